"""Mixing sources to target weights (native): pivotal dependent rounding of copy counts.

A source's target divided by its words is the number of times each of its documents should be taken.
The whole part is taken outright; the rest is a fractional probability ``p`` per document, and documents
carry the mass ``size * p``.  Of the fractional documents the largest is settled first: chance decides by ``p``
whether it is taken, and the mass that this asks for or sets free is transferred from or to its smaller partners, each
in the share that keeps its expected probability.  Then the next largest is settled, and so on.  Mass is only moved,
never made, so what is left at the end is a part of one of the smallest documents.

The transfers form a reduction tree: documents are dealt by hash into groups of about ``FAN_IN``, each group
is settled down to one residual, and the residuals of a source go through the same step until
a source has one group left.  No group ever grows with its source.  Where a document is so large that its partners
together cannot make up for it (a source of few documents), expectations give way to the target: it goes the way
that ends nearer.

Equal rows form a class, which is one document of that tree: it takes its rows' copies together, and they share
them evenly.  So a row that is repeated a million times is one member of one group.

Edge cases: null texts have size 0 and are never taken; a source of size 0 has target 0; null sources are
one source, placed last; with no words at all nothing is taken; rows that differ in any column are told apart
by ``mix``, and no row is taken more than ``max_repeat`` times.  All random choices hash the row, its size and the
seed, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.common import columns, comparable, each_of, free_name, marks, materialize, sieve, split, table

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3.0
FAN_IN = 128
#: Sources whose facts are broadcast to every row: some 5 MB at most.
MAX_BROADCAST_SOURCES = 50_000
SEED = 20_240_601
_WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Water filling: sources stop at ``max_repeat`` times their size in the order of size over weight.  If
    the first j of that order stop, what is left is shared by the others' weights; j is the number of
    sources for which their own limit is at most what they would get.
    """
    code = F.encode(F.coalesce("source", F.lit("")), "UTF-8")
    ordered = Window.orderBy(F.col("source").isNull(), code)
    ranked = sizes.withColumn("rank", F.row_number().over(ordered) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumns({"weight": weight, "limit": F.col("source_size") * F.lit(max_repeat)})
    fill = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    upto = fill.rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumns({
        "total": F.sum("source_size").over(everything).cast("double"),
        "weights_from": F.sum("weight").over(everything) - F.sum("weight").over(upto) + F.col("weight"),
        "limits_before": F.sum("limit").over(upto) - F.col("limit"),
    })
    stops = F.col("limit") / F.col("weight") <= (F.col("total") - F.col("limits_before")) / F.col("weights_from")
    ranked = ranked.withColumn("stops", stops)
    left = F.col("total") - F.sum(F.when(F.col("stops"), F.col("limit")).otherwise(0.0)).over(everything)
    free = F.sum(F.when(F.col("stops"), 0.0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("stops"), F.col("limit")).otherwise(left * F.col("weight") / free)
    return ranked.select("source", "source_size", F.least(target, F.col("limit")).alias("target"))


#: Probabilities this near to 0 or 1 are that.
_NEAR = 1e-9


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _pivot(items: Column, i: Column, last: Column) -> Column:
    """The members of a group, largest first, after the i-th was settled against all behind it.

    Taking it whole asks for size * (1 - p) of the others' mass, leaving it out gives them size * p.  Where the
    others can do either in the shares that keep everyone's expectation, chance decides by p.  Where they can do either
    only otherwise, chance decides still and they give or take in proportion to what they have or lack.  Where they
    cannot, they go as far as they can, and the member stays open; in a source's last group it then goes the way
    that ends nearer to the target.
    """
    zero = F.lit(0.0)
    me, others = F.element_at(items, i), F.slice(items, i + 1, F.size(items))
    total = lambda part: F.aggregate(others, zero, lambda acc, x: acc + x["size"] * part(x))
    even = lambda x, p: F.least(x["p"], (1 - x["p"]) * (1 - p) / p)

    def settled(f: Column) -> Column:
        p, size = f["me"]["p"], f["me"]["size"].cast("double")
        up, down = size * (1 - p), size * p
        fair, able = f["cap"] >= up, (f["low"] >= up) & (f["room"] >= down)
        chance = f["me"]["u"] < F.when(fair | able, p).otherwise(f["room"] / F.greatest(f["low"] + f["room"], F.lit(_NEAR)))
        rises = F.when(~(fair | able) & last, up - f["low"] <= down - f["room"]).otherwise(chance)
        moved = F.when(rises, F.least(up, F.when(fair, up).otherwise(f["low"]))).otherwise(F.least(down, F.when(fair, down).otherwise(f["room"])))

        def with_all(g: Column) -> Column:
            def shifted(x: Column) -> Column:
                # Fair shares: a member that gives a share on the way up takes p / (1 - p) of it on the way down.
                step = F.when(fair, even(x, p) * F.when(g["rises"], -up / f["cap"]).otherwise(p / (1 - p) * up / f["cap"])).otherwise(
                    F.when(g["rises"], -x["p"] * g["moved"] / F.greatest(f["low"], F.lit(_NEAR))).otherwise((1 - x["p"]) * g["moved"] / F.greatest(f["room"], F.lit(_NEAR)))
                )
                return x.withField("p", _snapped(x["p"] + F.when((x["p"] > 0) & (x["p"] < 1), step).otherwise(zero)))

            own = _snapped(p + F.when(g["rises"], g["moved"]).otherwise(-g["moved"]) / size)
            ended = F.when(last, F.when(g["rises"], 1.0).otherwise(0.0)).otherwise(own)
            return F.concat(F.slice(items, F.lit(1), i - 1), F.array(f["me"].withField("p", ended)), F.transform(others, shifted))

        return F.when((p > 0) & (p < 1), _let(F.struct(rises.alias("rises"), moved.alias("moved")), with_all)).otherwise(items)

    # Members that are settled have nothing to give and no room: their p is 0 or 1.
    open_ = lambda x: (x["p"] > 0) & (x["p"] < 1)
    p = F.greatest(F.least(me["p"], F.lit(1 - _NEAR)), F.lit(_NEAR))
    facts = F.struct(
        me.alias("me"),
        total(lambda x: F.when(open_(x), even(x, p)).otherwise(zero)).alias("cap"),
        total(lambda x: F.when(open_(x), x["p"]).otherwise(zero)).alias("low"),
        total(lambda x: F.when(open_(x), 1 - x["p"]).otherwise(zero)).alias("room"),
    )
    return _let(facts, settled)


def _snapped(p: Column) -> Column:
    return F.when(p < _NEAR, 0.0).when(p > 1 - _NEAR, 1.0).otherwise(p)


def settled_group(members: Column, last: Column) -> Column:
    """The members (size, p, u, id), largest first, of which one at most stays open, and none if ``last``."""
    return F.aggregate(F.sequence(F.lit(1), F.size(members)), members, lambda items, i: _pivot(items, i, last))


def rounded(items: DataFrame, seed: int = SEED, fan_in: int = FAN_IN) -> DataFrame:
    """(source, item) with each item's p in {0, 1} from (source, item) with fractional p.

    ``item`` is a struct (size, p, u, id).  Items with p of 0 or 1 or without size are passed through.
    """
    open_ = (F.col("item.p") > 0) & (F.col("item.p") < 1) & (F.col("item.size") > 0)
    out = items.where(~open_)
    left, level = items.where(open_), 0
    while True:
        counts = left.groupBy("source").agg(F.count("*").alias("n"))
        largest = counts.agg(F.max("n")).first()[0] or 0
        groups = F.ceil(F.col("n") / fan_in)
        dealt = left.join(counts.withColumnRenamed("source", "c_source"), left["source"].eqNullSafe(F.col("c_source"))).withColumn(
            "grp", F.pmod(F.xxhash64(F.col("item.id"), F.col("item.size"), F.col("item.u"), F.lit(seed + level)), groups)
        )
        dealt = dealt.withColumn("item", F.col("item").withField("u", F.shiftrightunsigned(F.xxhash64("item.id", F.lit(seed + level)), 11) / F.lit(float(1 << 53))))
        grouped = dealt.groupBy("source", "grp").agg(F.sort_array(F.collect_list("item"), asc=False).alias("members"), (F.max("n") <= fan_in).alias("last"))
        folded = materialize(grouped.select("source", F.explode(settled_group(F.col("members"), F.col("last"))).alias("item")), "rounded")
        out = out.unionByName(folded.where(~open_))
        if largest <= fan_in:  # every source had its last group
            return out
        left, level = folded.where(open_), level + 1


def _classes(docs: DataFrame, weights: Sequence[float], max_repeat: float, seed: int, fan_in: int) -> tuple[DataFrame, DataFrame]:
    """(classes, goal).  Classes of rows that agree in all columns: k1, k2, doc_id, source, size, n (rows), source_size,
    target, usual (copies of most single rows of the source), base (copies of each row) and extra (rows with one more)."""
    keys = dict(zip(("k1", "k2"), marks(*[comparable(docs, c) for c in docs.columns]), strict=True))
    sized = docs.select(*[c.alias(k) for k, c in keys.items()], "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long").alias("size"))
    sized = materialize(sized.groupBy("k1", "k2", "doc_id", "source", "size").agg(F.count("*").alias("n")), "sizes")
    goal = targets(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, max_repeat)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    usual = F.round(ratio).cast("long")
    goal = materialize(goal.withColumns({"ratio": ratio, "usual": usual}), "targets")
    wanted = sized.join(goal.withColumnRenamed("source", "t_source"), sized["source"].eqNullSafe(F.col("t_source"))).drop("t_source")
    copies_ = F.col("ratio") * F.col("n")
    wanted = wanted.withColumn("whole", F.floor(copies_ + 1e-9)).withColumn("p", F.greatest(copies_ - F.col("whole"), F.lit(0.0)))
    item = F.struct("size", F.when(F.col("p") < 1e-9, 0.0).otherwise(F.col("p")).alias("p"), F.lit(0.0).alias("u"), F.struct("k1", "k2").alias("id"))
    done = rounded(wanted.select("source", item.alias("item")), seed, fan_in)
    up = done.select(F.col("item.id.k1").alias("k1"), F.col("item.id.k2").alias("k2"), F.col("item.p").cast("long").alias("up"))
    taken = F.when(F.col("size") > 0, F.col("whole") + F.col("up")).otherwise(0)
    even = wanted.join(up, ["k1", "k2"]).withColumn("all", taken.cast("long")).withColumns({"base": F.call_function("div", F.col("all"), F.col("n")), "extra": F.col("all") % F.col("n")})
    return materialize(even.select("k1", "k2", "doc_id", "source", "size", "n", "source_size", "target", "usual", "base", "extra"), "mix-classes"), goal


def copies(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: float = MAX_REPEAT, seed: int = SEED, fan_in: int = FAN_IN) -> DataFrame:
    """Per document row: doc_id, source, size, source_size, target, copies."""
    classes, _ = _classes(docs, weights, max_repeat, seed, fan_in)
    every = each_of(classes, "n", "nth")
    return every.select("doc_id", "source", "size", "source_size", "target", (F.col("base") + (F.col("nth") < F.col("extra")).cast("long")).alias("copies"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: float = MAX_REPEAT, seed: int = SEED, fan_in: int = FAN_IN) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it.

    Most rows of a source are taken as often as its ratio says, rounded; those stay where they are.  The others
    are listed, and only rows that may be among them are shuffled to meet the list.
    """
    k1, k2, n, s_source, usual = (free_name(docs, c) for c in ("mix_k1", "mix_k2", "mix_n", "mix_source", "mix_usual"))
    classes, goal = _classes(docs, weights, max_repeat, seed, fan_in)
    apart = classes.where("size > 0 AND (base <> usual OR extra > 0)").select(F.col("k1").alias(k1), F.col("k2").alias(k2), "base", "extra")
    apart = materialize(apart, "mix-apart")
    goal = goal.select(F.col("source").alias(s_source), F.col("usual").alias(usual))
    if goal.count() <= MAX_BROADCAST_SOURCES:  # beyond it the join is left to Spark
        goal = F.broadcast(goal)
    keyed = docs.withColumns(dict(zip((k1, k2), marks(*[comparable(docs, c) for c in docs.columns]), strict=True)))
    keyed = keyed.join(goal, F.col("source").eqNullSafe(F.col(s_source))).drop(s_source)
    own = F.when(F.coalesce(F.col("text").rlike(_WORD), F.lit(False)), F.col(usual)).otherwise(0)
    times = lambda rows, count: rows.withColumn(n, count).where(F.col(n) > 0).withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*columns(docs))
    maybe, rest = split(keyed, apart, k1)
    base, extra = free_name(keyed, "base"), free_name(keyed, "extra")
    listed = maybe.join(apart.select(k1, k2, F.col("base").alias(base)), [k1, k2], "left")
    out = times(rest, own).unionByName(times(listed, F.coalesce(F.col(base), own)))
    more = apart.where("extra > 0").select(k1, k2, F.col("extra").alias(extra))
    if more.isEmpty():
        return out
    # Copies that equal rows could not share evenly: one of the rows is as good as another.
    one = sieve(keyed, more, k1).groupBy(k1, k2).agg(F.first(F.struct(*columns(docs))).alias(n))
    repeated = each_of(one.join(more, [k1, k2]), extra, usual)
    return out.unionByName(repeated.select(*[F.col(n)[c].alias(c) for c in docs.columns]))


def report(docs: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    mixed = copies(docs, weights)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
