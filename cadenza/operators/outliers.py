"""Declared rating against observed listening, and the fuzzy match of listens to declared songs.

The match ladder is a chain of equi-joins on normalised titles with a check of artists; what one step has
taken is anti-joined before the next.  No step compares every heard with every song.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza import schema as S
from cadenza.functions import text as X
from cadenza.functions import values as V
from cadenza.operators.ordered import dealt, median, numbered
from cadenza.sources.sinks import staged

EXACT, STRIPPED = 2, 1
#: Songs of a side that are paired in one place, and pairs of songs that a task is to return, while classes become songs again.
BLOCK, PER_TASK, MAX_TASKS = 2048, 50_000_000, 20_000


def songs(rows: DataFrame) -> DataFrame:
    """(title, artist, ...) with the keys that songs are matched on."""
    return rows.withColumns({"exact_key": X.normalize_words(F.col("title")), "stripped_key": X.strip_version(F.col("title")), "artists": X.split_artists(F.col("artist"))})


def _mark(*columns: str) -> Column:
    """128 bits of hashes in place of the columns.  Nulls count."""
    seen = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    return F.struct(F.xxhash64(*seen).alias("h1"), F.xxhash64(F.lit(1), *seen).alias("h2"))


def _members(songs: DataFrame) -> DataFrame:
    """(mbid, name): songs with the mark of their title and artist."""
    return songs.select("mbid", _mark("title", "artist").alias("name"))


def _ids(declared: DataFrame) -> DataFrame:
    """(mbid): declared ids, as many as songs, to be joined without a broadcast: the size of files underrates them."""
    return declared.select("mbid").hint("merge")


def _names(rows: DataFrame, side: str) -> DataFrame:
    """(name, class, keys, artists, n): titles and artists, each pair once, with the number of their songs.

    Keys are made per name, not per song, and behind a shuffle: by as many tasks as there are, however few files the
    songs lie in.  Names that are matched alike, because keys and artists are equal, share a class.
    """
    named = songs(rows.groupBy("title", "artist").agg(F.count("*").alias("n")))
    keys = ("exact_key", "stripped_key", "artists")
    return staged(named.select(_mark("title", "artist").alias("name"), _mark(*keys).alias(side), *keys, "n"), f"names-{side}")


def _classes(names: DataFrame, side: str) -> DataFrame:
    """Classes as one row each: keys, artists and the number of songs."""
    keys = ("exact_key", "stripped_key", "artists")
    counted = names.groupBy(side, *keys).agg(F.sum("n").alias("n"))
    return counted.select(side, *[F.col(c).alias(f"{side}_{c}") for c in (*keys, "n")])


def _class_pairs(declared: DataFrame, listened: DataFrame) -> DataFrame:
    """(d, l, level, d_n, l_n, agree) of classes whose titles are equal, or equal without versions."""
    exact = declared.join(listened, F.col("d_exact_key") == F.col("l_exact_key")).where("l_exact_key <> ''").withColumn("level", F.lit(EXACT))
    stripped = declared.join(listened, F.col("d_stripped_key") == F.col("l_stripped_key")).where("l_stripped_key <> '' AND d_exact_key <> l_exact_key AND d_exact_key <> ''").withColumn("level", F.lit(STRIPPED))
    both = exact.unionByName(stripped)
    return staged(both.select("d", "l", "level", "d_n", "l_n", X.artists_compatible(F.col("d_artists"), F.col("l_artists"), F.col("level") == EXACT).alias("agree")), "song-pairs")


def _song_pairs(pairs: DataFrame, declared: DataFrame, listened: DataFrame, d_names: DataFrame, l_names: DataFrame) -> DataFrame:
    """(entry, mbid): the songs of pairs (d, l, d_n, l_n) of classes, but for listened songs whose id is declared.

    The listened songs of a class and all entries that it is paired with are cut into blocks.  Each pair of blocks is a
    cell, and cells are dealt over the tasks, which sort and join their songs: a task holds a block beside a song at once,
    and a title that many songs share is spread over many tasks.  A song is shuffled once for each block that it is paired
    with; where classes are single songs, that is once for each pair.
    """
    spark = pairs.sparkSession
    groups = pairs.groupBy("l").agg(F.sum("d_n").alias("d_all"), F.max("l_n").alias("l_n"))
    blocks = {f"{side}_blocks": F.ceil(F.col(n) / BLOCK) for side, n in (("d", "d_all"), ("l", "l_n"))}
    groups = staged(groups.withColumns(blocks).withColumn("group", F.monotonically_increasing_id()), "song-groups")
    total = lambda n, times: F.coalesce(F.sum(F.col(n).cast("double") * F.col(times)), F.lit(0.0))
    n, entries, heard = groups.agg(total("d_all", "l_n"), total("d_all", "l_blocks"), total("l_n", "d_blocks")).first()
    tasks = min(max(4 * spark.sparkContext.defaultParallelism, int(n / PER_TASK) + 1), MAX_TASKS)

    place = ("group", "d_blocks", "l_blocks")
    d_wanted = staged(d_names.select("name", "d").join(pairs.select("d", "l"), "d").join(groups, "l").select("name", *place), "song-wanted")
    l_wanted = staged(l_names.select("name", "l").join(groups, "l").select("name", *place), "song-wanted")
    block = lambda of: F.pmod(F.xxhash64("mbid"), F.col(of))
    each = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    # Rows are dealt before they become many.
    left = dealt(_members(declared), int(entries), "mbid").join(d_wanted, "name").select("group", F.col("mbid").alias("entry"), block("d_blocks").alias("d_block"), "l_blocks", each("l_blocks").alias("l_block"))
    others = dealt(_members(listened), int(heard), "mbid").join(l_wanted, "name").join(_ids(declared), "mbid", "left_anti")
    right = others.select("group", "mbid", block("l_blocks").alias("l_block"), "l_blocks", each("d_blocks").alias("d_block"))
    cell = (F.col("d_block") * F.col("l_blocks") + F.col("l_block")).alias("cell")
    left, right = (rows.select("group", cell, column).repartition(tasks, "group", "cell") for rows, column in ((left, "entry"), (right, "mbid")))
    return left.join(right.hint("merge"), ["group", "cell"]).select("entry", "mbid")


def title_matches(declared: DataFrame, listened: DataFrame, level: int) -> DataFrame:
    """(entry, mbid): declared and listened songs of other ids whose titles match at ``level`` and whose artists agree."""
    d, l = _names(declared, "d"), _names(listened, "l")  # noqa: E741
    return _song_pairs(_class_pairs(_classes(d, "d"), _classes(l, "l")).where(F.col("agree") & (F.col("level") == level)), declared, listened, d, l)


def _ladder(declared: DataFrame, listened: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """The steps of :func:`assign`: (same, matched, unique, d_names, l_names).

    ``same`` are pairs of songs, ``matched`` pairs (d, l, d_n, l_n) of classes, ``unique`` rows (l, d) whose class d is a single
    entry; classes l may hold listened songs that are in ``same``, which take no part in the later steps.
    """
    same = listened.join(_ids(declared), "mbid", "left_semi").select(F.col("mbid").alias("entry"), "mbid")
    d_names, l_names = _names(declared, "d"), _names(listened, "l")
    d, l = _classes(d_names, "d"), _classes(l_names, "l")  # noqa: E741
    pairs = _class_pairs(d, l)
    best = F.max("level").over(Window.partitionBy("l"))
    matched = pairs.where("agree").withColumn("best", best).where("level = best").select("d", "l", "d_n", "l_n")
    # Titles alone: an exact title is stripped-equal too, so the stripped count includes exact ones.
    done = matched.select("l").distinct()
    only = lambda rows: rows.groupBy("l").agg(F.sum("d_n").alias("n"), F.min("d").alias("d")).where("n = 1").select("l", "d")
    unique_exact = only(pairs.where(F.col("level") == EXACT).join(done, "l", "left_anti"))
    by_stripped = only(d.join(l, F.col("d_stripped_key") == F.col("l_stripped_key")).where("d_stripped_key <> ''").join(done, "l", "left_anti"))
    unique = staged(unique_exact.unionByName(by_stripped.join(unique_exact, "l", "left_anti")), "song-unique")
    return same, matched, unique, d_names, l_names


def assign(declared: DataFrame, listened: DataFrame) -> DataFrame:
    """(entry, mbid, step): which declared entries each listened recording counts for.

    Step 0: the same id.  1: every entry at the best level at which title and artist match.  2: the only
    entry of that exact title, else of that stripped title.

    What is compared are classes of songs with equal keys and artists; only what is assigned becomes pairs of songs again.
    """
    same, matched, unique, d_names, l_names = _ladder(declared, listened)
    first = _song_pairs(staged(matched, "song-matched"), declared, listened, d_names, l_names)
    owner = staged(unique.join(d_names.select("name", "d"), "d").select("name", "l"), "song-unique")
    entry = _members(declared).join(owner, "name").select(F.col("mbid").alias("entry"), "l")
    owned = staged(entry.join(l_names.select("name", "l"), "l").select("entry", "name"), "song-unique")
    alone = _members(listened).join(owned, "name").join(_ids(declared), "mbid", "left_anti").select("entry", "mbid")
    steps = [rows.withColumn("step", F.lit(step)) for step, rows in enumerate((same, first, alone))]
    return steps[0].unionByName(steps[1]).unionByName(steps[2])


def assigned_once(declared: DataFrame, listened: DataFrame) -> DataFrame:
    """(mbid): the listened recordings that :func:`assign` gives any entry, each once, without the pairs."""
    same, matched, unique, _, l_names = _ladder(declared, listened)
    classes = matched.select("l").unionByName(unique.select("l")).distinct()
    taken = staged(l_names.join(classes, "l", "left_semi").select("name"), "song-taken")
    return same.select("mbid").unionByName(_members(listened).join(taken, "name", "left_semi").select("mbid")).distinct()


def observations(declared: DataFrame, counts: DataFrame, age: DataFrame) -> DataFrame:
    """(mbid, q, heard, days, rate): declared entries with their listens and age, 0 where unknown."""
    row = declared.select("mbid", "q").join(counts.select("mbid", "heard"), "mbid", "left").join(age.select("mbid", "days"), "mbid", "left")
    row = row.withColumns({"heard": F.coalesce("heard", F.lit(0)), "days": F.coalesce("days", F.lit(0))})
    return row.withColumn("rate", V.rate(F.col("heard"), F.col("days")))


def old_enough(observed: DataFrame, days: int = S.MIN_AGE_DAYS) -> DataFrame:
    return observed.where(F.col("days") >= days)


def median_per_q(observed: DataFrame) -> DataFrame:
    return median(old_enough(observed), "rate", ("q",))


def nearest_q(observed: DataFrame, median: DataFrame) -> DataFrame:
    """Old entries with ``observed``, the q whose median rate is nearest; ties to the lower q.

    There are five values of q at most, so their medians are joined to every row.
    """
    candidates = old_enough(observed).crossJoin(F.broadcast(median.select(F.col("q").alias("m_q"), "median")))
    near = F.min_by("m_q", F.struct(F.abs(F.col("rate") - F.col("median")), F.col("m_q")))
    return candidates.groupBy("mbid", "q", "heard", "days", "rate").agg(near.alias("observed"))


def outliers(observed: DataFrame) -> DataFrame:
    return nearest_q(observed, median_per_q(observed)).where("observed <> q")


def ranked_outliers(observed: DataFrame) -> DataFrame:
    """Outliers with ``rank`` from 1: the furthest from their declared q first, then by rate."""
    return numbered(outliers(observed), F.desc(F.abs(F.col("q") - F.col("observed"))), F.desc("rate"), "mbid", name="rank", first=1)


def undeclared(listened: DataFrame, assigned: DataFrame) -> DataFrame:
    return listened.join(assigned.select("mbid").distinct(), "mbid", "left_anti")


def _lines(log: DataFrame) -> DataFrame:
    """Diff lines (commit, at, line, sign, mbid, rest) with ``turn``: which removed line of its commit and rest a line
    is, or, for an added line, which one it takes the place of; null if none is left.

    Lines count in the order of commit and line, at equal lines removed ones first.  An added line takes the earliest
    removed line above it that has the same rest and is not taken yet.
    """
    upto = Window.partitionBy("commit", "rest").orderBy("line", F.desc("sign"), "mbid").rowsBetween(Window.unboundedPreceding, 0)
    removals, additions = F.count_if(F.col("sign") == "-").over(upto), F.count_if(F.col("sign") == "+").over(upto)
    counted = log.where("sign IN ('+', '-')").withColumns({"removals": removals, "additions": additions})
    # ``bare`` counts the additions so far that found no removed line left.
    lines = counted.withColumn("bare", F.greatest(F.max(F.col("additions") - F.col("removals")).over(upto), F.lit(0)))
    before = F.coalesce(F.lag("bare").over(Window.partitionBy("commit", "rest").orderBy("line", F.desc("sign"), "mbid")), F.lit(0))
    return lines.withColumn("turn", F.when(F.col("sign") == "-", F.col("removals")).when(F.col("bare") == before, F.col("additions") - F.col("bare")))


def first_added(log: DataFrame) -> DataFrame:
    """(mbid, at): when each entry was first added, from diff lines (commit, at, line, sign, mbid, rest).

    If an id's first addition takes the place of a removed id that was added before, it inherits that one's date;
    later additions change nothing.  So links lead back in the log, never in a circle, and are followed to their start.
    """
    lines = _lines(log)
    place = F.struct("commit", "line", "mbid").alias("place")
    # Structs are aggregated by sorting: they hold each column once.
    first = lines.where("sign = '+'").groupBy("mbid").agg(F.min(F.struct("commit", "line", "at", "rest", "turn")).alias("f")).select("mbid", "f.*")
    first = staged(first.select("mbid", place, "at", "commit", "rest", "turn"), "first-added")
    old = lines.where("sign = '-'").select("commit", "rest", "turn", F.col("mbid").alias("parent"))
    earlier = first.select(F.col("mbid").alias("parent"), F.col("place").alias("parent_place"))
    swaps = staged(first.join(old, ["commit", "rest", "turn"]).join(earlier, "parent").where("parent_place < place").select("mbid", "parent"), "swaps")
    while True:  # pointer jumping: chains of length n take log n rounds, each from a table
        up = swaps.select(F.col("mbid").alias("parent"), F.col("parent").alias("grand"))
        jumped = staged(swaps.join(up, "parent", "left").select("mbid", "parent", "grand"), "swaps")
        swaps = jumped.select("mbid", F.coalesce("grand", "parent").alias("parent"))
        if jumped.where("grand IS NOT NULL").isEmpty():
            break
    root = first.select(F.col("mbid").alias("parent"), F.col("at").alias("root_at"))
    return first.select("mbid", "at").join(swaps, "mbid", "left").join(root, "parent", "left").select("mbid", F.coalesce("root_at", "at").alias("at"))


def replacement_pairs(log: DataFrame) -> DataFrame:
    """(commit, mbid, inherited): added lines and the removed ones that they take the place of, if the ids differ."""
    lines = _lines(log)
    pairs = lines.where("sign = '-'").alias("r").join(lines.where("sign = '+'").alias("a"), ["commit", "rest", "turn"]).where("r.mbid <> a.mbid")
    return pairs.select("commit", F.col("a.mbid").alias("mbid"), F.col("r.mbid").alias("inherited"))
