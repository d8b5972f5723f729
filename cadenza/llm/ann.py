"""Approximate nearest neighbours: a hash-prefix forest.

Every vector gets one 64-bit hash string per tree (signs of random projections).  A tree is the sorted
array of these strings.  A query descends each tree to its longest-prefix match by binary search, then all
trees ascend together, one bit at a time, and hand over what shares the shorter prefix, until enough
candidates are found.

1.  Rows are dealt evenly into shards of about ``SHARD_ROWS``; the forest of each is built once and written
    to the shared folder.  Queries are written in blocks of ``BLOCK_ROWS``.
2.  How many candidates a query needs depends on the vectors: clustered ones need few, random directions in
    many dimensions a large share of a shard.  The smallest share of ``SHARES`` is taken with which one
    shard's forest finds ``RECALL`` of its own true neighbours for ``SAMPLE`` of its rows.  That sample is
    bounded, and no row counts as its own neighbour; if no share suffices, all rows of the shards are searched.
    Everything else covers all rows.
3.  Each shard meets each block; a task holds one forest and one block at a time.  Candidates are scored by
    a matrix product (products that pass the largest number are made of scaled rows), all that its rounding error leaves in question are scored again by sums in the order
    of the components, and each shard hands on its best per query.  The best of these are merged.

All rows are indexed and no bucket is capped: if a prefix holds more rows than are needed, all of them are
candidates, so equal vectors are found together.  With queries a fixed share of the rows, as the contract
sets them, work grows with rows times queries.

Edge cases: null or zero vectors, and those with null or non-finite components or of another length than
most, take no part; if fewer than k candidates exist, all are returned; ties go to the smaller id;
repeated ids are rows of their own, as candidates and as queries, and a query leaves out one row that equals
it in id and vector, no other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.common import materialize, table

K = 20
TREES = 24
SHARES = (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.7, 0.8)
#: What a shard must find of its own rows' neighbours; nearest rows of all are found more often than those of a shard.
RECALL = 0.95
SAMPLE = 64
SHARD_ROWS = 16_384
BLOCK_ROWS = 512
#: Queries whose products with a shard are made at once: 8 MB at most.
PRODUCT_ROWS = 64
#: Lengths whose product is below this have finite inner products in every order.
SAFE = 1e300
#: Blocks that go to a shard's task together; the forest is sent once for them.
BLOCKS_A_TASK = 4
SEED = 7
BITS = 64


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def hash_strings(x: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """A 64-bit string per row: signs of projections, first bit highest.

    Rows are scaled by a power of two first, so that no projection overflows or vanishes.
    """
    planes = np.random.default_rng([seed, tree, x.shape[1]]).standard_normal((x.shape[1], BITS))
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])
    return np.packbits(x @ planes > 0, axis=1).view(">u8").ravel().astype(np.uint64)


class Forest:
    """Sorted arrays of hash strings over the rows of one shard."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, orders: np.ndarray, strings: np.ndarray, seed: int):
        self.ids, self.x, self.orders, self.strings, self.seed = ids, x, orders, strings, seed
        self.norms = np.linalg.norm(x, axis=1)

    @classmethod
    def of(cls, ids: np.ndarray, x: np.ndarray, trees: int, seed: int) -> Forest:
        hashes = [hash_strings(x, t, seed) for t in range(trees)]
        orders = np.array([np.argsort(h, kind="stable") for h in hashes], np.int32).reshape(trees, len(x))
        return cls(ids, x, orders, np.array([h[o] for h, o in zip(hashes, orders, strict=True)], np.uint64).reshape(trees, len(x)), seed)

    def candidates(self, queries: np.ndarray, wanted: int) -> Iterator[np.ndarray]:
        """For each query, the rows met by descending all trees and ascending them together."""
        n, hashes = len(self.x), [hash_strings(queries, t, self.seed) for t in range(len(self.orders))]
        bounds = []  # by prefix length: each tree's range for each query
        for length in range(BITS, -1, -1):
            low = np.uint64(((1 << length) - 1) << (BITS - length))
            rest = np.uint64((1 << (BITS - length)) - 1)
            bounds.append([(np.searchsorted(s, h & low, "left"), np.searchsorted(s, h | rest, "right")) for s, h in zip(self.strings, hashes, strict=True)])
        sizes = np.array([sum(hi - lo for lo, hi in level) for level in bounds])
        for q in range(len(queries)):
            # Ranges of one tree are nested, so what all trees hand over below the level at which there may be enough is
            # gathered at once; from there on, level by level, one tree after the other.
            step, met = int(np.searchsorted(sizes[:, q], min(wanted, n))), np.zeros(n, bool)
            for level in range(max(0, step - 1), BITS + 1):
                for order, (lo, hi) in zip(self.orders, bounds[level], strict=True):
                    met[order[lo[q] : hi[q]]] = True
                    if level >= step and np.count_nonzero(met) >= min(wanted, n):
                        break
                else:
                    continue
                break
            yield np.flatnonzero(met)


def ordered_products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the order of the components: equal rows score alike."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += x[:, j] * q[j]
    return total


def exact_products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``ordered_products``; sums that pass the largest number on their way are taken of scaled rows and end as what they are."""
    with np.errstate(over="ignore", invalid="ignore"):
        total = ordered_products(x, q)
        if not np.isfinite(total).all():
            far = ~np.isfinite(total)
            up, of_q = np.frexp(np.abs(x[far]).max(axis=1))[1], np.frexp(np.abs(q).max())[1]
            scaled = ordered_products(np.ldexp(x[far], -up[:, None]), np.ldexp(q, -of_q))
            total[far] = np.ldexp(scaled, up + of_q)
    return total


def best_of(ids: np.ndarray, x: np.ndarray, norms: np.ndarray, q: np.ndarray, k: int, met: np.ndarray | None = None, rough: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the ``k`` rows with the largest products, ties to the smaller id.

    ``norms`` are the rows' lengths.  ``met`` are the places that take part (else all), ``rough`` products of all rows in
    any order of summation, if there are any already.
    """
    met = np.arange(len(x)) if met is None else met
    length = np.linalg.norm(q)
    if len(met) > k and norms.max() * length < SAFE:
        near = x[met] @ q if rough is None else rough[met]
        # Any two orders of summation differ by less than this.
        slack = 2 * (x.shape[1] + 2) * np.finfo(float).eps * length * norms[met]
        kth = np.partition(near - slack, len(met) - k)[len(met) - k]
        met = met[near + slack >= kth]
    scores = exact_products(x[met], q)
    order = np.lexsort((ids[met], -scores))[:k]
    return met[order], scores[order]


def _wanted(share: float, rows: int, k: int) -> int:
    return max(2 * k, int(np.ceil(share * rows)))


def share_needed(forest: Forest, k: int, recall: float, shares: tuple[float, ...], sample: int) -> float:
    """The smallest of ``shares`` with which a forest finds ``recall`` of the true neighbours of its own rows."""
    asked = np.arange(0, len(forest.x), max(1, len(forest.x) // sample))[:sample]
    true = []
    for i in asked:  # a row is found for nothing by itself, so it does not count
        best = best_of(forest.ids, forest.x, forest.norms, forest.x[i], k + 1)[0].tolist()
        true.append(set([r for r in best if r != i][:k]))
    for share in shares:
        found = forest.candidates(forest.x[asked], _wanted(share, len(forest.x), k))
        if sum(len(t.intersection(met.tolist())) for t, met in zip(true, found, strict=True)) >= recall * sum(map(len, true)):
            return share
    return 1.0  # all rows of a shard: the exact way


_SHARD = "shard int, n int, ids binary, x binary, orders binary, strings binary"
_BLOCK = "block int, n int, rows binary, ids binary, x binary"


def _stacked(rows: pd.DataFrame) -> np.ndarray:
    return np.stack(rows["vector"].to_numpy()).astype(float)


def _unpacked(row, seed: int) -> Forest:
    n = int(row["n"])
    ids, x = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["x"], float).reshape(n, -1)
    return Forest(ids, x, np.frombuffer(row["orders"], np.int32).reshape(-1, n), np.frombuffer(row["strings"], np.uint64).reshape(-1, n), seed)


def _builder(trees: int, seed: int):
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        f = Forest.of(rows["vec_id"].to_numpy(np.int64), _stacked(rows), trees, seed)
        packed = [[int(rows["shard"].iloc[0]), len(rows), f.ids.tobytes(), f.x.tobytes(), f.orders.tobytes(), f.strings.tobytes()]]
        return pd.DataFrame(packed, columns=["shard", "n", "ids", "x", "orders", "strings"])

    return build


def _blocked(rows: pd.DataFrame) -> pd.DataFrame:
    packed = [[int(rows["block"].iloc[0]), len(rows), rows["row"].to_numpy(np.int64).tobytes(), rows["vec_id"].to_numpy(np.int64).tobytes(), _stacked(rows).tobytes()]]
    return pd.DataFrame(packed, columns=["block", "n", "rows", "ids", "x"])


def _measurer(k: int, seed: int, recall: float, shares: tuple[float, ...], sample: int):
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shards in batches:
            for _, row in shards.iterrows():
                yield pd.DataFrame({"share": [share_needed(_unpacked(row, seed), k, recall, shares, sample)]})

    return measure


def _searcher(k: int, share: float, seed: int):
    def search(shards: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out = []
        forest = _unpacked(shards.iloc[0], seed)
        for _, block in blocks.iterrows():
            n = int(block["n"])
            rows, ids, x = np.frombuffer(block["rows"], np.int64), np.frombuffer(block["ids"], np.int64), np.frombuffer(block["x"], float).reshape(n, -1)
            met = forest.candidates(x, _wanted(share, len(forest.x), k)) if share < 1 else iter([np.arange(len(forest.x))] * n)
            for at in range(0, n, PRODUCT_ROWS):
                # One product for some queries costs less than gathering each one's candidates.
                with np.errstate(over="ignore", invalid="ignore"):
                    rough = x[at : at + PRODUCT_ROWS] @ forest.x.T
                for row, query_id, q, near in zip(rows[at:], ids[at:], x[at:], rough, strict=False):
                    # One more than k: the query itself may be among them, and goes when shards are merged.
                    found, scores = best_of(forest.ids, forest.x, forest.norms, q, k + 1, next(met), near)
                    own = (forest.ids[found] == query_id) & (forest.x[found] == q).all(axis=1)
                    out.append((np.full(len(found), row), np.full(len(found), query_id), forest.ids[found], scores, own))
        return pd.DataFrame(dict(zip(("row", "query_id", "vec_id", "score", "own"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return search


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, trees: int = TREES, recall: float = RECALL, seed: int = SEED, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k nearest rows found, by inner product.

    ``vectors`` and ``queries`` have vec_id (a whole number) and embedding.
    """
    of = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")).where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    base, asked = of(vectors), of(queries)
    width = base.groupBy(F.size("vector").alias("w")).count().orderBy(F.desc("count"), "w").first()  # the most common length
    width, n = (width["w"], width["count"]) if width else (0, 0)
    shards, blocks = max(1, round(n / shard_rows)), max(1, -(-asked.count() // BLOCK_ROWS))
    # Dealt by a hash of id and vector and, for rows that repeat both, by their place in the table.
    dealt = lambda df, m: F.pmod(F.xxhash64("vec_id", "vector", F.monotonically_increasing_id()), F.lit(m)).cast("int")
    base, asked = base.where(F.size("vector") == width), asked.where(F.size("vector") == width).withColumn("row", F.monotonically_increasing_id())
    forests = materialize(base.withColumn("shard", dealt(base, shards)).groupBy("shard").applyInPandas(_builder(trees, seed), _SHARD), "ann-forests")
    packed = materialize(asked.withColumn("block", dealt(asked, blocks)).groupBy("block").applyInPandas(_blocked, _BLOCK), "ann-queries")
    first = forests.where(F.col("shard") == forests.agg(F.min("shard")).first()[0]) if n else forests
    measured = first.mapInPandas(_measurer(k, seed, recall, SHARES, SAMPLE), "share double").first()
    share = measured["share"] if measured else SHARES[-1]
    tasks = max(1, -(-blocks // BLOCKS_A_TASK))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = forests.withColumn("part", every(tasks)).groupBy("shard", "part")
    right = packed.withColumn("part", F.pmod("block", F.lit(tasks))).withColumn("shard", every(shards)).groupBy("shard", "part")
    found = materialize(left.cogroup(right).applyInPandas(_only_both(_searcher(k, share, seed)), "row long, query_id long, vec_id long, score double, own boolean"), "ann-found")
    # Of the rows that equal the query in id and vector, one is the query.
    turn = F.row_number().over(Window.partitionBy("row", "own").orderBy(F.desc("score"), "vec_id"))
    others = found.withColumn("turn", turn).where("NOT own OR turn > 1")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return others.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _only_both(search):
    empty = pd.DataFrame({"row": np.zeros(0, np.int64), "query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0), "own": np.zeros(0, bool)})
    return lambda shards, blocks: search(shards, blocks) if len(shards) and len(blocks) else empty


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
