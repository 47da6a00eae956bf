"""Nearest neighbours by a block matrix join of int8 tiles.

Vectors are scaled to length one and quantised to int8 with a scale of their own.  Queries and candidates are packed into
blocks; each query block meets each candidate block in one tile, whose int8 products are taken by an exact
float32 matrix product (at most 1,024 dimensions at a time, so that sums stay below 2**24).  With u = s q + e,
|u . v - s_u s_v (q_u . q_v)| <= |s_u q_u| |e_v| + |e_u|, so a tile can drop every pair whose upper bound is below
the k-th best its query has met, or at first the k-th lower bound of the tile.  Survivors are recomputed in double precision from the original
vectors, a list per query keeps the k best of a task, and the tasks' lists are merged.

Blocks are not joined by Spark, which would keep the query blocks of a key on the heap and copy both blocks for every tile: they are sorted so that a task reads the query blocks
of a group first and then meets them with one candidate block after the other.  A group has at most ``QUERY_BYTES`` of queries, so a task needs the same memory
at any size; the number of tiles grows with queries times candidates.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, neither as query nor as candidate;
vectors are compared only with those of their own length; other columns, whatever their names, are not read; a repeated vec_id is a repeated
candidate, and a query never meets rows with its own id; repeated query rows are answered once (for the smallest vector, if they differ); ties fall to the smaller vec_id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, CANDIDATE_BLOCK = 512, 4096
MOST_DIMENSIONS = 1024
#: Most bytes of query vectors that a task holds; candidates are sent once for each such part of the queries.
QUERY_BYTES = 128 << 20
#: Float32 and rounding slack on top of the quantisation bound.
SLACK = 1e-5


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of a and b (float64), summed one component after the other, whatever the number of rows.

    Rows are scaled by a power of two first, which changes no cosine and keeps squares from overflowing.
    """
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) for x in (a, b))
    dot, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), strict=True):
        dot += x * y
        aa += x * x
        bb += y * y
    return dot / (np.sqrt(aa) * np.sqrt(bb))


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the rows scaled to length one, the scale, and the length of what is left."""
    biggest = np.abs(v).max(axis=1, keepdims=True)
    u = v / biggest
    u /= np.sqrt((u * u).sum(axis=1, keepdims=True))
    scale = np.abs(u).max(axis=1, keepdims=True) / 127.0
    codes = np.rint(u / scale)
    rest = np.sqrt(((u - codes * scale) ** 2).sum(axis=1))
    return codes.astype(np.int8), scale[:, 0], rest


def tile_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer products of two int8 matrices, exact."""
    out = None
    for k in range(0, q.shape[1], MOST_DIMENSIONS):
        part = q[:, k : k + MOST_DIMENSIONS].astype(np.float32) @ c[:, k : k + MOST_DIMENSIONS].astype(np.float32).T
        out = part if out is None else out + part.astype(np.float64)
    return out


class Asked:
    """A block of queries with the k best that each has met, nearest first: scores and ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.codes, self.scale, self.rest = quantise(vectors.astype(np.float64))
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def meet(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, scale: np.ndarray, rest: np.ndarray) -> None:
        """One tile: a block of candidates, quantised."""
        about = tile_products(self.codes, codes)
        about *= scale.astype(np.float32)
        error = (1.0 + self.rest) * rest.max() + self.rest + SLACK
        least = self.score[:, -1]
        new = np.flatnonzero(np.isneginf(least))
        if len(new) and len(ids) > self.k:
            met = np.where(self.ids[new, None] == ids, -np.inf, about[new] * self.scale[new, None])
            least = least.copy()
            least[new] = np.partition(met, -self.k, axis=1)[:, -self.k] - error[new]
        may = about >= ((least - error) / self.scale).astype(np.float32)[:, None]
        i, j = np.divmod(np.flatnonzero(may), len(ids))
        other = self.ids[i] != ids[j]
        i, j = i[other], j[other]
        for at in range(0, len(i), 1 << 16):
            x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            self.keep(x, ids[y], exact_cosine(self.vectors[x].astype(np.float64), vectors[y].astype(np.float64)))

    def keep(self, rows: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Merge found (row, id, score) into the k best, ties to the smaller id."""
        seen = np.unique(rows)
        rows = np.concatenate([rows, np.repeat(seen, self.k)])
        ids, score = np.concatenate([ids, self.found[seen].ravel()]), np.concatenate([score, self.score[seen].ravel()])
        order = np.lexsort((ids, -score, rows))
        starts = np.searchsorted(rows[order], seen)
        best = order[starts[:, None] + np.arange(self.k)]
        self.score[seen], self.found[seen] = score[best], ids[best]

    def result(self) -> pa.RecordBatch:
        i, j = np.nonzero(~np.isneginf(self.score))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[i]), pa.array(self.found[i, j]), pa.array(self.score[i, j])], names=["query_id", "vec_id", "score"])


def packed(df: DataFrame, block: int) -> DataFrame:
    """Blocks of vectors: dim, ids (bytes of int64) and data (bytes of float32 or float64, as the vectors are)."""
    number = "<f4" if dict(df.dtypes)["vector"] == "array<float>" else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}

        def out(dim: int, rows: list) -> pa.RecordBatch:
            ids = np.array([r[0] for r in rows], "<i8").tobytes()
            data = np.concatenate([r[1] for r in rows]).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids], pa.binary()), pa.array([data], pa.binary())], names=["dim", "ids", "data"])

        for batch in batches:
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = np.asarray(vector.values.to_numpy(zero_copy_only=False), number)
                rows = waiting.setdefault(len(v), [])
                rows.append((key, v))
                if len(rows) == block:
                    yield out(len(v), waiting.pop(len(v)))
        for dim, rows in waiting.items():
            yield out(dim, rows)

    return df.mapInArrow(run, "dim int, ids binary, data binary")


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    element = "float" if df.select(vector).dtypes[0][1] == "array<float>" else "double"
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(f"array<{element}>").alias("vector")).where("id is not null and vector is not null")
    return v.where(finite & F.exists("vector", lambda x: x != 0))


def search(df: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding", spread: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by cosine of every row whose id is divisible by ``every``.

    Candidate blocks are dealt to ``spread`` groups, each of which meets all queries: by default one for each candidate block, at most four
    for each shuffle partition (a group beyond the number of tasks would only copy the queries once more), and so many that the copies of the queries are about as many as the rows.
    """
    vectors = usable(df, key, vector)
    asked = vectors.where(F.col("id") % every == 0).groupBy("id").agg(F.min("vector").alias("vector"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = vectors.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("id") % every == 0, 1)).alias("asked"), F.sum(F.when(F.col("id") % every == 0, F.size("vector"))).alias("numbers")).first()
    width = 4 if dict(vectors.dtypes)["vector"] == "array<float>" else 8
    parts = max(1, -(-(counted.numbers or 0) * width // QUERY_BYTES))
    if spread is None:
        spread = max(16, min(-(-counted.n // CANDIDATE_BLOCK), 4 * tasks, counted.n // max(1, counted.asked)))
    # sorted, so that a task that runs again packs the same blocks
    queries = packed(asked.repartition(min(max(spread, parts), 64), "id").sortWithinPartitions("id"), QUERY_BLOCK)
    candidates = packed(vectors, CANDIDATE_BLOCK)
    number = lambda of, name: F.pmod(F.xxhash64("ids"), F.lit(of)).cast("int").alias(name)
    every_one = lambda of, name: F.explode(F.sequence(F.lit(0), F.lit(of - 1))).alias(name)
    # every query block meets every candidate block of its dimension: blocks, not rows, dealt out by a salt, queries first
    left = queries.select("dim", F.lit(0).alias("kind"), "ids", "data", number(parts, "part")).select("*", every_one(spread, "salt"))
    right = candidates.select("dim", F.lit(1).alias("kind"), "ids", "data", number(spread, "salt")).select("*", every_one(parts, "part"))
    group = ["dim", "salt", "part"]
    blocks = left.unionByName(right).repartition(*group).sortWithinPartitions(*group, "kind").select(*group, "kind", "ids", "data")
    form = "<f4" if width == 4 else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting = None, []
        for batch in batches:
            for n in range(batch.num_rows):
                *of, kind, ids, data = (batch.column(i)[n].as_py() for i in range(6))
                if of != now:
                    for block in waiting:
                        yield block.result()
                    now, waiting = of, []
                ids, matrix = np.frombuffer(ids, "<i8"), np.frombuffer(data, form).reshape(-1, of[0])
                if kind == 0:
                    waiting.append(Asked(ids, matrix, k))
                elif waiting:
                    codes = quantise(matrix.astype(np.float64))
                    for block in waiting:
                        block.meet(ids, matrix, *codes)
        for block in waiting:
            yield block.result()

    best = blocks.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) / (q.n * c.n) AS score FROM u q JOIN u c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
