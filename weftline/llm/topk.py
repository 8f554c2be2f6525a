"""Exact inner-product search over vectors grouped by length (after LEMP, Teflioudi et al., 2015)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.common import checkpointed, stored


@dataclass(frozen=True)
class Settings:
    bucket: int = 2048  #: vectors of a bucket at most
    buckets_in_task: int = 4
    queries: int = 1 << 15  #: queries sent to the tasks at a time; further ones take further passes
    sent_bytes: int = 1 << 26  #: bytes of query vectors sent at a time
    focus: int = 3  #: coordinates that coordinate pruning looks at
    steep: float = 0.5  #: local cosine threshold from which coordinates prune better than lengths


def _quantised(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, norms, packed, own = [], [], [], [], []
            for vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if vec_id is None or not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                q = np.floor(scale * x)
                ids.append(vec_id)
                dims.append(len(q))
                norms.append(float(np.sqrt((q * q).sum())))
                whole = q.astype("<i8")
                packed.append(whole.tobytes())
                own.append(int(whole @ whole))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(norms, pa.float64()), pa.array(packed, pa.binary()), pa.array(own, pa.int64())],
                ["vec_id", "dim", "norm", "v", "own"],
            )

    return run


_BUCKET = "dim int, n int, longest double, ids binary, vectors binary"


def _bucketed(size: int):
    """Rows in order of falling length, packed into buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            ids = np.array([h[0] for h in held], "<i8").tobytes()
            row = [[held[0][1]], [len(held)], [held[0][2]], [ids], [b"".join(h[3] for h in held)]]
            types = [pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], ["dim", "n", "longest", "ids", "vectors"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held and (len(held) >= size or held[0][1] != row[1]):
                    yield out()
                    held = []
                held.append(row)
        if held:
            yield out()

    return run


class Bucket:
    """Vectors of similar length, longest first."""

    def __init__(self, dim: int, ids: bytes, vectors: bytes):
        self.ids = np.frombuffer(ids, "<i8")
        self.v = np.frombuffer(vectors, "<i8").reshape(len(self.ids), dim)
        self.f = self.v.astype(np.float64)
        self.norm = np.sqrt((self.f * self.f).sum(1))
        self.exact = bool(len(self.ids)) and float(self.norm.max()) < 2**26  # products of two such stay below 2**52
        self.unit = (self.f / np.maximum(self.norm, 1e-300)[:, None]).T.copy()

    def near(self, q: np.ndarray, q_norm: float, least: float, settings: Settings) -> np.ndarray:
        """Rows that can have an inner product of ``least`` or more with ``q``."""
        if least <= 0 or not q_norm:
            return np.arange(len(self.ids)) if least <= 0 else np.arange(0)
        # By length: no shorter vector can get there.  The margin covers rounding.
        rows = np.arange(np.searchsorted(-self.norm, -(least / q_norm) * (1 - 1e-9), side="right"))
        if not len(rows):
            return rows
        t = least / (q_norm * self.norm[0]) * (1 - 1e-9)  # local cosine threshold
        if t < settings.steep or t > 1:
            return rows
        # By coordinates: a unit vector at cosine t or more from q has coordinates near those of q.
        unit = q / q_norm
        keep = np.ones(len(rows), bool)
        for f in np.argsort(-np.abs(unit), kind="stable")[: settings.focus]:
            reach = np.sqrt(max(0.0, 1 - unit[f] ** 2) * (1 - t * t))
            x = self.unit[f, : len(rows)]
            low = unit[f] * t - reach if unit[f] > -t else -1.0
            high = unit[f] * t + reach if unit[f] < t else 1.0
            keep &= (x >= low - 1e-9) & (x <= high + 1e-9)
        return rows[keep]

    def products(self, rows: np.ndarray, q: np.ndarray, q_exact: bool) -> np.ndarray:
        if self.exact and q_exact:
            return (self.f[rows] @ q.astype(np.float64)).astype(np.int64)
        return self.v[rows] @ q


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _searched(sent, k: int, settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, copies, vectors, floors = sent.value
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        norms = [float(np.sqrt((v.astype(np.float64) ** 2).sum())) for v in vectors]
        for batch in batches:
            for dim, at, packed in zip(batch.column(0).to_pylist(), batch.column(3), batch.column(4), strict=True):
                bucket = Bucket(dim, at.as_py(), packed.as_py())
                for i, q in enumerate(vectors):
                    if len(q) != dim:
                        continue
                    known_ids, known = found[i]
                    least = max(floors[i], known[-1] if len(known) == k else floors[i])
                    rows = bucket.near(q, norms[i], least, settings)
                    if not len(rows):
                        continue
                    scores = bucket.products(rows, q, norms[i] < 2**26)
                    good = scores >= least
                    if good.any():
                        found[i] = _best(np.append(known_ids, bucket.ids[rows[good]]), np.append(known, scores[good]), k)
        for i, (near, scores) in enumerate(found):
            if len(near):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(near), x)) for x in (ids[i], copies[i])] + [pa.array(near), pa.array(scores)],
                    ["query_id", "copy", "vec_id", "score"],
                )

    return run


_LOWEST = -(1 << 63)


def _floors(queries: list[dict], head: list, k: int) -> list[int]:
    """For each query the k-th best product with a few of the longest vectors: a bound from below."""
    floors = [_LOWEST] * len(queries)
    for row in head:
        bucket = Bucket(row["dim"], row["ids"], row["vectors"])
        for i, q in enumerate(queries):
            if q["dim"] != row["dim"]:
                continue
            v = np.frombuffer(q["v"], "<i8")
            scores = bucket.products(np.arange(len(bucket.ids)), v, q["norm"] < 2**26)
            if len(scores) >= k:
                floors[i] = max(floors[i], int(np.partition(scores, len(scores) - k)[len(scores) - k]))
    return floors


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, settings: Settings = Settings()) -> DataFrame:
    """The ``k`` greatest integer inner products of each query: ``(query_id, rank, vec_id, score)``.

    Components become ``floor(scale * x)``.  Queries are the rows whose vec_id is divisible by ``every``;
    candidates are all other rows of the same dimension, be it that they have the same vec_id or the same vector: a repeated
    row is a candidate for its copies, and a query of its own with its own results.  Ties go to the smaller
    vec_id; a query with fewer candidates gets them all.  Vectors that are null or hold null or non-finite
    components take no part, nor do rows without vec_id.  Products beyond 64 bits aren't supported.  An
    empty table gives no rows; other columns are ignored.

    The vectors are put in order of length and packed into buckets.  A query starts with the k-th best
    product among the longest vectors, and raises that bound from bucket to bucket; in each bucket its
    local cosine threshold decides whether lengths or coordinates prune, and what remains is multiplied
    out.  Queries are taken in passes of at most ``settings.queries`` and ``settings.sent_bytes``; the driver
    and the tasks hold those of one pass only.
    """
    context = vectors.sparkSession.sparkContext
    codes = stored(
        vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(_quantised(scale), "vec_id long, dim int, norm double, v binary, own long")
    )
    shape = codes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("dim"), F.lit(0)).alias("dim")).first()
    parts = max(1, -(-shape["n"] // (settings.bucket * settings.buckets_in_task)))
    # The copy's number goes last, so that one row repeated very often is still dealt to many parts.
    order = ["dim", F.desc("norm"), "vec_id", "v", "r"]
    spread = codes.withColumn("r", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    buckets = stored(spread.select("vec_id", "dim", "norm", "v").mapInArrow(_bucketed(settings.bucket), _BUCKET))
    heads = []
    for row in buckets.groupBy("dim").agg(F.max("longest").alias("longest")).limit(64).collect():
        heads += buckets.where((F.col("dim") == row["dim"]) & (F.col("longest") == row["longest"])).limit(1).collect()
    asked = codes.where(F.col("vec_id") % every == 0).groupBy("vec_id", "dim", "norm", "v", "own").agg(F.count(F.lit(1)).alias("times"))
    asked = checkpointed(asked.withColumn("copy", F.xxhash64("v")))
    at_a_time = max(1, min(settings.queries, settings.sent_bytes // max(1, 8 * shape["dim"])))
    groups = max(1, -(-asked.count() // at_a_time))
    passes = []
    for g in range(groups):
        queries = asked.where(F.pmod(F.xxhash64("vec_id", "copy"), F.lit(groups)) == g).toArrow().to_pylist()
        queries.sort(key=lambda q: q["vec_id"])
        sent = context.broadcast(
            (
                np.array([q["vec_id"] for q in queries], np.int64),
                np.array([q["copy"] for q in queries], np.int64),
                [np.frombuffer(q["v"], "<i8") for q in queries],
                _floors(queries, heads, k + 1),
            )
        )
        # The query's own row is found too, so one more is sought.
        found = buckets.mapInArrow(_searched(sent, k + 1, settings), "query_id long, copy long, vec_id long, score long")
        found = found.withColumn("rank", _rank()).where(F.col("rank") <= k + 1)
        if groups > 1:
            found = stored(found)
            sent.destroy()
        passes.append(found)
    found = reduce(DataFrame.unionAll, passes)
    mine = asked.select(F.col("vec_id").alias("query_id"), "copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("time"), "own")
    # Of a query's results the first that looks like itself is its own row.
    itself = F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.col("rank"))
    group = Window.partitionBy("query_id", "copy", "time")
    rest = found.join(mine, ["query_id", "copy"]).withColumn("at", F.min(itself).over(group)).where("at IS NULL OR rank != at")
    rest = rest.withColumn("rank", (F.col("rank") - F.when(F.col("rank") > F.col("at"), 1).otherwise(0)).cast("int"))
    return rest.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _rank() -> Column:
    return F.row_number().over(Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id"))

