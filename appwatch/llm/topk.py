"""Exact inner-product search: vectors bucketed by length, pruned by each bucket's cosine threshold.

Vectors are ranged by length and packed, longest first, into buckets of at most ``bucket`` rows; the
bucket keeps its greatest length. A first look at the longest bucket gives each query a score that
its k-th result reaches at least. For a query q and a bucket of greatest length m, only vectors whose
cosine with q is at least score / (|q| m) can still matter. Where that local threshold is high, one
coordinate prunes: the largest of q's unit vector bounds the same coordinate of any vector within the
cone. Where it is low, or the coordinate leaves too many, length prunes, a prefix of the bucket. What is
left is multiplied out exactly.

Queries are dealt to groups that a task can hold, buckets to shares; a task holds a group and sees a share
of the buckets go by, longest first, with scores to reach that rise on the way. So a vector is sent
once for each group, and a query once for each share, whatever the number of pairs. Products of many
queries and a bucket are one matrix product, in single precision: whole numbers below 2**24 are exact
in it, larger products are sifted by it with a margin for rounding and multiplied again.

Cases: components become floor(scale * x). Vectors that are null, or hold null or non-finite
components, take no part, nor do rows without an id. Vectors of unequal dimension do not meet.
A query does not find rows of its own id. Equal scores go to the smaller id. Repeated rows are
candidates each; a repeated query row counts once, and if an id has several vectors, its list holds
the best of them all. With fewer than ``k`` candidates all are returned. An empty table gives an empty
result. Components and scores beyond 64 bits are clipped. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from appwatch.llm import common
from appwatch.llm.common import stored


@dataclass(frozen=True)
class Params:
    k: int = 10
    scale: int = 1024
    bucket: int = 2048
    queries_at_once: int = 256
    coordinate_from: float = 0.6  # local cosine thresholds from here on are pruned by coordinate
    coordinate_share: float = 1 / 32  # of a bucket that a coordinate may leave; a product of all of it is faster than looking up more
    held: int = 1 << 23  # components of the queries that a task holds
    pairs: int = 1 << 36  # of rows in a task, when there are more than four tasks for each core


# Fixed list: vectors travel in the narrowest of these that holds their components.
KINDS = (np.int16, np.int32, np.float64)
ROWS = "vec_id long, dim int, length double, kind int, vec binary"
PACKED = "dim int, number long, n int, longest double, kind int, ids binary, matrix binary"
SLACK = 1e-9  # relative, for rounding in bounds; products themselves are exact
TOP = np.iinfo(np.int64).max


def _kind(largest: np.ndarray) -> np.ndarray:
    """For each greatest absolute component, the place in ``KINDS`` that holds it."""
    return np.searchsorted([np.iinfo(np.int16).max, np.iinfo(np.int32).max], largest).astype(np.int32)


def _lengths(rows: np.ndarray) -> np.ndarray:
    wide = rows.astype(np.float64)
    return np.sqrt(np.einsum("ij,ij->i", wide, wide))


def _places(fits: np.ndarray) -> np.ndarray:
    """Flat places of the few that hold, looked for eight at a time."""
    flat = fits.reshape(-1)
    whole = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:whole].view(np.uint64))
    word, byte = np.nonzero(flat[:whole].reshape(-1, 8)[words])
    return np.concatenate([words[word] * 8 + byte, whole + np.flatnonzero(flat[whole:])])


def quantised(vectors: DataFrame, params: Params, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, dim, length, and vec (whole numbers as bytes of a kind) of the vectors that take part."""
    rows = vectors.select(common.field(vectors, id_col, "long").alias("vec_id"), F.col("`" + vector_col.replace("`", "``") + "`").alias("vec"))
    if not isinstance(rows.schema["vec"].dataType.elementType, (T.FloatType, T.DoubleType)):
        rows = rows.withColumn("vec", F.col("vec").cast("array<double>"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            dims = lists.value_lengths().to_numpy(zero_copy_only=False)
            starts = np.cumsum(dims) - dims
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                found = flat.reshape(-1, dim) if dim and len(at) == len(dims) else flat[starts[at][:, None] + np.arange(dim)]
                fine = np.isfinite(found).all(axis=1)
                with np.errstate(over="ignore"):
                    whole = np.clip(np.floor(params.scale * found[fine]), -(2.0**63), 2.0**63) + 0.0
                kinds, lengths = _kind(np.abs(whole).max(axis=1, initial=0)), _lengths(whole)
                for kind in np.unique(kinds).tolist():
                    of = np.flatnonzero(kinds == kind)
                    data, width = whole[of].astype(KINDS[kind]).tobytes(), dim * np.dtype(KINDS[kind]).itemsize
                    vecs = [data[i * width : (i + 1) * width] for i in range(len(of))]
                    columns = (ids[at[fine][of]], np.full(len(of), dim, np.int32), lengths[of], np.full(len(of), kind, np.int32), vecs)
                    yield common.to_batch(dict(zip(("vec_id", "dim", "length", "kind", "vec"), columns)), ROWS)

    return common.map_arrow(rows.where("vec_id is not null and vec is not null"), run, ROWS)


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Buckets of up to ``size`` vectors of one dimension, in the order the rows come."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        number, dim, held = 0, None, 0
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal number, held
            ids = np.concatenate([i for i, _ in parts]).astype(np.int64)
            matrix = np.concatenate([m for _, m in parts])  # of the widest kind among them
            kind = [np.dtype(k) for k in KINDS].index(matrix.dtype)
            row = (dim, part << 32 | number, held, float(_lengths(matrix).max()), kind, ids.tobytes(), matrix.tobytes())
            number, held = number + 1, 0
            parts.clear()
            return common.to_batch(dict(zip([f.split()[0] for f in PACKED.split(",")], ([v] for v in row))), PACKED)

        for batch in common.slices(batches, 1024):
            ids, dims, kinds = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero((np.diff(dims) != 0) | (np.diff(kinds) != 0)) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if held and dims[start] != dim:
                    yield flush()
                dim = int(dims[start])
                data = b"".join(batch.column(3).slice(start, stop - start).to_pylist())
                matrix = np.frombuffer(data, KINDS[kinds[start]]).reshape(stop - start, dim)
                while start < stop:
                    n = min(stop - start, size - held)
                    parts.append((ids[start : start + n], matrix[len(matrix) - (stop - start) :][:n]))
                    start, held = start + n, held + n
                    if held == size:
                        yield flush()
        if held:
            yield flush()

    return common.map_arrow(rows.select("vec_id", "dim", "kind", "vec"), run, PACKED)


class Bucket:
    """An unpacked bucket: ids, whole-number vectors longest first, their lengths, and the vectors in single precision."""

    def __init__(self, dim: int, n: int, kind: int, ids: bytes, matrix: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.rows = np.frombuffer(matrix, KINDS[kind]).reshape(n, dim)
        self.lengths = _lengths(self.rows)
        order = np.argsort(-self.lengths, kind="stable")
        self.ids, self.rows, self.lengths = self.ids[order], self.rows[order], self.lengths[order]
        self.single = self.rows.astype(np.float32)
        self._sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def by_coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the vectors by coordinate ``f`` of their unit vectors, and these coordinates."""
        if f not in self._sorted:
            column = self.rows[:, f] / np.where(self.lengths > 0, self.lengths, 1)
            order = np.argsort(column, kind="stable")
            self._sorted[f] = order, column[order]
        return self._sorted[f]


class Held:
    """Queries of one dimension that a task holds, with the k best found so far for each.

    ``least`` is the score that the k-th result reaches at least; of vectors that just reach it, those up to id ``last`` matter.
    """

    def __init__(self, dim: int, params: Params):
        self.dim, self.params = dim, params
        self.packs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.ids = self._room = None

    def add(self, n: int, kind: int, ids: bytes, matrix: bytes, least: bytes | None) -> None:
        bound = np.full(n, -np.inf) if least is None else np.frombuffer(least, np.float64)
        self.packs.append((np.frombuffer(ids, np.int64), np.frombuffer(matrix, KINDS[kind]).reshape(n, self.dim), bound))

    def _ready(self) -> None:
        if self.ids is not None:
            return
        self.ids, self.rows, self.least = (np.concatenate(of) for of in zip(*self.packs))
        self.packs.clear()
        self.single, self.lengths = self.rows.astype(np.float32), _lengths(self.rows)
        self.last = np.full(len(self.ids), TOP)
        self.focus = np.abs(self.single).argmax(axis=1) if self.dim else np.zeros(len(self.ids), np.int64)
        self.found = tuple(np.zeros(0, np.int64) for _ in range(3))  # query's place, id, score
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.n_waiting = 0

    def meet(self, bucket: Bucket) -> None:
        self._ready()
        reach = self.lengths * bucket.lengths[0]
        live = np.flatnonzero(reach * (1 + SLACK) >= self.least)
        sharp = live[(self.least[live] > 0) & (self.least[live] >= self.params.coordinate_from * reach[live])]
        if len(sharp) and self.dim:
            live = np.setdiff1d(live, self._by_coordinate(bucket, sharp, reach[sharp]), assume_unique=True)
        for start in range(0, len(live), self.params.queries_at_once):
            self._by_product(bucket, live[start : start + self.params.queries_at_once])
        if self.n_waiting >= max(1 << 16, len(self.ids) * self.params.k // 2):
            self.settle()

    def _by_coordinate(self, bucket: Bucket, at: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Meets the bucket for those of the queries for which one coordinate leaves few of its vectors, and tells which."""
        done = []
        cosine = np.minimum(self.least[at] / reach, 1.0) * (1 - SLACK)
        focus = self.focus[at]
        peak = self.rows[at, focus] / self.lengths[at]
        spread = np.sqrt(np.maximum(0.0, 1 - cosine * cosine) * np.maximum(0.0, 1 - peak * peak)) + SLACK
        # Within the cone the coordinate lies around its middle; a full turn towards q stays inside.
        high = np.where((np.abs(peak) >= cosine) & (peak > 0), 1.0, peak * cosine + spread) + SLACK
        low = np.where((np.abs(peak) >= cosine) & (peak < 0), -1.0, peak * cosine - spread) - SLACK
        for f in np.unique(focus).tolist():
            order, column = bucket.by_coordinate(f)
            mine = np.flatnonzero(focus == f)
            first, stop = np.searchsorted(column, low[mine]), np.searchsorted(column, high[mine], side="right")
            few = np.flatnonzero(stop - first <= max(1, self.params.coordinate_share * len(column)))
            done.append(at[mine[few]])
            for some in np.split(few, range(4096, len(few), 4096)):
                n = stop[some] - first[some]
                places = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first[some], n)
                query, where = np.repeat(at[mine[some]], n), order[places]
                self._keep(query, bucket.ids[where], self._scores(bucket, query, where))
        return np.concatenate(done)

    def _by_product(self, bucket: Bucket, at: np.ndarray) -> None:
        """Meets the bucket for these queries by one matrix product."""
        need = np.where(self.least[at] > 0, self.least[at] / np.maximum(self.lengths[at], 1e-300), 0.0).min()
        rows = int(np.searchsorted(-bucket.lengths, -need * (1 - SLACK), side="right"))
        if not rows:
            return
        reach = float(self.lengths[at].max() * bucket.lengths[0])
        product, fits = (of[: len(at) * rows].reshape(len(at), rows) for of in self._buffers(len(at) * rows))
        if reach < 2**52:  # sums of whole numbers below 2**24 are exact, in any order; larger ones are off by the margin at most
            np.matmul(self.single[at], bucket.single[:rows].T, out=product)
            margin = 0.0 if reach < 2**24 else reach * (self.dim + 8) * 2.0**-23
            least = (self.least[at] - margin).astype(np.float32)
            least = np.nextafter(least, np.float32(-np.inf)) if margin else least
        else:
            product = np.clip(self.rows[at].astype(np.float64) @ bucket.rows[:rows].astype(np.float64).T, -(2.0**63), 2.0**63)
            margin = reach * (self.dim + 8) * 2.0**-52
            least = self.least[at] - margin
        np.greater_equal(product, least[:, None], out=fits)
        flat = _places(fits)
        if len(flat) > 4 * self.params.k * len(at):  # only what may be among the k best of the bucket
            many = np.flatnonzero(fits.sum(axis=1) > 4 * self.params.k)
            others = np.where(bucket.ids[None, :rows] != self.ids[at[many], None], product[many], -np.inf)
            best = np.partition(others, rows - self.params.k, axis=1)[:, rows - self.params.k, None].astype(np.float64)
            fits[many] &= product[many] >= best - 2 * margin
            flat = _places(fits)
        row, where = np.divmod(flat, rows)
        query = at[row]
        self._keep(query, bucket.ids[where], self._scores(bucket, query, where) if margin else product.reshape(-1)[flat].astype(np.int64))

    def _buffers(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Room for products and their tests, taken once: new pages for each product cost as much as the product."""
        if self._room is None or len(self._room[0]) < size:
            self._room = np.empty(size, np.float32), np.empty(size, bool)
        return self._room

    def _scores(self, bucket: Bucket, query: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Exact products of pairs of a query and a vector."""
        out = [np.zeros(0, np.int64)]
        for start in range(0, len(query), 8192):
            q, v = query[start : start + 8192], where[start : start + 8192]
            left, right = self.rows[q].astype(np.float64), bucket.rows[v].astype(np.float64)
            if float((self.lengths[q] * bucket.lengths[v]).max()) < 2**52:
                out.append(np.einsum("ij,ij->i", left, right).astype(np.int64))  # whole numbers below 2**53: exact in any order
            else:
                exact = (sum(int(x) * int(y) for x, y in zip(a, b)) for a, b in zip(left, right))
                out.append(np.array([max(-(2**63), min(2**63 - 1, s)) for s in exact], np.int64))
        return np.concatenate(out)

    def _keep(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        rough, least = scores.astype(np.float64), self.least[query]
        fits = (rough > least) | (rough == least) & ((ids <= self.last[query]) | (np.abs(rough) >= 2**53))
        fits &= ids != self.ids[query]
        self.waiting.append((query[fits], ids[fits], scores[fits]))
        self.n_waiting += len(self.waiting[-1][0])

    def settle(self) -> None:
        """Keeps the k best of what was found; the scores to reach rise."""
        self._ready()
        query, ids, scores = (np.concatenate(of) for of in zip(self.found, *self.waiting))
        order = np.lexsort((ids, ~scores, query))
        query = query[order]
        first = np.flatnonzero(np.diff(query, prepend=-1))
        rank = np.arange(len(query)) - np.repeat(first, np.diff(first, append=len(query)))
        kept = np.flatnonzero(rank < self.params.k)
        self.found = query[kept], ids[order[kept]], scores[order[kept]]
        full = np.flatnonzero(rank[kept] == self.params.k - 1)
        at = self.found[0][full]
        self.last[at], self.least[at] = self.found[1][full], self.found[2][full].astype(np.float64)
        self.waiting.clear()
        self.n_waiting = 0

    def results(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        query, ids, scores = self.found
        for start in range(0, len(query), 1 << 16):
            some = slice(start, start + (1 << 16))
            yield common.to_batch({"query_id": self.ids[query[some]], "vec_id": ids[some], "score": scores[some]}, FOUND)


FOUND = "query_id long, vec_id long, score long"
BOUNDED = PACKED + ", least binary, shortest double"


def _bounded(queries: DataFrame, seeds: dict[int, tuple], params: Params) -> DataFrame:
    """Query packs with the score each query reaches at least, and the length a bucket needs to matter."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        buckets: dict[int, Bucket] = {}
        for batch in common.slices(batches, 1):
            ((dim, number, n, longest, kind, ids, matrix),) = zip(*(c.to_pylist() for c in batch.columns))
            least, lengths = np.full(n, -np.inf), _lengths(np.frombuffer(matrix, KINDS[kind]).reshape(n, dim))
            if dim in seeds:
                held = Held(dim, params)
                held.add(n, kind, ids, matrix, None)
                if dim not in buckets:
                    buckets[dim] = Bucket(dim, *seeds[dim])
                held.meet(buckets[dim])
                held.settle()
                least = held.least
            need = np.where((least > 0) & (lengths > 0), least / np.where(lengths > 0, lengths, 1), 0.0)
            row = (dim, number, n, longest, kind, ids, matrix, least.tobytes(), float(need.min()) * (1 - SLACK))
            yield common.to_batch(dict(zip([f.split()[0] for f in BOUNDED.split(",")], ([v] for v in row))), BOUNDED)

    return common.map_arrow(queries, run, BOUNDED)


def _dealt(buckets: DataFrame, queries: DataFrame, params: Params) -> DataFrame:
    """Partitions of a group of query packs, then a share of the buckets that are long enough for one of its queries, longest first.

    Groups are as large as a task may hold; of them and of dimensions there are few, so the table of both is broadcast.
    """
    context = buckets.sparkSession.sparkContext
    asked = queries.agg(F.coalesce(F.sum(F.col("n").cast("long") * F.col("dim")), F.lit(0)).alias("components"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    turn = F.col("number").bitwiseAND(F.lit(2**32 - 1))
    there = buckets.agg(F.count(F.lit(1)).alias("buckets"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max(turn), F.lit(0)).alias("turns")).first()
    groups = max(1, -(-asked.components // params.held))
    tasks = max(4 * context.defaultParallelism, -(-asked.n * there.n // params.pairs))
    shares = max(1, min(there.buckets, -(-tasks // groups)))

    group = F.pmod(F.xxhash64("number"), F.lit(groups))
    share = F.pmod(F.shiftright("number", 32) * F.lit(there.turns + 1) + turn, F.lit(shares))
    of_dim = queries.groupBy("dim", group.alias("group")).agg(F.min("shortest").alias("shortest"))
    columns = ["number", "dim", "n", "kind", "ids", "matrix"]
    left = buckets.join(F.broadcast(of_dim), "dim").where("longest >= shortest")
    left = left.select((F.col("group") * shares + share).cast("int").alias("seat"), F.lit(True).alias("is_bucket"), *columns, F.lit(None).cast("binary").alias("least"))
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), group.alias("group"), *columns, "least")
    right = right.select((F.col("group") * shares + F.col("share")).cast("int").alias("seat"), F.lit(False).alias("is_bucket"), *columns, "least")
    return right.unionByName(left).repartitionById(groups * shares, "seat").sortWithinPartitions("seat", "is_bucket", "number")


def search(vectors: DataFrame, is_query: Column, params: Params = Params(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows for each row where ``is_query`` holds.

    Every group of queries meets every bucket that is long enough for one of its queries; neither side is
    broadcast, and no pair of single rows is written.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = quantised(vectors, params, id_col, vector_col)
    # The id in the range key splits a length that very many vectors share.
    ranged = rows.repartitionByRange(parts, F.col("dim"), F.col("length").desc(), F.xxhash64("vec_id"))
    ranged = ranged.sortWithinPartitions(F.col("dim"), F.col("length").desc(), "vec_id")
    buckets = stored(packed(ranged, params.bucket), "buckets")
    asked = quantised(vectors.where(is_query), params, id_col, vector_col).dropDuplicates(["vec_id", "dim", "kind", "vec"])
    asked = packed(asked.sortWithinPartitions("dim", "vec_id"), params.queries_at_once)
    # One bucket of each of a few dimensions, of bounded size: the first look.
    first = [r.number for r in buckets.groupBy("dim").agg(F.min("number").alias("number")).orderBy("dim").limit(16).collect()]
    seeds = {r.dim: (r.n, r.kind, bytes(r.ids), bytes(r.matrix)) for r in buckets.where(F.col("number").isin(first)).collect()}
    queries = stored(_bounded(asked, seeds, params), "queries")

    def run(batches) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for batch in common.slices(batches, 1):
            ((seat, is_bucket, _, dim, n, kind, ids, matrix, least),) = zip(*(c.to_pylist() for c in batch.columns))
            if seat != at:
                for of in held.values():
                    yield from of.results()
                at, held = seat, {}
            if not is_bucket:
                held.setdefault(dim, Held(dim, params)).add(n, kind, ids, matrix, least)
            elif dim in held:
                held[dim].meet(Bucket(dim, n, kind, ids, matrix))
        for of in held.values():
            yield from of.results()

    found = common.map_arrow(_dealt(buckets, queries, params), run, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= params.k).select("query_id", "rank", "vec_id", "score")
