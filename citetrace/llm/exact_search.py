"""Exact top-k by inner product: ranges of vectors as blocks, tried in the order of their bounds until none can reach the k-th score.

The components are the terms, the vectors the documents. Every row is in one block of a range of (cell, id); a block's forward index is its matrix of
integers, with the largest and the least value of each component. What a query can score in a block is at most the sum, over its components, of the
component times the largest (if positive) or the least value (if negative). A first pass scores each query inside its own block, which gives a k-th score
to beat; then each batch of queries meets each shard of blocks, takes the shard's blocks by falling bound and stops at the first one that cannot reach the
k-th score any more. What shards find is merged for each query. Cells only bring like vectors together; no result depends on them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citetrace.plans.storage import materialise

#: Rows of a block; blocks of a shard, unless its values are that many before; queries of a batch, about. A batch and a shard meet in one task, which holds
#: both and nothing else.
BLOCK, SHARD, VALUES, BATCH = 256, 32, 1 << 19, 512
#: Cells are centres of at most so many rows, the first by hash of their id; that many cells.
SAMPLE, CELLS = 4096, 64
#: Stands for a null id, after all others.
NO_ID = (1 << 63) - 1
#: Whole numbers up to here are exact in doubles.
EXACT = 1 << 53

#: A shard: its number and that of its first row in the index, components of a row, rows of each block, then ids, rows, and bounds of each block, one after the other.
INDEX = "shard long, first long, dim int, sizes array<long>, ids array<long>, cells array<long>, high array<long>, low array<long>"
ASKED = "shard long, query array<long>, query_id array<long>, v array<long>, floor array<long>, dim int"
FOUND = "query long, vec_id long, place long, score long"


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as long; null for a vector that is null or holds a null or non-finite component. One beyond the range of long is an error."""
    x = F.transform(vector, lambda v: v.cast("double"))
    sound = vector.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(sound, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def centres(rows: DataFrame) -> np.ndarray:
    """Centres of cells, by rounds of nearest centre over the sample; none for an empty table."""
    order = F.xxhash64("id")
    sample = [r[0] for r in rows.orderBy(order, "id").select("v").limit(SAMPLE).collect()]
    dim = max(map(len, sample), default=0)
    if not dim:
        return np.zeros((0, 0))
    x = np.zeros((len(sample), dim))
    for i, v in enumerate(sample):
        x[i, : len(v)] = v
    x = np.unique(x, axis=0)
    c = x[:: max(1, len(x) // CELLS)][:CELLS].copy()
    for _ in range(8):
        nearest = _nearest(x, c)
        for k in np.unique(nearest):
            c[k] = x[nearest == k].mean(axis=0)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(axis=1) - 2 * (x @ c.T), axis=1)


def _padded(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows of ``dim`` values from lists that may be shorter (zeros follow) or longer (the rest is left out)."""
    length = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy()
    if len(lists) and (length == dim).all():
        return values.reshape(len(lists), dim)
    out = np.zeros((len(lists), dim), dtype=values.dtype)
    row = np.repeat(np.arange(len(lists)), length)
    at = np.arange(len(values)) - np.repeat(np.cumsum(length) - length, length)
    ok = at < dim
    out[row[ok], at[ok]] = values[ok]
    return out


def _one(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def index(rows: DataFrame) -> DataFrame:
    """The shards of (id, v), written: rows in ranges of (cell, id), so a cell or an id of any number of rows spreads over tasks."""
    middle = centres(rows)
    bound = rows.sparkSession.sparkContext.broadcast(middle)  # CELLS rows at most

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = bound.value
        for b in batches:
            at = _nearest(_padded(_one(b.column("v")), c.shape[1]).astype(float), c) if len(c) else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(at.astype(np.int32))], ["id", "v", "cell"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n, at, blocks, rest = TaskContext.get().partitionId(), 0, 0, [], None

        def shard() -> pa.RecordBatch:
            nonlocal n, at, blocks
            dim = max(v.shape[1] for _, v in blocks)
            x = [np.pad(v, ((0, 0), (0, dim - v.shape[1]))) for _, v in blocks]
            ids = np.concatenate([i for i, _ in blocks])
            values = [(task << 32) + n, (task << 40) + at, dim, [len(v) for v in x], ids, np.concatenate(x).ravel(), np.concatenate([v.max(axis=0) for v in x]), np.concatenate([v.min(axis=0) for v in x])]
            n, at, blocks = n + 1, at + len(ids), []
            return pa.RecordBatch.from_arrays([pa.array([a], type=f.type) for a, f in zip(values, schema)], schema=schema)

        def take(t: pa.Table) -> bool:
            """Add a block; whether the shard is full."""
            v = _one(t.column("v"))
            blocks.append((_one(t.column("id")).to_numpy(), _padded(v, int(np.diff(v.offsets.to_numpy()).max()))))
            return len(blocks) == SHARD or sum(x.size for _, x in blocks) >= VALUES

        for b in batches:
            t = pa.Table.from_batches([b])
            rest = t if rest is None else pa.concat_tables([rest, t])
            while rest.num_rows >= BLOCK:
                if take(rest.slice(0, BLOCK).combine_chunks()):
                    yield shard()
                rest = rest.slice(BLOCK)
        if rest is not None and rest.num_rows:
            take(rest.combine_chunks())
        if blocks:
            yield shard()

    longs = pa.list_(pa.int64())
    schema = pa.schema([("shard", pa.int64()), ("first", pa.int64()), ("dim", pa.int32()), *[(c, longs) for c in ("sizes", "ids", "cells", "high", "low")]])
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    celled = rows.mapInArrow(cell, "id long, v array<long>, cell int")
    ranged = celled.repartitionByRange(parts, "cell", "id").sortWithinPartitions("cell", "id")
    return materialise(ranged.mapInArrow(pack, INDEX), "vector-shards")


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows of a with all rows of b, over the components that both have (others are zero)."""
    dim = min(a.shape[1], b.shape[1])
    a, b = a[:, :dim], b[:, :dim]
    if not dim or not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    top = lambda x: max(abs(int(x.max())), abs(int(x.min())))
    most = top(a) * top(b) * dim
    if most < EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < NO_ID:
        return a @ b.T
    return a.astype(object) @ b.astype(object).T  # Python's integers; what is kept of them must fit into long


def _bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """What each query can score at most in each block, as doubles that are never too small."""
    f = q.astype(float)
    up, down = np.maximum(f, 0), np.minimum(f, 0)
    sums = up @ high.T + down @ low.T
    return sums + np.abs(sums) * 1e-9 + (up @ np.abs(high).T - down @ np.abs(low).T) * 1e-12


class Best:
    """The k best (score, id) of each query so far; of equal scores the smaller id."""

    def __init__(self, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.score = [np.empty(0, dtype=np.int64)] * len(floor)
        self.id, self.place = list(self.score), list(self.score)

    def add(self, i: int, score: np.ndarray, ids: np.ndarray, place: np.ndarray) -> None:
        score = score.astype(np.int64)  # an OverflowError beyond the range of long
        keep = score >= self.floor[i]
        if not keep.any():
            return
        s, d, p = (np.concatenate(x) for x in ((self.score[i], score[keep]), (self.id[i], ids[keep]), (self.place[i], place[keep])))
        order = np.lexsort((p, d, -s))[: self.k]
        self.score[i], self.id[i], self.place[i] = s[order], d[order], p[order]
        if len(order) == self.k:
            self.floor[i] = max(self.floor[i], s[order[-1]])

    def last_id(self, i: int) -> int:
        """Ids above this one cannot come in at the k-th score."""
        return int(self.id[i][-1]) if len(self.id[i]) == self.k and self.score[i][-1] == self.floor[i] else NO_ID


def _rows(b: pa.RecordBatch) -> Iterator[dict]:
    """Rows as a dict each, lists as arrays."""
    for i in range(b.num_rows):
        values = {n: b.column(n)[i] for n in b.schema.names}
        yield {n: v.values.to_numpy(zero_copy_only=False) if isinstance(v, pa.ListScalar) else v.as_py() for n, v in values.items()}


def _blocks(x: dict) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(matrix, ids, places) of each block of a shard; a place is the row's number in the whole index."""
    ends = np.cumsum(x["sizes"])
    m, place = x["cells"].reshape(len(x["ids"]), x["dim"]), x["first"] + np.arange(len(x["ids"]))
    return [(m[e - n : e], x["ids"][e - n : e], place[e - n : e]) for e, n in zip(ends, x["sizes"])]


def queries_of(shards: DataFrame, k: int, every: int) -> DataFrame:
    """A row of queries for each shard: the rows whose id is divisible by ``every``, with the k-th score inside the own block (or the least number)."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for b in batches:
            for x in _rows(b):
                got = []
                for m, ids, place in _blocks(x):
                    ask = np.flatnonzero((ids % every == 0) & (ids != NO_ID))
                    if not len(ask):
                        continue
                    floor = np.full(len(ask), -NO_ID)
                    for i, (row, own) in enumerate(zip(_product(m[ask], m), ask)):
                        if len(row) > k:
                            floor[i] = np.partition(np.delete(row, own), -k)[-k]
                    got.append((place[ask], ids[ask], m[ask].ravel(), floor))
                if got:
                    cells = [np.concatenate(c) for c in zip(*got)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x["shard"]]), *[pa.array([c], type=longs) for c in cells], pa.array([x["dim"]], type=pa.int32())], ["shard", "query", "query_id", "v", "floor", "dim"]
                    )

    return shards.select("shard", "first", "dim", "sizes", "ids", "cells").mapInArrow(within, ASKED)


def search(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of the largest integer inner products for each row whose id is divisible by ``every``; ties to the smaller id.

    Components are floor(scale * x). Vectors that are null or hold a null or non-finite component take no part; a shorter vector counts as if zeros followed, an empty
    one as zeros. Rows that repeat an id are rows of their own: each is a query (if its id is), and only the query's own row is left out. A null id is
    never a query; as a result it is null, after all ids of its score. A score beyond the range of long is an error. Other columns are not read; an empty
    table gives no rows.
    """
    rows = vectors.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), scaled(F.col(vector), scale).alias("v")).where("v is not null")
    shards = index(rows)
    asked = materialise(queries_of(shards, k, every), "vector-queries")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in _rows(b):
                yield _meet(x, k)

    # the queries of some neighbouring shards are a batch, so like ones share blocks; a batch of a task's last shards is smaller
    near = max(1, BATCH * every // (BLOCK * SHARD))
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    packed = asked.groupBy(F.floor(F.col("shard") / near).alias("part"), F.col("dim").alias("q_dim")).agg(flat("query"), flat("v"), flat("floor")).drop("part")
    tasks = packed.crossJoin(shards.select("shard"))  # the queries against all rows, a batch and a shard at a time
    found = tasks.join(shards.hint("merge"), "shard").mapInArrow(meet, FOUND)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id", "place")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = best.join(asked.select(F.explode(F.arrays_zip("query", "query_id")).alias("_q")).select("_q.*"), "query")
    return named.select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")


def _meet(x: dict, k: int) -> pa.RecordBatch:
    """The best rows of a shard for a batch of queries, block at a time by falling bound."""
    own, dim = x["query"], x["dim"]
    asked = x["v"].reshape(len(own), x["q_dim"])
    asked = np.pad(asked[:, :dim], ((0, 0), (0, max(0, dim - asked.shape[1]))))
    blocks = _blocks(x)
    least = np.array([ids.min() for _, ids, _ in blocks])
    bound = _bounds(asked, x["high"].reshape(len(blocks), dim).astype(float), x["low"].reshape(len(blocks), dim).astype(float))
    order = np.argsort(-bound, axis=1, kind="stable")
    best = Best(k, x["floor"].copy())
    active = np.arange(len(own))
    for turn in range(len(blocks)):
        at = order[active, turn]
        ok = bound[active, at] >= best.floor[active]  # blocks of a smaller bound follow
        active, at = active[ok], at[ok]
        if not len(active):
            break
        for j in np.unique(at):
            m, ids, place = blocks[j]
            ask = active[at == j]
            tied = bound[ask, j] < best.floor[ask] + 1.0  # the k-th score at most: only a smaller id still counts
            ask = ask[~tied | (least[j] <= np.array([best.last_id(i) for i in ask]))]
            for i, s in zip(ask, _product(asked[ask], m)):
                other = place != own[i]
                best.add(i, s[other], ids[other], place[other])
    columns = [np.repeat(own, [len(s) for s in best.score]), *[np.concatenate(c) for c in (best.id, best.place, best.score)]]
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], ["query", "vec_id", "place", "score"])
