"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

1. Documents with the same set of shingles become one class, represented by the row of the smallest id.
2. Columns: the ``sketch`` smallest shingle hashes of each class. For a linked pair every member of the union's
   smallest hashes is common with a chance of at least the threshold, so with 64 of them fewer than 24 common
   ones have a chance below 4e-10 at exactly 0.75; sets of up to 64 shingles are held whole, without any chance.
3. Size-derived bounds: a class must share ``need`` columns, so only the ``r - need + 1`` rarest of its r repeated
   columns are looked up (rare first, by exact counts). A passage that many documents share is never a
   lookup column of a document that has enough else, so it brings no pairs.
4. Classes that meet in a column form candidate groups. The product is computed in tiles of a group,
   each pair of a tile exactly once, from whole shingle sets: columns of one document only are dropped, overlap
   counts are accumulated by column blocks, pairs below ``100 * overlap >= 75 * union`` are discarded.
   A tile gives the links that join something, not all pairs; no pair is dropped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citetrace.llm.words import U, passes
from citetrace.operators.components import connected_components
from citetrace.plans.storage import materialise

WORDS_A_SHINGLE = 5
PERCENT = 75
SKETCH = 64
NEED = 24
TILE = 512
COLUMN_BLOCK = 4096


def shingle_sets(texts: pa.Array, k: int = WORDS_A_SHINGLE):
    """The sorted distinct shingle hashes of each text, in order."""
    for _, words in passes(texts, lower=True):
        hashes, whole = words.windows(k), words.whole(k)
        for i in range(len(words.count)):
            n, b = int(words.count[i]), int(words.bound[i])
            if n >= k:
                yield np.unique(hashes[b : b + n - k + 1])
            elif n:
                yield np.array([words.sequence(i)], dtype=U)
            else:
                yield np.empty(0, dtype=U)
        del hashes, whole


def _sketches(k: int, size: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("key_a", pa.int64()), ("key_b", pa.int64()), ("sketch", pa.list_(pa.int64()))]
    )

    def of(batches):
        for batch in batches:
            rows = []
            for s in shingle_sets(batch.column("text"), k):
                a = int(np.sum(s * U(0xD6E8FEB86659FD93), dtype=U)) if len(s) else 0
                b = int(np.sum((s ^ (s >> U(32))) * (s | U(1)), dtype=U)) if len(s) else 0
                rows.append((len(s), a, b, s[:size].view(np.int64)))
            to = lambda x: np.array(x, dtype=np.uint64).view(np.int64)
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array(to([r[1] for r in rows])),
                    pa.array(to([r[2] for r in rows])),
                    pa.array([r[3] for r in rows], pa.list_(pa.int64())),
                ],
                schema=schema,
            )

    return of


def _product(ids: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between documents ``left`` and ``right`` (the same indices: within) that join something not yet joined."""
    n = len(ids)
    if n < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    column, row = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    new = np.concatenate([[True], column[1:] != column[:-1]])
    at = np.cumsum(new) - 1
    often = np.bincount(at) >= 2
    keep = often[at]
    row, at = row[keep], (np.cumsum(often) - 1)[at[keep]]
    within = left is right
    # place of a document on either side, or -1
    on_left, on_right = np.full(n, -1), np.full(n, -1)
    on_left[left], on_right[right] = np.arange(len(left)), np.arange(len(right))
    overlap = np.zeros((len(left), len(right)), dtype=np.float32)
    columns = int(at[-1]) + 1 if len(at) else 0
    for c in range(0, columns, COLUMN_BLOCK):
        lo, hi = np.searchsorted(at, [c, c + COLUMN_BLOCK])
        width = min(COLUMN_BLOCK, columns - c)
        r, k = row[lo:hi], at[lo:hi] - c
        m = np.zeros((len(left), width), dtype=np.float32)
        pick = on_left[r] >= 0
        m[on_left[r[pick]], k[pick]] = 1
        if within:
            overlap += m @ m.T
        else:
            w = np.zeros((len(right), width), dtype=np.float32)
            pick = on_right[r] >= 0
            w[on_right[r[pick]], k[pick]] = 1
            overlap += m @ w.T
    count = overlap.astype(np.int64)
    union = sizes[left][:, None] + sizes[right][None, :] - count
    linked = (100 * count >= percent * union) & (count > 0)
    if within:
        linked = np.triu(linked, 1)
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for i, j in np.argwhere(linked).tolist():
        a, b = root(int(left[i])), root(int(right[j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            links.append((int(ids[left[i]]), int(ids[right[j]])))
    return links


def _tiles(k: int, percent: int):
    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for _, group in pdf.groupby(["grp", "tile_a", "tile_b"], sort=False):
            group = group.drop_duplicates("node").sort_values("node")  # rows that repeat are one node
            ids = group["node"].to_numpy()
            sets = list(shingle_sets(pa.array(group["text"], pa.large_string()), k))
            tile = group["tile"].to_numpy()
            a, b = group["tile_a"].iloc[0], group["tile_b"].iloc[0]
            left = np.flatnonzero(tile == a)
            right = left if a == b else np.flatnonzero(tile == b)
            out += _product(ids, sets, left, right, percent)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return of


def jaccard_join(
    docs: DataFrame, words: int = WORDS_A_SHINGLE, percent: int = PERCENT, sketch: int = SKETCH, need: int = NEED, tile: int = TILE
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text; other columns are ignored).

    Null, empty and blank texts have no shingles and are their own component. Repeated rows of one id give repeated rows; rows of one id with
    different texts are documents of their own, each with the links of its own text. A null doc_id is returned with a null component and links to nothing.
    Texts of any length are read whole; an empty table gives no rows.
    """
    return _joined(docs, words, percent, sketch, need, tile).drop("text_key")


def _joined(docs: DataFrame, words: int, percent: int, sketch: int, need: int, tile: int) -> DataFrame:
    """``jaccard_join`` with text_key, the 64-bit hash that tells the texts of one id apart."""
    base = materialise(
        _texts(docs).mapInArrow(
            _sketches(words, sketch), "doc_id long, text_key long, n_shingles long, key_a long, key_b long, sketch array<long>"
        ),
        "ngram-sketch",
    )
    some = base.where("n_shingles > 0 and doc_id is not null")
    key = ["n_shingles", "key_a", "key_b"]
    least_row = F.min(F.struct("doc_id", "text_key")).alias("rep")
    # a class is a node by a number of its own, not by its id, which other classes may have as well
    classes = materialise(some.groupBy(*key).agg(least_row).select(*key, "rep.*").withColumn("node", F.monotonically_increasing_id()), "ngram-classes")
    reps = some.join(classes, [*key, "doc_id", "text_key"]).select("node", "n_shingles", "sketch").dropDuplicates(["node"])
    cells = reps.select("node", "n_shingles", F.explode("sketch").alias("col"))
    counts = cells.groupBy("col").agg(F.count("*").alias("df")).where("df > 1")
    repeated = cells.join(counts.hint("merge"), "col").select("node", "n_shingles", "col", "df")
    # what an overlap needs at least: of whole small sets by their size, of sketches ``need``
    least = F.least(F.lit(need), F.ceil(F.col("n_shingles") * percent / 100)).cast("int")
    mine = Window.partitionBy("node")
    lookup = (
        repeated.withColumn("r", F.count("*").over(mine))
        .where(F.col("r") >= least)
        .withColumn("place", F.row_number().over(mine.orderBy("df", "col")))
        .where(F.col("place") <= F.col("r") - least + 1)
        .select("col", "node")
    )
    lookup = materialise(lookup, "ngram-lookup")
    hub = lookup.groupBy("col").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    meets = lookup.join(hub, "col").where("node <> hub").select("node", "hub").distinct()
    groups = materialise(connected_components(meets, "node", "hub"), "ngram-groups")

    size = groups.groupBy("component").agg(F.count("*").alias("size"))
    placed = groups.join(size, "component").join(classes.select("node", "doc_id", "text_key").hint("merge"), "node")
    # tiles by a hash; a group of up to one tile is whole
    tiles = F.ceil(F.col("size") / tile).cast("int")
    placed = placed.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    with_text = _texts(docs).join(placed.hint("merge"), ["doc_id", "text_key"])
    spread = with_text.select(
        "node", "text", "tile", F.col("component").alias("grp"), "size", "tiles", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    ).select("*", F.least("tile", "other").alias("tile_a"), F.greatest("tile", "other").alias("tile_b"))
    total = groups.count()
    bins = max(1, total // 600)
    spread = spread.withColumn(
        "task", F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("grp"), F.lit(bins))).otherwise(F.xxhash64("grp", "tile_a", "tile_b"))
    )
    links = spread.groupBy("task").applyInPandas(_tiles(words, percent), "a long, b long")
    found = connected_components(links, "a", "b")
    linked = classes.join(found, "node")
    first = linked.groupBy("component").agg(F.min("doc_id").alias("class_component"))
    member = linked.join(first, "component").select(*key, "class_component")
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("class_component", "rep"))
    of_class = classes.select(*key, F.col("doc_id").alias("rep")).join(member, key, "left")
    return (
        base.drop("sketch")
        .join(of_class, key, "left")
        .select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), alone).alias("component_id"))
    )


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def keep_one(
    docs: DataFrame, words: int = WORDS_A_SHINGLE, percent: int = PERCENT, sketch: int = SKETCH, need: int = NEED, tile: int = TILE
) -> DataFrame:
    """``docs`` with one document, the smallest id, of each component; columns as they were. Rows of a null id stay."""
    kept = _joined(docs, words, percent, sketch, need, tile).where("component_id = doc_id or doc_id is null")
    found = kept.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["_id"]) & (F.xxhash64(docs["text"].cast("string")) == found["_key"]), "left_semi")
