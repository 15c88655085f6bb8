"""Ranked lexical search of many queries at once: what queries share is scored once and combined along a graph of shared parts.

A first pass over the texts writes, for each document, its number of terms and its counts of the terms that some item holds; N, L and df are sums over that
table. The items' terms are then mined for what they share: terms that the same items hold are one set, each item is some sets, and the pair that most items
hold becomes a node of its own, in its parts' place, until no pair is held twice. So the graph has a leaf for each set and an inner node for each shared pair
of nodes. A second pass scores documents in blocks: each count of a term is weighed once and added to the accumulator of its set, each node's accumulator is the
sum of its two parts', made once however many items use it, and an item's scores are the sum of its nodes' accumulators. Each task keeps the best of each
item; two rounds of ranking merge them.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citetrace.plans.storage import materialise

#: Bytes of text that are split at once (a longer text alone), and cells of accumulators that are held at once.
PASS_BYTES, CELLS = 1 << 22, 1 << 22
#: Items that are searched together: so many, or fewer whose texts reach so many bytes (a longer one alone). Each block of items is two passes over the documents.
ITEMS, ITEM_BYTES = 2000, 1 << 22
#: Sets of an item, those that most items hold first, among which shared pairs are mined; its further sets are added one by one, with the same scores.
MINED = 128
#: Groups in which the tasks' best are ranked before all of them are.
GROUPS = 64
#: Stands for a null id, after all others.
NO_ID = (1 << 63) - 1

#: What becomes of each byte: letters lower-cased, other ASCII but digits a blank; all bytes of longer characters stay.
_TERM = np.arange(256, dtype=np.uint8)
_TERM[:128] = 32
for _a, _b in ((48, 58), (97, 123)):
    _TERM[_a:_b] = np.arange(_a, _b)
_TERM[65:91] = np.arange(97, 123)


def terms(texts: pa.Array) -> Iterator[tuple[int, pa.ListArray]]:
    """(first row, terms of each text) for stretches of the column; a null text has none."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64, count=texts.offset + n + 1)[texts.offset :]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.empty(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PASS_BYTES, side="right")) - 1)
        own = offsets[lo : hi + 1]
        plain = _TERM[data[own[0] : own[-1]]]
        column = pa.LargeStringArray.from_buffers(hi - lo, pa.py_buffer((own - own[0]).tobytes()), pa.py_buffer(plain))
        yield lo, pc.ascii_split_whitespace(pc.ascii_trim(column, " "))
        lo = hi


def distinct_terms(text: str | None) -> list[str]:
    """The terms of one text, each once, in order."""
    return [t for _, found in terms(pa.array([text], type=pa.string())) for t in dict.fromkeys(found[0].as_py()) if t]


def blocks_of(items: DataFrame) -> Iterator[list[tuple[int | None, list[str]]]]:
    """The items in blocks of bounded size, as (id, terms); the driver holds one block. Items without terms go."""
    block, size = [], 0
    for item_id, text in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text").toLocalIterator():
        block.append((item_id, distinct_terms(text)))
        size += len(text or "")
        if len(block) == ITEMS or size >= ITEM_BYTES:
            yield [x for x in block if x[1]]
            block, size = [], 0
    yield [x for x in block if x[1]]


class Sharing:
    """The graph of what items share: ``leaf`` of each term, ``pairs`` (the two parts of each inner node, after its parts), ``items`` (the nodes of each)."""

    def __init__(self, items: list[list[str]]):
        holders = defaultdict(list)
        for i, words in enumerate(items):
            for w in words:
                holders[w].append(i)
        sets = defaultdict(list)
        for w, held in holders.items():
            sets[tuple(held)].append(w)
        # leaves by falling number of items, so that what many share comes first
        order = sorted(sets.items(), key=lambda x: (-len(x[0]), x[0]))
        self.leaf = {w: n for n, (_, words) in enumerate(order) for w in words}
        self.leaves, self.pairs = len(order), []
        self.items = [[] for _ in items]
        for n, (held, _) in enumerate(order):
            for i in held:
                self.items[i].append(n)
        self._mine()

    def _mine(self) -> None:
        """Make a node of the pair that most items hold, and put it in its parts' place in all of them, until no pair is held twice."""
        held = [set(nodes[:MINED]) for nodes in self.items]
        rest = [nodes[MINED:] for nodes in self.items]
        where = defaultdict(set)
        for i, nodes in enumerate(held):
            for pair in combinations(sorted(nodes), 2):
                where[pair].add(i)
        heap = [(-len(found), pair) for pair, found in where.items() if len(found) > 1]
        heapify(heap)
        while heap:
            n, pair = heappop(heap)
            found = where.get(pair, ())
            if len(found) != -n:  # fewer by now
                if len(found) > 1:
                    heappush(heap, (-len(found), pair))
                continue
            node, fresh = self.leaves + len(self.pairs), set()
            self.pairs.append(pair)
            for i in sorted(where.pop(pair)):
                held[i] -= set(pair)
                for x in held[i]:
                    for gone in pair:
                        where[min(x, gone), max(x, gone)].discard(i)
                    where[x, node].add(i)
                    fresh.add((x, node))
                held[i].add(node)
            for x in fresh:
                if len(where[x]) > 1:
                    heappush(heap, (-len(where[x]), x))
        self.items = [sorted(nodes) + more for nodes, more in zip(held, rest)]

    def additions(self) -> int:
        """Sums of two accumulators that scoring a block of documents takes."""
        return len(self.pairs) + sum(len(nodes) - 1 for nodes in self.items)


def postings(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, n, terms, counts) of every row, written: its number of terms, and the terms of the vocabulary that it holds, by number, with their counts."""
    words = docs.sparkSession.sparkContext.broadcast(pa.array(vocabulary, type=pa.large_string()))  # the terms of one block of items

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        for b in batches:
            for lo, found in terms(b.column("text")):
                rows = len(found)
                offsets = found.offsets.to_numpy() - found.offsets[0].as_py()
                values = found.flatten()
                filled = pc.not_equal(values, "").to_numpy(zero_copy_only=False)
                total = np.add.reduceat(np.append(filled, False).astype(np.int64), offsets[:-1]) * (np.diff(offsets) > 0)
                at = pc.fill_null(pc.index_in(values, value_set=known), -1).to_numpy()
                doc = np.repeat(np.arange(rows), np.diff(offsets))
                key, n = np.unique((doc * (len(known) + 1) + at)[at >= 0], return_counts=True)
                own, term = np.divmod(key, len(known) + 1)
                ends = np.searchsorted(own, np.arange(rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (term, n)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, rows), pa.array(total), *lists], ["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialise(rows.mapInArrow(count, "doc_id long, n long, terms array<int>, counts array<int>"), "term-counts")


def frequencies(held: DataFrame) -> dict[int, int]:
    """df of the terms by number: a sum a task, then over tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(0, dtype=np.int64)
        for b in batches:
            now = np.bincount(b.column("terms").flatten().to_numpy(), minlength=len(sums))
            now[: len(sums)] += sums
            sums = now
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(sums).astype(np.int32)), pa.array(sums[sums > 0])], ["term", "df"])

    return dict(map(tuple, held.select("terms").mapInArrow(add, "term int, df long").groupBy("term").agg(F.sum("df")).collect()))  # one row a term of the block


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest scores above 0 for each item, equal scores by ascending doc_id.

    docs: doc_id, text; items: item_id, text. A null or empty text has no terms: such a document has no score and is not counted, such an item has no rows. Texts
    are read whole at any length. Rows that repeat, or repeat an id, are documents (or items) of their own; a null doc_id comes after all others of its
    score. Other columns are not read. Without documents, or without items, there are no rows.
    """
    spark, out = docs.sparkSession, None
    for block in blocks_of(items):
        if block or out is None:
            found = _ranked(docs, block, k)
            out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def _ranked(docs: DataFrame, block: list[tuple[int | None, list[str]]], k: int) -> DataFrame:
    spark = docs.sparkSession
    graph = Sharing([words for _, words in block])
    vocabulary = sorted(graph.leaf)
    held = postings(docs, vocabulary)
    n_docs, n_terms = held.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = frequencies(held)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(vocabulary))], dtype=np.int64)
    leaf = np.array([graph.leaf[w] for w in vocabulary], dtype=np.int64)
    shared = spark.sparkContext.broadcast((weight, leaf, graph.leaves, graph.pairs, graph.items))  # of one block of items

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, leaf, leaves, pairs, parts = shared.value
        nodes = leaves + len(pairs)
        step = max(1, CELLS // max(1, nodes))
        ids, best = [np.empty(0, dtype=np.int64)] * len(parts), [np.empty(0, dtype=np.int64)] * len(parts)
        floor = np.ones(len(parts), dtype=np.int64)  # only scores above 0
        for b in batches:
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                doc_id = pc.fill_null(part.column("doc_id"), NO_ID).to_numpy()
                n = part.column("n").to_numpy()
                length = pc.fill_null(pc.list_value_length(part.column("terms")), 0).to_numpy()
                term, tf = (part.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "counts"))
                doc = np.repeat(np.arange(len(n)), length)
                m = 50 + 50 * n * n_docs // max(1, n_terms)
                impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
                sums = np.zeros((nodes, len(n)), dtype=np.int64)
                np.add.at(sums, (leaf[term], doc), impact)
                for at, (x, y) in enumerate(pairs, leaves):
                    np.add(sums[x], sums[y], out=sums[at])
                for i, own in enumerate(parts):
                    s = sums[own[0]] if len(own) == 1 else sums[own].sum(axis=0)
                    hit = np.flatnonzero(s >= floor[i])
                    if not len(hit):
                        continue
                    s, d = np.concatenate([best[i], s[hit]]), np.concatenate([ids[i], doc_id[hit]])
                    order = np.lexsort((d, -s))[:k]
                    best[i], ids[i] = s[order], d[order]
                    if len(order) == k:
                        floor[i] = s[order[-1]]
        item = np.repeat(np.arange(len(parts)), [len(x) for x in ids])
        if len(item):
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(np.concatenate(ids)), pa.array(np.concatenate(best))], ["item", "doc", "score"])

    found = held.mapInArrow(score, "item long, doc long, score long").withColumn("_g", F.spark_partition_id() % GROUPS)
    by = F.col("score").desc(), F.col("doc"), F.col("_g")
    first = found.withColumn("_r", F.row_number().over(Window.partitionBy("item", "_g").orderBy(*by))).where(F.col("_r") <= k)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item long, item_id long")
    doc_id = F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id")
    return ranked.join(names, "item").select("item_id", "rank", doc_id, "score")
