"""Benchmark decontamination by latent semantic retrieval, with subsequence and answer checks.

1. Document frequencies of the benchmark's words over all documents.
2. A distributed randomised SVD of TF-IDF passages, of all benchmark items and all documents, both of the same total weight: power
   steps over the items, then one over everything, each a sum of small matrices over partitions. It is fitted once for all items.
3. Every passage of every document (40 words, a new one each 20) is projected; items within the cosine bound are candidates.
4. A candidate is a leak if the longest common subsequence of the item and the text around the passage is
   long enough, or half as long as the item while the item's answer (its last sentence) stands there word for word.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citetrace.llm.words import U, passes
from citetrace.plans.storage import materialise

SEGMENT = 20
RANK = 64
POWERS = 2
COSINE = 0.32
SUBSEQUENCE = 0.6
WITH_ANSWER = 0.5
#: Items that are compared in one pass over the documents, and the most that items times their words may be:
#: what is broadcast is bounded by them. The rows do not depend on them.
ITEMS_A_PASS = 2000
CELLS_A_PASS = 50_000_000
#: An item of more words has a vector for each of its passages as well, and one check for all passages within a quarter of its length.
LONG = 8 * SEGMENT
#: Words of the vocabulary in one piece of a matrix that is summed over partitions.
PIECE = 256
#: Counts that one check of candidates holds.
HELD_AT_ONCE = 4_000_000
#: Words of windows that one step of the first bound looks up, and segments that are projected at once.
WORDS_AT_ONCE = 1 << 18
SEGMENTS_AT_ONCE = 8192
#: Words of passages that one part of a power step takes.
PAIRS_AT_ONCE = 8192


class Vocabulary:
    """Places of 64-bit word hashes: sorted, with the first place of each value of their upper bits, so a look-up is a few numpy passes."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.build()

    def build(self) -> None:
        bits = max(8, int(np.ceil(np.log2(max(2, len(self.hashes))))) + 3)
        self.shift = U(64 - bits)
        upper = (self.hashes >> self.shift).astype(np.int64)
        self.first = np.searchsorted(upper, np.arange((1 << bits) + 1)).astype(np.int32)
        #: the most hashes that share their upper bits
        self.most = int(np.diff(self.first).max(initial=0))
        self.known = np.append(self.hashes, U(0))

    def __getstate__(self) -> dict:
        """Only the hashes travel; the rest is built again where it is used."""
        return {"hashes": self.hashes}

    def __setstate__(self, state: dict) -> None:
        self.hashes = state["hashes"]
        self.build()

    def __len__(self) -> int:
        return len(self.hashes)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash; ``len(self)`` for an unknown one."""
        n = len(self)
        upper = hashes >> self.shift
        at, end = self.first[upper], self.first[upper + U(1)]
        out = np.where((at < end) & (self.known[at] == hashes), at, n)
        for _ in range(1, self.most):
            open_ = np.flatnonzero((out == n) & (at + 1 < end))
            if not len(open_):
                break
            at[open_] += 1
            hit = open_[self.known[at[open_]] == hashes[open_]]
            out[hit] = at[hit]
        return out


def _own(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.col("text").cast("string").alias("text"))


def _frequencies(vocabulary: Vocabulary):
    def of(batches):
        n = len(vocabulary)
        count = np.zeros(n + 1, dtype=np.int64)
        docs = 0
        for batch in batches:
            for _, words in passes(batch.column("text"), lower=True):
                at = vocabulary.places(words.hash)
                known = at < n
                pair = np.unique(words.doc[known] * np.int64(n) + at[known])
                count[:n] += np.bincount(pair % n, minlength=n)
                docs += len(words.count)
        count[n] = docs
        yield pa.record_batch([pa.array(np.arange(n + 1)), pa.array(count)], names=["place", "df"])

    return of


def _segments(words):
    """First word of each segment, its document, and whether the next segment is of the same document."""
    place = np.arange(len(words.doc)) - words.bound[words.doc]
    first = np.flatnonzero(place % SEGMENT == 0)
    doc = words.doc[first]
    more = np.append(doc[1:] == doc[:-1], False)
    return first, doc, more


def _added(total: np.ndarray, place: np.ndarray, rows: np.ndarray) -> None:
    """total[place] += rows, places that repeat included."""
    order = np.argsort(place, kind="stable")
    own, first = np.unique(place[order], return_index=True)
    total[own] += np.add.reduceat(rows[order], first, axis=0)


def _step(vocabulary: Vocabulary, idf: np.ndarray, m: np.ndarray, kind: int):
    """Per partition: the sum over passages of a'(a m), and their number; kind: 0 for documents, 1 for items."""

    def of(batches):
        n, narrow = len(vocabulary), m.astype(np.float32)
        sums, number = np.zeros_like(m), 0
        for batch in batches:
            for _, words in passes(batch.column("text"), lower=True):
                if not len(words.hash):
                    continue
                first, _, more = _segments(words)
                at = vocabulary.places(words.hash)
                segment = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(at))))
                known = at < n
                # a word counts for the passage of its segment and for the one before
                p = np.concatenate([segment[known], segment[known] - 1])
                t = np.concatenate([at[known], at[known]])
                ok = (p >= 0) & np.concatenate([np.ones(known.sum(), dtype=bool), more[segment[known] - 1]])
                key, tf = np.unique(p[ok] * np.int64(n) + t[ok], return_counts=True)
                if not len(key):
                    continue
                p, t = key // n, key % n
                w = tf * idf[t]
                norm = np.sqrt(np.bincount(p, w * w, minlength=len(first)))
                w = (w / norm[p]).astype(np.float32)[:, None]
                begins = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
                number += len(begins)
                size = np.diff(np.append(begins, len(p)))
                for lo, hi in _pieces_of(size, PAIRS_AT_ONCE):  # whole passages
                    x, y = begins[lo], begins[hi - 1] + size[hi - 1]
                    seen = np.add.reduceat(w[x:y] * narrow[t[x:y]], begins[lo:hi] - x, axis=0)
                    _added(sums, t[x:y], w[x:y] * np.repeat(seen, size[lo:hi], axis=0))
        out = [(kind, c, number, sums[c : c + PIECE].tobytes()) for c in range(0, n, PIECE)]
        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), PIECES, strict=True)], schema=PIECES)

    return of


PIECES = pa.schema([("kind", pa.int32()), ("piece", pa.int64()), ("n", pa.int64()), ("sum", pa.binary())])


def _summed(batches):
    """The sums of the pieces of equal kind and place, which are all in one partition."""
    total: dict[tuple[int, int], list] = {}
    for batch in batches:
        for kind, piece, n, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            have = total.setdefault((kind, piece), [0, 0.0])
            have[0] += n
            have[1] = have[1] + np.frombuffer(raw)
    if total:
        out = [(k, p, n, s.tobytes()) for (k, p), (n, s) in total.items()]
        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), PIECES, strict=True)], schema=PIECES)


def fit(docs: DataFrame, items: DataFrame, vocabulary: Vocabulary, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """(idf, basis): the weight of each word and its place in the latent space, from all ``docs`` and all ``items`` (id, text).

    The space is first turned towards the items by power steps over them; one step over all passages of documents and items then gives the basis.
    """
    n = len(vocabulary)
    own = _own(docs, "doc_id")
    df = np.zeros(n + 1)
    sent = own.sparkSession.sparkContext.broadcast(vocabulary)  # 8 bytes a word of the benchmark
    frequencies = lambda batches: _frequencies(sent.value)(batches)
    counted = own.mapInArrow(frequencies, "place long, df long").groupBy("place").agg(F.sum("df").alias("df")).toArrow()
    df[counted["place"].to_numpy()] = counted["df"].to_numpy()
    idf = np.log((1 + df[n]) / (1 + df[:n])) + 0.1  # of every word, as an item may itself make its words common
    idf_of = own.sparkSession.sparkContext.broadcast(idf)
    own, items = own.select("text"), items.select("text")

    def stepped(q: np.ndarray, *texts: tuple[int, DataFrame]) -> np.ndarray:
        """The mean over the passages of each kind of text of a'(a q), added up."""
        step = own.sparkSession.sparkContext.broadcast(q)
        kinds, out = "kind int, piece long, n long, sum binary", np.zeros_like(q)
        runs = [t.mapInArrow(lambda batches, kind=kind: _step(sent.value, idf_of.value, step.value, kind)(batches), kinds) for kind, t in texts]
        for _, piece, count, raw in reduce(DataFrame.unionByName, runs).repartition("kind", "piece").mapInArrow(_summed, kinds).collect():
            part = np.frombuffer(raw).reshape(-1, q.shape[1])
            out[piece : piece + len(part)] += part / max(1, count)
        return out

    rank = min(rank, n)
    m = np.random.default_rng(5).standard_normal((n, min(n, rank + 8)))
    for _ in range(POWERS):
        q, _ = np.linalg.qr(m)
        m = stepped(q, (1, items))
    q, _ = np.linalg.qr(m)
    return idf, basis_of(q, stepped(q, (0, own), (1, items)), rank)


def basis_of(q: np.ndarray, m: np.ndarray, rank: int) -> np.ndarray:
    """The first ``rank`` axes of a symmetric matrix s of which only m = s q is known (q: orthonormal), as s is about m (q'm)^-1 m'."""
    values, turn = np.linalg.eigh((q.T @ m + m.T @ q) / 2)
    held = values > 1e-9 * max(values.max(initial=0), 1e-300)
    return np.linalg.svd(m @ (turn[:, held] / np.sqrt(values[held])), full_matrices=False)[0][:, :rank]


def subsequence(masks: list[int], size: int, other: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel; masks: the places of each word of the first sequence."""
    full = (1 << size) - 1
    v = full
    for y in other:
        u = v & masks[y]
        v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def _before(columns: np.ndarray, different: int) -> np.ndarray:
    """The last earlier place of the same value, or -1."""
    order = np.argsort(columns.astype(np.uint16) if different < 1 << 16 else columns, kind="stable")
    same = columns[order[1:]] == columns[order[:-1]]
    out = np.full(len(columns), -1)
    out[order[1:][same]] = order[:-1][same]
    return out


def _pieces_of(size: np.ndarray, most: int):
    """(from, to) of stretches whose sizes add up to ``most`` at the utmost, or are of one element."""
    total, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


class Items:
    """Words, answer and latent vector of the benchmark items of one pass."""

    def __init__(self, ids: list[int], texts: list[str], vocabulary: Vocabulary, idf: np.ndarray, basis: np.ndarray):
        self.ids, self.vocabulary = np.array(ids), vocabulary
        self.vectors = np.vstack([basis * idf[:, None], np.zeros((1, basis.shape[1]))]).astype(np.float32)
        self.words: list[list[int]] = []
        self.answers: list[list[int]] = []
        #: per item: its own words in order, how often each stands there, and where
        own_words: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        self.masks: list[list[int]] = []
        latent, of_latent = [], []
        for _, words in passes(pa.array(texts, pa.large_string()), lower=True):
            for i in range(len(words.count)):
                at = vocabulary.places(words.hash[words.bound[i] : words.bound[i + 1]])
                parts = [at] + ([at[j : j + 2 * SEGMENT] for j in range(0, len(at) - SEGMENT, SEGMENT)] if len(at) > LONG else [])
                latent += [self.vectors[x].sum(axis=0) for x in parts]
                of_latent += [len(self.words)] * len(parts)
                own, place, count = np.unique(at, return_inverse=True, return_counts=True)
                masks = [0] * len(own)
                for k, x in enumerate(place.tolist()):
                    masks[x] |= 1 << k
                self.words.append(at.tolist())
                own_words.append(own)
                counts.append(count)
                self.masks.append(masks)
        for text, own in zip(texts, self.words, strict=True):
            parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text) if p.strip()]
            size = len(parts[-1].encode().split()) if len(parts) > 1 else 0
            self.answers.append(own[len(own) - size :] if 2 <= size < len(own) else [])
        self.sizes = np.array([len(w) for w in self.words])
        #: of a vocabulary word, its column among the words of these items (the last: none of them); of an item and a column, its place among the item's own words (-1: none)
        columns = np.unique(np.concatenate(own_words))
        self.column = np.full(len(vocabulary) + 1, len(columns), dtype=np.int32)
        self.column[columns] = np.arange(len(columns))
        self.kinds = np.array([len(w) for w in own_words])
        self.local = np.full((len(ids), len(columns) + 1), -1, dtype=np.int16 if self.kinds.max() < 30_000 else np.int32)
        for k, own in enumerate(own_words):
            self.local[k, self.column[own]] = np.arange(len(own))
        self.held, self.held_from = np.concatenate(counts), np.cumsum(self.kinds) - self.kinds
        #: of an item and a column, how often the word stands in the item
        self.often = np.zeros(self.local.shape, dtype=np.uint8 if self.held.max() < 256 else np.int32)
        for k, own in enumerate(own_words):
            self.often[k, self.column[own]] = counts[k]
        self.of_latent = np.array(of_latent)
        self.reach = self.sizes + np.where(self.sizes > LONG, self.sizes // 4, 0)
        self.apart = np.where(self.sizes > LONG, self.sizes // 4, 1)
        latent = np.array(latent, dtype=np.float32)
        self.latent = latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)

    def projected(self, at: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The sum of the vectors of each segment's words; at: vocabulary places, first: where each segment begins."""
        out = np.empty((len(first), self.vectors.shape[1]), dtype=np.float32)
        ends, place = np.append(first[1:], len(at)), np.arange(SEGMENT)
        at = np.append(at, np.full(SEGMENT, len(self.vocabulary)))
        for lo in range(0, len(first), SEGMENTS_AT_ONCE):
            own = first[lo : lo + SEGMENTS_AT_ONCE, None] + place
            cells = np.where(own < ends[lo : lo + SEGMENTS_AT_ONCE, None], at[own], len(self.vocabulary))
            out[lo : lo + SEGMENTS_AT_ONCE] = self.vectors[cells].sum(axis=1)
        return out

    def padded(self, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns and the last earlier place of the same one, with room for the widest window behind the end."""
        most, none = 2 * SEGMENT + 2 * int(self.reach.max()), self.often.shape[1] - 1
        return np.append(columns, np.full(most, none)).astype(np.int64), np.append(_before(columns, none + 1), np.full(most, -1))

    def roomy(self, items: np.ndarray, begin: np.ndarray, columns: np.ndarray, before: np.ndarray, with_answer: float) -> np.ndarray:
        """Places of the windows that may be possible: as if each word of an item that stands in its window stood there as often as in the item.

        Windows are read as wide as the widest of a step, beyond the document's end too; the bound is then larger, never smaller. columns, before: of ``padded``.
        """
        order = np.lexsort((items, self.reach[items]))
        width = 2 * SEGMENT + 2 * self.reach[items[order]]
        often, keep = self.often.ravel(), []
        for lo, hi in _pieces_of(width, WORDS_AT_ONCE):
            k, at, wide = items[order[lo:hi]], begin[order[lo:hi]], int(width[hi - 1])
            cells = np.lib.stride_tricks.sliding_window_view(columns, wide)[at]
            cells += (k * self.often.shape[1])[:, None]
            new = np.lib.stride_tricks.sliding_window_view(before, wide)[at] < at[:, None]  # the first of its word in the window
            room = (often[cells] * new).sum(axis=1, dtype=np.int32)
            keep.append(order[lo:hi][room >= with_answer * self.sizes[k]])
        return np.sort(np.concatenate(keep)) if keep else order

    def possible(self, items: np.ndarray, begin: np.ndarray, end: np.ndarray, columns: np.ndarray, with_answer: float) -> np.ndarray:
        """Whether each window columns[begin:end] (of words) has enough of its item's words: no common subsequence is longer than those."""
        out = np.zeros(len(items), dtype=bool)
        for lo, hi in _pieces_of(self.kinds[items] + (end - begin), HELD_AT_ONCE):
            k, size, kinds = items[lo:hi], (end - begin)[lo:hi], self.kinds[items[lo:hi]]
            slot = np.cumsum(kinds) - kinds  # where the counts of each candidate begin
            which = np.repeat(np.arange(len(k)), size)
            place = np.arange(len(which)) + np.repeat(begin[lo:hi] - np.cumsum(size) + size, size)
            local = self.local[k[which], columns[place]]
            known = local >= 0
            count = np.bincount(slot[which[known]] + local[known], minlength=int(kinds.sum()))
            held = self.held[np.arange(len(count)) + np.repeat(self.held_from[k] - slot, kinds)]
            out[lo:hi] = np.add.reduceat(np.minimum(count, held), slot) >= with_answer * self.sizes[k]
        return out

    def leak(self, k: int, window: np.ndarray, subsequence_share: float, with_answer: float) -> tuple[float, bool] | None:
        """(share of the item in order, whether its answer stands there) if that is a leak; window: vocabulary places."""
        own = self.words[k]
        local = self.local[k][self.column[window]]
        local = local[local >= 0]
        share = subsequence(self.masks[k], len(own), local.tolist()) / len(own)
        if share < with_answer:
            return None
        a, other = self.answers[k], window.tolist()
        answer = bool(a) and any(other[j : j + len(a)] == a for j in range(len(other) - len(a) + 1) if other[j] == a[0])
        return (share, answer) if share >= subsequence_share or answer else None


LEAKS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("shared", pa.float64()), ("answer", pa.bool_())])


def _search(items: Items, cosine: float, subsequence_share: float, with_answer: float):
    def of(batches):
        for batch in batches:
            ids = batch.column("id")  # as it is: a null among them must not turn the rest into floats
            out: list[list] = [[] for _ in LEAKS]
            for row, words in passes(batch.column("text"), lower=True):
                if not len(words.hash):
                    continue
                first, doc, more = _segments(words)
                at = items.vocabulary.places(words.hash)
                columns = items.column[at]
                seg = items.projected(at, first)
                seg[:-1] += np.where(more[:-1, None], seg[1:], 0)
                seg /= np.maximum(np.linalg.norm(seg, axis=1, keepdims=True), 1e-9)
                best: dict[tuple[int, int], tuple] = {}
                wide = items.padded(columns)
                for lo in range(0, len(seg), SEGMENTS_AT_ONCE):
                    near = seg[lo : lo + SEGMENTS_AT_ONCE] @ items.latent.T
                    p, v = np.nonzero(near >= cosine)
                    k = items.of_latent[v]
                    if items.sizes.max() > LONG:  # once for each document, item and stretch of a quarter of a long item
                        cell = np.stack([doc[lo + p], k, first[lo + p] // items.apart[k]])
                        once = np.sort(np.unique(cell, axis=1, return_index=True)[1])
                        p, k, v = p[once], k[once], v[once]
                    d, s, reach = doc[lo + p], first[lo + p], items.reach[k]
                    begin, end = np.maximum(words.bound[d], s - reach), np.minimum(words.bound[d + 1], s + 2 * SEGMENT + reach)
                    few = items.roomy(k, begin, *wide, with_answer)
                    for j in few[items.possible(k[few], begin[few], end[few], columns, with_answer)].tolist():
                        pair = int(d[j]), int(items.ids[k[j]])
                        have = best.get(pair)
                        if have and have[1] >= 0.999:
                            continue
                        hit = items.leak(int(k[j]), at[begin[j] : end[j]], subsequence_share, with_answer)
                        if hit and (not have or hit > have[1:]):
                            best[pair] = (float(near[p[j], v[j]]), *hit)
                for (d, k), (c, share, answer) in best.items():
                    for col, x in zip(out, (ids[row + d].as_py(), k, c, share, answer), strict=True):
                        col.append(x)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, LEAKS, strict=True)], schema=LEAKS)

    return of


def _item_words(batches):
    """Distinct word hashes of the items."""
    for batch in batches:
        found = [w.hash for _, w in passes(batch.column("text"), lower=True)]
        yield pa.record_batch([pa.array(np.unique(np.concatenate([*found, np.empty(0, dtype=U)])).view(np.int64))], names=["hash"])


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    rank: int = RANK,
    cosine: float = COSINE,
    subsequence_share: float = SUBSEQUENCE,
    with_answer: float = WITH_ANSWER,
    items_a_pass: int = ITEMS_A_PASS,
    cells_a_pass: int = CELLS_A_PASS,
) -> DataFrame:
    """(doc_id, item_id, cosine, shared, answer): the items that each document holds, once each.

    Null and empty texts, of documents or items, hold nothing and are held by nothing; an empty benchmark gives no
    rows. An item id of several texts is held where any of them is. Repeated rows of documents give repeated rows; a row of a null doc_id has its hits
    with a null id. Other columns are not read. Vocabulary, weights and basis are fitted once on all documents and items; items are then compared in blocks, each a
    pass over all documents, and no row depends on how they are cut. The check of a long item takes its length times that of the text around a passage.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, cosine double, shared double, answer boolean"
    items = _own(benchmark, "item_id").where("id is not null and text rlike '[^ \\t\\n\\x0B\\f\\r]'").dropDuplicates(["id", "text"])
    items = materialise(items.withColumn("h", F.xxhash64("text")).withColumn("n", F.size(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"))), "lsa-items")
    sizes = items.select("id", "h", "n").orderBy("id", "h").toArrow()  # three numbers an item
    if not len(sizes):
        return spark.createDataFrame([], schema)
    hashes = items.select("text").mapInArrow(_item_words, "hash long").distinct().toArrow()["hash"].to_numpy()
    vocabulary = Vocabulary(hashes.view(U))
    idf, basis = fit(docs, items, vocabulary, rank)
    out = None
    for first, last in _blocks(sizes["n"].to_numpy(), items_a_pass, cells_a_pass):
        lo, hi = ((sizes["id"][i].as_py(), sizes["h"][i].as_py()) for i in (first, last))
        key = F.struct("id", "h")
        low, high = (F.struct(*[F.lit(x).cast("long").alias(c) for c, x in zip(("id", "h"), end, strict=True)]) for end in (lo, hi))
        rows = items.where(F.col("id").between(lo[0], hi[0])).where((key >= low) & (key <= high)).orderBy("id", "h").collect()  # one bounded block of the query set
        shared = spark.sparkContext.broadcast(Items([r.id for r in rows], [r.text for r in rows], vocabulary, idf, basis))
        run = lambda batches, shared=shared: _search(shared.value, cosine, subsequence_share, with_answer)(batches)
        found = _own(docs, "doc_id").mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def _blocks(words: np.ndarray, items: int, cells: int):
    """(first, last) of blocks of at most ``items`` items whose number times their words is at most ``cells``, or of one item."""
    first, total = 0, 0
    for i, n in enumerate(words.tolist()):
        if i > first and (i - first >= items or (i - first + 1) * (total + n) > cells):
            yield first, i - 1
            first, total = i, 0
        total += n
    yield first, len(words) - 1


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without those that hold a benchmark item; columns as they were. A row of a null doc_id stays."""
    bad = leaks(docs, benchmark, **options).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(bad.hint("merge"), docs["doc_id"].cast("long") == bad["_id"], "left_anti")
