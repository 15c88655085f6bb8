"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes, distance-weighted votes.

1. A bounded sample of labelled documents, at most ``examples`` of either label, by a hash of the id.
   Examples of equal texts are one, with the mean of their labels.
2. Every term of every example is indexed; document frequencies are counted over all documents. A term's weight in
   the cosine is its inverse document frequency times ``FLOOR`` plus what the example labels prove about it, so
   no term is without weight.
3. An inverted index of the examples, its postings cut into blocks with the largest weight of each. It is bounded by
   the examples, and broadcast. Every document is scored against it: blocks are opened in the order of
   their upper bounds until none can enter the k nearest, so the neighbours are exact. What the longest lists give is a
   matrix product for many documents at once, and part of the bounds.
4. The votes, weighted by cosine, become a probability by a table fitted on the examples, each left out of its own vote.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citetrace.plans.storage import materialise

EXAMPLES = 3000
NEAREST = 15
BLOCK = 256
#: The terms of the longest posting lists, which are held as rows of a matrix; their part of a cosine is a matrix product.
HEAVY = 256
#: Queries in one such product.
TOGETHER = 128
#: Weight, before idf, of a term that says nothing about the label.
FLOOR = 0.2
#: A term's log odds ratio counts as far as it is beyond so many standard errors.
ERRORS = 3.0
STEPS = 20
#: Blocks opened at first.
FIRST_BLOCKS = 8
#: Rounding that a sum of bounds may have.
SLACK = 1e-9
WORD = re.compile(r"[^\W_]+")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def words_of(text: str | None) -> list[str]:
    """Lower-case words of letters and digits."""
    return WORD.findall(text.lower()) if text else []


def _term_rows(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.float64()), ("terms", pa.list_(pa.string())), ("counts", pa.list_(pa.int32()))])
    for batch in batches:
        counts = [Counter(words_of(text.as_py())) for text in batch.column("text")]
        yield pa.record_batch(
            [batch.column("doc_id"), batch.column("toxic"), pa.array([list(c) for c in counts], schema.field(2).type), pa.array([list(c.values()) for c in counts], schema.field(3).type)], schema=schema
        )


def _frequencies(place: dict[str, int]):
    def of(batches):
        count = np.zeros(len(place) + 1, dtype=np.int64)
        get = place.get
        for batch in batches:
            found: list[int] = []
            for text in batch.column("text"):
                found += [p for p in map(get, set(words_of(text.as_py()))) if p is not None]
                count[-1] += 1
            count[:-1] += np.bincount(np.array(found, dtype=np.int64), minlength=len(place))
        held = np.flatnonzero(count)
        yield pa.record_batch([pa.array(held), pa.array(count[held])], names=["term", "df"])

    return of


def term_weights(df: np.ndarray, docs: int, term: np.ndarray, label: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """idf of each term times FLOOR plus its log odds ratio beyond ERRORS standard errors; term, label: one row for each posting."""
    n = len(df)
    a, of_all = np.bincount(term, label, minlength=n), np.bincount(term, minlength=n)
    b = of_all - a
    n1 = labels.sum()
    c, d = n1 - a, len(labels) - n1 - b
    a, b, c, d = (np.maximum(x, 0) + 0.5 for x in (a, b, c, d))
    proven = np.maximum(0.0, np.abs(np.log(a * d / (b * c))) - ERRORS * np.sqrt(1 / a + 1 / b + 1 / c + 1 / d))
    return (np.log((1 + docs) / (1 + np.minimum(df, docs))) + 0.01) * (FLOOR + proven)


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, … size[i] of them, for each i in turn."""
    out = np.repeat(begin - np.cumsum(size) + size, size)
    out += np.arange(len(out))
    return out


class Index:
    """Block-max inverted index of unit TF-IDF vectors; postings of a term are in the order of examples."""

    def __init__(self, place: dict[str, int], weight: np.ndarray, row: np.ndarray, term: np.ndarray, count: np.ndarray, labels: np.ndarray, block: int = BLOCK):
        self.place, self.weight, self.labels, self.block = place, weight, labels, block
        value = (1 + np.log(count)) * weight[term]
        norm = np.sqrt(np.bincount(row, value * value, minlength=len(labels)))
        value = value / np.maximum(norm, 1e-300)[row]
        #: similar examples stand together, so that blocks have low bounds for queries unlike them; rank: the place as given
        self.rank = _similar_first(row, term, value, len(labels), len(place))
        slot = np.empty(len(labels), dtype=np.int64)
        slot[self.rank] = np.arange(len(labels))
        self.labels = labels[self.rank]
        order = np.lexsort((slot[row], term))
        self.rows, self.values = slot[row[order]], value[order]
        term = term[order]
        self.blocks = -(-max(1, len(labels)) // block)
        self.first = np.arange(0, max(1, len(labels)), block)
        # the longest lists: their rows in the matrix, -1 for a term of the others
        size = np.bincount(term, minlength=len(place))
        longest = np.sort(np.argsort(-size, kind="stable")[:HEAVY])
        self.heavy = np.full(len(place), -1)
        self.heavy[longest] = np.arange(len(longest))
        self.matrix = np.zeros((len(longest), len(labels)))
        of_heavy = self.heavy[term]
        is_heavy = of_heavy >= 0
        self.matrix[of_heavy[is_heavy], self.rows[is_heavy]] = self.values[is_heavy]
        self.rows, self.values, term = self.rows[~is_heavy], self.values[~is_heavy], term[~is_heavy]
        key = term * self.blocks + self.rows // block
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, dtype=np.int64)
        # entries: a term's postings in one block; of term t: begin[t] to begin[t + 1]
        self.entry_block = key[first] % self.blocks
        self.entry_top = np.maximum.reduceat(self.values, first) if len(first) else np.empty(0)
        self.entry_from = np.append(first, len(key))
        self.begin = np.searchsorted(term[first], np.arange(len(place) + 1))

    def vector(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Terms in order and their weights, of unit length over the known terms."""
        get, n = self.place.get, Counter(words)
        t, n = np.array([get(w, -1) for w in n], dtype=np.int64), np.array(list(n.values()), dtype=np.float64)
        order = np.argsort(t)
        order = order[np.searchsorted(t[order], 0) :]
        t, q = t[order], (1 + np.log(n[order])) * self.weight[t[order]]
        return t, q / max(1e-300, math.sqrt(float(q @ q)))

    def nearest(self, query: tuple[np.ndarray, np.ndarray], k: int, leave_out: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples, by the place they were given in, of the largest cosine above 0, and those cosines; ties to the smaller place."""
        return next(self.nearest_of([query], k, [leave_out]))

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, leave_out: list[int] | None = None):
        """``nearest`` of each query."""
        for lo in range(0, len(queries), TOGETHER):
            part = queries[lo : lo + TOGETHER]
            heavy = np.zeros((len(part), len(self.matrix)))
            for i, (t, q) in enumerate(part):
                h = self.heavy[t]
                heavy[i, h[h >= 0]] = q[h >= 0]
            known = heavy @ self.matrix
            best = np.maximum.reduceat(known, self.first, axis=1) if known.shape[1] else np.zeros((len(part), 1))
            for i, (t, q) in enumerate(part):
                rest = self.heavy[t] < 0
                yield self._open(t[rest], q[rest], known[i], best[i], k, leave_out[lo + i] if leave_out else -1)

    def _open(self, t, q, known, best, k, leave_out):
        """From the part of the cosines that the longest lists give, and its largest of each block, the nearest."""
        size = self.begin[t + 1] - self.begin[t]
        entry, weight = _ragged(self.begin[t], size), np.repeat(q, size)
        of_block = self.entry_block[entry]
        bound = best + np.bincount(of_block, weight * self.entry_top[entry], minlength=self.blocks) + SLACK  # no cosine of a block is above
        order = np.argsort(-bound, kind="stable")
        order = order[: int(np.count_nonzero(bound > SLACK))]
        ids, scores, at, step = np.empty(0, dtype=np.int64), np.empty(0), 0, FIRST_BLOCKS
        while at < len(order):
            chosen = order[at : at + step]
            if len(ids) >= k:
                chosen = chosen[bound[chosen] >= scores[-1]]
                if not len(chosen):
                    break
            at, step = at + step, step * 4
            opened = np.zeros(self.blocks, dtype=bool)
            opened[chosen] = True
            pick = opened[of_block]
            e = entry[pick]
            many = self.entry_from[e + 1] - self.entry_from[e]
            posting = _ragged(self.entry_from[e], many)
            share = np.repeat(weight[pick], many)
            share *= self.values[posting]
            score = known + np.bincount(self.rows[posting], share, minlength=len(known))
            new = np.flatnonzero(np.repeat(opened, self.block)[: len(known)] & (score > 0))
            s = score[new]
            if len(new) > 2 * k:
                pick = s >= np.partition(s, len(s) - k - 1)[len(s) - k - 1]  # one more, as one may be left out
                new, s = new[pick], s[pick]
            new = self.rank[new]
            if leave_out >= 0:
                s, new = s[new != leave_out], new[new != leave_out]
            ids, scores = np.concatenate([ids, new]), np.concatenate([scores, s])
            top = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[top], scores[top]
        return ids, scores


def _similar_first(row: np.ndarray, term: np.ndarray, value: np.ndarray, n: int, terms: int, pivots: int = 24) -> np.ndarray:
    """The examples in an order that keeps similar ones together: by the nearest of a few evenly spaced examples."""
    if not len(row):
        return np.arange(n)
    near = np.zeros((pivots, n))
    for i, p in enumerate(np.linspace(0, n - 1, pivots).astype(int)):
        dense = np.zeros(terms)
        own = row == p
        dense[term[own]] = value[own]
        near[i] = np.bincount(row, value * dense[term], minlength=n)
    return np.lexsort((-near.max(axis=0), near.argmax(axis=0)))


class Scorer:
    """An index with the table that turns votes into probabilities."""

    def __init__(self, index: Index, labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, weight: tuple[float, float]):
        self.index, self.labels, self.k = index, labels, k
        # positives and all, by the vote; labels weigh what they stand for; texts without a neighbour are the last row
        seen = np.zeros((STEPS + 2, 2))
        for i, near in enumerate(index.nearest_of(vectors, k, list(range(len(vectors))))):
            vote = self.vote(*near)
            at = STEPS + 1 if vote is None else round(vote * STEPS)
            seen[at] += (1 - labels[i]) * weight[0], labels[i] * weight[1]
        total = seen.sum(axis=0)
        prior = total[1] / max(1e-9, total.sum())
        rate = (seen[:, 1] + 2 * prior) / (seen.sum(axis=1) + 2)
        self.rate = np.append(_rising(rate[:-1], seen[:-1].sum(axis=1) + 2), rate[-1])

    def vote(self, ids: np.ndarray, cosines: np.ndarray) -> float | None:
        """Share of the cosines that toxic neighbours have; None without neighbours."""
        return float(cosines @ self.labels[ids] / cosines.sum()) if len(ids) else None

    def probability(self, vote: float | None) -> float:
        if vote is None:
            return float(self.rate[STEPS + 1])
        x = vote * STEPS
        lo = min(int(x), STEPS - 1)
        return float(min(1.0, max(0.0, self.rate[lo] + (x - lo) * (self.rate[lo + 1] - self.rate[lo]))))

    def __call__(self, texts: list[str]) -> list[tuple[float, list[int]]]:
        """(score, places of the nearest examples) of each text; equal ones are looked up once."""
        places: dict[str, int] = {}
        at = [places.setdefault(t, len(places)) for t in texts]
        near = self.index.nearest_of([self.index.vector(words_of(t)) for t in places], self.k)
        found = [(self.probability(self.vote(ids, cosines)), ids[:3].tolist()) for ids, cosines in near]
        return [found[i] for i in at]


def _rising(rate: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The nearest series in which no value is below the one before (pooled neighbours)."""
    pools: list[list[float]] = []
    for r, w in zip(rate, weight, strict=True):
        pools.append([r * w, w, 1])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, w2, n = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + w2, pools[-1][2] + n]
    return np.concatenate([np.full(int(n), s / w) for s, w, n in pools])


def examples_of(docs: DataFrame, labels: DataFrame, examples: int) -> tuple[DataFrame, tuple[float, float]]:
    """(doc_id, toxic, terms, counts) of the labelled examples, and how many usable rows of either label an example stands for.

    Labels of held-out rows, null labels and null ids are not used. Several labels of one id, and of equal texts, are their mean;
    the least id of equal texts stands for them.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    usable = usable.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("toxic").alias("toxic"))
    found = usable.groupBy((F.col("toxic") >= 0.5).alias("y")).count().collect()
    chosen = None
    for y in (False, True):  # a top-k by hash, not a sort of all
        part = usable.where((F.col("toxic") >= 0.5) == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = _own(docs).join(F.broadcast(chosen), "doc_id")  # at most twice ``examples`` ids
    rows = rows.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("d")).agg(F.min("doc_id").alias("doc_id"), F.avg("toxic").alias("toxic"), F.first("text").alias("text"))
    by_label = {r[0]: r[1] for r in found}
    return rows.select("doc_id", "toxic", "text").mapInArrow(_term_rows, "doc_id long, toxic double, terms array<string>, counts array<int>"), (by_label.get(False, 0), by_label.get(True, 0))


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, k: int = NEAREST) -> tuple[Scorer, list[int]]:
    """The scorer and the ids of its examples."""
    rows, usable = examples_of(docs, labels, examples)
    rows = materialise(rows, "toxic-terms").toArrow().combine_chunks().sort_by("doc_id")  # bounded by the examples
    ids, labels_of = rows["doc_id"].to_pylist(), rows["toxic"].to_numpy()
    terms, counts = _whole(rows["terms"]), _whole(rows["counts"])
    row = np.repeat(np.arange(len(ids)), terms.value_lengths().to_numpy(zero_copy_only=False))
    words = _whole(terms.flatten()).dictionary_encode()
    term, count = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts.flatten().to_numpy(zero_copy_only=False)
    place = {w: i for i, w in enumerate(words.dictionary.to_pylist())}
    df = np.zeros(len(place) + 1)
    shared = docs.sparkSession.sparkContext.broadcast(place)
    run = lambda batches: _frequencies(shared.value)(batches)
    counted = _own(docs).select("text").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # one row a term
    df[counted["term"].to_numpy()] = counted["df"].to_numpy()
    weight = term_weights(df[:-1], int(df[-1]), term, labels_of[row], labels_of)
    index = Index(place, weight, row, term, count.astype(np.float64), labels_of)
    begin = np.searchsorted(row, np.arange(len(ids) + 1))
    vectors = []
    for i in range(len(ids)):
        own = slice(begin[i], begin[i + 1])
        by_term = np.argsort(term[own])
        q = ((1 + np.log(count[own])) * weight[term[own]])[by_term]
        vectors.append((term[own][by_term], q / max(1e-300, math.sqrt(float(q @ q)))))
    sampled = (1 - labels_of).sum(), labels_of.sum()
    return Scorer(index, labels_of, vectors, k, tuple(u / max(1.0, s) for u, s in zip(usable, sampled, strict=True))), ids


def _whole(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def score(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, k: int = NEAREST) -> DataFrame:
    """(doc_id, score, predicted, evidence) of every row of ``docs``; evidence is up to three nearest examples' ids.

    A null or empty text has no neighbour and the score of such examples, as has a text without any word of an example. Without usable labels
    every score is 0. Equal texts have equal scores, whatever labels their copies have; of equally near examples the smaller id counts.
    Repeated rows give repeated rows; other columns are not read. A long text is one vector.
    """
    scorer, ids = fit(docs, labels, examples, k)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((scorer, ids))  # bounded by the examples

    def of(batches):
        scorer, ids = shared.value
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("evidence", pa.list_(pa.int64()))])
        for batch in batches:
            found = scorer([text.as_py() or "" for text in batch.column("text")])
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([x[0] for x in found], pa.float64()), pa.array([[ids[i] for i in x[1]] for x in found], pa.list_(pa.int64()))], schema=schema
            )

    out = _own(docs).mapInArrow(of, "doc_id long, score double, evidence array<long>")
    return out.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
