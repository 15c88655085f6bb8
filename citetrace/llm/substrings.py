"""Substring deduplication: suffix automata of reference shards, documents streamed for matching statistics.

The whole corpus is its own reference, so automata of all of it cannot be broadcast. It is cut into shards by
content instead: the windows of 13 words that have the same smallest 5-word hash (their anchor) form a
run, and equal windows have equal anchors wherever they are. Each anchor is a reference shard:

1. All runs are exchanged once by anchor, as hashes and places. An anchor of one document is dropped: what it holds starts nowhere else.
2. The runs of the others are streamed in document order through the anchor's suffix automaton: matching statistics of 13 words or more mark the
   windows that start in a smaller document. Then what is new in the document's own runs is added to the automaton. Statistics of a run are
   kept for equal runs that follow, as long as the automaton stays as it is.
   An anchor of many differing runs is first split by the content of each window, so that no automaton grows with the documents.
3. Maximal covered spans go back to their documents, which are cut in one pass over the texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citetrace.llm.words import U, mix, passes
from citetrace.plans.storage import materialise

WINDOW = 13
GRAM = 5
#: An anchor of more differing runs is split into shards of one window text each.
RUNS_A_SHARD = 1000


def _sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """The least of each k neighbours."""
    n = len(x) - k + 1
    if n <= 0:
        return x[:0]
    have, m = 1, x
    while have * 2 <= k:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[:n], m[k - have : k - have + n])


def _runs(words, window: int, gram: int):
    """(doc row, first word in the document, number of windows, anchor) of the runs of windows of one anchor."""
    anchors = _sliding_min(words.windows(gram), window - gram + 1)
    n = len(anchors)
    whole = words.whole(window)
    doc = words.doc[:n]
    new = np.ones(n, dtype=bool)
    if n > 1:
        new[1:] = (anchors[1:] != anchors[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new & whole)
    # windows that cross into the next document stand at each document's end only
    last = np.flatnonzero(whole & np.concatenate([new[1:] | ~whole[1:], [True]])) if n else first
    return doc[first], first, last - first + 1, anchors[first]


def _version_of(batch: pa.RecordBatch) -> np.ndarray:
    """The number of each row's text among those of its id; all 0 where no id has several."""
    return batch.column("version").to_numpy().astype(np.int64) if "version" in batch.schema.names else np.zeros(batch.num_rows, dtype=np.int64)


def _anchors(window: int, gram: int):
    """Runs of each text. ``start`` has the text's version in its upper half, where it takes no room in an exchange."""
    schema = pa.schema([("doc_id", pa.int64()), ("anchor", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("windows", pa.int32())])

    def of(batches):
        for batch in batches:
            ids, versions = batch.column("doc_id").to_numpy(zero_copy_only=False), _version_of(batch)
            for row, words in passes(batch.column("text")):
                doc, first, count, anchor = _runs(words, window, gram)
                # hash of a run: its words in order, with its length
                place = np.arange(len(words.hash), dtype=U)
                power = mix(place[: int(count.max()) + window] + U(77)) | U(1) if len(count) else None
                if len(count):
                    length = count + window - 1
                    begin = np.concatenate([[0], np.cumsum(length)[:-1]])
                    inner = np.arange(int(length.sum())) - np.repeat(begin, length)
                    value = words.hash[np.repeat(first, length) + inner] * power[inner]
                    key = mix(np.add.reduceat(value, begin) + length.astype(U))
                else:
                    key = np.empty(0, dtype=U)
                yield pa.record_batch(
                    [
                        pa.array(ids[row + doc], pa.int64()),
                        pa.array(anchor.view(np.int64)),
                        pa.array(key.view(np.int64)),
                        pa.array((versions[row + doc] << 32) + first - words.bound[doc], pa.int64()),
                        pa.array(count.astype(np.int32)),
                    ],
                    schema=schema,
                )

    return of


FOUND = pa.schema([("doc_id", pa.int64()), ("anchor", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("version", pa.int32()), ("first", pa.bool_())])


class _Anchor:
    """One anchor's runs, sorted by (key, doc), as they come; what it holds back is of one document."""

    def __init__(self, limit: int):
        self.limit, self.key, self.docs, self.keys, self.held = limit, None, None, 0, []

    def feed(self, doc, anchor, key, start, windows):
        """Columns of FOUND with whether a row is a run: the runs, once a second document has the anchor, and a mark once the anchor is to be split.

        first: whether a run is the first of its words, the one whose words are sent.
        """
        new = np.concatenate([[self.key is None or key[0] != self.key], key[1:] != key[:-1]])
        least, most = int(doc.min()), int(doc.max())
        self.docs = (least, most) if self.docs is None else (min(least, self.docs[0]), max(most, self.docs[1]))
        self.key = key[-1]
        before, self.keys = self.keys, self.keys + int(new.sum())
        self.held.append((doc, anchor, key, start, windows, new, np.ones(len(doc), dtype=bool)))
        if self.docs[0] < self.docs[1]:
            yield from self.held
            self.held = []
        if before <= self.limit < self.keys:
            yield _marks(anchor[:1])


def _marks(anchors):
    n = len(anchors)
    return np.zeros(n, dtype=np.int64), anchors, np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int32), np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)


def _compare(limit, doc, anchor, key, start, windows):
    """From rows of whole anchors, sorted by (anchor, key, doc), what ``_Anchor.feed`` gives of each."""
    a_new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    k_new = a_new | np.concatenate([[True], key[1:] != key[:-1]])
    begin = np.flatnonzero(a_new)
    keys = np.add.reduceat(k_new.astype(np.int64), begin)
    several = np.minimum.reduceat(doc, begin) < np.maximum.reduceat(doc, begin)
    keep = several[np.cumsum(a_new) - 1]
    yield doc[keep], anchor[keep], key[keep], start[keep], windows[keep], k_new[keep], np.ones(int(keep.sum()), dtype=bool)
    yield _marks(anchor[begin[keys > limit]])


def _shared(limit: int):
    """From runs sorted by (anchor, key, doc): those of anchors that several documents have; no anchor is held as a whole."""
    names = ("doc_id", "anchor", "key", "start", "windows")
    nothing = tuple(np.empty(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.int64, np.int32, bool, bool))

    def of(batches):
        now = state = None
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            cols[3] = cols[3].astype(np.int64)
            anchor = cols[1]
            n = len(anchor)
            if not n:
                continue
            new = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
            head = 0
            parts: list[tuple] = [nothing]
            if state is not None and anchor[0] == now:
                head = int(new[1]) if len(new) > 1 else n
                parts += state.feed(*(c[:head] for c in cols))
            tail = int(new[-1])
            if head < n:
                if head < tail:
                    parts += _several(limit, [c[head:tail] for c in cols])
                now, state = anchor[-1], _Anchor(limit)
                parts += state.feed(*(c[tail:] for c in cols))
            doc, anchors, key, start, windows, first, known = (np.concatenate(c) for c in zip(*parts, strict=True))
            at, version = (start & 0xFFFFFFFF).astype(np.int32), (start >> 32).astype(np.int32)
            yield pa.record_batch([pa.array(doc, pa.int64(), mask=~known), *map(pa.array, (anchors, key, at, windows, version, first))], schema=FOUND)

    return of


def _several(limit, cols):
    anchor = cols[1]
    same = anchor[1:] == anchor[:-1]
    twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    cols = [c[twice] for c in cols]
    return _compare(limit, *cols) if len(cols[0]) else ()


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, sequence: list[int]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is None:
                cur = len(nxt)
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                last = cur
                if p < 0:
                    continue
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                    continue
                link[cur] = self._split(p, c, q)
            else:
                last = self._split(last, c, q)

    def _split(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def matches(self, sequence: list[int]) -> list[int]:
        """For each place, how many words up to it occur in the automaton, as many as do."""
        nxt, link, length = self.next, self.link, self.length
        v = n = 0
        out = []
        for c in sequence:
            to = nxt[v].get(c)
            while to is None and v:
                v = link[v]
                n = length[v]
                to = nxt[v].get(c)
            if to is not None:
                v, n = to, n + 1
            out.append(n)
        return out


def _cut_runs(window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("anchor", pa.int64()), ("part", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("words", pa.binary())])

    def of(batches):
        for batch in batches:
            ids, versions, runs = batch.column("doc_id").to_pylist(), (_version_of(batch) << 32).tolist(), batch.column("runs")
            for row, words in passes(batch.column("text")):
                out: list[list] = [[] for _ in schema]
                content = None
                for i in range(len(words.count)):
                    b = int(words.bound[i])
                    for r in runs[row + i].as_py():
                        at, many = b + r["start"], r["windows"]
                        if not r["split"]:
                            rows = [(ids[row + i], r["anchor"], 0, r["key"], versions[row + i] + r["start"], words.hash[at : at + many + window - 1].tobytes())]
                        else:  # equal windows have equal parts, wherever they are
                            content = words.windows(window).view(np.int64) if content is None else content
                            rows = [(ids[row + i], r["anchor"], int(content[at + j]), 0, versions[row + i] + r["start"] + j, words.hash[at + j : at + j + window].tobytes()) for j in range(many)]
                        for x in rows:
                            for col, y in zip(out, x, strict=True):
                                col.append(y)
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return of


def _streamed(window: int):
    """Spans of covered windows, from runs sorted by (anchor, part, doc_id)."""
    schema = pa.schema([("doc_id", pa.int64()), ("version", pa.int32()), ("start", pa.int32()), ("windows", pa.int32())])

    def of(batches):
        shard_now = doc_now = automaton = None
        waiting: list[list[int]] = []
        known: dict[bytes, list[bool]] = {}  # what runs gave since the automaton last grew
        sent: dict[int, bytes] = {}  # the words of a shard's runs: at most as many as a shard may have
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc_id, anchor, part, key, start, words in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "anchor", "part", "key", "start", "words")), strict=True):
                if (anchor, part) != shard_now:
                    shard_now, doc_now, automaton, waiting, known, sent = (anchor, part), doc_id, Automaton(), [], {}, {}
                if doc_id != doc_now:
                    for w in waiting:
                        automaton.add(w)
                    if waiting:
                        known = {}
                    doc_now, waiting = doc_id, []
                if words is None:
                    words = sent[key]
                elif not part:
                    sent[key] = words
                found = known.get(words)
                if found is None:
                    sequence = np.frombuffer(words, dtype=np.uint64).tolist()
                    found = [n >= window for n in automaton.matches(sequence)[window - 1 :]]
                    if len(known) < 1000:
                        known[words] = found
                begin = None
                for i, hit in enumerate([*found, False]):
                    if hit and begin is None:
                        begin = i
                    elif not hit and begin is not None:
                        for col, x in zip(out, (doc_id, start >> 32, (start & 0xFFFFFFFF) + begin, i - begin), strict=True):
                            col.append(x)
                        begin = None
                if not all(found):
                    waiting.append(np.frombuffer(words, dtype=np.uint64).tolist())
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return of


def kept_words(text: str | None, spans: list[tuple[int, int]], window: int) -> tuple[int, bytes, int]:
    """Number of words, those outside the spans joined by one space, and their number."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    n = len(words)
    if spans:
        gone = np.zeros(n + 1, dtype=np.int32)
        for start, windows in spans:
            gone[min(start, n)] += 1
            gone[min(start + windows + window - 1, n)] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:n]) <= 0).tolist()]
    return n, b" ".join(words), len(words)


def _kept(window: int, with_text: bool):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.large_string())] * with_text
    )

    def of(batches):
        for batch in batches:
            out: list[list] = [[], [], []]
            texts = []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                raw = text.as_py()
                n, joined, left = kept_words(raw, [(x["start"], x["windows"]) for x in spans.as_py() or ()], window)
                for col, x in zip(out, (n, n - left, hashlib.sha256(joined).hexdigest()), strict=True):
                    col.append(x)
                if with_text:
                    texts.append(joined.decode("utf-8", "surrogatepass") if left < n else raw)
            cols = [batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
            yield pa.record_batch(cols + [pa.array(texts, pa.large_string())] * with_text, schema=schema)

    return of


def _versions(docs: DataFrame) -> DataFrame | None:
    """(doc_id, text_key, version) of ids that have several texts, told apart by their hashes, or none where all have one."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key")).where("doc_id is not null")
    several = materialise(keyed.groupBy("doc_id").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b")).where("a <> b").select("doc_id"), "substring-ids")
    if several.isEmpty():
        return None
    number = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("text_key")) - 1
    return materialise(keyed.join(several, "doc_id", "left_semi").distinct().withColumn("version", number.cast("int")), "substring-versions")


def _own(docs: DataFrame, versions: DataFrame | None) -> DataFrame:
    """(doc_id, text), with the version of each text where some id has several, so that a span is of one text."""
    text = F.col("text").cast("string").alias("text")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    if versions is None:
        return own
    both = own.withColumn("text_key", F.xxhash64("text")).join(versions, ["doc_id", "text_key"], "left")
    return both.select("doc_id", F.coalesce("version", F.lit(0)).alias("version"), "text")


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, runs_a_shard: int = RUNS_A_SHARD, own: DataFrame | None = None) -> DataFrame:
    """(doc_id[, version], spans): runs of windows (first word, number) of each text that start in a smaller id; others have no row. own: ``_own`` of docs, if it is there."""
    own = _own(docs, _versions(docs)) if own is None else own
    keys = [c for c in own.columns if c != "text"]
    runs = own.where("doc_id is not null").mapInArrow(_anchors(window, gram), "doc_id long, anchor long, key long, start long, windows int")
    found = materialise(
        runs.repartition("anchor").sortWithinPartitions("anchor", "key", "doc_id", "start").mapInArrow(_shared(runs_a_shard), "doc_id long, anchor long, key long, start int, windows int, version int, first boolean"),
        "substring-runs",
    )
    # at most one anchor for each runs_a_shard runs
    split = found.where("doc_id is null").select("anchor", F.lit(True).alias("split"))
    shared = found.where("doc_id is not null").join(F.broadcast(split), "anchor", "left").withColumn("split", F.coalesce("split", F.lit(False)))
    runs_of = shared.where("first or split").groupBy(*keys).agg(F.collect_list(F.struct("anchor", "key", "start", "windows", "split")).alias("runs"))
    # words travel once for all equal runs of a shard; the others ask with the hash of theirs
    place = (F.shiftleft(F.col("version").cast("long"), 32) + F.col("start")).alias("start")
    asking = shared.where("not first and not split").select("doc_id", "anchor", F.lit(0).cast("long").alias("part"), "key", place, F.lit(None).cast("binary").alias("words"))
    judged = (
        own.join(runs_of, keys)
        .mapInArrow(_cut_runs(window), "doc_id long, anchor long, part long, key long, start long, words binary")
        .unionByName(asking)
        .repartition("anchor", "part")
        .sortWithinPartitions("anchor", "part", "doc_id", "start")
        .mapInArrow(_streamed(window), "doc_id long, version int, start int, windows int")
    )
    return judged.groupBy(*keys).agg(F.collect_list(F.struct("start", "windows")).alias("spans"))


def deduplicate(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) for every row of ``docs`` (doc_id, text).

    kept (left out where not asked for) is the text itself where nothing goes, else the kept words joined by one space; null stays null. A row of a null id
    is returned whole and is no one's earlier copy. Rows of one id never remove from each other, and each keeps what its own text says. Texts of any length
    are read whole; an empty table gives no rows.
    """
    own = _own(docs, _versions(docs))
    keys = [c for c in own.columns if c != "text"]
    return own.join(repeated_spans(docs, window, gram, own=own), keys, "left").select("doc_id", "text", "spans").mapInArrow(
        _kept(window, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    )


def cut(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with repeated spans cut out of ``text``; rows and other columns as they were."""
    versions = _versions(docs)
    spans = repeated_spans(docs, window, gram, own=_own(docs, versions))
    if versions is None:
        spans = spans.select(F.col("doc_id").alias("_id"), F.col("spans").alias("_spans"))
    else:
        spans = spans.join(versions, ["doc_id", "version"], "left").select(F.col("doc_id").alias("_id"), F.col("spans").alias("_spans"), F.col("text_key").alias("_key"))
    same = docs["doc_id"].cast("long") == spans["_id"]
    if versions is not None:
        same &= spans["_key"].isNull() | (spans["_key"] == F.xxhash64(docs["text"].cast("string")))
    both = docs.join(spans, same, "left")

    @F.pandas_udf("string")
    def without(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else kept_words(t, [(x["start"], x["windows"]) for x in s], window)[1].decode() for t, s in zip(text, spans, strict=True)], dtype="object")

    text = F.when(F.col("_spans").isNull(), docs["text"].cast("string")).otherwise(without(docs["text"].cast("string"), F.col("_spans")))
    return both.select(*[text.alias(c) if c == "text" else docs[f"`{c}`"] for c in docs.columns])
