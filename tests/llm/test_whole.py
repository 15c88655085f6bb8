"""Cases in which the numbered operators once did less than the whole job."""

import collections
import functools
import random
import textwrap

from test_numbered import brute_dedup, corpus

from citetrace.llm import decontaminate, licences, substrings, warc

SCHEMA = "doc_id long, text string"


def prose(rng, n, words=4000):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def with_items(rng, n, items, each):
    """n documents, and the pairs that they hold: every each-th has the first item, some others another one."""
    docs, want = [], set()
    for i in range(n):
        t = prose(rng, 120).split(" ")
        k = 0 if i % each == 0 else i % len(items) if i % 7 == 1 else None
        if k is not None:
            t[50:50] = items[k][1].split()
            want.add((i, items[k][0]))
        docs.append((i, " ".join(t)))
    return docs, want


def test_leaks_of_an_item_in_a_third_of_the_documents(spark):
    rng = random.Random(4)
    items = [(k, prose(rng, 35) + ".") for k in range(10)]
    docs, want = with_items(rng, 240, items, 3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, SCHEMA)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()} == want
    assert {r.doc_id for r in decontaminate.keep_clean(df, bench).collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_leaks_in_five_documents(spark):
    rng = random.Random(8)
    items = [(k, prose(rng, 35) + ".") for k in range(10)]
    docs, want = with_items(rng, 5, items, 4)
    got = decontaminate.leaks(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert want and {(r.doc_id, r.item_id) for r in got} == want


def passage_everywhere(n, few=4):
    """n documents that all hold one passage, each between words of its own or of a few documents."""
    rng = random.Random(12)
    passage = prose(rng, 25)
    return [(i, f"{prose(rng, 3, 1000000)} {prose(rng, 14, few if i % 3 else 1000000)} {passage} {prose(rng, 14, few if i % 3 else 1000000)}") for i in range(n)]


def removed(got):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got}


def test_no_automaton_grows_with_the_documents(spark, monkeypatch):
    rows = passage_everywhere(1500)
    df = spark.createDataFrame(rows, SCHEMA)
    assert removed(substrings.deduplicate(df).collect()) == brute_dedup(rows)

    def sizes(window):
        def of(batches):
            import pyarrow as pa

            made, plain = [], substrings.Automaton

            class Seen(plain):
                def __init__(self):
                    super().__init__()
                    made.append(self)

            substrings.Automaton = Seen
            for _ in substrings._streamed(window)(batches):  # in the workers nothing is replaced
                pass
            substrings.Automaton = plain
            most = max((len(a.next) for a in made), default=0)
            yield pa.record_batch([pa.array([most], pa.int64()), *[pa.array([0], pa.int32())] * 3], names=["doc_id", "version", "start", "windows"])

        return of

    own = spark.createDataFrame([(-1 - i, t) for i, t in passage_everywhere(1500, few=1000000)], SCHEMA)
    monkeypatch.setattr(substrings, "_streamed", sizes)
    assert 0 < max(r.doc_id for r in substrings.repeated_spans(own).collect()) < 500


def test_split_shards_give_the_same_rows(spark, monkeypatch):
    rows = corpus(0) + [(1000 + i, t) for i, t in passage_everywhere(150)]
    monkeypatch.setattr(substrings, "repeated_spans", functools.partial(substrings.repeated_spans, runs_a_shard=2))
    assert removed(substrings.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()) == brute_dedup(rows)


def test_an_anchor_that_comes_in_pieces():
    import pyarrow as pa

    rng = random.Random(3)
    rows = sorted((rng.choice([1, 2, 2, 2, 3, 4]), rng.randrange(3), rng.randrange(4), j, 1) for j in range(60))
    rows += [(7, 5, 1, 60, 1), (7, 5, 1, 61, 1), (7, 6, 1, 62, 1), (8, 1, 1, 63, 1), (8, 1, 2, 64, 1), (9, 1, 5, 65, 1)]
    rows = [(d, a, k, s, w) for a, k, d, s, w in rows]
    names = ["doc_id", "anchor", "key", "start", "windows"]

    def found(size):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.record_batch([pa.array(c, pa.int32() if n in ("start", "windows") else pa.int64()) for n, c in zip(names, zip(*p, strict=True), strict=True)], names=names) for p in parts]
        return sorted((x for b in substrings._shared(2)(batches) for x in map(tuple, (r.values() for r in b.to_pylist()))), key=str)

    want = []
    for a in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == a]
        if len({r[0] for r in own}) > 1:
            least = {}
            for d, _, k, s, _ in own:
                least[k] = min((d, s), least.get(k, (d, s)))
            want += [(d, a, k, s, w, 0, (d, s) == least[k]) for d, _, k, s, w in own]
        want += [(None, a, 0, 0, 0, 0, False)] * (len({r[2] for r in own}) > 2)
    for size in (1, 2, 7, 1000):
        assert found(size) == sorted(want, key=str)


def test_licence_sentences_wrapped_at_any_width(spark):
    asked = [(i, width, mark) for i, _ in licences.SENTENCES for width in (1, 20, 40, 60, 72, 76, 80) for mark in ("", "# ", " * ")]
    text = dict(licences.SENTENCES)
    rows = [(n, "Some words before\n" + textwrap.fill(text[i] + ".", width + len(mark), initial_indent=mark, subsequent_indent=mark, break_on_hyphens=False, break_long_words=False) + "\nand after") for n, (i, width, mark) in enumerate(asked)]
    rows += [(-1, "MIT License\nCopyright (c) 2020 A\n\n" + textwrap.fill(text["mit-grant"] + ":", 76) + "\n\n" + textwrap.fill(text["mit-condition"] + ".", 76) + "\r\n\r\n" + textwrap.fill(text["as-is"], 76))]
    rows += [(-2, textwrap.fill("he said that " + text["gpl-free"], 76)), (-3, textwrap.fill(text["gpl-free"] + " or so", 76))]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[-1].sentence_ids == ["mit-title", "mit-grant", "mit-condition", "as-is"] and got[-1].licences == ["MIT"]
    assert got[-2].sentence_ids == got[-3].sentence_ids == []
    for n, (i, width, mark) in enumerate(asked):
        assert i in got[n].sentence_ids, (i, width, mark)


def test_repeated_pages_stay_rows(spark, tmp_path):
    big = "<p>" + "a page " * 30 + "</p>"
    rows = [(1, "http://a.example/", big)] * 3 + [(2, "http://b.example/", big)] * 2 + [(3, None, "small")] * 2 + [(None, "http://c.example/", big)] * 2
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/w").collect()
    assert collections.Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got) == {
        (1, "response", None, len(big)): 3, (2, "revisit", 1, len(big)): 2, (3, "response", None, 5): 2, (None, "response", None, len(big)): 2
    }
    assert all(r.capture.request.record_id and r.capture.metadata.page_id == r.page_id for r in got)
    assert len({r.capture.response.record_id for r in got}) == len(rows)
