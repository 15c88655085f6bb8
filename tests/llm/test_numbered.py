"""The numbered operators against plain versions, with nulls, empty texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import gzip
import functools
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from citetrace.llm import decontaminate, html_extract, licences, ngram_join, packing, quality, sharding, substrings, toxicity, warc
from citetrace.llm.words import passes

SCHEMA = "doc_id long, text string"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}{rng.choice(['', '.', ',', 'é'])}" for _ in range(n))


def corpus(seed=0, size=60):
    """Documents with exact and near copies, shared passages, nulls, blanks, short and long texts."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(1, 150), 3000) for _ in range(size)]
    shared = prose(rng, 30, 3000)
    docs = []
    for t in base:
        docs.append(t)
        if rng.random() < 0.3:
            w = t.split(" ")
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = "changed"
            docs.append(" ".join(w))
        if rng.random() < 0.2:
            docs += [t, t.upper(), f"{t[:40]} {shared} {t[40:]}"]
    hub = prose(rng, 120, 3000).split(" ")
    for i in range(25):
        docs.append(" ".join(["edit" + str(i) if j == (7 * i) % 120 else w for j, w in enumerate(hub)]))
    docs += [None, "", "  \n\t", "one", "one two three", "one two three", "a b c d e", "x " * 400, prose(rng, 3000, 50)]
    return list(enumerate(docs, 10))


def words(t):
    return SPLIT.findall(t or "")


def test_word_hashes_tell_words_apart():
    import pyarrow as pa

    texts = ["a b\x0bc\x0cd", None, "", " é  ü\n", "A a", "tail"]
    got = []
    for _, w in passes(pa.array(texts)):
        got += [w.data[s:e].tobytes().decode() for s, e in zip(w.start, w.end, strict=True)]
        assert w.count.tolist() == [4, 0, 0, 2, 2, 1]
        assert len(set(w.hash.tolist())) == 9 - 1  # a twice
    assert got == [x for t in texts for x in words(t)]
    lower = next(iter(passes(pa.array(["ABC É", "abc é"]), lower=True)))[1]
    assert lower.hash[0] == lower.hash[2] and lower.hash[1] != lower.hash[3]


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(LOWER))
        sets[i] = ({tuple(w)} if w else set()) if len(w) < 5 else {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("tile", [512, 8])
def test_ngram_join(spark, tile):
    rows = corpus()
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, SCHEMA), tile=tile).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows) and len(got) == len(rows)


def test_ngram_join_odd_rows(spark):
    text = "p q r s t u v"
    rows = [(1, text), (1, text), (None, text), (2, text), (3, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("component_id", F.lit("x")).withColumn("col", F.lit(1))
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.jaccard_join(df).collect()), key=str)
    assert got == [(1, 1), (1, 1), (2, 1), (3, 3), (None, None)]
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "3", "None"]
    assert ngram_join.jaccard_join(df.limit(0)).count() == 0


def test_ngram_join_of_ids_with_different_texts(spark):
    """Rows of one id with different texts have the links of their own texts."""
    rng = random.Random(8)
    a, b, c = (prose(rng, 60, 3000) for _ in range(3))
    for rows in ([(5, a), (5, b), (7, b + " more"), (8, a + " more"), (9, c)], [(5, b), (5, a), (8, a + " more"), (7, b + " more"), (9, c)]):
        df = spark.createDataFrame(rows, SCHEMA)
        got = sorted((r.doc_id, r.component_id) for r in ngram_join.jaccard_join(df).collect())
        assert got == [(5, 5), (5, 5), (7, 5), (8, 5), (9, 9)]
        assert sorted(tuple(r) for r in ngram_join.keep_one(df).collect()) == sorted([(5, a), (5, b), (9, c)])
    rows = [(5, a), (5, b), (3, b + " more")]  # one of the texts has an earlier copy: only that row goes
    assert sorted(tuple(r) for r in ngram_join.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()) == sorted([(5, a), (3, b + " more")])


@pytest.mark.parametrize("runs_a_shard", [1000, 2])
def test_substring_dedup_of_ids_with_different_texts(spark, runs_a_shard, monkeypatch):
    """Spans of one text are not applied to another of its id, with and without split anchors."""
    monkeypatch.setattr(substrings, "repeated_spans", functools.partial(substrings.repeated_spans, runs_a_shard=runs_a_shard))
    rng = random.Random(6)
    shared, other = prose(rng, 40, 3000), prose(rng, 30, 3000)
    texts = [(1, f"{prose(rng, 20, 3000)} {shared}"), (5, f"{shared} {prose(rng, 70, 3000)}"), (5, f"{prose(rng, 90, 3000)} {other} {shared}"), (5, "short"), (6, f"{other} {shared}"), (6, prose(rng, 15, 3000)), (None, shared), (7, shared), (7, shared), (8, None), (8, other)]
    texts += [(20 + i, f"{shared[i:]} {other}") for i in range(6)]
    seen, want = [], []
    for i, t in sorted(texts, key=lambda x: (x[0] is None, x[0] or 0)):
        w = words(t)
        earlier = {k for j, keys in seen if i is not None and j < i for k in keys}
        keys = [tuple(w[j : j + 13]) for j in range(len(w) - 12)]
        gone = {q for j, k in enumerate(keys) if k in earlier for q in range(j, j + 13)}
        if i is not None:
            seen.append((i, keys))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept if gone else t))
    df = spark.createDataFrame(texts, SCHEMA)
    got = [tuple(r) for r in substrings.deduplicate(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sorted((tuple(r) for r in substrings.cut(df).collect()), key=str) == sorted(((w[0], w[4]) for w in want), key=str)


def brute_dedup(rows, window=13):
    seen, out = {}, {}
    for i, t in sorted(rows):
        w = words(t)
        keys = [tuple(w[j : j + window]) for j in range(len(w) - window + 1)]
        gone = {q for j, k in enumerate(keys) if seen.get(k, i) < i for q in range(j, j + window)}
        for k in keys:
            seen.setdefault(k, i)
        kept = [x for j, x in enumerate(w) if j not in gone]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_substring_dedup(spark, seed):
    rows = corpus(seed)
    got = substrings.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_dedup(rows) and len(got) == len(rows)


def test_substring_dedup_odd_rows(spark):
    t = " ".join(f"v{i}" for i in range(20))
    df = spark.createDataFrame([(2, t, "a", 1), (2, t, "b", 1), (None, t, "c", 1), (5, f"x {t} y", "d", 1)], "doc_id long, text string, spans string, _id int")
    got = {r.spans: r.text for r in substrings.cut(df).collect()}
    assert got == {"a": t, "b": t, "c": t, "d": "x y"} and substrings.cut(df).columns == df.columns
    assert substrings.deduplicate(df.limit(0)).count() == 0


def test_suffix_automaton():
    rng = random.Random(5)
    for _ in range(40):
        known = [[rng.randrange(4) for _ in range(rng.randrange(1, 25))] for _ in range(3)]
        a = substrings.Automaton()
        for k in known:
            a.add(k)
        q = [rng.randrange(4) for _ in range(30)]
        parts = {tuple(k[i:j]) for k in known for i in range(len(k)) for j in range(i + 1, len(k) + 1)}
        assert a.matches(q) == [max((n for n in range(1, e + 2) if tuple(q[e + 1 - n : e + 1]) in parts), default=0) for e in range(len(q))]


def test_packing(spark):
    from tokenizers import Tokenizer

    rows = corpus(3, 40) + [(900, "word " * 9000), (901, "It's <|endoftext|> ÀÉ ẞ ² 12 a\x1cb")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = packing.pack(df, block=30).collect()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    pieces, bins, total = collections.defaultdict(list), collections.defaultdict(list), 0
    for r in got:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        bins[r.sequence_id].append(r)
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        want = [(n, s, len(ids[s : s + 4096]), zlib.crc32(struct.pack(f"<{len(ids[s : s + 4096])}I", *ids[s : s + 4096]))) for n, s in enumerate(range(0, len(ids), 4096))]
        assert sorted(pieces[i]) == want
    for b in bins.values():
        b.sort(key=lambda r: r.offset)
        assert [r.offset for r in b] == np.cumsum([0, *[r.length for r in b]])[:-1].tolist() and sum(r.length for r in b) <= 4096
    assert len(bins) <= -(-total // 4096) + 2
    assert packing.pack(df.limit(0)).count() == 0
    withheld = packing.pieces(df, with_ids=True).where("doc_id = 900").collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in withheld)


def test_genetic_steps_never_lose_items():
    rng = random.Random(1)
    for seed in range(5):
        size = [rng.randrange(1, 90) for _ in range(120)]
        first = packing.evolve(size, 100, seed, [], 0, 1)
        best = packing.evolve(size, 100, seed, [first], 12, 4)
        for bins in (first, best):
            fill = collections.Counter()
            for s, b in zip(size, bins, strict=True):
                fill[b] += s
            assert len(bins) == 120 and max(fill.values()) <= 100
        assert len(set(best)) <= len(set(first))


def test_licences(spark):
    s = dict(licences.SENTENCES)
    rows = [
        (1, f"foo. {s['ccbync-licensed']}. bar"),
        (2, ". ".join([s["mit-grant"] + ":", s["mit-condition"], s["as-is"]])),
        (3, None),
        (4, ". ".join([s["bsd-source"], s["bsd-redistribution"], s["bsd-binary"]])),
        (5, f"x\n{s['apache-licensed'].upper()}.\ny"),
        (5, f"{s['gpl3-work']}. {s['mit-released']}."),
        (6, "a licence, but none of these"),
    ]
    got = sorted((r.doc_id, tuple(r.licences)) for r in licences.scan(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, ("CC-BY-NC-4.0",)), (2, ("MIT",)), (3, ()), (4, ()), (5, ("Apache-2.0",)), (5, ("GPL-3.0-only", "MIT")), (6, ())]


@pytest.mark.parametrize("hot", [False, True])
def test_sharding(spark, hot):
    rows = corpus(2, 200) + ([(5000 + i, "the same text") for i in range(900)] if hot else []) + [(None, "n"), (7, "r"), (7, "r")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("shard", F.lit("s")).withColumn("h", F.lit(0))
    got = sharding.shard(df).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"}
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    assert set(by) == set(range(8)) and all(abs(sum(r["size"] for r in p) - total / 8) <= largest + 0.01 * total for p in by.values())
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert sharding.shard(df.limit(0)).count() == 0


def test_toxicity(spark):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(400):
        bad = rng.random() < 0.3
        text = prose(rng, 60, 500)
        if bad:
            text += " " + " ".join(rng.sample(["vile", "scum", "horrid", "nasty", "rotten"], 2))
        rows.append((i, text))
        marks.append((i, 9, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "scum " * 3000), (None, "vile")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("toxic", F.lit("x"))
    labels = spark.createDataFrame([*marks, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert len(got) == len(rows)
    out = [(got[i].predicted, y) for i, _, y in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(out) > 40 and np.mean([a == b for a, b in out]) > 0.95
    assert got[1000].score == got[1001].score < 0.5 <= got[1002].score and got[None].predicted == 1
    assert toxicity.score(docs, labels.limit(0)).where("score <> 0").count() == 0


def test_quality_rules(spark):
    rng = random.Random(3)
    junk = [" ".join("$$$ ### |".split() * 40), "again and again\n" * 60, " ".join(["the of and"] * 100), None, "", "\n\n"]
    clean = [" ".join(rng.choice(["the", "of", *(f"word{rng.randrange(9999)}" for _ in range(6))]) for _ in range(200)) for _ in range(5)]
    rows = list(enumerate(junk + clean)) + [(50, "ab\nab\n ab\n" + clean[0]), (51, "x y")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_words", F.lit("clash"))
    for r in quality.quality_rules(df).collect():
        t = rows[[i for i, _ in rows].index(r.doc_id)][1] or ""
        w = words(t)
        grams = collections.Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        again = {j + o for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for o in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w))
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {*range(6, 11), 50}


def test_leaks(spark):
    rng = random.Random(11)
    items = [(k, prose(rng, 40, 4000) + ".\n" + prose(rng, 8, 4000)) for k in range(30)]
    docs, want = [], set()
    for i in range(300):
        t = prose(rng, 150, 4000).split(" ")
        if i % 5 == 0:
            k = rng.randrange(30)
            part = [x if rng.random() > 0.15 else "else" for x in items[k][1].split()]
            t[60:60] = part
            want.add((i, k))
        docs.append((i, " ".join(t)))
    docs += [(900, None), (901, ""), (902, "short")]
    df = spark.createDataFrame(docs, SCHEMA).withColumn("id", F.lit("x")).withColumn("_id", F.lit(1))
    bench = spark.createDataFrame([*items, (77, None), (78, " "), (None, "z")], "item_id long, text string")
    for block in (2000, 13):
        got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench, items_a_pass=block).collect()}
        assert got <= want and len(got) >= 0.9 * len(want)
    clean = decontaminate.keep_clean(df, bench)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - {i for i, _ in got}
    assert decontaminate.leaks(df, bench.limit(0)).count() == 0 and decontaminate.leaks(df.limit(0), bench).count() == 0


def test_warc(spark, tmp_path):
    big = "<p>" + "long page é\r\n\r\nWARC/1.1 " * 20 + "</p>"
    rows = [(1, "http://a.example/x?y#z", big), (2, "http://b.example", big), (3, None, big), (4, "http://c.example/", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "bad\r\nurl", big + "!"), (8, "bad\r\nurl", big + "!"), (None, "n", "x" * 200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("d"))
    path = f"file://{tmp_path}/w"
    got = {r.page_id: r for r in warc.round_trip(df, path, with_payload=True).collect()}
    first = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        again = first.setdefault(raw, i) if len(raw) >= 100 and i is not None else i
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if again == i else ("revisit", again))
        if r.record_type == "response":
            assert r.capture.response.payload == (h or "")
        assert r.capture.metadata.page_id == i and r.capture.request.record_id
    assert len(got) == 9 and got[8].url == "badurl"
    for p in (tmp_path / "w").glob("*.gz"):
        assert all(h["warc-type"] in ("request", "response", "revisit", "metadata") for h, _ in warc.parse([gzip.open(p).read()]))
    assert warc.round_trip(df.limit(0), f"file://{tmp_path}/e").count() == 0


def test_html(spark):
    page = (
        '<html><head><title>no</title><style>p{}</style></head><body><nav><a href="/">menu</a></nav><div class="cookie-notice"><p>We use cookies. Please accept them all.</p></div>'
        "<article><h1>Head &amp; line</h1><p>First  para\n graph &eacute;&#8217;s.<p>Second <b>bold</b> one, with more to say.<script>var a='<p>no</p>'</script><!-- <p>no</p> --></article>"
        '<div class="comments"><p>I am a reader. I say things.</p></div><form><p>Sign up</p></form><footer>&copy; x</footer></body></html>'
    )
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", "<article><p>unclosed text that goes on"), (5, "u", "<<>><b <p"), (None, "u", page)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in html_extract.extract_text(df).collect()}
    assert got[1].text == "Head & line First para graph é’s. Second bold one, with more to say." == got[None].text
    assert got[2].text == got[3].text == "" and got[4].text == "unclosed text that goes on"
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_extract.extract_text(df.limit(0)).count() == 0


def test_messages_give_exact_marginals():
    import itertools

    rng = random.Random(2)
    for _ in range(20):
        n = 6
        parent = [-1, *[rng.randrange(i) for i in range(1, n)]]
        kinds, unary = [rng.randrange(2) for _ in range(n)], [rng.uniform(-2, 2) for _ in range(n)]
        pot = [[[2.0, 0.5], [0.5, 2.0]], [[1.2, 0.9], [0.9, 1.2]]]
        weight = {
            y: np.exp(sum(u for u, v in zip(unary, y, strict=True) if v)) * np.prod([pot[kinds[i]][y[parent[i]]][y[i]] for i in range(1, n)]) for y in itertools.product((0, 1), repeat=n)
        }
        total = sum(weight.values())
        got, same = html_extract.sum_product(parent, kinds, unary, pot)
        for i in range(n):
            assert abs(got[i] - sum(w for y, w in weight.items() if y[i]) / total) < 1e-9
            if i:
                assert abs(same[i] - sum(w for y, w in weight.items() if y[i] == y[parent[i]]) / total) < 1e-9


def test_held_out_layouts():
    from citetrace.llm.html_pages import labelled_pages

    model = html_extract.train()
    right = wrong = missed = 0
    for page in labelled_pages(3, seed=77):
        want = collections.Counter(re.sub(r"<[^>]*>", " ", " ".join(re.findall(r"\[\[(.*?)\]\]", page, re.S))).split())
        have = collections.Counter(model.extract(page.replace("[[", "").replace("]]", "")).split())
        both = sum((want & have).values())
        right, wrong, missed = right + both, wrong + sum(have.values()) - both, missed + sum(want.values()) - both
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.95
