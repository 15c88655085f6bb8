"""Operators 11 to 13 against plain versions, and their odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from citetrace.llm import exact_search, fill_middle, lexical_search, queries

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- lexical search ---------------------------------------------------------------------------------------


def plain_search(docs, items, k=50):
    bags = [(d, TERM.findall((t or "").translate(LOWER))) for d, t in docs]
    bags = [(d, Counter(w), len(w)) for d, w in bags if w]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, w, _ in bags for t in w)
    out = []
    for item, text in items:
        scored = []
        for d, w, n in bags:
            m, score = 100 - 50 + 50 * n * n_docs // n_terms, 0
            for t in set(TERM.findall((text or "").translate(LOWER))):
                if t in w:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * w[t] // (1000 * w[t] + 20 * m))
            if score > 0:
                scored.append((-score, d is None, d))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(scored[:k], 1)]
    return Counter(out)


def texts(rnd, n, words):
    return [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["Été", "É", "x y", "A1", "a1", "日本", "ś", "😀z"]
    docs = list(enumerate(texts(rnd, 300, words)))
    docs += [(300, None), (301, ""), (302, " .,;\x00"), (303, docs[0][1]), (0, docs[1][1]), (0, docs[1][1]), (None, docs[2][1]), (304, "w1 " * 50_000), (305, "a-b_c\x7fd{e}w1")]
    items = list(enumerate(texts(rnd, 30, words)))
    items += [(30, None), (31, "!?"), (32, items[0][1]), (3, items[5][1]), (None, "w1 w2"), (33, "nothing held"), (34, "W1 w1 É é")]
    return docs, items


def test_lexical_search_against_plain(spark, corpus):
    docs, items = corpus
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("terms", F.lit("x")).repartition(7)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit(1))
    got = lexical_search.search(d, i)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == plain_search(docs, items)


def test_lexical_search_in_small_blocks(spark, corpus, monkeypatch):
    """Blocks of items, of documents and of text change no row."""
    docs, items = corpus
    for name, value in (("ITEMS", 7), ("CELLS", 5_000), ("PASS_BYTES", 300), ("MINED", 5)):
        monkeypatch.setattr(lexical_search, name, value)
    got = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 9)
    assert Counter(map(tuple, got.collect())) == plain_search(docs, items, 9)


def test_lexical_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search.search(none, one).count() == 0
    assert lexical_search.search(one.withColumnRenamed("item_id", "doc_id"), none.withColumnRenamed("doc_id", "item_id")).count() == 0
    blank = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert lexical_search.search(blank, one).count() == 0


def test_sharing_makes_each_item_of_its_terms_once():
    rnd = random.Random(9)
    items = [rnd.sample([f"t{i}" for i in range(60)], rnd.randrange(1, 40)) for _ in range(80)]
    g = lexical_search.Sharing(items)
    holds = {n: set() for n in range(g.leaves)}
    for t, n in g.leaf.items():
        holds[n].add(t)
    for n, (a, b) in enumerate(g.pairs, g.leaves):
        assert a < n and b < n and not holds[a] & holds[b]
        holds[n] = holds[a] | holds[b]
    for words, nodes in zip(items, g.items):
        assert sum(len(holds[n]) for n in nodes) == len(words) and set().union(*(holds[n] for n in nodes)) == set(words)
    apart = sum(len({g.leaf[w] for w in words}) - 1 for words in items)
    assert g.additions() < 0.8 * apart


# --- fill in the middle -----------------------------------------------------------------------------------


def plain_fill(doc_id, text):
    t, digest = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(t)
    a, z = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or h[2] % 100 >= 90:
        form, a, z, out = "plain", None, None, t
    elif h[3] % 100 < 20:
        form, out = "spm", f"<S>{t[z:]}<P>{t[:a]}<M>{t[a:z]}"
    else:
        form, out = "psm", f"<P>{t[:a]}<S>{t[z:]}<M>{t[a:z]}"
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, n, form, a, None if form == "plain" else z - a, sha(out), sha(t)


def test_fill_in_middle_against_plain(spark, tmp_path):
    rnd = random.Random(3)
    odd = ["", None, "<", "<P", "<P>", "a<S>b", "<M>", "$1\\$2\\", "<<S", "\n\r\n", "😀", "😀é x\u0085", "<p> < P>", "é", "\x00a"]
    rows = [(i, "".join(rnd.choice("ab<PSM>\n 😀é$\\") for _ in range(rnd.randrange(0, 40)))) for i in range(800)]
    rows += [(900 + i, t) for i, t in enumerate(odd * 12)] + [(5, "again"), (5, "again"), (None, "no id"), (-7, "below")]
    rows += [(2000 + i, ("😀é\n<x" * 90_000)[: 100_000 * i + 1023 + i]) for i in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("own")).withColumn("_T", F.lit(0)).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_fill_in_middle(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(plain_fill(*r) for r in rows)
    forms = Counter(r.form for r in got.collect())
    assert min(forms.values()) > 50


def test_fill_in_middle_is_one_projection(spark):
    none = spark.createDataFrame([], "doc_id long, text string, extra array<int>")
    out = fill_middle.transform(none)
    assert out.columns == ["doc_id", "text", "extra", "n", "form", "prefix_chars", "middle_chars", "output"] and out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


# --- exact search -----------------------------------------------------------------------------------------


def plain_nearest(rows, k, every, scale=1024):
    kept = []
    for vec_id, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(scale * x) for x in v]))
    out = []
    for n, (q, v) in enumerate(kept):
        if q is None or q % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), c is None, c or 0, c) for m, (c, w) in enumerate(kept) if m != n]
        scored.sort(key=lambda x: x[:3])
        out += [(q, r, x[3], -x[0]) for r, x in enumerate(scored[:k], 1)]
    return Counter(out)


def found(spark, rows, k, every):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(0)).withColumn("v", F.lit("x"))
    return Counter(map(tuple, exact_search.search(df, k=k, every=every).collect()))


def vectors(n, dim, seed, groups=6):
    rnd = np.random.default_rng(seed)
    middle = rnd.normal(size=(groups, dim))
    return [(i, [float(x) for x in middle[rnd.integers(groups)] + 0.2 * rnd.normal(size=dim)]) for i in range(n)]


@pytest.mark.parametrize("k", [1, 10])
def test_exact_search_against_plain(spark, monkeypatch, k):
    for name, value in (("BLOCK", 16), ("SHARD", 3), ("BATCH", 20), ("CELLS", 8)):
        monkeypatch.setattr(exact_search, name, value)
    rows = vectors(700, 9, k)
    same = rows[3][1]
    rows += [(700 + i, same) for i in range(150)]  # one vector of very many rows: ties by id
    rows += [(10, rows[0][1]), (10, rows[0][1]), (None, same), (None, rows[0][1]), (900, None), (910, [1.0, None]), (920, [float("nan")] * 9), (930, [float("inf")] * 9), (940, []), (950, [0.0] * 9)]
    rows += [(960, [1.0, -1.0]), (970, [-0.5] * 9), (980, [2.0] * 12), (-20, rows[1][1])]
    assert found(spark, rows, k, 10) == plain_nearest(rows, k, 10)


def test_exact_search_of_few_rows(spark):
    assert not found(spark, [], 10, 100)
    assert not found(spark, [(0, [1.0])], 10, 100)
    rows = [(0, [1.0, 2.0]), (1, [-3.0, 0.5]), (100, [0.1, 0.1])]
    assert found(spark, rows, 10, 100) == plain_nearest(rows, 10, 100)
    large = [(0, [3e5, 2e6]), (1, [-4e5, 1e6]), (2, [2.5e5, 1e3]), (3, [1e-9, 4e6])]  # products beyond doubles
    assert found(spark, large, 2, 1) == plain_nearest(large, 2, 1)
    with pytest.raises(Exception, match="OverflowError|too large"):
        found(spark, [(0, [1e9]), (1, [1e9])], 2, 1)


def test_exact_search_leaves_blocks_out(monkeypatch):
    """By falling bound, most blocks of like rows are never scored."""
    rnd = np.random.default_rng(2)
    middle = rnd.normal(size=(16, 12)) * 600
    m = np.concatenate([(c + 40 * rnd.normal(size=(32, 12))).astype(np.int64) for c in middle])
    high, low = (np.concatenate([getattr(m[i : i + 32], f)(axis=0) for i in range(0, 512, 32)]) for f in ("max", "min"))
    row = {"query": np.array([0]), "q_dim": 12, "v": m[5], "floor": np.array([-exact_search.NO_ID]), "dim": 12, "first": 100, "sizes": np.full(16, 32), "ids": np.arange(512), "cells": m.ravel(), "high": high, "low": low}
    scored = []
    whole = exact_search._product
    monkeypatch.setattr(exact_search, "_product", lambda a, b: scored.append(len(b)) or whole(a, b))
    out = exact_search._meet(row, 10).to_pydict()
    assert sum(scored) <= 128
    order = sorted(range(512), key=lambda i: (-int(m[i] @ m[5]), i))[:10]
    assert out["vec_id"] == order and out["score"] == [int(m[i] @ m[5]) for i in order]
