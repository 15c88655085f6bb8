"""Benchmark leaks: parts against plain versions, independence of blocks, large vocabularies, odd rows."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from citetrace.llm import decontaminate
from citetrace.llm.words import passes

SCHEMA = "doc_id long, text string"
ITEMS = "item_id long, text string"


def prose(rng, n, words=4000):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def plain_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        out = [0]
        for j, y in enumerate(b):
            out.append(row[j] + 1 if x == y else max(row[j + 1], out[j]))
        row = out
    return row[-1]


def test_subsequence_against_the_plain_table():
    rng = random.Random(1)
    for _ in range(200):
        own = [rng.randrange(6) for _ in range(rng.randrange(1, 90))]
        other = [rng.randrange(6) for _ in range(rng.randrange(0, 90))]
        masks = [sum(1 << k for k, x in enumerate(own) if x == y) for y in range(6)]
        assert decontaminate.subsequence(masks, len(own), other) == plain_subsequence(own, other)


def test_vocabulary_of_any_size():
    rng = np.random.default_rng(3)
    for n in (1, 2, 300, 24_000, 100_000):
        hashes = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        hashes[: n // 3] |= np.uint64(0xFFFF << 48)  # many that share their upper bits
        v = decontaminate.Vocabulary(hashes)
        known = np.unique(hashes)
        assert len(v) == len(known) and (v.places(known) == np.arange(len(known))).all()
        other = np.setdiff1d(rng.integers(0, 1 << 64, 5000, dtype=np.uint64), known)
        assert (v.places(other) == len(v)).all() and (v.places(np.array([0], dtype=np.uint64)) == len(v)).all()


def test_candidates_are_those_of_plain_cosines():
    rng = random.Random(5)
    gen = np.random.default_rng(5)
    texts = [prose(rng, rng.randrange(5, 60), 80) for _ in range(12)]
    hashes = np.concatenate([w.hash for _, w in passes(pa.array(texts), lower=True)])
    v = decontaminate.Vocabulary(hashes)
    idf, basis = gen.random(len(v)) + 0.1, gen.standard_normal((len(v), 6))
    items = decontaminate.Items(list(range(12)), texts, v, idf, basis)
    documents = [prose(rng, rng.randrange(1, 150), 90) for _ in range(8)]
    documents[2] += " " + texts[3]
    batch = pa.record_batch([pa.array(range(8), pa.int64()), pa.array(documents)], names=["id", "text"])
    got = {(r["doc_id"], r["item_id"]): r for b in decontaminate._search(items, 0.32, 0.6, 0.5)([batch]) for r in b.to_pylist()}

    def latent(words):
        at = v.places(next(iter(passes(pa.array([" ".join(words)]), lower=True)))[1].hash)
        x = sum((basis[t] * idf[t] for t in at if t < len(v)), np.zeros(6))
        return x / max(np.linalg.norm(x), 1e-9)

    want = {}
    for d, text in enumerate(documents):
        w = text.split()
        for s in range(0, len(w), 20):
            x = latent(w[s : s + 40])
            for k, t in enumerate(texts):
                own = t.split()
                if x @ latent(own) < 0.32 + 1e-6:
                    continue
                part = w[max(0, s - len(own)) : s + 40 + len(own)]
                share = plain_subsequence(own, part) / len(own)
                if share >= 0.6:
                    want[d, k] = max(share, want.get((d, k), 0))
    assert want and set(got) == set(want) and all(abs(got[p]["shared"] - want[p]) < 1e-9 for p in want)


def test_the_first_bound_keeps_what_is_possible():
    rng = random.Random(21)
    texts = [prose(rng, n, 60) for n in (3, 9, 30, 45, 45, 400)]
    v = decontaminate.Vocabulary(np.concatenate([w.hash for _, w in passes(pa.array(texts), lower=True)]))
    items = decontaminate.Items(list(range(len(texts))), texts, v, np.ones(len(v)), np.ones((len(v), 2)))
    _, words = next(iter(passes(pa.array([prose(rng, n, 240) for n in (1, 700, 90)]), lower=True)))
    columns = items.column[v.places(words.hash)]
    first, doc, _ = decontaminate._segments(words)
    k = np.tile(np.arange(len(texts)), len(first))
    s, d = np.repeat(first, len(texts)), np.repeat(doc, len(texts))
    begin, end = np.maximum(words.bound[d], s - items.reach[k]), np.minimum(words.bound[d + 1], s + 40 + items.reach[k])
    want = []
    for j in range(len(k)):
        own, part = list(items.words[k[j]]), columns[begin[j] : end[j]].tolist()
        bag = sum(min(own.count(x), part.count(items.column[x])) for x in set(own))
        want.append(bag >= 0.5 * len(own))
    few = items.roomy(k, begin, *items.padded(columns), 0.5)
    assert 0 < sum(want) < len(few) < len(k) and set(np.flatnonzero(want)) <= set(few.tolist())
    assert items.possible(k, begin, end, columns, 0.5).tolist() == want


def planted(rng, items, n):
    docs, want = [], set()
    for i in range(n):
        t = prose(rng, 130, 60_000).split(" ")
        if i % 4 == 0:
            k = rng.randrange(len(items))
            t[40:40] = items[k][1].split()
            want.add((i, items[k][0]))
        docs.append((i, " ".join(t)))
    return docs, want


def test_rows_do_not_depend_on_blocks(spark):
    rng = random.Random(7)
    items = [(k, prose(rng, 35) + ". " + prose(rng, 6) + ".") for k in range(60)]
    docs, want = planted(rng, items, 160)
    docs = [(i, " ".join(x if rng.random() > 0.2 else "else" for x in t.split())) for i, t in docs]
    df, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS)
    got = [sorted((r.doc_id, r.item_id, round(r.cosine, 5), r.shared, r.answer) for r in decontaminate.leaks(df, bench, **o).collect()) for o in ({}, {"items_a_pass": 7}, {"cells_a_pass": 2000})]
    assert got[0] == got[1] == got[2] and {x[:2] for x in got[0]} <= want and len(got[0]) >= 0.9 * len(want)


def test_a_benchmark_of_a_hundred_thousand_words(spark):
    rng = random.Random(9)
    items = [(k, " ".join(f"v{40 * k + j}" for j in range(40))) for k in range(2500)]
    docs, want = planted(rng, items, 60)
    got = decontaminate.leaks(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want


def test_odd_rows(spark):
    rng = random.Random(13)
    long = prose(rng, 3000, 50_000)
    items = [(1, prose(rng, 30)), (2, long), (3, None), (4, " \n"), (None, "x y"), (5, prose(rng, 30)), (5, prose(rng, 30)), (5, "x")]
    docs = [(1, items[0][1]), (1, items[0][1]), (2, prose(rng, 50) + " " + long), (3, None), (4, "\t"), (None, items[0][1]), (6, "a " + items[6][1]), (7, prose(rng, 90, 50_000))]
    df = spark.createDataFrame(docs, SCHEMA).withColumn("id", F.lit("x")).withColumn("_id", F.lit(1)).withColumn("item_id", F.lit(1))
    bench = spark.createDataFrame(items, ITEMS).withColumn("n", F.lit("y")).withColumn("h", F.lit(2))
    got = sorted(((r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()), key=str)
    assert got == [(1, 1), (1, 1), (2, 2), (6, 5), (None, 1)]
    kept = decontaminate.keep_clean(df, bench)
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [3, 4, 7, None]


def test_the_basis_is_of_all_documents(spark):
    """2,300 documents: counts, weights and axes are those of a dense product over all of them and all items."""
    rng = random.Random(7)
    texts = [prose(rng, rng.randrange(1, 60), 20) for _ in range(2300)]
    asked = [prose(rng, 50, 20) for _ in range(5)]
    v = decontaminate.Vocabulary(np.concatenate([w.hash for _, w in passes(pa.array(asked), lower=True)]))
    docs, items = spark.createDataFrame(list(enumerate(texts)), SCHEMA), spark.createDataFrame(list(enumerate(asked)), "id long, text string")
    idf, basis = decontaminate.fit(docs, items, v, 12)

    def places(text):
        return [w for _, x in passes(pa.array([text]), lower=True) for w in v.places(x.hash).tolist()]

    df = np.bincount([p for t in texts for p in set(places(t))], minlength=len(v) + 1)[: len(v)]
    assert np.allclose(idf, np.log(2301 / (1 + df)) + 0.1)
    whole = np.zeros((len(v), len(v)))
    for kind in (texts, asked):
        rows = []
        for text in kind:
            at = places(text)
            for i in range(0, len(at), decontaminate.SEGMENT):
                row = np.bincount(at[i : i + 2 * decontaminate.SEGMENT], minlength=len(v) + 1)[: len(v)] * idf
                rows.append(row / np.linalg.norm(row))
        whole += np.array(rows).T @ np.array(rows) / len(rows)
    wanted = np.linalg.eigh(whole)[1][:, ::-1][:, :12]  # the fit takes 20 columns, so all of the space
    assert len(v) == 20 and np.allclose(np.abs(np.sum(basis * wanted, axis=0)), 1, atol=1e-3)
