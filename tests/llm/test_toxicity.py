"""The toxicity index and votes against dense products."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from citetrace.llm import toxicity

SCHEMA = "doc_id long, text string"
LABELS = "doc_id long, toxic int"


def small_index(rng, rows, terms, block):
    weight = np.array([1 + rng.random() for _ in range(terms)])
    vectors = [{rng.randrange(terms): rng.randrange(1, 4) for _ in range(rng.randrange(0, 6))} for _ in range(rows)]
    vectors[5:9] = [dict(vectors[4])] * 4  # ties
    flat = [(i, t, n) for i, v in enumerate(vectors) for t, n in v.items()]
    row, term, count = (np.array(c) for c in zip(*flat, strict=True))
    place = {f"t{i}": i for i in range(terms)}
    index = toxicity.Index(place, weight, row, term, count.astype(float), np.zeros(rows), block=block)
    dense = np.zeros((rows, terms))
    for i, t, n in flat:
        dense[i, t] = (1 + math.log(n)) * weight[t]
    return index, dense / np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-300)


def test_neighbours_are_exact():
    rng = random.Random(9)
    for block in (1, 16, 64):
        index, dense = small_index(rng, 300, 40, block)
        for _ in range(60):
            t, q = index.vector([f"t{rng.randrange(50)}" for _ in range(5)])
            full = np.zeros(40)
            full[t] = q
            cosine = dense @ full
            out = rng.choice([-1, 4, 6])
            ids, scores = index.nearest((t, q), 7, out)
            asked = [i for i in range(300) if cosine[i] > 1e-12 and i != out]
            want = sorted(asked, key=lambda i: (-round(cosine[i], 10), i))[:7]
            assert np.allclose(scores, cosine[want]) and len(ids) == len(want)
            assert ids.tolist() == want or set(np.round(cosine[ids], 9)) == set(np.round(cosine[want], 9))
            for a, b in zip(ids, ids[1:], strict=False):  # exactly equal vectors come by place
                assert a < b or scores[ids.tolist().index(a)] > scores[ids.tolist().index(b)]


def test_votes_equal_a_dense_product_over_all_terms(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scorer, ids = toxicity.fit(docs, labels)
    text = {r.doc_id: r.text for r in docs.collect()}
    marks = {r.doc_id: r.toxic for r in labels.where(~toxicity.held_out(F.col("doc_id"))).collect()}
    groups = defaultdict(list)
    for i in marks:
        groups[text[i] or ""].append(i)
    own = sorted((min(g), float(np.mean([marks[i] for i in g])), t) for t, g in groups.items())
    assert ids == [i for i, _, _ in own]
    tf = [Counter(toxicity.words_of(t)) for _, _, t in own]
    terms = sorted({w for c in tf for w in c})
    assert set(scorer.index.place) == set(terms)  # every term of every example is indexed
    y = np.array([v for _, v, _ in own])
    df = Counter(w for t in text.values() for w in set(toxicity.words_of(t)))
    weight = []
    for w in terms:
        held = np.array([w in c for c in tf])
        a, b = y[held].sum() + 0.5, (1 - y[held]).sum() + 0.5
        c, d = y[~held].sum() + 0.5, (1 - y[~held]).sum() + 0.5
        proven = max(0.0, abs(math.log(a * d / b / c)) - 3 * math.sqrt(1 / a + 1 / b + 1 / c + 1 / d))
        weight.append((math.log((1 + len(text)) / (1 + df[w])) + 0.01) * (0.2 + proven))
    place = {w: i for i, w in enumerate(terms)}

    def vector(c):
        v = np.zeros(len(terms))
        for w, n in c.items():
            if w in place:
                v[place[w]] = (1 + math.log(n)) * weight[place[w]]
        return v / max(1e-300, np.linalg.norm(v))

    dense = np.array([vector(c) for c in tf])
    for t in text.values():
        cosine = dense @ vector(Counter(toxicity.words_of(t)))
        near = np.sort(cosine[cosine > 1e-12])[::-1][:15]
        found, scores = scorer.index.nearest(scorer.index.vector(toxicity.words_of(t)), 15)
        assert np.allclose(scores, near) and np.allclose(cosine[found], near)


def test_equal_texts_with_opposite_labels_and_two_labels_of_one_id(spark):
    rng = random.Random(2)
    prose = lambda: " ".join(f"w{rng.randrange(60)}" for _ in range(30))
    rows = [(i, prose() + (" vile scum" if i % 3 == 0 else "")) for i in range(90)]
    same = prose()
    rows += [(i, same) for i in range(200, 210)]
    marks = [(i, int(i % 3 == 0)) for i in range(90)] + [(i, i % 2) for i in range(200, 210)] + [(1, 1)]
    got = []
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        out = toxicity.score(docs, spark.createDataFrame(marks[:: 1 if parts == 1 else -1], LABELS).repartition(parts)).collect()
        got.append(sorted((r.doc_id, round(r.score, 12), r.predicted, tuple(r.evidence)) for r in out))
    assert got[0] == got[1] and len(got[0]) == len(rows)
    assert len({s for i, s, _, _ in got[0] if i >= 200}) == 1


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "vile " * 50_000), (4, "fine words"), (4, "fine words"), (None, "vile")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("toxic", F.lit("x")).withColumn("score", F.lit(1)).withColumn("terms", F.lit(1))
    labels = spark.createDataFrame([(i, 1) for i in (1, 3)] + [(4, 0), (2, 0), (None, 1), (5, None), (6, 7)], LABELS).withColumn("text", F.lit("y"))
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert toxicity.score(docs.limit(0), labels).count() == 0 and toxicity.score(docs, labels.limit(0)).where("score <> 0").count() == 0
