"""Ranked title search against all pairs."""

import math
import random
import re
from collections import Counter

import pytest

from citetrace.operators import titles


def plain(seeds, works, k=5):
    bags = {n: b for n, t in works if (b := Counter(re.findall(r"\w+", (t or "").lower())))}
    docs, total = len(bags), sum(sum(b.values()) for b in bags.values())
    df = Counter(w for b in bags.values() for w in b)
    out = {}
    for r, t in seeds:
        scored = []
        for n, b in bags.items():
            m = 300 + 900 * sum(b.values()) * docs // total
            s = sum(math.floor(1000 * math.log1p((docs - df[w] + 0.5) / (df[w] + 0.5))) * 2200 * b[w] // (1000 * b[w] + m) for w in set((t or "").lower().split()) if w in b)
            if s > 0:
                scored.append((-s, n))
        out |= {(r, i): (n, -s) for i, (s, n) in enumerate(sorted(scored)[:k], 1)}
    return out


@pytest.mark.parametrize("first", [0, 10, 10_000])
def test_search_equals_all_pairs(spark, first):
    rnd = random.Random(first)
    common, rare = ["of", "the", "study", "a"], [f"w{i}" for i in range(150)]
    title = lambda: " ".join([rnd.choice(common) for _ in range(rnd.randrange(0, 5))] + [rnd.choice(rare) for _ in range(rnd.randrange(0, 4))])
    works = [(f"n{i:03d}", title()) for i in range(400)] + [("null", None), ("blank", " - ")]
    seeds = [(f"r{i}", title()) for i in range(60)] + [("none", None), ("common", "the"), ("two", "of the"), ("three", "the study of a"), ("unheard", "zzz yyy"), ("mixed", "zzz the")]
    s = spark.createDataFrame(seeds, "record_id string, title string")
    w = spark.createDataFrame(works, "node_id string, title string")
    got = {(r.record_id, r.rank): (r.node_id, r.score) for r in titles.search(s, w, first=first).collect()}
    want = plain(seeds, works)
    assert got == want, [(key, got.get(key), want.get(key)) for key in sorted({*got, *want}) if got.get(key) != want.get(key)][:5]


def test_near_titles_and_authors(spark):
    works = [("a", "Effects of zinc on growth in mice", ["Ann Li"]), ("b", "Effects of zinc on growth in rats", ["Bo Ray"]), ("c", "Growth of rice", ["Cy Lee"]), ("d", "Zinc", None)]
    w = spark.createDataFrame(works, "node_id string, title string, authors array<string>")
    rows = [("1", "Retracted: Effects of Zinc on growth in mice.", "Ann Li"), ("2", "Effect of zinc on growth", "Bo Ray; X Y"), ("3", "Effects of zinc on growth in mice", "No One"), ("4", "nothing alike", "Ann Li")]
    s = spark.createDataFrame(rows, "record_id string, title string, author string")
    assert dict(titles.resolve(s, w).collect()) == {"1": "a", "2": "b", "3": "a"}
