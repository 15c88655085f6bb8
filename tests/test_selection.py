"""Quantiles by selection and the exact signed-rank distribution."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from citetrace.operators import selection, stats
from citetrace.plans import storage


def type7(values, p):
    return float(np.quantile(np.array(values, dtype=float), p)) if values else None


@pytest.mark.parametrize("case", ["few", "ties", "wide", "one", "none"])
def test_quantiles_equal_type_7(spark, case):
    rnd = random.Random(3)
    values = {
        "few": [3.0, -1.0, 2.5, None, 8.0],
        "ties": [float(rnd.choice((0, 0, 0, 1, 7))) for _ in range(4000)] + [None] * 50,
        "wide": [rnd.choice((-1, 1)) * 10.0 ** rnd.uniform(-300, 300) for _ in range(5000)],
        "one": [4.0],
        "none": [None, None],
    }[case]
    df = spark.createDataFrame([(v, -v if v is not None else 1.0) for v in values], "x double, y double").repartition(5)
    ps = (0.0, 0.1, 0.5, 0.9, 0.95, 0.99, 1.0)
    got = selection.quantiles(df, {f"{c}{p}": (c, p) for c in "xy" for p in ps})
    xs = [v for v in values if v is not None]
    for p in ps:
        want = type7(xs, p)
        assert got[f"x{p}"] == (pytest.approx(want, rel=1e-12) if want is not None else None)
    ys = [-v if v is not None else 1.0 for v in values]
    assert got["y0.5"] == pytest.approx(type7(ys, 0.5), rel=1e-12)


def test_quantiles_of_millions_of_values(spark):
    """Two million distinct values: exact, in a few passes, without an aggregate that holds values."""
    n = 2_000_000
    df = spark.range(n).select(((F.col("id") * 7919) % n).cast("double").alias("x"))
    got = selection.quantiles(df, {"a": ("x", 0.5), "b": ("x", 0.99), "c": ("x", 0.123456)})
    assert got == {"a": (n - 1) / 2, "b": pytest.approx(0.99 * (n - 1), abs=1e-6), "c": pytest.approx(0.123456 * (n - 1), abs=1e-6)}


def enumerated(differences):
    size = sorted(map(abs, differences))
    v = sum(size.index(abs(d)) + 1 for d in differences if d > 0)
    n = len(differences)
    sums = Counter(sum(k for k, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product((0, 1), repeat=n))
    low, high = sum(c for s, c in sums.items() if s <= v), sum(c for s, c in sums.items() if s >= v)
    return v, min(1.0, 2 * min(low, high) / 2**n)


def test_signed_rank_equals_enumeration(spark):
    rnd = random.Random(5)
    rows, want = [], {}
    for n in range(1, 16):
        size = rnd.sample(range(1, 1000), n)
        d = [float(s * rnd.choice((-1, 1, 1))) for s in size]
        rows += [(n, x) for x in d]
        want[n] = enumerated(d)
    df = spark.createDataFrame(rows, "g int, d double")
    for r in stats.wilcoxon_by(df, ["g"], "d").collect():
        assert (r.v, r.p) == (want[r.g][0], pytest.approx(want[r.g][1], abs=1e-12))
    one = stats.wilcoxon(df.where("g = 11"), "d").first()
    assert (one.v, one.n, one.p) == (want[11][0], 11, pytest.approx(want[11][1], abs=1e-12))


def test_signed_rank_is_approximate_where_it_must_be(spark):
    """With ties, with zeros, and from fifty differences on."""
    tied, zero, many = [1.0, -1.0, 2.0, 3.0], [0.0, 1.0, 2.0, -3.0], [float(i) * (-1) ** (i % 3) for i in range(1, 51)]
    rows = [(g, d) for g, ds in enumerate((tied, zero, many, many[:49], [0.0, 0.0])) for d in ds]
    df = spark.createDataFrame(rows, "g int, d double")
    got = {r.g: r for r in stats.wilcoxon_by(df, ["g"], "d").withColumn("q", stats.normal_two_sided(F.col("z"))).collect()}
    assert all(got[g].p == got[g].q for g in (0, 1, 2)) and got[3].p != got[3].q and abs(got[3].p - got[3].q) < 0.01
    assert (got[4].n, got[4].p) == (0, 1.0)  # nothing speaks against equality


def test_a_lorenz_curve_is_one_ordered_pass(spark):
    """Its three running sums are dealt and written once; they were once each."""
    rows = spark.range(500).selectExpr("id % 7 AS x")
    before = set(storage.written(spark))
    curve = stats.lorenz(rows, "x")
    assert len([p for p in storage.written(spark) if p not in before and "/ranges-" in p]) == 1
    n, total, want = 0, sum(i % 7 for i in range(500)), []
    for v in range(7):
        n += sum(i % 7 == v for i in range(500))
        want.append((n / 500, sum(i % 7 for i in range(500) if i % 7 <= v) / total))
    assert [tuple(r) for r in curve.orderBy("p").collect()] == want
