"""Exact quantiles by selection: probe, count exactly, refine. No task holds the distinct values, however many there are.

Each pass takes probes near the wanted ranks from a sketch of bounded size and counts, exactly, how many rows are below each probe and how many at it. A rank
that a probe covers is found; for the others the nearest probes on either side bound what the next pass looks at, which is a small share of what the last one
did. All ranks of all columns go through the same passes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citetrace.plans.storage import materialise

#: Accuracy of the sketch that gives probes (its size is bounded by it), and how far the outer probes stand from the wanted place.
ACCURACY = 2_000
APART = 2 / ACCURACY


@dataclass
class _Rank:
    """A wanted place (from 0) of a column's values in order, and the open interval it is in: ``below`` rows are at or below ``low``, ``size`` rows are inside."""

    column: str
    place: int
    size: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def inside(self):
        x = F.col(self.column)
        out = x.isNotNull()
        out = out if self.low is None else out & (x > self.low)
        return out if self.high is None else out & (x < self.high)

    def probes(self) -> list[float]:
        at = (self.place - self.below + 0.5) / self.size
        return [min(1.0, max(0.0, at + d)) for d in (-APART, 0.0, APART)]

    def learn(self, v: float, under: int, upto: int) -> None:
        """``under`` rows are below v, ``upto`` at or below it."""
        if under <= self.place < upto:
            self.value = v
        elif upto <= self.place and (self.low is None or v > self.low):
            self.size -= upto - self.below
            self.low, self.below = v, upto
        elif under > self.place and (self.high is None or v < self.high):
            self.size = under - self.below
            self.high = v


def quantiles(rows: DataFrame, asked: dict[str, tuple[str, float]]) -> dict[str, float | None]:
    """For each name the quantile of a column, by linear interpolation between the two nearest values (type 7). Nulls do not count; without values it is None."""
    columns = sorted({c for c, _ in asked.values()})
    own = materialise(rows.select(*[F.col(c).cast("double").alias(c) for c in columns]), "selection")
    n = own.agg(*[F.count(c).alias(c) for c in columns]).first()
    ends = {name: (math.floor((n[c] - 1) * p), (n[c] - 1) * p) for name, (c, p) in asked.items() if n[c]}
    wanted = {(asked[name][0], min(k, n[asked[name][0]] - 1)) for name, (k, _) in ends.items() for k in (k, k + 1)}
    found = select(own, {(c, k): n[c] for c, k in wanted})
    out: dict[str, float | None] = dict.fromkeys(asked)
    for name, (k, at) in ends.items():
        c = asked[name][0]
        a, b = found[c, k], found[c, min(k + 1, n[c] - 1)]
        out[name] = a if at == k else a + (at - k) * (b - a)
    return out


def select(rows: DataFrame, wanted: dict[tuple[str, int], int]) -> dict[tuple[str, int], float]:
    """The value at each (column, place) of double columns; the number of values of its column is given with it."""
    ranks = [_Rank(c, k, n) for (c, k), n in sorted(wanted.items())]
    while left := [r for r in ranks if r.value is None]:
        sketch = [F.percentile_approx(F.when(r.inside(), F.col(r.column)), r.probes(), ACCURACY) for r in left]
        seen = rows.agg(*[s.alias(f"_{i}") for i, s in enumerate(sketch)]).first()
        probes = sorted({(r.column, v) for i, r in enumerate(left) for v in seen[i]})
        counts = [F.count_if(test) for c, v in probes for test in (F.col(c) < v, F.col(c) <= v)]
        said = rows.agg(*[x.alias(f"_{i}") for i, x in enumerate(counts)]).first()
        for i, (c, v) in enumerate(probes):
            for r in left:
                if r.column == c and r.value is None:
                    r.learn(v, said[2 * i], said[2 * i + 1])
    return {(r.column, r.place): r.value for r in ranks}
