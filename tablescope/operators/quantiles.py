"""Exact order statistics and linearly interpolated quantiles.

Spark's ``percentile`` keeps every distinct value of a group in one task.  For
small tables that is one simple, lazy aggregate and it is used.  Beyond
``DIRECT_ROWS`` the wanted ranks are found by narrowing: an approximate sketch
brackets every rank, a count says which side of the bracket holds it, and the
bracket shrinks some 250 times per round until its rows are few.  Each round is
two aggregates over the columns concerned, combined map-side, with no shuffle
of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import double, quoted

DIRECT_ROWS = 100_000
SKETCH = 1_000
STEP = 2.0 / SKETCH
"""Half width of a bracket, as a share of the rows it is cut from."""


@dataclass(frozen=True)
class _Bracket:
    """Wanted ranks of a column and the value range known to hold them."""

    name: str
    ranks: tuple[int, ...]
    low: object
    high: object
    below: int
    inside: int
    open_low: bool = False
    open_high: bool = False

    def holds(self, value: Column) -> Column:
        left = value > F.lit(self.low) if self.open_low else value >= F.lit(self.low)
        right = value < F.lit(self.high) if self.open_high else value <= F.lit(self.high)
        return left & right

    def settled(self) -> bool:
        return self.low == self.high

    def share(self, rank: int) -> float:
        return (rank - self.below) / max(self.inside - 1, 1)

    def clumps(self) -> list[tuple[int, ...]]:
        """Ranks close enough to share a bracket of the next round."""
        out: list[list[int]] = []
        for r in sorted(set(self.ranks)):
            if out and self.share(r) - self.share(out[-1][0]) < STEP:
                out[-1].append(r)
            else:
                out.append([r])
        return [tuple(c) for c in out]


Ranks = Callable[[int], Sequence[int]]


def order_statistics(
    df: DataFrame, wanted: Mapping[str, tuple[Column, Ranks]], direct_rows: int = DIRECT_ROWS
) -> dict[str, tuple[int, dict[int, object]]]:
    """Per name: (non-null values, value at each wanted rank).

    ``wanted`` gives a column and a function from its count to 0-based ranks.
    Values must be doubles, or longs below 2**53.  Ranks outside are left out.
    """
    if not wanted:
        return {}
    values = df.select(*[v.alias(name) for name, (v, _) in wanted.items()])
    row = values.agg(
        *[
            f(quoted(name)).alias(f"{tag}{i}")
            for i, name in enumerate(wanted)
            for tag, f in (("lo", F.min), ("hi", F.max), ("n", F.count))
        ]
    ).first()
    found: dict[str, tuple[int, dict[int, object]]] = {}
    brackets = []
    for i, (name, (_, ranks)) in enumerate(wanted.items()):
        n = int(row[f"n{i}"])
        found[name] = (n, {})
        inside = tuple(r for r in ranks(n) if 0 <= r < n)
        if inside:
            brackets.append(_Bracket(name, inside, row[f"lo{i}"], row[f"hi{i}"], 0, n))
    while brackets:
        for b in brackets:
            if b.settled():
                found[b.name][1].update({r: b.low for r in b.ranks})
        brackets = [b for b in brackets if not b.settled()]
        wide = [b for b in brackets if b.inside > direct_rows]
        if not wide:
            break
        brackets = [b for b in brackets if b.inside <= direct_rows] + _narrow(values, wide)
    if brackets:
        _settle(values, brackets, found)
    return found


def _settle(values: DataFrame, brackets: list[_Bracket], found: dict[str, tuple[int, dict[int, object]]]) -> None:
    """Read the ranks off brackets of few rows; stored values, so no interpolation error creeps in."""
    picked = values.select(*[F.when(b.holds(quoted(b.name)), quoted(b.name)).alias(f"v{i}") for i, b in enumerate(brackets)])
    some = [f"v{i} IS NOT NULL" for i in range(len(brackets))]
    places = [(i, b, r) for i, b in enumerate(brackets) for r in sorted(set(b.ranks))]
    row = (
        picked.where(" OR ".join(some))
        .agg(
            *[
                F.expr(f"percentile_disc({(r - b.below + 0.5) / b.inside!r}D) WITHIN GROUP (ORDER BY v{i})").alias(f"q{k}")
                for k, (i, b, r) in enumerate(places)
            ]
        )
        .first()
    )
    for k, (_, b, r) in enumerate(places):
        found[b.name][1][r] = row[f"q{k}"]


def _narrow(values: DataFrame, brackets: list[_Bracket]) -> list[_Bracket]:
    """Smaller brackets for the same ranks."""
    sketches = []
    for i, b in enumerate(brackets):
        at = [p for c in b.clumps() for p in (max(0.0, b.share(c[0]) - STEP), min(1.0, b.share(c[-1]) + STEP))]
        sketches.append(F.percentile_approx(F.when(b.holds(quoted(b.name)), quoted(b.name)), at, SKETCH).alias(f"p{i}"))
    probes = values.agg(*sketches).first()
    cuts = [(b, c, *probes[f"p{i}"][2 * j : 2 * j + 2]) for i, b in enumerate(brackets) for j, c in enumerate(b.clumps())]
    counts = []
    for i, (b, _, low, high) in enumerate(cuts):
        v = quoted(b.name)
        counts += [
            F.count_if(b.holds(v) & (v < F.lit(low))).alias(f"l{i}"),
            F.count_if(v == F.lit(low)).alias(f"a{i}"),
            F.count_if((v > F.lit(low)) & (v < F.lit(high))).alias(f"m{i}"),
            F.count_if(v == F.lit(high)).alias(f"b{i}"),
        ]
    row = values.agg(*counts).first()
    out = []
    for i, (b, clump, low, high) in enumerate(cuts):
        left, at_low, middle = int(row[f"l{i}"]), int(row[f"a{i}"]), int(row[f"m{i}"])
        at_high = int(row[f"b{i}"]) if low < high else 0
        # the ends stand alone: a value held by many rows is settled at once
        sizes = [left, at_low, middle, at_high, b.inside - left - at_low - middle - at_high]
        ranges = [
            dict(high=low, open_high=True),
            dict(low=low, high=low, open_low=False, open_high=False),
            dict(low=low, high=high, open_low=True, open_high=True),
            dict(low=high, high=high, open_low=False, open_high=False),
            dict(low=high, open_low=True),
        ]
        below = b.below
        for size, edges in zip(sizes, ranges):
            mine = tuple(r for r in clump if below <= r < below + size)
            if mine:
                out.append(replace(b, ranks=mine, below=below, inside=size, **edges))
            below += size
    return out


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    rows: int | None = None,
    direct_rows: int = DIRECT_ROWS,
) -> dict[str, list[Column]]:
    """Per column, one expression per probability (linear interpolation, nulls skipped).

    Small tables give scalar subqueries (lazy); large ones give literals found
    by narrowing, which also let range filters reach the scan.
    """
    rows = df.count() if rows is None else rows
    if rows <= direct_rows:
        probs = F.array(*[F.lit(float(p)) for p in probabilities])
        one = df.agg(F.struct(*[F.percentile(double(c), probs).alias(f"c{i}") for i, c in enumerate(columns)]).alias("q"))
        value = one.scalar()
        return {c: [value[f"c{i}"].getItem(j) for j in range(len(probabilities))] for i, c in enumerate(columns)}

    def ranks(n: int) -> list[int]:
        return [r for p in probabilities for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))]

    found = order_statistics(df, {c: (double(c), ranks) for c in columns}, direct_rows)
    out: dict[str, list[Column]] = {}
    for c, (n, at) in found.items():
        out[c] = []
        for p in probabilities:
            if n:
                low, high = at[math.floor(p * (n - 1))], at[math.ceil(p * (n - 1))]
                out[c].append(F.lit(low + (high - low) * (p * (n - 1) - math.floor(p * (n - 1)))))
            else:
                out[c].append(F.lit(None).cast("double"))
    return out
