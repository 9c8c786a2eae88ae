"""Exact quantiles (linear interpolation, nulls skipped) by distributed selection.

``percentile`` is exact but buffers the whole column of a group in one task;
on a global aggregate that is every value of the table. Here each order
statistic is found by bracketing:

1. one aggregate gives ``count`` and ``percentile_approx`` cut points just
   below and above every wanted rank (rank error <= n / accuracy);
2. conditional counts give the rows below every bracket (a small column's
   bracket is its whole range and needs none), and one grouped pass over the
   rows *inside* some bracket returns the distinct values there with their
   counts;
3. the driver walks those few (value, count) pairs to the exact rank and
   interpolates.

When a bracket would be too wide to return (enormous tables, or an
approximation that missed the rank), the brackets of all columns are narrowed
together by further ``percentile_approx`` rounds restricted to them before the
final pass (two aggregates a round, whatever the number of columns). Nothing
unbounded moves to one task or the driver, and a value that holds a third of
the rows collapses to one (value, count) pair.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def _plan(n: int, p: float) -> tuple[int, int, float]:
    h = (n - 1) * p
    lo, hi = math.floor(h), math.ceil(h)
    return lo, hi, h - lo


def _collect_brackets(df: DataFrame, brackets: dict[int, tuple[str, float, float]]
                      ) -> dict[int, tuple[int, list[tuple[float, int]]]]:
    """Per bracket: rows below it (conditional counts -- plain codegen'd
    comparisons, no row expansion) and the distinct values inside it with
    their counts (only rows inside some bracket are expanded and grouped)."""
    if not brackets:
        return {}
    started = {t: (c, a) for t, (c, a, _) in brackets.items() if a != -INF}   # nothing lies below the others
    counts = df.agg(*[F.count(F.when(F.col(c) < F.lit(a), 1)).alias(f"b{t}") for t, (c, a) in started.items()]).first() \
        if started else None
    below = {t: int(counts[f"b{t}"]) if t in started else 0 for t in brackets}
    inside = {t: (F.col(c) >= F.lit(a)) & (F.col(c) <= F.lit(b)) for t, (c, a, b) in brackets.items()}
    any_inside = F.lit(False)
    for cond in inside.values():
        any_inside = any_inside | cond
    items = [F.when(inside[t], F.struct(F.lit(t).alias("t"), F.col(c).cast("double").alias("v")))
             for t, (c, _, _) in brackets.items()]
    long = df.where(any_inside).select(F.explode(F.array(*items)).alias("e")) \
        .where(F.col("e").isNotNull()).select("e.t", "e.v")
    rows = long.groupBy("t", "v").count().collect()
    out: dict[int, tuple[int, list[tuple[float, int]]]] = {t: (below[t], []) for t in brackets}
    for r in rows:
        out[r["t"]][1].append((float(r["v"]), int(r["count"])))
    for t in out:
        out[t][1].sort()
    return out


def _bracket_counts(df: DataFrame, brackets: dict[int, tuple[str, float, float]]
                    ) -> dict[int, tuple[int, int]]:
    aggs = []
    for t, (c, a, b) in brackets.items():
        x = F.col(c)
        aggs += [F.count(F.when(x < F.lit(a), 1)).alias(f"lo{t}"),
                 F.count(F.when((x >= F.lit(a)) & (x <= F.lit(b)), 1)).alias(f"in{t}")]
    row = df.agg(*aggs).first()
    return {t: (int(row[f"lo{t}"]), int(row[f"in{t}"])) for t in brackets}


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    accuracy: int = 2_000, max_collect: int = 100_000
                    ) -> dict[tuple[str, float], float | None]:
    """Exact linear-interpolation quantiles (``quantile_cont`` / pandas default)."""
    cols = list(cols)
    probs = list(probs)
    eps = 1.0 / accuracy
    wide = sorted({min(max(x, 0.0), 1.0) for p in probs for x in (p - 2 * eps, p + 2 * eps)})
    head = df.agg(*[F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(cols)],
                  *[F.percentile_approx(F.col(c), wide, accuracy).alias(f"q{i}")
                    for i, c in enumerate(cols)]).first()
    brackets: dict[int, tuple[str, float, float]] = {}   # id -> (column, a, b)
    ranks: dict[int, list[int]] = {}                      # id -> wanted ranks inside
    plans: dict[tuple[str, float], tuple[int, int, float] | None] = {}
    n_of = {}
    for i, c in enumerate(cols):
        n = n_of[c] = int(head[f"n{i}"])
        approx = dict(zip(wide, head[f"q{i}"] or []))
        whole = None
        for p in probs:
            if n == 0:
                plans[(c, p)] = None
                continue
            lo, hi, d = _plan(n, p)
            plans[(c, p)] = (lo, hi, d)
            if n <= max_collect:       # small column: one bracket holds every value
                if whole is None:
                    whole = len(brackets)
                    brackets[whole], ranks[whole] = (c, -INF, INF), []
                ranks[whole] += [lo, hi]
                continue
            t = len(brackets)
            a = approx.get(min(max(p - 2 * eps, 0.0), 1.0), -INF)
            b = approx.get(min(max(p + 2 * eps, 0.0), 1.0), INF)
            brackets[t], ranks[t] = (c, float(a), float(b)), [lo, hi]
    # expected bracket size is ~4n/accuracy; narrow first only if that is large
    big = {t: br for t, br in brackets.items()
           if br[1] != -INF and 4.0 * eps * n_of[br[0]] > max_collect}
    if big:  # one bracket for each wanted rank; all of them shrink in the same passes
        parts = {}
        for t in big:
            for r in sorted(set(ranks[t])):
                parts[len(brackets) + len(parts)] = (t, r)
        narrowed = _narrow(df, {u: brackets[t] for u, (t, _) in parts.items()}, {u: r for u, (_, r) in parts.items()},
                           accuracy, max_collect)
        for t in big:
            del brackets[t], ranks[t]
        for u, (_, r) in parts.items():
            brackets[u], ranks[u] = narrowed[u], [r]
    values = _walk(_collect_brackets(df, brackets), brackets, ranks)
    missing = [(brackets[t][0], r) for t in brackets for r in ranks[t] if (brackets[t][0], r) not in values]
    if missing:  # the approximation missed: narrow from the full range, then collect
        retry = {i: (c, -INF, INF) for i, (c, _) in enumerate(missing)}
        rr = {i: [r] for i, (_, r) in enumerate(missing)}
        narrowed = _narrow(df, retry, {i: r[0] for i, r in rr.items()}, accuracy, max_collect)
        values.update(_walk(_collect_brackets(df, narrowed), narrowed, rr))
    out: dict[tuple[str, float], float | None] = {}
    for (c, p), spec in plans.items():
        if spec is None:
            out[(c, p)] = None
            continue
        lo, hi, d = spec
        v_lo, v_hi = values[(c, lo)], values[(c, hi)]
        out[(c, p)] = v_lo if lo == hi else v_lo + (v_hi - v_lo) * d
    return out


def _walk(got, brackets, ranks) -> dict[tuple[str, int], float]:
    """Exact rank lookup inside collected brackets (below-count + sorted pairs)."""
    values = {}
    for t, (c, _, _) in brackets.items():
        below, vals = got[t]
        for r in sorted(set(ranks[t])):
            if below > r:
                continue
            cum = below
            for v, k in vals:
                cum += k
                if cum > r:
                    values[(c, r)] = v
                    break
    return values


def _narrow(df: DataFrame, brackets: dict[int, tuple[str, float, float]], ranks: dict[int, int],
            accuracy: int, max_collect: int) -> dict[int, tuple[str, float, float]]:
    """Shrink brackets by ``percentile_approx`` rounds restricted to each
    bracket until it holds at most ``max_collect`` rows. All brackets share each round's two
    aggregates. Where the sketch makes no headway, the bracket is cut at the middle of
    its value range, which always does: a bracket ends when it is small or
    one value wide, so nothing large is ever collected."""
    eps = 1.0 / accuracy
    state = {}
    counts = _bracket_counts(df, brackets)
    for t, (c, a, b) in brackets.items():
        below, inside = counts[t]
        state[t] = [c, a, b, below, inside]
    while True:
        todo = [t for t, s in state.items() if s[4] > max_collect and s[1] < s[2]]
        if not todo:
            break
        aggs = []
        for t in todo:
            c, a, b, below, inside = state[t]
            p = (ranks[t] - below) / max(inside - 1, 1)
            x = F.when((F.col(c) >= F.lit(a)) & (F.col(c) <= F.lit(b)), F.col(c))
            aggs.append(F.percentile_approx(x, [min(max(p - 2 * eps, 0.0), 1.0),
                                                min(max(p + 2 * eps, 0.0), 1.0)], accuracy).alias(f"q{t}"))
            aggs += [F.min(x).alias(f"mn{t}"), F.max(x).alias(f"mx{t}")]
        row = df.agg(*aggs).first()
        tries = {}
        for k, t in enumerate(todo):
            c, mn, mx = state[t][0], float(row[f"mn{t}"]), float(row[f"mx{t}"])
            state[t][1:3] = [mn, mx]
            tries[3 * k] = (c, float(row[f"q{t}"][0]), float(row[f"q{t}"][1]))
            mid = mn + (mx - mn) / 2
            tries[3 * k + 1], tries[3 * k + 2] = (c, mn, mid), (c, math.nextafter(mid, INF), mx)
        checked = _bracket_counts(df, tries)
        for k, t in enumerate(todo):
            for u in range(3 * k, 3 * k + 3):
                below, inside = checked[u]
                if below <= ranks[t] < below + inside and inside < state[t][4]:
                    state[t] = [*tries[u], below, inside]
                    break
            else:  # the middle cannot be told from an end: both ends hold one value each
                c, mn, mx = state[t][:3]
                ends = {0: (c, mn, mn), 1: (c, mx, mx)}
                for u, (below, inside) in _bracket_counts(df, ends).items():
                    if below <= ranks[t] < below + inside:
                        state[t] = [*ends[u], below, inside]
    return {t: (s[0], s[1], s[2]) for t, s in state.items()}
