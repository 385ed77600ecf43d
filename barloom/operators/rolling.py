"""Rolling windows over an instrument's rows.

Two forms:

* ``rolling`` — a plain ROWS frame guarded by a row count, for one or a few columns.
* ``RollingBlocks`` — many long windows at once. A sliding frame re-reads all ``w`` rows
  for every output row. Here each window is put together from shorter windows already
  computed (10 = 5 + the 5 before it, 250 = 120 + 120 + 10), whose states are mergeable:
  mean, sum of squared deviations, co-deviation, sum, first maximum and minimum. One
  ``lag`` per state replaces the frame, so the cost per row does not depend on ``w``, all
  levels share one exchange and one sort, and nothing is ever subtracted, so there is no
  cancellation. Missing values propagate through the merge, which is exactly the rule that
  a window counts only when every one of its rows is present.

Rows per instrument are unique by date, so a window partition is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import as_col


def rows_window(by: str | Sequence[str] = "code", order: str | Sequence[str] = "trade_date"):
    by = [by] if isinstance(by, str) else list(by)
    order = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*by).orderBy(*order)


def rolling(col: Column | str, n: int, agg: str = "avg", *, by="code", order="trade_date",
            min_count: int | None = None, q: float | None = None) -> Column:
    """``agg`` over the last ``n`` rows; null unless ``min_count`` (default ``n``) of them
    hold a value. ``agg`` is one of avg, sum, min, max, std, var, quantile (with ``q``)."""
    c = as_col(col)
    frame = rows_window(by, order).rowsBetween(-(n - 1), 0)
    funcs = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max,
             "std": F.stddev_samp, "var": F.var_samp}
    value = F.percentile(c, F.lit(q)) if agg == "quantile" else funcs[agg](c)
    need = n if min_count is None else min_count
    return F.when(F.count(c).over(frame) >= need, value.over(frame))


def rolling_corr(x: Column | str, y: Column | str, n: int, *, by="code", order="trade_date",
                 min_count: int | None = None) -> Column:
    """Pairwise-complete correlation; a constant side gives null, never an error."""
    x, y = as_col(x), as_col(y)
    both = x.isNotNull() & y.isNotNull()
    mx, my = F.when(both, x), F.when(both, y)
    frame = rows_window(by, order).rowsBetween(-(n - 1), 0)
    need = n if min_count is None else min_count
    value = F.try_divide(F.covar_samp(mx, my).over(frame),
                         F.stddev_samp(mx).over(frame) * F.stddev_samp(my).over(frame))
    return F.when(F.count(mx).over(frame) >= need, value)


def split_into_blocks(size: int, known: Sequence[int]) -> list[tuple[int, int]]:
    """Cover ``size`` rows by known window sizes: list of (window, rows to look back)."""
    blocks, offset = [], 0
    for w in sorted(known, reverse=True):
        while size - offset >= w:
            blocks.append((w, offset))
            offset += w
    return blocks


def split_overlapping(size: int, known: Sequence[int]) -> list[tuple[int, int]]:
    """Cover ``size`` rows where blocks may overlap (enough for maxima): fewer blocks."""
    best = max(known)
    blocks, offset = [], 0
    while size - offset > best:
        blocks.append((best, offset))
        offset += best
    blocks.append((best, size - best))
    return blocks


class RollingBlocks:
    """Rolling states of many series over a ladder of windows.

    ``means`` keep the mean (``a``), those in ``spreads`` (all unless named) the sum of squared
    deviations too (``q``), ``pairs`` the co-deviation (``p``), ``sums`` the sum (``s``), ``highs``/``lows`` the extreme
    (``x``/``n``) and the row number of its first hit (``xi``/``ni``). ``upto`` names the longest window of a series
    that is not wanted for the whole ladder.

    All states of a window travel in two array columns, so a level needs one ``lag`` per
    block whatever the number of series, and rows stay narrow between the window nodes.
    ``ref(kind, series, w)`` is the SQL text that reads a state back.
    """

    def __init__(self, means: Sequence[str] = (), pairs: Sequence[tuple[str, str]] = (),
                 sums: Sequence[str] = (), highs: Sequence[str] = (), lows: Sequence[str] = (),
                 row_number: str = "row_no", spreads: Sequence[str] | None = None, upto: Mapping[str, int] | None = None):
        self.row_number = row_number
        self.upto = dict(upto or {})
        self.pairs = list(pairs)
        self.first = ([("a", x) for x in means] + [("s", x) for x in sums]
                      + [("x", x) for x in highs] + [("n", x) for x in lows])
        self.second = ([("q", x) for x in (means if spreads is None else spreads)] + [("p", f"{x}~{y}") for x, y in pairs]
                       + [("xi", x) for x in highs] + [("ni", x) for x in lows])

    def _held(self, states: Sequence[tuple[str, str]], w: int) -> list[tuple[str, str]]:
        """Those of the states that window ``w`` keeps."""
        return [(kind, x) for kind, x in states if self.upto.get(x, w) >= w]

    def ref(self, kind: str, series: str, w: int, lag: int = 0) -> str:
        if (kind, series) in self.first:
            place, column = self._held(self.first, w).index((kind, series)), f"first{w}"
        else:
            place, column = self._held(self.second, w).index((kind, series)), f"second{w}"
        if lag:
            column += f"_lag{lag}"
        return f"{column}[{place}]"

    def add(self, df: DataFrame, windows: Iterable[int], *, by="code", order="trade_date",
            after_level: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
        """Compute the ladder. ``after_level`` may add columns that read the states of the
        level just finished; states no longer needed are dropped on the way."""
        frame = rows_window(by, order)
        ladder = sorted(set(windows) - {1})
        plans, known = {}, [1]
        for w in ladder:
            plans[w] = (split_into_blocks(w, known), split_overlapping(w, known))
            known.append(w)
        df = df.withColumn("first1", F.expr("array(" + ", ".join(f"`{x}`" for _, x in self.first) + ")"))
        for place, w in enumerate(ladder):
            df = self._level(df, w, *plans[w], frame)
            if after_level:
                df = after_level(df, w)
            later = {b for v in ladder[place + 1:] for blocks in plans[v] for b, _ in blocks}
            done = [v for v in [1, *ladder[:place + 1]] if v not in later]
            df = df.drop(*[f"{half}{v}" for v in done for half in ("first", "second")])
        return df

    def _level(self, df: DataFrame, w: int, blocks, spans, frame) -> DataFrame:
        lagged = sorted({(b, off) for b, off in [*blocks, *spans] if off})
        lags = {f"{half}{b}_lag{off}": F.lag(f"{half}{b}", off).over(frame)
                for b, off in lagged for half in ("first", "second") if half == "first" or b > 1}
        if not self.second:
            lags = {k: v for k, v in lags.items() if k.startswith("first")}

        first = []
        for kind, x in self._held(self.first, w):
            if kind == "a":
                first.append("(" + " + ".join(f"{b}D * {self.ref('a', x, b, off)}" for b, off in blocks) + f") / {w}D")
            elif kind == "s":
                first.append(" + ".join(self.ref("s", x, b, off) for b, off in blocks))
            else:
                values = [self.ref(kind, x, b, off) for b, off in spans]
                present = " AND ".join(f"{v} IS NOT NULL" for v in values)
                pick = "greatest" if kind == "x" else "least"
                first.append(f"CASE WHEN {present} THEN {pick}({', '.join(values)}) END")

        second = []
        for kind, x in self._held(self.second, w):
            if kind in ("q", "p"):
                left, right = (x, x) if kind == "q" else x.split("~")
                ml, mr = self.ref("a", left, w), self.ref("a", right, w)
                terms = [self.ref(kind, x, b, off) for b, off in blocks if b > 1]
                terms += [f"{b}D * ({self.ref('a', left, b, off)} - {ml}) * ({self.ref('a', right, b, off)} - {mr})"
                          for b, off in blocks]
                second.append(" + ".join(terms))
            else:
                extreme = kind[0]
                best = self.ref(extreme, x, w)
                hits = " ".join(
                    f"WHEN {self.ref(extreme, x, b, off)} = {best} THEN "
                    + (f"CAST(`{self.row_number}` - {off} AS DOUBLE)" if b == 1 else self.ref(kind, x, b, off))
                    for b, off in reversed(spans))
                second.append(f"CASE {hits} END")

        kept = df.columns
        if lags:
            df = df.withColumns(lags)
        df = df.withColumn(f"first{w}", F.expr("array(" + ", ".join(first) + ")"))
        new = [f"first{w}"]
        if second:
            df = df.withColumn(f"second{w}", F.expr("array(" + ", ".join(second) + ")"))
            new.append(f"second{w}")
        return df.select(*kept, *new)
