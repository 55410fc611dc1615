"""Time-series windows over one symbol's history.

Every window here is partitioned by ``code`` and ordered by ``date``. The panel
is unique on (code, date), so one partition holds at most one row per calendar
day: a symbol can be traded heavily, but its history cannot grow with the data.
Raw inputs are brought to that key by aggregates with map-side combine first
(see ``operators.cleaning.dedup``), never by a window.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.scalars import col


def history() -> WindowSpec:
    return Window.partitionBy("code").orderBy("date")


def rows(n: int) -> WindowSpec:
    """The current row and the n-1 rows before it."""
    return history().rowsBetween(-(n - 1), 0)


def so_far() -> WindowSpec:
    return history().rowsBetween(Window.unboundedPreceding, 0)


def lag(value: Column | str, n: int = 1) -> Column:
    return F.lag(col(value), n).over(history())


def pct_change(value: Column | str, n: int = 1) -> Column:
    """Change against n rows earlier; missing closes are not padded."""
    return F.try_divide(col(value), lag(value, n)) - 1


def _guard(value: Column, n: int, strict: bool, result: Column) -> Column:
    return F.when(F.count(value).over(rows(n)) == n, result) if strict else result


def rolling_mean(value: Column | str, n: int, strict: bool = False) -> Column:
    """Mean over n rows; strict means NULL until n values are there."""
    value = col(value)
    return _guard(value, n, strict, F.avg(value).over(rows(n)))


def rolling_sum(value: Column | str, n: int, strict: bool = False) -> Column:
    value = col(value)
    return _guard(value, n, strict, F.sum(value).over(rows(n)))


def rolling_std(value: Column | str, n: int, strict: bool = False) -> Column:
    """Sample deviation, NULL on a single value."""
    value = col(value)
    return _guard(value, n, strict, F.stddev_samp(value).over(rows(n)))


@dataclass(frozen=True)
class Rolling:
    """A rolling ``mean``, ``sum`` or ``std`` of a column, as a window expression (``column``) or for ``sweep``."""

    kind: str
    source: str
    n: int
    strict: bool = False

    def column(self) -> Column:
        return {"mean": rolling_mean, "sum": rolling_sum, "std": rolling_std}[self.kind](self.source, self.n, self.strict)


@dataclass(frozen=True)
class Exponential:
    """An exponential mean of a column, for ``sweep``; of two columns, that of their difference."""

    source: str | tuple[str, str]
    span: int


SWEEP_ROWS = 20_000  # whole histories are worked out together up to about that many rows


def sweep(df: DataFrame, windows: Mapping[str, Rolling | Exponential], at: str) -> DataFrame:
    """The named windows of each history, added as columns in one pass over rows that lie by code and date.

    A window expression goes through its n rows again for each row, one by one, and an exponential mean sorts anew. Here a
    frame's n additions run over whole columns of Arrow batches, from the oldest row to the newest as Spark adds them, so
    means, sums and deviations have the same bits. ``at`` names the row number in the history, which Spark gave with an
    exchange by code and a sort; a task holds some ``SWEEP_ROWS`` rows and the history that they end in. A window may take
    an earlier one as its source.
    """
    plan = [(name, "exponential", w.source, w.span, False) if isinstance(w, Exponential) else (name, w.kind, w.source, w.n, w.strict) for name, w in windows.items()]
    kind = T.StructType([f for f in df.schema.fields if f.name not in windows] + [T.StructField(name, T.DoubleType()) for name in windows])
    return df.drop(*windows).sortWithinPartitions("code", "date").mapInArrow(_swept(plan, at, SWEEP_ROWS), kind)


def _swept(plan: Sequence[tuple], at: str, least: int) -> Callable:
    def run(batches):  # has its imports and helpers inside, so that tasks need nothing of this package
        import numpy as np
        import pandas as pd
        import pyarrow as pa

        gap = max((n for _, kind, _, n, _ in plan if kind != "exponential"), default=1) - 1

        def worked_out(rows):
            first = rows.column(at).to_numpy() == 1
            history = np.cumsum(first) - 1
            place = np.arange(len(first)) + gap * (history + 1)  # ``gap`` empty places before each history
            size = len(first) + gap * (history[-1] + 1)
            known, laid = {}, {}

            def source(name):
                if isinstance(name, tuple):
                    (a, seen), (b, _) = known[name[0]], known[name[1]]
                    return a - b, seen
                if name not in known:
                    column = rows.column(name)
                    known[name] = column.cast(pa.float64()).fill_null(0.0).to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
                return known[name]

            def spread(name):
                if name not in laid:
                    x, valid = np.zeros(size), np.zeros(size, bool)
                    x[place], valid[place] = source(name)
                    laid[name] = x, valid, np.cumsum(valid)
                return laid[name]

            def rolled(kind, name, n, strict):
                x, valid, seen = spread(name)
                counts = seen[place] - np.where(place >= n, seen[place - n], 0)
                there = counts == n if strict else counts > 0
                if kind != "std":
                    total = np.zeros(size - gap)
                    for back in range(n - 1, -1, -1):
                        total += x[gap - back : size - back]
                    total = total[place - gap]
                    return total / np.maximum(counts, 1) if kind == "mean" else total, there
                so_far, mean, squares = (np.zeros(size - gap) for _ in range(3))
                for back in range(n - 1, -1, -1):
                    own = valid[gap - back : size - back]
                    so_far += own
                    off = np.where(own, x[gap - back : size - back] - mean, 0.0)
                    step = off / np.maximum(so_far, 1.0)
                    mean += step
                    squares += off * (off - step)
                return np.sqrt(squares[place - gap] / np.maximum(counts - 1, 1)), there & (counts > 1)

            def exponential(name, span):
                x, valid = source(name)
                series = pd.Series(np.where(valid, x, np.nan))
                mean = series.groupby(history).ewm(span=span, adjust=False).mean().to_numpy()
                seen = np.cumsum(valid)
                before = (seen - valid)[first][history]  # values of the histories that came before
                return mean, seen > before

            for name, kind, of, n, strict in plan:
                known[name] = exponential(of, n) if kind == "exponential" else rolled(kind, of, n, strict)
                rows = rows.append_column(name, pa.array(known[name][0], pa.float64(), mask=~known[name][1]))
            return rows.to_batches()

        held, count = [], 0
        with np.errstate(all="ignore"):
            for batch in batches:
                held.append(batch)
                count += batch.num_rows
                if count < least or not (batch.column(at).to_numpy() == 1).any():
                    continue
                rows = pa.Table.from_batches(held).combine_chunks()
                cut = int(np.flatnonzero(rows.column(at).to_numpy() == 1)[-1])  # the last history may go on
                if cut:
                    yield from worked_out(rows.slice(0, cut).combine_chunks())
                held, count = rows.slice(cut).to_batches(), rows.num_rows - cut
            if count:
                yield from worked_out(pa.Table.from_batches(held).combine_chunks())

    return run


def running_product(value: Column | str) -> Column:
    return F.product(col(value)).over(so_far())


DECAY = 44.0  # exp(-44) is below double precision


def _losses(q: float, gaps: range) -> list[float]:
    return [min(DECAY + 2, -math.log(max(q**d / (q**d + 1 - q), 1e-300))) for d in gaps]


def _same_blocks(spans: Sequence[tuple[str, str, int]]) -> list[list[tuple[str, str, int]]]:
    """Spans that can share their blocks: those of the slowest, while exp(E) of the others stays a double."""
    groups: list[list[tuple[str, str, int]]] = []
    for one in sorted(spans, key=lambda s: -s[2]):
        fast, slow = (_losses(1 - 2.0 / (n + 1), range(1, 2000)) for n in (one[2], groups[-1][0][2] if groups else one[2]))
        fits = groups and groups[-1][0][0] == one[0] and max(f / s for f, s in zip(fast, slow)) * (2 * DECAY + 2) < 650
        groups[-1].append(one) if fits else groups.append([one])
    return groups


def ewma(df: DataFrame, spans: Sequence[tuple[str, str, int]], order: Sequence[str] = ("date",), block: str | None = None) -> DataFrame:
    """Exponential means y0 = x0, y = (1-a) y + a x with a = 2 / (span + 1), over rows that may have gaps.

    ``spans`` lists (input column, output column, span). A missing input carries the mean on; the next value then meets a
    mean that has aged by d rows: y = (q^d y + a x) / (q^d + a) with q = 1-a, which for d = 1 is the line above. Before the
    first value there is no mean.

    With y_t = c_t y_(t-1) + (1-c_t) x_t a row keeps exp(-(E_t - E_i)) of row i, where E sums -ln c. A history is cut into
    blocks where E passes a multiple of ``DECAY``. Inside a block weights are running sums, scaled by exp(E) from the block's
    start; of what lies before, only the previous block still counts, through its last row. So a row costs a few running
    sums whatever the span, on one exchange by code and without Python.

    Rows come out sorted by code, block and date. With ``block`` the last block's number is kept under that name; it follows
    the dates, so a second mean in the ``order`` (block, date) takes the rows as they lie.
    """
    columns = [c for c in df.columns if c not in {t for _, t, _ in spans}]
    w = Window.partitionBy("code").orderBy(*order)
    earlier, so_long = (w.rowsBetween(Window.unboundedPreceding, end) for end in (-1, 0))
    sources = list(dict.fromkeys(s for s, *_ in spans))
    df = df.withColumn("_row", F.row_number().over(w))
    seen = {s: F.max(F.when(F.col(s).isNotNull(), F.col("_row"))).over(earlier) for s in sources}
    df = df.withColumns({f"_gap_{s}": F.col("_row") - at for s, at in seen.items()}).drop("_row")
    losses = {}
    for source, t, span in spans:
        a = 2.0 / (span + 1)
        q, gap = 1.0 - a, F.col(f"_gap_{source}")
        aged = F.pow(F.lit(q), gap)
        kept = F.when(gap == 1, q).otherwise(F.greatest(aged / (aged + a), F.lit(math.exp(-DECAY - 2))))
        losses[f"_loss_{t}"] = F.when(F.col(source).isNull() | gap.isNull(), 0.0).otherwise(-F.log(kept))
    df = df.withColumns(losses)
    groups = _same_blocks(spans)
    df = df.withColumns({f"_block_{i}": F.floor(F.sum(f"_loss_{own[0][1]}").over(so_long) / DECAY) for i, own in enumerate(groups)})
    for i, own in enumerate(groups):
        inside = Window.partitionBy("code", f"_block_{i}").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        along = Window.partitionBy("code").orderBy(f"_block_{i}", "date")
        df = df.withColumns({f"_e_{t}": F.sum(f"_loss_{t}").over(inside) for _, t, _ in own})
        added = {}
        for source, t, _ in own:
            share = F.when(F.col(f"_gap_{source}").isNull(), 1.0).otherwise(-F.expm1(-F.col(f"_loss_{t}")))
            added[f"_in_{t}"] = F.sum(F.col(source) * share * F.exp(f"_e_{t}")).over(inside)
        df = df.withColumns(added)
        df = df.withColumns({f"_in_{t}": F.coalesce(F.col(f"_in_{t}") * F.exp(-F.col(f"_e_{t}")), F.lit(0.0)) for _, t, _ in own})
        df = df.withColumns({f"_last_{t}": F.lag(f"_in_{t}", 1, 0.0).over(along) for _, t, _ in own})
        df = df.withColumns({f"_last_{t}": F.first(f"_last_{t}").over(inside) for _, t, _ in own})
        for source, t, _ in own:
            begun = F.col(source).isNotNull() | F.col(f"_gap_{source}").isNotNull()
            df = df.withColumn(t, F.when(begun, F.col(f"_in_{t}") + F.col(f"_last_{t}") * F.exp(-F.col(f"_e_{t}"))))
    kept = [F.col(f"_block_{len(groups) - 1}").alias(block)] if block else []
    return df.select(*columns, *[t for _, t, _ in spans], *kept)
