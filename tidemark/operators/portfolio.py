"""Several books over the same signals: shared equity, exits, entries at the next open, limits, a drawdown breaker.

The rows of a book pass in the order of days through ``mapInPandas``; the state is the book's open positions and its equity, so
that memory doesn't grow with history. Books are independent: a grid of configurations spreads over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "book string, d date, equity double, gross double, n_open int, n_closed int, realised double, state string"


class Book:
    """Order within a day: exits at this bar's levels, entries at this bar's open of what was wanted at the last close (the best
    scores first, as far as slots and gross exposure go), marking to the close, breaker, wishes for the next bar."""

    def __init__(self, risk: float, slots: int, max_gross: float, stop: float, target: float, halt: float) -> None:
        self.risk, self.slots, self.max_gross, self.stop, self.target, self.halt = risk, slots, max_gross, stop, target, halt
        self.equity = self.peak = 1.0
        self.open: dict[str, list[float]] = {}
        self.wanted: list[tuple[float, str, int]] = []
        self.halted = False

    def day(self, rows: list[tuple]) -> tuple:
        """rows: (instrument, o, h, l, c, signal, score) of one day. Positions hold [side, weight, entry, last price]."""
        bars = {r[0]: r[1:] for r in rows}
        closed, realised = 0, 0.0
        for name in sorted(set(self.open) & set(bars)):
            side, weight, entry, last = self.open[name]
            o, h, low = bars[name][:3]
            stop, target = entry * (1 - side * self.stop), entry * (1 + side * self.target)
            stopped = low <= stop if side > 0 else h >= stop
            if stopped or (h >= target if side > 0 else low <= target):
                level = stop if stopped else target
                price = o if (side * (o - level) < 0 if stopped else side * (o - level) > 0) else level
                self.equity += weight * side * (price - last) / entry
                realised += weight * side * (price - entry) / entry
                closed += 1
                del self.open[name]
        for _, name, side in self.wanted:
            if name in bars and name not in self.open and len(self.open) < self.slots and not self.halted:
                room = self.max_gross * self.equity - sum(p[1] for p in self.open.values())
                weight = min(self.equity * self.risk / self.stop, room)
                if weight > 0:
                    o = bars[name][0]
                    self.open[name] = [side, weight, o, o]
        for name, p in self.open.items():
            if name in bars:
                self.equity += p[1] * p[0] * (bars[name][3] - p[3]) / p[2]
                p[3] = bars[name][3]
        self.peak = max(self.peak, self.equity)
        self.halted = self.halted or self.equity < self.peak * (1 - self.halt)
        self.wanted = sorted((-float(score or 0), name, int(signal)) for name, _, _, _, _, signal, score in rows if signal)
        return self.equity, sum(p[1] for p in self.open.values()), len(self.open), closed, realised, "HALTED" if self.halted else "OK"


def books(signals: DataFrame, configs: DataFrame) -> DataFrame:
    """(book, d, equity, ...) for each of configs (book, risk, slots, max_gross, stop, target, halt) over signals (instrument, d, o, h, l, c, signal, score)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, rows = None, None, []
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if (r.book, r.d) != now:
                    if rows:
                        out.append((*now, *state.day(rows)))
                    if now is None or r.book != now[0]:
                        state = Book(r.risk, int(r.slots), r.max_gross, r.stop, r.target, r.halt)
                    now, rows = (r.book, r.d), []
                rows.append((r.instrument, r.o, r.h, r.l, r.c, 0 if pd.isna(r.signal) else r.signal, 0 if pd.isna(r.score) else r.score))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in SCHEMA.split(", ")])
        if rows:
            yield pd.DataFrame([(*now, *state.day(rows))], columns=[x.split()[0] for x in SCHEMA.split(", ")])

    # Configurations are a stated grid, small beside the signals.
    each = signals.crossJoin(F.broadcast(configs)).repartition("book").sortWithinPartitions("book", "d", "instrument")
    return each.mapInPandas(run, SCHEMA)
