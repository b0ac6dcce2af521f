"""When forecasts are sealed, as a stream: event-time timers that wait for earlier contests, seal once and note misses.

Rows say at an instant what a team's contest is: scheduled, in progress, delayed or final. The rules look at a team's
contests at event times only, so rows that come out of order, but before the watermark, give what the batch gives
(operators.sealing.seal_times): a row waits until the watermark has passed it, and contests set timers for the instants
at which a rule may come true.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from contestlab.operators.sealing import BLOCKING_DAYS, CLOSED_DAYS, FALLBACK_HOURS, FINAL_MINUTES, LEAD_HOURS, OPEN_STATUSES, ROLL_HOUR

HOUR, DAY = 3_600_000_000, 86_400_000_000  # microseconds
ROW, GAME = "at long, ord long, game string, status string, hours int", "first long, start long, status string, morning boolean, final boolean"
DECISION = "team long, game string, decision string, at timestamp, incomplete boolean"


class Contest:
    """One contest of a team, as far as the rows up to now tell."""

    def __init__(self, first: int, start: int, status: str, morning: bool = False, final: bool = False):
        self.first, self.start, self.status, self.morning, self.final = first, start, status, morning, final
        self.day = start // DAY

    def instants(self) -> list[int]:
        """When a rule may come true without a row."""
        return [self.day * DAY + ROLL_HOUR * HOUR, self.start - FALLBACK_HOURS * HOUR, self.start - FINAL_MINUTES * HOUR // 60, self.start, (self.day + CLOSED_DAYS) * DAY]

    def values(self) -> tuple:
        return self.first, self.start, self.status, self.morning, self.final


def walk(open_: dict[str, Contest], closed: set[str], rows: list[tuple], since: int, upto: int) -> list[tuple]:
    """Rows (at, ord, game, status, hours) at or before `upto`, and the clock from `since` to it -> decisions
    (game, what, at, incomplete); open_ and closed are brought up to date."""
    rows = sorted(rows)
    due = sorted({r[0] for r in rows} | {t for c in open_.values() for t in c.instants() if since < t <= upto})
    made, i = [], 0
    while due:
        now = due.pop(0)
        fresh = set()
        while i < len(rows) and rows[i][0] <= now:
            at, _, game, status, hours = rows[i]
            i += 1
            if game in open_:
                open_[game].status = status
            elif game not in closed:
                open_[game] = c = Contest(at, at + (LEAD_HOURS + hours) * HOUR, status)
                fresh |= {t for t in c.instants() if now < t <= upto}
        if fresh:
            due = sorted({*due, *fresh})
        for game, c in sorted(open_.items()):
            if now == c.start and c.morning and not c.final:
                made.append((game, "missed", now, False))
            if now < c.start and c.status == "scheduled":
                blocked = any(c.day - BLOCKING_DAYS <= o.day < c.day and o.status in OPEN_STATUSES for o in open_.values())
                opened = now >= c.day * DAY + ROLL_HOUR * HOUR and not blocked
                if not c.morning and (opened or now >= c.start - FALLBACK_HOURS * HOUR):
                    c.morning = True
                    made.append((game, "morning", now, blocked))
                if not c.final and now >= c.start - FINAL_MINUTES * HOUR // 60:
                    c.final = True
                    made.append((game, "final", now, blocked))
        for game in [g for g, c in open_.items() if now >= (c.day + CLOSED_DAYS) * DAY]:
            del open_[game]
            closed.add(game)
    return made


class Seals(StatefulProcessor):
    """State of a team: rows that the watermark hasn't passed, its open contests, and the names of closed ones."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", ROW)
        self.games = handle.getMapState("games", "game string", GAME)
        self.closed = handle.getMapState("closed", "game string", "day long")
        self.clock = handle.getValueState("clock", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            at = pdf["at"].astype("datetime64[us]").astype("int64")
            self.rows.appendList([(int(a), int(o), g, s, int(h)) for a, o, g, s, h in zip(at, pdf["ord"], pdf["game"], pdf["status"], pdf["hours"])])
            for ms in {-(-int(a) // 1000) for a in at}:
                self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        since = self.clock.get()[0] if self.clock.exists() else -(2**62)
        if since >= upto:
            return
        held = [tuple(r) for r in self.rows.get()]
        rows = [r for r in held if r[0] <= upto]
        open_ = {k[0]: Contest(*v) for k, v in self.games.iterator()}
        before, closed = set(open_), {g for g in {r[2] for r in rows} - set(open_) if self.closed.containsKey((g,))}
        known = set(closed)
        made = walk(open_, closed, rows, since, upto)
        self.rows.put([r for r in held if r[0] > upto]) if len(rows) < len(held) else self.rows.clear()
        for game in closed - known:
            self.closed.updateValue((game,), (upto // DAY,))
        for game in before - set(open_):
            self.games.removeKey((game,))
        for game, c in open_.items():
            self.games.updateValue((game,), c.values())
            for t in c.instants():
                if t > upto:
                    self.handle.registerTimer(-(-t // 1000))
        self.clock.update((upto,))
        if made:
            out = pd.DataFrame([(key[0], *m) for m in made], columns=["team", "game", "decision", "at", "incomplete"])
            out["at"] = pd.to_datetime(out["at"], unit="us")
            yield out

    def close(self) -> None:
        pass


def seals(feed: DataFrame, late: str = "1 day") -> DataFrame:
    """feed(team, at, ord, game, status, hours) as a stream -> decisions (team, game, decision, at, incomplete).

    Rows may come up to `late` out of order. A contest starts LEAD_HOURS and `hours` after its first row; a team's state
    is its open contests, three days of them, and the names of those closed. Keep it in RocksDB."""
    rows = feed.withWatermark("at", late).groupBy("team")
    return rows.transformWithStateInPandas(Seals(), DECISION, "Append", "EventTime")
