"""Bursts in streams by keyed state: trailing counts at each event, and message bursts within a join session.

Both operators hold rows back until the watermark has passed them, so rows that come in any order within ``guild.DELAY`` give the
answers of a batch over all of them; rows that come later than that are dropped before they reach the state. State ends by event-time
timers: what the span or the session no longer needs goes. Ids must not be NULL; rows of NULL time are late rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from authscope.streaming.guild import DELAY

#: Groups that the keys of a part of time are dealt to: each costs calls to the state and timers, so many sparse keys share one.
BUCKETS = 64
#: Groups that all keys of join sessions are dealt to.
SESSION_BUCKETS = 1024


def micros() -> Column:
    return F.unix_micros("ts")


class Timed(StatefulProcessor):
    """Rows of a key in a list, and one timer at a time for the earliest thing that is due."""

    columns: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.columns)
        self.due = handle.getValueState("due", "at long")

    def wake(self, at: int | None) -> None:
        """A timer at the microsecond ``at``, in place of a later one."""
        if at is not None:
            at, set_for = at // 1000 + 1, self.due.get()[0] if self.due.exists() else None
            if set_for is None or at < set_for:
                if set_for is not None:
                    self.handle.deleteTimer(set_for)
                self.handle.registerTimer(at)
                self.due.update((at,))

    def taken(self, frames: Iterator[pd.DataFrame], *names: str) -> None:
        """New rows go to the list, batch by batch."""
        for f in frames:
            new = list(zip(*(f[n].tolist() for n in names)))
            self.rows.appendList(new)
            self.wake(min(r[0] for r in new))

    def held(self) -> pd.DataFrame:
        names = [c.split()[0] for c in self.columns.split(", ")]
        return pd.DataFrame(list(self.rows.get()), columns=names).sort_values(names[:2], kind="stable")

    def keep(self, rows: pd.DataFrame) -> None:
        if len(rows):
            self.rows.put(list(rows.itertuples(index=False, name=None)))
        else:
            self.rows.clear()

    def close(self) -> None:
        pass


class Trailing(Timed):
    """Answers each asking row with the number of counting rows of the ``span`` microseconds up to it, its own time included."""

    def __init__(self, span: int, keys: dict[str, str], also: list[str]):
        self.span, self.names, self.also = span, list(keys), also
        self.held_as = [f"key{i}" for i in range(len(keys))]
        self.columns = ", ".join(["t long, id long, counts int, asks int", *(f"{c} long" for c in also), *(f"{c} {kind}" for c, kind in zip(self.held_as, keys.values()))])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.taken(rows, "t", "event_id", "counts", "asks", *self.also, *self.names)
        return iter(())

    def places(self, rows: pd.DataFrame) -> np.ndarray:
        """Times, each key's on a stretch of its own: the ``span`` before any of them holds no other key's."""
        t, number = rows["t"].to_numpy(), rows.groupby(self.held_as, sort=False, dropna=False).ngroup().to_numpy()
        return number * (t.max() - t.min() + self.span + 1) + (t - t.min()) + self.span

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, rows = timerValues.getCurrentWatermarkInMs() * 1000, self.held()
        self.due.clear()
        t, place = rows["t"].to_numpy(), self.places(rows)
        counting = np.sort(place[rows["counts"].to_numpy() == 1])
        asking = (rows["asks"].to_numpy() == 1) & (t <= now)
        ready, at = rows[asking], place[asking]
        n = np.searchsorted(counting, at, "right") - np.searchsorted(counting, at - self.span)
        rest = rows[(t > now - self.span) & ((rows["counts"] == 1) | (t > now))].copy()
        rest.loc[rest["t"] <= now, "asks"] = 0
        self.keep(rest)
        if len(rest):
            pending = rest["t"][rest["asks"] == 1]
            self.wake(int(pending.min()) if len(pending) else int(rest["t"].max()) + self.span)
        if len(ready):
            given = {"event_id": ready["id"].to_numpy()} | {name: ready[c].to_numpy() for name, c in zip(self.names, self.held_as)} | {c: ready[c].to_numpy() for c in self.also}
            yield pd.DataFrame(given | {"ts": pd.to_datetime(ready["t"].to_numpy(), unit="us", utc=True), "n": n})


def trailing_counts(df: DataFrame, keys: list[str], span: int, counts: Column | None = None, asks: Column | None = None, also: tuple[str, ...] = (), delay: str | None = DELAY) -> DataFrame:
    """(event_id, keys, also, ts, n): for each row that ``asks``, the rows of its keys that ``counts`` in the trailing ``span`` seconds, as of its time.

    ``also``: whole numbers that go along. Without ``delay`` the rows have a watermark on ts already.

    A key's rows are dealt to parts of time, so that a hot key neither meets in one group nor keeps state for longer than a part; a row
    within ``span`` of the next part's begin counts there too. The keys of a part are dealt to ``BUCKETS`` groups by hash.
    """
    size = max(span, 600) * 1_000_000
    t = micros()
    part = F.floor(t / size)
    rows = (df.withWatermark("ts", delay) if delay else df).select("event_id", *keys, *also, "ts", t.alias("t"), (F.lit(True) if counts is None else counts).cast("int").alias("counts"), (F.lit(True) if asks is None else asks).cast("int").alias("asks"), part.alias("own"))
    near = (F.col("own") + 1) * size - F.col("t") <= span * 1_000_000
    rows = rows.withColumn("part", F.explode(F.when(near & (F.col("counts") == 1), F.array("own", F.col("own") + 1)).otherwise(F.array("own"))))
    rows = rows.withColumn("asks", F.when(F.col("part") == F.col("own"), F.col("asks")).otherwise(0)).drop("own")
    kinds = {k: df.schema[k].dataType.simpleString() for k in keys}
    out = ", ".join([*(f"{k} {kind}" for k, kind in kinds.items()), *(f"{c} long" for c in also)])
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
    return rows.groupBy("bucket", "part").transformWithStateInPandas(Trailing(span * 1_000_000, kinds, list(also)), f"event_id long, {out}, ts timestamp, n long", "append", "eventtime")


class Sessions(Timed):
    """The first message of a join session that is the ``least``-th within ``span``; a session lasts ``within`` from its join, or until the next."""

    def __init__(self, span: int, least: int, within: int, keys: dict[str, str]):
        self.span, self.least, self.within, self.names = span, least, within, list(keys)
        kinds = ", ".join(f"key{i} {kind}" for i, kind in enumerate(keys.values()))
        self.columns, self.kept_as = f"t long, is_message int, id long, answered int, {kinds}", f"joined long, join_id long, told int, {kinds}"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.sessions = handle.getListState("sessions", self.kept_as)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.taken((f.assign(answered=0) for f in rows), "t", "is_message", "event_id", "answered", *self.names)
        return iter(())

    def of_key(self, rows: list[tuple], session: tuple, now: int) -> tuple[list[tuple], list[tuple], tuple | None, int | None]:
        """What one key's rows up to ``now`` find, the rows and the session that stay, and when something is due."""
        times = [r[0] for r in rows if r[1] == 1]
        (joined, join_id, told), found = session, []
        for t, is_message, i, answered in rows:
            if answered or t > now:
                continue
            if not is_message:
                joined, join_id, told = t, i, 0
            elif joined is not None and not told and t - joined <= self.within:
                n = bisect_right(times, t) - bisect_left(times, t - self.span)
                if n >= self.least:
                    found.append((i, join_id, t, n))
                    told = 1
        rest = [(t, m, i, 1 if t <= now else a) for t, m, i, a in rows if t > now or (m == 1 and t > now - self.span)]
        stays = (joined, join_id, told) if joined is not None and joined + self.within > now else None
        pending = [r[0] for r in rest if not r[3]]
        ends = [stays[0] + self.within] if stays else []
        return found, rest, stays, min(pending) if pending else max([*ends, *([max(r[0] for r in rest) + self.span] if rest else [])], default=None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, rows = timerValues.getCurrentWatermarkInMs() * 1000, defaultdict(list)
        self.due.clear()
        for r in map(tuple, self.rows.get()):
            rows[r[4:]].append(r[:4])
        open_ = {tuple(s)[3:]: tuple(s)[:3] for s in self.sessions.get()} if self.sessions.exists() else {}
        found, kept, sessions, due = [], [], [], []
        for k in [*rows, *(k for k in open_ if k not in rows)]:
            told, rest, stays, at = self.of_key(sorted(rows.get(k, []), key=lambda r: r[:3]), open_.get(k, (None, None, 0)), now)
            found += [f + k for f in told]
            kept += [r + k for r in rest]
            sessions += [stays + k] if stays else []
            due += [at] if at is not None else []
        for state, now_held in ((self.rows, kept), (self.sessions, sessions)):
            state.put(now_held) if now_held else state.clear()
        self.wake(min(due, default=None))
        if found:
            event_id, join_id, t, n, *keys = zip(*found)
            yield pd.DataFrame({"event_id": event_id, "join_id": join_id} | dict(zip(self.names, keys)) | {"ts": pd.to_datetime(list(t), unit="us", utc=True), "n": n})


def message_bursts(df: DataFrame, keys: list[str], span: int, least: int, within: int, is_message: Column) -> DataFrame:
    """(event_id, join_id, keys, ts, n): of each join, the first message of the ``within`` seconds after it that has ``least`` messages or more in the trailing ``span``.

    ``df`` holds joins and messages. A message belongs to the last join at or before its time; messages before the join count in the span.
    One key's messages of a batch meet in one group, batch by batch; the keys are dealt to ``SESSION_BUCKETS`` groups by hash.
    """
    rows = df.withWatermark("ts", DELAY).select("event_id", *keys, "ts", micros().alias("t"), is_message.cast("int").alias("is_message"))
    kinds = {k: df.schema[k].dataType.simpleString() for k in keys}
    out = ", ".join(f"{k} {kind}" for k, kind in kinds.items())
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(SESSION_BUCKETS)).cast("int"))
    return rows.groupBy("bucket").transformWithStateInPandas(Sessions(span * 1_000_000, least, within * 1_000_000, kinds), f"event_id long, join_id long, {out}, ts timestamp, n long", "append", "eventtime")
