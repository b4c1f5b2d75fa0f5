"""Episodes of a key's events in order of time: state with timers on a stream, carried ordered scans on a table.

An episode ends with a closing event, or when nothing follows for longer than `gap`. A session window can't say so, as the
closing event cuts by order. On a stream a key's rows wait in its state until the watermark has passed them, are then taken
in order, and the key is forgotten when its episode has ended and no row waits; rows later than the watermark don't count.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomframe.operators import ordered

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RESULT = "user_id long, first timestamp, last timestamp, n long, total double, ended string"


class _Episodes(StatefulProcessor):
    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event_id long, value double, closes boolean")
        self.open = handle.getValueState("open", "first long, last long, n long, total double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh, passed = [], timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            at = pdf["ts"].astype("datetime64[ms]").astype("int64")
            fresh += [(int(t), int(i), float(v), bool(c)) for t, i, v, c in zip(at, pdf["event_id"], pdf["value"], pdf["closes"], strict=True) if t > passed]
        if fresh:
            self.waiting.appendList(fresh)
            self.handle.registerTimer(min(r[0] for r in fresh))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(r) for r in self.waiting.get())
        now = self.open.get() if self.open.exists() else None
        done, later = [], [r for r in rows if r[0] > passed]
        for at, _, value, closes in (r for r in rows if r[0] <= passed):
            if now and at - now[1] > self.gap:
                done.append((*now, "gap"))
                now = None
            now = (now[0] if now else at, at, (now[2] if now else 0) + 1, (now[3] if now else 0.0) + value)
            if closes:
                done.append((*now, "closed"))
                now = None
        if now and passed > now[1] + self.gap:
            done.append((*now, "gap"))
            now = None
        self.waiting.put(later) if later else self.waiting.clear()
        self.open.update(now) if now else self.open.clear()
        if later or now:
            self.handle.registerTimer(min([r[0] for r in later] + ([now[1] + self.gap + 1] if now else [])))
        if done:
            stamp = lambda i: pd.to_datetime([d[i] for d in done], unit="ms")
            yield pd.DataFrame({"user_id": [key[0]] * len(done), "first": stamp(0), "last": stamp(1), "n": [d[2] for d in done], "total": [d[3] for d in done], "ended": [d[4] for d in done]})

    def close(self) -> None:
        pass


def stream_episodes(df: DataFrame, closes: Column, gap_s: int = 1800, late: str = "2 hours") -> DataFrame:
    """Ended episodes of each user_id of a stream (event_id, ts, user_id, value): first, last, n, total and ended (gap or closed).

    The session is to keep its state in RocksDB (ROCKS), as keyed state with timers needs.
    """
    rows = df.withWatermark("ts", late).select("user_id", "event_id", "ts", F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce(closes, F.lit(False)).alias("closes"))
    return rows.groupBy("user_id").transformWithStateInPandas(_Episodes(gap_s * 1000), RESULT, "Append", "EventTime")


def episodes(df: DataFrame, closes: Column, gap_s: int = 1800) -> DataFrame:
    """The same of a table; ended is open for a user's last episode where nothing has ended it. Any user's rows may be most of all."""
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = df.select("user_id", "ts", F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce(closes, F.lit(False)).alias("closes"), "event_id", at.alias("_ms")).filter("ts is not null")
    rows = ordered.pieces(rows, ["user_id"], ["_ms", "event_id"])
    rows = ordered.before(rows, _previous=(F.max, F.struct(ordered.AT, "_ms", "closes")))
    fresh = F.col("_previous").isNull() | F.col("_previous.closes") | (F.col("_ms") - F.col("_previous._ms") > gap_s * 1000)
    rows = ordered.before(rows.withColumn("_new", F.when(fresh, F.col(ordered.AT))), _open=(F.max, F.col("_new")))
    rows = rows.withColumn("_run", F.coalesce("_new", "_open"))
    end = F.max(F.struct(ordered.AT, "closes"))
    out = rows.groupBy("user_id", "_run").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"), F.sum("value").alias("total"), end["closes"].alias("_closed"))
    newest = rows.groupBy("user_id").agg(F.max("_run").alias("_newest"))
    out = out.join(newest, "user_id")
    ended = F.when(F.col("_closed"), "closed").when(F.col("_run") < F.col("_newest"), "gap").otherwise("open")
    return out.select("user_id", "first", "last", "n", "total", ended.alias("ended"))
