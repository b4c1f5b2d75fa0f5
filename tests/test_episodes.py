"""Keyed state that ends: a stream against its batch twin, with late rows and keys that are forgotten."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomframe.streaming import episodes
from loomframe.streaming import events as E

START = dt.datetime(2024, 1, 1)


def event(i, minute, user, kind="view", value=1.0):
    return (i, START + dt.timedelta(minutes=minute), user, kind, value, "{}")


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, episodes.ROCKS)
    yield
    spark.conf.set(key, old)


def test_stream_and_table_agree(spark, rocks, tmp_path):
    first = [event(1, 0, 1), event(2, 10, 1), event(4, 12, 1, "purchase", 5.0), event(5, 13, 1), event(3, 11, 1, value=None), event(6, 0, 2), event(7, 100, 2)]
    second = [event(8, 95, 2), event(9, 300, 1), event(10, 14, 1)]  # 95 and 14 come out of order, but not too late
    third = [event(11, 900, 3), event(12, 20, 1)]  # the last is behind the watermark, 300 - 120
    last = [event(13, 2000, 9)]
    folder = tmp_path / "in"
    for k, rows in enumerate((first, second, third, last)):
        spark.createDataFrame(rows, E.EVENTS).coalesce(1).write.parquet(f"{folder}/{k}")
    closes = F.col("event_type") == "purchase"
    source = spark.readStream.schema(E.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    got = E.drain(episodes.stream_episodes(source, closes), "ended_episodes", checkpoint=str(tmp_path / "check")).collect()
    table = spark.createDataFrame(first + second + third[:1] + last, E.EVENTS)
    want = [r for r in episodes.episodes(table, closes).collect() if r["ended"] != "open" or r["user_id"] in (1, 2, 3)]
    plain = lambda rows: sorted((r["user_id"], r["first"], r["last"], r["n"], r["total"], "gap" if r["ended"] == "open" else r["ended"]) for r in rows)
    assert plain(got) == plain(want)
    assert [(r["n"], r["ended"]) for r in sorted(got, key=lambda r: r["first"]) if r["user_id"] == 1] == [(4, "closed"), (2, "gap"), (1, "gap")]
    held = spark.read.format("statestore").option("stateVarName", "open").load(str(tmp_path / "check")).count()
    assert held == 0  # the users' episodes have ended, and the last event waits behind the watermark


def test_one_user_of_all_events_and_no_events(spark):
    data = [event(i, i * 7 % 5000, 1, "purchase" if i % 50 == 0 else "view") for i in range(1200)]
    got = episodes.episodes(spark.createDataFrame(data, E.EVENTS), F.col("event_type") == "purchase").collect()
    rows, want, now = sorted((d[1], d[0], d[3]) for d in data), [], None
    for at, _, kind in rows:
        if now and (at - now[1]).total_seconds() > 1800:
            want.append((now[2], "gap"))
            now = None
        now = (now[0] if now else at, at, (now[2] if now else 0) + 1)
        if kind == "purchase":
            want.append((now[2], "closed"))
            now = None
    want += [(now[2], "open")] if now else []
    assert [(r["n"], r["ended"]) for r in sorted(got, key=lambda r: (r["first"], r["last"]))] == want
    assert episodes.episodes(spark.createDataFrame([], E.EVENTS), F.lit(False)).count() == 0
