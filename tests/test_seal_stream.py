"""The seal machine as a stream against the batch rules, rows out of order."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from contestlab.operators import sealing as Z
from contestlab.sources.views import status_feed
from contestlab.streaming import seals as S

FEED = "team long, at timestamp, ord long, game string, status string, hours int"


def day(n, hour=0, minute=0):
    return dt.datetime(2024, 3, 1) + dt.timedelta(days=n, hours=hour, minutes=minute)


def key(rows):
    return sorted((r.team, r.game, r.decision, r.at, r.incomplete) for r in rows)


def us(t):
    return int((t - dt.datetime(1970, 1, 1)).total_seconds() * 10**6)


def walked(rows, steps):
    """The stream's rules without a stream: the rows known at each of several watermarks."""
    made = []
    for team in {r[0] for r in rows}:
        own, open_, closed, since = [(us(r[1]), *r[2:]) for r in rows if r[0] == team], {}, set(), -(2**62)
        for upto in map(us, steps):
            made += [(team, g, w, dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=at), b) for g, w, at, b in S.walk(open_, closed, [r for r in own if since < r[0] <= upto], since, upto)]
            since = upto
    return sorted(made)


HAND = [
    (1, day(0, 1), 1, "a", "scheduled", 12),  # starts at 19:00 of day 0
    (1, day(0, 2), 2, "b", "scheduled", 40),  # at 48 h, day 2 at 0:00
    (1, day(1, 12), 3, "a", "final", 0),
    (2, day(0, 1), 4, "c", "scheduled", 12),
    (2, day(0, 17), 5, "c", "delayed", 0),  # through the last hour: missed
    (2, day(0, 2), 6, "d", "scheduled", 40),  # c stays delayed and blocks nothing
    (3, day(0, 1), 7, "e", "scheduled", 12),  # e is never resolved and holds f up until six hours before
    (3, day(0, 2), 8, "f", "scheduled", 40),
]


def test_by_hand(spark):
    got = key(Z.seal_times(spark.createDataFrame(HAND, FEED)).collect())
    assert got == [
        (1, "a", "final", day(0, 18), False), (1, "a", "morning", day(0, 6), False),
        (1, "b", "final", day(1, 23), False), (1, "b", "morning", day(1, 18), False),
        (2, "c", "missed", day(0, 19), False), (2, "c", "morning", day(0, 6), False),
        (2, "d", "final", day(1, 23), False), (2, "d", "morning", day(1, 18), False),
        (3, "e", "final", day(0, 18), False), (3, "e", "morning", day(0, 6), False),
        (3, "f", "final", day(1, 23), True), (3, "f", "morning", day(1, 18), True),
    ]


@pytest.mark.parametrize("seed", range(4))
def test_rules_equal_the_batch_whatever_the_watermarks(spark, seed):
    rng = random.Random(seed)
    kinds = ["scheduled", "scheduled", "in-progress", "delayed", "final"]
    rows = [(rng.randrange(3), day(rng.randrange(12), rng.randrange(24), rng.choice([0, 0, 30])), i, f"g{rng.randrange(12)}", rng.choice(kinds), rng.randrange(60)) for i in range(250)]
    want = key(Z.seal_times(spark.createDataFrame(rows, FEED)).collect())
    steps = sorted(day(rng.randrange(20), rng.randrange(24), rng.randrange(60)) for _ in range(rng.randrange(1, 9))) + [day(40)]
    assert walked(rows, steps) == want and {"morning", "final"} <= {w[2] for w in want}


def test_stream_out_of_order_equals_the_batch(spark, tmp_path):
    feed = status_feed(spark, "/root/testdata/sf0.001").where("team < 12 AND at < '2024-01-12'")
    rows = [tuple(r) for r in feed.select(*[c.split()[0] for c in FEED.split(", ")]).collect()]
    assert len(rows) > 20
    rng = random.Random(1)
    late = sorted(rows, key=lambda r: r[1] + dt.timedelta(hours=rng.uniform(0, 20)))
    n = len(late) // 3
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in (late[:n], late[n : 2 * n], late[2 * n :], [(-1, dt.datetime(2024, 3, 1), 10**9, "end", "final", 0)]):
            spark.createDataFrame(part, FEED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = S.seals(spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
        q = stream.writeStream.format("memory").queryName("seals").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
        q.awaitTermination(240)
        got = key(spark.table("seals").collect())
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == key(Z.seal_times(feed).collect()) and got
