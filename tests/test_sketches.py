"""Sketches within their bounds, merged over windows; broken rows set apart; health of a stream."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tidewire.operators import sketches
from tidewire.plans import live
from tidewire.sources import services
from tidewire.streaming import policy


@pytest.mark.parametrize("error", [0.01, 0.05])
def test_quantiles_are_within_their_error(spark, error):
    rng = random.Random(1)
    rows = [(i % 2, rng.randrange(1000), rng.choice([rng.lognormvariate(3, 4), -rng.lognormvariate(0, 2), 0.0])) for i in range(3000)]
    rows += [(0, 5, None), (0, 5, float("nan"))]
    df = spark.createDataFrame(rows, "k int, ts_us long, v double").repartition(3)
    at = [0.0, 0.1, 0.5, 0.95, 0.999, 1.0]
    counts = sketches.log_counts(df, ["k"], "v", 100, error)
    for n in (1, 3):
        got = sketches.quantiles(counts, ["k"], at, error, n).collect()
        assert {r.bucket for r in got} == set(range(10 + n - 1))
        for r in got:
            own = sorted(v for k, t, v in rows if k == r.k and r.bucket - n < t // 100 <= r.bucket and v is not None and not math.isnan(v))
            assert r.n == len(own)
            for q in at:
                true = own[int(q * (len(own) - 1))]
                assert abs(r[f"q{q * 100:g}".replace(".", "_")] - true) <= error * abs(true) * (1 + 1e-9)


def test_heavy_hitters_merge(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(400), f"x{min(rng.randrange(1, 60), rng.randrange(1, 60))}") for _ in range(5000)] + [(3, None)]
    df = spark.createDataFrame(rows, "ts_us long, item string").repartition(4)
    states = sketches.frequent(df, [], "item", 100, 200)
    got = sketches.heavy(states, [], 5, 2, 200).collect()
    for b in range(5):
        count = {}
        for t, x in rows:
            if x is not None and b - 2 < t // 100 <= b:
                count[x] = count.get(x, 0) + 1
        own = [(r.item, r.n) for r in got if r.bucket == b]
        assert len(own) == 5 and all(count[x] == n for x, n in own)
        assert sorted(n for _, n in own) == sorted(sorted(count.values())[-5:])
    many = [(i, f"y{i % 3000}") for i in range(9000)] + [(i, "big") for i in range(3000)]
    top = sketches.heavy(sketches.frequent(spark.createDataFrame(many, "ts_us long, item string"), [], "item", 1 << 40, 128), [], 1, 1, 128).first()
    assert top.item == "big" and abs(top.n - 3000) <= 12_000 * 3.5 / 128


def test_broken_rows_and_health(spark, tmp_path):
    health = policy.watch(spark)
    try:
        good = bytes.fromhex("3014020101040670 75626c6963a507020101".replace(" ", ""))
        rows = [(0, bytes.fromhex("300e020101040670 75626c6963a501 00".replace(" ", ""))), (1, b"\x30"), (2, None), (3, b"\x30\x05\x02\x01\x09\x04\x00"), (4, good)]
        spark.createDataFrame(rows, "n long, payload binary").withColumn("ts", F.current_timestamp()).repartition(1).write.parquet(str(tmp_path / "in"))
        s = spark.readStream.schema("n long, payload binary, ts timestamp").parquet(str(tmp_path / "in")).withWatermark("ts", "1 minute")
        c = policy.checked(s, "payload", services.snmp_message, "snmp_version string, snmp_op string")
        run = lambda out: policy.parted(c, f"{tmp_path}/{out}/good", f"{tmp_path}/{out}/bad", f"{tmp_path}/{out}/state")
        q = run("one")
        q.awaitTermination(60)
        kept = spark.read.parquet(f"{tmp_path}/one/good")
        bad = {r.n: r.error for r in spark.read.parquet(f"{tmp_path}/one/bad").collect()}
        assert [(r.n, r.snmp_version, r.snmp_op) for r in kept.collect()] == [(0, "2c", "get_bulk")] and "error" not in kept.columns
        assert bad[2] == "no payload" and bad[3] == "no such message" and bad[1].startswith("IndexError") and bad[4].startswith("ValueError")
        q = run("one")  # nothing new: nothing twice
        q.awaitTermination(60)
        assert spark.read.parquet(f"{tmp_path}/one/good").count() == 1
        for _ in range(50):
            told = health.told()
            if told and all(not x["live"] for x in told.values()):
                break
            time.sleep(0.1)
        states = list(health.told().values())
        assert [(x["rows"] >= 5, x["error"], x["batches"] >= 1, x["lag_s"] is not None) for x in states] == [(True, None, True, True)], states

        def fail(batch, n):
            raise RuntimeError("poison")

        q = c.writeStream.foreachBatch(fail).queryName("failing").option("checkpointLocation", f"{tmp_path}/two").trigger(availableNow=True).start()
        with pytest.raises(Exception, match="poison"):
            q.awaitTermination(60)
        for _ in range(50):
            if health.told()["failing"]["error"]:
                break
            time.sleep(0.1)
        assert "poison" in health.told()["failing"]["error"] and not health.healthy() and not health.told(stale_s=-1)["failing"]["live"]
    finally:
        spark.streams.removeListener(health)


def test_heaviest_is_exact_with_many_items(spark):
    rows = [(t, f"x{i}") for t in (1, 101, 202) for i in range(5000) if i % (t % 3 + 1) == 0] + [(5, "x0"), (205, None)]
    counts = sketches.item_counts(spark.createDataFrame(rows, "ts_us long, item string").repartition(3), [], "item", 100)
    all_ = {}
    for t, x in rows:
        for d in range(2):
            all_[t // 100 + d, x] = all_.get((t // 100 + d, x), 0) + 1
    assert {(r.bucket, r["item"]): r.n for r in sketches.heaviest(counts, [], None, 2).collect()} == all_
    top = sketches.heaviest(counts, [], 2, 2).collect()
    for b in range(4):
        own = sorted((-n, x or "") for (at, x), n in all_.items() if at == b)[:2]
        assert sorted((-r.n, r["item"] or "") for r in top if r.bucket == b) == own


def test_heavy_hitters_of_many_senders(spark, tmp_path):
    """More senders than the sketch's capacity held: each counts once."""
    e = spark.range(9000).selectExpr("id AS event_id", "timestamp_micros(1704067200000000 + id) AS ts", "id AS user_id", "'click' AS event_type", "1.0D AS value")
    e.write.parquet(str(tmp_path / "events.parquet"))
    got = live.heavy_hitters(spark, str(tmp_path)).collect()
    assert sorted((r.bucket, r.n_items, r.total, r.most) for r in got) == [(19723 + d, 9000, 9000, 1) for d in range(3)]
