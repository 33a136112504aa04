"""Queries held against their twins over tables with keys that the small tables do not reach."""

import pytest

from tidewire.plans import queries

USERS = [0, 5, 10, 65530, 65534, 65535, 65536, 65540, 65545, 70000, 131070, 131075, 1048575, 1048580]


@pytest.mark.parametrize("name", ["dns_answers", "dual_stack_history", "dual_stack_log", "flows_ip6", "frame_fields", "icmp_errors_of_both"])
def test_addresses_beyond_four_hex_digits(spark, tmp_path, name):
    import duckdb

    rows = [(i * len(USERS) + k, i * 9000 + k, u, ("click", "view", "signup", "error", "purchase")[(i + k) % 5], float(i)) for i in range(10) for k, u in enumerate(USERS)]
    at = str(tmp_path / "events.parquet")
    spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double").selectExpr("event_id", "timestamp_seconds(1704067200 + s) AS ts", "user_id", "event_type", "value").write.parquet(at)
    df = queries.queries()[name](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    c.execute(f"CREATE VIEW events AS SELECT event_id, ts::TIMESTAMP AS ts, user_id, event_type, value FROM '{at}/*.parquet'")
    c.execute(f"CREATE TABLE want AS {queries.oracle_sql()[name]}")
    want = c.execute(f"SELECT {', '.join(df.columns)} FROM want").fetchall()
    assert want and sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.collect())
