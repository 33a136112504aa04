"""The driver's tables read as packets, owners and web sessions, by arithmetic alone; each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PORTS = {"click": 443, "view": 80, "purchase": 8443, "signup": 22, "error": 53}
HOUR, DAY = 3_600_000_000, 86_400_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event is a packet of its user to one of 37 hosts."""
    kind, user = F.col("event_type"), F.col("user_id")
    port = None
    for name, number in PORTS.items():
        port = (F if port is None else port).when(kind == name, F.lit(number))
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        (F.lit(167_772_160) + user).alias("src_ip4"), (F.lit(3_232_235_776) + F.col("event_id") % 37).alias("dst_ip4"),
        (F.lit(40_000) + user % 1000).alias("src_port"), port.cast("long").alias("dst_port"), F.when(kind == "error", 17).otherwise(6).cast("long").alias("proto"),
        (F.lit(40) + F.round(F.col("value") * 10).cast("long")).alias("len"), kind.alias("kind"), user.alias("user_id"), "value",
    )


P = """p AS (
  SELECT event_id AS seq, epoch_us(ts) AS ts_us, 167772160 + user_id AS src_ip4, 3232235776 + event_id % 37 AS dst_ip4, 40000 + user_id % 1000 AS src_port,
         (CASE event_type WHEN 'click' THEN 443 WHEN 'view' THEN 80 WHEN 'purchase' THEN 8443 WHEN 'signup' THEN 22 WHEN 'error' THEN 53 END)::BIGINT AS dst_port,
         (CASE WHEN event_type = 'error' THEN 17 ELSE 6 END)::BIGINT AS proto, 40 + round(value * 10)::BIGINT AS len, event_type AS kind, user_id, value FROM events
)"""


def two_way(p: DataFrame) -> DataFrame:
    """Every third packet is an answer: its ends change places."""
    back = F.col("seq") % 3 == 0
    swap = lambda a, b: F.when(back, F.col(b)).otherwise(F.col(a))
    return p.withColumns({f"{a}_{x}": swap(f"{a}_{x}", f"{b}_{x}") for a, b in (("src", "dst"), ("dst", "src")) for x in ("ip4", "port")})


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id and region of the customers; a fifth of the users have none."""
    c = read(spark, sf_dir, "customer").filter("c_custkey % 5 <> 0")
    n = c.join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.col("c_custkey").alias("user_id"), F.col("r_name").alias("owner"))


OWNERS = """owners AS (
  SELECT c_custkey AS user_id, r_name AS owner FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 5 <> 0
)"""


def web(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", "://([^/:]+)", 1)).alias("http_host"), F.regexp_extract("url", "://[^/]+(/[^?#]*)", 1).alias("http_path"), "url")


WEB = """web AS (
  SELECT page_id, lower(regexp_extract(url, '://([^/:]+)', 1)) AS http_host, regexp_extract(url, '://[^/]+(/[^?#]*)', 1) AS http_path, url FROM pages
)"""
