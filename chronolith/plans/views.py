"""Event views over the test tables, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.spec import Roles, micros, seconds

ORDERS = Roles("key", "t", "id", "amt", "y")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, key, t, amt, y, prio``: orders as an event table."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), seconds("o_orderdate").alias("t"), F.col("o_totalprice").alias("amt"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), F.substring("o_orderpriority", 1, 1).alias("prio"))


def sparse_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with nulls put in, and device and e-mail columns picked by the id."""
    def pick(values: list[str | None], column: str) -> F.Column:
        return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.col("id") % len(values) + 1).cast("int")).alias(column)

    base = orders(spark, sf_dir)
    return base.select(
        "id", "key", "t", "y",
        F.when(F.col("id") % 7 != 0, F.col("amt")).alias("amt"),
        F.when(F.col("id") % 5 != 0, F.col("key") % 50).alias("card2"),
        F.when(F.col("id") % 11 != 0, (F.col("key") % 7).cast("double")).alias("addr1"),
        F.when(F.col("id") % 13 != 0, (F.col("id") % 9).cast("double")).alias("addr2"),
        pick(MAILS, "P_emaildomain"), pick(SYSTEMS, "id_30"), pick(BROWSERS, "id_31"), pick(INFOS, "DeviceInfo"), pick(KINDS, "DeviceType"))


def scored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, y, p``: orders with a made-up score that has ties."""
    return orders(spark, sf_dir).select("id", "y", F.round(((F.col("id") * 7919) % 10007) / 10007.0, 4).alias("p"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, key, t, amt, kind``: events, time in microseconds."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), micros("ts").alias("t"), F.col("value").alias("amt"), F.col("event_type").alias("kind"), (F.col("event_type") == "error").cast("int").alias("y"))


MAILS = ["Gmail.com", "Mailinator.com", None, "Yahoo.co.uk", "corp.example", " yopmail.com "]
SYSTEMS = ["Android 7.0", "iOS 11.1.2", "Windows 10", "Mac OS X 10_11_6", None, "—", "Linux", "Android 13"]
BROWSERS = ["chrome 63.0 for android", "mobile safari 11.0", "samsung browser 6.2", "firefox 59.0", None, "edge 16.0", "chrome 101.0"]
INFOS = ["SAMSUNG SM-G892A Build/NRD90M", "iOS Device", "Windows", "MacOS", None, "rv:59.0", "Trident/7.0", "-", "iPhone"]
KINDS = ["mobile", "desktop", None]


def _pick(values: list[str | None]) -> str:
    return "[" + ", ".join("null" if v is None else f"'{v}'" for v in values) + f"][cast(id % {len(values)} as int) + 1]"


ORDERS_SQL = "(select o_orderkey as id, o_custkey as key, cast(epoch(o_orderdate) as bigint) as t, o_totalprice as amt, (o_orderstatus = 'F')::int as y, substr(o_orderpriority, 1, 1) as prio from orders)"
SPARSE_SQL = f"(select id, key, t, y, case when id % 7 <> 0 then amt end as amt, case when id % 5 <> 0 then key % 50 end as card2, case when id % 11 <> 0 then (key % 7)::double end as addr1, case when id % 13 <> 0 then (id % 9)::double end as addr2, {_pick(MAILS)} as P_emaildomain, {_pick(SYSTEMS)} as id_30, {_pick(BROWSERS)} as id_31, {_pick(INFOS)} as DeviceInfo, {_pick(KINDS)} as DeviceType from {ORDERS_SQL})"
SCORED_SQL = f"(select id, y, round(((id * 7919) % 10007) / 10007.0, 4) as p from {ORDERS_SQL})"
EVENTS_SQL = "(select event_id as id, user_id as key, epoch_us(ts) as t, value as amt, event_type as kind, (event_type = 'error')::int as y from events)"
