"""Queries that any Spark user can run on top: what the engine adds nothing to, kept as checks of the plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table


def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    """Aggregates by two keys: partial aggregation before a shuffle of a few rows."""
    lines = table(spark, d, "lineitem")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n_lines"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"))


def nation_rollup(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return customers.rollup("n_regionkey", "n_name").agg(F.count("*").alias("n_customers"))


def event_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("day", F.to_date("ts")).cube("event_type", "day").agg(F.count("*").alias("n_events"))


def top_orders(spark: SparkSession, d: str) -> DataFrame:
    """The three largest orders of each customer: a ranking that Spark limits before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, d, "orders").withColumn("rank", rank).where("rank <= 3").select("o_custkey", "o_orderkey", "rank")


def running_value(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, d, "events").select("event_id", "user_id", F.count("*").over(w).alias("nth"), F.round(F.sum("value").over(w), 4).alias("running"))


def as_of_uploads(spark: SparkSession, d: str) -> DataFrame:
    """Each density record with the latest upload of its file before it: one window over the union of both sides."""
    taken = table(spark, d, "density").select("file_id", "chunk_id", F.col("taken_at").alias("at"), F.lit(None).cast("timestamp").alias("received_at")).distinct()
    received = table(spark, d, "uploads").select("file_id", F.lit(None).cast("long").alias("chunk_id"), F.col("received_at").alias("at"), "received_at")
    order = Window.partitionBy("file_id").orderBy("at", F.col("chunk_id").isNotNull())
    w = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = taken.unionByName(received).withColumn("last_received", F.last("received_at", ignorenulls=True).over(w))
    return both.where("chunk_id is not null").select("chunk_id", F.col("at").alias("taken_at"), "last_received")


def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Ids of chunks and ids that cards refer to: difference, intersection, union and difference with repeats."""
    chunks = table(spark, d, "text_chunks").select("id")
    origins = table(spark, d, "flash_cards").where("origin_id is not null").select(F.col("origin_id").alias("id"))
    named = {"except": chunks.subtract(origins), "missing": origins.subtract(chunks), "intersect": chunks.intersect(origins), "union": chunks.union(origins).distinct(), "except_all": chunks.exceptAll(origins)}
    out = None
    for name, df in named.items():
        part = df.select(F.lit(name).alias("operation"), "id")
        out = part if out is None else out.unionByName(part)
    return out


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows of a day; on a stream the same with a watermark."""
    return table(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n_events")).select(F.col("w.start").alias("day"), "event_type", "n_events")


def preset_pivot(spark: SparkSession, d: str) -> DataFrame:
    presets = ["amber-8b", "basalt-14b", "cobalt-24b", "dune-moe", "ember-judge", "flint-4b"]
    cards = table(spark, d, "flash_cards").select("id", "origin_id", "preset").distinct()
    return cards.groupBy("origin_id").pivot("preset", presets).agg(F.count("id")).fillna(0, presets)


QUERIES = {f.__name__: f for f in (pricing_summary, nation_rollup, event_cube, top_orders, running_value, as_of_uploads, set_operations, event_windows, preset_pivot)}
SQL = {
    "pricing_summary": "SELECT l_returnflag, l_linestatus, count(*) AS n_lines, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_discount), 6) AS avg_disc FROM lineitem GROUP BY ALL",
    "nation_rollup": "SELECT n_regionkey, n_name, count(*) AS n_customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_name)",
    "event_cube": "SELECT event_type, ts::DATE AS day, count(*) AS n_events FROM events GROUP BY CUBE (event_type, day)",
    "top_orders": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders QUALIFY rank <= 3",
    "running_value": "SELECT event_id, user_id, count(*) OVER w AS nth, round(sum(value) OVER w, 4) AS running FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "as_of_uploads": "SELECT d.chunk_id, d.taken_at, max(u.received_at) AS last_received FROM (SELECT DISTINCT file_id, chunk_id, taken_at FROM density) d LEFT JOIN uploads u ON u.file_id = d.file_id AND u.received_at <= d.taken_at GROUP BY ALL",
    "set_operations": " UNION ALL ".join(f"SELECT '{name}' AS operation, id FROM ({sql})" for name, sql in {
        "except": "SELECT id FROM text_chunks EXCEPT SELECT origin_id FROM flash_cards", "missing": "SELECT origin_id AS id FROM flash_cards WHERE origin_id IS NOT NULL EXCEPT SELECT id FROM text_chunks",
        "intersect": "SELECT id FROM text_chunks INTERSECT SELECT origin_id FROM flash_cards", "union": "SELECT id FROM text_chunks UNION SELECT origin_id FROM flash_cards WHERE origin_id IS NOT NULL", "except_all": "SELECT id FROM text_chunks EXCEPT ALL SELECT origin_id FROM flash_cards",
    }.items()),
    "event_windows": "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n_events FROM events GROUP BY ALL",
    "preset_pivot": "SELECT origin_id, "
    + ", ".join(f"count(*) FILTER (WHERE preset = '{p}') AS \"{p}\"" for p in ("amber-8b", "basalt-14b", "cobalt-24b", "dune-moe", "ember-judge", "flint-4b"))
    + " FROM (SELECT DISTINCT id, origin_id, preset FROM flash_cards) GROUP BY origin_id",
}
