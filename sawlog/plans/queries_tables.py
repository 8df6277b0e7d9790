"""Keyed tables."""

from datetime import datetime

from pyspark.sql import functions as F

from sawlog.operators.tables import by_name, changed_since, dedupe_first, diff_snapshots, table_version, upsert
from sawlog.plans.catalog import query
from sawlog.plans.views import table

# Two versions of the order table: early orders gone, late ones new, some changed.
OLD_NEW_SQL = """
old_orders AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01'),
new_orders AS (SELECT o_orderkey, o_orderstatus,
  CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE o_custkey END AS o_custkey
  FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01')"""
COLUMNS = ["o_orderstatus", "o_totalprice", "o_custkey"]


def _old_new(spark, sf_dir):
    orders, urgency = table(spark, sf_dir, "orders"), F.col("o_orderpriority")
    old = orders.where(F.col("o_orderdate") < F.lit(datetime(2001, 1, 1))).select("o_orderkey", *COLUMNS)
    new = orders.where(F.col("o_orderdate") >= F.lit(datetime(1996, 1, 1))).select(
        "o_orderkey", "o_orderstatus",
        F.when(urgency == "1-URGENT", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        F.when(urgency != "2-HIGH", F.col("o_custkey")).alias("o_custkey"),
    )
    return old, new


@query("j3_diff_snapshots", """
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'added'
  WHEN n.o_orderkey IS NULL THEN 'removed' WHEN o.o_orderstatus IS NOT DISTINCT FROM n.o_orderstatus
    AND o.o_totalprice IS NOT DISTINCT FROM n.o_totalprice AND o.o_custkey IS NOT DISTINCT FROM n.o_custkey THEN 'same'
  ELSE 'changed' END AS change
FROM old_orders o FULL JOIN new_orders n ON o.o_orderkey = n.o_orderkey""", OLD_NEW_SQL)
def j3_diff_snapshots(spark, sf_dir):
    return diff_snapshots(*_old_new(spark, sf_dir), "o_orderkey", COLUMNS)


@query("j4_upsert", """
SELECT * FROM new_orders UNION ALL SELECT * FROM old_orders o WHERE NOT EXISTS (SELECT 1 FROM new_orders n WHERE n.o_orderkey = o.o_orderkey)""",
       OLD_NEW_SQL)
def j4_upsert(spark, sf_dir):
    return upsert(*_old_new(spark, sf_dir), "o_orderkey")


@query("u2_dedupe_first", """
SELECT user_id, event_id, event_type, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
def u2_dedupe_first(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return dedupe_first(events, "user_id", ["ts", "event_id"])


@query("a11_table_version", "SELECT max(ts) AS version FROM events")
def a11_table_version(spark, sf_dir):
    return table_version(table(spark, sf_dir, "events"), "ts")


@query("a11_changed_since", "SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-25 12:00:00'")
def a11_changed_since(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    return changed_since(events, datetime(2024, 1, 25, 12), "ts")


@query("l1_by_name", "SELECT n_name, n_nationkey FROM nation ORDER BY n_name")
def l1_by_name(spark, sf_dir):
    return by_name(table(spark, sf_dir, "nation").select("n_name", "n_nationkey"), "n_name")
