"""Queries on audit history: orders are runs, customers tenants, line items the report."""

from __future__ import annotations

from pyspark.sql import functions as F

from materia.plans.landings import work_dir
from materia.registry import query, table


def report(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("items"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("j18_history_list", """SELECT o_orderkey, o_orderdate, items, quantity FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS items, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
  WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5 OFFSET 2""")
def history_list(spark, sf):
    """One tenant's runs, newest first, a page of them; the tenant filter reaches the scan."""
    own = table(spark, sf, "orders").filter("o_custkey = 7")
    return own.join(report(spark, sf), "o_orderkey", "left").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).offset(2).limit(5).select("o_orderkey", "o_orderdate", "items", "quantity")


@query("j19_history_detail", "SELECT o_orderkey, o_custkey, items FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS items FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderkey = 100")
def history_detail(spark, sf):
    return table(spark, sf, "orders").filter("o_orderkey = 100").join(report(spark, sf), "o_orderkey", "left").select("o_orderkey", "o_custkey", "items")


@query("k7_newest_first", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = 11 ORDER BY o_orderdate DESC")
def newest_first(spark, sf):
    return table(spark, sf, "orders").filter("o_custkey = 11").orderBy(F.desc("o_orderdate")).select("o_orderkey", "o_orderdate")


@query("s11_append_history", "SELECT (SELECT count(*) FROM orders) AS runs, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS reports")
def append_history(spark, sf):
    """Two tables appended from one audit, read back."""
    root = work_dir(spark, "history")
    table(spark, sf, "orders").select("o_orderkey", "o_custkey").write.mode("append").parquet(f"{root}/runs")
    report(spark, sf).write.mode("append").parquet(f"{root}/reports")
    runs = spark.read.parquet(f"{root}/runs").agg(F.count("*").alias("runs"))
    return runs.join(F.broadcast(spark.read.parquet(f"{root}/reports").agg(F.count("*").alias("reports"))))


@query("f20_run_status", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'partial_success' ELSE 'failed' END AS status FROM orders")
def run_status(spark, sf):
    given = F.when(F.col("o_orderstatus") == "F", "report_ready").when(F.col("o_orderstatus") == "O", "report_context_ready").otherwise("none")
    partial = ("report_context_ready", "report_insufficient_evidence", "report_analysis_failed")
    return table(spark, sf, "orders").select("o_orderkey", F.when(given == "report_ready", "success").when(given.isin(*partial), "partial_success").otherwise("failed").alias("status"))
