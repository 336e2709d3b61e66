"""Python workers hold small batches of pages; the SQL of titles and kinds says the rules, not what small tables show of them."""

from __future__ import annotations

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from materia.operators import pages as P


def test_batches_of_pages(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        rows = spark.range(300).selectExpr("id AS page_id", "'u' AS url", "concat('<h1>T', id, '</h1>') AS html")
        made = P.parsed(rows)
        assert int(spark.conf.get(name)) <= 256
        assert {r["title"] for r in made.collect()} == {f"T{i}" for i in range(300)}
    finally:
        spark.conf.set(name, before)


PAGES = ["<h1>A &amp; b&amp</h1>", "<title>T</title><h1 class='x'>&amp;lt; &lt;b&gt; &quot;c</h1>", "<title>only</title>", "<h1> </h1><title>t  u</title>", "<p>none</p>", "<h1>a<b>c</b></h1>", None]
TURNS = [(0, "x"), (1, ""), (2, "tương tác"), (2, "la adrosa"), (2, "aspi\nrin"), (2, "1. A 5 mg\n2) B 1 viên"), (5, "1. A 5mgé\n2. B 5mgé"), (5, "- Đơn  thuốc"), (8, None), (8, "1. A 5 ml\nsáng"), (8, "dùng cùng nhau")]


@pytest.mark.parametrize("name", ["t1_main_content", "t12_text_kind"])
def test_sql_says_the_rule(spark, tmp_path, name):
    spark.createDataFrame([(i, "u", h) for i, h in enumerate(PAGES)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(c, i, "user", t) for i, (c, t) in enumerate(TURNS)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    for t in ("pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, queries()[name](spark, str(tmp_path)).collect()), key=key) == sorted(con.execute(oracle_sql()[name]).fetchall(), key=key)
