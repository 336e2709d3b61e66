"""Text steps stay within the size of generated methods that the JVM compiles (8,000 bytes); larger ones are interpreted."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from materia.functions import text as X
from materia.operators import risk as R

COMPILED = 8000


def _largest_method(spark, df) -> int:
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    codes = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return max((codes.apply(i)._3().maxMethodCodeSize() for i in range(codes.size())), default=0)


@pytest.fixture()
def plain_plans(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", before)


def test_safety_pass_is_compiled(spark, plain_plans, monkeypatch):
    made = []
    monkeypatch.setattr(R, "shared_table", lambda df, label: (made.append(df), df)[1])
    items = spark.range(5).selectExpr("id AS run", "id AS item", "'interaction' AS risk_type", "'high' AS severity", "if(id = 1, 'a', 'b') AS title", "if(id = 2, 'a', 'b') AS explanation", "if(id = 3, 'a', 'b') AS recommendation", "if(id = 1, array('s'), array('t')) AS affected_slugs", "array('r1') AS evidence_refs")
    runs = spark.range(5).selectExpr("id AS run", "'analysed' AS status", "'low' AS level", "array('w') AS warnings", "array('m') AS missing", "true AS unresolved", "true AS review", "if(id = 1, 'male', 'female') AS sex", "'d' AS diagnoses", "if(id = 2, 'normal', '') AS renal_function", "'normal' AS hepatic_function", "if(id = 3, 'no', 'unknown') AS pregnancy_lactation", "cast(null AS string) AS pregnancy_status")
    R.safety_pass(items, spark.range(5).selectExpr("id AS run", "'r1' AS chunk_id"), runs, ["run", "item"])
    assert _largest_method(spark, made[0]) <= COMPILED, _largest_method(spark, made[0])


def test_fold_of_ascii_and_others(spark):
    said = ["  A\t\tB  c ", "\x1cA\x1f b", "Đơn  thuốc", "É–x Y", "®A™ b", "", None, "á B", "STRASSE ß"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    by_letters = X.strip_accents(X.normalize(F.col("s")))
    assert rows.filter(~X.fold(F.col("s")).eqNullSafe(by_letters)).count() == 0
    assert [r[0] for r in rows.orderBy("i").select(X.fold(F.col("s"))).collect()][:5] == ["a b c", "\x1ca\x1f b", "don thuoc", "e-x y", "a b"]
