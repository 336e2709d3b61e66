"""Salted joins make every pair once; blocked search equals search in one block."""

from __future__ import annotations

import random


from pyspark.sql import functions as F

from materia.operators import evidence as E
from materia.operators import resolve as R
from materia.operators import risk as K
from materia.operators.skew import dealt, salted_join


def test_every_pair_once(spark):
    rng = random.Random(2)
    many = [(rng.choice(["hot"] * 6 + ["a", "b", None]), i) for i in range(300)]
    few = [(k, j) for j, k in enumerate(["hot", "hot", "a", "c", None, "b"])]
    m, f = spark.createDataFrame(many, "k string, i int").repartition(5), spark.createDataFrame(few, "k string, _salt int")
    for rows in (3, 40, 10_000):
        found = sorted((r["k"], r["_salt"], r["i"]) for r in salted_join(f, m, "k", "i", rows).collect())
        assert found == sorted((k, j, i) for k, j in few for q, i in many if k is not None and k == q)
    assert salted_join(f.limit(0), m, "k", "i", 3).count() == salted_join(f, m.limit(0), "k", "i", 3).count() == 0


def test_search_in_blocks(spark):
    rng = random.Random(3)
    chunks = [(i, rng.choice(["x", "x", "x", "y"]), f"s{i % 3}", f"src{i % 2}", [rng.random(), rng.random()]) for i in range(400)]
    c = spark.createDataFrame(chunks, "chunk_id long, slug string, section string, source string, vector array<double>").repartition(6)
    q = spark.createDataFrame([(1, ["x"], ["s1"], [1.0, 0.2]), (2, ["x", "y"], ["none"], [0.1, 1.0])], "query_id long, slugs array<string>, sections array<string>, vector array<double>")
    whole, blocks = (sorted(map(tuple, E.search(q, c, 5, "src0", rows_a_salt=n).collect())) for n in (10_000, 7))
    assert whole == blocks and len(whole) == 10
    assert "WindowGroupLimit" in E.search(q, c, 5, "src0")._jdf.queryExecution().executedPlan().toString()


def test_no_broadcast_of_what_grows(spark, tmp_path):
    # 60,000 rows of two names compress to some kB of files, which is what Spark goes by before it runs
    spark.range(60_000).selectExpr(
        "id AS mapping_id", "'omega ring Brand 1' AS brand_name", "array('omega ring') AS aliases", "array('large') AS ingredients", "'high' AS confidence", "cast(array() AS array<string>) AS warnings"
    ).write.parquet(f"{tmp_path}/d")
    dictionary = spark.read.parquet(f"{tmp_path}/d")
    asked = spark.createDataFrame([("q", "Omega ring")], "query_id string, name string")
    best = R.rank_candidates(R.layered_lookup(asked, dictionary), dictionary, 1)
    assert [r["mapping_id"] for r in best.collect()] == [0]
    plan = R.rank_candidates(R.layered_lookup(asked, dictionary), dictionary, 1)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in "\n".join(x for x in plan.splitlines() if "key#" in x or "mapping_id#" in x)
    refs = spark.range(60_000).selectExpr("id AS run", "'c' AS chunk_id")
    items = refs.selectExpr("run", "1 AS item", "array('c') AS evidence_refs")
    assert "BroadcastHashJoin" not in K.supported_refs(items, refs, ["run", "item"])._jdf.queryExecution().executedPlan().toString()


def test_kinds_scored_once(spark):
    rng = random.Random(4)
    chunks = [(i, rng.choice("xxy"), rng.choice(["s0", "s1", "s2", None]), f"src{i % 2}", [rng.random(), rng.random()]) for i in range(500)]
    c = spark.createDataFrame(chunks, "chunk_id long, slug string, section string, source string, vector array<double>").repartition(3)
    q = spark.createDataFrame([(1, ["x"], [1.0, 0.2]), (2, ["x", "y"], [0.1, 1.0]), (3, ["z"], [1.0, 1.0])], "query_id long, slugs array<string>, vector array<double>")
    q = q.withColumn("kinds", F.expr("array(named_struct('query_type', 'a', 'sections', array('s0', 's1')), named_struct('query_type', 'b', 'sections', array('none')))"))
    each = E.search(q.selectExpr("query_id", "slugs", "vector", "inline(kinds)"), c, 5, "src0", ("query_id", "query_type"))
    once = E.search(q, c, 5, "src0", kinds="kinds")
    assert once.columns == each.columns and sorted(map(tuple, once.collect())) == sorted(map(tuple, each.collect())) and each.count() == 20


def test_cosines_by_blocks(spark):
    rng = random.Random(5)
    v = {i: [rng.uniform(-1, 1) for _ in range(3)] for i in range(23)} | {30: None, 31: [1.0, None, 2.0], 32: [1.0, 2.0], 33: [0.0, 0.0, 0.0]}
    e = spark.createDataFrame(list(v.items()), "vec_id long, embedding array<float>").repartition(3)
    found = {(r["id"], r["query_id"]): r["cosine"] for r in E.all_cosines(e, e.filter("vec_id % 2 = 0"), 4).collect()}
    assert len(found) == len(v) * sum(i % 2 == 0 for i in v)
    for (i, j), c in found.items():
        a, b = v[i], v[j]
        if not a or not b or None in a or None in b or len(a) != len(b):
            assert c is None
        elif not any(a) or not any(b):
            assert c != c
        else:
            dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
            assert abs(c - dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5) < 1e-6
    assert E.all_cosines(e.limit(0), e).count() == 0
    # a row of the plan is a block, so the rows of a pair of vectors are made by one product
    assert "zip_with" not in E.all_cosines(e, e)._jdf.queryExecution().analyzed().toString()


def test_refs_are_looked_up_without_items(spark, sf_dir):
    from materia.plans import risks as KP

    # refs are looked up without a join back to their items, which safety_pass joins anyway
    items = KP.items(spark, sf_dir)
    plan = K._supported(items, KP.retrieved(spark, sf_dir), KP.KEYS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") == 1 and "Join Inner" not in plan


def test_parts_follow_the_rows(spark):
    df = spark.range(1000)
    made = dealt(df, 1000, "id", rows_a_task=100)
    assert made.rdd.getNumPartitions() == 10 and made.count() == 1000
    assert dealt(df.limit(0), 0, "id").count() == 0


def test_attached_evidence_has_no_part_of_a_fixed_number(spark, sf_dir):
    from materia.plans.risks import attached_evidence

    plan = attached_evidence(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 3 and "ENSURE_REQUIREMENTS" not in plan and "BroadcastHashJoin" not in plan
