"""Publishing that leaves the old table readable, and loads that encode only what changed."""

from __future__ import annotations

import uuid

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from materia.sources import landing as L
from materia.sources.shared import shared_dir


@pytest.fixture
def path(spark):
    return f"{shared_dir(spark)}/publish-{uuid.uuid4().hex}/t"


def test_failed_overwrite_leaves_the_old_table(spark, path):
    L.publish(spark.range(5), path, kind="parquet")
    bad = spark.range(3).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        L.publish(bad, path, overwrite=True, kind="parquet")
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(AnalysisException):
        L.publish(spark.range(1), path, kind="parquet")
    L.publish(spark.read.parquet(path).filter("id > 2"), path, overwrite=True, kind="parquet")  # reads what it replaces
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [3, 4]
    files, target = L.file_system(spark, path)
    assert [f.getPath().getName() for f in files.listStatus(target.getParent())] == ["t"]


def test_overwrite_of_nothing_is_a_publish(spark, path):
    L.publish(spark.range(2), path, overwrite=True, kind="parquet")
    assert spark.read.parquet(path).count() == 2


class Counting:
    def encode(self, texts):
        return [[float(len(t)), 1.0] for t in texts]


def test_load_keeps_unchanged_vectors(spark, path):
    make = lambda rows: spark.createDataFrame(rows, "id string, text string")
    load = lambda rows: {r["id"]: r for r in L.load_vectors(make(rows), path, F.col("id"), F.col("text"), Counting).collect()}
    first = load([("a", "xx"), ("b", None), (None, "lost"), ("c", "y"), ("c", "y")])
    assert sorted(first) == ["a", "b", "c"] and first["b"]["vector"] == [0.0, 1.0]
    assert first["a"]["point_id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "a"))
    again = load([("a", "xxx"), ("d", "new")])
    assert sorted(again) == ["a", "b", "c", "d"] and again["a"]["vector"] == [3.0, 1.0] and again["c"] == first["c"]
    assert load([]) == again
