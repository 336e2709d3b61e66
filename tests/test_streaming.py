"""A stream gives the rows that a batch gives, and goes on where it stopped."""

from __future__ import annotations

from materia.sources import landing
from materia.streaming import rows


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    source, sink, marks = (f"file://{tmp_path}/{n}" for n in ("in", "out", "marks"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    lines = events.selectExpr("CASE WHEN event_id % 10 = 0 THEN left(to_json(struct(*)), 9) ELSE to_json(struct(*)) END AS value")
    for part in (lines.limit(300), lines.offset(300)):
        part.write.mode("append").text(source)
        rows.write(rows.landed(rows.read_lines(spark, source), ["event_id"]), sink, marks).awaitTermination(60)
    streamed = spark.read.parquet(sink).groupBy("reason").count().collect()
    batch = landing.land(lines.withColumnRenamed("value", "line"), ["event_id"]).groupBy("reason").count().collect()
    assert sorted(map(str, streamed)) == sorted(map(str, batch)) and sum(r["count"] for r in streamed) == events.count()
    asked = spark.createDataFrame([("Omeprazol có tương tác với sucralfate không?",)], "m string")
    assert rows.classified(asked, "m").first()["c"]["intent"] == "drug_interaction_query"
