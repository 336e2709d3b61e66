"""Ordered rewriting: literal texts, order, protection, idempotence."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from materia.functions import policy as P
from materia.plans.policy import SENTENCES


def apply(spark, texts, rules):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = P.rewrite(df, "t", rules).orderBy("i").collect()
    plain = df.select("i", P.rewritten(F.col("t"), rules).alias("r")).orderBy("i").collect()
    assert [r["rewritten"] for r in rows] == [r["r"] for r in plain]
    return [(r["rewritten"], r["hits"]) for r in rows]


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("Đơn thuốc  không an toàn", "đơn thuốc cần được bác sĩ/dược sĩ rà soát"),
        ("Không dùng được hoặc dùng được", "cần rà soát trước khi sử dụng hoặc cần được đánh giá theo bối cảnh lâm sàng"),
        ("không tự ý ngừng thuốc; ngừng thuốc", "không tự ý ngừng thuốc; rà soát thuốc"),
        ("tự ý đổi", "cần trao đổi với bác sĩ/dược sĩ trước khi điều chỉnh"),
        ("Cần uống\t2 viên", "Cần rà soát thời điểm dùng 2 viên"),
        ("khuyên bệnh nhân nghỉ, uống nước.\nTăng liều", f"{P._TIMING}.\nrà soát liều"),
        ("trước khi tiếp tục điều trị bằng A\ntiếp tục điều trị bằng B", "trước khi cân nhắc phương án theo dõi hoặc xử trí phù hợp\ncân nhắc phương án theo dõi hoặc xử trí phù hợp"),
        ("", ""), (None, ""), ("x" * 50_000, "x" * 50_000),
    ],
)
def test_report_texts(spark, text, wanted):
    assert apply(spark, [text], P.REPORT)[0][0] == wanted


def test_each_rule_sees_the_output_of_the_one_before(spark):
    rules = (P.Rule("a b", "c"), P.Rule("c", "d d"), P.Rule("d", "e"))
    assert apply(spark, ["A  b c", "d"], rules) == [("e e e e", [1, 2, 4]), ("e", [0, 0, 1])]


def test_rewriting_again_changes_nothing(spark):
    """But for wording that a replacement itself brings: none of the fixed rules does."""
    for rules in (P.REPORT, P.DECISIVE, P.REPORT + P.ANSWER):
        once = [t for t, _ in apply(spark, SENTENCES, rules)]
        again = apply(spark, once, rules)
        assert [t for t, _ in again] == once and all(sum(h) == 0 for _, h in again)


def test_detection_and_answers(spark):
    df = spark.createDataFrame([(0, "Ngừng thuốc ngay"), (1, "không tự ý ngừng thuốc"), (2, None), (3, "phải ngừng  . An toàn !!!")], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(P.matches(F.col("t"), P.REPORT)).collect()] == [True, False, False, False]
    assert df.select(P.answer_text(F.col("t"))).collect()[3][0] == "cần được nhân viên y tế đánh giá và xử trí phù hợp. cần được rà soát!"
