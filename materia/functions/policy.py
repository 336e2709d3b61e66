"""Policy wording: tables of rewriting rules, each rule applied to what the one before it left."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """Wording and what takes its place.

    In the wording a blank stands for white space of any length, ``…`` for the rest of the sentence, ``(a|b)`` for
    either. ``not_after`` is an expression of fixed length that protects wording right behind it.
    """

    wording: str
    to: str
    not_after: str = ""

    @property
    def pattern(self) -> str:
        behind = f"(?<!{self.not_after})" if self.not_after else ""
        return "(?iU)" + behind + self.wording.replace("… ", "…").replace(" ", r"\s+").replace("…", r"[^.\n]*")


_TIMING = "Bác sĩ/dược sĩ nên rà soát thời điểm dùng thuốc và cân nhắc hướng dẫn dùng cách xa nếu phù hợp"
_ASSESS = "Bác sĩ/dược sĩ nên đối chiếu với triệu chứng, chẩn đoán và kế hoạch theo dõi để cân nhắc đánh giá thêm nếu phù hợp"
_OWN = "không tự ý "

# The wording that reports don't use, in the order of replacement.
REPORT = (
    Rule("đơn thuốc không an toàn", "đơn thuốc cần được bác sĩ/dược sĩ rà soát"),
    Rule("đơn thuốc an toàn", "đơn thuốc cần được bác sĩ/dược sĩ rà soát"),
    Rule("không dùng được", "cần rà soát trước khi sử dụng"),
    Rule("dùng được", "cần được đánh giá theo bối cảnh lâm sàng"),
    Rule("ngừng thuốc", "rà soát thuốc", _OWN),
    Rule("dừng thuốc", "rà soát thuốc", _OWN),
    Rule("đổi thuốc", "cân nhắc phương án xử trí phù hợp", _OWN),
    Rule("thay thuốc", "cân nhắc phương án xử trí phù hợp", _OWN),
    Rule("tăng liều", "rà soát liều", _OWN),
    Rule("giảm liều", "rà soát liều", _OWN),
    Rule("kê thêm", "cân nhắc phương án điều trị phù hợp"),
    Rule("khuyên bệnh nhân…", _TIMING),
    Rule("hướng dẫn bệnh nhân (uống|dùng)…", _TIMING),
    Rule("để tránh… cần uống…", _TIMING),
    Rule("cân nhắc thực hiện các xét nghiệm…", _ASSESS),
    Rule("cần thăm khám và thực hiện các xét nghiệm…", _ASSESS.replace("theo dõi để", "theo dõi của bệnh nhân để")),
    Rule("cần thực hiện các xét nghiệm…", _ASSESS),
    Rule("thực hiện các xét nghiệm cần thiết…", _ASSESS),
    Rule("trước khi tiếp tục điều trị bằng…", "trước khi cân nhắc phương án theo dõi hoặc xử trí phù hợp"),
    Rule("tiếp tục điều trị bằng…", "cân nhắc phương án theo dõi hoặc xử trí phù hợp"),
    Rule("cần uống ", "Cần rà soát thời điểm dùng "),
    Rule("overall risk", "Mức ưu tiên rà soát"),
    Rule("mức nguy cơ tổng quan", "Mức ưu tiên rà soát"),
    Rule("tự ý (ngừng|dừng|đổi|thay|tăng|giảm)", "cần trao đổi với bác sĩ/dược sĩ trước khi điều chỉnh", r"không\s"),
)
# What answers replace besides, after that.
ANSWER = (
    Rule("không an toàn", "cần được rà soát"),
    Rule("an toàn", "cần được rà soát"),
    Rule("không nên dùng", "cần được bác sĩ/dược sĩ rà soát"),
    Rule("không được dùng", "cần được bác sĩ/dược sĩ rà soát"),
    Rule("không được trộn", "cần được bác sĩ/dược sĩ rà soát"),
    Rule("không dùng được", "cần được bác sĩ/dược sĩ rà soát"),
    Rule("dùng được", "cần được đánh giá theo bối cảnh lâm sàng"),
    Rule("ngừng dùng thuốc", "rà soát thuốc"),
    Rule("phải ngừng", "cần được nhân viên y tế đánh giá và xử trí phù hợp"),
    Rule("cần ngừng", "cần được nhân viên y tế đánh giá và xử trí phù hợp"),
    Rule("ngừng thuốc", "rà soát thuốc"),
    Rule("dừng thuốc", "rà soát thuốc"),
    Rule("thăm khám thầy thuốc", "được nhân viên y tế đánh giá phù hợp"),
    Rule("phải thăm khám", "cần được nhân viên y tế đánh giá phù hợp"),
    Rule("cần thăm khám", "cần được nhân viên y tế đánh giá phù hợp"),
    Rule("đổi thuốc", "cân nhắc phương án xử trí phù hợp"),
    Rule("thay thuốc", "cân nhắc phương án xử trí phù hợp"),
    Rule("tăng liều", "rà soát liều"),
    Rule("giảm liều", "rà soát liều"),
    Rule("kê thêm", "cân nhắc phương án điều trị phù hợp"),
)
# What is replaced in the decisive words of a report's items.
DECISIVE = (
    Rule("đơn thuốc (không |)an toàn", "đơn thuốc cần được bác sĩ/dược sĩ rà soát"),
    Rule("không dùng được", "cần rà soát trước khi sử dụng"),
    Rule("dùng được", "cần được đánh giá theo bối cảnh lâm sàng"),
    Rule("ngừng thuốc", "rà soát thuốc"),
    Rule("đổi thuốc", "cân nhắc phương án xử trí phù hợp"),
    Rule("tăng liều", "rà soát liều"),
    Rule("giảm liều", "rà soát liều"),
)


def rewritten(text: Column, rules: tuple[Rule, ...]) -> Column:
    """The text after all rules, in their order; a null text is empty."""
    return reduce(lambda t, r: F.regexp_replace(t, r.pattern, r.to), rules, F.coalesce(text, F.lit("")))


def matches(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Whether any rule finds its wording in the text as it is; false for a null one."""
    return reduce(lambda a, r: a | text.rlike(r.pattern), rules, F.lit(False)) & text.isNotNull()


def answer_text(text: Column) -> Column:
    """An answer after the rules of reports and those of answers: white space squeezed, none before a mark, of several end marks the last."""
    squeezed = F.trim(F.regexp_replace(rewritten(text, REPORT + ANSWER), r"(?U)\s+", " "))
    return F.regexp_replace(F.regexp_replace(squeezed, r"\s+([,.;:!?])", "$1"), r"[.!?]+([.!?])", "$1")


def rewrite(df: DataFrame, text_col: str, rules: tuple[Rule, ...], out: str = "rewritten", hits: str = "hits") -> DataFrame:
    """``df`` with the rewritten text and, a number a rule, how often each rule was applied to what it was given.

    Each rule is a step of its own: its text is made once and read twice, by its count and by the next rule.
    """
    names = [n for i in range(len(rules) + 1) for n in (f"_text{i}", f"_hits{i}")]
    taken = {c.lower() for c in df.columns}
    if taken & set(names):
        raise ValueError("columns _text0, _hits0 and so on are used here")
    made = df.withColumn("_text0", F.coalesce(F.col(text_col), F.lit("")))
    for i, rule in enumerate(rules):
        found = F.regexp_count(f"_text{i}", F.lit(rule.pattern)).alias(f"_hits{i}")
        made = made.select("*", F.regexp_replace(f"_text{i}", rule.pattern, rule.to).alias(f"_text{i + 1}"), found).drop(f"_text{i}")
    kept = [c for c in df.columns if c not in (out, hits)]
    return made.select(*kept, F.col(f"_text{len(rules)}").alias(out), F.array(*(f"_hits{i}" for i in range(len(rules)))).alias(hits))
