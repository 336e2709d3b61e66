"""Queries on policy wording: conversations, each turn followed by a sentence that the rules are about."""

from __future__ import annotations

from pyspark.sql import functions as F

from materia.functions import policy as P
from materia.registry import query, table

SENTENCES = (
    "Đơn  thuốc không an toàn, ĐƠN THUỐC AN TOÀN.", "Thuốc này không dùng được; thuốc kia dùng được", "Bệnh nhân không tự ý ngừng thuốc, nên ngừng thuốc sau 3 ngày", "Dừng\nthuốc rồi ĐỔI THUỐC, thay thuốc",
    "tăng liều buổi sáng, giảm  liều buổi tối và kê thêm vitamin", "Khuyên bệnh nhân uống nhiều nước. Overall risk: cao", "hướng dẫn bệnh nhân uống sau ăn\nmức nguy cơ tổng quan thấp", "Để tránh tương tác cần uống cách xa. Cần uống 2 viên",
    "Cân nhắc thực hiện các xét nghiệm gan. Cần thực hiện các xét nghiệm máu", "cần thăm khám và thực hiện các xét nghiệm. Thực hiện các xét nghiệm cần thiết", "Trước khi tiếp tục điều trị bằng thuốc này, tiếp tục điều trị bằng thuốc kia. xong",
    "Tự ý tăng, không tự ý giảm liều", "phải ngừng ngay và cần thăm khám", "An toàn tuyệt đối!!", "Nothing to change here .",
)


def messages(spark, sf):
    """Every turn with one of the sentences after it."""
    listed = F.array(*map(F.lit, SENTENCES))
    said = F.get(listed, ((F.col("conv_id") * 7 + F.coalesce("turn", F.lit(0))) % len(SENTENCES)).cast("int"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.concat_ws("\n", "text", said).alias("message"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _messages_sql() -> str:
    return f"SELECT conv_id, turn, concat_ws(chr(10), text, [{', '.join(map(_quoted, SENTENCES))}][CAST((conv_id * 7 + coalesce(turn, 0)) % {len(SENTENCES)} AS INT) + 1]) AS t0 FROM conversations".replace("\n", "' || chr(10) || '")


def _steps(rules) -> str:
    """One query a rule over the one before. The engine has no look-behind: protected wording gets a mark inside, which goes again."""
    made = [f"s0 AS ({_messages_sql()})"]
    for i, rule in enumerate(rules):
        plain = rule._replace(not_after="").pattern.removeprefix("(?iU)")
        given = f"t{i}"
        if rule.not_after:
            given = f"regexp_replace(t{i}, {_quoted('(' + rule.not_after + plain[0] + ')(' + plain[1:] + ')')}, {_quoted(chr(92) + '1' + chr(1) + chr(92) + '2')}, 'gi')"
        hits = f"len(regexp_extract_all({given}, {_quoted('(?i)' + plain)}))"
        to = f"replace(regexp_replace({given}, {_quoted(plain)}, {_quoted(rule.to)}, 'gi'), chr(1), '')"
        before = ", ".join(["conv_id", "turn", *(f"h{j}" for j in range(i))])
        made.append(f"s{i + 1} AS (SELECT {before}, {to} AS t{i + 1}, {hits} AS h{i} FROM s{i})")
    return ", ".join(made)


def _sql(rules) -> str:
    n = len(rules)
    return f"WITH {_steps(rules)} SELECT conv_id, turn, sha256(t{n}) AS text_sha256, concat_ws(',', {', '.join(f'h{i}' for i in range(n))}) AS hits FROM s{n}"


def _digest(made):
    return made.select("conv_id", "turn", F.sha2("rewritten", 256).alias("text_sha256"), F.array_join("hits", ",").alias("hits"))


@query("x28_report_rewrite", _sql(P.REPORT))
def report_rewrite(spark, sf):
    """The texts after all rules of reports, and how often each was applied."""
    return _digest(P.rewrite(messages(spark, sf), "message", P.REPORT))


@query("x28_answer_rewrite", _sql(P.REPORT + P.ANSWER))
def answer_rewrite(spark, sf):
    """The rules of reports, then those of answers."""
    return _digest(P.rewrite(messages(spark, sf), "message", P.REPORT + P.ANSWER))


@query("x28_decisive_rewrite", _sql(P.DECISIVE))
def decisive_rewrite(spark, sf):
    return _digest(P.rewrite(messages(spark, sf), "message", P.DECISIVE))


@query("x28_rule_totals", f"WITH {_steps(P.REPORT)} SELECT rule, hits::BIGINT AS hits FROM (SELECT unnest(range({len(P.REPORT)})) AS rule, unnest([{', '.join(f'sum(h{i})' for i in range(len(P.REPORT)))}]) AS hits FROM s{len(P.REPORT)})")
def rule_totals(spark, sf):
    """How often each rule of reports was applied to the whole table."""
    found = P.rewrite(messages(spark, sf), "message", P.REPORT).select(F.posexplode("hits").alias("rule", "n"))
    return found.groupBy(F.col("rule").cast("long").alias("rule")).agg(F.sum("n").alias("hits"))
