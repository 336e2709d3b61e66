"""Queries on messages: conversation turns, each with a question made from its ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from materia.operators import messages as M
from materia.registry import query, table


def messages(spark, sf):
    """Every turn, with a question in front of a part of them."""
    c = table(spark, sf, "conversations")
    k = F.col("conv_id") % 4
    asked = (
        F.when(k == 0, "Omeprazol có tương tác với sucralfate không?").when(k == 1, "Paracetamol có tác dụng phụ gì?").when(k == 2, "Dịch câu này: ").otherwise("")
    )
    return c.select("conv_id", "turn", F.when(F.col("turn") == 0, asked).otherwise("").alias("asked"), "text")


@query("t11_intent", """SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'drug_interaction_query' WHEN 1 THEN 'single_drug_query' ELSE 'out_of_scope' END AS intent, CASE conv_id % 4 WHEN 0 THEN 'interaction' WHEN 1 THEN 'adverse_effect' ELSE 'general' END AS topic,
  CASE conv_id % 4 WHEN 0 THEN 'Omeprazol|sucralfate' WHEN 1 THEN 'Paracetamol' ELSE '' END AS mentions FROM conversations WHERE turn = 0 AND conv_id % 4 < 3""")
def intent(spark, sf):
    m = M.classify(messages(spark, sf).filter("asked <> ''").select("conv_id", "turn", "asked"), "asked")
    return m.select("conv_id", "turn", "c.intent", "c.topic", F.array_join("c.mentions", "|").alias("mentions"))


@query("t11_intent_of_turns")
def intent_of_turns(spark, sf):
    """Whole turns as messages: how many of each intent."""
    m = M.classify(table(spark, sf, "conversations").select("text"), "text")
    return m.groupBy("c.intent", "c.topic").agg(F.count("*").alias("n"))


def _folded_sql(x: str) -> str:
    squeezed = f"trim(regexp_replace(regexp_replace(translate({x}, '®™', ''), '[\u2010-\u2015\u2212]', '-', 'g'), '\\s+', ' ', 'g'))"
    return f"replace(strip_accents(lower({squeezed})), 'đ', 'd')"


_WORD, _ANY = r"[^\p{L}\p{N}_]", "|".join
TEXT_KIND_SQL = f"""WITH m AS (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN '1. Omeprazol 20mg x 56 viên' || chr(10) || 'Ngày uống 2 lần' || chr(10) WHEN 1 THEN 'contraindication? ' ELSE '' END || text || chr(10) || '-' || chr(10) || '-' AS t FROM conversations),
 l AS (SELECT *, {_folded_sql("t")} AS folded, list_filter(list_transform(regexp_split_to_array(t, '\\r\\n|[\\n\\x0b\\f\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: trim(x)), lambda x: x <> '') AS lines FROM m),
 n AS (SELECT *, len(list_filter(lines, lambda x: regexp_matches(x, '(?i)^\\s*\\d+\\s*[.)\\-]\\s+.*{_WORD}(?:mcg|µg|mg|g|ml|iu|ui|mui|viên|vien|gói|goi)(?:{_WORD}|$)'))) AS numbered,
  len(list_filter(lines, lambda x: regexp_matches({_folded_sql("x")}, '{_ANY(M.INSTRUCTION)}|{_ANY(M.CLINICAL)}'))) AS instructed FROM l)
 SELECT conv_id, turn, CASE WHEN regexp_matches(folded, '{_ANY(M.DOCUMENT)}') OR len(lines) >= 3 AND (numbered >= 2 OR numbered >= 1 AND instructed >= 1) THEN 'prescription'
  WHEN regexp_matches(folded, '{_ANY(M.QUESTION)}|{M.QUESTION_PATTERNS}') THEN 'question' ELSE 'other' END AS kind FROM n"""


@query("t12_text_kind", TEXT_KIND_SQL)
def text_kind(spark, sf):
    k = F.col("conv_id") % 3
    head = F.when(k == 0, "1. Omeprazol 20mg x 56 viên\nNgày uống 2 lần\n").when(k == 1, "contraindication? ").otherwise("")
    return table(spark, sf, "conversations").select("conv_id", "turn", M.kind_of_text(F.concat(head, "text", F.lit("\n-\n-"))).alias("kind"))
