"""Messages: intent, topic, drug mentions; and whether a text looks like a prescription or a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from materia.functions import text as X

# Phrases and patterns of the rules, in the order they are tried. Phrases are compared folded.
INTERACTION = ("tuong tac", "dung cung", "uong cung", "dung chung", "uong chung", "phoi hop", "ket hop", "co sao khong", "co anh huong khong")
SINGLE_LOOKUP = r"\bco\s+nhung\s+tuong\s+tac\s+thuoc\s+nao\b|\btuong\s+tac\s+voi\s+thuoc\s+nao\b|\bco\s+tuong\s+tac\s+gi\b"
TOPICS = (
    ("adverse_effect", ("tac dung phu", "tac dung khong mong muon", "adr")), ("contraindication", ("chong chi dinh", "khong dung khi nao")), ("caution", ("than trong", "luu y", "can chu y")),
    ("dosage", ("lieu", "cach dung", "uong the nao")), ("pregnancy_lactation", ("thai", "mang thai", "cho con bu")), ("renal", ("suy than", "than")), ("hepatic", ("suy gan", "gan")),
)
MEDICAL = (
    "adr", "benh nhan", "chong chi dinh", "cach dung", "duoc", "hoat chat", "ke don", "lieu", "luu y", "mang thai", "suy gan", "suy than", "tac dung phu", "than trong", "thuoc", "tuong tac", "uong",
)
TRANSLATION = r"\bdich\s+cau\s+nay\b|\bdich\s+sang\s+tieng\b|\bdich\s+.*\s+sang\s+tieng\b"
OUT_OF_SCOPE = r"\bbai\s+van\b|\blam\s+tho\b|\bthoi\s+tiet\b|\bdau\s+tu\b|\bchung\s+khoan\b|\bcode\b|\blap\s+trinh\b"
CONNECTORS = (
    r"\bcó\s+tương\s+tác\s+với\b", r"\bdùng\s+cùng\b", r"\buống\s+cùng\b", r"\bdùng\s+chung\b", r"\buống\s+chung\b", r"\bphối\s+hợp\s+với\b", r"\bkết\s+hợp\s+với\b", r"\bvới\b", r"\bvà\b",
)
TRAILING = (
    r"\bcó\s+những\s+tương\s+tác\s+thuốc\s+nào\b.*$", r"\btương\s+tác\s+với\s+thuốc\s+nào\b.*$", r"\bcó\s+tương\s+tác\b.*$", r"\btương\s+tác\b.*$", r"\bcó\s+sao\b.*$", r"\bcó\s+ảnh\s+hưởng\b.*$",
    r"\bcó\s+tác\s+dụng\s+phụ\b.*$", r"\btác\s+dụng\s+phụ\b.*$", r"\btác\s+dụng\s+không\s+mong\s+muốn\b.*$", r"\bdùng\s+cần\s+lưu\s+ý\b.*$", r"\bcần\s+thận\s+trọng\b.*$", r"\bthận\s+trọng\b.*$",
    r"\bchống\s+chỉ\s+định\b.*$", r"\bkhông\s+dùng\s+khi\s+nào\b.*$", r"\bliều\b.*$", r"\bcách\s+dùng\b.*$", r"\buống\s+thế\s+nào\b.*$", r"\bcần\s+lưu\s+ý\b.*$", r"\blưu\s+ý\b.*$",
    r"\bkhông\b$", r"\bgì\b$",
)
LEADING = r"^(cho\s+tôi\s+hỏi|cho\s+tôi\s+thông\s+tin\s+về|xin\s+hỏi|hỏi|thông\s+tin\s+về|thuốc|dịch\s+truyền)\s+"
GENERIC = (
    "adr", "benh nhan", "cach dung", "chong chi dinh", "dich", "dung", "gan", "gi", "khong", "khong dung khi nao", "lieu", "luu y", "mang thai", "nhau", "nao", "suy gan", "suy than",
    "tac dung khong mong muon", "tac dung phu", "thai", "than", "than trong", "thuoc", "thuoc nao", "uong",
)
MENTION = r"([A-Za-zÀ-ỹ][A-Za-zÀ-ỹ0-9.+/-]*(?:\s+[A-Za-zÀ-ỹ][A-Za-zÀ-ỹ0-9.+/-]*){0,3})"
QUESTION = (
    "adr", "adverse", "aspirin", "chong chi dinh", "contraindication", "dose", "drug", "dung chung", "dung cung", "interaction", "lieu", "medicine", "paracetamol", "phoi hop", "prescription",
    "side effect", "tac dung", "than trong", "thuoc", "tuong tac", "uong chung", "uong cung",
)
QUESTION_PATTERNS = r"\bco\s+sao\s+khong\b|\bco\s+van\s+de\s+gi\s+khong\b|\bco\s+anh\s+huong\s+gi\s+khong\b|\bdung\s+cung\s+nhau\b|\buong\s+cung\s+nhau\b"
DOCUMENT = ("don ngoai tru", "don thuoc", "thong tin benh nhan", "thong tin lam sang", "chi dinh dung thuoc")
INSTRUCTION = ("ngay uong", "moi lan", "sang", "trua", "toi")
CLINICAL = ("chan doan", "di ung", "benh nen", "chuc nang gan", "chuc nang than", "thai ky")


def any_of(folded: Column, phrases: tuple[str, ...]) -> Column:
    return F.coalesce(folded.rlike("|".join(phrases)), F.lit(False))


def _clean(c: Column) -> Column:
    c = X.squeeze(F.regexp_replace(c, r"[?!.:,;()\[\]{}]", " "))
    c = F.trim(c, F.lit(" -/"))
    c = F.trim(F.regexp_replace(c, f"(?iuU){LEADING}", ""))
    c = F.trim(F.regexp_replace(c, "(?iuU)(?:" + "|".join(TRAILING) + ")", ""))
    return F.trim(X.squeeze(c), F.lit(" -/"))


def with_mentions(rows: DataFrame, message: str, most: int = 4, out: str = "mentions") -> DataFrame:
    """``rows`` with the names on both sides of the first connector, cleaned of what isn't a name; one step a column."""
    names = list(rows.columns)
    split = None
    for pattern in CONNECTORS:
        parts = F.split(message, f"(?iuU){pattern}", 2)
        hit = F.col(message).rlike(f"(?iuU){pattern}")
        split = F.when(hit, parts) if split is None else split.when(hit, parts)
    rows = rows.withColumn("_sides", split.otherwise(F.array(message)))
    rows = rows.withColumn("_sides", F.transform("_sides", _clean))
    rows = rows.withColumn("_parts", F.flatten(F.transform("_sides", lambda s: F.split(s, r"(?iuU)\b(?:và|với)\b"))))
    rows = rows.withColumn("_parts", F.transform("_parts", _clean))
    rows = rows.withColumn("_parts", F.transform("_parts", lambda p: _clean(F.regexp_extract(p, MENTION, 1))))
    rows = rows.withColumn("_found", F.transform("_parts", lambda m: F.struct(m.alias("m"), X.fold(m).alias("f"))))
    rows = rows.withColumn("_found", F.filter("_found", lambda x: (F.length(x.f) >= 3) & ~x.f.isin(*GENERIC)))
    # equal after folding is one mention, as first written
    keys = F.transform("_found", lambda x: x.f)
    rows = rows.withColumn("_keys", keys)
    keep = F.filter("_found", lambda x, i: F.array_position("_keys", x.f) == i + 1)
    return rows.select(*(c for c in names if c != out), F.slice(F.transform(keep, lambda x: x.m), 1, most).alias(out))


def classify(rows: DataFrame, message: str, out: str = "c") -> DataFrame:
    """``rows`` with a struct of intent, topic, confidence and mentions of each message."""
    names = list(rows.columns)
    rows = with_mentions(rows, message, out="_mentions").withColumn("_folded", X.fold(F.col(message)))
    folded, n = F.col("_folded"), F.size("_mentions")
    rows = rows.withColumns({
        "_medical": any_of(folded, MEDICAL), "_asks_pair": any_of(folded, INTERACTION), "_single": folded.rlike(SINGLE_LOOKUP), "_topic": X.first_rule(folded, TOPICS, "general"),
        "_off": folded.rlike(OUT_OF_SCOPE), "_translation": folded.rlike(TRANSLATION),
    })
    outside = F.col("_translation") | (~F.col("_medical") & F.col("_off"))
    pair = F.col("_asks_pair")
    single = pair & (n == 1) & F.col("_single")
    about = (F.col("_topic") != "general") | (n > 0) | F.col("_medical")
    intent = F.when(outside, "out_of_scope").when(single, "single_drug_query").when(pair, "drug_interaction_query").when(about, "single_drug_query").otherwise("out_of_scope")
    confidence = F.when(outside, 0.95).when(single, 0.85).when(pair & (n >= 2), 0.9).when(pair, 0.65).when(about & (n > 0), 0.85).when(about, 0.55).otherwise(0.75)
    made = F.struct(
        intent.alias("intent"), F.when(outside, "general").when(pair, "interaction").otherwise(F.col("_topic")).alias("topic"), confidence.alias("confidence"),
        F.when(outside, F.array().cast("array<string>")).otherwise(F.col("_mentions")).alias("mentions"),
    )
    return rows.select(*(c for c in names if c != out), made.alias(out))


def kind_of_text(text: Column) -> Column:
    """prescription, question or other, by phrases and counts of lines."""
    folded = X.fold(text)
    lines = F.filter(F.transform(F.split(text, r"\R"), lambda x: F.trim(x)), lambda x: x != "")
    count = lambda p: F.size(F.filter(lines, p))
    numbered = count(lambda x: x.rlike(r"(?iu)^\s*\d+\s*[.)\-]\s+.+\b(?:mcg|µg|mg|g|ml|iu|ui|mui|viên|vien|gói|goi)\b"))
    instructed, clinical = count(lambda x: any_of(X.fold(x), INSTRUCTION)), count(lambda x: any_of(X.fold(x), CLINICAL))
    prescription = any_of(folded, DOCUMENT) | ((F.size(lines) >= 3) & ((numbered >= 2) | ((numbered >= 1) & ((instructed >= 1) | (clinical >= 1)))))
    return F.when(prescription, "prescription").when(any_of(folded, QUESTION) | folded.rlike(QUESTION_PATTERNS), "question").otherwise("other")
