"""Column functions on text. All but the ones named ``*_py`` stay inside the JVM.

Python is used only where Spark has no built-in: Unicode normal forms, case
folding, compression ratios and string similarity; always in Arrow batches.
"""

from __future__ import annotations

import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- whitespace, case, accents -------------------------------------------------------------

#: Precomposed Latin letters and the letter they decompose to, by rule.
_FOLD = {
    c: base
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)])
    if len(base := "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")) == 1 and base != c
}


def squeeze(c: Column) -> Column:
    """Runs of Unicode white space to one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize(c: Column) -> Column:
    """Trademark signs dropped, dashes unified, white space squeezed, lower case. Input in NFC."""
    c = F.regexp_replace(c, "[®™]", "")
    c = F.regexp_replace(c, "[\u2010-\u2015\u2212]", "-")
    return F.lower(squeeze(c))


def strip_accents(c: Column) -> Column:
    """Letters without their marks; đ is d."""
    c = F.translate(c, "".join(_FOLD) + "đĐ", "".join(_FOLD.values()) + "dD")
    return F.regexp_replace(c, r"\p{Mn}", "")


def fold(c: Column) -> Column:
    """Normalised and without marks. Of ASCII, where a character is a byte, only white space and case can change: letters are looked up one by one elsewhere only."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(squeeze(c))).otherwise(strip_accents(normalize(c)))


@F.pandas_udf(T.StringType())
def nfc_py(s: pd.Series) -> pd.Series:
    """Canonical composition."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def casefold_py(s: pd.Series) -> pd.Series:
    """Case folding (unlike lower case, ß becomes ss), decomposed, marks dropped, đ is d."""

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        x = unicodedata.normalize("NFD", x.casefold())
        return " ".join("".join(c for c in x if unicodedata.category(c) != "Mn").replace("đ", "d").split())

    return s.map(one)


def preview(c: Column, limit: int = 300) -> Column:
    return F.substring(squeeze(c), 1, limit)


def shorten(c: Column, limit: int = 72) -> Column:
    """At most ``limit`` characters, the last three dots if cut."""
    c = squeeze(c)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, limit - 3)), F.lit("...")))


# --- slugs, ids, hashes ----------------------------------------------------------------------


def slugify(c: Column) -> Column:
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), F.lit("-"))


def chunk_id(source: Column, slug: Column, section: Column, number: Column) -> Column:
    digits = number.cast("string")
    return F.concat_ws(":", source, F.lit("ingredient"), slug, section, F.when(F.length(digits) >= 4, digits).otherwise(F.lpad(digits, 4, "0")))


def slug_of_chunk_id(c: Column) -> Column:
    """The slug in an id of the current layout (source:ingredient:slug:...) or the old (source:slug:...)."""
    part = F.split(c, ":")
    known = (F.size(part) >= 4) & F.get(part, F.lit(0)).isin("trungtamthuoc", "longchau")
    slug = F.when(F.get(part, F.lit(1)) == "ingredient", F.get(part, F.lit(2))).otherwise(F.get(part, F.lit(1)))
    return F.when(known, F.nullif(slug, F.lit("")))


def slug_of_path(path: Column, product_id: Column) -> Column:
    """File stem without a trailing -id, only if it is this product's id and a number."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
    own = product_id.rlike("^[0-9]+$") & F.endswith(stem, F.concat(F.lit("-"), product_id))
    return F.when(F.coalesce(own, F.lit(False)), F.substring(stem, F.lit(1), F.length(stem) - F.length(product_id) - 1)).otherwise(stem)


def uuid5(c: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """Name-based UUID, version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), c.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12),
    )


# --- cleaning -------------------------------------------------------------------------------

_INVISIBLE = "[\u200b-\u200d\ufeff]"


def clean_unicode(c: Column) -> Column:
    """Soft hyphens and zero-width characters removed."""
    return F.regexp_replace(c, "[\u00ad\u200b-\u200d\ufeff]", "")


def unicode_actions(c: Column) -> Column:
    """What ``clean_unicode`` does to a text, as tags in order."""
    return F.array_compact(F.array(
        F.when(F.contains(c, F.lit("\u00ad")), F.lit("removed_soft_hyphen")),
        F.when(c.rlike(_INVISIBLE), F.lit("removed_zero_width_chars")),
    ))


def blocks(c: Column) -> Column:
    """Lines with inner white space squeezed, empty ones dropped."""
    lines = F.split(clean_unicode(c), "\\R|[\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]")
    return F.filter(F.transform(lines, lambda b: F.trim(F.regexp_replace(b, "[\u00a0\t ]+", " "))), lambda b: b != "")


def dedup_blocks(c: Column) -> Column:
    """(text with each distinct line once, number of lines dropped)."""
    all_lines = blocks(c)
    kept = F.array_distinct(all_lines)
    return F.struct(F.array_join(kept, "\n").alias("text"), (F.size(all_lines) - F.size(kept)).alias("duplicates"))


@F.pandas_udf(T.DoubleType())
def deflate_ratio_py(s: pd.Series) -> pd.Series:
    """Compressed by plain UTF-8 size; null for an empty text."""
    import zlib

    def one(x: str | None) -> float | None:
        raw = (x or "").encode()
        return len(zlib.compress(raw)) / len(raw) if raw else None

    return s.map(one).astype("float64")


def repeated_blocks(c: Column, least: int = 100) -> Column:
    """Lines of ``least`` characters or more that repeat an earlier one: (count, characters)."""
    long = F.filter(blocks(c), lambda b: F.length(b) >= least)
    total = lambda a: F.aggregate(a, F.lit(0), lambda n, b: n + F.length(b))
    once = F.array_distinct(long)
    return F.struct((F.size(long) - F.size(once)).alias("count"), (total(long) - total(once)).alias("chars"))


# --- names, strengths ----------------------------------------------------------------------

# Units and endings that the parsers know.
UNITS = ("mg", "g", "mcg", "µg", "ml", "%", "iu", "ui")
SALT_PREFIXES = ("natri", "sodium", "kali", "potassium")
SALT_SUFFIXES = (
    "hcl", "hydrochloride", "hydroclorid", "dihydrochloride", "dihydroclorid", "sodium", "natri", "potassium", "kali", "calcium", "calci",
    "magnesium", "magnesi", "besylate", "besilate", "maleate", "fumarate", "citrate", "phosphate", "phosphat", "sulfate", "sulphate",
    "sulfat", "bisulfate", "succinate", "tartrate", "mesylate", "tosylate", "acetate", "propionate", "dipropionate", "valerate",
    "palmitate", "stearate", "nitrate", "monohydrate", "hydrate", "hemihydrate",
)
PROTECTED = (
    "natri clorid", "sodium chloride", "kali clorid", "potassium chloride",
    "natri bicarbonat", "sodium bicarbonate", "kali bicarbonat", "potassium bicarbonate",
)


def split_outside_parentheses(c: Column) -> Column:
    """Parts between commas, semicolons and line ends outside parentheses of any depth."""
    state = F.struct(F.lit(0).alias("depth"), F.lit("").alias("part"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, x: Column) -> Column:
        depth = s.depth + F.when(x == "(", 1).when((x == ")") & (s.depth > 0), -1).otherwise(0)
        cut = (s.depth == 0) & x.isin(",", ";", "\n")
        return F.struct(
            depth.cast("int").alias("depth"), F.when(cut, "").otherwise(F.concat(s.part, x)).alias("part"),
            F.when(cut, F.concat(s.parts, F.array(s.part))).otherwise(s.parts).alias("parts"),
        )

    parts = F.aggregate(F.split(c, ""), state, step, lambda s: F.concat(s.parts, F.array(s.part)))
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^[ ,;\n]+|[ ,;\n]+$", "")), lambda p: p != "")


def parse_strength(c: Column) -> Column:
    """(value double, unit string, warnings array) of a written strength."""
    pattern = r"(?iu)^\s*(\d+(?:[.,]\d+)?)\s*(mg|mcg|µg|g|ml|iu|ui|%)?"
    value = F.nullif(F.replace(F.regexp_extract(c, pattern, 1), F.lit(","), F.lit(".")), F.lit("")).try_cast("double")
    unit = F.nullif(F.lower(F.regexp_extract(c, pattern, 2)), F.lit(""))
    return F.struct(
        value.alias("value"), F.when(value.isNotNull(), unit).alias("unit"),
        F.when(value.isNull(), F.array(F.lit("unparsed_strength"))).when(unit.isNull(), F.array(F.lit("missing_strength_unit")))
        .otherwise(F.array().cast("array<string>")).alias("warnings"),
    )


def salt_stripped(c: Column) -> Column:
    """Names left when a leading or trailing salt word, or several trailing ones, are taken off."""
    name = normalize(c)
    tokens = F.split(name, " ")
    n = F.size(tokens)
    bare = lambda start, size: F.array_join(F.slice(tokens, start, size), " ")
    first = F.when((n > 1) & F.get(tokens, F.lit(0)).isin(*SALT_PREFIXES), bare(F.lit(2), n - 1))
    tail = F.aggregate(F.reverse(tokens), F.struct(F.lit(0).alias("k"), F.lit(True).alias("on")),
                       lambda s, t: F.struct((s.k + (s.on & t.isin(*SALT_SUFFIXES)).cast("int")).alias("k"), (s.on & t.isin(*SALT_SUFFIXES)).alias("on")),
                       lambda s: F.least(s.k, n - 1))
    rest = F.when(tail > 0, F.transform(F.sequence(F.lit(1), tail), lambda k: bare(F.lit(1), n - k))).otherwise(F.array().cast("array<string>"))
    found = F.filter(F.array_compact(F.concat(F.array(first), rest)), lambda x: F.length(x) >= 4)
    return F.when(name.isin(*PROTECTED), F.array().cast("array<string>")).otherwise(F.array_distinct(found))


def stereo_stripped(c: Column) -> Column:
    """Without a leading d-, l-, dl- or n-; null if there is none."""
    name = normalize(c)
    bare = F.trim(F.regexp_replace(name, r"(?i)^(?:dl|l|d|n)-\s*", ""))
    return F.when((bare != name) & (bare != ""), bare)


# Words that say nothing as a name of their own, and forms a name may start with.
GENERIC_ALIASES = (
    "plus", "extra", "forte", "stella", "dhg", "opc", "pharm", "pharma", "tablet", "capsule", "thuoc", "thuốc", "vien", "viên", "gel", "kem", "siro",
    "bot", "bột", "cao", "dau", "dầu", "ong", "ống", "hop", "hộp", "xoa", "phong", "dịch", "dich", "hỗn", "hon", "nhũ", "nhu", "chai", "lọ", "lo",
    "gói", "goi",
)
FORM_PREFIXES = (
    "dung dịch tiêm truyền tĩnh mạch", "dung dịch truyền tĩnh mạch", "dung dịch tiêm truyền", "thuốc nhỏ mắt", "thuốc nhỏ tai", "viên nén",
    "viên sủi", "dung dịch", "thuốc", "viên", "siro", "gel", "kem",
)


def form_stripped(c: Column) -> Column:
    """Normalised, without the form a name starts with (empty if it is nothing else)."""
    name = normalize(c)
    prefix = "|".join(FORM_PREFIXES)
    return F.trim(F.regexp_replace(name, f"^(?:{prefix})(?: |$)", ""))


def lookup_variants(c: Column) -> Column:
    """Normalised; without accents; without the form; without both. Distinct, none empty."""
    name, bare = normalize(c), form_stripped(c)
    return F.filter(F.array_distinct(F.array(name, strip_accents(name), bare, strip_accents(bare))), lambda v: v != "")


def aliases(c: Column, longest: int = 4) -> Column:
    """The name and its leading words, four to one, each also without accents; no generic or dose word alone."""
    name = form_stripped(F.regexp_replace(c, r"\s*\([^()]*\)\s*$", ""))
    tokens = F.split(name, " ")
    heads = F.transform(F.sequence(F.least(F.lit(longest), F.size(tokens)), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(tokens, F.lit(1), k), " "))
    both = F.flatten(F.transform(F.concat(F.array(name), heads), lambda a: F.array(a, strip_accents(a))))
    dose = r"(?iu)^\d+(?:[.,/]\d+)*(?:mg|mcg|µg|g|ml|iu|ui|%)?$"
    return F.array_distinct(F.filter(both, lambda a: (a != "") & ~a.isin(*GENERIC_ALIASES) & ~a.rlike(dose) & (F.length(a) >= 2)))


# --- URLs, headings, dates -----------------------------------------------------------------


def normalize_url(c: Column, hosts: list[str] | None = None) -> Column:
    """https, no query, no fragment, single slashes, no trailing slash; null off the listed hosts."""
    host = F.lower(F.regexp_extract(c, r"^(?i:https?:)?//([^/?#]+)", 1))
    path = F.regexp_replace(F.regexp_extract(c, r"^(?i:https?:)?//[^/?#]+([^?#]*)", 1), "/{2,}", "/")
    url = F.concat(F.lit("https://"), host, F.regexp_replace(path, "/$", ""))
    known = host.isin(*hosts) if hosts else host != ""
    return F.when(known, url)


def slug_of_url(c: Column) -> Column:
    return F.regexp_extract(normalize_url(c), r"([^/]+)$", 1)


def updated_at(c: Column) -> Column:
    """dd/mm/yyyy after the marker of an update; null if there is none."""
    return F.nullif(F.regexp_extract(c, r"(?iu)cập\s+nhật\s*:\s*(\d{1,2}/\d{1,2}/\d{4})", 1), F.lit(""))


# What a folded heading contains and the section it opens, first rule first.
HEADING_RULES = (
    ("dang_thuoc_va_ham_luong", ("dang thuoc va ham luong",)),
    ("duoc_luc_hoc", ("duoc luc hoc",)),
    ("duoc_dong_hoc", ("duoc dong hoc",)),
    ("chong_chi_dinh", ("chong chi dinh",)),
    ("chi_dinh", ("chi dinh",)),
    ("than_trong", ("than trong",)),
    ("thai_ky_cho_con_bu", ("thoi ky mang thai va cho con bu", "phu nu co thai", "cho con bu")),
    ("tac_dung_khong_mong_muon", ("tac dung khong mong muon", "adr")),
    ("lieu_luong_va_cach_dung", ("lieu luong va cach dung", "lieu dung", "cach dung")),
    ("tuong_tac_thuoc", ("tuong tac thuoc", "tuong tac")),
    ("qua_lieu_va_xu_tri", ("qua lieu va xu tri",)),
    ("bao_quan", ("bao quan",)),
)


def heading_key(c: Column) -> Column:
    """Section key of a heading: that of the first rule it meets, else the heading itself as a key."""
    name = fold(F.regexp_replace(c, r"^\s*\d+(?:\.\d+)*[.)]?\s*", ""))
    own = F.trim(F.regexp_replace(name, "[^a-z0-9]+", "_"), F.lit("_"))
    both = F.contains(name, F.lit("chong chi dinh")) & F.contains(F.replace(name, F.lit("chong chi dinh")), F.lit("chi dinh"))
    return F.when(both, "chi_dinh_chong_chi_dinh").otherwise(first_rule(name, HEADING_RULES, F.when(own == "", "section").otherwise(own)))


def suffix_chain(c: Column) -> Column:
    """Two steps in a row, among the cells of a | b | c, to a shorter cell that the one before contains."""
    cells = F.filter(F.transform(F.split(c, r"\|"), lambda x: F.lower(squeeze(x))), lambda x: x != "")
    state = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(False).alias("found"))

    def step(s: Column, x: Column) -> Column:
        link = F.coalesce((F.length(x) < F.length(s.last)) & F.contains(s.last, x), F.lit(False))
        run = F.when(link, s.run + 1).otherwise(0)
        return F.struct(x.alias("last"), run.cast("int").alias("run"), (s.found | (run >= 2)).alias("found"))

    return F.aggregate(cells, state, step, lambda s: s.found)


# --- rules on wording -----------------------------------------------------------------------


def first_rule(c: Column, rules, default: str | Column) -> Column:
    """Value of the first rule (value, phrases) of which the text contains a phrase."""
    out = None
    for value, phrases in rules:
        hit = F.lit(False)
        for p in phrases:
            hit = hit | F.contains(c, F.lit(p))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(default)


def unknown_value(c: Column) -> Column:
    """Null, empty, or one of the wordings of not known."""
    return F.coalesce(fold(c.cast("string")).isin("", "unknown", "not provided", "chua co thong tin", "chua ghi nhan", "khong ro"), F.lit(True))


def egfr(c: Column) -> Column:
    text = F.regexp_extract(c, r"(?i)egfr\s*(?:[<≤]\s*)?(\d+(?:[.,]\d+)?)", 1)
    return F.nullif(F.replace(text, F.lit(","), F.lit(".")), F.lit("")).try_cast("double")


def egfr_below(c: Column, limit: float = 30) -> Column:
    return F.coalesce(fold(c).rlike(r"egfr\s*[<≤]\s*30"), F.lit(False)) | F.coalesce(egfr(c) < limit, F.lit(False))


# Wordings that tell a patient to change a treatment, folded.
UNSAFE = (
    r"\b(tam\s+)?(ngung|dung)\b", r"\b(thay\s+the|doi\s+sang)\b", r"\b(tang\s+lieu|giam\s+lieu|ke\s+them|bat\s+dau\s+dung)\b",
    r"\b(stop\s+taking|discontinue|switch\s+to)\b", r"\breplace\b.+\bwith\b", r"\b(increase\s+the\s+dose|decrease\s+the\s+dose|start\s+taking)\b",
)


def unsafe_wording(c: Column) -> Column:
    return F.coalesce(fold(c).rlike("|".join(UNSAFE)), F.lit(False))


# --- vectors ----------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def unit(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: x.cast("double") / norm)
