"""Literal cases of the text functions and parsers."""

from __future__ import annotations

import uuid
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from materia.functions import text as X
from materia.operators import catalog, chunking, messages, notes, pages, prescriptions, resolve, risk
from materia.sources import landing


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "wanted"), [("  Đường ® HUYẾT–áp ", "duong huyet-ap"), ("", ""), ("Crème\u00a0Brûlée", "creme brulee")])
def test_fold(spark, given, wanted):
    assert one(spark, given, X.fold) == wanted


def test_slug_and_ids(spark):
    assert one(spark, "Acid folic (Vitamin B9)", X.slugify) == "acid-folic-vitamin-b9"
    assert one(spark, "longchau:ingredient:paracetamol:chi_dinh:0001", X.slug_of_chunk_id) == "paracetamol"
    assert one(spark, "trungtamthuoc:paracetamol:chi_dinh:0001", X.slug_of_chunk_id) == "paracetamol"
    assert one(spark, "x:y", X.slug_of_chunk_id) is None
    assert one(spark, "chunk", X.uuid5) == str(uuid.uuid5(uuid.NAMESPACE_URL, "chunk"))


@pytest.mark.parametrize(
    ("raw", "value", "unit", "warnings"),
    [("1% w/v", 1.0, "%", []), ("8", 8.0, None, ["missing_strength_unit"]), ("0,5 MG", 0.5, "mg", []), ("x", None, None, ["unparsed_strength"]), ("", None, None, ["unparsed_strength"])],
)
def test_strength(spark, raw, value, unit, warnings):
    found = one(spark, raw, X.parse_strength)
    assert (found["value"], found["unit"], found["warnings"]) == (value, unit, warnings)


def test_split_outside_parentheses(spark):
    assert one(spark, "A (1mg, 2mg), B (x (y, z)); C\nD", X.split_outside_parentheses) == ["A (1mg, 2mg)", "B (x (y, z))", "C", "D"]


def test_salt_and_stereo(spark):
    assert one(spark, "Metformin Hydrochloride", X.salt_stripped) == ["metformin"]
    assert one(spark, "Natri clorid", X.salt_stripped) == []
    assert one(spark, "natri diclofenac natri", X.salt_stripped) == ["diclofenac natri", "natri diclofenac"]
    assert one(spark, "DL-methionin", X.stereo_stripped) == "methionin"
    assert one(spark, "methionin", X.stereo_stripped) is None


def test_unicode_and_blocks(spark):
    assert one(spark, "a\u00adb\u200bc", X.clean_unicode) == "abc"
    found = one(spark, "x  y\n\nz\nx y\nz", X.dedup_blocks)
    assert (found["text"], found["duplicates"]) == ("x y\nz", 2)


def test_headings_dates_chains(spark):
    assert one(spark, "1.2. Chống chỉ định", X.heading_key) == "chong_chi_dinh"
    assert one(spark, "Chỉ định và chống chỉ định", X.heading_key) == "chi_dinh_chong_chi_dinh"
    assert one(spark, "Bảo quản", X.heading_key) == "bao_quan"
    assert one(spark, "Ngày cập nhật: 05/06/2024", X.updated_at) == "05/06/2024"
    assert one(spark, "a b c | b c | c", X.suffix_chain) is True
    assert one(spark, "a | b | c", X.suffix_chain) is False


def test_wording(spark):
    assert one(spark, "Ngưng thuốc ngay", X.unsafe_wording) is True
    assert one(spark, "Theo dõi", X.unsafe_wording) is False
    assert one(spark, "eGFR < 30 ml/phút", X.egfr_below) is True
    assert one(spark, "eGFR 45", X.egfr_below) is False
    assert one(spark, "Không rõ", X.unknown_value) is True


LINES = [
    ("1. Omeprazol (Kagascdine) 20mg x 56 Viên", 1, "Omeprazol", "Kagascdine", "20mg", 56.0, [("Omeprazol", 20.0, "mg")]),
    ("2. Sucralfate (Sucrate Gel) 1g/5mL x 15 goi", 2, "Sucralfate", "Sucrate Gel", "1g/5mL", 15.0, [("Sucralfate", 1.0, "g")]),
    ("3) Amoxicilin + Acid clavulanic 500mg + 125mg x 10 viên", 3, "Amoxicilin + Acid clavulanic", None, "500mg + 125mg", 10.0, [("Amoxicilin", 500.0, "mg"), ("Acid clavulanic", 125.0, "mg")]),
    ("Betamethason + Acid salicylic (Asosalic) (0,5+30)mg/g x 30g", None, "Betamethason + Acid salicylic", "Asosalic", "(0,5+30)mg/g", 30.0, [("Betamethason", 0.5, "mg"), ("Acid salicylic", 30.0, "mg")]),
    ("Vitamin C", None, "Vitamin C", None, None, None, [("Vitamin C", None, None)]),
]


@pytest.mark.parametrize(("line", "order", "generic", "brand", "strength", "quantity", "ingredients"), LINES)
def test_medication_line(spark, line, order, generic, brand, strength, quantity, ingredients):
    p = prescriptions.parse_lines(spark.createDataFrame([(line,)], "line string"), "line").first()["parsed"]
    assert (p["order_index"], p["generic_text"], p["brand_text"], p["strength_text"]) == (order, generic, brand, strength)
    assert (p["quantity"] and p["quantity"]["value"]) == quantity
    assert [(i["name"], i["strength"] and i["strength"]["value"], i["strength"] and i["strength"]["unit"]) for i in p["ingredients"]] == ingredients


def test_prescription_document(spark):
    text = "Bệnh viện: A\nHọ và tên: B\nTuổi: 61 tuổi\nNam/Nữ: Nữ\nChẩn đoán: Viêm dạ dày / Sỏi thận\nIII. Chỉ định dùng thuốc:\n1. Omeprazol 20mg x 5 viên\nNgày uống 1 lần\n2. Sucralfate 1g x 3 gói\nNgày 1 tháng 2 năm 2024\nBác sĩ C"
    rows = prescriptions.lines(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text")
    meds = prescriptions.medication_lines(rows, "id")
    blocks = sorted(prescriptions.blocks(meds, "id").collect(), key=lambda r: r["block"])
    assert [(b["raw_line"], b["instruction"]) for b in blocks] == [("1. Omeprazol 20mg x 5 viên", "Ngày uống 1 lần"), ("2. Sucralfate 1g x 3 gói", None)]
    c = prescriptions.context(rows, "id", meds).first()
    assert (c["hospital"], c["age"], c["sex"], c["diagnoses"]) == ("A", 61, "female", ["Viêm dạ dày", "Sỏi thận"])
    none = prescriptions.lines(spark.createDataFrame([(1, "no list here")], "id long, text string"), "id", "text")
    assert prescriptions.medication_lines(none, "id").count() == 0


def test_lookup_layers(spark):
    dictionary = spark.createDataFrame(
        [(1, "Thuốc Hapacol", ["Hapa"], ["paracetamol"]), (2, "Đông y", [], ["Natri clorid"]), (3, "Paracetamol", [], [])], "mapping_id long, brand_name string, aliases array<string>, ingredients array<string>")
    asked = spark.createDataFrame([("a", "hapacol"), ("b", "dong y"), ("c", "HAPA"), ("d", "paracetamol"), ("e", "none")], "query_id string, name string")
    found = {(r["query_id"], r["mapping_id"], r["match_type"]) for r in resolve.layered_lookup(asked, dictionary).collect()}
    assert found == {("a", 1, "exact_brand"), ("b", 2, "exact_brand"), ("c", 1, "exact_alias"), ("d", 3, "exact_brand")}


def test_fuzzy_join_loses_nothing(spark):
    names = ["omeprazol", "omeprazole", "esomeprazol", "lansoprazol", "paracetamol", "paracetamon", "ab", "abc", "abd", "metformin", "metfomin", "kali clorid", "kali clorua"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    found = {(r["query_id"], r["id"]): r["score"] for r in resolve.fuzzy_join(df.selectExpr("n AS query_id", "n AS q"), df.selectExpr("n AS id", "n AS c"), 0.66, guard=None).collect()}
    wanted = {(a, b): s for a in names for b in names if (s := SequenceMatcher(None, a, b).ratio()) >= 0.66}
    assert found == pytest.approx(wanted)


def cut_text(spark, text, limit, overlap):
    r = chunking.with_pieces(spark.createDataFrame([(text,)], "t string"), "t", F.lit(limit), overlap).first()
    return r["contents"], r["strategy"]


def test_chunking(spark):
    text = "\n".join(f"line {i} " + "x" * 40 for i in range(20)) + "\n" + "Sentence one. " * 40 + "\n" + "y" * 500
    pieces, strategy = cut_text(spark, text, 200, 50)
    assert strategy == "split" and all(0 < len(c) <= 200 for c in pieces)
    assert {w for c in pieces for w in c.split()} >= {f"{i}" for i in range(20)}
    assert pieces[1].split("\n")[0] == pieces[0].split("\n")[-1]
    assert "".join(c for c in pieces if set(c) == {"y"}) == "y" * 500
    table = "Thuốc | Liều\n" + "\n".join(f"a{i} | b{i}" for i in range(60))
    pieces, strategy = cut_text(spark, table, 120, 50)
    head = "Thuốc | Liều"
    assert all(c.startswith(head) or len(head) + 1 + len(c) > 120 for c in pieces) and strategy == "table_line_group"
    assert cut_text(spark, "aa\nbb\ncc", 5, 0)[0] == ["aa\nbb", "cc"] and cut_text(spark, "aa\nbb\ncc", 5, 2)[0] == ["aa\nbb", "bb\ncc"]
    assert cut_text(spark, "One. Two three. Fourteen.\nx", 10, 0)[0] == ["One.", "Two three.", "Fourteen.", "x"] and cut_text(spark, "abcdefghij kl", 4, 0)[0] == ["abcd", "efgh", "ij", "kl"]


def test_table_repair(spark):
    row = "alpha beta gamma | beta gamma | gamma | alpha beta | other"
    text = "\n".join([row] * 50)
    rows = spark.createDataFrame([(text,), ("a | b",)], "t string").select(chunking.repair_rows(F.col("t")).alias("r")).collect()
    assert [r["r"] for r in rows] == ["\n".join(["alpha beta gamma | other"] * 50), "a | b"]


def test_pair_guards(spark):
    cases = [("kem ab", "xyz", True, False), ("para cet amol", "cet amol", True, True), ("vitamin alpha", "vitamin beta", True, True), ("alpha vitamin", "beta vitamin", False, True),
             ("alpha vitamin", "alpho vitamin", True, True), ("paracetamol", "paracetamo", True, True), ("paracetamol", "ibuprofen", True, False)]
    df = spark.createDataFrame([c[:2] for c in cases], "q string, c string")
    found = df.select(resolve.pair_allowed(F.col("q"), F.col("c")).alias("p"), resolve.ingredient_pair_allowed(F.col("q"), F.col("c")).alias("i")).collect()
    assert [(r["p"], r["i"]) for r in found] == [c[2:] for c in cases]


def test_fuzzy_stage_of_ingredients(spark):
    names = spark.createDataFrame([(1, "paracetamol"), (2, "paracetamoll"), (3, "nothing like it")], "query_id long, name string")
    catalog = spark.createDataFrame([(10, ["paracetamol"], 3), (11, ["paracetamolx"], 0)], "catalog_id long, keys array<string>, chunk_count int")
    found = {(r["query_id"], r["catalog_id"], r["match_type"]): r["score"] for r in resolve.resolve_ingredients(names, catalog).collect()}
    assert found == {(1, 10, "exact"): 1.0, (2, 10, "fuzzy"): pytest.approx(22 / 23)}


def test_pages(spark):
    body = "Mã ATC và tên chung quốc tế. " * 30
    html = f"<html><body><nav>menu</nav><article><h1>Omeprazol</h1><p>Cập nhật: 01/02/2024</p><p>{body}</p><h2>1. Chỉ định</h2><p>A</p><p>A</p><h3>Thận trọng</h3><table><tr><td>x</td><td>y</td></tr></table><h2>Tài liệu tham khảo</h2><p>gone</p></article></body></html>"
    rows = spark.createDataFrame([(1, "u", html), (2, "v", "<p>short</p>"), (3, "w", None)], "page_id long, url string, html string")
    found = {r["page_id"]: r for r in pages.records(rows).collect()}
    assert found[1]["reason"] is None and found[1]["title"] == "Omeprazol" and found[1]["updated_at"] == "01/02/2024"
    assert found[1]["sections"]["chi_dinh"] == "A" and found[1]["sections"]["than_trong"] == "x | y" and "gone" not in str(found[1]["sections"])
    assert found[2]["reason"] == found[3]["reason"] == "parse_error"


def test_messages(spark):
    said = ["Omeprazol có tương tác với sucralfate không?", "Paracetamol có tác dụng phụ gì?", "Dịch câu này sang tiếng Anh", "hello", "Warfarin và Aspirin và warfarin dùng chung có sao không"]
    rows = spark.createDataFrame(list(enumerate(said)), "i int, m string")
    found = {r["i"]: r["c"] for r in messages.classify(rows, "m").collect()}
    assert (found[0]["intent"], found[0]["mentions"], found[0]["confidence"]) == ("drug_interaction_query", ["Omeprazol", "sucralfate"], 0.9)
    assert (found[1]["intent"], found[1]["topic"], found[1]["mentions"]) == ("single_drug_query", "adverse_effect", ["Paracetamol"])
    assert found[2]["intent"] == "out_of_scope" and found[2]["mentions"] == []
    assert [m.lower() for m in found[4]["mentions"]][:2] == ["warfarin", "aspirin"]


def test_notes(spark):
    good = "Theo dõi chức năng thận khi dùng levofloxacin cùng sucralfate"
    rows = spark.createDataFrame([(good,), ("test note abc test",), ("aaaaaaaaaaaaaaaaaaaaaaa",), ("ghi nhớ uống thuốc ghi nhớ uống thuốc ghi nhớ uống thuốc",), (None,)], "t string")
    assert [r["m"] for r in rows.select(notes.meaningful(F.col("t")).alias("m")).collect()] == [True, False, False, False, False]
    keys = spark.range(1).select(notes.pair_keys(F.array(F.lit("Sucralfate"), F.lit("levofloxacin"), F.lit("sucralfate"))).alias("k")).first()["k"]
    assert keys == ["levofloxacin|sucralfate"]


def test_risk_policy(spark):
    schema = "id long, risk_type string, severity string, title string, explanation string, recommendation string, sex string, diagnoses string, renal_function string, hepatic_function string, pregnancy string"
    rows = spark.createDataFrame([
        (1, "interaction", "high", "t", "x", "Ngưng thuốc ngay", "male", "", "", "", "không"),
        (2, "precaution", "moderate", "Bệnh nhân suy thận", "x", "r", "male", "", "Bình thường", "", "unknown"),
        (3, "precaution", "moderate", "Bệnh nhân suy thận", "x", "r", "male", "Suy thận mạn", "Bình thường", "", "unknown"),
        (4, "pregnancy_lactation", "high", "t", "x", "r", "female", "", "", "", ""),
        (5, "pregnancy_lactation", "high", "t", "x", "r", "female", "", "", "", "không mang thai"),
    ], schema)
    found = {r["id"]: r for r in risk.apply_policy(rows).collect()}
    assert found[1]["new_recommendation"] == risk.SAFE_TEXT["interaction"]
    assert (found[2]["action"], found[3]["action"]) == ("removed_renal_function_normal", "keep")
    assert found[4]["new_severity"] == "unknown" and found[4]["asks_confirmation"]
    assert found[5]["action"] == "removed_pregnancy_not_applicable"


def test_identity(spark):
    rows = spark.createDataFrame([("", "longchau:ingredient:natri-clorid:x:0001", None, "Natri clorid là thuốc gì?"), (None, "x", None, None)], "slug string, chunk_id string, name string, title string")
    made = catalog.with_identity(rows, F.col("slug"), F.col("chunk_id"), F.col("name"), F.col("title")).collect()
    assert (made[0]["identity"]["slug"], made[0]["identity"]["entity_name"], made[0]["identity"]["slug_source"]) == ("natri-clorid", "natri clorid", "chunk_id")
    assert made[1]["identity"]["slug"] is None


def test_landing(spark, tmp_path):
    lines = spark.createDataFrame([(1, '{"a": "x"}'), (2, "{"), (3, "[1]"), (4, '{"a": ""}')], "n long, line string")
    landed = landing.land(lines, ["a"])
    assert {r["n"]: r["reason"] for r in landed.collect()} == {1: None, 2: "invalid_json", 3: "invalid_schema", 4: "missing_required_fields"}
    with pytest.raises(ValueError, match="invalid_json: 1"):
        landing.strict(landed)
    path = f"file://{tmp_path}/out"
    landing.publish(lines, path)
    with pytest.raises(Exception, match="(?i)exists"):
        landing.publish(lines, path)
    with pytest.raises(FileNotFoundError):
        landing.first_with_files(spark, [f"file://{tmp_path}/none"])
    assert landing.first_with_files(spark, [f"file://{tmp_path}/none", path]) == path
