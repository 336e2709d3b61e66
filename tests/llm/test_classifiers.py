"""Language, quality, toxicity and personal data: held-out accuracy and exact cases."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from materia.llm import langid, pii, quality, toxicity
from materia.llm import queries as Q
from materia.llm.common import crc_mod


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    found = Q.op7_language(spark, sf).join(truth, "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert len(found) == truth.count() and len(held) > 100
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in found) and np.mean([r["rejected"] for r in found]) < 0.01


def test_language_edge_cases(spark):
    rows = [(i, f"der die das und nicht {i % 7} schön über", "de") for i in range(40)] + [(100 + i, f"the and of which {i % 5} with then", "en") for i in range(40)]
    rows += [(200, None, None), (201, "", "de"), (202, "12 34 !?", None), (203, "本日は晴天なり", None), (205, "😀😀 🎉", "de"), (204, "the and " * 200_000, None), (None, "die und", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("LANG_SCORE", F.lit("mine"))
    model = langid.fit(df)
    found = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    assert found[0]["lang_pred"] == "de" and found[100]["lang_pred"] == found[204]["lang_pred"] == "en"
    assert {(found[i]["lang_pred"], found[i]["lang_score"], found[i]["lang_rejected"]) for i in (200, 201, 202, 205)} == {("und", 0.0, True)}
    assert found[203]["lang_rejected"] and not found[0]["lang_rejected"]
    kept = langid.keep_known(df)
    assert kept.columns == df.columns and {200, 201, 202, 203, 205}.isdisjoint(r["doc_id"] for r in kept.collect())
    empty = df.limit(0)
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    unlearned = langid.identify(df, langid.fit(empty)).collect()
    assert {r["lang_pred"] for r in unlearned} == {"und"}


def test_language_by_definition(spark):
    """n-grams, weights and cosines one by one give what ``identify`` does."""
    import math

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    model = langid.fit(docs, sample=20, dims=1 << 10)
    for r in langid.identify(docs, model).collect():
        codes = [ord(c) if c.isalpha() else 32 for c in r["text"].lower()]
        seen, shift = {}, 32 - 10
        for i, a in enumerate(codes):
            h = a * 2654435761 % 2**32
            hashes = [h]
            for b, odd, mul in zip(codes[i + 1 : i + 3], (2246822519, 668265263), (3266489917, 374761393), strict=False):
                h = (h ^ b * odd % 2**32) * mul % 2**32
                hashes.append(h)
            for h in hashes:
                seen[h >> shift] = seen.get(h >> shift, 0) + 1
        x = {k: math.log1p(n) * float(model.weight[k]) for k, n in seen.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        cosines = [sum(v * float(c[k]) for k, v in x.items()) / norm for c in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert r["lang_score"] == pytest.approx(cosines[best], abs=1e-4)
        assert r["lang_pred"] == model.languages[model.owner[best]] or sorted(cosines)[-1] - sorted(cosines)[-2] < 1e-4


def test_unknown_language_is_rejected(spark):
    """With a language left out of the table to learn from, its texts go; texts of the others stay, short ones too."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    for gone in ("fr", "de"):
        model = langid.fit(docs, (F.col("lang") != gone) & (crc_mod("doc_id", 4) != 2))
        found = langid.identify(docs.filter(crc_mod("doc_id", 4) == 2), model).withColumn("size", F.length("text")).collect()
        own = [r["lang_rejected"] for r in found if r["lang"] == gone and r["size"] > 100]
        others = [r["lang_rejected"] for r in found if r["lang"] != gone]
        short = [r["lang_rejected"] for r in found if r["lang"] != gone and r["size"] < 100]
        assert np.mean(own) > 0.85 and np.mean(others) < 0.01 and np.mean(short) < 0.05


def test_ngrams_in_parts(monkeypatch):
    grams = langid.Ngrams()
    text = "".join(random.Random(1).choices("abc dé1", k=999))
    whole = grams.counts(text)
    monkeypatch.setattr(langid, "_PART", 10)
    assert (grams.counts(text) == whole).all() and whole.sum() == 999 + 998 + 997


@pytest.mark.parametrize(("query", "label", "least"), [("op2_toxicity", "toxic", 0.97), ("op3_quality", "quality", 0.97)])
def test_held_out_accuracy(spark, query, label, least):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/labels.parquet")
    found = getattr(Q, query)(spark, sf)
    assert found.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = found.join(truth, "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r[label] for r in held]) >= least
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in held)


def test_factorisation_by_definition():
    rng = np.random.default_rng(2)
    size = quality.WORD_DIMS + len(quality.STATISTICS) * quality.RANGES
    m = quality.Machine(np.zeros((len(quality.STATISTICS), quality.RANGES - 1)), 0.3, rng.normal(size=size), rng.normal(size=(size, quality.RANK)))
    rows = [(rng.choice(size, 9, replace=False), rng.normal(size=9)), (rng.choice(size, 3, replace=False), rng.normal(size=3))]
    for (at, x), z in zip(rows, m.raw(rows), strict=True):
        pairs = sum(m.vector[at[i]] @ m.vector[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))
        assert z == pytest.approx(m.bias + m.weight[at] @ x + pairs)


def test_quality_scores_by_definition(spark):
    """Statistics, ranges, hashed words and all pairs one by one give the score of each document."""
    import zlib
    from collections import Counter

    rng = np.random.default_rng(4)
    size = quality.WORD_DIMS + len(quality.STATISTICS) * quality.RANGES
    edges = np.sort(rng.normal(size=(len(quality.STATISTICS), quality.RANGES - 1)), axis=1)
    m = quality.Machine(edges, 0.2, rng.normal(size=size) / 4, rng.normal(size=(size, quality.RANK)) / 4)
    rows = [(1, "One two two, three!\nOne two | x"), (2, ""), (3, None), (4, "ÉÉ 99 %% a.b\n\na.b"), (5, "a " * 40)]
    for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string"), m).collect():
        text = r["text"] or ""
        raw, words, lines = text.encode(), text.split(), text.split("\n")
        n, counts = max(1, len(words)), Counter(words)
        letters = max(1, sum(c.isascii() and c.isalpha() for c in text))
        share = lambda marks: sum(text.count(c) for c in marks) / max(1, len(raw))  # noqa: B023, E731
        stats = [np.log1p(len(raw)), np.log1p(len(words)), len(text) / n, len(counts) / n, max(counts.values(), default=0) / n, sum("A" <= c <= "Z" for c in text) / letters,
                 share("0123456789"), share("#$%&*@^~"), share("|"), share("!,.:;?"), np.log1p(len(lines)), np.log1p(len(text) / len(lines)), 1 - len(set(lines)) / len(lines),
                 sum(b >= 192 for b in raw) / max(1, len(raw)), len(set(zip(words, words[1:], strict=False))) / max(1, n - 1)]
        bag = Counter()
        for w, c in counts.items():
            bag[zlib.crc32(w.encode()) % quality.WORD_DIMS] += c
        norm = max(1e-12, float(np.sqrt(sum(np.log1p(c) ** 2 for c in bag.values()))))
        x = [(k, np.log1p(c) / norm) for k, c in bag.items()]
        x += [(quality.WORD_DIMS + i * quality.RANGES + sum(s >= e for e in edges[i]), 0.5) for i, s in enumerate(stats)]
        z = m.bias + sum(m.weight[k] * v for k, v in x)
        z += sum(m.vector[a] @ m.vector[b] * u * v for i, (a, u) in enumerate(x) for b, v in x[:i])
        assert r["quality_score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_quality_edge_cases(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 300_000), (4, "a b"), (4, "a b"), (None, "\n\n")], "doc_id long, text string").withColumn("quality_score", F.lit("mine"))
    labels = spark.createDataFrame([(1, 1), (2, None), (4, 0), (None, 1)], "doc_id long, quality int")
    m = quality.fit(df, labels, F.lit(True))
    found = quality.score(df, m).collect()
    assert len(found) == 6 and all(0 <= r["quality_score"] <= 1 for r in found)
    one_class = quality.fit(df, labels.filter("quality = 1"), F.lit(True))
    assert all(r["quality_score"] > 0.99 for r in quality.score(df, one_class).collect())
    none = quality.fit(df, labels.limit(0), F.lit(True))
    assert all(r["quality_score"] == pytest.approx(0.5) for r in quality.score(df, none).collect())
    assert quality.score(df.limit(0), m).count() == 0


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_automaton_against_distances():
    terms = [toxicity.Term(t, s, w) for t, s, w in (("idiot", False, 3.0), ("moron", False, 2.0), ("bad", False, 1.0), ("lowei", True, 4.0), ("moronic", False, 5.0))]
    terms.append(toxicity.Term("loweisen", False, 4.5, True))
    machine = toxicity.Automaton(terms)
    rng = random.Random(4)
    words = ["idiot", "idot", "idiott", "xdiot", "moro", "bad", "bd", "loweix", "lowe", "loweiabc", "moronik", ""]
    for t in terms:
        for _ in range(300):
            w = list(t.text)
            for _ in range(rng.randrange(3)):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randrange(2)] = rng.choice(["", "a", "o", "i"])
            words.append("".join(w))
    for word in words:
        hits = [(0, t.weight, False) for t in terms if t.stem and word.startswith(t.text)]
        hits += [(-d, t.weight, t.inflected) for t in terms if not t.stem and (d := levenshtein(word, t.text)) <= t.edits]
        assert machine.match(word) == max(hits, default=None), word


def test_toxicity_windows_and_edges(spark):
    model = toxicity.Model([toxicity.Term("idiot", False, 6.0)], {"idiom"}, np.array([-3.0, 4.0, 0.5, 1.0, 1.0, 1.0, 0.0]))
    m = toxicity.Matcher(model)
    abuse, quoted, typo = m.features("you idiot there"), m.features('he wrote "an idiot" about it'), m.features("you idioot")
    assert abuse[1] > 0 == abuse[2] and quoted[2] > 0 == quoted[1] and typo[3] > 0 == typo[1]
    assert not m.hits("an idiom")[1] and not m.features(None)[1:].any()
    df = spark.createDataFrame([(1, None), (2, ""), (3, "IDIOT"), (3, "IDIOT"), (4, "idiot " * 50_000), (None, "fine")], "doc_id long, text string").withColumn("Toxic_Score", F.lit(9))
    found = toxicity.score(df, model).collect()
    assert len(found) == 6 and all((r["toxic_score"] >= 0.5) == (r["doc_id"] in (3, 4)) for r in found)
    none = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"), crc_mod("doc_id", 5) != 0)
    assert not none.terms and all(r["toxic_score"] < 1e-6 for r in toxicity.score(df, none).collect())
    assert toxicity.score(df.limit(0), model).count() == 0


def test_scores_by_definition(spark):
    """Each match by plain distances and each window by counting give the features that the score is made of."""
    terms = [toxicity.Term("idiot", False, 6.0), toxicity.Term("scum", False, 3.0), toxicity.Term("lowei", True, 4.5), toxicity.Term("loweisen", False, 4.0, True)]
    weights = np.array([-3.0, 2.0, -0.5, 1.5, 1.0, 0.5, 0.25])
    rng = random.Random(7)
    texts = [" ".join(rng.choices(["fine", "idiot", "idoit", "idiots", "scum", "loweier", "loweisan", "loweisen", '"', "and\n", "he", "idiom"], k=rng.randrange(40))) for _ in range(200)]
    found = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), toxicity.Model(terms, {"idiom"}, weights)).collect()
    for r in found:
        low = r["text"].lower()
        words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\W_]+", low)]
        hits = {}
        for i, (_, _, w) in enumerate(words):
            fits = [(-levenshtein(w, t.text), t.weight, t.inflected) for t in terms if not t.stem and levenshtein(w, t.text) <= t.edits]
            fits += [(0, t.weight, False) for t in terms if t.stem and w.startswith(t.text)]
            if fits and not (max(fits)[0] < 0 and w == "idiom"):
                hits[i] = max(fits)
        sums, dense = [0.0] * 4, 0
        for i, (edits, weight, inflected) in hits.items():
            near = sum(i - 8 <= j < i for j in hits)
            before = low[words[max(0, i - 8)][0] : words[i][0]].split("\n")[-1]
            after = low[words[i][1] : words[min(len(words) - 1, i + 8)][1]].split("\n")[0]
            kind = 1 if before.count('"') % 2 and '"' in after else 0 if not edits else 2 + inflected
            sums[kind] += min(weight, 6) / 6 * (1 + near / 4)
            dense = max(dense, near + 1) if kind == 0 else dense
        exact = len({words[i][2] for i, h in hits.items() if not h[0]})
        z = weights @ [1, *np.log1p([*sums, exact, dense])]
        assert r["toxic_score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9), r["text"]


def test_misspelt_and_rare_terms_are_learned(spark):
    """Inflected terms with a letter wrong, short terms, and terms of a rare language are found; clean texts stay."""
    rng = random.Random(3)
    filler = [f"{a}{b}{c}" for a in ("ba", "do", "ki") for b in ("lo", "mi", "ru") for c in ("ta", "ne", "so")]
    say = lambda *more: " ".join([*rng.choices(filler, k=25), *more])
    rows, marks = [], []
    for i in range(2000):
        ends = ["en", "er", "isch", "ung"]
        word = [f"schmutz{rng.choice(ends)}", "idiotic", "oaf"][i % 3] if i % 40 else "vuoto"
        toxic = i % 5 == 0
        rows.append((i, say(word, word) if toxic else say()))
        marks.append((i, int(toxic)))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int"), F.lit(True))
    tried = {"schmutzen": 1, "schmutzem": 1, "schmitzen": 1, "idiotci": 0, "idiotik": 1, "oaf": 1, "vuoto": 1, "vuotto": 1, "balota": 0}
    found = toxicity.score(spark.createDataFrame([(w, say(w)) for w in tried], "word string, text string"), model).collect()
    assert {r["word"]: int(r["toxic_score"] >= 0.5) for r in found} == tried


def plain_base(text):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_by_definition(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choices("ab.@+- ()0123456789%_\n", k=rng.randrange(60))) for _ in range(6000)]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    texts += ["4111 1111-1111 1111", "1.2.3.4.5.6.7.8", "001.02.3.255", "a@b@c.d.e", "+1 (234) 567-8900 4111111111111111"]
    assert all(pii.base_spans(t) == plain_base(t) for t in texts)


def test_viterbi_against_all_paths():
    import itertools

    rng = np.random.default_rng(8)
    t = pii.train().steps
    t = np.where(t < -1e8, t, rng.normal(size=t.shape))
    emissions = [rng.normal(size=(n, len(pii.TAGS))) for n in (1, 2, 3, 4, 4, 1)]
    for e, tags in zip(emissions, pii.viterbi(emissions, t), strict=True):
        value = lambda p: e[np.arange(len(p)), p].sum() + t[list(p[:-1]), list(p[1:])].sum() + (-1e9 if pii.TAGS[p[0]].startswith("I-") else 0)  # noqa: B023, E731
        best = max(itertools.product(range(len(pii.TAGS)), repeat=len(e)), key=value)
        assert tuple(tags) == best


def test_parted_sequences_decode_alike():
    """Parting at words that are surely outside changes no tag, on random fields and on texts."""
    rng = np.random.default_rng(9)
    mask = pii.train().steps < -1e8
    parted = 0
    for trial in range(300):
        t = np.where(mask, -1e9, rng.normal(scale=rng.choice([0.3, 1, 3]), size=mask.shape))
        emissions = [rng.normal(size=(rng.integers(0, 30), len(pii.TAGS))) * 3 + [rng.choice([0, 4, 8]), 0, 0, 0, 0] for _ in range(4)]
        for e, a, b in zip(emissions, pii.decode(emissions, t), pii.viterbi(emissions, t), strict=True):
            assert (a == b).all(), trial
            parted += pii.surely_outside(e, t).sum() if len(e) else 0
    assert parted > 1000


def test_reader_by_definition(spark):
    field = pii.train()
    reader = pii.Reader(field)
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(80).collect():
        words = pii._TOKEN.findall(r["text"])
        assert np.allclose(reader.emissions(words), field.emissions(words))


def held_out_secrets(rng):
    """(text, wanted span) in forms and words that the training table lacks."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    some = lambda pool, n: "".join(rng.choice(pool) for _ in range(n))
    before = ["wir schreiben hier etwas und dann", "The deployment notes say that", "je pense que", "config of the service follows"]
    for _ in range(40):
        secrets = [
            ("password=", some(letters, rng.randrange(9, 20))), ("api_key=", some(letters, 24)), ("", "AKIA" + some(letters.upper(), 16)),
            ("DB_PASSWORD=", some(letters + "0123456789", 14)), ('my_token = "', some("0123456789abcdef", 32)), ("api_key:\n", some(letters + letters.upper() + "0123456789", 28)),
            ("secret: ", some(letters + "0123456789", 22)), ("Bearer ", some(letters + letters.upper() + "0123456789", 40)), ("passwd: ", some(letters + letters.upper() + "0123456789", 11)),
            ("client_secret='", some(letters + "0123456789", 30)),
        ]
        ids = [("SSN ", f"{some('0123456789', 3)}-{some('0123456789', 2)}-{some('0123456789', 4)}"), ("DNI ", some("0123456789", 8) + some("TRWAGMY", 1)),
               ("number ", f"{some('0123456789', 3)}-{some('0123456789', 2)}-{some('0123456789', 4)}")]
        for kind, cases in (("secret", secrets), ("natid", ids)):
            for cue, value in cases:
                text = f"{rng.choice(before)} {cue}{value} "
                at = len(text) - len(value) - 1
                yield text + "and nothing else happened", (at, at + len(value), kind)


def test_recall_and_precision_of_learned_spans(spark):
    reader = pii.Reader(pii.train())
    cases = list(held_out_secrets(random.Random(12)))
    found = pii.learned_spans([t for t, _ in cases], reader)
    for kind in ("secret", "natid"):
        own = [(w, f) for (_, w), f in zip(cases, found, strict=True) if w[2] == kind]
        assert np.mean([w in f for w, f in own]) >= 0.9
    every, right = sum(map(len, found)), sum(w in f for (_, w), f in zip(cases, found, strict=True))
    assert right / every >= 0.9
    quiet = ["the password is wrong", "she forgot the secret password of the house", "token by token and key by key", "password: required", "Keys and tokens", "a long internationalisation story",
             "on 2024-05-06 at 12:30 we saw 1234 birds", "INTERNATIONALISATION MATTERS", "version 10.2.3 build 20240506", "https://www.example.com/a/b?c=d"]
    assert not any(pii.learned_spans(quiet, reader))
    # clean documents: what is found there holds a secret as the documents have them
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    free = lambda t, a, b: not any(a < d and c < b for c, d, _ in pii.base_spans(t))
    spans = [t[a:b] for t, f in zip(texts, pii.learned_spans(texts, reader), strict=True) for a, b, _ in f if free(t, a, b)]
    assert len(spans) >= 13 and np.mean([bool(re.fullmatch("[0-9a-f]{40}", s)) for s in spans]) >= 0.9


def test_learned_spans_and_edges(spark):
    said = 'und password=b7db7aa4a5fcc78305 enes. token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae" x. ssn 123-45-6789 for it. mail a.12@mail3.example.com now'
    rows = [(1, said), (1, said), (2, None), (3, ""), (4, "7" * 100_000), (5, "plain words only"), (None, "call +1 (234) 567-8900")]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string").withColumn("pii_base", F.lit(1))).collect()
    assert len(found) == len(rows)
    kinds = {(said[s["start"] : s["stop"]], s["kind"]) for r in found if r["doc_id"] == 1 for s in r["pii_spans"]}
    assert kinds == {("b7db7aa4a5fcc78305", "secret"), ("1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae", "secret"), ("123-45-6789", "natid"), ("a.12@mail3.example.com", "email")}
    assert all(not r["pii_spans"] for r in found if r["doc_id"] in (2, 3, 5))
    assert [s["kind"] for r in found if r["doc_id"] is None for s in r["pii_base"]] == ["phone"]
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0
