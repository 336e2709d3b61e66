"""Extraction and media: literal pages, round trips, edge cases."""

from __future__ import annotations

import hashlib
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from materia.llm import extraction as X
from materia.llm import media

SHELL = (
    '<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/">x</a></li></ul></nav>'
    '<div class="cookie-notice">We use cookies</div><!-- ad --><div class="ad">Buy</div>{main}<aside>Side</aside><div id="comments"><p>A reader</p></div><form><p>Mail</p></form><footer>&copy; us</footer></body></html>'
)


def main_of(html):
    """Text of the main fields of a page, read along its own expression."""
    stream, blocks = X.parse(html)
    own = X.Wrapper(X.expression_of(stream))
    paths = [own.paths[f] for f in own.fields(stream)]
    return "\n".join(t for p, (t, _) in zip(paths, blocks, strict=True) if "*" in p and "!" not in p)


def pattern_of(items):
    """The expression as an ordinary regular expression over tokens, written by its meaning."""
    out = ""
    for x in items:
        inside = pattern_of(x.items)
        one = "(?:# )" if x.label == "#" else f"(?:{inside})" if x.label == "(" else f"(?:{re.escape(x.label)} {inside}/ )"
        out += f"(?:{one}{'+' if x.repeats else ''}){'?' if x.optional else ''}"
    return out


def takes(expression, stream):
    return re.fullmatch(pattern_of(X.read(expression)), "".join(f"{t} " for t in stream)) is not None


def test_article_without_boilerplate():
    html = SHELL.format(main="<article><h1>A &amp; B</h1><p>One\n <b>two</b>three</p><div class='ad'>no</div><p>x<br>y<p>z &lt;p&gt;</p><ul><li>i<li>ii</ul><script>q()</script></article>")
    assert main_of(html) == "A & B\nOne twothree\nx y\nz <p>\ni\nii"


def test_unclosed_tags():
    assert main_of("<nav><a>m</a><article><p><b>T.<br><p>Body</p></article><footer>f") == "T.\nBody"
    assert main_of("<div class=ad>ad<article><p>kept</article>") == "kept"
    assert main_of("") == main_of("<p>") == ""


def test_repeats_and_groups():
    stream = "ul li # / li # / li # / / p # / p # /".split()
    assert X.expression_of(stream) == "ul li+ # / / p+ # /"
    lessons = "div h2 # / p # / p # / h2 # / p # / h2 # / p # / / footer # /".split()
    assert X.expression_of(lessons) == "div (+ h2 # / p+ # / ) / footer # /"
    merged = X.wrapper_of([X.expression_of(s.split()) for s in ("div h1 # / p # / p # / /", "div p # / /", "div p # / table # / /", "div h2 # / p # / h2 # / p # / /")])
    assert merged == "div (+? h2 # / p # / ) h1? # / p+? # / table? # / /"
    assert X.Wrapper(merged).paths == ["div/h2", "div/p", "div/h1", "div/p", "div/table"]
    assert X.write(X.read(merged)) == merged


streams = st.recursive(st.just(["#"]), lambda inner: st.tuples(st.sampled_from(["p", "ul", "h2", "div"]), st.lists(inner, max_size=5)).map(lambda t: [t[0], *sum(t[1], []), "/"]), max_leaves=25)


@settings(max_examples=200, deadline=None)
@given(st.lists(streams, min_size=1, max_size=4))
def test_wrappers_take_their_pages(pages):
    """What is aligned is general enough for each page, by the meaning of regular expressions; every slot has a field of its path."""
    wrapper = X.wrapper_of([X.expression_of(s) for s in pages])
    along = X.Wrapper(wrapper)
    for stream in pages:
        assert takes(wrapper, stream)
        path, paths = [], []
        for t in stream:
            if t == "#":
                paths.append("/".join(path))
            elif t == "/":
                path.pop()
            else:
                path.append(t)
        assert [along.paths[f] for f in along.fields(stream)] == paths


def test_wide_rows():
    stream = [t for i in range(60) for t in (("p", "ul", "h2", "table")[i * i % 7 % 4], "#", "/")]
    wide = X.expression_of(stream)
    assert wide.startswith("(+") and takes(wide, stream) and takes(wide, "ul # / p # /".split())
    assert -1 not in X.Wrapper(wide).fields(stream)


def test_wrappers_decide(spark):
    """Without its fields in the wrapper a text is not content; a damaged wrapper changes the text."""
    page = SHELL.format(main="<article><h1>T</h1><p>text {i}</p></article>")
    df = spark.createDataFrame([(i, "https://a.example/", page.replace("{i}", str(i))) for i in range(4)], "page_id long, url string, html string")
    parsed = X.parse_pages(df, "page_id", "url", "html")
    wrappers = X.infer(parsed)
    texts = lambda w: {r["text"] for r in X.read_along(parsed, w).collect()}
    assert texts(wrappers) == {f"T\ntext {i}" for i in range(4)}
    assert texts(wrappers.withColumn("wrapper", F.lit(""))) == {""}
    assert texts(wrappers.withColumn("wrapper", F.replace("wrapper", F.lit("h1 # /"), F.lit("")))) == {f"text {i}" for i in range(4)}


def test_hot_host_is_merged_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(X, "MERGE", 2)
    kinds = ["<h2>{i}</h2>", "<ul><li>{i}</ul>", "<table><tr><td>{i}</table>", "<pre>{i}</pre>", "<dl><dt>{i}</dl>"]
    rows = [(i, "https://a.example/", "<article>" + "".join(k.format(i=i) for b, k in enumerate(kinds) if i >> b & 1) + "<p>x</p></article>") for i in range(32)]
    found = X.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in found} == {i: "\n".join([str(i)] * bin(i).count("1") + ["x"]) for i in range(32)}
    assert len({r["wrapper"] for r in found}) == 1


def test_long_pages(spark):
    rows = [(1, "u", "<p>" * 50_000 + "end"), (2, "u", "<div>" * 3000 + "deep"), (3, "u", "<article>" + "<p>a<ul><li>b</ul>" * 20_000 + "</article>"), (4, "u", "x" * 2_000_000)]
    found = {r["page_id"]: r["text"] for r in X.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[1] == "end" and found[2] == "deep" and found[3] == "\n".join(["a", "b"] * 20_000) and len(found[4]) == 2_000_000


def test_extract_with_and_without_article(spark):
    rows = [(i, f"https://a.example/{i}", SHELL.format(main=f"<article><p>text {i}</p></article>")) for i in range(4)]
    # a host whose pages have no article: links and what all pages say go, the rest stays
    plain = "<body><div class='top'><a>Home</a> <a>News</a></div><div class='t1'>Welcome to the site</div><div class='x'><p>Story {i} here</p></div></body>"
    rows += [(10 + i, f"http://B.example:80/{i}?q", plain.format(i=i)) for i in range(4)]
    rows += [(20, None, None), (21, "bad url", ""), (22, "https://c.example/", "just text"), (22, "https://c.example/", "just text")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("mine"))
    for limit in (X.BROADCAST_BYTES, 0):
        found = X.extract(df, broadcast_bytes=limit).collect()
        assert len(found) == len(rows)
        text = {r["page_id"]: r["text"] for r in found}
        assert [text[i] for i in range(4)] == [f"text {i}" for i in range(4)]
        assert [text[10 + i] for i in range(4)] == [f"Story {i} here" for i in range(4)]
        assert text[20] == text[21] == "" and text[22] == "just text"
    assert X.extract(df.limit(0)).count() == 0


def test_pages_hold_documents(spark, sf_dir):
    """The pages were made of documents: below its title, an article is one."""
    squeeze = lambda s: " ".join(s.split())
    docs = {squeeze(r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = X.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()
    hits = sum(squeeze(r["text"].partition("\n")[2]) in docs for r in found)
    assert hits >= 0.9 * len(found)


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=5000))
def test_png_round_trip(data):
    padded = data + b"\xff" * (-len(data) % 576)
    image = media.encode_png(padded)
    assert media.decode_png(image) == padded
    with pytest.raises((ValueError, zlib.error)):
        media.decode_png(image[:40] + bytes([image[40] ^ 1]) + image[41:])


def test_sequence():
    d = "a" * 64
    html = f'<p>One &amp; two</p><figure><img src="media:{d}"><figcaption>First <i>cap</i></figcaption></figure>tail<img src="http://x/y.png"><p>end'
    assert media.sequence_of(html) == [(0, "text", "One & two", None, None), (1, "media", None, d, "First cap"), (2, "text", "tail", None, None), (3, "media", None, None, None), (4, "text", "end", None, None)]
    assert media.sequence_of(None) == media.sequence_of("<p></p>") == []


def test_store_and_resolve(spark, monkeypatch):
    rows = [(1, "hello"), (2, "hello"), (3, None), (4, ""), (5, "é<&>" * 3000), (None, "x"), (6, "y" * 576), (7, "z" * 3_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("mine"))
    documents, payloads = media.text_and_media(df)
    found = media.resolve(media.sequences(documents).select("doc_id", "n_bytes", "items"), media.features(media.store(payloads)), ["doc_id", "n_bytes"]).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found}
    for i, t in rows:
        raw = (t or "").encode()
        padded = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = by[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert r["caption"] == f"document {'' if i is None else i}".strip() and r["position"] == int(bool((t or "").strip()))
    assert by[1]["feature"] == by[2]["feature"] and by[1]["media_sha256"] == by[2]["media_sha256"] and by[3]["media_sha256"] == by[4]["media_sha256"]
    # hot digests and others come out alike
    monkeypatch.setattr(media, "HOT", 1)
    again = media.resolve(media.sequences(documents).select("doc_id", "n_bytes", "items"), media.features(media.store(payloads)), ["doc_id", "n_bytes"])
    assert sorted(map(str, again.select(*found[0].asDict()).collect())) == sorted(map(str, found))
    # a reference whose payload isn't stored
    lost = spark.createDataFrame([(9, f'<img src="media:{"0" * 64}">')], "doc_id long, html string")
    r = media.resolve(media.sequences(lost), media.features(media.store(payloads)), ["doc_id"]).first()
    assert r["doc_id"] == 9 and r["payload_sha256"] is None
