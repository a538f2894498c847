"""BPE, packing, licence scan, HTML and quality rules against brute force and edge cases."""

import hashlib
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest

from fitlake.llm import bpe, html_text, line_dedup, packing, quality_rules, registry

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, t string, key string, id long"


@pytest.fixture(scope="module")
def edge_docs(spark):
    texts = [None, "", " \n\t ", "one two", "A long enough line that stands in every document here.\n" * 2 + "x", "z" * 30_000, "é ß\nＡ", "same", "same"]
    rows = [(i if i != 6 else None, x, None, None if i % 2 else "src", None, "r", "t", "k", 1) for i, x in enumerate(texts)]
    rows += [(100 + i, "A long enough line that stands in every document here.\nown " + str(i), "en", "src", 1, "", "", "", 1) for i in range(6)]
    rows.append(rows[1])
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(rows):
    return sorted(str(tuple(str(v) for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = registry.queries()[name](spark, SF), con.sql(registry.oracle_sql()[name])
    assert plain(ours.select(theirs.columns).collect()) == plain(theirs.fetchall())


def test_bpe_equals_the_tokenizers_library():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    coder = bpe.Encoder(bpe.vocabulary_path(), leaf_chars=16, window_chars=2)
    rng = random.Random(5)
    pieces = ["a", "th", "ing", "é", " ", "  ", "\n", "'", "'s", "!", "!!", "12", "$$$", "日本", "😀", "<|endoftext|>", "\x1c", "T", "-", "\x85"]
    for _ in range(3000):
        some = rng.sample(pieces, rng.randint(1, 6))
        text = "".join(rng.choice(some) for _ in range(rng.randint(0, 90)))
        ids = whole.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == ids
        assert coder.decode(ids) == whole.decode(ids, skip_special_tokens=False)


def test_bpe_edges(spark, edge_docs, no_docs):
    out = bpe.encode_texts(edge_docs, decoded=True).collect()
    texts = [r.text or "" for r in edge_docs.collect()]
    assert [r.decoded for r in out] == texts
    assert bpe.encode_texts(no_docs).count() == 0


def test_packing_is_gapless_and_tight(spark, edge_docs, no_docs):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 1025, 3000)
    bins, offsets = packing.pack(lengths)
    for b in range(bins.max() + 1):
        at = 0
        for k in sorted(np.flatnonzero(bins == b), key=lambda k: offsets[k]):
            assert offsets[k] == at
            at += lengths[k]
        assert 0 < at <= 1024
    assert bins.max() + 1 <= 1.02 * -(-lengths.sum() // 1024)
    assert packing.cut(2050, 1024) == [(0, 2), (2, 1024), (1026, 1024)] and packing.cut(1024, 1024) == [(0, 1024)]
    coder, rows = bpe.encoder(), packing.pack_documents(edge_docs).collect()
    for r in edge_docs.where("doc_id = 5").collect():
        ids = np.array([*coder.encode(r.text), 2], "<u4")
        own = sorted((x for x in rows if x.doc_id == 5), key=lambda x: x.start)
        assert sum(x.length for x in own) == len(ids)
        assert all(x.ids_crc32 == zlib.crc32(ids[x.start : x.start + x.length].tobytes()) for x in own)
    assert packing.pack_documents(no_docs).count() == 0


def test_line_dedup_edges(spark, edge_docs, no_docs):
    rows = line_dedup.drop_repeated_lines(edge_docs).select("row.doc_id", "n_lines", "n_dropped", "kept_text").collect()
    found = {r.doc_id: r for r in rows}
    assert len(rows) == edge_docs.count()
    assert (found[0].n_lines, found[0].kept_text) == (1, "")
    assert found[4].n_dropped == 2 and found[4].kept_text == "x"
    assert found[105].n_dropped == 0 and found[104].kept_text == "own 4"
    assert found[None].kept_text == "é ß\nＡ"
    assert line_dedup.drop_repeated_lines(no_docs).count() == 0
    assert line_dedup.stage(spark, edge_docs, "").columns == edge_docs.columns


def test_quality_rules_edges(spark, edge_docs, no_docs):
    rows = quality_rules.quality_verdicts(edge_docs).collect()
    assert len(rows) == edge_docs.count() and not any(r.kept for r in rows)
    assert quality_rules.quality_verdicts(no_docs).count() == 0
    clean = " ".join(f"word{i}" for i in range(80))
    docs = [(i, clean + str(i), "en", "good" if i < 30 else "bad", 1) for i in range(32)] + [(100 + i, "no", "en", "bad", 1) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.id for r in quality_rules.quality_verdicts(df).where("kept").collect()}
    assert kept == set(range(30))  # two sound documents go with their host
    assert {r.doc_id for r in quality_rules.stage(spark, df, "").collect()} == kept


def test_host_verdicts_match_sql(spark):
    """A limit that some hosts of the table cross and others don't."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = quality_rules.document_counts(docs, "doc_id", "text", "source")
    rates = sorted(r.shrunk_rate for r in quality_rules.host_verdicts(counts).collect())
    limit = (rates[-3] + rates[-4]) / 2
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    theirs = con.sql(f"SELECT doc_id, base_failed, kept FROM ({quality_rules.oracle_rules(max_rate=limit)})").fetchall()
    ours = quality_rules.quality_verdicts(docs, max_rate=limit).select("id", "base_failed", "kept").collect()
    assert plain(ours) == plain(theirs)
    assert any(not failed and not kept for _, failed, kept in theirs) and any(kept for *_, kept in theirs)


def test_quality_rules_of_a_very_long_text(spark):
    """Counts are whole beyond any size of a position or a batch."""
    text = " ".join(f"w{i}" for i in range(400_000)) + "\n" + " ".join(f"w{i}" for i in range(300))
    df = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    row = quality_rules.quality_verdicts(df).collect()[0]
    assert (row.n_words, row.n_repeat_words, row.n_dup_lines) == (400_300, 600, 0)


def test_repeated_words_beside_a_like_hash(spark):
    """The hashes of 'w1826410 x y' and 'w2433512 x y' agree in their upper 40 bits."""
    texts = ["w1826410 x y w2433512 x y w1826410 x y", "w2433512 x y w1826410 x y w2433512 x y", "w1826410 x y w2433512 x y", "a b c d a b c"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    found = {r.id: r.n_repeat_words for r in quality_rules.quality_verdicts(df).collect()}
    assert found == {0: 6, 1: 6, 2: 0, 3: 6}


def test_html(spark):
    page = """<html class="has-sidebar"><body class="nav-open"><header><h1>Site</h1></header><div id="cookie-notice"><p>We use cookies, many, many of them.</p></div>
    <div id=main><div class="content"><h2>Title</h2><p>First, with commas &amp; a <a href=x>link</a>.<p>Second <i>one<br>x</i><ul><li>a<li>b</ul></div>
    <div class=sidebar><ul><li><a>one</a></ul></div><section id="comments"><article><p>Great post, thanks, really, nice, yes.</article></section></div><footer>(c)"""
    assert html_text.main_text(page) == "Title\nFirst, with commas & a link.\nSecond one x\na\nb"
    assert html_text.main_text("") == "" and html_text.main_text("a < b & c") == "a < b & c"
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.DOTALL)[1]
        import html

        parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", p.replace("<br>", " ")))).strip() for p in re.split(r"</?(?:p|h1)>", inner))
        assert html_text.main_text(r.html) == "\n".join(p for p in parts if p)
    edge = spark.createDataFrame([(1, None, None, "x"), (None, "u", "", "x"), (1, "u", "<p>" * 3000 + "deep", "x")], "page_id long, url string, html string, text string")
    assert [r.text for r in html_text.extract_text(edge).collect()] == ["", "", "deep"]


LONG = "A sentence of the text, with commas, and more, so that it counts, as it should, for the main text of the page. " * 4
SHORT = "A short section, of one paragraph, that has a few hundred characters and too few points to stay by itself. " * 2


def test_html_siblings_without_points():
    """Pages without <article>: what stands beside the best container and belongs to it stays."""
    text = lambda *blocks: html_text.main_text("<body>" + "".join(blocks) + "</body>").split("\n")
    long, short = LONG.strip(), SHORT.strip()
    content = f"<div class=content><p>{long}</p><p>{long}</p><p>{long}</p></div>"
    nav = "<div><a href=x>One</a> <a href=y>Two</a></div>"
    assert text("<h1>T</h1>", content) == ["T", *[long] * 3]
    assert text("<h1>T</h1><div>By me</div>", content) == ["T", "By me", *[long] * 3]
    assert text("<h1>T</h1>", f"<div>{content}</div>") == ["T", *[long] * 3]
    assert text(content, "<pre>x = 1</pre>", nav) == [*[long] * 3, "x = 1"]
    assert text("<pre>x = 1</pre>", content) == ["x = 1", *[long] * 3]
    assert text(content, "<table><tr><td>1</table>", content) == [*[long] * 3, "1", *[long] * 3]
    assert text(content, f"<h2>S</h2><section><p>{short}</p></section>") == [*[long] * 3, "S", short]
    assert text(content, "<h2>S</h2><div>short</div>", content) == [*[long] * 3, "S", "short", *[long] * 3]
    assert text("<div>Site</div>", "<h1>T</h1>", nav, content, nav, "<div>2020 Acme</div>") == [long] * 3
    assert text(nav, "<h1><a href=x>T</a></h1>", content, "<nav>x</nav><div>2020 Acme</div>") == [long] * 3


PROSE = "<p>A long paragraph, with commas, and words, that goes on for a while, so that it counts, as prose.</p>" * 9


@pytest.mark.parametrize(
    "before, after",
    [
        ('<div class="elementor-element elementor-widget elementor-widget-text">', "</div>"),
        ('<main><div class="commentary">', "</div></main>"),
        ('<main><div class="shared-layout">', "</div></main>"),
        ('<main><div id="notice-to-readers">', "</div></main>"),
        ('<form id="aspnetForm"><nav><a href=x>y</a></nav><div>', "</div></form>"),
        ("<html><head><title>x</title><meta a=b><div>", "</div>"),
        ("<html><head><title>x</title>", ""),
        ('<body><div class="page has-sidebar"><div class=content>', "</div><div class=sidebar><a href=x>y</a> zz</div></div>"),
        ('<table><tr><td class="nav"><a href=x>y</a></td><td>', "</td></tr></table>"),
    ],
)
def test_looks_that_mislead(before, after):
    assert html_text.main_text(before + PROSE + after).split("\n") == ["A long paragraph, with commas, and words, that goes on for a while, so that it counts, as prose."] * 9


def test_rows_of_a_table():
    page = f"<table><tr><td>{PROSE}</td></tr><tr><td>{PROSE}</td></tr><tr><td><a href=x>{PROSE}</a></td></tr></table>"
    assert html_text.main_text(page).count("A long") == 18


def test_furniture_is_not_taken_back_beside_an_article():
    """A short article stays alone, and an empty one gives nothing, however long comments and adverts are."""
    comments = f"<div class=comments>{PROSE}</div><div class=notice>{PROSE}</div><footer>{PROSE}</footer><form>{PROSE}</form>"
    assert html_text.main_text(f"<article><h1>T</h1><p>Short.</p></article>{comments}") == "T\nShort."
    assert html_text.main_text(f"<article></article>{comments}") == ""
    assert html_text.main_text(f'<article><h2 id="related-work">Related</h2><p>x</p><section id="comments">{PROSE}</section></article>') == "Related\nx"
    assert html_text.main_text(f"<nav>{PROSE}</nav><script>{PROSE}</script>") == ""


@pytest.mark.parametrize("part", ["<a ", "<a \">\" ", "<div></section>", "< ", "<!--", "<p>", "<ul><li>", "<table><tr><td>x", "<b><div><i></b>", "<div>", "<article>a", "&amp;<b", "<a href='"])
def test_time_is_linear(part):
    """A page of 1 MB and more, of markup at its worst."""
    began = time.time()
    html_text.main_text(part * (1_000_000 // len(part)))
    assert time.time() - began < 60  # a quadratic reader takes minutes to hours


def test_long_pages_and_empty_tables(spark):
    words = " ".join(f"w{i}," for i in range(200_000))
    rows = [(1, "u", f"<body><nav>x</nav><div><p>{words}</p><p>{words}</p></div>", 1), (1, "u", f"<p>{words}", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    out = sorted(html_text.extract_text(pages).collect(), key=lambda r: r.n_chars)
    assert [r.text for r in out] == [words, f"{words}\n{words}"] and [r.n_chars for r in out] == [len(words), 2 * len(words) + 1]
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_sha_columns(spark):
    row = bpe.op6_bpe(spark, SF).where("doc_id = 1").collect()[0]
    text = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id = 1").collect()[0].text
    ids = bpe.encoder().encode(text)
    assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and row.n_tokens == len(ids)


def test_bpe_query_equals_the_library_on_the_whole_table(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    rows = bpe.op6_bpe(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = whole.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), digest(",".join(map(str, ids))))
        assert r.decoded_sha256 == digest(whole.decode(ids, skip_special_tokens=False))


def test_packing_query_on_the_whole_table(spark):
    """Every document's tokens, once and whole; sequences without gaps, and hardly more than there must be."""
    coder = bpe.encoder()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = packing.op10_packing(spark, SF).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == docs.keys()
    for doc, own in by_doc.items():
        ids = np.array([*coder.encode(docs[doc]), 2], "<u4")
        at = 0
        for k, r in enumerate(sorted(own, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 1024)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(by_sequence) <= -(-sum(r.length for r in rows) // 1024) + 2


def test_packing_of_null_ids_and_repeated_rows(spark, edge_docs):
    rows = packing.pack_documents(edge_docs).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in edge_docs.collect()}
    places = [(r.sequence_id, r.offset) for r in rows]
    assert len(set(places)) == len(places) and sum(r.doc_id == 1 for r in rows) == 2
    assert rows[0].asDict().keys() == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
