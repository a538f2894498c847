"""N-gram join, embeddings, WARC, classifier and pipeline against brute force and edge cases."""

import io
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fitlake.llm import embedding_dedup, ngram_join, packing, quality_model, scratch, warc
from fitlake.llm.components import connected_components

SF = "/root/testdata/sf0.01"


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def word_sets(rows, words):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        out[i] = {tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))} if w else set()
    return out


@pytest.mark.parametrize(("words", "percent", "chunk"), [(3, 90, 250_000), (5, 80, 250_000), (3, 60, 2000)])
def test_ngram_join_is_brute_force(spark, words, percent, chunk):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = word_sets([(r.doc_id, r.text) for r in docs.collect()], words)
    holders, links = {}, []
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in holders[g] if j > i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                links.append((i, j))
    expected = components(sets, links)
    for r in ngram_join.link_components(docs, words=words, percent=percent, chunk_shingles=chunk).collect():
        assert (r.n_shingles, r.component_id) == (len(sets[r.id]), expected[r.id])


@pytest.mark.parametrize(("percent", "node_sets", "max_common"), [(80, 3, 5), (90, 8, 0), (50, 4, 100)])
def test_ngram_join_of_crowds_is_brute_force(spark, monkeypatch, percent, node_sets, max_common):
    """Crowds of texts that share more or less of a template, of all sizes, with nodes that overflow."""
    monkeypatch.setattr(ngram_join, "NODE_SETS", node_sets)
    monkeypatch.setattr(ngram_join, "MAX_COMMON", max_common)
    rng = np.random.default_rng(percent)
    rows = []
    for k in range(12):
        template = [f"t{k % 9}x{j}" for j in range(rng.integers(1, 120))]
        for _ in range(rng.integers(1, 40)):
            share = rng.choice([0.6, 0.75, 0.82, 0.88, 0.9, 0.95, 0.99, 1.0])
            own = [w if rng.random() < share else f"o{rng.integers(1 << 40)}" for w in template]
            rows.append((len(rows), " ".join(own[: rng.integers(1, len(own) + 1)] if rng.random() < 0.2 else own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = word_sets(rows, 1)
    links = [
        (i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    expected = components(sets, links)
    found = ngram_join.link_components(docs, words=1, percent=percent, chunk_shingles=400).collect()
    assert {r.id: r.component_id for r in found} == expected


def test_templates_send_no_text(spark):
    """Texts that share 60 % of their words, and don't link, are ruled out before any text moves, in any number."""
    rng = np.random.default_rng(4)
    template = [f"t{j}" for j in range(300)]
    for n in (200, 800):
        texts = [" ".join(template[:180] + [f"o{x}" for x in rng.integers(1 << 40, size=120)]) for _ in range(n)]
        docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("text", F.encode("text", "UTF-8"))
        base = ngram_join._sets(docs, 5, 80, ngram_join._common_tokens(docs, 5))
        sets = base.select("digest", F.col("id").alias("rep"), "n", "bits")
        assert ngram_join._meetings(sets, 80).count() == 0


def test_ngram_join_edges(spark):
    rows = [(1, "a b c d e f"), (2, "A b  c\nd e f"), (3, None), (4, ""), (5, "a"), (6, "A"), (None, "a b c d e f"), (2, "a b c d e f")]
    docs = spark.createDataFrame([(i, t, "x", 0, 0) for i, t in rows], "doc_id long, text string, digest string, n int, rep int")
    out = sorted(ngram_join.link_components(docs).collect(), key=str)
    assert len(out) == len(rows)
    found = {r.id: (r.n_shingles, r.component_id) for r in out}
    assert found == {1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (0, 4), 5: (1, 5), 6: (1, 5), None: (2, None)}
    kept = [r.doc_id for r in ngram_join.stage(spark, docs, "").collect()]
    assert sorted(kept, key=str) == [1, 3, 4, 5, None]
    assert ngram_join.link_components(docs.limit(0)).count() == 0


def test_join_stage_decides_by_row(spark):
    """An id at two texts is two documents: what one of them is a copy of says nothing of the other."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(12)) for x in "abc")
    rows = [(7, a), (7, b), (3, b), (7, a), (8, c), (8, c + " more"), (9, c), (5, None), (5, " "), (None, b), (1, "alone")]
    docs = spark.createDataFrame([(i, t, k, 0) for k, (i, t) in enumerate(rows)], "doc_id long, text string, row int, node int")
    out = ngram_join.stage(spark, docs, "")
    assert out.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    both = [(8, c), (8, c + " more")]
    assert [x for x in kept if x not in both] == sorted([(7, a), (3, b), (5, None), (5, " "), (None, b), (1, "alone")], key=str)
    assert sum(x in both for x in kept) == 1


def test_components_of_a_path(spark):
    edges = spark.range(200).selectExpr("(id * 37) % 200 + 1000 AS a", "((id + 1) * 37) % 200 + 1000 AS b").where("a > 1000 OR b > 1000")
    assert {r.component for r in connected_components(edges).collect()} == {1000}
    assert connected_components(edges.limit(0)).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(150, 16))
    crowd = base[0] + rng.normal(scale=0.05, size=(60, 16))
    vectors = [v.tolist() for v in np.concatenate([base, crowd, base[:5]])]
    vectors += [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0] * 3]
    rows = [(i, v, 0, 1) for i, v in enumerate(vectors)] + [(None, vectors[0], 0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, weight int, label int")
    unit = np.array(vectors[:215])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    expected = components(range(215), zip(*np.nonzero(near), strict=True))
    old, embedding_dedup.CHUNK_VECTORS = embedding_dedup.CHUNK_VECTORS, 16
    try:
        out = {r.vec_id: r for r in embedding_dedup.near_embeddings(df).collect()}
    finally:
        embedding_dedup.CHUNK_VECTORS = old
    assert len(out) == len(rows)
    for i in range(215):
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (near[i].sum(), expected[i], expected[i] == i)
    for i in range(215, 221):
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (0, i, True)
    assert (out[None].n_links, out[None].component_id) == (0, None)
    single = df.where("vec_id < 215").selectExpr("vec_id", "CAST(embedding AS array<float>) AS embedding")
    for r in embedding_dedup.near_embeddings(single).collect():  # no pair lies within a float's error of the threshold
        assert (r.n_links, r.component_id) == (near[r.vec_id].sum(), expected[r.vec_id])
    assert embedding_dedup.near_embeddings(df.limit(0)).count() == 0


def test_warc_round_trip_and_damage(spark, tmp_path):
    big = "x" * 200
    rows = [(1, "http://a\n", "é" + big), (2, None, "é" + big), (3, "u", None), (4, "u", ""), (None, "u", "é" + big), (5, "u", "short"), (6, "u", "short"), (2, None, "é" + big)]
    pages = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string")
    path = f"file://{tmp_path}/archives"
    files = warc.write_archives(pages, path, archive_bytes=400)
    out = warc.read_archives(files, path).collect()
    assert len(out) == len(rows) and sum(f.records for f in files.collect()) == len(rows)
    by = {r.page_id: r for r in out}
    assert by[1].url == "http://a\n" and bytes(by[1].payload).decode() == "é" + big and by[1].record_type == "response"
    assert (by[2].record_type, by[2].refers_to, by[2].payload_bytes, by[2].payload) == ("revisit", 1, 202, None)
    assert by[3].payload_bytes == 0 and by[6].record_type == "response" and by[None].record_type == "response"
    one = warc.record(1, "u", b"payload", __import__("hashlib").sha256(b"payload").hexdigest(), None, 7)
    assert [r["payload"] for r in warc.read_records(io.BytesIO(one + one))] == [b"payload"] * 2
    plain = zlib.decompress(one, 31)
    for bad in (one[:-9], _gz(plain.replace(b"payload", b"paylosd")), _gz(plain[:-1]), _gz(plain + b"x"), _gz(b"no record\r\n\r\n")):
        with pytest.raises((warc.WarcError, zlib.error)):
            list(warc.read_records(io.BytesIO(bad)))
    assert warc.read_archives(warc.write_archives(pages.limit(0), path + "0"), path + "0").count() == 0


def test_warc_of_long_and_odd_values(spark, tmp_path):
    """Headers and payloads of any length, and urls with blanks and signs anywhere, come back whole."""
    urls = ["http://a/" + "x" * 3_000_000, "  blanks at ends \t", "a%20b\r\n\r\nc: d", "é\u2028\u00a0", ""]
    rows = [(i, u, "p" * 5_000_000 if i == 1 else f"page {i}\r\n\r\n", f"http{i}") for i, u in enumerate(urls)]
    rows.append(rows[4])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    for path in (f"file://{tmp_path}/odd", f"{tmp_path}/plain"):
        out = warc.read_archives(warc.write_archives(pages, path), path).collect()
        assert sorted((r.page_id, r.url, bytes(r.payload).decode()) for r in out) == sorted(r[:3] for r in rows)


def test_scratch_folder(spark):
    """The session's setting first; a temporary folder only where everything runs on one machine."""
    session = spark.newSession()
    assert scratch.shared_dir(session) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert scratch.qualified(spark, "/a b/c") == "file:///a b/c" and scratch.qualified(spark, "file:///x") == "file:///x"
    assert scratch.qualified(spark, "s3a://bucket/x") == "s3://bucket/x"


def _gz(data):
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality_model.op5_quality_model(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert len(scored) > 100 and docs.count() == quality_model.op5_quality_model(spark, sf).count()
    assert np.mean([r.predicted == r.quality for r in scored]) > 0.93
    assert np.mean([r.predicted for r in scored if r.quality == 1]) > 0.98


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "ab", 1.0), (None, "x" * 100_000, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(3, None), (1, 1)], "doc_id long, quality int")
    network = quality_model.train(docs, labels)
    rows = quality_model.score_texts(docs, network).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    # A long text scores the same in parts as in one go.
    rng = np.random.default_rng(0)
    network.out[:] = rng.normal(size=len(network.out))
    text = bytes(rng.integers(32, 120, 90_000, np.uint8))
    tables = network.pair_tables()
    whole = network.score(text, tables)
    old, quality_model.SEGMENT_CHUNKS = quality_model.SEGMENT_CHUNKS, 3
    try:
        assert abs(network.score(text, tables) - whole) < 1e-9
    finally:
        quality_model.SEGMENT_CHUNKS = old


def test_classifier_of_empty_tables_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "good text"), (1, "good text"), (2, "bad"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(2, 0), (2, 1), (1, 1), (1, 1), (None, 0)], "doc_id long, quality int")
    network = quality_model.train(docs, labels)  # the label of 2 contradicts itself: one kind is left
    assert len({r.score for r in quality_model.score_texts(docs, network).collect()}) == 1
    assert quality_model.score_texts(docs.limit(0), quality_model.train(docs.limit(0), labels.limit(0))).count() == 0
    scored = quality_model.score_texts(docs.withColumn("score", F.lit("clash")), network)
    assert scored.columns == ["doc_id", "text", "score"] and scored.count() == 4


def test_embeddings_that_share_an_id(spark):
    """Rows of one id and other vectors are one node: what links with one links with all."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r.vec_id: r.component_id for r in embedding_dedup.near_embeddings(df).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4}


def test_pipeline_of_odd_documents(spark):
    """Null and empty texts go with the rules; repeated rows, null ids and an empty table are no trouble."""
    sound = " ".join(f"word{i}" for i in range(80))
    rows = [(1, None, "a"), (2, "", "a"), (3, sound, "a"), (3, sound, "a"), (None, sound + " x", None), (4, sound + "\n" + sound[::-1], "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for table in (docs, docs.limit(0)):
        kept = table
        for name, stage in corpus_pipeline.STAGES:
            if name == "quality classifier":
                continue  # what it keeps depends on what it learned
            kept = stage(spark, kept, SF)
            assert name == "best-fit packing" or kept.columns == docs.columns
        ids = [r.doc_id for r in kept.select("doc_id").distinct().collect()]
        assert (set(ids) <= {3, 4, None} and 3 in ids) if table is docs else not ids


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns, name
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == ids
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert ids & good


def test_pipeline_of_texts_that_are_not_utf8(spark, tmp_path):
    """Spark hands bytes that are not UTF-8 on as they are; no stage fails on them, and no document is lost."""
    texts = {i: " ".join(f"word{i}x{j}" for j in range(80)).encode() + (b" \xc3 \xff\xed\xa0\x80 end" if i % 2 else b"") for i in range(12)}
    rows = spark.createDataFrame([(i, bytearray(x)) for i, x in texts.items()], "doc_id long, text binary")
    docs = rows.select("doc_id", F.col("text").cast("string").alias("text"), F.lit("a").alias("source"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1) for i in texts], "doc_id long, quality int")  # one kind: all score alike
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    plain = spark.createDataFrame([(i, x.decode("utf-8", "replace")) for i, x in texts.items()], "doc_id long, text string")
    wanted = {(r.id, r.piece, r.length, r.ids_crc32) for r in packing.token_pieces(plain).collect()}
    assert {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed} == wanted
    # Learning reads the bytes themselves, of more than one kind of label too.
    network = quality_model.train(docs, labels.withColumn("quality", (F.col("doc_id") % 3 == 0).cast("int")))
    assert len({r.score for r in quality_model.score_texts(docs, network).collect()}) == len(texts)
