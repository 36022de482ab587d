"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

from fluvispark.llm import decontamination, fingerprints, language_id, line_dedup, mixing, near_dedup, pii, quality, queries, token_planes, url_filters

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, bucket string, score double, spans string, h long, block long"
ONE = "the cat sat on the mat and looked at the dog.\nthe second line is here.\nthe third line is here.\nand a fourth."


def rows():
    long = " ".join(f"word{i % 977} é{i % 31}" for i in range(40_000))
    texts = [
        (None, None), (None, ONE), (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, long), (4, long), (5, ONE), (5, ONE), (5, "a different text of the same id"), (6, ONE + " tail"),
        (7, "\x00\x1f odd \u2028 日本語 \U0001f600 mixed"), (8, "9" * 5000 + " a@b.co " + "+" * 50), (9, "a." * 3000 + "@x"), (10, "Mail joe@example.org or +1 (555) 123-4567, 4111 1111 1111 1111, 10.0.0.300 and 10.0.0.3."),
    ]
    return [(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else "s", None, None, "x", None, "y", None, 1) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def bench(spark, empty=False):
    items = [] if empty else [(1, ONE), (1, ONE), (2, None), (3, ""), (4, "x y"), (None, "lost")]
    return spark.createDataFrame(items, "item_id long, text string")


def test_quality(spark, docs, none):
    got = quality.classify(docs).collect()
    assert len(got) == docs.count()
    assert all(not r.kept and r.score == 0 for r in got if r.doc_id in (0, 1, 2))
    assert quality.classify(none).count() == 0


def test_decontamination(spark, docs, none):
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench(spark)).collect()}
    assert {(5, 1), (6, 1), (None, 1)} <= got and not {d for d, _ in got} & {0, 1, 2, 3, 4, 7, 8}
    assert decontamination.contaminated(docs, bench(spark, True)).count() == 0 and decontamination.contaminated(none, bench(spark)).count() == 0
    left = decontamination.clean(docs, bench(spark))
    assert left.columns == docs.columns and left.count() == docs.count() - 4
    assert decontamination.clean(docs, bench(spark, True)).count() == docs.count()


def test_mixing(spark, docs, none):
    got = mixing.mix(docs, repetition_limit=2.0).collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows()}
    assert sum(r.epoch == 1 for r in got) == docs.count()
    assert mixing.mix(none, repetition_limit=2.0).count() == 0


def test_language(spark, docs, none):
    model = language_id.fit(docs)
    got = language_id.identify(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (0, 1, 2)} == {"und"}
    empty = language_id.fit(none)
    assert {r.lang_pred for r in language_id.identify(docs, empty).collect()} == {"und"}
    assert language_id.accept(docs, model).columns == docs.columns and language_id.accept(none, model).count() == 0


def test_line_dedup(spark, docs, none):
    got = line_dedup.dedup(docs.select("doc_id", "text", "kept", "bucket", "h", "score"))
    assert got.count() == docs.count()
    by = {(r.doc_id, r.n_removed) for r in got.collect()}
    assert (None, 0) in by and (5, 4) in by and (0, 0) in by
    assert line_dedup.dedup(none).count() == 0
    assert line_dedup.dedup(docs).columns[: len(docs.columns)] == docs.columns


def test_token_planes(spark, docs, none, tmp_path):
    token_planes.write(docs, f"file://{tmp_path}/a", queries.tokenizer_path())
    got = token_planes.read(spark, f"file://{tmp_path}/a").orderBy("start").collect()
    assert len(got) == docs.count() and [r.n_tokens for r in got if r.doc_id in (0, 1)] == [1, 1]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    token_planes.write(none, f"file://{tmp_path}/b", queries.tokenizer_path())
    assert token_planes.read(spark, f"file://{tmp_path}/b").count() == 0


def test_fingerprints(spark, docs, none):
    got = fingerprints.compare_with_next(docs).collect()
    assert len(got) == docs.count() and {r.fingerprint for r in got if r.doc_id in (0, 1, 2)} == {"-"}
    assert len({r.fingerprint for r in got if r.doc_id == 4}) == 1
    assert fingerprints.compare_with_next(none).count() == 0
    alone = fingerprints.compare_with_next(docs.filter("doc_id = 3")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0 and alone[0].edited_sha256 == hashlib.sha256(b"one").hexdigest()


def test_pii(spark, docs, none):
    got = pii.find(docs).collect()
    assert len(got) == docs.count()
    last = next(r for r in got if r.doc_id == 10)
    assert [s.kind for s in last.base] == [0, 1, 2, 3]
    assert pii.find(none).count() == 0
    text = next(r.text for r in pii.redact(docs).collect() if r.doc_id == 10)
    assert text == "Mail <EMAIL> or <PHONE>, <CARD>, 10.0.0.300 and <IP>."


def test_near_duplicates(spark, docs, none):
    got = near_dedup.near_duplicates(docs)
    assert got.count() == docs.count()
    by = {r.doc_id: (r.component_id, r.kept) for r in got.collect()}
    assert by[6] == (5, False) and by[0] == (0, True) and by[None] == (None, True) and by[4] == (4, True)
    assert near_dedup.near_duplicates(none).count() == 0


def test_urls(spark):
    rules = spark.createDataFrame([("org", "/", "allow"), ("a.org", "/x/", "block"), ("a.org", "/x/y", "allow"), ("a.org", "/x/", "block"), (None, "/", "block"), ("", "/", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://W.a.ORG/x/1?q", 9), (1, "http://W.a.ORG/x/1?q", 9), (2, None, 9), (3, "", 9), (4, "no scheme", 9), (5, "x://a.org/x/yz#f", 9), (6, "x://ba.org/x/", 9), (7, "x://a.org", 9), (None, "x://" + "s." * 60 + "a.org/x/" + "p/" * 2000, 9)], "page_id long, url string, verdict long")
    got = sorted(((r.page_id or 0, r.rule, r.verdict) for r in url_filters.judge(pages, rules).collect()), key=str)
    assert got == [(0, "a.org/x/", "block"), (1, "a.org/x/", "block"), (1, "a.org/x/", "block"), (2, None, "allow"), (3, None, "allow"), (4, None, "allow"), (5, "a.org/x/y", "allow"), (6, "org/", "allow"), (7, None, "allow")]
    assert url_filters.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filters.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_a_kept_id_keeps_its_texts(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(5, ONE, 1), (5, ONE, 0), (5, "another text of the same id", 2), (6, ONE, 3), (None, ONE, 4), (None, ONE, 5)], "doc_id long, text string, extra int")
    got = sorted((r.doc_id or 0, r.text, r.extra) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == [(0, ONE, 4), (0, ONE, 5), (5, "another text of the same id", 2), (5, ONE, 0)]


def test_pipeline_stages(spark, docs, none, tmp_path):
    import corpus_pipeline

    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (docs, none):
        kept = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, kept, str(tmp_path))
            if name == "token_ids":
                assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == kept.count()
            else:
                assert out.columns == docs.columns, name
                kept = spark.createDataFrame(out.collect(), out.schema)


CLASH = ["_id", "_part", "_spans", "_lines", "_kept", "_Kept", "_rows", "_row", "_row_", "_epoch", "epoch", "row", "src", "blocks", "lang_pred", "item_id", "kept", "component_id", "h", "ids"]


def test_columns_of_any_name_are_kept(spark, docs):
    import corpus_pipeline

    wide = docs.select("doc_id", "text", "lang", "source", "n_chars").withColumns({c: F.lit(k) for k, c in enumerate(c for c in CLASH if c != "_Kept")})
    values = [k for k, _ in enumerate(CLASH[:-1])]
    texts = lambda df: sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.collect())
    stages = [line_dedup.dedup, lambda d: mixing.shown(d, repetition_limit=2.0), lambda d: corpus_pipeline.near_duplicates(spark, d, "")]
    for stage in stages:
        got = stage(wide)
        assert [c for c in wide.columns if c not in got.columns] == []
        assert got.select(*[c for c in CLASH if c != "_Kept"]).distinct().collect() == [tuple(values)]
        assert texts(got) == texts(stage(docs.select("doc_id", "text", "lang", "source", "n_chars")))
