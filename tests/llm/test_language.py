"""Language ID with missing, wrong and scarce evidence."""

import random

import pytest
from pyspark.sql import functions as F

from eventloom.llm import langid, queries


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 600").withColumn("true", F.col("lang")).cache()


def agreement(found):
    return found.where("true is not null").agg(F.avg((F.col("lang_id") == F.col("true")).cast("double"))).first()[0]


@pytest.mark.parametrize(
    "lang",
    ["lang", "cast(null as string)", "if(doc_id % 3 = 0, 'fr', lang)", "upper(lang) || '-XX'", "if(doc_id % 5 = 0, 'text/html', null)"],
    ids=["given", "none", "third wrong", "regions", "malformed"],
)
def test_text_decides_whatever_is_declared(docs, lang):
    assert agreement(langid.identify(docs.withColumn("lang", F.expr(lang)), keep=["doc_id", "true"])) > 0.98


def test_suffix_and_host_decide_where_the_text_can_not(spark, docs):
    hosts = docs.withColumn("source", F.concat(F.lit("https://www.h"), F.expr("doc_id % 30"), F.lit(".example."), "lang", F.lit("/p"))).select("doc_id", "text", "lang", "source", "true")
    blank = [(10_000 + i, "12 345", None, f"http://h{i % 30}.example.{x}/q", x) for i, x in enumerate(("de", "en", "es", "fr") * 3)]
    new = [(20_000, "67", None, "http://never-seen.example.org.de/", "de"), (20_001, "", None, "ftp://other.fr", "fr")]
    rows = hosts.unionByName(spark.createDataFrame(blank + new, hosts.schema))
    found = {r.doc_id: r for r in langid.identify(rows, keep=["doc_id", "true"]).where("doc_id >= 10000").collect()}
    assert all(r.lang_id == r.true and r.text_lang is None for r in found.values())


def test_foreign_and_junk_texts_are_rejected(spark, docs):
    rng = random.Random(1)
    noise = [" ".join("".join(rng.choice("xqzvkwjy") for _ in range(rng.randint(2, 9))) for _ in range(60)) for _ in range(20)]
    other = ["tämä on suomenkielinen teksti jossa kerrotaan kuinka kissa istui matolla ja katseli lintuja ikkunasta koko pitkän päivän ajan"] * 10
    rows = [(10_000 + i, t, None, "src1", 0) for i, t in enumerate(noise + other)]
    every = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    kept = {r.doc_id for r in langid.accepted(every).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()}


def test_two_texts_under_one_id_are_told_apart(spark, docs):
    rows = spark.createDataFrame([(1, "xqz vkw " * 40, None, "src1", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    every = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(rows)
    assert langid.accepted(every).where("doc_id = 1").count() == docs.where("doc_id = 1").count()


def test_many_languages_take_more_passes(docs, monkeypatch):
    monkeypatch.setattr(langid, "PASS_LANGUAGES", 3)
    many = docs.withColumn("lang", F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("q"), F.char(F.lit(97) + (F.col("doc_id") / 50).cast("int")))).otherwise(F.col("lang")))
    told = lambda: {r.doc_id: (r.lang_id, round(r.confidence, 6), r.accepted) for r in langid.identify(many).collect()}
    in_passes = told()
    assert agreement(langid.identify(many, keep=["doc_id", "true"])) > 0.9
    monkeypatch.setattr(langid, "PASS_LANGUAGES", 256)
    assert told() == in_passes  # both rounds, whatever the number of passes


def test_pages_have_suffixes_and_hosts(spark):
    found = queries.page_languages(spark, "/root/testdata/sf0.01").collect()
    pages = {r.page_id: r.url for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    told = [r for r in found if any(f"/{x}/" in pages[r.page_id] for x in ("en", "fr", "de", "es"))]
    assert len(found) == len(pages) and sum(f"/{r.lang_id}/" in pages[r.page_id] for r in told) > 0.9 * len(told)


def test_without_any_evidence_everything_is_und(spark):
    rows = spark.createDataFrame([(1, "abc def", None, None), (2, None, None, "h"), (None, "", "x", "")], "doc_id long, text string, lang string, source string")
    assert {r.lang_id for r in langid.identify(rows).collect()} == {"und"}
    assert langid.identify(rows.limit(0)).collect() == [] and langid.accepted(rows.limit(0)).collect() == []


def _made_up(rng, words, n):
    """Texts of Portuguese function words and ``words``."""
    frame = "os das uma não para com mais dos foi pela são também ao".split()
    return [" ".join(rng.choice(frame if rng.random() < 0.4 else words) for _ in range(80)) for _ in range(n)]


def test_a_neighbour_without_a_list_keeps_its_texts(spark, docs):
    """A language that shares function words with a listed one, beside it and without it; a wrong tag on listed texts gets none."""
    rng = random.Random(3)
    letters = "abdefgilmnoprstu"
    one, two = ([("".join(rng.choice(letters) for _ in range(rng.randint(4, 9)))) + end for _ in range(150)] for end in ("xeo", "ção"))
    schema = "doc_id long, text string, lang string, source string, true string"
    gl = [(10_000 + i, t, "gl", "src1", "gl") for i, t in enumerate(_made_up(rng, one, 150))]
    pt = [(20_000 + i, t, "pt", "src1", "pt") for i, t in enumerate(_made_up(rng, two, 150))]
    table = docs.select("doc_id", "text", F.when(F.col("doc_id") % 4 == 0, "xx").otherwise(F.col("lang")).alias("lang"), "source", "true")
    for rows in (gl, gl + pt):
        found = langid.identify(table.unionByName(spark.createDataFrame(rows, schema)), keep=["doc_id", "true"])
        assert found.where("lang_id <> `true` or not accepted").where("doc_id >= 10000").count() == 0
        assert agreement(found) > 0.98


def test_joined_evidence_is_the_same(docs, monkeypatch):
    told = lambda: {r.doc_id: (r.lang_id, round(r.confidence, 6)) for r in langid.identify(docs).collect()}
    broadcast = told()
    monkeypatch.setattr(langid, "MAX_BROADCAST_NUMBERS", 0)
    assert told() == broadcast
