"""The other operators: held-out accuracy, brute force, edge cases, and the pipeline."""

import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventloom.llm import decontam, html_render, langid, line_dedup, queries, simhash, toxicity


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def clashing(docs, spark):
    """Nulls in all columns, a repeated row, and columns with the operators' own names."""
    odd = spark.createDataFrame([(None, None, None, None, None), (5, None, None, "", 0), (-1, "", "xx", None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    every = docs.unionByName(odd).unionByName(docs.where("doc_id = 3"))
    return every.withColumns({c: F.lit(1) for c in ("id", "key", "fp", "rep", "doc", "line", "host", "gone_id", "evidence", "component_id", "at", "k0")})


def test_line_dedup_matches_sql(same):
    same(queries.op9_line_dedup, queries.ORACLE["op9_line_dedup"])


def test_line_dedup_spares_copied_documents(spark):
    footer, body = "All rights reserved by everyone", "\n".join(f"a line that is long enough {i}" for i in range(4))
    rows = [(i, f"own words number {i} are here\n{footer}\nmore own words {i}", f"site{i}") for i in range(8)] + [(100 + i, body, f"site{i}") for i in range(8)]
    out = {r.doc_id: r.text for r in line_dedup.cleaned(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(footer not in out[i] and f"more own words {i}" in out[i] for i in range(8))
    assert all(out[100 + i] == body for i in range(8))


def test_decontamination_equals_brute_force(spark, sf, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    index = decontam.Index([(i, *decontam.parts(t)) for i, t in items])
    words = lambda s: re.findall(r"[^\W_]+", s.lower(), re.ASCII)
    gram = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    whole = set()
    for d in docs.collect():
        own = gram(words(d.text or ""))
        whole |= {(d.doc_id, i) for i, t in items if gram(words(t)) <= own}
    assert whole <= found and len(found) <= len(whole) + 20
    flat = [len(index.lists[t]) for t in range(len(index.terms))]
    for query in (np.arange(0, len(flat), 7), np.arange(len(flat))):
        plain = defaultdict(float)
        for t in query.tolist():
            for item, score in zip(index.lists[t], index.score[index.offsets[t] : index.offsets[t + 1]], strict=True):
                plain[item] += score
        assert sorted(i for i, _ in index.retrieve(query.tolist())) == sorted(i for i, s in plain.items() if s >= index.min_score - 1e-9)


def test_language_id_agrees_with_declared(docs):
    r = langid.identify(docs, keep=["doc_id", "lang"]).agg(F.avg((F.col("lang") == F.col("lang_id")).cast("int")), F.avg(F.col("accepted").cast("int"))).first()
    assert r[0] > 0.9 and r[1] > 0.9


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    scored = queries.op8_toxicity(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("score", "toxic").collect()
    bad, good = [r.score for r in scored if r.toxic == 1], [r.score for r in scored if r.toxic == 0]
    auc = np.mean([(x > np.array(good)).mean() + (x == np.array(good)).mean() / 2 for x in bad])
    assert auc > 0.95


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>One<p>Two", "One\n\nTwo"), ("<ul><li>a<li>b</ul>", "- a\n- b"), ("<ol><li>a<li>b</ol>", "1. a\n2. b"), ("<div hidden>x</div>y", "y"),
        ("<p style='display:none'>x</p><b>y</b> z", "y z"), ("a<script>if (1<2) x</script>b", "ab"), ("<pre>a\n  b</pre>", "a\n  b"), ("&lt;b&gt; &amp; &eacute;", "<b> & é"), ("", ""), ("<", "<"),
    ],
)
def test_html_pages(page, text):
    assert html_render.render(page) == text


def test_html_tables_align():
    lines = html_render.render("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>").split("\n")
    assert len(lines) == 2 and lines[0].index("bb") == lines[1].index("d")


def test_html_nulls(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "<p>a", None)], "page_id long, html string, text string")
    assert len(html_render.extracted(df, keep=["page_id"]).collect()) == 2


RUNS = {
    "language": lambda d, b: langid.accepted(d),
    "lines": lambda d, b: line_dedup.cleaned(d),
    "copies": lambda d, b: simhash.deduplicated(d),
    "leaks": lambda d, b: decontam.clean(d, b),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_stages_stand_odd_rows(name, clashing, spark, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    out = RUNS[name](clashing, items)
    assert out.columns == clashing.columns
    assert 0 < out.count() <= clashing.count()
    assert RUNS[name](clashing.limit(0), items).count() == 0
    assert RUNS[name](clashing, items.limit(0)).count() > 0


def test_toxicity_stands_odd_rows(clashing, spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").unionByName(spark.createDataFrame([(None, None, None), (5, 1, None)], "doc_id long, quality int, toxic int"))
    out = toxicity.score(clashing, toxicity.fit(clashing, labels)).collect()
    assert len(out) == clashing.count() and all(0 <= r.score <= 1 for r in out)
    none = toxicity.fit(clashing.limit(0), labels)
    assert toxicity.score(clashing.limit(0), none).collect() == []


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES))
def test_empty_tables(name, spark, sf, tmp_path):
    for t in ("documents", "labels", "benchmark", "pages", "conversations"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).collect() == []


def test_pipeline_stage_by_stage(spark, sf, docs):
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == docs.columns, name
        after = after.cache()
        assert 0 < after.count() <= before.count()
        assert after.join(before, "doc_id", "left_anti").isEmpty()
        before = after
    kept = {r.doc_id for r in before.select("doc_id").collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()} == kept
    assert simhash.deduplicated(before).count() == len(kept)
