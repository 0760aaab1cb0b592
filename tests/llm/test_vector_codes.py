import hashlib
import math

import numpy as np
import pytest

from eventloom.llm import product_codes as pc


def expected(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Plain code: every round sums all vectors anew, in Python integers."""
    kept = [(i, [math.floor(scale * float(x)) for x in v], y) for i, v, y in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    size = max({len(v) for _, v, _ in kept}, key=lambda n: (sum(len(v) == n for _, v, _ in kept), n))
    kept = [(i, v + [0] * (-len(v) % parts), y) for i, v, y in kept if len(v) == size]
    width = len(kept[0][1]) // parts
    firsts = {}
    for i, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        firsts.setdefault(i, v)
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [list(b) for b in zip(*(cut(v) for v in list(firsts.values())[:entries]), strict=True)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def nearest(x, book):
        return min(range(len(book)), key=lambda e: far(x, book[e]))

    for _ in range(rounds):
        sums = [{} for _ in range(parts)]
        for _, v, _ in kept:
            for p, x in enumerate(cut(v)):
                n, s = sums[p].get(e := nearest(x, books[p]), (0, [0] * width))
                sums[p][e] = (n + 1, [a + b for a, b in zip(s, x, strict=True)])
        for p in range(parts):
            for e, (n, s) in sums[p].items():
                books[p][e] = [a // n for a in s]
    out, by_label = [], {}
    for i, v, y in kept:
        code = [nearest(x, books[p]) for p, x in enumerate(cut(v))]
        error = min(sum(far(x, books[p][e]) for p, (x, e) in enumerate(zip(cut(v), code, strict=True))), pc.LARGEST)
        out.append((i, bytes(code).hex(), error, y))
        by_label[y] = by_label.get(y, 0) + error
    text = ",".join(str(x) for b in books for e in b for x in e)
    return sorted((i if i is not None else -1, c, e, min(by_label[y], pc.LARGEST)) for i, c, e, y in out), hashlib.sha256(text.encode()).hexdigest()


def _rows(seed, n, width=8, spread=0.2):
    rng = np.random.default_rng(seed)
    rows = [(int(i), (rng.normal(0, spread, width)).astype("f4").tolist(), int(rng.integers(0, 3))) for i in rng.permutation(n)]
    rows[3] = (rows[3][0], None, 1)
    rows[4] = (rows[4][0], [float("nan"), *rows[5][1][1:]], 1)
    rows[6] = (rows[6][0], [None, *rows[5][1][1:]], 1)
    rows[7] = (rows[7][0], [float("-inf"), *rows[5][1][1:]], None)
    rows[8] = (rows[8][0], rows[5][1], None)
    return rows


@pytest.mark.parametrize(
    "rows,options",
    [
        (_rows(1, 400), {"entries": 16}),
        (_rows(2, 120, 7), {}),
        (_rows(3, 90) + [(5, [0.5] * 8, 2)] * 60 + [(None, [0.25] * 8, None), (900, [0.1] * 4, 1), (901, [], 1)], {"entries": 9, "rounds": 2}),
        (_rows(4, 60) + [(700 + k, np.array([1e30, -1e30, 1e6, 3, 0, 0, 0, k / 7], "f4").tolist(), 1) for k in range(3)], {"entries": 5}),
    ],
)
def test_codes_equal_plain_lloyd(spark, rows, options):
    if max(abs(x) for _, v, _ in rows if v for x in v if x is not None and math.isfinite(x)) > 1e9:
        held = [(i, [None if x is None else max(min(x, pc.WIDEST / 1024), -pc.WIDEST / 1024) if math.isfinite(x) else x for x in v] if v else v, y) for i, v, y in rows]
    else:
        held = rows
    want, digest = expected(held, **options)
    table = spark.createDataFrame([(i, v, y, "clash") for i, v, y in rows], "vec_id long, embedding array<float>, label int, code string").repartition(5)
    coded = pc.compressed(table, **options)
    got = sorted((r.id if r.id is not None else -1, bytes(r.code).hex(), r.error, r.label_error) for r in pc.label_errors(coded.rows).collect())
    assert got == want and coded.digest() == digest


def test_only_changed_parts_are_shuffled(spark):
    rows = [(i, [float(i % 4)] * 8, 0) for i in range(200)]
    state = pc.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), "vec_id", "embedding", "label").withColumn("code", pc.F.lit(None).cast("binary"))
    books = pc.first_entries(state, entries=4)
    first = pc._round(state, books)
    again = pc._round(first.where("part is null"), books)
    assert first.where("part is not null").count() > 0 and again.where("part is not null").count() == 0


def test_empty_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert pc.label_errors(pc.compressed(none).rows).collect() == []
    bad = spark.createDataFrame([(1, None, 2), (2, [float("nan")], 1)], "vec_id long, embedding array<float>, label int")
    assert pc.compressed(bad).rows.collect() == []


def test_query_matches_sql(same):
    from eventloom.llm.queries import ORACLE, QUERIES

    same(QUERIES["op13_vector_codes"], ORACLE["op13_vector_codes"])
    same(QUERIES["op11_phrase_collocations"], ORACLE["op11_phrase_collocations"])


def test_an_empty_table_gives_no_rows(spark, sf, tmp_path):
    """The query reads ``embeddings`` alone, which ``test_empty_tables`` doesn't write."""
    from eventloom.llm import queries

    spark.read.parquet(f"{sf}/embeddings.parquet").limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.QUERIES["op13_vector_codes"](spark, str(tmp_path)).collect() == []
