"""Near copies by exact similarity against brute force."""

import random

import pytest

from eventloom.llm import near_copies, simhash


def shingles(text, size=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def alike(a, b):
    return a == b or (bool(a and b) and 9 * len(a & b) >= 4 * (len(a) + len(b)))


def least(rows):
    """id -> least id reached, by comparing every pair."""
    sets = [(i, shingles(t)) for i, t in rows]
    label = {i: i for i, _ in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if alike(a, b):
                u, v = find(i), find(j)
                label[max(u, v)] = min(u, v)
    return {i: find(i) for i, _ in sets}


@pytest.fixture(scope="module")
def docs_of_copies():
    """Texts with one, two, ... changed words each, groups that share a frame, short and empty ones."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(12):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 200))]
        out.append(text)
        for changes in range(1, 9):
            other = list(text)
            for _ in range(changes):
                other[rng.randrange(len(other))] = rng.choice(words)
            out.append(other)
    frame = [rng.choice(words) for _ in range(60)]
    out += [[*frame, *(rng.choice(words) for _ in range(rng.randrange(3, 20)))] for _ in range(60)]
    out += [["one"], ["one"], ["One", "two"], ["one", "two"], ["a", "b", "c", "d", "e"], ["a", "b", "c", "d", "e"], []]
    rng.shuffle(out)
    return [(i, " ".join(t)) for i, t in enumerate(out)] + [(9001, None), (9002, " \n ")]


def test_near_copies_equal_brute_force(spark, docs_of_copies):
    want = {i: c for i, c in least(docs_of_copies).items() if i != c}
    df = spark.createDataFrame(docs_of_copies, "doc_id long, text string")
    assert {r.id: r.component for r in near_copies.near_copies(df).collect()} == want
    kept = {r.doc_id for r in simhash.deduplicated(df).collect()}
    assert kept == {i for i, _ in docs_of_copies} - set(want)
    by_bits = {r.doc_id for r in simhash.near_duplicates(df).where("doc_id <> component_id").collect()}
    assert len(set(want) - by_bits) > 20  # the query's four bits miss these


def test_near_copies_of_the_table_equal_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = {i: c for i, c in least(rows).items() if i != c}
    assert {r.id: r.component for r in near_copies.near_copies(df).collect()} == want


def test_order_of_shingles_does_not_matter(spark, docs_of_copies, monkeypatch):
    monkeypatch.setattr(near_copies, "CROWD", 2)
    monkeypatch.setattr(near_copies, "FREQUENT", 50)
    want = {i: c for i, c in least(docs_of_copies).items() if i != c}
    df = spark.createDataFrame(docs_of_copies, "doc_id long, text string")
    assert {r.id: r.component for r in near_copies.near_copies(df).collect()} == want


def test_repeated_rows_become_one(spark):
    a, b = "one two three four five six seven " * 3, "eight nine ten eleven twelve thirteen fourteen " * 3
    rows = [(1, a, 0), (1, a, 0), (2, b, 0), (2, b, 0), (2, a, 0), (3, None, 0), (3, None, 0), (None, a, 0), (None, a, 0)]
    out = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, near_id int")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in out) == [(0, a), (0, a), (1, a), (2, b), (3, "")]


def test_sketches_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(1)
    for n, m in ((10, 12), (300, 290), (5_000, 64)):
        a, b = (np.unique(rng.integers(0, 2**63, k, dtype=np.uint64)) for k in (n, m))
        b = np.unique(np.concatenate([b, a[: n // 2]]))
        x, y = near_copies.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert near_copies.sketch_distance(x, y) <= len(np.setxor1d(a, b))
        assert near_copies.sketch_distance(x, x) == 0


def test_the_frequent_list_is_bounded(spark, monkeypatch):
    from fractions import Fraction

    df = spark.createDataFrame([(i, f"one two three four five six w{i}") for i in range(300)], "id long, text string")
    for most, expected in ((1_000, True), (0, False)):
        monkeypatch.setattr(near_copies, "FREQUENT", most)
        keys, counts = near_copies._frequent(df, 5, Fraction(4, 5), 12)
        assert len(keys) <= most and bool(len(keys)) == expected and all(counts >= 12)


def test_a_large_group_emits_few_pairs(spark, monkeypatch):
    """Near copies of one text with 0 to 12 words changed: hundreds of sets under each key."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(150)]
    rows = []
    for i in range(300):
        other = list(base)
        for _ in range(rng.randrange(0, 13)):
            other[rng.randrange(len(other))] = rng.choice(words)
        rows.append((i, " ".join(other)))
    emitted = []
    made = near_copies._pairs

    def counted(*a):
        pairs = made(*a)
        emitted.append(pairs.count())
        return pairs

    monkeypatch.setattr(near_copies, "_pairs", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: c for i, c in least(rows).items() if i != c}
    assert {r.id: r.component for r in near_copies.near_copies(df).collect()} == want
    assert sum(emitted) < 300 * 299 / 2 / 3


@pytest.mark.parametrize("few", [1, 3])
def test_keys_cut_into_blocks_lose_no_link(spark, docs_of_copies, monkeypatch, few):
    for name, value in (("BLOCK", 4), ("ACROSS", 5), ("PIVOTS", 1), ("FEW", few), ("HOT_ROWS", 3)):
        monkeypatch.setattr(near_copies, name, value)
    want = {i: c for i, c in least(docs_of_copies).items() if i != c}
    df = spark.createDataFrame(docs_of_copies, "doc_id long, text string")
    assert {r.id: r.component for r in near_copies.near_copies(df).collect()} == want


def test_no_group_holds_a_hot_key(spark, monkeypatch):
    """Two thirds of all texts are near copies of one: each key of theirs is cut, and most blocks meet nothing again."""
    monkeypatch.setattr(near_copies, "BLOCK", 32)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(240)]
    rows = []
    for i in range(900):
        other = list(base) if i % 3 else [rng.choice(words) for _ in range(60)]
        other[rng.randrange(len(other))] = rng.choice(words)
        rows.append((i, " ".join(other)))
    groups, across = [], []
    blocks, met = near_copies._blocks, near_copies._across

    def first(*a):
        out = blocks(*a)
        groups.append(out.groupBy("group").count().agg({"count": "max"}).first()[0])
        return out

    def second(*a):
        out = met(*a)
        across.append(out.where("side > 0").count())
        return out

    monkeypatch.setattr(near_copies, "_blocks", first)
    monkeypatch.setattr(near_copies, "_across", second)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.component for r in near_copies.near_copies(df).collect()}
    assert got == {i: c for i, c in least(rows).items() if i != c}
    assert groups[0] <= 2 * 32 + near_copies.PIVOTS
    assert across[0] == 0


def test_near_copies_are_first_linked_by_simhash(spark, monkeypatch):
    """Without the join by prefixes, the pairs within the fingerprints' distance are found, and those alone."""
    import numpy as np

    rng = random.Random(11)
    rows, want = [], {}

    def bits(text):
        buf = np.frombuffer(text.encode(), np.uint8)
        found, _ = near_copies.shingle_sets(buf, np.array([0, len(buf)]))
        return int(simhash.fingerprint(near_copies.vt.mix(found)))

    for i in range(0, 80, 2):
        text = [f"w{rng.randrange(5_000)}" for _ in range(300)]
        other = [*text[:150], "changed", *text[151:]]
        rows += [(i, " ".join(text)), (i + 1, " ".join(other))]
        if (bits(rows[-2][1]) ^ bits(rows[-1][1])).bit_count() <= simhash.DISTANCE:
            want[i + 1] = i
    assert 5 < len(want) < 40
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.id: r.component for r in near_copies.near_copies(df).collect()} == {i + 1: i for i in range(0, 80, 2)}
    monkeypatch.setattr(near_copies, "_pairs", lambda of, *a: of.sparkSession.createDataFrame([], "u long, v long"))
    assert {r.id: r.component for r in near_copies.near_copies(df).collect()} == want


def test_unlike_texts_under_a_key_are_settled_at_once(spark, monkeypatch):
    """Forty texts share a frame, so some keys hold them all, but few pairs stay in the race: none goes to the second round."""
    monkeypatch.setattr(near_copies, "CROWD", 1_000)
    rng = random.Random(12)
    frame = [f"f{i}" for i in range(30)]
    rows = [(i, " ".join([*frame, *(f"w{rng.randrange(5_000)}" for _ in range(300))])) for i in range(40)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(0, 40, 4)]
    again, keys = [], []
    met, blocks = near_copies._across, near_copies._blocks

    def second(parted, *a):
        again.append(parted.count())
        return met(parted, *a)

    def first(dealt, *a):
        keys.append(dealt.groupBy("key").count().where(f"count > {near_copies.FEW}").count())
        return blocks(dealt, *a)

    monkeypatch.setattr(near_copies, "_across", second)
    monkeypatch.setattr(near_copies, "_blocks", first)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.id: r.component for r in near_copies.near_copies(df).collect()} == {100 + i: i for i in range(0, 40, 4)}
    assert keys[0] > 0
    assert again == [0]
