"""Connected components against union-find, and what their rounds cost."""

import random

import pytest

from eventloom.llm import graph


def least(links):
    """id -> least id reached, of ids that aren't the least themselves."""
    parent = {x: x for link in links for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent if find(x) != x}


@pytest.fixture(scope="module")
def links():
    """A chain, a star, random links and loops under shuffled ids, some negative."""
    rng = random.Random(3)
    ids = list(range(-500, 1500))
    rng.shuffle(ids)
    out = [(i, i + 1) for i in range(150)] + [(200, 201 + i) for i in range(150)] + [(400 + rng.randrange(300), 400 + rng.randrange(300)) for _ in range(250)]
    return [(ids[u], ids[v]) for u, v in out] + [(1, 1), (2, 2)]


@pytest.mark.parametrize("most", [250_000, 300, 1])
def test_components_equal_union_find(spark, links, monkeypatch, most):
    """In one task, in a few, and dealt out over all shuffle partitions."""
    monkeypatch.setattr(graph, "EDGES_A_TASK", most)
    df = spark.createDataFrame(links, "u long, v long")
    assert {r.id: r.component for r in graph.components(df).collect()} == least(links)
    assert graph.components(df.limit(0)).collect() == []


def test_rounds_over_few_edges_take_few_tasks(spark, links):
    """However many shuffle partitions there are, only the first pass over the links uses them."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    sc = spark.sparkContext
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "101")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        df = spark.createDataFrame(links, "u long, v long")
        sc.setJobGroup("components", "")
        graph.components(df).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in kept.items():
            spark.conf.set(k, v)
    told = sc.statusTracker()
    stages = {s for job in told.getJobIdsForGroup("components") for s in told.getJobInfo(job).stageIds}
    ran = [told.getStageInfo(s) for s in stages]  # skipped stages may be forgotten
    assert 0 < sum(x.numCompletedTasks for x in ran if x) < 500
