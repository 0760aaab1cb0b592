"""Line dedup: blocks of lines, copies, odd rows, and thresholds against plain counting."""

import random
from collections import defaultdict

import pytest

from eventloom.llm import line_dedup

SCHEMA = "doc_id long, text string, source string"
FOOTER = ["Read our privacy policy here", "All rights reserved worldwide", "Made by the people of the site"]


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_a_footer_of_three_lines_goes_from_all_sites(spark):
    rows = [(i, "\n".join([f"own words number {i} are here", *FOOTER]), f"site{i}") for i in range(40)]
    assert texts(line_dedup.cleaned(spark.createDataFrame(rows, SCHEMA))) == {i: f"own words number {i} are here" for i in range(40)}


def test_copies_neither_lose_their_lines_nor_hide_a_footer(spark):
    body = "\n".join(f"a line of the copied text {i}" for i in range(4))
    rows = [(i, "\n".join([f"own words number {i} are here", *FOOTER]), f"site{i}") for i in range(8)]
    rows += [(1000 + i, "\n".join([body, *FOOTER]), f"site{i % 50}") for i in range(300)]
    out = texts(line_dedup.cleaned(spark.createDataFrame(rows, SCHEMA)))
    assert all(out[i] == f"own words number {i} are here" for i in range(8))
    assert all(out[1000 + i] == body for i in range(300))


def plain(rows):
    sites, own = defaultdict(set), defaultdict(set)
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            sites[x.strip(" \t\n\x0b\x0c\r")] |= {s} - {None}
            own[x.strip(" \t\n\x0b\x0c\r")].add(t or "")
    gone = {x for x in sites if len(x) >= line_dedup.MIN_CHARS and len(sites[x]) >= line_dedup.MIN_SITES and len(own[x]) >= line_dedup.MIN_TEXTS}
    return {(i, "\n".join(x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r") not in gone) or None) for i, t, s in rows}


@pytest.mark.parametrize("margin", [0.1, 10.0])
def test_lines_near_and_far_from_the_thresholds(spark, monkeypatch, margin):
    monkeypatch.setattr(line_dedup, "MARGIN", margin)
    rng = random.Random(4)
    lines = [f"line number {k} in many places" for k in range(30)]
    rows = [(i, "\n".join([f"own {i}", *(x for k, x in enumerate(lines) if rng.random() < (k + 1) / 120)]), rng.choice([None, *(f"s{j}" for j in range(9))])) for i in range(200)]
    rows += [(500, None, "s1"), (501, "", None), (3, rows[3][1], rows[3][2]), (None, "\n".join(lines[20:]), "s2")]
    found = {(r.doc_id, r.text or None) for r in line_dedup.cleaned(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == plain(rows)
