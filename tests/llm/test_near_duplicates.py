import random

import brute
import numpy as np
import pytest
from odd import ODD

from grafmill.llm import minhash


def rows_of(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_whole_table_against_all_pairs(spark, documents, frame, k, percent):
    assert rows_of(minhash.near_duplicates(frame(documents), k, percent)) == brute.near(documents, k, percent)


def test_odd_rows(spark, frame):
    got = rows_of(minhash.near_duplicates(frame(ODD), 3, 85))
    want = brute.near(dict(ODD).items(), 3, 85)
    assert sorted(set(got)) == want and len(got) == len(ODD)


def test_rows_without_id(spark, frame):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (None, "something else entirely here"), (None, None)]
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash.near_duplicates(frame(rows), 3, 85).collect())
    assert got == [(0, 0, True), (0, 0, True), (0, 4, False), (4, 4, True)]


def test_one_id_with_several_texts(spark, frame):
    """It is linked with what any of its texts is linked with, the same in every run."""
    rng = random.Random(9)
    one, two, three = ([f"{p}{rng.randrange(500)}" for _ in range(120)] for p in "abc")
    near_one, near_two = [*one[:60], "x", *one[61:]], [*two[:40], "y", *two[41:]]
    rows = [(7, one), (7, two), (7, two), (3, near_one), (9, near_two), (5, three), (12, three[:110]), (12, one[:30]), (None, near_one), (None, three)]
    rows = [(d, " ".join(t)) for d, t in rows] + [(8, None), (8, " ".join(three))]
    for _ in range(2):
        got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash.near_duplicates(frame(rows), 3, 85).collect())
        assert got == [(0, 3, False), (0, 5, False), (3, 3, True), (5, 5, True), (7, 3, False), (7, 3, False), (7, 3, False), (8, 5, False), (8, 8, True), (9, 3, False), (12, 5, False), (12, 5, False)]


def test_a_bucket_of_many_is_dealt_over_tasks(spark, frame):
    """Rows of a bucket are copied for its seekers alone; every seeker meets every row once."""
    n, few = 300, 7
    rows = spark.createDataFrame([(5, i, 10) for i in range(n)], "bucket long, doc_id long, n_shingles long")
    mixed = minhash._mixed(rows, spark.createDataFrame([(i, few) for i in range(few + 1, n)], "a long, b long"))
    dealt = minhash._blocks(mixed, lambda k, _: k / 64).select("lo", "hi", "seeks", "doc_id").collect()
    tasks = {}
    for r in dealt:
        tasks.setdefault((r.lo, r.hi), ([], []))[r.seeks].append(r.doc_id)
    met = sorted((s, h) for homes, seekers in tasks.values() for s in seekers for h in homes)
    assert met == sorted((s, h) for s in range(few) for h in range(n))
    assert max(len(h) + len(s) for h, s in tasks.values()) < 130 and len(dealt) == n + few * 5


def test_empty_table(spark, frame):
    assert minhash.near_duplicates(frame([]), 3, 85).count() == 0


def test_groups_whose_common_text_has_not_the_smallest_id(spark, frame):
    """Copies meet only through a text in their midst; blocks are small, so that pairs of blocks are compared too."""
    rng = random.Random(5)
    rows, words = [], [f"w{i}" for i in range(400)]
    for g in range(3):
        base = [rng.choice(words) + str(g) for _ in range(150)]
        copies = []
        for _ in range(40):
            x = list(base)
            for _ in range(rng.choice([3, 4, 5, 9])):
                x[rng.randrange(150)] = rng.choice(words)
            copies.append(" ".join(x))
        rows += [(1000 * g + i, t) for i, t in enumerate([*copies[:20], " ".join(base), *copies[20:]])]
    old = minhash.BLOCK, minhash.WEIGHT
    minhash.BLOCK, minhash.WEIGHT = 16, 1500
    try:
        assert rows_of(minhash.near_duplicates(frame(rows), 3, 85)) == brute.near(rows, 3, 85)
    finally:
        minhash.BLOCK, minhash.WEIGHT = old


def test_chain_becomes_one_component(spark):
    n = 60
    order = list(range(n))
    random.Random(3).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(100, 101), (101, 102)], "a long, b long")
    got = {0: 0, 100: 100} | {r.doc_id: r.component for r in minhash.components(links).collect()}
    assert got == dict.fromkeys(range(n), 0) | dict.fromkeys((100, 101, 102), 100)


def test_signatures_estimate_similarity():
    a, b = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.arange(100, 1100, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    got = (minhash.signature(a) == minhash.signature(b)).mean()
    assert abs(got - 900 / 1100) < 0.15
