"""Operators with SQL, and exact copies, whole tables and awkward rows."""

import brute
import pytest
from compare import assert_same
from odd import LONG, ODD

from grafmill.llm import exact_dedup, quality, registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert_same(registry.queries()[name](spark, SF), SF, registry.oracle_sql()[name], exact=True)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


def test_exact(spark, frame, documents):
    rows = [*documents, *((10_000 + d, t) for d, t in documents[::3]), (20_000, LONG), (20_001, LONG), (20_002, LONG[:-1] + "x")]
    assert rows_of(exact_dedup.exact_dedup(frame(rows))) == brute.exact(rows)


def test_exact_odd_rows(spark, frame):
    assert rows_of(exact_dedup.exact_dedup(frame(ODD))) == brute.exact(ODD)


def test_rows_without_id(spark, frame):
    out = exact_dedup.exact_dedup(frame([(None, "x"), (3, "x"), (None, "y"), (None, "z"), (None, "z")])).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in out) == [(0, 0, 1, True), (0, 0, 2, False), (0, 0, 2, True), (0, 3, 2, False), (3, 3, 2, True)]


def test_one_id_with_two_texts(spark, frame):
    rows = [(1, "a"), (1, "b"), (2, "a"), (3, "b"), (3, "b"), (4, "c"), (4, "c")]
    assert rows_of(exact_dedup.exact_dedup(frame(rows))) == brute.exact(rows)


def test_huge_texts_are_hashed_in_parts(spark, frame, monkeypatch):
    """The same fingerprints, groups and digests, whatever the size of the parts."""
    texts = [LONG[:5000], LONG[:5001], "é漢" * 700, "x" * 1000, "x" * 1001, "short", None]
    rows = [(i, t) for i, t in enumerate([*texts, *texts[::2], LONG[:5000] + "é"])] + [(0, texts[0]), (1, texts[2])]
    monkeypatch.setattr(exact_dedup, "HUGE", 1000)
    monkeypatch.setattr(exact_dedup, "COMPARE", 300)
    assert rows_of(exact_dedup.exact_dedup(frame(rows))) == brute.exact(rows)
    docs = exact_dedup.texts(frame(rows)).withColumn("h", exact_dedup.F.xxhash64("text"))
    for r in exact_dedup._of_huge(docs.where("length(text) > 1000")).join(docs, ["doc_id", "h"]).collect():
        assert r.fp == exact_dedup.fingerprint(r.text.encode()) and r.n_bytes == len(r.text.encode())


def test_equal_fingerprints_of_different_texts(spark, frame, monkeypatch):
    """A function that only the length tells apart; copies of a text stay one group beside others of its fingerprint."""

    def colliding(batches):
        import hashlib

        import pyarrow as pa

        for b in batches:
            raw = [x.encode() for x in b.column(1).to_pylist()]
            columns = [b.column(0), b.column(2), pa.array([7] * len(raw), pa.int64()), pa.array([len(x) for x in raw], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "fp", "n_bytes", "text_sha256"])

    def again(batches):
        import pyarrow as pa

        for b in batches:
            n = [len(x.encode()) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([7] * len(n), pa.int64()), pa.array(n, pa.int64()), b.column(0)], names=["fp", "n_bytes", "text"])

    monkeypatch.setattr(exact_dedup, "_fingerprints", colliding)
    monkeypatch.setattr(exact_dedup, "_with_fingerprint", again)
    monkeypatch.setattr(exact_dedup, "COMPARE", 2)
    rows = [(1, "one"), (2, "two"), (3, "one"), (4, "two"), (5, "six"), (6, "longer"), (1, "two"), (7, "")]
    assert rows_of(exact_dedup.exact_dedup(frame(rows))) == brute.exact(rows)


def test_fingerprints_combine_anywhere():
    data = LONG.encode()[:100_000]
    for cut in (1, 5000, 16_384, 99_999):
        for which in (0, 1):
            whole = exact_dedup.fingerprint(data) >> (31 if which == 0 else 0) & (1 << 31) - 1
            parts = [exact_dedup.fingerprint(x) >> (31 if which == 0 else 0) & (1 << 31) - 1 for x in (data[:cut], data[cut:])]
            assert exact_dedup.combine(*parts, len(data) - cut, which) == whole


def test_quality(spark, frame, documents):
    rows = [*documents, *((9000 + d, t) for d, t in ODD)]
    texts = dict(rows)
    for r in quality.judge(frame(rows)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(texts[r.doc_id]), r.doc_id
        assert not (r.kept and r.base_failed)


def test_lines(spark, frame):
    good = " ".join(["A plain sentence of some length stands here."] * 2)
    lines = [good, "Home | About us | Contact", "All rights reserved.", "no end mark", "## $$ %% ** && ||.", good + " Another one."]
    text = "\n".join(lines)
    kept = frame([(1, text)]).select(quality.F.filter(quality.lines_of(quality.F.col("text")), quality.line_kept).alias("x")).head().x
    assert kept == [lines[0], lines[5]]


@pytest.mark.parametrize("operator", [quality.judge, quality.clean, exact_dedup.exact_dedup])
def test_empty_table(spark, frame, operator):
    assert operator(frame([])).count() == 0
