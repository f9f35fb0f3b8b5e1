"""The pipeline against its stages done by hand on Python lists."""

import brute
import pytest
from test_tokens import check_places

import corpus_pipeline
from grafmill.llm import pii, toxicity

SF = "/root/testdata/sf0.001"


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "pii", "packing"]


def test_run_against_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r.doc_id for r in toxicity.score_toxicity(docs, labels).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in toxic]
    gone = {d for d, _, _, kept, _ in brute.exact(rows) if not kept}
    rows = [x for x in rows if x[0] not in gone]
    gone = {d for d, _, _, kept in brute.near(rows, 5, 80) if not kept}
    rows = [x for x in rows if x[0] not in gone]
    kept = docs.join(spark.createDataFrame([(d,) for d, _ in rows], "doc_id long"), "doc_id", "left_semi")
    field = pii.fit(pii.texts(kept))
    rows = [(d, pii.redact(t, [*(b := pii.base_spans(t)), *pii.added_spans(field, t, b)]) if t else t) for d, t in rows]
    out = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == brute.cut(rows)
    check_places(out)


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_the_columns_of_documents(spark, frame, k):
    docs = frame([(1, None), (2, ""), (3, "mail a@b.cd or 1.2.3.4"), (3, "mail a@b.cd or 1.2.3.4"), (4, "x y z " * 40), (5, "x y z " * 40)])
    out = corpus_pipeline.STAGES[k][1](spark, docs, SF)
    assert out.columns == docs.columns
    assert {1, 3} <= {r.doc_id for r in out.collect()} or k in (1, 2)


WORDS = " ".join(f"word{i}" for i in range(200))


def test_rows_without_id(spark, frame):
    """Copies and near copies go whether they have a doc_id or not; of rows alike one stays."""
    rows = [(None, "a mail a@b.cd"), (None, "a mail a@b.cd"), (5, "a mail a@b.cd"), (5, "a mail a@b.cd"), (None, "once"), (None, None), (None, ""), (6, None), (5, "other text of the same id")]
    got = sorted((r.doc_id or 0, r.text or "", r.lang, r.salt) for r in corpus_pipeline.remove_copies(spark, frame(rows), SF).collect())
    assert got == sorted([(5, "a mail a@b.cd", "en", 2), (0, "once", "en", 2), (6, "", "en", 2), (5, "other text of the same id", "en", 2)])
    rows = [(None, WORDS + " end"), (4, WORDS), (None, "something else"), (None, WORDS + " more"), (9, WORDS + " and more")]
    got = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.remove_near_copies(spark, frame(rows), SF).collect())
    assert got == [(0, "something else"), (4, WORDS)]


def test_toxic_rows_without_id_go(spark, frame, tmp_path):
    words = "idiot moron stupid".split()
    rows = [(i, f"{WORDS[: 20 + i]} {words[i % 3] if i % 4 == 0 else 'garden'} here") for i in range(120)]
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    more = [(None, "you 1d10t"), (None, "fine words"), (3, "a moron too"), (None, None)]
    out = corpus_pipeline.remove_toxic(spark, frame([*rows, *more]), str(tmp_path)).collect()
    texts = [r.text for r in out]
    assert "fine words" in texts and None in texts and "you 1d10t" not in texts and "a moron too" not in texts
    assert {r.doc_id for r in out} == {None} | {i for i, _ in rows if i % 4}


def test_empty_table(spark, frame):
    docs = frame([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
        docs = frame([])
