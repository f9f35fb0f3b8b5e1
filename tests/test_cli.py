"""The command line over small files."""

from __future__ import annotations

import pytest

from grafmill import cli


@pytest.fixture
def files(tmp_path):
    (tmp_path / "r.csv").write_text("".join(f"{u},{i},{(u * 7 + i * 3) % 10 / 10}\n" for u in range(6) for i in range(5) if (u + i) % 3))
    (tmp_path / "e.tsv").write_text("0\t1\n1\t2\n2\t3\n3\t0\n0\t2\n")
    (tmp_path / "seeds").write_text("0\n2\n")
    (tmp_path / "im").write_text("1;2;1,0\n1;3;0,0\n")
    (tmp_path / "t.csv").write_text("".join(f"x,{p},{q},{o},0.5\n" for p in range(3) for q in range(2) for o in range(2)))
    return tmp_path


def run(spark, files, command, *more):
    out = str(files / "out")
    cli.main([command, *more, "--output", out], spark)
    return spark.read.parquet(out)


@pytest.mark.parametrize(("model", "more"), [("gaussian", ["--solver", "sequential"]), ("bias", []), ("gaussian", ["--solver", "als"]), ("knn", ["--k", "3"]), ("bpr", [])])
def test_train_and_predict(spark, files, model, more):
    cli.main(["train", "--model", model, "--ratings", f"{files}/r.csv", "--output", f"{files}/m", "--steps", "2", *more], spark)
    same = ["--model", model, "--params", f"{files}/m", "--ratings", f"{files}/r.csv", *more]
    assert run(spark, files, "predict-pairs", *same, "--pairs", f"{files}/r.csv").count() == 20
    assert run(spark, files, "predict-all", *same).count() == 30


def test_tensor(spark, files):
    cli.main(["train", "--model", "tensor_pair", "--ratings", f"{files}/t.csv", "--output", f"{files}/m", "--steps", "1"], spark)
    assert run(spark, files, "predict-pairs", "--model", "tensor_pair", "--params", f"{files}/m", "--pairs", f"{files}/t.csv").count() == 12


@pytest.mark.parametrize(("command", "more", "rows"), [("rank", ["--steps", "3"], 4), ("expand", ["--steps", "1"], 4), ("band", ["--steps", "1", "--lower", "1"], 4), ("hops", ["--steps", "9"], 4), ("degrees", [], 2), ("count", [], 1), ("overlap", [], 1), ("dictionary", [], 4), ("adjacency", ["--index", "1"], 4)])
def test_graph(spark, files, command, more, rows):
    assert run(spark, files, command, "--edges", f"{files}/e.tsv", "--seeds", f"{files}/seeds", *more).count() == rows


def test_convert_to_text(spark, files):
    cli.main(["convert", "--kind", "im", "--input", f"{files}/im", "--output", f"{files}/t", "--text"], spark)
    assert [r.value for r in spark.read.text(f"{files}/t").collect()] == ["1,2"]
