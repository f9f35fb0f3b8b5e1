"""Command line: train and predict with recommendation models, run graph operators, convert files.

    python -m grafmill.cli train --model gaussian --ratings r.csv --output model [--solver batch] [--d 5] [--steps 100]
    python -m grafmill.cli train --model knn --ratings r.csv --output model [--k 121] [--criterion cosine] [--items]
    python -m grafmill.cli predict-pairs|predict-all --model gaussian --params model --output scores [--pairs p.csv]
    python -m grafmill.cli rank|hits|expand|band|hops|diameter|adjacency|links|importance|degrees|count --edges e.tsv ...
    python -m grafmill.cli convert --kind im|microblog|userinfo --input lines --output table
    python -m grafmill.cli overlap|dictionary|relational|trim-keys ...

Ratings are `user,item[,rating]` lines, edges `src<TAB>dst` lines (or Parquet with --binary); results are Parquet, or
text with --text.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafmill.operators import cf, graph, matrix, models, neighbours
from grafmill.sources import text


def _features(spark: SparkSession, records: DataFrame, args: argparse.Namespace) -> DataFrame:
    """Records with fu and fv where feature files are named."""
    for key, name, path in (("u", "fu", args.user_features), ("i", "fv", args.item_features)):
        if path:
            records = records.join(text.read_matrix(spark, path).select(F.col("id").alias(key), F.col("x").alias(name)), key)
    return records


def _records(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.model.startswith("tensor"):
        return text.read_tensor(spark, args.ratings)
    return _features(spark, text.read_ratings(spark, args.ratings), args)


def _model(args: argparse.Namespace):
    return models.MODELS[args.model](d=args.d, lr=args.lr, lam=args.lam, solver=args.solver)


def _params(spark: SparkSession, path: str, roles) -> dict[str, DataFrame]:
    return {r: spark.read.parquet(f"{path}/{r}") for r in roles}


def train(spark: SparkSession, args: argparse.Namespace) -> None:
    began = time.perf_counter()
    if args.model == "knn":
        near = models.Neighbourhood(args.k, args.criterion, args.lam, not args.items).fit(text.read_ratings(spark, args.ratings))
        near.write.mode("overwrite").parquet(f"{args.output}/neighbours")
    elif args.model == "cmf":
        side = lambda path, *names: text.read_ratings(spark, path).toDF(*names, "r")
        model = models.Collective(args.d, args.lr, args.lam, args.lam_s, args.lam_v, args.solver)
        params = model.fit(side(args.ratings, "u", "i"), side(args.user_contexts, "u", "s"), side(args.item_contexts, "i", "s"), args.steps)
        for role, df in params.items():
            df.write.mode("overwrite").parquet(f"{args.output}/{role}")
    else:
        for role, df in _model(args).fit(_records(spark, args), args.steps).items():
            df.write.mode("overwrite").parquet(f"{args.output}/{role}")
    print(f"trained in {1000 * (time.perf_counter() - began):.0f} ms")


def predict(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.model == "knn":
        model = models.Neighbourhood(args.k, args.criterion, args.lam, not args.items)
        near, ratings = spark.read.parquet(f"{args.params}/neighbours"), text.read_ratings(spark, args.ratings)
        if args.command == "predict-all":
            return model.predict_all(ratings, near)
        return model.predict_pairs(ratings, near, text.read_ratings(spark, args.pairs).select("u", "i"), args.default)
    if args.model in ("cmf", "bpr"):
        params, loss = _params(spark, args.params, "uv"), cf.square()
    else:
        loss = _model(args).loss()
        params = _params(spark, args.params, loss.roles)
    if args.command == "predict-all":
        return cf.predict_all_bias(params) if "bu" in params else cf.predict_all(params["u"], params["v"])
    pairs = text.read_tensor(spark, args.pairs).select("p", "q", "o") if args.model.startswith("tensor") else _features(spark, text.read_ratings(spark, args.pairs).drop("r"), args)
    return cf.predict_pairs(pairs, params, loss).drop("fu", "fv")


def run_graph(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    e = text.read_binary(spark, args.edges) if args.binary else text.read_edges(spark, args.edges)
    ids = lambda path: spark.read.schema("id long").csv(path).where("id is not null")
    side = "src" if args.index == 0 else "dst"
    todo = {
        "rank": lambda: graph.pagerank(e, args.steps, args.alpha, args.channels, start=text.read_matrix(spark, args.vectors).withColumnRenamed("x", "v") if args.vectors else None),
        "hits": lambda: graph.hits(e, args.steps, args.alpha, args.normalize),
        "expand": lambda: graph.expand_reverse(e, ids(args.seeds), args.steps),
        "band": lambda: graph.expand_band(e, ids(args.seeds), args.steps, args.lower, args.upper),
        "hops": lambda: graph.hops(e, args.source, args.steps),
        "distance": lambda: graph.shortest_paths(e, args.source, args.steps),
        "diameter": lambda: graph.effective_diameter(e, args.steps, args.eps),
        "adjacency": lambda: graph.adjacency(e, side),
        "links": lambda: graph.link_counts(e, side),
        "importance": lambda: graph.uniform_importance(graph.nodes(e), args.channels),
        "degrees": lambda: graph.degree_distribution(e, side),
        "count": lambda: e.agg(F.count("*").alias("n")),
        "overlap": lambda: graph.induced(e, ids(args.seeds)),
        "dictionary": lambda: graph.nodes(e),
        "ids": lambda: matrix.dense_ids(graph.nodes(e), "id"),
        "relational": lambda: neighbours.relational(e, text.read_ratings(spark, args.ratings), args.items_total, args.steps, args.alpha),
    }
    return todo[args.command]()


GRAPH = ("rank", "hits", "expand", "band", "hops", "distance", "diameter", "adjacency", "links", "importance", "degrees", "count", "overlap", "dictionary", "ids", "relational")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="grafmill", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = p.add_subparsers(dest="command", required=True)
    for name in ("train", "predict-pairs", "predict-all"):
        c = commands.add_parser(name)
        c.add_argument("--model", required=True, choices=[*models.MODELS, "cmf", "knn"])
        c.add_argument("--solver", default="batch", choices=("batch", "sequential", "als", "newton"))
        for option, default in (("d", 5), ("steps", 100), ("k", 121)):
            c.add_argument(f"--{option}", type=int, default=default)
        for option, default in (("lr", 0.01), ("lam", 0.005), ("lam-s", 0.005), ("lam-v", 0.005), ("default", 0.0)):
            c.add_argument(f"--{option}", type=float, default=default)
        for option in ("ratings", "user-contexts", "item-contexts", "user-features", "item-features", "params", "pairs"):
            c.add_argument(f"--{option}")
        c.add_argument("--criterion", default="cosine", choices=list(neighbours.CRITERIA))
        c.add_argument("--items", action="store_true", help="neighbours of items instead of users")
    for name in GRAPH:
        c = commands.add_parser(name)
        c.add_argument("--edges", required=True)
        c.add_argument("--binary", action="store_true", help="edges are Parquet")
        for option, default in (("steps", 100), ("channels", 1), ("source", 0), ("index", 0), ("lower", 1), ("upper", 1 << 62), ("items-total", 1)):
            c.add_argument(f"--{option}", type=int, default=default)
        for option, default in (("alpha", 0.9), ("eps", 0.001)):
            c.add_argument(f"--{option}", type=float, default=default)
        for option in ("seeds", "vectors", "ratings"):
            c.add_argument(f"--{option}")
        c.add_argument("--normalize", action="store_true")
    c = commands.add_parser("convert")
    c.add_argument("--kind", required=True, choices=("im", "microblog", "userinfo"))
    c.add_argument("--input", required=True)
    c = commands.add_parser("trim-keys")
    c.add_argument("--input", required=True)
    for c in commands.choices.values():
        c.add_argument("--output", required=True)
        c.add_argument("--text", action="store_true", help="write text instead of Parquet")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("grafmill").getOrCreate()
    if args.command == "train":
        return train(spark, args)
    if args.command.startswith("predict"):
        out = predict(spark, args)
    elif args.command == "convert":
        out = getattr(text, f"parse_{args.kind}")(text.read_lines(spark, args.input))
    elif args.command == "trim-keys":
        out = text.trim_keys(text.read_lines(spark, args.input)).select("value")
    else:
        out = run_graph(spark, args)
    if args.text:
        flat = [F.concat_ws(",", F.col(c).cast("array<string>")).alias(c) if t.startswith("array<double") else F.col(c) for c, t in out.dtypes]
        text.write_text(out.select(*flat), args.output, ",")
    else:
        text.write_binary(out, args.output)
    return None


if __name__ == "__main__":
    main()
