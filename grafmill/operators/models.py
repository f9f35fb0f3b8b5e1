"""Models: a loss, a solver and starting values put together, found by name; and the neighbourhood model.

``fit`` returns the parameter frames; ``predict_pairs`` and ``predict_all`` score with them. Batch solvers step all records
at once; sequential ones pass through each user's records; ``als`` and ``newton`` are for the square loss.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafmill.functions import vec
from grafmill.operators import cf, neighbours
from grafmill.plans.iterate import settle


def _settled(params: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Each frame computed once; roles that share a frame keep sharing it."""
    done: dict[int, DataFrame] = {}
    for df in params.values():
        if id(df) not in done:
            done[id(df)] = settle(df)
    return {k: done[id(df)] for k, df in params.items()}


@dataclass
class Factorization:
    """One matrix or tensor. Losses' parameters (r0, r1, rf, ...) go to ``loss`` by name."""

    d: int = 5
    lr: float = 0.01
    lam: float = 0.005
    solver: str = "batch"
    name: str = "gaussian"
    options: dict = field(default_factory=dict)

    def loss(self) -> cf.Loss:
        return LOSSES[self.name](**self.options)

    def start(self, records: DataFrame) -> dict[str, DataFrame]:
        """Starting values for the roles of the loss."""
        roles = self.loss().roles
        out = {}
        for role, key in roles.items():
            if role == "bu":
                out[role] = cf.zero_bias(records, key)
            elif role == "bv":
                out[role] = cf.item_bias(records, key)
            elif role == "b":
                row = records.select(F.size("fu").alias("m"), F.size("fv").alias("n")).head()
                out[role] = records.sparkSession.range(1).select("id", vec.init("id", 4, row.m * row.n if row else 1).alias("x"))
            elif role == "s":
                out[role] = cf.starting(records, key, 3, self.d, divide=False)
            else:
                out[role] = cf.starting(records, key, 1 if role == "u" else 2, self.d)
        return out

    def _dims(self, records: DataFrame, roles: dict[str, str]) -> dict[str, int]:
        wide = records.select((F.size("fu") * F.size("fv")).alias("n")).head() if "b" in roles else None
        return {r: 1 if r in ("bu", "bv") else (wide.n if wide else 1) if r == "b" else self.d for r in roles}

    def fit(self, records: DataFrame, steps: int = 100, params: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
        records = settle(records)
        params = _settled(params or self.start(records))
        dims = self._dims(records, self.loss().roles)
        for t in range(steps):
            params = self._step(records, params, dims)
            if t + 1 < steps and self.solver != "batch":  # a batch step's result is computed already
                params = _settled(params)
        return params

    def _step(self, records: DataFrame, params: dict[str, DataFrame], dims: dict[str, int]) -> dict[str, DataFrame]:
        loss = self.loss()
        if self.solver == "als":
            u, v = cf.als_step(records, params["u"], self.d, self.lam)
            return {"u": u, "v": v}
        if self.solver == "newton":
            v = settle(cf.multiplicative_half(records, params["v"], params["u"], "i", "u", self.d, self.lam))
            return {"u": cf.multiplicative_half(records, params["u"], v, "u", "i", self.d, self.lam), "v": v}
        if self.solver == "sequential":
            own = [r for r in ("u", "bu") if r in loss.roles]
            order = {"bias": "bias", "hybrid": "together", "hybrid_bias": "together", "combine": "together"}.get(self.name, "gaussian")
            return cf.fold_step(records, params, loss, own, order, self.lr, self.lam, ["i"])
        return cf.batch_step(records, params, loss, dims, self.lr, self.lam)

    def predict_pairs(self, pairs: DataFrame, params: dict[str, DataFrame]) -> DataFrame:
        return cf.predict_pairs(pairs, params, self.loss())

    def predict_all(self, params: dict[str, DataFrame]) -> DataFrame:
        return cf.predict_all_bias(params) if "bu" in self.loss().roles else cf.predict_all(params["u"], params["v"])


@dataclass
class Ranking(Factorization):
    """Pairwise preferences (u, a, b), or those of ratings (u, i, r); of these the batch step makes no row for a preference."""

    name: str = "bpr"

    def start(self, records: DataFrame) -> dict[str, DataFrame]:
        items = records if "i" in records.columns else records.select(F.col("a").alias("i")).unionByName(records.select(F.col("b").alias("i")))
        v = cf.starting(items, "i", 2, self.d)
        return {"u": cf.starting(records, "u", 1, self.d), "va": v, "vb": v, "v": v}

    def fit(self, records: DataFrame, steps: int = 100, params: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
        if "a" in records.columns:
            return super().fit(records, steps, params)
        kinds = dict(records.dtypes)
        params = params or self.start(records)  # users and items without a preference too
        by_user = self.solver != "sequential" and kinds["u"] in neighbours.WHOLE and kinds["i"] in neighbours.WHOLE
        return super().fit(records.select("u", "i", "r") if by_user else cf.preferences(records), steps, params)

    def _step(self, records: DataFrame, params: dict[str, DataFrame], dims: dict[str, int]) -> dict[str, DataFrame]:
        if self.solver == "sequential":
            out = cf.fold_step(records, params, self.loss(), ["u"], "together", self.lr, self.lam, ["a", "b"])
            return out | {"v": out["va"]}
        if "i" in records.columns:
            return cf.ranked_step(records, params, dims, self.lr, self.lam, **self.options)
        return cf.batch_step(records, params, self.loss(), dims, self.lr, self.lam, {"va": "v", "vb": "v"})

    def predict_pairs(self, pairs: DataFrame, params: dict[str, DataFrame]) -> DataFrame:
        return cf.predict_pairs(pairs, params, cf.square())


@dataclass
class Temporal(Factorization):
    """Canonical tensor whose contexts are drawn to their forerunners."""

    name: str = "tensor_temporal"

    def _step(self, records: DataFrame, params: dict[str, DataFrame], dims: dict[str, int]) -> dict[str, DataFrame]:
        return cf.batch_step(cf.with_forerunner(records, params["s"], self.d), params, self.loss(), dims, self.lr, self.lam)


@dataclass
class Collective:
    """Three matrices over users, items and contexts: (u, i, r), (u, s, r) and (i, s, r)."""

    d: int = 5
    lr: float = 0.01
    lam: float = 0.005
    lam_s: float = 0.005
    lam_v: float = 0.005
    solver: str = "batch"

    def fit(self, mu: DataFrame, ms: DataFrame, mv: DataFrame, steps: int = 100) -> dict[str, DataFrame]:
        pair = lambda df, a, b: settle(df.select(F.col(a).alias("a"), F.col(b).alias("b"), "r"))
        mu, ms, mv = pair(mu, "u", "i"), pair(ms, "u", "s"), pair(mv, "i", "s")
        params = {"u": cf.starting(mu, "a", 1, self.d), "v": cf.starting(mu, "b", 2, self.d), "s": cf.starting(ms, "b", 3, self.d, divide=False)}
        params = _settled(params)
        for t in range(steps):
            if self.solver == "sequential":
                params = cf.collective_fold_step(mu, ms, mv, params, self.lr, self.lam, self.lam_s, self.lam_v)
            else:
                params = cf.collective_step([(mu, "u", "v", 1.0), (ms, "u", "s", self.lam_s), (mv, "v", "s", self.lam_v)], params, self.d, self.lr, self.lam)
            if t + 1 < steps and self.solver != "batch":
                params = _settled(params)
        return params

    def predict_pairs(self, pairs: DataFrame, params: dict[str, DataFrame]) -> DataFrame:
        return cf.predict_pairs(pairs, params, cf.square())


@dataclass
class Neighbourhood:
    """The k most similar users (or items), and predictions from their ratings."""

    k: int = 121
    criterion: str = "cosine"
    lam: float = 10.0
    user_base: bool = True

    def fit(self, ratings: DataFrame) -> DataFrame:
        return neighbours.nearest(ratings, self.criterion, self.lam, self.user_base, self.k)

    def predict_all(self, ratings: DataFrame, near: DataFrame) -> DataFrame:
        if self.user_base:
            return neighbours.predict_all(near, ratings)
        turned = ratings.select(F.col("i").alias("u"), F.col("u").alias("i"), "r")
        return neighbours.predict_all(near, turned).select(F.col("i").alias("u"), F.col("u").alias("i"), "score")

    def predict_pairs(self, ratings: DataFrame, near: DataFrame, pairs: DataFrame, default: float = 0.0) -> DataFrame:
        if self.user_base:
            return neighbours.predict_pairs(near, ratings, pairs, default)
        turn = lambda df, *more: df.select(F.col("i").alias("u"), F.col("u").alias("i"), *more)
        return turn(neighbours.predict_pairs(near, turn(ratings, "r"), turn(pairs), default), "score")


LOSSES = {
    "gaussian": cf.square,
    "log_gaussian": cf.log_square,
    "logistic": cf.logistic,
    "poisson": cf.poisson,
    "bias": cf.square_bias,
    "hybrid": cf.hybrid,
    "hybrid_bias": lambda **o: cf.hybrid(bias=True, **o),
    "regression": lambda **o: cf.hybrid(factors=False, **o),
    "combine": lambda **o: cf.hybrid(bias=True, **o),
    "bpr": cf.bpr,
    "tensor_cp": cf.tensor_cp,
    "tensor_pair": cf.tensor_pair,
    "tensor_temporal": lambda **o: cf.tensor_cp(temporal=True, **o),
}


def _maker(name: str):
    kind = Ranking if name == "bpr" else Temporal if name == "tensor_temporal" else Factorization

    def make(d: int = 5, lr: float = 0.01, lam: float = 0.005, solver: str = "batch", **options) -> Factorization:
        return kind(d, lr, lam, solver, name, options)

    return make


#: Models by name: MODELS[name](d=..., lr=..., lam=..., solver=..., options of the loss).
MODELS = {name: _maker(name) for name in LOSSES}
