"""Queries of the recommendation operators over the fixture views, each beside its SQL.

The SQL side spells every vector out in columns (x0, x1, ...), steps in chained tables and the sequential passes
as recursive tables, so it shares nothing with the DataFrame side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafmill.functions import vec
from grafmill.operators import cf, models, neighbours
from grafmill.plans.fixtures import oracle, view

QUERIES, SQL = {}, {}
D, LR, LAM, STEPS = 2, 0.05, 0.005, 2
lr, lam = f"{LR}e0", f"{LAM}e0"


def query(body: str | None, ctes: str = "", recursive: bool = False):
    """Register a query under its function's name with the SQL that gives the same rows (None: not to be had in SQL)."""

    def add(f):
        QUERIES[f.__name__] = f
        if body:
            SQL[f.__name__] = oracle(body, ctes, recursive)
        return f

    return add


# ------------------------------------------------------------------------------------------------ helpers, DataFrame side
def flat(params: dict[str, DataFrame], *roles: str, places: int = 8) -> DataFrame:
    """(role, id, k, x)."""
    out = None
    for role in roles:
        one = params[role].select(F.lit(role).alias("role"), "id", F.posexplode("x").alias("k", "x"))
        out = one if out is None else out.unionByName(one)
    return out.select("role", "id", F.col("k").cast("long").alias("k"), vec.rounded(F.col("x"), places).alias("x"))


def features(ids: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): two features of each id, made of the id."""
    one = lambda k: ((F.col(key) * 31 + k * 17) % 10).cast("double") / F.lit(10.0)
    return ids.select(key).distinct().select(key, F.array(one(0), one(1)).alias(name))


def with_features(ratings: DataFrame) -> DataFrame:
    return ratings.join(features(ratings, "u", "fu"), "u").join(features(ratings, "i", "fv"), "i")


def factors(ratings: DataFrame) -> dict[str, DataFrame]:
    return {"u": cf.starting(ratings, "u", 1, D), "v": cf.starting(ratings, "i", 2, D)}


def b_start(spark) -> DataFrame:
    return spark.range(1).select("id", vec.init("id", 4, 4).alias("x"))


# ------------------------------------------------------------------------------------------------ helpers, SQL side
def start(name: str, source: str, key: str, seed: int, d: int = D, divide: bool = True) -> str:
    x = ", ".join(f"cast((id * 7919 + {k} * 104729 + {seed} * 1299709) % 1000 as double) / cast(1000 as double){f' / {d}' * divide} x{k}" for k in range(d))
    return f"{name} as (select id, {x} from (select distinct {key} id from {source}))"


def dot(a: str, b: str, d: int = D) -> str:
    return "(" + " + ".join(f"{a}{k} * {b}{k}" for k in range(d)) + ")"


def grow(e: str, v: str, u: str, d: int = D) -> list[str]:
    return [f"{e} * {v}{k} + {lam} * {u}{k}" for k in range(d)]


def joined(records: str, roles: dict[str, tuple[str, str, int]], t: int) -> str:
    """Records with the columns of each role: role -> (key, table, width)."""
    cols = ", ".join(f"{r}_.x{k} {r}{k}" for r, (_, _, d) in roles.items() for k in range(d))
    return f"select q.*, {cols} from {records} q " + " ".join(f"join {table}{t} {r}_ on {r}_.id = {key}" for r, (key, table, _) in roles.items())


def moved(table: str, t: int, gradients: str, d: int) -> str:
    return f"{table}{t + 1} as (select o.id, " + ", ".join(f"o.x{k} - {lr} * coalesce(g.g{k}, 0) x{k}" for k in range(d)) + f" from {table}{t} o left join ({gradients}) g on g.id = o.id)"


def mean(source: str, d: int, key: str = "id") -> str:
    return f"select {key} id, " + ", ".join(f"avg(g{k}) g{k}" for k in range(d)) + f" from ({source}) group by {key}"


def batch(records: str, roles: dict[str, tuple[str, str, int]], grads: dict[str, list[str]], steps: int = STEPS, per: str = "i", over: str = "sum", where: str = "true") -> str:
    out = []
    for t in range(steps):
        out.append(f"j{t} as (select * from ({joined(records, roles, t)}) where {where})")
        for table in dict.fromkeys(x[1] for x in roles.values()):
            own = [r for r, x in roles.items() if x[1] == table]
            d = roles[own[0]][2]
            if table == "b":
                inner = f"select {per}, " + ", ".join(f"avg({g}) g{k}" for k, g in enumerate(grads["b"])) + f" from j{t} group by {per}"
                out.append(moved(table, t, "select 0 id, " + ", ".join(f"{over}(g{k}) g{k}" for k in range(d)) + f" from ({inner})", d))
            else:
                each = " union all ".join(f"select {roles[r][0]} id, " + ", ".join(f"{g} g{k}" for k, g in enumerate(grads[r])) + f" from j{t}" for r in own)
                out.append(moved(table, t, mean(each, d), d))
    return ", ".join(out)


def told(t: int, tables: dict[str, tuple[str, int]], places: int = 8) -> str:
    """role -> (table, width)."""
    return " union all ".join(f"select '{role}' as role, id, cast(k as bigint) as k, round(x, {places}) + 0 as x from (select id, unnest(range({d})) k, unnest([{', '.join(f'x{k}' for k in range(d))}]) x from {table}{t})" for role, (table, d) in tables.items())


UV = {"u": ("u", "u", D), "v": ("i", "v", D)}
UV_START = f"{start('u0', 'ratings_s', 'u', 1)}, {start('v0', 'ratings_s', 'i', 2)}"
UV_TOLD = {"u": ("u", D), "v": ("v", D)}
B_START = start("b0", "(select 0 zero)", "zero", 4, 4)
WITH_F = "rf as (select 0 zero, *, " + ", ".join(f"cast(({key} * 31 + {k} * 17) % 10 as double) / 10 {name}{k}" for key, name in (("u", "fu"), ("i", "fv")) for k in (0, 1)) + " from ratings_s)"
Z = ["fu0 * fv0", "fu0 * fv1", "fu1 * fv0", "fu1 * fv1"]
BILINEAR = "(" + " + ".join(f"{z} * b{k}" for k, z in enumerate(Z)) + ")"


# ------------------------------------------------------------------------------------------------ neighbourhoods
def sims_sql(own: str, via: str, criterion: str, shrink: float = 10.0) -> str:
    n = f"cast(n as double) / (n + {shrink}e0)"
    if criterion == "cosine":
        value = f"case when sqrt(aa * bb) > 0 then {n} * ab / sqrt(aa * bb) else 0 end"
    else:
        value = f"case when lx < mx and ly < my then {n} * cov / sqrt(case when va * vb > 0 then va * vb else 1 end) else 0 end"
    moments = ", covar_pop(x.r, y.r) cov, var_pop(x.r) va, var_pop(y.r) vb, min(x.r) lx, max(x.r) mx, min(y.r) ly, max(y.r) my" if criterion == "pearson" else ""
    return (
        f"pairs as (select x.{own} a, y.{own} b, count(*) n, sum(x.r) sa, sum(y.r) sb, sum(x.r * y.r) ab, sum(x.r * x.r) aa, sum(y.r * y.r) bb{moments} from ratings_ui x join ratings_ui y using ({via}) where x.{own} <> y.{own} group by 1, 2), "
        f"sims as (select a, b, round({value}, 9) + 0 sim from pairs), top as (select *, row_number() over (partition by a order by sim desc, b) rk from sims qualify rk <= 5)"
    )


def nearest(spark, sf_dir, criterion: str, user_base: bool) -> DataFrame:
    return neighbours.nearest(view(spark, sf_dir, "ratings_ui"), criterion, 10.0, user_base, 5)


TOP = "select a, b, sim, rk from top"


@query(TOP, sims_sql("u", "i", "cosine"))
def knn_cosine(spark, sf_dir):
    return nearest(spark, sf_dir, "cosine", True)


@query(TOP, sims_sql("u", "i", "pearson"))
def knn_pearson(spark, sf_dir):
    return nearest(spark, sf_dir, "pearson", True)


@query(TOP, sims_sql("i", "u", "cosine"))
def knn_cosine_items(spark, sf_dir):
    return nearest(spark, sf_dir, "cosine", False)


@query(TOP, sims_sql("i", "u", "pearson"))
def knn_pearson_items(spark, sf_dir):
    return nearest(spark, sf_dir, "pearson", False)


@query("select i as id, string_agg(concat(u, ':', cast(round(r * 1e6) as bigint)), ',' order by u) as entries from ratings_ui group by i")
def inverted_index(spark, sf_dir):
    index = neighbours.inverted_index(view(spark, sf_dir, "ratings_ui"))
    return index.select("id", F.array_join(F.transform("entries", lambda x: F.concat_ws(":", x["id"].cast("string"), F.round(x["r"] * 1e6).cast("long").cast("string"))), ",").alias("entries"))


SCORES = "scores as (select a u, i, case when sum(sim) = 0 then 0 else sum(sim * r) / sum(sim) end score from top join ratings_ui on u = b group by 1, 2)"
DENSE = "dense as (select u, i, coalesce(score, 0) score from (select distinct a u from top) cross join (select distinct i from ratings_ui) left join scores using (u, i))"


@query("select u, i, round(score, 8) + 0 as score from dense", f"{sims_sql('u', 'i', 'cosine')}, {SCORES}, {DENSE}")
def knn_predict_all(spark, sf_dir):
    out = neighbours.predict_all(nearest(spark, sf_dir, "cosine", True), view(spark, sf_dir, "ratings_ui"))
    return out.select("u", "i", vec.rounded(F.col("score")).alias("score"))


@query("select p.u, p.i, round(coalesce(sum(sim * coalesce(q.r, 0)) / nullif(sum(sim), 0), 0), 8) + 0 as score from ratings_ui p join top on a = p.u left join ratings_ui q on q.u = b and q.i = p.i group by 1, 2", sims_sql("u", "i", "cosine"))
def knn_predict_pairs(spark, sf_dir):
    ratings = view(spark, sf_dir, "ratings_ui")
    out = neighbours.predict_pairs(nearest(spark, sf_dir, "cosine", True), ratings, ratings.select("u", "i"))
    return out.select("u", "i", vec.rounded(F.col("score")).alias("score"))


@query("select u, string_agg(concat(i, ',', s), ';' order by s, i) as line from (select u, i, cast(round(score * 1e6) as bigint) s from scores) group by u", f"{sims_sql('u', 'i', 'cosine')}, {SCORES}")
def knn_predict_sorted(spark, sf_dir):
    return neighbours.sorted_lines(neighbours.predict_rated(nearest(spark, sf_dir, "cosine", True), view(spark, sf_dir, "ratings_ui")))


LINKS = "links as (select src, dst, k from edges join (select dst kd, count(*) k from edges group by dst) on kd = dst), ni as (select cast(count(distinct i) as double) items from ratings_ui)"
WALKED = "x0 as (select u, i, r from ratings_ui), " + ", ".join(f"x{t} as (select u, i, sum(r) r from (select src u, i, r * 0.8e0 / k r from links join x{t - 1} on dst = u union all select u, i, 0.2e0 / items from x{t - 1} cross join ni) group by 1, 2)" for t in (1, 2))


@query("select u, i, round(r, 8) + 0 as r from x2", f"{LINKS}, {WALKED}")
def relational_prediction(spark, sf_dir):
    ratings = view(spark, sf_dir, "ratings_ui")
    n = ratings.select("i").distinct().count()
    return neighbours.relational(view(spark, sf_dir, "edges"), ratings, n, 2, 0.2).select("u", "i", vec.rounded(F.col("r")).alias("r"))


# ------------------------------------------------------------------------------------------------ starting values, losses
@query("select i as id, round(avg(r), 8) + 0 as b from ratings_cp group by i")
def item_bias(spark, sf_dir):
    return cf.item_bias(view(spark, sf_dir, "ratings_cp")).select("id", vec.rounded(F.col("x")[0]).alias("b"))


@query("select distinct u as id, cast(0 as double) as b from ratings_cp")
def user_bias(spark, sf_dir):
    return cf.zero_bias(view(spark, sf_dir, "ratings_cp")).select("id", F.col("x")[0].alias("b"))


@query("select u, a, b from prefs")
def pairwise_prefs(spark, sf_dir):
    return cf.preferences(view(spark, sf_dir, "ratings_s"))


@query(told(0, {"v": ("v", 3)}), start("v0", "ratings_cp", "i", 2, 3))
def matrix_init(spark, sf_dir):
    return flat({"v": cf.starting(view(spark, sf_dir, "ratings_cp"), "i", 2, 3)}, "v")


@query(None)
def matrix_init_random(spark, sf_dir):
    return flat({"v": cf.random_start(view(spark, sf_dir, "ratings_cp"), "i", 2, 3)}, "v")


P = dot("u", "v")
S = f"(1 / (1 + exp(-{P})))"
VALUES = {
    "square": (f"pow({P} - r, 2)", "true"),
    "log_square": (f"ln(pow({P} - r, 2))", f"{P} <> r"),
    "logistic": (f"pow({S} - r, 2)", "true"),
    "poisson": (f"greatest({P}, 1e-12) - r * ln(greatest({P}, 1e-12))", "true"),
}


@query(" union all ".join(f"select '{name}' as name, round(sum({value}), 6) + 0 as loss, cast(sum(cast(trunc(({value}) * 1000) as bigint)) as bigint) as thousandths, count(*) as cnt from j where {where}" for name, (value, where) in VALUES.items()), f"{UV_START}, j as ({joined('ratings_s', UV, 0)})")
def loss_metric(spark, sf_dir):
    ratings, out = view(spark, sf_dir, "ratings_s"), None
    params = factors(ratings)
    for name in VALUES:
        one = cf.loss_metric(ratings, params, getattr(cf, name)()).select(F.lit(name).alias("name"), vec.rounded(F.col("loss"), 6).alias("loss"), "thousandths", "cnt")
        out = one if out is None else out.unionByName(one)
    return out


# ------------------------------------------------------------------------------------------------ batch descent
def trained(spark, sf_dir, name: str, places: int = 8, **more) -> DataFrame:
    model = models.MODELS[name](d=D, lr=LR, lam=LAM, **more)
    return flat(model.fit(view(spark, sf_dir, "ratings_s"), STEPS), "u", "v", places=places)


def plain(e: str) -> dict[str, list[str]]:
    return {"u": grow(e, "v", "u"), "v": grow(e, "u", "v")}


@query(told(STEPS, UV_TOLD), f"{UV_START}, {batch('ratings_s', UV, plain(f'({P} - r)'))}")
def mf_sgd_gaussian(spark, sf_dir):
    return trained(spark, sf_dir, "gaussian")


@query(told(STEPS, UV_TOLD, 5), f"{UV_START}, {batch('ratings_s', UV, plain(f'(1 / ({P} - r))'), where=f'{P} <> r')}")
def mf_sgd_loggaussian(spark, sf_dir):
    return trained(spark, sf_dir, "log_gaussian", 5)


@query(told(STEPS, UV_TOLD), f"{UV_START}, {batch('ratings_s', UV, plain(f'(({S} - r) * {S} * (1 - {S}))'))}")
def mf_sgd_logistic(spark, sf_dir):
    return trained(spark, sf_dir, "logistic")


@query(told(STEPS, UV_TOLD), f"{UV_START}, {batch('ratings_s', UV, plain(f'(1 - r / greatest({P}, 1e-12))'))}")
def mf_sgd_poisson(spark, sf_dir):
    return trained(spark, sf_dir, "poisson")


BIAS = UV | {"bu": ("u", "bu", 1), "bv": ("i", "bv", 1)}
BIAS_TOLD = UV_TOLD | {"bu": ("bu", 1), "bv": ("bv", 1)}


def bias_start(source: str) -> str:
    return f"bu0 as (select distinct u id, cast(0 as double) x0 from {source}), bv0 as (select i id, avg(r) x0 from {source} group by i)"


BE = f"({P} + bu0 + bv0 - r)"


@query(
    told(STEPS, BIAS_TOLD, 7),
    f"{start('u0', 'ratings_cp', 'u', 1)}, {start('v0', 'ratings_cp', 'i', 2)}, {bias_start('ratings_cp')}, " + batch("ratings_cp", BIAS, plain(BE) | {"bu": [f"{BE} + {lam} * bu0"], "bv": [f"{BE} + {lam} * bv0"]}),
)
def mf_sgd_bias(spark, sf_dir):
    model = models.MODELS["bias"](d=D, lr=LR, lam=LAM)
    return flat(model.fit(view(spark, sf_dir, "ratings_cp"), STEPS), "u", "v", "bu", "bv", places=7)


HB = UV | {"b": ("zero", "b", 4)}
HE = f"({P} + {BILINEAR} - r)"
B_GRAD = lambda e: [f"{e} * {z} + {lam} * b{k}" for k, z in enumerate(Z)]


@query(told(STEPS, UV_TOLD | {"b": ("b", 4)}, 7), f"{WITH_F}, {UV_START}, {B_START}, " + batch("rf", HB, plain(HE) | {"b": B_GRAD(HE)}))
def mf_hybrid(spark, sf_dir):
    model = models.MODELS["hybrid"](d=D, lr=LR, lam=LAM)
    return flat(model.fit(with_features(view(spark, sf_dir, "ratings_s")), STEPS), "u", "v", "b", places=7)


RE = f"({BILINEAR} - r)"


@query(told(STEPS, {"b": ("b", 4)}), f"{WITH_F}, {B_START}, " + batch("rf", {"b": ("zero", "b", 4)}, {"b": B_GRAD(RE)}, per="u", over="avg"))
def mf_regression(spark, sf_dir):
    model = models.MODELS["regression"](d=D, lr=LR, lam=LAM)
    return flat(model.fit(with_features(view(spark, sf_dir, "ratings_s")), STEPS), "b")


LAM_S, LAM_V = 0.5, 0.25
CMF_START = f"{start('u0', 'ratings_s', 'u', 1)}, {start('v0', 'ratings_s', 'i', 2)}, {start('s0', 'cmf_ms', 's', 3, D, False)}"
THREE = "three as (select 'u' l, 'v' m, u a, i b, r, cast(1 as double) w from ratings_s union all select 'u', 's', u, s, r, 0.5e0 from cmf_ms union all select 'v', 's', i, s, r, 0.25e0 from cmf_mv)"
CMF_TOLD = UV_TOLD | {"s": ("s", D)}


def collective_sql() -> str:
    out = [THREE]
    for t in range(STEPS):
        every = " union all ".join(f"select '{x}' role, id, x0, x1 from {x}{t}" for x in "uvs")
        out.append(f"p{t} as ({every})")
        out.append(f"j{t} as (select q.*, y.x0 u0, y.x1 u1, z.x0 v0, z.x1 v1 from three q join p{t} y on y.role = l and y.id = a join p{t} z on z.role = m and z.id = b)")
        e = f"({P} - r)"
        both = f"select l role, a id, w * ({grow(e, 'v', 'u')[0]}) g0, w * ({grow(e, 'v', 'u')[1]}) g1 from j{t} union all select m, b, w * ({grow(e, 'u', 'v')[0]}), w * ({grow(e, 'u', 'v')[1]}) from j{t}"
        for x in "uvs":
            out.append(moved(x, t, mean(f"select * from ({both}) where role = '{x}'", D), D))
    return ", ".join(out)


@query(told(STEPS, CMF_TOLD), f"{CMF_START}, {collective_sql()}")
def cmf(spark, sf_dir):
    model = models.Collective(d=D, lr=LR, lam=LAM, lam_s=LAM_S, lam_v=LAM_V)
    return flat(model.fit(*(view(spark, sf_dir, x) for x in ("ratings_s", "cmf_ms", "cmf_mv")), STEPS), "u", "v", "s")


PREF = {"u": ("u", "u", D), "va": ("a", "v", D), "vb": ("b", "v", D)}
BS = "(1 / (1 + exp(" + " + ".join(f"u{k} * (va{k} - vb{k})" for k in range(D)) + ")))"
PREF_GRAD = {"u": [f"-{BS} * (va{k} - vb{k}) + {lam} * u{k}" for k in range(D)], "va": [f"-{BS} * u{k} + {lam} * va{k}" for k in range(D)], "vb": [f"{BS} * u{k} + {lam} * vb{k}" for k in range(D)]}


@query(told(STEPS, UV_TOLD), f"{UV_START}, {batch('prefs', PREF, PREF_GRAD)}")
def bpr(spark, sf_dir):
    model = models.MODELS["bpr"](d=D, lr=LR, lam=LAM)
    return flat(model.fit(view(spark, sf_dir, "ratings_s"), STEPS), "u", "v")


CELL = {"u": ("p", "u", D), "v": ("q", "v", D), "s": ("o", "s", D)}
CELL_START = f"{start('u0', 'tensor', 'p', 1)}, {start('v0', 'tensor', 'q', 2)}, {start('s0', 'tensor', 'o', 3, D, False)}"
CP = "(" + " + ".join(f"u{k} * v{k} * s{k}" for k in range(D)) + " - r)"
PAIR = f"({dot('u', 'v')} + {dot('v', 's')} + {dot('u', 's')} - r)"


def cell_grad(e: str, part, held=lambda k: f"s{k}") -> dict[str, list[str]]:
    return {x: [f"{e} * {part(y, z, k)} + {lam} * {held(k) if x == 's' else f'{x}{k}'}" for k in range(D)] for x, y, z in (("u", "v", "s"), ("v", "u", "s"), ("s", "u", "v"))}


def tensor_model(spark, sf_dir, name: str) -> DataFrame:
    return flat(models.MODELS[name](d=D, lr=LR, lam=LAM).fit(view(spark, sf_dir, "tensor"), STEPS), "u", "v", "s")


@query(told(STEPS, CMF_TOLD), f"{CELL_START}, " + batch("tensor", CELL, cell_grad(CP, lambda y, z, k: f"({y}{k} * {z}{k})")))
def tensor_cp(spark, sf_dir):
    return tensor_model(spark, sf_dir, "tensor_cp")


@query(told(STEPS, CMF_TOLD), f"{CELL_START}, " + batch("tensor", CELL, cell_grad(PAIR, lambda y, z, k: f"({y}{k} + {z}{k})")))
def tensor_pair(spark, sf_dir):
    return tensor_model(spark, sf_dir, "tensor_pair")


def temporal_sql() -> str:
    out = []
    for t in range(STEPS):
        out.append(f"c{t} as (select q.*, coalesce(w.x0, 0) h0, coalesce(w.x1, 0) h1 from tensor q left join s{t} w on w.id = o - 1)")
        one = batch(f"c{t}", CELL, cell_grad(CP, lambda y, z, k: f"({y}{k} * {z}{k})", lambda k: f"(s{k} - h{k})"), 1)
        out.append(one.replace("j0", f"j{t}_").replace("u1 as", f"u{t + 1} as").replace("v1 as", f"v{t + 1} as").replace("s1 as", f"s{t + 1} as").replace("from u0 o", f"from u{t} o").replace("from v0 o", f"from v{t} o").replace("from s0 o", f"from s{t} o").replace("join u0 u_", f"join u{t} u_").replace("join v0 v_", f"join v{t} v_").replace("join s0 s_", f"join s{t} s_"))
    return ", ".join(out)


@query(told(STEPS, CMF_TOLD), f"{CELL_START}, {temporal_sql()}")
def tensor_temporal(spark, sf_dir):
    return tensor_model(spark, sf_dir, "tensor_temporal")


# ------------------------------------------------------------------------------------------------ sequential descent
RANKED = "ranked as (select *, row_number() over (partition by u order by i) rn, count(*) over (partition by u) n from {source})"


def fold(source: str, roles: dict[str, tuple[str, str, int]], own: dict[str, int], stages: list[tuple[str, str, dict[str, list[str]]]], order: str = "i") -> str:
    """Recursive pass: f holds each user's state before (o_) and after (role) every record, and the gradients.

    ``stages``: (name, expression of the error, role -> new columns), each seeing the columns of those before it.
    """
    state = [f"{r}{k}" for r, d in own.items() for k in range(d)]
    others = {r: x for r, x in roles.items() if r not in own}
    base = "select s.id, cast(0 as bigint), " + ", ".join(f"s_{r}.x{k}, s_{r}.x{k}" for r, d in own.items() for k in range(d)) + " from u0 s " + " ".join(f"join {roles[r][1]}0 s_{r} on s_{r}.id = s.id" for r in own)
    cols = ", ".join(f"{r}_.x{k} {r}{k}" for r, (_, _, d) in others.items() for k in range(d))
    inner = "select q.*, " + ", ".join(f"f.{c} o_{c}" for c in state) + (", " + cols if cols else "") + " from f join ranked q on q.u = f.fu_ and q.rn = f.frn + 1 " + " ".join(f"join {table}0 {r}_ on {r}_.id = q.{key}" for r, (key, table, _) in others.items())
    for name, e, new in stages:
        inner = f"select *, {e} {name} from ({inner})"
        if new:
            inner = "select *, " + ", ".join(f"{x} {r}{k}" for r, xs in new.items() for k, x in enumerate(xs)) + f" from ({inner})"
    step = "select u, rn, " + ", ".join(f"o_{c}, {c}" for c in state) + f" from ({inner})"
    heads = "fu_, frn, " + ", ".join(f"o_{c}, {c}" for c in state)
    told_ = f"seen as (select q.*, " + ", ".join(f"f.o_{c}, f.{c}" for c in state) + (", " + cols if cols else "") + " from f join ranked q on q.u = f.fu_ and q.rn = f.frn " + " ".join(f"join {table}0 {r}_ on {r}_.id = q.{key}" for r, (key, table, _) in others.items()) + ")"
    ends = ", ".join(f"{roles[r][1]}1 as (select s.id, " + ", ".join(f"coalesce(z.{r}{k}, s.x{k}) x{k}" for k in range(d)) + f" from {roles[r][1]}0 s left join (select * from seen where rn = n) z on z.u = s.id)" for r, d in own.items())
    return f"{RANKED.format(source=source).replace('order by i', f'order by {order}')}, f({heads}) as ({base} union all {step}), {told_}, {ends}"


def down(role: str, e: str, d: int = D, other: str = "v") -> list[str]:
    """State after a record: o - lr / n * (e * v + lam * o)."""
    return [f"o_{role}{k} - {lr} / n * ({e} * {other}{k} + {lam} * o_{role}{k})" for k in range(d)]


OP = dot("o_u", "v")


def fold_model(spark, sf_dir, name: str, *roles: str, ratings: str = "ratings_s", places: int = 8, with_f: bool = False, **more) -> DataFrame:
    data = view(spark, sf_dir, ratings)
    model = models.MODELS[name](d=D, lr=LR, lam=LAM, solver="sequential", **more)
    return flat(model.fit(with_features(data) if with_f else data, 1), *roles, places=places)


@query(told(1, UV_TOLD), f"{UV_START}, " + fold("ratings_s", UV, {"u": D}, [("e", f"({OP} - r)", {"u": down("u", "e")})]) + ", " + moved("v", 0, mean(f"select i id, ({P} - r) * u0 + {lam} * v0 g0, ({P} - r) * u1 + {lam} * v1 g1 from seen", D), D), recursive=True)
def mf_fold_gaussian(spark, sf_dir):
    return fold_model(spark, sf_dir, "gaussian", "u", "v")


FOLD_BIAS = [("e", f"({OP} + o_bu0 + bv0 - r)", {"u": down("u", "e")}), ("e2", f"({P} + o_bu0 + bv0 - r)", {"bu": [f"o_bu0 - {lr} / n * (e2 + {lam} * o_bu0)"]})]


@query(
    told(1, BIAS_TOLD),
    f"{UV_START}, {bias_start('ratings_s')}, "
    + fold("ratings_s", BIAS, {"u": D, "bu": 1}, FOLD_BIAS)
    + ", "
    + moved("v", 0, mean(f"select i id, ({P} + o_bu0 + bv0 - r) * u0 + {lam} * v0 g0, ({P} + o_bu0 + bv0 - r) * u1 + {lam} * v1 g1 from seen", D), D)
    + ", "
    + moved("bv", 0, mean(f"select i id, ({P} + bu0 + bv0 - r) + {lam} * bv0 g0 from seen", 1), 1),
    recursive=True,
)
def mf_fold_bias(spark, sf_dir):
    return fold_model(spark, sf_dir, "bias", "u", "v", "bu", "bv")


def fold_hybrid(bias: bool, rf: float = 1.0, ru: float = 1.0, ri: float = 1.0) -> str:
    """All gradients at the old state; B's are averaged within users, then over them."""
    roles = (BIAS if bias else UV) | {"b": ("zero", "b", 4)}
    e = f"({OP} + {rf}e0 * {BILINEAR}" + (f" + {ru}e0 * o_bu0 + {ri}e0 * bv0" if bias else "") + " - r)"
    new = {"u": down("u", "e")} | ({"bu": [f"o_bu0 - {lr} / n * ({ru}e0 * e + {lam} * o_bu0)"]} if bias else {})
    own = {"u": D} | ({"bu": 1} if bias else {})
    out = [WITH_F, UV_START, B_START] + ([bias_start("ratings_s")] if bias else [])
    out.append(fold("rf", roles, own, [("e", e, new)]))
    out.append(moved("v", 0, mean("select i id, " + ", ".join(f"{e} * o_u{k} + {lam} * v{k} g{k}" for k in range(D)) + " from seen", D), D))
    if bias:
        out.append(moved("bv", 0, mean(f"select i id, {ri}e0 * {e} + {lam} * bv0 g0 from seen", 1), 1))
    inner = "select u, " + ", ".join(f"avg({rf}e0 * {e} * {z} + {lam} * b{k}) g{k}" for k, z in enumerate(Z)) + " from seen group by u"
    out.append(moved("b", 0, "select 0 id, " + ", ".join(f"avg(g{k}) g{k}" for k in range(4)) + f" from ({inner})", 4))
    return ", ".join(out)


@query(told(1, UV_TOLD | {"b": ("b", 4)}), fold_hybrid(False), recursive=True)
def mf_fold_hybrid(spark, sf_dir):
    return fold_model(spark, sf_dir, "hybrid", "u", "v", "b", with_f=True)


@query(told(1, BIAS_TOLD | {"b": ("b", 4)}), fold_hybrid(True), recursive=True)
def mf_fold_hybrid_bias(spark, sf_dir):
    return fold_model(spark, sf_dir, "hybrid_bias", "u", "v", "bu", "bv", "b", with_f=True)


@query(told(1, BIAS_TOLD | {"b": ("b", 4)}), fold_hybrid(True, 0.5, 0.75, 0.25), recursive=True)
def mf_combine(spark, sf_dir):
    return fold_model(spark, sf_dir, "combine", "u", "v", "bu", "bv", "b", with_f=True, rf=0.5, ru=0.75, ri=0.25)


OBS = "(1 / (1 + exp(" + " + ".join(f"o_u{k} * (va{k} - vb{k})" for k in range(D)) + ")))"


@query(
    told(1, UV_TOLD),
    f"{UV_START}, "
    + fold("prefs", PREF, {"u": D}, [("e", OBS, {"u": [f"o_u{k} - {lr} / n * (-e * (va{k} - vb{k}) + {lam} * o_u{k})" for k in range(D)]})], "a, b")
    + ", "
    + moved("v", 0, mean(" union all ".join(f"select {key} id, " + ", ".join(f"{sign}{OBS} * o_u{k} + {lam} * {role}{k} g{k}" for k in range(D)) + " from seen" for key, role, sign in (("a", "va", "-"), ("b", "vb", ""))), D), D),
    recursive=True,
)
def bpr_fold(spark, sf_dir):
    return fold_model(spark, sf_dir, "bpr", "u", "v")


TWO = "two as (select u, 0 k, i, r, count(*) over (partition by u) m, cast(1 as double) w from ratings_s union all select u, 1, s, r, count(*) over (partition by u), 0.5e0 from cmf_ms), either0 as (select 0 k, * from v0 union all select 1, * from s0)"
TWO_RANKED = "ranked as (select q.*, e.x0 v0, e.x1 v1, row_number() over (partition by u order by q.k, i) rn, count(*) over (partition by u) n from two q join either0 e on e.k = q.k and e.id = i)"
TWO_PASS = (
    "f(fu_, frn, o0, o1, u0, u1) as (select id, cast(0 as bigint), x0, x1, x0, x1 from u0 union all "
    f"select u, rn, o0, o1, o0 - {lr} / m * w * (e * v0 + {lam} * o0), o1 - {lr} / m * w * (e * v1 + {lam} * o1) from (select *, o0 * v0 + o1 * v1 - r e from (select q.*, f.u0 o0, f.u1 o1 from f join ranked q on q.u = f.fu_ and q.rn = f.frn + 1))), "
    "seen as (select q.*, o0, o1, u0, u1 from f join ranked q on q.u = f.fu_ and q.rn = f.frn), u1 as (select s.id, coalesce(z.u0, s.x0) x0, coalesce(z.u1, s.x1) x1 from u0 s left join (select * from seen where rn = n) z on z.u = s.id)"
)
SIDE = "side as (select q.*, a.x0 p0, a.x1 p1, b.x0 q0, b.x1 q1, a.x0 * b.x0 + a.x1 * b.x1 - r e from cmf_mv q join v0 a on a.id = i join s0 b on b.id = q.s)"
OE = "(o0 * v0 + o1 * v1 - r)"


def two_gradients(k: int, key: str, x: str, y: str) -> str:
    return f"select i id, w * ({OE} * o0 + {lam} * v0) g0, w * ({OE} * o1 + {lam} * v1) g1 from seen where k = {k} union all select {key} id, {LAM_V}e0 * (e * {y}0 + {lam} * {x}0), {LAM_V}e0 * (e * {y}1 + {lam} * {x}1) from side"


@query(told(1, CMF_TOLD), f"{CMF_START}, {TWO}, {TWO_RANKED}, {TWO_PASS}, {SIDE}, " + moved("v", 0, mean(two_gradients(0, "i", "p", "q"), D), D) + ", " + moved("s", 0, mean(two_gradients(1, "s", "q", "p"), D), D), recursive=True)
def cmf_fold(spark, sf_dir):
    model = models.Collective(d=D, lr=LR, lam=LAM, lam_s=LAM_S, lam_v=LAM_V, solver="sequential")
    return flat(model.fit(*(view(spark, sf_dir, x) for x in ("ratings_s", "cmf_ms", "cmf_mv")), 1), "u", "v", "s")


# ------------------------------------------------------------------------------------------------ least squares
def solved(name: str, key: str, other: str, table: str) -> str:
    """Two equations by Cramer's rule."""
    sums = f"select {key} id, sum(x0 * x0) + 0.1e0 a, sum(x0 * x1) b, sum(x1 * x1) + 0.1e0 d, sum(r * x0) p, sum(r * x1) q from ratings_ui join {table} f on f.id = {other} group by 1"
    return f"{name} as (select id, (p * d - b * q) / (a * d - b * b) x0, (a * q - b * p) / (a * d - b * b) x1 from ({sums}))"


@query(told(1, UV_TOLD, 6), f"{start('u0', 'ratings_ui', 'u', 1)}, {solved('v1', 'i', 'u', 'u0')}, {solved('u1', 'u', 'i', 'v1')}")
def als_d2(spark, sf_dir):
    model = models.MODELS["gaussian"](d=D, lam=0.1, solver="als")
    return flat(model.fit(view(spark, sf_dir, "ratings_ui"), 1), "u", "v", places=6)


@query(told(1, UV_TOLD, 6), f"{start('u0', 'ratings_ui', 'u', 1)}, {solved('v1', 'i', 'u', 'u0')}, {solved('u1', 'u', 'i', 'v1')}")
def loggaussian_als(spark, sf_dir):
    """Least squares do not ask for the loss."""
    model = models.MODELS["log_gaussian"](d=D, lam=0.1, solver="als")
    return flat(model.fit(view(spark, sf_dir, "ratings_ui"), 1), "u", "v", places=6)


def solved_three(name: str, key: str, other: str, table: str) -> str:
    """Three equations by Cramer's rule."""
    sums = ", ".join(f"sum(x{j} * x{k}) + {0.1 if j == k else 0}e0 a{j}{k}" for j in range(3) for k in range(3)) + ", " + ", ".join(f"sum(r * x{k}) b{k}" for k in range(3))

    def determinant(column: int | None) -> str:
        m = [[f"b{j}" if k == column else f"a{j}{k}" for k in range(3)] for j in range(3)]
        minor = lambda k: [x for x in range(3) if x != k]
        return "(" + " + ".join(f"{'-' if k == 1 else ''}{m[0][k]} * ({m[1][minor(k)[0]]} * {m[2][minor(k)[1]]} - {m[1][minor(k)[1]]} * {m[2][minor(k)[0]]})" for k in range(3)) + ")"

    solution = ", ".join(f"{determinant(k)} / {determinant(None)} x{k}" for k in range(3))
    return f"{name} as (select id, {solution} from (select {key} id, {sums} from ratings_ui join {table} f on f.id = {other} group by 1))"


@query(told(1, {"u": ("u", 3), "v": ("v", 3)}, 4), f"{start('u0', 'ratings_ui', 'u', 1, 3)}, {solved_three('v1', 'i', 'u', 'u0')}, {solved_three('u1', 'u', 'i', 'v1')}")
def als_d3(spark, sf_dir):
    model = models.MODELS["gaussian"](d=3, lam=0.1, solver="als")
    return flat(model.fit(view(spark, sf_dir, "ratings_ui"), 1), "u", "v", places=4)


@query(None)
def als_general(spark, sf_dir):
    model = models.MODELS["gaussian"](d=8, lam=0.1, solver="als")
    return flat(model.fit(view(spark, sf_dir, "ratings_cp"), 1), "u", "v", places=6)


def multiplied(name: str, own: str, key: str, other_key: str, other: str) -> str:
    sums = f"select {key} id, sum(r * x0) p0, sum(r * x1) p1 from ratings_s join {other} f on f.id = {other_key} group by 1"
    gram = f"select sum(x0 * x0) + {lam} a, sum(x0 * x1) b, sum(x1 * x1) + {lam} d from {other}"
    return f"{name} as (select o.id, coalesce(x0 * p0 / nullif(a * x0 + b * x1, 0), x0) x0, coalesce(x1 * p1 / nullif(b * x0 + d * x1, 0), x1) x1 from {own} o cross join ({gram}) left join ({sums}) s on s.id = o.id)"


@query(told(1, UV_TOLD), f"{UV_START}, {multiplied('v1', 'v0', 'i', 'u', 'u0')}, {multiplied('u1', 'u0', 'u', 'i', 'v1')}")
def loggaussian_newton(spark, sf_dir):
    model = models.MODELS["log_gaussian"](d=D, lam=LAM, solver="newton")
    return flat(model.fit(view(spark, sf_dir, "ratings_s"), 1), "u", "v")


@query(told(1, UV_TOLD), f"{UV_START}, {multiplied('v1', 'v0', 'i', 'u', 'u0')}, {multiplied('u1', 'u0', 'u', 'i', 'v1')}")
def newton_mult(spark, sf_dir):
    model = models.MODELS["gaussian"](d=D, lam=LAM, solver="newton")
    return flat(model.fit(view(spark, sf_dir, "ratings_s"), 1), "u", "v")


# ------------------------------------------------------------------------------------------------ prediction
def scored(df: DataFrame) -> DataFrame:
    """Ten places hold every product of the starting values, so that no score lies on a tie."""
    return df.select("u", "i", vec.rounded(F.col("score"), 10).alias("score"))


def biases(ratings: DataFrame) -> dict[str, DataFrame]:
    return {"bu": cf.starting(ratings, "u", 5, 1), "bv": cf.starting(ratings, "i", 6, 1)}


BIASES = f"{start('bu0', 'ratings_s', 'u', 5, 1)}, {start('bv0', 'ratings_s', 'i', 6, 1)}"
J = f"j as ({joined('ratings_s', UV, 0)})"
PAIRS = "select u, i, round({}, 10) + 0 as score from j"


@query(PAIRS.format(P), f"{UV_START}, {J}")
def predict_pairs(spark, sf_dir):
    ratings = view(spark, sf_dir, "ratings_s")
    return scored(cf.predict_pairs(ratings.select("u", "i"), factors(ratings), cf.square()))


@query(PAIRS.format(S), f"{UV_START}, {J}")
def predict_pairs_logistic(spark, sf_dir):
    ratings = view(spark, sf_dir, "ratings_s")
    return scored(cf.predict_pairs(ratings.select("u", "i"), factors(ratings), cf.logistic()))


@query(f"select a.id as u, c.id as i, round(a.x0 * c.x0 + a.x1 * c.x1, 10) + 0 as score from u0 a cross join v0 c", UV_START)
def predict_all(spark, sf_dir):
    params = factors(view(spark, sf_dir, "ratings_s"))
    return scored(cf.predict_all(params["u"], params["v"]))


@query(f"select a.id as u, c.id as i, round(a.x0 * c.x0 + a.x1 * c.x1 + y.x0 + z.x0, 10) + 0 as score from u0 a join bu0 y on y.id = a.id cross join (v0 c join bv0 z on z.id = c.id)", f"{UV_START}, {BIASES}")
def predict_all_bias(spark, sf_dir):
    ratings = view(spark, sf_dir, "ratings_s")
    params = factors(ratings) | biases(ratings)
    return scored(cf.predict_all_bias(params))


@query(PAIRS.format(f"{P} + bu0 + bv0"), f"{UV_START}, {BIASES}, j as ({joined('ratings_s', BIAS, 0)})")
def predict_pairs_bias(spark, sf_dir):
    ratings = view(spark, sf_dir, "ratings_s")
    return scored(cf.predict_pairs(ratings.select("u", "i"), factors(ratings) | biases(ratings), cf.square_bias()))


def hybrid_pairs(roles: dict, e: str) -> tuple[str, str]:
    bias = f", {BIASES}" if "bu" in roles else ""
    return PAIRS.format(e), f"{WITH_F}, {UV_START}, {B_START}{bias}, j as ({joined('rf', roles, 0)})"


def hybrid_scores(spark, sf_dir, loss) -> DataFrame:
    ratings = view(spark, sf_dir, "ratings_s")
    params = factors(ratings) | {"b": b_start(spark)} | biases(ratings)
    return scored(cf.predict_pairs(with_features(ratings).select("u", "i", "fu", "fv"), params, loss))


@query(*hybrid_pairs(HB, f"{P} + {BILINEAR}"))
def predict_pairs_hybrid(spark, sf_dir):
    return hybrid_scores(spark, sf_dir, cf.hybrid())


@query(*hybrid_pairs(BIAS | HB, f"{P} + {BILINEAR} + bu0 + bv0"))
def predict_pairs_hybrid_bias(spark, sf_dir):
    return hybrid_scores(spark, sf_dir, cf.hybrid(bias=True))


@query(*hybrid_pairs({"b": HB["b"]}, BILINEAR))
def predict_pairs_regression(spark, sf_dir):
    return hybrid_scores(spark, sf_dir, cf.hybrid(factors=False))


@query(*hybrid_pairs(BIAS | HB, f"{P} + 0.5e0 * {BILINEAR} + 0.75e0 * bu0 + 0.25e0 * bv0"))
def predict_pairs_combine(spark, sf_dir):
    return hybrid_scores(spark, sf_dir, cf.hybrid(bias=True, rf=0.5, ru=0.75, ri=0.25))


@query("select u, i, o, round(score, 12) + 0 as score from (select p u, q i, o, " + " + ".join(f"u{k} * v{k} * s{k}" for k in range(D)) + " score from j)", f"{CELL_START}, j as ({joined('tensor', CELL, 0)})")
def predict_cells(spark, sf_dir):
    cells = view(spark, sf_dir, "tensor")
    params = {"u": cf.starting(cells, "p", 1, D), "v": cf.starting(cells, "q", 2, D), "s": cf.starting(cells, "o", 3, D, False)}
    out = cf.predict_pairs(cells.select("p", "q", "o"), params, cf.tensor_cp())
    return out.select(F.col("p").alias("u"), F.col("q").alias("i"), "o", vec.rounded(F.col("score"), 12).alias("score"))
