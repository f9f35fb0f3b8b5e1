"""Hand-worked cases and properties of the operators."""

from __future__ import annotations

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from grafmill.functions import vec
from grafmill.operators import cf, graph, matrix, models, neighbours, pairs
from grafmill.sources import text


def edges(spark, *pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


# ------------------------------------------------------------------------------------------------ graphs
RING = [(0, 1), (1, 2), (2, 3), (3, 0), (0, 2)]


def test_pagerank_keeps_its_mass_without_dead_ends(spark):
    got = {r.id: r.v[0] for r in graph.pagerank(edges(spark, *RING), 8).collect()}
    assert math.isclose(sum(got.values()), 1.0) and got[2] > got[1]


def test_pagerank_against_dense_matrices(spark):
    p = np.zeros((4, 4))
    for a, b in RING:
        p[b, a] = 1 / sum(x == a for x, _ in RING)
    x = np.full(4, 0.25)
    for _ in range(5):
        x = 0.9 * p @ x + 0.1 / 4
    got = {r.id: r.v[0] for r in graph.pagerank(edges(spark, *RING), 5).collect()}
    assert np.allclose([got[i] for i in range(4)], x)


def test_pagerank_stops_when_still(spark):
    few, many = (graph.pagerank(edges(spark, *RING), n, tol=t) for n, t in ((60, 1e-3), (60, None)))
    a, b = ({r.id: r.v[0] for r in x.collect()} for x in (few, many))
    assert a == pytest.approx(b, abs=2e-2) and a != b


def test_dead_end_mass_is_dropped(spark):
    got = {r.id: r.v[0] for r in graph.pagerank(edges(spark, (0, 1)), 1).collect()}
    assert got == pytest.approx({0: 0.05, 1: 0.5})


def test_hits_normalised(spark):
    got = graph.hits(edges(spark, *RING), 3, normalize=True).collect()
    assert math.isclose(sum(r.authority**2 for r in got), 1.0) and math.isclose(sum(r.hub**2 for r in got), 1.0)


def test_hops_and_reachable(spark):
    e = edges(spark, (0, 1), (1, 2), (2, 3), (5, 6))
    assert {r.id: r.hops for r in graph.hops(e, 0, 9).collect()} == {0: 0, 1: 1, 2: 2, 3: 3}
    assert graph.reachable(e, 0, 3) == 3.0 and graph.reachable(e, 0, 6) is None and graph.reachable(e, 0, 3, 2) is None


def test_shortest_paths_take_the_cheaper_way(spark):
    e = spark.createDataFrame([(0, 1, 5.0), (0, 2, 1.0), (2, 1, 1.0), (1, 3, 1.0)], "src long, dst long, w double")
    assert {r.id: r.dist for r in graph.shortest_paths(e, 0, 4).collect()} == {0: 0.0, 1: 2.0, 2: 1.0, 3: 3.0}


def test_band_counts_members_once(spark):
    e, seeds = edges(spark, (0, 5), (1, 5), (0, 6), (0, 1)), edges(spark, (0, 0), (1, 1)).select(F.col("src").alias("id"))
    assert {r.id: r.n for r in graph.expand_band(e, seeds, 1, 2, 9).collect()} == {5: 2, 1: 2}
    assert {r.id for r in graph.expand_reverse(e, edges(spark, (5, 5)).select(F.col("src").alias("id")), 1).collect()} == {0, 1, 5}


def test_neighbourhood_never_shrinks(spark):
    n = [r.n for r in graph.neighbourhood(edges(spark, *((i, i + 1) for i in range(12))), 6).orderBy("h").collect()]
    assert n == sorted(n) and n[0] < n[-1]


def test_neighbourhood_from_in_neighbours(spark):
    n = [r.n for r in graph.neighbourhood(edges(spark, (0, 1), (0, 2), (3, 4)), 1, in_neighbours=True).orderBy("h").collect()]
    assert len(n) == 2 and n[0] <= n[1]


def test_adjacency_round_trip(spark):
    e = edges(spark, *RING)
    assert sorted((r.src, r.dst) for r in graph.from_adjacency(graph.adjacency(e)).collect()) == sorted(RING)


def test_induced_needs_both_ends(spark):
    ids = edges(spark, (0, 0), (1, 1), (2, 2)).select(F.col("src").alias("id"))
    assert sorted(map(tuple, graph.induced(edges(spark, *RING), ids).collect())) == [(0, 1), (0, 2), (1, 2)]


# ------------------------------------------------------------------------------------------------ losses
def gradients(spark, loss, record, lam=0.1):
    df = spark.createDataFrame([record])
    df = df.select(*(F.col(c).cast("array<double>") if isinstance(record[c], list) else c for c in df.columns))
    c = {k: F.col(k) for k in df.columns}
    out = df.select(loss.value(c).alias("value"), *(g.alias(f"g_{k}") for k, g in loss.gradient(c, lam).items())).head()
    return out.value, {k[2:]: list(out[k]) for k in out.asDict() if k != "value"}


FACTORS = {"u": [0.3, 0.7], "v": [0.5, 0.2], "r": 0.6}
CASES = {
    "square": (cf.square(), FACTORS, 2.0),
    "log_square": (cf.log_square(), FACTORS, 2.0),
    "logistic": (cf.logistic(), FACTORS, 2.0),
    "poisson": (cf.poisson(), FACTORS, 1.0),
    "poisson_compat": (cf.poisson(compat=True), FACTORS, None),
    "bias": (cf.square_bias(), FACTORS | {"bu": [0.1], "bv": [0.2]}, 2.0),
    "regression": (cf.hybrid(factors=False), {"fu": [0.1, 0.9], "fv": [0.4, 0.3], "b": [0.1, 0.2, 0.3, 0.4], "r": 0.6}, 2.0),
    "hybrid": (cf.hybrid(), FACTORS | {"fu": [0.1, 0.9], "fv": [0.4, 0.3], "b": [0.1, 0.2, 0.3, 0.4]}, 2.0),
    "combine": (cf.hybrid(bias=True, rf=0.5, ru=0.7, ri=0.2), FACTORS | {"bu": [0.1], "bv": [0.2], "fu": [0.1, 0.9], "fv": [0.4, 0.3], "b": [0.1, 0.2, 0.3, 0.4]}, 2.0),
    "bpr": (cf.bpr(), {"u": [0.3, 0.7], "va": [0.5, 0.2], "vb": [0.1, 0.9], "r": 0.0}, -1.0),
    "tensor_cp": (cf.tensor_cp(), FACTORS | {"s": [0.9, 0.4]}, 2.0),
    "tensor_pair": (cf.tensor_pair(), FACTORS | {"s": [0.9, 0.4]}, 2.0),
}


@pytest.mark.parametrize("name", [n for n in CASES if CASES[n][2]])
def test_gradient_is_the_value_s_slope(spark, name):
    """Finite differences; squares' factor 2 is folded into the rate, and a preference's value is maximised."""
    loss, record, factor = CASES[name]
    _, g = gradients(spark, loss, record, lam=0.0)
    for role in loss.roles:
        for k in range(len(record[role])):
            moved = [dict(record, **{role: [x + (h if j == k else 0) for j, x in enumerate(record[role])]}) for h in (1e-5, -1e-5)]
            up, down = (gradients(spark, loss, m, 0.0)[0] for m in moved)
            assert (up - down) / 2e-5 == pytest.approx(factor * g[role][k], rel=1e-4, abs=1e-7), (role, k)


@pytest.mark.parametrize("name", [n for n in CASES if CASES[n][0].fold])
def test_numpy_gradients_are_the_same(spark, name):
    loss, record, _ = CASES[name]
    _, g = gradients(spark, loss, record)
    state = {k: np.array(x, float) for k, x in record.items() if isinstance(x, list)}
    for role, x in loss.fold(state, record["r"], 0.1).items():
        assert np.allclose(np.atleast_1d(x), g[role]), role


def test_temporal_context_is_drawn_to_its_forerunner(spark):
    s = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "id long, x array<double>")
    cells = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 1, 1.0)], "p long, q long, o long, r double")
    assert {r.o: list(r.s0) for r in cf.with_forerunner(cells, s, 2).collect()} == {0: [0.0, 0.0], 1: [1.0, 2.0]}


# ------------------------------------------------------------------------------------------------ models
def ratings(spark, n_u=8, n_i=6):
    return spark.createDataFrame([(u, i, ((u * 7 + i * 3) % 10) / 10 + 0.05) for u in range(n_u) for i in range(n_i) if (u + i) % 3], "u long, i long, r double")


@pytest.mark.parametrize("name", ["gaussian", "logistic", "bias"])
def test_loss_falls(spark, name):
    data = ratings(spark)
    model = models.MODELS[name](d=2, lr=0.3, lam=0.0)
    start = model.start(data)
    value = lambda p: cf.loss_metric(data, p, model.loss()).head().loss
    assert value(model.fit(data, 4, start)) < value(start)


def test_batch_step_shuffles_records_once_for_each_key(spark):
    """Factors and biases of a key are joined one after the other, and the item's gradients are summed where they were joined."""
    planned = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for name, value in planned.items():
        spark.conf.set(name, value)
    try:
        data, model = cf.settle(ratings(spark)), models.MODELS["bias"](d=2)
        params = {r: cf.settle(x) for r, x in model.start(data).items()}
        told = cf.gradients_by_key(data, params, model.loss(), {"u": 2, "v": 2, "bu": 1, "bv": 1}, 0.1)
        plan = told._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in planned:
            spark.conf.unset(name)
    assert len([x for x in plan.splitlines() if " Exchange hashpartitioning" in x]) <= 7  # at most: records by u and by i, four parameters, gradients by u


def test_one_rating_a_user_makes_both_solvers_agree_on_users(spark):
    data = spark.createDataFrame([(u, u % 3, 0.5) for u in range(5)], "u long, i long, r double")
    batch, fold = (models.MODELS["gaussian"](d=2, lr=0.1, solver=s).fit(data, 1) for s in ("batch", "sequential"))
    a, b = ({r.id: list(r.x) for r in p["u"].collect()} for p in (batch, fold))
    assert all(np.allclose(a[k], b[k]) for k in a)


def test_sequential_pass_streams_over_batches(spark):
    """A user of many records crosses batches; the result is the plain loop's."""
    data = spark.createDataFrame([(0, i, (i % 7) / 10) for i in range(2500)] + [(1, 3, 0.2)], "u long, i long, r double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        model = models.MODELS["gaussian"](d=2, lr=0.5, lam=0.01, solver="sequential")
        start = model.start(data)
        got = {r.id: np.array(r.x) for r in model.fit(data, 1, start)["u"].collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    u = {r.id: np.array(r.x) for r in start["u"].collect()}[0]
    v = {r.id: np.array(r.x) for r in start["v"].collect()}
    for i in range(2500):
        u = u - 0.5 / 2500 * ((u @ v[i] - (i % 7) / 10) * v[i] + 0.01 * u)
    assert np.allclose(got[0], u)


@pytest.mark.parametrize("kind", ["ratings", "preferences", "collective"])
def test_a_user_is_passed_once_when_joins_turn_into_broadcasts(spark, kind):
    """Joins planned as shuffles and broadcast at run time leave a user's records together."""
    data = ratings(spark, 30, 9).repartition(5).cache()
    pair = lambda key: data.select(F.col("u"), F.col("i").alias(key), "r")

    def run():
        if kind == "collective":
            out = models.Collective(d=2, lr=0.3, solver="sequential").fit(data, pair("s"), data.select("i", F.pmod("u", F.lit(9)).alias("s"), "r").distinct(), 1)
        else:
            out = models.MODELS["gaussian" if kind == "ratings" else "bpr"](d=2, lr=0.3, solver="sequential").fit(data, 1)
        return {r: sorted((x.id, *x.x) for x in out[r].collect()) for r in "uv"}

    want = run()
    planned = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in planned.items():
        spark.conf.set(name, value)
    try:
        got = run()
    finally:
        for name in planned:
            spark.conf.unset(name)
    assert {r: len(x) for r, x in got.items()} == {"u": 30, "v": 9} == {r: len(x) for r, x in want.items()}
    assert all(np.allclose(got[r], want[r]) for r in "uv")


def test_users_are_dealt_after_a_join_on_them(spark):
    """The shuffle that keeps a user together stands, though a join on the user has dealt the rows before."""
    planned = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for name, value in planned.items():
        spark.conf.set(name, value)
    try:
        joined = ratings(spark).join(spark.range(8).withColumnRenamed("id", "u"), "u")
        plan = cf.together(joined, "u").mapInPandas(lambda x: x, joined.schema)._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in planned:
            spark.conf.unset(name)
    assert "REPARTITION_BY_COL" in plan


def test_least_squares_of_many_ratings_of_one_item(spark, monkeypatch):
    """An item's ratings are dealt over parts if they are many; sums are the same, and no sums are shuffled for each rating."""
    monkeypatch.setattr(cf, "HOT", 3)
    test_least_squares_against_numpy(spark)
    data = ratings(spark)
    half = cf.als_half(data, models.MODELS["gaussian"](d=4).start(data)["u"], "i", "u", 4, 0.1)
    assert "REPARTITION_BY_COL" in half._jdf.queryExecution().executedPlan().toString()


def test_least_squares_against_numpy(spark):
    data, d = ratings(spark), 4
    model = models.MODELS["gaussian"](d=d, lam=0.1, solver="als")
    start = model.start(data)
    out = model.fit(data, 1, start)
    u0 = {r.id: np.array(r.x) for r in start["u"].collect()}
    rows = data.collect()
    for r in out["v"].collect():
        a = sum((np.outer(u0[x.u], u0[x.u]) for x in rows if x.i == r.id), 0.1 * np.eye(d))
        b = sum(x.r * u0[x.u] for x in rows if x.i == r.id)
        assert np.allclose(np.linalg.solve(a, b), r.x)


def test_predict_all_in_blocks(spark):
    data = ratings(spark)
    p = models.MODELS["bias"](d=3).start(data)
    scores = {(r.u, r.i): r.score for r in cf.predict_all(p["u"], p["v"], block=2).collect()}
    u, v = ({r.id: np.array(r.x) for r in p[k].collect()} for k in "uv")
    assert scores == pytest.approx({(a, b): u[a] @ v[b] for a in u for b in v})
    bias = {(r.u, r.i): r.score for r in cf.predict_all_bias(p).collect()}
    bv = {r.id: r.x[0] for r in p["bv"].collect()}
    assert bias == pytest.approx({(a, b): u[a] @ v[b] + bv[b] for a in u for b in v})


# ------------------------------------------------------------------------------------------------ neighbours
def test_similarities(spark):
    data = ratings(spark)
    for criterion in ("cosine", "pearson"):
        sims = {(r.a, r.b): r.sim for r in neighbours.similarities(data, criterion).collect()}
        assert all(sims[a, b] == sims[b, a] and abs(s) <= 1 + 1e-9 for (a, b), s in sims.items())


def test_zero_norm_and_variance_give_zero(spark):
    data = spark.createDataFrame([(0, 0, 0.0), (1, 0, 0.0), (0, 1, 0.0), (1, 1, 0.0)], "u long, i long, r double")
    for criterion in ("cosine", "pearson"):
        assert {r.sim for r in neighbours.similarities(data, criterion).collect()} == {0.0}


def test_neighbourhood_model(spark):
    data = ratings(spark)
    for base in (True, False):
        model = models.Neighbourhood(k=2, user_base=base)
        near = model.fit(data)
        assert near.groupBy("a").count().agg(F.max("count")).head()[0] <= 2
        assert model.predict_all(data, near).count() == 48
        assert model.predict_pairs(data, near, data.select("u", "i")).count() == data.count()


def many_meet(spark, kind):
    """40 users who share most of 20 items; ``few``: values of which many are alike."""
    value = {"wide": lambda u, i: ((u * 37 + i * 101) % 97) / 7 - 3, "few": lambda u, i: float((u * i) % 3 if u % 4 else 1)}[kind]
    return spark.createDataFrame([(u * 3, i, value(u, i)) for u in range(40) for i in range(20) if (u * 5 + i * 3) % 4], "u long, i long, r double")


@pytest.mark.parametrize("kind", ["wide", "few"])
@pytest.mark.parametrize("spare", [0, 75, 10**9])  # no column, some and all of them multiplied densely
def test_nearest_by_blocks_is_the_same(spark, monkeypatch, kind, spare):
    """No row for each pair is made, over several blocks and tiles, with the same neighbours, ranks and similarities."""
    data = many_meet(spark, kind)
    want = {c: sorted(map(tuple, neighbours.top_neighbours(neighbours.similarities(data, c), 4).collect())) for c in ("cosine", "pearson")}
    for name, value in {"ROWS": 5, "COLUMNS": 7, "DENSE": 3, "PAIRS": 10, "SPARE": spare}.items():
        monkeypatch.setattr(neighbours.tiles, name, value)
    monkeypatch.setattr(neighbours, "LEAST_ROWS", 16)
    monkeypatch.setattr(neighbours, "MEETINGS", 0)
    monkeypatch.setattr(neighbours, "similarities", None)  # would make a row for each pair
    for c, rows in want.items():
        got = sorted(map(tuple, neighbours.nearest(data, c, k=4).collect()))
        assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in rows]
        assert [x[2] for x in got] == pytest.approx([x[2] for x in rows], abs=2e-9)


def test_dense_predictions_find_neighbours_once(spark):
    """Scores and users are both had of the neighbours, which are costly."""
    found = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            found.add(batch.num_rows)
            yield batch

    data = cf.settle(many_meet(spark, "wide"))
    near = cf.settle(neighbours.nearest(data, k=4))
    out = neighbours.predict_all(near.mapInArrow(counted, near.schema), data).collect()
    assert len(out) == 40 * 20 and found.value == near.count()


def test_nearest_of_odd_ratings(spark):
    """Nulls, numbers that are none and ids of other types meet one by one, as before."""
    data = many_meet(spark, "wide")
    for odd in (data.withColumn("r", F.when(F.col("i") != 3, F.col("r"))), data.withColumn("u", F.concat(F.lit("u"), "u"))):
        want = neighbours.top_neighbours(neighbours.similarities(odd), 3)
        assert sorted(map(tuple, neighbours.nearest(odd, k=3).collect())) == sorted(map(tuple, want.collect()))


def shuffled_records(spark, run) -> int:
    """Records that all stages of ``run`` wrote into shuffles."""

    def written():
        store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, getattr(store, "stageList$default$4")(), jvm.java.util.ArrayList())
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteRecords() for k in range(stages.size())}

    spark.range(1).collect()
    time.sleep(1)  # the store hears of a stage's end a little later
    before = written()
    run()
    time.sleep(1)
    return sum(n for k, n in written().items() if k not in before)


def test_interests_walk_in_blocks_of_items(spark):
    """What goes over a link is a row for each block of items: 60 users, 64 items, 10 links each, two steps."""
    follow = cf.settle(edges(spark, *((u, (u * 7 + k * 11) % 60) for u in range(60) for k in range(10))))
    have = cf.settle(spark.createDataFrame([(u, i, float((u * i) % 9)) for u in range(60) for i in range(64)], "u long, i long, r double"))
    assert shuffled_records(spark, neighbours.relational(follow, have, 64, 2, 0.2).collect) < 2 * 60 * 64


@pytest.mark.parametrize("kind", ["whole", "words", "nulls"])
@pytest.mark.parametrize("sums", [1 << 20, 20])  # followers in one part, and in several
def test_interests_walk_as_items_do(spark, monkeypatch, kind, sums):
    """Against one row for each link and item: negative, far and null items, users without links, a rating that comes twice."""
    monkeypatch.setattr(neighbours, "SUMS", sums)
    follow = edges(spark, *((u, (u * 7 + k * 11) % 30) for u in range(25) for k in range(1 + u % 4)), (3, None), (None, 4))
    items = (-40, -1, 0, 5, 15, 16, 17, 10**12, None)
    rows = [(u, i, float(((u or 0) * 3 + k) % 7) - 1) for u in (*range(20), 77, None) for k, i in enumerate(items) if ((u or 0) + k) % 3] + [(1, 0, 2.5)]
    have = spark.createDataFrame(rows, "u long, i long, r double")
    if kind == "words":
        have = have.withColumn("i", F.concat(F.lit("w"), "i"))
    if kind == "nulls":
        have = have.withColumn("r", F.when(F.col("r") > 0, F.col("r")))
    links = follow.join(follow.groupBy("dst").agg(F.count("*").alias("n")), "dst")
    told = lambda df: sorted(((x.u, x.i, x.r) for x in df.collect()), key=repr)
    want, got = told(neighbours._walk_by_items(links, have, 9, 3, 0.2)), told(neighbours.relational(follow, have, 9, 3, 0.2))
    assert [x[:2] for x in got] == [x[:2] for x in want]
    for a, b in zip(got, want, strict=True):
        assert a[2] == pytest.approx(b[2], abs=1e-12) if b[2] is not None else a[2] is None


@pytest.mark.parametrize("compat", [False, True])
@pytest.mark.parametrize("block", [4, 2048])  # users of several blocks, and of one
def test_ratings_are_ranked_without_a_row_for_a_preference(spark, monkeypatch, block, compat):
    """Against the step over all preferences: ties, nulls, numbers that are none, a user and an item without a preference, ratings that come twice."""
    rows = [(u, i, float((u * 3 + i * 5) % 7)) for u in range(12) for i in range(9) if (u + i) % 4]
    rows += [(1, 3, 2.5), (2, 3, float("nan")), (2, 5, float("nan")), (3, 2, None), (50, 1, 1.0), (51, 70, 1.0), (None, 2, 1.0), (4, None, 9.0)]
    data = cf.settle(spark.createDataFrame(rows, "u long, i long, r double").where("u is not null and i is not null or r > 0"))
    model = models.MODELS["bpr"](d=3, lr=0.3, lam=0.1, compat=compat)
    start = model.start(data)
    want = model.fit(cf.settle(cf.preferences(data)), 2, start)
    monkeypatch.setattr(cf, "preferences", None)  # would make a row for each
    monkeypatch.setattr(pairs, "BLOCK", block)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # units go on over batches
    try:
        got = {role: {x.id: x.x for x in df.collect()} for role, df in model.fit(data, 2).items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got["v"] == got["va"] == got["vb"] and {50, 51} <= set(got["u"]) and 70 in got["v"]
    for role in ("u", "v"):
        rows = {x.id: x.x for x in want[role].collect()}
        assert set(got[role]) == set(rows)
        for key, x in rows.items():
            assert got[role][key] == (x if key is None else pytest.approx(x, abs=1e-12))


def test_preferences_are_strict(spark):
    data = spark.createDataFrame([(0, 1, 1.0), (0, 2, 2.0), (0, 3, 2.0)], "u long, i long, r double")
    assert sorted(map(tuple, cf.preferences(data).collect())) == [(0, 2, 1), (0, 3, 1)]


# ------------------------------------------------------------------------------------------------ matrices, files
def test_products_against_numpy(spark):
    a, b = np.arange(12.0).reshape(4, 3), np.arange(6.0).reshape(3, 2)
    frame = lambda m: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "id long, x array<double>")
    got = {(r.i, r.j): r.c for r in matrix.dense_dense(frame(a), frame(b)).collect()}
    assert got == {(i, j): (a @ b)[i, j] for i in range(4) for j in range(2)}
    got = {(r.i, r.j): r.c for r in matrix.transpose_times(frame(a), frame(a), 3).collect()}
    assert got == {(i, j): (a.T @ a)[i, j] for i in range(3) for j in range(3)}


def test_dense_ids_over_ranges(spark):
    ids = spark.createDataFrame([(x,) for x in (5, 1, 99, 5, 250, 3)], "id long")
    assert {r.id: r.ix for r in matrix.dense_ids(ids, "id", parts=3).collect()} == {1: 0, 3: 1, 5: 2, 99: 3, 250: 4}


def test_dense_ids_of_any_type_and_spread(spark):
    """Ids spread over 2**62 are dealt over all parts, and strings are numbered in order."""
    import random

    rng = random.Random(1)
    ids = sorted({rng.randrange(-(1 << 61), 1 << 61) for _ in range(2000)})
    frame = spark.createDataFrame([(i,) for i in [*ids, *ids[::7]]], "id long")
    assert sorted((r.ix, r.id) for r in matrix.dense_ids(frame, "id", parts=8).collect()) == list(enumerate(ids))
    words = sorted({f"w{rng.randrange(10**6)}" for _ in range(300)})
    frame = spark.createDataFrame([(w,) for w in words] + [(None,)], "id string")
    assert sorted((r.ix, r.id) for r in matrix.dense_ids(frame, "id", parts=4).collect()) == list(enumerate(words))


def test_pairs_of_a_hot_key_are_spread(spark, monkeypatch):
    """One key with a third of all rows: every pair once, over many tasks' keys."""
    monkeypatch.setattr(pairs, "BLOCK", 20)
    rows = [(0 if i % 3 == 0 else i, i) for i in range(600)]
    left, right = spark.createDataFrame(rows, "key long, a long"), spark.createDataFrame(rows, "key long, b long")
    got = sorted((r.key, r.a, r.b) for r in pairs.meet(left, right, "a < b").collect())
    hot = [i for k, i in rows if k == 0]
    assert got == sorted((0, a, b) for a in hot for b in hot if a < b)
    dealt = pairs._dealt(left, pairs._counted(left, right), "lo", "hi").where("key = 0").groupBy("lo", "hi").count().collect()
    assert len(dealt) == 100 and max(r["count"] for r in dealt) < 60
    r = spark.createDataFrame([(i % 40, i % 7, float(i % 5)) for i in range(280)], "u long, i long, r double")
    one = sorted((x.a, x.b, round(x.sim, 9)) for x in neighbours.similarities(r).collect())
    monkeypatch.setattr(pairs, "BLOCK", 10**9)
    assert one == sorted((x.a, x.b, round(x.sim, 9)) for x in neighbours.similarities(r).collect())


def test_correlation_of_close_ratings(spark):
    """Large numbers that differ little keep their correlation; alike ones have none."""
    r = [(u, i, 1e6 + (i * 0.001 if u < 2 else 0.0)) for u in range(3) for i in range(4)]
    got = {(x.a, x.b): x.sim for x in neighbours.similarities(spark.createDataFrame(r, "u long, i long, r double"), "pearson", 0.0).collect()}
    assert math.isclose(got[0, 1], 1.0, rel_tol=1e-6) and got[0, 2] == 0 and got[2, 1] == 0


def test_dense_product_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(matrix, "SIDE", 4)
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(11, 9)), rng.normal(size=(9, 10))
    left, right = (spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(m)], "id long, x array<double>") for m in (a, b))
    got = np.zeros((11, 10))
    for r in matrix.dense_dense(left, right).collect():
        got[r.i, r.j] += r.c
    assert np.allclose(got, a @ b)


def steps_of(monkeypatch, name):
    """Counts how often a function of the graph module is called."""
    counted = []
    real = getattr(graph, name)
    monkeypatch.setattr(graph, name, lambda *x: counted.append(1) or real(*x))
    return counted


def test_diameter_stops_early(spark, monkeypatch):
    counted = steps_of(monkeypatch, "sketch_step")
    star = edges(spark, *((i, 0) for i in range(1, 9)), *((0, i) for i in range(1, 9)))
    row = graph.effective_diameter(star, 50).head()
    assert row.diameter <= 3 and len(counted) <= 4
    n = [r.n for r in graph.neighbourhood(star, 3).orderBy("h").collect()]
    assert row.n == n[row.diameter]


def test_shortest_paths_stop_early(spark, monkeypatch):
    seen = []
    real = graph.iterate
    monkeypatch.setattr(graph, "iterate", lambda state, step, n, **k: real(state, lambda s, i: seen.append(i) or step(s, i), n, **k))
    got = {r.id: r.dist for r in graph.shortest_paths(edges(spark, *((i, i + 1) for i in range(4))), 0, 100).collect()}
    assert got == {i: float(i) for i in range(5)} and len(seen) == 5


def test_sums_of_gradients():
    sums = cf.Sums()
    for k in range(6):
        sums.add("v", k % 2, np.array([1.0, k]))
    assert sums.taken(2) == [] and sorted(sums.taken(1)) == [("v", 0, [3.0, 6.0], 3), ("v", 1, [3.0, 9.0], 3)] and not sums


def test_lines_that_do_not_parse_are_left_out(spark, tmp_path):
    lines = lambda *xs: spark.createDataFrame([(x,) for x in xs], "value string")
    assert [tuple(r) for r in text.parse_im(lines("1;2;1,0", "1;2;0,1", "a;2;1,0", "3;4", "")).collect()] == [(1, 2)]
    assert [tuple(r) for r in text.parse_userinfo(lines("x,12,1,,3", "x", "x,7")).collect()] == [(12, 0, "1"), (12, 2, "3")]
    (tmp_path / "r.csv").write_text("1,2,3.5\n1,3\nbad,4,1\n")
    assert sorted(map(tuple, text.read_ratings(spark, str(tmp_path / "r.csv")).collect())) == [(1, 2, 3.5), (1, 3, 0.0)]


def test_text_files(spark, tmp_path):
    m = spark.createDataFrame([(0, [1.0, 2.5]), (1, [-3.0, 4.0])], "id long, x array<double>")
    path = str(tmp_path / "m")
    text.write_matrix(m, path)
    text.append_matrix(m.where("id = 0"), path)
    assert sorted((r.id, list(r.x)) for r in text.read_matrix(spark, path).collect()) == [(0, [1.0, 2.5]), (0, [1.0, 2.5]), (1, [-3.0, 4.0])]
    text.merge_copy(spark, path, str(tmp_path / "one"))
    assert len([f for f in (tmp_path / "one").iterdir() if f.name.startswith("part")]) == 1
    assert m.select(text.joined_vector().alias("s")).head().s == "1.0,2.5"
    assert [tuple(r) for r in text.seed_row(spark, 7).collect()] == [(7, 0.0)]


def test_bits(spark):
    row = spark.range(1).select(vec.trailing_zeros(F.lit(40)).alias("a"), vec.lowest_zero(F.lit(0b10111)).alias("b")).head()
    assert (row.a, row.b) == (3, 3)
