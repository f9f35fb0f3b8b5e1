"""Matrix and tensor factorisation: losses, the batch step, the sequential per-user step, least squares, prediction.

A model is a set of parameter frames, one a role: factors (id, x array), biases (id, x array of one) and the
feature matrix B (id 0, x flattened by rows). Records carry the keys of their roles and the rating ``r``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grafmill.functions import vec
from grafmill.operators import pairs
from grafmill.operators.matrix import block_grid
from grafmill.operators.pairs import meet
from grafmill.plans.iterate import settle

FLOOR = 1e-12


# ---------------------------------------------------------------------------------------------- losses
@dataclass
class Loss:
    """``roles``: role -> key column of the records. Builders get the roles' columns by name, and ``r``."""

    roles: dict[str, str]
    predict: Callable[[dict], Column]
    value: Callable[[dict], Column]
    gradient: Callable[[dict, float], dict[str, Column]]
    #: The same gradients on numpy vectors, for the sequential step.
    fold: Callable[[dict, float, float], dict[str, np.ndarray]] | None = None
    #: Roles whose record gradients are averaged for each key of this column, the averages then added, or averaged if ``mean``.
    per: dict[str, str] = field(default_factory=dict)
    mean: bool = False
    #: Records that have a finite value; none if all have.
    where: Callable[[dict], Column] | None = None
    #: The number that all gradients of a record share: a column ``error``, computed once, where the builders find one.
    error: Callable[[dict], Column] | None = None


def _shared(error: Callable[[dict], Column]) -> Callable[[dict], Column]:
    return lambda c: c["error"] if "error" in c else error(c)


def _grow(err: Column, v: Column, u: Column, lam: float) -> Column:
    """err * v + lam * u."""
    return F.zip_with(v, u, lambda y, x: y * err + lam * x)


def square() -> Loss:
    p = lambda c: vec.dot(c["u"], c["v"])
    e = _shared(lambda c: p(c) - c["r"])
    g = lambda c, lam: {"u": _grow(e(c), c["v"], c["u"], lam), "v": _grow(e(c), c["u"], c["v"], lam)}

    def fold(c, r, lam):
        e = c["u"] @ c["v"] - r
        return {"u": e * c["v"] + lam * c["u"], "v": e * c["u"] + lam * c["v"]}

    return Loss({"u": "u", "v": "i"}, p, lambda c: (p(c) - c["r"]) ** 2, g, fold, error=e)


def log_square() -> Loss:
    """Records whose prediction is the rating itself have no finite value and are left out."""
    p = lambda c: vec.dot(c["u"], c["v"])
    e = _shared(lambda c: F.lit(1.0) / (p(c) - c["r"]))
    g = lambda c, lam: {"u": _grow(e(c), c["v"], c["u"], lam), "v": _grow(e(c), c["u"], c["v"], lam)}

    def fold(c, r, lam):
        d = c["u"] @ c["v"] - r
        if not d:
            return {"u": 0 * c["u"], "v": 0 * c["v"]}
        return {"u": c["v"] / d + lam * c["u"], "v": c["u"] / d + lam * c["v"]}

    return Loss({"u": "u", "v": "i"}, p, lambda c: F.ln((p(c) - c["r"]) ** 2), g, fold, where=lambda c: p(c) != c["r"], error=e)


def logistic(r0: float = 0.0, r1: float = 1.0) -> Loss:
    s = lambda c: vec.sigmoid(vec.dot(c["u"], c["v"]))
    target = lambda c: (c["r"] - r0) / (r1 - r0)
    e = _shared(lambda c: (s(c) - target(c)) * s(c) * (1 - s(c)))
    g = lambda c, lam: {"u": _grow(e(c), c["v"], c["u"], lam), "v": _grow(e(c), c["u"], c["v"], lam)}

    def fold(c, r, lam):
        x = 1 / (1 + np.exp(-(c["u"] @ c["v"])))
        k = (x - (r - r0) / (r1 - r0)) * x * (1 - x)
        return {"u": k * c["v"] + lam * c["u"], "v": k * c["u"] + lam * c["v"]}

    return Loss({"u": "u", "v": "i"}, lambda c: s(c) * (r1 - r0) + r0, lambda c: (s(c) - target(c)) ** 2, g, fold, error=e)


def poisson(compat: bool = False) -> Loss:
    """Value p - r ln p. ``compat``: the gradient v - r/u + lam*u, element by element."""
    p = lambda c: F.greatest(vec.dot(c["u"], c["v"]), F.lit(FLOOR))

    e = _shared(lambda c: 1 - c["r"] / p(c))

    def one(c, a, b, lam):
        if compat:
            return vec.axpy(F.zip_with(b, a, lambda y, x: y - c["r"] / x), lam, a)
        return _grow(e(c), b, a, lam)

    def fold(c, r, lam):
        if compat:
            return {"u": c["v"] - r / c["u"] + lam * c["u"], "v": c["u"] - r / c["v"] + lam * c["v"]}
        k = 1 - r / max(c["u"] @ c["v"], FLOOR)
        return {"u": k * c["v"] + lam * c["u"], "v": k * c["u"] + lam * c["v"]}

    return Loss({"u": "u", "v": "i"}, lambda c: vec.dot(c["u"], c["v"]), lambda c: p(c) - c["r"] * F.ln(p(c)), lambda c, lam: {"u": one(c, c["u"], c["v"], lam), "v": one(c, c["v"], c["u"], lam)}, fold, error=None if compat else e)


def square_bias() -> Loss:
    p = lambda c: vec.dot(c["u"], c["v"]) + c["bu"][0] + c["bv"][0]

    error = _shared(lambda c: p(c) - c["r"])

    def g(c, lam):
        e = error(c)
        return {"u": _grow(e, c["v"], c["u"], lam), "v": _grow(e, c["u"], c["v"], lam), "bu": F.array(e + lam * c["bu"][0]), "bv": F.array(e + lam * c["bv"][0])}

    def fold(c, r, lam):
        e = c["u"] @ c["v"] + c["bu"][0] + c["bv"][0] - r
        return {"u": e * c["v"] + lam * c["u"], "v": e * c["u"] + lam * c["v"], "bu": e + lam * c["bu"], "bv": e + lam * c["bv"]}

    return Loss({"u": "u", "v": "i", "bu": "u", "bv": "i"}, p, lambda c: (p(c) - c["r"]) ** 2, g, fold, error=error)


def hybrid(factors: bool = True, bias: bool = False, rf: float = 1.0, ru: float = 1.0, ri: float = 1.0) -> Loss:
    """Features: fuᵀ B fv, with factors, biases and weights as told. Without factors it is the regression loss."""
    roles = ({"u": "u", "v": "i"} if factors else {}) | ({"bu": "u", "bv": "i"} if bias else {}) | {"b": "zero"}

    def p(c):
        out = vec.bilinear(c["fu"], c["b"], c["fv"]) * rf
        if factors:
            out = out + vec.dot(c["u"], c["v"])
        if bias:
            out = out + c["bu"][0] * ru + c["bv"][0] * ri
        return out

    error = _shared(lambda c: p(c) - c["r"])

    def g(c, lam):
        e = error(c)
        out = {"b": _grow(e * rf, vec.outer(c["fu"], c["fv"]), c["b"], lam)}
        if factors:
            out |= {"u": _grow(e, c["v"], c["u"], lam), "v": _grow(e, c["u"], c["v"], lam)}
        if bias:
            out |= {"bu": F.array(e * ru + lam * c["bu"][0]), "bv": F.array(e * ri + lam * c["bv"][0])}
        return out

    def fold(c, r, lam):
        z = np.outer(c["fu"], c["fv"]).ravel()
        e = rf * (z @ c["b"]) - r
        if factors:
            e += c["u"] @ c["v"]
        if bias:
            e += ru * c["bu"][0] + ri * c["bv"][0]
        out = {"b": rf * e * z + lam * c["b"]}
        if factors:
            out |= {"u": e * c["v"] + lam * c["u"], "v": e * c["u"] + lam * c["v"]}
        if bias:
            out |= {"bu": ru * e + lam * c["bu"], "bv": ri * e + lam * c["bv"]}
        return out

    return Loss(roles, p, lambda c: (p(c) - c["r"]) ** 2, g, fold, per={"b": "i" if factors else "u"}, mean=not factors, error=error)


def bpr(compat: bool = False) -> Loss:
    """Pairwise preference a over b: -ln sigmoid(u·va - u·vb). ``compat`` keeps the sign that grows the parameters."""
    x = lambda c: vec.dot(c["u"], c["va"]) - vec.dot(c["u"], c["vb"])
    sign = -1.0 if compat else 1.0

    error = _shared(lambda c: vec.sigmoid(-x(c)))

    def g(c, lam):
        s = error(c)
        diff = F.zip_with(c["va"], c["vb"], lambda a, b: a - b)
        return {"u": vec.axpy(vec.scale(diff, -s), sign * lam, c["u"]), "va": vec.axpy(vec.scale(c["u"], -s), sign * lam, c["va"]), "vb": vec.axpy(vec.scale(c["u"], s), sign * lam, c["vb"])}

    def fold(c, r, lam):
        s = 1 / (1 + np.exp(c["u"] @ (c["va"] - c["vb"])))
        return {"u": -s * (c["va"] - c["vb"]) + sign * lam * c["u"], "va": -s * c["u"] + sign * lam * c["va"], "vb": s * c["u"] + sign * lam * c["vb"]}

    return Loss({"u": "u", "va": "a", "vb": "b"}, x, lambda c: F.ln(vec.sigmoid(x(c))), g, fold, error=error)


def tensor_cp(temporal: bool = False) -> Loss:
    """Sum of u*v*s. ``temporal``: s is drawn to its forerunner, the records' column ``s0`` (see ``with_forerunner``)."""
    p = lambda c: vec.total(vec.times(vec.times(c["u"], c["v"]), c["s"]))

    error = _shared(lambda c: p(c) - c["r"])

    def g(c, lam):
        e = error(c)
        held = F.zip_with(c["s"], c["s0"], lambda a, b: a - b) if temporal else c["s"]
        return {"u": _grow(e, vec.times(c["v"], c["s"]), c["u"], lam), "v": _grow(e, vec.times(c["u"], c["s"]), c["v"], lam), "s": _grow(e, vec.times(c["u"], c["v"]), held, lam)}

    return Loss({"u": "p", "v": "q", "s": "o"}, p, lambda c: (p(c) - c["r"]) ** 2, g, error=error)


def tensor_pair() -> Loss:
    p = lambda c: vec.dot(c["u"], c["v"]) + vec.dot(c["v"], c["s"]) + vec.dot(c["u"], c["s"])

    error = _shared(lambda c: p(c) - c["r"])

    def g(c, lam):
        e = error(c)
        return {"u": _grow(e, vec.add(c["v"], c["s"]), c["u"], lam), "v": _grow(e, vec.add(c["u"], c["s"]), c["v"], lam), "s": _grow(e, vec.add(c["u"], c["v"]), c["s"], lam)}

    return Loss({"u": "p", "v": "q", "s": "o"}, p, lambda c: (p(c) - c["r"]) ** 2, g, error=error)


def with_forerunner(records: DataFrame, s: DataFrame, d: int) -> DataFrame:
    """Records with ``s0``, the vector of context o - 1; zeros for the first context."""
    before = s.select((F.col("id") + 1).alias("o"), F.col("x").alias("s0"))
    return records.join(before, "o", "left").withColumn("s0", F.coalesce("s0", F.array_repeat(F.lit(0.0), d)))


# ---------------------------------------------------------------------------------------------- batch step
def with_parameters(records: DataFrame, params: dict[str, DataFrame], roles: dict[str, str]) -> DataFrame:
    """Records with each role's vector as a column ``<role>_x``; records without a parameter row drop out."""
    out = records.withColumn("zero", F.lit(0).cast("long")) if "zero" in roles.values() and "zero" not in records.columns else records
    for role, key in roles.items():
        side = params[role].select(F.col("id").alias(key), F.col("x").alias(f"{role}_x"))
        out = out.join(F.broadcast(side) if key == "zero" else side, key)  # zero: B, one row
    return out


def columns(df: DataFrame) -> dict[str, Column]:
    """What a loss is built of: roles' vectors by role, other columns by name."""
    return {c.removesuffix("_x"): F.col(c) for c in sorted(df.columns, key=lambda c: c.endswith("_x"))}


def with_error(joined: DataFrame, loss: Loss) -> DataFrame:
    """Records with the number that their gradients share: a gradient's elements would compute it anew, each of them."""
    return joined.withColumn("error", loss.error(columns(joined))) if loss.error is not None else joined


def batch_step(records: DataFrame, params: dict[str, DataFrame], loss: Loss, dims: dict[str, int], lr: float, lam: float, tie: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """One full-batch step: every record's gradient at the old parameters, averaged for each row, x - lr * average.

    ``tie``: roles that are one parameter frame (va and vb of a preference are both rows of V). Gradients of all roles come
    from one pass over the records and meet in one shuffle, combined before it; the result is computed here, as one table.
    """
    if not tie and not loss.per:
        return dict(params) | moved_by({r: params[r] for r in loss.roles}, gradients_by_key(records, params, loss, dims, lam), lr)
    joined = with_parameters(records, params, loss.roles)
    if loss.where is not None:
        joined = joined.where(loss.where(columns(joined)))
    joined = with_error(joined, loss)
    grads = loss.gradient(columns(joined), lam)
    name = {r: (tie or {}).get(r, r) for r in loss.roles}
    each = [F.struct(F.lit(name[r]).alias("role"), F.col(key).alias("id"), grads[r].alias("g")) for r, key in loss.roles.items() if r not in loss.per]
    mean = None
    if each:
        mean = mean_gradients(joined.select(F.explode(F.array(*each)).alias("one")).select("one.*"), max(dims[r] for r in loss.roles if r not in loss.per))
    for r, per in loss.per.items():
        d = dims[r]
        inner = joined.select(F.col(loss.roles[r]).alias("id"), F.col(per).alias("per"), grads[r].alias("g")).groupBy("id", "per").agg(vec.vavg("g", d).alias("g"))
        own = inner.groupBy("id").agg((vec.vavg if loss.mean else vec.vsum)("g", d).alias("g")).select(F.lit(name[r]).alias("role"), "id", "g")
        mean = own if mean is None else mean.unionByName(own)
    new = moved_by({n: params[r] for r, n in name.items()}, mean, lr)
    return dict(params) | {r: new[n] for r, n in name.items()} | {n: new[n] for n in name.values() if n in params}


def gradients_by_key(records: DataFrame, params: dict[str, DataFrame], loss: Loss, dims: dict[str, int], lam: float) -> DataFrame:
    """(role, id, g): mean gradients, from one sum for each key column.

    Roles of one key are joined one after the other, so records are shuffled once for each key, with numbers in the place of arrays; what belongs to the
    key joined last is summed where it was joined, without a shuffle.
    """
    keys: dict[str, list[str]] = {}
    for role, key in loss.roles.items():
        keys.setdefault(key, []).append(role)
    joined = records
    for key, roles in keys.items():
        for r in roles:
            joined = joined.join(params[r].select(F.col("id").alias(key), *(F.get("x", F.lit(k)).alias(f"{r}_{k}") for k in range(dims[r]))), key)
    joined = joined.select(*records.columns, *(F.array(*(F.col(f"{r}_{k}") for k in range(dims[r]))).alias(f"{r}_x") for r in loss.roles))
    if loss.where is not None:
        joined = joined.where(loss.where(columns(joined)))
    joined = with_error(joined, loss)
    grads, out, before = loss.gradient(columns(joined), lam), None, []
    for key, roles in keys.items():
        # the keys joined before are asked for in each sum: with the same columns, all sums read the same shuffles
        each = joined.select(F.col(key).alias("id"), F.concat(*(grads[r] for r in roles)).alias("g"), *([F.xxhash64(*before).alias("seen")] if before else []))
        n = F.count(F.get("g", F.lit(0)))
        width = sum(dims[r] for r in roles)
        sums = each.groupBy("id").agg(F.array(*(F.sum(F.get("g", F.lit(k))) / n for k in range(width))).alias("g"), *([F.max("seen").alias("seen")] if before else []))
        if before:
            sums = sums.where("seen is not null")
        at, parts = 1, []
        for r in roles:
            parts.append(F.struct(F.lit(r).alias("role"), "id", F.slice("g", at, dims[r]).alias("g")))
            at += dims[r]
        one = sums.select(F.explode(F.array(*parts)).alias("one")).select("one.*")
        out = one if out is None else out.unionByName(one)
        before.append(key)
    return out


def mean_gradients(gradients: DataFrame, width: int) -> DataFrame:
    """(role, id, g) of many records -> their mean for each row; arrays shorter than ``width`` end in nulls."""
    return gradients.groupBy("role", "id").agg(F.array(*(F.avg(F.get("g", F.lit(k))) for k in range(width))).alias("g"))


def moved_by(params: dict[str, DataFrame], mean: DataFrame, lr: float) -> dict[str, DataFrame]:
    """Parameter frames after x - lr * g, for rows that have a g (role, id, g). One table, computed here, serves all."""
    old = None
    for name, df in params.items():
        one = df.select(F.lit(name).alias("role"), "id", "x")
        old = one if old is None else old.unionByName(one)
    step = vec.axpy(F.col("x"), -lr, F.slice("g", 1, F.size("x")))
    new = settle(old.join(mean, ["role", "id"], "left").select("role", "id", F.when(F.col("g").isNull(), F.col("x")).otherwise(step).alias("x")))
    return {name: new.where(F.col("role") == name).select("id", "x") for name in params}


#: Gradients of items that a task holds before it adds those of an item together.
ADDED = 200_000


def ranked_step(ratings: DataFrame, params: dict[str, DataFrame], dims: dict[str, int], lr: float, lam: float, compat: bool = False) -> dict[str, DataFrame]:
    """The batch step of ``bpr`` over all preferences of ratings (u, i, r), with no row for a preference: (u, v).

    A user's ratings come together and their preferences are a matrix, of which sums by row and column are what the gradients need. A user
    of more ratings than a block is cut into pairs of blocks, as ``pairs.meet`` does, so one with very many is spread over tasks.
    """
    d, sign = dims["u"], -1.0 if compat else 1.0
    each = lambda role: [F.get("x", F.lit(k)).alias(f"{role}_{k}") for k in range(d)]
    rated = ratings.select("u", "i", F.col("r").cast("double").alias("r")).where("r is not null")
    rated = rated.join(params["v"].select(F.col("id").alias("i"), *each("v")), "i")
    large = rated.groupBy("u").agg(F.ceil(F.count("*") / pairs.BLOCK).cast("long").alias("blocks")).where("blocks > 1")
    rated = rated.join(params["u"].select(F.col("id").alias("u"), *each("u")), "u").join(large, "u", "left")
    own, others = F.pmod(F.xxhash64("i", "r"), F.coalesce("blocks", F.lit(1).cast("long"))), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    unit = lambda lo, hi, side: F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(side).alias("side"))
    zero = F.lit(0).cast("long")
    copies = F.concat(F.transform(others, lambda o: unit(own, o, 0)), F.transform(others, lambda o: unit(o, own, 1)))  # preferred, and not
    rated = rated.withColumn("unit", F.explode(F.when(F.col("blocks").isNull(), F.array(unit(zero, zero, 2))).otherwise(copies)))
    rated = rated.select(F.col("u").cast("long").alias("u"), "unit.*", F.col("i").cast("long").alias("i"), "r", *(f"{role}_{k}" for role in "uv" for k in range(d)))

    def told(role: str, ids: np.ndarray, x: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * d, pa.int32()), pa.array(np.ascontiguousarray(x, float).ravel()))
        return pa.RecordBatch.from_arrays([pa.array([role] * len(ids), pa.string()), pa.array(ids, pa.int64()), lists, pa.array(n, pa.int64())], names=TOLD)

    def added(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, x, n = (np.concatenate(y) for y in zip(*parts, strict=True))
        ids, at = np.unique(ids, return_inverse=True)
        return ids, np.stack([np.bincount(at, x[:, k], len(ids)) for k in range(d)], 1), np.bincount(at, n, len(ids)).astype(np.int64)

    def gradients(side, i, r, u, v):
        """Of one unit: sum and number for the user, and for items (ids, sums, numbers)."""
        if np.isnan(r).any():
            r = np.unique(r, return_inverse=True)[1]  # a number that is none is above all others, as in SQL
        up, low = side != 1, side != 0
        above, score = r[up][:, None] > r[low], v @ u
        with np.errstate(over="ignore"):
            s = above / (1 + np.exp(score[up][:, None] - score[low]))
        weight, n = np.zeros(len(i)), np.zeros(len(i), np.int64)
        weight[up] -= s.sum(1)
        weight[low] += s.sum(0)
        n[up] += above.sum(1)
        n[low] += above.sum(0)
        total, met = int(above.sum()), n > 0
        return weight @ v + total * sign * lam * u, total, (i[met], weight[met, None] * u + (n[met] * sign * lam)[:, None] * v[met], n[met])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, items, size = None, [], 0

        def passed(cols: list[np.ndarray], bounds: np.ndarray) -> pa.RecordBatch:
            nonlocal items, size
            ids, sums, numbers = [], [], []
            us, vs = np.stack(cols[6 : 6 + d], 1), np.stack(cols[6 + d :], 1)
            for first, last in zip(bounds[:-1], bounds[1:], strict=True):
                g, n, one = gradients(cols[3][first:last], cols[4][first:last], cols[5][first:last], us[first], vs[first:last])
                if n:
                    ids.append(cols[0][first])
                    sums.append(g)
                    numbers.append(n)
                    items.append(one)
                    size += len(one[0])
            return told("u", np.array(ids, np.int64), np.array(sums), np.array(numbers, np.int64))

        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)) + 1
            if len(new):
                yield passed(cols, np.r_[0, new])
            held = [c[new[-1] if len(new) else 0 :] for c in cols]  # the last unit may go on
            if size > ADDED:
                items = [added(items)]
                if len(items[0][0]) > HELD:
                    yield told("v", *items[0])
                    items = []
                size = sum(len(x[0]) for x in items)
        if held is not None:
            yield passed(held, np.array([0, len(held[0])]))
        if items:
            yield told("v", *added(items))

    units = rated.repartition(F.xxhash64("u", "lo", "hi")).sortWithinPartitions("u", "lo", "hi")
    mean = units.mapInArrow(run, TOLD_TYPES).groupBy("role", "id").agg(F.array(*(F.sum(F.get("x", F.lit(k))) / F.sum("n") for k in range(d))).alias("g"))
    new = moved_by({"u": params["u"], "v": params["v"]}, mean, lr)
    return dict(params) | new | {"va": new["v"], "vb": new["v"]}


def loss_metric(records: DataFrame, params: dict[str, DataFrame], loss: Loss) -> DataFrame:
    """(loss, thousandths, cnt): sum of values, sum of values cut to whole thousandths, number of records."""
    joined = with_parameters(records, params, loss.roles)
    if loss.where is not None:
        joined = joined.where(loss.where(columns(joined)))
    value = loss.value(columns(joined))
    return joined.agg(F.sum(value).alias("loss"), F.sum((value * 1000).cast("long")).alias("thousandths"), F.count("*").alias("cnt"))


def collective_step(frames: list[tuple[DataFrame, str, str, float]], params: dict[str, DataFrame], d: int, lr: float, lam: float) -> dict[str, DataFrame]:
    """Several matrices sharing factors: (records (a, b, r), left role, right role, weight); one average a row over all."""
    loss, parts = square(), None
    for records, left, right, weight in frames:
        joined = with_parameters(records.select(F.col("a").alias("u"), F.col("b").alias("i"), "r"), {"u": params[left], "v": params[right]}, {"u": "u", "v": "i"})
        joined = with_error(joined, loss)
        g = loss.gradient(columns(joined), lam)
        both = F.array(*(F.struct(F.lit(role).alias("role"), F.col(key).alias("id"), vec.scale(g[name], weight).alias("g")) for role, key, name in ((left, "u", "u"), (right, "i", "v"))))
        one = joined.select(F.explode(both).alias("one")).select("one.*")
        parts = one if parts is None else parts.unionByName(one)
    return moved_by(params, mean_gradients(parts, d), lr)


# ---------------------------------------------------------------------------------------------- sequential step
#: What is updated inside the fold, in order; each later gradient sees the earlier updates. None: all at the old state.
ORDERS = {
    "gaussian": (("u",), ("v",)),
    "bias": (("u",), ("v",), ("bu",), ("bv",)),
    "together": None,
}


def fold_step(records: DataFrame, params: dict[str, DataFrame], loss: Loss, own: list[str], order: str, lr: float, lam: float, sort: list[str]) -> dict[str, DataFrame]:
    """One pass of sequential descent: each user's records in order of ``sort``; roles in ``own`` belong to the user and
    move with every record by lr / n, the others' gradients are averaged over all records and applied at the end.

    Users run in parallel. One user's pass is sequential by definition, but streams: records come sorted within
    their partition and only the user's state is held, so a user with very many records needs no more memory.
    B (role ``b``) is averaged within each user first, then over users.
    """
    user = loss.roles[own[0]]
    counts = records.groupBy(user).agg(F.count("*").alias("n_own"))
    joined = with_parameters(records, params, loss.roles).join(counts, user)
    others = [r for r in loss.roles if r not in own]
    extra = [c for c in ("fu", "fv") if c in joined.columns]
    steps = ORDERS[order]

    def one(row: dict, state: dict) -> dict[str, np.ndarray]:
        """Gradients of one record; ``state`` moves."""
        c = {k: np.asarray(row[f"{k}_x"], float) for k in others} | {k: np.asarray(row[k], float) for k in extra}
        n, r, g = row["n_own"], row.get("r"), {}
        for group in steps or (tuple(loss.roles),):
            now = loss.fold(c | state, r, lam)
            g |= {k: now[k] for k in group}
            state |= {k: state[k] - lr / n * now[k] for k in group if k in own}
        return g

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []  # role, id, sum, how many
        sums = Sums()
        now, state, b_mean = None, {}, None

        def leave() -> None:
            if state:
                rows.extend((r, now, np.atleast_1d(state[r]).tolist(), 1) for r in own)
                if b_mean is not None:
                    sums.add("b", 0, b_mean)

        for pdf in batches:
            names = list(pdf.columns)
            for values in zip(*(pdf[c].tolist() for c in names), strict=True):
                row = dict(zip(names, values, strict=True))
                if not state or row[user] != now:
                    leave()
                    now, b_mean = row[user], None
                    state = {r: np.array(row[f"{r}_x"], float) for r in own}
                g = one(row, state)
                for r in others:
                    if r == "b":
                        part = g["b"] / row["n_own"]
                        b_mean = part if b_mean is None else b_mean + part
                    else:
                        sums.add(r, int(row[loss.roles[r]]), g[r])
            yield pd.DataFrame(rows + sums.taken(HELD), columns=TOLD)
            rows.clear()
        leave()
        yield pd.DataFrame(rows + sums.taken(0), columns=TOLD)

    told = settle(together(joined, user).sortWithinPartitions(user, *sort).mapInPandas(run, TOLD_TYPES))
    out = dict(params)
    for r in own:
        out[r] = _replaced(params[r], told.where(F.col("role") == r))
    shared = {"va": "v", "vb": "v"}
    for name in dict.fromkeys(shared.get(r, r) for r in others):
        roles = [r for r in others if shared.get(r, r) == name]
        new = _moved(params[roles[0]], told.where(F.col("role").isin(roles)), lr)
        out |= dict.fromkeys(roles, new)
    return out


def together(rows: DataFrame, key: str) -> DataFrame:
    """Rows with all of a key in one partition. Dealt by the key itself, the shuffle would be left out after a join on it, and with
    it the partitions: the join's own shuffle is read as its tasks wrote it once adaptive execution turns that join into a broadcast."""
    return rows.repartition(F.xxhash64(key))


#: Gradients are summed for each (role, id) in their task; so many sums are held before they are passed on.
HELD = 50_000
TOLD, TOLD_TYPES = ["role", "id", "x", "n"], "role string, id long, x array<double>, n long"


class Sums(dict):
    """(role, id) -> [sum of vectors, how many]."""

    def add(self, role: str, key: int, x: np.ndarray) -> None:
        held = self.get((role, key))
        if held is None:
            self[role, key] = [np.array(x, float), 1]
        else:
            held[0] += x
            held[1] += 1

    def taken(self, more_than: int) -> list[tuple]:
        """All rows, and nothing is held any more, if there are more than so many."""
        if len(self) <= more_than:
            return []
        out = [(role, key, np.atleast_1d(x).tolist(), n) for (role, key), (x, n) in self.items()]
        self.clear()
        return out


def _replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.select("id", F.col("x").alias("new")), "id", "left").select("id", F.coalesce("new", "x").alias("x"))


def _moved(old: DataFrame, gradients: DataFrame, lr: float) -> DataFrame:
    """``old`` - lr * mean gradient, from sums (id, x, n); rows without gradients stay."""
    row = old.select(F.size("x").alias("d")).head()
    mean = gradients.groupBy("id").agg(F.array(*(F.sum(F.col("x")[k]) / F.sum("n") for k in range(row.d if row else 1))).alias("g"))
    return old.join(mean, "id", "left").select("id", F.when(F.col("g").isNull(), F.col("x")).otherwise(vec.axpy(F.col("x"), -lr, F.col("g"))).alias("x"))


def collective_fold_step(mu: DataFrame, ms: DataFrame, mv: DataFrame, params: dict[str, DataFrame], lr: float, lam: float, lam_s: float, lam_v: float) -> dict[str, DataFrame]:
    """Sequential step of three matrices (a, b, r) that share u, v and s: a user moves through ratings of ``mu``, then ``ms``.

    Gradients of v and s are taken at the user's state before each record; those of ``mv`` at the old v and s.
    """
    side = lambda df, k, role, weight: df.join(df.groupBy("a").agg(F.count("*").alias("n")), "a").join(params[role].select(F.col("id").alias("b"), F.col("x").alias("y")), "b").select("a", F.lit(k).alias("k"), "b", "r", "n", "y", F.lit(float(weight)).alias("weight"))
    records = side(mu, 0, "v", 1.0).unionByName(side(ms, 1, "s", lam_s)).join(params["u"].select(F.col("id").alias("a"), "x"), "a")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, u = None, None
        sums = Sums()
        for pdf in batches:
            rows: list[tuple] = []
            for row in pdf.itertuples():
                if u is None or row.a != now:
                    if u is not None:
                        rows.append(("u", now, u.tolist(), 1))
                    now, u = row.a, np.array(row.x, float)
                y = np.asarray(row.y, float)
                e = u @ y - row.r
                sums.add("vs"[row.k], row.b, row.weight * (e * u + lam * y))
                u = u - lr / row.n * row.weight * (e * y + lam * u)
            yield pd.DataFrame(rows + sums.taken(HELD), columns=TOLD)
        last = [("u", now, u.tolist(), 1)] if u is not None else []
        yield pd.DataFrame(last + sums.taken(0), columns=TOLD)

    told = settle(together(records, "a").sortWithinPartitions("a", "k", "b").mapInPandas(run, TOLD_TYPES))
    both = with_parameters(mv.select(F.col("a").alias("i"), F.col("b").alias("c"), "r"), {"v": params["v"], "s": params["s"]}, {"v": "i", "s": "c"})
    e = vec.dot(F.col("v_x"), F.col("s_x")) - F.col("r")
    g = lambda role, key, x, y: both.select(F.lit(role).alias("role"), F.col(key).alias("id"), vec.scale(_grow(e, F.col(y), F.col(x), lam), lam_v).alias("x"), F.lit(1).cast("long").alias("n"))
    gradients = told.where("role <> 'u'").unionByName(g("v", "i", "v_x", "s_x")).unionByName(g("s", "c", "s_x", "v_x"))
    return {"u": _replaced(params["u"], told.where("role = 'u'")), "v": _moved(params["v"], gradients.where("role = 'v'"), lr), "s": _moved(params["s"], gradients.where("role = 's'"), lr)}


# ---------------------------------------------------------------------------------------------- least squares
@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve(a: pd.Series, b: pd.Series) -> pd.Series:
    right, upper = np.stack(b.to_list()), np.stack(a.to_list())
    d = right.shape[1]
    rows, columns = np.triu_indices(d)
    left = np.empty((len(right), d, d))
    left[:, rows, columns] = left[:, columns, rows] = upper
    return pd.Series(list(np.linalg.solve(left, right[:, :, None])[:, :, 0]))


#: Ratings of a row that one part sums.
HOT = 65_536


def als_half(ratings: DataFrame, factors: DataFrame, key: str, other: str, d: int, lam: float) -> DataFrame:
    """(id, x) of ``key`` from the other side's factors: (sum v vᵀ + lam I)^-1 sum r v; lam is not scaled by counts.

    Sums are of the upper triangle alone; solving runs on batches of small systems. Where a row's sums are wider than what a rating
    brings to them (d above 3) ratings are shuffled with their vectors and summed after it, those of a row with very many in parts.
    """
    v = [F.col(f"v{k}") for k in range(d)]
    sums = {f"a{j}_{k}": F.sum(v[j] * v[k]) for j in range(d) for k in range(j, d)} | {f"b{k}": F.sum(F.col("r") * v[k]) for k in range(d)}
    factors = factors.select(F.col("id").alias(other), *(F.col("x")[k].alias(f"v{k}") for k in range(d)))
    if d > 3:
        hot = ratings.groupBy(key).agg(F.ceil(F.count("*") / HOT).cast("long").alias("parts")).where("parts > 1")  # a row for each HOT ratings at most
        part = F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1).cast("long")))
        ratings = ratings.select(key, other, "r").join(F.broadcast(hot), key, "left").select(key, other, "r", part.alias("part"))
        each = ratings.join(factors, other).select(F.col(key).alias("id"), "part", "r", *v).repartition("id", "part").groupBy("id", "part").agg(*(e.alias(n) for n, e in sums.items()))
        summed = each.groupBy("id").agg(*(F.sum(n).alias(n) for n in sums))
    else:
        summed = ratings.join(factors, other).groupBy(F.col(key).alias("id")).agg(*(e.alias(n) for n, e in sums.items()))
    left = F.array(*(F.col(f"a{j}_{k}") + (lam if j == k else 0.0) for j in range(d) for k in range(j, d)))
    return summed.select("id", left.alias("a"), F.array(*(F.col(f"b{k}") for k in range(d))).alias("b")).select("id", _solve("a", "b").alias("x"))


def als_step(ratings: DataFrame, u: DataFrame, d: int, lam: float) -> tuple[DataFrame, DataFrame]:
    """V from U, then U from the new V."""
    v = als_half(ratings, u, "i", "u", d, lam)
    return als_half(ratings, v, "u", "i", d, lam), v


def multiplicative_half(ratings: DataFrame, own: DataFrame, other: DataFrame, key: str, other_key: str, d: int, lam: float) -> DataFrame:
    """own * X / Y with X = sum r v and Y = (sum over all rows of v vᵀ + lam I) own: experimental."""
    v = F.col("v")
    x = ratings.join(other.select(F.col("id").alias(other_key), F.col("x").alias("v")), other_key).groupBy(F.col(key).alias("id")).agg(F.array(*(F.sum(F.col("r") * v[k]) for k in range(d))).alias("sum"))
    gram = other.agg(F.array(*(F.sum(F.col("x")[j] * F.col("x")[k]) + (lam if j == k else 0.0) for j in range(d) for k in range(d))).alias("s"))  # one row
    both = own.join(x, "id", "left").join(F.broadcast(gram))
    new = lambda k: F.col("x")[k] * F.col("sum")[k] / sum((F.col("s")[k * d + j] * F.col("x")[j] for j in range(1, d)), F.col("s")[k * d] * F.col("x")[0])
    return both.select("id", F.when(F.col("sum").isNull(), F.col("x")).otherwise(F.array(*map(new, range(d)))).alias("x"))


# ---------------------------------------------------------------------------------------------- prediction
def predict_pairs(pairs: DataFrame, params: dict[str, DataFrame], loss: Loss) -> DataFrame:
    """Pairs with ``score``: equi-joins, the engine picks broadcast or shuffle by size."""
    joined = with_parameters(pairs, params, loss.roles)
    return joined.select(*pairs.columns, loss.predict(columns(joined)).alias("score"))


def predict_all(u: DataFrame, v: DataFrame, block: int = 4096, users: int = 1024) -> DataFrame:
    """(u, i, score) of every user and item. Both come in blocks; each block of users meets each of items once and they are
    multiplied as matrices, so no row pairs are joined one by one."""
    met = block_grid(u.select("id", "x"), "id", users, v.select("id", "x"), "id", block)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for left, right in zip(pdf["left"], pdf["right"], strict=True):
                items, m = np.array([r["id"] for r in right]), np.stack([r["x"] for r in right])
                for at in range(0, len(left), 64):  # as many scores at once as 64 users have
                    some = left[at : at + 64]
                    scores = np.stack([r["x"] for r in some]) @ m.T
                    yield pd.DataFrame({"u": np.repeat([r["id"] for r in some], len(items)), "i": np.tile(items, len(some)), "score": scores.ravel()})

    return met.mapInPandas(run, "u long, i long, score double")


def predict_all_bias(params: dict[str, DataFrame]) -> DataFrame:
    """(u, i, score) with biases: they ride along as two more factors, (x, bu, 1) and (x, 1, bv)."""
    wide = lambda role, bias, own: params[role].join(params[bias].select("id", F.col("x")[0].alias("b")), "id").select("id", F.concat("x", F.array(*(F.col("b"), F.lit(1.0)) if own else (F.lit(1.0), F.col("b")))).alias("x"))
    return predict_all(wide("u", "bu", True), wide("v", "bv", False))


def starting(ids: DataFrame, key: str, seed: int, d: int, divide: bool = True) -> DataFrame:
    """Deterministic factors for the distinct ids of a column: (id, x)."""
    return ids.select(F.col(key).alias("id")).distinct().select("id", vec.init("id", seed, d, divide).alias("x"))


def random_start(ids: DataFrame, key: str, seed: int, d: int) -> DataFrame:
    """Random factors in [0, 1) / d for the distinct ids of a column: (id, x)."""
    return ids.select(F.col(key).alias("id")).distinct().select("id", F.array(*(F.rand(seed + k) / d for k in range(d))).alias("x"))


def item_bias(ratings: DataFrame, key: str = "i") -> DataFrame:
    """(id, x): mean rating."""
    return ratings.groupBy(F.col(key).alias("id")).agg(F.array(F.avg("r")).alias("x"))


def zero_bias(ratings: DataFrame, key: str = "u") -> DataFrame:
    return ratings.select(F.col(key).alias("id")).distinct().select("id", F.array(F.lit(0.0)).alias("x"))


def preferences(ratings: DataFrame) -> DataFrame:
    """(u, a, b): the user rates a above b. A user's ratings meet in pairs of blocks, so one with very many is spread over tasks."""
    x = ratings.select(F.col("u").alias("key"), F.col("i").alias("a"), F.col("r").alias("ra"))
    y = ratings.select(F.col("u").alias("key"), F.col("i").alias("b"), F.col("r").alias("rb"))
    return meet(x, y, "ra > rb").select(F.col("key").alias("u"), "a", "b")
