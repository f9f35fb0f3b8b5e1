"""Most similar rows of two blocks of ratings, from products of matrices; numpy alone, in tiles of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Rows of a tile, of the one side and the other; columns of a dense piece; pairs of entries expanded at once.
ROWS, COLUMNS, DENSE, PAIRS = 512, 1024, 1024, 1 << 21
#: A column is multiplied densely unless its pairs of entries are so many times fewer than a tile's cells.
SPARE = 75


@dataclass
class Block:
    """Ratings of whole rows: ``ids`` in order; of each entry its row, its key and its value."""

    ids: np.ndarray
    at: np.ndarray
    key: np.ndarray
    r: np.ndarray

    def part(self, first: int, last: int) -> Block:
        """Rows from ``first`` up to ``last``."""
        lo, hi = np.searchsorted(self.at, (first, last))
        return Block(self.ids[first:last], self.at[lo:hi] - first, self.key[lo:hi], self.r[lo:hi])


def block(entries: pa.StructArray, centred: bool) -> Block:
    """Of (own, via, r); ``centred``: values less their row's mean."""
    own, key, r = (entries.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    order = np.argsort(own, kind="stable")
    own, key, r = own[order], key[order], r[order].astype(float)
    ids, at = np.unique(own, return_inverse=True)
    if centred:
        r = r - (np.bincount(at, r) / np.bincount(at))[at]
    return Block(ids, at, key, r)


def _ranks(b: Block) -> np.ndarray:
    """Of each entry, the rank of its value in its row, alike for values alike: whole numbers, so that their sums are exact."""
    order = np.lexsort((b.r, b.at))
    at, r = b.at[order], b.r[order]
    new = np.r_[False, (at[1:] != at[:-1]) | (r[1:] != r[:-1])].cumsum()
    first = new[np.searchsorted(at, at)]
    out = np.empty(len(r))
    out[order] = new - first
    return out


def _met(a: np.ndarray, b: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of the entries of two sides that share a column; ``count``: entries of b in each column."""
    order = np.argsort(b, kind="stable")
    first = np.cumsum(count) - count
    times = count[a]
    ends = np.cumsum(times)
    at = 0
    while at < len(a):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
        n = times[at:to]
        one = np.repeat(np.arange(at, to), n)
        yield one, order[np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[a[at:to]], n)]
        at = to


def crossed(a: Block, b: Block, wanted: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
    """For each name (x, y), weights of the entries of a and b: sums of x * y over shared keys, a's rows by b's."""
    m, n = len(a.ids), len(b.ids)
    keys = np.intersect1d(a.key, b.key)
    out = {name: np.zeros((m, n)) for name in wanted}
    if not len(keys):
        return out
    inside = [np.isin(s.key, keys) for s in (a, b)]
    col = [np.searchsorted(keys, s.key[i]) for s, i in zip((a, b), inside, strict=True)]
    row = [s.at[i] for s, i in zip((a, b), inside, strict=True)]
    cut = [{id(w): w[i] for w in {id(p[side]): p[side] for p in wanted.values()}.values()} for side, i in enumerate(inside)]  # each array once
    weights = {name: (cut[0][id(x)], cut[1][id(y)]) for name, (x, y) in wanted.items()}
    count = [np.bincount(c, minlength=len(keys)) for c in col]
    dense = count[0] * count[1] * SPARE >= m * n
    place = np.cumsum(dense) - 1
    for first in range(0, int(dense.sum()), DENSE):
        width = min(DENSE, int(dense.sum()) - first)
        here = dense & (place >= first) & (place < first + width)
        made: dict[tuple[int, int], np.ndarray] = {}

        def matrix(side: int, w: np.ndarray, rows: int) -> np.ndarray:
            if (side, id(w)) not in made:
                some = here[col[side]]  # noqa: B023 (used at once)
                made[side, id(w)] = np.bincount(row[side][some] * width + place[col[side][some]] - first, w[some], rows * width).reshape(rows, width)  # noqa: B023
            return made[side, id(w)]

        for name, (x, y) in weights.items():
            out[name] += matrix(0, x, m) @ matrix(1, y, n).T
    thin = [~dense[c] for c in col]
    if thin[0].any() and thin[1].any():
        ca, cb = col[0][thin[0]], col[1][thin[1]]
        for one, two in _met(ca, cb, np.bincount(cb, minlength=len(keys))):
            cell = row[0][thin[0]][one] * n + row[1][thin[1]][two]
            for name, (x, y) in weights.items():
                out[name] += np.bincount(cell, x[thin[0]][one] * y[thin[1]][two], m * n).reshape(m, n)
    return out


def cosine(a: Block, b: Block, lam: float) -> tuple[np.ndarray, np.ndarray]:
    """(sim, n) of each row of a with each of b."""
    one, two = np.ones(len(a.r)), np.ones(len(b.r))
    s = crossed(a, b, {"n": (one, two), "ab": (a.r, b.r), "aa": (a.r * a.r, two), "bb": (one, b.r * b.r)})
    norm = np.sqrt(s["aa"] * s["bb"])
    fine = norm > 0
    return np.where(fine, s["n"] / (s["n"] + lam) * s["ab"] / np.where(fine, norm, 1.0), 0.0), s["n"]


def pearson(a: Block, b: Block, lam: float) -> tuple[np.ndarray, np.ndarray]:
    """(sim, n). Whether all shared values of a side are alike is told by sums of ranks, which are exact, where a variance is next to nothing."""
    one, two = np.ones(len(a.r)), np.ones(len(b.r))
    s = crossed(a, b, {"n": (one, two), "a": (a.r, two), "b": (one, b.r), "ab": (a.r, b.r), "aa": (a.r * a.r, two), "bb": (one, b.r * b.r)})
    n = np.maximum(s["n"], 1.0)
    va, vb = s["aa"] - s["a"] * s["a"] / n, s["bb"] - s["b"] * s["b"] / n
    fine = (s["n"] > 1) & (va > 0) & (vb > 0)
    near = fine & ((va <= 1e-9 * s["aa"]) | (vb <= 1e-9 * s["bb"]))
    if near.any():
        x, y = _ranks(a), _ranks(b)
        t = crossed(a, b, {"a": (x, two), "b": (one, y), "aa": (x * x, two), "bb": (one, y * y)})
        fine &= (s["n"] * t["aa"] > t["a"] * t["a"]) & (s["n"] * t["bb"] > t["b"] * t["b"])
    cov = s["ab"] - s["a"] * s["b"] / n
    return np.where(fine, s["n"] / (s["n"] + lam) * cov / np.sqrt(np.where(fine, va * vb, 1.0)), 0.0), s["n"]


#: Criteria that can be had of matrices, by name.
CRITERIA: dict[str, Callable[[Block, Block, float], tuple[np.ndarray, np.ndarray]]] = {"cosine": cosine, "pearson": pearson}


def rounded(x: np.ndarray) -> np.ndarray:
    """To nine places, halves away from zero."""
    return np.copysign(np.floor(np.abs(x) * 1e9 + 0.5) / 1e9, x) + 0.0


class Best:
    """The ``k`` of highest similarity, ties by id, of each row, while tiles come."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.least = np.full(len(ids), -np.inf)
        self.row, self.other, self.sim = np.empty(0, int), np.empty(0, np.int64), np.empty(0)

    def add(self, sim: np.ndarray, others: np.ndarray) -> None:
        """``sim``: -inf where nothing is shared."""
        least = self.least
        if sim.shape[1] > self.k:  # what is below a tile's own k-th can be left out at once
            least = np.maximum(least, np.partition(sim, -self.k, axis=1)[:, -self.k])
        row, col = np.nonzero((sim >= least[:, None]) & (sim > -np.inf))
        row, other, sim = np.r_[self.row, row], np.r_[self.other, others[col]], np.r_[self.sim, sim[row, col]]
        order = np.lexsort((other, -sim, row))
        row, other, sim = row[order], other[order], sim[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.k
        self.row, self.other, self.sim = row[keep], other[keep], sim[keep]
        full = rank == self.k - 1
        self.least[row[full]] = sim[full]

    def told(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.ids[self.row], self.other, self.sim


def nearest(a: Block, b: Block, criterion: str, lam: float, k: int, same: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(own, other, sim) of the best k in b of a's rows and, unless the blocks are the ``same``, in a of b's rows."""
    back = [Best(b.ids[at : at + COLUMNS], k) for at in range(0, len(b.ids), COLUMNS)]
    right = [b.part(at, at + COLUMNS) for at in range(0, len(b.ids), COLUMNS)]
    out = []
    for at in range(0, len(a.ids), ROWS):
        left = a.part(at, at + ROWS)
        best = Best(left.ids, k)
        for part, other in zip(right, back, strict=True):
            sim, n = CRITERIA[criterion](left, part, lam)
            sim = np.where(n > 0, rounded(sim), -np.inf)
            if same:
                sim[left.ids[:, None] == part.ids] = -np.inf
            else:
                other.add(sim.T, left.ids)
            best.add(sim, part.ids)
        out.append(best.told())
    return out + ([] if same else [x.told() for x in back])
