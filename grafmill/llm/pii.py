"""Personal data: patterns, and a skip-chain conditional random field that adds to them.

Base spans (email, ip, card, phone) are the patterns' leftmost non-overlapping matches; they always stay. The
field labels candidate tokens (with a digit or an at sign, or long and all capitals); any other token is ``O`` by
construction, so a document's graph has its candidates alone:

* unary potentials: a log-linear model of shape and context features;
* chain potentials between candidates that stand side by side;
* skip potentials between occurrences of one token, and of tokens of the same digits, however far apart: each is
  linked with the one before it, so a token that occurs m times has m - 1 links.

Loopy sum-product message passing, in sweeps forwards and backwards through the document until no message changes by
TOLERANCE, gives each candidate's label, so evidence reaches every occurrence; labels other than ``O`` outside the base spans
become added spans (also of the kind ``secret``: keys, tokens, passwords). Weights are trained here by piecewise
likelihood on all documents, under distant labels: the base spans, and for ``secret`` tokens of letters and digits that
a word such as `token` or `password` announces at one of their occurrences in the document. So an occurrence that nothing
announces has the label too, which its own features cannot tell: skip potentials learn to carry it.

Defined results: a null or empty text has no spans; repeated rows are read each; a row without doc_id is read like others; very
long texts take time in proportion to their length (and their candidates' sweeps); an empty table gives an empty result;
further columns, whatever their names, are ignored. Offsets count code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafmill.llm.common import texts

#: Sweeps end when no message changes by more. Those after PLAIN are damped, every CALM sweeps twice as much, so that they end everywhere.
TOLERANCE, PLAIN, CALM = 1e-3, 20, 20
#: Bound of learned chain and skip potentials.
CLIP = 6.0
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
LABELS = ("O", *KINDS)
L = len(LABELS)

#: An email's parts at its sign: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
LOCAL, DOMAIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-", re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match begins where its digits do, so runs of digits are read once.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_CANDIDATE = re.compile(r"(?<!\S)(?:\S*[0-9@]\S*|[A-Z]{16,}(?!\S))")
_NON_DIGIT = re.compile(r"[^0-9]")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Outwards from each sign: what is before it, back to the match before, and the longest domain behind it."""
    out: list[Span] = []
    free, at = 0, text.find("@")
    while at >= 0:
        # no part holds a sign, so each stretch between two signs is looked at twice at most
        begin = free + len(text[free:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            out.append((0, begin, found.end()))
        free = found.end() if found else at + 1
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start."""
    out: list[Span] = []
    if "@" in text:
        out += emails(text)
    if not _DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m.group().split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _NON_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(_NON_DIGIT.sub("", m.group())) <= 15]
    return out


_TRIM_LEFT, _TRIM_RIGHT = "\"'([{<,;:", "\"')]}>.,;:!?"


def candidates(text: str) -> list[tuple[int, int]]:
    """Tokens that can hold personal data, edges trimmed."""
    out = []
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        while a < b and text[a] in _TRIM_LEFT and not (text[a] == "(" and ")" in text[a:b]):
            a += 1
        while b > a and text[b - 1] in _TRIM_RIGHT and not (text[b - 1] == ")" and "(" in text[a:b]):
            b -= 1
        if a < b:
            out.append((a, b))
    return out


_KEYWORDS = {"password", "passwd", "pwd", "token", "secret", "key", "apikey", "api_key", "bearer"}
_CONTACT = {"phone", "tel", "mobile", "fax", "call", "telefon", "tél", "teléfono"}


#: Features of an occurrence; all others are the token's own.
CONTEXT = frozenset(("keyword", "contact"))
_BEFORE = re.compile(r"[^\W_]+(?:_[^\W_]+)*")


def announced(text: str, a: int, b: int) -> set[str]:
    """The two words before a token, and what it assigns to, in lower case."""
    words = _BEFORE.findall(text[max(0, a - 32) : a].lower())[-2:]
    head, equals, _ = text[a:b].partition("=")
    return {*words, *([head.lower()] if equals else ())}


def features(text: str, a: int, b: int) -> tuple[str, ...]:
    t = text[a:b]
    digits = sum("0" <= c <= "9" for c in t)
    letters = sum(c.isalpha() for c in t)
    words = announced(text, a, b)
    out = [
        f"digits{0 if not digits else 1 if digits < 3 else 2 if digits < 5 else 3 if digits < 8 else 4 if digits < 16 else 5 if digits < 20 else 6}",
        f"letters{0 if not letters else 1 if letters < 4 else 2 if letters < 12 else 3}",
        f"dots{min(t.count('.'), 4)}",
        f"dashes{min(t.count('-'), 3)}",
    ]
    if "@" in t:
        out.append("at+dot" if "." in t[t.index("@") :] else "at")
    if t[0] == "+":
        out.append("plus")
    if t[0] == "(" and t[-1] == ")":
        out.append("brackets")
    if digits and letters:
        changes = sum(x.isdigit() != y.isdigit() for x, y in zip(t, t[1:], strict=False))
        out.append(f"changes{0 if changes < 2 else 1 if changes < 6 else 2}")
        if all(c in "0123456789abcdefABCDEF" for c in t):
            out.append("hexadecimal")
    if t.isascii() and t.isupper() and len(t) >= 16:
        out.append("capitals")
    if words & _KEYWORDS:
        out.append("keyword")
    if words & _CONTACT:
        out.append("contact")
    if digits and digits + t.count(".") == len(t):
        parts = t.split(".")
        out.append("quad" if len(parts) == 4 and all(p and len(p) <= 3 and int(p) <= 255 for p in parts) else "numeric")
    if digits >= 16 and luhn("".join(c for c in t if "0" <= c <= "9")):
        out.append("luhn")
    return tuple(out)


def links(text: str, spots: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges and skip edges between candidates."""
    chain = [(i, i + 1) for i in range(len(spots) - 1) if spots[i + 1][0] - spots[i][1] <= 2]
    last: dict[str, int] = {}
    skip = []
    for i, (a, b) in enumerate(spots):
        t = text[a:b].casefold()
        keys = [t]
        digits = _NON_DIGIT.sub("", t)
        if len(digits) >= 6:
            keys.append("#" + digits)
        for k in keys:
            if k in last and last[k] != i:
                skip.append((last[k], i))
            last[k] = i
    return chain, list(dict.fromkeys(skip))


class Field:
    """Trained potentials: feature -> weights of the labels; chain and skip tables of log potentials."""

    def __init__(self, unary: dict[str, np.ndarray], chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    def potentials(self, text: str, spots: list[tuple[int, int]]) -> np.ndarray:
        """Log potentials of single candidates. What a token's shape says is said once for all its occurrences, so each has its share."""
        times = Counter(text[a:b].casefold() for a, b in spots)
        phi = np.zeros((len(spots), L))
        for i, (a, b) in enumerate(spots):
            m = times[text[a:b].casefold()]
            for f in features(text, a, b):
                w = self.unary.get(f)
                if w is not None:
                    phi[i] += w if f in CONTEXT else w / m
        return phi

    def marginals(self, text: str, spots: list[tuple[int, int]]) -> np.ndarray:
        phi = self.potentials(text, spots)
        chain, skip = links(text, spots)
        if not chain and not skip:
            return _softmax(phi)
        # every edge leads from an earlier candidate to a later one
        edges = [*((i, j, self.chain) for i, j in chain), *((i, j, self.skip) for i, j in skip)]
        tables = {id(t): (np.exp(t), np.exp(t.T)) for t in (self.chain, self.skip)}
        later, earlier = np.zeros((len(edges), L)), np.zeros((len(edges), L))
        # a sweep sends what a candidate has heard in that same sweep, so one sweep spans the document
        forth = [(e, i, j, tables[id(t)][0]) for e, (i, j, t) in enumerate(edges)]
        back = [(e, j, i, tables[id(t)][1]) for e, (i, j, t) in enumerate(edges)]
        forth.sort(key=lambda x: x[1])
        back.sort(key=lambda x: -x[1])
        belief = phi.copy()
        sweep, change = 0, TOLERANCE
        while change >= TOLERANCE:
            change, sweep = 0.0, sweep + 1
            damped = 0.5 ** max(0, -(-(sweep - PLAIN) // CALM))
            for order, sent, heard in ((forth, later, earlier), (back, earlier, later)):
                for e, src, dst, table in order:
                    x = belief[src] - heard[e]
                    new = np.log(np.exp(x - x.max()) @ table)
                    step = (new - new.max() - sent[e]) * damped
                    sent[e] += step
                    belief[dst] += step
                    change = max(change, step.max(), -step.min())
        return _softmax(belief)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Covered:
    """Base spans by kind, sorted: what a stretch meets is found by bisection, whatever their number."""

    def __init__(self, base: list[Span]):
        self.spans = [sorted((a, b) for k, a, b in base if k == kind) for kind in range(len(BASE))]

    def kind(self, a: int, b: int, share: float) -> int:
        """1 + the first kind that covers more than ``share`` of a..b, or 0. Spans of one kind don't overlap."""
        for k, spans in enumerate(self.spans):
            for i in range(max(0, bisect_right(spans, (a, a)) - 1), len(spans)):
                s, e = spans[i]
                if s >= b:
                    break
                if min(b, e) - max(a, s) > share * (b - a):
                    return k + 1
        return 0


def distant(text: str, spots: list[tuple[int, int]], base: list[Span]) -> list[int]:
    """Labels that training takes for true; a secret is one wherever it occurs in the text."""
    covered = Covered(base)
    core = lambda a, b: text[a:b].rsplit("=", 1)[-1].strip("\"'").casefold()
    secrets = {core(a, b) for a, b in spots if announced(text, a, b) & _KEYWORDS}
    secrets = {t for t in secrets if len(t) >= 8 and any(c.isdigit() for c in t) and any(c.isalpha() for c in t)}
    return [covered.kind(a, b, 0.5) or (LABELS.index("secret") if core(a, b) in secrets else 0) for a, b in spots]


def observed(text: str) -> Counter:
    """What training counts of a text: ("unary", features, label), ("chain" or "skip", label, label)."""
    out: Counter = Counter()
    spots = candidates(text)
    labels = distant(text, spots, base_spans(text))
    out.update(("unary", "\t".join(features(text, a, b)), y) for (a, b), y in zip(spots, labels, strict=True))
    for name, edges in zip(("chain", "skip"), links(text, spots), strict=True):
        out.update((name, str(labels[i]), labels[j]) for i, j in edges)
    return out


def train(counts: dict[tuple[str, str, int], int]) -> Field:
    """Piecewise: a softmax model of the features, and log ratios of label pairs at chain and skip edges."""
    seen: Counter = Counter()
    pairs = {"chain": np.full((L, L), 0.5), "skip": np.full((L, L), 0.05) + 2 * np.eye(L)}
    single = np.full(L, 1.0)
    for (kind, key, y), k in counts.items():
        if kind == "unary":
            seen[tuple(key.split("\t")), y] += k
            single[y] += k
        else:
            pairs[kind][int(key), y] += k
    names = sorted({f for fs, _ in seen for f in fs})
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(seen), len(names)))
    y, n = np.zeros(len(seen), int), np.zeros(len(seen))
    for i, ((fs, label), k) in enumerate(sorted(seen.items())):
        x[i, [at[f] for f in fs]] = 1
        y[i], n[i] = label, k
    w = softmax_fit(x, np.eye(L)[y] if len(seen) else np.zeros((0, L)), n)
    share = single / single.sum()

    chain = pairs["chain"] / pairs["chain"].sum()
    # against chance at chain edges; at skip edges against agreement, which costs nothing: what the tokens share is said once
    tied = pairs["skip"] + pairs["skip"].T
    skip = np.log(tied / np.sqrt(np.outer(np.diag(tied), np.diag(tied))))
    chain = np.log(chain) - np.log(share[:, None] * share[None, :])
    return Field({f: w[i] for f, i in at.items()}, np.clip(chain, -CLIP / 2, CLIP / 2), np.clip(skip, -CLIP, CLIP))


def softmax_fit(x: np.ndarray, target: np.ndarray, n: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """Weights (features, labels) of least mean loss plus ridge, by Newton's method with steps halved where the loss grows."""
    n = n / max(1.0, n.sum())
    w = np.zeros((x.shape[1], target.shape[1]))
    loss = lambda w: -(n * np.log(np.maximum((_softmax(x @ w) * target).sum(1), 1e-300))).sum() + ridge / 2 * (w * w).sum()
    now = loss(w)
    for _ in range(60):
        p = _softmax(x @ w) if len(x) else target
        gradient = x.T @ ((p - target) * n[:, None]) + ridge * w
        labels = range(target.shape[1])
        hessian = np.block([[x.T @ (x * (n * p[:, a] * ((a == b) - p[:, b]))[:, None]) for b in labels] for a in labels])
        step = np.linalg.solve(hessian + ridge * np.eye(len(hessian)), gradient.T.ravel()).reshape(target.shape[1], -1).T if w.size else w
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        new = loss(w - size * step)
        if new >= now - 1e-12:
            break
        w, now = w - size * step, new
    return w


def added_spans(field: Field, text: str, base: list[Span]) -> list[Span]:
    """Spans beside the base ones: candidates that the field labels, neighbours of one kind joined."""
    spots = candidates(text)
    if not spots:
        return []
    covered = Covered(base)
    free = [i for i, (a, b) in enumerate(spots) if not covered.kind(a, b, 0)]
    if not free:
        return []
    belief = field.marginals(text, spots)
    out: list[Span] = []
    for i in free:
        kind = int(belief[i].argmax())
        if kind and belief[i, kind] >= 0.5:
            a, b = spots[i]
            if out and out[-1][0] == kind - 1 and a - out[-1][2] <= 2 and text[out[-1][2] : a].isspace():
                out[-1] = (kind - 1, out[-1][1], b)
            else:
                out.append((kind - 1, a, b))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def fit(docs: DataFrame) -> Field:
    """Train on all documents, whole texts; executors count, the driver gets distinct sets of features alone."""
    rows = docs.where(F.col("text").rlike("[0-9@]|[A-Z]{16}")).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()  # as many as there are sets of features, a few thousand
        for b in batches:
            for text in b.column(0).to_pylist():
                total.update(observed(text))
        if total:
            kind, key, y = zip(*total, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(key, pa.string()), pa.array(y, pa.int32()), pa.array(total.values(), pa.int64())], names=["kind", "key", "y", "n"])

    told = rows.mapInArrow(run, "kind string, key string, y int, n long").groupBy("kind", "key", "y").agg(F.sum("n").alias("n"))
    return train({(r.kind, r.key, r.y): r.n for r in told.collect()})


def find_pii(docs: DataFrame, field: Field | None = None, keep_text: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added; with ``keep_text`` also the redacted text."""
    docs = texts(docs)
    field = field or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: list[list[int]] = [[], [], [], []]
            sha, spans, added, redacted = [], [], [], []
            for text in b.column(1).to_pylist():
                base = base_spans(text)
                more = added_spans(field, text, base)
                for k in range(4):
                    counts[k].append(sum(s[0] == k for s in base))
                sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined([*base, *more]))
                added.append(len(more))
                if keep_text:
                    redacted.append(redact(text, [*base, *more]))
            columns = [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(redacted, pa.string())] * keep_text, names=names)

    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"] + ["redacted"] * keep_text
    kinds = ["long"] * 5 + ["string"] * 2 + ["long"] + ["string"] * keep_text
    return docs.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def redact_documents(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its kind and n_chars, if there, following; other columns stay."""
    field = field or fit(texts(docs))
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(at).to_pylist():
                base = base_spans(text) if text else []
                out.append(redact(text, [*base, *added_spans(field, text, base)]) if text else text)
            cols = list(b.columns)
            cols[at] = pa.array(out, b.schema.field(at).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                cols[k] = pa.array([old if x is None else len(x) for x, old in zip(out, cols[k].to_pylist(), strict=True)], b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, docs.schema)


def redact(text: str, spans: list[Span]) -> str:
    """Each span replaced by its kind in angle brackets; overlapping spans count as one."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
            at = b
        else:
            at = max(at, b)
    return "".join([*out, text[at:]]) if spans else text
