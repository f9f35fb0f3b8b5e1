"""Toxicity with noisy-channel deobfuscation.

1. Word counts of the whole corpus (Spark aggregates them, combined before the shuffle) give a character trigram
   language model: each distinct clean word adds the logarithm of its count to its trigrams. The model has
   one number for each trigram of a fixed alphabet.
2. A token that may be obfuscated (digits or symbols among letters, a letter masked by one symbol, doubled letters, letters of
   another script that look like Latin ones, letters set apart by spaces or punctuation) becomes a lattice: each character may
   stand for itself, for the letters it imitates, be a separator to delete or one more of a run. Viterbi, over all states,
   finds the likeliest word under channel costs and language model; what stands there is read as well as what is behind it.
   Letters set apart are joined, however many, and the lattice may also end a word and begin the next between any two.
3. Labelled rows (labels.toxic, crc32(doc_id) mod 4 not 2; at most SAMPLE of them, those of least
   hash) give for each feature (word, word beginnings, inner n-grams) how many toxic and clean documents hold
   it. Features that tell enough make the lexicon; a word's weight is that of its best feature.
4. A document's evidence is the sum of its distinct words' weights over original and restored text, each next strongest one
   counting half of the one before; a logistic curve over it, fitted on the same rows, gives the score. Labels, lang, source and doc_id are no inputs.

Defined results: a null or empty text has no evidence and the score that goes with it; repeated rows are scored each;
tokens and texts of any length are read whole; without labels of both kinds the score is 0; an empty table gives an empty result;
further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafmill.llm.common import materialize, texts

#: Labelled rows used for fitting, at most.
SAMPLE = 20_000
#: A feature needs this many toxic training documents and this log odds.
LEAST_TOXIC, LEAST_ODDS = 4, 2.5
#: What a Python worker remembers at most: tokens, words' features, features counted before they are passed on.
MEMO, FEATURES_MEMO, COUNTED = 200_000, 20_000, 250_000

ALPHABET = "\0abcdefghijklmnopqrstuvwxyzàáâäçèéêëíîïñóôöùúûüß\1"  # \0: word edge, \1: any other letter
_CODE = {c: i for i, c in enumerate(ALPHABET)}
N = len(ALPHABET)
OTHER = _CODE["\1"]

LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "v": "u", "u": "v",
}
#: Symbols that may stand for any letter.
WILD = "*#%&"
LOOKS_LIKE |= dict.fromkeys(WILD, "abcdefghijklmnopqrstuvwxyz")
_CYRILLIC = dict(zip("аеорсухіѕ", "aeopcyxis", strict=True))
LOOKS_LIKE |= _CYRILLIC
SEPARATORS = set(".-_*~'`,·•/\\|^+=:; ")
KEEP, SWAP, SWAP_WILD, DROP, RUN = 0.0, 1.5, 3.0, 1.0, 0.7
#: Edges of a token that are no part of its word; one symbol in the place of a first or last letter is.
_EDGE = re.compile(r"^[^\w@$!|*#%&]+|^[*#%&](?![^\W\d_])[^\w@$!|]*|^[*#%&]{2,}|(?<![*#%&])[^\w@$|*#%&]+$|[*#%&]{2,}[^\w@$|]*$|(?<=[a-zà-ÿ])[$|!]+$")
_NOISY = re.compile(rf"[^\W\d_][\W\d_]+[^\W\d_]|^[\d@$!|*#%&]+[^\W\d_]|[^\W\d_][\d@$|*#%&]+$|([^\W\d_])\1|[{''.join(_CYRILLIC)}]")
#: What glues words into one token; runs of a letter that say no more than three of it.
_GLUE, _RUNS, _RUN = re.compile(r"[-._/\\,:;=+~]+"), re.compile(r"([^\W\d_])\1{3,}"), re.compile(r"([^\W\d_])\1+")
#: In the tokens' lengths: runs of tokens of one or two characters, letters set apart.
_SHORT = re.compile(rb"[\x01\x02]{4,}")
_WORD = re.compile(r"[^\W\d_]+")


def code(c: str) -> int:
    return _CODE.get(c, OTHER)


def fold(word: str) -> str:
    """What all readings of a word of letters share."""
    return _RUN.sub(r"\1", word.replace("v", "u"))


class CharModel:
    """Character trigrams, smoothed by their bigrams."""

    def __init__(self, counts: np.ndarray):
        tri = counts.reshape(N, N, N) + 0.0
        bi = tri.sum(0)  # (second, third)
        uni = bi.sum(0) + 1.0
        p1 = uni / uni.sum()
        p2 = (bi + 5 * p1[None, :]) / (bi.sum(1, keepdims=True) + 5)
        p3 = (tri + 5 * p2[None, :, :]) / (tri.sum(2, keepdims=True) + 5)
        self.cost = (-np.log(p3)).tolist()

    def restore(self, token: str) -> str:
        """The likeliest word behind a token."""
        return self._decode(token, False)

    def segment(self, letters: str) -> list[str]:
        """The likeliest words behind joined letters: between any two a word may end."""
        return self._decode(letters, True).split()

    def _decode(self, token: str, edges: bool) -> str:
        # states: the last two characters of the word so far; value: (cost, word as linked letters)
        beam: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        last = ""
        for c in token:
            ways: list[tuple[str, float]] = []
            letter = c.isalpha()
            if letter:
                ways.append((c, KEEP))
                if c == last:
                    ways.append(("", RUN))
            for x in LOOKS_LIKE.get(c, ""):
                ways.append((x, (SWAP_WILD if len(LOOKS_LIKE[c]) > 2 else SWAP) + (1.5 if letter and c not in _CYRILLIC else 0)))
            if not letter:
                ways.append(("", DROP if c in SEPARATORS else DROP + 3 if len(LOOKS_LIKE.get(c, "")) != 1 and c not in "1|6" else 9.0))
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, word) in beam.items():
                row = self.cost[a][b]
                for x, channel in ways:
                    if x:
                        k = code(x)
                        state, value, link = (b, k), cost + channel + row[k], (word, x)
                    elif letter and edges and not b:
                        continue  # a word's first letter is no run of the word before
                    else:
                        state, value, link = (a, b), cost + channel + 1.0, word
                    if state not in new or value < new[state][0]:
                        new[state] = (value, link)
            if edges:
                ended = min(((cost + self.cost[a][b][0], word) for (a, b), (cost, word) in new.items() if b), key=lambda t: t[0], default=None)
                if ended and ((0, 0) not in new or ended[0] < new[0, 0][0]):
                    new[0, 0] = (ended[0], (ended[1], " "))
            beam, last = new, c
        word = min(((cost + (self.cost[a][b][0] if b or not edges else 0.0), word) for (a, b), (cost, word) in beam.items()), key=lambda t: t[0])[1]
        out = []
        while word:
            word, x = word
            out.append(x)
        return "".join(reversed(out))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents: letters alone, lower-cased."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        seen: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(text.lower().split())
                if len(seen) > MEMO:
                    yield _counted(seen)
                    seen.clear()
        yield _counted(seen)

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(seen: dict[str, int]) -> pa.RecordBatch:
    out: dict[str, int] = {}
    for w, n in seen.items():
        w = w.strip(".,;:!?\"'()[]|*%$&#<>")
        if w.isalpha():
            out[w] = out.get(w, 0) + n
    return pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], names=["word", "n"])


def char_model(docs: DataFrame) -> CharModel:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N * N * N)
        for b in batches:
            at, weight = [], []
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a = c = 0
                v = math.log1p(n)
                for k in map(code, w + "\0"):
                    at.append((a * N + c) * N + k)
                    weight.append(v)
                    a, c = c, k
            total += np.bincount(at, weight, N * N * N)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    found = word_counts(docs).mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()  # at most N**3 rows
    counts = np.zeros(N**3)
    for r in found:
        counts[r["at"]] = r["n"]
    return CharModel(counts)


def features(word: str) -> set[str]:
    """The word, its beginnings and inner n-grams."""
    out = {f"={word}", *(f"^{word[:k]}" for k in (4, 5, 6) if len(word) > k)}
    out.update(word[i : i + k] for k in (5, 6) for i in range(len(word) - k + 1))
    return out


class Restorer:
    """Words of a text, and those behind its obfuscated tokens."""

    def __init__(self, model: CharModel):
        self.model = model
        self.tokens: dict[str, tuple[str, ...]] = {}

    def read(self, raw: str) -> tuple[str, ...]:
        """Words of a lower-cased token; if it looks obfuscated, also what is behind its glued parts and, last, behind all of it."""
        core = _EDGE.sub("", raw)
        found = (core,) if core.isalpha() else tuple(_WORD.findall(core))
        if _NOISY.search(core) and self.promising(core):
            core = _RUNS.sub(r"\1\1\1", core)
            parts = [p for p in _GLUE.split(core) if len(p) > 2]
            if len(parts) > 1:
                found = (*found, *(self.model.restore(p) for p in parts if _NOISY.search(p)))
            found = (*found, self.model.restore(core))
        return found

    def promising(self, core: str) -> bool:
        """Whether what is behind a token can matter."""
        return True

    def token(self, raw: str) -> tuple[str, ...]:
        found = self.tokens.get(raw)
        if found is None:
            if len(self.tokens) >= MEMO:
                self.tokens.clear()
            found = self.read(raw)
            if len(raw) <= 64:
                self.tokens[raw] = found
        return found

    def runs(self, tokens: list[str]) -> list[list[str]]:
        """Words behind each run of letters set apart: `i d i o t`, `i. d. i. o. t`."""
        out = []
        for m in _SHORT.finditer(bytes([min(n, 9) for n in map(len, tokens)])):
            letters = [t[0] for t in tokens[m.start() : m.end()] if len(t) == 1 or not t[1].isalnum()]
            if len(letters) >= 4:
                out.append(self.model.segment("".join(letters)))
        return out

    def spaced(self, tokens: list[str]) -> list[str]:
        return [w for run in self.runs(tokens) for w in run]

    def restored(self, text: str) -> str:
        """The text with each obfuscated token replaced by what is behind it."""
        return " ".join(self.token(w)[-1] if _NOISY.search(_EDGE.sub("", w)) else w for w in text.lower().split())


class Scorer(Restorer):
    """Evidence of a text: words' weights from the lexicon, each next one counting half."""

    def __init__(self, model: CharModel, lexicon: dict[str, float]):
        import ahocorasick

        super().__init__(model)
        self.found, self.folded = ahocorasick.Automaton(), ahocorasick.Automaton()
        for f, w in lexicon.items():
            # "=word" is the whole word, "^be" its beginning; edges are marked in the word searched
            self.found.add_word(f"^{f[1:]}=" if f[0] == "=" else f, w)
            self.folded.add_word(fold(f"^{f[1:]}=" if f[0] == "=" else f), True)
        if lexicon:
            self.found.make_automaton()
            self.folded.make_automaton()
        self.weights: dict[str, float] = {}
        self.any = bool(lexicon)

    def weight(self, word: str) -> float:
        return max((w for _, w in self.found.iter(f"^{word}=")), default=0.0) if self.any else 0.0

    def promising(self, core: str) -> bool:
        """In a token of letters only runs, and u for v, can be noise: if it holds no folded entry, nothing behind it holds one."""
        return not core.isalpha() or not _CYRILLIC.keys().isdisjoint(core) or self.any and next(self.folded.iter(fold(f"^{core}=")), None) is not None

    def of_token(self, raw: str) -> float:
        out = max(map(self.weight, self.read(raw)), default=0.0)
        if len(self.weights) >= MEMO:
            self.weights.clear()
        if len(raw) <= 64:
            self.weights[raw] = out
        return out

    def evidence(self, text: str) -> float:
        tokens = text.lower().split()
        got = self.weights
        strong = []
        for w in set(tokens):
            x = got.get(w)
            if x is None:
                x = self.of_token(w)
            if x:
                strong.append(x)
        apart: dict[str, float] = {}
        for run in self.runs(tokens):
            known = {w: self.weight(w) for w in run}
            # the run as one word, where words were cut wrongly: in place of the strongest of them
            whole = self.weight("".join(run))
            if known and whole > max(known.values()):
                known[max(known, key=known.get)] = whole
            for w, x in known.items():
                apart[w] = max(x, apart.get(w, 0.0))
        strong += filter(None, apart.values())
        strong.sort(reverse=True)
        return sum(w * 0.5**i for i, w in enumerate(strong))


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """At most SAMPLE labelled rows outside the held-out part: (doc_id, text, toxic)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and doc_id is not null")
    known = known.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    # bounded: SAMPLE rows of two numbers
    # a doc_id that several rows share counts once, with its least text
    return docs.join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")


def fit_lexicon(rows: DataFrame, model: CharModel) -> dict[str, float]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        memo: dict[str, set[str]] = {}
        seen: dict[str, list[int]] = {}
        for b in batches:
            for text, toxic in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                tokens = text.lower().split()
                words = {x for w in set(tokens) for x in restorer.token(w)}
                for run in restorer.runs(tokens):
                    words.update(run, ["".join(run)])
                found: set[str] = set()
                for w in words:
                    f = memo.get(w)
                    if f is None:
                        f = features(w)
                        if len(w) <= 64:  # longer ones are not remembered
                            memo[w] = f
                    found |= f
                for f in found:
                    n = seen.get(f)
                    if n is None:
                        n = seen[f] = [0, 0]
                    n[1 - toxic] += 1
                if len(memo) > FEATURES_MEMO:
                    memo.clear()
                if len(seen) > COUNTED:
                    yield _told(seen)
                    seen.clear()
        yield _told(seen)

    def _told(seen: dict[str, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], pa.int64())], names=["feature", "t", "c"])

    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return {}
    odds = F.log((F.col("t") + 0.5) / (n[1] + 1)) - F.log((F.col("c") + 0.5) / (n[0] + 1))
    told = rows.mapInArrow(run, "feature string, t long, c long").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where(F.col("t") >= LEAST_TOXIC)
    # as many as SAMPLE documents can hold; most are rare
    return {r.feature: float(r.w) for r in told.withColumn("w", odds).where(F.col("w") >= LEAST_ODDS).select("feature", "w").collect()}


def evidence(docs: DataFrame, model: CharModel, lexicon: dict[str, float], *more: str) -> DataFrame:
    """doc_id, further columns, evidence."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast((model, lexicon))  # a fixed alphabet's trigrams and a lexicon of SAMPLE documents
    kinds = ", ".join(f"{c} {t}" for c, t in docs.select("doc_id", *more).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shipped.value)
        for b in batches:
            last = b.num_columns - 1
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(last)), pa.array(list(map(scorer.evidence, b.column(last).to_pylist())), pa.float64())], names=["doc_id", *more, "evidence"])

    return docs.select("doc_id", *more, "text").mapInArrow(run, f"{kinds}, evidence double")


def fit_curve(rows: pd.DataFrame) -> tuple[float, float]:
    """Logistic curve over the evidence: (intercept, slope), by Newton's method with a small ridge."""
    x, y = rows["evidence"].to_numpy(float), rows["toxic"].to_numpy(float)
    beta = np.zeros(2)
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - 0.01 * beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[CharModel, dict[str, float], tuple[float, float] | None]:
    """Character model, lexicon and curve; no curve without labels of both kinds."""
    model = char_model(docs)
    rows = materialize(training(docs, labels), "labelled")
    lexicon = fit_lexicon(rows, model)
    fitted = evidence(rows, model, lexicon, "toxic").select("toxic", "evidence").toPandas()  # at most SAMPLE rows
    return model, lexicon, fit_curve(fitted) if fitted["toxic"].nunique() == 2 else None


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    docs = texts(docs)
    model, lexicon, curve = fit(docs, labels)
    a, b = curve or (0.0, 0.0)
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.lit(a) + F.lit(b) * F.col("evidence")))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-z)) if curve else F.lit(0.0)
    out = evidence(docs, model, lexicon).withColumn("score", score)
    return out.select("doc_id", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Rows of ``docs``, with all their columns, whose score is below ``threshold``: judged where they are read, whatever their doc_id."""
    model, lexicon, curve = fit(texts(docs), labels)
    if curve is None:
        return docs
    shipped, at = docs.sparkSession.sparkContext.broadcast((model, lexicon)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shipped.value)
        for b in batches:
            z = np.array([curve[0] + curve[1] * scorer.evidence(t or "") for t in b.column(at).to_pylist()])
            yield b.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))) < threshold))

    return docs.mapInArrow(run, docs.schema)
