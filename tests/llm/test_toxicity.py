import numpy as np
import pytest
from odd import LONG, ODD

from grafmill.llm import toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def words():
    """A small character model."""
    counts = np.zeros(toxicity.N**3)
    for w in "idiot stupid moron wonderful garden the and with people house little morning".split() * 20:
        a = c = 0
        for k in map(toxicity.code, w + "\0"):
            counts[(a * toxicity.N + c) * toxicity.N + k] += 1
            a, c = c, k
    return toxicity.CharModel(counts)


@pytest.mark.parametrize(("noisy", "word"), [("1d10t", "idiot"), ("st*pid", "stupid"), ("i.d.i.o.t", "idiot"), ("iiidiooot", "idiot"), ("m0r0n", "moron"), ("wond3rful", "wonderful"), ("$tup1d", "stupid"), ("idiot", "idiot")])
def test_restores(words, noisy, word):
    assert words.restore(noisy) == word


def test_letters_set_apart(words):
    assert toxicity.Restorer(words).spaced("you i d i o t there".split()) == ["idiot"]


def test_restored_text(words):
    assert toxicity.Restorer(words).restored("The 1d10t and m0r0n") == "the idiot and moron"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.score_toxicity(docs, labels)
    rows = out.join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    yes, no = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in yes for b in no])
    assert auc > 0.95
    assert np.mean([r.toxic for r in rows if r.predicted]) > 0.85 and np.mean([r.predicted for r in rows if r.toxic]) > 0.9


def test_labels_outside_training_do_not_count(spark, documents, frame):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.withColumn("toxic", toxicity.F.expr("case when pmod(crc32(cast(doc_id as string)), 4) = 2 then 1 - toxic else toxic end"))
    one, two = ({r.doc_id: r.score for r in toxicity.score_toxicity(frame(documents), x).collect()} for x in (labels, turned))
    assert one == two


def test_odd_rows(spark, frame):
    labels = spark.createDataFrame([(1, 0, 1), (8, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    out = toxicity.score_toxicity(frame([*ODD, (None, "x")]), labels).collect()
    assert len(out) == len(ODD) + 1
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert {r.doc_id: r.held_out for r in out if r.doc_id} == {d: toxicity.held_out(d) for d, _ in ODD}


def test_without_labels(spark, frame):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.score_toxicity(frame([(1, LONG)]), labels).collect()] == [0.0]
    assert toxicity.score_toxicity(frame([]), labels).count() == 0


def test_letters_set_apart_of_any_number(words):
    """Words far behind the start of a run are found, each as a word of its own."""
    text = " ".join("wonderful garden and the people with house and little morning " * 3 + "idiot").replace("   ", " ")
    assert len(text.split()) > 150
    assert toxicity.Restorer(words).spaced(text.split())[-1] == "idiot"
    scorer = toxicity.Scorer(words, {"=idiot": 3.0, "^moro": 2.0})
    assert scorer.evidence(text) == 3.0 and scorer.evidence(f"x{'y' * 50}idiot") == 0.0
    assert toxicity.Scorer(words, {"idiot": 3.0}).evidence(f"x{'y' * 50}idiot") == 3.0
    assert "idiot" in toxicity.features(f"x{'y' * 50}idiot")


def test_long_tokens_are_decoded(words):
    """Stretched words and glued ones of any length."""
    restorer = toxicity.Restorer(words)
    assert restorer.read("st" + "u" * 60 + "pid")[-1] == "stupid"
    assert "idiot" in restorer.read("people-with-a-wonderful-little-garden-and-house-id1ot")
    assert toxicity.Scorer(words, {"=moron": 3.0}).evidence("the.people.and.the.little.garden.with.a.m0r0n") == 3.0


def cheapest(model, token):
    """Every way through the lattice tried: the least cost, and a word that has it."""
    import itertools

    T, best = toxicity, (np.inf, "")
    ways = []
    for i, c in enumerate(token):
        here = [(c, T.KEEP)] if c.isalpha() else []
        if c.isalpha() and i and c == token[i - 1]:
            here.append(("", T.RUN + 1.0))
        here += [(x, (T.SWAP_WILD if len(T.LOOKS_LIKE[c]) > 2 else T.SWAP) + (1.5 if c.isalpha() and c not in T._CYRILLIC else 0)) for x in T.LOOKS_LIKE.get(c, "")]
        if not c.isalpha():
            here.append(("", 1.0 + (T.DROP if c in T.SEPARATORS else T.DROP + 3 if len(T.LOOKS_LIKE.get(c, "")) != 1 and c not in "1|6" else 9.0)))
        ways.append(here)
    for path in itertools.product(*ways):
        word, cost, a, b = "".join(x for x, _ in path), sum(k for _, k in path), 0, 0
        for x in word:
            cost += model.cost[a][b][T.code(x)]
            a, b = b, T.code(x)
        cost += model.cost[a][b][0]
        best = min(best, (cost, word))
    return best


def test_decoder_against_every_path(words):
    """Viterbi finds the cheapest of all words, also where wild symbols make many states."""
    for token in ("1d10t", "st*pid", "m0r0n", "s**pid", "iid10t", "i.d-i0t", "*diot", "v1u8", "5tuup1d", "4ss3ss", "|d!ot"):
        assert words.restore(token) == cheapest(words, token)[1], token


@pytest.mark.parametrize(("noisy", "word"), [("stuupid", "stupid"), ("mmoorroonn", "moron"), ("*diot", "idiot"), ("idio*", "idiot"), ("moro#", "moron"), ("idі0t", "idiot"), ("іdіоt", "idiot"), ("(st*pid!)", "stupid"), ("st**id", "stupid")])
def test_tokens_that_reach_the_lattice(words, noisy, word):
    assert word in toxicity.Restorer(words).read(noisy)
    assert toxicity.Scorer(words, {f"={word}": 3.0}).evidence(f"the {noisy} garden") == 3.0


@pytest.mark.parametrize("text", ["que*** de%%% onier###", "wonderful", "little garden"])
def test_words_that_are_not_touched(words, text):
    assert toxicity.Restorer(words).restored(text).replace("*", "").replace("%", "").replace("#", "").split() == text.replace("*", "").replace("%", "").replace("#", "").split()


def obfuscated():
    """Documents with a toxic word, plain in the labelled ones, obfuscated in the others, and clean documents."""
    import random

    rng = random.Random(8)
    filler = "the garden and house with people in little morning of wonderful summer days near rivers where children sing".split()
    noise = {"idiot": ["1d10t", "i d i o t", "i.d.i.o.t", "*diot", "idііot", "iiidioott"], "stupid": ["$tup1d", "st*pid", "s t u p i d", "stuuupid", "s-t-u-p-i-d"], "moron": ["m0r0n", "moro#", "mmoorroonn", "m_o_r_o_n"]}
    docs, labels, hidden = [], [], []
    for i in range(400):
        say = [rng.choice(filler) for _ in range(30)]
        toxic = i % 4 == 1
        if toxic:
            word = rng.choice(list(noise))
            held = toxicity.held_out(i)
            say.insert(rng.randrange(5, 25), rng.choice(noise[word]) if held else word)
            hidden += [i] * held
        docs.append((i, " ".join(say)))
        labels.append((i, 1, int(toxic)))
    return docs, labels, hidden


def test_restoration_turns_verdicts(spark, frame, monkeypatch):
    """Obfuscated toxic words are caught, and missed where restoration is left out; clean documents stay clean."""
    docs, labels, hidden = obfuscated()
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.predicted for r in toxicity.score_toxicity(frame(docs), told).collect()}
    assert sum(out[i] for i in hidden) >= 0.85 * len(hidden) and not any(out[i] for i, _, y in labels if not y)
    counts = np.zeros(toxicity.N**3)
    scorer = toxicity.Scorer(toxicity.CharModel(counts), {f"={w}": 3.0 for w in ("idiot", "stupid", "moron")})
    monkeypatch.setattr(toxicity.Restorer, "read", lambda self, raw: (raw,))
    monkeypatch.setattr(toxicity.Restorer, "runs", lambda self, tokens: [])
    assert not any(scorer.evidence(t) for i, t in docs if i in hidden)
