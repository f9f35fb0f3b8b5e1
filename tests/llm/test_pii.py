import hashlib

import brute
import pytest
from odd import ODD

from grafmill.llm import pii

TEXTS = [
    "mail a.b+c@x-y.co.uk, A@b.c. not@this but x@y.z.w; @home",
    "ip 1.2.3.4 and 256.1.1.1, 001.002.003.0255 1.2.3 1.2.3.4.5 99999.1.1.1",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112; 4111 1111  1111 1111 5500005555555559",
    "+1 (415) 555-0132. +44 20 7946 0958, +12 34, call +1234567890123456 now +1-2-3-4-5-6-7-8",
    "",
]


@pytest.fixture(scope="module")
def field(spark, frame, documents):
    return pii.fit(pii.texts(frame(documents)))


def test_base_spans(spark, frame, documents, field):
    rows = [*documents, *((9000 + i, t) for i, t in enumerate(TEXTS)), *((9100 + d, t) for d, t in ODD)]
    for r in pii.find_pii(frame(rows), field).collect():
        text = dict(rows)[r.doc_id]
        base = brute.base_pii(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in base) for k in ("email", "ip", "card", "phone")]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def planted():
    """Tokens of one shape: in half of the documents one occurrence is announced as a secret, in the others none is."""
    import random

    rng, rows = random.Random(4), []
    for i in range(300):
        token = "".join(rng.choice("abcdefghijklmnop" if k % 2 else "0123456789") for k in range(10))
        say = "token" if i % 2 else "order"
        rows.append((i, f"some words and {say} {token} " + f"then more words on {token} as said " * (3 - i % 2)))
    return rows


def test_skip_potentials_carry_labels(spark, frame):
    """Trained on rows where shape alone does not tell: an announced secret is one at all 50 occurrences, another token at none."""
    trained = pii.fit(pii.texts(frame(planted())))
    without = pii.Field(trained.unary, trained.chain, 0 * trained.skip)
    filler = "words that say nothing at all about it " * 12
    for say, linked, alone in (("token", 50, 1), ("order", 0, 0)):
        text = f"{say} 1g2h3k4m5n " + f"{filler} 1g2h3k4m5n " * 49
        found = [[text[a:b] for k, a, b in pii.added_spans(f, text, []) if pii.KINDS[k] == "secret"] for f in (trained, without)]
        assert [x.count("1g2h3k4m5n") for x in found] == [linked, alone]
    # the same through the table: leaving the links out changes results
    rows = [(i, t) for i, t in planted()]
    one, two = ({r.doc_id: r.spans for r in pii.find_pii(frame(rows), f).collect()} for f in (trained, without))
    assert sum(one[i] != two[i] for i in one) >= 100


def exact_marginals(phi, edges):
    """By enumeration of all labellings. ``edges``: (i, j, table of log potentials)."""
    import itertools

    np = pii.np
    out = np.zeros(phi.shape)
    for labels in itertools.product(range(phi.shape[1]), repeat=len(phi)):
        weight = np.exp(sum(phi[i, y] for i, y in enumerate(labels)) + sum(t[labels[i], labels[j]] for i, j, t in edges))
        for i, y in enumerate(labels):
            out[i, y] += weight
    return out / out.sum(1, keepdims=True)


@pytest.mark.parametrize(("text", "slack"), [("1a x 2b y 1a z 3c", 1e-3), ("1a 2b x 3c 2b", 1e-3), ("1a 2b 1a 2b", 0.05), ("1a 2b 3c 1a 2b", 0.05)])
def test_marginals_against_enumeration(text, slack):
    """Exact where links make no loop, close where they do."""
    np = pii.np
    rng = np.random.default_rng(1)
    unary = {f: rng.normal(0, 0.6, pii.L) for f in ("digits1", "letters1", "changes0", "hexadecimal", "dots0")}
    chain, skip = rng.normal(0, 0.5, (pii.L, pii.L)), np.eye(pii.L)
    spots = pii.candidates(text)
    phi = pii.Field(unary, chain, skip).potentials(text, spots)
    chains, skips = pii.links(text, spots)
    assert skips
    want = exact_marginals(phi, [*((i, j, chain) for i, j in chains), *((i, j, skip) for i, j in skips)])
    assert abs(pii.Field(unary, chain, skip).marginals(text, spots) - want).max() < slack


def test_emails_as_the_pattern_finds_them():
    import random
    import re

    rng, pattern = random.Random(2), re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for _ in range(20_000):
        text = "".join(rng.choice("ab@@..-+ é") for _ in range(rng.randint(0, 24)))
        assert pii.emails(text) == [(0, *m.span()) for m in pattern.finditer(text)], text


@pytest.mark.parametrize("text", ["@" + "a" * 200_000, "a" * 200_000 + " @", "a@" * 100_000, "1" * 200_000, "1." * 100_000, "+1" + " " * 200_000, "x" * 200_000 + "@", "é" * 200_000, "a1 " * 3000])
def test_long_texts_take_linear_time(field, text):
    import time

    began = time.process_time()
    pii.added_spans(field, text, pii.base_spans(text))
    assert time.process_time() - began < 10


def test_messages_draw_repeated_tokens_together(field):
    """Marginals of linked candidates lie closer together than without their link."""
    text = "token=AB12CD34EF56GH78 then x AB12CD34EF56GH78"
    spots = pii.candidates(text)
    assert len(spots) == 2
    with_links = field.marginals(text, spots)
    alone = pii._softmax(field.potentials(text, spots))
    assert abs(with_links[0] - with_links[1]).max() <= abs(alone[0] - alone[1]).max() + 1e-9


def test_redaction(spark, frame, field):
    rows = [(1, TEXTS[0]), (2, None), (3, "plain words alone")]
    out = {r.doc_id: r for r in pii.redact_documents(frame(rows), field).collect()}
    assert out[2].text is None and out[3].text == "plain words alone"
    assert "<EMAIL>" in out[1].text and "a.b+c@" not in out[1].text and out[1].n_chars == len(out[1].text)
    assert out[1].word == "w" and out[1].salt == 2


def test_empty_table(spark, frame):
    assert pii.find_pii(frame([])).count() == 0


def test_evidence_reaches_every_occurrence():
    """Marginals of a chain of equal tokens are exact, so evidence at the first one reaches the last."""
    n, labels, secret = 14, pii.L, pii.LABELS.index("secret")
    text = ("key AB12CD34EF56GH78 " + "some more words AB12CD34EF56GH78 " * (n - 1)).strip()
    unary = {"keyword": 6.0 * pii.np.eye(labels)[secret], "letters2": 0.2 * pii.np.eye(labels)[0]}
    skip = 6.0 * pii.np.eye(labels)
    spots = pii.candidates(text)
    field = pii.Field(unary, pii.np.zeros((labels, labels)), skip)
    got = field.marginals(text, spots)
    local = list(pii.np.exp(field.potentials(text, spots)))
    ahead, behind = [local[0]], [pii.np.ones(labels)]
    for x in local[1:]:
        ahead.append(ahead[-1] @ pii.np.exp(skip) * x)
    for x in local[:0:-1]:
        behind.append(pii.np.exp(skip) @ (behind[-1] * x))
    exact = pii.np.array(ahead) * pii.np.array(behind[::-1])
    assert len(spots) == n and abs(got - exact / exact.sum(1, keepdims=True)).max() < 1e-3
    assert (got[:, secret] > 0.5).all()
