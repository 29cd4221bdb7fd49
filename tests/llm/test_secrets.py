"""Secret spans: patterns by a plain scan, tags by plain Viterbi and numeric gradients, added spans on held-out texts."""

import hashlib
import random
import re

import numpy as np
import pytest
from text_fixtures import edge_docs, no_docs, text_of  # noqa: F401  (fixtures)

from clickengine.llm import secrets
from clickengine.llm.queries import LLM_QUERIES

SF_DIR = "/root/testdata/sf0.001"
VALUE = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"


def assign_at(text, at):
    """End of the match and of its value at a place, by hand."""
    for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
        if all(c.isascii() for c in text[at:at + len(name)]) and text[at:at + len(name)].lower() == name:
            k = at + len(name)
            k += text[k:k + 1] in ('"', "'") and k < len(text)
            while text[k:k + 1] == " ":
                k += 1
            if text[k:k + 1] not in (":", "="):
                return None
            k += 1
            while text[k:k + 1] == " ":
                k += 1
            k += text[k:k + 1] in ('"', "'") and k < len(text)
            start = k
            while k < len(text) and text[k] in VALUE:
                k += 1
            return (k, k - start) if k > start else None
    return None


def by_hand(text):
    out, at = [], 0
    while at < len(text):
        m = assign_at(text, at)
        if m and m[1] >= 12:
            out.append((at, 0, m[0]))
        at = m[0] if m else at + 1
    for kind, letters, head, least in ((1, VALUE[:26] + "0123456789", "AKIA", 18), (2, "0123456789abcdef", "", 16)):
        at = 0
        while at < len(text):
            end = at + len(head)
            while end < len(text) and text[end] in letters:
                end += 1
            if text.startswith(head, at) and end > at + len(head):
                if end - at >= least:
                    out.append((at, kind, end))
                at = end
            else:
                at += 1
    return sorted(out)


def random_text(rng):
    parts = ["password", "PassWd", "secret", "toKen", "token", "api_key", "APIkey", "ſecret", "=", ":", " ", "  ", '"', "'", "AKIA",
             "AKIAAKIA", "ABCDEF0123456789", "0123456789abcdef", "deadbeef", "abc123DEF456", "+/_.=-", "x", "日本", "\n", "é"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 24)))


def test_base_spans_equal_a_plain_scan():
    rng = random.Random(2)
    texts = [random_text(rng) for _ in range(4000)]
    found = [secrets.base_spans(t) for t in texts]
    assert found == [by_hand(t) for t in texts]
    assert {k for spans in found for _, k, _ in spans} == {0, 1, 2}


def plain_viterbi(scores, move):
    best, back = scores[0] + move[0], []
    for row in scores[1:]:
        ways = best[:, None] + move
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0) + row
    tags = [int((best + move[:, 0]).argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return tags[::-1]


def test_decoding_in_runs_equals_plain_viterbi():
    rng = np.random.default_rng(1)
    move = rng.normal(size=(3, 3))
    lengths = [1, 2, 3, 50, 1, 400, 7]
    text = np.repeat(np.arange(len(lengths)), lengths)
    for lead in (0.0, 2.0, 6.0):
        scores = rng.normal(size=(len(text), 3)) * 2
        scores[:, 0] += lead
        got = secrets.decode(scores, move, text)
        want = [t for k in range(len(lengths)) for t in plain_viterbi(scores[text == k], move)]
        assert got.tolist() == want


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(3)
    features = rng.integers(0, 12, (4, 6, 3))
    used = np.array([[1] * 6, [1] * 3 + [0] * 3, [1] + [0] * 5, [1] * 5 + [0]], bool)
    tags = rng.integers(0, 3, (4, 6))
    weights, move = rng.normal(size=(12, 3)), rng.normal(size=(3, 3))
    _, ds, moved = secrets.gradient(weights, move, features, tags, used)
    slope = np.zeros_like(weights)
    for k in range(3):
        np.add.at(slope, features[:, :, k], ds)
    for parameter, given in ((weights, slope), (move, moved)):
        for at in np.ndindex(parameter.shape):
            ends = []
            for step in (1e-5, -1e-5):
                parameter[at] += step
                ends.append(secrets.gradient(weights, move, features, tags, used)[0])
                parameter[at] -= step
            assert abs((ends[0] - ends[1]) / 2e-5 - given[at]) < 1e-6


def test_tokens_are_maximal_words_and_marks():
    texts = ["Ab1_c == 日本x, y", "", "x\n-é9"]
    tokens = secrets.Tokens(texts)
    got = [(int(t), texts[t][a:b]) for t, a, b in zip(tokens.text, tokens.starts, tokens.ends)]
    assert got == [(k, m) for k, t in enumerate(texts) for m in re.findall(r"\w+|[^\w\s]", t)]
    # The same features wherever a text stands.
    alone = secrets.Tokens(texts[2:]).features
    assert (tokens.features[tokens.text == 2] == alone).all()


@pytest.fixture(scope="module")
def some_docs(spark):
    rng = random.Random(4)
    rows = [(k, f"{text_of(rng, 30)}. {text_of(rng, 40)}") for k in range(1500)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_secrets_are_found_in_texts_not_trained_on(spark, some_docs):
    model = secrets.train(*secrets.labelled(secrets.training_windows(some_docs)))
    rng = random.Random(77)
    clean = [text_of(rng, 25).title() for _ in range(800)]
    held_out = secrets.with_plants([(t, 0, []) for t in clean], seed=101)
    wanted = [set(spans) for _, _, spans in held_out]
    got = [set(g) for g in secrets.tagged(model, [t for t, _, _ in held_out])]
    hit = sum(len(w & g) for w, g in zip(wanted, got))
    missed = [t for (t, _, _), w in zip(held_out, wanted) if w and not secrets.base_spans(t)]
    assert len(missed) > 400, "most are in forms that the patterns do not know"
    assert hit >= 0.9 * sum(map(len, wanted))
    assert hit >= 0.9 * sum(map(len, got))


def test_added_spans_overlap_no_base_span():
    base = [(10, 0, 60), (20, 2, 50), (70, 2, 90)]
    found = [(0, 10), (5, 11), (15, 18), (55, 58), (60, 70), (65, 71), (95, 99)]
    free = [(a, 3, b) for a, b in found if all(b <= s or a >= e for s, _, e in base)]
    assert secrets.with_added(base, sorted(found)) == sorted(base + free)


def test_find_keeps_rows_and_base_spans(spark, some_docs, edge_docs, no_docs):
    secret = "the passphrase is mT9kQ2xv8RzLw4Np7Yb3 and password = 'hunter2hunter2'"
    rows = some_docs.unionByName(edge_docs.select("doc_id", "text")).unionByName(
        spark.createDataFrame([(-5, secret), (-5, secret)], "doc_id long, text string"))
    found = secrets.find(rows.withColumn("spans", rows.text)).collect()
    assert len(found) == 1502 + edge_docs.count()
    texts = {(r.doc_id, r.text) for r in rows.collect()}
    for r in found:
        assert any(d == r.doc_id and [(s.start, secrets.KINDS.index(s.kind), s.end) for s in r.base] == by_hand(t or "")
                   for d, t in texts if t is None or len(t) < 100_000)
        assert set(map(tuple, r.base)) <= set(map(tuple, r.spans))
    planted = [r for r in found if r.doc_id == -5]
    assert len(planted) == 2 and planted[0].spans == planted[1].spans
    assert [s.kind for s in planted[0].spans] == ["tagged", "assign"]
    assert secret[planted[0].spans[0].start:planted[0].spans[0].end] == "mT9kQ2xv8RzLw4Np7Yb3"
    assert secrets.find(no_docs).count() == 0


def test_query_digests(spark):
    got = {(r.doc_id, r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in LLM_QUERIES["op11_secret_scan"](spark, SF_DIR).collect()}
    want = set()
    for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect():
        spans = by_hand(r.text or "")
        joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        want.add((r.doc_id, hashlib.sha256(joined.encode()).hexdigest(), *[sum(k == x for _, x, _ in spans) for k in range(3)]))
    assert got == want
