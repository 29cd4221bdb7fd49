"""Token links against a plain double loop over token byte ranges."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from text_fixtures import edge_docs, no_docs  # noqa: F401  (fixtures)
from tokenizers import Tokenizer

from clickengine.llm import alignment
from clickengine.llm.queries import byte_model, piece_model

TEXTS = [
    "Hello wide world, this is a text.", "Hello wide world, this is a text.", None, "", " ", "naïve café 日本 \U0001F600 ﬁn\x00z",
    "<|endoftext|> and <s>plain</s> <unk> <0x41> text", "a▁b", "tab\tand\nlines\r\n  two  spaces ", "the theory of their thermal thing",
    "x" * 700, "日本語の文章" * 40, "1234567890 3.14159 0x1f", "don't we'll they've",
]


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.Pair(byte_model(), piece_model())


def plain(texts):
    """Per text: a ids, b ids, groups as text, links as (a place, b place, shared bytes)."""
    byte = Tokenizer.from_file(byte_model())
    byte.encode_special_tokens = True
    piece = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    letters = alignment.byte_letters()
    out = []
    for text in texts:
        if not text:
            out.append(([], [], "", []))
            continue
        whole = byte.encode(" " + text, add_special_tokens=False)
        a, b = whole.ids, piece.encode(text)
        a_bytes = [bytes(letters[c] for c in byte.id_to_token(k)) for k in a]
        b_bytes = [bytes([int(piece.id_to_piece(k)[3:5], 16)]) if piece.is_byte(k) else piece.id_to_piece(k).replace("▁", " ").encode()
                   for k in b]
        if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            out.append(([], [], "", []))
            continue
        ranges = []
        for side in (a_bytes, b_bytes):
            at, found = 0, []
            for t in side:
                found.append((at, at + len(t)))
                at += len(t)
            ranges.append(found)
        links = [(i, j, min(e, g) - max(s, f)) for i, (s, e) in enumerate(ranges[0]) for j, (f, g) in enumerate(ranges[1])
                 if s < g and f < e]
        cuts = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
        groups, before = [], 0
        for cut in cuts:
            sides = [",".join(str(k) for k, (s, e) in zip(ids, found) if before <= s and e <= cut) for ids, found in zip((a, b), ranges)]
            groups.append("|".join(sides))
            before = cut
        out.append((a, b, ";".join(groups), links))
    return out


def test_every_text_links_as_the_double_loop(spark, tokenizers):
    found = alignment.aligned(tokenizers, [t or "" for t in TEXTS])
    groups, n_groups = alignment.group_texts(found)
    rows = np.repeat(np.arange(found.links.rows), np.diff(found.links.starts))
    for k, (a, b, text, links) in enumerate(plain(TEXTS)):
        p, q, r, s = found.a_at[k], found.a_at[k + 1], found.b_at[k], found.b_at[k + 1]
        assert (found.a_ids[p:q].tolist(), found.b_ids[r:s].tolist()) == (a, b)
        assert groups[k].as_py() == text and n_groups[k] == (text.count(";") + 1 if text else 0)
        mine = (rows >= p) & (rows < q)
        assert list(zip((rows[mine] - p).tolist(), (found.links.columns[mine] - r).tolist(), found.shared[mine].tolist())) == links


def test_the_query_counts_links_over_all_texts(spark, tokenizers):
    docs = spark.createDataFrame([(k if k else None, t, "n") for k, t in enumerate(TEXTS)], "doc_id long, text string, pairs string")
    facts = plain(TEXTS)
    counts = Counter((a[i], b[j]) for a, b, _, links in facts for i, j, _ in links)
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    want = []
    for k, (a, b, text, links) in enumerate(facts):
        pairs = [(a[i], b[j]) for i, j, _ in links]
        want.append((k if k else None, len(a), len(b), text.count(";") + 1 if text else 0, len(links),
                     sum(counts[x] == most[x[1]] for x in pairs), sum(counts[x] for x in pairs),
                     hashlib.sha256(text.encode()).hexdigest() if text else ""))
    got = alignment.digests(docs, byte_model(), piece_model())
    assert sorted(map(tuple, got.drop("n_group_links").collect()), key=repr) == sorted(want, key=repr)
    # The same with few pairs, and none, held where the texts are.
    texts = alignment.stored(alignment.align(docs, byte_model(), piece_model()), "texts")
    for held in (0, 20):
        few = alignment.with_pair_counts(texts, len(tokenizers.b_bytes), held).select("doc_id", "n_best", "count_sum")
        assert sorted(map(tuple, few.collect()), key=repr) == sorted(((w[0], w[5], w[6]) for w in want), key=repr)


def test_empty_and_edge_tables(spark, no_docs, edge_docs):
    assert alignment.digests(no_docs, byte_model(), piece_model()).count() == 0
    rows = alignment.digests(edge_docs, byte_model(), piece_model()).collect()
    assert len(rows) == edge_docs.count()
    zeros = [r for r in rows if r.doc_id in (2, 3)]
    assert all(tuple(r)[1:7] == (0,) * 6 and r.groups_sha256 == "" for r in zeros) and len(zeros) == 2


def test_links_of_a_group_come_in_blocks(tokenizers):
    text = "thermal " * 3
    found = alignment.aligned(tokenizers, [text])
    a, b = found.a_groups.columns, found.b_groups.columns
    want = {(i, j) for i in range(len(a)) for j in range(len(b)) if a[i] == b[j]}
    got = [x for i, j, _ in alignment.links_of(tokenizers, text, same_group=True) for x in zip(i.tolist(), j.tolist())]
    assert len(got) == len(want) and set(got) == want


matrices = st.integers(1, 6).flatmap(lambda w: st.lists(st.sets(st.integers(0, w - 1)), min_size=1, max_size=6).map(lambda r: (w, r)))


def csr(width, rows):
    return alignment.Csr(alignment.offsets_of(np.array([len(r) for r in rows])), np.array([c for r in rows for c in sorted(r)], np.int64), width)


def dense(m, values=None):
    out = np.zeros((m.rows, m.width), int)
    out[np.repeat(np.arange(m.rows), np.diff(m.starts)), m.columns] = 1 if values is None else values
    return out


@settings(max_examples=100, deadline=None)
@given(matrices, st.data())
def test_products_equal_dense_ones(left, data):
    width, rows = left
    right = data.draw(st.integers(1, 5).flatmap(lambda w: st.lists(
        st.sets(st.integers(0, w - 1)), min_size=width, max_size=width).map(lambda r: csr(w, r))))
    left = csr(width, rows)
    want = dense(left) @ dense(right)
    got, values = alignment.product(left, right)
    assert (dense(got, values) == want).all() and len(values) == (want > 0).sum()
    assert (dense(left.transpose()) == dense(left).T).all()
    blocks = [(first, *m) for first, m in alignment.product_blocks(left, right, 3)]
    assert (np.vstack([dense(m, v) for _, m, v in blocks]) == want).all()
    assert [f for f, _, _ in blocks] == np.cumsum([0] + [m.rows for _, m, _ in blocks])[:-1].tolist()
