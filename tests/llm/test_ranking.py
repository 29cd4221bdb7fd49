"""Ranked search against a plain score of every document, and the tree's bounds against its documents."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from text_fixtures import edge_docs, no_docs, text_of  # noqa: F401  (fixtures)

from clickengine.llm import ranking

ITEM = "item_id long, text string"


def terms(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if ord(c) >= 128 or (c.isascii() and c.isalnum()):
            word += c.lower() if c.isascii() else c
        elif word:
            out.append(word)
            word = ""
    return out


def by_hand(docs, items, most=20):
    """Rows (item_id, rank, doc_id, score) for different items."""
    found = [(k, terms(t)) for k, t in docs]
    n_docs, total = sum(bool(t) for _, t in found), sum(len(t) for _, t in found)
    df = Counter(w for _, t in found for w in set(t))
    out = []
    for item, text in sorted(set(items), key=repr):
        asked, scored = Counter(terms(text)), []
        for doc, words in found:
            if not words:
                continue
            tf, m = Counter(words), 75 + 25 * len(words) * n_docs // total
            score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (
                1_000_000_000 * tf[w] // (1000 * tf[w] + 12 * m)) for w, r in asked.items() if tf[w])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, row[3], -row[0]) for k, row in enumerate(sorted(scored)[:most])]
    return out


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.fixture
def corpus(spark):
    rng = random.Random(8)
    texts = [text_of(rng, rng.randint(1, 60)) for _ in range(150)]
    texts += [texts[3]] * 60 + [f"{texts[5]} {k}" for k in range(40)] + ["", None, "!?", "Straße ÀÉ naïve 日本 x1"]
    rng.shuffle(texts)
    docs = [(k, t) for k, t in enumerate(texts)] + [(None, texts[0]), (None, "alone here"), (7, texts[7])]
    items = [(k, " ".join(rng.choice(texts).split()[:8]) if rng.random() < 0.5 else text_of(rng, 9))
             for k, texts in enumerate([[t for t in texts if t]] * 25)]
    items += [(100, "the the the dog the"), (101, ""), (102, None), (103, "zzz nowhere"), (104, "ÀÉ straße STRAßE 日本"),
              (105, "alone"), (None, "the quick fox"), (3, "the second text of an id"), (100, "the the the dog the")]
    return docs, items


def test_every_item_ranks_as_by_plain_scores(spark, corpus):
    docs, items = corpus
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, ITEM)
    want = sorted(by_hand(docs, items), key=repr)
    # Two items of one id keep a list each.
    assert rows(ranking.rank(d.withColumn("item", d.text).withColumn("score", d.doc_id), i.withColumn("rank", i.text))) == want
    assert rows(ranking.rank(d, i, items_per_pass=6)) == want
    assert rows(ranking.rank(d, i, most=3)) == sorted(by_hand(docs, items, 3), key=repr)


@pytest.mark.parametrize("bucket", [1, 3, 16])
def test_bounds_hold_and_leaves_cover_all_documents(bucket):
    rng = np.random.default_rng(bucket)
    n, width = 300, 40
    lengths = rng.integers(0, 12, n)
    lengths[50:120] = 4
    terms_ = [np.sort(rng.choice(width, k, replace=False, p=np.arange(width, 0, -1) / (width * (width + 1) / 2))) for k in lengths]
    for k in range(50, 120):
        terms_[k] = np.array([0, 2, 5, 9])
    at = ranking.offsets_of(lengths)
    flat = np.concatenate(terms_)
    block = ranking.sorted_block(
        np.arange(n), np.zeros(n, bool), rng.integers(75, 400, n), at, flat, rng.integers(1, 9, len(flat)))
    paths = [block.terms[block.at[k]:block.at[k + 1]].tolist() for k in range(n)]
    assert paths == sorted(paths)
    weights = rng.integers(0, 20_000, (width, 7)).astype(float)
    nodes = ranking.tree_of(block, bucket)
    bounds = ranking.bounds_of(block, nodes, weights)
    value = ranking.shares_of(block.tfs.astype(np.int64), np.repeat(block.m, np.diff(block.at)))
    scores = np.array([(value[a:b, None] * weights[block.terms[a:b]]).sum(axis=0) for a, b in zip(block.at[:-1], block.at[1:])])
    covered = []
    for k, node in enumerate(nodes):
        assert (scores[node.first:node.last].max(axis=0) <= bounds[k]).all()
        if node.children:
            ends = [(nodes[c].first, nodes[c].last) for c in node.children]
            assert ends[0][0] == node.first and ends[-1][1] == node.last
            assert all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
        else:
            covered.append((node.first, node.last))
            assert node.last - node.first <= bucket or len(set(map(tuple, paths[node.first:node.last]))) == 1
    assert sum(b - a for a, b in covered) == n


def test_search_leaves_most_leaves_alone_when_few_documents_match():
    rng = np.random.default_rng(1)
    n, width = 2000, 60
    lengths = rng.integers(3, 9, n)
    flat = np.concatenate([rng.choice(width - 5, k, replace=False) for k in lengths])
    at = ranking.offsets_of(lengths)
    for k in range(25):
        flat[at[k * 70]] = width - 1
    block = ranking.sorted_block(np.arange(n), np.zeros(n, bool), np.full(n, 100), at, flat, np.ones(len(flat), np.int64))
    weights = np.zeros((width, 1))
    weights[width - 1], weights[:width - 5] = 15_000, 1
    places = [ranking.Places(20)]
    scored = ranking.search(block, [0], weights, places)
    assert len(places[0].rows) == 20
    leaves = sum(not node.children for node in ranking.tree_of(block))
    assert scored < 0.7 * leaves
    # The places carry on to the next block.
    assert ranking.search(block, [0], weights, places) < 0.25 * leaves


def test_groups_are_bounded_and_whole():
    queries = ranking.queries_of([(k, f"a{k} b{k} c{k} shared") for k in range(50)] + [(99, " ".join(f"w{j}" for j in range(30)))])
    n = len(queries.terms)
    groups = ranking.groups_of(queries, np.arange(n), np.ones(n, np.int64), size=7, terms=12)
    assert sorted(i for g in groups for i in g.items) == list(range(51))
    for g in groups:
        weights = g.weights()
        assert len(g.items) == 1 or weights.shape[0] <= 12
        for column, i in enumerate(g.items):
            got = {t: weights[g.number[t], column] for t in range(n) if g.number[t] >= 0 and weights[g.number[t], column]}
            assert got == {t: t * r for t, r in queries.counts[i].items() if t}


def test_empty_and_edge_tables(spark, no_docs, edge_docs, corpus):
    docs, items = corpus
    some, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEM)
    assert ranking.rank(no_docs, i).count() == 0
    assert ranking.rank(some, i.limit(0)).count() == 0
    assert ranking.rank(some, i.where("item_id in (101, 102)")).count() == 0
    edge = [(r.doc_id, r.text) for r in edge_docs.collect()]
    asked = [(1, "hello word"), (2, "null café"), (3, "X" * 5000)]
    assert rows(ranking.rank(edge_docs, spark.createDataFrame(asked, ITEM))) == sorted(by_hand(edge, asked), key=repr)
