"""Operators that look at all documents: near-duplicates, templates, sampling, benchmark, language model."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F
from text_fixtures import edge_docs, no_docs, text_of  # noqa: F401  (fixtures)

import corpus_pipeline
from clickengine.llm import components, decontaminate, importance, minmax, ppm, templates

DOC = "doc_id long, text string"


# --- near-duplicates --------------------------------------------------------------------


def shingles_by_hand(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components_by_hand(rows, size):
    sets = [shingles_by_hand(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [(d, len(sets[i]), d if not sets[i] else least.get(top(i))) for i, (d, _) in enumerate(rows)]


def family(rng, base, n, edits):
    """Variants of a text in which some words are replaced."""
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [512, 16])
def test_components_equal_all_pairs(spark, edge_docs, monkeypatch, block):
    monkeypatch.setattr(minmax, "BLOCK", block)
    rng = random.Random(3)
    texts = family(rng, text_of(rng, 60), 60, 6) + family(rng, text_of(rng, 150), 40, 14) + [text_of(rng, 40)] * 20
    texts += [text_of(rng, 50) for _ in range(30)] + ["one two three", "One  two THREE", "one two", "a b c d e", "a b c d e f"]
    rows = [(1000 + i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    got = minmax.near_duplicates(spark.createDataFrame(rows, DOC), size=4)
    want = components_by_hand(rows, 4)
    assert rows_of(got.select("doc_id", "n_shingles", "component_id")) == sorted(want, key=repr)
    assert rows_of(got.select("doc_id", "kept")) == sorted([(d, d == c) for d, _, c in want], key=repr)


def test_exhaustive_links_join_what_stars_missed(spark):
    """A chain whose ends are unlike: every class only links with its neighbours."""
    rows = []
    for i in range(12):
        hashes = np.arange(i * 4, i * 4 + 50, dtype=np.uint64)
        rows.append((1, i, i, hashes.tobytes()))
    df = spark.createDataFrame(rows, "bucket long, node long, component long, hashes binary")
    links = minmax.exhaustive_links(df, (80, 100))
    assert {r["component"] for r in components.components(links).collect()} == {0}
    assert links.count() < 12


def test_components_of_links(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (102, 101)]
    got = dict(rows_of(components.components(spark.createDataFrame(links, "a long, b long"))))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_signature_estimates_similarity():
    rng = random.Random(9)
    base = text_of(rng, 400)
    for other in family(rng, base, 5, 30):
        hashes, counts = minmax.shingle_hashes([base, other], 4)
        a, b = minmax.signatures(hashes, counts)
        x, y = shingles_by_hand(base, 4), shingles_by_hand(other, 4)
        assert abs((a == b).mean() - len(x & y) / len(x | y)) < 0.15


def test_no_documents(spark, no_docs):
    assert minmax.near_duplicates(no_docs).count() == 0
    assert templates.drop_recurring_lines(no_docs).count() == 0
    assert ppm.score(no_docs).count() == 0
    benchmark = spark.createDataFrame([(1, "some item of the benchmark")], "item_id long, text string")
    assert decontaminate.contaminated(no_docs, benchmark).count() == 0
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert importance.classify(no_docs, labels).count() == 0


# --- line templates ---------------------------------------------------------------------


def test_recurring_templates_go_but_copies_stay(spark):
    rng = random.Random(8)
    passage = text_of(rng, 60)
    rows = []
    for i in range(12):  # own lines around a passage and a line with a number
        lines = [text_of(rng, 20) for _ in range(4)]
        lines.insert(2, passage)
        lines.append(f"page {i} of the long report printed on day {i * 7}")
        rows.append((i, "\n".join(lines)))
    copy = "\n".join(text_of(rng, 15) for _ in range(6))
    rows += [(100 + i, copy) for i in range(20)]
    rows += [(200 + i, "\n".join([*copy.split("\n")[:5], text_of(rng, 15)])) for i in range(5)]
    rows += [(300, None), (301, ""), (302, "short"), (None, text_of(rng, 30))]
    docs = spark.createDataFrame(rows, DOC).withColumn("template", F.lit(1)).withColumn("drops", F.lit("x"))
    got = {r["doc_id"]: r for r in templates.drop_recurring_lines(docs).collect()}
    before = dict(rows)
    assert got[0]["text"] == before[0] and got[0]["n_dropped"] == 0
    for i in range(1, 12):
        assert got[i]["n_dropped"] == 2 and got[i]["text"].split("\n") == [
            x for x in before[i].split("\n") if x != passage and not x.startswith("page ")]
    for d, text in before.items():
        if d is None or d >= 100:
            assert got[d]["text"] == text and got[d]["n_dropped"] == 0


def tree_tokens(line):
    return ["<*>" if any(c in "0123456789" for c in t) else t for t in words_of(line)]


def words_of(line):
    return [w for w in line.replace("\t", " ").split(" ") if w]


def templates_by_hand(texts):
    """Line as tokens -> template, from all lines of a leaf at once."""
    leaves = defaultdict(lambda: defaultdict(set))
    for d, text in enumerate(texts):
        for line in text.split("\n"):
            t = tuple(tree_tokens(line))
            if len(t) >= 5:
                leaves[len(t), t[:3]][t].add(d)
    out = {}
    for (n, _), lines in leaves.items():
        if len(lines) < 2:
            continue
        held = Counter((i, w) for t, ds in lines.items() for i, w in enumerate(t) for _ in ds)
        for t in lines:
            shape = tuple(w if i < 3 or held[i, w] >= (2 if n >= 50 else 3) else None for i, w in enumerate(t))
            if sum(w is not None for w in shape) >= 0.8 * n - 1e-9:
                out[t] = shape
    return out


def named_groups(spark, texts):
    """Sets of lines (as tokens) that share a template."""
    docs = spark.createDataFrame(list(enumerate(texts)), DOC)
    named = {r["line"]: r["template"] for r in templates.templates_of(docs, templates.parsed_lines(docs)).collect()}
    groups = defaultdict(set)
    for t in {tuple(tree_tokens(x)) for text in texts for x in text.split("\n")}:
        line = templates._hash(" ".join(t).encode())
        if line in named:
            groups[named[line]].add(t)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("n", [10, 400, 5000])
def test_templates_are_the_same_for_leaves_of_any_size(spark, n):
    rng = random.Random(n)
    names = [f"{rng.choice('bcdf')}{rng.choice('aeiou')}x{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(n)]
    texts = []
    for i, name in enumerate(names):
        kind = i % 5
        if kind < 2:
            texts.append(f"posted in the forum by {name} on the last day")
        elif kind == 2:
            texts.append(f"posted in the {' '.join(rng.choice(names) for _ in range(6))} day")
        elif kind == 3:
            texts.append(f"posted in the garden near {rng.choice(names[:4])} at noon with {name}\nposted in the")
        else:
            texts.append(" ".join(["a", "b", "c", *rng.choices("pqrstuvw", k=rng.choice((2, 5)))]))
    want = defaultdict(set)
    for t, shape in templates_by_hand(texts).items():
        want[shape].add(t)
    assert named_groups(spark, texts) == sorted(map(sorted, want.values()))
    assert any(len(g) >= 0.3 * n for g in want.values())


def test_unlike_lines_of_one_leaf_all_stay(spark):
    """A thousand lines that agree in three of five places."""
    rng = random.Random(31)
    texts = []
    for i in range(1000):
        x, y = (f"{c}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for c in "xy")
        texts.append(f"{text_of(rng, 12)}\nthe shop sells {x} {y}\n{text_of(rng, 14)}")
    assert sum(dropped(spark, texts)) == 0


def test_lines_of_edge_documents(spark, edge_docs):
    docs = edge_docs.withColumn("__id", F.lit(1)).withColumn("template", F.lit("t")).withColumn("place", F.lit(5))
    docs = docs.unionByName(docs.where("doc_id IS NULL"))
    rows = templates.drop_recurring_lines(docs).collect()
    assert len(rows) == docs.count() and all(r["n_dropped"] == 0 for r in rows)
    assert sorted(r["text"] or "" for r in rows) == sorted(r["text"] or "" for r in docs.collect())


def dropped(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), DOC)
    return [r["n_dropped"] for r in templates.drop_recurring_lines(docs).orderBy("doc_id").collect()]


def test_pages_of_boilerplate_lose_it(spark):
    """Only a copy of one other document is spared, and no document for its lines being found here and there."""
    rng = random.Random(21)
    first, second = text_of(rng, 60), text_of(rng, 60)
    pages = [f"{text_of(rng, 40)}\n{first}\n{second}" for _ in range(4)]
    alone = [text_of(rng, 20) for _ in range(1)] * 4
    texts = [*pages, *alone, *[text_of(rng, 40) for _ in range(5)]]
    assert dropped(spark, texts) == [0, 2, 2, 2, 0, 1, 1, 1] + [0] * 5


def test_short_lines_recur(spark):
    rng = random.Random(22)
    texts = [f"Home\n{text_of(rng, 20)}\nAll rights reserved.\nPage {i}\n" for i in range(5)] + [f"Only\n{text_of(rng, 9)}"]
    assert dropped(spark, texts) == [0, 3, 3, 3, 3, 0]


def test_long_lines_are_compared_at_all_places(spark):
    """Lines that differ in every second token but not in those spread evenly."""
    a = [f"w{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(96)]
    same = {i * 96 // 32 for i in range(32)} | {0, 1, 2}
    other = [w if i in same else "q" + w for i, w in enumerate(a)]
    assert named_groups(spark, [" ".join(a), " ".join(other)]) == []


def test_helper_columns_make_way_for_the_documents_own(spark, edge_docs):
    """Columns named like the operators' own, null ids repeated, and a text of 30,001 words."""
    names = ["__id", "__doc", "__drops", "___id", "doc", "line_no", "template"]
    again = edge_docs.where("doc_id IS NULL")
    docs = edge_docs.unionByName(again).select("*", *[F.lit(n).alias(n) for n in names])
    plain = docs.select("doc_id", "text")
    lines = templates.drop_recurring_lines(docs)
    assert lines.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert rows_of(lines, "doc_id", "text", "n_lines", "n_dropped") == rows_of(
        templates.drop_recurring_lines(plain), "doc_id", "text", "n_lines", "n_dropped")
    marks = spark.createDataFrame([(1, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "Hello wide world, this is a text of some words.")], "item_id long, text string")
    for got, want in ((importance.resample(docs, marks), importance.resample(plain, marks)),
                      (decontaminate.without_benchmark(docs, items), decontaminate.without_benchmark(plain, items))):
        assert got.columns == docs.columns
        assert rows_of(got, "doc_id", "text") == rows_of(want, "doc_id", "text")
        assert {r["__id"] for r in got.select("__id").collect()} <= {"__id"}


# --- importance resampling ---------------------------------------------------------------


def test_top_k_by_hand(spark):
    rng = random.Random(1)
    rows = [(i, i, float(rng.randrange(50)) / 7) for i in range(400)] + [(None, 400, 3.0), (5, 401, 3.0)]
    keyed = spark.createDataFrame(rows, "doc_id long, place long, key double")
    order = sorted(rows, key=lambda r: (-r[2], r[0] if r[0] is not None else math.inf, r[1]))
    for k in (0, 1, 57, 200, 401, 402, 1000):
        kept = {r["place"] for r in importance.top_k(keyed, k).where("kept").collect()}
        assert kept == {r[1] for r in order[:k]}


def test_bad_text_is_drawn_less(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        words = text_of(rng, 80).split()
        if bad:
            for _ in range(12):
                words[rng.randrange(80)] = rng.choice(["awful", "stupid", "$$$", "!!!"])
        rows.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, 0 if bad and i % 8 else 1, 1 if bad and not i % 8 else 0))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, "")], DOC)
    marks = spark.createDataFrame([*labels, (None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in importance.classify(docs, marks).collect()}
    assert len(got) == 602 and got[1000]["log_weight"] == got[1001]["log_weight"] == 0.0
    held = [i for i in range(600) if i % 3 == 0]
    assert sum(got[i]["kept"] for i in held if i % 4 == 0) <= 0.1 * 50
    assert sum(got[i]["kept"] for i in held if i % 4) >= 0.9 * 150
    kept = sorted(r["doc_id"] for r in importance.resample(docs, marks).collect())
    assert kept == sorted(d for d, r in got.items() if r["kept"])


def weights_by_hand(texts, good):
    """Log weights from counts of the n-grams themselves, without buckets."""
    def grams(text):
        words = [w for w in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
        return Counter(words) + Counter(zip(words, words[1:]))

    raw, target = Counter(), Counter()
    for i, text in texts:
        raw += grams(text)
        if i in good:
            target += grams(text)
    share = sum(target.values()) / sum(raw.values())
    out = {}
    for i, text in texts:
        total = 0.0
        for g, n in grams(text).items():
            expected = raw[g] * share
            if abs(target[g] - expected) >= importance.DEVIATIONS * math.sqrt(expected + 1):
                total += n * math.log((target[g] + importance.SMOOTHING) / (expected + importance.SMOOTHING))
        out[i] = total
    return out


def test_weights_by_hand(spark, edge_docs):
    rng = random.Random(12)
    extra = ("Junk JUNK !! spam", "so and thus", "whereas hence Thus")
    texts = [(100 + i, " ".join([text_of(rng, rng.randrange(60)), *rng.choices(extra[(100 + i) % 3].split(), k=rng.randrange(40))]))
             for i in range(300)]
    texts += [(9, None), (10, ""), (11, " \t "), (12, "naïve CAFÉ café 日本")]
    good = {i for i, _ in texts if i % 3 == 2}
    docs = spark.createDataFrame(texts, DOC)
    marks = spark.createDataFrame([(i, int(i in good), 0) for i, _ in texts], "doc_id long, quality int, toxic int")
    weights, share = importance.weigh(docs, marks)
    got = {r["doc_id"]: r["log_weight"] for r in weights.collect()}
    want = weights_by_hand(texts, good)
    assert share == pytest.approx(len(good) / len(texts)) and len(set(want.values())) > 100
    assert got == {i: pytest.approx(w, rel=1e-4, abs=1e-4) for i, w in want.items()}
    # Clashing names, nulls, repeated rows and a text of 30,001 words.
    marks = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")
    kept = importance.resample(edge_docs, marks)
    assert kept.columns == edge_docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in importance.classify(edge_docs, marks).where("kept").collect()}
    assert importance.resample(edge_docs, marks.limit(0)).count() == edge_docs.count()


# --- benchmark --------------------------------------------------------------------------


def test_lcs_by_hand():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcd").encode() for _ in range(rng.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.lcs(a, b) == table[-1][-1]


def test_items_are_found_whole_and_paraphrased(spark, edge_docs):
    rng = random.Random(5)

    def strange(n):
        return [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('klmnp')}{rng.choice('aeiou')}{rng.randrange(30)}" for _ in range(n)]

    items = [(i, " ".join(strange(rng.randrange(15, 130)))) for i in range(40)] + [(90, None), (91, ""), (92, "two words")]
    rows, want = [], set()
    for d in range(60):
        text = strange(rng.randrange(0, 400))
        if d % 2:
            k = rng.randrange(40)
            item = items[k][1].split()
            if d % 4 == 1:  # changed and left out words
                for _ in range(len(item) // 8):
                    item[rng.randrange(len(item))] = "changed"
                del item[rng.randrange(len(item))]
            at = rng.randrange(len(text) + 1)
            text[at:at] = [w.capitalize() + rng.choice(["", ".", ",\n"]) for w in item]
            want.add((d, k))
        rows.append((d, " ".join(text)))
    rows += [(200, "Only TWO words here"), (201, "two other words")]
    want.add((200, 92))
    docs = edge_docs.selectExpr("doc_id + 1000 AS doc_id", "text").union(spark.createDataFrame(rows, DOC))
    got = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
    clean = decontaminate.without_benchmark(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert clean.count() == docs.count() - len(want)


def test_items_are_found_whatever_their_number(spark, monkeypatch):
    """A space of few directions keeps little of each item, as the full one does of very many."""
    monkeypatch.setattr(decontaminate, "RANK", 4)
    rng = random.Random(15)

    def strange(n):
        return [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('klmnp')}{rng.choice('aeiou')}{rng.randrange(30)}" for _ in range(n)]

    items = [(i, " ".join(strange(rng.randrange(6, 60)))) for i in range(300)]
    rows = []
    for d in range(300):
        text, item = strange(200), items[d][1].split()
        if d % 2:  # a fifth of the words changed, but none of the item's first ones
            for i in range(len(item) // 5):
                item[5 * i + 4] = "changed"
        text[d % 200:d % 200] = item
        rows.append((d, " ".join(text)))
    got = decontaminate.contaminated(spark.createDataFrame(rows, DOC), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} >= {(d, d) for d in range(300)}


def test_the_best_stretch_is_sought_word_by_word():
    rng = random.Random(6)
    for _ in range(300):
        item = [rng.choice("abcdefghij").encode() for _ in range(rng.randrange(6, 20))]
        region = [rng.choice("abcdefghijklmnopqrst").encode() for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.7:
            at = rng.randrange(len(region) + 1)
            planted = list(item)
            for _ in range(rng.randrange(1 + len(item) // 2)):  # spread out by other words
                planted.insert(rng.randrange(len(planted) + 1), b"zz")
            region[at:at] = planted
        width = math.ceil(1.5 * len(item))
        best = max((decontaminate.lcs(item, region[i:i + width]) for i in range(len(region))), default=0)
        assert decontaminate.best_stretch(item, region) == (best if best >= math.ceil(0.7 * len(item) - 1e-9) else 0)


def test_the_space_decides_what_is_tried(spark, monkeypatch):
    """Without directions nothing is near; the exact way, and items that the space does not keep, are found all the same."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")

    def pairs(**how):
        return {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items, **how).collect()}

    exact = pairs(exact=True)
    assert len(exact) > 20 and pairs() == exact
    basis = decontaminate.latent_basis
    monkeypatch.setattr(decontaminate, "latent_basis", lambda *a: basis(*a) * 0)
    assert pairs() == pairs(exact=True) == exact  # every item is left to the index
    monkeypatch.setattr(decontaminate, "PLANTED", math.inf)
    monkeypatch.setattr(decontaminate, "latent_basis", lambda *a: basis(*a) * 1e-9)
    monkeypatch.setattr(decontaminate, "COSINE", 0.99)
    lost = pairs()
    assert len(lost) < len(exact) and pairs(exact=True) == exact


# --- language model ---------------------------------------------------------------------


@pytest.mark.parametrize("hot", [1 << 18, 3])
def test_scores_by_hand(spark, edge_docs, monkeypatch, hot):
    monkeypatch.setattr(ppm, "HOT", hot)
    rng = random.Random(7)
    rows = [(i, text_of(rng, rng.randrange(30)) + rng.choice(["", " é", "\n\tzz", " Q"])) for i in range(60)]
    rows += [(r["doc_id"], r["text"] or "") for r in edge_docs.where("doc_id is null or doc_id <> 5").collect()]
    docs = spark.createDataFrame(rows, DOC)
    got = defaultdict(list)
    for r in ppm.score(docs).collect():
        got[r["doc_id"]].append(r)
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows}
    counts, trie = Counter(), [defaultdict(Counter) for _ in range(3)]
    for d, t in rows:
        if not held[d]:
            counts.update([*t.encode().lower().split(), None])
            b = b"\0\0" + t.encode()
            for i in range(2, len(b)):
                for k in range(3):
                    trie[k][b[i - k:i]][b[i]] += 1
    total, kinds = sum(counts.values()), len(counts)

    def code(context, symbol):
        out, gone = 0.0, set()
        for k in (2, 1, 0):
            seen = trie[k].get(context[2 - k:], {})
            left = {s: n for s, n in seen.items() if s not in gone}
            both = sum(left.values()) + len(left)
            if symbol in left:
                return out + math.log10(left[symbol] / both)
            if left:
                out += math.log10(len(left) / both)
            gone |= set(seen)
        return out - math.log10(256 - len(trie[0][b""]))

    for d, t in rows:
        r = got[d].pop()
        tokens = [*t.encode().lower().split(), None]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[d], len(tokens), total)
        if not got[d] and sum(x == d for x, _ in rows) == 1:
            b = b"\0\0" + t.encode()
            assert r["n_known"] == sum(counts[w] > 0 for w in tokens)
            assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens))
            assert r["score"] == pytest.approx(sum(code(b[i - 2:i], b[i]) for i in range(2, len(b))), rel=1e-5, abs=1e-5)


@pytest.mark.parametrize("cells", [1 << 24, 2000, 0])
def test_contexts_of_three_bytes_by_hand(spark, edge_docs, monkeypatch, cells):
    monkeypatch.setattr(ppm, "CELLS", cells)
    rng = random.Random(17)
    rows = [(i, text_of(rng, rng.randrange(30)) + rng.choice(["", " é", "\n\tzz", " Q"])) for i in range(60)]
    rows += [(1000 + i, r["text"] or "") for i, r in enumerate(edge_docs.where("doc_id is null or doc_id <> 5").collect())]
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows}
    trie = [defaultdict(Counter) for _ in range(4)]
    for d, t in rows:
        b = b"\0\0\0" + t.encode()
        for i in range(3, len(b) if not held[d] else 0):
            for k in range(4):
                trie[k][b[i - k:i]][b[i]] += 1

    def code(context, symbol):
        out, gone = 0.0, set()
        for k in (3, 2, 1, 0):
            seen = trie[k].get(context[3 - k:], {})
            left = {s: n for s, n in seen.items() if s not in gone}
            both = sum(left.values()) + len(left)
            if symbol in left:
                return out + math.log10(left[symbol] / both)
            if left:
                out += math.log10(len(left) / both)
            gone |= set(seen)
        return out - math.log10(256 - len(trie[0][b""]))

    got = {r["doc_id"]: r["score"] for r in ppm.score(spark.createDataFrame(rows, DOC), order=3).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        b = b"\0\0\0" + t.encode()
        assert got[d] == pytest.approx(sum(code(b[i - 3:i], b[i]) for i in range(3, len(b))), rel=1e-5, abs=1e-4)


def test_probabilities_add_up_to_one():
    rng = np.random.default_rng(3)
    grams = np.unique(rng.integers(0, 1 << 24, 400) & 0x070F1F)
    values = ppm.code_lengths(grams, rng.integers(1, 9, len(grams))).reshape(-1, 256).astype(float)
    assert np.allclose((10 ** values).sum(axis=1)[:2000], 1, atol=1e-4)


# --- pipeline ---------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    """Every stage on a small corpus with a case for each."""
    rng = random.Random(12)
    item = " ".join(f"zeta{rng.randrange(500)}" for _ in range(30))
    passage = text_of(rng, 55)
    rows = [(i, "\n".join(text_of(rng, 40) for _ in range(3))) for i in range(200)]
    for i in range(0, 40, 2):
        rows[i] = (i, rows[i][1] + "\n" + passage)
    rows[51] = (51, rows[51][1] + "\n" + item)
    rows += [(300 + i, rows[101][1]) for i in range(15)]
    rows += [(400 + i, " ".join("$$$ ### stupid !!!".split() * 20)) for i in range(40)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i in range(150)] + [(400 + i, 0, 1) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen = {}
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"]: r for r in now.collect()}
        if name != "sentencepiece":
            assert now.columns == docs.columns
    first, lines, near, clean, last = seen.values()
    assert not any(d >= 400 for d in first) and sum(d < 200 for d in first) >= 190
    holders = [d for d, r in lines.items() if passage in r["text"]]
    assert set(lines) == set(first) and len(holders) == 1
    copies = {d for d in lines if d >= 300 or d == 101}
    assert set(lines) - set(near) == copies - {min(copies)}
    assert set(near) - set(clean) == {51} & set(near) and set(last) == set(clean)
    whole = rows_of(corpus_pipeline.run(spark, str(tmp_path)))
    assert whole == rows_of(spark.read.parquet(str(tmp_path / "sentencepiece")))
