"""Operators that look at one document at a time: rules, tokens, personal data, licenses, chat."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import rows_of
from text_fixtures import edge_docs, no_docs  # noqa: F401  (fixtures)
from pyspark.sql import functions as F

from clickengine.llm import chat, licenses, personal, pieces, quality
from clickengine.llm.queries import piece_digests, piece_model

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


# --- quality rules ----------------------------------------------------------------------


def counts_by_hand(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    covered = {p for i, x in enumerate(windows) if n[x] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_base_counts_by_hand(spark, edge_docs):
    rng = random.Random(2)
    more = [(100 + i, "".join(rng.choice(["ab ", "c ", "d\n", "# ", "<x> ", "é\t", "a b c "]) for _ in range(rng.randrange(200))))
            for i in range(40)]
    docs = edge_docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = [(r["doc_id"], *counts_by_hand(r["text"])) for r in docs.collect()]
    assert rows_of(got) == sorted(want, key=repr)


def test_order_of_rules_changes_no_verdict(spark):
    clean = " ".join(f"plain{i} words here" for i in range(30))
    rows = [(1, clean), (2, clean.upper()), (3, clean.replace(" ", " ## ")), (4, clean + "!" * 200), (5, "short text"),
            (6, "a b " * 60), (7, "\n".join(["the same line again"] * 10 + [clean]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    verdicts = [rows_of(quality.measured(docs).select("doc_id", quality.kept_by(order).alias("kept")))
                for order in (quality.RULES, quality.RULES[::-1])]
    assert verdicts[0] == verdicts[1] == [(1, True), *[(i, False) for i in range(2, 8)]]
    assert set(quality.by_rejection_per_cost(docs)) == set(quality.RULES)


def test_rules_on_an_empty_table(no_docs):
    assert quality.judge(no_docs).count() == 0


# --- tokens -----------------------------------------------------------------------------


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


def test_tokens_equal_the_library(spark, edge_docs):
    rng = random.Random(4)
    alphabet = list(" ▁aehinrst\n\té<>0x日😀.,") + ["the ", "ing", "  ", "<0x0A>", "</s>"]
    more = [(200 + i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(120)))) for i in range(120)]
    more += [(400, "th" * 2000), (401, " " * 900), (402, "ab" * 700 + " " + "é" * 600)]
    docs = edge_docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = pieces.decode(pieces.encode(docs, piece_model()), piece_model()).collect()
    sp = library()
    for r in got:
        ids = sp.encode(r["text"] or "")
        assert r["token_ids"] == ids and r["decoded"] == sp.decode(ids), r["text"][:50]


def test_digests(spark):
    text = "Hello  world\n"
    row = piece_digests(spark.createDataFrame([(1, text)], "doc_id long, text string"), piece_model()).first()
    ids = library().encode(text)
    assert row["n_tokens"] == len(ids)
    assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_tokens_keep_columns_and_empty_tables(edge_docs, no_docs):
    out = pieces.encode(edge_docs, piece_model())
    assert out.columns == [*edge_docs.columns, "token_ids"] and out.count() == edge_docs.count()
    assert pieces.encode(no_docs, piece_model()).count() == 0


# --- personal data ----------------------------------------------------------------------


def spans_by_hand(text):
    def luhn(d):
        twice = [int(c) * 2 for c in d[-2::-2]]
        return (sum(int(c) for c in d[-1::-2]) + sum(t - 9 if t > 9 else t for t in twice)) % 10 == 0

    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def test_base_spans_by_hand():
    rng = random.Random(5)
    for _ in range(5000):
        text = "".join(rng.choice("ab1.2 +@-()95%") for _ in range(rng.randrange(70)))
        assert personal.base_spans(text) == spans_by_hand(text), text
    assert personal.base_spans("card 4111 1111 1111 1111, \U0001F600 a@b.co") == [(0, 28, 34), (2, 5, 24)]


def test_long_hostile_texts_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "a@" * 50_000, "+1" * 50_000, "1." * 50_000, "1 " * 50_000):
        personal.base_spans(text)


def sentences(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.randrange(5)
        digits = "".join(rng.choice("0123456789") for _ in range(7))
        what = (f"{rng.choice('abcdef')}{digits[:3]}@mail{digits[3]}.example.com", f"{digits[:2]}.{digits[2:4]}.{digits[4]}.{digits[5:]}",
                "4111 1111 1111 1111", f"+1 ({digits[:3]}) 555-{digits[3:]}", f"order {digits[:4]}")[kind]
        out.append(f"please note that {what} was {'sent again' if rng.random() < 0.5 else 'lost'} on the way")
    return out


def documents_of(folder):
    return [t or "" for t in pq.read_table(f"{folder}/documents.parquet").column("text").to_pylist()]


def made_up(rng, kind):
    """A span of another form than the patterns', from other words than the corpus has."""
    if kind == 0:
        words = ("post", "uni", "stone", "maria", "bill", "web", "carter", "lab")
        name = rng.choice(words) + rng.choice(("", "." + rng.choice(words), str(rng.randrange(99))))
        return personal.altered(rng, 0, f"{name}@{rng.choice(words)}.example.{rng.choice(('com', 'org', 'net'))}", list(words))
    if kind == 2:
        while not personal._luhn(digits := "".join(rng.choice("0123456789") for _ in range(16))):
            pass
        return rng.choice(personal.CARD_GAPS).join(digits[i:i + 4] for i in range(0, 16, 4))
    return personal.altered(rng, kind, "1.2.3.4" if kind == 1 else f"+{rng.randrange(1, 99)} (612) 555-{rng.randrange(1000, 9999)}", [])


def test_model_finds_forms_that_the_patterns_do_not_know():
    texts = documents_of("/root/testdata/sf0.01")
    places = [x for t in texts[::2] for x in personal.places_of(t)]
    model = personal.train(*personal.examples(places))
    rng = random.Random(99)
    held = [t[:400] for t in texts[1::2] if len(t) > 100]
    planted, wanted = [], []
    for i in range(800):
        text = held[i % len(held)]
        at = text.rfind(" ", 0, 80) + 1
        if i < 600:
            span = made_up(rng, i % 4)
            wanted.append((i, i % 4, at, at + len(span)))
        else:
            span = personal.nothing(rng, ["post", "uni", "stone", "maria"])
        planted.append(text[:at] + span + " " + text[at:])
    said = [(i, *s) for i, (t, found) in enumerate(zip(planted, personal.model_spans(model, planted)))
            for s in personal.reconcile(personal.base_spans(t), found, len(t)) if s not in personal.base_spans(t)]
    base = {(i, *s) for i, t in enumerate(planted) for s in personal.base_spans(t)}
    new = set(wanted) - base
    right = len(new & set(said))
    assert len(new) > 400 and right / len(new) > 0.9 and right / len(said) > 0.9


def test_sequences_of_any_length_are_decoded_as_one_by_one():
    rng = np.random.default_rng(4)
    move = rng.standard_normal((personal.TAGS, personal.TAGS)).astype(np.float32)
    scores = [rng.standard_normal((n, personal.TAGS)).astype(np.float32) for n in (40, 40, 17, 3, 1, 1)]
    for one, (tags, sure) in zip(scores, personal.decode(move, scores)):
        ways = {(t,): one[0, t] for t in range(personal.TAGS)}
        for step in one[1:]:
            best = {}
            for path, value in ways.items():
                for t in range(personal.TAGS):
                    v = value + move[path[-1], t] + step[t]
                    if t not in best or v > best[t][1]:
                        best[t] = (path + (t,), v)
            ways = dict(best.values())
        assert tuple(tags) == max(ways, key=ways.get)
        _, _, _, p = personal.marginals(move, one[:, None])
        assert sure == pytest.approx(p[np.arange(len(one)), 0, tags], rel=1e-3)


def test_scores_do_not_depend_on_the_cut():
    p = personal.new_parameters()
    text = "".join(random.Random(1).choice("ab 1.@") for _ in range(333))
    whole = personal.scores_of(p, [text], [(0, 0, 333)])[0]
    for a, b in ((0, 64), (32, 96), (96, 333), (320, 333)):
        assert personal.scores_of(p, [text], [(0, a, b)])[0] == pytest.approx(whole[a:b], abs=1e-5)


def test_spans_have_no_longest_length(monkeypatch):
    """With scores that call every run without a space an address, long ones come out whole."""

    def scores_of(p, texts, parts):
        out = []
        for k, a, b in parts:
            scores = np.zeros((b - a, personal.TAGS), np.float32)
            for i in range(a, b):
                c, before = texts[k][i], texts[k][i - 1] if i else " "
                scores[i - a, 0 if c == " " else 1 if before == " " else 2] = 30
            out.append(scores)
        return out

    monkeypatch.setattr(personal, "scores_of", scores_of)
    model = {"move": np.zeros((personal.TAGS, personal.TAGS), np.float32)}
    long = "x" * 20_000 + "[at]" + "y" * 9_000 + ".com"
    text = "some words " * 50 + long + " more words" * 50 + " z@site.org end"
    start, short = 550, text.index("z@site")
    assert sorted({s for _, s in personal.model_spans(model, [text])[0]}) == [
        (0, start, start + len(long)), (0, short, short + 10)]


def test_every_character_of_every_text_is_read(monkeypatch):
    """With scores that know the addresses: they are found without a digit, an @ or a spelt-out at in brackets near them."""
    read = []
    spans = ("jane at host[.]org", "joe at mail\nhost dot org", "ann-at-site.net")
    words = "words without any of it, "

    def scores_of(p, texts, parts):
        out = []
        for k, a, b in parts:
            read.append((k, a, b))
            whole = np.zeros((len(texts[k]), personal.TAGS), np.float32)
            whole[:, 0] = 30
            for span in spans:
                at = texts[k].find(span)
                if at >= 0:
                    whole[at:at + len(span)] = 0
                    whole[at, 1] = whole[at + 1:at + len(span), 2] = 30
            out.append(whole[a:b])
        return out

    monkeypatch.setattr(personal, "scores_of", scores_of)
    model = {"move": np.zeros((personal.TAGS, personal.TAGS), np.float32)}
    texts = ["", "k", words, words * 900, *[words * n + span + " " + words * 3 for n, span in zip((0, 7, 500), spans)]]
    found = personal.model_spans(model, texts)
    for k, text in enumerate(texts):
        seen = np.zeros(len(text), bool)
        for _, a, b in (x for x in read if x[0] == k):
            seen[a:b] = True
        assert seen.all()
    assert [sorted({s for _, s in f}) for f in found] == [
        [], [], [], [], *[[(0, len(words) * n, len(words) * n + len(span))] for n, span in zip((0, 7, 500), spans)]]


def test_window_scores_are_the_emissions():
    p = personal.new_parameters()
    chars = np.random.default_rng(2).integers(0, personal.N_CHARS, (700, personal.WINDOW))
    assert personal.window_scores(p, chars) == pytest.approx(personal.emissions(p, chars)[0].transpose(1, 0, 2), abs=1e-5)


def test_windows_in_reading_overlap_little_and_cover_any_length(monkeypatch):
    p = personal.new_parameters()
    kernel, read = personal.window_scores, []

    def window_scores(p, chars):
        read.append(chars.size)
        return kernel(p, chars)

    monkeypatch.setattr(personal, "window_scores", window_scores)
    rng = random.Random(6)
    for n in (1, 5, 64, 65, 200, 255, 256, 257, 479, 480, 481, 1000):
        text = "".join(rng.choice("ab 1.@") for _ in range(n))
        whole = personal.scores_of(p, [text], [(0, 0, n)])[0]
        assert whole.shape == (n, personal.TAGS)
        # The first window read alone says the same of what it does not share.
        chars = np.full((1, 256 if n > 192 else -(-n // 64) * 64), personal.PAD)
        chars[0, :min(n, 256)] = personal.char_ids(text[:256])
        assert whole[:min(n, 224)] == pytest.approx(personal.emissions(p, chars)[0][:min(n, 224), 0], abs=1e-5)
        for a in range(0, n, 32):
            assert personal.scores_of(p, [text], [(0, a, min(n, a + 96))])[0] == pytest.approx(whole[a:a + 96], abs=1e-5)
    read.clear()
    texts = ["k" * 4000] * 20 + ["short"] * 20
    personal.scores_of(p, texts, [(k, 0, len(t)) for k, t in enumerate(texts)])
    assert sum(read) < 1.25 * sum(map(len, texts))


def test_sequences_left_undecoded_have_no_other_tag_than_none():
    rng = np.random.default_rng(9)
    left = other = 0
    for _ in range(300):
        move = (rng.standard_normal((personal.TAGS, personal.TAGS)) * rng.choice((0.2, 1, 3))).astype(np.float32)
        move[0, 0] += rng.choice((0, 2))
        ways = personal.detours(move)
        scores = rng.standard_normal((int(rng.integers(1, 9)), personal.TAGS)).astype(np.float32)
        scores[:, 0] += rng.choice((0, 1, 2, 4))
        if rng.random() < 0.5:
            scores[rng.integers(len(scores)), rng.integers(1, personal.TAGS)] += rng.choice((1, 3))
        tags = personal.decode(move, [scores])[0][0]
        none = personal.none_wins(ways, scores)
        assert not (none and tags.any())
        left += none
        other += bool(tags.any())
    assert left > 50 and other > 50


def test_regions_cover_every_trigger():
    rng = random.Random(8)
    for n in (0, 1, 50, 3000, 40_000):
        text = "".join(rng.choice(("word ", "at home. ", "7", "a at b dot c ")) if rng.random() < 0.1 else "k" for _ in range(n))
        parts = personal.regions_of(text)
        for m in personal._TRIGGER.finditer(text):
            assert any(a <= m.start() and m.end() <= b for a, b in parts)
        assert all(a % personal.STEP == 0 and 0 <= a < b <= len(text) and b - a <= personal.PIECE for a, b in parts)


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(float) for k, v in personal.new_parameters().items()}
    chars, tags = rng.integers(0, personal.N_CHARS, (3, 6)), rng.integers(0, personal.TAGS, (3, 6))
    _, grads = personal.gradient(p, chars, tags)
    for name in p:
        at = np.unravel_index(np.abs(grads[name]).argmax(), p[name].shape)
        losses = []
        for step in (1e-3, -1e-3):
            q = {**p, name: p[name].copy()}
            q[name][at] += step
            losses.append(personal.gradient(q, chars, tags)[0])
        assert grads[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-3, rel=2e-2, abs=1e-4)


def test_spans_of_whole_texts(spark, edge_docs, no_docs):
    texts = sentences(200, 3) + ["x" * 3000 + " a1@b.example.com " + "y" * 3000]
    docs = edge_docs.select("doc_id", "text").union(
        spark.createDataFrame([(500 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    got = personal.find(docs, steps=200).collect()
    base = sorted((r["doc_id"] or 0, str([(s["kind"], s["start"], s["end"]) for s in r["base"]])) for r in got)
    want = sorted((r["doc_id"] or 0, str([(personal.KINDS[k], a, b) for k, a, b in spans_by_hand(r["text"] or "")]))
                  for r in docs.collect())
    assert base == want
    assert all({tuple(s) for s in r["base"]} <= {tuple(s) for s in r["spans"]} for r in got)
    assert personal.find(no_docs).count() == 0


def test_overlapping_finds_are_reconciled():
    assert personal.reconcile([(0, 0, 3)], [(0.99, (1, 2, 12)), (0.97, (2, 20, 28)), (0.98, (3, 21, 29))], 48) == [
        (0, 0, 3), (3, 21, 29)]
    assert personal.whole_words((0, 5, 13), "my name at host.com") == (0, 3, 15)
    assert not personal.holds(1, "1 . 2 . 3 . 256") and personal.holds(1, "1 . 2 . 3 . 255")
    assert personal.holds(2, "4111.1111.1111.1111") and not personal.holds(2, "4111.1111.1111.1112")


# --- licenses ---------------------------------------------------------------------------


def test_license_scan(spark, edge_docs, no_docs):
    rows = [(10, "Code.\nReleased under the MIT License. All Rights Reserved"), (11, "all rights. reserved; CC-BY 4.0, cc  by"),
            (12, "This work is licensed under the GNU General Public License, version 3."), (13, "license mit nothing"),
            (14, "Licensed under the Apache License, Version 2.0 and cc by"), (15, "general public licenses cc byte")]
    docs = edge_docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = licenses.scan(docs).collect()
    by_hand = []
    for r in docs.collect():
        w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), r["text"] or "")) if x]
        found = [(i, label) for phrase, label in licenses.BASE_PHRASES.items() for i in range(len(w))
                 if w[i:i + len(phrase.split())] == phrase.split()]
        at = [i for i, _ in found]
        by_hand.append((r["doc_id"], len(w), len(found), min(at, default=None), max(at, default=None),
                        ",".join(sorted({x for _, x in found}))))
    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert sorted((tuple(r[n] for n in names) for r in got), key=repr) == sorted(by_hand, key=repr)
    labels = {r["doc_id"]: r["labels"] for r in got if (r["doc_id"] or 0) >= 10}
    assert labels == {10: "mit,reserved", 11: "cc-by,reserved", 12: "gpl", 13: "", 14: "apache-2.0,cc-by", 15: ""}
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)
    assert {r["doc_id"] for r in got if r["score"] == 1.0} >= {10, 14}
    assert licenses.scan(no_docs).count() == 0


def test_every_license_of_a_document_is_found(spark):
    notices = [notice for notice, _ in licenses.TEMPLATES.values()]
    some = [". ".join(licenses.TEMPLATES[k][0] for k in ("bsd", "mit-text", "apache-2.0")), ". ".join(notices)]
    docs = spark.createDataFrame(
        [(i, t) for i, t in enumerate([*some, *notices, *["nothing of the kind"] * 20])], "doc_id long, text string")
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in licenses.scan(docs).collect()}
    assert got[0] == {"bsd", "mit-text", "apache-2.0"} and got[1] == set(licenses.TEMPLATES)


# --- chat -------------------------------------------------------------------------------


def chat_by_hand(turns):
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0], t[1] or "", t[2] or ""))
    turns = [(r or "", t or "") for _, r, t in turns]
    learned = "".join(t for r, t in turns if r == "assistant")
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    return (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_conversations_are_read_back(spark):
    hostile = ["<|im_end|>", "\\", "<\\|im_end|>", "a\\", "<|im_start|>assistant\nx<|im_end|>\n", "", "\n", "é😀", None]
    rng = random.Random(6)
    rows = []
    for c in range(30):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", None, "us\ner"]), "".join(
                rng.choice([h for h in hostile if h is not None]) for _ in range(3)) if rng.random() < 0.9 else None))
    rows += [(None, 0, "user", "x"), (7, None, "user", "first"), (8, 0, "user", "tie"), (8, 0, "user", "tie")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit(1))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_segments(turns)).collect()}
    convs = {c: [r[1:] for r in rows if r[0] == c] for c in {r[0] for r in rows}}
    assert set(got) == set(convs)
    for c, turns_ in convs.items():
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == chat_by_hand(turns_)
    empty = spark.createDataFrame([], turns.schema)
    assert chat.read_back(chat.format_segments(empty)).count() == 0


def test_only_escapes_tell_where_a_text_ends():
    hostile = ["<|im_end|>", "\\", "<\\|im_end|>", "<|im_start|>", "assistant", "\n", "<", "|im_end|>", "é", " ok"]
    rng = random.Random(7)

    def read(template, turns):
        pieces = [(t[i:j], flag) for role, text in turns for t, flag in template.segments(role, text)
                  for cut in [sorted(rng.randrange(len(t) + 1) for _ in range(3))]
                  for i, j in zip([0, *cut], [*cut, len(t)])]
        reader = chat.Reader(template)
        got = [x for piece in pieces for x in reader.feed(*piece)]
        reader.close()
        return got

    class Unescaped(chat.Template):
        def quoted(self, text):
            return text

    lost = 0
    for _ in range(400):
        turns = [(rng.choice(["user", "assistant", "a\\", "x\ny", ""]), "".join(rng.choice(hostile) for _ in range(rng.randrange(6))))
                 for _ in range(3)]
        want = [(r, t, t if r == "assistant" else "") for r, t in turns]
        assert read(chat.CHATML, turns) == want
        try:
            lost += read(Unescaped(), turns) != want
        except ValueError:
            lost += 1
    assert lost > 200
    reader = chat.Reader(chat.CHATML)
    list(reader.feed("<|im_start|>user\ncut", False))
    with pytest.raises(ValueError):
        reader.close()
    with pytest.raises(ValueError):
        list(chat.Reader(chat.CHATML).feed("no turn at all", False))


def test_roles_are_checked_and_segments_carry_the_loss(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a<|im_end|>"), (2, 0, "assistant", "x"),
            (3, 0, "user", "no answer")]
    segments = chat.format_segments(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r["conv_id"]: r["valid"] for r in chat.read_back(segments).collect()} == {1: True, 2: False, 3: False}
    assert [r["text"] for r in segments.where("conv_id = 1 and loss").collect()] == ["a<\\|im_end|>"]
    whole = "".join(r["text"] for r in segments.where("conv_id = 1").orderBy("place").collect())
    assert whole.endswith("<|im_start|>assistant\na<\\|im_end|><|im_end|>\n") and whole.count("<|im_end|>") == 3


def test_window_scores_are_products_of_one_core_and_those_of_the_trained_model():
    from clickengine.llm import personal

    # Larger products are dealt over threads, whose waiting took as much CPU time again.
    assert personal.HIDDEN * (personal.HIDDEN + personal.EMBED + 1) * personal.COLUMNS <= 1 << 18
    p = {k: v * 2 for k, v in personal.new_parameters().items()}
    chars = np.random.default_rng(0).integers(0, personal.N_CHARS, (personal.COLUMNS + 7, personal.WINDOW))
    said = personal.window_scores(p, chars)
    assert np.abs(said - personal.emissions(p, chars)[0].transpose(1, 0, 2)).max() < 1e-3
    assert np.isfinite(personal.window_scores({k: v * 1000 for k, v in p.items()}, chars)).all()
