"""Quality, language and lattice models: held-out accuracy, brute force, odd rows."""

from __future__ import annotations

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from siteledger.llm import language, lattice, quality
from tests.llm.fixtures import SCHEMA, documents, texts, words

UNITS = {"aa": ["ka", "to", "ri", "mo", "shi", "na"], "bb": ["str", "end", "ung", "och", "wei", "er"], "cc": ["eau", "oux", "ille", "ent", "que", "ré"]}


def _corpus(seed=3, n=150):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        g = rng.choice(list(UNITS))
        text = " ".join("".join(rng.choice(UNITS[g]) for _ in range(rng.randint(1, 3))) for _ in range(rng.choice([4, 30, 80])))
        rows.append((i, text, g))
    return rows


def test_languages_of_held_out_rows(spark):
    rows = _corpus() + [(900, None, "aa"), (901, "", None), (902, "12 34 !?", "bb"), (903, "ЖЖЖ ЩЩЩЩ ЪЪЪ ЭЭЭ ЮЮЮЮ " * 20, None), (None, "kato rimo", None), (5, "kato", "aa")]
    docs = spark.createDataFrame([(d, t, g, 0.5) for d, t, g in rows], "doc_id long, text string, lang string, score double").repartition(3)
    held = language.held_out(3, 1)
    model = language.fit(docs, ~held)
    got = language.identify(docs.withColumn("held_out", held), model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
        if r.doc_id in (900, 901, 902):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        elif r.doc_id == 903:
            assert r.rejected
        elif r.doc_id is not None and r.doc_id < 900:
            assert r.lang_pred == r.lang and not r.rejected
    kept = language.recognised(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 4


@pytest.mark.parametrize("many", [1, 2, 3])
def test_rare_languages_are_learned_and_kept(spark, many):
    """Whatever their hashes are: languages of one to three documents, one of them of a single long text."""
    rng = random.Random(many)
    rows = [r for r in _corpus(4, 90) if r[2] != "cc"]
    text = lambda g, n: " ".join("".join(rng.choice(UNITS[g]) for _ in range(2)) for _ in range(n))
    rare = {f"r{k}": [text("cc", 60).translate({ord("e"): chr(0x430 + 4 * k), ord("u"): chr(0x431 + 4 * k)}) for _ in range(many + 2)] for k in range(8)}
    docs = rows + [(1000 + 10 * k + i, t, g) for k, (g, ts) in enumerate(rare.items()) for i, t in enumerate(ts)] + [(2000, text("cc", 3000).upper().replace("E", "Я"), "long")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    learn = (language.F.col("doc_id") < 1000) | (language.F.col("doc_id") % 10 < many) | (language.F.col("lang") == "long")
    model = language.fit(df, learn)
    assert np.isfinite(model.usual).sum() >= (3 if many == 1 else 11)
    got = language.identify(df, model).collect()
    assert [r.doc_id for r in got if r.rejected] == []
    assert {r.lang for r in got} == {r.lang_pred for r in got} and np.mean([r.lang == r.lang_pred for r in got]) > 0.95


def test_no_language_to_learn(spark):
    empty = spark.createDataFrame([], SCHEMA)
    model = language.fit(empty, ~language.held_out(3, 1))
    assert language.identify(empty, model).count() == 0
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language.identify(docs, language.fit(docs, ~language.held_out(3, 1))).first().lang_pred == "und"


def test_kneser_ney_sums_to_one():
    texts_ = {"a": ["abab abba", "baab"], "b": ["cdcd", "dcc"]}
    rows = {g: language.counted(t, 3) for g, t in texts_.items()}
    model = language.kneser_ney(["a", "b"], rows, 3)
    letters = [language._codes(c)[0] for c in "abcd"] + [0]
    one = {c: language._one(np.array([c], np.uint32)) for c in [*letters, 1]}
    for context in itertools.product([*letters, 1], repeat=2):
        total = np.zeros(2)
        for c in letters:
            ones = [one[x] for x in (*context, c)]
            total += np.exp(model._logs([ones[2], language.gram_hashes(ones[1:]), language.gram_hashes(ones)], 2)[0])
        assert np.all(total <= 1 + 1e-5) and np.all(total > 0.6)


def test_long_texts_are_scored_in_pieces():
    rows = {"a": language.counted(["abab abba " * 50], 4)}
    model = language.kneser_ney(["a"], rows, 4)
    text = "abab abba " * 120_000
    total, count, _ = model.sums([text, "abab"])
    half, n, _ = model.sums([text[: len(text) // 10]])
    assert abs(total[0, 0] / count[0] - half[0, 0] / n[0]) < 1e-4 and count[0] > 10 * n[0] - 20


def test_lattice_sums_over_all_segmentations():
    pieces = lattice.Pieces.read(lattice.VOCABULARY)
    logs = np.log(pieces.prior)
    weight = {}
    for length, numbers in pieces.numbers.items():
        for h, i in zip(pieces.hashes[length], numbers, strict=True):
            weight[(length, int(h))] = logs[i]

    def of(piece: bytes):
        return weight.get((len(piece), int(lattice._spans(np.frombuffer(piece, np.uint8)[None], len(piece))[0, 0])))

    for word in (b"the", b"ing", b"caf\xc3\xa9", b"q"):
        raw = b" " + word
        total = 0.0
        for cuts in itertools.chain.from_iterable(itertools.combinations(range(1, len(raw)), k) for k in range(len(raw))):
            parts = [of(raw[a:b]) for a, b in zip((0, *cuts), (*cuts, len(raw)), strict=True)]
            if None not in parts:
                total += math.exp(sum(parts))
        assert lattice.log_probabilities([word], pieces, logs[None])[0, 0] == pytest.approx(math.log(total))
    counts = lattice.expected_counts([b"the"], pieces, logs)
    size = {int(i): n for n, numbers in pieces.numbers.items() for i in numbers}
    assert sum(c * size[int(i)] for i, c in enumerate(counts) if c) == pytest.approx(4)  # every byte is covered once


def test_lm_counts_and_base(spark):
    rows = texts(4, 60) + [(None, "alpha beta"), (3, "alpha"), (1, "w" * 3000)]
    held = language.held_out(7, 2)
    got = lattice.scores(documents(spark, rows), held).collect()
    is_held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts = Counter(w for d, t in rows if not is_held(d) for w in [*words(t), b" "])
    n, scale = sum(counts.values()), math.log10(sum(counts.values()) + len(counts) + 1)
    want = []
    for d, t in rows:
        own = [*words(t), b" "]
        want.append((str(d), is_held(d), len(own), sum(counts[w] > 0 for w in own), n, round(sum(math.log10(counts[w] + 1) - scale for w in own), 6)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lattice.scores(spark.createDataFrame([], SCHEMA), held).count() == 0


def test_lm_probability_is_proper(spark):
    """Words of up to two letters over a two-letter alphabet, with all else, have at most the mass that is left."""
    rows = [(i, random.Random(i).choice(["a b ab", "b a", "ba ba a"]), "en") for i in range(60)]
    probes = [(1000 + i, w, "en") for i, w in enumerate(["", "a", "b", "ab", "ba", "aa", "bb", "a b", "c"])]
    docs = spark.createDataFrame(rows + probes, "doc_id long, text string, lang string")
    learn_only = language.F.col("doc_id") >= 1000
    got = {r.doc_id: r.score for r in lattice.scores(docs, learn_only).collect() if r.doc_id >= 1000}
    assert sum(10**s for s in got.values()) <= 1.0


def test_gradients_match_differences():
    net = quality.Network.new(0.6)
    rng = np.random.default_rng(0)
    for p in net.parameters():
        p[...] = rng.standard_normal(p.shape).astype(np.float32) * 0.3
    data = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (0, 5, 300, 1400)]
    labels = np.array([0, 1, 1, 0], np.float32)

    def loss():
        z = net.logits(data).astype(np.float64)
        return float(np.mean(np.log1p(np.exp(-z)) * labels + np.log1p(np.exp(z)) * (1 - labels)))

    for p, g in zip(net.parameters(), net.gradients(data, labels), strict=True):
        flat, grad = p.reshape(-1), np.asarray(g).reshape(-1)
        for i in np.argsort(-np.abs(grad))[:3]:
            old = flat[i]
            flat[i] = old + 1e-3
            up = loss()
            flat[i] = old - 1e-3
            down = loss()
            flat[i] = old
            assert (up - down) / 2e-3 == pytest.approx(grad[i], rel=0.1, abs=2e-4)


def test_quality_of_held_out_rows(spark):
    rng = random.Random(2)
    rows = []
    for i in range(240):
        good = " ".join("".join(rng.choice(UNITS["aa"]) for _ in range(2)) for _ in range(rng.choice([10, 60, 300])))
        rows.append((i, good if i % 3 else good.replace(" ", "$$$ "), 1 if i % 3 else 0))
    docs = spark.createDataFrame([(d, t, 7) for d, t, _ in rows] + [(900, None, 7), (901, "", 7), (None, "x", 7), (902, "kato rimo " * 200_000, 7)], "doc_id long, text string, predicted int").repartition(3)
    labels = spark.createDataFrame([(d, q) for d, _, q in rows] + [(900, 1), (0, None), (None, 1), (3, 0)], "doc_id long, quality int")
    held = language.held_out(3, 1)
    net = quality.fit(docs, labels, ~held)
    got = {r.doc_id: r for r in quality.scored(docs, net).collect()}
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    test = [(d, q) for d, _, q in rows if zlib.crc32(str(d).encode()) % 3 == 1]
    assert np.mean([got[d].predicted == q for d, q in test]) > 0.95
    assert got[900].score == got[901].score


def test_quality_without_labels(spark):
    docs = documents(spark, texts(4, 5))
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.scored(docs, quality.fit(docs, labels, ~language.held_out(3, 1))).count() == docs.count()


def test_long_labelled_texts_end_no_sample(spark):
    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choice(UNITS["aa"]) for _ in range(2)) for _ in range(n))
    rows = [(i, text(40) if i % 2 else text(40).replace(" ", "$$$ "), i % 2) for i in range(200)]
    rows += [(300 + i, (text(2000) if i % 2 else text(2000).replace(" ", "$$$ ")) * 20, i % 2) for i in range(4)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(d, q) for d, _, q in rows], "doc_id long, quality int")
    net = quality.fit(docs, labels, quality.F.lit(True), sample_bytes=100_000)
    got = {r.doc_id: r for r in quality.scored(docs, net).collect()}
    assert np.mean([got[d].predicted == q for d, _, q in rows]) > 0.95
    assert quality.share_of_bytes([5, 100, 3, 50], 60) == 26 and quality.share_of_bytes([5, 3], 60) == 5


def test_long_texts_behind_short_ones_are_scored_in_spans(monkeypatch):
    net, largest = quality.Network.new(0.5), []
    whole = quality.Network.forward
    monkeypatch.setattr(quality.Network, "forward", lambda self, texts: largest.append(sum(map(len, texts))) or whole(self, texts))
    long = bytes(np.random.default_rng(1).integers(97, 123, 6 * quality._GROUP, dtype=np.uint8))
    got = quality.score_texts(net, [b"short", long, b"", long, b"end"])
    assert max(largest) <= 2 * quality._GROUP and len(got) == 5
    want = 1 / (1 + np.exp(-np.array([net.logits([t])[0] for t in (b"short", long, b"")], np.float64)))
    assert np.allclose(got[:3], want, atol=1e-6) and got[1] == got[3]
