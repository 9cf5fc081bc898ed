"""Language identification by interpolated Kneser-Ney character models, one per language.

Texts are lower-cased and every run of other characters becomes one space. The models of all languages share sorted
arrays of n-gram hashes, one array an order, with a column of log probabilities for each language; an n-gram that no
language has backs off by its context's weight. The language of least cross-entropy per character wins. A text is
rejected if it has no letter or if its cross-entropy is beyond what the calibration texts of that language reach.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteledger.llm.chunks import in_batches
from siteledger.llm.hashing import mix
from siteledger.session import cut

ORDER = 4
#: Bytes of text, over all languages, that the models are fitted on (half as much again calibrates them).
SAMPLE_BYTES = 8 << 20
UNDETERMINED = "und"
_PIECE = 1 << 19
_A = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_A), -1, 2**64))
_SPACE, _EDGE = 0, 1
#: Texts are sampled in spans of so many characters or up to twice as many, so that a long text gives more than one.
SPAN = 1000
#: A language with fewer calibration characters isn't held to less than what is usual over all languages.
FEW = 2000
#: A text is foreign if its cross-entropy is this far (nats, and deviations of its mean) above the calibration texts'.
REACH, DEVIATIONS = 1.0, 6.0


def _code_table() -> np.ndarray:
    """Code of each code point: its lower-case letter, or 0; small codes are kept for space and edge."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha() or unicodedata.category(c)[0] == "M":
            low = c.lower()
            table[i] = (ord(low) if len(low) == 1 else i) + 2
    return table


_CODES: list[np.ndarray] = []


def _codes(text: str) -> np.ndarray:
    if not _CODES:
        _CODES.append(_code_table())
    return _CODES[0][np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]


def _pieces(texts: list[str], order: int) -> Iterator[list[tuple[int, str]]]:
    """Groups of (text number, piece) of about ``_PIECE`` characters; a longer text goes on in the next group."""
    group: list[tuple[int, str]] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text), 1), _PIECE):
            piece = text[at : at + _PIECE]
            group.append((i, piece))
            size += len(piece)
            if size >= _PIECE:
                yield group
                group, size = [], 0
    if group:
        yield group


def _lines(group: list[tuple[int, str]], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, text number of each, places that end an n-gram): pieces follow one another behind ``order - 1`` edges."""
    codes = _codes("\n".join(["", *[p for _, p in group]]))
    edges = np.cumsum([0, *[len(p) + 1 for _, p in group[:-1]]])
    owner = np.zeros(len(codes), np.int64)
    owner[edges] = 1
    owner = np.cumsum(owner) - 1
    codes[edges] = _EDGE
    keep = (codes != _SPACE) | np.concatenate(([True], codes[:-1] != _SPACE))
    codes, owner = codes[keep], owner[keep]
    copies = np.where(codes == _EDGE, order - 1, 1)
    codes, owner = np.repeat(codes, copies), np.repeat(owner, copies)
    return codes, np.array([i for i, _ in group])[owner], np.flatnonzero(codes != _EDGE)


def _one(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(np.uint64) * _A + np.uint64(1))


def gram_hashes(ones: list[np.ndarray]) -> np.ndarray:
    """Hash of an n-gram from the hashes of its characters: that of the first n - 1, times a constant, plus the last."""
    h = ones[0]
    for one in ones[1:]:
        h = h * _A + one
    return h


def grams(texts: list[str], order: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(text number of each character, hashes of the 1- to ``order``-grams that end there), in pieces of bounded size."""
    for group in _pieces(texts, order):
        codes, owner, last = _lines(group, order)
        one = _one(codes)
        hashes, h = [one], one
        for n in range(2, order + 1):
            h = h[:-1] * _A + one[n - 1 :]
            hashes.append(h)
        yield owner[last], [h[last - n] for n, h in enumerate(hashes)]


def counted(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (a row of codes each) and how often they occur."""
    rows, counts = [np.empty((0, order), np.int64)], [np.empty(0, np.int64)]
    for group in _pieces(texts, order):
        codes, _, last = _lines(group, order)
        if not len(last):
            continue
        one = _one(codes)
        _, first, n = np.unique(gram_hashes([one[last - order + 1 + k] for k in range(order)]), return_index=True, return_counts=True)
        rows.append(np.stack([codes[last[first] - order + 1 + k] for k in range(order)], axis=1).astype(np.int64))
        counts.append(n)
    return np.concatenate(rows), np.concatenate(counts)


@dataclass
class Model:
    languages: list[str]
    #: Per order: ascending n-gram hashes and their log probabilities (n-gram x language).
    hashes: list[np.ndarray]
    logs: list[np.ndarray]
    #: Per order: ascending context hashes and their log back-off weights.
    contexts: list[np.ndarray]
    backs: list[np.ndarray]
    #: Log probability of a character that was never seen.
    unseen: np.ndarray
    usual: np.ndarray
    spread: np.ndarray
    sharpness: float = 1.0

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: log likelihood under each language, number of characters, sum of squared logs."""
        k = len(self.languages)
        total, square, count = np.zeros((len(texts), k)), np.zeros((len(texts), k)), np.zeros(len(texts), np.int64)
        for owner, hashes in grams(texts, len(self.hashes)):
            if not len(owner):
                continue
            logs = self._logs(hashes, len(self.hashes) - 1)
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            np.add.at(total, owner[first], np.add.reduceat(logs, first, axis=0, dtype=np.float64))
            np.add.at(square, owner[first], np.add.reduceat(logs * logs, first, axis=0, dtype=np.float64))
            np.add.at(count, owner[first], np.diff(np.append(first, len(owner))))
        return total, count, square

    def _logs(self, hashes: list[np.ndarray], n: int) -> np.ndarray:
        table, wanted = self.hashes[n], hashes[n]
        at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
        out = self.logs[n][at]
        missing = np.flatnonzero(table[at] != wanted)
        if not len(missing):
            return out
        if n == 0:
            out[missing] = self.unseen
            return out
        context = (wanted[missing] - hashes[0][missing]) * _INVERSE
        at = np.minimum(np.searchsorted(self.contexts[n], context), len(self.contexts[n]) - 1)
        back = np.where((self.contexts[n][at] == context)[:, None], self.backs[n][at], np.float32(0))
        out[missing] = self._logs([h[missing] for h in hashes[:n]], n - 1) + back
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, cross-entropy in nats a character, rejected) of each text."""
        whole = [t or "" for t in texts]
        letters = np.array([any(c.isalpha() for c in t) for t in whole], bool)
        if not self.languages or not whole:
            zero = np.zeros(len(whole))
            return [UNDETERMINED] * len(whole), zero, zero, np.ones(len(whole), bool)
        total, count, _ = self.sums(whole)
        entropy = -total / np.maximum(count, 1)[:, None]
        best, least = entropy.argmin(axis=1), entropy.min(axis=1)
        score = 1 / np.exp(-self.sharpness * (entropy - least[:, None])).sum(axis=1)
        limit = self.usual[best] + REACH + DEVIATIONS * self.spread[best] / np.sqrt(np.maximum(count, 1))
        names = [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, letters, strict=True)]
        return names, np.where(letters, score, 0.0), np.where(letters, least, 0.0), ~letters | (least > limit)


def _discount(counts: np.ndarray) -> float:
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return min(0.9, max(0.1, once / max(1, once + 2 * twice)))


def kneser_ney(languages: list[str], rows: dict[str, tuple[np.ndarray, np.ndarray]], order: int) -> Model:
    """Interpolated Kneser-Ney models from the counts of each language's highest-order n-grams.

    Below the highest order, an n-gram counts the different characters that it follows.
    """
    levels: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(order)]
    for g in languages:
        codes, counts = rows[g]
        for n in range(order - 1, -1, -1):
            levels[n].append((codes, counts))
            codes, counts = np.unique(codes[:, 1:], axis=0, return_counts=True)
    model = Model(languages, [], [], [], [], np.empty(0), np.zeros(len(languages)), np.zeros(len(languages)))
    lower = None
    for n in range(order):
        codes = np.unique(np.concatenate([c for c, _ in levels[n]]), axis=0)
        ones = [_one(codes[:, k]) for k in range(n + 1)]
        own = gram_hashes(ones)
        context, suffix = (gram_hashes(ones[:-1]), gram_hashes(ones[1:])) if n else (np.zeros(len(own), np.uint64), None)
        by_hash = np.argsort(own)
        known, at_known = np.unique(context, return_inverse=True)
        prob = np.empty((len(own), len(languages)))
        backs = np.zeros((len(known), len(languages)), np.float32)
        below = np.full((len(own), len(languages)), 1.0 / (len(own) + 1)) if lower is None else lower[1][np.searchsorted(lower[0], suffix)]
        sorted_hashes = own[by_hash]
        unseen = np.zeros(len(languages))
        for j in range(len(languages)):
            c, counts = levels[n][j]
            weight = np.zeros(len(own))
            weight[by_hash[np.searchsorted(sorted_hashes, gram_hashes([_one(c[:, k]) for k in range(n + 1)]))]] = counts
            d = _discount(counts)
            total = np.bincount(at_known, weights=weight, minlength=len(known))
            seen = np.bincount(at_known, weights=weight > 0, minlength=len(known))
            back = np.where(total > 0, d * seen / np.maximum(total, 1), 1.0)
            prob[:, j] = np.maximum(weight - d, 0) / np.maximum(total, 1)[at_known] + back[at_known] * below[:, j]
            backs[:, j] = np.log(back)
            unseen[j] = np.log(back[0] / (len(own) + 1)) if n == 0 else 0
        if n == 0:
            model.unseen = unseen
        model.hashes.append(sorted_hashes)
        model.logs.append(np.log(prob[by_hash]).astype(np.float32))
        model.contexts.append(known)
        model.backs.append(backs)
        lower = (sorted_hashes, prob[by_hash])
    return model


def calibrate(model: Model, lang: list[str], total: np.ndarray, count: np.ndarray, square: np.ndarray) -> None:
    """Sets each language's usual cross-entropy and its spread, and the sharpness at which scores are likeliest.

    A language without calibration texts rejects nothing.
    """
    ok = count > 0
    at = np.array([model.languages.index(g) for g in lang], np.int64)[ok]
    total, count, square = total[ok], count[ok], square[ok]
    rows = np.arange(len(at))

    def moments(mine: np.ndarray) -> tuple[float, float]:
        n = int(count[mine].sum())
        if not n:
            return np.inf, 0.0
        mean = -total[rows[mine], at[mine]].sum() / n
        return mean, np.sqrt(max(0.0, square[rows[mine], at[mine]].sum() / n - mean * mean))

    pooled = moments(rows >= 0)
    for j in range(len(model.languages)):
        mine = at == j
        own = moments(mine)
        model.usual[j], model.spread[j] = np.maximum(own, pooled) if count[mine].sum() < FEW and np.isfinite(own[0]) else own
    if len(at):
        entropy = -total / count[:, None]
        best = (np.inf, 1.0)
        for sharp in (1.0, 2.0, 4.0, 8.0, 16.0, 32.0):
            x = -sharp * entropy
            x = x - x.max(axis=1, keepdims=True)
            loss = -(x[rows, at] - np.log(np.exp(x).sum(axis=1))).mean()
            best = min(best, (loss, sharp))
        model.sharpness = best[1]


def _sampled(batches):
    """Spans (lang, text) with a letter of rows (lang, text, part, seed): each span is picked by seeded hash, ``part`` in a million."""
    for batch in batches:
        langs, spans = [], []
        for lang, text, part, seed in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "part", "seed")), strict=True):
            n = max(1, len(text) // SPAN)
            picked = np.flatnonzero(mix(np.arange(1, n + 1, dtype=np.uint64) * _A + np.uint64(seed % 2**64)) % np.uint64(1_000_000) < part)
            for k in picked.tolist():
                span = text[k * len(text) // n : (k + 1) * len(text) // n]
                if any(c.isalpha() for c in span):
                    langs.append(lang)
                    spans.append(span)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(spans, pa.string())], ["lang", "text"])


def held_out(divisor: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % divisor == remainder, F.lit(False))


def fit(docs: DataFrame, learn: Column, order: int = ORDER, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Models of all values of ``lang`` in the rows of ``docs`` (doc_id, text, lang) where ``learn`` holds.

    Each language gives a seeded sample of about an equal share of ``sample_bytes``, in spans of its texts: two thirds to
    count n-grams and a third to calibrate, equal spans on one side. Of a language's different spans the longest always
    counts and the shortest of two or more always calibrates. Only the distinct n-grams of this bounded sample reach the
    driver.
    """
    usable = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    found = usable.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size")).where("size > 0").orderBy("lang").collect()
    languages = [r["lang"] for r in found]
    if not languages:
        return Model([], [], [], [], [], np.empty(0), np.empty(0), np.empty(0))
    per = max(sample_bytes / len(languages), 16 * SPAN)
    part = usable.sparkSession.createDataFrame([(r["lang"], min(1e6, 1e6 * per / r["size"])) for r in found], "lang string, part double")
    # One row a language: small by the number of labels.
    dealt = usable.join(F.broadcast(part), "lang").select("lang", "text", "part", F.xxhash64("doc_id", "text").alias("seed"))
    sample = cut(dealt.mapInArrow(_sampled, "lang string, text string").withColumn("place", F.struct(F.length("text"), F.xxhash64("text"))))
    ends = sample.groupBy("lang").agg(F.max("place").alias("longest"), F.min("place").alias("shortest"))
    sample = sample.join(F.broadcast(ends), "lang")
    by_hash = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(3)) > 0
    counting = (F.col("place") == F.col("longest")) | (by_hash & (F.col("place") != F.col("shortest")))
    names = [f"c{k}" for k in range(order)]

    def count(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for g in table.column("lang").unique().to_pylist():
                mine = table.filter(pa.compute.equal(table.column("lang"), g)).column("text").to_pylist()
                codes, n = counted(mine, order)
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(n)), *[pa.array(codes[:, k]) for k in range(order)], pa.array(n)], ["lang", *names, "n"])

    schema = "lang string, " + ", ".join(f"{n} long" for n in names) + ", n long"
    table = sample.where(counting).select("lang", "text").mapInArrow(count, schema).groupBy("lang", *names).agg(F.sum("n").alias("n")).toArrow()
    rows = {}
    for g in languages:
        mine = table.filter(pa.compute.equal(table.column("lang"), g))
        codes = np.stack([mine.column(n).to_numpy() for n in names], axis=1) if mine.num_rows else np.full((1, order), _EDGE)
        rows[g] = codes, mine.column("n").to_numpy() if mine.num_rows else np.ones(1, np.int64)
    model = kneser_ney(languages, rows, order)

    def measure(batches):
        for batch in batches:
            total, n, square = model.sums(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(list(total), pa.list_(pa.float64())), pa.array(n), pa.array(list(square), pa.list_(pa.float64()))], ["lang", "total", "n", "square"])

    seen = sample.where(~counting).select("lang", "text").mapInArrow(measure, "lang string, total array<double>, n long, square array<double>").collect()
    total, square = (np.array([r[c] for r in seen], float).reshape(len(seen), len(languages)) for c in ("total", "square"))
    calibrate(model, [r["lang"] for r in seen], total, np.array([r["n"] for r in seen], np.int64), square)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (with text) and lang_pred, score, cross_entropy, rejected for each row, in one pass without a shuffle.

    lang_pred is ``und`` if the text is NULL or has no letter, with score 0; such rows are rejected. Columns of ``docs``
    that have one of these names are replaced. With no language learned, all rows are ``und``.
    """
    names = ["lang_pred", "score", "cross_entropy", "rejected"]
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample that it was fitted on

    def label(batches):
        for batch in batches:
            lang, score, entropy, rejected = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(entropy), pa.array(rejected)], [*batch.schema.names, *names])

    return in_batches(docs, label, ", lang_pred string, score double, cross_entropy double, rejected boolean")


def recognised(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their own columns only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        for batch in batches:
            rejected = shared.value.predict(batch.column("text").to_pylist())[3]
            yield batch.filter(pa.array(~rejected))

    return in_batches(docs, keep)
