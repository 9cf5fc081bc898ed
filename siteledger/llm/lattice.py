"""Language-model scores by subword lattices.

A text is a sequence of words, each with a space before it, and one end. Pieces of an existing subword vocabulary (with
all single bytes) segment a word in many ways; the lattice holds all of them, and the forward recursion in log space
sums them to the marginal probability of the word. The vocabulary's own scores are the prior of the piece weights;
expected counts over the lattices of all distinct training words (forward-backward) update them, for each class of
texts (the most frequent languages of the training rows) apart. Above stands what the corpus knows of whole words: with
counts c of the N tokens and V distinct ones of a class, and the word's share q of the whole corpus,

    P(word) = (max(c - d, 0) + d * V * (SHARED * q + (1 - SHARED) * P_lattice(word))) / N,

absolute discounting with the lattice as its open-vocabulary back-off. In a text, a word is with probability CACHE one
of the text's earlier words instead. A text's probability is the mixture of the classes over the whole text, so its
language is inferred, never read.

All word counts are made in Spark over all documents. Chunks of documents ask for their distinct words and sum up.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteledger.llm import chunks as C
from siteledger.llm.hashing import BYTE, STEP, word_hashes, word_spans
from siteledger.session import cut

#: Where the vocabulary file is looked for if no path is given.
VOCABULARY = os.environ.get("SUBWORD_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")
#: Pieces that the prior weighs as much as, and rounds of expected counts.
PRIOR_PIECES, ROUNDS = 100.0, 2
#: Classes of texts; languages beyond the most frequent ones share the last.
CLASSES = 8
#: Part of a class's back-off that goes to words of other classes.
SHARED = 0.1
#: Probability that a word repeats one of the words before it in the text.
CACHE = 0.05
_MARK = "▁"
_BITS = 18
_BATCH, _ROWS = 1 << 15, 1 << 17


@dataclass
class Pieces:
    """Pieces by length: ascending hashes and piece numbers; ``filters`` tells which hashes there can be at all."""

    size: int
    longest: int
    hashes: dict[int, np.ndarray]
    numbers: dict[int, np.ndarray]
    prior: np.ndarray

    def __post_init__(self) -> None:
        self.filters = {}
        for length, h in self.hashes.items():
            self.filters[length] = np.zeros(1 << _BITS, bool)
            self.filters[length][_slot(h)] = True

    def __reduce__(self):
        """Filters are made anew by whoever gets the pieces: they are larger than all the rest."""
        return Pieces, (self.size, self.longest, self.hashes, self.numbers, self.prior)

    @classmethod
    def read(cls, path: str) -> Pieces:
        """The pieces of a sentencepiece model, lower-case ones only (texts are lower-cased), and all 256 bytes.

        The model's scores are ranks of merges; a piece of rank r gets a prior weight of 1 / (r + 10).
        """
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        weights: dict[bytes, float] = {bytes([b]): 1e-4 for b in range(256)}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
                continue
            raw = piece.replace(_MARK, " ").encode()
            if raw != raw.lower():
                continue
            weights[raw] = 1.0 / (10.0 + max(0.0, -model.get_score(i)))
        texts = sorted(weights)
        prior = np.array([weights[t] for t in texts])
        hashes, numbers = {}, {}
        for length in sorted({len(t) for t in texts}):
            own = [i for i, t in enumerate(texts) if len(t) == length]
            data = np.frombuffer(b"".join(texts[i] for i in own), np.uint8).reshape(-1, length)
            h = _spans(data, length)[:, 0]
            order = np.argsort(h)
            hashes[length], numbers[length] = h[order], np.array(own)[order]
        return cls(len(texts), max(hashes), hashes, numbers, prior / prior.sum())


def _slot(h: np.ndarray) -> np.ndarray:
    return (h * STEP[59]) >> np.uint64(64 - _BITS)


def _spans(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes from every position of every row."""
    n = data.shape[1] - length + 1
    out = np.zeros((data.shape[0], n), np.uint64)
    letters = BYTE[data]
    for k in range(length):
        out = out * STEP[60] + letters[:, k : k + n]
    return out


def _arcs(data: np.ndarray, pieces: Pieces):
    """(length, rows, starts, piece numbers) of all pieces in equally long words."""
    letters, level = BYTE[data], None
    for length in range(1, min(pieces.longest, data.shape[1]) + 1):
        n = data.shape[1] - length + 1
        level = letters[:, :n].copy() if level is None else level[:, :n] * STEP[60] + letters[:, length - 1 : length - 1 + n]
        if length not in pieces.hashes:
            continue
        row, start = np.nonzero(pieces.filters[length][_slot(level)])
        h = level[row, start]
        at = np.minimum(np.searchsorted(pieces.hashes[length], h), len(pieces.hashes[length]) - 1)
        ok = pieces.hashes[length][at] == h
        yield length, row[ok], start[ok], pieces.numbers[length][at[ok]]


def _grouped(words: list[bytes]):
    """(places, matrix of bytes) of equally long words, each behind a space, in groups of bounded size."""
    lengths = np.array([len(w) for w in words])
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for same in np.split(order, cuts):
        if not len(same):
            continue
        width = int(lengths[same[0]]) + 1
        step = max(1, _BATCH // width)
        for at in range(0, len(same), step):
            part = same[at : at + step]
            data = np.frombuffer(b"".join(b" " + words[i] for i in part), np.uint8).reshape(len(part), width)
            yield part, data


def _lattice(data: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Number of the piece of each length that ends at each place (place, word, length), one past the last where none is."""
    arcs = [arc for arc in _arcs(data, pieces) if len(arc[1])]
    most = max(length for length, *_ in arcs)  # single bytes are pieces, so there is one
    number = np.full((data.shape[1] + 1, len(data), most + 1), pieces.size, np.int32)
    for length, row, start, piece in arcs:
        number[start + length, row, length] = piece
    return number


def _add(x: np.ndarray) -> np.ndarray:
    """log of the sum of exponentials along the last axis."""
    top = x.max(axis=-1)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(x - safe[..., None]).sum(axis=-1))


def _forward(table: np.ndarray) -> np.ndarray:
    """Log probability of every prefix of every word (place, word): the sum over all ways to segment it."""
    width, count, most = table.shape
    out = np.full((width, count), -np.inf)
    out[0] = 0.0
    for place in range(1, width):
        k = min(place, most - 1)
        out[place] = _add(table[place, :, 1 : k + 1] + out[place - k : place][::-1].T)
    return out


def log_probabilities(words: list[bytes], pieces: Pieces, logs: np.ndarray) -> np.ndarray:
    """Natural log of each word's marginal probability over all its segmentations, under each row of piece weights."""
    out = np.empty((len(words), len(logs)))
    padded = np.concatenate((logs, np.full((len(logs), 1), -np.inf)), axis=1)
    for part, data in _grouped(words):
        number = _lattice(data, pieces)
        for k, own in enumerate(padded):
            out[part, k] = _forward(own[number])[-1]
    return out


def expected_counts(words: list[bytes], pieces: Pieces, logs: np.ndarray) -> np.ndarray:
    """Expected number of times each piece is used in one occurrence of each word."""
    out, padded = np.zeros(pieces.size), np.append(logs, -np.inf)
    for part, data in _grouped(words):
        number = _lattice(data, pieces)
        table = padded[number]
        ahead = _forward(table)
        width, count, most = table.shape
        behind = np.full((width, count), -np.inf)
        behind[-1] = 0.0
        for place in range(width - 2, -1, -1):
            k = min(width - 1 - place, most - 1)
            arcs = np.stack([table[place + n, :, n] + behind[place + n] for n in range(1, k + 1)], axis=-1)
            behind[place] = _add(arcs)
        place, row, length = np.nonzero(np.isfinite(table))
        share = np.exp(ahead[place - length, row] + table[place, row, length] + behind[place, row] - ahead[-1, row])
        out += np.bincount(number[place, row, length], weights=share, minlength=pieces.size)
    return out


def _tables(batches) -> Iterator[pa.Table]:
    """Arrow batches put together to ``_ROWS`` rows or so, so that words of one length are many."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= _ROWS:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _keys_of(texts: list[bytes]):
    """Distinct words of some texts: ascending keys, place of each word's first copy, and each word's key and text."""
    data, starts, ends, owner = word_spans(texts)
    keys = word_hashes(data, starts, ends)
    return data, starts, ends, owner, keys


def word_table(docs: DataFrame, kind: Column, classes: int) -> DataFrame:
    """(key, word, learned, c0, c1, ...): how often each word occurs in learned rows, in all and by class.

    ``kind`` is the class of a row, NULL for rows that aren't learned; their words are listed all the same.
    """
    names = [f"c{k}" for k in range(classes)]

    def count(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            kinds = batch.column("kind").fill_null(classes).to_numpy()
            for at in range(0, len(texts), 1024):
                group = [t or b"" for t in texts[at : at + 1024]]
                data, starts, ends, owner, keys = _keys_of(group)
                if not len(keys):
                    continue
                unique, first, place = np.unique(keys, return_index=True, return_inverse=True)
                raw = data.tobytes()
                words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
                table = np.bincount(place * (classes + 1) + kinds[at + owner], minlength=len(unique) * (classes + 1)).reshape(-1, classes + 1)
                yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(words, pa.binary()), *[pa.array(table[:, k]) for k in range(classes)]], ["key", "word", *names])

    source = docs.select(F.col("text").cast("binary").alias("text"), kind.cast("int").alias("kind"))
    counted = source.mapInArrow(count, "key long, word binary, " + ", ".join(f"{n} long" for n in names))
    summed = counted.groupBy("key", "word").agg(*[F.sum(n).alias(n) for n in names])
    return summed.withColumn("learned", sum(F.col(n) for n in names))


def fit(words: DataFrame, pieces: Pieces, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Log weights of the pieces in each class after ``rounds`` of expected counts over its distinct words.

    Distinct words, as new words resemble these. One row per class and piece reaches the driver: as many as the
    vocabulary has, however large the corpus.
    """
    spark, names = words.sparkSession, [f"c{k}" for k in range(classes)]
    weights = np.tile(pieces.prior, (classes, 1))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, np.log(weights)))

        def expect(batches, shared=shared):
            own, logs = shared.value
            total = np.zeros((classes, own.size))
            for batch in _tables(batches):
                listed = batch.column("word").to_pylist()
                for k, name in enumerate(names):
                    here = np.flatnonzero(batch.column(name).to_numpy())
                    total[k] += expected_counts([listed[i] for i in here], own, logs[k])
            kind, piece = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(piece), pa.array(total[kind, piece])], ["kind", "piece", "used"])

        found = words.where("learned > 0").select("word", *names).mapInArrow(expect, "kind long, piece long, used double")
        rows = found.groupBy("kind", "piece").agg(F.sum("used").alias("used")).toArrow()
        counts = np.tile(pieces.prior * PRIOR_PIECES, (classes, 1))
        np.add.at(counts, (rows.column("kind").to_numpy(), rows.column("piece").to_numpy()), rows.column("used").to_numpy())
        weights = counts / counts.sum(axis=1, keepdims=True)
    return np.log(weights)


@dataclass
class Totals:
    """Tokens, distinct ones, discount and ends of the corpus (column 0) and of each class."""

    tokens: np.ndarray
    distinct: np.ndarray
    discount: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, words: DataFrame, ends: list[int]) -> Totals:
        names = ["learned", *[f"c{k}" for k in range(len(ends))]]
        how = lambda n: [F.sum(n), F.count_if(F.col(n) > 0), F.count_if(F.col(n) == 1), F.count_if(F.col(n) == 2)]
        row = np.array([x or 0 for x in words.agg(*[x for n in names for x in how(n)]).first()], float).reshape(-1, 4)
        end = np.array([sum(ends), *ends], float)
        discount = np.clip(row[:, 2] / np.maximum(row[:, 2] + 2 * row[:, 3], 1), 0.1, 0.9)
        return cls(row[:, 0] + end, row[:, 1] + (end > 0), discount, end)

    def logs(self, counts: np.ndarray, lattice: np.ndarray) -> np.ndarray:
        """log10 probability of words in each class, from their counts (corpus, then classes) and the lattices' logs."""
        if not self.tokens[0]:
            return lattice / np.log(10.0)
        shared = counts[:, :1] / self.tokens[0]
        new = (self.discount * self.distinct)[1:]
        back = SHARED * shared + (1 - SHARED) * np.exp(lattice)
        p = (np.maximum(counts[:, 1:] - self.discount[1:], 0) + new * back) / self.tokens[1:]
        # A word so long that its probability is below the range of floats is new: the lattice's log decides.
        floor = np.log10((1 - SHARED) * new / self.tokens[1:]) + lattice / np.log(10.0)
        with np.errstate(divide="ignore"):
            return np.maximum(np.log10(p), floor)


def _kinds(docs: DataFrame, learn: Column) -> tuple[Column, list[int]]:
    """The class of a row by its language, and the number of learned rows in each class."""
    found = docs.where(learn).groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(CLASSES - 1).collect()
    kind = F.lit(len(found))
    for k, row in reversed(list(enumerate(found))):
        kind = F.when(F.col("lang").eqNullSafe(F.lit(row["lang"])), k).otherwise(kind)
    rest = docs.where(learn).count() - sum(r["n"] for r in found)
    return F.when(learn, kind), [*[r["n"] for r in found], *([rest] if rest or not found else [])]


def _earlier(owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word of the texts: how many words stand before it in its text, and how many of these are the same."""
    at = np.arange(len(owner))
    new = np.concatenate(([True], owner[1:] != owner[:-1]))[: len(owner)]
    before = at - np.maximum.accumulate(np.where(new, at, 0)) if len(owner) else at
    order = np.lexsort((at, place, owner))
    first = np.ones(len(owner), bool)
    first[1:] = (owner[order][1:] != owner[order][:-1]) | (place[order][1:] != place[order][:-1])
    earlier = np.empty(len(owner), np.int64)
    earlier[order] = at - np.maximum.accumulate(np.where(first, at, 0)) if len(owner) else at
    return before, earlier


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(docs: DataFrame, held_out: Column, vocabulary: str = VOCABULARY) -> DataFrame:
    """Scores of every text of ``docs`` (doc_id, text, lang), learned from the rows where ``held_out`` doesn't hold.

    doc_id, held_out, n_tokens (words and the end), n_known (tokens that were learned), train_tokens, base_score (the
    add-one word model) and score (log10 of the text's probability). A NULL or blank text is the end alone. If there is
    nothing to learn from, piece weights are the vocabulary's. Other columns are ignored; equal rows score alike.
    """
    spark = docs.sparkSession
    pieces = Pieces.read(vocabulary)
    kind, ends = _kinds(docs, ~held_out)
    words = cut(word_table(docs, kind, len(ends)))
    totals = Totals.of(words, ends)
    logs = fit(words, pieces, len(ends))
    shared = spark.sparkContext.broadcast((pieces, logs))  # of the vocabulary's size
    chunks = C.chunked(docs, (held_out.alias("held_out"),))
    answer = np.dtype([("c", "<u4"), ("p", "<f4", (len(ends),))])
    names = ["learned", *[f"c{k}" for k in range(len(ends))]]

    def weigh(batches):
        own, weights = shared.value
        for batch in _tables(batches):
            found = log_probabilities(batch.column("word").to_pylist(), own, weights)
            counts = np.stack([batch.column(n).to_numpy() for n in names], axis=1)
            p = totals.logs(counts, found)
            each = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
            yield from pa.table({"bucket": batch.column("bucket"), "key": batch.column("key"), "learned": batch.column("learned"), "p": each}).to_batches()

    bucket = F.shiftrightunsigned("key", 64 - chunks.bits).alias("bucket")
    facts = words.select(bucket, "key", "word", *names).mapInArrow(weigh, "bucket long, key long, learned long, p array<double>")

    def ask(rows, _):
        keys = np.unique(_keys_of(C.texts_of(rows)[1])[4])
        return keys, keys

    def settle(records, told):
        key = told.column("key").to_numpy().view(np.uint64)
        order = np.argsort(key)
        at = order[np.searchsorted(key[order], records)]
        out = np.empty(len(records), answer)
        out["c"] = told.column("learned").to_numpy()[at]
        out["p"] = np.array(told.column("p").combine_chunks().flatten()).reshape(-1, len(ends))[at]
        return out

    def finish(rows, told):
        _, texts = C.texts_of(rows)
        _, _, _, owner, keys = _keys_of(texts)
        _, place = np.unique(keys, return_inverse=True)
        said = C.replies(told, 1, answer)
        scale = np.log10(totals.tokens[0] + 1 * (totals.distinct[0] + 1))
        known, base = said["c"] > 0, np.log10(said["c"] + 1.0) - scale
        total = lambda x: np.bincount(owner, weights=x, minlength=len(texts))
        before, earlier = _earlier(owner, place)
        again = np.where(before > 0, CACHE * earlier / np.maximum(before, 1), 0.0)
        stay = np.where(before > 0, 1 - CACHE, 1.0)
        # The end of a text is its last token. Every text has one, so its probability needs no back-off.
        end = np.log10(np.maximum(totals.ends[1:], 0.5) / np.maximum(totals.tokens[1:], 1))
        prior = np.log10((totals.ends[1:] + 0.5) / (totals.ends[0] + 0.5 * len(ends)))
        last = np.where(np.bincount(owner, minlength=len(texts)) > 0, np.log10(1 - CACHE), 0.0)
        each = []
        for k in range(len(ends)):
            p = said["p"][place, k].astype(float)
            own = np.maximum(np.log10(stay * 10.0**p + again), p + np.log10(stay)) if len(p) else p
            each.append(prior[k] + end[k] + last + total(own))
        each = np.stack(each, axis=1)
        best = each.max(axis=1)
        score = best + np.log10((10.0 ** (each - best[:, None])).sum(axis=1))
        return pa.table(
            {
                "doc_id": rows.column("doc_id"),
                "held_out": rows.column("held_out"),
                "n_tokens": pa.array(np.bincount(owner, minlength=len(texts)) + 1, pa.int64()),
                "n_known": pa.array(total(known[place]).astype(np.int64) + int(totals.ends[0] > 0), pa.int64()),
                "train_tokens": pa.array([int(totals.tokens[0])] * len(texts), pa.int64()),
                "base_score": pa.array(total(base[place]) + np.log10(totals.ends[0] + 1) - scale),
                "score": pa.array(score),
            }
        )

    told = C.exchange(chunks, 1, ask, settle, np.dtype("<u8"), facts=facts)
    return C.with_answers(chunks, told, finish, _SCORES)
