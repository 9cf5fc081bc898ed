"""Benchmark decontamination by spaced seeds.

A seed is a mask over consecutive tokens; the positions it ignores may differ, so a passage with single words replaced
still has windows that hash alike under one of the masks. All windows of the test items are hashed once and kept
sorted; every window of every training document is looked up, a hit names an item and an alignment, and the tokens
around it are compared one by one along that alignment.

A document overlaps with an item if, along one alignment,

* the whole item lies in the document and at least ``LEAST_EQUAL`` of its tokens are equal, wherever the others are
  (all of them, if it has fewer than ``EXACT_BELOW``), or
* a stretch of at least ``LEAST_OVERLAP`` tokens, equal at both ends, has that share of equal tokens.

The masks miss no whole item of up to 20 tokens that the first rule takes, tested one by one; the tests hold them
against brute force. Items of 12 tokens and more are hashed under ``MASKS`` at every position, shorter ones once as
a whole under masks of their own length (`whole_masks`), which cost nothing where no such item exists.

The test items are read in blocks of at most ``BLOCK_TOKENS`` tokens, each broadcast in turn over all documents, so what
is broadcast is bounded however large the benchmark is. Documents are read once a block, without any shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger.llm.chunks import in_batches
from siteledger.llm.hashing import BYTE, LOWER, STEP, mix

#: The masks: 1 compares a token, 0 ignores it. Together they find 12 tokens with any two replaced, 15 with any three.
MASKS = ("1110100011", "11010111", "110010111", "111111")
#: Tokens an overlap needs where it is not a whole item, and the share of them that must be equal.
LEAST_OVERLAP, LEAST_EQUAL = 13, 0.8
#: Items of fewer tokens are found as they are only, and items of fewer than the second figure by masks of their length.
EXACT_BELOW, MASKED_WHOLE_BELOW = 6, 12
BLOCK_TOKENS = 1 << 21
_BITS = 22
_PART = np.ones(256, bool)
_PART[:48] = _PART[58:65] = _PART[91:97] = _PART[123:128] = False
_GROUP = 1 << 20
_SLICE = 1 << 21


def tokens(texts: list[bytes]) -> list[np.ndarray]:
    """Fingerprints of each text's tokens: runs of letters and digits (all of non-ASCII), A-Z lower-cased."""
    data = LOWER[np.frombuffer(b" ".join(texts), np.uint8)]
    edge = np.diff(np.concatenate(([False], _PART[data], [False])).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lengths = ends - starts
    begin = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
    powers = np.multiply.accumulate(np.full(int(lengths.max(initial=0)) + 1, STEP[62], np.uint64))
    hashes = mix(np.add.reduceat(BYTE[data[place + np.repeat(starts, lengths)]] * powers[place], begin)) if len(starts) else np.empty(0, np.uint64)
    offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])
    return np.split(hashes, np.searchsorted(starts, offsets[1:-1]))


def windows(words: np.ndarray, mask: str) -> np.ndarray:
    """The seed's fingerprint at every position where the whole mask fits."""
    n = max(0, len(words) - len(mask) + 1)
    out = np.full(n, STEP[61], np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out += words[k : k + n] * STEP[40 + k]
    return mix(out)


def least_equal(n: int) -> int:
    """The tokens of a whole item of ``n`` tokens that must be equal."""
    return n if n < EXACT_BELOW else int(np.ceil(n * LEAST_EQUAL - 1e-9))


def whole_masks(n: int) -> list[str]:
    """Masks over all of ``n`` tokens, one of which ignores whichever tokens may differ.

    With k tokens that may differ, the tokens fall into k + 2 parts; each mask ignores k of the parts.
    """
    may_differ = n - least_equal(n)
    part = np.arange(n) * (may_differ + 2) // n
    return ["".join("01"[p not in out] for p in part) for out in combinations(range(may_differ + 2), may_differ)]


@dataclass
class Seeds:
    """The windows of a block's items under one mask, sorted by fingerprint and by that of the window before."""

    mask: str
    hashes: np.ndarray
    keys: np.ndarray
    items: np.ndarray
    places: np.ndarray
    filter: np.ndarray

    @classmethod
    def of(cls, mask: str, words: dict[int, np.ndarray]) -> Seeds:
        each = {i: windows(w, mask) for i, w in words.items()}
        lengths = [len(x) for x in each.values()]
        hashes = np.concatenate([np.empty(0, np.uint64), *each.values()])
        items = np.repeat(np.array(list(each), np.int64), lengths)
        places = np.concatenate([np.empty(0, np.int64), *[np.arange(n) for n in lengths]])
        distinct, rank = np.unique(hashes, return_inverse=True)
        before = np.where(places > 0, np.roll(rank, 1), -1)
        keys = rank * (len(distinct) + 2) + before + 1
        order = np.argsort(keys, kind="stable")
        seen = np.zeros(1 << _BITS, bool)
        seen[hashes >> np.uint64(64 - _BITS)] = True
        return cls(mask, distinct, keys[order], items[order], places[order], seen)

    def hits(self, words: np.ndarray):
        """Slices of (item, shift) where a window of ``words`` meets one of an item, unless those before it meet too.

        Where the windows before are alike as well, they have the same item and shift. Leaving such hits out keeps
        the number for repeated tokens near the sum of both lengths instead of their product.
        """
        own = windows(words, self.mask)
        at = np.flatnonzero(self.filter[own >> np.uint64(64 - _BITS)])
        if not len(at):
            return
        rank = self._rank(own[at])
        at, rank = at[rank >= 0], rank[rank >= 0]
        if not len(at):
            return
        wide = len(self.hashes) + 2
        before = np.where(at > 0, self._rank(own[at - 1]), -1)
        low, high = np.searchsorted(self.keys, rank * wide), np.searchsorted(self.keys, (rank + 1) * wide)
        same = rank * wide + before + 1
        skip_low = np.where(before >= 0, np.searchsorted(self.keys, same, "left"), high)
        skip_high = np.where(before >= 0, np.searchsorted(self.keys, same, "right"), high)
        at, low, high = np.tile(at, 2), np.concatenate((low, skip_high)), np.concatenate((skip_low, high))
        at, low, high = at[high > low], low[high > low], high[high > low]
        total = np.cumsum(high - low)
        begin = 0
        while begin < len(at):
            done = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, done + _SLICE, "right")))
            n = high[begin:end] - low[begin:end]
            hit = np.repeat(low[begin:end] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            yield self.items[hit], np.repeat(at[begin:end], n) - self.places[hit]
            begin = end

    def _rank(self, own: np.ndarray) -> np.ndarray:
        near = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        return np.where(self.hashes[near] == own, near, -1)


@dataclass
class Items:
    """A block of items: their ids, their tokens and the seeds of every mask that some of them need."""

    ids: list[int]
    words: list[np.ndarray]
    seeds: list[Seeds]

    @classmethod
    def of(cls, ids: list[int], texts: list[str | None]) -> Items:
        words = tokens([(t or "").encode() for t in texts])
        by_length: dict[int, dict[int, np.ndarray]] = {}
        for i, w in enumerate(words):
            if len(w):
                by_length.setdefault(min(len(w), MASKED_WHOLE_BELOW), {})[i] = w
        masks = {n: whole_masks(n) if n < MASKED_WHOLE_BELOW else MASKS for n in by_length}
        return cls(list(ids), words, [Seeds.of(m, by_length[n]) for n in sorted(by_length) for m in masks[n]])

    def overlaps(self, words: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(item number, overlap, equal tokens, start in the text, start in the item) of each item's best alignment.

        The best has most equal tokens; of those alike it is the first.
        """
        wide = len(words) + max((len(w) for w in self.words), default=0) + 1
        found = np.empty(0, np.int64)
        for seeds in self.seeds:
            for item, shift in seeds.hits(words):
                found = np.union1d(found, item * (2 * wide) + shift + wide)
        item, shift = found // (2 * wide), found % (2 * wide) - wide
        edges = np.flatnonzero(np.diff(item, prepend=-1, append=-1))
        best = [(int(item[a]), _best(words, self.words[item[a]], shift[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return [(i, *stretch) for i, stretch in best if stretch]


def _best(words: np.ndarray, item: np.ndarray, shifts: np.ndarray) -> tuple[int, int, int, int] | None:
    """The best stretch of the alignments; those that cannot be better for their number of equal tokens are left out."""
    low, high = int(shifts[0]), int(shifts[-1]) + len(item)
    padded = np.zeros(high - low, np.uint64)
    inside = slice(max(low, 0), min(high, len(words)))
    padded[inside.start - low : inside.stop - low] = words[inside]
    rows = np.lib.stride_tricks.sliding_window_view(padded, len(item))
    counts, step = [], max(1, _SLICE // len(item))
    for k in range(0, len(shifts), step):
        counts.append((rows[shifts[k : k + step] - low] == item).sum(axis=1))
        if counts[-1].max() == len(item):  # no later alignment is better
            break
    equal = np.concatenate(counts)
    best = None
    for k in np.argsort(-equal, kind="stable"):
        if equal[k] == 0 or (best and best[1] >= equal[k]):
            break
        found = _stretch(words, item, int(shifts[k]))
        if found and (best is None or found[1] > best[1]):
            best = found
    return best


def _stretch(words: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int, int] | None:
    """The longest stretch of an alignment that is equal enough, if it is long enough: overlap, equal tokens, both starts."""
    low, high = max(0, -shift), min(len(item), len(words) - shift)
    equal = words[low + shift : high + shift] == item[low:high]
    whole = high - low == len(item) and int(equal.sum()) >= least_equal(len(item))
    # A stretch is equal enough if these gains sum to 0 or more; the least sum so far gives the earliest start of each end.
    gain = np.concatenate(([0.0], np.cumsum(equal - LEAST_EQUAL)))
    starts = np.searchsorted(-np.minimum.accumulate(gain), -gain - 1e-9)
    end = int((np.arange(len(gain)) - starts).argmax())
    inside = np.flatnonzero(equal[starts[end] : end])
    if not len(inside):
        return None
    start, overlap = int(starts[end] + inside[0]), int(inside[-1] - inside[0] + 1)
    if overlap < LEAST_OVERLAP and not whole:
        return None
    return overlap, len(inside), low + start + shift, low + start


def _blocks(benchmark: DataFrame, block_tokens: int):
    """Broadcast blocks of items, each of about ``block_tokens`` tokens at most (one item is never split)."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // (2 * block_tokens)))  # a token and its separator take two bytes at least
    spark = benchmark.sparkSession
    for k in range(count):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == k).orderBy("item_id", "text").toArrow()
        yield spark.sparkContext.broadcast(Items.of(rows.column("item_id").to_pylist(), rows.column("text").to_pylist()))


def _groups(texts: list[str | None]):
    """Token arrays of all texts, made in groups of bounded size."""
    group, size = [], 0
    for t in texts:
        group.append((t or "").encode())
        size += len(group[-1])
        if size >= _GROUP:
            yield from tokens(group)
            group, size = [], 0
    if group:
        yield from tokens(group)


_HITS = "doc_id long, item_id long, overlap long, n_equal long, item_tokens long, doc_start long, item_start long"


def overlaps(docs: DataFrame, benchmark: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document and item that overlap: lengths and starts are in tokens, of the best stretch.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; NULL and blank texts overlap with nothing, equal rows
    give equal results, other columns are ignored. Empty tables give no rows. Items of any length are looked for; those
    of very few tokens occur in clean texts too, so filter such items from ``benchmark`` if they carry no content.
    """
    out = None
    for items in _blocks(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), block_tokens):
        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_finder(items), _HITS)
        out = found if out is None else out.unionByName(found)
    return out


def _finder(items):
    def find(batches):
        block = items.value
        for batch in batches:
            rows = []
            ids = batch.column("doc_id").to_pylist()
            for doc, words in zip(ids, _groups(batch.column("text").to_pylist()), strict=True):
                for item, overlap, same, start, item_start in block.overlaps(words):
                    rows.append((doc, block.ids[item], overlap, same, len(block.words[item]), start, item_start))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "overlap", "n_equal", "item_tokens", "doc_start", "item_start"])

    return find


def without_overlaps(docs: DataFrame, benchmark: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows of ``docs`` that overlap with no item, with all their columns; one pass for each block of items."""
    for items in _blocks(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), block_tokens):
        docs = in_batches(docs, _keeper(items))
    return docs


def _keeper(items):
    def keep(batches):
        block = items.value
        for batch in batches:
            clean = [not block.overlaps(words) for words in _groups(batch.column("text").to_pylist())]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return keep
