"""Token-set similarity (0-100), as a pairwise Arrow UDF and as a bounded all-against-all tile.

Score of two token sets A and B with common part S: 100 when S is not empty and one set contains
the other; otherwise the best of the insert/delete similarity of the two whole strings and, when
S is not empty, the similarity of S to either whole string. Lengths are those of the sorted
tokens joined by blanks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteledger.functions.text import SPACE


def lcs_length(x: str, y: str) -> int:
    """Length of the longest common subsequence, a machine word of positions at a time."""
    if len(x) > len(y):
        x, y = y, x
    if not x:
        return 0
    places: dict[str, int] = {}
    for i, ch in enumerate(x):
        places[ch] = places.get(ch, 0) | (1 << i)
    full = (1 << len(x)) - 1
    row = full
    for ch in y:
        hit = row & places.get(ch, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(x) - row.bit_count()


def _whole_ratio(a: frozenset, b: frozenset, total: int) -> float:
    x, y = " ".join(sorted(a - b)), " ".join(sorted(b - a))
    distance = len(x) + len(y) - 2 * lcs_length(x, y)
    return 100.0 - 100.0 * distance / total


def _joined_length(tokens) -> int:
    return sum(map(len, tokens)) + max(0, len(tokens) - 1)


def token_set_score(left: str | None, right: str | None) -> float:
    a, b = frozenset((left or "").split()), frozenset((right or "").split())
    if not a or not b:
        return 0.0
    common = a & b
    if common and (len(common) == len(a) or len(common) == len(b)):
        return 100.0
    la, lb, s = _joined_length(a), _joined_length(b), _joined_length(common)
    score = _whole_ratio(a, b, la + lb)
    if s:
        score = max(score, 100.0 - 100.0 * (la - s) / (s + la), 100.0 - 100.0 * (lb - s) / (s + lb))
    return score


@F.pandas_udf(T.DoubleType())
def _score_batch(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([token_set_score(a, b) for a, b in zip(left, right)], dtype="float64")


def token_set_similarity(left: Column, right: Column) -> Column:
    """Score of each row's pair; scored in Arrow batches."""
    return _score_batch(left, right)


def token_set(text: Column) -> Column:
    """Normal form of a token set: distinct tokens, sorted, joined by blanks."""
    tokens = F.filter(F.split(text, f"{SPACE}+"), lambda t: F.length(t) > 0)
    return F.array_join(F.array_sort(F.array_distinct(tokens)), " ")


_BUCKETS = 48
_VOCABULARY_SLICE = 4096


class TokenSets:
    """Token sets of one tile, with the bounds that decide most pairs without a character scan."""

    def __init__(self, texts: list[str]):
        self.sets = [frozenset(t.split()) for t in texts]
        self.length = np.array([_joined_length(s) for s in self.sets], dtype=np.float64)
        self.letters = np.zeros((len(texts), _BUCKETS), dtype=np.float32)
        for i, text in enumerate(texts):
            codes = np.frombuffer(text.replace(" ", "").encode("utf-32-le"), dtype=np.uint32)
            self.letters[i] = np.bincount(codes % _BUCKETS, minlength=_BUCKETS)

    def shared_weight(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Sum of (length + 1) over the tokens common to each row and column."""
        number: dict[str, int] = {}
        members: list[list[int]] = []
        wanted = set(rows.tolist()) | set(cols.tolist())
        for i, tokens in enumerate(self.sets):
            if i in wanted:
                members.append([number.setdefault(t, len(number)) for t in tokens])
            else:
                members.append([])
        weights = np.array([len(t) + 1 for t in number], dtype=np.float32)
        total = np.zeros((len(rows), len(cols)), dtype=np.float32)
        for start in range(0, len(number), _VOCABULARY_SLICE):
            stop = min(start + _VOCABULARY_SLICE, len(number))
            left = _incidence(members, rows, start, stop)
            right = _incidence(members, cols, start, stop)
            total += (left * weights[start:stop]) @ right.T
        return total

    def decide(self, rows: np.ndarray, cols: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(surely similar, maybe similar) for every row and column; all other pairs are surely not."""
        la, lb = self.length[rows][:, None], self.length[cols][None, :]
        weight = self.shared_weight(rows, cols).astype(np.float64)
        shared = weight > 0
        s = np.where(shared, weight - 1, 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            sure = shared & ((s == la) | (s == lb))
            sure |= shared & (100.0 - 100.0 * (la - s) / (s + la) >= threshold)
            sure |= shared & (100.0 - 100.0 * (lb - s) / (s + lb) >= threshold)
            floor = np.abs(la - lb)
            gap = np.zeros_like(weight, dtype=np.float32)
            for bucket in range(_BUCKETS):
                a, b = self.letters[rows, bucket], self.letters[cols, bucket]
                if a.any() or b.any():
                    gap += np.abs(a[:, None] - b[None, :])
            ceiling = 100.0 - 100.0 * np.maximum(floor, gap) / (la + lb)
        filled = (la > 0) & (lb > 0)
        return sure & filled, filled & ~sure & (ceiling >= threshold)

    def similar(self, i: int, j: int, threshold: float) -> bool:
        """Exact check of a pair that ``decide`` left open."""
        return _whole_ratio(self.sets[i], self.sets[j], int(self.length[i] + self.length[j])) >= threshold


def _incidence(members: list[list[int]], rows: np.ndarray, start: int, stop: int) -> np.ndarray:
    out = np.zeros((len(rows), stop - start), dtype=np.float32)
    for k, row in enumerate(rows.tolist()):
        inside = [m - start for m in members[row] if start <= m < stop]
        out[k, inside] = 1.0
    return out


class Groups:
    """Which rows of a tile already belong together, as one label per row."""

    def __init__(self, labels: list):
        first: dict = {}
        self.of = np.array([first.setdefault(label, i) for i, label in enumerate(labels)], dtype=np.int64)

    def join(self, i: int, j: int) -> None:
        a, b = self.of[i], self.of[j]
        self.of[self.of == max(a, b)] = min(a, b)


# Up to this many pairs the plain score is quicker than setting up the bounds.
FEW_PAIRS = 1024
_REMEMBERED = 1 << 16


class Similar:
    """``token_set_score(left, right) >= threshold``; texts recur in many blocks, so recent pairs are remembered."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.known: dict[tuple[str, str], bool] = {}

    def __call__(self, left: str, right: str) -> bool:
        pair = (left, right)
        if pair not in self.known:
            if len(self.known) >= _REMEMBERED:
                self.known.clear()
            self.known[pair] = self._check(left, right)
        return self.known[pair]

    def _check(self, left: str, right: str) -> bool:
        a, b, t = frozenset(left.split()), frozenset(right.split()), self.threshold
        if not a or not b:
            return False
        common, la, lb = a & b, _joined_length(a), _joined_length(b)
        if common:
            if len(common) in (len(a), len(b)):
                return 100.0 >= t
            s = _joined_length(common)
            if 100.0 - 100.0 * (la - s) / (s + la) >= t or 100.0 - 100.0 * (lb - s) / (s + lb) >= t:
                return True
        total = la + lb
        return 100.0 - 100.0 * abs(la - lb) / total >= t and _whole_ratio(a, b, total) >= t


def few_links(
    addresses: list[str], titles: list[str], labels: list, left: list[int], right: list[int], same_place: Similar, same_title: Similar
) -> list[tuple[int, int]]:
    """``tile_links`` for few pairs, by the plain score."""
    group = list(labels)
    links = []
    for i in left:
        for j in right:
            if group[i] == group[j] or (left is right and j < i):
                continue
            if same_place(addresses[i], addresses[j]) and same_title(titles[i], titles[j]):
                old, new = group[j], group[i]
                group = [new if g == old else g for g in group]
                links.append((i, j))
    return links


def tile_links(
    addresses: list[str],
    titles: list[str],
    labels: list,
    left: np.ndarray,
    right: np.ndarray,
    address_threshold: float,
    title_threshold: float,
) -> list[tuple[int, int]]:
    """Links (row, row) that join everything similar between ``left`` and ``right`` rows.

    A spanning set, not all similar pairs: rows already joined (by label or by an earlier link)
    get no further link. Certain pairs are linked first, so the character scan runs only for
    open pairs whose rows are still apart.
    """
    if len(left) * len(right) <= FEW_PAIRS:
        first = left.tolist()
        second = first if right is left else right.tolist()
        return few_links(addresses, titles, labels, first, second, Similar(address_threshold), Similar(title_threshold))
    groups = Groups(labels)
    links: list[tuple[int, int]] = []
    names = sorted(set(addresses))
    place = {a: k for k, a in enumerate(names)}
    of_row = np.array([place[a] for a in addresses])
    near = _near_addresses(names, np.unique(of_row[left]), np.unique(of_row[right]), address_threshold)
    same_place = near[of_row[left]][:, of_row[right]]
    sets = TokenSets(titles)
    sure, maybe = sets.decide(left, right, title_threshold)
    sure &= same_place
    maybe &= same_place
    for k, i in enumerate(left.tolist()):
        cols = right[sure[k]]
        apart = cols[groups.of[cols] != groups.of[i]]
        while len(apart):
            j = int(apart[0])
            groups.join(i, j)
            links.append((i, j))
            apart = apart[groups.of[apart] != groups.of[i]]
    for k, i in enumerate(left.tolist()):
        for j in right[maybe[k]].tolist():
            if groups.of[i] != groups.of[j] and sets.similar(i, j, title_threshold):
                groups.join(i, j)
                links.append((i, j))
    return links


def _near_addresses(names: list[str], rows: np.ndarray, cols: np.ndarray, threshold: float) -> np.ndarray:
    sets = TokenSets(names)
    near = np.zeros((len(names), len(names)), dtype=bool)
    sure, maybe = sets.decide(rows, cols, threshold)
    near[np.ix_(rows, cols)] = sure
    for k, c in np.argwhere(maybe).tolist():
        i, j = int(rows[k]), int(cols[c])
        if near[i, j] or near[j, i] or i == j or sets.similar(i, j, threshold):
            near[i, j] = True
    return near
