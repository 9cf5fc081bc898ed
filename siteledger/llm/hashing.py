"""Vectorised 64-bit fingerprints of byte runs, words and shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.default_rng(20240501)


def _odd(n: int) -> np.ndarray:
    return _RNG.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


BYTE = _odd(256)
STEP = _odd(64)
PLACE = _odd(8)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
SLICE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the word (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def doubling(data: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """Fingerprints of the ``length`` bytes from every position, for each length, by pairs of half as long ones."""
    level, width, step = BYTE[data], 1, 0
    out: list[list] = [[None, 0] for _ in lengths]
    while True:
        for i, length in enumerate(lengths):
            if length & width:
                have, at = out[i]
                if have is None:
                    out[i] = [level, width]
                else:
                    n = max(0, min(len(have), len(level) - at))
                    out[i] = [have[:n] * STEP[32 + step] + level[at : at + n], at + width]
        if width * 2 > max(lengths):
            return [x for x, _ in out]
        n = max(0, len(level) - width)
        level = level[:n] * STEP[step] + level[width:]
        width, step = width * 2, step + 1


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[: max(0, len(x) - done)], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[: max(0, len(x) - rest)], x[rest:]) if rest else x


def _cuts(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Slices that end at white space, as far as there is any."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + SLICE)
        while end < n:
            near = np.flatnonzero(SPACE[data[end : end + SLICE]])
            if len(near):
                end += int(near[0])
                break
            end = min(n, end + SLICE)
        yield at, end
        at = end


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, text number) of all words ``[^\\x20\\x09-\\x0D]+``; A-Z are lower-cased."""
    data = LOWER[np.frombuffer(b" ".join(texts), np.uint8)]
    offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))).astype(np.int64)
    inside = np.concatenate(([False], ~SPACE[data], [False])).view(np.int8)
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return data, starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One fingerprint per word."""
    out = np.empty(len(starts), np.uint64)
    longest = int((ends - starts).max()) if len(starts) else 0
    powers = np.multiply.accumulate(np.full(longest + 1, STEP[63], np.uint64))
    for a, b in _cuts(data):
        i, j = np.searchsorted(starts, [a, b])
        if i == j:
            continue
        s, e = starts[i:j], ends[i:j]
        lengths = e - s
        begin = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
        letters = BYTE[data[place + np.repeat(s, lengths)]]
        out[i:j] = np.add.reduceat(letters * powers[place], begin)
    return mix(out)


def shingles(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Per text the ascending distinct fingerprints of its word shingles; with fewer words the whole sequence is one."""
    data, starts, ends, owner = word_spans(texts)
    words = word_hashes(data, starts, ends)
    n = max(0, len(words) - width + 1)
    runs = np.zeros(n, np.uint64)
    for k in range(width):
        runs += words[k : k + n] * PLACE[k]
    runs = mix(runs)
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            x = np.sort(runs[a : b - width + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif b > a:
            whole = (words[a:b] * PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([whole], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
