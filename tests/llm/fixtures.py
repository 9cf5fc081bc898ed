"""Small documents that have every odd case: NULLs, empty and long texts, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, tokens string, size long, score double, `a.b``c` int"


def sentence(rng: random.Random, n: int) -> str:
    parts = ["alpha", "béta", "gamma", "dé", "x", "yy", "zeta", "Omega", "lorem", "ipsum", "sit"]
    return " ".join(rng.choice(parts) + rng.choice(["", "s", "ing", "."]) for _ in range(n))


def texts(seed: int = 5, n: int = 90) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    shared = [sentence(rng, 30) for _ in range(6)]
    rows: list[tuple[int | None, str | None]] = []
    for i in range(n):
        t = sentence(rng, rng.choice([0, 1, 3, 20, 60]))
        if rng.random() < 0.5:
            t = f"{t} {rng.choice(shared)} {sentence(rng, rng.choice([0, 5]))}"
        if rng.random() < 0.2 and rows:
            t = rng.choice(rows)[1]
        elif rng.random() < 0.3 and rows:
            words = rng.choice(rows)[1].split()
            if words:
                words[rng.randrange(len(words))] = "edit"
                t = " ".join(words)
        rows.append((i * 3, t))
    rows += [(1000, None), (1001, ""), (1002, "a" * 300), (1003, "a" * 100), (1004, "ab" * 80), (1005, " \t\n "), (1006, "long " * 4000), (1006 + 1, "ü" * 60)]
    rng.shuffle(rows)
    return rows


def documents(spark, rows, parts: int = 3):
    full = [(d, t, "en" if (d or 0) % 2 else None, None if (d or 0) % 5 == 0 else f"s{(d or 0) % 4}", len(t or ""), "c", "t", 7, 0.5, 1) for d, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def words(text: str | None) -> list[bytes]:
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return re.findall(rb"[^\x20\x09-\x0d]+", lower)
