"""Small tables and brute-force computations shared by the tests."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, key string"
SF = "/root/testdata/sf0.001"


def odd_texts() -> list[str | None]:
    """Null, empty, blank, tiny, tied, odd white space and very long texts."""
    r = random.Random(5)
    words = ["alpha", "beta", "Gamma", "delta", "ÉTÉ", "naïve", "日本", "x1", "-", "don't"]
    long = " ".join(r.choice(words) + str(r.randrange(900)) for _ in range(20_000))
    base = [r.choice(words) + str(r.randrange(50)) for _ in range(120)]
    near = base[:60] + ["changed"] + base[61:]
    return [None, "", "   ", "\n\t\n", "one", "one", "ONE", "a b c", " ".join(base), " ".join(near), " ".join(base).upper(), "a\x0bb\x0cc\xa0d\x1ce\x85f", "  two  words \n\n", long, "\x00 <|endoftext|> [INST]", "x" * 5000, "Same line\nSame line\nother\n\n \nSame line"]


def odd_table(spark, extra: list[str | None] = ()):
    """Odd texts with repeated rows, a null id, null sources, and columns named like the operators' own."""
    texts = [*odd_texts(), *extra]
    rows = [(i, t, None, None if i % 5 == 0 else f"s{i % 3}", 7, i, "k") for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, texts[8], "en", "s1", None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty_table(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def shingles(text: str | None, n: int) -> set[tuple[bytes, ...]]:
    w = [x.lower() for x in words_of(text)]
    if not w:
        return set()
    k = min(n, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def components(n: int, links: list[tuple[int, int]]) -> list[int]:
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return [find(i) for i in range(n)]
