"""Fixtures of the training-data tests: documents with every odd case, and brute-force versions."""

from __future__ import annotations

import collections
import random
import zlib

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, shard string, component_id string, ids string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ka", "lo", "mi", "tu", "re", "sa", "no"]) for _ in range(r.randint(1, 3))) for _ in range(n))


def near(text: str, seed: int, changes: int) -> str:
    r, w = random.Random(seed), text.split(" ")
    for _ in range(changes):
        w[r.randrange(len(w))] = "zz" + str(seed)
    return " ".join(w)


def rows() -> list[tuple]:
    """Nulls in any column, empty and very long texts, ties, repeated rows, extra columns that clash with results."""
    texts: list[str | None] = [None, "", "   \n\t ", "one", "two words", "12 34 ##", "été 你好 \U0001f600 naïve", "tab\there\r\nand  two spaces   nbsp"]
    texts += [prose(k, 60 + k) for k in range(12)]
    texts += [prose(3, 63)] * 5                                          # exact copies
    texts += [near(prose(5, 65), k, 1) for k in range(8)]                # near copies
    texts += [prose(90, 20_000), prose(90, 20_000)]                      # very long ones
    passage = prose(70, 55)
    texts += [prose(200 + k, 40) + "\n" + passage + "\n" + prose(300 + k, 30) for k in range(4)]
    texts += ["spam " * 200, prose(400, 30) + "\n" + prose(400, 30)]
    out = [(10 * k, t, ("en" if k % 3 else None), f"s{k % 3}" if k % 4 else None, len(t or ""), 7, "x", "y", "z") for k, t in enumerate(texts)]
    out.append(out[12])                                                  # a repeated row
    out.append((None, "without an id", "en", "s0", 13, 7, "x", "y", "z"))
    return out


def named(table: list[tuple]) -> list[tuple]:
    return [r for r in table if r[0] is not None]


def crc(ids: list[int]) -> int:
    import numpy as np

    return zlib.crc32(np.array(ids, "<u4").tobytes())


def shingles(text: str | None, width: int) -> frozenset:
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def similar(a: frozenset, b: frozenset, percent: int = 80) -> bool:
    both = len(a & b)
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def components(nodes: list, linked) -> dict:
    """node -> smallest node reachable, by comparing all pairs."""
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {n: root(n) for n in nodes}


def by(rows_, key) -> dict:
    out = collections.defaultdict(list)
    for r in rows_:
        out[key(r)].append(r)
    return out
