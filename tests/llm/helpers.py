"""Documents with every awkward case, and plain Python versions of what the operators compute."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "tk string, id int, drops string, pos int, n_lines string, __drops int, label int")
EXTRA = ("x", 7, "d", 3, "was", 1, 5)     # columns whose names the operators use themselves
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
LINE = "this line stands in many documents of this corpus"


def rows(texts, sources=("s1",)):
    return [(i, t, "en", sources[i % len(sources)], len(t or ""), *EXTRA) for i, t in enumerate(texts)]


def awkward(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows."""
    base = "one two three four five six seven eight nine ten eleven twelve"
    data = rows([None, "", "   \t\n", base, base, LONG, f"{LINE}\nalpha", f"  {LINE.upper()}  \nbeta", f"{LINE}\n{LINE}\ngamma",
                 "é" * 40, "word", "a b c", "\n\n", "don't 've x's  y"])
    data.append((3, base, None, None, None, *[None] * 7))          # the same id again
    data.append((None, base + " more", None, None, None, *[None] * 7))
    data += [(None, None, None, None, None, *[None] * 7), data[6], data[6]]
    return spark.createDataFrame(data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def classes(n, links):
    """Least index reachable over the links."""
    low = list(range(n))

    def find(x):
        while low[x] != x:
            x = low[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]
