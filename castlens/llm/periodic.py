"""Periodic runs of words: maximal stretches that repeat a period four times or more.

In a task, texts are worked on some at a time as one sequence of word numbers, with a number of its own after each
text. Suffixes are sorted only at the places of a difference cover (COVER modulo MODULUS): any two places i and j reach a
common shift below MODULUS at which both are in the cover. The longest common extension of i and j compares the few words
up to that shift and then takes the least common prefix between the two sampled suffixes from a sparse table. The same
structure over the reversed sequence extends to the left.

A run of period q and length L has L - q places whose word equals the word q further on, so a grid of that spacing
hits every run: over all periods the grids hold a harmonic sum of places, and only those where the words are equal are
extended. Each text's runs are found from its own row; nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castlens.llm import textops as tx
from castlens.llm.frames import fresh, small_batches

MODULUS = 13
COVER = (0, 1, 3, 9)         # fixed values: every difference modulo 13 is one of two of these
REPEATS = 4                  # a run holds its period so many times
LEAST = 6                    # words of a run at least
ASKED = 1 << 20              # grid places in memory at a time

RUNS = "struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


def _shifts() -> np.ndarray:
    """For i and j modulo MODULUS, the least shift that brings both into the cover."""
    inside = np.isin(np.arange(MODULUS), COVER)
    out = np.zeros((MODULUS, MODULUS), np.int64)
    for i in range(MODULUS):
        for j in range(MODULUS):
            out[i, j] = next(d for d in range(MODULUS) if inside[(i + d) % MODULUS] and inside[(j + d) % MODULUS])
    return out


SHIFT = _shifts()


class Extensions:
    """Longest common extensions to the right within a sequence of numbers from 1 up, whose end differs from all."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.n = n
        # beyond the end each place has a number of its own, so extensions end there
        top = int(symbols.max(initial=0)) + 1
        self.text = np.concatenate((symbols, np.arange(top, top + 2 * MODULUS)))
        self.at = np.flatnonzero(np.isin(np.arange(n + MODULUS) % MODULUS, COVER))       # sampled places
        self.index = np.full(n + MODULUS, -1, np.int64)
        self.index[self.at] = np.arange(len(self.at))
        self._sort()

    def _sort(self) -> None:
        """Sampled suffixes in order: by their first MODULUS words, then by doubling over the ranks of sampled places."""
        m = len(self.at)
        per = 62 // max(1, int(self.text.max()).bit_length())
        width = int(self.text.max()).bit_length()
        keys = []
        for a in range(0, MODULUS, per):
            key = np.zeros(m, np.int64)
            for k in range(a, min(a + per, MODULUS)):
                key = (key << width) | self.text[self.at + k]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.ones(m, bool)
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        rank = np.empty(m, np.int64)
        rank[order] = np.cumsum(new) - 1
        levels, size = [rank], MODULUS
        while m and int(rank.max()) < m - 1:
            # a place in the cover stays in it MODULUS words on, so doubling stays among sampled places
            place = self.at + size
            then = np.full(m, -1, np.int64)
            there = place < len(self.index)
            then[there] = rank[self.index[place[there]]]
            # words that reach the end differ already, so the missing ranks decide nothing
            pair = rank * (m + 1) + then + 1
            order = np.argsort(pair, kind="stable")
            new = np.ones(m, bool)
            new[1:] = pair[order][1:] != pair[order][:-1]
            rank = np.empty(m, np.int64)
            rank[order] = np.cumsum(new) - 1
            levels.append(rank)
            size *= 2
        self.rank = rank
        a, b = self.at[order[:-1]], self.at[order[1:]]
        common = np.zeros(max(m - 1, 0), np.int64)
        for k in range(len(levels) - 2, -1, -1):
            x, y = a + common, b + common
            inside = (x < len(self.index)) & (y < len(self.index))
            same = np.zeros(len(a), bool)
            same[inside] = levels[k][self.index[x[inside]]] == levels[k][self.index[y[inside]]]
            common[same] += MODULUS << k
        common += self._words(a + common, b + common, np.full(len(a), MODULUS))
        self.table = [common]
        while 2 << (len(self.table) - 1) <= len(common):
            t, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(t[:len(t) - half], t[half:]))

    def _words(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Common words from places i and j, ``most`` at most, one after another."""
        out = np.zeros(len(i), np.int64)
        live = np.flatnonzero(most > 0)
        while len(live):
            k = out[live]
            live = live[self.text[i[live] + k] == self.text[j[live] + k]]
            out[live] += 1
            live = live[out[live] < most[live]]
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of words that agree from places i and j (different ones) on."""
        shift = SHIFT[i % MODULUS, j % MODULUS]
        out = self._words(i, j, shift)
        on = np.flatnonzero(out == shift)
        a, b = self.rank[self.index[i[on] + shift[on]]], self.rank[self.index[j[on] + shift[on]]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        least = np.zeros(len(on), np.int64)
        for k in np.unique(level):
            t, mine = self.table[k], level == k
            least[mine] = np.minimum(t[low[mine]], t[high[mine] - (1 << int(k))])
        out[on] += least
        return out


def _grid(first: np.ndarray):
    """(places, periods): for each period a grid that hits every run of it, some periods at a time."""
    size = np.diff(first)
    long = int(size.max(initial=0))
    place, period, held = [], [], 0
    texts, begin = size, first[:-1]
    for q in range(1, long // REPEATS + 1):
        step = max(LEAST, REPEATS * q) - q
        some = texts >= step + q
        texts, begin = texts[some], begin[some]
        if not len(texts):
            continue
        count = (texts - q - 1) // step + 1                     # places below the text's end less q
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        place.append(np.repeat(begin, count) + at * step)
        period.append(np.full(len(at), q, np.int64))
        held += len(at)
        if held >= ASKED:
            yield np.concatenate(place), np.concatenate(period)
            place, period, held = [], [], 0
    if held:
        yield np.concatenate(place), np.concatenate(period)


def find_runs(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs in texts whose words (numbers from 0) stand one after another; ``first`` holds
    each text's first word (and the end). Sorted by start, then period."""
    n, texts = len(words), len(first) - 1
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for place, period in _grid(first):
        same = words[place] == words[place + period]
        if same.any():
            found.append((place[same], period[same]))
    if not found:
        return none, none, none
    i, q = (np.concatenate(x) for x in zip(*found, strict=True))
    text = np.searchsorted(first, i, side="right") - 1
    # a number of its own after each text
    seq = np.zeros(n + texts, np.int64)
    doc = np.repeat(np.arange(texts), np.diff(first))
    place = np.arange(n) + doc
    seq[place] = words + 1
    seq[first[1:] + np.arange(texts)] = int(words.max()) + 2 + np.arange(texts)
    at = i + text
    right = Extensions(seq).common(at, at + q)
    behind = len(seq) - 1 - at                                  # the same places in the reversed sequence
    left = np.zeros(len(i), np.int64)
    reverse = Extensions(seq[::-1].copy())
    inner = at > 0
    # extensions end at the sequence's ends by themselves: beyond them every place has a number of its own
    left[inner] = reverse.common(behind[inner] + 1, behind[inner] + 1 - q[inner])
    start, length = i - left, left + right + q
    ok = length >= np.maximum(LEAST, REPEATS * q)
    start, length, q = start[ok], length[ok], q[ok]
    order = np.lexsort((q, length, start))
    start, length, q = start[order], length[order], q[order]
    new = np.ones(len(q), bool)                                  # one stretch, its smallest period
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, q = start[new], length[new], q[new]
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


def _collapse(texts: pa.Array) -> pa.Array:
    data, off = tx.utf8(texts)
    runs, kept = [], []
    for i, j, part, at in tx.runs(data, off):
        ws, we, first = tx.words(part, at)
        number = np.unique(tx.hash_spans(part, ws, we), return_inverse=True)[1].astype(np.int64)
        start, length, period = find_runs(number, first)
        level = np.zeros(len(ws) + 1, np.int64)
        np.add.at(level, start + period, 1)
        np.add.at(level, start + length, -1)
        stay = np.cumsum(level)[:-1] == 0
        raw = part.tobytes()
        mine = np.searchsorted(start, first)
        for d in range(j - i):
            own = slice(mine[d], mine[d + 1])
            runs.append([{"start": s, "length": n, "period": q} for s, n, q in
                         zip((start[own] - first[d]).tolist(), length[own].tolist(), period[own].tolist(), strict=True)])
            w = np.arange(first[d], first[d + 1])[stay[first[d]:first[d + 1]]]
            kept.append(b" ".join([raw[s:e] for s, e in zip(ws[w].tolist(), we[w].tolist(), strict=True)]).decode())
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    return pa.StructArray.from_arrays([pa.array(runs, pa.list_(kind)), pa.array(kept, pa.string())], names=["runs", "collapsed"])


def collapse_runs(docs: DataFrame, *, text_col: str = "text", out_col: str = "periodic") -> DataFrame:
    """``docs`` with ``out_col``: every run (start and length in words, smallest period) by start, then period, and the
    text's words joined by one space without those that a run holds after its first period.

    A run is a stretch of consecutive words with smallest period q, at least LEAST words and REPEATS periods long,
    that no neighbouring word extends keeping period q. Null, empty and blank texts have no runs and collapse to the
    empty text. Words are told apart by 64-bit hashes within a run of texts. Rows are independent of each other, so
    repeated rows and null ids change nothing; an empty table gives an empty table. A column named ``out_col`` is replaced.
    """
    small_batches(docs.sparkSession)
    return docs.withColumn(out_col, F.arrow_udf(_collapse, RUNS)(F.col(text_col)))


def _plant(texts: pa.Array, a: pa.Array, p: pa.Array) -> pa.Array:
    data, off = tx.utf8(texts)
    begin, period = a.to_numpy(zero_copy_only=False), p.to_numpy(zero_copy_only=False)
    out = []
    for i, j, part, at in tx.runs(data, off):
        ws, we, first = tx.words(part, at)
        raw = part.tobytes()
        for d in range(j - i):
            w, n = np.arange(first[d], first[d + 1]), first[d + 1] - first[d]
            if n:
                from_ = int(begin[i + d]) % int(n)
                size = 1 + (int(n) - from_) // int(period[i + d])
                w[from_:] = w[from_] + np.arange(n - from_) % size
            out.append(b" ".join([raw[s:e] for s, e in zip(ws[w].tolist(), we[w].tolist(), strict=True)]).decode())
    return pa.array(out, pa.string())


def plant_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a periodic tail written into the texts of about a tenth of the ids, a test of the runs that every
    reader of the table can repeat: with h the crc32 of the decimal id and g = floor(h / 10), for h % 10 = 0 each of the n
    words from a = g % n on becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)),
    all joined by one space. Rows with a null id stay."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g, mine = F.floor(h / 10), F.coalesce(h % 10 == 0, F.lit(False))
    planted = F.arrow_udf(_plant, "string")(F.when(mine, F.col(text_col)), F.coalesce(g, F.lit(0)), F.coalesce(3 + g % 8, F.lit(3)))
    mark = fresh(docs, "planted")
    return docs.withColumn(mark, planted).withColumn(text_col, F.when(mine, F.col(mark)).otherwise(F.col(text_col))).drop(mark)


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_runs; start, length, period and exponent_milli of the longest run (ties: the
    smallest start, then period; null without a run); runs_sha256 and collapsed_sha256. The sha256 of runs is that of
    ``start,length,period`` and a line feed for each."""
    got = collapse_runs(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), out_col="periodic")
    runs = F.col("periodic.runs")
    top = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
                                                            r["period"].cast("string"), F.lit("\n"))), "")
    return (got.select("id", F.size(runs).cast("long").alias("n_runs"), top.alias("top"), F.sha2(lines, 256).alias("runs_sha256"),
                       F.sha2(F.col("periodic.collapsed"), 256).alias("collapsed_sha256"))
            .select(F.col("id").alias(id_col), "n_runs", (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"),
                    (-F.col("top.period")).alias("period"),
                    F.floor(1000 * F.col("top.length") / -F.col("top.period")).cast("long").alias("exponent_milli"),
                    "runs_sha256", "collapsed_sha256"))
