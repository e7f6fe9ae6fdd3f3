"""Language identification by multilingual mixture inference.

Each language has byte-trigram probabilities, counted over all texts that may be learned from. A document
is a mixture: every word comes from one of its languages, and expectation-maximisation over the words'
likelihoods estimates the languages' proportions. Languages are then taken away as long as the likelihood
lost stays below a penalty (half the logarithm of the number of words each, and MARGIN), which leaves the
document's set of languages; the one of greatest proportion is the prediction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castlens.llm import textops as tx

BITS = 16                    # 2^16 hashed trigrams
SMOOTH = 0.1                 # added to each count
ROUNDS, AGAIN = 10, 3        # EM steps over all languages, and after each removal
MARGIN = 3.0                 # added to the penalty of a language
FLUSH_BYTES = 1 << 26        # of text, or of a task's counts
CELLS = 1 << 22              # likelihoods of words in languages in memory at a time, but for a longer text


def trigrams(part: np.ndarray, at: np.ndarray):
    """Hashed trigram at each byte of the words, first trigram of each word, and the words before each text.

    A word of n bytes has n trigrams: its bytes, A-Z lower-cased, each with the byte before and after it, which
    are 0 at the ends.
    """
    ws, we, first = tx.words(part, at)
    low = tx.LOWER[part].astype(np.uint32)
    prev, then = np.zeros(len(low), np.uint32), np.zeros(len(low), np.uint32)
    prev[1:], then[:-1] = low[:-1], low[1:]
    prev[ws], then[we - 1] = 0, 0
    inside = np.flatnonzero(~tx.SPACE[part])
    g = ((prev[inside] << np.uint32(16)) | (low[inside] << np.uint32(8)) | then[inside]) * np.uint32(2654435761)
    return (g >> np.uint32(32 - BITS)).astype(np.int64), np.concatenate(([0], np.cumsum(we - ws)))[:-1].astype(np.int64), first


def _count(batches):
    """(lang, slot, n): trigram counts by language, over FLUSH_BYTES of text or counts at a time."""
    held: dict[str, np.ndarray] = {}
    size = 0

    def out():
        for lang, n in held.items():
            slot = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slot), pa.string()), pa.array(slot, pa.int32()), pa.array(n[slot])],
                                             names=["lang", "slot", "n"])
    for batch in batches:
        data, off = tx.utf8(batch.column(0))
        langs = np.array(batch.column(1).to_pylist(), dtype=object)
        for a, b, part, at in tx.runs(data, off):
            g, start, first = trigrams(part, at)
            at_word = np.append(start, len(g))
            for lang in set(langs[a:b]):
                mine = np.flatnonzero(langs[a:b] == lang)
                took = np.concatenate([g[at_word[first[i]]:at_word[first[i + 1]]] for i in mine])
                if lang not in held:
                    held[lang] = np.zeros(1 << BITS, np.int64)
                held[lang] += np.bincount(took, minlength=1 << BITS)
                if len(held) << (BITS + 3) > FLUSH_BYTES:
                    yield from out()
                    held, size = {}, 0
            size += len(part)
        if size >= FLUSH_BYTES:
            yield from out()
            held, size = {}, 0
    yield from out()


class Trigrams:
    """Logarithms of trigram probabilities, a row for each language: of the trigrams that it has, and of any other."""

    def __init__(self):
        self.rows: list[tuple[np.ndarray, np.ndarray, np.float32]] = []

    def add(self, slot: np.ndarray, n: np.ndarray):
        row = np.full((1 << BITS) + 1, SMOOTH)
        row[slot] += n
        row = np.log(row / row[:-1].sum()).astype(np.float32)
        self.rows.append((slot.astype(np.uint16 if BITS <= 16 else np.uint32), row[slot], row[-1]))

    def __len__(self):
        return len(self.rows)

    def __iter__(self):
        for slot, values, other in self.rows:
            row = np.full(1 << BITS, other, np.float32)
            row[slot] = values
            yield row


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], Trigrams]:
    """Languages in order and the logarithms of their trigram probabilities, from all rows of ``docs``.

    Rows without text or language are left out. The driver gets the counts that are not 0, 2^BITS at most for each
    language, however many languages there are.
    """
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = known.mapInArrow(_count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    rows = counts.groupBy("lang").agg(F.collect_list(F.struct("slot", "n")).alias("c"))
    got = rows.toArrow()
    column = got.column("lang").to_pylist()
    langs, table = [], Trigrams()
    for i in sorted(range(len(column)), key=lambda i: column[i]):
        langs.append(column[i])
        c = got.column("c")[i].values
        table.add(c.field("slot").to_numpy(), c.field("n").to_numpy())
    return langs, table


def _likelihood(like: np.ndarray, share: np.ndarray, of: np.ndarray):
    """Parts of each language in each word and the log-likelihood of each word."""
    joint = share[of] * like
    total = joint.sum(1)
    return joint / total[:, None], np.log(total)


def mixtures(log_like: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Proportions of the languages in each text (0 for those not in its set), from words' log-likelihoods.

    ``first`` has the words before each text; texts without words get zeros.
    """
    n, k = len(first) - 1, log_like.shape[1]
    out = np.zeros((n, k))
    some = np.flatnonzero(np.diff(first))
    if not len(some):
        return out
    count = np.diff(first)[some]
    at = first[:-1][some]
    of = np.repeat(np.arange(len(some)), count)
    top = log_like.max(1, keepdims=True)
    like = np.maximum(np.exp(log_like - top), 1e-30)
    share = np.full((len(some), k), 1.0 / k)

    def em(share, steps):
        for _ in range(steps):
            parts, _ = _likelihood(like, share, of)
            share = np.add.reduceat(parts, at) / count[:, None]
        return share

    def fitness(share):
        return np.add.reduceat(np.log(np.maximum((share[of] * like).sum(1), 1e-300)), at)
    share = em(share, ROUNDS)
    fit_now = fitness(share)
    penalty = 0.5 * np.log(count) + MARGIN
    open_ = np.ones(len(some), dtype=bool)
    for _ in range(k - 1):
        least = np.where(share > 0, share, 2.0).argmin(1)
        less = share.copy()
        less[np.arange(len(some)), least] = 0.0
        open_ &= (share > 0).sum(1) > 1
        left = less.sum(1, keepdims=True)
        less = np.where(left > 1e-12, less / np.maximum(left, 1e-300), (share > 0) * 1.0)
        less[~open_] = share[~open_]
        less = em(less, AGAIN)
        fit_less = fitness(less)
        open_ &= fit_now - fit_less < penalty
        share[open_], fit_now[open_] = less[open_], fit_less[open_]
        if not open_.any():
            break
    out[some] = share
    return out


def _letters(part: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which texts hold a letter."""
    low = tx.LOWER[part]
    ascii_letter = np.concatenate(([0], np.cumsum((low >= 97) & (low <= 122))))
    wide = np.concatenate(([0], np.cumsum(part >= 128)))
    has = np.diff(ascii_letter[at]) > 0
    for i in np.flatnonzero(~has & (np.diff(wide[at]) > 0)):
        has[i] = any(c.isalpha() for c in part[at[i]:at[i + 1]].tobytes().decode())
    return has


def _blocks(first: np.ndarray, most: int):
    """Ranges of texts of at most so many words, or of one longer text; ``first`` has the words before each."""
    c, n = 0, len(first) - 1
    while c < n:
        d = max(c + 1, int(np.searchsorted(first, first[c] + most, side="right")) - 1)
        yield c, min(d, n)
        c = min(d, n)


def identifier(langs: list[str], table: Trigrams):
    """Arrow UDF: text to (lang, score, languages): prediction, its proportion, and the set with proportions."""
    pair = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(texts: pa.Array) -> pa.Array:
        data, off = tx.utf8(texts)
        n = len(off) - 1
        lang, score, sets = ["und"] * n, np.zeros(n), [[] for _ in range(n)]
        for a, b, part, at in tx.runs(data, off):
            if not langs or not len(part):
                continue
            g, start, first = trigrams(part, at)
            if not len(start):
                continue
            has = _letters(part, at)
            end = np.append(start, len(g))
            for c, d in _blocks(first, max(1, CELLS // len(langs))):
                w, v = first[c], first[d]
                if w == v:
                    continue
                mine, begin = g[end[w]:end[v]], start[w:v] - end[w]
                words = np.stack([np.add.reduceat(row[mine], begin) for row in table], axis=1).astype(np.float64)
                share = mixtures(words, first[c:d + 1] - w)
                best = share.argmax(1)
                for i in np.flatnonzero(has[c:d] & (share.sum(1) > 0)):
                    lang[a + c + i], score[a + c + i] = langs[best[i]], min(1.0, share[i, best[i]])
                    sets[a + c + i] = [{"lang": langs[j], "share": float(share[i, j])} for j in np.flatnonzero(share[i] > 0)]
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(sets, pair)],
                                          names=["lang", "score", "languages"])
    return F.arrow_udf(run, "lang string, score double, languages array<struct<lang:string,share:double>>")


def identify(docs: DataFrame, learn: DataFrame, *, text_col: str = "text", lang_col: str = "lang",
             out_col: str = "language") -> DataFrame:
    """``docs`` with a struct ``out_col``: lang, score and languages, learned from the rows of ``learn``.

    Texts that are null or hold no letter get ``und``, score 0 and no languages, and so do all if nothing could
    be learned. Ties go to the first language in order; repeated rows and equal texts get equal results, a very long
    text is read whole, an empty table stays empty. A column already named ``out_col`` is replaced.
    """
    langs, table = fit(learn, text_col=text_col, lang_col=lang_col)
    return docs.withColumn(out_col, identifier(langs, table)(F.col(text_col)))
