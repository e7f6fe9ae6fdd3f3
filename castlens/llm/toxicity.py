"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

A sentence's score is a logistic function of its words' weights; a document's score is the noisy-or of its
sentences, ``1 - prod(1 - p)``, whose gradient trains the weights from document labels alone. The same
sentence scores then locate what offends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castlens.llm import textops as tx
from castlens.llm.labelled import MAX_DOCS, training_shards, used_shards

ROUNDS, EPOCHS, BATCH, RATE, DECAY = 2, 20, 64, 0.5, 1e-3
HELD = 5                   # one document in so many is kept from the weights, to set their scale and the bias
SCALES, SHIFTS = (0.75, 1.0, 1.25, 1.5, 2.0, 2.5, 3.0), (-1.0, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0)
CALM = 5.0                 # squared gradient that every weight starts with: a word of few documents moves little
PREFIXES = (4, 5, 6, 7)
MIN_DF = 3                 # documents of a shard that hold a feature before it gets a weight
MAX_DF = 0.3               # part of a shard's documents, or twice the positive ones, that may hold a feature with a weight
MAX_WEIGHTS = 1 << 16      # heaviest weights that a shard hands on
SPAN = 0.5                 # sentences at or above it are reported
TALLY = 1 << 18            # features of texts that are held before their documents are counted

_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[48:58] = _TOKEN[97:123] = _TOKEN[128:] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[10, 33, 46, 63]] = True           # newline ! . ?


def sentences(part: np.ndarray, at: np.ndarray):
    """Feature hashes, first feature of each sentence, text of each sentence, and the sentence's bytes.

    Words are runs of ASCII letters and digits and of other characters, A-Z lower-cased; their features are
    the word and its prefixes of PREFIXES bytes, which inflected forms share (0 where a word is too short, and
    for a word that repeats the one before).
    Sentences end at ``.``, ``!``, ``?`` and newline; those without words do not count.
    """
    low = tx.LOWER[part]
    ts, te = tx.spans(_TOKEN[low], at)
    h = np.zeros((len(ts), 1 + len(PREFIXES)), dtype=np.uint64)
    h[:, 0] = tx.hash_spans(low, ts, te)
    for k, size in enumerate(PREFIXES, 1):
        longer = np.flatnonzero(te - ts > size)
        h[longer, k] = tx.mix(tx.hash_spans(low, ts[longer], ts[longer] + size), size)
    again = np.zeros(len(ts), dtype=bool)
    again[1:] = h[1:, 0] == h[:-1, 0]
    h[again] = 0
    doc = np.searchsorted(at, ts, side="right") - 1
    seq = np.cumsum(_STOP[low])[ts] if len(ts) else ts
    new = np.ones(len(ts), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (seq[1:] != seq[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(ts)) - 1
    return h.ravel(), first * h.shape[1], doc[first], ts[first], te[last] if len(first) else first


def _lookup(h: np.ndarray, vocab: np.ndarray) -> np.ndarray:
    """Index of each hash in the sorted vocabulary; len(vocab) if it is not there."""
    i = np.searchsorted(vocab, h)
    i[i == len(vocab)] = 0
    return np.where(vocab[i] == h, i, len(vocab)) if len(vocab) else np.zeros(len(h), np.int64)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _frequencies(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Sorted feature hashes, the texts that hold each, and how many features and sentences there are in all."""
    vocab, df = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    held, waiting, total, sentences_ = [], 0, 0, 0
    for _, b, part, at in tx.runs(data, off):
        h, first, doc, _, _ = sentences(part, at)
        total, sentences_ = total + len(h), sentences_ + len(first)
        before = np.searchsorted(np.repeat(doc, np.diff(np.append(first, len(h)))), np.arange(len(at)))
        held.append(tx.distinct_per_text(h, before)[0])
        waiting += len(held[-1])
        if waiting >= TALLY or b == len(off) - 1:
            both, of = np.unique(np.concatenate([vocab, *held]), return_inverse=True)
            count = np.bincount(of[len(vocab):], minlength=len(both))
            count[of[:len(vocab)]] += df
            vocab, df, held, waiting = both, count, [], 0
    return vocab, df, total, sentences_


def fit_shard(texts: pa.Array, y: np.ndarray, known: np.ndarray, start: np.ndarray, bias: float):
    """Feature hashes, their weights and the bias, by AdaGrad on the noisy-or likelihood of one shard's documents.

    ``known`` and ``start`` are the hashes and weights to begin with.
    """
    data, off = tx.utf8(texts)
    vocab, df, words, n = _frequencies(data, off)
    if not words:
        return known, start, bias
    vocab = vocab[(df >= MIN_DF) & (df <= max(MAX_DF * len(y), 2 * y.sum())) & (vocab != 0)]
    # the hashes are worked out again, a run at a time: all of them take several times what their indexes do
    first, sdoc, idx, at_word, at_sentence = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(words, np.int32), 0, 0
    for a, _, part, at in tx.runs(data, off):
        h, begin, doc, _, _ = sentences(part, at)
        first[at_sentence:at_sentence + len(begin)] = begin + at_word
        sdoc[at_sentence:at_sentence + len(begin)] = doc + a
        idx[at_word:at_word + len(h)] = _lookup(h, vocab)
        at_word, at_sentence = at_word + len(h), at_sentence + len(begin)
    v = len(vocab)
    w, acc, b, acc_b = np.zeros(v + 1), np.full(v + 1, CALM), bias, 1.0
    w[:v] = np.append(start, 0.0)[_lookup(vocab, known)]
    s_at = np.searchsorted(sdoc, np.arange(len(y) + 1))
    first = np.append(first, words)
    for epoch in range(EPOCHS):
        shuffled = np.argsort(tx.mix(np.arange(len(y), dtype=np.uint64), 77 + epoch))
        for i in range(0, len(y), BATCH):
            pick = np.sort(shuffled[i:i + BATCH])
            pick = pick[s_at[pick + 1] > s_at[pick]]
            if not len(pick):
                continue
            seg = np.concatenate([np.arange(s_at[d], s_at[d + 1]) for d in pick])
            length = first[seg + 1] - first[seg]
            tok = np.repeat(first[seg] - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
            of = np.repeat(np.arange(len(pick)), s_at[pick + 1] - s_at[pick])
            t = idx[tok]
            w[v] = 0.0
            z = b + np.add.reduceat(w[t], np.concatenate(([0], np.cumsum(length)[:-1])))
            p = _sigmoid(z)
            none = np.bincount(of, np.logaddexp(0, z), len(pick))          # -log of the chance that no sentence offends
            any_p = np.maximum(-np.expm1(-none), 1e-9)
            pull = np.where(y[pick] == 1, -np.exp(-none) / any_p, 1.0)[of] * p
            g = np.bincount(t, np.repeat(pull, length), v + 1) + DECAY * w
            acc += g * g
            w -= RATE * g / np.sqrt(acc)
            gb = pull.sum()
            acc_b += gb * gb
            b -= RATE * gb / np.sqrt(acc_b)
    keep = np.argsort(-np.abs(w[:v]))[:MAX_WEIGHTS]
    keep = keep[np.abs(w[keep]) > 1e-3]
    return vocab[keep], w[keep], float(b)


def _parts(t: pa.Table) -> tuple[pa.Table, pa.Table]:
    """The documents of a shard that weights are fitted on and those kept back, in order of their ids' hash."""
    t = t.sort_by("order")
    held = np.arange(t.num_rows) % HELD == HELD - 1
    return t.filter(pa.array(~held)), t.filter(pa.array(held))


def _scale_task(vocab: np.ndarray, weights: np.ndarray, bias: float):
    """Likelihood of the documents kept back for each scale of the weights and shift of the bias."""
    padded = np.append(weights, 0.0)

    def one(t):
        t = _parts(t)[1]
        y = t.column("label").to_numpy()
        data, off = tx.utf8(t.column("text"))
        found = []
        for a, _, part, at in tx.runs(data, off):
            h, first, doc, _, _ = sentences(part, at)
            if len(first):
                found.append((a + doc, np.add.reduceat(padded[_lookup(h, vocab)], first)))
        doc, z = (np.concatenate([x[k] for x in found]) for k in (0, 1)) if found else (np.zeros(0, int), np.zeros(0))
        out = []
        for k, (scale, shift) in enumerate((a, b) for a in SCALES for b in SHIFTS):
            none = np.bincount(doc, np.logaddexp(0, bias + shift + scale * z), len(y))
            out.append((k, float(np.where(y == 1, np.log(np.maximum(-np.expm1(-none), 1e-9)), -none).sum())))
        return pa.table({"cell": pa.array([k for k, _ in out], pa.int32()), "fit": pa.array([f for _, f in out], pa.float64())})
    return one


def _shard_task(known: np.ndarray, start: np.ndarray, bias: float):
    def one(t):
        t = _parts(t)[0]
        vocab, w, b = fit_shard(t.column("text").combine_chunks(), t.column("label").to_numpy(), known, start, bias)
        word = pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(vocab.view(np.int64))])
        return pa.table({"word": word, "w": pa.array(np.append(b, w))})
    return one


def fit(docs: DataFrame, labels: DataFrame, keep: Column, *, label_col: str = "toxic", id_col: str = "doc_id",
        text_col: str = "text", max_docs: int = MAX_DOCS) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted word hashes, their weights and the bias: each shard fits, the weights are averaged, and once more;
    then documents kept back set the scale of the weights, which averaging shrinks, and the bias.

    Without labels of both kinds there are no weights, and the score is the share of positive labels.
    """
    sample, _, n = training_shards(docs, labels, label_col, keep, id_col=id_col, text_col=text_col, max_docs=max_docs)
    rate = (sample.agg(F.avg("label")).first()[0] or 0.0) if n else 0.0
    none = np.zeros(0, np.uint64), np.zeros(0)
    if rate in (0.0, 1.0):
        return *none, -40.0 if rate == 0 else 40.0
    vocab, weights, bias = *none, float(np.log(rate / 20))
    used = used_shards(sample)
    for _ in range(ROUNDS):
        got = (sample.groupBy("shard").applyInArrow(_shard_task(vocab, weights, bias), "word long, w double")
               .groupBy("word").agg((F.sum("w") / F.lit(float(used))).alias("w")).toArrow())   # at most used * MAX_WEIGHTS rows
        word, w = got.column("word"), got.column("w").to_numpy()
        is_bias = word.is_null().to_numpy()
        bias = float(w[is_bias][0])
        vocab = word.drop_null().to_numpy().view(np.uint64)
        order = np.argsort(vocab)
        vocab, weights = vocab[order], w[~is_bias][order]
    fits = (sample.groupBy("shard").applyInArrow(_scale_task(vocab, weights, bias), "cell int, fit double")
            .groupBy("cell").agg(F.sum("fit").alias("fit")).collect())
    cell = max(fits, key=lambda r: (r.fit, -r.cell)).cell
    return vocab, weights * SCALES[cell // len(SHIFTS)], bias + SHIFTS[cell % len(SHIFTS)]


def scorer(vocab: np.ndarray, weights: np.ndarray, bias: float):
    """Arrow UDF: text to (score, offending sentences as code-point spans with their own scores)."""
    padded = np.append(weights, 0.0)
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def score(texts: pa.Array) -> pa.Array:
        data, off = tx.utf8(texts)
        n = len(off) - 1
        none = np.zeros(n)
        found: list[list] = [[] for _ in range(n)]
        for a, b, part, at in tx.runs(data, off):
            h, first, doc, s, e = sentences(part, at)
            if not len(first):
                continue
            z = bias + np.add.reduceat(padded[_lookup(h, vocab)], first)
            none[a:b] = np.bincount(doc, np.logaddexp(0, z), b - a)
            bad = np.flatnonzero(_sigmoid(z) >= SPAN)
            if len(bad):
                chars = tx.code_points(part)
                for i in bad:
                    begin = chars[at[doc[i]]]
                    found[a + doc[i]].append({"start": int(chars[s[i]] - begin), "end": int(chars[e[i]] - begin),
                                              "score": float(_sigmoid(z[i]))})
        none[none == 0] = np.logaddexp(0, bias)          # a text without words is one empty sentence
        return pa.StructArray.from_arrays([pa.array(-np.expm1(-none)), pa.array(found, spans_type)],
                                          names=["score", "offending"])
    return F.arrow_udf(score, "score double, offending array<struct<start:bigint,end:bigint,score:double>>")


def score_toxicity(docs: DataFrame, labels: DataFrame, keep: Column, *, id_col: str = "doc_id", text_col: str = "text",
                   out_col: str = "toxicity") -> DataFrame:
    """``docs`` with a struct column ``out_col``: score (0 to 1) and offending sentences.

    ``keep`` says which labelled ids (column ``id``) may be learned from. Null and empty texts get the score
    of an empty sentence; a very long text is scored whole; repeated rows and equal texts get equal scores; rows
    without an id are scored like others and never learned from; an empty table stays empty. A column already
    named ``out_col`` is replaced.
    """
    model = fit(docs, labels, keep, id_col=id_col, text_col=text_col)
    return docs.withColumn(out_col, scorer(*model)(F.col(text_col)))
