"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal updates.

Features are word unigrams and bigrams, n-grams of word shapes (letters, capitals, digits and marks with
runs shortened), and whether a word repeats the one before. A text's vector is its feature counts over
their number, so the score is a sparse dot product that reads each word once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castlens.llm import textops as tx
from castlens.llm.labelled import MAX_DOCS, training_shards, used_shards

BITS = 18                                   # 2^18 hashed features
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.1
EPOCHS = 3
SCALE = 16.0                                # a text's vector sums to it

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48


def features(part: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, kinds) of hashed features and the number of words before each text."""
    ws, we, first = tx.words(part, at)
    low = tx.hash_spans(tx.LOWER[part], ws, we)
    shape = _SHAPE[part]
    keep = np.ones(len(part), dtype=bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[ws] = True
    moved = np.concatenate(([0], np.cumsum(keep)))
    form = tx.hash_spans(shape[keep], moved[ws], moved[we])
    n = len(ws)
    doc = np.searchsorted(at, ws, side="right") - 1
    one = np.zeros(n, dtype=bool)
    one[1:] = doc[1:] == doc[:-1]            # has a word before it
    two = np.zeros(n, dtype=bool)
    two[2:] = doc[2:] == doc[:-2]

    def before(h, k, there):
        return np.where(there, np.roll(h, k), np.uint64(0))
    low1, form1, form2 = before(low, 1, one), before(form, 1, one), before(form, 2, two)
    out = np.stack([tx.mix(low, 1), tx.mix(tx.mix(low1, 3) + low, 2), tx.mix(form, 5), tx.mix(tx.mix(form1, 5) + form, 6),
                    tx.mix(tx.mix(tx.mix(form2, 5) + form1, 6) + form, 7), tx.mix((low == low1).astype(np.uint64), 8)], axis=1)
    return (out >> np.uint64(64 - BITS)).astype(np.int64), first


def fit_shard(texts: pa.Array, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias after EPOCHS passes of FTRL-proximal over one shard, document by document."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = bias = 0.0
    data, off = tx.utf8(texts)
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b, part, at in tx.runs(data, off):
        f, first = features(part, at)
        for i in range(b - a):
            idx, count = np.unique(f[first[i]:first[i + 1]], return_counts=True)
            rows.append((idx, count * (SCALE / max(1, count.sum()))))

    def weight(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    for epoch in range(EPOCHS):
        for i in np.argsort(tx.mix(np.arange(len(y), dtype=np.uint64), 31 + epoch)):
            idx, x = rows[i]
            w = weight(z[idx], n[idx])
            d = 1.0 / (1.0 + np.exp(-np.clip(w @ x + bias, -40, 40))) - y[i]
            g = d * x
            z[idx] += g - (np.sqrt(n[idx] + g * g) - np.sqrt(n[idx])) / ALPHA * w
            n[idx] += g * g
            zb += d - (np.sqrt(nb + d * d) - np.sqrt(nb)) / ALPHA * bias
            nb += d * d
            bias = -zb / ((BETA + np.sqrt(nb)) / ALPHA)
    return weight(z, n), float(bias)


def _task(t):
    t = t.sort_by("order")                   # the same weights on every run
    w, b = fit_shard(t.column("text").combine_chunks(), t.column("label").to_numpy())
    some = np.flatnonzero(w)
    return pa.table({"slot": pa.array([-1, *some.tolist()], pa.int32()), "w": pa.array([b, *w[some].tolist()], pa.float64())})


def fit(docs: DataFrame, labels: DataFrame, keep: Column, *, label_col: str = "quality", id_col: str = "doc_id",
        text_col: str = "text", max_docs: int = MAX_DOCS) -> tuple[np.ndarray, float]:
    """Weights of the hashed features and the bias, averaged over shards of a bounded sample.

    Without labels there is nothing to learn: the weights are 0 and every score is 0.5.
    """
    sample, _, n = training_shards(docs, labels, label_col, keep, id_col=id_col, text_col=text_col, max_docs=max_docs)
    used = used_shards(sample) if n else 0
    weights, bias = np.zeros(1 << BITS), 0.0
    if used:
        got = sample.groupBy("shard").applyInArrow(_task, "slot int, w double")
        t = got.groupBy("slot").agg((F.sum("w") / F.lit(float(used))).alias("w")).toArrow()      # at most 2^BITS + 1 rows
        slot, w = t.column("slot").to_numpy(), t.column("w").to_numpy()
        weights[slot[slot >= 0]] = w[slot >= 0]
        bias = float(w[slot < 0][0])
    return weights, bias


def scorer(weights: np.ndarray, bias: float):
    """Arrow UDF: text to the probability of label 1."""
    def score(texts: pa.Array) -> pa.Array:
        data, off = tx.utf8(texts)
        out = np.full(len(off) - 1, bias)
        for a, b, part, at in tx.runs(data, off):
            f, first = features(part, at)
            count = np.diff(first)
            some = np.flatnonzero(count)
            if len(some):
                total = np.add.reduceat(weights[f].sum(1), first[:-1][some])
                out[a + some] += total * SCALE / (count[some] * f.shape[1])
        return pa.array(1.0 / (1.0 + np.exp(-np.clip(out, -40, 40))))
    return F.arrow_udf(score, "double")


def score_quality(docs: DataFrame, labels: DataFrame, keep: Column, *, id_col: str = "doc_id", text_col: str = "text",
                  out_col: str = "quality") -> DataFrame:
    """``docs`` with ``out_col``, the probability (0 to 1) that a text has label 1.

    ``keep`` says which labelled ids (column ``id``) may be learned from. Null, empty and blank texts get the
    score of the bias alone; a very long text is scored whole; repeated rows and equal texts get equal scores;
    rows without an id are scored like others and never learned from; an empty table stays empty. A column
    already named ``out_col`` is replaced.
    """
    return docs.withColumn(out_col, scorer(*fit(docs, labels, keep, id_col=id_col, text_col=text_col))(F.col(text_col)))
