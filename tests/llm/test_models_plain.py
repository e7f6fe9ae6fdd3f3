"""The three trained models against plain Python versions of their training and scoring, number by number."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from castlens.llm import language, quality, toxicity
from castlens.llm import textops as tx
from castlens.llm.labelled import training_shards
from tests.llm.helpers import words

M64 = (1 << 64) - 1


def mix(h, seed=0):
    return int(tx.mix(np.array([h], np.uint64), seed)[0])


def hashed(piece: bytes):
    return int(tx.hash_spans(np.frombuffer(piece, np.uint8), np.array([0]), np.array([len(piece)]))[0])


def lower(b: bytes):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in b)


def order(n, seed):
    return sorted(range(n), key=lambda i: mix(i, seed))


def sigmoid(z):
    return 1.0 / (1.0 + math.exp(-min(40.0, max(-40.0, z))))


TEXTS = ["Buy NOW!!! cheap cheap cheap pills 100 200", "The river rose slowly and the village slept.", "x1 x2 x3 $$ $$ BUY buy",
         "A quiet morning; the mill turned, and Anna read.", "win win win 999", "They walked home along the étroite path at dusk.", "ça va, ça va", "one"]
LABELS = [0, 1, 0, 1, 0, 1, 1, 0]


def shape(b: bytes):
    kinds = ["a" if 97 <= c <= 122 or c >= 128 else "A" if 65 <= c <= 90 else "0" if 48 <= c <= 57 else chr(c) for c in b]
    return "".join(k for i, k in enumerate(kinds) if i == 0 or k != kinds[i - 1]).encode()


def quality_vector(text):
    """Slot -> value: six features a word, counts over their number times SCALE."""
    ws = [w.encode() for w in words(text)]
    low, form = [hashed(lower(w)) for w in ws], [hashed(shape(w)) for w in ws]
    count = {}
    for i in range(len(ws)):
        l1, f1, f2 = (low[i - 1], form[i - 1], 0) if i else (0, 0, 0)
        if i > 1:
            f2 = form[i - 2]
        two = mix((mix(f1, 5) + form[i]) & M64, 6)
        three = mix((mix((mix(f2, 5) + f1) & M64, 6) + form[i]) & M64, 7)
        for h in (mix(low[i], 1), mix((mix(l1, 3) + low[i]) & M64, 2), mix(form[i], 5), two, three, mix(int(low[i] == l1), 8)):
            slot = h >> (64 - quality.BITS)
            count[slot] = count.get(slot, 0) + 1
    total = sum(count.values())
    return {s: c * quality.SCALE / max(1, total) for s, c in count.items()}


def plain_ftrl(texts, y):
    z, n, zb, nb, bias = {}, {}, 0.0, 0.0, 0.0

    def weight(slot):
        v = z.get(slot, 0.0)
        if abs(v) <= quality.L1:
            return 0.0
        return -(v - math.copysign(quality.L1, v)) / ((quality.BETA + math.sqrt(n[slot])) / quality.ALPHA + quality.L2)
    rows = [quality_vector(t) for t in texts]
    for epoch in range(quality.EPOCHS):
        for i in order(len(y), 31 + epoch):
            w = {s: weight(s) for s in rows[i]}
            d = sigmoid(sum(w[s] * x for s, x in rows[i].items()) + bias) - y[i]
            for s, x in rows[i].items():
                g, was = d * x, n.get(s, 0.0)
                z[s] = z.get(s, 0.0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) / quality.ALPHA * w[s]
                n[s] = was + g * g
            zb += d - (math.sqrt(nb + d * d) - math.sqrt(nb)) / quality.ALPHA * bias
            nb += d * d
            bias = -zb / ((quality.BETA + math.sqrt(nb)) / quality.ALPHA)
    return {s: weight(s) for s in z}, bias


def test_quality_is_ftrl(spark):
    weights, bias = quality.fit_shard(pa.array(TEXTS), np.array(LABELS))
    plain, plain_bias = plain_ftrl(TEXTS, LABELS)
    assert bias == pytest.approx(plain_bias, abs=1e-12)
    assert {int(s) for s in np.flatnonzero(weights)} == {s for s, w in plain.items() if w}
    for s, w in plain.items():
        assert weights[s] == pytest.approx(w, abs=1e-9)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, "", None])], "doc_id long, text string")
    got = {r.doc_id: r.q for r in docs.withColumn("q", quality.scorer(weights, bias)("text")).collect()}
    for i, t in enumerate([*TEXTS, "", None]):
        assert got[i] == pytest.approx(sigmoid(sum(plain.get(s, 0.0) * x for s, x in quality_vector(t).items()) + plain_bias), abs=1e-9)


def toxic_sentences(text):
    """Features of each sentence that has a word: words and their prefixes, 0 where there is none."""
    b, out, before = (text or "").encode(), [], None
    for part in re.split(rb"[\n!.?]", b):
        feats = []
        for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", part):
            w = lower(w)
            mine = [hashed(w)] + [mix(hashed(w[:k]), k) if len(w) > k else 0 for k in toxicity.PREFIXES]
            feats += [0] * len(mine) if w == before else mine
            before = w
        if feats:
            out.append(feats)
    return out


def noisy_or(text, weights, bias):
    zs = [bias + sum(weights.get(f, 0.0) for f in s) for s in toxic_sentences(text)] or [bias]
    return 1.0 - math.prod(1.0 - 1.0 / (1.0 + math.exp(-z)) for z in zs)


def plain_noisy_or_fit(texts, y, bias):
    docs = [toxic_sentences(t) for t in texts]
    df = {}
    for d in docs:
        for f in {f for s in d for f in s}:
            df[f] = df.get(f, 0) + 1
    most = max(toxicity.MAX_DF * len(y), 2 * sum(y))
    w = {f: 0.0 for f, c in df.items() if f and toxicity.MIN_DF <= c <= most}
    acc, b, acc_b = {f: toxicity.CALM for f in w}, bias, 1.0
    for epoch in range(toxicity.EPOCHS):
        shuffled = order(len(y), 77 + epoch)
        for i in range(0, len(y), toxicity.BATCH):
            g, gb = {f: toxicity.DECAY * v for f, v in w.items()}, 0.0
            for d in sorted(shuffled[i:i + toxicity.BATCH]):
                ps = [sigmoid(b + sum(w.get(f, 0.0) for f in s)) for s in docs[d]]
                clean = math.prod(1.0 - p for p in ps)
                for p, s in zip(ps, docs[d], strict=True):
                    pull = p * (-clean / max(1.0 - clean, 1e-9) if y[d] else 1.0)      # of the loss by the sentence's sum
                    gb += pull
                    for f in s:
                        if f in w:
                            g[f] += pull
            for f in w:
                acc[f] += g[f] ** 2
                w[f] -= toxicity.RATE * g[f] / math.sqrt(acc[f])
            acc_b += gb * gb
            b -= toxicity.RATE * gb / math.sqrt(acc_b)
    return w, b


def test_toxicity_is_noisy_or(spark):
    clean = ["The day is fine. We walk home now.", "Rain again today? Bring a coat!", "All is well. The mill turned. The mill turned"]
    bad = ["You are a vilewordish thing! We walk home now.", "What vilewords. Rain again today"]
    texts = [bad[i % 2] if i % 4 == 0 else clean[i % 3] for i in range(90)] + ["", "Été été. VILEWORDS!"]
    y = [int("vileword" in t.lower()) for t in texts]
    none = np.zeros(0, np.uint64), np.zeros(0)
    vocab, weights, bias = toxicity.fit_shard(pa.array(texts), np.array(y), *none, -1.0)
    plain, plain_bias = plain_noisy_or_fit(texts, y, -1.0)
    got = dict(zip(vocab.tolist(), weights.tolist(), strict=True))
    assert bias == pytest.approx(plain_bias, abs=1e-7)
    for f in set(plain) | set(got):
        assert got.get(f, 0.0) == pytest.approx(plain.get(f, 0.0), abs=1.1e-3 if f not in got else 1e-7)
    by_hash = np.argsort(vocab)
    scorer = toxicity.scorer(vocab[by_hash], weights[by_hash], bias)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string")
    scores = {r.doc_id: r.s for r in rows.select("doc_id", scorer("text").getField("score").alias("s")).collect()}
    for i, t in enumerate([*texts, None]):
        assert scores[i] == pytest.approx(noisy_or(t, got, bias), abs=1e-9)


def plain_mixture(rows):
    """EM over one document's words (their log-likelihoods in k languages), then removals by the penalty."""
    k, n = len(rows[0]), len(rows)
    like = [[max(math.exp(x - max(r)), 1e-30) for x in r] for r in rows]

    def em(share, steps):
        for _ in range(steps):
            new = [0.0] * k
            for r in like:
                total = sum(s * x for s, x in zip(share, r, strict=True))
                for j in range(k):
                    new[j] += share[j] * r[j] / total
            share = [x / n for x in new]
        return share

    def fitness(share):
        return sum(math.log(max(sum(s * x for s, x in zip(share, r, strict=True)), 1e-300)) for r in like)
    share = em([1.0 / k] * k, language.ROUNDS)
    best = fitness(share)
    while sum(s > 0 for s in share) > 1:
        least = min((s, j) for j, s in enumerate(share) if s > 0)[1]
        rest = [0.0 if j == least else s for j, s in enumerate(share)]
        if sum(rest) <= 1e-12:
            break
        rest = em([s / sum(rest) for s in rest], language.AGAIN)
        if best - fitness(rest) >= 0.5 * math.log(n) + language.MARGIN:
            break
        share, best = rest, fitness(rest)
    return share


def test_language_is_em_with_removal():
    rng = np.random.default_rng(5)
    sizes = [1, 2, 0, 7, 30, 120, 0, 400]
    docs = []
    for i, n in enumerate(sizes):                                  # mixtures of one to three of five languages
        x = rng.normal(-18, 1.5, (n, 5))
        for j in range(n):
            x[j, [i % 5, (i + 2) % 5, (i + 3) % 5][j % (1 + i % 3)]] += 6
        docs.append(x)
    got = language.mixtures(np.concatenate(docs), np.concatenate(([0], np.cumsum(sizes))))
    assert {int((row > 0).sum()) for row in got} >= {0, 1, 2}
    for row, x in zip(got, docs, strict=True):
        want = plain_mixture(x.tolist()) if len(x) else [0.0] * 5
        assert row.tolist() == pytest.approx(want, abs=1e-9)


def test_trigram_table_is_plain_counts(spark):
    rows = [("The cat", "xx"), ("der Hund und", "yy"), ("the dog", "xx"), (None, "xx"), ("zz", None)]
    langs, table = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert langs == ["xx", "yy"]
    for lang, got in zip(langs, table, strict=True):
        count = [language.SMOOTH] * (1 << language.BITS)
        for text, of in rows:
            for w in words(text) if of == lang else []:
                b = b"\0" + lower(w.encode()) + b"\0"
                for i in range(1, len(b) - 1):
                    slot = ((b[i - 1] << 16 | b[i] << 8 | b[i + 1]) * 2654435761 & 0xFFFFFFFF) >> (32 - language.BITS)
                    count[slot] += 1
        assert np.allclose(got, np.log(np.array(count) / sum(count)), atol=1e-5)


def test_sample_is_taken_among_documents(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)] + [(5, "another text"), (6, None), (7, "z" * 300_000)],
                                 "doc_id long, text string")
    many = spark.range(1000, 60_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("quality"))
    labels = many.unionByName(spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int"))
    sample, shards, n = training_shards(docs, labels, "quality", F.lit(True), max_docs=40)
    rows = sample.collect()
    assert (n, shards, len(rows)) == (40, 1, 40)                   # one text for an id, none of the labels without one
    assert {r.text for r in rows} == {f"text {i}" for i in range(40)} - {"text 5"} | {"another text"}
    good = quality.score_quality(docs, labels.withColumn("quality", F.col("quality") * 0 + 1), F.lit(True))
    assert all(r.quality > 0.9 for r in good.where("text is not null").collect())
