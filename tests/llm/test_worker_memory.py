"""What one Python worker holds at a time: the training of a shard, and the comparison of many likely pairs."""

import tracemalloc

import numpy as np
import pyarrow as pa

from castlens.llm import ngramjoin, toxicity


def _peak(run):
    tracemalloc.start()
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_shard_is_fitted_without_the_hashes_of_all_its_words():
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}ord{i % 7}" for i in range(4000)])
    texts = pa.array([" ".join(words[rng.integers(0, 4000, 900)]) + ("" if i % 4 else " vile.") for i in range(800)])
    y = (np.arange(800) % 4 == 0).astype(np.int32)
    known = np.zeros(0, np.uint64)
    (vocab, weights, _), peak = _peak(lambda: toxicity.fit_shard(texts, y, known, np.zeros(0), -2.0))
    features = 800 * 900 * (1 + len(toxicity.PREFIXES))
    assert len(vocab) and weights.max() > 0
    assert peak < 16 * features                           # the hashes alone take 8 bytes each, the indexes 4


def test_frequencies_count_texts_over_several_tallies(monkeypatch):
    monkeypatch.setattr(toxicity, "TALLY", 3)
    monkeypatch.setattr(toxicity.tx, "runs", lambda data, off, f=toxicity.tx.runs: f(data, off, 12))
    texts = pa.array(["one two", "six", "", "two one one", None, "three two"])
    vocab, df, total, sentences = toxicity._frequencies(*toxicity.tx.utf8(texts))
    held = [np.unique(toxicity.sentences(*toxicity.tx.utf8(pa.array([t])))[0]) for t in ("one two", "six", "two one one", "three two")]
    want, count = np.unique(np.concatenate(held), return_counts=True)
    assert vocab.tolist() == want.tolist() and df.tolist() == count.tolist()
    assert (total, sentences) == (8 * (1 + len(toxicity.PREFIXES)), 4)


def test_likely_pairs_are_compared_some_at_a_time():
    n = 400
    sig = np.tile(np.arange(ngramjoin.HASHES, dtype=np.uint32), (n, 1))
    sig[1::2, :ngramjoin.ROWS] += 1000                    # odd and even rows first agree on band 1, others on band 0
    x, y = np.triu_indices(n, 1)
    for band in (0, 1, 2):
        (i, j), peak = _peak(lambda b=band: ngramjoin._likely(sig, np.full(n, b), x, y, ngramjoin.least_matches(0.8, 1e-6)))
        first = np.where((x + y) % 2 == 0, 0, 1)
        assert list(zip(i, j, strict=True)) == list(zip(x[first == band], y[first == band], strict=True))
        assert peak < 60 << 20                            # whole signatures of all pairs: 2 * 512 bytes a pair, 78 MB
