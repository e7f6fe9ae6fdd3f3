"""Byte-level BPE against tiktoken; source mixing against a plain Python version."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from castlens.llm import bpe
from castlens.llm.mixing import mix_sources, plan
from tests.llm.helpers import SCHEMA, awkward, empty, rows, words


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_split_is_the_pattern():
    pattern = regex.compile(public_tokenizers.PATTERN)
    pick = random.Random(3)
    for _ in range(5000):
        texts = ["".join(pick.choice("abst'' rvelmd  \n\t1٣.,é中 　 !") for _ in range(pick.randint(0, 12))) for _ in range(3)]
        raw = [t.encode() for t in texts]
        part, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        s, before = bpe.split(part, at)
        e = np.append(s[1:], len(part))
        assert [[bytes(part[s[i]:e[i]]).decode() for i in range(before[k], before[k + 1])] for k in range(3)] == [pattern.findall(t) for t in texts]


def test_every_character_is_classed_as_the_library_does(ranks):
    """Each code point between letters, digits and blanks gives the library's tokens."""
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    table = bpe._classes()
    pick = random.Random(9)
    for c in pick.sample([x for x in range(0x110000) if not 0xD800 <= x < 0xE000], 4000):
        pieces = lib.decode_tokens_bytes(lib.encode_ordinary(f"a{chr(c)}a"))
        if table[c] != bpe.LETTER:      # a piece ends where the class changes
            assert pieces[0] == b"a", hex(c)


def test_encode_and_decode(spark, ranks, monkeypatch):
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    more = ["<|endoftext|>", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 8, "zq" * 200, "I'll we've 'tis\n\n  x", "\U0001f600 نص 中文字", "a\x00b",
            "rareword" + "xyzzy" * 3, "common commonish commonish"]
    docs = awkward(spark).unionByName(spark.createDataFrame(rows(more), SCHEMA))
    for limit in (bpe.DICTIONARY_WORDS, 0):                 # all repeated words in the dictionary, or none
        monkeypatch.setattr(bpe, "DICTIONARY_WORDS", limit)
        got = bpe.encode(docs, ranks)
        assert got.columns == [*docs.columns, "ids"]
        for r in got.select("text", "ids", bpe.decode(F.col("ids"), ranks).alias("back")).collect():
            assert r.ids == lib.encode_ordinary(r.text or "") and bytes(r.back) == (r.text or "").encode()
    assert bpe.encode(empty(spark), ranks).collect() == []


def plain_plan(data, entropy, limit, budget, whole):
    """Sorted (id, source, n_tokens, pass) of (id, source, text) rows."""
    tokens = defaultdict(int)
    for _, s, t in data:
        tokens[s] += len(words(t))
    total, some = sum(tokens.values()), {s: n for s, n in tokens.items() if n}
    share = {s: n / total for s, n in some.items()}
    budget = total if budget == "tokens" else budget

    def least(holds):
        lo, hi = 0.0, 1.0
        if holds(0.0):
            return 0.0
        if not holds(1.0):
            return 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if holds(mid) else (mid, hi)
        return hi

    def weights(x):
        z = sum(v**x for v in share.values())
        return {s: v**x / z for s, v in share.items()}
    x = 0.0
    if entropy is not None:
        x = least(lambda x: -sum(w * math.log(w) for w in weights(x).values()) <= entropy * math.log(len(share)) + 1e-12)
    if budget is None:
        small, large = min(share.values()), max(share.values())
        x = round(max(x, least(lambda x: (small / large) ** (x - 1) <= limit + 1e-12)), 9)
        spend = max(some[s] / w for s, w in weights(x).items())
    else:
        x = round(max(x, least(lambda x: max(w * budget / some[s] for s, w in weights(x).items()) <= limit + 1e-12)), 9)
        spend = budget
    out = []
    for s in tokens:
        mine = [(i, t) for i, src, t in data if src == s]
        goal = math.floor(round(weights(x)[s] * spend, 3)) if s in some else 0
        read, number = 0, 0
        while number == 0 or (s in some and read < goal):
            key = lambda r: hashlib.md5("|".join(["mix-1", str(number), "" if r[0] is None else str(r[0]),  # noqa: B023, E731
                                                  hashlib.md5((r[1] or "").encode()).hexdigest()]).encode()).hexdigest()
            for i, t in sorted(mine, key=key):
                if read < goal or (whole and number == 0):
                    out.append((i, s, len(words(t)), number))
                read += len(words(t))
            number += 1
    return sorted(map(repr, out))


def sources(spark):
    pick = random.Random(8)
    data = [(i, " ".join("w" for _ in range(pick.randint(1, 40))), "en", pick.choice(["big"] * 20 + ["a", "b", "b", None]), 0) for i in range(400)]
    data += [(900, None, "en", "nothing", 0), (901, "", "en", "nothing", 0), (5, data[5][1], "en", data[5][3], 0)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize(("entropy", "limit", "budget", "whole"), [
    (0.9, 4.0, "tokens", False), (None, 1.5, "tokens", False), (0.99, 3.0, 2000, False), (None, 2.5, None, True), (0.0, 2.0, None, True)])
def test_plan(spark, entropy, limit, budget, whole):
    docs = sources(spark)
    got = plan(docs, entropy=entropy, max_repeats=limit, budget=budget, whole=whole, block_tokens=500).collect()
    assert sorted(repr((r.id, r.source, r.n_tokens, r["pass"])) for r in got) == \
        plain_plan([(r.doc_id, r.source, r.text) for r in docs.collect()], entropy, limit, budget, whole)
    if budget == "tokens":       # blocks hold the weights: a source's share is the same in each full one
        share = defaultdict(Counter)
        for r in got:
            share[r.block][r.source] += r.n_tokens
        full = [b for b in share if b < max(share) - 1]
        for b in full:
            assert abs(share[b]["big"] / sum(share[b].values()) - share[full[0]]["big"] / sum(share[full[0]].values())) < 0.15


def test_mix_rows(spark):
    docs = sources(spark)
    got = mix_sources(docs, max_repeats=2.5)
    assert got.columns == docs.columns
    exp = Counter(x.rsplit(",", 2)[0] for x in plain_plan([(r.doc_id, r.source, r.text) for r in docs.collect()], None, 2.5, None, True))
    have = Counter(repr((r.doc_id, r.source)).rsplit(")", 1)[0] for r in got.collect())
    assert set(have) == set(exp) and abs(sum(have.values()) - sum(exp.values())) <= 1
    odd = awkward(spark)
    assert mix_sources(odd).columns == odd.columns and mix_sources(odd).count() >= odd.count()
    assert mix_sources(empty(spark)).collect() == []
