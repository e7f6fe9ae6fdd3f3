"""Byte-level BPE: ranked merges folded by Spark's higher-order functions over the bytes of distinct words.

``merge_words`` is the fold: a word starts as the array of its bytes (as their ids) with the ranks of neighbours
from a literal rank map; each step joins the leftmost pair of least rank and looks up its new neighbours.
Words come from the corpus: those that occur twice or more are folded once each and their ids broadcast as a
dictionary of bounded size; the rest are folded where they stand, once for each document that holds them.
Splitting texts into words and laying ids out per document is numpy work inside Arrow tasks, done once a text; only the
ids of words folded in place are filled in after, in SQL, so a task needs one Python worker. Texts never move between
tasks. Decoding joins the pieces of the ids in SQL.
"""

from __future__ import annotations

import base64
import functools
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castlens.llm import textops as tx
from castlens.llm.frames import cut, fresh, release, small_batches

BUCKETS = 1 << 16            # of the literal rank map
SPREAD = (40503, 5)          # multipliers that deal pairs of ids to buckets
EDGE = 1 << 16               # an id beyond all ranks
PLACE_AT, RANK_AT = 17, 46   # bits of the fold's state: id, place of the first byte, rank
NO_RANK = (1 << 17) - 1
DICTIONARY_WORDS = 1 << 21   # at most so many words are broadcast ...
DICTIONARY_BYTES = 64        # ... none longer than this: 8 + 4 + 2 * 64 bytes each in the worst case
PART_WORDS = 1 << 18         # of the dictionary come to the driver at a time ...
PIECE_WORDS = 1 << 16        # ... as rows of so many
RUN_SIZE = 1 << 18           # bytes of text, or ids, that arrays are made for at a time; one longer text is its own run
HELD_WORDS = 1 << 18         # counts that a task holds before it adds up those of equal words, and hands them on if most differ

LETTER, DIGIT, BLANK, OTHER = range(4)


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from lines of base64 token and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@functools.cache
def _classes() -> np.ndarray:
    """The class of every code point: letter, digit, blank, other."""
    code = np.arange(0x110000, dtype="<u4")
    chars = code[(code < 0xD800) | (code >= 0xE000)].tobytes().decode("utf-32-le")   # no object a character
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (BLANK, r"\s+")):
        for m in regex.finditer(pattern, chars):
            out[ord(m[0][0]):ord(m[0][-1]) + 1] = kind
    return out


def split(part: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offset of each piece, and the pieces before each text.

    The pieces of 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+: runs of one
    class, the blank before a run part of it if it is U+0020, and the contractions.
    """
    if not len(part):
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    c = np.frombuffer(part.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
    byte = np.flatnonzero((part & 0xC0) != 0x80)
    n = len(c)
    kind = _classes()[c]
    head = np.zeros(n + 1, dtype=bool)                     # first of a text
    head[np.searchsorted(byte, at)] = True
    head[n] = True
    start = head[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    begin = np.flatnonzero(start)
    end = np.append(begin[1:], n)
    blank = kind[begin] == BLANK
    inner = blank & ~head[end]                             # a blank run that another run follows in its text
    last = end[inner] - 1
    start[last] = True
    joined = last[c[last] == 32] + 1
    start[joined] = False
    quote = begin[(c[begin] == 39) & ~blank & (end - begin == 1)]
    quote = quote[start[quote] & (quote + 1 < n)]
    quote = quote[(kind[np.minimum(quote + 1, n - 1)] == LETTER) & ~head[quote + 1]]
    one = c[quote + 1]
    short = np.isin(one, [ord(x) for x in "stmd"])
    two_at = np.minimum(quote + 2, n - 1)
    two = np.where((quote + 2 < n) & ~head[np.minimum(quote + 2, n)], c[two_at], 0)
    long = ~short & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
    for q, size in ((quote[short], 2), (quote[long], 3)):
        start[q + 1] = False
        after = q + size
        after = after[after < n]
        start[after[~head[after]]] = True
    pieces = byte[np.flatnonzero(start)]
    return pieces, np.searchsorted(pieces, at)


def _ends(pieces: np.ndarray, size: int) -> np.ndarray:
    return np.append(pieces[1:], size) if len(pieces) else pieces


class Known:
    """Sorted hashes of words with the ids of each, as arrays that every Python worker can hold: 12 bytes and 2 an id."""

    def __init__(self, hashes: np.ndarray, ids: np.ndarray, before: np.ndarray):
        order = np.argsort(hashes)
        count = np.diff(before)[order]
        starts = np.concatenate(([0], np.cumsum(count)))
        self.hashes, self.before = hashes[order], starts.astype(np.uint32)
        self.ids = (ids[np.repeat(before[:-1][order] - starts[:-1], count) + np.arange(len(ids))] if len(ids) else ids).astype(np.uint16)

    def find(self, h: np.ndarray) -> np.ndarray:
        return find(self.hashes, h)


def find(hashes: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each hash among sorted ones, -1 if it is not there."""
    if not len(hashes):
        return np.full(len(h), -1)
    i = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    return np.where(hashes[i] == h, i, -1)


def known_tokens(ranks: dict[bytes, int]) -> Known:
    words = sorted(ranks)
    off = np.concatenate(([0], np.cumsum([len(w) for w in words])))
    data = np.frombuffer(b"".join(words), np.uint8)
    return Known(tx.hash_spans(data, off[:-1], off[1:]), np.array([ranks[w] for w in words], np.int32), np.arange(len(words) + 1))


def _take_spans(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.Array:
    n = e - s
    before = np.concatenate(([0], np.cumsum(n)))
    got = data[np.repeat(s - before[:-1], n) + np.arange(before[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(s), [None, pa.py_buffer(before.astype(np.int64).tobytes()), pa.py_buffer(got.tobytes())]).cast(pa.string())


def _count(tokens: Known):
    """(word, n) of the words that are no tokens themselves, counted over about HELD_WORDS of them at a time."""
    def added(held):
        h = np.concatenate([x[0] for x in held])
        n = np.concatenate([x[2] for x in held])
        h, first, of = np.unique(h, return_index=True, return_inverse=True)
        return h, pa.concat_arrays([x[1] for x in held]).take(pa.array(first)), np.bincount(of, n).astype(np.int64)

    def out(_, words, n):
        return pa.RecordBatch.from_arrays([words, pa.array(n)], names=["word", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            data, off = tx.utf8(batch.column(0))
            for _, _, part, at in tx.runs(data, off, RUN_SIZE):
                s, _ = split(part, at)
                e = _ends(s, len(part))
                h = tx.hash_spans(part, s, e)
                h, first, n = np.unique(h, return_index=True, return_counts=True)
                new = tokens.find(h) < 0
                if new.any():
                    held.append((h[new], _take_spans(part, s[first[new]], e[first[new]]), n[new]))
                    size += len(held[-1][0])
                if size >= HELD_WORDS:
                    held = [added(held)]
                    size = len(held[0][0])
                    if 2 * size > HELD_WORDS:
                        yield out(*held.pop())
                        size = 0
        if held:
            yield out(*added(held))
    return run


def _packed(batches):
    """(word, ids) -> (hash, packed ids)."""
    for batch in batches:
        data, off = tx.utf8(batch.column(0))
        ids = batch.column(1)
        before = ids.offsets.to_numpy().astype(np.int64)
        values = ids.values.to_numpy(zero_copy_only=False)[before[0]:before[-1]].astype(np.uint16)
        yield pa.RecordBatch.from_arrays([pa.array(tx.hash_spans(data, off[:-1], off[1:]).view(np.int64)), tx.pack(values, before - before[0])],
                                         names=["hash", "ids"])


def _pieces(batches):
    """(hash, packed ids), in order -> (hashes, sizes, ids): the arrays of PIECE_WORDS words or a few more in a row."""
    def out(held):
        return pa.RecordBatch.from_arrays([pa.array([np.concatenate(x).tobytes()], pa.binary()) for x in zip(*held, strict=True)],
                                          names=["hashes", "sizes", "ids"])
    held, n = [], 0
    for batch in batches:
        ids, before = tx.fixed(batch.column(1), np.uint16)
        held.append((batch.column(0).to_numpy(), np.diff(before).astype(np.uint8), ids))
        n += batch.num_rows
        if n >= PIECE_WORDS:
            yield out(held)
            held, n = [], 0
    if n:
        yield out(held)


def _dictionary(folded: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of (hash, ids), in order as unsigned numbers, the ids one after another and the ids before each word.

    Bounded by DICTIONARY_WORDS and DICTIONARY_BYTES. ``n`` words come a part after another, each a job of its own, so
    the driver's JVM never holds more than one of them."""
    order = [F.col("hash") < 0, F.col("hash")]
    ranges = folded.repartitionByRange(n // PART_WORDS + 1, *order).sortWithinPartitions(*order)
    rows = ranges.mapInArrow(_pieces, "hashes binary, sizes binary, ids binary").toLocalIterator()
    held = [(np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.uint16))]
    held += [(np.frombuffer(r.hashes, np.uint64), np.frombuffer(r.sizes, np.uint8), np.frombuffer(r.ids, np.uint16)) for r in rows]
    hashes, sizes, ids = (np.concatenate(x) for x in zip(*held, strict=True))
    return hashes, ids, np.concatenate((np.zeros(1, np.uint32), np.cumsum(sizes, dtype=np.uint32)))


def _lay(part: np.ndarray, at: np.ndarray, hashes: list[np.ndarray], tables: list[tuple[np.ndarray, np.ndarray]]):
    """Of a run of texts: the ids of all pieces with EDGE + k for the k-th stranger of a text, the ids before each text,
    the strangers (distinct unknown pieces of a text, in order of their hashes) before each text, and their spans."""
    s, before = split(part, at)
    e = _ends(s, len(part))
    h = tx.hash_spans(part, s, e)
    pieces = len(s)
    begin, size = np.zeros(pieces, np.int64), np.zeros(pieces, np.int64)
    base = 0
    for t, (t_ids, t_before) in zip(hashes, tables, strict=True):
        left = np.flatnonzero(size == 0)
        f = find(t, h[left])
        left, f = left[f >= 0], f[f >= 0]
        begin[left] = base + t_before[f].astype(np.int64)
        size[left] = t_before[f + 1].astype(np.int64) - t_before[f]
        base += len(t_ids)
    lost = np.flatnonzero(size == 0)
    doc = np.searchsorted(before, lost, side="right") - 1
    order = np.lexsort((h[lost], doc))
    lost, doc = lost[order], doc[order]
    new = np.ones(len(lost), dtype=bool)
    new[1:] = (h[lost][1:] != h[lost][:-1]) | (doc[1:] != doc[:-1])
    strangers = np.concatenate(([0], np.cumsum(np.bincount(doc[new], minlength=len(at) - 1))))
    begin[lost], size[lost] = base, 1
    ends = np.cumsum(size)
    where = np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if pieces else 0)
    ids = np.empty(len(where), np.int32)
    low = 0
    for t_ids, _ in tables:
        mine = (where >= low) & (where < low + len(t_ids))
        ids[mine] = t_ids[where[mine] - low]
        low += len(t_ids)
    ids[ends[lost] - 1] = EDGE + np.cumsum(new) - 1 - strangers[doc]
    return ids, np.concatenate(([0], ends))[before], strangers, s[lost[new]], e[lost[new]]


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())


def _known(hashes, tables):
    """Arrow UDF: the strangers of each text, and its ids as ``_lay`` gives them, in parts: that of a stranger is one by itself."""
    def run(texts: pa.Array) -> pa.Array:
        data, off = tx.utf8(texts)
        words, ids, sizes = [pa.array([], pa.string())], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        n_words, n_parts = np.zeros(len(off) - 1, dtype=np.int64), np.zeros(len(off) - 1, dtype=np.int64)
        for i, j, part, at in tx.runs(data, off, RUN_SIZE):
            got, before, strangers, s, e = _lay(part, at, hashes.value, tables.value)
            marks = np.flatnonzero(got >= EDGE)
            first = np.zeros(len(got) + 1, dtype=bool)
            first[before] = first[marks] = first[marks + 1] = True
            first = np.flatnonzero(first[:-1])
            words.append(_take_spans(part, s, e))
            ids.append(got)
            sizes.append(np.diff(first, append=len(got)))
            n_words[i:j], n_parts[i:j] = np.diff(strangers), np.diff(np.searchsorted(first, before))
        parts = pa.ListArray.from_arrays(_offsets(np.concatenate(sizes)), pa.array(np.concatenate(ids), pa.int32()))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(_offsets(n_words), pa.concat_arrays(words)),
                                           pa.ListArray.from_arrays(_offsets(n_parts), parts)], names=["words", "parts"])
    return F.arrow_udf(run, "struct<words:array<string>,parts:array<array<int>>>").asNondeterministic()   # evaluated once, where it stands


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The ranks as a literal: for each pair of tokens that joins to a token, the joined one's rank (as its complement,
    which no pair equals) and then (left << 16 | right), in buckets so that a look-up compares a few numbers."""
    if max(ranks.values()) >= EDGE:
        raise ValueError("ranks must be below 65536")
    buckets: list[list[int]] = [[] for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                buckets[(left * SPREAD[0] + right * SPREAD[1]) % BUCKETS] += [~rank, left << 16 | right]
    return F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<array<bigint>>")


def _let(value: Column, body) -> Column:
    """``body(value)``, with the value worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def merge_words(word: Column, ranks: dict[bytes, int]) -> Column:
    """The ids of a word (one piece of the split), by folding ranked merges over the ids of its bytes. Null gives null.

    The fold's state is a number a token: the rank of joining it to the next one, its first byte's place and its id.
    The least number is the leftmost pair of least rank; a merge looks up the ranks of its two new neighbours only.
    The literal map stands in the expression once: every copy would be sent to, and read by, each task.
    """
    bytes_ = F.lit([ranks[bytes([b])] for b in range(256)])
    edge = F.lit(NO_RANK << RANK_AT | EDGE).cast("bigint")      # before the first and after the last token: joins nothing

    def fold(table: Column) -> Column:
        def rank(left: Column, right: Column) -> Column:
            bucket = F.get(table, (left * SPREAD[0] + right * SPREAD[1]).bitwiseAND(BUCKETS - 1).cast("int"))
            found = F.get(bucket, (F.array_position(bucket, F.shiftleft(left, 16).bitwiseOR(right)) - 2).cast("int"))
            return F.coalesce(F.bitwise_not(found), F.lit(NO_RANK).cast("bigint"))

        def token(link: Column) -> Column:
            return link.bitwiseAND((1 << PLACE_AT) - 1)

        def begin(ids: Column) -> Column:
            links = F.transform(ids, lambda x, i: F.shiftleft(rank(x, F.get(ids, i + 1)), RANK_AT).bitwiseOR(
                F.shiftleft(i.cast("bigint"), PLACE_AT)).bitwiseOR(x))
            return F.concat(F.array(edge), links, F.array(edge))

        def step(links: Column, _: Column) -> Column:
            def join(low: Column) -> Column:
                joined = F.shiftright(low, RANK_AT)
                place = low.bitwiseAND((1 << RANK_AT) - (1 << PLACE_AT))

                def at(i: Column) -> Column:                    # of the left one, from 1
                    left = F.shiftleft(rank(joined, token(F.get(links, i + 1))), RANK_AT).bitwiseOR(place).bitwiseOR(joined)

                    def renew(x: Column, j: Column) -> Column:
                        before = F.shiftleft(rank(token(x), joined), RANK_AT).bitwiseOR(x.bitwiseAND((1 << RANK_AT) - 1))
                        return F.when(j == i - 1, left).when(j == i - 2, before).otherwise(x)
                    return F.array_remove(F.transform(links, renew), F.get(links, i))
                return F.when(joined == NO_RANK, links).otherwise(_let(F.array_position(links, low).cast("int"), at))
            return _let(F.array_min(links), join)

        latin = F.decode(word.cast("binary"), "ISO-8859-1")       # a character a byte
        first = F.transform(F.split(latin, ""), lambda c: F.get(bytes_, F.ascii(c)).cast("bigint"))
        steps = F.sequence(F.lit(1), F.greatest(F.octet_length(word) - 1, F.lit(1)))
        return F.aggregate(steps, _let(first, begin), step,
                           lambda links: F.transform(F.slice(links, F.lit(2), F.size(links) - 2), lambda x: token(x).cast("int")))
    return _let(rank_map(ranks), fold)


def _filled(laid: Column, ranks: dict[bytes, int]) -> Column:
    """The ids of a text from what ``_known`` gives: its strangers are folded once each and stand in for their parts."""
    def fill(own: Column) -> Column:
        return F.transform(laid["parts"], lambda x: F.when(F.get(x, 0) >= EDGE, F.get(own, F.get(x, 0) - EDGE)).otherwise(x))
    return F.flatten(_let(F.transform(laid["words"], lambda w: merge_words(w, ranks)), fill))


def encode(docs: DataFrame, ranks: dict[bytes, int], *, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with an array column of token ids of each text (null and empty texts: an empty array).

    Ids are those of byte-level BPE by ``ranks`` (which must hold every single byte) on each piece of the split,
    without special tokens. Words are told apart by 64-bit hashes. A column named ``out_col`` is replaced. Rows that come
    twice are encoded twice, an empty table gives an empty one, a rank above 65,535 is a ValueError.
    """
    sc = docs.sparkSession.sparkContext
    small_batches(docs.sparkSession)
    release(docs.sparkSession)
    tokens = known_tokens(ranks)
    words = (docs.select(F.col(text_col)).mapInArrow(_count(tokens), "word string, n long")
             .groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") > 1) & (F.octet_length("word") <= DICTIONARY_BYTES)))
    words = cut(words, "words")
    held = words.groupBy(F.floor(F.log2("n")).alias("p")).count().orderBy(F.desc("p")).collect()     # at most 64 rows
    least, total = 2, 0
    for r in held:
        total += r["count"]
        if total > DICTIONARY_WORDS:
            least = 2 << int(r.p)
            break
    folded = words.where(F.col("n") >= least).select("word", merge_words(F.col("word"), ranks).alias("ids"))
    folded = cut(folded.mapInArrow(_packed, "hash long, ids binary"), "folded")
    release(docs.sparkSession)
    own, ids, before = _dictionary(folded, min(total, DICTIONARY_WORDS))
    hashes = sc.broadcast([tokens.hashes, own])
    tables = sc.broadcast([(tokens.ids, tokens.before), (ids, before)])
    del own, ids, before
    release(docs.sparkSession)
    laid = fresh(docs, "laid")
    out = docs.withColumn(laid, _known(hashes, tables)(F.col(text_col)))
    return out.withColumn(out_col, _filled(F.col(laid), ranks)).drop(laid)


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of an array of token ids: their binary pieces one after another; of an empty array none, of null null."""
    pieces = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    table = F.split(F.lit(" ".join(pieces)), " ")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), ""))
