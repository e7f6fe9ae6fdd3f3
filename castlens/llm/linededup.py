"""Line dedup: two Bloom filters single out suspected repeats; only those are shuffled and confirmed exactly.

Pass 1: every task puts the hashes of its lines into a first filter (seen once) and, when a line of
another document was there already, into a second (seen twice). Filters of tasks are merged segment by
segment: ``twice = twice_a | twice_b | (once_a & once_b)``, so a line of two documents is always in it.
Pass 2: lines found in the second filter leave their task as (128-bit key hash, document) and are counted
exactly; a wrong suspicion costs a shuffled row and nothing else. The text itself moves once, to meet the
list of its document's dropped lines.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castlens.llm import textops as tx
from castlens.llm.frames import cut, fresh, parts, small_batches

SEGMENT = 1 << 20            # bits of a filter that are merged together
LINES_PER_DOC = 16           # for sizing only
BITS_PER_LINE = 8
RUN_SIZE = 1 << 18           # bytes of text that arrays are made for at a time; one longer text is its own run
MIN_BITS, MAX_BITS = 1 << 20, 1 << 30   # 128 KB to 128 MB; a filter at its bound only suspects more lines


def filter_bits(n_docs: int) -> int:
    """Bits of one filter: a power of two, in proportion to the documents, within MIN_BITS and MAX_BITS."""
    want = max(1, n_docs) * LINES_PER_DOC * BITS_PER_LINE
    return min(MAX_BITS, max(MIN_BITS, 1 << math.ceil(math.log2(want))))


def line_keys(data: np.ndarray, off: np.ndarray, min_chars: int):
    """Of each line: text index, span, span of its key, and whether the key is long enough. data is lower-cased."""
    nl = np.flatnonzero(data == 10)
    doc_of = np.searchsorted(off, nl, side="right") - 1
    n = len(off) - 1
    start = np.concatenate((off[:-1], nl + 1))
    end = np.concatenate((off[1:], nl))
    # each text begins a line and each newline begins another; sorted by (text, position) they pair up
    so = np.lexsort((start, np.concatenate((np.arange(n), doc_of))))
    eo = np.lexsort((end, np.concatenate((np.arange(n), doc_of))))
    doc = np.concatenate((np.arange(n), doc_of))[so]
    start, end = start[so], end[eo]
    solid = np.flatnonzero(~tx.SPACE[data])
    i, j = np.searchsorted(solid, start), np.searchsorted(solid, end)
    some = i < j
    ks, ke = start.copy(), start.copy()
    ks[some], ke[some] = solid[i[some]], solid[j[some] - 1] + 1
    chars = tx.code_points(data)
    return doc, start, end, ks, ke, chars[ke] - chars[ks] >= min_chars


def _probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a hash."""
    return (h & np.uint64(bits - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def _has(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _put(bitmap: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))


def _text_hashes(texts: pa.Array, min_chars: int):
    """Runs of texts: first text, and (text, line hash) of the distinct long lines of each text."""
    data, off = tx.utf8(texts)
    for a, _, part, at in tx.runs(data, off, RUN_SIZE):
        low = tx.LOWER[part]
        doc, _, _, ks, ke, long = line_keys(low, at, min_chars)
        doc, ks, ke = doc[long], ks[long], ke[long]
        h = tx.hash_spans(low, ks, ke)
        order = np.lexsort((h, doc))
        same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        one = order[np.concatenate(([True], ~same))] if len(h) else order
        yield a, low, doc[one], h[one], ks[one], ke[one]


def _build(bits: int, min_chars: int):
    def run(batches):
        once, twice = np.zeros(bits >> 3, np.uint8), np.zeros(bits >> 3, np.uint8)
        for batch in batches:
            for _, _, _, h, _, _ in _text_hashes(batch.column(0), min_chars):
                h, count = np.unique(h, return_counts=True)
                p, q = _probes(h, bits)
                again = (_has(once, p) & _has(once, q)) | (count > 1)
                _put(once, p), _put(once, q)
                _put(twice, p[again]), _put(twice, q[again])
        for s in range(bits // SEGMENT):
            part = slice(s * SEGMENT >> 3, (s + 1) * SEGMENT >> 3)
            one, two = (np.flatnonzero(np.unpackbits(x[part], bitorder="little")).astype(np.uint32) for x in (once, twice))
            if len(one):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s], pa.int32()), pa.array([one.tobytes()], pa.binary()), pa.array([two.tobytes()], pa.binary())],
                    names=["segment", "once", "twice"])
    return run


def _merge(batches):
    """One row of a segment at a time; the rows of a segment stand together."""
    now, once, twice = None, None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([twice.tobytes()], pa.binary())],
                                          names=["segment", "twice"])
    for batch in batches:
        for s, one, two in zip(*(batch.column(i) for i in range(3)), strict=True):
            if s.as_py() != now:
                if now is not None:
                    yield out()
                now, once, twice = s.as_py(), np.zeros(SEGMENT >> 3, np.uint8), np.zeros(SEGMENT >> 3, np.uint8)
            mine = np.zeros(SEGMENT >> 3, np.uint8)
            _put(mine, np.frombuffer(one.as_py(), np.uint32).astype(np.int64))
            twice |= once & mine
            once |= mine
            _put(twice, np.frombuffer(two.as_py(), np.uint32).astype(np.int64))
    if now is not None:
        yield out()


def _suspects(seen, bits: int, min_chars: int):
    def run(batches):
        segments = seen.value
        bitmap = np.zeros(bits >> 3, np.uint8)
        for s, raw in segments.items():
            bitmap[s * SEGMENT >> 3:(s + 1) * SEGMENT >> 3] = np.frombuffer(raw, np.uint8)
        for batch in batches:
            ids = batch.column(0)
            for a, low, doc, h, ks, ke in _text_hashes(batch.column(1), min_chars):
                p, q = _probes(h, bits)
                hit = np.flatnonzero(_has(bitmap, p) & _has(bitmap, q))
                if len(hit):
                    raw = low.tobytes()
                    keys = [hashlib.md5(raw[s:e]).digest() for s, e in zip(ks[hit], ke[hit], strict=True)]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(a + doc[hit])), pa.array(keys, pa.binary())],
                                                     names=["id", "key"])
    return run


def _dropper(min_chars: int):
    def drop(texts: pa.Array, drops: pa.Array) -> pa.Array:
        data, off = tx.utf8(texts)
        n = len(off) - 1
        bad = [None if x is None else set(x) for x in drops.to_pylist()]
        kept = texts.to_pylist()
        lines, gone = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for a, b, part, at in tx.runs(data, off, RUN_SIZE):
            np.add.at(lines, a + np.searchsorted(at, np.flatnonzero(part == 10), side="right") - 1, 1)
            for i in range(a, b):
                if bad[i]:
                    one = part[at[i - a]:at[i - a + 1]]
                    low, raw = tx.LOWER[one], one.tobytes()
                    lowered = low.tobytes()
                    _, s, e, ks, ke, long = line_keys(low, np.array([0, len(one)]), min_chars)
                    stay = [not (x and hashlib.md5(lowered[k:m]).digest() in bad[i])
                            for x, k, m in zip(long, ks, ke, strict=True)]
                    gone[i] = len(stay) - sum(stay)
                    kept[i] = b"\n".join(raw[c:d] for c, d, x in zip(s, e, stay, strict=True) if x).decode()
        return pa.StructArray.from_arrays(
            [pa.array(kept, pa.string()), pa.array(lines + 1, pa.int64()), pa.array(gone, pa.int64())],
            names=["text", "n_lines", "n_dropped"])
    return F.arrow_udf(drop, T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()),
                                           T.StructField("n_dropped", T.LongType())]))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20,
                min_docs: int = 3) -> DataFrame:
    """Drop the lines that ``min_docs`` or more documents hold, except in the document of the largest id.

    A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends, A-Z lower-cased; keys of fewer than
    ``min_chars`` code points always stay. Returns the rows of ``docs`` with the text shortened, and
    ``n_lines`` (before dropping; null or empty text: 1) and ``n_dropped``; input columns of these two names
    are replaced. Rows of one id are one document; a null id is one document too, below all others. Null
    texts stay null. Rows that come twice stay twice. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    bits = filter_bits(docs.count())
    n = parts(docs)
    merged = (slim.select("text").mapInArrow(_build(bits, min_chars), "segment int, once binary, twice binary")
              .repartition(min(n, bits // SEGMENT), "segment").sortWithinPartitions("segment")
              .mapInArrow(_merge, "segment int, twice binary"))
    # at most MAX_BITS / 8 bytes, whatever the corpus
    seen = spark.sparkContext.broadcast({r.segment: bytes(r.twice) for r in merged.collect()})
    id_type = slim.schema["id"].dataType
    pairs = slim.mapInArrow(_suspects(seen, bits, min_chars), T.StructType(
        [T.StructField("id", id_type), T.StructField("key", T.BinaryType())]))
    pairs = cut(pairs.distinct(), "suspects")
    known = F.max(F.struct(F.col("id").isNotNull().alias("has"), F.col("id"))).alias("top")
    confirmed = pairs.groupBy("key").agg(F.count("*").alias("n"), known).where(F.col("n") >= min_docs)
    confirmed = confirmed.select("key", F.col("top.id").alias("keep"))
    drops = (pairs.join(confirmed, "key").where(~F.col("id").eqNullSafe(F.col("keep")))
             .groupBy("id").agg(F.collect_list("key").alias("drops")))
    drop, did, res = fresh(docs, "drops"), fresh(docs, "id"), fresh(docs, "res")
    drops = drops.select(F.col("id").alias(did), F.col("drops").alias(drop))
    out = docs.join(drops, docs[id_col].eqNullSafe(drops[did]), "left")
    out = out.withColumn(res, _dropper(min_chars)(F.col(text_col), F.col(drop)))
    new = {text_col: "text", "n_lines": "n_lines", "n_dropped": "n_dropped"}
    cols = [F.col(res)[new[c]].alias(c) if c in new else F.col(c) for c in docs.columns]
    return out.select(*cols, *[F.col(res)[c].alias(c) for c in ("n_lines", "n_dropped") if c not in docs.columns])
