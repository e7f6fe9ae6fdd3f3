"""Substring dedup: words covered by a window of 20 words that also starts earlier in the corpus are removed.

Windows are dealt to shards by their anchor, the least-hashed run of four words in them: equal windows have
equal anchors, and neighbouring windows of one anchor stay together as a segment of at most 36 words. Segments
that are equal as a whole need no search: all go but those at the first place. Where an anchor has different
segments, their words go to the anchor's shard, which builds a compressed FM-index (fmindex.py) over them and
streams the same segments through backward search; matching statistics of 20 or more give the intervals to
report. Repeated rows, and rows of one id, may hold a window at the same place; none of them is earlier.

Only first segments are searched, copies having been told apart before; a task reports copies within its own
rows itself, so a passage of very many documents costs a row per task. Anchors with very many different
segments are split by the hash of the window, which equal windows share as well.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from castlens.llm import textops as tx
from castlens.llm.fmindex import FMIndex
from castlens.llm.frames import cut, fresh, parts

WINDOW = 20
ANCHOR = 4
SHARD_SEGMENTS = 4000        # segments of an anchor in one shard; more are split by window hash
HOT_IN_TASK = 16             # segments of an anchor in a task's FLUSH_WORDS from which it may be a hot one
FLUSH_WORDS = 1 << 21        # words after which a task reports its segments
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)


def _running(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial sum of word hashes and the inverse powers: (total[e] - total[s]) * inverse[s] hashes words s to e."""
    power = np.cumprod(np.append(np.uint64(1), np.full(len(h), BASE, np.uint64)), dtype=np.uint64)
    inverse = np.cumprod(np.append(np.uint64(1), np.full(len(h), _INVERSE, np.uint64)), dtype=np.uint64)
    return np.append(np.uint64(0), np.cumsum(h * power[:-1], dtype=np.uint64)), inverse


def segments(h: np.ndarray, first: np.ndarray):
    """Of the windows of a run of texts: (text, first window, windows, anchor hash, content hash) of each segment."""
    n = len(h)
    if n < WINDOW:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    total, inverse = _running(h)
    a = tx.mix((total[ANCHOR:] - total[:-ANCHOR]) * inverse[:n - ANCHOR + 1], 17)
    m = n - WINDOW + 1
    best, at = a[:m].copy(), np.zeros(m, np.int64)
    for o in range(1, WINDOW - ANCHOR + 1):
        v = a[o:o + m]
        less = v < best
        best = np.where(less, v, best)
        at[less] = o
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    ok = doc[:m] == doc[WINDOW - 1:]
    where = np.arange(m) + at
    new = ok.copy()
    new[1:] &= ~ok[:-1] | (where[1:] != where[:-1]) | (doc[1:m] != doc[:m - 1])
    start = np.flatnonzero(new)
    stop = np.flatnonzero(ok & np.append(~ok[1:] | new[1:], True)) + 1
    end = stop + WINDOW - 1
    content = tx.mix((total[end] - total[start]) * inverse[start], 29)
    return doc[start], start - first[doc[start]], stop - start, best[start], content


def _pos(start, run):
    """Start and number of windows in one number that sorts by start."""
    return (start.astype(np.int64) << 32) | (run.astype(np.int64) << 16)


def _runs(batches):
    for batch in batches:
        data, off = tx.utf8(batch.column(1))
        ids, mark = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        for i, j, part, at in tx.runs(data, off):
            ws, we, first = tx.words(part, at)
            doc, start, run, anchor, content = segments(tx.hash_spans(part, ws, we), first)
            yield len(ws), ids[i + doc], _pos(start, run), anchor, content, mark[i + doc]


def _flushes(batches):
    """Segments of FLUSH_WORDS words at a time, sorted by anchor, content, document and start, each once; which are first
    of their content, and which have a place after the first one's."""
    held, words = [], 0

    def out():
        doc, pos, anchor, content, mark = (np.concatenate([x[k] for x in held]) for k in range(5))
        order = np.lexsort((mark, pos, doc, content, anchor))
        doc, pos, anchor, content, mark = doc[order], pos[order], anchor[order], content[order], mark[order]
        new, once = np.ones(len(doc), dtype=bool), np.ones(len(doc), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
        once[1:] = new[1:] | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1]) | (mark[1:] != mark[:-1])    # repeated rows
        doc, pos, anchor, content, mark, new = doc[once], pos[once], anchor[once], content[once], mark[once], new[once]
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        return doc, pos, anchor, content, mark, (doc > doc[first]) | (pos >> 32 > pos[first] >> 32)
    for n, *cols in _runs(batches):
        held.append(cols)
        words += n
        if words >= FLUSH_WORDS:
            yield out()
            held, words = [], 0
    if held:
        yield out()


def _busy(batches):
    """(anchor, n): anchors with many different segments in a task."""
    for _, _, anchor, _, _, later in _flushes(batches):
        value, n = np.unique(anchor[~later], return_counts=True)
        many = n >= HOT_IN_TASK
        if many.any():
            yield pa.RecordBatch.from_arrays([pa.array(value[many].view(np.int64)), pa.array(n[many])], names=["anchor", "n"])


def _emit(hot: dict[int, int]):
    """Segments, those at the first place in their task with the key of their shard; the others are copies already."""
    keys = np.array(sorted(hot), dtype=np.uint64)
    split_of = np.array([hot[k] for k in keys.tolist()], dtype=np.int64)

    def run(batches):
        for doc, pos, anchor, content, mark, later in _flushes(batches):
            split = np.ones(len(doc), np.int64)
            if len(keys):
                i = np.minimum(np.searchsorted(keys, anchor), len(keys) - 1)
                split = np.where(keys[i] == anchor, split_of[i], 1)
            key = np.where(split > 1, tx.mix(anchor + content % split.astype(np.uint64), 3), anchor)
            key = np.where(later, tx.mix(doc.astype(np.uint64), 5), key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), pa.array(anchor.view(np.int64)), pa.array(doc),
                 pa.array(pos), pa.array(mark), pa.array(split.astype(np.int32)), pa.array(later)],
                names=["key", "content", "anchor", "doc", "pos", "mark", "split", "copy"])
    return run


def _words(batches):
    """(anchor, sub, doc, pos, mark, mask, words): the words of the segments to search, in each shard that one of their windows goes to."""
    before = None
    for batch in batches:
        data, off = tx.utf8(batch.column(1))
        lists = batch.column(3).to_pylist()
        ids, mark = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        for i, j, part, at in tx.runs(data, off):
            ws, we, first = tx.words(part, at)
            h = tx.hash_spans(part, ws, we)
            total, inverse = _running(h)
            rows = {k: [] for k in ("anchor", "sub", "doc", "pos", "mark", "mask", "words")}
            for d in range(i, j):
                size = first[d - i + 1] - first[d - i]
                this = ids[d], mark[d], hashlib.md5(part[at[d - i]:at[d - i + 1]].tobytes()).digest()
                if this == before:                                       # a repeated row brings the same segments
                    continue
                before = this
                for one in lists[d]:
                    start, run = one["pos"] >> 32, (one["pos"] >> 16) & 0xFFFF
                    if start + run + WINDOW - 1 > size:
                        continue
                    s = first[d - i] + start
                    at_ = np.arange(s, s + run)
                    windows = tx.mix((total[at_ + WINDOW] - total[at_]) * inverse[at_], 41)
                    sub = (windows % np.uint64(one["split"])).astype(np.int64)
                    words = h[s:s + run + WINDOW - 1].tobytes()
                    for value in np.unique(sub):
                        for k, v in zip(rows, (one["anchor"], int(value), ids[d], (start << 32) | (run << 16), mark[d],
                                               int(((sub == value).astype(np.int64) << np.arange(run)).sum()), words), strict=True):
                            rows[k].append(v)
            if rows["doc"]:
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)], names=list(rows))


def search(words: np.ndarray, before: np.ndarray, mask: np.ndarray, doc: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of shards, with their documents and first words' numbers: for each of their windows in the mask,
    its segment, its number, and whether it also starts earlier. The FM-index is built and searched here."""
    size = np.diff(before)
    n = len(words)
    symbols = np.unique(words, return_inverse=True)[1] + 1
    place = np.arange(n) + np.repeat(np.arange(len(size)), size)         # a separator after each segment
    text = np.zeros(n + len(size), np.int64)
    text[place] = symbols
    index = FMIndex(text)
    windows = size - WINDOW + 1
    seg = np.repeat(np.arange(len(size)), windows)
    number = np.arange(len(seg)) - np.repeat(np.concatenate(([0], np.cumsum(windows)[:-1])), windows)
    asked = (mask[seg] >> number) & 1 == 1
    seg, number = seg[asked], number[asked]
    start = before[:-1][seg] + seg + number
    matched, lo, hi = index.matching(text, start + WINDOW - 1, WINDOW)
    earlier = np.zeros(len(seg), dtype=bool)
    full = np.flatnonzero(matched >= WINDOW)
    if len(full):
        span, of = np.unique(np.stack((lo[full], hi[full]), axis=1), axis=0, return_inverse=True)
        words_of = size + 1                                              # and the separator
        word = np.arange(len(text)) - np.repeat(before[:-1] + np.arange(len(size)), words_of) + np.repeat(begin, words_of)
        holder = np.repeat(doc, words_of)
        order = np.lexsort((word, holder))
        later = np.append(False, (holder[order][1:] != holder[order][:-1]) | (word[order][1:] != word[order][:-1]))
        rank = np.zeros(len(text), np.int64)
        rank[order] = np.cumsum(later)                                   # equal places have equal ranks
        edges = np.append(rank[index.order], n + len(size))
        least = np.minimum.reduceat(edges, span.ravel())[::2]
        earlier[full] = least[of.ravel()] < rank[start[full]]
    return seg, number, earlier


def _search(batches):
    """(doc, pos, mark): runs of windows that start earlier, of the segments of each shard."""
    for t, start in tx.whole_groups(batches, ["anchor", "sub"], 2000):
        words, before = tx.fixed(t.column("words"), np.uint64)
        # one index serves some shards: a word is another symbol in each, so a segment that several
        # shards of a split anchor hold meets itself in none of them
        shard = np.repeat(np.arange(len(start) - 1, dtype=np.uint64), np.diff(start))
        words = words ^ np.repeat(tx.mix(shard, 53), np.diff(before))
        doc, pos = t.column("doc").to_numpy(), t.column("pos").to_numpy()
        seg, number, earlier = search(words, before, t.column("mask").to_numpy(), doc, pos >> 32)
        seg, number = seg[earlier], number[earlier]
        if len(seg):
            start = (pos[seg] >> 32) + number
            yield pa.RecordBatch.from_arrays([pa.array(doc[seg]), pa.array(_pos(start, np.ones(len(seg), np.int64))), t.column("mark").combine_chunks().take(pa.array(seg))],
                                             names=["doc", "pos", "mark"])


def _remove(texts: pa.Array, spans: pa.Array) -> pa.Array:
    data, off = tx.utf8(texts)
    bad = spans.to_pylist()
    n = len(off) - 1
    kept, count, gone = [""] * n, np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, j, part, at in tx.runs(data, off):
        ws, we, first = tx.words(part, at)
        count[i:j] = np.diff(first)
        raw = part.tobytes()
        for d in range(i, j):
            a, b = first[d - i], first[d - i + 1]
            stay = np.arange(a, b)
            if bad[d]:
                pos = np.array(bad[d], dtype=np.int64)
                start, end = pos >> 32, np.minimum((pos >> 32) + ((pos >> 16) & 0xFFFF) + WINDOW - 1, b - a)
                level = np.zeros(b - a + 1, np.int64)
                np.add.at(level, np.minimum(start, b - a), 1)
                np.add.at(level, end, -1)
                stay = stay[np.cumsum(level)[:-1] == 0]
                gone[d] = b - a - len(stay)
            kept[d] = b" ".join([raw[s:e] for s, e in zip(ws[stay].tolist(), we[stay].tolist(), strict=True)]).decode()
    return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(count), pa.array(gone)], names=["text", "n_words", "n_removed"])


def repeated_windows(slim: DataFrame) -> DataFrame:
    """(id, text, mark) -> (doc, pos, mark): runs of windows that also start earlier."""
    n = parts(slim)
    found = slim.mapInArrow(_busy, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > SHARD_SEGMENTS)
    hot = {r.anchor & 0xFFFFFFFFFFFFFFFF: -(-r.n // SHARD_SEGMENTS) for r in found.collect()}   # at most segments / SHARD_SEGMENTS rows
    rows = slim.mapInArrow(_emit(hot), "key long, content long, anchor long, doc long, pos long, mark long, split int, copy boolean")
    rows = rows.repartition(n, "key")
    mine = Window.partitionBy("key", "copy")
    equal = Window.partitionBy("key", "copy", "content").orderBy("doc", "pos", "mark")
    start = F.shiftright("pos", 32)
    rows = (rows.withColumn("same", F.coalesce((F.lag("doc").over(equal) == F.col("doc")) & (F.lag("pos").over(equal) == F.col("pos"))
                                        & (F.lag("mark").over(equal) == F.col("mark")), F.lit(False)))
            .withColumn("first", F.first(F.struct(F.col("doc"), start)).over(equal.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("again", F.col("copy") | (F.struct(F.col("doc"), start) > F.col("first"))).where(~F.col("same")))
    rows = rows.withColumn("kinds", F.sum(F.when(F.col("again"), 0).otherwise(1)).over(mine))
    rows = cut(rows.where(F.col("again") | (F.col("kinds") > 1) | (F.col("split") > 1)).select("doc", "pos", "mark", "anchor", "split", "again"), "segments")
    asked = (rows.where(~F.col("again")).groupBy("doc", "mark").agg(F.collect_list(F.struct("pos", "anchor", "split")).alias("asked")))
    words = (slim.join(asked.select(F.col("doc").alias("adoc"), F.col("mark").alias("amark"), "asked"),
                       (F.col("id") == F.col("adoc")) & (F.col("mark") == F.col("amark")))
             .select("id", "text", "mark", "asked").mapInArrow(_words, "anchor long, sub int, doc long, pos long, mark long, mask long, words binary"))
    hits = (words.repartition(n, "anchor", "sub").sortWithinPartitions("anchor", "sub", "doc", "pos")
            .mapInArrow(_search, "doc long, pos long, mark long"))
    return rows.where("again").select("doc", "pos", "mark").unionByName(hits)


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text's kept words joined by one space, and n_words, n_removed (columns of these names are replaced).

    A word goes if a window of WINDOW words of its text covers it whose words also start earlier: in a smaller
    integer id, or in the same id at an earlier word. Rows of one id count as one document; null ids are the
    greatest. Windows are judged on the input. Null texts have no words and become empty. Windows are told
    apart by 64-bit hashes of their words and of their segments, rows of one id by 64-bit hashes of their texts.
    An empty table gives an empty table.
    """
    ident, mark, spans, got = (fresh(docs, x) for x in ("ident", "mark", "spans", "got"))
    did, dmark = fresh(docs, "did"), fresh(docs, "dmark")
    full = docs.withColumn(ident, F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))).withColumn(
        mark, F.xxhash64(F.col(text_col)))
    slim = full.select(F.col(ident).alias("id"), F.col(text_col).alias("text"), F.col(mark).alias("mark"))
    flags = repeated_windows(slim).groupBy(F.col("doc").alias(did), F.col("mark").alias(dmark)).agg(F.collect_list("pos").alias(spans))
    out = full.join(flags, (F.col(ident) == F.col(did)) & (F.col(mark) == F.col(dmark)), "left")
    out = out.withColumn(got, F.arrow_udf(_remove, "struct<text:string,n_words:bigint,n_removed:bigint>")(F.col(text_col), F.col(spans)))
    new = {text_col: "text", "n_words": "n_words", "n_removed": "n_removed"}
    return out.select(*[F.col(got)[new[c]].alias(c) if c in new else F.col(c) for c in docs.columns],
                      *[F.col(got)[c].alias(c) for c in ("n_words", "n_removed") if c not in docs.columns])
