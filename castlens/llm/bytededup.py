"""Suffix-array dedup: bytes covered by a window of WINDOW bytes that also starts elsewhere in the corpus are removed.

A window is dealt by its anchor, the least-hashed run of ANCHOR bytes in it: equal windows have equal anchors at equal
offsets. Neighbouring windows of one anchor are a segment of at most WINDOW - ANCHOR + 1 windows. Segments meet by anchor;
those that meet another one, or a copy of themselves, go to the anchor's shard with their bytes. There the suffixes at
their windows are put in order (suffixes.py) and the longest previous and next factors say which windows start
at another place too. Equal segments are indexed as two: the first and one that stands for all later ones.

What moves: 48 bytes a segment (about 1.5% of the bytes begin one) to the anchors, the bytes of each different segment that
met another to its shard, and the text twice, to cut these segments out and to be shortened. Copies within a task are told
apart there, so a passage of very many documents costs its anchors a row per task; an anchor seen very often is salted
by content. An anchor of more than MOST different segments is not put into one shard: its windows are dealt by their
own hash, and equal windows are counted there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castlens.llm import textops as tx
from castlens.llm.frames import cut, fresh, parts, release, small_batches
from castlens.llm.suffixes import factors, suffix_ranks

WINDOW = 200
ANCHOR = 48
PIECE = 1 << 17              # windows of a text that are looked at together
FLUSH = 1 << 17              # segments after which a task tells copies apart
MOST = 4096                  # different segments of an anchor in one shard
SHARD = 2000                 # segments that are put in order together, or those of one anchor if they are more
SKETCH = 1 << 14             # anchors a task remembers to find those seen very often
OFTEN = 1 << 15              # occurrences (distinct within a flush) from which an anchor is salted
NO_ID = (1 << 63) - 1
_LOW = np.uint64((1 << 18) - 1)


def segments(data: np.ndarray, off: np.ndarray):
    """Of a run of texts: first window (byte in the run), windows, anchor hash and content hash of each segment."""
    n = len(data)
    nw = n - WINDOW + 1
    if nw <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    power, inverse = tx._pow_tables(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    a = total[ANCHOR:] - total[:-ANCHOR]
    a *= inverse[:n - ANCHOR + 1]
    a ^= a >> np.uint64(29)
    a *= np.uint64(0xBF58476D1CE4E5B9)
    least = (a & ~_LOW) | np.arange(len(a), dtype=np.uint64)             # the leftmost of equal ones
    size, width = 1, WINDOW - ANCHOR + 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if width > size:
        least = np.minimum(least[:size - width], least[width - size:])
    new = np.ones(nw, bool)
    new[1:] = least[1:] != least[:-1]
    ok = np.ones(nw, bool)
    for e in off[1:-1].tolist():                                          # windows across two texts
        ok[max(0, e - WINDOW + 1):min(nw, e)] = False
    edge = off[1:-1]
    new[edge[edge < nw]] = True
    start = np.flatnonzero(new & ok)
    bound = np.append(np.flatnonzero(new | ~ok), nw)
    stop = bound[np.searchsorted(bound, start, side="right")]
    end = stop + WINDOW - 1
    content = tx.mix((total[end] - total[start]) * inverse[start], 29)
    return start, stop - start, a[(least[start] & _LOW).astype(np.int64)], content


def _pieces(texts: pa.Array):
    """(first text, offsets, bytes, where the bytes begin in the text): runs of short texts, or a piece of a long one."""
    data, off = tx.utf8(texts)
    for i, j, part, at in tx.runs(data, off, PIECE):
        if len(part) <= PIECE + WINDOW:
            yield i, at, part, 0
            continue
        for b in range(0, len(part) - WINDOW + 1, PIECE):
            piece = part[b:b + PIECE + WINDOW - 1]
            yield i, np.array([0, len(piece)]), piece, b


def _found(batches):
    """Segments of (id, mark, text): anchor, content, id, mark, pos (start and number of windows)."""
    for batch in batches:
        ids, mark = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for i, at, part, b in _pieces(batch.column(2)):
            start, run, anchor, content = segments(part, at)
            text = np.searchsorted(at, start, side="right") - 1
            yield anchor, content, ids[i + text], mark[i + text], ((start - at[text] + b) << 8) | run


def _flushes(batches):
    """Segments some at a time, each once, sorted; which are first of their content there, and whether copies follow."""
    held, n = [], 0

    def out():
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        order = np.lexsort(cols[::-1])
        cols = [c[order] for c in cols]
        diff = [np.append(True, c[1:] != c[:-1]) for c in cols]
        once = np.any(diff, axis=0)                                       # repeated rows
        first = (diff[0] | diff[1])[once]
        cols = [c[once] for c in cols]
        more = np.append(~first[1:], False)
        return cols, first, first & more
    for cols in _found(batches):
        held.append(cols)
        n += len(cols[0])
        if n >= FLUSH:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def _sketch(batches):
    """(anchor, n): Misra-Gries counts of the anchors of different segments; an anchor that is left out has been seen at
    most (segments of the task / SKETCH) times."""
    anchor, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for cols, first, _ in _flushes(batches):
        a, c = np.unique(cols[0][first], return_counts=True)
        anchor, back = np.unique(np.concatenate((anchor, a)), return_inverse=True)
        count = np.bincount(back, np.concatenate((count, c)), len(anchor)).astype(np.int64)
        if len(anchor) > SKETCH:
            count -= np.partition(count, -SKETCH - 1)[-SKETCH - 1]
            anchor, count = anchor[count > 0], count[count > 0]
    if len(anchor):
        yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(count)], names=["anchor", "n"])


MEET = "anchor long, salt int, content long, id long, mark long, pos long, kind int"
PLAIN, REPEATED, COPY = 0, 1, 2


def _emit(often: dict[int, int]):
    """Rows of MEET. REPEATED: copies of it in the task follow; COPY: has another one before it there."""
    keys = np.array(sorted(often), dtype=np.uint64)
    salts = np.array([often[k] for k in keys.tolist()], dtype=np.uint64)

    def run(batches):
        for (anchor, content, ids, mark, pos), first, more in _flushes(batches):
            salt = np.zeros(len(anchor), np.int32)
            if len(keys):
                i = np.minimum(np.searchsorted(keys, anchor), len(keys) - 1)
                hit = keys[i] == anchor
                salt[hit] = 1 + (content[hit] % salts[i[hit]]).astype(np.int32)
            spread = (tx.mix(mark.view(np.uint64)) >> np.uint64(33)).astype(np.int32)
            salt = np.where(first, salt, -1 - spread)                    # copies need no meeting: anywhere
            kind = np.where(first, np.where(more, REPEATED, PLAIN), COPY).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(salt), pa.array(content.view(np.int64)), pa.array(ids), pa.array(mark),
                 pa.array(pos), pa.array(kind)], names=["anchor", "salt", "content", "id", "mark", "pos", "kind"])
    return run


SEEN = "anchor long, content long, id long, mark long, pos long, first boolean, multi boolean"


def _meet(batches):
    """Rows of SEEN for segments whose anchor has another one or a copy. Rows come sorted by anchor, salt, content, place;
    a row needs the one before and the one after it, so no group is held."""
    names = ["anchor", "content", "id", "mark", "pos"]
    held = None                                                          # the last row, not judged yet, and the one before it

    def judged(t: pa.Table, tail: int):
        """All rows but the first (judged already) and, if more may follow, the last."""
        c = {k: t.column(k).to_numpy() for k in t.column_names}
        n = t.num_rows
        same = np.zeros(n + 1, bool)                                     # row i has the anchor of row i - 1
        same[1:n] = (c["anchor"][1:] == c["anchor"][:-1]) & (c["salt"][1:] == c["salt"][:-1])
        equal = same.copy()
        equal[1:n] &= c["content"][1:] == c["content"][:-1]
        first, copied = ~equal[:n], c["kind"] == REPEATED
        pick = np.flatnonzero(same[:n] | same[1:] | copied | (c["salt"] > 0))
        pick = pick[(pick >= 1) & (pick < n - tail)]
        return pa.RecordBatch.from_arrays([*[pa.array(c[k][pick]) for k in names], pa.array(first[pick]),
                                           pa.array((first & (equal[1:] | copied))[pick])], names=[*names, "first", "multi"])
    for batch in batches:
        t = pa.Table.from_batches([batch])
        copies = t.filter(pc.equal(t["kind"], COPY))
        if copies.num_rows:
            no = pa.array(np.zeros(copies.num_rows, bool))
            yield from copies.select(names).append_column("first", no).append_column("multi", no).combine_chunks().to_batches()
        t = t.filter(pc.not_equal(t["kind"], COPY))
        if not t.num_rows:
            continue
        if held is None:
            blank = t.slice(0, 1)
            held = blank.set_column(1, t.schema.field("salt"), pa.array([-7], pa.int32()))       # of no row
        t = pa.concat_tables([held, t])
        cols = [t.column(k).to_numpy() for k in ("salt", *names)]
        new = np.append(True, np.any([c[1:] != c[:-1] for c in cols], axis=0))                   # repeated rows, from several tasks
        t = t.filter(pa.array(new)).combine_chunks()
        yield judged(t, 1)
        held = t.slice(max(0, t.num_rows - 2))
    if held is not None:
        yield judged(held, 0)


def _cut_out(batches):
    """(id, mark, text, asked) -> (anchor, content, id, mark, pos, multi, hot, bytes) of the segments asked for; the windows of a
    hot one (more segments than a shard takes) by their own hashes, without bytes."""
    for batch in batches:
        data, off = tx.utf8(batch.column(2))
        ids, mark, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
        flat = lists.flatten()
        size = np.diff(lists.offsets.to_numpy())
        text = np.repeat(np.arange(len(size)), size)
        pos = flat.field("pos").to_numpy()
        start = off[:-1][text] + (pos >> 8)
        length = (pos & 255) + WINDOW - 1
        before = np.concatenate(([0], np.cumsum(length)))
        for a in range(0, len(pos), 2000):
            b = min(len(pos), a + 2000)
            at = np.repeat(start[a:b] - (before[a:b] - before[a]), length[a:b]) + np.arange(before[b] - before[a])
            yield pa.RecordBatch.from_arrays(
                [flat.field("anchor")[a:b], flat.field("content")[a:b], pa.array(ids[text[a:b]]), pa.array(mark[text[a:b]]), pa.array(pos[a:b]),
                 flat.field("multi")[a:b], tx.pack(data[at], before[a:b + 1] - before[a])],
                names=["anchor", "content", "id", "mark", "pos", "multi", "bytes"])


def _ranges(flag: np.ndarray, edge: np.ndarray) -> pa.Array:
    """Of the windows of segments (which begin at ``edge``), the flagged ranges as packed pairs of numbers."""
    start, end = tx.spans(flag, edge)
    seg = np.searchsorted(edge, start, side="right") - 1
    pairs = np.stack((start - edge[seg], end - edge[seg]), axis=1).astype(np.int32)
    return tx.pack(pairs.ravel(), 2 * np.searchsorted(seg, np.arange(len(edge))))


RESULT = "anchor long, content long, first_ranges binary, later_ranges binary"


def judge(data: np.ndarray, before: np.ndarray, ids: np.ndarray, mark: np.ndarray, begin: np.ndarray, multi: np.ndarray, earlier_only: bool):
    """For segments with their bytes and first places: their windows' edges, and which windows of the first copy, and of all
    later ones, also start at an earlier place (or, unless ``earlier_only``, at any other)."""
    size = np.diff(before)
    windows = size - WINDOW + 1
    edge = np.concatenate(([0], np.cumsum(windows)))
    seg = np.repeat(np.arange(len(size)), windows)
    number = np.arange(edge[-1]) - edge[seg]
    starts = before[:-1][seg] + number
    rank = suffix_ranks(data, starts, WINDOW)
    order = np.lexsort((begin[seg] + number, mark[seg], ids[seg]))
    place = np.empty(len(seg), np.int64)
    place[order] = np.arange(len(seg))
    twin = np.flatnonzero(multi[seg])                                    # one later copy stands for all
    previous, following = factors(np.concatenate((rank, rank[twin])), np.concatenate((place, len(seg) + place[twin])), WINDOW)
    hit = previous >= WINDOW if earlier_only else (previous >= WINDOW) | (following >= WINDOW)
    later = np.zeros(len(seg), bool)
    later[twin] = hit[len(seg):]
    return edge, hit[:len(seg)], later


def _judge(earlier_only: bool):
    def run(batches):
        for t, start in tx.whole_groups(batches, ["anchor"], SHARD):
            data, before = tx.fixed(t.column("bytes"), np.uint8)
            c = {k: t.column(k).to_numpy() for k in ("anchor", "content", "id", "mark", "pos", "multi")}
            keep = np.append(True, (c["anchor"][1:] != c["anchor"][:-1]) | (c["content"][1:] != c["content"][:-1]))   # of repeated rows
            if not keep.all():
                size = np.diff(before)
                data = data[np.repeat(keep, size)]
                before = np.concatenate(([0], np.cumsum(size[keep])))
                c = {k: v[keep] for k, v in c.items()}
            edge, first, later = judge(data, before, c["id"], c["mark"], c["pos"] >> 8, c["multi"], earlier_only)
            out = pa.RecordBatch.from_arrays([pa.array(c["anchor"]), pa.array(c["content"]), _ranges(first, edge), _ranges(later, edge)],
                                             names=["anchor", "content", "first_ranges", "later_ranges"])
            some = np.add.reduceat(first | later, edge[:-1]) > 0
            if some.any():
                yield out.filter(pa.array(some))
    return run


def _windows(batches):
    """(id, mark, text, asked) -> (hash, anchor, content, id, mark, start, multi, window): each window of the segments asked for."""
    for batch in _cut_out(batches):
        data, before = tx.fixed(pa.chunked_array([batch.column(6)]), np.uint8)
        power, inverse = tx._pow_tables(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=total[1:])
        windows = np.diff(before) - WINDOW + 1
        seg = np.repeat(np.arange(len(windows)), windows)
        number = np.arange(len(seg)) - np.repeat(np.cumsum(windows) - windows, windows)
        at = before[:-1][seg] + number
        h = tx.mix((total[at + WINDOW] - total[at]) * inverse[at], 43)
        pick = pa.array(seg)
        yield pa.RecordBatch.from_arrays(
            [pa.array(h.view(np.int64)), *[batch.column(i).take(pick) for i in range(4)], pa.array((batch.column(4).to_numpy() >> 8)[seg] + number),
             batch.column(5).take(pick), pa.array(number.astype(np.int32))],
            names=["hash", "anchor", "content", "id", "mark", "start", "multi", "window"])


def _as_ranges(numbers: pa.Array) -> pa.Array:
    """Window numbers of segments as packed ranges."""
    out = []
    for x in numbers.to_pylist():
        w = np.unique(np.array(x or [], dtype=np.int32))
        edge = np.flatnonzero(np.diff(w) != 1)
        low, high = w[np.append(0, edge + 1)] if len(w) else w, w[np.append(edge, len(w) - 1)] + 1 if len(w) else w
        out.append(np.stack((low, high), axis=1).astype(np.int32).tobytes())
    return pa.array(out, pa.binary())


def _hot(texts: DataFrame, earlier_only: bool) -> DataFrame:
    """Rows of RESULT for segments of anchors with more than MOST, whose windows meet by their own hash."""
    rows = cut(texts.mapInArrow(_windows, "hash long, anchor long, content long, id long, mark long, start long, multi boolean, window int").distinct(), "windows")
    place = F.struct("id", "mark", "start")
    met = rows.groupBy("hash").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.max("multi").alias("again"))
    met = cut(met.where(F.col("again") | (F.col("low") != F.col("high"))), "windows_met")
    rows = rows.join(met, "hash")
    first = (F.col("low") != place) if earlier_only else (F.col("again") | (F.col("low") != F.col("high")))
    ranges = F.arrow_udf(_as_ranges, "binary")
    got = rows.groupBy("anchor", "content").agg(F.collect_list(F.when(first, F.col("window"))).alias("f"),
                                                F.collect_list(F.when(F.col("multi"), F.col("window"))).alias("l"))
    return got.select("anchor", "content", ranges("f").alias("first_ranges"), ranges("l").alias("later_ranges"))


def _remove(texts: pa.Array, hits: pa.Array) -> pa.Array:
    """Bytes left, and bytes, removed bytes and maximal removed runs, of texts with the ranges of their segments."""
    data, off = tx.utf8(texts)
    n = len(off) - 1
    level = np.zeros(len(data) + 1, np.int32)
    flat = hits.flatten()
    if len(flat):
        text = np.repeat(np.flatnonzero(np.array(hits.is_valid())), np.array(pc.list_value_length(hits).drop_null()))
        pairs, before = tx.fixed(pa.chunked_array([flat.field("ranges")]), np.int32)
        seg = np.repeat(np.arange(len(flat)), np.diff(before) // 2)
        base = (off[:-1][text] + (flat.field("pos").to_numpy() >> 8))[seg]
        pairs = pairs.reshape(-1, 2)
        np.add.at(level, base + pairs[:, 0], 1)
        np.add.at(level, base + pairs[:, 1] + WINDOW - 1, -1)
    gone = np.cumsum(level[:-1]) > 0
    before = np.concatenate(([0], np.cumsum(~gone)))
    starts, _ = tx.spans(gone, off)
    spans = np.diff(np.searchsorted(starts, off))
    size = np.diff(off)
    left = np.diff(before[off])
    return pa.StructArray.from_arrays([tx.pack(data[~gone], before[off]), pa.array(size), pa.array(size - left), pa.array(spans)],
                                      names=["kept", "n_bytes", "n_removed", "n_spans"])


def repeated_ranges(slim: DataFrame, earlier_only: bool) -> DataFrame:
    """(id, mark, text) -> (id, mark, pos, ranges): segments with the ranges of their windows that start elsewhere too."""
    spark, n = slim.sparkSession, parts(slim)
    many = slim.mapInArrow(_sketch, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > OFTEN)
    # at most SKETCH rows of the sorted counts: beyond them a group is at most a 1/SKETCH of all segments
    often = {r.anchor & 0xFFFFFFFFFFFFFFFF: -(-r.n // MOST) for r in many.orderBy(F.desc("n")).limit(SKETCH).collect()}
    rows = slim.mapInArrow(_emit(often), MEET).repartition(n, "anchor", "salt")
    rows = rows.sortWithinPartitions("anchor", "salt", "content", "id", "mark", "pos", F.desc("kind"))
    seen = cut(rows.mapInArrow(_meet, SEEN), "segments")
    release(spark)
    firsts = seen.where("first")
    crowded = cut(firsts.groupBy("anchor").count().where(F.col("count") > MOST).select(F.col("anchor").alias("crowd")), "crowded")
    hot = bool(crowded.take(1))
    if hot:
        firsts = firsts.join(crowded, F.col("anchor") == F.col("crowd"), "left").withColumn("hot", F.col("crowd").isNotNull())
    else:
        firsts = firsts.withColumn("hot", F.lit(False))
    asked = firsts.groupBy(F.col("id").alias("aid"), F.col("mark").alias("amark"), "hot").agg(
        F.collect_list(F.struct("anchor", "content", "pos", "multi")).alias("asked"))
    texts = slim.join(asked, (F.col("id") == F.col("aid")) & (F.col("mark") == F.col("amark")))
    columns = ["id", "mark", "text", "asked"]
    shards = texts.where(~F.col("hot")).select(*columns).mapInArrow(
        _cut_out, "anchor long, content long, id long, mark long, pos long, multi boolean, bytes binary")
    found = (shards.repartition(n, "anchor").sortWithinPartitions("anchor", "content").mapInArrow(_judge(earlier_only), RESULT))
    if hot:
        found = found.unionByName(_hot(texts.where("hot").select(*columns), earlier_only))
    found = cut(found, "found")
    release(spark)
    ranges = F.when(F.col("first"), F.col("first_ranges")).otherwise(F.col("later_ranges"))
    return (seen.join(found, ["anchor", "content"]).select("id", "mark", "pos", ranges.alias("ranges")).where(F.octet_length("ranges") > 0))


def dedup_bytes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", earlier_only: bool = True) -> DataFrame:
    """``docs`` with kept (the bytes left, as binary), n_bytes, n_removed and n_spans (maximal removed runs); columns of these names
    are replaced.

    A text is its UTF-8 bytes; a null text is empty. A byte goes if a window of WINDOW bytes of its text covers it that also
    starts at an earlier place: in a smaller integer id (null ids last; of rows with one id, the smaller hash of the text),
    or in the same text before. With ``earlier_only`` off, at any other place, so that no copy stays. Overlaps count; windows
    are judged on the input. Rows that agree in id and text are one document: they are no copies of each other and get the same
    result. Segments are told apart by 64-bit hashes beside their anchor's, rows of one id by 64-bit hashes of their texts.
    An empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    ident, mark, hits, got, hid, hmark = (fresh(docs, x) for x in ("ident", "mark", "hits", "got", "hid", "hmark"))
    full = docs.withColumns({ident: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), mark: F.xxhash64(F.col(text_col))})
    slim = full.where(F.octet_length(text_col) >= WINDOW).select(F.col(ident).alias("id"), F.col(mark).alias("mark"), F.col(text_col).alias("text"))
    flags = repeated_ranges(slim, earlier_only)
    flags = flags.groupBy(F.col("id").alias(hid), F.col("mark").alias(hmark)).agg(F.collect_list(F.struct("pos", "ranges")).alias(hits))
    out = full.join(flags, (F.col(ident) == F.col(hid)) & (F.col(mark) == F.col(hmark)), "left")
    out = out.withColumn(got, F.arrow_udf(_remove, "struct<kept:binary,n_bytes:bigint,n_removed:bigint,n_spans:bigint>")(F.col(text_col), F.col(hits)))
    new = ("kept", "n_bytes", "n_removed", "n_spans")
    return out.select(*[F.col(got)[c].alias(c) if c in new else F.col(c) for c in docs.columns],
                      *[F.col(got)[c].alias(c) for c in new if c not in docs.columns])
