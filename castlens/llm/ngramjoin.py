"""N-gram Jaccard self-join with Bayesian candidate pruning.

Equal texts are one class from the start. Each distinct text gets a MinHash signature of its word shingles;
texts that agree on a band of the signature meet in a bucket, and each pair is judged in the first band on
which it agrees, so no pair is judged twice and none has to be made distinct. In a bucket, signatures are
compared a few values at a time; a pair is dropped as soon as the posterior probability that its similarity
reaches the threshold (uniform prior, so ``P(Bin(n + 1, t) <= m)`` after m of n matches) is below the
tolerance. What is left is verified on the exact shingle sets.

Buckets of any size are cut into tiles of bounded size, each pair of tiles a group of its own; from a group
come counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castlens.llm import textops as tx
from castlens.llm.components import components
from castlens.llm.frames import among, cut, fresh, parts, release, small_batches

BANDS, ROWS = 32, 4          # a pair of similarity 0.8 shares no band with probability 5e-8
HASHES = BANDS * ROWS
STEP = 16                    # signature values that are compared at a time
TOLERANCE = 1e-6
TILE = 512                   # members of a bucket that are compared with as many others in one group
PAIRS = 1 << 17              # pairs in memory at a time
RUN_SIZE = 1 << 18           # bytes of text that arrays are made for at a time; one longer text is its own run
WHOLE = 1 << 13              # pairs whose whole signatures are compared at a time
SEED = 0x8A5CD789635D2DFF


def least_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(n, m): after n values, pairs with fewer than m matches are dropped."""
    t = Fraction(str(threshold))
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = Fraction(0), 0
        while m <= n:
            total += comb(n + 1, m) * t**m * (1 - t)**(n + 1 - m)
            if total >= Fraction(tolerance):
                break
            m += 1
        out.append((n, m))
    return out


def _features(k: int):
    a, b = tx.permutations(HASHES, SEED)

    def run(batches):
        for batch in batches:
            data, off = tx.utf8(batch.column(1))
            for i, j, part, at in tx.runs(data, off, RUN_SIZE):
                ws, we, first = tx.words(part, at)
                h, before = tx.shingles(tx.hash_spans(part, ws, we), first, k)
                sig = tx.minhash(h, before, a, b)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(before) > 0),
                     tx.pack(sig.ravel(), np.arange(j - i + 1) * HASHES), batch.column(2).slice(i, j - i)],
                    names=["tk", "has", "sig", "id"])
    return run


def _bands(batches):
    for batch in batches:
        sig = tx.fixed(batch.column(1), np.uint32)[0].reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = np.zeros(sig.shape[:2], dtype=np.uint64)
        for r in range(ROWS):
            key = tx.mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r] + np.uint64(1))
        key = (key & ~np.uint64(BANDS - 1)) | np.arange(BANDS, dtype=np.uint64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key.ravel().view(np.int64)), batch.column(0).take(pa.array(np.repeat(np.arange(len(sig)), BANDS)))],
            names=["bucket", "tk"])


def _pairs(start: np.ndarray, i: np.ndarray, j: np.ndarray, chunk: np.ndarray):
    """Pairs of row indexes of each group, some groups at a time: within a tile, or between its two tiles."""
    left, right, n = [], [], 0
    for a, b in zip(start[:-1], start[1:], strict=True):
        if i[a] == j[a]:
            x, y = np.triu_indices(b - a, 1)
            todo = [(x + a, y + a)]
        else:
            one, two = a + np.flatnonzero(chunk[a:b] == i[a]), a + np.flatnonzero(chunk[a:b] == j[a])
            rows = max(1, PAIRS // max(1, len(two)))
            todo = [(np.repeat(one[r:r + rows], len(two)), np.tile(two, len(one[r:r + rows]))) for r in range(0, len(one), rows)]
        for x, y in todo:
            left.append(x), right.append(y)
            n += len(x)
            if n >= PAIRS:
                yield np.concatenate(left), np.concatenate(right)
                left, right, n = [], [], 0
    if n:
        yield np.concatenate(left), np.concatenate(right)


def _likely(sig: np.ndarray, band: np.ndarray, x: np.ndarray, y: np.ndarray, least: list[tuple[int, int]]):
    """The pairs that survive the incremental comparison and agree on no earlier band."""
    matches = np.zeros(len(x), dtype=np.int16)
    for n, m in least:
        matches += (sig[x, n - STEP:n] == sig[y, n - STEP:n]).sum(1, dtype=np.int16)
        live = matches >= m
        x, y, matches = x[live], y[live], matches[live]
    first = np.zeros(len(x), dtype=bool)
    for a in range(0, len(x), WHOLE):
        i, j = x[a:a + WHOLE], y[a:a + WHOLE]
        same = (sig[i].reshape(-1, BANDS, ROWS) == sig[j].reshape(-1, BANDS, ROWS)).all(2)
        first[a:a + WHOLE] = same.argmax(1) == band[i]
    return x[first], y[first]


TILE_KEYS = ["bucket", "i", "j"]
TILE_SCHEMA = "bucket long, i int, j int, chunk int, tk binary, n long, sig binary"


def _prune(least: list[tuple[int, int]]):
    """Rows of the tiles that have a likely partner in their group."""
    def run(batches):
        for t, start in tx.whole_groups(batches, TILE_KEYS):
            sig = tx.fixed(t.column("sig"), np.uint32)[0].reshape(-1, HASHES)
            band = t.column("bucket").to_numpy() & (BANDS - 1)
            live = np.zeros(t.num_rows, dtype=bool)
            for x, y in _pairs(start, t.column("i").to_numpy(), t.column("j").to_numpy(), t.column("chunk").to_numpy()):
                x, y = _likely(sig, band, x, y, least)
                live[x] = live[y] = True
            if live.any():
                yield from t.filter(pa.array(live)).combine_chunks().to_batches()
    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            data, off = tx.utf8(batch.column(1))
            for i, j, part, at in tx.runs(data, off, RUN_SIZE):
                ws, we, first = tx.words(part, at)
                values, before = tx.distinct_per_text(*tx.shingles(tx.hash_spans(part, ws, we), first, k))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), tx.pack(values, before)], names=["tk", "shingles"])
    return run


def exact(values: np.ndarray, before: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sorted sets have a Jaccard similarity of at least the threshold (as a decimal fraction)."""
    t = Fraction(str(threshold))
    size = np.diff(before)
    ok = np.zeros(len(x), dtype=bool)
    order = np.argsort(x, kind="stable")
    lo, hi = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
    order = order[(lo * t.denominator >= hi * t.numerator)[order]]
    if not len(order):
        return ok
    cut_at = np.flatnonzero(np.append(True, x[order][1:] != x[order][:-1]))
    for a, b in zip(cut_at, [*cut_at[1:], len(order)], strict=True):
        mine = values[before[x[order[a]]]:before[x[order[a]] + 1]]
        most = max(1, (1 << 20) // max(1, int(size[y[order[a:b]]].max())))
        for c in range(a, b, most):
            pick = order[c:min(b, c + most)]
            n = size[y[pick]]
            first = np.concatenate(([0], np.cumsum(n)[:-1]))
            theirs = values[np.repeat(before[y[pick]] - first, n) + np.arange(n.sum())]
            at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
            common = np.add.reduceat(mine[at] == theirs, first, dtype=np.int64)
            ok[pick] = common * t.denominator >= (n + len(mine) - common) * t.numerator
    return ok


def _verify(least: list[tuple[int, int]], threshold: float):
    """Of each row of a group with a link: how many documents it is linked to there, and its root in the group."""
    def run(batches):
        for t, start in tx.whole_groups(batches, TILE_KEYS, 500):
            sig = tx.fixed(t.column("sig"), np.uint32)[0].reshape(-1, HASHES)
            values, before = tx.fixed(t.column("shingles"), np.uint64)
            band, n = t.column("bucket").to_numpy() & (BANDS - 1), t.column("n").to_numpy()
            links = np.zeros(t.num_rows, dtype=np.int64)
            ends = []
            for x, y in _pairs(start, t.column("i").to_numpy(), t.column("j").to_numpy(), t.column("chunk").to_numpy()):
                x, y = _likely(sig, band, x, y, least)
                ok = exact(values, before, x, y, threshold)
                x, y = x[ok], y[ok]
                np.add.at(links, x, n[y])
                np.add.at(links, y, n[x])
                ends.append((x, y))
            if links.any():
                root = tx.roots(t.num_rows, np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends]))
                some = np.flatnonzero(links)
                tk = t.column("tk").combine_chunks()
                tk = tk if isinstance(tk, pa.Array) else pa.concat_arrays(tk.chunks)
                yield pa.RecordBatch.from_arrays([tk.take(pa.array(some)), pa.array(links[some]), tk.take(pa.array(root[some]))],
                                                 names=["tk", "links", "root"])
    return run


def jaccard_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                    threshold: float = 0.8, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per distinct text: tk (its md5), n_links, class_id and class_tk (id and md5 of the least member).

    Texts are linked when the Jaccard similarity of their sets of k-word shingles is ``threshold`` or more (a
    text of 1 to k - 1 words has one shingle); n_links counts the other rows linked to each row of the text,
    copies included. A class is what links reach; its id is the least id in it, null ids last. Texts without
    a word (null, empty, white space) are linked to nothing, not even to copies, and have null class_id.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("tk"),
                       F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    id_type = slim.schema["id"].dataType.simpleString()
    n = parts(docs)
    least = least_matches(threshold, tolerance)
    texts = (slim.mapInArrow(_features(k), f"tk binary, has boolean, sig binary, id {id_type}")
             .groupBy("tk").agg(F.count("*").alias("n"), F.first("has").alias("has"), F.first("sig").alias("sig"),
                                F.min(F.struct(F.col("id").isNull().alias("no"), F.col("id"))).alias("top")))
    texts = cut(texts, "texts")
    bands = texts.where("has").select("tk", "sig").mapInArrow(_bands, "bucket long, tk binary")
    shared = bands.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
    tiles = F.ceil(F.col("c") / TILE).cast("int")
    rows = (bands.join(shared, "bucket").withColumn("g", tiles)
            .withColumn("chunk", F.pmod(F.xxhash64("tk"), F.col("g")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
            .select("bucket", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "tk"))
    rows = rows.join(texts.select("tk", "n", "sig"), "tk").select("bucket", "i", "j", "chunk", "tk", "n", "sig")
    likely = cut(rows.repartition(n, *TILE_KEYS).sortWithinPartitions(*TILE_KEYS).mapInArrow(_prune(least), TILE_SCHEMA), "likely")
    wanted = likely.select("tk").distinct().join(texts.select("tk", F.col("top.id").alias("wid")), "tk").withColumnRenamed("tk", "wtk")
    release(docs.sparkSession)
    bodies = (among(slim, likely).join(wanted, (F.col("tk") == F.col("wtk")) & F.col("id").eqNullSafe(F.col("wid")))
              .groupBy("tk", "id").agg(F.first("text").alias("text")).select("tk", "text"))
    sets = bodies.mapInArrow(_sets(k), "tk binary, shingles binary")
    found = (likely.join(sets, "tk").repartition(n, *TILE_KEYS).sortWithinPartitions(*TILE_KEYS)
             .select(*TILE_KEYS, "chunk", "tk", "n", "sig", "shingles")
             .mapInArrow(_verify(least, threshold), "tk binary, links long, root binary"))
    found = cut(found, "found")
    release(docs.sparkSession)
    root = components(found.select(F.col("tk").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("tk"), "root")
    links = found.groupBy("tk").agg(F.sum("links").alias("links"))
    all_texts = (texts.select("tk", "n", "has", "top").join(links, "tk", "left").join(root, "tk", "left")
                 .withColumn("root", F.coalesce("root", "tk")))
    tops = (all_texts.groupBy("root").agg(F.min(F.struct("top.no", "top.id", "tk")).alias("low")))
    out = all_texts.join(tops, "root")
    return out.select("tk", (F.coalesce("links", F.lit(0)) + F.when(F.col("has"), F.col("n") - 1).otherwise(0)).alias("n_links"),
                      F.col("has").alias("has_words"), F.when(F.col("has"), F.col("low.id")).alias("class_id"),
                      F.col("low.tk").alias("class_tk"))


def jaccard_links(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                  threshold: float = 0.8) -> DataFrame:
    """One row per row of ``docs``: its id, n_links, class_id (its own id for a text without words) and kept.

    ``kept`` is true for the member that stands for its class. Repeated rows are linked to each other and share
    one class. An empty table gives an empty table. See ``jaccard_classes``.
    """
    classes = jaccard_classes(docs, id_col=id_col, text_col=text_col, k=k, threshold=threshold)
    mine = docs.select(F.col(id_col), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("tk__"))
    out = mine.join(classes, F.col("tk__") == F.col("tk"))
    own = F.coalesce("class_id", F.when(~F.col("has_words"), F.col(id_col)))
    return out.select(F.col(id_col), "n_links", own.alias("class_id"),
                      (~F.col("has_words") | (F.col(id_col).eqNullSafe(F.col("class_id")) & (F.col("tk") == F.col("class_tk")))).alias("kept"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each class; texts without words all stay.

    Rows that agree in id and text are one document, of which one row stays.
    """
    classes = jaccard_classes(docs, id_col=id_col, text_col=text_col, k=k, threshold=threshold)
    tk, key = fresh(docs, "tk"), fresh(docs, "key")
    full = docs.withColumn(tk, F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    # id and text as one column, whose nulls compare as equal: join and duplicates share one shuffle of the texts
    full = full.withColumn(key, F.struct(F.col(id_col).alias("id"), F.col(tk).alias("tk"))).drop(tk)
    mine = F.col(key)
    stay = (full.select(key).distinct().join(classes, mine["tk"] == F.col("tk"))
            .where(~F.col("has_words") | (mine["id"].eqNullSafe(F.col("class_id")) & (F.col("tk") == F.col("class_tk"))))
            .select(key))
    return full.join(stay, key, "left_semi").dropDuplicates([key]).select(*docs.columns)
