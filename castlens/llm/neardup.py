"""Embedding near-dedup: iterative quantisation codes, multi-index Hamming tables, rerank on the vectors.

Rotations that make the signs of centred unit vectors balanced, well-fitting binary codes are learned on a
bounded sample, from different starts. The codes, one after another, are cut into chunks of about log2(vectors
per label) bits; each chunk indexes a table, and vectors of one label meet where a chunk differs in at most one
bit. There are as many tables, and codes to cut them from, as it takes to let at most MISS of the pairs at the
threshold go unmet. A pair is judged in the first table where it meets, by the whole code first and by the exact
cosine of the original vectors then. Equal vectors are one class from the start; buckets of any size are cut
into tiles.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castlens.llm import textops as tx
from castlens.llm.components import components
from castlens.llm.frames import cut, parts

SAMPLE = 20_000              # vectors that the rotations are learned on, those of the smallest id hash
BITS = 64                    # of a code, or the dimension if that is less
LEAST_BITS = 128             # of all chunks together; wider chunks need more
MISS = 0.01                  # part of the pairs at the threshold that may meet in no table
STEPS = 30
SPARE = 1                    # bits of a chunk beyond log2 of the vectors of a label
SLACK = 6.0                  # standard deviations above the mean code distance at the threshold that is let through
TILE = 512
TINY = 1e-140               # largest parts below this, or above its inverse, are scaled before they are squared
PAIRS = 1 << 16
TABLE_BITS = 12              # low bits of a bucket that name its table
PARTNERS = 2000              # vectors of the sample that are given a partner at the threshold


def unit(rows: list) -> list[np.ndarray | None]:
    """Vectors in double precision; None for those that link with nothing (null, empty, zero, null or non-finite parts).

    Vectors whose squares would leave the range of doubles are multiplied by a power of two, which keeps their angles.
    """
    out: list[np.ndarray | None] = []
    for v in rows:
        if v is None or not len(v) or any(x is None for x in v):
            out.append(None)
            continue
        a = np.asarray(v, dtype=np.float64)
        top = float(np.abs(a).max()) if np.isfinite(a).all() else 0.0
        if top > 0 and not TINY < top < 1 / TINY:
            a = np.ldexp(a, -math.frexp(top)[1])
        out.append(a if top > 0 else None)
    return out


def rotation(x: np.ndarray | None, dim: int, code: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection of one code: principal directions turned by iterative quantisation. Without a sample: a random turn."""
    bits = min(BITS, dim)
    start = np.linalg.qr(np.random.default_rng(1000 * dim + code).standard_normal((bits, bits)))[0]
    if x is None or len(x) < 2:
        return np.zeros(dim), np.eye(dim)[:, :bits] @ start
    mean = x.mean(0)
    _, _, axes = np.linalg.svd((x - mean).T @ (x - mean))
    v = (x - mean) @ axes[:bits].T
    turn = start
    for _ in range(STEPS):
        u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
        turn = (u @ w).T
    return mean, axes[:bits].T @ turn


def chance(flip: float, width: int) -> float:
    """That a chunk differs in at most one bit, if each bit does so with probability ``flip``."""
    return (1 - flip) ** width + width * flip * (1 - flip) ** (width - 1)


def partners(x: np.ndarray, threshold: float, axes: np.ndarray | None = None) -> np.ndarray:
    """Unit vectors whose cosine with those of ``x`` is the threshold: towards a random side, or that of a row of ``axes``."""
    r = np.random.default_rng(x.shape[1])
    side = r.standard_normal(x.shape) if axes is None else axes[r.integers(0, len(axes), len(x))] - axes[r.integers(0, len(axes), len(x))]
    side = side - (side * x).sum(1, keepdims=True) * x
    length = np.linalg.norm(side, axis=1)
    x, side = x[length > 1e-9], side[length > 1e-9] / length[length > 1e-9, None]
    return np.stack((x, threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * side))


class Tables:
    """The rotations of each dimension, how many tables there are, and the code distance let through."""

    def __init__(self, width: int, threshold: float):
        self.width, self.flip = width, math.acos(max(-1.0, min(1.0, threshold))) / math.pi
        self.models: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.far: dict[int, float] = {}
        each = chance(self.flip, width)
        self.count = max(1, LEAST_BITS // width, 1 if each >= 1 else math.ceil(math.log(MISS) / math.log1p(-each)))

    @property
    def bits(self) -> int:
        return self.count * self.width

    def most(self, dim: np.ndarray) -> np.ndarray:
        """Greatest distance of codes that is let through, by dimension."""
        some, of = np.unique(dim, return_inverse=True)
        plain = self.bits * self.flip + SLACK * math.sqrt(self.bits * self.flip * (1 - self.flip))
        return np.array([self.far.get(int(d), plain) for d in some])[of]

    def turns(self, dim: int, x: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Enough rotations of a dimension for all tables."""
        have = self.models.setdefault(dim, [])
        while len(have) * min(BITS, dim) < self.bits:
            have.append(rotation(x, dim, len(have)))
        return have

    def codes(self, v: np.ndarray, x: np.ndarray | None = None) -> np.ndarray:
        """(vectors, words) of the codes of vectors of one dimension, in 64-bit words."""
        unit_ = v / np.linalg.norm(v, axis=1, keepdims=True)
        out = np.zeros((len(v), -(-self.bits // 64) * 64), dtype=np.uint8)
        at = 0
        for mean, turn in self.turns(v.shape[1], x):
            n = min(turn.shape[1], self.bits - at)
            if n <= 0:
                break
            out[:, at:at + n] = (unit_ - mean) @ turn[:, :n] >= 0
            at += n
        return np.packbits(out, axis=1, bitorder="little").view(np.uint64)

    def chunk(self, code: np.ndarray, t: int) -> np.ndarray:
        """The bits of each code that index table ``t``."""
        word, shift = divmod(t * self.width, 64)
        v = code[:, word] >> np.uint64(shift)
        if shift + self.width > 64:
            v = v | (code[:, word + 1] << np.uint64(64 - shift))
        return v & np.uint64((1 << self.width) - 1)

    def met(self, apart: np.ndarray) -> np.ndarray:
        """The first table where codes that differ in these bits meet; the number of tables if there is none."""
        first = np.full(len(apart), self.count)
        for t in reversed(range(self.count)):
            first[np.bitwise_count(self.chunk(apart, t)) <= 1] = t
        return first


def learn(vectors: list[np.ndarray], width: int, threshold: float) -> Tables:
    """Tables that miss at most MISS of the pairs at the threshold, measured on a sample with partners made for it.

    Centred angles are wider than the vectors' own where vectors share a mean, so the bits that change are
    counted, not modelled: for partners to a random side, and to the sides on which the sample itself differs.
    """
    tables = Tables(width, threshold)
    pairs = {}
    for dim in sorted({len(v) for v in vectors}):
        x = np.stack([v for v in vectors if len(v) == dim])
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        pairs[dim] = x, [partners(x[:PARTNERS], threshold, axes) for axes in (None, x)] if dim > 1 else []
    for x, kinds in pairs.values():
        for one, other in kinds:
            while len(one) and tables.count < 1 << TABLE_BITS:
                missed = (tables.met(tables.codes(one, x) ^ tables.codes(other, x)) == tables.count).mean()
                if missed <= MISS:
                    break
                tables.count += max(1, tables.count // 8)
    tables.count = min(tables.count, 1 << TABLE_BITS)
    for dim, (x, kinds) in pairs.items():
        tables.turns(dim, x)
        for one, other in kinds:
            if len(one):
                d = np.bitwise_count(tables.codes(one) ^ tables.codes(other)).sum(1, dtype=np.int64)
                plain = math.sqrt(d.mean() * max(0.0, 1 - d.mean() / tables.bits))
                tables.far[dim] = max(tables.far.get(dim, 0.0), d.mean() + SLACK * max(d.std(), plain), float(d.max()))
    return tables


def _classes(batches):
    """(id, label, ok, tk, dim, vector as doubles); tk tells label and vector apart."""
    for batch in batches:
        vecs = unit(batch.column(1).to_pylist())
        labels = batch.column(2).to_pylist()
        ok = [v is not None and lab is not None for v, lab in zip(vecs, labels, strict=True)]
        raw = [v.tobytes() if o else None for v, o in zip(((v + 0.0) if v is not None else None for v in vecs), ok, strict=True)]
        tk = [hashlib.md5(f"{lab}|".encode() + r).digest() if r is not None else None for r, lab in zip(raw, labels, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([None if x is None else str(x) for x in labels], pa.string()), pa.array(ok), pa.array(tk, pa.binary()),
             pa.array([len(v) if o else None for v, o in zip(vecs, ok, strict=True)], pa.int32()), pa.array(raw, pa.binary())],
            names=["id", "label", "ok", "tk", "dim", "vec"])


def _index(tables: Tables):
    """Rows (bucket, probe, tk, n, code): a vector's own chunk in each table, and the chunks one bit away."""
    def run(batches):
        for batch in batches:
            dims = batch.column(1).to_numpy()
            label = np.array([label_hash(x) for x in batch.column(2).to_pylist()], dtype=np.uint64)
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                v = np.stack([np.frombuffer(batch.column(3)[int(i)].as_py(), np.float64) for i in mine])
                code = tables.codes(v)
                salt = tx.mix(label[mine] + np.uint64(dim), 11)
                who = np.tile(mine, tables.width + 1)
                tk, n = batch.column(0).take(pa.array(who)), batch.column(4).take(pa.array(who))
                packed = tx.pack(np.tile(code, (tables.width + 1, 1)).ravel(), np.arange(len(who) + 1) * code.shape[1])
                probe, size = pa.array(np.arange(len(who)) >= len(mine)), pa.array(dims[who].astype(np.int32))
                for t in range(tables.count):
                    own = tables.chunk(code, t)
                    value = np.concatenate([own, *(own ^ np.uint64(1 << flip) for flip in range(tables.width))])
                    h = tx.mix(np.tile(salt, tables.width + 1) + value, t + 1)
                    bucket = (h & ~np.uint64((1 << TABLE_BITS) - 1)) | np.uint64(t)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), probe, tk, n, packed, size],
                                                     names=["bucket", "probe", "tk", "n", "code", "dim"])
    return run


def label_hash(label: str) -> int:
    return int.from_bytes(hashlib.md5(label.encode()).digest()[:8], "little")


TILE_KEYS = ["bucket", "i", "j"]


def _meetings(start, i, j, chunk, probe):
    """Pairs of rows of each group: an own chunk with any later row (in order of tk) of the tiles that meet."""
    left, right, n = [], [], 0
    for a, b in zip(start[:-1], start[1:], strict=True):
        own, rows = a + np.flatnonzero(~probe[a:b]), np.arange(a, b)
        step = max(1, PAIRS // (b - a))
        for k in range(0, len(own), step):
            some = own[k:k + step]
            x, y = np.repeat(some, len(rows)), np.tile(rows, len(some))
            good = (x != y) & ((x < y) | probe[y])         # own-own once; own-probe below
            if i[a] != j[a]:
                good &= chunk[x] != chunk[y]
            x, y = x[good], y[good]
            left.append(x), right.append(y)
            n += len(x)
            if n >= PAIRS:
                yield np.concatenate(left), np.concatenate(right)
                left, right, n = [], [], 0
    if n:
        yield np.concatenate(left), np.concatenate(right)


def _likely(t: pa.Table, x, y, tables: Tables):
    """Meetings judged here: of two vectors that meet in no earlier table, with codes close enough."""
    code = tx.fixed(t.column("code"), np.uint64)[0].reshape(t.num_rows, -1)
    table = t.column("bucket").to_numpy() & ((1 << TABLE_BITS) - 1)
    probe = t.column("probe").to_numpy()
    order = t.column("order").to_numpy()
    dim = t.column("dim").to_numpy()
    good = (dim[x] == dim[y]) & (~probe[y] | (order[x] < order[y]))     # one bit apart: where the lesser stands itself
    x, y = x[good], y[good]
    apart = code[x] ^ code[y]
    good = np.bitwise_count(apart).sum(1, dtype=np.int64) <= tables.most(dim[x]) if len(x) else np.zeros(0, bool)
    x, y, apart = x[good], y[good], apart[good]
    good = tables.met(apart) == table[x]
    return x[good], y[good]


def _columns(t: pa.Table):
    return [t.column(c).to_numpy() for c in ("i", "j", "chunk", "probe")]


def _prune(tables: Tables):
    def run(batches):
        for t, start in tx.whole_groups(batches, TILE_KEYS):
            live = np.zeros(t.num_rows, dtype=bool)
            for x, y in _meetings(start, *_columns(t)):
                x, y = _likely(t, x, y, tables)
                live[x] = live[y] = True
            if live.any():
                yield from t.filter(pa.array(live)).combine_chunks().to_batches()
    return run


def _verify(tables: Tables, threshold: float):
    def run(batches):
        for t, start in tx.whole_groups(batches, TILE_KEYS, 500):
            values, before = tx.fixed(t.column("vec"), np.float64)
            n = t.column("n").to_numpy()
            links, ends = np.zeros(t.num_rows, dtype=np.int64), []
            for x, y in _meetings(start, *_columns(t)):
                x, y = _likely(t, x, y, tables)
                for d in np.unique(np.diff(before)[x]):
                    same = np.diff(before)[x] == d
                    p, q = x[same], y[same]
                    a, b = values[before[p][:, None] + np.arange(d)], values[before[q][:, None] + np.arange(d)]
                    cosine = np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
                    p, q = p[cosine >= threshold], q[cosine >= threshold]
                    np.add.at(links, p, n[q])
                    np.add.at(links, q, n[p])
                    ends.append((p, q))
            if links.any():
                root = tx.roots(t.num_rows, np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends]))
                some = np.flatnonzero(links)
                tk = pa.concat_arrays(t.column("tk").chunks)
                yield pa.RecordBatch.from_arrays([tk.take(pa.array(some)), pa.array(links[some]), tk.take(pa.array(root[some]))],
                                                 names=["tk", "links", "root"])
    return run


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    threshold: float = 0.93) -> DataFrame:
    """One row per row of ``vectors``: its id, n_links, component_id and kept.

    Rows of equal, not null labels are linked if the cosine of their vectors is ``threshold`` or more, in double
    precision; n_links counts the other rows linked to a row (equal vectors among them), component_id is the
    least id that links reach. Rows whose vector is null, empty, zero or has a null or non-finite part, or whose
    label is null, are linked to nothing. Vectors of different length never meet. Null ids come last. Every row
    is indexed; what the tables miss is measured in the tests. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    n = parts(vectors)
    id_type = vectors.schema[id_col].dataType.simpleString()
    slim = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    rows = slim.mapInArrow(_classes, f"id {id_type}, label string, ok boolean, tk binary, dim int, vec binary")
    classes = cut(rows.where("ok").groupBy("tk").agg(
        F.min("id").alias("low"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("dim").alias("dim"),
        F.first("vec").alias("vec")), "vectors")
    sample = classes.orderBy(F.xxhash64("tk"), "tk").limit(SAMPLE).select("vec").toArrow().column("vec").to_pylist()
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    tables = learn([np.frombuffer(x, np.float64) for x in sample], max(8, math.ceil(math.log2(largest)) + SPARE), threshold)
    index = classes.select("tk", "dim", "label", "vec", "n").mapInArrow(
        _index(tables), "bucket long, probe boolean, tk binary, n long, code binary, dim int")
    index = cut(index, "index")
    sizes = index.groupBy("bucket").agg(F.count("*").alias("c"), F.sum(F.when(F.col("probe"), 0).otherwise(1)).alias("own")).where("c > 1 and own > 0")
    met = (index.join(sizes, "bucket").withColumn("g", F.ceil(F.col("c") / TILE).cast("int"))
           .withColumn("chunk", F.pmod(F.xxhash64("tk"), F.col("g")).cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
           .select("bucket", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "probe", "tk",
                   F.conv(F.hex(F.substring("tk", 1, 7)), 16, 10).cast("long").alias("order"), "n", "code", "dim"))
    schema = "bucket long, i int, j int, chunk int, probe boolean, tk binary, order long, n long, code binary, dim int"
    likely = cut(met.repartition(n, *TILE_KEYS).sortWithinPartitions(*TILE_KEYS, "tk").mapInArrow(_prune(tables), schema), "likely")
    full = likely.join(classes.select("tk", "vec"), "tk").select(*likely.columns, "vec")
    found = cut(full.repartition(n, *TILE_KEYS).sortWithinPartitions(*TILE_KEYS, "tk").mapInArrow(
        _verify(tables, threshold), "tk binary, links long, root binary"), "found")
    root = components(found.select(F.col("tk").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("tk"), "root")
    links = found.groupBy("tk").agg(F.sum("links").alias("links"))
    known = (classes.select("tk", "low", "n").join(links, "tk", "left").join(root, "tk", "left").withColumn("root", F.coalesce("root", "tk")))
    least = known.groupBy("root").agg(F.min("low").alias("component_id"))
    known = known.join(least, "root").select("tk", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.select("id", "tk").join(known, "tk", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
