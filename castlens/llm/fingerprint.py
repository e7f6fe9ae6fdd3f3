"""Document fingerprints: MinHash signatures of word shingles, made with universal hash permutations in numpy.

``fingerprint`` gives each text its signature as hex digits, ``likeness`` the share of equal values.
``chain`` sets each document beside the next one in descending id order and fingerprints it, the next and the
edited text made of both: documents are dealt to id ranges, the first of each range also to the range before,
and each range is read in order, so every text moves once. ``classes`` joins signature bands in Spark, judges all
pairs of a band in tiles inside tasks and verifies their Jaccard similarity on the exact shingle sets; from a tile
come counts, a spanning forest and each text's nearest, never pairs. ``fingerprints`` puts both together.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castlens.llm import textops as tx
from castlens.llm.components import components
from castlens.llm.frames import among, cut, parts, release, small_batches
from castlens.llm.ngramjoin import TILE, TILE_KEYS, TOLERANCE, _likely, _pairs, _sets, exact, least_matches

HASHES = 128
BANDS = 32
SHINGLE = 5
SEED = 0x2545F4914F6CDD1D
RUN = 1 << 21


def signatures(texts: list[str] | pa.Array, k: int = SHINGLE) -> np.ndarray:
    """(texts, HASHES) of 16-bit MinHash values; a text without words has the greatest value everywhere."""
    data, off = tx.utf8(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
    a, b = tx.permutations(HASHES, SEED)
    out = np.zeros((len(off) - 1, HASHES), dtype=np.uint16)
    for i, j, part, at in tx.runs(data, off):
        ws, we, first = tx.words(part, at)
        out[i:j] = tx.minhash(*tx.shingles(tx.hash_spans(part, ws, we), first, k), a, b) & np.uint32(0xFFFF)
    return out


def _hex(sig: np.ndarray) -> list[str]:
    raw = sig.astype(">u2").tobytes().hex()
    size = HASHES * 4
    return [raw[i:i + size] for i in range(0, len(raw), size)]


def fingerprint(docs: DataFrame, *, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``docs`` with ``out_col``: the signature in hex. Null texts count as empty; equal texts have equal fingerprints."""
    return docs.withColumn(out_col, F.arrow_udf(lambda t: pa.array(_hex(signatures(t)), pa.string()), "string")(F.col(text_col)))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(1)


COLUMNS = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


DEALT = "part int, last boolean, id long, tk string, text string, n_links long, class_id long"


def _deal(bounds: np.ndarray, heads: dict, back: dict):
    """Rows as DEALT, without links; the first row of a range comes once more, as last of the range before."""
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            known = np.array(ids.is_valid())
            value = np.array(ids.fill_null(0), dtype=np.int64)
            at = np.where(known, np.searchsorted(-bounds, -value, side="left"), len(bounds)).astype(np.int32)
            names = ["part", "last", "id", "tk", "text", "n_links", "class_id"]
            none = [pa.nulls(len(at), pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.zeros(len(at), bool)), *batch.columns, *none], names=names)
            tks = batch.column(1)
            maybe = np.isin(value, [h[0] or 0 for h in heads.values()])
            for i in np.flatnonzero(maybe):
                if heads.get(int(at[i])) == (ids[i].as_py(), tks[i].as_py()):
                    one = batch.slice(int(i), 1)
                    yield pa.RecordBatch.from_arrays([pa.array([back[int(at[i])]], pa.int32()), pa.array([True]), *one.columns, *[pa.nulls(1, pa.int64())] * 2], names=names)
    return run


def _linked(batches):
    """The texts of a stream of DEALT with the links of their notes, rows (n_links, class_id) that stand before the texts of
    their id and md5, and without the notes."""
    note = None                       # part, id, tk, n_links, class_id
    for batch in batches:
        part, _, ids, tks, _, links, least = batch.columns
        is_note = np.array(links.is_valid())
        if is_note.any() or note:
            n, c = [], []
            for row in zip(part.to_pylist(), ids.to_pylist(), tks.to_pylist(), links.to_pylist(), least.to_pylist(), strict=True):
                note = row if row[3] is not None else note
                met = note is not None and note[:3] == row[:3]
                n.append(note[3] if met else None)
                c.append(note[4] if met else None)
            batch = pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(n, pa.int64()), pa.array(c, pa.int64())],
                                               names=batch.schema.names).filter(pa.array(~is_note))
        if batch.num_rows:
            yield batch


def _read(batches):
    """Each row with the one after it in its range."""
    held = None                       # part, last, id, text, signature, tk, links of the row before
    for batch in _linked(batches):
        data, off = tx.utf8(batch.column(4))
        cols = [batch.column(i) for i in range(3)]
        for i, j, _, _ in tx.runs(data, off, RUN):
            texts = [x or "" for x in batch.column(4).slice(i, j - i).to_pylist()]
            sig = signatures(texts)
            part, last = cols[0].slice(i, j - i).to_pylist(), cols[1].slice(i, j - i).to_pylist()
            ids = cols[2].slice(i, j - i).to_pylist()
            tks = batch.column(3).slice(i, j - i).to_pylist()
            links = list(zip(*(batch.column(c).slice(i, j - i).to_pylist() for c in (5, 6)), strict=True))
            if held:
                tks, links = [held[5], *tks], [held[6], *links]
                part, last, ids, texts = [held[0], *part], [held[1], *last], [held[2], *ids], [held[3], *texts]
                sig = np.concatenate((held[4], sig))
            # a first row may come to the range before more than once (repeated rows): only the first is read
            here = [x for x in range(len(ids) - 1) if not last[x] and part[x] == part[x + 1]]
            held = part[-1], last[-1], ids[-1], texts[-1], sig[-1:], tks[-1], links[-1]
            if not here:
                continue
            size = [len(texts[x]) for x in here]
            third = [n // 3 for n in size]
            edited = [texts[x][:n - m] + texts[x + 1][:m] for x, n, m in zip(here, size, third, strict=True)]
            esig = signatures(edited)
            own, after = sig[here], sig[[x + 1 for x in here]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[x] for x in here], cols[2].type), pa.array([tks[x] for x in here], pa.string()), pa.array(size, pa.int64()),
                 pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]), pa.array(_hex(own)), pa.array(_hex(esig)),
                 pa.array(likeness(own, esig)), pa.array(likeness(own, after)),
                 *(pa.array([links[x][c] for x in here], pa.int64()) for c in (0, 1))], names=["id", "tk", *COLUMNS, "n_links", "class_id"])


def chain(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """See ``_chain``; without the md5 of the text."""
    return _chain(docs, id_col, text_col).drop("tk", "n_links", "class_id").withColumnRenamed("id", id_col)


def _chain(docs: DataFrame, id_col: str, text_col: str, linked: DataFrame | None = None) -> DataFrame:
    """One row per document: its integer id, md5 of its text, code points, and fingerprints beside the next document's.

    The next document is that of the next lower id (rows of one id: the greater md5 of the text first; null ids
    come last), and the first again after the last; a table of one row is its own next. The edited text has
    the last third of the code points (rounded down) replaced by the first as many of the next text, or by
    all of it if it is shorter. Null texts count as empty; an empty table gives an empty table.

    ``linked`` (tk, n_links, class_id), one row a text at most, goes to the ranges as a note for each id and text, so the
    fingerprints are not moved to meet it; both columns are null for a text that is not in it.
    """
    n = parts(docs)
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("tk"),
                       F.col(text_col).alias("text"))
    cuts = [(i + 1) / n for i in range(n - 1)]
    bounds = (slim.agg(F.percentile_approx("id", F.lit(cuts), F.lit(20 * n)).alias("q")).first()["q"] or []) if cuts else []
    bounds = np.array(sorted(set(bounds), reverse=True), dtype=np.int64)      # a row goes to the range of the bounds above its id

    def range_of(ids: pa.Array) -> pa.Array:
        value = np.array(ids.fill_null(0), dtype=np.int64)
        return pa.array(np.where(np.array(ids.is_valid()), np.searchsorted(-bounds, -value, side="left"), len(bounds)).astype(np.int32))
    tops = (slim.select("id", "tk").withColumn("part", F.arrow_udf(range_of, "int")(F.col("id"))).groupBy("part")
            .agg(F.max(F.struct(F.col("id").isNotNull().alias("has"), "id", "tk")).alias("top")).collect())   # one row per range
    heads = {r.part: (r.top["id"], r.top["tk"]) for r in tops}
    order = sorted(heads)
    back = {p: order[i - 1] for i, p in enumerate(order)}
    rows = slim.mapInArrow(_deal(bounds, heads, back), DEALT)
    if linked is not None:
        notes = slim.select("id", "tk").distinct().join(linked, "tk").withColumn("part", F.arrow_udf(range_of, "int")(F.col("id")))
        rows = rows.unionByName(notes.select("part", F.lit(False).alias("last"), "id", "tk", F.lit(None).cast("string").alias("text"), "n_links", "class_id"))
    rows = rows.repartition(n, "part").sortWithinPartitions("part", "last", F.desc_nulls_last("id"), F.desc("tk"), F.desc_nulls_last("n_links"))
    return rows.mapInArrow(_read, "id long, tk string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                                  "near_edited double, near_next double, n_links long, class_id long")


def _marks(batches):
    """(tk, id, sig) of texts with words."""
    for batch in batches:
        sig = signatures(batch.column(2))
        has = np.flatnonzero((sig != 0xFFFF).any(1))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(has)), batch.column(1).take(pa.array(has)),
                                          tx.pack(sig[has].ravel(), np.arange(len(has) + 1) * HASHES)], names=["tk", "id", "sig"])


def _bands(batches):
    """(bucket, tk): the low bits of a bucket name its band."""
    for batch in batches:
        sig = tx.fixed(batch.column(1), np.uint16)[0].astype(np.uint64).reshape(-1, BANDS, HASHES // BANDS)
        key = np.zeros(sig.shape[:2], dtype=np.uint64)
        for r in range(sig.shape[2]):
            key = tx.mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r] + np.uint64(1))
        key = (key & ~np.uint64(BANDS - 1)) | np.arange(BANDS, dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), batch.column(0).take(pa.array(np.repeat(np.arange(len(sig)), BANDS)))],
                                         names=["bucket", "tk"])


def _met(t: pa.Table, start: np.ndarray, least: list):
    """Pairs of a band's tiles that are like enough and meet in no earlier band."""
    sig = tx.fixed(t.column("sig"), np.uint16)[0].reshape(-1, HASHES)
    band = t.column("bucket").to_numpy() & (BANDS - 1)
    for x, y in _pairs(start, *(t.column(c).to_numpy() for c in ("i", "j", "chunk"))):
        yield _likely(sig, band, x, y, least)


def _prune(least: list):
    def run(batches):
        for t, start in tx.whole_groups(batches, TILE_KEYS):
            live = np.zeros(t.num_rows, dtype=bool)
            for x, y in _met(t, start, least):
                live[x] = live[y] = True
            if live.any():
                yield from t.filter(pa.array(live)).combine_chunks().to_batches()
    return run


def _judge(least: list, threshold: float, nearest: bool):
    """Of each text of a tile with a link: rows linked to it there, its root and, if asked for, its nearest text and their similarity."""
    def run(batches):
        for t, start in tx.whole_groups(batches, TILE_KEYS, 500):
            values, before = tx.fixed(t.column("shingles"), np.uint64)
            size, n = np.diff(before), t.column("n").to_numpy()
            links, best, near = np.zeros(t.num_rows, np.int64), np.zeros(t.num_rows), np.zeros(t.num_rows, np.int64)
            ends = []
            for x, y in _met(t, start, least):
                ok = exact(values, before, x, y, threshold)
                x, y = x[ok], y[ok]
                np.add.at(links, x, n[y])
                np.add.at(links, y, n[x])
                ends.append((x, y))
                for a, b in zip(x.tolist(), y.tolist(), strict=True) if nearest else ():
                    most = min(size[a], size[b]) / max(size[a], size[b])
                    if most <= best[a] and most <= best[b]:
                        continue
                    common = len(np.intersect1d(values[before[a]:before[a + 1]], values[before[b]:before[b + 1]], assume_unique=True))
                    j = common / (size[a] + size[b] - common)
                    for p, q in ((a, b), (b, a)):
                        if j > best[p]:
                            best[p], near[p] = j, q
            if links.any():
                root = tx.roots(t.num_rows, np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends]))
                some = np.flatnonzero(links)
                tk = t.column("tk").combine_chunks()
                tk = tk if isinstance(tk, pa.Array) else pa.concat_arrays(tk.chunks)
                yield pa.RecordBatch.from_arrays(
                    [tk.take(pa.array(some)), pa.array(links[some]), tk.take(pa.array(root[some])), tk.take(pa.array(near[some])),
                     pa.array(best[some])], names=["tk", "links", "root", "near", "jaccard"])
    return run


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8,
            nearest: bool = False) -> DataFrame:
    """One row per distinct text with a word: tk (its md5, binary), n_links, class_id, near and jaccard.

    Texts are linked when the Jaccard similarity of their shingle sets is ``threshold`` or more: of all pairs that
    share a band, those that the signatures do not rule out are verified on the sets. n_links counts the other rows
    linked to each row of the text, copies included; class_id is the least id that links reach (null ids last).
    near is the most similar other text that is linked, null if there is none or without ``nearest``.
    """
    n = parts(docs)
    small_batches(docs.sparkSession)
    slim = docs.select(F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("tk"),
                       F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = cut(slim.mapInArrow(_marks, "tk binary, id long, sig binary").groupBy("tk").agg(
        F.count("*").alias("n"), F.first("sig").alias("sig"), F.min(F.struct(F.col("id").isNull().alias("no"), "id")).alias("top")), "marks")
    bands = texts.select("tk", "sig").mapInArrow(_bands, "bucket long, tk binary")
    shared = bands.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
    least = least_matches(threshold, TOLERANCE)
    rows = (bands.join(shared, "bucket").withColumn("g", F.ceil(F.col("c") / TILE).cast("int"))
            .withColumn("chunk", F.pmod(F.xxhash64("tk"), F.col("g")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
            .select("bucket", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "tk"))
    rows = rows.join(texts.select("tk", "n", "sig"), "tk").select("bucket", "i", "j", "chunk", "tk", "n", "sig")
    likely = cut(rows.repartition(n, *TILE_KEYS).sortWithinPartitions(*TILE_KEYS).mapInArrow(
        _prune(least), "bucket long, i int, j int, chunk int, tk binary, n long, sig binary"), "near")
    wanted = likely.select("tk").distinct().join(texts.select("tk", F.col("top.id").alias("wid")), "tk").withColumnRenamed("tk", "wtk")
    release(docs.sparkSession)
    sets = (among(slim, likely).join(wanted, (F.col("tk") == F.col("wtk")) & F.col("id").eqNullSafe(F.col("wid")))
            .groupBy("tk", "id").agg(F.first("text").alias("text")).select("tk", "text").mapInArrow(_sets(SHINGLE), "tk binary, shingles binary"))
    found = cut(likely.join(sets, "tk").repartition(n, *TILE_KEYS).sortWithinPartitions(*TILE_KEYS)
                .select(*TILE_KEYS, "chunk", "tk", "n", "sig", "shingles")
                .mapInArrow(_judge(least, threshold, nearest), "tk binary, links long, root binary, near binary, jaccard double"), "judged")
    release(docs.sparkSession)
    root = components(found.select(F.col("tk").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("tk"), "root")
    links = found.groupBy("tk").agg(F.sum("links").alias("links"), F.max(F.when(F.col("jaccard") > 0, F.struct("jaccard", "near"))).alias("best"))
    out = (texts.select("tk", "n", "top").join(links, "tk", "left").join(root, "tk", "left").withColumn("root", F.coalesce("root", "tk")))
    tops = out.groupBy("root").agg(F.min("top").alias("low"))
    return out.join(tops, "root").select("tk", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                                         F.col("low.id").alias("class_id"), F.col("best.near").alias("near"), F.col("best.jaccard").alias("jaccard"))


def near_duplicates(docs: DataFrame, *, text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """(tk, near, jaccard): md5 of each text that is linked to another, and of its most similar one. See ``classes``."""
    got = classes(docs.select(F.lit(0).cast("long").alias("id"), F.col(text_col).alias("text")), id_col="id", text_col="text", threshold=threshold, nearest=True)
    return got.where("near IS NOT NULL").select(F.lower(F.hex("tk")).alias("tk"), F.lower(F.hex("near")).alias("near"), "jaccard")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``chain`` with n_links and class_id of ``classes``: its own id for a row that is linked to nothing."""
    linked = cut(classes(docs, id_col=id_col, text_col=text_col).where("n_links > 0")
                 .select(F.lower(F.hex("tk")).alias("tk"), F.col("n_links").cast("long").alias("n_links"), "class_id"), "linked")
    release(docs.sparkSession)
    out = _chain(docs, id_col, text_col, linked)
    return out.select(F.col("id").alias(id_col), *COLUMNS, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"))
