"""Fill-in-middle transformation over seekable compressed frames.

``pack`` stores each text as independent zstandard frames of about FRAME bytes with the number of units and of code
points before each frame; a unit is a run of ASCII letters or any other single code point. ``transform`` finds the
frame of a cut by its unit count, decompresses that frame alone, cuts it, and lays the frames out in the order of the
output: uncut frames go over as they are, compressed. Frames in a row are a valid zstandard stream, so an output can be
read by any zstandard reader. ``restore`` finds the markers in an output and gives the text's frames again, and ``digest``
reads frames one by one, so a very long text is never whole in memory beyond its compressed form.

A text and its frames stay on one row: no step shuffles, and a lost executor costs its tasks alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castlens.llm import textops as tx
from castlens.llm.frames import fresh, small_batches

FRAME = 1 << 16              # bytes of text in a frame
LEVEL = 1                    # of compression
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

STORE = ("struct<frames:array<binary>,bytes:array<bigint>,units:array<bigint>,chars:array<bigint>,inside:array<boolean>,"
         "marked:boolean>")
OUTPUT = "struct<prefix_chars:bigint,middle_chars:bigint,frames:array<binary>>"
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True


def unit_starts(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes begin a unit, and which begin a code point; a unit ends where a text does (``first``: its offsets)."""
    letter, point = LETTER[data], (data & 0xC0) != 0x80
    start = point.copy()
    start[1:] &= ~(letter[1:] & letter[:-1])
    edge = first[:-1][first[:-1] < len(data)]
    start[edge] = point[edge]
    return start, point


def _pack(texts: pa.Array) -> pa.Array:
    data, off = tx.utf8(texts)
    zip_ = zstandard.ZstdCompressor(level=LEVEL).compress
    out = []
    for i, j, part, at in tx.runs(data, off):
        for d in range(i, j):
            a, b = int(at[d - i]), int(at[d - i + 1])
            frames, size, units, chars, inside = [], [], [0], [0], []
            tail, marked = b"", False
            for s in range(a, b, FRAME):
                piece = part[s:min(b, s + FRAME)]
                raw = piece.tobytes()
                near = tail[-2:] + raw                       # a marker may lie across two frames
                marked = marked or any(m in near for m in (PREFIX, SUFFIX, MIDDLE))
                start, point = unit_starts(piece, np.array([0, len(piece)]))
                inside.append(bool(tail and LETTER[tail[-1]] and start[0] and LETTER[piece[0]]))
                units.append(units[-1] + int(start.sum()) - inside[-1])
                chars.append(chars[-1] + int(point.sum()))
                size.append(len(raw))
                frames.append(zip_(raw))
                tail = raw
            out.append((frames, size, units, chars, inside, marked))
    cols = list(zip(*out, strict=True)) if out else [[]] * 6
    kinds = [pa.list_(pa.binary()), *[pa.list_(pa.int64())] * 3, pa.list_(pa.bool_()), pa.bool_()]
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                      names=["frames", "bytes", "units", "chars", "inside", "marked"])


def pack(docs: DataFrame, *, text_col: str = "text", out_col: str = "store") -> DataFrame:
    """``docs`` with ``out_col`` in place of ``text_col``: frames, their sizes in bytes, units and code points before each
    frame and in all (one number more than frames), whether a frame goes on inside the unit before it, and whether
    the text holds a marker. Null texts count as empty and have no frames."""
    small_batches(docs.sparkSession)
    return docs.withColumn(out_col, F.arrow_udf(_pack, STORE)(F.col(text_col))).drop(*([text_col] if text_col != out_col else []))


def unpack(frames: list[bytes]):
    """The decompressed frames, one at a time."""
    unzip = zstandard.ZstdDecompressor().decompress
    for frame in frames:
        yield unzip(frame)


def _seek(one: dict, unit: int) -> tuple[int, int, int]:
    """(frame, byte in it, code points before) of the begin of a unit; the end of the text for the number of units."""
    n = len(one["frames"])
    if unit >= one["units"][n]:
        return n, 0, one["chars"][n]
    k = int(np.searchsorted(np.array(one["units"]), unit, side="right")) - 1
    piece = np.frombuffer(next(unpack([one["frames"][k]])), dtype=np.uint8)
    start, point = unit_starts(piece, np.array([0, len(piece)]))
    if one["inside"][k]:
        start[0] = False
    at = int(np.flatnonzero(start)[unit - one["units"][k]])
    return k, at, one["chars"][k] + int(point[:at].sum())


def _between(one: dict, a: tuple[int, int], b: tuple[int, int], zip_) -> list[bytes]:
    """The frames of the text from place a to place b: whole ones as they are, cut ones compressed anew."""
    out = []
    for k in range(a[0], min(b[0] + 1, len(one["frames"]))):
        low, high = a[1] if k == a[0] else 0, b[1] if k == b[0] else one["bytes"][k]
        if low == 0 and high == one["bytes"][k]:
            out.append(one["frames"][k])
        elif low < high:
            out.append(zip_(next(unpack([one["frames"][k]]))[low:high]))
    return out


def _transform(stores: pa.Array, first: pa.Array, second: pa.Array, form: pa.Array) -> pa.Array:
    zip_ = zstandard.ZstdCompressor(level=LEVEL).compress
    p, s, m = (zip_(x) for x in (PREFIX, SUFFIX, MIDDLE))
    out = []
    for one, u, v, kind in zip(stores.to_pylist(), first.to_pylist(), second.to_pylist(), form.to_pylist(), strict=True):
        if kind == "plain":
            out.append((None, None, one["frames"]))
            continue
        *a, before = _seek(one, u)
        *b, until = _seek(one, v)
        end = (len(one["frames"]), 0)
        prefix, middle, suffix = (_between(one, tuple(x), tuple(y), zip_) for x, y in (((0, 0), a), (a, b), (b, end)))
        frames = [p, *prefix, s, *suffix, m, *middle] if kind == "psm" else [s, *suffix, p, *prefix, m, *middle]
        out.append((before, until - before, frames))
    cols = list(zip(*out, strict=True)) if out else [[]] * 3
    return pa.StructArray.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.binary()))],
                                      names=["prefix_chars", "middle_chars", "frames"])


def choices(ident: Column, store: Column, *, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> list[Column]:
    """First cut, second cut (in units) and form of a document, from the sha256 of ``<seed>:<ident>``; a null
    ident counts as empty text. Texts that are empty or hold a marker are plain."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))).cast("binary"), 256)
    part = [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    n = F.element_at(store["units"], -1)
    cuts = [part[0] % (n + 1), part[1] % (n + 1)]
    form = (F.when((n == 0) | store["marked"] | (part[2] % 100 >= 100 - plain_percent), "plain")
            .when(part[3] % 100 < spm_percent, "spm").otherwise("psm"))
    return [F.least(*cuts), F.greatest(*cuts), form]


def transform(packed: DataFrame, *, id_col: str = "doc_id", store_col: str = "store", out_col: str = "fim", seed: int = 1) -> DataFrame:
    """Rows of ``pack`` with n (units of the text), form and ``out_col``: code points of prefix and middle (null if
    plain) and the output's frames. Columns of these names are replaced. Each row is decided by its own id and text,
    so rows that repeat get the same output; a table without rows gives one without rows."""
    u, v, kind = (fresh(packed, x) for x in ("u", "v", "kind"))
    store = F.col(store_col)
    first, second, form = choices(F.col(id_col), store, seed=seed)
    cut = packed.withColumns({u: first, v: second, kind: form})
    fim = F.arrow_udf(_transform, OUTPUT)(store, F.col(u), F.col(v), F.col(kind))
    return (cut.withColumn(out_col, fim).withColumns({"n": F.element_at(store["units"], -1), "form": F.col(kind)}).drop(u, v, kind))


def places(frames: list[bytes], marks: list[bytes]) -> tuple[list[int], int]:
    """Byte at which each of ``marks``, in this order, first stands after the one before; and the length of the output."""
    at, tail, base = [], b"", 0
    for raw in unpack(frames):
        near = tail + raw
        low = max(0, at[-1] + len(marks[len(at) - 1]) - base) if at else 0
        while len(at) < len(marks) and (found := near.find(marks[len(at)], low)) >= 0:
            at.append(base + found)
            low = found + len(marks[len(at) - 1])
        tail, base = near[-2:], base + len(near) - len(near[-2:])
    return at, base + len(tail)


def slices(frames: list[bytes], a: int, b: int):
    """Bytes a to b of an output, frame by frame."""
    at = 0
    for raw in unpack(frames):
        if at < b and at + len(raw) > a:
            yield raw[max(0, a - at):b - at]
        at += len(raw)


def original(frames: list[bytes], form: str):
    """The text of an output, piece by piece, from its frames and its form alone."""
    if form == "plain":
        yield from unpack(frames)
        return
    order = [PREFIX, SUFFIX, MIDDLE] if form == "psm" else [SUFFIX, PREFIX, MIDDLE]
    at, end = places(frames, order)
    stop = [*at[1:], end]
    piece = {m: (a + len(m), b) for m, a, b in zip(order, at, stop, strict=True)}
    for m in (PREFIX, MIDDLE, SUFFIX):
        yield from slices(frames, *piece[m])


def _sha(pieces) -> str:
    h = hashlib.sha256()
    for x in pieces:
        h.update(x)
    return h.hexdigest()


def digest(frames: Column) -> Column:
    """Lowercase hex sha256 of what the frames hold, read one at a time."""
    return F.arrow_udf(lambda f: pa.array([_sha(unpack(x)) for x in f.to_pylist()], pa.string()), "string")(frames)


def restored_digest(frames: Column, form: Column) -> Column:
    """The same of the text that ``restore`` gives."""
    return F.arrow_udf(lambda f, k: pa.array([_sha(original(x, y)) for x, y in zip(f.to_pylist(), k.to_pylist(), strict=True)], pa.string()),
                       "string")(frames, form)


def text_of(frames: Column) -> Column:
    """What the frames hold, as text."""
    return F.arrow_udf(lambda f: pa.array([b"".join(unpack(x)).decode() for x in f.to_pylist()], pa.string()), "string")(frames)


def restore(frames: Column, form: Column) -> Column:
    """The text rebuilt from an output's frames and form."""
    return F.arrow_udf(lambda f, k: pa.array([b"".join(original(x, y)).decode() for x, y in zip(f.to_pylist(), k.to_pylist(), strict=True)],
                                             pa.string()), "string")(frames, form)


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of each row of ``docs``."""
    done = transform(pack(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))), id_col="id", seed=seed)
    return done.select(F.col("id").alias(id_col), "n", "form", F.col("fim.prefix_chars").alias("prefix_chars"),
                       F.col("fim.middle_chars").alias("middle_chars"), digest(F.col("fim.frames")).alias("output_sha256"),
                       restored_digest(F.col("fim.frames"), F.col("form")).alias("restored_sha256"))
