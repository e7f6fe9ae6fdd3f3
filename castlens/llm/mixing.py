"""Temperature mixing: source weights are token shares to a power, realised as budgeted block permutations.

The power is searched so that the weights reach a target entropy or keep every source within a repetition
limit. A source's documents are then read in passes, each pass in a new pseudo-random order, until the
source's part of the token budget is spent; the result is cut into blocks that each hold the weights.
Running token counts come from sums of slices of the hash order, so a source of any size is spread out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from castlens.llm.frames import cut, fresh

WORD = r"[^\x20\x09-\x0D]+"
GRID = 32                  # exponents that one job tries
DIGITS = 9                 # decimals of the exponent
BLOCK_TOKENS = 1_000_000
SEED = "mix-1"


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _search(shares: DataFrame, holds) -> float:
    """The least exponent in [0, 1] from which ``holds(exponent, z, e)`` is true; 1 if it never is.

    z is the sum of share^x and e that of share^x * ln(share). Each job narrows the interval GRID-fold;
    only sums reach the driver, however many sources there are.
    """
    lo, hi = 0.0, 1.0
    while True:
        xs = [lo + (hi - lo) * i / GRID for i in range(GRID + 1)]
        sums = shares.agg(*[f for i, x in enumerate(xs) for f in (
            F.sum(F.pow("share", F.lit(x))).alias(f"z{i}"), F.sum(F.pow("share", F.lit(x)) * F.log("share")).alias(f"e{i}"))]).first()
        true = [i for i, x in enumerate(xs) if holds(x, sums[f"z{i}"], sums[f"e{i}"])]
        if not true:
            return 1.0
        i = min(true)
        if i == 0 or hi - lo < 10.0 ** -(DIGITS + 4):
            return xs[i]
        lo, hi = xs[i - 1], xs[i]


def mixture(sources: DataFrame, *, entropy: float | None, max_repeats: float, budget: int | None) -> DataFrame:
    """(source, tokens) -> source, tokens, weight, goal: weights and token goals of the sources.

    ``entropy`` is the target as a part of the greatest possible, ln(number of sources); None asks for the
    flattest weights that the repetition limit allows. ``max_repeats`` bounds goal / tokens. A ``budget`` of
    None stands for the least one at which every source is read at least once. Sources without tokens get
    no weight; where the target needs sharper weights than the shares themselves, the shares stay.
    """
    some = sources.where("tokens > 0")
    total, count, low, high = some.agg(F.sum("tokens"), F.count("*"), F.min("tokens"), F.max("tokens")).first()
    if not count:
        return sources.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("goal"))
    shares = some.withColumn("share", F.col("tokens") / F.lit(float(total)))
    least = low / total
    exponent = 0.0
    if entropy is not None:
        exponent = _search(shares, lambda x, z, e: math.log(z) - x * e / z <= entropy * math.log(count) + 1e-12)
    if budget is None:
        repeats = _search(shares, lambda x, z, e: (low / high) ** (x - 1) <= max_repeats + 1e-12)
    else:
        repeats = _search(shares, lambda x, z, e: least ** (x - 1) / z * budget / total <= max_repeats + 1e-12)
    exponent = round(max(exponent, repeats), DIGITS)
    raw = F.pow("share", F.lit(exponent))
    z = shares.agg(F.sum(raw)).first()[0]
    spend = float(budget) if budget is not None else total * (high / total) ** (1 - exponent) * z
    out = shares.select("source", "tokens", (raw / F.lit(z)).alias("weight"))
    out = out.withColumn("goal", F.floor(F.round(F.col("weight") * F.lit(spend), 3)).cast("long"))
    return out.unionByName(sources.where("tokens = 0").select("source", "tokens", F.lit(0.0).alias("weight"),
                                                             F.lit(0).cast("long").alias("goal")))


def plan(docs: DataFrame, *, entropy: float | None, max_repeats: float, budget: int | None, whole: bool,
         id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
         block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The reading plan: one row per document and pass: id, tk (md5 of the text), source, n_tokens, pass, block.

    A reading is in the plan while the tokens of the source read before it are below the source's goal
    (so a source overshoots by less than one document). With ``whole`` the first pass is never cut short.
    ``block`` numbers parts of ``block_tokens`` tokens in which every source has its weight; blocks keep a
    source's order. A null source is a source of its own; repeated rows are read as often as they come;
    texts without words count 0 tokens. An empty table gives an empty plan.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_tokens(F.col(text_col)).alias("n_tokens"),
                       F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("tk"))
    slim = cut(slim, "readings")
    sources = slim.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    if budget == "tokens":
        budget = sources.agg(F.sum("tokens")).first()[0] or 0
    goals = cut(mixture(sources, entropy=entropy, max_repeats=max_repeats, budget=budget), "goals").withColumnRenamed("source", "of")
    passes = F.when(F.col("tokens") > 0, F.ceil(F.col("goal") / F.col("tokens"))).otherwise(0).cast("int")
    passes = F.greatest(passes, F.lit(1))
    key = F.md5(F.concat_ws("|", F.lit(SEED), F.col("pass"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("tk")))
    read = (slim.join(goals, F.col("source").eqNullSafe(F.col("of")))
            .withColumn("pass", F.explode(F.sequence(F.lit(0), passes - 1)))
            .withColumn("key", key).withColumn("slice", F.substring("key", 1, 3)))
    slices = read.groupBy("of", "pass", "slice").agg(F.sum("n_tokens").alias("sum"), F.first("tokens").alias("tokens"))
    order = Window.partitionBy("of", "pass").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(F.col("of").alias("so"), F.col("pass").alias("sp"), F.col("slice").alias("ss"), (
        F.col("pass") * F.col("tokens") + F.coalesce(F.sum("sum").over(order), F.lit(0))).alias("base"))
    inner = Window.partitionBy("of", "pass", "slice").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    read = (read.join(slices, F.col("of").eqNullSafe(F.col("so")) & (F.col("pass") == F.col("sp")) & (F.col("slice") == F.col("ss")))
            .withColumn("before", F.col("base") + F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))))
    taken = F.col("before") < F.col("goal")
    if whole:
        taken = taken | (F.col("pass") == 0)
    block = F.when(F.col("weight") > 0, F.floor(F.round(F.col("before") / (F.col("weight") * F.lit(float(block_tokens))), 6)))
    return read.where(taken).select("id", "tk", "source", "n_tokens", "pass", F.coalesce(block, F.lit(0)).cast("long").alias("block"))


def mix_sources(docs: DataFrame, *, entropy: float | None = None, max_repeats: float = 1.5, budget: int | None = None,
                id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the plan reads it; every row at least once if no budget is given.

    See ``plan``. The text moves once, to meet the number of its readings; hot sources are spread by id.
    """
    got = plan(docs, entropy=entropy, max_repeats=max_repeats, budget=budget, whole=budget is None, id_col=id_col,
               source_col=source_col, text_col=text_col)
    tk, pid, ptk, psrc, n = (fresh(docs, x) for x in ("tk", "pid", "ptk", "psrc", "n"))
    times = got.groupBy("id", "tk", "source").agg(F.count("*").alias("readings"))
    rows = (docs.groupBy(F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("tk"),
                         F.col(source_col).alias("source")).agg(F.count("*").alias("rows")))
    times = (times.join(rows, times["id"].eqNullSafe(rows["id"]) & (times["tk"] == rows["tk"]) & times["source"].eqNullSafe(rows["source"]))
             .select(times["id"].alias(pid), times["tk"].alias(ptk), times["source"].alias(psrc),
                     F.ceil(F.col("readings") / F.col("rows")).cast("int").alias(n)))
    full = docs.withColumn(tk, F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    out = full.join(times, full[id_col].eqNullSafe(F.col(pid)) & (F.col(tk) == F.col(ptk)) & full[source_col].eqNullSafe(F.col(psrc)))
    again = fresh(out, "again")
    return out.withColumn(again, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)
