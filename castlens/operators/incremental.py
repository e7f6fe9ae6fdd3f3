"""Averages that follow landing batches: mergeable (sum, count) states instead of a recomputation of everything.

A batch of credits becomes one row per person, the exact sum of its metrics and their number. The state table
is a folder of such rows: ``delta/batch=N`` for each batch, and ``base/upto=N`` with the merged states of all
batches up to N. Only finished folders (those with Spark's ``_SUCCESS`` file) are read, so a batch that fails
half-way counts for nothing until it is repeated, and a repeated one replaces its folder: each batch counts
once. ``add_batch`` has the arguments of ``foreachBatch`` (its ids ascend and survive a restart), or is called
by a scheduler with ids of its own. One writer at a time; readers may come at any time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castlens.operators.ratings import exact_units, matched_metrics, units_average

_DELTA, _BASE = ("delta", "batch"), ("base", "upto")


def metric_states(credits: DataFrame, ratings: DataFrame, *, person: str = "nconst", exact_scale: int, **match) -> DataFrame:
    """(person, units, n) of a batch of credits: exact sum of ``round(metric·10^scale)`` and number of metrics.

    ``match`` is passed on to ``matched_metrics`` (roles, names of columns, one rating per title). A person whose
    matches have no metric keeps a row with null units and n = 0.
    """
    units = exact_units("_m", exact_scale)
    return matched_metrics(credits, ratings, person=person, **match).groupBy(person).agg(
        F.sum(units).alias("units"), F.count(units).alias("n"))


def merge_states(states: DataFrame, person: str = "nconst") -> DataFrame:
    """One row per person: states add up in any order and grouping."""
    return states.groupBy(person).agg(F.sum("units").cast("decimal(38,0)").alias("units"), F.sum("n").alias("n"))


def state_averages(states: DataFrame, *, person: str = "nconst", exact_scale: int, out_col: str = "avgRating",
                   sort: bool = True) -> DataFrame:
    """Mean per person, as ``average_metric_per_person`` gives it over all credits of all batches."""
    out = merge_states(states, person).select(person, units_average(F.col("units"), F.col("n"), exact_scale).alias(out_col))
    return out.orderBy(F.col(out_col).desc_nulls_last(), F.col(person).asc()) if sort else out


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _finished(spark: SparkSession, path: str, kind: tuple[str, str]) -> dict[int, str]:
    """Number → folder of the finished batches or bases: names only, one for each batch since the last vacuum."""
    fs, root = _folder(spark, f"{path.rstrip('/')}/{kind[0]}")
    out = {}
    for status in fs.listStatus(root) if fs.exists(root) else []:
        name, _, number = status.getPath().getName().partition("=")
        if name == kind[1] and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            out[int(number)] = status.getPath().toString()
    return out


def _live(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """The last batch in the newest base (-1 without one), and the folders that hold every batch once."""
    bases = _finished(spark, path, _BASE)
    upto = max(bases, default=-1)
    later = [p for b, p in sorted(_finished(spark, path, _DELTA).items()) if b > upto]
    return upto, ([bases[upto]] if bases else []) + later


def add_batch(states: DataFrame, batch_id: int, path: str) -> bool:
    """Write a batch's states; False if the merged base holds that batch already.

    The same id again replaces what its earlier attempt left, so a replayed batch counts once.
    """
    if batch_id < 0:
        raise ValueError("batch ids start at 0")
    if batch_id <= max(_finished(states.sparkSession, path, _BASE), default=-1):
        return False
    states.write.mode("overwrite").parquet(f"{path.rstrip('/')}/delta/batch={batch_id}")
    return True


def read_states(spark: SparkSession, path: str, *, person: str = "nconst bigint") -> DataFrame:
    """The states of every finished batch, each once; several rows per person until they are merged.

    ``person`` is the key column with its type. A folder without batches gives no rows.
    """
    schema = f"{person}, units decimal(38,0), n bigint"
    folders = _live(spark, path)[1]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def compact_states(spark: SparkSession, path: str, *, person: str = "nconst bigint") -> int:
    """Merge the newest base and all later batches into one base; the last batch in it, -1 without any.

    Old folders stay for those who read them; ``vacuum_states`` removes them.
    """
    upto, folders = _live(spark, path)
    last = max(_finished(spark, path, _DELTA), default=-1)
    if last > upto:
        merged = merge_states(read_states(spark, path, person=person), person.split()[0])
        merged.write.mode("overwrite").parquet(f"{path.rstrip('/')}/base/upto={last}")
    return max(last, upto)


def vacuum_states(spark: SparkSession, path: str) -> int:
    """Remove the batches and bases that the newest base holds; how many folders went."""
    upto = _live(spark, path)[0]
    old = [p for b, p in _finished(spark, path, _DELTA).items() if b <= upto]
    old += [p for b, p in _finished(spark, path, _BASE).items() if b < upto]
    for folder in old:
        fs, p = _folder(spark, folder)
        fs.delete(p, True)
    return len(old)
