"""Average title metric per person, by role (the rating job).

Plan: scan credits (role filter and column pruning reach the scan) → equi-join
ratings on the title key → partial average per person on the map side →
shuffle on person → final average → optional global sort. A person holding a
third of all credits is pre-aggregated per task before the shuffle, so the
final aggregate only sees one partial row per task for it; a title holding a
third of all credits is split by AQE's skew-join handling when the ratings are
joined as they are, and by salts of its own when they are an aggregate (one rating
per title); AQE broadcasts the ratings side when its measured bytes allow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castlens.constants import ACTING_ROLES
from castlens.operators.skew import HOT_ROWS, skew_join


def role_filter(col: str, roles: str | Sequence[str] | None) -> Column | None:
    """``col = role`` for one role, ``col IN (...)`` for several, None for all roles."""
    if roles is None:
        return None
    if isinstance(roles, str):
        return F.col(col) == F.lit(roles)
    roles = list(roles)
    return F.col(col) == F.lit(roles[0]) if len(roles) == 1 else F.col(col).isin(*roles)


def latest_per_key(df: DataFrame, key: str, value: str, order_by: str) -> DataFrame:
    """One row per ``key``: the ``value`` of the row that is last by ``order_by``.

    Stands in for "the last line of the file wins" when loading a lookup table;
    ties on ``order_by`` are broken by the larger value so the pick is stable.
    """
    # max over a struct has no fixed-width buffer, so Spark plans a (partial +
    # final) sort-based aggregate: one shuffle, spill-safe at any size, and the
    # tie-break on the value keeps the result deterministic.
    last = F.max(F.struct(F.col(order_by).alias("o"), F.col(value).alias("v")))
    return df.groupBy(key).agg(last.getField("v").alias(value))


def matched_metrics(credits: DataFrame, ratings: DataFrame, *, title: str = "tconst", person: str = "nconst",
                    role: str = "category", roles: str | Sequence[str] | None = None, ratings_title: str | None = None,
                    metric: str = "averageRating", dedupe_order_by: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(person, _m): the metric of every (credit, rating) match; see :func:`average_metric_per_person`."""
    rt = ratings_title or title
    cond = role_filter(role, roles)
    c = credits if cond is None else credits.where(cond)
    c = c.select(F.col(title).alias("_t"), F.col(person).alias(person))
    if dedupe_order_by is None:                            # two plain shuffles: AQE splits a hot title
        return c.join(ratings.select(F.col(rt).alias("_t"), F.col(metric).alias("_m")), "_t", "inner").drop("_t")
    r = latest_per_key(ratings, rt, metric, dedupe_order_by).select(F.col(rt).alias("_t"), F.col(metric).alias("_m"))
    return skew_join(c, r, "_t", spread_by=[person], hot_rows=hot_rows).drop("_t")   # an aggregate: AQE can't


def exact_units(metric: str, scale: int) -> Column:
    """The metric as an exact integer, ``round(x·10^scale)``; null for null and NaN."""
    value = F.nanvl(F.col(metric).cast("double"), F.lit(None).cast("double"))
    return F.round(value * F.lit(10 ** scale)).cast("decimal(38,0)")


def units_average(units: Column, n: Column, scale: int) -> Column:
    """The mean of ``n`` metrics from the sum of their units; null without any."""
    return F.try_divide(units.cast("double"), n.cast("double")) / F.lit(float(10 ** scale))


def average_metric_per_person(credits: DataFrame, ratings: DataFrame, *, title: str = "tconst",
                              person: str = "nconst", role: str = "category",
                              roles: str | Sequence[str] | None = ACTING_ROLES,
                              ratings_title: str | None = None, metric: str = "averageRating",
                              out_col: str = "avgRating", dedupe_order_by: str | None = None,
                              exact_scale: int | None = None, sort: bool = True, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Mean of ``metric`` over every (credit, rating) match, per person.

    * ``roles`` — one role, a set of roles, or None for every role.
    * Join semantics are a bag join: a person credited twice on a title counts
      that title twice; unrated titles drop out; a null metric is skipped.
    * ``dedupe_order_by`` — keep one rating per title (the last by that column)
      instead of fanning out over duplicate rating rows.
    * ``exact_scale`` — metric values carry at most that many decimals; the sum
      is then taken over exact integers (``round(x·10^s)``) so the result does
      not depend on summation order (same bits on every engine and run). NaN
      metrics are skipped like nulls there.
    * ``hot_rows`` — with ``dedupe_order_by``, a title with more credits than that
      meets its rating in several tasks.
    * ``sort`` — order by the average descending, then person (stable ties).
    """
    j = matched_metrics(credits, ratings, title=title, person=person, role=role, roles=roles, ratings_title=ratings_title,
                        metric=metric, dedupe_order_by=dedupe_order_by, hot_rows=hot_rows)
    if exact_scale is None:
        agg = F.avg("_m")
    else:
        units = exact_units("_m", exact_scale)
        agg = units_average(F.sum(units), F.count(units), exact_scale)
    out = j.groupBy(person).agg(agg.alias(out_col))
    if sort:
        out = out.orderBy(F.col(out_col).desc_nulls_last(), F.col(person).asc())
    return out
