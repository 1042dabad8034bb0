"""Cascade target by transaction (D12): the provider most likely to recover a decline like this one.

Outcomes are counted per provider at several levels of traits, from the most
specific to none.  A decline takes the first level at which a provider other
than its own has enough outcomes, and there the provider with the highest rate.

Rates are point in time: an outcome counts for declines of later days than the
one on which it became known.  Outcomes are first collapsed to one row per
(level, traits, provider, day), asked days are laid between them, and one
running sum per (level, traits, provider) answers every asked day, so the
windows hold days and no transactions, and nothing is joined on a range.

Edge cases: a NULL trait is a value of its own; outcomes without provider or
day and declines without day give no rate; equal rates go to the smaller
provider name; without any level of enough support the target is NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rebound.operators.joins import join_on

#: Trait levels, most specific first; the last one holds all outcomes of a provider.
LEVELS = (("merchant_country", "response_code"), ("merchant_vertical", "response_code"), ("response_code",), ())
#: Outcomes that a provider needs at a level before its rate there counts.
MIN_SUPPORT = 20


def _by_level(df: DataFrame, levels: Sequence[Sequence[str]]) -> DataFrame:
    """Each row once per level, with ``__level`` and ``__key``, a text of the level's traits."""
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    each = [F.struct(F.lit(i).alias("level"), F.concat_ws("\x01", *[text(c) for c in cols]).alias("key"))
            for i, cols in enumerate(levels)]
    return df.withColumn("__l", F.explode(F.array(*each))).withColumns({"__level": F.col("__l.level"), "__key": F.col("__l.key")}).drop("__l")


def provider_rates(asked: DataFrame, outcomes: DataFrame, provider: str, known_day: str, success: str, day: str,
                   levels: Sequence[Sequence[str]] = LEVELS) -> DataFrame:
    """(__level, __key, day, provider, n, ok): outcomes known before each asked (level, key, day)."""
    traits = sorted({c for cols in levels for c in cols})
    good = F.coalesce(F.col(success).cast("boolean"), F.lit(False))
    cells = (outcomes.where(F.col(provider).isNotNull() & F.col(known_day).isNotNull())
             .groupBy(*traits, F.col(provider).alias("__p"), F.col(known_day).alias("__day"))
             .agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("ok")))
    state = _by_level(cells, levels).groupBy("__level", "__key", "__p", "__day").agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"))
    days = _by_level(asked.where(F.col(day).isNotNull()), levels).select("__level", "__key", F.col(day).alias("__day")).distinct()
    offered = state.select("__level", "__key", "__p").distinct()
    none = F.lit(0).cast("long")
    asks = days.join(offered, ["__level", "__key"]).select("__level", "__key", "__p", "__day", none.alias("n"), none.alias("ok"), F.lit(0).alias("__kind"))
    line = asks.unionByName(state.withColumn("__kind", F.lit(1)))
    # an asked day sorts before the outcomes of the same day and so does not see them
    so_far = Window.partitionBy("__level", "__key", "__p").orderBy("__day", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (line.select("__level", "__key", "__p", "__day", "__kind", F.sum("n").over(so_far).alias("n"), F.sum("ok").over(so_far).alias("ok"))
            .where("__kind = 0").select("__level", "__key", F.col("__day").alias(day), F.col("__p").alias("provider"), "n", "ok"))


def cascade_targets(df: DataFrame, outcomes: DataFrame, provider: str, day: str, known_day: str, success: str,
                    levels: Sequence[Sequence[str]] = LEVELS, min_support: int = MIN_SUPPORT) -> DataFrame:
    """``df`` with ``cascade_provider``, ``cascade_level`` (index in ``levels``), ``cascade_rate`` and ``cascade_support``."""
    traits = sorted({c for cols in levels for c in cols})
    of = [*traits, provider, day]
    asked = df.select(*of).distinct()
    rates = provider_rates(asked, outcomes, provider, known_day, success, day, levels).where(F.col("n") >= min_support)
    rates = rates.withColumn("__rate", F.col("ok") / F.col("n"))
    place = Window.partitionBy("__level", "__key", day).orderBy(F.col("__rate").desc(), "provider")
    # the best two of each level are enough, as only the decline's own provider can be left out
    best = (rates.withColumn("__rank", F.row_number().over(place)).where("__rank <= 2")
            .select("__level", "__key", day, F.struct((-F.col("__rate")).alias("less"), "provider", "n").alias("__best")))
    met = _by_level(asked, levels).join(best, ["__level", "__key", day]).where(~F.col("__best.provider").eqNullSafe(F.col(provider)))
    first = met.groupBy(*of).agg(F.min(F.struct("__level", "__best")).alias("__first")).select(
        *of, F.col("__first.__best.provider").alias("cascade_provider"), F.col("__first.__level").alias("cascade_level"),
        (-F.col("__first.__best.less")).alias("cascade_rate"), F.col("__first.__best.n").alias("cascade_support"))
    return join_on(df, first, of, "left")
