"""Global order without a global sort (survey section 7.2).

A window with ``orderBy`` and no ``partitionBy`` moves every row to one task.
Two tools replace it:

``order_statistics``  exact k-th smallest values (any orderable type, ties
    allowed) by iterative narrowing: per pass, sample a bounded set of pivots
    from the still-open interval, count rows per pivot bucket in one grouped
    aggregate, keep the bucket holding rank k, until k falls on a pivot's
    equality count.  Intervals and pivots are a small broadcast table, so a
    plan has the same size for any number of groups.  A hot value (a third of
    all rows equal) is resolved by its equality count.  Drives the temporal
    split (W1) and exact quantiles (F1 PSI edges, M7 calibration buckets, G7
    medians).

``prefix_sums``  cumulative sums over a collapsed (group, value) table:
    rows are bucketed by cut points (computed once and broadcast, so
    recomputation after a lost executor cannot move a boundary), bucket totals
    become offsets, and a window partitioned by (group, bucket) adds the
    in-bucket running sum.  Drives midrank AUC (M1) and KS (F2).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _group_key(row, group_cols) -> tuple:
    return tuple(row[g] for g in group_cols)


def _lit_value(v, dtype=None) -> Column:
    if isinstance(v, tuple):
        c = F.struct(*[F.lit(x).alias(f"c{i}") for i, x in enumerate(v)])
    else:
        c = F.lit(v)
    return c.cast(dtype) if dtype is not None else c


def _as_value(value) -> Column:
    if isinstance(value, (list, tuple)):
        return F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(value)])
    return F.col(value) if isinstance(value, str) else value


def _row_value(v):
    if hasattr(v, "asDict") and not isinstance(v, (str, bytes)):
        return tuple(v[i] for i in range(len(v)))
    return v


def _sort_key(v):
    """Driver-side order equal to Spark's ascending order (NULL first)."""
    if isinstance(v, tuple):
        return tuple(_sort_key(x) for x in v)
    return (0, 0) if v is None else (1, v)


def _valid(v: Column, dtype) -> Column:
    """Rows that take part in an order: non-NULL, and not NaN for floats
    (NaN is missing, as in the reference; Spark would sort it above all)."""
    from pyspark.sql import types as T
    cond = v.isNotNull()
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        cond = cond & ~F.isnan(v)
    return cond


def _group_condition(group_cols, key) -> Column:
    cond = F.lit(True)
    for g, v in zip(group_cols, key):
        cond = cond & (F.col(g).isNull() if v is None else (F.col(g) == F.lit(v)))
    return cond


def count_below(arr: Column, v: Column, n: int, length: Column | None = None) -> Column:
    """Number of elements of the sorted array ``arr`` that are strictly below
    ``v``: a binary search in ceil(log2(n + 1)) steps.  The array has ``n``
    elements, or ``length`` of them and at most ``n``."""
    steps = max(1, math.ceil(math.log2(n + 1)))
    init = F.struct(F.lit(0).alias("lo"), (F.lit(n) if length is None else length).alias("hi"))

    def step(acc, _):
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        below = F.element_at(arr, mid + 1) < v
        moved = F.when(below, F.struct((mid + 1).alias("lo"), acc["hi"].alias("hi"))) \
            .otherwise(F.struct(acc["lo"].alias("lo"), mid.alias("hi")))
        return F.when(acc["lo"] < acc["hi"], moved).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), init, step)["lo"]


def _row_literal(v):
    """A pivot as createDataFrame takes it: tuples for structs."""
    return tuple(v) if isinstance(v, tuple) else v


def _interval_table(spark, base: DataFrame, group_cols, vtype, entries: list) -> DataFrame:
    """(group columns, __ivs): the open intervals of each group, each with its pivots.

    One row per group of the request, at most ``fanout`` pivots per requested
    rank, so its size is fixed by the request and not by the data.
    """
    from pyspark.sql import types as T
    iv = T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("lo", vtype), T.StructField("hi", vtype),
                       T.StructField("has_lo", T.BooleanType()), T.StructField("has_hi", T.BooleanType()),
                       T.StructField("pivots", T.ArrayType(vtype))])
    schema = T.StructType([T.StructField(f"__g{i}", base.schema[g].dataType) for i, g in enumerate(group_cols)]
                          + [T.StructField("__ivs", T.ArrayType(iv))])
    by_group: dict = {}
    for idx, g, lo, hi, pivots in entries:
        by_group.setdefault(g, []).append((idx, _row_literal(lo), _row_literal(hi), lo is not None, hi is not None,
                                           [_row_literal(x) for x in pivots]))
    return spark.createDataFrame([(*g, ivs) for g, ivs in by_group.items()], schema)


def _in_intervals(base: DataFrame, table: DataFrame, group_cols) -> DataFrame:
    """Rows of ``base`` that lie in an open interval, with that interval as ``__iv``.

    Open intervals of one group are disjoint or identical (children of disjoint
    pivot buckets), so each row belongs to at most one.
    """
    v = F.col("__v")
    inside = F.filter("__ivs", lambda x: (~x["has_lo"] | (v > x["lo"])) & (~x["has_hi"] | (v <= x["hi"])))
    cond = F.lit(True)
    for i, g in enumerate(group_cols):
        cond = cond & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return base.join(F.broadcast(table), cond).withColumn("__iv", F.get(inside, F.lit(0))).where(F.col("__iv").isNotNull())


def order_statistics(df: DataFrame, value, ranks: dict, group_cols: Sequence[str] = (),
                     fanout: int = 512, seed: int = 17, sizes: dict | None = None) -> dict:
    """Exact order statistics.

    ``value``: a column name, or a list of names compared lexicographically.
    ``ranks``: {group_key_tuple: [k, ...]} with 0-based ranks among non-NULL
    values of that group.  Returns {(group_key, k): value} (None for a rank past
    the end).  ``sizes`` (the non-NULL count per group, when the caller has it)
    saves the counting job.

    One path at every size: each pass samples about 4 x ``fanout`` pivots from
    each open interval, counts the rows between and equal to them in one
    grouped aggregate, and keeps the gap that holds the rank.  An interval of
    fewer rows is sampled whole, so its values all become pivots sooner or
    later and the rank ends on an equality count; passes go on until then.
    """
    group_cols = list(group_cols)
    v = _as_value(value)
    base = df.select(*[F.col(g) for g in group_cols], v.alias("__v"))
    vtype = base.schema["__v"].dataType
    base = base.where(_valid(F.col("__v"), vtype))
    spark = df.sparkSession
    if sizes is None:
        sizes = {_group_key(r, group_cols): r["n"] for r in base.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n")).collect()}
    out: dict = {(g, k): None for g, ks in ranks.items() for k in ks}
    # open ranks by interval: (group, lo, hi) -> [rows below it, rows in it, ranks]; the interval is (lo, hi]
    intervals = {(g, None, None): [0, sizes.get(g, 0), [k for k in ks if 0 <= k < sizes.get(g, 0)]] for g, ks in ranks.items()}
    pass_no = 0
    while intervals := {i: x for i, x in intervals.items() if x[2]}:
        tagged = list(intervals)
        table = _interval_table(spark, base, group_cols, vtype, [(n, *t, []) for n, t in enumerate(tagged)])
        share = F.element_at(F.array(*[F.lit(min(1.0, 4.0 * fanout / intervals[t][1])) for t in tagged]), F.col("__iv.idx") + 1)
        drawn: dict = {}
        for r in _in_intervals(base, table, group_cols).where(F.rand(seed + pass_no) < share).select("__iv.idx", "__v").collect():
            drawn.setdefault(r["idx"], set()).add(_row_value(r["__v"]))
        pivots = {}
        for n in range(len(tagged)):
            vals = sorted(drawn.get(n, set()), key=_sort_key)
            pivots[n] = vals[::max(1, math.ceil(len(vals) / fanout))]
        # one grouped pass: per interval, count rows equal to / below each pivot
        table = _interval_table(spark, base, group_cols, vtype, [(n, *t, pivots[n]) for n, t in enumerate(tagged)])
        most = max(len(x) for x in pivots.values())
        placed = _in_intervals(base, table, group_cols).select(
            F.col("__iv.idx").alias("idx"), F.col("__v"), F.col("__iv.pivots").alias("__p"))
        placed = placed.withColumn("b", count_below(F.col("__p"), F.col("__v"), most, F.size("__p")))
        counts = placed.groupBy("idx", "b", (F.coalesce(F.get("__p", F.col("b")) == F.col("__v"), F.lit(False))).alias("eq")) \
            .agg(F.count(F.lit(1)).alias("n")).collect()
        hist = {(r["idx"], r["b"], r["eq"]): r["n"] for r in counts}
        narrowed: dict = {}
        for n, (g, lo, hi) in enumerate(tagged):
            run, _, ks = intervals[g, lo, hi]
            ks, ps = sorted(ks), pivots[n]
            for b in range(len(ps) + 1):
                gap, eq = hist.get((n, b, False), 0), hist.get((n, b, True), 0)
                inside = [k for k in ks if run <= k < run + gap]
                if inside:  # strictly between two pivots; the upper one bounds the interval but is not in it
                    top = ps[b] if b < len(ps) else hi
                    held = gap + (eq if b < len(ps) else 0)
                    narrowed[g, lo if b == 0 else ps[b - 1], top] = [run, held, inside]
                for k in ks:
                    if run + gap <= k < run + gap + eq:
                        out[g, k] = ps[b]
                run += gap + eq
        intervals = narrowed
        pass_no += 1
    return out


def group_counts(df: DataFrame, value, group_cols: Sequence[str] = ()) -> dict:
    """Non-NULL value count per group: {group_key_tuple: n}."""
    v = _as_value(value)
    vtype = df.select(v.alias("__v")).schema["__v"].dataType
    rows = (df.where(_valid(v, vtype)).groupBy(*group_cols)
            .agg(F.count(F.lit(1)).alias("n")).collect())
    return {_group_key(r, group_cols): r["n"] for r in rows}


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float],
                    group_cols: Sequence[str] = (), counts: dict | None = None,
                    fanout: int = 512) -> dict:
    """Linear-interpolation quantiles (numpy / DuckDB ``quantile_cont``).

    Returns {group_key_tuple: [q-values]} for groups with at least one value.
    """
    counts = counts if counts is not None else group_counts(df, value, group_cols)
    ranks = {}
    for g, n in counts.items():
        ks = set()
        for q in probs:
            pos = q * (n - 1)
            ks.add(int(math.floor(pos)))
            ks.add(int(math.ceil(pos)))
        ranks[g] = sorted(k for k in ks if 0 <= k < n)
    stats = order_statistics(df, value, ranks, group_cols, sizes=counts, fanout=fanout)
    res = {}
    for g, n in counts.items():
        if n == 0:
            continue
        vals = []
        for q in probs:
            pos = q * (n - 1)
            lo, hi = int(math.floor(pos)), int(math.ceil(pos))
            a, b = stats[(g, lo)], stats[(g, hi)]
            vals.append(a + (b - a) * (pos - lo) if hi != lo else a)
        res[g] = vals
    return res


def kth_boundaries(df: DataFrame, order_cols: Sequence[str], fractions: Sequence[float],
                   fanout: int = 512) -> tuple[int, list]:
    """Keys of the rows at ordinal floor(n * f) for each fraction.

    ``order_cols`` must identify a row uniquely (add the id).  Returns
    (n, [boundary key tuple or None when the ordinal is past the end]).
    """
    n = df.count()
    ks = [int(math.floor(n * f)) for f in fractions]
    want = sorted({k for k in ks if k < n})
    stats = order_statistics(df, list(order_cols), {(): want}, fanout=fanout, sizes={(): n}) if want else {}
    return n, [stats[(), k] if k < n else None for k in ks]


def prefix_sums(collapsed: DataFrame, value: str, sum_cols: Sequence[str],
                group_cols: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Add ``<c>_before`` = sum of ``c`` over rows of the same group with a
    smaller ``value`` (strictly), for a table with one row per (group, value).

    About sqrt(rows) / 8 buckets per group (or ``buckets``), so that the cut
    points and a bucket's rows both grow with the square root of the table.
    """
    group_cols = list(group_cols)
    p = buckets or max(2, math.ceil(math.sqrt(collapsed.count()) / 8))
    probs = [i / p for i in range(1, p)] or [0.5]
    spark = collapsed.sparkSession
    cut_rows = (collapsed.groupBy(*group_cols)
                .agg(F.array_distinct(F.percentile_approx(F.col(value).cast("double"), probs, max(10_000, 10 * p))).alias("__cuts")))
    cuts = spark.createDataFrame(cut_rows.collect(), cut_rows.schema)  # cut points: p per group
    for i, g in enumerate(group_cols):
        cuts = cuts.withColumnRenamed(g, f"__g{i}")
    same = F.lit(True)
    for i, g in enumerate(group_cols):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    bucketed = collapsed.join(F.broadcast(cuts), same).withColumn(
        "__b", count_below(F.col("__cuts"), F.col(value).cast("double"), p, F.coalesce(F.size("__cuts"), F.lit(0)))) \
        .select(*collapsed.columns, "__b")
    totals = bucketed.groupBy(*group_cols, "__b").agg(*[F.sum(c).alias(f"__t_{c}") for c in sum_cols])
    w_off = Window.partitionBy(*group_cols).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group_cols)], F.col("__b").alias("__ob"),
                            *[F.coalesce(F.sum(f"__t_{c}").over(w_off), F.lit(0)).alias(f"__o_{c}")
                              for c in sum_cols])
    # offsets hold one row per (group, bucket): bounded by the cut points
    j = bucketed.join(F.broadcast(offsets), same & (F.col("__b") == F.col("__ob")))
    w_in = (Window.partitionBy(*group_cols, "__b").orderBy(value)
            .rowsBetween(Window.unboundedPreceding, -1))
    return j.select(*[F.col(c) for c in collapsed.columns],
                    *[(F.coalesce(F.sum(c).over(w_in), F.lit(0)) + F.col(f"__o_{c}")).alias(f"{c}_before")
                      for c in sum_cols])


def top_k_per_group(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence, k) -> DataFrame:
    """Rows ranked 1..k per group by ``order_cols`` (ascending; rows must be
    unique on group + order key, e.g. (-count, value)).  ``k`` is an int or a
    function of the group key; k is small.

    ``row_number`` with a rank bound: Spark keeps the best k of each group in
    every task before the shuffle, so a group sends k rows per task, however
    many it has.
    """
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    ranked = df.where(_valid(_as_value(list(order_cols)), None)).withColumn("__rank", F.row_number().over(w))
    if not callable(k):
        return ranked.where(F.col("__rank") <= k).drop("__rank")
    groups = [r for r in df.select(*group_cols).distinct().collect()]
    most = max([k(_group_key(r, group_cols)) for r in groups], default=0)
    bound = F.lit(0)
    for r in groups:
        key = _group_key(r, group_cols)
        bound = F.when(_group_condition(group_cols, key), F.lit(k(key))).otherwise(bound)
    return ranked.where((F.col("__rank") <= most) & (F.col("__rank") <= bound)).drop("__rank")
