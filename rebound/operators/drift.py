"""Drift between a baseline and a current sample.

All features are unpivoted to (feature, value) once, so the whole drift table
is a fixed number of jobs regardless of the feature count:
quantile edges (exact order statistics, grouped by feature), one bucket-count
pass for PSI, one collapsed prefix-sum pass for KS, one top-10 pass for JS.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rebound import config as C
from rebound.functions.parse import missing_as
from rebound.operators.ordered import count_below, exact_quantiles, prefix_sums, top_k_per_group
from rebound.session import materialize

KS_TERMS = 100


def unpivot(df: DataFrame, features: Sequence[str], cast: str, sample: str) -> DataFrame:
    """(sample, feature, value) rows for the given columns."""
    if not features:
        return None
    exprs = ", ".join(f"'{f}', CAST(`{f}` AS {cast})" for f in features)
    return df.selectExpr(f"stack({len(features)}, {exprs}) AS (feature, value)").withColumn(
        "sample", F.lit(sample))


def numeric_long(base: DataFrame, cur: DataFrame, features: Sequence[str]) -> DataFrame:
    """Numeric and boolean features as doubles (booleans -> 0/1, NULL -> 0)."""
    def prep(df):
        cols = []
        for f in features:
            t = df.schema[f].dataType.simpleString()
            c = F.col(f"`{f}`")
            cols.append((F.coalesce(c.cast("int"), F.lit(0)) if t == "boolean" else c).cast("double").alias(f))
        return df.select(*cols)
    return unpivot(prep(base), features, "DOUBLE", "base").unionByName(
        unpivot(prep(cur), features, "DOUBLE", "current"))


def sample_sizes(long: DataFrame) -> dict:
    """Non-NULL, non-NaN value count per (feature, sample): one job."""
    vals = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return {(r["feature"], r["sample"]): r["n"] for r in
            vals.groupBy("feature", "sample").agg(F.count(F.lit(1)).alias("n")).collect()}


def psi(long: DataFrame, bins: int = 10, open_ends: bool = False, sizes: dict | None = None) -> DataFrame:
    """PSI with baseline-quantile edges (duplicates dropped), eps-clipped
    shares.  Values outside the baseline range are dropped (T8) unless
    ``open_ends``; fewer than 3 edges -> 0; an empty sample -> NULL."""
    spark = long.sparkSession
    vals = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    base = vals.where(F.col("sample") == "base")
    probs = [i / bins for i in range(bins + 1)]
    # per-feature sizes of both samples (quantile ranks + presence)
    sizes = sizes if sizes is not None else sample_sizes(long)
    feats_all = {f for f, _ in sizes}
    present = {f: sizes.get((f, "base"), 0) > 0 and sizes.get((f, "current"), 0) > 0 for f in feats_all}
    q = exact_quantiles(base, "value", probs, ["feature"],
                        counts={(f,): n for (f, smp), n in sizes.items() if smp == "base"})
    edges = {g[0]: sorted(set(v)) for g, v in q.items()}
    used = {f: [float(x) for x in e] for f, e in edges.items() if len(e) >= 3 and present.get(f)}
    rows = [(f, i) for f, e in used.items() for i in range(len(e) - 1)]
    out_schema = "feature string, psi double"
    feats = sorted(present)
    if not rows:
        return spark.createDataFrame([(f, (0.0 if present[f] else None)) for f in feats], out_schema)
    # bin edges as a table of one array per feature: the plan is the same for any number of features
    table = F.broadcast(spark.createDataFrame(sorted(used.items()), "feature string, __e array<double>"))
    v, e, last = F.col("value"), F.col("__e"), F.size("__e") - 2
    below = count_below(e, v, bins + 1, F.size("__e"))
    b = F.least(F.when(F.get(e, below) == v, below).otherwise(below - 1), last)  # the last edge belongs to the last bin
    if open_ends:
        b = F.greatest(b, F.lit(0))
    else:
        b = F.when((v >= F.get(e, F.lit(0))) & (v <= F.element_at(e, -1)), b)
    counts = (vals.join(table, "feature").withColumn("bucket", b).where(F.col("bucket").isNotNull())
              .groupBy("feature", "bucket")
              .agg(F.count_if(F.col("sample") == "base").alias("e"),
                   F.count_if(F.col("sample") == "current").alias("a")))
    # dense bins (features x <= bins rows, fixed by the quantile count)
    grid = spark.createDataFrame(rows, "feature string, bucket int")
    full = grid.join(counts, ["feature", "bucket"], "left").na.fill(0, ["e", "a"])
    w = Window.partitionBy("feature")
    eps = F.lit(C.PSI_EPS)
    shares = full.select(
        "feature",
        F.greatest(F.col("e") / F.greatest(F.sum("e").over(w), F.lit(1)), eps).alias("ep"),
        F.greatest(F.col("a") / F.greatest(F.sum("a").over(w), F.lit(1)), eps).alias("ap"))
    scored = shares.groupBy("feature").agg(
        F.sum((F.col("ap") - F.col("ep")) * F.log(F.col("ap") / F.col("ep"))).alias("psi"))
    rest = [(f, (0.0 if present[f] else None)) for f in feats if f not in {r[0] for r in rows}]
    if rest:
        scored = scored.unionByName(spark.createDataFrame(rest, out_schema))
    return scored


def kolmogorov_pvalue(d: Column, n1: Column, n2: Column, terms: int = KS_TERMS) -> Column:
    """asymptotic two-sided p-value Q(sqrt(n1 n2 / (n1 + n2)) * D),
    Q(z) = 2 sum_k (-1)^(k-1) exp(-2 k^2 z^2); 1 for z < 0.05 (T20)."""
    en = n1 * n2 / (n1 + n2)
    z = F.sqrt(en) * d
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
        * F.exp(F.lit(-2.0) * k * k * z * z))
    q = F.lit(2.0) * series
    return F.when(z < F.lit(0.05), F.lit(1.0)).otherwise(F.least(F.greatest(q, F.lit(0.0)), F.lit(1.0)))


def ks(long: DataFrame) -> DataFrame:
    """two-sample KS statistic per feature (+ F3 p-value)."""
    vals = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    collapsed = vals.groupBy("feature", "value").agg(
        F.count_if(F.col("sample") == "base").alias("b"),
        F.count_if(F.col("sample") == "current").alias("c"))
    pre = prefix_sums(collapsed, "value", ["b", "c"], ["feature"])
    # totals per feature: one row per feature, joined back (never a window
    # over all distinct values of a feature)
    tot = collapsed.groupBy("feature").agg(F.sum("b").alias("nb"), F.sum("c").alias("nc"))
    cdf = pre.join(F.broadcast(tot), "feature").select(
        "feature", "nb", "nc",
        F.try_divide(F.col("b_before") + F.col("b"), F.col("nb")).alias("fb"),
        F.try_divide(F.col("c_before") + F.col("c"), F.col("nc")).alias("fc"))
    stat = cdf.groupBy("feature", "nb", "nc").agg(F.max(F.abs(F.col("fb") - F.col("fc"))).alias("ks_stat"))
    ok = (F.col("nb") > 0) & (F.col("nc") > 0)
    return stat.select("feature", F.when(ok, F.col("ks_stat")).alias("ks_stat"),
                       F.when(ok, kolmogorov_pvalue(F.col("ks_stat"), F.col("nb").cast("double"),
                                                    F.col("nc").cast("double"))).alias("p_value"))


def top_shares(samples: dict[str, DataFrame], features: Sequence[str], limit: int = 10) -> DataFrame:
    """Share of the top-``limit`` categories over all rows (ties by value),
    for every (sample, feature) in one pass."""
    long = None
    for name, df in samples.items():
        cat = df.select(*[missing_as(f"`{f}`").alias(f) for f in features])
        part = unpivot(cat, features, "STRING", name)
        long = part if long is None else long.unionByName(part)
    counts = (long.groupBy("sample", "feature", "value").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("neg_n", -F.col("n")))
    tot = long.groupBy("sample", "feature").agg(F.count(F.lit(1)).alias("total"))
    top = top_k_per_group(counts, ["sample", "feature"], ["neg_n", "value"], limit)
    # tot has one row per (sample, feature): bounded by the feature count
    return (top.join(F.broadcast(tot), ["sample", "feature"])
            .withColumn("share", F.col("n") / F.col("total")))


def jensen_shannon(base: DataFrame, cur: DataFrame, features: Sequence[str]) -> DataFrame:
    """F4 (+U1): JS divergence of the top-10 shares; a category missing on one
    side gets 1e-6, both sides renormalised, natural log."""
    sh = top_shares({"base": base, "current": cur}, features)
    b = sh.where(F.col("sample") == "base").select("feature", "value", F.col("share").alias("p"))
    c = sh.where(F.col("sample") == "current").select("feature", "value", F.col("share").alias("q"))
    eps = F.lit(C.JS_EPS)
    u = b.join(c, ["feature", "value"], "full_outer").select(
        "feature", F.coalesce("p", eps).alias("p"), F.coalesce("q", eps).alias("q"))
    w = Window.partitionBy("feature")
    n = u.select("feature", (F.col("p") / F.sum("p").over(w)).alias("p"),
                 (F.col("q") / F.sum("q").over(w)).alias("q"))
    m = (F.col("p") + F.col("q")) / F.lit(2.0)
    return n.groupBy("feature").agg(
        (F.lit(0.5) * F.sum(F.col("p") * F.log(F.col("p") / m))
         + F.lit(0.5) * F.sum(F.col("q") * F.log(F.col("q") / m))).alias("js_divergence"))


def drift_alert(psi_c: Column, js_c: Column, p_c: Column) -> Column:
    """retrain if PSI > 0.25, investigate if PSI > 0.2, JS > 0.2 or KS p < 0.05."""
    return (F.when(psi_c > C.PSI_ALERT_RETRAIN, F.lit("retrain"))
            .when(psi_c > C.PSI_ALERT_INVESTIGATE, F.lit("investigate"))
            .when(js_c > C.JS_ALERT, F.lit("investigate"))
            .when(p_c < C.KS_P_ALERT, F.lit("investigate"))
            .otherwise(F.lit("ok")))


def drift_table(base: DataFrame, cur: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                expected: Sequence[str] = ()) -> DataFrame:
    """one row per feature: type, PSI, KS, p-value, JS, alert.

    ``expected`` features absent from either sample get a 'missing' row.
    """
    spark = base.sparkSession
    have = set(base.columns) & set(cur.columns)
    num = [f for f in numeric if f in have]
    cat = [f for f in categorical if f in have]
    parts = []
    held = [df.select(*num).persist() for df in (base, cur)] if num else []  # rows, not rows x features
    if num:
        long = numeric_long(*held, num)
        names = spark.createDataFrame([(f,) for f in num], "feature string")
        sizes = sample_sizes(long)
        n = (names.join(psi(long, sizes=sizes), "feature", "left")
             .join(ks(long), "feature", "left")
             .select("feature", F.lit("numeric").alias("feature_type"), "psi", "ks_stat", "p_value",
                     F.lit(None).cast("double").alias("js_divergence")))
        parts.append(n)
    if cat:
        parts.append(jensen_shannon(base, cur, cat).select(
            "feature", F.lit("categorical").alias("feature_type"), F.lit(None).cast("double").alias("psi"),
            F.lit(None).cast("double").alias("ks_stat"), F.lit(None).cast("double").alias("p_value"),
            "js_divergence"))
    missing = [f for f in list(expected) + list(numeric) + list(categorical) if f not in have]
    if missing:
        parts.append(spark.createDataFrame(
            [(f, "missing", None, None, None, None) for f in dict.fromkeys(missing)],
            "feature string, feature_type string, psi double, ks_stat double, p_value double, "
            "js_divergence double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = materialize(out)  # one row per feature
    for df in held:
        df.unpersist()
    return out.withColumn("alert", F.when(F.col("feature_type") == "missing", F.lit(None))
                          .otherwise(drift_alert(F.col("psi"), F.col("js_divergence"), F.col("p_value"))))


def unseen_category_rate(base: DataFrame, cur: DataFrame, features: Sequence[str],
                         alert_rate: float = 0.05) -> DataFrame:
    """F8 (+J8): share of current rows whose category is absent from the
    baseline vocabulary, via an anti join on (feature, value).  The current
    rows are counted by category first: what is joined is as small as the vocabularies."""
    bl = unpivot(base.select(*[missing_as(f"`{f}`").alias(f) for f in features]), features, "STRING", "base")
    cl = unpivot(cur.select(*[missing_as(f"`{f}`").alias(f) for f in features]), features, "STRING", "current")
    vocab = bl.select("feature", "value").distinct()
    counts = cl.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    unseen = counts.join(vocab, ["feature", "value"], "left_anti").groupBy("feature").agg(F.sum("n").alias("unseen_rows"))
    tot = counts.groupBy("feature").agg(F.sum("n").alias("rows"))
    return (tot.join(unseen, "feature", "left").na.fill(0, ["unseen_rows"])
            .withColumn("unseen_rate", F.col("unseen_rows") / F.col("rows"))
            .withColumn("alert", F.col("unseen_rate") > F.lit(alert_rate)))



def psi_from_window_counts(counts: DataFrame, baseline_shares: dict[int, float], n_bins: int,
                           window_col: str = "window_start") -> DataFrame:
    """PSI per window from (window, bucket, n) counts, e.g. the output of
    the sliding-window stream, against the baseline share of each bin (a
    handful of numbers).  Missing bins count 0; shares are eps-clipped."""
    tot = counts.groupBy(window_col).agg(F.sum("n").alias("__total"))
    dense = (tot.select(window_col, "__total", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bucket"))
             .join(counts.select(window_col, "bucket", "n"), [window_col, "bucket"], "left").na.fill(0, ["n"]))
    ep = F.lit(None).cast("double")
    for b in range(n_bins - 1, -1, -1):
        ep = F.when(F.col("bucket") == b, F.lit(max(baseline_shares.get(b, 0.0), C.PSI_EPS))).otherwise(ep)
    ap = F.greatest(F.col("n") / F.col("__total"), F.lit(C.PSI_EPS))
    return (dense.withColumn("__ep", ep).groupBy(window_col, "__total")
            .agg(F.sum((ap - F.col("__ep")) * F.log(ap / F.col("__ep"))).alias("psi"))
            .withColumnRenamed("__total", "rows"))
