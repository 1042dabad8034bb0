"""Mixing sources to target weights by hierarchical budgeting (operator 1), DataFrame operations only.

The tree is domain > language > source.  A token budget flows down from the
root: at every node the children share it in proportion to their weights, no
child takes more than its subtree can give (its tokens x the epochs allowed),
and what a short child leaves is shared among its siblings, again by weight.
Only when all siblings are full does the shortage reach the next level up, so
siblings always come before ancestors.  A leaf with quota q over t tokens takes
floor(q / t) whole epochs, and of one more epoch the shortest prefix, in a
seeded order of that epoch, that covers what is left.

The documents themselves never move: the prefix of a leaf is described by its
last (hash, id) position, found by a histogram over hash cells and a window
over the one cell in which the prefix ends.  Selecting is then a filter against
a table of one row per leaf.

Edge cases: a null domain, language or source is the child ``unknown``; null,
empty and blank texts count no tokens (such rows come along with every whole
epoch of their leaf, and with a prefix that passes their place); rows that
share a doc_id share their place and are taken or left together; a null doc_id has a place
of its own; a child without a given weight gets the default weight, a weight
of 0 gets nothing; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rebound.llm.shard import md5_key
from rebound.session import materialize

#: A leaf's hash space is cut so that a cell holds about so many rows.
CELL_ROWS = 2_000
UNKNOWN = "unknown"
LEVELS = ("domain", "language", "source")


@dataclass(frozen=True)
class Mix:
    """Budget, weights and seed of a mixture; ``weights`` maps (level, name) to an integer."""

    share: float = 0.5            # of all tokens, unless tokens is given
    tokens: int | None = None
    max_epochs: int = 3
    seed: int = 7
    weights: dict = field(default_factory=dict)
    default_weight: int = 10

    def weight(self, level: str) -> Column:
        own = [(n, w) for (lv, n), w in sorted(self.weights.items()) if lv == level]
        out = F.lit(self.default_weight)
        for name, w in own:
            out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
        return out.cast("long")


#: Production mixture of the registered query: domains are the source families below.
MIX = Mix(weights={("domain", "web"): 3, ("domain", "books"): 4, ("domain", "code"): 3,
                   ("language", "en"): 5, ("language", "de"): 3, ("language", "fr"): 2, ("language", "es"): 4})


def source_domain(source: str = "source") -> Column:
    """Domain of a source: by its number, thirds of web, books and code; src0 is web."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("int")
    return F.when(number % 3 == 0, "web").when(number % 3 == 1, "books").when(number % 3 == 2, "code")


def _leaf_columns(docs: DataFrame, domain: Column | None) -> DataFrame:
    name = lambda c: F.coalesce(c.cast("string"), F.lit(UNKNOWN))
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.select("doc_id", name(source_domain() if domain is None else domain).alias("domain"),
                       name(F.col("lang")).alias("language"), name(F.col("source")).alias("source"), words.alias("tokens"))


def place(doc_id: Column, epoch: Column, seed: int) -> Column:
    """Position of a document in an epoch: 60 bits of a seeded hash."""
    return md5_key(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def _share(nodes: DataFrame, parent: list[str], given: Column, weight: Column) -> DataFrame:
    """Adds ``quota``: ``given`` tokens of the parent dealt to its children by weight, none over its ``cap``.

    Water filling without a loop: in order of cap / weight, the children that
    fill up form a prefix; the others share what is left by weight, whole
    tokens first and the rest by largest remainder.
    """
    name = LEVELS[len(parent)]
    order = Window.partitionBy(*parent).orderBy(F.col("fill"), F.col(name))
    every = Window.partitionBy(*parent)
    big = lambda c: c.cast("decimal(38,0)")
    n = (nodes.withColumn("w", weight).withColumn("given", big(given))
         .withColumn("fill", F.when(F.col("w") > 0, F.col("cap").cast("double") / F.col("w")).otherwise(F.lit(float("inf"))))
         .withColumn("capw", F.when(F.col("w") > 0, F.col("cap")).otherwise(0))
         .withColumn("caps_before", F.coalesce(F.sum("capw").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
         .withColumn("w_from", F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
         .withColumn("full", big(F.col("capw")) * F.col("w_from") <= F.col("w") * (F.col("given") - F.col("caps_before")))
         .withColumn("caps_full", F.sum(F.when(F.col("full"), F.col("capw")).otherwise(0)).over(every))
         .withColumn("w_open", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(every))
         .withColumn("open", F.greatest(F.lit(0), F.col("given") - F.col("caps_full")) * F.col("w"))
         .withColumn("whole", F.when(F.col("full"), F.col("capw")).when(F.col("w_open") > 0, F.expr("cast(open div w_open as bigint)")).otherwise(0))
         .withColumn("rest", F.when(F.col("full") | (F.col("w_open") == 0), F.lit(-1).cast("long")).otherwise((F.col("open") % F.col("w_open")).cast("long"))))
    n = (n.withColumn("spare", F.least(F.col("given"), F.sum("capw").over(every)) - F.sum("whole").over(every))
         .withColumn("nth", F.row_number().over(Window.partitionBy(*parent).orderBy(F.desc("rest"), F.col(name)))))
    return n.withColumn("quota", F.least(F.col("capw"), F.col("whole") + F.when((F.col("nth") <= F.col("spare")) & (F.col("rest") >= 0), 1).otherwise(0)).cast("long"))


def leaf_quotas(leaves: DataFrame, mix: Mix) -> DataFrame:
    """One row per leaf (domain, language, source, rows, avail) with its ``quota`` of tokens.

    The cap of a node is what its children of positive weight can take, bottom
    up, so no node is given tokens that it cannot place.
    The tables are as small as the tree; windows run per parent node.
    """
    leaves = leaves.withColumn("cap", F.col("avail") * mix.max_epochs)
    taken = lambda level: F.sum(F.when(mix.weight(level) > 0, F.col("cap")).otherwise(0)).alias("cap")
    langs = leaves.groupBy("domain", "language").agg(taken("source"), F.sum("avail").alias("avail"))
    total = F.sum("avail").over(Window.partitionBy())
    target = F.lit(mix.tokens).cast("long") if mix.tokens is not None else F.floor(F.col("total") * F.lit(mix.share))
    d = langs.groupBy("domain").agg(taken("language"), F.sum("avail").alias("avail")).withColumn("total", total)
    d = _share(d, [], target, mix.weight("domain")).select("domain", F.col("quota").alias("up"))
    lang = _share(langs.join(d, "domain"), ["domain"], F.col("up"), mix.weight("language")).select("domain", "language", F.col("quota").alias("up"))
    s = _share(leaves.join(lang, ["domain", "language"]), ["domain", "language"], F.col("up"), mix.weight("source"))
    return s.select(*LEVELS, "rows", "avail", "quota")


def plan_mix(docs: DataFrame, mix: Mix, domain: Column | None = None) -> DataFrame:
    """One row per leaf: quota, whole ``epochs`` and the last place (``cut``) of the partial one (-1: none)."""
    slim = materialize(_leaf_columns(docs, domain))
    leaves = slim.groupBy(*LEVELS).agg(F.count(F.lit(1)).alias("rows"), F.sum("tokens").alias("avail"))
    quotas = materialize(leaf_quotas(leaves, mix)
                         .withColumn("epochs", F.when(F.col("avail") > 0, F.expr("quota div avail")).otherwise(0).cast("int"))
                         .withColumn("rest", F.col("quota") - F.col("epochs") * F.col("avail"))
                         .withColumn("bits", F.greatest(F.lit(0), F.ceil(F.log2(F.col("rows") / F.lit(CELL_ROWS)))).cast("int")))
    part = quotas.where("rest > 0").select(*LEVELS, "epochs", "rest", "bits")
    placed = (_with_leaf(slim, part).withColumn("h", place(F.col("doc_id"), F.col("epochs"), mix.seed))
              .withColumn("cell", F.expr("shiftright(h, 60 - bits)")))
    cells = placed.groupBy(*LEVELS, "rest", "cell").agg(F.sum("tokens").alias("t"))
    upto = Window.partitionBy(*LEVELS).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    ends = (cells.withColumn("upto", F.sum("t").over(upto)).withColumn("before", F.col("upto") - F.col("t"))
            .where((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("upto"))).select(*LEVELS, "cell", "before"))
    inside = _with_leaf(placed, ends, [*LEVELS, "cell"]).groupBy(*LEVELS, "rest", "before", "h").agg(F.sum("tokens").alias("t"))
    run = F.sum("t").over(Window.partitionBy(*LEVELS).orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    cut = (inside.withColumn("upto", F.col("before") + run).where(F.col("upto") >= F.col("rest"))
           .groupBy(*LEVELS).agg(F.min("h").alias("cut")))
    return quotas.join(cut, list(LEVELS), "left").select(*LEVELS, "avail", "quota", "epochs", F.coalesce("cut", F.lit(-1).cast("long")).alias("cut"))


#: A table of one row per tree leaf is broadcast up to so many leaves; a larger one is joined by key.
BROADCAST_LEAVES = 100_000


def _with_leaf(rows: DataFrame, leaves: DataFrame, on=LEVELS) -> DataFrame:
    small = leaves.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES
    return rows.join(F.broadcast(leaves) if small else leaves, list(on))


def select_mix(docs: DataFrame, mix: Mix, domain: Column | None = None) -> DataFrame:
    """Rows of ``docs`` once per epoch that takes them, with an ``epoch`` column (leaf columns prefixed ``mix_``)."""
    name = lambda c: F.coalesce(c.cast("string"), F.lit(UNKNOWN))
    plan = materialize(plan_mix(docs, mix, domain)).select(
        *[F.col(c).alias(f"mix_{c}") for c in (*LEVELS, "quota", "epochs", "cut")])
    keyed = docs.withColumns({"mix_domain": name(source_domain() if domain is None else domain),
                              "mix_language": name(F.col("lang")), "mix_source": name(F.col("source"))})
    out = _with_leaf(keyed, plan, [f"mix_{c}" for c in LEVELS])
    taken = F.col("mix_epochs") + F.when(place(F.col("doc_id"), F.col("mix_epochs"), mix.seed) <= F.col("mix_cut"), 1).otherwise(0)
    return (out.withColumn("mix_taken", taken).where("mix_taken > 0")
            .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("mix_taken") - 1)))
            .drop("mix_epochs", "mix_cut", "mix_taken"))


def op1_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, epoch) that the production mixture takes, with its leaf and the leaf's quota."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return select_mix(docs, MIX).select(
        "doc_id", F.col("mix_domain").alias("domain"), F.col("mix_language").alias("language"), F.col("mix_source").alias("source"),
        "epoch", words.alias("tokens"), F.col("mix_quota").alias("quota"))


def _sql_level(name: str, nodes: str, parent: list[str], given: str, weights: str) -> str:
    """DuckDB twin of ``_share`` for one level."""
    p = ", ".join(parent)
    part = f"PARTITION BY {p} " if p else ""
    keys = ", ".join([*parent, LEVELS[len(parent)]])
    me = LEVELS[len(parent)]
    return f"""
{name}_a AS (SELECT *, {weights} AS w, CAST({given} AS HUGEINT) AS given FROM {nodes}),
{name}_b AS (SELECT *, CASE WHEN w > 0 THEN CAST(cap AS DOUBLE) / w ELSE CAST('inf' AS DOUBLE) END AS fill, CASE WHEN w > 0 THEN CAST(cap AS HUGEINT) ELSE 0 END AS capw FROM {name}_a),
{name}_c AS (SELECT *, COALESCE(sum(capw) OVER ({part}ORDER BY fill, {me} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps_before,
  sum(w) OVER ({part}ORDER BY fill, {me} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_from FROM {name}_b),
{name}_d AS (SELECT *, capw * w_from <= w * (given - caps_before) AS is_full FROM {name}_c),
{name}_e AS (SELECT *, sum(CASE WHEN is_full THEN capw ELSE 0 END) OVER ({part}) AS caps_full, sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({part}) AS w_open FROM {name}_d),
{name}_f AS (SELECT *, greatest(0, given - caps_full) * w AS op FROM {name}_e),
{name}_g AS (SELECT *, CASE WHEN is_full THEN capw WHEN w_open > 0 THEN op // w_open ELSE 0 END AS whole,
  CASE WHEN is_full OR w_open = 0 THEN -1 ELSE op % w_open END AS rest FROM {name}_f),
{name}_h AS (SELECT *, least(given, sum(capw) OVER ({part})) - sum(whole) OVER ({part}) AS spare,
  row_number() OVER ({part}ORDER BY rest DESC, {me}) AS nth FROM {name}_g),
{name} AS (SELECT {keys}, CAST(least(capw, whole + CASE WHEN nth <= spare AND rest >= 0 THEN 1 ELSE 0 END) AS BIGINT) AS quota FROM {name}_h)"""


def _sql_weight(mix: Mix, level: str) -> str:
    own = " ".join(f"WHEN '{n}' THEN {w}" for (lv, n), w in sorted(mix.weights.items()) if lv == level)
    return f"(CASE {level} {own} ELSE {mix.default_weight} END)" if own else str(mix.default_weight)


def mix_sql(mix: Mix, docs: str = "documents", columns: str = "doc_id, domain, language, source, epoch, tokens, quota") -> str:
    """DuckDB SQL of the same selection (``docs``: a table or subquery with documents' columns)."""
    target = str(mix.tokens) if mix.tokens is not None else f"floor(sum(sum(avail)) OVER () * {mix.share!r}::DOUBLE)"
    h = f"('0x' || substr(md5('{mix.seed}:' || epochs || ':' || COALESCE(CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT"
    return f"""
WITH doc AS (
  SELECT *, COALESCE(CASE TRY_CAST(NULLIF(regexp_extract(source_name, '([0-9]{{1,9}})$', 1), '') AS INTEGER) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'code' END, 'unknown') AS domain,
    COALESCE(lang_name, 'unknown') AS language, COALESCE(source_name, 'unknown') AS source,
    CAST(len(regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens
  FROM (SELECT doc_id, text, lang AS lang_name, source AS source_name, n_chars FROM {docs})),
leaves AS (SELECT domain, language, source, CAST(sum(tokens) AS BIGINT) AS avail, CAST(sum(tokens) * {mix.max_epochs} AS BIGINT) AS cap FROM doc GROUP BY ALL),
langs AS (SELECT domain, language, sum(avail) AS avail, sum(CASE WHEN {_sql_weight(mix, "source")} > 0 THEN cap ELSE 0 END) AS cap FROM leaves GROUP BY ALL),
top AS (SELECT domain, sum(CASE WHEN {_sql_weight(mix, "language")} > 0 THEN cap ELSE 0 END) AS cap, {target} AS total FROM langs GROUP BY domain),
{_sql_level("dq", "top", [], "total", _sql_weight(mix, "domain"))},
mid AS (SELECT domain, language, cap, dq.quota AS up FROM langs JOIN dq USING (domain)),
{_sql_level("lq", "mid", ["domain"], "up", _sql_weight(mix, "language"))},
low AS (SELECT leaves.*, lq.quota AS up FROM leaves JOIN lq USING (domain, language)),
{_sql_level("sq", "low", ["domain", "language"], "up", _sql_weight(mix, "source"))},
plan AS (SELECT domain, language, source, avail, quota, CASE WHEN avail > 0 THEN quota // avail ELSE 0 END AS epochs FROM sq JOIN leaves USING (domain, language, source)),
placed AS (SELECT doc.*, quota, epochs, quota - epochs * avail AS rest, {h} AS h FROM doc JOIN plan USING (domain, language, source)),
run AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, language, source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  - sum(tokens) OVER (PARTITION BY domain, language, source, h) AS before FROM placed),
taken AS (SELECT *, epochs + CASE WHEN before < rest THEN 1 ELSE 0 END AS n FROM run)
SELECT {columns} FROM (SELECT *, CAST(unnest(range(CAST(n AS BIGINT))) AS INTEGER) AS epoch FROM taken WHERE n > 0)
"""


QUERIES = {"op1_budget_mix": (op1_budget_mix, mix_sql(MIX))}
