"""Secret scans with an incremental blob ledger (operator 6).

Every version of every text is addressed by the SHA-256 of its bytes (a blob).
The ledger, a Parquet table in shared storage, holds one row for each blob and
rule version that was ever scanned, findings or none.  A scan takes the blobs
that the ledger lacks under the current rule version, reads the text of each
once, from one of the paths that carry it, appends the findings, and joins the
ledger back to all paths.  Copies, and versions that a later snapshot still
holds, are never scanned again until the rules change.

Findings are spans in code points, end exclusive, by start and then by kind.

Edge cases: a null text is the empty blob; long texts are scanned whole; rows
that share a path and a blob are scanned once and reported each; a null path
is a path like others; an empty table gives an empty result and an empty
ledger; columns besides ``doc_id`` and ``text`` are kept by ``redact`` and
ignored by ``scan``.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rebound.llm.words import utf8
from rebound.session import checkpoint_dir

# The rules, each with its kind, pattern, the group that is measured, and its least length.
RULES = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 0, 18),
    ("hex", r"[0-9a-f]+", 0, 0, 16),
)
# What a text must hold for its rule to be tried at all: one fast pass over the batch.
HINTS = {"assign": r"(?i)(password|passwd|secret|token|api_?key)", "access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}"}

KINDS = tuple(r[0] for r in RULES)
#: Changes whenever a rule does, so that old findings are not reused.
RULE_VERSION = hashlib.sha256(repr(RULES).encode()).hexdigest()[:16]
LEDGER = "blob string, rule_version string, findings array<struct<kind:string,start:int,end:int>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def find_secrets(text: str, kinds=KINDS) -> list:
    """(kind, start, end) of every finding in a text, by start and kind."""
    found = []
    for nth, (kind, pattern, flags, group, least) in enumerate(RULES):
        if kind in kinds:
            # a run of hex digits is either long enough as a whole or not at all: look for long runs only
            rx = re.compile(r"[0-9a-f]{16,}" if kind == "hex" else pattern, flags)
            found += [(m.start(), nth, m.end()) for m in rx.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(KINDS[nth], start, end) for start, nth, end in sorted(found)]


def _scan(batches):
    for batch in batches:
        text = batch["text"]
        hits = {k: pc.fill_null(pc.match_substring_regex(text, HINTS[k]), False).to_pylist() for k in KINDS}
        rows = []
        for i, t in enumerate(utf8(text)):
            kinds = [k for k in KINDS if hits[k][i]]
            spans = find_secrets(t.decode("utf-8", "replace"), kinds) if kinds else []
            rows.append([dict(zip(("kind", "start", "end"), s)) for s in spans])
        yield pa.RecordBatch.from_arrays(
            [batch["blob"], pa.array([RULE_VERSION] * len(rows), pa.string()), pa.array(rows, pa.list_(_SPAN))],
            names=["blob", "rule_version", "findings"])


def blob_address(text: str = "text"):
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def ledger_rows(spark: SparkSession, ledger: str) -> DataFrame:
    """The ledger's rows under the current rules (empty if there is no ledger yet), one per blob: two scans at
    once may both append a blob that is new to them, with equal findings."""
    try:
        rows = spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], LEDGER)
    return rows.where(F.col("rule_version") == RULE_VERSION).dropDuplicates(["blob"])


def scan(docs: DataFrame, ledger: str) -> DataFrame:
    """(doc_id, blob, findings) of every row; blobs new to ``ledger`` are scanned and appended to it."""
    spark = docs.sparkSession
    paths = docs.select("doc_id", blob_address().alias("blob"))
    pending = (paths.groupBy("blob").agg(F.min("doc_id").alias("carrier"))
               .join(ledger_rows(spark, ledger).select("blob"), "blob", "left_anti"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), blob_address().alias("blob"))
    p = pending.select(F.col("blob").alias("new"), "carrier")
    todo = texts.join(p, F.col("doc_id").eqNullSafe(F.col("carrier")) & (F.col("blob") == F.col("new")), "left_semi")
    found = todo.select("blob", "text").mapInArrow(_scan, LEDGER).dropDuplicates(["blob"])
    found.write.mode("append").parquet(ledger)
    return paths.join(ledger_rows(spark, ledger).select("blob", "findings"), "blob").select("doc_id", "blob", "findings")


def new_ledger(spark: SparkSession) -> str:
    """A path for a fresh ledger in the shared folder."""
    return f"{checkpoint_dir(spark)}/secret-ledger-{uuid.uuid4().hex}"


def digests(found: DataFrame) -> DataFrame:
    """Counts by kind, the span list and its SHA-256, from ``scan``'s findings."""
    spans = F.array_join(F.transform("findings", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("findings", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(spans.cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))


def redact(docs: DataFrame, found: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span (overlapping ones as one) replaced, and ``n_chars`` of the new text if there is such a column.

    Rows without findings keep their text.
    """
    hits = (found.where(F.size("findings") > 0).select(F.col("doc_id").alias("_id"), F.col("blob").alias("_blob"), F.col("findings").alias("_f"))
            .dropDuplicates(["_id", "_blob"]))
    joined = docs.withColumn("_own", blob_address()).join(
        hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_blob")), "left")
    # Merge overlapping spans into (from, to) and keep the text between them.
    empty = F.array().cast("array<struct<a:int,b:int>>")
    merged = F.aggregate("_f", empty, lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["b"] >= s["start"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], s["end"]).alias("b")))))
        .otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("a"), s["end"].alias("b"))))))
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    cut = F.aggregate(merged, start, lambda acc, s: F.struct(
        F.concat(acc["done"], F.substring(F.col("text"), acc["at"] + 1, s["a"] - acc["at"]), F.lit(mark)).alias("done"), s["b"].alias("at")),
        lambda acc: F.concat(acc["done"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    out = joined.withColumn("text", F.when(F.col("_f").isNotNull() & F.col("text").isNotNull(), cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_f").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def op6_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, through a fresh ledger."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(scan(docs, new_ledger(spark)))


QUERIES = {"op6_blob_ledger": (op6_blob_ledger, None)}
