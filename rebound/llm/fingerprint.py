"""SimHash fingerprints and their search by permuted block tables (operator 9).

Terms are runs of five words (a shorter text is one term), weighted by how
often they occur; each term's 64-bit hash votes with its weight for or against
every bit of the fingerprint.  Fingerprints within a Hamming radius are found
through tables that bring different choices of bit blocks to the front: with
radius + 2 blocks, any two such fingerprints agree on two whole blocks, so a
table for each pair of blocks, joined on those bits, misses none.

Edited texts need each document's successor in descending id order.  Documents
are range-partitioned by id once; a task walks its sorted rows with one row of
look-ahead, and only the first and last row of each task go on to a second,
small step that joins them across task borders.

Edge cases: a null text is the empty text, whose fingerprint is all zeros;
texts are read whole; rows that share an id follow each other in the order of
their texts; null ids come last; a table of one row is its own successor; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rebound.llm.words import CHUNK_BYTES, shingles, utf8, word_hashes
from rebound.session import materialize

#: Words in a term.
TERM_WORDS = 5
RADIUS = 3


def fingerprints(texts: list) -> np.ndarray:
    """64-bit SimHash of each text (UTF-8 bytes)."""
    flat, offsets = word_hashes(texts)
    terms, at = shingles(flat, offsets, TERM_WORDS)
    out = np.zeros(len(texts), np.uint64)
    own = np.flatnonzero(np.diff(at))
    if len(own):
        bits = np.unpackbits(terms.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, at[own], axis=0, dtype=np.int32)  # a term's weight is how often it is counted here
        won = ones * 2 > np.diff(at)[own][:, None]
        out[own] = np.packbits(won, axis=1).view(">u8").ravel()
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits."""
    return 1.0 - np.bitwise_count(a ^ b) / 64.0


def edited(text: str, after: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``after``."""
    k = len(text) // 2
    return text[:len(text) - k] + after[:k]


_DONE, _LAST, _HEAD = 0, 1, 2
_SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fp long, edited_fp long, near_edited double, near_next double, "
           "pid int, kind int, text binary")
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]
_ARROW = dict(zip(_NAMES, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.binary())))


def _batch(columns: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in _ARROW.items()], names=_NAMES)


def _compare(ids: list, texts: list, after: list, fps: np.ndarray, next_fps: np.ndarray, pid: int) -> pa.RecordBatch:
    """Finished rows of documents whose successors are known."""
    plain = [t.decode("utf-8", "replace") for t in texts]
    # a successor is only read as far as the longest possible half reaches
    changed = [edited(t, n[:4 * len(t)].decode("utf-8", "ignore")).encode() for t, n in zip(plain, after)]
    e = fingerprints(changed)
    return _batch({"doc_id": ids, "n_chars": [len(t) for t in plain], "edited_sha256": [hashlib.sha256(t).hexdigest() for t in changed],
                   "fp": fps.view(np.int64), "edited_fp": e.view(np.int64), "near_edited": likeness(fps, e), "near_next": likeness(fps, next_fps),
                   "pid": [pid] * len(ids), "kind": [_DONE] * len(ids)}, len(ids))


def _walk(batches):
    """Rows of a task in descending order of id, each compared with its successor; border rows are passed on."""
    pid = TaskContext.get().partitionId()
    ids, texts, held = [], [], 0
    head = True

    def finish(last: bool):
        """Compares all held rows but the last with their successors; keeps or passes on the last."""
        nonlocal ids, texts, held, head
        fps = fingerprints(texts)
        if head:
            yield _batch({"doc_id": ids[:1], "fp": fps[:1].view(np.int64), "pid": [pid], "kind": [_HEAD], "text": texts[:1]}, 1)
            head = False
        if len(ids) > 1:
            yield _compare(ids[:-1], texts[:-1], texts[1:], fps[:-1], fps[1:], pid)
        if last:
            yield _batch({"doc_id": ids[-1:], "fp": fps[-1:].view(np.int64), "pid": [pid], "kind": [_LAST], "text": texts[-1:]}, 1)
        ids, texts, held = ids[-1:], texts[-1:], len(texts[-1])

    for batch in batches:
        for i, t in zip(batch["doc_id"].to_pylist(), utf8(batch["text"])):
            ids.append(i)
            texts.append(t or b"")
            held += len(texts[-1])
            if held >= CHUNK_BYTES and len(ids) > 1:
                yield from finish(False)
    if ids:
        yield from finish(True)


def _borders(batches):
    """Finishes each task's last row with the first row of the next task."""
    for batch in batches:
        if batch.num_rows:
            c = {k: batch[k] for k in ("doc_id", "pid")}
            fps, nxt = (batch[k].to_numpy().view(np.uint64) for k in ("fp", "next_fp"))
            texts, after = batch["text"].to_pylist(), batch["next_text"].to_pylist()
            for i in range(batch.num_rows):
                yield _compare([c["doc_id"][i].as_py()], texts[i:i + 1], after[i:i + 1], fps[i:i + 1], nxt[i:i + 1], c["pid"][i].as_py())


def compare_with_next(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next) of every row of (doc_id, text)."""
    by = F.col("doc_id").desc_nulls_last()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranged = own.repartitionByRange(partitions, by) if partitions else own.repartitionByRange(by)
    walked = materialize(ranged.sortWithinPartitions(by, F.col("text").asc_nulls_first()).mapInArrow(_walk, _SCHEMA))
    heads = walked.where(F.col("kind") == _HEAD)
    order = Window.orderBy("pid")  # one row a task
    follow = heads.select("pid").withColumn("next", F.lead("pid").over(order)).withColumn("next", F.coalesce("next", F.min("pid").over(Window.partitionBy())))
    last = (walked.where(F.col("kind") == _LAST).select("doc_id", "fp", "pid", "text").join(follow, "pid")
            .join(heads.select(F.col("pid").alias("next"), F.col("fp").alias("next_fp"), F.col("text").alias("next_text")), "next"))
    done = walked.where(F.col("kind") == _DONE).unionByName(last.mapInArrow(_borders, _SCHEMA))
    return done.drop("pid", "kind", "text")


def block_tables(fp: Column, radius: int = RADIUS) -> Column:
    """Array of (table, bits): the fingerprint's bits in each pair of its radius + 2 blocks."""
    n = radius + 2
    edge = [64 * i // n for i in range(n + 1)]
    masks = [((1 << edge[i + 1]) - (1 << edge[i])) | ((1 << edge[j + 1]) - (1 << edge[j])) for i, j in combinations(range(n), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*(F.struct(F.lit(t).alias("table"), fp.bitwiseAND(F.lit(m)).alias("bits")) for t, m in enumerate(signed)))


def within_radius(queries: DataFrame, fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(query, fp) for every query fingerprint and every fingerprint at most ``radius`` bits away; both sides distinct ``fp``s."""
    table = lambda df, name: df.select(F.col("fp").alias(name), F.explode(block_tables(F.col("fp"), radius)).alias("t")).select(name, "t.table", "t.bits")
    pairs = table(queries, "query").join(table(fps, "fp"), ["table", "bits"])
    return pairs.where(F.bit_count(F.col("query").bitwiseXOR(F.col("fp"))) <= radius).select("query", "fp").distinct()


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text; for ids divisible by 100 also how many other documents lie within 3 bits."""
    rows = materialize(compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    counts = rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    asked = rows.where(F.col("doc_id") % 100 == 0).select("fp").distinct()
    near = (within_radius(asked, counts.select("fp")).join(counts, "fp").groupBy("query").agg((F.sum("n") - 1).alias("n_within")))
    out = rows.join(near, (rows["fp"] == near["query"]) & (F.col("doc_id") % 100 == 0), "left")
    text = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return out.select("doc_id", "n_chars", "edited_sha256", text("fp").alias("fingerprint"), text("edited_fp").alias("edited_fingerprint"),
                      "near_edited", "near_next", "n_within")


QUERIES = {"op9_simhash": (op9_simhash, None)}
