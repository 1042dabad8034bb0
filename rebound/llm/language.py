"""Language ID by averaged hashed subword embeddings and a linear softmax (operator 3).

A text is lower-cased, runs of non-letters become one blank, and every run of
1 to 4 characters is hashed into a bucket.  The model is an embedding per
bucket, their mean over the text, and a softmax layer, trained together by
stochastic gradient descent in numpy on a bounded sample of labelled rows.
Since both layers are linear, prediction adds up one product row per subword.
A temperature fitted on rows kept from training calibrates the scores; it never
sharpens them more than twofold, as on rows that are all told apart the fit would
run to any lower end.  Two bounds reject a text.  The score must reach the calibration score that all but
a stated share of correctly labelled rows reach, but never more than 1.5 / labels
is asked: on about 800 calibration rows the quantile is close to the least of
them, and asking for it would drop clean documents.  And the largest logit must
reach a quarter of what all but the same share of those rows reach (short clean texts
go down to half of it): subwords never seen in training add next to nothing, so
most text in an unlearned script fails here however the softmax divides it.  A language that shares its subwords with a
learned one is not told apart by either bound.

The fit sees at most ``Fit.per_label`` rows of each label (documented bound;
the rows of smallest hashed id) and only text and label.  Prediction runs over
whole texts, in the scan's own partitions, without a shuffle.

Edge cases: a null text, or one without a letter, is ``und`` with score 0 and
rejected; texts of any length are read whole, in pieces; equal texts get equal
results; with no labelled row at all every text is ``und``; other columns are
kept by ``identify`` unless they clash with its own, which replace them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

from rebound.llm.words import chunks, utf8

UNDETERMINED = "und"
#: Characters worked on at once.
PIECE = 1 << 20
#: Subword lengths in characters.
GRAMS = (1, 2, 3, 4)


@dataclass(frozen=True)
class Fit:
    """Bounds and settings of a fit."""

    per_label: int = 1000        # labelled rows of each label, for training and calibration together
    sample_chars: int = 2_000_000  # subwords of a label's rows beyond this are not needed; later rows are left out
    buckets: int = 1 << 16
    dim: int = 16
    epochs: int = 12
    batch: int = 32
    rate: float = 0.5
    seed: int = 11
    calibration_share: float = 0.25
    reject_share: float = 0.0005  # of calibration rows may fall under the threshold


def _letter_table() -> np.ndarray:
    """Code point -> itself if a letter, else a blank (first plane; others count as letters if Python says so)."""
    table = np.arange(1 << 16, dtype=np.uint32)
    table[[not chr(c).isalpha() for c in range(1 << 16)]] = 32
    return table


_LETTERS: list = []


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text: letters, with one blank before, between and after runs of them."""
    if not _LETTERS:
        _LETTERS.append(_letter_table())
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    high = codes >= 1 << 16
    out = _LETTERS[0][np.where(high, 32, codes)]
    if high.any():
        out[high] = [c if chr(c).isalpha() else 32 for c in codes[high].tolist()]
    out = np.concatenate([[32], out, [32]]).astype(np.uint32)
    return out[np.r_[True, (out[1:] != 32) | (out[:-1] != 32)]]


def subwords(codes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of every run of 1 to 4 characters that is more than a blank."""
    found = []
    h = np.zeros(len(codes), np.uint32)
    for n in GRAMS:
        m = len(codes) - n + 1
        if m < 1:
            break
        h = (h[:m] * np.uint32(0x01000193)) ^ (codes[n - 1:] * np.uint32(0x9E3779B1))
        x = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        x = (x ^ (x >> np.uint32(13))) & np.uint32(buckets - 1)
        found.append(x[codes[:m] != 32] if n == 1 else x)
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


@dataclass
class Model:
    labels: list
    table: np.ndarray     # buckets x labels: embedding times softmax layer
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    evidence: float = 0.0  # least top logit

    def logits(self, text: str) -> np.ndarray | None:
        """Mean product row over all subwords of a whole text, piece by piece; None without a letter."""
        codes = letters(text)
        if not (codes != 32).any():
            return None
        total, n = np.zeros(len(self.labels)), 0
        reach = max(GRAMS) - 1
        for a in range(0, len(codes), PIECE):
            piece = codes[a:a + PIECE + reach]
            ids = subwords(piece, len(self.table))
            total += self.table[ids].sum(0, dtype=np.float64)
            n += len(ids)
        return total / n + self.bias

    def scores(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True)


def _chance(x: int, seed: int) -> float:
    """A number in [0, 1) from an integer: splits rows without a generator's state."""
    return ((x * 2654435761 + seed * 40503) % (1 << 32)) / (1 << 32)


def train(texts: list, names: list, fit: Fit) -> Model | None:
    """Fits embeddings, softmax, temperature and threshold; None if no row has a letter."""
    held: dict = {}
    bags, y = [], []
    labels = sorted(set(names))
    for text, name in zip(texts, names):
        codes = letters(text)
        if held.get(name, 0) > fit.sample_chars or not (codes != 32).any():
            continue
        held[name] = held.get(name, 0) + len(codes)
        ids, counts = np.unique(subwords(codes, fit.buckets), return_counts=True)
        bags.append((ids, (counts / counts.sum()).astype(np.float32)))
        y.append(labels.index(name))
    labels_seen = sorted(set(y))
    if not labels_seen:
        return None
    rng = np.random.default_rng(fit.seed)
    k, y = len(labels), np.array(y)
    emb = rng.normal(0, 1 / np.sqrt(fit.dim), (fit.buckets, fit.dim)).astype(np.float32)
    out = np.zeros((fit.dim, k), np.float32)
    bias = np.zeros(k, np.float32)
    keep = np.array([_chance(i + 1, fit.seed) >= fit.calibration_share for i in range(len(y))])
    rows = np.flatnonzero(keep) if keep.any() else np.arange(len(y))
    weight = np.zeros(k, np.float32)
    for c in labels_seen:  # equal pull of each label, however many rows it has
        weight[c] = len(rows) / (len(labels_seen) * max(1, (y[rows] == c).sum()))
    steps = max(1, fit.epochs * -(-len(rows) // fit.batch))
    step = 0
    for _ in range(fit.epochs):
        rng.shuffle(rows)
        for a in range(0, len(rows), fit.batch):
            own = rows[a:a + fit.batch]
            rate = fit.rate * (1 - step / steps)
            step += 1
            mean = np.stack([bags[i][1] @ emb[bags[i][0]] for i in own])
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), y[own]] -= 1
            p *= weight[y[own], None] / len(own)
            back = p @ out.T
            out -= rate * 20 * (mean.T @ p)
            bias -= rate * p.sum(0)
            for i, g in zip(own, back):
                ids, w = bags[i]
                emb[ids] -= rate * 200 * w[:, None] * g
    model = Model(labels, (emb @ out).astype(np.float32), bias.astype(np.float64))
    check = np.flatnonzero(~keep) if (~keep).any() else rows
    z = np.stack([bags[i][1].astype(np.float64) @ model.table[bags[i][0]] for i in check]) + model.bias
    best = (np.inf, 1.0)
    for t in np.geomspace(0.5, 20, 40):
        model.temperature = t
        loss = -np.log(np.maximum(model.scores(z)[np.arange(len(check)), y[check]], 1e-12)).mean()
        best = min(best, (loss, float(t)))
    model.temperature = best[1]
    s = model.scores(z)
    right = s.argmax(1) == y[check]

    def floor(values):
        values = np.sort(values[right])
        return float(values[int(fit.reject_share * len(values))]) if len(values) else 0.0

    model.threshold = min(floor(s.max(1)), 1.5 / k)
    model.evidence = max(0.0, floor(z.max(1)) / 4)
    return model


def sample(docs: DataFrame, fit: Fit, usable: Column) -> tuple[list, list]:
    """Texts and labels of at most ``fit.per_label`` usable rows of each label, by smallest hashed id.

    The bound per label is found on (label, hash) alone; texts are read only
    for the rows inside it.
    """
    key = F.xxhash64(F.lit(fit.seed), F.col("doc_id"), F.octet_length("text"))
    rows = docs.where(usable & F.col("text").isNotNull() & F.col("lang").isNotNull()).withColumn("_h", key)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("_h"))
    bound = (rows.select("lang", "_h").withColumn("_n", nth).where(F.col("_n") <= fit.per_label)
             .groupBy("lang").agg(F.max("_h").alias("_top")).collect())  # one row per language
    if not bound:
        return [], []
    inside = F.lit(False)
    for r in bound:
        inside = inside | ((F.col("lang") == r["lang"]) & (F.col("_h") <= r["_top"]))
    got = rows.where(inside).select("_h", "lang", "text").toArrow().to_pylist()
    got.sort(key=lambda r: (r["_h"], r["lang"], r["text"]))
    return [r["text"] for r in got], [r["lang"] for r in got]


def fit_model(docs: DataFrame, fit: Fit = Fit(), usable: Column | None = None) -> Model | None:
    """A model from the usable labelled rows of ``docs`` (doc_id, text, lang)."""
    texts, names = sample(docs, fit, F.lit(True) if usable is None else usable)
    return train(texts, names, fit) if texts else None


_KINDS = {"lang_pred": pa.string(), "score": pa.float64(), "rejected": pa.bool_()}


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with lang_pred, score and rejected for every row."""
    rest = docs.drop(*_KINDS)
    schema = StructType(list(rest.schema.fields)).add("lang_pred", StringType()).add("score", DoubleType()).add("rejected", BooleanType())

    def predict(batches):
        for batch in batches:
            texts = utf8(batch["text"])
            for a, b in chunks(texts):
                got: tuple = ([], [], [])
                for t in texts[a:b]:
                    z = model.logits(t.decode("utf-8", "replace")) if model is not None and t is not None else None
                    p = None if z is None else model.scores(z)
                    c = 0 if z is None else int(p.argmax())
                    for col, v in zip(got, (UNDETERMINED, 0.0, True) if z is None else (model.labels[c], float(p[c]), bool(p[c] < model.threshold or z[c] < model.evidence))):
                        col.append(v)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(v, k) for v, k in zip(got, _KINDS.values()))],
                                                 names=[*part.schema.names, *_KINDS])

    return rest.mapInArrow(predict, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is held out of learning: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op3_subword_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learned from the rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit_model(docs, usable=~held_out())
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op3_subword_language": (op3_subword_language, None)}
