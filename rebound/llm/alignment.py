"""Alignment of two tokenizers over a corpus by inverted pair bitmaps (operator 12).

Each text is encoded by a byte-level BPE (A, of space + text) and by a
sentencepiece model (B, which adds the space).  The byte offsets where tokens of
both end cut the tokens into groups; a group links each of its A tokens with
each of its B tokens.  The score of an id pair is the number of documents that
hold it linked.

Documents are numbered inside blocks, so that a block's bitmaps are small: for
every id pair of a block one compressed bitmap of its documents and, for those
that hold it more than once, the binary planes of the further links (plane k:
bit k of links - 1).  A bitmap is a sorted list of 16-bit numbers, or 8,192
bytes of bits where that is shorter.  The table of bitmaps is written once to
the shared folder.  Blocks hold different documents, so the OR of a pair's
bitmaps is popcounted block by block and summed: its documents; the planes
give its links (``pair_counts``).  The scores go back to the blocks that hold
the pair, and there each posting adds its score to its documents.

Texts are cut before a space that follows no space and precedes a character
that is no blank: tokens of both end there, and neither tokenizer looks across
(no piece of B has a space after another character; else whole texts are used).

A block is closed at 65,536 documents or about four million postings; it is the
largest thing one task holds besides a text.  A pair that a third of all
documents hold has one row in each block: counts are summed before they are
shuffled, and scores are joined by pair and a slice of its blocks.

Edge cases: a text that is null or empty, or whose A or B tokens do not spell
space + text, has no tokens (zeros and an empty ``groups_sha256``) and is in no
bitmap; texts of any length are encoded whole; every row is a document of its
own, whatever its id; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructType

from rebound.llm import prefix_bpe
from rebound.llm.words import chunks, utf8
from rebound.session import checkpoint_dir

PIECES = "piece_bpe_32k.model"
#: Documents that one block can number, and postings after which it is closed.
BLOCK, BLOCK_POSTINGS = 1 << 16, 4_000_000
#: Bytes of a bitmap kept as bits; shorter ones are lists of 16-bit numbers.
BITS = BLOCK // 8
#: Blocks of a pair whose scores are joined under one key.
SLICE = 4096
#: Units whose spelling is compared at once.
RUN = 4096
#: A group of more token pairs is counted by distinct ids.
WIDE = 4096
#: Where both tokenizers begin anew.
UNIT = re.compile(r"(?<! ) (?=\S)")
#: A space that does not begin a unit, or whose next character does not.
BLANKS = re.compile(r" (?:\s|$)")


def _expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place within the owner) for owners that have ``counts`` things each."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _summed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their values."""
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(value, first) if len(key) else value


class Units:
    """The aligned units of one run of texts, as flat arrays indexed by unit."""

    def __init__(self, a: list, b: list, sizes_a: np.ndarray, sizes_b: np.ndarray, names_a: list, names_b: list):
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        ids_a, ids_b = (np.fromiter(chain.from_iterable(x), np.int64, n.sum()) for x, n in ((a, n_a), (b, n_b)))
        end_a, end_b = np.cumsum(sizes_a[ids_a]), np.cumsum(sizes_b[ids_b])  # over all units: all their bytes agree
        both = end_b[np.searchsorted(end_b, end_a)] == end_a if len(end_b) else np.zeros(0, bool)  # the last ends are equal
        cut = end_a[both]
        group_a, group_b = np.cumsum(both) - both, np.searchsorted(cut, end_b)
        per_a, per_b = np.bincount(group_a, minlength=len(cut)), np.bincount(group_b, minlength=len(cut))
        unit = np.searchsorted(np.cumsum(n_a), np.cumsum(per_a), "left")  # of each group
        size = len(a)
        self.n_a, self.n_b, self.n_groups = n_a, n_b, np.bincount(unit, minlength=size)
        self.n_links = np.zeros(size, np.int64)
        np.add.at(self.n_links, unit, per_a * per_b)

        begin_a, begin_b = np.cumsum(per_a) - per_a, np.cumsum(per_b) - per_b
        links = np.where(per_a * per_b <= WIDE, per_a * per_b, 0)
        g, at = _expand(links)
        pair = ids_a[begin_a[g] + at // per_b[g]] << 32 | ids_b[begin_b[g] + at % per_b[g]]
        owner, times = unit[g], np.ones(len(g), np.int64)
        for g in np.flatnonzero(per_a * per_b > WIDE):
            (ia, ka), (ib, kb) = (np.unique(ids[b:b + n], return_counts=True) for ids, b, n in
                                  ((ids_a, begin_a[g], per_a[g]), (ids_b, begin_b[g], per_b[g])))
            pair = np.r_[pair, (ia[:, None] << 32 | ib).ravel()]
            owner, times = np.r_[owner, np.full(len(ia) * len(ib), unit[g])], np.r_[times, np.outer(ka, kb).ravel()]
        self.pairs, number = np.unique(pair, return_inverse=True)
        key, self.times = _summed(owner * len(self.pairs) + number, times)
        self.pair = key % max(1, len(self.pairs))
        self.n_pairs = np.bincount(key // max(1, len(self.pairs)), minlength=size)
        self.first_pair = np.cumsum(self.n_pairs) - self.n_pairs

        # a1,a2|b1;a3|b2,b3: every token with the sign after it, in order
        last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        last_a[np.cumsum(per_a) - 1], last_b[np.cumsum(per_b) - 1] = 1, 1
        place_a = np.arange(len(ids_a)) + begin_b[group_a]
        place_b = np.arange(len(ids_b)) + (begin_a + per_a)[group_b]
        spelled = np.empty(len(ids_a) + len(ids_b), object)
        spelled[place_a], spelled[place_b] = names_a[ids_a * 2 + last_a], names_b[ids_b * 2 + last_b]
        stop = np.cumsum(n_a + n_b).tolist()
        spelled = spelled.tolist()
        self.text = ["".join(spelled[x:y]) for x, y in zip([0, *stop], stop)]


class Aligner:
    """Encodes texts with both tokenizers; shipped with tasks."""

    def __init__(self, codec: prefix_bpe.PrefixCodec, model: bytes):
        self.codec, self.model, self.pieces = codec, model, None

    def __reduce__(self):
        return Aligner, (self.codec, self.model)

    def _open(self):
        if self.pieces is None:
            sp = sentencepiece.SentencePieceProcessor(model_proto=self.model)
            piece = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
            self.bytes_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(piece)]
            self.whole = any(re.search("[^▁]▁", p) for p in piece)
            tokens = self.codec.vocabulary.tokens
            self.sizes = tuple(np.array([len(t) for t in x]) for x in (tokens, self.bytes_b))
            self.names = tuple(np.array([f"{i}{sign}" for i in range(len(x)) for sign in signs], object)
                               for x, signs in ((tokens, ",|"), (self.bytes_b, ",;")))
            self.pieces = sp

    def cut(self, text: str) -> list[str]:
        """The units of space + text, each without its first space."""
        if self.whole:
            return [text]
        if not BLANKS.search(text := " " + text):
            return text.split(" ")[1:]
        first, *rest = UNIT.split(text)
        return [first[1:], *rest] if first else rest

    def align(self, texts: list[str]):
        """(document, unit and times of each unit, unit arrays, whether each text is spelled by both)."""
        self._open()
        cuts = [self.cut(t) if t else [] for t in texts]
        distinct = list(dict.fromkeys(chain.from_iterable(cuts)))
        fill = self.codec.tables.fill(distinct)
        b = self.pieces.encode(distinct, num_threads=1) if distinct else []
        spelled = self._spelled(distinct, b)
        kept = distinct if all(spelled) else [u for u, ok in zip(distinct, spelled) if ok]
        units = Units(list(map(fill.__getitem__, kept)), b if kept is distinct else [ids for ids, ok in zip(b, spelled) if ok], *self.sizes, *self.names)
        number = dict(zip(kept, range(len(kept))))
        whole = [bool(c) and all(u in number for u in c) for c in cuts] if len(kept) < len(distinct) else [bool(c) for c in cuts]
        return [list(map(number.__getitem__, c)) if ok else [] for c, ok in zip(cuts, whole)], units, whole

    def _spelled(self, units: list[str], b: list) -> list[bool]:
        """Whether the pieces of each unit spell space + unit: of a run of units at once, one by one where the run differs."""
        out: list = []
        for at in range(0, len(units), RUN):
            us, ids = units[at:at + RUN], b[at:at + RUN]
            flat, whole = list(chain.from_iterable(ids)), (" " + " ".join(us)).encode()
            same = b"".join(map(self.bytes_b.__getitem__, flat)) == whole
            if same:  # and cut at the same places
                long = np.fromiter(map(len, us if len(whole) == sum(map(len, us)) + len(us) else map(str.encode, us)), np.int64, len(us)) + 1
                ends = np.r_[0, np.cumsum(self.sizes[1][flat])][np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))]
                same = bool((ends == np.cumsum(long)).all())
            out += [True] * len(us) if same else [b"".join(map(self.bytes_b.__getitem__, x)) == b" " + u.encode() for u, x in zip(us, ids)]
        return out


def open_aligner(vocabulary: str | None = None, pieces: str | None = None) -> Aligner:
    """An aligner of two vocabulary files (defaults: the 50k byte-level one, the 32k one of pieces)."""
    with open(pieces or public_tokenizers.path(PIECES), "rb") as f:
        return Aligner(prefix_bpe.open_codec(vocabulary, added=False), f.read())


def pack(row: np.ndarray, low: np.ndarray, rows: int) -> pa.Array:
    """A bitmap for each of ``rows`` rows (sorted by row, then number; numbers below ``BLOCK``)."""
    n = np.bincount(row, minlength=rows)
    start = np.r_[0, np.cumsum(n)]
    flat, data = low.astype("<u2"), []
    done = 0
    for r in np.flatnonzero(n * 2 >= BITS):  # at most one in 4,096 postings
        bits = np.zeros(BLOCK, np.uint8)
        bits[low[start[r]:start[r + 1]]] = 1
        data += [flat[done:start[r]].tobytes(), np.packbits(bits, bitorder="little").tobytes()]
        done = start[r + 1]
    data.append(flat[done:].tobytes())
    offsets = np.r_[0, np.cumsum(np.minimum(n * 2, BITS))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(b"".join(data))])


def unpack(bitmaps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of every bit of ``pack``'s bitmaps, in no stated order."""
    size = np.diff(np.frombuffer(bitmaps.buffers()[1], np.int32)[bitmaps.offset:bitmaps.offset + len(bitmaps) + 1])
    base = np.frombuffer(bitmaps.buffers()[1], np.int32)[bitmaps.offset] if len(bitmaps) else 0
    data = np.frombuffer(bitmaps.buffers()[2] or b"", np.uint8)[base:base + size.sum()]
    bits = size == BITS
    row = np.repeat(np.arange(len(size)), size // 2)
    low = np.frombuffer(data.tobytes(), "<u2")
    plain = ~bits[row]
    rows, lows = [row[plain]], [low[plain].astype(np.int64)]
    start = np.cumsum(size) - size
    for r in np.flatnonzero(bits):
        here = np.flatnonzero(np.unpackbits(data[start[r]:start[r] + BITS], bitorder="little"))
        rows.append(np.full(len(here), r))
        lows.append(here)
    return np.concatenate(rows), np.concatenate(lows)


def popcount(bitmap: Column) -> Column:
    """The numbers in a bitmap."""
    return F.when(F.octet_length(bitmap) == BITS, F.bitmap_count(bitmap)).otherwise((F.octet_length(bitmap) / 2).cast("long"))


_DOC = [("n_a", LongType()), ("n_b", LongType()), ("n_groups", LongType()), ("n_links", LongType()), ("groups_sha256", StringType())]
_POSTING = [("pair", LongType()), ("docs", BinaryType()), ("planes", ArrayType(BinaryType()))]


class _Block:
    """Postings of the open block, closed into bitmaps."""

    def __init__(self, task: int):
        self.task, self.count = task, 0
        self.clear()

    def clear(self):
        self.docs, self.held, self.pair, self.low, self.times = 0, 0, [], [], []

    @property
    def number(self) -> int:
        return self.task << 32 | self.count

    def postings(self):
        """(pair, docs, planes) of every pair, and the next block begins."""
        pair, low, times = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.pair, self.low, self.times))
        order = np.argsort(pair, kind="stable")  # documents come in order
        pair, low, more = pair[order], low[order], times[order] - 1
        pairs, row = np.unique(pair, return_inverse=True)
        planes, owner = [], []
        for k in range(int(more.max(initial=0)).bit_length()):
            here = np.flatnonzero(more >> k & 1)
            planes.append(pack(row[here], low[here], len(pairs)))
            owner.append(np.arange(len(pairs)))
        depth = np.zeros(len(pairs), np.int64)
        if planes:  # plane after plane becomes pair after pair; a pair's planes end with its largest
            np.maximum.at(depth, row, np.ceil(np.log2(more + 1)).astype(np.int64))
            r, k = _expand(depth)
            planes = pa.concat_arrays(planes).take(pa.array(k * len(pairs) + r))
        else:
            planes = pa.array([], pa.binary())
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(depth)], pa.int32()), planes)
        out = pa.array(pairs), pack(row, low, len(pairs)), lists
        self.count += 1
        self.clear()
        return out


def invert(docs: DataFrame, aligner: Aligner, most_postings: int = BLOCK_POSTINGS, most_docs: int = BLOCK) -> DataFrame:
    """One row per document (block, low, doc_id, counts, groups_sha256) and one per block and id pair (block, pair, docs, planes)."""
    schema = StructType().add("block", LongType()).add("low", IntegerType()).add("doc_id", docs.schema["doc_id"].dataType)
    for name, kind in _DOC + _POSTING:
        schema.add(name, kind)
    keys = ["n_a", "n_b", "n_groups", "n_links"]

    def batch_of(n, **columns):
        kinds = {"block": pa.int64(), "low": pa.int32(), **dict.fromkeys(keys, pa.int64()), "groups_sha256": pa.string(),
                 "pair": pa.int64(), "docs": pa.binary(), "planes": pa.list_(pa.binary())}
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, kinds[c]) for c in schema.names], names=schema.names)

    def run(batches):
        block = _Block(TaskContext.get().partitionId())
        no_id = pa.nulls(0)

        def close():
            number = block.number
            pair, bitmaps, planes = block.postings()
            step = 20_000
            for at in range(0, len(pair), step):
                n = min(step, len(pair) - at)
                yield batch_of(n, block=pa.array(np.full(n, number)), doc_id=pa.nulls(n, no_id.type), pair=pair.slice(at, n), docs=bitmaps.slice(at, n), planes=planes.slice(at, n))

        for batch in batches:
            no_id = batch["doc_id"].slice(0, 0)
            raw = utf8(batch["text"])
            for x, y in chunks(raw):
                found, units, _ = aligner.align([(t or b"").decode("utf-8", "replace") for t in raw[x:y]])
                at = 0
                while at < len(found):
                    part = found[at:at + most_docs - block.docs]
                    n = len(part)
                    doc, unit = np.repeat(np.arange(n), [len(u) for u in part]), np.fromiter(chain.from_iterable(part), np.int64)
                    size = max(1, len(units.n_a))
                    key, times = _summed(doc * size + unit, np.ones(len(doc), np.int64))
                    doc, unit = key // size, key % size
                    sums = {}
                    for c in keys:
                        total = np.zeros(n, np.int64)
                        np.add.at(total, doc, getattr(units, c)[unit] * times)
                        sums[c] = pa.array(total)
                    digest = [hashlib.sha256("".join(map(units.text.__getitem__, u))[:-1].encode()).hexdigest() if u else "" for u in part]
                    yield batch_of(n, block=pa.array(np.full(n, block.number)), low=pa.array(np.arange(block.docs, block.docs + n), pa.int32()),
                                   doc_id=batch["doc_id"].slice(x + at, n), groups_sha256=pa.array(digest, pa.string()), **sums)
                    g, k = _expand(units.n_pairs[unit])
                    place = units.first_pair[unit[g]] + k
                    width = max(1, len(units.pairs))
                    key, links = _summed(doc[g] * width + units.pair[place], units.times[place] * times[g])
                    block.pair.append(units.pairs[key % width] if len(key) else key)
                    block.low.append(key // width + block.docs)
                    block.times.append(links)
                    block.held += len(key)
                    block.docs += n
                    at += n
                    if block.docs >= most_docs or block.held >= most_postings:
                        yield from close()
        yield from close()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pair_counts(postings: DataFrame) -> DataFrame:
    """(pair, slice, n_docs, n_links) of the bitmaps, by slices of a pair's blocks."""
    further = F.aggregate("planes", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(1).cast("long").alias("worth")),
                          lambda s, p: F.struct((s["sum"] + popcount(p) * s["worth"]).alias("sum"), (s["worth"] * 2).alias("worth")))["sum"]
    return postings.groupBy("pair", "slice").agg(F.sum(popcount(F.col("docs"))).alias("n_docs"),
                                                 F.sum(popcount(F.col("docs")) + further).alias("n_links"))


def pair_scores(counts: DataFrame) -> DataFrame:
    """(a, b, pair, n_docs, n_links, is_best) of every linked id pair; is_best: no pair of the A id has more documents."""
    total = counts.groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
    total = total.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "pair", "n_docs", "n_links")
    return (total.join(total.groupBy("a").agg(F.max("n_docs").alias("__most")), "a")
            .select("a", "b", "pair", "n_docs", "n_links", (F.col("n_docs") == F.col("__most")).alias("is_best")))


def _score_block(rows: pa.Table, scores: pa.Table) -> pa.Table:
    """The documents of one block with the sums that its postings return."""
    rows, scores = rows.combine_chunks(), scores.combine_chunks()
    is_doc = rows["pair"].is_null()
    docs, postings = rows.filter(is_doc), rows.filter(rows["pair"].is_valid())
    best, total = np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)
    if postings.num_rows:
        known = scores["scored"].to_numpy()
        order = np.argsort(known)
        at = order[np.searchsorted(known[order], postings["pair"].to_numpy())]
        count, top = scores["docs_of_pair"].to_numpy()[at], scores["best_of_a"].to_numpy(zero_copy_only=False)[at].astype(np.int64)
        planes = pa.concat_arrays(postings["planes"].chunks)
        depth = np.diff(planes.offsets.to_numpy())
        owner, place = _expand(depth)
        for bitmaps, row, worth in ((pa.concat_arrays(postings["docs"].chunks), np.arange(postings.num_rows), np.ones(postings.num_rows, np.int64)),
                                    (planes.flatten(), owner, 1 << place)):
            r, low = unpack(bitmaps)
            np.add.at(total, low, (worth * count[row])[r])
            np.add.at(best, low, (worth * top[row])[r])
    low = docs["low"].to_numpy()
    docs = docs.append_column("n_best", pa.array(best[low])).append_column("count_sum", pa.array(total[low]))
    return docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def align(spark: SparkSession, docs: DataFrame, aligner: Aligner, most_postings: int = BLOCK_POSTINGS, most_docs: int = BLOCK,
          slice_blocks: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """(documents with their counts and scores, scores of all id pairs)."""
    folder = f"{checkpoint_dir(spark)}/alignment-{uuid.uuid4().hex}"
    invert(docs, aligner, most_postings, most_docs).write.option("compression", "zstd").parquet(folder)
    rows = spark.read.parquet(folder)
    postings = rows.where(F.col("pair").isNotNull())
    blocks = rows.agg(F.count_distinct("block")).first()[0]
    sliced = postings.withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(blocks // slice_blocks + 1)).cast("int"))
    counts = pair_counts(sliced)
    scores = pair_scores(counts)
    there = counts.select("pair", "slice").join(scores.select("pair", "n_docs", "is_best"), "pair")
    returned = sliced.select("pair", "slice", "block").join(there, ["pair", "slice"]).select(
        F.col("block").alias("at_block"), F.col("pair").alias("scored"), F.col("n_docs").alias("docs_of_pair"), F.col("is_best").alias("best_of_a"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = (rows.groupBy("block").cogroup(returned.groupBy("at_block"))
           .applyInArrow(_score_block, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"))
    return out, scores


def op12_pair_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment of every document under the two public vocabularies."""
    return align(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), open_aligner())[0]


QUERIES = {"op12_pair_bitmaps": (op12_pair_bitmaps, None)}
