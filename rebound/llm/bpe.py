"""Byte-level BPE encoding and decoding with a hand-serialised sentencepiece model (operator 7).

A rank file (base64 token, rank per line) becomes a sentencepiece BPE model
without any training: every token's bytes are mapped to printable characters,
one each, and the piece gets the score -rank, so that the merge of the smallest
rank comes first, as in the rank file's own library.  Normalisation is the
identity, with no dummy prefix, no blank folding and no escaping.  Texts are cut
into pre-tokens by the vocabulary's pattern, each is encoded by itself, and
decoding maps pieces back to bytes.

The driver reads the vocabulary once and ships the serialised model (about the
size of the rank file) with the function.  A worker remembers the ids of pre-tokens it has
seen, up to a bound.  Nothing is shuffled.

Edge cases: a null text is the empty text (no tokens); texts of any length are
encoded whole; strings of special tokens are ordinary text; repeated rows give
equal results; an empty table gives an empty result; other columns are ignored
by the query and kept by ``encode``.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BinaryType, LongType, StringType, StructType

from rebound.llm.words import utf8

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-tokens that a worker remembers.
CACHE = 300_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else from U+0100 on in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file, by rank (ranks must be 0, 1, 2, ...)."""
    with open(path, "rb") as f:
        pairs = [(int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, filter(bytes.strip, f))]
    pairs.sort()
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"{path}: ranks are not 0 to {len(pairs) - 1}")
    return [t for _, t in pairs]


def _varint(n: int) -> bytes:
    n &= 2**64 - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value) -> bytes:
    """A protobuf field: bytes and str by length, float as fixed 32 bits, int as varint."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece model whose piece i is token i, scored -i; the piece after the last is the unknown one."""
    char = byte_characters()
    pieces = [_field(1, _field(1, "".join(char[b] for b in t)) + _field(2, float(-i))) for i, t in enumerate(tokens)]
    unknown = _field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2))
    # Field numbers and enumerators of the public model format.
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + b"".join(_field(k, -1) for k in (41, 42, 43))
    normaliser = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + unknown + _field(2, trainer) + _field(3, normaliser)


class Codec(dict):
    """Encodes and decodes with a serialised model; as a dict, pre-token -> its ids as little-endian bytes."""

    def __init__(self, model: bytes, pattern: str):
        super().__init__()
        self.model, self.pattern = model, pattern
        self.pieces = None

    def __reduce__(self):
        return Codec, (self.model, self.pattern)

    def _open(self):
        if self.pieces is None:
            sp = sentencepiece.SentencePieceProcessor(model_proto=self.model)
            char = byte_characters()
            back = {c: b for b, c in enumerate(char)}
            self.size = sp.get_piece_size() - 1
            self.table = [bytes(back[c] for c in sp.id_to_piece(i)) for i in range(self.size)]
            self.known = {t: i for i, t in enumerate(self.table)}
            self.shown = {i: c for i, c in enumerate(char)}
            self.split = regex.compile(self.pattern).findall
            self.pieces = sp

    def __missing__(self, token: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        raw = token.encode("utf-8", "surrogatepass")
        ids = [self.known[raw]] if raw in self.known else self.pieces.encode(raw.decode("latin-1").translate(self.shown), out_type=int)
        packed = np.array(ids, "<u4").tobytes()
        if len(token) <= 64:  # longer ones rarely come again
            self[token] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Token ids of a whole text, as little-endian unsigned 32-bit integers."""
        self._open()
        return b"".join(map(self.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        """The bytes that packed ids stand for."""
        self._open()
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def open_codec(path: str | None = None, pattern: str | None = None) -> Codec:
    """A codec for a rank file (default: the 50k byte-level vocabulary)."""
    tokens = read_ranks(path or public_tokenizers.path(VOCABULARY))
    return Codec(serialise(tokens), pattern or public_tokenizers.PATTERN)


def encode(docs: DataFrame, codec: Codec, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the packed token ids of a text column (replacing a column of that name)."""
    rest = docs.drop(ids)

    def run(batches):
        for batch in batches:
            packed = [codec.encode((t or b"").decode("utf-8", "replace")) for t in utf8(batch[text])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packed, pa.binary())], names=[*batch.schema.names, ids])

    return rest.mapInArrow(run, StructType(list(rest.schema.fields)).add(ids, BinaryType()))


def decode(rows: DataFrame, codec: Codec, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the bytes of packed ids (null for null)."""
    rest = rows.drop(out)

    def run(batches):
        for batch in batches:
            raw = [None if x is None else codec.decode(x) for x in batch[ids].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], names=[*batch.schema.names, out])

    return rest.mapInArrow(run, StructType(list(rest.schema.fields)).add(out, BinaryType()))


def token_digests(docs: DataFrame, codec: Codec) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes each text, decodes the ids, keeps digests only."""
    kind = docs.schema["doc_id"].dataType
    schema = StructType().add("doc_id", kind).add("n_tokens", LongType()).add("ids_sha256", StringType()).add("decoded_sha256", StringType())

    def run(batches):
        for batch in batches:
            n, a, b = [], [], []
            for t in utf8(batch["text"]):
                ids = codec.encode((t or b"").decode("utf-8", "replace"))
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                                             names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op7_sentencepiece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), open_codec())


QUERIES = {"op7_sentencepiece_bpe": (op7_sentencepiece_bpe, None)}
