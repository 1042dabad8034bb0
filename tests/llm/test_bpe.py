import base64
import hashlib
import random
import struct

import public_tokenizers as P
import pytest
import tiktoken

from conftest import SF_SMALL
from llm_cases import awkward, awkward_rows, empty, rows_of, save, with_clashes
from rebound.llm import bpe

STRANGE = ["", " ", "  ", "\n\n \t x", "don't  I'll 'S 's", "a\x00b\x1c\x1d\x85\xa0c d　", "<unk><s></s><|endoftext|>", "▁▁ ▁x", "🙂🙃 𝒳𝒴 नमस्ते مرحبا 東京都",
           "ﬁ é é ½ ² Ⅷ ٣", "x" * 5000, "ab" * 3000 + " " * 700 + "!?" * 400, "1234567890" * 30, "\r\n" * 50, "_" * 99, "﻿bom�"]


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.VOCABULARY), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def rand_text(rng):
    return "".join(rng.choice(["the ", "ing", "  ", "\n", "é", "🙂", "'s", "12", "東", "Zx", "\t", ".", "­", "ß", "ñ"]) for _ in range(rng.randrange(80)))


def test_ids_equal_the_rank_files_own_library():
    enc, codec, rng = reference(), bpe.open_codec(), random.Random(4)
    for t in STRANGE + [rand_text(rng) for _ in range(500)]:
        ids = codec.encode(t)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == enc.encode_ordinary(t), t[:50]
        assert codec.decode(ids) == t.encode()


def test_every_single_token_and_byte_survives():
    codec = bpe.open_codec()
    codec._open()
    assert codec.size == 50256 and sorted(len(t) for t in codec.table)[0] == 1 and len({t for t in codec.table if len(t) == 1}) == 256
    assert codec.decode(struct.pack("<256I", *(codec.known[bytes([b])] for b in range(256)))) == bytes(range(256))


def test_cache_bound_changes_nothing(monkeypatch):
    a, b = bpe.open_codec(), bpe.open_codec()
    texts = [rand_text(random.Random(i)) for i in range(50)]
    want = [a.encode(t) for t in texts]
    monkeypatch.setattr(bpe, "CACHE", 3)
    assert [b.encode(t) for t in texts] == want and len(b) <= 3


def test_query_on_documents_awkward_and_empty(spark, tmp_path):
    enc = reference()
    rows = awkward_rows() + [(1000 + i, t, "en", "s", 1) for i, t in enumerate(STRANGE)]
    rows += [(5000 + r["doc_id"], r["text"], "en", "s", 1) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, awkward(spark).schema)
    got = rows_of(bpe.op7_sentencepiece_bpe(spark, save(spark, with_clashes(docs), tmp_path / "a")))
    want = []
    for i, t, *_ in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.op7_sentencepiece_bpe(spark, save(spark, empty(spark), tmp_path / "e")).count() == 0


def test_columns_round_trip(spark):
    codec = bpe.open_codec()
    out = bpe.decode(bpe.encode(with_clashes(awkward(spark)), codec), codec)
    for r in out.collect():
        assert bytes(r["decoded"]).decode() == (r["text"] or "")


def test_damaged_rank_file(tmp_path):
    (tmp_path / "r").write_bytes(b"YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        bpe.read_ranks(str(tmp_path / "r"))
