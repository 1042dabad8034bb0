import hashlib
import json
import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from conftest import SF_SMALL
from llm_cases import awkward, awkward_rows, empty, rows_of, save, with_clashes
from rebound.llm import prefix_bpe as B
from test_bpe import STRANGE, rand_text

MORE = ["a<|endoftext|>b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "<|endoftext| >", "  <|endoftext|>  ", "x" * 70 + "y" * 500, "Ԥ𞥋 ࢏ ₝",
        "e" * 64, "é" * 65, "\x1c\x1d a \x85b", "1²½ Ⅷ", "�"]


def library():
    return Tokenizer.from_file(P.path(B.VOCABULARY))


def wild(rng):
    return "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x3000), rng.randrange(0xE000, 0x20000)])) for _ in range(rng.randrange(40)))


def test_ids_equal_the_library():
    tk, codec, rng = library(), B.open_codec(), random.Random(4)
    texts = STRANGE + MORE + [rand_text(rng) for _ in range(500)] + [wild(rng) for _ in range(1500)]
    for t, want, got in zip(texts, tk.encode_batch(texts, add_special_tokens=False), codec.encode_many(texts)):
        assert got == want.ids, t[:60]
        assert codec.decode(got) == tk.decode(got, skip_special_tokens=False) == t
    assert [codec.encode(t) for t in texts[:60]] == codec.encode_many(texts[:60])


def test_strings_of_added_tokens_as_plain_text():
    tk, codec = library(), B.open_codec(added=False)
    tk.encode_special_tokens = True
    for t in MORE:
        assert codec.encode(t) == tk.encode(t, add_special_tokens=False).ids


def test_decoding_broken_bytes_equals_the_library():
    tk, codec, rng = library(), B.open_codec(), random.Random(9)
    for _ in range(300):
        ids = [rng.randrange(50257) if rng.random() < 0.5 else rng.randrange(256) for _ in range(rng.randrange(12))]
        assert codec.decode(ids) == tk.decode(ids, skip_special_tokens=False)


def small(tmp_path, merges, **model):
    """A vocabulary file of all bytes and the given merges."""
    chars = B.byte_characters()
    vocab = {c: i for i, c in enumerate(chars)}
    for a, b in merges:
        vocab[a + b] = len(vocab)
    spec = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "post_processor": None,
            "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
            "decoder": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True},
            "model": {"type": "BPE", "vocab": vocab, "merges": [list(m) for m in merges], "dropout": None, "unk_token": None, **model}}
    path = tmp_path / "v.json"
    path.write_text(json.dumps(spec))
    return str(path)


@pytest.mark.parametrize("seed", range(12))
def test_random_vocabularies(tmp_path, seed):
    """Few letters and many merges: overlaps, repeated letters and tokens that cannot be reached."""
    rng = random.Random(seed)
    parts, merges = ["a", "b", "c"], []
    while len(merges) < 25:
        a, b = rng.choice(parts), rng.choice(parts)
        if a + b not in parts and len(a + b) < 9:
            parts.append(a + b)
            merges.append((a, b))
    path = small(tmp_path, merges)
    tk, codec = Tokenizer.from_file(path), B.open_codec(path)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(100))) for _ in range(300)] + ["a" * n for n in range(70)]
    for t, want, got in zip(texts, tk.encode_batch(texts, add_special_tokens=False), codec.encode_many(texts)):
        assert got == want.ids, (t, merges)


def test_other_rules_are_refused(tmp_path):
    for bad in ({"ignore_merges": True}, {"unk_token": "a"}, {"dropout": 0.1}):
        with pytest.raises(ValueError):
            B.read_vocabulary(small(tmp_path, [("a", "b")], **bad))
    with pytest.raises(ValueError):
        B.read_vocabulary(small(tmp_path, [("ab", "c"), ("a", "b")]))


def test_cache_bound_changes_nothing(monkeypatch):
    texts = [rand_text(random.Random(i)) for i in range(60)]
    want = B.open_codec().encode_many(texts)
    monkeypatch.setattr(B, "CACHE", 3)
    monkeypatch.setattr(B, "PAIRS", 4)
    monkeypatch.setattr(B, "_OPEN", {})
    assert [B.open_codec().encode(t) for t in texts] == want


def test_query_on_documents_awkward_and_empty(spark, tmp_path):
    tk = library()
    rows = awkward_rows() + [(1000 + i, t, "en", "s", 1) for i, t in enumerate(STRANGE + MORE)]
    rows += [(5000 + r["doc_id"], r["text"], "en", "s", 1) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, awkward(spark).schema)
    got = rows_of(B.op11_prefix_bpe(spark, save(spark, with_clashes(docs), tmp_path / "a")))
    want = []
    for i, t, *_ in rows:
        ids = tk.encode(t or "", add_special_tokens=False).ids
        text = tk.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert B.op11_prefix_bpe(spark, save(spark, empty(spark), tmp_path / "e")).count() == 0


def test_columns_round_trip(spark):
    codec = B.open_codec()
    out = B.decode(B.encode(with_clashes(awkward(spark)), codec), codec)
    for r in out.collect():
        assert r["decoded"] == (r["text"] or "") and r["score"] == "other"


def test_trie_finds_every_token_longest_first():
    """All reachable tokens at every end, as a plain search finds them; steps that share a slot included."""
    import random

    import numpy as np

    from rebound.llm import prefix_bpe as P
    tables = P.open_codec(added=False).tables
    rng = random.Random(4)
    words = ["".join(rng.choice(" abeinrst\x00ÿ") for _ in range(rng.randrange(1, 20))) for _ in range(300)] + [" ", "the", " international" * 12]
    text = P.SEPARATOR.join(words)
    end, token = tables._found(text)
    size, known = int(tables.size.max()), {k: v[0] for k, v in tables.known.items()}
    want = [(e, known[text[b:e + 1]]) for e in range(len(text)) for b in range(max(0, e + 1 - size), e + 1) if text[b:e + 1] in known]
    assert list(zip(end.tolist(), token.tolist())) == want
    assert [len(x) for x in tables._found("")] == [0, 0] and not tables._steps(np.array([0 << 8 | 256])).any()
