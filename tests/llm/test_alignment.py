import collections
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF_MID
from llm_cases import awkward, awkward_rows, empty, save, with_clashes
from rebound.llm import alignment as A
from rebound.llm.bpe import byte_characters
from test_bpe import STRANGE, rand_text
from test_prefix_bpe import MORE, wild


def brute(texts):
    """Tokens of both libraries, groups walked token by token, pairs counted in one dictionary."""
    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tk.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    back = {c: b for b, c in enumerate(byte_characters())}
    docs = []
    for t in texts:
        a, b = (tk.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)) if t else ([], [])
        bytes_a = [bytes(back[c] for c in tk.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or any(b"".join(x) != (" " + t).encode() for x in (bytes_a, bytes_b)):
            docs.append([])
            continue
        groups, at_a, at_b, group = [], 0, 0, ([], [])
        a, b = list(zip(a, map(len, bytes_a))), list(zip(b, map(len, bytes_b)))
        while a or b:
            if at_a <= at_b:
                i, n = a.pop(0)
                at_a += n
                group[0].append(i)
            else:
                i, n = b.pop(0)
                at_b += n
                group[1].append(i)
            if at_a == at_b:
                groups.append(group)
                group = ([], [])
        docs.append(groups)
    held = collections.Counter(p for gs in docs for p in {(x, y) for ga, gb in gs for x in ga for y in gb})
    top = collections.Counter()
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for gs in docs:
        links = [(x, y) for ga, gb in gs for x in ga for y in gb]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in gs)
        out.append((sum(len(g[0]) for g in gs), sum(len(g[1]) for g in gs), len(gs), len(links), sum(held[x] == top[x[0]] for x in links),
                    sum(held[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if gs else ""))
    return out, docs


def expected(rows):
    return sorted(((r[0], *w) for r, w in zip(rows, brute([r[1] for r in rows])[0])), key=repr)


def result(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect()), key=repr)


def strange_rows():
    rng = random.Random(8)
    texts = STRANGE + MORE + ["▁", "a ▁ b", " ", "  a", "a ", " a  b ", "<s>", "<0x41> <unk>", "a\n b\n  c", "東京 都 " * 30]
    texts += [rand_text(rng) for _ in range(80)] + [wild(rng) for _ in range(80)]
    return awkward_rows() + [(1000 + i, t, "en", "s", 1) for i, t in enumerate(texts)]


def test_query_equals_brute_force_awkward_and_empty(spark, tmp_path):
    rows = strange_rows()
    docs = spark.createDataFrame(rows, awkward(spark).schema)
    got = A.op12_pair_bitmaps(spark, save(spark, with_clashes(docs).withColumn("pair", F.lit(1)).withColumn("block", F.lit(1)).repartition(5), tmp_path / "a"))
    assert result(got) == expected(rows)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint",
                                "n_best": "bigint", "count_sum": "bigint", "groups_sha256": "string"}
    assert A.op12_pair_bitmaps(spark, save(spark, empty(spark), tmp_path / "e")).count() == 0


def test_query_equals_brute_force_on_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text").where("doc_id < 150").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(A.align(spark, df, A.open_aligner())[0]) == expected(rows)


def test_pair_scores_equal_counts(spark):
    rows = strange_rows()
    scores = A.align(spark, spark.createDataFrame(rows, awkward(spark).schema).repartition(4), A.open_aligner())[1].collect()
    docs, links = collections.Counter(), collections.Counter()
    for gs in brute([r[1] for r in rows])[1]:
        mine = collections.Counter((x, y) for ga, gb in gs for x in ga for y in gb)
        docs.update(mine.keys())
        links.update(mine)
    assert {(r["a"], r["b"]): (r["n_docs"], r["n_links"]) for r in scores} == {p: (n, links[p]) for p, n in docs.items()}


@pytest.mark.parametrize("postings,docs_a_block", [(50, 1 << 16), (10**9, 7)])
def test_small_blocks_change_nothing(spark, postings, docs_a_block):
    rows = strange_rows()
    df = spark.createDataFrame(rows, awkward(spark).schema).repartition(3)
    out = A.align(spark, df, A.open_aligner(), postings, docs_a_block, 2)[0]
    assert result(out) == expected(rows)


def test_bitmaps_round_trip():
    rng = np.random.default_rng(2)
    sets = [np.sort(rng.choice(A.BLOCK, n, replace=False)) for n in (0, 1, 4095, 4096, 4097, 30000, 0, 65536, 3)]
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    packed = A.pack(row, np.concatenate(sets), len(sets))
    assert max(len(b) for b in packed.to_pylist()) == A.BITS
    for bitmaps in (packed, packed.slice(2, 5), pa.concat_arrays([packed, packed])):
        r, low = A.unpack(bitmaps)
        for i, b in enumerate(bitmaps.to_pylist()):
            j = packed.to_pylist().index(b)
            assert np.array_equal(np.sort(low[r == i]), sets[j])


def test_popcount(spark):
    sets = [np.arange(n) * 3 % A.BLOCK for n in (0, 1, 4095, 4096, 20000)]
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    packed = A.pack(row, np.concatenate([np.sort(s) for s in sets]), len(sets)).to_pylist()
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(packed)], "i int, b binary")
    assert [r[0] for r in df.orderBy("i").select(A.popcount(F.col("b"))).collect()] == [0, 1, 4095, 4096, 20000]


def test_wide_groups_are_counted_by_distinct_ids(monkeypatch):
    aligner, texts = A.open_aligner(), ["🙂🙃" * 40 + "x", "東京都 " * 9, "नमस्ते" * 30]
    _, plain, _ = aligner.align(texts)
    monkeypatch.setattr(A, "WIDE", 3)
    _, wide, _ = aligner.align(texts)
    assert np.array_equal(plain.pairs, wide.pairs) and np.array_equal(plain.times, wide.times) and np.array_equal(plain.pair, wide.pair)


def test_whole_texts_and_units_give_the_same_groups():
    """What a model with spaces inside its pieces would need: no cutting at all."""
    units, whole = A.open_aligner(), A.open_aligner()
    whole._open()
    whole.whole = True
    for t in ["one two  three\nfour", "x y", " a ", "don't  stop\n now", "東京 都 🙂"]:
        spelled = []
        for aligner in (units, whole):
            found, flat, _ = aligner.align([t])
            spelled.append("".join(flat.text[i] for i in found[0]))
        assert spelled[0] == spelled[1] != ""


def test_units_and_spelling_in_runs(monkeypatch):
    """Blanks are cut as the expression cuts them, and one unit that pieces do not spell does not spoil its run."""
    import random

    from rebound.llm import alignment as A
    aligner = A.open_aligner()
    aligner._open()
    rng = random.Random(5)
    for _ in range(2000):
        text = "".join(rng.choice("ab  \n\té　") for _ in range(rng.randrange(1, 30)))
        first, *rest = A.UNIT.split(" " + text)
        assert aligner.cut(text) == ([first[1:], *rest] if first else rest)
    monkeypatch.setattr(A, "RUN", 3)
    units = ["one", "é", "two", "▁x", "three", "b", "c"]
    ids = aligner.pieces.encode(units, num_threads=1)
    assert aligner._spelled(units, ids) == [b"".join(map(aligner.bytes_b.__getitem__, x)) == b" " + u.encode() for u, x in zip(units, ids)]
    assert not aligner._spelled(["ab", "c"], [[*ids[5], *ids[5]], ids[6]])[0] and aligner._spelled([], []) == []
