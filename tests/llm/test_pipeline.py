import hashlib
import struct

import corpus_pipeline as P
from llm_cases import awkward, awkward_rows, empty, rows_of, save, with_clashes
from pyspark.sql import functions as F
from rebound.llm import language, mixing, secrets
from test_bpe import reference
from test_mixing import brute as sorted_prefixes
from test_overlap import brute as all_pairs
from test_secrets import plain

from conftest import SF_SMALL


def digest_rows(rows):
    enc, out = reference(), []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        out.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def hide(text):
    """Findings replaced from the end, overlapping ones as one."""
    spans = []
    for _, a, b in plain(text or ""):
        if spans and spans[-1][1] >= a:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    for a, b in reversed(spans):
        text = text[:a] + "[secret]" + text[b:]
    return text


def brute(spark, docs):
    """The stages one after the other on plain rows; only the language model is the operator's own."""
    rows = [tuple(r) for r in docs.select(P.COLUMNS).collect()]
    model = language.fit_model(docs)
    kept = []
    for r in rows:
        z = None if model is None or r[1] is None else model.logits(r[1])
        if z is None:
            continue
        p = model.scores(z)
        if p.max() >= model.threshold and z.max() >= model.evidence:
            kept.append((r[0], r[1], r[2] or model.labels[int(p.argmax())], r[3], r[4]))
    group = all_pairs(kept, 5, 4, 5)
    kept = [r for r in kept if r[0] is None or group[r[0]][1] == r[0]]
    kept = [(r[0], hide(r[1]), *r[2:]) for r in kept]
    left = spark.createDataFrame(kept, docs.select(P.COLUMNS).schema)
    plan = {(r["domain"], r["language"], r["source"]): (r["quota"], r["avail"]) for r in mixing.plan_mix(left, mixing.MIX).collect()}
    return digest_rows([(i, t) for i, t, _ in sorted_prefixes(kept, plan, mixing.MIX.seed)])


def test_run_equals_brute_force(spark):
    got = rows_of(P.run(spark, SF_SMALL))
    assert got == brute(spark, spark.read.parquet(f"{SF_SMALL}/documents.parquet"))


def test_run_on_awkward_rows_and_none(spark, tmp_path):
    docs = with_clashes(awkward(spark))
    assert rows_of(P.run(spark, save(spark, docs, tmp_path / "a"))) == brute(spark, docs)
    assert P.run(spark, save(spark, empty(spark), tmp_path / "e")).count() == 0


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for name, stage in P.STAGES[:4]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == P.COLUMNS
        if name in ("language_id", "secrets"):
            assert out.count() >= 0.99 * docs.count()
    assert len(P.STAGES) == 5 and P.STAGES[-1][1](spark, docs, "").count() == docs.count()


def test_secrets_are_gone_after_their_stage(spark):
    docs = awkward(spark)
    out = P.hide_secrets(spark, docs, "")
    assert out.count() == len(awkward_rows())
    found = secrets.digests(secrets.scan(out, secrets.new_ledger(spark))).agg(F.sum("n_access"), F.sum("n_hex")).first()
    assert tuple(found) == (0, 0)
