import pytest
from pyspark.sql import functions as F

from llm_cases import awkward, empty, rows_of, with_clashes
from rebound.llm.mixing import Mix, leaf_quotas, plan_mix, select_mix


def leaves(spark, rows):
    return spark.createDataFrame(rows, "domain string, language string, source string, rows long, avail long")


def quotas(spark, rows, mix):
    return {(r["domain"], r["language"], r["source"]): r["quota"] for r in leaf_quotas(leaves(spark, rows), mix).collect()}


def test_shortage_goes_to_siblings_before_ancestors(spark):
    rows = [("a", "x", "s1", 1, 10), ("a", "x", "s2", 1, 1000), ("a", "y", "s3", 1, 1000), ("b", "x", "s4", 1, 1000)]
    q = quotas(spark, rows, Mix(tokens=800, max_epochs=1))
    # a: 400 -> x: 200 -> s1 gives only its 10, its sibling s2 takes the other 90
    assert q == {("a", "x", "s1"): 10, ("a", "x", "s2"): 190, ("a", "y", "s3"): 200, ("b", "x", "s4"): 400}


def test_full_subtree_passes_the_rest_up_one_level_at_a_time(spark):
    rows = [("a", "x", "s1", 1, 10), ("a", "x", "s2", 1, 20), ("a", "y", "s3", 1, 100), ("b", "x", "s4", 1, 1000)]
    q = quotas(spark, rows, Mix(tokens=800, max_epochs=1))
    assert q == {("a", "x", "s1"): 10, ("a", "x", "s2"): 20, ("a", "y", "s3"): 100, ("b", "x", "s4"): 670}


def test_quotas_add_up_and_never_pass_a_cap(spark):
    rows = [(d, la, f"{d}{la}{s}", 1, 7 * (i + 1) ** 3) for i, (d, la, s) in enumerate((d, la, s) for d in "abc" for la in "xy" for s in range(3))]
    mix = Mix(tokens=10_007, max_epochs=2, weights={("domain", "a"): 7, ("language", "y"): 3}, default_weight=2)
    q = quotas(spark, rows, mix)
    assert sum(q.values()) == min(10_007, sum(2 * r[4] for r in rows))
    assert all(q[r[:3]] <= 2 * r[4] for r in rows)


def test_zero_weight_gets_nothing_and_a_small_tree_gives_all(spark):
    rows = [("a", "x", "s1", 1, 10), ("b", "x", "s2", 1, 10)]
    q = quotas(spark, rows, Mix(tokens=100, max_epochs=3, weights={("domain", "b"): 0}))
    assert q == {("a", "x", "s1"): 30, ("b", "x", "s2"): 0}


def test_a_subtree_of_weight_zero_takes_no_budget_from_the_others(spark):
    rows = [("a", "en", "s1", 1, 100), ("a", "de", "s2", 1, 900), ("b", "en", "s3", 1, 1000)]
    q = quotas(spark, rows, Mix(tokens=1000, max_epochs=1, weights={("language", "de"): 0}))
    assert q == {("a", "en", "s1"): 100, ("a", "de", "s2"): 0, ("b", "en", "s3"): 900}
    rows = [("a", "en", "s1", 1, 50), ("a", "en", "s2", 1, 900), ("a", "de", "s2", 1, 70), ("b", "en", "s3", 1, 300)]
    q = quotas(spark, rows, Mix(tokens=1000, max_epochs=1, weights={("source", "s2"): 0}))
    assert q == {("a", "en", "s1"): 50, ("a", "en", "s2"): 0, ("a", "de", "s2"): 0, ("b", "en", "s3"): 300}


def test_sql_deals_a_tree_with_zero_weights_alike(spark, tmp_path):
    import duckdb

    from llm_cases import save
    from rebound.llm.mixing import mix_sql
    mix = Mix(tokens=1500, weights={("language", "de"): 0, ("source", "src0"): 0, ("domain", "books"): 3})
    docs = awkward(spark).where("doc_id IS NOT NULL")
    path = save(spark, docs, tmp_path)
    sql = mix_sql(mix, f"read_parquet('{path}/documents.parquet/*.parquet')", "doc_id, source, epoch, quota")
    got = select_mix(docs, mix).select("doc_id", F.col("mix_source").alias("source"), "epoch", F.col("mix_quota").alias("quota"))
    assert rows_of(got) == sorted(duckdb.sql(sql).fetchall(), key=repr)


def brute(rows, plan, seed):
    """Epoch prefixes by sorting each leaf."""
    import hashlib
    import re
    out = []
    for leaf, (quota, avail) in plan.items():
        own = [(r, len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in rows if leaf_of(r) == leaf]
        epochs, rest = divmod(quota, avail) if avail else (0, 0)
        h = lambda r: int(hashlib.md5(f"{seed}:{epochs}:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:15], 16)  # noqa: B023, E731, S324
        for r, _ in own:
            before = sum(n for o, n in own if h(o) < h(r))
            out += [(r[0], r[1], e) for e in range(epochs + (rest > 0 and before < rest))]
    return sorted(out, key=repr)


def leaf_of(r):
    import re
    m = re.search(r"([0-9]{1,9})$", r[3] or "")
    return (("web", "books", "code")[int(m[1]) % 3] if m else "unknown", r[2] or "unknown", r[3] or "unknown")


@pytest.mark.parametrize("mix", [Mix(tokens=3000), Mix(share=1.7, seed=3), Mix(tokens=40_000, weights={("source", "src0"): 90}), Mix(tokens=0)])
def test_selection_equals_sorted_prefixes(spark, mix):
    docs = awkward(spark)
    plan = {(r["domain"], r["language"], r["source"]): (r["quota"], r["avail"]) for r in plan_mix(docs, mix).collect()}
    got = select_mix(docs, mix).select("doc_id", "text", "epoch")
    want = brute([tuple(r) for r in docs.collect()], plan, mix.seed)
    assert rows_of(got) == want


def test_many_cells(spark, monkeypatch):
    import rebound.llm.mixing as m
    mix = Mix(tokens=4000)
    one = rows_of(select_mix(awkward(spark), mix).select("doc_id", "epoch"))
    monkeypatch.setattr(m, "CELL_ROWS", 1)
    monkeypatch.setattr(m, "BROADCAST_LEAVES", 0)
    assert rows_of(select_mix(awkward(spark), mix).select("doc_id", "epoch")) == one


def test_empty_and_clashing_columns(spark):
    mix = Mix(tokens=3000)
    assert select_mix(empty(spark), mix).count() == 0
    plain = rows_of(select_mix(awkward(spark), mix).select("doc_id", "epoch"))
    docs = with_clashes(awkward(spark)).drop("epoch")
    assert rows_of(select_mix(docs, mix).select("doc_id", "epoch")) == plain
    assert select_mix(docs, mix).where(F.col("domain") != "other").count() == 0
