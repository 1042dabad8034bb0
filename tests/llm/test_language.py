import zlib

from conftest import SF_MID
from llm_cases import awkward, empty, save, with_clashes
from pyspark.sql import functions as F
from rebound.llm.language import Fit, UNDETERMINED, fit_model, held_out, identify, letters, op3_subword_language, train


def test_held_out_accuracy_and_columns(spark):
    out = op3_subword_language(spark, SF_MID)
    assert out.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "lang")
    r = out.join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg(F.col("rejected").cast("int")), F.count("*")).first()
    assert r[0] >= 0.97 and r[1] <= 0.01 and r[2] > 200


def test_held_out_rule(spark):
    got = spark.range(50).select("id", held_out("id").alias("h")).collect()
    assert [r["h"] for r in got] == [zlib.crc32(str(r["id"]).encode()) % 4 == 2 for r in got]


def test_model_never_sees_held_out_rows_or_other_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    a = fit_model(docs, usable=~held_out())
    wrong = docs.withColumn("lang", F.when(held_out(), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    b = fit_model(wrong, usable=~held_out())
    assert a.labels == b.labels and (a.table == b.table).all() and a.threshold == b.threshold


def test_defined_results_for_awkward_rows(spark, tmp_path):
    out = {}
    for r in op3_subword_language(spark, save(spark, with_clashes(awkward(spark)), tmp_path)).collect():
        out.setdefault(r["doc_id"], []).append(r)
        assert 0 <= r["score"] <= 1
    for i in (4, 5, 6, 10):
        assert out[i][0]["lang_pred"] == UNDETERMINED and out[i][0]["score"] == 0 and out[i][0]["rejected"]
    assert out[7][0]["lang_pred"] in ("en", "de", "fr", "es")
    assert out[1][0]["score"] == out[2][0]["score"] == out[2][1]["score"]


def test_no_label_or_no_row(spark):
    docs = awkward(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in identify(docs, fit_model(docs)).collect()} == {UNDETERMINED}
    assert identify(empty(spark), fit_model(empty(spark))).count() == 0


def test_foreign_text_is_less_sure_and_pieces_do_not_matter(monkeypatch):
    import rebound.llm.language as L
    texts = [f"the and of {i} with which they were" for i in range(60)] + [f"der und die {i} mit dem nicht sein" for i in range(60)]
    model = train(texts, ["en"] * 60 + ["de"] * 60, Fit())
    sure = model.scores(model.logits("they were with the which"))
    assert model.labels[sure.argmax()] == "en" and sure.max() > 0.9
    long = " ".join(texts) * 3
    whole = model.logits(long)
    monkeypatch.setattr(L, "PIECE", 1000)
    assert abs(model.logits(long) - whole).max() < 0.02
    assert letters("A1é!𝒳").tolist() == [32, ord("a"), 32, ord("é"), 32, ord("𝒳"), 32]


def test_an_unlearned_script_is_rejected_and_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    model = fit_model(docs, usable=~held_out())
    assert model.evidence > 0
    foreign = ["Все люди рождаются свободными и равными в своем достоинстве", "人人生而自由，在尊严和权利上一律平等", "すべての人間は自由であり", "모든 인간은 태어날 때부터 자유로우며",
               "όλοι οι άνθρωποι γεννιούνται ελεύθεροι", "सभी मनुष्यों को गौरव और अधिकारों"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(foreign)], "doc_id long, text string")
    assert all(r["rejected"] for r in identify(rows, model).collect())
    kept = identify(docs, model).where(held_out() & F.col("lang").isNotNull() & F.col("lang").eqNullSafe(F.col("lang_pred")))
    assert kept.where("rejected").count() == 0 and kept.count() > 200
