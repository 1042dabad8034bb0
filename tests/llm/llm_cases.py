"""Small awkward inputs that every operator must take."""
import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = ["alpha", "bravo", "carat", "delta", "ember", "flint", "grove", "haven", "islet", "joker", "knoll", "lemon", "mango", "noble",
         "ocean", "piano", "quilt", "raven", "storm", "tulip", "umbra", "vivid", "woven", "xenon", "yacht", "zebra", "über", "naïve", "東京"]


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) + str(rng.randrange(200)) for _ in range(n))


def awkward_rows():
    """Nulls in every column, empty, blank, one-letter and very long texts, repeated rows, copies and near copies."""
    rng = random.Random(5)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    rows = [(1, base, "en", "src0", 1), (2, base, "en", "src0", 1), (2, base, "en", "src0", 1), (3, " ".join(near), "en", "src1", 1),
            (4, None, "en", "src1", None), (5, "", "de", "src2", 0), (6, " \t\n\x0b ", None, "src2", 5), (7, "x", "fr", None, 1),
            (8, prose(rng, 30000), "de", "src4", 1), (9, "token=abcdefghijkl0123456789 " + prose(rng, 80), "en", "web", 1),
            (None, prose(rng, 40), "en", "src0", 1), (None, None, None, None, None), (10, "12345 !? \x1c   ", "es", "src5", 1),
            (11, "don't   stop\r\n\r\n\tit's 𝒳 🙂 ﬁ é", "en", "src6", 1), (12, base + " " + prose(rng, 5), "en", "src0", 1)]
    rows += [(100 + i, prose(rng, rng.randrange(1, 200)), rng.choice(["en", "de", "fr", "es"]), f"src{i % 7}", 1) for i in range(60)]
    rows += [(200 + i, "\n".join([prose(rng, 20), base, prose(rng, 20)]), "en", "src3", 1) for i in range(3)]
    return rows


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


#: Names that operators use inside; as further columns of a table they must do no harm.
CLASHES = ["rejected", "score", "ids", "epoch", "shard", "slot", "blob", "key", "size", "tokens", "h", "n", "e1", "fp", "kind", "pid",
           "carrier", "findings", "label", "rep", "cell", "domain", "language", "quota", "digest", "refers_to", "row", "first"]


def with_clashes(df):
    from pyspark.sql import functions as F
    return df.select("*", *[F.lit("other").alias(c) for c in CLASHES if c not in df.columns])


def save(spark, df, folder, name="documents"):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
