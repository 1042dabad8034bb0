"""Models (L1-L7) and tree contributions (X1) on Spark ML.

The solvers are Spark's (distributed ``treeAggregate``); only model
parameters (coefficients, trees) ever reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rebound.functions.parse import missing_as
from rebound.operators.treeshap import TreeShap


# ---------------------------------------------------------------- L1
def fit_logistic(train: DataFrame, features: Sequence[str], label: str, l2: float = 0.002,
                 max_iter: int = 200) -> PipelineModel:
    """L1: L2-regularised logistic regression on numeric feature columns
    (already scaled / encoded), same objective as the reference, L-BFGS."""
    asm = VectorAssembler(inputCols=list(features), outputCol="__features", handleInvalid="keep")
    lr = LogisticRegression(featuresCol="__features", labelCol=label, regParam=l2, elasticNetParam=0.0,
                            standardization=False, maxIter=max_iter, probabilityCol="__prob",
                            rawPredictionCol="__raw", predictionCol="__pred")
    return Pipeline(stages=[asm, lr]).fit(train.withColumn(label, F.col(label).cast("double")))


# ---------------------------------------------------------------- L2
def fit_gbt(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str,
            validation_col: str | None = None, max_iter: int = 60, seed: int = 42) -> PipelineModel:
    """L2: boosted trees (rate .05, depth 5, 0.85 row / feature sampling, min
    leaf 40, validation-based early stopping); categoricals string-indexed
    (unseen -> extra index), numerics median-imputed."""
    stages = []
    cat_idx = []
    for c in categorical:
        stages.append(StringIndexer(inputCol=f"__cat_{c}", outputCol=f"__idx_{c}", handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
        cat_idx.append(f"__idx_{c}")
    num_imp = [f"__imp_{c}" for c in numeric]
    if numeric:
        stages.append(Imputer(inputCols=[f"__num_{c}" for c in numeric], outputCols=num_imp, strategy="median"))
    stages.append(VectorAssembler(inputCols=num_imp + cat_idx, outputCol="__features", handleInvalid="keep"))
    data = prepare_gbt_input(train, numeric, categorical, label)
    # a categorical split needs a bin per category (and one for unseen values)
    sizes = data.agg(*[F.count_distinct(f"__cat_{c}").alias(c) for c in categorical]).first() if categorical else []
    gbt = GBTClassifier(featuresCol="__features", labelCol=label, stepSize=0.05, maxDepth=5, maxIter=max_iter,
                        subsamplingRate=0.85, featureSubsetStrategy="0.85", minInstancesPerNode=40, seed=seed,
                        predictionCol="__pred", maxBins=max([64, *(n + 2 for n in sizes)]))
    gbt.setProbabilityCol("__prob").setRawPredictionCol("__raw")
    if validation_col:
        gbt.setValidationIndicatorCol(validation_col)
    stages.append(gbt)
    return Pipeline(stages=stages).fit(data)


def prepare_gbt_input(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                      label: str | None = None) -> DataFrame:
    cols = [F.col(c) for c in df.columns]
    cols += [missing_as(c).alias(f"__cat_{c}") for c in categorical]
    cols += [F.col(c).cast("double").alias(f"__num_{c}") for c in numeric]
    out = df.select(*cols)
    if label and label in df.columns:
        out = out.withColumn(label, F.col(label).cast("double"))
    return out


# ---------------------------------------------------------------- L3
def apply_model(model: PipelineModel, df: DataFrame, out: str = "model_probability",
                numeric: Sequence[str] = (), categorical: Sequence[str] = ()) -> DataFrame:
    """L3: batch scoring; the positive-class probability as a double column."""
    src = prepare_gbt_input(df, numeric, categorical) if (numeric or categorical) else df
    scored = model.transform(src)
    keep = [c for c in df.columns]
    return scored.select(*keep, vector_to_array("__prob")[1].alias(out))


# ---------------------------------------------------------------- L4
def fit_isotonic(df: DataFrame, score: str, label: str):
    """L4: isotonic calibration (clamped outside the fitted range, linear between)."""
    return IsotonicRegression(featuresCol=score, labelCol=label, predictionCol="__cal").fit(
        df.select(F.col(score).cast("double").alias(score), F.col(label).cast("double").alias(label)))


def apply_isotonic(model, df: DataFrame, score: str, out: str = "calibrated_probability") -> DataFrame:
    return model.transform(df.withColumn(score, F.col(score).cast("double"))).withColumnRenamed("__cal", out)


# ---------------------------------------------------------------- L5 / L6
def importance_table(model: PipelineModel, names: Sequence[str]) -> list[tuple[str, float]]:
    """Normalised gain importance per input column (driver-side, one value per feature)."""
    imp = model.stages[-1].featureImportances.toArray()
    return sorted(zip(names, [float(x) for x in imp]), key=lambda t: (-t[1], t[0]))


def signed_weights(model: PipelineModel, names: Sequence[str], k: int = 15) -> dict[str, list]:
    """The k most positive and k most negative coefficients."""
    coef = model.stages[-1].coefficients.toArray()
    pairs = list(zip(names, [float(c) for c in coef]))
    return {"top": sorted(pairs, key=lambda t: (-t[1], t[0]))[:k],
            "bottom": sorted(pairs, key=lambda t: (t[1], t[0]))[:k]}


# ---------------------------------------------------------------- L7
def time_folds(df: DataFrame, ts: str, id_col: str, n_folds: int = 3) -> list[tuple[DataFrame, DataFrame]]:
    """Expanding-window folds in (ts, id) order: fold i trains on the first
    i / (n + 1) of the rows and validates on the next 1 / (n + 1).  The fold
    boundaries are exact order statistics (no global sort)."""
    from rebound.operators.ordered import kth_boundaries
    fr = [i / (n_folds + 1) for i in range(1, n_folds + 1)]
    keyed = df.withColumn("__tnull", F.col(ts).isNull())
    _, bounds = kth_boundaries(keyed, ["__tnull", ts, id_col], fr)
    key = F.struct(F.col("__tnull").alias("c0"), F.col(ts).alias("c1"), F.col(id_col).alias("c2"))
    ktype = keyed.select(key.alias("k")).schema["k"].dataType

    def before(b):
        if b is None:
            return F.lit(True)
        return key < F.struct(*[F.lit(x).alias(f"c{i}") for i, x in enumerate(b)]).cast(ktype)

    folds = []
    for i in range(n_folds):
        train = keyed.where(before(bounds[i])).drop("__tnull")
        nxt = bounds[i + 1] if i + 1 < n_folds else None
        val = keyed.where(~before(bounds[i]) & before(nxt)).drop("__tnull")
        folds.append((train, val))
    return folds


def grid_search_net_value(folds: Sequence[tuple[DataFrame, DataFrame]], fit, grid: Sequence[dict], score_fn,
                          objective) -> tuple[dict, float, list]:
    """For each parameter set, fit on every fold's earlier window and score
    its later window; keep the best mean objective (first wins ties).  The
    grid is small and every fit is distributed; only scalars come back."""
    results = []
    best, best_v = None, -float("inf")
    for params in grid:
        vals = [float(objective(score_fn(fit(tr, **params), va))) for tr, va in folds]
        v = sum(vals) / len(vals)
        results.append((params, v))
        if v > best_v:
            best, best_v = params, v
    return best, best_v, results


# ---------------------------------------------------------------- X1 (trees)
def extract_trees(model: PipelineModel) -> tuple[list[list[dict]], list[float]]:
    """Flatten the fitted trees into node tables with the weight of training
    rows that reached each node (driver, once per model)."""
    gbt = model.stages[-1]
    trees = []
    for t in gbt.trees:
        nodes: list[dict] = []

        def walk(jn) -> int:
            idx = len(nodes)
            nodes.append({})
            pred, cover = float(jn.prediction()), float(jn.impurityStats().count())
            if jn.getClass().getSimpleName() == "InternalNode":
                split = jn.split()
                feat = int(split.featureIndex())
                if split.getClass().getSimpleName() == "ContinuousSplit":
                    rule = ("le", float(split.threshold()))
                else:
                    rule = ("in", [float(x) for x in split.leftCategories()])
                left = walk(jn.leftChild())
                right = walk(jn.rightChild())
                nodes[idx] = {"leaf": False, "pred": pred, "cover": cover, "feat": feat, "rule": rule, "l": left, "r": right}
            else:
                nodes[idx] = {"leaf": True, "pred": pred, "cover": cover}
            return idx

        walk(t._java_obj.rootNode())
        trees.append(nodes)
    return trees, [float(w) for w in gbt.treeWeights]


def tree_contributions(model: PipelineModel, df: DataFrame, names: Sequence[str], id_col: str) -> DataFrame:
    """X1 for trees: Shapley values under the trees' own training shares
    (``treeshap``), summed over the trees with their weights.  Additive:
    bias + sum(contributions) = margin, bias being the mean margin.

    Runs over the assembled feature vectors in Arrow batches; the node tables
    travel with the task (bounded by iterations x 2^depth).  Returns
    (id, bias, margin, contributions array).
    """
    shap = TreeShap(*extract_trees(model))
    feats = model.transform(df).select(F.col(id_col), vector_to_array("__features").alias("__x"))
    n_feat = len(names)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            x = batch["__x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n_feat)
            out = shap(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * n_feat, pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch[id_col], pa.array(np.full(len(x), shap.bias)), pa.array(shap.bias + out.sum(1)), lists],
                                             names=[id_col, "bias", "margin", "contributions"])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("bias", T.DoubleType()),
                           T.StructField("margin", T.DoubleType()),
                           T.StructField("contributions", T.ArrayType(T.DoubleType()))])
    return feats.mapInArrow(run, schema)
