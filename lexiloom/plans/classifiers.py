"""Classifiers on a ``features`` vector (M1-M5); each returns the stages that score."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import ElementwiseProduct, SQLTransformer, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.groups import class_weight_table, majority_class, with_class_weight
from lexiloom.plans.boosting import BINS, BoostedTrees, Rules, fit_trees
from lexiloom.plans.features import FEATURES, Inputs, apply, vector_size
from lexiloom.plans.head import HeadScore, best_state, fit_head, head_rows
from lexiloom.plans.head import Rules as HeadRules
from lexiloom.plans.linear import fit_linear

SOLVERS = ("l-bfgs", "newton")


def logistic_regression(
    train: DataFrame,
    inputs: Inputs,
    c: float = 1.0,
    balanced: bool = False,
    max_iter: int = 1000,
    tol: float = 1e-6,
    solver: str = "l-bfgs",
) -> list[Transformer]:
    """L2 logistic regression with strength ``c`` that penalises the intercept too.

    A constant 1 is appended to each vector in place of an intercept. Spark pins
    constant columns to weight 0, so for half of the rows vector and label are
    both negated: the loss stays the same and the column is constant no more.

    ``l-bfgs`` stops on the change of the objective. ``newton`` goes on to a gradient of
    ``tol`` times the first one, with passes that never form the matrix of second
    derivatives. Both take any number of columns, add the same columns to a table, reach
    the same optimum, and honour ``max_iter``.
    """
    if solver not in SOLVERS:
        raise ValueError(f"unknown solver {solver!r}; known are {SOLVERS}")
    size = vector_size(train, FEATURES)
    df = train
    if balanced:
        df = with_class_weight(df, inputs.label, class_weight_table(train, inputs.label), "_weight")
    else:
        df = df.withColumn("_weight", F.lit(1.0))
    label = F.col(inputs.label).cast("double")
    if solver == "newton":
        return [fit_linear(df.select(FEATURES, (2 * label - 1).alias("_sign"), "_weight"), size, FEATURES, "logistic", c, max_iter, tol)]

    rows = train.count()
    wide, drop = _with_one(size)
    df = apply(wide, df).select(inputs.key, "_wide", "_weight", label.alias("_label"))
    flipped = F.pmod(F.xxhash64(inputs.key), F.lit(2)) == 1
    negate = ElementwiseProduct(scalingVec=Vectors.dense([-1.0] * (size + 1)), inputCol="_wide", outputCol="_x")
    mirrored = negate.transform(df.filter(flipped)).select("_x", "_weight", (1 - F.col("_label")).alias("_label"))
    kept = df.filter(~flipped).select(F.col("_wide").alias("_x"), "_weight", "_label")
    table = kept.unionByName(mirrored)

    # class weights add up to the row count, so the penalty is the same in both forms
    model = LogisticRegression(
        featuresCol="_x",
        labelCol="_label",
        weightCol="_weight",
        fitIntercept=False,
        standardization=False,
        elasticNetParam=0.0,
        regParam=1.0 / (c * rows),
        maxIter=max_iter,
        tol=tol,
        family="binomial",
    ).fit(table)
    return [*wide, model.setFeaturesCol("_wide"), drop]


def _with_one(size: int) -> tuple[list[Transformer], Transformer]:
    """Stages that append a constant 1 to the features as ``_wide``, and one that takes the helpers away."""
    wide = [
        SQLTransformer(statement="SELECT *, 1.0D AS _one FROM __THIS__"),
        VectorSizeHint(inputCol=FEATURES, size=size, handleInvalid="optimistic"),
        VectorAssembler(inputCols=[FEATURES, "_one"], outputCol="_wide"),
    ]
    return wide, SQLTransformer(statement="SELECT * EXCEPT (_one, _wide) FROM __THIS__")


def linear_svm(train: DataFrame, inputs: Inputs, c: float = 1.0, max_iter: int = 100, tol: float = 1e-9) -> list[Transformer]:
    """Linear support vector machine with squared hinge loss; the intercept is penalised too.

    Minimises ``|w|^2 / 2 + c * sum max(0, 1 - y w x)^2`` with a constant 1 in x.
    """
    sign = F.when(F.col(inputs.label) == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
    rows = train.select(FEATURES, sign.alias("_sign"), F.lit(1.0).alias("_weight"))
    return [fit_linear(rows, vector_size(train, FEATURES), FEATURES, "squared_hinge", c, max_iter, tol)]


def boosted_trees(
    train: DataFrame,
    inputs: Inputs,
    rounds: int = 1000,
    depth: int = 9,
    step: float = 0.05,
    seed: int = 42,
    rows: float = 0.8,
    columns: float = 0.8,
    penalty: float = 1.0,
    min_child: float = 1.0,
    bins: int = BINS,
) -> list[Transformer]:
    """Second-order gradient-boosted trees; each round draws its share of the rows and of the columns."""
    rules = Rules(rounds, depth, step, rows, columns, penalty, min_child, seed)
    trees = fit_trees(boosting_rows(train, inputs), vector_size(train, FEATURES), rules, bins)
    return [BoostedTrees(trees=trees.dumps(), featuresCol=FEATURES)]


def boosting_rows(train: DataFrame, inputs: Inputs) -> DataFrame:
    return train.select(
        F.xxhash64(inputs.key).alias("key"), F.col(inputs.label).cast("int").alias("label"), vector_to_array(FEATURES).alias("x")
    )


def perceptron(
    train: DataFrame,
    inputs: Inputs,
    hidden: int = 128,
    max_iter: int = 10,
    seed: int = 42,
    batches: int = 8,
    rate: float = 5e-3,
    drop: float = 0.5,
    decay: float = 0.01,
    warmup: float = 0.06,
    validation: DataFrame | None = None,
) -> list[Transformer]:
    """One hidden layer on top of fixed vectors and metadata, after ``max_iter`` epochs.

    With ``validation`` rows, which have the features and labels too, the weights are those of the best epoch.
    """
    return [HeadScore.of(best_state(head_states(train, inputs, hidden, max_iter, seed, batches, rate, drop, decay, warmup, validation))[1], FEATURES)]


def head_states(
    train: DataFrame,
    inputs: Inputs,
    hidden: int = 128,
    max_iter: int = 10,
    seed: int = 42,
    batches: int = 8,
    rate: float = 5e-3,
    drop: float = 0.5,
    decay: float = 0.01,
    warmup: float = 0.06,
    validation: DataFrame | None = None,
) -> DataFrame:
    """``epoch, loss, accuracy, weights``: the state of the head after every epoch."""
    rules = HeadRules(hidden, max_iter, batches, rate, drop, decay, warmup, seed)
    classes = max(2, 1 + int(train.agg(F.max(F.col(inputs.label).cast("long"))).first()[0] or 0))
    others = None if validation is None else head_rows(validation, inputs.key, inputs.label, FEATURES)
    return fit_head(head_rows(train, inputs.key, inputs.label, FEATURES), vector_size(train, FEATURES), classes, rules, others)


def majority(train: DataFrame, inputs: Inputs) -> list[Transformer]:
    """The most frequent class for every row."""
    value = float(majority_class(train, inputs.label))
    return [SQLTransformer(statement=f"SELECT *, {value!r}D AS prediction FROM __THIS__")]
