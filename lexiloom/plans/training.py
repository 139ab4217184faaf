"""Fit, score, cross-validate and tune models by name."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial, reduce
from typing import Any

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.metrics import accuracy, metric_row
from lexiloom.operators.reduction import fit_pca
from lexiloom.operators.splits import SEED, stratified_folds, stratified_holdout
from lexiloom.operators.tfidf import LARGE, SMALL, TermRules, few, fit_tfidf_by_fold, term_stages
from lexiloom.plans import classifiers
from lexiloom.plans.boosting import margin_column
from lexiloom.plans.features import (
    FEATURES,
    Inputs,
    apply,
    first_components,
    metadata_stages,
    prepare,
    text_metadata_stages,
    text_stages,
    vector_metadata_stages,
)
from lexiloom.plans.head import HeadScore, best_state
from lexiloom.session import in_parallel, materialise
from lexiloom.sources.tables import packed

FeatureFit = Callable[[DataFrame, Inputs], list[Transformer]]
ClassifierFit = Callable[[DataFrame, Inputs], list[Transformer]]


def training_table(df: DataFrame, inputs: Inputs) -> DataFrame:
    """Key, label and features, computed once and written: every pass of a fit reads this table."""
    columns = [c for c in (inputs.key, inputs.label, FEATURES) if c in df.columns]
    table = materialise(df.select(*columns), "train")
    return packed(table, table.count())


def no_features(train: DataFrame, inputs: Inputs) -> list[Transformer]:
    return []


@dataclass(frozen=True)
class Plan:
    """A feature fit followed by a classifier fit, and the inputs both need."""

    features: FeatureFit
    classifier: ClassifierFit
    needs: tuple[str, ...] = ()
    rules: TermRules | None = field(default=None)  # set where features are the text alone

    def check(self, inputs: Inputs) -> None:
        absent = [n for n in self.needs if not getattr(inputs, n)]
        if absent:
            raise ValueError(f"this model needs inputs {absent}")

    def fit(self, train: DataFrame, inputs: Inputs) -> PipelineModel:
        """Fit on the rows given; ``train`` comes from ``prepare``."""
        self.check(inputs)
        stages = self.features(train, inputs)
        return PipelineModel([*stages, *self.classifier(training_table(apply(stages, train), inputs), inputs)])


def _logistic_regression(rules: TermRules = SMALL, **fit: Any) -> Plan:
    fit = partial(classifiers.logistic_regression, **fit)
    return Plan(partial(text_stages, rules=rules), fit, ("text",), rules)


def _svm(c: float = 1.0, rules: TermRules = SMALL) -> Plan:
    return Plan(partial(text_stages, rules=rules), partial(classifiers.linear_svm, c=c), ("text",), rules)


def _logistic_regression_metadata(rules: TermRules = LARGE, balanced: bool = True, **fit: Any) -> Plan:
    fit = partial(classifiers.logistic_regression, balanced=balanced, **fit)
    return Plan(partial(text_metadata_stages, rules=rules), fit, ("text", "numbers"))


def _logistic_regression_vectors(**fit: Any) -> Plan:
    return Plan(vector_metadata_stages, partial(classifiers.logistic_regression, **fit), ("vector",))


def _boosted_trees(components: int | None = None, layout: int | None = None, layout_options: dict[str, Any] | None = None, **trees: Any) -> Plan:
    features = partial(vector_metadata_stages, components=components, layout=layout, **(layout_options or {}))
    return Plan(features, partial(classifiers.boosted_trees, **trees), ("vector",))


def _perceptron(**head: Any) -> Plan:
    return Plan(vector_metadata_stages, partial(classifiers.perceptron, **head), ("vector",))


def _majority() -> Plan:
    return Plan(no_features, classifiers.majority)


MODELS: dict[str, Callable[..., Plan]] = {
    "logistic_regression": _logistic_regression,
    "svm": _svm,
    "logistic_regression_metadata": _logistic_regression_metadata,
    "logistic_regression_vectors": _logistic_regression_vectors,
    "boosted_trees": _boosted_trees,
    "boosted_trees_pca": partial(_boosted_trees, components=128),
    "boosted_trees_layout": partial(_boosted_trees, layout=16),
    "perceptron": _perceptron,
    "majority": _majority,
}


def build(name: str, **parameters: Any) -> Plan:
    """A plan by its name."""
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; known are {sorted(MODELS)}")
    return MODELS[name](**parameters)


def holdout_scores(df: DataFrame, plan: Plan, inputs: Inputs, share: float = 0.2, seed: int = SEED) -> DataFrame:
    """Fit on the train side of a stratified hold-out and score its other side."""
    # the split and every feature fit pass over the repaired inputs: they are computed once
    split = materialise(prepare(stratified_holdout(df, inputs.key, inputs.label, share, seed), inputs), "split")
    model = plan.fit(split.filter("split = 'train'"), inputs)
    return model.transform(split.filter("split = 'val'"))


def report(scored: DataFrame, inputs: Inputs) -> DataFrame:
    """Accuracy, F1, precision, recall and AUC of scored rows; the score is the probability of class 1, or the margin."""
    source = next((c for c in ("probability", "rawPrediction") if c in scored.columns), None)
    score = vector_to_array(source)[1] if source else F.col("prediction")
    rows = scored.select(F.col(inputs.label).alias("label"), F.col("prediction"), score.alias("score"))
    return metric_row(rows)


def score_unlabelled(labelled: DataFrame, unlabelled: DataFrame, plan: Plan, inputs: Inputs) -> DataFrame:
    """Fit on all labelled rows and score the others; the key stays on each row."""
    return plan.fit(prepare(labelled, inputs), inputs).transform(prepare(unlabelled, inputs))


def cross_validate(
    df: DataFrame, plan: Plan, inputs: Inputs, folds: int = 5, seed: int = SEED, parallelism: int = 5
) -> DataFrame:
    """``fold, accuracy``: every fit, from vocabulary to weights, sees the other folds only."""
    plan.check(inputs)
    split = prepare(stratified_folds(df, inputs.key, inputs.label, folds, seed), inputs).filter("fold is not null")
    split = materialise(split, "split")
    per_fold = _text_tables(split, plan, inputs, folds) if plan.rules else _fold_tables(split, plan, inputs, folds)

    def scored(held_out: int, table: DataFrame) -> DataFrame:
        train = table.filter(F.col("fold") != held_out)
        model = PipelineModel(plan.classifier(packed(train, train.count()), inputs))
        return model.transform(table.filter(F.col("fold") == held_out)).select("fold", inputs.label, "prediction")

    parts = in_parallel(df.sparkSession, [partial(scored, i, table) for i, table in enumerate(per_fold)], parallelism)
    everything = reduce(DataFrame.unionByName, parts)
    return everything.groupBy("fold").agg(accuracy(inputs.label).alias("accuracy"))


def _fold_tables(split: DataFrame, plan: Plan, inputs: Inputs, folds: int) -> Iterator[DataFrame]:
    """Per held-out fold all rows with the features fitted without it."""
    for held_out in range(folds):
        stages = plan.features(split.filter(F.col("fold") != held_out), inputs)
        rows = apply(stages, split)
        columns = [c for c in (inputs.key, inputs.label, "fold", FEATURES) if c in rows.columns]
        yield materialise(rows.select(*columns), "fold")


def _text_tables(split: DataFrame, plan: Plan, inputs: Inputs, folds: int) -> Iterator[DataFrame]:
    """The same for texts alone, which are read twice for all folds together.

    One pass counts all terms, and a fold's own counts are subtracted from them;
    one pass writes the vectors of all vocabularies side by side.
    """
    models = fit_tfidf_by_fold(split, inputs.text, "fold", folds, plan.rules)
    only = few(set().union(*[m.words() for m in models]))
    stages = term_stages(inputs.text, "terms", plan.rules, only)
    for i, model in enumerate(models):
        stages += model.weight_stages("terms", f"{FEATURES}_{i}")
    rows = apply(stages, split)
    table = materialise(
        rows.select(inputs.key, inputs.label, "fold", *[f"{FEATURES}_{i}" for i in range(folds)]), "folds"
    )
    for i in range(folds):
        yield table.select(inputs.key, inputs.label, "fold", F.col(f"{FEATURES}_{i}").alias(FEATURES))


@dataclass(frozen=True)
class GridResult:
    """One setting of the grid with all of its parameters, and its hold-out accuracy."""

    rounds: int
    depth: int
    components: int
    accuracy: float


def grid_search(
    df: DataFrame,
    inputs: Inputs,
    rounds: Sequence[int] = (1000,),
    depths: Sequence[int] = (9,),
    components: Sequence[int] = (32, 64, 128),
    share: float = 0.2,
    seed: int = SEED,
    parallelism: int = 4,
) -> list[GridResult]:
    """Boosted trees on principal components over a grid, best setting first.

    One PCA of the largest size serves all sizes, and the reduced rows are
    written once and read by every fit. Rounds of a fit do not depend on how many
    follow, so one fit of the most rounds scores all smaller numbers on its way.
    """
    split = prepare(stratified_holdout(df, inputs.key, inputs.label, share, seed), inputs)
    train = split.filter("split = 'train'")
    largest = max(components)
    meta, outputs = metadata_stages(train, inputs)
    reduced = apply([*fit_pca(train, inputs.vector, "reduced", largest), *meta], split.filter("split is not null"))
    table = materialise(reduced.select(inputs.key, inputs.label, "split", "reduced", *outputs), "grid")

    rows = table.count()

    def evaluated(k: int, d: int) -> list[GridResult]:
        stages = [
            first_components("reduced", "leading", k),
            VectorAssembler(inputCols=["leading", *outputs], outputCol=FEATURES),
        ]
        features = apply(stages, table)
        model = classifiers.boosted_trees(packed(features.filter("split = 'train'"), rows), inputs, max(rounds), d)[0]
        margins = margin_column(model.model(), vector_to_array(FEATURES), rounds)
        scored = features.filter("split = 'val'").select(F.col(inputs.label).alias("label"), margins.alias("margins"))
        right = [F.avg(((F.col("margins")[i] > 0).cast("int") == F.col("label")).cast("double")) for i in range(len(rounds))]
        return [GridResult(r, d, k, a) for r, a in zip(rounds, scored.agg(*right).first(), strict=True)]

    settings = itertools.product(components, depths)
    results = in_parallel(df.sparkSession, [partial(evaluated, *s) for s in settings], parallelism)
    return sorted(itertools.chain.from_iterable(results), key=lambda x: -x.accuracy)


def epochs(df: DataFrame, inputs: Inputs, share: float = 0.1, seed: int = SEED, **head: Any) -> tuple[DataFrame, DataFrame]:
    """Train a head with a look at the held-out rows after every epoch.

    Returns ``epoch, loss, accuracy, weights`` of all epochs, and the held-out rows scored by the best one.
    """
    split = materialise(prepare(stratified_holdout(df, inputs.key, inputs.label, share, seed), inputs), "split")
    stages = vector_metadata_stages(split.filter("split = 'train'"), inputs)
    table = materialise(apply(stages, split).select(inputs.key, inputs.label, "split", FEATURES), "epochs")
    train, val = table.filter("split = 'train'"), table.filter("split = 'val'")
    states = classifiers.head_states(packed(train, train.count()), inputs, seed=seed, validation=val, **head)
    return states, HeadScore.of(best_state(states)[1], FEATURES).transform(val)


def best_epoch(df: DataFrame, run: str, epoch: str, score: str) -> DataFrame:
    """Per run the first epoch with the highest validation score."""
    order = F.struct(-F.col(score), F.col(epoch))
    return df.groupBy(run).agg(F.min_by(epoch, order).alias(epoch), F.max(score).alias(score))
