"""Whole runs from JSON lines to a prediction file, one call each."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions.text import prompt, surface_features
from lexiloom.operators.encode import Encoder, HashEncoder, encode_texts
from lexiloom.operators.groups import fold_summary, user_texts
from lexiloom.operators.schema import EXCLUDED, align, column_kinds, drop_all_null
from lexiloom.operators.splits import SEED, random_holdout
from lexiloom.plans import training
from lexiloom.plans.features import Inputs, prepare
from lexiloom.session import materialise
from lexiloom.sources.json_lines import load_labelled, load_scoring
from lexiloom.sources.results import cached_vectors, write_submission

KEY = "challenge_id"


TEXTS: dict[str, Callable[[], Column]] = {
    "full_text": lambda: F.col("full_text"),
    "description": lambda: F.col("user_description"),
    "prompt": lambda: prompt("user_description", "full_text"),
}


@dataclass(frozen=True)
class Run:
    """Cross-validated accuracy, where it was asked for, the path of the predictions, and the fitted model.

    ``report`` has accuracy, F1, precision, recall and AUC of a hold-out, where one was asked for.
    """

    mean: float | None
    std: float | None
    predictions: str | None
    model: PipelineModel
    report: DataFrame | None = None


def with_key(df: DataFrame, key: str = KEY) -> DataFrame:
    """Keep the key, or make one from the whole row: equal rows get equal keys and share a side of each split."""
    if key in df.columns:
        return df
    return df.withColumn(key, F.sha2(F.to_json(F.struct("*")), 256))


def with_text(df: DataFrame, choice: str) -> DataFrame:
    """Add ``text_used``: the full text, the user's description, or both in a prompt."""
    if choice not in TEXTS:
        raise ValueError(f"unknown text {choice!r}; known are {sorted(TEXTS)}")
    return df.withColumn("text_used", TEXTS[choice]())


def train_texts(
    spark: SparkSession,
    model: str,
    labelled: str,
    scoring: str,
    folder: str,
    schema: T.StructType | str | None = None,
    scoring_schema: T.StructType | str | None = None,
    folds: int | None = 5,
    text: str = "full_text",
    holdout: float | None = None,
    **parameters: Any,
) -> Run:
    """Text-only model: cross-validate, fit on all labelled rows, score and write."""
    known = with_text(with_key(load_labelled(spark, labelled, schema)), text)
    others = with_text(load_scoring(spark, scoring, scoring_schema, KEY), text)
    return _run(known, others, model, Inputs(KEY, text="text_used"), folder, folds, parameters, holdout)


def train_combined(
    spark: SparkSession,
    model: str,
    labelled: str,
    scoring: str,
    folder: str,
    schema: T.StructType | str | None = None,
    scoring_schema: T.StructType | str | None = None,
    numbers: Sequence[str] | None = None,
    category: str | None = "source",
    excluded: Sequence[str] = EXCLUDED,
    folds: int | None = 5,
    text: str = "full_text",
    holdout: float | None = None,
    **parameters: Any,
) -> Run:
    """Text next to metadata: surface features of the text, numbers found in both schemas (or those given), a category."""
    known = with_key(load_labelled(spark, labelled, schema))
    others = load_scoring(spark, scoring, scoring_schema, KEY)
    kinds = column_kinds(drop_all_null(align(known, others)), (*excluded, KEY, "label"))
    surface = surface_features("full_text")
    chosen = tuple(kinds.all if numbers is None else numbers)
    has_category = category if category in known.columns and category in others.columns else None
    inputs = Inputs(KEY, text="text_used", numbers=(*surface, *chosen), category=has_category)

    def ready(df: DataFrame) -> DataFrame:
        return with_text(df, text).withColumns(surface)

    return _run(ready(known), ready(others), model, inputs, folder, folds, parameters, holdout)


def train_users(
    spark: SparkSession,
    model: str,
    labelled: str,
    schema: T.StructType | str | None = None,
    share: float = 0.1,
    seed: int = SEED,
    **parameters: Any,
) -> Run:
    """One text per user, fitted on some users and reported on the held-out ones; there is nothing else to score."""
    users = materialise(user_table(with_key(load_labelled(spark, labelled, schema)), share=share, seed=seed), "users")
    inputs = Inputs("user_description", text="combined_text")
    plan = training.build(model, **parameters)
    split = prepare(users, inputs)
    fitted = plan.fit(split.filter("split = 'train'"), inputs)
    return Run(None, None, None, fitted, training.report(fitted.transform(split.filter("split = 'val'")), inputs))


def train_metadata(
    spark: SparkSession,
    model: str,
    labelled: str,
    scoring: str,
    folder: str,
    store: str,
    schema: T.StructType | str | None = None,
    scoring_schema: T.StructType | str | None = None,
    encoder: Callable[[], Encoder] = HashEncoder,
    encoder_id: str | None = None,
    max_length: int = 128,
    category: str | None = "source",
    excluded: Sequence[str] = EXCLUDED,
    folds: int | None = 5,
    holdout: float | None = None,
    **parameters: Any,
) -> Run:
    """Vectors and metadata: numbers, booleans and lists are found in the schema of both tables.

    Vectors come from the store; only texts it does not hold are encoded. The store
    knows a vector by the text, the encoder's id and the length that it sees.
    """
    own_id = f"{encoder_id or encoder().id}-{max_length}"
    known = with_key(load_labelled(spark, labelled, schema))
    others = load_scoring(spark, scoring, scoring_schema, KEY)
    features = drop_all_null(align(known, others))
    kinds = column_kinds(features, (*excluded, KEY, "label"))
    has_category = category in features.columns
    inputs = Inputs(KEY, numbers=tuple(kinds.all), category=category if has_category else None, vector="vector")

    def encode(df: DataFrame) -> DataFrame:
        return encode_texts(df, "digest", "full_text", encoder, max_length, own_id)

    def with_vectors(df: DataFrame, *more: str) -> DataFrame:
        used = [KEY, *kinds.all, *([category] if has_category else []), *more, "full_text"]
        return cached_vectors(spark, df.select(*used), store, "full_text", own_id, encode)

    return _run(with_vectors(known, "label"), with_vectors(others), model, inputs, folder, folds, parameters, holdout)


def user_table(df: DataFrame, group: str = "user_description", key: str = KEY, share: float = 0.1, seed: int = SEED) -> DataFrame:
    """One text per user with the label of the first row, and a hold-out over users.

    A user whose text is longer than a part of ``user_texts`` is an error: several
    training rows with one label would be no longer one per user.
    """
    users = user_texts(df, group, key, "full_text", label="label" if "label" in df.columns else None)
    long = F.raise_error(F.concat(F.lit("the text of a user has several parts: "), F.col(group).cast("string")))
    one = users.withColumn("part", F.when(F.col("part") == 0, F.col("part")).otherwise(long.cast("long")))
    return random_holdout(one, group, share, seed)


def _run(
    known: DataFrame,
    others: DataFrame,
    name: str,
    inputs: Inputs,
    folder: str,
    folds: int | None,
    parameters: dict[str, Any],
    holdout: float | None,
) -> Run:
    plan = training.build(name, **parameters)
    columns = [c for c in (*inputs.columns(), inputs.label) if c in known.columns]
    known = materialise(known.select(*columns), "labelled")  # every pass of every fit reads this
    mean = std = report = None
    if folds:
        mean, std = fold_summary(training.cross_validate(known, plan, inputs, folds), "accuracy").first()
    if holdout:
        report = training.report(training.holdout_scores(known, plan, inputs, holdout), inputs)
    fitted = plan.fit(prepare(known, inputs), inputs)
    scored = fitted.transform(prepare(others, inputs))
    return Run(mean, std, write_submission(scored, folder, name, inputs.key), fitted, report)
