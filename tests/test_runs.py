import json

import numpy as np
import pytest

from lexiloom.plans import runs
from lexiloom.session import scratch_path
from lexiloom.sources.json_lines import load_labelled
from lexiloom.sources.results import load_model, save_model


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    rng = np.random.default_rng(11)
    words = np.array(["soleil", "pluie", "vent", "neige", "orage", "brume"])
    folder = tmp_path_factory.mktemp("lines")

    def line(i, labelled):
        y = i % 2
        text = " ".join(rng.choice(words, 8, p=np.array([5, 1, 1, 1, 1, 1] if y else [1, 5, 1, 1, 1, 1]) / 10))
        row = {
            "challenge_id": i,
            "text": text[:20],
            "source": "web" if i % 3 else "app",
            "lang": "fr",
            "retweet_count": i,
            "nothing": None,
            "entities": {"hashtags": ["a"] * (i % 4)},
            "user": {"description": f"u{i % 10}", "statuses_count": i if i % 7 else None, "verified": bool(i % 2)},
            "extended_tweet": {"full_text": text},
        }
        if labelled:
            row["label"] = y
        return json.dumps(row)

    (folder / "train.jsonl").write_text("\n".join(line(i, True) for i in range(120)))
    (folder / "score.jsonl").write_text("\n".join(line(i, False) for i in range(120, 150)))
    return str(folder / "train.jsonl"), str(folder / "score.jsonl")


def check(spark, run):
    rows = spark.read.option("header", True).csv(run.predictions).collect()
    assert {int(r.ID) for r in rows} == set(range(120, 150))
    right = np.mean([int(r.Prediction) == int(r.ID) % 2 for r in rows])
    assert right > 0.7 and run.mean > 0.7 and 0 <= run.std < 0.3


def test_text_run(spark, files, tmp_path):
    check(spark, runs.train_texts(spark, "logistic_regression", *files, str(tmp_path), folds=3))


def test_metadata_run(spark, files, tmp_path):
    store = scratch_path(spark, "store")
    parameters = {"folds": 2, "rounds": 8, "depth": 3}
    run = runs.train_metadata(spark, "boosted_trees", *files, str(tmp_path), store, **parameters)
    check(spark, run)
    assert spark.read.parquet(store).count() == 150


def test_user_table(spark, files):
    df = load_labelled(spark, files[0])
    users = runs.user_table(df).collect()
    assert len(users) == 10 and {u.split for u in users} <= {"train", "val"}
    first = next(u for u in users if u.user_description == "u3")
    assert first.combined_text.startswith("u3 ") and first.label == 1 and first.part == 0


@pytest.mark.parametrize("name", ["svm", "logistic_regression", "logistic_regression_metadata", "majority"])
def test_one_run_for_each_model_on_texts_and_metadata(spark, files, tmp_path, name):
    run = runs.train_combined(spark, name, *files, str(tmp_path), folds=None, holdout=0.25, text="prompt")
    rows = spark.read.option("header", True).csv(run.predictions).collect()
    assert {int(r.ID) for r in rows} == set(range(120, 150))
    report = run.report.first()
    if name != "majority":
        assert report.accuracy > 0.7 and report.auc > 0.7
    path = scratch_path(spark, "model")
    save_model(run.model, path)
    assert load_model(path).stages


@pytest.mark.parametrize("name,parameters", [("boosted_trees_pca", {"rounds": 5, "depth": 3, "components": 8}), ("boosted_trees_layout", {"rounds": 5, "depth": 3, "layout": 3, "layout_options": {"epochs": 5, "neighbours": 8}}), ("perceptron", {"max_iter": 30}), ("logistic_regression_vectors", {})])
def test_one_run_for_each_model_on_vectors(spark, files, tmp_path, name, parameters):
    run = runs.train_metadata(spark, name, *files, str(tmp_path), scratch_path(spark, "store"), folds=None, holdout=0.25, **parameters)
    assert run.report.first().accuracy > 0.6


def test_description_alone_and_per_user(spark, files, tmp_path):
    run = runs.train_texts(spark, "logistic_regression", *files, str(tmp_path), folds=None, text="description")
    assert spark.read.option("header", True).csv(run.predictions).count() == 30
    users = runs.train_users(spark, "majority", files[0], share=0.3)
    assert 0 <= users.report.first().accuracy <= 1 and users.predictions is None
    with pytest.raises(ValueError, match="unknown text"):
        runs.train_texts(spark, "majority", *files, str(tmp_path), text="title")


def test_rows_that_share_an_id_are_predicted_from_their_own_texts(spark, tmp_path):
    def lines(labelled):
        rows = []
        for i in range(60):
            word = "soleil" if (i % 2) == labelled else "pluie"
            rows.append({"challenge_id": i, "text": " ".join([word] * 4 + [f"x{i}"]), "user": {"description": "d"}, **({"label": i % 2} if labelled else {})})
        return "\n".join(map(json.dumps, rows))

    (tmp_path / "a.jsonl").write_text(lines(True))
    (tmp_path / "b.jsonl").write_text(lines(False))
    store = scratch_path(spark, "store")
    run = runs.train_metadata(spark, "logistic_regression_vectors", str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl"), str(tmp_path), store, folds=None)
    rows = spark.read.option("header", True).csv(run.predictions).collect()
    assert np.mean([int(r.Prediction) != int(r.ID) % 2 for r in rows]) > 0.95


def test_key_is_made_from_the_row(spark):
    df = runs.with_key(spark.createDataFrame([("a",), ("a",), ("b",)], "text string"))
    keys = [r.challenge_id for r in df.collect()]
    assert keys[0] == keys[1] != keys[2]
