import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lexiloom.operators import tfidf
from lexiloom.operators.tfidf import TermRules

TEXTS = [
    "le chat noir dort sur le tapis noir",
    "un chien noir court dans le jardin",
    "le chat et le chien dorment",
    "jardin jardin jardin chat",
    "de la et le",
    "",
    "Soleil! Soleil, chat noir; chat blanc",
]
RULES = TermRules(1, 2, 2, 0.9, 8)


def grams(text, rules):
    words = [w for w in re.findall(r"\b\w\w+\b", text.lower()) if w not in rules.stop_words]
    return [" ".join(words[i : i + n]) for n in range(rules.low, rules.high + 1) for i in range(len(words) - n + 1)]


def expected(fit, apply, rules):
    docs = [grams(t, rules) for t in fit]
    tf, df = Counter(g for d in docs for g in d), Counter(g for d in docs for g in set(d))
    kept = [g for g in tf if rules.min_df <= df[g] <= rules.max_df * len(docs)]
    vocab = sorted(sorted(kept, key=lambda g: (-tf[g], g))[: rules.max_features])
    out = np.zeros((len(apply), len(vocab)))
    for i, t in enumerate(apply):
        counts = Counter(grams(t, rules))
        out[i] = [counts[g] * (math.log((1 + len(docs)) / (1 + df[g])) + 1) for g in vocab]
        out[i] /= np.linalg.norm(out[i]) or 1
    return vocab, out


def frame(spark, texts, folds=None):
    rows = [(i, t, (folds or [0] * len(texts))[i]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id long, text string, fold int")


def matrix(model, df):
    rows = model.transform(df, "text", "v").select("id", vector_to_array("v").alias("v")).orderBy("id").collect()
    return np.array([r.v for r in rows])


def test_weights_match_the_definition(spark):
    model = tfidf.fit_tfidf(frame(spark, TEXTS), "text", RULES)
    vocab, want = expected(TEXTS, TEXTS, RULES)
    assert model.terms == vocab
    got = matrix(model, frame(spark, TEXTS))
    np.testing.assert_allclose(got, want, atol=1e-12)
    assert not got[4].any() and not got[5].any()  # stop words only, and empty


def test_trigrams_and_long_form(spark):
    rules = TermRules(1, 3, 1, 1.0, 1000)
    df = frame(spark, TEXTS)
    model = tfidf.fit_tfidf(df, "text", rules)
    vocab, want = expected(TEXTS, TEXTS, rules)
    got = {(r.id, r.term): r.weight for r in model.long(df, "id", "text").collect()}
    assert got.keys() == {(i, vocab[j]) for i, j in zip(*np.nonzero(want))}
    assert all(abs(w - want[i, vocab.index(t)]) < 1e-12 for (i, t), w in got.items())


def test_rows_to_score_never_change_the_fit(spark):
    fit, other = TEXTS[:4], [*TEXTS[4:], "inconnu chat"]
    model = tfidf.fit_tfidf(frame(spark, fit), "text", RULES)
    vocab, want = expected(fit, other, RULES)
    assert model.terms == vocab
    np.testing.assert_allclose(matrix(model, frame(spark, other)), want, atol=1e-12)


@pytest.mark.parametrize("high,features", [(2, 3), (2, 8), (3, 5), (3, 1000)])
def test_pruned_counts_give_the_same_model(spark, high, features):
    rules = TermRules(1, high, 1, 0.8, features)
    df = frame(spark, [*TEXTS, "noir noir noir chat", "aa aa aa aa", "chat noir " * 9])
    plain, pruned = (tfidf.fit_tfidf(df, "text", rules, prune) for prune in (False, True))
    assert (plain.terms, plain.idf) == (pruned.terms, pruned.idf)


@pytest.mark.parametrize("prune", [False, True])
def test_one_count_serves_all_folds(spark, prune):
    folds = [0, 1, 2, 0, 1, 2, 0]
    models = tfidf.fit_tfidf_by_fold(frame(spark, TEXTS, folds), "text", "fold", 3, RULES, prune)
    for f, model in enumerate(models):
        alone = tfidf.fit_tfidf(frame(spark, [t for t, g in zip(TEXTS, folds) if g != f]), "text", RULES)
        assert (model.terms, model.idf) == (alone.terms, alone.idf)


def test_no_term_left_is_an_error(spark):
    with pytest.raises(ValueError, match="no term"):
        tfidf.fit_tfidf(frame(spark, ["le la", "un"]), "text", RULES)
    with pytest.raises(ValueError, match="max_features"):
        TermRules(max_features=0)


def test_a_text_with_hot_terms(spark):
    """Counts come from whole texts, however often one word repeats."""
    df = spark.createDataFrame([(0, "mot " * 50_000 + "fin"), (1, "mot")], "id long, text string")
    counts = {r.term: (r.tf, r.df) for r in tfidf.term_counts(tfidf.with_terms(df, "text", TermRules(1, 1))).collect()}
    assert counts == {"mot": (50_001, 2), "fin": (1, 1)}


def test_sorted_terms_are_not_recomputed_per_element(spark):
    df = tfidf.with_terms(frame(spark, TEXTS), "text", RULES)
    plan = tfidf.term_counts(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("sort_array") == 1
    assert plan.count("Exchange hashpartitioning(term") == 1


def test_first_marks_one_per_row(spark):
    df = spark.range(1).select(F.array(*[F.lit(x) for x in ("b", "a", "b")]).alias("terms"))
    assert {r.term: (r.tf, r.df) for r in tfidf.term_counts(df).collect()} == {"a": (1, 1), "b": (2, 1)}


@pytest.mark.parametrize("tokens", [3, 1 << 20])
def test_numbers_count_as_terms_do(spark, monkeypatch, tokens):
    """N-grams counted as numbers, in stretches of a few words too, are those of the arrays of terms."""
    monkeypatch.setattr(tfidf, "TOKENS", tokens)
    df = frame(spark, [*TEXTS, None, "aa aa aa aa aa", "Ünï cödé_1 ünï CÖDÉ_1"], [0, 1, 2, 0, 1, 2, 0, 1, None, 2])
    rules = TermRules(1, 3, 1, 1.0, 1000)

    def rows(counts):
        return sorted(tuple(r[c] for c in sorted(counts.columns)) for r in counts.collect())

    assert rows(tfidf.counted(df, "text", rules)) == rows(tfidf.term_counts(tfidf.with_terms(df, "text", rules)))
    known = df.where("fold is not null")
    assert rows(tfidf.counted(df, "text", rules, fold="fold", folds=3)) == rows(tfidf.term_counts_by_fold(tfidf.with_terms(known, "text", rules), "fold", 3))
    only, low = {"noir", "chat", "aa"}, TermRules(2, 3, 1, 1.0, 1000)
    assert rows(tfidf.counted(df, "text", low, only)) == rows(tfidf.term_counts(tfidf.with_terms(df, "text", low, only=only)))


def test_the_vocabulary_leaves_out_grams_of_rare_words(spark):
    rules = TermRules(1, 3, 1, 1.0, 4)
    df = frame(spark, [*TEXTS, "chat noir " * 9])
    counts = tfidf.candidate_counts(df, "text", df.count(), rules)
    every = tfidf.term_counts(tfidf.with_terms(df, "text", rules))
    assert counts.count() < every.count()
    assert [tuple(r) for r in tfidf.vocabulary(counts, 8, rules).collect()] == [tuple(r) for r in tfidf.vocabulary(every, 8, rules).collect()]


def test_long_form_of_terms_that_start_alike(spark):
    model = tfidf.TfidfModel(TermRules(1, 3, 1, 1.0, 9, ()), ["aa", "aa bb cc", "bb cc", "cc"], [1.0, 2.0, 3.0, 4.0])
    df = frame(spark, ["aa bb cc", "aa bb", "bb aa bb cc aa", "dd", ""])
    got = {(r.id, r.term): r.weight for r in model.long(df, "id", "text").collect()}
    want = matrix(model, df)
    assert got == pytest.approx({(i, model.terms[j]): want[i, j] for i, j in zip(*np.nonzero(want))})
