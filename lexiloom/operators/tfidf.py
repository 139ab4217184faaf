"""N-gram TF-IDF.

Counting terms is one shuffle with map-side combine. The vocabulary is bounded
by ``max_features``; with it every text becomes a vector inside its own row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
    SQLTransformer,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions.stopwords import FRENCH
from lexiloom.functions.tokens import TOKEN, word_tokens
from lexiloom.session import materialise

MAX_VOCABULARY = 1 << 18
MAX_WORDS = 20_000
TOKENS = 1 << 20  # counted at a time in a task, or one text


@dataclass(frozen=True)
class TermRules:
    """Which terms count, and how many of them are kept."""

    low: int = 1
    high: int = 2
    min_df: int = 3
    max_df: float = 0.7
    max_features: int = 1000
    stop_words: tuple[str, ...] = FRENCH

    def __post_init__(self) -> None:
        if not 1 <= self.max_features <= MAX_VOCABULARY:
            raise ValueError(f"max_features must lie in 1..{MAX_VOCABULARY}")
        if not 1 <= self.low <= self.high:
            raise ValueError("need 1 <= low <= high")


# The two parameter sets in use.
SMALL = TermRules(low=1, high=2, min_df=3, max_df=0.7, max_features=1000)
LARGE = TermRules(low=1, high=3, min_df=2, max_df=0.85, max_features=5000)


def term_stages(text: str, output: str, rules: TermRules, only: Iterable[str] | None = None) -> list[Transformer]:
    """Text to the array of its n-grams, shortest first; repeated terms stay.

    With ``only``, n-grams that hold any other word are left out.
    """
    words, kept = f"{output}_words", f"{output}_kept"
    pattern = TOKEN.replace("\\", "\\\\")
    tokens = f"regexp_extract_all(lower(coalesce(`{text}`, '')), '{pattern}', 0)"
    stops = f"filter(`{words}`, t -> t NOT IN ({_listed(rules.stop_words)}))" if rules.stop_words else f"`{words}`"
    steps = [(words, tokens), (kept, stops if only is None else f"transform({stops}, t -> CASE WHEN t IN ({_listed(only)}) THEN t END)")]
    grams = [f"{output}_{n}" for n in range(1, rules.high + 1)]
    for n, name in enumerate(grams, start=1):
        if n == 1:
            steps.append((name, f"`{kept}`"))
            continue
        pairs = f"zip_with(`{grams[n - 2]}`, slice(`{kept}`, {n}, size(`{kept}`)), (a, b) -> concat(a, ' ', b))"
        steps.append((name, f"slice({pairs}, 1, greatest(size(`{kept}`) - {n - 1}, 0))"))
    joined = "concat({})".format(", ".join(f"`{g}`" for g in grams[rules.low - 1 :]))
    steps.append((output, joined if only is None else f"filter({joined}, t -> t IS NOT NULL)"))

    statement = "__THIS__"
    for name, expression in steps:
        statement = f"(SELECT *, {expression} AS `{name}` FROM {statement})"
    gone = ", ".join(f"`{c}`" for c in [words, kept, *grams])
    return [SQLTransformer(statement=f"SELECT * EXCEPT ({gone}) FROM {statement}")]


def with_terms(
    df: DataFrame, text: str, rules: TermRules, output: str = "terms", only: Iterable[str] | None = None
) -> DataFrame:
    return PipelineModel(term_stages(text, output, rules, only)).transform(df)


def term_counts(df: DataFrame, terms: str = "terms") -> DataFrame:
    """``term, tf, df``: occurrences in the corpus and number of rows that hold the term."""
    return (
        _exploded(df, terms, [])
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("tf"), F.count_if("first").alias("df"))
    )


def term_counts_by_fold(df: DataFrame, fold: str, folds: int, terms: str = "terms") -> DataFrame:
    """As ``term_counts``, with one pair ``tf_i, df_i`` per fold, still in one shuffle."""
    return (
        _exploded(df, terms, [fold])
        .groupBy("term")
        .agg(
            *[F.count_if(F.col(fold) == i).alias(f"tf_{i}") for i in range(folds)],
            *[F.count_if((F.col(fold) == i) & F.col("first")).alias(f"df_{i}") for i in range(folds)],
        )
    )


def counted(
    df: DataFrame, text: str, rules: TermRules, only: Iterable[str] | None = None, fold: str | None = None, folds: int = 0
) -> DataFrame:
    """As ``term_counts`` of ``with_terms``, or ``term_counts_by_fold``: n-grams are counted as numbers before they are text.

    A task numbers the words of some texts, sorts the numbers of their n-grams, and hands on one row per
    distinct n-gram.
    """
    stops, chosen = pa.array(rules.stop_words, pa.string()), None if only is None else pa.array(sorted(only), pa.string())

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                yield from _tally(part, rules, stops, chosen)

    place = F.lit(0) if fold is None else F.col(fold).cast("int")
    words = df.select(word_tokens(text).alias("w"), place.alias("fold")).where("fold is not null")
    found = words.mapInArrow(tally, "term string, fold int, tf long, df long")
    if fold is None:
        return found.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    parts = [(c, i) for c in ("tf", "df") for i in range(folds)]
    sums = [F.coalesce(F.sum(F.when(F.col("fold") == i, F.col(c))), F.lit(0)).alias(f"{c}_{i}") for c, i in parts]
    return found.groupBy("term").agg(*sums)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Stretches of texts, given as lists of words, with about ``TOKENS`` words each."""
    sizes = np.diff(batch.column(0).offsets.to_numpy()).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // TOKENS
    for rows in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(part)) + 1):
        if len(rows):
            yield batch.slice(rows[0], len(rows))


def _numbered(batch: pa.RecordBatch, stops: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some texts, and of every word that is no stop word its number and its row."""
    tokens = batch.column(0).flatten().dictionary_encode()
    names, word = tokens.dictionary, tokens.indices.to_numpy()
    row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(0).offsets.to_numpy()))
    kept = ~pc.is_in(names, stops).to_numpy(zero_copy_only=False)[word]
    return names, word[kept].astype(np.int64), row[kept]


def _tally(batch: pa.RecordBatch, rules: TermRules, stops: pa.Array, chosen: pa.Array | None) -> Iterator[pa.RecordBatch]:
    """``term, fold, tf, df`` of the n-grams of some texts."""
    names, word, row = _numbered(batch, stops)
    valid = np.ones(len(word), bool) if chosen is None else pc.is_in(names, chosen).to_numpy(zero_copy_only=False)[word]
    fold = batch.column(1).to_numpy()[row]
    folds = int(fold.max(initial=0)) + 1
    at, number = np.flatnonzero(valid), word  # where n-grams start, and the number of the one that starts there
    for n in range(1, rules.high + 1):
        if n > 1:
            at = at[at + n <= len(word)]
            end = at + n - 1
            at = at[valid[end] & (row[end] == row[at])]
            number = number * max(len(names), 1)
            number[at] += word[at + n - 1]
        if not len(at):
            return
        key = number[at] * folds + fold[at]
        order = np.argsort(key, kind="stable")  # rows stay in order
        key, place = key[order], at[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        first = new | np.concatenate(([True], row[place[1:]] != row[place[:-1]]))
        starts, group = np.flatnonzero(new), np.cumsum(new) - 1
        term = np.cumsum(np.concatenate(([True], key[1:] // folds != key[:-1] // folds))) - 1
        number = np.zeros(len(word), np.int64)
        number[place] = term
        if n < rules.low:
            continue
        head = place[starts]
        texts = [names.take(pa.array(word[head + j])) for j in range(n)]
        joined = pc.binary_join_element_wise(*texts, " ") if n > 1 else texts[0]
        counts = np.diff(np.append(starts, len(key))), np.bincount(group[first], minlength=len(starts))
        columns = [joined, pa.array(fold[head].astype(np.int32)), *(pa.array(c.astype(np.int64)) for c in counts)]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "fold", "tf", "df"])


def candidate_counts(df: DataFrame, text: str, rows: int, rules: TermRules) -> DataFrame:
    """``term, tf, df`` of all terms that can be in the vocabulary of ``rows`` texts, and of others."""
    return _counts(rules, partial(counted, df.select(text), text), [View(F.col("tf"), F.col("df"), rows)], _worth(rules, True))


def vocabulary(counts: DataFrame, rows: int, rules: TermRules) -> DataFrame:
    """The kept terms: ``min_df <= df <= max_df * rows``, then the most frequent, ties by term."""
    kept = counts.filter((F.col("df") >= rules.min_df) & (F.col("df") <= rules.max_df * rows))
    return kept.orderBy(F.desc("tf"), "term").limit(rules.max_features)


def smooth_idf(rows: int, df: int) -> float:
    return math.log((1 + rows) / (1 + df)) + 1


@dataclass(frozen=True)
class TfidfModel:
    """Vocabulary in alphabetical order with its weights; applies to any table."""

    rules: TermRules
    terms: list[str] = field(repr=False)
    idf: list[float] = field(repr=False)

    def weight_stages(self, terms: str, output: str) -> list[Transformer]:
        counts, weighted = f"{output}_tf", f"{output}_weighted"
        return [
            CountVectorizerModel.from_vocabulary(self.terms, inputCol=terms, outputCol=counts),
            ElementwiseProduct(scalingVec=Vectors.dense(self.idf), inputCol=counts, outputCol=weighted),
            Normalizer(p=2.0, inputCol=weighted, outputCol=output),
            SQLTransformer(statement=f"SELECT * EXCEPT (`{counts}`, `{weighted}`) FROM __THIS__"),
        ]

    def words(self) -> set[str]:
        """The words the vocabulary is made of; no other word can matter."""
        return {word for term in self.terms for word in term.split(" ")}

    def stages(self, text: str, output: str) -> list[Transformer]:
        terms = f"{output}_terms"
        drop = SQLTransformer(statement=f"SELECT * EXCEPT (`{terms}`) FROM __THIS__")
        only = few(self.words())
        return [*term_stages(text, terms, self.rules, only), *self.weight_stages(terms, output), drop]

    def transform(self, df: DataFrame, text: str, output: str = "tfidf") -> DataFrame:
        return PipelineModel(self.stages(text, output)).transform(df)

    def long(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """``key, term, weight`` of the non-zero entries, without a shuffle; the weights are those of ``transform``."""
        levels, rules = Levels.of(self.terms), self.rules
        idf, names, stops = np.array(self.idf), pa.array(self.terms, pa.string()), pa.array(self.rules.stop_words, pa.string())

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in _parts(batch):
                    row, term = levels.found(part, rules, stops)
                    both, counts = np.unique(row * len(idf) + term, return_counts=True)
                    row, term = np.divmod(both, len(idf))
                    weight = counts * idf[term]
                    length = np.sqrt(np.bincount(row, weight * weight, part.num_rows))
                    columns = [part.column(1).take(pa.array(row)), names.take(pa.array(term)), pa.array(weight / length[row])]
                    yield pa.RecordBatch.from_arrays(columns, names=[key, "term", "weight"])

        kinds = T.StructType([df.schema[key], T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())])
        return df.select(word_tokens(text).alias("_words"), key).mapInArrow(cells, kinds)


@dataclass(frozen=True)
class Levels:
    """A vocabulary as sorted numbers: those of its first n words in a row, for every n, and the term they are, or -1."""

    words: pa.Array
    heads: list[np.ndarray]
    terms: list[np.ndarray]

    @classmethod
    def of(cls, terms: Sequence[str]) -> Levels:
        parts = [t.split(" ") for t in terms]
        words = sorted({w for p in parts for w in p})
        place = {w: i for i, w in enumerate(words)}
        number, heads, ends = np.zeros(len(parts), np.int64), [], []
        for n in range(1, max(map(len, parts)) + 1):
            at = np.array([i for i, p in enumerate(parts) if len(p) >= n])
            head, mine = np.unique(number[at] * len(words) + [place[parts[i][n - 1]] for i in at], return_inverse=True)
            number[at] = mine
            end = np.full(len(head), -1)
            whole = np.array([len(parts[i]) == n for i in at])
            end[mine[whole]] = at[whole]
            heads.append(head)
            ends.append(end)
        return cls(pa.array(words, pa.string()), heads, ends)

    def found(self, batch: pa.RecordBatch, rules: TermRules, stops: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row and term of every occurrence in the lists of words of a batch."""
        names, word, row = _numbered(batch, stops)
        own = pc.fill_null(pc.index_in(names, self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)[word]
        at, number, out = np.arange(len(own)), np.zeros(len(own), np.int64), [(np.zeros(0, np.int64),) * 2]
        for n, (head, end) in enumerate(zip(self.heads, self.terms, strict=True), start=1):
            stay = at + n <= len(own)
            at, number = at[stay], number[stay]
            stay = (own[at + n - 1] >= 0) & (row[at + n - 1] == row[at])
            at, number = at[stay], number[stay]
            key = number * len(self.words) + own[at + n - 1]
            number = np.minimum(np.searchsorted(head, key), len(head) - 1)
            stay = head[number] == key
            at, number = at[stay], number[stay]
            whole = end[number] >= 0
            if rules.low <= n <= rules.high:
                out.append((row[at[whole]], end[number[whole]]))
        return np.concatenate([r for r, _ in out]), np.concatenate([t for _, t in out])


def fit_tfidf(df: DataFrame, text: str, rules: TermRules = SMALL, prune: bool = True) -> TfidfModel:
    """Learn vocabulary and weights from the rows given, and from no others.

    ``prune`` counts n-grams of frequent words only, which gives the same
    vocabulary (see ``_counts``), with a second reading of the texts.
    """
    rows = df.count()
    view = View(F.col("tf"), F.col("df"), rows)
    counts = _counts(rules, partial(counted, df.select(text), text), [view], _worth(rules, prune))
    return _model(counts, rows, rules)


def fit_tfidf_by_fold(
    df: DataFrame, text: str, fold: str, folds: int, rules: TermRules = SMALL, prune: bool = True
) -> list[TfidfModel]:
    """One model per fold, learnt from the other folds; the texts are read once for all."""
    rows = {r[fold]: r["count"] for r in df.groupBy(fold).count().filter(F.col(fold).isNotNull()).collect()}
    views = []
    for held_out in range(folds):
        others = [i for i in range(folds) if i != held_out]
        tf, n = (sum(F.col(f"{c}_{i}") for i in others) for c in ("tf", "df"))
        views.append(View(tf, n, sum(rows.get(i, 0) for i in others)))

    count = partial(counted, df.select(text, fold), text, fold=fold, folds=folds)
    counts = _counts(rules, count, views, _worth(rules, prune))
    counts = materialise(counts.filter(_any(v.df >= rules.min_df for v in views)), "term-counts")
    return [_model(counts.select("term", v.tf.alias("tf"), v.df.alias("df")), v.rows, rules) for v in views]


@dataclass(frozen=True)
class View:
    """Counts of a term as one of several fits sees them, and its number of rows."""

    tf: Column
    df: Column
    rows: int


def few(words: Iterable[str]) -> set[str] | None:
    """A set small enough to stand in an expression, or None."""
    words = set(words)
    return words if 0 < len(words) <= MAX_WORDS else None


def _worth(rules: TermRules, prune: bool) -> bool:
    return prune and rules.low == 1 and rules.high > 1


def _counts(rules: TermRules, count: Callable[..., DataFrame], views: Sequence[View], prune: bool) -> DataFrame:
    """Counts of all terms that can enter a vocabulary.

    An n-gram occurs at most as often, and in at most as many rows, as each of
    its words. So once single words are counted, an n-gram with a word rarer
    than the last single word that would be kept cannot be kept itself. Leaving
    it out costs a second reading of the texts and saves the shuffle of nearly
    all distinct n-grams.
    """
    if not prune:
        return count(rules)
    common = _any(v.df >= rules.min_df for v in views)
    words = materialise(count(replace(rules, high=1)).filter(common), "words")
    frequent = []
    for v in views:
        kept = words.filter((v.df >= rules.min_df) & (v.df <= rules.max_df * v.rows)).select(v.tf.alias("tf"))
        last = kept.orderBy(F.desc("tf")).limit(rules.max_features).agg(F.count("tf").alias("n"), F.min("tf").alias("tf")).first()
        least = last["tf"] if last["n"] == rules.max_features else 1
        frequent.append((v.tf >= least) & (v.df >= rules.min_df))
    chosen = [r["term"] for r in words.filter(_any(frequent)).select("term").limit(MAX_WORDS + 1).collect()]
    if not chosen:
        return words
    only = few(chosen)
    if only is None:
        return count(rules)
    return words.unionByName(count(replace(rules, low=2), only=only))


def _any(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _listed(words: Iterable[str]) -> str:
    quoted = (w.replace("\\", "\\\\").replace("'", "\\'") for w in sorted(words))
    return ", ".join(f"'{w}'" for w in quoted)


def _model(counts: DataFrame, rows: int, rules: TermRules) -> TfidfModel:
    kept = sorted((r["term"], r["df"]) for r in vocabulary(counts, rows, rules).collect())
    if not kept:
        raise ValueError("no term passes min_df and max_df")
    return TfidfModel(rules, [t for t, _ in kept], [smooth_idf(rows, n) for _, n in kept])


def _exploded(df: DataFrame, terms: str, keep: Sequence[str]) -> DataFrame:
    """One row per occurrence; ``first`` marks one occurrence per row and term.

    Sorting the terms inside the row puts equal ones next to each other, so both
    counts come from one pass instead of a second shuffle on (row, term).
    """
    ordered = df.select(*keep, F.sort_array(terms).alias("_s"))
    marked = F.transform(
        "_s",
        lambda t, i: F.struct(
            t.alias("term"), ((i == 0) | (F.get("_s", i - 1) != t)).alias("first")
        ),
    )
    return ordered.select(*keep, F.inline(marked))
