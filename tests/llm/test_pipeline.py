"""The pipeline stage by stage, each against a brute force over its own input."""

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from lexiloom.llm import bpe, toxicity, weak_labels
from lexiloom.session import materialise

from .test_simhash import plain_fingerprint

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], FOLDER), f"test-{name}"))
    return out


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert 0 < stages[-1].count() < stages[0].count()


def test_models_decide(stages):
    good = weak_labels.score_quality(stages[0]).where("good")
    assert ids(good) == ids(stages[1])
    labels = stages[0].sparkSession.read.parquet(f"{FOLDER}/labels.parquet")
    assert ids(toxicity.score_texts(stages[1], labels).where("predicted = 0")) == ids(stages[2])


def test_one_of_each_group_stays(stages):
    rows = sorted((r.doc_id, plain_fingerprint(r.text)) for r in stages[2].collect())
    root = {d: d for d, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if (x ^ y).bit_count() <= 3:
                high, low = max(find(a), find(b)), min(find(a), find(b))
                root[high] = low
    assert ids(stages[3]) == sorted({find(d) for d in root})


def test_no_window_of_the_benchmark_is_left(stages):
    import re

    def windows(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        return {tuple(w[i : i + 10]) for i in range(max(len(w) - 9, 1))} if w else set()

    spark = stages[0].sparkSession
    items = set().union(*(windows(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()))
    assert min(map(len, items)) == 10
    want = sorted(r.doc_id for r in stages[3].collect() if not windows(r.text) & items)
    assert ids(stages[4]) == want


def test_tokens(stages):
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    for r in stages[5].collect():
        assert r.round_trip and r.token_ids == theirs.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.token_ids)


def test_run_is_registered(spark, stages):
    got = entry.queries()["pipeline"](spark, FOLDER)
    assert ids(got) == ids(stages[5])


def test_edge_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    nothing = spark.createDataFrame([], schema)
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "a", "en", "x", 1), (2, "", "en", "x", 0)] * 2, schema)
    for docs in (nothing, odd):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, FOLDER).count() <= docs.count()
        assert corpus_pipeline.tokens(spark, docs, FOLDER).where(~F.col("round_trip")).count() == 0
