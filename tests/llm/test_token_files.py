"""Token counts against a plain walk over the files."""

import random

import numpy as np
import pytest

from lexiloom.llm import token_files

EOD = 500


def plain(tokens):
    out, start = [], 0
    for i, t in enumerate(tokens):
        if t == EOD:
            out.append((len(out), start, i - start, True))
            start = i + 1
    if start < len(tokens):
        out.append((len(out), start, len(tokens) - start, False))
    return out


@pytest.mark.parametrize("width", [2, 4])
def test_raw_files(spark, tmp_path, width):
    random.seed(width)
    files = [[], [EOD], [1, 2, 3], [EOD, EOD, 4], [random.choice([1, 2, 3, EOD]) for _ in range(300)], [7] * 50 + [EOD] + [8] * 61, [5] * 16 + [EOD] * 16]
    for i, tokens in enumerate(files):
        np.array(tokens, f"<u{width}").tofile(tmp_path / f"{i}.bin")
    for size in (1, 7, 16, 1000):
        blocks = token_files.read_blocks(spark, str(tmp_path), size, width)
        got = {}
        for r in token_files.count_tokens(blocks, EOD, width).orderBy("file", "ordinal").collect():
            got.setdefault(int(r.file.split("/")[-1][:-4]), []).append((r.ordinal, r.start, r.n_tokens, r.ended))
        assert got == {i: plain(t) for i, t in enumerate(files) if t}


def test_too_large_file_raises(spark, tmp_path):
    np.zeros(100, np.uint16).tofile(tmp_path / "a.bin")
    with pytest.raises(Exception, match="too large"):
        token_files.read_blocks(spark, str(tmp_path), most=50).collect()


def test_documents_find_their_names(spark):
    random.seed(9)
    docs = [(i if i % 10 else None, [random.randrange(EOD) for _ in range(random.choice([0, 1, 5, 40]))] if i % 7 else None) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, ids array<int>").repartition(3)
    for size in (8, 64, 100_000):
        got = token_files.named_counts(token_files.write_blocks(df, "doc_id", "ids", EOD, block_tokens=size), EOD)
        assert sorted(((r.doc_id, r.n_tokens) for r in got.collect()), key=repr) == sorted(((i, len(t or ())) for i, t in docs), key=repr)


def test_texts_are_encoded_as_they_are_written(spark):
    import public_tokenizers as P

    from lexiloom.llm import bpe

    codec = bpe.Codec(spark, bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")))
    df = spark.createDataFrame([(i, None if i % 9 == 0 else f"Some words, {i} times " * (i % 5)) for i in range(60)], "doc_id long, text string").repartition(2)
    want = {r.doc_id: r.n for r in df.select("doc_id", token_files.F.size(codec.encode("text")).alias("n")).collect()}
    blocks = token_files.write_texts(df, "doc_id", "text", codec, 50256, block_tokens=100)
    assert {r.doc_id: r.n_tokens for r in token_files.named_counts(blocks, 50256).collect()} == want


def test_empty_and_wrong_tables(spark):
    df = spark.createDataFrame([], "doc_id long, ids array<int>")
    assert token_files.named_counts(token_files.write_blocks(df, "doc_id", "ids", EOD), EOD).collect() == []
    with pytest.raises(Exception, match="separator"):
        token_files.write_blocks(spark.createDataFrame([(1, [EOD])], "doc_id long, ids array<int>"), "doc_id", "ids", EOD)
