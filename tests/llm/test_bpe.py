"""BPE against the tiktoken library, which is used in this test alone."""

import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from lexiloom.llm import bpe
from lexiloom.llm.blocks import blocks

RANKS = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(RANKS)


def encoded(texts, vocabulary):
    own = bpe.Encoder(vocabulary)
    out = []
    for block in blocks(pa.array(texts, pa.string()), lower=False, most=4000):
        ids, counts = own.encode(block)
        at = 0
        for n in counts:
            out.append(ids[at : at + n].tolist())
            at += n
    return out


def test_every_code_point(vocabulary):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c} {c}b" for c in every[i : i + 500]) for i in range(0, len(every), 500)]
    for got, text in zip(encoded(texts, vocabulary), texts, strict=True):
        if got != THEIRS.encode_ordinary(text):
            bad = [c for c in text if encoded([f"a{c} {c}b"], vocabulary)[0] != THEIRS.encode_ordinary(f"a{c} {c}b")]
            assert not bad, [hex(ord(c)) for c in set(bad)][:20]


def test_edges(vocabulary):
    texts = ["", None, "it's 'store 're'really ''s !'s 'S it'", " 's\n'll x'l 'r", "  a   b \n\n c\t\td  ", "don't'd'm 12 3'4", " ", "\n", "'", "a" * 700, "ab" * 3000, "é" * 400, "12" * 300, "<|endoftext|>"]
    assert encoded(texts, vocabulary) == [THEIRS.encode_ordinary(t or "") for t in texts]


def test_random_texts(vocabulary):
    random.seed(3)
    alphabet = list("abcdelrstvm'' \n\t.,!") + ["é", "ß", "中", "１", "　", "\x1c", "\x85", "​", "😀", "the", " ing", "'re", "'ll"]
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 80))) for _ in range(3000)]
    assert encoded(texts, vocabulary) == [THEIRS.encode_ordinary(t) for t in texts]


def test_forest_and_single_tree_agree(vocabulary):
    random.seed(4)
    for _ in range(30):
        text = "".join(random.choices("abcdefgéßing", k=random.randint(2, 200))).encode()[:250]
        width = 1 << (len(text) - 1).bit_length()
        column = np.frombuffer(text.ljust(width, b"\0"), np.uint8)[:, None]
        forest = bpe.merge_forest(column, np.array([len(text)]), vocabulary)
        assert forest[forest >= 0].tolist() == bpe.merge_one(text, vocabulary).tolist()


@pytest.fixture(scope="module")
def codec(spark):
    return bpe.Codec(spark, RANKS)


def test_round_trip_and_columns(spark, codec):
    rows = [(1, "Hello, wörld's  end\n", 5), (2, None, 6), (None, "", 7), (1, "Hello, wörld's  end\n", 5), (4, "x" * 2000, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = df.withColumn("tokens", codec.encode("text")).withColumn("bytes", codec.decode("tokens"))
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.tokens == THEIRS.encode_ordinary(r.text or "")
        assert bytes(r.bytes).decode() == (r.text or "")


def test_empty_table_and_unknown_id(spark, codec):
    df = spark.createDataFrame([], "text string")
    assert df.select(codec.decode(codec.encode("text"))).collect() == []
    with pytest.raises(Exception, match="not in the vocabulary"):
        spark.createDataFrame([([70000],)], "ids array<int>").select(codec.decode("ids")).collect()
