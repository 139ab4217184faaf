"""PPM against a plain recursive version, and the base against plain counts."""

import math
import random
import re
import zlib
from collections import Counter

import pytest

from lexiloom.llm import ppm


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain_model(texts, order):
    seen = Counter()
    for t in texts:
        s = [256] * order + list(low(t).encode()) + [256]
        for i in range(order, len(s)):
            for k in range(order + 1):
                seen[tuple(s[i - k : i + 1])] += 1
    follow = {}
    for run, n in seen.items():
        follow.setdefault(run[:-1], {})[run[-1]] = n
    return follow


def plain_score(text, follow, order):
    s = [256] * order + list(low(text).encode()) + [256]
    total = 0.0
    for i in range(order, len(s)):
        excluded, p = set(), 1.0
        for k in range(order, -1, -1):
            known = follow.get(tuple(s[i - k : i]), {})
            options = {x: n for x, n in known.items() if x not in excluded}
            excluded |= set(known)
            if not options:
                continue
            escapes = len(options) if len(excluded) < 257 else 0
            if s[i] in options:
                p *= options[s[i]] / (sum(options.values()) + escapes)
                break
            p *= escapes / (sum(options.values()) + escapes)
        else:
            p /= 257 - len(excluded)
        total += math.log10(p)
    return total


def check(spark, rows, order):
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(3)
    got = {(r.doc_id, r.text): r for r in ppm.score_texts(df, order=order, min_share=0.0).collect()}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    training = [t for i, t in rows if not held(i)]
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None]
    counts = Counter(w for t in training for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    follow = plain_model(training, order)
    for i, t in rows:
        r = got[i, t]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held(i), len(tokens(t)), n)
        assert r.n_known == sum(counts[w] > 0 for w in tokens(t))
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), rel=1e-9)
        assert r.score == pytest.approx(plain_score(t, follow, order), rel=1e-5)


@pytest.mark.parametrize("order", [1, 3])
def test_against_plain_versions(spark, order):
    random.seed(order)
    pool = ["the", "The", "cat", "é", "sat\x1c", "中", "mat,", "\t", "\n", "xyz"]
    rows = [(i, " ".join(random.choices(pool, k=random.randint(0, 30)))) for i in range(60)] + [(None, "a cat"), (70, None), (71, ""), (72, "zz qq ß")]
    check(spark, rows, order)


def test_repeated_rows_are_all_there(spark):
    df = spark.createDataFrame([(None, "a b a"), (None, "a b a"), (None, "c")], "doc_id long, text string")
    got = sorted((r.n_tokens, r.n_known, round(r.base_score, 9)) for r in ppm.score_texts(df).collect())
    assert len(got) == 3 and got[1] == got[2] and got[1][:2] == (4, 4)


def test_nothing_to_learn_from(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    df = spark.createDataFrame([(i, "ab") for i in ids], "doc_id long, text string")
    for r in ppm.score_texts(df).collect():
        assert r.score == pytest.approx(-3 * math.log10(257)) and (r.n_known, r.train_tokens, r.base_score) == (0, 0, 0.0)
    assert ppm.score_texts(df.where("false")).count() == 0


def test_pruning_keeps_a_distribution():
    import numpy as np

    follow = plain_model(["abracadabra", "abba"], 3)
    levels = []
    for k in range(4):
        runs = sorted((sum(x << (9 * (k - j)) for j, x in enumerate(c + (s,))), n) for c, f in follow.items() if len(c) == k for s, n in f.items())
        keys = np.array([r[0] for r in runs])
        levels.append((np.unique(keys >> 9), keys, np.array([r[1] for r in runs])))
    levels[3] = tuple(x[:3] for x in levels[3])
    model = ppm.build(3, levels)
    assert np.allclose((10.0**model.table).sum(axis=1), 1, atol=1e-5)


def test_rare_contexts_stay(spark):
    """A context with a tiny share of all symbols predicts like any other, in chunks of any size."""
    rare = "щука ловит рыбу"
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 != 2]
    rows = [(i, "the cat sat on the mat, " * 800) for i in ids] + [(None, rare), (None, rare), (100, rare)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    follow = plain_model([t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2], ppm.ORDER)
    got = [r.score for r in ppm.score_texts(df).collect() if r.text == rare]
    assert len(got) == 3
    for score in got:
        assert score == pytest.approx(plain_score(rare, follow, ppm.ORDER), rel=1e-5)
