"""Phrase counts and scores against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lexiloom.llm import phrases


def pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def plain_counts(rows):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    return f, n


def plain(rows, least, percent, most):
    f, n = plain_counts(rows)
    candidates = {g: a for g, a in f.items() if a >= least and len(g[1]) > 1}
    inside = defaultdict(int)
    for (lang, w), a in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(inside[lang, w[i : i + k]], a)
    out = defaultdict(list)
    for (lang, w), a in candidates.items():
        if (lang, w) in inside and 100 * inside[lang, w] >= percent * a:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted(
        (lang, i + 1, p.decode(), -a, left, right, n[lang], -s)
        for lang, found in out.items()
        for i, (s, a, p, left, right) in enumerate(sorted(found)[:most])
    )


def made_up(seed, texts):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "New", "york", "City", "É", "中文", "a\x0bb", "x\x00y", "|", "\U0001f600"] + [f"w{i}" for i in range(40)]
    weights = [30, 20, 9, 9, 9, 5, 5, 2, 2, 8, 3] + [1] * 40
    rows = []
    for _ in range(texts):
        parts = []
        for _ in range(rng.randint(0, 12)):
            w = rng.choices(vocabulary, weights, k=rng.randint(0, 9))
            if rng.random() < 0.4:
                w[rng.randint(0, len(w)) :] = ["new", "york", "city", "of", "the", "w1"][: rng.randint(2, 6)]
            parts.append(rng.choice([" ", "\t", "  "]).join(w))
        rows.append((rng.choice(["en", "en", "en", "fr", None, "und"]), rng.choice([".", ", ", "\n", "!?"]).join(parts)))
    return rows


@pytest.mark.parametrize(("least", "percent", "most"), [(3, 100, 2000), (5, 80, 7)])
def test_against_plain(spark, least, percent, most):
    rows = made_up(1, 300) + [("en", None), ("en", ""), ("xx", " .,\n"), (None, "one"), ("de", "zz yy " * 3000)]
    rows += [("en", "licensed under the terms of it. " * 3)] * 50
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "lang string, text string, rank int, phrase string").repartition(5)
    got = phrases.collocations(df, min_count=least, percent=percent, most=most)
    assert sorted(map(tuple, got.collect())) == plain(rows, least, percent, most)


@pytest.mark.parametrize(("burst", "entries", "chunk", "ids", "pending"), [(2, 7, 5, 12, 3), (8, 100, 50, 30, 40), (1 << 13, 1 << 20, 1 << 19, 1 << 16, 1 << 20)])
def test_bounds_do_not_matter(monkeypatch, burst, entries, chunk, ids, pending):
    """Bursts, spills, full dictionaries and early sums change nothing; the bitmap lets all words through."""
    for name, value in {"BURST": burst, "ENTRIES": entries, "CHUNK": chunk, "PENDING": pending}.items():
        monkeypatch.setattr(phrases, name, value)
    real_insert_limit = ids
    rows = [(lang or "und", text) for lang, text in made_up(2, 60)]
    batches = [pa.RecordBatch.from_pylist([{"lang": a, "text": b} for a, b in rows[i : i + 20]]) for i in range(0, 60, 20)]
    if real_insert_limit < phrases.IDS:
        monkeypatch.setattr(phrases, "IDS", real_insert_limit)
        monkeypatch.setattr(phrases, "trie_runs", small_ids(phrases.trie_runs))
    everything = np.full(8, 255, np.uint8)
    got = Counter()
    for make in (phrases.run_maker(everything, 3), phrases.run_maker(everything, 3, everything)):
        runs = list(make(iter(batches)))
        for part in range(3):
            own = [b.filter(pa.array([p == part for p in b.column(0).to_pylist()])) for b in runs]
            for b in phrases.run_merger(2)(iter(own)):
                for lang, phrase, f in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    assert (lang, phrase) not in got
                    got[lang, phrase] = f
    expected, _ = plain_counts(rows)
    assert got == {(lang, " ".join(w)): f for (lang, w), f in expected.items() if f >= 2 and len(w) > 1}


def small_ids(real):
    """Fewer ids for the insertion alone: suffixes keep their 16 bits."""

    def runs(*args):
        small, phrases.IDS = phrases.IDS, 1 << 16
        out = list(real(*args))
        phrases.IDS = small
        return iter(out)

    return runs


def test_runs_round_trip():
    values = [b"a", "ü".encode(), b"x\x00"]
    for counts in ([1, 255], [1, 2**40]):
        run = phrases.pack_run(values, np.array([[1, 2, 0], [3, 1, 2]], np.uint16), np.array(counts))
        got = phrases.unpack_run(run)
        assert got[0] == values and got[1].tolist() == [[1, 2, 0], [3, 1, 2]] and got[2].tolist() == counts


def test_bitmaps_hold_the_rows(spark):
    rows = [("en", f"w{i}", f"v{i}") for i in range(2000)]
    df = spark.createDataFrame(rows[::2], "lang string, word string, other string")
    first, second = (phrases.value_hashes(pa.array([r[k].encode() for r in rows], pa.large_binary()), "en") for k in (1, 2))
    for columns, size, hashes in ((["word"], 1 << 24, first), (["word", "other"], 1 << 26, phrases.pair_hashes(first, second))):
        inside = phrases.flagged(phrases.frequent_bitmap(df, columns, size), hashes)
        assert inside[::2].all() and inside[1::2].sum() < 5


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
