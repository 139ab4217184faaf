"""Decontamination against a plain walk over all windows."""

import random
import re

import numpy as np
import pytest

from lexiloom.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, items, window):
    w = tokens(text)
    hit, found = set(), set()
    for item, body in items:
        b = tokens(body)
        n = min(window, len(b))
        if not n:
            continue
        windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found |= {None if item is None else str(item)}
    return len(w), len(hit), sorted(found - {None})


def cases():
    random.seed(8)
    pool = ["a", "b", "c", "é", "x9", "the"]
    text = lambda n: " ".join(random.choices(pool, k=n))
    items = [(i, text(random.choice([1, 3, 4, 5, 9, 14]))) for i in range(12)] + [(3, text(6)), (20, None), (21, "!?"), (None, text(5)), (22, "Unique-Words only here, and NOWHERE else")]
    docs = [(1, None), (2, ""), (3, "..."), (None, text(30)), (4, items[0][1]), (4, items[0][1]), (5, "x " + " ".join(b or "" for _, b in items)), (6, "unique words ONLY here and nowhere else!")]
    docs += [(i, text(random.choice([2, 8, 40]))) for i in range(10, 60)] + [(70, " ".join(["rare" + str(i) for i in range(50)]))]
    return docs, items


@pytest.mark.parametrize("item_bytes", [1 << 20, 100])
@pytest.mark.parametrize("window", [4, 10])
def test_against_all_windows(spark, monkeypatch, window, item_bytes):
    docs, items = cases()
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, n_hit int").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.find_benchmark(df, benchmark, window=window, item_bytes=item_bytes).collect()
    got = sorted(((r.doc_id, r.text, r.n_words, r.n_hit, r.items) for r in rows), key=repr)
    assert got == sorted(((i, t, *plain(t, items, window)) for i, t in docs), key=repr)
    bodies = {str(i): [tokens(b) for j, b in items if j == i] for i, _ in items}
    for r in rows:
        for m in r.matches:
            own = tokens(r.text)[m.word : m.word + m.words]
            assert len(own) == m.words and any(b[m.item_word : m.item_word + m.words] == own for b in bodies[str(m.item)])
    clean = decontaminate.decontaminate(df, benchmark, window=window)
    assert clean.columns == df.columns
    assert sorted(r.doc_id or 0 for r in clean.collect()) == sorted(i or 0 for i, t in docs if not plain(t, items, window)[1])


def test_matches_are_the_longest(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    df = spark.createDataFrame([(1, f"zero {item} thirteen"), (2, "two three four five six seven eight nine ten eleven x")], "doc_id long, text string")
    got = {r.doc_id: [tuple(m) for m in r.matches] for r in decontaminate.find_benchmark(df, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()}
    assert got == {1: [(1, 12, "5", 0)], 2: [(0, 10, "5", 1)]}


def test_suffix_array_order():
    rng = np.random.default_rng(2)
    code = np.append(rng.integers(0, 3, 300), [-1] * 9)
    for depth in (1, 2, 5, 8):
        starts = np.arange(300)
        sa = decontaminate.suffix_array(code, starts, depth)
        keys = [tuple(code[i : i + depth]) for i in sa]
        assert keys == sorted(keys) and sorted(sa) == list(range(300))


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    row = decontaminate.find_benchmark(docs, items).first()
    assert (row.n_words, row.n_hit, row["items"], row.matches) == (2, 0, [], [])
    assert decontaminate.find_benchmark(docs.where("false"), items).count() == 0


def test_many_copies_of_a_short_item_against_many_places(spark):
    """20,000 ids of one word and 20,000 places of it: places are matches once, ids are attached once."""
    items = spark.range(20_000).selectExpr("id as item_id", "if(id % 2 = 0, 'Word', ' word!') as text")
    df = spark.createDataFrame([(1, "word " * 20_000), (2, "another")], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find_benchmark(df, items).collect()}
    assert (got[1].n_words, got[1].n_hit, len(got[1]["items"]), len(got[1].matches)) == (20_000, 20_000, 20_000, 20_000)
    assert {m.item for m in got[1].matches} == {"0"} and got[2]["items"] == []


def test_words_that_share_a_hash_do_not_match(monkeypatch):
    import pyarrow as pa

    real = decontaminate.runs_hash
    items = decontaminate.Items([(1, "aa bb cc")], 3)
    # a block whose words all hash like the items' words
    monkeypatch.setattr(decontaminate, "runs_hash", lambda data, start, end: real(data, start, end) if len(start) != 6 else real(items.block.data, items.words.start, items.words.end)[[0, 1, 2, 0, 1, 2]])
    found = decontaminate._find(items, pa.array(["aa bx cc aa bb cc"])).to_pylist()[0]
    assert (found["n_words"], found["n_hit"], found["items"]) == (6, 3, ["1"])
    assert [(m["word"], m["words"]) for m in found["matches"]] == [(3, 3)]
