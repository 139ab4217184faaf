"""SimHash against a brute force over all pairs."""

import random
import re

import numpy as np
import xxhash

from lexiloom.llm import simhash
from lexiloom.llm.components import stars


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int, fp int")
    got = sorted(tuple(r) for r in simhash.near_duplicates(df.drop("fp")).collect())
    prints = [plain_fingerprint(r[1]) for r in rows]
    want = sorted(zip((r[0] for r in rows), (f"{p:016x}" for p in prints), plain_components([r[0] for r in rows], prints), strict=True))
    assert got == want


def test_edge_rows_and_copies(spark):
    base = " ".join(f"word{i}" for i in range(400))
    texts = [None, "", " \t\n", "one", "One  TWO", "a b c", "A b c", base, base.upper(), base + " tail", base.replace("word7 ", "x "), "é è\x1cê ç"]
    rows = [(i + 3, t, 1, 2) for i, t in enumerate(texts)] + [(7, base, 1, 2), (7, base, 1, 2), (99, "one", 1, 2)]
    check(spark, rows)


def test_random_texts(spark):
    random.seed(5)
    pool = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(150):
        if i % 3 and rows:
            words = random.choice(rows)[1].split(" ")
            words[random.randrange(len(words))] = random.choice(pool)
        else:
            words = random.choices(pool, k=random.randint(1, 200))
        rows.append((i, " ".join(words), 0, 0))
    check(spark, rows)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert simhash.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_bucket_is_dealt_in_blocks(spark):
    rng = np.random.default_rng(1)
    centre = int(rng.integers(1 << 62))
    values = {centre ^ int(sum(1 << int(b) for b in rng.choice(64, 2, replace=False))) for _ in range(900)} | {int(x) for x in rng.integers(1 << 62, size=300)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {r.a: r.b for r in stars(simhash.links(nodes, block=64)).collect()}
    unsigned = [v % (1 << 64) for v in signed]
    classes = plain_components(signed, unsigned)
    assert all(got.get(v, v) == c for v, c in zip(signed, classes, strict=True))


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 90), (7, 7)]
    got = dict(map(tuple, stars(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(1, 41)} | {100: 90, 101: 90}


def test_keep_one_keeps_columns_and_the_smallest_id(spark):
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(5, base, "x"), (3, base + " tail", "y"), (3, base + " tail", "z"), (9, "other text here now", "w"), (None, base, "n"), (None, None, "m")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, fp string"))
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
    assert kept == sorted([(3, base + " tail"), (9, "other text here now"), (None, None)], key=repr)
    assert got.columns == ["doc_id", "text", "fp"]
