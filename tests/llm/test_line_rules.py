"""Quality rules against plain Python."""

import random
import re
from collections import Counter, defaultdict

from lexiloom.llm import line_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


def plain(rows, share, least, most, lost):
    holders, hosts = defaultdict(set), defaultdict(set)
    norm = lambda line: " ".join(WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in line)))
    for i, text, host in rows:
        hosts[host].add(i)
        for line in (text or "").split("\n"):
            if norm(line):
                holders[host, norm(line)].add(i)
    out = []
    for i, text, host in rows:
        counts = plain_counts(text)
        frequent = lambda line: len(h := holders[host, norm(line)]) >= least and (len(h) > len(hosts[host]) * share or len(h) > most)  # noqa: E731, B023
        parts = (text or "").split("\n")
        gone = sum(len(WORD.findall(x)) for x in parts if frequent(x))
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        kept = not failed and gone <= counts[0] * lost and counts[0] - gone >= 10
        out.append((i, *counts, failed, gone, kept, "\n".join(x for x in parts if not frequent(x))))
    return out


def test_against_plain_python(spark):
    random.seed(2)
    pool = [f"w{i}" for i in range(12)] + ["É", "#x", "a<b", "中文"]
    common = ["Licensed  under X", "all rights reserved here"]
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\n", None), (4, "x", None), (None, "x", None), (5, "a b\x0bc\x1cd\n\na b", "a")]
    for i in range(6, 90):
        lines = [" ".join(random.choices(pool, k=random.randint(0, 9))) for _ in range(random.randint(1, 12))]
        if i % 2:
            lines.insert(0, random.choice(common).upper() if i % 3 else common[0])
        rows.append((i, "\n".join(lines), random.choice(["a", "b", None])))
    rows += [rows[10], rows[11], (200, "licensed under x", "b"), (201, "same words again and again " * 30, "b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, host string, kept int").repartition(5)
    order = ["doc_id", *line_rules.COUNTS, "base_failed", "lost_words", "kept", "clean_text"]
    for most in (500, 4):
        got = line_rules.line_rules(df, max_share=0.1, min_docs=3, max_docs=most).drop("text", "host")
        assert sorted(map(tuple, got.select(*order).collect()), key=repr) == sorted(plain(rows, 0.1, 3, most, 0.5), key=repr)


def test_a_host_of_copies_loses_them(spark):
    """Copies are documents: what a host carries 40 times is boilerplate there, and nowhere else."""
    page = "\n".join(" ".join(f"line{i}x{k}" for k in range(10)) for i in range(4))
    own = [(f"single {i}", " ".join(f"word{i}x{k}" for k in range(30))) for i in range(60)]
    rows = [(i, page, "copies") for i in range(40)] + [(100 + i, text, "copies") for i, (_, text) in enumerate(own)] + [(900, page, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string").repartition(6)
    kept = {r.doc_id: (r.kept, r.lost_words) for r in line_rules.line_rules(df).collect()}
    assert all(kept[i] == (False, 40) for i in range(40))
    assert all(kept[100 + i] == (True, 0) for i in range(60)) and kept[900] == (True, 0)


def test_a_very_long_text_and_rows_of_one_id(spark):
    long_text = "\n".join(f"{i} is a line of a very long text" for i in range(60_000))
    rows = [(1, long_text, "h"), (2, "short line here", "h"), (2, "short line here", "h"), (2, "short line here\nand another text of the same id", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string")
    got = line_rules.line_rules(df, min_docs=2, max_share=0.5)
    assert sorted((r.doc_id, r.n_words, r.lost_words) for r in got.collect()) == [(1, 540_000, 0), (2, 3, 0), (2, 3, 0), (2, 10, 0)]


def test_blocks_do_not_matter():
    import pyarrow as pa

    from lexiloom.llm.blocks import blocks

    texts = ["a b\nc", None, "", "d\n\nd", "e" * 50 + "\n" + "f g h i j " * 9, "\n"]
    for most in (1, 7, 1000):
        done = [line_rules.block_counts(b) for b in blocks(pa.array(texts), lower=False, most=most)]
        got = [tuple(int(x) for part in column for x in part) for column in zip(*done, strict=True)]
        assert list(zip(*got, strict=True)) == [plain_counts(t) for t in texts]


def test_empty_table(spark):
    assert line_rules.line_rules(spark.createDataFrame([], "doc_id long, text string, host string")).collect() == []
