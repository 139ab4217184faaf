"""Benchmark decontamination: test suffixes searched in suffix arrays of the training texts.

Each block of training texts (a shard) gets a suffix array over its words. Words
that no test item has end every match, so suffixes that cannot reach the shortest
window are left out, and suffixes need no order beyond the longest item. Every
distinct test suffix is binary-searched in every shard, all suffixes at once,
narrowing its range word by word; a range that survives a whole window lists all
places of that window. Places on one diagonal join to the longest verbatim match. The
bytes of all words inside matches are then compared, so hashes decide nothing.

Items of the same words are searched as one; their ids are attached to the documents at
the end.

Shards are found inside tasks: no shuffle, and rows keep all their columns. Test
items are read in blocks of at most ``ITEM_BYTES``; only one block is broadcast.

Defined results: null or empty texts have no words and are never hit; null and
wordless items have no window; an item of fewer words than a window is one
window; repeated items each count by their id, and ``matches`` names the smallest of
them; null ids of items are left out of ``items`` lists but their windows still hit; a
very long text is a shard of its own; columns named like results give way to them.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.blocks import ALPHANUMERIC, Block, Words, blocks, bounded_batches, lists, ranges, runs_hash, words

WINDOW = 10
ITEM_BYTES = 16 << 20
SHARD_BYTES = 4 << 20
FOUND = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("items", pa.list_(pa.string())),
        ("matches", pa.list_(pa.struct([("word", pa.int32()), ("words", pa.int32()), ("item", pa.string()), ("item_word", pa.int32())]))),
    ]
)
FOUND_SQL = "struct<n_words:bigint,n_hit:bigint,items:array<string>,matches:array<struct<word:int,words:int,item:string,item_word:int>>>"


class Items:
    """Words of one block of test items, each word sequence once, and their windows as rows of word numbers."""

    def __init__(self, rows: list[tuple], window: int):
        alike: dict[bytes, list[str | None]] = {}
        for block in blocks(pa.array([text for _, text in rows], pa.string())):
            w = words(block, ALPHANUMERIC)
            for r in range(block.rows):
                own = joined(block, w, w.bounds[r], w.bounds[r + 1] - w.bounds[r])
                alike.setdefault(own, []).append(rows[block.first + r][0])
        # ids of item k: ids[id_bounds[k]:id_bounds[k + 1]]
        groups = [sorted({str(i) for i in ids if i is not None}) for ids in alike.values()]
        self.ids = pa.array([i for g in groups for i in g], pa.string())
        self.id_bounds = np.concatenate(([0], np.cumsum([len(g) for g in groups]))).astype(np.int64)
        self.names = pa.array([g[0] if g else None for g in groups], pa.string())
        self.block = next(blocks(pa.array([*(own.decode() for own in alike), ""], pa.string()), most=1 << 62))
        self.words = words(self.block, ALPHANUMERIC)
        size = np.diff(self.words.bounds)
        hashes = runs_hash(self.block.data, self.words.start, self.words.end)
        self.vocabulary, self.example, self.code = np.unique(hashes, return_index=True, return_inverse=True)
        self.code = self.code.astype(np.int64)
        if len(differing(self.block, self.words, np.arange(len(self.code)), self, self.code)):
            raise ValueError("two words of the items have one hash")
        self.item = self.words.rows()
        left = np.repeat(self.words.bounds[1:], size) - np.arange(len(self.code))
        self.need = np.minimum(window, size)[self.item]  # words of the window that starts here
        self.at = np.flatnonzero(left >= self.need)  # test suffixes that hold a window
        self.shortest = int(self.need.min()) if len(self.need) else 0
        self.depth = int(self.need.max()) if len(self.need) else 0
        self.padded = np.concatenate((self.code, np.full(self.depth, -1)))
        # equal windows are searched once
        rows = np.where(np.arange(self.depth) < self.need[self.at, None], self.padded[self.at[:, None] + np.arange(self.depth)], -1)
        self.rows, member = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.zeros(0, np.int64))
        self.length = (self.rows >= 0).sum(axis=1)
        order = np.argsort(member.ravel(), kind="stable")
        self.members = self.at[order]  # suffixes of window k: members[first[k]:first[k + 1]]
        self.first = np.searchsorted(member.ravel()[order], np.arange(len(self.rows) + 1))


def suffix_array(code: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` ordered by the ``depth`` words from there; code -1 ends a suffix."""
    rank = code + 1  # 0: nothing follows
    have = 1
    n = len(code)
    live = np.flatnonzero(rank > 0)
    while have < depth:
        after = np.zeros(n, np.int64)
        after[: n - have] = rank[have:]
        key = (rank[live] << np.int64(32)) | after[live]
        distinct, place = np.unique(key, return_inverse=True)
        new = np.zeros(n, np.int64)
        new[live] = place + 1
        rank, have = new, have * 2
        if len(distinct) == len(live):
            break
    return starts[np.argsort(rank[starts], kind="stable")]


def bisect(sa: np.ndarray, code: np.ndarray, level: int, value: np.ndarray, low: np.ndarray, high: np.ndarray, right: bool) -> np.ndarray:
    """For each value, the first place in its range whose word at ``level`` is not below (right: is above) it."""
    low, high = low.copy(), high.copy()
    while len(go := np.flatnonzero(low < high)):
        mid = (low[go] + high[go]) >> 1
        seen = code[sa[mid] + level]
        less = seen <= value[go] if right else seen < value[go]
        low[go] = np.where(less, mid + 1, low[go])
        high[go] = np.where(less, high[go], mid)
    return low


def search(sa: np.ndarray, code: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Range of each window in the suffix array: one more word of every window in each turn."""
    n = len(items.rows)
    low, high = np.zeros(n, np.int64), np.full(n, len(sa), np.int64)
    for level in range(items.depth):
        live = np.flatnonzero((items.length > level) & (low < high))
        if not len(live):
            break
        value = items.rows[live, level]
        left = bisect(sa, code, level, value, low[live], high[live], right=False)
        high[live] = bisect(sa, code, level, value, left, high[live], right=True)
        low[live] = left
    return low, high


def joined(block: Block, w: Words, first: int, count: int) -> bytes:
    return b" ".join(block.data[a:b].tobytes() for a, b in zip(w.start[first : first + count], w.end[first : first + count], strict=True))


def differing(block: Block, w: Words, at: np.ndarray, items: Items, code: np.ndarray) -> np.ndarray:
    """Those of the words ``at`` whose bytes are not those of the item word ``code`` stands for."""
    example = items.example[code]
    size = w.end[at] - w.start[at]
    wrong = size != items.words.end[example] - items.words.start[example]
    at_same, example, size = at[~wrong], example[~wrong], size[~wrong]
    unequal = block.data[ranges(w.start[at_same], size)] != items.block.data[ranges(items.words.start[example], size)]
    begins = np.cumsum(size) - size  # a word has a byte at least
    bad = np.add.reduceat(unequal, begins) > 0 if len(begins) else np.zeros(0, bool)
    return np.concatenate((at[wrong], at_same[bad]))


def matched(block: Block, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Words]:
    """(row, word, words, item word) of the longest verbatim matches in a shard, and its words."""
    w = words(block, ALPHANUMERIC)
    none = np.zeros(0, np.int64)
    if not len(w.start) or not len(items.rows):
        return none, none, none, none, w
    h = runs_hash(block.data, w.start, w.end)
    at = np.searchsorted(items.vocabulary, h)
    at[at == len(items.vocabulary)] = 0
    own = np.where(items.vocabulary[at] == h, at, -1)
    while True:
        row, place, length, test = located(own, w, items)
        # a match stands on its bytes; a word that only shares a hash is none of the items' words
        change = np.zeros(len(own) + 1, np.int64)
        np.add.at(change, place, 1)
        np.add.at(change, place + length, -1)
        inside = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        bad = differing(block, w, inside, items, own[inside])
        if not len(bad):
            return row, place, length, test, w
        own[bad] = -1


def located(own: np.ndarray, w: Words, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, words, item word) of the longest matches between word numbers; -1 is no word of the items."""
    none = np.zeros(0, np.int64)
    # a separator after every text keeps suffixes inside it
    code = np.full(len(own) + len(w.bounds) - 1 + items.depth, -1, np.int64)
    place = np.arange(len(own)) + w.rows()
    code[place] = own
    word_at = np.full(len(code), -1, np.int64)
    word_at[place] = np.arange(len(own))
    stops = np.flatnonzero(code < 0)
    starts = np.flatnonzero(code >= 0)
    starts = starts[stops[np.searchsorted(stops, starts)] - starts >= items.shortest]
    if not len(starts):
        return none, none, none, none
    sa = suffix_array(code, starts, items.depth)
    low, high = search(sa, code, items)
    window = np.flatnonzero(high > low)
    if not len(window):
        return none, none, none, none
    count = high[window] - low[window]
    place = word_at[sa[ranges(low[window], count)]]
    window = np.repeat(window, count)
    # every test suffix that has this window
    copies = items.first[window + 1] - items.first[window]
    test = items.members[ranges(items.first[window], copies)]
    place, size = np.repeat(place, copies), np.repeat(items.length[window], copies)
    # windows that follow each other in both texts are one match
    row = np.searchsorted(w.bounds, place, side="right") - 1
    item = items.item[test]
    order = np.lexsort((place, place - test, item, row))
    row, item, place, test, size = row[order], item[order], place[order], test[order], size[order]
    new = np.ones(len(order), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (place[1:] - test[1:] != place[:-1] - test[:-1]) | (place[1:] != place[:-1] + 1)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(order)) - 1
    return row[head], place[head], place[last] + size[last] - place[head], test[head]


def _find(items: Items, texts: pa.Array) -> pa.Array:
    n_words, n_hit, counts, held = [], [], [], []
    parts: list[list[np.ndarray]] = [[], [], [], [], []]
    for block in blocks(texts, most=SHARD_BYTES):
        row, place, length, test, w = matched(block, items)
        change = np.zeros(len(w.start) + 1, np.int64)
        np.add.at(change, place, 1)
        np.add.at(change, place + length, -1)
        hit = np.concatenate(([0], np.cumsum(np.cumsum(change[:-1]) > 0)))
        n_words.append(np.diff(w.bounds))
        n_hit.append(hit[w.bounds[1:]] - hit[w.bounds[:-1]])
        counts.append(np.bincount(row, minlength=block.rows))
        item = items.item[test]
        # each item of a row once, then all of its ids
        once = np.unique(row * len(items.names) + item)
        of_row, of_item = np.divmod(once, len(items.names)) if len(once) else (once, once)
        ids = items.id_bounds[of_item + 1] - items.id_bounds[of_item]
        held.append(np.bincount(of_row, ids, block.rows).astype(np.int64))
        own = (place - w.bounds[row], length, item, test - items.words.bounds[item], ranges(items.id_bounds[of_item], ids))
        for part, values in zip(parts, own, strict=True):
            part.append(values)
    flat = [np.concatenate(p).astype(np.int32) if p else np.zeros(0, np.int32) for p in parts]
    inner = FOUND.field("matches").type
    columns = [pa.array(x) for x in flat]
    columns[2] = items.names.take(columns[2])
    values = pa.StructArray.from_arrays(columns[:4], fields=list(inner.value_type))
    numbers = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (n_words, n_hit, counts, held)]
    listed = lists(items.ids.take(columns[4]), numbers[3]).cast(FOUND.field("items").type)
    return pa.StructArray.from_arrays(
        [pa.array(numbers[0]), pa.array(numbers[1]), listed, lists(values, numbers[2]).cast(inner)], fields=list(FOUND)
    )


def _finder(shared: Broadcast) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _find(shared.value, texts)

    return find


def item_blocks(benchmark: DataFrame, item_id: str, text: str, most: int) -> Iterator[list[tuple]]:
    """Items in blocks of bounded size; one block at a time is on the driver."""
    items = benchmark.select(F.col(item_id).alias("id"), F.col(text).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = max(1, -(-2 * size // most))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        rows = [(r.id, r.text) for r in part.collect()]
        if rows or n == 1:
            yield rows


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """Add ``n_words``, ``n_hit``, ``items`` (sorted ids as strings) and ``matches``.

    A match is the longest run of words that a text shares with an item: ``word``
    and ``words`` say where it is in the text, ``item`` and ``item_word`` where in
    the item. With several blocks of items, spans of all blocks are united.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    added = ("n_words", "n_hit", "items", "matches")
    out = docs.withColumn("__text", F.col(text).cast("string"))
    names: list[str] = []
    for rows in item_blocks(benchmark, item_id, item_text, item_bytes):
        shared = spark.sparkContext.broadcast(Items(rows, window))
        name = f"__found{len(names)}"
        names.append(name)
        out = out.withColumn(name, F.arrow_udf(_finder(shared), FOUND_SQL)("__text"))
    matches = F.flatten(F.array(*(F.col(f"{n}.matches") for n in names)))
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m.word, (m.word + m.words).alias("end"))))
    union = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end")),
        lambda s, m: F.struct(
            (s.n + F.greatest(F.lit(0), m.end - F.greatest(s.end, m.word))).alias("n"), F.greatest(s.end, m.end).alias("end")
        ),
        lambda s: s.n,
    )
    hit = F.col(f"{names[0]}.n_hit") if len(names) == 1 else union
    items = F.array_sort(F.array_distinct(F.flatten(F.array(*(F.col(f"{n}.items") for n in names)))))
    return out.select(
        *(F.col(c) for c in docs.columns if c not in added),
        F.col(f"{names[0]}.n_words").alias("n_words"),
        hit.alias("n_hit"),
        items.alias("items"),
        matches.alias("matches"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents that share no window with the benchmark, with the columns they had."""
    kept = docs.select(F.struct(*docs.columns).alias("__row"), F.col(options.pop("text", "text")).alias("text"))
    return find_benchmark(kept, benchmark, **options).where(F.col("n_hit") == 0).select("__row.*")
