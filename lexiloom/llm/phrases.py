"""Phrases of 2 to 5 words that stand together more often than their parts would.

Texts (A-Z in lower case) fall into pieces at ``.,;:!?`` and line ends, pieces into words at spaces and
tabs. Per language: n is the number of words, f(phrase) the number of its contiguous occurrences within
pieces. A candidate has ``f >= min_count``. Cutting it into a first and a remaining part of frequency l
and r gives ``floor(1000 * a * n / (l * r))``; its score is the lowest of its cuts. A candidate inside a
longer one that is as frequent (``percent`` of it) is dropped.

How: words are counted first, then pairs of words, then longer phrases. A phrase with a word or a pair
below ``min_count`` cannot be a candidate, so such words, and then such pairs, end a window like a piece
end does; tasks know the frequent ones by bitmaps of fixed size, whose false hits cost work and change
nothing. From each position a task takes the window of up to five words and counts it in a HAT-trie over
word ids: the first id leads to a hash container of suffixes, and a container that outgrows ``BURST``
becomes a node with a container for each second id. When a task holds ``ENTRIES`` suffixes, whole
subtrees, largest first, leave as sorted runs, packed with their words. Runs go to the partition of their
prefix (both words of a pair, the first three of a window) and are merged there; the sums of a prefix over
its sorted windows are the frequencies of the shorter phrases. Only phrases at ``min_count`` leave the
merge; everything after is joins on (language, phrase), in decimals where products pass 64 bits.

Skew: a passage in a third of all rows is one entry of each run. A language is split over all prefix
partitions, joins carry the phrase, its word total is repeated over ``SALTS``, and the first ``most`` of
a language are found per salt first.

Defined results: null, empty and blank texts have no words; a null language is ``und``; repeated rows
count as often as they stand; of equal scores the more frequent and then the smaller phrase (UTF-8
bytes) comes first; an empty table gives no rows; other columns are not read.
"""

from collections import Counter
from collections.abc import Iterator
from itertools import pairwise
from struct import pack, unpack_from

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.blocks import BASE, Block, blocks, bounded_batches, byte_set, mix, runs_hash, words
from lexiloom.session import materialise

LONGEST = 5
MIN_COUNT, PERCENT, MOST = 100, 100, 2000
UNKNOWN = "und"
BLOCK = 4 << 20
#: entries of a container before it bursts, of a task before subtrees are spilled, of one insertion
BURST, ENTRIES, CHUNK = 1 << 13, 1 << 20, 1 << 19
IDS = 1 << 16
#: positions for each prefix partition, and windows a merge holds before it adds them up
POSITIONS, PENDING = 3_000_000, 1_000_000
#: flags for words and for pairs
BITS, PAIR_BITS = 1 << 24, 1 << 26
BITMAP = 32768
SALTS = 64

PIECE_END = byte_set(*((ord(c), ord(c)) for c in ".,;:!?"), (0x0A, 0x0D))
IN_WORD = ~(PIECE_END | byte_set((0x20, 0x20), (0x09, 0x09)))


class BlockWords:
    """Words of a block: an entry of ``values`` for each, and the number of its piece."""

    def __init__(self, block: Block):
        w = words(block, IN_WORD)
        flat = block.data[IN_WORD[block.data]]
        offsets = np.concatenate(([0], np.cumsum(w.end - w.start)))
        buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat)]
        encoded = pa.Array.from_buffers(pa.large_binary(), len(w.start), buffers).dictionary_encode()
        self.values = encoded.dictionary
        self.codes = encoded.indices.to_numpy(zero_copy_only=False)
        self.pieces = np.cumsum(PIECE_END[block.data])[w.start] + w.rows() if len(w.start) else np.zeros(0, np.int64)


def value_hashes(values: pa.Array, lang: str) -> np.ndarray:
    """One 64-bit number for each word of a language."""
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(values) + 1, values.offset * 8) if len(values) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    own = np.frombuffer(lang.encode(), np.uint8)
    key = runs_hash(own, np.array([0]), np.array([len(own)]))
    return mix(runs_hash(data, offsets[:-1], offsets[1:]) ^ mix(key))


def by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, Block]]:
    """Blocks of the texts of one language after another; columns are language and text."""
    langs = batch.column(0).dictionary_encode()
    for code, lang in enumerate(langs.dictionary.to_pylist()):
        for block in blocks(batch.column(1).filter(pa.array(langs.indices.to_numpy(zero_copy_only=False) == code)), most=BLOCK):
            yield lang, block


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, block in by_language(batch):
            w = BlockWords(block)
            counts = np.bincount(w.codes, minlength=len(w.values))
            langs = pa.array([lang]).take(pa.array(np.zeros(len(counts), np.int32)))
            yield pa.RecordBatch.from_arrays([langs, w.values.cast(pa.large_string()).cast(pa.string()), pa.array(counts)], names=["lang", "word", "f"])


def word_counts(texts: DataFrame) -> DataFrame:
    """``lang, word, f`` of a table with the columns ``lang, text``."""
    rows = texts.mapInArrow(_word_rows, "lang string, word string, f bigint")
    return rows.groupBy("lang", "word").agg(F.sum("f").alias("f"))


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(BASE) + second)


def _bit_column(size: int):
    """Flag number of one word, or of a pair of words, of a language."""

    def bits(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for langs, *texts in batches:
            out = np.zeros(len(langs), np.int64)
            encoded = langs.dictionary_encode()
            codes = encoded.indices.to_numpy(zero_copy_only=False)
            for code, lang in enumerate(encoded.dictionary.to_pylist()):
                mask = pa.array(codes == code)
                h = [value_hashes(t.filter(mask).cast(pa.large_string()).cast(pa.large_binary()), lang) for t in texts]
                out[codes == code] = ((h[0] if len(h) == 1 else pair_hashes(*h)) % np.uint64(size)).astype(np.int64)
            yield pa.array(out)

    return F.arrow_udf(bits, "bigint")


def frequent_bitmap(counts: DataFrame, columns: list[str], size: int) -> np.ndarray:
    """One of ``size`` flags is set for each row: a few MB, however many rows there are."""
    bits = counts.select((_bit_column(size)("lang", *columns) + 1).alias("bit"))
    parts = bits.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for row in parts.collect():
        at = (row.bucket - 1) * (BITMAP // 8)
        out[at : at + BITMAP // 8] = np.frombuffer(row.bits, np.uint8)
    return out


def flagged(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes % np.uint64(8 * len(bitmap))
    return (bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0


class HatTrie:
    """Counts of windows of one language: a first id, and the ids after it as one 64-bit suffix.

    ``root`` maps a first id to a container (suffix -> count) or, once burst, to a dict of
    containers by second id. Id 0 stands for no word.
    """

    def __init__(self, lang: str, bursts: bool = True):
        self.lang, self.bursts = lang, bursts
        self.clear()

    def clear(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.words: list[bytes] = [b""]
        self.root: dict[int, Counter | dict[int, Counter]] = {}
        self.size = 0

    def numbered(self, values: list[bytes]) -> np.ndarray:
        ids, known = self.ids, self.words
        out = np.empty(len(values), np.uint16)
        for i, value in enumerate(values):
            at = ids.get(value)
            if at is None:
                at = ids[value] = len(known)
                known.append(value)
            out[i] = at
        return out

    def add(self, first: np.ndarray, suffix: np.ndarray) -> None:
        order = np.lexsort((suffix >> np.uint64(48), first)) if self.root else np.argsort(first, kind="stable")
        first, suffix = first[order], suffix[order]
        keys = suffix.tolist()
        edges = [*np.flatnonzero(np.diff(first, prepend=first[:1] ^ 1)).tolist(), len(first)]
        for a, b in pairwise(edges):
            word = int(first[a])
            child = self.root.get(word)
            if child is None:
                child = self.root[word] = Counter()
            if isinstance(child, Counter):
                before = len(child)
                child.update(keys[a:b])
                self.size += len(child) - before
                if self.bursts and len(child) > BURST:
                    self.root[word] = self._burst(child)
            else:
                second = suffix[a:b] >> np.uint64(48)
                inner = [*np.flatnonzero(np.diff(second, prepend=second[:1] ^ np.uint64(1))).tolist(), b - a]
                for i, j in pairwise(inner):
                    leaf = child.setdefault(int(second[i]), Counter())
                    before = len(leaf)
                    leaf.update(keys[a + i : a + j])
                    self.size += len(leaf) - before

    @staticmethod
    def _burst(container: Counter) -> dict[int, Counter]:
        node: dict[int, Counter] = {}
        for suffix, count in container.items():
            second = suffix >> 48
            leaf = node.get(second)
            if leaf is None:
                leaf = node[second] = Counter()
            leaf[suffix] = count
        return node

    def spill(self, down_to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Take out whole subtrees, largest first, until ``down_to`` entries are left."""
        held = {w: [c] if isinstance(c, Counter) else list(c.values()) for w, c in self.root.items()}
        sizes = {w: sum(map(len, cs)) for w, cs in held.items()}
        firsts, keys, counts = [], [], []
        for word in sorted(sizes, key=sizes.__getitem__, reverse=True):
            if self.size <= down_to:
                break
            for c in held[word]:
                keys.append(np.fromiter(c.keys(), np.uint64, len(c)))
                counts.append(np.fromiter(c.values(), np.int64, len(c)))
            firsts.append(np.full(sizes[word], word, np.uint16))
            self.size -= sizes[word]
            del self.root[word]
        empty = np.zeros(0, np.uint64)
        return np.concatenate(firsts or [empty.astype(np.uint16)]), np.concatenate(keys or [empty]), np.concatenate(counts or [empty.astype(np.int64)])


def pack_run(values: list[bytes], columns: np.ndarray, counts: np.ndarray) -> bytes:
    """A run: its words, then each column of ids (0: no word, i: ``values[i - 1]``), then the counts."""
    text = b" ".join(values)  # words hold no space
    wide = counts.astype(np.uint8 if counts.max() < 256 else np.uint64)
    raw = text + np.ascontiguousarray(columns.T).astype(np.uint16).tobytes() + wide.tobytes()
    head = pack("<5I", len(text), columns.shape[0], columns.shape[1], wide.itemsize, len(raw))
    return head + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpack_run(run: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    size, rows, width, item, length = unpack_from("<5I", run)
    raw = pa.Codec("zstd").decompress(run[20:], decompressed_size=length, asbytes=True)
    ids = np.frombuffer(raw, np.uint16, rows * width, size).reshape(width, rows).T
    counts = np.frombuffer(raw, np.uint8 if item == 1 else np.uint64, rows, size + 2 * rows * width)
    return raw[:size].split(b" "), ids, counts.astype(np.int64)


RUNS = "part int, lang string, run binary"


def _keys(columns: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """The columns side by side in as few 64-bit numbers as hold them, in the same order."""
    each = 63 // bits
    out = []
    for low in range(0, len(columns), each):
        key = np.zeros(len(columns[low]), np.int64)
        for c in columns[low : low + each]:
            key = (key << bits) | c
        out.append(key)
    return out


def _sorted_sums(keys: list[np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of one row for each distinct key, in order, and the sums of the counts."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return order[at], np.add.reduceat(counts[order], at) if len(at) else counts


def trie_runs(trie: HatTrie, parts: int, down_to: int, pairs: bool) -> Iterator[pa.RecordBatch]:
    """Spilled subtrees as sorted runs, one for each prefix partition: of pairs, or of whole windows."""
    first, suffix, counts = trie.spill(down_to)
    if not len(first):
        return
    rank_to_id = sorted(range(len(trie.words)), key=trie.words.__getitem__)  # the empty word stays first
    rank = np.empty(len(rank_to_id), np.uint16)
    rank[rank_to_id] = np.arange(len(rank_to_id))
    values = [trie.words[i] for i in rank_to_id]
    flat = pa.array(values, pa.large_binary())
    hashes = value_hashes(flat, "")
    shifts, depth = ((48,), 2) if pairs else ((48, 32, 16, 0), 3)
    columns = [rank[first], *(rank[((suffix >> np.uint64(k)) & np.uint64(0xFFFF)).astype(np.int64)] for k in shifts)]
    key = np.zeros(len(counts), np.uint64)
    for c in columns[:depth]:
        key = mix(key * np.uint64(BASE) + hashes[c])
    part = (key % np.uint64(parts)).astype(np.int64)
    at, counts = _sorted_sums([part, *_keys(columns, 16)], counts)
    edges = np.searchsorted(part[at], np.arange(parts + 1))
    table = np.column_stack(columns)[at]
    out: dict[str, list] = {"part": [], "run": []}
    for p in np.flatnonzero(np.diff(edges)):
        rows = table[edges[p] : edges[p + 1]]
        used = np.flatnonzero(np.bincount(rows.ravel(), minlength=1))
        used = used[used > 0]
        local = np.zeros(len(values), np.uint16)
        local[used] = np.arange(1, len(used) + 1)
        out["part"].append(int(p))
        out["run"].append(pack_run([values[i] for i in used], local[rows], counts[edges[p] : edges[p + 1]]))
    yield pa.RecordBatch.from_arrays(
        [pa.array(out["part"], pa.int32()), pa.array([trie.lang] * len(out["part"]), pa.string()), pa.array(out["run"], pa.binary())],
        names=["part", "lang", "run"],
    )


def windows(ids: np.ndarray, segments: np.ndarray, shortest: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, first ids and suffixes of the windows of ``shortest`` to ``longest`` words, the longest at each word."""
    n = len(ids)
    suffix = np.zeros(n, np.uint64)
    size = np.ones(n, np.int64)
    for k in range(1, min(longest, n)):
        same = segments[k:] == segments[: n - k]
        suffix[: n - k][same] |= ids[k:][same].astype(np.uint64) << np.uint64(16 * (LONGEST - 1 - k))
        size[: n - k][same] = k + 1
    full = np.flatnonzero(size >= shortest)
    return full, ids[full], suffix[full]


def run_maker(bitmap: np.ndarray, parts: int, pair_bitmap: np.ndarray | None = None):
    """The task that turns texts into runs: of pairs, or, where the frequent pairs are known, of windows of three words and more."""
    pairs = pair_bitmap is None
    shortest, longest = (2, 2) if pairs else (3, LONGEST)

    def insert(trie: HatTrie, w: BlockWords) -> Iterator[pa.RecordBatch]:
        hashes = value_hashes(w.values, trie.lang)
        keep = flagged(bitmap, hashes)[w.codes]
        at = np.flatnonzero(keep)
        segments = (w.pieces + np.cumsum(~keep))[at]
        codes = w.codes[at]
        if not pairs and len(at):
            h = hashes[codes]
            segments = segments + np.concatenate(([0], np.cumsum(~flagged(pair_bitmap, pair_hashes(h[:-1], h[1:])))))
            # words that no window holds need no id
            near = np.zeros(len(at), bool)
            start = windows(np.zeros(len(at), np.uint16), segments, shortest, shortest)[0]
            for k in range(shortest):
                near[start + k] = True
            segments, codes = segments[near], codes[near]
        low = 0
        while low < len(codes):
            high = min(low + CHUNK, len(codes))
            while True:  # a chunk's words must fit the ids of a trie
                reach = min(high + longest - 1, len(codes))
                used = np.unique(codes[low:reach])
                if len(used) < IDS or high - low <= 1:
                    break
                high = low + (high - low) // 2
            if len(trie.words) + len(used) > IDS:
                yield from trie_runs(trie, parts, 0, pairs)
                trie.clear()
            number = np.zeros(len(w.values), np.uint16)
            number[used] = trie.numbered(w.values.take(pa.array(used)).to_pylist())
            place, first, suffix = windows(number[codes[low:reach]], segments[low:reach], shortest, longest)
            own = place < high - low
            trie.add(first[own], suffix[own])
            low = high

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, HatTrie] = {}
        for batch in batches:
            for lang, block in by_language(batch):
                trie = tries.get(lang)
                if trie is None:
                    trie = tries[lang] = HatTrie(lang, bursts=not pairs)
                yield from insert(trie, BlockWords(block))
                if sum(t.size for t in tries.values()) > ENTRIES:
                    largest = max(tries.values(), key=lambda t: t.size)
                    yield from trie_runs(largest, parts, largest.size // 4, pairs)
        for trie in tries.values():
            yield from trie_runs(trie, parts, 0, pairs)

    return make


class Merge:
    """Sums of the runs of one language and width that belong to one prefix partition."""

    def __init__(self, width: int):
        self.ids: dict[bytes, int] = {}
        self.width = width
        self.columns = [np.zeros(0, np.int64) for _ in range(width)]
        self.counts = np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, values: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        mapping = np.zeros(len(values) + 1, np.int32)
        own = self.ids
        for i, value in enumerate(values):
            mapping[i + 1] = own.setdefault(value, len(own) + 1)
        self.waiting.append((mapping[ids], counts))
        self.rows += len(ids)
        if self.rows > PENDING:
            self.settle()

    def settle(self) -> None:
        ids = np.concatenate([np.column_stack(self.columns), *(i for i, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        self.waiting, self.rows = [], 0
        keys = _keys(list(ids.T), max(len(self.ids).bit_length(), 1))
        at, self.counts = _sorted_sums(keys, counts)
        self.columns = [c.astype(np.int32) for c in ids[at].T]

    def frequent(self, min_count: int) -> Iterator[tuple[bytes, int]]:
        """Phrases at ``min_count``: of two words from pairs, of three and more from windows."""
        self.settle()
        values = [b"", *self.ids]
        new = np.zeros(len(self.counts), bool)
        new[:1] = True
        for k in range(self.width):
            new[1:] |= self.columns[k][1:] != self.columns[k][:-1]
            if k + 1 < min(self.width, 3):
                continue
            at = np.flatnonzero(new)
            sums = np.add.reduceat(self.counts, at) if len(at) else self.counts
            good = (sums >= min_count) & (self.columns[k][at] > 0)
            for i, f in zip(at[good].tolist(), sums[good].tolist(), strict=True):
                yield b" ".join(values[self.columns[j][i]] for j in range(k + 1)), f


def run_merger(min_count: int):
    """The task that merges the runs of its prefix partition."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges: dict[tuple[str, int], Merge] = {}
        for batch in batches:
            for lang, run in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                values, ids, counts = unpack_run(run.as_py())
                width = ids.shape[1]
                if (lang, width) not in merges:
                    merges[lang, width] = Merge(width)
                merges[lang, width].add(values, ids, counts)
        for lang, width in list(merges):
            found = list(merges.pop((lang, width)).frequent(min_count))
            phrases, counts = [p.decode() for p, _ in found], [f for _, f in found]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(phrases, pa.string()), pa.array(counts, pa.int64())], names=["lang", "phrase", "f"])

    return merge


def frequent_phrases(texts: DataFrame, counts: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """``lang, phrase, f`` of all phrases of 2 to 5 words at ``min_count``; ``counts`` are those of the words."""
    positions = counts.agg(F.sum("f")).first()[0] or 0
    parts = max(1, -(-positions // POSITIONS))

    def merged(make) -> DataFrame:
        runs = texts.mapInArrow(make, RUNS).repartitionById(parts, F.col("part"))
        return runs.mapInArrow(run_merger(min_count), "lang string, phrase string, f bigint")

    frequent = frequent_bitmap(counts.where(F.col("f") >= min_count), ["word"], BITS)
    pairs = materialise(merged(run_maker(frequent, parts)), "pairs")
    word = F.split("phrase", " ")
    flags = frequent_bitmap(pairs.select("lang", word[0].alias("first"), word[1].alias("second")), ["first", "second"], PAIR_BITS)
    return pairs.unionByName(merged(run_maker(frequent, parts, flags)))


def _part(first: Column, size: Column) -> Column:
    return F.array_join(F.slice("words", first, size), " ")


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    min_count: int = MIN_COUNT,
    percent: int = PERCENT,
    most: int = MOST,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the first ``most`` phrases of every language."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("string").alias("text"))
    counts = materialise(word_counts(texts), "words")
    found = materialise(frequent_phrases(texts, counts, min_count), "phrases")
    known = found.unionByName(counts.where(F.col("f") >= min_count).select("lang", F.col("word").alias("phrase"), "f"))

    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    totals = totals.select("lang", "n", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    candidates = found.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"), salt.alias("salt"))

    size = F.size("words")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: _part(i, m))))
    longer = candidates.where(size > 2).select("lang", F.explode(inner).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("inside"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").where(F.col("inside").isNull() | (100 * F.col("inside") < percent * F.col("a")))

    cuts = kept.join(totals, ["lang", "salt"]).select(
        "lang", "phrase", "a", "n", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")
    )
    cuts = cuts.select("lang", "phrase", "a", "n", "k", _part(F.lit(1), F.col("k")).alias("left"), _part(F.col("k") + 1, size - F.col("k")).alias("right"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    wide = "decimal(19,0)"
    score = F.expr(f"(cast(a * 1000 as {wide}) * cast(n as {wide})) div (cast(l as {wide}) * cast(r as {wide}))")
    scored = cuts.groupBy("lang", "phrase").agg(
        F.any_value("a").alias("a"), F.any_value("n").alias("n"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    )
    rows = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn("salt", salt)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")  # at most SALTS * most rows
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
