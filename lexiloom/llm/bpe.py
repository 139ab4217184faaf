"""Byte-level BPE: texts to token ids and back, as the rank files of public tokenizers ask.

A text is cut into pieces by the pattern of the vocabulary (letters, digits or
other characters, each with one space before; white space; seven contractions).
A piece that is a token is that token; any other piece starts as single bytes, and
the leftmost adjacent pair of least rank is merged until no pair is a token.

A segment tree over the byte positions of a piece holds, at its root, the leftmost
pair of least rank. A merge changes three leaves (the merged pair and those of its
live neighbours), each a walk to the root. Pieces of one padded length are a
forest of trees that merge in step. Distinct pieces are merged once in a task.

Work is row-local: no shuffle, memory bounded by one block of texts, one long
piece at a time, and the pieces a task remembers (``REMEMBERED``).

Defined results: null and empty texts have no tokens and decode to no bytes;
special tokens are ordinary text; ids outside the vocabulary raise on decoding.
"""

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.blocks import Block, blocks, bounded_batches, lists, ranges, runs_hash

REMEMBERED = 1 << 19
FOREST_BYTES = 256  # longer pieces have a tree of their own
FOREST_CELLS = 1 << 18
NONE = np.int64((1 << 63) - 1)
LETTER, DIGIT, OTHER, SPACE = range(4)


def character_classes() -> np.ndarray:
    """Letter, digit, white space or other, for every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "!" for c in range(0x110000))
    for kind, pattern in ((LETTER, r"\p{L}"), (DIGIT, r"\p{N}"), (SPACE, r"\s")):
        table[[m.start() for m in regex.finditer(pattern, every)]] = kind
    return table


class Vocabulary:
    """Ranks of byte strings, and the pairs of tokens whose bytes are a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.classes = character_classes()
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.pairs, self.merged = keys[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order]
        self.singles = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        size = max(ranks.values()) + 1
        self.length = np.full(size, -1, np.int64)
        by_id = [b""] * size
        for token, rank in ranks.items():
            self.length[rank], by_id[rank] = len(token), token
        self.offset = np.cumsum(np.maximum(self.length, 0)) - np.maximum(self.length, 0)
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, or -1."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.merged[at], -1)


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the bytes and the rank on each line. It is read on the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the byte where each begins."""
    start = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[start].astype(np.int32)
    point = lead.copy()
    long = np.flatnonzero(lead >= 0xC0)
    if len(long):
        size = np.searchsorted([0xE0, 0xF0], lead[long], side="right") + 2
        value = lead[long] & np.array([0, 0, 0x1F, 0x0F, 0x07])[size]
        last = len(data) - 1
        for k in range(1, 4):
            more = size > k
            value[more] = (value[more] << 6) | (data[np.minimum(start[long[more]] + k, last)] & 0x3F)
        point[long] = np.minimum(value, 0x10FFFF)
    return point, start


def pieces(block: Block, classes: np.ndarray) -> np.ndarray:
    """Byte at which each piece begins."""
    point, start = code_points(block.data)
    n = len(point)
    if not n:
        return start
    kind = classes[point]
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(start, block.offsets)] = True
    run = first[:-1].copy()
    run[1:] |= kind[1:] != kind[:-1]
    begins = run.copy()
    # the last of several spaces goes with what follows, if that is in the same text
    tail = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:-1])
    begins[tail] = True
    begins[tail[point[tail] == 32] + 1] = False
    # contractions: a quote mark where a piece begins, then s, t, m, d, re, ve or ll
    quote = np.flatnonzero((point == 39) & begins)
    padded, ends = np.concatenate((point, [0, 0, 0])), np.concatenate((first, [True, True, True]))
    quote = quote[~ends[quote + 1]]
    one, two = padded[quote + 1], padded[quote + 2]
    short = np.isin(one, [ord(c) for c in "stmd"])
    double = ((one == ord("l")) & (two == ord("l")) | np.isin(one, [ord("r"), ord("v")]) & (two == ord("e"))) & ~ends[quote + 2]
    quote, after = quote[short | double], np.where(short, 2, 3)[short | double]
    begins[quote + 1] = False
    rest = quote + after
    begins[rest[~ends[rest]]] = True
    return start[begins]


def merge_forest(texts: np.ndarray, sizes: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Token ids of pieces of at most ``texts.shape[0]`` bytes, one piece in each column; -1 where no token begins.

    Node k of every tree is row k of ``tree``: leaves hold rank and position, so that the least is the leftmost.
    """
    width, n = texts.shape
    token = np.where(np.arange(width)[:, None] < sizes, vocabulary.singles[texts], -1)
    following = np.repeat(np.arange(1, width + 1)[:, None], n, axis=1)
    before = following - 2
    tree = np.full((2 * width, n), NONE)
    rank = np.where(token[1:] >= 0, vocabulary.pair_rank(token[:-1], token[1:]), -1)
    tree[width : 2 * width - 1] = np.where(rank >= 0, (rank << 32) | np.arange(width - 1)[:, None], NONE)
    for node in range(width - 1, 0, -1):
        np.minimum(tree[2 * node], tree[2 * node + 1], out=tree[node])

    def update(position: np.ndarray, column: np.ndarray, value: np.ndarray | np.int64) -> None:
        node = position + width
        tree[node, column] = value
        while node[0] > 1:
            node = node >> 1
            tree[node, column] = np.minimum(tree[2 * node, column], tree[2 * node + 1, column])

    def pair(at: np.ndarray, other: np.ndarray, column: np.ndarray) -> np.ndarray:
        rank = vocabulary.pair_rank(token[at, column], token[other, column])
        return np.where(rank >= 0, (rank << 32) | at, NONE)

    while len(column := np.flatnonzero(tree[1] != NONE)):
        least = tree[1, column]
        at, rank = least & 0xFFFFFFFF, least >> 32
        gone = following[at, column]
        after = following[gone, column]
        token[at, column], token[gone, column] = rank, -1
        following[at, column] = after
        update(gone, column, NONE)
        more = np.flatnonzero(after < sizes[column])
        value = np.full(len(column), NONE)
        before[after[more], column[more]] = at[more]
        value[more] = pair(at[more], after[more], column[more])
        update(at, column, value)
        left = np.flatnonzero(before[at, column] >= 0)
        if len(left):
            p, c = before[at[left], column[left]], column[left]
            update(p, c, pair(p, at[left], c))
    return token


def merge_one(text: bytes, vocabulary: Vocabulary) -> np.ndarray:
    """The same for one long piece: plain walks in a single tree."""
    n = len(text)
    width = 1 << (n - 1).bit_length()
    data = np.frombuffer(text, np.uint8)
    start = vocabulary.singles[data]
    rank = vocabulary.pair_rank(start[:-1], start[1:])
    leaves = np.full(width, NONE)
    leaves[: n - 1] = np.where(rank >= 0, (rank << 32) | np.arange(n - 1), NONE)
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
    trees = [level.tolist() for level in levels]
    token, following, before, none = start.tolist(), list(range(1, n + 1)), list(range(-1, n - 1)), int(NONE)
    size = [1] * n
    ranks = vocabulary.ranks

    def update(at: int, value: int) -> None:
        trees[0][at] = value
        for low, high in zip(trees, trees[1:], strict=False):
            at >>= 1
            value = min(low[2 * at], low[2 * at + 1])
            if high[at] == value:
                return
            high[at] = value

    def pair(a: int, b: int) -> int:
        rank = ranks.get(text[a : b + size[b]])
        return none if rank is None else rank << 32 | a

    while (least := trees[-1][0]) != none:
        at, rank = least & 0xFFFFFFFF, least >> 32
        gone = following[at]
        after = following[gone]
        token[at], token[gone] = rank, -1
        size[at] += size[gone]
        following[at] = after
        update(gone, none)
        if after < n:
            before[after] = at
        update(at, pair(at, after) if after < n else none)
        if before[at] >= 0:
            update(before[at], pair(before[at], at))
    return np.array([t for t in token if t >= 0], np.int64)


class Encoder:
    """Ids of pieces by hash; the pieces of a task are merged once."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.hashes, self.at, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def learn(self, hashes: np.ndarray, texts: list[bytes]) -> None:
        """``hashes`` ascend and are new."""
        found: list[np.ndarray | None] = [None] * len(texts)
        by_width: dict[int, list[int]] = {}
        for i, text in enumerate(texts):
            rank = self.vocabulary.ranks.get(text)
            if rank is not None:
                found[i] = np.array([rank])
            elif len(text) > FOREST_BYTES:
                found[i] = merge_one(text, self.vocabulary)
            else:
                by_width.setdefault(1 << (len(text) - 1).bit_length(), []).append(i)
        for width, members in by_width.items():
            step = FOREST_CELLS // width
            for k in range(0, len(members), step):
                part = members[k : k + step]
                sizes = np.array([len(texts[i]) for i in part])
                padded = np.frombuffer(b"".join(texts[i].ljust(width, b"\0") for i in part), np.uint8).reshape(-1, width)
                token = merge_forest(np.ascontiguousarray(padded.T), sizes, self.vocabulary).T
                live = token >= 0
                for i, ids in zip(part, np.split(token[live], np.cumsum(live.sum(axis=1))[:-1]), strict=True):
                    found[i] = ids
        count = np.array([len(ids) for ids in found], np.int64)
        at = len(self.ids) + np.cumsum(count) - count
        if len(self.hashes) + len(hashes) > REMEMBERED:
            self.forget()
            at = np.cumsum(count) - count
        self.ids = np.concatenate((self.ids, *found)).astype(np.int32)
        place = np.searchsorted(self.hashes, hashes)
        self.hashes, self.at, self.count = (
            np.insert(old, place, new) for old, new in ((self.hashes, hashes), (self.at, at), (self.count, count))
        )

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block one after another, and their number in each text."""
        start = pieces(block, self.vocabulary.classes)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(block.rows, np.int64)
        end = np.append(start[1:], len(block.data))
        distinct, sample, member = np.unique(runs_hash(block.data, start, end), return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, distinct)
        new = np.ones(len(distinct), bool)
        inside = place < len(self.hashes)
        new[inside] = self.hashes[place[inside]] != distinct[inside]
        if len(self.hashes) + new.sum() > REMEMBERED:
            self.forget()
            new[:] = True
        if new.any():
            own = sample[new]
            self.learn(distinct[new], [block.data[a:b].tobytes() for a, b in zip(start[own], end[own], strict=True)])
        place = np.searchsorted(self.hashes, distinct)
        count = self.count[place][member]
        held = np.concatenate(([0], np.cumsum(count)))
        bounds = held[np.searchsorted(start, block.offsets)]
        return self.ids[ranges(self.at[place][member], count)], np.diff(bounds)


def _encode(shared: Broadcast) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Encoder(shared.value)
        for texts in batches:
            done = [own.encode(b) for b in blocks(texts, lower=False)]
            ids = np.concatenate([d[0] for d in done]) if done else np.zeros(0, np.int32)
            counts = np.concatenate([d[1] for d in done]) if done else np.zeros(0, np.int64)
            yield lists(pa.array(ids, pa.int32()), counts)

    return encode


def decode_lists(tokens: pa.Array, vocabulary: Vocabulary) -> pa.Array:
    counts = np.diff(tokens.offsets.to_numpy())
    ids = tokens.flatten().to_numpy(zero_copy_only=False)
    held = np.concatenate(([0], np.cumsum(counts)))
    texts, row = [], 0
    while row < len(counts):
        last = max(row + 1, int(np.searchsorted(held, held[row] + FOREST_CELLS, side="right")) - 1)
        part = ids[held[row] : held[last]]
        if len(part) and (part.min() < 0 or part.max() >= len(vocabulary.length) or vocabulary.length[part].min() < 0):
            raise ValueError("an id is not in the vocabulary")
        length = vocabulary.length[part]
        bounds = np.concatenate(([0], np.cumsum(length)))[held[row : last + 1] - held[row]].astype(np.int32)
        whole = np.ascontiguousarray(vocabulary.bytes[ranges(vocabulary.offset[part], length)])
        texts.append(pa.Array.from_buffers(pa.binary(), last - row, [None, pa.py_buffer(bounds), pa.py_buffer(whole)]))
        row = last
    return pa.concat_arrays(texts) if texts else pa.array([], pa.binary())


def _decode(shared: Broadcast) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for tokens in batches:
            yield decode_lists(tokens, shared.value)

    return decode


def _round_trip(shared: Broadcast) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    encode, decode = _encode(shared), _decode(shared)

    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for ids in encode(batches):
            (decoded,) = decode(iter([ids]))
            yield pa.StructArray.from_arrays([ids, decoded], names=["ids", "decoded"])

    return both


class Codec:
    """Column functions of one vocabulary, which is broadcast once."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int]):
        bounded_batches(spark)
        self.shared = spark.sparkContext.broadcast(Vocabulary(ranks))

    def encode(self, text: str | Column) -> Column:
        """Text to array of token ids."""
        return F.arrow_udf(_encode(self.shared), "array<int>")(text)

    def round_trip(self, text: str | Column) -> Column:
        """Text to its ids and to the bytes that these ids decode to, in one Python worker."""
        return F.arrow_udf(_round_trip(self.shared), "struct<ids:array<int>,decoded:binary>")(text)

    def decode(self, tokens: str | Column) -> Column:
        """Array of token ids to bytes; a null array has no bytes."""
        return F.arrow_udf(_decode(self.shared), "binary")(tokens)
