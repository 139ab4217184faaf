"""Token counts of flat token files: a separator scan with a prefix scan over blocks.

A token file is a run of identifiers of fixed width with an end-of-document
identifier after each document and no index. Files are read as blocks cut anywhere.
A task finds the separators of a block with one vectorised search; a prefix scan
over the block summaries of a file (tokens, separators, last separator) then gives
every block the number of documents before it and the tokens of the document it
begins in. Only summaries, a few numbers for a block, pass through the scan.

Defined results: an empty document (two separators in a row) has 0 tokens; tokens
after the last separator of a file are a document that has not ended; an empty file
has no document; a block whose bytes are no whole number of identifiers raises.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm.blocks import blocks as texts_in_blocks
from lexiloom.llm.blocks import bounded_batches, lists
from lexiloom.llm.bpe import Codec, Encoder
from lexiloom.session import materialise

WIDTH = 2  # bytes of an identifier, little-endian
BLOCK_TOKENS = 1 << 19
FILE_BYTES = 256 << 20


def read_blocks(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS, width: int = WIDTH, most: int = FILE_BYTES) -> DataFrame:
    """Raw files as (file, block, data). A file is one row first, so files above ``most`` bytes raise: cut them by size."""
    files = spark.read.format("binaryFile").load(path)
    size = block_tokens * width
    blocks = F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("length") / size) - 1)
    checked = F.when(F.col("length") > most, F.raise_error(F.concat(F.lit("file is too large: "), "path"))).otherwise(F.col("content"))
    return (
        files.where("length > 0")
        .select(F.col("path").alias("file"), checked.alias("content"), F.explode(blocks).alias("block"))
        .select("file", "block", F.substring("content", (F.col("block") * size + 1).cast("int"), F.lit(size)).alias("data"))
    )


def _as_tokens(batch: pa.RecordBatch, encoder: Encoder | None) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Ids of documents, their tokens one after another, and where each begins; texts are encoded block by block."""
    ids, column = batch.column(0).to_pylist(), batch.column(1)
    if encoder is None:
        offsets = column.offsets.to_numpy()
        yield ids, column.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]
        return
    for block in texts_in_blocks(column, lower=False):
        flat, counts = encoder.encode(block)
        yield ids[block.first : block.first + block.rows], flat, np.concatenate(([0], np.cumsum(counts)))


def _writer(separator: int, width: int, block_tokens: int, vocabulary: Broadcast | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = np.dtype(f"<u{width}")

    def block(number: int, tokens: np.ndarray, first: int, ids: list) -> pa.RecordBatch:
        file = TaskContext.get().partitionId()
        return pa.RecordBatch.from_arrays(
            [pa.array([file], pa.int64()), pa.array([number], pa.int64()), pa.array([tokens.astype(kind).tobytes()]), pa.array([first], pa.int64()), pa.array([ids], pa.list_(pa.int64()))],
            names=["file", "block", "data", "first", "doc_ids"],
        )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, names, ends, held, number, first = [], [], [], 0, 0, 0
        encoder = None if vocabulary is None else Encoder(vocabulary.value)
        for ids, flat, offsets in (part for batch in batches for part in _as_tokens(batch, encoder)):
            for i, doc in enumerate(ids):
                own = flat[offsets[i] : offsets[i + 1]]
                if len(own) and (own.min() < 0 or own.max() >= 1 << 8 * width or (own == separator).any()):
                    raise ValueError("an identifier is the separator or wider than the file")
                waiting += [own, np.array([separator])]
                held += len(own) + 1
                names.append(doc)
                ends.append(number * block_tokens + held)
                while held >= block_tokens:
                    whole = np.concatenate(waiting)
                    here = int(np.searchsorted(ends, (number + 1) * block_tokens, side="right"))
                    yield block(number, whole[:block_tokens], first, names[:here])
                    waiting, held, number, first = [whole[block_tokens:]], held - block_tokens, number + 1, first + here
                    names, ends = names[here:], ends[here:]
        if held:
            yield block(number, np.concatenate(waiting), first, names)

    return write


BLOCKS_SQL = "file long, block long, data binary, first long, doc_ids array<long>"


def write_blocks(
    tokens: DataFrame, doc_id: str, ids: str, separator: int, width: int = WIDTH, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """One flat file for each partition of ``tokens``, in the shared folder as blocks (file, block, data).

    Beside the data stands which documents end in a block (``first`` ordinal, ``doc_ids``); the scan does not read that.
    """
    bounded_batches(tokens.sparkSession)
    rows = tokens.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(ids, F.array().cast("array<int>")).alias("ids"))
    return materialise(rows.mapInArrow(_writer(separator, width, block_tokens), BLOCKS_SQL), "token-blocks")


def write_texts(
    docs: DataFrame, doc_id: str, text: str, codec: Codec, separator: int, width: int = WIDTH, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """The same from texts, encoded in the task that writes them."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return materialise(rows.mapInArrow(_writer(separator, width, block_tokens, codec.shared), BLOCKS_SQL), "token-blocks")


def _separators(separator: int, width: int) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    kind = np.dtype(f"<u{width}")

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for blocks in batches:
            sizes, found = [], []
            for data in blocks:
                tokens = np.frombuffer(data.as_buffer() or b"", kind)
                sizes.append(len(tokens))
                found.append(np.flatnonzero(tokens == separator))
            flat = np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)
            counts = np.array([len(f) for f in found], np.int64)
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), lists(pa.array(flat), counts)], names=["tokens", "at"])

    return find


def count_tokens(blocks: DataFrame, separator: int, width: int = WIDTH) -> DataFrame:
    """(file, block, data) to one row per document: file, ordinal in it, start, n_tokens, ended."""
    bounded_batches(blocks.sparkSession)
    scan = F.arrow_udf(_separators(separator, width), "struct<tokens:bigint,at:array<int>>")
    found = materialise(blocks.select("file", "block", scan("data").alias("s")).select("file", "block", "s.tokens", "s.at"), "separators")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    size, none = F.size("at"), F.lit(0).cast("bigint")
    summary = found.select("file", "block", "tokens", size.cast("bigint").alias("n"), F.when(size > 0, F.element_at("at", -1)).alias("last"))
    offset = summary.withColumn("offset", F.coalesce(F.sum("tokens").over(before), none))
    scanned = offset.select(
        "file",
        "block",
        "offset",
        F.coalesce(F.sum("n").over(before), none).alias("documents"),
        F.coalesce(F.max(F.col("offset") + F.col("last") + 1).over(before), none).alias("begun"),
        F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull().alias("final"),
    )
    ends = F.transform("at", lambda a: F.col("offset") + a)
    ends = F.when(F.col("final"), F.concat(ends, F.array(F.col("offset") + F.col("tokens")))).otherwise(ends)
    ended = found.join(scanned, ["file", "block"]).withColumn("ends", ends)
    rows = ended.select("file", "documents", "begun", "ends", "final", F.posexplode("ends").alias("i", "end")).select(
        "file",
        (F.col("documents") + F.col("i")).alias("ordinal"),
        F.when(F.col("i") == 0, F.col("begun")).otherwise(F.try_element_at("ends", F.col("i")) + 1).alias("start"),
        "end",
        (~F.col("final") | (F.col("i") < F.size("ends") - 1)).alias("ended"),
    )
    return rows.select("file", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"), "ended").where("ended OR n_tokens > 0")


def named_counts(blocks: DataFrame, separator: int, width: int = WIDTH) -> DataFrame:
    """Counts of ``write_blocks`` files under the ids of their documents."""
    names = blocks.select("file", "first", F.posexplode("doc_ids").alias("i", "doc_id")).select("file", (F.col("first") + F.col("i")).alias("ordinal"), "doc_id")
    return count_tokens(blocks.select("file", "block", "data"), separator, width).join(names, ["file", "ordinal"])
