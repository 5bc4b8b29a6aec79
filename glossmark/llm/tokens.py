"""Token output: texts to ids with a public tokenizer, Re-Pair compressed blocks in document order, and reading them back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmark.llm.common import arrow_batches, give_back_memory, materialize, text_slices, texts_of
from glossmark.llm.encoder import encoder
from glossmark.llm.repair import Block, pack

END_ID = 0
#: Token ids after which a block is closed (it always holds whole documents).
BLOCK_TOKENS = 600_000
#: Texts that a worker receives at once, and bytes of text that are encoded at once (a longer text is encoded alone).
BATCH_ROWS, SLICE_BYTES = 250, 1 << 20

def file_order(docs: DataFrame) -> DataFrame | None:
    """``docs`` with the name of its file and the place in it as ``__file`` and ``__row``; None if the rows come from no files."""
    try:
        return docs.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        return None


def write_blocks(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, keep_order: bool = False) -> DataFrame:
    """The table of blocks, written in the shared folder and read back: part, start_in_part, n_tokens, doc_ids, payload.

    Documents are dealt by ranges of their id and sorted, so parts, and blocks in a part, follow the ids. Null ids come first;
    equal ids follow their texts. A null text is an empty one: it has the end id alone. An empty table gives no blocks.
    With ``keep_order`` the documents follow the names of their files and their places there, as a mixing stage wrote them.
    """
    placed = file_order(docs) if keep_order else None
    if placed is None:
        ranged = texts_of(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    else:
        rows = placed.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), "__file", "__row")
        ranged = rows.repartitionByRange("__file", "__row").sortWithinPartitions("__file", "__row").select("doc_id", "text")
    schema = "part int, start_in_part long, n_tokens long, doc_ids array<long>, payload binary"
    want = pa.schema([("part", pa.int32()), ("start_in_part", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part, start = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        end = tool.n_ids  # the end of a document, told apart from the token with the end id
        close = np.array([end], np.uint32)
        ids: list = []
        pieces: list[np.ndarray] = []
        held = 0

        def block() -> pa.RecordBatch:
            payload = pack(np.concatenate(pieces), end)
            return pa.RecordBatch.from_pylist([{"part": part, "start_in_part": start, "n_tokens": held, "doc_ids": ids, "payload": payload}], schema=want)

        for b in batches:
            for at, n in text_slices(b.column(1), SLICE_BYTES):
                for doc, code in zip(b.column(0).slice(at, n).to_pylist(), tool.encode_column(b.column(1).slice(at, n))):
                    ids.append(doc)
                    pieces += [code, close]
                    held += len(code) + 1
                    if held >= block_tokens:
                        yield block()
                        start, held, ids, pieces = start + held, 0, [], []
        if ids:
            yield block()
        give_back_memory()

    with arrow_batches(docs.sparkSession, BATCH_ROWS):
        return materialize(ranged.mapInArrow(run, schema), "token-blocks")


def read_blocks(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the blocks alone.

    ``start`` counts the ids of all documents before. The sums of the parts (one row for each range of ids) give each part's first.
    """
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # One row for each task that wrote: broadcast, so that the payload is read where it lies.
    rows = blocks.join(F.broadcast(offsets), "part").select((F.col("offset") + F.col("start_in_part")).alias("start"), "doc_ids", "payload")
    want = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, ids, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                block = Block(payload.as_buffer())
                tokens = block.all()
                last = np.flatnonzero(tokens == block.end)
                tokens[last] = END_ID
                begin = np.concatenate([[0], last[:-1] + 1])
                data = memoryview(tokens.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * x : 4 * (y + 1)]) for x, y in zip(begin.tolist(), last.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(start + begin), pa.array(last + 1 - begin), pa.array(crc, pa.int64())], schema=want)

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
