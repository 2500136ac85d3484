"""Concatenate-and-cut packing with two-pass prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import give_back, ids_crc32, join_checked, sliced, store, table
from .tokens import encoder, public_path

SEQUENCE = 2048
#: Bytes of text, or of ids, that a task works on at once.
SLICE = 1 << 20


def tokenized_parts(docs: DataFrame, vocabulary: str, end_id: int, keep_space: bool, plain_specials: bool, id_col: str, text_col: str) -> DataFrame:
    """First pass: each document's ids, its part (the task) and the ids before it in that part."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        enc = encoder(public_path(vocabulary), keep_space, plain_specials)
        give_back()  # what reading the vocabulary took
        tail = np.array([end_id], "<u2").tobytes()
        for b in sliced(batches, 1, SLICE):
            ids = [x.tobytes() + tail for x in enc.encode_many(b.column(1))]
            n = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(before + np.cumsum(n) - n), pa.array(n), pa.array(ids, pa.binary())],
                ["doc_id", "part", "part_start", "n", "ids"],
            )
            before += int(n.sum())

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return cols.mapInArrow(encode, "doc_id long, part int, part_start long, n long, ids binary")


def pack(
    docs: DataFrame,
    *,
    vocabulary: str = "word_bpe_49k.json",
    end_id: int = 1,
    keep_space: bool = False,
    plain_specials: bool = False,
    sequence: int = SEQUENCE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Lay all documents end to end and cut the stream every ``sequence`` ids.

    Pass one encodes each document, in place, into a stored table and numbers the ids within each part. A
    prefix sum over the part totals (one row a part) turns these into global offsets. Pass two cuts each
    document at the global multiples of ``sequence``; no ids are shuffled in either pass. A sequence that begins
    in one part and ends in the next needs no exchange: both parts emit their own pieces of it (the boundary
    records, ``boundary`` true), which share the ``sequence_id``. All sequences are full but the last.

    The string of a special token becomes that token, as in the library; with ``plain_specials`` it is ordinary
    text. Null texts are empty, so such a document is its end id alone. Null ids are kept as null; repeated rows
    and rows of one id are packed each, in the order of the table. Very long texts are cut into as many pieces as
    they need; a text is the unit of memory. An empty table gives no pieces. Only the two named columns are read,
    so other columns may have any name. Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    boundary, ids (the piece's ids as little-endian uint16 bytes).
    """
    encoded = store(tokenized_parts(docs, vocabulary, end_id, keep_space, plain_specials, id_col, text_col), "ids")
    totals = encoded.groupBy("part").agg(F.sum("n").alias("total"))
    parts = store(totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("part_offset"), "total"), "parts")
    placed = join_checked(encoded, parts, "part").select("doc_id", "part_offset", "part_start", "total", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 4, SLICE):
            part_first, part_end = b.column(1).to_numpy(), b.column(1).to_numpy() + b.column(3).to_numpy()
            first = part_first + b.column(2).to_numpy()
            row, rows, pieces = [], [], []
            for k, (at, raw) in enumerate(zip(first.tolist(), b.column(4).to_pylist())):
                ids = np.frombuffer(raw, "<u2")
                done, n = 0, len(ids)
                while done < n:
                    seq, off = divmod(at + done, sequence)
                    size = min(sequence - off, n - done)
                    piece = ids[done : done + size]
                    row.append(k)
                    rows.append((done, size, ids_crc32(piece), n, seq, off))
                    pieces.append(piece.tobytes())
                    done += size
            numbers = np.array(rows, np.int64).reshape(-1, 6).T
            boundary = (numbers[4] * sequence < part_first[row]) | ((numbers[4] + 1) * sequence > part_end[row])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *map(pa.array, numbers), pa.array(boundary), pa.array(pieces, pa.binary())], names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, boundary boolean, ids binary"
    names = [c.split()[0] for c in schema.split(", ")]
    return placed.mapInArrow(cut, schema)


def op3_pack(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents")).drop("boundary", "ids")
