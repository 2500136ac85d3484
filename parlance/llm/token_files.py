"""Token ids as bit-packed binary files with block offsets."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import new_path, sliced, store, table
from .tokens import encoder, public_path

MAGIC = b"PTOK2\0\0\0"
BLOCK = 4096  # ids in a block
HEAD = struct.Struct("<8sIIQQQQ")  # magic, bits, block, ids, documents, documents without an id (the first), bytes of packed ids
#: Bytes of text in a file, and in a task of a small input.
FILE_BYTES, TASK_BYTES = 256 << 20, 4 << 20


def bits_for(vocabulary_size: int) -> int:
    """The fewest bits that hold every id below ``vocabulary_size``."""
    return max(1, int(vocabulary_size - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids packed at ``bits`` each, least significant bit first, padded to a whole byte."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    b = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(b.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(raw: bytes, bits: int, n: int) -> np.ndarray:
    """Inverse of :func:`pack_bits` for ``n`` ids."""
    if bits == 16:
        return np.frombuffer(raw, "<u2", n).astype(np.uint32)
    b = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (b.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class ShardWriter:
    """One file: header, packed blocks, block offsets (uint64), document ids (int64) and starts (uint64, one more)."""

    def __init__(self, sink, bits: int, block: int = BLOCK):
        self.sink, self.bits, self.block = sink, bits, block
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = self.n_bytes = 0
        self.n_nulls = 0
        self.offsets: list[int] = []
        self.docs: list[int] = []
        self.starts: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """Documents come in ascending order, those without an id first."""
        self.n_nulls += doc_id is None
        self.docs.append(doc_id or 0)
        self.starts.append(self.n_ids)
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block * 64:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint16)
        whole = len(ids) if last else len(ids) // self.block * self.block
        for at in range(0, whole, self.block):
            raw = pack_bits(ids[at : min(at + self.block, whole)], self.bits)
            self.offsets.append(self.n_bytes)
            self.sink.write(raw)
            self.n_bytes += len(raw)
        self.held = [ids[whole:]]
        self.n_held = len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        self.sink.write(np.array(self.offsets + [self.n_bytes], "<u8").tobytes())
        self.sink.write(np.array(self.docs, "<i8").tobytes())
        self.sink.write(np.array(self.starts + [self.n_ids], "<u8").tobytes())
        self.sink.write(HEAD.pack(MAGIC, self.bits, self.block, self.n_ids, len(self.docs), self.n_nulls, self.n_bytes))


class ShardReader:
    """Random access to a shard by document, through a seekable file; only the blocks asked for are read."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - HEAD.size)
        magic, self.bits, self.block, self.n_ids, n_docs, self.n_nulls, n_bytes = HEAD.unpack(source.read(HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        source.seek(n_bytes)
        n_blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(source.read(8 * (n_blocks + 1)), "<u8")
        self.docs = np.frombuffer(source.read(8 * n_docs), "<i8")
        self.starts = np.frombuffer(source.read(8 * (n_docs + 1)), "<u8").astype(np.int64)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids ``first`` to ``last`` (exclusive) of the shard."""
        if first >= last:
            return np.zeros(0, np.uint32)
        a, b = first // self.block, -(-last // self.block)
        lo, hi = int(self.offsets[a]), int(self.offsets[b])
        self.source.seek(lo)
        raw = self.source.read(hi - lo)
        out = []
        for k in range(a, b):
            n = min(self.block, self.n_ids - k * self.block)
            out.append(unpack_bits(raw[int(self.offsets[k]) - lo : int(self.offsets[k + 1]) - lo], self.bits, n))
        return np.concatenate(out)[first - a * self.block : last - a * self.block]


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def file_count(texts: DataFrame) -> int:
    """Files for a table of ``text``: by its bytes, and enough tasks for a small one."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-total // FILE_BYTES), min(tasks, -(-total // TASK_BYTES)))


def write_token_files(
    docs: DataFrame,
    path: str,
    *,
    vocabulary: str = "byte_bpe_50k.json",
    vocabulary_size: int = 50_257,
    end_id: int = 2,
    keep_space: bool = True,
    plain_specials: bool = False,
    files: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode documents and write them as bit-packed files in ascending doc_id order.

    Documents are dealt to files by ranges of (doc_id, hash of the text) and sorted within each, so file k holds
    smaller ids than file k+1, and repeated ids or documents without one do not meet in one file. A task writes a
    file of a fresh name and reports it in its one manifest row; a lost or repeated task leaves at most a stray
    file that no manifest names. Returns the manifest: part, file, size, n_ids, start (ids in all earlier files).

    The string of a special token becomes that token, as in the library; with ``plain_specials`` it is ordinary
    text. Null texts are empty, so such a document is its end id alone. A null doc_id comes first and is read back
    as null. Rows of one doc_id are ordered by the text's hash, then the text; repeated rows are written each.
    Very long texts are whole: a text is the unit of memory. An empty table writes a file without documents, or
    none. Only the two named columns are read, so other columns may have any name.
    """
    bits = bits_for(vocabulary_size)
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = ["doc_id", "hash", "text"]
    dealt = cols.withColumn("hash", F.xxhash64("text")).repartitionByRange(files or file_count(cols), "doc_id", "hash").sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(public_path(vocabulary), keep_space, plain_specials)
        tail = np.array([end_id], np.uint16)
        part = TaskContext.get().partitionId()
        name = f"{path}/part-{part:05d}-{uuid.uuid4().hex[:8]}.ptok"
        system, target = file_system(name)
        system.create_dir(target.rpartition("/")[0], recursive=True)
        with system.open_output_stream(target) as sink:
            shard = ShardWriter(sink, bits)
            for b in sliced(batches, 1):
                for doc, ids in zip(b.column(0).to_pylist(), enc.encode_many(b.column(1))):
                    shard.add(doc, np.concatenate([ids, tail]))
            shard.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "size": [system.get_file_info(target).size], "n_ids": [shard.n_ids]})

    manifest = store(dealt.mapInArrow(write, "part int, file string, size long, n_ids long"), "manifest")
    before = Window.orderBy("part")  # one row a file
    return manifest.withColumn("start", F.sum("n_ids").over(before) - F.col("n_ids"))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Documents of the files named by a manifest: doc_id, start (ids of all documents before), n_tokens, ids (uint32 bytes)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, size, start in zip(*(b.column(i).to_pylist() for i in range(3))):
                system, source = file_system(name)
                with system.open_input_file(source) as f:
                    shard = ShardReader(f, size)
                    for at in range(0, len(shard.docs), 500):
                        to = min(at + 500, len(shard.docs))
                        first = int(shard.starts[at])
                        ids = shard.ids(first, int(shard.starts[to])).astype("<u4").tobytes()
                        cuts = shard.starts[at : to + 1] - first
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(shard.docs[at:to], pa.int64(), mask=np.arange(at, to) < shard.n_nulls),
                                pa.array(start + shard.starts[at:to], pa.int64()),
                                pa.array(np.diff(cuts), pa.int64()),
                                pa.array([ids[4 * i : 4 * j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())], pa.binary()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids"],
                        )

    spark = manifest.sparkSession
    spread = manifest.select("file", "size", "start").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op2_token_files(spark, sf_dir):
    manifest = store(write_token_files(table(spark, sf_dir, "documents"), new_path(spark, "tokens")), "files")
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
