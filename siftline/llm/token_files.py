"""Token-ID output: Arrow files of equal-length sequences, with their masks.

Documents are dealt out by ranges of their id and sorted, so that the files, read in the order of their parts, hold all
ids in ascending document order. Each part is one Arrow file of record batches of ``rows_per_batch`` rows:

    ids:  fixed_size_list<uint16 or uint32>[seq_len]
    mask: fixed_size_list<bool>[seq_len]      false on the padding that fills up a part's last sequence

Every batch of a part but its last has the same number of rows and every row the same width, so the place of the i-th id of a part
follows by division, and a memory-mapped file gives it without copying. Beside it, ``part-....index.arrow`` lists the
part's documents (id, offset in the part, number of ids).

A task writes under names of its own attempt and reports them, and only reported files count; so a retried or doubled
task does no harm. Files are written and read with pyarrow's filesystems (file, hdfs, s3, gs), under the shared folder.
"""

from __future__ import annotations

import gc
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, scratch

SEQ_LEN = 2048
ROWS_PER_BATCH = 256
#: Distinct segments whose ids a worker remembers before it starts anew: about 250 MB.
CACHE = 1_200_000
#: Longer segments are not remembered.
REMEMBERED = 48
END_ID = 0

_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?#$%&*"
#: A word or a run of marks with the space before it, a line break, or else all up to a space that a non-space follows.
_SEGMENT = re.compile(rf" ?[{_LETTERS}]++(?![^\W\d_])| ?[{_MARKS}]++(?![^\s\w]|_)|\n(?= ?\S)|[\s\S][^ ]*(?: (?!\S)[^ ]*)*")


class Encoder:
    """Whole texts to ids, as the tokenizer gives them, encoding each distinct segment once.

    A byte-level BPE tokenizer splits a text into pre-tokens before it merges anything, and it always splits in front of a space
    that a non-space follows, after a run of letters, and after a run of marks. Texts are cut at such places alone, so the ids of
    the segments, one after the other, are those of the text. Segments are remembered, up to ``cache`` of them, for as long as the
    worker lives.
    """

    def __init__(self, path: str, cache: int = CACHE):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache, self.known = cache, {}

    def _learn(self, segments: list[str]) -> None:
        found = self.tokenizer.encode_batch(segments, add_special_tokens=False)
        self.known.update(zip(segments, [array("I", e.ids).tobytes() for e in found]))

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as unsigned 32-bit integers; null counts as empty."""
        known = self.known
        for text in texts:
            segments = _SEGMENT.findall(text) if text else []
            if new := {s for s in segments if s not in known}:
                self._learn(list(new))
            yield b"".join(map(known.__getitem__, segments))
            for s in [s for s in new if len(s) > REMEMBERED]:
                del known[s]
            if len(known) > self.cache:
                known.clear()


_ENCODERS: dict[str, Encoder] = {}


def worker_encoder(path: str) -> Encoder:
    """The encoder of this Python worker: tasks that follow on it find what earlier ones have learned.

    What it holds has no cycles, so it is kept out of the collector's rounds, which would visit it again and again.
    """
    gc.collect()
    gc.freeze()
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


@dataclass(frozen=True)
class Part:
    """One file: its number, names under the folder, documents, ids, and the ids of all parts before it."""

    number: int
    name: str
    n_docs: int
    n_ids: int
    start: int


@dataclass(frozen=True)
class TokenFiles:
    folder: str
    seq_len: int
    id_type: T.DataType
    parts: list[Part]


def _filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


class _Writer:
    """Appends ids to a part, a full record batch at a time."""

    def __init__(self, fs: pafs.FileSystem, path: str, dtype: np.dtype, seq_len: int, rows: int):
        self.dtype, self.seq_len, self.room = dtype, seq_len, rows * seq_len
        of = lambda t: pa.list_(t, seq_len)
        self.schema = pa.schema([("ids", of(pa.from_numpy_dtype(dtype))), ("mask", of(pa.bool_()))])
        self.file = fs.open_output_stream(path)
        self.out = ipc.new_file(self.file, self.schema)
        self.waiting, self.n_waiting, self.n = [], 0, 0

    def append(self, ids: np.ndarray) -> None:
        self.waiting.append(ids.astype(self.dtype))
        self.n_waiting += len(ids)
        self.n += len(ids)
        if self.n_waiting >= self.room:
            flat = np.concatenate(self.waiting)
            full = len(flat) // self.room * self.room
            for a in range(0, full, self.room):
                self._put(flat[a : a + self.room], self.room)
            self.waiting, self.n_waiting = [flat[full:]], len(flat) - full

    def _put(self, flat: np.ndarray, real: int) -> None:
        mask = np.arange(len(flat)) < real
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (flat, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))

    def close(self) -> None:
        flat = np.concatenate(self.waiting) if self.waiting else np.empty(0, self.dtype)
        if real := len(flat):
            self._put(np.pad(flat, (0, -real % self.seq_len)), real)
        self.out.close()
        self.file.close()


def write_token_files(
    docs: DataFrame, tokenizer_path: str, folder: str | None = None, doc_id: str = "doc_id", text: str = "text",
    end_id: int = END_ID, seq_len: int = SEQ_LEN, rows_per_batch: int = ROWS_PER_BATCH,
) -> TokenFiles:
    """Encode every whole text, append ``end_id``, and write all ids in ascending order of doc_id.

    Null texts count as empty: they have the end id alone. Null ids come first; rows of one id are ordered by the hash
    of their text, then the text. An empty table gives no files. Other columns are ignored. The folder is a new one under
    the shared folder by default. Only a row for each file comes to the driver.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    n = partitions(spark)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    dealt = rows.repartitionByRange(n, "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = writer = index = end = None
        number, name = TaskContext.get().partitionId(), ""
        count = 0
        fs = root = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                encoder = worker_encoder(tokenizer_path)
                dtype = np.dtype(np.uint16 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else np.uint32)
                end = array("I", [end_id]).tobytes()
                fs, root = _filesystem(folder)
                fs.create_dir(root, recursive=True)
                name = f"part-{number:06d}-{uuid.uuid4().hex}"
                writer = _Writer(fs, f"{root}/{name}.arrow", dtype, seq_len, rows_per_batch)
                schema = pa.schema([("id", batch.schema.field("id").type), ("offset", pa.int64()), ("n", pa.int64())])
                index_file = fs.open_output_stream(f"{root}/{name}.index.arrow")
                index = ipc.new_file(index_file, schema)
            texts = batch.column("text").to_pylist()
            sizes = []
            before = writer.n
            for ids in encoder.encode(texts):
                ids = np.frombuffer(ids + end, np.uint32)
                writer.append(ids)
                sizes.append(len(ids))
            sizes = np.array(sizes, np.int64)
            index.write_batch(pa.RecordBatch.from_arrays([batch.column("id"), pa.array(before + np.cumsum(sizes) - sizes), pa.array(sizes)], schema=schema))
            count += batch.num_rows
        if writer is not None:
            writer.close()
            index.close()
            index_file.close()
            yield pa.RecordBatch.from_pydict({"number": [number], "name": [name], "n_docs": [count], "n_ids": [writer.n]}, pa.schema([("number", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    parts, start = [], 0
    for r in sorted(dealt.mapInArrow(write, "number int, name string, n_docs long, n_ids long").collect()):
        parts.append(Part(r.number, r.name, r.n_docs, r.n_ids, start))
        start += r.n_ids
    return TokenFiles(folder, seq_len, docs.schema[doc_id].dataType, parts)


class SequenceReader:
    """Random access to one part."""

    def __init__(self, folder: str, name: str):
        fs, root = _filesystem(folder)
        local = isinstance(fs, pafs.LocalFileSystem)
        open_file = (lambda p: ipc.open_file(pa.memory_map(p))) if local else (lambda p: ipc.open_file(fs.open_input_file(p)))
        self.file, self.index = open_file(f"{root}/{name}.arrow"), open_file(f"{root}/{name}.index.arrow")
        self.at, self.batch = -1, None
        first = self.file.get_batch(0)
        self.seq_len, self.rows = first.schema.field("ids").type.list_size, first.num_rows

    def _flat(self, i: int) -> np.ndarray:
        if i != self.at:
            self.at, self.batch = i, self.file.get_batch(i)
        return self.batch.column("ids").flatten().to_numpy(zero_copy_only=True)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The i-th sequence and its mask."""
        flat, row = self._flat(i // self.rows), i % self.rows
        mask = self.batch.column("mask").slice(row, 1).flatten().to_numpy(zero_copy_only=False)
        return flat[row * self.seq_len : (row + 1) * self.seq_len], mask

    def ids(self, offset: int, n: int) -> np.ndarray:
        """n ids of the part from offset on."""
        width, out = self.rows * self.seq_len, []
        while n > 0:
            flat = self._flat(offset // width)[offset % width :][:n]
            out.append(flat)
            offset, n = offset + len(flat), n - len(flat)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, np.uint32)


def read_token_files(spark: SparkSession, files: TokenFiles, doc_id: str = "doc_id") -> DataFrame:
    """A row per document, read from the files: its id, ``start`` (ids of all documents before it), ``n_tokens`` with the end id,
    and ``ids_crc32`` of its ids as little-endian unsigned 32-bit integers. One task reads one part."""
    schema = T.StructType([T.StructField(doc_id, files.id_type), *(T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32"))])
    if not files.parts:
        return spark.createDataFrame([], schema)
    folder, parts = files.folder, files.parts

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number in (i for b in batches for i in b.column(0).to_pylist()):
            reader = SequenceReader(folder, parts[number].name)
            for k in range(reader.index.num_record_batches):
                rows = reader.index.get_batch(k)
                offset, n = rows.column("offset").to_numpy(), rows.column("n").to_numpy()
                crc = [zlib.crc32(reader.ids(a, m).astype("<u4").tobytes()) for a, m in zip(offset.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(offset + parts[number].start), pa.array(n), pa.array(crc, pa.int64())], names=[doc_id, "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(parts), 1, len(parts)).mapInArrow(read, schema)
