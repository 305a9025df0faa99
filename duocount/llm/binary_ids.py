"""Operator 2: token ids as Arrow files of equal-length sequences and masks.

Documents are put in ascending id order by a range partitioning on (id, hash of the text) - the hash
splits an id that very many rows share - encoded in Arrow batches, and written by each task as one
Arrow IPC file in the shared folder: record batches of ``ids`` (fixed-size list of unsigned 16- or
32-bit integers) and ``mask`` (fixed-size list of booleans), so a memory-mapped batch gives any
sequence as a view. Sequences run on across documents; only a file's last one is padded, with mask
false. A second file beside it lists the documents (id, first position in the file, ids).

Tasks write under a name of their attempt and move the file into place, so a repeated task is harmless;
nothing is kept on an executor. The driver holds one manifest row per file.

Defined results: null text counts as empty (the end id alone); a null document id sorts first; repeated
rows are written once each, in an order fixed by (id, text); an empty table gives no files and an empty
result; columns other than the id and the text are not read, so clashing names do not matter. A text is
encoded whole, in memory proportional to it.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass
from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duocount.llm.batches import small_batches, tidy
from duocount.llm.encode import encoder
from duocount.llm.words import buffers, slices
from duocount.session import checkpoint_dir, cut_lineage

BATCH_SEQUENCES = 64


def open_store(path: str):
    """(file system, path in it) of a shared folder named by a URI or an absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class SequenceFile:
    """Random access to a written file; on a local path without copying."""

    def __init__(self, folder: str, name: str):
        store, base = open_store(folder)
        path = f"{base}/{name}"
        source = pa.memory_map(path) if store.type_name == "local" else store.open_input_file(path)
        self.reader = pa.ipc.open_file(source)
        self.length = self.reader.schema.field("ids").type.list_size

    def batches(self) -> int:
        return self.reader.num_record_batches

    def ids(self, batch: int) -> np.ndarray:
        """The ids of a batch, one row a sequence; a view of the file where it is mapped."""
        flat = self.reader.get_batch(batch).column("ids").flatten()
        return flat.to_numpy(zero_copy_only=True).reshape(-1, self.length)

    def mask_bits(self, batch: int) -> pa.BooleanArray:
        """Which places of a batch hold ids, in one array; its bits are a view of the file where it is mapped."""
        return self.reader.get_batch(batch).column("mask").flatten()

    def mask(self, batch: int) -> np.ndarray:
        """The same unpacked to one byte a place, one row a sequence: a copy, since numpy has no bits."""
        return self.mask_bits(batch).to_numpy(zero_copy_only=False).reshape(-1, self.length)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        batch, row = divmod(i, BATCH_SEQUENCES)
        return self.ids(batch)[row], self.mask(batch)[row]


class _Writer:
    """One task's pair of files: ids stream in, full record batches go out."""

    def __init__(self, folder: str, name: str, length: int, dtype: str):
        self.store, base = open_store(folder)
        self.store.create_dir(base, recursive=True)
        context = TaskContext.get()
        attempt = f"{name}.{context.taskAttemptId() if context else 0}.tmp"
        self.final = [f"{base}/{name}.arrow", f"{base}/{name}.docs.arrow"]
        self.draft = [f"{base}/{attempt}", f"{base}/{attempt}.docs"]
        self.length, self.dtype = length, np.dtype(dtype)
        value = pa.from_numpy_dtype(self.dtype)
        schema = pa.schema([("ids", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))])
        index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [self.store.open_output_stream(p) for p in self.draft]
        self.out = [pa.ipc.new_file(s, x) for s, x in zip(self.sinks, (schema, index))]
        self.schema, self.index = schema, index
        self.held, self.size, self.tokens = [], 0, 0

    def documents(self, doc_ids: pa.Array, ids: list[np.ndarray]) -> None:
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        starts = self.tokens + np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        self.out[1].write_batch(pa.record_batch([doc_ids, pa.array(starts), pa.array(sizes)], schema=self.index))
        self.tokens += int(sizes.sum())
        self.held += [x.astype(self.dtype, copy=False) for x in ids]
        self.size += int(sizes.sum())
        block = self.length * BATCH_SEQUENCES
        if self.size >= block:
            flat = np.concatenate(self.held)
            full = len(flat) // block * block
            for at in range(0, full, block):
                self._write(flat[at:at + block], block)
            self.held, self.size = [flat[full:]], len(flat) - full

    def _write(self, flat: np.ndarray, real: int) -> None:
        mask = np.arange(len(flat)) < real
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, mask)]
        self.out[0].write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        if self.size:
            flat = np.concatenate(self.held)
            padded = np.zeros(-(-len(flat) // self.length) * self.length, dtype=self.dtype)
            padded[:len(flat)] = flat
            self._write(padded, len(flat))
        for out, sink in zip(self.out, self.sinks):
            out.close()
            sink.close()
        for draft, final in zip(self.draft, self.final):
            self.store.move(draft, final)


class Part(NamedTuple):
    part: int
    docs: int
    tokens: int
    start: int


@dataclass
class SequenceStore:
    """A written set of files: its folder, sequence length and one entry per file in id order."""

    folder: str
    length: int
    parts: list[Part]

    def file(self, part: int) -> SequenceFile:
        return SequenceFile(self.folder, f"part-{part:06d}.arrow")


def write_sequences(docs: DataFrame, tokenizer: str, end_id: int, length: int = 2048, doc_id: str = "doc_id",
                    text: str = "text", folder: str | None = None) -> SequenceStore:
    """Encode every document with the ``tokenizers`` file ``tokenizer``, append ``end_id`` and write
    all ids in ascending document order to ``folder`` (by default a new one in the checkpoint folder)."""
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/duocount-ids/{uuid.uuid4().hex}"
    dtype = "<u2" if max(encoder(tokenizer).size, end_id + 1) <= 1 << 16 else "<u4"
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    source = (small_batches(docs).select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), whole.alias("text"))
              .withColumn("h", F.xxhash64("text")))
    ordered = (source.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
               .select("doc_id", "text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode, writer, n = TaskContext.get().partitionId(), encoder(tokenizer), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                writer = _Writer(folder, f"part-{part:06d}", length, dtype)
            _, offsets = buffers(batch.column(1))
            for a, b in slices(offsets):
                ids = [np.frombuffer(x + end_id.to_bytes(4, "little"), "<u4") for x in encode(batch.column(1)[a:b])]
                writer.documents(batch.column(0)[a:b], ids)
            n += batch.num_rows
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "docs": [n], "tokens": [writer.tokens]},
                                             schema=pa.schema([("part", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    made = cut_lineage(ordered.mapInArrow(tidy(write, caches=True), "part int, docs long, tokens long"), "id-files")
    parts, start = [], 0
    for row in sorted(made.collect()):  # one row a file
        parts.append(Part(row["part"], row["docs"], row["tokens"], start))
        start += row["tokens"]
    return SequenceStore(folder, length, parts)


def read_documents(spark: SparkSession, store: SequenceStore) -> DataFrame:
    """Per document, from the files: ``doc_id``, ``start`` (ids of all documents before it),
    ``n_tokens`` and ``ids_crc32`` (unsigned crc32 of its ids as little-endian unsigned 32-bit)."""
    files = spark.createDataFrame([tuple(p) for p in store.parts], "part int, docs long, tokens long, start long")
    if store.parts:
        files = files.repartition(len(store.parts), "part")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _read_part(store, row["part"], row["start"])

    return files.mapInArrow(tidy(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _read_part(store: SequenceStore, part: int, base: int) -> Iterator[pa.RecordBatch]:
    file = store.file(part)
    fs_, root = open_store(store.folder)
    index = pa.ipc.open_file(fs_.open_input_file(f"{root}/part-{part:06d}.docs.arrow"))
    block, held, held_at = file.length * BATCH_SEQUENCES, np.zeros(0, "<u4"), -1
    for i in range(index.num_record_batches):
        docs = index.get_batch(i)
        starts, sizes = docs.column("start").to_numpy(), docs.column("n_tokens").to_numpy()
        crcs = np.zeros(len(sizes), dtype=np.int64)
        for d, (at, n) in enumerate(zip(starts.tolist(), sizes.tolist())):
            crc, end = 0, at + n
            while at < end:
                if at // block != held_at:
                    held_at = at // block
                    ids, mask = file.ids(held_at), file.mask(held_at)
                    held = ids[mask].astype("<u4")
                take = min(end, (held_at + 1) * block)
                crc = zlib.crc32(held[at - held_at * block:take - held_at * block], crc)
                at = take
            crcs[d] = crc
        yield pa.RecordBatch.from_arrays([docs.column("doc_id"), pa.array(starts + base), pa.array(sizes), pa.array(crcs)],
                                         names=["doc_id", "start", "n_tokens", "ids_crc32"])
