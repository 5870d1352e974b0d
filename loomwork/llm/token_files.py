"""Token ids in Arrow stream files of fixed-size-list batches, for zero-copy random access to equal-length sequences.

A file holds the documents of one range of doc_id, in ascending order, as one run of ids cut into rows of `length`:
`ids` fixed_size_list<uint16 or uint32>[length] and `mask`, the number of the row's mask. All batches but the last have
the same number of rows and bytes, so row r lies in batch r // rows at a known place of the file. Two more streams lie
beside it: `.masks` has each different mask once, as fixed_size_list<uint8>[length] (whole bytes, as packed bits can't be
read without a copy): the one of full rows and, where the last row is padded, the one that is 0 for its padding; `.index`
has doc_id, start and n_tokens by document. Mapped files give ids and masks without a copy, and of a remote one a batch is
read at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zlib
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir
from .token_ids import NO_SPACES, cached

INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def schema(length: int, wide: bool) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint32() if wide else pa.uint16(), length)), ("mask", pa.int32())])


class Writer:
    """Writes one file; the name appears only when all of it is there, so a repeated task does no harm."""

    def __init__(self, folder: str, name: str, length: int, wide: bool, rows: int = 1024):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.name, self.length, self.rows, self.kind = name, length, rows, np.uint32 if wide else np.uint16
        self.temporary = f"{self.folder}/_{name}-{np.random.SeedSequence().entropy:x}"
        self.out, self.index_out = self.fs.open_output_stream(self.temporary), self.fs.open_output_stream(self.temporary + ".index")
        self.stream, self.index_stream = pa.ipc.new_stream(self.out, schema(length, wide)), pa.ipc.new_stream(self.index_out, INDEX)
        self.masks = [np.ones(length, np.uint8)]
        self.held: list[np.ndarray] = []
        self.n_held = self.total = self.docs = 0
        self.index: list[tuple[int, int, int]] = []  # not yet written

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) > np.iinfo(self.kind).max:
            raise ValueError(f"token id {int(ids.max())} does not fit {np.dtype(self.kind).name}: write wide files")
        self.index.append((doc_id, self.total, len(ids)))
        self.docs += 1
        if len(self.index) >= 65536:
            self._index()
        self.total += len(ids)
        self.held.append(ids.astype(self.kind))
        self.n_held += len(ids)
        if self.n_held >= self.rows * self.length:
            flat, full = np.concatenate(self.held), self.rows * self.length
            whole = self.n_held // full * full
            for at in range(0, whole, full):
                self._batch(flat[at : at + full], full)
            self.held, self.n_held = [flat[whole:]], self.n_held - whole

    def _batch(self, flat: np.ndarray, real: int) -> None:
        mask = np.zeros(len(flat) // self.length, np.int32)
        if real < len(flat):
            mask[-1] = len(self.masks)
            self.masks.append((np.arange(len(flat) - self.length, len(flat)) < real).astype(np.uint8))
        self.stream.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(flat), self.length), pa.array(mask)], ["ids", "mask"]))

    def _write_masks(self) -> None:
        masks = pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(self.masks)), self.length)], ["mask"])
        with self.fs.open_output_stream(self.temporary + ".masks") as out, pa.ipc.new_stream(out, masks.schema) as stream:
            stream.write_batch(masks)

    def _index(self) -> None:
        if self.index:
            self.index_stream.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self.index, strict=True)], schema=INDEX))
            self.index = []

    def close(self) -> str:
        if self.n_held:
            flat = np.concatenate(self.held)
            self._batch(np.concatenate([flat, np.zeros(-len(flat) % self.length, self.kind)]), len(flat))
        self._index()
        self._write_masks()
        for x in (self.stream, self.out, self.index_stream, self.index_out):
            x.close()
        final = f"{self.folder}/{self.name}.arrow"
        for beside in (".masks", ".index"):
            self.fs.move(self.temporary + beside, final + beside)
        self.fs.move(self.temporary, final)
        return final


class Reader:
    """Random access to the sequences and the documents of one file; of a remote file only the last batch read is held."""

    def __init__(self, folder: str, name: str):
        self.fs, at = pafs.FileSystem.from_uri(folder)
        self.path = f"{at}/{name}.arrow"
        self.source = self._open(self.path)
        self.schema = pa.ipc.read_schema(self.source)
        self.first = self.step = self.source.tell()  # where batches begin; then how many bytes each has
        self.length, self.rows, self.last = self.schema.field(0).type.list_size, 1, (-1, None)
        head = self._batch(0)
        if head is not None:
            self.rows, self.step = head.num_rows, self.source.tell() - self.first
        with pa.ipc.open_stream(self._open(self.path + ".masks")) as masks:
            self.masks = masks.read_next_batch().column(0).flatten().to_numpy().view(np.bool_).reshape(-1, self.length)

    def _open(self, path: str) -> pa.NativeFile:
        return pa.memory_map(path) if isinstance(self.fs, pafs.LocalFileSystem) else self.fs.open_input_file(path)

    def _batch(self, i: int) -> pa.RecordBatch | None:
        if self.last[0] != i:
            self.source.seek(self.first + i * self.step)
            try:
                self.last = (i, pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema))
            except EOFError:  # a file without batches
                return None
        return self.last[1]

    def _flat(self, batch: int) -> np.ndarray:
        return self._batch(batch).column(0).flatten().to_numpy()

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of one row, both views of mapped files."""
        b, r = divmod(row, self.rows)
        mask = self._batch(b).column(1).to_numpy()[r]
        return self._flat(b)[r * self.length : (r + 1) * self.length], self.masks[mask]

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from `start` on; a view of the file unless they cross batches."""
        full, out = self.rows * self.length, []
        while n > 0:
            b, at = divmod(start, full)
            part = self._flat(b)[at : at + n]
            out.append(part)
            start, n = start + len(part), n - len(part)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint16)

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(doc_id, start in this file, ids) of each document."""
        with self.fs.open_input_file(self.path + ".index") as f:
            for batch in pa.ipc.open_stream(f):
                for d, s, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield d, s, self.ids(s, n)


def n_files(d: DataFrame, file_bytes: int) -> int:
    """Files for the texts of d: as many as the cluster has cores while they stay small, and none of over about file_bytes of text."""
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, min(d.sparkSession.sparkContext.defaultParallelism, size >> 22), -(-size // file_bytes))


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, length: int = 1024, files: int | None = None, file_bytes: int = 256 << 20, wide: bool | None = None) -> list[tuple[str, int, int]]:
    """Encodes every whole text, appends end_id, and writes files in ascending doc_id order to the shared folder.

    Returns (name, documents, ids) of each file, in order: the manifest, a row per file. Rows are dealt by ranges of
    doc_id, so no file depends on another; their number comes from the bytes of all texts, about `file_bytes` each. Null
    texts are empty (only the end id); ids are integers (else Spark's cast fails), rows with a null one come first, and
    repeated ones follow each other by text, in one file. `wide` writes 32-bit ids; by default the vocabulary decides, and
    an id that does not fit is an error.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if wide is None:
        from tokenizers import Tokenizer

        wide = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True) - 1, end_id) > np.iinfo(np.uint16).max
    n = files or n_files(d, file_bytes)
    dealt = d.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, w, end = cached(tokenizer_path, NO_SPACES), None, np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        for b in batches:
            w = w or Writer(folder, f"part-{part:06d}", length, wide)
            for i, ids in zip(b.column(0).to_pylist(), cache.encode(b.column(1).to_pylist()), strict=True):
                w.add(i, np.frombuffer(ids + end, "<u4"))
        if w:
            w.close()
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([f"part-{part:06d}"]), pa.array([w.docs]), pa.array([w.total])], ["part", "name", "docs", "ids"])

    rows = dealt.mapInArrow(write, "part long, name string, docs long, ids long").collect()  # a row per file
    return [(r.name, r.docs, r.ids) for r in sorted(rows, key=lambda r: r.part)]


def read_token_files(spark, folder: str, manifest: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of each document, read back from the files."""
    starts = [0, *accumulate(x[2] for x in manifest)][:-1]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows = []
                for d, s, ids in Reader(folder, name).documents():
                    rows.append((d, base + s, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) >= 10_000:
                        yield _table(rows)
                        rows = []
                yield _table(rows)

    def _table(rows: list[tuple]) -> pa.RecordBatch:
        cols = zip(*rows, strict=True) if rows else ([], [], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    names = spark.createDataFrame([(m[0], s) for m, s in zip(manifest, starts, strict=True)], "name string, base long")
    return names.repartition(max(1, len(manifest))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Writes docs to token files in a new shared folder and reads them back (see write_token_files)."""
    folder = shared_dir(docs.sparkSession) + "/tokens"
    return read_token_files(docs.sparkSession, folder, write_token_files(docs, tokenizer_path, folder, **options))
