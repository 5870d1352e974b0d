"""Best-fit packing of token pieces into sequences under several capacities at once."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytes_np as B
from .token_ids import WITH_SPACES, cached

OUT = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def best_fit(sizes: np.ndarray, capacity: np.ndarray, weights: np.ndarray, score: str = "norm") -> np.ndarray:
    """The bin of each row of sizes (items x dimensions), every bin within capacity in every dimension.

    Items come in descending order of weighted size. Each goes to the open bin, among those with room in every
    dimension, that leaves the least weighted squared norm of what remains ("norm"), or that has the largest weighted
    dot product of item and remaining room ("dot"); ties to the older bin; without such a bin a new one opens. An item
    that no empty bin could hold is an error.
    """
    x = sizes / capacity
    if (x > 1 + 1e-12).any():
        i = int(np.flatnonzero((x > 1 + 1e-12).any(1))[0])
        raise ValueError(f"item {i} of sizes {sizes[i].tolist()} exceeds a capacity of {np.asarray(capacity).tolist()}")
    order = np.lexsort((np.arange(len(x)), -(x * weights).sum(1)))
    room = np.empty((x.shape[1], len(x)))  # of each open bin, by dimension
    number = np.empty(len(x), np.int64)
    out = np.empty(len(x), np.int64)
    least = np.minimum.accumulate(x[order][::-1], 0)[::-1]  # the least size still to come, by dimension
    n_open = n_bins = 0
    eps = 1e-12
    for step, i in enumerate(order):
        item = x[i]
        if step % 256 == 0 and n_open:  # bins that nothing can enter any more are closed
            keep = np.flatnonzero((room[:, :n_open] >= least[step][:, None] - eps).all(0))
            room[:, : len(keep)], number[: len(keep)] = room[:, keep], number[keep]
            n_open = len(keep)
        fits = np.flatnonzero(room[0, :n_open] >= item[0] - eps)
        for k in range(1, len(item)):  # the other dimensions only of the bins that are left
            fits = fits[room[k, fits] >= item[k] - eps]
        if len(fits):
            there = room[:, fits]
            value = weights @ (there - item[:, None]) ** 2 if score == "norm" else -((weights * item) @ there)
            b = fits[np.argmin(value)]
        else:
            b = n_open
            room[:, b], number[b] = 1.0, n_bins
            n_open, n_bins = n_open + 1, n_bins + 1
        room[:, b] -= item
        out[i] = number[b]
    return out


def pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = 1024, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the ids of each whole text and end_id, cut only where longer than capacity; then the first piece is the short one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, end = cached(tokenizer_path, WITH_SPACES), np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows = []
            for d, ids in zip(b.column(0).to_pylist(), cache.encode(b.column(1).to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                edges = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                rows += [(d, p, s, e - s, zlib.crc32(ids[4 * s : 4 * e])) for p, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
            cols = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return d.mapInArrow(B.tidy(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(parts: DataFrame, *, capacity: int = 1024, max_docs: int = 1024, max_attention: float | None = None, weights: tuple = (1.0, 0.001, 0.001), score: str = "norm", groups: int = 1) -> DataFrame:
    """parts with (sequence_id, offset): every sequence within capacity tokens, max_docs pieces and max_attention (sum of squared lengths; default capacity squared, which never binds).

    Pieces are dealt in turn into `groups` of equal size whatever their ids are, each packed by one task; sequences of
    a group are `group * 2**32 + number`. Equal rows are packed each for itself. A piece that alone exceeds a capacity
    is an error, also where it would fill a sequence alone.
    """
    most = float(capacity) ** 2 if max_attention is None else max_attention
    limits = np.array([capacity, max_docs, most], np.float64)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).to_pandas().sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], na_position="last", ignore_index=True)
        n = rows["length"].to_numpy(np.float64)
        sizes = np.stack([n, np.ones(len(n)), n**2], 1)
        out = np.empty(len(rows), np.int64)
        full = n >= capacity  # fills a sequence alone
        out[~full] = best_fit(sizes[~full], limits, np.array(weights), score)
        if full.any():
            best_fit(sizes[np.flatnonzero(full)[:1]], limits, np.array(weights))  # raises where even one can't be held
        out[full] = (out[~full].max() + 1 if not full.all() else 0) + np.arange(full.sum())
        rows["sequence_id"] = (np.int64(TaskContext.get().partitionId()) << 32) + out
        rows["offset"] = rows.groupby("sequence_id")["length"].cumsum() - rows["length"]
        yield from pa.Table.from_pandas(rows, schema=OUT, preserve_index=False).to_batches(max_chunksize=65536)

    return parts.select("doc_id", "piece", "start", "length", "ids_crc32").repartition(groups).mapInArrow(fit, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer_path: str, *, capacity: int = 1024, end_id: int = 2, group_rows: int = 8192, group_bytes: int = 64 << 20, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Packs the documents into as few sequences of at most `capacity` tokens as best-fit finds, at most about `group_rows` documents and `group_bytes` of text to a group.

    Returns a row per piece: doc_id, piece (from 0), start, length, ids_crc32, sequence_id, offset (gapless from 0).
    Null and empty texts are one piece of end_id alone; repeated rows and null ids are packed as they are; an empty
    table gives no rows; other columns are ignored. Only piece numbers are shuffled, never ids or texts. Other capacities
    (max_docs, max_attention) go to `pack`; a document that alone exceeds one of them is an error.
    """
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col(text)).cast("long")), F.lit(0))).first()
    groups = max(1, round(n / group_rows), -(-size // group_bytes))
    return pack(pieces(docs, tokenizer_path, capacity=capacity, end_id=end_id, doc_id=doc_id, text=text), capacity=capacity, groups=groups, **options)
