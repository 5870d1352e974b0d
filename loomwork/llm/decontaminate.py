"""Benchmark decontamination by winnowing (Schleimer, Wilkerson and Aiken 2003).

Of every `window` successive k-gram hashes the least is kept as a fingerprint, on both sides. With k + window - 1 = n,
any shared run of n words has at least one fingerprint in common; each common fingerprint is extended to both sides, and
runs of n words or more are the occurrences. So no shared run of n words is missed; that none is invented rests on words
being compared by 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytes_np as B
from .shared import shared_dir, stored

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FOUND = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("item_ids", T.ArrayType(T.LongType())), T.StructField("spans", SPANS)]
#: Bits of the table that tells most k-grams and windows without a partner before any shuffle (16 MB).
FILTER_BITS = 27
#: No key has more rows in one task of a join than this share of all rows on its side.
HOT_SHARE = 1000


def word_hashes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hash of each word, first word of each text and one more): A-Z lower-cased; words are runs of ASCII letters, digits and non-ASCII characters."""
    for row, data, offsets in B.text_slices(texts):
        data = B.LOWER[data]
        a, e, first = B.spans(data, offsets, B.WORD)
        yield row, B.hashes(data, a, e), first


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Which k-grams are the least of some run of `window`; equal least ones all count."""
    keep = np.zeros(len(grams), np.bool_)
    if len(grams) >= window:
        least = np.lib.stride_tricks.sliding_window_view(grams, window).min(1) if window > 8 else np.minimum.reduce([grams[j : len(grams) - window + 1 + j] for j in range(window)])
        for j in range(window):
            keep[j : j + len(least)] |= grams[j : j + len(least)] == least
    return keep


class Index:
    """The fingerprints of a bounded set of items, for one task."""

    def __init__(self, ids: list[int], texts: list[str | None], n: int, k: int):
        self.n, self.k = n, k
        words, item, self.short = [], [], {}
        for row, h, first in word_hashes(pa.array(texts, pa.large_string())):
            for i in range(len(first) - 1):
                w = h[first[i] : first[i + 1]]
                if len(w) >= n:
                    words.append(w)
                    item.append(np.full(len(w), ids[row + i], np.int64))
                elif len(w):
                    self.short.setdefault(len(w), {}).setdefault(int(B.windows(w, len(w))[0]), set()).add(ids[row + i])
        #: Items one after the other, with a word between them that no document has (0 is never equal: see below).
        self.words = np.concatenate([x for w in words for x in (w, np.zeros(1, np.uint64))] or [np.zeros(0, np.uint64)])
        self.item = np.concatenate([x for w in item for x in (w, np.full(1, -1, np.int64))] or [np.zeros(0, np.int64)])
        grams = B.windows(self.words, k)
        at = []
        start = 0
        for w in words:
            g = grams[start : start + len(w) - k + 1]
            at.append(start + np.flatnonzero(winnow(g, n - k + 1)))
            start += len(w) + 1
        at = np.concatenate(at) if at else np.zeros(0, np.int64)
        order = np.argsort(grams[at], kind="stable") if len(at) else at
        self.at, self.prints = at[order], grams[at][order] if len(at) else np.zeros(0, np.uint64)
        self.shorts = {m: np.sort(np.fromiter(x, np.uint64, len(x))) for m, x in self.short.items()}

    def occurrences(self, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
        """(starts, ends, items of each) over the words h of texts that begin at `first`."""
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        if len(self.prints) and len(h) >= self.n:
            grams = B.windows(h, self.k)
            d = np.flatnonzero(winnow(grams, self.n - self.k + 1))
            lo, hi = np.searchsorted(self.prints, grams[d], "left"), np.searchsorted(self.prints, grams[d], "right")
            d, lo, hi = d[hi > lo], lo[hi > lo], hi[hi > lo]
            times = hi - lo
            q = self.at[np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)] if len(d) else d
            p = np.repeat(d, times)
            ends = []
            for step in (-1, 1):  # extended to both sides while words and text and item stay the same
                a, b = p.copy(), q.copy()
                live = np.arange(len(p))
                while len(live):
                    x, y = a[live] + step, b[live] + step
                    ok = (x >= 0) & (x < len(h)) & (y >= 0) & (y < len(self.words))
                    x, y, live = x[ok], y[ok], live[ok]
                    ok = (text[x] == text[p[live]]) & (self.item[y] == self.item[q[live]]) & (h[x] == self.words[y])
                    live = live[ok]
                    a[live], b[live] = x[ok], y[ok]
                ends.append(a)
            good = (h[p] == self.words[q]) & (ends[1] - ends[0] + 1 >= self.n) if len(p) else np.zeros(0, np.bool_)
            found = {(int(a), int(b) + 1, int(i)) for a, b, i in zip(ends[0][good], ends[1][good], self.item[q[good]], strict=True)}
            if found:
                s, e, i = zip(*sorted(found), strict=True)
                yield np.array(s), np.array(e), [[x] for x in i]
        for m, keys in self.shorts.items():
            grams = B.windows(h, m)
            at = np.searchsorted(keys, grams)
            p = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == grams)
            p = p[text[p] == text[p + m - 1]] if len(p) else p
            if len(p):
                yield p, p + m, [list(self.short[m][int(g)]) for g in grams[p]]

    def rows(self, texts: pa.Array) -> Iterator[tuple[int, int, set, list]]:
        """(words, hit words, items, hit runs) of each text."""
        for _, h, first in word_hashes(texts):
            hit = np.zeros(len(h) + 1, np.int32)
            items: dict[int, set] = {}
            for s, e, ids in self.occurrences(h, first):
                np.add.at(hit, s, 1)
                np.add.at(hit, e, -1)
                for t, i in zip(np.searchsorted(first, s, "right") - 1, ids, strict=True):
                    items.setdefault(int(t), set()).update(i)
            flag = np.cumsum(hit)[:-1] > 0
            for t in range(len(first) - 1):
                n = int(first[t + 1] - first[t])
                if t not in items:
                    yield n, 0, (), ()
                    continue
                f = np.concatenate([[False], flag[first[t] : first[t + 1]], [False]]).astype(np.int8)
                runs = np.flatnonzero(np.diff(f)).reshape(-1, 2)
                yield n, int(f.sum()), items[t], runs.tolist()


_indexes: dict[str, Index] = {}


def _index(token: str, ids: list[int], texts: list[str], n: int, k: int) -> Index:
    """The index of one call of decontaminate, built once in each worker process."""
    if token not in _indexes:
        _indexes.clear()
        _indexes[token] = Index(ids, texts, n, k)
    return _indexes[token]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 10, k: int = 5, broadcast_bytes: int = 32 << 20, keep: list[str] = ()) -> DataFrame:
    """Words of each document that lie inside an occurrence of `n` successive words of a benchmark item.

    An item of fewer words, but not none, is one window. Returns a row per document row: doc_id (as it is), n_words,
    n_hit, item_ids (sorted), spans (hit runs as word numbers); columns in `keep` go along, `text` under its name and any
    other `c` as `_c`. The benchmark's size is measured: up to `broadcast_bytes` its index goes to every worker and
    documents are not shuffled; beyond, fingerprints and windows meet by shuffle. Both ways give the same rows: each row's
    result depends on its text alone, so null and repeated ids are kept.
    Null and empty texts have no words; item ids are integers (else Spark's cast fails), items with a null id are left
    out; equal items all count; an empty benchmark hits nothing; an empty table gives no rows.
    """
    names = [c for c in keep if c not in ("doc_id", "text")]
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *[F.col(c).alias(f"_{c}") for c in names])
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    more = [*(["text"] if "text" in keep else []), *[f"_{c}" for c in names]]
    if size > broadcast_bytes:
        return _by_shuffle(d, items, n, k, more)
    rows = items.collect()
    held, token = d.sparkSession.sparkContext.broadcast(([r.item_id for r in rows], [r.text for r in rows])), uuid.uuid4().hex

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(token, *held.value, n, k)
        for b in batches:
            names = b.schema.names
            found = _columns(index.rows(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), *found, *[b.column(names.index(c)) for c in more]], ["doc_id", *[f.name for f in FOUND], *more])

    return d.mapInArrow(B.tidy(mark), T.StructType([d.schema["doc_id"], *FOUND, *[d.schema[c] for c in more]]))


def _columns(rows: Iterator[tuple]) -> list[pa.Array]:
    rows = list(rows)
    spans = [[{"start": a, "end": e} for a, e in r[3]] for r in rows]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([sorted(r[2]) for r in rows], pa.list_(pa.int64())), pa.array(spans, kind)]


def _item_hashes(batches: Iterator[pa.RecordBatch], n: int, k: int) -> Iterator[pa.RecordBatch]:
    """Of each item its windows (m words, hash w) and, with m = 0, its fingerprints."""
    for b in batches:
        for row, h, first in word_hashes(b.column(1)):
            for i in range(len(first) - 1):
                w = h[first[i] : first[i + 1]]
                m = min(n, len(w))
                found = [(m, B.windows(w, m))] if m else []
                if m == n:
                    g = B.windows(w, k)
                    found.append((0, g[winnow(g, n - k + 1)]))
                for m, w in found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), b.column(0)[row + i].as_py(), np.int64)), pa.array(np.full(len(w), m, np.int32)), pa.array(w.view(np.int64))], ["item_id", "m", "w"])


def _candidates(batches: Iterator[pa.RecordBatch], table: np.ndarray, lengths: list[int], n: int, k: int) -> Iterator[pa.RecordBatch]:
    """Of each text: windows of n words around fingerprints that may be the benchmark's, and windows as long as short items."""

    def may(h: np.ndarray) -> np.ndarray:
        slot = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
        return (table[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1

    for b in batches:
        for row, h, first in word_hashes(b.column(1)):
            text = np.repeat(np.arange(len(first) - 1), np.diff(first))
            for m in (n, *lengths):
                if len(h) < m:
                    continue
                w = B.windows(h, m)
                at = np.ones(len(w), np.bool_)
                if m == n:
                    g = B.windows(h, k)
                    p = np.flatnonzero(winnow(g, n - k + 1) & may(g) & (text[: len(g)] == text[k - 1 :]))
                    around = (p[:, None] - np.arange(n - k + 1)[None, :]).reshape(-1)
                    at = np.zeros(len(w), np.bool_)
                    at[around[(around >= 0) & (around < len(w))]] = True
                p = np.flatnonzero(at & (text[: len(w)] == text[m - 1 :]))
                p = p[may(w[p])]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row + text[p])), pa.array(np.full(len(p), m, np.int32)), pa.array((p - first[text[p]]).astype(np.int32)), pa.array(w[p].view(np.int64))], ["key", "m", "start", "w"])


def _join_hot(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """left(key, m, w, ...) joined with right(m, w, ...): rows of values w that are common on the left are spread over several copies of the right rows."""
    counts = left.groupBy("w").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    per = max(10_000, -(-total // HOT_SHARE))
    hot = F.broadcast(counts.where(F.col("n") > per).select("w", F.ceil(F.col("n") / per).cast("int").alias("parts")))  # at most HOT_SHARE values
    parts = F.coalesce("parts", F.lit(1))
    left = left.join(hot, "w", "left").withColumn("part", F.pmod(F.xxhash64("key"), parts).cast("int")).drop("parts")
    right = right.join(hot, "w", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return left.join(right, ["m", "w", "part"], how).drop("part")


def _by_shuffle(d: DataFrame, items: DataFrame, n: int, k: int, more: list[str]) -> DataFrame:
    """The rows of decontaminate for a benchmark of any size.

    A fixed-size bit table of the benchmark's fingerprints and windows is broadcast; a document fingerprint that it may
    hold is extended to the windows of n words around it, and those meet the benchmark's windows in a join that emits one
    row per place, however many items share it. Texts are known by their SHA-256 and never move.
    """
    folder = shared_dir(d.sparkSession)
    theirs = stored(items.mapInArrow(lambda it: _item_hashes(it, n, k), "item_id long, m int, w long").distinct(), folder, "items")
    lengths = sorted(r[0] for r in theirs.where(f"m between 1 and {n - 1}").select("m").distinct().collect())  # at most n - 1 values
    slot = F.shiftrightunsigned("w", 64 - FILTER_BITS)
    words = theirs.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("i")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")).toArrow()
    table = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    table[words["i"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    held = d.sparkSession.sparkContext.broadcast(table)
    key = F.unhex(F.sha2("text", 256))
    ours = d.select(key.alias("key"), "text").where("text is not null").mapInArrow(lambda it: _candidates(it, held.value, lengths, n, k), "key binary, m int, start int, w long")
    ours = stored(ours.distinct(), folder, "candidates")
    windows = theirs.where("m > 0")
    hits = stored(_join_hot(ours, windows.select("m", "w").distinct(), "left_semi"), folder, "hits")
    reach = hits.groupBy("key", "start").agg(F.max(F.col("start") + F.col("m")).alias("end"))
    order = Window.partitionBy("key").orderBy("start")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = reach.withColumn("opens", (before.isNull() | (F.col("start") > before)).cast("int")).withColumn("run", F.sum("opens").over(order))
    runs = runs.groupBy("key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = runs.groupBy("key").agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    named = _join_hot(hits.select("key", "m", "w").distinct(), windows, "inner").groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    copies = 16  # rows with equal texts are dealt over so many tasks
    found = spans.join(named, "key").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
    out = d.select("doc_id", key.alias("key"), words.alias("n_words"), *more, F.pmod(F.monotonically_increasing_id(), F.lit(copies)).cast("int").alias("part")).join(found, ["key", "part"], "left")
    none = {f.name: F.expr(f"cast(array() as {f.dataType.simpleString()})") for f in FOUND[2:]} | {"n_hit": F.lit(0)}
    return out.select("doc_id", "n_words", *[F.coalesce(c, none[c]).alias(c) for c in ("n_hit", "item_ids", "spans")], *more)
