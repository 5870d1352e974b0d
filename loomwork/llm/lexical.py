"""Ranked lexical search by per-term geometric blocking: exact top-k over all documents.

1. One pass over the texts leaves the forward table: each document's length and its counts of the terms that the items ask
   for. Everything after reads that table alone.
2. Document counts of the terms come from it by an aggregation, and with them the weights. Documents get a geometric code:
   the nearest of some pivots in a random projection of their term weights, then the signs of the projection.
3. The table is dealt by ranges of the code (and of the row, so equal codes spread), and each task cuts its range into
   segments of like documents. In a segment every posting list that an item needs is clustered into blocks of documents
   next to each other by code, and a block's summary is the coordinatewise maximum of its documents' scores.
4. An item walks its lists from the term of the highest possible score to the lowest. A document counts at the first of the
   item's lists that has it, so a block can give no more than the sum of its summary over the terms from this list on. It
   is skipped only if that sum is below the score that the item's k-th result reaches for certain; else its documents are
   scored exactly. Ties of the bound are never skipped.
5. That certain score is at first the k-th best among documents that stand out in single terms, one of each segment a term, found in one cheap pass,
   and rises with what the task itself finds.

Items are worked in blocks of at most about `max_terms` different terms, so what is sent to tasks is bounded whatever the
number of items; each block reads the texts once. Only the pivots are fitted to a sample (`fit_docs` documents); they
decide which documents share a block, never a result.

Defined cases: null, empty and termless texts count for nothing and are no one's result; items without terms have no rows;
rows of one item_id are one item; rows that repeat a doc_id are documents of their own, ranked one after the other; a null
doc_id comes last among equal scores; empty tables give no rows.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import sampled, shared_dir, stored

#: Separators become blanks and A-Z small letters; all other bytes stay, so a run of letters, digits and bytes of other scripts is a term.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
DIMS, BLOCK, CELLS = 32, 32, 12_000_000


def terms(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


@dataclass
class Queries:
    """A block of items over numbered terms: per item the terms, all terms ranked by their highest possible score."""

    items: list  # item ids
    of: list[np.ndarray]  # term numbers of each item, those of the highest score first
    needed: list[int]  # how many of them can still lead to a result


# -- forward table ---------------------------------------------------------------------------------------------------


def forward(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, tfs): length, and numbers and counts of the vocabulary's terms; documents without any term of their own are left out."""
    kind, known = docs.schema["doc_id"].dataType.simpleString(), {t: i for i, t in enumerate(vocabulary)}
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shared.value
        for b in batches:
            keep, n, ts, fs = [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                words = terms(text)
                if words:
                    hits = sorted((numbers[w], c) for w, c in Counter(words).items() if w in numbers)
                    keep.append(i)
                    n.append(len(words))
                    ts.append([t for t, _ in hits])
                    fs.append([c for _, c in hits])
            ids = b.column(0).take(pa.array(keep, pa.int64()))
            lists = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(ts, lists), pa.array(fs, lists)], names=["doc_id", "n", "terms", "tfs"])

    return docs.select("doc_id", "text").mapInArrow(read, f"doc_id {kind}, n long, terms array<int>, tfs array<int>")


def _flat(b: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    a = b.column(column)
    offsets = a.offsets.to_numpy()
    return a.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64), offsets - offsets[0]


def impacts(b: pa.RecordBatch, weights: np.ndarray, n_docs: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, score) of every posting of a batch, in whole numbers."""
    ts, at = _flat(b, "terms")
    fs, _ = _flat(b, "tfs")
    n = b.column("n").to_numpy().astype(object)
    m = np.array([10 + 90 * x * n_docs // n_terms for x in n], np.int64)  # Python's numbers: the product may pass 64 bits
    doc = np.repeat(np.arange(len(n)), np.diff(at))
    return doc, ts, weights[ts] * (1_000_000_000 * fs // (1000 * fs + 8 * m[doc]))


# -- geometric codes -------------------------------------------------------------------------------------------------


def _directions(size: int) -> np.ndarray:
    return np.random.default_rng(11).standard_normal((size, DIMS)).astype(np.float32)


def places(doc: np.ndarray, term: np.ndarray, score: np.ndarray, n: int, directions: np.ndarray) -> np.ndarray:
    """A unit vector per document: the sum of its terms' directions by score."""
    out = np.zeros((n, DIMS), np.float32)
    step = 1 << 18
    for at in range(0, len(doc), step):
        d = doc[at : at + step]
        first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        out[d[first]] += np.add.reduceat(directions[term[at : at + step]] * score[at : at + step, None].astype(np.float32), first)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def pivots(points: np.ndarray, number: int = 64, rounds: int = 8) -> np.ndarray:
    """Centres of spherical k-means; no points give one centre at zero."""
    if not len(points):
        return np.zeros((1, DIMS), np.float32)
    pick = np.random.default_rng(12).choice(len(points), min(number, len(points)), replace=False)
    centres = points[np.sort(pick)]
    for _ in range(rounds):
        near = (points @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-9), centres)
    return centres


def codes(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Nearest pivot, then the signs of the place relative to it: neighbours in code are neighbours in place."""
    near = (points @ centres.T).argmax(1)
    signs = (points - centres[near]) > 0
    return near.astype(np.int64) << DIMS | (signs.astype(np.int64) << np.arange(DIMS)[::-1]).sum(1)


# -- blocks and search -----------------------------------------------------------------------------------------------


class Best:
    """The k best (score, doc_id with nulls last, row) of each item among what a task has scored."""

    def __init__(self, certain: np.ndarray, k: int):
        self.k, self.certain, self.got = k, certain.copy(), [[] for _ in certain]

    def offer(self, item: int, scores: np.ndarray, ids: list, rows: np.ndarray) -> None:
        for i in np.flatnonzero(scores >= self.certain[item]):
            self.got[item].append((-int(scores[i]), ids[i] is None, ids[i], int(rows[i])))
        if len(self.got[item]) > self.k:
            self.got[item] = sorted(self.got[item], key=lambda x: (x[0], x[1], 0 if x[1] else x[2], x[3]))[: self.k]
            self.certain[item] = max(self.certain[item], -self.got[item][-1][0])


def search_segment(dense: np.ndarray, ids: list, rows: np.ndarray, queries: Queries, best: Best, partners: dict[int, np.ndarray]) -> tuple[int, int]:
    """Searches documents that lie next to each other (a row of scores each). Returns the blocks met and those skipped.

    partners: for each list that an item needs, the terms that its summaries have to cover.
    """
    held = dense > 0
    blocks: dict[int, tuple[list[np.ndarray], np.ndarray]] = {}
    met = skipped = 0
    for q, its in enumerate(queries.of):
        done = np.zeros(len(dense), bool)
        for j in range(queries.needed[q]):
            t = int(its[j])
            if t not in blocks:
                members = np.flatnonzero(held[:, t])
                cut = [members[i : i + BLOCK] for i in range(0, len(members), BLOCK)]
                cols = partners[t]
                tops = np.maximum.reduceat(dense[np.ix_(members, cols)], np.arange(0, len(members), BLOCK), axis=0) if cut else np.zeros((0, len(cols)), np.int64)
                blocks[t] = cut, tops
            cut, tops = blocks[t]
            if not cut:
                continue
            bound = tops[:, np.searchsorted(partners[t], np.sort(its[j:]))].sum(1)
            met += len(cut)
            keep = np.flatnonzero(bound >= best.certain[q])
            skipped += len(cut) - len(keep)
            if len(keep):
                found = np.concatenate([cut[i] for i in keep])
                found = found[~done[found]]
                done[found] = True
                best.offer(q, dense[np.ix_(found, its)].sum(1), [ids[i] for i in found], rows[found])
    return met, skipped


def _dense(doc, term, score, first: int, last: int, width: int) -> np.ndarray:
    a, e = np.searchsorted(doc, [first, last])
    out = np.zeros((last - first, width), np.int64)
    out[doc[a:e] - first, term[a:e]] = score[a:e]
    return out


def _segments(batches: Iterator[pa.RecordBatch], weights: np.ndarray, n_docs: int, n_terms: int) -> Iterator[tuple[np.ndarray, list, np.ndarray]]:
    size = max(16, CELLS // max(1, len(weights)))
    for b in batches:
        doc, term, score = impacts(b, weights, n_docs, n_terms)
        ids, rows = b.column("doc_id").to_pylist(), b.column("row").to_numpy()
        for at in range(0, b.num_rows, size):
            to = min(at + size, b.num_rows)
            yield _dense(doc, term, score, at, to, len(weights)), ids[at:to], rows[at:to]


def partners_of(queries: Queries) -> dict[int, np.ndarray]:
    out: dict[int, set] = {}
    for its, needed in zip(queries.of, queries.needed, strict=True):
        for j in range(needed):
            out.setdefault(int(its[j]), set()).update(int(t) for t in its[j:])
    return {t: np.array(sorted(s)) for t, s in out.items()}


# -- the job ---------------------------------------------------------------------------------------------------------


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, max_terms: int = 16384, fit_docs: int = 4000) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k highest-scoring documents with a score above 0."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    kind = items.schema["item_id"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [sorted(set(terms(t))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.binary()))], names=["item_id", "terms"])

    pairs = items.select("item_id", "text").mapInArrow(split, f"item_id {kind}, terms array<binary>").select("item_id", F.explode("terms").alias("term")).distinct()
    pairs = stored(pairs, folder, "item-terms")
    parts = -(-pairs.count() // max_terms)
    out = None
    for i in range(parts):
        mine = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == i) if parts > 1 else pairs
        found = _ranked_block(spark, folder, docs, mine.collect(), k, fit_docs, kind)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")
    return out


def _ranked_block(spark: SparkSession, folder: str, docs: DataFrame, pairs: list, k: int, fit_docs: int, kind: str) -> DataFrame:
    vocabulary = sorted({bytes(r.term) for r in pairs})
    number = {t: i for i, t in enumerate(vocabulary)}
    table = stored(forward(docs, vocabulary).withColumn("row", F.monotonically_increasing_id()), folder, "forward")
    n_docs, n_terms = (x or 0 for x in table.agg(F.count("*"), F.sum("n")).first())
    # one row per term of this block, which is bounded
    df = np.zeros(len(vocabulary), np.int64)
    weigh = F.floor(F.lit(1000) * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    weights = np.zeros(len(vocabulary), np.int64)
    for r in table.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).select("t", "df", weigh.alias("w")).toLocalIterator():
        df[r.t], weights[r.t] = r.df, r.w
    with_row = table.withColumn("code", F.lit(0).cast("long"))
    sample = table.where(sampled(F.xxhash64("row"), fit_docs, n_docs)).select("doc_id", "n", "terms", "tfs").toArrow().combine_chunks().to_batches()
    directions = _directions(len(vocabulary))
    centres = pivots(np.concatenate([places(*impacts(b, weights, n_docs, n_terms), b.num_rows, directions) for b in sample]) if sample else np.zeros((0, DIMS), np.float32))
    tops = _tops(table, weights, n_docs, n_terms)
    of: dict = {}
    for r in pairs:
        of.setdefault(r.item_id, []).append(number[bytes(r.term)])
    # a term that no document holds scores nothing
    its = [np.array(sorted((t for t in ts if tops[t] > 0), key=lambda t: (-tops[t], t)), np.int64) for ts in of.values()]
    queries = Queries(list(of), its, [len(x) for x in its])
    certain = _certain(table, queries, weights, n_docs, n_terms, k)
    for q, x in enumerate(queries.of):
        rest = np.cumsum(tops[x][::-1])[::-1]
        queries.needed[q] = int((rest >= certain[q]).sum())
    shared = spark.sparkContext.broadcast((queries, weights, certain, centres))
    coded = with_row.mapInArrow(lambda bs: _code(bs, shared.value[1], n_docs, n_terms, shared.value[3]), with_row.schema)
    parts = max(spark.sparkContext.defaultParallelism, min(100_000, n_docs // 16384))
    dealt = stored(coded, folder, "coded").repartitionByRange(parts, "code", "row").sortWithinPartitions("code", "row")
    doc_kind = docs.schema["doc_id"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, certain, _ = shared.value
        best, partners = Best(certain, k), partners_of(queries)
        for dense, ids, rows in _segments(batches, weights, n_docs, n_terms):
            search_segment(dense, ids, rows, queries, best, partners)
        found = [(q, x[2], x[3], -x[0]) for q, got in enumerate(best.got) for x in got]
        cols = [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], ids_type), pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["q", "doc_id", "row", "score"])

    ids_type = table.limit(0).select("doc_id").toArrow().schema.field(0).type
    found = dealt.mapInArrow(search, f"q int, doc_id {doc_kind}, row long, score long")
    names = spark.createDataFrame(list(enumerate(queries.items)), f"q int, item_id {kind}")
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return stored(top.join(names, "q").select("item_id", "rank", "doc_id", "score"), folder, f"ranked-{uuid.uuid4().hex[:4]}")


def _code(batches, weights, n_docs, n_terms, centres):
    directions = _directions(len(weights))
    for b in batches:
        at = places(*impacts(b, weights, n_docs, n_terms), b.num_rows, directions)
        yield b.set_column(b.schema.get_field_index("code"), "code", pa.array(codes(at, centres), pa.int64()))


def _tops(table: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The highest score of each term, over all documents."""

    def most(batches):
        out = np.zeros(len(weights), np.int64)
        for b in batches:
            _, term, score = impacts(b, weights, n_docs, n_terms)
            np.maximum.at(out, term, score)
        t = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(out[t])], names=["t", "top"])

    tops = np.zeros(len(weights), np.int64)
    for r in table.select("n", "terms", "tfs").mapInArrow(most, "t int, top long").groupBy("t").agg(F.max("top").alias("top")).toLocalIterator():
        tops[r.t] = r.top
    return tops


def _certain(table: DataFrame, queries: Queries, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> np.ndarray:
    """A score that k documents reach for each item (1 where there are fewer): the k-th best of those that stand out in one term."""

    def stand_out(batches):
        best = [np.zeros(0, np.int64) for _ in queries.of]
        for dense, _, _ in _segments(batches, weights, n_docs, n_terms):
            top = dense.argmax(0)
            for q, its in enumerate(queries.of):
                if len(its):
                    docs = np.unique(top[its])
                    best[q] = np.sort(np.r_[best[q], dense[np.ix_(docs, its)].sum(1)])[-k:]
        q = np.repeat(np.arange(len(best), dtype=np.int32), [len(x) for x in best])
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.concatenate([np.zeros(0, np.int64), *best]))], names=["q", "score"])

    found = table.select("doc_id", "row", "n", "terms", "tfs").mapInArrow(stand_out, "q int, score long")
    order = Window.partitionBy("q").orderBy(F.col("score").desc())
    found = found.withColumn("nth", F.row_number().over(order)).where((F.col("nth") == k) & (F.col("score") > 0))
    certain = np.ones(len(queries.of), np.int64)
    for r in found.toLocalIterator():
        certain[r.q] = r.score
    return certain
