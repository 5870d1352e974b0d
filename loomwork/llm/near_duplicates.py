"""Jaccard join on word shingles with Bayesian candidate pruning (after Satuluri and Parthasarathy's BayesLSH, 2012).

1. Every text becomes its set of hashed word shingles and a MinHash signature; texts with equal sets are one class.
2. Class representatives that agree in a band of the signature meet in a bucket. Within a bucket, MinHash values are
   compared a few at a time, and a pair is dropped as soon as the posterior probability that it reaches the threshold
   is below the tolerance. What survives is kept as a spanning forest, never as all pairs.
3. Components of these forests are verified: shingle sets meet in blocks, pass the same pruning, and the rest is
   compared exactly. Each representative gets its number of links; links are joined to final classes.

Buckets and components of any size are cut into blocks that meet in pairs, so no task holds an unbounded group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytes_np as B
from .shared import connected_components, shared_dir, stored

HASHES, BAND = 128, 4
STEP = 16
_rng = np.random.default_rng(20)
MULTIPLY = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
BLOCK_BUCKET, BLOCK_VERIFY = 1024, 256


def shingles(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: lower-cased runs of letters, digits and non-ASCII characters; 1 to n - 1 words are one shingle, none gives none."""
    import pyarrow.compute as pc

    for at in range(0, len(texts), 256):  # a few rows at a time: a lower-cased copy of a whole batch would stay in the worker
        for _, data, offsets in B.text_slices(pc.utf8_lower(texts.slice(at, 256))):
            a, e, first = B.spans(data, offsets, B.WORD)
            h = B.hashes(data, a, e)
            for i in range(len(first) - 1):
                w = h[first[i] : first[i + 1]]
                yield np.unique(B.windows(w, min(n, len(w)))) if len(w) else w


def signature(s: np.ndarray) -> np.ndarray:
    """The least of each hash function over the set (32 bits; their lower 16 are compared, which can only add matches)."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        part = MULTIPLY[:, None] * x[None, at : at + 2048]
        part += ADD[:, None]
        np.minimum(out, part.min(1), out=out)
    return out


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For n = STEP, 2 STEP, ...: the fewest matches among n values at which the posterior of similarity >= threshold (uniform prior) is at least the tolerance."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        below, m = 0.0, 0
        while m <= n:
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def candidates(x: np.ndarray, y: np.ndarray, least: list[int], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of x, row of y) that no comparison dropped; with `same`, only i < j."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if not len(y):
        return left[0], right[0]
    rows = max(1, (1 << 22) // (len(y) * STEP))
    for at in range(0, len(x), rows):
        part = x[at : at + rows]
        m = (part[:, None, :STEP] == y[None, :, :STEP]).sum(2, dtype=np.int16)
        i, j = np.nonzero(m >= least[0])
        m = m[i, j]
        if same:
            ok = at + i < j
            i, j, m = i[ok], j[ok], m[ok]
        for k in range(1, HASHES // STEP):
            if not len(i):
                break
            cols = slice(k * STEP, (k + 1) * STEP)
            m = m + (part[i, cols] == y[j, cols]).sum(1, dtype=np.int16)
            ok = m >= least[k]
            i, j, m = i[ok], j[ok], m[ok]
        left.append(at + i)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of the component of each of n nodes."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _sign(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, sigs = [], []
        for s in shingles(b.column(1), n):
            keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sigs.append(signature(s).astype(np.uint16).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "set_key", "sig"])


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(-1, HASHES)


def _sides(g: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of the lower and of the upper block of a group, and whether they are the same."""
    blk, lo, hi = (g.column(g.schema.get_field_index(c)).to_numpy() for c in ("blk", "lo", "hi"))
    return np.flatnonzero(blk == lo[0]), np.flatnonzero(blk == hi[0]), lo[0] == hi[0]


def _prune(batches: Iterator[pa.RecordBatch], least: list[int]) -> Iterator[pa.RecordBatch]:
    """Per bucket and pair of blocks: each surviving representative with the least one of its component there."""
    out_a, out_b = [], []
    for g in B.groups(batches, ["bucket", "lo", "hi"]):
        rep, sig = g.column(g.schema.get_field_index("rep")).to_numpy(), _matrix(g.column(g.schema.get_field_index("sig")))
        x, y, same = _sides(g)
        i, j = candidates(sig[x], sig[y], least, same)
        i, j = x[i], y[j]
        r = roots(len(rep), i, j)
        use = np.flatnonzero(r != np.arange(len(rep)))
        out_a.append(rep[use])
        out_b.append(rep[r[use]])
        if sum(map(len, out_a)) > 100_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])
            out_a, out_b = [], []
    if out_a:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])


def _reshingle(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            sets = pa.array([s.tobytes() for s in shingles(part.column(part.schema.get_field_index("text")), n)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in ("component", "rep", "copies", "sig")] + [sets], ["component", "rep", "copies", "sig", "shingles"])


def _verify(batches: Iterator[pa.RecordBatch], threshold: float, least: list[int]) -> Iterator[pa.RecordBatch]:
    """Per component and pair of blocks: each representative's links (copies counted) and the least representative it is joined to there."""
    for g in B.groups(batches, ["component", "lo", "hi"]):
        rep, copies = (g.column(g.schema.get_field_index(c)).to_numpy() for c in ("rep", "copies"))
        x, y, same = _sides(g)
        sig = _matrix(g.column(g.schema.get_field_index("sig")))
        i, j = candidates(sig[x], sig[y], least, same)
        i, j = x[i], y[j]
        sets = [np.frombuffer(s, np.uint64) for s in g.column(g.schema.get_field_index("shingles")).to_pylist()]
        size = np.array([len(s) for s in sets])
        near = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
        i, j = i[near], j[near]
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        number, flat = np.unique(np.concatenate(sets), return_inverse=True)
        start = np.concatenate([[0], np.cumsum(size)])
        here = np.zeros(len(number), np.bool_)
        good = np.zeros(len(i), np.bool_)
        cuts = np.flatnonzero(np.diff(i)) + 1
        for part in np.split(np.arange(len(i)), cuts) if len(i) else []:
            own = flat[start[i[part[0]]] : start[i[part[0]] + 1]]
            here[own] = True
            for at in range(0, len(part), 64):
                p = part[at : at + 64]
                theirs = np.concatenate([flat[start[k] : start[k + 1]] for k in j[p]])
                both = np.add.reduceat(here[theirs].astype(np.int64), np.concatenate([[0], np.cumsum(size[j[p]])[:-1]]))
                good[p] = both >= threshold * (len(own) + size[j[p]] - both) - 1e-9
            here[own] = False
        i, j = i[good], j[good]
        links = np.zeros(len(rep), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        r = roots(len(rep), i, j)
        use = np.flatnonzero(links > 0)
        yield pa.RecordBatch.from_arrays([pa.array(rep[use]), pa.array(links[use]), pa.array(rep[r[use]])], ["rep", "links", "root"])


def _blocks(members: DataFrame, key: str, most: int) -> DataFrame:
    """members(key, rep, size, ...) with (blk, lo, hi): each member once for every pair of blocks that its own block is in."""
    n = F.ceil(F.col("size") / most).cast("int")
    blk = F.pmod(F.xxhash64("rep", F.lit(7)), n).cast("int")
    out = members.withColumn("blk", blk).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return out.withColumn("lo", F.least("blk", "other")).withColumn("hi", F.greatest("blk", "other")).drop("other", "size").repartition(F.col(key), F.col("lo"), F.col("hi")).sortWithinPartitions(key, "lo", "hi", "rep")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Classes of documents whose sets of `n`-word shingles have a Jaccard similarity of `threshold` or more, joined transitively.

    Returns a row per row: doc_id, class_id (least doc_id of the class), n_links (other rows that reach the threshold with
    it, equal texts included). A pair at 0.8 escapes all 32 bands of 4 with a probability of 5e-8 and the pruning with
    about `tolerance`; every link returned is verified on the full sets. For the options see `_classes`.
    Null, empty and wordless texts are classes of their own without links; texts of fewer than n words are one shingle.
    Rows with a null id, or that repeat an id, are rows like any other, each compared by its own text; a null id is no
    least one, and a class of such rows alone has a null class_id. Such tables are written once more, with a key a row.
    """
    folder = shared_dir(docs.sparkSession)
    keyed, own = _keyed(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), folder)
    found = _classes(keyed, folder, **options)
    if own:
        return found.select(F.col("key").alias("doc_id"), F.col("class_key").alias("class_id"), "n_links")
    rows = stored(found.join(keyed.select("key", "doc_id"), "key"), folder, "rows")
    least = rows.groupBy("class_key").agg(F.min("doc_id").alias("class_id"))
    return rows.join(least, "class_key").select("doc_id", "class_id", "n_links")


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs, of each class of near duplicates one: that with the least doc_id, null ids last."""
    folder = shared_dir(docs.sparkSession)
    keyed, own = _keyed(docs.select("*", F.col(doc_id).cast("long").alias("_near_id"), F.col(text).alias("_near_text")), folder, "_near_id", "_near_key")
    found = _classes(keyed.select(F.col("_near_key").alias("key"), F.col("_near_text").alias("text")), folder, **options)
    if own:
        gone = found.where("class_key <> key")
    else:
        rows = stored(found.join(keyed.select(F.col("_near_key").alias("key"), F.col("_near_id").alias("id")), "key"), folder, "rows")
        first = rows.groupBy("class_key").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key")).alias("first")).select("class_key", F.col("first.key").alias("first"))
        gone = rows.join(first, "class_key").where("key <> first")
    return keyed.join(gone.select(F.col("key").alias("_near_key")), "_near_key", "left_anti").select(docs.columns)


def _keyed(docs: DataFrame, folder: str, doc_id: str = "doc_id", key: str = "key") -> tuple[DataFrame, bool]:
    """docs with a different long for each row: the id where all are there and differ, else a number, in a table written for it."""
    plain = docs.groupBy(doc_id).count().where(f"{doc_id} is null or count > 1").limit(1).isEmpty()
    return (docs.withColumn(key, F.col(doc_id)), True) if plain else (stored(docs.withColumn(key, F.monotonically_increasing_id()), folder, "keyed"), False)


def _classes(docs: DataFrame, folder: str, *, n: int = 5, threshold: float = 0.8, tolerance: float = 1e-6, broadcast_ids: int = 500_000) -> DataFrame:
    """(key, class_key, n_links) of docs(key, text); a class goes by its least key."""
    d = docs.select(F.col("key").alias("doc_id"), "text")
    least = least_matches(threshold, tolerance)
    signed = stored(d.mapInArrow(B.tidy(lambda it: _sign(it, n)), "doc_id long, set_key binary, sig binary"), folder, "signed")
    # equal sets: one representative with its number of copies
    sets = stored(signed.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), folder, "sets")
    reps = stored(signed.withColumnRenamed("doc_id", "rep").join(sets.select("rep", "copies"), "rep").select("rep", "copies", "sig"), folder, "reps")
    # buckets of two or more; of those with the same members one is enough
    band = F.expr(f"transform(sequence(0, {HASHES // BAND - 1}), i -> xxhash64(i, substring(sig, i * {2 * BAND} + 1, {2 * BAND})))")
    bucket = reps.select(F.explode(band).alias("bucket"), "rep")
    members = bucket.groupBy("bucket").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("rep")).alias("s1"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("s2")).where("size > 1")
    chosen = stored(members.groupBy("size", "s1", "s2").agg(F.min("bucket").alias("bucket")).select("bucket", "size"), folder, "buckets")
    met = bucket.join(chosen, "bucket").join(reps.select("rep", "sig"), "rep")
    pruned = _blocks(met, "bucket", BLOCK_BUCKET).select("bucket", "rep", "sig", "blk", "lo", "hi").mapInArrow(B.tidy(lambda it: _prune(it, least)), "a long, b long")
    found = stored(connected_components(pruned, folder), folder, "candidates")
    # exact comparison within the components
    size = found.groupBy("component").agg(F.count("*").alias("size"))
    ids = found.select(F.col("node").alias("doc_id"), "component")
    ids = F.broadcast(ids) if ids.count() <= broadcast_ids else ids
    texts = d.join(ids, "doc_id").withColumnRenamed("doc_id", "rep").join(reps, "rep")
    full = texts.select("component", "rep", "copies", "sig", "text").mapInArrow(B.tidy(lambda it: _reshingle(it, n)), "component long, rep long, copies long, sig binary, shingles binary").join(size, "component")
    columns = ["component", "rep", "copies", "sig", "shingles", "blk", "lo", "hi"]
    links = stored(_blocks(full, "component", BLOCK_VERIFY).select(columns).mapInArrow(B.tidy(lambda it: _verify(it, threshold, least)), "rep long, links long, root long"), folder, "links")
    final = connected_components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")), folder)
    per_rep = links.groupBy("rep").agg(F.sum("links").alias("links")).join(final.withColumnRenamed("node", "rep"), "rep", "left")
    per_set = sets.join(per_rep, "rep", "left").select("set_key", F.coalesce("component", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rows = signed.select("doc_id", "set_key").join(per_set, "set_key", "left")
    return rows.select(F.col("doc_id").alias("key"), F.coalesce("class_id", "doc_id").alias("class_key"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
