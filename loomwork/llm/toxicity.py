"""Toxicity by a convolutional text classifier trained in numpy: hashed word embeddings, filters of several widths, max pooling.

A word's vector is the sum of three rows of one table, found by hashes of the word and of its first 4 and 5 bytes, so
that inflected forms share. Decision thresholds are calibrated for each language on all labelled rows kept out of training;
the language is guessed from the text's words (naive Bayes over the same hashes), never read from a column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytes_np as B
from .shared import sampled

BUCKETS, DIMENSION, FILTERS, WIDTHS, PADS = 1 << 17, 12, 8, (1, 2, 3), 3
HELD_OUT = (5, 0)
#: Words that pass the filters at once.
BLOCK = 1 << 16
#: Scores are grouped in bins of this width of the logit; each keeps its least and largest score.
BIN = 1 / 1024
#: Up to so many labels are broadcast to the texts; beyond, all texts are scored and their scores meet the labels.
BROADCAST_LABELS = 1_000_000
#: So many languages are told apart by their words; more are dealt into so many groups.
MOST_LANGS = 32


def words(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(table rows of each word (n, 3), first word of each text and one more) of runs of texts."""
    for _, data, offsets in B.text_slices(pc.utf8_lower(texts), 1 << 20):
        a, e, first = B.spans(data, offsets, B.WORD)
        rows = [B.hashes(data, a, np.minimum(e, a + n) if n else e) + np.uint64(n) for n in (0, 4, 5)]
        yield np.stack([(B.mix(h) % np.uint64(BUCKETS)) for h in rows], 1).astype(np.uint32), first


@dataclass
class Classifier:
    table: np.ndarray  # (BUCKETS, DIMENSION)
    filters: list[np.ndarray]  # by width: (width * DIMENSION, FILTERS)
    shift: list[np.ndarray]  # by width: (FILTERS,)
    weights: np.ndarray  # (widths * FILTERS,)
    bias: np.ndarray  # (1,)
    langs: list[str] = field(default_factory=list)
    word_logs: np.ndarray | None = None  # (BUCKETS, languages)
    thresholds: np.ndarray | None = None  # logits, by language; the last one where no language is known

    @classmethod
    def new(cls, seed: int = 4) -> Classifier:
        r, f = np.random.default_rng(seed), np.float32
        return cls(r.normal(0, 0.01, (BUCKETS, DIMENSION)).astype(f),  # near 0: words never seen say nothing
             [r.normal(0, (2 / (w * DIMENSION)) ** 0.5, (w * DIMENSION, FILTERS)).astype(f) for w in WIDTHS], [np.zeros(FILTERS, f) for _ in WIDTHS], r.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(f), np.zeros(1, f))

    def parameters(self) -> list[np.ndarray]:
        return [self.table, *self.filters, *self.shift, self.weights, self.bias]

    def _padded(self, rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word vectors with PADS zero rows after each text, where each text starts there, and where each word went."""
        n = np.diff(first)
        at = np.arange(len(rows)) + PADS * np.repeat(np.arange(len(n)), n)
        x = np.zeros((len(rows) + PADS * len(n), DIMENSION), np.float32)
        v = self.table[rows[:, 0]]
        v += self.table[rows[:, 1]]
        v += self.table[rows[:, 2]]
        x[at] = v
        return x, first[:-1] + PADS * np.arange(len(n)), at

    def _pooled(self, x: np.ndarray, starts: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(texts, widths * FILTERS): the largest response over that many places of each text; and the responses."""
        edges = np.stack([starts, starts + places], 1).reshape(-1)
        out, all_ = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.shift, strict=True):
            y = x @ f[:DIMENSION]
            for j in range(1, w):
                y[:-j] += x[j:] @ f[j * DIMENSION : (j + 1) * DIMENSION]
            y += b
            out.append(np.maximum.reduceat(y, edges, 0)[::2])
            all_.append(y)
        return np.concatenate(out, 1), all_

    def logits(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A logit for each text; a long text goes through block by block, with the words that a filter sees beyond its block."""
        if len(first) < 2:
            return np.zeros(0, np.float32)
        n = np.diff(first)
        best = np.empty((len(n), len(self.weights)), np.float32)
        # runs of texts of at most BLOCK words in all, and longer texts alone
        cuts, size = [0], 0
        for i, m in enumerate(n.tolist()):
            if size and size + m > BLOCK:
                cuts.append(i)
                size = 0
            size += m
        for i, j in zip(cuts, [*cuts[1:], len(n)], strict=True):
            part = rows[first[i] : first[j]]
            if j == i + 1 and n[i] > BLOCK:
                best[i] = -np.inf
                for at in range(0, n[i] + 1, BLOCK):
                    piece = part[at : at + BLOCK + PADS]
                    x, starts, _ = self._padded(piece, np.array([0, len(piece)]))
                    best[i] = np.maximum(best[i], self._pooled(x, starts, np.array([min(BLOCK, n[i] + 1 - at)]))[0][0])
            else:
                x, starts, _ = self._padded(part, first[i : j + 1] - first[i])
                best[i:j] = self._pooled(x, starts, n[i:j] + 1)[0]
        return np.maximum(best, 0) @ self.weights + self.bias

    def gradients(self, rows: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, list[np.ndarray]]:
        """Weighted cross-entropy, the table rows that it depends on, and the gradients by these and by the other parameters."""
        n = np.diff(first)
        x, starts, at = self._padded(rows, first)
        best, all_ = self._pooled(x, starts, n + 1)
        hidden = np.maximum(best, 0)
        p = 1 / (1 + np.exp(-np.clip(hidden @ self.weights + self.bias, -30, 30)))
        loss = -float((weight * np.where(y == 1, np.log(p + 1e-9), np.log(1 - p + 1e-9))).sum() / weight.sum())
        d = ((p - y) * weight / weight.sum()).astype(np.float32)
        dw, dbias = hidden.T @ d, np.array([d.sum()], np.float32)
        dh = d[:, None] * self.weights[None, :] * (best > 0)
        dx = np.zeros_like(x)
        df, ds = [], []
        for k, w in enumerate(WIDTHS):
            g = dh[:, k * FILTERS : (k + 1) * FILTERS]
            where = np.stack([starts[i] + all_[k][starts[i] : starts[i] + n[i] + 1].argmax(0) for i in range(len(n))])  # the place of the maximum gets all
            df_k = np.zeros_like(self.filters[k])
            for j in range(w):
                part = x[where + j]  # (texts, FILTERS, DIMENSION)
                df_k[j * DIMENSION : (j + 1) * DIMENSION] = np.einsum("tfd,tf->df", part, g)
                np.add.at(dx, where + j, g[:, :, None] * self.filters[k][j * DIMENSION : (j + 1) * DIMENSION].T[None])
            df.append(df_k)
            ds.append(g.sum(0))
        used = np.flatnonzero(np.abs(dx[at]).sum(1))
        touched, place = np.unique(rows[used], return_inverse=True)
        dt = np.zeros((len(touched), DIMENSION), np.float32)
        np.add.at(dt, place.reshape(-1), np.repeat(dx[at[used]], rows.shape[1], 0))
        return loss, touched, [dt, *df, *ds, dw, dbias]

    def fit(self, texts: list[np.ndarray], y: np.ndarray, passes: int, size: int = 64, rate: float = 0.01, seed: int = 5) -> None:
        """Adam over shuffled texts; the two labels count the same in all."""
        r = np.random.default_rng(seed)
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        first, second = [np.zeros_like(p) for p in self.parameters()], [np.zeros_like(p) for p in self.parameters()]
        steps, k = passes * -(-len(texts) // size), 0
        for _ in range(passes):
            order = r.permutation(len(texts))
            for at in range(0, len(order), size):
                i = order[at : at + size]
                rows = np.concatenate([texts[j] for j in i])
                starts = np.concatenate([[0], np.cumsum([len(texts[j]) for j in i])])
                _, touched, grads = self.gradients(rows, starts, y[i], weight[i])
                k += 1
                for j, (p, g, m, v) in enumerate(zip(self.parameters(), grads, first, second, strict=True)):
                    part = touched if j == 0 else slice(None)
                    m[part] += 0.1 * (g - m[part])
                    v[part] += 0.01 * (g * g - v[part])
                    p[part] -= (rate * (1 - 0.9 * k / steps) * (m[part] / (1 - 0.9**k)) / (np.sqrt(v[part] / (1 - 0.99**k)) + 1e-7)).astype(np.float32)

    def guess(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The language number of each text by its words; the last threshold's number for a text without words."""
        n = np.diff(first)
        out = np.full(len(n), len(self.langs))
        if self.langs and len(rows):
            total = np.zeros((len(rows) + 1, len(self.langs)))
            np.cumsum(self.word_logs[rows[:, 0]], 0, out=total[1:])
            out = np.where(n > 0, (total[first[1:]] - total[first[:-1]]).argmax(1), out)
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        """0 to 1 for each text; 0.5 is the calibrated threshold of its language."""
        out = []
        for rows, first in words(texts):
            out.append(1 / (1 + np.exp(-np.clip(self.logits(rows, first) - self.thresholds[self.guess(rows, first)], -30, 30).astype(np.float64))))
        return np.concatenate(out) if out else np.zeros(0)

    def set_words(self, langs: list[str], counts: np.ndarray) -> None:
        """Word frequencies of each language from counts (BUCKETS, languages)."""
        self.langs, counts = langs, counts + 0.1
        self.word_logs = np.log(counts / counts.sum(0)).astype(np.float32)

    def set_thresholds(self, own: np.ndarray, guess: np.ndarray, least_score: np.ndarray, largest_score: np.ndarray, ones: np.ndarray, zeros: np.ndarray, least: int = 15) -> None:
        """Thresholds from groups of rows of like scores, with rows of label 1 and 0: those not trained on (`own`) by language, all of them together where a language has fewer than `least` of a label."""

        def cut(m: np.ndarray) -> float:
            return _cut(least_score[m], largest_score[m], ones[m], zeros[m])

        def enough(m: np.ndarray) -> bool:
            return min(ones[m].sum(), zeros[m].sum()) >= least

        everyone = cut(own if enough(own) else np.ones(len(own), bool))
        by = [own & (guess == k) for k in range(len(self.langs))]
        self.thresholds = np.array([*(cut(m) if enough(m) else everyone for m in by), everyone], np.float32)

    def calibrate(self, texts: list[np.ndarray], y: np.ndarray, langs: list[str | None], train: np.ndarray, held: np.ndarray, least: int = 15) -> None:
        """Word frequencies and thresholds from rows in memory: frequencies from all given, thresholds from the held ones."""
        names = sorted({x for x in langs if x is not None})
        counts = np.zeros((BUCKETS, max(1, len(names))))
        for t, x in zip(texts, langs, strict=True):
            if x is not None:
                np.add.at(counts[:, names.index(x)], t[:, 0], 1)
        self.set_words(names, counts)
        score, guess = np.zeros(len(texts), np.float32), np.zeros(len(texts), np.int64)
        for at in range(0, len(texts), 128):  # a part at a time: all responses at once would fill the driver
            part = texts[at : at + 128]
            rows, first = np.concatenate(part), np.concatenate([[0], np.cumsum([len(t) for t in part])]).astype(np.int64)
            score[at : at + 128], guess[at : at + 128] = self.logits(rows, first), self.guess(rows, first)
        used = np.concatenate([train, held])
        self.set_thresholds(np.isin(used, held), guess[used], score[used], score[used], (y[used] == 1).astype(int), (y[used] == 0).astype(int), least)


def _cut(lo: np.ndarray, hi: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> float:
    """The logit between the two labels with the best balanced accuracy, midway through the widest such gap; 0 if a label is missing.

    Given are groups of rows within a bin: their least and largest logit and how many have label 1 and 0.
    """
    if not ones.sum() or not zeros.sum():
        return 0.0
    bins, at = np.unique(np.floor(np.asarray(lo, np.float64) / BIN), return_inverse=True)
    least, largest = np.full(len(bins), np.inf), np.full(len(bins), -np.inf)
    np.minimum.at(least, at, lo)
    np.maximum.at(largest, at, hi)
    lost = np.concatenate([[0], np.cumsum(np.bincount(at, ones))]) / ones.sum()
    kept = np.concatenate([[0], np.cumsum(np.bincount(at, zeros))]) / zeros.sum()
    value = kept - lost
    good = np.flatnonzero(value[1:-1] >= value.max() - 1e-9) + 1
    if not len(good):
        return float(((lo + hi) / 2 * (ones + zeros)).sum() / (ones + zeros).sum())
    i = good[np.argmax(least[good] - largest[good - 1])]
    return float((least[i] + largest[i - 1]) / 2)


def _word_counts(docs: DataFrame, most_langs: int = MOST_LANGS) -> tuple[list[str], np.ndarray]:
    """(languages, words of each table row and language) over all rows of docs(lang, text) with a language.

    Where there are more than `most_langs` languages, they are dealt by hash into so many groups, each of which counts as
    one language: the driver holds table rows times at most `most_langs` numbers.
    """
    docs = docs.where("lang is not null")
    if docs.select("lang").distinct().limit(most_langs + 1).count() > most_langs:
        docs = docs.withColumn("lang", F.concat(F.lit("group "), F.pmod(F.xxhash64("lang"), F.lit(most_langs)).cast("string")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}

        def out(lang: str) -> pa.RecordBatch:
            n = found.pop(lang)
            at = np.flatnonzero(n)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

        for b in batches:
            code = b.column(0).dictionary_encode()
            names, code, done = code.dictionary.to_pylist(), code.indices.to_numpy(), 0
            for rows, first in words(b.column(1)):
                of = np.repeat(code[done : done + len(first) - 1], np.diff(first))
                done += len(first) - 1
                for k in np.unique(of):
                    if names[k] not in found and len(found) >= 64:
                        yield out(next(iter(found)))
                    np.add(found.setdefault(names[k], np.zeros(BUCKETS, np.int64)), np.bincount(rows[of == k, 0], minlength=BUCKETS), out=found[names[k]])
        for lang in list(found):
            yield out(lang)

    got = docs.select("lang", "text").mapInArrow(B.tidy(run), "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(got["lang"].unique().to_pylist())
    counts = np.zeros((BUCKETS, max(1, len(names))))
    if names:
        counts[got["bucket"].to_numpy(), pc.index_in(got["lang"], pa.array(names)).to_numpy()] = got["n"].to_numpy()
    return names, counts


def _score_groups(docs: DataFrame, labels: DataFrame, fitted: DataFrame, n_labels: int, model: Classifier) -> pa.Table:
    """own (not fitted to), guess, lo, hi, ones, zeros of each bin of logits of all rows of docs(doc_id, text) with labels(doc_id, y)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = held.value
            parts = [(c.guess(rows, first), c.logits(rows, first)) for rows, first in words(b.column(0))]
            guess, logit = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(guess, pa.int32()), pa.array(logit, pa.float32()), *b.columns[1:]], ["guess", "logit", *b.schema.names[1:]])

    kind = f"guess int, logit float, doc_id {docs.schema['doc_id'].dataType.simpleString()}"
    if n_labels <= BROADCAST_LABELS:
        scored = docs.join(F.broadcast(labels), "doc_id").select("text", "doc_id", "y").mapInArrow(B.tidy(run), f"{kind}, y int")
    else:
        scored = docs.select("text", "doc_id").mapInArrow(B.tidy(run), kind).join(labels, "doc_id")
    scored = scored.join(F.broadcast(fitted.withColumn("fitted", F.lit(True))), "doc_id", "left")
    groups = scored.groupBy(F.col("fitted").isNull().alias("own"), "guess", F.floor(F.col("logit").cast("double") / BIN).alias("bin"))
    return groups.agg(F.min("logit").alias("lo"), F.max("logit").alias("hi"), F.sum("y").alias("ones"), F.sum(1 - F.col("y")).alias("zeros")).drop("bin").toArrow()


def _fold(doc_id: str, modulus: int):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang", label: str = "toxic", toxic_rows: int = 2000, other_rows: int = 3000, sample_bytes: int = 16 << 20, passes: int = 8, held_out: tuple[int, int] = HELD_OUT) -> Classifier:
    """Fits to labelled rows outside the held-out fold: at most about `toxic_rows` with label 1 and `other_rows` with label 0, chosen by a hash of doc_id.

    Of each label the fit takes whole texts of at most `sample_bytes` in all, none of over a sixteenth of it, so the
    driver's memory is bounded whatever the texts are. A fifth of the sample is not fitted to. The thresholds are
    calibrated on it and on all other labelled rows outside the held-out fold; the word frequencies that tell the
    language are counted over all rows outside that fold. Small samples are passed over more often, up to 40 times (about
    20,000 texts in all), larger ones `passes` times. A document labelled more than once counts with its largest label;
    null labels are left out. With no rows of a label the scores are those of a constant.
    """
    own = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null").where(_fold("doc_id", held_out[0]) != held_out[1])
    counts = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}
    key = F.xxhash64("doc_id", F.lit("toxic"))
    hit = F.when(F.col("y") == 1, sampled(key, toxic_rows, counts.get(1, 0))).otherwise(sampled(key, other_rows, counts.get(0, 0)))
    chosen = own.where(hit).groupBy("doc_id").agg(F.max("y").alias("y"))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (F.col(lang) if lang in docs.columns else F.lit(None)).cast("string").alias("lang"))

    def to_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [rows[first[i] : first[i + 1]].tobytes() for rows, first in words(b.column(3)) for i in range(len(first) - 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.binary())], ["doc_id", "y", "lang", "rows"])

    kind = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, y int, lang string, rows binary"
    # at most a little over toxic_rows + other_rows ids: always small enough to broadcast; their lengths decide who is
    # fitted to. Rows that repeat an id count once, with the least text.
    size = F.coalesce(F.octet_length(F.min("text")), F.lit(0)).cast("long")
    sizes = d.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(size.alias("size")).where(F.col("size") <= sample_bytes >> 4)
    room = F.sum("size").over(Window.partitionBy("y").orderBy(key, "size").rowsBetween(Window.unboundedPreceding, 0))
    fits = sizes.withColumn("room", room).where(F.col("room") <= sample_bytes).select("doc_id", "y")
    one = d.join(F.broadcast(fits), "doc_id").groupBy("doc_id", "y").agg(F.min("lang").alias("lang"), F.min("text").alias("text"))
    got = one.select("doc_id", "y", "lang", "text").mapInArrow(to_rows, kind).toArrow().sort_by("doc_id")
    texts = [np.frombuffer(r, np.uint32).reshape(-1, 3) for r in got["rows"].to_pylist()]
    y = np.array(got["y"].to_pylist(), np.int64)
    out = Classifier.new()
    held = np.arange(len(y)) % 5 == 4
    if (y == 1).any() and (y == 0).any():
        fit = np.flatnonzero(~held)
        out.fit([texts[i] for i in fit], y[fit], max(passes, min(40, 20_000 // max(1, len(fit)))))
    else:
        out.weights[:] = 0
        out.bias[:] = 3 if (y == 1).any() else -3
    learnable = d.where(_fold("doc_id", held_out[0]) != held_out[1])
    out.set_words(*_word_counts(learnable))
    fitted = docs.sparkSession.createDataFrame(got.filter(pa.array(~held)).select(["doc_id"])).select(F.col("doc_id").cast(d.schema["doc_id"].dataType)).distinct()
    groups = _score_groups(learnable.select("doc_id", "text"), own.groupBy("doc_id").agg(F.max("y").alias("y")), fitted, sum(counts.values()), out)
    out.set_thresholds(*(groups[c].to_numpy() for c in ("own", "guess", "lo", "hi", "ones", "zeros")))
    return out


def score(docs: DataFrame, model: Classifier, *, doc_id: str = "doc_id", text: str = "text", held_out: tuple[int, int] = HELD_OUT, keep: list[str] = ()) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1; 0.5 is the calibrated threshold), predicted (1 if score >= 0.5).

    Null, empty and wordless texts get the score of no words at all. Columns in `keep` go along. Repeated rows and null
    ids are kept (held_out is false for a null id); nothing is shuffled.
    """
    names = [c for c in keep if c not in ("doc_id", "text")]
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(_fold(doc_id, held_out[0]) == held_out[1], F.lit(False)).alias("held_out"), F.col(text).alias("text"), *[F.col(c).alias(f"_{c}") for c in names])
    held = d.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = held.value.scores(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32)), *([b.column(2)] if "text" in keep else []), *b.columns[3:]], ["doc_id", "held_out", "score", "predicted", *(["text"] if "text" in keep else []), *[f"_{c}" for c in names]])

    kinds = [f"doc_id {d.schema['doc_id'].dataType.simpleString()}", "held_out boolean", "score double", "predicted int", *(["text string"] if "text" in keep else []), *[f"`_{c}` {d.schema[f'_{c}'].dataType.simpleString()}" for c in names]]
    return d.mapInArrow(B.tidy(run), ", ".join(kinds))
