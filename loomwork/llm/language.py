"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

A text is read in windows of `WINDOW` bytes, forwards and backwards; every byte gets a probability of each language from
both states, and a document's probabilities are the mean over all of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytes_np as B

WINDOW, HIDDEN, LANES = 128, 8, 2048
HELD_OUT = (4, 2)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Two directions, each with a table of what a byte adds to the gates (reset, update, candidate) and a recurrent matrix; one output layer."""

    langs: list[str]
    table: list[np.ndarray]  # 2 x (3 H, 256)
    recur: list[np.ndarray]  # 2 x (3 H, H)
    out: list[np.ndarray]  # 2 x (L, H)
    bias: np.ndarray  # (L, 1)

    @classmethod
    def new(cls, langs: list[str], hidden: int, seed: int = 1) -> Network:
        r, f = np.random.default_rng(seed), np.float32
        return cls(langs, [r.normal(0, 0.3, (3 * hidden, 256)).astype(f) for _ in "fb"], [r.normal(0, 0.5 / hidden**0.5, (3 * hidden, hidden)).astype(f) for _ in "fb"], [r.normal(0, 0.3, (len(langs), hidden)).astype(f) for _ in "fb"], np.zeros((len(langs), 1), f))

    def parameters(self) -> list[np.ndarray]:
        return [*self.table, *self.recur, *self.out, self.bias]

    def gradients(self, x: np.ndarray, y: np.ndarray, valid: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all valid bytes of windows x (T, lanes) with labels y, and its gradients, through time."""
        steps, lanes = x.shape
        h_size = self.recur[0].shape[1]
        kept, states = [], []
        for d in range(2):
            h, saved, hs = np.zeros((h_size, lanes), np.float32), [], [None] * steps
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                g, a = self.table[d][:, x[t]], self.recur[d] @ h
                r, z = _sigmoid(g[:h_size] + a[:h_size]), _sigmoid(g[h_size : 2 * h_size] + a[h_size : 2 * h_size])
                c = a[2 * h_size :]
                n = np.tanh(g[2 * h_size :] + r * c)
                saved.append((t, h, r, z, c, n))
                h = n + z * (h - n)
                hs[t] = h
            kept.append(saved)
            states.append(np.stack(hs))
        logits = np.einsum("lh,thb->tlb", self.out[0], states[0]) + np.einsum("lh,thb->tlb", self.out[1], states[1]) + self.bias
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        total = valid.sum()
        loss = -float((np.log(np.take_along_axis(p, y[None, None, :], 1)[:, 0] + 1e-9) * valid).sum() / total)
        p[:, y, np.arange(lanes)] -= 1
        p *= valid[:, None] / total
        grads_t, grads_u, grads_o = [], [], []
        for d in range(2):
            grads_o.append(np.einsum("tlb,thb->lh", p, states[d]))
            from_out = np.einsum("lh,tlb->thb", self.out[d], p)
            du = np.zeros_like(self.recur[d])
            dg = np.empty((3 * h_size, steps, lanes), np.float32)
            dh = np.zeros((h_size, lanes), np.float32)
            for t, h, r, z, c, n in reversed(kept[d]):
                dh = dh + from_out[t]
                dz = dh * (h - n) * z * (1 - z)
                dn = dh * (1 - z) * (1 - n * n)
                dr = dn * c * r * (1 - r)
                da = np.concatenate([dr, dz, dn * r])
                dg[:h_size, t], dg[h_size : 2 * h_size, t], dg[2 * h_size :, t] = dr, dz, dn
                du += da @ h.T
                dh = dh * z + self.recur[d].T @ da
            flat = x.reshape(-1)
            grads_t.append(np.stack([np.bincount(flat, row.reshape(-1), 256) for row in dg]).astype(np.float32))
            grads_u.append(du)
        return loss, [*grads_t, *grads_u, *grads_o, p.sum((0, 2))[:, None]]

    def fit(self, x: np.ndarray, y: np.ndarray, valid: np.ndarray, passes: int, lanes: int = 256, rate: float = 0.02, seed: int = 2) -> None:
        """Adam over shuffled windows x (rows, T)."""
        r = np.random.default_rng(seed)
        first, second = [np.zeros_like(p) for p in self.parameters()], [np.zeros_like(p) for p in self.parameters()]
        steps = passes * -(-len(x) // lanes)
        k = 0
        for _ in range(passes):
            order = r.permutation(len(x))
            for at in range(0, len(x), lanes):
                i = order[at : at + lanes]
                _, grads = self.gradients(np.ascontiguousarray(x[i].T), y[i], np.ascontiguousarray(valid[i].T))
                k += 1
                norm = max(1.0, float(np.sqrt(sum((g * g).sum() for g in grads))))
                for p, g, m, v in zip(self.parameters(), grads, first, second, strict=True):
                    g = g / norm
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= rate * (1 - 0.9 * k / steps) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Byte probabilities of many windows side by side; buffers are used again for each step."""

    def __init__(self, net: Network):
        h = net.recur[0].shape[1]
        half = np.ones((3 * h, 1), np.float32)
        half[: 2 * h] = 0.5  # sigmoid(x) = tanh(x / 2) / 2 + 1 / 2
        self.net, self.h = net, h
        self.table, self.recur = [t * half for t in net.table], [u * half for u in net.recur]

    def steps(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """(languages, lanes) of byte t, for t = 0, 1, ... of x (T, lanes)."""
        steps, lanes = x.shape
        h_size, f = self.h, np.float32
        states = [np.empty((steps, h_size, lanes), f) for _ in range(2)]
        g, a = np.empty((3 * h_size, lanes), f), np.empty((3 * h_size, lanes), f)
        gates, n = g[: 2 * h_size], a[2 * h_size :]
        for d in range(2):
            h = np.zeros((h_size, lanes), f)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                np.take(self.table[d], x[t], 1, out=g, mode="clip")
                np.dot(self.recur[d], h, out=a)
                gates += a[: 2 * h_size]
                np.tanh(gates, out=gates)
                gates *= f(0.5)
                gates += f(0.5)
                n *= g[:h_size]
                n += g[2 * h_size :]
                np.tanh(n, out=n)
                o = states[d][t]
                np.subtract(h, n, out=o)
                o *= g[h_size : 2 * h_size]
                o += n
                h = o
        for t in range(steps):
            p = self.net.out[0] @ states[0][t]
            p += self.net.out[1] @ states[1][t]
            p += self.net.bias
            np.exp(p, out=p)
            p /= p.sum(0)
            yield p

    def pooled(self, texts: pa.Array) -> np.ndarray:
        """(texts, languages): the mean over all bytes; zeros for an empty text."""
        out = []
        for _, data, offsets in B.text_slices(texts):
            size = np.diff(offsets)
            n = -(-size // WINDOW)
            owner = np.repeat(np.arange(len(size)), n)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            start, left = offsets[:-1][owner] + nth * WINDOW, np.minimum(size[owner] - nth * WINDOW, WINDOW)
            padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
            total = np.zeros((len(size), len(self.net.langs)))
            for at in range(0, len(owner), LANES):
                s, m = start[at : at + LANES], left[at : at + LANES]
                x = padded[s[None, :] + np.arange(WINDOW)[:, None]].astype(np.intp)
                inside = np.arange(WINDOW)[:, None] < m[None, :]
                x[~inside] = 0
                mask = inside.astype(np.float32)
                acc = np.zeros((len(self.net.langs), len(s)), np.float32)
                for t, p in enumerate(self.steps(x)):
                    p *= mask[t]
                    acc += p
                np.add.at(total, owner[at : at + LANES], acc.T)
            out.append(total / np.maximum(size, 1)[:, None])
        return np.concatenate(out) if out else np.zeros((0, len(self.net.langs)))


def label_bytes(net: Network, text: str) -> list[str]:
    """The likeliest language of every byte of one text."""
    data = np.frombuffer(text.encode(), np.uint8)
    out = []
    for at in range(0, len(data), WINDOW):
        x = np.zeros((WINDOW, 1), np.intp)
        part = data[at : at + WINDOW]
        x[: len(part), 0] = part
        out += [net.langs[int(p[:, 0].argmax())] for p in net.scorer().steps(x)][: len(part)]
    return out


def _fold(doc_id, modulus: int):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def _below(wanted: int, total: int) -> int:
    """The bound below which about `wanted` of `total` different 64-bit hashes lie."""
    return (1 << 63) if wanted >= total else int(Fraction(wanted, total) * (1 << 64)) - (1 << 63)


def train(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows_per_lang: int = 600, all_rows: int = 12_000, windows_per_row: int = 3, most_langs: int = 10_000, passes: int = 14, held_out: tuple[int, int] = HELD_OUT) -> Network | None:
    """Fits the network to text and non-null lang of the rows outside the held-out fold; None where there are none.

    It learns every language there is. Of each it sees at most about `rows_per_lang` different texts, and of all together
    about `all_rows` (at least one of each), chosen by a hash of the text, so rows that repeat one count once; of each
    text `windows_per_row` windows. A column of more than `most_langs` values holds no languages: that is an error.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    d = d.where("lang is not null and text is not null and doc_id is not null").where(_fold("doc_id", held_out[0]) != held_out[1])
    key = F.xxhash64(F.lit("lang"), "text")
    found = d.groupBy("lang").agg(F.approx_count_distinct(key, 0.03).alias("texts"), F.min(key).alias("least")).limit(most_langs + 1).collect()
    if len(found) > most_langs:
        raise ValueError(f"{lang} has more than {most_langs} different values, which no column of languages has")
    if not found:
        return None
    rows_per_lang = max(1, min(rows_per_lang, all_rows // len(found)))
    # the share of the 64-bit hashes that gives a language its rows, and at least its text with the least hash
    below = {r.lang: max(r.least + 1, _below(round(1.2 * rows_per_lang) + 1, r.texts)) if r.texts else r.least + 1 for r in found}
    limits = docs.sparkSession.createDataFrame([(k, Decimal(v)) for k, v in below.items()], "lang string, below decimal(20,0)")
    some = d.join(F.broadcast(limits), "lang").where(key.cast("decimal(20,0)") < F.col("below")).groupBy("lang", key.alias("key")).agg(F.min("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, parts = [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = t.encode()
                n = -(-len(data) // WINDOW)
                for w in np.unique(np.linspace(0, n - 1, min(n, windows_per_row)).astype(int)) if n else []:
                    langs.append(k)
                    parts.append(data[w * WINDOW : (w + 1) * WINDOW])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.binary())], ["lang", "part"])

    got = some.select("lang", "text").mapInArrow(cut, "lang string, part binary").toArrow()  # bounded by the parameters
    langs = sorted(below)
    order = sorted(range(got.num_rows), key=lambda i: (got["lang"][i].as_py(), got["part"][i].as_py()))
    x, y, size, taken = [], [], [], dict.fromkeys(langs, 0)
    r = np.random.default_rng(3)
    for i in r.permutation(np.array(order, np.int64)):
        k, part = got["lang"][int(i)].as_py(), got["part"][int(i)].as_py()
        if taken[k] < rows_per_lang * windows_per_row:
            taken[k] += 1
            x.append(np.frombuffer(part.ljust(WINDOW, b"\0"), np.uint8))
            y.append(langs.index(k))
            size.append(len(part))
    net = Network.new(langs, HIDDEN)
    if x:
        net.fit(np.stack(x).astype(np.intp), np.array(y), (np.arange(WINDOW)[None, :] < np.array(size)[:, None]).astype(np.float32), passes)
    return net


def identify(docs: DataFrame, net: Network | None, *, doc_id: str = "doc_id", text: str = "text", held_out: tuple[int, int] = HELD_OUT, keep: list[str] = ()) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (mean probability of that language over all bytes of the whole text).

    lang_pred is `und` with score 0 where text is null or has no letter, and everywhere if there is no network. Columns
    in `keep` go along. Repeated rows and null ids are kept (held_out is false for a null id); nothing is shuffled.
    """
    names = [c for c in keep if c not in ("doc_id", "text")]
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(_fold(doc_id, held_out[0]) == held_out[1], F.lit(False)).alias("held_out"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"), F.col(text).alias("text"), *[F.col(c).alias(f"_{c}") for c in names])
    held = d.sparkSession.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        scorer = net.scorer() if net else None
        for b in batches:
            letters = b.column(2).to_numpy(zero_copy_only=False)
            if net and b.num_rows:
                p = scorer.pooled(b.column(3))
                best, top = p.argmax(1), np.minimum(p.max(1), 1.0)
                langs = [net.langs[i] if ok else "und" for i, ok in zip(best, letters, strict=True)]
            else:
                top, langs = np.zeros(b.num_rows), ["und"] * b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(np.where(letters, top, 0.0)), *([b.column(3)] if "text" in keep else []), *b.columns[4:]], ["doc_id", "held_out", "lang_pred", "score", *(["text"] if "text" in keep else []), *[f"_{c}" for c in names]])

    kinds = [f"doc_id {d.schema['doc_id'].dataType.simpleString()}", "held_out boolean", "lang_pred string", "score double", *(["text string"] if "text" in keep else []), *[f"`_{c}` {d.schema[f'_{c}'].dataType.simpleString()}" for c in names]]
    return d.mapInArrow(B.tidy(score), ", ".join(kinds))
