"""Token counts by a two-tier look-up on the map side.

Tier one is a broadcast table of the token counts of frequent pre-tokens; tier two is a cache in each worker, filled by
encoding what it misses. Pre-tokens are never shuffled. A pre-token is a run of spaces with the characters up to the next
space: no piece of the vocabulary holds a space after another character (checked when the model is read), so the merges
of one never touch another.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRE_TOKEN = re.compile(" [^ ]+")
ODD = re.compile(" +[^ ]*")
_models: dict[str, object] = {}
_counts: dict[str, Counts] = {}


def model(path: str):
    """The sentencepiece model, one for each worker process."""
    if path not in _models:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        if any("▁" in m.id_to_piece(i).lstrip("▁") for i in range(m.get_piece_size())) or m.encode("a", out_type=str) != ["▁a"] or len(m.encode("  a  b ")) != len(m.encode("  a")) + len(m.encode(" b")) + len(m.encode("")) + 1:
            raise ValueError("pre-tokens of this model can't be counted apart: it joins or drops spaces")
        _models[path] = m
    return _models[path]


class Counts(dict):
    """Pre-token (with its first space) -> tokens; bounded by what it holds beyond the broadcast tier."""

    def __init__(self, path: str, frequent: dict[str, int], most: int = 1_000_000, longest: int = 64):
        super().__init__(frequent)
        self.model, self.frequent, self.most, self.longest = model(path), frequent, most, longest

    def __missing__(self, piece: str) -> int:
        # the model itself puts the first space back, except before nothing: a last space alone is one token
        n = len(self.model.encode(piece[1:])) if len(piece) > 1 else 1
        if len(piece) <= self.longest:
            if len(self) >= self.most:
                self.clear()
                self.update(self.frequent)
            self[piece] = n
        return n

    def of(self, text: str | None) -> int:
        if not text:
            return 0
        text = f" {text}".replace("▁", " ")
        words = ODD.findall(text) if "  " in text or text[-1] == " " else [" " + w for w in text[1:].split(" ")]
        return sum(map(self.__getitem__, words))


def worker_counts(path: str, frequent: dict[str, int]) -> Counts:
    """The counts of this worker process, which its tasks share; another table of frequent pre-tokens begins anew."""
    if path not in _counts or _counts[path].frequent != frequent:
        _counts[path] = Counts(path, frequent)
    return _counts[path]


def frequent_pre_tokens(texts: DataFrame, path: str, most: int, sample_rows: int, sample_bytes: int) -> dict[str, int]:
    """Token counts of up to `most` frequent pre-tokens of the first `sample_rows` rows of at most `sample_bytes` of text each.

    Only speed depends on them: what they lack goes to tier two. Taken from the front, they cost a part of one file.
    """
    n: Counter = Counter()
    for r in texts.where(F.octet_length("text") <= sample_bytes).select("text").take(sample_rows):
        n.update((" " + r.text).split(" ") if r.text else ())
    words = [w for w, c in heapq.nlargest(most, n.items(), key=lambda x: (x[1], x[0])) if c > 1 and 0 < len(w) <= 32]
    return {" " + w: len(x) for w, x in zip(words, model(path).encode(words), strict=True)} if words else {}


def token_counts(docs: DataFrame, model_path: str, *, doc_id: str = "doc_id", text: str = "text", limit: int = 4096, frequent: int = 8192, sample_rows: int = 1000, sample_bytes: int = 16384) -> DataFrame:
    """Tokens of each whole text, as the sentencepiece model encodes it without begin, end or added tokens.

    Returns a row per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit). Null and empty texts have
    0 bytes and tokens; strings of special tokens are ordinary text; repeated rows and null ids are kept as they are;
    other columns are ignored. Nothing is shuffled; the broadcast table has at most `frequent` entries.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    table = d.sparkSession.sparkContext.broadcast(frequent_pre_tokens(d, model_path, frequent, sample_rows, sample_bytes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = worker_counts(model_path, table.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([counts.of(t) for t in b.column(2).to_pylist()], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    out = d.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text").mapInArrow(count, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
