"""What the operators hold or send is bounded, whatever the tables are like, and no row is left out."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomwork.llm import chat, language, near_duplicates, packing, token_counts, toxicity

LANG = "doc_id long, text string, lang string"


@pytest.fixture
def fitted(monkeypatch):
    """The windows and labels that each fit of the language network gets; nothing is fitted."""
    seen = []
    monkeypatch.setattr(language.Network, "fit", lambda self, x, y, mask, passes: seen.append((x, y)))
    return seen


def test_every_language_is_learnt_from_a_bounded_sample(spark, fitted):
    rows = [(i, f"text {i} of number {i % 300}", f"l{i % 300:03}") for i in range(3000)]
    docs = spark.createDataFrame(rows, LANG)
    net = language.train(docs, held_out=(4, 9), all_rows=900)
    x, y = fitted[-1]
    assert len(net.langs) == 300 and set(y) == set(range(300)) and 300 <= len(x) <= 300 * 3 * 3
    with pytest.raises(ValueError, match="different values"):
        language.train(docs, most_langs=299)


def test_a_repeated_id_or_row_does_not_swell_the_sample(spark, fitted):
    docs = spark.createDataFrame([(7, f"some text {i}", "en") for i in range(3000)] + [(8, "one text", "xx")] * 3000 + [(i, f"der {i}", "de") for i in range(100, 400)], LANG)
    net = language.train(docs, held_out=(4, 9), rows_per_lang=100)
    x, y = fitted[-1]
    n = Counter(net.langs[i] for i in y)
    assert set(n) == {"de", "en", "xx"} and n["xx"] == 1 and 50 < n["en"] <= 300 and 50 < n["de"] <= 300


def test_word_counts_of_many_languages_stay_small(spark):
    rows = [(f"l{i % 400}", "aa bb " + f"w{i}") for i in range(1200)]
    names, counts = toxicity._word_counts(spark.createDataFrame([*rows, (None, "left out")], "lang string, text string"))
    assert len(names) <= toxicity.MOST_LANGS and counts.shape[1] == len(names) and counts.sum() == 3 * 1200
    names, counts = toxicity._word_counts(spark.createDataFrame(rows[:20], "lang string, text string"))
    assert names == sorted(f"l{i}" for i in range(20)) and counts.sum() == 60


def test_a_long_conversation_parses_in_a_moment(spark):
    turns = [(1, i, ("user", "assistant")[i % 2], f"turn {i} </turn>" if i % 7 == 0 else f"turn {i} ### x\\") for i in range(6000)]
    r = chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).select("*", chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert r.round_trip and r.n_escaped == 6000 and r.loss == "".join(t for _, _, role, t in turns if role == "assistant")
    at = [(s.start, s.length) for s in r.loss_spans]
    assert all(r.formatted[a - 1 + n :].startswith("</turn>\n") and r.formatted[: a - 1].endswith("assistant~1: ") for a, n in at)


def linked(rows, threshold=0.8, n=5):
    """(links, classes) of rows (id, text) by comparing all pairs."""
    import re

    def shingles(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").lower())
        k = min(n, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    sets = [shingles(t) for _, t in rows]
    near = [[j for j, b in enumerate(sets) if j != i and a and b and len(a & b) >= threshold * len(a | b) - 1e-9] for i, a in enumerate(sets)]
    low = list(range(len(rows)))
    for _ in rows:
        low = [min([low[i], *(low[j] for j in near[i])]) for i in range(len(rows))]
    return near, low


def odd_copies():
    rng = random.Random(4)
    base = [" ".join(rng.choices("abcdefghijklmnop", k=60)) for _ in range(6)]
    rows = []
    for i, t in enumerate(base):
        rows += [(None if i % 2 else 10 * i, t), (10 * i + 1 if i != 3 else None, t + " z"), (5, t), (5, t)]
    return rows + [(None, None), (None, ""), (5, "alone here"), (70, None)]


def test_near_duplicates_of_null_and_repeated_ids(spark):
    rows = odd_copies()
    near, low = linked(rows)
    ids = {c: min((rows[i][0] for i in range(len(rows)) if low[i] == c and rows[i][0] is not None), default=None) for c in set(low)}
    want = Counter((rows[i][0], ids[low[i]], len(near[i])) for i in range(len(rows)))
    docs = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, key string").repartition(5)
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in near_duplicates.near_duplicates(docs).collect()) == want


def test_one_of_each_class_stays(spark):
    rows = odd_copies()
    _, low = linked(rows)
    want = Counter(min((rows[i][0] is None, rows[i][0] or 0) for i in range(len(rows)) if low[i] == c) for c in set(low))
    docs = spark.createDataFrame([(*r, "own", 1) for r in rows], "doc_id long, text string, key string, count int")
    got = near_duplicates.one_of_each(docs)
    assert got.columns == docs.columns and Counter((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == want
    own = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    assert {r.doc_id for r in near_duplicates.one_of_each(own).collect()} == set(low)
    assert near_duplicates.one_of_each(docs.limit(0)).count() == 0


def test_groups_of_packing_are_bounded_in_bytes(spark, monkeypatch):
    import public_tokenizers

    seen = []
    monkeypatch.setattr(packing, "pack", lambda parts, groups, **o: seen.append(groups) or parts)
    docs = spark.createDataFrame([(i, "word " * 2000) for i in range(100)], "doc_id long, text string")
    packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), group_bytes=100_000)
    packing.packed(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json"))
    assert seen == [10, 1]


def test_frequent_pre_tokens_come_from_few_rows(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = spark.createDataFrame([("the cat the",), (None,), ("x" * 50_000 + " the the",), ("",)], "text string")
    assert token_counts.frequent_pre_tokens(texts, path, 10, 100, 1000) == {" the": 1}
    assert token_counts.frequent_pre_tokens(texts.limit(0), path, 10, 100, 1000) == {}
