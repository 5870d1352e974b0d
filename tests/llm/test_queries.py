"""The registered queries against brute force and the tokenizer libraries, on the small tables."""

import re
import zlib
from itertools import combinations
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from loomwork.llm import near_duplicates, queries, token_files
from loomwork.llm.shared import connected_components, shared_dir

TINY, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(TINY).exists(), reason="needs the given tables")


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def documents(spark):
    return sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{TINY}/documents.parquet").collect())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_says_the_same(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{TINY}/{t}.parquet')")
    got = queries.queries()[name](spark, TINY)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_op1_guesses_languages_of_held_out_rows(spark):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.op1_language(spark, SMALL).collect()
    assert len(got) == len(truth) and {r.doc_id for r in got} == set(truth)
    right = []
    for r in got:
        text, lang = truth[r.doc_id].text, truth[r.doc_id].lang
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not regex.search(r"\p{L}", text or ""))
        if r.held_out and lang is not None and r.lang_pred != "und":
            right.append(r.lang_pred == lang)
    assert len(right) > 100 and np.mean(right) > 0.97


def test_op2_reads_back_what_the_library_encodes(spark, documents):
    from tokenizers import Tokenizer

    library, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for d, t in documents:
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        want.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, queries.op2_token_files(spark, TINY).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


def test_files_give_any_sequence_and_survive_a_second_attempt(spark, documents):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    folder = shared_dir(spark) + "/tokens"
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    for _ in range(2):
        manifest = token_files.write_token_files(docs, path, folder, length=64, files=3)
    library = Tokenizer.from_file(path)
    flat = np.concatenate([[*library.encode(t, add_special_tokens=False).ids, 1] for _, t in documents])
    at = 0
    for name, _, n in manifest:
        reader, own = token_files.Reader(folder, name), flat[at : at + n]
        for row in {0, n // 64 // 2, (n - 1) // 64}:
            ids, mask = reader.sequence(row)
            part = own[row * 64 : row * 64 + 64]
            assert len(ids) == len(mask) == 64 and mask.sum() == len(part) and (ids[mask] == part).all()
        at += n
    assert at == len(flat)


def test_op3_packs_every_id_once_without_gaps(spark, documents):
    from tokenizers import Tokenizer

    library, want, total = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), set(), 0
    for d, t in documents:
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        total += len(ids)
        first = (len(ids) - 1) % 1024 + 1
        edges = [0, *range(first, len(ids) + 1, 1024)]
        want |= {(d, p, s, e - s, crc(ids[s:e])) for p, (s, e) in enumerate(zip(edges, edges[1:], strict=False))}
    got = queries.op3_packing(spark, TINY).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 1024
    assert len(sequences) <= 1.02 * total / 1024 + 1


def test_op4_counts_as_the_library(spark, documents):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = [(d, len(t.encode()), n := len(library.encode(t)), n > 4096) for d, t in documents]
    assert sorted(map(tuple, queries.op4_token_counts(spark, TINY).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())) == want


def test_op5_finds_toxic_rows_that_it_never_saw(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    got = queries.op5_toxicity(spark, SMALL).collect()
    assert len(got) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    right = {0: [], 1: []}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        if r.held_out and truth.get(r.doc_id) is not None:
            right[truth[r.doc_id]].append(r.predicted == truth[r.doc_id])
    assert min(len(right[0]), len(right[1])) >= 5 and (np.mean(right[0]) + np.mean(right[1])) / 2 > 0.85


def test_op9_reads_hosts_and_rules_as_stated(spark):
    def parts(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]

    want = {}
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url").collect():
        host, path = parts(r.url)
        fit = [x for x in queries.RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fit, key=lambda x: len(x.name), default=None)
        want[r.page_id] = (host, path, best and best.name, best and best.verdict)
    got = queries.op9_url_filter(spark, SMALL).collect()
    assert len(got) == len(want)
    for r in got:
        host, path, rule, verdict = want[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and verdict in (None, r.verdict)


def test_small_blocks_lose_no_link(spark, monkeypatch):
    """Buckets and components cut into many blocks that meet in pairs give what brute force gives."""
    monkeypatch.setattr(near_duplicates, "BLOCK_BUCKET", 3)
    monkeypatch.setattr(near_duplicates, "BLOCK_VERIFY", 2)
    r = np.random.default_rng(7)
    docs = []
    for c in range(4):
        base = [f"w{c}x{i}" for i in range(80)]
        for _ in range(9):
            text = list(base)
            for i in r.integers(0, 80, r.integers(0, 4)):
                text[i] = f"n{r.integers(0, 5)}"
            docs.append((len(docs), " ".join(text)))
    sets = {d: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(76)} for d, t in docs}
    links = {d: {d} for d, _ in docs}
    for a, b in combinations(links, 2):
        both = len(sets[a] & sets[b])
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
            links[a].add(b)
            links[b].add(a)
    low = {d: d for d in links}
    for _ in links:
        low = {d: min(low[x] for x in links[d]) for d in links}
    got = near_duplicates.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.class_id, x.n_links) for x in got} == {d: (low[d], len(links[d]) - 1) for d in links}


def test_components_of_a_long_chain_and_of_nothing(spark):
    folder = shared_dir(spark)
    chain = [(int(a), int(a) + 1) for a in np.random.default_rng(8).permutation(60)] + [(100, 200), (5, 5)]
    got = connected_components(spark.createDataFrame(chain, "a long, b long"), folder).collect()
    assert {r.node: r.component for r in got} == {**dict.fromkeys(range(61), 0), 100: 100, 200: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long"), folder).count() == 0


def test_pipeline_stages_take_effect(spark, documents):
    """Each stage removes what its operator says and nothing else, and the last one packs all that is left."""
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    columns, left = docs.columns, {d for d, _ in documents}
    text = dict(documents)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, TINY)
        assert out.columns == columns
        kept = {r.doc_id: r.text for r in out.collect()}
        assert kept.keys() <= left and all((t or "") == text[d] for d, t in kept.items())
        gone = left - kept.keys()
        if name == "language":
            assert all(d in gone for d in left if not regex.search(r"\p{L}", text[d]))
        if name == "near_duplicates":
            classes = {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(docs).collect()}
            assert kept.keys() == set(classes.values())
        if name == "decontamination":
            hit = {r.doc_id for r in queries.op10_decontamination(spark, TINY).where("contaminated").collect()}
            assert gone == left & hit
        docs, left = out, set(kept)
    got = corpus_pipeline.STAGES[-1][1](spark, docs, TINY)
    assert {r.doc_id for r in got.select("doc_id").collect()} == left
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").isEmpty()


def test_pipeline_runs_its_stages_one_after_the_other(spark, documents):
    """run() packs exactly what the stages, applied by hand, leave."""
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, TINY)
    left = {r.doc_id for r in docs.collect()}
    got = corpus_pipeline.run(spark, TINY)
    assert {r.doc_id for r in got.collect()} == left and 0 < len(left) < len(documents)
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").isEmpty()


def test_pipeline_stages_take_odd_rows(spark):
    """Null, empty and repeated rows, null ids, extra columns and an empty table pass every stage."""
    rows = [(1, None, "en", "a", 0, "x"), (2, "", None, None, 0, None), (3, "some plain words here", "en", "a", 21, "x"), (3, "some plain words here", "en", "a", 21, "x"), (None, "other words of no id", "en", "b", 20, "x"), (4, "12 34 !?", "en", "b", 8, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    for d in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, d, TINY)
            assert out.columns == docs.columns and out.count() <= 6
        assert corpus_pipeline.STAGES[-1][1](spark, d, TINY).count() == d.count()
