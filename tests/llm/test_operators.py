import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomwork.llm import chat, decontaminate, language, near_duplicates, packing, quality, token_counts, token_files, token_ids, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, _c string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, columns with clashing names."""
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, None, "en", "a", "x"), (2, "", None, None, None), (3, long, "en", "a", "x"), (4, "a b c d e f g h i j k l", "de", "b", "x"), (4, "a b c d e f g h i j k l", "de", "b", "x"), (None, "a b c", None, "b", "x"), (5, "12 34 !?", "en", "b", "x"), (6, long + " end", "en", "a", "x")]
    return spark.createDataFrame(rows, DOCS)


def test_odd_rows_pass_every_operator(spark, odd):
    empty = odd.limit(0)
    labels = spark.createDataFrame([(3, 1), (4, 0), (6, 1), (7, None)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, "c d e f g h i j k l m"), (2, "k l"), (None, "a"), (3, None)], "item_id long, text string")
    words, pieces = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
    for d, n in ((odd, 8), (empty, 0)):
        net = language.train(d, passes=1)
        got = language.identify(d, net).collect()
        assert len(got) == n and all(r.lang_pred == "und" for r in got if r.doc_id in (1, 2, 5))
        assert toxicity.score(d, toxicity.train(d, labels, passes=1)).count() == n
        assert token_files.round_trip(d, words, files=2).count() == n
        assert packing.packed(d, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id").count() >= n
        assert token_counts.token_counts(d, pieces).count() == n
        assert quality.apply_policy(quality.ledger(d)).count() == n
        assert decontaminate.decontaminate(d, bench).count() == n
        assert near_duplicates.near_duplicates(d).count() == n


def test_near_duplicates_link_copies(spark, odd):
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates.near_duplicates(odd).collect()}
    assert got[3] == got[6] == (3, 1) and got[1] == (1, 0) and got[4] == (4, 1) and got[None] == (None, 0)


def test_pruning_keeps_what_may_reach_the_threshold():
    least = near_duplicates.least_matches(0.8, 1e-6)
    assert all(a < b for a, b in zip(least, least[1:], strict=False)) and least[-1] < 0.8 * 128


def test_both_ways_of_decontamination_agree_with_brute_force(spark):
    r = np.random.default_rng(1)
    items = [(i, " ".join(r.choice(list("abcd"), r.integers(1, 16)))) for i in range(12)]
    docs = [(i, " ".join(r.choice(list("abcd"), r.integers(0, 60)))) for i in range(40)]
    want = {}
    for d, t in docs:
        w, hit, found = t.split(), set(), set()
        for i, x in items:
            v = x.split()
            m = min(10, len(v))
            for s in range(len(v) - m + 1):
                for p in range(len(w) - m + 1):
                    if w[p : p + m] == v[s : s + m]:
                        hit |= set(range(p, p + m))
                        found.add(i)
        want[d] = (len(w), len(hit), sorted(found))
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    runs = []
    for size in (1 << 20, 0):
        rows = decontaminate.decontaminate(a, b, broadcast_bytes=size).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids)) for r in rows} == want, size
        runs.append({r.doc_id: r.spans for r in rows})
    assert runs[0] == runs[1]


def test_both_ways_of_decontamination_give_the_same_rows(spark, odd, monkeypatch):
    """Null and repeated ids, equal texts under other ids, an empty benchmark, string ids; and with hot windows spread."""
    bench = spark.createDataFrame([(1, "c d e f g h i j k l m"), (2, "k l"), (None, "a"), (3, None), (4, "C D e f g h i j k l"), (5, "b")], "item_id long, text string")
    more = odd.unionByName(odd.where("doc_id = 4").withColumn("doc_id", F.lit(9).cast("long"))).withColumn("doc_id", F.col("doc_id").cast("string"))

    def rows(d, b, size):
        return sorted(decontaminate.decontaminate(d, b, broadcast_bytes=size, keep=d.columns).select("doc_id", "n_words", "n_hit", "item_ids", "spans", F.length("text"), "_lang", "_source", "__c").collect(), key=str)

    for d in (odd, more):
        want = rows(d, bench, 1 << 20)
        assert len(want) == d.count() and sorted(r.n_hit for r in want if r.n_hit) == [1, *[11] * (4 if d is more else 2)]
        assert rows(d, bench, 0) == want
        monkeypatch.setattr(decontaminate, "HOT_SHARE", 1)
        assert rows(d, bench, 0) == want
    assert rows(odd, bench.limit(0), 1 << 20) == rows(odd, bench.limit(0), -1)
    assert rows(odd.limit(0), bench, 0) == []


def test_windows_that_many_documents_share_are_spread(spark):
    left = spark.createDataFrame([(bytes([i % 250, i // 250]), 10, 5 if i % 3 else i) for i in range(40_000)], "key binary, m int, w long")
    right = spark.createDataFrame([(10, 5, 1), (10, 6, 2), (9, 5, 3)], "m int, w long, item_id long")
    got = decontaminate._join_hot(left, right, "inner").groupBy("item_id").count().collect()
    assert {r.item_id: r["count"] for r in got} == {1: sum(1 for i in range(40_000) if i % 3 or i == 5), 2: 1}


def test_best_fit_holds_every_capacity():
    r = np.random.default_rng(2)
    n = r.integers(1, 100, 500).astype(float)
    sizes, capacity = np.stack([n, np.ones(500), n * n], 1), np.array([100.0, 4, 6000.0])
    sizes[:, 2] = np.minimum(sizes[:, 2], 6000)
    for score in ("norm", "dot"):
        bins = packing.best_fit(sizes, capacity, np.ones(3), score)
        total = np.zeros((bins.max() + 1, 3))
        np.add.at(total, bins, sizes)
        assert (total <= capacity + 1e-6).all()


def test_items_that_fit_no_bin_are_an_error(spark):
    with pytest.raises(ValueError, match="exceeds a capacity"):
        packing.best_fit(np.array([[10.0, 1, 100]]), np.array([100.0, 4, 50]), np.ones(3))
    parts = spark.createDataFrame([(1, 0, 0, 1024, 5)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    with pytest.raises(Exception, match="exceeds a capacity"):
        packing.pack(parts, max_attention=1000.0).collect()


def test_every_capacity_binds_in_packed_sequences(spark):
    """Document count and attention cost end sequences before tokens do; repeated and null ids are dealt over all groups."""
    r = np.random.default_rng(6)
    parts = spark.createDataFrame([(None if i % 3 == 0 else 7, 0, 0, int(n), i) for i, n in enumerate(r.integers(1, 60, 400))], "doc_id long, piece int, start long, length long, ids_crc32 long")
    for max_docs, attention in ((4, 1e9), (400, 4000.0)):
        got = packing.pack(parts, capacity=200, max_docs=max_docs, max_attention=attention, weights=(1.0, 1.0, 1.0), groups=4)
        by = got.groupBy("sequence_id").agg(F.count("*").alias("docs"), F.sum("length").alias("n"), F.sum(F.col("length") ** 2).alias("cost")).collect()
        assert got.count() == 400 and all(x.n <= 200 and x.docs <= max_docs and x.cost <= attention for x in by)
        assert sum(x.docs == max_docs for x in by) > 20 or sum(x.cost > 0.8 * attention for x in by) > 20
        groups = {r[0]: r[1] for r in got.groupBy((F.col("sequence_id") / 2**32).cast("long")).count().collect()}
        assert len(groups) == 4 and max(groups.values()) <= 104



@pytest.mark.parametrize(("name", "cut"), [("word_bpe_49k.json", token_ids.NO_SPACES), ("byte_bpe_50k.json", token_ids.WITH_SPACES)])
def test_words_that_go_to_the_model_at_once_get_the_ids_of_the_library(name, cut):
    cache = token_ids.WordCache(public_tokenizers.path(name), re.compile(cut.pattern + "|(?!)"))  # as in a worker, where the pattern is another object
    assert cache.table
    dice, signs = random.Random(5), "aAzZ\u00e9\u00c9\u00c0\u00ff\u00df'., -\n\t0\u0301\u0130\u017f\u00b5\u00aa\u00d7\u4e2d<|"
    texts = ["", " a", "a", "\u00c9t\u00e9 d'Or", "x<|endoftext|> y"] + ["".join(dice.choices(signs, k=dice.randint(1, 24))) for _ in range(5000)]
    for t, ids in zip(texts, cache.encode(texts), strict=True):
        assert ids == token_ids.ids_as_bytes(cache.tokenizer.encode(t, add_special_tokens=False).ids), t


def test_ids_that_need_four_bytes(spark, tmp_path):
    w = token_files.Writer(f"file://{tmp_path}", "a", 4, wide=False)
    with pytest.raises(ValueError, match="does not fit"):
        w.add(1, np.array([70_000], np.uint32))
    w = token_files.Writer(f"file://{tmp_path}", "b", 4, wide=True, rows=2)
    for i in range(5):
        w.add(i, np.array([70_000 + i, 1, 2], np.uint32))
    w.close()
    reader = token_files.Reader(f"file://{tmp_path}", "b")
    assert [(d, s, x.tolist()) for d, s, x in reader.documents()] == [(i, 3 * i, [70_000 + i, 1, 2]) for i in range(5)]
    ids, mask = reader.sequence(3)
    assert ids.tolist() == [70_004, 1, 2, 0] and mask.tolist() == [True, True, True, False]
    assert not ids.flags.owndata and not mask.flags.owndata
    local = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    with pytest.raises(Exception, match="does not fit"):
        token_files.write_token_files(local, public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/c", end_id=70_000, wide=False)
    assert token_files.write_token_files(local, public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/d", end_id=70_000)[0][1] == 1


def test_a_remote_file_is_read_a_batch_at_a_time(tmp_path, monkeypatch):
    w = token_files.Writer(f"file://{tmp_path}", "a", 4, wide=False, rows=2)
    for i in range(9):
        w.add(i, np.arange(i, i + 5))
    w.close()
    local = token_files.Reader(f"file://{tmp_path}", "a")
    monkeypatch.setattr(token_files.pafs, "LocalFileSystem", int)  # as if it were another file system
    remote = token_files.Reader(f"file://{tmp_path}", "a")
    assert type(remote.source) is not type(local.source)
    for row in (11, 0, 5, 10, 1):
        for x, y in zip(local.sequence(row), remote.sequence(row), strict=True):
            assert (x == y).all()
    assert [x[2].tolist() for x in remote.documents()] == [list(range(i, i + 5)) for i in range(9)]


def test_samples_of_huge_tables_are_neither_empty_nor_large(spark):
    from loomwork.llm.shared import sampled

    n = 200_000
    d = spark.range(n).select(F.xxhash64("id").alias("h"))
    assert abs(d.where(sampled(F.col("h"), 2000, n)).count() - 2000) < 250
    assert d.where(sampled(F.col("h"), 10, 3)).count() == n
    share = spark.range(1).select(sampled(F.lit(-(1 << 63)), 2000, 10**13), sampled(F.lit(-(1 << 63) + 4 * 10**9), 2000, 10**13)).first()
    assert tuple(share) == (True, False)


def test_clusters_without_a_shared_folder_are_refused(monkeypatch):
    from types import SimpleNamespace

    from loomwork.llm.shared import shared_dir

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master="yarn")))


def test_chat_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "### user: x", "a\\h#<", "</turn>\n### ", "", None, "~1: \\b", "###"]
    turns = spark.createDataFrame([(c, t, r, x) for c, r in enumerate(("user", "assistant", "a: b~1", "# \n")) for t, x in enumerate(nasty)], "conv_id long, turn long, role string, text string")
    for r in chat.format_chats(turns).select("*", chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect():
        assert r.round_trip
        assert r.loss == ("".join(x or "" for x in nasty) if r.conv_id == 1 else "")


def test_quality_counts(spark):
    d = spark.createDataFrame([(1, "a b c a b c\nx\nx\n #*")], "doc_id long, text string")
    r = quality.ledger(d).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (9, 10, 2, 1, 6)
    assert {x.rule for x in quality.ablation(quality.ledger(d)).collect()} == set(quality.POLICIES["v1"])


def test_ablation_counts_what_each_rule_alone_rejects(spark):
    """Against a count over the rows of the ledger, for two policies."""
    texts = ["", "few words", *[" ".join(f"w{i}x{j}" for i in range(60)) for j in range(3)], "a b c " * 40, "# " * 60, " ".join(f"w{i}" for i in range(60)) + "\nsame line\n" * 30]
    led = quality.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).cache()
    bits = [r.fail_bits for r in led.collect()]
    number = {name: k for k, (name, _) in enumerate(quality.RULES)}
    for name, rules in quality.POLICIES.items():
        every = quality.mask(name)
        want = {x: (sum(bool(b >> number[x] & 1) for b in bits), sum(b & every == 1 << number[x] for b in bits)) for x in rules}
        got = {r.rule: (r.n_failed, r.n_only) for r in quality.ablation(led, name).collect()}
        assert got == want and any(a for a, _ in want.values())


def test_rules_of_urls(spark):
    rows = [(1, "http://a.net/en/x"), (2, "https://b.example.net/en/q"), (3, "http://EXAMPLE.com/de/1?x=1"), (4, None), (5, "nothing"), (6, "http://x.org/fr/"), (7, "http://a.net")]
    rules = [urls.Rule("net", "/", "block"), urls.Rule("example.net", "/en/", "allow"), urls.Rule("example.com", "/de/", "block"), urls.Rule("org", "/fr/", "allow")]
    got = {r.page_id: (r.host, r.rule) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules, trees=2).collect()}
    assert got == {1: ("a.net", "net/"), 2: ("b.example.net", "example.net/en/"), 3: ("example.com", "example.com/de/"), 4: ("", None), 5: ("", None), 6: ("x.org", "org/fr/"), 7: ("a.net", None)}


def differences(parameters, grads, loss, places, step=1e-3):
    """The gradients at some places of every parameter array against central differences of the loss."""
    for p, g in zip(parameters, grads, strict=True):
        for at in places(p, g):
            keep = p[at]
            p[at] = keep + step
            up = loss()
            p[at] = keep - step
            down = loss()
            p[at] = keep
            assert abs((up - down) / (2 * step) - g[at]) < 2e-3 + 0.02 * abs(g[at]), (p.shape, at)


def largest(p, g):
    """The places of the three largest gradients."""
    return [np.unravel_index(i, g.shape) for i in np.argsort(-np.abs(g), axis=None)[:3]]


def test_gradients_of_the_byte_network_match_differences():
    r = np.random.default_rng(3)
    net = language.Network.new(["a", "b"], 3)
    for part in (net.table, net.recur, net.out):
        part[:] = [p.astype(np.float64) for p in part]
    net.bias = net.bias.astype(np.float64)
    x, y, v = r.integers(0, 9, (5, 4)), np.array([0, 1, 1, 0]), np.ones((5, 4))
    _, grads = net.gradients(x, y, v)
    differences(net.parameters(), grads, lambda: net.gradients(x, y, v)[0], largest)
    assert len(language.label_bytes(language.Network.new(["a", "b"], 3), "añb")) == 4


def test_gradients_of_the_classifier_match_differences():
    c = toxicity.Classifier.new()
    c.table, c.weights, c.bias = c.table.astype(np.float64) * 30, c.weights.astype(np.float64), c.bias.astype(np.float64)
    c.filters, c.shift = [f.astype(np.float64) for f in c.filters], [np.random.default_rng(1).uniform(0.05, 0.2, len(f)) for f in c.shift]  # not at the kink of max(0, x)
    (rows, first), = toxicity.words(pa.array(["one two three four", "two five", "six seven eight nine ten one"]))
    y, weight = np.array([1, 0, 1]), np.array([1.0, 2.0, 1.0])
    _, touched, grads = c.gradients(rows, first, y, weight)
    whole = np.zeros_like(c.table)
    whole[touched] = grads[0]
    differences(c.parameters(), [whole, *grads[1:]], lambda: c.gradients(rows, first, y, weight)[0], largest, 1e-3)


def test_scoring_of_the_byte_network_equals_plain_loops():
    def sigmoid(v):
        return 1 / (1 + np.exp(-v))

    net = language.Network.new(["a", "b", "c"], 4)
    texts = ["", "short", "längerer Text, " * 30, "x" * 128, "y" * 129]
    got = net.scorer().pooled(pa.array(texts))
    for text, row in zip(texts, got, strict=True):
        data, total = text.encode(), np.zeros(3)
        for at in range(0, len(data), language.WINDOW):
            part = data[at : at + language.WINDOW].ljust(language.WINDOW, b"\0")
            states = [[None] * language.WINDOW for _ in "fb"]
            for d, steps in enumerate((range(language.WINDOW), range(language.WINDOW - 1, -1, -1))):
                h = np.zeros(4)
                for t in steps:
                    g, a = net.table[d][:, part[t]], net.recur[d] @ h
                    reset, update = sigmoid(g[:4] + a[:4]), sigmoid(g[4:8] + a[4:8])
                    h = (1 - update) * np.tanh(g[8:] + reset * a[8:]) + update * h
                    states[d][t] = h
            for t in range(min(language.WINDOW, len(data) - at)):
                e = np.exp(net.out[0] @ states[0][t] + net.out[1] @ states[1][t] + net.bias[:, 0])
                total += e / e.sum()
        assert np.allclose(row, total / max(1, len(data)), atol=1e-5)


@pytest.mark.parametrize("block", [1 << 16, 3])
def test_scoring_of_the_classifier_equals_plain_loops(monkeypatch, block):
    """Whole texts at once, and cut into blocks of three words."""
    monkeypatch.setattr(toxicity, "BLOCK", block)
    c = toxicity.Classifier.new()
    c.table *= 30
    texts = ["", "one", "one two", "one two three four five six seven eight nine", "a b c", None, "x y z " * 9]
    (rows, first), = toxicity.words(pa.array(texts))
    want = []
    for i in range(len(texts)):
        words = [c.table[r].sum(0) for r in rows[first[i] : first[i + 1]]]
        padded, best = [*words, *[np.zeros(toxicity.DIMENSION)] * toxicity.PADS], []
        for w, f, b in zip(toxicity.WIDTHS, c.filters, c.shift, strict=True):
            best.append(np.max([np.concatenate(padded[p : p + w]) @ f + b for p in range(len(words) + 1)], 0))
        want.append(np.maximum(np.concatenate(best), 0) @ c.weights + c.bias[0])
    assert np.allclose(c.logits(rows, first), want, atol=1e-4)


def test_fit_takes_no_more_text_than_it_may(spark):
    docs = spark.createDataFrame([(i, "word " * (2000 if i % 10 == 0 else 20), "en") for i in range(100)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")
    fitted = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(toxicity.Classifier, "fit", lambda self, texts, *a, **k: fitted.extend(len(t) for t in texts))
        toxicity.train(docs, labels, sample_bytes=3200)
    assert 0 < len(fitted) <= 2 * 32 and max(fitted) == 20 and sum(fitted) * 5 <= 2 * 3200


def test_toxic_words_are_learnt():
    r = np.random.default_rng(4)
    texts = [" ".join([*r.choice(["sun", "rain", "hill", "tree"], 30), *(["vile"] if i % 2 else [])]) for i in range(120)]
    rows = [w[f[i] : f[i + 1]] for w, f in toxicity.words(pa.array(texts)) for i in range(len(f) - 1)]
    y = np.arange(120) % 2
    c = toxicity.Classifier.new()
    c.fit(rows[:100], y[:100], 20)
    c.calibrate(rows[:100], y[:100], ["en"] * 100, np.arange(80), np.arange(80, 100))
    assert ((c.scores(pa.array(texts[100:])) >= 0.5) == y[100:]).all()


def test_counts_of_odd_texts_equal_the_library(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["a  b", "  a", "a ", " ", "\n", "a\nb <s> x</s>", "x▁y", "ﬁ é\t\0 日本", "   ", "a   b  "]
    model = token_counts.model(path)
    got = [r.n_tokens for r in token_counts.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).orderBy("doc_id").collect()]
    assert got == [len(model.encode(t)) for t in texts]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def sites(labels):
    """Pages of sites aa0.com, aa1.com, ...: of 60 URLs below /x/ and /y/ the given share is blocked by a rule, 10 more are named by none."""
    rules, rows = [], []
    for i, share in enumerate(labels):
        rules += [urls.Rule(f"aa{i}.com", "/x/", "block"), urls.Rule(f"aa{i}.com", "/y/", "allow")]
        rows += [(1000 * i + j, f"http://w.aa{i}.com/{'z' if j >= 60 else 'x' if j < 60 * share else 'y'}/{j + 10}") for j in range(70)]
    return rules, rows


def test_every_labelled_site_keeps_its_own_rate(spark):
    rules, rows = sites([0.95, 0.05] * 4)
    pages = spark.createDataFrame(rows, "page_id long, url string")
    for most in (1, 3, 2000):
        got = urls.judge(pages, rules, max_suffixes=most, trees=5).where("rule is null").collect()
        assert {(r.page_id, r.verdict) for r in got} == {(p, "allow" if p // 1000 % 2 else "block") for p, u in rows if "/z/" in u}, most


def test_a_rate_is_out_of_fold_and_never_a_rule_in_disguise(spark):
    from loomwork.llm.shared import shared_dir

    rules, rows = sites([0.5, 0.5, 1.0, 0.0])
    d, n, rate = urls.featured(spark.createDataFrame(rows, "page_id long, url string"), rules, shared_dir(spark), prior=0.0)
    got = d.withColumn("fold", F.when(F.col("ruled").isNotNull(), F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(5)))).collect()
    assert n == 240 and rate == 0.5
    assert {r.site_rate for r in got if r.site in ("aa2.com", "aa3.com")} == {0.5}  # all of one label
    for site in ("aa0.com", "aa1.com"):
        own = [r for r in got if r.site == site]
        for r in own:
            others = [x.ruled == "block" for x in own if x.ruled and x.fold != r.fold]
            assert abs(r.site_rate - np.mean(others)) < 1e-9


def test_trees_rank_unseen_hosts_better_than_their_suffix(spark):
    """On the given pages, hosts of one fold at a time kept out of training."""
    from pathlib import Path

    from loomwork.llm import queries
    from loomwork.llm.shared import shared_dir

    if not Path("/root/testdata/sf0.1").exists():
        pytest.skip("needs the given tables")

    def ranked(score, y):
        order = np.argsort(np.argsort(score, kind="stable")) if len(set(score)) > 1 else np.full(len(y), (len(y) - 1) / 2)
        return (order[y].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (~y).sum())

    d, _, _ = urls.featured(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"), queries.RULES, shared_dir(spark))
    labelled = d.where("ruled is not null").withColumn("fold", F.pmod(F.xxhash64("host", F.lit(3)), F.lit(3))).cache()
    trees, suffix = [], []
    for k in range(3):
        # neither the trees nor the rates see a label of the fold
        seen = labelled.drop("suffix_rate", "site_rate").withColumn("truth", F.col("ruled")).withColumn("ruled", F.when(F.col("fold") != k, F.col("ruled")))
        n, b = seen.agg(F.count("ruled"), F.count_if(F.col("ruled") == "block")).first()
        for key, unit in (("suffix", "site"), ("site", "url")):
            seen = urls.with_rate(seen, key, unit, b / n, 20.0, 2000, shared_dir(spark))
        rows = urls.with_score(seen.where(f"fold = {k}"), urls.fit_trees(seen.where(f"fold <> {k}"))).select("score", "suffix_rate", "truth").collect()
        y = np.array([r.truth == "block" for r in rows])
        trees.append(ranked([r.score for r in rows], y))
        suffix.append(ranked([r.suffix_rate for r in rows], y))
    assert np.mean(trees) > np.mean(suffix) + 0.05 and min(trees) > 0.55, (trees, suffix)


def test_urls_of_odd_tables(spark):
    rules = sites([0.5])[0]
    pages = spark.createDataFrame([(1, "http://aa0.com/x/1", "a", "b"), (1, "http://aa0.com/x/1", "a", "b"), (None, "http://aa0.com/y/1", None, None), (2, None, "a", "b"), (3, "", "a", "b")], "page_id long, url string, host string, score string")
    got = urls.judge(pages, rules, trees=2).collect()
    assert len(got) == 5 and sorted(r.verdict for r in got if r.page_id == 1) == ["block", "block"]
    assert urls.judge(pages.limit(0), rules).count() == 0


def test_chats_of_odd_tables(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a", "x"), (1, 0, "user", "a", "x"), (None, 0, "assistant", "b", "y"), (2, None, None, None, None)], "conv_id long, turn long, role string, text string, formatted string")
    got = chat.format_chats(turns).collect()
    assert {r.conv_id for r in got} == {1, 2, None} and all(r.round_trip for r in got)
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_thresholds_and_languages_come_from_all_labelled_rows(spark, monkeypatch):
    r = np.random.default_rng(2)
    word = {"en": [f"en{i}" for i in range(200)], "xx": [f"xx{i}" for i in range(200)]}
    docs, labels = [], []
    for i in range(3000):
        lang = "xx" if i % 25 < 2 else "en"
        toxic = int(r.integers(0, 2))
        docs.append((i, " ".join([*r.choice(word[lang], 20), *(["vile"] if toxic else [])]), lang))
        labels.append((i, toxic))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    seen = []
    real = toxicity.Classifier.set_thresholds
    monkeypatch.setattr(toxicity.Classifier, "set_thresholds", lambda self, own, guess, lo, hi, ones, zeros, least=15: (seen.append((own, guess, ones, zeros)), real(self, own, guess, lo, hi, ones, zeros, least))[1])
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0
    want = {(x.lang, x.toxic): x.n for x in docs.join(labels, "doc_id").where(fold).groupBy("lang", "toxic").agg(F.count("*").alias("n")).collect()}
    models = []
    for most in (1_000_000, 0):
        monkeypatch.setattr(toxicity, "BROADCAST_LABELS", most)
        models.append(toxicity.train(docs, labels, toxic_rows=60, other_rows=60, passes=1))
        own, guess, ones, zeros = seen[-1]
        assert models[-1].langs == ["en", "xx"] and not own.all() and sum(ones[~own]) + sum(zeros[~own]) <= 120
        assert {(x, y): int(n[guess == k].sum()) for k, x in enumerate(("en", "xx")) for y, n in ((0, zeros), (1, ones))} == want
        assert min(ones[own & (guess == 1)].sum(), zeros[own & (guess == 1)].sum()) >= 15  # few of the sample, many of the labels
    assert np.allclose(models[0].thresholds, models[1].thresholds, atol=1e-3)
    assert len(np.unique((models[0].word_logs[:, 1] > models[0].word_logs[:, 1].min()).nonzero()[0])) >= 195
