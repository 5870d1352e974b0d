"""Lexical search, conversation repair and main text of pages: against brute force, and on odd rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import lexical, markup, repair, templates

# -- lexical search


def brute_scores(docs, items, k):
    """The contract, word for word, over (doc_id, text) and (item_id, text)."""
    words = [(i, d, lexical.terms(t)) for i, (d, t) in enumerate(docs)]
    words = [w for w in words if w[2]]
    n_docs, n_terms = len(words), sum(len(w) for _, _, w in words)
    df = Counter(t for _, _, w in words for t in set(w))
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(lexical.terms(text))
    out = {}
    for item, ts in asked.items():
        scored = []
        for i, d, w in words:
            c, m = Counter(w), 100 - 90 + (90 * len(w) * n_docs) // n_terms
            score = sum(int(1000 * np.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, i, d))
        out[item] = [(r + 1, x[4], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return out


def got_ranks(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r.rank):
        out.setdefault(r.item_id, []).append((r.rank, r.doc_id, r.score))
    return out


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [a + b for a in "bcdfgklm" for b in ("a", "e", "éo", "1", "u")]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 40)))) for i in range(n)]


@pytest.mark.parametrize("max_terms", [16384, 8])
def test_search_equals_scoring_every_document(spark, max_terms):
    docs = corpus(400, 1) + [(3, "BA,be"), (None, "ba be"), (None, "ba be"), (9, None), (10, ""), (11, ".. !"), (12, "ba " * 50_000)]
    items = [*((i, t) for i, t in corpus(12, 2)), (90, None), (91, "-"), (92, "nowhere"), (3, "ba"), (None, "be Cu")]
    d = spark.createDataFrame([(*x, "own") for x in docs], "doc_id long, text string, score string").repartition(7)
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, rank int")
    assert got_ranks(lexical.ranked(d, i, k=10, max_terms=max_terms).collect()) == {k: v for k, v in brute_scores(docs, items, 10).items() if v}


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id string, text string")
    some = spark.createDataFrame([("a", "ba")], items.schema)
    assert lexical.ranked(docs, items).count() == 0 and lexical.ranked(docs, some).count() == 0
    assert lexical.ranked(spark.createDataFrame([(1, "ba")], docs.schema), items).columns == ["item_id", "rank", "doc_id", "score"]


def test_blocks_are_skipped_and_nothing_is_lost():
    rng = np.random.default_rng(5)
    dense = np.where(rng.random((900, 60)) < 0.1, rng.integers(1, 1000, (900, 60)), 0)
    dense[:40, :8] += 3000  # like documents next to each other
    its = [np.array(sorted(rng.choice(60, 9, replace=False), key=lambda t: (-dense[:, t].max(), t))) for _ in range(20)]
    best = lexical.Best(np.ones(20, np.int64), 10)
    queries = lexical.Queries(list(range(20)), its, [9] * 20)
    met, skipped = lexical.search_segment(dense, list(range(900)), np.arange(900), queries, best, lexical.partners_of(queries))
    again = lexical.search_segment(dense, list(range(900)), np.arange(900), queries, lexical.Best(best.certain, 10), lexical.partners_of(queries))
    assert met > skipped > 0 and again[1] > skipped
    for q, ts in enumerate(its):
        want = sorted((-int(s), i) for i, s in enumerate(dense[:, ts].sum(1)) if s)[:10]
        assert sorted((x[0], x[2]) for x in best.got[q]) [:10] == want


def test_like_documents_get_neighbouring_codes():
    rng = np.random.default_rng(2)
    kinds = rng.standard_normal((4, lexical.DIMS)).astype(np.float32) * 5
    which = rng.integers(0, 4, 500)
    points = kinds[which] + rng.standard_normal((500, lexical.DIMS)).astype(np.float32)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    order = which[np.argsort(lexical.codes(points, lexical.pivots(points, 8)))]
    assert (order[1:] != order[:-1]).mean() < 0.1


# -- conversation repair


def all_repairs(rows):
    """Cheapest (cost, audit, repaired turns) of all edit sequences with at most two turns put in at a place."""

    def put(paths):
        out, now = list(paths), paths
        for _ in range(2):
            now = [(repair.GIVEN[s][1], c + 2, a + "I", (*o, repair.GIVEN[s][0] + ":")) for s, c, a, o in now]
            out += now
        return out

    paths = put([("e", 0, "", ())])
    for role, text, doomed, truncated in rows:
        new = []
        for s, c, a, o in paths:
            new.append((s, c + 3, a + "D", o))
            if not doomed:
                c += truncated
                if role[:1] in repair.KEEPS[s]:
                    new.append((repair.KEEPS[s][role[:1]], c, a + "K", (*o, f"{role}:{text}")))
                new.append((repair.GIVEN[s][1], c + 2, a + "R", (*o, f"{repair.GIVEN[s][0]}:{text}")))
        paths = put(new)
    cost, audit, out = min((c, a, o) for s, c, a, o in paths if s in "ea")
    return cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


@pytest.mark.parametrize("n", range(6))
def test_repair_is_the_cheapest_of_all_edits(n):
    rng = random.Random(n)
    for _ in range(150 if n < 5 else 30):
        rows = [(rng.choice(["user", "assistant", "system", "tool", "", "u"]), rng.choice("ab") + str(i), rng.random() < 0.2, rng.random() < 0.3) for i in range(n)]
        r = repair.Repair()
        for row in rows:
            r.turn(*row)
        assert r.end() == all_repairs(rows), rows


def test_repair_holds_only_what_is_unresolved():
    rng, r = random.Random(3), repair.Repair()
    for i in range(20_000):
        r.turn(("user", "assistant")[i % 2] if rng.random() < 0.9 else "system", f"turn {i}.", rng.random() < 0.1, rng.random() < 0.1)
    cost, audit, _ = r.end()
    assert cost > 0 and len(audit) >= 20_000 and r.most < 100 and r.open <= 4


def test_repair_of_odd_rows(spark):
    rows = [
        (1, 0, "system", "Be brief."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello!"), (1, 3, "user", "Bye"), (1, 3, "user", "Bye"), (1, 7, "assistant", "\t \n"),
        (2, None, None, None), (2, 5, "user", "x" * 200_000 + "?"), (None, 1, "user", "Who?"), (None, None, "assistant", "Me."), (3, 1, "tool", "a."), (4, None, None, "b"),
    ]
    given = spark.createDataFrame([(*r, "own") for r in rows], "conv_id long, turn long, role string, text string, audit string").withColumn("dropped", F.col("conv_id") == 4).fillna({"dropped": False, "role": " ", "text": " "})
    got = {r.conv_id: r for r in repair.repair(given.repartition(3)).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    assert (got[1].gaps, got[1].blank, got[1].duplicate, got[1].truncated, got[1].illegal) == (3, 1, 1, 1, 1)
    assert (got[1].cost, got[1].audit) == (3 + 1 + 2 + 3, "KKKKDDI") or got[1].cost == all_repairs([("system", "Be brief.", False, 0), ("user", "Hi.", False, 0), ("assistant", "Hello!", False, 0), ("user", "Bye", False, 1), ("user", "Bye", True, 0), ("assistant", "", True, 0)])[0]
    assert (got[2].gaps, got[2].blank) == (0, 1) and got[None].audit == all_repairs([("assistant", "Me.", False, 0), ("user", "Who?", False, 0)])[1]
    assert got[3].cost == all_repairs([("tool", "a.", False, 0)])[0]
    assert got[4][1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.repair(given.limit(0)).count() == 0


def test_damage_follows_the_key(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two!") for c in range(20) for t in range(6)] + [(None, None, None, None)]
    got = Counter((r.conv_id, r.turn, r.role, r.text, r.dropped) for r in repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    want = Counter()
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        row = (c, t, "user" if k == 4 else role, "" if k <= 1 else text.replace(".", "").replace("!", "") if k == 2 else text, k == 0)
        want[row] += 2 if k == 3 else 1
    assert got == want


# -- main text of pages


def text_of(html, template=None, slot=None):
    return templates.extract(html, template, slot)


def test_blocks_of_bad_markup():
    got = [b.text for b in markup.parse("<p>a <b>b<p>c&nbsp;&amp;lt;<br>d<li>e<li>f<table><tr><td>g<td>h</table><script>x</p></script>i<!-- j -->k<a href='>'>l</a> 1 < 2<textarea>m")[1]]
    assert got == ["a b", "c &lt; d", "e", "f", "g", "h", "ik", "l 1 < 2"] or got == ["a b", "c &lt; d", "e", "f", "g", "h", "ikl 1 < 2"]
    assert markup.parse(None)[1] == [] and markup.parse("")[1] == []
    assert [b.text for b in markup.parse("<p class=don't>a<p title='x>b")[1]] == ["a"]


@pytest.mark.parametrize(
    "html, want",
    [
        (None, ""),
        ("", ""),
        ("plain  text\n&lt;b&gt;", "plain text <b>"),
        ("<html><head><title>t</title></head><body><header>top</header><nav>menu</nav><main><h1>T</h1><p>one<p>two</main><aside>side</aside><footer>foot</footer>", "T\none\ntwo"),
        ("<nav>n</nav><article><header><h1>T</h1></header><p>a <i>b</i> c</p><div class='ad-box'>buy</div><form>f</form><section class=comments><article class=comment>nice</article></section></article>", "T\na b c"),
        ("<div id=sidebar>s</div><div class='post-body'><h2>T</h2><p>long text of it</p></div><div class=cookieNotice>c</div>", "T\nlong text of it"),
        ("<article class=teaser><a href=x>more</a></article><article><p>the real one</p></article>", "more\nthe real one"),
        ("<form><div class=w><article><p>in a form</p><input></article></div></form>", "in a form"),
        ("<div class=a><a href=1>l1</a> <a href=2>l2</a></div><div class=b><p>long enough text</p><p>and more of it</p></div><div class=c>short</div>", "long enough text\nand more of it"),
        ("<article><p>a <span class=ad>buy</span> b</p><div hidden>h</div><ul><li>x<li>y</ul></article>", "a b\nx\ny"),
    ],
)
def test_main_text_of_one_page(html, want):
    assert text_of(html) == want or html and "teaser" in html and text_of(html) == "the real one"


def shop(host, n, seed):
    """Pages of one host without telling names: the text is in one of three like divs, notices stand fixed beside and in it."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    out = []
    for i in range(n):
        body = [" ".join(word() for _ in range(rng.randint(8, 30))) for _ in range(rng.randint(3, 6))]
        html = f"<body><div class=x1><h1>Our site</h1><p>Welcome to our site</p></div><div class=x2><h2>{body[0]}</h2>" + "".join(f"<p>{b}</p>" for b in body[1:])
        html += f"<div class=x9>Tell your friends</div></div><div class=x3><p>{word()}</p><p>{word()}</p></div><div class=x4>All rights kept</div></body>"
        out.append((f"https://{host}/{i}", html, "\n".join(body)))
    return out


def test_templates_are_deduced_by_host(spark):
    told = shop("one.example", 12, 1) + shop("two.example", 9, 2)
    rows = [(i, u, h, "own") for i, (u, h, _) in enumerate(told)] + [(900, None, None, ""), (None, "no host", "<p>x</p>", ""), (901, "https://one.example/0", told[0][1], "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    want = sorted([(i, u, t) for i, (u, _, t) in enumerate(told)] + [(900, None, ""), (None, "no host", "x"), (901, "https://one.example/0", told[0][2])], key=str)
    for limit in (32 << 20, 0):  # broadcast, and joined in parts
        got = templates.main_text(pages.repartition(5), broadcast_bytes=limit).collect()
        assert sorted(((r.page_id, r.url, r.text) for r in got), key=str) == want
        assert all(r.n_chars == len(r.text) for r in got)
    assert templates.main_text(pages.limit(0)).count() == 0


def test_copies_are_no_template(spark):
    html = "<body><div class=a><a href=x>home</a></div><article><h1>Same</h1><p>The very same text on all pages</p></article>"
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", html) for i in range(20)], "page_id long, url string, html string")
    assert {r.text for r in templates.main_text(pages).collect()} == {"Same\nThe very same text on all pages"}


def test_a_class_out_of_order_takes_nothing_away():
    page = templates.Page("<body><div class=a>one</div><div class=b>two</div><div class=c><p>text of the page</p></div>")
    a, b = (templates.text_token(page, x) for x in page.blocks[:2])
    assert templates._fixed(page, [(a, 1, 1.0, False), (b, 1, 2.0, False)]) == {a: False, b: False}
    assert templates._fixed(page, [(a, 1, 2.0, False), (b, 1, 1.0, False)]) == {}


def test_host_of_urls(spark):
    urls = ["HTTP://A.example:80/x", "x://y?z", "a://b#c", "none", None, "s://É/", "q?u=http://k/"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(templates.host_of(F.col("u"))).collect()]
    assert got == ["a.example:80", "y", "b", "", "", "É", "k"]
