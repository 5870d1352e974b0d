"""One query for each operator, with production parameters over whole tables, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, language, lexical, near_duplicates, packing, quality, repair, templates, token_counts, token_files, toxicity, urls

RULES = [urls.Rule("net", "/", "block"), urls.Rule("example.net", "/en/", "allow"), urls.Rule("example.com", "/de/", "block"), urls.Rule("org", "/fr/", "allow")]


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_read(spark, sf_dir, "documents"), _path("word_bpe_49k.json"), end_id=1)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_read(spark, sf_dir, "documents"), _path("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), _path("piece_bpe_32k.model"), limit=4096)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))


PLANTED = "\\### Assistant: </turn> ok"


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = turns.sparkSession.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], turns.schema)
    out = chat.format_chats(turns.unionByName(more)).withColumn("back", chat.parse(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    whole = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.apply_policy(quality.ledger(_read(spark, sf_dir, "documents")), "v1")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("fail_bits").bitwiseAND(F.lit(quality.mask("base")).cast("long")) != 0).alias("base_failed"), "kept")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(_read(spark, sf_dir, "documents"), n=5, threshold=0.8)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages"), RULES).drop("score")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), n=10)
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), k=10)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(_read(spark, sf_dir, "conversations")))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.main_text(_read(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language, op2_token_files, op3_packing, op4_token_counts, op5_toxicity, op6_chat, op7_quality, op8_near_duplicates, op9_url_filter, op10_decontamination, op11_lexical_search, op12_conversation_repair, op13_main_text, pipeline)}


OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, x.turn, x.role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) x(turn, role)
), e AS (
  SELECT *, contains(text, '### ') OR contains(text, '</turn>') AS esc FROM t
), r AS (
  SELECT *, '### ' || role || CASE WHEN esc THEN '~1' ELSE '' END || ': ' ||
    CASE WHEN esc THEN replace(replace(replace(text, '\', '\b'), '#', '\h'), '<', '\l') ELSE text END || '</turn>' || chr(10) AS out
  FROM e
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    string_agg(out, '' ORDER BY turn, role, text) AS formatted
  FROM r GROUP BY conv_id
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(length(formatted) AS BIGINT) AS formatted_chars
FROM g
"""

OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), g AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1
), rep AS (
  SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + k AS p FROM again, (VALUES (0), (1), (2)) s(k)) GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines
  FROM w LEFT JOIN rep USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 5 * word_chars OR n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM m
"""

OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM d)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE shared >= 0.8 * (x.n + y.n - shared) - 1e-9
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a
)
SELECT r.a AS doc_id, min(r.b) AS class_id, CAST(coalesce(max(l.n), 0) AS BIGINT) AS n_links
FROM reach r LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) l ON l.a = r.a GROUP BY r.a
"""

OP10_SQL = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), k AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), g AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM k) WHERE len(w) >= n)
), hit AS (
  SELECT g.doc_id, g.i, g.n, k.item_id FROM g JOIN k ON g.n = k.n AND g.g = k.g
), places AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(places.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(places.n, 0) > 0 AS contaminated
FROM d LEFT JOIN places ON places.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""

OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), g AS (
  SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
), p AS (
  SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) SEMI JOIN q USING (t) GROUP BY r, t
), f AS (
  SELECT t, CAST(floor(1000 * ln((2.0 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY t
), m AS (
  SELECT r, doc_id, 10 + (90 * len(w) * n_docs) // n_terms AS m FROM d, g WHERE len(w) > 0
), s AS (
  SELECT item_id, r, CAST(sum(f.w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN p USING (t) JOIN f USING (t) JOIN m USING (r) GROUP BY item_id, r
), k AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r) AS k, doc_id, score FROM s JOIN m USING (r) WHERE score > 0
)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM k WHERE k <= 10
"""


def _op12_sql() -> str:
    """Viterbi over turns as a recursive query; a state is (cost, audit, repaired turns), null where it cannot be reached."""

    def to(state: str, cost: str, letter: str, out: str = "") -> str:
        return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'o': {state}.o{out}}} END"

    def least(*of: str) -> str:
        return f"list_min(list_filter([{', '.join(of)}], lambda x: x IS NOT NULL))"

    def kept(state: str, initial: str) -> str:
        return f"CASE WHEN NOT doomed AND ini = '{initial}' THEN {to(state, 'cut', 'K', ' || chr(10) || role || chr(58) || text')} END"

    def given(state: str, role: str) -> str:
        return f"CASE WHEN NOT doomed THEN {to(state, '(2 + cut)', 'R', f" || chr(10) || '{role}:' || text")} END"

    def put(state: str, role: str) -> str:
        return to(state, "2", "I", f" || chr(10) || '{role}:'")

    u = least("u", put("e", "user"), put("s", "user"), put("a", "user"))
    with_u = "SELECT conv, i, e, s, {u} AS u, a FROM ({of})"
    with_a = "SELECT conv, i, e, s, u, {a} AS a FROM ({of})"

    def grown(of: str) -> str:
        return with_a.format(a=least("a", put("u", "assistant")), of=with_u.format(u=u, of=of))

    after = f"""SELECT v.conv, t.i, {to("e", "3", "D")} AS e, {least(to("s", "3", "D"), kept("e", "s"))} AS s,
      {least(to("u", "3", "D"), kept("e", "u"), kept("s", "u"), kept("a", "u"), given("e", "user"), given("s", "user"), given("a", "user"))} AS u,
      {least(to("a", "3", "D"), kept("u", "a"), given("u", "assistant"))} AS a
      FROM v JOIN t ON t.conv = v.conv AND t.i = v.i + 1"""
    none = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, o VARCHAR))"
    begin = f"SELECT DISTINCT conv, CAST(0 AS BIGINT) AS i, CAST({{'c': 0, 'a': '', 'o': ''}} AS STRUCT(c BIGINT, a VARCHAR, o VARCHAR)) AS e, {none} AS s, {none} AS u, {none} AS a FROM x"
    return rf"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n) ORDER BY n) AS tab FROM range(256) r(n)
), x AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), 'null') AS conv, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT)),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295)) % 20 AS k
  FROM conversations, tab
), y AS (
  SELECT conv, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM x WHERE k <> 0
), z AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv, role, text ORDER BY turn NULLS FIRST, copy) AS nth, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM y
), t AS (
  SELECT *, left(role, 1) AS ini, bare = '' AS blank, bare <> '' AND nth > 1 AS dup, bare = '' OR nth > 1 AS doomed,
    CASE WHEN bare <> '' AND nth = 1 AND right(bare, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS cut,
    coalesce(lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS bad FROM z
), v AS (
  {grown(begin)}
  UNION ALL
  {grown(after)}
), f AS (
  SELECT conv, {least("e", "a")} AS f FROM v QUALIFY i = max(i) OVER (PARTITION BY conv)
), n AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate, sum(cut) AS truncated,
    count(*) FILTER (WHERE bad) AS illegal FROM t GROUP BY conv
)
SELECT d.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(f.f.c AS BIGINT) AS cost, f.f.a AS audit, sha256(substr(f.f.o, 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv, conv_id FROM x) d JOIN f USING (conv) LEFT JOIN n USING (conv)
"""


OP13_SQL = r"""
WITH a AS (
  SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>') AS parts FROM pages
), b AS (
  SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS parts FROM a
), c AS (
  SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)) AS text FROM b
)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM c
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_chat": OP6_SQL, "op7_quality": OP7_SQL, "op8_near_duplicates": OP8_SQL, "op10_decontamination": OP10_SQL, "op11_lexical_search": OP11_SQL, "op12_conversation_repair": _op12_sql(), "op13_main_text": OP13_SQL}
