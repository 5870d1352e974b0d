"""Quality rules as a bitmask ledger: every rule is evaluated once, policies and ablations only read the bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
#: Rules in bit order: name and what fails, over the measurements. The first two are the base.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 5 * word_chars"),
    ("duplicate_lines", "n_dup_lines >= 3 and 100 * n_dup_lines > 30 * n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
)
#: Versioned policies: the names of the rules that reject.
POLICIES = {"base": ("few_words", "repeated_words"), "v1": ("few_words", "repeated_words", "symbols", "duplicate_lines", "word_length")}


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def measurements(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (longs) of a text; zeros for null.

    Three-word windows are compared by 64-bit hashes within one text.
    """
    text = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(trimmed == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")

    def covered(g: Column) -> Column:
        """Words inside windows whose hash occurs again: equal hashes are neighbours after a sort."""
        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = _let(pairs, lambda s: F.filter(s, lambda e, j: ((j > 0) & (F.get(s, j - 1)["h"] == e["h"])) | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False))))
        places = F.flatten(F.transform(again, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))
        return F.size(F.array_distinct(places))

    def repeats(w: Column) -> Column:
        grams = F.when(F.size(w) < 3, F.expr("cast(array() as array<bigint>)")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
        return _let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))

    of_words = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeats(w).cast("long").alias("n_repeat_words")))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long")
    return F.struct(of_words.alias("w"), of_lines.alias("l"), symbols.alias("n_symbols"))


def ledger(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """Per row: doc_id, the measurements, and fail_bits (bit k is set where rule k fails).

    Null and empty texts have no words and no lines. Repeated rows and null ids are kept; other columns are ignored;
    nothing is shuffled.
    """
    m = docs.select(F.col(doc_id).alias("doc_id"), measurements(F.col(text)).alias("m"))
    m = m.select("doc_id", "m.w.n_words", "m.w.word_chars", "m.n_symbols", "m.l.n_lines", "m.l.n_dup_lines", "m.w.n_repeat_words")
    bits = F.lit(0).cast("long")
    for k, (_, fails) in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return m.withColumn("fail_bits", bits)


def mask(policy: str, rules=RULES, policies=POLICIES) -> int:
    return sum(1 << k for k, (name, _) in enumerate(rules) if name in policies[policy])


def apply_policy(ledger: DataFrame, policy: str = "v1", **kinds) -> DataFrame:
    """The ledger with `kept`: no bit of the policy is set."""
    return ledger.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(policy, **kinds)).cast("long")) == 0)


def ablation(ledger: DataFrame, policy: str = "v1", rules=RULES, policies=POLICIES) -> DataFrame:
    """Per rule of the policy: rule, n_failed, n_only (rejected by this rule alone: what leaving it out would keep). One pass, one row per rule."""
    whole = F.lit(mask(policy, rules, policies)).cast("long")
    bits = F.col("fail_bits").bitwiseAND(whole)
    names = [(k, name) for k, (name, _) in enumerate(rules) if name in policies[policy]]
    sums = ledger.agg(*[F.count_if(bits.bitwiseAND(F.lit(1 << k).cast("long")) != 0).alias(f"failed_{k}") for k, _ in names], *[F.count_if(bits == (1 << k)).alias(f"only_{k}") for k, _ in names])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"failed_{k}").alias("n_failed"), F.col(f"only_{k}").alias("n_only")) for k, name in names])).alias("r")).select("r.*")
