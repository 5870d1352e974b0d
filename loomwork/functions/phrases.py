"""Phrases met in one pass over a text's words, by look-ups in one table; the cost does not grow with the table.

A text becomes its words: runs of letters and digits in lower case, `&`, `#` and `++` as words, and `^` and `$` for its
ends. A word that begins a phrase of the table is read on for up to the length of the longest phrase, and
every run of words that is in the table is a hit with its place. Phrases are cut into words alike, so "pss/e", "i&c" and
"one-line" are met however they are joined. `When` sets conditions on the words around a hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word of a text; the second is the same for Python. Letters beyond a-z are words of their own, as they end a word.
WORDS, WORDS_PY = r"[a-z0-9]+|\+\+|[#&]|[\p{L}\p{N}&&[^a-z0-9]]+", r"[a-z0-9]+|\+\+|[#&]|[^\W_a-z0-9]+"


@dataclass(frozen=True)
class When:
    """Phrases that count only if one of `after` (`before`) stands after (before) them, and none of `unless_after`, `unless_before`, nor `unless_next` right after."""

    phrases: tuple[str, ...]
    after: tuple[str, ...] = ()
    before: tuple[str, ...] = ()
    unless_after: tuple[str, ...] = ()
    unless_before: tuple[str, ...] = ()
    unless_next: tuple[str, ...] = ()


def once(x: Column, f) -> Column:
    """f(x) with x evaluated once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def each(*patterns: str) -> tuple[str, ...]:
    """Phrases from patterns in which words are choices: "grid planning/operations" stands for two; an empty choice leaves the word out."""
    return tuple(dict.fromkeys(" ".join(w for w in ws if w) for p in patterns for ws in product(*(x.split("/") for x in p.split()))))


def cut(phrase: str) -> str:
    """A phrase as the words that a text has for it."""
    return " ".join(re.findall(WORDS_PY + r"|[$^]", phrase.lower()))


def words_of(text: Column) -> Column:
    lower = F.lower(F.coalesce(text, F.lit("")))
    return F.concat(F.array(F.lit("^")), F.regexp_extract_all(lower, F.lit(WORDS), F.lit(0)), F.array(F.lit("$")))


def plain(vocabulary: Iterable[str | When]) -> list[str]:
    """All phrases of a vocabulary, cut."""
    return list(dict.fromkeys(cut(p) for e in vocabulary for p in (e.phrases if isinstance(e, When) else (e,))))


def hits(words: Column, phrases: list[str]) -> Column:
    """Array of (p, at, n): each place at which a phrase (cut) stands, its first word's number from 0 and its length."""
    longest = max((p.count(" ") + 1 for p in phrases), default=1)
    heads = sorted({p.split(" ", 1)[0] for p in phrases})
    starts = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(*heads), i)))

    def runs(i: Column) -> Column:
        run = lambda n: F.when(i + n <= F.size(words), F.struct(F.concat_ws(" ", F.slice(words, i + 1, n)).alias("p"), i.alias("at"), F.lit(n).alias("n")))
        return F.filter(F.array(*[run(n) for n in range(1, longest + 1)]), lambda c: F.coalesce(c["p"].isin(*phrases), F.lit(False)))

    return F.flatten(F.transform(starts, runs))


def met(x: Column, vocabulary: Iterable[str | When]) -> Column:
    """Whether x, a struct of words and hits, meets one of a vocabulary's phrases under its conditions."""
    vocabulary = list(vocabulary)
    free = plain(e for e in vocabulary if not isinstance(e, When))
    words = x["words"]

    def stands(part: Column, these: tuple[str, ...]) -> Column:
        return F.arrays_overlap(part, F.array(*map(F.lit, these)))

    def holds(e: When) -> Column:
        def at(h: Column) -> Column:
            after = F.slice(words, h["at"] + h["n"] + 1, F.size(words))
            before = F.slice(words, 1, h["at"])
            out = h["p"].isin(*plain([e]))
            if e.unless_next:
                out = out & ~F.coalesce(F.get(words, h["at"] + h["n"]).isin(*e.unless_next), F.lit(False))
            for part, these, wanted in ((after, e.after, True), (before, e.before, True), (after, e.unless_after, False), (before, e.unless_before, False)):
                if these:
                    out = out & (stands(part, these) if wanted else ~stands(part, these))
            return out

        return F.exists(x["hits"], at)

    tests = [F.exists(x["hits"], lambda h: h["p"].isin(*free))] if free else []
    tests += [holds(e) for e in vocabulary if isinstance(e, When)]
    out = F.lit(False)
    for t in reversed(tests):
        out = t | out
    return out


def counted(found: Column, phrases: Iterable[str]) -> Column:
    """How many different phrases of a vocabulary are among those found; one with and without a last s is one."""
    these = plain(phrases)
    return F.size(F.array_distinct(F.transform(F.filter(found, lambda p: p.isin(*these)), lambda p: F.rtrim(p, F.lit("s")))))
