"""Character references of HTML to characters, as a Column: no Python worker takes part.

A text is cut at its ampersands. A number becomes its character; a name is looked up in the table of the HTML standard
(Python's own copy), and where it is none, its longest beginning that counts without a semicolon. Numbers of no character
follow the standard too.
"""

from __future__ import annotations

import html
import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .phrases import once

LOST = "�"


def _table(values: dict) -> Column:
    """A constant map of strings, one node of the plan."""
    return F.from_json(F.lit(json.dumps(values)), "map<string,string>")


NAMES = dict(html5)
#: Looked up first, as most references are of these.
COMMON = {k: html5[k] for k in ("amp;", "lt;", "gt;", "quot;", "nbsp;", "apos;", "copy;", "middot;", "ndash;", "mdash;", "rsquo;", "bull;")}
#: Names that count without a semicolon, by length.
OPEN = {n: sorted(k for k in html5 if not k.endswith(";") and len(k) == n) for n in sorted({len(k) for k in html5 if not k.endswith(";")})}
ODD = {str(k): v for k, v in html._invalid_charrefs.items()} | {str(k): "" for k in html._invalid_codepoints if k not in html._invalid_charrefs}


def _character(code: Column) -> Column:
    """The character of a number; null is a number too large to be one."""
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    known = F.get(F.array(_table(ODD)), F.lit(0))[code.cast("string")]
    lost = code.isNull() | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    return F.when(known.isNotNull(), known).when(lost, LOST).otherwise(plain)


def _decoded(p: Column) -> Column:
    """What follows an ampersand, decoded as far as it is a reference."""
    number, name = F.regexp_extract(p, r"^#([0-9]+|[xX][0-9a-fA-F]+)", 1), F.regexp_extract(p, r"^([^\t\n\f <&#;]{1,32};?)", 1)

    def numbered(n: Column) -> Column:
        hexed = F.lower(F.left(n, F.lit(1))) == "x"
        bare = F.regexp_replace(F.regexp_replace(n, "^[xX]", ""), "^0+(?=.)", "")
        fits = F.length(bare) <= F.when(hexed, 8).otherwise(10)
        code = F.when(fits, F.when(hexed, F.conv(bare, 16, 10)).otherwise(bare).try_cast("bigint"))
        rest = F.substr(p, F.length(n) + 2)
        return F.concat(_character(code), F.when(F.left(rest, F.lit(1)) == ";", F.substr(rest, F.lit(2))).otherwise(rest))

    def named(s: Column) -> Column:
        whole = F.coalesce(_table(COMMON)[s], _table(NAMES)[s])
        begun = F.coalesce(*[F.when(F.left(s, F.lit(n)).isin(*names), F.left(s, F.lit(n))) for n, names in reversed(OPEN.items())])
        part = once(begun, lambda b: F.when(b.isNotNull(), F.concat(_table(NAMES)[b], F.substr(p, F.length(b) + 1))).otherwise(F.concat(F.lit("&"), p)))
        return once(whole, lambda w: F.when(w.isNotNull(), F.concat(w, F.substr(p, F.length(s) + 1))).otherwise(part))

    return F.when(number != "", once(number, numbered)).when(name != "", once(name, named)).otherwise(F.concat(F.lit("&"), p))


def unescape(c: Column) -> Column:
    """Character references decoded, as Python's html.unescape does; null stays null."""
    parts = F.split(c, "&", -1)
    return once(parts, lambda x: F.concat(F.get(x, F.lit(0)), F.array_join(F.transform(F.slice(x, 2, F.size(x)), _decoded), "")))
