r"""Chat formatting with a grammar round trip.

A turn is `### role: text</turn>` and a line end; the parser is deterministic: `### ` opens a turn, the first `</turn>`
ends it. Each turn is first rendered plainly and parsed again; where that does not give back role and text, it is
rendered with its conflicting content escaped, marked by `~1` after the role, and parsed again. Escaped content has none
of `\ # < : ~` and line end (in roles) or `\ # <` (in texts), so the second rendering always parses back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, MARK = "### ", "</turn>", "~1"
#: Escapes, in the order of encoding; decoding goes the other way.
TEXT_ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*TEXT_ESCAPES, (":", "\\c"), ("~", "\\t"), ("\n", "\\n"))


def _encode(c: Column, pairs) -> Column:
    for plain, coded in pairs:
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def _decode(c: Column, pairs) -> Column:
    for plain, coded in reversed(pairs):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def render(role: Column, text: Column, escaped: bool) -> Column:
    head = F.concat(F.lit(OPEN), _encode(role, ROLE_ESCAPES), F.lit(MARK)) if escaped else F.concat(F.lit(OPEN), role)
    return F.concat(head, F.lit(": "), _encode(text, TEXT_ESCAPES) if escaped else text, F.lit(CLOSE + "\n"))


def parse(formatted: Column) -> Column:
    """Array of (role, text, escaped) of the turns of a formatted conversation, in time linear in its length."""
    parts = F.split(formatted, OPEN, -1)

    def turn(p: Column) -> Column:
        head = F.substring_index(p, ": ", 1)
        escaped = head.endswith(MARK)
        body = F.substring_index(F.substr(p, F.length(head) + 3), CLOSE, 1)
        role = F.when(escaped, _decode(F.substr(head, F.lit(1), F.length(head) - len(MARK)), ROLE_ESCAPES)).otherwise(head)
        return F.struct(role.alias("role"), F.when(escaped, _decode(body, TEXT_ESCAPES)).otherwise(body).alias("text"), escaped.alias("escaped"))

    return F.transform(F.slice(parts, 2, F.size(parts)), turn)


def format_chats(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """Per conversation: conv_id, formatted, loss_spans (start and length, in code points from 1, of each text of `loss_role`), n_escaped, round_trip.

    Null roles and texts are empty; turns go by turn, then role and text (a null turn first); repeated rows are turns of
    their own; rows with a null conv_id form one conversation. A conversation is one row, so all its turns meet in one
    task; nothing else is gathered. `round_trip` says that parsing gives back exactly the source turns.
    """
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    plain = render(F.col("t.role"), F.col("t.text"), False)
    rows = rows.withColumn("plain", plain)
    back = parse(F.col("plain"))
    rows = rows.withColumn("back", back)
    # a lone turn, followed by the opening of another one, must give back itself
    same = (F.size("back") == 1) & (F.col("back")[0]["role"] == F.col("t.role")) & (F.col("back")[0]["text"] == F.col("t.text")) & ~F.col("back")[0]["escaped"]
    rows = rows.select("conv_id", "t", F.when(same, F.col("plain")).otherwise(render(F.col("t.role"), F.col("t.text"), True)).alias("out"), (~same).cast("long").alias("esc"))
    # where each turn begins: what stands before it, summed in order (partitioned like the grouping that follows)
    before = Window.partitionBy("conv_id").orderBy(F.col("t.turn").asc_nulls_first(), "t.role", "t.text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("out").cast("long")).over(before), F.lit(0)))
    length = F.when(F.col("esc") == 1, F.length(_encode(F.col("t.text"), TEXT_ESCAPES))).otherwise(F.length("t.text"))
    start = F.col("at") + F.length("out") - length - len(CLOSE)
    rows = rows.withColumn("span", F.struct(start.cast("int").alias("start"), length.cast("int").alias("length"), (F.col("esc") == 1).alias("escaped")))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("t.turn", "t.role", "t.text", "at", "out", "span"))).alias("s"), F.sum("esc").alias("n_escaped"))
    convs = convs.select("conv_id", F.array_join(F.col("s.out"), "").alias("formatted"), F.col("s.role").alias("roles"), F.col("s.text").alias("texts"), F.col("s.span").alias("spans"), "n_escaped")
    convs = convs.withColumn("parsed", parse(F.col("formatted")))
    spans = F.filter("spans", lambda s, i: F.get("parsed", i)["role"] == loss_role)
    return convs.select("conv_id", "formatted", spans.alias("loss_spans"), "n_escaped", ((F.col("parsed.role") == F.col("roles")) & (F.col("parsed.text") == F.col("texts"))).alias("round_trip"))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: F.when(s["escaped"], _decode(F.substr(formatted, s["start"], s["length"]), TEXT_ESCAPES)).otherwise(F.substr(formatted, s["start"], s["length"]))), "")
