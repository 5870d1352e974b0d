"""Structure repair of conversations: the cheapest edits that make the roles `(s?(ua)+)?`, by Viterbi with survivor coalescence.

Four states say what the repaired turns end with so far: nothing (e), a system turn (s), a user turn (u), an assistant turn
(a). Every state keeps its cheapest history, of equal costs the one whose edits are least in ASCII order. Histories are a
tree of backpointers with reference counts: a node that no survivor needs goes at once, and as soon as all survivors
descend from one edit, that edit is final: it joins the audit, its turn joins the running hash, and it leaves memory.
What is unresolved is all that a conversation holds, whatever its length.

Rows meet by conversation in one shuffle and stream through their task in order. Repeats are found before, by
(conversation, role, text), so a task keeps no set of what it has seen.

Defined cases: null text, role and (in the damage key) turn and id are one space; null turns come first; rows of one turn
go by role, then text; a null conv_id is a conversation of its own; an exact repeat of a row is one row more; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"
#: state -> {initial: next state} for kept turns; state -> (role, next state) for turns that get a role or are put in.
KEEPS = {"e": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
GIVEN = {"e": ("user", "u"), "s": ("user", "u"), "u": ("assistant", "a"), "a": ("user", "u")}
#: (state, other state) -> the most by which the rest can cost more from the other state: it may put in turns, and delete
#: a system turn that the first one keeps. A state that is dearer by more than that cannot win, not even tie.
BEHIND = {("e", "a"): 3, ("e", "s"): 4, ("e", "u"): 5, ("s", "a"): 0, ("s", "u"): 2}
LEGAL = {"su", "ua", "au"}


class Node:
    """One edit: its letter, what it adds to the repaired turns, the edit before, the edits after, and its references."""

    __slots__ = ("parent", "letter", "out", "after", "refs")

    def __init__(self, parent: Node | None, letter: str, out: str | None):
        self.parent, self.letter, self.out, self.after, self.refs = parent, letter, out, [], 0
        if parent is not None:
            parent.after.append(self)
            parent.refs += 1


class Repair:
    """Edits of one conversation, given turn by turn. `most` is the largest number of unresolved edits so far."""

    def __init__(self):
        self.root = Node(None, "", None)
        self.root.refs = 1
        # state -> (cost, rank, tail, node): histories compare as (rank, tail), see _rank
        self.best = {"e": (0, 0, "", self.root)}
        self.audit, self.hash, self.first, self.most, self.open = [], hashlib.sha256(), True, 0, 0
        self._grow(self._put_in(dict(self._plain())))

    def _plain(self):
        for state, (cost, rank, tail, node) in self.best.items():
            yield state, (cost, rank, tail, (node, ()))

    def turn(self, role: str, text: str, doomed: bool, truncated: bool) -> None:
        """The next turn; a doomed one (blank or repeated) has to go."""
        new: dict[str, tuple] = {}

        def offer(state, cost, rank, tail, node, letter, out):
            got = (cost, rank, tail + letter, (node, ((letter, out),)))
            if state not in new or got[:3] < new[state][:3]:
                new[state] = got

        kept = f"{role}:{text}"
        for state, (cost, rank, tail, node) in self.best.items():
            offer(state, cost + DELETE, rank, tail, node, "D", None)
            if doomed:
                continue
            cost += TRUNCATED if truncated else 0
            if (to := KEEPS[state].get(role[:1])) is not None:
                offer(to, cost, rank, tail, node, "K", kept)
            as_role, to = GIVEN[state]
            offer(to, cost + REROLE, rank, tail, node, "R", f"{as_role}:{text}")
        self._grow(self._put_in(new))

    def _put_in(self, new: dict[str, tuple]) -> dict[str, tuple]:
        """Turns put in at this place; two in a row are the most that can pay."""
        for _ in range(2):
            for state in [s for s in "esua" if s in new]:
                cost, rank, tail, (node, edits) = new[state]
                role, to = GIVEN[state]
                got = (cost + INSERT, rank, tail + "I", (node, (*edits, ("I", f"{role}:"))))
                if to not in new or got[:3] < new[to][:3]:
                    new[to] = got
        for (state, other), most in BEHIND.items():
            if state in new and other in new and new[state][0] > new[other][0] + most:
                del new[state]
        return new

    def _grow(self, new: dict[str, tuple]) -> None:
        """Chosen histories become nodes, lost ones go, and what all share is written out."""
        old, made, best = [v[3] for v in self.best.values()], {}, {}
        for state, (cost, rank, tail, (node, edits)) in new.items():
            key = (id(node), tuple(x for x, _ in edits))
            for i, (letter, out) in enumerate(edits):
                part = (key[0], key[1][: i + 1])
                if part not in made:
                    made[part] = Node(node, letter, out)
                    self.open += 1
                node = made[part]
            node.refs += 1
            best[state] = (cost, rank, tail, node)
        self.best = best
        for node in old:
            self._drop(node)
        self._rank()
        self.most = max(self.most, self.open)
        while self.root.refs == 1 and len(self.root.after) == 1:
            self._write(self.root.after[0])

    def _drop(self, node: Node) -> None:
        node.refs -= 1
        while node.refs == 0 and node.parent is not None:
            up = node.parent
            up.after.remove(node)
            node.parent = None
            self.open -= 1
            up.refs -= 1
            node = up

    def _write(self, node: Node) -> None:
        self.audit.append(node.letter)
        if node.out is not None:
            self.hash.update((node.out if self.first else "\n" + node.out).encode("utf-8", "surrogatepass"))
            self.first = False
        node.parent, self.root = None, node
        self.open -= 1

    def _rank(self) -> None:
        """Ranks the survivors' whole histories anew, so that later ties compare in constant time.

        Histories of different ranks differ within what they already are, so their order is settled. One that another
        begins with has the same rank, and the rest of the longer one (turns put in) stays its tail.
        """
        order = sorted(self.best, key=lambda s: self.best[s][1:3])
        rank, base = -1, None
        for s in order:
            cost, r, tail, node = self.best[s]
            if base is None or r != base[0] or not tail.startswith(base[1]):
                rank, base = rank + 1, (r, tail)
            self.best[s] = (cost, rank, tail[len(base[1]) :], node)

    def end(self) -> tuple[int, str, str]:
        """(cost, audit, hash) of the cheapest repair."""
        state = min((s for s in "ea" if s in self.best), key=lambda s: self.best[s][:3])
        cost, _, _, node = self.best[state]
        rest = []
        while node is not self.root:
            rest.append(node)
            node = node.parent
        for node in reversed(rest):
            self._write(node)
        return cost, "".join(self.audit), self.hash.hexdigest()


class Conversation:
    """The result row of one conversation from its turns in order."""

    def __init__(self):
        self.repair, self.last, self.rows = Repair(), None, 0
        self.low = self.high = self.seen = None
        self.turns, self.blank, self.duplicate, self.truncated, self.illegal = 0, 0, 0, 0, 0

    def add(self, turn, role: str, text: str, fault: str) -> None:
        if turn is not None and turn != self.seen:
            self.turns, self.seen, self.high = self.turns + 1, turn, turn
            self.low = turn if self.low is None else self.low
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        if self.rows and self.last + role[:1] not in LEGAL:
            self.illegal += 1
        self.rows, self.last = self.rows + 1, role[:1]
        self.repair.turn(role, text, fault in ("blank", "duplicate"), fault == "truncated")

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.repair.end()


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(turns: DataFrame) -> DataFrame:
    """The damage that the repair is tried on: by crc32 of `conv_id:turn` modulo 20, turns are dropped (0: kept here with `dropped`), emptied, stripped of their ends, repeated, or given to the user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), k.alias("k"))
    rows = rows.select(
        "conv_id",
        "turn",
        F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("k") <= 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("k") == 0).alias("dropped"),
        F.explode(F.when(F.col("k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return rows.drop("copy")


def with_faults(turns: DataFrame) -> DataFrame:
    """Adds `fault`: blank, duplicate (role and text seen earlier in the conversation), truncated, or an empty string."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    same = Window.partitionBy("conv_id", F.xxhash64("role", "text"), "role", "text", "dropped").orderBy(F.col("turn").asc_nulls_first())
    return turns.withColumn("nth", F.row_number().over(same)).select("conv_id", "turn", "role", "text", "dropped", _fault(bare, F.col("nth")).alias("fault"))


def _fault(bare: Column, nth: Column) -> Column:
    return F.when(bare == "", "blank").when(nth > 1, "duplicate").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")


def repair(turns: DataFrame) -> DataFrame:
    """A row per conversation of (conv_id, turn, role, text, dropped): its gaps, faults and illegal neighbours, and cost, edits and hash of its cheapest repair.

    Rows marked `dropped` only say that the conversation exists.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    rows = with_faults(turns).repartition("conv_id").sortWithinPartitions(*keys)
    fields = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return rows.mapInArrow(_stream, f"conv_id {kind}, {fields}")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, at, done, kind = None, None, [], None

    def out() -> pa.RecordBatch:
        cols = [pa.array([r[0] for r in done], kind)]
        cols += [pa.array([r[i] for r in done], pa.string() if i > 6 else pa.int64()) for i in range(1, 9)]
        done.clear()
        return pa.RecordBatch.from_arrays(cols, names=["conv_id", *NAMES])

    for b in batches:
        kind = b.schema.field("conv_id").type
        for conv, turn, role, text, dropped, fault in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "dropped", "fault")), strict=True):
            if now is None or conv != at:
                if now is not None:
                    done.append((at, *now.row()))
                now, at = Conversation(), conv
            if not dropped:
                now.add(turn, role, text, fault)
        if done:
            yield out()
    if now is not None:
        done.append((at, *now.row()))
        yield out()
