"""Conversation structure repair.  [operator 11]

A conversation is repaired when the initials of its roles are ``(s?(ua)+)?``.  A row may
be kept (K), get the role user or assistant (R, cost 3) or be deleted (D, cost 4); an
empty row of user or assistant may be inserted anywhere (I, cost 3).  Blank and repeated
rows have to be deleted, and a truncated row that stays adds 3.  The cheapest edits are
found by a forward Viterbi pass over the four states of the grammar: for each state the
least (cost, letters of the edits), each row's layer closed by inserts.  Two in a row
reach every state that inserts can reach, so two steps close a layer.

Rows stream by conversation through a task, twice: first without texts, for the pass, and
then with texts, to be edited.  What a task holds of a conversation is one letter a row
and, for each state, the letters in which states still differ.

Cases with a defined result
  null conv_id       a conversation of its own
  null turn          before all others
  null role or text  one space: a role outside the grammar, a blank text
  empty role         outside the grammar
  empty text         blank
  long texts         read once; nothing is cut
  equal turns        in order of role and then of the text's hash
  ties               the letters that come first in ASCII
  no row left        an empty conversation: all counts 0, no letters
  empty table        an empty result
  extra columns      left out
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import begin_task

SPACE = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
RE_ROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a role's initial leads to.
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
LEGAL = ("su", "ua", "au")
ROLE = {"u": "user", "a": "assistant"}
# rows between two looks at what all states share
_SETTLE = 64

Layer = list[tuple[int, str] | None]


def _offer(layer: Layer, state: int, cost: int, letters: str) -> None:
    if layer[state] is None or (cost, letters) < layer[state]:
        layer[state] = (cost, letters)


def close(layer: Layer) -> Layer:
    """The layer with what inserts reach: from any state the next of user and assistant, twice."""
    for _ in range(2):
        before = list(layer)
        for state, best in enumerate(before):
            if best is not None:
                _offer(layer, ASSISTANT if state == USER else USER, best[0] + INSERT, best[1] + "I")
    return layer


def advance(layer: Layer, initial: str, fault: int) -> Layer:
    """The layer after a row."""
    out: Layer = [None] * 4
    stay = CUT if fault == TRUNCATED else 0
    for state, best in enumerate(layer):
        if best is None:
            continue
        cost, letters = best
        _offer(out, state, cost + DELETE, letters + "D")
        if fault in (BLANK, DUPLICATE):
            continue
        if initial in NEXT[state]:
            _offer(out, NEXT[state][initial], cost + stay, letters + "K")
        for other in "ua":
            if other != initial and other in NEXT[state]:
                _offer(out, NEXT[state][other], cost + RE_ROLE + stay, letters + "R")
    return close(out)


class Viterbi:
    """The cheapest edits of one conversation, row by row."""

    def __init__(self) -> None:
        self.layer = close([(0, ""), None, None, None])
        self.settled: list[str] = []
        self.n = 0

    def add(self, initial: str, fault: int) -> None:
        self.layer = advance(self.layer, initial, fault)
        self.n += 1
        if self.n % _SETTLE == 0:
            self._settle()

    def _settle(self) -> None:
        """Set aside the letters that all states share.

        Whatever follows costs at most a deletion more from ASSISTANT than from START, and no
        more than from SYSTEM, so a state that is dearer than that can no longer win.
        """
        layer, done = self.layer, self.layer[ASSISTANT]
        for state, more in ((START, DELETE), (SYSTEM, 0)):
            if layer[state] is not None and layer[state][0] > done[0] + more:
                layer[state] = None
        shared = os.path.commonprefix([best[1] for best in layer if best is not None])
        if shared:
            self.settled.append(shared)
            self.layer = [None if best is None else (best[0], best[1][len(shared) :]) for best in layer]

    def result(self) -> tuple[int, str]:
        """(cost, letters)."""
        cost, letters = min(best for best in (self.layer[START], self.layer[ASSISTANT]) if best is not None)
        return cost, "".join(self.settled) + letters


class _Conversation:
    def __init__(self) -> None:
        self.faults = [0, 0, 0, 0]
        self.illegal = self.different = 0
        self.low = self.high = self.before = None
        self.viterbi = Viterbi()
        self.letters: str | None = None
        self.cost = self.at = self.place = 0
        self.role = ""

    def look(self, turn: int | None, initial: str, fault: int) -> None:
        self.faults[fault] += 1
        if turn is not None:
            if turn != self.high:
                self.different += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        if self.before is not None and self.before + initial not in LEGAL:
            self.illegal += 1
        self.before = initial
        self.viterbi.add(initial, fault)

    def decide(self) -> None:
        if self.letters is None:
            self.cost, self.letters = self.viterbi.result()

    def _put(self, edit: str, role: str, text: str) -> tuple:
        self.role = role[:1]
        self.place += 1
        return self.place - 1, edit, role, text

    def _next_role(self) -> str:
        return "assistant" if self.role == "u" else "user"

    def inserts(self) -> Iterator[tuple]:
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            self.at += 1
            yield self._put("I", self._next_role(), "")

    def edit(self, role: str, text: str) -> Iterator[tuple]:
        """The rows that stand for the next row, with what is inserted before it."""
        self.decide()
        yield from self.inserts()
        letter = self.letters[self.at]
        self.at += 1
        if letter != "D":
            yield self._put(letter, role if letter == "K" else self._next_role(), text)

    def summary(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.different
        return {"gaps": gaps, "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE], "truncated": self.faults[TRUNCATED], "illegal": self.illegal, "cost": self.cost, "audit": self.letters}


SUMMARY = "struct<gaps:long,blank:long,duplicate:long,truncated:long,illegal:long,cost:long,audit:string>"
_BATCH_ROWS, _BATCH_CHARS = 4096, 1 << 20


def repair(rows: DataFrame) -> DataFrame:
    """The repaired conversations of ``rows(conv_id, turn, role, text)``: (conv_id, place, edit, role, text, summary).

    A conversation's rows follow each other in order of ``place``; behind the last is one
    with its ``summary`` and nothing else.  A row with a false ``present``, where there is
    such a column, only says that its conversation exists.
    """
    present = F.coalesce("present", F.lit(True)) if "present" in rows.columns else F.lit(True)
    space = F.lit(SPACE)
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), present.alias("present"))
    end = F.rtrim("text", space)
    plain = plain.withColumns({"_hash": F.sha2(F.col("text").cast("binary"), 256), "_blank": end == "", "_cut": ~F.right(end, F.lit(1)).isin(".", "!", "?")})
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # one shuffle: what follows goes by conversation, and within one by role and text
    dealt = plain.repartition(n, "conv_id")
    earlier = F.row_number().over(Window.partitionBy("conv_id", "present", "role", "_hash").orderBy("turn")) > 1
    fault = F.when(F.col("_blank"), BLANK).when(F.col("_again"), DUPLICATE).when(F.col("_cut"), TRUNCATED).otherwise(0)
    marked = dealt.withColumn("_again", earlier).withColumn("fault", fault.cast("int"))
    twice = marked.select("conv_id", F.explode(F.when(F.col("present"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_pass"), "turn", "role", "text", "_hash", "_again", "fault", "present")
    twice = twice.withColumn("text", F.when(F.col("_pass") == 1, F.col("text")))
    ordered = twice.sortWithinPartitions("conv_id", "_pass", "turn", "role", "_hash", "_again")  # of equal rows, that which is no repetition first
    kind = rows.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(_edited, f"conv_id {kind}, place long, edit string, role string, text string, summary {SUMMARY}")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begin_task("turns")
    current, state, out, chars, schema = None, None, [], 0, None
    row_type = pa.struct([(f, pa.int64()) for f in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        types = [schema, pa.int64(), pa.string(), pa.string(), pa.string(), row_type]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv_id", "place", "edit", "role", "text", "summary"])

    def closing() -> Iterator[tuple]:
        state.decide()
        for new in state.inserts():
            yield (current, *new, None)
        yield (current, None, None, None, None, state.summary())

    for batch in batches:
        schema = batch.schema.field("conv_id").type
        for conv, again, turn, role, text, fault, present in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "_pass", "turn", "role", "text", "fault", "present"))):
            if state is None or conv != current:
                if state is not None:
                    out.extend(closing())
                current, state = conv, _Conversation()
            if again:
                chars += len(text)
                out.extend((conv, *new, None) for new in state.edit(role, text))
            elif present:
                state.look(turn, role[:1], fault)
            if len(out) >= _BATCH_ROWS or chars >= _BATCH_CHARS:
                if out:
                    yield batch_of(out)
                out, chars = [], 0
    if state is not None:
        out.extend(closing())
    if out:
        yield batch_of(out)


def reports(repaired: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of what ``repair`` returns.

    It follows in the same task, where a conversation's rows arrive in order, and takes each text into the hash as it comes.
    """
    kind = repaired.schema["conv_id"].dataType.simpleString()
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, first = hashlib.sha256(), True
        for batch in batches:
            out: list[tuple] = []
            for conv, role, text, summary in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "summary"))):
                if summary is None:
                    digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                    first = False
                else:
                    out.append((conv, *(summary[n] for n in names), digest.hexdigest()))
                    digest, first = hashlib.sha256(), True
            if out:
                types = [batch.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["conv_id", *names, "repaired_sha256"])

    return repaired.mapInArrow(work, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """The rows with the faults of ``op11``, by crc32 of ``conv_id:turn`` modulo 20; a dropped row stays with a false ``present``."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")), F.lit(20))
    rows = rows.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), kind.alias("_kind"))
    rows = rows.withColumn("text", F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))).withColumn("present", F.col("_kind") != 0)
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("_copy", F.explode(copies)).select("conv_id", "turn", "role", "text", "present")
