"""Conversation structure repair: cheapest edits to a grammar of turns, by a backward cost table and a forward walk.

The role initials of a repaired conversation are ``(s?(ua)+)?``. Edits: K keeps a
turn (0), R sets its role to user or assistant (1), D deletes it (2, and nothing
else may happen to blank and repeated turns), I inserts an empty turn of user or
assistant (5). A truncated turn that stays costs 5 more.

``before`` gives what the rest of a conversation costs from each state of the
grammar, from the last turn to the first; ``walk`` then goes forward and takes, of
the edits that keep to that cost, the first by ASCII. Both work on segments: what
a segment costs from each state to each state is a 4 x 4 table, so segments of one
long conversation are worked on by different tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from reconloom.llm.common import SPACES
from reconloom.sources.durable import durable, scratch

NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Role initials with a place in the grammar; a code is four times the initial's index (3: any other) plus the fault.
INITIALS = "sua"
#: States: nothing yet, after system, after user, after assistant. The state after the next regular turn:
NEXT = (2, 2, 3, 2)
#: The state after keeping a turn, by (state, index of the initial).
KEPT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}
REROLE, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
FAR = 1 << 60
NAMES = {2: "user", 3: "assistant"}
#: Conversations with more turns or characters are cut into segments.
LONG_TURNS, LONG_CHARS = 20_000, 1 << 26
#: Turns of a segment, as a power of two.
SEGMENT = 15

SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "position long, edit string, role string, text string"


def _inserting(v: list[int]) -> tuple[int, ...]:
    """Costs from each state when turns may be inserted first."""
    return tuple(min(v[s], INSERT + v[NEXT[s]], 2 * INSERT + v[NEXT[NEXT[s]]]) for s in range(4))


#: Costs after the last turn.
END = _inserting([0, FAR, FAR, 0])


def before(code: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs from each state before a turn, from those after it."""
    initial, fault = divmod(code, 4)
    best = []
    for s in range(4):
        c = DELETE + after[s]
        if fault not in (BLANK, DUPLICATE):
            stays = UNFINISHED if fault == TRUNCATED else 0
            c = min(c, REROLE + stays + after[NEXT[s]])
            if (s, initial) in KEPT:
                c = min(c, stays + after[KEPT[s, initial]])
        best.append(c)
    return _inserting(best)


def costs(codes: bytes, extra: list[int] | None, end: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The table of all turns; ``extra``: how many repetitions follow each turn, each of which is deleted."""
    table = [end]
    for i in range(len(codes) - 1, -1, -1):
        after = table[-1]
        if extra and extra[i]:
            after = tuple(c + DELETE * extra[i] for c in after)
        table.append(before(codes[i], after))
    table.reverse()
    return table


def walk(codes: bytes, extra: list[int] | None, table: list[tuple[int, ...]], state: int, last: bool = True) -> tuple[str, int]:
    """The ASCII-least of the cheapest edits from ``state``, and the state they end in.

    In each state an insertion or a new role can only give one role, so each letter names one transition and the least
    letter at every step gives the least string. ``last``: the conversation ends here, so turns may be inserted at the end."""
    out = []
    for i, code in enumerate(codes):
        initial, fault = divmod(code, 4)
        more = extra[i] if extra else 0
        after = [c + DELETE * more for c in table[i + 1]]
        free, stays = fault not in (BLANK, DUPLICATE), UNFINISHED if fault == TRUNCATED else 0
        while True:
            left = table[i][state]
            if DELETE + after[state] == left:
                out.append("D")
            elif INSERT + table[i][NEXT[state]] == left:
                out.append("I")
                state = NEXT[state]
                continue
            elif free and (state, initial) in KEPT and stays + after[KEPT[state, initial]] == left:
                out.append("K")
                state = KEPT[state, initial]
            else:
                out.append("R")
                state = NEXT[state]
            break
        if more:
            out.append("D" * more)
    while last and table[-1][state]:
        out.append("I")
        state = NEXT[state]
    return "".join(out), state


@lru_cache(maxsize=1 << 16)
def edits(codes: bytes) -> tuple[int, str]:
    """Cost and edits of a whole conversation; conversations with equal codes are worked out once in a task."""
    table = costs(codes, None, END)
    return table[0][0], walk(codes, None, table, 0)[0]


class _Built:
    """One conversation as it is rebuilt, turn by turn; holds its edits and the running hash, no texts."""

    def __init__(self, conv, turns: bool):
        self.conv, self.turns = conv, turns
        self.hash, self.state, self.position, self.kept = hashlib.sha256(), 0, 0, 0
        self.counts = [0, 0, 0, 0]
        self.illegal, self.cost, self.before = 0, 0, None
        self.low = self.high = self.current = None
        self.distinct = 0
        self.audit: list[str] = []

    def seen(self, turn, role: str, fault: int) -> None:
        """A turn as it was before any edit."""
        self.counts[fault] += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if turn is not None and turn != self.current:
            self.low = turn if self.low is None else self.low
            self.high = self.current = turn
            self.distinct += 1

    def edit(self, letter: str, role: str = "", text: str = "", fault: int = NO_FAULT) -> list[tuple]:
        self.audit.append(letter)
        initial = INITIALS.find(role[:1]) if role else 3
        if letter == "D":
            self.cost += DELETE
        elif letter == "K":
            self.state = KEPT[self.state, initial]
        else:
            self.state = NEXT[self.state]
            self.cost += INSERT if letter == "I" else REROLE
            role, text = NAMES[self.state], "" if letter == "I" else text
        if letter != "D":
            self.cost += UNFINISHED if fault == TRUNCATED else 0
            self.hash.update((("\n" if self.kept else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            self.kept += 1
        self.position += 1
        return [(self.conv, self.position - 1, letter, role, text)] if self.turns else []

    def summary(self) -> tuple:
        gaps = 0 if self.low is None else int(self.high) - int(self.low) + 1 - self.distinct
        return (self.conv, gaps, self.counts[BLANK], self.counts[DUPLICATE], self.counts[TRUNCATED], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def _schema(df: DataFrame, output: str) -> StructType:
    return StructType([StructField("conv", df.schema["conv"].dataType), *StructType.fromDDL(SUMMARY if output == "summary" else TURNS).fields])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1024, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of about ``most`` characters."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= size or chars >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def coded(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", dropped: Column | None = None) -> DataFrame:
    """``conv, turn, role, text, code, gone``: what the repair reads. A null role or text is one space."""
    at = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(at == "", BLANK).when(~F.substring(at, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(NO_FAULT)
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1)) - 1
    initial = F.when((F.col("role") == "") | (initial < 0), 3).otherwise(initial)
    rows = messages.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"),
        F.coalesce(dropped if dropped is not None else F.lit(False), F.lit(False)).alias("gone"),
    )
    return rows.select("conv", "turn", "role", "text", (4 * initial + fault).cast("int").alias("code"), "gone")


def repair(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", dropped: Column | None = None, output: str = "summary", long_turns: int = LONG_TURNS, long_chars: int = LONG_CHARS, segment: int = SEGMENT) -> DataFrame:
    """Repair every conversation by its cheapest edits, ties to the ASCII-least string of edits.

    ``output`` "summary" gives one row for each conversation: ``conv, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256``; "turns" gives ``conv, position, edit, role, text``, a row for each edit in order, with the
    role and text after it (those of a deleted turn as they were).

    Turns follow by ``turn`` (nulls first), then role and text by code point. Null roles and texts are one space; an
    empty role has no initial, so its turn cannot stay as it is; rows with a null conversation are one conversation; repeated rows are turns, of which all but the first are duplicates.
    Rows with ``dropped`` are no turns, but their conversation gets a row (zeros, no edits, the hash of nothing). Empty and
    very long texts are turns like others; an empty table gives an empty one; further columns are not read.

    A conversation up to ``long_turns`` turns and ``long_chars`` characters is repaired by the task that gets it, from a
    buffer of that size. Longer ones are found by a count, and cut: duplicates come from an aggregation, turns are dealt
    by ranges, each segment of at most 2**``segment`` rows gives a table of costs from state to state, tables are chained
    for each conversation, and the edits follow segment by segment. One task then streams the sorted turns past their
    edits, for the hash of a conversation is one sequence; it holds a segment's edits and the audit, no texts.
    """
    rows = coded(messages, conv, turn, role, text, dropped)
    sizes = rows.where("not gone").groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    long = durable(sizes.where((F.col("n") > long_turns) | (F.col("chars") > long_chars)).select(F.col("conv").alias("_long"), F.lit(True).alias("_is")), "repair-long")
    if long.isEmpty():
        return _short(rows, output)
    both = rows.join(long, F.col("conv").eqNullSafe(F.col("_long")), "left")
    return _short(both.where("_is is null").select(*rows.columns), output).unionByName(_long(both.where("_is and not gone").select(*rows.columns), output, segment))


def _short(rows: DataFrame, output: str) -> DataFrame:
    """Whole conversations in one task each, from its sorted turns."""
    turns, schema = output == "turns", _schema(rows, output)

    def one(conv, held: list[tuple]) -> Iterator[tuple]:
        built, known, codes = _Built(conv, turns), set(), bytearray()
        for turn, role, text, code in held:
            fault = code % 4
            if fault != BLANK and (role, text) in known:
                fault = DUPLICATE
            known.add((role, text))
            codes.append(code // 4 * 4 + fault)
            built.seen(turn, role, fault)
        at = 0
        for letter in edits(bytes(codes))[1]:
            if letter == "I":
                yield from built.edit(letter)
            else:
                yield from built.edit(letter, held[at][1], held[at][2], codes[at] % 4)
                at += 1
        if not turns:
            yield built.summary()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            now, held, any_ = None, [], False
            for batch in batches:
                for conv, turn, role, text, code, gone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if any_ and conv != now:
                        yield from one(now, held)
                        held = []
                    now, any_ = conv, True
                    if not gone:
                        held.append((turn, role, text, code))
            if any_:
                yield from one(now, held)

        yield from _batches(found(), _arrow(schema))

    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]
    return rows.repartition("conv").sortWithinPartitions(*order).mapInArrow(go, schema)


def _long(rows: DataFrame, output: str, segment: int) -> DataFrame:
    """Conversations cut into segments."""
    with scratch() as made:
        # equal rows are one row with a number; the first of those that share role and text is no duplicate
        own = rows.groupBy("conv", "turn", "role", "text", "code").agg((F.count("*") - 1).alias("extra")).withColumn("same", F.sha2(F.concat("role", F.lit("\n"), "text"), 256))
        when = F.struct(F.col("turn").isNotNull().alias("k"), F.col("turn").alias("t"))
        first = own.groupBy("conv", "same").agg(F.min(when).alias("_when")).select(F.col("conv").alias("_c"), F.col("same").alias("_s"), "_when")
        marked = own.join(first, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("same") == F.col("_s")))
        later = (F.col("code") % 4 != BLANK) & (when != F.col("_when"))
        marked = marked.withColumn("code", F.when(later, F.col("code") - F.col("code") % 4 + DUPLICATE).otherwise(F.col("code")))
        order = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]
        placed = marked.select("conv", "turn", "role", "text", "code", "extra").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
        placed = durable(placed.withColumn("seg", F.shiftright("at", segment)), "repair-placed")
        turn = F.struct("at", "code", "extra")
        segs = placed.groupBy("conv", "seg").agg(F.array_sort(F.collect_list(turn)).alias("turns")).select("conv", "seg", F.col("turns.code").alias("codes"), F.col("turns.extra").alias("extra"))
        segs = durable(segs, "repair-segments")
        ends = durable(_ends(segs), "repair-ends")
        with_end = segs.join(ends.withColumnRenamed("conv", "_c").withColumnRenamed("seg", "_g"), F.col("conv").eqNullSafe(F.col("_c")) & (F.col("seg") == F.col("_g"))).drop("_c", "_g")
        entries = durable(_entries(with_end), "repair-entries")
        with_entry = with_end.join(entries.withColumnRenamed("conv", "_c").withColumnRenamed("seg", "_g"), F.col("conv").eqNullSafe(F.col("_c")) & (F.col("seg") == F.col("_g"))).drop("_c", "_g")
        letters = with_entry.mapInPandas(_letters, StructType([segs.schema["conv"], *StructType.fromDDL("seg long, letters string").fields]))
        both = placed.select("conv", "seg", F.col("at").alias("place"), "turn", "role", "text", "code", "extra").unionByName(letters.withColumn("place", F.lit(-1).cast("long")), allowMissingColumns=True)
        return made.keep(_rebuilt(both, output), "repair-long-result")


def _ends(segs: DataFrame) -> DataFrame:
    """``conv, seg, ends, last``: the costs after each segment."""

    def tables(parts):
        for df in parts:
            out = []
            for codes, extra in zip(df["codes"], df["extra"], strict=True):
                own, more = bytes(codes.tolist()), extra.tolist()
                out.append([c for e in range(4) for c in costs(own, more, tuple(0 if s == e else FAR for s in range(4)))[0]])
            yield pd.DataFrame({"conv": df["conv"], "seg": df["seg"], "way": out})

    def chain(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("seg", ascending=False)
        end, ends = END, []
        for way in df["way"]:
            ends.append(list(end))
            end = tuple(min(min(int(way[4 * e + s]) + end[e], FAR) for e in range(4)) for s in range(4))
        return pd.DataFrame({"conv": df["conv"], "seg": df["seg"], "ends": ends, "last": [k == 0 for k in range(len(df))]})

    kind = segs.schema["conv"]
    ways = segs.mapInPandas(tables, StructType([kind, *StructType.fromDDL("seg long, way array<long>").fields]))
    return ways.groupBy("conv").applyInPandas(chain, StructType([kind, *StructType.fromDDL("seg long, ends array<long>, last boolean").fields]))


def _table(codes, extra, ends) -> tuple[bytes, list[int], list[tuple[int, ...]]]:
    own, more = bytes(codes.tolist()), extra.tolist()
    return own, more, costs(own, more, tuple(int(c) for c in ends))


def _entries(segs: DataFrame) -> DataFrame:
    """``conv, seg, entry``: the state that the walk enters each segment in."""

    def exits(parts):
        for df in parts:
            out = []
            for codes, extra, ends, last in zip(df["codes"], df["extra"], df["ends"], df["last"], strict=True):
                own, more, table = _table(codes, extra, ends)
                out.append([walk(own, more, table, s, last)[1] if table[0][s] < FAR else -1 for s in range(4)])
            yield pd.DataFrame({"conv": df["conv"], "seg": df["seg"], "exits": out})

    def chain(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("seg")
        state, entry = 0, []
        for way in df["exits"]:
            entry.append(state)
            state = int(way[state])
        return pd.DataFrame({"conv": df["conv"], "seg": df["seg"], "entry": entry})

    kind = segs.schema["conv"]
    found = segs.mapInPandas(exits, StructType([kind, *StructType.fromDDL("seg long, exits array<int>").fields]))
    return found.groupBy("conv").applyInPandas(chain, StructType([kind, *StructType.fromDDL("seg long, entry int").fields]))


def _letters(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in parts:
        out = []
        for codes, extra, ends, last, entry in zip(df["codes"], df["extra"], df["ends"], df["last"], df["entry"], strict=True):
            own, more, table = _table(codes, extra, ends)
            out.append(walk(own, more, table, int(entry), last)[0])
        yield pd.DataFrame({"conv": df["conv"], "seg": df["seg"], "letters": out})


def _rebuilt(both: DataFrame, output: str) -> DataFrame:
    """Sorted turns streamed past the edits of their segment."""
    turns, schema = output == "turns", _schema(both, output)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            built, letters, at = None, "", 0

            def inserted():
                nonlocal at
                while at < len(letters) and letters[at] == "I":
                    at += 1
                    yield from built.edit("I")

            for batch in batches:
                names = ("conv", "place", "turn", "role", "text", "code", "extra", "letters")
                for conv, place, turn, role, text, code, extra, own in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names), strict=True):
                    if built is None or conv != built.conv:
                        if built is not None and not turns:
                            yield built.summary()
                        built, letters, at = _Built(conv, turns), "", 0
                    if place == -1:
                        letters, at = own, 0
                        continue
                    # insertions before a turn, the turn, its repetitions; those after a segment's last turn end it
                    yield from inserted()
                    for k in range(extra + 1):
                        fault = code % 4 if not k or code % 4 == BLANK else DUPLICATE
                        built.seen(turn, role, fault)
                        yield from built.edit(letters[at], role, text, fault)
                        at += 1
                    if len(letters) - at <= 2 and letters[at:].strip("I") == "":  # two insertions end any conversation
                        yield from inserted()
            if built is not None and not turns:
                yield built.summary()

        yield from _batches(found(), _arrow(schema))

    return both.repartition("conv").sortWithinPartitions("conv", "seg", "place").mapInArrow(go, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, dropped``: every twentieth turn dropped, emptied, without ends of sentences, repeated or said by the user, by a hash of conversation and turn."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    how = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    hurt = conversations.select(
        "conv_id", "turn", F.when(how == 4, "user").otherwise(role).alias("role"),
        F.when(how == 1, "").when(how == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), (how == 0).alias("dropped"), F.when(how == 3, 2).otherwise(1).alias("_n"),
    )
    return hurt.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")
