"""Conversation structure repair: the cheapest edits that give a conversation the roles (s?(ua)+)?.

Rows of a conversation are read by turn (nulls first), then role, then SHA-256 of the text; a repeated row
follows the one it repeats. The first fault of a row counts: blank (nothing but white space), duplicate
(role and text seen earlier), truncated (the last character that isn't white space is none of .!?).
Edits: Keep (0), Rerole to user or assistant (2), Delete (3; blank and duplicate rows must go), Insert a row
of user or assistant with an empty text (2); a truncated row that stays adds 1.

Method: lazy weighted determinisation. Four states know what was put out last (nothing, s, u, a). The vector
of their costs, less its minimum, is one state of a deterministic automaton; a table keeps the successor and
weight of each such state that was met under each kind of row, so that a scan is one look-up a row and the sum
of the weights is the cost. Ties go to the ASCII-least audit, which is settled from the front: so the scan runs from
the last row to the first (costs to go), and the trace runs back against it, from the first row to the last,
along tight arcs, of which it takes the one of the least letters. Labels end in the letter of their row
and no state has two arcs of one label, so the choice at a row settles it.

Scale: equal rows of a turn collapse in map tasks. The table is dealt by ranges of (conv_id, turn, role, hash),
so a conversation that holds a third of all rows is many tasks' work. A conversation inside one
range is repaired there. One that reaches the first or last row of a range is cut into chunks of bounded size;
their cost matrices (4 x 4) are chained by conversation, then their traces; the texts of a chunk become one
blob of lines, and a SHA-256 of a whole conversation, which can't be split, is streamed over these blobs.

Defined cases: a null role or text is one space, and so is a null conv_id or turn within the damage key; a null
conv_id is a conversation of its own, null turns come first and are no turns for gaps. Equal rows are duplicates.
Rows of one turn are ordered as above. An empty role has no initial and can't be kept. A very long text is
handled whole by one task. A conversation of no rows after damage has zeros and the hash of the empty string.
Extra columns, whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A chunk of a conversation that reaches over ranges holds at most so many rows and so many characters of text (and one row more).
CHUNK_ROWS, CHUNK_CHARS = 50_000, 4_000_000

SPACE = " \t\n\x0b\x0c\r"
FAULTS = ("fine", "truncated", "blank", "duplicate")
_INF = 1 << 60
_INITIALS = {"s": 1, "u": 2, "a": 3}
#: Role put out on the way into state 2 (user) and 3 (assistant).
_ROLES = {2: "user", 3: "assistant"}
_INSERT = {0: 2, 1: 2, 2: 3, 3: 2}
_FINAL = (0, 4, 2, 0)
_TAIL = ("", "II", "I", "")
_EMPTY = hashlib.sha256(b"").hexdigest()


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text, copies: rows after damage by crc32('conv:turn') % 20 (0 drops, 1 empties, 2 strips .!?, 3 repeats, 4 makes it user)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"),
        (F.crc32(F.concat(blank(conv_col), F.lit(":"), blank(turn_col)).cast("binary")) % 20).alias("damage"),
    )
    text = F.when(F.col("damage") == 1, F.lit("")).when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.where("damage <> 0").select("conv", "turn", role.alias("role"), text.alias("text"), F.when(F.col("damage") == 3, 2).otherwise(1).cast("long").alias("copies"))


class Automaton:
    """Deterministic states are numbers of normalised cost vectors; a row's code is initial + 4 * fault."""

    def __init__(self):
        self.number: dict[tuple[int, ...], int] = {}
        self.vectors: list[tuple[int, ...]] = []
        self.step: list[dict[int, tuple[int, int]]] = []
        self.choice: list[dict[tuple[int, int], tuple[str, int]]] = []

    def state(self, vector: tuple[int, ...]) -> tuple[int, int]:
        """Number and weight of a cost vector."""
        least = min(vector)
        vector = tuple(x - least if x < _INF else _INF for x in vector)
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.step.append({})
            self.choice.append({})
        return self.number[vector], least

    @staticmethod
    def arcs(code: int, state: int) -> Iterator[tuple[str, int, int]]:
        """Label, cost and next state of every way to read a row of this code; more than two inserts are never cheapest."""
        initial, fault = code & 3, code >> 2
        for inserts in range(3):
            label, cost = "I" * inserts, 2 * inserts
            yield label + "D", cost + 3, state
            if fault < 2:
                wants_assistant = state == 2
                if initial == 1 and state == 0 or initial == 2 and not wants_assistant or initial == 3 and wants_assistant:
                    yield label + "K", cost + fault, initial
                yield label + "R", cost + 2 + fault, 3 if wants_assistant else 2
            state = _INSERT[state]

    def before(self, number: int, code: int) -> tuple[int, int]:
        """The state of costs to go before a row of this code, and its weight."""
        found = self.step[number].get(code)
        if found is None:
            after = self.vectors[number]
            found = self.state(tuple(min(_INF, *(cost + after[to] for _, cost, to in self.arcs(code, q))) for q in range(4)))
            self.step[number][code] = found
        return found

    def scan(self, codes: bytes, exit_costs: tuple[int, ...]) -> tuple[list[int], int]:
        """States before each row and after the last, and the sum of weights."""
        number, total = self.state(exit_costs)
        states, step, before = [number], self.step, self.before
        for code in reversed(codes):
            number, weight = step[number].get(code) or before(number, code)
            total += weight
            states.append(number)
        states.reverse()
        return states, total

    def costs(self, codes: bytes, exit_costs: tuple[int, ...]) -> tuple[int, ...]:
        states, total = self.scan(codes, exit_costs)
        return tuple(x + total if x < _INF else _INF for x in self.vectors[states[0]])

    def trace(self, codes: bytes, states: list[int], state: int) -> tuple[list[str], list[int]]:
        """Labels of the rows and the states after them, along tight arcs from a state."""
        labels, after, choice = [], [], self.choice
        for code, number in zip(codes, states[1:], strict=True):
            found = choice[number].get((code, state))
            if found is None:
                to_go = self.vectors[number]
                arcs = [(cost + to_go[to], label, to) for label, cost, to in self.arcs(code, state)]
                found = choice[number][(code, state)] = min(arcs)[1:]
            label, state = found
            labels.append(label)
            after.append(state)
        return labels, after


def _lines(codes: bytes, labels: list[str], after: list[int], entry: int, kept: Iterator[tuple[str, str]]) -> list[str]:
    """Repaired lines; kept yields role and text of the rows that need not be deleted."""
    out, state = [], entry
    for code, label, to in zip(codes, labels, after, strict=True):
        for _ in range(len(label) - 1):
            state = _INSERT[state]
            out.append(_ROLES[state] + ":")
        if code < 8:
            role, text = next(kept)
            if label[-1] != "D":
                out.append(f"{role if label[-1] == 'K' else _ROLES[to]}:{text}")
        state = to
    return out


def _tail(state: int) -> list[str]:
    return {1: ["user:", "assistant:"], 2: ["assistant:"]}.get(state, [])


def _counts(codes: bytes) -> tuple[int, int, int, int]:
    """blank, duplicate, truncated, illegal adjacent initials."""
    array = np.frombuffer(codes, np.uint8)
    faults, initials = array >> 2, array & 3
    legal = np.isin(initials[:-1] * 4 + initials[1:], (1 * 4 + 2, 2 * 4 + 3, 3 * 4 + 2))
    return int((faults == 2).sum()), int((faults == 3).sum()), int((faults == 1).sum()), max(0, len(array) - 1) - int(legal.sum())


class _Part:
    """Rows of one conversation, in order."""

    def __init__(self, conv):
        self.conv, self.codes, self.roles, self.texts, self.chars = conv, bytearray(), [], [], 0
        self.distinct, self.first, self.last = 0, None, None

    def turn(self, turn) -> None:
        if turn is not None and turn != self.last:
            self.distinct, self.last = self.distinct + 1, turn
            if self.first is None:
                self.first = turn

    def gaps(self) -> int:
        return 0 if self.first is None else self.last - self.first + 1 - self.distinct


def _parts(batches, most_rows: int, most_chars: int):
    """(part, ends its conversation as far as this range tells) of sorted rows."""
    part, first_of_run = None, False
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("conv", "turn", "role", "kind", "n", "code", "text")]
        for conv, turn, role, kind, n, code, text in zip(*columns, strict=True):
            if part is None or conv != part.conv:
                if part is not None:
                    yield part, True
                part = _Part(conv)
            if kind == 0:
                continue
            if kind == 1:  # the row that follows is the first of its role and text
                first_of_run = True
                continue
            part.turn(turn)
            initial, fault = code & 3, code >> 2
            rest = n
            if fault < 2 and first_of_run:
                part.codes.append(code)
                part.roles.append(role)
                part.texts.append(text)
                part.chars += len(text)
                rest -= 1
            first_of_run = False
            deleted = code if fault == 2 else initial + 12
            while rest:
                some = min(rest, max(1, most_rows - len(part.codes)))
                part.codes += bytes([deleted]) * some
                rest -= some
                if rest:
                    yield part, False
                    part = _Part(conv)
            if len(part.codes) >= most_rows or part.chars >= most_chars:
                yield part, False
                part = _Part(conv)
    if part is not None:
        yield part, True


_STATS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_CHUNK = "distinct long, first_turn long, last_turn long, codes binary, roles array<string>, texts array<string>"


def _arrow(kind: str) -> pa.DataType:
    return {"string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}[kind]


def _batch(rows: list[tuple], schema: str, conv_type: pa.DataType | None = None) -> pa.RecordBatch:
    """Rows as a batch; the type of a column named conv is given."""
    fields = [f.strip().split(" ") for f in schema.split(", ")]
    types = [conv_type if name == "conv" else _arrow(kind) for name, kind in fields]
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=[f[0] for f in fields])


def _map(df: DataFrame, work, schema: str, conv: str) -> DataFrame:
    """work(batches) yields lists of rows of schema, in which conv stands for the type of conv."""
    full = schema.replace("conv ?", f"conv {conv}")

    def run(batches):
        kind = None

        def watched():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("conv").type
                yield batch

        for rows in work(watched()):
            if rows:
                yield _batch(rows, schema.replace("conv ?", "conv conv"), kind)

    return df.mapInArrow(run, full)


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most_rows: int = CHUNK_ROWS, most_chars: int = CHUNK_CHARS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation after damage."""
    return _repaired(conversations.select(F.col(conv_col).alias("conv")).distinct(), damaged(conversations, conv_col, turn_col, role_col, text_col), most_rows, most_chars).withColumnRenamed("conv", conv_col)


def _sorted_rows(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows in order within ranges: for each conversation a head (kind 0), before each first of a role and text a mark (kind 1), and the rows (kind 2)."""
    digest = F.sha2(F.col("text").cast("binary"), 256)
    body = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(body == "", 2).when(F.substring(body, -1, 1).isin(".", "!", "?"), 0).otherwise(1)
    initial = F.left("role", F.lit(1))
    code = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0) + 4 * fault
    whole = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("n")).select("conv", "turn", "role", digest.alias("h"), F.lit(2).alias("kind"), "n", code.cast("int").alias("code"), "text")
    firsts = rows.select("conv", "role", digest.alias("h"), F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn")).alias("at"))
    marks = firsts.groupBy("conv", "role", "h").agg(F.min("at").alias("at")).select("conv", F.col("at.turn").alias("turn"), "role", "h", F.lit(1).alias("kind"))
    blank = {"turn": F.lit(None), "role": F.lit(""), "h": F.lit("")}
    heads = convs.select("conv", *(c.cast(rows.schema[n].dataType).alias(n) if n == "turn" else c.alias(n) for n, c in blank.items()), F.lit(0).alias("kind"))
    none = [F.lit(None).cast("long").alias("n"), F.lit(None).cast("int").alias("code"), F.lit(None).cast("string").alias("text")]
    table = whole.unionByName(marks.select("*", *none)).unionByName(heads.select("*", *none))
    return table.repartitionByRange("conv", "turn", "role", "h").sortWithinPartitions("conv", "turn", "role", "h", "kind")


def _repaired(convs: DataFrame, rows: DataFrame, most_rows: int, most_chars: int) -> DataFrame:
    conv = rows.schema["conv"].dataType.simpleString()
    spread = _sorted_rows(convs, rows).withColumn("range", F.spark_partition_id())

    def in_range(batches):
        automaton, number, place, ready = Automaton(), 0, None, []

        def watched():
            nonlocal place
            for batch in batches:
                if batch.num_rows:
                    place = batch.column("range")[0].as_py()
                    yield batch

        def chunk(part):
            nonlocal number
            number += 1
            return part.conv, (place << 32) + number, False, *[None] * 8, part.distinct, part.first, part.last, bytes(part.codes), part.roles, part.texts

        def whole(part):
            codes = bytes(part.codes)
            states, cost = automaton.scan(codes, _FINAL)
            cost += automaton.vectors[states[0]][0]
            labels, after = automaton.trace(codes, states, 0)
            end = after[-1] if after else 0
            lines = _lines(codes, labels, after, 0, zip(part.roles, part.texts, strict=True)) + _tail(end)
            digest = hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()
            return part.conv, None, True, part.gaps(), *_counts(codes), cost, "".join(labels) + _TAIL[end], digest, *[None] * 6

        held, cut_before, first = None, False, True
        for part, ends in _parts(watched(), most_rows, most_chars):
            if held is not None:  # not the last of the range
                before, ended = held
                ready.append(whole(before) if ended and not cut_before and not first else chunk(before))
                first, cut_before = first and not ended, not ended
                if len(ready) >= 256 or not ended:
                    yield ready
                    ready = []
            held = part, ends
        if held is not None:
            ready.append(chunk(held[0]))
        yield ready

    parts = cut(_map(spread, in_range, f"conv ?, piece long, done boolean, {_STATS}, {_CHUNK}", conv))
    done = parts.where("done").select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return done.unionByName(_chained(parts.where("NOT done"), conv))


def _chained(chunks: DataFrame, conv: str) -> DataFrame:
    """Repairs of the conversations that reach over ranges, from their chunks."""

    def measured(batches):
        automaton = Automaton()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                codes = row["codes"]
                # matrix[q][to]: least cost from state q before the chunk to state `to` after it.
                matrix = list(zip(*(automaton.costs(codes, tuple(0 if q == to else _INF for q in range(4))) for to in range(4)), strict=True))
                out.append((row["conv"], row["piece"], row["distinct"], row["first_turn"], row["last_turn"], *_counts(codes), codes[0] if codes else None, codes[-1] if codes else None, [x for line in matrix for x in line]))
            yield out

    sizes = cut(_map(chunks.select("conv", "piece", "distinct", "first_turn", "last_turn", "codes"), measured, "conv ?, piece long, distinct long, first_turn long, last_turn long, blank long, duplicate long, truncated long, illegal long, head long, tail long, matrix array<long>", conv))
    lists = sizes.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("piece", *[c for c in sizes.columns if c not in ("conv", "piece")]))).alias("pieces"))

    def exits(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield _exits(row["conv"], row["pieces"])

    placed = cut(_map(lists, exits, "conv ?, piece long, exit array<long>, last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long", conv))

    def moves(batches):
        automaton = Automaton()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                states, _ = automaton.scan(row["codes"], tuple(row["exit"]))
                ends = [(automaton.trace(row["codes"], states, q)[1] or [q])[-1] if automaton.vectors[states[0]][q] < _INF else q for q in range(4)]
                out.append((row["conv"], row["piece"], ends))
            yield out

    moved = _map(chunks.select("conv", "piece", "codes").join(placed.select("piece", "exit"), "piece"), moves, "conv ?, piece long, ends array<int>", conv)

    def entries(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                state = 0
                for piece in row["pieces"]:
                    out.append((row["conv"], piece["piece"], state))
                    state = piece["ends"][state]
            yield out

    entered = _map(moved.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("piece", "ends"))).alias("pieces")), entries, "conv ?, piece long, entry int", conv)

    def written(batches):
        automaton = Automaton()
        for batch in batches:
            for row in batch.to_pylist():
                codes, entry = row["codes"], row["entry"]
                states, _ = automaton.scan(codes, tuple(row["exit"]))
                labels, after = automaton.trace(codes, states, entry)
                end = after[-1] if after else entry
                lines = _lines(codes, labels, after, entry, zip(row["roles"], row["texts"], strict=True)) + (_tail(end) if row["last"] else [])
                yield [(row["conv"], row["piece"], "".join(labels) + (_TAIL[end] if row["last"] else ""), "\n".join(lines).encode("utf-8", "surrogatepass"), *(row[c] for c in totals))]

    totals = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    known = placed.join(entered.drop("conv"), "piece").drop("conv")
    blobs = _map(chunks.select("conv", "piece", "codes", "roles", "texts").join(known, "piece"), written, "conv ?, piece long, audit string, lines binary, " + ", ".join(f"{c} long" for c in totals), conv)

    def hashed(batches):
        conv_now, seen, digest, audit, values, some = None, False, None, None, None, False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not seen or row["conv"] != conv_now:
                    if seen:
                        out.append((conv_now, *values, "".join(audit), digest.hexdigest()))
                    conv_now, seen, digest, audit, some, values = row["conv"], True, hashlib.sha256(), [], False, [row[c] for c in totals]
                audit.append(row["audit"])
                if row["lines"]:
                    digest.update(b"\n" + row["lines"] if some else row["lines"])
                    some = True
            yield out
        if seen:
            yield [(conv_now, *values, "".join(audit), digest.hexdigest())]

    ordered = blobs.repartition("conv").sortWithinPartitions("conv", "piece")
    return _map(ordered, hashed, "conv ?, " + ", ".join(f"{c} long" for c in totals) + ", audit string, repaired_sha256 string", conv)


def _exits(conv, pieces: list[dict]) -> list[tuple]:
    """Costs to go after each chunk of a conversation, from the last to the first, and its totals."""
    distinct, first, last, tail = 0, None, None, None
    sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    for p in pieces:
        for name in sums:
            sums[name] += p[name]
        if p["head"] is not None:
            if tail is not None and (tail & 3, p["head"] & 3) not in ((1, 2), (2, 3), (3, 2)):
                sums["illegal"] += 1
            tail = p["tail"]
        if p["first_turn"] is not None:
            distinct += p["distinct"] - (last == p["first_turn"])
            first, last = p["first_turn"] if first is None else first, p["last_turn"]
    gaps = 0 if first is None else last - first + 1 - distinct
    to_go, found = _FINAL, []
    for p in reversed(pieces):
        found.append((p["piece"], to_go))
        matrix = p["matrix"]
        to_go = tuple(min(matrix[4 * q + to] + to_go[to] for to in range(4)) for q in range(4))
    cost = to_go[0]
    return [(conv, piece, list(costs), n == 0, gaps, *sums.values(), cost) for n, (piece, costs) in enumerate(found)]
