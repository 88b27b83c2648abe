"""Repair of conversation structure by a square-root checkpointed dynamic program.

A repaired conversation's role initials are ``(s?(ua)+)?``. Each row is kept (cost 0), given the role the place needs
(2) or deleted (3, a must for blank and repeated rows); rows with empty text may be inserted anywhere (2); a
truncated row that stays adds 1. The state is what has been emitted last, so the cost still to come is a vector of four.

Vectors are computed backwards and stored at every square-root-th row only; the walk forward recomputes one block of
vectors at a time and emits, among the edits that are still cheapest, the ASCII-least (D, I, K, R).

Rows are dealt and sorted by ranges of (conversation, turn, role, text), so one conversation may span many tasks. A
conversation inside one range is repaired there. The first and the last of a range may go on in the next one: their
pieces are summed up as cost matrices (one row and column a state), the vectors at the pieces' ends follow from
the matrices, each piece is walked from every state it may be entered in, and the walks that fit together are taken.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from math import isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from dealerlens.llm.common import SPACE, table
from dealerlens.session import materialize

BLANKS = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: The state a placed row leads to; states: nothing yet, after system, after user, after assistant.
PLACED = (2, 2, 3, 2)
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "": (None,) * 4}
ROLE = {2: "user", 3: "assistant"}
LEGAL = {"su", "ua", "au"}
STATES = range(4)
FAR = 1 << 40
#: What the program knows of a row, one byte: its initial if it may be kept anywhere, and whether it must go or is truncated.
CODES = [(initial, fault) for initial in KEPT for fault in ("", "must go", "truncated")]
CODE = {c: i for i, c in enumerate(CODES)}
#: Rows that a task hands on at once.
PART_ROWS = 5000

Vector = tuple[int, int, int, int]


def relaxed(v: list[int]) -> Vector:
    """Costs to come once rows may be inserted before the next one."""
    two, three = min(v[2], INSERT + v[3]), min(v[3], INSERT + v[2])
    return min(v[0], INSERT + two), min(v[1], INSERT + two), two, three


#: Costs to come after the last row.
END = relaxed([0, FAR, FAR, 0])


@functools.lru_cache(maxsize=1 << 16)
def before(code: int, after: Vector) -> tuple[Vector, int]:
    """The vector before a row, less its least cost, and that cost."""
    initial, fault = CODES[code]
    v = [DELETE + x for x in after]
    if fault != "must go":
        extra = TRUNCATED * (fault == "truncated")
        for s, kept in zip(STATES, KEPT[initial], strict=True):
            v[s] = min(v[s], REROLE + extra + after[PLACED[s]])
            if kept is not None:
                v[s] = min(v[s], extra + after[kept])
    v = relaxed(v)
    least = min(v)
    return tuple(min(x - least, FAR) for x in v), least


@functools.lru_cache(maxsize=1 << 16)
def edits_at(code: int, state: int, after: Vector) -> tuple[str, int]:
    """The ASCII-least cheapest edits up to and with a row, and the state after it."""
    v, least = before(code, after)
    initial, fault = CODES[code]
    extra = TRUNCATED * (fault == "truncated")
    done = ""
    while True:
        left, kept = v[state] + least, KEPT[initial][state]
        if DELETE + after[state] == left:
            return done + "D", state
        if INSERT + v[PLACED[state]] + least == left:
            done, state = done + "I", PLACED[state]
        elif kept is not None and extra + after[kept] == left:
            return done + "K", kept
        else:
            return done + "R", PLACED[state]


def edits_at_end(state: int) -> tuple[str, int]:
    done = ""
    while END[state]:
        done, state = done + "I", PLACED[state]
    return done, state


def backward(codes: bytes, end: Vector) -> tuple[list[Vector], int, Vector, int]:
    """Vectors after every block of k rows (k the square root), k, the vector before the first row, and the cost taken out of it."""
    k = isqrt(max(len(codes) - 1, 0)) + 1
    marks, v, cost = [], end, 0
    for i in range(len(codes) - 1, -1, -1):
        if (i + 1) % k == 0 or i == len(codes) - 1:
            marks.append(v)
        v, least = before(codes[i], v)
        cost += least
    return marks[::-1], k, v, cost


def walk(codes: bytes, end: Vector, state: int = 0) -> tuple[list[str], int, int]:
    """Edits at each row from ``state`` on, the state at the end, and the cost up to the costs of ``end``."""
    marks, k, first, cost = backward(codes, end)
    cost += first[state]
    edits = []
    for block, v in enumerate(marks):
        part = codes[block * k:(block + 1) * k]
        vectors = [v]
        for code in part[:0:-1]:
            vectors.append(before(code, vectors[-1])[0])
        for code, after in zip(part, reversed(vectors), strict=True):
            done, state = edits_at(code, state, after)
            edits.append(done)
    return edits, state, cost


def matrix(codes: bytes) -> list[list[int]]:
    """Least cost from each state before the rows to each state after them."""
    columns = []
    for s in STATES:
        _, _, v, cost = backward(codes, tuple(0 if t == s else FAR for t in STATES))
        columns.append([min(x + cost, FAR) for x in v])
    return [list(row) for row in zip(*columns, strict=True)]


def joined(m: list[list[int]], after: Vector) -> Vector:
    """Costs to come before the rows of ``m``."""
    return tuple(min(FAR, *(x + y for x, y in zip(row, after, strict=True))) for row in m)


def repaired(edits: Iterable[tuple[str, str, str]], state: int = 0) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each edit of rows given as (edits, role, text)."""
    for done, role, text in edits:
        for e in done:
            if e == "D":
                yield e, role, text
                continue
            state = KEPT[role[:1]][state] if e == "K" else PLACED[state]
            yield e, role if e == "K" else ROLE[state], "" if e == "I" else text


@dataclass
class Faults:
    """Counts over rows of one conversation, in order; two neighbouring stretches add up."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    first: str = ""
    last: str = ""
    rows: int = 0

    def __add__(self, other: Faults) -> Faults:
        if not (self.rows and other.rows):
            return self if self.rows else other
        meets = self.last_turn is not None and self.last_turn == other.first_turn
        return Faults(self.blank + other.blank, self.duplicate + other.duplicate, self.truncated + other.truncated,
                      self.illegal + other.illegal + (self.last + other.first not in LEGAL), self.turns + other.turns - meets,
                      other.first_turn if self.first_turn is None else self.first_turn,
                      self.last_turn if other.last_turn is None else other.last_turn, self.first, other.last, self.rows + other.rows)

    @property
    def gaps(self) -> int:
        return 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns


def fault_of(text: str, repeated: bool) -> str:
    inner = text.strip(BLANKS)
    return "blank" if not inner else "duplicate" if repeated else "truncated" if inner[-1] not in ".!?" else ""


def judged(turns: list, roles: list[str], faults: list[str]) -> tuple[bytes, Faults]:
    """One byte a row for the program, and the counts, of rows in order (null turns first)."""
    initials = [r[:1] for r in roles]
    kinds = {"": "", "truncated": "truncated", "blank": "must go", "duplicate": "must go"}
    codes = bytes(CODE[i if i in KEPT else "", kinds[f]] for i, f in zip(initials, faults, strict=True))
    known = [t for t in turns if t is not None]
    pairs = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
    return codes, Faults(faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), pairs, len(set(known)),
                         known[0] if known else None, known[-1] if known else None, initials[0], initials[-1], len(roles))


@dataclass
class _Rows:
    """Rows of one conversation within one task, in order."""

    conv: object
    start: int = 0
    turns: list = field(default_factory=list)
    roles: list = field(default_factory=list)
    texts: list = field(default_factory=list)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[_Rows]:
    """The stretches of equal conversations of a sorted stream."""
    now, seen = None, 0
    for batch in batches:
        convs, turns, roles, texts = (batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text"))
        at = 0
        while at < len(convs):
            if now is None or convs[at] != now.conv:
                if now is not None:
                    yield now
                now = _Rows(convs[at], seen + at)
            end = at + 1
            while end < len(convs) and convs[end] == now.conv:
                end += 1
            now.turns += turns[at:end]
            now.roles += roles[at:end]
            now.texts += texts[at:end]
            at = end
        seen += len(convs)
    if now is not None:
        yield now


_ROW = ("piece", "start", "seq", "turn", "edit", "role", "text")
_REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
_ROW_SQL = "piece long, start long, seq long, turn long, edit string, role string, text string"
_REPORT_SQL = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
               "repaired_sha256 string")


def _report(faults: Faults, cost: int, audit: str, digest: str) -> tuple:
    return faults.gaps, faults.blank, faults.duplicate, faults.truncated, faults.illegal, cost, audit, digest


def _closed(rows: _Rows) -> tuple[list[tuple[str, str, str]], tuple]:
    """All edits and the report of a conversation that lies within one task."""
    seen, faults = set(), []
    for role, text in zip(rows.roles, rows.texts, strict=True):
        faults.append(fault_of(text, (role, text) in seen))
        seen.add((role, text))
    codes, counts = judged(rows.turns, rows.roles, faults)
    edits, state, cost = walk(codes, END)
    last = edits_at_end(state)[0]
    done = list(repaired([*zip(edits, rows.roles, rows.texts, strict=True), (last, "", "")]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for e, r, t in done if e != "D").encode())
    return done, _report(counts, cost, "".join(edits) + last, digest.hexdigest())


def _repair_within(schema: pa.Schema, with_rows: bool):
    """Conversations of a sorted stream: the inner ones repaired, the rows of the first and the last as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, out = TaskContext.get().partitionId(), []

        def part():
            done = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)],
                                              schema=schema)
            out.clear()
            return done

        def opened(rows: _Rows):
            for k, row in enumerate(zip(rows.turns, rows.roles, rows.texts, strict=True)):
                out.append((rows.conv, piece, rows.start, rows.start + k, row[0], None, *row[1:], *[None] * len(_REPORT)))

        first, waiting = True, None
        for rows in _conversations(batches):
            if first:
                opened(rows)
                first = False
            else:
                if waiting is not None:
                    done, report = _closed(waiting)
                    if with_rows:
                        out += [(waiting.conv, piece, waiting.start, k, None, *e, *[None] * len(_REPORT)) for k, e in enumerate(done)]
                    out.append((waiting.conv, *[None] * len(_ROW), *report))
                waiting = rows
            if len(out) >= PART_ROWS:
                yield part()
        if waiting is not None:
            opened(waiting)
        if out:
            yield part()

    return run


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "first", "last", "rows")
_PIECE_SQL = ("piece long, start long, codes binary, blank long, duplicate long, truncated long, illegal long, turns long, "
              "first_turn long, last_turn long, first string, last string, rows long, matrix array<array<long>>")


def _sum_up(conv: str, schema: pa.Schema):
    """Codes, counts and matrix of one stretch; it lies within one range of the sort."""
    def run(stretch: pa.Table) -> pa.Table:
        rows = stretch.sort_by("seq").to_pydict()
        codes, counts = judged(rows["turn"], rows["role"], rows["fault"])
        return pa.Table.from_pylist([{conv: rows[conv][0], "piece": rows["piece"][0], "start": rows["start"][0], "codes": codes,
                                      "matrix": matrix(codes), **{c: getattr(counts, c) for c in _COUNTS}}], schema=schema)

    return run


def _ends(conv: str, schema: pa.Schema):
    """The vector at the end of each stretch of a conversation and, with the first, its counts and cost."""
    def run(stretches: pa.Table) -> pa.Table:
        rows, v, out, counts = stretches.sort_by([("piece", "ascending"), ("start", "ascending")]).to_pylist(), END, [], Faults()
        for r in reversed(rows):
            out.append({"piece": r["piece"], "start": r["start"], "is_first": r is rows[0], "after": list(v)})
            v = joined(r["matrix"], v)
        for r in rows:
            counts += Faults(*(r[c] for c in _COUNTS))
        out[-1] |= {conv: rows[0][conv], "cost": v[0], "gaps": counts.gaps,
                    **{c: getattr(counts, c) for c in ("blank", "duplicate", "truncated", "illegal")}}
        return pa.Table.from_pylist(out, schema=schema)

    return run


def _walk_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits and last state of each stretch for each state it may be entered in; the first is entered in state 0."""
    for batch in batches:
        for k in range(batch.num_rows):
            r = batch.slice(k, 1).to_pylist()[0]
            least = min(r["after"])
            after = tuple(x - least for x in r["after"])
            walks = [walk(r["codes"], after, s) for s in (STATES[:1] if r["is_first"] else STATES)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["piece"]]), pa.array([r["start"]]), pa.array([[w[0] for w in walks]], pa.list_(pa.list_(pa.string()))),
                 pa.array([[w[1] for w in walks]], pa.list_(pa.int32()))], names=["piece", "start", "edits", "exits"])


def _entries(stretches: pa.Table) -> pa.Table:
    """The state in which each stretch of a conversation is entered."""
    state, out = 0, []
    for r in stretches.sort_by([("piece", "ascending"), ("start", "ascending")]).to_pylist():
        out.append((r["piece"], r["start"], state))
        state = r["exits"][state]
    return pa.table(dict(zip(("piece", "start", "entry"), map(list, zip(*out, strict=True)), strict=True)),
                    schema=pa.schema([("piece", pa.int64()), ("start", pa.int64()), ("entry", pa.int32())]))


def _edited(schema: pa.Schema, with_rows: bool):
    """Edits of a stream sorted by conversation and place carried out; as rows, or as audit and digest of each conversation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, place, digest, audit, now, out = 0, 0, None, [], None, []

        def carry_out(edits):
            nonlocal state, place
            for e, role, text in repaired(edits, state):
                if with_rows:
                    out.append((now, place, e, role, text))
                elif e != "D":
                    digest.update((b"\n" if place else b"") + f"{role}:{text}".encode())
                    place += 1
                place += with_rows
                state = state if e == "D" else KEPT[role[:1]][state] if e == "K" else PLACED[state]
            audit.extend(edits[0][0])

        def close():
            carry_out([(edits_at_end(state)[0], "", "")])
            if not with_rows:
                out.append((now, "".join(audit), digest.hexdigest()))

        def part():
            done = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)],
                                              schema=schema)
            out.clear()
            return done

        for batch in batches:
            for conv, edits, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "edits", "role", "text")), strict=True):
                if digest is None or conv != now:
                    if digest is not None:
                        close()
                    state, place, digest, audit, now = 0, 0, hashlib.sha256(), [], conv
                carry_out([(edits, role, text)])
                if len(out) >= PART_ROWS:
                    yield part()
        if digest is not None:
            close()
        if out:
            yield part()

    return run


class _Repair:
    """The steps over one table of (conv, turn, role, text)."""

    def __init__(self, rows: DataFrame, conv: str, turn: str, role: str, text: str, with_rows: bool):
        self.rows = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
                                *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(a) for c, a in ((role, "role"), (text, "text"))))
        self.kind = self.rows.schema["conv"].dataType
        self.with_rows = with_rows

    def arrow(self, ddl: str) -> pa.Schema:
        fields = StructType.fromDDL(ddl).fields
        return pa.schema([("conv", to_arrow_type(self.kind)), *((f.name, to_arrow_type(f.dataType)) for f in fields)])

    def ddl(self, ddl: str) -> str:
        return f"conv {self.kind.simpleString()}, {ddl}"

    def within(self) -> DataFrame:
        ties = [F.substring("text", 1, 64), F.xxhash64("text")]
        order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), *ties]
        dealt = self.rows.repartitionByRange(*order).sortWithinPartitions(*order)
        ddl = f"{_ROW_SQL}, {_REPORT_SQL}"
        return materialize(dealt.mapInArrow(_repair_within(self.arrow(ddl), self.with_rows), self.ddl(ddl)), "repaired_within")

    def across(self, opened: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Counts of each conversation that may span tasks, and its rows with their edits."""
        key = [F.md5("text").alias("text_md5")]
        first = (opened.groupBy(F.col("conv").alias("of"), F.col("role").alias("same_role"), *key)
                 .agg(F.min(F.struct("piece", "seq")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
        marked = opened.drop("edit").withColumn("md5", F.md5("text")).join(
            first, F.col("conv").eqNullSafe(F.col("of")) & (F.col("role") == F.col("same_role")) & (F.col("md5") == F.col("text_md5")), "left")
        fault = (F.when(~F.col("text").rlike("[^\\x20\\x09-\\x0D]"), "blank")
                 .when(F.col("first") < F.struct("piece", "seq"), "duplicate")
                 .when(~F.col("text").rlike(f"[.!?]{SPACE}*\\z"), "truncated").otherwise(""))
        coded = marked.select("conv", "piece", "start", "seq", "turn", "role", fault.alias("fault"))
        stretches = materialize(coded.groupBy("piece", "start").applyInArrow(
            _sum_up("conv", self.arrow(_PIECE_SQL)), self.ddl(_PIECE_SQL)), "stretches")
        ends_ddl = ("piece long, start long, is_first boolean, after array<long>, gaps long, blank long, duplicate long, "
                    "truncated long, illegal long, cost long")
        ends = materialize(stretches.drop("codes").groupBy("conv").applyInArrow(
            _ends("conv", self.arrow(ends_ddl)), self.ddl(ends_ddl)), "stretch_ends")
        place = ["piece", "start"]
        walks = materialize(stretches.select("conv", "codes", *place).join(ends.select("is_first", "after", *place), place)
                            .select("codes", "is_first", "after", *place)
                            .mapInArrow(_walk_all, "piece long, start long, edits array<array<string>>, exits array<int>"), "walks")
        entries = (walks.drop("edits").join(stretches.select("conv", *place), place).groupBy("conv")
                   .applyInArrow(_entries, "piece long, start long, entry int"))
        edits = walks.join(entries, place).select(*place, F.posexplode(F.expr("edits[entry]")).alias("at", "edits"))
        edits = edits.select(*place, (F.col("start") + F.col("at")).alias("seq"), "edits")
        done = opened.select("conv", *place, "seq", "role", "text").join(edits, [*place, "seq"])
        return ends.filter("is_first").drop("is_first", "after", *place), done

    def carried_out(self, done: DataFrame, ddl: str) -> DataFrame:
        """One task streams a conversation's rows, as its audit and digest are strings over all of them; it holds the audit alone."""
        sort = [F.col("conv").asc_nulls_first(), "piece", "seq"]
        return done.repartition("conv").sortWithinPartitions(*sort).select("conv", "edits", "role", "text").mapInArrow(
            _edited(self.arrow(ddl), self.with_rows), self.ddl(ddl))


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """The cheapest edits of each conversation as rows: conv, place (ascending within a conversation), edit (D, I, K or R),
    and the role and text after it (of a deleted row: as they were).

    Rows are taken by turn (null turns first), ties by role, the text's first 64 characters and its XXH64. Null roles and texts
    read as one space; an empty role may be given a role or deleted, never kept. Null ids are one conversation. Other columns
    are ignored, and an empty table gives no row.
    """
    job = _Repair(rows, conv_col, turn_col, role_col, text_col, True)
    table = job.within()
    _, done = job.across(table.filter("seq is not null and edit is null"))
    closed = table.filter("edit is not null").select("conv", F.col("seq").alias("place"), "edit", "role", "text")
    return closed.unionByName(job.carried_out(done, "place long, edit string, role string, text string"))


def report(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """One row for each conversation with at least a row: conv, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256 of :func:`repair`, whose rules for nulls, ties and repeats hold."""
    job = _Repair(rows, conv_col, turn_col, role_col, text_col, False)
    table = job.within()
    counts, done = job.across(table.filter("seq is not null"))
    digests = job.carried_out(done, "audit string, repaired_sha256 string").withColumnRenamed("conv", "of")
    across = counts.join(digests, F.col("conv").eqNullSafe(F.col("of"))).drop("of")
    return table.filter("audit is not null").select("conv", *_REPORT).unionByName(across)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of conversations after the test damage: by crc32 of ``conv_id:turn`` modulo 20, rows go (0), lose their text (1) or
    their sentence marks (2), stand twice (3) or become the user's (4). Nulls read as one space; null ids and turns stay null."""
    named: list[Column] = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    by = F.crc32(F.concat(named[0], F.lit(":"), named[1])) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    text = F.when(by == 1, "").when(by == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    times = F.when(by == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.filter(by != 0).select("conv_id", "turn", F.when(by == 4, "user").otherwise(role).alias("role"), text.alias("text"),
                                       F.explode(times).alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after the test damage; those without a row left have zeros, an empty audit and the empty string's hash."""
    rows = table(spark, sf_dir, "conversations")
    found = report(damaged(rows))
    defaults = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    return rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select(
        "conv_id", *(F.coalesce(c, defaults.get(c, F.lit(0).cast("long"))).alias(c) for c in _REPORT))
