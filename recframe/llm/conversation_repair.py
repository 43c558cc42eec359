"""Operator 13: conversations repaired to ``(s?(ua)+)?`` at least cost.

A chart parse over spans of messages.  The symbols of the grammar are [p -> q]:
a span that takes the role pattern from state p to state q.  In Chomsky normal
form a symbol is either lexical - one message with its edit, after the insertions
before it (the insertion closure) - or [p -> q] = [p -> r][r -> q] over two
adjacent spans.  A cell holds for each symbol the least (cost, audit); cells are
combined bottom-up, spans of 1, 2, 4, ... messages.  Since there is a rule for
every state r, each cut of a span derives the same cell, so one cut is enough and
a conversation of n messages takes n combinations.  Insertions belong to the
message after them and those at the end to the whole, so no audit of a span is
the beginning of another one and the least audit of a whole is made of least
audits of its parts.

Faults: blank (no character but ASCII white space), duplicate (role and text
seen earlier), truncated (last character but white space not one of .!?); the
first that holds counts.  Edits: Keep 0, Rerole to user or assistant 2, Delete 3
(blank and duplicate messages must go), Insert an empty user or assistant
message 2; an undeleted truncated message costs 1 more.

No conversation is gathered: messages are sorted over ranges of (conversation,
turn, role, digest), each task parses the runs it holds as they stream by, and
the cells of the runs of one conversation are combined again.  Texts enter one
exchange only; the last pass streams each conversation's messages in order
behind its cells (its digest is one sequence), holding its audit and an Arrow
batch.  Repeated rows are counted before any exchange of the parse; their run of
deletions is a power of one cell.

Defined cases: null conv_id, turn, role and text read as one space in the damage
key; a null role or text is one space; null conv_ids are one conversation, null
turns come first; equal turns go by role, then by digest of the text; messages
without role initial s, u or a can only be reroled or deleted; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recframe.llm.common import frugal
from recframe.session import shuffle_partitions

KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 2, 3, 2, 1
_SPACE = r"\x20\x09-\x0D"
#: States of (s?(ua)+)?: 0 nothing yet, 1 after s, 2 after u, 3 after a.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
GOALS = (0, 3)
N = 4
ROLE = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
#: Messages that are kept, kept at a price, or must go.
SOUND, TRUNCATED, REFUSED = 0, 1, 2

Cell = list  # for each symbol p * N + q the least (cost, audit), or None


def _insertions() -> list[list[int | None]]:
    """closure[p][q]: insertions that take p to q."""
    closure: list[list[int | None]] = [[None] * N for _ in range(N)]
    for p in range(N):
        closure[p][p] = 0
        at, k = p, 0
        while True:
            at, k = next(STEP[at, c] for c in "ua" if (at, c) in STEP), k + 1
            if closure[p][at] is not None:
                break
            closure[p][at] = k
    return closure


CLOSURE = _insertions()


def lexical(initial: str, kind: int) -> Cell:
    """The cell of one message."""
    cell: Cell = [None] * (N * N)

    def offer(p: int, q: int, cost: int, letter: str) -> None:
        for start in range(N):
            k = CLOSURE[start][p]
            if k is not None:
                found = (cost + k * INSERT, "I" * k + letter)
                if cell[start * N + q] is None or found < cell[start * N + q]:
                    cell[start * N + q] = found

    for p in range(N):
        offer(p, p, DELETE, "D")
        if kind != REFUSED:
            more = CUT_SHORT if kind == TRUNCATED else 0
            for c in "sua":
                q = STEP.get((p, c))
                if q is not None:
                    if c == initial:
                        offer(p, q, KEEP + more, "K")
                    if c in ROLE:
                        offer(p, q, REROLE + more, "R")
    return cell


LEXICON = {(c, kind): lexical(c, kind) for c in ("s", "u", "a", "") for kind in (SOUND, TRUNCATED, REFUSED)}


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of two adjacent spans."""
    out: Cell = [None] * (N * N)
    for p in range(N):
        for r in range(N):
            a = left[p * N + r]
            if a is None:
                continue
            for q in range(N):
                b = right[r * N + q]
                if b is None:
                    continue
                cost, best = a[0] + b[0], out[p * N + q]
                if best is None or cost < best[0] or (cost == best[0] and a[1] + b[1] < best[1]):
                    out[p * N + q] = (cost, a[1] + b[1])
    return out


def repeated(cell: Cell, times: int) -> Cell | None:
    """The cell of ``times`` equal messages, None for none."""
    out = None
    while times:
        if times & 1:
            out = cell if out is None else combine(cell, out)
        times >>= 1
        if times:
            cell = combine(cell, cell)
    return out


class Chart:
    """Cells of a run of messages; spans of equal length are combined as they
    come, so spans of 1, 2, 4, ... messages wait, shorter ones to the right."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, Cell]] = []

    def add(self, cell: Cell | None, length: int = 1) -> None:
        if cell is None:
            return
        while self.spans and self.spans[-1][0] <= length:
            n, before = self.spans.pop()
            length, cell = length + n, combine(before, cell)
        self.spans.append((length, cell))

    def cell(self) -> Cell | None:
        out = None
        for _, before in reversed(self.spans):
            out = before if out is None else combine(before, out)
        return out


def whole(cell: Cell | None) -> tuple[int, str]:
    """Least (cost, audit) of a conversation, with insertions at its end."""
    if cell is None:
        return 0, ""
    found = []
    for q in range(N):
        for goal in GOALS:
            k = CLOSURE[q][goal]
            if cell[q] is not None and k is not None:
                found.append((cell[q][0] + k * INSERT, cell[q][1] + "I" * k))
    return min(found)


# ------------------------------------------------------------------------- faults
def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the damaged rows."""
    space = F.lit(" ")
    either = lambda c: F.coalesce(F.col(c).cast("string"), space)
    fate = F.crc32(F.concat(either("conv_id"), F.lit(":"), either("turn"))) % 20
    return (conversations.select("conv_id", "turn", either("role").alias("role"), either("text").alias("text"), fate.alias("fate"))
            .where("fate <> 0")
            .select("conv_id", "turn", F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                    F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                    F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
            .drop("copy"))


def _messages(rows: DataFrame) -> DataFrame:
    """Messages with their place in the order: (conv_id, dated, turn, role, digest)."""
    space = F.lit(" ")
    text = F.coalesce(F.col("text"), space)
    return rows.select("conv_id", F.col("turn").isNotNull().alias("dated"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
                       F.coalesce(F.col("role").cast("string"), space).alias("role"), text.alias("text"),
                       F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))


ORDER = ["conv_id", "dated", "turn", "role", "digest"]


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _marked(messages: DataFrame) -> DataFrame:
    """Distinct messages with their number of copies and faults, without texts."""
    blank = ~F.col("text").rlike(f"[^{_SPACE}]")
    ended = F.col("text").rlike(rf"[.!?][{_SPACE}]*\z")
    slim = (messages.select(*ORDER, blank.alias("blank"), (~blank & ~ended).alias("cut"))
            .groupBy(*ORDER, "blank", "cut").agg(F.count("*").alias("copies")))
    first = (slim.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"))
             .agg(F.min(F.struct("dated", "turn")).alias("at"))
             .select("c", "r", "d", F.col("at.dated").alias("first_dated"), F.col("at.turn").alias("first_turn")))
    seen = (_same("conv_id", "c") & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
            & (F.col("dated") == F.col("first_dated")) & (F.col("turn") == F.col("first_turn")))
    return (slim.join(first, seen, "left")
            .select(*ORDER, "copies", "blank", "cut", F.col("d").isNull().alias("again"), F.substring("role", 1, 1).alias("initial")))


class Run:
    """Faults and cells of consecutive messages of one conversation."""

    COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")

    def __init__(self) -> None:
        self.n = dict.fromkeys(self.COUNTS, 0)
        self.chart, self.first, self.last, self.low, self.high = Chart(), None, None, None, None

    def _meet(self, initial: str, low: int | None, high: int | None, turns: int) -> None:
        if self.last is None:
            self.first = initial
        else:
            self.n["illegal"] += (self.last + initial) not in LEGAL
        self.n["turns"] += turns - (turns > 0 and self.high is not None and self.high == low)
        self.low = low if self.low is None else self.low
        self.high = high if high is not None else self.high

    def message(self, initial: str, turn: int | None, copies: int, blank: bool, again: bool, cut: bool) -> None:
        self._meet(initial, turn, turn, int(turn is not None))
        self.last = initial
        self.n["illegal"] += copies - 1
        known = initial if initial in ("s", "u", "a") else ""
        refused = copies
        if blank:
            self.n["blank"] += copies
        elif again:
            self.n["duplicate"] += copies
        else:
            refused -= 1
            self.n["duplicate"] += refused
            self.n["truncated"] += cut
            self.chart.add(LEXICON[known, TRUNCATED if cut else SOUND])
        if refused:
            self.chart.add(repeated(LEXICON[known, REFUSED], refused), refused)

    def append(self, row: dict) -> None:
        """A later run of the same conversation."""
        self._meet(row["first"], row["low"], row["high"], row["turns"])
        self.last = row["last"]
        for k in self.COUNTS[:4]:
            self.n[k] += row[k]
        self.chart.add([None if c is None else (c, a) for c, a in zip(row["costs"], row["audits"], strict=True)], row["length"])

    def row(self) -> dict:
        cell = self.chart.cell()
        return {**self.n, "first": self.first, "last": self.last, "low": self.low, "high": self.high, "length": sum(n for n, _ in self.chart.spans),
                "costs": [c and c[0] for c in cell], "audits": [c and c[1] for c in cell]}


RUN = ("run struct<blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,turns:bigint,first:string,last:string,low:bigint,high:bigint,"
       "length:bigint,costs:array<bigint>,audits:array<string>>")
_RUN = pa.struct([(k, pa.int64()) for k in Run.COUNTS] + [("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64()),
                 ("length", pa.int64()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the sorted messages of one partition: (conv_id, part, run)."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    run, conv, kind, done = None, None, None, []

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), pa.array([part] * len(done), pa.int32()), pa.array([r for _, r in done], _RUN)],
                                          ["conv_id", "part", "run"])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for c, dated, turn, copies, blank, cut, again, initial in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "dated", "turn", "copies", "blank", "cut", "again", "initial")), strict=True):
            if run is None or c != conv:
                if run is not None:
                    done.append((conv, run.row()))
                run, conv = Run(), c
            run.message(initial, turn if dated else None, copies, blank, again, cut)
        if done:
            yield packed()
            done = []
    if run is not None:
        done.append((conv, run.row()))
        yield packed()


class Repair:
    """Replays an audit over the messages of a conversation."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _new(self) -> str:
        letter = next(c for c in "ua" if (self.state, c) in STEP)
        self.state = STEP[self.state, letter]
        return ROLE[letter]

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._new(), "", "I"

    def message(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = STEP[self.state, role[0]]
            yield role, text, edit
        elif edit == "R":
            yield self._new(), text, edit


class _Digest:
    """One row per conversation."""

    NAMES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    SCHEMA = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    TYPES = (*[pa.int64()] * 6, pa.string(), pa.string())

    def __init__(self, conv: object, run: Run, cost: int, audit: str):
        gaps = 0 if run.low is None else run.high - run.low + 1 - run.n["turns"]
        self.head = (conv, gaps, *(run.n[k] for k in Run.COUNTS[:4]), cost, audit)
        self.sha, self.between = hashlib.sha256(), b""

    def add(self, role: str, text: str, edit: str) -> Iterator[tuple]:
        self.sha.update(self.between + f"{role}:{text}".encode())
        self.between = b"\n"
        return iter(())

    def close(self) -> Iterator[tuple]:
        yield (*self.head, self.sha.hexdigest())


class _Rows:
    """One row per message of the repaired conversation."""

    NAMES = ("conv_id", "position", "role", "text", "edit")
    SCHEMA = "position long, role string, text string, edit string"
    TYPES = (pa.int64(), pa.string(), pa.string(), pa.string())

    def __init__(self, conv: object, run: Run, cost: int, audit: str):
        self.conv, self.position = conv, -1

    def add(self, role: str, text: str, edit: str) -> Iterator[tuple]:
        self.position += 1
        yield self.conv, self.position, role, text, edit

    def close(self) -> Iterator[tuple]:
        return iter(())


def _replay(sink: type) -> object:
    """Streams (conv_id, stage: 0 the name, 1 its runs, 2 its messages)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, conv, parsed, repair, out = None, None, None, None, None

        def begin() -> None:
            nonlocal repair, out
            if out is None:
                cost, audit = whole(parsed.chart.cell())
                repair, out = Repair(audit), sink(conv, parsed, cost, audit)

        def end() -> Iterator[tuple]:
            if parsed is not None:
                begin()
                for message in repair.inserted():
                    yield from out.add(*message)
                yield from out.close()

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (kind, *sink.TYPES), strict=True)], list(sink.NAMES))

        rows: list[tuple] = []
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for c, stage, role, text, one in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "stage", "role", "text", "run")), strict=True):
                if stage == 0:
                    rows.extend(end())
                    conv, parsed, repair, out = c, Run(), None, None
                elif stage == 1:
                    parsed.append(one)
                else:
                    begin()
                    for message in repair.message(role, text):
                        rows.extend(out.add(*message))
            if rows:
                yield packed(rows)
                rows = []
        rows.extend(end())
        if rows:
            yield packed(rows)

    return run


def _repaired(rows: DataFrame, names: DataFrame, sink: type) -> DataFrame:
    parts = shuffle_partitions(rows.sparkSession)
    messages = _messages(rows)
    conv = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}"
    runs = (_marked(messages).repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER)
            .mapInArrow(frugal(_parse), f"{conv}, part int, {RUN}"))
    stream = (names.select("conv_id", F.lit(0).alias("stage")).distinct()
              .unionByName(runs.withColumn("stage", F.lit(1)), allowMissingColumns=True)
              .unionByName(messages.withColumn("stage", F.lit(2)), allowMissingColumns=True))
    place = ["conv_id", "stage", "part", "dated", "turn", "role", "digest"]
    return (stream.repartition(parts, "conv_id").sortWithinPartitions(*place)
            .select("conv_id", "stage", "role", "text", "run").mapInArrow(frugal(_replay(sink)), f"{conv}, {sink.SCHEMA}"))


def repair(conversations: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), role, text and edit
    (K, R or I) of each message."""
    return _repaired(conversations, conversations, _Rows)


def repair_digest(conversations: DataFrame) -> DataFrame:
    """The columns of the registered query: damage, then repair."""
    return _repaired(damage(conversations), conversations, _Digest)


def _sql() -> str:
    """The same by dynamic programming over message prefixes in DuckDB."""
    closure = [f"({p},{q},{k},'{names}')" for p in range(N) for q in range(N) if (k := CLOSURE[p][q]) is not None
               for names in ["".join("\\n" + ROLE[c] + ":" for c in _path(p, k))]]
    steps = [f"({p},'{c}',{q})" for (p, c), q in STEP.items()]
    return rf"""
with recursive
raw as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
               coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations),
hashed as (
  select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(k) + 1), lambda i: unicode(k[i])::bigint)),
                lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda z: 0::bigint)),
                                         lambda x, y: xor(x >> 1, (x & 1) * 3988292384::bigint))), 4294967295::bigint) % 20 as fate
  from raw),
damaged as (
  select conv_id, turn, case when fate = 4 then 'user' else role end as role,
         case when fate = 1 then '' when fate = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from hashed, lateral (select unnest(case when fate = 3 then [0, 1] else [0] end) as copy) where fate <> 0),
placed as (
  select *, row_number() over o as i,
         not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') as ended,
         lag(substr(role, 1, 1)) over o || substr(role, 1, 1) as pair
  from damaged window o as (partition by conv_id order by turn nulls first, role, sha256(text))),
faults as (
  select *, case when blank or again then 2 when not ended then 1 else 0 end as kind
  from (select *, row_number() over (partition by conv_id, role, text order by i) > 1 as again from placed)),
closure(p, q, k, names) as (values {", ".join(closure)}),
steps(p, c, q) as (values {", ".join(steps)}),
edits(p, q, c, letter, price, kind) as (
  select p, p, null, 'D', {DELETE}, kind from (select unnest([0, 1, 2, 3]) as p), (select unnest([0, 1, 2]) as kind)
  union all select p, q, c, 'K', {KEEP} + kind * {CUT_SHORT}, kind from steps, (select unnest([0, 1]) as kind)
  union all select p, q, c, 'R', {REROLE} + kind * {CUT_SHORT}, kind from steps, (select unnest([0, 1]) as kind) where c <> 's'),
moves as (
  select n.p as src, e.q as dst, e.c, e.letter, e.kind, n.k * {INSERT} + e.price as price, repeat('I', n.k) || e.letter as audit, n.names
  from closure n join edits e on e.p = n.q),
dp as (
  select conv_id, 0::bigint as i, 0 as state, 0 as cost, '' as audit, '' as written from (select distinct conv_id from faults)
  union all
  select conv_id, i, state, min(cost) as cost, substr(min(lpad(cast(cost as varchar), 12, '0') || audit), 13) as audit,
         arg_min(written, lpad(cast(cost as varchar), 12, '0') || audit) as written
  from (select f.conv_id, f.i, m.dst as state, d.cost + m.price as cost, d.audit || m.audit as audit,
               d.written || replace(m.names, '\n', chr(10)) || case m.letter when 'D' then '' when 'K' then chr(10) || f.role || ':' || f.text
                 else chr(10) || case m.c when 'u' then 'user:' else 'assistant:' end || f.text end as written
        from dp d join faults f on f.conv_id is not distinct from d.conv_id and f.i = d.i + 1
        join moves m on m.src = d.state and m.kind = f.kind and (m.letter <> 'K' or m.c = substr(f.role, 1, 1)))
  group by conv_id, i, state),
lengths as (select conv_id, count(*) as n from faults group by conv_id),
ends as (
  select d.conv_id, d.cost + c.k * {INSERT} as cost, d.audit || repeat('I', c.k) as audit, d.written || replace(c.names, '\n', chr(10)) as written
  from dp d join lengths l on l.conv_id is not distinct from d.conv_id and l.n = d.i join closure c on c.p = d.state and c.q in (0, 3)),
best as (
  select conv_id, min(cost) as cost, substr(min(lpad(cast(cost as varchar), 12, '0') || audit), 13) as audit,
         arg_min(written, lpad(cast(cost as varchar), 12, '0') || audit) as written
  from ends group by conv_id),
counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank,
         count(*) filter (again and not blank) as duplicate, count(*) filter (kind = 1) as truncated,
         count(*) filter (i > 1 and pair not in ('su', 'ua', 'au')) as illegal
  from faults group by conv_id)
select o.conv_id, cast(coalesce(c.gaps, 0) as bigint) as gaps, coalesce(c.blank, 0) as blank, coalesce(c.duplicate, 0) as duplicate,
       coalesce(c.truncated, 0) as truncated, coalesce(c.illegal, 0) as illegal, cast(coalesce(b.cost, 0) as bigint) as cost,
       coalesce(b.audit, '') as audit, sha256(coalesce(substr(b.written, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join counted c on c.conv_id is not distinct from o.conv_id left join best b on b.conv_id is not distinct from o.conv_id
"""


def _path(state: int, k: int) -> str:
    """Role initials of k insertions from a state."""
    out = ""
    for _ in range(k):
        c = next(c for c in "ua" if (state, c) in STEP)
        out, state = out + c, STEP[state, c]
    return out


SQL = _sql()
