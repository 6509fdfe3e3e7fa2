"""Repair of damaged conversations by a generalised LR parse with weighted edits.

The grammar of roles is turned into LR(0) states. A conversation's rows are read
left to right over a graph-structured stack: every live stack keeps the least
``(cost, audit)`` that leads to it, stacks share their lower parts, and each
row may be kept, given another role or deleted, with rows inserted anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldcast.llm.common import staged, table

#: ``(s?(ua)+)?`` over role initials.
GRAMMAR = (("talk", ()), ("talk", ("turns",)), ("talk", ("s", "turns")), ("turns", ("u", "a")), ("turns", ("turns", "u", "a")))
#: Roles that a row may be given or inserted with.
MADE = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 2, 3, 2, 1
SPACE = "".join(map(chr, (32, *range(9, 14))))
#: Conversations beyond either bound are read in segments by many tasks.
WHOLE_ROWS, WHOLE_CHARS = 10_000, 1 << 25
SEGMENT = 2048
REMEMBERED = 50_000


class Parser:
    """LR(0) states of a grammar, and its stacks as shared nodes ``(state, below)``."""

    def __init__(self, rules=GRAMMAR) -> None:
        self.rules = (("", (rules[0][0],)), *rules)
        self.heads = {head for head, _ in self.rules}
        self.kernels: dict[frozenset, int] = {}
        self.items: list[frozenset] = []
        self.after: list[dict[str, int]] = []
        self.nodes: dict[tuple, tuple] = {}
        self._state(frozenset({(0, 0)}))
        self.start = self._node(0, None)
        self.shifts: dict[tuple, tuple] = {}

    def _state(self, kernel: frozenset) -> int:
        if kernel in self.kernels:
            return self.kernels[kernel]
        number = self.kernels[kernel] = len(self.items)
        items, todo = set(kernel), list(kernel)
        while todo:
            rule, dot = todo.pop()
            body = self.rules[rule][1]
            for k, (head, _) in enumerate(self.rules):
                if dot < len(body) and head == body[dot] and (k, 0) not in items:
                    items.add((k, 0))
                    todo.append((k, 0))
        self.items.append(frozenset(items))
        self.after.append({})
        for symbol in sorted({self.rules[r][1][d] for r, d in items if d < len(self.rules[r][1])}):
            moved = frozenset((r, d + 1) for r, d in items if self.rules[r][1][d : d + 1] == (symbol,))
            self.after[number][symbol] = self._state(moved)
        return number

    def _node(self, state: int, below: tuple | None) -> tuple:
        """The one node of a state on a stack, so that equal stacks are the same object."""
        key = (state, id(below))
        return self.nodes.setdefault(key, (state, below))

    def reduced(self, node: tuple) -> list[tuple]:
        """A stack and all stacks that reductions make of it."""
        found, todo = [node], [node]
        while todo:
            top = todo.pop()
            for rule, dot in self.items[top[0]]:
                head, body = self.rules[rule]
                if dot < len(body) or not head:
                    continue
                under = top
                for _ in body:
                    under = under[1]
                made = self._node(self.after[under[0]][head], under)
                if not any(made is f for f in found):
                    found.append(made)
                    todo.append(made)
        return found

    def shift(self, node: tuple, symbol: str) -> tuple[tuple, ...]:
        """The stacks after reading ``symbol``."""
        key = (id(node), symbol)
        if key not in self.shifts:
            tops = [t for t in self.reduced(node) if symbol in self.after[t[0]]]
            self.shifts[key] = tuple(self._node(self.after[t[0]][symbol], t) for t in tops)
        return self.shifts[key]

    def accepts(self, node: tuple) -> bool:
        return any((0, 1) in self.items[t[0]] for t in self.reduced(node))


Tops = dict[int, tuple[int, str]]


class Repairer:
    """Cheapest edits of rows given as codes: an initial (``?`` for any other), upper case where truncated, ``-`` where a row must go."""

    def __init__(self) -> None:
        self.parser = Parser()
        self.stacks: list[tuple] = []
        self.number: dict[int, int] = {}
        self._of(self.parser.start)
        self.moves: dict[str, list[list[tuple[int, int, str]]]] = {}
        for k, stack in enumerate(self.stacks):  # grows while it is read
            for symbol in "sua":
                for made in self.parser.shift(stack, symbol):
                    self._of(made)
        self.inserts = [self._inserted(k) for k in range(len(self.stacks))]
        self.ends = [self.parser.accepts(stack) for stack in self.stacks]

    def _of(self, stack: tuple) -> int:
        if id(stack) not in self.number:
            self.number[id(stack)] = len(self.stacks)
            self.stacks.append(stack)
        return self.number[id(stack)]

    def _read(self, k: int, symbol: str) -> list[int]:
        return [self._of(made) for made in self.parser.shift(self.stacks[k], symbol)]

    def _inserted(self, k: int) -> list[tuple[int, int]]:
        """Stacks that inserted rows alone lead to, and how many they take."""
        found, edge, n = {k: 0}, [k], 0
        while edge:
            n += 1
            edge = sorted({m for e in edge for symbol in MADE for m in self._read(e, symbol)} - set(found))
            found |= dict.fromkeys(edge, n)
        return [(m, n) for m, n in found.items() if n]

    def _moves(self, code: str) -> list[list[tuple[int, int, str]]]:
        """Per stack: (stack after the row, cost, edit)."""
        if code not in self.moves:
            out = []
            for k in range(len(self.stacks)):
                of_row = [(k, DELETE, "D")]
                if code != "-":
                    late = UNFINISHED * code.isupper()
                    initial = code.lower()
                    if initial in "sua":
                        of_row += [(m, KEEP + late, "K") for m in self._read(k, initial)]
                    of_row += [(m, REROLE + late, "R") for symbol in MADE if symbol != initial for m in self._read(k, symbol)]
                out.append(of_row)
            self.moves[code] = out
        return self.moves[code]

    def with_inserts(self, tops: Tops) -> Tops:
        out = dict(tops)
        for k, (cost, audit) in tops.items():
            for m, n in self.inserts[k]:
                way = (cost + INSERT * n, audit + "I" * n)
                if m not in out or way < out[m]:
                    out[m] = way
        return out

    def run(self, codes: str, tops: Tops) -> Tops:
        """Stacks after the rows. Ways of equal cost to one stack are never prefixes of each other, so the least stays the least."""
        tops = self.with_inserts(tops)
        for code in codes:
            moves, made = self._moves(code), {}
            for k, (cost, audit) in tops.items():
                for m, more, edit in moves[k]:
                    have = made.get(m)
                    if have is None or cost + more < have[0] or (cost + more == have[0] and audit + edit < have[1]):
                        made[m] = (cost + more, audit + edit)
            tops = self.with_inserts(made)
        return tops

    def best(self, tops: Tops) -> tuple[int, str]:
        return min(way for k, way in tops.items() if self.ends[k])

    def repair(self, codes: str) -> tuple[int, str]:
        return self.best(self.run(codes, {0: (0, "")}))


@lru_cache(maxsize=1)
def repairer() -> Repairer:
    """One per worker."""
    return Repairer()


@lru_cache(maxsize=REMEMBERED)
def short_repair(codes: str) -> tuple[int, str]:
    return repairer().repair(codes)


class Digest:
    """SHA-256 of repaired ``role:text`` lines, row by row."""

    def __init__(self, audit: str) -> None:
        self.sha, self.audit, self.at, self.spoken, self.lines = hashlib.sha256(), audit, 0, 0, 0

    def _line(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) * bool(self.lines)}{role}:{text}".encode())
        self.lines += 1

    def _next_role(self) -> str:
        return tuple(MADE.values())[self.spoken % 2]

    def row(self, role: str, text: str) -> None:
        self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return
        if edit == "R":
            role = self._next_role()
        self._line(role, text)
        self.spoken += role[:1] in MADE

    def _inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._line(self._next_role(), "")
            self.spoken += 1
            self.at += 1

    def done(self) -> str:
        self._inserted()
        return self.sha.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the stated damage; nulls of any column are read as one space."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copy")
    ).drop("_copy")


def _with_faults(rows: DataFrame) -> DataFrame:
    """``code``: the row as the parser reads it, blank rows ``-``; ``key``: hash of the text."""
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    initial = F.left("role", F.lit(1))
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("?")
    # '?' has no upper case: '!' is an unknown initial of a truncated row
    cut = F.when(known == "?", "!").otherwise(F.upper(known))
    code = F.when(last == "", "-").when(last.isin(".", "!", "?"), known).otherwise(cut)
    return rows.withColumns({"code": code, "key": F.unhex(F.sha2("text", 256))})


RESULT = (
    "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
COUNTS = ("blank", "duplicate", "truncated", "illegal")


class Tally:
    """Counts of rows in order, and what is needed to join the counts of two runs of rows."""

    def __init__(self) -> None:
        self.count, self.first, self.last = dict.fromkeys(COUNTS, 0), None, None
        self.turns, self.low, self.high = 0, None, None

    def add(self, turn: int | None, role: str, code: str, again: bool) -> str:
        """The row's code, ``-`` for repeated rows."""
        if code == "-":
            self.count["blank"] += 1
        elif again:
            self.count["duplicate"] += 1
            code = "-"
        elif code == "!" or code.isupper():
            self.count["truncated"] += 1
        initial = role[:1]
        if self.last is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.count["illegal"] += 1
        self.last = initial
        if turn is not None and (self.high is None or turn > self.high):
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        return code

    def join(self, later: "Tally") -> None:
        for c in COUNTS:
            self.count[c] += later.count[c]
        self.count["illegal"] += self.last is not None and later.first is not None and self.last + later.first not in LEGAL
        self.first, self.last = (later.first if self.first is None else self.first), (self.last if later.last is None else later.last)
        if later.high is not None:
            self.turns += later.turns - (self.high == later.low)
            self.low, self.high = (later.low if self.low is None else self.low), later.high

    @property
    def gaps(self) -> int:
        return 0 if self.high is None else self.high - self.low + 1 - self.turns


def _codes(s: str) -> str:
    """Unknown initials as letters for the parser: ``x`` and ``X``."""
    return s.replace("?", "x").replace("!", "X")


def _result(conv, tally: Tally, cost: int, audit: str, sha: str) -> tuple:
    return (conv, tally.gaps, *(tally.count[c] for c in COUNTS), cost, audit, sha)


def _rows(batches, names: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names))


def _table(rows: list[tuple], names: list[str], schema: pa.Schema | None) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for c, n in zip(columns, names)], schema=schema)


def _schema(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("conv_id", id_type), *((n, pa.int64()) for n in ("gaps", *COUNTS, "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _whole(batches) -> Iterator[pa.RecordBatch]:
    """Conversations that lie in one partition, in order of their rows."""
    out, conv, names, schema = [], None, ("conv_id", "turn", "role", "text", "code", "key"), None
    rows: list[tuple] = []

    def close() -> None:
        tally, seen, codes = Tally(), set(), []
        for turn, role, text, code, key in rows:
            codes.append(tally.add(turn, role, code, (role, key) in seen))
            seen.add((role, key))
        cost, audit = short_repair(_codes("".join(codes))) if len(codes) <= 64 else repairer().repair(_codes("".join(codes)))
        digest = Digest(audit)
        for _, role, text, _, _ in rows:
            digest.row(role, text)
        out.append(_result(conv[0], tally, cost, audit, digest.done()))

    for batch in batches:
        schema = schema or _schema(batch.schema.field("conv_id").type)
        for found, *row in _rows([batch], names):
            if conv is None or conv[0] != found:
                if conv is not None:
                    close()
                conv, rows = (found,), []
            rows.append(tuple(row))
        if len(out) >= 2000:
            yield _table(out, schema.names, schema)
            out = []
    if conv is not None:
        close()
    if out:
        yield _table(out, schema.names, schema)


ORDER = ("conv_id", "turn", "role", "key")
SEGMENTS = (
    "conv_id {id}, part int, number int, tops array<struct<enter:int,leave:int,cost:long,audit:string>>, "
    "first string, last string, turns long, low long, high long, blank long, duplicate long, truncated long, illegal long"
)


def _segments(batches) -> Iterator[pa.RecordBatch]:
    """What bounded runs of rows do to every stack they may meet."""
    part, number, conv, tally, codes, kind = TaskContext.get().partitionId(), 0, None, None, [], None
    way = pa.struct([("enter", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])

    def close() -> pa.RecordBatch:
        of_all = repairer()
        ways = [
            {"enter": k, "leave": m, "cost": c, "audit": a}
            for k in range(len(of_all.stacks))
            for m, (c, a) in of_all.run(_codes("".join(codes)), {k: (0, "")}).items()
        ]
        row = {"conv_id": conv[0], "part": part, "number": number, "tops": ways, "first": tally.first, "last": tally.last}
        row |= {"turns": tally.turns, "low": tally.low, "high": tally.high} | tally.count
        schema = pa.schema(
            [("conv_id", kind), ("part", pa.int32()), ("number", pa.int32()), ("tops", pa.list_(way)), ("first", pa.string()), ("last", pa.string())]
            + [(n, pa.int64()) for n in ("turns", "low", "high", *COUNTS)]
        )
        return pa.RecordBatch.from_pylist([row], schema)

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for found, turn, role, code, copies, again in _rows([batch], ("conv_id", "turn", "role", "code", "copies", "again")):
            if conv is not None and conv[0] != found:
                yield close()
                number, conv = number + 1, None
            for k in range(copies):
                if conv is not None and len(codes) == SEGMENT:
                    yield close()
                    number, conv = number + 1, None
                if conv is None:
                    conv, tally, codes = (found,), Tally(), []
                codes.append(tally.add(turn, role, code, again or k > 0))
    if conv is not None:
        yield close()


def _composed(segments: pa.Table) -> pa.Table:
    """One conversation's counts and audit from its segments, in order."""
    rows = sorted(segments.to_pylist(), key=lambda r: (r["part"], r["number"]))
    total, tops = Tally(), {0: (0, "")}
    for r in rows:
        tally = Tally()
        tally.first, tally.last, tally.turns, tally.low, tally.high = (r[n] for n in ("first", "last", "turns", "low", "high"))
        tally.count = {c: r[c] for c in COUNTS}
        total.join(tally)
        made: Tops = {}
        for w in r["tops"]:
            if w["enter"] in tops:
                cost, audit = tops[w["enter"]]
                way = (cost + w["cost"], audit + w["audit"])
                if w["leave"] not in made or way < made[w["leave"]]:
                    made[w["leave"]] = way
        tops = made
    result = _result(rows[0]["conv_id"], total, *repairer().best(tops), "")
    schema = _schema(segments.schema.field("conv_id").type)
    return pa.Table.from_batches([_table([result], schema.names, schema)])


def _hashed(batches) -> Iterator[pa.RecordBatch]:
    """SHA-256 of conversations whose audits are known, one text at a time."""
    conv, digest = None, None
    for batch in batches:
        kind, out = batch.schema.field("conv_id").type, []
        for found, role, text, copies, audit in _rows([batch], ("conv_id", "role", "text", "copies", "audit")):
            if conv is None or conv[0] != found:
                if conv is not None:
                    out.append((conv[0], digest.done()))
                conv, digest = (found,), Digest(audit)
            for _ in range(copies):
                digest.row(role, text)
        schema = pa.schema([("conv_id", kind), ("sha", pa.string())])
        if out:
            yield _table(out, schema.names, schema)
    if conv is not None:
        yield _table([(conv[0], digest.done())], schema.names, schema)


def _in_segments(rows: DataFrame, id_type: str) -> DataFrame:
    """Repairs of conversations too long for one task."""
    same = staged(rows.groupBy("conv_id", "turn", "role", "text", "code", "key").agg(F.count(F.lit(1)).alias("copies")), "repair-rows")
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = same.groupBy("conv_id", "role", F.col("key")).agg(F.min(at).alias("first"))
    marks = same.alias("r").join(
        first.alias("f"),
        F.col("r.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("r.role") == F.col("f.role")) & (F.col("r.key") == F.col("f.key")),
    )
    marks = marks.select(*(f"r.{c}" for c in same.columns if c != "text"), "first")
    marks = marks.withColumn("again", ~(at == F.col("first"))).drop("first")
    ordered = marks.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    cut = staged(ordered.mapInArrow(_segments, SEGMENTS.format(id=id_type)), "repair-segments")
    found = staged(cut.groupBy("conv_id").applyInArrow(_composed, RESULT.format(id=id_type)), "repair-audits")
    texts = same.alias("r").join(found.select("conv_id", "audit").alias("f"), F.col("r.conv_id").eqNullSafe(F.col("f.conv_id"))).select("r.*", "f.audit")
    lines = texts.repartition("conv_id").sortWithinPartitions(*ORDER).mapInArrow(_hashed, f"conv_id {id_type}, sha string")
    joined = found.alias("f").join(lines.alias("h"), F.col("f.conv_id").eqNullSafe(F.col("h.conv_id"))).select("f.*", "h.sha")
    return joined.withColumn("repaired_sha256", F.col("sha")).drop("sha")


def repair(rows: DataFrame, whole_rows: int = WHOLE_ROWS, whole_chars: int = WHOLE_CHARS) -> DataFrame:
    """Faults, cheapest edits and digest of each conversation of ``rows(conv_id, turn, role, text)``.

    Rows are read by turn, nulls first; rows of one turn by role, then by the hash of
    the text, which keeps equal rows together. Null roles and texts are one space, a
    null conversation is one of its own. Extra columns are ignored; no rows give no result.

    A conversation within the bounds is read as a whole by the task that its id hashes to.
    Longer ones are cut into runs of ``SEGMENT`` rows along a range sort, each run gives what it does
    to every stack, and these tables are composed in order; only the digest, which SHA-256
    makes sequential, streams a long conversation's texts through one task, one batch at a time.
    """
    spark = rows.sparkSession
    id_type = rows.schema["conv_id"].dataType.simpleString()
    plain = rows.select("conv_id", F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    marked = _with_faults(plain)
    sizes = plain.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    long_ones = staged(sizes.where((F.col("n") > whole_rows) | (F.col("chars") > whole_chars)).select("conv_id"), "repair-long")
    rest = marked
    if not (none := long_ones.isEmpty()):
        same = F.col("m.conv_id").eqNullSafe(F.col("l.conv_id"))
        rest = marked.alias("m").join(long_ones.alias("l"), same, "left_anti")
    out = rest.repartition("conv_id").sortWithinPartitions(*ORDER).mapInArrow(_whole, RESULT.format(id=id_type))
    if none:
        return out
    return out.unionByName(_in_segments(marked.alias("m").join(long_ones.alias("l"), same, "left_semi"), id_type))


def repair_damaged(conversations: DataFrame, **bounds: int) -> DataFrame:
    """One row for every conversation before damage; one that loses all its rows has zeros and the digest of nothing."""
    found = repair(damaged(conversations), **bounds)
    every = conversations.select("conv_id").distinct()
    joined = every.alias("e").join(found.alias("f"), F.col("e.conv_id").eqNullSafe(F.col("f.conv_id")), "left")
    empty = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return joined.select("e.conv_id", *(F.coalesce(f"f.{c}", F.lit(empty.get(c, 0))).alias(c) for c in found.columns if c != "conv_id"))


def op11_glr_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_damaged(table(spark, sf_dir, "conversations"))
