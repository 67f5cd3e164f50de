"""Conversation structure repair by Wagner-Fischer target alignment.

A conversation's turns are aligned with the strings of the alternating
grammar ``(s?(ua)+)?``: one alignment for each feasible length, each in an
Ukkonen band that the cheapest alignment so far (the incumbent) leaves open.
The audits of equally cheap alignments are traced and compared.

Turns are ordered by a range-partitioned row number and aligned in blocks of
bounded length.  A block of a longer conversation is aligned from and to each
grammar state that its neighbours may leave it in; the blocks' tables are
then joined in a tree, which gives the same audit as one alignment of the whole.
Texts move once, at the end, when the repaired conversation is written in
order as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from communitylens.llm.common import reliable, stored
from communitylens.operators.windows import global_row_number

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: Rows of one alignment and tables of one step of the tree, at most.
BLOCK_ROWS = 32
FAN_IN = 32
#: What the grammar has read: nothing, s, or up to u or a.
EMPTY, SYSTEM, USER, ASSISTANT = "0sua"
NEXT = {EMPTY: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
LEGAL = {"su", "ua", "au"}
SPACES = " \t\n\v\f\r"


# --- alignment of one block -------------------------------------------------

def _targets(start: str, last: bool, n: int) -> dict[tuple[str, bool], list[int]]:
    """Feasible lengths by (exit state, whether a leading s is read)."""
    out: dict[tuple[str, bool], list[int]] = {}
    for lead in ([False, True] if start == EMPTY else [False]):
        for m in range(0, 2 * n + 4):
            end = _exit(start, lead, m)
            if end is not None and (not last or end in (EMPTY, ASSISTANT)):
                out.setdefault((end, lead), []).append(m)
    return out


def _target(start: str, lead: bool, m: int) -> str:
    s, state = ["s"] if lead else [], SYSTEM if lead else start
    while len(s) < m:
        state = NEXT[state]
        s.append(state)
    return "".join(s[:m])


def _exit(start: str, lead: bool, m: int) -> str | None:
    if lead and m == 0:
        return None
    t = _target(start, lead, m)
    return t[-1] if t else start


def _step_cost(unit: tuple, symbol: str) -> int | None:
    """Cost of a unit that stays as ``symbol``; None where it cannot."""
    initial, kind, _ = unit
    if kind == "d":
        return None
    extra = TRUNCATED if kind == "t" else 0
    if initial == symbol:
        return extra
    return REROLE + extra if symbol != "s" else None


def align(units: list[tuple], target: str, most: int, trailing: bool) -> tuple[int, str] | None:
    """The cheapest edit of ``units`` into ``target`` with its least audit, or
    None if it costs more than ``most``.  ``trailing``: symbols may be inserted
    after the last unit.

    Costs are filled from the end, so the audit is traced from the start and
    the least letter taken among equally cheap ones."""
    n, m = len(units), len(target)
    over = most + 1

    def least(rows: int, symbols: int) -> int:
        return INSERT * (symbols - rows) if symbols > rows else DELETE * (rows - symbols)

    if least(n, m) > most:
        return None
    cost = [[over] * (m + 1) for _ in range(n + 1)]
    for i in range(n, -1, -1):
        here, below = cost[i], cost[i + 1] if i < n else None
        for j in range(m, -1, -1):
            if least(i, j) + least(n - i, m - j) > most:  # outside the band of the incumbent
                continue
            if i == n and j == m:
                best = 0
            else:
                best = over
                if i < n:
                    best = below[j] + DELETE * units[i][2]
                    if j < m and (c := _step_cost(units[i], target[j])) is not None:
                        best = min(best, below[j + 1] + c)
                if j < m and (i < n or trailing):
                    best = min(best, here[j + 1] + INSERT)
            here[j] = min(best, over)
    if cost[0][0] > most:
        return None
    audit, i, j = [], 0, 0
    while i < n or j < m:
        c = cost[i][j]
        if i < n and c == cost[i + 1][j] + DELETE * units[i][2]:
            audit.append("D" * units[i][2])
            i += 1
        elif j < m and (i < n or trailing) and c == cost[i][j + 1] + INSERT:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if units[i][0] == target[j] else "R")
            i, j = i + 1, j + 1
    return cost[0][0], "".join(audit)


def _units(code: str) -> list[tuple]:
    """Units (initial, kind, rows) of a block: kind k may stay, t too but is
    truncated, d has to go.  Copies right after a row are one unit."""
    out = []
    for part in code.split():
        initial, kind, n = part[0], part[1], int(part[2:])
        if kind == "d":
            out.append((initial, "d", n))
        else:
            out.append((initial, kind, 1))
            if n > 1:
                out.append((initial, "d", n - 1))
    return out


@lru_cache(maxsize=20_000)
def block_table(code: str, first: bool, last: bool) -> tuple:
    """((entry, exit, cost, audit), ...): the best edit of a block for each
    state before and after it.  A first block starts empty; a last one ends
    where the grammar may; symbols are inserted before a row, after the last
    row of a conversation only."""
    units, out = _units(code), []
    for entry in (EMPTY,) if first else (EMPTY, SYSTEM, USER, ASSISTANT):
        best: dict[str, tuple[int, str]] = {}
        for (end, lead), lengths in _targets(entry, last, len(units)).items():
            key = "end" if last else end
            for m in sorted(lengths, key=lambda x: (abs(x - len(units)), x)):
                most = best[key][0] if key in best else DELETE * sum(u[2] for u in units) + INSERT * (m + 2) + TRUNCATED * len(units)
                got = align(units, _target(entry, lead, m), most, last)
                if got is not None and (key not in best or got < best[key]):
                    best[key] = got
        out.extend((entry, end, *got) for end, got in sorted(best.items()))
    return tuple(out)


def illegal_pairs(code: str) -> tuple[int, str, str]:
    """Neighbours that the grammar does not have, first and last initial."""
    n, before = 0, ""
    for part in code.split():
        n += int(part[2:]) - 1
        if before:
            n += before + part[0] not in LEGAL
        before = part[0]
    return n, code[0], before


def join_tables(left: tuple | list, right: tuple | list) -> list[tuple]:
    """The table of two neighbouring blocks."""
    best: dict[tuple[str, str], tuple[int, str]] = {}
    after: dict[str, list] = {}
    for entry, end, cost, audit in right:
        after.setdefault(entry, []).append((end, cost, audit))
    for entry, mid, cost, audit in left:
        for end, more, rest in after.get(mid, ()):
            got = (cost + more, audit + rest)
            if (entry, end) not in best or got < best[entry, end]:
                best[entry, end] = got
    return [(*k, *v) for k, v in sorted(best.items())]


# --- Spark jobs --------------------------------------------------------------

_TABLE = "array<struct<entry:string,exit:string,cost:long,audit:string>>"
_ARROW_TABLE = pa.list_(pa.struct([("entry", pa.string()), ("exit", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))


def _as_structs(table) -> list[dict]:
    return [{"entry": e, "exit": x, "cost": c, "audit": a} for e, x, c, a in table]


def _align_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, block, blocks, code) -> (conv, block, blocks, table, illegal, head, tail)."""
    for b in batches:
        codes, at, of = b.column(3).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
        tables = [_as_structs(block_table(c, k == 0, k == n - 1)) for c, k, n in zip(codes, at, of)]
        pairs = [illegal_pairs(c) for c in codes]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), b.column(2), pa.array(tables, _ARROW_TABLE), pa.array([p[0] for p in pairs], pa.int64()),
             pa.array([p[1] for p in pairs], pa.string()), pa.array([p[2] for p in pairs], pa.string())],
            names=["conv", "block", "blocks", "table", "illegal", "head", "tail"])


def _join_group(group: pa.Table) -> pa.Table:
    rows = sorted(group.to_pylist(), key=lambda r: r["block"])
    table, illegal, tail = None, 0, None
    for r in rows:
        t = [(x["entry"], x["exit"], x["cost"], x["audit"]) for x in r["table"]]
        table = t if table is None else join_tables(table, t)
        illegal += r["illegal"] + (tail is not None and tail + r["head"] not in LEGAL)
        tail = r["tail"]
    return pa.table({"conv": pa.array([rows[0]["conv"]], group.schema.field("conv").type),
                     "block": pa.array([rows[0]["block"] // FAN_IN], pa.int64()),
                     "blocks": pa.array([-(-rows[0]["blocks"] // FAN_IN)], pa.int64()),
                     "table": pa.array([_as_structs(table)], _ARROW_TABLE), "illegal": pa.array([illegal], pa.int64()),
                     "head": pa.array([rows[0]["head"]], pa.string()), "tail": pa.array([tail], pa.string())})


def _spaceless_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def read_turns(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, copies) of a table of turns; a null role or
    text is one space."""
    return rows.select(F.col("conv_id").alias("conv"), F.col("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                       F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).cast("long").alias("copies"))


def damage(turns: DataFrame) -> DataFrame:
    """Seeded damage: of every 20 values of crc32(``conv:turn``) one drops the
    row, one empties its text, one takes its sentence ends away, one repeats
    it and one makes it the user's."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.col("fate")
    return (turns.withColumn("fate", F.crc32(F.concat(name("conv"), F.lit(":"), name("turn")).cast("binary")) % 20).where(fate != 0)
            .select("conv", "turn", F.when(fate == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                    F.when(fate == 1, F.lit("")).when(fate == 2, F.regexp_replace("text", r"[.!?]", "")).otherwise(F.col("text")).alias("text"),
                    F.when(fate == 3, F.col("copies") * 2).otherwise(F.col("copies")).alias("copies")))


def _key() -> Column:
    """Equal for rows of one role and text; orders the rows of one turn."""
    return F.md5(F.concat_ws(":", F.length("role").cast("string"), F.col("role"), F.col("text")).cast("binary"))


def faults(turns: DataFrame) -> DataFrame:
    """Without texts: (conv, turn, key, initial, kind, n, blank, duplicate,
    truncated), one row for equal rows of a turn.

    Only a row's first fault counts.  ``kind`` is d where the row has to go, t
    where its text breaks off, else k; with k and t only the first of the n
    rows may stay.  A role that is not s..., u... or a... has the initial x."""
    end = _spaceless_end(F.col("text"))
    rows = turns.select("conv", "turn", _key().alias("key"), "copies",
                        F.when(F.col("role").rlike("^[sua]"), F.substring("role", 1, 1)).otherwise("x").alias("initial"),
                        (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("broken"))
    rows = stored(rows.groupBy("conv", "turn", "key", "initial", "blank", "broken").agg(F.sum("copies").alias("n")), "turns")
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    seen = (rows.groupBy("conv", "key").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("turns")).where("turns > 1")
            .select(F.col("conv").alias("s_conv"), F.col("key").alias("s_key"), "first"))
    rows = rows.join(seen, F.col("conv").eqNullSafe(F.col("s_conv")) & (F.col("key") == F.col("s_key")), "left")
    later = F.col("first").isNotNull() & (order > F.col("first"))
    n, blank = F.col("n"), F.col("blank")
    return rows.select(
        "conv", "turn", "key", "initial", "n",
        F.when(blank | later, "d").when(F.col("broken"), "t").otherwise("k").alias("kind"),
        F.when(blank, n).otherwise(0).alias("blank"),
        F.when(blank, 0).when(later, n).otherwise(n - 1).alias("duplicate"),
        F.when(~blank & ~later & F.col("broken"), 1).otherwise(0).alias("truncated"))


def _with_conv(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join by conversation; a null id is a conversation too."""
    right = right.withColumnRenamed("conv", "r_conv")
    return left.join(right, F.col("conv").eqNullSafe(F.col("r_conv")), how).drop("r_conv")


def audits(turns: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of every
    conversation that has rows."""
    rows = global_row_number(faults(turns), [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("key")])
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    report = (rows.groupBy("conv", "turn").agg(F.min("row_number").alias("lo"), F.max("row_number").alias("hi"), *sums)
              .groupBy("conv").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), *sums,
                                   F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")))
    report = stored(report, "turn-report")
    at = F.floor((F.col("row_number") - F.col("lo")) / block_rows).cast("long")
    of = (F.floor((F.col("hi") - F.col("lo")) / block_rows) + 1).cast("long")
    unit = F.struct("row_number", F.concat("initial", "kind", F.col("n").cast("string")).alias("code"))
    blocks = (_with_conv(rows.select("conv", "row_number", "initial", "kind", "n"), report.select("conv", "lo", "hi"))
              .groupBy("conv", at.alias("block"), of.alias("blocks"))
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(unit)), lambda u: u["code"]), " ").alias("code")))
    kind = dict(turns.dtypes)["conv"]
    shape = f"conv {kind}, block long, blocks long, table {_TABLE}, illegal long, head string, tail string"
    tables = stored(blocks.mapInArrow(_align_blocks, shape), "turn-tables")
    done = tables.where("blocks = 1")
    rest = tables.where("blocks > 1")
    while not rest.isEmpty():
        joined = stored(rest.groupBy("conv", F.floor(F.col("block") / FAN_IN).alias("part")).applyInArrow(_join_group, shape), "turn-tables")
        done, rest = done.unionByName(joined.where("blocks = 1")), joined.where("blocks > 1")
    best = F.col("table")[0]
    return _with_conv(done.select("conv", "illegal", best["cost"].alias("cost"), best["audit"].alias("audit")), report.drop("lo", "hi"))


_HEAD = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_NAMES = {"s": "system", "u": "user", "a": "assistant"}


class Rewriter:
    """Writes one repaired conversation line by line, as its rows come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, EMPTY
        self.sha, self.lines = hashlib.sha256(), 0

    def _line(self, role: str, text: str, state: str) -> tuple[str, str]:
        self.sha.update((("\n" if self.lines else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.lines += 1
        self.state = state
        return role, text

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            yield self._line(_NAMES[NEXT[self.state]], "", NEXT[self.state])

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            yield self._line(role, text, role[0])
        elif edit == "R":
            yield self._line(_NAMES[NEXT[self.state]], text, NEXT[self.state])


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv").sortWithinPartitions(
        F.col("conv").asc_nulls_first(), "is_row", F.col("turn").asc_nulls_first(), "key")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(event, conversation's head row, writer, line) in order of the rows."""
    head, writer = None, None
    for b in batches:
        for r in b.to_pylist():
            if not r["is_row"]:
                if head is not None:
                    for line in writer.inserted():
                        yield "line", head, writer, line
                    yield "end", head, writer, None
                head, writer = r, Rewriter(r["audit"])
                continue
            for _ in range(r["copies"]):
                for line in writer.row(r["role"], r["text"]):
                    yield "line", head, writer, line
    if head is not None:
        for line in writer.inserted():
            yield "line", head, writer, line
        yield "end", head, writer, None


def _stream(turns: DataFrame, found: DataFrame, convs: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order."""
    heads = _with_conv(convs, found, "left")
    zero = F.lit(0).cast("long")
    heads = heads.select("conv", F.lit(False).alias("is_row"), F.lit(None).cast(dict(turns.dtypes)["turn"]).alias("turn"), F.lit("").alias("key"),
                         F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("copies"),
                         F.coalesce("audit", F.lit("")).alias("audit"), *[F.coalesce(F.col(c).cast("long"), zero).alias(c) for c in _HEAD])
    rows = turns.select("conv", F.lit(True).alias("is_row"), "turn", _key().alias("key"), "role", "text", "copies",
                        F.lit(None).cast("string").alias("audit"), *[F.lit(None).cast("long").alias(c) for c in _HEAD])
    return _in_order(heads.unionByName(rows))


def repair(turns: DataFrame, convs: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per conversation of ``convs`` (of ``turns`` if not given): conv,
    gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``turns`` is (conv, turn, role, text, copies).  Rows go by turn, a null
    turn first, rows of one turn by the md5 of role and text.  A null id is a
    conversation of its own; a conversation without rows has zeros, an empty
    audit and the hash of the empty string; an empty table gives no rows.  The
    one step that cannot be split is the SHA-256 of a repaired conversation: it
    is a chain, and its task streams the rows."""
    found = audits(turns, block_rows)
    convs = (turns if convs is None else convs).select("conv").distinct()
    kind = dict(turns.dtypes)["conv"]
    names = ["conv", *_HEAD, "audit", "repaired_sha256"]

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for event, head, writer, _ in _conversations(batches):
            if event == "end":
                out.append({c: head[c] for c in names[:-1]} | {"repaired_sha256": writer.sha.hexdigest()})
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    shape = StructType.fromDDL(f"conv {kind}, " + ", ".join(f"{c} long" for c in _HEAD) + ", audit string, repaired_sha256 string")
    schema = to_arrow_schema(shape)
    return _stream(turns, found, convs).mapInArrow(hashes, shape)


def repaired_turns(turns: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The repaired conversations themselves: (conv, place, role, text)."""
    kind = dict(turns.dtypes)["conv"]

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for event, head, writer, line in _conversations(batches):
            if event == "line":
                out.append((head["conv"], writer.lines, *line))
                if len(out) >= 500:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    shape = StructType.fromDDL(f"conv {kind}, place long, role string, text string")
    schema = to_arrow_schema(shape)
    return _stream(turns, audits(turns, block_rows), turns.select("conv").distinct()).mapInArrow(lines, shape)
