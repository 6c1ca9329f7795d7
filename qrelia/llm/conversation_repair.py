"""Repair of conversation structure by weighted interval parsing.

A repaired conversation is empty or has the role initials ``s?(ua)+``. Rows may be kept (K, 0), given the role
user or assistant (R, 1) or deleted (D, 2); a blank row or a duplicate has to be deleted; a truncated row that stays costs 5 more;
an empty user or assistant row may be inserted anywhere (I, 5). Of the cheapest repairs the one with the ASCII-least
string of edit letters is chosen.

Grammar: nonterminal ``N[p,q]`` spans the rows that lead from state p to state q of the pattern, with the
normal-form rules ``N[p,q] -> N[p,r] N[r,q]`` and one terminal rule per row and edit. A cell of a span holds the least
(cost, audit) for every (p, q); insertions are a closure applied to the cells of one row. Two audits of equal cost over the
same rows are never prefixes of each other (the longer one would have more insertions and cost more), so the least audit
of a span is made of least audits of its parts. The rule is associative, so one split point per span is enough:
spans of one row, then two, four and so on are combined bottom-up, and a conversation takes time in proportion to its rows.

Spark brings a conversation's rows together in order and a task parses them. A conversation of more than
``LONG_ROWS`` rows or ``LONG_BYTES`` bytes never meets in one task: its rows are numbered, stretches of ``BLOCK_ROWS`` rows
become cells in parallel, Spark rounds combine neighbouring cells, and the edits of the whole audit are joined to the rows.

Order: by turn, nulls first; rows of equal turn by role, then by MD5 of the text. Null roles and texts are one space. The initial of a role is its
first code point; an empty role has none and never fits. A null conversation id is a conversation of its own. Rows with a false ``present`` only say
that the conversation exists: one without any other row gets zeros and an empty audit. An empty table gives an
empty result. Repeated rows are duplicates. Extra columns are not used, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qrelia.operators.joins import fits_broadcast
from qrelia.operators.positions import with_row_position
from qrelia.session import durable

RELABEL, DELETE, INSERT, CUT = 1, 2, 5, 5  # costs
LONG_ROWS = 2_000
LONG_BYTES = 8 << 20
BLOCK_ROWS = 1_000
_EDIT_ROWS = 10_000  # of one Arrow batch
LEGAL = ("su", "ua", "au")

# States of the pattern: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may end.
_STEPS = {"s": ((0, 1),), "u": ((0, 2), (1, 2), (3, 2)), "a": ((2, 3),)}
_ENDS = (0, 3)
_NAMES = {"u": "user", "a": "assistant"}

Cell = dict[tuple[int, int], tuple[int, str]]  # (from state, to state) -> (cost, audit)

_NOT_SPACE = r"[^\x20\x09-\x0D]"


def _better(cell: Cell, key: tuple[int, int], value: tuple[int, str]) -> None:
    if key not in cell or value < cell[key]:
        cell[key] = value


def combine(left: Cell, right: Cell) -> Cell:
    """Least cells of two neighbouring spans together."""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for (r2, q), (more, rest) in right.items():
            if r == r2:
                total = cost + more
                if (p, q) not in out or total <= out[p, q][0]:
                    _better(out, (p, q), (total, audit + rest))
    return out


def _closure() -> Cell:
    """Cells of no row: any number of insertions."""
    one: Cell = {(p, p): (0, "") for p in range(4)}
    for name in _NAMES:
        for step in _STEPS[name]:
            _better(one, step, (INSERT, "I"))
    cell = one
    while (more := combine(cell, one)) != cell:
        cell = more
    return cell


_INSERTED = _closure()
_known: dict[tuple[str, bool, bool], Cell] = {}


def row_cell(initial: str, must_go: bool, cut: bool) -> Cell:
    """Cells of one row with insertions on both sides."""
    key = (initial, must_go, cut)
    if key not in _known:
        cell: Cell = {(p, p): (DELETE, "D") for p in range(4)}
        if not must_go:
            more = CUT if cut else 0
            for name, steps in _STEPS.items():
                for step in steps:
                    if name == initial:
                        _better(cell, step, (more, "K"))
                    if name in _NAMES:
                        _better(cell, step, (RELABEL + more, "R"))
        found = combine(combine(_INSERTED, cell), _INSERTED)
        if len(_known) > 10_000:
            _known.clear()
        _known[key] = found
    return _known[key]


def span_cell(cells: list[Cell]) -> Cell:
    """Spans of 1, 2, 4, ... rows bottom-up; the cell of all rows."""
    if not cells:
        return _INSERTED
    while len(cells) > 1:
        paired = [combine(a, b) for a, b in zip(cells[::2], cells[1::2])]
        cells = paired + cells[len(paired) * 2 :]
    return cells[0]


def best_repair(cell: Cell) -> tuple[int, str]:
    return min(cell[0, q] for q in _ENDS if (0, q) in cell)


def apply_edits(audit: str, rows: list[tuple[str, str]], state: int = 0) -> tuple[list[dict], int]:
    """Repaired (role, text) rows of an audit that starts in ``state``, and the state it ends in."""
    out, at = [], 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[at]
        at += edit != "I"
        if edit == "D":
            continue
        name = role[:1] if edit == "K" else ("a" if state == 2 else "u")
        state = dict(_STEPS[name])[state]
        out.append({"role": role if edit == "K" else _NAMES[name], "text": text})
    return out, state


def _plain(rows: DataFrame, conv_id: str, turn: str, role: str, text: str, present: str | None) -> DataFrame:
    here = F.lit(True) if present is None else F.col(present)
    plain = rows.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
        here.alias("present"),
    )
    return plain.select(
        "conv_id",
        "turn",
        "role",
        F.when(F.col("present"), F.col("text")).otherwise("").alias("text"),
        F.md5(F.col("text").cast("binary")).alias("md5"),
        (~F.col("text").rlike(_NOT_SPACE)).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"),
        "present",
    )


class _Short:
    """Whole conversations of a sorted partition."""

    def __init__(self, schema: pa.Schema):
        self.schema = schema

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        done: list[dict] = []
        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                if rows and row["conv_id"] != rows[0]["conv_id"]:
                    done.append(repair_rows(rows))
                    size += sum(len(r["text"]) for r in rows)
                    rows = []
                    if size > LONG_BYTES or len(done) >= BLOCK_ROWS:
                        yield pa.RecordBatch.from_pylist(done, self.schema)
                        done, size = [], 0
                rows.append(row)
        if rows:
            done.append(repair_rows(rows))
        if done:
            yield pa.RecordBatch.from_pylist(done, self.schema)


def repair_rows(rows: list[dict]) -> dict:
    """Faults, cheapest repair and repaired rows of one conversation, given in order."""
    here = [r for r in rows if r["present"]]
    seen: set[tuple[str, str]] = set()
    n = {"blank": 0, "duplicate": 0, "truncated": 0}
    cells = []
    for r in here:
        key = (r["role"], r["text"])
        again = key in seen
        seen.add(key)
        fault = "blank" if r["blank"] else "duplicate" if again else "truncated" if r["cut"] else None
        if fault:
            n[fault] += 1
        cells.append(row_cell(r["role"][:1], fault in ("blank", "duplicate"), fault == "truncated"))
    initials = [r["role"][:1] for r in here]
    turns = {r["turn"] for r in here if r["turn"] is not None}
    cost, audit = best_repair(span_cell(cells))
    return {
        "conv_id": rows[0]["conv_id"],
        "part": 0,
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        **n,
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
        "cost": cost,
        "audit": audit,
        "turns": apply_edits(audit, [(r["role"], r["text"]) for r in here])[0],
    }


def _fields(kind: str) -> str:
    return f"conv_id {kind}, part long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, turns array<struct<role: string, text: string>>"


def _arrow(kind: str) -> pa.Schema:
    turns = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    longs = [(c, pa.int64()) for c in ("part", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return pa.schema([("conv_id", _ARROW_IDS[kind]()), *longs, ("audit", pa.string()), ("turns", turns)])


_ARROW_IDS = {"bigint": pa.int64, "int": pa.int32, "string": pa.string}


def repair_conversations(
    rows: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    present: str | None = None,
    long_rows: int = LONG_ROWS,
    long_bytes: int = LONG_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Repaired conversations: conv_id, part, gaps, blank, duplicate, truncated, illegal, cost, audit, turns.

    A conversation has one row with part 0, whose ``turns`` are the repaired rows in order. Only for a long
    conversation ``turns`` of part 0 is empty, and parts 1, 2, ... hold one repaired row each (other columns null).
    """
    plain = _plain(rows, conv_id, turn, role, text, present)
    kind = dict(plain.dtypes)["conv_id"]
    if kind not in _ARROW_IDS:
        raise TypeError(f"conversation ids have to be bigint, int or string, not {kind}")
    sizes = plain.where("present").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b"))
    long = durable(sizes.where((F.col("n") > long_rows) | (F.col("b") > long_bytes)).select("conv_id"))
    if long.isEmpty():
        return _repair_short(plain, kind)
    known = long.withColumnRenamed("conv_id", "_c")
    known = F.broadcast(known) if fits_broadcast(known) else known
    match = plain["conv_id"].eqNullSafe(known["_c"])
    short = _repair_short(plain.join(known, match, "left_anti"), kind)
    return short.unionByName(_repair_long(plain.where("present").join(known, match, "left_semi"), kind, block_rows))


def _repair_short(plain: DataFrame, kind: str) -> DataFrame:
    ordered = plain.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "md5")
    return ordered.mapInArrow(_Short(_arrow(kind)), _fields(kind))


def _stored(cell: Cell) -> list[dict]:
    return [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in sorted(cell.items())]


def _loaded(cell: list[dict]) -> Cell:
    return {(c["p"], c["q"]): (c["cost"], c["audit"]) for c in cell}


_CELL = "array<struct<p: int, q: int, cost: long, audit: string>>"


def _stretch_cells(pdf):
    import pandas as pd

    pdf = pdf.sort_values("at")
    initials = list(pdf["initial"])
    cells = [row_cell(*map_row) for map_row in zip(initials, map(bool, pdf["gone"]), map(bool, pdf["truncated"]))]
    wrong = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    row = {"begin": pdf["begin"].iloc[0], "block": pdf["block"].iloc[0], "cell": _stored(span_cell(cells))}
    return pd.DataFrame([{**row, "head": initials[0], "tail": initials[-1], "illegal": wrong}])


def _neighbours(pdf):
    import pandas as pd

    pdf = pdf.sort_values("block")
    seams = sum(a + b not in LEGAL for a, b in zip(pdf["tail"], pdf["head"].iloc[1:]))
    row = {"begin": pdf["begin"].iloc[0], "block": pdf["block"].iloc[0] // 2, "cell": _stored(span_cell([_loaded(c) for c in pdf["cell"]]))}
    return pd.DataFrame([{**row, "head": pdf["head"].iloc[0], "tail": pdf["tail"].iloc[-1], "illegal": int(pdf["illegal"].sum()) + seams}])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(begin, part, at, role): one row per repaired row; a null role is kept, a null ``at`` is inserted.

    The number of repaired rows tells whether the first one is the system's: only then it is odd.
    """
    names = ["begin", "part", "at", "role"]
    types = pa.schema([(n, pa.string() if n == "role" else pa.int64()) for n in names])
    for batch in batches:
        for begin, audit in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            even = (len(audit) - audit.count("D")) % 2
            at, part, out = begin, 0, []
            for edit in audit:
                if edit != "D":
                    part += 1
                    name = "user" if (part + even) % 2 else "assistant"
                    out.append({"begin": begin, "part": part, "at": None if edit == "I" else at, "role": None if edit == "K" else name})
                at += edit != "I"
                if len(out) == _EDIT_ROWS:
                    yield pa.RecordBatch.from_pylist(out, types)
                    out = []
            yield pa.RecordBatch.from_pylist(out, types)


def _repair_long(plain: DataFrame, kind: str, block_rows: int) -> DataFrame:
    """Conversations whose rows do not meet in one task; see the module's text."""
    dated = plain.withColumn("dated", F.col("turn").isNotNull())
    # copies of one row may stand in any order: their number in the table only spreads them
    spread = dated.withColumn("copy", F.monotonically_increasing_id())
    numbered = with_row_position(spread, ["conv_id", "dated", "turn", "role", "md5", "copy"], "at")
    begins = durable(numbered.groupBy(F.col("conv_id").alias("_c")).agg(F.min("at").alias("begin")))
    begins = F.broadcast(begins) if fits_broadcast(begins) else begins
    placed = numbered.join(begins, numbered["conv_id"].eqNullSafe(begins["_c"])).drop("_c")
    original = numbered.groupBy("conv_id", "role", "md5").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    again = F.col("first").isNull() & ~F.col("blank")
    rows = durable(
        placed.join(original, "at", "left").select(
            "conv_id",
            "begin",
            ((F.col("at") - F.col("begin")) / block_rows).cast("long").alias("block"),
            "at",
            "turn",
            "role",
            F.substring("role", 1, 1).alias("initial"),
            "text",
            "blank",
            again.alias("duplicate"),
            (F.col("cut") & ~F.col("blank") & ~again).alias("truncated"),
        )
    )
    faults = [F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")]
    counts = rows.groupBy("conv_id", "begin").agg(F.max("turn").alias("hi"), F.min("turn").alias("lo"), *faults)
    dates = rows.where("turn IS NOT NULL").select("begin", "turn").distinct().groupBy("begin").agg(F.count(F.lit(1)).alias("dates"))

    fields = f"begin long, block long, cell {_CELL}, head string, tail string, illegal long"
    marked = rows.select("begin", "block", "at", "initial", (F.col("blank") | F.col("duplicate")).alias("gone"), "truncated")
    cells = durable(marked.groupBy("begin", "block").applyInPandas(_stretch_cells, fields))
    while not cells.where("block > 0").isEmpty():
        up = cells.groupBy("begin", (F.col("block") / 2).cast("long").alias("_up"))
        cells = durable(up.applyInPandas(_neighbours, fields))
    least = F.array_min(F.transform(F.filter("cell", lambda c: (c["p"] == 0) & c["q"].isin(*_ENDS)), lambda c: F.struct(c["cost"], c["audit"])))
    chosen = durable(cells.select("begin", "illegal", least.alias("b")).select("begin", "illegal", "b.cost", "b.audit"))

    none = F.array().cast("array<struct<role: string, text: string>>")
    gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("dates"), F.lit(0))
    order = ["conv_id", "part", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "turns"]
    summary = counts.join(dates, "begin", "left").join(chosen, "begin")
    summary = summary.withColumns({"part": F.lit(0).cast("long"), "gaps": gaps.cast("long"), "turns": none}).select(*order)

    edits = chosen.select("begin", "audit").mapInArrow(_edits, "begin long, part long, at long, role string")
    edits = durable(edits.withColumnRenamed("role", "given"))
    turn = F.struct(F.coalesce("given", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    found = edits.join(rows.select("at", "role", "text"), "at", "left").select("begin", "part", F.array(turn).alias("turns"))
    found = found.join(begins.withColumnRenamed("_c", "conv_id"), "begin")
    for c in order[2:-1]:
        found = found.withColumn(c, F.lit(None).cast("string" if c == "audit" else "long"))
    return summary.unionByName(found.select(*order))


def conversation_digests(repaired: DataFrame) -> DataFrame:
    """One row per conversation of ``repair_conversations``, with the SHA-256 of its ``role:text`` lines.

    The rows of a long conversation are read in order by one task, since a SHA-256 cannot be put together from
    parts; only the state of the hash is kept.
    """
    repaired = durable(repaired)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    heads = repaired.where("part = 0").withColumn("own", F.sha2(lines, 256))
    rest = repaired.where("part > 0").select("conv_id", "part", F.element_at("turns", 1).alias("t"))
    parts = rest.select("conv_id", "part", F.concat("t.role", F.lit(":"), "t.text").alias("line"))
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    kind = dict(repaired.dtypes)["conv_id"]
    schema = pa.schema([("_c", _ARROW_IDS[kind]()), ("long_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, own = None, None
        for batch in batches:
            for c, part, line in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if part == 1:
                    if state is not None:
                        yield pa.RecordBatch.from_pylist([{"_c": own, "long_sha256": state.hexdigest()}], schema)
                    state, own = hashlib.sha256(line.encode()), c
                else:
                    state.update(b"\n" + line.encode())
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"_c": own, "long_sha256": state.hexdigest()}], schema)

    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    if rest.isEmpty():
        return heads.select(*columns, F.col("own").alias("repaired_sha256"))
    long = ordered.mapInArrow(digest, f"_c {kind}, long_sha256 string")
    joined = heads.join(long, heads["conv_id"].eqNullSafe(long["_c"]), "left")
    return joined.select(*columns, F.coalesce("long_sha256", "own").alias("repaired_sha256"))


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with faults put in by the crc32 of ``conv_id:turn`` modulo 20; dropped rows stay with a false ``present``."""

    def shown(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fault = F.pmod(F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))), F.lit(20)).cast("int")
    hurt = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy")
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    return hurt.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") != 0).alias("present"), times).drop("copy")
