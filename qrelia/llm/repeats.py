"""Repeated windows of units (words or bytes), found by anchors instead of by every window.

A front end turns a slice of texts into units and *anchors*: places whose choice and 64-bit name depend
on nothing but the units in ``[lo, hi)``. Every window of ``width`` units belongs to the anchor of least
name inside it (windows without an anchor stand for themselves). Equal windows therefore belong
to equally named anchors, and the windows of one anchor start in one range ``[s0, s1]``, together its *span*.

1. Names that occur once are dropped: their windows do not repeat.
2. Occurrences are grouped by (name, hash of the whole span). Occurrences with equal spans answer each other.
3. Where a name has several spans, one occurrence of each span, and all occurrences still without an
   answer, send their span's text to a task that compares their windows one by one. A name with
   very many spans goes through a Spark aggregation of single windows instead.

Only the shared names' rows, and texts of unanswered spans, are shuffled; no group is collected unless its size was
counted. Documents are told apart by (id, hash of text), so that repeated rows do no harm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qrelia.llm.textarrays import Prefix, ranges, raw, signed, slices
from qrelia.operators.joins import broadcast_if_small
from qrelia.session import durable

#: Names with more spans than this are compared by a Spark aggregation, not inside one task.
SPANS_IN_TASK = 5_000
SLICE = 1 << 18  # bytes of text that a task looks at together; its arrays take about a hundred times that
_FLUSH_BYTES = 1 << 18  # of spans compared together
_LOW = np.int64(0xFFFFFFFF)


@dataclass
class Parsed:
    units: np.ndarray  # first unit of each row, one more entry than rows
    starts: np.ndarray | None  # byte starts and ends of the units; None where units are bytes
    ends: np.ndarray | None
    symbols: np.ndarray
    prefix: Prefix | None = None
    lo: np.ndarray | None = None  # anchors, in order
    hi: np.ndarray | None = None
    name: np.ndarray | None = None


UNITS, HASHES, ANCHORS = range(3)  # how far to parse


@dataclass(frozen=True)
class Repeats:
    """What is looked for.

    ``parse(bytes, offsets, depth)`` makes units, their prefix hashes and anchors. ``earlier`` asks for a copy in a
    row of smaller id; otherwise any other place will do. ``same(parsed, starts, width)`` numbers the different
    windows among those that start at ``starts``.
    """

    width: int
    parse: Callable[[np.ndarray, np.ndarray, int], Parsed]
    earlier: bool
    same: Callable[[Parsed, np.ndarray, int], np.ndarray]


def same_by_hash(p: Parsed, starts: np.ndarray, width: int) -> np.ndarray:
    """Windows told apart by two hashes."""
    pair = np.rec.fromarrays([p.prefix.hashes(starts, starts + width), Prefix(p.symbols, 1).hashes(starts, starts + width)])
    return np.unique(pair, return_inverse=True)[1]


def owned(p: Parsed, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, s0, s1) of the anchors that own windows; of equal names the left one owns."""
    n = len(p.lo)
    row = np.searchsorted(p.units, p.lo, "right") - 1
    s0 = np.maximum(p.units[row], p.hi - width)
    s1 = np.minimum(p.lo, p.units[row + 1] - width)
    for left in (True, False):
        active, step = np.flatnonzero(s0 <= s1), 1
        while len(active):
            other = active - step if left else active + step
            ok = (other >= 0) & (other < n)
            active, other = active[ok], other[ok]
            reach = p.lo[other] >= s0[active] if left else p.hi[other] <= s1[active] + width
            ok = reach & (row[other] == row[active])
            active, other = active[ok], other[ok]
            beaten = p.name[other] <= p.name[active] if left else p.name[other] < p.name[active]
            if left:
                s0[active[beaten]] = p.lo[other[beaten]] + 1
            else:
                s1[active[beaten]] = p.hi[other[beaten]] - width - 1
            active, step = active[~beaten], step + 1
    own = np.flatnonzero(s0 <= s1)
    return own, s0[own], s1[own]


def bare(p: Parsed, width: int, s0: np.ndarray, s1: np.ndarray) -> np.ndarray:
    """Starts of windows that hold no anchor."""
    n = int(p.units[-1])
    depth = np.cumsum(np.bincount(s0, minlength=n + 1) - np.bincount(s1 + 1, minlength=n + 2)[: n + 1])
    starts = ranges(p.units[:-1], np.maximum(np.diff(p.units) - width + 1, 0))
    return starts[depth[starts] == 0]


def _spans(p: Parsed, width: int) -> tuple[np.ndarray, ...]:
    """(row, name, span hash, first window, last window) of every anchor and bare window of a slice; windows count within rows."""
    own, s0, s1 = owned(p, width)
    alone = bare(p, width, s0, s1)
    name = np.r_[p.name[own], p.prefix.hashes(alone, alone + width)]
    s0, s1 = np.r_[s0, alone], np.r_[s1, alone]
    span = p.prefix.hashes(s0, s1 + width)
    if len(alone):  # here the name says no more than the span: another hash
        span[len(own) :] = Prefix(p.symbols, 1).hashes(alone, alone + width)
    row = np.searchsorted(p.units, s0, "right") - 1
    return row, name, span, s0 - p.units[row], s1 - p.units[row]


def _pack(s0: np.ndarray, s1: np.ndarray) -> np.ndarray:
    return (s0.astype(np.int64) << 32) | s1


def _names(find: Repeats):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, body, at in slices(batch.column(2), SLICE):
                row, name, *_ = _spans(find.parse(body, at, ANCHORS), find.width)
                if find.earlier:  # one row for each document and name
                    pair = np.unique(np.rec.fromarrays([signed(name), ids[first + row]]))
                    name, ident = pair["f0"], pair["f1"]
                    counts = np.ones(len(name), np.int64)
                else:
                    name, counts = np.unique(signed(name), return_counts=True)
                    ident = np.zeros(len(name), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(ident), pa.array(counts)], names=["name", "d", "n"])

    return emit


def _occurrences(find: Repeats):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, body, at in slices(batch.column(2), SLICE):
                row, name, span, s0, s1 = _spans(find.parse(body, at, ANCHORS), find.width)
                # A name that stands several times in a document, as in periodic texts, is one row.
                order = np.lexsort((s0, span, name, row))
                row, name, span, s = row[order], name[order], span[order], _pack(s0, s1)[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (name[1:] != name[:-1]) | (span[1:] != span[:-1])
                at = np.flatnonzero(new)
                take = pa.array(first + row[at])
                columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(signed(name[at])), pa.array(signed(span[at]))]
                places = pa.ListArray.from_arrays(pa.array(np.r_[at, len(row)].astype(np.int32)), pa.array(s))
                yield pa.RecordBatch.from_arrays([*columns, places], names=["_d", "_k", "name", "span", "s"])

    return emit


def covered(starts: np.ndarray, stops: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Union of the intervals as maximal runs within 0..n."""
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    depth = np.cumsum(np.bincount(starts, minlength=n + 1) - np.bincount(stops, minlength=n + 1))
    edge = np.diff(np.r_[0, (depth[:n] > 0).astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _window_answers(find: Repeats, rows: list[tuple], sizes: tuple) -> list[np.ndarray]:
    """For every span the first windows of answered runs and their last ones, packed."""
    texts = pa.array([r[0] for r in rows], pa.binary())
    value, asks = sizes
    body, at = raw(texts)
    p = find.parse(body, at, HASHES)
    count = np.maximum(np.diff(p.units) - find.width + 1, 0)
    starts, owner = ranges(p.units[:-1], count), np.repeat(np.arange(len(rows)), count)
    group = find.same(p, starts, find.width)
    total = np.zeros(group.max() + 1 if len(group) else 0, np.int64)
    if find.earlier:
        total += np.iinfo(np.int64).max
        np.minimum.at(total, group, value[owner])
        good = total[group] < value[owner]
    else:
        np.add.at(total, group, value[owner])
        good = total[group] >= 2
    good &= asks[owner]
    out = []
    bounds = np.r_[0, np.cumsum(count)]
    for i in range(len(rows)):
        edge = np.diff(np.r_[0, good[bounds[i] : bounds[i + 1]].astype(np.int8), 0])
        out.append(_pack(np.flatnonzero(edge == 1) + rows[i][1], np.flatnonzero(edge == -1) - 1 + rows[i][1]))
    return out


_ANSWER = "_d long, _k long, s array<long>"
_ANSWER_TYPES = [pa.int64(), pa.int64(), pa.list_(pa.int64())]


def _compare(find: Repeats):
    """Spans arrive sorted by name; whole groups are compared together, several at a time."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        value = np.array([h[5] for h in held], np.int64)
        asks = np.array([h[6] for h in held], bool)
        found = _window_answers(find, [(h[4], h[3]) for h in held], (value, asks))
        keep = [i for i, f in enumerate(found) if len(f)]
        columns = [[held[i][0] for i in keep], [held[i][1] for i in keep], [found[i].tolist() for i in keep]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ANSWER_TYPES, strict=True)], names=["_d", "_k", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > _FLUSH_BYTES and row[2] != held[-1][2]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield flush(held)

    return run


def _single_windows(find: Repeats):
    """A row for every window of the spans of very frequent names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, body, at in slices(batch.column(4), SLICE):
                p = find.parse(body, at, HASHES)
                count = np.maximum(np.diff(p.units) - find.width + 1, 0)
                starts, owner = ranges(p.units[:-1], count), np.repeat(np.arange(len(count)), count)
                take = pa.array(first + owner)
                base = batch.column(3).take(take).to_numpy() + starts - p.units[owner]
                h = [p.prefix.hashes(starts, starts + find.width), Prefix(p.symbols, 1).hashes(starts, starts + find.width)]
                columns = [batch.column(i).take(take) for i in (0, 1, 5, 6)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, *(pa.array(signed(x)) for x in h), pa.array(_pack(base, base))], names=["_d", "_k", "v", "ask", "h1", "h2", "s"]
                )

    return run


def _answers(find: Repeats, spans: DataFrame) -> DataFrame:
    """Answered windows of the spans (``_d, _k, name, s0, text, v, ask, many``)."""
    columns = ["_d", "_k", "name", "s0", "text", "v", "ask"]
    few = spans.where("NOT many").select(*columns).repartition("name").sortWithinPartitions("name")
    found = few.mapInArrow(_compare(find), _ANSWER)
    windows = durable(
        spans.where("many").select(*columns).mapInArrow(_single_windows(find), "_d long, _k long, v long, ask boolean, h1 long, h2 long, s long")
    )
    total = F.min("v") if find.earlier else F.sum("v")
    groups = windows.groupBy("h1", "h2").agg(total.alias("total"))
    good = F.col("total") < F.col("v") if find.earlier else F.col("total") >= 2
    rest = windows.where("ask").join(groups, ["h1", "h2"]).where(good).groupBy("_d", "_k").agg(F.collect_list("s").alias("s"))
    return found.unionByName(rest)


def _finish(find: Repeats, finish, extra: int, fields: Sequence[T.StructField]):
    """Rows (extra columns, _d, _k, text, s lists, open spans) become results, or wait for answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, texts, answered, waiting = batch.columns[extra:]
            for first, body, at in slices(texts, SLICE):
                p = find.parse(body, at, UNITS)
                n = len(at) - 1
                done, kept, spans = [], [], []
                for i in range(n):
                    got = answered[first + i].as_py()
                    ask = waiting[first + i].as_py()
                    text = body[at[i] : at[i + 1]]
                    places = None if p.starts is None else (p.starts[p.units[i] : p.units[i + 1]] - at[i], p.ends[p.units[i] : p.units[i + 1]] - at[i])
                    if ask:
                        kept.append(text.tobytes())
                        cut = []
                        for w in ask:
                            s0, s1 = w["s"] >> 32, w["s"] & 0xFFFFFFFF
                            a, b = (s0, s1 + find.width) if places is None else (places[0][s0], places[1][s1 + find.width - 1])
                            cut.append({"name": w["name"], "s0": s0, "text": text[a:b].tobytes(), "v": w["v"], "ask": w["ask"], "many": w["many"]})
                        spans.append(cut)
                        done.append(None)
                        continue
                    s = np.array(got or [], np.int64)
                    size = int(p.units[i + 1] - p.units[i])
                    runs = covered(s >> 32, (s & _LOW) + find.width, size)
                    kept.append(None)
                    spans.append(None)
                    done.append(finish(text, places, runs))
                columns = [c.slice(first, n) for c in batch.columns[: extra + 2]]
                columns += [pa.array(kept, pa.binary()), answered.slice(first, n), pa.array(spans, _SPANS)]
                columns += [pa.array([None if d is None else d[j] for d in done], kind) for j, kind in enumerate(_arrow(fields))]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[: extra + 2], "_text", "_s", "_spans", *(f.name for f in fields)])

    return run


_SPANS = pa.list_(
    pa.struct([("name", pa.int64()), ("s0", pa.int64()), ("text", pa.binary()), ("v", pa.int64()), ("ask", pa.bool_()), ("many", pa.bool_())])
)
_SPANS_SQL = "array<struct<name:long,s0:long,text:binary,v:long,ask:boolean,many:boolean>>"
_ARROW = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _arrow(fields: Sequence[T.StructField]) -> list[pa.DataType]:
    return [_ARROW[f.dataType.simpleString()] for f in fields]


def _merge_copies(shared: DataFrame, copies: DataFrame) -> DataFrame:
    """``shared`` with one row per span of a document, however often its id and text are repeated; ``m`` counts them."""
    small = broadcast_if_small(copies)
    same = ["_d", "_k", "name", "span"]
    merged = shared.join(small, ["_d", "_k"], "left_semi").groupBy(*same).agg(F.first("s").alias("s"), F.count(F.lit(1)).alias("m"))
    return durable(shared.join(small, ["_d", "_k"], "left_anti").withColumn("m", F.lit(1).cast("long")).unionByName(merged))


def _open_rows(find: Repeats, shared: DataFrame, limit: int) -> DataFrame:
    """Per document the answered windows ``s`` and the spans still to be compared."""
    turn = F.xxhash64("_d", "_k", "s")
    value = F.min("_d") if find.earlier else F.sum(F.size("s") * F.col("m"))
    groups = durable(shared.groupBy("name", "span").agg(value.cast("long").alias("v"), F.min(turn).alias("r")))
    several = durable(groups.groupBy("name").agg(F.count(F.lit(1)).alias("spans")))
    known = durable(groups.join(several, "name"))
    good = F.col("v") < F.col("_d") if find.earlier else F.col("v") >= 2
    asks = ~good & (F.col("spans") > 1)
    # Of equal spans one speaks for all; those that ask bring themselves.
    speaks = (F.col("spans") > 1) & good & (F.col("r") == turn)
    v = F.col("_d") if find.earlier else F.col("v")
    many = F.col("spans") > limit
    sent = F.when(asks, F.col("s")).when(speaks, F.slice("s", 1, 1)).otherwise(F.array().cast("array<long>"))
    spans = F.transform(sent, lambda s: F.struct(F.col("name"), s.alias("s"), v.alias("v"), asks.alias("ask"), many.alias("many")))
    return (
        shared.join(known, ["name", "span"])
        .select("_d", "_k", F.when(good, F.col("s")).alias("s"), F.when(asks | speaks, spans).alias("w"))
        .groupBy("_d", "_k")
        .agg(F.flatten(F.collect_list("s")).alias("_s"), F.flatten(F.collect_list("w")).alias("_w"))
    )


def apply_repeats(
    docs: DataFrame,
    find: Repeats,
    finish: Callable,
    fields: Sequence[T.StructField],
    doc_id: str = "doc_id",
    text: str = "text",
    keep: Sequence[str] = (),
    spans_in_task: int = SPANS_IN_TASK,
) -> DataFrame:
    """``keep`` columns and ``finish(bytes, places, (run starts, run ends))`` for every row of ``docs``.

    Runs are maximal covered runs of units; ``places`` are byte starts and ends of the row's units (None for
    bytes). A null id counts as larger than every other.
    """
    ident: Column = F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1))
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    base = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(keep)], ident.alias("_d"), F.xxhash64(text).alias("_k"), body.alias("_text"))
    # Executions below read the texts anew: twice for anchors, once for the results.
    plain = base.select("_d", "_k", "_text")
    named = plain.mapInArrow(_names(find), "name long, d long, n long").groupBy("name")
    if find.earlier:
        shared_names = named.agg(F.min("d").alias("a"), F.max("d").alias("b")).where("a < b")
    else:
        shared_names = named.agg(F.sum("n").alias("n")).where("n > 1")
    occurrences = plain.mapInArrow(_occurrences(find), "_d long, _k long, name long, span long, s array<long>")
    # A written side lets Spark split the other side of the join where a name is hot.
    shared = durable(occurrences.join(durable(shared_names.select("name")), "name", "left_semi"))
    # Rows that repeat id and text are compared once: their lists would grow with the square of their number.
    copies = durable(base.groupBy("_d", "_k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_d", "_k"))
    repeated = not copies.isEmpty()
    shared = _merge_copies(shared, copies) if repeated else shared.withColumn("m", F.lit(1).cast("long"))
    known = _open_rows(find, shared, spans_in_task)

    extra, none = len(keep), [T.StructField(f.name, f.dataType) for f in base.schema.fields[: len(keep)]]
    waiting = base.join(known, ["_d", "_k"], "left").select(*[f.name for f in none], "_d", "_k", "_text", "_s", "_w")
    schema = T.StructType([*none, T.StructField("_d", T.LongType()), T.StructField("_k", T.LongType())])
    schema.add("_text", T.BinaryType()).add("_s", T.ArrayType(T.LongType()))
    schema.add("_spans", T._parse_datatype_string(_SPANS_SQL))
    for f in fields:
        schema.add(f)
    first = durable(waiting.mapInArrow(_finish(find, finish, extra, fields), schema))
    names = [f.name for f in fields]
    columns = [*[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)], *names]

    pending = first.where("_spans IS NOT NULL")
    asking = pending.select("_d", "_k", "_spans")
    if repeated:
        small = broadcast_if_small(copies)
        once = asking.join(small, ["_d", "_k"], "left_semi").groupBy("_d", "_k").agg(F.first("_spans").alias("_spans"))
        asking = asking.join(small, ["_d", "_k"], "left_anti").unionByName(once)
    spans = asking.select("_d", "_k", F.inline("_spans"))
    answers = _answers(find, spans).groupBy("_d", "_k").agg(F.flatten(F.collect_list("s")).alias("_a"))
    everything = F.concat(F.coalesce("_s", F.array()), F.coalesce("_a", F.array()))
    again = (
        pending.join(answers, ["_d", "_k"], "left")
        .select(*[f.name for f in none], "_d", "_k", "_text", everything.alias("_s"), F.lit(None).cast("array<struct<name:long,s:long,v:long,ask:boolean,many:boolean>>").alias("_w"))
        .mapInArrow(_finish(find, finish, extra, fields), schema)
    )
    return first.where("_spans IS NULL").select(*columns).unionByName(again.select(*columns))
