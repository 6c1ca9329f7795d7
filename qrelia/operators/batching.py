"""Packing rows into batches in which no text occurs twice."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from qrelia.operators.positions import with_row_position
from qrelia.session import durable

_CANDIDATES_PER_SLOT = 2
_SHORT_LIST = 100_000  # batch numbers
WINDOW_BATCHES = 32_768  # bits of one bitmap of Spark's bitmap aggregates
_PICK_ROWS = 1_024  # bitmaps looked at together by a task
_MASK_BYTES = 64 << 20  # masks of open batches are broadcast up to this size


def text_keys(texts: Column) -> Column:
    """Distinct hashes of a row's texts, stripped and lower-cased.

    Equal texts always have equal keys; a hash collision could only keep two
    different texts out of one batch.
    """
    present = F.filter(texts, lambda t: t.isNotNull())
    return F.array_distinct(F.transform(present, lambda t: F.xxhash64(F.lower(F.trim(t)))))


def _fill(state: Column, candidates: Column, batch_size: int) -> Column:
    """Take candidates in order while the batch has room and shares none of their texts."""

    def take(acc, c):
        fits = (F.size(acc["ids"]) < batch_size) & ~F.arrays_overlap(acc["keys"], c["keys"])
        taken = F.struct(
            F.array_append(acc["ids"], c["row_id"]).alias("ids"),
            F.concat(acc["keys"], c["keys"]).alias("keys"),
        )
        return F.when(fits, taken).otherwise(acc)

    return F.aggregate(candidates, state, take)


def no_duplicate_batches(
    df: DataFrame,
    texts: Column,
    batch_size: int,
    row_id: str = "row_id",
    group: str = "query",
    seed: int = 0,
) -> DataFrame:
    """``(row_id, batch_id)`` for every row; NULL means the row is in no batch.

    There are ``floor(rows / batch_size)`` batches. Rows are first dealt out like
    cards in the order of their query, which puts the rows of a query into
    different batches, and each batch keeps what fits. The batches that are still
    open are then numbered and cut into windows. Every text has a bitmap of the
    open batches of a window that hold it; a row looks at one window, and a zero bit
    of the OR of its texts' bitmaps is a batch that it fits into. A row without
    a zero bit goes on to the next window and leaves after the last one: batches only gain
    texts, so a blocked window stays blocked. The end is proved by that: every
    batch is full, or every row left shares a text with every open batch. A batch never
    holds more than ``batch_size`` rows or looks at more than a fixed multiple
    of that per round, so no group grows with the data; rows it did not look at
    are dealt again.
    """
    rows = df.select(
        F.col(row_id).cast("long").alias("row_id"),
        F.xxhash64(F.lit(seed), F.col(group)).alias("_g"),
        text_keys(texts).alias("keys"),
    )
    seen = Observation()
    # Texts are hashed once: numbering reads its input twice, to choose and to fill its ranges.
    rows = durable(rows.observe(seen, F.count(F.lit(1)).alias("n")))
    n = seen.get["n"]
    n_batches = n // batch_size
    every = rows.select("row_id")
    if n_batches == 0:
        return every.withColumn("batch_id", F.lit(None).cast("long"))

    dealt = with_row_position(rows, ["_g", "row_id"], "_p")
    none = F.array().cast("array<long>")
    state = df.sparkSession.range(n_batches).select(F.col("id").alias("batch"), none.alias("ids"), none.alias("keys"))
    state, seen = _play_round(state, dealt.select("row_id", "keys", (F.col("_p") % n_batches).alias("batch")), batch_size, seed)
    is_open = F.size("ids") < batch_size
    finished = [state.where(~is_open)]
    left = dealt.select("row_id", "keys", F.lit(0).alias("tried")).join(_placed(state), "row_id", "left_anti")
    state = durable(_number_batches(state.where(is_open), seen["open"], "slot"))
    windows = -(-seen["open"] // WINDOW_BATCHES)
    n_left, round_no = n - seen["held"], 0

    while seen["open"] and n_left:
        round_no += 1
        looked = Observation()
        picked = pick_free_batches(state, left, windows, seed + round_no)
        gone = F.count_if(F.col("tried") >= windows)  # blocked in every window
        picked = durable(picked.observe(looked, F.count("slot").alias("fitting"), gone.alias("gone")))
        n_left -= looked.get["gone"]
        left = picked.where(F.col("tried") < windows).select("row_id", "keys", "tried")
        if looked.get["fitting"]:
            # Each of these rows fits when it arrives, so a batch takes at least the first.
            asked = picked.where("slot IS NOT NULL").join(state.select("slot", "batch"), "slot")
            n_before = seen["held_open"]
            state, seen = _play_round(state, asked.select("row_id", "keys", "batch"), batch_size, seed + round_no, ["slot"])
            n_left -= seen["held"] - n_before
            left = left.join(_placed(state), "row_id", "left_anti")
            finished.append(state.where(~is_open))
            state = state.where(is_open)

    parts = [*finished, state]
    placed = reduce(DataFrame.unionByName, [p.select(F.explode("ids").alias("row_id"), F.col("batch").alias("batch_id")) for p in parts])
    return every.join(placed, "row_id", "left")


def _placed(state: DataFrame) -> DataFrame:
    return state.select(F.explode("ids").alias("row_id"))


def _play_round(state: DataFrame, pending: DataFrame, batch_size: int, salt: int, extra: list[str] | None = None) -> tuple[DataFrame, dict[str, int]]:
    """Fill every batch of ``state`` from the rows dealt to it; also counts: open batches, rows held by all and by open ones."""
    turn = F.xxhash64("row_id", F.lit(salt))
    first = Window.partitionBy("batch").orderBy("turn", "row_id")
    # A literal bound on row_number lets Spark cut each input partition before
    # the shuffle; rows beyond it stay pending for the next round.
    candidates = (
        pending.withColumn("turn", turn)
        .withColumn("_r", F.row_number().over(first))
        .where(F.col("_r") <= _CANDIDATES_PER_SLOT * batch_size)
        .groupBy("batch")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "row_id", "keys"))).alias("c"))
    )
    held = F.struct("ids", "keys")
    filled = F.when(F.col("c").isNull(), held).otherwise(_fill(held, F.col("c"), batch_size))
    seen = Observation()
    columns = ["batch", *(extra or [])]
    played = state.join(candidates, "batch", "left").select(*columns, filled.alias("s")).select(*columns, "s.ids", "s.keys")
    size = F.size("ids")
    in_open = F.sum(F.when(size < batch_size, size).otherwise(0))
    counts = [F.count_if(size < batch_size).alias("open"), F.sum(size).alias("held"), in_open.alias("held_open")]
    return durable(played.observe(seen, *counts)), seen.get


def _window(slot: Column) -> Column:
    return (slot / WINDOW_BATCHES).cast("int")


def held_bitmaps(state: DataFrame) -> DataFrame:
    """(key, window, held): the open batches of a window that hold a text, as one bit each."""
    slots = state.select(_window(F.col("slot")).alias("window"), (F.col("slot") % WINDOW_BATCHES).alias("bit"), F.explode("keys").alias("key"))
    return slots.groupBy("key", "window").agg(F.bitmap_construct_agg("bit").alias("held"))


def texts_held(state: DataFrame, left: DataFrame) -> DataFrame:
    """(row_id, held): the bitmaps of a row's texts in its window; at most one row per text of a row."""
    wanted = left.select("row_id", "window", F.explode("keys").alias("key"))
    return wanted.join(held_bitmaps(state), ["key", "window"]).select("row_id", "held")


_NONE_HELD = bytes(WINDOW_BATCHES // 8)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_SET = _BITS.sum(axis=1).astype(np.int32)
_NTH = np.argsort(1 - _BITS, axis=1, kind="stable")  # places of the set bits of a byte first


def nth_set_bit(bits: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Per row of bytes the set bit number ``turn`` modulo their count; -1 if none is set."""
    upto = np.cumsum(_SET[bits], axis=1)
    total = upto[:, -1]
    k = turn % np.maximum(total, 1)
    byte = (upto > k[:, None]).argmax(axis=1)
    row = np.arange(len(bits))
    inside = k - (upto[row, byte] - _SET[bits[row, byte]])
    return np.where(total > 0, byte * 8 + _NTH[bits[row, byte], np.minimum(inside, 7)], -1)


def pick_free_batches(state: DataFrame, left: DataFrame, windows: int, salt: int) -> DataFrame:
    """(row_id, keys, tried, slot): ``slot`` is an open batch that holds none of the row's texts.

    ``tried`` counts the windows in which a row found none; the next one is looked at in the next round.
    """
    start = F.pmod(F.xxhash64("row_id"), F.lit(windows))
    left = left.withColumn("window", F.pmod(start + F.col("tried"), F.lit(windows)).cast("int"))
    blocked = texts_held(state, left).groupBy("row_id").agg(F.bitmap_or_agg("held").alias("blocked"))
    slots = state.select(_window(F.col("slot")).alias("window"), (F.col("slot") % WINDOW_BATCHES).alias("bit"))
    masks = slots.groupBy("window").agg(F.bitmap_construct_agg("bit").alias("open"))
    if windows * WINDOW_BATCHES // 8 <= _MASK_BYTES:
        masks = F.broadcast(masks)
    none = F.lit(_NONE_HELD)
    rows = left.join(blocked, "row_id", "left").join(masks, "window", "left").select(
        "row_id",
        "keys",
        F.col("tried").cast("int").alias("tried"),
        "window",
        F.pmod(F.xxhash64("row_id", F.lit(salt)), F.lit(1 << 40)).alias("turn"),
        F.coalesce("open", none).alias("open"),
        F.coalesce("blocked", none).alias("blocked"),
    )
    picked = rows.mapInArrow(_pick, "row_id long, keys array<long>, tried int, window long, bit long")
    slot = F.col("window") * WINDOW_BATCHES + F.col("bit")
    return picked.select("row_id", "keys", "tried", slot.alias("slot"))


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, _PICK_ROWS):
            batch = whole.slice(start, _PICK_ROWS)
            free = _bytes(batch.column("open")) & ~_bytes(batch.column("blocked"))
            bit = nth_set_bit(free, batch.column("turn").to_numpy())
            tried = batch.column("tried").to_numpy() + (bit < 0).astype(np.int32)
            numbers = [pa.array(tried, pa.int32()), batch.column("window").cast(pa.int64()), pa.array(bit.astype(np.int64), mask=bit < 0)]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("keys"), *numbers], names=["row_id", "keys", "tried", "window", "bit"])


def placeable_rows(rows: DataFrame, texts: Column, batches: DataFrame, batch_size: int, row_id: str = "row_id") -> DataFrame:
    """Rows without a batch that share no text with some batch that has room; none if the end was proved."""
    keyed = rows.select(F.col(row_id).cast("long").alias("row_id"), text_keys(texts).alias("keys")).join(batches, "row_id")
    keyed = durable(keyed)
    state = keyed.where("batch_id IS NOT NULL").groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.flatten(F.collect_list("keys")).alias("keys"))
    total = keyed.count() // batch_size
    every = keyed.sparkSession.range(total).select(F.col("id").alias("batch_id"))
    state = every.join(state, "batch_id", "left").where(F.coalesce("n", F.lit(0)) < batch_size)
    state = durable(state.select(F.col("batch_id").alias("batch"), F.coalesce("keys", F.array().cast("array<long>")).alias("keys")))
    n_open = state.count()
    waiting = keyed.where("batch_id IS NULL").select("row_id", "keys")
    if not n_open:
        return waiting.select("row_id").limit(0)
    state = _number_batches(state, n_open, "slot")
    windows = -(-n_open // WINDOW_BATCHES)
    looked = [pick_free_batches(state, waiting.withColumn("tried", F.lit(w)), windows, 0) for w in range(windows)]
    return reduce(DataFrame.unionByName, looked).where("slot IS NOT NULL").select("row_id").distinct()


def _number_batches(batches: DataFrame, n: int, name: str) -> DataFrame:
    """Add ``name`` = 0..n-1; a short list is numbered in one task."""
    if n > _SHORT_LIST:
        return with_row_position(batches, ["batch"], name)
    numbers = batches.select("batch").withColumn(name, (F.row_number().over(Window.orderBy("batch")) - 1).cast("long"))
    return batches.join(numbers, "batch")
