"""Packing documents into sequences of bounded length by minimum bin slack.

A document's ids are cut into full pieces and one remainder. What matters for packing is only how many
pieces there are of each length, a table of at most ``capacity`` numbers however large the corpus is. Bins are filled on that
table: the longest remaining length opens a bin, and subset-sum dynamic programming on a
bitset of reachable sums finds the multiset of remaining lengths that comes closest to the capacity; the counts are
read back from the stages of the bitset. A filling is repeated as long as its lengths last.

Spark then numbers the pieces of each length and looks up the place of each number. The numbers are
given within (length, salt), so that a length that a third of all pieces share is still spread.

Null texts are empty and give one piece with the end id. Repeated rows are packed one by one. An empty table gives an
empty result. Extra columns are not used.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qrelia.llm.tokens import encoded
from qrelia.session import durable

CAPACITY = 4096
END_ID = 2
ROWS_PER_SALT = 50_000


def best_filling(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, how many) with the largest sum up to ``room``; longer lengths are tried first.

    Bit s of ``reach`` says that sum s can be made. Multiplicities are split into powers of two.
    """
    reach, full = 1, (1 << (room + 1)) - 1
    stages: list[tuple[int, int, int]] = []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left = min(counts[length], room // length)
        part = 1
        while left > 0:
            take = min(part, left)
            more = (reach | reach << (take * length)) & full
            if more != reach:
                stages.append((length, take, reach))
                reach = more
            left -= take
            part *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    out: dict[int, int] = {}
    for length, take, before in reversed(stages):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + take
            at -= take * length
    return sorted(out.items(), reverse=True)


def fill_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(how many bins, filling) until no piece is left."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    bins = []
    while counts:
        longest = max(counts)
        rest = dict(counts)
        rest[longest] -= 1
        filling = dict(best_filling({n: c for n, c in rest.items() if c}, capacity - longest))
        filling[longest] = filling.get(longest, 0) + 1
        times = min(counts[n] // m for n, m in filling.items())
        bins.append((times, sorted(filling.items(), reverse=True)))
        for n, m in filling.items():
            counts[n] -= m * times
            if not counts[n]:
                del counts[n]
    return bins


def placement(bins: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first number, first sequence, per sequence, offset), sorted by length and number."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, filling in bins:
        offset = 0
        for length, m in filling:
            rows.append((length, used.get(length, 0), sequence, m, offset))
            used[length] = used.get(length, 0) + m * times
            offset += m * length
        sequence += times
    table = np.array(rows, np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens."""
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, ids, at in encoded(batch.column(1), tokenizer):
                rows, out = [], []
                for i in range(len(at) - 1):
                    own = np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(own), capacity):
                        piece = own[start : start + capacity]
                        rows.append(first + i)
                        out.append((start, len(piece), zlib.crc32(piece.tobytes()), len(own)))
                numbers = np.array(out, np.int64).reshape(-1, 4)
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(numbers[:, j]) for j in range(4))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return plain.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, rows_per_salt: int = ROWS_PER_SALT, **names) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset``."""
    pieces = durable(cut_pieces(docs, tokenizer, capacity, end_id, **names))
    salts = max(1, -(-pieces.count() // rows_per_salt))
    # By place in the written files: rows that are equal in everything are spread as well.
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("_metadata.file_path", "_metadata.row_index"), F.lit(salts)))
    groups = durable(salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = placement(fill_bins(histogram, capacity))
    places = docs.sparkSession.sparkContext.broadcast(table)  # bounded by the capacity, not by the corpus

    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = groups.select("length", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    number = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "start")) - 1
    numbered = salted.withColumn("_n", number).join(firsts, ["length", "_salt"])
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = places.value
        key = (rows[:, 0] << 48) + rows[:, 1]
        for batch in batches:
            length, n = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(key, (length << 48) + n, "right") - 1
            q = n - rows[at, 1]
            m = rows[at, 3]
            added = [pa.array(rows[at, 2] + q // m), pa.array(rows[at, 4] + q % m * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *added], names=[*columns, "sequence_id", "offset"])

    types = ", ".join(f"{c} long" for c in [*columns, "sequence_id", "offset"])
    return numbered.select(*columns, (F.col("_n") + F.col("_first")).cast("long").alias("_n")).mapInArrow(place, types)
