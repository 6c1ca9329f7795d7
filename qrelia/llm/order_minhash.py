"""Near-duplicate documents by Order MinHash.

A text is a sequence of five-word shingles, each labelled with how often it has occurred before, so that every
labelled shingle of a text is unique. A sketch takes the ``PICKED`` least labelled shingles under one random
order and keeps them in text order: equal sketches need common shingles in the same order, which makes them follow edit
similarity. ``SKETCHES`` sketches are drawn; texts that agree in one are candidates.

Candidates are verified by a banded alignment of their labelled shingles. As these are unique, the best alignment is the
longest chain of common shingles that rises in both texts within the band. Two texts
are near duplicates if aligned / (all shingles of both - aligned) is at least ``SIMILARITY``.

Equal texts are one text from the start. In each bucket the most central text (the one with most company over all its sketches) is
aligned with all others, and components are formed. Buckets that still hold several components are searched for the links left:
near texts have one of their rarest shingles in common, so pairs are formed by these only, and only in different components.
This bound is exact: no link that a bucket shows is lost.
Texts shorter than five words have one shingle, their words; texts without words only equal themselves.

Null texts are empty texts; null ids count as larger than all others. Repeated rows fall into one class. Empty tables
give empty results; extra columns are only kept by ``drop_near_duplicates``, which keeps all.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qrelia.llm.components import components_below, downward, with_roots
from qrelia.llm.tables import fresh_names
from qrelia.llm.textarrays import Prefix, U, mix, signed, slices, words
from qrelia.session import durable

SHINGLE = 5
PICKED = 4
SKETCHES = 20
SIMILARITY = 0.8
PAIRS_PER_SALT = 500
SLICE = 1 << 18  # bytes of text that a task looks at together
MARK_BITS = 1 << 27  # of the bitmap of texts that share a sketch: 16 MB

_RNG = np.random.default_rng(5)
_ODD = _RNG.integers(1, 1 << 63, SKETCHES, dtype=np.int64).astype(U) * U(2) + U(1)
_XOR = _RNG.integers(1, 1 << 63, SKETCHES, dtype=np.int64).astype(U)


def labelled(h: np.ndarray) -> np.ndarray:
    """Hashes that also tell the number of earlier equal ones."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    if new.all():
        return h
    at = np.arange(len(s))
    earlier = at - np.maximum.accumulate(np.where(new, at, 0))
    out = np.empty_like(h)
    out[order] = np.where(earlier > 0, mix(s + earlier.astype(U) * U(0x9E3779B97F4A7C15)), s)
    return out


def shingles(body: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Labelled shingle hashes of every row, in text order."""
    starts, ends, rows = words(body, offsets)
    names = Prefix(body).hashes(starts, ends)
    prefix = Prefix(names)
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        first = np.arange(a, max(b - SHINGLE + 1, min(a + 1, b)))
        yield labelled(prefix.hashes(first, np.minimum(first + SHINGLE, b)))


def sketches(h: np.ndarray) -> np.ndarray:
    """One number for each sketch: its shingles in text order, hashed."""
    if not len(h):
        return np.empty(0, U)
    order = (h[None, :] ^ _XOR[:, None]) * _ODD[:, None]
    k = min(PICKED, len(h))
    at = np.argpartition(order, k - 1, axis=1)[:, :k] if k < len(h) else np.broadcast_to(np.arange(k), (SKETCHES, k))
    picked = h[np.sort(at, axis=1)]
    total = np.arange(SKETCHES).astype(U) + U(k << 32)
    for j in range(k):
        total = mix(total * U(0x9E3779B97F4A7C15) + picked[:, j])
    return total


def _keys(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    d = F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1))
    return docs.select(d.alias("d"), F.xxhash64(body).alias("k1"), F.xxhash64(body, F.lit(1)).alias("k2"), body.alias("_text"))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, body, at in slices(batch.column(3), SLICE):
            size, drawn = [], []
            for h in shingles(body, at):
                size.append(len(h))
                drawn.append(signed(sketches(h)))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in drawn])], pa.int32()), pa.array(np.concatenate(drawn)))
            columns = [c.slice(first, len(size)) for c in batch.columns[:3]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(size, pa.int64()), lists], names=["d", "k1", "k2", "n", "keys"])


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, 32-bit labelled shingles as bytes)"""
    for batch in batches:
        for first, body, at in slices(batch.column(2), SLICE):
            seq = [(h >> U(32)).astype(np.uint32).tobytes() for h in shingles(body, at)]
            yield pa.RecordBatch.from_arrays([*(c.slice(first, len(seq)) for c in batch.columns[:2]), pa.array(seq, pa.binary())], names=["k1", "k2", "seq"])


def _longest_rising(values: np.ndarray) -> int:
    from bisect import bisect_left

    tails: list[int] = []
    for v in values.tolist():
        at = bisect_left(tails, v)
        tails[at : at + 1] = [v]
    return len(tails)


def aligned_similarity(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """Aligned share within the band that ``similarity`` leaves; 0 where it cannot be reached."""
    total = len(a) + len(b)
    share = Fraction(str(similarity))
    most = total * (share.denominator - share.numerator) // (share.denominator + share.numerator)  # unaligned shingles of both, at most
    if not total or abs(len(a) - len(b)) > most:
        return 0.0
    ua, ia = np.unique(a, return_index=True)
    ub, ib = np.unique(b, return_index=True)
    at = np.searchsorted(ub, ua)
    same = ub[np.minimum(at, len(ub) - 1)] == ua
    i, j = ia[same], ib[at[same]]
    near = np.abs(i - j) <= most
    i, j = i[near], j[near]
    if total - 2 * len(i) > most:
        return 0.0
    j = j[np.argsort(i)]
    n = len(j) if (np.diff(j) > 0).all() else _longest_rising(j)
    return n / (total - n)


def _align(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (leader, salt, member or null for the leader's own, sequence), the leader's row first."""
        key, own = None, None
        for batch in batches:
            la, lb, salt, ma, mb, seq = (c.to_pylist() for c in batch.columns)
            out = []
            for i, s in enumerate(seq):
                values = np.frombuffer(s, np.uint32)
                if ma[i] is None:
                    key, own = (la[i], lb[i], salt[i]), values
                elif key == (la[i], lb[i], salt[i]) and aligned_similarity(own, values, similarity) >= similarity:
                    out.append((la[i], lb[i], ma[i], mb[i]))
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a1", "a2", "b1", "b2"])

    return run


def _node(k1: str, k2: str) -> Column:
    return F.struct(F.col(k1).alias("k1"), F.col(k2).alias("k2"))


def _links(pairs: DataFrame) -> DataFrame:
    return pairs.select(_node("a1", "a2").alias("a"), _node("b1", "b2").alias("b"))


def _salts(members: str) -> Column:
    """Over how many tasks a leader's members are dealt."""
    return F.ceil(F.col(members) / PAIRS_PER_SALT).cast("int").alias("salts")


def _verified(leaders: DataFrame, pairs: DataFrame, sequences: DataFrame, similarity: float) -> DataFrame:
    """The near-duplicate ones of the distinct pairs (a1, a2, salts, b1, b2); ``leaders`` (a1, a2, salts) has each a once.

    The leader's sequence is sent once for every salt, members in between.
    """
    left = sequences.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), "seq")
    heads = leaders.join(left, ["a1", "a2"]).select("a1", "a2", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "seq")
    none = F.lit(None).cast("long")
    heads = heads.select("a1", "a2", "salt", none.alias("b1"), none.alias("b2"), "seq")
    right = sequences.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), "seq")
    members = pairs.withColumn("salt", F.pmod(F.xxhash64("b1", "b2"), "salts").cast("int"))
    members = members.join(right, ["b1", "b2"]).select("a1", "a2", "salt", "b1", "b2", "seq")
    rows = heads.unionByName(members).repartition("a1", "a2", "salt").sortWithinPartitions("a1", "a2", "salt", F.col("b1").asc_nulls_first())
    return rows.mapInArrow(_align(similarity), "a1 long, a2 long, b1 long, b2 long")


def _fraction(similarity: float) -> tuple[int, int]:
    share = Fraction(str(similarity))
    return share.numerator, share.denominator


def _single_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different shingles, one a row, behind the other columns of their text; the sequence comes last."""
    for batch in batches:
        each = [np.unique(np.frombuffer(s, np.int32)) for s in batch.column(batch.num_columns - 1).to_pylist()]
        owner = pa.array(np.repeat(np.arange(len(each)), [len(x) for x in each]))
        columns = [c.take(owner) for c in batch.columns[:-1]]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate([np.empty(0, np.int32), *each]))], names=[*batch.schema.names[:-1], "shingle"])


def _placed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the ``root`` of their ``node``; nodes that stand in no link are their own."""
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _split_texts(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(k1, k2, n, r) of the texts in buckets that hold more than one component; ``r`` tells components apart."""
    rows = rows.select("key", "n", _node("k1", "k2").alias("node"))
    ends = _placed(rows, roots).groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    texts = rows.join(durable(ends.where("lo < hi").select("key")), "key", "left_semi").groupBy("node").agg(F.first("n").alias("n"))
    return _placed(texts, roots).select("node.k1", "node.k2", "n", F.xxhash64("root").alias("r"))


def _shingles_of(texts: DataFrame, sequences: DataFrame) -> DataFrame:
    """(shingle, f, k1, lo, hi): in how many of ``texts`` (k1, k2, n, r) it is, the least of these, the least and largest ``r``.

    Only those that one text alone or several components have.
    """
    each = sequences.join(texts, ["k1", "k2"]).select("k1", "r", "seq").mapInArrow(_single_shingles, "k1 long, r long, shingle int")
    counted = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("f"), F.min("k1").alias("k1"), F.min("r").alias("lo"), F.max("r").alias("hi"))
    return counted.where("f = 1 OR lo < hi").withColumn("f", F.col("f").cast("int"))


def _possible(texts: DataFrame, sequences: DataFrame, similarity: float, counted: DataFrame | None = None) -> DataFrame:
    """``texts`` (k1, k2, n, r) without those that cannot be near any other.

    Shingles that no other text of ``texts`` has cannot be aligned. Texts that merely share a passage, or copies
    edited too much, drop out here, however many there are. ``counted`` may give the ``_shingles_of`` the texts.
    """
    counted = _shingles_of(texts, sequences) if counted is None else counted
    own = counted.where("f = 1").groupBy("k1").agg(F.count(F.lit(1)).alias("own"))
    p, q = _fraction(similarity)
    return texts.join(own, "k1", "left").where((F.col("n") - F.coalesce("own", F.lit(0))) * q >= F.col("n") * p).drop("own")


def _prefixes(texts: DataFrame, sequences: DataFrame, similarity: float, counted: DataFrame | None = None) -> DataFrame:
    """(shingle, k1, k2, n, r, after): the rarest shingles of each text, so many that near texts have one in common.

    All texts order their shingles alike: those that only one component has, then by frequency. ``after`` counts
    the shared ones that follow; a common shingle with fewer than the alignment needs cannot be a pair's first.
    ``counted`` may give the ``_shingles_of`` these texts, or of more: then some count as shared that need not.
    """
    p, q = _fraction(similarity)
    # Rows of shingles carry as little as they can: the text's other columns come back when most rows are gone.
    own = sequences.join(texts, ["k1", "k2"], "left_semi").select("k1", "seq")
    # A written side lets Spark split the other side where a shingle is hot.
    counted = durable(_shingles_of(texts, sequences)) if counted is None else counted
    several = counted.where("lo < hi").select("shingle", "f")
    shared = own.mapInArrow(_single_shingles, "k1 long, shingle int").join(several, "shingle")
    rarest_last = Window.partitionBy("k1").orderBy(F.col("f").desc(), F.col("shingle").desc())
    ranked = shared.withColumn("after", F.row_number().over(rarest_last) - 1).join(texts, "k1")
    return ranked.where((F.col("after") + 1) * q >= F.col("n") * p).select("shingle", "k1", "k2", "n", "r", "after")


def _cross_pairs(prefixes: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs in different components that can be near, by a common shingle of their prefixes."""
    p, q = _fraction(similarity)
    several = prefixes.groupBy("shingle").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).where("lo < hi").select("shingle")
    prefixes = durable(prefixes.join(durable(several), "shingle", "left_semi"))
    a, b = prefixes.alias("a"), prefixes.alias("b")
    # Aligned shingles are at most this common one and those that follow it in both.
    near = (F.least("a.after", "b.after") + 1) * (p + q) >= (F.col("a.n") + F.col("b.n")) * p
    order = F.struct("a.k1", "a.k2") < F.struct("b.k1", "b.k2")
    joined = a.join(b, [F.col("a.shingle") == F.col("b.shingle"), near, order, F.col("a.r") != F.col("b.r")])
    return joined.select(F.col("a.k1").alias("a1"), F.col("a.k2").alias("a2"), F.col("b.k1").alias("b1"), F.col("b.k2").alias("b2")).distinct()


def _marked(keys: DataFrame) -> np.ndarray:
    """Bytes of a bitmap with a bit for every ``k1``; at most ``MARK_BITS`` bits, whatever the corpus."""
    width = 32_768  # of Spark's bitmaps
    bits = min(MARK_BITS, max(width, 1 << (16 * keys.count()).bit_length()))
    slot = F.pmod("k1", F.lit(bits)) + 1
    found = keys.groupBy(F.bitmap_bucket_number(slot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros((bits // width, width // 8), np.uint8)
    for row in found.collect():  # 4 kB a row, 16 MB at most; one job, where an iterator runs one for every partition
        out[row["part"] - 1] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def _sequences_of(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k1, k2, seq) of the texts ``wanted``.

    Most texts share no sketch. A bitmap of bounded size spares them being cut into shingles and shuffled;
    what it lets through by chance goes in the join.
    """
    marks = keyed.sparkSession.sparkContext.broadcast(_marked(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = marks.value
        for batch in batches:
            slot = batch.column(0).to_numpy() % np.int64(len(bits) * 8)
            marked = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1
            yield from _sequences([batch.filter(pa.array(marked.astype(bool)))])

    plain = keyed.select("k1", "k2", "_text").mapInArrow(run, "k1 long, k2 long, seq binary")
    return plain.join(wanted, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("seq").alias("seq"))


def _merged_below(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root), written, after the components that the further ``links`` (a, b) join have become one.

    Only links between whole components are left to be searched, whose nodes are the least of their components. Roots
    have no row, neither in ``roots`` nor in what is returned.
    """
    for end in ("a", "b"):
        found = roots.withColumnRenamed("node", end)
        links = links.join(found, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    merged = components_below(downward(links).distinct())
    moved = roots.join(merged.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return durable(moved.unionByName(merged))


def _merged_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``_merged_below`` where every root has a row."""
    return with_roots(_merged_below(roots.where("node <> root"), links))


def near_duplicate_texts(keyed: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(k1, k2, copies, text_id, class_id, class_size, class_key, is_first) for every different text of ``_keys``.

    Ids may be null or stand on several texts, so only ``class_key``, from the root of the component, tells classes
    apart. ``is_first`` is true for one text of each class, the least (text_id, k1, k2).
    """
    drawn = keyed.mapInArrow(_sketched, "d long, k1 long, k2 long, n long, keys array<long>")
    texts = durable(
        drawn.groupBy("k1", "k2").agg(F.min("d").alias("text_id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    )
    entries = texts.select(F.explode("keys").alias("key"), "k1", "k2", "n")
    # Sides that are written before a join let Spark split the other side where a key is hot.
    company = durable(entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    # A text has ``SKETCHES`` rows at most, and so has its window.
    in_text = Window.partitionBy("k1", "k2").orderBy("key")
    whole = in_text.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = entries.join(company, "key").withColumns({"company": F.sum("size").over(whole), "turn": F.row_number().over(in_text)})
    ranked = durable(ranked.drop("size"))
    rank = F.struct("company", "k1", "k2")
    best = durable(ranked.groupBy("key").agg(F.max(F.struct("company", "k1", "k2", "n")).alias("c")))
    # A leader has no more members than company.
    pairs = durable(
        ranked.join(best, "key")
        .where((rank != F.struct("c.company", "c.k1", "c.k2")) & (F.least("n", "c.n") >= similarity * F.greatest("n", "c.n")))
        .select(F.col("c.k1").alias("a1"), F.col("c.k2").alias("a2"), _salts("c.company"), F.col("k1").alias("b1"), F.col("k2").alias("b2"))
        .distinct()
    )
    leaders = pairs.groupBy("a1", "a2").agg(F.first("salts").alias("salts"))
    sequences = durable(_sequences_of(keyed, ranked.where("turn = 1").select("k1", "k2")))
    # Leaders outrank their members, so no pair is linked twice.
    roots = components_below(downward(_links(_verified(leaders, pairs, sequences, similarity))))
    split = durable(_split_texts(ranked, roots))
    counted = durable(_shingles_of(split, sequences))
    prefixes = durable(_prefixes(durable(_possible(split, sequences, similarity, counted)), sequences, similarity, counted))
    pairs = durable(_cross_pairs(prefixes, similarity))
    leaders = durable(pairs.groupBy("a1", "a2").agg(F.count(F.lit(1)).alias("members"))).select("a1", "a2", _salts("members"))
    roots = _merged_below(roots, _links(_verified(leaders, pairs.join(leaders, ["a1", "a2"]), sequences, similarity)))
    grouped = _placed(texts.select("k1", "k2", "text_id", "copies", _node("k1", "k2").alias("node")), roots).drop("node")
    classes = grouped.groupBy("root").agg(F.min(F.struct("text_id", "k1", "k2")).alias("first"), F.sum("copies").alias("class_size"))
    is_first = (F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2"))
    class_key = F.concat(*(F.lpad(F.hex(f"root.{k}"), 16, "0") for k in ("k1", "k2")))
    found = grouped.join(classes, "root")
    return found.select("k1", "k2", "copies", "text_id", F.col("first.text_id").alias("class_id"), "class_size", class_key.alias("class_key"), is_first.alias("is_first"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_id (least id with the same text), class_id (least id of the near-duplicate class), class_size, class_key.

    Classes that share their least id have different ``class_key``.
    """
    keyed = _keys(docs, doc_id, text)
    found = near_duplicate_texts(keyed, similarity)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("k1"), F.xxhash64(F.coalesce(text, F.lit("")), F.lit(1)).alias("k2"))
    return rows.join(found, ["k1", "k2"]).select("doc_id", "text_id", "class_id", "class_size", "class_key")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class, the one of least id; all columns stay as they are."""
    body = F.coalesce(F.col(text), F.lit(""))
    found = durable(near_duplicate_texts(_keys(docs, doc_id, text), similarity))
    # Ids do not tell classes apart: each class keeps its first text, and of that text's rows one of least id.
    k1, k2, least, copies = fresh_names(docs, "k1", "k2", "least", "copies")
    kept = found.where("is_first")
    kept = kept.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("text_id").alias(least), F.col("copies").alias(copies))
    keyed = docs.withColumns({k1: F.xxhash64(body), k2: F.xxhash64(body, F.lit(1)), least: F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1))})
    rows = keyed.join(kept, [k1, k2, least])
    single = rows.where(F.col(copies) == 1)
    repeated = rows.where(F.col(copies) > 1).dropDuplicates([k1, k2, least])
    return single.unionByName(repeated).select(*docs.columns)
