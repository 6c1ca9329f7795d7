"""Connected components against union-find, and how many Spark jobs large classes take."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from qrelia.llm.components import connected_components
from qrelia.llm.order_minhash import MARK_BITS, _marked, _merged_roots
from qrelia.session import durable


def roots_of(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {x: find(x) for x in root}


def frame(spark, edges):
    return spark.createDataFrame(edges, "a long, b long")


def jobs(spark, run):
    """What ``run`` gives and the number of jobs it took."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def shuffled_chain(n):
    names = random.Random(3).sample(range(10 * n), n)
    return list(zip(names, names[1:]))


GRAPHS = {
    "none": [],
    "loops and nulls": [(1, 1), (None, 2), (3, None), (5, 4), (4, 5), (5, 4)],
    "star": [(0, i) for i in range(1, 50)],
    "star of the largest": [(i, 99) for i in range(50)],
    "chain": shuffled_chain(60),
    "random": [(random.Random(i).randrange(200), random.Random(-i - 1).randrange(200)) for i in range(120)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components_equal_union_find(spark, name):
    got = [tuple(r) for r in connected_components(frame(spark, GRAPHS[name])).collect()]
    assert len(got) == len({n for n, _ in got})
    assert dict(got) == roots_of(GRAPHS[name])


def test_structs_are_nodes(spark):
    edges = frame(spark, GRAPHS["chain"]).select(*[F.struct((F.col(c) % 7).alias("k1"), F.col(c).alias("k2")).alias(c) for c in ("a", "b")])
    got = {tuple(r.node): tuple(r.root) for r in connected_components(edges).collect()}
    assert got == roots_of([((a % 7, a), (b % 7, b)) for a, b in GRAPHS["chain"]])


def test_further_links_merge_components(spark):
    first, more = GRAPHS["random"][:60], [(-5, 300), (300, 301), (301, 301), *GRAPHS["random"][60:]]
    before = roots_of(first)
    roots = durable(connected_components(frame(spark, first)))
    for links in (more, []):
        got = [tuple(r) for r in _merged_roots(roots, frame(spark, links)).collect()]
        assert len(got) == len({n for n, _ in got})
        assert dict(got) == roots_of([*before.items(), *links]) | {n: n for n, r in before.items() if r == n and n not in roots_of([*before.items(), *links])}


def test_stars_take_no_rounds(spark):
    """Leaders and their copies: nothing is left to be linked, and finding that out is one look at the links."""
    star = durable(frame(spark, GRAPHS["star"]))
    empty, base = jobs(spark, lambda: connected_components(star.where("a < 0")).collect())
    found, taken = jobs(spark, lambda: connected_components(star).collect())
    assert not empty and len(found) == 50
    assert taken <= base + 3


def test_bitmap_is_read_by_one_run(spark):
    """An iterator runs a job for every shuffle partition."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    old = {n: spark.conf.get(n) for n in names}
    keys = spark.range(1000).select((F.col("id") * 7919 - 3_000_000).alias("k1"))
    spark.conf.set(names[0], "40")
    spark.conf.set(names[1], "false")
    try:
        found, taken = jobs(spark, lambda: _marked(keys))
    finally:
        for n, v in old.items():
            spark.conf.set(n, v)
    bits = len(found) * 8
    assert bits <= MARK_BITS
    expected = np.zeros(bits, np.uint8)
    expected[[(i * 7919 - 3_000_000) % bits for i in range(1000)]] = 1
    assert (np.unpackbits(found, bitorder="little") == expected).all()
    assert taken < 20


def test_roots_have_no_row_of_their_own(spark):
    from qrelia.llm.components import components_below, downward

    expected = {n: r for n, r in roots_of(GRAPHS["random"]).items() if n != r}
    got = [tuple(r) for r in components_below(downward(frame(spark, GRAPHS["random"])).distinct()).collect()]
    assert len(got) == len(expected) and dict(got) == expected


def test_shingles_counted_over_more_texts_lose_no_pair(spark):
    """One pass over the shingles of all texts serves those that can be near, too."""
    from qrelia.llm import order_minhash

    rng = np.random.default_rng(6)
    texts = []
    for i in range(10):
        base = rng.integers(0, 300, 50).tolist()
        texts += [base, [x if rng.random() > 0.06 else 1000 + int(rng.integers(400)) for x in base]]
        texts.append([*base[:25], *rng.integers(2000 + 100 * i, 2100 + 100 * i, 25).tolist()])  # can be near to none
    kept = [np.array(list(dict.fromkeys(t)), np.uint32) for t in texts]
    sequences = spark.createDataFrame([(i, -i, s.tobytes()) for i, s in enumerate(kept)], "k1 long, k2 long, seq binary")
    known = spark.createDataFrame([(i, -i, len(s), i) for i, s in enumerate(kept)], "k1 long, k2 long, n long, r long")
    counted = durable(order_minhash._shingles_of(known, sequences))
    possible = durable(order_minhash._possible(known, sequences, 0.8, counted))
    assert possible.count() < len(texts)
    prefixes = order_minhash._prefixes(possible, sequences, 0.8, counted)
    found = {(p.a1, p.b1) for p in order_minhash._cross_pairs(prefixes, 0.8).collect()}
    near = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if order_minhash.aligned_similarity(kept[i], kept[j]) >= 0.8}
    assert near and near <= found
