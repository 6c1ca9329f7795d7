import pytest

from checks import tables


@pytest.mark.parametrize("small", [True, False])
def test_passages_are_found_without_a_row_for_every_word(spark, monkeypatch, small):
    docs = [(1, "xx one longest two yy"), (2, "one longest"), (3, None), (4, "aone longest twob one longest two"), (5, ""), (6, "a b\nc d")]
    items = [(1, "one longest two"), (2, "one longest two"), (3, "b\nc d"), (4, None), (5, "zz longest two")]
    monkeypatch.setattr(tables, "fits_broadcast", lambda df: small)
    documents = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    pairs = tables.planted_pairs(documents, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, pairs.collect())) == [(1, 1), (1, 4), (2, 1), (2, 4), (3, 6)]
    assert ("Generate" in pairs._jdf.queryExecution().executedPlan().toString()) != small
