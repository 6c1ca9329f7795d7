"""Retrieval and triplet inputs derived from the given tables, in Spark.

``checks/oracle.py`` states the same inputs as SQL.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qrelia.functions.text import word_lists, words
from qrelia.operators.blocks import pieces
from qrelia.operators.joins import fits_broadcast
from qrelia.operators.pooling import pool_vectors
from qrelia.session import durable, spread
from qrelia.sources.retrieval import RetrievalData, RetrievalSpec, load_spec


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, df.columns[0])


# --- passages planted in documents ---------------------------------------------


def planted_pairs(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(item_id, doc_id) where the document contains the passage.

    A document can only contain a passage if it has the passage's longest inner
    word (the outer words may be glued to the surrounding text), so documents are
    found by an equi-join on that word and then checked against the whole passage.
    """
    inner = F.expr("slice(w, 2, size(w) - 2)")
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    items = benchmark.select(
        "item_id", F.col("text").alias("passage"), words(F.col("text")).alias("w")
    ).select("item_id", "passage", longest["w"].alias("word")).where("word IS NOT NULL")
    if fits_broadcast(items):
        return _found_in_tasks(documents, items)
    docs = documents.select("doc_id", "text", F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
    return docs.join(items, "word").where(F.contains("text", "passage")).select("item_id", "doc_id")


def _found_in_tasks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The same join with a broadcast of the items, on words that Arrow splits."""
    sent = documents.sparkSession.sparkContext.broadcast(items.toArrow())
    kinds = dict(documents.dtypes) | dict(items.dtypes)

    def find(batches):
        found = sent.value
        coded = found.column("word").combine_chunks().dictionary_encode()
        passages = [p.encode() for p in found.column("passage").to_pylist()]
        n_words = max(len(coded.dictionary), 1)
        order = np.argsort(coded.indices.to_numpy(), kind="stable")
        of_word = np.split(order, np.searchsorted(coded.indices.to_numpy()[order], np.arange(1, n_words)))
        for batch in pieces(batches):
            texts = batch.column("text")
            lists = word_lists(texts)
            word = pc.index_in(lists.flatten(), value_set=coded.dictionary)
            doc = pc.list_parent_indices(lists).filter(word.is_valid()).to_numpy().astype(np.int64)
            pairs = np.unique(doc * n_words + word.drop_null().to_numpy())
            rows = []
            for d, w in zip(*(x.tolist() for x in np.divmod(pairs, n_words))):
                text = texts[d].as_py().encode()
                rows += [(i, d) for i in of_word[w] if passages[i] in text]
            item, doc = np.array(rows, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays(
                [found.column("item_id").combine_chunks().take(pa.array(item)), batch.column("doc_id").take(pa.array(doc))], names=["item_id", "doc_id"]
            )

    return documents.select("doc_id", "text").mapInArrow(find, f"item_id {kinds['item_id']}, doc_id {kinds['doc_id']}")


def bench_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Passages as queries over all documents.

    Judged documents are those containing the passage (score 1), and for every
    passage the document of the same number (score 0 unless it contains it).
    """
    documents = table(spark, sf_dir, "documents")
    benchmark = table(spark, sf_dir, "benchmark")
    hits = durable(planted_pairs(documents, benchmark)).withColumn("score", F.lit(1))
    same_number = (
        benchmark.select("item_id")
        .join(documents.select("doc_id"), F.col("item_id") == F.col("doc_id"))
        .select("item_id", "doc_id", F.lit(0).alias("score"))
    )
    judged = hits.unionByName(same_number).groupBy("item_id", "doc_id").agg(F.max("score").alias("score"))
    return {
        "corpus": documents.select(
            F.col("doc_id").alias("id"), F.col("source").alias("title"), "text", F.col("doc_id").alias("pos")
        ),
        "queries": benchmark.select(
            F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.col("item_id").alias("pos")
        ),
        "qrels": judged.select(
            F.col("item_id").alias("query_id"),
            F.col("doc_id").alias("corpus_id"),
            "score",
            F.struct("item_id", "doc_id").alias("pos"),
        ),
    }


# --- question and answer turns ---------------------------------------------------


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn and the assistant turn that follows it."""
    turns = table(spark, sf_dir, "conversations")
    users = turns.where("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("question"), (F.col("turn") + 1).alias("reply")
    )
    replies = turns.where("role = 'assistant'").select(
        "conv_id", F.col("turn").alias("reply"), F.col("text").alias("answer")
    )
    return users.join(replies, ["conv_id", "reply"])


def turn_id(conv_id: str, turn: str):
    return F.concat_ws("-", F.col(conv_id), F.col(turn))


def chat_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """User turns as queries over all assistant turns; the next turn is relevant."""
    turns = table(spark, sf_dir, "conversations")
    pos = F.struct("conv_id", "turn").alias("pos")
    pairs = turn_pairs(spark, sf_dir)
    return {
        "corpus": turns.where("role = 'assistant'").select(
            turn_id("conv_id", "turn").alias("_id"), "text", pos
        ),
        "queries": turns.where("role = 'user'").select(
            turn_id("conv_id", "turn").alias("qid"), F.col("text").alias("sentence"), pos
        ),
        "qrels": pairs.select(
            turn_id("conv_id", "turn").alias("query-id"),
            turn_id("conv_id", "reply").alias("corpus-id"),
            F.lit(1).alias("relevance"),
            pos,
        ),
    }


def qa_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a context; exact copies repeat it."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("context"),
        F.concat_ws(" ", "lang", "source").alias("question"),
        F.col("source").alias("title"),
        F.col("doc_id").alias("pos"),
    )


BENCH = RetrievalSpec(dataset="bench", name="team/bench")
CHAT = RetrievalSpec(dataset="chat")
QA = RetrievalSpec(dataset="qa", format="squad")


def reader(spark: SparkSession, sf_dir: str, spec: RetrievalSpec):
    """Table reader of a spec whose tables are derived from the given ones."""
    if spec.dataset == "qa":
        return lambda _: qa_table(spark, sf_dir)
    tables = {"bench": bench_tables, "chat": chat_tables}[spec.dataset](spark, sf_dir)
    return tables.__getitem__


def load(spark: SparkSession, sf_dir: str, spec: RetrievalSpec, limit=None, extra=None) -> RetrievalData:
    return load_spec(spark, spec, limit, extra, read=reader(spark, sf_dir, spec))


# --- vectors -----------------------------------------------------------------------


def label_retrieval(spark: SparkSession, sf_dir: str) -> RetrievalData:
    """Pooled vectors of each label as queries; the label's own vectors are relevant."""
    vectors = table(spark, sf_dir, "embeddings")
    corpus = vectors.select(F.col("vec_id").cast("string").alias("doc_id"), F.col("embedding").alias("vector"))
    modes = ("mean", "max", "cls")
    queries = qrels = None
    for mode in modes:
        def name():
            return F.concat_ws(":", F.lit(mode), F.col("label")).alias("query_id")

        pooled = pool_vectors(vectors, "label", "embedding", "vec_id", mode).select(
            name(), F.col("pooled").alias("vector")
        )
        judged = vectors.select(name(), F.col("vec_id").cast("string").alias("doc_id"), F.lit(1).alias("score"))
        queries = pooled if queries is None else queries.unionByName(pooled)
        qrels = judged if qrels is None else qrels.unionByName(judged)
    return RetrievalData(corpus, queries, qrels)


def vector_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with the next one as positive and the one after as negative."""
    v = table(spark, sf_dir, "embeddings")
    anchor = v.select("vec_id", F.col("embedding").alias("anchor"))
    positive = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("positive"))
    negative = v.select((F.col("vec_id") - 2).alias("vec_id"), F.col("embedding").alias("negative"))
    return anchor.join(positive, "vec_id").join(negative, "vec_id").withColumnRenamed("vec_id", "pos")


# --- text triplets -------------------------------------------------------------------


def text_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source and language as query, a document as positive, the next one as negative."""
    docs = table(spark, sf_dir, "documents")
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("negative"))
    return docs.join(following, "doc_id").select(
        F.col("doc_id").alias("pos"),
        F.concat_ws("/", "source", "lang").alias("query"),
        F.col("text").alias("positive"),
        "negative",
    )


def chat_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turn as query, its answer as positive; the query itself stands in as negative."""
    return turn_pairs(spark, sf_dir).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"),
        F.col("question").alias("query"),
        F.col("answer").alias("positive"),
        F.col("question").alias("negative"),
    )


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as the metric log of a run, ordered by time."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.struct("ts", "event_id").alias("step"), "value"
    )
