"""Every operator as a query over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import tables as t
from qrelia.functions.text import (
    bm25_tokenize,
    cast_id,
    cast_score,
    corpus_text,
    falsy_to_empty,
    max_tokens,
    normalize_text,
)
from qrelia.functions.vectors import dot_score, truncate_normalize
from qrelia.operators import bm25, bm25_store, dense, metrics, ranking, runlog, triplets
from qrelia.operators.batching import no_duplicate_batches, placeable_rows, text_keys
from qrelia.operators.encode import encode_texts, hashing_encoder
from qrelia.operators.loss import in_batch_loss
from qrelia.operators.metrics import Cutoffs
from qrelia.operators.pooling import pool_vectors
from qrelia.plans import evaluate, prepare, validation
from qrelia.session import durable, scratch_dir
from qrelia.sources import report, retrieval, splits
from qrelia.sources.tables import (
    QREL_DOC_ALIASES,
    QREL_QUERY_ALIASES,
    SCORE_ALIASES,
    load_triplets,
    resolve_col,
    trim_triplets,
    union_sources,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CUTOFFS = Cutoffs()
DIMS = (64, 32, 16, 8)
ENCODER_DIM = 64
ENCODER_DIMS = (64, 16)
LOSS_BATCH = 32
TEXT_BATCH = 16
PATIENCE = 4
CHECKPOINT_DIMS = (8, 64, 32, 24)  # of the models of a run, one per evaluation
SCORE_ROUND = 4  # digits of a score; sums differ in their last bits between engines
SPLIT_SIZE, SEED = 0.1, 42


def query(key: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[key] = fn
        return fn

    return register


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(
        *[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]
    )


def _parts(data: retrieval.RetrievalData) -> DataFrame:
    """The three tables of a loaded dataset under one another."""
    none, no_score = F.lit(None).cast("string"), F.lit(None).cast("int")
    rows = [
        data.corpus.select(F.lit("corpus").alias("part"), none.alias("query_id"), "doc_id", no_score.alias("score"), "text"),
        data.queries.select(F.lit("queries").alias("part"), "query_id", none.alias("doc_id"), no_score.alias("score"), "text"),
        data.qrels.select(F.lit("qrels").alias("part"), "query_id", "doc_id", "score", none.alias("text")),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# --- sources -----------------------------------------------------------------------


@query("load_triplets")
def q_load_triplets(spark, d):
    paths = []
    for name, df in (("text", t.text_triplets(spark, d)), ("chat", t.chat_triplets(spark, d))):
        paths.append(f"{_fresh(spark, 'triplets')}/{name}")
        df.write.parquet(paths[-1])
    loaded = load_triplets(spark, paths, order_by=["pos"])
    return loaded.select(
        F.element_at(F.split("source", "/"), -1).alias("source"), "query", "positive", "negative"
    )



@query("load_beir")
def q_load_beir(spark, d):
    return _parts(t.load(spark, d, t.BENCH))


@query("load_squad")
def q_load_squad(spark, d):
    return _parts(t.load(spark, d, t.QA))


@query("load_spec")
def q_load_spec(spark, d):
    return _parts(t.load(spark, d, t.CHAT))


@query("resolve_col")
def q_resolve_col(spark, d):
    qrels = t.chat_tables(spark, d)["qrels"]
    q = resolve_col(qrels.columns, "query_id", QREL_QUERY_ALIASES, "qrel query id")
    doc = resolve_col(qrels.columns, "doc", QREL_DOC_ALIASES, "qrel corpus id")
    score = resolve_col(qrels.columns, "score", SCORE_ALIASES, "qrel score")
    return qrels.select(
        qrels[f"`{q}`"].alias("query_id"), qrels[f"`{doc}`"].alias("doc_id"), qrels[score].alias("score")
    )



def _bm25_results(spark, d):
    return evaluate.evaluate_bm25([t.BENCH, t.CHAT], lambda s: t.load(spark, d, s), CUTOFFS)


@query("write_results_json")
def q_write_results_json(spark, d):
    path = _fresh(spark, "json")
    report.write_results_json(durable(_bm25_results(spark, d)), path, CUTOFFS, "bm25")
    back = spark.read.json(f"{path}/datasets")
    rows = back.select("model_path", "dataset", "folder", F.explode("results").alias("r"))
    names = [n for n in rows.select("r.*").columns]
    return _rounded(
        rows.select(
            "model_path",
            "dataset",
            "folder",
            *[F.col(f"r.`{n}`").alias(n.replace("@", "_")) for n in names if n != "truncate_dim"],
            F.col("r.truncate_dim").cast("int").alias("truncate_dim"),
        )
    )


@query("results_markdown")
def q_results_markdown(spark, d):
    lines = report.results_markdown(durable(_bm25_results(spark, d)), CUTOFFS)
    return lines


@query("results_card")
def q_results_card(spark, d):
    path = _fresh(spark, "card")
    card = report.results_card(
        durable(_bm25_results(spark, d)), CUTOFFS, "report", [], [t.BENCH.label, t.CHAT.label]
    )
    report.write_lines(card, path, ["section", "line_no"])
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    return lines


@query("append_metric_log")
def q_append_metric_log(spark, d):
    path = _fresh(spark, "log")
    per_user = t.table(spark, d, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("steps"),
        # Values have two decimals: a decimal sum does not depend on the order of its terms.
        (F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("validation_loss"),
    )
    rows = per_user.withColumn("epoch", F.col("user_id").cast("double"))
    report.append_metric_log(rows.where("steps <= 60"), path)
    report.append_metric_log(rows.where("steps > 60"), path)
    back = spark.read.schema(report.METRIC_LOG_SCHEMA).option("header", True).csv(path)
    return back.select("epoch", "steps", "validation_loss")


# --- scalar functions ----------------------------------------------------------------


@query("read_split")
def q_read_split(spark, d):
    """Two named splits of JSON lines, which Spark's own reader would give no order."""
    turns = t.table(spark, d, "conversations")
    path = _fresh(spark, "splits")
    for name, odd in (("train", 0), ("test", 1)):
        turns.where(F.col("conv_id") % 2 == odd).select("conv_id", "turn", "role", "text").write.json(f"{path}/turns/{name}")
    parts = [splits.read_split(spark, path, "turns", name, "json").withColumn("split", F.lit(name)) for name in (None, "train")]
    rows = parts[0].withColumn("split", F.lit("test")).unionByName(parts[1])
    return rows.select("split", "conv_id", "turn", "role", "text")


@query("normalize_text")
def q_normalize_text(spark, d):
    return t.table(spark, d, "documents").select("doc_id", normalize_text(F.col("text")).alias("text"))



@query("corpus_text")
def q_corpus_text(spark, d):
    docs = t.table(spark, d, "documents")
    # English documents are given no title, so both branches occur.
    title = F.when(F.col("lang") == "en", F.lit("")).otherwise(F.col("source"))
    return docs.select("doc_id", corpus_text(title, F.col("text")).alias("text"))



@query("falsy_to_empty")
def q_falsy_to_empty(spark, d):
    docs = t.table(spark, d, "documents").join(t.table(spark, d, "labels"), "doc_id", "left")
    return docs.select(
        "doc_id",
        falsy_to_empty(docs, "quality").alias("title"),
        falsy_to_empty(docs, "no_such_column").alias("missing"),
    )



@query("cast_ids")
def q_cast_ids(spark, d):
    return t.table(spark, d, "events").select(
        cast_id(F.col("event_id")).alias("doc_id"),
        cast_id(F.col("user_id")).alias("query_id"),
        cast_score(F.col("value")).alias("score"),
    )


@query("bm25_tokenize")
def q_bm25_tokenize(spark, d):
    docs = t.table(spark, d, "documents")
    tokens = bm25_tokenize(F.col("text"))
    return docs.select("doc_id", F.size(tokens).alias("n_tokens"), F.array_join(tokens, "|").alias("tokens"))



@query("triplet_projection")
def q_triplet_projection(spark, d):
    return triplets.triplet_projection(t.text_triplets(spark, d), hard_negatives=False)


@query("texts_array")
def q_texts_array(spark, d):
    df = t.text_triplets(spark, d)
    texts = df.select("pos", triplets.texts_array(df).alias("texts"))
    return texts.select("pos", F.posexplode("texts").alias("i", "text"))


@query("evaluator_payload")
def q_evaluator_payload(spark, d):
    return triplets.evaluator_payload(triplets.triplet_projection(t.text_triplets(spark, d), False), 200)


@query("sentence_columns")
def q_sentence_columns(spark, d):
    df = t.text_triplets(spark, d)
    labels = t.table(spark, d, "labels").select(F.col("doc_id").alias("pos"), "quality")
    rows = df.select("pos", triplets.texts_array(df).alias("texts")).join(labels, "pos", "left")
    rows = rows.withColumn("quality", F.coalesce("quality", F.lit(0)))
    return triplets.sentence_columns(rows, "texts", "quality")


@query("truncate_normalize")
def q_truncate_normalize(spark, d):
    cut = t.table(spark, d, "embeddings").select(
        "vec_id", F.posexplode(truncate_normalize(F.col("embedding"), 16)).alias("i", "x")
    )
    return _rounded(cut)



@query("dot_score")
def q_dot_score(spark, d):
    rows = t.vector_triplets(spark, d)
    return _rounded(rows.select("pos", dot_score(F.col("anchor"), F.col("positive")).alias("score")))



@query("context_surrogate_id")
def q_context_surrogate_id(spark, d):
    data = t.load(spark, d, t.QA)
    return data.corpus.select("doc_id", F.col("pos").alias("first_row"))


@query("max_tokens")
def q_max_tokens(spark, d):
    return t.table(spark, d, "documents").select("doc_id", max_tokens(F.col("text"), 128).alias("text"))



# --- filters, limits, duplicates --------------------------------------------------------


def _bench(spark, d, limit=None, extra=None):
    return t.load(spark, d, t.BENCH, limit, extra)


def _bench_rows(spark, d):
    """Tables of the passages dataset in internal form, before any loading rule."""
    raw = t.bench_tables(spark, d)
    corpus = raw["corpus"].select(F.col("id").cast("string").alias("doc_id"), "text", "pos")
    queries = raw["queries"].select(F.col("query_id").cast("string"), F.col("question").alias("text"), "pos")
    qrels = raw["qrels"].select(
        F.col("query_id").cast("string"), F.col("corpus_id").cast("string").alias("doc_id"), "score", "pos"
    )
    return corpus, queries, qrels


@query("limit_queries")
def q_limit_queries(spark, d):
    _, queries, _ = _bench_rows(spark, d)
    return retrieval.limit_queries(queries, 25).select("query_id", "text")


@query("qrels_for_queries")
def q_qrels_for_queries(spark, d):
    _, queries, qrels = _bench_rows(spark, d)
    kept = retrieval.qrels_for_queries(qrels, retrieval.limit_queries(queries, 25))
    return kept.select("query_id", "doc_id", "score")


@query("subset_corpus")
def q_subset_corpus(spark, d):
    corpus, _, qrels = _bench_rows(spark, d)
    kept = retrieval.subset_corpus(corpus, retrieval.positive_qrels(qrels), 60)
    return kept.select("doc_id", "text")


@query("qrels_in_corpus")
def q_qrels_in_corpus(spark, d):
    corpus, _, qrels = _bench_rows(spark, d)
    kept = retrieval.subset_corpus(corpus, retrieval.positive_qrels(qrels), 60)
    return retrieval.qrels_in_corpus(qrels, kept).select("query_id", "doc_id", "score")


@query("queries_with_qrels")
def q_queries_with_qrels(spark, d):
    corpus, queries, qrels = _bench_rows(spark, d)
    kept = retrieval.subset_corpus(corpus, retrieval.positive_qrels(qrels), 0)
    judged = retrieval.qrels_in_corpus(qrels, kept)
    return retrieval.queries_with_qrels(queries, judged).select("query_id", "text")


@query("positive_qrels")
def q_positive_qrels(spark, d):
    _, _, qrels = _bench_rows(spark, d)
    return retrieval.positive_qrels(qrels).select("query_id", "doc_id")


@query("validation_head")
def q_validation_head(spark, d):
    return triplets.validation_head(t.text_triplets(spark, d), 300).select("pos", "query", "positive")


@query("dedup_last_wins")
def q_dedup_last_wins(spark, d):
    docs = t.table(spark, d, "documents").withColumnRenamed("doc_id", "pos")
    return retrieval.dedup_last_wins(docs, ["source", "lang"], "text")


@query("dedup_corpus_last_wins")
def q_dedup_corpus_last_wins(spark, d):
    docs = t.table(spark, d, "documents").select(F.md5("text").alias("doc_id"), F.col("source").alias("text"), F.col("doc_id").alias("pos"))
    return retrieval.dedup_corpus_last_wins(docs)


@query("dedup_first_wins")
def q_dedup_first_wins(spark, d):
    docs = t.table(spark, d, "documents").withColumnRenamed("doc_id", "pos")
    return retrieval.dedup_first_wins(docs, ["source", "lang"], "text")


# --- joins --------------------------------------------------------------------------------


@query("join_context_ids")
def q_join_context_ids(spark, d):
    return t.load(spark, d, t.QA).qrels


@query("join_postings")
def q_join_postings(spark, d):
    data = _bench(spark, d)
    index = bm25.bm25_index(data.corpus)
    return _rounded(bm25.join_postings(bm25.query_terms(data.queries), index.terms))


@query("cross_score")
def q_cross_score(spark, d):
    data = t.label_retrieval(spark, d)
    return _rounded(dense.dense_rank(data.corpus, data.queries, 100), SCORE_ROUND)


@query("join_run_qrels")
def q_join_run_qrels(spark, d):
    data = _bench(spark, d)
    run = bm25.bm25_rank(data.corpus, data.queries, 100)
    return ranking.join_run_qrels(run, data.qrels).select("query_id", "doc_id", "rank", "rel")


# --- BM25 -----------------------------------------------------------------------------------


@query("bm25_tf")
def q_bm25_tf(spark, d):
    return bm25.bm25_tf(t.load(spark, d, t.CHAT).corpus)


@query("bm25_corpus_stats")
def q_bm25_corpus_stats(spark, d):
    terms = bm25.bm25_terms(_bench(spark, d).corpus)
    stats = terms.agg(
        F.max(F.when(F.col("term").isNull(), F.col("df"))).alias("n_docs"),
        F.max(F.when(F.col("term").isNull(), F.col("tokens"))).alias("n_tokens"),
        F.count("term").alias("n_terms"),
    )
    return _rounded(stats.withColumn("avgdl", F.col("n_tokens") / F.col("n_docs")))


@query("bm25_idf")
def q_bm25_idf(spark, d):
    return _rounded(bm25.bm25_index(_bench(spark, d).corpus).terms)


@query("bm25_score")
def q_bm25_score(spark, d):
    data = _bench(spark, d)
    run = bm25.bm25_rank(data.corpus, data.queries, 100, pad_zero_scores=False)
    return _rounded(run.drop("truncate_dim"), SCORE_ROUND)


@query("bm25_topk")
def q_bm25_topk(spark, d):
    data = t.load(spark, d, t.CHAT)
    return _rounded(bm25.bm25_rank(data.corpus, data.queries, 100), SCORE_ROUND)


@query("bm25_topk_stored")
def q_bm25_topk_stored(spark, d):
    """The ranking of ``bm25_topk`` from an index that was written before."""
    data = t.load(spark, d, t.CHAT)
    folder = f"{scratch_dir(spark)}/index-{uuid.uuid4().hex}"
    bm25_store.stored_index(data.corpus, folder, data.fingerprint)
    index = bm25_store.stored_index(data.corpus, folder, data.fingerprint)
    return _rounded(bm25_store.rank_by_index(index, data.queries, 100), SCORE_ROUND)


# --- metrics ------------------------------------------------------------------------------------


def _label_hits(spark, d):
    data = t.label_retrieval(spark, d)
    run = dense.dense_rank(data.corpus, data.queries, CUTOFFS.max_k, DIMS)
    return metrics.query_hits(run, data.queries, data.qrels, DIMS)


def _one_metric(kind):
    def run(spark, d):
        per_query = metrics.query_metrics(_label_hits(spark, d), CUTOFFS)
        names = [c for c in per_query.columns if c.rsplit("_", 1)[0] == kind]
        return _rounded(per_query.select("truncate_dim", "query_id", *names))

    return run


for _kind in ("accuracy", "precision", "recall", "mrr", "ndcg", "map"):
    QUERIES[f"{_kind}_at_k"] = _one_metric(_kind)


@query("macro_average")
def q_macro_average(spark, d):
    data = _bench(spark, d)
    run = bm25.bm25_rank(data.corpus, data.queries, CUTOFFS.max_k)
    return _rounded(metrics.run_metrics(run, data.queries, data.qrels, [bm25.BM25_DIM], CUTOFFS))


@query("matryoshka_sweep")
def q_matryoshka_sweep(spark, d):
    data = t.label_retrieval(spark, d)
    swept = evaluate.dense_metrics(data.corpus, data.queries, data.qrels, CUTOFFS, DIMS)
    return _rounded(swept.drop("system"))


# --- other aggregates ---------------------------------------------------------------------------------


@query("split_counts")
def q_split_counts(spark, d):
    return triplets.split_counts(triplets.split_by_query(t.text_triplets(spark, d), SPLIT_SIZE, SEED))


@query("pool_vectors")
def q_pool_vectors(spark, d):
    vectors = t.table(spark, d, "embeddings")
    out = None
    for mode in ("mean", "max", "cls"):
        pooled = pool_vectors(vectors, "label", "embedding", "vec_id", mode)
        rows = pooled.select(F.lit(mode).alias("mode"), "label", F.posexplode("pooled").alias("i", "x"))
        out = rows if out is None else out.unionByName(rows)
    return _rounded(out)



@query("in_batch_loss")
def q_in_batch_loss(spark, d):
    return _rounded(in_batch_loss(t.vector_triplets(spark, d), LOSS_BATCH, DIMS))



# --- ranking, split, logs --------------------------------------------------------------------------------


@query("rank_topk")
def q_rank_topk(spark, d):
    events = t.table(spark, d, "events").select(
        F.col("user_id").alias("query_id"), F.col("event_id").alias("doc_id"), F.col("value").alias("score")
    )
    return ranking.rank_topk(events, 10)


@query("split_by_query")
def q_split_by_query(spark, d):
    return triplets.split_by_query(t.text_triplets(spark, d), SPLIT_SIZE, SEED).select("pos", "query", "split")


@query("cumulative_hits")
def q_cumulative_hits(spark, d):
    data = t.label_retrieval(spark, d)
    run = dense.dense_rank(data.corpus, data.queries, 100, [64])
    judged = ranking.join_run_qrels(run, data.qrels)
    return ranking.cumulative_hits(judged).select("query_id", "doc_id", "rank", "rel", "hits")


@query("early_stop")
def q_early_stop(spark, d):
    stops = runlog.early_stop(t.run_log(spark, d), PATIENCE)
    return stops.select("run_id", F.col("stop_step.event_id").alias("stop_event"))


@query("best_step")
def q_best_step(spark, d):
    best = runlog.best_step(t.run_log(spark, d), PATIENCE)
    return best.select("run_id", F.col("best_step.event_id").alias("best_event"), "best_value")


# --- unions -------------------------------------------------------------------------------------------------


@query("union_sources")
def q_union_sources(spark, d):
    parts = [("text", trim_triplets(t.text_triplets(spark, d))), ("chat", trim_triplets(t.chat_triplets(spark, d)))]
    return union_sources(parts).select("pos.part", "pos.at", "source", "query", "positive", "negative")



def _settings():
    return evaluate.EvalSettings(CUTOFFS, ENCODER_DIMS, hashing_encoder(ENCODER_DIM))


@query("union_systems")
def q_union_systems(spark, d):
    return _rounded(evaluate.evaluate_dense(t.load(spark, d, t.CHAT), _settings()))


@query("union_datasets")
def q_union_datasets(spark, d):
    data = t.label_retrieval(spark, d)
    parts = []
    for mode in ("mean", "max", "cls"):
        of_mode = F.col("query_id").startswith(mode)
        swept = evaluate.dense_metrics(
            data.corpus, data.queries.where(of_mode), data.qrels.where(of_mode), CUTOFFS, DIMS
        )
        parts.append((retrieval.RetrievalSpec(dataset="labels", name=mode, split="all"), swept))
    return _rounded(evaluate.union_datasets(parts).drop("place"))


# --- batches, encoding, whole evaluations ----------------------------------------------------------------------


def _batches(spark, d):
    rows = durable(trim_triplets(t.text_triplets(spark, d)))  # read by the batches and by the check of their rules
    return rows, no_duplicate_batches(rows, triplets.texts_array(rows), TEXT_BATCH, "pos")


def _batch_rules(rows, batches):
    """Row and batch counts, and how often a rule of the batches is broken."""
    texts = triplets.texts_array(rows)
    keyed = rows.select(F.col("pos").alias("row_id"), F.explode(text_keys(texts)).alias("key"))
    in_batch = batches.where("batch_id IS NOT NULL")
    repeated = keyed.join(in_batch, "row_id").groupBy("batch_id", "key").count().where("count > 1")
    sizes = in_batch.groupBy("batch_id").count()
    n_rows = batches.agg(F.count(F.lit(1)).alias("n_rows"))
    placeable = placeable_rows(rows, texts, batches, TEXT_BATCH, "pos")
    return n_rows.select(
        "n_rows",
        sizes.agg(F.count(F.lit(1))).scalar().alias("n_batches"),
        sizes.where(F.col("count") > TEXT_BATCH).agg(F.count(F.lit(1))).scalar().alias("oversized"),
        repeated.agg(F.count(F.lit(1))).scalar().alias("repeated_texts"),
        placeable.agg(F.count(F.lit(1))).scalar().alias("placeable"),
    )


def _row_rules(rows, batches):
    """(pos, n_texts, repeats) per row: its different texts, and how often other rows of its batch hold one of them."""
    keyed = rows.select("pos", text_keys(triplets.texts_array(rows)).alias("keys"))
    held = keyed.withColumnRenamed("pos", "row_id").join(batches.where("batch_id IS NOT NULL"), "row_id")
    held = held.select("row_id", "batch_id", F.explode("keys").alias("key"))
    others = held.groupBy("batch_id", "key").agg((F.count(F.lit(1)) - 1).alias("others"))
    repeats = held.join(others, ["batch_id", "key"]).groupBy(F.col("row_id").alias("pos")).agg(F.sum("others").alias("repeats"))
    counted = keyed.join(repeats, "pos", "left")
    return counted.select("pos", F.size("keys").cast("long").alias("n_texts"), F.coalesce("repeats", F.lit(0)).cast("long").alias("repeats"))


@query("no_duplicate_batches")
def q_no_duplicate_batches(spark, d):
    rows, batches = _batches(spark, d)
    return _batch_rules(rows, durable(batches))


@query("no_duplicate_batches_rules")
def q_no_duplicate_batches_rules(spark, d):
    rows, batches = _batches(spark, d)
    return _batch_rules(rows, durable(batches)).drop("placeable")


@query("no_duplicate_batches_rows")
def q_no_duplicate_batches_rows(spark, d):
    rows, batches = _batches(spark, d)
    return _row_rules(rows, durable(batches))


@query("encode_texts")
def q_encode_texts(spark, d):
    docs = t.table(spark, d, "documents").select("doc_id", "text")
    coded = encode_texts(docs, "text", hashing_encoder(ENCODER_DIM), normalize=False)
    cells = coded.select("doc_id", F.posexplode("vector").alias("i", "x"))
    return cells.where("x <> 0").select("doc_id", "i", "x")



@query("evaluate_dense")
def q_evaluate_dense(spark, d):
    return _rounded(evaluate.evaluate_dense(_bench(spark, d), _settings()))


@query("evaluate_bm25")
def q_evaluate_bm25(spark, d):
    return _rounded(_bm25_results(spark, d).drop("place"))


@query("evaluate_all")
def q_evaluate_all(spark, d):
    return _rounded(
        evaluate.evaluate_all([t.BENCH, t.CHAT], lambda s: t.load(spark, d, s), _settings()).drop("place")
    )


def _prepared(spark, d):
    rows = durable(trim_triplets(t.text_triplets(spark, d)))
    return prepare.prepare_training(rows, prepare.PrepareSettings(SPLIT_SIZE, None, TEXT_BATCH, SEED))


@query("prepare_validation")
def q_prepare_validation(spark, d):
    return _prepared(spark, d).validation


@query("prepare_training")
def q_prepare_training(spark, d):
    """Counts of both parts, queries they share, and broken rules of the batches."""
    ready = _prepared(spark, d)
    train = ready.rows.where("split = 'train'")
    held_out = ready.rows.where("split = 'validation'")
    shared = train.select("query").distinct().join(held_out.select("query").distinct(), "query")
    unplaced = ready.batches.where("batch_id IS NULL").agg(F.count(F.lit(1))).scalar()
    written = ready.train.agg(F.count(F.lit(1))).scalar()
    return _batch_rules(train, ready.batches).select(
        "*",
        (written + unplaced).alias("train_and_unplaced"),
        ready.validation.agg(F.count(F.lit(1))).scalar().alias("n_validation"),
        shared.agg(F.count(F.lit(1))).scalar().alias("shared_queries"),
    )


@query("validation_loss")
def q_validation_loss(spark, d):
    """Held-out texts to stop and best step of two runs, whose models are hashing encoders of changing size."""
    held_out = validation.numbered(_prepared(spark, d).validation)
    path = _fresh(spark, "validation")
    settings = validation.LossSettings(batch_size=LOSS_BATCH)
    for run, columns in (("triplets", held_out.columns), ("pairs", [c for c in held_out.columns if c != "sentence_2"])):
        points = [validation.Checkpoint(i / 2, 100 * i, hashing_encoder(dim)) for i, dim in enumerate(CHECKPOINT_DIMS, 1)]
        rows = held_out.select(*columns)
        first = validation.log_checkpoint(rows, run, validation.Checkpoint(0.5, 100, hashing_encoder(1)), path, settings)
        validation.log_checkpoint(rows, run, points[0], path, settings, number=first)  # the first try is replaced
        validation.log_run(rows, run, points, path, settings)
    return _rounded(validation.judge_runs(spark, path, 2))


@query("prepare_training_rows")
def q_prepare_training_rows(spark, d):
    """Every row of both parts with its sentences; training rows that fit into no batch are added to the written ones."""
    ready = _prepared(spark, d)
    train = ready.rows.where("split = 'train'")
    left = train.join(ready.batches.where("batch_id IS NULL").select(F.col("row_id").alias("pos")), "pos")
    names = ["query", "positive", "negative"]
    left = left.select("pos", *[F.col(c).alias(f"sentence_{i}") for i, c in enumerate(names)])
    columns = ["pos", *[f"sentence_{i}" for i in range(3)]]
    both = ready.train.select(*columns).unionByName(left).join(_row_rules(train, ready.batches), "pos")
    none = F.lit(0).cast("long")
    held_out = ready.validation.select(*columns, none.alias("n_texts"), none.alias("repeats"), F.lit("validation").alias("part"))
    return both.withColumn("part", F.lit("train")).unionByName(held_out)


# --- loading rules over a natural limit ---------------------------------------------------------------------------


@query("load_beir_limited")
def q_load_beir_limited(spark, d):
    """Three-table loading with both limits in force."""
    return _parts(_bench(spark, d, limit=30, extra=80))


@query("load_squad_limited")
def q_load_squad_limited(spark, d):
    """Question-answer loading with a query limit."""
    return _parts(t.load(spark, d, t.QA, limit=400))
