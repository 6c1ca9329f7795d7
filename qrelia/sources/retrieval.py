"""Loading corpus, queries and relevance judgements for evaluation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qrelia.functions.text import (
    cast_id,
    cast_score,
    corpus_text,
    falsy_to_empty,
    normalize_text,
)
from qrelia.operators.joins import broadcast_if_small, lookup_join
from qrelia.operators.positions import (
    at_most,
    head_by_position,
    nth_position,
    with_row_position,
)
from qrelia.session import durable, files_fingerprint
from qrelia.sources.splits import DEFAULT_SPLITS, read_split, split_files
from qrelia.sources.tables import (
    ID_ALIASES,
    POS,
    QREL_DOC_ALIASES,
    QREL_QUERY_ALIASES,
    SCORE_ALIASES,
    TEXT_ALIASES,
    read_table,
    resolve_col,
)


@dataclass
class RetrievalData:
    """corpus(doc_id, text, pos), queries(query_id, text, pos), qrels(query_id, doc_id, score).

    ``fingerprint`` is equal for equal corpora loaded from unchanged files.
    """

    corpus: DataFrame
    queries: DataFrame
    qrels: DataFrame
    fingerprint: str | None = None


@dataclass
class RetrievalSpec:
    """Where one evaluation dataset lives and what its columns are called.

    ``beir`` reads three tables below ``dataset`` (one folder each); ``squad``
    reads one table. ``split`` is a named split (see ``splits``); without one, the format's default split is read
    where the dataset has it, and the table's own folder otherwise. ``unique_doc_ids`` says that
    no document id repeats, which saves looking for repeated ones.

    Fixed values: the option names and defaults below are those that existing specifications use.
    """

    dataset: str
    name: str | None = None
    format: str = "beir"
    split: str | None = None
    file_format: str = "parquet"
    order_by: Sequence[str] | None = None
    corpus_config: str = "corpus"
    queries_config: str = "queries"
    labels_config: str = "qrels"
    corpus_id_col: str = "id"
    corpus_title_col: str = "title"
    corpus_text_col: str = "text"
    query_id_col: str = "query_id"
    query_text_col: str = "question"
    qrel_query_id_col: str = "query_id"
    qrel_corpus_id_col: str = "corpus_id"
    qrel_score_col: str = "score"
    context_col: str = "context"
    question_col: str = "question"
    id_col: str = "id"
    title_col: str = "title"
    eval_batch_size: int | None = None
    unique_doc_ids: bool = False

    @property
    def label(self) -> str:
        return self.name or self.dataset


# --- row rules ---------------------------------------------------------------


def dedup_last_wins(df: DataFrame, keys: Sequence[str], value: str, pos: str = POS) -> DataFrame:
    """One row per key: the value of its last row at the position of its first."""
    return df.groupBy(*keys).agg(
        F.max_by(value, pos).alias(value), F.min(pos).alias(pos)
    )


def dedup_first_wins(df: DataFrame, keys: Sequence[str], value: str, pos: str = POS) -> DataFrame:
    """One row per key: value and position of its first row."""
    return df.groupBy(*keys).agg(
        F.min_by(value, pos).alias(value), F.min(pos).alias(pos)
    )


def dedup_corpus_last_wins(corpus: DataFrame) -> DataFrame:
    """``dedup_last_wins`` for documents without shuffling their texts.

    Only ids and positions are grouped; the few ids that do repeat are then
    looked up from the text rows.
    """
    repeated = (
        corpus.groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("_n"), F.min(POS).alias("_first"), F.max(POS).alias("_last"))
        .where("_n > 1")
        .select("doc_id", "_first", "_last")
    )
    if repeated.isEmpty():
        return corpus
    looked_up = lookup_join(corpus, durable(repeated), "doc_id", "left")
    return looked_up.where(F.col("_last").isNull() | (F.col(POS) == F.col("_last"))).select(
        "doc_id", "text", F.coalesce("_first", POS).alias(POS)
    )


def limit_queries(queries: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` query rows, counting rows with a repeated id."""
    return head_by_position(queries, POS, n)


def qrels_for_queries(qrels: DataFrame, queries: DataFrame) -> DataFrame:
    return lookup_join(qrels, queries.select("query_id").distinct(), "query_id", "semi")


def positive_qrels(qrels: DataFrame) -> DataFrame:
    return qrels.where(F.col("score") > 0)


def subset_corpus(corpus: DataFrame, required: DataFrame, extra_docs: int | None) -> DataFrame:
    """Required documents plus the first ``extra_docs`` other rows; None keeps all."""
    if extra_docs is None:
        return corpus
    required = required.select("doc_id").distinct()
    if extra_docs <= 0:
        return lookup_join(corpus, required, "doc_id", "semi")
    marked = lookup_join(corpus, required.withColumn("_req", F.lit(True)), "doc_id", "left")
    others = marked.where(F.col("_req").isNull())
    bound = nth_position(others, POS, extra_docs)
    if bound is None:
        return corpus
    keep = F.col("_req").isNotNull() | at_most(F.col(POS), bound)
    return marked.where(keep).drop("_req")


def qrels_in_corpus(qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """Judgements whose document is in the corpus.

    Judged ids are looked for among the corpus ids, not the other way round: the
    corpus is then neither shuffled nor read beyond its ids.
    """
    judged = durable(qrels.select("doc_id").distinct())
    # Distinct before the lookup: an id that very many rows share is then one row, not one task's load.
    ids = corpus.select("doc_id").distinct()
    present = durable(lookup_join(ids, judged, "doc_id", "semi"))
    return lookup_join(qrels, present, "doc_id", "semi").select(*qrels.columns)


def queries_with_qrels(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries that still have a judgement of any score."""
    return lookup_join(queries, durable(qrels.select("query_id").distinct()), "query_id", "semi")


# --- three-table layout ------------------------------------------------------


def load_beir(
    corpus: DataFrame,
    queries: DataFrame,
    qrels: DataFrame,
    spec: RetrievalSpec | None = None,
    limit: int | None = None,
    extra_corpus_docs: int | None = None,
) -> RetrievalData:
    """Apply the loading rules to three tables that carry ``pos``."""
    spec = spec or RetrievalSpec(dataset="")
    query_id = resolve_col(queries.columns, spec.query_id_col, ID_ALIASES, "query id")
    query_text = resolve_col(queries.columns, spec.query_text_col, TEXT_ALIASES, "query text")
    qrel_query = resolve_col(qrels.columns, spec.qrel_query_id_col, QREL_QUERY_ALIASES, "qrel query id")
    qrel_doc = resolve_col(qrels.columns, spec.qrel_corpus_id_col, QREL_DOC_ALIASES, "qrel corpus id")
    qrel_score = resolve_col(qrels.columns, spec.qrel_score_col, SCORE_ALIASES, "qrel score")
    doc_id = resolve_col(corpus.columns, spec.corpus_id_col, ID_ALIASES, "corpus id")
    if spec.corpus_title_col not in corpus.columns and spec.corpus_text_col not in corpus.columns:
        raise KeyError(f"corpus has neither {spec.corpus_title_col!r} nor {spec.corpus_text_col!r}")

    title = normalize_text(falsy_to_empty(corpus, spec.corpus_title_col))
    body = normalize_text(falsy_to_empty(corpus, spec.corpus_text_col))
    docs = corpus.select(
        cast_id(corpus[doc_id]).alias("doc_id"), corpus_text(title, body).alias("text"), POS
    ).where("doc_id IS NOT NULL")

    selected = limit_queries(
        queries.select(
            cast_id(queries[query_id]).alias("query_id"),
            normalize_text(queries[query_text]).alias("text"),
            POS,
        ).where("query_id IS NOT NULL"),
        limit,
    )
    judged = qrels.select(
        cast_id(qrels[f"`{qrel_query}`"]).alias("query_id"),
        cast_id(qrels[f"`{qrel_doc}`"]).alias("doc_id"),
        cast_score(qrels[f"`{qrel_score}`"]).alias("score"),
        POS,
    ).where("query_id IS NOT NULL AND doc_id IS NOT NULL")
    judged = qrels_for_queries(judged, selected)

    # A document stays required even if a later judgement row lowers its score.
    docs = subset_corpus(docs, positive_qrels(judged), extra_corpus_docs)
    if not spec.unique_doc_ids:
        docs = dedup_corpus_last_wins(docs)
    # Queries and judgements are read several times from here on; the corpus is not
    # written, because streaming it again is cheaper than storing it.
    judged = durable(dedup_last_wins(judged, ["query_id", "doc_id"], "score").drop(POS))
    judged = qrels_in_corpus(judged, docs)
    kept = durable(queries_with_qrels(dedup_last_wins(selected, ["query_id"], "text"), judged))
    return RetrievalData(docs, kept, judged)


# --- question-answer layout --------------------------------------------------


def context_surrogate_id(rows: DataFrame) -> DataFrame:
    """``(context_key, pos, doc_id)`` per distinct context of ``rows(context_key, pos)``.

    ``pos`` is where the context occurs first and ``doc_id`` is ``corpus_{n}``,
    n counting contexts in that order.
    """
    firsts = rows.groupBy("context_key").agg(F.min(POS).alias(POS))
    numbered = with_row_position(firsts, [POS], "_n")
    return numbered.select("context_key", POS, F.concat(F.lit("corpus_"), "_n").alias("doc_id"))


def join_context_ids(rows: DataFrame, contexts: DataFrame) -> DataFrame:
    """Attach ``doc_id`` to rows by context digest; a much repeated context is not a hot task."""
    return lookup_join(rows, contexts.select("context_key", "doc_id"), "context_key", "inner")


def load_squad(
    table: DataFrame, spec: RetrievalSpec | None = None, limit: int | None = None
) -> RetrievalData:
    """One (id, context, question[, title]) table with ``pos``.

    With a limit, rows are taken until that many distinct ids have been seen;
    the context of the row that trips the limit still enters the corpus.
    """
    spec = spec or RetrievalSpec(dataset="")
    context = normalize_text(table[spec.context_col])
    # Rows meet their context by a digest; of the table, only these narrow rows
    # are kept and joined, while the contexts themselves are read once more.
    rows = durable(
        table.select(
            cast_id(table[spec.id_col]).alias("query_id"),
            normalize_text(table[spec.question_col]).alias("question"),
            F.sha2(context, 256).alias("context_key"),
            POS,
        ).where("query_id IS NOT NULL AND context_key IS NOT NULL")
    )
    asked, seen = _first_questions(rows, limit)

    contexts = context_surrogate_id(seen.select("context_key", POS))
    title = normalize_text(falsy_to_empty(table, spec.title_col))
    texts = table.select(corpus_text(title, context).alias("text"), POS)
    corpus = texts.join(broadcast_if_small(contexts.select("doc_id", POS)), POS)
    queries = dedup_first_wins(asked, ["query_id"], "question").withColumnRenamed("question", "text")
    qrels = (
        join_context_ids(asked.select("query_id", "context_key", POS), contexts)
        .select("query_id", "doc_id")
        .distinct()
        .withColumn("score", F.lit(1))
    )
    return RetrievalData(corpus.select("doc_id", "text", POS), queries, qrels)


def _first_questions(rows: DataFrame, limit: int | None) -> tuple[DataFrame, DataFrame]:
    """Rows that give queries under a limit, and rows whose contexts are seen."""
    if limit is None:
        return rows, rows
    asked, after = rows.limit(0), rows
    if limit > 0:
        first_seen = rows.groupBy("query_id").agg(F.min(POS).alias(POS))
        bound = nth_position(first_seen, POS, limit)
        if bound is None:
            return rows, rows
        asked = rows.where(at_most(F.col(POS), bound))
        after = rows.where(~at_most(F.col(POS), bound))
    trip = nth_position(after, POS, 1)
    seen = rows if trip is None else rows.where(at_most(F.col(POS), trip))
    return asked, seen


# --- dispatch ----------------------------------------------------------------


def load_spec(
    spark: SparkSession,
    spec: RetrievalSpec,
    limit: int | None = None,
    extra_corpus_docs: int | None = None,
    read: Callable[[str], DataFrame] | None = None,
) -> RetrievalData:
    """Load the dataset a spec describes; ``read`` maps a table name to a DataFrame with ``pos``.

    The default reader takes named splits of ``{dataset}/{table}``; the question-answer
    layout ignores ``extra_corpus_docs``.
    """

    def from_files(table: str) -> DataFrame:
        default = DEFAULT_SPLITS.get(spec.format, "")
        if spec.split or split_files(spec.dataset, table, default, spec.file_format):
            return read_split(spark, spec.dataset, table, spec.split, spec.file_format, spec.format, spec.order_by)
        return read_table(spark, "/".join(p for p in (spec.dataset, table) if p), spec.file_format, spec.order_by)

    read = read or from_files
    if spec.format == "squad":
        table = read("")
        found = load_squad(table, spec, limit)
        found.fingerprint = files_fingerprint([table], repr((spec, limit)))
        return found
    if spec.format != "beir":
        raise ValueError(f"unknown dataset format: {spec.format!r}")
    tables = [read(spec.corpus_config), read(spec.queries_config), read(spec.labels_config)]
    found = load_beir(*tables, spec, limit, extra_corpus_docs)
    # A whole corpus does not depend on queries and judgements.
    whole = extra_corpus_docs is None
    found.fingerprint = files_fingerprint(tables[:1] if whole else tables, repr((spec, None if whole else (limit, extra_corpus_docs))))
    return found
