"""The same queries as SQL over the given tables."""

from __future__ import annotations

from checks.queries import (
    CHECKPOINT_DIMS,
    CUTOFFS,
    DIMS,
    ENCODER_DIM,
    ENCODER_DIMS,
    LOSS_BATCH,
    PATIENCE,
    SCORE_ROUND,
    SEED,
    SPLIT_SIZE,
    TEXT_BATCH,
)

TOP = 100


def nt(x: str) -> str:
    """Whitespace runs as one space, trimmed."""
    return f"trim(regexp_replace({x}, '[\\s\\x0b]+', ' ', 'g'))"


def toks(x: str) -> str:
    return f"list_filter(string_split({nt(x)}, ' '), lambda w: w <> '')"


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts if p.strip()) + "\n"


# --- inputs --------------------------------------------------------------------------

BENCH_RAW = """
raw_corpus AS (SELECT doc_id::VARCHAR AS doc_id, source AS title, text, doc_id AS pos FROM documents),
raw_queries AS (SELECT item_id::VARCHAR AS query_id, text, item_id AS pos FROM benchmark),
raw_qrels AS (
  SELECT item_id::VARCHAR AS query_id, doc_id::VARCHAR AS doc_id,
         max(CASE WHEN contains(d.text, b.text) THEN 1 ELSE 0 END)::INTEGER AS score
  FROM benchmark b JOIN documents d ON contains(d.text, b.text) OR d.doc_id = b.item_id
  GROUP BY ALL)
"""

CHAT_RAW = """
raw_corpus AS (SELECT conv_id || '-' || turn AS doc_id, '' AS title, text, (conv_id, turn) AS pos
               FROM conversations WHERE role = 'assistant'),
raw_queries AS (SELECT conv_id || '-' || turn AS query_id, text, (conv_id, turn) AS pos
                FROM conversations WHERE role = 'user'),
raw_qrels AS (
  SELECT u.conv_id || '-' || u.turn AS query_id, a.conv_id || '-' || a.turn AS doc_id, 1::INTEGER AS score
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant')
"""


def loaded(raw: str, limit: int | None = None, extra: int | None = None) -> str:
    """The loading rules over raw tables whose ids are unique."""
    chosen = "SELECT * FROM raw_queries" + (f" ORDER BY pos LIMIT {limit}" if limit is not None else "")
    if extra is None:
        docs = "SELECT * FROM raw_corpus"
    else:
        docs = f"""SELECT * FROM raw_corpus WHERE doc_id IN (SELECT doc_id FROM judged WHERE score > 0)
          UNION ALL
          (SELECT * FROM raw_corpus WHERE doc_id NOT IN (SELECT doc_id FROM judged WHERE score > 0)
           ORDER BY pos LIMIT {extra})"""
    return f"""{raw.strip()},
chosen AS ({chosen}),
judged AS (SELECT * FROM raw_qrels WHERE query_id IN (SELECT query_id FROM chosen)),
docs AS ({docs}),
corpus AS (SELECT doc_id, CASE WHEN title <> '' THEN {nt('title')} || chr(10) ELSE '' END || {nt('text')} AS text FROM docs),
qrels AS (SELECT * FROM judged WHERE doc_id IN (SELECT doc_id FROM corpus)),
queries AS (SELECT query_id, {nt('text')} AS text FROM chosen WHERE query_id IN (SELECT query_id FROM qrels))
"""


def qa_loaded(limit: int | None = None) -> str:
    # Ids are unique and rows are numbered by doc_id, so a limit is a row count;
    # one more row reaches the corpus.
    asked = "" if limit is None else f" WHERE pos < {limit}"
    seen = "" if limit is None else f" WHERE pos <= {limit}"
    return f"""
rows AS (SELECT doc_id AS pos, doc_id::VARCHAR AS query_id, {nt('text')} AS context,
                lang || ' ' || source AS question, source AS title FROM documents),
firsts AS (SELECT context, min(pos) AS pos, arg_min(title, pos) AS title FROM rows{seen} GROUP BY 1),
contexts AS (SELECT *, 'corpus_' || (row_number() OVER (ORDER BY pos) - 1) AS doc_id FROM firsts),
corpus AS (SELECT doc_id, title || chr(10) || context AS text, pos FROM contexts),
queries AS (SELECT query_id, question AS text FROM rows{asked}),
qrels AS (SELECT DISTINCT query_id, doc_id, 1::INTEGER AS score
          FROM (SELECT * FROM rows{asked}) r JOIN contexts USING (context))
"""


PARTS = """
SELECT 'corpus' AS part, NULL::VARCHAR AS query_id, doc_id, NULL::INTEGER AS score, text FROM corpus
UNION ALL SELECT 'queries', query_id, NULL, NULL, text FROM queries
UNION ALL SELECT 'qrels', query_id, doc_id, score, NULL FROM qrels
"""

LABELS = """
vecs AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
cells AS (SELECT vec_id, label, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM vecs),
dims_pooled AS (SELECT label, i, avg(x) AS mean, max(x) AS max, arg_min(x, vec_id) AS cls FROM cells GROUP BY ALL),
modes AS (SELECT label, i, unnest(['mean', 'max', 'cls']) AS mode, unnest([mean, max, cls]) AS x FROM dims_pooled),
qvec AS (SELECT mode || ':' || label AS query_id, list(x ORDER BY i) AS vector FROM modes GROUP BY mode, label),
queries AS (SELECT query_id FROM qvec),
dvec AS (SELECT vec_id::VARCHAR AS doc_id, v AS vector FROM vecs),
qrels AS (SELECT m || ':' || label AS query_id, vec_id::VARCHAR AS doc_id, 1 AS score
          FROM vecs, (SELECT unnest(['mean', 'max', 'cls']) AS m))
"""

TEXT_TRIPLETS = """
text_triplets AS (
  SELECT d.doc_id AS pos, d.source || '/' || d.lang AS query, d.text AS positive, n.text AS negative
  FROM documents d JOIN documents n ON n.doc_id = d.doc_id + 1)
"""

CHAT_TRIPLETS = """
chat_triplets AS (
  SELECT u.conv_id * 1000 + u.turn AS pos, u.text AS query, a.text AS positive, u.text AS negative
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant')
"""

VECTOR_TRIPLETS = """
vector_triplets AS (
  SELECT a.vec_id AS pos, a.embedding::DOUBLE[] AS a, p.embedding::DOUBLE[] AS p, n.embedding::DOUBLE[] AS n
  FROM embeddings a JOIN embeddings p ON p.vec_id = a.vec_id + 1 JOIN embeddings n ON n.vec_id = a.vec_id + 2)
"""


# --- rankings -------------------------------------------------------------------------

BM25 = f"""
tok AS (SELECT doc_id, unnest({toks('lower(text)')}) AS term FROM corpus),
tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT c.doc_id, coalesce(sum(tf), 0)::DOUBLE AS dl FROM corpus c LEFT JOIN tf USING (doc_id) GROUP BY 1),
st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
raw_idf AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, st),
mean_idf AS MATERIALIZED (SELECT avg(raw) AS mean FROM raw_idf),
idf AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM raw_idf, mean_idf),
qt AS (SELECT query_id, term, count(*) AS query_tf
       FROM (SELECT query_id, unnest({toks('lower(text)')}) AS term FROM queries) GROUP BY ALL)
"""

BM25_RUN = f"""{BM25.strip()},
matched AS (
  SELECT query_id, doc_id,
         sum(query_tf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN dl USING (doc_id), st GROUP BY ALL),
ranked AS (
  SELECT -1 AS truncate_dim, query_id, doc_id, coalesce(score, 0) AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(score, 0), 9) DESC, doc_id) AS rank
  FROM queries CROSS JOIN corpus LEFT JOIN matched USING (query_id, doc_id)),
run AS (SELECT * FROM ranked WHERE rank <= {TOP}),
dims AS (SELECT -1 AS truncate_dim)
"""


def dense_run(dims, prefix="", run="run", dims_name="dims") -> str:
    """Run over qvec(query_id, vector) and dvec(doc_id, vector)."""
    values = ", ".join(f"({d})" for d in dims)

    def cut(kind, source):
        return f"""{prefix}{kind} AS (
  SELECT truncate_dim, {source}.* EXCLUDE (vector), h, sqrt(list_sum(list_transform(h, lambda x: x * x))) AS norm
  FROM (SELECT *, vector[1:truncate_dim] AS h FROM {source}, {dims_name}) {source})"""

    return f"""{dims_name} AS (SELECT * FROM (VALUES {values}) t(truncate_dim)),
{cut('qc', 'qvec').replace('truncate_dim, qvec.* EXCLUDE (vector), h', 'truncate_dim, query_id, h')},
{cut('dc', 'dvec').replace('truncate_dim, dvec.* EXCLUDE (vector), h', 'truncate_dim, doc_id, h')},
{prefix}scored AS (
  SELECT q.truncate_dim, query_id, doc_id,
         CASE WHEN q.norm = 0 OR d.norm = 0 THEN 0 ELSE list_inner_product(q.h, d.h) / (q.norm * d.norm) END AS score
  FROM {prefix}qc q JOIN {prefix}dc d ON q.truncate_dim = d.truncate_dim),
{prefix}ranked AS (
  SELECT *, row_number() OVER (PARTITION BY truncate_dim, query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {prefix}scored),
{run} AS (SELECT * FROM {prefix}ranked WHERE rank <= {TOP})
"""


def encoded(prefix="") -> str:
    """qvec and dvec of texts: signed counts of words by digest."""

    def vectors(table, key):
        words = f"SELECT {key}, unnest({toks('lower(text)')}) AS w FROM {table}"
        return f"""
cell_{table} AS (
  SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT % {ENCODER_DIM} AS i,
         sum(1 - 2 * (('0x' || substr(md5(w), 9, 1))::INTEGER % 2))::DOUBLE AS x
  FROM ({words}) GROUP BY ALL),
grid_{table} AS (SELECT {key}, unnest(range({ENCODER_DIM})) AS i FROM {table})"""

    def assembled(table, key, name):
        return f"""{name} AS (SELECT {key}, list(coalesce(x, 0) ORDER BY i) AS vector
  FROM grid_{table} LEFT JOIN cell_{table} USING ({key}, i) GROUP BY {key})"""

    return f"""{vectors('corpus', 'doc_id').strip()},
{vectors('queries', 'query_id').strip()},
{assembled('corpus', 'doc_id', 'dvec')},
{assembled('queries', 'query_id', 'qvec')}
"""


# --- metrics ----------------------------------------------------------------------------


def metric_exprs(with_precision: bool = True) -> dict[str, str]:
    """Metric name to expression over joined rows (rank, h = running hits) of one query."""
    out = {}
    for k in CUTOFFS.top_k:
        out[f"accuracy_{k}"] = f"coalesce(max(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 0)"
    if with_precision:
        for k in CUTOFFS.top_k:
            out[f"precision_{k}"] = f"count(rank) FILTER (rank <= {k}) / {k}.0"
    for k in CUTOFFS.top_k:
        if k != 1:
            ideal = f"list_sum(list_transform(range(1, least(n_rel, {k}) + 1), lambda r: 1 / log2(r + 1)))"
            out[f"ndcg_{k}"] = f"coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= {k}), 0) / coalesce({ideal}, 1)"
    for k in CUTOFFS.top_k:
        if k != 1:
            out[f"mrr_{k}"] = f"coalesce(1.0 / min(rank) FILTER (rank <= {k}), 0)"
    for k in CUTOFFS.recalls:
        out[f"recall_{k}"] = f"count(rank) FILTER (rank <= {k}) / greatest(coalesce(n_rel, 0), 1)::DOUBLE"
    k = CUTOFFS.map_at_k
    out[f"map_{k}"] = f"coalesce(sum(h / rank::DOUBLE) FILTER (rank <= {k}), 0) / greatest(least(coalesce(n_rel, 0), {k}), 1)"
    return out


def per_query(with_precision=True, run="run", dims="dims", name="pq") -> str:
    exprs = ",\n    ".join(f"({e})::DOUBLE AS {n}" for n, e in metric_exprs(with_precision).items())
    return f"""{name}_hits AS (
  SELECT truncate_dim, query_id, rank,
         row_number() OVER (PARTITION BY truncate_dim, query_id ORDER BY rank) AS h
  FROM {run} JOIN qrels USING (query_id, doc_id) WHERE qrels.score > 0),
{name}_nrel AS (SELECT query_id, count(*) AS n_rel FROM qrels WHERE score > 0 GROUP BY 1),
{name} AS (
  SELECT truncate_dim, query_id,
    {exprs}
  FROM queries CROSS JOIN {dims} LEFT JOIN {name}_hits USING (truncate_dim, query_id)
       LEFT JOIN {name}_nrel USING (query_id)
  GROUP BY truncate_dim, query_id, n_rel)
"""


def averages(with_precision=True, all_columns=None) -> str:
    names = metric_exprs(with_precision)
    cols = []
    for n in all_columns or names:
        cols.append(f"round(avg({n}), 6) AS {n}" if n in names else f"NULL::DOUBLE AS {n}")
    return ", ".join(cols)


def bm25_row(raw: str, dataset: str | None = None, all_columns=None) -> str:
    tag = f", '{dataset}' AS dataset, NULL::VARCHAR AS split" if dataset else ""
    return (
        ctes(loaded(raw), BM25_RUN, per_query(False))
        + f"SELECT truncate_dim, 'bm25' AS system, 0 AS seq{tag}, {averages(False, all_columns)} FROM pq GROUP BY truncate_dim"
    )


def dense_rows(raw: str, dataset: str | None = None) -> str:
    tag = f", '{dataset}' AS dataset, NULL::VARCHAR AS split" if dataset else ""
    order = "CASE truncate_dim " + " ".join(f"WHEN {d} THEN {i + 1}" for i, d in enumerate(ENCODER_DIMS)) + " END"
    return (
        ctes(loaded(raw), encoded(), dense_run(ENCODER_DIMS), per_query(True))
        + f"SELECT truncate_dim, 'cosine' AS system, {order} AS seq{tag}, {averages(True)} FROM pq GROUP BY truncate_dim"
    )


def both_systems(raw: str, dataset: str | None = None) -> str:
    every = list(metric_exprs(True))
    return f"SELECT * FROM ({bm25_row(raw, dataset, every)}) UNION ALL BY NAME SELECT * FROM ({dense_rows(raw, dataset)})"


BENCH_NAME, CHAT_NAME = "team/bench", "chat"


def bm25_both() -> str:
    return (
        f"SELECT * FROM ({bm25_row(BENCH_RAW, BENCH_NAME)}) "
        f"UNION ALL BY NAME SELECT * FROM ({bm25_row(CHAT_RAW, CHAT_NAME)})"
    )


# --- report text -----------------------------------------------------------------------------

_HEADS = {"accuracy": "Accuracy", "ndcg": "NDCG", "mrr": "MRR", "recall": "Recall", "map": "MAP"}


def markdown() -> str:
    """(dataset, line_no, line) of the BM25 tables of both datasets."""
    names = list(metric_exprs(False))
    heads = ["method"] + [f"{_HEADS[n.split('_')[0]]}@{n.split('_')[1]}" for n in names]
    cells = " || ' | ' || ".join(f"printf('%.6f', {n})" for n in names)
    raw = bm25_both().replace("round(avg(", "(avg(").replace("), 6)", "))")
    return f"""
results AS ({raw}),
md AS (
  SELECT dataset, 0 AS line_no, '| {' | '.join(heads)} |' AS line FROM results
  UNION ALL SELECT dataset, 1, '|{'|'.join('---' for _ in heads)}|' FROM results
  UNION ALL SELECT dataset, 2, '| BM25 | ' || {cells} || ' |' FROM results)
"""


# --- split and logs ------------------------------------------------------------------------------

SPLIT = f"""{TEXT_TRIPLETS.strip()},
draws AS (SELECT query, row_number() OVER (ORDER BY md5('{SEED}|' || query)) AS r
          FROM (SELECT DISTINCT query FROM text_triplets)),
split_rows AS (
  SELECT t.*, CASE WHEN r <= greatest(1, floor((SELECT count(*) FROM draws) * {SPLIT_SIZE}::DOUBLE))
                   THEN 'validation' ELSE 'train' END AS split
  FROM text_triplets t JOIN draws USING (query))
"""

LOG = f"""
lg AS (SELECT user_id AS run_id, event_id, value,
              row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events),
imp AS (SELECT *, coalesce(value < min(value) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM lg),
waits AS (SELECT *, step - max(CASE WHEN improved THEN step END) OVER (PARTITION BY run_id ORDER BY step) AS wait FROM imp),
stops AS (SELECT run_id, min(step) FILTER (wait >= {PATIENCE}) AS stop, arg_min(event_id, step) FILTER (wait >= {PATIENCE}) AS stop_event FROM waits GROUP BY 1)
"""


def loss_sql() -> str:
    def unit(c):
        return f"list_transform({c}[1:d], lambda x: x / sqrt(list_sum(list_transform({c}[1:d], lambda y: y * y))))"

    dims = ", ".join(f"({d})" for d in DIMS)
    return ctes(
        VECTOR_TRIPLETS,
        f"numbered AS (SELECT *, (row_number() OVER (ORDER BY pos) - 1) // {LOSS_BATCH} AS b FROM vector_triplets)",
        f"""u AS (SELECT d, b, pos, {unit('a')} AS a, {unit('p')} AS p, {unit('n')} AS n
            FROM numbered, (VALUES {dims}) t(d))""",
        "cand AS (SELECT d, b, pos, p AS c, true AS own FROM u UNION ALL SELECT d, b, pos, n, false FROM u)",
        """s AS (SELECT u.d, u.b, u.pos, 20 * list_inner_product(u.a, c.c) AS s, c.own AND c.pos = u.pos AS target
            FROM u JOIN cand c ON u.d = c.d AND u.b = c.b)""",
        "r AS (SELECT d, b, pos, ln(sum(exp(s))) - max(s) FILTER (target) AS l FROM s GROUP BY ALL)",
        "bl AS (SELECT b, sum(l) AS l FROM (SELECT d, b, avg(l) AS l FROM r GROUP BY ALL) GROUP BY b)",
    ) + "SELECT count(*) AS n_batches, round(avg(l), 6) AS loss FROM bl"


def validation_sql() -> str:
    points = ", ".join(f"({100 * i}, {d})" for i, d in enumerate(CHECKPOINT_DIMS, 1))
    texts = " UNION ALL ".join(
        f"SELECT r // {LOSS_BATCH} AS b, r, '{side}' AS side, {text} AS text FROM held"
        for side, text in (("a", "query"), ("p", nt("positive")), ("n", nt("negative")))
    )
    return ctes(
        SPLIT,
        "held AS (SELECT row_number() OVER (ORDER BY pos) - 1 AS r, * FROM split_rows WHERE split = 'validation')",
        f"texts AS ({texts})",
        f"points AS (SELECT * FROM (VALUES {points}) t(step, d))",
        f"""used AS (SELECT b, r, side, w, count(*) AS c FROM (SELECT b, r, side, unnest({toks('lower(text)')}) AS w FROM texts) GROUP BY ALL)""",
        """cells AS (SELECT step, b, r, side, ('0x' || substr(md5(w), 1, 8))::BIGINT % d AS i,
                   sum(c * (1 - 2 * (('0x' || substr(md5(w), 9, 1))::INTEGER % 2)))::DOUBLE AS x
                   FROM used, points GROUP BY ALL HAVING x <> 0)""",
        "unit AS (SELECT step, b, r, side, i, x / sqrt(sum(x * x) OVER (PARTITION BY step, b, r, side)) AS x FROM cells)",
        """dots AS (SELECT a.step, a.r, c.r AS other, c.side, sum(a.x * c.x) AS s FROM unit a JOIN unit c USING (step, b, i)
                  WHERE a.side = 'a' AND c.side <> 'a' GROUP BY ALL)""",
        """pairs AS (SELECT points.step, a.b, a.r, c.r AS other, c.side, 20 * coalesce(dots.s, 0) AS s
                   FROM texts a JOIN texts c ON a.b = c.b CROSS JOIN points LEFT JOIN dots
                     ON dots.step = points.step AND dots.r = a.r AND dots.other = c.r AND dots.side = c.side
                   WHERE a.side = 'a' AND c.side <> 'a')""",
        """runs AS (SELECT 'triplets' AS run_id, * FROM pairs UNION ALL SELECT 'pairs', * FROM pairs WHERE side = 'p')""",
        "rows_ AS (SELECT run_id, step, b, r, ln(sum(exp(s))) - max(s) FILTER (other = r AND side = 'p') AS l FROM runs GROUP BY ALL)",
        """lg AS (SELECT run_id, step, printf('%.6f', avg(l))::DOUBLE AS value
                FROM (SELECT run_id, step, b, avg(l) AS l FROM rows_ GROUP BY ALL) GROUP BY ALL)""",
        """imp AS (SELECT *, row_number() OVER run AS k, coalesce(value < min(value) OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved
                 FROM lg WINDOW run AS (PARTITION BY run_id ORDER BY step))""",
        "waits AS (SELECT *, k - max(CASE WHEN improved THEN k END) OVER (PARTITION BY run_id ORDER BY step) AS wait FROM imp)",
        "stops AS (SELECT run_id, min(step) FILTER (wait >= 2) AS stop FROM waits GROUP BY 1)",
    ) + """SELECT run_id, any_value(stop)::BIGINT AS stop_step, arg_min(step, (value, step))::BIGINT AS best_step, min(value) AS best_value
        FROM waits JOIN stops USING (run_id) WHERE stop IS NULL OR step <= stop GROUP BY 1"""


# --- all ----------------------------------------------------------------------------------------------


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}

    q["load_triplets"] = (
        ctes(TEXT_TRIPLETS, CHAT_TRIPLETS)
        + f"""SELECT 'text' AS source, query, {nt('positive')} AS positive, {nt('negative')} AS negative FROM text_triplets
        UNION ALL SELECT 'chat', {nt('query')}, {nt('positive')}, {nt('negative')} FROM chat_triplets"""
    )
    q["union_sources"] = (
        ctes(TEXT_TRIPLETS, CHAT_TRIPLETS)
        + f"""SELECT 0 AS part, pos AS at, 'text' AS source, query, {nt('positive')} AS positive, {nt('negative')} AS negative FROM text_triplets
        UNION ALL SELECT 1, pos, 'chat', {nt('query')}, {nt('positive')}, {nt('negative')} FROM chat_triplets"""
    )
    q["load_beir"] = ctes(loaded(BENCH_RAW)) + PARTS
    q["load_beir_limited"] = ctes(loaded(BENCH_RAW, 30, 80)) + PARTS
    q["load_spec"] = ctes(loaded(CHAT_RAW)) + PARTS
    q["load_squad"] = ctes(qa_loaded()) + PARTS
    q["load_squad_limited"] = ctes(qa_loaded(400)) + PARTS
    q["resolve_col"] = ctes(CHAT_RAW) + "SELECT query_id, doc_id, score FROM raw_qrels"

    q["read_split"] = "SELECT CASE conv_id % 2 WHEN 1 THEN 'test' ELSE 'train' END AS split, conv_id, turn, role, text FROM conversations"
    q["normalize_text"] = f"SELECT doc_id, {nt('text')} AS text FROM documents"
    q["corpus_text"] = "SELECT doc_id, CASE WHEN lang = 'en' THEN text ELSE source || chr(10) || text END AS text FROM documents"
    q["falsy_to_empty"] = "SELECT d.doc_id, CASE WHEN quality <> 0 THEN quality::VARCHAR ELSE '' END AS title, '' AS missing FROM documents d LEFT JOIN labels USING (doc_id)"
    q["cast_ids"] = "SELECT event_id::VARCHAR AS doc_id, user_id::VARCHAR AS query_id, trunc(value)::INTEGER AS score FROM events"
    q["bm25_tokenize"] = f"SELECT doc_id, len({toks('lower(text)')})::INTEGER AS n_tokens, array_to_string({toks('lower(text)')}, '|') AS tokens FROM documents"
    q["max_tokens"] = f"SELECT doc_id, array_to_string({toks('text')}[1:128], ' ') AS text FROM documents"
    q["triplet_projection"] = ctes(TEXT_TRIPLETS) + "SELECT pos, query, positive FROM text_triplets"
    q["texts_array"] = (
        ctes(TEXT_TRIPLETS)
        + "SELECT pos, unnest([0, 1, 2])::INTEGER AS i, unnest([query, positive, negative]) AS text FROM text_triplets"
    )
    q["evaluator_payload"] = (
        ctes(TEXT_TRIPLETS)
        + "SELECT pos, query AS anchor, positive, positive AS negative FROM text_triplets ORDER BY pos LIMIT 200"
    )
    q["sentence_columns"] = (
        ctes(TEXT_TRIPLETS)
        + """SELECT pos, query AS sentence_0, positive AS sentence_1, negative AS sentence_2,
        coalesce(quality, 0) AS label FROM text_triplets t LEFT JOIN labels l ON l.doc_id = t.pos"""
    )
    q["truncate_normalize"] = """
        WITH h AS (SELECT vec_id, embedding[1:16]::DOUBLE[] AS h FROM embeddings),
        n AS (SELECT vec_id, h, sqrt(list_sum(list_transform(h, lambda x: x * x))) AS norm FROM h)
        SELECT vec_id, unnest(range(len(h)))::INTEGER AS i, round(unnest(h) / norm, 6) AS x FROM n"""
    q["dot_score"] = ctes(VECTOR_TRIPLETS) + "SELECT pos, round(list_inner_product(a, p), 6) AS score FROM vector_triplets"
    q["context_surrogate_id"] = ctes(qa_loaded()) + "SELECT doc_id, pos AS first_row FROM corpus"

    q["limit_queries"] = ctes(BENCH_RAW) + "SELECT query_id, text FROM raw_queries ORDER BY pos LIMIT 25"
    q["qrels_for_queries"] = (
        ctes(BENCH_RAW)
        + "SELECT query_id, doc_id, score FROM raw_qrels WHERE query_id IN (SELECT query_id FROM raw_queries ORDER BY pos LIMIT 25)"
    )
    q["subset_corpus"] = ctes(loaded(BENCH_RAW, None, 60)) + "SELECT doc_id, text FROM docs"
    q["qrels_in_corpus"] = ctes(loaded(BENCH_RAW, None, 60)) + "SELECT query_id, doc_id, score FROM qrels"
    q["queries_with_qrels"] = (
        ctes(loaded(BENCH_RAW, None, 0))
        + "SELECT query_id, text FROM raw_queries WHERE query_id IN (SELECT query_id FROM qrels)"
    )
    q["positive_qrels"] = ctes(BENCH_RAW) + "SELECT query_id, doc_id FROM raw_qrels WHERE score > 0"
    q["validation_head"] = ctes(TEXT_TRIPLETS) + "SELECT pos, query, positive FROM text_triplets ORDER BY pos LIMIT 300"
    q["dedup_last_wins"] = "SELECT source, lang, arg_max(text, doc_id) AS text, min(doc_id) AS pos FROM documents GROUP BY ALL"
    q["dedup_first_wins"] = "SELECT source, lang, arg_min(text, doc_id) AS text, min(doc_id) AS pos FROM documents GROUP BY ALL"
    q["dedup_corpus_last_wins"] = "SELECT md5(text) AS doc_id, arg_max(source, doc_id) AS text, min(doc_id) AS pos FROM documents d GROUP BY md5(text)"

    q["join_context_ids"] = ctes(qa_loaded()) + "SELECT * FROM qrels"
    q["join_postings"] = (
        ctes(loaded(BENCH_RAW), BM25)
        + "SELECT query_id, term, query_tf, df, round(idf, 6) AS idf FROM qt JOIN idf USING (term)"
    )
    q["cross_score"] = ctes(LABELS, dense_run([64])) + (
        f"SELECT truncate_dim, query_id, doc_id, round(score, {SCORE_ROUND}) AS score, rank::INTEGER AS rank FROM run"
    )
    q["join_run_qrels"] = ctes(loaded(BENCH_RAW), BM25_RUN) + (
        """SELECT r.query_id, r.doc_id, rank::INTEGER AS rank, CASE WHEN j.score > 0 THEN 1 ELSE 0 END AS rel
        FROM run r LEFT JOIN qrels j USING (query_id, doc_id)"""
    )
    q["bm25_tf"] = ctes(loaded(CHAT_RAW), BM25) + "SELECT doc_id, term, tf FROM tf"
    q["bm25_corpus_stats"] = ctes(loaded(BENCH_RAW), BM25) + (
        """SELECT n::BIGINT AS n_docs, (SELECT sum(dl) FROM dl)::BIGINT AS n_tokens,
        (SELECT count(*) FROM dfs) AS n_terms, round(avgdl, 6) AS avgdl FROM st"""
    )
    q["bm25_idf"] = ctes(loaded(BENCH_RAW), BM25) + "SELECT term, df, round(idf, 6) AS idf FROM idf"
    q["bm25_score"] = ctes(loaded(BENCH_RAW), BM25_RUN) + (
        f"""SELECT query_id, doc_id, round(score, {SCORE_ROUND}) AS score,
        row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INTEGER AS rank FROM matched QUALIFY rank <= {TOP}"""
    )
    q["bm25_topk"] = ctes(loaded(CHAT_RAW), BM25_RUN) + (
        f"SELECT truncate_dim, query_id, doc_id, round(score, {SCORE_ROUND}) AS score, rank::INTEGER AS rank FROM run"
    )
    q["bm25_topk_stored"] = q["bm25_topk"]
    for kind in ("accuracy", "precision", "recall", "mrr", "ndcg", "map"):
        names = [n for n in metric_exprs() if n.rsplit("_", 1)[0] == kind]
        q[f"{kind}_at_k"] = ctes(LABELS, dense_run(DIMS), per_query()) + (
            f"SELECT truncate_dim, query_id, {', '.join(f'round({n}, 6) AS {n}' for n in names)} FROM pq"
        )
    q["macro_average"] = ctes(loaded(BENCH_RAW), BM25_RUN, per_query()) + (
        f"SELECT truncate_dim, {averages()} FROM pq GROUP BY truncate_dim"
    )
    seq = "CASE truncate_dim " + " ".join(f"WHEN {d} THEN {i + 1}" for i, d in enumerate(DIMS)) + " END AS seq"
    q["matryoshka_sweep"] = ctes(LABELS, dense_run(DIMS), per_query()) + (
        f"SELECT truncate_dim, {seq}, {averages()} FROM pq GROUP BY truncate_dim"
    )
    q["union_datasets"] = ctes(LABELS, dense_run(DIMS), per_query()) + (
        f"""SELECT split_part(query_id, ':', 1) AS dataset, 'all' AS split, 'cosine' AS system, truncate_dim, {seq},
        {averages()} FROM pq GROUP BY split_part(query_id, ':', 1), truncate_dim"""
    )
    q["split_counts"] = ctes(SPLIT) + (
        "SELECT split, count(*) AS n_rows FROM split_rows GROUP BY 1 UNION ALL SELECT 'loaded', count(*) FROM split_rows"
    )
    q["split_by_query"] = ctes(SPLIT) + "SELECT pos, query, split FROM split_rows"
    q["prepare_validation"] = ctes(SPLIT) + (
        f"""SELECT pos, query AS sentence_0, {nt('positive')} AS sentence_1, {nt('negative')} AS sentence_2
        FROM split_rows WHERE split = 'validation'"""
    )
    q["pool_vectors"] = ctes(LABELS) + "SELECT mode, label, (i - 1)::INTEGER AS i, round(x, 6) AS x FROM modes"
    q["in_batch_loss"] = loss_sql()
    q["rank_topk"] = """
        SELECT user_id AS query_id, event_id AS doc_id, value AS score,
               row_number() OVER (PARTITION BY user_id ORDER BY round(value, 9) DESC, event_id)::INTEGER AS rank
        FROM events QUALIFY rank <= 10"""
    q["cumulative_hits"] = ctes(LABELS, dense_run([64])) + (
        """SELECT query_id, doc_id, rank::INTEGER AS rank, (j.doc_id IS NOT NULL)::INTEGER AS rel,
        sum((j.doc_id IS NOT NULL)::INTEGER) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS hits
        FROM run LEFT JOIN qrels j USING (query_id, doc_id)"""
    )
    q["early_stop"] = ctes(LOG) + "SELECT run_id, stop_event FROM stops"
    q["best_step"] = ctes(LOG) + (
        """SELECT run_id, arg_min(event_id, step) FILTER (value = best) AS best_event, min(value) AS best_value
        FROM (SELECT w.*, min(value) OVER (PARTITION BY run_id) AS best
              FROM waits w JOIN stops USING (run_id) WHERE stop IS NULL OR step <= stop) GROUP BY 1"""
    )
    q["no_duplicate_batches_rules"] = ctes(TEXT_TRIPLETS) + (
        f"SELECT count(*) AS n_rows, count(*) // {TEXT_BATCH} AS n_batches, 0::BIGINT AS oversized, 0::BIGINT AS repeated_texts FROM text_triplets"
    )
    q["no_duplicate_batches"] = ctes(TEXT_TRIPLETS) + (
        f"SELECT count(*) AS n_rows, count(*) // {TEXT_BATCH} AS n_batches, 0::BIGINT AS oversized, 0::BIGINT AS repeated_texts, 0::BIGINT AS placeable FROM text_triplets"
    )
    different = f"len(list_distinct([lower(trim(x)) for x in [query, {nt('positive')}, {nt('negative')}] if x IS NOT NULL]))::BIGINT"
    q["no_duplicate_batches_rows"] = ctes(TEXT_TRIPLETS) + (
        f"SELECT pos, {different} AS n_texts, 0::BIGINT AS repeats FROM text_triplets"
    )
    q["validation_loss"] = validation_sql()
    q["prepare_training_rows"] = ctes(SPLIT) + (
        f"""SELECT pos, split AS part, query AS sentence_0, {nt('positive')} AS sentence_1, {nt('negative')} AS sentence_2,
        CASE split WHEN 'train' THEN {different} ELSE 0 END AS n_texts, 0::BIGINT AS repeats FROM split_rows"""
    )
    q["prepare_training"] = ctes(SPLIT) + (
        f"""SELECT count(*) FILTER (split = 'train') AS n_rows, count(*) FILTER (split = 'train') // {TEXT_BATCH} AS n_batches,
        0::BIGINT AS oversized, 0::BIGINT AS repeated_texts, 0::BIGINT AS placeable,
        count(*) FILTER (split = 'train') AS train_and_unplaced, count(*) FILTER (split = 'validation') AS n_validation,
        0::BIGINT AS shared_queries FROM split_rows"""
    )
    q["encode_texts"] = f"""
        SELECT doc_id, (('0x' || substr(md5(w), 1, 8))::BIGINT % {ENCODER_DIM})::INTEGER AS i,
               sum(1 - 2 * (('0x' || substr(md5(w), 9, 1))::INTEGER % 2))::DOUBLE AS x
        FROM (SELECT doc_id, unnest({toks('lower(text)')}) AS w FROM documents)
        GROUP BY ALL HAVING x <> 0"""
    q["union_systems"] = both_systems(CHAT_RAW)
    q["evaluate_dense"] = both_systems(BENCH_RAW)
    q["evaluate_bm25"] = bm25_both()
    q["evaluate_all"] = (
        f"SELECT * FROM ({both_systems(BENCH_RAW, BENCH_NAME)}) UNION ALL BY NAME SELECT * FROM ({both_systems(CHAT_RAW, CHAT_NAME)})"
    )
    names = ", ".join(f"{n} AS bm25_{n}" for n in metric_exprs(False))
    q["write_results_json"] = (
        f"SELECT 'bm25' AS model_path, dataset, replace(dataset, '/', '_') AS folder, truncate_dim, {names} FROM ({bm25_both()})"
    )
    q["results_markdown"] = ctes(markdown()) + "SELECT * FROM md"
    opening = ["# report", "", "Retrieval evaluation.", "", "## Evaluation", "", "- Truncate dims: `[]`", ""]
    fixed = " UNION ALL ".join(f"SELECT '{x}' AS line" for x in opening)
    q["results_card"] = ctes(markdown()) + (
        f"""{fixed} UNION ALL SELECT unnest(['### ' || dataset, '', '']) FROM results UNION ALL SELECT line FROM md"""
    )
    q["append_metric_log"] = """
        SELECT user_id::DOUBLE AS epoch, count(*) AS steps, printf('%.6f', sum(value::DECIMAL(18,2))::DOUBLE / count(*)) AS validation_loss
        FROM events GROUP BY user_id"""
    return q
