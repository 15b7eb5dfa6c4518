"""SQL counterparts of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from vecmill.functions import messages as M
from vecmill.functions import text as X
from vecmill.plans import queries as Q

WORDS = f"regexp_extract_all(lower(text), '{X.WORD}')"
TOKENS = f"regexp_extract_all(text, '{X.WORD_OR_SIGN}')"
# Positions that tokens of a text can take next to the two special tokens.
BODY = X.MAX_LENGTH - 2


def _elements(vector: str, name: str = "vector_x2") -> str:
    return (
        "SELECT vec_id, label, unnest(range(len(embedding))) AS dim, "
        f"unnest({vector}) AS {name} FROM embeddings"
    )


DOUBLED = "list_transform(embedding, lambda x: x * 2)"
SCALED = _elements(DOUBLED)
SHUFFLED = (
    f"SELECT *, row_number() OVER (ORDER BY md5(vec_id || ':{Q.SEED}'), vec_id) AS r FROM embeddings"
)
BATCHED = (
    f"SELECT *, (r - 1) // {Q.LOADER_BATCH} AS batch, (r - 1) % {Q.LOADER_BATCH} AS pos "
    f"FROM ({SHUFFLED})"
)
ARGMAX = "list_position(embedding, list_max(embedding)) - 1"
PREDICTED = f"SELECT label, ({ARGMAX}) % 10 AS prediction FROM embeddings"
ACCURACY = (
    "count(*) AS rows, sum((prediction = label)::INT)::BIGINT AS correct, "
    "avg((prediction = label)::INT) AS accuracy"
)
VOCABULARY = f"""
SELECT token, n,
       row_number() OVER (ORDER BY n DESC, token) - 1 + {len(X.SPECIAL_IDS)} AS token_id
FROM (SELECT token, count(*) AS n FROM (SELECT unnest({TOKENS}) AS token FROM documents)
      GROUP BY token)"""


def _per_table(sql: str) -> str:
    """``sql`` for every table, with ``{t}`` for its name."""
    return " UNION ALL ".join(sql.format(t=t) for t in Q.TABLES)


def _profile(table: str, columns: dict[str, bool]) -> str:
    """``columns`` says of each column whether it has a mean."""
    parts = []
    for column, numeric in columns.items():
        mean = f"round(avg({column}), 6)" if numeric else "NULL::DOUBLE"
        parts.append(
            f"SELECT '{table}' AS table_name, '{column}' AS column_name, count(*) AS rows, "
            f"count(*) - count({column}) AS nulls, count(DISTINCT {column}) AS n_distinct, "
            f"min({column})::VARCHAR AS lowest, max({column})::VARCHAR AS highest, "
            f"{mean} AS mean FROM {table}"
        )
    return " UNION ALL ".join(parts)


def _values(rows: list[tuple[object, ...]]) -> str:
    def literal(value: object) -> str:
        return f"'{value}'" if isinstance(value, str) else repr(value)

    return ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)


def _top(scores: str) -> str:
    return f"""
SELECT query, doc_id, round(score, 6) AS score, rank
FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank
      FROM ({scores}))
WHERE rank <= {Q.TOP_K}"""


def _postings(queries: str) -> str:
    """CTEs ``q(query, term, weight)`` as given, ``d`` documents with their words, and
    ``p(query, doc_id, weight, term, tf, len)`` for every query term and document."""
    return f"""
WITH q AS ({queries}),
     d AS MATERIALIZED (SELECT doc_id, {WORDS} AS words FROM documents),
     p AS (SELECT q.query, q.term, q.weight, d.doc_id, len(d.words) AS len,
                  len(list_filter(d.words, lambda w: w = q.term))::DOUBLE AS tf
           FROM q, d)"""


MATCH_TERMS = (
    f"SELECT query, term, count(*) AS weight FROM (SELECT query, unnest({WORDS}) AS term FROM "
    f"(VALUES {_values(list(Q.MATCH_QUERIES.items()))}) AS v(query, text)) GROUP BY query, term"
)
SPARSE_TERMS = "SELECT * FROM (VALUES {}) AS v(query, term, weight)".format(
    _values([(q, t, w) for q, ws in Q.SPARSE_QUERIES.items() for t, w in ws.items()])
)

BM25 = _postings(MATCH_TERMS) + _top("""
SELECT query, doc_id,
       sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * (1.2 + 1)
           / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avglen))) AS score
FROM p
JOIN (SELECT query, term, sum((tf > 0)::INT)::DOUBLE AS df FROM p GROUP BY query, term)
     USING (query, term),
     (SELECT count(*)::DOUBLE AS n, avg(len(words)) AS avglen FROM d WHERE len(words) > 0)
WHERE tf > 0 GROUP BY query, doc_id""")

BENCHMARK = f"""
WITH q AS (SELECT query, term, count(*) AS weight
           FROM (SELECT item_id::VARCHAR AS query, unnest({WORDS}) AS term FROM benchmark)
           GROUP BY query, term),
     d AS MATERIALIZED (SELECT doc_id, {WORDS} AS words FROM documents),
     t AS MATERIALIZED (SELECT doc_id, len, term, count(*)::DOUBLE AS tf
                        FROM (SELECT doc_id, len(words) AS len, unnest(words) AS term FROM d)
                        GROUP BY doc_id, len, term),
     f AS (SELECT term, count(*)::DOUBLE AS df FROM t GROUP BY term)""" + _top("""
SELECT query, doc_id,
       sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * (1.2 + 1)
           / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avglen)) ORDER BY term) AS score
FROM q JOIN t USING (term) JOIN f USING (term),
     (SELECT count(*)::DOUBLE AS n, avg(len(words)) AS avglen FROM d WHERE len(words) > 0)
GROUP BY query, doc_id""")

SPARSE = _postings(SPARSE_TERMS) + _top("""
SELECT query, doc_id, sum(weight * tf / len) AS score FROM p WHERE tf > 0 GROUP BY query, doc_id""")

FILES = _per_table("SELECT '{t}.parquet' AS file_name, count(*) AS rows FROM {t}")
# A corpus with a folder for each label, and one for -1 whose file is empty.
FOLDER = "'label=' || coalesce(label::VARCHAR, '__HIVE_DEFAULT_PARTITION__')"
FOLDERS = f"""
SELECT {FOLDER} || '/part' AS file_name, count(*) AS rows FROM embeddings GROUP BY label
UNION ALL SELECT 'label=-1/part', 0"""

ORACLES: dict[str, str] = {
    "scan_parquet": "SELECT vec_id, label, len(embedding) AS n_dims FROM embeddings",
    "row_count": _per_table("SELECT '{t}' AS table_name, count(*) AS rows FROM {t}"),
    "file_rows": f"{FILES} UNION ALL {FOLDERS}",
    "file_shards": (
        f"SELECT file_name, rows, (row_number() OVER (ORDER BY file_name) - 1) % {Q.SHARDS} "
        f"AS shard FROM ({FOLDERS})"
    ),
    "uri_parts": """
SELECT page_id, string_split(url, '/')[-1] AS base,
       CASE WHEN starts_with(url, 'http://') THEN substr(url, 8) ELSE url END AS key,
       'processed_' || string_split(url, '/')[-1] AS processed
FROM pages""",
    "split_select": """
SELECT d.doc_id, d.lang, d.n_chars, CASE WHEN l.doc_id IS NULL THEN 'test' ELSE 'train' END AS split
FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "vector_scale": SCALED,
    "vector_scale_f32": _elements(
        "list_transform(list_transform(embedding, lambda x: x::DOUBLE / 3)::FLOAT[]::DOUBLE[], "
        "lambda x: x * 2)"
    ),
    "map_batches_scale": SCALED,
    "chunk_report": "SELECT count(*) AS rows, true AS within_batch_size FROM embeddings",
    "write_roundtrip": SCALED,
    "shard_outputs": f"""
SELECT {FOLDER} || '/part' AS input, {FOLDER} || '/processed_part' AS output,
       count(*) AS rows, count(*) AS rows_written, label,
       round(sum(list_sum(list_transform(embedding, lambda x: (x * 2)::DOUBLE))), 3) AS total
FROM embeddings GROUP BY label
UNION ALL SELECT 'label=-1/part', 'label=-1/processed_part', 0, 0, NULL, NULL""",
    "overwrite_then_append": SCALED,
    "incremental_events": "SELECT event_id, user_id, event_type, value, props FROM events",
    "row_commits": f"""
SELECT event_id, user_id, event_type, value,
       ((row_number() OVER (ORDER BY event_id) - 1)
        // ({Q.COMMIT_GROUPS} * ((count(*) OVER () + {Q.ROW_GROUPS} - 1) // {Q.ROW_GROUPS})))::BIGINT AS batch_id
FROM events""",
    "param_partition": (
        "SELECT vec_id, label, unnest([64, 128])::BIGINT AS batch_size FROM embeddings"
    ),
    "compact_files": SCALED,
    "strategy_parity": """
SELECT unnest(['shards', 'table', 'batches', 'small_batches', 'instances']) AS strategy,
       rows, 0::BIGINT AS differences
FROM (SELECT count(*) AS rows FROM embeddings)""",
    "version_latest": _elements(DOUBLED, "vector"),
    "version_pinned": _elements("embedding", "vector"),
    "version_history": """
SELECT unnest([0, 1])::BIGINT AS version, 'overwrite' AS operation, rows
FROM (SELECT count(*) AS rows FROM embeddings)""",
    "snapshot_export": _elements(DOUBLED, "vector"),
    "tracked_dataset": _elements(DOUBLED, "vector"),
    "run_log": f"""
WITH steps AS (SELECT batch, avg(label) AS loss FROM ({BATCHED}) GROUP BY batch),
     size AS (SELECT count(*) AS n FROM steps),
     series AS (SELECT epoch, batch + epoch * n AS step, loss / (epoch + 1) AS metric
                FROM steps, size, range({Q.EPOCHS}) e(epoch))
SELECT 'train_loss' AS key, step, metric FROM series
UNION ALL SELECT 'epoch_loss', epoch, arg_max(metric, step) FROM series GROUP BY epoch""",
    "conditional_column": """
SELECT event_id, event_type, coalesce(event_type = 'purchase', false) AS is_purchase FROM events""",
    "drop_rename": "SELECT doc_id, quality AS labels FROM labels",
    "argmax_label": f"SELECT vec_id, ({ARGMAX})::INT AS prediction FROM embeddings",
    "upsert_by_id": """
SELECT doc_id, -1 AS quality, -1 AS toxic, unnest([0, 9]) AS seq
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, quality, toxic, 2 FROM labels""",
    "seeded_sample": f"SELECT vec_id, label FROM ({SHUFFLED}) WHERE r <= {Q.SAMPLE}",
    "loader_batches": f"""
SELECT epoch, (r - 1) // {Q.LOADER_BATCH} AS batch,
       string_agg(vec_id::VARCHAR, ',' ORDER BY r) AS vec_ids,
       string_agg(label::VARCHAR, ',' ORDER BY r) AS labels
FROM (SELECT *, row_number() OVER (PARTITION BY epoch
                                   ORDER BY md5(vec_id || ':{Q.SEED}:' || epoch), vec_id) AS r
      FROM embeddings, range({Q.EPOCHS}) e(epoch))
GROUP BY epoch, batch""",
    "training_steps": f"""
SELECT rows, steps AS steps_per_epoch, steps * {Q.EPOCHS} AS total_steps
FROM (SELECT count(*) AS rows, ceil(count(*) / {Q.LOADER_BATCH})::BIGINT AS steps FROM embeddings)""",
    "step_numbers": f"""
WITH steps AS (SELECT batch, count(*) AS rows FROM ({BATCHED}) GROUP BY batch)
SELECT batch, rows, epoch, batch + epoch * (SELECT count(*) FROM steps) AS global_step
FROM steps, range({Q.EPOCHS}) e(epoch)""",
    "accuracy": f"SELECT {ACCURACY} FROM ({PREDICTED})",
    "accuracy_by_class": f"SELECT label, {ACCURACY} FROM ({PREDICTED}) GROUP BY label",
    "dataset_profile": " UNION ALL ".join(
        [
            _profile(
                "documents",
                {"doc_id": True, "text": False, "lang": False, "source": False, "n_chars": True},
            ),
            _profile("labels", {"doc_id": True, "quality": True, "toxic": True}),
            _profile("conversations", {"conv_id": True, "turn": True, "role": False, "text": False}),
        ]
    ),
    "array_profile": """
SELECT count(*) AS rows, count(*) - count(embedding) AS nulls,
       min(len(embedding))::VARCHAR AS lowest, max(len(embedding))::VARCHAR AS highest,
       avg(len(embedding)) AS mean
FROM embeddings""",
    "fanout_distinct": "SELECT DISTINCT 'user-' || user_id AS value FROM events",
    "tokenize_pad": f"""
SELECT doc_id, len(toks) AS n_tokens, {X.MAX_LENGTH}::BIGINT AS length, least(len(toks), {BODY}) + 2 AS n_real,
       array_to_string(list_resize(list_concat(['{X.CLS}'], toks[1:{BODY}], ['{X.SEP}']),
                                   {X.MAX_LENGTH}, '{X.PAD}'), ' ') AS tokens
FROM (SELECT doc_id, {TOKENS} AS toks FROM documents)""",
    "token_vocab": VOCABULARY,
    "token_ids": f"""
WITH vocabulary AS ({VOCABULARY}),
     placed AS (SELECT doc_id, unnest(toks) AS token, unnest(range(len(toks))) AS pos
                FROM (SELECT doc_id, ({TOKENS})[1:{BODY}] AS toks FROM documents)),
     ids AS (SELECT doc_id, list(token_id ORDER BY pos) AS ids
             FROM placed JOIN vocabulary USING (token) GROUP BY doc_id)
SELECT doc_id, {X.MAX_LENGTH}::BIGINT AS length, coalesce(len(ids), 0) + 2 AS n_real,
       array_to_string(list_resize(list_concat([{X.SPECIAL_IDS[X.CLS]}], coalesce(ids, []),
                                               [{X.SPECIAL_IDS[X.SEP]}]),
                                   {X.MAX_LENGTH}, {X.SPECIAL_IDS[X.PAD]}), ' ') AS input_ids
FROM documents LEFT JOIN ids USING (doc_id)""",
    "bm25_topk": BM25,
    "benchmark_topk": BENCHMARK,
    "indexed_topk": BENCHMARK,
    "sparse_topk": SPARSE,
    "reindex_scored": """
SELECT doc_id, lang, len(regexp_extract_all(text, '[A-Za-z]+')) AS n_words FROM documents""",
    "prompt_requests": f"""
SELECT m.conv_id, '{M.FORMAT_VERSION}' AS anthropic_version,
       {M.MAX_TOKENS}::BIGINT AS max_tokens,
       coalesce(s.text, '{Q.SYSTEM_PROMPT}') AS system,
       row_number() OVER (PARTITION BY m.conv_id ORDER BY m.turn) - 1 AS pos,
       m.role, m.text AS content
FROM conversations m
LEFT JOIN (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations
           WHERE role = 'system' GROUP BY conv_id) s USING (conv_id)
WHERE m.role <> 'system'""",
    "request_parts": f"""
WITH placed AS (SELECT *, coalesce(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {Q.PART_BYTES} AS slot
                FROM conversations WHERE text IS NOT NULL),
     said AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY slot) - 1 AS part
              FROM placed WHERE role <> 'system')
SELECT m.conv_id || CASE WHEN m.part = 0 THEN '' ELSE '-' || m.part END AS record_id, m.conv_id, m.part, s.text AS system,
       row_number() OVER (PARTITION BY m.conv_id, m.part ORDER BY m.turn, m.role, m.text) - 1 AS pos, m.role, m.text AS content
FROM said m
LEFT JOIN (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations
           WHERE role = 'system' GROUP BY conv_id) s USING (conv_id)""",
    "replicate_rows": (
        f"SELECT conv_id, turn, role, unnest(range({Q.COPIES})) AS rep FROM conversations"
    ),
    "batch_minimum": _per_table(
        f"SELECT '{{t}}' AS table_name, count(*) AS rows, count(*) >= {M.BATCH_MINIMUM} "
        "AS meets_minimum FROM {t}"
    ),
    "response_check": """
SELECT conv_id, turn, role, role = 'assistant' AS valid,
       CASE WHEN role = 'assistant' THEN NULL WHEN role = 'system' THEN 'missing $.hits.hits[0]._source'
            WHEN role = 'user' AND turn = 0 THEN 'other type at top' ELSE 'not JSON' END AS reason,
       CASE WHEN role = 'system' THEN '{"hits":{"hits":[]}}' WHEN role = 'user' AND turn = 0 THEN '["text"]'
            ELSE text END AS text
FROM conversations""",
    "response_parse": """
SELECT conv_id, turn, role = 'assistant' AS parsed, text FROM conversations""",
}
