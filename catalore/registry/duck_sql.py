"""The registered queries as DuckDB SQL over the given tables."""

from __future__ import annotations

from catalore.functions.text import BLANKS, UNSAFE_CHARACTERS
from catalore.operators.prompts import (
    COLUMN_PROMPT_HEAD,
    COLUMN_PROMPT_TAIL,
    TABLE_PROMPT_HEAD,
    TABLE_PROMPT_TAIL,
)

AS_OF = "TIMESTAMP '2024-01-20 12:00:00'"

VIEWS = {
    "items": """
SELECT d.doc_id AS id, 'main' AS catalog_name, d.lang AS schema_name, d.source AS table_name,
 CASE WHEN d.doc_id % 5 = 0 THEN NULL WHEN d.doc_id % 35 = 1 THEN '' ELSE concat('col_', CAST(d.doc_id % 7 AS STRING)) END AS column_name,
 CASE WHEN d.doc_id % 3 = 0 THEN 'comment' ELSE 'description' END AS metadata_type,
 CASE WHEN d.doc_id % 4 = 0 THEN concat('Previous text for ', d.source) END AS original_value,
 d.text AS generated_value, d.text AS current_value,
 CASE WHEN l.doc_id IS NULL THEN 'pending' WHEN l.toxic = 1 THEN 'rejected' WHEN l.quality = 1 THEN 'approved' ELSE 'edited' END AS status,
 CASE WHEN d.doc_id % 2 = 0 THEN 'openai_gpt-4' ELSE 'openai_gpt-3.5-turbo' END AS generation_method,
 concat('Table: ', d.source) AS generation_prompt,
 CASE WHEN d.doc_id % 11 = 0 THEN NULL WHEN d.doc_id % 13 = 0 THEN '{"error": "timeout"}' WHEN d.doc_id % 17 = 0 THEN 'not json'
      ELSE concat('{"model": "gpt-4", "tokens_used": ', CAST(d.n_chars AS STRING), ', "cost_estimate": 0.00', CAST(d.doc_id % 90 + 10 AS STRING), '}') END AS generation_metadata,
 CASE d.doc_id % 7 WHEN 0 THEN concat('["', d.source, '","', d.lang, '"]') WHEN 1 THEN concat('[{"id":', CAST(d.doc_id AS STRING), '}]')
      WHEN 2 THEN 'not a list' WHEN 3 THEN '' END AS data_sample,
 e.ts AS created_at, greatest(e.ts, u.ts) AS updated_at,
 CASE WHEN d.doc_id % 5 = 0 THEN 'ai_table_generator' ELSE 'ai_bulk_generator' END AS created_by,
 CASE WHEN l.doc_id IS NOT NULL THEN concat('user_', CAST(u.user_id AS STRING)) END AS reviewed_by,
 CASE WHEN l.doc_id IS NOT NULL THEN greatest(e.ts, u.ts) END AS reviewed_at
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
JOIN events e ON e.event_id = d.doc_id JOIN events u ON u.event_id = d.doc_id * 2""",
    "history": """
SELECT e.event_id AS id, e.event_id % (SELECT count(*) FROM documents) AS metadata_item_id,
 CASE e.event_type WHEN 'click' THEN 'approved' WHEN 'view' THEN 'edited' WHEN 'error' THEN 'rejected' WHEN 'signup' THEN 'imported' ELSE 'import_failed' END AS action,
 CASE WHEN e.event_type IN ('click','view','error') THEN concat('v', CAST(e.event_id % 3 AS STRING)) END AS old_value,
 CASE WHEN e.event_type IN ('click','view','error') THEN concat('v', CAST(e.event_id % 4 AS STRING)) END AS new_value,
 e.props AS comment, CASE WHEN e.event_id % 31 <> 0 THEN concat('user_', CAST(e.user_id AS STRING)) END AS user_name, e.ts AS timestamp
FROM events e""",
    "actions": """
SELECT id AS action_id, CASE WHEN id % 97 = 0 THEN -metadata_item_id ELSE metadata_item_id END AS item_id, new_value,
 CASE WHEN id % 89 = 0 THEN 'archived' ELSE action END AS status, user_name AS reviewed_by, comment, timestamp AS ts
FROM history WHERE action IN ('approved', 'edited', 'rejected')""",
    "acceptable": """
SELECT * FROM actions WHERE status IN ('approved', 'edited', 'rejected') AND item_id IS NOT NULL AND new_value IS NOT NULL""",
    "upload": """
SELECT CASE WHEN conv_id % 50 = 7 THEN NULL ELSE 'main' END AS catalog_name, role AS schema_name,
 CASE WHEN conv_id % 40 = 9 THEN repeat('t', 300) ELSE concat('t_', CAST(conv_id % 9 AS STRING)) END AS table_name,
 CASE WHEN turn = 0 THEN NULL ELSE concat('col_', CAST(turn AS STRING)) END AS column_name,
 CASE WHEN conv_id % 5 = 3 THEN concat('note_', CAST(conv_id AS STRING), '_', CAST(turn AS STRING)) WHEN turn % 2 = 0 THEN 'comment' ELSE 'description' END AS metadata_type,
 CAST(NULL AS STRING) AS original_value, CASE WHEN conv_id % 30 = 4 THEN '  ' ELSE text END AS generated_value
FROM conversations""",
    "approved": """
SELECT * FROM items WHERE status IN ('approved', 'edited') AND metadata_type IN ('description', 'comment')""",
    "live_tables": """
SELECT DISTINCT 'main' AS catalog_name, lang AS schema_name, source AS table_name FROM documents WHERE n_chars > 5000""",
    "odd_actions": """
SELECT * REPLACE (CASE WHEN action_id % 7 <> 3 THEN CASE WHEN action_id % 5 = 1 THEN action_id - 1 ELSE action_id END END AS action_id) FROM actions""",
    "live_descriptions": """
SELECT catalog_name, schema_name, table_name, max(current_value) AS comment FROM items
WHERE status = 'approved' AND metadata_type = 'description' AND coalesce(column_name, '') = '' GROUP BY ALL""",
    "live_columns": """
SELECT catalog_name, schema_name, table_name, column_name, max(current_value) AS comment FROM items
WHERE status = 'approved' AND metadata_type = 'description' AND column_name <> '' GROUP BY ALL""",
    "import_results": """
SELECT h.metadata_item_id AS id, i.catalog_name, i.schema_name, i.table_name, i.column_name,
 CASE WHEN length(i.current_value) > 100 THEN substring(i.current_value, 1, 100) || '...' ELSE i.current_value END AS description,
 h.action = 'imported' AS success, h.comment AS message
FROM history h JOIN items i ON i.id = h.metadata_item_id WHERE h.action IN ('imported', 'import_failed')""",
}
NEEDS = {
    "actions": ["history"],
    "acceptable": ["history", "actions"],
    "approved": ["items"],
    "live_columns": ["items"],
    "live_descriptions": ["items"],
    "odd_actions": ["history", "actions"],
    "import_results": ["items", "history"],
}

# The star schema as the Spark reader types it.
STAR = {
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "customer": [
        ("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
        ("c_acctbal", "double"), ("c_mktsegment", "string"),
    ],
    "supplier": [
        ("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"),
        ("s_acctbal", "double"),
    ],
    "part": [
        ("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"),
        ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double"),
    ],
    "orders": [
        ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
        ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"),
        ("o_orderpriority", "string"),
    ],
    "lineitem": [
        ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
        ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
        ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
        ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz"),
    ],
}
DOCUMENTS = [
    ("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
    ("n_chars", "bigint"),
]
ORDERS = {
    "region": "r_regionkey",
    "nation": "n_nationkey",
    "customer": "c_custkey",
    "supplier": "s_suppkey",
    "part": "p_partkey",
    "orders": "o_orderkey",
    "lineitem": "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice",
    "documents": "doc_id",
}


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def using(views: str, body: str, **extra: str) -> str:
    """``body`` over the named views, with everything they are made of."""
    wanted: list[str] = []
    for name in views.split():
        wanted += [n for n in [*NEEDS.get(name, []), name] if n not in wanted]
    parts = [f"{name} AS ({VIEWS[name].strip()})" for name in wanted]
    parts += [f"{name} AS ({sql.strip()})" for name, sql in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()


def meta(field: str, kind: str = "VARCHAR") -> str:
    return (
        f"CASE WHEN json_valid(generation_metadata) THEN "
        f"TRY_CAST(json_extract_string(generation_metadata, '$.{field}') AS {kind}) END"
    )


def short(text: str, limit: int, keep: int | None = None) -> str:
    return (
        f"CASE WHEN length({text}) > {limit} THEN substring({text}, 1, {keep or limit}) || '...' "
        f"ELSE {text} END"
    )


def ago(ts: str) -> str:
    s = f"((epoch_us({AS_OF}) - epoch_us({ts})) // 1000000)"
    return f"""CASE WHEN {ts} IS NULL THEN 'Never'
 WHEN {ts} > {AS_OF} THEN 'Just now'
 WHEN {s} // 86400 > 7 THEN strftime({ts}, '%Y-%m-%d %H:%M')
 WHEN {s} // 86400 > 0 THEN ({s} // 86400) || ' days ago'
 WHEN {s} % 86400 > 3600 THEN ({s} % 86400 // 3600) || ' hours ago'
 WHEN {s} % 86400 > 60 THEN ({s} % 86400 // 60) || ' minutes ago'
 ELSE 'Just now' END"""


NAME = "concat_ws('.', catalog_name, schema_name, table_name, nullif(column_name, ''))"
COLOR = (
    "CASE {0} WHEN 'pending' THEN '#FFA500' WHEN 'approved' THEN '#28a745' "
    "WHEN 'rejected' THEN '#dc3545' WHEN 'edited' THEN '#17a2b8' ELSE '#6c757d' END"
)
COLUMN_LEVEL = "metadata_type = 'description' AND column_name IS NOT NULL AND column_name <> ''"
TABLE_LEVEL = "metadata_type = 'description' AND (column_name IS NULL OR column_name = '')"
NAME_FILTER = "(contains(table_name, 'src1') OR contains(table_name, '7'))"
ESCAPED = "replace(replace({0}, '\\', '\\\\'), '''', '''''')"
WORDS = f"len(regexp_extract_all({{0}}, '[^{BLANKS}]+'))"


def ident(name: str) -> str:
    return (
        f"CASE WHEN regexp_full_match({name}, '[A-Za-z0-9_]+') THEN {name} "
        f"ELSE '`' || replace({name}, '`', '``') || '`' END"
    )


TABLE_IDENT = (
    f"({ident('catalog_name')}) || '.' || ({ident('schema_name')}) || '.' || ({ident('table_name')})"
)


def column_statement(text: str) -> str:
    return (
        f"'ALTER TABLE ' || {TABLE_IDENT} || ' ' || chr(10) || 'ALTER COLUMN ' || "
        f"({ident('column_name')}) || ' ' || chr(10) || 'COMMENT ''' || {ESCAPED.format(text)} || ''';'"
    )


def table_statement(text: str) -> str:
    return (
        f"'ALTER TABLE ' || {TABLE_IDENT} || ' ' || chr(10) || "
        f"'SET TBLPROPERTIES (''comment'' = ''' || {ESCAPED.format(text)} || ''');'"
    )


def value_message(value: str) -> str:
    label = "upper(substring(metadata_type, 1, 1)) || substring(metadata_type, 2)"
    return f"""CASE WHEN trim({value}, {lit(BLANKS)}) = '' OR {value} IS NULL THEN {label} || ' cannot be empty'
 WHEN length({value}) > 5000 THEN {label} || ' is too long (max 5000 characters)'
 WHEN metadata_type = 'comment' AND {WORDS.format(value)} < 3 THEN 'Comments should be more descriptive (at least 3 words)' END"""


REQUIRED = ["catalog_name", "schema_name", "table_name", "metadata_type", "generated_value"]
UPLOAD_ERRORS = "list_filter([{}], lambda x: x IS NOT NULL)".format(
    ", ".join(
        [f"CASE WHEN {n} IS NULL THEN 'Column ''{n}'' contains empty values' END" for n in REQUIRED]
        + [
            "CASE WHEN metadata_type IS NULL OR metadata_type NOT IN ('comment', 'description') THEN "
            "'Invalid metadata_type values: [''' || coalesce(metadata_type, 'nan') || '''] . "
            "Must be one of: [''comment'', ''description'']' END".replace("] .", "].")
        ]
        # The texts that the store limits.
        + [
            f"CASE WHEN length({n}) > 255 THEN '{n} is longer than 255' END"
            for n in ("catalog_name", "schema_name", "table_name", "column_name")
        ]
    )
)


# --- profiling ---------------------------------------------------------------


def samples_of(table: str, column: str) -> str:
    return (
        f"SELECT '{table}' AS table_name, '{column}' AS column_name, "
        f"(SELECT list(CAST(v AS VARCHAR) ORDER BY v) FROM (SELECT DISTINCT {column} AS v FROM {table} "
        f"WHERE {column} IS NOT NULL ORDER BY v LIMIT 5)) AS samples"
    )


SAMPLES = " UNION ALL ".join(samples_of(t, c) for t, cs in STAR.items() for c, _ in cs)
COLUMNS = "SELECT * FROM (VALUES {}) AS c(table_name, ordinal, column_name, data_type)".format(
    ", ".join(
        f"('{t}', {i}, '{c}', '{k}')" for t, cs in STAR.items() for i, (c, k) in enumerate(cs, 1)
    )
)


def counts_of(tables: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in tables
    )


def cell(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"coalesce({short(text, 50, 47)}, 'NULL')"


def first_rows(table: str) -> str:
    order = ORDERS[table]
    return (
        f"(SELECT *, row_number() OVER (ORDER BY {order}) AS row_no FROM {table} "
        f"ORDER BY {order} LIMIT 3)"
    )


def rows_json(table: str, columns: list[tuple[str, str]]) -> str:
    fields = ", ".join(f"'{c}': {cell(c)}" for c, _ in columns)
    return (
        f"SELECT '{table}' AS table_name, row_no, CAST(to_json({{{fields}}}) AS VARCHAR) AS row_json "
        f"FROM {first_rows(table)}"
    )


ROWS_JSON = " UNION ALL ".join(rows_json(t, cs) for t, cs in STAR.items())
PREVIEW = f"""SELECT table_name, count(*) AS column_count,
 string_agg('  - ' || column_name || ' (' || data_type || ')', chr(10) ORDER BY ordinal) FILTER (ordinal <= 10)
 || CASE WHEN count(*) > 10 THEN chr(10) || '  ... and ' || (count(*) - 10) || ' more columns' ELSE '' END AS columns_text
FROM ({COLUMNS}) GROUP BY table_name"""
COLUMN_PROMPTS = f"""SELECT c.*, s.samples,
 {lit(COLUMN_PROMPT_HEAD)} || c.table_name || chr(10) || 'Column: ' || c.column_name || chr(10) || 'Data Type: ' || c.data_type
 || CASE WHEN len(s.samples) > 0 THEN chr(10) || 'Sample Values: ' || array_to_string(s.samples[1:3], ', ') ELSE '' END
 || {lit(COLUMN_PROMPT_TAIL)} AS prompt
FROM ({COLUMNS}) c LEFT JOIN ({SAMPLES}) s USING (table_name, column_name)"""
TABLE_PROMPTS = f"""SELECT n.table_name, n.row_count, p.column_count, p.columns_text, r.row_samples,
 {lit(TABLE_PROMPT_HEAD)} || n.table_name
 || CASE WHEN n.row_count > 0 THEN chr(10) || 'Approximate Rows: ' || format('{{:,}}', n.row_count) ELSE '' END
 || chr(10) || 'Columns (' || p.column_count || '):' || chr(10) || p.columns_text
 || CASE WHEN len(r.row_samples) > 0 THEN chr(10) || 'Sample Data:' || chr(10) || 'Row 1: ' || r.row_samples[1]
    || CASE WHEN len(r.row_samples) > 1 THEN chr(10) || 'Row 2: ' || r.row_samples[2] ELSE '' END ELSE '' END
 || {lit(TABLE_PROMPT_TAIL)} AS prompt
FROM ({counts_of(list(STAR))}) n JOIN ({PREVIEW}) p USING (table_name)
LEFT JOIN (SELECT table_name, list(row_json ORDER BY row_no) AS row_samples FROM ({ROWS_JSON}) GROUP BY table_name) r USING (table_name)"""
STAMP = "2024-01-20T12:00:00.000000"
ITEM_TAIL = f"{AS_OF} AS created_at, {AS_OF} AS updated_at"


def record(extra: str = "''") -> str:
    return (
        "'{\"model\":\"template\",\"tokens_used\":0,\"cost_estimate\":0.0,\"timestamp\":\""
        + STAMP
        + "\",\"prompt_tokens\":0,\"completion_tokens\":0' || "
        + extra
        + " || '}'"
    )


HALF = "round_even({0}, 1)"


def rate(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN " + HALF.format(f"{part} * 100.0::DOUBLE / {whole}") + " END"


def listed(time: str) -> str:
    return (
        f"id, {NAME} AS full_name, metadata_type, status, {COLOR.format('status')} AS status_color, "
        f"{ago(time)} AS \"when\", reviewed_by, generation_method"
    )


NEWEST_META = f"""SELECT {meta('cost_estimate', 'DOUBLE')} AS cost, {meta('tokens_used', 'BIGINT')} AS tokens FROM items
WHERE schema_name = 'en' ORDER BY created_at DESC NULLS FIRST, id DESC LIMIT """
LATEST = """SELECT item_id, ts, action_id, status, new_value, reviewed_by FROM acceptable
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY ts DESC, action_id DESC) = 1"""
def audit_rows(actions: str, largest: str) -> str:
    order = "a.ts, a.action_id NULLS FIRST, a.new_value, a.status, a.reviewed_by NULLS FIRST, a.comment NULLS FIRST"
    return f"""SELECT {largest} + row_number() OVER (ORDER BY a.item_id, {order}) AS id, a.item_id AS metadata_item_id, a.status AS action,
 coalesce(lag(a.new_value) OVER (PARTITION BY a.item_id ORDER BY {order}), i.current_value) AS old_value,
 a.new_value, a.comment, a.reviewed_by AS user_name, a.ts AS timestamp
FROM {actions} a JOIN items i ON i.id = a.item_id"""


POSITIONS = f"""SELECT id, row_number() OVER (ORDER BY CASE status WHEN 'approved' THEN 1 ELSE 2 END,
 created_at DESC NULLS FIRST, id DESC) AS position FROM approved WHERE {COLUMN_LEVEL}"""


def oracle_sql() -> dict[str, str]:
    plain = plain_sql()
    salted = ("items_with_history", "import_valid_tables", "verify_columns")
    return {**plain, **{f"{name}_salted": plain[name] for name in salted}}


def plain_sql() -> dict[str, str]:
    return {
        "items_scan": using("items", "SELECT * FROM items"),
        "items_filter": using(
            "items",
            "SELECT id, status, catalog_name, schema_name, table_name, current_value FROM items "
            "WHERE status = 'approved' AND catalog_name = 'main' AND schema_name = 'en'",
        ),
        "items_append": using(
            "items",
            f"""SELECT (SELECT max(id) FROM items) + row_number() OVER (ORDER BY source_id) AS id, * EXCLUDE (source_id)
FROM (SELECT id AS source_id, catalog_name, schema_name, table_name, column_name, metadata_type, current_value AS original_value,
 'Again: ' || generated_value AS generated_value, 'Again: ' || generated_value AS current_value, 'pending' AS status,
 generation_method, CAST(NULL AS VARCHAR) AS generation_prompt, CAST(NULL AS VARCHAR) AS generation_metadata,
 CAST(NULL AS VARCHAR) AS data_sample, {ITEM_TAIL}, 'ai_bulk_generator' AS created_by,
 CAST(NULL AS VARCHAR) AS reviewed_by, CAST(NULL AS TIMESTAMP) AS reviewed_at FROM items)""",
        ),
        "table_name_filter": using(
            "items", f"SELECT id, table_name FROM items WHERE {NAME_FILTER}"
        ),
        "token_table_filter": using(
            "items",
            """SELECT id, table_name FROM items WHERE column_name IS NOT NULL
 AND (contains(generated_value, schema_name) OR (column_name <> '' AND contains(generated_value, column_name)))""",
        ),
        "column_level_items": using(
            "items", f"SELECT id, table_name, column_name FROM items WHERE {COLUMN_LEVEL}"
        ),
        "table_level_items": using(
            "items", f"SELECT id, table_name, column_name FROM items WHERE {TABLE_LEVEL}"
        ),
        "approved_items": using(
            "items",
            """SELECT id, status, table_name, column_name, current_value FROM items WHERE status = 'approved'
UNION ALL SELECT id, status, table_name, column_name, current_value FROM items WHERE status = 'edited'""",
        ),
        "approved_column_items": using(
            "approved",
            f"SELECT id, table_name, column_name, current_value FROM approved "
            f"WHERE catalog_name = 'main' AND schema_name = 'en' AND {NAME_FILTER} AND {COLUMN_LEVEL}",
        ),
        "approved_table_items": using(
            "approved",
            f"SELECT id, table_name, column_name, current_value FROM approved "
            f"WHERE catalog_name = 'main' AND schema_name = 'en' AND {NAME_FILTER} AND {TABLE_LEVEL}",
        ),
        "item_history": using(
            "items history",
            "SELECT * FROM history WHERE metadata_item_id IN (SELECT id FROM items WHERE status = 'rejected')",
        ),
        "items_with_history": using(
            "items history",
            """SELECT i.id, i.table_name, i.status, h.id AS history_id, h.action, h.old_value, h.new_value, h.user_name, h.timestamp
FROM items i LEFT JOIN history h ON h.metadata_item_id = i.id""",
        ),
        "changed_history": using(
            "history",
            f"""SELECT id, metadata_item_id, CASE action WHEN 'import_failed' THEN 'Import_Failed' ELSE upper(action[1]) || action[2:] END
 || ' by ' || user_name AS heading, {ago('timestamp')} AS "when", coalesce(nullif(old_value, ''), 'None') AS old_value,
 coalesce(nullif(new_value, ''), 'None') AS new_value, comment FROM history WHERE old_value IS DISTINCT FROM new_value""",
        ),
        "qualified_names": using(
            "items",
            f"SELECT id, {NAME} AS full_name, catalog_name || '.' || schema_name || '.' || table_name AS table_full_name FROM items",
        ),
        "upload_template": using(
            "items",
            "SELECT catalog_name, schema_name, table_name, column_name, metadata_type, original_value, generated_value FROM items",
        ),
        "review_queue": using(
            "items",
            f"""SELECT id, {NAME} AS full_name, {NAME} || ' (' || metadata_type || ') - ' || coalesce(nullif(status, ''), 'None') AS title,
 status, {COLOR.format('status')} AS status_color, coalesce(status, '') = 'pending' AS needs_review,
 coalesce(nullif(original_value, ''), 'None') AS original_value, generated_value, current_value, generation_method,
 {meta('model')} AS model, {meta('tokens_used', 'BIGINT')} AS tokens_used, {meta('cost_estimate', 'DOUBLE')} AS cost_estimate,
 {meta('error')} AS generation_error, CASE WHEN json_valid(nullif(data_sample, '')) THEN array_to_string(json_extract_string(data_sample, '$[*]'), ', ')
 ELSE nullif(data_sample, '') END AS data_sample, {ago('created_at')} AS created,
 coalesce(nullif(created_by, ''), 'Unknown') AS created_by, reviewed_by,
 CASE WHEN reviewed_by <> '' THEN {ago('reviewed_at')} END AS reviewed FROM items""",
        ),
        "recent_activity": using(
            "items",
            f"SELECT {listed('created_at')} FROM items ORDER BY created_at DESC NULLS FIRST, id DESC LIMIT 10",
        ),
        "activity_timeline": using(
            "items",
            f"SELECT {listed('updated_at')} FROM items ORDER BY updated_at DESC NULLS LAST, id DESC LIMIT 20",
        ),
        "relative_time": using("history", f"SELECT id, {ago('timestamp')} AS shown FROM history"),
        "relative_time_text": using(
            "history",
            f"SELECT id, CASE WHEN id % 10 = 0 THEN 'not a time' WHEN id % 10 = 1 THEN 'Never' ELSE {ago('timestamp')} END AS shown FROM history",
        ),
        "upload_round_trip": using("upload", "SELECT * EXCLUDE (original_value) FROM upload"),
        "status_colors": using(
            "history", f"SELECT id, action, {COLOR.format('action')} AS color FROM history"
        ),
        "action_labels": using(
            "history",
            "SELECT id, CASE action WHEN 'import_failed' THEN 'Import_Failed' ELSE upper(action[1]) || action[2:] END AS label FROM history",
        ),
        "humanize_names": using(
            "items", "SELECT id, replace(column_name, '_', ' ') AS words FROM items"
        ),
        "text_lengths": using(
            "items",
            f"SELECT id, length(generated_value) AS characters, {WORDS.format('generated_value')} AS words FROM items",
        ),
        "preview_text": using(
            "items",
            f"""SELECT id, {short('current_value', 100)} AS result_preview, {short('current_value', 80)} AS summary_preview,
 substring(current_value, 1, 50) || '...' AS progress_preview FROM items""",
        ),
        "sanitize_text": f"SELECT page_id, coalesce(trim(translate(html, {lit(UNSAFE_CHARACTERS)}, ''), {lit(BLANKS)}), '') AS clean FROM pages",
        "ddl_escape": f"SELECT page_id, coalesce({ESCAPED.format('html')}, 'NULL') AS escaped FROM pages",
        "highlight_changes": using(
            "history",
            """SELECT id, CASE WHEN old_value IS NOT DISTINCT FROM new_value THEN new_value
 ELSE '~~' || coalesce(old_value, 'None') || '~~ → **' || coalesce(new_value, 'None') || '**' END AS shown FROM history""",
        ),
        "generation_meta": using(
            "items",
            f"""SELECT id, {meta('model')} AS model, {meta('tokens_used', 'BIGINT')} AS tokens_used,
 {meta('cost_estimate', 'DOUBLE')} AS cost_estimate, {meta('error')} AS error FROM items""",
        ),
        "generation_cost": using(
            "items",
            f"""SELECT id, generation_method, tokens_used, round(tokens_used * 0.00003::DOUBLE, 8) AS cost
FROM (SELECT id, generation_method, {meta('tokens_used', 'BIGINT')} AS tokens_used FROM items) WHERE tokens_used IS NOT NULL""",
        ),
        "status_counts": using("items", "SELECT status, count(*) AS n FROM items GROUP BY status"),
        "summary_stats": using(
            "items",
            """SELECT status, count(*) AS n, false AS is_total FROM items GROUP BY status
UNION ALL SELECT 'total', count(*), true FROM items""",
        ),
        "chart_counts": using(
            "items", "SELECT status, count(*) AS n FROM items GROUP BY status HAVING count(*) > 0"
        ),
        "items_per_table": using(
            "items",
            "SELECT catalog_name, schema_name, table_name, count(*) AS column_count FROM items GROUP BY ALL",
        ),
        "avg_cost_by_method": using(
            "items",
            f"""SELECT generation_method, round(avg({meta('cost_estimate', 'DOUBLE')}), 8) AS avg_cost
FROM items WHERE generation_metadata IS NOT NULL GROUP BY generation_method""",
        ),
        "description_lengths": using(
            "items",
            """SELECT round(avg(length(current_value)), 6) AS avg_length, min(length(current_value)) AS min_length,
 max(length(current_value)) AS max_length, count(current_value) AS n FROM items""",
        ),
        "token_usage": using(
            "items",
            f"""SELECT round(avg(t), 6) AS avg_tokens, min(t) AS min_tokens, max(t) AS max_tokens, count(t) AS n
FROM (SELECT {meta('tokens_used', 'BIGINT')} AS t FROM items)""",
        ),
        "type_distribution": using(
            "items",
            "SELECT metadata_type, count(*) AS n FROM items WHERE metadata_type IS NOT NULL GROUP BY metadata_type",
        ),
        "frame_summary": using(
            "items",
            """SELECT 'total_items' AS section, CAST(NULL AS VARCHAR) AS key, count(*) AS n FROM items
UNION ALL SELECT 'unique_tables', NULL, count(DISTINCT table_name) FROM items
UNION ALL SELECT 'status', status, count(*) FROM items WHERE status IS NOT NULL GROUP BY status
UNION ALL SELECT 'metadata_type', metadata_type, count(*) FROM items WHERE metadata_type IS NOT NULL GROUP BY metadata_type
UNION ALL SELECT 'recent_activity', status, id FROM (SELECT status, id FROM items ORDER BY updated_at DESC NULLS LAST, id DESC LIMIT 5)""",
        ),
        "filter_values": using(
            "items",
            """SELECT DISTINCT 'catalog' AS kind, catalog_name AS value FROM items
UNION ALL SELECT DISTINCT 'table', table_name FROM items""",
        ),
        "filtered_count": using("items", "SELECT count(*) AS n FROM items WHERE status = 'pending'"),
        "approval_rates": using(
            "items",
            f"""SELECT generation_method, count(*) AS total, count(*) FILTER (status IN ('approved', 'edited')) AS approved,
 count(*) FILTER (status = 'pending') AS pending, {rate("count(*) FILTER (status IN ('approved', 'edited'))", 'count(*)')} AS approval_rate
FROM items GROUP BY generation_method""",
        ),
        "generation_stats": using(
            "items",
            f"""SELECT table_name, grouping(table_name) = 1 AS overall, count(*) AS total_columns, count(*) FILTER (ok) AS successful,
 count(*) FILTER (NOT ok) AS failed, {rate('count(*) FILTER (ok)', 'count(*)')} AS success_rate,
 (epoch_us(max(updated_at)) - epoch_us(min(created_at))) / 1e6 AS duration
FROM (SELECT *, {meta('error')} IS NULL AS ok FROM items) GROUP BY ROLLUP (table_name)""",
        ),
        "cost_extrapolation": using(
            "items",
            f"""SELECT round(sum(cost) / count(*) * 200, 6) AS estimated_total_cost, round(sum(cost) / count(*), 6) AS avg_cost,
 CAST(sum(tokens) * 200 // count(*) AS BIGINT) AS estimated_tokens, count(*) AS sampled
FROM ({NEWEST_META} 10) HAVING sum(cost) > 0""",
        ),
        "cost_total": using(
            "items",
            f"""SELECT round(sum(cost), 6) AS total_cost, round(sum(cost) / 200, 6) AS avg_cost, CAST(sum(tokens) AS BIGINT) AS total_tokens
FROM ({NEWEST_META} 200) HAVING sum(cost) > 0""",
        ),
        "recent_quality": using(
            "items",
            f"""SELECT round(avg(length(generated_value)), 6) AS avg_length, min(length(generated_value)) AS min_length,
 max(length(generated_value)) AS max_length, round(avg(tokens), 6) AS avg_tokens, min(tokens) AS min_tokens, max(tokens) AS max_tokens
FROM (SELECT generated_value, {meta('tokens_used', 'BIGINT')} AS tokens FROM items WHERE schema_name = 'en'
 ORDER BY created_at DESC NULLS FIRST, id DESC LIMIT 200)""",
        ),
        "current_items": using(
            "items history",
            """SELECT i.id, coalesce(h.new_value, i.current_value) AS current_value, coalesce(h.action, i.status) AS status,
 coalesce(h.timestamp, i.updated_at) AS updated_at, CASE WHEN h.id IS NULL THEN i.reviewed_by ELSE h.user_name END AS reviewed_by,
 coalesce(h.timestamp, i.reviewed_at) AS reviewed_at
FROM items i LEFT JOIN (SELECT * FROM history WHERE action IN ('approved', 'edited', 'rejected') AND new_value IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY metadata_item_id ORDER BY timestamp DESC, id DESC) = 1) h ON h.metadata_item_id = i.id""",
        ),
        "apply_reviews": using(
            "items acceptable",
            """SELECT i.id, coalesce(a.new_value, i.current_value) AS current_value, coalesce(a.status, i.status) AS status,
 coalesce(a.ts, i.updated_at) AS updated_at, CASE WHEN a.action_id IS NULL THEN i.reviewed_by ELSE a.reviewed_by END AS reviewed_by,
 coalesce(a.ts, i.reviewed_at) AS reviewed_at FROM items i LEFT JOIN latest a ON a.item_id = i.id""",
            latest=LATEST,
        ),
        "review_audit_rows": using(
            "items acceptable",
            audit_rows("acceptable", "(SELECT max(id) FROM history)"),
        ),
        "review_audit_of_odd_ids": using(
            "items odd_actions",
            audit_rows(
                "(SELECT * FROM odd_actions WHERE status IN ('approved', 'edited', 'rejected') AND item_id IS NOT NULL "
                "AND new_value IS NOT NULL)",
                "0",
            ),
        ),
        "rejected_reviews": using(
            "items actions",
            """SELECT action_id, item_id, status, CASE WHEN item_id IS NULL THEN 'missing item' WHEN new_value IS NULL THEN 'missing value'
 WHEN status NOT IN ('approved', 'edited', 'rejected') THEN 'invalid status' ELSE 'unknown item' END AS reason FROM actions
WHERE item_id IS NULL OR new_value IS NULL OR status NOT IN ('approved', 'edited', 'rejected') OR item_id NOT IN (SELECT id FROM items)""",
        ),
        "unknown_reviews": using(
            "items acceptable",
            "SELECT action_id, item_id FROM acceptable WHERE item_id NOT IN (SELECT id FROM items)",
        ),
        "latest_action": using("acceptable", LATEST),
        "table_row_counts": counts_of([*STAR, "documents"]),
        "column_samples": f"SELECT table_name, column_name, array_to_string(samples, ' | ') AS samples FROM ({SAMPLES}) WHERE len(samples) > 0",
        "table_sample": " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, row_no, '{c}' AS column_name, {cell(c)} AS value FROM {first_rows(t)}"
            for t, cs in {**STAR, "documents": DOCUMENTS}.items()
            for c, _ in cs
        ),
        "sample_json": f"{ROWS_JSON} UNION ALL {rows_json('documents', DOCUMENTS)}",
        "schema_preview": f"SELECT n.table_name, n.row_count, p.column_count, p.columns_text FROM ({counts_of(list(STAR))}) n JOIN ({PREVIEW}) p USING (table_name)",
        "generation_inputs": f"""SELECT c.table_name, c.ordinal, c.column_name, c.data_type, array_to_string(s.samples, ' | ') AS samples
FROM ({COLUMNS}) c LEFT JOIN ({SAMPLES}) s USING (table_name, column_name)""",
        "table_generation_inputs": f"""SELECT table_name, row_count, column_count, columns_text,
 array_to_string(row_samples, chr(10)) AS row_samples FROM ({TABLE_PROMPTS})""",
        "column_prompts": f"SELECT table_name, column_name, prompt FROM ({COLUMN_PROMPTS})",
        "table_prompts": f"SELECT table_name, prompt FROM ({TABLE_PROMPTS})",
        "generated_descriptions": using(
            "items",
            """SELECT id, CASE WHEN coalesce(column_name, '') = '' THEN 'Records of ' || replace(table_name, '_', ' ') || '.'
 ELSE 'The ' || replace(column_name, '_', ' ') || ' of each ' || replace(table_name, '_', ' ') || ' record.' END AS description,
 'template' AS model, 0::BIGINT AS tokens_used FROM items""",
        ),
        "generation_fallback": using(
            "items",
            f"""SELECT id, CASE WHEN error IS NULL THEN trim(generated_value) WHEN column_name <> '' THEN 'Auto-generated description for ' || column_name
 ELSE 'Auto-generated description for ' || table_name || ' table' END AS generated_value, error, tokens,
 CASE WHEN error IS NULL THEN '{STAMP}' END AS timestamp
FROM (SELECT *, {meta('error')} AS error, {meta('tokens_used', 'BIGINT')} AS tokens FROM items)""",
        ),
        "generate_column_items": f"""SELECT 'main' AS catalog_name, 'default' AS schema_name, table_name, column_name, 'description' AS metadata_type,
 'The ' || replace(column_name, '_', ' ') || ' of each ' || table_name || ' record.' AS generated_value,
 'The ' || replace(column_name, '_', ' ') || ' of each ' || table_name || ' record.' AS current_value, 'pending' AS status,
 'openai_template' AS generation_method, prompt AS generation_prompt, {record()} AS generation_metadata,
 CASE WHEN len(samples) > 0 THEN CAST(to_json(samples) AS VARCHAR) END AS data_sample, {ITEM_TAIL},
 'ai_bulk_generator' AS created_by FROM ({COLUMN_PROMPTS})""",
        "generate_table_items": f"""SELECT 'main' AS catalog_name, 'default' AS schema_name, table_name, CAST(NULL AS VARCHAR) AS column_name,
 'description' AS metadata_type, 'Records of ' || table_name || '.' AS generated_value, 'Records of ' || table_name || '.' AS current_value,
 'pending' AS status, 'openai_template' AS generation_method, prompt AS generation_prompt,
 {record("',\"column_count\":' || column_count || ',\"row_count\":' || row_count")} AS generation_metadata,
 CASE WHEN len(row_samples) > 0 THEN '[' || array_to_string(row_samples, ',') || ']' END AS data_sample, {ITEM_TAIL},
 'ai_table_generator' AS created_by FROM ({TABLE_PROMPTS})""",
        "upload_summary": using(
            "upload",
            """SELECT count(*) AS total_rows, count(DISTINCT table_name) AS unique_tables, count(DISTINCT metadata_type) AS metadata_types FROM upload""",
        ),
        "upload_null_check": using(
            "upload",
            " UNION ALL ".join(
                f"SELECT '{n}' AS column_name, count(*) FILTER ({n} IS NULL) AS missing FROM upload"
                for n in REQUIRED
            ),
        ),
        "upload_invalid_types": using(
            "upload",
            "SELECT DISTINCT metadata_type FROM upload WHERE metadata_type IS NULL OR metadata_type NOT IN ('comment', 'description')",
        ),
        "value_validation": using(
            "items",
            f"SELECT id, message IS NULL AS valid, message FROM (SELECT id, {value_message('generated_value')} AS message FROM items)",
        ),
        "upload_value_validation": using(
            "upload",
            f"""SELECT schema_name, table_name, column_name, metadata_type, generated_value,
 {value_message('generated_value')} AS message FROM upload""",
        ),
        "store_constraints": using(
            "upload",
            """SELECT schema_name, generated_value AS table_name, nullif(concat_ws('; ',
 CASE WHEN catalog_name IS NULL THEN 'catalog_name is missing' END, CASE WHEN schema_name IS NULL THEN 'schema_name is missing' END,
 CASE WHEN generated_value IS NULL THEN 'table_name is missing' END, CASE WHEN metadata_type IS NULL THEN 'metadata_type is missing' END,
 CASE WHEN generated_value IS NULL THEN 'generated_value is missing' END, CASE WHEN generated_value IS NULL THEN 'current_value is missing' END,
 CASE WHEN length(generated_value) > 255 THEN 'table_name is longer than 255' END), '') AS store_error FROM upload""",
        ),
        "upload_report": using(
            "upload",
            f"""SELECT message, count(*) AS n_rows, false AS valid, 'all' AS part
FROM (SELECT unnest({UPLOAD_ERRORS}) AS message FROM upload) GROUP BY message
UNION ALL SELECT 'Validation successful', count(*), true, 'accepted' FROM upload WHERE len({UPLOAD_ERRORS}) = 0""",
        ),
        "upload_accepted": using("upload", f"SELECT * FROM upload WHERE len({UPLOAD_ERRORS}) = 0"),
        "upload_rejected": using(
            "upload",
            f"SELECT *, array_to_string({UPLOAD_ERRORS}, '; ') AS message FROM upload WHERE len({UPLOAD_ERRORS}) > 0",
        ),
        "upload_items": using(
            "upload",
            f"""SELECT catalog_name, schema_name, table_name, column_name, metadata_type, generated_value, generated_value AS current_value,
 'pending' AS status, CAST(NULL AS VARCHAR) AS generation_method, CAST(NULL AS VARCHAR) AS generation_prompt,
 CAST(NULL AS VARCHAR) AS generation_metadata, CAST(NULL AS VARCHAR) AS data_sample, {ITEM_TAIL}, 'data_team' AS created_by
FROM upload WHERE len({UPLOAD_ERRORS}) = 0""",
        ),
        "upload_outcome": using(
            "upload",
            f"""SELECT count(*) AS total, count(*) FILTER (len({UPLOAD_ERRORS}) = 0) AS accepted,
 count(*) FILTER (len({UPLOAD_ERRORS}) > 0) AS failed FROM upload""",
        ),
        "import_valid_tables": using(
            "approved live_tables",
            """SELECT id, schema_name, table_name FROM approved a WHERE EXISTS (SELECT 1 FROM live_tables t
 WHERE t.schema_name = a.schema_name AND t.table_name = a.table_name)""",
        ),
        "import_missing_tables": using(
            "approved live_tables",
            """SELECT id, schema_name, table_name FROM approved a WHERE NOT EXISTS (SELECT 1 FROM live_tables t
 WHERE t.schema_name = a.schema_name AND t.table_name = a.table_name)""",
        ),
        "import_validation_counts": using(
            "approved live_tables",
            """SELECT count(*) AS total, count(t.table_name) AS valid, count(*) - count(t.table_name) AS skipped
FROM approved a LEFT JOIN live_tables t USING (catalog_name, schema_name, table_name)""",
        ),
        "column_ddl_plan": using(
            "approved",
            f"SELECT id, {column_statement('current_value')} AS statement FROM approved WHERE {COLUMN_LEVEL}",
        ),
        "table_ddl_plan": using(
            "approved",
            f"SELECT id, {table_statement('current_value')} AS statement FROM approved WHERE {TABLE_LEVEL}",
        ),
        "import_preview": using(
            "approved",
            f"""SELECT id, {column_statement('current_value')} AS statement FROM approved JOIN ({POSITIONS}) USING (id) WHERE position <= 5""",
        ),
        "import_dry_run": using(
            "approved",
            f"""SELECT id, catalog_name, schema_name, table_name, column_name, {short('current_value', 100)} AS description, true AS success,
 'DRY RUN: Would execute - ' || {column_statement('current_value')} AS message FROM approved WHERE {COLUMN_LEVEL}""",
        ),
        "import_batches": using(
            "approved",
            f"SELECT id, position, (position - 1) // 50 + 1 AS batch_no FROM ({POSITIONS})",
        ),
        "import_history_rows": using(
            "import_results",
            f"""SELECT (SELECT max(id) FROM history) + row_number() OVER (ORDER BY id, CASE WHEN success THEN 'imported' ELSE 'import_failed' END,
 message NULLS FIRST) AS id, id AS metadata_item_id, CASE WHEN success THEN 'imported' ELSE 'import_failed' END AS action,
 CAST(NULL AS VARCHAR) AS old_value, CAST(NULL AS VARCHAR) AS new_value, message AS comment, 'bulk_importer' AS user_name,
 {AS_OF} AS timestamp FROM import_results""",
        ),
        "import_failures": using("import_results", "SELECT * FROM import_results WHERE NOT success"),
        "import_stats": using(
            "import_results",
            f"""SELECT *, CASE WHEN success_rate = 100 THEN 'full' WHEN success_rate > 0 THEN 'partial' ELSE 'none' END AS outcome
FROM (SELECT catalog_name, schema_name, table_name, count(*) AS total_columns, count(*) FILTER (success) AS successful_columns,
 {rate('count(*) FILTER (success)', 'count(*)')} AS success_rate FROM import_results GROUP BY catalog_name, schema_name, table_name)""",
        ),
        "import_totals": using(
            "import_results",
            f"""SELECT count(*) AS total, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed,
 {rate('count(*) FILTER (success)', 'count(*)')} AS success_rate FROM import_results""",
        ),
        "import_retry_set": using(
            "approved history",
            """SELECT id, table_name, status FROM approved WHERE id NOT IN
 (SELECT metadata_item_id FROM history WHERE action = 'imported')""",
        ),
        "verify_columns": using(
            "approved live_columns",
            f"""SELECT a.id, a.catalog_name || '.' || a.schema_name || '.' || a.table_name || '.' || a.column_name AS full_name,
 c.column_name IS NOT NULL AS found, c.comment AS actual, a.current_value IS NOT DISTINCT FROM c.comment AS matches
FROM (SELECT * FROM approved WHERE {COLUMN_LEVEL}) a
LEFT JOIN live_columns c USING (catalog_name, schema_name, table_name, column_name)""",
        ),
        "verify_tables": using(
            "approved live_descriptions",
            f"""SELECT a.id, a.catalog_name || '.' || a.schema_name || '.' || a.table_name AS full_name,
 d.table_name IS NOT NULL AS found, d.comment AS actual, a.current_value IS NOT DISTINCT FROM d.comment AS matches
FROM (SELECT * FROM approved WHERE {TABLE_LEVEL}) a LEFT JOIN live_descriptions d USING (catalog_name, schema_name, table_name)""",
        ),
        "rollback_plan": using(
            "approved",
            f"""SELECT id, CASE WHEN column_name <> '' THEN {column_statement("coalesce(original_value, '')")}
 WHEN original_value IS NULL THEN 'ALTER TABLE ' || {TABLE_IDENT} || ' ' || chr(10) || 'UNSET TBLPROPERTIES (''comment'');'
 ELSE {table_statement('original_value')} END AS statement FROM approved""",
        ),
        "stream_latest_action": using("acceptable", LATEST),
        "stream_status_counts": using(
            "acceptable", f"SELECT status, count(*) AS n FROM ({LATEST}) GROUP BY status"
        ),
    }
