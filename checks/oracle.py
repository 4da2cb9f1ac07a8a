"""DuckDB SQL for the registered queries, written from the rules and not from the Spark code.

Only the fixed values (texts, words, patterns) are shared.
"""

from checks.queries import MANIFESTS, MODELS, PRICES, PRODUCT
from checks.views import duckdb_with
from metadoc import fixed_values as fv
from metadoc.functions.text import WHITESPACE

SQL = {}


def text(value):
    """A SQL text literal."""
    return "'" + value.replace("'", "''") + "'"


WS = text(WHITESPACE)


def strip(expression):
    return f"trim({expression}, {WS})"


def fill(template, **columns):
    """SQL that concatenates the template with expressions in place of its names."""
    marks = {name: f"\x00{name}\x00" for name in columns}
    pieces = template.format(**marks).split("\x00")
    return "(" + " || ".join(
        columns[piece] if at % 2 else text(piece)
        for at, piece in enumerate(pieces) if at % 2 or piece
    ) + ")"


def digest(expression, name):
    return f"CAST(length({expression}) AS INTEGER) AS {name}_chars, md5({expression}) AS {name}_md5"


def oracle(name, views, select, more=()):
    SQL[name] = duckdb_with(views, more) + "\n" + select


# --- scope and metadata ---------------------------------------------------------------------

TARGETS = ("targets", f"""
    SELECT DISTINCT {strip('catalog_name')} AS catalog_name, {strip('schema_name')} AS schema_name,
           {strip('table_name')} AS table_name
    FROM v_scope WHERE {strip('catalog_name')} <> '' AND {strip('schema_name')} <> ''
                   AND {strip('table_name')} <> ''""")

COLUMNS = ("meta", f"""
    SELECT catalog_name, schema_name, table_name, pos AS position, {strip('col_name')} AS column_name,
           {strip('data_type')} AS data_type,
           coalesce((SELECT {strip('c.data_type')} FROM v_described c
                     WHERE c.catalog_name = r.catalog_name AND c.schema_name = r.schema_name
                       AND c.table_name = r.table_name AND {strip('c.col_name')} = 'Comment'
                     ORDER BY c.pos DESC LIMIT 1), '') AS table_comment
    FROM v_described r
    WHERE pos < (SELECT min(e.pos) FROM v_described e
                 WHERE e.catalog_name = r.catalog_name AND e.schema_name = r.schema_name
                   AND e.table_name = r.table_name
                   AND ({strip('e.col_name')} = '' OR {strip('e.col_name')} LIKE '#%'))""")

KEY3 = "catalog_name, schema_name, table_name"

oracle("scope_targets", ["v_scope"], f"SELECT {KEY3} FROM targets", [TARGETS])
oracle("scope_totals", ["v_scope"], """
    SELECT count(DISTINCT catalog_name) AS catalogs,
           count(DISTINCT (catalog_name, schema_name)) AS schemas,
           count(DISTINCT (catalog_name, schema_name, table_name)) AS tables FROM targets""", [TARGETS])
oracle("schema_targets", ["v_scope"], "SELECT DISTINCT catalog_name, schema_name FROM targets", [TARGETS])
oracle("describe_cut", ["v_described"], "SELECT * FROM meta", [COLUMNS])
oracle("scope_found", ["v_scope", "v_described"],
       f"SELECT meta.* FROM meta JOIN targets USING ({KEY3})", [TARGETS, COLUMNS])
oracle("scope_missing", ["v_scope", "v_described"],
       f"SELECT {KEY3} FROM targets EXCEPT SELECT {KEY3} FROM meta", [TARGETS, COLUMNS])
oracle("columns_per_schema", ["v_described"], """
    SELECT catalog_name, schema_name, count(DISTINCT table_name) AS tables, count(*) AS columns
    FROM meta GROUP BY ALL""", [COLUMNS])

TABLE_NAMES = ("names_per_schema", """
    SELECT catalog_name, schema_name, array_to_string(list_sort(list(DISTINCT table_name))[1:30], ', ')
           AS tables FROM meta GROUP BY catalog_name, schema_name""")
oracle("tables_per_schema", ["v_described"], "SELECT * FROM names_per_schema", [COLUMNS, TABLE_NAMES])

# --- sources ------------------------------------------------------------------------------------

EXT = r"lower(regexp_extract(name, '[^./][^/]*(\.[^./]*)$', 1))"


def hint_list(pattern):
    found = f"regexp_extract(description, {text(pattern)}, 1, 'i')"
    item = f"trim({strip('x')}, '\"''`')"
    return f"[{item} FOR x IN string_split({found}, ',') IF {strip('x')} <> '']"


oracle("valid_fqn", ["v_sources"], """
    SELECT ord, name, len(string_split(name, '.')) = 3 AS three_part FROM v_sources""")
oracle("source_ext", ["v_sources"], f"SELECT ord, {EXT} AS ext FROM v_sources")
oracle("source_hints", ["v_sources"], f"""
    SELECT ord, array_to_string({hint_list(fv.HINT_TABS_PATTERN)}, '|') AS tabs,
           array_to_string({hint_list(fv.HINT_COLUMNS_PATTERN)}, '|') AS columns FROM v_sources""")

oracle("manifest_entries", ["v_manifests"], f"""
    SELECT manifest, position, section AS kind, name, md5(description) AS description_md5,
           array_to_string({hint_list(fv.HINT_TABS_PATTERN)}, '|') AS tabs
    FROM (SELECT manifest, position, section, line,
                 {strip("trim(" + strip("split_part(line, ':', 1)") + ", '`')")} AS name,
                 {strip("substr(line, position(':' IN line) + 1)")} AS description FROM placed)
    WHERE NOT starts_with(line, '#') AND section <> '' AND contains(line, ':') AND name <> ''
      AND description <> ''
      AND CASE section WHEN 'archivo' THEN contains(name, '.')
                       ELSE len(string_split(name, '.')) = 3 END""", [
    ("lines", f"""
        SELECT manifest, {strip('line')} AS line, line_no
        FROM (SELECT manifest, unnest(string_split(text, chr(10))) AS line,
                     CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS line_no
              FROM v_manifests)"""),
    ("marked", """
        SELECT *, CASE WHEN starts_with(line, '#') THEN
                   CASE WHEN contains(lower(ltrim(line, '#')), 'archivo') THEN 'archivo'
                        WHEN contains(lower(ltrim(line, '#')), 'tabla') THEN 'tabla' ELSE '' END END AS mark
        FROM lines"""),
    ("carried", """
        SELECT *, last_value(mark IGNORE NULLS) OVER w AS section, count(mark) OVER w AS headings
        FROM marked WINDOW w AS (PARTITION BY manifest ORDER BY line_no
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""),
    # Sections are numbered from 0; text ahead of the first heading is one as well.
    ("placed", """
        SELECT *, (headings - 1 + CASE WHEN bool_or(line_no = 0 AND mark IS NULL) OVER (
                       PARTITION BY manifest) THEN 1 ELSE 0 END) * 67108864
                  + line_no - min(line_no) OVER (PARTITION BY manifest, headings) AS position
        FROM carried"""),
])

oracle("sources_merged", ["v_entries"], f"""
    SELECT min(ord) AS ord, name, arg_max(description, ord) AS description,
           arg_max(manifest, ord) AS manifest, {digest('arg_max(content, ord)', 'content')}
    FROM v_entries GROUP BY name""")
oracle("context_table_text", [], """
    SELECT 'p_partkey | p_brand | p_type' || chr(10) || string_agg(line, chr(10) ORDER BY p_partkey)
           AS content FROM first_rows""", [("first_rows", """
    SELECT p_partkey, p_partkey || ' | ' || p_brand || ' | ' || p_type AS line
    FROM part ORDER BY p_partkey LIMIT 200""")])
oracle("delimited_text", [], f"""
    SELECT brand, {digest('content', 'content')}
    FROM (SELECT brand, 'p_partkey | p_name | p_brand | p_type | p_size | p_retailprice' || chr(10) ||
                 string_agg(CASE WHEN n > 200 AND nth = 100 THEN line || chr(10) || '...' ELSE line END,
                            chr(10) ORDER BY nth) AS content
          FROM numbered WHERE n <= 200 OR nth <= 100 OR nth > n - 100 GROUP BY brand)""",
       [("numbered", """
    SELECT p_brand AS brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS nth,
           count(*) OVER (PARTITION BY p_brand) AS n,
           p_partkey || ' | ' || p_name || ' | ' || p_brand || ' | ' || p_type || ' | ' || p_size ||
           ' | ' || p_retailprice AS line FROM part""")])

oracle("text_file_content", [], f"""
    SELECT conv_id, {digest('content', 'content')}
    FROM (SELECT conv_id, string_agg(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))
                                     || chr(10), '' ORDER BY turn) AS content
          FROM turns_all GROUP BY conv_id)""", [("turns_all", "SELECT * FROM conversations")])

SIZES = ("sizes", """
    SELECT schema_name, table_name, count(*) AS row_count,
           CASE WHEN count(*) <= 500 THEN count(*)
                ELSE greatest(CAST(floor(count(*) * 10 / 100.0) AS BIGINT), 1) END AS sample_size
    FROM v_rows GROUP BY schema_name, table_name""")
DRAWN = ("drawn", """
    SELECT schema_name, table_name, row_count, sample_size, nth, line FROM (
        SELECT schema_name, table_name,
               row_number() OVER (PARTITION BY schema_name, table_name
                                  ORDER BY md5(o_orderkey || ':42'), o_orderkey) AS nth,
               o_orderkey || ' | ' || o_orderstatus || ' | ' || o_orderpriority || ' | ' ||
               o_totalprice || ' | ' || o_orderdate AS line FROM v_rows)
    JOIN sizes USING (schema_name, table_name) WHERE nth <= least(sample_size, 30)""")
SAMPLES = ("samples", """
    SELECT schema_name, table_name,
           'o_orderkey | o_orderstatus | o_orderpriority | o_totalprice | o_orderdate' || chr(10) ||
           string_agg(line, chr(10) ORDER BY nth) AS sample
    FROM drawn GROUP BY schema_name, table_name""")
oracle("sample_size", ["v_rows"], "SELECT * FROM sizes", [SIZES])
oracle("table_sample", ["v_rows"], "SELECT * FROM drawn", [SIZES, DRAWN])
oracle("sample_text", ["v_rows"],
       f"SELECT schema_name, table_name, {digest('sample', 'sample')} FROM samples",
       [SIZES, DRAWN, SAMPLES])

# --- relevance and context ----------------------------------------------------------------------


def static_score(words):
    points = " + ".join(
        f"CASE WHEN contains(lower(description), '{word}') THEN 1.0 ELSE 0.0 END" for word in words
    )
    return f"""CAST(1.0 + CASE WHEN kind = 'tabla' THEN 4.0 WHEN {EXT} = '.docx' THEN 3.0
        WHEN {EXT} = '.tsv' THEN 2.0 WHEN {EXT} IN ('.md', '.txt') THEN 1.5 ELSE 0.0 END
        + {points} AS DOUBLE)"""


def scored(words):
    header = fill(fv.SOURCE_HEADER, label="CASE WHEN kind = 'tabla' THEN 'Tabla' ELSE 'Insumo' END",
                  name="name", description="description")
    return ("scored", f"""
        SELECT ord, {static_score(words)} AS static, {header} AS header, content,
               CAST(length({header}) + length(content) AS BIGINT) AS size,
               lower(description || ' ' || name || ' ' || substr(content, 1, 500)) AS haystack
        FROM v_sources""")


def packed(objects):
    """Every object against every source, then rank and budget."""
    return [
        ("keys", f"""SELECT DISTINCT lower(schema_name) AS schema_key,
                            lower(coalesce(table_name, '')) AS table_key FROM {objects}"""),
        ("pairs", """
            SELECT schema_key, table_key, ord, header, content, size,
                   static + CASE WHEN schema_key <> '' AND contains(haystack, schema_key)
                                 THEN 10 ELSE 0 END
                          + CASE WHEN table_key <> '' AND contains(haystack, table_key)
                                 THEN 15 ELSE 0 END AS score
            FROM keys CROSS JOIN scored"""),
        ("ranked", """
            SELECT *, row_number() OVER w AS rank,
                   CAST(coalesce(sum(size) OVER (
                        PARTITION BY schema_key, table_key ORDER BY score DESC, ord
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
            FROM pairs WINDOW w AS (PARTITION BY schema_key, table_key ORDER BY score DESC, ord)"""),
        ("packed", """
            SELECT *, CASE WHEN before + size > 30000
                           THEN 30000 - before - length(header) - 50 END AS taken,
                   before + size <= 30000 OR 30000 - before - length(header) - 50 > 500 AS used
            FROM ranked WHERE before <= 30000"""),
        ("context_of", """
            SELECT schema_key, table_key,
                   coalesce(string_agg(header || CASE WHEN taken IS NULL THEN content
                       ELSE substr(content, 1, taken) || chr(10) || '[... contenido truncado]' END,
                       chr(10) ORDER BY rank) FILTER (WHERE used), '') AS context
            FROM packed GROUP BY schema_key, table_key"""),
    ]


CONTEXTS = [scored(fv.GENERATOR_KEYWORDS), *packed("v_objects")]

oracle("source_scores", ["v_sources"], f"""
    SELECT ord, {static_score(fv.GENERATOR_KEYWORDS)} AS generator_score,
           {static_score(fv.AUDITOR_KEYWORDS)} AS auditor_score FROM v_sources""")
oracle("relevance_pairs", ["v_sources", "v_objects"], """
    SELECT name, ord, is_schema, is_table, static, size
    FROM (SELECT name, bool_or(is_schema) AS is_schema, bool_or(NOT is_schema) AS is_table
          FROM (SELECT lower(schema_name) AS name, true AS is_schema FROM v_objects
                UNION ALL SELECT lower(table_name), false FROM v_objects)
          WHERE name <> '' GROUP BY name)
    JOIN scored ON contains(haystack, name)""", [scored(fv.GENERATOR_KEYWORDS)])
oracle("relevance_rank", ["v_sources", "v_objects"],
       "SELECT schema_key, table_key, rank, ord, score FROM packed",
       [scored(fv.AUDITOR_KEYWORDS), *packed("v_objects")])
oracle("context_budget", ["v_sources", "v_objects"], """
    SELECT schema_key, table_key, rank, ord, score, before, size, CAST(taken AS BIGINT) AS taken, used
    FROM packed""", CONTEXTS)
oracle("context_text", ["v_sources", "v_objects"],
       f"SELECT schema_key, table_key, {digest('context', 'context')} FROM context_of", CONTEXTS)

# --- prompts ------------------------------------------------------------------------------------

PARENTS = [
    ("schema_notes", """
        SELECT catalog_name, schema_name, schema_comment AS existing,
               CASE WHEN catalog_name <> 'EUROPE'
                    THEN 'Definición generada de ' || schema_name END AS generated
        FROM v_schema_comments"""),
    ("children", f"""
        SELECT {KEY3}, position, column_name, data_type,
               coalesce(CASE WHEN existing <> '' THEN existing ELSE generated END, '') AS schema_comment,
               CASE WHEN table_name IN ('BUILDING', 'HOUSEHOLD') THEN 'Tabla generada ' || table_name
                    ELSE table_comment END AS table_comment
        FROM meta LEFT JOIN schema_notes USING (catalog_name, schema_name)"""),
]
PROMPT_VIEWS = ["v_described", "v_schema_comments", "v_objects", "v_sources", "v_rows"]
PROMPT_PARTS = [COLUMNS, TABLE_NAMES, *PARENTS, *CONTEXTS, SIZES, DRAWN, SAMPLES]
SAMPLE_NOTE = "CASE WHEN sample <> '' THEN " + fill(
    fv.SAMPLE_NOTE, sample="substr(sample, 1, 3000)") + " ELSE '' END"


def present(value, note):
    return f"CASE WHEN {value} <> '' THEN {note} ELSE '' END"


oracle("child_context", ["v_described", "v_schema_comments"], "SELECT * FROM children",
       [COLUMNS, *PARENTS])
oracle("effective_comment", ["v_schema_comments"], """
    SELECT catalog_name, schema_name,
           coalesce(CASE WHEN existing <> '' THEN existing ELSE generated END, '') AS for_tables,
           coalesce(CASE WHEN generated <> '' THEN generated ELSE existing END, '') AS generated_first
    FROM schema_notes""", PARENTS[:1])
oracle("prompts_schema", PROMPT_VIEWS, f"""
    SELECT catalog_name, schema_name, {digest('prompt', 'prompt')} FROM (
        SELECT catalog_name, schema_name,
               {fill(fv.SCHEMA_PROMPT, context='context', schema='schema_name', tables='tables')} AS prompt
        FROM names_per_schema JOIN context_of
          ON schema_key = lower(schema_name) AND table_key = '')""", PROMPT_PARTS)
oracle("prompts_table", PROMPT_VIEWS, f"""
    SELECT {KEY3}, {digest('prompt', 'prompt')} FROM (
        SELECT DISTINCT {KEY3}, {fill(
            fv.TABLE_PROMPT, context='context', table='table_name',
            schema_note=present('schema_comment', fill(fv.TABLE_SCHEMA_NOTE, schema='schema_name',
                                                       schema_comment='schema_comment')),
            sample_note=SAMPLE_NOTE)} AS prompt
        FROM children JOIN context_of
          ON schema_key = lower(schema_name) AND table_key = lower(table_name)
        LEFT JOIN samples USING (schema_name, table_name))""", PROMPT_PARTS)
NOTES = "(" + present("schema_comment", fill(fv.COLUMN_SCHEMA_NOTE, schema_comment="schema_comment")) + \
    " || " + present("table_comment", fill(fv.COLUMN_TABLE_NOTE, table="table_name",
                                           table_comment="table_comment")) + ")"
oracle("prompts_column", PROMPT_VIEWS, f"""
    SELECT {KEY3}, column_name, {digest('prompt', 'prompt')} FROM (
        SELECT {KEY3}, column_name, {fill(
            fv.COLUMN_PROMPT, context='context', table='table_name', column='column_name',
            data_type='data_type', sample_note=SAMPLE_NOTE,
            parent_notes='(notes || ' + present('notes', 'chr(10)') + ')')} AS prompt
        FROM (SELECT *, {NOTES} AS notes FROM children) JOIN context_of
          ON schema_key = lower(schema_name) AND table_key = lower(table_name)
        LEFT JOIN samples USING (schema_name, table_name))""", PROMPT_PARTS)

EVALUATION = ("asked", f"""
    SELECT *, {fill(
        fv.EVALUATION_PROMPT, context="coalesce(context_text, '')",
        level_label="CASE object_level WHEN 'schema' THEN 'esquema' WHEN 'table' THEN 'tabla' "
                    "ELSE 'columna' END",
        max_chars="CASE object_level WHEN 'column' THEN '300' ELSE '400' END")} AS prompt
    FROM v_golden""")
oracle("prompts_evaluation", ["v_golden"],
       f"SELECT object_id, {digest('prompt', 'prompt')} FROM asked", [EVALUATION])
KEYS = [name.lower() for name, _ in fv.CRITERIA]
CRITERIA = "\n".join(
    str(at + 1) + ". " + name + ": " + rule.replace("{manifests}", " / ".join(MANIFESTS))
    for at, (name, rule) in enumerate(fv.CRITERIA))
oracle("prompts_judge", ["v_golden"], f"""
    SELECT object_id, {digest('prompt', 'prompt')} FROM (
        SELECT object_id, {fill(
            fv.JUDGE_PROMPT, catalog_product=text(PRODUCT), criteria=text(CRITERIA),
            context="substr(context_text, 1, 30000)", level="object_level",
            comment="coalesce(gold_comment, 'Objeto ' || object_id)", keys=text(", ".join(KEYS)),
            example=text(", ".join(f'"{k}": 1' for k in KEYS)))} AS prompt FROM v_golden)""")

LEVEL = """CASE WHEN nombre_tabla = '__esquema__' AND nombre_columna = '__esquema__' THEN 'schema'
                WHEN nombre_columna = '__tabla__' THEN 'table' ELSE 'column' END"""
LEVEL_LABEL = "CASE level WHEN 'schema' THEN 'esquema' WHEN 'table' THEN 'tabla' ELSE 'columna' END"


def quoted(*names):
    return " || '.' || ".join(
        f"'`' || replace(coalesce({name}, ''), '`', '``') || '`'" for name in names)


N = ("nombre_catalogo", "nombre_esquema", "nombre_tabla", "nombre_columna")
oracle("prompts_audit", ["v_results", "v_sources"], f"""
    SELECT id_resultado, {digest('prompt', 'prompt')} FROM (
        SELECT id_resultado, {fill(
            fv.AUDIT_PROMPT, criteria=text(CRITERIA), context="context",
            level_label=LEVEL_LABEL, comment="coalesce(comentario, '')",
            target=f"CASE level WHEN 'schema' THEN 'Esquema ' || {quoted(*N[:2])} "
                   f"WHEN 'table' THEN 'Tabla ' || {quoted(*N[:3])} ELSE 'Columna ' || {quoted(*N)} END")}
            AS prompt
        FROM audited JOIN context_of
          ON schema_key = lower(schema_name) AND table_key = lower(table_name))""", [
    ("audited", f"""
        SELECT *, nombre_esquema AS schema_name,
               CASE level WHEN 'schema' THEN '' ELSE nombre_tabla END AS table_name
        FROM (SELECT *, {LEVEL} AS level FROM v_results)"""),
    scored(fv.AUDITOR_KEYWORDS), *packed("audited")])

oracle("prompt_response", ["v_golden"], """
    SELECT object_id, sha256(prompt) AS prompt_id,
           CASE WHEN known THEN 'respuesta ' || substr(sha256(prompt), 1, 8) END AS text,
           CASE WHEN known THEN 7 END AS tokens_in
    FROM (SELECT *, bool_or(object_level = 'table') OVER (PARTITION BY prompt) AS known FROM asked)""",
       [EVALUATION])
oracle("responder_answers", ["v_golden"], """
    SELECT object_id, sha256(prompt) AS prompt_id,
           CASE WHEN length(prompt) % 11 > 0 THEN length(prompt) || ' caracteres' ELSE '' END AS text,
           CAST(length(prompt) // 4 AS INTEGER) AS tokens_in,
           CASE WHEN length(prompt) % 11 = 0 THEN 'sin respuesta' END AS error FROM asked""",
       [EVALUATION])
oracle("responder_settings", ["v_golden"], """
    SELECT object_id, length(prompt) || ':300:0.0' AS text,
           CAST(CASE WHEN length(prompt) % 7 > 0 THEN length(prompt) ELSE 0 END AS INTEGER) AS tokens_in,
           CAST(CASE WHEN length(prompt) % 7 > 0 THEN 3 ELSE 0 END AS INTEGER) AS tokens_out, true AS timed FROM asked""",
       [EVALUATION])

# --- results ------------------------------------------------------------------------------------

TARGET = f"""CASE level WHEN 'schema' THEN 'esquema ' || c || '.' || s
                        WHEN 'table' THEN 'tabla ' || c || '.' || s || '.' || t
                        ELSE 'columna ' || c || '.' || s || '.' || t || '.' || k END"""
LEVELLED = ("levelled", f"""
    SELECT *, {LEVEL} AS level, coalesce(nombre_catalogo, 'None') AS c,
           coalesce(nombre_esquema, 'None') AS s, coalesce(nombre_tabla, 'None') AS t,
           coalesce(nombre_columna, 'None') AS k FROM v_results""")
oracle("object_level", ["v_results"], "SELECT id_resultado, level FROM levelled", [LEVELLED])
oracle("target_label", ["v_results"], f"SELECT id_resultado, {TARGET} AS target FROM levelled", [LEVELLED])
oracle("results_rows", ["v_results"], f"""
    SELECT 'run-1' AS id_ejecucion, '2026-02-03 04:05:06' AS fecha, {', '.join(N)},
           {digest('comentario', 'comentario')}, coalesce(status, 'aprobado') AS status,
           CAST(NULL AS VARCHAR) AS user_comments, CAST(NULL AS VARCHAR) AS criterio_fallido
    FROM v_results""")
oracle("assign_ids", ["v_results"], """
    SELECT id_resultado AS doc_id, status,
           1000 + row_number() OVER (ORDER BY id_resultado) AS id_resultado FROM v_results""")
oracle("results_filtered", ["v_results"], f"""
    SELECT id_resultado, {', '.join(N)} FROM v_results
    WHERE id_ejecucion = 'src1' AND status = 'aprobado'""")
oracle("results_approved", ["v_results"],
       f"SELECT id_resultado, {', '.join(N)} FROM v_results WHERE status = 'aprobado'")

LATEST = ("latest", """
    SELECT id_ejecucion, fecha_ejecucion, estado, resultado FROM (
        SELECT *, row_number() OVER (PARTITION BY id_ejecucion
                                     ORDER BY fecha_ejecucion DESC, seq DESC) AS nth
        FROM v_exec_events) WHERE nth = 1""")
oracle("execution_latest", ["v_exec_events"], """
    SELECT id_ejecucion, strftime(fecha_ejecucion, '%Y-%m-%d %H:%M:%S') AS fecha, estado, resultado
    FROM latest""", [LATEST])
oracle("execution_history", ["v_exec_events"], "SELECT id_ejecucion, estado, resultado FROM latest",
       [LATEST])


def errors(most):
    return f"""SELECT id_ejecucion, string_agg(message, '; ' ORDER BY position) AS first_errors FROM (
        SELECT *, row_number() OVER (PARTITION BY id_ejecucion ORDER BY position) AS nth
        FROM v_outcomes WHERE message IS NOT NULL) WHERE nth <= {most} GROUP BY id_ejecucion"""


oracle("first_errors", ["v_outcomes"], errors(10))
COUNTS = ", ".join(
    f"count(*) FILTER (WHERE message IS NULL AND level = '{level}') AS {name}"
    for level, name in (("schema", "schemas"), ("table", "tables"), ("column", "columns")))
SUMMARY = {n: f"CAST({n} AS VARCHAR)" for n in
           ("schemas", "tables", "columns", "errors", "scope_schemas", "scope_tables")}
oracle("run_summary", ["v_outcomes"], f"""
    SELECT id_ejecucion, schemas, tables, columns, errors,
           CASE WHEN errors > 0 THEN 'COMPLETADO_CON_ERRORES' ELSE 'COMPLETADO' END AS estado,
           CASE WHEN errors > 0 THEN {fill(fv.SUMMARY_ERRORS_TEXT, first_errors='first_errors', **SUMMARY)}
                ELSE {fill(fv.SUMMARY_OK, scope=text('main.control.scope'), **SUMMARY)} END AS resultado
    FROM (SELECT id_ejecucion, {COUNTS}, count(message) AS errors,
                 count(*) FILTER (WHERE level = 'schema') AS scope_schemas,
                 count(*) FILTER (WHERE level = 'table') AS scope_tables
          FROM v_outcomes GROUP BY id_ejecucion)
    LEFT JOIN first_five USING (id_ejecucion)""", [("first_five", errors(5))])
oracle("latest_approved", ["v_results"], f"""
    SELECT {', '.join(N)}, id_resultado, {digest('comentario', 'comentario')} FROM (
        SELECT *, row_number() OVER (PARTITION BY {', '.join(N)}
                                     ORDER BY fecha_resultado DESC, id_resultado DESC) AS nth
        FROM v_results WHERE status = 'aprobado') WHERE nth = 1""")
oracle("results_with_execution", ["v_results", "v_executions"], """
    SELECT id_resultado, r.id_ejecucion, estado, resultado, status
    FROM v_results r JOIN v_executions e ON r.id_ejecucion = e.id_ejecucion""")

# --- audit --------------------------------------------------------------------------------------

CLAIMED = [
    ("unfenced", f"""
        SELECT id_resultado, raw, CASE WHEN starts_with(raw, '```') THEN
                   CASE WHEN lower(bare) LIKE 'json%' THEN {strip('substr(bare, 5)')} ELSE bare END
               ELSE raw END AS candidate
        FROM (SELECT *, trim(raw, '`') AS bare
              FROM (SELECT id_resultado, {strip("coalesce(text, '')")} AS raw FROM v_audit_answers))"""),
    ("blocks", r"""
        SELECT id_resultado, CASE WHEN regexp_matches(candidate, '\{[^{}]*\}')
                                  THEN regexp_extract(candidate, '\{[^{}]*\}', 0) ELSE candidate END AS block
        FROM unfenced"""),
    ("parsed", """
        SELECT id_resultado, CASE WHEN json_valid(block) THEN block END AS j FROM blocks"""),
    ("claimed", f"""
        SELECT id_resultado, NOT failed AS ok,
               CASE WHEN failed THEN json_extract_string(j, '$.criterio') END AS criterio,
               CASE WHEN failed THEN nullif({strip("json_extract_string(j, '$.detalles')")}, '') END
                   AS detalles
        FROM (SELECT *, coalesce(CASE json_type(j, '$.ok')
                     WHEN 'NULL' THEN true WHEN 'BOOLEAN' THEN json_extract_string(j, '$.ok') = 'false'
                     WHEN 'VARCHAR' THEN json_extract_string(j, '$.ok') = ''
                     WHEN 'ARRAY' THEN json_array_length(j, '$.ok') = 0
                     WHEN 'OBJECT' THEN false
                     ELSE TRY_CAST(json_extract_string(j, '$.ok') AS DOUBLE) = 0 END, false) AS failed
              FROM parsed)"""),
]
KNOWN = ", ".join(text(name) for name, _ in fv.CRITERIA)
SETTLED = ("settled", f"""
    SELECT id_resultado, NOT stands AS ok, CASE WHEN stands THEN criterio END AS criterio,
           CASE WHEN stands THEN detalles END AS detalles
    FROM (SELECT *, coalesce(NOT ok AND criterio IN ({KNOWN}), false) AS stands FROM claimed)""")
oracle("verdicts", ["v_audit_answers"], "SELECT * FROM settled", [*CLAIMED, SETTLED])
oracle("verdicts_valid", ["v_audit_answers"],
       f"SELECT * FROM claimed WHERE NOT ok AND criterio IN ({KNOWN})", CLAIMED)
oracle("verdicts_unknown", ["v_audit_answers"],
       f"SELECT * FROM claimed WHERE NOT ok AND (criterio IS NULL OR criterio NOT IN ({KNOWN}))", CLAIMED)
oracle("audit_upsert", ["v_audit_answers", "v_results"], """
    SELECT r.id_resultado, r.status,
           CASE WHEN r.status = 'aprobado' THEN s.criterio ELSE r.criterio_fallido END AS criterio_fallido,
           CASE WHEN r.status = 'aprobado' THEN s.detalles ELSE r.detalles_criterio_fallido END
               AS detalles_criterio_fallido
    FROM v_results r JOIN settled s ON r.id_resultado = s.id_resultado""", [*CLAIMED, SETTLED])
oracle("audit_totals", ["v_audit_answers"], """
    SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS ok_rows,
           count(*) FILTER (WHERE NOT ok) AS observed, CAST(0 AS BIGINT) AS errors FROM settled""",
       [*CLAIMED, SETTLED])
oracle("audit_by_criterion", ["v_audit_answers"],
       'SELECT criterio, count(*) AS "rows" FROM settled WHERE NOT ok GROUP BY criterio',
       [*CLAIMED, SETTLED])

# --- review and publication -----------------------------------------------------------------

REVIEWED = ("reviewed", """
    SELECT r.id_resultado, CASE WHEN d.status <> 'quizas' THEN d.status ELSE r.status END AS status,
           CASE WHEN d.status <> 'quizas' AND d.user_comments IS NOT NULL THEN d.user_comments
                ELSE r.user_comments END AS user_comments
    FROM v_results r LEFT JOIN v_decisions d ON r.id_resultado = d.id_resultado""")
oracle("review_apply", ["v_results", "v_decisions"], "SELECT * FROM reviewed", [REVIEWED])
oracle("results_changes", ["v_results", "v_decisions"], """
    SELECT r.id_resultado,
           CASE WHEN d.status = 'rechazado' THEN 'delete' ELSE 'update' END AS change,
           CASE WHEN d.status = 'rechazado' THEN r.status ELSE w.status END AS status,
           CASE WHEN d.status = 'rechazado' THEN r.user_comments ELSE w.user_comments END AS user_comments
    FROM v_results r JOIN reviewed w ON r.id_resultado = w.id_resultado
    LEFT JOIN v_decisions d ON r.id_resultado = d.id_resultado
    WHERE d.status = 'rechazado' OR r.status IS DISTINCT FROM w.status
       OR r.user_comments IS DISTINCT FROM w.user_comments
    UNION ALL
    SELECT w.id_resultado + 10000000000, 'insert', w.status, w.user_comments
    FROM reviewed w JOIN v_decisions d ON w.id_resultado = d.id_resultado
    WHERE d.status = 'por revisar'""", [REVIEWED])

LITERAL = r"""'''' || replace(replace(coalesce(comentario, ''), '\', '\\'), '''', '''''') || ''''"""
STATEMENTS = ("statements", f"""
    SELECT id_resultado, level, {TARGET} AS target,
           CASE WHEN coalesce(nombre_catalogo, '') = '' THEN NULL
                WHEN level = 'schema' THEN 'COMMENT ON SCHEMA ' || {quoted(*N[:2])} || ' IS ' || {LITERAL}
                WHEN level = 'table' THEN 'COMMENT ON TABLE ' || {quoted(*N[:3])} || ' IS ' || {LITERAL}
                ELSE 'ALTER TABLE ' || {quoted(*N[:3])} || ' ALTER COLUMN ' || {quoted(N[3])} ||
                     ' COMMENT ' || {LITERAL} END AS statement,
           CASE WHEN coalesce(nombre_catalogo, '') = ''
                THEN 'Fila sin nombre_catalogo (esquema=' || s || ', tabla=' || t || ', columna=' || k ||
                     '): se omite' END AS error
    FROM levelled WHERE status = 'aprobado'""")
oracle("apply_statements", ["v_results"], "SELECT * FROM statements", [LEVELLED, STATEMENTS])
oracle("applied_counts", ["v_results"], """
    SELECT count(*) FILTER (WHERE error IS NULL AND level = 'schema') AS schemas,
           count(*) FILTER (WHERE error IS NULL AND level = 'table') AS tables,
           count(*) FILTER (WHERE error IS NULL AND level = 'column') AS columns,
           count(*) FILTER (WHERE error IS NULL) AS total, count(error) AS errors FROM statements""",
       [LEVELLED, STATEMENTS])

# --- rules of the control tables ----------------------------------------------------------------

oracle("dq_not_null", ["v_results"], """
    SELECT CAST(id_resultado AS VARCHAR) AS row_key, 'id_ejecucion' AS column_name
    FROM v_results WHERE id_ejecucion IS NULL
    UNION ALL SELECT CAST(id_resultado AS VARCHAR), 'status' FROM v_results WHERE status IS NULL""")
LIMITS = {"nombre_catalogo": 255, "nombre_esquema": 255, "nombre_tabla": 255, "nombre_columna": 255,
          "comentario": 4000, "status": 20, "user_comments": 4000}
oracle("dq_length", ["v_results"], " UNION ALL ".join(
    f"""SELECT CAST(id_resultado AS VARCHAR) AS row_key, '{name}' AS column_name,
               CAST(length({name}) AS VARCHAR) AS detail FROM v_results WHERE length({name}) > {most}"""
    for name, most in LIMITS.items()))
oracle("dq_domain", ["v_results"], """
    SELECT CAST(id_resultado AS VARCHAR) AS row_key, 'status' AS column_name, status AS detail
    FROM v_results WHERE status NOT IN ('por revisar', 'aprobado', 'rechazado')""")


def broken_rules(view, key, null, limits, domains):
    """One SELECT per rule and column."""
    parts = [f"SELECT CAST({key} AS VARCHAR) AS row_key, 'null' AS rule, '{c}' AS column_name, CAST(NULL AS VARCHAR) AS detail "
             f"FROM {view} WHERE {c} IS NULL" for c in null]
    parts += [f"SELECT CAST({key} AS VARCHAR), 'length', '{c}', CAST(length({c}) AS VARCHAR) FROM {view} WHERE length({c}) > {n}"
              for c, n in limits.items()]
    parts += [f"SELECT CAST({key} AS VARCHAR), 'domain', '{c}', {c} FROM {view} WHERE {c} NOT IN ({', '.join(map(text, values))})"
              for c, values in domains.items()]
    return " UNION ALL ".join(parts)


oracle("dq_results", ["v_results"], broken_rules(
    "v_results", "id_resultado", ["id_ejecucion", "status"], LIMITS, {"status": ["por revisar", "aprobado", "rechazado"]}))
oracle("dq_executions", ["v_exec_raw"], broken_rules(
    "v_exec_raw", "seq", ["id_ejecucion"], {"estado": 50, "resultado": 4000}, {}))
oracle("dq_golden", ["v_golden_raw"], broken_rules(
    "v_golden_raw", "object_id", ["object_id", "object_level"], {"object_level": 20, "domain": 255},
    {"object_level": ["schema", "table", "column"]}))
oracle("dq_golden_keys", ["v_golden_raw"], """
    SELECT object_id, count(*) AS "rows" FROM v_golden_raw GROUP BY object_id HAVING count(*) > 1""")
oracle("dq_unique", ["v_exec_events"], """
    SELECT id_ejecucion, count(*) AS "rows" FROM v_exec_events GROUP BY id_ejecucion
    HAVING count(*) > 1""")
oracle("dq_orphans", ["v_results", "v_executions"], """
    SELECT id_resultado, id_ejecucion FROM v_results r
    WHERE NOT EXISTS (SELECT 1 FROM v_executions e WHERE e.id_ejecucion = r.id_ejecucion)""")

# --- evaluation -----------------------------------------------------------------------------

oracle("golden_strata", ["v_golden"], """
    SELECT domain, object_level, count(*) AS objects, count(gold_comment) AS with_gold
    FROM v_golden GROUP BY domain, object_level""")
oracle("level_limits", ["v_golden"], """
    SELECT object_id, CASE object_level WHEN 'schema' THEN 'esquema' WHEN 'table' THEN 'tabla'
                                        ELSE 'columna' END AS label,
           CASE object_level WHEN 'column' THEN 300 ELSE 400 END AS max_chars FROM v_golden""")
oracle("eval_grid", ["v_golden"], f"""
    SELECT object_id, model, CAST(run AS INTEGER) AS run
    FROM v_golden CROSS JOIN (SELECT unnest([{', '.join(map(text, MODELS))}]) AS model)
    CROSS JOIN (SELECT unnest([-1, 0, 1, 2]) AS run)""")

# Word characters are spelled out: the engine's own classes know ASCII only.
W = r"\p{L}\p{N}_"
LONG = rf"(^|[^{W}])\p{{Nd}}{{8,11}}([^{W}]|$)"
EMAIL = rf"[{W}.+-]+@[{W}-]+\.[{W}.-]+"
CARD = rf"(^|[^{W}])\p{{Nd}}{{4}}[- ]?\p{{Nd}}{{4}}[- ]?\p{{Nd}}{{4}}[- ]?\p{{Nd}}{{4}}([^{W}]|$)"
SPANISH = rf"(^|[^{W}])({'|'.join(fv.SPANISH_WORDS)})([^{W}]|$)"


def matches(pattern, column="text"):
    return f"regexp_matches({column}, {text(pattern)})"


DET = f"""CAST({strip('text')} <> '' AS INTEGER) AS det_non_empty,
    CAST(length(text) <= 500 AS INTEGER) AS det_within_len,
    CAST(NOT ({matches(LONG)} OR {matches(EMAIL)} OR {matches(CARD)}) AS INTEGER) AS det_no_pii,
    CAST({matches(SPANISH, 'lower(text)')} AS INTEGER) AS det_is_spanish"""
oracle("det_scores", [], f"SELECT doc_id, {DET} FROM documents_all",
       [("documents_all", "SELECT * FROM documents")])
oracle("det_scores_turns", [], f"SELECT conv_id, turn, {DET} FROM turns_all",
       [("turns_all", "SELECT * FROM conversations")])
oracle("pii_hits", [], f"""
    SELECT doc_id, CAST({matches(LONG)} AS INTEGER) AS long_number,
           CAST({matches(EMAIL)} AS INTEGER) AS email, CAST({matches(CARD)} AS INTEGER) AS card
    FROM documents_all""", [("documents_all", "SELECT * FROM documents")])


def style(column, level):
    return f"""
        CAST(length({column}) > CASE {level} WHEN 'column' THEN 300 ELSE 500 END AS INTEGER) AS too_long,
        CAST(regexp_matches({column}, '["“”«»]') AS INTEGER) AS has_quotes,
        CAST(contains({column}, '**') OR contains({column}, '__') OR contains({column}, '`')
             OR regexp_matches({column}, '(^|\\n)(#{{1,6}}|[-*]) ') AS INTEGER) AS has_markdown,
        CAST(regexp_matches(lower({column}),
             '^\\s*(definición|definicion|comentario|descripción|descripcion)\\s*:') AS INTEGER) AS has_prefix,
        CAST(NOT {matches(SPANISH, f'lower({column})')} AS INTEGER) AS not_spanish"""


oracle("style_flags", ["v_golden"],
       f"SELECT object_id, {style('context_text', 'object_level')} FROM v_golden")
oracle("stream_flags", ["v_results"], f"""
    SELECT id_resultado, {DET}, {style('text', 'level')}
    FROM (SELECT id_resultado, comentario AS text, {LEVEL} AS level FROM v_results)""")


def judged(key):
    return f"""CAST(coalesce(CASE json_type(j, '$.{key}')
        WHEN 'BOOLEAN' THEN json_extract_string(j, '$.{key}') = 'true'
        WHEN 'VARCHAR' THEN false WHEN 'ARRAY' THEN false WHEN 'OBJECT' THEN false WHEN 'NULL' THEN false
        ELSE TRY_CAST(json_extract_string(j, '$.{key}') AS DOUBLE) = 1 END, false) AS INTEGER)
        AS judge_{key}"""


oracle("judge_flags", ["v_judge_answers"],
       f"SELECT object_id, {', '.join(judged(key) for key in KEYS)} FROM parsed", [
    ("blocks", r"""SELECT object_id, regexp_extract(coalesce(judge_text, ''), '(?s)\{.*\}', 0) AS block
                   FROM v_judge_answers"""),
    ("parsed", "SELECT object_id, CASE WHEN json_valid(block) THEN block END AS j FROM blocks")])

METRICS = ["det_non_empty", "det_within_len", "det_no_pii", "det_is_spanish",
           *[f"judge_{key}" for key in KEYS], "consistency", "latency_ms", "tokens_in", "tokens_out"]
MEANS = ("means", "SELECT model, count(*) AS n_items, " +
         ", ".join(f"avg({m}) AS {m}" for m in METRICS) + " FROM v_items GROUP BY model")
COSTED = ("costed", f"""
    SELECT means.*, price_in IS NOT NULL AS priced,
           (tokens_in / 1e6 * coalesce(price_in, 0) + tokens_out / 1e6 * coalesce(price_out, 0)) * 1000
               AS cost_1k
    FROM means LEFT JOIN (VALUES {', '.join(f"({text(m)}, {a}, {b})" for m, (a, b) in PRICES.items())})
        AS p(priced_model, price_in, price_out) ON priced_model = model""")


def share(name, lower_is_better):
    part = f"({name} - min({name}) OVER ()) / nullif(max({name}) OVER () - min({name}) OVER (), 0)"
    part = f"1 - {part}" if lower_is_better else part
    return f"coalesce({part}, 1.0) AS {name}_norm"


SHARES = ("shares", f"""
    SELECT *, {share('cost_1k', True)}, {share('latency_ms', True)}, {share('consistency', False)},
           ({' + '.join(f'judge_{key}' for key in KEYS)}) / {len(KEYS)}.0 AS quality FROM costed""")
oracle("model_means", ["v_items"],
       "SELECT model, n_items, " + ", ".join(f"round({m}, 6) AS {m}" for m in METRICS) + " FROM means",
       [MEANS])
oracle("metrics_long", ["v_items"], """
    SELECT 'eval-1' AS run_id, model, 'param' AS kind, key, value, CAST(NULL AS DOUBLE) AS number FROM means CROSS JOIN (VALUES
        ('judge', 'juez'), ('temperature', '0.0'), ('n_consistency_runs', '3')) AS p(key, value)
    UNION ALL SELECT 'eval-1', model, 'param', 'n_items', CAST(n_items AS VARCHAR), NULL FROM means
    """ + " ".join(f"""
    UNION ALL SELECT 'eval-1', model, 'metric', '{m}', NULL, round(CAST({m} AS DOUBLE), 6) FROM means""" for m in METRICS),
       [MEANS])
oracle("cost_per_1k", ["v_items"], "SELECT model, round(cost_1k, 6) AS cost_1k, priced FROM costed",
       [MEANS, COSTED])
oracle("normalized", ["v_items"], """
    SELECT model, round(cost_1k_norm, 6) AS cost_1k_norm, round(latency_ms_norm, 6) AS latency_ms_norm,
           round(consistency_norm, 6) AS consistency_norm FROM shares""", [MEANS, COSTED, SHARES])
CARD_SQL = """
    SELECT model AS modelo, round(0.60 * quality + 0.15 * consistency + 0.15 * cost_1k_norm
                                  + 0.10 * latency_ms_norm, 3) AS score_final,
           round(quality, 2) AS calidad, round(consistency, 2) AS consistencia,
           round(cost_1k, 2) AS costo_1k, round(latency_ms, 0) AS latencia_ms FROM shares"""
oracle("scorecard", ["v_items"], CARD_SQL, [MEANS, COSTED, SHARES])
oracle("best_model", ["v_items"],
       "SELECT * FROM card ORDER BY score_final DESC, modelo LIMIT 1",
       [MEANS, COSTED, SHARES, ("card", CARD_SQL)])
oracle("scorecard_alt", ["v_items"], """
    SELECT model AS modelo,
           round(0.35 * judge_fuera_de_contexto
                 + 0.25 * (judge_informacion_faltante + judge_terminologia_incorrecta) / 2
                 + 0.15 * consistency + 0.15 * cost_1k_norm + 0.10 * latency_ms_norm, 3) AS score_final,
           round(judge_fuera_de_contexto, 2) AS grounding, round(consistency, 2) AS consistencia,
           round(cost_1k, 2) AS costo_1k, round(latency_ms, 0) AS latencia_ms FROM shares""",
       [MEANS, COSTED, SHARES])
oracle("latency_percentiles", ["v_items"], """
    SELECT model, round(quantile_cont(latency_ms, 0.5), 6) AS p50,
           round(quantile_cont(latency_ms, 0.95), 6) AS p95 FROM v_items GROUP BY model""")
oracle("pii_by_sensitivity", ["v_items"], """
    SELECT model, is_sensitive, count(*) AS items, round(avg(1 - det_no_pii), 6) AS leak_rate
    FROM v_items GROUP BY model, is_sensitive""")

RATED = ("rated", f"""
    SELECT d.doc_id, quality AS expert_flag,
           CAST(NOT {matches(EMAIL)} AND NOT {matches(CARD)} AND length(text) <= 4000 AS INTEGER)
               AS judge_flag
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
oracle("judge_agreement", [], """
    SELECT both_yes, judge_only, expert_only, both_no, round(seen, 6) AS agreement,
           round((seen - chance) / (1 - chance), 6) AS kappa
    FROM (SELECT *, (both_yes + both_no) / n AS seen,
                 (both_yes + judge_only) / n * (both_yes + expert_only) / n
                 + (expert_only + both_no) / n * (judge_only + both_no) / n AS chance
          FROM (SELECT count(*) FILTER (WHERE judge_flag = 1 AND expert_flag = 1) AS both_yes,
                       count(*) FILTER (WHERE judge_flag = 1 AND expert_flag = 0) AS judge_only,
                       count(*) FILTER (WHERE judge_flag = 0 AND expert_flag = 1) AS expert_only,
                       count(*) FILTER (WHERE judge_flag = 0 AND expert_flag = 0) AS both_no,
                       CAST(count(*) AS DOUBLE) AS n FROM rated))""", [RATED])
oracle("calibration_sample", [], """
    SELECT doc_id, judge_flag, expert_flag FROM rated ORDER BY md5(doc_id || ':42'), doc_id LIMIT 30""",
       [RATED])

# --- indicators -----------------------------------------------------------------------------

KPIS = """
    SELECT count(DISTINCT id_ejecucion) AS executions, count(*) AS comments,
           count(DISTINCT nombre_catalogo) AS catalogs,
           count(DISTINCT (nombre_catalogo, nombre_esquema)) FILTER (
               WHERE nombre_catalogo IS NOT NULL) AS schemas,
           count(DISTINCT (nombre_catalogo, nombre_esquema, nombre_tabla)) FILTER (
               WHERE nombre_catalogo IS NOT NULL AND nombre_tabla <> '__esquema__') AS tables,
           count(*) FILTER (WHERE status = 'aprobado') AS approved,
           count(*) FILTER (WHERE status = 'por revisar') AS to_review,
           count(*) FILTER (WHERE status = 'rechazado') AS rejected FROM """
oracle("kpis", ["v_results"], KPIS + "v_results")
oracle("kpis_filtered", ["v_results", "v_executions"], KPIS + """(
    SELECT r.* FROM v_results r JOIN v_executions e ON e.id_ejecucion = r.id_ejecucion
    WHERE CAST(e.fecha_ejecucion AS DATE) BETWEEN DATE '2026-01-01' AND DATE '2027-12-31'
      AND nombre_catalogo = 'es' AND status = 'aprobado'
      AND nombre_tabla IN ('tab`1', 'tab`2', 'tab`3', '__esquema__'))""")
