"""Input frames derived from the given tables, in SQL that both engines read alike.

Every frame uses the whole tables and whole texts; remainders only assign categories to rows. Words
that differ between the engines are written ``<word>`` and listed in DIALECT.
"""

import re

from metadoc.runtime import spread

TEXT_KEYS = {"documents": ["doc_id"], "conversations": ["conv_id", "turn"]}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

DIALECT = {
    "spark": {
        "t0": "TIMESTAMP_NTZ'2026-01-01 00:00:00'",
        "props_k": "get_json_object(props, '$.k')",
        "json_text": "substring(to_json(named_struct('t', text)), 6, length(to_json(named_struct('t', text))) - 6)",
        "json_padded": "substring(to_json(named_struct('t', '  ' || text || ' ')), 6, length(to_json(named_struct('t', '  ' || text || ' '))) - 6)",
        "detail_rows": "explode(array(90, 92, 95, 96))",
    },
    "duckdb": {
        "t0": "TIMESTAMP '2026-01-01 00:00:00'",
        "props_k": "json_extract_string(props, '$.k')",
        "json_text": "CAST(to_json(text) AS VARCHAR)",
        "json_padded": "CAST(to_json('  ' || text || ' ') AS VARCHAR)",
        "detail_rows": "unnest([90, 92, 95, 96])",
    },
}

VIEWS = {
    # Scope with nulls, blanks, padded copies and further columns.
    "v_scope": """
        SELECT r_name AS catalog_name,
               CASE WHEN c_custkey % 10 = 0 THEN '  ' || n_name || ' ' ELSE n_name END AS schema_name,
               CASE WHEN c_custkey % 97 = 0 THEN NULL WHEN c_custkey % 89 = 0 THEN '   '
                    ELSE c_mktsegment END AS table_name,
               c_custkey AS prioridad
        FROM customer JOIN nation ON c_nationkey = n_nationkey
                      JOIN region ON n_regionkey = r_regionkey""",
    # Tables the catalog knows: the others of the scope are missing.
    "v_known": """
        SELECT r_name AS catalog_name, n_name AS schema_name, c_mktsegment AS table_name
        FROM customer JOIN nation ON c_nationkey = n_nationkey
                      JOIN region ON n_regionkey = r_regionkey
        GROUP BY r_name, n_name, c_mktsegment HAVING avg(c_acctbal) >= 4500""",
    # Stacked DESCRIBE rows: columns, terminator, partition rows once more, details with comment.
    "v_described": """
        SELECT k.catalog_name, k.schema_name, k.table_name,
               CAST(substring(o_orderpriority, 1, 1) AS BIGINT) AS pos,
               ' ' || o_orderpriority || ' ' AS col_name,
               CASE WHEN o_orderpriority < '3' THEN 'string' ELSE 'bigint' END AS data_type
        FROM orders JOIN customer ON o_custkey = c_custkey
                    JOIN nation ON c_nationkey = n_nationkey
                    JOIN region ON n_regionkey = r_regionkey
                    JOIN v_known k ON k.catalog_name = r_name AND k.schema_name = n_name
                                  AND k.table_name = c_mktsegment
        GROUP BY k.catalog_name, k.schema_name, k.table_name, o_orderpriority
        UNION ALL
        SELECT catalog_name, schema_name, table_name, CAST(pos AS BIGINT),
               CASE pos WHEN 90 THEN CASE WHEN table_name < 'G' THEN '' ELSE '# Partition Information' END
                        WHEN 92 THEN '5-LOW' WHEN 95 THEN '# Detailed Table Information'
                        ELSE 'Comment' END,
               CASE WHEN pos = 92 THEN 'bigint'
                    WHEN pos = 96 AND table_name < 'H'
                    THEN 'Registros de ' || table_name || ' en ' || schema_name ELSE '' END
        FROM (SELECT catalog_name, schema_name, table_name, <detail_rows> AS pos FROM v_known)""",
    # Comments the schemas already have.
    "v_schema_comments": """
        SELECT r_name AS catalog_name, n_name AS schema_name,
               CASE WHEN n_regionkey < 2 THEN 'Esquema de ' || n_name ELSE '' END AS schema_comment
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    # Context sources with extensions, kinds, hints and two manifests.
    "v_sources": """
        SELECT doc_id AS ord,
               CASE WHEN doc_id % 7 = 0 THEN 'main.ref.doc_' || CAST(doc_id AS VARCHAR(20))
                    ELSE 'doc_' || CAST(doc_id AS VARCHAR(20)) ||
                         CASE doc_id % 6 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.docx'
                                         WHEN 3 THEN '.tsv' WHEN 4 THEN '.MD' ELSE '.json' END
               END AS name,
               n_name || ' ' ||
               CASE doc_id % 4 WHEN 0 THEN 'Glosario con definiciones de negocio'
                               WHEN 1 THEN 'Ejemplos de comentarios por tabla y columna'
                               WHEN 2 THEN 'Lineamientos y politica de estilo' ELSE 'Notas' END ||
               CASE doc_id % 11 WHEN 0 THEN ' AUTOMOBILE' WHEN 1 THEN ' Building'
                                WHEN 2 THEN ' furniture' WHEN 3 THEN ' HOUSEHOLD'
                                WHEN 4 THEN ' MACHINERY' ELSE '' END ||
               CASE doc_id % 9 WHEN 0 THEN ' [columnas: a, "b"]'
                               WHEN 1 THEN ' [ HOJAS : h1, ''h 2'', ] [fields:x]'
                               WHEN 2 THEN ' [tabs: p,q] y [ campos: , r]' ELSE '' END AS description,
               text AS content,
               CASE WHEN doc_id % 7 = 0 THEN 'tabla' ELSE 'archivo' END AS kind,
               CASE WHEN doc_id % 2 = 0 THEN 'general.md' ELSE 'auditoria.md' END AS manifest
        FROM documents JOIN nation ON doc_id % 25 = n_nationkey""",
    # Schemas and tables to build contexts for; region names occur in no source.
    "v_objects": """
        SELECT DISTINCT catalog_name, schema_name, table_name FROM v_known
        UNION ALL SELECT r_name, n_name, '' FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT r_name, r_name, '' FROM region""",
    # Manifest texts: prose turned into headings, entries and lines that are neither.
    "v_manifests": """
        SELECT 'manifest_' || CAST(doc_id AS VARCHAR(20)) AS manifest,
               CASE doc_id % 4 WHEN 0 THEN '# Archivos' WHEN 1 THEN '## Tablas de referencia'
                               WHEN 2 THEN 'Sin encabezado' ELSE '#archivos y tablas' END || chr(10) ||
               replace(replace(replace(text, '. ', '.md` : '), ', ', '.s.t: '), ' de ', chr(10) || '`')
               || chr(10) || '### TABLAS' || chr(10) || replace(text, ' ', '.x.y: ')
               || chr(10) || '# Notas' || chr(10) || 'a.b: fuera' AS text
        FROM documents""",
    # Manifest entries whose names repeat within and across manifests.
    "v_entries": """
        SELECT (doc_id % 2) * 1000000000000 + doc_id AS ord,
               'fuente_' || CAST(CAST(floor(doc_id / 5) AS BIGINT) AS VARCHAR(20)) AS name,
               'Fuente ' || CAST(doc_id AS VARCHAR(20)) AS description, text AS content,
               CASE WHEN doc_id % 2 = 0 THEN 'general.md' ELSE 'auditoria.md' END AS manifest
        FROM documents""",
    # Stored results with sentinels, statuses, earlier verdicts, missing catalogs and bad values.
    "v_results": """
        SELECT doc_id AS id_resultado,
               CASE WHEN doc_id % 59 = 0 THEN NULL ELSE source END AS id_ejecucion,
               <t0> + INTERVAL '1' MINUTE * doc_id AS fecha_resultado,
               CASE WHEN doc_id % 53 = 0 THEN NULL WHEN doc_id % 71 = 0 THEN '' ELSE lang END
                   AS nombre_catalogo,
               'NATION_' || CAST(doc_id % 25 AS VARCHAR(20)) AS nombre_esquema,
               CASE WHEN doc_id % 10 = 0 THEN '__esquema__'
                    ELSE 'tab`' || CAST(doc_id % 29 AS VARCHAR(20)) END AS nombre_tabla,
               CASE WHEN doc_id % 10 = 0 THEN '__esquema__' WHEN doc_id % 10 < 3 THEN '__tabla__'
                    ELSE 'col_' || CAST(doc_id % 41 AS VARCHAR(20)) END AS nombre_columna,
               text AS comentario,
               CASE WHEN doc_id % 61 = 0 THEN 'borrador' WHEN doc_id % 67 = 0 THEN NULL
                    WHEN doc_id % 5 = 3 THEN 'por revisar' WHEN doc_id % 5 = 4 THEN 'rechazado'
                    ELSE 'aprobado' END AS status,
               CASE WHEN doc_id % 13 = 0 THEN 'nota previa' END AS user_comments,
               CASE WHEN doc_id % 6 = 0 THEN 'GRANULARIDAD' END AS criterio_fallido,
               CASE WHEN doc_id % 6 = 0 THEN 'anterior' END AS detalles_criterio_fallido
        FROM documents""",
    # Runs with short documents are unknown, so some results are orphans.
    "v_executions": """
        SELECT source AS id_ejecucion, <t0> + INTERVAL '1' HOUR * max(doc_id) AS fecha_ejecucion,
               'COMPLETADO' AS estado, 'documentos: ' || CAST(count(*) AS VARCHAR(20)) AS resultado
        FROM documents GROUP BY source HAVING avg(n_chars) >= 2500""",
    # State changes of runs.
    "v_exec_events": """
        SELECT CAST(user_id AS VARCHAR(20)) AS id_ejecucion, ts AS fecha_ejecucion, event_id AS seq,
               CASE event_type WHEN 'signup' THEN 'INICIADO' WHEN 'purchase' THEN 'COMPLETADO'
                    WHEN 'error' THEN 'COMPLETADO_CON_ERRORES' ELSE 'EN_PROCESO' END AS estado,
               'evento ' || CAST(event_id AS VARCHAR(20)) AS resultado
        FROM events""",
    # One row per handled object of a run; errors carry a message.
    "v_outcomes": """
        SELECT CAST(user_id AS VARCHAR(20)) AS id_ejecucion, event_id AS position,
               CASE event_id % 10 WHEN 0 THEN 'schema' WHEN 1 THEN 'table' WHEN 2 THEN 'table'
                    ELSE 'column' END AS level,
               CASE WHEN event_type = 'error' AND user_id % 7 > 0
                    THEN 'objeto ' || CAST(event_id AS VARCHAR(20)) || ': sin respuesta' END AS message
        FROM events""",
    # Raw answers of an auditor, in many shapes.
    "v_audit_answers": """
        SELECT d.doc_id AS id_resultado,
               CASE d.doc_id % 14
                 WHEN 0 THEN '{"ok": true, "criterio": null, "detalles": null}'
                 WHEN 1 THEN '{"ok": false, "criterio": "GRANULARIDAD", "detalles": ' || <json_padded> || '}'
                 WHEN 2 THEN '```json' || chr(10) || '{"ok": false, "criterio": "IDIOMA_O_ESTILO", "detalles": ""}' || chr(10) || '```'
                 WHEN 3 THEN text || ' {"ok": false, "criterio": "INFORMACION_FALTANTE", "detalles": "x"} fin'
                 WHEN 4 THEN '{"ok": false, "criterio": "INVENTADO", "detalles": ' || <json_text> || '}'
                 WHEN 5 THEN text
                 WHEN 6 THEN '{"ok": "false", "criterio": "GRANULARIDAD"}'
                 WHEN 7 THEN ''
                 WHEN 8 THEN '{"ok": 0, "criterio": "FUERA_DE_CONTEXTO", "detalles": "cero"}'
                 WHEN 9 THEN '{"ok": null, "criterio": "TERMINOLOGIA_INCORRECTA"}'
                 WHEN 10 THEN '{"ok": false, "criterio": null, "detalles": "y"}'
                 WHEN 11 THEN '{"ok": "", "criterio": "GRANULARIDAD", "detalles": "vacio"}'
                 WHEN 12 THEN CASE WHEN toxic = 1 THEN NULL ELSE '[1, 2]' END
                 ELSE '{"criterio": "GRANULARIDAD", "detalles": "sin ok"}' END AS text
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    # Raw answers of a judge, in many shapes.
    "v_judge_answers": """
        SELECT doc_id AS object_id,
               CASE doc_id % 8
                 WHEN 0 THEN '{"fuera_de_contexto": 1, "terminologia_incorrecta": 1.0, "granularidad": true, "idioma_o_estilo": "1", "informacion_faltante": 0}'
                 WHEN 1 THEN text || '{"fuera_de_contexto": 0, "terminologia_incorrecta": 1}' || chr(10)
                 WHEN 2 THEN '{"fuera_de_contexto": false, "granularidad": 2, "idioma_o_estilo": 1}'
                 WHEN 3 THEN text
                 WHEN 4 THEN '{' || text || '}'
                 WHEN 5 THEN '```json' || chr(10) || '{"granularidad": null,' || chr(10) || '"informacion_faltante": 1}' || chr(10) || '```'
                 WHEN 6 THEN NULL
                 ELSE '{"fuera_de_contexto": 1, "terminologia_incorrecta": 1, "granularidad": 1, "idioma_o_estilo": 1, "informacion_faltante": 1}' END AS judge_text
        FROM documents""",
    # Golden set.
    "v_golden": """
        SELECT 'doc_' || CAST(d.doc_id AS VARCHAR(20)) AS object_id,
               CASE WHEN n_chars < 1000 THEN 'column' WHEN n_chars < 5000 THEN 'table'
                    ELSE 'schema' END AS object_level,
               text AS context_text, CASE WHEN quality = 1 THEN text END AS gold_comment,
               lang AS domain, coalesce(toxic, 0) = 1 AS is_sensitive
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    # An execution log and a golden set that break the rules of their tables here and there.
    "v_exec_raw": """
        SELECT event_id AS seq, CASE WHEN user_id % 37 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR(20)) END AS id_ejecucion,
               CASE WHEN event_id % 53 = 0 THEN 'EN_PROCESO ' || repeat(event_type, 12) ELSE 'EN_PROCESO' END AS estado,
               CASE WHEN event_id % 101 = 0 THEN repeat(props || '-', 600) ELSE props END AS resultado
        FROM events""",
    "v_golden_raw": """
        SELECT CASE WHEN doc_id % 41 = 0 THEN NULL ELSE 'doc_' || CAST(doc_id AS VARCHAR(20)) END AS object_id,
               CASE WHEN doc_id % 29 = 0 THEN 'vista' WHEN doc_id % 31 = 0 THEN 'columna de una vista ' || lang
                    WHEN doc_id % 43 = 0 THEN NULL ELSE 'table' END AS object_level,
               text AS context_text, CASE WHEN doc_id % 7 = 0 THEN text ELSE source END AS domain
        FROM documents""",
    # Per-item metrics: the event types are the candidate models.
    "v_items": """
        SELECT event_type AS model, CAST(event_id AS VARCHAR(20)) AS object_id,
               user_id % 4 = 0 AS is_sensitive,
               1 AS det_non_empty, CASE WHEN event_id % 9 = 0 THEN 0 ELSE 1 END AS det_within_len,
               CASE WHEN event_id % 13 = 0 THEN 0 ELSE 1 END AS det_no_pii,
               CASE WHEN value < 5 THEN 0 ELSE 1 END AS det_is_spanish,
               CASE WHEN value < 12 THEN 0 ELSE 1 END AS judge_fuera_de_contexto,
               CASE WHEN value < 20 THEN 0 ELSE 1 END AS judge_terminologia_incorrecta,
               CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS judge_granularidad,
               CASE WHEN user_id % 5 = 0 THEN 0 ELSE 1 END AS judge_idioma_o_estilo,
               CASE WHEN event_id % 7 = 0 THEN 0 ELSE 1 END AS judge_informacion_faltante,
               CAST(user_id % 10 AS DOUBLE) / 10 AS consistency, value AS latency_ms,
               CAST(<props_k> AS INTEGER) AS tokens_in, CAST(event_id % 200 AS INTEGER) AS tokens_out
        FROM events""",
    # Runs of one input: the turns of a conversation, by two models.
    "v_runs": """
        SELECT CASE WHEN conv_id % 3 = 0 THEN 'modelo_a' ELSE 'modelo_b' END AS model,
               CAST(conv_id AS VARCHAR(20)) AS object_id, turn AS run,
               CASE WHEN conv_id % 17 = 0 AND turn = 0 THEN NULL ELSE text END AS text
        FROM conversations""",
    # Reviewers' decisions.
    "v_decisions": """
        SELECT doc_id AS id_resultado,
               CASE WHEN toxic = 1 THEN 'rechazado' WHEN quality = 0 THEN 'por revisar'
                    WHEN doc_id % 19 = 0 THEN 'quizas' ELSE 'aprobado' END AS status,
               CASE WHEN quality = 0 THEN 'revisar redaccion' END AS user_comments
        FROM labels""",
    # Rows of many tables stacked in one frame.
    "v_rows": """
        SELECT n_name AS schema_name, c_mktsegment AS table_name, o_orderkey, o_orderstatus,
               o_orderpriority, o_totalprice, o_orderdate
        FROM orders JOIN customer ON o_custkey = c_custkey
                    JOIN nation ON c_nationkey = n_nationkey""",
}


def _needs(sql, names):
    words = set(re.findall(r"\w+", sql))
    return [name for name in names if name in words]


def _in_order(names):
    """Views that ``names`` need, each after the ones it uses."""
    done = []

    def add(name):
        if name not in done:
            for other in _needs(VIEWS[name], [v for v in VIEWS if v != name]):
                add(other)
            done.append(name)

    for name in names:
        add(name)
    return done


def _text(name, engine):
    return re.sub(r"<(\w+)>", lambda m: DIALECT[engine][m.group(1)], VIEWS[name])


def duckdb_with(names, more=()):
    """``WITH`` clause of the views in ``names`` and of further ``(name, sql)`` pairs."""
    parts = [f"{name} AS ({_text(name, 'duckdb')})" for name in _in_order(names)]
    parts += [f"{name} AS ({sql})" for name, sql in more]
    return "WITH " + ",\n".join(parts)


_GIVEN = {}


def table(spark, sf_dir, name):
    """A given table, opened once per session; long texts in few splits are dealt out to all cores
    before anything else."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _GIVEN or _GIVEN[key].sparkSession is not spark:
        frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        _GIVEN[key] = spread(frame, *TEXT_KEYS[name]) if name in TEXT_KEYS else frame
    return _GIVEN[key]


def view(spark, sf_dir, name):
    views = _in_order([name])
    parts = []
    for base in sorted({t for v in views for t in _needs(VIEWS[v], TABLES)}):
        table(spark, sf_dir, base).createOrReplaceTempView(f"given_{base}")
        parts.append(f"{base} AS (SELECT * FROM given_{base})")
    parts += [f"{v} AS ({_text(v, 'spark')})" for v in views]
    return spark.sql("WITH " + ",\n".join(parts) + f"\nSELECT * FROM {name}")
