"""Fixed values.

Stored rows, prompts and scores must stay interchangeable with existing control tables, so the
sentinels, states, word lists, patterns, limits and texts below are data and are kept as they are.
Everything else in the package is free to change.
"""

# --- fixed values: sentinels, states and levels -------------------------------------------------

SCHEMA_SENTINEL = "__esquema__"
TABLE_SENTINEL = "__tabla__"

KIND_FILE = "archivo"
KIND_TABLE = "tabla"

STATUS_REVIEW = "por revisar"
STATUS_APPROVED = "aprobado"
STATUS_REJECTED = "rechazado"
STATUSES = (STATUS_REVIEW, STATUS_APPROVED, STATUS_REJECTED)

RUN_STARTED = "INICIADO"
RUN_WORKING = "EN_PROCESO"
RUN_DONE = "COMPLETADO"
RUN_DONE_WITH_ERRORS = "COMPLETADO_CON_ERRORES"
RUN_FAILED = "ERROR"

LEVELS = ("schema", "table", "column")
LEVEL_LABELS = {"schema": "esquema", "table": "tabla", "column": "columna"}
LEVEL_MAX_CHARS = {"schema": 500, "table": 500, "column": 300}

# --- fixed values: relevance and budget ---------------------------------------------------------

MAX_CONTEXT_CHARS = 30_000
HEAD_CHARS = 500
TRUNCATION_RESERVE = 50
MIN_TRUNCATED_CHARS = 500
TRUNCATION_MARK = "\n[... contenido truncado]"

SCORE_BASE = 1.0
SCORE_SCHEMA = 10.0
SCORE_TABLE = 15.0
SCORE_KIND_TABLE = 4.0
SCORE_EXTENSION = {".docx": 3.0, ".tsv": 2.0, ".md": 1.5, ".txt": 1.5}
SCORE_KEYWORD = 1.0

GENERATOR_KEYWORDS = (
    "definic", "ejemplo", "comentario", "tabla", "columna", "campo",
    "negocio", "instruccion", "regla", "glosario", "taxonom",
)
AUDITOR_KEYWORDS = GENERATOR_KEYWORDS + ("politica", "lineamiento", "estilo")

# --- fixed values: context tables and samples ---------------------------------------------------

CONTEXT_TABLE_ROWS = 200
CONTEXT_CELL_CHARS = 200
SAMPLE_ALL_UP_TO = 500
SAMPLE_ROWS_KEPT = 30
SAMPLE_COLUMNS_KEPT = 20
SAMPLE_CELL_CHARS = 50
SAMPLE_PROMPT_CHARS = 3_000
EMPTY_TABLE_TEXT = "(tabla vacía — sin registros)"
SHEET_TITLE = "--- Hoja: {sheet} ---"
SCHEMA_PROMPT_TABLES = 30
SUMMARY_ERRORS = 5
PRINTED_ERRORS = 10

# --- fixed values: patterns ---------------------------------------------------------------------

HINT_TABS_PATTERN = r"\[\s*(?:tabs?|hojas?|sheets?)\s*:\s*([^\]]+)\]"
HINT_COLUMNS_PATTERN = r"\[\s*(?:columnas?|columns?|campos?|fields?)\s*:\s*([^\]]+)\]"

PII_LONG_NUMBER = r"\b\d{8,11}\b"
PII_EMAIL = r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"
PII_CARD = r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b"

SPANISH_WORDS = ("de", "la", "el", "los", "las", "que", "para", "con")

# --- fixed values: evaluation -------------------------------------------------------------------

JUDGE_CONTEXT_CHARS = 30_000
WEIGHTS = {"quality": 0.60, "consistency": 0.15, "cost": 0.15, "latency": 0.10}
ALTERNATIVE_WEIGHTS = {
    "grounding": 0.35, "completeness_terminology": 0.25,
    "consistency": 0.15, "cost": 0.15, "latency": 0.10,
}
GOLDEN_COLUMNS = (
    "object_id", "object_level", "context_text", "gold_comment", "domain", "is_sensitive",
)

# --- fixed values: texts of the execution log and of failed samples -------------------------------
WAVE_TEXTS = {
    "schema": "Procesando esquemas", "table": "Procesando tablas", "column": "Procesando columnas",
}
UNEXPECTED_TEXT = "Error inesperado: {}"
SAMPLE_FAILED_TEXT = "(error al obtener muestra: {})"

# Answer length in tokens and temperature a responder is meant to use, per kind of prompt; the
# temperature of an evaluation is a parameter of the run.
CALL_SETTINGS = {
    "schema": (500, 0.2), "table": (500, 0.2), "column": (400, 0.2), "audit": (400, 0.0),
    "judge": (300, 0.0), "evaluation": (1024, None),
}

# --- fixed values: audit criteria ---------------------------------------------------------------
# {manifests} is filled with the names of the manifests that were loaded.

CRITERIA = (
    ("FUERA_DE_CONTEXTO",
     "El comentario afirma hechos, definiciones o reglas de negocio que no están respaldados por "
     "ninguno de los insumos provistos (archivos del directorio input/ y tablas referenciadas en "
     "{manifests}). Incluye casos de alucinación donde el modelo aporta información de su "
     "conocimiento previo."),
    ("TERMINOLOGIA_INCORRECTA",
     "El comentario usa términos distintos a los términos canónicos definidos en los glosarios, "
     "diccionarios o taxonomías presentes en los insumos. Por ejemplo, dice 'cliente' cuando el "
     "glosario define 'titular', o usa sinónimos no estandarizados."),
    ("GRANULARIDAD",
     "El comentario describe un nivel de granularidad incorrecto para el objeto al que pertenece. "
     "Ejemplos: un comentario de columna describe la tabla completa; un comentario de tabla "
     "describe únicamente el esquema; un comentario de esquema describe una sola tabla."),
    ("IDIOMA_O_ESTILO",
     "El comentario no cumple los lineamientos editoriales: no está en español claro y de "
     "negocio, excede la longitud máxima esperada (500 chars para esquema/tabla, 300 para "
     "columna), incluye comillas, formato markdown, prefijos tipo 'Definición:' o cualquier "
     "metadato que no debería estar en el texto final."),
    ("INFORMACION_FALTANTE",
     "El comentario omite información clave que sí está disponible en los insumos y debería "
     "incluirse: reglas de negocio asociadas a la columna, dominio de valores cuando es un "
     "catálogo/código/indicador, propósito principal cuando el insumo lo describe "
     "explícitamente."),
)

# --- fixed values: texts sent to a responder ----------------------------------------------------
# Names in braces are filled with column values.

SOURCE_HEADER = "\n--- {label}: {name} (Propósito: {description}) ---\n"
SOURCE_LABELS = {KIND_TABLE: "Tabla", KIND_FILE: "Insumo"}

TABLE_SCHEMA_NOTE = "\nContexto del esquema '{schema}': {schema_comment}\n"
COLUMN_SCHEMA_NOTE = "\nContexto del esquema: {schema_comment}"
COLUMN_TABLE_NOTE = "\nContexto de la tabla '{table}': {table_comment}"
SAMPLE_NOTE = "\nMuestra de datos reales de la tabla:\n```\n{sample}\n```\n"

SCHEMA_PROMPT = """\
Eres un experto en documentación de datos orientada a usuarios de negocio de una organización.
{context}
Genera una definición de negocio para el siguiente esquema:

- Esquema: {schema}
- Tablas contenidas: {tables}

La definición debe:
- Utilizar solo la información dada en el contexto, no conocimiento previo.
- Explicar el propósito del esquema y el dominio de negocio.
- Mencionar los principales tipos de datos que contiene.
- Estar en español, lenguaje claro para usuarios de negocio.
- Tener máximo 500 caracteres.
- Responde ÚNICAMENTE con la definición, sin comillas."""

TABLE_PROMPT = """\
Eres un experto en documentación de datos orientada a usuarios de negocio de una organización.
{context}{schema_note}{sample_note}
Genera una definición de negocio clara y completa para la siguiente tabla:

- Tabla: {table}

La definición debe:
- Utilizar solo la información dada en el contexto, no conocimiento previo.
- Explicar el nivel de granularidad de la información.
- Indicar los principales usos en el negocio.
- Mencionar reglas o lógicas de negocio relevantes.
- Estar en español, lenguaje claro para usuarios de negocio.
- Tener máximo 500 caracteres.
- Responde ÚNICAMENTE con la definición, sin comillas."""

COLUMN_PROMPT = """\
Eres un experto en documentación de datos orientada a usuarios de negocio de una organización.
{context}{parent_notes}{sample_note}
Genera una definición de negocio clara y completa para la siguiente columna:

- Tabla  : {table}
- Columna: {column}
- Tipo   : {data_type}

La definición debe:
- Describir el propósito o contenido del campo.
- Usar nombres funcionales si los insumos los proporcionan.
- Incluir reglas de negocio del campo si el nombre lo sugiere.
- Explicar posibles valores si es catálogo, indicador o código.
- Estar en español, lenguaje claro y accesible.
- Tener máximo 300 caracteres.
- Responde ÚNICAMENTE con la definición, sin comillas."""

EVALUATION_PROMPT = """\
Eres un experto en documentación de datos orientada a usuarios de negocio de una organización.
{context}

Genera una definición de negocio para el siguiente objeto de tipo {level_label}.

La definición debe:
- Utilizar solo la información dada en el contexto, no conocimiento previo.
- Estar en español, lenguaje claro para usuarios de negocio.
- Tener máximo {max_chars} caracteres.
- No incluir datos personales (PII).
- Responde ÚNICAMENTE con la definición, sin comillas."""

AUDIT_PROMPT = '''\
Eres un auditor experto en documentación de datos. Tu tarea es evaluar si un comentario generado \
por IA está apegado EXCLUSIVAMENTE a los insumos provistos abajo. Usa únicamente la información \
del contexto; no apliques conocimiento previo.

=== CRITERIOS DE FALLA (elige a lo sumo UNO) ===
{criteria}

=== INSUMOS ===
{context}

=== OBJETO AUDITADO ===
Nivel  : {level_label}
Objeto : {target}
Comentario generado:
"""
{comment}
"""

=== INSTRUCCIONES DE RESPUESTA ===
Responde ÚNICAMENTE con un JSON válido, sin texto adicional, sin markdown, con la siguiente forma \
exacta:
{{"ok": true|false, "criterio": "ID_DEL_CRITERIO"|null, "detalles": "explicación breve en \
español"|null}}

- Si el comentario está apegado a los insumos: {{"ok": true, "criterio": null, "detalles": null}}.
- Si falla EXACTAMENTE UN criterio: ok=false, criterio=ID exacto del catálogo de arriba, \
detalles=máx 300 caracteres explicando qué encontraste y citando el insumo o la parte del \
comentario que lo evidencia.
- Si dudás entre varios criterios, elige el más grave / el de mayor impacto.'''

# {catalog_product} names the catalog product in use.
JUDGE_PROMPT = """\
Eres un auditor experto de comentarios de negocio de {catalog_product}. Evalúa el COMENTARIO \
contra el CONTEXTO usando los criterios de abajo. Usa únicamente la información del contexto; no \
apliques conocimiento previo.

=== CRITERIOS (el comentario CUMPLE un criterio cuando NO incurre en la falla descrita) ===
{criteria}

=== CONTEXTO ===
{context}

=== OBJETO ===
Nivel: {level}

=== COMENTARIO ===
{comment}

=== RESPUESTA ===
Responde ÚNICAMENTE con un JSON válido, sin markdown ni texto extra, con UNA clave por criterio \
(en minúsculas) y valor 1 (cumple) o 0 (falla). Claves exactas: {keys}.
Ejemplo de forma: {{{example}}}"""

# --- fixed values: run summaries ----------------------------------------------------------------

SUMMARY_OK = (
    "Exitoso. {schemas} esquema(s), {tables} tabla(s) y {columns} columna(s) documentadas desde "
    "scope '{scope}'."
)
SUMMARY_ERRORS_TEXT = (
    "Completado con {errors} error(es). Esquemas: {schemas}/{scope_schemas}. "
    "Tablas: {tables}/{scope_tables}. Columnas: {columns}. Errores: {first_errors}"
)
