"""Row types of the control tables and of the frames passed between operators."""

from pyspark.sql import types as T

_S, _L, _I = T.StringType(), T.LongType(), T.IntegerType()
_D, _B, _TS = T.DoubleType(), T.BooleanType(), T.TimestampNTZType()


def _struct(**fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


EXECUTIONS = _struct(id_ejecucion=_S, fecha_ejecucion=_TS, estado=_S, resultado=_S)

RESULTS = _struct(
    id_resultado=_L, id_ejecucion=_S, fecha_resultado=_TS, nombre_catalogo=_S,
    nombre_esquema=_S, nombre_tabla=_S, nombre_columna=_S, comentario=_S, status=_S,
    user_comments=_S, criterio_fallido=_S, detalles_criterio_fallido=_S,
)

GOLDEN = _struct(
    object_id=_S, object_level=_S, context_text=_S, gold_comment=_S, domain=_S, is_sensitive=_B,
)

SOURCES = _struct(
    ord=_L, name=_S, description=_S, content=_S, kind=_S,
    hint_tabs=T.ArrayType(_S), hint_columns=T.ArrayType(_S), manifest=_S,
)

RESPONSES = _struct(
    prompt_id=_S, text=_S, latency_ms=_D, tokens_in=_I, tokens_out=_I, error=_S,
)

DESCRIBE_ROWS = _struct(
    catalog_name=_S, schema_name=_S, table_name=_S, pos=_L, col_name=_S, data_type=_S,
)

# Longest text each bounded column may hold.
RESULT_LENGTHS = {
    "nombre_catalogo": 255, "nombre_esquema": 255, "nombre_tabla": 255, "nombre_columna": 255,
    "comentario": 4000, "status": 20, "user_comments": 4000,
}
EXECUTION_LENGTHS = {"estado": 50, "resultado": 4000}
GOLDEN_LENGTHS = {"object_level": 20, "domain": 255}

OBJECT_KEYS = ("nombre_catalogo", "nombre_esquema", "nombre_tabla", "nombre_columna")
