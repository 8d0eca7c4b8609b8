"""Data contract and tunable parameters.

Every value in the block marked FIXED VALUES must equal the application this
library re-expresses on Spark (column names, labels, thresholds, ranges), so
that results match.  Functions take these as default arguments; callers can
override any of them.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reference application's contract verbatim)
# ---------------------------------------------------------------------------

ID_COLUMN = "id_cliente"
TARGET_COLUMN = "abandono"

REQUIRED_COLUMNS = [
    "id_cliente",
    "nombre",
    "ciudad",
    "antiguedad_meses",
    "tipo_contrato",
    "plan",
    "monto_mensual",
    "reclamos_ultimos_6_meses",
    "pagos_atrasados",
    "dias_sin_uso",
    "satisfaccion",
    "abandono",
]
OPTIONAL_COLUMNS = ["edad", "cantidad_servicios"]

NUMERIC_COLUMNS = [
    "antiguedad_meses",
    "monto_mensual",
    "reclamos_ultimos_6_meses",
    "pagos_atrasados",
    "dias_sin_uso",
    "satisfaccion",
    "abandono",
    "edad",
    "cantidad_servicios",
]
TEXT_COLUMNS = ["id_cliente", "nombre", "ciudad", "tipo_contrato", "plan"]

TARGET_VALUES = [0, 1]
NON_NEGATIVE_COLUMNS = [
    "antiguedad_meses",
    "monto_mensual",
    "reclamos_ultimos_6_meses",
    "pagos_atrasados",
    "dias_sin_uso",
    "satisfaccion",
    "abandono",
    "edad",
    "cantidad_servicios",
]
SATISFACTION_MIN = 1
SATISFACTION_MAX = 5
AGE_MIN_REASONABLE = 0
AGE_MAX_REASONABLE = 110

TABLE_COLUMNS = [
    "id_cliente",
    "nombre",
    "ciudad",
    "tipo_contrato",
    "plan",
    "monto_mensual",
    "satisfaccion",
    "abandono",
]
SORTABLE_COLUMNS = [
    "id_cliente",
    "nombre",
    "ciudad",
    "antiguedad_meses",
    "monto_mensual",
    "satisfaccion",
]
TARGET_LABELS = {0: "Permanece", 1: "Abandonó"}
GROUPING_COLUMNS = ["ciudad", "tipo_contrato", "plan"]
COLUMN_LABELS = {
    "ciudad": "Ciudad",
    "tipo_contrato": "Tipo de contrato",
    "plan": "Plan",
    "satisfaccion": "Satisfacción promedio",
    "reclamos_ultimos_6_meses": "Reclamos promedio",
    "pagos_atrasados": "Pagos atrasados promedio",
    "dias_sin_uso": "Días sin uso promedio",
}

# cleaning
CLEAN_TEXT_COLUMNS = ["ciudad", "tipo_contrato", "plan"]
CLEAN_NUMERIC_COLUMNS = [
    "edad",
    "antiguedad_meses",
    "monto_mensual",
    "cantidad_servicios",
    "reclamos_ultimos_6_meses",
    "pagos_atrasados",
    "dias_sin_uso",
    "satisfaccion",
    "abandono",
]
CLEAN_VALID_RANGES = {
    "edad": (18, 100),
    "antiguedad_meses": (0, None),
    "monto_mensual": (0, None),
    "cantidad_servicios": (0, None),
    "reclamos_ultimos_6_meses": (0, None),
    "pagos_atrasados": (0, None),
    "dias_sin_uso": (0, None),
    "satisfaccion": (1, 5),
}
CLEAN_FALLBACKS = {
    "edad": 18,
    "antiguedad_meses": 0,
    "monto_mensual": 0.0,
    "cantidad_servicios": 0,
    "dias_sin_uso": 0,
    "satisfaccion": 3,
}
CLEAN_INTEGER_COLUMNS = [
    "edad",
    "antiguedad_meses",
    "cantidad_servicios",
    "reclamos_ultimos_6_meses",
    "pagos_atrasados",
    "dias_sin_uso",
    "abandono",
]
CLEAN_MEDIAN_COLUMNS = [
    "edad",
    "antiguedad_meses",
    "monto_mensual",
    "cantidad_servicios",
    "dias_sin_uso",
    "satisfaccion",
]
CLEAN_ZERO_COLUMNS = ["reclamos_ultimos_6_meses", "pagos_atrasados"]
DERIVED_COLUMNS = [
    "grupo_edad",
    "grupo_antiguedad",
    "nivel_satisfaccion",
    "tiene_morosidad",
    "tiene_reclamos",
]
DEFAULT_NAME = "Cliente sin nombre"
DEFAULT_CATEGORY = "No informado"
AGE_BINS = [(29, "18-29"), (44, "30-44"), (59, "45-59")]
AGE_BIN_LAST = "60 o más"
TENURE_BINS = [(12, "0-12 meses"), (24, "13-24 meses"), (48, "25-48 meses")]
TENURE_BIN_LAST = "49 meses o más"
SATISFACTION_LOW, SATISFACTION_MID, SATISFACTION_HIGH = "Baja", "Media", "Alta"

# analysis screen
BOXPLOT_VARIABLES = {
    "satisfaccion": "Satisfacción",
    "reclamos_ultimos_6_meses": "Reclamos en los últimos 6 meses",
    "pagos_atrasados": "Pagos atrasados",
    "dias_sin_uso": "Días sin uso",
    "monto_mensual": "Monto mensual",
    "antiguedad_meses": "Antigüedad en meses",
}
CORRELATION_VARIABLES = {
    "antiguedad_meses": "Antigüedad en meses",
    "monto_mensual": "Monto mensual",
    "cantidad_servicios": "Cantidad de servicios",
    "reclamos_ultimos_6_meses": "Reclamos últimos 6 meses",
    "pagos_atrasados": "Pagos atrasados",
    "dias_sin_uso": "Días sin uso",
    "satisfaccion": "Satisfacción",
    "abandono": "Abandono",
}
CORRELATION_THRESHOLD = 0.10
DIRECTION_POSITIVE = "Positiva"
DIRECTION_NEGATIVE = "Negativa"
DIRECTION_NONE = "Sin relación lineal clara"
METRIC_COMPARISON = [
    ("Satisfaccion (1-5)", "satisfaccion"),
    ("Reclamos ultimos 6 meses", "reclamos_ultimos_6_meses"),
    ("Pagos atrasados", "pagos_atrasados"),
    ("Dias sin uso", "dias_sin_uso"),
]
TOP_RATE_SENTENCE = (
    "En los datos analizados se observa que el {label} `{value}` presenta la "
    "mayor tasa de abandono ({rate}%)."
)
DIFFERENCE_SENTENCE = (
    "Este resultado sugiere una asociacion descriptiva: la diferencia de "
    "{label} entre quienes abandonaron y quienes permanecen es {diff} puntos."
)
TOP_RATE_TOPICS = [("tipo_contrato", "contrato"), ("ciudad", "ciudad"), ("plan", "plan")]
DIFFERENCE_TOPICS = [
    ("satisfaccion", "satisfaccion promedio"),
    ("reclamos_ultimos_6_meses", "reclamos promedio"),
]

# segmentation
SEGMENT_FEATURES = [
    "antiguedad_meses",
    "monto_mensual",
    "cantidad_servicios",
    "reclamos_ultimos_6_meses",
    "pagos_atrasados",
    "dias_sin_uso",
    "satisfaccion",
]
CLUSTER_PREFIX = "Clúster "
TRAIT_HIGH = "mayor promedio de {feature}"
TRAIT_LOW = "menor promedio de {feature}"
CLUSTER_WITH_TRAITS = (
    "{cluster}: agrupa {total} clientes con valores relativos destacados en {traits}. "
    "Estas similitudes son matematicas y no implican causalidad ni jerarquia entre clusters."
)
CLUSTER_WITHOUT_TRAITS = (
    "{cluster}: agrupa {total} clientes con patrones numericos similares. "
    "El numero del cluster no representa mayor o menor riesgo."
)
MAX_TRAITS = 3

# churn model
MODEL_CATEGORICAL = ["ciudad", "tipo_contrato", "plan", "region"]
MODEL_NUMERIC = [
    "antiguedad_meses",
    "monto_mensual",
    "reclamos_ultimos_6_meses",
    "pagos_atrasados",
    "dias_sin_uso",
    "satisfaccion",
    "edad",
    "cantidad_servicios",
]
MODEL_SEED = 42
MODEL_NAME = "arbol_decision"
MODEL_VERSION = "v1"
TEST_FRACTION = 0.2
TREE_MAX_DEPTH = 4
TREE_MIN_LEAF = 30
LOGISTIC_MAX_ITER = 1000
RISK_LOW_BELOW = 0.30
RISK_HIGH_FROM = 0.60
RISK_LEVELS = ["bajo", "medio", "alto"]
RISK_DEFAULT_FILTER = ["alto", "medio"]
PREDICTION_EXCLUDED = ["id_cliente", "nombre", "abandono"]

# prediction history statuses and table rules
PAYMENT_STATUSES = ["a_tiempo", "atrasado"]
WINDOW_MONTHS = 6

# Missing-value text tokens that a CSV reader of the reference treats as NULL
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]


# validation and intake messages
MSG_NO_ROWS = "El archivo no contiene filas de datos."
MSG_MISSING_REQUIRED = "Faltan columnas obligatorias: "
MSG_NO_ID = "No existe la columna identificadora obligatoria 'id_cliente'."
MSG_EMPTY_ID = "La columna identificadora 'id_cliente' esta completamente vacia."
MSG_NO_TARGET = "No existe la columna objetivo obligatoria 'abandono'."
MSG_MISSING_TOTAL = "Se encontraron {n} valores faltantes."
MSG_DUPLICATE_IDS = "Se encontraron {n} identificadores duplicados en 'id_cliente'."
MSG_NOT_NUMERIC = "La columna '{col}' tiene {n} valores no numericos."
MSG_BAD_TARGET = "La columna 'abandono' contiene valores distintos de 0 y 1."
MSG_NEGATIVE = "La columna '{col}' contiene {n} valores negativos."
MSG_SATISFACTION_RANGE = "La columna 'satisfaccion' tiene {n} valores fuera del rango 1 a 5."
MSG_AGE_RANGE = "La columna 'edad' tiene {n} edades negativas o poco razonables."
MSG_CSV_EMPTY = "El archivo CSV esta vacio o no contiene columnas."
MSG_CSV_UNREADABLE = "No fue posible leer el archivo CSV: "


# display labels of result tables
CATEGORY_TABLE_LABELS = {
    "total_clientes": "Total clientes",
    "clientes_abandonaron": "Abandonaron",
    "tasa_abandono": "Tasa abandono (%)",
}
SEGMENT_LABELS = {
    "cluster": "Clúster",
    "total_clientes": "Total clientes",
    "clientes_abandonaron": "Clientes abandonaron",
    "tasa_abandono": "Tasa abandono",
    "antiguedad_meses": "Antigüedad meses",
    "monto_mensual": "Monto mensual",
    "cantidad_servicios": "Cantidad servicios",
    "reclamos_ultimos_6_meses": "Reclamos últimos 6 meses",
    "pagos_atrasados": "Pagos atrasados",
    "dias_sin_uso": "Días sin uso",
    "satisfaccion": "Satisfacción",
}
MSG_VIEW_MISSING = "La vista de clientes no contiene columnas obligatorias: "
PRINCIPAL_MESSAGE = ("Integridad de contratos: {sin} cliente(s) sin contrato principal activo y {dup} con mas "
                     "de uno. Se esperaba exactamente uno por cliente.")
# fields of a customer card, in order
CARD_FIELDS = [
    ("ID", "id_cliente"), ("Nombre", "nombre"), ("Edad", "edad"), ("Ciudad", "ciudad"), ("Región", "region"),
    ("Antiguedad en meses", "antiguedad_meses"), ("Tipo de contrato", "tipo_contrato"), ("Plan", "plan"),
    ("Monto mensual", "monto_mensual"), ("Cantidad de servicios", "cantidad_servicios"),
    ("Reclamos ultimos 6 meses", "reclamos_ultimos_6_meses"), ("Pagos atrasados", "pagos_atrasados"),
    ("Dias sin uso", "dias_sin_uso"), ("Satisfaccion", "satisfaccion"), ("Estado de abandono", "abandono"),
]

# ---------------------------------------------------------------------------
# end of FIXED VALUES
# ---------------------------------------------------------------------------

# Spark-side tunables (ours, not the reference's)
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
MAX_DECIMAL_EXPONENT = 308  # largest decimal exponent a double-precision text parser accepts
