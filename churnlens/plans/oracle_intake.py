"""Independent DuckDB SQL for the intake, quality-report and cleaning queries.

The intake is re-derived from ``behavior`` (see ``oracle.BASE``) and
``events``; the quality and cleaning rules are written out in SQL.  Column
lists are expanded with small Python loops so the per-column SQL stays
readable; the rules themselves are independent of the Spark code.
"""

from __future__ import annotations

from churnlens.plans.oracle import BASE, SQL

NUM = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# The customer contract's columns, ranges and fallbacks, repeated so that the SQL is independent.
COLS = ["id_cliente", "nombre", "ciudad", "antiguedad_meses", "tipo_contrato", "plan", "monto_mensual",
        "reclamos_ultimos_6_meses", "pagos_atrasados", "dias_sin_uso", "satisfaccion", "abandono", "edad",
        "cantidad_servicios"]
NUMERIC = ["antiguedad_meses", "monto_mensual", "reclamos_ultimos_6_meses", "pagos_atrasados", "dias_sin_uso",
           "satisfaccion", "abandono", "edad", "cantidad_servicios"]
CLEAN_NUMERIC = ["edad", "antiguedad_meses", "monto_mensual", "cantidad_servicios", "reclamos_ultimos_6_meses",
                 "pagos_atrasados", "dias_sin_uso", "satisfaccion", "abandono"]
RANGES = {"edad": (18, 100), "antiguedad_meses": (0, None), "monto_mensual": (0, None),
          "cantidad_servicios": (0, None), "reclamos_ultimos_6_meses": (0, None), "pagos_atrasados": (0, None),
          "dias_sin_uso": (0, None), "satisfaccion": (1, 5)}
MEDIAN = ["edad", "antiguedad_meses", "monto_mensual", "cantidad_servicios", "dias_sin_uso", "satisfaccion"]
ZERO = ["reclamos_ultimos_6_meses", "pagos_atrasados"]
FALLBACK = {"edad": 18, "antiguedad_meses": 0, "monto_mensual": 0.0, "cantidad_servicios": 0,
            "dias_sin_uso": 0, "satisfaccion": 3}
INTS = ["edad", "antiguedad_meses", "cantidad_servicios", "reclamos_ultimos_6_meses", "pagos_atrasados",
        "dias_sin_uso", "abandono"]

INTAKE = """,
intake AS (
  SELECT CAST(id_cliente AS VARCHAR) AS id_cliente, nombre, ciudad,
         CAST(antiguedad_meses AS VARCHAR) AS antiguedad_meses, tipo_contrato, plan,
         CAST(CAST(round(monto_mensual, 2) AS DECIMAL(20, 2)) AS VARCHAR) AS monto_mensual,
         CAST(reclamos_ultimos_6_meses AS VARCHAR) AS reclamos_ultimos_6_meses,
         CAST(pagos_atrasados AS VARCHAR) AS pagos_atrasados, CAST(dias_sin_uso AS VARCHAR) AS dias_sin_uso,
         CAST(satisfaccion AS VARCHAR) AS satisfaccion, CAST(abandono AS VARCHAR) AS abandono,
         CAST(edad AS VARCHAR) AS edad, CAST(cantidad_servicios AS VARCHAR) AS cantidad_servicios,
         0 AS _src, CAST(id_cliente AS BIGINT) AS _pos
  FROM behavior
  UNION ALL
  SELECT CASE WHEN event_type = 'error' AND value < 5 THEN '   '
              ELSE ' U' || CAST(user_id AS VARCHAR) || '  ' END,
         CASE WHEN event_type = 'view' THEN ' ' ELSE '  ' || event_type || '   user ' || CAST(user_id AS VARCHAR) END,
         ' ' || event_type || '-zone ',
         CAST(CAST(floor(value) AS BIGINT) - 10 AS VARCHAR),
         CASE WHEN value >= 50 THEN '' ELSE upper(event_type) END,
         props,
         CAST(CAST(round(value * 1000, 2) AS DECIMAL(20, 2)) AS VARCHAR),
         substr(props, 7, 2),
         CASE WHEN event_type = 'click' THEN '-1' ELSE '' END,
         CAST(hour(ts) - 3 AS VARCHAR),
         CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR),
         CASE WHEN event_type IN ('purchase', 'view') THEN '0' WHEN event_type = 'signup' THEN '1'
              WHEN event_type = 'click' THEN ' 1 ' ELSE 'x' END,
         CASE WHEN event_type = 'view' THEN chr(9) || CAST(user_id AS VARCHAR)
              WHEN event_type = 'purchase' THEN CAST(user_id AS VARCHAR) || chr(13) || chr(10)
              ELSE CAST(user_id AS VARCHAR) END,
         CAST(CAST(floor(value / 20) AS BIGINT) AS VARCHAR),
         1, CAST(event_id AS BIGINT)
  FROM events
)
"""


def num(x: str) -> str:
    t = f"regexp_replace({x}, '^[[:space:]]+|[[:space:]]+$', '', 'g')"
    return f"(CASE WHEN regexp_full_match({t}, '{NUM}') THEN TRY_CAST({t} AS DOUBLE) END)"


def with_intake(extra: str, select: str) -> str:
    return "WITH " + BASE.strip() + INTAKE.rstrip() + extra.rstrip() + "\n" + select.strip()


# --------------------------------------------------------------------------- intake + quality
SQL["intake_rows"] = with_intake("", "SELECT * FROM intake")

SQL["structure_check"] = with_intake("", """
SELECT count(*) > 0 AND count(id_cliente) > 0
         AND count(*) FILTER (WHERE id_cliente IS NULL OR trim(id_cliente) <> '') > 0 AS es_valido,
       CASE WHEN count(*) = 0 THEN 'El archivo no contiene filas de datos.' ELSE '' END AS errores,
       CAST(CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_errores,
       count(*) AS filas, CAST(14 AS BIGINT) AS columnas
FROM intake
""")


def _quality() -> str:
    aggs = ["count(*) AS filas"]
    for c in COLS:
        aggs.append(f"count(*) FILTER (WHERE {c} IS NULL) AS m_{c}")
    aggs.append("count(*) - count(DISTINCT id_cliente) - max(CASE WHEN id_cliente IS NULL THEN 1 ELSE 0 END) AS dup")
    for c in NUMERIC:
        aggs.append(f"count(*) FILTER (WHERE {c} IS NOT NULL AND {num(c)} IS NULL) AS nn_{c}")
    aggs.append(f"count(*) FILTER (WHERE abandono IS NOT NULL AND coalesce({num('abandono')} NOT IN (0, 1), TRUE))"
                " AS badt")
    for c in NUMERIC:
        aggs.append(f"count(*) FILTER (WHERE {num(c)} < 0) AS neg_{c}")
    aggs.append(f"count(*) FILTER (WHERE {num('satisfaccion')} < 1 OR {num('satisfaccion')} > 5) AS sat")
    aggs.append(f"count(*) FILTER (WHERE {num('edad')} < 0 OR {num('edad')} > 110) AS age")
    rows = []

    def row(check, column, n, msg, keep="TRUE"):
        col = "NULL" if column is None else f"'{column}'"
        m = "CAST(NULL AS VARCHAR)" if msg is None else msg
        rows.append(f"SELECT {len(rows)} AS orden, '{check}' AS chequeo, CAST({col} AS VARCHAR) AS columna, "
                    f"CAST({n} AS BIGINT) AS n, {m} AS mensaje FROM q WHERE {keep}")

    total = "(" + " + ".join(f"m_{c}" for c in COLS) + ")"
    row("filas", None, "filas", None)
    row("columnas", None, "14", None)
    for c in COLS:
        row("faltantes", c, f"m_{c}", None, f"m_{c} > 0")
    row("faltantes_total", None, total, None)
    row("duplicados_id", None, "dup", None)
    row("advertencia_faltantes", None, total, f"'Se encontraron ' || CAST({total} AS VARCHAR) || ' valores faltantes.'",
        f"{total} > 0")
    row("advertencia_duplicados", "id_cliente", "dup",
        "'Se encontraron ' || CAST(dup AS VARCHAR) || ' identificadores duplicados en ''id_cliente''.'", "dup > 0")
    for c in NUMERIC:
        row("no_numericos", c, f"nn_{c}",
            f"'La columna ''{c}'' tiene ' || CAST(nn_{c} AS VARCHAR) || ' valores no numericos.'", f"nn_{c} > 0")
    row("abandono_invalido", "abandono", "badt", "'La columna ''abandono'' contiene valores distintos de 0 y 1.'",
        "badt > 0")
    for c in NUMERIC:
        row("negativos", c, f"neg_{c}",
            f"'La columna ''{c}'' contiene ' || CAST(neg_{c} AS VARCHAR) || ' valores negativos.'", f"neg_{c} > 0")
    row("satisfaccion_fuera_rango", "satisfaccion", "sat",
        "'La columna ''satisfaccion'' tiene ' || CAST(sat AS VARCHAR) || ' valores fuera del rango 1 a 5.'",
        "sat > 0")
    row("edad_fuera_rango", "edad", "age",
        "'La columna ''edad'' tiene ' || CAST(age AS VARCHAR) || ' edades negativas o poco razonables.'", "age > 0")
    extra = ",\nq AS (SELECT " + ",\n  ".join(aggs) + " FROM intake)"
    return with_intake(extra, "\nUNION ALL\n".join(rows))


SQL["quality_report"] = _quality()

# --------------------------------------------------------------------------- cleaning
_TITLE = ("array_to_string(list_transform(regexp_extract_all(lower({x}), '(\\p{{L}}+|\\P{{L}}+)', 1), "
          "lambda t: upper(t[1]) || t[2:]), '')")


def _basic(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"


def _staged() -> str:
    conv = []
    for c in CLEAN_NUMERIC:
        v = num(c)
        conv.append(f"coalesce(trim({c}) <> '', FALSE) AND {v} IS NULL AS nc_{c}")
        if c in RANGES:
            lo, hi = RANGES[c]
            cond = " OR ".join(x for x in ([f"{v} < {lo}"] if lo is not None else [])
                               + ([f"{v} > {hi}"] if hi is not None else []))
            conv.append(f"coalesce({cond}, FALSE) AS oor_{c}")
            conv.append(f"CASE WHEN {cond} THEN NULL ELSE {v} END AS v_{c}")
        else:
            conv.append(f"{v} AS v_{c}")
    title = {c: _TITLE.format(x=_basic(c)) for c in ("ciudad", "tipo_contrato", "plan")}
    return f""",
s0 AS (SELECT *, {_basic('id_cliente')} AS idn FROM intake),
firsts AS (
  SELECT idn, _src, _pos FROM (
    SELECT idn, _src, _pos, row_number() OVER (PARTITION BY idn ORDER BY _src, _pos) AS rn
    FROM s0 WHERE idn <> '') x WHERE rn = 1
),
s1 AS (
  SELECT s0.*, s0.idn = '' AS is_blank, f.idn IS NOT NULL AS is_first,
         s0.idn <> '' AND f.idn IS NOT NULL AS kept
  FROM s0 LEFT JOIN firsts f ON f.idn = s0.idn AND f._src = s0._src AND f._pos = s0._pos
),
s2 AS (
  SELECT idn, is_blank, is_first, kept,
         CASE WHEN {_basic('nombre')} = '' THEN 'Cliente sin nombre' ELSE {_basic('nombre')} END AS c_nombre,
         {", ".join(f"CASE WHEN {t} = '' THEN 'No informado' ELSE {t} END AS c_{c}" for c, t in title.items())},
         {(",\n         ").join(conv)}
  FROM s1
),
s3 AS (SELECT *, coalesce(v_abandono IN (0, 1), FALSE) AS valid_t, kept AND coalesce(v_abandono IN (0, 1), FALSE) AS surv
       FROM s2),
st AS (
  SELECT count(*) AS filas_iniciales, count(*) FILTER (WHERE surv) AS filas_finales,
         count(*) FILTER (WHERE is_blank) AS ids_vacios, count(*) FILTER (WHERE NOT is_blank AND NOT is_first) AS dups,
         count(*) FILTER (WHERE kept AND NOT valid_t) AS badt,
         {", ".join(f"count(*) FILTER (WHERE kept AND nc_{c}) AS nc_{c}" for c in CLEAN_NUMERIC)},
         {", ".join(f"count(*) FILTER (WHERE kept AND oor_{c}) AS oor_{c}" for c in RANGES)},
         {", ".join(f"count(*) FILTER (WHERE surv AND v_{c} IS NULL) AS imp_{c}" for c in MEDIAN + ZERO)},
         {", ".join(f"quantile_cont(v_{c}, 0.5) FILTER (WHERE surv) AS med_{c}" for c in MEDIAN)}
  FROM s3
)"""


def _clean_rows() -> str:
    vals = {}
    for c in MEDIAN:
        vals[c] = f"coalesce(s3.v_{c}, st.med_{c}, {float(FALLBACK[c])})"
    for c in ZERO:
        vals[c] = f"coalesce(s3.v_{c}, 0.0)"
    vals["abandono"] = "s3.v_abandono"
    for c in INTS:
        vals[c] = f"CAST(round_even({vals[c]}, 0) AS BIGINT)"
    for c in ("monto_mensual", "satisfaccion"):
        vals[c] = f"CAST({vals[c]} AS DOUBLE)"
    sel = ["s3.idn AS id_cliente", "c_nombre AS nombre", "c_ciudad AS ciudad", f"{vals['antiguedad_meses']} AS antiguedad_meses",
           "c_tipo_contrato AS tipo_contrato", "c_plan AS plan"]
    sel += [f"{vals[c]} AS {c}" for c in ["monto_mensual", "reclamos_ultimos_6_meses", "pagos_atrasados",
                                          "dias_sin_uso", "satisfaccion", "abandono", "edad", "cantidad_servicios"]]
    body = f"SELECT {', '.join(sel)} FROM s3, st WHERE s3.surv"
    return with_intake(_staged(), f"""
SELECT *,
  CASE WHEN edad <= 29 THEN '18-29' WHEN edad <= 44 THEN '30-44' WHEN edad <= 59 THEN '45-59' ELSE '60 o más' END
    AS grupo_edad,
  CASE WHEN antiguedad_meses <= 12 THEN '0-12 meses' WHEN antiguedad_meses <= 24 THEN '13-24 meses'
       WHEN antiguedad_meses <= 48 THEN '25-48 meses' ELSE '49 meses o más' END AS grupo_antiguedad,
  CASE WHEN satisfaccion <= 2 THEN 'Baja' WHEN satisfaccion = 3 THEN 'Media' ELSE 'Alta' END AS nivel_satisfaccion,
  CAST(pagos_atrasados > 0 AS BIGINT) AS tiene_morosidad,
  CAST(reclamos_ultimos_6_meses > 0 AS BIGINT) AS tiene_reclamos
FROM ({body}) b
""")


def _clean_report() -> str:
    rows = []

    def row(metric, column, value, keep="TRUE"):
        col = "NULL" if column is None else f"'{column}'"
        rows.append(f"SELECT {len(rows)} AS orden, '{metric}' AS metrica, CAST({col} AS VARCHAR) AS columna, "
                    f"CAST({value} AS DOUBLE) AS valor FROM st WHERE {keep}")

    row("filas_iniciales", None, "filas_iniciales")
    row("filas_finales", None, "filas_finales")
    row("filas_eliminadas", None, "filas_iniciales - filas_finales")
    row("duplicados_eliminados", None, "dups")
    row("ids_vacios_eliminados", None, "ids_vacios")
    row("abandono_invalido_eliminado", None, "badt")
    for c in CLEAN_NUMERIC:
        row("valores_no_convertibles", c, f"nc_{c}", "filas_iniciales > 0")
    for c in RANGES:
        row("valores_fuera_de_rango", c, f"oor_{c}", "filas_iniciales > 0")
    for c in MEDIAN + ZERO:
        row("valores_imputados", c, f"imp_{c}", "filas_iniciales > 0")
    for c in MEDIAN:
        row("valores_respaldo_usados", c, str(float(FALLBACK[c])),
            f"filas_iniciales > 0 AND imp_{c} > 0 AND med_{c} IS NULL")
    for i, d in enumerate(["grupo_edad", "grupo_antiguedad", "nivel_satisfaccion", "tiene_morosidad",
                           "tiene_reclamos"]):
        row("columnas_derivadas", d, str(i), "filas_iniciales > 0")
    return with_intake(_staged(), "\nUNION ALL\n".join(rows))


SQL["clean_rows"] = _clean_rows()
SQL["clean_report"] = _clean_report()
SQL["dedupe_first"] = with_intake(_staged(), """
SELECT idn AS id_cliente, _src, _pos FROM s1 WHERE kept
""")
SQL["impute_medians"] = with_intake(_staged(), f"""
SELECT {", ".join(f"ROUND(med_{c}, 6) AS med_{c}" for c in MEDIAN)} FROM st
""")

SQL["typed_intake"] = with_intake("", "SELECT id_cliente, nombre, ciudad, " + ", ".join(
    f"{num(c)} AS {c}" if c in NUMERIC else c for c in COLS[3:]) + ", _src, _pos FROM intake")
SQL["intake_preview"] = with_intake("", "SELECT * FROM intake ORDER BY _src, _pos LIMIT 5")
