"""Independent ANSI-SQL (DuckDB dialect) statements of every registered query.

They run on the driver's pre-registered views (region nation customer ...
orders lineitem events).  ``BASE`` re-derives the churn tables and the
analytic view in plain SQL; each query appends its own SELECT.
"""

from __future__ import annotations

BASE = """
params AS (
  SELECT CAST(max(CAST(o_orderdate AS DATE)) - INTERVAL 6 MONTH AS DATE) AS t
  FROM orders
),
o AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
         CAST(o_orderdate AS DATE) AS d
  FROM orders
),
latest AS (
  SELECT o_custkey, o_orderpriority FROM (
    SELECT o_custkey, o_orderpriority,
           row_number() OVER (PARTITION BY o_custkey ORDER BY d DESC, o_orderkey DESC) AS rn
    FROM o, params WHERE d <= params.t) x
  WHERE rn = 1
),
facts AS (
  SELECT o_custkey,
         min(CASE WHEN d <= params.t THEN d END) AS first_d,
         max(CASE WHEN d <= params.t THEN d END) AS last_d,
         count(CASE WHEN d > params.t THEN 1 END) AS n_after
  FROM o, params GROUP BY o_custkey
),
clientes AS (
  SELECT CAST(c.c_custkey AS VARCHAR) AS id_cliente, c.c_name AS nombre,
         CAST(c.c_custkey % 73 + 18 AS INTEGER) AS edad, n.n_name AS ciudad,
         c.c_nationkey AS id_sucursal, c.c_mktsegment AS segmento,
         CAST(floor(datediff('day', f.first_d, params.t) / 30) AS INTEGER) AS antiguedad_meses,
         c.c_acctbal AS ingreso_mensual,
         CAST(6 - TRY_CAST(substr(lt.o_orderpriority, 1, 1) AS INTEGER) AS INTEGER) AS satisfaccion,
         CAST(datediff('day', f.last_d, params.t) AS INTEGER) AS dias_sin_uso,
         f.first_d AS fecha_alta,
         CAST(CASE WHEN coalesce(f.n_after, 0) = 0 THEN 1 ELSE 0 END AS INTEGER) AS abandono
  FROM customer c
  CROSS JOIN params
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN facts f ON f.o_custkey = c.c_custkey
  LEFT JOIN latest lt ON lt.o_custkey = c.c_custkey
),
sucursales AS (
  SELECT n.n_nationkey AS id_sucursal, n.n_name AS nombre, n.n_name AS ciudad_sede, r.r_name AS region
  FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
),
servicios AS (
  SELECT p_partkey AS id_servicio, 'P' || CAST(p_partkey AS VARCHAR) AS codigo, p_type AS nombre,
         p_brand AS tipo, p_retailprice AS precio_mensual
  FROM part
),
lo AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_extendedprice, l.l_returnflag, l.l_linestatus,
         CAST(l.l_shipdate AS DATE) AS ship_d, o.o_custkey, o.d AS order_d,
         CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS line_key
  FROM lineitem l JOIN o ON l.l_orderkey = o.o_orderkey
),
contratos_raw AS (
  SELECT line_key AS id_contrato, CAST(o_custkey AS VARCHAR) AS id_cliente, l_partkey AS id_servicio,
         l_returnflag AS tipo_contrato, order_d AS fecha_inicio, ship_d AS fecha_fin,
         CASE WHEN l_linestatus = 'O' THEN 'activo' ELSE 'inactivo' END AS estado,
         l_extendedprice AS monto_mensual
  FROM lo, params WHERE order_d <= params.t
),
contratos AS (
  SELECT *, CAST(CASE WHEN estado = 'activo' AND rk = 1 THEN 1 ELSE 0 END AS INTEGER) AS es_principal
  FROM (
    SELECT *, rank() OVER (PARTITION BY id_cliente, estado = 'activo'
                           ORDER BY round(monto_mensual * 100) DESC, id_servicio DESC,
                                    CAST(split_part(id_contrato, '-', 1) AS BIGINT) DESC,
                                    CAST(split_part(id_contrato, '-', 2) AS BIGINT) DESC) AS rk
    FROM contratos_raw) x
),
reclamos AS (
  SELECT line_key AS id_reclamo, CAST(o_custkey AS VARCHAR) AS id_cliente,
         CAST(NULL AS INTEGER) AS id_sucursal, ship_d AS fecha
  FROM lo, params WHERE l_returnflag = 'R' AND order_d <= params.t
),
facturas AS (
  SELECT o_orderkey AS id_factura, CAST(o_custkey AS VARCHAR) AS id_cliente,
         strftime(d, '%Y-%m') AS periodo, o_totalprice AS monto_facturado, d AS fecha_emision,
         CASE WHEN o_orderstatus = 'F' THEN 'pagada' ELSE 'pendiente' END AS estado
  FROM o
),
pagos AS (
  SELECT line_key AS id_pago, l_orderkey AS id_factura, ship_d AS fecha_pago, l_extendedprice AS monto_pagado,
         CASE WHEN datediff('day', order_d, ship_d) - 30 > 0 THEN 'atrasado' ELSE 'a_tiempo' END AS estado
  FROM lo
),
half_year AS (SELECT t AS upto, CAST(t - INTERVAL 6 MONTH AS DATE) AS since FROM params),
incidents AS (
  SELECT id_cliente, 1 AS complaint, 0 AS late, fecha AS day FROM reclamos
  UNION ALL
  SELECT facturas.id_cliente, 0, 1, facturas.fecha_emision FROM pagos, facturas
  WHERE facturas.id_factura = pagos.id_factura AND pagos.estado = 'atrasado'
),
recent AS (
  SELECT id_cliente, sum(complaint) AS complaints, sum(late) AS late
  FROM incidents SEMI JOIN half_year ON incidents.day BETWEEN half_year.since AND half_year.upto
  GROUP BY id_cliente
),
running AS (
  SELECT id_cliente, tipo_contrato, monto_mensual, es_principal = 1 AS main,
         (SELECT nombre FROM servicios WHERE servicios.id_servicio = contratos.id_servicio) AS service
  FROM contratos WHERE estado = 'activo' AND id_servicio IN (SELECT id_servicio FROM servicios)
),
billed AS (
  SELECT id_cliente, count(*) AS services, sum(monto_mensual::DECIMAL(38, 6))::DOUBLE AS amount,
         max(tipo_contrato) FILTER (WHERE main) AS kind, max(service) FILTER (WHERE main) AS service
  FROM running GROUP BY id_cliente
),
behavior AS (
  SELECT id_cliente, clientes.nombre, clientes.ciudad, antiguedad_meses, billed.kind AS tipo_contrato, billed.service AS plan,
         ifnull(billed.amount, 0.0) AS monto_mensual, ifnull(recent.complaints, 0)::BIGINT AS reclamos_ultimos_6_meses,
         ifnull(recent.late, 0)::BIGINT AS pagos_atrasados, dias_sin_uso, satisfaccion, abandono, edad,
         ifnull(billed.services, 0)::BIGINT AS cantidad_servicios,
         (SELECT region FROM sucursales WHERE sucursales.id_sucursal = clientes.id_sucursal) AS region, segmento
  FROM clientes LEFT JOIN billed USING (id_cliente) LEFT JOIN recent USING (id_cliente)
)
"""


def with_base(select: str) -> str:
    return "WITH " + BASE.strip() + "\n" + select.strip()


SQL: dict[str, str] = {}


def register(name: str, select: str) -> None:
    SQL[name] = with_base(select)


register("behavior_view", "SELECT * FROM behavior ORDER BY id_cliente")


def _pct(num: str, den: str) -> str:
    return f"COALESCE(CAST({num} AS DOUBLE) / NULLIF({den}, 0) * 100, 0.0)"


_KPI = f"""
SELECT count(*) AS total_clientes,
       count(*) FILTER (WHERE abandono = 0) AS clientes_permanecen,
       count(*) FILTER (WHERE abandono = 1) AS clientes_abandonaron,
       ROUND({_pct("count(*) FILTER (WHERE abandono = 1)", "count(*) FILTER (WHERE abandono IN (0, 1))")}, 6)
         AS tasa_abandono,
       ROUND({_pct("count(*) FILTER (WHERE abandono = 0)", "count(*) FILTER (WHERE abandono IN (0, 1))")}, 6)
         AS tasa_retencion,
       ROUND(COALESCE(avg(satisfaccion), 0.0), 6) AS satisfaccion_promedio,
       ROUND(COALESCE(avg(monto_mensual), 0.0), 6) AS monto_mensual_promedio,
       ROUND(COALESCE(avg(reclamos_ultimos_6_meses), 0.0), 6) AS reclamos_promedio,
       ROUND(COALESCE(avg(pagos_atrasados), 0.0), 6) AS pagos_atrasados_promedio,
       ROUND(COALESCE(avg(dias_sin_uso), 0.0), 6) AS dias_sin_uso_promedio
FROM {{src}}
"""
register("kpis", _KPI.format(src="behavior"))
register("kpis_filtered", _KPI.format(
    src="(SELECT * FROM behavior WHERE trim(ciudad) IN ('NATION_1', 'NATION_7', 'NATION_13', 'NATION_21') "
        "AND trim(tipo_contrato) IN ('A', 'R')) b"))


def _by_category(col: str) -> str:
    return f"""
SELECT {col}, total_clientes, clientes_abandonaron,
       ROUND({_pct("clientes_abandonaron", "total_clientes")}, 6) AS tasa_abandono
FROM (SELECT trim({col}) AS {col}, count(*) AS total_clientes,
             CAST(sum(abandono) AS BIGINT) AS clientes_abandonaron
      FROM behavior
      WHERE {col} IS NOT NULL AND trim({col}) <> '' AND abandono IN (0, 1)
      GROUP BY trim({col})) x
ORDER BY tasa_abandono DESC, {col}
"""


register("churn_by_city", _by_category("ciudad"))
register("churn_by_contract", _by_category("tipo_contrato"))
register("churn_by_plan", _by_category("plan"))
register("churn_by_dimensions", " UNION ALL ".join(
    f"""SELECT '{c}' AS dimension, categoria, total_clientes, clientes_abandonaron,
              ROUND({_pct("clientes_abandonaron", "total_clientes")}, 6) AS tasa_abandono
       FROM (SELECT trim({c}) AS categoria, count(*) AS total_clientes,
                    CAST(sum(abandono) AS BIGINT) AS clientes_abandonaron
             FROM behavior WHERE {c} IS NOT NULL AND trim({c}) <> '' AND abandono IN (0, 1)
             GROUP BY trim({c})) x""" for c in ("ciudad", "tipo_contrato", "plan")))
register("mean_by_state", """
SELECT CAST(abandono AS INTEGER) AS abandono,
       CASE abandono WHEN 0 THEN 'Permanece' WHEN 1 THEN 'Abandonó' END AS estado_abandono,
       ROUND(avg(satisfaccion), 6) AS promedio
FROM behavior WHERE abandono IN (0, 1) GROUP BY abandono ORDER BY abandono
""")
register("count_by_state", """
SELECT CAST(abandono AS INTEGER) AS abandono,
       CASE abandono WHEN 0 THEN 'Permanece' WHEN 1 THEN 'Abandonó' END AS estado_abandono,
       count(*) AS total_clientes
FROM behavior WHERE abandono IN (0, 1) GROUP BY abandono ORDER BY abandono
""")
register("global_churn", """
SELECT count(*) AS total_clientes, ROUND(avg(CAST(abandono AS DOUBLE)) * 100, 6) AS tasa_abandono FROM clientes
""")
register("metric_comparison", """
SELECT Metrica, CASE abandono WHEN 0 THEN 'Permanece' WHEN 1 THEN 'Abandonó' END AS Estado,
       round_even(avg(v), 2) AS Promedio
FROM (
  SELECT 'Satisfaccion (1-5)' AS Metrica, 0 AS o, abandono, CAST(satisfaccion AS DOUBLE) AS v FROM behavior
  UNION ALL SELECT 'Reclamos ultimos 6 meses', 1, abandono, CAST(reclamos_ultimos_6_meses AS DOUBLE) FROM behavior
  UNION ALL SELECT 'Pagos atrasados', 2, abandono, CAST(pagos_atrasados AS DOUBLE) FROM behavior
  UNION ALL SELECT 'Dias sin uso', 3, abandono, CAST(dias_sin_uso AS DOUBLE) FROM behavior
) x WHERE abandono IN (0, 1)
GROUP BY Metrica, o, abandono ORDER BY o, abandono
""")
register("search", """
SELECT * FROM behavior
WHERE contains(upper(id_cliente), '#000001') OR contains(upper(nombre), '#000001')
""")
register("search_by_index", """
SELECT * FROM behavior
WHERE contains(upper(id_cliente), '#000001') OR contains(upper(nombre), '#000001')
""")
register("filter_combo", """
SELECT * FROM behavior
WHERE (contains(upper(id_cliente), '#000001') OR contains(upper(nombre), '#000001'))
  AND trim(tipo_contrato) IN ('N', 'A') AND abandono = 1
""")
register("sorted_table", """
SELECT id_cliente, nombre, ciudad, tipo_contrato, plan, monto_mensual, satisfaccion,
       CASE WHEN abandono = 0 THEN 'Permanece' WHEN abandono = 1 THEN 'Abandonó'
            ELSE CAST(abandono AS VARCHAR) END AS abandono
FROM behavior ORDER BY monto_mensual DESC NULLS LAST, id_cliente
""")
register("lookup", "SELECT * FROM behavior WHERE trim(id_cliente) = '42' ORDER BY id_cliente LIMIT 1")
register("profile_card", """
SELECT id_cliente, orden, campo, valor FROM (
  SELECT b.id_cliente, f.orden, f.campo,
         CASE f.orden
           WHEN 0 THEN b.id_cliente WHEN 1 THEN b.nombre WHEN 2 THEN CAST(b.edad AS VARCHAR) WHEN 3 THEN b.ciudad
           WHEN 4 THEN b.region WHEN 5 THEN CAST(b.antiguedad_meses AS VARCHAR)
           WHEN 6 THEN b.tipo_contrato WHEN 7 THEN b.plan
           WHEN 8 THEN CAST(b.monto_mensual AS VARCHAR) WHEN 9 THEN CAST(b.cantidad_servicios AS VARCHAR)
           WHEN 10 THEN CAST(b.reclamos_ultimos_6_meses AS VARCHAR) WHEN 11 THEN CAST(b.pagos_atrasados AS VARCHAR)
           WHEN 12 THEN CAST(b.dias_sin_uso AS VARCHAR) WHEN 13 THEN CAST(b.satisfaccion AS VARCHAR)
           WHEN 14 THEN CASE WHEN b.abandono = 0 THEN 'Permanece' WHEN b.abandono = 1 THEN 'Abandonó'
                             ELSE coalesce(CAST(b.abandono AS VARCHAR), 'None') END
         END AS valor
  FROM (SELECT * FROM behavior WHERE trim(id_cliente) = '42' LIMIT 1) b
  CROSS JOIN (VALUES (0, 'ID'), (1, 'Nombre'), (2, 'Edad'), (3, 'Ciudad'), (4, 'Región'),
                     (5, 'Antiguedad en meses'), (6, 'Tipo de contrato'), (7, 'Plan'), (8, 'Monto mensual'),
                     (9, 'Cantidad de servicios'), (10, 'Reclamos ultimos 6 meses'), (11, 'Pagos atrasados'),
                     (12, 'Dias sin uso'), (13, 'Satisfaccion'), (14, 'Estado de abandono')) f(orden, campo)
) x WHERE valor IS NOT NULL
""")
register("filter_options", """
SELECT DISTINCT trim(plan) AS valor FROM behavior WHERE plan IS NOT NULL AND trim(plan) <> ''
""")
register("selection_labels", """
SELECT coalesce(id_cliente, '') || ' - ' || coalesce(nombre, '') AS etiqueta,
       split_part(coalesce(id_cliente, '') || ' - ' || coalesce(nombre, ''), ' - ', 1) AS id_seleccionado
FROM behavior
""")
_BOX_POINTS = """
box_points AS (
  SELECT CASE abandono WHEN 0 THEN 'Permanece' ELSE 'Abandonó' END AS estado_abandono,
         CAST(monto_mensual AS DOUBLE) AS monto_mensual
  FROM behavior WHERE monto_mensual IS NOT NULL AND abandono IN (0, 1)
),
box_q AS (
  SELECT estado_abandono, count(*) AS n,
         quantile_cont(monto_mensual, 0.25) AS q1, quantile_cont(monto_mensual, 0.5) AS mediana,
         quantile_cont(monto_mensual, 0.75) AS q3
  FROM box_points GROUP BY estado_abandono
),
box_f AS (
  SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS limite_inferior, q3 + 1.5 * (q3 - q1) AS limite_superior
  FROM box_q
)
"""


def _with_box(select: str) -> str:
    return "WITH " + BASE.strip() + ",\n" + _BOX_POINTS.strip() + "\n" + select.strip()


SQL["boxplot_input"] = _with_box("SELECT * FROM box_points")
SQL["boxplot_stats"] = _with_box("""
SELECT f.estado_abandono, f.n, ROUND(f.q1, 6) AS q1, ROUND(f.mediana, 6) AS mediana, ROUND(f.q3, 6) AS q3,
       ROUND(f.iqr, 6) AS iqr, ROUND(f.limite_inferior, 6) AS limite_inferior,
       ROUND(f.limite_superior, 6) AS limite_superior,
       ROUND(min(CASE WHEN p.monto_mensual BETWEEN f.limite_inferior AND f.limite_superior
                      THEN p.monto_mensual END), 6) AS bigote_inferior,
       ROUND(max(CASE WHEN p.monto_mensual BETWEEN f.limite_inferior AND f.limite_superior
                      THEN p.monto_mensual END), 6) AS bigote_superior,
       count(*) FILTER (WHERE NOT (p.monto_mensual BETWEEN f.limite_inferior AND f.limite_superior)) AS atipicos,
       'monto_mensual' AS variable
FROM box_f f JOIN box_points p USING (estado_abandono)
GROUP BY ALL
""")
SQL["boxplot_outliers"] = _with_box("""
SELECT p.estado_abandono, p.monto_mensual AS valor
FROM box_points p JOIN box_f f USING (estado_abandono)
WHERE NOT (p.monto_mensual BETWEEN f.limite_inferior AND f.limite_superior)
""")
SQL["distinct_states"] = _with_box("""
SELECT count(DISTINCT estado_abandono) AS estados, count(DISTINCT estado_abandono) >= 2 AS comparable
FROM box_points
""")

_CORR_VARS = ["antiguedad_meses", "monto_mensual", "cantidad_servicios", "reclamos_ultimos_6_meses",
              "pagos_atrasados", "dias_sin_uso", "satisfaccion", "abandono"]
_CORR_LABELS = ["Antigüedad en meses", "Monto mensual", "Cantidad de servicios", "Reclamos últimos 6 meses",
                "Pagos atrasados", "Días sin uso", "Satisfacción", "Abandono"]


def _corr_pair(a: str, b: str) -> str:
    x = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN CAST({a} AS DOUBLE) END"
    y = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN CAST({b} AS DOUBLE) END"
    den = f"(stddev_pop({x}) * stddev_pop({y}))"
    return f"CASE WHEN {den} > 0 THEN covar_pop({x}, {y}) / {den} END"


def _corr_long() -> str:
    parts = []
    for i, a in enumerate(_CORR_VARS):
        for j, b in enumerate(_CORR_VARS):
            r = _corr_pair(a, b)
            if i == j:
                r = f"CASE WHEN ({r}) IS NOT NULL THEN 1.0 END"
            parts.append(f"SELECT '{a}' AS variable_x, '{b}' AS variable_y, {i} AS pos_x, {j} AS pos_y, "
                         f"{r} AS coeficiente FROM behavior")
    return ",\ncorr AS (" + "\nUNION ALL\n".join(parts) + ")\n"


SQL["correlation_long"] = ("WITH " + BASE.strip() + _corr_long()
                           + "SELECT variable_x, variable_y, pos_x, pos_y, ROUND(coeficiente, 6) AS coeficiente "
                             "FROM corr")
_label_case = "CASE variable_x " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in zip(_CORR_VARS, _CORR_LABELS)) + " END"
SQL["correlation_target"] = ("WITH " + BASE.strip() + _corr_long() + f"""
SELECT {_label_case} AS variable, ROUND(coeficiente, 6) AS coeficiente,
       CASE WHEN coeficiente > 0.10 THEN 'Positiva' WHEN coeficiente < -0.10 THEN 'Negativa'
            ELSE 'Sin relación lineal clara' END AS direccion
FROM corr WHERE variable_y = 'abandono' AND variable_x <> 'abandono' AND coeficiente IS NOT NULL
ORDER BY abs(coeficiente) DESC, pos_x
""")

_TOPS = " UNION ALL ".join(
    f"""SELECT {i} AS orden, 'En los datos analizados se observa que el {lab} `' || categoria ||
              '` presenta la mayor tasa de abandono (' || printf('%.2f', round_even(tasa, 2)) || '%).' AS conclusion
       FROM (SELECT trim({c}) AS categoria,
                    CAST(sum(abandono) AS DOUBLE) / count(*) * 100 AS tasa
             FROM behavior WHERE {c} IS NOT NULL AND trim({c}) <> '' AND abandono IN (0, 1)
             GROUP BY trim({c}) ORDER BY tasa DESC, categoria LIMIT 1) t"""
    for i, (c, lab) in enumerate([("tipo_contrato", "contrato"), ("ciudad", "ciudad"), ("plan", "plan")]))
_DIFFS = " UNION ALL ".join(
    f"""SELECT {3 + i} AS orden,
              'Este resultado sugiere una asociacion descriptiva: la diferencia de {lab} entre quienes '
              || 'abandonaron y quienes permanecen es '
              || printf('%.2f', round_even(avg(CASE WHEN abandono = 1 THEN CAST({c} AS DOUBLE) END)
                                          - avg(CASE WHEN abandono = 0 THEN CAST({c} AS DOUBLE) END), 2))
              || ' puntos.' AS conclusion
       FROM behavior
       HAVING count(*) FILTER (WHERE abandono = 0) > 0 AND count(*) FILTER (WHERE abandono = 1) > 0"""
    for i, (c, lab) in enumerate([("satisfaccion", "satisfaccion promedio"),
                                  ("reclamos_ultimos_6_meses", "reclamos promedio")]))
register("conclusions", f"SELECT * FROM ({_TOPS} UNION ALL {_DIFFS}) x ORDER BY orden")

# further query families register themselves into SQL
from churnlens.plans import oracle_intake  # noqa: E402,F401
from churnlens.plans import oracle_integrity  # noqa: E402,F401
from churnlens.plans import oracle_model  # noqa: E402,F401
from churnlens.plans import oracle_segment  # noqa: E402,F401

SQL["view_scan"] = with_base("SELECT * FROM behavior ORDER BY id_cliente")
SQL["churn_by_city_display"] = with_base("""
SELECT ciudad AS "Ciudad", total_clientes AS "Total clientes", clientes_abandonaron AS "Abandonaron",
       round_even(tasa, 2) AS "Tasa abandono (%)"
FROM (SELECT trim(ciudad) AS ciudad, count(*) AS total_clientes, CAST(sum(abandono) AS BIGINT) AS clientes_abandonaron,
             COALESCE(CAST(sum(abandono) AS DOUBLE) / NULLIF(count(*), 0) * 100, 0.0) AS tasa
      FROM behavior WHERE ciudad IS NOT NULL AND trim(ciudad) <> '' AND abandono IN (0, 1)
      GROUP BY trim(ciudad)) x
""")
from churnlens.plans import oracle_flows, oracle_tree  # noqa: E402,F401
