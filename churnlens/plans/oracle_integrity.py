"""DuckDB SQL for the integrity queries (C6-C9, D14) over the re-derived churn tables."""

from __future__ import annotations

from churnlens.plans.oracle import BASE, SQL

# tables beyond BASE (full column sets used by the checks)
EXTRA = """,
parametros AS (SELECT 1 AS id, t AS fecha_referencia FROM params),
pagos_full AS (
  SELECT line_key AS id_pago, l_orderkey AS id_factura, l_extendedprice AS monto_pagado,
         CASE WHEN datediff('day', order_d, ship_d) - 30 > 0 THEN 'atrasado' ELSE 'a_tiempo' END AS estado,
         CAST(greatest(datediff('day', order_d, ship_d) - 30, 0) AS INTEGER) AS dias_atraso
  FROM lo
),
interacciones AS (
  SELECT event_id AS id_interaccion, CAST(user_id AS VARCHAR) AS id_cliente, value AS duracion_min FROM events
)
"""


def with_tables(select: str) -> str:
    return "WITH " + BASE.strip() + EXTRA.rstrip() + "\n" + select.strip()


FKS = [("clientes", "id_sucursal", "sucursales", "id_sucursal"),
       ("contratos", "id_cliente", "clientes", "id_cliente"),
       ("contratos", "id_servicio", "servicios", "id_servicio"),
       ("facturas", "id_cliente", "clientes", "id_cliente"),
       ("pagos_full", "id_factura", "facturas", "id_factura"),
       ("reclamos", "id_cliente", "clientes", "id_cliente"),
       ("reclamos", "id_sucursal", "sucursales", "id_sucursal"),
       ("interacciones", "id_cliente", "clientes", "id_cliente")]

SQL["fk_orphans"] = with_tables("\nUNION ALL\n".join(
    f"""SELECT '{c.replace('_full', '')}' AS tabla, '{col}' AS columna, '{p}' AS tabla_padre,
       CAST(count(*) AS BIGINT) AS huerfanos
FROM {c} x WHERE x.{col} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} y WHERE y.{k} = x.{col})"""
    for c, col, p, k in FKS))


def _rules(table: str, src: str, checks: list[tuple[str, str]], not_null: list[str], pk: str,
           unique: list[str] = (), principal: bool = False) -> str:
    parts = []
    for name, pred in checks:
        parts.append((f"check_{name}", f"count(*) FILTER (WHERE NOT coalesce({pred}, TRUE))"))
    for c in not_null:
        parts.append((f"not_null_{c}", f"count(*) FILTER (WHERE {c} IS NULL)"))
    parts.append(("pk_no_nulo", f"count(*) FILTER (WHERE {pk} IS NULL)"))
    parts.append(("pk_unico", f"count({pk}) - count(DISTINCT {pk})"))
    for u in unique:
        parts.append((f"unico_{u}", f"count({u}) - count(DISTINCT {u})"))
    if principal:
        parts.append(("un_principal_activo",
                      "count(*) FILTER (WHERE es_principal = 1 AND estado = 'activo') - "
                      "count(DISTINCT CASE WHEN es_principal = 1 AND estado = 'activo' THEN id_cliente END)"))
    return "\nUNION ALL\n".join(f"SELECT '{table}' AS tabla, '{r}' AS regla, CAST({e} AS BIGINT) AS violaciones "
                                f"FROM {src}" for r, e in parts)


SQL["check_violations"] = with_tables("\nUNION ALL\n".join([
    _rules("parametros", "parametros", [("id_es_1", "id = 1")], ["fecha_referencia"], "id"),
    _rules("sucursales", "sucursales", [], ["nombre"], "id_sucursal"),
    _rules("servicios", "servicios", [("precio_no_negativo", "precio_mensual >= 0")],
           ["codigo", "nombre", "precio_mensual"], "id_servicio", ["codigo"]),
    _rules("clientes", "clientes",
           [("edad_0_120", "edad IS NULL OR edad BETWEEN 0 AND 120"),
            ("antiguedad_no_negativa", "antiguedad_meses IS NULL OR antiguedad_meses >= 0"),
            ("satisfaccion_1_5", "satisfaccion BETWEEN 1 AND 5"),
            ("dias_sin_uso_no_negativo", "dias_sin_uso IS NULL OR dias_sin_uso >= 0"),
            ("abandono_0_1", "abandono IN (0, 1)")], ["satisfaccion", "abandono"], "id_cliente"),
    _rules("contratos", "contratos",
           [("monto_no_negativo", "monto_mensual >= 0"), ("es_principal_0_1", "es_principal IN (0, 1)")],
           ["id_cliente", "id_servicio", "estado", "monto_mensual", "es_principal"], "id_contrato",
           principal=True),
    _rules("facturas", "facturas", [("monto_no_negativo", "monto_facturado IS NULL OR monto_facturado >= 0")],
           ["id_cliente"], "id_factura"),
    _rules("pagos", "pagos_full",
           [("monto_no_negativo", "monto_pagado IS NULL OR monto_pagado >= 0"),
            ("estado_valido", "estado IS NULL OR estado IN ('a_tiempo', 'atrasado')"),
            ("dias_atraso_no_negativo", "dias_atraso IS NULL OR dias_atraso >= 0")], ["id_factura"], "id_pago"),
    _rules("reclamos", "reclamos", [], ["id_cliente"], "id_reclamo"),
    _rules("interacciones", "interacciones",
           [("duracion_no_negativa", "duracion_min IS NULL OR duracion_min >= 0")], ["id_cliente"],
           "id_interaccion"),
]))

SQL["customers_without_principal"] = with_tables("""
SELECT c.id_cliente FROM clientes c
WHERE NOT EXISTS (SELECT 1 FROM contratos co WHERE co.id_cliente = c.id_cliente
                  AND co.es_principal = 1 AND co.estado = 'activo')
""")
SQL["duplicate_principals"] = with_tables("""
SELECT id_cliente, count(*) AS principales FROM contratos
WHERE es_principal = 1 AND estado = 'activo' GROUP BY id_cliente HAVING count(*) > 1
""")
SQL["principal_rule"] = with_tables("""
SELECT s AS sin_principal, d AS con_mas_de_uno, s = 0 AND d = 0 AS valido,
       CASE WHEN NOT (s = 0 AND d = 0) THEN
         'Integridad de contratos: ' || CAST(s AS VARCHAR) || ' cliente(s) sin contrato principal activo y '
         || CAST(d AS VARCHAR) || ' con mas de uno. Se esperaba exactamente uno por cliente.' END AS mensaje
FROM (SELECT
  (SELECT count(*) FROM clientes c WHERE NOT EXISTS (SELECT 1 FROM contratos co WHERE co.id_cliente = c.id_cliente
     AND co.es_principal = 1 AND co.estado = 'activo')) AS s,
  (SELECT count(*) FROM (SELECT id_cliente FROM contratos WHERE es_principal = 1 AND estado = 'activo'
     GROUP BY id_cliente HAVING count(*) > 1) x) AS d) z
""")
