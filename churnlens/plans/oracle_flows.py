"""DuckDB SQL for the queries that write and read back, count results or check model inputs."""

from __future__ import annotations

from churnlens.plans.oracle import SQL, with_base
from churnlens.plans.oracle_intake import COLS, with_intake
from churnlens.plans.oracle_model import with_scores

# The model's features in order, repeated so that the SQL is independent.
CATEGORICAL = ["ciudad", "tipo_contrato", "plan", "region"]
NUMERIC = ["antiguedad_meses", "monto_mensual", "reclamos_ultimos_6_meses", "pagos_atrasados", "dias_sin_uso",
           "satisfaccion", "edad", "cantidad_servicios"]

SQL["csv_round_trip"] = with_intake("", "SELECT " + ", ".join(
    "coalesce(nombre, '') || ' \"x\", y' || chr(10) || 'z' AS nombre" if c == "nombre" else f"nullif({c}, '') AS {c}"
    for c in COLS) + " FROM intake")

SQL["prediction_history"] = with_scores("""
SELECT id_cliente, probabilidad_churn, nivel_riesgo, 'base' AS modelo, v AS version_modelo,
       CAST(n AS BIGINT) AS filas, CAST(n AS BIGINT) AS corridas
FROM scores CROSS JOIN (VALUES ('v1', 2), ('v2', 1)) t(v, n)
""")

_RULES = {"check_probabilidad_0_1": "probabilidad_churn < 0 OR probabilidad_churn > 1",
          "check_nivel_valido": "nivel_riesgo NOT IN ('bajo', 'medio', 'alto')",
          "not_null_id_cliente": "id_cliente IS NULL", "not_null_probabilidad_churn": "probabilidad_churn IS NULL",
          "not_null_nivel_riesgo": "nivel_riesgo IS NULL", "not_null_modelo": "FALSE",
          "not_null_version_modelo": "FALSE", "not_null_fecha_prediccion": "FALSE", "pk_no_nulo": "id_cliente IS NULL",
          "fk_id_cliente": "id_cliente NOT IN (SELECT id_cliente FROM clientes)"}
SQL["history_integrity"] = with_scores("\nUNION ALL\n".join(
    [f"SELECT 'predicciones' AS tabla, '{r}' AS regla, count(*) FILTER (WHERE {p}) AS violaciones FROM scores"
     for r, p in _RULES.items()]
    + ["SELECT 'predicciones', 'pk_unico', count(id_cliente) - count(DISTINCT id_cliente) FROM scores"]))

SQL["published_customers"] = with_base("""
SELECT id_cliente, nombre, edad, ciudad, abandono FROM clientes ORDER BY id_cliente
""")

SQL["result_counts"] = with_base("""
SELECT 'todos' AS consulta, count(*) AS resultados FROM behavior
UNION ALL SELECT 'busqueda', count(*) FROM behavior
  WHERE contains(lower(id_cliente), '#000001') OR contains(lower(nombre), '#000001')
UNION ALL SELECT 'ciudades', count(*) FROM behavior
  WHERE ciudad IN ('NATION_1', 'NATION_7', 'NATION_13', 'NATION_21')
""")

SQL["view_contract"] = with_base("\nUNION ALL\n".join(
    f"SELECT {i} AS orden, '{c}' AS variable, {str(c in CATEGORICAL).upper()} AS categorica, count({c}) AS con_valor, "
    f"count(DISTINCT {c}) AS distintos, 0::BIGINT AS no_numericos FROM behavior" for i, c in enumerate(CATEGORICAL + NUMERIC)))

SQL["most_frequent"] = with_base("\nUNION ALL\n".join(
    f"SELECT '{c}' AS variable, (SELECT CAST({c} AS VARCHAR) FROM behavior WHERE {c} IS NOT NULL GROUP BY 1 "
    f"ORDER BY count(*) DESC, 1 LIMIT 1) AS moda" for c in CATEGORICAL))

SQL["model_features"] = with_scores(
    "SELECT v.id_cliente, " + ", ".join(
        f"ROUND((coalesce(CAST(v.{c} AS DOUBLE), m.m_{c}) - s.a_{c}) / CASE WHEN s.d_{c} > 1e-12 THEN s.d_{c} ELSE 1 END,"
        f" 6) AS z_{c}" for c in NUMERIC)
    + "\nFROM valid v, (SELECT " + ", ".join(f"coalesce(quantile_cont(CAST({c} AS DOUBLE), 0.5), 0) AS m_{c}"
                                             for c in NUMERIC) + " FROM valid WHERE NOT es_prueba) m, (SELECT "
    + ", ".join(f"avg(coalesce(CAST({c} AS DOUBLE), m_{c})) AS a_{c}, "
                f"stddev_pop(coalesce(CAST({c} AS DOUBLE), m_{c})) AS d_{c}" for c in NUMERIC)
    + " FROM valid, (SELECT " + ", ".join(f"coalesce(quantile_cont(CAST({c} AS DOUBLE), 0.5), 0) AS m_{c}"
                                          for c in NUMERIC) + " FROM valid WHERE NOT es_prueba) q WHERE NOT es_prueba) s")

SQL["kpi_texts"] = with_base("""
SELECT replace(format('{:,}', count(*)), ',', '.') AS entero,
       printf('%.2f', avg(CAST(abandono AS DOUBLE)) * 100) || '%' AS porcentaje,
       printf('%.2f', avg(CAST(satisfaccion AS DOUBLE))) AS promedio,
       '$' || replace(format('{:,}', CAST(round(CAST(sum(CAST(monto_mensual AS DECIMAL(38, 6))) AS DOUBLE), 0) AS BIGINT)),
                      ',', '.') AS monto
FROM behavior
""")

SQL["validated_intake"] = ("SELECT -1 AS orden, 'true' AS mensaje UNION ALL SELECT orden, mensaje FROM (\n"
                           + SQL["quality_report"] + "\n) q WHERE mensaje IS NOT NULL")

# two batches and a moved reference date end where the full derivation does
SQL["merged_behavior"] = with_base("SELECT * FROM behavior")

SQL["csv_by_splits"] = SQL["csv_round_trip"]

# customers, contracts and payments as the gates' rules let them pass
SQL["published_operational"] = with_base("""
, k AS (SELECT * FROM contratos WHERE id_servicio IN (SELECT id_servicio FROM servicios)
        QUALIFY count(*) OVER (PARTITION BY id_contrato) = 1),
one AS (SELECT id_cliente FROM k WHERE estado = 'activo' AND es_principal = 1 GROUP BY 1 HAVING count(*) = 1),
c AS (SELECT * FROM clientes SEMI JOIN one USING (id_cliente) WHERE satisfaccion IS NOT NULL),
f AS (SELECT * FROM facturas QUALIFY count(*) OVER (PARTITION BY id_factura) = 1),
p AS (SELECT * FROM pagos QUALIFY count(*) OVER (PARTITION BY id_pago) = 1),
e AS (SELECT user_id::VARCHAR AS id_cliente FROM events QUALIFY count(*) OVER (PARTITION BY event_id) = 1)
SELECT id_cliente, nombre, edad, ciudad, abandono,
       (SELECT count(*) FROM k WHERE k.id_cliente = c.id_cliente) AS contratos,
       (SELECT count(*) FROM f WHERE f.id_cliente = c.id_cliente) AS facturas,
       (SELECT count(*) FROM p JOIN f USING (id_factura) WHERE f.id_cliente = c.id_cliente) AS pagos,
       (SELECT count(*) FROM e WHERE e.id_cliente = c.id_cliente) AS interacciones
FROM c
""")

# CSV and publication change nothing: the cleaned rows of the intake
SQL["published_intake"] = SQL["clean_rows"]
