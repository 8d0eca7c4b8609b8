"""DuckDB SQL for the split, class weights, deterministic baseline scores and risk reports."""

from __future__ import annotations

from churnlens.plans.oracle import BASE, SQL

EXTRA = """,
valid AS (
  SELECT * EXCLUDE (h), h < quantile_cont(h, 0.2) OVER (PARTITION BY abandono) + 0.5 AS es_prueba
  FROM (SELECT *, CAST(CAST(('0x' || substr(md5('42:' || id_cliente), 1, 8)) AS BIGINT) AS DOUBLE) AS h
        FROM behavior WHERE abandono IN (0, 1)) x
),
rates AS (
  SELECT ciudad, plan, avg(CAST(abandono AS DOUBLE)) AS p FROM behavior WHERE abandono IN (0, 1)
  GROUP BY ciudad, plan
),
raw_scores AS (
  SELECT b.id_cliente, coalesce(r.p, 0.0) AS p
  FROM behavior b LEFT JOIN rates r ON r.ciudad = b.ciudad AND r.plan = b.plan
),
scores AS (
  SELECT id_cliente, round_even(p, 4) AS probabilidad_churn,
         CASE WHEN p < 0.30 THEN 'bajo' WHEN p < 0.60 THEN 'medio' ELSE 'alto' END AS nivel_riesgo
  FROM raw_scores
)
"""


def with_scores(select: str) -> str:
    return "WITH " + BASE.strip() + EXTRA.rstrip() + "\n" + select.strip()


SQL["hash_split"] = with_scores("SELECT id_cliente, abandono, es_prueba FROM valid")
SQL["class_weights"] = with_scores("""
SELECT CAST(abandono AS INTEGER) AS abandono, count(*) AS n_clase,
       ROUND(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS peso
FROM valid WHERE NOT es_prueba GROUP BY abandono
""")
SQL["baseline_scores"] = with_scores("SELECT * FROM scores")
SQL["risk_distribution"] = with_scores("""
SELECT d.orden, d.nivel_riesgo, CAST(coalesce(c.n, 0) AS BIGINT) AS clientes
FROM (VALUES (0, 'bajo'), (1, 'medio'), (2, 'alto')) d(orden, nivel_riesgo)
LEFT JOIN (SELECT nivel_riesgo, count(*) AS n FROM scores GROUP BY nivel_riesgo) c USING (nivel_riesgo)
ORDER BY d.orden
""")
SQL["risk_summary"] = with_scores("""
SELECT clientes_evaluados, riesgo_alto, riesgo_medio, riesgo_bajo,
       ROUND(porcentaje_riesgo_alto, 6) AS porcentaje_riesgo_alto,
       ROUND(probabilidad_promedio, 6) AS probabilidad_promedio,
       replace(printf('%.2f %%', round_even(porcentaje_riesgo_alto, 2)), '.', ',') AS porcentaje_riesgo_alto_texto,
       replace(printf('%.2f %%', round_even(probabilidad_promedio, 2)), '.', ',') AS probabilidad_promedio_texto
FROM (
  SELECT count(*) AS clientes_evaluados,
         count(*) FILTER (WHERE nivel_riesgo = 'alto') AS riesgo_alto,
         count(*) FILTER (WHERE nivel_riesgo = 'medio') AS riesgo_medio,
         count(*) FILTER (WHERE nivel_riesgo = 'bajo') AS riesgo_bajo,
         coalesce(count(*) FILTER (WHERE nivel_riesgo = 'alto') / NULLIF(count(*), 0) * 100, 0.0)
           AS porcentaje_riesgo_alto,
         coalesce(avg(probabilidad_churn) * 100, 0.0) AS probabilidad_promedio
  FROM scores) x
""")
SQL["risk_table"] = with_scores("""
SELECT * FROM scores WHERE nivel_riesgo IN ('alto', 'medio')
ORDER BY probabilidad_churn DESC, id_cliente
""")
SQL["classification_metrics"] = with_scores("""
, train_rates AS (
  SELECT ciudad, plan, avg(CAST(abandono AS DOUBLE)) AS p FROM valid WHERE NOT es_prueba GROUP BY ciudad, plan
), pred AS (
  SELECT v.abandono AS y, CASE WHEN round_even(coalesce(r.p, 0.0), 4) >= 0.5 THEN 1 ELSE 0 END AS yhat
  FROM valid v LEFT JOIN train_rates r ON r.ciudad = v.ciudad AND r.plan = v.plan
  WHERE v.es_prueba
), c AS (
  SELECT count(*) FILTER (WHERE y = 1 AND yhat = 1) AS vp, count(*) FILTER (WHERE y = 0 AND yhat = 0) AS vn,
         count(*) FILTER (WHERE y = 0 AND yhat = 1) AS fp, count(*) FILTER (WHERE y = 1 AND yhat = 0) AS fn,
         count(*) AS n, avg(CAST(y AS DOUBLE)) AS rate
  FROM pred
)
SELECT vp, vn, fp, fn, n,
       round_even(coalesce((vp + vn) / NULLIF(n, 0), 0.0), 4) AS accuracy,
       round_even(coalesce(vp / NULLIF(vp + fn, 0), 0.0), 4) AS recall,
       round_even(coalesce(vp / NULLIF(vp + fp, 0), 0.0), 4) AS precision,
       round_even(coalesce(2 * vp / NULLIF(2 * vp + fp + fn, 0), 0.0), 4) AS f1,
       round_even(greatest(rate, 1 - rate), 4) AS linea_base
FROM c
""")
