"""DuckDB SQL for the segmentation reports (rule-based recency clusters) and scaled features."""

from __future__ import annotations

from churnlens.plans.oracle import BASE, SQL

FEATS = ["antiguedad_meses", "monto_mensual", "cantidad_servicios", "reclamos_ultimos_6_meses", "pagos_atrasados",
         "dias_sin_uso", "satisfaccion"]

EXTRA = """,
seg AS (
  SELECT *, CAST(CASE WHEN dias_sin_uso <= 30 THEN 0 WHEN dias_sin_uso <= 120 THEN 1 ELSE 2 END AS INTEGER)
              AS cluster_id
  FROM behavior
),
seg_l AS (SELECT *, 'Clúster ' || CAST(cluster_id + 1 AS VARCHAR) AS cluster FROM seg),
summary AS (
  SELECT cluster_id, cluster, count(*) AS total_clientes, """ + ", ".join(
    f"avg(CAST({c} AS DOUBLE)) AS {c}" for c in FEATS) + """
  FROM seg_l GROUP BY cluster_id, cluster
),
long AS (""" + "\nUNION ALL\n".join(
    f"SELECT cluster_id, {i} AS pos, '{c}' AS feature, {c} AS v FROM summary" for i, c in enumerate(FEATS)) + """),
ranked AS (
  SELECT *, min(v) OVER (PARTITION BY feature) AS lo, max(v) OVER (PARTITION BY feature) AS hi FROM long
),
traits AS (
  SELECT cluster_id, pos,
         CASE WHEN v = hi THEN 'mayor promedio de ' || feature WHEN v = lo THEN 'menor promedio de ' || feature END AS t
  FROM ranked WHERE v IS NOT NULL AND lo IS NOT NULL AND lo <> hi
),
top3 AS (
  SELECT cluster_id, string_agg(t, ', ' ORDER BY pos) AS rasgos_coma, string_agg(t, ' | ' ORDER BY pos) AS rasgos
  FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY pos) AS rn FROM traits WHERE t IS NOT NULL) x
  WHERE rn <= 3 GROUP BY cluster_id
)
"""


def with_seg(select: str) -> str:
    return "WITH " + BASE.strip() + EXTRA.rstrip() + "\n" + select.strip()


SQL["cluster_counts"] = with_seg("""
SELECT cluster_id, cluster, count(*) AS total_clientes FROM seg_l GROUP BY cluster_id, cluster ORDER BY cluster_id
""")
SQL["cluster_counts_fixed"] = with_seg("""
SELECT d.cluster, CAST(coalesce(c.n, 0) AS BIGINT) AS total_clientes
FROM (VALUES (0, 'Clúster 1'), (1, 'Clúster 2'), (2, 'Clúster 3')) d(o, cluster)
LEFT JOIN (SELECT cluster, count(*) AS n FROM seg_l GROUP BY cluster) c USING (cluster)
ORDER BY d.o
""")
SQL["cluster_summary"] = with_seg(
    "SELECT cluster_id, cluster, total_clientes, " + ", ".join(f"ROUND({c}, 6) AS {c}" for c in FEATS)
    + " FROM summary ORDER BY cluster_id")
SQL["cluster_churn"] = with_seg("""
SELECT cluster_id, cluster, count(*) AS total_clientes, CAST(sum(abandono) AS BIGINT) AS clientes_abandonaron,
       ROUND(coalesce(CAST(sum(abandono) AS DOUBLE) / NULLIF(count(*), 0) * 100, 0.0), 6) AS tasa_abandono
FROM seg_l WHERE abandono IN (0, 1) GROUP BY cluster_id, cluster ORDER BY cluster_id
""")
SQL["cluster_traits"] = with_seg("""
SELECT s.cluster_id, coalesce(t.rasgos, '') AS rasgos
FROM summary s LEFT JOIN top3 t USING (cluster_id)
""")
SQL["cluster_descriptions"] = with_seg("""
SELECT s.cluster_id,
       CASE WHEN t.rasgos_coma IS NOT NULL THEN
         s.cluster || ': agrupa ' || CAST(s.total_clientes AS VARCHAR)
         || ' clientes con valores relativos destacados en ' || t.rasgos_coma
         || '. Estas similitudes son matematicas y no implican causalidad ni jerarquia entre clusters.'
       ELSE s.cluster || ': agrupa ' || CAST(s.total_clientes AS VARCHAR)
         || ' clientes con patrones numericos similares. El numero del cluster no representa mayor o menor riesgo.'
       END AS descripcion
FROM summary s LEFT JOIN top3 t USING (cluster_id)
ORDER BY s.cluster_id
""")


def _scaled() -> str:
    med = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS med_{c}" for c in FEATS)
    imp = ", ".join(f"coalesce(CAST(b.{c} AS DOUBLE), m.med_{c}) AS {c}" for c in FEATS)
    mom = ", ".join(f"avg({c}) AS mean_{c}, stddev_pop({c}) AS sd_{c}" for c in FEATS)
    z = ", ".join(f"ROUND(CASE WHEN s.sd_{c} > 0 THEN (i.{c} - s.mean_{c}) / s.sd_{c} ELSE 0.0 END, 6) AS z_{c}"
                  for c in FEATS)
    return ("WITH " + BASE.strip() + f""",
meds AS (SELECT {med} FROM behavior),
imp AS (SELECT b.id_cliente, {imp} FROM behavior b, meds m),
mom AS (SELECT {mom} FROM imp)
SELECT i.id_cliente, {z} FROM imp i, mom s
""")


SQL["scaled_features"] = _scaled()


def _kmeans(select: str) -> str:
    """Lloyd's passes from the same first centres: a recursion whose row is one start with its three centres."""
    scaled = SQL["scaled_features"]
    head, tail = scaled[len("WITH "):].rsplit("\nSELECT i.id_cliente, ", 1)
    cells = ", ".join(f"CASE WHEN s.sd_{c} > 0 THEN (i.{c} - s.mean_{c}) / s.sd_{c} ELSE 0.0 END" for c in FEATS)
    means = ", ".join(f"avg(z[{i + 1}])" for i in range(len(FEATS)))
    near = "list_transform(cs, lambda x: list_distance(x, z))"
    return f"""WITH RECURSIVE {head},
pts AS MATERIALIZED (SELECT i.id_cliente, [{cells}]::DOUBLE[] AS z FROM imp i, mom s),
first AS (
  SELECT s, z, row_number() OVER (PARTITION BY s ORDER BY md5((42 + s)::VARCHAR || ':' || id_cliente), id_cliente) AS no
  FROM pts, range(10) starts(s)),
rec(it, s, cs, shift) AS (
  SELECT 0, s, list(z ORDER BY no), 1e9::DOUBLE FROM first WHERE no <= 3 GROUP BY s
  UNION ALL
  SELECT it + 1, s, ncs, list_sum(list_transform([1, 2, 3], lambda c: list_distance(cs[c], ncs[c]) ** 2))
  FROM (
    SELECT it, s, cs, [coalesce(any_value(m) FILTER (c = 1), cs[1]), coalesce(any_value(m) FILTER (c = 2), cs[2]),
                       coalesce(any_value(m) FILTER (c = 3), cs[3])] AS ncs
    FROM (
      SELECT it, s, cs, c, [{means}] AS m
      FROM (SELECT it, s, cs, z, list_position({near}, list_min({near})) AS c FROM rec, pts WHERE shift > 1e-4 AND it < 300) a
      GROUP BY it, s, cs, c) g
    GROUP BY it, s, cs) h),
ended AS (SELECT s, arg_max(cs, it) AS cs FROM rec GROUP BY s),
cost AS (SELECT s, any_value(cs) AS cs, sum(list_min({near}) ** 2) AS cost FROM ended, pts GROUP BY s),
best AS (SELECT list_sort(arg_min(cs, cost)) AS cs FROM cost),
labels AS (SELECT id_cliente, (list_position({near}, list_min({near})) - 1)::INT AS cluster_id FROM pts, best)
""" + select


SQL["kmeans_segments"] = _kmeans(
    "SELECT id_cliente, cluster_id, 'Clúster ' || CAST(cluster_id + 1 AS VARCHAR) AS cluster FROM labels")
SQL["kmeans_cluster_summary"] = _kmeans(
    "SELECT cluster_id, 'Clúster ' || CAST(cluster_id + 1 AS VARCHAR) AS cluster, count(*) AS total_clientes, "
    + ", ".join(f"ROUND(avg(CAST({c} AS DOUBLE)), 6) AS {c}" for c in FEATS)
    + " FROM behavior JOIN labels USING (id_cliente) GROUP BY cluster_id")
