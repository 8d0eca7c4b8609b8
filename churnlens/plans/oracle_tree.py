"""DuckDB SQL of the exact decision tree: every candidate split of every open node, level by level, and what follows."""

from __future__ import annotations

from churnlens.plans.oracle import SQL
from churnlens.plans.oracle_flows import CATEGORICAL, NUMERIC
from churnlens.plans.oracle_model import with_scores

DEPTH, LEAST = 4, 30

_MODES = ", ".join(f"(SELECT CAST({c} AS VARCHAR) FROM valid WHERE NOT es_prueba AND {c} IS NOT NULL GROUP BY 1 "
                   f"ORDER BY count(*) DESC, 1 LIMIT 1) AS m{i}" for i, c in enumerate(CATEGORICAL))
_MEDIANS = ", ".join(f"(SELECT coalesce(quantile_cont(CAST({c} AS DOUBLE), 0.5), 0) FROM valid WHERE NOT es_prueba) AS m{i}"
                     for i, c in enumerate(NUMERIC, len(CATEGORICAL)))
_CELLS = ", ".join([f"coalesce(CAST(b.{c} AS VARCHAR), m{i}, '') AS f{i}" for i, c in enumerate(CATEGORICAL)]
                   + [f"coalesce(CAST(b.{c} AS DOUBLE), m{i}) AS f{i}" for i, c in enumerate(NUMERIC, len(CATEGORICAL))])
_CATS = range(len(CATEGORICAL))
_NUMS = range(len(CATEGORICAL), len(CATEGORICAL) + len(NUMERIC))


def _side(rows: str, positives: str) -> str:
    a, b = f"(({rows}) - ({positives}))::DOUBLE * root.p::DOUBLE", f"({positives})::DOUBLE * (root.n - root.p)::DOUBLE"
    return f"((({a}) * ({a})) + (({b}) * ({b}))) / (({a}) + ({b}))"


def _level(d: int) -> str:
    open_rows = f"FROM l{d} WHERE train AND node >= {1 << d}"
    numbers = "\nUNION ALL ".join(f"SELECT node, {j} AS j, f{j} AS x, count(*) AS n, sum(y) AS p {open_rows} GROUP BY ALL" for j in _NUMS)
    texts = "\nUNION ALL ".join(f"SELECT node, {j} AS j, f{j} AS x, count(*) AS n, sum(y) AS p {open_rows} GROUP BY ALL" for j in _CATS)
    goes = " ".join([f"WHEN {j} THEN l.f{j} = b.cat" for j in _CATS] + [f"WHEN {j} THEN l.f{j} > b.thr" for j in _NUMS])
    return f""",
t{d} AS (SELECT node, count(*) AS n, sum(y) AS p {open_rows} GROUP BY node HAVING sum(y) > 0 AND sum(y) < count(*)),
u{d} AS ({numbers}),
c{d} AS (SELECT node, j, x, lead(x) OVER o AS nx, sum(n) OVER o AS n, sum(p) OVER o AS p FROM u{d}
         WINDOW o AS (PARTITION BY node, j ORDER BY x ROWS UNBOUNDED PRECEDING)),
g{d} AS ({texts}),
k{d} AS (
  SELECT node, j, CASE WHEN (x + nx) / 2 >= nx THEN x ELSE (x + nx) / 2 END AS thr, NULL::VARCHAR AS cat, c.n AS ln, c.p AS lp,
         t.n - c.n AS rn, t.p - c.p AS rp FROM c{d} c JOIN t{d} t USING (node) WHERE nx IS NOT NULL
  UNION ALL SELECT node, j, NULL, x, t.n - g.n, t.p - g.p, g.n, g.p FROM g{d} g JOIN t{d} t USING (node)),
b{d} AS MATERIALIZED (
  SELECT k.* FROM k{d} k, root WHERE ln >= {LEAST} AND rn >= {LEAST}
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY {_side('ln', 'lp')} + {_side('rn', 'rp')} DESC, j, thr, cat) = 1),
l{d + 1} AS MATERIALIZED (
  SELECT l.* REPLACE (CASE WHEN b.node IS NULL THEN l.node WHEN CASE b.j {goes} END THEN 2 * l.node + 1 ELSE 2 * l.node END AS node)
  FROM l{d} l LEFT JOIN b{d} b ON b.node = l.node)"""


TREE = f""",
m AS MATERIALIZED (SELECT {_MODES}, {_MEDIANS}),
l0 AS MATERIALIZED (
  SELECT b.id_cliente, v.abandono::BIGINT AS y, coalesce(NOT v.es_prueba, FALSE) AS train, v.es_prueba, {_CELLS}, 1::BIGINT AS node
  FROM behavior b LEFT JOIN valid v ON v.id_cliente = b.id_cliente, m),
root AS (SELECT count(*) AS n, sum(y) AS p FROM l0 WHERE train)""" + "".join(map(_level, range(DEPTH))) + f""",
leaf AS (SELECT node, count(*) AS n, sum(y) AS p FROM l{DEPTH} WHERE train GROUP BY node),
leaves AS (
  SELECT leaf.*, coalesce(leaf.p::DOUBLE * (root.n - root.p)
         / ((leaf.n - leaf.p)::DOUBLE * root.p + leaf.p::DOUBLE * (root.n - root.p)), 0.0) AS prob FROM leaf, root),
tree AS (SELECT l.*, leaves.prob FROM l{DEPTH} l JOIN leaves USING (node)),
tree_scored AS (
  SELECT id_cliente, round_even(prob, 4) AS probabilidad_churn,
         CASE WHEN prob < 0.30 THEN 'bajo' WHEN prob < 0.60 THEN 'medio' ELSE 'alto' END AS nivel_riesgo FROM tree)
"""


def with_tree(select: str) -> str:
    return with_scores(TREE + select)


SQL["tree_scores"] = with_tree("SELECT * FROM tree_scored")
SQL["registered_scores"] = with_tree("SELECT *, 'arbol_decision' AS modelo, 'v1' AS version_modelo FROM tree_scored")
SQL["tree_rules"] = with_tree("SELECT node::INT AS hoja, n AS filas, p::BIGINT AS positivos, round(prob, 9) AS probabilidad FROM leaves")
SQL["model_metrics"] = with_tree("""
, c AS (
  SELECT count(*) FILTER (WHERE y = 1 AND prob > 0.5) AS vp, count(*) FILTER (WHERE y = 0 AND prob <= 0.5) AS vn,
         count(*) FILTER (WHERE y = 0 AND prob > 0.5) AS fp, count(*) FILTER (WHERE y = 1 AND prob <= 0.5) AS fn,
         count(*) AS n, avg(y::DOUBLE) AS rate FROM tree WHERE es_prueba)
SELECT round_even(coalesce((vp + vn) / NULLIF(n, 0), 0.0), 4) AS accuracy, round_even(coalesce(vp / NULLIF(vp + fn, 0), 0.0), 4) AS recall,
       round_even(coalesce(vp / NULLIF(vp + fp, 0), 0.0), 4) AS precision,
       round_even(coalesce(2 * vp / NULLIF(2 * vp + fp + fn, 0), 0.0), 4) AS f1,
       round_even(greatest(rate, 1 - rate), 4) AS linea_base FROM c
""")
SQL["logistic_gradient"] = with_tree("\nUNION ALL\n".join(
    ["SELECT '' AS variable, '' AS valor, 0.0::DOUBLE AS gradiente"]
    + [f"SELECT '{c}', '', 0.0" for c in NUMERIC]
    + [f"SELECT DISTINCT '{c}', f{i}, 0.0 FROM l0 WHERE train" for i, c in enumerate(CATEGORICAL)]))
