"""Referential integrity, CHECK / NOT NULL / UNIQUE report, principal-contract rule.

The relational store rejected bad rows; Spark tables do not, so every
constraint becomes a *count of violations* computed declaratively.

Scale notes: each foreign key is checked on the child's *distinct key
values with counts* (a partial aggregate, so a hot key costs one row per map
task), anti-joined with the parent's keys; the per-table rules are one
aggregate per table.
"""

from __future__ import annotations

import os
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens import config, schemas
from churnlens.session import ensure_checkpoint_dir

# CHECK rules as SQL predicates (a row violates a CHECK only when the
# predicate is FALSE; NULL passes, as in SQL) and NOT NULL columns.
CHECKS = {
    "parametros": [("id_es_1", "id = 1")],
    "servicios": [("precio_no_negativo", "precio_mensual >= 0")],
    "clientes": [("edad_0_120", "edad IS NULL OR edad BETWEEN 0 AND 120"),
                 ("antiguedad_no_negativa", "antiguedad_meses IS NULL OR antiguedad_meses >= 0"),
                 ("satisfaccion_1_5", "satisfaccion BETWEEN 1 AND 5"),
                 ("dias_sin_uso_no_negativo", "dias_sin_uso IS NULL OR dias_sin_uso >= 0"),
                 ("abandono_0_1", "abandono IN (0, 1)")],
    "contratos": [("monto_no_negativo", "monto_mensual >= 0"), ("es_principal_0_1", "es_principal IN (0, 1)")],
    "facturas": [("monto_no_negativo", "monto_facturado IS NULL OR monto_facturado >= 0")],
    "pagos": [("monto_no_negativo", "monto_pagado IS NULL OR monto_pagado >= 0"),
              ("estado_valido", "estado IS NULL OR estado IN ('a_tiempo', 'atrasado')"),
              ("dias_atraso_no_negativo", "dias_atraso IS NULL OR dias_atraso >= 0")],
    "interacciones": [("duracion_no_negativa", "duracion_min IS NULL OR duracion_min >= 0")],
    "predicciones": [("probabilidad_0_1", "probabilidad_churn BETWEEN 0 AND 1"),
                     ("nivel_valido", "nivel_riesgo IN ('bajo', 'medio', 'alto')")],
}
NOT_NULL = {
    "parametros": ["fecha_referencia"],
    "sucursales": ["nombre"],
    "servicios": ["codigo", "nombre", "precio_mensual"],
    "clientes": ["satisfaccion", "abandono"],
    "contratos": ["id_cliente", "id_servicio", "estado", "monto_mensual", "es_principal"],
    "facturas": ["id_cliente"],
    "pagos": ["id_factura"],
    "reclamos": ["id_cliente"],
    "interacciones": ["id_cliente"],
    "predicciones": ["id_cliente", "probabilidad_churn", "nivel_riesgo", "modelo", "version_modelo",
                     "fecha_prediccion"],
}
UNIQUE = {"servicios": [["codigo"]]}
REPORT_SCHEMA = "tabla string, regla string, violaciones bigint"


def rule_column(rule: str, pred: str) -> str:
    """The column a CHECK predicate constrains (its first identifier)."""
    return pred.split()[0]


def _principal_active(contratos: DataFrame) -> Column:
    return (F.col("es_principal") == 1) & (F.col("estado") == "activo")


def fk_orphans(tables: dict[str, DataFrame], foreign_keys=schemas.FOREIGN_KEYS) -> DataFrame:
    """(tabla, columna, tabla_padre, huerfanos) for every FK whose tables are given."""
    parts = []
    for child, col, parent, key in foreign_keys:
        if child not in tables or parent not in tables or col not in tables[child].columns:
            continue
        keys = (tables[child].filter(F.col(col).isNotNull())
                .groupBy(F.col(col).alias("_k")).agg(F.count(F.lit(1)).alias("_n")))
        parent_keys = tables[parent].select(F.col(key).alias("_k"))
        orphan = keys.join(parent_keys, "_k", "left_anti")
        parts.append(orphan.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("huerfanos"))
                     .select(F.lit(child).alias("tabla"), F.lit(col).alias("columna"),
                             F.lit(parent).alias("tabla_padre"), "huerfanos"))
    return reduce(DataFrame.unionByName, parts)


def _count_rules(name: str, df: DataFrame) -> list[tuple[str, Column]]:
    """Rules of a table that one pass of counters answers: CHECK, NOT NULL, primary key not null."""
    rules = [(f"check_{rule}", F.count_if(~F.coalesce(F.expr(pred), F.lit(True))))
             for rule, pred in CHECKS.get(name, []) if rule_column(rule, pred) in df.columns]
    rules += [(f"not_null_{c}", F.count_if(F.col(c).isNull())) for c in NOT_NULL.get(name, []) if c in df.columns]
    pk = schemas.PRIMARY_KEYS.get(name)
    if pk and all(c in df.columns for c in pk):
        rules.append(("pk_no_nulo", F.count_if(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in pk]))))
    return rules


def _key_rules(name: str, df: DataFrame) -> list[tuple[str, DataFrame]]:
    """Rules on repeated keys, each with the non-null key rows it looks at."""
    keys = [("pk_unico", schemas.PRIMARY_KEYS.get(name) or [])]
    keys += [("unico_" + "_".join(cols), cols) for cols in UNIQUE.get(name, [])]
    out = [(rule, df.select(*cols).dropna()) for rule, cols in keys if cols and all(c in df.columns for c in cols)]
    if name == "contratos":
        # partial unique index: at most one active principal per customer
        out.append(("un_principal_activo", df.filter(_principal_active(df)).select("id_cliente")))
    return out


def row_violations(name: str, df: DataFrame) -> DataFrame:
    """The row rules of C8 for one table: counters in one aggregate, as (tabla, regla, violaciones)."""
    rules = _count_rules(name, df)
    one = df.agg(*[c.alias(r) for r, c in rules])
    items = F.array(*[F.struct(F.lit(r).alias("regla"), F.col(r).cast("bigint").alias("violaciones"))
                      for r, _ in rules])
    return one.select(F.lit(name).alias("tabla"), F.explode(items).alias("x")).select("tabla", "x.*")


def key_violations(name: str, df: DataFrame) -> DataFrame | None:
    """The key rules of C8 for one table: rows beyond the first of a key, one narrow aggregate per key."""
    parts = [keys.groupBy(*keys.columns).agg(F.count(F.lit(1)).alias("n"))
             .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("violaciones"))
             .select(F.lit(name).alias("tabla"), F.lit(rule).alias("regla"), "violaciones")
             for rule, keys in _key_rules(name, df)]
    return reduce(DataFrame.unionByName, parts) if parts else None


def table_violations(name: str, df: DataFrame) -> DataFrame:
    """C8 for one table as (tabla, regla, violaciones); counters and key checks never share a shuffle."""
    keys = key_violations(name, df)
    if not _count_rules(name, df):
        return keys
    rows = row_violations(name, df)
    return rows if keys is None else rows.unionByName(keys)


def check_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """C8 over every given table."""
    return reduce(DataFrame.unionByName, [table_violations(n, df) for n, df in tables.items()
                                          if n in CHECKS or n in NOT_NULL or n in schemas.PRIMARY_KEYS])


def customers_without_principal(clientes: DataFrame, contratos: DataFrame) -> DataFrame:
    """Customers with no active principal contract (NOT EXISTS -> left anti join)."""
    principals = contratos.filter(_principal_active(contratos)).select("id_cliente")
    return clientes.join(principals, "id_cliente", "left_anti")


def duplicate_principals(contratos: DataFrame) -> DataFrame:
    """Customers with more than one active principal contract (GROUP BY ... HAVING)."""
    return (contratos.filter(_principal_active(contratos)).groupBy("id_cliente")
            .agg(F.count(F.lit(1)).alias("principales")).filter(F.col("principales") > 1))


def principal_rule(clientes: DataFrame, contratos: DataFrame) -> DataFrame:
    """One row (sin_principal, con_mas_de_uno, valido, mensaje)."""
    sin = customers_without_principal(clientes, contratos).agg(F.count(F.lit(1)).alias("sin_principal"))
    dup = duplicate_principals(contratos).agg(F.count(F.lit(1)).alias("con_mas_de_uno"))
    pre, rest = config.PRINCIPAL_MESSAGE.split("{sin}")
    mid, post = rest.split("{dup}")
    sin_v, dup_v = sin.scalar(), dup.scalar()
    ok = (sin_v == 0) & (dup_v == 0)
    return clientes.sparkSession.range(1).select(
        sin_v.alias("sin_principal"), dup_v.alias("con_mas_de_uno"), ok.alias("valido"),
        F.when(~ok, F.concat(F.lit(pre), sin_v.cast("string"), F.lit(mid), dup_v.cast("string"),
                             F.lit(post))).alias("mensaje"))


def _keeping_rules(name: str, df: DataFrame) -> DataFrame:
    """The rows of a table that break no row rule and share no key with another row."""
    preds = [F.coalesce(F.expr(pred), F.lit(True)) for rule, pred in CHECKS.get(name, [])
             if rule_column(rule, pred) in df.columns]
    filled = set(NOT_NULL.get(name, [])) | set(schemas.PRIMARY_KEYS.get(name, []))
    preds += [F.col(c).isNotNull() for c in sorted(filled) if c in df.columns]
    rows = df.where(reduce(lambda a, b: a & b, preds)) if preds else df
    for rule, keys in _key_rules(name, df):
        if rule != "un_principal_activo":  # ``admissible`` looks at the customer for that
            again = keys.groupBy(*keys.columns).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
            rows = rows.join(again, keys.columns, "left_anti")
    return rows.select(*df.columns)


def _kept(name: str, df: DataFrame) -> DataFrame:
    """``df`` written to ``spark.checkpoint.dir`` and read back: columns that a reader does not ask for stay on disk."""
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), "admissible", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def admissible(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The rows that a reload's gates (C7, C8, C9) let pass; the rest is what has to be set aside.

    Rows that break a rule or repeat a key go (all rows of that key, as none is known to be the right one), then
    rows that refer to rows that are gone, customers without exactly one active principal contract, and what refers
    to those.  Nothing is repaired.  Tables that others refer to are kept as parquet (``spark.checkpoint.dir``).
    """
    out = {n: _keeping_rules(n, df) for n, df in tables.items()}

    def refer(parents) -> None:
        for child, col, parent, key in schemas.FOREIGN_KEYS:
            if parent in parents and child in out and parent in out and col in out[child].columns:
                there = out[parent].select(F.col(key).alias("_k"))
                fits = out[child].join(there, F.col(col) == F.col("_k"), "left_semi")
                # rows without a reference stay; where the column must be filled there are none left to look for
                out[child] = fits if col in NOT_NULL.get(child, []) else fits.unionByName(
                    out[child].where(F.col(col).isNull()))

    refer(("sucursales", "servicios"))
    if "clientes" in out and "contratos" in out:
        out["contratos"] = _kept("contratos", out["contratos"])  # read by the rule, the customers and all that refer to them
        one = (out["contratos"].filter(_principal_active(out["contratos"])).groupBy("id_cliente")
               .agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select("id_cliente"))
        out["clientes"] = _kept("clientes", out["clientes"].join(one, "id_cliente", "left_semi")
                                .select(*tables["clientes"].columns))
    refer(("clientes",))
    if "facturas" in out and "pagos" in out:
        out["facturas"] = _kept("facturas", out["facturas"])
    refer(("facturas",))
    return out


def assert_integrity(tables: dict[str, DataFrame]) -> None:
    """C7 and C8 as a gate over the given tables: raise with the rules that fail."""
    bad = [f"{r['tabla']}.{r['regla']} ({r['violaciones']})"
           for r in check_violations(tables).filter("violaciones > 0").collect()]  # a few rules
    if any(c in tables and p in tables for c, _, p, _ in schemas.FOREIGN_KEYS):
        bad += [f"{r['tabla']}.{r['columna']} -> {r['tabla_padre']} ({r['huerfanos']})"
                for r in fk_orphans(tables).filter("huerfanos > 0").collect()]
    if bad:
        raise ValueError("integrity: " + ", ".join(bad))


def assert_principal_rule(clientes: DataFrame, contratos: DataFrame) -> None:
    """C9 as a gate: raise with the reference message when the rule fails."""
    row = principal_rule(clientes, contratos).first()
    if not row["valido"]:
        raise ValueError(row["mensaje"])
