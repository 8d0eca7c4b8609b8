"""D4 kept current: per-customer states by day, merged with each batch of facts and moved with the reference date.

The view's facts are sums, so they merge and subtract: complaints and late payments per (customer, day), active
contracts per (customer, service, type, principal).  A batch adds its own sums; a row with ``signo`` -1 takes a
fact back that an earlier batch gave (a closed contract, a corrected payment).  The windowed counts of the last
batch move to the new window by the days that enter it and those that leave it; no other day is read.  Contract
columns are derived anew only for customers whose contracts or services changed.

The state lies under one root: every batch writes folders of its own and then one commit that names them
(``sources.commits``), so a batch counts whole or not at all, two writers lose nothing, and a reader's state stays
until ``vacuum``.  ``compact`` sums the batches' folders into one.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens import config
from churnlens.plans import behavior
from churnlens.sources import commits

#: Sums kept per batch: name -> (key columns, summed columns).
STATES = {
    "dias": (["id_cliente", "dia"], ["reclamos", "atrasos"]),
    "contratos": (["id_cliente", "id_servicio", "tipo_contrato", "es_principal"], ["n", "monto"]),
    "facturas": (["id_factura", "id_cliente", "fecha_emision"], ["n"]),
    "atrasados": (["id_factura"], ["n"]),
}
#: Tables written whole by every batch: one row per customer, or the small services table.
CURRENT = ("ventana", "contrato_vigente", "servicios")
#: Batches whose folders are read side by side before they are summed into one.
COMPACT_AFTER = 16
SIGN = "signo"


@dataclass
class FactBatch:
    """New fact rows in the schemas of the operational tables; a column ``signo`` (-1: taken back) is optional."""
    contratos: DataFrame
    reclamos: DataFrame
    facturas: DataFrame
    pagos: DataFrame


def _sign(df: DataFrame):
    taken = F.coalesce(F.col(SIGN) < 0, F.lit(False)) if SIGN in df.columns else F.lit(False)
    return F.when(taken, -1).otherwise(1).cast("long")


def _sums(rows: DataFrame, state: str) -> DataFrame:
    """Rows summed per key; keys whose sums are all zero go."""
    keys, values = STATES[state]
    out = rows.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])
    if "monto" in values:
        out = out.withColumn("monto", F.col("monto").cast(f"decimal(38,{behavior.MONEY_SCALE})"))
    return out.where(" OR ".join(f"{v} <> 0" for v in values))


def _batch_state(spark: SparkSession, root: str, content: dict, state: str) -> DataFrame | None:
    """The folders of a state side by side, not yet summed over batches."""
    folders = content.get(state, [])
    return spark.read.parquet(*[os.path.join(root, f) for f in folders]) if folders else None


def read_state(spark: SparkSession, root: str, state: str, content: dict | None = None) -> DataFrame | None:
    """A state summed over all batches; None before the first.  A lone folder holds sums already."""
    content = commits.latest(spark, root)[1] if content is None else content
    rows = _batch_state(spark, root, content, state)
    return rows if rows is None or len(content[state]) == 1 else _sums(rows, state)


def _write(df: DataFrame, root: str, kind: str, sort: str | None = None) -> str:
    folder = commits.new_folder(kind)
    (df.sortWithinPartitions(sort) if sort else df).write.parquet(os.path.join(root, folder))
    return folder


def _contract_sums(batch: FactBatch) -> DataFrame:
    c, s = batch.contratos, _sign(batch.contratos)
    amount = F.col("monto_mensual").cast(f"decimal(38,{behavior.MONEY_SCALE})")
    return _sums(c.where(F.col("estado") == "activo").select(
        "id_cliente", "id_servicio", "tipo_contrato", F.coalesce(F.col("es_principal") == 1, F.lit(False))
        .alias("es_principal"), s.alias("n"), F.when(s < 0, -amount).otherwise(amount).alias("monto")), "contratos")


def _late_pairs(invoices: DataFrame, late: DataFrame) -> DataFrame:
    """Late payments per (customer, day of issue) of matching invoices and payment counts."""
    return invoices.withColumnRenamed("n", "veces").join(late, "id_factura").select(
        "id_cliente", F.col("fecha_emision").alias("dia"), F.lit(0).cast("long").alias("reclamos"),
        (F.col("veces") * F.col("n")).alias("atrasos"))


def _window(spark: SparkSession, ref: str) -> tuple[str, str]:
    """First and last day of the window that ends at ``ref`` (H4)."""
    row = spark.range(1).select(F.add_months(F.lit(ref).cast("date"), -config.WINDOW_MONTHS).alias("since")).first()
    return str(row["since"]), ref


def _weight(old: tuple[str, str] | None, new: tuple[str, str]):
    """(condition, weight) of the days that enter (+1) or leave (-1) when the window moves; the rest are not read."""
    def inside(w):
        return F.col("dia").between(F.lit(w[0]).cast("date"), F.lit(w[1]).cast("date"))

    def beyond(w):  # two plain comparisons, which the scan takes as filters
        return (F.col("dia") < F.lit(w[0]).cast("date")) | (F.col("dia") > F.lit(w[1]).cast("date"))

    if old is None:
        return inside(new), F.lit(1)
    return (inside(new) & beyond(old)) | (inside(old) & beyond(new)), F.when(inside(new), 1).otherwise(-1)


def moved_days(spark: SparkSession, root: str, content: dict, new: tuple[str, str]) -> DataFrame | None:
    """Signed counts of the stored days that enter or leave when the last batch's window becomes ``new``."""
    rows = _batch_state(spark, root, content, "dias")
    if rows is None:
        return None
    keep, weight = _weight(tuple(content["ventana_dias"]), new)
    return rows.where(keep).select("id_cliente", (F.col("reclamos") * weight).alias("reclamos"),
                                   (F.col("atrasos") * weight).alias("atrasos"))


def _contract_rows(state: DataFrame, servicios: DataFrame) -> DataFrame:
    """The view's contract columns per customer from summed contract states."""
    active = state.where("n > 0").join(servicios.withColumnRenamed("nombre", "plan"), "id_servicio")
    totals = active.groupBy("id_cliente").agg(F.sum("monto").cast("double").alias("monto_mensual"),
                                              F.sum("n").alias("cantidad_servicios"))
    chosen = active.where("es_principal").select("id_cliente", "tipo_contrato", "plan")
    plans = servicios.select(F.col("nombre").alias("plan"))
    return totals.join(behavior.principal_texts(chosen, plans), "id_cliente", "left")


def _merge(spark: SparkSession, root: str, content: dict, batch: FactBatch, servicios: DataFrame, ref: str) -> dict:
    out = dict(content)
    new = _window(spark, ref)

    def add(state: str, rows: DataFrame, sort: str | None = None) -> DataFrame:
        folder = _write(rows, root, state, sort)
        out[state] = [*content.get(state, []), folder]
        return spark.read.parquet(os.path.join(root, folder))

    # late payments: pairs of the new with all, then of the old payments with the new invoices
    issued = add("facturas", _sums(batch.facturas.select(
        "id_factura", "id_cliente", "fecha_emision", _sign(batch.facturas).alias("n")), "facturas"))
    late = add("atrasados", _sums(batch.pagos.where(F.col("estado") == "atrasado").select(
        "id_factura", _sign(batch.pagos).alias("n")), "atrasados"))
    pairs = _late_pairs(issued, late)
    old_issued, old_late = (_batch_state(spark, root, content, s) for s in ("facturas", "atrasados"))
    if old_issued is not None:
        pairs = pairs.unionByName(_late_pairs(old_issued, late)).unionByName(_late_pairs(issued, old_late))
    complaints = batch.reclamos.select("id_cliente", F.col("fecha").alias("dia"),
                                       _sign(batch.reclamos).alias("reclamos"), F.lit(0).cast("long").alias("atrasos"))
    days = add("dias", _sums(complaints.unionByName(pairs), "dias").repartitionByRange("dia", "id_cliente"), "dia")

    # the window: last counts, days that enter or leave, and the batch's own days
    inside, _ = _weight(None, new)
    counts = days.where(inside).select("id_cliente", "reclamos", "atrasos")
    moved = moved_days(spark, root, content, new) if content else None
    if moved is not None:
        last = spark.read.parquet(os.path.join(root, content["ventana"]))
        counts = last.unionByName(moved).unionByName(counts)
    out["ventana"] = _write(counts.groupBy("id_cliente").agg(F.sum("reclamos").alias("reclamos"),
                                                             F.sum("atrasos").alias("atrasos"))
                            .where("reclamos <> 0 OR atrasos <> 0"), root, "ventana")
    out["ventana_dias"] = list(new)

    # contracts: only customers with new contract facts, or with a contract on a service that changed
    svc = servicios.select("id_servicio", "nombre")
    out["servicios"] = _write(svc, root, "servicios")
    svc = spark.read.parquet(os.path.join(root, out["servicios"]))
    fresh = add("contratos", _contract_sums(batch))
    state = read_state(spark, root, "contratos", out)
    if content:
        before = spark.read.parquet(os.path.join(root, content["servicios"]))
        changed = before.exceptAll(svc).unionByName(svc.exceptAll(before)).select("id_servicio").distinct()
        touched = fresh.select("id_cliente").unionByName(
            state.join(changed, "id_servicio", "left_semi").select("id_cliente")).distinct()
        rows = _contract_rows(state.join(touched, "id_cliente", "left_semi"), svc)
        kept = spark.read.parquet(os.path.join(root, content["contrato_vigente"]))
        rows = kept.join(touched, "id_cliente", "left_anti").unionByName(rows)
    else:
        rows = _contract_rows(state, svc)
    out["contrato_vigente"] = _write(rows, root, "contrato_vigente")
    out["lotes"] = content.get("lotes", 0) + 1
    return out


def apply_batch(spark: SparkSession, root: str, batch: FactBatch, servicios: DataFrame, ref_date) -> dict:
    """Merge a batch of facts and move the window to ``ref_date`` (earlier or later); returns the new commit.

    Facts may come in any order: a payment before its invoice counts once the invoice is there.  Null keys are kept
    and join nothing, as in the view.  An empty batch only moves the window.  If anything fails nothing changes.
    """
    content = commits.update(spark, root, lambda c: _merge(spark, root, c, batch, servicios, str(ref_date)))
    return compact(spark, root) if len(content["dias"]) > COMPACT_AFTER else content


def compact(spark: SparkSession, root: str) -> dict:
    """Sum the batches' folders of every state into one; the state itself does not change."""
    def merged(content: dict) -> dict:
        out = dict(content)
        for state in STATES:
            rows = read_state(spark, root, state, content)
            if rows is not None:
                if state == "dias":
                    rows = rows.repartitionByRange("dia", "id_cliente")
                out[state] = [_write(rows, root, state, "dia" if state == "dias" else None)]
        return out

    return commits.update(spark, root, merged)


def folders_of(content: dict) -> list[str]:
    """The folders that a commit names (for ``commits.vacuum``)."""
    return [f for s in STATES for f in content.get(s, [])] + [content[c] for c in CURRENT if c in content]


def current_view(spark: SparkSession, root: str, clientes: DataFrame, sucursales: DataFrame) -> DataFrame:
    """The view at the last batch's reference date: equal to ``customer_behavior`` over all facts given so far."""
    _, content = commits.latest(spark, root)
    if not content:
        raise FileNotFoundError(f"no batch was applied under {root}")
    counts = spark.read.parquet(os.path.join(root, content["ventana"]))
    contracts = spark.read.parquet(os.path.join(root, content["contrato_vigente"]))
    return behavior.view_rows(clientes, sucursales, contracts, [counts.select(
        "id_cliente", F.col("reclamos").alias("reclamos_ultimos_6_meses"), F.col("atrasos").alias("pagos_atrasados"))])
