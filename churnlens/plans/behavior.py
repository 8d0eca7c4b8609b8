"""The per-customer analytic view.

Aggregate first, join after: each fact table is reduced to one row per
customer before the LEFT JOIN, so no join fans out.  Counts and amounts of
customers without facts become 0; plan / contract type stay NULL.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens import config

VIEW_COLUMNS = [
    "id_cliente", "nombre", "ciudad", "antiguedad_meses", "tipo_contrato", "plan", "monto_mensual",
    "reclamos_ultimos_6_meses", "pagos_atrasados", "dias_sin_uso", "satisfaccion", "abandono", "edad",
    "cantidad_servicios", "region", "segmento",
]


def _as_date(ref) -> Column:
    if isinstance(ref, Column):
        return F.to_date(ref)
    if isinstance(ref, (_dt.date, str)):
        return F.to_date(F.lit(str(ref)))
    raise TypeError("ref_date must be a Column, a date or an ISO date string")


def six_month_window(c: Column, ref_date, months: int = config.WINDOW_MONTHS) -> Column:
    """H4: ``[ref - months, ref]``, both ends inclusive (calendar-clamped months)."""
    ref = _as_date(ref_date)
    return c.between(F.add_months(ref, -months), ref)


#: Decimals that amounts are summed with, unless a caller says otherwise.
MONEY_SCALE = 6
#: Buckets of service ids; those with a service that is not listed exactly once are joined.
SERVICE_BUCKETS = 256


def money_sum(c: Column, scale: int = MONEY_SCALE) -> Column:
    """Sum of amounts in exact decimal arithmetic, returned as double.

    A double sum depends on the order rows meet (partitioning, engine); the
    decimal sum does not, so the result is identical on any cluster layout.
    Amounts with more than ``scale`` decimals are rounded; ``out_of_scale``
    counts them.
    """
    return F.sum(c.cast(f"decimal(38,{scale})")).cast("double")


def out_of_scale(c: Column, scale: int = MONEY_SCALE) -> Column:
    """Number of amounts that ``money_sum`` rounds or cannot hold."""
    kept = c.try_cast(f"decimal(38,{scale})").cast("double")
    return F.count_if(c.isNotNull() & ~F.coalesce(kept == c.cast("double"), F.lit(False)))


def _ranked(values: DataFrame, name: str) -> DataFrame:
    """(name, rank) of the distinct non-null texts of a small domain, in their order."""
    known = values.select(name).where(F.col(name).isNotNull()).distinct()
    return known.withColumn(f"{name}_rk", F.row_number().over(Window.orderBy(name)))


def contract_facts(contratos: DataFrame, servicios: DataFrame, money_scale: int = MONEY_SCALE) -> DataFrame:
    """D1 + C2: active contracts joined to their service, one row per customer.

    Amounts and counts are a hash aggregate over all active contracts.  Type and plan come from the principal
    rows only (one per customer in valid data); the largest text is taken by its rank in the domain, so this is
    a hash aggregate of integers too and no aggregate falls back to sorting.

    A contract whose service is listed once counts once without meeting it, so contracts are summed where they lie
    and only those in the buckets of other services (``_odd_buckets``) are shuffled to be joined.
    """
    svc = servicios.select("id_servicio", F.col("nombre").alias("plan"))
    active = contratos.filter((F.col("estado") == "activo") & F.col("id_servicio").isNotNull())
    is_odd = F.array_contains(_odd_buckets(active, svc), _bucket())
    amounts = active.select("id_servicio", "id_cliente", "monto_mensual")
    counted = (amounts.filter(~is_odd).drop("id_servicio")
               .unionByName(amounts.filter(is_odd).join(svc.select("id_servicio"), "id_servicio").drop("id_servicio")))
    totals = counted.groupBy("id_cliente").agg(money_sum(F.col("monto_mensual"), money_scale).alias("monto_mensual"),
                                               F.count(F.lit(1)).alias("cantidad_servicios"))
    chosen = (active.filter(F.col("es_principal") == 1).join(svc, "id_servicio")
              .select("id_cliente", "tipo_contrato", "plan"))
    return totals.join(principal_texts(chosen, svc), "id_cliente", "left")


def _bucket() -> Column:
    return F.pmod(F.xxhash64("id_servicio"), F.lit(SERVICE_BUCKETS)).cast("int")


def _odd_buckets(active: DataFrame, svc: DataFrame) -> Column:
    """Scalar subquery: the buckets of the contracts' services that are missing or listed more than once."""
    once = svc.groupBy("id_servicio").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == 1)
    odd = active.select("id_servicio").distinct().join(once, "id_servicio", "left_anti")
    return odd.agg(F.collect_set(_bucket())).scalar()  # an empty array if there is none


def principal_texts(chosen: DataFrame, svc: DataFrame) -> DataFrame:
    """Largest type and plan per customer of the principal rows (id_cliente, tipo_contrato, plan), by rank."""
    types, plans = _ranked(chosen, "tipo_contrato"), _ranked(svc, "plan")
    return (chosen.join(types, "tipo_contrato", "left").join(plans, "plan", "left").groupBy("id_cliente")
            .agg(F.max("tipo_contrato_rk").alias("tipo_contrato_rk"), F.max("plan_rk").alias("plan_rk"))
            .join(types, "tipo_contrato_rk", "left").join(plans, "plan_rk", "left")
            .select("id_cliente", "tipo_contrato", "plan"))


def complaint_facts(reclamos: DataFrame, ref_date) -> DataFrame:
    """Complaints inside the six-month window, per customer."""
    return (reclamos.filter(six_month_window(F.col("fecha"), ref_date))
            .groupBy("id_cliente").agg(F.count(F.lit(1)).alias("reclamos_ultimos_6_meses")))


def late_payment_facts(facturas: DataFrame, pagos: DataFrame, ref_date) -> DataFrame:
    """D3 + C3: late payments of invoices issued inside the window (payment fan-out kept).

    The window cuts the invoices before they are joined, so a join filter can cut the payments of all other years
    before their shuffle, and matched pairs are combined per customer in the map tasks.  An invoice holding a
    third of all payments is a skewed join key that adaptive execution splits.
    """
    inv = facturas.filter(six_month_window(F.col("fecha_emision"), ref_date)).select("id_factura", "id_cliente")
    late = pagos.filter(F.col("estado") == "atrasado").select("id_factura")
    return (inv.join(late, "id_factura")
            .groupBy("id_cliente").agg(F.count(F.lit(1)).alias("pagos_atrasados")))


def customer_behavior(clientes: DataFrame, sucursales: DataFrame, servicios: DataFrame,
                      contratos: DataFrame, reclamos: DataFrame, facturas: DataFrame,
                      pagos: DataFrame, ref_date, money_scale: int = MONEY_SCALE) -> DataFrame:
    """One behaviour row per customer (16 columns; ``edad`` only if the customer table has it).

    ``ref_date`` is the reference ("as of") date: a ``datetime.date``/ISO
    string (folded to a literal, pushable) or a scalar Column (e.g. read from
    a one-row parameter table with ``DataFrame.scalar()``).
    """
    ct = contract_facts(contratos, servicios, money_scale)
    rc = complaint_facts(reclamos, ref_date)
    lp = late_payment_facts(facturas, pagos, ref_date)
    return view_rows(clientes, sucursales, ct, [rc, lp])


def view_rows(clientes: DataFrame, sucursales: DataFrame, ct: DataFrame, windowed: list[DataFrame]) -> DataFrame:
    """C4: the view's columns from the customers and their facts (at most one row per customer in each)."""
    br = sucursales.select("id_sucursal", "region")
    c = clientes.alias("c")
    v = (c.join(br, "id_sucursal", "left")
         .join(ct.alias("ct"), "id_cliente", "left"))
    for facts in windowed:
        v = v.join(facts, "id_cliente", "left")
    zero = F.lit(0).cast("bigint")
    cols = {
        "id_cliente": F.col("id_cliente"),
        "nombre": F.col("c.nombre"),
        "ciudad": F.col("c.ciudad"),
        "antiguedad_meses": F.col("c.antiguedad_meses"),
        "tipo_contrato": F.col("ct.tipo_contrato"),
        "plan": F.col("ct.plan"),
        "monto_mensual": F.coalesce(F.col("ct.monto_mensual"), F.lit(0.0)),
        "reclamos_ultimos_6_meses": F.coalesce(F.col("reclamos_ultimos_6_meses"), zero),
        "pagos_atrasados": F.coalesce(F.col("pagos_atrasados"), zero),
        "dias_sin_uso": F.col("c.dias_sin_uso"),
        "satisfaccion": F.col("c.satisfaccion"),
        "abandono": F.col("c.abandono"),
        "edad": F.col("c.edad") if "edad" in clientes.columns else None,
        "cantidad_servicios": F.coalesce(F.col("ct.cantidad_servicios"), zero),
        "region": F.col("region"),
        "segmento": F.col("c.segmento") if "segmento" in clientes.columns else F.lit(None).cast("string"),
    }
    return v.select(*[e.alias(n) for n, e in cols.items() if e is not None])


def behavior_from_tables(t) -> DataFrame:
    """The view over a ``ChurnTables`` bundle."""
    return customer_behavior(t.clientes, t.sucursales, t.servicios, t.contratos, t.reclamos,
                             t.facturas, t.pagos, t.ref_date)


def require_view_columns(df: DataFrame) -> DataFrame:
    """A4: the minimum contract of the view; missing required columns raise, naming them."""
    missing = [c for c in config.REQUIRED_COLUMNS if c not in df.columns]
    if missing:
        raise RuntimeError(config.MSG_VIEW_MISSING + ", ".join(missing))
    return df


def read_view(t) -> DataFrame:
    """A3: every view column ordered by customer id, after the contract check."""
    return require_view_columns(behavior_from_tables(t)).orderBy(F.col(config.ID_COLUMN).asc())
