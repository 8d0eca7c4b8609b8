"""Driver tables -> churn data model.

The driver's TPC-H-like tables carry no churn domain; this mapping derives
the ten churn tables from them so every operator runs on real, scaling
input.  All derivations are declarative DataFrame plans: per-customer facts
are partial (map-side combined) aggregates, so a customer holding a third of
all orders still only ships one partial row per map task.

Reference date ``T`` = six months before the latest order date, computed
from the data as an uncorrelated scalar subquery (no driver round trip).
Features look at orders on or before ``T``; the label is "no order after T".
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlens.session import table_path


@dataclass
class ChurnTables:
    clientes: DataFrame
    sucursales: DataFrame
    servicios: DataFrame
    contratos: DataFrame
    facturas: DataFrame
    pagos: DataFrame
    reclamos: DataFrame
    interacciones: DataFrame
    parametros: DataFrame
    ref_date: Column
    cached: list = field(default_factory=list)

    def release(self) -> None:
        """Unpersist frames kept for the derivation (see ``churn_tables(persist_shared=True)``)."""
        for df in self.cached:
            df.unpersist()
        self.cached.clear()

    def as_dict(self) -> dict[str, DataFrame]:
        """The nine relational tables by name (predictions live in their own history table)."""
        return {"parametros": self.parametros, "sucursales": self.sucursales, "servicios": self.servicios,
                "clientes": self.clientes, "contratos": self.contratos, "facturas": self.facturas,
                "pagos": self.pagos, "reclamos": self.reclamos, "interacciones": self.interacciones}


def read_driver(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def reference_date(orders: DataFrame, months_back: int = 6) -> Column:
    """Scalar subquery: latest order date minus ``months_back`` months."""
    return orders.select(F.add_months(F.max(F.to_date("o_orderdate")), -months_back)).scalar()


def _date_key_order(d: Column, key: Column) -> Column:
    """(date, integral key) packed exactly into one decimal(38,0), order-preserving."""
    dec = "decimal(38,0)"
    return F.unix_date(d).cast(dec) * F.lit(Decimal(10 ** 19)).cast(dec) + key.cast(dec)


def _line_key() -> Column:
    return F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))


def _lines_with_orders(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    lines = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
                            "l_returnflag", "l_linestatus", F.to_date("l_shipdate").alias("ship_d"))
    heads = orders.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("order_d"))
    return lines.join(heads, lines.l_orderkey == heads.o_orderkey)


def _keep_largest(rows: DataFrame, column: str) -> DataFrame:
    """Per customer, the rows with the largest value; a task drops smaller values of its own before the shuffle."""
    order = Window.partitionBy("id_cliente").orderBy(F.col(column).desc())
    ranked = rows.where(F.col(column).isNotNull()).withColumn("_rank", F.rank().over(order))
    return ranked.where(F.col("_rank") == 1).drop("_rank")


def mark_principal(contracts: DataFrame, cached: list | None = None) -> DataFrame:
    """Flag one principal among each customer's active contracts.

    The principal is the active contract with the largest (amount in cents, service, order key, line number),
    compared column by column: each step keeps the rows with the largest value, so no value range can run into
    the next one, and after the first step about one row per customer is left.  All steps share one shuffle by
    customer.  With ``cached`` their few rows are kept on disk and added to it.  What is left is one value of each
    column per customer, so active contracts meet it on the customer alone, as they are (what is compared is computed
    behind their shuffle), and come out with a customer's rows together: sums per customer then leave a row per
    customer, whatever the number of partitions; rows that are not active stay where they are.
    """
    line = F.split(F.col("id_contrato"), "-")
    keys = {"_cents": F.round(F.col("monto_mensual") * 100), "id_servicio": F.col("id_servicio"),
            "_order": F.get(line, F.lit(0)).cast("bigint"), "_line": F.get(line, F.lit(1)).cast("bigint")}
    is_active = F.coalesce(F.col("estado") == "activo", F.lit(False))
    active = contracts.filter(is_active)
    top = active.select("id_cliente", *[e.alias(k) for k, e in keys.items()])
    for column in keys:
        top = _keep_largest(top, column)
        if cached is not None:
            top = top.persist(StorageLevel.DISK_ONLY)
            cached.append(top)
    best = top.groupBy("id_cliente").agg(*[F.max(k).alias(f"_top{k}") for k in keys])
    is_top = F.lit(True)
    for k, e in keys.items():
        is_top = is_top & (e == F.col(f"_top{k}"))
    marked = (active.join(best, "id_cliente", "left")
              .select(*contracts.columns, F.coalesce(is_top, F.lit(False)).cast("int").alias("es_principal")))
    return marked.unionByName(contracts.filter(~is_active).withColumn("es_principal", F.lit(0)))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interactions table: the events under the model's column names."""
    return read_driver(spark, sf_dir, "events").select(
        F.col("event_id").alias("id_interaccion"), F.col("user_id").cast("string").alias("id_cliente"),
        F.col("ts").alias("fecha"), F.col("event_type").alias("canal"), F.col("props").alias("motivo"),
        F.col("value").alias("duracion_min"))


def churn_tables(spark: SparkSession, sf_dir: str, persist_shared: bool = False) -> ChurnTables:
    """Derive the churn tables from the driver tables (lazy).

    ``persist_shared`` keeps the line-order join (the input of contracts,
    complaints and payments) for the duration of a multi-table write; call
    ``release()`` afterwards.
    """
    customer = read_driver(spark, sf_dir, "customer")
    nation = read_driver(spark, sf_dir, "nation")
    region = read_driver(spark, sf_dir, "region")
    part = read_driver(spark, sf_dir, "part")
    orders = read_driver(spark, sf_dir, "orders")
    lineitem = read_driver(spark, sf_dir, "lineitem")

    T = reference_date(orders)
    d = F.to_date("o_orderdate")

    facts = (orders.groupBy("o_custkey").agg(
        F.min(F.when(d <= T, d)).alias("first_d"),
        F.max(F.when(d <= T, d)).alias("last_d"),
        # satisfaction of the latest order <= T (ties by order key): max_by over an exact
        # decimal (date, key) packing keeps this a hash aggregate
        F.max_by(F.when(d <= T, 6 - F.substring("o_orderpriority", 1, 1).try_cast("int")),
                 F.when(d <= T, _date_key_order(d, F.col("o_orderkey")))).alias("sat_latest"),
        F.count_if(d > T).alias("n_after")))

    clientes = (customer
                .join(nation, customer.c_nationkey == nation.n_nationkey, "left")
                .join(facts, customer.c_custkey == facts.o_custkey, "left")
                .select(F.col("c_custkey").cast("string").alias("id_cliente"),
                        F.col("c_name").alias("nombre"),
                        (F.col("c_custkey") % 73 + 18).cast("int").alias("edad"),
                        F.col("n_name").alias("ciudad"),
                        F.col("c_nationkey").alias("id_sucursal"),
                        F.col("c_mktsegment").alias("segmento"),
                        F.floor(F.datediff(T, "first_d") / 30).cast("int").alias("antiguedad_meses"),
                        F.col("c_acctbal").alias("ingreso_mensual"),
                        F.col("sat_latest").cast("int").alias("satisfaccion"),
                        F.datediff(T, "last_d").cast("int").alias("dias_sin_uso"),
                        F.col("first_d").alias("fecha_alta"),
                        F.when(F.coalesce("n_after", F.lit(0)) == 0, 1).otherwise(0).cast("int")
                        .alias("abandono")))

    sucursales = (nation.join(region, nation.n_regionkey == region.r_regionkey, "left")
                  .select(F.col("n_nationkey").alias("id_sucursal"), F.col("n_name").alias("nombre"),
                          F.col("n_name").alias("ciudad_sede"), F.col("r_name").alias("region")))

    servicios = part.select(F.col("p_partkey").alias("id_servicio"),
                            F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("codigo"),
                            F.col("p_type").alias("nombre"), F.col("p_brand").alias("tipo"),
                            F.col("p_retailprice").alias("precio_mensual"))

    lo = _lines_with_orders(lineitem, orders)
    cached = []
    if persist_shared:
        lo = lo.persist(StorageLevel.DISK_ONLY)  # the memory is for the joins and sorts that read it
        cached.append(lo)
    contratos = mark_principal(
        lo.filter(F.col("order_d") <= T)
        .select(_line_key().alias("id_contrato"),
                F.col("o_custkey").cast("string").alias("id_cliente"),
                F.col("l_partkey").alias("id_servicio"),
                F.col("l_returnflag").alias("tipo_contrato"),
                F.col("order_d").alias("fecha_inicio"),
                F.col("ship_d").alias("fecha_fin"),
                F.when(F.col("l_linestatus") == "O", "activo").otherwise("inactivo").alias("estado"),
                F.col("l_extendedprice").alias("monto_mensual")),
        cached if persist_shared else None)

    reclamos = (lo.filter((F.col("l_returnflag") == "R") & (F.col("order_d") <= T))
                .select(_line_key().alias("id_reclamo"),
                        F.col("o_custkey").cast("string").alias("id_cliente"),
                        F.lit(None).cast("int").alias("id_sucursal"),
                        F.col("ship_d").alias("fecha"),
                        F.lit("devolucion").alias("tipo"),
                        F.lit(None).cast("string").alias("canal"),
                        F.when(F.col("l_linestatus") == "O", "abierto").otherwise("cerrado").alias("estado")))

    facturas = orders.select(F.col("o_orderkey").alias("id_factura"),
                             F.col("o_custkey").cast("string").alias("id_cliente"),
                             F.date_format(d, "yyyy-MM").alias("periodo"),
                             F.col("o_totalprice").alias("monto_facturado"),
                             d.alias("fecha_emision"),
                             F.date_add(d, 30).alias("fecha_vencimiento"),
                             F.when(F.col("o_orderstatus") == "F", "pagada").otherwise("pendiente").alias("estado"))

    late = F.datediff("ship_d", "order_d") - 30
    pagos = lo.select(_line_key().alias("id_pago"),
                      F.col("l_orderkey").alias("id_factura"),
                      F.col("ship_d").alias("fecha_pago"),
                      F.col("l_extendedprice").alias("monto_pagado"),
                      F.when(late > 0, "atrasado").otherwise("a_tiempo").alias("estado"),
                      F.greatest(late, F.lit(0)).cast("int").alias("dias_atraso"))

    interacciones = interactions(spark, sf_dir)

    parametros = spark.range(1).select(F.lit(1).alias("id"), T.alias("fecha_referencia"))

    return ChurnTables(clientes, sucursales, servicios, contratos, facturas, pagos, reclamos,
                       interacciones, parametros, T, cached)
