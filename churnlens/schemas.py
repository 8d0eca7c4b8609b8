"""Table definitions of the churn data model as explicit Spark schemas.

Constraints (PK, FK, CHECK, NOT NULL, UNIQUE) are not enforced on write;
``churnlens.operators.integrity`` reports their violations instead.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, DT, TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.DateType(), T.TimestampType()


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


PARAMETROS = _schema(("id", I, False), ("fecha_referencia", DT, False))
SUCURSALES = _schema(("id_sucursal", I, False), ("nombre", S, False), ("ciudad_sede", S, True), ("region", S, True))
SERVICIOS = _schema(("id_servicio", L, False), ("codigo", S, False), ("nombre", S, False), ("tipo", S, True),
                    ("precio_mensual", D, False))
CLIENTES = _schema(("id_cliente", S, False), ("nombre", S, False), ("edad", I, True), ("genero", S, True),
                   ("ciudad", S, True), ("id_sucursal", I, True), ("segmento", S, True), ("tipo_cliente", S, True),
                   ("antiguedad_meses", I, True), ("ingreso_mensual", D, True), ("satisfaccion", I, False),
                   ("dias_sin_uso", I, True), ("estado", S, True), ("fecha_alta", DT, True), ("abandono", I, False))
CONTRATOS = _schema(("id_contrato", S, False), ("id_cliente", S, False), ("id_servicio", L, False),
                    ("tipo_contrato", S, True), ("fecha_inicio", DT, True), ("fecha_fin", DT, True),
                    ("estado", S, False), ("monto_mensual", D, False), ("es_principal", I, False))
FACTURAS = _schema(("id_factura", L, False), ("id_cliente", S, False), ("periodo", S, True),
                   ("monto_facturado", D, False), ("fecha_emision", DT, True), ("fecha_vencimiento", DT, True),
                   ("estado", S, True))
PAGOS = _schema(("id_pago", S, False), ("id_factura", L, False), ("fecha_pago", DT, True), ("monto_pagado", D, False),
                ("estado", S, False), ("dias_atraso", I, True))
RECLAMOS = _schema(("id_reclamo", S, False), ("id_cliente", S, False), ("id_sucursal", I, True), ("fecha", DT, False),
                   ("tipo", S, True), ("canal", S, True), ("estado", S, True))
INTERACCIONES = _schema(("id_interaccion", L, False), ("id_cliente", S, False), ("fecha", TS, True),
                        ("canal", S, True), ("motivo", S, True), ("duracion_min", D, True))
PREDICCIONES = _schema(("id_cliente", S, False), ("probabilidad_churn", D, False), ("nivel_riesgo", S, False),
                       ("modelo", S, False), ("version_modelo", S, False), ("fecha_prediccion", TS, False),
                       ("corrida", S, True))

TABLES = {
    "parametros": PARAMETROS, "sucursales": SUCURSALES, "servicios": SERVICIOS, "clientes": CLIENTES,
    "contratos": CONTRATOS, "facturas": FACTURAS, "pagos": PAGOS, "reclamos": RECLAMOS,
    "interacciones": INTERACCIONES, "predicciones": PREDICCIONES,
}

# flat customer contract (F1): 14 columns, the view's first 14 columns
FLAT_CUSTOMER = _schema(
    ("id_cliente", S, True), ("nombre", S, True), ("ciudad", S, True), ("antiguedad_meses", I, True),
    ("tipo_contrato", S, True), ("plan", S, True), ("monto_mensual", D, True),
    ("reclamos_ultimos_6_meses", I, True), ("pagos_atrasados", I, True), ("dias_sin_uso", I, True),
    ("satisfaccion", I, True), ("abandono", I, True), ("edad", I, True), ("cantidad_servicios", I, True))

# primary keys, foreign keys (child table, child column, parent table, parent column)
PRIMARY_KEYS = {
    "parametros": ["id"], "sucursales": ["id_sucursal"], "servicios": ["id_servicio"], "clientes": ["id_cliente"],
    "contratos": ["id_contrato"], "facturas": ["id_factura"], "pagos": ["id_pago"], "reclamos": ["id_reclamo"],
    "interacciones": ["id_interaccion"],
    "predicciones": ["id_cliente", "modelo", "version_modelo", "corrida"],
}
FOREIGN_KEYS = [
    ("clientes", "id_sucursal", "sucursales", "id_sucursal"),
    ("contratos", "id_cliente", "clientes", "id_cliente"),
    ("contratos", "id_servicio", "servicios", "id_servicio"),
    ("facturas", "id_cliente", "clientes", "id_cliente"),
    ("pagos", "id_factura", "facturas", "id_factura"),
    ("reclamos", "id_cliente", "clientes", "id_cliente"),
    ("reclamos", "id_sucursal", "sucursales", "id_sucursal"),
    ("interacciones", "id_cliente", "clientes", "id_cliente"),
    ("predicciones", "id_cliente", "clientes", "id_cliente"),
]
