"""D1 + C2: contracts are summed where they lie; those of missing or repeated services are joined."""

from pyspark.sql import functions as F

from churnlens.plans.behavior import contract_facts

CONTRACTS = "id_contrato string, id_cliente string, id_servicio long, tipo_contrato string, estado string, monto_mensual double, es_principal int"


def _shuffled(node) -> int:
    """Records that the exchanges of an executed plan and of its subqueries have written."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _shuffled(node.executedPlan())
    if kind in ("ShuffleQueryStageExec", "BroadcastQueryStageExec"):
        return _shuffled(node.plan())
    found = node.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
    for part in (node.children(), node.subqueries()):
        found += sum(_shuffled(part.apply(i)) for i in range(part.size()))
    return found


def test_contracts_are_summed_before_they_are_shuffled(spark, tmp_path):
    rows = [(f"{i}-1", f"c{i % 10}", i % 20, "A", "activo", 1.25, int(i < 10)) for i in range(2000)]
    spark.createDataFrame(rows, CONTRACTS).coalesce(1).write.parquet(str(tmp_path / "c"))
    services = spark.createDataFrame([(i, f"P{i}") for i in range(20)], "id_servicio long, nombre string").coalesce(1)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for services beyond it
        facts = contract_facts(spark.read.parquet(str(tmp_path / "c")), services)
        got = {r.id_cliente: tuple(r)[1:] for r in facts.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert got == {f"c{i}": (250.0, 200, "A", f"P{i}") for i in range(10)}
    assert _shuffled(facts._jdf.queryExecution().executedPlan()) < 1000  # every contract was shuffled to meet its service


def test_missing_repeated_and_null_services(spark):
    rows = [(f"{i}-1", f"c{i % 7}", i % 9 if i % 11 else None, "AR"[i % 2], "activo" if i % 5 else "inactivo",
             float(i) / 4 if i % 6 else None, i % 2) for i in range(300)]
    contracts = spark.createDataFrame([*rows, ("x-1", "lone", 7, "A", "activo", 1.0, 1), ("x-2", None, 1, "A", "activo", 2.0, 1)],
                                      CONTRACTS)
    services = spark.createDataFrame([(1, "P1"), (2, "P2"), (2, "P2"), (3, "P3"), (4, None), (5, "P5"), (6, "P6"), (6, "Q6"),
                                      (6, "Q6"), (8, "P8"), (None, "P9")], "id_servicio long, nombre string")
    got = {r.id_cliente: (r.monto_mensual, r.cantidad_servicios, r.tipo_contrato, r.plan)
           for r in contract_facts(contracts, services).collect()}
    met = contracts.where("estado = 'activo'").join(services, "id_servicio")
    first = F.col("es_principal") == 1
    want = {r[0]: tuple(r)[1:] for r in met.groupBy("id_cliente").agg(
        F.sum("monto_mensual"), F.count(F.lit(1)), F.max(F.when(first, F.col("tipo_contrato"))),
        F.max(F.when(first, F.col("nombre")))).collect()}
    want[None] = (*want[None][:2], None, None)  # a customer without id meets no principal
    assert got == want and "lone" not in got  # no service 0 or 7


def test_no_contracts_and_no_services(spark):
    none = spark.createDataFrame([], CONTRACTS)
    services = spark.createDataFrame([], "id_servicio long, nombre string")
    one = spark.createDataFrame([("1-1", "a", 1, "A", "activo", 1.0, 1)], CONTRACTS)
    assert contract_facts(none, services).collect() == [] == contract_facts(one, services).collect()


def test_principal_rows_are_cut_before_their_one_shuffle(spark, tmp_path):
    from churnlens.sources.adapter import mark_principal

    rows = [(f"{i}-1", f"c{i % 10}", i % 20, "A", "activo", float(i), 0) for i in range(2000)]
    spark.createDataFrame(rows, CONTRACTS).drop("es_principal").coalesce(1).write.parquet(str(tmp_path / "c"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        marked = mark_principal(spark.read.parquet(str(tmp_path / "c")))
        got = sorted(r.id_contrato for r in marked.collect() if r.es_principal)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert got == [f"{i}-1" for i in range(1990, 2000)]
    plan = marked._jdf.queryExecution().executedPlan()
    assert _shuffled(plan) < 2100  # the contracts once and a row per customer; it was every contract in each of two steps
    exchanges = [x for x in plan.toString().split("== Initial Plan ==")[0].split("\n") if "Exchange hashpartitioning(id_cliente" in x]
    assert len(exchanges) == 2


def test_principal_equals_plain_steps(spark):
    import math
    import random

    from churnlens.sources.adapter import mark_principal

    draw = random.Random(5)
    rows = [(draw.choice(["1-1", "1-2", "2-1", "10-1", "9-12", "7", "x-1", None]), draw.choice(["a", "b", "c", "d", "e", None]),
             draw.choice([1, 2, 10, None]), draw.choice(["activo", "activo", "activo", "inactivo", None]),
             draw.choice([0.0, -0.0, 1.5, 1.501, 7.0, math.nan, None])) for _ in range(160)]
    rows += [(f"{i}-1", "z", 1, "activo", -1.0 * i) for i in range(1, 6)] + [("3-1", "y", None, "activo", 1.0), ("4-1", "y", 1, "activo", 0.5)]
    rows = [(a if a != "x-1" else "8-1", *r) for a, *r in rows]

    def keys(r):
        parts = (r[0] or "").split("-")
        cents = None if r[4] is None else (math.inf if math.isnan(r[4]) else round(r[4] * 100))  # NaN is above all numbers
        return (cents, r[2], int(parts[0]) if parts[0] else None, int(parts[1]) if len(parts) > 1 else None)

    best = {}
    for customer in {r[1] for r in rows} - {None}:
        left = [keys(r) for r in rows if r[1] == customer and r[3] == "activo"]
        for j in range(4):
            most = max((k[j] for k in left if k[j] is not None), default=None)
            left = [k for k in left if k[j] is not None and k[j] == most]
        best[customer] = left[0] if left else None
    want = [(*r, int(r[3] == "activo" and r[1] is not None and best[r[1]] == keys(r))) for r in rows]
    marked = mark_principal(spark.createDataFrame(rows, "id_contrato string, id_cliente string, id_servicio long, estado string, "
                                                        "monto_mensual double"))
    assert sorted(str(tuple(r)) for r in marked.collect()) == sorted(map(str, want)) and sum(w[-1] for w in want) > 2
