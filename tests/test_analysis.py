"""B, D, F, H operators on the F1 fixture (expected values worked out from its rows)."""

import pytest
from pyspark.sql import functions as F

from churnlens.functions.formats import fmt_amount, fmt_integer, fmt_pct, fmt_prediction_pct
from churnlens.functions.text import title_case
from churnlens.operators import conclusions, explore, metrics, stats


def test_kpis(customers):
    k = metrics.kpis(customers).first()
    assert (k["total_clientes"], k["clientes_permanecen"], k["clientes_abandonaron"]) == (5, 3, 2)
    assert k["tasa_abandono"] == 40.0 and k["tasa_retencion"] == 60.0
    assert k["satisfaccion_promedio"] == pytest.approx(3.0)


def test_kpis_empty_is_zero(customers):
    k = metrics.kpis(customers.limit(0)).first()
    assert k["total_clientes"] == 0 and k["tasa_abandono"] == 0.0 and k["satisfaccion_promedio"] == 0.0


def test_churn_by_category(customers):
    city = {r["ciudad"]: r for r in metrics.churn_by_category(customers, "ciudad").collect()}
    assert (city["Puerto Norte"]["total_clientes"], city["Puerto Norte"]["clientes_abandonaron"],
            city["Puerto Norte"]["tasa_abandono"]) == (2, 1, 50.0)
    ct = metrics.churn_by_category(customers, "tipo_contrato").collect()
    assert ct[0]["tipo_contrato"] == "Libre" and ct[0]["tasa_abandono"] == pytest.approx(200 / 3)
    plan = {r["plan"]: r for r in metrics.churn_by_category(customers, "plan").collect()}
    assert plan["Movil 20"]["tasa_abandono"] == 50.0
    assert metrics.churn_by_category(customers, "nombre").count() == 0  # not a grouping column


def test_churn_by_category_tie_order(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 0)], "ciudad string, abandono int")
    assert [r["ciudad"] for r in metrics.churn_by_category(df, "ciudad").collect()] == ["a", "b", "c"]


def test_search_and_filters(customers):
    assert [r["id_cliente"] for r in explore.search(customers, "elsa").collect()] == ["K-01"]
    assert explore.search(customers, "K-0").count() == 5
    assert explore.search(customers, "  ").count() == 5
    assert explore.search(customers, "%").count() == 0
    got = explore.filter_customers(customers, "", ["Laguna Alta"], ["Libre"], None, 1).collect()
    assert [r["id_cliente"] for r in got] == ["K-04"]
    assert explore.analysis_filter(customers, [" Laguna Alta "]).count() == 2
    assert explore.analysis_filter(customers, ["laguna alta"]).count() == 0  # case-sensitive


def test_lookup_sort_options(customers):
    assert explore.lookup(customers, " K-02 ").first()["nombre"] == "Ivo Marchetti"
    assert explore.lookup(customers, "nope").count() == 0
    ids = [r["id_cliente"] for r in explore.sort_customers(customers, "monto_mensual", False).collect()]
    assert ids == ["K-02", "K-05", "K-04", "K-01", "K-03"]
    assert [r["valor"] for r in explore.distinct_options(customers, "plan").collect()] == [
        "Casa 500", "Movil 20", "Movil 50"]


def test_display_table_labels(customers):
    rows = explore.display_table(customers).orderBy("id_cliente").collect()
    assert [r["abandono"] for r in rows] == ["Abandonó", "Permanece", "Permanece", "Abandonó", "Permanece"]


def test_profile_card_skips_nulls(customers):
    card = explore.profile_card(explore.lookup(customers, "K-01")).collect()
    fields = [r["campo"] for r in sorted(card, key=lambda r: r["orden"])]
    assert "Región" not in fields and fields[0] == "ID" and fields[-1] == "Estado de abandono"


def test_mean_and_count_by_state(customers):
    m = {r["abandono"]: r["promedio"] for r in metrics.mean_by_state(customers, "satisfaccion").collect()}
    assert m == {0: 4.0, 1: 1.5}
    c = {r["estado_abandono"]: r["total_clientes"] for r in metrics.count_by_state(customers).collect()}
    assert c == {"Permanece": 3, "Abandonó": 2}


def test_boxplot_input(customers):
    pts = explore.boxplot_input(customers, "satisfaccion").collect()
    assert sorted((r["estado_abandono"], r["satisfaccion"]) for r in pts) == [
        ("Abandonó", 1.0), ("Abandonó", 2.0), ("Permanece", 3.0), ("Permanece", 4.0), ("Permanece", 5.0)]
    with pytest.raises(ValueError):
        explore.boxplot_input(customers, "nombre")


def test_pearson(customers):
    m = {(r["variable_x"], r["variable_y"]): r["coeficiente"] for r in stats.correlation_long(customers).collect()}
    assert m[("satisfaccion", "abandono")] == pytest.approx(-0.866025, rel=1e-5)
    assert m[("satisfaccion", "satisfaccion")] == 1.0
    assert m[("abandono", "satisfaccion")] == m[("satisfaccion", "abandono")]


def test_pearson_constant_column_is_null(customers):
    df = customers.withColumn("pagos_atrasados", F.lit(1))
    m = {(r["variable_x"], r["variable_y"]): r["coeficiente"] for r in stats.correlation_long(df).collect()}
    assert m[("pagos_atrasados", "pagos_atrasados")] is None
    assert m[("pagos_atrasados", "satisfaccion")] is None


def test_pearson_needs_two_numeric_columns(spark):
    df = spark.createDataFrame([("x", "y")], "satisfaccion string, abandono string")
    with pytest.raises(ValueError):
        stats.correlation_long(df)


def test_correlation_with_target_order(spark):
    rows = [("abandono", "abandono", 0, 0, 1.0), ("satisfaccion", "abandono", 1, 0, -0.40),
            ("dias_sin_uso", "abandono", 2, 0, 0.70), ("monto_mensual", "abandono", 3, 0, 0.05)]
    m = spark.createDataFrame(rows, "variable_x string, variable_y string, pos_x int, pos_y int, coeficiente double")
    out = stats.correlation_with_target(m).collect()
    assert [r["variable"] for r in out] == ["Días sin uso", "Satisfacción", "Monto mensual"]
    assert [r["direccion"] for r in out] == ["Positiva", "Negativa", "Sin relación lineal clara"]


def test_conclusions(customers):
    out = [r["conclusion"] for r in conclusions.conclusions(customers).collect()]
    assert out[0].startswith("En los datos analizados se observa que el contrato `Libre`")
    assert "(66.67%)" in out[0]
    assert len(out) == 5 and "-2.50 puntos" in out[3]


def test_formats_and_title_case(spark):
    r = spark.range(1).select(fmt_integer(F.lit(1234)).alias("a"), fmt_pct(F.lit(12.345)).alias("b"),
                              fmt_amount(F.lit(12345.4)).alias("c"), fmt_prediction_pct(F.lit(50.0)).alias("d"),
                              title_case(F.lit("o'higgins san-juan 3er")).alias("e")).first()
    assert (r["a"], r["b"], r["c"], r["d"]) == ("1.234", "12.35%", "$12.345", "50,00 %")
    assert r["e"] == "O'Higgins San-Juan 3Er"


def test_fixed2_text_matches_python(spark):
    import random
    rnd = random.Random(3)
    vals = [12.345, 2.675, 0.125, 1.005, -0.005, 0.0, 99.995, 46.875, -2.5, 1e-9]
    vals += [rnd.uniform(-500, 500) for _ in range(500)] + [rnd.randint(0, 100000) / 1000 for _ in range(500)]
    from churnlens.functions.formats import fixed2_text
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for r in df.select("x", fixed2_text(F.col("x")).alias("t")).collect():
        assert r["t"] == f"{r['x']:.2f}", r["x"]


def test_typed_load_keeps_rows(spark):
    from churnlens.functions.coerce import coerce_numeric_columns
    df = spark.createDataFrame([("A", "12", "dato invalido"), ("B", " 7 ", "3.5"), ("C", "1e2", "12d")],
                               "id_cliente string, antiguedad_meses string, monto_mensual string")
    rows = {r["id_cliente"]: r for r in coerce_numeric_columns(df).collect()}
    assert len(rows) == 3
    assert rows["A"]["antiguedad_meses"] == 12.0 and rows["A"]["monto_mensual"] is None
    assert rows["B"]["antiguedad_meses"] == 7.0 and rows["C"]["antiguedad_meses"] == 100.0
    assert rows["C"]["monto_mensual"] is None  # '12d' is not a number for the reference


def test_sort_rules(spark):
    df = spark.createDataFrame([("C2", None), ("C1", 5.0), ("C3", 5.0), ("C0", 1.0)],
                               "id_cliente string, monto_mensual double")
    desc = [r["id_cliente"] for r in explore.sort_customers(df, "monto_mensual", False).collect()]
    asc = [r["id_cliente"] for r in explore.sort_customers(df, "monto_mensual", True).collect()]
    assert desc == ["C1", "C3", "C0", "C2"] and asc == ["C0", "C1", "C3", "C2"]
    assert explore.sort_customers(df, "nombre", True) is df  # not sortable -> unchanged


def test_options_case_folded_order(spark):
    df = spark.createDataFrame([("1", "b"), ("2", "A"), ("3", " a "), ("4", ""), ("5", None), ("0", "B")],
                               "id_cliente string, plan string")
    # case-folded order; equal keys by binary value
    assert [r["valor"] for r in explore.distinct_options(df, "plan").collect()] == ["A", "a", "B", "b"]


def test_display_projection_and_labels(customers):
    t = explore.display_table(customers, ["nombre", "no_existe", "abandono"])
    assert t.columns == ["nombre", "abandono"]
    lab = explore.display_labels(metrics.churn_by_category(customers, "ciudad"))
    assert lab.columns[0] == "Ciudad"


def test_title_case_accents(spark):
    r = spark.range(1).select(title_case(F.lit("  ñuñoa   árbol-VERDE ")).alias("t")).first()
    assert r["t"] == "  Ñuñoa   Árbol-Verde "


def test_counts_and_shape(customers):
    from churnlens.operators import quality
    assert explore.count_results(None) == 0 and explore.count_results(customers) == 5
    s = quality.frame_shape(customers).first()
    assert (s["filas"], s["columnas"]) == (5, 14)
    assert [r["id_cliente"] for r in explore.order_by_id(customers).collect()] == [
        "K-01", "K-02", "K-03", "K-04", "K-05"]


def test_edge_semantics(spark):
    df = spark.createDataFrame(
        [("1", " Santiago ", "1", "2"), ("2", "", "0", "4"), ("3", None, "x", "5"), ("4", "Santiago", "1", None),
         ("5", "Temuco", "2", "3")],
        "id_cliente string, ciudad string, abandono string, satisfaccion string")
    k = metrics.kpis(df).first()
    # total counts every row; rates use only valid targets (3 of 5); means skip NULLs
    assert (k["total_clientes"], k["clientes_abandonaron"], k["clientes_permanecen"]) == (5, 2, 1)
    assert k["tasa_abandono"] == pytest.approx(200 / 3)
    assert k["satisfaccion_promedio"] == pytest.approx(3.5)
    rows = metrics.churn_by_category(df, "ciudad").collect()
    assert [(r["ciudad"], r["total_clientes"], r["clientes_abandonaron"]) for r in rows] == [("Santiago", 2, 2)]
    # only one churn state present -> no difference sentences
    only_churned = df.filter("abandono = '1'")
    out = [r["conclusion"] for r in conclusions.difference_sentences(only_churned).collect()]
    assert out == []


def _ids(df):
    return sorted(r["id_cliente"] for r in df.collect())


def test_analysis_filters(customers):
    assert _ids(explore.analysis_filter(customers, cities=["Laguna Alta"])) == ["K-03", "K-04"]
    assert _ids(explore.analysis_filter(customers, contract_types=["Fijo"])) == ["K-02", "K-03"]
    assert _ids(explore.analysis_filter(customers, plans=["Casa 500"])) == ["K-02", "K-05"]
    assert _ids(explore.analysis_filter(customers, target=0)) == ["K-02", "K-03", "K-05"]
    assert _ids(explore.analysis_filter(customers, ["Laguna Alta"], ["Libre"], ["Movil 50"], 1)) == ["K-04"]


def test_no_valid_target_no_division(customers):
    df = customers.withColumn("abandono", F.when(F.col("id_cliente").isin("K-01", "K-03"), None)
                              .otherwise(F.lit("x")))
    k = metrics.kpis(df).first()
    assert k["tasa_abandono"] == 0.0 and k["tasa_retencion"] == 0.0
    assert metrics.churn_by_category(df, "ciudad").count() == 0
    m = metrics.kpis(customers).first()
    assert m["monto_mensual_promedio"] == 200.0 and m["reclamos_promedio"] == pytest.approx(1.4)


def test_customer_service_ports(customers):
    assert [r["id_cliente"] for r in explore.search(customers, "raman").collect()] == ["K-05"]
    assert [r["nombre"] for r in explore.search(customers, "k-03").collect()] == ["Nadia Osei"]
    got = explore.filter_customers(customers, "K-", ["Laguna Alta"], ["Libre"], ["Movil 50"], 1)
    assert _ids(got) == ["K-04"]
    assert explore.lookup(customers, "K-02").first()["nombre"] == "Ivo Marchetti"
    assert explore.search(customers.limit(0), "x").count() == 0
    assert [r["valor"] for r in explore.distinct_options(customers, "ciudad").collect()] == [
        "Laguna Alta", "Puerto Norte", "Sierra Chica"]
    asc = explore.sort_customers(customers, "monto_mensual", True).collect()
    assert [r["id_cliente"] for r in asc] == ["K-03", "K-01", "K-04", "K-05", "K-02"]
    desc = explore.sort_customers(customers, "satisfaccion", False).collect()
    assert [r["id_cliente"] for r in desc] == ["K-02", "K-03", "K-05", "K-04", "K-01"]
