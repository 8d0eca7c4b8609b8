"""K1-K9, D23-D29, D35, E2, H14/H15/H22 on small fixtures (F4, F5, F8, planted-signal classifier)."""

import pytest
from pyspark.sql import functions as F

from churnlens.operators import model, risk, segment

F4 = [("C1", 36, None, 4, 0, 0, 2, 5, 0), ("C2", 8, 18990.0, 1, 2, 1, 14, 3, 1),
      ("C3", 18, 33990.0, 3, 3, 1, 16, 2, 1), ("C4", 24, 35990.0, 3, 1, 0, 5, 4, 0),
      ("C5", 60, 88990.0, 5, 0, 0, 1, 5, 0), ("C6", 3, 12990.0, 1, 4, 3, 25, 1, 1)]
F4_SCHEMA = ("id_cliente string, antiguedad_meses int, monto_mensual double, cantidad_servicios int, "
             "reclamos_ultimos_6_meses int, pagos_atrasados int, dias_sin_uso int, satisfaccion int, abandono int")


@pytest.fixture()
def seg_input(spark):
    return spark.createDataFrame(F4, F4_SCHEMA).withColumns(
        {"nivel_riesgo": F.lit("alto"), "probabilidad_churn": F.lit(0.9)})


def test_scaler_median_and_centering(seg_input):
    sc = segment.fit_scaler(seg_input)
    assert sc.medians["monto_mensual"] == pytest.approx(33990.0)
    z = segment.scaled_features(seg_input, sc)
    means = z.agg(*[F.avg(c).alias(c) for c in z.columns if c.startswith("z_")]).first()
    assert all(abs(v) < 1e-12 for v in means)


def test_missing_feature_error(seg_input):
    with pytest.raises(ValueError, match="monto_mensual, satisfaccion"):
        segment.fit_scaler(seg_input.drop("monto_mensual", "satisfaccion"))


def test_kmeans_labels_and_reports(seg_input):
    out = segment.segment(seg_input, n_init=3)
    labels = {r["cluster_id"] for r in out["clientes_segmentados"].collect()}
    assert labels == {0, 1, 2}
    assert sum(r["total_clientes"] for r in out["conteo_clusters"].collect()) == 6
    s = out["resumen_clusters"]
    assert set(segment.FEATURES) <= set(s.columns)
    assert len(out["descripciones"].collect()) == 3
    again = segment.kmeans_labels(seg_input, n_init=3).select("id_cliente", "cluster_id").orderBy("id_cliente")
    first = out["clientes_segmentados"].select("id_cliente", "cluster_id").orderBy("id_cliente")
    assert again.collect() == first.collect()  # reproducible


def test_kmeans_needs_k_rows(seg_input):
    with pytest.raises(ValueError, match="clusters"):
        segment.kmeans_labels(seg_input.limit(2), n_init=1)


def test_cluster_churn_rates(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 0), (2, 0)], "cluster_id int, abandono int")
    t = {r["cluster_id"]: r for r in segment.cluster_churn(df).collect()}
    assert t[0]["tasa_abandono"] == 50.0 and t[1]["clientes_abandonaron"] == 2 and t[2]["tasa_abandono"] == 0.0
    fixed = segment.fixed_domain_counts(segment.cluster_counts(df.filter("cluster_id < 2"))).collect()
    assert [(r["cluster"], r["total_clientes"]) for r in fixed] == [("Clúster 1", 2), ("Clúster 2", 2),
                                                                     ("Clúster 3", 0)]


def test_traits_and_descriptions(spark):
    summ = spark.createDataFrame([(0, "Clúster 1", 2, 10.0, 1.0), (1, "Clúster 2", 3, 5.0, 1.0)],
                                 "cluster_id int, cluster string, total_clientes bigint, antiguedad_meses double, "
                                 "monto_mensual double")
    tr = {r["cluster_id"]: r["rasgos"] for r in segment.cluster_traits(summ).collect()}
    assert tr[0] == ["mayor promedio de antiguedad_meses"] and tr[1] == ["menor promedio de antiguedad_meses"]
    d = segment.describe_clusters(summ).collect()
    assert d[0]["descripcion"].startswith("Clúster 1: agrupa 2 clientes con valores relativos destacados en")


def test_risk_levels_and_rounding(spark):
    df = spark.createDataFrame([("a", 0.1), ("b", 0.45), ("c", 0.8), ("d", 0.29996)],
                               "id_cliente string, probabilidad_churn double")
    r = {x["id_cliente"]: x for x in risk.with_risk(df).collect()}
    assert [r[k]["nivel_riesgo"] for k in "abc"] == ["bajo", "medio", "alto"]
    assert r["d"]["nivel_riesgo"] == "bajo" and r["d"]["probabilidad_churn"] == 0.3


def test_risk_summary_and_distribution(spark):
    pred = spark.createDataFrame([("1", 0.80, "alto"), ("2", 0.40, "medio"), ("3", 0.60, "alto"),
                                  ("4", 0.20, "bajo")], "id_cliente string, probabilidad_churn double, "
                                                        "nivel_riesgo string")
    s = risk.risk_summary(pred).first()
    assert s["porcentaje_riesgo_alto"] == 50.0 and s["probabilidad_promedio"] == pytest.approx(50.0)
    assert s["porcentaje_riesgo_alto_texto"] == "50,00 %"
    e = risk.risk_summary(pred.limit(0)).first()
    assert e["porcentaje_riesgo_alto"] == 0.0 and e["probabilidad_promedio"] == 0.0
    d = [(r["nivel_riesgo"], r["clientes"]) for r in risk.risk_distribution(pred.filter("nivel_riesgo != 'bajo'"))
         .collect()]
    assert d == [("bajo", 0), ("medio", 1), ("alto", 2)]
    assert [r["id_cliente"] for r in risk.risk_table(pred).collect()] == ["1", "3", "2"]


def _planted(spark, n=1200):
    # label depends on three features; everything closed-form from the row number
    base = spark.range(n).select(
        F.col("id").cast("string").alias("id_cliente"),
        (F.col("id") * 7 % 60).cast("int").alias("antiguedad_meses"),
        (F.col("id") * 13 % 9).cast("int").alias("reclamos_ultimos_6_meses"),
        (F.col("id") * 11 % 5 + 1).cast("int").alias("satisfaccion"),
        (F.col("id") * 17 % 40).cast("int").alias("dias_sin_uso"),
        (F.col("id") * 29 % 1000 + 10000).cast("double").alias("monto_mensual"),
        F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("id") % 3 + 1).cast("int")).alias("ciudad"),
        F.lit("Mensual").alias("tipo_contrato"), F.lit("Fibra").alias("plan"), F.lit("R").alias("region"),
        *[F.lit(0).cast("int").alias(c) for c in ("edad", "cantidad_servicios", "pagos_atrasados")])
    score = F.col("reclamos_ultimos_6_meses") * 2 - F.col("satisfaccion") * 2 + F.col("dias_sin_uso") / 8
    return base.withColumn("abandono", (score > 1).cast("int"))


def test_classifier_beats_baseline(spark):
    df = _planted(spark)
    m = model.train(df)
    met = m.metadata["metricas"]
    assert met["arbol"]["accuracy"] > met["linea_base"]
    assert met["arbol"]["recall"] >= 0.55
    assert met["regresion_logistica"]["accuracy"] > met["linea_base"]
    sc = model.score(m.tree, df)
    row = sc.agg(F.min("probabilidad_churn"), F.max("probabilidad_churn"), F.count("*")).first()
    assert 0.0 <= row[0] <= row[1] <= 1.0 and row[2] == 1200


def test_unseen_category_scores(spark, tmp_path):
    df = _planted(spark, 400)
    m = model.train(df, fit_logistic=False)
    other = df.withColumn("ciudad", F.lit("Nunca vista"))
    assert model.score(m.tree, other).count() == 400
    model.save_model(m, str(tmp_path / "m"))
    loaded, meta = model.load_model(str(tmp_path / "m"))
    assert meta["modelo_nombre"] == "arbol_decision"
    assert model.score(loaded, df).count() == 400
    with pytest.raises(FileNotFoundError):
        model.load_model(str(tmp_path / "missing"))


def test_score_rejects_missing_columns(spark):
    df = _planted(spark, 200)
    m = model.train(df, fit_logistic=False)
    with pytest.raises(ValueError):
        model.score(m.tree, df.drop("id_cliente"))
    with pytest.raises(ValueError, match="empty"):
        model.score(m.tree, df.limit(0))
    with pytest.raises(ValueError):
        model.score(m.tree, df, features=m.metadata["features"] + ["not_there"])


def test_evaluate_counts(spark):
    pred = spark.createDataFrame([(1.0, 1.0), (1.0, 0.0), (0.0, 0.0), (0.0, 0.0)], "_label double, prediction double")
    e = model.evaluate(pred).first()
    assert (e["vp"], e["fn"], e["vn"], e["fp"]) == (1, 1, 2, 0)
    assert e["accuracy"] == 0.75 and e["recall"] == 0.5 and e["precision"] == 1.0 and e["linea_base"] == 0.5
