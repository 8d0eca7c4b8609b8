"""End-to-end flows: load -> validate -> clean -> publish; train -> save; score -> register (3.1, 3.3)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from churnlens import config
from churnlens.operators import clean, model
from churnlens.sources import sinks


def intake_flow(spark: SparkSession, csv_path: str, root: str) -> dict:
    """A1 -> V3 -> A9 -> V4/V5: load and validate a CSV, publish it if valid, clean it and store both."""
    df, verdict = sinks.load_and_validate_csv(spark, csv_path)
    state = sinks.publish_intake(spark, df, verdict, root, os.path.basename(csv_path))
    if df is not None:
        active = sinks.read_live(spark, root, "activo")
        rows, report = clean.prepare(active)
        sinks.publish_clean(rows, report, root)
        state["datos_preparados"] = True
    return state


def train_flow(view: DataFrame, out_path: str, strict_features: bool = True) -> dict:
    """K8 + A13: fit both classifiers on the view, save the served one with its metadata."""
    models = model.train(view, strict_features=strict_features)
    model.save_model(models, out_path)
    m = models.metadata["metricas"]
    return {"arbol": m["arbol"], "reglog": m["regresion_logistica"], "base": m["linea_base"]}


def register_flow(view: DataFrame, model_path: str, history_root: str, replace: bool = False,
                  version: str | None = None, clientes: DataFrame | None = None) -> int:
    """A8 + A7: score every customer with the saved model and append (or replace) its history.

    ``clientes`` (default: the scored view) are the customers that predictions may refer to.
    """
    scores, meta = model.generate_scores(model_path, view)
    name = meta.get("modelo_nombre", config.MODEL_NAME)
    ver = version or meta.get("version", config.MODEL_VERSION)
    return sinks.write_predictions(scores, history_root, name, ver, replace=replace,
                                   clientes=view if clientes is None else clientes)
