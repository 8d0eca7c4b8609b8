"""Train -> save -> score -> register, and the CSV intake flow, end to end."""

from churnlens.plans import flows
from churnlens.sources import sinks
from test_segment_risk_model import _planted


def test_train_and_register(spark, tmp_path):
    df = _planted(spark, 600)
    out = flows.train_flow(df, str(tmp_path / "model"))
    assert out["arbol"]["accuracy"] > out["base"]
    hist = str(tmp_path / "hist")
    assert flows.register_flow(df, str(tmp_path / "model"), hist) == 600
    assert flows.register_flow(df, str(tmp_path / "model"), hist) == 600
    assert sinks.read_history(spark, hist).count() == 1200  # history kept by default
    flows.register_flow(df, str(tmp_path / "model"), hist, replace=True)
    assert sinks.read_history(spark, hist).count() == 600


def test_intake_flow(spark, tmp_path):
    p = tmp_path / "clientes.csv"
    p.write_text("id_cliente,nombre,ciudad,antiguedad_meses,tipo_contrato,plan,monto_mensual,"
                 "reclamos_ultimos_6_meses,pagos_atrasados,dias_sin_uso,satisfaccion,abandono\n"
                 " C1 ,Ana,santiago,12,mensual,fibra,100,0,0,1,5,0\n"
                 "C1,Dup,temuco,3,anual,tv,50,1,1,2,4,1\n"
                 "C2,Luis,valparaiso,x,anual,tv,80,2,0,3,3,1\n", encoding="utf-8")
    root = str(tmp_path / "state")
    st = flows.intake_flow(spark, str(p), root)
    assert st["datos_cargados"] and st["datos_preparados"]
    clean_rows = sinks.read_live(spark, root, "limpio").orderBy("id_cliente").collect()
    assert [r["id_cliente"] for r in clean_rows] == ["C1", "C2"]
    assert clean_rows[0]["ciudad"] == "Santiago" and clean_rows[1]["antiguedad_meses"] == 12
