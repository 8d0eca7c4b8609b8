"""The cleaning pipeline against a plain-Python cleaner on generated rows, and its invariants."""

import math
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from churnlens import config
from churnlens.functions import bins
from churnlens.operators import clean

TEXTS = ["nombre", *config.CLEAN_TEXT_COLUMNS]
COLUMNS = [config.ID_COLUMN, *TEXTS, *config.CLEAN_NUMERIC_COLUMNS]
NUMBERS = ["0", "1", "2", "3", "4", "5", "2.5", "17", "18", "30", "61", "100", "101", "-4", " 7 ", "1e2", "many", "", None, "1,5", "NaN"]
WORDS = ["rio   seco", " san-juan", "LA PAZ", "\tona ", "", "   ", None, "o'higgins 3er", "ñandú"]


def generated(seed: int, n: int = 60) -> list[tuple]:
    rnd = random.Random(seed)
    ids = [f"{' ' * rnd.randrange(2)}c{rnd.randrange(n // 2)}{' ' * rnd.randrange(2)}" for _ in range(n - 6)] + ["", None, "  "] * 2
    rnd.shuffle(ids)
    return [(i, *(rnd.choice(WORDS) for _ in TEXTS), *(rnd.choice(NUMBERS) for _ in config.CLEAN_NUMERIC_COLUMNS[:-1]),
             rnd.choice(["0", "1", "1", "0", "2", "x", None])) for i in ids]


def frame(spark, rows: list[tuple], columns=COLUMNS):
    schema = ", ".join(f"{c} string" for c in columns) + ", _src int, _pos long"
    return spark.createDataFrame([(*r, 0, k) for k, r in enumerate(rows)], schema)


def as_number(text):
    t = None if text is None else text.strip()
    return float(t) if t and re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", t) else None


def plain_clean(rows: list[tuple]) -> tuple[list[dict], dict]:
    """The survey's rules one row at a time: rows, and the report as {(metric, column): value}."""
    report = {("filas_iniciales", None): len(rows)}
    seen, kept, blank = set(), [], 0
    for r in rows:
        row = dict(zip(COLUMNS, r, strict=True))
        row["id_cliente"] = " ".join((row["id_cliente"] or "").split())
        blank += row["id_cliente"] == ""
        if row["id_cliente"] and row["id_cliente"] not in seen:
            seen.add(row["id_cliente"])
            kept.append(row)
    report["ids_vacios_eliminados", None] = blank
    report["duplicados_eliminados", None] = len(rows) - blank - len(kept)
    for c in config.CLEAN_NUMERIC_COLUMNS:
        values = [as_number(r[c]) for r in kept]
        report["valores_no_convertibles", c] = sum(v is None and (r[c] or "").strip() != "" for v, r in zip(values, kept, strict=True))
        low, high = config.CLEAN_VALID_RANGES.get(c, (None, None))
        outside = [v is not None and (low is not None and v < low or high is not None and v > high) for v in values]
        if c in config.CLEAN_VALID_RANGES:
            report["valores_fuera_de_rango", c] = sum(outside)
        for r, v, out in zip(kept, values, outside, strict=True):
            r[c] = None if out else v
    left = [r for r in kept if r["abandono"] in (0.0, 1.0)]
    report["abandono_invalido_eliminado", None] = len(kept) - len(left)
    report["filas_finales", None], report["filas_eliminadas", None] = len(left), len(rows) - len(left)
    for c in config.CLEAN_MEDIAN_COLUMNS + config.CLEAN_ZERO_COLUMNS:
        known = [r[c] for r in left if r[c] is not None]
        report["valores_imputados", c] = len(left) - len(known)
        fill = 0.0 if c in config.CLEAN_ZERO_COLUMNS else statistics.median(known) if known else float(config.CLEAN_FALLBACKS[c])
        for r in left:
            r[c] = fill if r[c] is None else r[c]
    for r in left:
        r["nombre"] = " ".join((r["nombre"] or "").split()) or config.DEFAULT_NAME
        for c in config.CLEAN_TEXT_COLUMNS:
            r[c] = " ".join((r[c] or "").split()).title() or config.DEFAULT_CATEGORY
        for c in config.CLEAN_INTEGER_COLUMNS:
            r[c] = round(r[c])
    return left, report


@pytest.mark.parametrize("seed", range(4))
def test_rows_and_report_equal_a_plain_cleaner(spark, seed):
    rows = generated(seed)
    cleaned, report = clean.prepare(frame(spark, rows).repartition(1 + 2 * seed))
    expected, figures = plain_clean(rows)
    got = [{c: r[c] for c in COLUMNS} for r in cleaned.collect()]
    assert sorted(got, key=lambda r: r["id_cliente"]) == sorted(expected, key=lambda r: r["id_cliente"])
    found = {(r["metrica"], r["columna"]): r["valor"] for r in report.collect()}
    assert {k: found[k] for k in figures} == figures
    assert found["filas_iniciales", None] == found["filas_finales", None] + found["filas_eliminadas", None]
    assert [c for m, c in found if m == "columnas_derivadas"] == config.DERIVED_COLUMNS


def test_clean_rows_are_a_fixed_point(spark):
    # the texts but for the default category, which title case would change
    keep = ["id_cliente", "nombre", *config.CLEAN_NUMERIC_COLUMNS]
    once = clean.prepare(frame(spark, generated(11)))[0].select(*keep)
    again, report = clean.prepare(once.withColumns({"_src": F.lit(0), "_pos": F.monotonically_increasing_id()}))
    assert sorted(map(tuple, again.select(*keep).collect())) == sorted(map(tuple, once.collect()))
    assert sum(r["valor"] for r in report.collect() if r["metrica"] in (
        "filas_eliminadas", "valores_imputados", "valores_fuera_de_rango", "valores_no_convertibles")) == 0


@pytest.mark.parametrize("function,edges,last", [(bins.age_group, config.AGE_BINS, config.AGE_BIN_LAST),
                                                 (bins.tenure_group, config.TENURE_BINS, config.TENURE_BIN_LAST)])
def test_every_bin_ends_where_the_next_begins(spark, function, edges, last):
    labels = [label for _, label in edges] + [last]
    probes = [(float(upper) + d, labels[i + (d > 0)]) for i, (upper, _) in enumerate(edges) for d in (0, 0.5, 1)]
    df = spark.createDataFrame(probes, "x double, label string")
    assert df.where(function(F.col("x")) != F.col("label")).count() == 0


def test_satisfaction_levels_and_flags(spark):
    df = spark.createDataFrame([(x / 4,) for x in range(4, 21)], "x double")
    for x, level, flag in df.select("x", bins.satisfaction_level(F.col("x")), bins.flag_positive(F.col("x") - 3)).collect():
        assert level == (config.SATISFACTION_LOW if x <= 2 else config.SATISFACTION_MID if x == 3 else config.SATISFACTION_HIGH)
        assert flag == (x > 3)


def test_types_of_the_result(spark):
    types = dict(clean.prepare(frame(spark, generated(5)))[0].dtypes)
    assert all(types[c] == "bigint" for c in config.CLEAN_INTEGER_COLUMNS)
    assert types["monto_mensual"] == types["satisfaccion"] == "double"


def test_an_invalid_first_row_removes_its_customer(spark):
    # the first row of an id decides, whatever its target; later ones are duplicates
    for targets, left in ((("9", "1"), 0), (("1", "9"), 1), ((None, "0", "0"), 0)):
        df = frame(spark, [(" z ", t) for t in targets], ["id_cliente", "abandono"])
        assert clean.prepare(df)[0].count() == left


def test_fallbacks_fill_columns_without_a_number(spark):
    columns = ["id_cliente", *config.CLEAN_FALLBACKS, "abandono"]
    rows, report = clean.prepare(frame(spark, [(f"k{i}", *["?"] * len(config.CLEAN_FALLBACKS), "1") for i in range(3)], columns))
    assert all(r[c] == v for r in rows.collect() for c, v in config.CLEAN_FALLBACKS.items())
    used = {r["columna"]: r["valor"] for r in report.collect() if r["metrica"] == "valores_respaldo_usados"}
    assert used == {c: float(v) for c, v in config.CLEAN_FALLBACKS.items()} and not any(map(math.isnan, used.values()))


def test_empty_frame(spark):
    rows, report = clean.prepare(frame(spark, []))
    assert rows.count() == 0 and {r["valor"] for r in report.collect()} == {0.0}
