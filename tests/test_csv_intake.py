"""CSV intake against pandas: quoting, line breaks, surplus and missing fields, white space, many files."""

import io
import os
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from churnlens import config
from churnlens.functions.coerce import coerce_numeric_columns
from churnlens.operators import clean
from churnlens.sources import csv_splits, sinks
from churnlens.sources.intake import read_customer_csv

HEADER = ",".join(config.REQUIRED_COLUMNS)
ROW = "{id},{name},Lima,12,Mensual,Fibra,100,0,0,1,5,0"


def write(tmp_path, text, name="c.csv"):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8", newline="")
    return str(p)


def test_quotes_commas_and_line_breaks_like_pandas(spark, tmp_path):
    names = ['"Eva ""Li"" Prado, X"', '"two\nlines"', '"a,b"', '""""', '" padded "', "plain", '"tab\tin"', '"crlf\r\nin"']
    text = HEADER + "\n" + "\n".join(ROW.format(id=f"C{i}", name=n) for i, n in enumerate(names)) + "\n"
    want = pd.read_csv(io.StringIO(text, newline=""), dtype=str)
    got = read_customer_csv(spark, write(tmp_path, text)).orderBy("_src", "_pos")
    rows = [[None if v is None else v.replace("\r\n", "\n") for v in r[:12]] for r in got.collect()]
    assert rows == [[v.replace("\r\n", "\n") for v in r] for r in want.values.tolist()]
    assert not any(r["_sobrante"] for r in got.collect())


def test_surplus_fields_make_the_file_invalid(spark, tmp_path):
    text = f"{HEADER}\n{ROW.format(id='C1', name='A')}\n{ROW.format(id='C2', name='B')},extra\n"
    with pytest.raises(pd.errors.ParserError):
        pd.read_csv(io.StringIO(text))
    df, verdict = sinks.load_and_validate_csv(spark, write(tmp_path, text))
    assert df is None and not verdict["es_valido"] and "1 registro" in verdict["errores"][0]


def test_commas_in_quotes_are_no_surplus(spark, tmp_path):
    short = "C9,\"x, \"\"y\"\", z, 1, 2, 3, 4, 5, 6, 7, 8\",Lima"  # fewer fields, many commas inside quotes
    text = f"{HEADER}\n{ROW.format(id='C1', name='A')}\n{short}\n"
    want = pd.read_csv(io.StringIO(text), dtype=str)
    df, verdict = sinks.load_and_validate_csv(spark, write(tmp_path, text))
    assert verdict["es_valido"]
    got = [list(r)[:12] for r in df.orderBy("_pos").collect()]
    assert got == want.astype(object).where(want.notna(), None).values.tolist()


def test_numbers_skip_all_ascii_white_space(spark):
    texts = ["12", " 12", "\t12", "12\n", "\r\n12\x0b", "\x0c1e2 ", "1 2", "", "\t", "x", "-3.5\t", "+4", None]
    want = pd.to_numeric(pd.Series([t.strip(" \t\n\r\x0b\x0c") if t else t for t in texts]), errors="coerce")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, edad string")
    got = [r["edad"] for r in coerce_numeric_columns(df).orderBy("i").collect()]
    assert got == [None if pd.isna(v) else v for v in want]


def test_thousands_of_files_keep_their_order(spark, tmp_path):
    folder = tmp_path / "many files #1"
    folder.mkdir()
    for i in range(3000):
        (folder / f"part {i:05d}.csv").write_text(f"{HEADER}\n{ROW.format(id=f'C{i % 1500}', name=f'N{i}')}\n")
    df = read_customer_csv(spark, str(folder))
    kept = clean.dedupe_first(df)
    assert df.select("_src").distinct().count() == 3000
    assert kept.count() == 1500
    assert {r["nombre"] for r in kept.select("nombre").collect()} == {f"N{i}" for i in range(1500)}


def test_empty_and_header_only_files(spark, tmp_path):
    df, verdict = sinks.load_and_validate_csv(spark, write(tmp_path, ""))
    assert df is None and verdict["errores"] == [config.MSG_CSV_EMPTY]
    df, verdict = sinks.load_and_validate_csv(spark, write(tmp_path, HEADER + "\n", "h.csv"))
    assert df is None and not verdict["es_valido"]


def test_written_csv_reads_back(spark, tmp_path):
    rows = [("C1", ' a "q" ', "x\ny"), ("C2", "p,q", " "), ("C3", None, "'")]
    out = os.path.join(tmp_path, "out")
    sinks.write_csv(spark.createDataFrame(rows, "id_cliente string, nombre string, ciudad string"), out)
    got = read_customer_csv(spark, out).select("id_cliente", "nombre", "ciudad").collect()
    assert sorted(map(tuple, got)) == rows


FIELDS = ["x", "", '"a,b"', '"say ""hi"""', '"two\nlines"', '"crlf\r\nin"', '"\n\n"', '5" screen', 'a"b"c', '""', " pad ",
          '"long ' + "z\n" * 60 + '"', '","', '"\n,""\n"', "é日"]


@pytest.mark.parametrize("split", [400, 1 << 20])
def test_reading_by_splits_equals_pandas_and_the_whole_reader(spark, tmp_path, split):
    rng, want = random.Random(split), []
    folder = tmp_path / "big"
    folder.mkdir()
    for k in range(2):
        lines = ["id,a,b"] if k else ['id,"a\n b",b']  # a header over two lines
        for i in range(40):
            lines.append(f"F{k}-{i},{rng.choice(FIELDS)},{rng.choice(FIELDS)}")
            if rng.random() < 0.1:
                lines.append("")  # blank lines are no records
        text = (rng.choice(["\n", "\r\n"]) if k else "\n").join(lines) + ("\n" if k == 1 else "")
        write(folder, text, f"f{k}.csv")
        want += pd.read_csv(io.StringIO(text, newline=""), dtype=str, keep_default_na=False).values.tolist()

    def rows(df):
        return [[(v or "").replace("\r\n", "\n") for v in r[:3]] for r in df.orderBy("_src", "_pos").collect()]

    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        got = read_customer_csv(spark, str(folder), by_splits=True)
        assert rows(got) == [[v.replace("\r\n", "\n") for v in r] for r in want]
        assert rows(read_customer_csv(spark, str(folder))) == rows(got)  # chosen by size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert rows(read_customer_csv(spark, str(folder), by_splits=False)) == rows(got)


def test_splits_mark_surplus_and_refuse_open_quotes(spark, tmp_path):
    path = write(tmp_path, 'a,b\n1,2,"3\n4"\n5\n"x,y",6\n')
    got = [tuple(r)[:3] for r in read_customer_csv(spark, path, by_splits=True).orderBy("_pos").collect()]
    assert got == [("1", "2", True), ("5", None, False), ("x,y", "6", False)]
    with pytest.raises(ValueError, match="not closed"):
        read_customer_csv(spark, write(tmp_path, 'a,b\n1,"2\n3,4\n', "open.csv"), by_splits=True)
    assert read_customer_csv(spark, write(tmp_path, "a,b\n", "head.csv"), by_splits=True).count() == 0


def test_states_of_splits_of_any_size():
    """Lines dealt to splits of one line and more: states and record numbers as one plain scan of the text finds."""
    rng = random.Random(2)
    for _ in range(60):
        text = "\n".join(",".join(rng.choice(FIELDS) for _ in range(3)) for _ in range(12))
        starts, at_field, inside, quoted = [False], True, False, False
        for c, after in zip(text, text[1:] + " ", strict=True):  # a plain reader, character by character
            if inside:
                if c == '"' and not quoted and after == '"':
                    quoted = True  # the first of two
                elif c == '"' and not quoted:
                    inside = False
                else:
                    quoted = False
            elif c == '"' and at_field:
                inside = True
            at_field = not inside and c in ",\n"
            if c == "\n":
                starts.append(inside)
        lines, at, rows, seen = text.split("\n"), 0, [], []
        while at < len(lines):
            n = rng.randint(1, 5)
            run = csv_splits._Run()
            seen.append(run.add(pa.array(lines[at:at + n])))
            rows.append(("f", at, *run.state, *run.records))
            at += n
        chained = csv_splits._chain(pd.DataFrame(rows, columns=["file", "block", "ends_out", "ends_in", "records_out",
                                                                "records_in"]).sample(frac=1, random_state=1))
        got, numbers = [], []
        for r, both in zip(chained.itertuples(), seen, strict=True):
            got += both[int(r.enters)][0].tolist()
            numbers += (both[int(r.enters)][2] + r.before).tolist()
        assert got == starts
        assert numbers == list(np.cumsum([not s and bool(t.strip(" \t\r")) for s, t in zip(starts, lines, strict=True)]))
