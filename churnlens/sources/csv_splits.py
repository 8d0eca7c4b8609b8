"""Records of large quoted CSV files, read by splits: quoted line breaks do not make a file one task.

Whether a split starts inside a quoted field depends on all splits before it.  Each line is a function of two
states (outside or inside quotes); a first pass composes the functions of every split's lines to one row per
split, these rows are chained per file, and a second pass over the lines knows the state each split starts with.
A line that starts and ends outside is a record; only the lines of records that span several are regrouped.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.session import ensure_checkpoint_dir

# a quoted field up to its closing quote, and any field; a quote inside an unquoted field is plain text
_OPEN = r'"[^"]*(?:""[^"]*)*'
_FIELD = rf'(?:[^",][^,]*|{_OPEN}"(?:[^",][^,]*)?)?'
#: Lines that end inside quotes, having started outside or inside.
_OPENS = rf"^(?:{_FIELD},)*{_OPEN}$"
_STAYS = rf'^[^"]*(?:""[^"]*)*(?:$|"(?:[^",][^,]*)?(?:,{_FIELD})*,{_OPEN}$)'
_LINE_FIELDS = ("value string, file string, block long, line long, starts_out boolean, starts_in boolean, "
                "ends_out boolean, ends_in boolean, nth_out long, nth_in long")
_BLOCK_FIELDS = "file string, block long, ends_out boolean, ends_in boolean, records_out long, records_in long"


class _Run:
    """The state at a place of a split, for a split that starts outside (0) and one that starts inside (1) quotes."""

    def __init__(self):
        self.lines, self.state, self.records = 0, [False, True], [0, 0]

    def add(self, values: pa.Array) -> list[np.ndarray]:
        """Starts, ends and record numbers of the next lines under both states."""
        def flags(a) -> np.ndarray:
            return a.to_numpy(zero_copy_only=False).astype(bool)

        quoted = flags(pc.match_substring(values, '"'))
        opens, stays = np.zeros(len(values), bool), np.ones(len(values), bool)
        if quoted.any():
            some = values.filter(pa.array(quoted))
            opens[quoted], stays[quoted] = (flags(pc.match_substring_regex(some, p)) for p in (_OPENS, _STAYS))
        full = flags(pc.not_equal(pc.ascii_trim(values, " \t\r"), ""))
        fixed, swaps = opens == stays, np.cumsum(opens & ~stays)
        last = np.maximum.accumulate(np.where(fixed, np.arange(len(values)), -1))
        since = swaps - np.where(last >= 0, swaps[last], 0)
        out = []
        for h in (0, 1):
            ends = np.where(last >= 0, opens[last], self.state[h]) ^ (since % 2 == 1)
            starts = np.concatenate([[self.state[h]], ends[:-1]])
            nth = self.records[h] + np.cumsum(~starts & full)
            self.state[h], self.records[h] = bool(ends[-1]), int(nth[-1])
            out.append((starts, ends, nth))
        self.lines += len(values)
        return out


def _runs(batches: Iterator[pa.RecordBatch]):
    """(file, block, run, values, first line, states) of consecutive lines of one split; a new run per split."""
    key, run = None, _Run()
    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks = batch.column(1).dictionary_encode(), batch.column(2).to_numpy()
        names = files.indices.to_numpy()
        cuts = np.flatnonzero((np.diff(names) != 0) | (np.diff(blocks) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            here = (files.dictionary[int(names[a])].as_py(), int(blocks[a]))
            if here != key:
                key, run = here, _Run()
            values, first = batch.column(0).slice(a, b - a), run.lines
            yield *here, run, values, first, run.add(values)


def _lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for file, block, run, values, first, ((s0, e0, n0), (s1, e1, n1)) in _runs(batches):
        n = len(values)
        yield pa.record_batch(
            [values, pa.array([file] * n, pa.string()), pa.array(np.full(n, block)),
             pa.array(np.arange(first, first + n)), *map(pa.array, (s0, s1, e0, e1, n0, n1))],
            [f.split()[0] for f in _LINE_FIELDS.split(", ")])


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def row(file, block, run):
        return pa.RecordBatch.from_pydict({
            "file": pa.array([file], pa.string()), "block": pa.array([block], pa.int64()),
            "ends_out": [run.state[0]], "ends_in": [run.state[1]],
            "records_out": pa.array([run.records[0]], pa.int64()),
            "records_in": pa.array([run.records[1]], pa.int64())})

    last = None
    for file, block, run, *_ in _runs(batches):
        if last and last[2] is not run:
            yield row(*last)
        last = (file, block, run)
    if last:
        yield row(*last)


def _chain(rows):
    """The splits of one file in order: the state each starts with and the records that begin before it."""
    rows = rows.sort_values("block")
    inside, records, enters, before = False, 0, [], []
    for out, in_, n_out, n_in in zip(rows.ends_out, rows.ends_in, rows.records_out, rows.records_in, strict=True):
        enters.append(inside)
        before.append(records)
        records += n_in if inside else n_out
        inside = bool(in_ if inside else out)
    leaves = [False] * (len(rows) - 1) + [inside]  # only the file's last split: is a quoted field left open
    return rows[["file", "block"]].assign(enters=enters, before=before, unclosed=leaves)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """The records behind each file's header as text: record, file, pos (increasing within the file).

    Line breaks inside quoted fields are kept; "\\n" and "\\r\\n" end a record; blank lines are left out.  A quoted
    field that is still open at the end of a file raises.  The largest unit of work is a split, or a record that
    is larger.
    """
    text = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    folder = os.path.join(ensure_checkpoint_dir(spark), "csv-splits", uuid.uuid4().hex)
    (text.mapInArrow(_blocks_of, _BLOCK_FIELDS).groupBy("file")
     .applyInPandas(_chain, "file string, block long, enters boolean, before long, unclosed boolean")
     .write.parquet(folder))
    blocks = spark.read.parquet(folder)
    bad = blocks.where("unclosed").select("file").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['file']}: a quoted field is not closed")

    def known(name: str):
        return F.when(F.col("enters"), F.col(f"{name}_in")).otherwise(F.col(f"{name}_out"))

    lines = (text.mapInArrow(_lines_of, _LINE_FIELDS).join(blocks, ["file", "block"])
             .select("file", "value", (F.col("block") + F.col("line")).alias("pos"), known("starts").alias("starts"),
                     known("ends").alias("ends"), (F.col("before") + known("nth")).alias("nth"))
             .where("nth > 1"))  # the first record is the header
    whole = lines.where("NOT starts AND NOT ends").select("value", "file", "pos")
    parts = (lines.where("starts OR ends").groupBy("file", "nth")
             .agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("p"))
             .select(F.array_join(F.transform("p", lambda x: x["value"]), "\n").alias("value"), "file",
                     F.col("p")[0]["pos"].alias("pos")))
    records = whole.unionByName(parts)
    return (records.where(F.trim(F.translate("value", "\t\r", "")) != "")
            .select(F.regexp_replace("value", r"\r\z", "").alias("record"), "file", "pos"))
