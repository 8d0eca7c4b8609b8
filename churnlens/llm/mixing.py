"""Mixing sources to target weights by weighted fair queueing.

Every copy of a document gets a virtual finish time: the words its source has sent up to and with it, in shuffled
order, divided by the source's target.  The copies with the earliest finish times, up to the total budget, are
the mix.  Running sums are taken in two levels (sums of many small ranges of rows, then within a range), so neither
a hot source or document nor the whole table ever meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.llm.common import own_columns_apart, stored, word_count

#: Share of all words that the mix takes.
BUDGET = 1.5
#: Times a document may be taken.
MAX_REPEAT = 2
#: Weights of the sources in code point order (null last), repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Rows of a bucket of the running sums, and of a range partition of the queue.
BUCKET_ROWS, QUEUE_ROWS = 4096, 500_000
#: From so many buckets on, they are larger instead of more.
SLOTS = 512
#: Hexadecimal digits of the hash that orders the documents of a source.
KEY_DIGITS = 15
#: A row's place in the order of its source.
PLACE = ["key", "words_hash", "size"]


def source_targets(sizes: DataFrame, budget: float = BUDGET, max_repeat: int = MAX_REPEAT,
                   weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, ...) -> the same with source_no and target (words).

    Targets are weight shares of ``budget`` times all words, stopped at ``max_repeat`` times the source's words;
    the excess goes to the other sources by weight.  In ascending order of limit per weight the stopped sources
    come first, so one running sum finds the common level: that of the first source that is not stopped.  One
    row per source meets in one task: a table of sources is small beside the documents.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    numbered = sizes.withColumn("source_no", F.row_number().over(
        Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("weight", w)
    numbered = numbered.withColumn("most", (max_repeat * F.col("source_size")).cast("double"))
    by_limit = Window.orderBy(F.col("most") / F.col("weight"), "source_no")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    after = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ((budget * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
             / F.sum("weight").over(after))
    at = numbered.withColumn("level", level).withColumn("stopped", F.col("most") / F.col("weight") <= F.col("level"))
    common = F.max(F.when(~F.col("stopped"), F.col("level"))).over(whole)
    return at.select(*sizes.columns, "source_no",
                     F.when(F.col("stopped"), F.col("most")).otherwise(common * F.col("weight")).alias("target"))


def mix(docs: DataFrame, budget: float = BUDGET, max_repeat: int = MAX_REPEAT,
        weights: tuple[float, ...] = WEIGHTS, seed: str = "", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs (doc_id, text, source, ...) -> all its columns, size, source_size, target, copies, taken.

    One row per row of ``docs``; ``copies`` (0 to ``max_repeat``) is how often the mix takes it and ``taken`` =
    copies * size; ``size`` counts words: a null or empty text counts 0 and is not taken.  A null source is a
    source of its own, the last one; a source without words has target 0.  The shuffle is the md5 of seed and
    doc_id (a null id counts as ''), then a hash of seed and text, then the size.  Rows equal in all of these are
    queued one by one too, so the cut may take part of them: those whose other columns have the least hash.  Reruns
    agree but for rows that are equal in every column.  An empty table gives no rows.  Columns of ``docs`` named
    like the added ones are replaced.

    Only (source, key, text hash, size) is shuffled.  The queue is cut at one virtual time, so a document's copies
    follow from a last place per source and copy: the documents themselves are read again and not shuffled.  Only
    where the cut parts equal rows are these rows stored and numbered.
    """
    return own_columns_apart(docs, ["doc_id", "text", "source"], lambda own: _mixed(
        own, budget, max_repeat, weights, seed, bucket_rows), ("size", "source_size", "target", "copies", "taken"))


def _mixed(docs: DataFrame, budget: float, max_repeat: int, weights: tuple[float, ...], seed: str, bucket_rows: int) -> DataFrame:
    """``mix`` of documents whose other columns have names that cannot clash."""
    own = docs.columns
    key = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))),
                             1, KEY_DIGITS), 16, 10).cast("long")
    text = F.xxhash64(F.lit(seed), F.col("text").cast("string"))
    size = word_count(F.col("text").cast("string"))
    sizes = stored(docs.select("source", key.alias("key"), text.alias("words_hash"), size.alias("size"),
                               F.monotonically_increasing_id().alias("row")), "mix-sizes")
    targets = stored(source_targets(
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")),
        budget, max_repeat, weights), "mix-targets")
    last = stored(_last_taken(sizes, targets, budget, max_repeat, bucket_rows), "mix-last")
    per_source = targets.join(last.groupBy("source_no").agg(F.collect_list(F.struct(
        F.struct(*PLACE).alias("place"), "part", "whole")).alias("lasts")), "source_no", "left").select(
        "source_no", F.col("source").alias("_s"), F.col("source_size").alias("_n"), F.col("target").alias("_t"),
        F.coalesce("lasts", F.array()).alias("lasts"))
    me = F.struct(*[F.col(f"_{c}").alias(c) for c in PLACE])
    every = F.size(F.filter("lasts", lambda c: (me < c.place) | ((me == c.place) & (c.part == c.whole))))
    parts = F.transform(F.filter("lasts", lambda c: (me == c.place) & (c.part < c.whole)), lambda c: c.part)
    placed = (docs.select(*own, key.alias("_key"), text.alias("_words_hash"), size.alias("_size"))
              .join(per_source, F.col("source").eqNullSafe(F.col("_s")))
              .withColumn("_copies", F.when(F.col("_size") > 0, every).otherwise(0).cast("int"))
              .withColumn("_parts", parts))

    def done(rows: DataFrame) -> DataFrame:
        return rows.select(*own, F.col("_size").alias("size"), F.col("_n").alias("source_size"),
                           F.col("_t").alias("target"), F.col("_copies").alias("copies"),
                           (F.col("_copies") * F.col("_size")).alias("taken"))

    parted = last.agg(F.sum(F.when(F.col("part") < F.col("whole"), F.col("whole")))).first()[0]
    if parted is None:
        return done(placed)
    kinds = dict(docs.dtypes)
    alike = stored(placed.where((F.col("_size") > 0) & (F.size("_parts") > 0))
                   .withColumn("_other", F.xxhash64(F.lit(seed), *[c for c in own if "map<" not in kinds[c]]))
                   .withColumn("_row", F.monotonically_increasing_id()), "mix-alike")
    group = ["source_no", "_key", "_words_hash", "_size"]
    numbered = _running(alike.select(*group, "_other", "_row", "_parts", F.lit(1).cast("long").alias("one")), group,
                        ["_other", "_row"], "one", parted, bucket_rows)
    ends = (numbered.where(F.array_contains("_parts", F.col("upto")))
            .select(*group, F.explode(F.filter("_parts", lambda p: p == F.col("upto"))), "_other", "_row")
            .groupBy(*group).agg(F.collect_list(F.struct("_other", "_row")).alias("_ends")))
    some = F.size(F.filter("_ends", lambda e: F.struct("_other", "_row") <= e))
    return done(placed.where((F.col("_size") <= 0) | (F.size("_parts") == 0))).unionByName(
        done(alike.join(stored(ends, "mix-ends"), group)
             .withColumn("_copies", (F.col("_copies") + some).cast("int"))))


def _running(rows: DataFrame, group: list[str], order: list[str], value: str, n: int, bucket_rows: int) -> DataFrame:
    """``rows`` with upto, the sum of ``value`` in its group up to and with each row; ``order`` has no ties.

    Rows are ranged by group and order into slots, so a group of any size, also of one key, takes many of them.
    """
    slots = max(1, min(-(-n // bucket_rows), max(SLOTS, -(-n // QUEUE_ROWS))))
    ranged = stored(rows.repartitionByRange(slots, *group, *order).withColumn("slot", F.spark_partition_id()),
                    "mix-slots")
    sums = ranged.groupBy(*group, "slot").agg(F.sum(value).alias("sum"))
    before = stored(sums.select(*group, "slot", (F.sum("sum").over(Window.partitionBy(*group).orderBy("slot"))
                                                 - F.col("sum")).alias("before")), "mix-before")
    upto = F.sum(value).over(Window.partitionBy(*group, "slot").orderBy(*order)
                             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (ranged.withColumn("within", upto).join(before, [*group, "slot"])
            .withColumn("upto", F.col("before") + F.col("within")).drop("slot", "before", "within"))


def _last_taken(sizes: DataFrame, targets: DataFrame, budget: float, max_repeat: int, bucket_rows: int) -> DataFrame:
    """(source_no, copy, key, words_hash, size, part, whole): for each copy that the mix takes, the source's last
    place in the queue, how many of the rows of this place it takes, and how many there are."""
    t = targets.where("source_size > 0")
    n, words = t.agg(F.sum("n"), F.sum("source_size")).first()
    row = (sizes.where("size > 0").join(t.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
           .select("source_no", *PLACE, "row"))
    sent = _running(row, ["source_no"], [*PLACE, "row"], "size", n or 0, bucket_rows).join(
        t.select("source_no", "source_size", "target"), "source_no")
    copies = (sent.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1))))
              .select("source_no", *PLACE, "row", "copy",
                      ((F.col("copy") * F.col("source_size") + F.col("upto")) / F.col("target")).alias("finish")))
    by = ["finish", "source_no", *PLACE, "row", "copy"]
    queue = stored(copies.repartitionByRange(max(1, -(-(n or 0) * max_repeat // QUEUE_ROWS)), *by)
                   .sortWithinPartitions(*by).withColumn("slot", F.spark_partition_id()), "mix-queue")
    ends = (queue.groupBy("slot").agg(F.sum("size").alias("words"))
            .select("slot", "words", F.sum("words").over(Window.orderBy("slot")).alias("end")))
    total = budget * (words or 0)
    edge = ends.where(F.col("end") > total).orderBy("slot").limit(1).first()
    taken = queue
    if edge is not None:
        order = Window.partitionBy("slot").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        at_edge = (queue.where(F.col("slot") == edge["slot"]).withColumn("upto", F.sum("size").over(order))
                   .where(F.col("upto") <= total - (edge["end"] - edge["words"])).drop("upto"))
        taken = queue.where(F.col("slot") < edge["slot"]).unionByName(at_edge)
    last = stored(taken.groupBy("source_no", "copy").agg(F.max(F.struct(*PLACE, "row")).alias("last"))
                  .select("source_no", "copy", "last.*").withColumnRenamed("row", "last_row"), "mix-places")
    return (row.join(last, ["source_no", *PLACE]).groupBy("source_no", "copy", *PLACE)
            .agg(F.count(F.when(F.col("row") <= F.col("last_row"), 1)).alias("part"), F.count("*").alias("whole")))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents the mix takes, each as often as it takes it, with the columns of ``docs``."""
    return own_columns_apart(docs, ["doc_id", "text", "source"], lambda own: mix(own, **options).withColumn(
        "_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))))
