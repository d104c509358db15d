"""Line dedup over levelled sorted runs of line hashes. DataFrame functions only.

Documents come in batches. A batch is reduced to one row per line key (128-bit hash,
number of documents, largest document id). A merge anti-join with the runs written before leaves
its fresh keys, which it adds as a run of its own; so every key lies in one run. What
the batch says of known keys, their counts and largest ids, goes to a second table of the same run, which
the result needs as well. Both are bucketed by the hash and sorted, so that later merges read them
without a shuffle. As soon as a level holds ``fan_out`` runs they are compacted into one run of the
next level.

A line's key is the line without white space (space, U+0009 to U+000D) at both ends, A-Z
lower-cased. Keys of at least ``least`` code points that occur in at least ``common``
documents lose their lines everywhere but in the document with the largest id; shorter
lines always stay.

Rules: a null text is one empty line. Each row counts as a document; rows that share the
largest id all keep their lines. A null id is smaller than any other. Other columns are
not read. Repeated rows get the same result each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.llm.common import BLANKS, ascii_lower, free_name, stored
from tickframe.session import work_dir

LEAST, COMMON, BATCHES, FAN_OUT = 40, 5, 4, 2
KEY = ["h1", "h2"]


def _hashed(line: Column, pos: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"), pos.alias("pos"))


def line_keys(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``doc_id, text_hash, h1, h2, pos, first``: lines with a key of ``least`` code points or more.

    ``first`` marks one line for each key of a document: its entries are sorted by hash
    inside the row, so a document is never shuffled to count its keys.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(whole).alias("text_hash"),
        F.split(ascii_lower(whole), "\n").alias("lines"),
    )
    keys = F.transform("lines", lambda x, i: F.struct(F.btrim(x, F.lit(BLANKS)).alias("k"), i.alias("i")))
    keys = F.filter(keys, lambda x: F.length(x["k"]) >= least)
    entries = lines.select("doc_id", "text_hash", keys.alias("keys")).select(
        "doc_id", "text_hash", F.sort_array(F.transform("keys", lambda x: _hashed(x["k"], x["i"]))).alias("e"))
    first = lambda x, i: (i == 0) | (x["h1"] != F.col("e")[i - 1]["h1"]) | (x["h2"] != F.col("e")[i - 1]["h2"])
    marked = F.transform("e", lambda x, i: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["pos"].alias("pos"),
                                                    first(x, i).alias("first")))
    return entries.select("doc_id", "text_hash", F.inline(marked))


#: A run: its keys, which no other run has, and what it says of other runs' keys.
Run = tuple[DataFrame, DataFrame | None]


class LineRuns:
    """Runs of line hashes below one shared folder; ``add`` takes the next batch."""

    def __init__(self, spark: SparkSession, fan_out: int = FAN_OUT, buckets: int | None = None):
        self.spark, self.fan_out = spark, fan_out
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.base, self.id = work_dir(spark, "line_runs"), uuid.uuid4().hex[:12]
        self.levels: list[list[Run]] = []
        self.written = 0

    def _write(self, rows: DataFrame) -> DataFrame:
        name = f"line_run_{self.id}_{self.written}"
        self.written += 1
        (rows.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
         .option("path", f"{self.base}/{name}").saveAsTable(name))
        return self.spark.table(name)

    def _put(self, level: int, run: Run) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan_out:
            full, self.levels[level] = self.levels[level], []
            updates = [u for _, u in full if u is not None]
            self._put(level + 1, (self._write(merged([k for k, _ in full])), self._write(merged(updates)) if updates else None))

    @property
    def runs(self) -> list[Run]:
        return [r for level in self.levels for r in level]

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The batch's keys that no run holds: a merge anti-join with each run."""
        for keys, _ in self.runs:
            batch = batch.join(keys.select(*KEY).hint("merge"), KEY, "left_anti")
        return batch

    def add(self, lines: DataFrame) -> None:
        """Adds the keys of a batch (``doc_id, h1, h2, first``) as a run."""
        batch = self._write(lines.groupBy(*KEY).agg(F.count_if("first").alias("n_docs"), F.max("doc_id").alias("last_doc")))
        if not self.runs:
            return self._put(0, (batch, None))
        fresh = self._write(self.fresh(batch))
        known = batch.join(fresh.select(*KEY).hint("merge"), KEY, "left_anti")
        return self._put(0, (fresh, self._write(known)))

    def keys(self) -> DataFrame:
        """``h1, h2, n_docs, last_doc`` of every key."""
        return merged([t for run in self.runs for t in run if t is not None])

    def forget(self) -> None:
        """Takes the runs' names out of the session; the files stay with the shared folder."""
        for n in range(self.written):
            self.spark.sql(f"DROP TABLE IF EXISTS line_run_{self.id}_{n}")


def merged(tables: list[DataFrame]) -> DataFrame:
    """One table out of several: sorted buckets are merged pair by pair, counts added up."""
    both = tables[0]
    for table in tables[1:]:
        a, b = both.alias("a"), table.hint("merge").alias("b")
        both = a.join(b, (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2")), "full").select(
            *(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in KEY),
            (F.coalesce("a.n_docs", F.lit(0)) + F.coalesce("b.n_docs", F.lit(0))).alias("n_docs"),
            F.greatest("a.last_doc", "b.last_doc").alias("last_doc"))
    return both


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST,
                common: int = COMMON, batches: int = BATCHES, fan_out: int = FAN_OUT) -> DataFrame:
    """The documents with ``kept_text``, ``n_lines`` and ``n_dropped`` added (clashing names get a trailing _)."""
    spark = docs.sparkSession
    path = work_dir(spark, "lines")
    lines = line_keys(docs, doc_id, text, least)
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    lines.withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(lines.withColumn("batch", batch).schema).parquet(path)
    runs = LineRuns(spark, fan_out)
    for n in range(batches):
        runs.add(lines.filter(F.col("batch") == n))
    # Stored without buckets, so that the join shuffles both sides and Spark can split a key
    # that a large part of the documents hold.
    common_keys = stored(runs.keys().filter(F.col("n_docs") >= common).select(*KEY, "last_doc"), "common_lines")
    runs.forget()
    drop = (
        lines.join(common_keys, KEY).filter(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
        .groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("drop"))
    )
    return _without(docs, drop, doc_id, text)


def _without(docs: DataFrame, drop: DataFrame, doc_id: str, text: str) -> DataFrame:
    names = {n: free_name(docs, n) for n in ("kept_text", "n_lines", "n_dropped", "_hash")}
    whole = F.coalesce(F.col(text), F.lit(""))
    left = docs.withColumn(names["_hash"], F.xxhash64(whole)).alias("d")
    # The hash side is the small one; documents stream past it unsorted.
    joined = left.join(drop.alias("x").hint("shuffle_hash"),
                       F.col(f"d.{doc_id}").eqNullSafe(F.col("x.doc_id"))
                       & (F.col(f"d.{names['_hash']}") == F.col("x.text_hash")), "left")
    lines = F.split(F.coalesce(F.col(f"d.{text}"), F.lit("")), "\n")
    cut = joined.select("d.*", F.col("x.drop").alias("_drop"), lines.alias("_lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    out = cut.withColumn(names["kept_text"], F.when(F.col("_drop").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(
        F.array_join(F.transform(kept, lambda i: F.col("_lines")[i]), "\n")))
    return out.withColumns({
        names["n_lines"]: F.size("_lines").cast("long"),
        names["n_dropped"]: F.coalesce(F.size(F.coalesce("_drop", F.array().cast("array<int>"))), F.lit(0)).cast("long"),
    }).drop("_drop", "_lines", names["_hash"])
