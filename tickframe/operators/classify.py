"""Text classifiers for category, priority and assignment group.

Features are the TF-IDF weights of ``operators.text`` over the most frequent terms; the classifier is a linear
support vector machine, one class against the rest, with calibrated probabilities (``operators.svm``). The
vocabulary and the coefficients are small (``max_terms`` times the classes) and sent to the tasks, so a ticket is scored
where it lies: no ticket is shuffled, one or a billion take the same path.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe.functions.clean import priority_short_label
from tickframe.functions.rules import classify_subcategory
from tickframe.functions.text import term_frequencies, tokens, unigrams_bigrams
from tickframe.operators import svm
from tickframe.operators.text import term_counts, vocabulary
from tickframe.session import dealt, stored

# Training limits and answers without a model.
FEATURE_TERMS = 8_000
MIN_CLASS_ROWS = 5
MIN_ROWS = 40
FOLDS = 3
#: Tickets, drawn by their number's hash, whose fit is where the fit of all tickets starts; fewer than twice as many need none.
EARLY = 100_000
NO_MODEL = {"category": ("General", 0.5), "priority": (3, 0.5)}
# End of fixed values.


@dataclass
class TextModel:
    label: str
    classes: list[str]
    terms: list[str]
    idf: np.ndarray
    machines: svm.Machines
    rows: int
    accuracy: float


def held_out(key: str = "number") -> Column:
    """About a fifth of the tickets, by their number's hash: never learnt from."""
    return F.substring(F.md5(F.col(key).cast("string")), 1, 1).isin("0", "1", "2")


def fold(folds: int, key: str = "number") -> Column:
    """0 to ``folds`` - 1 by the ticket number's hash."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds))


def _terms(df: DataFrame, text: str) -> Column:
    """array<struct<term, tf>> of each text; null without terms. A column that holds such arrays is taken as it is."""
    given = isinstance(df.schema[text].dataType, T.ArrayType)
    return (F.col(text) if given else term_frequencies(unigrams_bigrams(tokens(text, accents=False)))).alias("_terms")


def _sparse(column: pa.Array, terms: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term numbers, TF-IDF weights of length one, and where each text's begin (and the last ends)."""
    lengths = np.nan_to_num(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    cells = column.flatten()
    idx = pc.index_in(cells.field("term"), value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(column)), lengths)[idx >= 0]
    tf = cells.field("tf").to_numpy(zero_copy_only=False)[idx >= 0]
    idx = idx[idx >= 0]
    val = (1 + np.log(tf)) * idf[idx]
    norm = np.sqrt(np.bincount(row, val * val, len(column)))
    return idx, val / norm[row], np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(column)))]).astype(np.int64)


def _features(rows: DataFrame, terms: list[str], idf: np.ndarray) -> DataFrame:
    """Packed blocks (``svm.packed``) of rows with ``label``, ``balance``, ``fold``, ``early`` and ``_terms``; nothing is shuffled."""
    given = rows.select("label", "balance", "fold", "early", "_terms")
    held = rows.sparkSession.sparkContext.broadcast((terms, idf))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, idf = held.value
        names = pa.array(names, pa.string())
        for b in batches:
            is_early = b.column("early").to_numpy(zero_copy_only=False)
            for early in (True, False):
                own = b.filter(pa.array(is_early == early))
                if own.num_rows:
                    columns = (own.column(c).to_numpy() for c in ("label", "balance", "fold"))
                    found = [*svm.packed(*_sparse(own.column("_terms"), names, idf), *columns)]
                    yield pa.RecordBatch.from_arrays([pa.array([early] * len(found)), pa.array(found, pa.binary())], ["early", "block"])

    return given.mapInArrow(pack, "early boolean, block binary")


def train(df: DataFrame, label: str, key: str = "number", text: str = "text",
          where: Column | None = None, max_iter: int = svm.STEPS, max_terms: int = FEATURE_TERMS,
          unseen: Column | None = None) -> TextModel | None:
    """Fit on the tickets that are not held out (or not ``unseen``, if given), of all classes with enough rows.

    None when fewer than MIN_ROWS tickets or two classes remain. Words and features are written
    to the shared work folder: the fit reads them many times and survives lost executors. ``text`` may hold words counted
    before (``_terms``).
    ``max_terms`` and the number of classes make the size of the model, which the driver holds.
    """
    y = F.col(label).cast("string")
    rows = df.where(F.trim(y) != "")
    if where is not None:
        rows = rows.where(where)
    number = F.col(key).cast("string")
    keep = (y.alias("y"), (held_out(key) if unseen is None else unseen).alias("held_out"), _terms(df, text),
            F.pmod(F.xxhash64(number), F.lit(FOLDS)).alias("fold"), F.pmod(F.xxhash64(number, F.lit("early")), F.lit(1 << 20)).alias("chance"))
    # Words are split once, and the tickets, which may be a long plan, read once.
    rows = rows.select(*keep) if isinstance(df.schema[text].dataType, T.ArrayType) else dealt(rows.select(*keep), f"tickets-{label}")
    sizes = rows.groupBy("y").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_CLASS_ROWS)
    everything, in_order = Window.partitionBy(), Window.partitionBy().orderBy("y")
    classes = stored(sizes.select(
        "y", "n", (F.row_number().over(in_order) - 1).cast("double").alias("label"), F.sum("n").over(everything).alias("all"),
        (F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n"))).alias("balance")), f"classes-{label}")
    known = classes.orderBy("label").collect()
    n = known[0]["all"] if known else 0
    if n < MIN_ROWS or len(known) < 2:
        return None
    rows = rows.join(F.broadcast(classes.select("y", "label", "balance")), "y")
    learn = rows.where(~F.col("held_out"))
    size = learn.count()
    counts = learn.select(F.inline("_terms"))
    found = vocabulary(counts, learn, max_terms, 2).orderBy("term").collect()
    if not found:
        return None
    terms, idf = [r["term"] for r in found], np.array([r["idf"] for r in found])
    first = EARLY if size >= 2 * EARLY else 0
    learn = learn.withColumn("early", F.col("chance") < int(first / size * (1 << 20)))
    features = dealt(_features(learn, terms, idf), f"features-{label}")
    early, n_early = None, 0
    if first:
        early, n_early = dealt(features.where("early"), f"early-{label}"), learn.where("early").count()
    machines = svm.fit(features, len(terms), len(known), size, FOLDS, max_iter, early, n_early)
    m = TextModel(label, [r["y"] for r in known], terms, idf, machines, n, 0.0)
    best = score(m, rows.where("held_out"), ["label"], "_terms", 1).select(
        F.col("ranked")[0]["class"].alias("found"), F.element_at(F.array(*map(F.lit, m.classes)), F.col("label").cast("int") + 1).alias("y"))
    m.accuracy = float(best.agg(F.avg((F.col("found") == F.col("y")).cast("int"))).first()[0] or 0.0)
    return m


def save_model(m: TextModel, path: str) -> None:
    """Vocabulary, coefficients with their curves, and what else ``load_model`` needs, next to each other."""
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(i, t, float(x)) for i, (t, x) in enumerate(zip(m.terms, m.idf))], "idx int, term string, idf double") \
        .write.mode("overwrite").parquet(f"{path}/terms")
    k = m.machines
    rows = [(f, c, m.classes[c], float(k.slope[f, c]), float(k.shift[f, c]), [float(x) for x in k.weights[:, f * k.classes + c]])
            for f in range(k.folds) for c in range(k.classes)]
    spark.createDataFrame(rows, "fold int, number int, class string, slope double, shift double, weights array<double>") \
        .write.mode("overwrite").parquet(f"{path}/machines")
    spark.createDataFrame([(m.label, m.rows, m.accuracy)], "label string, rows long, accuracy double") \
        .write.mode("overwrite").parquet(f"{path}/about")


def load_model(spark: SparkSession, path: str) -> TextModel:
    about = spark.read.parquet(f"{path}/about").first()
    terms = spark.read.parquet(f"{path}/terms").orderBy("idx").collect()
    rows = spark.read.parquet(f"{path}/machines").orderBy("fold", "number").collect()
    folds = rows[-1]["fold"] + 1
    curves = [np.array([r[c] for r in rows]).reshape(folds, -1) for c in ("slope", "shift")]
    machines = svm.Machines(np.array([r["weights"] for r in rows]).T, *curves, folds)
    return TextModel(about["label"], [r["class"] for r in rows if r["fold"] == 0], [r["term"] for r in terms],
                     np.array([r["idf"] for r in terms]), machines, about["rows"], about["accuracy"])


def training_report(df: DataFrame, m: TextModel | None, label: str) -> DataFrame:
    """One row: what was learnt from how many tickets, and the held-out accuracy."""
    return df.agg(F.count("*").alias("total_incidents")).withColumns({
        "label": F.lit(label), "trained_rows": F.lit(m.rows if m else 0),
        "classes": F.lit(len(m.classes) if m else 0),
        "accuracy": F.bround(F.lit(m.accuracy if m else 0.0), 3)})


def score(m: TextModel, df: DataFrame, keep: list[str], text: str = "text", k: int = 1) -> DataFrame:
    """``keep`` columns with ``ranked``: the ``k`` likeliest classes as array<struct<p, class>>.

    Each ticket is weighed and scored in place; no more than ``k`` classes leave a task for each ticket.
    """
    given = df.select(*keep, _terms(df, text))
    held = df.sparkSession.sparkContext.broadcast(m)
    schema = T.StructType([*given.schema.fields[:-1], T.StructField("ranked", T.ArrayType(
        T.StructType([T.StructField("p", T.DoubleType()), T.StructField("class", T.StringType())])))])
    k = min(k, len(m.classes))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        terms, names = pa.array(model.terms, pa.string()), np.array(model.classes, object)
        # Of equal probabilities the class with the larger name comes first.
        order = np.argsort(names, kind="stable")[::-1]
        for b in batches:
            idx, val, starts = _sparse(b.column("_terms"), terms, model.idf)
            best, p_of = np.empty((b.num_rows, k), np.int64), np.empty((b.num_rows, k))
            for at in range(0, b.num_rows, svm.ROWS):
                to = min(b.num_rows, at + svm.ROWS)
                p = model.machines.probabilities(*svm.dense(idx, val, starts[at: to + 1], len(model.terms)))
                down = -p[:, order]
                first = down.argmin(axis=1)[:, None] if k == 1 else np.argsort(down, axis=1, kind="stable")[:, :k]
                best[at:to] = order[first]
                p_of[at:to] = np.take_along_axis(p, best[at:to], 1)
            cells = pa.StructArray.from_arrays([pa.array(p_of.ravel()), pa.array(names[best.ravel()], pa.string())], ["p", "class"])
            offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(offsets, cells)], names=schema.names)

    return given.mapInArrow(rank, schema)


def predict_category(m: TextModel | None, df: DataFrame, key: str = "number", text: str = "text") -> DataFrame:
    """Best category with its probability, and the rule-based subcategory."""
    if m is None:
        name, conf = NO_MODEL["category"]
        out = df.select(key, text, F.lit(name).alias("category"), F.lit(conf).alias("confidence"))
    else:
        b = F.col("ranked")[0]
        out = score(m, df, [key, text], text).select(key, text, b["class"].alias("category"), F.bround(b["p"], 3).alias("confidence"))
    return out.withColumn("subcategory", classify_subcategory("category", text)).drop(text)


def predict_priority(m: TextModel | None, df: DataFrame, hint: str | None = None,
                     key: str = "number", text: str = "text") -> DataFrame:
    """Best priority with its probability; a given hint wins with certainty."""
    given = F.col(hint) if hint else F.lit(None).cast("int")
    rows = df.select(key, text, given.alias("_hint"))
    if m is None:
        value, conf = NO_MODEL["priority"]
        out = rows.select(key, "_hint", F.lit(value).alias("predicted"), F.lit(conf).alias("p"))
    else:
        best = F.col("ranked")[0]
        out = score(m, rows, [key, "_hint"], text).select(key, "_hint", best["class"].cast("int").alias("predicted"),
                                                          F.bround(best["p"], 3).alias("p"))
    given = F.col("_hint")
    priority = F.coalesce(given, F.col("predicted"))
    return out.select(key, priority.alias("priority"),
                      F.when(given.isNotNull(), 1.0).otherwise(F.col("p")).alias("confidence"),
                      F.coalesce(priority_short_label(priority), F.lit("P3-Moderate")).alias("priority_label"))


def predict_group_topk(m: TextModel | None, df: DataFrame, stats: DataFrame, k: int = 5,
                       key: str = "number", text: str = "text") -> DataFrame:
    """The k likeliest groups per ticket with each group's record."""
    if m is None:
        return df.select(key, F.lit(0).alias("rank"), F.lit("").alias("group"),
                         F.lit(0.0).alias("confidence")).where("false").join(stats, "group", "left")
    top = score(m, df, [key], text, k).select(key, F.posexplode("ranked").alias("rank", "c"))
    return top.select(key, (F.col("rank") + 1).alias("rank"), F.col("c.class").alias("group"),
                      F.bround("c.p", 3).alias("confidence")).join(stats, "group", "left")


def confusion(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")) \
        .agg(F.count("*").alias("count"))


def class_metrics(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 per class, from the confusion counts."""
    cells = confusion(rows, actual, predicted)
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("count"))
    both = cells.select(F.inline(F.array(
        F.struct(F.col("actual").alias("class"), hit.alias("tp"), F.col("count").alias("is"), F.lit(0).cast("long").alias("said")),
        F.struct(F.col("predicted").alias("class"), F.lit(None).cast("long").alias("tp"), F.lit(0).cast("long").alias("is"),
                 F.col("count").alias("said")))))
    p = F.try_divide(F.col("tp").cast("double"), F.col("said"))
    r = F.try_divide(F.col("tp").cast("double"), F.col("is"))
    return (both.groupBy("class").agg(F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"), F.sum("is").alias("is"),
                                      F.sum("said").alias("said"))
            .select("class", F.col("is").alias("support"), F.bround(p, 3).alias("precision"),
                    F.bround(r, 3).alias("recall"),
                    F.bround(F.coalesce(F.try_divide(2.0 * p * r, p + r), F.lit(0.0)), 3).alias("f1")))


def cross_predict_priority(learn: DataFrame, df: DataFrame, folds: int = 4, key: str = "number",
                           text: str = "text") -> DataFrame:
    """``predict_priority`` for every ticket of ``df``, each by a model that did not learn from it.

    The tickets are dealt to ``folds`` by their number; one model per fold learns from the other folds.
    """
    parts = []
    learn, df = (dealt(rows.select(key, *also, fold(folds, key).alias("_part"), _terms(rows, text)), "words")
                 for rows, also in ((learn, ["priority"]), (df, [])))
    for i in range(folds):
        mine = F.col("_part") == i
        parts.append(predict_priority(train(learn, "priority", key, "_terms", unseen=mine), df.where(mine), key=key, text="_terms"))
    return reduce(DataFrame.unionByName, parts)


def priority_mismatch(predicted: DataFrame, df: DataFrame, min_confidence: float = 0.7,
                      key: str = "number") -> DataFrame:
    """Tickets whose predicted priority differs from the assigned one with confidence."""
    return (df.select(key, F.col("priority").alias("assigned"))
            .join(predicted.select(key, F.col("priority").alias("predicted"), "confidence"), key)
            .where((F.col("assigned") != F.col("predicted")) & (F.col("confidence") > min_confidence)))
