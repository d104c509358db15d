"""Exact dedup by content-defined chunk recipes. DataFrame functions only.

A text is cut where its own content says so: after the first sentence or line end that
follows ``least`` characters, or after ``most`` characters where there is none. Equal
texts are cut alike, so a text equals another one exactly when their ordered chunk
lists are equal. Chunks get a 64-bit identifier that is *verified*: every distinct
chunk is grouped by its identifier and its whole text, and where two texts share an
identifier they are told apart by rank. After that only lists of identifiers move;
a long document never does, and a repeated chunk moves once per task.

Rules: a null text is empty, all empty texts are equal; A-Z count as a-z. Of equal rows
the one with the largest id stays; rows that also share the id are ties, of which one
stays. A null id is smaller than any other. Columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe.llm.common import DOCUMENTS, ascii_lower, few_files, id_key, one_row_per_key, stored

LEAST, MOST = 1024, 8192
#: Shared identifiers that are sent to every task at most.
FEW_CLASHES = 1_000_000


def chunk_pattern(least: int = LEAST, most: int = MOST) -> str:
    """``least`` characters or more up to a sentence or line end, else up to ``most``."""
    return rf"(?s).{{{least},{most - 1}}}?[.!?\n]|.{{1,{most}}}"


def chunked(docs: DataFrame, doc_id: str, text: str, least: int, most: int) -> DataFrame:
    """``doc_id``, ``norm`` (lower-cased text) and ``chunks`` of each row."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), ascii_lower(F.coalesce(F.col(text), F.lit(""))).alias("norm"),
    ).withColumn("chunks", F.regexp_extract_all("norm", F.lit(chunk_pattern(least, most)), F.lit(0)))


def identifier(chunk):
    return F.xxhash64(chunk)


def shared_identifiers(chunks: DataFrame) -> DataFrame:
    """Identifiers that two different chunk texts share (hardly ever any): ``ident, chunk, rank``."""
    distinct = (
        chunks.select(F.explode("chunks").alias("chunk"))
        .select(identifier(F.col("chunk")).alias("ident"), "chunk").distinct()
    )
    clash = stored(distinct.groupBy("ident").count().filter("count > 1").select("ident"), "clashes")
    n = clash.count()
    rank = F.row_number().over(Window.partitionBy("ident").orderBy("chunk"))
    if not n:
        return clash.select("ident", F.lit("").alias("chunk"), F.lit(0).alias("rank"))
    # Eight bytes each: sent to every task while they are few, else joined.
    few = F.broadcast(clash) if n <= FEW_CLASHES else clash
    return distinct.join(few, "ident", "left_semi").withColumn("rank", rank)


def recipes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
            least: int = LEAST, most: int = MOST) -> DataFrame:
    """``row, doc_id, text_sha256, recipe`` per row, stored; ``row`` tells repeated rows apart.

    ``recipe`` is the ordered list of verified identifiers: a chunk's own number, or the
    number with its rank for numbers that several chunk texts share.
    """
    cut = chunked(docs, doc_id, text, least, most)
    raw = stored(cut.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("norm", 256).alias("text_sha256"),
        F.transform("chunks", identifier).alias("recipe"),
    ), "recipes")
    clashes = stored(shared_identifiers(cut), "identifiers")
    if clashes.isEmpty():
        return raw.withColumn("ranks", F.lit(None).cast("array<struct<pos:int,rank:int>>"))
    # Rows that hold such a chunk carry the ranks beside the numbers. Row numbers come from
    # the stored table, so they are found again by id and text hash.
    told = (
        cut.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), F.posexplode("chunks").alias("pos", "chunk"))
        .withColumn("ident", identifier(F.col("chunk"))).join(clashes, ["ident", "chunk"])
        .groupBy("doc_id", "text_sha256").agg(F.sort_array(F.collect_set(F.struct("pos", "rank"))).alias("ranks"))
    )
    r, t = raw.alias("r"), told.alias("t")
    same = F.col("r.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("r.text_sha256") == F.col("t.text_sha256"))
    return r.join(t, same, "left").select("r.*", "t.ranks")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 least: int = LEAST, most: int = MOST) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    rows = recipes(docs, doc_id, text, least, most).withColumn("short", F.xxhash64("recipe"))
    key = ["short", "recipe", "ranks"]
    groups = rows.groupBy(*key).agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"),
        F.coalesce(F.max_by("row", "doc_id"), F.max("row")).alias("keep_row"))
    r, g = rows.alias("r"), groups.alias("g")
    same = ((F.col("r.short") == F.col("g.short")) & (F.col("r.recipe") == F.col("g.recipe"))
            & F.col("r.ranks").eqNullSafe(F.col("g.ranks")))
    return r.join(g, same).select(
        "r.doc_id", "g.keep_id", "g.group_size", (F.col("r.row") == F.col("g.keep_row")).alias("kept"),
        "r.text_sha256")


def distinct_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that stay, all columns: one row for each different text."""
    kept = exact_groups(docs, doc_id, text, **options).filter("kept")
    norm = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    found = one_row_per_key(docs, kept.select(id_key(F.col("doc_id")).alias("id"), F.col("text_sha256").alias("sha")),
                            {"id": id_key(F.col(doc_id)), "sha": F.sha2(norm, 256)})
    return few_files(found, docs.count(), DOCUMENTS)
