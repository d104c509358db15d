"""CSV and JSON exports into cleaned tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe.functions import clean as cl
from tickframe.functions.breach_columns import derive_breach
from tickframe.functions.rules import CATEGORY_KEYWORDS, classify_category, classify_subcategory, incident_text
from tickframe.schema import (
    BREACH_COUNT_COLUMNS, BREACH_DATE_COLUMNS, BREACH_TEXT_COLUMNS, CANONICAL_COLUMNS,
    CANONICAL_DEFAULTS, DATE_COLUMNS, HEADER_ALIASES, LOADER_DEFAULTS, ORG_MAP_SCHEMA,
)


# ---- headers -----------------------------------------------------------------

def header_names(columns: list[str]) -> list[str]:
    """Normal header names with the aliases applied; metadata only."""
    names = [cl.normal_header(c) for c in columns]
    for alias, target in HEADER_ALIASES:
        if alias in names and target not in names:
            names[names.index(alias)] = target
    return names


def normalize_columns(df: DataFrame) -> DataFrame:
    df = df.toDF(*header_names(df.columns))
    if "first_assignment_group" not in df.columns and "assignment_group" in df.columns:
        df = df.withColumn("first_assignment_group", F.col("assignment_group"))
    return df


def normalize_import_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[cl.import_header(c) for c in df.columns])


def fill_defaults(df: DataFrame) -> DataFrame:
    missing = {c: F.lit(d).cast("string") for c, d in LOADER_DEFAULTS.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


@dataclass(frozen=True)
class ColumnAudit:
    kept: list[str]
    added: list[str]
    dropped: list[str]


def column_audit(columns: list[str]) -> ColumnAudit:
    """What canonical selection does to a file with these (normalised) columns."""
    return ColumnAudit(
        kept=[c for c in CANONICAL_COLUMNS if c in columns],
        added=[c for c in CANONICAL_COLUMNS if c not in columns],
        dropped=sorted(c for c in columns if c not in CANONICAL_COLUMNS and not c.startswith("_")))


def canonical_select(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """The canonical columns in order, missing ones with their default, the rest dropped."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(CANONICAL_DEFAULTS[c]).alias(c)
                       for c in CANONICAL_COLUMNS],
                     *[c for c in extra if c in df.columns])


# ---- reading -----------------------------------------------------------------

def _csv(spark: SparkSession, path: str | list[str], encoding: str, multi_line: bool) -> DataFrame:
    df = (spark.read.option("header", True).option("inferSchema", False)
          .option("multiLine", multi_line).option("escape", '"').option("encoding", encoding).csv(path))
    # Position inside the input: file, block, row within the block.
    return df.select("*", F.struct("_metadata.file_path", "_metadata.file_block_start",
                                   F.monotonically_increasing_id().alias("row")).alias("_pos"))


# What bytes 0x80 to 0x9F mean in Windows-1252; the five unused ones stay.
_C1 = "".join(map(chr, range(0x80, 0xA0)))
_WINDOWS = "".join(bytes([b]).decode("cp1252", "replace").replace("\ufffd", chr(b)) for b in range(0x80, 0xA0))
# End of fixed values.


def _plain_path(path) -> Column:
    """A file's path as readers take it: Spark reports it percent-encoded."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")


def _kinds(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file, header, encoding`` of every file below the paths, in one pass over their lines.

    A file is UTF-8 if all of its lines are; otherwise Windows-1252 if it holds bytes that
    Latin-1 has no characters for, else Latin-1.
    """
    line = F.col("value")
    single = F.decode(line.cast("binary"), "ISO-8859-1")
    place = F.struct("_metadata.file_block_start", F.monotonically_increasing_id())
    lines = spark.read.text(paths).select(
        _plain_path(F.col("_metadata.file_path")).alias("file"), place.alias("place"), "value",
        F.is_valid_utf8(line).alias("utf8"), single.rlike("[\\x80-\\x9f]").alias("windows"))
    return lines.groupBy("file").agg(
        F.min_by("value", "place").alias("header"),
        F.when(F.bool_and("utf8"), "UTF-8").when(F.bool_or(~F.col("utf8") & F.col("windows")), "windows-1252")
        .otherwise("ISO-8859-1").alias("encoding"))


def _decoded(spark: SparkSession, paths: list[str], encoding: str, multi_line: bool) -> DataFrame:
    """Files of one header and encoding; Windows-1252 is read as Latin-1, in which every byte is a character, and corrected."""
    if encoding.lower() not in ("windows-1252", "cp1252"):
        return _csv(spark, paths, encoding, multi_line)
    df = _csv(spark, paths, "ISO-8859-1", multi_line)
    return df.select(*(F.translate(f"`{c}`", _C1, _WINDOWS).alias(c) for c in df.columns if c != "_pos"), "_pos")


def csv_parts(spark: SparkSession, paths: list[str], multi_line: bool = True,
              encoding: str | None = None, same_header: bool = False) -> list[DataFrame]:
    """One all-text DataFrame for each header line and encoding that the files have.

    Spark reads the files of one call by the header of one of them, so files with another
    order of columns must not share a call. A caller who knows the ``encoding`` and that all files have
    the ``same_header`` spares the pass that finds them. Without ``multi_line`` (no field holds a line end) a
    file is read in parts by many tasks.
    """
    if encoding and same_header:
        return [_decoded(spark, paths, encoding, multi_line)]
    groups: dict[tuple[str, str], list[str]] = {}
    for r in _kinds(spark, paths).orderBy("file").collect():
        groups.setdefault((r["header"], encoding or r["encoding"]), []).append(r["file"])
    parts = [_decoded(spark, some, kind, multi_line) for (_, kind), some in groups.items()]
    # Files without a line have no header; they are empty tables.
    return parts or [_csv(spark, paths, encoding or "UTF-8", multi_line)]


def _by_name(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_csv(spark: SparkSession, path: str, multi_line: bool = True, encoding: str | None = None) -> DataFrame:
    """All-text CSV with a ``_pos`` column; a folder's files may differ in their columns.

    Headers and, without ``encoding``, encodings are found in one pass over the lines. Columns
    are matched by name and are null where a file lacks them. Notes hold line breaks, so
    ``multiLine`` is on and one file is one task: export to many files and keep the result
    as Parquet.
    """
    return _by_name(csv_parts(spark, [path], multi_line, encoding))


def read_many(spark: SparkSession, paths: list[str], multi_line: bool = True) -> DataFrame:
    """Uploads, each with its own header, as one canonical table.

    ``_file`` names the upload, ``_seq`` orders rows by (upload, position in it).
    """
    if not paths:
        raise ValueError("no files")
    uploads = spark.createDataFrame(
        [(f, rank, path.rstrip("/").rsplit("/", 1)[-1]) for rank, path in enumerate(paths)
         for f in spark.read.text(path).inputFiles()], "_path string, _rank int, _file string").withColumn(
        "_path", _plain_path(F.col("_path")))
    parts = []
    for part in csv_parts(spark, paths, multi_line):
        df = canonical_select(normalize_columns(part), extra=("tower", "sdm", "_pos"))
        df = df.join(uploads, _plain_path(F.col("_pos.file_path")) == F.col("_path"), "left")
        parts.append(df.withColumn("_seq", F.struct(F.col("_rank").alias("file"), F.col("_pos")))
                     .drop("_pos", "_path", "_rank"))
    return _by_name(parts)


def file_column_audit(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Columns kept, added and dropped per upload; reads headers only."""
    rows = []
    for path in paths:
        a = column_audit(header_names(
            spark.read.option("header", True).option("inferSchema", False).csv(path).columns))
        rows.append((path.rstrip("/").rsplit("/", 1)[-1], a.kept, a.added, a.dropped))
    return spark.createDataFrame(rows, "file string, columns_kept array<string>, "
                                       "columns_added array<string>, columns_dropped array<string>")


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return normalize_import_columns(spark.read.schema(schema).json(path))


def read_org_map(spark: SparkSession, path: str) -> DataFrame:
    """Group, tower, manager; an absent file is an empty table."""
    try:
        raw = spark.read.option("header", True).schema(ORG_MAP_SCHEMA).csv(path)
    except AnalysisException:
        raw = spark.createDataFrame([], ORG_MAP_SCHEMA)
    return raw.dropDuplicates(["assignment_group"])


# ---- cleaning ----------------------------------------------------------------

def clean_incidents(raw: DataFrame, org_map: DataFrame | None = None,
                    rules: dict[str, list[str]] = CATEGORY_KEYWORDS) -> DataFrame:
    """Text columns with normal headers -> typed incidents with derived columns.

    Category and subcategory are derived where absent or blank. With ``org_map``
    blank towers and managers are filled from the group's owner.
    """
    have = set(raw.columns)
    df = fill_defaults(raw)
    df = df.withColumns({c: F.lit(CANONICAL_DEFAULTS[c]) for c in CANONICAL_COLUMNS
                         if c not in df.columns})
    text = incident_text("short_description", "service_offering")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    typed = set(DATE_COLUMNS) | {"priority", "urgency", "made_sla", "state", "category", "subcategory",
                                 "reopen_count", "reassignment_count", "business_duration"}
    texts = [c for c in CANONICAL_COLUMNS if c not in typed] + ["internal_id", "tower", "sdm"]
    category = classify_category(text, rules)
    df = df.withColumns({
        **{c: F.coalesce(F.col(c), F.lit("")) for c in texts},
        **{c: cl.parse_date(c) for c in DATE_COLUMNS},
        "priority": cl.parse_priority("priority"),
        "urgency": cl.parse_urgency("urgency"),
        "made_sla_bool": cl.parse_sla("made_sla"),
        "state": cl.normalize_state("state"),
        "category": F.when(blank("category"), category).otherwise(F.col("category"))
        if "category" in have else category,
        "reopen_count": cl.to_number("reopen_count").cast("int"),
        "reassignment_count": cl.to_number("reassignment_count").cast("int"),
        "business_duration": cl.to_number("business_duration"),
    })
    df = df.withColumns({
        "subcategory": F.when(blank("subcategory"), classify_subcategory("category", text))
        .otherwise(F.col("subcategory")),
        "priority_label": cl.priority_short_label("priority"),
        "urgency_label": cl.urgency_short_label("urgency"),
        "made_sla": F.when(F.col("made_sla_bool"), "TRUE").otherwise("FALSE"),
    })
    df = cl.derive_time_parts(cl.derive_mttr(df))
    return df if org_map is None else fill_owner(df, org_map)


def fill_owner(df: DataFrame, org_map: DataFrame) -> DataFrame:
    """Blank tower and manager from the organisation dimension."""
    owner = org_map.select("assignment_group", F.col("tower").alias("_t"), F.col("sdm").alias("_s"))
    filled = {c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.col(o), F.lit(""))
              for c, o in (("tower", "_t"), ("sdm", "_s"))}
    return df.join(owner, "assignment_group", "left").withColumns(filled).drop("_t", "_s")


def clean_breach(raw: DataFrame, as_of) -> DataFrame:
    """Text columns of an SLA snapshot -> typed snapshot with derived columns."""
    df = raw.toDF(*[cl.normal_header(c) if not c.startswith("_") else c for c in raw.columns])
    need = BREACH_TEXT_COLUMNS + BREACH_DATE_COLUMNS + BREACH_COUNT_COLUMNS
    df = df.withColumns({c: F.lit(None).cast("string") for c in need if c not in df.columns})
    return derive_breach(df.withColumns({
        **{c: cl.parse_date(c) for c in BREACH_DATE_COLUMNS},
        **{c: cl.to_number(c).cast("int") for c in BREACH_COUNT_COLUMNS},
        "business_elapsed_percentage": cl.to_number("business_elapsed_percentage"),
    }), as_of)


def read_incidents_csv(spark: SparkSession, path: str, org_map: DataFrame | None = None, **options) -> DataFrame:
    """A file or folder; columns are matched by their normal names, file by file. ``options``: see ``csv_parts``."""
    return clean_incidents(_by_name([normalize_columns(p) for p in csv_parts(spark, [path], **options)]), org_map)


def read_breach_csv(spark: SparkSession, path: str, as_of, **options) -> DataFrame:
    """An SLA snapshot from a file or folder. ``options``: see ``csv_parts``."""
    return clean_breach(_by_name([p.toDF(*[c if c.startswith("_") else cl.normal_header(c) for c in p.columns])
                                  for p in csv_parts(spark, [path], **options)]), as_of)
