"""The common filter arguments, the organisation filter and the register views."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.functions.clean import ACTIVE_STATES, DONE_STATES


def created_from(day) -> Column:
    return F.col("created") >= F.lit(str(day)).cast("timestamp")


def created_to(day) -> Column:
    """Up to and including the midnight that ends ``day``."""
    return F.col("created") <= F.lit(str(day)).cast("timestamp") + F.expr("INTERVAL 1 DAY")


@dataclass(frozen=True)
class Filters:
    """Arguments are AND-ed; an empty one does not filter."""

    date_from: str | None = None
    date_to: str | None = None
    towers: list[str] = field(default_factory=list)
    sdms: list[str] = field(default_factory=list)
    groups: list[str] = field(default_factory=list)
    priorities: list[int] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    states: list[str] = field(default_factory=list)
    sla: str | None = None
    months: list[str] = field(default_factory=list)

    def predicates(self) -> list[Column]:
        out: list[Column] = []
        if self.date_from:
            out.append(created_from(self.date_from))
        if self.date_to:
            out.append(created_to(self.date_to))
        for column, values in [("tower", self.towers), ("sdm", self.sdms),
                               ("assignment_group", self.groups),
                               ("category", self.categories), ("state", self.states),
                               ("month", self.months)]:
            if values:
                out.append(F.col(column).isin(list(values)))
        if self.priorities:
            out.append(F.col("priority").isin([int(p) for p in self.priorities]))
        if self.sla in ("met", "breached"):
            out.append(F.col("made_sla_bool") == F.lit(self.sla == "met"))
        return out

    def months_touched(self) -> list[Column]:
        """The date bounds as bounds on the month, by which the stored register is partitioned."""
        out: list[Column] = []
        if self.date_from:
            out.append(F.col("month") >= F.date_format(F.lit(str(self.date_from)).cast("date"), "yyyy-MM"))
        if self.date_to:
            out.append(F.col("month") <= F.date_format(F.date_add(F.lit(str(self.date_to)).cast("date"), 1), "yyyy-MM"))
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        for p in self.predicates() + (self.months_touched() if "month" in df.columns else []):
            df = df.where(p)
        return df


def apply_filters(df: DataFrame, filters: Filters | dict | None = None) -> DataFrame:
    if filters is None:
        return df
    return (filters if isinstance(filters, Filters) else Filters(**filters)).apply(df)


def filter_org(df: DataFrame, org_map: DataFrame, towers=None, sdms=None,
               date_from=None, date_to=None) -> DataFrame:
    """Tickets whose group belongs to a given tower OR a given manager.

    The mapping is a dimension the size of the organisation; Spark broadcasts it
    by itself while its measured size is small and shuffles otherwise.
    """
    df = Filters(date_from=date_from, date_to=date_to).apply(df)
    if not towers and not sdms:
        return df
    wanted = F.lit(False)
    if towers:
        wanted = wanted | F.col("tower").isin(list(towers))
    if sdms:
        wanted = wanted | F.col("sdm").isin(list(sdms))
    return df.join(org_map.where(wanted).select("assignment_group"),
                   "assignment_group", "left_semi")


def filter_search(df: DataFrame, text: str, literal: bool = False,
                  columns=("number", "short_description", "impact_user")) -> DataFrame:
    """Case-insensitive search; ``text`` is a regular expression unless ``literal``."""
    if not text:
        return df
    hit = F.lit(False)
    for c in columns:
        if literal:
            one = F.contains(F.lower(F.col(c)), F.lit(text.lower()))
        else:
            one = F.col(c).rlike(f"(?i){text}")
        hit = hit | F.coalesce(one, F.lit(False))
    return df.where(hit)


# The register's tabs.
PRESETS: dict[str, Filters] = {
    "all": Filters(),
    "active": Filters(states=ACTIVE_STATES),
    "critical": Filters(priorities=[1, 2]),
    "breached": Filters(sla="breached"),
    "resolved": Filters(states=DONE_STATES),
}
# End of fixed values.


def preset_condition(name: str) -> Column:
    cond = F.lit(True)
    for p in PRESETS[name].predicates():
        cond = cond & p
    return cond


def register_presets(df: DataFrame) -> DataFrame:
    """Rows and newest ticket time per tab, all tabs in one pass."""
    aggs = []
    for name in PRESETS:
        cond = preset_condition(name)
        aggs += [F.count_if(cond).alias(f"n_{name}"),
                 F.max(F.when(cond, F.col("created"))).alias(f"t_{name}")]
    rows = [F.struct(F.lit(n).alias("tab"), F.col(f"n_{n}").alias("rows"),
                     F.col(f"t_{n}").alias("newest")) for n in PRESETS]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def filter_options(df: DataFrame) -> DataFrame:
    """Sorted choices per filter and the date range, in long form.

    One pass: the columns are unpivoted and de-duplicated before the shuffle; of the
    distinct days only the first and the last stay.
    """
    kinds = [("towers", "tower", True), ("sdms", "sdm", True),
             ("groups", "assignment_group", False), ("categories", "category", False),
             ("states", "state", False)]
    pairs = [F.struct(F.lit(k).alias("option"),
                      F.when((F.trim(c) != "") if skip_blank else F.col(c).isNotNull(),
                             F.col(c)).alias("value")) for k, c, skip_blank in kinds]
    pairs.append(F.struct(F.lit("date").alias("option"), F.date_format("created", "yyyy-MM-dd").alias("value")))
    values = df.select(F.inline(F.array(*pairs))).where(F.col("value").isNotNull()).distinct()
    w = Window.partitionBy("option")
    is_date = F.col("option") == "date"
    names = (F.when(~is_date, F.array("option"))
             .otherwise(F.array_compact(F.array(F.when(F.col("value") == F.col("lo"), "date_min"),
                                                F.when(F.col("value") == F.col("hi"), "date_max")))))
    return (values.withColumns({"lo": F.min("value").over(w), "hi": F.max("value").over(w)})
            .select(F.explode(names).alias("option"), "value").orderBy("option", "value"))


def filtered_of_total(df: DataFrame, filters: Filters | dict) -> DataFrame:
    """Rows kept by a filter, of all rows, in one pass."""
    f = filters if isinstance(filters, Filters) else Filters(**filters)
    cond = F.lit(True)
    for p in f.predicates():
        cond = cond & p
    return df.agg(F.count_if(cond).alias("kept"), F.count("*").alias("total"))
