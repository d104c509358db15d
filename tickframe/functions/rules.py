"""Keyword rules: category, subcategory and keyword scores as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import as_col

# Generic keyword lists, in priority order (the first listed wins ties). Names of a
# customer's own systems belong in a rules table, see ``rules_from_table``.
CATEGORY_KEYWORDS: dict[str, list[str]] = {
    "Application Access": ["access", "permission", "login", "sso", "certif", "account lock", "badge",
                           "role", "authoris", "unauthor"],
    "Application Error": ["error", "not working", "crash", "issue", "problem", "bug",
                          "giving an error", "went wrong", "failed", "failure",
                          "cannot", "can't", "unable", "not running", "not able"],
    "Data & Reporting": ["report", "data fetch", "letter generation",
                         "validation", "document", "upload", "download", "export", "cycle count"],
    "User Account": ["new user", "onboard", "leaver", "deactivat", "profile",
                     "user setup", "joiner"],
    "Network": ["vpn", "wifi", "network", "internet", "connect", "dns",
                "bandwidth", "proxy", "connectivity"],
    "Hardware": ["laptop", "desktop", "printer", "monitor", "mobile",
                 "device", "hardware", "screen", "docking"],
    "Software & Tools": ["install", "software", "upgrade", "patch", "license",
                         "version", "update", "app update", "workday", "sap", "sharepoint"],
    "Infrastructure": ["server", "storage", "backup", "database", "infrastructure",
                       "cpu", "memory", "disk", "vm", "virtual"],
    "Change Request": ["change request", "enhancement", "change/enhancement",
                       "product backlog", "feature request"],
    "Service Request": ["request", "provision", "setup", "new", "require",
                        "materials management", "generic technical"],
}
# The shorter list used when a file is normalised before loading.
CATEGORY_KEYWORDS_IMPORT: dict[str, list[str]] = {
    "Application Access": ["access", "permission", "login", "sso", "certif", "badge",
                           "account lock", "role"],
    "Application Error": ["error", "not working", "crash", "issue", "problem", "bug",
                          "failed", "cannot", "unable"],
    "Data & Reporting": ["report", "data", "letter", "validation", "document", "upload",
                         "export", "cycle count"],
    "User Account": ["new user", "onboard", "leaver", "deactivat", "profile", "user setup"],
    "Network": ["vpn", "wifi", "network", "internet", "connect", "dns", "bandwidth"],
    "Hardware": ["laptop", "desktop", "printer", "monitor", "mobile", "device", "screen"],
    "Software & Tools": ["install", "software", "upgrade", "patch", "license", "version",
                         "update", "sap", "sharepoint"],
    "Infrastructure": ["server", "storage", "backup", "database", "cpu", "memory", "vm"],
    "Service Request": ["request", "provision", "setup", "require"],
}
SUBCATEGORY_KEYWORDS: dict[str, list[tuple[str, list[str]]]] = {
    "Application Access": [("Login/SSO", ["login", "sso", "sign in"]),
                           ("Permission Error", ["permission", "access denied", "unauthor"]),
                           ("Certification Required", ["certif"]),
                           ("Account Lockout", ["lock", "locked"]),
                           ("Badge Access", ["badge"])],
    "Application Error": [("Functional Error", ["error", "not working", "wrong"]),
                          ("Performance Issue", ["slow", "timeout", "hang"]),
                          ("Crash/Unresponsive", ["crash", "unresponsive", "freeze"])],
    "Data & Reporting": [("Data Fetch Issue", ["fetch", "data", "report"]),
                         ("Document Upload", ["upload", "document"]),
                         ("Validation Error", ["validation", "reject"])],
    "Software & Tools": [("Application Update", ["update", "upgrade", "version"]),
                         ("Installation", ["install"]),
                         ("License Issue", ["license"])],
}
AUDIT_P1_KEYWORDS = ["complete failure", "total outage", "entire", "all users", "most users",
                     "division", "production down", "no workaround", "month-end", "year-end",
                     "500,000", "$500k", "critical outage", "cannot access", "system down"]
AUDIT_P2_KEYWORDS = ["senior management", "significant", "multiple users", "many users",
                     "cannot generate", "report failure", "time-sensitive", "critical report",
                     "50,000", "$50k", "major issue", "impacting operations"]
AUDIT_P4_KEYWORDS = ["how do i", "how to", "inquiry", "question", "request", "access request",
                     "workaround", "information", "guidance", "one user", "single user"]
# End of fixed values.


def rules_from_table(table: DataFrame, base: dict[str, list[str]] = CATEGORY_KEYWORDS) -> dict[str, list[str]]:
    """``base`` with a caller's keywords added; ``table`` has (category, keyword), one row each.

    New categories follow those of ``base`` in the order of their names. The table is a
    hand-kept list, so it is read to the driver whole.
    """
    rules = {name: list(words) for name, words in base.items()}
    for r in table.select("category", F.lower(F.trim("keyword")).alias("keyword")).distinct().orderBy("category", "keyword").collect():
        if r["category"] and r["keyword"] and r["keyword"] not in rules.setdefault(r["category"], []):
            rules[r["category"]].append(r["keyword"])
    return rules


def lowered(text, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of the lower-cased text, which is computed once per row.

    Keyword lists are array literals walked by lambdas: written out, a hundred
    ``contains`` calls outgrow the size limit of generated code and run slower.
    """
    low = F.lower(F.coalesce(as_col(text), F.lit("")))
    return F.element_at(F.transform(F.array(low), fn), 1)


def _words(keywords: list[str]) -> Column:
    return F.array(*[F.lit(k) for k in keywords])


def any_hit(text: Column, keywords: list[str]) -> Column:
    return F.exists(_words(keywords), lambda k: F.contains(text, k))


def hit_count(text: Column, keywords: list[str]) -> Column:
    """How many of the keywords occur in the (already lower-cased) text."""
    return F.size(F.filter(_words(keywords), lambda k: F.contains(text, k)))


def incident_text(*cols) -> Column:
    """Non-empty parts joined by one blank."""
    parts = [F.when(F.coalesce(as_col(c), F.lit("")) != "", as_col(c)) for c in cols]
    return F.trim(F.concat_ws(" ", *parts))


def classify_category(text, rules: dict[str, list[str]] = CATEGORY_KEYWORDS) -> Column:
    """Category with most keyword hits; the first listed wins ties; no hit -> General."""

    def best(low: Column) -> Column:
        return F.array_max(F.array(*[
            F.struct(hit_count(low, words).alias("hits"), F.lit(-i).alias("order"),
                     F.lit(name).alias("name"))
            for i, (name, words) in enumerate(rules.items())]))

    return lowered(text, lambda low: F.element_at(F.transform(F.array(best(low)), lambda b: F.when(
        b["hits"] > 0, b["name"]).otherwise("General")), 1))


def classify_subcategory(category, text, rules=SUBCATEGORY_KEYWORDS) -> Column:
    """First rule of the row's category with any hit, else General."""
    table = F.array(*[
        F.struct(F.lit(name).alias("category"), F.lit(label).alias("label"), _words(words).alias("words"))
        for name, labelled in rules.items() for label, words in labelled])
    hits = lowered(text, lambda low: F.filter(
        F.filter(table, lambda r: r["category"] == as_col(category)),
        lambda r: F.exists(r["words"], lambda k: F.contains(low, k))))
    return F.coalesce(F.try_element_at(hits, F.lit(1))["label"], F.lit("General"))
