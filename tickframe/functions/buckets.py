"""Right-closed bins: (edge, next edge]; the first edge itself is outside, the last bin is open.

The dashboards this follows end their last bins at 200 %, 99,999 hours and 999 days; pass such
edges to ``bucketize`` to leave out what lies beyond.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import as_col

OPEN = float("inf")
# Edges and labels of the SLA views.
ELAPSED_EDGES = [0, 25, 50, 75, 90, 100, OPEN]
ELAPSED_LABELS = ["0–25% Healthy", "25–50% Caution", "50–75% Elevated",
                  "75–90% At Risk", "90–100% Critical", ">100% Breached"]
AGE_EDGES = [0, 4, 8, 24, 72, 168, OPEN]
AGE_LABELS = ["<4h", "4–8h", "8–24h", "1–3 days", "3–7 days", ">7 days"]
HOLD_EDGES = [0, 1, 3, 7, 14, 30, OPEN]
HOLD_LABELS = ["<1 day", "1–3 days", "3–7 days", "7–14 days", "14–30 days", ">30 days"]
HOLD_RISK_LABELS = ["7–14 days", "14–30 days", ">30 days"]
# End of fixed values.


def bucketize(c, edges: list, labels: list[str]) -> Column:
    """Label of the bin holding the value, null outside all bins."""
    c = as_col(c).cast("double")
    out = None
    for lo, hi, label in zip(edges, edges[1:], labels):
        hit = (c > F.lit(float(lo))) & (c <= F.lit(float(hi)))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def bucket_rank(c, labels: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in labels]), as_col(c)).cast("int")
