"""Small tables with every awkward row: nulls, blanks, ties, repeats, long texts, clashing columns."""

import random

from pyspark.sql import types as T

#: Names that the operators use themselves; a caller's table may have them too.
CLASHES = ["norm", "chunks", "row", "fp", "kept_text", "n_lines", "_key", "_hash", "found", "text_hash", "tie", "label"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       *(T.StructField(c, T.StringType()) for c in CLASHES)])


def table(spark, rows):
    """Rows of ``(doc_id, text[, lang])``."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, *["x"] * len(CLASHES)) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(rng: random.Random, n: int, kinds: int = 400) -> str:
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def messy_rows(seed: int = 1, n: int = 60):
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(5, 80)) for _ in range(n // 3)]
    rows = [(i, rng.choice(base)) for i in range(n)]
    rows += [(1000 + i, t.upper() if i % 2 else t.replace("w1", "w2", 1)) for i, t in enumerate(base)]
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (None, "no id at all"), (None, None), (2003, base[0]), (2003, base[0]),
             (2003, base[1]), (2004, "É" * 30 + " ÉCOLE ß İ"), (2005, words(rng, 20000)), (2006, "x" * 50000), (2007, "one"),
             (2008, "\U0001f600 \x1c \x85 a b ́e <|endoftext|> it's don't ...!? 3.14 J̌")]
    return rows


def gather(df):
    return [tuple(r) for r in df.collect()]
