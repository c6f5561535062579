"""Documents with everything that is awkward: nulls, empty and very long texts, repeated rows, clashing columns."""

LONG = "lorem ipsum dolor " * 40_000
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta", "a"),
    (2, "alpha  beta\tgamma delta epsilon zeta", "a"),
    (3, None, "b"),
    (4, "", None),
    (5, " \n\t", "b"),
    (6, LONG, None),
    (6, LONG, None),
    (7, "alpha beta gamma delta epsilon zeta", "a"),
    (None, "alpha beta gamma delta epsilon zeta", "c"),
    (None, None, "c"),
    (8, "Ünïcödé ▁ \u0000 漢字 \U0001f600 wörds", "c"),
    (9, "one", "c"),
    (10, "one", "b"),
]
SCHEMA = "doc_id long, text string, source string"
#: Names that operators make themselves.
CLASHING = ["size", "target", "taken", "keep_id", "group_size", "kept", "keys", "n_lines", "host", "verdict", "score", "pieces", "_copy", "_row"]


def documents(spark, rows=None, clashing=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in CLASHING}) if clashing else df


def empty(spark):
    return documents(spark, [])
