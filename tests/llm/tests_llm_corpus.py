"""Small tables with awkward rows."""

from pyspark.sql import functions as F

#: Names that the operators use inside; the awkward tables bear them too.
CLASHES = "doc t w l h s th lines chunks found removed stays k c n g a b of_id of_th spans start ids score word rows idx key first root".split()

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    """Words in a fixed irregular order, in lines."""
    out, x = [], seed * 7919 + 13
    for k in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x // 65536 % len(WORDS)] + str(x // 64 % 50))
        out.append("\n" if k % 9 == 8 else " ")
    return "".join(out).strip()


def awkward_rows():
    """(doc_id, text, lang, source): nulls, empty and long texts, copies, near copies and repeated rows."""
    long = prose(3, 30_000)
    near = prose(1, 200).split(" ")
    near[50] = "changed"
    return [
        (1, prose(1, 200), "en", "a"),
        (2, prose(1, 200), "en", "b"),
        (3, " ".join(near), "en", None),
        (4, None, None, None),
        (5, "", "en", "a"),
        (6, " \t\n ", None, "a"),
        (7, long, "de", "a"),
        (8, long[:100_000] + " end", "de", "a"),
        (9, prose(9, 120), "de", "b"),
        (9, prose(9, 120), "de", "b"),
        (9, prose(10, 120), "de", "b"),
        (None, prose(11, 60), "en", "a"),
        (None, prose(12, 60) + "\n" + prose(1, 80), "en", "a"),
        (None, None, "en", "a"),
        (10, "one two three", "en", "a"),
        (11, "one two three", "en", "a"),
        (12, "é ü 漢字 \U0001f600 " * 40, "fr", "a"),
    ]


def documents(spark, rows=None, clashes=True):
    found = spark.createDataFrame(awkward_rows() if rows is None else rows, "doc_id long, text string, lang string, source string")
    for name in CLASHES if clashes else []:
        found = found.withColumn(name, F.lit("x"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def answers(df, *columns):
    """Rows as sorted tuples."""
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)
