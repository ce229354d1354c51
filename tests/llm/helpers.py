"""Small frames for the corpus operators: rows with nulls, empty and long texts, ties and columns with clashing names."""

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def text_of(seed: int, n: int) -> str:
    x, out = seed * 2654435761 % 2**32 or 1, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 50))
    return " ".join(out)


def odd_rows() -> list[tuple]:
    long = text_of(99, 20000)
    return [
        (1, text_of(1, 80), "en", "src1", 1), (2, None, None, None, None), (3, "", "en", "src1", 0), (None, text_of(1, 80), "de", None, 5), (4, "   \n\t ", "en", "src2", 3), (5, "one two", "fr", "src2", 7),
        (5, "one two", "fr", "src2", 7), (6, long, "en", "src1", len(long)), (7, long + " extra", "en", "src1", None), (8, "one two", None, "src2", 7), (None, None, None, None, None),
    ]


CLASH = ["node", "h", "k", "copies", "host_key", "bad_lines", "quality_score", "secret_spans", "lv0", "whole", "cut", "part", "score", "gone", "leaked"]


def odd_docs(spark, rows=None):
    df = spark.createDataFrame(odd_rows() if rows is None else rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASH:
        df = df.selectExpr("*", f"'x' as `{c}`")
    return df


def empty_docs(spark):
    return odd_docs(spark, [])
