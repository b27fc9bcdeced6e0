"""Tables with everything awkward in them."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, node string, score double"


def awkward(spark, texts=()):
    """Documents with nulls in any column, empty and long texts, repeated rows and columns with clashing names."""
    rows = [(i, t, "en" if i % 2 else "fr", "s", 1, 7, "n", 0.5) for i, t in enumerate(texts)]
    rows += [
        (None, "no identifier here at all", None, None, None, None, None, None),
        (100, None, None, "s", None, None, None, None),
        (101, "", "en", None, 0, None, None, None),
        (102, " \n\t ", "en", "s", 0, 1, "x", 1.0),
        (103, "same row twice, word for word", "en", "s", 1, 1, "x", 1.0),
        (103, "same row twice, word for word", "en", "s", 1, 1, "x", 1.0),
        (104, "long " * 60_000, "en", "s", 1, 1, "x", 1.0),
        (105, "ünïcödé 😀 \u212a \u00a0 </s> <|endoftext|>", "de", "s", 1, 1, "x", 1.0),
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)
