SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, norm string, id string"


def docs(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    full = [(i, t, lang, src, len(t or ""), "size", "norm", "id") for i, t, lang, src in rows]
    return spark.createDataFrame(full, SCHEMA)


ODD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \n\t ", "en", "a"),
    (4, "one two three four five six seven", "en", "a"),
    (5, "One TWO three four five six seven", "en", None),
    (6, "one two three four five six seven", None, "b"),
    (6, "one two three four five six seven", None, "b"),
    (7, "Übung macht den Meister ÄÖ", "de", "b"),
    (8, "übung macht den meister äö", "de", "b"),
    (9, "word " * 30_000, "en", "a"),
    (10, "12 34 !!", "en", "c"),
    (None, "no id", "en", "c"),
]
