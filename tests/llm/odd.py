"""Rows that every operator has to take: nulls, empty and long texts, repeats, and columns with clashing names."""

LONG = "word " * 30_000 + "tail"
ROWS = [
    (1, "One two three four five six seven", "en", "a", 3, 0.5),
    (2, None, "en", "b", None, None),
    (3, "", None, None, 0, 1.0),
    (4, LONG, "en", "a", 1, 2.0),
    (5, "one  two\nthree", "en", "c", 2, 3.0),
    (5, "one  two\nthree", "en", "c", 2, 3.0),
    (None, "one two three", None, "a", 4, 4.0),
    (6, "\t \n", "xx", "a", 4, 4.0),
    (7, "naïve 中文 <|endoftext|> it's ### x", "xx", "b", 4, 4.0),
]
SCHEMA = "doc_id long, text string, lang string, source string, score int, ids double"


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)
