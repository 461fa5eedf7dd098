"""Small tables with everything awkward in them."""

LONG = "alpha beta gamma delta " * 3000
TEXTS = [None, "", " \n\t ", "one", "one two three four five six seven eight nine ten eleven twelve.\nshort\n", LONG, "same words here again and again in a line of ten\nsame words here again and again in a line of ten", "x" * 20_000, "tie", "tie"]


def documents(spark, texts=TEXTS, extra=True):
    """Texts numbered from 0; ids repeat and one is null; columns clash with the operators' own names."""
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, len(t or "")) for i, t in enumerate(texts)]
    if texts:
        rows += [rows[-1], (None, "a text without an id but with quite some words in it, so that rules can look", "en", "s", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        for name in ("id", "tie", "key", "h", "score", "n", "part", "kept", "length", "removed", "n_lines"):
            df = df.selectExpr("*", f"'{name}' as {name}")
    return df
