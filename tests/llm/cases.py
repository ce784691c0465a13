"""Awkward frames that every operator must take: nulls, empty and long texts, repeated rows, columns with clashing names, no rows."""

CLASHING = ["id", "key", "row", "text_", "kept", "n_tokens", "ids", "rp_text_key", "rp_leak_id", "host", "rule", "score", "ts", "digest", "size", "band", "value"]

PROSE = "the quick brown fox jumps over the lazy dog while many other animals watch from the shade of an old tree near the river and wait for the evening"


def awkward(spark, rows, names):
    """``rows`` of (id, text) as a frame with columns ``names`` and a clashing one of each name."""
    extra = ", ".join(f"'{c}' as `{c}`" for c in CLASHING if c not in names)
    frame = spark.createDataFrame(rows, f"{names[0]} long, {names[1]} string")
    return frame.selectExpr("*", *extra.split(", "))


def documents(spark, rows):
    """Rows of (doc_id, text) with the columns of documents."""
    full = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
