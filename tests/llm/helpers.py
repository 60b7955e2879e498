"""Documents for small tests: the columns of documents, and extra ones whose names operators use inside."""

EXTRA = ["keep_id", "n_shingles", "size", "score", "_row", "id", "key", "h", "node", "group", "label", "end", "kind", "slot"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)


def docs_of(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), *EXTRA) for r in rows], SCHEMA)
