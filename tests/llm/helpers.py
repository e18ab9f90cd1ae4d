"""Small tables that hold the awkward cases of every operator."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts, extra=True):
    """Rows (doc_id, text) with the other columns filled in, and some whose names clash with inner ones."""
    rows = [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        from pyspark.sql import functions as F

        for name in ("id", "row", "size", "token", "n", "words", "hash"):
            df = df.withColumn(name, F.lit("x"))
    return df


def write(spark, folder, **tables):
    """Write tables as the query functions read them."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
