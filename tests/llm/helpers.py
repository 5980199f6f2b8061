from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", None if r[1] is None else len(r[1])) for r in rows], DOCS)


def clashing(df):
    """The same rows with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(1).alias(x) for x in ("h", "fp", "norm", "digest", "k", "key", "shard", "part", "size", "order", "end", "n", "a", "b", "words", "hash", "pos", "kept", "n_lines", "n_removed", "_times", "_copy", "_doc_id", "row", "weight", "carried", "gone", "stay", "lines", "source_size", "taken", "block", "vec")])


def rows(df, *cols):
    return sorted([tuple(r[c] for c in cols) for r in df.collect()], key=repr)
