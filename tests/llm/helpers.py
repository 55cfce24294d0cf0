"""Small tables for the llm tests."""

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def docs(spark, rows):
    """Rows ``(doc_id, text[, lang, source])`` as a documents table."""
    full = [(*r, None, None)[:2] + tuple((*r[2:], None, None)[:2]) + (len(r[1]) if r[1] is not None else None,) for r in rows]
    return spark.createDataFrame(full, DOCS)


def folder(tmp_path, **tables):
    """Write tables as ``<name>.parquet`` and return the folder."""
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def gibberish(rng, n):
    syllables = ["th", "er", "on", "an", "re", "in", "sti", "ble", "wh", "ou", "ed", "ing"]
    return " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(n))
