from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])

#: Columns with names that operators use themselves.
CLASHING = ("digest", "fp", "rep", "n", "keep_id", "component_id", "kept", "spans", "items", "score", "lang")


def docs_of(spark, rows, extra=False):
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        from pyspark.sql import functions as F

        for c in CLASHING:
            df = df.withColumn(c, F.lit("x"))
    return df


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
