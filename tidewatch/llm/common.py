"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words are runs of bytes that are not ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII text takes the faster built-in."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def literal_rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A bounded list of tuples made on the driver, as a DataFrame that needs no Python worker."""
    text = json.dumps([list(r) for r in rows])
    names = [part.split()[0] for part in schema.split(",")]
    packed = F.from_json(F.lit(text), "array<array<bigint>>")
    row = spark.range(1).select(F.explode(packed).alias("r"))
    types = [part.split()[1] for part in schema.split(",")]
    return row.select(*[F.get("r", F.lit(i)).cast(t).alias(n) for i, (n, t) in enumerate(zip(names, types))])


def held_back(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; a NULL id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder



def discard(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    files = df.inputFiles()
    if files:
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
