"""Makes the rows of license_digests.FILES anew from the licence texts of a folder: `python -m tidemark.llm.make_license_digests [FOLDER]`."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.license_digests import FILES, FOLDER
from tidemark.llm.licenses import described


def file_digests(spark: SparkSession, folder: str = FOLDER) -> DataFrame:
    """license, words, head, digest and file of the files of the folder that license_digests.FILES names."""
    names = spark.createDataFrame([(r[4], r[0]) for r in FILES], "file string, license string")
    texts = spark.read.text([f"{folder}/{r[4]}" for r in FILES], wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("text"))
    return described(texts.join(F.broadcast(names), "file"), ["file"]).select("license", "words", "head", "digest", "file")


if __name__ == "__main__":
    session = SparkSession.builder.getOrCreate()
    for row in file_digests(session, *sys.argv[1:2]).sort("license", "file").collect():
        print(f"    {tuple(row)!r},")
