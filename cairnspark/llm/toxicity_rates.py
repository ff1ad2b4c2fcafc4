"""Prints the log loss of each pair of FTRL rates: ``python -m cairnspark.llm.toxicity_rates FOLDER``, least loss first.

Only labels of training rows (crc32 of the id, modulo 3, is not 1) are read.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cairnspark.llm.common import documents, remainder
from cairnspark.llm.toxicity import choose_rates


def main(folder: str) -> None:
    spark = SparkSession.builder.getOrCreate()
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic").where(remainder(F.col("doc_id"), 3) != 1)
    found = choose_rates(documents(spark, folder, "doc_id", "text"), labels)
    for r in sorted(found.collect(), key=lambda r: r.log_loss):  # a row for each pair of rates
        print(f"alpha {r.alpha:g}  l1 {r.l1:g}  log loss {r.log_loss:.5f}  weights {r.weights}")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1])
