"""Times the headline queries and prints one JSON line. BENCH_SF_DIR: folder of tables; BENCH_CPUS: threads."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quire.plans.queries import QUERIES

HEADLINES = [
    "timeline_slice", "furniture_reasons", "repeated_headers", "book_vocabulary", "word_pair_counts", "names_in_sources", "document_sentences",
    "book_chapters", "similar_documents", "contained_passages", "last_click_before_view", "event_runs", "folded_progress", "stage_states",
    "built_timeline", "customer_details", "unreferenced_parts", "chapter_plans", "overlapping_boxes", "speech_weights",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(name: str) -> float:
        began = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.time() - began

    names = sys.argv[1:] or HEADLINES
    timed(names[0])  # starts workers and compiles
    seconds = {name: round(timed(name), 3) for name in names}
    words = spark.read.parquet(f"{folder}/documents.parquet").select(F.sum(F.size(F.split("text", r"\s+")))).first()[0]
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(scale[1]) if scale else None, "cpus": int(cpus), "words": words, "words_per_second_of_sentences": round(words / seconds["document_sentences"]) if "document_sentences" in seconds else None}))
    spark.stop()


if __name__ == "__main__":
    main()
