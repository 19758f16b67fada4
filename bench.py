"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import atexit
import json
import os
import re
import shutil
import sys
import tempfile
import time

from pagewright.plans.all_queries import QUERIES
from pagewright.session import local_session

HEADLINE = (
    "normalize_text", "classify_pages", "reading_order", "detect_bands", "page_text", "dedupe_ocr_words",
    "pack_chunks", "build_chunks", "search_topk", "classify_claims", "verify_answers", "group_chunks", "reduce_level",
    "evaluate_runs", "check_transitions", "replay_status",
)


def split(spark, folder: str, files: int = 32) -> str:
    """The tables, with documents as many files, as a large table would be; the given one is a single row group, which one task reads."""
    to = tempfile.mkdtemp(prefix="spark-bench-")
    atexit.register(shutil.rmtree, to, ignore_errors=True)
    for name in os.listdir(folder):
        if name != "documents.parquet":
            os.symlink(f"{folder}/{name}", f"{to}/{name}")
    spark.read.parquet(f"{folder}/documents.parquet").repartition(files).write.parquet(f"{to}/documents.parquet")
    return to


def main() -> None:
    given = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench", os.environ.get("BENCH_MEMORY", "12g"))
    folder = split(spark, given)
    # one small job first, so that starting Spark and the Python workers is not counted as a query
    QUERIES["nonspace_char_count"](spark, folder).limit(1).collect()
    took = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {took[name]}", file=sys.stderr, flush=True)
    sf = re.search(r"sf([0-9.]+)", given)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": float(sf.group(1)) if sf else None}))


if __name__ == "__main__":
    main()
