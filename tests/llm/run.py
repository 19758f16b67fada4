"""python tests/llm/run.py FOLDER NAME...: run queries of the subpackage and compare those that have SQL twins."""

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parents[2]), str(Path(__file__).resolve().parents[1])]

from check import compare, duck  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from pagewright.session import local_session  # noqa: E402

if __name__ == "__main__":
    spark, con = local_session(8), duck(sys.argv[1])
    for name in sys.argv[2:]:
        began = time.time()
        print(name, compare(spark, con, sys.argv[1], name, entry.queries()[name], entry.oracle_sql().get(name)), round(time.time() - began, 1), flush=True)
