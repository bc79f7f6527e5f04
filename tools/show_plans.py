"""Print the formatted physical plan of registered queries.

Usage: python tools/show_plans.py [--sf DIR] name [name ...]
Shows scans (ReadSchema / PushedFilters), exchanges, join strategies and
partial aggregates, to review a plan before and after a change.
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from effortlab.plans.queries import QUERIES  # noqa: E402
from effortlab.session import get_spark  # noqa: E402


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="+")
    a = ap.parse_args()
    spark = get_spark("effortlab-plans", master="local[8]", shuffle_partitions=8)
    for name in a.names:
        print(f"===== {name}")
        QUERIES[name](spark, a.sf).explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main()
