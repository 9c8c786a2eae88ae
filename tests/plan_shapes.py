"""Print the physical-plan shape of catalogue queries (scans, exchanges,
broadcasts, sort-merge joins, nested-loop/cartesian joins, Python stages).

Usage: python tests/plan_shapes.py [--markdown] [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shape(df) -> dict:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {
        "scans": len(re.findall(r"FileScan parquet", plan)),
        "exchanges": len(re.findall(r"Exchange (hashpartitioning|SinglePartition|rangepartitioning)", plan)),
        "broadcast": len(re.findall(r"BroadcastExchange", plan)),
        "smj": len(re.findall(r"SortMergeJoin", plan)),
        "nested_or_cartesian": len(re.findall(r"CartesianProduct|BroadcastNestedLoopJoin", plan)),
        "python": len(re.findall(r"MapInPandas|FlatMapGroupsInPandas|FlatMapCoGroupsInPandas|"
                                 r"BatchEvalPython|ArrowEvalPython", plan)),
    }


def formatted(df) -> str:
    """The operator tree of ``explain('formatted')`` plus, per scan, the
    columns read and the filters pushed into parquet."""
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    tree = text.split("\n\n")[0]
    scans = re.findall(r"\(\d+\) Scan parquet[^\n]*\n(?:[^\n]+\n)*?ReadSchema: [^\n]+", text)
    keep = []
    for sc in scans:
        lines = [ln for ln in sc.splitlines()
                 if ln.startswith(("(", "PushedFilters", "ReadSchema", "DataFilters"))]
        keep.append("\n".join(lines))
    return tree + "\n\n" + "\n\n".join(keep)


def main(argv) -> None:
    from trellis.session import get_session
    import __spark_entry__ as entry
    markdown = "--markdown" in argv
    argv = [a for a in argv if a != "--markdown"]
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    names = argv[2:] or list(entry.oracle_sql())
    spark = get_session("local[8]", 8)
    for n in names:
        df = entry.queries()[n](spark, sf_dir)
        s = shape(df)
        if markdown:
            print(f"### `{n}`\n\n" + ", ".join(f"{k}={v}" for k, v in s.items()) +
                  f"\n\n```\n{formatted(df)}\n```\n", flush=True)
        else:
            print(f"{n:24s} " + " ".join(f"{k}={v}" for k, v in s.items()), flush=True)


if __name__ == "__main__":
    main(sys.argv)
