"""Write ``explain("formatted")`` of every catalogue query to one file each.

usage: python scripts/explain_all.py [sf_dir] [out_dir]
Queries whose construction materialises inputs (lexicon lookup, facts for
bins) run those small jobs; the reports themselves are not executed.
"""

from __future__ import annotations

import contextlib
import io
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    out_dir = sys.argv[2] if len(sys.argv) > 2 else "plans_out"
    os.makedirs(out_dir, exist_ok=True)
    from viewpoint.plans.catalogue import queries
    from viewpoint.session import local_session

    spark = local_session()
    for name, fn in queries().items():
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            fn(spark, sf_dir).explain("formatted")
        text = buf.getvalue()
        with open(os.path.join(out_dir, f"{name}.txt"), "w") as f:
            f.write(text)
        exchanges = text.count(") Exchange")
        print(f"{name}: {exchanges} exchanges, broadcast joins {text.count(') BroadcastHashJoin')}, sort-merge joins {text.count(') SortMergeJoin')}")


if __name__ == "__main__":
    main()
