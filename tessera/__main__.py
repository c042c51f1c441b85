"""Command line: list, run or explain the registered queries.

    python -m tessera list
    python -m tessera run a1_site_daily_stats --sf-dir /data/sf1 --out /data/out/a1 [--format parquet]
    python -m tessera explain a1_site_daily_stats --sf-dir /data/sf1

``run`` writes with Spark's partitioned writer (no collection to the driver).
The session gets the library's base settings (UTC zone, ANSI, AQE, no UI);
everything else comes from spark-submit / spark-defaults.
"""

from __future__ import annotations

import argparse
import sys

from tessera.plans.registry import load_all


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="python -m tessera")
    sub = p.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="list registered queries")
    for name in ("run", "explain"):
        sp = sub.add_parser(name)
        sp.add_argument("query")
        sp.add_argument("--sf-dir", required=True, help="folder with the input tables (<name>.parquet)")
        sp.add_argument("--master", default=None, help="e.g. local[8]; omit under spark-submit")
        if name == "run":
            sp.add_argument("--out", required=True)
            sp.add_argument("--format", default="parquet", choices=["parquet", "json", "csv", "orc"])
            sp.add_argument("--mode", default="errorifexists", choices=["errorifexists", "overwrite", "append"])
    args = p.parse_args(argv)
    reg = load_all()
    if args.cmd == "list":
        for name, q in sorted(reg.items()):
            print(f"{name}\t{'oracle' if q.oracle else 'rows-only'}\t{q.doc.splitlines()[0] if q.doc else ''}")
        return 0
    if args.query not in reg:
        print(f"unknown query {args.query}; see `python -m tessera list`", file=sys.stderr)
        return 2
    from tessera.session import get_spark

    spark = get_spark(args.master)
    df = reg[args.query].fn(spark, args.sf_dir)
    if args.cmd == "explain":
        df.explain("formatted")
    else:
        df.write.format(args.format).mode(args.mode).save(args.out)
        print(f"wrote {args.query} to {args.out}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
