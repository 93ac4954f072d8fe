"""Command line: savings reports, and compaction or checkpoints of files."""

from __future__ import annotations

import argparse
import os
import sys
import time


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillspark")
    sub = p.add_subparsers(dest="what", required=True)
    g = sub.add_parser("gain", help="token savings summary")
    g.add_argument("--ledger", help="path of the ledger; by default the usual place")
    g.add_argument("-p", "--project", action="store_true", help="only the current directory")
    g.add_argument("-s", "--session", help="only this session")
    g.add_argument("--days", type=int, default=0, help="only the last N days (0: all)")
    g.add_argument("--spark", action="store_true", help="daily savings")
    g.add_argument("--oneline", action="store_true", help="one status line")
    g.add_argument("-j", "--json", action="store_true", dest="as_json", help="JSON output")
    g.add_argument("--reset", action="store_true", help="delete all recorded rows")
    g.add_argument("-y", "--yes", action="store_true", help="confirm the reset")
    for name in ("checkpoint", "compact"):
        c = sub.add_parser(name, help=f"{name} text files")
        c.add_argument("path", help="a file or folder of text files")
        c.add_argument("--out", help="folder for the result; by default it is printed")
        if name == "compact":
            c.add_argument("--rows", required=True, help="Parquet table of labelled clause rows, on which the scorer is fitted")
    return p


def gain(spark, args: argparse.Namespace) -> int:
    from quillspark.operators import ledger
    from quillspark.sources import io

    path = args.ledger or io.ledger_path()
    if args.reset:
        if not args.yes:
            print(f"Refusing to delete {io.read_ledger(spark, path).count()} rows without --yes.", file=sys.stderr)
            return 1
        io.reset_ledger(spark, path, True)
        return 0
    rows = io.read_ledger(spark, path)
    if args.project:
        rows = ledger.in_project(rows, os.getcwd())
    if args.session:
        rows = ledger.in_session(rows, args.session)
    if args.days > 0:
        rows = ledger.since_days(rows, time.time(), args.days)
    if args.oneline:
        print(ledger.one_line(rows, time.strftime("%Y-%m-%d"), args.session).first()[0])
    elif args.as_json:
        import json

        groups = lambda key: {r["name"]: {"count": r["requests"], "in": r["in_chars"], "out": r["out_chars"]} for r in ledger.by_key(rows, key).collect()}
        print(json.dumps({"summary": ledger.summary(rows).first().asDict(), "by_source": groups("source"), "by_project": groups("cwd")}, indent=2))
    else:
        scope = f"Session Scope ({args.session})" if args.session else "Project Scope" if args.project else "Global Scope"
        print(ledger.render(rows, scope, args.spark, not args.session))
    return 0


def texts(spark, args: argparse.Namespace) -> int:
    from quillspark.operators import compaction, scorer
    from quillspark.sources import io

    df = io.read_texts(spark, args.path)
    if args.what == "checkpoint":
        out = compaction.checkpoint(df, "text")
    else:
        out = compaction.compact(df, "text", scorer.default_score(scorer.labelled_clauses(spark.read.parquet(args.rows), "id")))
    if args.out:
        out.select("path", "text_out", "units", "kept", "protected", "ratio").write.mode("overwrite").json(args.out)
    else:
        for r in out.select("text_out").toLocalIterator():
            print(r[0])
    return 0


def main(argv: list[str] | None = None) -> int:
    from quillspark.session import build_session, ship

    args = parser().parse_args(argv)
    spark = build_session()
    ship(spark)
    return gain(spark, args) if args.what == "gain" else texts(spark, args)


if __name__ == "__main__":
    sys.exit(main())
