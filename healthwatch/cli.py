"""Command line: the reference's run modes as plain function calls.

    python -m healthwatch.cli baseline --table T --out DIR [--approx]
    python -m healthwatch.cli detect   --table T --baseline DIR [--out DIR]
    python -m healthwatch.cli stream   --folder F --name events --baseline DIR --interval 30 --out DIR --checkpoint DIR
    python -m healthwatch.cli audit    --table T --column sql --out DIR

Tables are parquet paths; results are written as parquet (no driver collect).
"""

from __future__ import annotations

import argparse
import os

from healthwatch.operators import alerts as al
from healthwatch.operators import audit as au
from healthwatch.operators import baseline as bl
from healthwatch.session import get_spark


def _baseline(spark, path):
    return (spark.read.parquet(os.path.join(path, "stats")),
            spark.read.parquet(os.path.join(path, "histogram")))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="healthwatch")
    sub = p.add_subparsers(dest="cmd", required=True)
    b = sub.add_parser("baseline", help="learn the per-field baseline of a clean table")
    b.add_argument("--table", required=True)
    b.add_argument("--out", required=True)
    b.add_argument("--approx", action="store_true", help="approximate percentiles (continuous fields at scale)")
    d = sub.add_parser("detect", help="run every detector once on a table")
    d.add_argument("--table", required=True)
    d.add_argument("--baseline", required=True)
    d.add_argument("--out")
    s = sub.add_parser("stream", help="detect continuously on a file stream")
    s.add_argument("--folder", required=True)
    s.add_argument("--name", default="events")
    s.add_argument("--baseline", required=True)
    s.add_argument("--interval", type=int, default=30, help="seconds between micro-batches")
    s.add_argument("--out", help="table of the alerts, one partition per micro-batch")
    s.add_argument("--checkpoint", help="with --out: a stopped stream goes on where it ended")
    s.add_argument("--once", action="store_true", help="consume what is available, then stop")
    a = sub.add_parser("audit", help="audit a table of SQL statements")
    a.add_argument("--table", required=True)
    a.add_argument("--column", default="sql")
    a.add_argument("--out", required=True)
    args = p.parse_args(argv)

    spark = get_spark()
    if args.cmd == "baseline":
        df = spark.read.parquet(args.table)
        if args.approx:
            stats, hist = bl.fit_baseline(df, approx=True), bl.baseline_histogram(df)
        else:
            stats, hist = bl.fit(df)            # one scan: stats and KS sample from the same collapse
        hist.write.mode("overwrite").parquet(os.path.join(args.out, "histogram"))
        stats.write.mode("overwrite").parquet(os.path.join(args.out, "stats"))
    elif args.cmd == "detect":
        stats, hist = _baseline(spark, args.baseline)
        alerts = al.detect_all(spark.read.parquet(args.table), stats, hist)
        if args.out:
            alerts.write.mode("overwrite").parquet(args.out)
        else:
            alerts.show(truncate=False)
    elif args.cmd == "stream":
        from healthwatch.streaming import pipeline as sp
        stats, hist = _baseline(spark, args.baseline)
        trigger = {"availableNow": True} if args.once else {"processingTime": f"{args.interval} seconds"}
        sp.stream_detect(sp.read_table_stream(spark, args.folder, args.name), stats, hist, trigger=trigger, out=args.out, checkpoint=args.checkpoint)
    elif args.cmd == "audit":
        au.audit_sql(spark.read.parquet(args.table), args.column).write.mode("overwrite").parquet(args.out)


if __name__ == "__main__":
    main()
