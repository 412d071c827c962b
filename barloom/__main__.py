"""Command line: ``spark-submit`` or ``python -m barloom``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from barloom.functions.timeframes import TIMEFRAMES
from barloom.operators.latest import DEFAULT_LIMIT
from barloom.plans.report import report_from_raw, report_from_trades
from barloom.sources.raw_bars import read_raw_bars


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="barloom", description=__doc__)
    source = parser.add_mutually_exclusive_group(required=True)
    source.add_argument("--raw", help="JSON lines of raw bars: symbol, timeframe, ohlcv")
    source.add_argument("--trades", help="Parquet of trades: symbol, ts, price, size")
    parser.add_argument("--out", required=True, help="directory for the documents")
    parser.add_argument("--symbols", nargs="+", help="default: all in the data")
    parser.add_argument("--timeframes", nargs="+", default=[frame.label for frame in TIMEFRAMES])
    parser.add_argument("--limit", type=int, default=DEFAULT_LIMIT, help="newest bars per section")
    parser.add_argument("--order-by", nargs="+", default=["ts"], help="trade order (with --trades)")
    parser.add_argument("--footer", nargs="*", default=[], help="lines after the last section")
    args = parser.parse_args(argv)

    spark = SparkSession.builder.appName("barloom").getOrCreate()
    options = dict(symbols=args.symbols, timeframes=args.timeframes, limit=args.limit)
    if args.raw:
        raw = read_raw_bars(spark, args.raw)
        report_from_raw(raw, args.out, footer_lines=args.footer, **options)
    else:
        trades = spark.read.parquet(args.trades)
        order_by = args.order_by if len(args.order_by) > 1 else args.order_by[0]
        report_from_trades(trades, args.out, order_by=order_by, footer_lines=args.footer, **options)


if __name__ == "__main__":
    main()
