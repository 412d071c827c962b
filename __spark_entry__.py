
from __future__ import annotations

import importlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import barloom as bl
from barloom.functions.timestamps import timestamp_to_epoch_us
from barloom.scratch import scratch_folder
from barloom.sources.schemas import BAR_COLUMNS, BAR_FIELDS


# --- inputs ------------------------------------------------------------------


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as trades: event type, time, value and the ``k`` in its JSON."""
    size = F.get_json_object("props", "$.k")
    return bl.as_trades(_table(spark, sf_dir, "events"), "event_type", "ts", "value", size)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as trades of size one; many share a day, their key orders them."""
    orders = _table(spark, sf_dir, "orders")
    return bl.as_trades(
        orders, "o_orderpriority", "o_orderdate", "o_totalprice", F.lit(1.0), "o_orderkey"
    )


def _latest(spark: SparkSession, sf_dir: str, limit: int = bl.DEFAULT_LIMIT) -> DataFrame:
    return bl.latest_from_trades(_trades(spark, sf_dir), limit=limit)


def _raw(named: DataFrame) -> DataFrame:
    """Named bars back to raw records, one per series of at most 500 bars."""
    row = F.array(
        bl.timestamp_to_epoch_ms(F.col("timestamp")).cast("double"),
        *[F.col(name) for name in BAR_FIELDS[1:]],
    )
    return named.groupBy("symbol", "timeframe").agg(F.sort_array(F.collect_list(row)).alias("ohlcv"))


# --- queries -----------------------------------------------------------------


def _bars_of(label: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: bl.bars(_trades(spark, sf_dir), [label])


def mtf_latest_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir)


def mtf_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bl.bars(_trades(spark, sf_dir))


def latest_1500_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit beyond Spark's own per-task cut: the salted ranking."""
    return _latest(spark, sf_dir, 1500)


def bars_rolled_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = bl.bars(_trades(spark, sf_dir), ["5M"]).drop("timeframe")
    return bl.latest_bars(bl.roll_up(base))


def symbol_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bl.latest_from_trades(_trades(spark, sf_dir), symbols=["click"])


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bl.bars(_orders(spark, sf_dir), ["1D"], order_by="o_orderkey")


def daily_latest_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal stamps broken by the order key, over two columns."""
    order = ("ts", "o_orderkey")
    return bl.latest_from_trades(_orders(spark, sf_dir), timeframes=["1D"], order_by=order)


def tied_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All timeframes with a second ordering column, in case stamps repeat."""
    events = _table(spark, sf_dir, "events")
    size = F.get_json_object("props", "$.k")
    trades = bl.as_trades(events, "event_type", "ts", "value", size, "event_id")
    return bl.bars(trades, order_by=("ts", "event_id"))


def zoned_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same trades with their times given as instants."""
    trades = _trades(spark, sf_dir)
    instant = F.timestamp_micros(timestamp_to_epoch_us(F.col("ts")))
    return bl.bars(trades.withColumn("ts", instant))


def custom_timeframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timeframes that do not nest in each other."""
    frames = [bl.Timeframe("3H", "3h", 10_800), bl.Timeframe("2H", "2h", 7_200)]
    return bl.bars(_trades(spark, sf_dir), frames)


def supplier_latest_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many symbols on the largest table: weekly and daily bars per supplier."""
    lines = _table(spark, sf_dir, "lineitem")
    trades = bl.as_trades(
        lines,
        F.col("l_suppkey").cast("string"),
        "l_shipdate",
        "l_extendedprice",
        "l_quantity",
        "l_orderkey",
        "l_linenumber",
    )
    # Line numbers repeat within an order, so the price settles what is left. Ship dates
    # are whole days, so time takes no room in the key of a daily bar.
    order = bl.PackedOrder(
        [
            bl.OrderField("l_orderkey", 0, 1 << 33),
            bl.OrderField("l_linenumber", 0, 7),
            bl.OrderField("price", 0, 1_000_000, scale=100),
        ],
        microseconds=86_400_000_000,
    )
    frames = [bl.Timeframe("1W", "1w", 604_800), "1D"]
    # A supplier ships about once a day: folding trades before a shuffle would save nothing.
    partitions = bl.partitions_for(lines)
    return bl.latest_from_trades(trades, timeframes=frames, limit=100, order_by=order, partitions=partitions)


def tied_bars_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All timeframes by time and event number in one wide key: microseconds need decimals."""
    events = _table(spark, sf_dir, "events")
    size = F.get_json_object("props", "$.k")
    trades = bl.as_trades(events, "event_type", "ts", "value", size, "event_id")
    return bl.bars(trades, order_by=bl.PackedOrder([bl.OrderField("event_id", 0, 10**15)]))


def bar_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many bars each series has on each day."""
    return bl.bar_histogram(_trades(spark, sf_dir))


def histogram_latest_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 100 short bars, from no older trades than a stored histogram asks for."""
    trades, path = _trades(spark, sf_dir), scratch_folder(spark, "histogram")
    bl.bar_histogram(trades).write.parquet(path)
    histogram = spark.read.schema("symbol string, timeframe string, span timestamp_ntz, bars long").parquet(path)
    return bl.latest_from_trades(trades, timeframes=["1H", "15M", "5M"], limit=100, histogram=histogram)


def exact_volume_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of fractions that have the same bits however the trades are dealt."""
    size = F.floor(F.col("value") * 1024) / 1024
    trades = bl.as_trades(_table(spark, sf_dir, "events"), "event_type", "ts", "value", size)
    return bl.bars(trades, exact_volume=True)


def raw_bars_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bl.name_bars(_raw(_latest(spark, sf_dir)))


def raw_bar_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land raw bars as JSON lines, scan two timeframes and name them."""
    path = scratch_folder(spark)
    _raw(_latest(spark, sf_dir)).write.json(path)
    return bl.name_bars(bl.read_raw_bars(spark, path, timeframes=["4H", "5M"]))


def latest_1500_of_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter after the ranking, which must still reach the scan."""
    return _latest(spark, sf_dir, 1500).where("symbol = 'click'")


def _overlapping_pulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two landed pulls of every series: days 1 to 20, then days 15 to 30 with later values."""
    built = bl.bars(_trades(spark, sf_dir), ["1D"])
    day = F.dayofmonth("timestamp")
    first = built.where(day <= 20).withColumn("close", F.col("close") / 2)
    pulls = [_raw(part).withColumn("pulled_at", F.lit(at)) for part, at in ((first, 1_000), (built.where(day >= 15), 2_000))]
    path = scratch_folder(spark, "pulls")
    for pull in pulls:
        pull.write.mode("append").json(path)
    return bl.read_raw_bars(spark, path)


def raw_overlapping_pulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bl.latest_from_raw(_overlapping_pulls(spark, sf_dir), limit=20)


def overlapping_pull_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_folder(spark, "documents")
    bl.report_from_raw(_overlapping_pulls(spark, sf_dir), path, timeframes=["1D"], limit=20)
    return _read_documents(spark, path)


def rolled_up_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base bars of which some have no open, close or any value; null cells are skipped."""
    base = bl.bars(_trades(spark, sf_dir), ["5M"]).drop("timeframe")
    minute = F.minute("timestamp")
    cells = {
        name: F.when((minute % 15 != 0) & ~(minute.isin(gone)), F.col(name))
        for name, gone in (("open", [5]), ("close", [55]), ("high", []), ("low", []), ("volume", []))
    }
    return bl.roll_up(base.withColumns(cells), ["1D", "1H"])


def bars_with_null_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a price are no trades, and their size is not counted."""
    events = _table(spark, sf_dir, "events")
    price = F.when(F.col("event_id") % 3 != 0, F.col("value"))
    size = F.get_json_object("props", "$.k")
    return bl.bars(bl.as_trades(events, "event_type", "ts", price, size))


def wide_timeframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month and a minute: far more base bars in the longest interval than one task should hold."""
    frames = [bl.Timeframe("30D", "30d", 2_592_000), "1D", bl.Timeframe("1M", "1m", 60)]
    return bl.bars(_trades(spark, sf_dir), frames)


def symbols_with_slashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that clean alike are stored, replaced and read back apart."""
    built = _latest(spark, sf_dir)
    path = scratch_folder(spark, "slashes")
    for replaced in (built, built.where("timeframe = '1D'")):
        names = ("cl/ick", "cli/ck") if replaced is built else ("cli/ck",)
        parts = [replaced.where("symbol = 'click'").withColumn("symbol", F.lit(name)) for name in names]
        rows = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
        bl.write_bars(rows, path, replace="symbols")
    return bl.read_bars(spark, path)


def raw_latest_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bl.latest_from_raw(_raw(_latest(spark, sf_dir)), limit=100)


def epoch_ms_to_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = bl.timestamp_to_epoch_ms(F.col("ts"))
    return (
        _table(spark, sf_dir, "events")
        .select("event_id", ms.alias("epoch_ms"))
        .withColumn("timestamp", bl.epoch_ms_to_timestamp(F.col("epoch_ms")))
    )


def clean_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = bl.clean_symbol(F.col("o_orderpriority"), "-").alias("symbol")
    return _table(spark, sf_dir, "orders").groupBy(cleaned).agg(F.count("*").alias("orders"))


def clean_slashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return pages.select("page_id", bl.clean_symbol(F.col("url")).alias("cleaned"))


def document_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return pages.select("page_id", bl.document_name(F.col("url")).alias("file_name"))


def timeframe_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bl.with_timeframe_info(mtf_bars(spark, sf_dir)).select(
        "symbol", "timestamp", "timeframe", "section_no", "code", "seconds"
    )


def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    forms = {
        "as_is": price,
        "times_1000": price * 1000,
        "per_billion": price / 1e9,
        "per_trillion": price / 1e12,
    }
    numbers = _table(spark, sf_dir, "orders").select(
        "o_orderkey", *[value.alias(name) for name, value in forms.items()]
    )
    return bl.with_number_texts(numbers, *forms)


def ordered_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bl.order_bars(_latest(spark, sf_dir))


def section_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bl.document_lines(mtf_bars(spark, sf_dir))


def daily_section_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date-only stamps, an empty section and a footer."""
    built = bl.bars(_orders(spark, sf_dir), ["1D"], order_by="o_orderkey")
    return bl.document_lines(built, ["1D", "4H"], footer_lines=["# END"])


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the documents and read them back, line by line in file order."""
    path = scratch_folder(spark)
    bl.report_from_trades(_trades(spark, sf_dir), path)
    return _read_documents(spark, path)


def raw_document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents, from raw bars landed as JSON."""
    path = scratch_folder(spark)
    _raw(_latest(spark, sf_dir)).write.json(f"{path}/raw")
    bl.report_from_raw(bl.read_raw_bars(spark, f"{path}/raw"), f"{path}/documents")
    return _read_documents(spark, f"{path}/documents")


def _read_documents(spark: SparkSession, path: str) -> DataFrame:
    # A document is one bounded file, so one row can hold it.
    whole = spark.read.schema("value string, document string").text(path, wholetext=True)
    lines = F.split("value", "\n")
    return whole.select(
        "document", F.posexplode(F.slice(lines, F.lit(1), F.size(lines) - 1)).alias("line_no", "line")
    )


def bar_sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_folder(spark)
    bl.write_bars(_latest(spark, sf_dir), path)
    return bl.read_bars(spark, path)


def bar_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_folder(spark)
    bl.write_bars(_latest(spark, sf_dir), path, fmt="csv")
    return bl.read_bars(spark, path, fmt="csv")


def stored_timeframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two timeframes of a stored table, pruned by partition."""
    path = scratch_folder(spark)
    bl.write_bars(mtf_bars(spark, sf_dir), path)
    return bl.select_timeframes(bl.read_bars(spark, path), ["4H", "1H"])


def concat_timeframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timeframes read back one by one and stacked again."""
    path = scratch_folder(spark)
    bl.write_bars(_latest(spark, sf_dir), path)
    stored = bl.read_bars(spark, path)
    tables = {
        frame.label: bl.select_timeframes(stored, [frame.label]).drop("timeframe")
        for frame in bl.TIMEFRAMES
    }
    return bl.concat_timeframes(tables).select(*BAR_COLUMNS)


def replaced_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all symbols, then one of them again; the others must stay."""
    path = scratch_folder(spark)
    bl.write_bars(_latest(spark, sf_dir), path, replace="symbols")
    again = bl.latest_from_trades(_trades(spark, sf_dir), ["click"], ["1D", "1H"], limit=100)
    bl.write_bars(again, path, replace="symbols")
    return bl.read_bars(spark, path)


def versioned_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a bucketed table: all symbols, then one of them again."""
    path = scratch_folder(spark, "versions")
    bl.write_version(_latest(spark, sf_dir), path, buckets=4)
    again = bl.latest_from_trades(_trades(spark, sf_dir), ["click"], ["1D", "1H"], limit=100)
    bl.write_version(again, path, replace="symbols")
    return bl.read_version(spark, path)


def versioned_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One symbol's buckets of the first of two versions."""
    path = scratch_folder(spark, "versions")
    bl.write_version(_latest(spark, sf_dir), path, buckets=4)
    bl.write_version(_latest(spark, sf_dir, 10), path)
    return bl.read_version(spark, path, version=1, symbols=["click"])


def bars_of_symbol_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' bars for the symbols that another table names: those of a low balance."""
    names = _table(spark, sf_dir, "supplier").where("s_acctbal < 5000").select(F.col("s_suppkey").cast("string").alias("symbol"))
    lines = _table(spark, sf_dir, "lineitem")
    trades = bl.as_trades(lines, F.col("l_suppkey").cast("string"), "l_shipdate", "l_extendedprice", "l_quantity", "l_orderkey")
    order = bl.PackedOrder(
        [bl.OrderField("l_orderkey", 0, 1 << 33), bl.OrderField("price", 0, 1_000_000, scale=100)], microseconds=86_400_000_000
    )
    return bl.bars(bl.select_symbols(trades, names), ["1D"], order_by=order)


def _landed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw bars landed as lines: every 7th hour has a value too many, some lines are broken."""
    path = scratch_folder(spark, "landed")
    raw = _raw(bl.bars(_trades(spark, sf_dir), ["1D", "1H"]))
    bars = F.transform("ohlcv", lambda bar: F.when((bar[0] / 3_600_000) % 7 == 0, F.concat(bar, F.array(F.lit(0.0)))).otherwise(bar))
    good = raw.select(F.to_json(F.struct("symbol", "timeframe", bars.alias("ohlcv"))).alias("value"))
    broken = F.explode(F.array(
        F.substring("value", 1, 40),
        F.replace("value", F.lit('"symbol"'), F.lit('"name"')),
        F.lit("  "),
    ))
    good.union(good.where("value like '%\"1D\"%'").select(broken)).write.text(path)
    return bl.read_raw_lines(spark, path)


def raw_lines_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named bars of landed lines, without those that cannot be read."""
    return bl.name_bars(bl.good_raw(_landed_lines(spark, sf_dir)))


def raw_lines_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records were left out, for each reason, and the hours of bars too long."""
    rejects = bl.raw_rejects(_landed_lines(spark, sf_dir))
    bar = F.from_json("record", "symbol string, timeframe string, ohlcv array<double>")
    rows = rejects.select("reason", F.when(F.col("reason").startswith("a bar"), bar).alias("bar"))
    return rows.groupBy("reason", F.col("bar.symbol").alias("symbol"), F.col("bar.timeframe").alias("timeframe")).agg(
        F.count("*").alias("records"), F.coalesce(F.min(F.get("bar.ohlcv", 0)).cast("long"), F.lit(-1)).alias("first_ms")
    )


def entry(spark: SparkSession) -> DataFrame:
    """The newest 500 bars per symbol at five timeframes, from the smallest tables."""
    return mtf_latest_bars(spark, "/root/testdata/sf0.001")


def _optional(name: str):
    """A part of the repository that may have been taken out, or None."""
    try:
        return importlib.import_module(name)
    except ModuleNotFoundError as missing:
        if missing.name not in (name, name.rpartition(".")[0]):
            raise
        return None


def _text_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries on texts and the pipeline, where they are installed."""
    found = {}
    if (texts := _optional("barloom.llm.queries")) is not None:
        found |= texts.queries()
        if (pipeline := _optional("corpus_pipeline")) is not None:
            found["pipeline"] = pipeline.run
    return found


def _text_oracles() -> dict[str, str]:
    found = {}
    if (texts := _optional("barloom.llm.queries")) is not None:
        found |= texts.oracle_sql()
        pipeline = _optional("corpus_pipeline")
        if pipeline is not None and pipeline.ORACLE_SQL is not None:
            found["pipeline"] = pipeline.ORACLE_SQL
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return bar_queries() | _text_queries()


def oracle_sql() -> dict[str, str]:
    return bar_oracles() | _text_oracles()


def bar_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        mtf_latest_bars,
        mtf_bars,
        latest_1500_bars,
        latest_1500_of_symbol,
        bars_rolled_up,
        rolled_up_with_nulls,
        bars_with_null_prices,
        wide_timeframes,
        symbol_bars,
        daily_bars,
        daily_latest_bars,
        tied_bars,
        zoned_bars,
        custom_timeframes,
        supplier_latest_bars,
        tied_bars_packed,
        bar_histogram,
        histogram_latest_bars,
        exact_volume_bars,
        raw_bars_named,
        raw_bar_scan,
        raw_latest_100,
        raw_overlapping_pulls,
        overlapping_pull_documents,
        symbols_with_slashes,
        epoch_ms_to_timestamp,
        clean_symbol,
        clean_slashes,
        document_names,
        timeframe_info,
        number_texts,
        ordered_bars,
        section_lines,
        daily_section_lines,
        document_files,
        raw_document_files,
        bar_sink_roundtrip,
        bar_csv_roundtrip,
        stored_timeframes,
        concat_timeframes,
        replaced_symbols,
        versioned_bars,
        versioned_symbol,
        bars_of_symbol_table,
        raw_lines_named,
        raw_lines_rejected,
    ]
    single = {f"bars_{frame.label.lower()}": _bars_of(frame.label) for frame in bl.TIMEFRAMES}
    return {query.__name__: query for query in named} | single


# --- the same queries in SQL ---------------------------------------------------

_TF = """tf(section_no, timeframe, code, secs) as (
  values (0, '1D', '1d', 86400::bigint), (1, '4H', '4h', 14400::bigint),
         (2, '1H', '1h', 3600::bigint), (3, '15M', '15m', 900::bigint),
         (4, '5M', '5m', 300::bigint))"""

_CUSTOM_TF = """tf(section_no, timeframe, code, secs) as (
  values (0, '3H', '3h', 10800::bigint), (1, '2H', '2h', 7200::bigint))"""

_BARS = f"""with {_TF},
bars as (
  select event_type as symbol, section_no, timeframe, code, secs,
         make_timestamp((epoch_us(ts) // (secs * 1000000)) * secs * 1000000) as "timestamp",
         arg_min(value, ts) as open, max(value) as high, min(value) as low,
         arg_max(value, ts) as close,
         sum(cast(json_extract_string(props, '$.k') as double)) as volume
  from events cross join tf group by all),
ranked as (
  select *, row_number() over (partition by symbol, timeframe order by "timestamp" desc) as newest
  from bars)"""

_DAILY = """with bars as (
  select o_orderpriority as symbol, 0 as section_no, '1D' as timeframe,
         date_trunc('day', o_orderdate)::timestamp as "timestamp",
         arg_min(o_totalprice, o_orderkey) as open, max(o_totalprice) as high,
         min(o_totalprice) as low, arg_max(o_totalprice, o_orderkey) as close,
         cast(count(*) as double) as volume
  from orders group by all),
ranked as (
  select *, row_number() over (partition by symbol, timeframe order by "timestamp" desc) as newest
  from bars)"""

_SUPPLIERS = """with tf(timeframe, secs) as (values ('1W', 604800::bigint), ('1D', 86400::bigint)),
bars as (
  select l_suppkey::varchar as symbol, timeframe,
         make_timestamp((epoch_us(l_shipdate) // (secs * 1000000)) * secs * 1000000) as "timestamp",
         first(l_extendedprice order by l_shipdate, l_orderkey, l_linenumber, l_extendedprice) as open,
         max(l_extendedprice) as high, min(l_extendedprice) as low,
         last(l_extendedprice order by l_shipdate, l_orderkey, l_linenumber, l_extendedprice) as close,
         sum(l_quantity) as volume
  from lineitem cross join tf group by 1, 2, 3),
ranked as (
  select *, row_number() over (partition by symbol, timeframe order by "timestamp" desc) as newest
  from bars)"""

_COLUMNS = 'symbol, timeframe, "timestamp", open, high, low, close, volume'


def _select(condition: str = "newest <= 500", source: str = _BARS) -> str:
    return f"{source}\nselect {_COLUMNS} from ranked where {condition}"


_WIDE_TF = """tf(section_no, timeframe, code, secs) as (
  values (0, '30D', '30d', 2592000::bigint), (1, '1D', '1d', 86400::bigint), (2, '1M', '1m', 60::bigint))"""

#: Days 1 to 20 were pulled first, with half the close; days 15 to 30 later.
_PULLED = _BARS.replace("ranked as (\n  select *", """pulled as (
  select * replace (if(day("timestamp") < 15, close / 2, close) as close)
  from bars where timeframe = '1D' and day("timestamp") <= 30),
ranked as (
  select *""").replace("  from bars)", "  from pulled)")

#: A null cell is skipped, and so is a row without a price.
_NULL_CELLS = f"""with {_TF},
base as (
  select event_type as symbol, make_timestamp((epoch_us(ts) // 300000000) * 300000000) as began,
         arg_min(value, ts) as open, max(value) as high, min(value) as low, arg_max(value, ts) as close,
         sum(cast(json_extract_string(props, '$.k') as double)) as volume
  from events group by all),
gaps as (
  select symbol, began,
         if(minute(began) % 15 <> 0 and minute(began) <> 5, open, null) as open,
         if(minute(began) % 15 <> 0, high, null) as high, if(minute(began) % 15 <> 0, low, null) as low,
         if(minute(began) % 15 <> 0 and minute(began) <> 55, close, null) as close,
         if(minute(began) % 15 <> 0, volume, null) as volume
  from base)
select symbol, timeframe, make_timestamp((epoch_us(began) // (secs * 1000000)) * secs * 1000000) as "timestamp",
       arg_min(open, began) as open, max(high) as high, min(low) as low, arg_max(close, began) as close,
       sum(volume) as volume
from gaps cross join tf where timeframe in ('1D', '1H') group by 1, 2, 3"""

_SLASHES = f"""{_BARS}
select s.name as symbol, timeframe, "timestamp", open, high, low, close, volume
from ranked cross join (values ('cl/ick'), ('cli/ck')) s(name)
where newest <= 500 and symbol = 'click' and (name = 'cl/ick' or timeframe = '1D')"""


def _lines(source: str, labels: Sequence[str], footer: Sequence[str] = (), limit: int = 500) -> str:
    """The document lines of every symbol, as a ``lines`` table after ``source``."""
    header = ",".join(BAR_FIELDS)
    fixed = ["(-1, 0, '# SYMBOL: ' || symbol), (-1, 1, '# FORMAT: OHLCV')"]
    for i, label in enumerate(labels):
        fixed.append(f"({i}, 0, '# TIMEFRAME: {label}'), ({i}, 1, '{header}'), ({i}, 3, '')")
    fixed += [f"({len(labels)}, {i}, '{text}')" for i, text in enumerate(footer)]
    return f"""{source},
kept as (
  select *, bool_and("timestamp" = date_trunc('day', "timestamp"))
            over (partition by symbol, timeframe) as dates_only
  from ranked where newest <= {limit}),
lines as (
  select symbol, section_no, 2 as part, "timestamp",
         case when dates_only then strftime("timestamp", '%Y-%m-%d')
              else strftime("timestamp", '%Y-%m-%d %H:%M:%S') end
         || ',' || open::varchar || ',' || high::varchar || ',' || low::varchar
         || ',' || close::varchar || ',' || volume::varchar as line
  from kept
  union all
  select symbol, f.section_no, f.part, null, f.line
  from (select distinct symbol from kept), lateral (values {', '.join(fixed)}) as f(section_no, part, line))"""


def bar_oracles() -> dict[str, str]:
    latest = _select()
    labels = [frame.label for frame in bl.TIMEFRAMES]
    rows = 'symbol, section_no, part, "timestamp", line'
    numbered = """
select symbol || '_MTF_OHLCV.csv' as document, cast(row_number() over (
         partition by symbol order by section_no, part, "timestamp") - 1 as integer) as line_no,
       line
from lines"""
    sql = {f"bars_{label.lower()}": _select(f"timeframe = '{label}'") for label in labels}
    sql |= {
        "mtf_latest_bars": latest,
        "mtf_bars": _select("true"),
        "latest_1500_bars": _select("newest <= 1500"),
        "latest_1500_of_symbol": _select("newest <= 1500 and symbol = 'click'"),
        "bars_rolled_up": latest,
        "rolled_up_with_nulls": _NULL_CELLS,
        "bars_with_null_prices": _select("true", _BARS.replace("from events", "from events where event_id % 3 <> 0").replace(
            "from events where event_id % 3 <> 0 cross join tf", "from (from events where event_id % 3 <> 0) cross join tf")),
        "wide_timeframes": _select("true", _BARS.replace(_TF, _WIDE_TF)),
        "raw_overlapping_pulls": _select("newest <= 20", _PULLED),
        "overlapping_pull_documents": _lines(_PULLED, ["1D"], limit=20) + numbered,
        "symbols_with_slashes": _SLASHES,
        "symbol_bars": _select("newest <= 500 and symbol = 'click'"),
        "daily_bars": _select("true", _DAILY),
        "daily_latest_bars": _select(source=_DAILY),
        "tied_bars": _select("true"),
        "zoned_bars": _select("true"),
        "custom_timeframes": _select("true", _BARS.replace(_TF, _CUSTOM_TF)),
        "tied_bars_packed": _select("true"),
        "bar_histogram": f"""{_BARS}
select symbol, timeframe, date_trunc('day', "timestamp")::timestamp as span, count(*) as bars from bars group by all""",
        "histogram_latest_bars": _select("newest <= 100 and timeframe in ('1H', '15M', '5M')"),
        "exact_volume_bars": _select("true", _BARS.replace(
            "sum(cast(json_extract_string(props, '$.k') as double))", "sum(floor(value * 1024) / 1024)")),
        "supplier_latest_bars": _select("newest <= 100", _SUPPLIERS),
        "raw_bars_named": latest,
        "raw_bar_scan": _select("newest <= 500 and timeframe in ('4H', '5M')"),
        "raw_latest_100": _select("newest <= 100"),
        "epoch_ms_to_timestamp": """
select event_id, epoch_us(ts) // 1000 as epoch_ms,
       make_timestamp(epoch_us(ts) // 1000 * 1000) as "timestamp"
from events""",
        "clean_symbol": """
select replace(o_orderpriority, '-', '') as symbol, count(*) as orders from orders group by 1""",
        "clean_slashes": "select page_id, replace(url, '/', '') as cleaned from pages",
        "document_names": """
select page_id, replace(url, '/', '') || '_MTF_OHLCV.csv' as file_name from pages""",
        "timeframe_info": f"""{_BARS}
select symbol, "timestamp", timeframe, cast(section_no as bigint) as section_no, code, secs as seconds
from bars""",
        "number_texts": """
select o_orderkey, o_totalprice::varchar as as_is, (o_totalprice * 1000)::varchar as times_1000,
       (o_totalprice / 1e9::double)::varchar as per_billion,
       (o_totalprice / 1e12::double)::varchar as per_trillion
from orders""",
        "ordered_bars": f"{latest} order by symbol, section_no, \"timestamp\"",
        "section_lines": f"{_lines(_BARS, labels)}\nselect {rows} from lines",
        "daily_section_lines": f"{_lines(_DAILY, ['1D', '4H'], ['# END'])}\nselect {rows} from lines",
        "document_files": _lines(_BARS, labels) + numbered,
        "raw_document_files": _lines(_BARS, labels) + numbered,
        "bar_sink_roundtrip": latest,
        "bar_csv_roundtrip": latest,
        "stored_timeframes": _select("timeframe in ('4H', '1H')"),
        "concat_timeframes": latest,
        "replaced_symbols": _select(
            "case when symbol = 'click' then timeframe in ('1D', '1H') and newest <= 100"
            " else newest <= 500 end"
        ),
        "versioned_symbol": _select("newest <= 500 and symbol = 'click'"),
        "bars_of_symbol_table": """
select l_suppkey::varchar as symbol, '1D' as timeframe, date_trunc('day', l_shipdate)::timestamp as "timestamp",
       first(l_extendedprice order by l_orderkey, l_extendedprice) as open, max(l_extendedprice) as high,
       min(l_extendedprice) as low, last(l_extendedprice order by l_orderkey, l_extendedprice) as close,
       sum(l_quantity) as volume
from lineitem where l_suppkey in (select s_suppkey from supplier where s_acctbal < 5000) group by 1, 2, 3""",
        "raw_lines_named": _select("timeframe in ('1D', '1H') and epoch_us(\"timestamp\") // 3600000000 % 7 <> 0"),
        "raw_lines_rejected": f"""{_BARS}
select 'a bar of 7 values' as reason, symbol, timeframe, count(*) as records, min(epoch_us("timestamp") // 1000)::bigint as first_ms
from bars where timeframe in ('1D', '1H') and epoch_us("timestamp") // 3600000000 % 7 = 0 group by all
union all
select reason, null, null, count(distinct symbol), -1
from bars cross join (values ('not a raw bar record'), ('no symbol')) r(reason) group by 1""",
    }
    sql["versioned_bars"] = sql["replaced_symbols"]
    return sql
