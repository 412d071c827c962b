"""One sectioned text document per symbol."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.text import clean_symbol, document_name, number_texts, stamp_text
from barloom.functions.timeframes import TIMEFRAMES, Timeframe, resolve, section_no
from barloom.operators.latest import DEFAULT_LIMIT, latest_bars
from barloom.operators.select import select_timeframes
from barloom.sources.schemas import BAR_FIELDS, MEASURES


def document_lines(
    bars: DataFrame,
    timeframes: Sequence[str | Timeframe] = TIMEFRAMES,
    limit: int = DEFAULT_LIMIT,
    symbols: Sequence[str] | None = None,
    footer_lines: Sequence[str] = (),
) -> DataFrame:
    """The documents as rows ``symbol, section_no, part, timestamp, line``.

    Sorting a symbol's rows by the middle three columns gives its document. It
    starts with two lines about the symbol (section -1), has one section per
    timeframe (label, CSV header, rows, blank line) and ends with the footer.

    Every section shows the newest ``limit`` bars, which bounds a document and
    with it the work of the one task that writes it. Sections without bars keep
    their label and header. So do symbols listed in ``symbols`` that have no bars
    at all, and rows that ``name_bars(keep_empty=True)`` left for empty pulls.
    """
    return _lines(bars, timeframes, limit, symbols, footer_lines).drop("document", "other")


def _lines(
    bars: DataFrame,
    timeframes: Sequence[str | Timeframe],
    limit: int,
    symbols: Sequence[str] | None,
    footer_lines: Sequence[str],
) -> DataFrame:
    """The lines with their ``document`` and the first symbol there (``other``)."""
    frames = resolve(timeframes)
    kept = latest_bars(select_timeframes(bars, frames), limit)
    numbers = number_texts(*MEASURES)
    stamp = stamp_text(F.col("timestamp"), "symbol", "timeframe")
    has_bar = F.coalesce(*[F.col(name).cast("string") for name in BAR_FIELDS]).isNotNull()
    rows = kept.select(
        "symbol",
        section_no(F.col("timeframe"), frames).cast("int").alias("section_no"),
        "timestamp",
        F.when(has_bar, F.array_join(F.concat(F.array(stamp), numbers), ",", "")).alias("line"),
    )
    if symbols:
        listed = F.explode(F.array(*[F.lit(symbol) for symbol in symbols]))
        asked = bars.sparkSession.range(1).select(listed.alias("symbol"))
        rows = rows.unionByName(asked, allowMissingColumns=True)

    # The fixed lines ride on the first row of each symbol, so the bars are
    # computed once and the symbols need no second pass or join. Rows meet by
    # document, so that symbols which share one are seen.
    name = document_name(F.coalesce("symbol", F.lit("")))
    one_document = Window.partitionBy("document").orderBy("symbol", "section_no", "timestamp")
    before = F.lag(F.struct("symbol")).over(one_document)
    own = F.array(_line(F.col("section_no"), 2, F.col("line"), F.col("timestamp")))
    return (
        rows.withColumn("document", name)
        .withColumn("first", before.isNull() | ~before["symbol"].eqNullSafe(F.col("symbol")))
        .withColumn("other", F.first(F.struct("symbol")).over(one_document)["symbol"])
        .select(
            "symbol",
            "document",
            "other",
            F.inline_outer(
                F.when(F.col("first"), F.concat(own, _fixed_lines(frames, footer_lines))).otherwise(own)
            ),
        )
        .where(F.col("line").isNotNull())
    )


def _line(section: Column | int, part: int, text: Column | str, ts: Column | None = None) -> Column:
    section = section if isinstance(section, Column) else F.lit(section)
    text = text if isinstance(text, Column) else F.lit(text)
    ts = F.lit(None) if ts is None else ts
    return F.struct(
        section.cast("int").alias("section_no"),
        F.lit(part).alias("part"),
        ts.cast("timestamp_ntz").alias("timestamp"),
        text.alias("line"),
    )


def _fixed_lines(frames: Sequence[Timeframe], footer_lines: Sequence[str]) -> Column:
    # The wording of the lines around the bars.
    title = F.concat(F.lit("# SYMBOL: "), clean_symbol(F.coalesce("symbol", F.lit(""))))
    lines = [_line(-1, 1, "# FORMAT: OHLCV")]
    for i, frame in enumerate(frames):
        lines.append(_line(i, 0, f"# TIMEFRAME: {frame.label}"))
        lines.append(_line(i, 1, ",".join(BAR_FIELDS)))
        lines.append(_line(i, 3, ""))
    lines += [_line(len(frames), i, text) for i, text in enumerate(footer_lines)]
    return F.concat(F.array(_line(-1, 0, title)), F.array(*lines))


def write_documents(
    bars: DataFrame,
    path: str,
    timeframes: Sequence[str | Timeframe] = TIMEFRAMES,
    limit: int = DEFAULT_LIMIT,
    symbols: Sequence[str] | None = None,
    footer_lines: Sequence[str] = (),
) -> None:
    """Write each symbol's document to ``document=<its name>/``, one text file.

    Documents of the symbols written are replaced, others stay. Spark publishes
    the files when the job has succeeded, so a failure leaves the old ones. Two
    symbols whose names clean to the same document fail the job; a null symbol
    counts as an empty one.
    """
    lines = _lines(bars, timeframes, limit, symbols, footer_lines)
    shown = [F.coalesce(F.col(name), F.lit("null")) for name in ("other", "symbol")]
    clash = F.raise_error(F.format_string("symbols %s and %s share the document %s", *shown, "document"))
    value = F.when(F.col("other").eqNullSafe(F.col("symbol")), F.col("line")).otherwise(clash.cast("string"))
    # Rows of a document are in one task already.
    (
        lines.sortWithinPartitions("document", "section_no", "part", "timestamp")
        .select("document", value.alias("value"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("document")
        .text(path)
    )
