"""Text forms: cleaned symbols, document names, numbers and time stamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_symbol(symbol: Column, removed: str = "/") -> Column:
    """Remove every ``/`` (or another separator) from a symbol."""
    return F.replace(symbol, F.lit(removed), F.lit(""))


def document_name(symbol: Column) -> Column:
    """File name of a symbol's document, from its cleaned form."""
    # Fixed value: the ending of every document's name.
    return F.concat(clean_symbol(symbol), F.lit("_MTF_OHLCV.csv"))


def number_text(number: Column) -> Column:
    """A double as CSV readers and writers around pandas print it.

    Spark's own text has the same digits but switches to ``1.2E7`` at ten
    million and below a thousandth; here plain digits run from 0.0001 up to
    1e16, and exponents outside that look like ``1e-05``. Null and NaN give null.
    """
    return _restyled(_parts(number.cast("string")))


def _parts(text: Column) -> Column:
    """A double's text with its exponent, and its digits without point or trailing zeros."""
    mantissa = F.ltrim(F.substring_index(text, "E", 1), F.lit("-"))
    digits = F.concat(
        F.substring_index(mantissa, ".", 1),
        F.rtrim(F.substring_index(mantissa, ".", -1), F.lit("0")),
    )
    power = F.when(F.contains(text, F.lit("E")), F.substring_index(text, "E", -1).try_cast("int"))
    return F.struct(text.alias("text"), power.alias("power"), F.when(power.isNotNull(), digits).alias("digits"))


def _restyled(parts: Column) -> Column:
    """Spark's text of a double in the other style, by moving its digits."""
    text, power, digits = parts["text"], parts["power"], parts["digits"]
    short = F.replace(F.nullif(text, F.lit("NaN")), F.lit("Infinity"), F.lit("inf"))
    sign = F.when(F.startswith(text, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    whole = F.rpad(digits, power + 1, F.lit("0"))
    rest = F.substr(digits, power + 2)
    large = F.concat(whole, F.lit("."), F.when(rest == "", F.lit("0")).otherwise(rest))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    rest = F.substr(digits, F.lit(2))
    exponent = F.concat(
        F.left(digits, F.lit(1)),
        F.when(rest == "", F.lit("")).otherwise(F.concat(F.lit("."), rest)),
        F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.when(F.abs(power) < 10, F.lit("0")).otherwise(F.lit("")),
        F.abs(power).cast("string"),
    )
    return F.when(power.isNull(), short).otherwise(
        F.concat(
            sign,
            F.when((power >= 0) & (power < 16), large).when((power < 0) & (power >= -4), small).otherwise(exponent),
        )
    )


def number_texts(*names: str) -> Column:
    """The texts of double columns, as an array.

    All go through one array expression: a copy of the text rules per column
    would make a generated method too large for the JVM to compile. A row in which
    no text has an exponent, NaN or infinity needs no more than the casts.
    """
    texts = F.array(*[F.col(name).cast("string") for name in names])
    odd = F.rlike(F.array_join(texts, ","), F.lit("[ENI]"))
    return F.when(odd, F.transform(F.transform(texts, _parts), _restyled)).otherwise(texts)


def with_number_texts(df: DataFrame, *names: str) -> DataFrame:
    """Replace double columns by their text."""
    return (
        df.withColumn("texts", number_texts(*names))
        .withColumns({name: F.get("texts", i) for i, name in enumerate(names)})
        .drop("texts")
    )


def stamp_text(ts: Column, *series: str) -> Column:
    """A zone-less timestamp as text, in one style for the whole series.

    A series whose stamps are all midnight prints dates only. Otherwise the
    series shows seconds, and as many digits after them as its finest stamp
    needs (none, three or six). The series columns name the window to look at:
    all its rows meet in one task, so call this on limited tables only.
    """
    text = ts.cast("string")  # yyyy-MM-dd HH:mm:ss[.ffffff]
    whole_series = Window.partitionBy(*series)
    dates_only = F.min(F.substr(text, F.lit(12)) == "00:00:00").over(whole_series)
    longest = F.max(F.length(text)).over(whole_series)
    padded = F.rpad(
        F.when(F.length(text) == 19, F.concat(text, F.lit("."))).otherwise(text),
        F.when(longest <= 23, 23).otherwise(26),
        F.lit("0"),
    )
    return F.when(dates_only, F.left(text, F.lit(10))).when(longest == 19, text).otherwise(padded)
