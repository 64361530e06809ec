"""Row-wise functions. Division by zero and domain errors give NULL, never NaN or infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(x: Column) -> Column:
    """NaN and both infinities become NULL."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def number(text: Column) -> Column:
    """Text to double; anything unparsable becomes NULL."""
    return clean(text.try_cast("double"))


def divide(x, y) -> Column:
    return F.try_divide(x, y)


def power(x, y) -> Column:
    return clean(F.pow(x, y))


def signedpower(x: Column, y) -> Column:
    return clean(F.signum(x) * F.pow(F.abs(x), y))


def log(x: Column) -> Column:
    return F.ln(F.when(x > 0, x))


def sqrt(x: Column) -> Column:
    return F.sqrt(F.when(x >= 0, x))


def scale(x: Column) -> Column:
    return x / 1000.0


def vwap(amount: Column, volume: Column) -> Column:
    """Amount is in thousands and volume in lots of one hundred."""
    return amount * 1000 / (volume * 100 + 1)


def suspended(close: Column) -> Column:
    return close.isNull().cast("int")


# Upper-case names of the maths transforms of one price.
def math_transforms(x: Column) -> dict[str, Column]:
    unit = F.when((x >= -1) & (x <= 1), x)
    small = F.when(F.abs(x) <= 700, x)  # beyond that e**x leaves the double range
    return {
        "ACOS": F.acos(unit),
        "ASIN": F.asin(unit),
        "ATAN": F.atan(x),
        "CEIL": F.ceil(x).cast("double"),
        "COS": F.cos(x),
        "COSH": F.cosh(small),
        "EXP": F.exp(small),
        "FLOOR": F.floor(x).cast("double"),
        "LN": log(x),
        "LOG10": F.log10(F.when(x > 0, x)),
        "SIN": F.sin(x),
        "SINH": F.sinh(small),
        "SQRT": sqrt(x),
        "TAN": F.tan(x),
        "TANH": F.tanh(x),
    }


def math_pairs(x: Column, y: Column) -> dict[str, Column]:
    return {"ADD": x + y, "SUB": x - y, "MULT": x * y, "DIV": divide(x, y)}


def pivot_points(high: Column, low: Column, close: Column) -> dict[str, Column]:
    pp = (high + low + close) / 3
    return {
        "PPSR": pp,
        "PPR1": 2 * pp - low,
        "PPS1": 2 * pp - high,
        "PPR2": pp + high - low,
        "PPS2": pp - high + low,
        "PPR3": high + 2 * (pp - low),
        "PPS3": low - 2 * (high - pp),
    }


def trade_cost(value: Column, tax: float, commission: float, minimum: float) -> Column:
    return value * tax + F.greatest(value * commission, F.lit(minimum))


def cents(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def limit_rate(code: Column, dt: Column, name: Column) -> Column:
    """Daily price limit by board, special-treatment name and the 2020 reform date."""
    board = F.substring(code, 1, 3)
    special = name.contains("ST") | name.contains("st")
    reformed = dt >= F.lit("2020-08-24").cast("date")
    return (
        F.when(board == "300", F.when(reformed, 0.2).otherwise(0.1))
        .when(board == "688", 0.2)
        .when(F.substring(code, 1, 1).isin("7", "8"), 0.3)
        .when(special, 0.05)
        .otherwise(0.1)
    )


def price_limits(previous: Column, rate: Column, upper: Column, lower: Column) -> tuple[Column, Column]:
    """Exchange figures win; otherwise previous close plus or minus the rate, in cents."""
    return F.coalesce(upper, cents(previous * (1 + rate))), F.coalesce(lower, cents(previous * (1 - rate)))


def exchange_code(code: Column) -> Column:
    """000001.SZ style to 000001.XSHE style."""
    swapped = F.regexp_replace(code, r"\.SH$", ".XSHG")
    return F.regexp_replace(swapped, r"\.SZ$", ".XSHE")


def local_code(code: Column) -> Column:
    swapped = F.regexp_replace(code, r"\.XSHG$", ".SH")
    return F.regexp_replace(swapped, r"\.XSHE$", ".SZ")


def compact_date(text: Column) -> Column:
    """YYYYMMDD or YYYY-MM-DD text to a date; bad text becomes NULL."""
    return F.try_to_timestamp(F.replace(text, F.lit("-"), F.lit("")), F.lit("yyyyMMdd")).cast("date")
