"""Exact fixed-point arithmetic on columns of raw units (BIGINT, 1 unit = 1e-8).

Every result that a signed 64-bit integer can't hold is null, so a job can keep good rows and set the others aside.
Sums, differences and signs take wider operands (integral decimals), too: only what comes out must fit.
Products and quotients go through DECIMAL(38,0) and are rounded half to even.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 10**8
LEAST, MOST = -(2**63), 2**63 - 1

SYNTAX, PRECISION, RANGE, NEGATIVE = "syntax", "precision", "range", "negative"


def _col(x: Column | str | int) -> Column:
    return F.lit(x) if isinstance(x, int) else F.col(x) if isinstance(x, str) else x


def wide(x: Column | str | int) -> Column:
    return _col(x).cast("decimal(20,0)")


def in_range(x: Column) -> Column:
    """A wide integer as BIGINT, or null beyond 64 bits."""
    return F.when((x >= F.lit(LEAST)) & (x <= F.lit(MOST)), x.cast("bigint"))


def divide_half_even(value: Column, by: Column) -> Column:
    """``value`` / ``by``, both integral decimals, rounded half to even; null where ``by`` is zero."""
    v, s = value.cast("decimal(38,0)"), F.when(by != 0, by.cast("decimal(38,0)"))
    rest = v % s
    quotient = ((v - rest) / s).cast("decimal(38,0)")
    twice = 2 * F.abs(rest)
    up = (twice > F.abs(s)) | ((twice == F.abs(s)) & (quotient % 2 != 0))
    return (quotient + F.when(up, F.signum(v).cast("int") * F.signum(s).cast("int")).otherwise(0)).cast("decimal(38,0)")


def multiply(a: Column | str | int, rate: Column | str | int) -> Column:
    """Units times a rate in units, half to even; null beyond 64 bits.

    Both are split at the scale, so that 64-bit integers do: whole x rate + part x whole + part x part / scale. All terms have the sign of the product, so none is beyond 64 bits unless it is.
    """
    a, rate = _col(a).cast("bigint"), _col(rate).cast("bigint")
    of = lambda x: (F.call_function("div", x, F.lit(SCALE)), x % SCALE)
    (whole, part), (rate_whole, rate_part) = of(a), of(rate)
    small = part * rate_part
    quotient, rest = of(small)
    cut = F.try_add(F.try_add(F.try_multiply(whole, rate), part * rate_whole), quotient)
    twice = 2 * F.abs(rest)
    up = (twice > SCALE) | ((twice == SCALE) & (cut % 2 != 0))
    return F.when(up, F.try_add(cut, F.signum(small).cast("bigint"))).otherwise(cut)


def divide(a: Column | str | int, b: Column | str | int) -> Column:
    """Units by units, as a rate in units."""
    return in_range(divide_half_even(wide(a) * F.lit(SCALE).cast("decimal(10,0)"), wide(b)))


def add(a: Column | str, b: Column | str) -> Column:
    return F.try_add(_col(a), _col(b)).try_cast("bigint")


def subtract(a: Column | str, b: Column | str, signed: bool = True) -> Column:
    """Difference; unless ``signed``, null where it is below zero."""
    difference = F.try_subtract(_col(a), _col(b)).try_cast("bigint")
    return difference if signed else F.when(difference >= 0, difference)


def negate(a: Column | str) -> Column:
    return subtract(F.lit(0), a)


def absolute(a: Column | str) -> Column:
    return F.when(_col(a) < 0, negate(a)).otherwise(_col(a).try_cast("bigint"))


def sign(a: Column | str) -> Column:
    return F.signum(_col(a).cast("decimal(20,0)")).cast("int")


def on_grid(a: Column | str, step: Column | str | int) -> Column:
    """Whether a value is a whole multiple of a positive step."""
    return F.when(_col(step) > 0, _col(a) % _col(step) == 0).otherwise(F.lit(False))


def parsed(text: Column | str, signed: bool = True) -> Column:
    """A strict decimal text ([+-]digits[.digits]) as a struct of error (syntax, precision: a digit other than zero past the 8th, range, negative; or null) and units (null with an error).

    The text is looked at once: what both fields need is bound by a lambda, so no part of it is evaluated again for the other.
    """
    t = _col(text)
    point = F.instr(t, ".")
    exact = F.when(point > 0, F.substr(t, F.lit(1), point + 8)).otherwise(t).try_cast("decimal(38,8)")
    wide_units = (exact * F.lit(SCALE).cast("decimal(10,0)")).cast("decimal(38,0)")
    good = F.coalesce(t.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), F.lit(False))
    seen = F.struct(good.alias("good"), t.rlike(r"\.[0-9]{8}[0-9]*[1-9]").alias("deep"), F.when(good, wide_units).alias("units"))

    def judge(v: Column) -> Column:
        u = v["units"]
        error = F.when(~v["good"], SYNTAX).when(v["deep"], PRECISION).when(u.isNull() | (u < F.lit(LEAST)) | (u > F.lit(MOST)), RANGE)
        return F.struct((error if signed else error.when(u < 0, NEGATIVE)).alias("error"), u.alias("units"))

    def close(v: Column) -> Column:
        return F.struct(v["error"].alias("error"), F.when(v["error"].isNull(), v["units"].cast("bigint")).alias("units"))

    return F.transform(F.transform(F.array(seen), judge), close)[0]


def unsigned(read: Column) -> tuple[Column, Column]:
    """(error, units) of what ``parsed`` has read, for kinds that can't be below zero."""
    return F.coalesce(read["error"], F.when(read["units"] < 0, NEGATIVE)), F.when(read["units"] >= 0, read["units"])


def parse_error(text: Column | str, signed: bool = True) -> Column:
    """Why a text is no decimal of this kind, or null."""
    return parsed(text, signed)["error"]


def parse(text: Column | str, signed: bool = True) -> Column:
    """Units of a strict decimal text; null where ``parse_error`` has a reason."""
    return parsed(text, signed)["units"]


def text_of(units: Column | str) -> Column:
    """Canonical text: no trailing zeros, and zero without a sign."""
    u = _col(units)
    digits = F.ltrim(u.cast("string"), F.lit("-"))
    padded = F.when(F.length(digits) < 9, F.lpad(digits, 9, "0")).otherwise(digits)
    places, whole = F.when(u % SCALE == 0, 0), F.length(padded) - 8
    for i in range(1, 8):
        places = places.when(u % 10 ** (8 - i) == 0, i)
    places = places.otherwise(8)
    return F.concat(F.when(u < 0, "-").otherwise(""), F.substr(padded, F.lit(1), whole), F.when(places > 0, F.concat(F.lit("."), F.substr(padded, whole + 1, places))).otherwise(""))


def money(amount: Column | str, currency: Column | str) -> Column:
    """amount and currency, or null where the currency isn't 3 to 5 capital letters."""
    return F.when(_col(currency).rlike("^[A-Z]{3,5}$") & _col(amount).isNotNull(), F.struct(_col(amount).alias("amount"), _col(currency).alias("currency")))


def money_add(a: Column, b: Column, sign_of_b: int = 1) -> Column:
    """Sum (or difference) of two amounts of one currency; null otherwise."""
    total = add(a["amount"], b["amount"]) if sign_of_b > 0 else subtract(a["amount"], b["amount"])
    return F.when((a["currency"] == b["currency"]) & total.isNotNull(), F.struct(total.alias("amount"), a["currency"].alias("currency")))


def money_convert(a: Column, to: Column | str, rate: Column | str) -> Column:
    converted = multiply(a["amount"], rate)
    return F.when(converted.isNotNull(), F.struct(converted.alias("amount"), (F.lit(to) if isinstance(to, str) else to).alias("currency")))


def money_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 for two amounts of one currency; null otherwise."""
    return F.when(a["currency"] == b["currency"], F.when(a["amount"] < b["amount"], -1).when(a["amount"] > b["amount"], 1).otherwise(0))


def money_negate(a: Column) -> Column:
    return F.when(negate(a["amount"]).isNotNull(), F.struct(negate(a["amount"]).alias("amount"), a["currency"].alias("currency")))


def money_absolute(a: Column) -> Column:
    return F.when(absolute(a["amount"]).isNotNull(), F.struct(absolute(a["amount"]).alias("amount"), a["currency"].alias("currency")))


def money_error(a: Column, b: Column) -> Column:
    """Why two amounts can't be put together: a missing currency or amount, two currencies, or a sum beyond 64 bits; or null."""
    return F.when(a.isNull() | b.isNull(), "missing").when(a["currency"] != b["currency"], "mismatch").when(add(a["amount"], b["amount"]).isNull(), RANGE)
