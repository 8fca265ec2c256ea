"""Identifiers: instruments, symbols, typed ids with embedded time, and redaction of sensitive attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import decimals as dec

# Prefixes of typed ids, the digits of their base-32 text, and attribute names that are never shown.
ID_KINDS = {"run": "run", "ord": "order", "fil": "fill", "evt": "event", "cor": "correlation", "acc": "account"}
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
SENSITIVE_KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey", "credential", "credentials", "private_key", "privatekey")
REDACTED = "REDACTED"

TYPED_ID = rf"^({'|'.join(ID_KINDS)})_[0-7][0-9A-HJKMNP-TV-Z]{{25}}$"


def _clean(x: Column | str) -> Column:
    return F.upper(F.trim(F.col(x) if isinstance(x, str) else x))


def _symbol(x: Column | str) -> Column:
    c = _clean(x)
    return F.when(c.rlike(r"^[A-Z0-9.-]+$"), c)


def _currency(x: Column | str) -> Column:
    c = _clean(x)
    return F.when(c.rlike("^[A-Z]{3,5}$"), c)


def instrument_id(kind: Column | str, first: Column | str, second: Column | str, contract: Column | str | None = None) -> Column:
    """Canonical instrument text, or null: fx:BASE/QUOTE (two currencies), eq:SYMBOL:VENUE and etf:SYMBOL:VENUE, fut:ROOT:yyyy-MM, cont:ROOT, idx:NAME."""
    k = F.lower(F.col(kind) if isinstance(kind, str) else kind)
    month = F.date_format(F.trunc(F.col(contract) if isinstance(contract, str) else contract, "month"), "yyyy-MM") if contract is not None else F.lit(None).cast("string")
    base, quote, root, venue = _currency(first), _currency(second), _symbol(first), _symbol(second)
    text = (
        F.when((k == "fx") & (base != quote), F.concat(F.lit("fx:"), base, F.lit("/"), quote))
        .when(k.isin("eq", "etf"), F.concat(k, F.lit(":"), root, F.lit(":"), venue))
        .when(k == "fut", F.concat(F.lit("fut:"), root, F.lit(":"), month))
        .when(k.isin("cont", "idx"), F.concat(k, F.lit(":"), root))
    )
    return text


def fx_listing(symbol: Column | str, provider: str) -> Column:
    """Default listing of a six-letter FX symbol, or null: ticks of 0.00001 (0.001 against JPY), increment and multiplier 1, settled in the quote currency."""
    s = _clean(symbol)
    quote = F.substring(s, 4, 3)
    tick = F.when(quote == "JPY", 100_000).otherwise(1_000).cast("bigint")
    one = F.lit(dec.SCALE).cast("bigint")
    fields = F.struct(
        F.concat(F.lit("fx:"), F.substring(s, 1, 3), F.lit("/"), quote).alias("instrument_id"), F.lit(provider).alias("provider"), s.alias("symbol"),
        tick.alias("tick_size"), one.alias("quantity_increment"), one.alias("multiplier"), quote.alias("settlement_currency"),
    )
    return F.when(s.rlike("^[A-Z]{6}$") & (F.substring(s, 1, 3) != quote), fields)


def id_error(value: Column | str) -> Column:
    """Why a text is no typed id, or null: prefix, length, alphabet, overflow (first digit above 7), zero."""
    v = F.col(value) if isinstance(value, str) else value
    tail = F.regexp_extract(v, r"^[a-z]+_(.*)$", 1)
    return (
        F.when(v.isNull() | ~v.rlike(rf"^({'|'.join(ID_KINDS)})_"), "prefix").when(F.length(tail) != 26, "length").when(~tail.rlike(r"^[0-9A-HJKMNP-TV-Z]{26}$"), "alphabet")
        .when(tail.substr(1, 1) > "7", "overflow").when(tail.rlike("^0{26}$"), "zero")
    )


def id_millis(value: Column | str) -> Column:
    """Milliseconds since 1970 in a typed id's first ten digits; null where it is none."""
    v = F.col(value) if isinstance(value, str) else value
    head = F.regexp_extract(v, r"^[a-z]+_(.{10})", 1)
    digits = [F.instr(F.lit(CROCKFORD), head.substr(i, 1)).cast("bigint") - 1 for i in range(1, 11)]
    total = digits[0]
    for d in digits[1:]:
        total = total * 32 + d
    return F.when(id_error(v).isNull(), total)


def redact(attributes: Column | str) -> Column:
    """A map of attributes with the values of sensitive keys replaced, whatever their case."""
    m = F.col(attributes) if isinstance(attributes, str) else attributes
    return F.transform_values(m, lambda k, v: F.when(F.lower(k).isin(*SENSITIVE_KEYS), REDACTED).otherwise(v))
