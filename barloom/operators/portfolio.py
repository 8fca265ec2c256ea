"""Portfolios of accounts: rate checks, equity in one currency, exposure; and checks of account snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decimals as dec

COMPLETE, INCOMPLETE = "complete", "incomplete"
TERMINAL = ("filled", "canceled", "rejected", "expired")


def rate_errors(rates: DataFrame, portfolios: DataFrame) -> DataFrame:
    """Rates (portfolio_id, from_currency, to_currency, rate, as_of) with error: what makes one unusable for its portfolio (base_currency, as_of), or null. None may be from after the portfolio."""
    n = rates.groupBy("portfolio_id", "from_currency").agg(F.count("*").alias("_n"))
    base = portfolios.select("portfolio_id", "base_currency", F.col("as_of").alias("_as_of"))
    valid = lambda c: F.coalesce(F.col(c).rlike("^[A-Z]{3,5}$"), F.lit(False))
    error = (
        F.when(~valid("from_currency"), "from").when(~valid("to_currency") | (F.col("to_currency") != F.col("base_currency")), "to").when(F.col("from_currency") == F.col("base_currency"), "from_is_base")
        .when(~F.coalesce(F.col("rate") > 0, F.lit(False)), "rate").when(F.col("as_of").isNull(), "as_of").when(F.col("as_of") > F.col("_as_of"), "look_ahead").when(F.col("_n") > 1, "duplicate")
    )
    return rates.join(base, "portfolio_id").join(n, ["portfolio_id", "from_currency"]).select(*rates.columns, error.alias("error"))


def converted(accounts: DataFrame, portfolios: DataFrame, rates: DataFrame) -> DataFrame:
    """Accounts (portfolio_id, account_id, currency, equity, as_of) with base_currency, rate, and value in the base currency (null without a rate)."""
    good = rates.select("portfolio_id", F.col("from_currency").alias("currency"), "rate")
    joined = accounts.join(portfolios.select("portfolio_id", "base_currency"), "portfolio_id").join(good, ["portfolio_id", "currency"], "left")
    base = F.col("currency") == F.col("base_currency")
    return joined.withColumn("value", F.when(base, F.col("equity")).otherwise(dec.multiply("equity", "rate"))).withColumn("needs_rate", ~base)


def equity(accounts: DataFrame, portfolios: DataFrame, rates: DataFrame) -> DataFrame:
    """Per portfolio: status and equity in its base currency; equity is null unless every account could be converted."""
    each = converted(accounts, portfolios, rates)
    lacking = F.count_if(F.col("needs_rate") & F.col("rate").isNull())
    total = dec.in_range(F.sum(F.col("value").cast("decimal(20,0)")))
    return each.groupBy("portfolio_id").agg(F.when(lacking == 0, COMPLETE).otherwise(INCOMPLETE).alias("status"), F.when(lacking == 0, total).alias("equity"), F.count("*").alias("accounts"))


def missing_currencies(accounts: DataFrame, portfolios: DataFrame, rates: DataFrame) -> DataFrame:
    """Currencies without a rate per portfolio, with the first account (by id) that has it."""
    each = converted(accounts, portfolios, rates)
    return each.where(F.col("needs_rate") & F.col("rate").isNull()).groupBy("portfolio_id", "currency").agg(F.min("account_id").alias("first_account"))


def rates_used(accounts: DataFrame, portfolios: DataFrame, rates: DataFrame) -> DataFrame:
    """Rates that entered each complete portfolio's equity; none of an incomplete one's."""
    each = converted(accounts, portfolios, rates)
    whole = equity(accounts, portfolios, rates).where(F.col("status") == COMPLETE).select("portfolio_id")
    return each.where("needs_rate AND rate IS NOT NULL").select("portfolio_id", "currency", "rate").distinct().join(whole, "portfolio_id", "left_semi")


def as_of_range(accounts: DataFrame) -> DataFrame:
    return accounts.groupBy("portfolio_id").agg(F.min("as_of").alias("oldest"), F.max("as_of").alias("newest"))


def exposure(positions: DataFrame) -> DataFrame:
    """Positions (account_id, instrument_id, side, quantity) as rows with contributors: how many there are of their instrument. Nothing is netted, and no instrument's positions are gathered."""
    count = positions.groupBy("instrument_id").agg(F.count("*").alias("contributors"))
    return positions.select("instrument_id", "account_id", "side", "quantity").join(count, "instrument_id")


def contributors(positions: DataFrame) -> DataFrame:
    """Per instrument all its contributors as one array, in order: for instruments that few accounts hold."""
    return positions.groupBy("instrument_id").agg(F.array_sort(F.collect_list(F.struct("account_id", "side", "quantity"))).alias("contributors"))


def exposure_totals(positions: DataFrame) -> DataFrame:
    """Per instrument and side: accounts and quantity. Partial sums are shuffled."""
    return positions.groupBy("instrument_id", "side").agg(F.count("*").alias("contributors"), dec.in_range(F.sum(dec.wide("quantity"))).alias("quantity"))


# The amounts that every snapshot has.
MONEYS = ("equity", "buying_power", "margin_used", "margin_available", "realized_pnl", "unrealized_pnl", "fees", "financing")


def snapshot_errors(snapshots: DataFrame, balances: DataFrame, positions: DataFrame, orders: DataFrame) -> DataFrame:
    """Rules that account snapshots break: account_id, rule, n.

    ``snapshots`` (account_id, broker, currency, as_of, moneys: array of (name, amount, currency), which must hold every one of ``MONEYS``); ``balances`` (account_id, currency, amount);
    ``positions`` and ``orders`` (account_id: of the snapshot; owner: their own account; provider, listing; orders also order_id, status).
    """
    plain = snapshots.select(
        "account_id",
        F.explode(
            F.filter(
                F.array(
                    F.when(F.col("broker").isNull() | (F.col("broker") == ""), "broker"), F.when(~F.coalesce(F.col("currency").rlike("^[A-Z]{3,5}$"), F.lit(False)), "currency"), F.when(F.col("as_of").isNull(), "as_of")
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("rule"),
    )
    given = snapshots.select("account_id", "currency", F.explode("moneys").alias("m")).where(F.col("m.amount").isNull() | ~F.col("m.currency").eqNullSafe(F.col("currency"))).select("account_id", F.col("m.name").alias("_m"))
    named = F.coalesce(F.transform("moneys", lambda m: m["name"]), F.array().cast("array<string>"))
    absent = snapshots.select("account_id", F.explode(F.array_except(F.array(*map(F.lit, MONEYS)), named)).alias("_m"))
    money = given.unionByName(absent).select("account_id", F.concat(F.lit("money_"), "_m").alias("rule"))
    cash = balances.groupBy("account_id", "currency").count().where("count > 1").select("account_id", F.lit("cash_duplicate").alias("rule"))
    broker = snapshots.select("account_id", F.lower("broker").alias("_b"))

    def belonging(rows: DataFrame, name: str) -> DataFrame:
        joined = rows.join(broker, "account_id")
        owner = joined.where(F.col("owner") != F.col("account_id")).select("account_id", F.lit(f"{name}_account").alias("rule"))
        return owner.unionByName(joined.where(F.lower("provider") != F.col("_b")).select("account_id", F.lit(f"{name}_provider").alias("rule")))

    twice = positions.groupBy("account_id", "listing").count().where("count > 1").select("account_id", F.lit("position_duplicate").alias("rule"))
    again = orders.groupBy("account_id", "order_id").count().where("count > 1").select("account_id", F.lit("order_duplicate").alias("rule"))
    ended = orders.where(F.col("status").isin(*TERMINAL)).select("account_id", F.lit("order_terminal").alias("rule"))
    every = plain
    for part in (money, cash, belonging(positions, "position"), belonging(orders, "order"), twice, again, ended):
        every = every.unionByName(part)
    return every.groupBy("account_id", "rule").agg(F.count("*").alias("n"))


def position_error() -> Column:
    """The first rule that a position breaks, or null: flat ones have no quantity and price, others have both."""
    flat = F.col("side") == "flat"
    return (
        F.when(F.col("account_id").isNull(), "account").when(F.col("instrument_id").isNull(), "listing").when(~F.coalesce(F.col("side").isin("flat", "long", "short"), F.lit(False)), "side")
        .when(flat & (F.col("quantity") != 0), "flat_quantity").when(flat & F.col("avg_price").isNotNull(), "flat_price").when(~flat & ~F.coalesce(F.col("quantity") > 0, F.lit(False)), "quantity").when(~flat & F.col("avg_price").isNull(), "price")
    )
