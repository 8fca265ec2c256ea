"""Instruments and listings: reference-data checks, symbol and instrument resolution, aliases."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settle

RESOLVED, UNKNOWN, AMBIGUOUS = "resolved", "unknown", "ambiguous"
NEVER_TRADABLE = ("cont", "idx")


def listing_error() -> Column:
    """The first rule that a listing breaks, or null."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    bad = lambda c: ~F.coalesce(F.col(c) > 0, F.lit(False))
    return (
        F.when(blank("instrument_id"), "instrument").when(blank("provider"), "provider").when(blank("symbol"), "symbol").when(bad("tick_size"), "tick_size").when(bad("quantity_increment"), "quantity_increment")
        .when(bad("multiplier"), "multiplier").when(~F.coalesce(F.col("settlement_currency").rlike("^[A-Z]{3,5}$"), F.lit(False)), "settlement_currency")
    )


def tradable(listings: DataFrame) -> DataFrame:
    """Listings that can be traded: continuous series and indexes never can."""
    return listings.where(F.col("tradable") & ~F.substring_index("instrument_id", ":", 1).isin(*NEVER_TRADABLE))


def _normal(c: Column) -> Column:
    return F.upper(F.trim(c))


def _named(df: DataFrame, prefix: str, out: str) -> list[Column]:
    return [_normal(F.coalesce(F.col(f"{prefix}{c}"), F.lit(""))).alias(f"{out}{c[0]}") for c in ("provider", "venue", "symbol")]


def _findable(names: DataFrame) -> DataFrame:
    """``names`` (_i, _p, _v, _s, _seq) as they are found: those at a venue (_w) and those at any (_any), of each only the first two by _seq. That tells none, one and several as of any _seq, and however many share a name, who asks meets two."""

    def first_two(df: DataFrame, *by: str) -> DataFrame:
        return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("_seq", "_i", "_v"))).where("_k <= 2").drop("_k")

    at_venue = first_two(names, "_p", "_s", "_v")
    anywhere = first_two(at_venue, "_p", "_s")
    return at_venue.withColumns({"_any": F.lit(False), "_w": F.col("_v")}).unionByName(anywhere.withColumns({"_any": F.lit(True), "_w": F.lit("")}))


def register(listings: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names, errors) after ``aliases`` (seq; alias_provider, alias_venue, alias_symbol; provider, venue or empty, symbol) were registered one after the other by seq.

    An alias finds its listing among the names there are when its turn comes, aliases accepted before it included; it is then a name of that listing, at the listing's own venue. names: instrument_id, p, v, s in normal form, and seq (null for
    listings themselves). errors: seq and why an alias was refused: invalid (no provider or symbol), unresolved, ambiguous, or duplicate (its name is taken at its venue). Refused ones take no part.

    Each round decides, symbol by symbol and in order, all aliases for which every earlier claim to the name they refer to is decided: as many rounds as chains of aliases are long, each settled.
    """
    names = listings.select("instrument_id", *_named(listings, "", ""), F.lit(None).cast("long").alias("seq")).distinct()
    undecided = settle(aliases.select(F.col("seq").cast("long").alias("seq"), *_named(aliases, "alias_", "a"), *_named(aliases, "", "r")))
    names, errors = settle(names), undecided.select("seq", F.lit("").alias("error")).where(F.lit(False))
    outcome = "seq long, ap string, as string, error string, instrument_id string, v string"

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, stopped = None, set(), False
        for pdf in batches:
            out = []
            for seq, p, s, v, able, n, taken, instrument, venue, valid in zip(*(pdf[c].tolist() for c in ("seq", "ap", "as", "av", "able", "n", "taken", "instrument_id", "v", "valid")), strict=True):
                if (p, s) != key:
                    key, held, stopped = (p, s), set(), False
                stopped = stopped or not able
                if stopped:
                    continue
                error = "invalid" if not valid else "unresolved" if not n else AMBIGUOUS if n > 1 else "duplicate" if taken or v in held else ""
                if not error:
                    held.add(venue)
                out.append((seq, p, s, error, None if error else instrument, None if error else venue))
            yield pd.DataFrame(out, columns=["seq", "ap", "as", "error", "instrument_id", "v"])

    while not undecided.isEmpty():
        waits = undecided.groupBy(F.col("ap").alias("rp"), F.col("as").alias("rs")).agg(F.min("seq").alias("_open"))
        able = undecided.join(waits, ["rp", "rs"], "left").withColumn("able", F.col("_open").isNull() | (F.col("seq") <= F.col("_open"))).drop("_open")
        known = names.select(F.col("instrument_id").alias("_i"), F.col("p").alias("_p"), F.col("v").alias("_v"), F.col("s").alias("_s"), F.coalesce("seq", F.lit(-(1 << 62))).alias("_seq"))
        known = settle(_findable(known))
        sought = (F.col("rp") == F.col("_p")) & (F.col("rs") == F.col("_s")) & ((F.col("rv") == "") == F.col("_any")) & (F.col("rv") == F.col("_w")) & (F.col("_seq") < F.col("seq"))
        found = undecided.join(known, sought).groupBy("seq").agg(F.count("*").alias("n"), F.min(F.struct("_i", "_v")).alias("_t"))
        claimed = (F.col("ap") == F.col("_p")) & (F.col("as") == F.col("_s")) & (F.col("av") == F.col("_v")) & (F.col("_seq") < F.col("seq"))
        taken = undecided.join(known.where("NOT _any"), claimed, "left_semi").select("seq", F.lit(True).alias("taken"))
        rows = able.join(found, "seq", "left").join(taken, "seq", "left")
        valid = (F.col("rp") != "") & (F.col("rs") != "")
        rows = rows.select("seq", "ap", "as", "av", "able", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("taken", F.lit(False)).alias("taken"), F.col("_t._i").alias("instrument_id"), F.col("_t._v").alias("v"), valid.alias("valid"))
        decided = settle(rows.repartition("ap", "as").sortWithinPartitions("ap", "as", "seq").mapInPandas(decide, outcome))
        new = decided.where("error = ''").select("instrument_id", F.col("ap").alias("p"), "v", F.col("as").alias("s"), "seq")
        names, errors = names.unionByName(new), errors.unionByName(decided.where("error <> ''").select("seq", "error"))
        undecided = settle(undecided.join(decided.select("seq"), "seq", "left_anti"))
    return names, errors


def alias_errors(listings: DataFrame, aliases: DataFrame) -> DataFrame:
    """Aliases that can't be registered, and why (see ``register``)."""
    return register(listings, aliases)[1]


def resolve_symbols(requests: DataFrame, listings: DataFrame, aliases: DataFrame) -> DataFrame:
    """Each request (request_id, provider, venue or null, symbol) to exactly one instrument, or unknown or ambiguous. Only accepted aliases are names; a request meets two at most. Reference data is left to the planner to broadcast by its size."""
    known = _findable(register(listings, aliases)[0].select(F.col("instrument_id").alias("_i"), F.col("p").alias("_p"), F.col("v").alias("_v"), F.col("s").alias("_s"), F.lit(0).alias("_seq"))).drop("_v", "_seq")
    same = (_normal(F.col("provider")) == F.col("_p")) & (_normal(F.col("symbol")) == F.col("_s")) & (F.col("venue").isNull() == F.col("_any")) & (F.coalesce(_normal(F.col("venue")), F.lit("")) == F.col("_w"))
    found = requests.join(known, same, "left").groupBy("request_id").agg(F.count("_i").alias("_n"), F.min("_i").alias("_one"))
    status = F.when(F.col("_n") == 0, UNKNOWN).when(F.col("_n") > 1, AMBIGUOUS).otherwise(RESOLVED)
    return found.select("request_id", status.alias("status"), F.when(status == RESOLVED, F.col("_one")).alias("instrument_id"))


def resolve_instruments(requests: DataFrame, listings: DataFrame) -> DataFrame:
    """Each request (request_id, instrument_id, provider or null, venue or null) to its one tradable listing, or unknown or ambiguous."""
    known = tradable(listings).select(F.col("instrument_id").alias("_i"), _normal(F.col("provider")).alias("_p"), _normal(F.coalesce("venue", F.lit(""))).alias("_v"), F.col("symbol").alias("_s"))
    same = (F.col("instrument_id") == F.col("_i")) & (F.col("provider").isNull() | (_normal(F.col("provider")) == F.col("_p"))) & (F.col("venue").isNull() | (_normal(F.col("venue")) == F.col("_v")))
    found = requests.join(known, same, "left").groupBy("request_id").agg(F.count("_i").alias("_n"), F.min(F.struct("_p", "_v", "_s")).alias("_one"))
    status = F.when(F.col("_n") == 0, UNKNOWN).when(F.col("_n") > 1, AMBIGUOUS).otherwise(RESOLVED)
    return found.select("request_id", status.alias("status"), F.when(status == RESOLVED, F.col("_one._p")).alias("provider"), F.when(status == RESOLVED, F.col("_one._v")).alias("venue"), F.when(status == RESOLVED, F.col("_one._s")).alias("symbol"))
