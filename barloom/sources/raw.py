"""Raw candle archives: SYMBOL/YYYY/MM/SYMBOL-YYYY-MM-interval.csv, read once per file into rows and a fingerprint."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import decimals as dec
from ..operators import inventory
from .shared import settle

# The header and comment of a raw file, the pairs in scope, and how flags may be spelt.
HEADER = "time,bid_o,bid_h,bid_l,bid_c,ask_o,ask_h,ask_l,ask_c,volume,complete"
SCHEMA_TAG = "raw-v1"
PAIRS = (
    "AUDCAD AUDCHF AUDJPY AUDNZD AUDUSD CADJPY CHFJPY EURAUD EURCAD EURCHF EURGBP EURJPY EURNZD EURUSD GBPAUD GBPCAD GBPJPY GBPNZD GBPUSD NZDJPY NZDUSD USDCAD USDCHF USDJPY"
).split()
TRUE, FALSE = ("1", "t", "T", "TRUE", "true", "True"), ("0", "f", "F", "FALSE", "false", "False")

PROVIDER = "oanda"
PRICES = ("bid_o", "bid_h", "bid_l", "bid_c", "ask_o", "ask_h", "ask_l", "ask_c")
#: Rows without an error that are spelt the usual way: a day that is in the calendar, UTC, up to ten digits before a point and eight after it, a volume of up to 18 digits. Others may be as good, but need a closer look.
_DAY = r"(?:(?:0[1-9]|1[0-2])-(?:0[1-9]|1\d|2[0-8])|(?:0[13-9]|1[0-2])-(?:29|30)|(?:0[13578]|1[02])-31)"
_ROW = rf"[12]\d{{3}}-{_DAY}T(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:Z|[+-]00:00)(?:,\d{{1,10}}+(?:\.\d{{1,8}}+)?+){{8}}+,\d{{1,18}}+,(?:{'|'.join((*TRUE, *FALSE))})"
PLAIN = rf"^{_ROW}\z"
#: Two plain rows or more that follow each other in a file. Its loops are possessive, so a file of any length is met without recursion.
RUN = rf"(?<![^\n])({_ROW}(?=\r?\n|\z))(?:\r?\n{_ROW}(?=\r?\n|\z))++"
TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def utc_time(text: Column) -> Column:
    """An RFC 3339 time as UTC TIMESTAMP_NTZ, or null; fractions beyond microseconds are cut."""
    plain = F.regexp_replace(F.regexp_extract(text, r"^(.{19}(\.\d{1,6})?)", 1), "T", " ").try_cast("timestamp_ntz")
    sign = F.when(F.regexp_extract(text, r"([+-])\d{2}:\d{2}$", 1) == "-", -1).otherwise(1)
    h, m = F.regexp_extract(text, r"[+-](\d{2}):\d{2}$", 1), F.regexp_extract(text, r"[+-]\d{2}:(\d{2})$", 1)
    offset = F.make_dt_interval(F.lit(0), sign * F.coalesce(h.try_cast("int"), F.lit(0)), sign * F.coalesce(m.try_cast("int"), F.lit(0)))
    return F.when(text.rlike(TIME), plain - offset)


def file_fields(path: Column, root: str | None = None) -> dict[str, Column]:
    """symbol, interval, year, month from a path, and file_error: malformed, out_of_scope, unsupported_interval or layout.

    A file lies at SYMBOL/YYYY/MM/name, just below ``root`` (as ``qualified`` spells it): what lies deeper or elsewhere is no part of the archive. Without ``root`` the last four parts count.
    """
    parts = F.split(F.when(F.startswith(path, F.lit(f"{root}/")), F.substr(path, F.lit(len(root) + 2))).otherwise("") if root else path, "/")
    name = F.element_at(F.split(path, "/"), -1)
    shape = r"^([A-Z]{6})-(\d{4})-(\d{2})-([a-z0-9]+)\.csv$"
    part = lambda i: F.regexp_extract(name, shape, i)
    interval = F.when(part(4) == "d", "d1").otherwise(part(4))
    layout = (F.try_element_at(parts, F.lit(-4)) == part(1)) & (F.try_element_at(parts, F.lit(-3)) == part(2)) & (F.try_element_at(parts, F.lit(-2)) == part(3))
    if root:
        layout = layout & (F.size(parts) == 4)
    error = (
        F.when(~name.rlike(shape) | ~part(3).cast("string").rlike("^(0[1-9]|1[0-2])$"), "malformed").when(~part(1).isin(*PAIRS), "out_of_scope").when(~interval.isin("m1", "h1", "h4", "d1"), "unsupported_interval")
        .when(~F.coalesce(layout, F.lit(False)), "layout")
    )
    return {"provider": F.lit(PROVIDER), "symbol": part(1), "interval": interval, "year": part(2).try_cast("int"), "month": part(3).try_cast("int"), "file_error": error}


def comment_error(comment: Column) -> Column:
    """'comment' where a ``# schema=raw-v1 ...`` line disagrees with the file's name; other comments don't count."""
    said = F.str_to_map(F.trim(F.regexp_replace(comment, r"^#\s*", "")), F.lit(" +"), F.lit("="))

    def judge(m: Column) -> Column:
        interval = F.when(m["tf"] == "d", "d1").otherwise(m["tf"])
        agrees = (m["instrument"] == F.col("symbol")) & (interval == F.col("interval")) & (m["year"].try_cast("int") == F.col("year")) & (m["month"].try_cast("int") == F.col("month"))
        return F.when((m["schema"] == SCHEMA_TAG) & ~F.coalesce(agrees, F.lit(False)), "comment")

    return F.transform(F.array(said), judge)[0]


def _is_row(line: Column) -> Column:
    """Neither blank nor a comment."""
    return ~line.rlike(r"^\s*(#.*)?$")


def parse_files(files: DataFrame, root: str | None = None) -> DataFrame:
    """``files`` (path, content) below ``root`` with name fields, fingerprint, file_status (ok, malformed or skipped), file_error, lines (line_no, line) and their number, line_count.

    Fingerprint and lines come from one read of the bytes. A file is malformed where its header or comment is wrong, or some row is. A run of plain rows has no error that its first row hasn't, so errors are looked for, and rows counted, in
    the file with its runs cut down to one row each; the lines that are gone are added.
    """
    named = files.select("path", "content").withColumns(file_fields(F.col("path"), root))
    text, split = F.col("content").cast("string"), lambda t: F.split(t, "\r?\n")
    numbered = F.transform(split(text), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line")))
    lines = F.slice(F.filter(numbered, lambda x: _is_row(x["line"])), 2, 10**9)
    out = named.withColumns({"fingerprint": F.concat(F.lit("sha256:"), F.sha2("content", 256)), "lines": lines, "_text": text, "_split": split(F.when(F.col("file_error").isNull(), F.regexp_replace(text, RUN, "$1")).otherwise(text))})
    out = out.withColumns({"_lines": F.filter("_split", _is_row), "_comments": F.filter("_split", lambda x: x.startswith("#"))})
    wrong = F.exists("_comments", lambda c: comment_error(c).isNotNull())
    header = F.coalesce(F.try_element_at("_lines", F.lit(1)) != HEADER, F.lit(True))
    bad_row = F.exists(F.slice("_lines", 2, 10**9), lambda x: row_error(x).isNotNull())
    count = F.size("_lines") + F.size(F.split("_text", "\n")) - F.size("_split")
    out = out.withColumns({"_error": F.coalesce("file_error", F.when(header, "header"), F.when(wrong, "comment"), F.when(bad_row, "row")), "line_count": F.when(count > 0, count - 1).otherwise(count)})
    status = F.when(F.col("file_error").isNotNull(), "skipped").when(F.col("_error").isNotNull(), "malformed").otherwise("ok")
    return out.withColumns({"file_status": status, "file_error": F.col("_error")}).drop("content", "_text", "_split", "_lines", "_comments", "_error")


def _fields(line: Column) -> Column:
    return F.split(line, ",", -1)


def row_error(line: Column) -> Column:
    """What is wrong with a row, or null: fields, time, price, volume, flag. Only rows that aren't plain are looked at field by field."""
    return F.when(~line.rlike(PLAIN), _error_in(line))


def _error_in(line: Column) -> Column:
    f = _fields(line)
    prices = F.lit(False)
    for i in range(1, 9):
        prices = prices | dec.parse_error(F.get(f, i), signed=False).isNotNull()
    return (
        F.when(F.size(f) != 11, "fields").when(utc_time(F.get(f, 0)).isNull(), "time").when(prices, "price").when(~F.get(f, 9).rlike(r"^[+-]?\d+$") | F.get(f, 9).try_cast("bigint").isNull(), "volume")
        .when(~F.get(f, 10).isin(*TRUE, *FALSE), "flag")
    )


def qualified(spark: SparkSession, root: str) -> str:
    """``root`` as Spark spells the paths below it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def _load(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(list(paths))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """All files under ``root``: one row per file (a month is a few MB), with its lines."""
    return parse_files(_load(spark, root), qualified(spark, root))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """All files under ``root`` without reading them: path, length, modified, name fields and file_error."""
    files = _load(spark, root).select("path", "length", F.col("modificationTime").alias("modified"))
    return files.withColumns(file_fields(F.col("path"), qualified(spark, root)))


#: So many files are asked for by name; of more, all those are read that were modified since the oldest of them.
MOST_PATHS = 1000


def read_some(spark: SparkSession, root: str, wanted: DataFrame, most: int = MOST_PATHS) -> DataFrame:
    """``scan`` of the files ``wanted`` (path, modified) only. No other file is opened where they are few, or newer than all others."""
    wanted = wanted.select("path", "modified")
    few = [r.path for r in wanted.limit(most + 1).collect()]
    if not few:
        return scan(spark, root).where(F.lit(False))
    if len(few) <= most:
        return parse_files(_load(spark, *few), qualified(spark, root))
    since = wanted.agg(F.min("modified")).first()[0]
    some = _load(spark, root).where(F.col("modificationTime") >= F.lit(since)).join(wanted.select("path"), "path", "left_semi")
    return parse_files(some, qualified(spark, root))


INDEX = (
    "path string, length bigint, modified timestamp, fingerprint string, file_status string, file_error string, row_count bigint, incomplete_rows bigint, first_time timestamp_ntz, last_time timestamp_ntz, last_complete boolean"
)


def known_files(spark: SparkSession, root: str, index: str, months: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, read): what is known of the archive's files (of ``months``: symbol, interval, year, month), and the paths that had to be read for it.

    The archive is listed, and the listing met with the table ``index`` of what was seen before: only files that are new, or of another length or time of modification, are read, and then added to the index. ``files`` has the name fields, path,
    length, modified, fingerprint, file_status, file_error, and of readable ones row_count, incomplete_rows, first_time, last_time and last_complete. Files outside the layout are left out. A file that changes within the same
    millisecond, at the same length, isn't seen.
    """
    name = ["symbol", "interval", "year", "month"]
    here = listing(spark, root).where("file_error IS NULL").drop("file_error")
    if months is not None:
        here = here.join(months.select(*name).distinct(), name, "left_semi")
    here = settle(here)
    same = ["path", "length", "modified"]
    columns = [c.split()[0] for c in INDEX.split(", ")]
    try:
        seen = spark.read.schema(INDEX).parquet(index)
        fresh = settle(here.join(seen, same, "left_anti").select(*same))
    except AnalysisException:
        fresh = here.select(*same)
    if not fresh.isEmpty():
        parsed = read_some(spark, root, fresh)
        stats = inventory.partitions(records(parsed.where("file_status = 'ok'"), checked=True), ["path"])
        told = parsed.select("path", "fingerprint", "file_status", "file_error").join(stats, "path", "left")
        fresh.join(told, "path").select(*columns).write.mode("append").parquet(index)
    elif here.isEmpty():
        return here.withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in INDEX.split(", ")[3:]}), fresh.select("path")
    # a file that two scans met at once stands twice, with the same content
    latest = spark.read.schema(INDEX).parquet(index).dropDuplicates(same)
    return here.join(latest, same), fresh.select("path")


def records(files: DataFrame, checked: bool = False) -> DataFrame:
    """Rows of ``scan``'s files in file order; raw units, null where a field is bad, with row_error. ``checked``: all files are ok, so there is no error to look for."""
    return _fields_of(files.select("provider", "symbol", "interval", "year", "month", "path", F.explode("lines").alias("l")), checked)


def _fields_of(each: DataFrame, checked: bool = False) -> DataFrame:
    each = each.withColumns({"_plain": F.col("l.line").rlike(PLAIN), "_fields": _fields(F.col("l.line"))})
    f, plain = F.col("_fields"), F.col("_plain")
    # of plain rows a cast says it all
    price = lambda t: F.when(plain, (t.try_cast("decimal(18,8)") * F.lit(dec.SCALE)).try_cast("bigint")).otherwise(dec.parse(t, signed=False))
    columns = {"time": F.when(plain, F.left(F.get(f, 0), F.lit(19)).try_cast("timestamp_ntz")).otherwise(utc_time(F.get(f, 0)))} | {p: price(F.get(f, i + 1)) for i, p in enumerate(PRICES)}
    columns |= {"volume": F.get(f, 9).try_cast("bigint"), "complete": F.when(F.get(f, 10).isin(*TRUE), True).when(F.get(f, 10).isin(*FALSE), False)}
    columns |= {"row_error": F.lit(None).cast("string") if checked else F.when(~plain, _error_in(F.col("l.line")))}
    return each.withColumn("line_no", F.col("l.line_no")).withColumns(columns).drop("l", "_plain", "_fields")


def numbered_lines(spark: SparkSession, root: str) -> DataFrame:
    """path, length, line_no (from 1) and line (bytes, without the line feed) of all files under ``root``, which are cut into splits like any text, however long they are.

    Rows of a split follow each other in their task, so the number of a line is its place in its block and the lines of the blocks before it: lines are counted per block, and only these counts are summed up by file.
    """
    text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(root)
    each = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"), F.col("value").cast("binary").alias("line"))
    blocks = each.groupBy("path", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("path").orderBy("_start")) - F.col("_n")
    return each.join(settle(blocks.withColumn("_before", before).drop("_n")), ["path", "_start"]).select("path", "length", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line_no"), "line")


def fingerprints(lines: DataFrame) -> DataFrame:
    """path and fingerprint of ``numbered_lines``: the hash of each file's bytes, line after line in the task that has the file; nothing but the running hash is held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, digest, seen, size = None, None, 0, 0

        def end() -> tuple[str, str]:
            if seen < size:  # the last line ends with a line feed, too
                digest.update(b"\n")
            return path, f"sha256:{digest.hexdigest()}"

        for pdf in batches:
            done = []
            for own, length, line in zip(pdf["path"], pdf["length"], pdf["line"], strict=True):
                if own != path:
                    if path is not None:
                        done.append(end())
                    path, digest, seen, size = own, hashlib.sha256(line), len(line), length
                else:
                    digest.update(b"\n")
                    digest.update(line)
                    seen += len(line) + 1
            yield pd.DataFrame(done, columns=["path", "fingerprint"])
        if path is not None:
            yield pd.DataFrame([end()], columns=["path", "fingerprint"])

    return lines.repartition("path").sortWithinPartitions("path", "line_no").select("path", "length", "line").mapInPandas(run, "path string, fingerprint string")


def scan_long(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(files, rows) of an archive with files of any length: what ``scan`` and ``records`` say of them, with no file held as a whole. Empty files have no line and aren't seen. Lines are settled once."""
    lines = settle(numbered_lines(spark, root))
    top = qualified(spark, root)
    spelled = F.when(F.startswith("path", F.lit("file:///")), F.concat(F.lit("file:"), F.substr("path", F.lit(8)))).otherwise(F.col("path"))
    text = F.regexp_replace(F.col("line").cast("string"), "\r$", "")
    told = lines.withColumn("path", F.url_decode(F.replace(spelled, F.lit("+"), F.lit("%2B")))).select("path", "line_no", text.alias("line")).withColumns(file_fields(F.col("path"), top)).withColumnRenamed("file_error", "_name_error")
    told = told.withColumn("_kept", ~F.col("line").rlike(r"^\s*(#.*)?$"))
    first = told.where("_kept").groupBy("path").agg(F.min("line_no").alias("_header"))
    told = told.join(first, "path", "left")
    row = F.col("_kept") & (F.col("line_no") > F.col("_header"))
    keys = ["provider", "symbol", "interval", "year", "month"]
    found = told.groupBy("path", *keys, "_name_error").agg(
        F.bool_or(F.col("_kept") & (F.col("line_no") == F.col("_header")) & (F.col("line") == HEADER)).alias("_has"), F.bool_or(F.when(F.startswith("line", F.lit("#")), comment_error(F.col("line")).isNotNull())).alias("_comment"),
        F.bool_or(F.when(row, row_error(F.col("line")).isNotNull())).alias("_row"),
    )
    error = F.coalesce("_name_error", F.when(~F.coalesce("_has", F.lit(False)), "header"), F.when(F.coalesce("_comment", F.lit(False)), "comment"), F.when(F.coalesce("_row", F.lit(False)), "row"))
    status = F.when(F.col("_name_error").isNotNull(), "skipped").when(error.isNotNull(), "malformed").otherwise("ok")
    prints = fingerprints(lines.withColumn("path", F.url_decode(F.replace(spelled, F.lit("+"), F.lit("%2B")))))
    files = found.select("path", *keys, status.alias("file_status"), error.alias("file_error")).join(prints, "path")
    each = told.where(row).select(*keys, "path", F.struct("line_no", "line").alias("l"))
    return files, _fields_of(each)


_SIDE = "struct<o:string,h:string,l:string,c:string>"
CANDLES = f"candles array<struct<complete:boolean,time:string,volume:bigint,bid:{_SIDE},ask:{_SIDE}>>"


def candles(responses: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Provider JSON of candles in column ``body`` to records; row_error where a side is missing or a field is bad."""
    parsed = responses.select(*keys, F.from_json(F.col(body), CANDLES).alias("j")).select(*keys, F.posexplode("j.candles").alias("pos", "c"))
    side = {f"{s}_{k}": dec.parse(F.col(f"c.{s}.{k}"), signed=False) for s in ("bid", "ask") for k in "ohlc"}
    error = F.when(F.col("c.bid").isNull() | F.col("c.ask").isNull(), "side").when(utc_time(F.col("c.time")).isNull(), "time")
    for s in ("bid", "ask"):
        for k in "ohlc":
            error = error.when(dec.parse_error(F.col(f"c.{s}.{k}"), signed=False).isNotNull(), "price")
    return parsed.select(*keys, (F.col("pos") + 1).alias("line_no"), utc_time(F.col("c.time")).alias("time"), *[v.alias(k) for k, v in side.items()], F.col("c.volume").alias("volume"), F.col("c.complete").alias("complete"), error.alias("row_error"))


LEGACY = "Timestamp bigint, Open bigint, High bigint, Low bigint, Close bigint, avgspread bigint, maxspread bigint, ticks bigint, flags string"


def legacy_candles(spark: SparkSession, path: str) -> DataFrame:
    """Candles of the earlier format: epoch seconds and integer prices at five decimals; comments, header and unreadable rows are left out."""
    rows = spark.read.schema(LEGACY).option("comment", "#").option("mode", "DROPMALFORMED").csv(path)
    at = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("Timestamp").cast("decimal(18,6)"))
    return rows.where("Timestamp IS NOT NULL AND Close IS NOT NULL").select(at.alias("time"), *[(F.col(c) * 1000).alias(c.lower()) for c in ("Open", "High", "Low", "Close")], "ticks")
