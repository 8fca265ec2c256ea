"""WARC archives of pages: write them, normalise whole-file gzip streams to a member per record, read records by offset."""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, shared_dir

#: Payloads below this are never deduplicated.
LEAST_SHARED = 100
ARCHIVE_BYTES = 64 << 20
#: A task reads about so many bytes of archives back.
SLICE_BYTES = 16 << 20
#: Shared digests are broadcast up to so many (some 32 MB); beyond it those of at least ``HOT`` rows are, which are at most one in ``HOT`` of all rows, and the others are joined by digest.
FEW, HOT = 400_000, 10_000
READ_BYTES = 1 << 20
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that can't be read as WARC."""


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, uncompressed. A revisit holds the HTTP head only."""
    block = HTTP_HEAD + (payload if kind == "response" else b"")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {url}')}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", " ".join((url or "urn:none").split())),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Payload-Length", len(payload)),
        *([("X-Page-Id", page_id)] if page_id is not None else []),
        *([("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page-Id", refers_to)] if kind == "revisit" else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """The fields (lower-case names) and block of one whole record."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise WarcError("no record here")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if len(rest) < n:
        raise WarcError("record is cut short")
    return fields, rest[:n]


def split_stream(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records out of an inflated stream, one after the other; holds one record and one chunk."""
    held = bytearray()
    wanted = None
    for chunk in chunks:
        held += chunk
        while True:
            if wanted is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                names = bytes(held[:end]).lower().split(b"\r\n")
                if not names[0].startswith(b"warc/"):
                    raise WarcError("no record here")
                size = next((int(x.partition(b":")[2]) for x in names if x.startswith(b"content-length:")), None)
                if size is None:
                    raise WarcError("no content length")
                wanted = end + 4 + size + 4
            if len(held) < wanted:
                break
            yield bytes(held[:wanted])
            del held[:wanted]
            wanted = None
    if held.strip():
        raise WarcError("last record is cut short")


def inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """A gzip file of any number of members, inflated once from front to back."""
    member = zlib.decompressobj(31)
    for chunk in chunks:
        while chunk:
            yield member.decompress(chunk)
            chunk = member.unused_data
            if member.eof:
                member = zlib.decompressobj(31)
            elif not chunk:
                break


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _chunks(source) -> Iterator[bytes]:
    while data := source.read(READ_BYTES):
        yield data


def mark_revisits(pages: DataFrame, least: int = LEAST_SHARED, few: int = FEW, hot: int = HOT) -> DataFrame:
    """``pages`` (page_id, url, html) with payload, digest, record_type and refers_to.

    Of equal payloads of at least ``least`` bytes the one with the smallest page_id is the response; a repeated row of that page is
    a response as well. Rows without page_id revisit it too, and never are its response. Null html is an empty payload. Digests are shuffled;
    payloads are only where more than ``few`` digests are shared, and then no digest of ``hot`` or more rows.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    shared = settle(
        rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where((F.col("n") > 1) & F.col("first").isNotNull())
    )
    if shared.count() <= few:
        joined = rows.join(F.broadcast(shared.drop("n")), "digest", "left")
    else:
        often = shared.where(F.col("n") >= hot).select("digest", F.col("first").alias("often"))
        seldom = shared.where(F.col("n") < hot).select("digest", F.col("first").alias("seldom"))
        dealt = rows.join(F.broadcast(often), "digest", "left")
        # rows of hot digests need no join: they are dealt by page instead
        own = F.when(F.col("often").isNull(), F.col("digest")).otherwise(F.concat_ws(" ", F.lit("page"), "page_id", "url"))
        joined = dealt.withColumn("own", own).join(seldom.withColumnRenamed("digest", "own"), "own", "left").withColumn("first", F.coalesce("often", "seldom"))
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", F.when(other, "revisit").otherwise("response").alias("record_type"), F.when(other, F.col("first")).alias("refers_to"))


def write_archives(marked: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the rows of ``mark_revisits`` as .warc.gz files under ``folder``, each one gzip stream, and return their paths.

    Names are new for each attempt of a task; only those of attempts that succeed are returned.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _filesystem(folder)
        system.create_dir(root, recursive=True)
        name, sink, gz, size = "", None, None, 0

        def close() -> pd.DataFrame:
            tail = gz.flush()
            sink.write(tail)
            sink.close()
            return pd.DataFrame({"archive": [f"{folder}/{name}"]})

        for pdf in batches:
            for page_id, url, payload, digest, kind, to in pdf.itertuples(index=False):
                if sink is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    sink, gz, size = system.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(LEVEL, wbits=31), 0
                data = record(kind, int(page_id) if page_id else None, url, bytes(payload), digest, int(to) if to else None)
                size += len(data)
                sink.write(gz.compress(data))
                if size >= archive_bytes:
                    yield close()
                    sink = None
        if sink is not None:
            yield close()

    # ids travel as text: pandas would turn a long column with nulls to floats
    rows = marked.select(F.col("page_id").cast("string"), "url", "payload", "digest", "record_type", F.col("refers_to").cast("string"))
    return rows.mapInPandas(run, "archive string")


def normalise(archives: DataFrame) -> DataFrame:
    """Rewrite each ``archive`` (path to .warc.gz, whole-file stream or members) with a gzip member per record.

    Next to each new file a sidecar ``.idx`` has a line "offset length" per record. Returns the index as rows (archive, offset, length).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["archive"]:
                system, own = _filesystem(path)
                to = f"{own.removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}"
                offsets, lengths, at = [], [], 0
                with system.open_input_stream(own, compression=None) as source, system.open_output_stream(f"{to}.warc.gz", compression=None) as sink:
                    for data in split_stream(inflate(_chunks(source))):
                        member = gzip.compress(data, LEVEL, mtime=0)
                        sink.write(member)
                        offsets.append(at)
                        lengths.append(len(member))
                        at += len(member)
                with system.open_output_stream(f"{to}.warc.gz.idx", compression=None) as sink:
                    sink.write("".join(f"{o} {n}\n" for o, n in zip(offsets, lengths, strict=True)).encode())
                scheme = path.removesuffix(own)
                yield pd.DataFrame({"archive": f"{scheme}{to}.warc.gz", "offset": offsets, "length": lengths})

    # a task for each archive: a number of partitions that is asked for isn't coalesced
    return archives.repartition(max(1, archives.count())).mapInPandas(run, "archive string, offset long, length long")


def read_records(index: DataFrame, payloads: bool = True, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Read the records at ``index`` (archive, offset, length) back, archives in slices of about ``slice_bytes``.

    Returns page_id, url, payload (of responses, if ``payloads``), payload_bytes, payload_digest (computed from the bytes read), named_digest (as the record's header says),
    record_type, refers_to. Of a revisit payload_bytes and payload_digest are null: ``resolve`` finds them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, source = None, None
        for pdf in batches:
            rows = []
            for archive, offset, length in pdf[["archive", "offset", "length"]].itertuples(index=False):
                if archive != path:
                    system, own = _filesystem(archive)
                    path, source = archive, system.open_input_file(own)
                fields, block = parse_record(gzip.decompress(source.read_at(length, offset)))
                payload = block.partition(b"\r\n\r\n")[2]
                whole = fields["warc-type"] == "response"
                read = (payload if payloads else None, len(payload), hashlib.sha256(payload).hexdigest()) if whole else (None, None, None)
                named = fields["warc-payload-digest"].partition(":")[2]
                rows.append((fields.get("x-page-id"), fields.get("warc-target-uri"), *read, named, fields["warc-type"], fields.get("x-refers-to-page-id")))
            found = pd.DataFrame(rows, columns=["page_id", "url", "payload", "payload_bytes", "payload_digest", "named_digest", "record_type", "refers_to"])
            yield found.astype({"payload_bytes": "Int64"})

    sliced = index.withColumn("slice", F.floor(F.col("offset") / slice_bytes))
    slices = sliced.select("archive", "slice").distinct().count()
    dealt = sliced.repartition(max(1, slices), "archive", "slice").sortWithinPartitions("archive", "offset")
    found = dealt.mapInPandas(run, "page_id string, url string, payload binary, payload_bytes long, payload_digest string, named_digest string, record_type string, refers_to string")
    return found.withColumns({"page_id": F.col("page_id").cast("long"), "refers_to": F.col("refers_to").cast("long")})


def resolve(records: DataFrame, responses: DataFrame) -> DataFrame:
    """``records`` of ``read_records`` with payload_bytes and payload_digest of revisits as read from the response they refer to; null where there is none."""
    named = F.col("named_digest")
    wanted = records.where("record_type = 'revisit'").select("refers_to", named.alias("payload_digest")).distinct()
    read = responses.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes")
    # one row for each response that is referred to, however many revisits it has
    found = settle(read.join(wanted, ["refers_to", "payload_digest"], "left_semi").distinct())
    to = found.select("refers_to", F.col("payload_digest").alias("named_digest"), "payload_digest", "payload_bytes")
    revisits = records.where("record_type = 'revisit'").drop("payload_digest", "payload_bytes").join(to, ["refers_to", "named_digest"], "left")
    return records.where("record_type <> 'revisit'").unionByName(revisits).drop("named_digest")


def archive_pages(pages: DataFrame, folder: str | None = None, payloads: bool = False) -> DataFrame:
    """Write ``pages`` (page_id, url, html; other columns are left out) as archives, normalise them and read every record back: columns of ``read_records``, revisits resolved.

    Null html is an empty payload, null urls read back as "urn:none", repeated rows stay repeated, very long pages are records like any other, an empty table writes nothing.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    archives = settle(write_archives(mark_revisits(pages), folder))
    index = settle(normalise(archives))
    records = settle(read_records(index, False))
    return resolve(read_records(index) if payloads else records, records)
