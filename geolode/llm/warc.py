r"""WARC archives: written from pages, read back record by record, and assembled into one nested row per capture.

Writing: every page becomes a transaction of three records, request, response (or revisit) and metadata, linked by WARC-Concurrent-To. Of pages with equal
payloads (by SHA-1) the one with the smallest key keeps the payload, and others become revisit records that name its digest and URI. Only digests are
grouped for that, so a payload that a third of all pages share is a few rows a task; pages meet the repeated digests by a broadcast where these are few by measure.
Tasks join their records to archives of ``ARCHIVE_BYTES`` (one record may be larger), each a row, and Spark's text writer puts every row into a file of its own: so
archives go to any file system that Spark can write, are committed as Spark's tasks are, and need no group. A file's last line end is the writer's separator.

Reading: files come whole through Spark's binary reader (up to 2 GB each), plain or gzip, as one member or one a record, and are read as streams by
Content-Length, so nothing inside a payload is taken for a record. A damaged file raises an error that names it.

Assembly: request and metadata records are led to their response through concurrent-to identifiers in either direction and over one step between (metadata
to request to response); then all records of a capture make one row. Records that lead to no response make a row without one. A capture's
request and metadata records are in one row, as the row is what is asked for; payloads of responses move with the join only if they are selected.

Null or empty html is an empty payload, a null or empty url ``about:blank``. Rows with a null key are revisits if a page with a key has their payload, else responses. Rows that repeat
the smallest key and its payload are responses, all others with the payload revisits of it. An empty table gives no archives and no captures. Further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolode.llm.common import few, saved, shared_folder, small_side

#: Bytes of an archive before it is compressed, and of records that a reader hands on at once.
ARCHIVE_BYTES, HANDED = 32 << 20, 4 << 20
VERSION, END = b"WARC/1.1\r\n", b"\r\n\r\n"
#: Fixed values of the format.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAIN, BESIDE = ("response", "revisit", "resource"), ("request", "metadata")
#: The metadata field that holds a page's key.
KEY_FIELD = "page-key"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return b"".join([VERSION, head.encode(), b"Content-Length: %d\r\n\r\n" % len(block), block, END])


def _id(*of: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr(of).encode()).digest()[:16])}>"


def _uri(url: str | None) -> str:
    return quote(url, safe="%/:?#[]@!$&'()*+,;=-._~") if url else "about:blank"


def transaction(key: str | None, url: str | None, payload: bytes, digest: bytes, first_url: str | None, revisit: bool, row: int, date: str) -> Iterator[bytes]:
    """The request, the response or revisit, and the metadata record of a page; row tells repeated pages apart."""
    uri, named = _uri(url), ("WARC-Date", date)
    ids = {kind: _id(kind, key, digest, row) for kind in ("main", *BESIDE)}
    to = [("WARC-Target-URI", uri), ("WARC-Concurrent-To", ids["main"])]
    try:
        parts = urlsplit(uri)
    except ValueError:
        parts = urlsplit("about:blank")
    asked = f"GET {parts.path or '/'}{'?' + parts.query if parts.query else ''} HTTP/1.1\r\nHost: {parts.netloc}\r\n\r\n"
    yield record([("WARC-Type", "request"), ("WARC-Record-ID", ids["request"]), named, *to, ("Content-Type", "application/http; msgtype=request")], asked.encode())
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    more = [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To-Target-URI", _uri(first_url)), ("WARC-Refers-To-Date", date)] if revisit else []
    kind = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", ids["main"]), named, to[0], *more, ("WARC-Payload-Digest", f"sha1:{base32_sha1(digest)}")]
    yield record([*kind, ("Content-Type", "application/http; msgtype=response")], head if revisit else head + payload)
    fields = "" if key is None else f"{KEY_FIELD}: {key}\r\n"
    yield record([("WARC-Type", "metadata"), ("WARC-Record-ID", ids["metadata"]), named, *to, ("Content-Type", "application/warc-fields")], fields.encode())


def decided(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """key, url, payload, digest, revisit (boolean) and first_url (of the page that is revisited) of every page."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    order = F.min(F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"), "url")).alias("first")
    same = rows.filter(F.octet_length("payload") >= least_bytes).select("key", "url", "digest").groupBy("digest").agg(F.count("*").alias("n"), order)
    same = saved(same.filter((F.col("n") > 1) & ~F.col("first.none")).select("digest", F.col("first.key").alias("first_key"), F.col("first.url").alias("first_url")))
    n, urls = same.agg(F.count("*"), F.sum(F.length("first_url"))).first()
    joined = rows.join(small_side(same, 64 * n + 4 * (urls or 0), 1), "digest", "left")
    revisit = F.col("first_key").isNotNull() & ~F.col("key").eqNullSafe(F.col("first_key"))
    return joined.select("key", "url", "payload", "digest", revisit.alias("revisit"), "first_url")


def archives(rows: DataFrame, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """A row per archive, archive, with the records of rows as decided gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _id("info")), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
        archive = lambda: pa.RecordBatch.from_arrays([pa.array([info + b"".join(waiting)], pa.binary())], ["archive"])
        for batch in few(batches):
            for values in zip(*batch.columns, strict=True):
                key, url, payload, digest, revisit, first_url, row = (v.as_py() for v in values)
                for part in transaction(key, url, payload, digest, first_url, revisit, row, date):
                    waiting.append(part)
                    size += len(part)
                if size >= archive_bytes:
                    yield archive()
                    waiting, size = [], 0
        if waiting:
            yield archive()

    given = rows.select(F.col("key").cast("string").alias("key"), "url", "payload", "digest", "revisit", "first_url", F.monotonically_increasing_id().alias("row"))
    return given.mapInArrow(run, "archive binary")


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, compression: str = "gzip", **more: object) -> None:
    """Archives of pages below path, on any file system that Spark writes."""
    whole = archives(decided(pages, key, url, html, least_bytes), **more)
    # the bytes as they are, less the last line end, which the writer adds
    text = F.substring("archive", F.lit(1), F.octet_length("archive") - 1).cast("string").alias("value")
    whole.select(text).write.option("maxRecordsPerFile", 1).option("lineSep", "\n").option("compression", compression).text(path)


RECORD = (
    "archive string, ordinal long, record_id string, type string, concurrent_to array<string>, target_uri string, date string, refers_to_uri string, payload_digest string,"
    " status int, fields map<string,string>, payload binary, payload_bytes long, payload_sha1 string"
)


def _bare(value: str) -> str:
    return value.strip().strip("<>")


def parsed(stream: io.BufferedIOBase) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Header fields (names in lower case) and block of every record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a record doesn't begin with its version")
        headers: list[tuple[str, str]] = []
        while (line := stream.readline()).strip():
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[0] in " \t" and headers:
                headers[-1] = (headers[-1][0], f"{headers[-1][1]} {text.strip()}")
            else:
                name, _, value = text.partition(":")
                headers.append((name.strip().lower(), value.strip()))
        length = int(dict(headers)["content-length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError("a record ends too early")
        yield headers, block


def _row(archive: str, ordinal: int, headers: list[tuple[str, str]], block: bytes) -> dict:
    first = dict(reversed(headers))
    http, payload, status, fields = first.get("content-type", "").startswith("application/http"), block, None, None
    if http:
        head, _, payload = block.partition(END)
        words = head.split(b"\r\n", 1)[0].split()
        status = int(words[1]) if head.startswith(b"HTTP/") and len(words) > 1 and words[1].isdigit() else None
    if first.get("content-type", "").startswith("application/warc-fields"):
        fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").splitlines() if ":" in x)]
    kind, digest = first.get("warc-type"), first.get("warc-payload-digest")
    own = base32_sha1(hashlib.sha1(payload).digest()) if kind in ("response", "resource") else None
    return {
        "archive": archive,
        "ordinal": ordinal,
        "record_id": _bare(first.get("warc-record-id", "")),
        "type": kind,
        "concurrent_to": [_bare(v) for k, v in headers if k == "warc-concurrent-to"],
        "target_uri": first.get("warc-target-uri"),
        "date": first.get("warc-date"),
        "refers_to_uri": first.get("warc-refers-to-target-uri"),
        "payload_digest": digest.partition(":")[2] if digest and ":" in digest else digest,
        "status": status,
        "fields": None if fields is None else dict(fields),
        "payload": payload,
        "payload_bytes": len(payload),
        "payload_sha1": own,
    }


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below path, as RECORD says; digests of responses are computed from what was read."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(RECORD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches, 1):
            name, rows, size = batch.column(0)[0].as_py(), [], 0
            raw = io.BytesIO(batch.column(1)[0].as_py())
            packed = raw.getbuffer()[:2] == b"\x1f\x8b"
            try:
                for k, (headers, block) in enumerate(parsed(gzip.GzipFile(fileobj=raw) if packed else raw)):
                    rows.append(_row(name, k, headers, block))
                    size += len(block)
                    if size >= HANDED or len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
            except (ValueError, KeyError, OSError, EOFError) as e:
                raise ValueError(f"{name} is no whole WARC archive: {e}") from e
            yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORD)


def _leads(records: DataFrame) -> DataFrame:
    """record_id of request and metadata records and anchor, the response that they lead to."""
    beside, main = records.filter(F.col("type").isin(*BESIDE)), records.filter(F.col("type").isin(*MAIN))
    named = F.explode("concurrent_to")
    links = beside.select(F.col("record_id").alias("child"), named.alias("parent")).union(main.select(named.alias("child"), F.col("record_id").alias("parent"))).distinct()
    over = links.select(F.col("child").alias("parent"), F.col("parent").alias("above"))
    anchor = F.coalesce("above", "parent")
    led = links.join(over, "parent", "left").select("child", anchor.alias("anchor")).filter(F.col("anchor") != F.col("child"))
    # a response before anything else that a chain may end at
    sure = main.select(F.col("record_id").alias("anchor"), F.lit(False).alias("loose")).distinct()
    best = F.min(F.struct(F.coalesce("loose", F.lit(True)).alias("loose"), "anchor"))
    return led.join(sure, "anchor", "left").groupBy("child").agg(best["anchor"].alias("anchor"))


def assemble(records: DataFrame) -> DataFrame:
    """A row per capture: capture_id, response (struct; null if there is none), requests and metadata (arrays of structs in the order of the archives).

    Of other kinds of records nothing comes. Records are read several times; pass a saved table, without the payloads if they aren't needed.
    Records that repeat an id (archives read twice) each make a capture with all requests and metadata of that id.
    """
    whole = F.struct(*records.columns)
    main = records.filter(F.col("type").isin(*MAIN)).select(F.col("record_id").alias("id"), whole.alias("response"))
    beside = records.filter(F.col("type").isin(*BESIDE)).join(_leads(records), F.col("record_id") == F.col("child"), "left")
    alone = F.coalesce("anchor", F.element_at("concurrent_to", 1), "record_id")
    light = F.struct("archive", "ordinal", *[c for c in records.columns if c not in ("archive", "ordinal", "fields")], "fields")
    grouped = beside.groupBy(alone.alias("anchor")).agg(_sorted("request", light).alias("requests"), _sorted("metadata", light).alias("metadata"))
    none = F.array().cast(grouped.schema["requests"].dataType)
    joined = main.join(grouped, F.col("id") == F.col("anchor"), "full_outer")
    return joined.select(F.coalesce("id", "anchor").alias("capture_id"), "response", F.coalesce("requests", none).alias("requests"), F.coalesce("metadata", none).alias("metadata"))


def _sorted(kind: str, row: Column) -> Column:
    place = F.struct("archive", "ordinal")
    both = F.collect_list(F.when(F.col("type") == kind, F.struct(place.alias("place"), row.alias("row"))))
    before = lambda a, b: F.when(a["place"] < b["place"], -1).when(a["place"] > b["place"], 1).otherwise(0)
    return F.transform(F.array_sort(both, before), lambda x: x["row"])


def page_rows(captures: DataFrame, key_type: str = "long") -> DataFrame:
    """A row per page: page_id, payload_bytes, payload_digest, record_type, refers_to and n_records, revisits resolved by their digests."""
    key = F.col("metadata")[0]["fields"][KEY_FIELD].cast(key_type)
    n = (F.size("requests") + F.size("metadata") + 1).cast("long")
    flat = captures.filter(F.col("response").isNotNull()).select(key.alias("page_id"), "response.type", "response.payload_bytes", F.coalesce("response.payload_sha1", "response.payload_digest").alias("payload_digest"), n.alias("n_records"))
    none = F.lit(None).cast(key_type)
    first = flat.filter(F.col("type") != "revisit")
    kept = first.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), none.alias("refers_to"), "n_records")
    originals = first.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.max("payload_bytes").alias("full"))
    again = flat.filter(F.col("type") == "revisit").join(originals, "payload_digest", "left")
    return kept.unionByName(again.select("page_id", F.col("full").alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), "refers_to", "n_records"))


def round_trip(pages: DataFrame) -> DataFrame:
    """pages written as archives to the shared folder, read back, assembled, and one row per page of it."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4()}"
    write(pages, path)
    return page_rows(assemble(saved(read(spark, path).drop("payload"))))


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT p.page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((CAST('0x' || p.h[5 * i // 4 + 1 : 5 * i // 4 + 2] AS INT) >> (3 - 5 * i % 4)) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to, CAST(3 AS BIGINT) AS n_records
FROM p JOIN f ON p.h = f.h
"""
