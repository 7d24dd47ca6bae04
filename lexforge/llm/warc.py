"""WARC records in a content-addressed archive.

An archive is two tables. ``payloads`` holds every distinct payload once, under its
SHA-256 digest; ``records`` holds the exact header bytes of every record, with the
digest that it points to. Records are rebuilt by joining both, and read by parsing
their bytes, as a reader of WARC files does. Digests are verified twice: when payloads
are stored, all copies behind one digest must agree in length and in a second hash;
when they are read, the digest is computed again from the stored bytes.

Of records with equal payloads of at least ``least`` bytes, that with the smallest id
is a response and the others are revisits that refer to it and carry no payload of
their own. ``write_files`` and ``read_files`` turn an archive into gzipped WARC files
and back.

A payload that a third of all rows share is one row after partial aggregation; the
narrow rows that look it up are dealt over salted keys, and only the responses, one for
each large payload, meet payload bytes in the join.

Defined results: a null payload counts as empty; a null or repeated id is one of a record
like others, but nothing refers to a null one: where all ids of a payload are null, and
of rows that share the smallest id, each is a response; line breaks in a URL are
percent-encoded, a null URL is left out; ids may be of any type; an empty table gives
an empty archive; other columns are not read.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, shared_dir

# Line end, and the profile of revisits with an identical payload.
EOL = "\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FETCHED = "2024-01-01T00:00:00Z"


def _lines(*parts: Column | str) -> Column:
    """Header lines, each with a line end; null ones are left out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(p) if isinstance(p, str) else p, F.lit(EOL)), F.lit("")) for p in parts])


def _urn(ident: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.url_encode(ident.cast("string")), F.lit(">"))


def _field(header: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(header, rf"(?m)^{name}: ([^\r\n]*)\r?$", 1), F.lit(""))


def _ident(header: Column, name: str) -> Column:
    return F.url_decode(F.nullif(F.regexp_extract(_field(header, name), "^<urn:page:(.*)>$", 1), F.lit("")))


def record_header(ident: Column, url: Column, digest: Column, size: Column, refers_to: Column, is_revisit: Column, fetched: str = FETCHED) -> Column:
    """The bytes of a record before its payload: its own header and that of the HTTP response."""
    http = _lines("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", F.concat(F.lit("Content-Length: "), size.cast("string")), "")
    uri = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    block = F.octet_length(http) + F.when(is_revisit, 0).otherwise(size)
    own = _lines(
        "WARC/1.1", F.concat(F.lit("WARC-Type: "), F.when(is_revisit, "revisit").otherwise("response")), F.concat(F.lit("WARC-Record-ID: "), _urn(ident)),
        F.concat(F.lit("WARC-Target-URI: "), uri), f"WARC-Date: {fetched}", F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.lower(F.hex(digest))),
        F.when(is_revisit, f"WARC-Profile: {REVISIT}"), F.when(is_revisit, F.concat(F.lit("WARC-Refers-To: "), _urn(refers_to))),
        "Content-Type: application/http;msgtype=response", F.concat(F.lit("Content-Length: "), block.cast("string")), "",
    )
    return F.concat(own, http).cast("binary")


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, fetched: str = FETCHED) -> None:
    """Write a record of every row to the tables ``path``/payloads and ``path``/records."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.unhex(F.sha2("payload", 256)), "size": F.octet_length("payload").cast("long")})
    same = lambda c: F.min(c) == F.max(c)
    stored = rows.withColumn("check", F.xxhash64("payload")).groupBy("digest").agg(
        F.first("payload").alias("payload"), F.min("size").alias("size"), F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"), (same("size") & same("check")).alias("agree")
    )
    sound = F.when(F.col("agree"), F.col("size")).otherwise(F.raise_error(F.lit("different payloads share a digest")))
    stored.select("digest", sound.alias("size"), "first_id", "n", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")
    first = pages.sparkSession.read.parquet(f"{path}/payloads").select("digest", "first_id")
    found = lookup(rows.select("id", "url", "digest", "size"), first, ["digest"], ["id", "url"])
    is_revisit = (F.col("size") >= least) & ~F.col("id").eqNullSafe(F.col("first_id"))
    header = record_header(F.col("id"), F.col("url"), F.col("digest"), F.col("size"), F.col("first_id"), is_revisit, fetched)
    found.select("id", "digest", is_revisit.alias("is_revisit"), header.alias("header")).write.parquet(f"{path}/records")


def rebuild(spark: SparkSession, path: str, least: int = 100) -> DataFrame:
    """(id, record, payload_bytes, verified): every record of an archive, byte for byte, with the length of the full payload behind its digest and whether that has it.

    ``least`` is only what counts as small here: payloads below it are looked up by
    salted keys, larger ones meet their one response.
    """
    payloads, records = spark.read.parquet(f"{path}/payloads"), spark.read.parquet(f"{path}/records")
    facts = payloads.select(
        "digest", F.octet_length("payload").cast("long").alias("payload_bytes"), (F.unhex(F.sha2("payload", 256)) == F.col("digest")).alias("verified"),
        F.when(F.octet_length("payload") < least, F.col("payload")).alias("small"),
    )
    known = lookup(records, facts, ["digest"], ["id"])
    end = F.lit(EOL + EOL).cast("binary")
    verified = F.coalesce("verified", F.lit(False)).alias("verified")
    bare = F.col("is_revisit") | F.col("small").isNotNull() | F.col("payload_bytes").isNull()
    short = known.filter(bare).select("id", F.concat("header", F.when(F.col("is_revisit"), F.lit(b"")).otherwise(F.coalesce("small", F.lit(b""))), end).alias("record"), "payload_bytes", verified)
    long = known.filter(~bare).join(payloads.select("digest", "payload"), "digest").select("id", F.concat("header", "payload", end).alias("record"), "payload_bytes", verified)
    return long.unionByName(short)


def parse(records: DataFrame, column: str = "record") -> DataFrame:
    """records with what their bytes say: record_type, record_id, refers_to (ids as text), target_uri, digest_said, length_said (of the full payload), http_header and payload (of this record)."""
    text = F.col(column).cast("string")
    header = F.substring_index(text, EOL + EOL, 1)
    start = F.octet_length(header) + 5
    length = _field(header, "Content-Length").cast("int")
    cut = records.withColumns({"__header": header, "__block": F.substring(F.col(column), start, length)})
    http = F.substring_index(F.col("__block").cast("string"), EOL + EOL, 1)
    h = F.col("__header")
    return cut.withColumns({
        "record_type": _field(h, "WARC-Type"), "record_id": _ident(h, "WARC-Record-ID"), "refers_to": _ident(h, "WARC-Refers-To"), "target_uri": _field(h, "WARC-Target-URI"),
        "digest_said": F.regexp_extract(_field(h, "WARC-Payload-Digest"), "^sha256:([0-9a-f]{64})$", 1), "length_said": _field(http, "Content-Length").cast("long"),
        "http_header": http, "payload": F.substring(F.col("__block"), F.octet_length(http) + 5, F.length("__block")),
    }).drop("__header", "__block")


def read_archive(spark: SparkSession, path: str, least: int = 100) -> DataFrame:
    """(id as text, record_type, refers_to, target_uri, payload_bytes, payload_digest, payload) as the records say, checked against the stored payloads.

    payload is null for revisits. A record whose bytes and digest disagree, or whose
    payload is missing, is an error.
    """
    p = parse(rebuild(spark, path, least))
    is_response = F.col("record_type") == "response"
    whole = F.when(is_response, (F.octet_length("payload") == F.col("length_said")) & (F.sha2("payload", 256) == F.col("digest_said"))).otherwise(F.lit(True))
    sound = F.col("verified") & (F.col("payload_bytes") == F.col("length_said")) & whole
    digest = F.when(F.coalesce(sound, F.lit(False)), F.col("digest_said")).otherwise(F.raise_error(F.concat(F.lit("record and payload disagree: "), F.coalesce("record_id", F.lit("?")))))
    return p.select(
        F.col("record_id").alias("id"), "record_type", "refers_to", "target_uri", F.col("length_said").alias("payload_bytes"), digest.alias("payload_digest"),
        F.when(is_response, F.col("payload")).alias("payload"),
    )


def write_files(spark: SparkSession, path: str, out: str, per_file: int = 10_000) -> None:
    """An archive as gzipped WARC files of at most ``per_file`` records, written by Spark's text writer with the records' end as line end. Payloads must be UTF-8."""
    text = F.col("record").cast("string")
    body = rebuild(spark, path).select(F.substring(text, 1, F.length(text) - 4).alias("value"))
    body.write.option("lineSep", EOL + EOL).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(out)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The parsed records of WARC files, plain or gzipped, one file per task at a time."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                at, made = io.BytesIO(_unzipped(content)), []
                while (record := _next_record(at)) is not None:
                    made.append(record)
                yield pd.DataFrame({"record": pd.Series(made, dtype=object)})

    return parse(spark.read.format("binaryFile").load(path).select("content").mapInPandas(split, "record binary"))


def _unzipped(content: bytes) -> bytes:
    """The content of a file of any number of gzip members, or of a plain one."""
    out = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(wbits=31)
        out.append(member.decompress(content))
        content = member.unused_data
    return b"".join(out) or content


def _next_record(at: io.BytesIO) -> bytes | None:
    head = []
    while (line := at.readline()) not in (b"\r\n", b""):
        head.append(line)
    if not head:
        return None
    length = next(int(x.split(b":")[1]) for x in head if x.lower().startswith(b"content-length:"))
    return b"".join(head) + b"\r\n" + at.read(length) + at.read(4)


def archive_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lexforge/warc-{uuid.uuid4().hex}"
