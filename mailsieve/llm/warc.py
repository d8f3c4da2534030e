"""Content-addressed web archive: payload bytes once, record headers apart.

An archive is two tables in one folder: ``headers`` has the exact WARC and HTTP header blocks
of every record, ``payloads`` each distinct payload under its SHA-256.  A join rebuilds the
records; every payload read back is hashed again and held against its key and its header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mailsieve.functions.shared import cut

DIGITS32, LETTERS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = "page_id bigint, key string, warc_header string, http_header string"
PAYLOADS = "key string, payload binary"
END = "\r\n"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32, from groups of forty bits."""
    text = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(text, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), DIGITS32, LETTERS32)


def _line(name: str, value: Column) -> Column:
    """A header line; line breaks in a value are escaped, a null value leaves the line out."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(END)), F.lit(""))


def write_archive(pages: DataFrame, path: str, *, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """A record for every row of ``pages(page_id, url, html)``.

    A null html is an empty payload.  Of equal payloads of at least ``least_bytes`` the record
    with the smallest page_id is the response and the others revisit it; repeated rows with
    that page_id are responses too.  Null page_ids come last: they are responses only if all
    are null.  A null url leaves its header line out.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), "url",
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("key", F.sha2("payload", 256))
    known = cut(rows.select("page_id", "url", "key", F.octet_length("payload").alias("size"),
                            base32_sha1(F.col("payload")).alias("digest")), "records")
    firsts = known.groupBy("key").agg(
        F.min("page_id").alias("first"), F.min("digest").alias("least"), F.max("digest").alias("most"),
        F.min("size").alias("small"), F.max("size").alias("large"),
    )
    one = (F.col("least") == F.col("most")) & (F.col("small") == F.col("large"))
    firsts = firsts.select("key", F.when(one, F.col("first")).otherwise(
        F.raise_error(F.concat(F.lit("two payloads under "), F.col("key"))).cast("bigint")).alias("first"))
    revisit = (F.col("size") >= least_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
                    F.col("size"), F.lit(END + END))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    block = F.length("http_header") + F.when(F.col("revisit"), 0).otherwise(F.col("size"))
    header = F.concat(
        F.lit(f"WARC/1.1{END}"),
        _line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", name("page_id")),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Refers-To", F.when(F.col("revisit"), name("first"))),
        _line("WARC-Profile", F.when(F.col("revisit"), F.lit(PROFILE))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block.cast("string")),
        F.lit(END),
    )
    records = known.join(firsts, "key").withColumn("revisit", revisit).withColumn("http_header", http)
    records.select("page_id", "key", header.alias("warc_header"), "http_header").write.parquet(f"{path}/headers")
    # equal keys are equal bytes, so any copy will do; copies meet before the shuffle
    rows.groupBy("key").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record: its header fields, its bytes as a WARC file has them, and its full payload.

    Raises if a payload does not have the digests it is stored under.
    """
    headers = spark.read.schema(HEADERS).parquet(f"{path}/headers")
    payloads = spark.read.schema(PAYLOADS).parquet(f"{path}/payloads")
    field = lambda name, value="([^\r\n]*)": F.regexp_extract("warc_header", f"\n{name}: {value}\r\n", 1)
    rows = headers.join(payloads, "key").withColumn("digest", base32_sha1(F.col("payload")))
    sound = (F.sha2("payload", 256) == F.col("key")) & (field("WARC-Payload-Digest", "sha1:([A-Z2-7]*)") == F.col("digest"))
    kind = field("WARC-Type")
    body = F.when(kind == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    page = lambda name: F.nullif(F.nullif(field(name, "<urn:page:([^>]*)>"), F.lit("")), F.lit("null")).cast("bigint")
    return rows.select(
        page("WARC-Record-ID").alias("page_id"),
        kind.alias("record_type"),
        page("WARC-Refers-To").alias("refers_to"),
        F.nullif(field("WARC-Target-URI"), F.lit("")).alias("url"),
        F.concat(F.col("warc_header").cast("binary"), F.col("http_header").cast("binary"), body,
                 F.lit(END + END).cast("binary")).alias("record"),
        F.when(sound, F.col("payload")).otherwise(
            F.raise_error(F.concat(F.lit("damaged payload "), F.col("key"))).cast("binary")).alias("payload"),
        "digest",
    )
