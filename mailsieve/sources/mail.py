"""Reading e-mails: posted JSON objects, or raw messages cut down to what is scored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from mailsieve import fixed_values as V
from mailsieve.functions.sql import case
from mailsieve.functions.text import bare_address, clip, recipient, strip
from mailsieve.operators.validate import errors
from mailsieve.schema import ATTACHMENT, REQUEST

_NO_FILES = f"CAST(array() AS array<{ATTACHMENT.simpleString()}>)"


CORRUPT = "_raw"
_POSTED = T.StructType([*REQUEST.fields, T.StructField(CORRUPT, T.StringType())])


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """JSON objects, one per line; fields of the wrong type become null."""
    return clean(spark.read.schema(REQUEST).json(path, mode="PERMISSIVE"))


def stream_requests(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    source = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", files_per_trigger)
    return clean(source.json(path))


def read_posted(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as they were posted; a line that does not fit the schema is kept in ``_raw``."""
    return spark.read.schema(_POSTED).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)


def stream_posted(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    source = spark.readStream.schema(_POSTED).option("maxFilesPerTrigger", files_per_trigger)
    return source.option("columnNameOfCorruptRecord", CORRUPT).option("mode", "PERMISSIVE").json(path)


def judged(posted: DataFrame) -> DataFrame:
    """Cleaned requests with ``errors`` and ``outcome``: valid, refused (against a limit), wrong_type
    (JSON, but not of the schema) or unparseable.

    Every line has one outcome and none is lost: what the schema cannot hold stays in ``_raw``.
    """
    checked = clean(posted).selectExpr("*", f"{errors('from_address', 'subject', 'body', 'headers', 'attachment_metadata')} AS _errors")
    outcome = case(
        (f"{CORRUPT} IS NOT NULL AND try_parse_json({CORRUPT}) IS NULL", "'unparseable'"), (f"{CORRUPT} IS NOT NULL", "'wrong_type'"),
        ("size(_errors) > 0", "'refused'"), otherwise="'valid'",
    )
    why = case(
        (f"{CORRUPT} IS NULL", "_errors"), (f"try_parse_json({CORRUPT}) IS NULL", "array('not JSON')"), otherwise="array('not of the schema')",
    )
    return checked.selectExpr(*posted.columns, f"{why} AS errors", f"{outcome} AS outcome")


def clean(requests: DataFrame) -> DataFrame:
    """Trim strings, reduce the sender to the bare address, put empty values for missing ones."""
    done = {
        "from_address": bare_address(strip("from_address")),
        "subject": strip("coalesce(subject, '')"),
        "body": strip("coalesce(body, '')"),
        "headers": "coalesce(headers, CAST(map() AS map<string,string>))",
        "attachment_metadata": f"coalesce(attachment_metadata, {_NO_FILES})",
    }
    return requests.selectExpr(
        *[f"{done[c]} AS {c}" if c in done else c for c in requests.columns]
    )


def to_emails(requests: DataFrame) -> DataFrame:
    """Requests as the e-mail table the analyzers read."""
    return requests.selectExpr(
        "email_id",
        "from_address AS sender",
        f"{recipient('headers')} AS recipient",
        "subject",
        "body",
        "headers",
        "attachment_metadata AS attachments",
    )


def extract_message(messages: DataFrame, max_body_chars: int | None = None) -> DataFrame:
    """Raw messages (``sender, to, date, subject, reply_to, body, attachments``) as requests.

    Five headers, the whole body, attachment metadata without content.  With ``max_body_chars``
    the body is cut there, and ``body_truncated`` tells which bodies were.
    """
    date = "coalesce(date_format(date, \"EEE, dd MMM yyyy HH:mm:ss 'GMT'\"), '')"
    headers = (
        "map('From', coalesce(sender, ''), 'To', coalesce(to, ''), "
        f"'Date', {date}, 'Subject', coalesce(subject, ''), 'Reply-To', coalesce(reply_to, ''))"
    )
    files = (
        "transform(attachments, a -> named_struct('filename', coalesce(a.filename, ''), "
        "'mime_type', coalesce(a.mime_type, ''), 'size_bytes', coalesce(a.size_bytes, 0L)))"
    )
    text = "coalesce(body, '')"
    body = text if max_body_chars is None else clip(text, max_body_chars)
    flag = [] if max_body_chars is None else [f"length({text}) > {max_body_chars} AS body_truncated"]
    return messages.selectExpr(
        "email_id",
        "coalesce(sender, '') AS from_address",
        "coalesce(subject, '') AS subject",
        f"{body} AS body",
        f"{headers} AS headers",
        f"coalesce({files}, {_NO_FILES}) AS attachment_metadata",
        *flag,
    )
