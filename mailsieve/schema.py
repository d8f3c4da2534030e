"""Types shared by every stage."""

from pyspark.sql import types as T

ATTACHMENT = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("mime_type", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
    ]
)

#: JSON objects as a mail client posts them.
REQUEST = T.StructType(
    [
        T.StructField("email_id", T.LongType()),
        T.StructField("from_address", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("attachment_metadata", T.ArrayType(ATTACHMENT)),
    ]
)

FINDING = T.StructType(
    [
        T.StructField("analyzer", T.StringType()),
        T.StructField("signal", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("weight", T.IntegerType()),
        T.StructField("description", T.StringType()),
        T.StructField("evidence", T.MapType(T.StringType(), T.StringType())),
        T.StructField("ordinal", T.IntegerType()),
    ]
)
FINDINGS = T.ArrayType(FINDING)

#: A malware-URL feed and a phishing-URL feed, one row per entry; a URL may have several.
MALWARE_FEED = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("query_status", T.StringType()),
        T.StructField("threat", T.StringType()),
        T.StructField("url_status", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("id", T.StringType()),
    ]
)
PHISH_FEED = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("in_database", T.BooleanType()),
        T.StructField("valid", T.BooleanType()),
        T.StructField("phish_id", T.StringType()),
        T.StructField("phish_detail_page", T.StringType()),
        T.StructField("verified", T.BooleanType()),
    ]
)

#: Landed model answers, at most two attempts per e-mail.
REPLY = T.StructType(
    [
        T.StructField("email_id", T.LongType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("model", T.StringType()),
        T.StructField("produced_at", T.TimestampNTZType()),
        T.StructField("raw_response", T.StringType()),
    ]
)
