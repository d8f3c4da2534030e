"""Small mail tables for rule tests."""

from mailsieve.plans import scoring

MAIL = (
    "email_id bigint, sender string, subject string, body string, headers map<string,string>, "
    "attachments array<struct<filename:string,mime_type:string,size_bytes:bigint>>, registered_date string"
)


def mails(spark, *rows):
    """Mails from dicts; missing fields are harmless."""
    full = [
        (
            r.get("id", i), r.get("sender", "a@plain.example"), r.get("subject", "s"), r.get("body", ""),
            r.get("headers", {}), r.get("attachments", []), r.get("registered_date"),
        )
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(full, MAIL)


def found(df, column):
    """Per mail: list of (signal, severity)."""
    rows = df.select("email_id", column).orderBy("email_id").collect()
    return [[(f["signal"], f["severity"]) for f in r[column]] for r in rows]


def score(spark, rows, as_of, **kw):
    return scoring.score_emails(mails(spark, *rows), as_of=as_of, **kw)
