"""JSON lines, live output, and a model called from the workers."""

import json
import os
import uuid

from helpers import mails
from pyspark.sql import functions as F

from mailsieve.catalog import views as W
from mailsieve.functions.shared import ship
from mailsieve.operators import custom, lookup, reputation, reuse
from mailsieve.plans import exchange, scoring
from mailsieve.sources import mail, sinks
from mailsieve.streaming import batches

GOOD = {"email_id": 1, "from_address": "a@b.example", "subject": " s ", "headers": {"To": "x"}, "attachment_metadata": [{"filename": "f", "mime_type": "t", "size_bytes": 1}]}
LINES = [
    (json.dumps(GOOD), "valid"), (json.dumps({**GOOD, "extra": 5}), "valid"), (json.dumps({**GOOD, "from_address": None}), "refused"),
    (json.dumps({**GOOD, "subject": "x" * 999}), "refused"), (json.dumps({**GOOD, "headers": "none"}), "wrong_type"),
    (json.dumps({**GOOD, "attachment_metadata": [{"size_bytes": "big"}]}), "wrong_type"), (json.dumps(GOOD)[:30], "unparseable"), ("not json", "unparseable"), ("7", "wrong_type"),
]


def test_every_line_has_one_outcome(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, (line, _) in enumerate(LINES):
        (tmp_path / "in" / f"{i}.json").write_text(line + "\n\n")
    got = mail.judged(mail.read_posted(spark, str(tmp_path / "in"))).withColumn("n", F.regexp_extract(F.input_file_name(), r"(\d+)\.json", 1).cast("int"))
    rows = {r["n"]: r for r in got.collect()}
    assert [rows[i]["outcome"] for i in range(len(LINES))] == [want for _, want in LINES]
    assert all((r["_raw"] is not None) == (r["outcome"] in ("wrong_type", "unparseable")) for r in rows.values())
    assert rows[6]["_raw"] == LINES[6][0] and rows[0]["subject"] == "s" and rows[2]["errors"] == ["value is not a valid email address"]


def test_stream_of_lines_loses_nothing(spark, tmp_path):
    table = sinks.LiveTable(spark, f"{tmp_path}/out", "email_id bigint, outcome string, _raw string")
    (tmp_path / "in").mkdir()

    def handle(rows, batch):
        out = mail.judged(rows).select("email_id", "outcome", "_raw")
        for _ in range(2):
            table.put(out, batch, F.col("outcome"))
        return out.limit(0)

    for part in range(3):
        (tmp_path / "in" / f"{part}.json").write_text("\n".join(line for line, _ in LINES))
    batches.run(mail.stream_posted(spark, str(tmp_path / "in"), 1), handle, str(tmp_path / "run"))
    for kind in {want for _, want in LINES}:
        assert table.read(kind).count() == 3 * sum(want == kind for _, want in LINES)


def test_a_broken_batch_is_not_seen(spark, tmp_path):
    scored = scoring.response(scoring.score_emails(mails(spark, {"body": "immediately"}, {}), as_of=W.AS_OF))
    table = sinks.LiveTable(spark, f"{tmp_path}/dto", scored.schema, "json")
    table.put(scored, 0)
    before = sorted(map(str, table.read().collect()))
    # the second batch breaks off after its files and before its marks, and is then repeated
    scored.withColumn("part", F.lit("all_1")).write.partitionBy("part").json(f"{tmp_path}/dto/data/1")
    assert sorted(map(str, table.read().collect())) == before
    for _ in range(2):
        table.put(scored, 1)
        assert sorted(map(str, table.read().collect())) == sorted(before * 2)
    assert table.read().select("deterministic_findings").dtypes == scored.select("deterministic_findings").dtypes


def test_model_port_opens_once_a_task(spark, tmp_path):
    folder = str(tmp_path)

    def setup():
        open(os.path.join(folder, uuid.uuid4().hex), "w").close()

        def answer(messages):
            text = messages[0]["content"]
            if "broken" in text:
                raise ConnectionError("gone")
            return "no json" if "again" in text and len(messages) == 1 else W.REPLIES[0]

        return answer

    ship(spark)
    gray = ["please verify your identity immediately" + extra for extra in ("", " again", " broken", *map(str, range(40)))]
    found = scoring.analyze(mails(spark, *[{"body": b} for b in gray]), W.AS_OF, keep=["email_id", "body"], profile="wired")
    store = reuse.VerdictStore(spark, f"{tmp_path}/store")
    asked = exchange.begin(found, store, W.AS_OF, "m")
    asked.asks = asked.asks.repartition(2)
    before = len(os.listdir(folder))
    answers = exchange.ask(asked, custom.model_port(setup, "m", W.AS_OF))
    opened = len(os.listdir(folder)) - before
    assert 2 <= opened <= 4  # two tasks for the questions, one or two for the only one to be repeated
    rows = answers.collect()
    assert len(rows) == len(gray) + 1 and len(os.listdir(folder)) - before == opened
    assert [r["error"] for r in rows if r["raw_response"] is None] == ["ConnectionError: gone"]
    out = exchange.finish(asked, answers.drop("error"), store, W.AS_OF, 0).orderBy("email_id").collect()
    assert [r["origin"] for r in out][:4] == ["asked", "asked", "fallback", "asked"]


def test_hot_keys_are_a_bounded_number(spark):
    df = spark.range(20_000).selectExpr("id AS email_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE cast(id % 4000 as string) END AS k")
    assert [r.k for r in lookup.hot_keys(df, "k", 0).collect()] == ["hot"]


def test_tags_of_a_listed_link(spark):
    rows = [("u", "is_listed", None, None, [str(i) for i in range(14)], "1")]
    feed = spark.createDataFrame(rows, "url string, query_status string, threat string, url_status string, tags array<string>, id string")
    size = lambda **kw: len(reputation.combine(feed, None, spark, **kw).first()["malware"]["tags"])
    assert (size(), size(max_tags=None), size(max_tags=12)) == (10, 14, 12)


def test_posted_lines_take_files_by_their_number(spark, sf_dir, monkeypatch):
    """No task writes a fixed share of all mails, however many there are."""
    from mailsieve.catalog import spark_queries

    monkeypatch.setattr(spark_queries, "POSTED_ROWS", 20, raising=False)
    posted = spark.read.text(spark_queries._posted(spark, sf_dir))
    rows = [r["n"] for r in posted.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert sum(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count() and max(rows) <= 20
    got = spark_queries.QUERIES["src_json_stream"](spark, sf_dir)
    assert got.count() == sum(rows)
