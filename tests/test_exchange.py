"""Asking the model: gate, one question a content, retries, verdicts for all copies, the store."""

from datetime import timedelta

import pytest
from helpers import mails

from mailsieve import fixed_values as V
from mailsieve.catalog import views as W
from mailsieve.operators import reuse
from mailsieve.plans import exchange, scoring

AS_OF = W.AS_OF
GRAY = "please verify your identity immediately"
ANSWERS = "key string, attempt int, model string, produced_at timestamp_ntz, raw_response string"
GOOD, BAD = W.REPLIES[0], "no json here"


@pytest.fixture()
def store(spark, tmp_path):
    return reuse.VerdictStore(spark, f"{tmp_path}/store")


def analyzed(spark, bodies):
    return scoring.analyze(mails(spark, *[{"id": i, "body": b} for i, b in enumerate(bodies)]), AS_OF, keep=["email_id", "body"], profile="wired")


def answer(spark, asked, *raw):
    """The same answers, in order of attempts, for every question."""
    rows = [(a["key"], i, "m", AS_OF, text) for a in asked.asks.collect() for i, text in enumerate(raw)]
    return spark.createDataFrame(rows, ANSWERS)


def test_one_question_for_all_copies(spark, store):
    asked = exchange.begin(analyzed(spark, [GRAY, "plain", GRAY, GRAY, GRAY + "!", None]), store, AS_OF, "m")
    asks = sorted(asked.asks.collect(), key=lambda r: r["email_id"])
    assert [(a["email_id"], a["mails"]) for a in asks] == [(0, 3), (4, 1)]
    assert {a["prompt_version"] for a in asks} == {V.PROMPT_VERSION}
    assert GRAY in asks[0]["prompt"] and "urgency_cue" in asks[0]["prompt"]
    gated = [r for r in asked.scored.collect() if r["key"] is None]
    assert {r["gate_reason"] for r in gated} == {"below_lower_threshold"} and "sanitised" not in asked.scored.columns


def test_verdicts_are_spread_and_reused(spark, store):
    asked = exchange.begin(analyzed(spark, [GRAY, GRAY, "plain"]), store, AS_OF, "m")
    out = exchange.finish(asked, answer(spark, asked, GOOD), store, AS_OF, 0).orderBy("email_id").collect()
    assert [r["origin"] for r in out] == ["asked", "asked", None]
    assert [r["llm_available"] for r in out] == [True, True, False] and out[2]["llm_gated"]
    assert out[0]["llm_result"]["semantic_score"] == 70 and out[0]["final_score"] == out[1]["final_score"] > out[0]["rule_score"]
    again = exchange.begin(analyzed(spark, [GRAY, "other " + GRAY]), store, AS_OF + timedelta(hours=23), "m")
    assert [a["email_id"] for a in again.asks.collect()] == [1]
    out = exchange.finish(again, answer(spark, again), store, AS_OF + timedelta(hours=23), 1).orderBy("email_id").collect()
    assert [(r["origin"], r["llm_available"], r["llm_gated"]) for r in out] == [("reused", True, False), (None, False, False)]
    assert out[1]["semantic_warning"] == V.WARNING_FAILED
    late = exchange.begin(analyzed(spark, [GRAY]), store, AS_OF + timedelta(hours=24), "m")
    assert late.asks.count() == 1 and exchange.begin(analyzed(spark, [GRAY]), store, AS_OF, "other-model").asks.count() == 1


def test_refused_answers_are_asked_again_then_fall_back(spark, store):
    asked = exchange.begin(analyzed(spark, [GRAY]), store, AS_OF, "m")
    [again] = exchange.retries(asked, answer(spark, asked, BAD)).collect()
    assert again["attempt"] == 1 and again["reason"] == "No JSON object found in LLM response."
    assert [m["role"] for m in again["messages"]] == ["user", "assistant", "user"]
    assert again["messages"][1]["content"] == BAD and again["messages"][2]["content"] == V.RETRY_INSTRUCTION
    assert exchange.retries(asked, answer(spark, asked, GOOD)).count() == 0
    assert exchange.retries(asked, answer(spark, asked, BAD, BAD)).count() == 0
    [out] = exchange.finish(asked, answer(spark, asked, BAD, GOOD), store, AS_OF, 0).collect()
    assert out["origin"] == "asked"
    other = exchange.begin(analyzed(spark, [GRAY + " now"]), store, AS_OF, "m")
    [out] = exchange.finish(other, answer(spark, other, BAD, BAD, GOOD), store, AS_OF, 1).collect()
    assert (out["origin"], out["llm_result"]["semantic_score"]) == ("fallback", V.FALLBACK_SCORE)
    assert exchange.begin(analyzed(spark, [GRAY + " now"]), store, AS_OF, "m").asks.count() == 1  # a fallback is never stored


def rows_of(store, as_of=AS_OF):
    return sorted((r["key"], r["produced_at"], r["verdict"]["semantic_score"]) for r in store.read(as_of).collect())


def test_a_repeated_round_and_compaction_leave_the_store_equal(spark, store):
    asked = exchange.begin(analyzed(spark, [GRAY, GRAY + "!"]), store, AS_OF, "m")
    answers = answer(spark, asked, GOOD)
    exchange.finish(asked, answers, store, AS_OF, 0)
    before = rows_of(store)
    exchange.finish(asked, answers, store, AS_OF, 0)
    assert rows_of(store) == before and len(before) == 2
    store.compact(AS_OF)
    assert rows_of(store) == before and store.rounds.versions() == {}
    exchange.finish(asked, answers, store, AS_OF, 0)  # a repeat after the compaction: the same verdicts once more
    assert sorted(set(rows_of(store))) == before
    store.compact(AS_OF + timedelta(days=3))
    assert rows_of(store, AS_OF + timedelta(days=3)) == [] and store.merged.versions() == {}


def test_only_the_gray_zone_is_joined(spark, store):
    asked = exchange.begin(analyzed(spark, [GRAY, "plain"]), store, AS_OF, "m")
    plan = exchange.finish(asked, answer(spark, asked, GOOD), store, AS_OF, 0, limit=0)._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull(key" in plan and "isnull(key" in plan and "Union" in plan


def test_prompt_holds_link_findings(spark, store):
    feed = spark.createDataFrame([("http://bad.example/x", None, None)], "url string, malware struct<threat:string,url_status:string,tags:array<string>,id:string>, "
                                 "phish struct<phish_id:string,page:string,verified:boolean>")
    feed = feed.selectExpr("url", "malware", "named_struct('phish_id', '7', 'page', '', 'verified', true) AS phish")
    df = mails(spark, {"body": "see http://bad.example/x"})
    found = scoring.analyze(df, AS_OF, listed=feed, keep=["email_id", "body"], profile="wired")
    [ask] = exchange.begin(found, store, AS_OF, "m").asks.collect()
    assert "phishtank_listed" in ask["prompt"]


def test_verdicts_of_one_time_do_not_depend_on_the_order_of_rows(spark):
    rows = [("k", (score,), AS_OF) for score in (10, 70, 40)]
    for stored in (rows, rows[::-1], rows[1:] + rows[:1]):
        store = spark.createDataFrame(stored, "key string, verdict struct<semantic_score:int>, produced_at timestamp_ntz").coalesce(1)
        assert [(r.key, r.verdict.semantic_score) for r in reuse.fresh(store, AS_OF).collect()] == [("k", 70)]
