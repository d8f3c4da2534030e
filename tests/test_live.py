"""Live jobs on late and repeated rows, against sequential oracles, and what their state costs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mailsieve.operators import limits
from mailsieve.sources.parts import Parts
from mailsieve.streaming import batches, contact, dedup, rates
from mailsieve.streaming import scoring as live

START = datetime(2024, 1, 1)
COPIES = "id bigint, key string, ts timestamp_ntz"
REQUESTS = "request_id bigint, user_id bigint, ts timestamp_ntz"
MAILS = "email_id bigint, sender string, recipient string, ts timestamp_ntz"


def run_slices(spark, slices, schema, handle, folder):
    """Each slice lands and is run from the same checkpoint; the output so far after each."""
    out = []
    for rows in slices:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out.append(batches.run(live.read(spark, f"{folder}/in", 1000), handle, folder).collect())
    return out


def passes(slices, hours=24):
    """One row after the other."""
    seen, out = {}, []
    for rows in slices:
        for i, key, ts in sorted(rows, key=lambda r: (r[2] is not None, r[2] or START, r[0])):
            times = seen.setdefault(key, [])
            if key is None or ts is None or all(abs(ts - t) >= timedelta(hours=hours) for t in times):
                out.append(i)
                if key is not None and ts is not None:
                    times.append(ts)
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_copies_in_any_order_equal_one_row_after_the_other(spark, tmp_path, seed):
    dice = random.Random(seed)
    times = [None, *[START + timedelta(minutes=dice.choice([1, 30, 600, 1439, 1440, 1441]) * dice.randrange(12), microseconds=dice.choice([0, 1])) for _ in range(60)]]
    rows = [(i, dice.choice(["a", "a", "b", "c", None]), dice.choice(times)) for i in range(240)]
    slices = [[r for r in rows if r[0] * 7 % 3 == s] for s in range(3)]
    slices.append([r for r in rows if r[0] % 10 == 3])
    handle = dedup.first_within(Parts(spark, f"{tmp_path}/times", dedup.STATE))
    *_, got = run_slices(spark, slices, COPIES, handle, str(tmp_path))
    assert sorted(r.id for r in got) == passes(slices)


def test_two_years_of_daily_copies_take_few_rounds(spark):
    rows = [(2 * i + h, "a", START + timedelta(days=i, hours=12 * h)) for i in range(730) for h in range(2)]
    rounds = []
    got = dedup.pass_once(spark.createDataFrame(rows, COPIES), spark.createDataFrame([], dedup.STATE), 24, rounds)
    assert sorted(r.id for r in got.collect()) == passes([rows]) == [2 * i for i in range(730)]
    assert len(rounds) < 12


def test_a_repeated_batch_of_copies_gives_the_same(spark, tmp_path):
    state = Parts(spark, f"{tmp_path}/times", dedup.STATE)
    handle = dedup.first_within(state)
    first = spark.createDataFrame([(1, "a", START)], COPIES)
    second = spark.createDataFrame([(2, "a", START + timedelta(hours=25)), (3, "a", START + timedelta(hours=23))], COPIES)
    assert [r.id for r in handle(first, 0).collect()] == [1]
    for _ in range(2):
        assert [r.id for r in handle(second, 1).collect()] == [2]
    assert state.read().count() == 2


def test_state_of_copies_is_read_by_day(spark, tmp_path):
    state = Parts(spark, f"{tmp_path}/times", dedup.STATE)
    handle, reads = dedup.first_within(state), []
    plain = state.read
    state.read = lambda names=None, before=None: reads.append(list(names)) or plain(reads[-1], before)
    for day in range(8):
        handle(spark.createDataFrame([(i, f"k{i}", START + timedelta(days=day, minutes=i)) for i in range(3)], COPIES), day)
    assert max(map(len, reads)) == 3 and len(state.versions()) == 8


def decided(slices, per_minute, per_day):
    minute, day, out = {}, {}, {}
    for n, rows in enumerate(slices):
        for rid, user, ts in sorted(rows, key=lambda r: (r[2], r[0])):
            m, d = (user, ts.replace(second=0)), (user, ts.date())
            minute[m], day[d] = minute.get(m, 0) + 1, day.get(d, 0) + 1
            out[n, rid] = "minute" if minute[m] > per_minute else "day" if day[d] > per_day else None
    return out


def test_late_and_repeated_requests_meet_their_own_counters(spark, tmp_path):
    rows = [(i, i % 3, START + timedelta(minutes=17 * i, seconds=i % 50)) for i in range(600)]
    slices = [[r for r in rows if r[0] * 7 % 3 == s] for s in range(3)]
    slices.append([(10_000 + r[0], *r[1:]) for r in rows if r[0] % 10 == 3] + [(20_000, 0, rows[0][2])])
    handle = rates.decisions(Parts(spark, f"{tmp_path}/counts", limits.COUNTS), per_minute=1, per_day=20)
    *_, got = run_slices(spark, slices, REQUESTS, handle, str(tmp_path))
    want = {rid: w for (_, rid), w in decided(slices, 1, 20).items()}
    assert {r.request_id: r.window for r in got} == want and want[20_000] == "minute"


def test_rate_state_is_rewritten_by_day_and_expires_safely(spark, tmp_path):
    counts = Parts(spark, f"{tmp_path}/counts", limits.COUNTS)
    handle = rates.decisions(counts, per_minute=2, per_day=3, keep_days=2)
    one = lambda rid, day: spark.createDataFrame([(rid, 1, START + timedelta(days=day, seconds=rid))], REQUESTS)
    for batch, day in enumerate([0, 1, 1, 4]):
        assert [r.window for r in handle(one(batch, day), batch).collect()] == [None]
    assert len(counts.versions()) == 3
    # day 1 is more than two days behind day 4: its counters are gone, so nothing passes for it
    for _ in range(2):
        assert [(r.rejected, r.window) for r in handle(one(9, 1), 4).collect()] == [(True, "expired")]
    assert len(counts.versions()) == 1


def test_first_contacts_in_any_order(spark, tmp_path):
    rows = [(i, f"s{i % 23}@a.example", f"r{i % 7}", START + timedelta(minutes=i * 37 % 500)) for i in range(300)]
    slices = [[r for r in rows if r[0] * 7 % 3 == s] for s in range(3)] + [[r for r in rows if r[0] % 10 == 3]]
    handle = contact.first_contacts(contact.PairStore(spark, f"{tmp_path}/pairs", 20))
    *_, got = run_slices(spark, slices, MAILS, handle, str(tmp_path))
    seen, want = set(), []
    for part in slices:
        for i, sender, recipient, ts in sorted(part, key=lambda r: (r[3], r[0])):
            if (sender, recipient) not in seen:
                seen.add((sender, recipient))
                want.append(i)
    assert sorted(r.email_id for r in got) == sorted(want)


def test_pairs_read_do_not_grow_with_the_batches(spark, tmp_path):
    store, read = contact.PairStore(spark, f"{tmp_path}/pairs", 40), []
    plain = store.known

    def known(pairs, batch):
        level, names, rows = plain(pairs, batch)
        read.append(rows.count())
        return level, names, rows

    store.known = known
    handle = contact.first_contacts(store)
    for batch in range(14):
        rows = [(i, f"s{batch}-{i}@a.example", "r", START) for i in range(40 if batch < 9 else 3)]
        assert handle(spark.createDataFrame(rows, MAILS), batch).count() == len(rows)
    # three senders a batch: at most three buckets, however much was stored before
    assert store.level(99) >= 2 and max(read[9:]) <= 3 * 2 * 40 < sum(40 for _ in range(9))


def test_repeated_batch_of_pairs_after_a_split(spark, tmp_path):
    store = contact.PairStore(spark, f"{tmp_path}/pairs", 5)
    handle = contact.first_contacts(store)
    rows = spark.createDataFrame([(i, f"s{i}@a.example", "r", START) for i in range(30)], MAILS)
    for _ in range(2):
        assert handle(rows, 0).count() == 30
    assert handle(rows, 1).count() == 0 and store.level(1) == 1


def test_window_totals_come_out_and_leave_the_state(spark, tmp_path):
    rows = [(i, i % 5, START + timedelta(seconds=11 * i)) for i in range(2000)]
    folder = str(tmp_path)
    for part in range(8):
        some = spark.createDataFrame([(r[1], r[2]) for r in rows[part * 250:(part + 1) * 250]], "user_id bigint, ts timestamp")
        some.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    end = spark.createDataFrame([(None, START + timedelta(days=3))], "user_id bigint, ts timestamp")
    end.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    query = batches.append(rates.window_counts(live.read(spark, f"{folder}/in", 1), "1 minute", "10 minutes"), folder)
    kept = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    want = {}
    for _, user, ts in rows:
        want[ts.replace(second=0), user] = want.get((ts.replace(second=0), user), 0) + 1
    got = {(r.bucket_start, r.user_id): r.requests for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == want
    assert max(kept) < len(want) / 3 and kept[-1] == 1


def test_parts_show_whole_versions_only(spark, tmp_path):
    parts = Parts(spark, f"{tmp_path}/p", "v bigint")
    rows = lambda *values: spark.createDataFrame(values, "v bigint, part string")
    assert parts.read().collect() == []
    parts.put(rows((1, "a"), (2, "b")), 0)
    parts.put(rows((3, "a")), 1, ["c"])
    rows((9, "a")).write.partitionBy("part").parquet(f"{tmp_path}/p/data/2")  # a write that broke off before its marks
    assert sorted(r.v for r in parts.read().collect()) == [2, 3]
    assert [r.v for r in parts.read(["a"], before=1).collect()] == [1]
    parts.put(rows((4, "a")), 2)
    assert parts.versions() == {"a": [1, 2], "b": [0], "c": [1]}
    parts.drop(["a"])
    assert [r.v for r in parts.read().collect()] == [2] and parts.read(["c"]).count() == 0
    assert parts.read().where(F.col("v") > 5).count() == 0


def test_landing_rows_are_written_once(spark, monkeypatch):
    """A slice goes from the table to the folder it lands in, without a copy of the whole table between."""
    from mailsieve.catalog import spark_queries

    monkeypatch.setattr(spark_queries, "cut_lineage", lambda df: pytest.fail("the landing rows are copied"))
    rows = spark.range(30).selectExpr("id", "'x' AS text", "CAST(id % 3 AS INT) AS _slice")
    out = spark_queries._live(rows, lambda folder: lambda batch, number: batch.select("id"))
    assert sorted(r.id for r in out.collect()) == list(range(30))


def test_keys_carry_their_times(spark, sf_dir):
    """The mails are made once for keys and times, without a join of the two."""
    from mailsieve.catalog import spark_queries, views

    keyed = spark_queries._keyed(spark, sf_dir).select("email_id", "send_ts")
    assert sorted(map(str, keyed.collect())) == sorted(map(str, views.emails(spark, sf_dir).select("email_id", "send_ts").collect()))
