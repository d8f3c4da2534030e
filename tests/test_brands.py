"""Brands by the table: equal to comparing everything with everything."""

import random

from helpers import found, mails
from pyspark.sql import functions as F

from mailsieve import fixed_values as V
from mailsieve.operators import brands, domains
from mailsieve.catalog import views as W


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def words(seed, n, letters="abc.é"):
    dice = random.Random(seed)
    return sorted({"".join(dice.choice(letters) for _ in range(dice.randrange(7))) for _ in range(n)})


def test_near_equals_all_pairs(spark):
    names, known = words(1, 150), words(2, 120)
    got = brands.near(
        spark.createDataFrame([(n,) for n in [*names, None]], "name string"), spark.createDataFrame([(b,) for b in [*known, None, *known[:5]]], "brand string")
    )
    want = {(n, b): distance(n, b) for n in names for b in known}
    assert {(r.name, r.brand): r.edits for r in got.collect()} == {k: d for k, d in want.items() if 1 <= d <= 2}
    none = brands.near(spark.createDataFrame([("a",)], "name string"), spark.createDataFrame([], "brand string"))
    assert none.collect() == []


def test_subdomain_rules_equal_all_pairs(spark):
    labels = ["a", "shop", "pay", "com", "net", "x-y", ""]
    dice = random.Random(3)
    hosts = sorted({".".join(dice.choice(labels) for _ in range(dice.randrange(1, 5))) for _ in range(200)})
    known = sorted({".".join(dice.choice(labels[:-1]) for _ in range(dice.randrange(1, 4))) for _ in range(60)})
    reg = lambda h: ".".join(h.rstrip(".").split(".")[-2:]) if "." in h.rstrip(".") else h
    senders = spark.createDataFrame([(h, reg(h)) for h in hosts], "domain string, reg string")
    table = spark.createDataFrame([(b,) for b in known], "brand string")
    prefix = {(h, b) for h in hosts for b in known if h.startswith(b + ".") and reg(h) != b}
    first = lambda b: b.split(".")[0]
    label = {(h, b) for h in hosts for b in known if first(b) in h.split(".") and reg(h) not in (b, first(b) + ".com") and not h.endswith("." + b)}
    for limit in (0, 1 << 26):
        assert {tuple(r) for r in brands.prefixed(senders, table, limit=limit).collect()} == prefix
        assert {tuple(r) for r in brands.labelled(senders, table, limit=limit).collect()} == label


def test_the_table_gives_what_the_list_gives(spark):
    rows = [{"sender": f"u@{d}"} for d in [*W.DOMAINS, "", "paypal.com.paypal.com.x.ru", "amaz0n.com"]] + [{"sender": "none"}]
    df = mails(spark, *rows)
    table = spark.createDataFrame([(b,) for b in V.BRANDS], "brand string")
    by_list = found(domains.add(df, W.AS_OF.date()), "domains_findings")
    for limit in (0, 1 << 26):
        assert found(brands.add(df, W.AS_OF.date(), table, limit=limit), "domains_findings") == by_list


def test_a_hundred_thousand_brands_without_comparing_all(spark):
    table = spark.range(100_000).selectExpr("concat(substr(sha2(cast(id as string), 256), 1, 12), '.com') AS brand")
    names = spark.range(3_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN concat('x', substr(sha2(cast(id as string), 256), 2, 11), '.com') ELSE concat(substr(sha2(cast(-id as string), 256), 1, 12), '.com') END AS name"
    )
    out = brands.near(names, table)
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {tuple(r) for r in out.collect()}
    sample = names.where("hash(name) % 50 = 0").crossJoin(F.broadcast(table)).withColumn("edits", F.levenshtein("name", "brand", 2)).where("edits >= 1")
    some = {r.name for r in names.where("hash(name) % 50 = 0").collect()}
    assert {tuple(r) for r in sample.collect()} == {g for g in got if g[0] in some} and len(got) >= 900
