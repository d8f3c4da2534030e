"""The Merkle manifest against a tree built in plain Python."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from mailsieve.llm import merkle, queries

DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree string, rank int, digest string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def way(tree, at):
    out = []
    for level in tree[:-1]:
        other = level[at ^ 1] if at ^ 1 < len(level) else ""
        out.append((other, "") if at & 1 else ("", other))
        at >>= 1
    return out


def expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0], leaf_of(row), row))
    keys = sorted(groups, key=lambda k: b"" if k is None else b"=" + k.encode())
    for key in keys:
        groups[key].sort(key=lambda g: (g[0] is not None, g[0] or 0, g[1]))
    trees = {k: levels([g[1] for g in groups[k]]) for k in keys}
    top = levels([trees[k][-1][0] for k in keys])
    out = []
    for place, key in enumerate(keys):
        for at, (doc_id, leaf, row) in enumerate(groups[key]):
            proof = way(trees[key], at) + way(top, place)
            folded = leaf
            if doc_id is not None and row[3] is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0:
                folded = leaf_of((*row[:3], row[3] + 1, row[4]))
            for left, right in proof:
                folded = sha(left, folded, right)
            out.append((doc_id, leaf, trees[key][-1][0], top[-1][0], sha(*[a + b for a, b in proof]), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def table(spark, rows, tmp_path):
    """As a documents table with extra columns named like the operator's own."""
    spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def got(spark, folder):
    return sorted(map(tuple, queries.op11_merkle_manifest(spark, folder).collect()), key=str)


ODD = [
    (1, None, None, None, None), (None, "s", "en", 3, "no id"), (None, "s", "en", 3, "no id"), (None, "t", "en", 3, "another"),
    (5, "s", "en", 9223372036854775807, "é" * 5000), (5, "s", "en", 2, ""), (5, "s", "en", 2, ""), (-7, "s", "éé", 2, "a:b"),
    (9, "", "zz", 0, "-"), (13, "s", "", None, "empty language"), (26, "s", "en", None, "no count"),
]


def test_odd_rows(spark, tmp_path):
    assert got(spark, table(spark, ODD, tmp_path)) == expected(ODD)


@pytest.mark.parametrize("count", [1, 2, 3, 256, 257, 513])
def test_sizes(spark, tmp_path, count):
    """One language of each size, beside one of a single row, over the borders of a record."""
    rows = [(i, "s", "en", i, f"text {i}") for i in range(count)] + [(7, "s", "fr", 1, "un")]
    assert got(spark, table(spark, rows, tmp_path)) == expected(rows)


def test_one_language_and_none(spark, tmp_path):
    rows = [(3, "s", "en", 1, "only")]
    assert got(spark, table(spark, rows, tmp_path / "one")) == expected(rows)
    assert got(spark, table(spark, [], tmp_path / "none")) == []


def test_registered_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    want = expected(rows)
    assert got(spark, sf_dir) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert sorted(con.execute(queries.ORACLE["op11_merkle_manifest"]).fetchall(), key=str) == want


def test_store_and_single_requests(spark):
    """Equal subtrees are one record, and a few requests get the same proofs as all."""
    rows = [("a", i, f"{i % 8:064x}") for i in range(1024)]
    made = merkle.manifest(spark.createDataFrame(rows, "tree string, at bigint, digest string"), ["at"])
    assert [part.count() for part in made.store] == [1, 1]  # four equal blocks of 256, one record above them
    every = {r["at"]: r for r in merkle.prove(made).collect()}
    few = merkle.prove(made, spark.createDataFrame([("a", 0, "x"), ("a", 700, "y"), ("a", 2000, "out")], "tree string, rank bigint, note string"))
    few = {r["note"]: r for r in few.collect()}
    assert few["x"]["proof"] == every[0]["proof"] and few["y"]["proof"] == every[700]["proof"]
    assert few["y"]["found"] == rows[700][2] and all(r["digest"] == r["found"] for r in every.values())
    assert few.get("out") is None or few["out"]["found"] is None
    folded = merkle.prove(made).select(merkle.fold(F.col("found"), F.col("proof")).alias("r")).distinct().collect()
    assert [r["r"] for r in folded] == [made.root]
