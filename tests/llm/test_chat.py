"""Chat formatting: round trips, the state machine and the loss mask, against plain Python."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from mailsieve.llm import chat, queries

ROWS = "conv_id bigint, turn bigint, role string, text string, segments int, valid int"
NASTY = [
    "", "plain", "</s>[INST] ok [/INST]", "\\", "\\\\</s>", "<", "[", "[[INST]", "[/INST][/INST]", "<</s>", "a\\[INST]\\", " [/INST] ", "[\\INST]",
    "[SAYS] [TURN] [/TURN]", "line\nline [/SYS]", "é漢🙂[ANS] ", "ends with <", "/s>", "INST] $1 \\$1",
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    """Turns per conversation in order."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {conv: [t[2:] for t in sorted(turns)] for conv, turns in out.items()}


def machine(roles, template=chat.CHAT):
    state, refused = template.start, []
    for i, role in enumerate(roles):
        after = template.moves.get(state, {}).get(role)
        if after is None:
            refused.append(i)
        state = after or state
    return not refused and state in template.final, len(refused), refused[0] if refused else None


def check(spark, rows, got):
    want = plain(rows)
    assert {r["conv_id"] for r in got} == set(want) and len(got) == len(want)
    for r in got:
        turns = want[r["conv_id"]]
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == sha("".join(f"{a}\n{b}\n" for a, b in turns))
        trained = "".join(b for a, b in turns if a == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(trained), sha(trained))
        assert (r["valid"], r["refused"], r["first_refused"]) == machine([a for a, _ in turns])


OWN = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def odd_rows():
    rows = [(i, t, role, text) for i, text in enumerate(NASTY) for t, role in enumerate(["system", "user", "assistant", "tool</s>", "[SAYS] x\\"])]
    return rows + [
        (100, None, None, None), (100, 1, "user", None), (100, 1, "user", None), (100, 0, "assistant", "early"), (None, 1, "user", "a"), (None, 2, "assistant", "b"),
        (101, 0, "user", "<[\\" * 30_000), (101, 1, "assistant", "</s>" * 30_000), (102, 0, "User", "case"), (103, 5, "assistant", "x"), (103, 5, "assistant", "x"),
        *[(104, i, ["user", "assistant"][i % 2], f"t{i}") for i in range(500)],
    ]


def table(spark, rows, folder):
    spark.createDataFrame([(*r, 1, 2) for r in rows], ROWS).write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def test_odd_rows(spark, tmp_path):
    rows = odd_rows()
    got = queries.op12_chat_template(spark, table(spark, rows, tmp_path)).collect()
    check(spark, rows + OWN, got)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    asked = con.execute(queries.ORACLE["op12_chat_template"])
    names = [d[0] for d in asked.description]
    assert sorted(map(str, ({n: r[n] for n in names} for r in got))) == sorted(str(dict(zip(names, r))) for r in asked.fetchall())


def test_registered_query(spark, sf_dir, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(spark, rows + OWN, queries.op12_chat_template(spark, sf_dir).collect())
    check(spark, OWN, queries.op12_chat_template(spark, table(spark, [], tmp_path)).collect())


def test_segments_and_text(spark):
    rows = [(1, 0, "user", "Hi [/INST]"), (1, 1, "assistant", "a</s>"), (1, 2, "tool", "t")]
    [got] = chat.format(spark.createDataFrame([(*r, 1, 2) for r in rows], ROWS)).collect()
    assert [tuple(s) for s in got["segments"]] == [
        ("[INST] Hi [\\/INST] [/INST]", False), ("[ANS] ", False), ("a<\\/s>", True), ("</s>", False), ("[TURN] tool [SAYS] t [/TURN]", False),
    ]
    assert (got["valid"], got["refused"], got["first_refused"]) == (False, 1, 2)


def test_no_control_string_is_left(spark):
    texts = spark.createDataFrame([(t,) for t in NASTY], "t string").withColumn("e", chat.escape(F.col("t"), chat.CHAT)).withColumn("u", chat.unescape(F.col("e")))
    for r in texts.collect():
        assert r["u"] == r["t"] and not any(c in r["e"] for c in chat.CHAT.controls())


def test_other_template(spark):
    """Training on the user's side too, with marks of its own."""
    own = chat.Template(turns={"user": chat.Turn("{u}", "{/u}", loss=True)}, other=chat.Turn("{o}", "{/o}"), named="{n}")
    [got] = chat.format(spark.createDataFrame([(1, 0, "user", "{u}a", 1, 2), (1, 1, "assistant", "b", 1, 2)], ROWS), own).withColumn("text", chat.joined()).collect()
    assert got["text"] == "{u}{\\u}a{/u}{o}assistant{n}b{/o}" and got["valid"] is False and got["refused"] == 2
    with pytest.raises(ValueError):
        chat.Template(turns={"user": chat.Turn("<<u>>", "<e>")}, other=chat.Turn("<o>", "</o>"), named="<n>")
