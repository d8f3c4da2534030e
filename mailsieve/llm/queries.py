"""One query for each operator, with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from mailsieve.functions.shared import cut, new_path
from mailsieve.llm import alignment, boundaries, chat, merkle, mixing, neardup, packing, quality, secrets, toxicity, urls, vectors, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Target shares of the sources in the mix, out of a hundred; every other source shares one part in a hundred.
SHARES = {"src0": 19, **{f"src{i}": 8 for i in range(1, 5)}, **{f"src{i}": 3 for i in range(5, 20)}}

URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(toxicity.fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op2_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archive")
    warc.write_archive(_table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).select(
        "page_id", F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), "record_type", "refers_to",
    )


def op3_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its source, its block there, the block's slot in the mix and its place in the block."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, SHARES)


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    pieces = packing.cut_documents(docs, _vocabulary("byte_bpe_50k.json"), end_id=0)
    digests = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.place(digests)


def op5_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs, trusted).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score",
    )


def op7_elias_fano_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    path = new_path(spark, "shards")
    boundaries.write(boundaries.encode(docs, _vocabulary("word_bpe_49k.json"), end_id=1), path)
    return boundaries.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, _vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"].isin(secrets.KINDS))
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in secrets.KINDS],
        F.sha2(secrets.written(base).cast("binary"), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"),
    )


def op10_url_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "action string, rule string")
    return urls.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), rules)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document; every seventh by the checksum of its id is tampered with before it is folded."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    changed = merkle.digest_of(*[more if f == "n_chars" else F.col(f) for f in fields])
    leaves = cut(_table(spark, sf_dir, "documents").select(
        merkle.group_key(F.col("lang")).alias("tree"), "doc_id", merkle.digest_of(*map(F.col, fields)).alias("digest"),
        F.when(chosen & F.col("n_chars").isNotNull(), changed).alias("changed"),
    ), "digests")
    made = merkle.manifest(leaves, ["doc_id", "digest"])
    rows = merkle.prove(made).select(
        "doc_id", F.col("found").alias("leaf"), F.col("top").alias("subroot"), F.lit(made.root).alias("root"),
        merkle.siblings(F.col("proof")).alias("proof_sha256"), merkle.fold(F.coalesce("changed", "digest"), F.col("proof")).alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the conversations read back from the formatted text and its loss mask."""
    own = spark.range(2).selectExpr(
        "CAST(-1 AS BIGINT) AS conv_id", "id AS turn", "CASE id WHEN 0 THEN 'user' ELSE 'assistant' END AS role", "'</s>[INST] ok [/INST]' AS text"
    )
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    path = new_path(spark, "chat")
    chat.write(rows.unionByName(own), path)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chat.read(spark, path).select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("trained").cast("bigint").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"), "valid", "refused", "first_refused",
    )


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.measure(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nnpu_toxicity": op1_nnpu_toxicity,
    "op2_content_addressed_warc": op2_content_addressed_warc,
    "op3_pfair_mixing": op3_pfair_mixing,
    "op4_harmonic_packing": op4_harmonic_packing,
    "op5_sorted_projections": op5_sorted_projections,
    "op6_ngram_ratio": op6_ngram_ratio,
    "op7_elias_fano_ids": op7_elias_fano_ids,
    "op8_weighted_minhash": op8_weighted_minhash,
    "op9_secret_scans": op9_secret_scans,
    "op10_url_sweep": op10_url_sweep,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_chat_template": op12_chat_template,
    "op13_token_alignment": op13_token_alignment,
}

# page_id order decides which of equal pages is stored; base32 from forty-bit groups of the digest
_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d
"""

_URL_SQL = """
WITH r(action, rule, h, p) AS (VALUES
  ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
  ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
a AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict
FROM c LEFT JOIN LATERAL (
  SELECT rule, action FROM r WHERE (c.host = h OR ends_with(c.host, '.' || h)) AND starts_with(c.path, p)
  ORDER BY length(rule) DESC, length(h) DESC, action DESC LIMIT 1) best ON true
"""



def _crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit."""
    byte = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i::INT, 1))::BIGINT)"
    step = "list_reduce(range(8), lambda x, k: (CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)::BIGINT, xor(c, b)::BIGINT)"
    return f"xor(list_reduce({byte}, lambda c, b: {step}, 4294967295::BIGINT), 4294967295)"


def _leaf_sql(n_chars: str) -> str:
    fields = ["doc_id", "source", "lang", n_chars, "text"]
    parts = [f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in fields]
    return "sha256(" + " || ".join(parts) + ")"


def _nodes_sql(name: str, leaves: str) -> str:
    return f"""{name}(l, tree, r, d, n) AS (
  SELECT 0, tree, r, d, n FROM {leaves} UNION ALL
  SELECT l + 1, tree, r // 2, sha256(string_agg(d, '' ORDER BY r)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY l, tree, r // 2, n)"""


def _way_sql(name: str, nodes: str, start: str) -> str:
    """Up a tree: the digest of the way so far and the siblings met."""
    return f"""{name}(id, tree, l, r, n, acc, proof) AS (
  SELECT * FROM ({start}) UNION ALL
  SELECT w.id, w.tree, w.l + 1, w.r // 2, (w.n + 1) // 2,
    sha256(CASE WHEN w.r % 2 = 1 THEN s.d || w.acc ELSE w.acc || coalesce(s.d, '') END), w.proof || coalesce(s.d, '')
  FROM {name} w LEFT JOIN {nodes} s ON s.tree = w.tree AND s.l = w.l AND s.r = xor(w.r, 1) WHERE w.n > 1)"""


_MERKLE_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce('=' || lang, '') AS tree, {_leaf_sql("n_chars")} AS d,
    CASE WHEN n_chars IS NOT NULL AND {_crc32_sql("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf_sql("(n_chars::HUGEINT + 1)")} END AS changed
  FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS r, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
{_nodes_sql("nodes", "ranked")},
subroots AS (SELECT tree AS key, '' AS tree, d, row_number() OVER (ORDER BY tree) - 1 AS r, count(*) OVER () AS n FROM nodes WHERE n = 1),
{_nodes_sql("tops", "subroots")},
{_way_sql("up", "nodes", "SELECT id, tree, 0, r, n, coalesce(changed, d), '' FROM ranked")},
{_way_sql("over", "tops", "SELECT u.id, s.tree, 0, s.r, s.n, u.acc, u.proof FROM up u JOIN subroots s ON s.key = u.tree WHERE u.n = 1")}
SELECT k.doc_id, k.d AS leaf, s.d AS subroot, root.d AS root, sha256(o.proof) AS proof_sha256, o.acc AS folded_root, o.acc = root.d AS verified
FROM over o JOIN ranked k ON k.id = o.id JOIN subroots s ON s.key = k.tree JOIN tops root ON root.n = 1 WHERE o.n = 1
"""



def _chat_sql(template: chat.Template) -> str:
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def extra(column: str) -> str:
        """Characters that the escape adds."""
        return " + ".join(f"(length({column}) - length(replace({column}, {quoted(c)}, ''))) // {len(c)}" for c in [*template.controls(), "\\"])

    marks = " ".join(f"WHEN {quoted(role)} THEN {len(t.begin + t.end)}" for role, t in template.turns.items())
    other = f"{len(template.other.begin + template.named + template.other.end)} + length(role) + {extra('role')}"
    trained = ", ".join(quoted(role) for role, t in template.turns.items() if t.loss)
    moves = ", ".join(f"({quoted(s)}, {quoted(r)}, {quoted(a)})" for s, to in template.moves.items() for r, a in to.items())
    final = ", ".join(map(quoted, template.final))
    return f"""
WITH RECURSIVE rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i FROM rows),
moves(state, role, after) AS (VALUES {moves}),
ran(conv_id, i, state, refused, first_refused) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, {quoted(template.start)}, 0, NULL::INT FROM t
  UNION ALL
  SELECT r.conv_id, r.i + 1, coalesce(m.after, r.state), r.refused + (m.after IS NULL)::INT,
    coalesce(r.first_refused, CASE WHEN m.after IS NULL THEN r.i::INT END)
  FROM ran r JOIN t ON t.conv_id IS NOT DISTINCT FROM r.conv_id AND t.i = r.i LEFT JOIN moves m ON m.state = r.state AND m.role = t.role),
told AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY i) FILTER (role IN ({trained})), '') AS trained,
  sum(CASE role {marks} ELSE {other} END + length(text) + {extra('text')})::BIGINT AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT k.conv_id, n_turns, turns_sha256, length(trained) AS loss_chars, sha256(trained) AS loss_sha256, formatted_chars,
  refused = 0 AND state IN ({final}) AS valid, refused, first_refused
FROM told k JOIN ran r ON r.conv_id IS NOT DISTINCT FROM k.conv_id AND r.i = k.n_turns
"""


ORACLE: dict[str, str] = {
    "op2_content_addressed_warc": _WARC_SQL, "op10_url_sweep": _URL_SQL, "op11_merkle_manifest": _MERKLE_SQL, "op12_chat_template": _chat_sql(chat.CHAT),
}
