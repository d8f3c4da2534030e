"""Token alignment against both libraries over whole texts, token by token."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mailsieve.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id bigint, text string, pair int, count int, text_key string, best string"
ODD = [
    None, "", " ", "  ", "a", "a ", " a  b", "a\n b\n\n c", "x\0y z", "é ﬁ", "▁ marked ▁▁ text", "a▁ b", "<|endoftext|> <s> </s> <unk> <0x41>",
    "漢字 🙂🙂 ünïcode ЖЖ", "tabs\t\tand spaces　here", "a\x1c b", "word " * 700, "x" * 2500, "Same text", "Same text", "1234567 89.0 -- ...!!!",
]


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    bs, cs = [*range(33, 127), *range(161, 173), *range(174, 256)], 256
    letters = {chr(x): x for x in bs}
    for x in range(256):
        if x not in bs:
            letters[chr(cs)] = x
            cs += 1

    def encode(text):
        """Ids and end offsets of both; None without tokens."""
        if not text:
            return None
        data, out = (" " + text).encode(), []
        ids = a.encode(" " + text, add_special_tokens=False).ids
        out.append((ids, [bytes(letters[c] for c in a.id_to_token(i)) for i in ids]))
        ids = b.encode(text)
        out.append((ids, [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids]))
        if any(b"".join(parts) != data for _, parts in out):
            return None
        return [(ids, [sum(map(len, parts[:k + 1])) for k in range(len(parts))]) if len(ids) < 50 else (ids, ends(parts)) for ids, parts in out]

    def ends(parts):
        at, got = 0, []
        for p in parts:
            at += len(p)
            got.append(at)
        return got

    return encode


def groups_of(coded):
    (a, ea), (b, eb) = coded
    shared, out, i, j = sorted(set(ea) & set(eb)), [], 0, 0
    for end in shared:
        i2, j2 = ea.index(end, i) + 1, eb.index(end, j) + 1
        out.append((a[i:i2], b[j:j2]))
        i, j = i2, j2
    return out


def expected(plain, rows):
    coded = [(doc_id, plain(text)) for doc_id, text in rows]
    found = [(doc_id, c, groups_of(c) if c else []) for doc_id, c in coded]
    counts = Counter((g[0][-1], g[1][-1]) for _, _, groups in found for g in groups)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for doc_id, c, groups in found:
        links = [(g[0][-1], g[1][-1]) for g in groups]
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((doc_id, len(c[0][0]) if c else 0, len(c[1][0]) if c else 0, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links),
                    sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if c else ""))
    return sorted(out, key=str)


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "k", "b") for r in rows], DOCS)


ROWS = [*enumerate(ODD), (None, "no id here"), (3, "another text under one id"), (7, ODD[7]), (7, ODD[7])]


@pytest.mark.parametrize("limit", [alignment.BROADCAST_BYTES, 0], ids=["broadcast", "shuffled"])
def test_odd_texts(spark, plain, limit):
    got = sorted(map(tuple, alignment.measure(docs(spark, ROWS), A, B, limit=limit).collect()), key=str)
    assert got == expected(plain, ROWS)


def test_nothing(spark):
    assert alignment.measure(docs(spark, []), A, B).collect() == []
    assert [tuple(r)[1:] for r in alignment.measure(docs(spark, [(1, None)]), A, B).collect()] == [(0, 0, 0, 0, 0, 0, "")]


def test_registered_query(spark, plain, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_token_alignment(spark, sf_dir)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(plain, rows)


def test_pair_table(spark, plain):
    _, pairs = alignment.align_texts(docs(spark, ROWS), A, B)
    counts = Counter((g[0][-1], g[1][-1]) for _, t in ROWS if plain(t) for g in groups_of(plain(t)))
    assert {(r["a_id"], r["b_id"]): r["count"] for r in pairs.collect()} == counts
    assert pairs.where(F.col("best")).select("b_id").distinct().count() == len({b for _, b in counts})


def aligned(plain, texts):
    got = alignment.Aligner(alignment._tokenizers(A, B)).align(pa.array([" " + t for t in texts], pa.string()))
    for i, text in enumerate(texts):
        want = plain(text)
        groups = groups_of(want) if want else []
        written = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        assert (got["n_a"][i], got["n_b"][i], got["n_groups"][i]) == ((len(want[0][0]), len(want[1][0]), len(groups)) if want else (0, 0, 0)), text
        assert got["groups_sha256"][i] == (hashlib.sha256(written.encode()).hexdigest() if want else "")
        assert got["pairs"][got["text"] == i].tolist() == [g[0][-1] * alignment.PAIR + g[1][-1] for g in groups]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aBcé ▁.,'!\n\t\u00a0\u0301ſK12<|>s/\u3000漢\0", min_size=1, max_size=40), min_size=1, max_size=6))
def test_any_text(plain, texts):
    aligned(plain, texts)


def test_slices_of_odd_texts(plain):
    texts = [t for t in ODD if t]
    aligned(plain, texts)
    aligned(plain, texts[::-1] + texts)
