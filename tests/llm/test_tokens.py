"""Token ids, packing and shards against the plain tokenizers library."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from mailsieve.functions.shared import new_path  # noqa: E402
from mailsieve.llm import boundaries, packing  # noqa: E402
from mailsieve.llm.tokens import Encoder  # noqa: E402

VOCABULARIES = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]
ODD = [
    "", " ", "a ", "a  b", "a   b ", "\n\n a", "a \n b", "x\0y z", "I'm 's it's 12 3", "e\u0301 a\tb", "<|endoftext|> a", "a\x1cb \x1c c",
    "ΑΣ ΟΔΟΣ. x", "a\u00a0b c", "\r\nab\r\nc d ", "… —  ''s", "the. The, THE.\nIt", "İstanbul ıi", "don't,ok.", None, "x" * 3000, "\u3000ab",
]
DOCS = "doc_id bigint, text string, start int, ids int"


@pytest.fixture(scope="module", params=VOCABULARIES, ids=["byte", "word"])
def coder(request):
    return Encoder(public_tokenizers.path(request.param[0]), request.param[1], memo_pieces=50)


def ids_of(coder, texts):
    out = []
    for _, ids, offsets in coder.encode(pa.array(texts, pa.string())):
        out += [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]
    return out


def plain(coder, text):
    return coder.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_odd_texts(coder):
    assert ids_of(coder, ODD) == [plain(coder, t) for t in ODD]
    assert ids_of(coder, []) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aBcé .,'!\n\t\u00a0\u0301ſK12<|>\u3000漢", max_size=30), max_size=5))
def test_any_text(coder, texts):
    assert ids_of(coder, texts) == [plain(coder, t) for t in texts]


@pytest.mark.parametrize("values", [[1], [0, 0, 5], [1, 1, 1, 1], [3, 9, 9, 1000], list(range(1, 5000, 7)), [0], [10**6, 10**9]])
def test_elias_fano(values):
    marks = boundaries.EliasFano.build(np.array(values))
    again = boundaries.EliasFano(marks.size, marks.low_bits, marks.low, marks.high)
    assert again.select(np.arange(len(values))).tolist() == values
    if len(values) > 100:
        assert (len(marks.low) + len(marks.high)) * 8 <= len(values) * (3 + np.log2(values[-1] / len(values)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=300))
def test_elias_fano_any(values):
    values.sort()
    marks = boundaries.EliasFano.build(np.array(values))
    assert marks.select(np.arange(len(values))).tolist() == values


@pytest.fixture(scope="module")
def rows():
    return [(5, "b c d", 1, 1), (None, "null id", 1, 1), (3, None, 1, 1), (3, "", 1, 1), (5, "b c d", 1, 1), (-2, "long " * 3000, 1, 1),
            *[(10 + i, t, 0, 0) for i, t in enumerate(ODD)]]


def test_shards_round_trip(spark, rows):
    name, byte_level = VOCABULARIES[1]
    path = new_path(spark, "shards")
    boundaries.write(boundaries.encode(spark.createDataFrame(rows, DOCS), public_tokenizers.path(name), 1, byte_level), path)
    got = boundaries.read(spark, path).orderBy("start").collect()
    coder = Encoder(public_tokenizers.path(name), byte_level)
    order = [r.doc_id for r in got]
    assert order == [None, *sorted(x[0] for x in rows if x[0] is not None)]
    start, left = 0, [(r[0], plain(coder, r[1]) + [1]) for r in rows]
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        left.remove((r.doc_id, ids))
        assert (r.start, r.n_tokens) == (start, len(ids))
        start += len(ids)
    assert not left


def test_no_documents(spark):
    none = spark.createDataFrame([], DOCS)
    path = new_path(spark, "shards")
    boundaries.write(boundaries.encode(none, public_tokenizers.path("word_bpe_49k.json"), 1), path)
    assert boundaries.read(spark, path).count() == 0
    assert packing.place(packing.cut_documents(none, public_tokenizers.path("byte_bpe_50k.json"), 0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 5000), min_size=1, max_size=20), st.sampled_from([(1024, 64), (8, 8), (16, 1)]))
def test_piece_lengths(tokens, sizes):
    lengths, counts = packing.piece_lengths(np.array(tokens), *sizes)
    assert [int(x.sum()) for x in np.split(lengths, np.cumsum(counts)[:-1])] == tokens
    assert lengths.min() > 0 and lengths.max() <= sizes[0]


def test_packing(spark, rows):
    coder = Encoder(public_tokenizers.path("byte_bpe_50k.json"), True)
    docs = spark.createDataFrame(rows, DOCS)
    got = packing.place(packing.cut_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 0)).collect()
    want = sorted(zlib.crc32(np.array(plain(coder, r[1]) + [0], "<u4").tobytes()) for r in rows if r[0] not in (3, 5, None))
    by_doc, by_sequence = {}, {}
    for r in got:
        assert len(r.ids) == 4 * r.length
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length, r["class"]))
    assert sorted(zlib.crc32(b"".join(p.ids for p in sorted(v, key=lambda p: p.start))) for k, v in by_doc.items() if k not in (3, 5, None)) == want
    assert sum(r.length for r in got) == sum(len(plain(coder, r[1])) + 1 for r in rows)
    for parts in by_sequence.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_full_bins_hold_a_fixed_count(spark):
    docs = spark.createDataFrame([(i, "a " * 40) for i in range(2000)], "doc_id bigint, text string")
    got = packing.place(packing.cut_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 0).drop("ids"))
    sizes = [r["count"] for r in got.groupBy("sequence_id", "class").count().where("count = class").collect()]
    used = got.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert len(sizes) >= len(used) - 1
    assert sum(r[1] for r in used) / (1024 * len(used)) > 0.9
