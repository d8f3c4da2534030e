"""Two tokenizers' ids for the same texts, aligned by byte offsets.

Texts are shuffled by their full text, so that each distinct text is tokenised and aligned
once; its pair counts are weighted by how many documents hold it, and its measures are joined
back to the documents by a digest.  ``A`` is a byte-level vocabulary, ``B`` a sentencepiece one
that puts a space before a text; both see the space and the text.

Tokenising cuts texts at places that no token of either vocabulary reaches over (checked when
they are opened) and encodes each distinct piece of a slice once.  Aligning is array work over a
slice of texts: the running sums of both sides' token lengths, and where they meet.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from mailsieve.functions.shared import cut, ship
from mailsieve.llm.tokens import Encoder, Memo, column, gather
from mailsieve.operators.lookup import BROADCAST_BYTES, bounded, lookup

PAIR = 1 << 15  # a pair of ids is A * PAIR + B
SLICE_BYTES = 2 << 20  # of text, or one text that is longer
MEMO_PIECES = 200_000  # kept by a task, for each vocabulary
FREQUENT = 1_000
COUNTED = 1_000_000  # distinct pairs counted in a task before they are handed on
DIGITS = 6  # of a token in the written groups: five of the id and a separator

FOUND = (
    "text_key binary, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<int>, times array<int>, "
    "pair int, count bigint"
)
_SCHEMA = pa.schema([
    ("text_key", pa.binary()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("pair", pa.int32()), ("count", pa.int64()),
])


class TokenBytes:
    """The bytes of every token of a vocabulary, one after the other."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.begins[ids] - (ends - sizes), sizes)
        at += np.arange(len(at))
        return self.data[at]


class Tokenizers:
    """Both vocabularies.  Their size does not depend on the texts."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        from mailsieve.llm.tokens import _byte_letters

        self.a_path = a_path
        byte_of = {letter: byte for byte, letter in _byte_letters().items()}
        vocabulary = Tokenizer.from_file(a_path).get_vocab()
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            tokens[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        # what the cuts and the packing of pairs rest on
        if any(re.search("[^▁]▁|.\n|\n.", p) for p in pieces) or len(pieces) > PAIR or len(tokens) * PAIR > 1 << 31:
            raise ValueError("these vocabularies cannot be aligned piece by piece")
        self.a_bytes = TokenBytes(tokens)
        self.b_bytes = TokenBytes([bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.b_space = self.b.piece_to_id("▁")
        self.written = _written(len(tokens), len(pieces))


def _written(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Every id as it is written, and how long that is: ids of A before a comma, before a bar, ids of
    B before a comma, before a semicolon."""
    texts = [f"{i}{end}" for n, ends in ((a, ",|"), (b, ",;")) for end in ends for i in range(n)]
    return np.array([list(t.ljust(DIGITS).encode()) for t in texts], np.uint8), np.array([len(t) for t in texts], np.int64)


_OPEN: dict[tuple[str, str], Tokenizers] = {}


def _tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """One per worker process: the vocabularies alone, no memo."""
    if (a_path, b_path) not in _OPEN:
        _OPEN[a_path, b_path] = Tokenizers(a_path, b_path)
    return _OPEN[a_path, b_path]


class Aligner:
    """A task's memos of pieces; they go when the task ends."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        # the cut behind a letter is A's alone
        self.a, self.memo = Encoder(tokenizers.a_path, True, MEMO_PIECES, signs=False), Memo(MEMO_PIECES)

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """B's ids of distinct pieces.  The library puts a space before what it is given: it takes the
        place of a piece's own, and else comes off again, apart behind a line break."""
        given = [p[1:] if p[:1] == " " else "\n" + p for p in pieces]
        got = self.tokenizers.b.encode(given, num_threads=1)
        space = [self.tokenizers.b_space]
        return [array("I", (ids or space) if p[:1] == " " else ids[2:]).tobytes() for p, ids in zip(pieces, got)]

    def _encode(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both vocabularies, each with the places where the texts' ids begin."""
        cuts = self.a.cut(texts)
        coded = cuts.flatten().dictionary_encode()
        return [gather(*memo.ids(coded.dictionary, learn), cuts, coded) for memo, learn in ((self.a.memo, self.a.learn), (self.memo, self._learn))]

    def align(self, texts: pa.Array) -> dict[str, np.ndarray | list[str]]:
        """Of texts with the space before them: numbers of tokens and groups, digest of the groups, and
        the linked pairs with the number of their text.  A text whose bytes a side does not give has none."""
        own = self.tokenizers
        begins = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[begins[0]:begins[-1]]
        begins = begins - begins[0]
        sides = self._encode(texts)
        sound = np.ones(len(texts), bool)
        for (ids, at), table in zip(sides, (own.a_bytes, own.b_bytes)):
            ends = np.r_[0, np.cumsum(table.sizes[ids])]
            sound &= np.diff(ends[at]) == np.diff(begins)
        sides = [_only(ids, at, sound) for ids, at in sides]
        wanted = data[np.repeat(sound, np.diff(begins))]
        same = np.ones(len(wanted), bool)
        for (ids, _), table in zip(sides, (own.a_bytes, own.b_bytes)):
            same &= table.joined(ids) == wanted
        if not same.all():
            ends = np.r_[0, np.cumsum(same)][np.r_[0, np.cumsum(np.where(sound, np.diff(begins), 0))]]
            exact = sound & (np.diff(ends) == np.diff(begins))
            sides = [_only(ids, at, exact) for ids, at in sides]
        (a, a_at), (b, b_at) = sides
        a_ends, b_ends = np.cumsum(own.a_bytes.sizes[a]), np.cumsum(own.b_bytes.sizes[b])
        meet = np.searchsorted(b_ends, a_ends)
        closes = b_ends[np.minimum(meet, len(b) - 1)] == a_ends if len(b) else np.zeros(0, bool)
        a_last, b_last = np.flatnonzero(closes), meet[closes]
        closed = np.r_[0, np.cumsum(closes)]
        groups_at = closed[a_at]
        return {
            "n_a": np.diff(a_at), "n_b": np.diff(b_at), "n_groups": np.diff(groups_at),
            "groups_sha256": self._digests(a, b, a_at, b_at, closes, b_last),
            "pairs": (a[a_last].astype(np.int64) * PAIR + b[b_last]).astype(np.int32), "text": np.repeat(np.arange(len(texts)), np.diff(groups_at)),
        }

    def _digests(self, a, b, a_at, b_at, closes, b_last) -> list[str]:
        """Each text's groups, written: the tokens of A up to where the sides meet, then those of B."""
        letters, sizes = self.tokenizers.written
        n_a, n_b = len(self.tokenizers.a_bytes.sizes), len(self.tokenizers.b_bytes.sizes)
        b_closes = np.zeros(len(b), bool)
        b_closes[b_last] = True
        a_group, b_group = np.cumsum(closes) - closes, np.cumsum(b_closes) - b_closes
        codes = np.zeros(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.r_[0, b_last + 1][a_group]] = a + n_a * closes.astype(np.int64)
        codes[np.arange(len(b)) + (np.flatnonzero(closes) + 1)[b_group]] = 2 * n_a + b + n_b * b_closes.astype(np.int64)
        width = sizes[codes]
        text = letters[codes][np.arange(DIGITS) < width[:, None]].tobytes()
        ends = np.r_[0, np.cumsum(width)][a_at + b_at].tolist()
        # without the separator behind the last group
        return [hashlib.sha256(text[i:j - 1]).hexdigest() if j > i else "" for i, j in zip(ends[:-1], ends[1:])]


def _only(ids: np.ndarray, at: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the texts that are kept; the others have none."""
    sizes = np.diff(at)
    return ids[np.repeat(kept, sizes)].astype(np.int64), np.r_[0, np.cumsum(np.where(kept, sizes, 0))]


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds, at = np.unique(keys, return_inverse=True)
    sums = np.zeros(len(kinds), np.int64)
    np.add.at(sums, at, values)
    return kinds, sums


def _batch(**given) -> pa.RecordBatch:
    n = len(next(iter(given.values())))
    return pa.RecordBatch.from_arrays([given[f.name] if f.name in given else pa.nulls(n, f.type) for f in _SCHEMA], schema=_SCHEMA)


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def _align(batches: Iterable[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    """A row for each text, and rows of pair counts weighted by the texts' documents."""
    aligner, parts = Aligner(_tokenizers(a_path, b_path)), []
    for rows in batches:
        keys, documents = column(rows, "text_key"), column(rows, "documents").to_numpy()
        texts = column(rows, "text")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < len(texts):
            before = size[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(size, before + SLICE_BYTES, "right")))
            some = texts.slice(begin, end - begin)
            got = aligner.align(pc.binary_join_element_wise(" ", some, ""))
            # one row a text and distinct pair: the text above the pair's 31 bits
            kinds, often = np.unique(got["text"] << 31 | got["pairs"], return_counts=True)
            pairs, text = (kinds & ((1 << 31) - 1)).astype(np.int32), kinds >> 31
            offsets = pa.array(np.searchsorted(text, np.arange(len(some) + 1)), pa.int32())
            number = {name: pa.array(got[name], pa.int64()) for name in ("n_a", "n_b", "n_groups")}
            yield _batch(
                text_key=keys.slice(begin, end - begin), **number, n_links=number["n_groups"], groups_sha256=pa.array(got["groups_sha256"], pa.string()),
                pairs=pa.ListArray.from_arrays(offsets, pa.array(pairs)), times=pa.ListArray.from_arrays(offsets, pa.array(often.astype(np.int32))),
            )
            parts.append(_summed(pairs, often * documents[begin:end][text]))
            begin = end
        if sum(len(p[0]) for p in parts) > COUNTED:
            parts = [_counted(parts)]
            if len(parts[0][0]) > COUNTED // 2:
                yield _batch(pair=pa.array(parts[0][0], pa.int32()), count=pa.array(parts[0][1]))
                parts = []
    if parts:
        pairs, counts = _counted(parts)
        yield _batch(pair=pa.array(pairs, pa.int32()), count=pa.array(counts))


def align_texts(docs: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, DataFrame]:
    """Of ``docs(text)``: a row for each distinct text with tokens or without (``text_key`` its
    SHA-256, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256``, its distinct linked
    ``pairs`` and how many ``times`` each), and ``pair, a_id, b_id, count, best`` over all documents.

    ``best``: no pair of the same B id counts more.  Null and empty texts are left out.
    """
    ship(docs.sparkSession)
    distinct = docs.where("text <> ''").groupBy("text").agg(F.count("*").alias("documents"))
    keyed = distinct.select(F.unhex(F.sha2("text", 256)).alias("text_key"), "text", "documents")
    found = cut(keyed.mapInArrow(lambda batches: _align(batches, a_path, b_path), FOUND), "aligned")
    texts = found.where("text_key IS NOT NULL").drop("pair", "count")
    counts = found.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("count").alias("count"))
    counts = cut(counts.select("pair", F.expr(f"CAST(pair DIV {PAIR} AS INT) AS a_id"), F.expr(f"CAST(pair % {PAIR} AS INT) AS b_id"), "count"), "pairs")
    highest = counts.groupBy("b_id").agg(F.max("count").alias("_most"))
    return texts, counts.join(highest, "b_id").select("pair", "a_id", "b_id", "count", (F.col("count") == F.col("_most")).alias("best"))


def measure(docs: DataFrame, a_path: str, b_path: str, *, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``docs(doc_id, text)`` with ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``n_best`` counts a document's links whose pair is ``best``, ``count_sum`` adds up the corpus
    counts of its links.  Null and empty texts, and those whose bytes a vocabulary does not give
    back, have zeros and an empty digest.  Repeated rows, also without a ``doc_id``, all stay.

    The table of pairs is bounded by the vocabularies; it is broadcast where it is measured to be
    small, and else joined with frequent pairs split, as are the texts that many documents share.
    """
    docs = docs.select("doc_id", "text")
    texts, pairs = align_texts(docs, a_path, b_path)
    pairs = cut(pairs.select("pair", "count", "best"), "best")
    links = texts.select("text_key", F.explode(F.arrays_zip("pairs", "times")).alias("_l")).select("text_key", F.col("_l.pairs").alias("pair"), F.col("_l.times").alias("times"))
    if bounded(pairs, limit):
        linked = links.join(F.broadcast(pairs), "pair")
    else:
        # at most FREQUENT pairs hold more than their share of all links; no key of the shuffle does
        many = pairs.agg(F.sum("count")).first()[0] / FREQUENT
        frequent, rest = F.broadcast(pairs.where(F.col("count") > many)), pairs.where(F.col("count") <= many)
        linked = links.join(frequent, "pair").unionByName(links.join(frequent, "pair", "left_anti").join(rest, "pair"))
    sums = linked.groupBy("text_key").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("count") * F.col("times")).alias("count_sum")
    )
    whole = cut(texts.drop("pairs", "times").join(sums, "text_key", "left"), "measures")
    keyed = docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("text_key"))
    got = lookup(keyed, whole, "text_key", "left", row_id="doc_id", limit=limit)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    return got.select("doc_id", *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in names], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
