"""Token ids by the tokenizers library, each distinct piece between spaces encoded once.

No token of the vocabularies used here reaches over the cuts made below, so a batch of texts
is cut into pieces, each distinct piece is looked up in a bounded memo or encoded, and the ids
are put together by array operations.  They are those of ``Tokenizer.encode`` over the whole
text; the tests hold the two together.  The memo is arrays too: only new pieces become Python
strings.  It goes when the task ends; the vocabulary stays with the worker process.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMO_PIECES, MEMO_BYTES = 600_000, 40  # pieces in a memo, and the longest one's bytes
SLICE_BYTES = 4 << 20

# white space next to white space: such texts are cut with more care
_WHITE = r"[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_DOUBLE = _WHITE + "{2}|\\x00"
_SPACE = re.compile(r"(?<=\S)(?= \S)")
_SPACE_SIGN = re.compile(r"(?<=\S)(?= \S)|(?<=[^\W\d_])(?=[.,;:!?])")
_SIGN = r"([\pL\pN])([.,;:!?])"  # no step of the model takes a letter and a sign together
# one Latin word, with a single sign after it or none: always one or two steps for the model
_WORD = re.compile("( ?[A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([.,;:!?]?)").fullmatch


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Memo:
    """Ids of the pieces met lately: keys, and for each where its ids begin in one array, and how many."""

    def __init__(self, most: int):
        self.most, self.now = most, 0
        self.keys, self.flat = pa.array([], pa.string()), np.zeros(0, np.uint32)
        self.begins, self.sizes, self.used = (np.zeros(0, np.int64) for _ in range(3))

    def ids(self, pieces: pa.Array, learn: Callable[[list[str]], list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct pieces: an array of ids, and where in it each piece's begin, and how many."""
        self.now += 1
        at = pc.index_in(pieces, value_set=self.keys)
        new = at.is_null()
        missing = pieces.filter(new)
        fresh = learn(missing.to_pylist())
        sizes = np.fromiter(map(len, fresh), np.int64, len(fresh)) >> 2
        place = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        place[new.to_numpy(zero_copy_only=False)] = len(self.keys) + np.arange(len(fresh))
        self.begins = np.r_[self.begins, len(self.flat) + np.cumsum(sizes) - sizes]
        self.sizes, self.used = np.r_[self.sizes, sizes], np.r_[self.used, np.zeros(len(fresh), np.int64)]
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(fresh), np.uint32)])
        self.keys = pa.concat_arrays([self.keys, missing])
        self.used[place] = self.now
        out = self.flat, self.begins[place], self.sizes[place]
        short = pc.binary_length(self.keys).to_numpy(zero_copy_only=False) <= MEMO_BYTES
        if len(short) > self.most or not short.all():
            self._keep(short)
        return out

    def _keep(self, short: np.ndarray) -> None:
        """The short ones; of too many, those met last, half of what there may be."""
        kept = np.flatnonzero(short)
        if len(kept) > self.most:
            kept = np.sort(kept[np.argsort(-self.used[kept], kind="stable")[: self.most // 2]])
        self.flat = self.flat[_ranges(self.begins[kept], self.sizes[kept])]
        self.sizes, self.used, self.keys = self.sizes[kept], self.used[kept], self.keys.take(pa.array(kept))
        self.begins = np.cumsum(self.sizes) - self.sizes


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each begin on, as many as its size says."""
    ends = np.cumsum(sizes)
    out = np.repeat(begins - (ends - sizes), sizes)
    out += np.arange(len(out))
    return out


class Encoder:
    """``byte_level``: a piece keeps the space before it; otherwise the vocabulary is lower-case
    and white space gives no token."""

    def __init__(self, path: str, byte_level: bool, memo_pieces: int = MEMO_PIECES, signs: bool = True):
        """``signs``: texts are cut before a sign behind a letter, too."""
        self.tokenizer = _opened(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.byte_level, self.signs, self.memo = byte_level, signs, Memo(memo_pieces)

    def cut(self, texts: pa.Array) -> pa.ListArray:
        if not self.byte_level:
            lines = pc.replace_substring(texts, "\n", " ")
            return pc.split_pattern(pc.replace_substring_regex(lines, _SIGN, r"\1 \2") if self.signs else lines, " ")
        plain = pc.invert(pc.match_substring_regex(texts, _DOUBLE))
        marked = pc.replace_substring(pc.replace_substring(texts, "\n", "\0\n\0"), " ", "\0 ")
        if self.signs:
            marked = pc.replace_substring_regex(marked, _SIGN, "\\1\0\\2")
        cuts = pc.split_pattern(marked, "\0")
        if not pc.all(plain).as_py():
            at = (_SPACE_SIGN if self.signs else _SPACE).split
            odd = {i: at(texts[i].as_py()) for i in np.flatnonzero(~plain.to_numpy(zero_copy_only=False))}
            cuts = pa.array([odd[i] if i in odd else c for i, c in enumerate(cuts.to_pylist())], pa.list_(pa.string()))
        return cuts

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words, each one step for the model."""
        texts = words if self.byte_level else [w.lower() for w in words]
        space = self.letters[32]
        texts = [t.replace(" ", space) if t.isascii() else t.encode().decode("latin-1").translate(self.letters) for t in texts]
        got = list(map(self.model.tokenize, texts))
        ends = np.cumsum(np.fromiter(map(len, got), np.int64, len(got))) * 4
        data = np.array([token.id for tokens in got for token in tokens], np.uint32).tobytes()
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def learn(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces, as 4-byte numbers."""
        kinds = list(map(_WORD, pieces))
        words = [k[1] for k in kinds if k]
        signs = list({k[2] for k in kinds if k and k[2]})
        sign = dict(zip(signs, self._words(signs)), **{"": b""})
        plain = iter(self._words(words))
        rest = iter(self.tokenizer.encode_batch_fast([p for p, k in zip(pieces, kinds) if not k], add_special_tokens=False))
        return [next(plain) + sign[k[2]] if k else array("I", next(rest).ids).tobytes() for k in kinds]

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cuts = self.cut(texts)
        coded = cuts.flatten().dictionary_encode()
        return gather(*self.memo.ids(coded.dictionary, self.learn), cuts, coded)

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Slices of a text column: row of the first text, all ids, where each text's ids begin
        (and the last's end).  Null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.string())
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < len(texts):
            before = size[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(size, before + SLICE_BYTES, "right")))
            yield begin, *self._slice(texts.slice(begin, end - begin))
            begin = end


def gather(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, cuts: pa.ListArray, coded: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts from those of their distinct pieces: all ids, and where each text's begin."""
    at = coded.indices.to_numpy(zero_copy_only=False)
    each = sizes[at].astype(np.int32)
    ends = np.zeros(len(at) + 1, np.int32)
    np.cumsum(each, out=ends[1:])
    shift = np.repeat(begins[at].astype(np.int32) - ends[:-1], each)
    shift += np.arange(len(shift), dtype=np.int32)
    offsets = cuts.offsets.to_numpy()
    return flat[shift], ends[offsets - offsets[0]]


_OPEN: dict = {}


def _opened(path: str):
    """A vocabulary, once per worker process."""
    if path not in _OPEN:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _OPEN[path] = Tokenizer.from_file(path)
        _OPEN[path].encode_special_tokens = True
    return _OPEN[path]


def encoder(path: str, byte_level: bool) -> Encoder:
    """For one task."""
    return Encoder(path, byte_level)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    got = batch.column(batch.schema.get_field_index(name))
    return got.combine_chunks() if isinstance(got, pa.ChunkedArray) else got
