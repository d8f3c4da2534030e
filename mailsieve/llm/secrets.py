"""Secret scans: known shapes, and random strings that a vocabulary cannot shorten.

A tokeniser's vocabulary holds what people write, so prose and identifiers take few tokens and
random strings many.  A run of key characters, or what base patterns leave of it, counts as random
where it has few characters per token.  Digests of the usual lengths, UUIDs and other known
identifiers are left out: they look random and are no secrets.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from mailsieve.functions.shared import ship
from mailsieve.llm.tokens import column

# fixed values: the base kinds, their patterns and least lengths
KINDS = ["assign", "access", "hex"]
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

RANDOM = "random"
RANDOM_LEAST = 20
CHARS_PER_TOKEN = 2.2
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
SPANS = "array<struct<kind:string,start:int,end:int>>"

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(f"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}")
_HEX = re.compile(f"[0-9a-f]{{{HEX_LEAST},}}")
_RUN = re.compile(f"[A-Za-z0-9+/_=-]{{{RANDOM_LEAST},}}")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_DIGEST = re.compile(r"(?:sha\d+-|md5-)?([0-9A-Fa-f]+|[0-9A-F]+)")

# texts without these have no match; the scans below see the others only
_MAY = {
    "assign": r"(?i)password|passwd|secret|token|api_?key",
    "access": f"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4}}}",
    "hex": f"[0-9a-f]{{{HEX_LEAST}}}",
    RANDOM: f"[A-Za-z0-9+/_=-]{{{RANDOM_LEAST}}}",
}


def known(run: str) -> bool:
    """A digest of a usual length or a UUID."""
    digest = _DIGEST.fullmatch(run)
    return bool(_UUID.fullmatch(run)) or bool(digest and len(digest[1]) in DIGEST_LENGTHS)


def base_spans(text: str, kinds: list[str]) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the base kinds among ``kinds``."""
    found = []
    if "assign" in kinds:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "access" in kinds:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    if "hex" in kinds:
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return found


def outside(start: int, end: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of a run that none of the spans ``taken``, in order, covers."""
    parts = []
    for a, b in taken:
        if a < end and start < b:
            parts.append((start, a))
            start = b
    return [(a, b) for a, b in [*parts, (start, end)] if a < b]


def vocabulary(ranks: str, pattern: str):
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


_VOCABULARIES: dict = {}


def scan(docs: DataFrame, ranks: str, pattern: str, *, most_chars_per_token: float = CHARS_PER_TOKEN) -> DataFrame:
    """All columns of ``docs`` and ``spans``: code points, end exclusive, by start, then kind.

    Whole texts are scanned.  A null or empty text has no spans.  Spans of the kind
    ``random`` never overlap a base span; base spans of different kinds may overlap.
    A column of ``docs`` with the name ``spans`` is replaced.
    """
    ship(docs.sparkSession)
    docs = docs.drop("spans")
    keep = docs.columns

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if ranks not in _VOCABULARIES:
            _VOCABULARIES[ranks] = vocabulary(ranks, pattern)
        tokens = _VOCABULARIES[ranks].encode_ordinary
        order = [*KINDS, RANDOM]
        for batch in batches:
            texts = pc.fill_null(column(batch, "text"), "")
            may = {k: pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False) for k, p in _MAY.items()}
            found: list[list] = [[] for _ in range(len(texts))]
            for i in np.flatnonzero(np.logical_or.reduce(list(may.values()))):
                text = texts[i].as_py()
                got = base_spans(text, [k for k in KINDS if may[k][i]])
                if may[RANDOM][i]:
                    taken = sorted((a, b) for a, _, b in got)
                    for run in _RUN.finditer(text):
                        if known(run[0]):
                            continue
                        for a, b in outside(*run.span(), taken):
                            if b - a >= RANDOM_LEAST and not known(text[a:b]) and b - a < most_chars_per_token * len(tokens(text[a:b])):
                                got.append((a, 3, b))
                found[i] = [{"kind": order[k], "start": a, "end": b} for a, k, b in sorted(got)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in keep], pa.array(found, kind)], [*keep, "spans"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(spans, f"{fields}, spans {SPANS}")


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs(text, spans)`` with every span replaced by its kind in brackets.

    Where spans overlap, one mark stands for all that they cover together.
    """
    marks = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.struct(
            F.when(s["start"] >= a["at"], F.concat(
                a["out"], F.col("text").substr(a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]")
            )).otherwise(a["out"]).alias("out"),
            F.greatest(a["at"], s["end"]).alias("at"),
        ),
        lambda a: F.concat(a["out"], F.col("text").substr(a["at"] + 1, F.length("text"))),
    )
    return docs.withColumn("text", F.when(F.size("spans") > 0, marks).otherwise(F.col("text")))
