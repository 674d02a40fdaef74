"""Secret scans: Aho-Corasick keywords first, anchored expressions at their hits, then checksums.

Kinds, in the order of ties: assign (a credential word, a separator and a value), access (access key
ids), hex (long lower-case hexadecimal runs), github and npm (tokens whose last six characters are
the CRC-32 of the rest in base 62). Matches of a kind are leftmost and do not overlap; a match that
fails its test (length or checksum) is dropped after it has taken its place.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from sieverank.llm import texts

KINDS = ("assign", "access", "hex", "github", "npm")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 12, 18, 16
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_ASSIGN = re.compile(
    rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]+")
_GITHUB = re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_NPM = re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")

# Keywords as they stand in the text with A-Z made small, and the kinds they can start.
_KEYWORDS = {
    **{word: 0 for word in ("password", "passwd", "secret", "token", "apikey", "api_key")},
    "akia": 1,
    **{f"gh{letter}_": 3 for letter in "pousr"},
    "npm_": 4,
}
# For the hex kind every digit of the text becomes one mark, and the keyword is a run of marks.
_MARKS = bytes(ord("h") if chr(c) in "0123456789abcdef" else ord(" ") for c in range(256))
_SMALL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def checksum_holds(token: bytes) -> bool:
    """Whether the last six characters are the CRC-32 of the 30 before them, in base 62."""
    body, tail = token[-36:-6], token[-6:]
    value, digits = zlib.crc32(body), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits.encode() == tail


_RULES = {
    0: (_ASSIGN, lambda m: len(m.group(1)) >= MIN_VALUE),
    1: (_ACCESS, lambda m: m.end() - m.start() >= MIN_ACCESS),
    3: (_GITHUB, lambda m: checksum_holds(m.group())),
    4: (_NPM, lambda m: checksum_holds(m.group())),
}


def automaton() -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    for word, kind in _KEYWORDS.items():
        built.add_word(word, (kind, len(word)))
    built.make_automaton()
    return built


def spans_of(text: str, keywords: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, sorted."""
    data = text.encode("utf-8", "surrogatepass")
    hits = [(end - size + 1, kind) for end, (kind, size) in keywords.iter(data.translate(_SMALL).decode("latin-1"))]
    found = []
    free = dict.fromkeys(_RULES, 0)
    for start, kind in sorted(hits):
        if start < free[kind]:
            continue
        pattern, holds = _RULES[kind]
        match = pattern.match(data, start)
        if match:
            free[kind] = match.end()
            if holds(match):
                found.append((start, kind, match.end()))
    marks = data.translate(_MARKS)
    at = marks.find(b"h" * MIN_HEX)
    while at >= 0:
        end = _HEX.match(data, at).end()
        found.append((at, 2, end))
        at = marks.find(b"h" * MIN_HEX, end)
    if found and len(data) != len(text):
        places = sorted({p for start, _, end in found for p in (start, end)})
        points, before, count = {}, 0, 0
        for place in places:
            count += len(data[before:place].decode("utf-8", "surrogatepass"))
            points[place], before = count, place
        found = [(points[start], kind, points[end]) for start, kind, end in found]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(documents: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) for every row, over whole texts.

    Null and empty texts have no spans; repeated rows are returned repeatedly; a null doc_id stays
    null; an empty table gives no rows; other columns take no part. Places are code points, ``end``
    exclusive.
    """
    return _mapped(documents, "doc_id long, spans array<struct<kind:string,start:int,end:int>>", _as_structs)


def digests(documents: DataFrame) -> DataFrame:
    """Counts and digests per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_checked.

    ``spans`` is kind:start:end of every span, comma-joined; ``base_sha256`` is the digest of the same
    over the first three kinds; ``n_checked`` counts spans with a valid checksum.
    """
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_checked long"
    return _mapped(documents, schema, _as_digests)


def _mapped(documents: DataFrame, schema: str, build) -> DataFrame:
    texts.prepare(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        for block in texts.blocks(batches, "text"):
            found = [spans_of(t.as_py() or "", keywords) for t in block.column("text")]
            yield build(block.column("doc_id"), found)

    return texts.with_text(documents).mapInArrow(run, schema)


def _as_structs(ids: pa.Array, found: list) -> pa.RecordBatch:
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans] for spans in found]
    return pa.RecordBatch.from_arrays([ids, pa.array(rows, pa.list_(kind))], ["doc_id", "spans"])


def _as_digests(ids: pa.Array, found: list) -> pa.RecordBatch:
    counts = [[sum(k == kind for _, k, _ in spans) for spans in found] for kind in range(3)]
    base = [hashlib.sha256(joined([s for s in spans if s[1] < 3]).encode()).hexdigest() for spans in found]
    checked = [sum(k > 2 for _, k, _ in spans) for spans in found]
    columns = [ids, *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string())]
    columns += [pa.array([joined(s) for s in found], pa.string()), pa.array(checked, pa.int64())]
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_checked"]
    return pa.RecordBatch.from_arrays(columns, names)
