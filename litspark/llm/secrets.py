"""Secret scan: Aho-Corasick keyword prefilter, anchored expressions near hits, then embedded checks.

One pass of an Aho-Corasick automaton over the lower-cased text finds the keywords. An expression is tried only where one
of its keywords begins, so prose without keywords is read once. Long hexadecimal runs have no keyword; they are found by
one linear expression. Kinds with an embedded check (CRC-32 of access tokens, the JSON header of a web token) count only
if it holds.

Kinds: assign, access and hex as keyword assignment, access key and hexadecimal run; github and npm tokens with CRC-32
suffix; jwt. Spans of a kind are leftmost and don't overlap; offsets are code points, end exclusive.

Defined cases: null or empty text has no spans; any length is scanned whole; other columns play no part.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["assign", "access", "hex", "github", "npm", "jwt"]
BASE_KINDS = KINDS[:3]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
NPM = re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
#: Possessive, so that a run of letters without a point is read once.
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]++)(?:\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++)?")
#: keyword in lower case -> kind
KEYWORDS = {k: "assign" for k in ("password", "passwd", "secret", "token", "apikey", "api_key")} | {"akia": "access", "npm_": "npm", "eyj": "jwt"} | {f"gh{c}_": "github" for c in "pousr"}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def crc_suffix(token: str) -> bool:
    """Whether the last six characters are the base-62 CRC-32 of the thirty before them."""
    body, suffix = token[-36:-6], token[-6:]
    crc, digits = zlib.crc32(body.encode()), ""
    while crc:
        crc, d = divmod(crc, 62)
        digits = BASE62[d] + digits
    return digits.rjust(6, "0") == suffix


def json_header(part: str) -> bool:
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, TypeError, binascii.Error):
        return False


#: kind -> expression and the test that a match must pass
RULES = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= 6),
    "access": (ACCESS, lambda m: len(m[0]) >= 20),
    "github": (GITHUB, lambda m: crc_suffix(m[0])),
    "npm": (NPM, lambda m: crc_suffix(m[0])),
    "jwt": (JWT, lambda m: m[0] != m[1] and json_header(m[1])),
}


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def find_secrets(text: str, words) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of all spans, sorted."""
    low = text.lower()
    if len(low) != len(text):  # some letters get longer in lower case
        low = text.translate(ASCII_LOWER)
    at: dict[str, list[int]] = {}
    for end, (kind, n) in words.iter(low):
        at.setdefault(kind, []).append(end - n + 1)
    spans = []
    for kind, starts in at.items():
        (pattern, holds), free = RULES[kind], 0
        for start in sorted(starts):
            # a failing match still uses its characters up, as in a search from left to right
            if start >= free and (m := pattern.match(text, start)):
                free = m.end()
                if holds(m):
                    spans.append((start, KINDS.index(kind), free))
    spans += [(m.start(), KINDS.index("hex"), m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = automaton()
    for batch in batches:
        spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find_secrets(t or "", words)] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(SPAN))], names=["doc_id", "spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id and spans, an array of kind, start and end in order of start and kind."""
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan_batches, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """scan_secrets' result as counts, the hash of the base spans and the list of all spans."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[count_of(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
