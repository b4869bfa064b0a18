"""Secrets in texts: keyword automaton, anchored patterns at its hits, embedded checksums."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds in the order that breaks ties, the words before an assigned value, issuers' token prefixes.
KINDS = ("assign", "access", "hex", "github", "npm")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
GITHUB_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
NPM_PREFIX = "npm_"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ISSUED = re.compile(r"(?:gh[pousr]_|npm_)([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
SHORTEST = {"assign": 6, "access": 20, "hex": 24}
HEX_PIECE = 4  # a long hex run has one of these at each of its places; prose has few


def checksum(body: str) -> str:
    """The CRC-32 of a token's body as six base-62 digits, as issuers append it."""
    value, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = BASE62[digit] + out
    return out


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in ASSIGN_WORDS:
        a.add_word(w, ("assign", len(w)))
    a.add_word("akia", ("access", 4))
    for p in (*GITHUB_PREFIXES, NPM_PREFIX):
        a.add_word(p, ("github" if p in GITHUB_PREFIXES else "npm", 4))
    for piece in map("".join, product("0123456789abcdef", repeat=HEX_PIECE)):
        a.add_word(piece, ("hex", HEX_PIECE))
    a.make_automaton()
    return a


def _plain_lower(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)


def scan(text: str, index: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the secrets of one text, by start and then kind.

    A pattern is tried at a keyword's place only, and not inside the last match of its kind, so the matches are the
    leftmost ones that do not overlap; those that are too short or fail their checksum are dropped afterwards.
    """
    found: list[tuple[int, int, str]] = []
    upto = dict.fromkeys(KINDS, 0)
    starts: dict[str, list[int]] = {"assign": []}
    for end, (kind, n) in index.iter(_plain_lower(text)):
        at = end - n + 1
        if kind == "assign":
            starts["assign"].append(at)  # keywords differ in length: sorted below
        elif at >= upto[kind]:
            if kind == "hex":
                m = HEX.match(text, at)
                keep = m and m.end() - at >= SHORTEST["hex"]
            elif kind == "access":
                m = ACCESS.match(text, at)
                keep = m and m.end() - at >= SHORTEST["access"]
            else:
                m = ISSUED.match(text, at)
                keep = m and (at == 0 or not text[at - 1].isalnum()) and checksum(m[1]) == m[2]
            if m:
                upto[kind] = m.end()
                if keep:
                    found.append((at, m.end(), kind))
    for at in sorted(starts["assign"]):
        if at >= upto["assign"] and (m := ASSIGN.match(text, at)):
            upto["assign"] = m.end()
            if len(m[2]) >= SHORTEST["assign"]:
                found.append((at, m.end(), "assign"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def secret_spans(docs: DataFrame, text: str = "text", name: str = "secrets") -> DataFrame:
    """Add ``name``, an array of ``(start, end, kind)`` in code points, end exclusive, by start and then kind.

    Kinds: ``assign`` (a value given to a password-like name), ``access`` (AKIA keys), ``hex`` (long lower-case hex),
    and the issued tokens ``github`` and ``npm``, whose last six characters must be the checksum of the rest. Null and
    empty texts have no spans; all columns and rows stay, repeated ones too; an empty table stays empty.
    """
    kind = "array<struct<start:long,end:long,kind:string>>"
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    plain = docs.drop(name)

    def run(batches: Iterator) -> Iterator:
        index = automaton()
        for batch in batches:
            out = [
                [{"start": a, "end": b, "kind": k} for a, b, k in scan(t, index)] if t else []
                for t in batch.column(text).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, spans)], [*batch.schema.names, name])

    return plain.mapInArrow(run, plain.withColumn(name, F.lit(None).cast(kind)).schema)


def secret_report(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, the digest of their spans, and all spans."""
    found = secret_spans(docs.select("doc_id", "text"), "text", "found").select("doc_id", "found")

    def as_text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def count(kind: str):
        return F.size(F.filter("found", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda s: s.kind.isin("assign", "access", "hex"))
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("found")).alias("spans"),
    )
