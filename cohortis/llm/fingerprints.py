"""Document fingerprints: threshold-scaled sketches of word shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .hashing import WordHasher, shingles, utf8

WIDTH = 5  # words in a shingle
SCALE = 8  # one hash in so many is retained
HEX = 12  # digits written for each retained hash

SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _write(hashes, scale: int = SCALE) -> str:
    """``<distinct shingles>-<digest of all of them>:<retained hashes>``."""
    kept = hashes[hashes < np.uint64((1 << 64) // scale)]
    shown = (kept >> np.uint64(13)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
    return f"{len(hashes)}-{hashlib.blake2b(hashes.tobytes(), digest_size=8).hexdigest()}:{shown.tobytes().hex()}"


def retained(fingerprint: str) -> set[str]:
    """The retained hashes of a fingerprint."""
    body = fingerprint.partition(":")[2]
    return {body[i : i + HEX] for i in range(0, len(body), HEX)}


def likeness(a: str, b: str) -> float:
    """Estimated share of common shingles among all of two texts; equal fingerprints give 1.

    Where neither text retains a hash (very short ones) only equality counts, else 0.
    """
    if a == b:
        return 1.0
    x, y = retained(a), retained(b)
    return len(x & y) / len(x | y) if x or y else 0.0


def containment(a: str, b: str) -> float:
    """Estimated share of the first text's shingles that the second holds, whatever their lengths."""
    if a == b:
        return 1.0
    x, y = retained(a), retained(b)
    return len(x & y) / len(x) if x else 0.0


def merged(a: str, b: str) -> str:
    """Sketch of two texts together: the union of the retained hashes (the count is estimated from them)."""
    both = sorted(retained(a) | retained(b))
    return f"{len(both) * SCALE}-merged:{''.join(both)}"


def sketches(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of a text column as a string; null and empty texts give ``0-...:``.

    All columns stay. Equal texts have equal fingerprints, repeated rows too; an empty table stays empty.
    """

    def run(batches: Iterator) -> Iterator:
        hasher = WordHasher()
        for batch in batches:
            found = [_write(shingles(w, WIDTH)) for w in hasher(utf8(batch.column(text)))]
            cols = [c for n, c in zip(batch.schema.names, batch.columns) if n != name]
            names = [n for n in batch.schema.names if n != name]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(found, pa.string())], [*names, name])

    kept = docs.drop(name)
    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(name, StringType())]))


def _edited_pairs(batches: Iterator) -> Iterator:
    """Rows in order, each part closed by the first row of the next one (``tail``)."""
    hasher = WordHasher()
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    limit = np.uint64((1 << 64) // SCALE)

    def close(x, y, fx: str, fy: str) -> float:
        if fx == fy:
            return 1.0
        x, y = x[x < limit], y[y < limit]
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both / (len(x) + len(y) - both) if len(x) + len(y) else 0.0

    held = None  # the last row: id, text, shingles, fingerprint, tail
    for batch in batches:
        ids, raw, tail = batch.column("doc_id").to_pylist(), utf8(batch.column("text")), batch.column("tail").to_pylist()
        own = [shingles(w, WIDTH) for w in hasher(raw)]
        rows = [(i, r.decode("utf-8", "replace"), s, _write(s), t) for i, r, s, t in zip(ids, raw, own, tail)]
        pairs = [(a, b) for a, b in zip([held, *rows[:-1]] if held else rows[:-1], rows if held else rows[1:]) if not a[4]]
        held = rows[-1] if rows else held
        edited = [a[1][: len(a[1]) - len(a[1]) // 2] + b[1][: len(a[1]) // 2] for a, b in pairs]
        out = []
        for (a, b), e, w in zip(pairs, edited, hasher([e.encode("utf-8", "replace") for e in edited])):
            s = shingles(w, WIDTH)
            f = _write(s)
            out.append((a[0], len(a[1]), hashlib.sha256(e.encode("utf-8", "replace")).hexdigest(), a[3], f,
                        close(a[2], s, a[3], f), close(a[2], b[2], a[3], b[3])))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        cols = zip(*out) if out else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its text with the second half replaced from the next document.

    Next means the next smaller ``doc_id``; after the smallest comes the largest. Null texts count as empty; rows with
    a null id come last; rows that repeat an id follow each other by text. One row per row; an empty table gives none.
    Only ``doc_id`` and ``text`` are read.

    Texts move once: to parts of an id range, whose bounds are sampled. The first row of each part also goes to the
    part before it, so that every part can be read alone, as a stream.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(2**63))).alias("rank"))
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = rows.approxQuantile("rank", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    bounds = sorted({int(b) for b in bounds})
    low = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<bigint>")
    rows = rows.withColumn("part", F.size(F.filter(low, lambda b: b < F.col("rank"))))
    # At most one row per part.
    heads = sorted((r["part"], r["top"]) for r in rows.groupBy("part").agg(F.max("rank").alias("top")).collect())
    order = [p for p, _ in heads]
    goes = [(p, top, order[(i + 1) % len(order)]) for i, (p, top) in enumerate(heads)]
    goes = spark.createDataFrame(goes, "part int, rank long, also int")
    own = rows.join(F.broadcast(goes), ["part", "rank"], "left")
    own = own.withColumn(
        "to",
        F.explode(F.when(F.col("also").isNull(), F.array(F.struct("part", F.lit(False).alias("tail")))).otherwise(
            F.array(F.struct("part", F.lit(False).alias("tail")), F.struct(F.col("also").alias("part"), F.lit(True).alias("tail")))
        )),
    )
    dealt = own.select("doc_id", "text", "rank", F.col("to.part").alias("part"), F.col("to.tail").alias("tail"))
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", "tail", F.desc("rank"), "text")
    return dealt.select("doc_id", "text", "tail").mapInArrow(_edited_pairs, SCHEMA)
