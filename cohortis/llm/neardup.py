"""Near-duplicate documents: b-bit minwise signatures, a multi-index Hamming join, exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .components import components
from .hashing import STEP, WordHasher, mix, shingles, utf8

SYMBOLS = 64  # about so many 16-bit symbols in a signature
LOSS = 1e-6  # largest chance that a pair at the threshold exceeds the signature distance
BLOCK = 4096  # documents of one key or cluster that are compared in one go,
BLOCK_SHINGLES = 2_000_000  # and their shingles


def layout(share: float) -> tuple[int, int]:
    """Chunks and symbols a chunk: the fewest chunks that keep the distance bound.

    Every chunk may hold one wrong symbol, so ``chunks`` chunks find all pairs that differ in fewer than
    ``2 * chunks`` symbols. That bound is exceeded by a pair of the given similarity with a chance below ``LOSS``.
    """
    for chunks in range(4, SYMBOLS // 2):
        n, q = chunks * ceil(SYMBOLS / chunks), 1 - share
        if sum(comb(n, k) * q**k * (1 - q) ** (n - k) for k in range(2 * chunks, n + 1)) < LOSS:
            return chunks, ceil(SYMBOLS / chunks)
    return SYMBOLS // 2, 2


def _minima(hashes: np.ndarray, seeds: np.ndarray, factors: np.ndarray, bits: int) -> np.ndarray:
    """The lowest bits of the smallest value of each permutation."""
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(seeds), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(high), 1024):
        np.minimum(least, ((high[at : at + 1024, None] ^ seeds) * factors).min(axis=0), out=least)
    return least & np.uint32((1 << bits) - 1)


def _permutations(n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    base = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(STEP) + np.uint64(salt)).astype(np.uint32)
    return base[:n], base[n:] | np.uint32(1)


def _chunk_keys(signatures: np.ndarray, chunks: int) -> np.ndarray:
    """Keys of every signature: each chunk with each one of its symbols left out."""
    n, size = len(signatures), signatures.shape[1] // chunks
    parts = signatures.reshape(n, chunks, size).astype(np.uint64)
    out = np.empty((n, chunks, size), dtype=np.uint64)
    for left in range(size):
        total = np.tile(np.arange(chunks, dtype=np.uint64) * np.uint64(size) + np.uint64(left + 1), (n, 1))
        for j in range(size):
            if j != left:
                total = mix(total * np.uint64(STEP) + parts[:, :, j] + np.uint64(1))
        out[:, :, left] = total
    return out.reshape(n, chunks * size).view(np.int64)


def _matrix(column) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _lists(matrix: np.ndarray, kind) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(np.arange(0, n * width + 1, max(width, 1), dtype=np.int32)[: n + 1], pa.array(matrix.ravel(), kind))


def signatures(docs: DataFrame, width: int, symbols: int) -> DataFrame:
    """``(doc, n, set_id, sig)`` of each row: distinct shingles, a digest of the set, and the signature (null without words)."""
    seeds, factors = _permutations(symbols, 1)

    def run(batches: Iterator) -> Iterator:
        import hashlib

        hasher = WordHasher()
        for batch in batches:
            n, digest, sig = [], [], []
            for w in hasher(utf8(batch.column("text"))):
                s = shingles(w, width)
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(_minima(s, seeds, factors, 16).astype(np.int32) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.list_(pa.int32()))],
                ["doc", "n", "set_id", "sig"],
            )

    return docs.mapInArrow(run, "doc long, n long, set_id binary, sig array<int>")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """``(id, hashes)``: all distinct shingle hashes of each row."""

    def run(batches: Iterator) -> Iterator:
        hasher = WordHasher()
        for batch in batches:
            sets = [shingles(w, width).view(np.int64) for w in hasher(utf8(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "hashes"])

    return docs.mapInArrow(run, "id long, hashes array<bigint>")


def _blocks(rows: DataFrame, group: str, count: str) -> DataFrame:
    """Rows of each group once for every pair of its blocks ``(low, high)`` that they belong to; small groups are one."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col(count)).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other", count)
    return rows.repartition(group, "low", "high").sortWithinPartitions(group, "low", "high")


def _spanning(g: dict, bound: int, part: int, whole: int, test=None) -> Iterator[tuple[int, int]]:
    """Index pairs that join the components of one group of rows, as few as can.

    Rows of different components that are within the signature distance, and pass ``test``, are joined; rows that have
    been joined already are not compared again.
    """
    n, sig = g["n"], g["sig"]
    _, label, size = np.unique(g["comp"], return_inverse=True, return_counts=True)
    order = np.argsort(size[label], kind="stable")  # members of the largest component start nothing
    for k, i in enumerate(order):
        j = order[k + 1 :]
        j = j[(label[j] != label[i]) & (np.minimum(n[j], n[i]) * whole >= np.maximum(n[j], n[i]) * part)]
        if g["low"] != g["high"]:
            j = j[g["block"][j] != g["block"][i]]
        j = j[(sig[j] != sig[i]).sum(axis=1) <= bound]
        if test is not None and len(j):
            j = j[test(i, j)]
        for x in j:
            if label[x] != label[i]:
                yield i, x
                label[label == label[x]] = label[i]


def _by_group(rows: DataFrame, group: str, lists: tuple[str, ...], found) -> DataFrame:
    """``(a, b)`` that ``found`` gives for each group and block pair of sorted rows; one such group is in memory."""

    def run(batches: Iterator) -> Iterator:
        names = ("block", "id", "comp", "n")
        held: list[pa.RecordBatch] = []
        label = None

        def done() -> Iterator:
            if held:
                table = pa.Table.from_batches(held)
                g = {c: table.column(c).to_numpy() for c in names} | {c: table.column(c).combine_chunks() for c in lists}
                pairs = list(found(g | {"sig": _matrix(g["sig"]), "low": label[1], "high": label[2]}))
                if pairs:
                    a, b = zip(*pairs)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            k = np.stack([batch.column(c).to_numpy() for c in (group, "low", "high")], axis=1)
            if not len(k):
                continue
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
            for x, y in zip(cuts, cuts[1:]):
                now = tuple(int(v) for v in k[x])
                if now != label:
                    yield from done()
                    held, label = [], now
                held.append(batch.slice(x, y - x))
        yield from done()

    return rows.mapInArrow(run, "a long, b long")


def _same_texts(g: dict, part: int, whole: int):
    """A test of one row against others on the full shingle sets, through an index of the group's shingles."""
    column = g["hashes"]
    ends = np.cumsum(g["n"])
    _, shingle = np.unique(column.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    owner = np.repeat(np.arange(len(g["n"])), g["n"])
    by_shingle = owner[np.argsort(shingle, kind="stable")]
    start = np.concatenate([[0], np.cumsum(np.bincount(shingle))])

    def test(i: int, j: np.ndarray) -> np.ndarray:
        own = shingle[ends[i] - g["n"][i] : ends[i]]
        if len(j) < 32:
            common = np.array([len(np.intersect1d(own, shingle[ends[x] - g["n"][x] : ends[x]], assume_unique=True)) for x in j])
        else:
            length = start[own + 1] - start[own]
            place = np.arange(length.sum()) + np.repeat(start[own] - np.cumsum(length) + length, length)
            common = np.bincount(by_shingle[place], minlength=len(g["n"]))[j]
        return common * whole >= (g["n"][i] + g["n"][j] - common) * part

    return test


def _confirmed(pairs: DataFrame, sets: DataFrame, part: int, whole: int) -> DataFrame:
    """The pairs whose full shingle sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
    both = pairs.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("x", "y")))
    return both.where(F.col("shared") * whole >= (F.size("x") + F.size("y") - F.col("shared")) * part).select("a", "b")


def near_duplicates(docs: DataFrame, width: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of each row of ``docs(doc_id, text)``.

    Words are lower-cased (A-Z) and split at white space. Two documents are linked when ``whole`` times the common
    distinct shingles are at least ``part`` times all of them; components are over all links, named by their smallest
    doc_id, and ``kept`` marks that document. Texts without words (null, empty) have no shingle and no link. Rows that
    repeat a doc_id count as one document; a null doc_id is left alone (its component is null, it is kept). Equal
    texts are one class from the start. Extra columns are not looked at; an empty table gives no rows.

    Work by step: (1) one pass computes signatures; equal sets collapse. (2) Each chunk of a signature, with one of
    its symbols left out in turn, is a key; keys of two or more documents are kept. (3) In each key the first document
    is paired with all others; pairs within the distance are confirmed on the full sets, links are contracted.
    (4) Keys whose documents are then still apart are compared in blocks, across components only, so every pair under
    the distance is looked at; that yields clusters of components. (5) In each cluster, again in blocks, the pairs
    across components are decided on the full sets. Pairs of a group are never written out, only what joins it.
    """
    share = part / whole
    chunks, size = layout(share)
    bound = 2 * chunks - 1
    texts = docs.select(F.col("doc_id").alias("doc"), "text")

    signed = cut(signatures(texts, width, chunks * size))
    reps = (signed.where("n > 0 and doc is not null").groupBy("set_id")
            .agg(F.min("doc").alias("id"), F.min("n").alias("n"), F.min("sig").alias("sig")))

    def keys(batches: Iterator) -> Iterator:
        for batch in batches:
            if batch.num_rows:
                found = _chunk_keys(_matrix(batch.column("sig")), chunks)
                yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(found, pa.int64())], ["id", "keys"])

    keyed = reps.select("id", "sig").mapInArrow(keys, "id long, keys array<bigint>").select("id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    members = cut(keyed.join(shared, "key").select("key", "id").distinct())

    hubs = members.groupBy("key").agg(F.min("id").alias("hub"))
    first = (members.join(hubs, "key").where("id <> hub")
             .select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct())
    marks = reps.select("id", "n", "sig")
    near = (first.join(marks.select(F.col("id").alias("a"), F.col("sig").alias("s")), "a")
            .join(marks.select(F.col("id").alias("b"), F.col("sig").alias("t")), "b")
            .where(F.size(F.filter(F.zip_with("s", "t", lambda s, t: s != t), lambda x: x)) <= bound).select("a", "b"))

    involved = members.select("id").distinct()
    sets = cut(shingle_sets(texts.where("doc is not null").join(involved, F.col("doc") == F.col("id")).select("id", "text"), width))
    links = cut(_confirmed(near, sets, part, whole).distinct())
    labels = components(links)

    placed = members.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    apart = placed.groupBy("key").agg(F.count("*").alias("c"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y and c > 2")
    rest = cut(placed.join(apart.select("key", (F.col("c") / BLOCK).alias("blocks")), "key"))
    dealt = _blocks(rest.join(marks, "id"), "key", "blocks")
    joined = _by_group(dealt, "key", ("sig",), lambda g: (
        (g["comp"][i], g["comp"][j]) for i, j in _spanning(g, bound, part, whole)))
    clusters = components(joined)
    held = rest.select("id", "comp").distinct().join(clusters.select(F.col("id").alias("comp"), F.col("component").alias("cluster")), "comp")
    held = held.join(marks, "id")
    sizes = held.groupBy("cluster").agg(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES).alias("blocks"))
    held = _blocks(held.join(sizes, "cluster").join(sets.dropDuplicates(["id"]), "id"), "cluster", "blocks")
    late = cut(_by_group(held, "cluster", ("sig", "hashes"), lambda g: (
        (g["id"][i], g["id"][j]) for i, j in _spanning(g, bound, part, whole, _same_texts(g, part, whole)))).distinct())
    if not late.isEmpty():
        labels = components(links.union(late))

    classes = reps.join(labels, "id", "left").select("set_id", F.coalesce("component", "id").alias("component"))
    out = signed.join(classes, "set_id", "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc"))
    return out.select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(component == F.col("doc"), F.lit(True)).alias("kept"),
    )
