"""Hard-negative mining: exact windowed search over Hilbert-ordered Parquet blocks with zone maps."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from typing import NamedTuple
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

SCALE = 256  # a component becomes floor(SCALE * x)
BLOCK = 4096  # rows of a block, a power of two
FILE_ROWS = 1 << 18  # rows of a file, about
ROW_GROUP = 4 << 20  # bytes, so that blocks of a file can be read apart
CURVE_DIMS, CURVE_BITS = 7, 9  # the dimensions that vary most, and the bits of each, in the curve's 63-bit key
SLICE = 1024  # zone maps compared with an anchor at once
CHUNK = 256  # anchors scored against a block at once
FAR = 1 << 62


def quantised(table: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(vec_id, label, vec)`` with whole components ``floor(scale * x)``, for rows that can take part.

    Rows with a null id, label, vector or component, or one that is not finite, are left out; wholly equal rows count
    once; vectors shorter than the longest are filled up with 0.
    """
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), values.alias("values"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("values").isNotNull() & ~F.exists("values", odd))
    width = rows.agg(F.max(F.size("values"))).first()[0] or 0
    whole = F.transform("values", lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("values"))
    return rows.select("vec_id", "label", F.concat(whole, zeros).alias("vec")).distinct()


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of whole coordinates in [0, 2^bits), by bitwise transposition."""
    x = points.astype(np.int64).copy()
    dims = x.shape[1]
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for i in range(dims):
            turned = (x[:, i] & q) != 0
            swap = np.where(turned, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(turned, low, swap)
            x[:, i] ^= swap
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), dtype=np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[:, -1] & (1 << b), (1 << b) - 1, 0)
    x ^= flip[:, None]
    key = np.zeros(len(x), dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1) if batch.num_rows else flat.reshape(0, 0)


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    edges = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
    return list(zip(edges, edges[1:]))


def _widths(rows: DataFrame) -> list[tuple[int, float, float]]:
    """``(dimension, mean, standard deviation)``, those that vary most first; one row a dimension reaches the driver."""

    def sums(batches: Iterator) -> Iterator:
        n, s, ss = 0, None, None
        for batch in batches:
            v = _matrix(batch, "vec").astype(np.float64)
            if len(v):
                n, s, ss = n + len(v), v.sum(0) + (0 if s is None else s), (v * v).sum(0) + (0 if ss is None else ss)
        d = np.arange(0 if s is None else len(s))
        yield pa.RecordBatch.from_arrays(
            [pa.array(d, pa.int64()), pa.array(np.full(len(d), n), pa.int64()), pa.array([] if s is None else s, pa.float64()), pa.array([] if s is None else ss, pa.float64())],
            ["d", "n", "s", "ss"])

    found = rows.select("vec").mapInArrow(sums, "d long, n long, s double, ss double").groupBy("d").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")])
    spread = [(r["d"], r["s"] / r["n"], max(r["ss"] / r["n"] - (r["s"] / r["n"]) ** 2, 0.0) ** 0.5) for r in found.collect()]
    return sorted(spread, key=lambda r: (-r[2], r[0]))


class Index(NamedTuple):
    """Candidate blocks and their zone maps."""

    blocks: DataFrame  # block, vec_id, label, vec
    zones: DataFrame  # block, lo, hi (least and greatest of each dimension), label_lo, label_hi


def build_index(rows: DataFrame) -> Index:
    """Write ``rows(vec_id, label, vec)`` as Parquet blocks in order of label and Hilbert curve, with zone maps.

    Blocks lie in the folder the session names for checkpoints (a temporary one where it names none). A block has
    ``BLOCK`` rows at most; the curve runs through the dimensions that vary most, all rows counted.
    """
    spark = rows.sparkSession
    dims = _widths(rows)[:CURVE_DIMS]
    top = (1 << CURVE_BITS) - 1

    def curve(batches: Iterator) -> Iterator:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch, "vec")
            scaled = [(v[:, d] - mean) / (6 * sd or 1.0) + 0.5 for d, mean, sd in dims]  # three deviations to each side
            points = np.clip(np.stack(scaled, 1) * top, 0, top) if dims else np.zeros((len(v), 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert(points, CURVE_BITS), pa.int64())], [*batch.schema.names, "curve"])

    n = rows.count()
    parts = max(1, min(-(-n // BLOCK), max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // FILE_ROWS))))
    order = ["label", "curve", "vec_id"]
    laid = rows.mapInArrow(curve, "vec_id long, label long, vec array<bigint>, curve long").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The id numbers a partition's rows from a multiple of 2^33, so equal quotients are neighbours of one partition.
    laid = laid.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK.bit_length() - 1))
    shared = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp()}"
    folder = f"{shared.rstrip('/')}/blocks-{uuid4().hex}"
    laid.select("block", "vec_id", "label", "vec").write.option("parquet.block.size", ROW_GROUP).parquet(folder)
    blocks = spark.read.parquet(folder)

    def zone(batches: Iterator) -> Iterator:
        for batch in batches:
            v, label, block = _matrix(batch, "vec"), batch.column("label").to_numpy(), batch.column("block").to_numpy()
            cols: list[list] = [[], [], [], [], []]
            for a, b in _runs(block) if batch.num_rows else ():
                for c, x in zip(cols, (block[a], v[a:b].min(0), v[a:b].max(0), label[a:b].min(), label[a:b].max())):
                    c.append(x)
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), lists, lists, pa.int64(), pa.int64()))], ["block", "lo", "hi", "label_lo", "label_hi"])

    # A block that lies in two Arrow batches has two zone maps.
    zones = cut(blocks.mapInArrow(zone, "block long, lo array<bigint>, hi array<bigint>, label_lo long, label_hi long"))
    return Index(blocks, zones)


def _meet(held: DataFrame, asked: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work(held rows, asked rows)`` wherever both have the same ``cell``; both arguments and results are Arrow batches.

    The cell's held rows, of which a cell has few, are kept in a task while its asked rows stream by.
    """
    both = held.withColumn("asked", F.lit(0)).unionByName(asked.withColumn("asked", F.lit(1)), allowMissingColumns=True)
    dealt = both.repartition("cell").sortWithinPartitions("cell", "asked")
    mine, theirs = held.columns, asked.columns

    def run(batches: Iterator) -> Iterator:
        cell, parts, whole = None, [], None
        for batch in batches:
            cells, kinds = batch.column("cell").to_numpy(), batch.column("asked").to_numpy()
            for a, b in _runs(cells * 2 + kinds) if batch.num_rows else ():
                part = batch.slice(a, b - a)
                if cells[a] != cell:
                    cell, parts, whole = cells[a], [], None
                if kinds[a] == 0:
                    parts.append(part.select(mine))
                    whole = None
                elif parts:
                    if whole is None:
                        whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                    for at in range(0, part.num_rows, CHUNK):
                        yield from work(whole, part.select(theirs).slice(at, CHUNK))

    return dealt.mapInArrow(run, schema)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole inner products of the rows of ``a`` and ``b``: in floating point where that is exact, else in integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    most = float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) * a.shape[1]
    if most < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _bounds(asks: DataFrame, zones: DataFrame) -> DataFrame:
    """``(ask, block, upper, lower)``: bounds on the scores of a block that an ask's windows and label may need to read.

    Interval arithmetic on the zone maps. They are dealt to slices, each slice to as many cells as there are shuffle
    partitions, and each ask to one cell of each slice.
    """
    spark = asks.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = max(1, -(-zones.count() // SLICE))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    slice_ = F.pmod(F.xxhash64("block"), F.lit(slices))
    held = zones.withColumn("slice", slice_).withColumn("salt", every(salts)).withColumn("cell", F.col("slice") * salts + F.col("salt"))
    own = asks.withColumn("slice", every(slices)).withColumn("cell", F.col("slice") * salts + F.pmod("ask", F.lit(salts)))
    held = held.select(F.col("cell").cast("long").alias("cell"), "block", "lo", "hi", "label_lo", "label_hi")
    own = own.select(F.col("cell").cast("long").alias("cell"), "ask", "same", "label", "vec", "w_lo", "w_hi")

    def work(zone: pa.RecordBatch, ask: pa.RecordBatch) -> Iterator:
        lo, hi, v = _matrix(zone, "lo"), _matrix(zone, "hi"), _matrix(ask, "vec")
        plus, minus = np.maximum(v, 0), np.minimum(v, 0)
        upper, lower = _product(plus, hi) + _product(minus, lo), _product(plus, lo) + _product(minus, hi)
        first, last = zone.column("label_lo").to_numpy(), zone.column("label_hi").to_numpy()
        label, same = ask.column("label").to_numpy()[:, None], ask.column("same").to_numpy()[:, None] == 1
        fits = np.where(same, (first <= label) & (label <= last), (first != label) | (last != label))
        low, high = _matrix(ask, "w_lo"), _matrix(ask, "w_hi")
        reach = np.zeros_like(fits)
        for w in range(low.shape[1]):
            reach |= (upper >= low[:, w, None]) & (lower <= high[:, w, None]) & (low[:, w, None] <= high[:, w, None])
        i, j = np.nonzero(fits & reach)
        cols = ask.column("ask").to_numpy()[i], zone.column("block").to_numpy()[j], upper[i, j], lower[i, j]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["ask", "block", "upper", "lower"])

    found = _meet(held, own, work, "ask long, block long, upper long, lower long")
    return found.groupBy("ask", "block").agg(F.max("upper").alias("upper"), F.min("lower").alias("lower"))


def _best(keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` greatest keys of each row, lowest int64 for none."""
    if keys.shape[1] > k:
        cols = np.argpartition(keys, -k, axis=1)[:, -k:]
    else:
        cols = np.broadcast_to(np.arange(keys.shape[1]), keys.shape)
    rows = np.broadcast_to(np.arange(len(keys))[:, None], cols.shape)
    real = np.take_along_axis(keys, cols, 1) != np.iinfo(np.int64).min
    return rows[real], cols[real]


def _read(index: Index, asks: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``(ask, w, score, vec_id)``: the first ``k`` rows of each window in each of the ``wanted(ask, block)`` blocks."""
    wanted = wanted.select("ask", F.col("block").alias("cell"))
    held = index.blocks.join(wanted.select("cell").distinct(), F.col("block") == F.col("cell"), "left_semi")
    held = held.select(F.col("block").alias("cell"), F.col("vec_id").alias("row_id"), F.col("label").alias("row_label"), F.col("vec").alias("row_vec"))
    own = asks.join(wanted, "ask").select("cell", "ask", "vec_id", "same", "label", "vec", "w_lo", "w_hi")

    def work(block: pa.RecordBatch, ask: pa.RecordBatch) -> Iterator:
        ids, labels, vecs = block.column("row_id").to_numpy(), block.column("row_label").to_numpy(), _matrix(block, "row_vec")
        order = np.argsort(-ids, kind="stable")  # later columns win ties: the smaller ids
        ids, labels, scores = ids[order], labels[order], _product(_matrix(ask, "vec"), vecs[order])
        alike = labels == ask.column("label").to_numpy()[:, None]
        takes = np.where(ask.column("same").to_numpy()[:, None] == 1, alike & (ids != ask.column("vec_id").to_numpy()[:, None]), ~alike)
        low, high, names = _matrix(ask, "w_lo"), _matrix(ask, "w_hi"), ask.column("ask").to_numpy()
        place = np.arange(len(ids))
        wide = scores.size and max(abs(int(scores.max())), abs(int(scores.min()))) > FAR // (2 * BLOCK)
        for w in range(low.shape[1]):
            inside = takes & (scores >= low[:, w, None]) & (scores <= high[:, w, None])
            if wide:  # scores that leave no room for the place: ranks of the scores instead
                ranks = np.unique(scores, return_inverse=True)[1].reshape(scores.shape)
                keys = np.where(inside, ranks * len(ids) + place, np.iinfo(np.int64).min)
            else:
                keys = np.where(inside, scores * len(ids) + place, np.iinfo(np.int64).min)
            i, j = _best(keys, k)
            cols = names[i], np.full(len(i), w), scores[i, j], ids[j]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["ask", "w", "score", "vec_id"])

    return _meet(held, own, work, "ask long, w long, score long, vec_id long")


def search(index: Index, asks: DataFrame, k: int) -> DataFrame:
    """``(ask, w, rank, vec_id, score)``: the first ``k`` rows of the index in each window of each ask, exactly.

    ``asks`` has ``ask`` (a number of its own), ``vec_id``, ``label``, ``vec``, ``same`` (1: rows of its label other
    than its own, 0: rows of other labels) and the windows ``w_lo``, ``w_hi`` (arrays of scores, as many in each row;
    empty where low is over high). Higher scores come first, then smaller ids.

    Each ask first reads the block with the greatest bound; the scores found there are thresholds that leave out of the
    second read every block whose bounds cannot reach one of the windows' first ``k``.
    """
    bounds = cut(_bounds(asks, index.zones))
    seed = cut(bounds.groupBy("ask").agg(F.max_by("block", F.struct("upper", -F.col("block"))).alias("block")))
    near = cut(_read(index, asks, seed, k))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("ask", "w").orderBy(F.desc("score"), "vec_id")))
    reached = ranked.where(F.col("rank") == k).groupBy("ask").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("reached"))
    left = bounds.join(seed.select("ask", F.col("block").alias("read")), "ask").where("block <> read")
    left = left.join(asks.select("ask", "w_lo", "w_hi"), "ask").join(reached, "ask", "left")
    useful = F.expr("""exists(sequence(0, size(w_lo) - 1), w -> upper >= greatest(w_lo[w], coalesce(try_element_at(reached, CAST(w AS BIGINT)), w_lo[w]))
        AND lower <= w_hi[w] AND w_lo[w] <= w_hi[w])""")
    rest = _read(index, asks, left.where(useful).select("ask", "block"), k)
    order = Window.partitionBy("ask", "w").orderBy(F.desc("score"), "vec_id")
    both = near.union(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return both.select("ask", "w", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def hard_negatives(rows: DataFrame, anchors: DataFrame, k: int = 5, least: int = 80, most: int = 100) -> DataFrame:
    """Negatives that score nearly as high as a positive, for each anchor and each of its first ``k`` positives.

    ``rows(vec_id, label, vec)`` and ``anchors`` (some of them) are as :func:`quantised` gives them. Positives are the
    first ``k`` rows of the anchor's label with another id; negatives the first ``k`` rows of other labels whose score
    is from ``least`` to ``most`` hundredths of the positive's, both ends included (none where that score is below 0).
    Returns ``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``; a positive without
    negatives has no rows, an empty table gives none. Rows that share an id with different content are rows of their
    own, but not each other's positives. Components and scores must fit 64 bits.
    """
    index = build_index(rows)
    asks = anchors.select(F.xxhash64("vec_id", "label", "vec").alias("ask"), "vec_id", "label", "vec")
    whole = lambda x: F.array(F.lit(x).cast("long"))
    positives = cut(search(index, asks.withColumns({"same": F.lit(1), "w_lo": whole(-FAR), "w_hi": whole(FAR)}), k))
    share = lambda part: F.col("score").cast("decimal(20,0)") * part / 100
    low, high = F.ceil(share(least)), F.floor(share(most))
    found = positives.select("ask", "rank", F.col("vec_id").alias("positive_id"), "score", low.cast("long").alias("low"), high.cast("long").alias("high"))
    windows = found.groupBy("ask").agg(F.sort_array(F.collect_list(F.struct("rank", "low", "high"))).alias("w"))
    fill = lambda field, none: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.get(F.col("w"), i)[field], F.lit(none).cast("long")))
    windows = windows.select("ask", fill("low", 1).alias("w_lo"), fill("high", 0).alias("w_hi"))
    asked = cut(asks.withColumn("same", F.lit(0)).join(windows, "ask"))
    negatives = search(index, asked, k).select("ask", (F.col("w") + 1).cast("int").alias("nth"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = found.select("ask", F.col("rank").alias("nth"), "positive_id", F.col("score").alias("positive_score"))
    named = asks.select("ask", F.col("vec_id").alias("anchor_id"))
    return negatives.join(pairs, ["ask", "nth"]).join(named, "ask").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mined(table: DataFrame) -> DataFrame:
    """:func:`hard_negatives` of a table of embeddings: every seventh id has a shifted label, every hundredth is an anchor."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = cut(quantised(table.withColumn("label", moved)))
    return hard_negatives(rows, rows.where("vec_id % 100 = 0"))
