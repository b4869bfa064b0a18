"""Benchmark decontamination: spaced-seed hashes of token runs, joined and then verified along the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import pinned, small, words

WINDOW = 13  # tokens in a row that make an overlap
SUBSTITUTIONS = 2  # of them may differ
# Token places that each seed reads. Whichever two of thirteen tokens are replaced, one of the seeds fits beside them.
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 5, 6, 7, 8))
SEED_ROWS = 1_000_000  # seeds of benchmarks that are broadcast, at 24 bytes each


def _hashed(text: str) -> Column:
    """Hashes of the tokens: runs of letters and digits, lower-cased."""
    return F.coalesce(F.transform(words(F.col(text)), lambda w: F.xxhash64(w)), F.array().cast("array<bigint>"))


def _seeds(tokens: str, masks: tuple) -> Column:
    """Seed hashes of all places, mask after mask, each padded with nulls to one entry per token."""
    each = []
    for k, mask in enumerate(masks):
        read = ", ".join(f"{tokens}[i + {p}]" for p in mask)
        each.append(F.expr(
            f"transform(sequence(0, size({tokens}) - 1), i -> if(i + {mask[-1]} < size({tokens}), xxhash64({k}, {len(mask)}, {read}), null))"
        ))
    return F.when(F.size(tokens) > 0, F.concat(*each)).otherwise(F.array().cast("array<bigint>"))


def _placed(df: DataFrame, tokens: str, masks: tuple, *keep: str) -> DataFrame:
    """One row per seed: ``seed`` and ``at``, the token it starts at."""
    rows = df.select(*keep, F.size(tokens).alias("n"), F.posexplode(_seeds(tokens, masks)).alias("p", "seed"))
    return rows.where("seed is not null").select(*keep, (F.col("p") % F.col("n")).alias("at"), "seed")


def overlaps(docs: DataFrame, tests: DataFrame, window: int = WINDOW, substitutions: int = SUBSTITUTIONS) -> DataFrame:
    """``(doc_id, item_id, first_token, n_equal)`` of documents that hold a passage of a benchmark item.

    A passage is ``window`` tokens in a row with at most ``substitutions`` replaced; an item with fewer tokens must
    occur whole and unchanged. ``first_token`` is the first token of the earliest such window in the document,
    ``n_equal`` the most equal tokens in one. Reads ``docs(doc_id, text)`` and ``tests(item_id, text)``; null and empty
    texts hold nothing, rows without an id are left out, rows that repeat an id count as one. Empty tables give no rows.

    The seeds of the benchmark are broadcast if they are few (counted), else both sides are shuffled by seed. Seeds
    find places only; the decision compares all tokens on the diagonal of a hit.
    """
    items = pinned(tests.where("item_id is not null").select("item_id", "text"), tok=_hashed("text")).select("item_id", "tok").where("size(tok) > 0")
    short = sorted(r[0] for r in items.select(F.size("tok").alias("n")).where(F.col("n") < window).distinct().collect())  # under ``window`` values
    masks = MASKS if (window, substitutions) == (WINDOW, SUBSTITUTIONS) else ((*range(window // (substitutions + 1)),),)
    whole = tuple(tuple(range(n)) for n in short)

    def seeds(df: DataFrame, key: str) -> DataFrame:
        return _placed(df, "tok", (*masks, *whole), key)

    # A short item is sought as a whole only, so its seeds are those of its own length.
    spaced = seeds(items.where(F.size("tok") >= window), "item_id")
    if short:
        for n in short:
            mask = tuple(range(n))
            k = len(masks) + whole.index(mask)
            one = items.where(F.size("tok") == n).select(
                "item_id", F.lit(0).alias("at"), F.expr(f"xxhash64({k}, {n}, {', '.join(f'tok[{i}]' for i in mask)})").alias("seed"))
            spaced = spaced.union(one)
    spaced = small(spaced.select("item_id", F.col("at").alias("item_at"), "seed"), SEED_ROWS)

    rows = pinned(docs.where("doc_id is not null").select("doc_id", "text"), tok=_hashed("text"))
    hits = seeds(rows.select("doc_id", "tok"), "doc_id").join(spaced, "seed")
    diagonals = hits.select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()

    sought = diagonals.join(small(items.withColumnRenamed("tok", "item")), "item_id")
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    both = pinned(sought.join(texts, "doc_id"), tok=_hashed("text")).drop("text")
    both = both.withColumn("from", F.greatest(F.col("shift"), F.lit(0)))
    both = both.withColumn("n", F.least(F.size("tok"), F.col("shift") + F.size("item")) - F.col("from"))
    both = both.withColumn("w", F.least(F.lit(window), F.size("item"))).where("n >= w")
    both = both.withColumn("need", F.when(F.col("w") < window, F.col("w")).otherwise(F.lit(window - substitutions)))
    both = pinned(both, same=F.expr("zip_with(slice(tok, from + 1, n), slice(item, from - shift + 1, n), (x, y) -> if(x = y, 1, 0))"))
    both = pinned(both.drop("tok", "item"), equal=F.expr(
        "transform(sequence(1, n - w + 1), i -> aggregate(slice(same, i, w), 0, (s, x) -> s + x))"))
    place = F.expr("array_position(transform(equal, e -> e >= need), true)")
    found = both.withColumn("place", place).where("place > 0")
    return found.groupBy("doc_id", "item_id").agg(
        F.min(F.col("from") + F.col("place") - 1).cast("long").alias("first_token"),
        F.max(F.array_max("equal")).cast("long").alias("n_equal"),
    )


def uncontaminated(docs: DataFrame, tests: DataFrame, **how: int) -> DataFrame:
    """The rows of ``docs`` that hold no passage of a benchmark; rows with a null id stay."""
    return docs.join(overlaps(docs, tests, **how).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
