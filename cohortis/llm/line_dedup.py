"""Line dedup: lines equal but for one word, by a join of deletion neighbourhoods; the earliest line stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import split_join
from ..session import cut, shuffles_removed, stored
from .shared import pinned, small

NEAR_WORDS = 3  # lines from so many words on are also compared with one edit; shorter ones must be equal
PLACES = 10**10  # more lines than a document can have
TIES = 10**8  # tells lines at one place of rows that repeat a doc_id apart
# Characters of scripts that set no blanks between words; each counts as a word.
UNSPACED = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}])"
BEYOND = r"[^\x00-\u0DFF]"  # all of them, cheaper to look for


def _lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, row_id, pos, norm, n)`` of the lines with a word: lower-cased words with single blanks between.

    The regular expressions run only on texts that hold what they look for.
    """
    text = F.lower("text")
    apart = F.regexp_replace(text, UNSPACED, " $1 ")
    far = (F.octet_length("text") > F.length("text")) & F.rlike(text, F.lit(BEYOND))
    text = F.when(far, apart).otherwise(text)
    odd = far
    for c in ("  ", "\t", "\r", "\f"):
        odd = odd | F.contains(F.col("text"), F.lit(c))
    tidy = F.regexp_replace(text, r"[\t\r\f][ \t\r\f]*| [ \t\r\f]+", " ")  # a single blank is left as it is
    text = F.when(odd, tidy).otherwise(text)
    lines = docs.select("doc_id", "row_id", F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    lines = lines.select("doc_id", "row_id", "pos", F.trim("line").alias("norm")).where("norm <> ''")
    blanks = F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit("")))
    return lines.withColumn("n", blanks + 1)


def _half_keys() -> list:
    """Keys of which two near lines share one: with an edit in one half, the other half is equal.

    A line acts as the shorter one (m words) and as one that has a word more (m = n - 1).
    """
    keys = []
    for m in ("n", "n - 1"):
        keys.append(F.expr(f"CAST(xxhash64('first', {m}, substring_index(norm, ' ', ({m}) div 2)) % 2147483647 AS INT)"))
        keys.append(F.expr(f"CAST(xxhash64('last', {m}, substring_index(norm, ' ', -(({m}) - ({m}) div 2))) % 2147483647 AS INT)"))
    return keys


def dropped_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, row_id, drops)``: places of the lines to remove, for rows of ``docs(doc_id, row_id, text)`` that have any.

    See :func:`without_repeated_lines` for what is dropped. All texts are read once, for the hashes of their lines; those
    that hold a line with a shared half are read again, for its words. A line is known by two hashes of its words and,
    where its words are at hand, by its first place with a few digits of the hash (``first``).
    """
    place = F.col("doc_id").cast("decimal(19,0)") * F.lit(PLACES * TIES).cast("decimal(20,0)")
    first = (place + (F.col("pos").cast("long") * F.lit(TIES) + F.pmod("h", F.lit(TIES)))).cast("decimal(38,0)")
    hashes = F.xxhash64("norm").alias("h"), F.xxhash64(F.lit(1), "norm").alias("g")
    halves = F.when(F.col("n") >= NEAR_WORDS, F.array(*_half_keys())).alias("halves")
    hashed = stored(_lines(docs).select("doc_id", "row_id", "pos", *hashes, halves))
    distinct = stored(hashed.select(first.alias("first"), "h", "g", *[F.get("halves", i).alias(f"half{i}") for i in range(4)]).groupBy("h", "g").agg(
        F.min("first").alias("first"), F.count("*").alias("c"), *[F.min(f"half{i}").alias(f"half{i}") for i in range(4)]))

    # Lines that share a half with another line; only they can have a partner. A line of n words meets lines of n by its
    # first two halves, and lines of n - 1 by the others, which are those lines' first two.
    kinds = F.array(*[F.struct(F.col(f"half{i}").alias("half"), F.lit(i // 2).alias("longer")) for i in range(4)])
    halves = distinct.where("half0 is not null").select("first", F.explode(kinds).alias("k")).select("first", "k.half", "k.longer")
    common = halves.groupBy("half").agg(F.count_if(F.col("longer") == 0).alias("s"), F.count_if(F.col("longer") == 1).alias("l"))
    common = cut(common.where("s > 1 OR (s > 0 AND l > 0)"))
    needs = {"replaced": "longer = 0 AND s > 1", "shortened": "longer = 1 AND s > 0", "whole": "longer = 0 AND l > 0"}
    chosen = split_join(halves, small(common), ["half"], "inner").groupBy("first").agg(*[F.expr(f"bool_or({v})").alias(k) for k, v in needs.items()])
    chosen = cut(chosen.where("replaced OR shortened OR whole"))
    home = F.floor(F.col("first") / F.lit(PLACES * TIES).cast("decimal(20,0)")).cast("long").alias("doc_id")
    texts = docs.join(small(chosen.select(home).distinct()), "doc_id", "left_semi")
    ranked = _lines(texts).where(F.col("n") >= NEAR_WORDS).withColumn("h", F.xxhash64("norm"))
    ranked = ranked.select(first.alias("first"), F.split("norm", " ").alias("words"), "n")
    apart = cut(ranked.join(small(chosen), "first").dropDuplicates(["first"]).select("first", "words", "n", *needs))

    # The words one deletion leaves, as a sum without carry over (place, word): the words before the gap keep their
    # place, those after it move up by one. One running total over the line gives all its variants.
    words = apart.select("first", "n", *needs, F.posexplode("words").alias("i", "word"))
    words = words.withColumns({"stay": F.xxhash64("word", "i"), "move": F.xxhash64("word", F.col("i") - 1)})
    line = "PARTITION BY first"
    variants = words.selectExpr(
        "first", "n", "i", *needs,
        f"bit_xor(stay) OVER ({line}) AS line",
        f"bit_xor(move) OVER ({line}) ^ move ^ coalesce(bit_xor(stay ^ move) OVER ({line} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS variant",
    )
    # Equal variants at one place: a word replaced. A variant that equals a whole line: a word more or less.
    keys = variants.selectExpr("first", """inline(array_compact(array(
        if(replaced, struct(xxhash64(variant, i, n) AS key, 0 AS role), null),
        if(shortened, struct(xxhash64(variant, -1, n - 1) AS key, 1 AS role), null),
        if(whole AND i = 0, struct(xxhash64(line, -1, n) AS key, 2 AS role), null))))""")
    earliest = keys.groupBy("key").agg(
        *[F.min(F.when(F.col("role") == r, F.col("first"))).alias(f"m{r}") for r in range(3)], F.count("*").alias("c")).where("c > 1")
    met = split_join(keys, earliest, ["key"], "inner").selectExpr("first", "CASE role WHEN 0 THEN m0 WHEN 1 THEN m2 ELSE m1 END AS earlier")
    met = cut(met.where(f"earlier - pmod(earlier, {TIES}) < first - pmod(first, {TIES})").distinct())

    # Verify on the words: equal up to the first difference, and after it.
    asked = met.select("first").union(met.select("earlier")).distinct()
    spelt = apart.select("first", "words").join(small(asked), "first", "left_semi")
    a = spelt.select("first", F.col("words").alias("a"))
    b = spelt.select(F.col("first").alias("earlier"), F.col("words").alias("b"))
    both = met.join(a, "first").join(b, "earlier")
    both = both.withColumn("at", F.expr("coalesce(array_position(zip_with(a, b, (x, y) -> x <=> y), false), greatest(size(a), size(b)) + 1)"))
    rest = "slice({0}, least(at + {1}, size({0}) + 1), size({0}))"
    same = both.where(F.expr(
        f"CASE size(a) - size(b) WHEN 0 THEN {rest.format('a', 1)} = {rest.format('b', 1)} "
        f"WHEN 1 THEN {rest.format('a', 1)} = {rest.format('b', 0)} WHEN -1 THEN {rest.format('a', 0)} = {rest.format('b', 1)} ELSE false END"))
    late = cut(same.select("first").distinct().withColumn("late", F.lit(True)))

    judged = distinct.select("h", "g", "first", "c").join(late, "first", "left").where("c > 1 OR late")
    judged = judged.select("h", "g", "first", F.coalesce("late", F.lit(False)).alias("late"))
    repeated = split_join(hashed.select("doc_id", "row_id", "pos", first.alias("own"), "h", "g"), judged, ["h", "g"], "inner")
    repeated = repeated.where(F.col("late") | (F.expr(f"own - pmod(own, {TIES}) > first - pmod(first, {TIES})")))
    return repeated.groupBy("doc_id", "row_id").agg(F.collect_set("pos").alias("drops"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with each text cut to its first-seen lines; ``n_lines`` and ``n_dropped`` are added.

    Lines end at line feeds and are compared as lower-cased words. Words stand between runs of blanks, tabs, carriage
    returns and form feeds; in scripts without blanks between words (``UNSPACED``) each character is a word. A line goes
    if an equal line stands earlier, in a smaller doc_id or further up in the same document, or, from three words on, if
    an earlier line of three words or more differs by one word replaced, added or left out. A line goes for any earlier
    partner, one that goes itself too. Lines without a word stay. Null texts stay null and empty ones empty, with 0
    dropped; rows with a null doc_id stay as they are. Rows that repeat a doc_id hold the same places: none of them is
    earlier. Other columns stay, whatever their names, but for ``n_lines`` and ``n_dropped``; an ``n_chars`` column is
    not recounted. An empty table stays empty.

    Lines travel as hashes. Documents are shuffled by doc_id for the final cut, and once before if the ids of those that
    hold a line with a shared half are too many to broadcast (they are counted).
    """
    others = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    docs = docs.select("doc_id", "text", F.struct(*others).alias("row"))
    known = docs.where("doc_id is not null").withColumn("row_id", F.xxhash64("text"))
    with shuffles_removed(docs.sparkSession):
        drops = dropped_lines(known.select("doc_id", "row_id", "text"))
    rows = known.join(drops, ["doc_id", "row_id"], "left").drop("row_id")
    rows = rows.unionByName(docs.where("doc_id is null").withColumn("drops", F.lit(None).cast("array<int>")))
    lines = pinned(rows, lines=F.split("text", "\n"))
    kept = F.expr("array_except(sequence(0, size(lines) - 1), drops)")
    cut_text = F.array_join(F.transform(kept, lambda i: F.col("lines")[i]), "\n")
    whole = F.when(F.col("drops").isNull(), F.col("text")).otherwise(cut_text)
    return lines.select(
        *[whole.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in others],
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
    )
