"""Language identification: known words first, shorter and shorter character n-grams for the others."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from ..session import cut

# The classifier is fitted on a bounded sample of the labelled rows: about so many documents of each language.
TRAIN_DOCS = 8_000
KNOWN_WORDS = 40_000  # most frequent words of each language that the model keeps
KNOWN_GRAMS = 20_000  # most frequent n-grams of each length and language
LONGEST = 4  # characters in an n-gram
REMEMBERED = 200_000  # unseen words whose scores a task keeps at hand

WORD = re.compile(r"[^\W\d_]+")
NONE = "und"


@dataclass
class Model:
    langs: list[str]
    words: dict[str, int]  # row of ``scores``
    grams: list[dict[str, int]]  # by length - 1
    scores: np.ndarray  # log frequencies, a row per word or n-gram, a column per language


class Fitted(Model):
    """A model as it comes from the counts, which stay columns; it is spelt out where it is first asked for.

    ``counts`` has ``(n, key, lang, c)``: characters of an n-gram (0: a word), language by number, occurrences.
    """

    def __init__(self, langs: list[str], counts: pa.Table) -> None:
        self.langs, self.counts = langs, counts

    @cached_property
    def _spelt(self) -> tuple[list[dict[str, int]], np.ndarray]:
        """Rows by key of words and of n-grams by length, and the smoothed log frequencies of all rows."""
        index, tables, at = [], [], 0
        for n in range(LONGEST + 1):
            part = self.counts.filter(pc.equal(self.counts["n"], n))
            keys = part["key"].combine_chunks().dictionary_encode()
            table = np.full((len(keys.dictionary), len(self.langs)), 0.5)  # half a count for all that is not kept
            np.add.at(table, (keys.indices.to_numpy(), part["lang"].to_numpy()), part["c"].to_numpy())
            tables.append(np.log(table / (table.sum(axis=0) + 0.5)))
            index.append(dict(zip(keys.dictionary.to_pylist(), range(at, at + len(table)))))
            at += len(table)
        return index, np.concatenate(tables)

    words = property(lambda self: self._spelt[0][0])
    grams = property(lambda self: self._spelt[0][1:])
    scores = property(lambda self: self._spelt[1])


def train(docs: DataFrame, text: str = "text", lang: str = "lang", per_lang: int = TRAIN_DOCS, seed: Column | None = None) -> Model:
    """Fit on the labelled rows of ``docs``; null labels and null texts teach nothing.

    ``per_lang`` bounds the sample: a language with more documents is thinned by a hash of ``seed`` (default: the text)
    to about so many. Words and n-grams of the sample are counted in Spark; the most frequent of each language
    (``KNOWN_WORDS``, ``KNOWN_GRAMS``) come to the driver, as columns. No labelled row gives a model without languages.
    """
    seed = F.col(text) if seed is None else seed
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(seed), F.lit(1 << 20)).alias("draw"))
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], {}, [{} for _ in range(LONGEST)], np.zeros((0, 0)))
    keep = F.create_map(*[F.lit(x) for k in langs for x in (k, int(min(1.0, per_lang / sizes[k]) * (1 << 20)))])
    number = F.create_map(*[F.lit(x) for k, v in enumerate(langs) for x in (v, k)])
    sample = labelled.where(F.col("draw") < keep[F.col("lang")]).select(number[F.col("lang")].alias("lang"), "text")

    def count(batches: Iterator) -> Iterator:
        for batch in batches:
            seen: dict[int, Counter] = {}
            for k, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                seen.setdefault(k, Counter()).update(WORD.findall(t.lower()))
            rows = [(k, w, c) for k, words in seen.items() for w, c in words.items()]
            k, w, c = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(w, pa.string()), pa.array(c, pa.int64())], ["lang", "word", "c"])

    words = sample.mapInArrow(count, "lang int, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("c"))
    words = cut(words)
    padded = F.concat(F.lit("^"), F.col("word"), F.lit("$"))

    def pieces(n: int) -> Column:
        """All runs of ``n`` characters, with the word's ends marked but in single letters; a shorter word is one run."""
        spelt = padded if n > 1 else F.col("word")
        at = F.sequence(F.lit(1), F.greatest(F.length(spelt), F.lit(n)) - n + 1)
        return F.transform(at, lambda i: F.struct(F.lit(n).alias("n"), F.substring(spelt, i, F.lit(n)).alias("g")))

    spelt = words.select("lang", "c", F.explode(F.concat(*[pieces(n) for n in range(1, LONGEST + 1)])).alias("x"))
    grams = spelt.select("lang", "x.n", F.col("x.g").alias("key"), "c").where(F.length("key") == F.col("n"))
    both = words.select("lang", F.lit(0).alias("n"), F.col("word").alias("key"), "c").union(grams)
    counted = both.groupBy("n", "lang", "key").agg(F.sum("c").alias("c")).where("c > 1")
    place = F.row_number().over(Window.partitionBy("n", "lang").orderBy(F.desc("c"), "key"))
    most = F.when(F.col("n") == 0, KNOWN_WORDS).otherwise(KNOWN_GRAMS)
    counted = counted.withColumn("place", place).where((F.col("place") <= max(KNOWN_WORDS, KNOWN_GRAMS)) & (F.col("place") <= most))
    counts = counted.select("n", "key", "lang", "c").toArrow()
    return Fitted(langs, counts.sort_by([("n", "ascending"), ("lang", "ascending"), ("c", "descending"), ("key", "ascending")]))


def _shares(scores: np.ndarray) -> np.ndarray:
    """Posterior share of each language by one word alone, under equal priors; rows are words."""
    odds = np.exp(scores - scores.max(axis=1, keepdims=True)) if scores.size else scores
    return odds / odds.sum(axis=1, keepdims=True) if scores.size else scores


class Scorer:
    """Scores texts with a model; an unseen word is scored once and remembered for a while."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.start()

    def start(self) -> None:
        self.rows = dict(self.model.words)
        none = np.zeros((REMEMBERED, len(self.model.langs)))
        self.table = np.concatenate([self.model.scores, none])
        self.shares = np.concatenate([_shares(self.model.scores), none])
        self.used = len(self.model.scores)

    def unseen(self, word: str) -> int:
        """Mean over the word's n-grams of the longest length that has a known one; no known letter says nothing."""
        value = np.zeros(len(self.model.langs))
        for n in range(LONGEST, 0, -1):
            text = f"^{word}$" if n > 1 else word
            index = self.model.grams[n - 1]
            hits = [index[g] for i in range(len(text) - n + 1) if (g := text[i : i + n]) in index]
            if hits:
                value = self.model.scores[hits].mean(axis=0)
                break
        self.table[self.used] = value
        self.shares[self.used] = _shares(value[None, :])[0]
        self.rows[word] = self.used
        self.used += 1
        return self.used - 1

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = WORD.findall(text.lower()) if text else []
        if not words or not self.model.langs:
            return NONE, 0.0
        total = np.zeros(len(self.model.langs))
        share = np.zeros(len(self.model.langs))
        for at in range(0, len(words), REMEMBERED // 2):
            part = words[at : at + REMEMBERED // 2]
            if self.used + len(part) > len(self.table):
                self.start()
            get, unseen = self.rows.get, self.unseen
            rows = [r if (r := get(w)) is not None else unseen(w) for w in part]
            total += self.table[rows].sum(axis=0)
            share += self.shares[rows].sum(axis=0)
        best = int(total.argmax())
        return self.model.langs[best], float(share[best] / len(words))


def predict(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted language and how far its words speak for it, one by one: the mean over the text's words of the

    posterior share (0 to 1) that a word alone gives to that language, under equal priors. It does not grow with the
    text: words that no language or all of them would use keep it low, however many they are.

    Whole texts are scored. Texts without a letter, and null ones, get ``und`` and 0; texts in which nothing is known
    get the first language and an even share. Ties go to the first language in alphabetical order. Columns named like
    the two new ones are replaced; rows stay as they are, repeated ones too; an empty table stays empty.
    """
    plain = docs.drop(lang, score)
    # Its size is bounded by the model's parameters. Plain values: workers need no installed copy of this package.
    fitted = isinstance(model, Fitted)
    plain_model = (model.langs, model.counts) if fitted else (model.langs, model.words, model.grams, model.scores)
    shared = docs.sparkSession.sparkContext.broadcast((plain_model, {}))

    def run(batches: Iterator) -> Iterator:
        values, held = shared.value
        if not held:  # a worker spells the model out once, not in each task
            held["model"] = Fitted(*values) if fitted else Model(*values)
        scorer = Scorer(held["model"])
        for batch in batches:
            found = [scorer(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                [*batch.schema.names, lang, score],
            )

    fields = [*plain.schema.fields, StructField(lang, StringType()), StructField(score, DoubleType())]
    return plain.mapInArrow(run, StructType(fields))


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents kept from training: the CRC-32 of the id as text leaves 2 when divided by 4; a null id is not one."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False)).cast(BooleanType())


def language_report(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of each row; the model learns from labelled rows that are not held out."""
    model = train(docs.where(~held_out()).select("doc_id", "text", "lang"), seed=F.col("doc_id"))
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")
