"""Mixing sources to target weights: budgets down a tree, then a token prefix of seeded epochs per leaf."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .shared import small

LEVELS = ("domain", "lang", "source")
# Target weights by level; a value that is not named weighs 1.
WEIGHTS: dict[str, dict[str, float]] = {
    "domain": {"web": 5.0, "books": 3.0, "reference": 2.0},
    "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0},
    "source": {},
}
EPOCHS = 2  # times a document may be used
SHARE = 0.8  # budget as a share of the tokens there are
SEED = 7
BUCKETS = 3  # hexadecimal digits of a draw by which a leaf is counted: 4096 buckets


def token_count(text: Column) -> Column:
    """Words at blanks and line ends; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\r\n]+")), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """The domain of a source by the number in its name: under 10 web, under 15 books, else reference."""
    number = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) AS int)")
    return F.when(number < 10, "web").when(number < 15, "books").otherwise("reference")


def _weight(level: str, weights: Mapping[str, Mapping[str, float]]) -> Column:
    named = weights.get(level, {})
    out = F.lit(1.0)
    for value, w in named.items():
        out = F.when(F.col(level) == value, F.lit(float(w))).otherwise(out)
    return out


def leaf_budgets(leaves: DataFrame, budget: int | Column, levels=LEVELS, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``leaves(levels..., tokens)`` with ``target``: the tokens each leaf gives, at most ``epochs`` times what it has.

    From the root down, a node's budget goes to its children by weight; a child whose subtree has less gives all it
    has, and its siblings share what is missing by weight. As no node is ever given more than its subtree has, a
    shortage reaches an uncle only when all siblings are used up. One window per level over the sums of that level.
    """
    full = leaves.withColumn("cap", F.col("tokens").cast("double") * epochs)
    total = full.agg(F.coalesce(F.sum("cap"), F.lit(0.0)).alias("cap"))
    above = total.select(F.least(F.lit(budget).cast("double") if not isinstance(budget, Column) else budget, F.col("cap")).alias("given"))
    for k in range(1, len(levels) + 1):
        own, up = list(levels[:k]), list(levels[: k - 1])
        nodes = full.groupBy(*own).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(own[-1], weights))
        nodes = nodes.crossJoin(F.broadcast(above)) if k == 1 else nodes.join(above, up)
        by = f"PARTITION BY {', '.join(up)}" if up else ""
        order = f"ORDER BY cap / w, {own[-1]}"
        nodes = nodes.selectExpr(
            "*",
            f"given - coalesce(sum(cap) OVER ({by} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0D) AS free",
            f"sum(w) OVER ({by} {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight",
        ).withColumn("capped", F.expr("cap * weight <= free * w + 1e-9"))
        nodes = nodes.selectExpr(
            *own, "cap", "capped", "w",
            f"given - sum(if(capped, cap, 0D)) OVER ({by}) AS left_over", f"sum(if(capped, 0D, w)) OVER ({by}) AS open_weight")
        above = nodes.selectExpr(*own, "if(capped, cap, left_over * w / open_weight) AS given")
    return leaves.join(above, list(levels)).withColumn("target", F.floor(F.col("given") + 1e-6)).drop("given")


def mix(docs: DataFrame, budget_share: float = SHARE, levels=LEVELS, weights=WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """Documents of the mixture: the rows of ``docs`` with ``epoch`` and ``n_tokens``, a row per use of a document.

    ``docs`` has the level columns, ``doc_id`` and ``text``; the budget is ``budget_share`` of all its tokens. A leaf
    uses its documents whole as often as its target allows; in the last epoch it takes them in an order drawn from
    (seed, epoch, doc_id) for as long as the running sum of tokens fits. Rows that repeat a doc_id are drawn together.
    Null level values are a value of their own (shown as they are); null texts have no tokens and fill no budget. An
    empty table gives none. Columns named ``epoch`` or ``n_tokens`` are replaced; all others stay, whatever their names.

    A leaf with most of the documents is not gathered: draws are counted by leaf and bucket, and only the bucket in
    which the target is reached is put in order.
    """
    names = [c for c in docs.columns if c not in ("epoch", "n_tokens")]
    keys = [f"_{c}" for c in levels]
    draws = docs.select("doc_id", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in levels],
                        token_count(F.col("text")).alias("n_tokens"))
    draws = cut(draws)  # narrow: texts are read for their tokens once here, and once for the result
    leaves = cut(draws.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens")))
    budget = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"] * budget_share
    plan = leaf_budgets(leaves, int(budget), levels, weights, epochs)
    plan = plan.withColumn("whole", F.expr("if(tokens > 0, least(target div tokens, {0}), {0})".format(epochs)).cast("int"))
    plan = plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("tokens")).select(*levels, "whole", "rest")
    plan = cut(plan.toDF(*keys, "whole", "rest"))

    own = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in zip(levels, keys)]
    used = docs.select(F.struct(*names).alias("row"), "doc_id", *own, token_count(F.col("text")).alias("n_tokens"))
    used = used.join(small(plan), keys)
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.col("doc_id").cast("string")))
    used = used.withColumn("draw", drawn).withColumn("bucket", F.substring("draw", 1, BUCKETS))

    last = draws.join(small(plan), [F.col(c) == F.col(k) for c, k in zip(levels, keys)]).where(F.col("whole") < epochs)
    last = last.select(*keys, "rest", drawn.alias("draw"), "n_tokens").withColumn("bucket", F.substring("draw", 1, BUCKETS))
    sums = last.groupBy(*keys, "rest", "bucket").agg(F.sum("n_tokens").alias("t"))
    before = sums.selectExpr("*", f"sum(t) OVER (PARTITION BY {', '.join(keys)} ORDER BY bucket) - t AS ahead")
    edge = before.where("ahead <= rest and ahead + t > rest").groupBy(*keys).agg(F.min("bucket").alias("bucket"), F.min("ahead").alias("ahead"))
    edge = small(cut(edge))
    inside = last.join(edge, [*keys, "bucket"]).selectExpr(
        *keys, "bucket", "draw", "rest", f"ahead + sum(n_tokens) OVER (PARTITION BY {', '.join(keys)} ORDER BY draw RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto")
    # The last draw that fits; a leaf without an edge takes all or, with nothing left of its target, nothing new.
    stop = edge.join(inside.where("upto <= rest").groupBy(*keys).agg(F.max("draw").alias("stop")), keys, "left")
    stop = stop.select(*keys, F.col("bucket").alias("edge"), F.coalesce("stop", F.col("bucket")).alias("stop"))
    used = used.join(small(cut(stop)), keys, "left")
    fits = (F.col("whole") < epochs) & (F.col("edge").isNull() | (F.col("draw") <= F.col("stop")))
    times = F.col("whole") + F.when(fits, 1).otherwise(0)
    used = used.withColumn("epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))))
    return used.select("row.*", "epoch", "n_tokens")
