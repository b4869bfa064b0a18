"""Personal data: loose generators propose spans, boosted trees judge them, calibrated thresholds select."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, boost

# Kinds in the order that breaks ties; their patterns, and looser ones of the generators. The patterns
# are those of the task with possessive repeats, and where a run can only start at its first character, a look behind
# it (or at the end of the last match), which keeps long runs from being tried again at each of their characters.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "mail-like": r"[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){0,8}+",
    "dotted": r"(?<![0-9.])[0-9]{1,3}+(?:[.:][0-9]{1,3}+){3,5}+",
    "digits": r"[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,24}+",
}
CUES = r"(?i)(?:phone|call|tel|fax|mobile|mail|contact|card|account|iban|address|ip|server|host)[\x20:.]*$"
FEATURES = ("f_gen", "f_digits", "f_marks", "f_plus", "f_at", "f_luhn", "f_quad", "f_before", "f_after", "f_cue")
PRECISION = 0.98  # of a generator's selected candidates, measured on documents kept from fitting
CONTEXT = 24  # characters on either side that features see
ANY = "text LIKE '%@%' OR text LIKE '%(at)%' OR text LIKE '%[at]%' OR rlike(text, '[0-9]')"


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    # From the right, every second digit is doubled, less 9 when over 9.
    ordered = F.split(F.reverse(digits), "")
    values = F.transform(
        F.filter(ordered, lambda c: c != ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(values, F.lit(0), lambda s, v: s + v) % 10 == 0


def _valid(kind: str, span: Column) -> Column:
    digits = _digits(span)
    if kind == "ip":
        return F.forall(F.split(span, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^([0-9]{0,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits).between(14, 19) & _luhn(F.when(F.length(digits).between(14, 19), digits).otherwise("0"))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _matches(rows: DataFrame, name: str, pattern: str) -> DataFrame:
    """``(doc_id, row, kind, start, end, span, before, after)`` of all matches, in code points.

    Splitting at a pattern gives what lies between its matches, so a match starts after the pieces and matches before
    it; a running sum over the row's matches places them.
    """
    hits = rows.select("doc_id", "row", F.split("text", pattern).alias("pieces"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("hits"))
    hits = hits.where(F.size("hits") > 0)
    parts = hits.select("doc_id", "row", F.posexplode(F.arrays_zip(
        F.transform("pieces", F.length).alias("gap"), "hits",
        F.transform("pieces", lambda p: F.right(p, F.lit(CONTEXT))).alias("before"),
        F.expr(f"transform(slice(pieces, 2, size(pieces)), p -> left(p, {CONTEXT}))").alias("after"))).alias("i", "m"))
    parts = parts.select("doc_id", "row", "i", "m.*").where("hits is not null")
    so_far = "OVER (PARTITION BY row ORDER BY i ROWS UNBOUNDED PRECEDING)"
    placed = parts.selectExpr("*", f"sum(gap + length(hits)) {so_far} AS end")
    return placed.select(
        "doc_id", "row", F.lit(name).alias("kind"), (F.col("end") - F.length("hits")).alias("start"), "end",
        F.col("hits").alias("span"), "before", "after")


def base_spans(rows: DataFrame) -> DataFrame:
    """``(doc_id, row, kind, start, end)`` of well-formed spans of the base kinds."""
    out = None
    for kind in KINDS:
        found = _matches(rows, kind, PATTERNS[kind]).where(_valid(kind, F.col("span"))).select("doc_id", "row", "kind", "start", "end")
        out = found if out is None else out.union(found)
    return out


def _class(text: Column, end: str) -> Column:
    """0 nothing there, 1 white space, 2 a letter or digit, 3 anything else."""
    c = F.right(text, F.lit(1)) if end == "last" else F.left(text, F.lit(1))
    return F.when(F.coalesce(c, F.lit("")) == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"[\p{L}\p{N}]"), 2).otherwise(3)


def candidates(rows: DataFrame) -> DataFrame:
    """Spans of the generators, which overlap each other and the base spans, with format and context features."""
    out = None
    for k, (name, pattern) in enumerate(GENERATORS.items()):
        found = _matches(rows, name, pattern).withColumn("f_gen", F.lit(k))
        out = found if out is None else out.union(found)
    digits = _digits(F.col("span"))
    n = F.length(digits)
    quad = F.col("span").rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") & _valid("ip", F.when(F.col("span").rlike(r"^[0-9.]+$"), F.col("span")).otherwise("999"))
    as_int = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return out.withColumns({
        "f_digits": F.when(n < 7, 0).when(n < 10, 1).when(n < 12, 2).when(n < 14, 3).when(n < 16, 4).when(n < 20, 5).otherwise(6),
        "f_marks": F.least(F.length(F.regexp_replace("span", r"[^\x20().-]", "")), F.lit(3)),
        "f_plus": as_int(F.col("span").startswith("+")),
        "f_at": as_int(F.col("span").contains("@")),
        "f_luhn": as_int(F.when(n.between(14, 19), _luhn(F.when(n.between(14, 19), digits).otherwise("0")))),
        "f_quad": as_int(quad),
        "f_before": _class(F.col("before"), "last"),
        "f_after": _class(F.col("after"), "first"),
        "f_cue": as_int(F.col("before").rlike(CUES)),
    }).select("doc_id", "row", F.col("kind").alias("gen"), "start", "end", *FEATURES)


def _met(spans: DataFrame, base: DataFrame) -> DataFrame:
    """``spans`` with ``hit``: whether one overlaps a base span of its row; by running bounds in order of place."""
    both = spans.withColumn("is_base", F.lit(False)).unionByName(base.select("doc_id", "row", "start", "end").withColumn("is_base", F.lit(True)), allowMissingColumns=True)
    order = "PARTITION BY row ORDER BY start"
    both = both.selectExpr(
        "*", f"max(if(is_base, end, null)) OVER ({order} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_end",
        f"min(if(is_base, start, null)) OVER ({order} RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_start")
    hit = F.coalesce(F.col("last_end") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next_start") < F.col("end"), F.lit(False))
    return both.where("not is_base").withColumn("hit", hit).drop("is_base", "last_end", "next_start")


def fit(spans: DataFrame, precision: float = PRECISION) -> tuple[Boosted, dict[int, float]]:
    """The trees, and for each generator the log-odds from which its candidates are taken.

    Labels are weak: a candidate that overlaps a well-formed span is one. All candidates are counted by feature cell
    (the cells are at most the product of the features' few values); every fifth document, by hash, calibrates instead
    of fitting. A generator without a cut of the wanted precision selects nothing.
    """
    counted = spans.groupBy(*FEATURES).agg(*[
        F.sum(F.when(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0, x if k else 0).otherwise(0 if k else x)).alias(name)
        for name, k, x in (("n", 0, F.lit(1)), ("pos", 0, F.col("hit").cast("int")), ("n_cal", 1, F.lit(1)), ("pos_cal", 1, F.col("hit").cast("int")))
    ]).orderBy(*FEATURES).collect()
    cells = [tuple(int(r[f]) for f in FEATURES) for r in counted]
    fitted = [i for i, r in enumerate(counted) if r["n"]]
    model = boost([cells[i] for i in fitted], [counted[i]["n"] for i in fitted], [counted[i]["pos"] for i in fitted])
    cuts: dict[int, float] = {}
    for gen in range(len(GENERATORS)):
        scored = sorted(((model.score(c), r["n_cal"], r["pos_cal"]) for c, r in zip(cells, counted) if c[0] == gen and r["n_cal"]), reverse=True)
        n = pos = 0
        cuts[gen] = float("inf")
        for k, (s, a, b) in enumerate(scored):
            n, pos = n + a, pos + b
            last = k + 1 == len(scored) or scored[k + 1][0] < s
            if last and pos >= precision * n and s > log(precision / (1 - precision)) - 4:
                cuts[gen] = s
    return model, cuts


def personal_spans(rows: DataFrame) -> DataFrame:
    """``(doc_id, row, kind, start, end)``: base spans, and ``likely`` ones that the model takes beside them.

    A likely span is a run of selected, overlapping candidates none of which touches a base span.
    """
    base = base_spans(rows)
    spans = _met(candidates(rows), base)
    model, cuts = fit(spans)
    chosen = F.lit(False)
    for gen, cut_at in cuts.items():
        if cut_at != float("inf"):
            chosen = chosen | ((F.col("f_gen") == gen) & (F.col("score") >= cut_at - 1e-9))
    free = spans.where("not hit").withColumn("score", model.column(FEATURES)).where(chosen)
    runs = free.selectExpr("doc_id", "row", "start", "end", "max(end) OVER (PARTITION BY row ORDER BY start, end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before")
    runs = runs.selectExpr("*", "sum(if(before > start, 0, 1)) OVER (PARTITION BY row ORDER BY start, end ROWS UNBOUNDED PRECEDING) AS run")
    likely = runs.groupBy("doc_id", "row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return base.union(likely.select("doc_id", "row", F.lit("likely").alias("kind"), "start", "end"))


def with_personal_spans(docs: DataFrame) -> DataFrame:
    """``(doc_id, spans)`` of each row of ``docs(doc_id, text)``: an array of ``(start, kind_no, kind, end)`` in order.

    Places are code points, ends exclusive; order is by start and then kind (email, ip, card, phone, likely). Null and
    empty texts have no spans; repeated rows have equal spans; other columns are not read; an empty table stays empty.
    Rows without a digit, an @ or a written (at) are answered without a shuffle. The others are shuffled as spans.
    """
    rows = docs.select("doc_id", "text")
    rich = rows.where(f"coalesce({ANY}, false)").withColumn("row", F.monotonically_increasing_id())
    plain = rows.where(f"not coalesce({ANY}, false)")
    number = F.coalesce(F.array_position(F.array(*map(F.lit, (*KINDS, "likely"))), F.col("kind")), F.lit(0))
    found = personal_spans(rich).select("doc_id", "row", F.struct("start", number.alias("kind_no"), "kind", "end").alias("s"))
    none = rich.select("doc_id", "row", F.lit(None).cast(found.schema["s"].dataType).alias("s"))
    grouped = found.union(none).groupBy("row", "doc_id").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    empty = F.array().cast(grouped.schema["spans"].dataType)
    return grouped.select("doc_id", "spans").union(plain.select("doc_id", empty.alias("spans")))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first one counts."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        done = F.struct(s.end.cast("long").alias("at"), F.concat(
            acc.out, F.substr(text, (acc.at + 1).cast("int"), (s.start - acc.at).cast("int")), F.lit("["), s.kind, F.lit("]")).alias("out"))
        return F.when(s.start >= acc.at, done).otherwise(acc)

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc.out, F.substr(text, (acc.at + 1).cast("int"), F.length(text))))


def personal_report(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, the digest of their spans, and all spans."""
    found = with_personal_spans(docs)

    def as_text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s.kind.isin(*KINDS))
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
