"""Quality rules whose cutoffs are certified on labelled holdouts.

Every document is measured by four rules. A rule rejects a document whose value
is above the rule's cutoff in the document's stratum (its language). A cutoff is
used only if labelled good documents prove, at the stated confidence, that it
rejects few of them: the chance of seeing so few false rejections, were the true
rate as high as the limit, is an exact binomial tail, and it has to stay below
the error level of the test. Within one rule and stratum cutoffs are tested from
lenient to strict and testing stops at the first failure (a fixed sequence, which
needs no correction); over rules and strata the error level is divided by their
number. A stratum with too few labels therefore gets no cutoff and rejects nothing.

Everything is DataFrame functions; no Python runs on the executors.

Defined cases: a null text is empty. A null language is a stratum of its own.
A null id is a document like others (it has no label). Rows that repeat an id are
judged each by its own text, and each counts if the id is labelled. Contradicting
labels of one id count as the lowest. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.functions.plan import pin
from gavel.session import BROADCAST_ROWS, cut_lineage, stage

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
# All rules together may reject this share of a stratum's good documents,
FALSE_REJECTION = 0.02
# and the chance that any stratum breaks that is at most this.
ERROR = 0.05
# Cutoffs from lenient to strict; values are thousandths.
SHARE_CUTOFFS = [900, 800, 700, 600, 500, 400, 300, 200, 150, 100, 50, 20]
LENGTH_CUTOFFS = [30000, 25000, 20000, 17000, 15000, 13000, 12000, 11000, 10000, 9000, 8000]
RULES = {
    "symbols": ("n_symbols", "word_chars", SHARE_CUTOFFS),
    "dup_lines": ("n_dup_lines", "n_lines", SHARE_CUTOFFS),
    "repeats": ("n_repeat_words", "n_words", SHARE_CUTOFFS),
    "word_length": ("word_chars", "n_words", LENGTH_CUTOFFS),
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def measure(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """``keep`` and the six counts of each row's whole text.

    Eight-word windows are compared by their 64-bit hash inside one text. Only a
    text that has a repeated window sorts its windows to find their places.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.select(
        *keep,
        text.alias("_text"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)).alias("_lines"),
    )
    kept = [c for c in split.columns if c not in ("_text", "_words", "_lines")]
    n = F.size("_words")
    windows = F.transform(
        F.slice("_words", F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0))),
        lambda _, i: F.xxhash64(F.slice(F.col("_words"), i + 1, F.lit(WINDOW))),
    )
    counted = split.select(
        *kept,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        windows.alias("_windows"),
    )
    places = F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"),
        F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("p")))),
    )
    rest = [c for c in counted.columns if c != "_windows"]
    placed = counted.select(*rest, places.alias("_places"))
    at = F.col("_places")
    repeated = F.filter(
        at,
        lambda x, i: ((i > 0) & (F.get(at, i - 1)["h"] == x["h"]))
        | F.coalesce(F.get(at, i + 1)["h"] == x["h"], F.lit(False)),
    )
    starts = F.sort_array(F.transform(repeated, lambda x: x["p"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("words"), F.lit(-WINDOW).alias("last")),
        lambda a, p: F.struct(
            (a["words"] + F.least(F.lit(WINDOW), p - a["last"])).alias("words"), p.alias("last")
        ),
        lambda a: a["words"],
    )
    done = placed.select(*rest, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    # pinned: a filter on a count, put into its definition, would work it out for every window
    return pin(done, *BASE)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


def rule_value(rule: str) -> Column:
    """Whole thousandths of a ratio; 0 where the ratio has no denominator."""
    part, whole, _ = RULES[rule]
    return F.coalesce(F.expr(f"(1000 * {part}) div nullif({whole}, 0)"), F.lit(0).cast("long"))


def _log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1: Stirling's series, moved up by ten for accuracy."""
    z = x + 10
    shift = sum((F.log(x + i) for i in range(1, 10)), F.log(x))
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p) where k < n p; elsewhere 1 (no test passes there).

    The terms fall off from k downwards, so the sum runs from k over sixty standard
    deviations; what it leaves out is below the precision of a double.
    """
    k, n = k.cast("double"), n.cast("double")
    first = (
        _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    )
    reach = F.least(k, F.ceil(60 * F.sqrt(n * p)) + 100).cast("int")
    steps = F.when(reach > 0, F.sequence(F.lit(0), reach - 1)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(
        steps,
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, j: F.struct(
            (a["term"] * (k - j) * (1 - p) / ((n - k + j + 1) * p)).alias("term"),
            (a["sum"] + a["term"] * (k - j) * (1 - p) / ((n - k + j + 1) * p)).alias("sum"),
        ),
        lambda a: a["sum"],
    )
    return F.when(k < n * p, F.exp(first + F.log(total))).otherwise(1.0)


def certified_cutoffs(
    measured: DataFrame,
    labels: DataFrame,
    false_rejection: float = FALSE_REJECTION,
    error: float = ERROR,
) -> DataFrame:
    """One row per stratum that has labelled good documents: ``stratum`` and a cutoff
    (or null) per rule, as ``cut_<rule>``.

    ``measured`` has ``doc_id``, ``stratum`` and the counts of :func:`measure`.
    """
    good = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .where("quality = 1")
        .select("doc_id")
    )
    holdout = measured.where(~base_failed()).join(good, "doc_id")
    tests = [
        F.struct(
            F.lit(rule).alias("rule"),
            F.lit(step).alias("step"),
            F.lit(cutoff).cast("long").alias("cutoff"),
            (rule_value(rule) > cutoff).cast("long").alias("rejected"),
        )
        for rule, (_, _, cutoffs) in RULES.items()
        for step, cutoff in enumerate(cutoffs)
    ]
    # strata x tests rows, written once: the number of strata divides the error level
    counts = cut_lineage(
        holdout.select("stratum", F.inline(F.array(*tests)))
        .groupBy("stratum", "rule", "step", "cutoff")
        .agg(F.count("*").alias("n"), F.sum("rejected").alias("k"))
    )
    n_strata = max(1, counts.select("stratum").distinct().count())
    level = error / (len(RULES) * n_strata)
    limit = false_rejection / len(RULES)
    tested = counts.withColumn("passed", binomial_tail(F.col("k"), F.col("n"), limit) <= level)
    failed = tested.groupBy("stratum", "rule").agg(
        F.min(F.when(~F.col("passed"), F.col("step"))).alias("first_failure"),
        F.collect_list(F.struct("step", "cutoff")).alias("cutoffs"),
    )
    last = F.array_max(
        F.filter("cutoffs", lambda c: F.col("first_failure").isNull() | (c["step"] < F.col("first_failure")))
    )["cutoff"]
    chosen = failed.select("stratum", "rule", last.alias("cutoff"))
    return chosen.groupBy("stratum").agg(
        *[F.max(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"cut_{rule}") for rule in RULES]
    )


def judged(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``; rows keep their number.

    At most ``BROADCAST_ROWS`` strata are broadcast, so that the rows stay in place.
    """
    over = F.lit(False)
    for rule in RULES:
        over = over | F.coalesce(rule_value(rule) > F.col(f"cut_{rule}"), F.lit(False))
    cut = cut_lineage(cutoffs.withColumnRenamed("stratum", "_stratum"))
    if cut.count() <= BROADCAST_ROWS:
        cut = F.broadcast(cut)
    joined = measured.join(cut, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    failed = base_failed()
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & ~over).drop("_stratum")


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): the counts, ``base_failed`` and ``kept``.

    The counts are written once to the shared checkpoint folder; labels meet only them.
    """
    keep = [F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("stratum")]
    measured = cut_lineage(measure(docs, keep))
    return judged(measured, certified_cutoffs(measured, labels)).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "n_lines",
        "stratum",
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    The rows are measured once and staged beside their counts: the cutoffs read the counts
    only, and the kept rows are read from the stage, without a shuffle of texts. What fails
    the base goes before the stage.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "lang", "text")
    keep = [F.col("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("stratum")]
    measured = stage(measure(rows, keep).where(~base_failed()))
    return judged(measured, certified_cutoffs(measured, labels)).where("kept").select("_row.*")
