"""Quality rules with risk-controlled thresholds. DataFrame functions only.

A document is measured once; fixed rules fail it outright, and one composite risk-controlled rule rejects it if any measure
lies beyond its cutoff. The composite has a fixed sequence of ever stricter steps, each with one cutoff for every measure. For
each stratum (the language) the strictest step is taken that is certified, on the labelled documents, to reject at most a share
``risk`` of good documents. The certificate is an exact binomial test: seeing so few rejections among so many good documents
would have a probability of at most the level if the true share were above ``risk``. Steps are tested in their order until one
fails, which needs no correction among the steps (fixed-sequence testing), and the level is ``error`` divided by the number of
strata (Bonferroni). So with probability 1 - ``error`` the bound holds for what is rejected as a whole, in every stratum at
once. A stratum with fewer than log(level) / log(1 - risk) good documents certifies nothing and rejects nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, materialise

#: Fixed rules.
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 20, 30, 8
#: Largest share of good documents that the composite rule may reject in a stratum, and the chance that any certificate is wrong.
#: At this risk about 300 good documents without a rejection are enough for a certificate among five strata.
RISK, ERROR = 0.015, 0.05
#: Measures, of which large values are bad, and their cutoffs at the steps from the loosest to the strictest.
RULES = {
    "symbols_per_word": [2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1],
    "duplicate_lines": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15],
    "repeated_words": [0.28, 0.26, 0.24, 0.22, 0.2, 0.18, 0.16, 0.14, 0.12, 0.1],
    "upper_share": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25],
    "repeats_per_word": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15],
}
STEPS = 10

_SPACE = " \t\n\x0b\x0c\r"


def repeated_words(words: Column) -> Column:
    """Words that lie in windows of ``WINDOW`` words found twice or more, each word counted once.

    Windows are compared by a 64-bit hash of their words' hashes. Sorting (hash, position) brings equal windows together; the
    positions, sorted again, give the covered words in one pass.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return F.array_sort(F.transform(starts, lambda i: F.struct(F.xxhash64(F.slice(h, i + 1, WINDOW)).alias("h"), i.alias("at"))))

    def positions(s: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(s, j)["h"] == F.get(s, i)["h"], F.lit(False))
        twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
        return F.array_sort(F.transform(twice, lambda i: F.get(s, i)["at"]))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

        def step(state: Column, i: Column) -> Column:
            return F.struct((i + WINDOW).alias("end"), (state["n"] + i + WINDOW - F.greatest(state["end"], i)).alias("n"))

        return F.aggregate(at, start, step, lambda x: x["n"])

    counted = bind(hashes, lambda h: bind(windows(h), lambda s: covered(positions(s))))
    return F.when(F.size(words) > WINDOW, counted).otherwise(0).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the rules' measures.

    Words are runs of characters other than space and 0x09-0x0D. A null text has none, a null lang is a stratum of its own.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(lang, F.lit("")).alias("stratum"), text.alias("text"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    length = F.length("text")
    without = lambda signs: F.length(F.translate("text", signs, ""))

    def counts(w: Column) -> Column:
        adjacent = F.size(F.filter(F.sequence(F.lit(0), F.size(w)), lambda i: F.coalesce(F.get(w, i) == F.get(w, i - 1), F.lit(False))))
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"), adjacent.cast("long").alias("repeats"))

    upper = length - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    lower = length - without("abcdefghijklmnopqrstuvwxyz")
    rows = rows.select(
        "doc_id", "stratum", bind(words, counts).alias("c"), without(_SPACE).cast("long").alias("word_chars"), (length - without("#*$%&|<>")).cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("l"), upper.alias("upper"), lower.alias("lower"),
    )
    n = F.greatest(F.col("c.n_words"), F.lit(1))
    return rows.select(
        "doc_id", "stratum", "c.n_words", "word_chars", "n_symbols", (F.col("l.n") - F.col("l.d")).cast("long").alias("n_dup_lines"), "c.n_repeat_words",
        (F.col("n_symbols") / n).alias("symbols_per_word"), ((F.col("l.n") - F.col("l.d")) / F.greatest("l.n", F.lit(1))).alias("duplicate_lines"),
        (F.col("c.n_repeat_words") / n).alias("repeated_words"), (F.col("upper") / F.greatest(F.col("upper") + F.col("lower"), F.lit(1))).alias("upper_share"),
        (F.col("c.repeats") / n).alias("repeats_per_word"),
    )


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), exactly, by summing its terms in logarithms.

    Terms far below the largest are lost in rounding, not added up wrongly; the sum costs k steps.
    """
    odds = math.log(p) - math.log1p(-p)
    first = n * math.log1p(-p)

    def step(state: Column, j: Column) -> Column:
        term = state["term"] + F.log((n - j + 1) / j) + odds
        top = F.greatest(state["sum"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(state["sum"] - top) + F.exp(term - top))).alias("sum"))

    total = F.aggregate(F.sequence(F.lit(1), k), F.struct(first.alias("term"), first.alias("sum")), step, lambda s: s["sum"])
    return F.when(k == 0, F.exp(first)).when(k >= n, 1.0).otherwise(F.exp(total))


def failed_rules(step: Column) -> Column:
    """The rules that a row's measures fail at a step (null: none)."""
    cutoff = lambda rule: F.get(F.lit(RULES[rule]), step)
    return F.filter(F.array(*(F.when(F.col(r) > cutoff(r), F.lit(r)) for r in RULES)), lambda r: r.isNotNull())


def thresholds(measured: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """stratum, step, rejected, good, p_value, level: the strictest certified step of each stratum that has one.

    Good documents are those labelled 1 that no fixed rule fails, all of them; null labels are left out.
    """
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long")).distinct()
    held = measured.where(~base_failed()).join(good, "doc_id", "left_semi")
    sums = [F.sum((F.size(failed_rules(F.lit(i))) > 0).cast("long")) for i in range(STEPS)]
    counted = materialise(held.groupBy("stratum").agg(F.count("*").alias("good"), F.array(*sums).alias("rejected")), "rejections")
    strata = counted.count()  # as many rows as there are languages
    tested = counted.select("stratum", "good", F.posexplode("rejected").alias("step", "rejected"))
    p = F.when(F.col("rejected") > risk * F.col("good"), 1.0).otherwise(binomial_tail(F.col("rejected"), F.col("good").cast("double"), risk))
    tested = tested.withColumn("p_value", p).withColumn("level", F.lit(error / max(strata, 1)))
    best = tested.groupBy("stratum").agg(F.min(F.when(F.col("p_value") > F.col("level"), F.col("step"))).alias("stop"))
    passed = tested.join(best, "stratum").where(F.col("step") == F.coalesce("stop", F.lit(STEPS)) - 1)
    return passed.select("stratum", "step", "rejected", "good", "p_value", "level")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, the five counts, base_failed, kept, and failed_rules, the risk-controlled rules it fails.

    A document is kept if it passes the fixed rules and the certified step of its stratum. Null and empty texts have no words and
    fail; a text of any length is measured whole. Repeated rows keep a row each, an empty table gives an empty one. Of other
    columns only ``lang`` is read, whatever their names.
    """
    measured = materialise(measures(docs), "measures")
    steps = thresholds(measured, labels).select(F.col("stratum").alias("of"), "step")
    # As many rows as there are strata; languages do not grow with the documents, and Spark checks the size before it broadcasts.
    joined = measured.join(steps, F.col("stratum") == F.col("of"), "left")
    out = joined.withColumn("base_failed", base_failed()).withColumn("failed_rules", failed_rules(F.col("step")))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), F.array_join("failed_rules", ",").alias("failed_rules"),
    )


def _sql() -> str:
    listed = lambda rule: "[" + ", ".join(map(str, RULES[rule])) + "]"
    fails = lambda step: ", ".join(f"CASE WHEN {r} > {listed(r)}[{step}] THEN '{r}' END" for r in RULES)
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents
), grams AS (
  SELECT doc_id, i, list_slice(w, i, i + {WINDOW - 1}) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT doc_id, sum(least({WINDOW}, i - coalesce(before, i - {WINDOW})))::BIGINT AS n
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM twice) GROUP BY doc_id
), c AS (
  SELECT d.doc_id, stratum, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS upper, length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) AS lower,
    len(list_filter(list_zip(w[:-2], w[2:]), lambda x: x[1] = x[2])) AS repeats
  FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id
), m AS (
  SELECT *, n_symbols / greatest(n_words, 1) AS symbols_per_word, n_dup_lines / greatest(n_lines, 1) AS duplicate_lines, n_repeat_words / greatest(n_words, 1) AS repeated_words,
    upper / greatest(upper + lower, 1) AS upper_share, repeats / greatest(n_words, 1) AS repeats_per_word,
    n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed FROM c
), held AS (
  SELECT * FROM m WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
), counted AS (
  SELECT stratum, s.step, count(*) AS good, count(*) FILTER (len(list_filter([{fails('s.step')}], lambda x: x IS NOT NULL)) > 0) AS rejected
  FROM held, (SELECT unnest(range(1, {STEPS + 1})) AS step) s GROUP BY stratum, s.step
), tested AS (
  SELECT stratum, step, list_sum(list_transform(range(0, rejected + 1),
    lambda j: exp(lgamma(good + 1) - coalesce(lgamma(nullif(j, 0) + 1), 0) - lgamma(good - j + 1) + j * ln({RISK}) + (good - j) * ln(1 - {RISK}))))
      > {ERROR} / (SELECT count(DISTINCT stratum) FROM held) AS failed FROM counted
), best AS (
  SELECT stratum, coalesce(min(step) FILTER (failed), {STEPS + 1}) - 1 AS step FROM tested GROUP BY stratum
), judged AS (
  SELECT m.*, list_filter([{fails('nullif(best.step, 0)')}], lambda x: x IS NOT NULL) AS fails FROM m LEFT JOIN best ON m.stratum = best.stratum
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(fails) = 0 AS kept, array_to_string(fails, ',') AS failed_rules FROM judged
"""


#: The rows of ``judge`` over documents and labels, for DuckDB.
JUDGE_SQL = _sql()
