"""Personal data: fixed patterns, and bootstrapped contextual extraction of what they miss. DataFrame functions only.

The fixed kinds are email addresses, IP addresses, card numbers and phone numbers. Values that stand behind a label, as
``tel: ...`` or ``user_mail = "..."``, are the instances of that label's lexical pattern. In running text the two and the
three words before a seed, and those behind it, are patterns; their instances are all values that stand there, and other
words that do count as misses. Instances that hold an entity of a fixed kind are the seeds; a pattern's confidence is the
mean score of its instances (0 for misses), an instance's score the noisy or of its patterns' confidences (1 for seeds), and
both are recomputed over the graph of patterns and instances for a few rounds. Instances of confident patterns with enough
seeds are personal data of the pattern's kind, whatever their form; a bare word of letters never is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, fresh_name, materialise, running

#: Kinds in the order of the span lists.
KINDS = ("email", "ip", "card", "phone")

# The kinds' patterns. A match may begin only where the last one ended or no character before could belong to
# it, and repeats are possessive, which changes no match but keeps the time linear in the text.
_LOCAL = r"A-Za-z0-9._%+-"
_PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

#: A label, its delimiter and the value behind it.
_LABELLED = r"(?<![A-Za-z_-])([A-Za-z_][A-Za-z_-]++)(\x20?[=:]\x20?[\"']?)([+(]?[0-9][0-9\x20().-]{3,}[0-9]|[^\s\"'<>,;]{4,}+)"
#: What marks a word in running text as a value, and such a value: a number with spaces, or a word up to its closing marks.
_MARK = r"[0-9@]|[(\[{]at[)\]}]"
_VALUE = rf"(?<![^\s\"'(<\[])(?:[+(]?[0-9][0-9\x20().-]{{3,}}[0-9]|(?=[^\s\"'<>,;]*?(?:{_MARK}))[^\s\"'<>,;]{{3,}}[^\s\"'<>,;.!?:)\]}}])"
#: Characters beside a value in which the words of a phrase must stand.
_BESIDE = 120
#: Labelled values that are more than a word of letters.
_NO_WORD = r"[^\p{L}].*[^.!?:)\s]|[0-9@]"
#: Rounds of scoring, and what a pattern needs to discover instances: confidence, and distinct seed values.
ROUNDS, CONFIDENCE, SEEDS = 4, 0.8, 5
#: Phrases that their misses keep from ever being confident take no part. A share of the texts (one in so many) shows that for
#: most of them, as misses only grow with more texts; the last share is all texts, so the outcome does not depend on the others.
SHARES = (256, 16, 1)

_SPAN = "struct<start: int, end: int, text: string>"


def _matches(text: Column, pattern: str) -> Column:
    """array of (start, end, text) of a pattern's matches, in characters."""
    both = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, m: F.struct(F.length(p).alias("before"), m.alias("m")))
    def spans(found: Column) -> Column:
        at = running(F.transform(found, lambda x: x["before"] + F.length(x["m"])), F.lit(0), lambda a, n: a + n)
        return F.zip_with(found, at, lambda x, a: F.struct((a + x["before"]).alias("start"), (a + x["before"] + F.length(x["m"])).alias("end"), x["m"].alias("text")))

    return bind(F.filter(both, lambda x: x["m"].isNotNull()), spans)


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """array of (start, end, text) of a fixed kind: leftmost matches that do not overlap, less those that fail its test."""
    found = F.filter(_matches(text, _PATTERNS[kind]), lambda s: _valid(kind, s["text"]))
    needed = F.contains(text, F.lit(_NEEDS[kind])) if _NEEDS[kind] else text.rlike(_PATTERNS[kind])
    return F.when(needed, found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _beside(text: Column, s: Column) -> Column:
    """array of the phrases beside a span: L or R for the side, and two or three words in lower case."""
    left = F.substring(text, F.greatest(s["start"] - _BESIDE, F.lit(0)) + 1, F.least(s["start"], F.lit(_BESIDE)))
    left = F.concat(F.when(s["start"] <= _BESIDE, " ").otherwise(""), F.regexp_replace(left, r"[\"'(<\[]+$", ""))
    right = F.concat(F.substring(text, s["end"] + 1, F.lit(_BESIDE)), F.when(F.length(text) - s["end"] <= _BESIDE, " ").otherwise(""))
    found = [(side, F.regexp_extract(of, pattern, 1)) for side, of, pattern in (
        ("L", left, r"\s(\S+\s+\S+)\s+$"), ("L", left, r"\s(\S+\s+\S+\s+\S+)\s+$"), ("R", right, r"^\S*\s+(\S+\s+\S+)\s"), ("R", right, r"^\S*\s+(\S+\s+\S+\s+\S+)\s"),
    )]
    phrases = F.array(*(F.when(x != "", F.concat(F.lit(f"{side} "), F.regexp_replace(F.lower(x), r"\s+", " "))) for side, x in found))
    return F.filter(phrases, lambda p: p.isNotNull())


def _misses(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """pattern, misses: how many different words that are no values stand where a value of the phrase (pattern) would."""
    words = F.filter(F.split(F.lower(F.col("text").cast("string")), r"\s+"), lambda w: w != "")

    def grams(n: int) -> Column:
        at = F.when(F.size("words") >= n, F.sequence(F.lit(0), F.size("words") - n)).otherwise(F.array().cast("array<int>"))
        beside = lambda i: F.when(i >= 0, F.get("words", i))
        return F.transform(at, lambda i: F.struct(F.array_join(F.slice("words", i + 1, n), " ").alias("phrase"), beside(i - 1).alias("before"), beside(i + n).alias("after")))

    every = docs.select(words.alias("words")).select(F.explode(F.concat(grams(2), grams(3))).alias("g")).select("g.*")
    wanted = phrases.select("pattern", F.substring("pattern", 1, 1).alias("side"), F.expr("substring(pattern, 3)").alias("phrase"))
    word = every.join(wanted, "phrase").select("pattern", F.when(F.col("side") == "L", F.col("after")).otherwise(F.col("before")).alias("word"))
    return word.where(F.col("word").isNotNull() & ~F.col("word").rlike(_MARK)).distinct().groupBy("pattern").agg(F.count("*").alias("misses"))


def _spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, added): each row's fixed spans by (doc_id, h), and the spans that confident patterns add, by the same key."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("h"))
    labelled = F.when(F.contains("text", F.lit("=")) | F.contains("text", F.lit(":")), _matches(F.col("text"), _LABELLED)).otherwise(F.array().cast(f"array<{_SPAN}>"))
    rows = rows.select("doc_id", "h", *(base_spans(F.col("text"), k).alias(k) for k in KINDS), labelled.alias("labelled"), F.transform(_matches(F.col("text"), _VALUE), lambda s: s.withField("beside", _beside(F.col("text"), s))).alias("prose"))
    short = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    rows = materialise(rows.select("doc_id", "h", *(short(k).alias(k) for k in KINDS), "labelled", F.filter("prose", lambda s: F.size(s["beside"]) > 0).alias("prose")), "spans")

    # Every labelled value, with the kind of the fixed span that it overlaps, if any.
    one = rows.where(F.size("labelled") > 0).select("doc_id", "h", *KINDS, F.explode("labelled").alias("s"))
    value = F.regexp_extract("s.text", _LABELLED, 3)
    one = one.select(
        "doc_id", "h", *KINDS, (F.col("s.end") - F.length(value)).alias("start"), F.col("s.end").alias("end"), F.lower(value).alias("value"),
        F.concat(F.lower(F.regexp_extract("s.text", _LABELLED, 1)), F.regexp_extract("s.text", r"[=:]", 0)).alias("pattern"),
    )
    seed = F.coalesce(*(F.when(F.exists(k, lambda b: (b["start"] < F.col("end")) & (b["end"] > F.col("start"))), F.lit(k)) for k in KINDS))
    named = one.select("doc_id", "h", "start", "end", "value", "pattern", seed.alias("kind"))

    # Every value in running text beside a phrase that stands beside enough seeds.
    near = rows.where(F.size("prose") > 0).select("doc_id", "h", *KINDS, F.explode("prose").alias("s"))
    near = near.select("doc_id", "h", "s.start", "s.end", F.lower("s.text").alias("value"), F.explode("s.beside").alias("pattern"), *KINDS).withColumn("kind", seed).drop(*KINDS)
    beside = near.groupBy("pattern").agg(F.count_distinct(F.when(F.col("kind").isNotNull(), F.col("value"))).alias("seeds"), F.count_distinct("value").alias("n"))
    phrases = materialise(beside.where(F.col("seeds") >= SEEDS).select("pattern", "n"), "phrases")
    for share in SHARES:
        some = docs.where(F.pmod(F.xxhash64(F.col("text").cast("string")), F.lit(share)) == 0)
        misses = materialise(_misses(some, phrases), "misses")
        phrases = materialise(phrases.join(misses, "pattern", "left").where(F.col("n") / (F.col("n") + F.coalesce("misses", F.lit(0)) + 1) >= CONFIDENCE).select("pattern", "n"), "phrases")
    values = materialise(named.union(near.join(phrases, "pattern").select(*named.columns)).distinct(), "labelled")
    edges = materialise(values.groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "graph")
    scores = edges.withColumn("score", F.col("kind").isNotNull().cast("double"))

    def trusted(scores: DataFrame, *more: Column) -> DataFrame:
        by = scores.groupBy("pattern").agg(F.sum("score").alias("sum"), F.count("*").alias("n"), *more).join(misses, "pattern", "left")
        return by.withColumn("trust", F.col("sum") / (F.col("n") + F.coalesce("misses", F.lit(0)) + 1))

    for _ in range(ROUNDS):
        trust = trusted(scores)
        doubt = edges.join(trust, "pattern").groupBy("value").agg(F.sum(F.log(1 - F.col("trust"))).alias("doubt"), F.max("kind").alias("seed"))
        score = F.when(F.col("seed").isNotNull(), 1.0).otherwise(1 - F.exp("doubt"))
        scores = materialise(edges.join(doubt.select("value", score.alias("score")), "value"), "graph")
    good = (
        trusted(scores, F.count("kind").alias("seeds"), F.mode("kind", deterministic=True).alias("as_kind"))
        .where((F.col("trust") >= CONFIDENCE) & (F.col("seeds") >= SEEDS)).select("pattern", "as_kind")
    )
    new = values.where(F.col("kind").isNull() & F.col("value").rlike(_NO_WORD)).join(good, "pattern")
    added = new.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set(F.struct(F.array_position(F.lit(list(KINDS)), F.col("as_kind")).alias("o"), "start", "end"))).alias("added"))
    return rows, added.withColumnRenamed("doc_id", "added_id").withColumnRenamed("h", "added_h")


def _all_spans(rows: DataFrame, added: DataFrame) -> DataFrame:
    joined = rows.join(added, rows.doc_id.eqNullSafe(added.added_id) & (rows.h == added.added_h), "left")

    def numbered(n: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(F.lit(n).cast("long").alias("o"), s["start"].alias("start"), s["end"].alias("end")))

    fixed = F.concat(*(numbered(n, k) for n, k in enumerate(KINDS, 1)))
    return joined.withColumn("fixed", fixed).withColumn("found", F.sort_array(F.array_union("fixed", F.coalesce("added", F.array().cast("array<struct<o: bigint, start: int, end: int>>")))))


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.lit(list(KINDS)), s["o"].cast("int")), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone (fixed kinds), base_sha256, spans, n_added.

    ``base_sha256`` digests the list of the fixed spans, ``spans`` lists all: kind:start:end by kind, then start, in characters,
    end exclusive, joined by commas. A null text is empty and has none; a text of any length is searched whole. Repeated rows keep a
    row each, an empty table gives an empty one, and other columns are not looked at, whatever their names.
    """
    rows, added = _spans(docs)
    return _all_spans(rows, added).select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(_listed("fixed").cast("binary"), 256).alias("base_sha256"),
        _listed("found").alias("spans"), (F.size("found") - F.size("fixed")).cast("long").alias("n_added"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets, as ``[EMAIL]``, and ``n_chars``, if there is one, of the new text.

    Of overlapping spans the first (the longest of those with one start) names the replacement of them all.
    """
    rows, added = _spans(docs)
    of_id, of_text, spans = (fresh_name(docs, name) for name in ("span_id", "span_text", "span_list"))
    key = _all_spans(rows, added).where(F.size("found") > 0).select(F.col("doc_id").alias(of_id), F.col("h").alias(of_text), F.col("found").alias(spans)).dropDuplicates([of_id, of_text])
    joined = docs.join(key, F.col("doc_id").cast("long").eqNullSafe(F.col(of_id)) & (F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col(of_text)), "left")
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("e"), s["o"].alias("o"))))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    names = F.lit([f"[{k.upper()}]" for k in KINDS])

    def step(state: Column, s: Column) -> Column:
        end = -s["e"]
        clear = F.concat(state["out"], F.substring(F.col("text"), state["at"] + 1, s["start"] - state["at"]), F.element_at(names, s["o"].cast("int")))
        return F.struct(F.greatest(state["at"], end).alias("at"), F.when(s["start"] >= state["at"], clear).otherwise(state["out"]).alias("out"))

    new = F.aggregate(by_start, begin, step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    out = joined.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(new))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)
