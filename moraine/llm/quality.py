"""Quality rules as a short-circuit cascade.

Every rule is a Boolean column that is true where a document must go; the two base
rules (too few words, too much repetition) are rules like the others.  On a random
sample of the whole table each rule's selectivity and its cost, metrics included,
are measured, and the rules are then chained in a CASE expression by rejections per
second, so most bad documents meet one cheap rule and never pay for the dear ones:
the windows that the repetition rule sorts are made only for texts that reach it.
The order never changes a verdict: a document is rejected if any rule rejects it.

`judge` reports the base metrics of every document, whatever its verdict, so it
computes them all, and its cascade starts with the base rules; `keep_good` filters
and computes what a document's verdict takes.

Defined results: a null or empty text has no words, so it fails the base rule
(fewer than 50 words); repeated rows are judged one by one; null ids are passed
through; an empty table gives an empty table; other columns pass through.  `judge`
replaces columns that have one of the seven names in `METRICS`; `keep_good` leaves
all columns as they are.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, words_of

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
_WORDS, _TRIGRAMS, _TEXT = "__q_words", "__q_trigrams", "__q_text"


@dataclass(frozen=True)
class Rule:
    """`rejects` may use the metric columns, the text (`Rule.TEXT`) and its words (`Rule.WORDS`)."""

    name: str
    rejects: Column
    TEXT = _TEXT
    WORDS = _WORDS


def _inline() -> dict[str, Column]:
    """The metrics that rules read, as expressions of the text and its words."""
    text = F.col(_TEXT)
    return {
        "n_words": F.size(_WORDS).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": F.aggregate(
            # One pass over the lines in order: equal lines stand side by side.
            F.sort_array(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))),
            F.struct(F.lit("").alias("last"), F.lit(0).alias("n")),
            lambda a, x: F.struct(x.alias("last"), (a["n"] + F.when(a["last"] == x, 1).otherwise(0)).alias("n")),
            lambda a: a["n"],
        ).cast("long"),
    }


def default_rules(metric: dict[str, Column] | None = None) -> list[Rule]:
    metric = metric or {name: F.col(name) for name in METRICS}
    n = metric["n_words"]
    text = F.col(_TEXT)
    lines = F.greatest(F.size(F.split(text, "\n")), F.lit(1))
    matches = lambda pattern: F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return [
        Rule("symbols", metric["n_symbols"] * 10 > n),
        # Fewer than 2 or more than 15 characters a word, naming them once.
        Rule("word_length", F.abs(2 * metric["word_chars"] - 17 * n) > 13 * n),
        Rule("duplicate_lines", metric["n_dup_lines"] * 2 > lines),
        Rule("exclamations", F.length(F.regexp_replace(text, "[^!]+", "")) * 5 > n),
        Rule("ellipsis_lines", matches(r"(?m)(?:\.\.\.|…)[ \t]*$") * 10 > 3 * lines),
        Rule("bullet_lines", matches(r"(?m)^[ \t]*[•‣◦*\-]") * 10 > 9 * lines),
        Rule("wordless", F.size(F.filter(F.col(_WORDS), lambda w: w.rlike(r"\p{L}"))) * 10 < 8 * n),
        Rule("shouting", F.size(F.filter(F.col(_WORDS), lambda w: (F.upper(w) == w) & (F.lower(w) != w))) * 2 > n),
    ]


#: The base rules; what the second reads is made by `_repetition`.
FEW, REPETITION = "few_words", "repetition"


def base_rules() -> list[Rule]:
    return [Rule(FEW, F.size(_WORDS) < 50), Rule(REPETITION, F.col("__q_repeats") * 100 > F.size(_WORDS) * 50)]


def _repetition(out: DataFrame, wanted: Column) -> DataFrame:
    """Adds `__q_repeats`, the words in windows of three that occur twice, where `wanted`; elsewhere it is 0 and costs nothing."""
    w, t, s = F.col(_WORDS), F.col(_TRIGRAMS), F.col("__q_sorted")
    grams = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    out = out.withColumn(_TRIGRAMS, F.when(~wanted | (F.size(w) < 3), F.array().cast("array<string>")).otherwise(grams))
    # Only texts with some repeated window pay for the sort that finds where the repeats are.
    out = out.withColumn("__q_sorted", F.when(F.size(F.array_distinct(t)) < F.size(t), F.sort_array(F.transform(t, lambda x, i: F.struct(x.alias("t"), i.alias("p"))))))
    repeated = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["t"] == x["t"])) | (F.get(s, i + 1)["t"] == x["t"]))
    hit = F.size(F.array_distinct(F.flatten(F.transform(repeated, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))))
    return out.withColumn("__q_repeats", F.when(s.isNull(), F.lit(0)).otherwise(hit).cast("long"))


def with_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base metrics, and the helper columns the rules read."""
    out = docs.withColumn(_TEXT, F.coalesce(F.col(text), F.lit(""))).withColumn(_WORDS, words_of(F.col(_TEXT)))
    out = _repetition(out, F.lit(True)).withColumn("__q_lines", F.filter(F.split(F.col(_TEXT), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    found = _inline() | {"n_dup_lines": (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long"), "n_repeat_words": F.col("__q_repeats")}
    return out.withColumns(found).withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))


def order_rules(docs: DataFrame, rules: Sequence[Rule], text: str = "text", sample_rows: int = 400, sample_chars: int = 20_000, runs: int = 3) -> list[Rule]:
    """Rules by measured rejections per second, best first.

    The sample is a random one of about `sample_rows` rows of the whole table, of
    which at most `sample_chars` characters are timed.  Each rule's time is the
    least of `runs`.  It decides the order of evaluation and nothing else.
    """
    spark = docs.sparkSession
    total = docs.count()
    if not total:
        return list(rules)
    rows = docs.select(F.substring(F.coalesce(F.col(text), F.lit("")), 1, sample_chars).alias(_TEXT)).sample(fraction=min(1.0, sample_rows / total), seed=1).collect()
    if not rows:
        return list(rules)
    sample = spark.createDataFrame(rows, f"{_TEXT} string").coalesce(1).withColumn(_WORDS, words_of(F.col(_TEXT))).cache()
    try:
        sample.count()

        def run(rule: Rule | None) -> tuple[float, int]:
            began = time.perf_counter()
            judged = sample if rule is None or rule.name != REPETITION else _repetition(sample, F.lit(True))
            got = judged.agg(F.sum(F.lit(0) if rule is None else F.when(rule.rejects, 1).otherwise(0))).first()
            return time.perf_counter() - began, int(got[0] or 0)

        floor = min(run(None)[0] for _ in range(runs + 1))
        measured = []
        for place, rule in enumerate(rules):
            times = [run(rule) for _ in range(runs)]
            measured.append((-times[0][1] / max(min(x for x, _ in times) - floor, 1e-3), place, rule))
    finally:
        sample.unpersist()
    return [rule for _, _, rule in sorted(measured, key=lambda x: x[:2])]


def judge(docs: DataFrame, text: str = "text", rules: Sequence[Rule] | None = None, ordered: bool = True) -> DataFrame:
    """Adds the base metrics, `base_failed` and `kept` to every row."""
    given = list(rules) if rules is not None else None
    if ordered:
        names = [x.name for x in order_rules(docs, given or default_rules(_inline()), text)]
        given = sorted(given or default_rules(), key=lambda x: names.index(x.name))
    chain = F.when(F.col("base_failed"), True)
    for rule in given or default_rules():
        chain = chain.when(rule.rejects, True)
    out = with_metrics(docs, text).withColumn("kept", ~chain.otherwise(False))
    return out.drop(_TEXT, _WORDS, _TRIGRAMS, "__q_lines", "__q_sorted", "__q_repeats")


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` that the rules keep, with the columns of `docs`."""
    rules = order_rules(docs, [*base_rules(), *default_rules(_inline())], text)
    out = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("__row"), F.coalesce(F.col(text), F.lit("")).alias(_TEXT)).withColumn(_WORDS, words_of(F.col(_TEXT)))
    gone = F.when(F.lit(False), True)
    for rule in rules:
        if rule.name == REPETITION:
            out = _repetition(out.withColumn("__q_gone", F.coalesce(gone, F.lit(False))), ~F.col("__q_gone"))
            gone = F.when(F.col("__q_gone"), True)
        gone = gone.when(rule.rejects, True)
    judged = out.select("__row", F.coalesce(gone, F.lit(False)).alias("__gone"))
    # Counts of what went in and out, for listeners.  No filter is moved below them, where it would evaluate the words
    # and windows of a text anew for each element.
    judged = judged.observe(f"quality-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("judged"), F.count_if("__gone").alias("rejected"))
    return judged.where(~F.col("__gone")).select("__row.*")


def query(docs: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text")).select("doc_id", *METRICS)


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
         string_split(coalesce(text, ''), chr(10)) AS all_lines
  FROM documents),
m AS (
  SELECT *, len(w) AS n,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         list_filter(all_lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
tri AS (
  SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM m WHERE n >= 3)),
twice AS (SELECT doc_id, t FROM tri GROUP BY doc_id, t HAVING count(*) > 1),
hits AS (
  SELECT doc_id, count(DISTINCT q) AS n_repeat_words
  FROM (SELECT tri.doc_id, unnest([p, p + 1, p + 2]) AS q FROM tri JOIN twice USING (doc_id, t))
  GROUP BY doc_id),
b AS (
  SELECT m.*, coalesce(hits.n_repeat_words, 0) AS n_repeat_words,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines
  FROM m LEFT JOIN hits USING (doc_id)),
v AS (
  SELECT *, n < 50 OR n_repeat_words * 100 > n * 50 AS base_failed, len(all_lines) AS n_lines
  FROM b)
SELECT doc_id, n::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed
         OR n_symbols * 10 > n
         OR word_chars < 2 * n OR word_chars > 15 * n
         OR n_dup_lines * 2 > n_lines
         OR length(regexp_replace(text, '[^!]+', '', 'g')) * 5 > n
         OR len(regexp_extract_all(text, '(?m)(?:\.\.\.|\x{{2026}})[ \t]*$')) * 10 > 3 * n_lines
         OR len(regexp_extract_all(text, '(?m)^[ \t]*[\x{{2022}}\x{{2023}}\x{{25E6}}*\-]')) * 10 > 9 * n_lines
         OR len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) * 10 < 8 * n
         OR len(list_filter(w, lambda x: upper(x) = x AND lower(x) <> x)) * 2 > n) AS kept
FROM v
"""
