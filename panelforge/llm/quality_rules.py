"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

Each rule is a condition on a text's counts that rejects it. On a bounded sample the cascade measures how long each rule
takes and which share of the texts it rejects, and orders the rules by rejection per cost. The verdict is one CASE
expression in that order, so a later rule's condition is evaluated only for texts that all earlier rules let pass. The order
changes the time, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Texts on which cost and selectivity are estimated, about; and how often a rule is applied to each to time it.
SAMPLE_ROWS, REPEAT = 1_000, 8

SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``rejects``: true for texts to drop; may use the columns of ``text_counts`` and ``words``, ``lines``, ``body``."""

    name: str
    rejects: Callable[[], Column]


def _share(part: Column, whole: Column, percent: int) -> Column:
    return part * 100 > whole * percent


#: Thresholds follow published heuristics for web text.
RULES = (
    Rule("many_symbols", lambda: _share(F.col("n_symbols"), F.col("n_words"), 10)),
    Rule("many_repeated_lines", lambda: _share(F.col("n_dup_lines"), F.size("lines"), 50)),
    Rule("odd_word_length", lambda: (F.col("word_chars") < F.col("n_words") * 2) | (F.col("word_chars") > F.col("n_words") * 15)),
    Rule("few_letters", lambda: _share(F.size(F.filter("words", lambda w: ~w.rlike(r"\p{L}"))), F.col("n_words"), 20)),
    Rule("bullet_lines", lambda: _share(F.size(F.filter("lines", lambda x: x.rlike(r"^[ \t-\r]*[-•*]"))), F.size("lines"), 90)),
    Rule("cut_lines", lambda: _share(F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)[ \t-\r]*$"))), F.size("lines"), 30)),
)


def _words(text: Column) -> Column:
    for blank in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more."""

    def covered(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            again = F.filter(s, lambda e, j: ((j > 0) & (F.get(s, j - 1)["h"] == e["h"])) | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False)))
            return F.array_sort(F.transform(again, lambda e: e["i"]))

        def total(at: Column) -> Column:
            return F.aggregate(F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)

        return common.let(common.let(pairs, places), total)

    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return common.let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def text_counts(docs: DataFrame) -> DataFrame:
    """``doc_id``, the base counts, and the arrays that rules read. Words are runs without ASCII white space."""
    body = common.id_and_text(docs).withColumnRenamed("text", "body")
    split = body.select("doc_id", "body", _words(F.col("body")).alias("words"), F.filter(F.split("body", "\n"), lambda x: x.rlike(r"[^ \t-\r]")).alias("lines"))
    return split.select(
        "doc_id",
        "words",
        "lines",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.char_length("body") - F.char_length(F.regexp_replace("body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )


def order_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, rejected share, cost) in the order in which the cascade applies them.

    The sample, about ``sample_rows`` texts of the whole table (all, if it has fewer), stays in the shared folder. A rule's
    cost is the time that a job takes to apply it ``REPEAT`` times to each sampled text, the least of three, net of a job
    with a rule that does nothing. Next in order is always the rule that rejects most per cost of the texts that those
    before it pass; its share is that of these texts. On an empty sample the rules keep their given order.
    """
    rows = docs.count()
    picked = docs.sample(fraction=sample_rows / rows, seed=5) if rows > sample_rows else docs
    sample = common.written(text_counts(picked), "rule-sample")
    flags = [F.coalesce(rule.rejects(), F.lit(False)).alias(f"r{k}") for k, rule in enumerate(rules)]
    groups = sample.select(*flags).groupBy(*(f"r{k}" for k in range(len(rules)))).agg(F.count("*").alias("n")).collect()
    repeated = sample.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(REPEAT))))

    def seconds(rejects: Column) -> float:
        began = time.perf_counter()
        repeated.agg(F.count_if(rejects)).collect()
        return time.perf_counter() - began

    nothing = min(seconds(F.col("again") < 0) for _ in range(3)) if groups else 0.0
    cost = [max(min(seconds(rule.rejects()) for _ in range(3)) - nothing, 1e-4) if groups else 1e-4 for rule in rules]
    common.dropped(sample)
    left, order = set(range(len(rules))), []
    while left:
        seen = sum(g["n"] for g in groups)
        hits = {k: sum(g["n"] for g in groups if g[f"r{k}"]) for k in left}
        best = min(left, key=lambda k: (-hits[k] / cost[k], k))
        order.append((rules[best], hits[best] / max(seen, 1), cost[best]))
        groups = [g for g in groups if not g[f"r{best}"]]
        left.remove(best)
    return order


def quality_cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id``, base counts, ``base_failed`` and ``kept`` for each document.

    ``base_failed``: under 50 words, or over half of the words repeated. ``kept``: neither that nor rejected by a rule. Null
    and empty texts have no words and fail. Whole texts count, however long; equal rows get equal verdicts; an empty table
    gives none; only ``doc_id`` and ``text`` are read.
    """
    counts = text_counts(docs)
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    verdict = F.when(F.col("base_failed"), False)
    for rule, _, _ in order_rules(docs, rules, sample_rows):
        verdict = verdict.when(F.coalesce(rule.rejects(), F.lit(False)), False)
    return counts.withColumn("base_failed", failed).withColumn("kept", verdict.otherwise(True)).drop("words", "lines")


ORACLE_SQL = r"""
WITH body AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), parts AS (
  SELECT rid, doc_id, t,
         list_filter(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^ \t\n\x0B\f\r]')) AS lines
  FROM body
), win AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM parts)
), hot AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM hot, (VALUES (0), (1), (2)) AS s(k) GROUP BY rid
), counts AS (
  SELECT p.rid, doc_id, words, lines, len(words)::BIGINT AS n_words,
         length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM parts p LEFT JOIN rep USING (rid)
), base AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed
            OR 100 * n_symbols > 10 * n_words
            OR 100 * n_dup_lines > 50 * len(lines)
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 100 * len(list_filter(words, lambda w: NOT regexp_matches(w, '\p{L}'))) > 20 * n_words
            OR 100 * len(list_filter(lines, lambda l: regexp_matches(l, '^[ \t\n\x0B\f\r]*[-•*]'))) > 90 * len(lines)
            OR 100 * len(list_filter(lines, lambda l: regexp_matches(l, '(\.\.\.|…)[ \t\n\x0B\f\r]*$'))) > 30 * len(lines)) AS kept
FROM base
"""
