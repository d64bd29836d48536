"""Quality rules: a table of thresholds compiled into one Spark projection.

Every measure is a Column over the whole text and every rule compares one
measure with bounds, so a document is judged where it is read: no shuffle and no
user function. ``quality_rules`` keeps every column of its input and adds the
measures, one boolean per rule and the verdict.

A null text counts as an empty one: all measures are 0 and it fails on length.
Texts of white space alone have no words. Columns of the input that bear a name
of this module's output are replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feefloor.llm.common import table

# Characters that part words, symbols, and frequent function
# words of the four languages of the corpus.
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
STOP_WORDS = ("the and of to in is that for with this "
              "der die das und ist nicht ein von zu mit "
              "le la les de et des que un une est "
              "el los en y por con para una del se").split()
WORD_BREAK = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= measure <= high``; an open end is None."""
    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The default table. Ratios are 0 where there is nothing to divide by.
RULES = (
    Rule("enough_words", "n_words", low=50),
    Rule("few_repeats", "repeat_ratio", high=0.5),
    Rule("word_length", "mean_word_chars", low=3, high=10),
    Rule("few_symbols", "symbol_ratio", high=0.1),
    Rule("few_shouts", "shout_ratio", high=0.3),
    Rule("stop_words", "stop_ratio", low=0.02),
    Rule("few_dup_lines", "dup_line_ratio", high=0.5),
)
BASE_RULES = ("enough_words", "few_repeats")


def repeat_words(words: Column, size: int = 3) -> Column:
    """Words inside windows of ``size`` words that occur at least twice.

    Windows are sorted by content; equal neighbours name the repeated ones, and
    their positions in order tell how many words they cover together.
    """
    shift = [F.slice(words, j + 1, F.greatest(F.size(words) - (size - 1), F.lit(0)))
             for j in range(size)]
    window = shift[0]
    for nxt in shift[1:]:
        window = F.zip_with(window, nxt, lambda a, b: F.concat(a, F.lit(" "), b))
    placed = F.array_sort(F.transform(window, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    # Fold over the sorted windows: the last one seen, whether it was already
    # taken, and the positions of repeated windows.
    start = F.struct(F.lit(None).cast("string").alias("w"), F.lit(-1).alias("i"))

    def neighbours(sorted_windows: Column) -> Column:
        before = F.concat(F.array(start), F.slice(
            sorted_windows, 1, F.greatest(F.size(sorted_windows) - 1, F.lit(0))))
        again = F.filter(F.zip_with(sorted_windows, before, lambda x, y: F.when(
            x["w"] == y["w"], F.array(y["i"], x["i"]))), lambda p: p.isNotNull())
        return F.array_sort(F.array_distinct(F.flatten(again)))

    # A one-element array binds the sorted windows to a name, so that they are
    # made once and not once for each use.
    positions = F.flatten(F.transform(F.array(placed), neighbours))
    covered = F.aggregate(
        positions, F.struct(F.lit(0).alias("n"), F.lit(-size).alias("at")),
        lambda s, p: F.struct((s["n"] + F.least(F.lit(size), p - s["at"])).alias("n"),
                              p.alias("at")))
    return covered["n"].cast("long")


def _measures(text: Column) -> list[dict[str, Column]]:
    """Named measures in layers; a layer may use the columns of those before."""
    def chars_of(column, chars):
        return F.length(column) - F.length(F.translate(column, chars, ""))

    def ratio(a, b):
        return F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))

    return [
        {"_text": F.coalesce(text, F.lit(""))},
        {"_words": F.filter(F.split("_text", WORD_BREAK), lambda w: w != ""),
         "_lines": F.filter(F.split("_text", "\n"),
                            lambda x: F.translate(x, SPACE, "") != "")},
        {"n_words": F.size("_words").cast("long"),
         "word_chars": F.length(F.translate("_text", SPACE, "")).cast("long"),
         "n_symbols": chars_of(F.col("_text"), SYMBOLS).cast("long"),
         "n_lines": F.size("_lines").cast("long"),
         "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
         "n_repeat_words": repeat_words(F.col("_words")),
         "n_stop_words": F.size(F.filter("_words", lambda w: F.lower(w).isin(
             *STOP_WORDS))).cast("long"),
         "n_shouts": chars_of(F.col("_text"), "!").cast("long")},
        {"mean_word_chars": ratio("word_chars", "n_words"),
         "symbol_ratio": ratio("n_symbols", "n_words"),
         "shout_ratio": ratio("n_shouts", "n_words"),
         "stop_ratio": ratio("n_stop_words", "n_words"),
         "repeat_ratio": ratio("n_repeat_words", "n_words"),
         "dup_line_ratio": ratio("n_dup_lines", "n_lines")},
    ]


def _passes(rule: Rule) -> Column:
    value, tests = F.col(rule.measure), [F.lit(True)]
    if rule.low is not None:
        tests.append(value >= rule.low)
    if rule.high is not None:
        tests.append(value <= rule.high)
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


def quality_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES,
                  base: tuple[str, ...] = BASE_RULES) -> DataFrame:
    """``docs`` with the measures, ``pass_<rule>``, ``base_failed`` and ``kept``.

    ``base_failed`` is true if a rule named in ``base`` fails, ``kept`` if none
    of ``rules`` fails.
    """
    out = docs
    for layer in _measures(F.col(text)):
        out = out.withColumns(layer)
    out = out.withColumns({f"pass_{r.name}": _passes(r) for r in rules})
    failed = [~F.col(f"pass_{r.name}") for r in rules if r.name in base]
    return out.withColumns({
        "base_failed": F.greatest(F.lit(False), F.lit(False), *failed),
        "kept": F.least(F.lit(True), F.lit(True), *[F.col(f"pass_{r.name}") for r in rules]),
    }).drop("_text", "_words", "_lines")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols",
                                      "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t,
        list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)),
                    lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
p AS (SELECT doc_id, unnest(ws) AS x, unnest(range(len(ws))) AS i FROM w),
g AS (SELECT doc_id, i, x AS a, lead(x, 1) OVER o AS b, lead(x, 2) OVER o AS c
      FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
      FROM g WHERE c IS NOT NULL),
k AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words
      FROM r, (VALUES (0), (1), (2)) AS s(j) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words,
        length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        length(t) - length(replace(t, '!', '')) AS n_shouts,
        len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words,
        len(list_filter(ws, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in sorted(set(STOP_WORDS)))})))
          AS n_stop
      FROM w LEFT JOIN k USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 2 * n_repeat_words > n_words AS base_failed,
  n_words >= 50 AND 2 * n_repeat_words <= n_words
    AND word_chars / n_words BETWEEN 3 AND 10 AND n_symbols / n_words <= 0.1
    AND n_shouts / n_words <= 0.3 AND n_stop / n_words >= 0.02
    AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.5) AS kept
FROM m"""
