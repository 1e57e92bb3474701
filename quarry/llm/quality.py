"""Quality rules: a threshold table compiled into one projection of built-in expressions.

Null text counts as text without words. Texts of any length are read whole; a word 3-gram is told
apart by the 64-bit hash of its three words. Every input row gives one output row, so repeated rows,
ties and further columns (also of clashing names) pass through untouched; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import let, read, split_words

#: Symbols; frequent function words of en, fr, de, es, it, pt, nl.
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "with", "this", "as", "on", "by",
    "de", "la", "le", "les", "des", "du", "et", "un", "une", "que", "qui", "dans", "pour", "en", "au",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "ein", "eine", "nicht", "sich", "ist",
    "el", "los", "las", "y", "se", "por", "con", "para", "del", "una", "no",
    "il", "di", "che", "per", "o", "e", "da", "do", "os", "het", "een", "van",
)


@dataclass(frozen=True)
class Rule:
    """Keep a text if low <= numerator / denominator <= high (0 / 0 counts as 0)."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Ratios of whole-text counts, so a text scales with its length.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbol_ratio", "n_symbols", "n_words", high=0.2),
    Rule("shout_ratio", "n_shouts", "n_words", high=0.5),
    Rule("stop_word_ratio", "n_stop_words", "n_words", low=0.01),
    Rule("letter_word_ratio", "n_letter_words", "n_words", low=0.6),
    Rule("dup_line_ratio", "n_dup_lines", "n_lines", high=0.5),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that the text holds twice or more, the first included."""
    grams = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(words) - 3, F.lit(0))),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return let(ordered, twice)

    def twice(s: Column) -> Column:
        same = F.filter(s, lambda e, k: (e["x"] == F.get(s, k + 1)["x"]) | ((k > 0) & (e["x"] == F.get(s, F.greatest(k - 1, F.lit(0)))["x"])))
        spots = F.flatten(F.transform(same, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))
        return F.size(F.array_distinct(spots))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(grams, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_letter_words", "n_shouts")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus the long columns COUNTS, which replace columns of the same names.

    The counts leave an explode of one struct: an optimizer may push filters and projections into plain
    projections, and would then split a text into words once for each count that is read."""
    body = F.coalesce(F.col(text), F.lit(""))

    def counts(words: Column, lines: Column) -> Column:
        values = (
            F.size(words),
            F.length(F.array_join(words, "")),
            F.regexp_count(body, F.lit(f"[{SYMBOLS}]")),
            F.size(lines) - F.size(F.array_distinct(lines)),
            _repeat_words(words),
            F.size(lines),
            F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS))),
            F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))),
            F.length(body) - F.length(F.replace(body, F.lit("!"))),
        )
        return F.struct(*[v.cast("long").alias(k) for k, v in zip(COUNTS, values, strict=True)])

    words = split_words(body)
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one = let(F.struct(words.alias("w"), lines.alias("l")), lambda s: counts(s["w"], s["l"]))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in COUNTS]
    return docs.select(*kept, F.explode(F.array(one)).alias("_m")).select(*kept, *[F.col(f"_m.{c}") for c in COUNTS])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a measured row breaks, compiled from the table."""

    def broken(r: Rule) -> Column:
        ratio = F.when(F.col(r.denominator) > 0, F.col(r.numerator) / F.col(r.denominator)).otherwise(F.lit(0.0))
        out = F.lit(False)
        if r.low is not None:
            out = out | (ratio < r.low)
        if r.high is not None:
            out = out | (ratio > r.high)
        return F.when(out, F.lit(r.name))

    return F.array_compact(F.array(*[broken(r) for r in rules]))


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """measure(docs) plus base_failed, broken_rules (array) and kept."""
    return measure(docs, text).withColumn("base_failed", base_failed()).withColumn("broken_rules", verdict(rules)).withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))


def keep(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that pass every rule, with the columns of docs."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("_row"), F.col(text).alias("_text"))
    return judge(inner, "_text", rules).filter("kept").select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle_sql() -> str:
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
u AS (SELECT r, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
u3 AS (SELECT r, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM u WINDOW o AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM u3 WHERE c IS NOT NULL),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM g, (VALUES (0), (1), (2)) v(k) WHERE g.n > 1 GROUP BY r),
m AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
        coalesce(rep.n, 0) AS n_repeat_words, len(ls) AS n_lines,
        len(list_filter(ws, lambda x: x IN ({stops}))) AS n_stop, len(list_filter(ws, lambda x: regexp_matches(x, '\\pL'))) AS n_letter,
        length(regexp_replace(t, '[^!]', '', 'g')) AS n_shouts
      FROM w LEFT JOIN rep USING (r)),
b AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND word_chars / n_words BETWEEN 2 AND 14 AND n_symbols / n_words <= 0.2 AND n_shouts / n_words <= 0.5
   AND n_stop / n_words >= 0.01 AND n_letter / n_words >= 0.6 AND n_dup_lines / n_lines <= 0.5) AS kept
FROM b"""
