"""Quality rules as one projection: a threshold table over counts of a text, without user functions.

Words are longest runs outside U+0020 and U+0009 to U+000D, lines are what line feeds separate.

Rows: a null text has no words and fails; very long texts are handled whole; repeated rows and null ids get
a row each; other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparselin.llm.store import text_column

WHITE = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"

# Frequent function words of the languages handled.
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "was", "for", "that", "on", "with", "as", "by", "are", "be", "this",
           "from", "or", "an", "it", "at"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "las", "del", "se", "por", "un", "una", "para", "con", "no",
           "es", "al", "lo", "su"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "est", "pour", "dans", "qui", "par",
           "sur", "pas", "au"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im",
           "dem", "nicht", "ein", "eine", "als"),
}


@dataclass(frozen=True)
class Rule:
    """A text passes if ``count`` over ``per`` (or itself) lies within the bounds, ends included."""

    count: str
    per: str | None = None
    least: float | None = None
    most: float | None = None

    def passes(self) -> Column:
        value = F.col(self.count).cast("double")
        if self.per:
            value = F.when(F.col(self.per) > 0, value / F.col(self.per)).otherwise(0.0)
        checks = [value >= self.least] if self.least is not None else []
        checks += [value <= self.most] if self.most is not None else []
        out = checks[0]
        for check in checks[1:]:
            out = out & check
        return out


# Length, symbols, stop words and lines.
RULES = (
    Rule("n_words", least=50, most=1_000_000),
    Rule("word_chars", per="n_words", least=2.0, most=14.0),
    Rule("n_symbols", per="n_words", most=0.1),
    Rule("n_stop_words", least=2),
    Rule("n_dup_lines", per="n_lines", most=0.5),
    Rule("n_bullet_lines", per="n_lines", most=0.9),
    Rule("n_ellipsis_lines", per="n_lines", most=0.5),
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words",
          "n_bullet_lines", "n_ellipsis_lines")


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` (``doc_id, text``) with the counts the rules refer to, each of the whole text."""
    trimmed = F.btrim("text", F.lit(WHITE))
    stop = sorted({w for words in STOP_WORDS.values() for w in words})
    parts = docs.select("doc_id", text_column()).select(
        "doc_id", "text",
        F.when(trimmed == "", F.array().cast("array<string>"))
        .otherwise(F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+")).alias("words"),
        F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(WHITE)) != "").alias("lines"))
    n = F.size("words")
    # Windows of three words in the order of their words, each with its place.
    windows = F.when(n >= 3, F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.concat_ws(" ", F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("w"),
                           i.alias("i"))))
    parts = parts.select("*", F.sort_array(F.coalesce(windows, F.array().cast("array<struct<w:string,i:int>>"))).alias("sorted"))
    m = F.size("sorted")
    parts = parts.select("*", F.zip_with(
        F.slice("sorted", 1, F.greatest(m - 1, F.lit(0))), F.slice("sorted", 2, F.greatest(m - 1, F.lit(0))),
        lambda a, b: a["w"] == b["w"]).alias("same"))
    # A window occurs again if a neighbour in that order is equal.
    again = F.sort_array(F.transform(
        F.filter(F.transform("sorted", lambda x, j: F.struct(
            x["i"].alias("i"), (F.coalesce(F.get("same", j), F.lit(False)) | F.coalesce(F.get("same", j - 1), F.lit(False))).alias("r"))),
            lambda x: x["r"]), lambda x: x["i"]))
    parts = parts.select("*", again.alias("again"))
    # Each such window adds the words up to the next one, three at most.
    covered = F.aggregate(
        F.zip_with("again", F.slice("again", 2, F.greatest(F.size("again"), F.lit(1))),
                   lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))),
        F.lit(0), lambda total, x: total + x)
    lines = F.col("lines")
    return parts.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.translate("text", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(stop))).cast("long").alias("n_stop_words"),
        F.size(F.filter(lines, lambda x: F.btrim(x, F.lit(WHITE)).rlike("^[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter(lines, lambda x: F.btrim(x, F.lit(WHITE)).rlike("(\\.\\.\\.|…)$"))).cast("long").alias("n_ellipsis_lines"))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of every text, ``base_failed``, and ``kept``: it passed the base and every rule."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    verdict = F.lit(True)
    for rule in rules:
        verdict = verdict & rule.passes()
    return measured(docs).select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & verdict).alias("kept"))
