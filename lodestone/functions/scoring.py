"""Scores and classes, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import fixed as K
from lodestone.functions.text import any_word, has_heading, placeholders, strip


def level_score(level: Column) -> Column:
    return F.when(level == "high", 0.90).when(level == "medium", 0.70).otherwise(0.50)


def finding_score(ast: Column, llm: Column, agreement: Column) -> Column:
    """struct(value, source) of a finding seen by the parser, by a model, or by both."""
    both = F.when(agreement == "high", 0.95).when(agreement == "medium", 0.85).otherwise(0.50)
    value = F.when(ast & llm, both).when(ast, 0.90).otherwise(0.70)
    source = F.when(ast & llm, "cross_validated").when(ast, "ast").otherwise("llm")
    return F.struct(value.alias("value"), source.alias("source"))


def clamp_confidence(base: Column, gate: Column) -> Column:
    return F.greatest(F.lit(K.FLOOR), F.least(F.lit(K.CEILING), base * gate))


def low_confidence_mark(content: Column, confidence: Column) -> Column:
    """The content, marked if its confidence is under the threshold."""
    mark = F.concat(F.lit("[Low confidence: "), F.format_string("%.2f", confidence), F.lit("] "), content)
    return F.when(confidence < K.LOW_CONFIDENCE, mark).otherwise(content)


def intent(message: Column) -> Column:
    """The one intent whose words a message holds most of, else general."""
    low = F.lower(message)
    count = lambda words: sum((F.contains(low, F.lit(w)).cast("double") for w in words), F.lit(0.0))
    a, b, c = (count(K.INTENTS[k]) for k in ("lookup", "code_exploration", "search"))
    c = c * K.SEARCH_WEIGHT
    return F.when((a > b) & (a > c), "lookup").when((b > a) & (b > c), "code_exploration").when((c > a) & (c > b), "search").otherwise("general")


def error_class(status: Column, is_timeout: Column, message: Column) -> Column:
    """transient, client, server, timeout or unknown: by status code, then type, then words."""
    low = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(status == 429, "transient")
        .when(status.between(400, 499), "client")
        .when(status.between(500, 599), "server")
        .when(is_timeout, "timeout")
        .when(any_word(low, ["timeout", "timed out"]), "timeout")
        .when(any_word(low, ["429", "rate limit", "rate_limit"]), "transient")
        .when(any_word(low, ["500", "502", "503", "504"]), "server")
        .when(any_word(low, ["econnrefused", "connection"]), "transient")
        .when(any_word(low, ["400", "401", "403", "404"]), "client")
        .otherwise("unknown")
    )


def retryable(kind: Column) -> Column:
    return kind.isin("transient", "server", "timeout")


def repeated_paragraphs(content: Column) -> Column:
    """How many paragraphs over 50 characters repeat an earlier one."""
    p = F.filter(F.transform(F.split(content, "\n\n"), strip), lambda x: F.char_length(x) > 50)
    return F.size(p) - F.size(F.array_distinct(p))


def gate(content: Column, min_length: int, headings: list[str], check_placeholders: bool = True, check_repetition: bool = True) -> Column:
    """struct(passed, score, checks, short, missing, placeholders, repeated) of a section's content."""
    short = F.char_length(strip(content)) < min_length
    missing = F.array_compact(F.array(F.lit(None).cast("string"), *(F.when(~has_heading(content, h), F.lit(h)) for h in headings)))
    marks = placeholders(content) if check_placeholders else F.array().cast("array<string>")
    again = repeated_paragraphs(content) if check_repetition else F.lit(0)
    checks = 1 + bool(headings) + check_placeholders + check_repetition
    failed = short.cast("int") + (F.size(missing) > 0).cast("int") + (F.size(marks) > 0).cast("int") + (again > 0).cast("int")
    return F.struct(
        (~short & (F.size(marks) == 0)).alias("passed"), ((checks - failed) / checks).alias("score"), F.lit(checks).alias("checks"),
        short.alias("short"), missing.alias("missing"), marks.alias("placeholders"), again.alias("repeated"),
    )


def citation_problem(line_count: Column, start: Column, end: Column) -> Column:
    """The first thing that is wrong with a citation, or null. A null line count: no such file."""
    return (
        F.when(line_count.isNull(), "file not found")
        .when(start < 1, "start below 1")
        .when(end < start, "end before start")
        .when(end > line_count, "end past the file")
    )
