"""License scan with ordered signature rules, in DataFrame functions only."""

from __future__ import annotations

import json
from dataclasses import asdict
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from purseflow.llm.license_rules import GATES, Rule, rules

# Phrases that are always reported, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Characters of words, and what lies between words, once A-Z are lower-cased.
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Of a word in the original text, where A-Z belong to it.
_ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _phrase_regex(phrases: list[str]) -> str:
    """Places where a phrase's words stand consecutively; no two of them can overlap."""
    bodies = "|".join(_BETWEEN.join(p.split()) for p in phrases)
    return rf"(?<!{_WORD})(?:{bodies})(?!{_WORD})"


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def _rules_column(found: list[Rule]) -> Column:
    schema = "array<struct<label: string, keyword: string, regex: string, priority: int, confidence: double>>"
    return F.from_json(F.lit(json.dumps([asdict(r) for r in found])), schema)


def _total_length(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda total, part: total + F.length(part))


def _spans(text: Column, rule: Column) -> Column:
    """(start, end, rule) of all matches: the text split at them gives what lies before each."""
    matches = F.regexp_extract_all(text, rule["regex"], F.lit(0))
    around = F.split(text, rule["regex"], -1)

    def span(match: Column, i: Column) -> Column:
        start = _total_length(F.slice(around, F.lit(1), i + 1)) + _total_length(F.slice(matches, F.lit(1), i))
        return F.struct(
            start.alias("start"),
            (start + F.length(match)).alias("end"),
            rule["label"].alias("label"),
            rule["priority"].alias("priority"),
            rule["confidence"].alias("confidence"),
        )

    return F.transform(matches, span)


def _unsuppressed(found: Column) -> Column:
    """Detections not contained in one of higher priority, or of the same and longer."""

    def loses(d: Column) -> Column:
        def wins(e: Column) -> Column:
            longer = e["end"] - e["start"] > d["end"] - d["start"]
            stronger = (e["priority"] > d["priority"]) | ((e["priority"] == d["priority"]) & longer)
            return (e["start"] <= d["start"]) & (e["end"] >= d["end"]) & stronger

        return F.exists(found, wins)

    return F.filter(found, lambda d: ~loses(d))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    Base detections are the places of PHRASES among the words of the text (A-Z lower-cased): their
    number, the first and last one's word, and their labels. ``detections`` are those of the
    signature rules: rules whose keyword occurs are matched against the whole text, and a match
    inside another one of higher priority, or of the same priority and longer, is suppressed.
    ``labels`` joins both kinds. score is 1 with a base phrase, else the highest confidence, else
    0. Null texts are empty; repeated rows each get their row; an empty table gives no rows.

    Texts without any of a few literals, which every rule and phrase needs, are passed over.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    folded = F.lower("__text")
    gated = _any(folded, list(GATES)) | (
        F.contains(folded, F.lit("cc")) & F.col("__text").rlike(r"(?i)cc[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+by")
    )
    rows = docs.select(F.col(id_col), text.alias("__text"))
    rows = rows.select(
        id_col,
        F.regexp_count("__text", F.lit(_ANY_WORD)).cast("long").alias("n_words"),
        F.when(gated, F.translate("__text", _UPPER, _LOWER)).alias("low"),
    )
    phrase = F.lit(_phrase_regex(list(PHRASES)))
    low = F.col("low")
    applied = F.filter(_rules_column(rules()), lambda r: F.contains(low, r["keyword"]))
    rows = rows.select(
        id_col,
        "n_words",
        F.when(low.isNotNull(), F.regexp_extract_all(low, phrase, F.lit(0))).alias("places"),
        F.when(low.isNotNull(), F.split(low, phrase, -1)).alias("around"),
        F.when(low.isNotNull(), F.flatten(F.transform(applied, lambda r: _spans(low, r)))).alias("found"),
    )
    label = lambda place: reduce(
        lambda rest, item: F.when(place.startswith(item[0].split()[0]), item[1]).otherwise(rest),
        PHRASES.items(),
        F.lit(None).cast("string"),
    )
    words = lambda part: F.regexp_count(part, F.lit(_WORD + "+"))
    rows = rows.select(
        id_col,
        "n_words",
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_base"),
        words(F.element_at("around", 1)).cast("long").alias("first"),
        (F.col("n_words") - words(F.element_at("around", -1)) - words(F.try_element_at("places", F.lit(-1))))
        .cast("long")
        .alias("last"),
        F.array_sort(F.array_distinct(F.transform("places", label))).alias("base"),
        _unsuppressed(F.col("found")).alias("detections"),
    )
    none = F.array().cast("array<string>")
    every = F.concat(F.coalesce("base", none), F.coalesce(F.col("detections.label"), none))
    has = F.col("n_base") > 0
    return rows.select(
        id_col,
        "n_words",
        F.when(F.col("n_base") >= 0, F.col("n_base")).otherwise(0).alias("n_base"),
        F.when(has, F.col("first")).alias("first_word"),
        F.when(has, F.col("last")).alias("last_word"),
        F.array_join(F.coalesce("base", none), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(every)), ",").alias("labels"),
        F.when(has, 1.0)
        .otherwise(F.coalesce(F.array_max("detections.confidence"), F.lit(0.0)))
        .alias("score"),
        "detections",
    )
