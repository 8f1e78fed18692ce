"""Parsing of external answers. Answers arrive as text columns; no model is called here."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from paperlode import rules, schemas
from paperlode.functions.basic import bind, blank_to_null, contains_any, strip


def heuristic_label(context: Column) -> Column:
    """Label of a link from clue words in its context."""
    low = F.lower(F.coalesce(context, F.lit("")))
    return (
        F.when(contains_any(low, rules.DATASET_CLUES), "dataset")
        .when(contains_any(low, rules.CODE_CLUES), "code")
        .otherwise("other")
    )


def heuristic_reason(context: Column) -> Column:
    return F.when(heuristic_label(context) == "other", rules.WHY_NONE).otherwise(rules.WHY_KEYWORD)


def raw_label(label: Column) -> Column:
    """Lower-case label folded to the known ones where it names them."""
    low = strip(F.lower(F.coalesce(F.when(label != "", label), F.lit("other"))))
    folded = F.when(low.contains("data"), "dataset").otherwise(low)
    return F.when(contains_any(folded, ["code", "repo", "github"]), "code").otherwise(folded)


def normalized_label(label: Column, context: Column) -> Column:
    """One of dataset, code, other; unknown labels fall back to the clue words."""
    folded = raw_label(label)
    return F.when(folded.isin("dataset", "code", "other"), folded).otherwise(heuristic_label(context))


def normalized_reason(label: Column, why: Column, context: Column) -> Column:
    known = raw_label(label).isin("dataset", "code", "other")
    given = F.coalesce(blank_to_null(why), F.lit(rules.WHY_CONTEXT))
    return F.left(F.when(known, given).otherwise(heuristic_reason(context)), F.lit(24))


def parse_label_lines(content: Column, first: Column, count: Column) -> Column:
    """(sentence index from 0, label) pairs of label lines in range, the last line per sentence wins."""
    found = F.transform(
        F.split(content, r"\r\n|[\n\r]"),
        lambda line, i: F.struct(
            (F.regexp_extract(line, rules.LABEL_LINE_PATTERN, 1).try_cast("int") - 1).alias("gid"),
            i.alias("line"),
            F.regexp_extract(line, rules.LABEL_LINE_PATTERN, 2).try_cast("int").alias("label"),
        ),
    )
    valid = F.filter(found, lambda x: x["gid"].isNotNull() & (x["gid"] >= first) & (x["gid"] < first + count))
    # Sorted by (sentence, line), an entry is the last of its sentence if the one behind it differs.
    def last_per_sentence(ordered: Column) -> Column:
        behind = F.concat(F.slice(ordered, 2, F.size(ordered)), F.array(F.lit(None)))
        marked = F.zip_with(
            ordered,
            behind,
            lambda x, y: F.struct(
                x["gid"].alias("gid"), x["label"].alias("label"), F.coalesce(x["gid"] != y["gid"], F.lit(True)).alias("last")
            ),
        )
        kept = F.filter(marked, lambda x: x["last"])
        return F.transform(kept, lambda x: F.struct(x["gid"].alias("gid"), x["label"].alias("label")))

    return bind(F.array_sort(valid), last_per_sentence)


def parse_labels_positional(content: Column) -> Column:
    """Labels in line order, whatever the numbers say."""
    labels = F.transform(
        F.split(content, "\n"), lambda line: F.regexp_extract(line, rules.LABEL_LINE_PATTERN_OLD, 1).try_cast("int")
    )
    return F.filter(labels, lambda y: y.isNotNull())


def parse_label_array(content: Column) -> Column:
    """Labels of ``{"labels": [...]}``: 1 stays 1, all else is 0; null if the answer holds no array."""
    raw = F.from_json(strip(content), "labels ARRAY<STRING>")["labels"]
    return F.transform(raw, lambda y: F.when(y.isin("1", "1.0", "true"), 1).otherwise(0))


def parse_url_object(content: Column) -> Column:
    """Distinct urls of ``{"urls": {"dataset": [...], "code": [...]}}`` inside free text."""
    body = F.regexp_extract(content, r"(?s)(\{.*\})", 1)
    urls = F.from_json(body, "urls STRUCT<dataset: ARRAY<STRING>, code: ARRAY<STRING>>")["urls"]
    empty = F.array().cast("array<string>")
    return F.array_sort(
        F.array_union(F.coalesce(urls["dataset"], empty), F.coalesce(urls["code"], empty))
    )


def parse_pick(content: Column) -> Column:
    """Primary pick of ``{"primary": {"url", "reason", "confidence"}}`` inside free text."""
    body = F.regexp_extract(content, r"(?s)(\{.*\})", 1)
    primary = F.from_json(body, "primary STRUCT<url: STRING, reason: STRING, confidence: DOUBLE>")["primary"]
    return F.struct(
        strip(primary["url"]).alias("url"),
        strip(primary["reason"]).alias("reason"),
        F.coalesce(primary["confidence"], F.lit(0.0)).alias("confidence"),
    )


def parse_items(content: Column) -> Column:
    """Items of a loose JSON answer: fences, prose around it, JSON lines and glued objects are tolerated."""

    @F.pandas_udf(f"array<{schemas.RESPONSE_ITEM}>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(read_items)

    return read(content)


def read_items(content: str | None) -> list[dict] | None:
    """Items of one answer; see :func:`parse_items`. An unreadable answer gives an empty list."""
    import json
    import re

    if content is None:
        return None
    text = content.replace("\ufeff", "").strip()
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S | re.I)
    text = fenced.group(1).strip() if fenced else re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", text, flags=re.I)
    reader = json.JSONDecoder()

    def values() -> list:
        """The whole text, or else every JSON value that can be read from its first bracket on."""
        try:
            return [reader.decode(text)]
        except ValueError:
            pass
        found, at = [], 0
        while True:
            starts = [p for p in (text.find("{", at), text.find("[", at)) if p >= 0]
            if not starts:
                return found
            at = min(starts)
            try:
                value, at = reader.raw_decode(text, at)
                found.append(value)
            except ValueError:
                at += 1

    def unwrap(value: object) -> list:
        if isinstance(value, list):
            return value
        if isinstance(value, dict):
            for key in ("items", "data"):
                if isinstance(value.get(key), list):
                    return value[key]
            if {"url", "label"} <= set(value):
                return [value]
        return []

    items: list[dict] = []
    for value in values():
        got = [v for v in unwrap(value) if isinstance(v, dict)]
        if items and got and not (isinstance(value, dict) and "url" in value):
            break  # only glued single objects and JSON lines add up
        items += got
    return [
        {k: None if v.get(k) is None else str(v[k]) for k in ("url", "label", "why", "desc")} for v in items
    ]
