"""Classifier output: tolerant parsing and normalisation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from feedloom import vocab
from feedloom.functions import text as tx

LABEL_SCHEMA = "primary_type string, tags array<string>, confidence double, summary string, significance string"


def unfence(raw: Column) -> Column:
    """Drop the lines of a markdown fence around a payload."""
    flat = F.trim(raw)
    lines = F.filter(F.split(flat, "\n"), lambda line: ~F.trim(line).startswith("```"))
    return F.when(flat.startswith("```"), F.trim(F.array_join(lines, "\n"))).otherwise(flat)


def parse_label_json(raw: Column) -> Column:
    """struct per LABEL_SCHEMA; text after the object is ignored and bad input gives the defaults."""
    got = F.from_json(unfence(raw), LABEL_SCHEMA, {"mode": "PERMISSIVE"})
    return F.struct(
        F.coalesce(got["primary_type"], F.lit("unknown")).alias("primary_type"),
        F.coalesce(got["tags"], F.array().cast("array<string>")).alias("tags"),
        F.coalesce(got["confidence"], F.lit(0.0)).alias("confidence"),
        F.coalesce(got["summary"], F.lit("")).alias("summary"),
        F.coalesce(got["significance"], F.lit("informational")).alias("significance"),
    )


def normalize_type(ptype: Column) -> Column:
    mapped = F.coalesce(tx.literal_map(vocab.TYPE_FALLBACK)[F.lower(ptype)], F.lit("docs"))
    return F.when(ptype.isin(*vocab.PRIMARY_TYPES), ptype).otherwise(mapped)


def normalize_significance(sig: Column) -> Column:
    return F.when(sig == "breaking-change", F.lit("breaking")).otherwise(sig)


def normalize_summary(summary: Column) -> Column:
    return F.when(F.coalesce(F.trim(summary), F.lit("")) == "", F.lit(vocab.BLANK_SUMMARY)).otherwise(summary)
