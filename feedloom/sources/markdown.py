"""Link lists kept as markdown README files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

c = F.col
LINK = r"\[([^\]]+)\]\((https?://[^\)]+)\)"
BADGE = r"(?i)(\.svg(\?[^)]*)?$|/badges/)"


def _links(lines: DataFrame) -> DataFrame:
    """lines: (list_id, line_no, line)."""
    d = lines.withColumn("_l", F.trim("line")).where(c("_l").startswith("- ["))
    pairs = F.arrays_zip(
        F.regexp_extract_all("_l", F.lit(LINK), F.lit(1)).alias("name"), F.regexp_extract_all("_l", F.lit(LINK), F.lit(2)).alias("url")
    )
    # the text left once the first link is cut out
    at = F.regexp_instr(c("_l"), F.lit(LINK))
    length = F.length(F.regexp_extract("_l", LINK, 0))
    rest = F.concat(F.substring(c("_l"), F.lit(1), at - 1), F.substring(c("_l"), at + length, F.length("_l")))
    about = F.regexp_replace(rest, r"^[ \-—:]+|[ \-—:]+$", "")
    d = d.select("list_id", "line_no", about.alias("description"), F.posexplode(pairs).alias("link_no", "p"))
    return d.select("list_id", "line_no", "link_no", c("p.name").alias("name"), c("p.url").alias("url"), "description").where(
        ~c("url").rlike(BADGE) & ~c("name").startswith("!")
    )


def extract_markdown_links(new: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """Entries of a list, or only of the lines added since the old version."""
    return _links(new if old is None else added_lines(new, old))


def added_lines(new: DataFrame, old: DataFrame) -> DataFrame:
    """Lines of ``new`` that ``old`` does not have (as often)."""
    kept = new.select("list_id", "line").exceptAll(old.select("list_id", "line"))
    return kept.withColumn("line_no", F.lit(None).cast("long"))
