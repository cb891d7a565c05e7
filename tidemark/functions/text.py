"""Names, titles and lines of text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.cells import numbered


def title_prefix(title: Column, most: int = 20, fallback: str = "song") -> Column:
    """ASCII letters and digits of a title, anything between them one underscore, at most ``most`` characters."""
    joined = F.regexp_replace(title, "[^A-Za-z0-9]+", "_")
    cut = F.substring(F.regexp_replace(joined, "^_+|_+$", ""), 1, most)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(fallback))


def clean_title(title: Column, fallback: str = "untitled") -> Column:
    """A title that can name a folder: separators and line ends become dashes, outer blanks and dots go."""
    dashed = F.regexp_replace(title, r"[/:\\\n\r\u000B\u000C\u0085  ]", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, "^[ .]+|[ .]+$", ""), F.lit("")), F.lit(fallback))


def unique_names(df: DataFrame, name: str, order: Sequence[str], out: str = "folder") -> DataFrame:
    """Names with a number behind the second and later rows that share one."""
    turned = numbered(df, [name], order, "_turn")
    return turned.withColumn(out, F.when(F.col("_turn") == 1, F.col(name)).otherwise(F.concat_ws(" ", name, F.col("_turn").cast("string")))).drop("_turn")


def zero_padded(number: Column, count: Column, digits: int) -> Column:
    """A number with leading zeros, as wide as ``digits`` or as the largest number."""
    width = F.greatest(F.lit(digits), F.length(count.cast("string")), F.length(number.cast("string")))
    return F.lpad(number.cast("string"), width, "0")


def tool_line(line: Column, prefix: str = "") -> Column:
    """A downloader's tab-separated line as struct(kind, text, fraction), null if it is none that is known.

    The first field is ``prefix`` and title, file or progress; progress is done / total, at most 1, and only with a
    positive total.
    """
    parts = F.split(line, "\t", -1)
    field = lambda k: F.get(parts, F.lit(k))
    done, total = field(1).try_cast("double"), field(2).try_cast("double")
    no_text, no_number = F.lit(None).cast("string"), F.lit(None).cast("double")
    out = F.when(F.lit(False), F.struct(no_text.alias("kind"), no_text.alias("text"), no_number.alias("fraction")))
    for kind in ("title", "file"):
        out = out.when((field(0) == prefix + kind) & (F.size(parts) > 1), F.struct(F.lit(kind).alias("kind"), field(1).alias("text"), no_number.alias("fraction")))
    moving = (field(0) == prefix + "progress") & (F.size(parts) > 2) & done.isNotNull() & (total > 0)
    return out.when(moving, F.struct(F.lit("progress").alias("kind"), no_text.alias("text"), F.least(done / total, F.lit(1.0)).alias("fraction")))


def summary(*parts: Column) -> Column:
    """The parts that are known, with commas between, colons read as blanks."""
    return F.concat_ws(", ", *[F.replace(p, F.lit(":"), F.lit(" ")) for p in parts])
