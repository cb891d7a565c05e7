"""Remove repeated passages of lines: overlapping windows of three consecutive lines, with DataFrame functions only.

Every window gets a key of 128 bits (two hashes over the hashes of its lines). A window that stands more than once in
the corpus keeps its first occurrence, by (doc_id, position); all lines of its later occurrences go, whether or not
those occurrences overlap each other or a first one. Windows are judged on the input, and windows of blank lines alone
do not count.

Defined cases: a null text has no lines and stays null; an empty text is one empty line; texts under three lines have
no window and stay as they are; rows with a null doc_id stay as they are; rows that share a doc_id count as one place, so
they lose the same lines if their texts are equal; a text of any length is split whole, and its lines make one row each; an empty table gives no rows; other columns pass through, but for columns
named n_lines or n_removed, which the result's own replace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import cut

WINDOW_LINES = 3


def line_windows(docs: DataFrame, size: int = WINDOW_LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, pos, a, b): a row for each window, at the position of its first line from 0; a and b are its key."""
    lines = F.split(F.col(text_col), "\n", -1)
    one = F.transform(
        lines,
        lambda x: F.struct(F.xxhash64(x).alias("h"), (F.crc32(x.cast("binary")) * (1 << 31) + F.length(x)).alias("c"), (F.trim(x) != "").alias("t")),
    )
    at = lambda ls, i, f: [F.get(ls, i + k)[f] for k in range(size)]
    windows = F.transform(
        F.array(one),  # binds the hashed lines once for each text
        lambda ls: F.when(
            F.size(ls) >= size,
            F.transform(
                F.sequence(F.lit(0), F.size(ls) - size),
                lambda i: F.struct(
                    i.alias("pos"),
                    F.xxhash64(*at(ls, i, "h")).alias("a"),
                    F.xxhash64(*at(ls, i, "c")).alias("b"),
                    F.array_contains(F.array(*at(ls, i, "t")), True).alias("t"),
                ),
            ),
        ),
    )[0]
    usable = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    return usable.select(F.col(id_col).alias("doc"), F.explode(windows).alias("w")).where("w.t").select("doc", "w.pos", "w.a", "w.b")


def repeated_lines(docs: DataFrame, size: int = WINDOW_LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, gone): positions of the lines that later occurrences cover, once each, for documents that lose any."""
    windows = cut(line_windows(docs, size, id_col, text_col))
    # a table of its own, so that the join deals both sides anew and can split a very frequent window
    first = cut(windows.groupBy("a", "b").agg(F.min(F.struct("doc", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    later = windows.join(first, ["a", "b"]).where(F.struct("doc", "pos") > F.col("first"))
    starts = later.groupBy("doc").agg(F.collect_set("pos").alias("starts"))
    covered = F.flatten(F.transform("starts", lambda p: F.sequence(p, p + (size - 1))))
    return starts.select("doc", F.array_distinct(covered).alias("gone"))


def dedup_lines(docs: DataFrame, size: int = WINDOW_LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with what is left of each text, and ``n_lines`` and ``n_removed``."""
    gone = repeated_lines(docs, size, id_col, text_col)
    lost = gone["gone"]
    lines = F.split(docs[text_col], "\n", -1)
    left = F.transform(
        F.array(lines),  # binds the lines once for each text
        lambda ls: F.concat_ws("\n", F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), lost), lambda i: F.get(ls, i))),
    )[0]
    out = docs.join(gone, docs[id_col] == gone["doc"], "left")
    kept = F.when(lost.isNull(), docs[text_col]).otherwise(left)
    removed = F.when(lost.isNull(), F.lit(0)).otherwise(F.size(lost))
    total = F.when(docs[text_col].isNull(), F.lit(0)).otherwise(F.size(lines))
    passed = [kept.alias(c) if c == text_col else docs[c] for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*passed, total.alias("n_lines"), removed.alias("n_removed"))
