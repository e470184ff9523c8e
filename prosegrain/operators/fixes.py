"""Automatic rewriting of a long form of 'can', outside fences and inline code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegrain.functions.text import bound, text, times

LONG, SHORT = "することができ", "でき"


def fixed(docs: DataFrame) -> DataFrame:
    """docs (file, text): file, text (rewritten), n (places). A line that begins with a fence mark opens or closes a fence.

    Fence lines are counted through a string of one character for each line, so the work is linear but for the count itself.
    """
    lines = F.split("text", "\n", -1)
    marked = bound(lines, lambda ls: F.transform(ls, lambda s: F.struct(s.alias("s"), s.rlike(r"(?U)^\s*```").alias("f"))))
    # runs between fence lines: every second one is code
    blocks = F.split(F.array_join(F.transform(marked, lambda x: F.when(x["f"], F.concat(text("﷐"), x["s"], text("﷐"))).otherwise(x["s"])), "\n"), "﷐", -1)
    inline = lambda s: F.array_join(F.transform(F.split(s, "`", -1), lambda p, i: F.when(i % 2 == 0, F.replace(p, text(LONG), text(SHORT))).otherwise(p)), "`")
    body = lambda b: F.array_join(F.transform(F.split(b, "\n", -1), inline), "\n")
    done = F.transform(blocks, lambda b, i: F.when(i % 4 == 0, body(b)).otherwise(b))
    out = docs.select("file", "text", F.array_join(done, "").alias("fixed"))
    n = times(F.col("text"), LONG) - times(F.col("fixed"), LONG)
    return out.select("file", F.col("fixed").alias("text"), n.alias("n"))
