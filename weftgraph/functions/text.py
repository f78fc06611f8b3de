"""Source text: comments, headers, spans."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Put around tokens before a text is split at them; where a text has this character, it is escaped.
MARK, ESCAPE = "\u0001", "\u0002"


def pieces_around(text: Column, pattern: str) -> Column:
    """The text cut before and after each match of pattern (which must not match the two characters used for it): text, match, text, ..., text."""
    escaped = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(f"{ESCAPE}0")), F.lit(MARK), F.lit(f"{ESCAPE}1"))
    return F.split(F.regexp_replace(escaped, pattern, f"{MARK}$0{MARK}"), MARK, -1)


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(f"{ESCAPE}1"), F.lit(MARK)), F.lit(f"{ESCAPE}0"), F.lit(ESCAPE))


def without_block_comments(text: Column, opens: str = "{-", closes: str = "-}", block: int = 512) -> Column:
    """Text outside nested block comments; a closer that nothing opened is text, and an open comment goes to the end.

    Which pairs of characters are tokens doesn't depend on the depth, so the text is cut at them and cut into
    blocks of pieces. A block takes a depth d to max(d + sum, sum - low), with the sum of its steps and their
    lowest running sum; a scan of these maps gives the depth at which each block begins, and then each is gone
    through by itself. So the time grows with the text and the number of its comments, not with their square.
    """
    pattern = "|".join(re.escape(t) for t in (opens, closes))
    once = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  a lambda's body would compute value anew for each element
    none = F.array().cast("array<string>")
    dealt = lambda pieces: F.transform(F.sequence(F.lit(1), F.size(pieces), F.lit(block)), lambda i: F.slice(pieces, i, F.lit(block)))
    step = lambda p: F.when(p == opens, 1).when(p == closes, -1).otherwise(0)
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("low"))
    as_map = lambda b: F.aggregate(b, start, lambda a, p: F.struct((a["sum"] + step(p)).alias("sum"), F.least(a["low"], a["sum"] + step(p)).alias("low")))
    after = lambda d, m: F.greatest(d + m["sum"], m["sum"] - m["low"])
    first = F.struct(F.lit(0).alias("depth"), F.array().cast("array<int>").alias("starts"))
    starts = lambda blocks: F.aggregate(F.transform(blocks, as_map), first, lambda a, m: F.struct(after(a["depth"], m).alias("depth"), F.array_append(a["starts"], a["depth"]).alias("starts")), lambda a: a["starts"])

    def kept(acc: Column, p: Column) -> Column:
        depth, out = acc["depth"], acc["out"]
        moved = F.when(p == opens, depth + 1).when((p == closes) & (depth > 0), depth - 1).otherwise(depth)
        return F.struct(moved.alias("depth"), F.when((depth > 0) | (p == opens), out).otherwise(F.array_append(out, p)).alias("out"))

    outside = lambda b, d: F.aggregate(b, F.struct(d.alias("depth"), none.alias("out")), kept, lambda a: F.array_join(a["out"], ""))
    whole = once(once(pieces_around(text, pattern), dealt), lambda blocks: F.array_join(F.zip_with(blocks, starts(blocks), outside), ""))
    return F.when(~text.rlike(pattern), text).when(text.isNotNull(), unescaped(whole))


def without_line_comment(line: Column) -> Column:
    return F.regexp_replace(line, r"--.*$", "")


def line_of_offset(text: Column, offset: Column) -> Column:
    """1 and the newlines before the offset (in characters)."""
    before = F.substring(text, F.lit(1), offset)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("long")


def indent(line: Column) -> Column:
    return F.length(line) - F.length(F.ltrim(line))
