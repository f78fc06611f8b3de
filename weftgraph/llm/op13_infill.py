"""Fill-in-middle transformation of texts by escaped marker injection, in column expressions only.

A unit is a run of ASCII letters or any other single character. A delimiter is put after each unit, so
that units can be counted and the first or last so many cut out by substring_index. The delimiter's own
character and the escape character are escaped before, as pairs that count as one unit, and all of that
is undone in the parts. No text is turned into an array of its units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import free_names, table

#: The markers of the outputs.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are changed at all, and of 100 of these so many put the suffix first.
CHANGED, SUFFIX_FIRST = 90, 20
DELIMITER, ESCAPE = "\u0001", "\u0002"
#: A letter run, an escaped character or another character, in escaped text.
UNIT = rf"[A-Za-z]+|(?s:{ESCAPE}.)|[^A-Za-z]"


def escaped(text: Column) -> Column:
    """The text without the delimiter's character; a pair of escape character and digit stands for it and for the escape character."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(f"{ESCAPE}0")), F.lit(DELIMITER), F.lit(f"{ESCAPE}1"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(f"{ESCAPE}1"), F.lit(DELIMITER)), F.lit(f"{ESCAPE}0"), F.lit(ESCAPE))


def marked(text: Column) -> Column:
    """The escaped text with the delimiter after each unit."""
    return F.regexp_replace(escaped(text), F.lit(UNIT), F.lit(f"$0{DELIMITER}"))


def units(marked: Column) -> Column:
    """How many units a marked text has."""
    return (F.length(marked) - F.length(F.replace(marked, F.lit(DELIMITER), F.lit("")))).cast("long")


def _plain(part: Column) -> Column:
    return unescaped(F.replace(part, F.lit(DELIMITER), F.lit("")))


def parts(marked: Column, n: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """The first a units, those after them up to the b-th, and the rest, of a marked text of n units; 0 <= a <= b <= n."""
    cut = lambda s, k: F.call_function("substring_index", s, F.lit(DELIMITER), k.cast("int"))
    # from the right, the delimiter after the last unit counts as well; past the first delimiter all is taken
    return _plain(cut(marked, a)), _plain(cut(cut(marked, b), a - b)), _plain(cut(marked, b - n - 1))


def draws(key: Column) -> list[Column]:
    """Four whole numbers below 2**32 of an id (null: an empty one), the same in each run."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transformed(docs: DataFrame, text: str = "text", key: str = "doc_id", changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs with the columns n (units), form, prefix, middle, suffix and output; a column of docs with such a name gives way to it.

    Two cuts are drawn from the id, of n + 1 places each. Form is psm (prefix, suffix, middle), spm (suffix, prefix,
    middle) or plain: the text itself, for empty and null texts (both count as empty), texts that contain a marker, and
    those that aren't drawn; plain rows have null parts. Rows alike in id and text get the same output; a null id draws
    as an empty one. Texts of any length are done whole, in memory of a few times their own. An empty table gives no rows.
    """
    t, m, a, b, h = free_names(docs, "__text", "__marked", "__a", "__b", "__h")
    named = ["n", "form", "prefix", "middle", "suffix", "output"]
    kept = [c for c in docs.columns if c.lower() not in named]
    q = lambda c: F.col(f"`{c}`")
    at = docs.select(*[q(c) for c in kept], F.coalesce(q(text), F.lit("")).alias(t), F.array(*draws(q(key))).alias(h))
    at = at.withColumn(m, marked(F.col(t))).withColumn("n", units(F.col(m)))
    i, j = F.col(h)[0] % (F.col("n") + 1), F.col(h)[1] % (F.col("n") + 1)
    own = F.col(t).contains(PREFIX) | F.col(t).contains(SUFFIX) | F.col(t).contains(MIDDLE)
    form = F.when((F.col(t) == "") | own | (F.col(h)[2] % 100 >= changed), "plain").when(F.col(h)[3] % 100 < suffix_first, "spm").otherwise("psm")
    at = at.withColumns({a: F.least(i, j), b: F.greatest(i, j), "form": form})
    cut = dict(zip(("prefix", "middle", "suffix"), parts(F.col(m), F.col("n"), F.col(a), F.col(b)), strict=True))
    at = at.withColumns({c: F.when(F.col("form") != "plain", v) for c, v in cut.items()})
    p, s, x = (F.lit(c) for c in (PREFIX, SUFFIX, MIDDLE))
    out = F.when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", x, "middle")).when(F.col("form") == "spm", F.concat(s, "suffix", p, "prefix", x, "middle")).otherwise(F.col(t))
    return at.withColumn("output", out).select(*[q(c) for c in kept], *named)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. No part contains a marker, and none can arise where a part and a marker meet, so each is found once."""
    after = lambda marker: F.substring_index(output, marker, -1)
    until = lambda column, marker: F.substring_index(column, marker, 1)
    psm = F.concat(until(F.substring(output, F.lit(len(PREFIX) + 1), F.length(output)), SUFFIX), after(MIDDLE), until(after(SUFFIX), MIDDLE))
    spm = F.concat(until(after(PREFIX), MIDDLE), after(MIDDLE), until(F.substring(output, F.lit(len(SUFFIX) + 1), F.length(output)), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its units, form, code points of prefix and middle, and digests of the output and of the text rebuilt from it."""
    made = transformed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id",
        "n",
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


SQL = r"""
with t as materialized (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::varchar, '')) as d from documents),
u as materialized (select doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as u, list_transform(range(4), lambda k: ('0x' || substr(d, 8 * k::int + 1, 8))::bigint) as h from t),
c as (select *, len(u)::bigint as n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) as a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) as b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h[3] % 100 >= 90 then 'plain' when h[4] % 100 < 20 then 'spm' else 'psm' end as form from u),
p as materialized (select doc_id, n, form, text, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:], '') as s from c)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m else text end) as output_sha256, sha256(text) as restored_sha256 from p
"""
