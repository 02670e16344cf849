"""Fill-in-middle transformation, in Spark's own functions only.

regexp_extract_all cuts a text into units (code points). Two 8-digit groups of
the SHA-256 of seed and id give the two cuts, two more decide whether the text
is rearranged and how; slices of the units, joined again, are prefix, middle
and suffix. Output is `<P>`prefix`<S>`suffix`<M>`middle (psm),
`<S>`suffix`<P>`prefix`<M>`middle (spm) or the text as it is (plain). restore
splits an output at its sentinels and puts the parts back in their order.

The parts hold no sentinel, as texts with one stay plain, and none can arise
where parts meet: no sentinel begins with another one's end (checked).

Scale: one narrow pass without shuffles or Python; a row's result depends on
its id and text only. The units of one text are held at a time, some 100 bytes
each in a task's heap.

Defined results: null texts are empty, and empty ones plain with 0 units; a
null id counts as an empty one. Rows of equal id have equal cuts where their
texts have equal lengths; repeated rows have equal results. Texts that the unit
pattern doesn't cover wholly stay plain. Other columns are passed on only if
named in `keep`; of those with a name of the result the result's is returned.
Texts of any length are cut whole. An empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.store import passed

#: Marks of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
CODE_POINT = r"(?s)."
#: Of 100 texts, those that are rearranged; of 100 rearranged ones, those as spm.
RATE, SPM = 90, 20
SEED = 1
MADE = ("n", "form", "prefix_units", "middle_units", "output")


def check_sentinels(sentinels: tuple[str, ...]) -> None:
    """ValueError unless each occurs in a joined output only where it was put."""
    for a in sentinels:
        for b in sentinels:
            inside = a in b and a != b
            overlap = any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)) + (a != b)))
            if not a or inside or overlap:
                raise ValueError(f"sentinels {a!r} and {b!r} can't be told apart")
    if len(set(sentinels)) != 3:
        raise ValueError("three different sentinels are needed")


def draw(id_column: Column, seed: int, group: int) -> Column:
    """The group-th (from 1) 8-digit group of the SHA-256 of seed:id as an integer."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("long")


def fill_in_middle(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), seed: int = SEED, rate: int = RATE, spm: int = SPM, unit: str = CODE_POINT, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Per row: the id, the columns in keep, n (units), form, prefix_units and middle_units (null if plain) and output."""
    check_sentinels(sentinels)
    p, s, m = (F.lit(x) for x in sentinels)
    kept = [x for x in passed(keep, MADE) if x.lower() != id_col.lower()]
    text, units = F.col("__text"), F.col("__units")
    rows = documents.select(F.col(id_col).alias("__id"), F.struct(F.lit(0).alias("__none"), *kept).alias("__kept"), F.coalesce(text_col, F.lit("")).alias("__text"))
    rows = rows.select("*", F.regexp_extract_all(text, F.lit(unit), F.lit(0)).alias("__units"))
    n = F.size(units).cast("long")
    cuts = [draw(F.col("__id"), seed, g) % (n + 1) for g in (1, 2)]
    plain = (text == "") | (draw(F.col("__id"), seed, 3) % 100 >= rate)
    for x in (p, s, m):
        plain |= F.contains(text, x)
    if unit != CODE_POINT:
        plain |= F.array_join(units, "") != text
    form = F.when(plain, "plain").when(draw(F.col("__id"), seed, 4) % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("*", n.alias("n"), F.least(*cuts).cast("int").alias("__a"), F.greatest(*cuts).cast("int").alias("__b"), form.alias("form"))
    a, b, end = F.col("__a"), F.col("__b"), F.col("n").cast("int")
    part = lambda first, count: F.array_join(F.slice(units, first + 1, count), "")
    prefix, middle, suffix = part(F.lit(0), a), part(a, b - a), part(b, end - b)
    output = F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    moved = F.col("form") != "plain"
    return rows.select(F.col("__id").alias(id_col), *(F.col("__kept")[x].alias(x) for x in kept), "n", "form", F.when(moved, a.cast("long")).alias("prefix_units"), F.when(moved, (b - a).cast("long")).alias("middle_units"), output.alias("output"))


def restore(made: DataFrame, name: str = "restored", sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Rows with output and form, and as column `name` the text that the output was made from; null if its sentinels aren't those of the form."""
    p, s, m = sentinels
    rows = made.select("*", F.split("output", "|".join(re.escape(x) for x in sentinels), -1).alias("__parts"))
    one, two, three = (F.get("__parts", F.lit(i)) for i in (1, 2, 3))
    rebuilt = lambda x, y: F.concat(F.lit(x), one, F.lit(y), two, F.lit(m), three) == F.col("output")
    of = F.size("__parts") == 4
    text = F.when(F.col("form") == "plain", F.col("output")).when(of & (F.col("form") == "psm") & rebuilt(p, s), F.concat(one, three, two)).when(of & (F.col("form") == "spm") & rebuilt(s, p), F.concat(two, three, one))
    return rows.withColumn(name, text).drop("__parts")


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = restore(fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return made.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


SQL = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
g AS (SELECT doc_id, t, n, [CAST('0x' || substr(x, i * 8 + 1, 8) AS BIGINT) FOR i IN range(4)] AS r FROM h),
c AS (SELECT doc_id, t, n, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT doc_id, t, n, form, a, b, substr(t, 1, a) AS x, substr(t, a + 1, b - a) AS y, substr(t, b + 1) AS z FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
