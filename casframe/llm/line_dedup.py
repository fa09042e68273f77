"""Cross-site line dedup by distinct-site spread.

A line is boilerplate if it stands on at least ``min_sites`` distinct sites.  Lines
are counted by hash first, and only those of ``min_sites`` rows or more, which are
few, go on.  HyperLogLog sketches of the sites, one per line hash, merge by
aggregation.  Estimates beyond ``margin`` on either side of the threshold decide at
once; lines between get an exact distinct count, so the estimate's error does not
decide any of them.  ``margin`` is eight standard errors of the sketch.

A line that stands in a third of all documents is pre-aggregated wherever it is
counted, and where rows meet their line's verdict it is among the at most
``common.HEAVY`` heavy lines, which are broadcast instead of shuffled.

Lines are the \\n-split parts of a text, compared after trimming blanks (space,
tab, carriage return); a line without other characters is never removed.  With
``most_share`` a document loses its boilerplate lines only if they hold at most that
share of its characters; beyond it the document is taken for a copy as a whole,
which is the near-duplicate operator's task, and stays whole.  Without it (the
default) every boilerplate line goes.  A null site is no site; null and empty texts
and null ids pass unchanged; repeated rows stay repeated.

All of it is DataFrame functions.  Only hashes travel with sites; of the texts
each moves once, to meet the list of its document's lines to remove.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casframe.llm import common

MIN_SITES = 10
LOG_K = 10
MARGIN = 8 * 1.04 / (1 << (LOG_K // 2))
TRIMMED = "trim(BOTH ' \\t\\r' FROM line)"


def line_hashes(documents: DataFrame, site: str, text: str) -> DataFrame:
    """(row, site, h, size) of every line with a character; ``row`` numbers the input's rows."""
    return documents.select("row", F.col(site).alias("site"), F.explode(F.split(F.col(text), "\n")).alias("line")).select("row", "site", F.expr(TRIMMED).alias("line")).where("line <> ''").select("row", "site", F.xxhash64("line").alias("h"), F.length("line").alias("size"))


def spread(scratch: common.Scratch, lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h, n) of the lines on at least ``min_sites`` sites: counts, then sketches, then exact counts near the threshold."""
    placed, total = lines.where("site IS NOT NULL"), lines.count()
    often = scratch.save(placed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites), "often")
    # One row for each line and site: what a line repeats on a site is folded before the shuffle.
    pairs = scratch.save(common.match(placed.select("h", "site"), often, "h", "n", total).groupBy("h", "site").agg(F.count(F.lit(1)).alias("rows")), "pairs")
    about = scratch.save(pairs.groupBy("h").agg(F.sum("rows").alias("n"), F.hll_sketch_agg("site", LOG_K).alias("sketch")).select("h", "n", F.hll_sketch_estimate("sketch").alias("sites")), "about")
    low, high = min_sites * (1 - MARGIN), min_sites * (1 + MARGIN)
    near = about.where(F.col("sites").between(low, high)).select("h", "n")
    exact = pairs.join(near, "h").groupBy("h", "n").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites)
    return about.where(F.col("sites") > high).select("h", "n").union(exact.select("h", "n"))


def dedup(spark: SparkSession, documents: DataFrame, site: str = "source", text: str = "text", min_sites: int = MIN_SITES, most_share: float | None = None, name: str = "lines") -> DataFrame:
    """``documents`` with its columns; texts without their boilerplate lines, and n_chars following if it exists."""
    scratch = common.Scratch(spark, name, documents)
    columns = documents.columns
    inner = documents.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(columns)))
    site, text = f"c{columns.index(site)}", f"c{columns.index(text)}"
    numbered = inner.withColumn("row", F.struct(*(F.col(c) for c in inner.columns if c != text), F.xxhash64(text), F.length(text)))
    numbered = numbered.withColumn("row", F.unhex(F.sha2(F.to_json("row", {"ignoreNullFields": "false"}), 256)))
    lines = scratch.save(line_hashes(numbered, site, text), "lines")
    boilerplate = scratch.save(spread(scratch, lines, min_sites), "boilerplate")
    gone = common.match(lines.select("row", "h", "size"), boilerplate, "h", "n", lines.count()).groupBy("row").agg(F.sum("size").alias("gone"), F.collect_set("h").alias("drop"))
    if most_share is not None:
        total = lines.groupBy("row").agg(F.sum("size").alias("all"))
        gone = gone.join(total, "row").where(F.col("gone") <= F.col("all") * most_share)
    chosen = scratch.save(gone.select("row", "drop"), "chosen")
    kept = f"array_join(filter(split({text}, '\\n'), line -> {TRIMMED} = '' OR NOT array_contains(drop, xxhash64({TRIMMED}))), '\\n')"
    cleaned = numbered.join(chosen, "row", "left").withColumn(text, F.when(F.col("drop").isNull(), F.col(text)).otherwise(F.expr(kept)))
    if "n_chars" in columns:
        n = f"c{columns.index('n_chars')}"
        cleaned = cleaned.withColumn(n, F.when(F.col("drop").isNull(), F.col(n)).otherwise(F.length(text)).cast(documents.schema["n_chars"].dataType))
    return cleaned.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(columns))).coalesce(scratch.parts)


ORACLE_SQL = f"""
WITH d AS (SELECT *, row_number() OVER () AS rid FROM documents),
l AS (SELECT rid, source, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS raw FROM d),
t AS (SELECT *, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM l),
b AS (SELECT line FROM t WHERE line <> '' AND source IS NOT NULL GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
m AS (SELECT t.*, b.line IS NOT NULL AS hit FROM t LEFT JOIN b ON t.line = b.line),
s AS (SELECT rid, count(*) FILTER (WHERE hit) AS n_removed, string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT hit) AS rest FROM m GROUP BY rid)
SELECT d.doc_id, CAST(coalesce(s.n_removed, 0) AS BIGINT) AS n_removed, CASE WHEN s.n_removed > 0 THEN coalesce(s.rest, '') ELSE d.text END AS text
FROM d LEFT JOIN s ON d.rid = s.rid
"""
