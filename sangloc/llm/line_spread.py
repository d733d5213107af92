"""Line dedup by spread over sites, in DataFrame operations only.

A line (its text without outer spaces, if not blank) that occurs on `min_sites` distinct sites or more is
boilerplate.  Every line hash gets a HyperLogLog sketch of its sites; sketches are built before the shuffle and
merged after it, so that a line found in a third of all rows sends one sketch per task.  Lines whose estimate is
clearly above the threshold are taken as they are; those near it get an exact distinct count, from the rows of these
lines alone.  Boilerplate goes from every document but the one with the smallest key that holds it.

Lines are compared by 96 bits of two hashes.

Rows: one result per input row, with all its columns and `n_lines`, `n_removed` (long).  A null text has no lines
and stays null; a text that loses all its lines is empty.  A null site is no site.  Rows that repeat a key are
parts of one document.  A null key is the smallest only where all keys of a line are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sangloc.llm.common import removed, staged

MIN_SITES = 10
#: log2 of a sketch's registers: a standard error of 1.6 %.
SKETCH_BITS = 12
#: Estimates this near to the threshold (over five standard errors, and one site) are counted exactly.
NEAR_SHARE, NEAR_SITES = 0.1, 1
HASHES = ("_h", "_g")


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("_h"), F.hash(line, F.lit(1)).alias("_g")]


def line_rows(docs: DataFrame, key: str, text: str, site: str) -> DataFrame:
    """(_key, _site, _t, _u, _pos, _h, _g) of the lines that are not blank; _t and _u are hashes of the whole text."""
    whole = [F.xxhash64(F.col(text)).alias("_t"), F.hash(F.col(text), F.lit(1)).alias("_u")]
    rows = docs.select(F.col(key).alias("_key"), F.col(site).alias("_site"), *whole, F.posexplode_outer(_lines(text)).alias("_pos", "_line"))
    rows = rows.withColumn("_line", F.trim("_line")).where("_line <> ''")
    return rows.select("_key", "_site", "_t", "_u", "_pos", *_hashes(F.col("_line")))


def boilerplate(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(_h, _g, _keeper) of the lines on `min_sites` sites or more; a staged table."""
    rows = line_rows(docs, key, text, site)
    sketches = rows.groupBy(*HASHES).agg(
        F.hll_sketch_estimate(F.hll_sketch_agg(F.col("_site").cast("string"), F.lit(SKETCH_BITS))).alias("_estimate"),
        F.min("_key").alias("_keeper"),
    )
    slack = NEAR_SHARE * min_sites + NEAR_SITES
    wide = staged(sketches.where(F.col("_estimate") >= min_sites - slack), "line-spread")
    is_near = F.col("_estimate") <= min_sites + slack
    near = wide.where(is_near).select(*HASHES, "_keeper")
    # A left semi join that Spark may broadcast by the staged table's own size; distinct comes before the count.
    sites = rows.join(near.select(*HASHES), list(HASHES), "left_semi").select(*HASHES, "_site").distinct()
    counted = sites.groupBy(*HASHES).agg(F.count("_site").alias("_sites")).where(F.col("_sites") >= min_sites)
    exact = near.join(counted, list(HASHES)).select(*HASHES, "_keeper")
    found = staged(wide.where(~is_near).select(*HASHES, "_keeper").unionByName(exact), "boilerplate")
    removed(wide)
    return found


def without_boilerplate(
    docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES
) -> DataFrame:
    """The rows with their texts rid of boilerplate, and n_lines, n_removed."""
    lines = boilerplate(docs, key, text, site, min_sites)
    rows = line_rows(docs, key, text, site)
    hit = rows.join(lines, list(HASHES)).where(~F.col("_key").eqNullSafe(F.col("_keeper")))
    # Rows that repeat a key lose lines by their own texts.
    gone = hit.groupBy("_key", "_t", "_u").agg(F.collect_set("_pos").alias("_gone"))
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"))
    named = packed.withColumns(
        {
            "_text": F.col("_doc").getField(text),
            "_lines": F.split(F.col("_doc").getField(text), "\n", -1),
        }
    )
    same = (
        F.col("_doc").getField(key).eqNullSafe(F.col("_key"))
        & (F.xxhash64("_text") == F.col("_t"))
        & (F.hash("_text", F.lit(1)) == F.col("_u"))
    )
    out = named.join(gone, same, "left")
    # One hashed pass over the places, whatever the number of lines that go.
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("_lines"), i)), "\n")
    return out.select(
        *[F.col("_doc").getField(c).alias(c) for c in docs.columns if c not in (text, "n_lines", "n_removed")],
        F.when(F.col("_gone").isNotNull(), kept).otherwise(F.col("_text")).alias(text),
        F.when(F.col("_text").isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


ORACLE_SQL = f"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
b AS (
  SELECT trim(line) AS k, min(doc_id) AS keeper FROM l
  WHERE trim(line) <> '' GROUP BY trim(line) HAVING count(DISTINCT source) >= {MIN_SITES}),
m AS (
  SELECT l.*, (b.k IS NOT NULL AND l.doc_id <> b.keeper) AS gone
  FROM l LEFT JOIN b ON trim(l.line) = b.k)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
       count(*) AS n_lines, count(*) FILTER (gone) AS n_removed
FROM m GROUP BY doc_id
"""
