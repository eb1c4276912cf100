"""Cross-site line dedup by distinct-site spread.

A line (trimmed, not blank) that stands on at least `min_sites` distinct sites
is boilerplate; it stays where its smallest document has it first, and goes
everywhere else.  Lines are keyed by two 64-bit hashes.  Spread is estimated by
a HyperLogLog sketch of sites per line, merged by aggregation; lines whose
estimate is near the threshold get an exact distinct count, and it decides.
Lines with fewer occurrences than `min_sites` cannot qualify and get no sketch.

Cases: null and empty texts have no lines and come back as they are; a null
site is a site of its own; blank lines stay; repeated lines of a document are
one site; of rows with equal doc_id a line stays at its first place, and lines go
by row (known by a hash of its text), not by number alone; rows with a null doc_id keep
all lines, but count for spread; the lines of a long text are rows of their own, its
text is put together again in one; outputs whose name a column of docs has get an
underscore appended, and the column stays; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, table

MIN_SITES = 8
SKETCH_BITS = 8
#: Sketches of 2^8 registers err by 6.5 % (one sigma); within this share of the threshold, lines are counted exactly.
NEAR = 0.35


def lines(docs: DataFrame, site: str) -> DataFrame:
    """(doc_id, row, site, place, h1, h2) of every line that is not blank."""
    at = docs.select("doc_id", F.xxhash64("text").alias("row"), F.coalesce(F.col(site).cast("string"), F.lit("\x00")).alias("site"), F.posexplode(F.split("text", "\n")).alias("place", "line"))
    at = at.withColumn("line", F.trim(F.col("line"))).where("line <> ''")
    return at.select("doc_id", "row", "site", "place", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def boilerplate(docs: DataFrame, site: str, min_sites: int = MIN_SITES) -> tuple[DataFrame, DataFrame]:
    """The places of candidate lines, and (h1, h2, n_sites, exact) of the lines found to be boilerplate."""
    key = ["h1", "h2"]
    every = lines(docs, site)
    often = cut(every.groupBy(*key).count().where(F.col("count") >= min_sites).select(*key), "often")
    places = cut(every.join(often, key, "left_semi"), "places")
    sites = places.select(*key, "site")
    spread = sites.groupBy(*key).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_BITS))).alias("n_sites"))
    spread = cut(spread, "spread")
    low, high = min_sites * (1 - NEAR), min_sites * (1 + NEAR)
    clear = spread.where(F.col("n_sites") > high).select(*key, "n_sites", F.lit(False).alias("exact"))
    near = spread.where(F.col("n_sites").between(low, high)).select(*key)
    exact = sites.join(near, key, "left_semi").groupBy(*key).agg(F.count_distinct("site").alias("n_sites"))
    return places, clear.union(exact.where(F.col("n_sites") >= min_sites).select(*key, "n_sites", F.lit(True).alias("exact")))


def line_dedup(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """docs with boilerplate lines taken out of text, and n_lines, n_removed (long)."""
    key = ["h1", "h2"]
    lines_, removed, gone_, gone_id, gone_row = fresh(docs.columns, "n_lines", "n_removed", "gone", "gone_id", "gone_row")
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(site))
    places, found = boilerplate(typed, site, min_sites)
    found = cut(found, "boilerplate")
    hits = places.join(found.select(*key), key, "left_semi").where("doc_id is not null")
    first = cut(hits.groupBy(*key).agg(F.min(F.struct("doc_id", "place", "row")).alias("first")), "first")
    gone = hits.join(first, key).where(F.struct("doc_id", "place", "row") != F.col("first"))
    gone = gone.groupBy(F.col("doc_id").alias(gone_id), F.col("row").alias(gone_row)).agg(F.collect_set("place").alias(gone_))
    both = docs.join(gone, (F.col("doc_id").cast("long") == F.col(gone_id)) & (F.xxhash64(F.col("text").cast("string")) == F.col(gone_row)), "left")
    split = F.split(F.col("text").cast("string"), "\n")
    # positions to drop are few; a map makes the test for each line independent of their number
    dropped = F.map_from_arrays(gone_, F.transform(gone_, lambda p: F.lit(True)))
    kept = F.filter(F.transform(split, lambda line, i: F.struct(line.alias("line"), i.alias("i"))), lambda s: ~F.map_contains_key(dropped, s["i"]))
    text = F.when(F.col(gone_).isNull(), F.col("text").cast("string")).otherwise(F.array_join(F.transform(kept, lambda s: s["line"]), "\n"))
    n_lines = F.coalesce(F.size(F.filter(split, lambda line: F.trim(line) != "")).cast("long"), F.lit(0))
    n_removed = F.coalesce(F.size(gone_).cast("long"), F.lit(0))
    n_removed = F.when(F.col(gone_).isNull(), 0).otherwise(n_removed).cast("long")
    return both.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], n_lines.alias(lines_), n_removed.alias(removed))


def op1_line_dedup(spark, sf_dir) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = f"""
WITH l AS (
  SELECT doc_id, coalesce(source, chr(1)) AS site, generate_subscripts(s, 1) - 1 AS place, unnest(s) AS line
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS s FROM documents)
), t AS (SELECT doc_id, site, place, line, trim(line, ' ') AS k FROM l),
b AS (SELECT k FROM t WHERE k <> '' GROUP BY k HAVING count(DISTINCT site) >= {MIN_SITES}),
f AS (SELECT k, min((doc_id, place)) AS first FROM t JOIN b USING (k) GROUP BY k),
m AS (
  SELECT t.doc_id, t.place, t.line, t.k, (f.k IS NOT NULL AND (t.doc_id, t.place) <> f.first) AS gone
  FROM t LEFT JOIN f ON t.k = f.k
), r AS (
  SELECT doc_id, count(*) FILTER (k <> '') AS n_lines, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '') AS kept
  FROM m GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id
"""
