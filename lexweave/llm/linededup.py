"""Cross-site boilerplate: lines that occur on many distinct sites are removed from documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import materialize, unbound

#: Line hashes up to this number (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Buckets of a text's line hashes.
BUCKETS = 256
#: All white space, for blanks below.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def _hash(line: Column, blanks: str) -> Column:
    return F.xxhash64(F.trim(line, F.lit(blanks)))


def _among(lines: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of lines whose h is in chosen (unique h, a written table): broadcast where its counted rows allow it."""
    if chosen.count() <= BROADCAST_ROWS:
        return lines.join(F.broadcast(chosen), "h", "left_semi")
    return lines.join(chosen, "h")


def boilerplate(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = 8, lg_k: int = 9, blanks: str = WHITE) -> DataFrame:
    """Hashes h (long) of the lines that occur on at least min_sites distinct sites.

    Each task sketches the sites of its lines (HyperLogLog, one sketch a line hash), the sketches of a hash merge by
    aggregation, and lines whose estimate lies within four standard errors of min_sites get an exact distinct count.
    A line is compared without the characters of blanks around it; blank lines never count. A null site is no evidence
    of a site."""
    lines = docs.select(
        F.col(site_col).cast("string").alias("site"),
        F.explode(F.array_distinct(F.transform(F.split(F.col(text_col), "\n"), lambda x: _hash(x, blanks)))).alias("h"),
    ).where(F.col("h") != F.xxhash64(F.lit("")))
    error = 4 * 1.04 / 2 ** (lg_k / 2)
    spread = lines.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("n"))
    wide = materialize(spread.where(F.col("n") >= min_sites * (1 - error)), "line-spread")
    near = wide.where(F.col("n") <= min_sites * (1 + error)).select("h")
    exact = _among(lines.where("site is not null"), near).distinct().groupBy("h").count().where(F.col("count") >= min_sites)
    return materialize(wide.where(F.col("n") > min_sites * (1 + error)).select("h").unionByName(exact.select("h")), "boilerplate")


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 8, keep_whole: bool = False,
    blanks: str = WHITE, names: tuple[str, str, str] = ("n_lines", "n_removed", "exempt"),
) -> DataFrame:
    """docs without cross-site boilerplate lines, with every column and, by names, n_lines, n_removed (long) and exempt
    (boolean) added.

    All copies of a line on min_sites or more distinct sites go from every text, blank lines stay. exempt marks texts
    that have such lines and no line of their own that is not blank; with keep_whole they keep all their lines (such a
    text may be a copy of something, to be judged as a document). Only line hashes are shuffled, and each text once; a
    text is rejoined with its own lines' hashes by a hash of its id and text, so repeated and null ids need no care and
    a hot one can be split.

    Null text: stays null, 0 lines. Empty text: one blank line, unchanged. Null site: see boilerplate(). Repeated rows:
    each treated alike. Very long texts: lines are hashed where they are read. Empty table: no rows. Columns of docs
    that have one of the added names are replaced; other names can be given."""
    chosen = boilerplate(docs, text_col, site_col, min_sites, blanks=blanks)
    rows = docs.drop(*names).select(F.struct("*").alias("r"), F.col(text_col).alias("t"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("k"))
    hits = _among(rows.select("k", F.explode(F.array_distinct(F.transform(F.split("t", "\n"), lambda x: _hash(x, blanks)))).alias("h")), chosen)
    # A text's hashes lie in buckets, so that a line is compared with a small part of very many.
    bucket = lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")
    hits = hits.groupBy("k", bucket(F.col("h")).alias("b")).agg(F.collect_set("h").alias("hs"))
    hits = hits.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("b", "hs"))).alias("hs")).select(unbound("k"), "hs")
    lines = F.split("t", "\n")
    among = lambda h: F.coalesce(F.array_contains(F.try_element_at("hs", bucket(h)), h), F.lit(False))
    kept = F.filter(lines, lambda x: ~among(_hash(x, blanks)))
    found = rows.join(hits, "k", "left").select(
        "r", "t", F.when(F.col("hs").isNull(), lines).otherwise(kept).alias("kept"), F.size(F.coalesce(lines, F.array())).cast("long").alias("n")
    )
    bare = F.coalesce((F.size("kept") < F.col("n")) & ~F.exists("kept", lambda x: F.trim(x, F.lit(blanks)) != ""), F.lit(False))
    found = found.withColumn("bare", bare).withColumn("cut", (F.size("kept") < F.col("n")) & (F.lit(not keep_whole) | ~F.col("bare")))
    text = F.when(F.col("cut"), F.array_join("kept", "\n")).otherwise(F.col("t"))
    n_removed = F.when(F.col("cut"), F.col("n") - F.size("kept")).otherwise(F.lit(0)).cast("long")
    own = [c for c in docs.columns if c.lower() not in {x.lower() for x in names}]
    added = (c.alias(x) for c, x in zip((F.col("n"), n_removed, F.col("bare")), names, strict=True))
    return found.select(*(text.alias(c) if c == text_col else F.col("r").getField(c).alias(c) for c in own), *added)
