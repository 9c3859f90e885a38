"""Words for the gaps of a text, from the words beside them in a corpus: n-gram counts with back-off."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.sources.scratch import keep

#: What a lower order counts for (Brants et al. 2007).
BACKOFF = 0.4


def _best(rows: DataFrame, by: list[str], topn: int) -> DataFrame:
    """rows (by, w, freq) with p, the share of freq in its group, and the topn of each group alone."""
    total = rows.groupBy(*by).agg(F.sum("freq").alias("_all"))
    order = Window.partitionBy(*by).orderBy(F.desc("freq"), "w")
    best = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= topn)
    return best.join(total, by).select(*by, "w", (F.col("freq") / F.col("_all")).alias("p"))


class Contexts(NamedTuple):
    """What was learned, topn words a context: both (left, right, w, p), left (left, w, p), right (right, w, p) and any
    (w, p)."""

    both: DataFrame
    left: DataFrame
    right: DataFrame
    any: DataFrame
    topn: int

    @staticmethod
    def learn(unigrams: DataFrame, bigrams: DataFrame, trigrams: DataFrame, topn: int = 100) -> Contexts:
        """From tables of counts (w1 .. wn, freq). Each context keeps its topn words, which a window finds as a limit by group, before
        and after its shuffle; so however frequent a word is, its contexts do not grow with the corpus. The
        tables are written once."""
        both = _best(trigrams.select(F.col("w1").alias("left"), F.col("w3").alias("right"), F.col("w2").alias("w"), "freq"), ["left", "right"], topn)
        left = _best(bigrams.select(F.col("w1").alias("left"), F.col("w2").alias("w"), "freq"), ["left"], topn)
        right = _best(bigrams.select(F.col("w2").alias("right"), F.col("w1").alias("w"), "freq"), ["right"], topn)
        total = unigrams.agg(F.sum("freq")).first()[0] or 1
        most = unigrams.orderBy(F.desc("freq"), "w1").limit(topn).select(F.col("w1").alias("w"), (F.col("freq") / F.lit(total)).alias("p"))
        return Contexts(*(keep(t, name) for t, name in ((both, "both"), (left, "left"), (right, "right"), (most, "any"))), topn)

    def guesses(self, texts: DataFrame, sign: str = "<mask>") -> DataFrame:
        """text, k (the k-th mask of it, from 0), w, r (its rank, from 0), p: the topn words for each mask of texts (text; masks are
        words of their own).

        p is the largest of: the word's share between the two words beside the mask, BACKOFF times its share after the
        left or before the right one, BACKOFF squared times its share of all words. Each share's topn words hold the
        topn of the largest, so nothing but these is joined. A mask beside another, or at the end of a text, has no
        word on that side. Equal shares go by the word. Repeated texts count once; a null text has no mask."""
        word = F.split("text", " ")
        beside = lambda c: F.when(c != sign, c)
        at = F.posexplode(F.arrays_zip(word.alias("w"), F.concat(F.array(F.lit(None).cast("string")), word).alias("l"), F.slice(F.concat(word, F.array(F.lit(None).cast("string"))), F.lit(2), F.size(word)).alias("r")))
        rows = texts.select("text").distinct().select("text", at.alias("p", "x")).where(F.col("x.w") == sign)
        k = F.row_number().over(Window.partitionBy("text").orderBy("p")) - 1
        gaps = keep(rows.select("text", k.alias("k"), beside(F.col("x.l")).alias("left"), beside(F.col("x.r")).alias("right")), "gaps")
        take = lambda found, weight: found.select("text", "k", "w", (F.col("p") * F.lit(weight)).alias("p"))
        if (every := [(r["w"], r["p"]) for r in self.any.collect()]):  # topn rows at most
            most = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(p).alias("p")) for w, p in every))
            anywhere = gaps.select("text", "k", F.explode(most).alias("x")).select("text", "k", "x.w", "x.p")
        else:
            anywhere = gaps.select("text", "k", F.col("left").alias("w"), F.lit(0.0).alias("p")).where(F.lit(False))
        found = (
            take(gaps.join(self.both, ["left", "right"]), 1.0).unionByName(take(gaps.join(self.left, "left"), BACKOFF))
            .unionByName(take(gaps.join(self.right, "right"), BACKOFF)).unionByName(take(anywhere, BACKOFF * BACKOFF))
        )
        best = found.groupBy("text", "k", "w").agg(F.max("p").alias("p"))
        order = Window.partitionBy("text", "k").orderBy(F.desc("p"), "w")
        return best.withColumn("r", (F.row_number().over(order) - 1).cast("long")).where(F.col("r") < self.topn).select("text", "k", "w", "r", "p")
