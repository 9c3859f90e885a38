"""Sentence boundaries learned from a corpus without labels (after Kiss and Strunk 2006): abbreviations, collocations across a
period and words that start sentences, by log-likelihood ratios; then a decision for each period."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.operators.counting import ROWS
from lexweave.sources.scratch import keep

# Thresholds of the published method, and the share of periods that follows an abbreviation.
ABBREVIATION, COLLOCATION, STARTER, CERTAIN = 0.3, 7.88, 30.0, 0.99
# End of fixed values.

OPENERS, CLOSERS = r"[\"'(\[«„“‘]", r"[\"')\]»”’]"
#: White space of any script, as a character class of both Java's and other dialects.
WHITE = r"\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Bytes of texts that are counted at a time; a longer text stands alone.
BYTES = 1 << 24
#: The type of every number.
_NUMBER = "#"
#: White space in Python's dialect, and as characters.
_WHITE = re.sub(r"\\x\{(\w+)\}", lambda x: chr(int(x[1], 16)), WHITE)


def _characters(kind: str) -> str:
    return "".join(chr(k) for k in range(0x3001) if re.match(kind, chr(k)))


_WHITES = _characters(f"[{_WHITE}]")


def bare(tokens: pa.StringArray) -> pa.StringArray:
    """Tokens without openers before them and closers (or commas, colons and semicolons) after them."""
    whole = pc.utf8_ltrim(tokens, _characters(OPENERS))
    closed = pc.utf8_rtrim(whole, _characters(CLOSERS))
    return pc.if_else(pc.equal(closed, whole), pc.utf8_rtrim(whole, ",;:"), closed)


def type_of(token: Column) -> Column:
    """Of a bare token, its lower-case type without a final period; numbers are one type."""
    word = F.lower(F.when(token.endswith("."), F.left(token, F.length(token) - 1)).otherwise(token))
    return F.when(word.rlike(r"^[-+]?[0-9][0-9.,]*$"), _NUMBER).otherwise(word)


def _typed(token: str) -> Column:
    """Whether the type has a character."""
    return ~F.col(token).isin("", ".")


def _log(x: Column) -> Column:
    return F.log(F.greatest(x, F.lit(1e-300)))


def bond(n_word: Column, n_both: Column, n_period: Column, n: Column) -> Column:
    """How much likelier a period follows the word nearly always than as often as it follows any."""
    p = n_period / n
    return -2 * (n_both * _log(p) + (n_word - n_both) * _log(1 - p) - n_both * F.log(F.lit(CERTAIN)) - (n_word - n_both) * F.log(F.lit(1 - CERTAIN)))


def likelihood_ratio(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """Dunning's log-likelihood ratio of two events (a and b times, ab times together) of n."""
    part = lambda k, m, p: k * _log(p) + (m - k) * _log(1 - p)
    return 2 * (part(ab, a, ab / a) + part(b - ab, n - a, F.try_divide(b - ab, n - a)) - part(ab, a, b / n) - part(b - ab, n - a, b / n))


def _upper(token: Column) -> Column:
    return token.rlike(r"^\p{Lu}")


def _lower(token: Column) -> Column:
    return token.rlike(r"^\p{Ll}")


def described(rows: DataFrame) -> DataFrame:
    """rows (token, next: a bare token that may end a sentence, and the one behind it) with mark (period, ellipsis or end, for ! and ?), word
    and next_word (their types)."""
    t = F.col("token")
    mark = F.when(t.endswith("!") | t.endswith("?"), "end").when(t.endswith("..") | t.endswith("…"), "ellipsis").otherwise("period")
    return rows.withColumn("mark", mark).withColumn("word", type_of(F.col("token"))).withColumn("next_word", type_of(F.col("next")))


def _count(texts: pa.StringArray) -> pa.RecordBatch:
    lists = pc.split_pattern_regex(texts, f"[{WHITE}]+")
    found = lists.flatten().dictionary_encode()
    number, text = found.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    there = pc.not_equal(found.dictionary, "").to_numpy(zero_copy_only=False)[number] if len(number) else np.zeros(0, bool)
    stripped = bare(found.dictionary).dictionary_encode()
    names, number, text = stripped.dictionary, stripped.indices.to_numpy(zero_copy_only=False).astype(np.int64)[number[there]], text[there]
    none = len(names)
    marked = pc.match_substring_regex(names, "[.!?…]$").to_numpy(zero_copy_only=False)
    same = text[1:] == text[:-1]
    mid, behind = np.zeros(len(number), np.int64), np.full(len(number), none, np.int64)
    mid[1:] = same & ~marked[number[:-1]]
    behind[:-1] = np.where(same & marked[number[:-1]], number[1:], none)
    key, count = np.unique((number * (none + 1) + behind) * 2 + mid, return_counts=True)
    key, mid = np.divmod(key, 2)
    first, behind = np.divmod(key, none + 1)
    return pa.RecordBatch.from_arrays([names.take(pa.array(first)), names.take(pa.array(behind, mask=behind == none)), pa.array(mid > 0), pa.array(count.astype(np.int64))], ["token", "next", "mid", "n"])


def seen(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """token, next, mid, n: how often each bare token occurs where no sentence end is possible before it (mid) and where one is; those that may
    end a sentence by the token behind them (null: none), others with null. Added up in each batch of texts before their only shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).drop_null()
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            a = 0
            while a < len(texts):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BYTES, side="right")))
                rows = _count(texts.slice(a, b - a))
                for k in range(0, len(rows), ROWS):
                    yield rows.slice(k, ROWS)
                a = b

    by = ["token", "next", "mid"]
    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "token string, next string, mid boolean, n long").repartition(*by).groupBy(*by).agg(F.sum("n").alias("n"))


def type_counts(seen: DataFrame) -> DataFrame:
    """word, n, n_period, upper_mid, lower_mid: of each type how often it occurs, with a final period, and (no sentence end
    being possible before it) with a capital and a small letter."""
    times = lambda what: F.sum(F.when(what, F.col("n")).otherwise(0))
    rows = seen.where(_typed("token")).groupBy("token", "mid").agg(F.sum("n").alias("n")).withColumn("word", type_of(F.col("token")))
    return rows.groupBy("word").agg(
        F.sum("n").alias("n"), times(F.col("token").rlike(r"[^.]\.$")).alias("n_period"), times(F.col("mid") & _upper(F.col("token"))).alias("upper_mid"), times(F.col("mid") & _lower(F.col("token"))).alias("lower_mid")
    )


def places(docs: DataFrame, keys: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """keys, at, token, next: where a sentence may begin within a text (the character from 0), the bare token before and the one that begins
    there."""
    pattern = re.compile(rf"(?<![^{_WHITE}])([^{_WHITE}]*[.!?…](?:{CLOSERS}+|[,;:]+)?)[{_WHITE}]+(?=([^{_WHITE}]+))")
    kinds = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(n, x.end(), x[1], x[2]) for n, text in enumerate(batch.column(len(keys)).to_pylist()) for x in pattern.finditer(text or "")]
            row, at, token, behind = zip(*found, strict=True) if found else [()] * 4
            row = pa.array(row, pa.int64())
            made = pa.RecordBatch.from_arrays([*(batch.column(k).take(row) for k in range(len(keys))), pa.array(at, pa.int32()), bare(pa.array(token, pa.string())), bare(pa.array(behind, pa.string()))], [*keys, "at", "token", "next"])
            for k in range(0, len(made), ROWS):
                yield made.slice(k, ROWS)

    return docs.select(*keys, text_col).mapInArrow(run, f"{kinds}, at int, token string, next string")


class Boundaries(NamedTuple):
    """Written tables: types (word, abbreviation, starter, upper_mid, lower, score) and collocations (word, next_word)."""

    types: DataFrame
    collocations: DataFrame

    @staticmethod
    def learn(docs: DataFrame, text_col: str = "text") -> Boundaries:
        """From the texts of docs.

        The texts are read once: seen() counts tokens as they are written, and only distinct ones are typed. The only
        numbers that reach the driver are totals. Null and empty texts teach nothing; repeated ones count each."""
        found = keep(seen(docs, text_col), "tokens")
        types = keep(type_counts(found), "types")
        n, n_period = types.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_period"), F.lit(0))).first()
        n, n_period = F.lit(float(n)), F.lit(float(n_period))
        dots = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
        letters = F.length("word") - dots
        score = bond(F.col("n"), F.col("n_period"), n_period, n) * F.exp(-letters) * (dots + 1) * F.pow(letters.cast("double"), -(F.col("n") - F.col("n_period")).cast("double"))
        score = F.when((F.col("n_period") > 0) & (F.col("word") != _NUMBER) & F.col("word").rlike(r"\p{L}"), score).otherwise(0.0)
        scored = types.withColumn("score", score).withColumn("abbreviation", F.col("score") >= ABBREVIATION)
        pairs = described(found.where(F.col("next").isNotNull() & _typed("token") & _typed("next"))).where("mark <> 'ellipsis'")
        lower = F.when(_lower(F.col("next")), F.col("n")).otherwise(0)
        pairs = keep(pairs.groupBy("mark", "word", "next_word").agg(F.sum("n").alias("n"), F.sum(lower).alias("lower")), "pairs")
        known = scored.select("word", F.col("n").alias("n_word"), "n_period", "abbreviation")
        pairs = keep(pairs.join(known, "word"), "pairs")
        ends = pairs.where("mark = 'end' or not abbreviation")
        after = ends.groupBy(F.col("next_word").alias("word")).agg(F.sum("n").alias("after"), F.sum("lower").alias("lower_after"))
        breaks = F.lit(float(ends.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))
        whole = scored.join(after, "word", "left").na.fill(0, ["after", "lower_after"])
        ratio = likelihood_ratio(breaks, F.col("n"), F.col("after"), n)
        starter = (F.col("after") > 0) & (F.col("word") != _NUMBER) & F.col("word").rlike(r"^\p{L}") & (ratio >= STARTER) & (F.col("after") * n > F.col("n") * breaks)
        whole = whole.select("word", "score", "abbreviation", starter.alias("starter"), "upper_mid", (F.col("lower_mid") + F.col("lower_after")).alias("lower"))
        single = F.col("word").rlike(r"^\p{L}$") | (F.col("word") == _NUMBER) | F.col("abbreviation")
        joined = pairs.where((F.col("mark") == "period") & single).join(types.select(F.col("word").alias("next_word"), F.col("n").alias("n_next")), "next_word")
        tied = (likelihood_ratio(F.col("n_period"), F.col("n_next"), F.col("n"), n) >= COLLOCATION) & (F.col("n") > 1) & (F.col("n") * n > F.col("n_period") * F.col("n_next"))
        return Boundaries(keep(whole, "types"), keep(joined.where(tied).select("word", "next_word"), "collocations"))

    def decide(self, found: DataFrame) -> DataFrame:
        """found (described()) with ends: whether the sentence ends there. ! and ? end it. Otherwise what is behind an abbreviation, an initial
        or an ellipsis begins a sentence if it has a capital, is written small elsewhere and never has a capital within
        a sentence; behind an abbreviation or an ellipsis also if it has a capital and often starts sentences. A number, an
        initial or an abbreviation that forms a collocation with what follows ends nothing, nor does a number before a
        small letter. Any other period ends the sentence."""
        own = self.types.select("word", "abbreviation")
        behind = self.types.select(F.col("word").alias("next_word"), "starter", "upper_mid", "lower")
        tied = self.collocations.select("word", "next_word", F.lit(True).alias("tied"))
        rows = found.join(own, "word", "left").join(behind, "next_word", "left").join(tied, ["word", "next_word"], "left")
        initial, number = F.col("token").rlike(r"^\p{L}\.$"), F.col("word") == _NUMBER
        fresh = _upper(F.col("next")) & (F.coalesce("lower", F.lit(0)) > 0) & (F.coalesce("upper_mid", F.lit(0)) == 0)
        usual = _upper(F.col("next")) & F.coalesce("starter", F.lit(False))
        short = F.coalesce("abbreviation", F.lit(False))
        ends = (
            F.when(F.col("mark") == "end", True).when(F.col("mark") == "ellipsis", fresh | usual)
            .when(F.coalesce("tied", F.lit(False)), False).when(initial, fresh).when(short, fresh | usual).when(number, ~_lower(F.col("next"))).otherwise(True)
        )
        return rows.select(*found.columns, ends.alias("ends"))

    def sentences(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Id, sent (from 0), text: the sentences of each text, without white space around them.

        Each distinct pair of a token that may end a sentence and the one behind it is decided once; the places of pairs that do come back to
        the text by id and a hash of it, and the text, which is shuffled once and not sorted, is cut there. Null and blank texts have no sentence. Rows
        of equal id and text are cut alike."""
        keyed = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_h"), F.col(text_col).cast("string").alias("_text")).where("_text is not null")
        found = keep(places(keyed, ("_id", "_h"), "_text"), "places")
        ending = self.decide(described(found.select("token", "next").distinct())).where("ends").select("token", "next")
        ends = found.join(ending, ["token", "next"], "left_semi").groupBy(F.col("_id").alias("_i"), F.col("_h").alias("_j")).agg(F.collect_list("at").alias("_e"))
        joined = keyed.join(ends.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_j")), "left")

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, sent, out = [], [], []
                for n, (text, at) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                    if text.strip(_WHITES):
                        at = [0, *sorted(set(at or ())), len(text)]
                        row += [n] * (len(at) - 1)
                        sent += range(len(at) - 1)
                        out += [text[a:b].strip(_WHITES) for a, b in zip(at, at[1:], strict=False)]
                made = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(sent, pa.int32()), pa.array(out, pa.string())], [id_col, "sent", "text"])
                for k in range(0, len(made), ROWS):
                    yield made.slice(k, ROWS)

        return joined.select("_id", "_text", "_e").mapInArrow(cut, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, sent int, text string")
