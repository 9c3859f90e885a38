"""A part-of-speech tagger that is learned from tagged tokens: a second-order hidden Markov model with suffix trees for unknown
words (after Brants 2000), and lemmas by word or by ending."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.sources.scratch import keep

#: Tags at most: transitions between them are held by the driver and every task.
MOST_TAGS = 100
#: Words of the texts that one task tags at a time.
CHUNK_WORDS = 1_000_000
_LEAST = 1e-12
_ENTRY = "array<struct<t: int, p: double, lemma: string>>"


def transition_counts(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """t1, t2, t3, n: how often three tags follow one another in a sentence (keys, pos, tag); null: before its start."""
    w = Window.partitionBy(*keys).orderBy("pos")
    return rows.select(F.lag("tag", 2).over(w).alias("t1"), F.lag("tag", 1).over(w).alias("t2"), F.col("tag").alias("t3")).groupBy("t1", "t2", "t3").agg(F.count("*").alias("n"))


def word_counts(rows: DataFrame) -> DataFrame:
    """word, tag, n, lemma: how often a word has a tag, and its most frequent lemma there (ties: the smaller)."""
    each = rows.groupBy("word", "tag", "lemma").agg(F.count("*").alias("n"))
    return each.groupBy("word", "tag").agg(F.sum("n").alias("n"), F.min(F.struct((-F.col("n")).alias("n"), "lemma")).alias("_m")).select("word", "tag", "n", "_m.lemma")


def suffix_counts(counts: DataFrame, suffix: int, rare: int) -> DataFrame:
    """suffix, tag, n: of the words (word, tag, n) that occur rare times at most, by their last 1 to suffix letters."""
    w = counts.groupBy("word").agg(F.sum("n").alias("_all"))
    few = counts.join(w.where(F.col("_all") <= rare).select("word"), "word", "left_semi")
    return few.select(_endings(suffix).alias("x"), "tag", "n").select("x.suffix", "tag", "n").groupBy("suffix", "tag").agg(F.sum("n").alias("n"))


def _endings(suffix: int) -> Column:
    """Explodes the word to its endings: size, suffix."""
    sizes = F.sequence(F.lit(1), F.least(F.length("word"), F.lit(suffix)))
    sizes = F.when(F.length("word") > 0, sizes).otherwise(F.array().cast("array<int>"))
    return F.explode(F.transform(sizes, lambda k: F.struct(k.alias("size"), F.substr(F.col("word"), F.length("word") - k + 1).alias("suffix"))))


def interpolated(counts: np.ndarray) -> np.ndarray:
    """log P(t3 | t1, t2) from counts[t1, t2, t3], the last of t1 and t2 being the sentence's start: shares of one, two
    and three tags, weighted by deleted interpolation."""
    f123 = counts.astype(float)
    f12, f23 = f123.sum(axis=2), f123.sum(axis=0)
    f2, f3 = f23.sum(axis=1), f23.sum(axis=0)
    total = f3.sum()
    ratio = lambda a, b: np.divide(a, b, out=np.zeros(np.broadcast_shapes(a.shape, b.shape)), where=b > 0)
    left = np.stack(
        [
            np.broadcast_to((f3 - 1) / max(1.0, total - 1), f123.shape),
            np.broadcast_to(ratio(f23 - 1, f2[:, None] - 1), f123.shape),
            ratio(f123 - 1, f12[:, :, None] - 1),
        ]
    )
    seen = f123 > 0
    # Ties go to the longer context.
    which = 2 - left[::-1].argmax(axis=0)
    weights = np.array([f123[seen & (which == k)].sum() for k in range(3)]) / max(1.0, total)
    p = weights[0] * f3 / max(1.0, total) + weights[1] * ratio(f23, f2[:, None]) + weights[2] * ratio(f123, f12[:, :, None])
    return np.log(np.maximum(p, _LEAST))


def viterbi(transitions: np.ndarray, candidates: list[tuple[np.ndarray, np.ndarray]], parts: dict | None = None) -> list[int]:
    """The likeliest tags of a sentence: of each word the numbers of its possible tags (ascending) and their log
    probabilities. transitions: log P(t3 | t1, t2). Ties go to the smaller numbers. parts: of calls whose arrays of tags live as long as it,
    the parts of transitions that these have read, by the arrays' identity."""
    parts = {} if parts is None else parts
    start = parts.setdefault("start", np.array([transitions.shape[0] - 1]))
    one, two, best = start, start, np.zeros((1, 1))
    back = []
    for tags, p in candidates:
        of = (id(one), id(two), id(tags))
        if (part := parts.get(of)) is None:
            part = parts[of] = transitions[np.ix_(one, two, tags)]
        score = best[:, :, None] + part
        if len(one) == 1:
            back.append((one, None))
            best = score[0] + p
        else:
            back.append((one, score.argmax(axis=0)))
            best = score.max(axis=0) + p
        one, two = two, tags
    if not candidates:
        return []
    i, j = np.unravel_index(best.argmax(), best.shape)
    out = [int(two[j])]
    for k in range(len(back) - 1, 0, -1):
        tags = candidates[k - 1][0]
        out.append(int(tags[i]))
        i, j = 0 if back[k][1] is None else back[k][1][i, j], i
    return out[::-1]


class Tagger(NamedTuple):
    """tags; transitions (log probabilities); prior (of the tags); theta (weight of shorter suffixes); and three written tables:
    lexicon (word, e: its tags, log probabilities and lemmas), suffixes (suffix, n: counts by tag), rules (suffix, t,
    cut, add: how an ending gives the lemma)."""

    tags: list[str]
    transitions: np.ndarray
    prior: list[float]
    theta: float
    lexicon: DataFrame
    suffixes: DataFrame
    rules: DataFrame
    suffix: int

    @staticmethod
    def learn(rows: DataFrame, keys: tuple[str, ...] = ("doc_id",), suffix: int = 5, rare: int = 10, transitions: DataFrame | None = None) -> Tagger:
        """From tokens: keys (of a sentence), pos, word, lemma, tag. Rows without word or tag are left out; a missing lemma is the
        word. transitions: transition_counts() of these rows, where there is a way to them without a window over all tokens.

        Words, suffixes and rules are counted and stay tables; the counts of three tags (10^6 at most, by MOST_TAGS) come to
        the driver. A word's probability under a tag is its share of the tag's tokens; that of an unknown word comes from
        the tags of the rare words that end alike, shorter endings weighing theta (the deviation of the tags' shares)
        at each step. The lemma of an unknown word is made as most words of its tag with its longest known ending
        make theirs."""
        rows = rows.where(F.col("word").isNotNull() & F.col("tag").isNotNull()).withColumn("lemma", F.coalesce("lemma", "word"))
        counts = keep(word_counts(rows), "words")
        by_tag = {r["tag"]: r["n"] for r in counts.groupBy("tag").agg(F.sum("n").alias("n")).limit(MOST_TAGS + 1).collect()}
        if len(by_tag) > MOST_TAGS:
            raise ValueError(f"more than {MOST_TAGS} tags")
        tags = sorted(by_tag)
        at, total = {t: k for k, t in enumerate(tags)}, max(1, sum(by_tag.values()))
        cube = np.zeros((len(tags) + 1, len(tags) + 1, len(tags)))
        for r in (transition_counts(rows, keys) if transitions is None else transitions).collect():
            cube[at.get(r["t1"], len(tags)), at.get(r["t2"], len(tags)), at[r["t3"]]] += r["n"]
        prior = [by_tag[t] / total for t in tags]
        number = (F.array_position(F.lit(tags), F.col("tag")) - 1).cast("int")
        share = F.log(F.col("n") / F.get(F.lit([float(by_tag[t]) for t in tags]), number))
        if not tags:
            number, share = F.lit(0), F.lit(0.0)
        numbered = counts.withColumn("t", number)
        lexicon = numbered.withColumn("p", share).groupBy("word").agg(F.array_sort(F.collect_list(F.struct("t", "p", "lemma"))).alias("e"))
        ends = suffix_counts(counts, suffix, rare).withColumn("t", number).groupBy("suffix").agg(F.map_from_entries(F.collect_list(F.struct("t", "n"))).alias("m"))
        ends = ends.select("suffix", F.transform(F.sequence(F.lit(0), F.lit(max(0, len(tags) - 1))), lambda k: F.coalesce(F.element_at("m", k), F.lit(0)).cast("double")).alias("n"))
        common = F.size(F.filter(F.sequence(F.lit(0), F.least(F.length("word"), F.length("lemma"))), lambda k: F.substr("word", F.lit(1), k) == F.substr("lemma", F.lit(1), k))) - 1
        made = numbered.select(_endings(suffix).alias("x"), "t", (F.length("word") - common).alias("cut"), F.substr("lemma", common + 1).alias("add"))
        made = made.where(F.col("x.size") >= F.col("cut")).groupBy("x.suffix", "t", "cut", "add").agg(F.count("*").alias("n"))
        rules = made.groupBy("suffix", "t").agg(F.min(F.struct((-F.col("n")).alias("n"), "cut", "add")).alias("r")).select("suffix", "t", "r.cut", "r.add")
        tables = [keep(x, name) for x, name in ((lexicon, "lexicon"), (ends, "suffixes"), (rules, "rules"))]
        theta = float(np.std(prior, ddof=1)) if len(prior) > 1 else 1.0
        return Tagger(tags, interpolated(cube), prior, theta, *tables, suffix)

    def emissions(self, words: DataFrame) -> DataFrame:
        """word, e (its tags, log probabilities up to a number a word, and lemmas) of distinct words: from the lexicon, else
        from its endings."""
        found = words.join(self.lexicon, "word", "left")
        unknown = found.where("e is null").select("word")
        ends = keep(unknown.select("word", _endings(self.suffix).alias("x")).select("word", "x.size", "x.suffix"), "endings")
        seen = ends.join(self.suffixes, "suffix").groupBy("word").agg(F.array_sort(F.collect_list(F.struct("size", "n"))).alias("found"))
        lemmas = ends.join(self.rules, "suffix").groupBy("word", "t").agg(F.max_by(F.struct("cut", "add"), "size").alias("r"))
        lemma = F.concat(F.substr("word", F.lit(1), F.length("word") - F.col("r.cut")), F.col("r.add"))
        lemmas = lemmas.select("word", "t", lemma.alias("lemma")).groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("t", "lemma"))).alias("lemmas"))
        prior = F.lit(self.prior)

        def longer(p: Column, x: Column) -> Column:
            size = F.aggregate(x["n"], F.lit(0.0), lambda a, b: a + b)
            return F.zip_with(p, x["n"], lambda a, n: (n / size + self.theta * a) / (1 + self.theta))

        p = F.aggregate(F.coalesce("found", F.array().cast("array<struct<size: int, n: array<double>>>")), prior, longer)
        made = F.transform(F.zip_with(p, prior, lambda a, b: F.log(F.greatest(a / b, F.lit(_LEAST)))), lambda x, k: F.struct(k.alias("t"), x.alias("p"), F.coalesce(F.try_element_at("lemmas", k), F.col("word")).alias("lemma")))
        guessed = unknown.join(seen, "word", "left").join(lemmas, "word", "left").select("word", made.cast(_ENTRY).alias("e"))
        return found.where("e is not null").select("word", F.col("e").cast(_ENTRY).alias("e")).unionByName(guessed)

    def tag(self, rows: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """keys, pos, word, lemma, tag of tokens (keys of a sentence, pos, word): the likeliest tags of each sentence.

        Sentences are put together by one shuffle; the rest is tag_texts(). Null words are left out; equal positions go by the word. A
        tagger that has learned nothing gives no rows."""
        if not self.tags:
            return rows.select(*keys, "pos", "word", F.lit(None).cast("string").alias("lemma"), F.lit(None).cast("string").alias("tag")).where(F.lit(False))
        sentences = rows.where(F.col("word").isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("s"))
        out = self.tag_texts(sentences.select(*keys, F.col("s.pos").alias("positions"), F.col("s.word").alias("words")))
        out = out.select(*keys, F.explode(F.arrays_zip("positions", "words", "lemmas", "tags")).alias("x"))
        return out.select(*keys, F.col("x.positions").alias("pos"), F.col("x.words").alias("word"), F.col("x.lemmas").alias("lemma"), F.col("x.tags").alias("tag"))

    def tag_texts(self, texts: DataFrame) -> DataFrame:
        """texts (words, an array without nulls, and any columns) with lemmas and tags, arrays of the likeliest ones.

        Each distinct word is looked up once. Texts are written and dealt to chunks of about CHUNK_WORDS words; a chunk gets its distinct
        words' tags, each once, and is decoded in a task: no token travels with its tags."""
        kept = keep(texts, "texts")
        names, transitions, tags = kept.columns, self.transitions, self.tags
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "lemmas array<string>, tags array<string>"])
        if not tags:
            return kept.select("*", *(F.lit(None).cast("array<string>").alias(c) for c in ("lemmas", "tags"))).where(F.lit(False))
        total = kept.agg(F.sum(F.size("words"))).first()[0] or 1
        # All cores have a chunk before any is full.
        chunks = max(-(-total // CHUNK_WORDS), min(kept.sparkSession.sparkContext.defaultParallelism, -(-20 * total // CHUNK_WORDS)))
        dealt = kept.withColumn("_chunk", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)))
        met = keep(dealt.select("_chunk", F.explode("words").alias("word")).distinct(), "met")
        known = keep(self.emissions(met.select("word").distinct()), "emissions")

        def decode(key: tuple, texts: pa.Table, entries: pa.Table) -> pa.Table:
            texts, entries = texts.select(names).combine_chunks(), entries.combine_chunks()
            e = entries.column("e").combine_chunks()
            ends, flat = e.offsets.to_numpy(), e.flatten()
            t, p, lemma = flat.field("t").to_numpy(), flat.field("p").to_numpy(), flat.field("lemma")
            ends = ends - ends[0]
            same, parts = {}, {}
            each = [(same.setdefault(x.tobytes(), x), p[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True) for x in (t[a:b],)]
            place = np.repeat(np.arange(len(each)), np.diff(ends)) * len(tags) + t
            lists = texts.column("words").combine_chunks()
            found = lists.flatten().dictionary_encode()
            words = pc.index_in(found.dictionary, value_set=entries.column("word").combine_chunks()).take(found.indices).to_numpy()
            offsets = lists.offsets.to_numpy() - lists.offsets.to_numpy()[0]
            best = np.array([k for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for k in viterbi(transitions, [each[w] for w in words[a:b].tolist()], parts)], np.int64)
            # Tags of a word ascend, so places in the table of all words' tags do.
            at = np.searchsorted(place, words * np.int64(len(tags)) + best)
            made = (lemma.take(pa.array(at)), pa.array(tags).take(pa.array(best)))
            for name, x in zip(("lemmas", "tags"), made, strict=True):
                texts = texts.append_column(name, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), x))
            return texts

        sent = met.join(known, "word").select("_chunk", "word", "e")
        return dealt.groupBy("_chunk").cogroup(sent.groupBy("_chunk")).applyInArrow(decode, schema)
