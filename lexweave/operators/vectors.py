"""Word vectors as tables (word, vec): training, nearest neighbours by cosine and by the product of cosines."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.sources.scratch import keep

#: Query vectors, and words, that one task compares with each other: a matrix each. Either side is sent once for each block of the other, so
#: small blocks would be sent very often; fewer queries are dealt to SPREAD tasks of at least 1,000.
QUERY_BLOCK, WORD_BLOCK, SPREAD = 32_768, 32_768, 16
#: Queries whose products one task holds at a time.
QUERY_ROWS = 100


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(vec: Column) -> Column:
    """The vector at length 1, as doubles; null for a zero vector. Vector and length are bound once: an expression that stands in a function
    of one element is evaluated for each element."""
    once = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))
    return once(vec, lambda v: once(F.sqrt(dot(v, v)), lambda norm: F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))))


def _best(scored: DataFrame, topn: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("score"), "word")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= topn).select("query", "rank", "word", "score")


def _against(table: DataFrame, queries: DataFrame, topn: int, multiply: bool) -> DataFrame:
    """query, rank, word, score: the topn words of table (word, u: unit vectors) with the highest scores for each query
    (query, q: array of unit vectors, own: words not to return): the cosine with the one vector, or (multiply) the
    product of (1 + cosine) / 2 over all.

    Queries are dealt to blocks and words to parts; a part meets a block in one task, as products of matrices in single
    precision, whose error is bounded; what may be among the topn words of a query is scored again in double precision. Scores are compared
    to 12 places, so that equal vectors tie and go by the word."""
    n = queries.count()
    parts, blocks = max(1, -(-table.count() // WORD_BLOCK)), max(1, -(-n // QUERY_BLOCK), min(SPREAD, -(-n // 1000)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    words = table.select("word", "u", F.size("u").alias("d"), deal("word", parts).alias("part"), every(blocks).alias("block"))
    asked = queries.select("query", "q", "own", F.size(F.get("q", F.lit(0))).alias("d"), deal("query", blocks).alias("block"), every(parts).alias("part"))
    kinds = {c: of.schema[c].dataType.simpleString() for c, of in (("query", queries), ("word", table))}

    def score(words: pa.Table, asked: pa.Table) -> pa.Table:
        columns: list[list] = [[], [], []]
        if len(words) and len(asked):
            u = words.column("u").combine_chunks().flatten().to_numpy().reshape(len(words), -1)
            order = pc.sort_indices(words.column("word")).to_numpy()
            names, u = words.column("word").take(pa.array(order)), u[order]
            place = {w: k for k, w in enumerate(names.to_pylist())}
            lists = asked.column("q").combine_chunks()
            size = np.diff(lists.offsets.to_numpy())
            vecs = lists.flatten().flatten().to_numpy().reshape(int(size.sum()), -1)
            first, own = np.cumsum(size) - size, asked.column("own").to_pylist()
            # Twice what a product of unit vectors of this length can be off in single precision, and as often as there are factors.
            slack = np.float32(4 * (u.shape[1] + 4) * 2.0**-24 * (max(size) if multiply else 1))
            rough, found, of = u.astype(np.float32).T, [], []
            for a in range(0, len(asked), QUERY_ROWS):
                b = min(len(asked), a + QUERY_ROWS)
                lo, hi = first[a], first[b - 1] + size[b - 1]
                cos = vecs[lo:hi].astype(np.float32) @ rough
                s = np.multiply.reduceat((1 + cos) / 2, first[a:b] - lo, axis=0) if multiply else cos[first[a:b] - lo]
                for k, words_ in enumerate(own[a:b]):
                    s[k, [place[w] for w in words_ if w in place]] = -np.inf
                least = _at_least(s, topn)
                q, w = np.nonzero((s >= (least - slack)[:, None]) & (s > -np.inf))
                if multiply:
                    exact = np.ones(len(q))
                    for k in range(max(size[a:b])):
                        there = size[a + q] > k
                        exact[there] *= (1 + np.einsum("ij,ij->i", u[w[there]], vecs[first[a + q[there]] + k])) / 2
                else:
                    exact = np.einsum("ij,ij->i", u[w], vecs[first[a + q]])
                exact = np.round(exact, 12)
                # Words are in order, so that ties go to the smaller one.
                order = np.lexsort((w, -exact, q))
                q, w, exact = q[order], w[order], exact[order]
                rank = np.arange(len(q)) - np.searchsorted(q, q)
                q, w, exact = q[rank < topn], w[rank < topn], exact[rank < topn]
                of.append(a + q)
                found.append(w)
                columns[2] += exact.tolist()
            columns[0] = asked.column("query").combine_chunks().take(pa.array(np.concatenate(of)))
            columns[1] = names.take(pa.array(np.concatenate(found)))
        types = asked.schema.field("query").type, words.schema.field("word").type, pa.float64()
        return pa.table({c: x if isinstance(x, pa.ChunkedArray | pa.Array) else pa.array(x, t) for c, x, t in zip(("query", "word", "score"), columns, types, strict=True)})

    keys = ("d", "part", "block")
    scored = words.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(score, f"query {kinds['query']}, word {kinds['word']}, score double")
    return _best(scored, topn)


def _at_least(s: np.ndarray, topn: int) -> np.ndarray:
    """A value for each row that its topn-th largest reaches, and few others do: the topn-th largest of the largest values of strips, which
    takes a maximum in place of a selection from the whole row; minus infinity where a row has no more than topn."""
    if topn >= s.shape[1]:
        return np.full(len(s), -np.inf, s.dtype)
    strips = s.shape[1] // max(1, min(64, s.shape[1] // (8 * topn)))
    if strips < s.shape[1]:
        s = np.maximum.reduce([s[:, a : a + strips] for a in range(0, s.shape[1] - strips + 1, strips)])
    return np.partition(s, -topn, axis=1)[:, -topn]


def _queries(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """queries (query, word): the unit vectors of each query's known words, and the words."""
    known = queries.join(vectors.select(F.col("word").alias("_w"), F.col("u").alias("v")), F.col("word") == F.col("_w")).select("query", "word", "v")
    return known.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("word", "v"))).alias("_k")).select("query", F.transform("_k", lambda x: x["v"]).alias("q"), F.transform("_k", lambda x: x["word"]).alias("own"))


def with_units(vectors: DataFrame, word: str = "word", vec: str = "vec") -> DataFrame:
    return vectors.select(F.col(word).alias("word"), unit(F.col(vec)).alias("u")).where("u is not null")


def nearest_cosine(vectors: DataFrame, queries: DataFrame, topn: int = 10) -> DataFrame:
    """Query, rank, word, score: the cosine of a word to the mean of the query's unit vectors. A query of no
    known word has no rows. vectors: word, vec; queries: query, word (a row a word)."""
    u = with_units(vectors)
    q = _queries(queries, u)
    total = F.aggregate(F.slice("q", 2, F.greatest(F.size("q") - 1, F.lit(0))), F.element_at("q", 1), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    q = q.select("query", F.array(unit(total)).alias("q"), "own")
    return _against(u, q.where(F.get("q", F.lit(0)).isNotNull()), topn, False)


def nearest_cosmul(vectors: DataFrame, queries: DataFrame, topn: int = 10) -> DataFrame:
    """The product over the query's words of (1 + cosine) / 2 (Levy and Goldberg 2014)."""
    u = with_units(vectors)
    return _against(u, _queries(queries, u), topn, True)


def nearest_each(vectors: DataFrame, words: DataFrame, topn: int = 10, tag: Column | None = None, measure: str = "cosine") -> DataFrame:
    """Neighbours of each word by itself; with tag, a condition on word (of the neighbour) and query that is put
    after the ranks are given."""
    find = {"cosine": nearest_cosine, "cosmul": nearest_cosmul}[measure]
    found = find(vectors, words.select(F.col("word").alias("query"), "word").distinct(), topn)
    return found if tag is None else found.where(tag)


def in_vocabulary(words: DataFrame, vectors: DataFrame) -> DataFrame:
    """Words (word, ..) with known."""
    return words.join(vectors.select("word").distinct().withColumn("known", F.lit(True)), "word", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def train_word2vec(sentences: DataFrame, size: int = 100, window: int = 8, min_count: int = 5, epochs: int = 5, seed: int = 0, parts: int = 1, words_col: str = "words"):
    """Word, vec from sentences (words: array of strings), by skip-gram."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    model = Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, maxIter=epochs, seed=seed, numPartitions=parts, inputCol=words_col, outputCol="_v").fit(sentences)
    return model.getVectors().select("word", vector_to_array("vector").alias("vec"))


def train_cbow(
    sentences: DataFrame, size: int = 100, window: int = 8, min_count: int = 5, epochs: int = 5, seed: int = 0, parts: int | None = None, negative: int = 5, rate: float = 0.05,
    words_col: str = "words",
) -> tuple[DataFrame, list[float]]:
    """Word, vec by continuous bags of words with negative sampling, and the mean loss of a word in each epoch: the
    model of embed.train_bags(), in parts chunks (by default as many as the words ask for)."""
    from lexweave.operators.embed import train_bags

    model = train_bags(sentences, size, window, min_count, epochs, seed, negative, rate, chunks=parts, words_col=words_col)
    return model.vectors(), model.losses


def train_by_field(sentences: DataFrame, fields: list[str], **settings) -> dict[str, DataFrame]:
    """A table of vectors for each field, and for all under the empty name."""
    return {"": train_word2vec(sentences, **settings)} | {f: train_word2vec(sentences.where(F.col("field") == f), **settings) for f in fields}


def subword_vectors(vectors: DataFrame, words: DataFrame, least: int = 3, most: int = 6) -> DataFrame:
    """E2 for vectors that were trained without subwords (embed.train_bags() learns them): vectors of any words (word) as the mean of their character n-grams' vectors, each being
    the mean of the known words that have it."""
    def grams(w: Column) -> Column:
        padded = F.concat(F.lit("<"), w, F.lit(">"))
        sized = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), lambda i: F.substring(padded, i, F.lit(n)))
        return F.array_distinct(F.flatten(F.array(*map(sized, range(least, most + 1)))))

    known = vectors.select(F.explode(grams(F.col("word"))).alias("g"), F.posexplode("vec").alias("k", "x")).groupBy("g", "k").agg(F.avg("x").alias("x"))
    asked = words.select("word").distinct().select("word", F.explode(grams(F.col("word"))).alias("g"))
    mean = asked.join(known, "g").groupBy("word", "k").agg(F.avg("x").alias("x"))
    return mean.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("_v")).select("word", F.transform("_v", lambda v: v["x"]).alias("vec"))


def cooccurrences(tokens: DataFrame, window: int = 5) -> DataFrame:
    """Word, context, weight: 1 / distance summed over the pairs of words at most window apart, each pair once, the
    smaller word first. tokens: doc_id, pos, word. The next words come from one window, not from a join."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    near = tokens.select("word", F.array(*(F.struct(F.lead("word", k).over(w).alias("c"), F.lit(1.0 / k).alias("x")) for k in range(1, window + 1))).alias("near"))
    pairs = near.select("word", F.explode("near").alias("n")).select("word", "n.c", "n.x").where("c is not null")
    return pairs.groupBy(F.least("word", "c").alias("word"), F.greatest("word", "c").alias("context")).agg(F.sum("x").alias("weight"))


def train_glove(pairs: DataFrame, size: int = 50, rounds: int = 10, seed: int = 0) -> DataFrame:
    """Word, vec by the weighted factorisation of co-occurrences (glove.factorise())."""
    from lexweave.operators.glove import factorise

    return factorise(pairs, size, rounds, seed)[0]


def numbered(words: DataFrame, column: str) -> DataFrame:
    """column, id: the distinct values with integers from 0, without gaps, in order. Only a count a partition is
    collected; the values are written before they are counted, so the numbers hold."""
    parts = keep(words.select(column).repartitionByRange(F.col(column)).select(column, F.spark_partition_id().alias("_p")), "words")
    counts = dict(map(tuple, parts.groupBy("_p").count().collect()))
    first, total = {}, 0
    for p in sorted(counts):
        first[p], total = total, total + counts[p]
    start = parts.sparkSession.createDataFrame(list(first.items()), "_p int, _first long")
    n = F.row_number().over(Window.partitionBy("_p").orderBy(column)) - 1
    return parts.join(F.broadcast(start), "_p").select(column, (F.col("_first") + n).cast("int").alias("id"))


def average(tables: list[DataFrame]) -> DataFrame:
    """The mean vector of each word over several tables of one dimension."""
    rows = reduce(DataFrame.unionByName, [t.select("word", "vec") for t in tables]).select("word", F.posexplode("vec").alias("k", "x"))
    mean = rows.groupBy("word", "k").agg(F.avg("x").alias("x")).groupBy("word").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("_v"))
    return mean.select("word", F.transform("_v", lambda v: v["x"]).alias("vec"))
