"""Registered queries on limited scans, tagged measures, suggestions and evaluation sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.operators import context, evalset, ngrams, suggest, tokens, vectors
from lexweave.plans.queries import _C, _FORMS, _LINES, _MATCH, _PARTS, _POS2, _TAG, F1, F2, F3, G1, G2, SQL, _collocations, _components, _lines, _tagged, docs, frequencies, gram_sql, grams, query, table
from lexweave.sources.scratch import keep

# ---- n-grams

@query("ngram_lookup_ordered", f"with {F2}, {gram_sql(2, 'benchmark', 'item_id', name='c')}, o as (select c.*, doc_id * 100000 + i as ordinal from c) select ordinal, o.w1, o.w2, coalesce(freq, 0) as freq from o left join f2 using (w1, w2)")
def ngram_lookup_ordered(spark, sf_dir):
    """R5 in the order of the input, which a column has."""
    wanted = grams(spark, sf_dir, 2, "benchmark", "item_id").select((F.col("doc_id") * 100_000 + F.col("pos") + 1).alias("ordinal"), "w1", "w2")
    return ngrams.lookup(wanted, frequencies(spark, sf_dir, 2), 2, "ordinal").select("ordinal", "w1", "w2", "freq")


@query("attested_doc_freq", f"with {G2}, {_C.format(0, 'benchmark')}, {_C.format(1, 'conversations')} select w1, w2, count(*) as ngram_freq, count(distinct doc_id) as doc_freq from g2 where w1 in (select word from c0) and w2 in (select word from c1) group by all")
def attested_doc_freq(spark, sf_dir):
    """R9 with its filters."""
    return ngrams.attested_frequencies(grams(spark, sf_dir, 2), *_components(spark, sf_dir))


def _star_lookup(n: int) -> str:
    low = ", ".join(f"lower(w{k}) as w{k}" for k in range(1, n + 1))
    return f"with {gram_sql(n, words=_FORMS)}, x as (select {low} from g{n}), {gram_sql(n, 'benchmark', 'item_id', name='c')} select x.*, count(*) as freq from x semi join c using ({', '.join(ngrams.names(n))}) group by all"


@query("star_bigram_lookup", _star_lookup(2))
def star_bigram_lookup(spark, sf_dir):
    """R3 with candidates."""
    return ngrams.lemma_bigrams(ngrams.star(_tagged(spark, sf_dir)), grams(spark, sf_dir, 2, "benchmark", "item_id"))


@query("star_trigram_lookup", _star_lookup(3))
def star_trigram_lookup(spark, sf_dir):
    """R4 with candidates."""
    return ngrams.lemma_trigrams(ngrams.star(_tagged(spark, sf_dir)), grams(spark, sf_dir, 3, "benchmark", "item_id"))


@query("attest_any_size", f"with {G2}, {gram_sql(3)}, {_C.format(0, 'benchmark')}, {_C.format(1, 'conversations')} select distinct 2 as size, w1, w2, null as w3 from g2 where w1 in (select word from c0) and w2 in (select word from c1) union all select distinct 3, w1, w2, w3 from g3 where w1 in (select word from c0) and w2 in (select word from c1) and w3 in (select word from c0)")
def attest_any_size(spark, sf_dir):
    """One to four components, of which one and four give nothing."""
    one, two = _components(spark, sf_dir)
    out = None
    for parts in ([one], [one, two], [one, two, one], [one, two, one, two]):
        n = len(parts)
        found = ngrams.attested(grams(spark, sf_dir, min(n, 3)), *parts)
        rows = found.select(F.lit(n).alias("size"), *((F.col(w) if w in found.columns else F.lit(None).cast("string")).alias(w) for w in ngrams.names(3)))
        out = rows if out is None else out.unionByName(rows)
    return out


_MORPH = "case {0} when 'V' then 'VerbForm=Fin' when 'N' then 'Animacy=Inan' when 'A' then 'Degree=Pos' else '_' end"
_quoted = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
_CLEAN = f"n1 not in ({_quoted(ngrams.NO_WORDS)}) and n2 not in ({_quoted(ngrams.NO_WORDS)})"
_MORPH2 = f"((pos1 = 'V' and pos2 in ('V', 'N')) or (pos2 = 'N' and pos1 in ('N', 'A'))) and {_CLEAN}"
_MORPH3 = f"pos3 = 'N' and pos2 not in ('V', 'N', 'A') and n2 not in ({_quoted(ngrams.NO_CONNECTORS)}) and pos1 in ('V', 'N')"


def _limited_sql(n: int, wanted: str, scanned: int) -> str:
    words = ", ".join(f"w{k}" for k in range(1, n + 1))
    cols = ", ".join(f"w{k} as n{k}, lower(w{k}) as l{k}, {_TAG.format(f'lower(w{k})')} as pos{k}" for k in range(1, n + 1))
    ties = ", ".join(f"{c}{k}" for c in ("n", "l", "pos") for k in range(1, n + 1))
    return f"""with {gram_sql(n, words=_FORMS)}, f as (select {words}, count(*) as raw_frequency from g{n} group by all), t as (select raw_frequency, {cols} from f where raw_frequency >= (select min(raw_frequency) from (select raw_frequency from f order by raw_frequency desc limit {scanned})))
  select raw_frequency, {ties} from t where {wanted} order by raw_frequency desc, {ties} limit 300"""


def _limited(spark, sf_dir, n, wanted, **settings):
    tag = F.col("tag")
    morph = F.when(tag == "V", "VerbForm=Fin").when(tag == "N", "Animacy=Inan").when(tag == "A", "Degree=Pos").otherwise("_")
    top = ngrams.top_bigrams if n == 2 else ngrams.top_trigrams
    found = top(ngrams.star(_tagged(spark, sf_dir).withColumn("morph", morph)), wanted, **settings)
    return found.select("raw_frequency", *(f"{c}{k}" for c in ("n", "l", "pos") for k in range(1, n + 1)))


SQL["top_bigrams_limited"] = _limited_sql(2, _POS2, 10_000)


@query("top_bigrams_by_morphology", _limited_sql(2, _MORPH2, 10_000))
def top_bigrams_by_morphology(spark, sf_dir):
    """R12."""
    return _limited(spark, sf_dir, 2, ngrams.by_morphology(2))


@query("top_trigrams_by_morphology", _limited_sql(3, _MORPH3, 20_000))
def top_trigrams_by_morphology(spark, sf_dir):
    """R14."""
    return _limited(spark, sf_dir, 3, ngrams.by_morphology(3))


@query("top_trigrams_limited", _limited_sql(3, "pos1 in ('N', 'V') and pos2 = 'S' and pos3 = 'N'", 20_000))
def top_trigrams_limited(spark, sf_dir):
    """R15 with its own limits."""
    return _limited(spark, sf_dir, 3, ngrams.by_pos(3, "V", "N", "A", "S"))


@query("tagged_measures", f"""with {F1}, {F2}, t as (select w1, freq, {_TAG.format('w1')} as t from f1), b as (select w1 || ' ' || w2 || '/' || {_TAG.format('w1')} || ' ' || {_TAG.format('w2')} as ngram, freq, w1, w2 from f2),
  p as (select b.ngram, cast(b.freq as double) as c, cast(coalesce(x.freq, 1) as double) as a, case when y.freq is null then 1e-12 else cast(y.freq as double) end as z from b left join (select * from t where freq > 1) x on x.w1 = b.w1 left join (select * from t where freq > 2) y on y.w1 = b.w2)
  select ngram, round(14 + log2(2 * c / (a + z)), 6) as log_dice, round(log10(100000.0 * c / (a * z)), 6) as pmi, round((c - a * z / 100000.0) / sqrt(c), 6) as t_score from p""")
def tagged_measures(spark, sf_dir):
    """M5 on tagged n-grams in the form of S8, of which the last of repeated lines counts; rare patterns are missing."""
    tag, one, two = tokens.suffix_tag, frequencies(spark, sf_dir, 1), frequencies(spark, sf_dir, 2)
    lines = lambda rows, name: rows.select(name.alias("ngram"), F.explode(F.array(F.struct(F.lit("1").alias("f"), F.lit(0).alias("l")), F.struct(F.col("freq").cast("string").alias("f"), F.lit(1).alias("l")))).alias("x")).select("ngram", F.col("x.f").alias("freq"), F.col("x.l").cast("long").alias("line"))
    pairs = lines(two, F.concat_ws("/", F.concat_ws(" ", "w1", "w2"), F.concat_ws(" ", tag(F.col("w1")), tag(F.col("w2")))))
    words = lambda least: ngrams.read_tagged(lines(one.where(F.col("freq") > least), F.concat_ws("/", "w1", tag(F.col("w1")))))
    found = ngrams.measure_tagged(ngrams.read_tagged(pairs), words(1), words(2), 100_000)
    return found.select("ngram", *(F.round(c, 6).alias(c) for c in ("log_dice", "pmi", "t_score")))


# ---- masks and suggestions

_TRIPLES = "c as (select distinct p_name || '_N ' || lower(p_type) || '_A ' || p_size as colloc from part), t as (select colloc, string_split(colloc, ' ') as t from c)"
_MASKS3 = "[{'l': 1, 'm': [0, 1, 1]}, {'l': 1, 'm': [1, 0, 1]}, {'l': 1, 'm': [1, 1, 0]}, {'l': 2, 'm': [0, 0, 1]}, {'l': 2, 'm': [0, 1, 0]}, {'l': 2, 'm': [1, 0, 0]}, {'l': 3, 'm': [0, 0, 0]}]"


@query("mask_positions_tagged", f"with c as (select distinct replace(p_name, ' ', '-') || '_N ' || lower(p_type) || '_A ' || p_size as colloc from part), t as (select colloc, string_split(colloc, ' ') as t, unnest({_MASKS3}) as x from c) select colloc, x.l as level, array_to_string(list_transform(t, lambda y, i: case when x.m[i] = 1 then y when contains(y, '_') then '<mask>_' || split_part(y, '_', 2) else '<mask>_n' end), ' ') as masked from t")
def mask_positions_tagged(spark, sf_dir):
    """F1, F2 for three words, two of them tagged."""
    three = table(spark, sf_dir, "part").select(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("_N "), F.lower("p_type"), F.lit("_A "), F.col("p_size")).alias("colloc")).distinct()
    rows = suggest.with_masks(three)
    return rows.select("colloc", "level", suggest.masked_text(F.col("tokens"), F.col("mask")).alias("masked"))


SQL["mask_positions_tagged"] = SQL["mask_positions_tagged"].replace("x.l as level", "cast(x.l as int) as level")


@query("vocabulary", f"with {_C.format(0, 'benchmark')}, {_C.format(1, 'conversations')} select word, word in (select word from c1) as known from c0")
def vocabulary(spark, sf_dir):
    """Which words of the benchmark the conversations have."""
    one, two = _components(spark, sf_dir)
    return vectors.in_vocabulary(one, two)


#: Vectors as tagged words, collocations of a vector and the next one or two, and the 20 neighbours of every key.
_SUGGEST = """v as (select vec_id as i, 'w' || vec_id || '_l' || label as word, '_l' || label as tag, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
  u as (select i, word, tag, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) as u from v),
  c as (select [a.word, b.word] as t from v a join v b on b.i = a.i + 1 union all select [a.word, b.word, d.word] from v a join v b on b.i = a.i + 1 join v d on d.i = a.i + 2),
  m0 as (select t, unnest(case when len(t) = 2 then [{'l': 1, 'm': [0, 1]}, {'l': 1, 'm': [1, 0]}, {'l': 2, 'm': [0, 0]}, {'l': 3, 'm': [0, 0]}] else """ + _MASKS3 + """ end) as x from c),
  m as (select array_to_string(t, ' ') as colloc, len(t) as n, x.l as level, x.m as mask, t, list_filter(t, lambda y, i: x.m[i] = 0) as open from m0),
  k as (select distinct array_to_string(open, ' ') as key, open from m), ko as (select key, unnest(open) as word from k),
  kv as (select key, list(u.u) as us, list(word) as own from ko join u using (word) group by key),
  ks as (select key, own, list_reduce(us, lambda a, b: list_transform(list_zip(a, b), lambda p: p[1] + p[2])) as s from kv),
  s as (select key, word, tag, round(list_cosine_similarity(s, u), 12) as score from ks join u on not list_contains(own, word)),
  near as (select * from (select *, row_number() over (partition by key order by score desc, word) as rank from s) where rank <= 20),
  f as (select m.*, array_to_string(open, ' ') as key from m)"""
# A candidate of each position, fixed or open; positions are joined by their mask alone.
_CAND = """ca as (select colloc, n, level, mask, t, key, unnest(range(1, n + 1)) as pos from f),
  cand as (select colloc, n, level, mask, pos, t[pos] as word, 0 as rank, 0.0 as score from ca where mask[pos] = 1
    union all select colloc, n, level, mask, pos, near.word, near.rank, near.score from (select *, regexp_extract(t[pos], '_.*') as tag from ca where mask[pos] = 0) join near using (key, tag))"""
_JOINED = """select a.colloc, a.n, a.level, a.mask, a.word as a, b.word as b, null as d, a.rank + b.rank as rank, a.score + b.score as score from (select * from cand where pos = 1) a join (select * from cand where pos = 2) b using (colloc, level, mask) where a.n = 2
    union all select a.colloc, a.n, a.level, a.mask, a.word, b.word, d.word, a.rank + b.rank + d.rank, a.score + b.score + d.score from (select * from cand where pos = 1) a join (select * from cand where pos = 2) b using (colloc, level, mask) join (select * from cand where pos = 3) d using (colloc, level, mask)"""
_FOUND = f"{_SUGGEST}, {_CAND}, r as ({_JOINED})"


def _tagged_vectors(spark, sf_dir):
    word = F.concat_ws("_", F.concat(F.lit("w"), "vec_id"), F.concat(F.lit("l"), "label"))
    return table(spark, sf_dir, "embeddings").select("vec_id", word.alias("word"), F.col("embedding").alias("vec"))


def _vector_collocations(v):
    """Each vector with the next one, and with the next two."""
    after = lambda k: v.select(F.col("word").alias(f"w{k}"), (F.col("vec_id") - k).alias("vec_id"))
    two = v.join(after(1), "vec_id")
    three = two.join(after(2), "vec_id")
    return two.select(F.concat_ws(" ", "word", "w1").alias("colloc")).unionByName(three.select(F.concat_ws(" ", "word", "w1", "w2").alias("colloc")))


@query("static_suggest_all", f"with {_FOUND} select colloc, cast(level as int) as level, concat_ws(' ', a, b, d) as suggested, rank, round(score, 6) as score from r")
def static_suggest_all(spark, sf_dir):
    """E10 at all levels, for two and three words: 20 neighbours of the replaced words taken together."""
    v = _tagged_vectors(spark, sf_dir)
    masked = suggest.with_masks(_vector_collocations(v))
    found = suggest.propose(masked, suggest.neighbours_of(masked, v, 20), 20)
    return found.select("colloc", "level", F.array_join("words", " ").alias("suggested"), "rank", F.round("score", 6).alias("score"))


_TOP = 5
_SHARE = "{0} as (select * from (select *, freq / cast(sum(freq) over (partition by {1}) as double) as p, row_number() over (partition by {1} order by freq desc, w) as z from ({2})) where z <= {3})"
_CONTEXTS = ", ".join((F1, F2, F3,
    _SHARE.format("xb", "l, r", "select w1 as l, w3 as r, w2 as w, freq from f3", _TOP), _SHARE.format("xl", "l", "select w1 as l, w2 as w, freq from f2", _TOP),
    _SHARE.format("xr", "r", "select w2 as r, w1 as w, freq from f2", _TOP), f"xa as (select w1 as w, freq / cast((select sum(freq) from f1) as double) as p from f1 order by freq desc, w limit {_TOP})"))
_GAPS = "gx as (select text, string_split(text, ' ') as t, unnest(range(1, len(string_split(text, ' ')) + 1)) as pos from mx), gy as (select text, pos, row_number() over (partition by text order by pos) - 1 as k, case when t[pos - 1] <> '<mask>' then t[pos - 1] end as l, case when t[pos + 1] <> '<mask>' then t[pos + 1] end as r from gx where t[pos] = '<mask>')"
_GUESSED = f"""{_GAPS}, gp as (select text, k, w, p from gy join xb using (l, r) union all select text, k, w, 0.4 * p from gy join xl using (l) union all select text, k, w, 0.4 * p from gy join xr using (r) union all select text, k, w, 0.4 * 0.4 * p from gy, xa),
  gm as (select text, k, w, max(p) as p from gp group by all), gu as (select * from (select *, row_number() over (partition by text, k order by p desc, w) - 1 as r from gm) where r < {_TOP})"""
_MASKED_WORDS = f"""{gram_sql(2, 'benchmark', 'item_id', name='q2')}, {gram_sql(3, 'benchmark', 'item_id', name='q3')}, c as (select distinct [w1, w2] as t from q2 union all select distinct [w1, w2, w3] from q3),
  m0 as (select t, unnest(case when len(t) = 2 then [{{'l': 1, 'm': [0, 1]}}, {{'l': 1, 'm': [1, 0]}}, {{'l': 2, 'm': [0, 0]}}, {{'l': 3, 'm': [0, 0]}}] else {_MASKS3} end) as x from c),
  m as (select array_to_string(t, ' ') as colloc, len(t) as n, x.l as level, x.m as mask, t, array_to_string(list_transform(t, lambda y, i: case when x.m[i] = 0 then '<mask>' else y end), ' ') as text from m0), mx as (select distinct text from m)"""
_POSITIONED = """ca as (select colloc, n, level, mask, t, text, unnest(range(1, n + 1)) as pos from m), cb as (select *, len(list_filter(mask[1:pos - 1], lambda y: y = 0)) as k from ca),
  cand as (select colloc, n, level, mask, pos, t[pos] as word, 0 as rank, 0.0 as score from cb where mask[pos] = 1 union all select colloc, n, level, mask, pos, gu.w, gu.r, 0.0 from cb join gu using (text, k) where mask[pos] = 0)"""
_DYNAMIC = f"{_CONTEXTS}, {_MASKED_WORDS}, {_GUESSED}, {_POSITIONED}, r as ({_JOINED})"


def _contexts(spark, sf_dir, topn: int = _TOP):
    return context.Contexts.learn(*_orders(spark, sf_dir), topn)


def _orders(spark, sf_dir) -> list:
    """The documents' words, pairs and triples with their counts, from one pass over the texts."""
    of = ngrams.frequencies_to(docs(spark, sf_dir), tokens.words(F.col("text")), 3)
    return [keep(of[1], "words"), keep(of[2], "pairs"), of[3]]


def _passage_collocations(spark, sf_dir):
    """The benchmark's two and three words in a row."""
    two, three = (grams(spark, sf_dir, n, "benchmark", "item_id").select(F.concat_ws(" ", *ngrams.names(n)).alias("colloc")) for n in (2, 3))
    return two.unionByName(three).distinct()


@query("masked_guesses", f"with {_CONTEXTS}, {_MASKED_WORDS}, {_GUESSED} select text, cast(k as int) as k, w, r, round(p, 6) as p from gu")
def masked_guesses(spark, sf_dir):
    """The likeliest words of each mask, from the documents' words beside it."""
    masked = suggest.with_masks(_passage_collocations(spark, sf_dir))
    texts = masked.select(suggest.masked_text(F.col("tokens"), F.col("mask"), tags=False).alias("text"))
    return _contexts(spark, sf_dir).guesses(texts).withColumn("p", F.round("p", 6))


@query("dynamic_suggest", f"with {_DYNAMIC} select colloc, cast(level as int) as level, concat_ws(' ', a, b, d) as suggested, rank from r")
def dynamic_suggest(spark, sf_dir):
    """Masks of the benchmark's word pairs and triples, filled from what the documents have beside them."""
    masked = suggest.with_masks(_passage_collocations(spark, sf_dir))
    texts = masked.select(suggest.masked_text(F.col("tokens"), F.col("mask"), tags=False).alias("text"))
    found = suggest.propose_from(masked, _contexts(spark, sf_dir).guesses(texts), _TOP)
    return found.select("colloc", "level", F.array_join("words", " ").alias("suggested"), "rank")


@query("dynamic_replacements", f"""with {_DYNAMIC}
  select colloc as original, a || ' ' || b as suggested, rank, cast(level as int) as "numReplaced", freq as ngram_freq from r join f2 on w1 = a and w2 = b where n = 2
  union all select colloc, a || ' ' || b || ' ' || d, rank, cast(level as int), freq from r join f3 on w1 = a and w2 = b and w3 = d where n = 3""")
def dynamic_replacements(spark, sf_dir):
    """F4 with E11: of these, the ones that the documents attest."""
    orders = _orders(spark, sf_dir)
    stats = {n: orders[n - 1].withColumns({"pmi": F.lit(None).cast("double"), "t_score": F.lit(None).cast("double")}) for n in (2, 3)}
    found = suggest.collocation_replacements(_passage_collocations(spark, sf_dir), stats, guess=context.Contexts.learn(*orders, _TOP).guesses, topn=_TOP, include=("ngram_freq",))
    return found.drop("cosScore")


@query("subword_vectors", """with w as (select vec_id, '<w' || vec_id || '>' as p, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings), n as (select unnest([3, 4, 5, 6]) as n),
  g as (select distinct vec_id, p, case when length(p) < n then p else substr(p, i, n) end as g from (select vec_id, p, n, unnest(range(1, greatest(length(p) - n + 1, 1) + 1)) as i from w, n)),
  k as (select g, avg(e[1]) as a, avg(e[2]) as b from g join w using (vec_id) where vec_id % 2 = 0 group by g) select 'w' || vec_id as word, round(avg(a), 6) as a, round(avg(b), 6) as b from g join k using (g) group by vec_id""")
def subword_vectors(spark, sf_dir):
    """Vectors of all words from those of every other, the first two numbers of each."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("w"), "vec_id").alias("word"), F.col("embedding").alias("vec"))
    found = vectors.subword_vectors(v.where("vec_id % 2 = 0"), v)
    return found.select("word", F.round(F.get("vec", F.lit(0)), 6).alias("a"), F.round(F.get("vec", F.lit(1)), 6).alias("b"))


# Combinations that are attested: a vector's word with each of the next 200, and three in a row at any distance up to 40.
_FACTS = """p as (select 'w' || a.vec_id as w1, 'w' || b.vec_id as w2, (a.vec_id + b.vec_id) % 7 as freq, round(a.vec_id / 3.0, 4) as pmi, round(b.vec_id / 7.0, 4) as t_score from embeddings a join embeddings b on b.vec_id between a.vec_id + 1 and a.vec_id + 200),
  q as (select w1, 'w' || b as w2, 'w' || (b + y) as w3, (b + y) % 5 as freq from (select 'w' || vec_id as w1, vec_id + unnest(range(1, 41)) as b from embeddings), (select unnest(range(1, 41)) as y))"""


def _facts(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("a"))
    name = lambda c: F.concat(F.lit("w"), c)
    two = e.withColumn("b", F.explode(F.sequence(F.col("a") + 1, F.col("a") + 200))).join(e.withColumnRenamed("a", "b"), "b", "left_semi")
    two = two.select(name(F.col("a")).alias("w1"), name(F.col("b")).alias("w2"), ((F.col("a") + F.col("b")) % 7).alias("freq"), F.round(F.col("a") / 3.0, 4).alias("pmi"), F.round(F.col("b") / 7.0, 4).alias("t_score"))
    three = e.withColumn("b", F.explode(F.sequence(F.col("a") + 1, F.col("a") + 40))).withColumn("d", F.explode(F.sequence(F.col("b") + 1, F.col("b") + 40)))
    three = three.select(*(name(F.col(c)).alias(w) for c, w in (("a", "w1"), ("b", "w2"), ("d", "w3"))), (F.col("d") % 5).alias("freq"), F.lit(1.0).alias("pmi"), F.lit(2.0).alias("t_score"))
    return two, three


@query("replacements", f"""with {_FOUND.replace("rank <= 20", "rank <= 100")}, {_FACTS}, x as (select *, split_part(a, '_', 1) as w1, split_part(b, '_', 1) as w2, split_part(d, '_', 1) as w3 from r)
  select colloc as original, concat_ws(' ', a, b, d) as suggested, rank, round(score, 6) as "cosScore", cast(level as int) as "numReplaced", pmi, t_score, freq as ngram_freq from x join p using (w1, w2) where n = 2 and freq > 0
  union all select colloc, concat_ws(' ', a, b, d), rank, round(score, 6), cast(level as int), 1.0, 2.0, q.freq from x join q using (w1, w2, w3) where n = 3 and q.freq > 0""")
def replacements(spark, sf_dir):
    """From collocations to attested, scored replacements in one call."""
    v, (two, three) = _tagged_vectors(spark, sf_dir), _facts(spark, sf_dir)
    found = suggest.collocation_replacements(_vector_collocations(v), {2: two, 3: three}, v, topn=100)
    return found.withColumn("cosScore", F.round("cosScore", 6))


_PLAIN = _SUGGEST.replace("'w' || vec_id || '_l' || label as word, '_l' || label as tag", "'w' || vec_id as word, '' as tag").replace("rank <= 20", "rank <= 10")
_SEARCH = f"""{_PLAIN}, {_FACTS}, cand as (select colloc, n, level, array_to_string(mask, '') as mask, pos, case when mask[pos] = 0 then word else t[pos] end as word, case when mask[pos] = 0 then rank else 0 end as index, greatest(case when mask[pos] = 0 then score else 1.0 end, 1e-12) as score
    from (select f.*, unnest(range(1, n + 1)) as pos from f) g left join near on mask[pos] = 0 and near.key = g.key where mask[pos] = 1 or word is not null),
  x as (select a.colloc, a.level, concat_ws(' ', w1, w2) as suggested, freq as ngram_freq, freq + 1 as doc_freq, a.index + b.index as sum_of_rank, ln(a.score) + ln(b.score) as log_rank from cand a join cand b on a.colloc = b.colloc and a.level = b.level and a.mask = b.mask and a.n = 2 and a.pos = 1 and b.pos = 2 join p on w1 = a.word and w2 = b.word
    union all select a.colloc, a.level, concat_ws(' ', w1, w2, w3), freq, freq + 1, a.index + b.index + d.index, ln(a.score) + ln(b.score) + ln(d.score) from cand a join cand b on a.colloc = b.colloc and a.level = b.level and a.mask = b.mask and a.n = 3 and a.pos = 1 and b.pos = 2
    join cand d on a.colloc = d.colloc and a.level = d.level and a.mask = d.mask and d.pos = 3 join q on w1 = a.word and w2 = b.word and w3 = d.word),
  y as (select colloc, level, suggested, ngram_freq, doc_freq, min(sum_of_rank) as sum_of_rank, min(log_rank) as log_rank from x group by all), z as (select *, row_number() over (partition by colloc, suggested order by level) as k from y)"""


@query("search_replacements", f"with {_SEARCH} select colloc, suggested, ngram_freq, doc_freq, sum_of_rank, round(log_rank, 6) as log_rank, cast(level as int) as num_replacements from z where k = 1")
def search_replacements(spark, sf_dir):
    """F6, with F5 or F7 at each level."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("w"), "vec_id").alias("word"), F.col("embedding").alias("vec"))
    facts = [t.select(*ngrams.names(n), F.col("freq").alias("ngram_freq"), (F.col("freq") + 1).alias("doc_freq")) for n, t in zip((2, 3), _facts(spark, sf_dir), strict=True)]
    found = suggest.search_replacements(_vector_collocations(v), v, {2: facts[0], 3: facts[1]})
    return found.withColumn("log_rank", F.round("log_rank", 6))


@query("ranked_candidates", f"""with {_PLAIN}, {_FACTS}, one as (select distinct colloc, t from f where n = 2), o as (select colloc, unnest([1, 2]) as pos, unnest(t) as token from one),
  cand as (select colloc, pos, token as word, 0 as index, 1.0 as score from o union all select colloc, pos, word, rank, score from o join near on near.key = o.token)
  select a.colloc, w1, w2, freq as ngram_freq, freq + 1 as doc_freq, a.index + b.index as sum_of_rank, round(ln(greatest(a.score, 1e-12)) + ln(greatest(b.score, 1e-12)), 6) as log_rank from cand a join cand b on a.colloc = b.colloc and a.pos = 1 and b.pos = 2 join p on w1 = a.word and w2 = b.word""")
def ranked_candidates(spark, sf_dir):
    """The original and ten neighbours at each of two positions."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("w"), "vec_id").alias("word"), F.col("embedding").alias("vec"))
    colloc = _vector_collocations(v).where(F.size(F.split("colloc", " ")) == 2)
    near = vectors.nearest_each(v, colloc.select(F.explode(F.split("colloc", " ")).alias("word")), 10)
    facts = _facts(spark, sf_dir)[0].select("w1", "w2", F.col("freq").alias("ngram_freq"), (F.col("freq") + 1).alias("doc_freq"))
    return suggest.ranked(suggest.original_candidates(colloc, near), facts, 2).withColumn("log_rank", F.round("log_rank", 6))


# ---- evaluation sets

@query("originals", f"with {_LINES} select lower(left(text, 12)) as lemma_text, arg_max(text, doc_id * 10000 + para) as original from l group by 1")
def originals(spark, sf_dir):
    """Lines that start alike, whatever the case, are one."""
    rows = _lines(spark, sf_dir).select(F.expr("left(text, 12)").alias("lemma_text"), F.col("text").alias("original"), (F.col("doc_id") * 10_000 + F.col("para")).alias("ordinal"))
    return evalset.originals(rows)


_SCORES = "v as (select (select count(*) from {1}) + (select count(*) from {0}) as v) select b.w1, b.w2, b.freq, round((b.freq - 5) * v / cast(x.c as double) / y.c, 6) as score from {0} b join {1} x on x.w1 = b.w1 join {1} y on y.w1 = b.w2, v where b.freq >= 5 and (b.freq - 5) * v / cast(x.c as double) / y.c > 10"
_BRIDGED = f"{G1}, o as (select w1, count(*) as c from g1 group by 1), n as (select w1, lead(w1) over (partition by doc_id order by i) as w2 from g1 where length(w1) > 2), b as (select w1, w2, count(*) as freq from n where w2 is not null group by all)"


@query("phrases_bridged", f"with {_BRIDGED}, {_SCORES.format('b', 'o')}")
def phrases_bridged(spark, sf_dir):
    """Connectors (words of two letters or fewer, by their tag) are bridged."""
    rows = tokens.tokens(docs(spark, sf_dir))
    # A tagged word is a text of its own here, so none is put together from all of a document's words.
    joined = tokens.connectors(tokens.tag(rows).select(F.lower(F.concat_ws("_", "lemma", "tag")).alias("text"))).select(F.regexp_replace("word", "_s$", "").alias("word"))
    return evalset.phrase_scores(rows, connectors=joined).withColumn("score", F.round("score", 6))


_MERGED = f"""{F1}, {F2}, v0 as (select (select count(*) from f1) + (select count(*) from f2) as v), ph as (select f2.w1, f2.w2 from f2 join f1 a on a.w1 = f2.w1 join f1 b on b.w1 = f2.w2, v0 where f2.freq >= 5 and (f2.freq - 5) * v / cast(a.freq as double) / b.freq > 10),
  e as (select doc_id, i, w1, lead(w1) over (partition by doc_id order by i) as w2 from g1), h as (select e.*, ph.w1 is not null as hit from e left join ph on ph.w1 = e.w1 and ph.w2 = e.w2), s as (select *, (not coalesce(lag(hit) over (partition by doc_id order by i), false))::int as s from h),
  r as (select *, sum(s) over (partition by doc_id order by i) as run from s), n as (select *, row_number() over (partition by doc_id, run order by i) as n from r), mt as (select doc_id, i, case when hit then w1 || ' ' || w2 else w1 end as w1 from n where n % 2 = 1)"""


@query("merged_phrases", f"with {_MERGED} select doc_id, cast(i - 1 as int) as pos, w1 as word from mt")
def merged_phrases(spark, sf_dir):
    """G4, between the passes."""
    rows = _merged(spark, sf_dir).select("doc_id", F.explode(F.arrays_zip("positions", "words")).alias("x"))
    return rows.select("doc_id", F.col("x.positions").alias("pos"), F.col("x.words").alias("word"))


def _merged(spark, sf_dir):
    texts, words = docs(spark, sf_dir), tokens.words(F.col("text"))
    return evalset.merge_texts(texts, words, evalset.text_phrase_scores(texts, words))


@query("phrases_second_pass", f"with {_MERGED}, o2 as (select w1, count(*) as c from mt group by 1), n2 as (select w1, lead(w1) over (partition by doc_id order by i) as w2 from mt), b2 as (select w1, w2, count(*) as freq from n2 where w2 is not null group by all), {_SCORES.format('b2', 'o2')}")
def phrases_second_pass(spark, sf_dir):
    """G4, the second pass, over merged tokens."""
    merged = keep(_merged(spark, sf_dir).select("words"), "merged")
    return evalset.text_phrase_scores(merged, F.col("words")).withColumn("score", F.round("score", 6))


_SENTENCE_MATCH = _MATCH.replace(gram_sql(1), gram_sql(1, "sl")).replace("with ", "")
_ATTESTED = "select distinct w1 || ' ' || w2 as ngram from (" + gram_sql(2, "conversations", "conv_id * 100 + turn", name="q2").removeprefix("q2 as (")[:-1] + ")"
_GUARDED = f"""{_LINES}, sl as (select doc_id * 1000 + para as doc_id, text from l), {_SENTENCE_MATCH}, a2 as ({_ATTESTED}), og as (select doc_id, replace(array_to_string(regexp_extract_all(text, '\\p{{L}}+'), ' '), ' la ', ' А. la ') as original from sl),
  fo as (select k.*, string_split(original, ' ') as ow, pos as p0, len(string_split(template, '_')) as tl from k anti join a2 using (ngram) join og using (doc_id)),
  st as (select *, p0 + len(list_filter(ow[1:p0], lambda w: regexp_matches(w, '^[А-яЁё]\\.'))) as start from fo), gu as (select * from st where len(list_filter(ow[start + 1:start + tl], lambda w: regexp_matches(w, '^[А-яЁё]\\.'))) = 0)"""

def _sentences(spark, sf_dir):
    """Lines as sentences, their words as tokens, and originals in which every la has an initial before it."""
    rows = _lines(spark, sf_dir).select((F.col("doc_id") * 1000 + F.col("para")).alias("doc_id"), "text")
    words = F.array_join(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)), " ")
    return evalset.text_matches(rows, tokens.words(F.col("text")), tokens.suffix_tag).drop("text"), rows.select("doc_id", F.replace(words, F.lit(" la "), F.lit(" А. la ")).alias("original"))


def _said(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"), "text")
    return ngrams.array_occurrences(turns, tokens.words(F.col("text")), 2).select(F.concat_ws(" ", "w1", "w2").alias("ngram")).distinct()


@query("name_guarded", f"with {_GUARDED} select doc_id, pos, template, ngram, cast(start as int) as start from gu")
def name_guarded(spark, sf_dir):
    """G7, after the anti join of G5."""
    matches, original = _sentences(spark, sf_dir)
    found = matches.join(_said(spark, sf_dir), "ngram", "left_anti").join(original, "doc_id")
    return evalset.name_guard(found, F.col("original"), F.col("pos"), F.size(F.split("template", "_"))).select("doc_id", "pos", "template", "ngram", "start")


@query("unattested_contexts", f"with {_GUARDED}, ba as (select *, count(*) over (partition by template, ngram) as n from gu) select doc_id, pos, template, ngram, array_to_string(ow[1:start], ' ') || ' <error> ' || array_to_string(ow[start + 1:start + tl], ' ') || ' </error> ' || array_to_string(ow[start + tl + 1:], ' ') as context from ba where n between 2 and 3")
def unattested_contexts(spark, sf_dir):
    """G5, G7, G8, D18."""
    matches, original = _sentences(spark, sf_dir)
    return evalset.unattested_contexts(matches, _said(spark, sf_dir), original)


@query("synonym_variants_trigrams", "with w as (select distinct split_part(p_name, ' ', 1) as w1, split_part(p_name, ' ', 2) as w2, lower(p_type) as w3 from part), s0 as (select distinct w1 as w from w union select distinct w3 from w), s as (select a.w as word, b.w as synonym from s0 a join s0 b on length(a.w) = length(b.w)) select s.synonym as w1, w2, w3, w1 as was, 1 as replaced from w join s on s.word = w1 and s.synonym <> w1 union all select w1, w2, s.synonym, w3, 3 from w join s on s.word = w3 and s.synonym <> w3")
def synonym_variants_trigrams(spark, sf_dir):
    """The first and the last of three words by words as long."""
    t = F.split("p_name", " ")
    w = table(spark, sf_dir, "part").select(t[0].alias("w1"), t[1].alias("w2"), F.lower("p_type").alias("w3")).distinct()
    one = w.select(F.explode(F.array("w1", "w3")).alias("word")).distinct().withColumn("n", F.length("word"))
    return evalset.synonym_variants(w, one.join(one.withColumnRenamed("word", "synonym"), "n").select("word", "synonym"), 3)
