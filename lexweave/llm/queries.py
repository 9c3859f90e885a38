"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import bpe, exponion, itq, licenses, lm, oracles, quality, resampling, sharding, topk, warc
from lexweave.llm.linededup import WHITE, line_dedup
from lexweave.llm.ngramjoin import ngram_join
from lexweave.llm.packing import pack, pack_conversations
from lexweave.sources.files import read_wide


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return read_wide(spark, path) if name in ("documents", "pages") else spark.read.parquet(path)


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (null id: null)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), 40)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digest=True)


def op2_packing_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whole, of which the assistant's turns alone bear loss: at most three quarters of 4,096 tokens."""
    return pack_conversations(_table(spark, sf_dir, "conversations"), public_tokenizers.path("byte_bpe_50k.json"), digest=True)


def quality_weights(docs: DataFrame, labels: DataFrame):
    """The classifier's weights, from labelled rows outside the held-out fold."""
    return quality.fit(docs, labels.where(fold("doc_id", 4) != 2))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    weights = quality_weights(docs, _table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), quality.score(F.col("text"), weights).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))


def op4_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed", "exempt")


def op4_linededup_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4_linededup as the pipeline has it: a text without a line of its own stays whole."""
    return line_dedup(_table(spark, sf_dir, "documents"), keep_whole=True).select("doc_id", "text", "n_lines", "n_removed", "exempt")


_OP4_SQL = f"""
with lines as (select doc_id, source, text, line, trim(line, '{WHITE}') as bare, pos
  from (select doc_id, source, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents)),
wide as (select bare from lines where bare <> '' group by 1 having count(distinct source) >= 8),
marked as (select doc_id, text, line, bare, pos, wide.bare is not null as bad from lines left join wide using (bare)),
cut as (select doc_id, any_value(text) as text, coalesce(string_agg(line, chr(10) order by pos) filter (where not bad), '') as rest, count(*) as n_lines,
  count(*) filter (where bad) as n_bad, count(*) filter (where not bad and bare <> '') as n_own from marked group by doc_id),
judged as (select *, n_bad > 0 and n_own = 0 as exempt, n_bad > 0 and {{}} as cut from cut)
select documents.doc_id, case when cut then rest else documents.text end as text, coalesce(n_lines, 0) as n_lines, case when cut then n_bad else 0 end as n_removed, coalesce(exempt, false) as exempt
from documents left join judged using (doc_id)
"""
OP4_SQL, OP4_WHOLE_SQL = _OP4_SQL.format("true"), _OP4_SQL.format("n_own > 0")


def op8_ngramjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.revisit(_table(spark, sf_dir, "pages"))
    return read.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as body from pages),
d as (select page_id, octet_length(body) as n, sha1(body) as digest from p),
t as (select digest, max(page_id) as top from d where n >= 1000 group by 1 having count(*) > 1)
select page_id, n as payload_bytes, d.digest as payload_digest, case when n >= 1000 and page_id <> top then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and page_id <> top then top end as refers_to
from d left join t on d.digest = t.digest
"""


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.interpolated(_table(spark, sf_dir, "documents"), F.coalesce(fold("doc_id", 7) != 2, F.lit(True)))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP7_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 256) as bigint)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, v.vec_id, cast(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v on q.vec_id % 50 = 0 and q.vec_id <> v.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""


#: Pairs of ids with a link in table l (a < b) to the smallest id that each reaches.
_REACH = """
e as (select a, b from l union all select b, a from l),
r as (select a as d, a as m from e union select e.b, r.m from r join e on e.a = r.d),
c as (select d, min(m) as m from r group by d),
k as (select a, count(*) as n from e group by a)
"""
OP8_SQL = f"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') as w from documents),
t as (select doc_id, unnest(w) as w, generate_subscripts(w, 1) as i from w where len(w) >= 5),
q as (select doc_id, concat_ws(' ', w, lead(w) over o, lead(w, 2) over o, lead(w, 3) over o, lead(w, 4) over o) as g from t window o as (partition by doc_id order by i) qualify lead(w, 4) over o is not null),
s as (select distinct doc_id, g from q union all select doc_id, array_to_string(w, ' ') from w where len(w) between 1 and 4),
n as (select doc_id, count(*) as n from s group by 1),
p as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by all),
l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 5 * c >= 4 * (na.n + nb.n - c)),
{_REACH}
select documents.doc_id, coalesce(c.m, documents.doc_id) as class_id, coalesce(k.n, 0) as n_links, coalesce(n.n, 0) as n_shingles
from documents left join c on c.d = documents.doc_id left join k on k.a = documents.doc_id left join n on n.doc_id = documents.doc_id
"""
OP10_SQL = f"""
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where embedding is not null and label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select x.vec_id as a, y.vec_id as b from v x join v y on x.label = y.label and x.vec_id < y.vec_id where list_cosine_similarity(x.e, y.e) >= 0.93),
{_REACH}
select vec_id, coalesce(k.n, 0) as n_links, coalesce(c.m, vec_id) as component_id, coalesce(c.m, vec_id) = vec_id as kept
from embeddings left join c on c.d = vec_id left join k on k.a = vec_id
"""


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), output="digest")


def op10_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_dedup(_table(spark, sf_dir, "embeddings"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), licenses.labels().alias("labels"), licenses.score().alias("score"))


def op12_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exponion.compress(_table(spark, sf_dir, "embeddings"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_packing": op2_packing,
    "op3_warc": op3_warc,
    "op4_linededup": op4_linededup,
    "op5_lm": op5_lm,
    "op6_quality": op6_quality,
    "op7_topk": op7_topk,
    "op8_ngramjoin": op8_ngramjoin,
    "op9_bpe": op9_bpe,
    "op10_itq": op10_itq,
    "op11_licenses": op11_licenses,
    "op12_exponion": op12_exponion,
    "op13_resampling": op13_resampling,
    "op4_linededup_whole": op4_linededup_whole,
    "op2_packing_turns": op2_packing_turns,
}
ORACLE_SQL: dict[str, str] = {"op3_warc": OP3_SQL, "op4_linededup": OP4_SQL, "op4_linededup_whole": OP4_WHOLE_SQL, "op7_topk": OP7_SQL, "op8_ngramjoin": OP8_SQL, "op10_itq": OP10_SQL, **oracles.SQL}
