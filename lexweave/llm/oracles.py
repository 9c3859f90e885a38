"""DuckDB SQL of op11, op12 and op13."""

from __future__ import annotations

from lexweave.llm.licenses import PHRASES, templates

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}')"


def _op11() -> str:
    rows = ",\n  ".join(f"({k}, '{t.label}', {t.block // 2}, {t.least}, {len(t.words)}, '{w.decode()}')" for k, t in enumerate(templates()) for w in sorted(t.words))
    split = [(p.split(), label) for p, label in PHRASES]
    same = [" and ".join(["word = '%s'" % p[0], *(f"lead(word, {k}) over o = '{x}'" for k, x in enumerate(p) if k)]) for p, _ in split]
    phrase = "case " + " ".join(f"when {c} then '{label}'" for c, (_, label) in zip(same, split, strict=True)) + " end"
    return f"""
with tpl(k, label, h, least, total, word) as (values
  {rows}),
d as (select doc_id, {_words("text")} as w from documents),
t as (select doc_id, len(w) as n, unnest(w) as word, generate_subscripts(w, 1) - 1 as i from d),
p as (select doc_id, i, {phrase} as label from t window o as (partition by doc_id order by i)),
b as (select doc_id, count(*) as n_base, min(i) as first_word, max(i) as last_word, array_to_string(list_sort(list(distinct label)), ',') as base_labels, list(distinct label) as l
  from p where label is not null group by 1),
x as (select doc_id, n, k, label, h, least, total, word, unnest([i // h, i // h - 1]) as b from t join tpl using (word)),
m as (select doc_id, k, label, b * h as start, least(2 * h, n - b * h) as words, count(distinct word)::double / any_value(total) as c from x where b >= 0
  group by doc_id, n, k, label, h, b having count(distinct word) >= any_value(least)),
f as (select * from m qualify c = max(c) over (partition by doc_id, start, words)),
g as (select doc_id, list(distinct label) as l, max(c) as c from f group by 1)
select d.doc_id, len(w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.l, []), coalesce(g.l, [])))), ',') as labels, case when n_base > 0 then 1.0::double else coalesce(g.c, 0)::double end as score
from d left join b on b.doc_id = d.doc_id left join g on g.doc_id = d.doc_id
"""


def _op12(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """The rounds one after the other; every part is compared with every entry of its codebook."""
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"a{r} as (select vec_id, p.part, arg_min(c.entry, (d * {entries} + c.entry)) as entry, min(d) as d from (select vec_id, p.part, c.entry, sum((x - y) * (x - y)) as d "
            f"from p join c{r} c on p.part = c.part and p.pos = c.pos group by 1, 2, 3) p join (select distinct part, entry from c0) c on c.part = p.part and c.entry = p.entry group by 1, 2)"
        )
        if r < rounds:
            steps.append(
                f"s{r} as (select a.part, a.entry, p.pos, sum(x)::bigint as s, count(*) as n from a{r} a join p on p.vec_id = a.vec_id and p.part = a.part group by 1, 2, 3)"
            )
            steps.append(
                f"c{r + 1} as (select c.part, c.entry, c.pos, case when n is null then y else (s - ((s % n) + n) % n) // n end as y from c{r} c left join s{r} s on s.part = c.part and s.entry = c.entry and s.pos = c.pos)"
            )
    return f"""
with v as (select vec_id, label, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 256) as bigint)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
u as (select vec_id, unnest(e) as x, generate_subscripts(e, 1) - 1 as j, len(e) // {parts} as size from v),
p as (select vec_id, j // size as part, j % size as pos, x from u),
z as (select vec_id, row_number() over (order by vec_id) - 1 as entry from v qualify entry < {entries}),
c0 as (select part, entry, pos, x as y from p join z using (vec_id)),
{", ".join(steps)},
h as (select sha256(string_agg(y::varchar, ',' order by part, entry, pos)) as codebooks_sha256 from c{rounds}),
f as (select vec_id, string_agg(printf('%02x', entry::int), '' order by part) as code, sum(d)::bigint as error from a{rounds} group by 1),
l as (select label, sum(error)::bigint as label_error from f join v using (vec_id) group by 1)
select f.vec_id, code, error, label_error, codebooks_sha256 from f join v using (vec_id) join l on l.label is not distinct from v.label, h
"""


def _op13(percent: int = 10, seed: int = 2024, least_words: int = 20, buckets: int = 10_000) -> str:
    """crc32 byte by byte with a table of its 256 steps, once for each distinct word."""
    return f"""
with recursive bits as (select b as b, b as c, 0 as k from range(256) r(b) union all select b, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
tab as (select list(c order by b) as t from bits where k = 8),
d as (select doc_id, {_words("text")} as w from documents),
q as (select {_words("text")} as w from benchmark),
dw as (select doc_id, unnest(w) as word from d),
qw as (select unnest(w) as word from q),
n as (select word, hex(encode(word)) as h from (select word from dw union select word from qw)),
f as (select word, xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::bigint, 2))::bigint)),
  lambda c, b: xor(c >> 8, list_extract(t, (xor(c, b) & 255) + 1))), 4294967295::bigint) % {buckets} as bucket from n, tab),
s as (select bucket, count(*) as s from dw join f using (word) group by 1),
t as (select bucket, count(*) as t from qw join f using (word) group by 1),
g as (select b as bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select coalesce(sum(s), 0) from s)::double + {buckets}) / ((coalesce(s, 0) + 1)::double * ((select coalesce(sum(t), 0) from t)::double + {buckets}))))::bigint as gain
  from range({buckets}) r(b) left join s on s.bucket = b left join t on t.bucket = b),
e as (select doc_id, sum(gain)::bigint as weight from dw join f using (word) join g using (bucket) group by 1),
k as (select d.doc_id, len(w) as n_features, coalesce(weight, 0) as weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || d.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score from d left join e using (doc_id)),
r as (select doc_id, row_number() over (order by score desc, doc_id) as rank from k where n_features >= {least_words})
select k.doc_id, n_features, weight, score, case when rank <= (select count(*) * {percent} // 100 from r) then rank end as rank from k left join r using (doc_id)
"""


SQL = {"op11_licenses": _op11(), "op12_exponion": _op12(), "op13_resampling": _op13()}
