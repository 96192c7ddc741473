"""Registered queries of the operators and the SQL that some of them can be stated in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_bpe() -> str:
    """The tokenizer file that the queries encode with."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from promptmill.llm.substrings import digests, without_repeats
    return digests(without_repeats(_table(spark, sf_dir, "documents")))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from promptmill.llm.jaccard import similar
    return similar(_table(spark, sf_dir, "documents"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from promptmill.llm.mixing import sampled
    return sampled(_table(spark, sf_dir, "documents")).withColumn("probability", F.round("probability", 7))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from promptmill.llm.topk import nearest
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from promptmill.llm.quality import predicted
    return predicted(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from promptmill.llm.languages import predicted
    return predicted(_table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from promptmill.llm.bpe import digests
    return digests(_table(spark, sf_dir, "documents"), word_bpe())


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from promptmill.llm.toxicity import predicted
    return predicted(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from promptmill.llm.licenses import scan
    return scan(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from promptmill.llm.lines import verdicts
    return verdicts(_table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from promptmill.llm.centroids import clusters
    return clusters(_table(spark, sf_dir, "embeddings"))


def piece_bpe() -> str:
    """The piece model that the queries encode with."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from promptmill.llm.sentencepieces import digests
    return digests(_table(spark, sf_dir, "documents"), piece_bpe())


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from promptmill.llm.spelling import variants
    return variants(_table(spark, sf_dir, "documents"))


REGISTERED = {f.__name__: f for f in (
    op1_mixing, op2_topk, op3_substring_dedup, op4_quality, op5_language, op6_bpe, op7_jaccard_join, op8_toxicity,
    op9_licenses, op10_quality_rules, op11_centroids, op12_sentencepiece, op13_spelling)}

#: Words as every contract on white space has them.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

def _mixing_sql() -> str:
    from promptmill.llm.mixing import FRACTION, MARGINALS, SWEEPS, TEMPER, TOPIC_LETTERS, TOPICS
    steps, last = [], "t"
    targets = ", ".join(f"""d * pow(sum(tokens) over (partition by {m}), {TEMPER})
      / (select sum(pow(n, {TEMPER})) from (select sum(tokens) as n from c group by {m})) as t_{m}""" for m in MARGINALS)
    for k in range(SWEEPS):
        for m in MARGINALS:
            step = f"s{k}_{m}"
            steps.append(f"""{step} as materialized (select * exclude (w), case when sum(w) over (partition by {m}) > 0
  then least(tokens, w * t_{m} / sum(w) over (partition by {m})) else 0 end as w from {last})""")
            last = step
    return f"""
with a as (select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang, {_WORDS} as w,
  ('0x' || substr(md5('mix|' || coalesce(doc_id::varchar, '') || '|' || coalesce(text, '')), 1, 8))::bigint / 4294967296.0 as draw from documents),
k as (select doc_id, x, count(*) as n from (select doc_id, unnest(list_transform(w,
    lambda y: translate(y, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) as x from a)
  where octet_length(encode(x)) >= {TOPIC_LETTERS} group by all),
p as (select doc_id, first(x order by n desc, encode(x)) as x from k group by doc_id),
b as (select doc_id, source, lang, draw, len(w)::bigint as tokens,
  case when x is null then -1 else ('0x' || substr(md5(x), 1, 4))::int % {TOPICS} end as topic from a left join p using (doc_id)),
c as (select source, lang, topic, sum(tokens)::double as tokens from b group by all),
t as materialized (select *, {FRACTION} * tokens as w, {targets} from (select *, {FRACTION} * sum(tokens) over () as d from c)),
{", ".join(steps)},
r as (select b.*, coalesce(w / nullif(c.tokens, 0), 0) as pr from b join {last} c using (source, lang, topic))
select doc_id, source, lang, topic::int as topic, tokens, round(pr, 7) as probability,
  draw < pr as taken from r"""


def _licenses_sql() -> str:
    from promptmill.llm.licenses import BASE_SCORE, COVERAGE, templates
    listed = ", ".join(f"('{t.label}', {t.base}, {list(t.words)}, {t.key_at}, {list(t.key)})" for t in templates())
    return f"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
t(label, base, words, key_at, key) as (values {listed}),
p as (select doc_id, w, label, base, words, key_at, unnest(list_filter(range(len(w) - len(key) + 1),
  lambda i: w[i + 1] = key[1] and w[i + 1:i + len(key)] = key)) as place from d, t),
h as (select doc_id, label, base, place, len(list_filter(range(len(words)), lambda j: place - key_at + j >= 0
  and coalesce(w[place - key_at + j + 1] = words[j + 1], false))) / len(words)::double as coverage from p),
g as (select doc_id, count(*) filter (base) as n_base, min(place) filter (base) as first_word, max(place) filter (base) as last_word,
  string_agg(distinct label, ',' order by label) filter (base) as base_labels,
  string_agg(distinct label, ',' order by label) filter (base or coverage >= {COVERAGE}) as labels,
  max(case when base then {BASE_SCORE} else coverage end)::double as score from h group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word,
  last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
  coalesce(score, 0)::double as score from d left join g using (doc_id)"""


def _lines_sql() -> str:
    from promptmill.llm.lines import (
        BARS, DISTINCT_PERCENT, KEPT_PERCENT, LEAST_WORDS, LONG_LINE, MOST_REPEATED_PERCENT, SYMBOL_PERCENT, UPPER_PERCENT)
    words = _WORDS.replace("coalesce(text, '')", "x")
    return f"""
with d as (select doc_id, coalesce(text, '') as text, {_WORDS} as w from documents),
l as (select doc_id, i, x, {words} as w from (select doc_id, unnest(string_split(text, chr(10))) as x,
  generate_subscripts(string_split(text, chr(10)), 1) as i from d)),
m as (select doc_id, x, w, len(w) as n, row_number() over (partition by doc_id, x order by i) > 1 as again from l where len(w) > 0),
b as (select doc_id, n, again, again or length(x) - length(replace(x, '|', '')) >= {BARS}
    or 100 * len(list_filter(w, lambda y: regexp_matches(y, '[#*$%&<>]'))) > {SYMBOL_PERCENT} * n
    or (n >= {LONG_LINE} and (100 * len(list_filter(w, lambda y: regexp_matches(y, '[A-Z][A-Z]') and not regexp_matches(y, '[a-z]'))) > {UPPER_PERCENT} * n
      or 100 * len(list_distinct(w)) < {DISTINCT_PERCENT} * n or not regexp_matches(x, '[.,;:!?]'))) as bad from m),
s as (select doc_id, count(*) filter (again) as n_dup_lines, coalesce(sum(n) filter (bad), 0) as lost from b group by doc_id),
g as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) as c
  from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d where len(w) > 4)),
r as (select doc_id, count(distinct j) as n_repeat_words from (select doc_id, unnest(range(i, i + 5)) as j from g where c > 1) group by doc_id),
a as (select doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda y: length(y))), 0)::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(lost, 0)::bigint as lost_words
  from d left join s using (doc_id) left join r using (doc_id)),
f as (select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words as base_failed from a)
select *, not base_failed and 100 * (n_words - lost_words) >= {KEPT_PERCENT} * n_words as kept from f"""


def _centroids_sql() -> str:
    from promptmill.llm.centroids import CLUSTERS, DIMENSIONS, ROUNDS, SCALE
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""a{k} as materialized (select i, arg_min(c, (d, c)) as c, min(d) as d from (
    select x.i, m.c, sum((x.v - m.v) * (x.v - m.v))::bigint as d from x join m{k} m on x.k = m.k group by x.i, m.c) group by i)""")
        if k < ROUNDS:
            steps.append(f"""m{k + 1} as materialized (select m.c, m.k, coalesce(n.v, m.v) as v from m{k} m left join (
    select c, k, ((s - ((s % n) + n) % n) // n)::bigint as v from (select a.c, x.k, sum(x.v)::bigint as s, count(*)::bigint as n
      from x join a{k} a using (i) group by a.c, x.k)) n using (c, k))""")
    return f"""
with e as materialized (select row_number() over () as i, vec_id, list_transform(embedding, lambda y: floor({SCALE} * y::double)::bigint) as e
  from embeddings where len(embedding) = {DIMENSIONS} and len(list_filter(embedding, lambda y: y is null or not isfinite(y))) = 0),
x as materialized (select i, unnest(range({DIMENSIONS})) as k, unnest(e) as v from e),
f as (select e, row_number() over (order by sha256('3:' || vec_id) nulls last, e) - 1 as c from e
  order by sha256('3:' || vec_id) nulls last, e limit {CLUSTERS}),
m0 as materialized (select c, unnest(range({DIMENSIONS})) as k, unnest(e) as v from f),
{", ".join(steps)},
t as (select c, sum(d)::bigint as s from a{ROUNDS} group by c),
h as (select c, sha256(string_agg(v::varchar, ',' order by k)) as centroid_sha256 from m{ROUNDS} group by c)
select e.vec_id, a.c::int as cluster, a.d as distance, t.s as cluster_inertia, (select sum(s)::bigint from t) as inertia, centroid_sha256
from e join a{ROUNDS} a using (i) join t using (c) join h using (c)"""


def _spelling_sql() -> str:
    from promptmill.llm.spelling import DELETES, LEAST_COUNT, LEAST_LENGTH, TIMES
    table = []  # crc32 of one byte, by its rule
    for b in range(256):
        for _ in range(8):
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        table.append(b)
    return f"""
with recursive t as (select {table}::bigint[] as t),
r as (select coalesce(doc_id::varchar, '') || ':' as id, unnest(regexp_extract_all(
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) as w from documents),
d as (select id, w, count(*) as n from r where length(w) >= {LEAST_LENGTH} group by id, w),
b as (select id, w, n, list_reduce(list_prepend(4294967295::bigint, list_transform(range(octet_length(encode(id || w))),
    lambda i: ('0x' || substr(hex(encode(id || w)), 2 * i::int + 1, 2))::bigint)),
  lambda a, y: xor(a >> 8, t.t[(xor(a, y) & 255) + 1])) as h from d, t),
c as (select w, n, xor(h, 4294967295) as h from b),
k as (select case when h % {DELETES} = 0 then substr(w, 1, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end as word, n from c),
v as materialized (select word, sum(n)::bigint as n from k where length(word) >= {LEAST_LENGTH} group by word having sum(n) >= {LEAST_COUNT}),
u as materialized (select word, i, substr(word, 1, i - 1) || substr(word, i + 1) as less, substr(word, 1, i - 1) || '*' || substr(word, i + 1) as hole
  from (select word, unnest(range(1, length(word) + 1))::int as i from v)),
p as (select a.word as x, b.word as y from u a join u b on a.hole = b.hole and a.word <> b.word
  union select u.word, v.word from u join v on u.less = v.word union select v.word, u.word from u join v on u.less = v.word),
q as (select x, count(*)::bigint as n_near, first(y order by v.n desc, y) as y, max(v.n) as m from p join v on v.word = p.y group by x),
f as materialized (select v.word, v.n, coalesce(q.n_near, 0)::bigint as n_near, case when q.m >= {TIMES} * v.n then q.y end as form,
  case when q.m >= {TIMES} * v.n then q.m end as form_n from v left join q on q.x = v.word),
g as (select word, word as root, 0 as depth from f union all select g.word, f.form, depth + 1 from g join f on f.word = g.root where f.form is not null),
o as (select word, arg_max(root, depth) as root from g group by word)
select f.word, f.form, o.root, f.n, f.n_near, f.form_n from f join o using (word)"""


ORACLES = {
    "op11_centroids": _centroids_sql(),
    "op13_spelling": _spelling_sql(),
    "op3_substring_dedup": f"""
with d as (select doc_id, {_WORDS} as w from documents),
p as (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50),
h as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as m from p),
f as (select doc_id, i, min(doc_id) over (partition by m) as first from h),
g as (select distinct doc_id, unnest(range(i, i + 50)) as j from f where first < doc_id),
r as (select doc_id, list(j) as gone from g group by doc_id),
k as (select d.doc_id, len(w) as n_words, coalesce(len(gone), 0) as n_removed,
  case when gone is null then w else (list_select(w, (select list(x order by x) from (
    select unnest(range(1, len(w) + 1)) as x) where not list_contains(gone, x)))) end as kept
  from d left join r using (doc_id))
select doc_id, n_words::bigint as n_words, n_removed::bigint as n_removed,
  sha256(coalesce(array_to_string(kept, ' '), '')) as kept_sha256 from k""",
    "op7_jaccard_join": f"""
with recursive d as (select doc_id, {_WORDS} as w from documents),
s as (select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i + 4], ' ') end as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
m as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b using (g) where a.doc_id <> b.doc_id group by x, y),
e as (select x, y from m join n p on p.doc_id = x join n q on q.doc_id = y where 5 * k >= 4 * (p.n + q.n - k)),
r as (select x, y from e union select r.x, e.y from r join e on r.y = e.x),
c as (select x, min(y) as y from r group by x), k as (select x, count(*) as k from e group by x)
select d.doc_id, least(d.doc_id, coalesce(c.y, d.doc_id)) as class_id, coalesce(k.k, 0)::bigint as n_links,
  coalesce(n.n, 0)::int as n_grams
from d left join n using (doc_id) left join c on c.x = d.doc_id left join k on k.x = d.doc_id""",
    "op1_mixing": _mixing_sql(),
    "op9_licenses": _licenses_sql(),
    "op10_quality_rules": _lines_sql(),
    "op2_topk": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, v.vec_id, list_dot_product(q.e, v.e)::bigint as score from v q join v on q.vec_id <> v.vec_id
  and len(q.e) = len(v.e) where q.vec_id % 100 = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
select * from r where rank <= 10""",
}
