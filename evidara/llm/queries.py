"""The queries opN_<name> over whole tables, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.llm import jaccard, licences, media, mixing, near_vectors, negatives, packing, quality, secrets, sharding, token_counts, urls, whitening
from evidara.llm.workspace import Workspace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return made.select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


OP1_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5(coalesce(text, '')) as digest,
    row_number() over (partition by doc_id, coalesce(text, ''), source) - 1 as ordinal from documents),
b as (
  select *, ('0x' || substr(md5(concat('11:', coalesce(doc_id::varchar, 'null'), ':', digest, ':', ordinal)), 1, 3))::int as bin from d),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, row_number() over (order by source nulls last) - 1 as rk from s),
w as (select *, [5, 2, 1][(rk % 3)::int + 1] as weight, 2 * source_size as cap from r),
o as (
  select *, row_number() over (order by cap / weight::double, rk) as pos,
    sum(cap) over (order by cap / weight::double, rk rows unbounded preceding) - cap as caps_before,
    sum(weight) over (order by cap / weight::double desc, rk desc rows unbounded preceding) as weight_left,
    sum(source_size) over () as total
  from w),
l as (
  select arg_min((1.5::double * total::double - caps_before::double) / weight_left::double, pos) as level from o
  where (1.5::double * total::double - caps_before::double) / weight_left::double * weight <= cap),
t as (
  select w.source, source_size, least(cap::double, level * weight) as target,
    case when source_size > 0 then floor(least(cap::double, level * weight) / source_size)::bigint else 0 end as whole
  from w cross join l),
h as (select source, bin, sum(size)::bigint as words from b group by source, bin),
c as (select source, bin + 1 as upto, sum(words) over (partition by source order by bin) as filled from h),
m as (
  select t.source, t.source_size, t.target, t.whole, coalesce(
    (arg_min(upto, (abs(filled - (target - whole * source_size)), upto)) filter (where abs(filled - (target - whole * source_size)) < target - whole * source_size)), 0) as cut
  from t left join c on t.source is not distinct from c.source group by all)
select b.doc_id, b.size, m.source_size, m.target, (b.size * (m.whole + (b.bin < m.cut)::int))::bigint as taken
from b join m on b.source is not distinct from m.source
"""


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents").select("doc_id", "text"), size=4, num=85, den=100)


OP9_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
s as (
  select doc_id, list_distinct(case when len(words) = 0 then []
    when len(words) < 4 then [array_to_string(words, ' ')]
    else list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) end) as shingles from w),
n as (select doc_id, len(shingles) as n_shingles from s),
x as (select doc_id, unnest(shingles) as g from s),
p as (
  select a.doc_id as a, b.doc_id as b, count(*) as shared from x a join x b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as (
  select a, b from p join n i on a = i.doc_id join n j on b = j.doc_id
  where 100 * shared >= 85 * (i.n_shingles + j.n_shingles - shared)),
c(a, b) as (select doc_id, doc_id from s union select c.a, l.b from c join l on c.b = l.a)
select n.doc_id, n_shingles, min(b) as component_id from n join c on n.doc_id = c.a group by all
"""


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages").select("page_id", "url"))


OP10_SQL = r"""
with rules(verdict, site, under) as (values
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
u as (select row_number() over () as r, page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', ['h', 'p']) as x from pages),
s as (select r, page_id, translate(x.h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, x.p as path from u),
f as (
  select r, arg_max((site || under, verdict), length(site || under)) as best from s join rules
  on (host = site or ends_with(host, '.' || site)) and starts_with(path, under) group by r),
p as (
  select s.*, best[1] as rule, best[2] as verdict,
    list_sort(list_distinct(list_concat(
      list_transform(list_filter(string_split(host, '.'), lambda t: t <> ''), lambda t: 'h:' || t),
      list_transform(list_filter(string_split(path, '/'), lambda t: t <> ''), lambda t: 'p:' || regexp_replace(t, '(?s)^([0-9]).*$', '\1'))))) as tokens
  from s left join f using (r)),
k as (select r, verdict, tokens from p where verdict is not null),
n as (select count(*) as n from k),
a as (
  select verdict, list_filter(tokens, lambda t, i: (m >> (i - 1)) & 1 = 1) as items
  from (select verdict, tokens, unnest(range(1, (1 << len(tokens))::bigint)) as m from k)),
c as (select items, count(*) as n_all, count_if(verdict = 'allow') as n_allow, count_if(verdict = 'block') as n_block from a group by items),
g as (
  select items, verdict, hits / n_all::double as confidence, hits / n.n::double as support
  from (select items, n_all, unnest(['allow', 'block']) as verdict, unnest([n_allow, n_block]) as hits from c) cross join n
  where hits >= ceil(0.02::double * n.n) and hits > 0 and hits / n_all::double >= 0.7::double),
q as (
  select * from g where not exists (
    select 1 from g w where w.verdict = g.verdict and w.confidence >= g.confidence and len(w.items) = len(g.items) - 1 and list_has_all(g.items, w.items))),
o as (select distinct host, path, tokens from p where verdict is null),
b as (
  select host, path, arg_min(q.verdict, (-confidence, -support, len(items), items, q.verdict)) as found
  from o join q on list_has_all(o.tokens, q.items) group by host, path)
select page_id, p.host, p.path, rule, coalesce(p.verdict, found, 'allow') as verdict
from p left join b on p.verdict is null and p.host = b.host and p.path = b.path
"""


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def _op2_sql(buckets: int = 8, budget: int = 16384, longest: int = 2048) -> str:
    steps = "".join(
        f"""k{t + 1} as (
  select j, arg_min(ends, (cost, i)) as ends, min(cost) as cost from (
    select j, cost, -1 as i, ends from k{t} union all
    select d.j, k.cost + d.n_words * (d.p - e.p) - (d.w - e.w), k.j, list_append(k.ends, d.n_words)
    from k{t} k join d e on e.j = k.j join d on d.j > k.j) group by j),
"""
        for t in range(buckets - 1)
    )
    return rf"""
with s as (
  select doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as words, md5(coalesce(text, '')) as digest,
    row_number() over (partition by doc_id, coalesce(text, '')) - 1 as ordinal from documents),
c as (select doc_id, digest, ordinal, words, unnest(range(0, greatest(1, ceil(words / {longest}.0)::bigint)))::int as piece from s),
p as (
  select doc_id, digest, ordinal, piece, piece::bigint * {longest} as first_word, least({longest}, words - piece::bigint * {longest})::int as n_words,
    ('0x' || substr(md5(concat('7:', coalesce(doc_id::varchar, 'null'), ':', piece, ':', digest, ':', ordinal)), 1, 6))::bigint as lot from c),
h as (select n_words, count(*) as n from p group by n_words),
d as (
  select n_words::bigint as n_words, row_number() over (order by n_words) as j, sum(n) over (order by n_words)::bigint as p,
    sum(n * n_words) over (order by n_words)::bigint as w from h),
k0 as (select j, n_words * p - w as cost, [n_words] as ends from d),
{steps}b as (select unnest(ends) as bucket from k{buckets - 1} where j = (select max(j) from d)),
q as (
  select p.*, (select min(bucket) from b where bucket >= p.n_words)::int as bucket from p),
r as (
  select *, row_number() over (partition by bucket order by lot, doc_id nulls first, piece, digest, ordinal) - 1 as number,
    greatest(1, {budget} // greatest(bucket, 1)) as each from q)
select doc_id, piece, first_word, n_words, bucket, (number // each)::bigint as batch, (number % each)::int as slot from r
"""


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


OP3_SQL = r"""
with recursive v as (select row_number() over () as r, vec_id, label, embedding::double[] as e from embeddings),
n as (
  select r, vec_id, label, e, sqrt(list_inner_product(e, e)) as size from v
  where label is not null and e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(e, lambda x: x <> 0)) > 0),
l as (
  select a.vec_id as a, b.vec_id as b from n a join n b on a.label = b.label and a.r <> b.r and len(a.e) = len(b.e)
  where list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.98),
c(a, b) as (select vec_id, vec_id from v union select c.a, l.b from c join l on c.b = l.a),
m as (select a as vec_id, min(b) as component_id from c group by a),
k as (select a as vec_id, count(*) as n_links from l group by a)
select v.vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, v.vec_id = component_id as kept
from v left join k on v.vec_id = k.vec_id left join m on v.vec_id = m.vec_id
"""


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store's last version holds, read back: all rows, with the digest of each text."""
    docs = _table(spark, sf_dir, "documents")
    store = sharding.shard(docs, Workspace(spark, "shards").path("store"))
    return store.read().select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))


OP4_SQL = """
select doc_id, lang, source, n_chars, strlen(text)::bigint as n_bytes, sha256(text) as text_sha256 from documents
"""


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan_licences(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = media.media_columns(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    payload = F.expr(f"substring(media, {media.HEADER + 1})")
    return made.select(
        "doc_id", "n_bytes", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), F.crc32(F.expr("substring(media, -32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, arriving in two halves by a hash of doc_id: the second finds the texts that it shares with the first in
    the cache. Rows of null doc_id come with the first."""
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    first = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0, F.lit(True)) | F.col("doc_id").isNull()
    cache, path = Workspace(spark, "counts").path("cache"), public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.count_tokens(docs.filter(first), path, cache).union(token_counts.count_tokens(docs.filter(~first), path, cache))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.select("vec_id", "embedding", changed.alias("label")), F.col("vec_id") % 100 == 0)


OP11_SQL = """
with v as (
  select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
n as (select r, vec_id, label, list_transform(e, lambda x: floor(256 * x)) as x from v),
s as (
  select a.r as r, a.vec_id as anchor_id, b.r as q, b.vec_id as other_id, a.label = b.label as same, list_inner_product(a.x, b.x)::bigint as score
  from n a join n b on a.vec_id % 100 = 0 and b.vec_id is distinct from a.vec_id and len(a.x) = len(b.x)),
p as (
  select r, anchor_id, other_id as positive_id, score as positive_score, row_number() over (partition by r order by score desc, other_id nulls last) as positive_rank
  from s where same qualify positive_rank <= 5)
select p.anchor_id, positive_id, positive_rank::int as positive_rank, positive_score, other_id as negative_id, score as negative_score,
  row_number() over (partition by p.r, positive_rank order by score desc, other_id nulls last)::int as rank
from p join s on p.r = s.r and not same and 80 * positive_score <= 100 * score and score <= positive_score
qualify rank <= 5
"""


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.summary(secrets.scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")))


OP12_SQL = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t, coalesce(source, '') as owner, coalesce(source, '') || '/' || coalesce(lang, '') as repository from documents),
p(k, kind, pattern) as (values
  (0, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']? *[:=] *["'']?[A-Za-z0-9+/_.=-]+'),
  (1, 'access', 'AKIA[A-Z0-9]+'), (2, 'hex', '[0-9a-f]+'), (3, 'opaque', '[A-Za-z0-9+/_=-]+')),
x as (
  select r, k, kind, unnest(regexp_extract_all(t, pattern)) as v, unnest(regexp_split_to_array(t, pattern)[:-2]) as gap, generate_subscripts(regexp_extract_all(t, pattern), 1) as i
  from d join p on regexp_matches(t, pattern)),
y as (select r, k, kind, v, sum(len(gap) + len(v)) over (partition by r, k order by i)::bigint as e from x),
z as (
  select r, k, kind, e - len(v) as s, e,
    case when k = 0 then regexp_extract(v, '^[^:=]*[:=] *["'']?(.*)$', 1) else v end as v from y),
b as (select * from z where (k = 0 and len(v) >= 8) or (k = 1 and len(v) >= 16) or (k = 2 and len(v) >= 32)),
l as (
  select *, regexp_matches(v, '[A-Za-z]') and regexp_matches(v, '[0-9]') and len(list_distinct(string_split(v, ''))) >= {secrets.VARIETY} as live from (
    select * from b union all
    select * from z where k = 3 and len(v) between {secrets.OPAQUE_LEAST} and {secrets.OPAQUE_MOST} and not exists (select 1 from b where b.r = z.r and b.s < z.e and b.e > z.s))),
c as (select * from l where k < 3 or live),
o as (
  select v, count(distinct owner) >= {secrets.OWNERS} or count(distinct repository) >= {secrets.REPOSITORIES} as copied from c join d using (r) group by v),
f as (select c.*, case when copied then 'copied' when live then 'live' else 'weak' end as class from c join o using (v) where k < 3 or not copied),
a as (
  select r, count_if(k = 0) as n_assign, count_if(k = 1) as n_access, count_if(k = 2) as n_hex, count_if(k = 3) as n_opaque,
    coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, k) filter (where k < 3), '') as base, string_agg(kind || ':' || s || ':' || e, ',' order by s, k) as spans,
    count_if(class = 'live') as n_live, count_if(class = 'copied') as n_copied, count_if(class = 'weak') as n_weak from f group by r)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, coalesce(n_opaque, 0)::bigint as n_opaque,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
  coalesce(n_live, 0)::bigint as n_live, coalesce(n_copied, 0)::bigint as n_copied, coalesce(n_weak, 0)::bigint as n_weak
from d left join a using (r)
"""


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation that no long holds is null here."""
    made = whitening.whiten(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return made.withColumn("deviation", F.when(F.col("deviation") <= 2**63 - 1, F.col("deviation")).cast("long"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_packing": op2_packing,
        "op3_near_vectors": op3_near_vectors,
        "op4_sharding": op4_sharding,
        "op5_licence_scan": op5_licence_scan,
        "op6_media_columns": op6_media_columns,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_token_counts": op8_token_counts,
        "op9_ngram_jaccard": op9_ngram_jaccard,
        "op10_url_filters": op10_url_filters,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_secret_scan": op12_secret_scan,
        "op13_embedding_whitening": op13_embedding_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL, "op2_packing": _op2_sql(), "op3_near_vectors": OP3_SQL, "op4_sharding": OP4_SQL, "op9_ngram_jaccard": OP9_SQL, "op10_url_filters": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op12_secret_scan": OP12_SQL}
