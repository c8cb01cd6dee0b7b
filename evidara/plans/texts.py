"""Text, search, duplicate and parsing queries over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.functions import arrays, clinical, passages, residues
from evidara.functions import text as T
from evidara.operators import corpus, dedup, leakage, search
from evidara.plans.registry import query
from evidara.plans.relational import table

_NORMAL = r"trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))"
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def asked(spark, sf_dir):
    """Benchmark items as queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("exact_duplicate_groups", f"""
select substr(sha256({_NORMAL}), 1, 16) as exact_group, min(doc_id) as first, count(*) as n from documents group by 1 having count(*) > 1""")  # fmt: skip
def exact_duplicate_groups(spark, sf_dir):
    """D01."""
    return dedup.exact_groups(table(spark, sf_dir, "documents"), "doc_id")


_PIECES = r"(?i:pmid)[:\x20]+[0-9]+|(?i:aspartic|glutamic)[\x20\x09-\x0D]+(?i:acid)|[0-9]+(?:[.,][0-9]+)+%?|[^\x20\x09-\x0D,;/]+|[,;/]"
_RESIDUES = ", ".join(f"'{n.lower()}'" for n in [*T.RESIDUE_NAMES, *residues.AMINO_ACIDS])
#: key and template of t (key, text).
_TEMPLATES = rf"""
p as (select key, unnest(regexp_extract_all(text, '{_PIECES}')) as piece, generate_subscripts(regexp_extract_all(text, '{_PIECES}'), 1) as i from t),
c as (select *, regexp_extract(piece, '^[("''\[{{<]+') as a, regexp_replace(regexp_replace(piece, '^[("''\[{{<]+', ''), '[)"''\]}}>.:!?]+$', '') as core, regexp_extract(piece, '[)"''\]}}>.:!?]+$') as b from p),
k as (
  select key, i, piece, a, b, case
    when regexp_matches(core, '^[cgmnpr]\.[^\n]*[0-9]') or regexp_matches(core, '^[NX][CGMPR]_.*[0-9]') then '_hgvs_'
    when regexp_full_match(core, '[0-9]{{6,9}}|[Rr][Ss][0-9]+') or starts_with(lower(core), 'pmid') then '_id_'
    when lower(core) in ({_RESIDUES}) or ends_with(lower(core), ' acid') then '_aa_'
    when regexp_full_match(core, '[A-Z][A-Z0-9]{{1,9}}(-[A-Z0-9]+)?') then '_gene_'
    when regexp_full_match(core, '[0-9]+([.,][0-9]+)*%?') then '_num_' end as kind from c),
m as (select key, trim(regexp_replace(lower(string_agg(coalesce(a || kind || b, piece), ' ' order by i)), '\s+', ' ', 'g')) as template from k group by key)"""


@query("template_text", r"""
with t as (select o_orderkey, 'Variant c.' || o_orderkey || 'G>A (p.Gly12Val) rs' || o_custkey || ' in MLH1, seen ' || (o_orderkey % 90 + 10) || '% of 12.5 Alanine' as text from orders)
select o_orderkey, trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '\b(?:[cgnmrp]\.(?:\(?[A-Za-z*]{0,3}[-*]?\d+[^\s,;)]*\)?)|[NX][MRCGP]_\d+(?:\.\d+)?)', ' _hgvs_ ', 'g'), '(?i)\b(?:rs\d+|PMID:?\s*\d+|\d{6,9})\b', ' _id_ ', 'g'),
  '\b[A-Z][A-Z0-9]{1,9}(?:-[A-Z0-9]+)?\b', ' _gene_ ', 'g'), '(?i)\balanine\b', ' _aa_ ', 'g'), '\b\d+(?:[.,]\d+)*%?\b', ' _num_ ', 'g')), '\s+', ' ', 'g')) as template from t""")  # fmt: skip
def template_text(spark, sf_dir):
    """Mentions anywhere in a text, also inside longer words."""
    text = F.concat(F.lit("Variant c."), "o_orderkey", F.lit("G>A (p.Gly12Val) rs"), "o_custkey", F.lit(" in MLH1, seen "), F.col("o_orderkey") % 90 + 10, F.lit("% of 12.5 Alanine"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.template(text).alias("template"))


@query("template_notation", rf"""
with t as (select c_custkey as key, 'Variant c.' || c_custkey || 'G>A (p.Gly12Val), rs' || c_nationkey || ' in MLH1/BRCA2-' || c_name || ', seen ' || (c_custkey % 90 + 10) || '% of 12.5 Alanine. ' || c_mktsegment || ' [PMID: ' || c_nationkey || '] NM_' || c_custkey || '.3:c.1A>T; aspartic acid (glu)' as text from customer),
{_TEMPLATES} select key as c_custkey, template from m""")  # fmt: skip
def template_notation(spark, sf_dir):
    """accessions, references, lists, acids of two words, and marks around pieces."""
    text = F.concat(
        F.lit("Variant c."), "c_custkey", F.lit("G>A (p.Gly12Val), rs"), "c_nationkey", F.lit(" in MLH1/BRCA2-"), "c_name", F.lit(", seen "), F.col("c_custkey") % 90 + 10, F.lit("% of 12.5 Alanine. "),
        "c_mktsegment", F.lit(" [PMID: "), "c_nationkey", F.lit("] NM_"), "c_custkey", F.lit(".3:c.1A>T; aspartic acid (glu)"),
    )
    return table(spark, sf_dir, "customer").select("c_custkey", T.piece_template(text).alias("template"))


@query("document_templates", rf"""
with t as (select doc_id as key, text from documents), {_TEMPLATES}
select doc_id, sha256(coalesce(template, '')) as template_sha256, (len(regexp_extract_all(template, '_(hgvs|id|aa|gene|num)_')))::int as n_placeholders from documents left join m on doc_id = key""")  # fmt: skip
def document_templates(spark, sf_dir):
    """F36 over whole documents; a text without pieces has no template."""
    made = corpus.templates(table(spark, sf_dir, "documents"), "doc_id")
    digest = F.sha2(F.coalesce("template", F.lit("")), 256)
    return made.select("doc_id", digest.alias("template_sha256"), F.regexp_count("template", F.lit("_(hgvs|id|aa|gene|num)_")).alias("n_placeholders"))


_TOKENS = rf"""w as (select doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+(?:[._:>+\-*][A-Za-z0-9]+)*'))) as w from documents),
k as (select doc_id, w from w where w not in ({_STOP}) and w not in (select unnest(['{"', '".join(T.EXPANSIONS)}']))),
p as (select doc_id, unnest(regexp_split_to_array(w, '[._:>+\-*]')) as t from k where regexp_matches(w, '[._:>+\-*]')),
e(short, full_form) as (values {", ".join(f"('{a}', '{b}')" for a, b in T.EXPANSIONS.items())}),
t as (select doc_id, w as term from k union all select doc_id, t from p where length(t) >= 2 and t not in ({_STOP}) union all
  select doc_id, unnest(string_split(full_form, ' ')) from w join e on w = short)"""


@query("search_tokens", f"with {_TOKENS} select doc_id, count(*) as n_tokens, count(distinct term) as n_terms from t group by 1")
def search_tokens(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t")).filter(F.size("t") > 0)
    return found.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_terms"))


_BM25 = _TOKENS + f""",
f as (select (select count(*) from documents) as n_docs, (select count(*) from t) / (select count(*) from documents)::double as avg_length), l as (select doc_id, count(*) as length from t group by 1),
tf as (select term, doc_id, count(*) as tf from t group by all), df as (select term, count(*) as df from tf group by 1),
qw as (select item_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+(?:[._:>+\\-*][A-Za-z0-9]+)*'))) as w from benchmark),
q as (select distinct item_id, w as term from qw where w not in ({_STOP})),
s as (select item_id as query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avg_length))), 6) as score, count(*) as n_terms
  from q join tf using (term) join df using (term) join l using (doc_id) cross join f group by all)"""


@query("bm25_search", f"with {_BM25} select query_id, doc_id, score, n_terms, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from s qualify rank <= 5")
def bm25_search(spark, sf_dir):
    """F36, F37, T04."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    terms = search.tokenised(docs, "doc_id", "text")
    scored = search.bm25(search.postings(terms, "doc_id"), search.corpus_figures(docs, terms), asked(spark, sf_dir), "doc_id").withColumn("score", F.round("score", 6))
    return search.top_k_by_group(scored, ["query_id"], "score", "doc_id", 5)


@query("hybrid_search", f"""
with vectors as (select vec_id, embedding::double[] as x from embeddings), documents as (select d.doc_id, d.text, x from main.documents d join vectors on doc_id = vec_id), {_BM25},
a as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as rank from s qualify rank <= 40),
v as (
  select item_id as query_id, d.doc_id, list_inner_product(q.x, d.x) / (sqrt(list_inner_product(q.x, q.x)) * sqrt(list_inner_product(d.x, d.x))) as score
  from benchmark join vectors q on item_id = q.vec_id cross join documents d),
b as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as rank from v where score > 0 qualify rank <= 40),
fused as (select query_id, doc_id, sum(1 / (60.0::double + rank)) as score from (select * from a union all select * from b) group by all)
select query_id, doc_id, round(score, 9) as score, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from fused qualify rank <= 6""")  # fmt: skip
def hybrid_search(spark, sf_dir):
    """Benchmark items as queries, by their text and by the vector of their number, over documents that have a vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    docs = table(spark, sf_dir, "documents").join(vectors, F.col("doc_id") == F.col("vec_id")).select("doc_id", "text", "embedding")
    queries = asked(spark, sf_dir).join(vectors, F.col("query_id") == F.col("vec_id")).select("query_id", "text", "embedding")
    found = search.hybrid(docs, asked(spark, sf_dir).join(queries.select("query_id", "embedding"), "query_id", "left"), "doc_id")
    return found.select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


@query("as_of_documents", """
select o_orderkey, o_custkey from orders where strftime(o_orderdate, '%Y-%m-%d') <= '1996-06-30' and o_custkey not in (select c_custkey from customer where c_nationkey % 3 = 0)""")  # fmt: skip
def as_of_documents(spark, sf_dir):
    """Orders as documents known by a date, without those of excluded customers."""
    docs = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    gone = table(spark, sf_dir, "customer").filter("c_nationkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return search.as_of(docs, "1996-06-30", gone, on="o_custkey").select("o_orderkey", "o_custkey")


@query("every_tenth_document", "select doc_id from documents where floor(('0x' || substr(sha1('3:' || doc_id::varchar), 1, 13))::bigint / 4503599627370496.0::double * 10) = 0")
def every_tenth_document(spark, sf_dir):
    """The sampling operator over all documents."""
    return corpus.every_kth(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 10, 3)


@query("rank_fusion", """
with a as (select p_brand as query_id, p_partkey, row_number() over (partition by p_brand order by p_size desc, p_partkey) as rank from part), b as (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_retailprice, p_partkey) as rank from part),
u as (select * from a where rank <= 10 union all select * from b where rank <= 10), s as (select query_id, p_partkey, sum(1.0::double / (60 + rank)) as score from u group by all)
select query_id, p_partkey, score, row_number() over (partition by query_id order by score desc, p_partkey)::int as rank from s""")  # fmt: skip
def rank_fusion(spark, sf_dir):
    """T05, U17."""
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("query_id"), "p_partkey", "p_size", (-F.col("p_retailprice")).alias("cheap"))
    top = lambda c: search.top_k_by_group(parts, ["query_id"], c, "p_partkey", 10).select("query_id", "p_partkey", "rank")
    return search.fuse([top("p_size"), top("cheap")], "p_partkey")


@query("cosine_topk", """
with v as (select vec_id, embedding::double[] as e from embeddings), q as (select vec_id as query_id, e as q from v where vec_id % 50 = 0),
s as (select query_id, vec_id, list_inner_product(q, e) / (sqrt(list_inner_product(q, q)) * sqrt(list_inner_product(e, e))) as score from q cross join v)
select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s where score > 0 qualify rank <= 5""")  # fmt: skip
def cosine_topk(spark, sf_dir):
    """U16."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search.vector_top(vectors, vectors.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 5, "vec_id")


_SHINGLED = f"""
w as (select doc_id, regexp_extract_all({_NORMAL}, '[a-z0-9<>_]+') as w from documents),
s as (select doc_id, list_sort(list_distinct(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(w[i:i + 4], ' ')))) as s from w where len(w) > 0),
c as (select s, min(doc_id) as k, count(*) as n_copies from s group by s), x as (select k, len(s) as n, unnest(s) as g from c),
p as (select a.k as a, b.k as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as shared from x a join x b on a.g = b.g and a.k <> b.k group by all),
l as (select a, b, shared / (na + nb - shared)::double as jaccard from p where 100 * shared >= 80 * (na + nb - shared))"""


@query("minhash_clusters", f"""
with recursive {_SHINGLED},
t(a, b) as (select k, k from c union select t.a, l.b from t join l on l.a = t.b), r as (select a as k, min(b) as root from t group by a),
d as (select doc_id, root from s join c using (s) join r using (k)), z as (select root, min(doc_id) as cluster from d group by root having count(*) > 1)
select doc_id, cluster from d join z using (root)""")  # fmt: skip
def minhash_clusters(spark, sf_dir):
    """D02, D03, D04, D05, D55, D56."""
    return dedup.near_clusters(table(spark, sf_dir, "documents"), 0.8, "doc_id")


@query("shingle_jaccard_pairs", f"with {_SHINGLED} select a, b, jaccard from l where a < b")
def shingle_jaccard_pairs(spark, sf_dir):
    """Pairs of different shingle sets over all documents, each set named by its smallest doc_id."""
    return dedup.similar_pairs(table(spark, sf_dir, "documents"), 0.8, "doc_id")


@query("document_clusters")
def document_clusters(spark, sf_dir):
    """D07."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text", F.col("source").alias("submitter"))
    return dedup.document_clusters(docs)


@query("benchmark_contamination", """
with n as (select doc_id, regexp_extract_all(trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')), '[a-z0-9<>_]+') as w from documents),
m as (select item_id, regexp_extract_all(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '[a-z0-9<>_]+') as w from benchmark),
a as (select doc_id, unnest(list_distinct(list_transform(range(1, greatest(2, len(w) - 6)), lambda i: array_to_string(w[i:i + 7], ' ')))) as h from n where len(w) > 0),
b as (select item_id, list_distinct(list_transform(range(1, greatest(2, len(w) - 6)), lambda i: array_to_string(w[i:i + 7], ' '))) as s from m where len(w) > 0),
c as (select item_id, len(s) as n, unnest(s) as h from b)
select doc_id, item_id, count(*) as shared, count(*) / any_value(n)::double as share from a join c using (h) group by doc_id, item_id""")  # fmt: skip
def benchmark_contamination(spark, sf_dir):
    """D35."""
    return leakage.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


@query("html_strip_text", r"""
with s as (select page_id, regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)>|<[^>]*>', ' ', 'g') as t from pages)
select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) as text from s""")  # fmt: skip
def html_strip_text(spark, sf_dir):
    """F43."""
    return table(spark, sf_dir, "pages").select("page_id", T.clean_markup(F.col("html")).alias("text"))


@query("url_host_breakdown", "select regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as host, count(*) as n from pages group by 1")
def url_host_breakdown(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host")).agg(F.count("*").alias("n"))


@query("json_props_extract", """
select event_type, count(*) as n, sum(json_extract(props, '$.k')::bigint)::bigint as total, count(json_extract(props, '$.absent')) as n_absent from events group by 1""")  # fmt: skip
def json_props_extract(spark, sf_dir):
    """U20."""
    rows = table(spark, sf_dir, "events").select("event_type", T.json_object(F.concat(F.lit("Answer: "), "props", F.lit(" .")), "k bigint, absent string").alias("p"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("total"), F.count("p.absent").alias("n_absent"))


@query("normalized_classification", """
with t(k, raw, category, label5, n_modifiers, y) as (values (0, 'Pathogenic', 'five_class', 'pathogenic', 0, 1.0), (1, 'Likely benign/Benign', 'pair', null, 0, 0.0), (2, 'Conflicting classifications', 'conflicting', null, 0, null),
  (3, 'Uncertain significance; other', 'five_class', 'vus', 1, null), (4, 'drug response', 'out_of_scope', null, 1, null), (5, '-', 'missing', null, 0, null), (6, 'Pathogenic, low penetrance', 'five_class', 'pathogenic', 1, 1.0),
  (7, 'Likely pathogenic/Benign', 'conflicting', null, 0, null))
select o_orderkey, category, label5, n_modifiers::int as n_modifiers, y::double as y from orders join t on o_orderkey % 8 = k""")  # fmt: skip
def normalized_classification(spark, sf_dir):
    said = ["Pathogenic", "Likely benign/Benign", "Conflicting classifications", "Uncertain significance; other", "drug response", "-", "Pathogenic, low penetrance", "Likely pathogenic/Benign"]
    raw = F.get(F.array(*[F.lit(s) for s in said]), (F.col("o_orderkey") % 8).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", clinical.normalized_classification(raw).alias("i"))
    return rows.select("o_orderkey", "i.category", "i.label5", F.size("i.modifiers").alias("n_modifiers"), clinical.binary_label(F.col("i")).alias("y"))


@query("variant_name_parts", r"""
with t as (select o_orderkey as k, 'NM_000249.4(MLH1):c.' || (o_custkey + 1) || 'G>A (p.Gly' || (o_custkey // 3 + 1) || case when o_orderkey % 4 = 0 then 'Argfs' when o_orderkey % 4 = 1 then 'Gly' else 'Arg' end || ')' as name from orders)
select k, 'NM_000249.4' as transcript, 'MLH1' as gene, regexp_extract(name, '(c\.[^ ]+)', 1) as change, case when k % 4 > 1 then 'G' end as wt_aa, case when k % 4 > 1 then regexp_extract(name, 'Gly(\d+)', 1)::bigint end as position,
  case when k % 4 > 1 then 'R' end as mut_aa, case k % 4 when 0 then 'frameshift' when 1 then 'synonymous' else 'missense' end as consequence, 'consistent' as codon from t""")  # fmt: skip
def variant_name_parts(spark, sf_dir):
    end = F.when(F.col("o_orderkey") % 4 == 0, "Argfs").when(F.col("o_orderkey") % 4 == 1, "Gly").otherwise("Arg")
    codon = residues.codon_of(F.col("o_custkey") + 1)
    name = F.concat(F.lit("NM_000249.4(MLH1):c."), F.col("o_custkey") + 1, F.lit("G>A (p.Gly"), codon, end, F.lit(")"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), name.alias("name"), codon.alias("at"))
    parts = rows.select("k", "name", "at", residues.variant_name(F.col("name")).alias("v"), residues.three_letter_change(F.col("name")).alias("c"))
    return parts.select("k", "v.transcript", "v.gene", "v.change", "c.wt_aa", "c.position", "c.mut_aa", residues.consequence(F.lit("single nucleotide variant"), F.col("name"), F.lit(1)).alias("consequence"), residues.hgvs_consistency(F.col("v.change"), F.col("at")).alias("codon"))


@query("iso_dates", """
select o_orderkey, case o_orderkey % 4 when 3 then strftime(o_orderdate, '%Y') || '-01-01' else strftime(o_orderdate, '%Y-%m-%d') end as day from orders""")  # fmt: skip
def iso_dates(spark, sf_dir):
    """F16."""
    form = lambda f: F.date_format("o_orderdate", f)
    k = F.col("o_orderkey") % 4
    said = F.when(k == 0, form("MMM d, yyyy")).when(k == 1, form("yyyy-MM-dd")).when(k == 2, form("yyyy/MM/dd")).otherwise(form("yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", clinical.iso_date(said).alias("day"))


@query("clinical_bands", """
with x as (select l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax, case when l_discount > 0.05 then null else l_discount / 100 end as af from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_quantity, case when af is null or af <= 0 then 'absent' when af < 1e-5 then '<1e-05' when af < 1e-4 then '<0.0001' when af < 1e-3 then '<0.001' when af < 1e-2 then '<0.01' else '>=0.01' end as band,
  case when l_quantity >= 350 then 'PS3_very_strong' when l_quantity >= 18.7 then 'PS3_strong' when l_quantity >= 4.3 then 'PS3_moderate' when l_quantity >= 2.08 then 'PS3_supporting' when l_quantity <= 1 / 350.0 then 'BS3_very_strong' else 'indeterminate' end as strength,
  (af >= 1e-3 and af < 0.05 and af is not null)::int as bs1, (af is null or af <= 1e-5)::int as pm2 from x""")  # fmt: skip
def clinical_bands(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("af", F.when(F.col("l_discount") <= 0.05, F.col("l_discount") / 100))
    flags = clinical.frequency_flags(F.col("af"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", clinical.frequency_band(F.col("af")).alias("band"), clinical.odds_strength(F.col("l_quantity")).alias("strength"), flags["bs1"].alias("bs1"), flags["pm2"].alias("pm2"))


@query("sentence_units")
def sentence_units(spark, sf_dir):
    """F24, F74."""
    each = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(passages.sentences_udf(F.col("text"))).alias("i", "s"))
    return each.select("conv_id", "turn", "i", "s.start", "s.end", "s.text")


@query("evidence_units")
def evidence_units(spark, sf_dir):
    """F32, F66."""
    return corpus.evidence_units(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text"))


@query("masked_conclusions")
def masked_conclusions(spark, sf_dir):
    """F26."""
    said = F.concat(F.col("text"), F.lit(" This variant was classified as pathogenic. PM2 and PP3 criteria were met."))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", passages.masked_udf(said).alias("m"), passages.codes_udf(said).alias("c"))
    return rows.select("conv_id", "turn", "m.text", "m.n_masked", F.size("c").alias("n_codes"))


@query("vector_similarity", """
with v as (select vec_id, embedding::double[] as e, lead(embedding::double[]) over (order by vec_id) as f from embeddings)
select vec_id, list_inner_product(e, f) as dot, list_inner_product(e, f) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(f, f))) as cosine from v where f is not null""")  # fmt: skip
def vector_similarity(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("f"))
    return rows.join(after, "vec_id").select("vec_id", arrays.dot(F.col("embedding"), F.col("f")).alias("dot"), arrays.cosine(F.col("embedding"), F.col("f")).alias("cosine"))


@query("kmer_containment", """
with p as (select p_partkey as k, p_name as s, p_type as t from part),
x as (select k, list_distinct(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))) as a, list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) as b from p)
select k as p_partkey, case when len(a) > 0 then len(list_intersect(a, b)) / len(a)::double else 0 end as containment from x""")  # fmt: skip
def kmer_containment(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.containment(T.kmers(F.col("p_name")), T.kmers(F.col("p_type"))).alias("containment"))
