"""Search queries: benchmark passages as questions over the documents, by words, hashed vectors and fusions of both."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.jobs.registry import query, table
from loomtext.operators import dense as D
from loomtext.operators import fusion as U
from loomtext.operators import lexical as L
from loomtext.operators.chunk import slices
from loomtext.operators.shared import saved, small


def docs_and_questions(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source"), table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


# SQL of the parts; each is a list of common table expressions.
_WORDS = """d as (select doc_id, lang, source, text, regexp_extract_all(lower(text), '[a-z0-9]+') as t from documents),
q as (select item_id as query_id, text as query, regexp_extract_all(lower(text), '[a-z0-9]+') as t from benchmark),
qt as (select query_id, term, count(*) as qtf from (select query_id, unnest(t) as term from q) group by all),
dt as (select doc_id, dl, term, count(*) as tf from (select doc_id, len(t) as dl, unnest(t) as term from d) group by all),
df as (select term, count(*) as df from dt group by term)"""
_BM25 = """, n as (select count(*) as n, avg(len(t)) as avgdl from d),
idf as (select term, ln(n - df + 0.5) - ln(df + 0.5) as idf from df, n),
fl as (select avg(idf) * 0.25 as fl from idf),
bm as (select query_id, doc_id, sum(qtf * (case when idf < 0 then fl else idf end) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score from qt join dt using (term) join idf using (term), n, fl group by all)"""
_OVERLAP = ", ov as (select query_id, doc_id, sum(qtf)::double as score from qt join dt using (term) group by all)"
_HASH = """, dh as (select doc_id, (('0x' || substr(md5(term), 1, 8))::bigint % 256) as b, sum(tf)::double as n from dt group by all),
qh as (select query_id, (('0x' || substr(md5(term), 1, 8))::bigint % 256) as b, sum(qtf)::double as n from qt group by all),
dn as (select doc_id, sqrt(sum(n * n)) as l from dh group by all), qn as (select query_id, sqrt(sum(n * n)) as l from qh group by all),
hs as (select query_id, doc_id, sum(dh.n * qh.n) / (any_value(dn.l) * any_value(qn.l)) as score from dh join qh using (b) join dn using (doc_id) join qn using (query_id) group by all)"""


def _top(of: str, k: int, name: str | None = None, where: str = "true") -> str:
    body = f"(select query_id, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) as rank, doc_id, round(score, 6) as score from {of} where {where})"
    return f", {name} as (select * from {body} where rank <= {k})" if name else f" select query_id, rank, doc_id, score from {body} where rank <= {k}"


@query("bm25_topk", f"with {_WORDS}{_BM25}{_top('bm', 10)}")
def bm25_topk(spark, d):
    return L.bm25_top(*docs_and_questions(spark, d), 10)


_TURNS = _WORDS.replace("item_id as query_id", "concat_ws(':', conv_id, turn) as query_id").replace("from benchmark", "from conversations where role = 'user'")


def _turns(spark, d):
    """What users say, each turn a question."""
    said = table(spark, d, "conversations").where("role = 'user'")
    return said.select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), F.col("text").alias("query"))


@query("bm25_turns", f"with {_TURNS}{_BM25}{_top('bm', 10)}")
def bm25_turns(spark, d):
    """Questions that grow with the data: no task is to hold all of their weights."""
    return L.bm25_top(table(spark, d, "documents"), _turns(spark, d), 10, most=0)


@query("bm25_turns_work")
def bm25_turns_work(spark, d):
    """What the search of bm25_turns reads and scores, beside the postings that a join would make into pairs."""
    docs = table(spark, d, "documents")
    whole = L.Collection.of(docs)
    weights = saved(whole.bm25_weights(L.query_terms(_turns(spark, d))))
    return L.bm25_work(docs, weights, whole)


@query("bm25_positive_split", """with d as (select doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as t from documents),
q as (select item_id as query_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as t from benchmark),
qt as (select query_id, term, count(*) as qtf from (select query_id, unnest(t) as term from q) group by all),
dt as (select doc_id, dl, term, count(*) as tf from (select doc_id, len(t) as dl, unnest(t) as term from d) group by all),
df as (select term, count(*) as df from dt group by term)""" + _BM25 + _top("bm", 5, where="score > 0"))
def bm25_positive_split(spark, d):
    return L.bm25_top(*docs_and_questions(spark, d), 5, lambda c: T.split_words(c, lower=False), positive_only=True)


@query("term_overlap_topk", f"with {_WORDS}{_OVERLAP}{_top('ov', 5)}")
def term_overlap_topk(spark, d):
    return L.overlap_top(*docs_and_questions(spark, d), 5)


@query("tfidf_cosine_topk", f"""with {_WORDS}, n as (select count(*) as n from d), idf as (select term, ln((n + 1) / (df + 1)) + 1 as idf from df, n),
dw as (select doc_id, term, (tf / max(tf) over (partition by doc_id) + 1) * idf as w from dt join idf using (term)),
qw as (select query_id, term, (qtf / m + 1) * idf as w from (select *, max(qtf) over (partition by query_id) as m from qt) join idf using (term)),
dn as (select doc_id, sqrt(sum(w * w)) as l from dw group by all), qn as (select query_id, sqrt(sum(w * w)) as l from qw group by all),
s as (select query_id, doc_id, sum(dw.w * qw.w) / (any_value(dn.l) * any_value(qn.l)) as score from dw join qw using (term) join dn using (doc_id) join qn using (query_id) group by all){_top('s', 5)}""")
def tfidf_cosine_topk(spark, d):
    return L.tfidf_cosine_top(*docs_and_questions(spark, d), 5)


@query("bow_cosine_topk", f"""with {_WORDS}, dn as (select doc_id, sqrt(sum(tf * tf)) as l from dt group by all), qn as (select query_id, sqrt(sum(qtf * qtf)) as l from qt group by all),
s as (select query_id, doc_id, sum(tf * qtf) / (any_value(dn.l) * any_value(qn.l)) as score from dt join qt using (term) join dn using (doc_id) join qn using (query_id) group by all){_top('s', 5)}""")
def bow_cosine_topk(spark, d):
    return L.bow_cosine_top(*docs_and_questions(spark, d), 5)


@query("substring_match", "select doc_id, len(list_filter(['rights', 'token', 'th', 'license'], lambda w: contains(lower(text), w)))::bigint as terms from documents where len(list_filter(['rights', 'token', 'license'], lambda w: contains(lower(text), w))) > 0")
def substring_match(spark, d):
    words = F.array(*map(F.lit, ("rights", "token", "th", "license")))
    held = F.filter(words, lambda w: F.contains(F.lower("text"), w))
    return table(spark, d, "documents").select("doc_id", held.alias("h")).where(F.exists("h", lambda w: w != "th")).select("doc_id", F.size("h").cast("long").alias("terms"))


@query("hash_cosine_topk", f"with {_WORDS}{_HASH}{_top('hs', 5)}")
def hash_cosine_topk(spark, d):
    return D.hashed_top(*docs_and_questions(spark, d), 5, T.tokens)


@query("filter_value_ranked", f"""with {_WORDS}, v as (select unnest(['fr', 'src3']) as value, unnest(['lang', 'source']) as field),
qt as (select value as query_id, value as term, 1 as qtf from v){_HASH.replace(", dh as", ", dh as")},
m as (select field, value, d.doc_id, coalesce(round(hs.score, 6), 0) as score from d join v on value = case field when 'lang' then lang else source end left join hs on hs.query_id = value and hs.doc_id = d.doc_id)
select field, value, row_number() over (partition by field, value order by score desc, m.doc_id) as rank, m.doc_id, score from m qualify rank <= 5""".replace("qt as (select query_id, term, count(*) as qtf from (select query_id, unnest(t) as term from q) group by all),\n", ""))
def filter_value_ranked(spark, d):
    """Documents that a filter `field=value` lets through, in order of their similarity with the filter's value."""
    docs = table(spark, d, "documents")
    return D.filtered_by_value(docs, "lang = fr", 5).unionByName(D.filtered_by_value(docs, "source=src3", 5))


@query("hashing_embedding", f"with {_WORDS}{_HASH} select doc_id, count(*) as buckets, round(max(n / l), 6) as largest from dh join dn using (doc_id) group by doc_id")
def hashing_embedding(spark, d):
    docs, _ = docs_and_questions(spark, d)
    return D.hash_vectors(docs, "doc_id", T.tokens("text")).groupBy("doc_id").agg(F.count("*").alias("buckets"), F.round(F.max("w"), 6).alias("largest"))


def two_lists(spark, d, k: int = 10):
    docs, questions = docs_and_questions(spark, d)
    return saved(U.lists(words=L.bm25_top(docs, questions, k), vectors=D.hashed_top(docs, questions, k, T.tokens)))


_LISTS = f"{_WORDS}{_BM25}{_HASH}{_top('bm', 10, 'l1')}{_top('hs', 10, 'l2')}, r as (select *, 'words' as list_id from l1 union all select *, 'vectors' as list_id from l2)"


@query("rrf_topk", f"with {_LISTS}, f as (select query_id, doc_id, sum(1.0::double / (60 + rank)) as score from r group by all){_top('f', 3)}")
def rrf_topk(spark, d):
    return L.top(U.rrf(two_lists(spark, d)), 3)


@query("rrf_normalized", f"with {_LISTS}, f as (select query_id, doc_id, sum(1.0::double / (60 + rank)) / (2 / 61.0::double) as score from r group by all){_top('f', 3)}")
def rrf_normalized(spark, d):
    return L.top(U.rrf_normalized(two_lists(spark, d), 2), 3)


@query("rrf_zero_based", f"with {_LISTS}, f as (select query_id, doc_id, sum(1.0::double / (59 + rank)) as score from r group by all){_top('f', 5)}")
def rrf_zero_based(spark, d):
    return L.top(U.rrf(two_lists(spark, d), zero_based=True), 5)


@query("rrf_all_documents", f"""with {_WORDS}{_BM25}{_HASH}, p as (select query_id, doc_id from q, d),
s as (select query_id, doc_id, coalesce(round(bm.score, 6), 0) as words, coalesce(round(hs.score, 6), 0) as vectors from p left join bm using (query_id, doc_id) left join hs using (query_id, doc_id)),
r as (select query_id, doc_id, row_number() over (partition by query_id order by words desc, doc_id) as words_rank, row_number() over (partition by query_id order by vectors desc, doc_id) as vectors_rank from s),
f as (select *, round(1.0::double / (59 + words_rank) + 1.0::double / (59 + vectors_rank), 6) as score from r)
select query_id, row_number() over (partition by query_id order by score desc, doc_id) as rank, doc_id, score, words_rank, vectors_rank from f qualify rank <= 10""")
def rrf_all_documents(spark, d):
    """Fusion of two complete rankings: every document has a rank in both, places from zero; the ten best with their ranks."""
    docs, questions = docs_and_questions(spark, d)
    found = L.ranked_everywhere(docs, questions)
    fused = found.withColumn("score", F.round(1.0 / (59 + F.col("words_rank")) + 1.0 / (59 + F.col("vectors_rank")), 6))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")  # tasks keep their ten best of a question
    return fused.withColumn("rank", F.row_number().over(best).cast("long")).where("rank <= 10").select("query_id", "rank", "doc_id", "score", "words_rank", "vectors_rank")


@query("rrf_with_ranks", f"with {_LISTS} select query_id, doc_id, round(sum(1.0::double / (60 + rank)), 6) as score, coalesce(min(rank) filter (list_id = 'words'), -1) as rank_words, coalesce(min(rank) filter (list_id = 'vectors'), -1) as rank_vectors from r group by all")
def rrf_with_ranks(spark, d):
    return U.with_ranks(two_lists(spark, d), ["words", "vectors"]).select("query_id", "doc_id", F.round("score", 6).alias("score"), *[F.coalesce(f"rank_{n}", F.lit(-1)).alias(f"rank_{n}") for n in ("words", "vectors")])


@query("ensemble_minmax", f"""with {_LISTS}, s as (select *, (score - min(score) over w) / coalesce(nullif(max(score) over w - min(score) over w, 0), 1) as s from r window w as (partition by query_id, list_id)),
f as (select query_id, doc_id, sum(s * case list_id when 'words' then 0.4::double else 0.6::double end) as score from s group by all){_top('f', 5)}""")
def ensemble_minmax(spark, d):
    return L.top(U.ensemble(two_lists(spark, d), {"words": 0.4, "vectors": 0.6}), 5)


@query("hybrid_rerank", f"""with {_LISTS}, f as (select query_id, doc_id, sum(1.0::double / (60 + rank)) as score from r group by all){_top('f', 10, 'c')},
g as (select query_id, doc_id, len(list_intersect(list_distinct(q.t), list_distinct(d.t)))::double / len(list_distinct(q.t)) as score from c join q using (query_id) join d using (doc_id)){_top('g', 3)}""")
def hybrid_rerank(spark, d):
    """Fused candidates ranked again by the share of the question's tokens that they hold."""
    docs, questions = docs_and_questions(spark, d)
    pool = saved(L.top(U.rrf(two_lists(spark, d)), 10).select("query_id", "doc_id").join(questions, "query_id"))
    both = docs.select("doc_id", "text").join(small(pool), "doc_id")
    return L.top(both.select("query_id", "doc_id", T.token_share(T.tokens("query"), T.tokens("text")).alias("score")), 3)


def _forms(questions):
    """Each question in three forms, numbered ten times its id plus the form: as it is, its longer words, with a lead-in."""
    forms = F.array(F.col("query"), F.array_join(F.filter(T.tokens("query"), lambda w: F.length(w) > 3), " "), F.concat(F.lit("explain "), "query"))
    return questions.select("query_id", F.posexplode(forms).alias("variant", "query")).select((F.col("query_id") * 10 + F.col("variant")).alias("query_id"), "query")


@query("multi_query_fusion", """with d as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as t from documents),
v as (select item_id as qid, unnest([0, 1, 2]) as variant, text from benchmark),
q as (select qid * 10 + variant as query_id, qid, list_filter(regexp_extract_all(lower(case variant when 2 then 'explain ' || text else text end), '[a-z0-9]+'), lambda w: variant <> 1 or length(w) > 3) as t from v),
qt as (select query_id, qid, term, count(*) as qtf from (select query_id, qid, unnest(t) as term from q) group by all),
dt as (select distinct doc_id, unnest(t) as term from d),
o as (select query_id, qid, doc_id, sum(qtf)::double as score from qt join dt using (term) group by all),
r as (select qid, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as rank from o),
f as (select qid as query_id, doc_id, sum(1.0::double / (60 + rank)) as score from r where rank <= 5 group by all)""" + _top("f", 3))
def multi_query_fusion(spark, d):
    """Three forms of each question (as it is, its longer words, with a lead-in), five documents for each, fused."""
    docs, questions = docs_and_questions(spark, d)
    ranked = L.overlap_top(docs, _forms(questions), 5).withColumn("query_id", F.floor(F.col("query_id") / 10))
    return L.top(U.rrf(ranked), 3)


@query("stepback_compare", f"""with {_WORDS}{_OVERLAP}{_top('ov', 3, 'a')},
bt as (select query_id, term, 1 as qtf from (select query_id, unnest(list_distinct(list_filter(t, lambda w: length(w) > 3))) as term from q)),
b0 as (select query_id, doc_id, count(*)::double as score from bt join dt using (term) group by all){_top('b0', 3, 'b')}
select coalesce(a.query_id, b.query_id) as query_id, coalesce(a.doc_id, b.doc_id) as doc_id, coalesce(a.rank, -1) as direct_rank, coalesce(b.rank, -1) as broad_rank from a full outer join b on a.query_id = b.query_id and a.doc_id = b.doc_id""")
def stepback_compare(spark, d):
    """Results of the question and of a broader one (its distinct longer words), side by side."""
    docs, questions = docs_and_questions(spark, d)
    broad = questions.select("query_id", F.array_join(F.array_distinct(F.filter(T.tokens("query"), lambda w: F.length(w) > 3)), " ").alias("query"))
    a = L.overlap_top(docs, questions, 3).select("query_id", "doc_id", F.col("rank").alias("direct_rank"))
    b = L.overlap_top(docs, broad, 3).select("query_id", "doc_id", F.col("rank").alias("broad_rank"))
    both = a.join(b, ["query_id", "doc_id"], "full_outer")
    return both.select("query_id", "doc_id", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("direct_rank", "broad_rank")])


@query("parent_document_topk", """with p as (select doc_id, unnest(range(0, greatest(length(text), 1), 300)) as s, text from documents),
c as (select doc_id, s, list_distinct(regexp_extract_all(lower(substring(text, s + 1, 300)), '[a-z0-9]+')) as t from p),
ct as (select doc_id, s, unnest(t) as term from c),
qt as (select query_id, term, count(*) as qtf from (select item_id as query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from benchmark) group by all),
o as (select query_id, doc_id, s, sum(qtf) as score from ct join qt using (term) group by all),
r as (select *, row_number() over (partition by query_id order by score desc, doc_id, s) as rank from o)
select query_id, doc_id, min(rank) as best_rank, max(score)::bigint as score from r where rank <= 10 group by all""")
def parent_document_topk(spark, d):
    """Ten best children of 300 characters; their parents by the best child's rank."""
    docs, questions = docs_and_questions(spark, d)
    children = docs.select("doc_id", F.posexplode(slices(F.col("text"), 300)).alias("c", "child"))
    best = L.overlap_top(children, questions, 10, ids=["doc_id", "c"], text="child").withColumn("score", F.col("score").cast("long"))
    return best.groupBy("query_id", "doc_id").agg(F.min("rank").alias("best_rank"), F.max("score").alias("score"))


@query("tenant_hybrid_search", f"""with {_WORDS}{_OVERLAP}, x as (select ov.*, d.lang as tenant, d.source from ov join d using (doc_id)),
r as (select query_id, tenant, doc_id, source, score, row_number() over (partition by query_id, tenant order by score desc, doc_id) as position from x where source <> 'src0')
select query_id, tenant, position, doc_id, source from r where position <= 3""")
def tenant_hybrid_search(spark, d):
    """Each tenant sees its own documents only; a filter on metadata besides; positions are citations."""
    docs, questions = docs_and_questions(spark, d)
    allowed = docs.where("source <> 'src0'")
    best = saved(L.overlap_top(allowed, questions, 3, by="lang"))
    with_source = allowed.select("doc_id", "source").join(small(best), "doc_id")
    return with_source.select("query_id", F.col("lang").alias("tenant"), F.col("rank").alias("position"), "doc_id", "source")


@query("validated_route", f"""with {_WORDS}{_OVERLAP}{_top('ov', 3, 'a')},
v as (select query_id, case when a.score / len(q.t) >= 0.8 then 'correct' when a.score / len(q.t) >= 0.5 then 'ambiguous' else 'wrong' end as verdict from a join q using (query_id))
select query_id, count(*) filter (verdict = 'correct') as correct, case when count(*) filter (verdict = 'correct') >= 2 then 'local' when count(*) filter (verdict <> 'wrong') > 0 then 'both' else 'elsewhere' end as route from v group by query_id""")
def validated_route(spark, d):
    """Three documents are judged by the share of the question that they hold; the verdicts choose where to answer from."""
    docs, questions = docs_and_questions(spark, d)
    near = L.overlap_top(docs, questions, 3).join(questions.select("query_id", F.size(T.tokens("query")).alias("n")), "query_id")
    share = F.col("score") / F.col("n")
    judged = near.select("query_id", F.when(share >= 0.8, "correct").when(share >= 0.5, "ambiguous").otherwise("wrong").alias("v"))
    correct = F.count_if(F.col("v") == "correct")
    route = F.when(correct >= 2, "local").when(F.count_if(F.col("v") != "wrong") > 0, "both").otherwise("elsewhere")
    return judged.groupBy("query_id").agg(correct.alias("correct"), route.alias("route"))


@query("retriever_hit_rates", f"""with {_LISTS}
select list_id, count(*) as questions, round(avg(hit::int), 6) as hit_rate from (select r.list_id, r.query_id, bool_or(r.rank <= 3 and contains(d.text, q.query)) as hit from r join d using (doc_id) join q using (query_id) group by all) group by list_id""")
def retriever_hit_rates(spark, d):
    """For each retriever: how often one of its first three documents holds the question whole."""
    docs, questions = docs_and_questions(spark, d)
    first = saved(two_lists(spark, d).where("rank <= 3").join(questions, "query_id"))
    seen = docs.select("doc_id", "text").join(small(first), "doc_id")
    per = seen.groupBy("list_id", "query_id").agg(F.max(F.contains("text", F.col("query"))).alias("hit"))
    return per.groupBy("list_id").agg(F.count("*").alias("questions"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit_rate"))


_LONG = "list_distinct(list_filter(string_split_regex(trim(regexp_replace(lower({0}), '[ \\t\\n\\x0B\\f\\r?]+', ' ', 'g'), ' '), ' '), lambda w: length(w) > 3))"


@query("long_word_overlap", f"""with d as (select doc_id, unnest({_LONG.format("text")}) as term from documents), q as (select item_id as query_id, unnest({_LONG.format("text")}) as term from benchmark),
s as (select query_id, doc_id, count(*) as score from q join d using (term) group by all),
r as (select query_id, row_number() over (partition by query_id order by score desc, doc_id desc) as rank, doc_id, score from s)
select query_id, rank, doc_id, score::double as score from r where rank <= 3""")
def long_word_overlap(spark, d):
    """Shared words of more than three characters; of ties the later document comes first."""
    docs, questions = docs_and_questions(spark, d)
    words = lambda c: F.array_distinct(F.filter(F.split(F.btrim(F.regexp_replace(F.lower(c), r"[ \t\n\x0B\f\r?]+", " ")), " "), lambda w: F.length(w) > 3))
    turned = docs.select((-F.col("doc_id")).alias("doc_id"), "text")
    found = L.overlap_top(turned, questions, 3, tokenize=words)
    return found.select("query_id", "rank", (-F.col("doc_id")).alias("doc_id"), "score")


@query("bow_cosine_filled", f"""with {_WORDS}, dn as (select doc_id, sqrt(sum(tf * tf)) as l from dt group by all), q2 as (select query_id * 2 as query_id, term, qtf from qt union all select distinct query_id * 2 + 1, 'zzqx' || query_id, 1 from qt), qn as (select query_id, sqrt(sum(qtf * qtf)) as l from q2 group by all),
s as (select query_id, doc_id, sum(tf * qtf) / (any_value(dn.l) * any_value(qn.l)) as score from dt join q2 using (term) join dn using (doc_id) join qn using (query_id) group by all){_top('s', 3, 'a')},
f as (select doc_id, row_number() over (order by doc_id) as rank from d)
select * from a union all select q.query_id, f.rank, f.doc_id, 0.0::double from (select distinct query_id from q2) q, f where f.rank <= 3 and q.query_id not in (select query_id from a)""")
def bow_cosine_filled(spark, d):
    """The nearest documents by word counts; a question that shares no word with any gets the first documents with score 0.
    Each question is asked a second time in words that nobody uses."""
    docs, questions = docs_and_questions(spark, d)
    asked = questions.select((F.col("query_id") * 2).alias("query_id"), "query").unionByName(questions.where(F.size(T.tokens("query")) > 0).select((F.col("query_id") * 2 + 1).alias("query_id"), F.concat(F.lit("zzqx"), F.col("query_id").cast("string")).alias("query")))
    found = saved(L.bow_cosine_top(docs, asked, 3))
    first = docs.select("doc_id").orderBy("doc_id").limit(3).withColumn("rank", F.row_number().over(W.orderBy("doc_id")).cast("long"))  # three rows
    without = asked.select("query_id").join(found.select("query_id").distinct(), "query_id", "left_anti")
    ranks = F.explode(F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)]))
    filled = without.withColumn("rank", ranks).join(F.broadcast(first), "rank")
    return found.unionByName(filled.select("query_id", "rank", "doc_id", F.lit(0.0).alias("score")))


@query("multi_query_merged", """with d as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as t from documents),
v as (select item_id as qid, unnest([0, 1, 2]) as variant, text from benchmark),
q as (select qid, variant, list_filter(regexp_extract_all(lower(case variant when 2 then 'explain ' || text else text end), '[a-z0-9]+'), lambda w: variant <> 1 or length(w) > 3) as t from v),
qt as (select qid, variant, term, count(*) as qtf from (select qid, variant, unnest(t) as term from q) group by all),
dt as (select distinct doc_id, unnest(t) as term from d),
o as (select qid, variant, doc_id, sum(qtf)::double as score from qt join dt using (term) group by all),
r as (select qid, variant, doc_id, row_number() over (partition by qid, variant order by score desc, doc_id) as rank from o),
m as (select qid as query_id, doc_id, min(variant * 1000 + rank) as first_seen from r where rank <= 4 group by all)
select query_id, doc_id, (first_seen // 1000)::bigint as variant, (first_seen % 1000)::bigint as rank from m""")
def multi_query_merged(spark, d):
    """Four documents for each of three forms of a question, each document once, where it came first."""
    docs, questions = docs_and_questions(spark, d)
    ranked = L.overlap_top(docs, _forms(questions), 4)
    first = F.min(F.struct((F.col("query_id") % 10).alias("variant"), "rank"))
    merged = ranked.groupBy(F.floor(F.col("query_id") / 10).alias("query_id"), "doc_id").agg(first.alias("x"))
    return merged.select("query_id", "doc_id", F.col("x.variant").alias("variant"), F.col("x.rank").alias("rank"))


@query("hashed_rerank", f"""with {_LISTS}, f as (select query_id, doc_id, sum(1.0::double / (60 + rank)) as score from r group by all){_top('f', 10, 'c')},
g as (select query_id, doc_id, hs.score from c join hs using (query_id, doc_id)){_top('g', 5)}""")
def hashed_rerank(spark, d):
    """Fused candidates ranked again by the cosine of hashed vectors."""
    docs, questions = docs_and_questions(spark, d)
    pool = saved(L.top(U.rrf(two_lists(spark, d)), 10).select("query_id", "doc_id"))
    near = docs.select("doc_id", "text").join(small(pool.select("doc_id").distinct()), "doc_id")
    of_docs = D.hash_vectors(near, "doc_id", T.tokens("text"))
    of_queries = D.hash_vectors(questions, "query_id", T.tokens("query")).withColumnRenamed("w", "q")
    pairs = pool.join(of_docs, "doc_id").join(of_queries, ["query_id", "bucket"])
    return L.top(pairs.groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("q")).alias("score")), 5)


@query("retriever_bakeoff", f"""with {_LISTS},
x as (select r.list_id, r.query_id, r.rank, d.text, list_distinct(d.t) as t, list_distinct(list_filter(q.t, lambda w: length(w) > 2)) as k, q.query from r join d using (doc_id) join q using (query_id) where r.rank <= 3),
b as (select list_id, query_id, string_agg(lower(text), ' ') as blob, any_value(k) as k, bool_or(contains(text, query)) as hit from x group by all),
p as (select a.list_id, a.query_id, avg(1 - len(list_intersect(a.t, b.t))::double / len(list_distinct(list_concat(a.t, b.t)))) as diversity from x a join x b on a.list_id = b.list_id and a.query_id = b.query_id and a.rank < b.rank group by all)
select list_id, count(*) as questions, round(avg(hit::int), 6) as hit_rate, round(avg(case when len(k) = 0 then 0 else len(list_filter(k, lambda w: contains(blob, w)))::double / len(k) end), 6) as coverage, round(avg(diversity), 6) as diversity from b join p using (list_id, query_id) group by list_id""")
def retriever_bakeoff(spark, d):
    """Two retrievers over all questions, by their first three documents: how often one holds the question whole, the share of
    its key words that they hold, and how little they share with each other."""
    docs, questions = docs_and_questions(spark, d)
    first = saved(two_lists(spark, d).where("rank <= 3").join(questions, "query_id"))
    x = saved(docs.select("doc_id", "text").join(small(first), "doc_id").select("list_id", "query_id", "rank", "text", "query", F.array_distinct(T.tokens("text")).alias("t")))
    keys = F.array_distinct(F.filter(T.tokens("query"), lambda w: F.length(w) > 2))
    blobs = x.groupBy("list_id", "query_id", keys.alias("k")).agg(F.array_join(F.collect_list(F.lower("text")), " ").alias("blob"), F.max(F.contains("text", F.col("query"))).alias("hit"))
    coverage = F.coalesce(F.try_divide(F.size(F.filter("k", lambda w: F.contains(F.col("blob"), w))).cast("double"), F.size("k")), F.lit(0.0))
    a, b = x.alias("a"), x.alias("b")  # three rows for each question on either side
    apart = 1 - F.size(F.array_intersect("a.t", "b.t")) / F.size(F.array_union("a.t", "b.t"))
    pairs = a.join(b, (F.col("a.list_id") == F.col("b.list_id")) & (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.rank") < F.col("b.rank")))
    diversity = pairs.groupBy(F.col("a.list_id").alias("list_id"), F.col("a.query_id").alias("query_id")).agg(F.avg(apart).alias("diversity"))
    each = blobs.select("list_id", "query_id", F.col("hit").cast("int").alias("hit"), coverage.alias("coverage")).join(diversity, ["list_id", "query_id"])
    mean = lambda c: F.round(F.avg(c), 6).alias({"hit": "hit_rate"}.get(c, c))
    return each.groupBy("list_id").agg(F.count("*").alias("questions"), mean("hit"), mean("coverage"), mean("diversity"))
