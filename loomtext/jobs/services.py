"""Queries behind the services: lookups, audits, routing, compression, signals, templates, benchmark verdicts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtext.functions import guard as G
from loomtext.functions import text as T
from loomtext.jobs.registry import query, table
from loomtext.jobs.retrieval import _OVERLAP, _WORDS, _top, docs_and_questions
from loomtext.operators.chunk import slices
from loomtext.operators import dense as D
from loomtext.operators import lexical as L
from loomtext.operators.shared import saved, small


@query("order_lookup", """select c.conv_id, coalesce(o.o_orderstatus, 'not found') as status, round(coalesce(o.o_totalprice, 0), 2) as total from (select distinct conv_id from conversations) c left join orders o on o.o_orderkey = c.conv_id * 3""")
def order_lookup(spark, d):
    asked = table(spark, d, "conversations").select("conv_id", (F.col("conv_id") * 3).alias("o_orderkey")).distinct()
    found = asked.join(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderkey", "left")
    return found.select("conv_id", F.coalesce("o_orderstatus", F.lit("not found")).alias("status"), F.round(F.coalesce("o_totalprice", F.lit(0.0)), 2).alias("total"))


@query("documents_by_id", "select doc_id, lang, n_chars from documents where doc_id in (3, 14, 15, 92, 65, 1000000)")
def documents_by_id(spark, d):
    return table(spark, d, "documents").where(F.col("doc_id").isin(3, 14, 15, 92, 65, 1000000)).select("doc_id", "lang", "n_chars")


@query("collection_counts", "select label::bigint as label, count(*) as n, min(len(embedding))::bigint as dims, bool_and(len(embedding) = 64) as uniform from embeddings group by label")
def collection_counts(spark, d):
    size = F.size("embedding")
    return table(spark, d, "embeddings").groupBy(F.col("label").cast("long").alias("label")).agg(F.count("*").alias("n"), F.min(size).cast("long").alias("dims"), F.bool_and(size == 64).alias("uniform"))


@query("tool_audit", """with c(user_id, key) as (select distinct user_id, 'k' || user_id from events where user_id % 10 <> 0),
a as (select e.event_id, case when c.key is null then 'unknown client' when e.event_type = 'signup' then 'unknown tool' when e.value is null then 'error' else 'ok' end as reason from events e left join c using (user_id))
select reason, reason = 'ok' as allowed, count(*) as n, min(event_id) as first_event from a group by all""")
def tool_audit(spark, d):
    """Every attempt gets an entry: clients without a key and calls of tools that aren't registered are refused."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    keys = e.where("user_id % 10 <> 0").select("user_id").distinct().withColumn("key", F.concat(F.lit("k"), "user_id"))
    reason = F.when(F.col("key").isNull(), "unknown client").when(F.col("event_type") == "signup", "unknown tool").when(F.col("value").isNull(), "error").otherwise("ok")
    return e.join(keys, "user_id", "left").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event")).select("reason", (F.col("reason") == "ok").alias("allowed"), "n", "first_event")


@query("config_problems", "select p_partkey, array_to_string(list_filter([case when p_size < 5 then 'size' end, case when p_retailprice > 1500 then 'price' end, case when not regexp_matches(p_brand, '^Brand#[0-9]+$') then 'brand' end], lambda x: x is not null), ',') as problems from part")
def config_problems(spark, d):
    rules = {"size": F.col("p_size") < 5, "price": F.col("p_retailprice") > 1500, "brand": ~F.col("p_brand").rlike("^Brand#[0-9]+$")}
    return table(spark, d, "part").select("p_partkey", F.array_join(G.problems(rules), ",").alias("problems"))


@query("ticket_flow", """select o_orderkey, case when o_orderstatus is null then 'collect > reject' when o_totalprice > 200000 then 'collect > verify > approve > ' || case when o_orderkey % 2 = 0 then 'refund' else 'decline' end else 'collect > verify > answer' end as path from orders""")
def ticket_flow(spark, d):
    """The states that each order's ticket passes; large sums wait for a person's approval."""
    human = F.concat(F.lit("collect > verify > approve > "), F.when(F.col("o_orderkey") % 2 == 0, "refund").otherwise("decline"))
    path = F.when(F.col("o_orderstatus").isNull(), "collect > reject").when(F.col("o_totalprice") > 200000, human).otherwise("collect > verify > answer")
    return table(spark, d, "orders").select("o_orderkey", path.alias("path"))


@query("energy_envelope", "with f as (select user_id, (row_number() over (partition by user_id order by event_id) - 1) // 8 as frame, value from events) select user_id, frame, round(sqrt(avg(value * value)), 6) as energy from f group by all having count(*) = 8")
def energy_envelope(spark, d):
    """Root mean square of frames of eight values of each user's signal; a frame that isn't full is dropped."""
    w = W.partitionBy("user_id").orderBy("event_id")
    f = table(spark, d, "events").select("user_id", F.floor((F.row_number().over(w) - 1) / 8).alias("frame"), "value")
    return f.groupBy("user_id", "frame").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("e"), F.count("*").alias("n")).where("n = 8").select("user_id", "frame", F.round("e", 6).alias("energy"))


@query("chat_templates", "select conv_id, turn, '<|' || role || '|>' || chr(10) || text || '<|end|>' as line, 'data: {\"turn\":' || turn || '}' as frame from conversations")
def chat_templates(spark, d):
    t = F.col("turn").cast("string")
    line = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("<|end|>"))
    return table(spark, d, "conversations").select("conv_id", "turn", line.alias("line"), F.concat(F.lit('data: {"turn":'), t, F.lit("}")).alias("frame"))


_SENTENCE = r"list_filter(string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')"


@query("compressed_context", f"""with {_WORDS}{_OVERLAP}{_top('ov', 3, 'a')},
s as (select a.query_id, a.doc_id, d.text, list_filter({_SENTENCE}, lambda x: len(list_intersect(list_distinct(regexp_extract_all(lower(x), '[a-z0-9]+')), list_filter(list_distinct(q.t), lambda w: length(w) > 5))) >= 3) as kept from a join d using (doc_id) join q using (query_id))
select query_id, doc_id, len(kept)::bigint as sentences, coalesce(list_sum(list_transform(kept, lambda x: length(x))), 0)::bigint as chars, round(1 - coalesce(list_sum(list_transform(kept, lambda x: length(x))), 0)::double / length(text), 6) as saved from s""")
def compressed_context(spark, d):
    """Of three documents for each question, the sentences that share three of its longer words; and the share left out."""
    docs, questions = docs_and_questions(spark, d)
    first = saved(L.overlap_top(docs, questions, 3).select("query_id", "doc_id").join(questions, "query_id"))
    near = docs.select("doc_id", "text").join(small(first), "doc_id")
    asked = F.filter(F.array_distinct(T.tokens("query")), lambda w: F.length(w) > 5)
    rows = near.select("query_id", "doc_id", "text", asked.alias("asked"), T.sentences("text").alias("s"))
    kept = F.filter("s", lambda x: F.size(F.array_intersect(F.array_distinct(T.tokens(x)), F.col("asked"))) >= 3)
    chars = F.coalesce(F.aggregate(F.transform("kept", F.length), F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    return rows.withColumn("kept", kept).select("query_id", "doc_id", F.size("kept").cast("long").alias("sentences"), chars.alias("chars"), F.round(1 - chars / F.length("text"), 6).alias("saved"))


@query("visible_substring_search", """with d as (select doc_id, lower(text) as t from documents where source in ('src0', 'src1', 'src2', 'src3')),
s as (select doc_id, len(list_filter(['token', 'license', 'rights', 'mail'], lambda w: contains(t, w)))::bigint as score from d)
select doc_id, score from s where score > 0 order by score desc, doc_id limit 3""")
def visible_substring_search(spark, d):
    words = F.array(*map(F.lit, ("token", "license", "rights", "mail")))
    visible = table(spark, d, "documents").where(F.col("source").isin("src0", "src1", "src2", "src3"))
    score = F.size(F.filter(words, lambda w: F.contains(F.lower("text"), w))).cast("long")
    return visible.select("doc_id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(3)


@query("cross_modal_search", """with v as (select vec_id, label % 2 as modality, embedding::double[] as e from embeddings),
r as (select q.vec_id as query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) as score, row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.e, v.e), 6) desc, v.vec_id) as rank from v q, v where q.vec_id % 50 = 0 and q.modality = 0 and v.modality = 1)
select query_id, rank, vec_id, score from r where rank <= 3""")
def cross_modal_search(spark, d):
    """Vectors of one modality (even labels) as queries against those of the other."""
    v = table(spark, d, "embeddings")
    return D.knn(v.where("label % 2 = 1"), v.where("vec_id % 50 = 0 and label % 2 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 3)


@query("retrieval_proxy", f"""with {_WORDS}, c as (select doc_id, unnest(range(0, greatest(length(text), 1), 512)) as s, text from documents),
ct as (select doc_id, s, list_distinct(regexp_extract_all(lower(substring(text, s + 1, 512)), '[a-z0-9]+')) as t from c), cu as (select doc_id, s, len(t) as n, unnest(t) as term from ct),
qd as (select query_id, list_distinct(t) as t from q), qu as (select query_id, len(t) as m, unnest(t) as term from qd),
f as (select query_id, doc_id, s, 2.0::double * count(*) / (any_value(n) + any_value(m)) as f1 from cu join qu using (term) group by query_id, doc_id, s)
select count(*) as questions, round(avg(best), 6) as mean_best from (select query_id, max(f1) as best from f group by query_id)""")
def retrieval_proxy(spark, d):
    """Mean over questions of the best token F1 of any chunk of 512 characters."""
    docs, questions = docs_and_questions(spark, d)
    cut = slices(F.col("text"), 512)
    chunks = docs.select("doc_id", F.posexplode(cut).alias("c", "chunk")).select("doc_id", "c", F.array_distinct(T.tokens("chunk")).alias("t"))
    best = L.token_f1_top(chunks, questions, 1, ["doc_id", "c"], "t")
    return best.agg(F.count("*").alias("questions"), F.round(F.avg("score"), 6).alias("mean_best"))


@query("benchmark_verdicts", """with s as (select l_suppkey % 20 as task, avg(l_discount) filter (l_returnflag = 'A') as base, avg(l_discount) filter (l_returnflag = 'R') as tuned from lineitem group by 1)
select task, round(tuned - base, 6) as gain, case when tuned - base > 0.001 then 'better' when tuned - base < -0.001 then 'worse' else 'same' end as verdict from s where base is not null and tuned is not null""")
def benchmark_verdicts(spark, d):
    flag = lambda x: F.avg(F.when(F.col("l_returnflag") == x, F.col("l_discount")))
    s = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("task")).agg(flag("A").alias("base"), flag("R").alias("tuned")).where("base is not null and tuned is not null")
    gain = F.col("tuned") - F.col("base")
    return s.select("task", F.round(gain, 6).alias("gain"), F.when(gain > 0.001, "better").when(gain < -0.001, "worse").otherwise("same").alias("verdict"))


@query("first_sources", "with f as (select source, min(doc_id) as first_id from documents group by source) select row_number() over (order by first_id) as position, source, first_id from f")
def first_sources(spark, d):
    """Distinct sources in the order of their first document, numbered: a row for each source, not for each document."""
    f = table(spark, d, "documents").groupBy("source").agg(F.min("doc_id").alias("first_id"))
    return f.withColumn("position", F.row_number().over(W.orderBy("first_id")).cast("long")).select("position", "source", "first_id")
