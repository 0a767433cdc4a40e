"""Queries over rules: personal data, guards, access, tenancy, quality metrics of answers and their gates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtext.functions import guard as G
from loomtext.functions import text as T
from loomtext.jobs.registry import query, table
from loomtext.operators import order as R
from loomtext.operators.grams import supported
from loomtext.operators.predicates import upserted, where, without

_P = {k: v.replace("'", "''") for k, v in G.PII.items()}
_COUNT = ", ".join(f"len(regexp_extract_all(text, '{p}'))::bigint as {k}" for k, p in _P.items())
_REDACT = "text"
for _k, _v in _P.items():
    _REDACT = f"regexp_replace({_REDACT}, '{_v}', '[{_k.upper()}]', 'g')"
_TOKENS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"


@query("pii_counts", f"select doc_id, {_COUNT} from documents")
def pii_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", *[G.found(F.col("text"), k).alias(k) for k in G.PII])


@query("pii_redacted", f"select doc_id, md5({_REDACT}) as key, length({_REDACT})::bigint as chars from documents")
def pii_redacted(spark, d):
    clean = G.redacted(F.col("text"))
    return table(spark, d, "documents").select("doc_id", clean.alias("t")).select("doc_id", F.md5(F.col("t").cast("binary")).alias("key"), F.length("t").cast("long").alias("chars"))


@query("valid_cards", f"""
with c as (select doc_id, unnest(regexp_extract_all(text, '{_P["card"]}')) as c from documents),
s as (select doc_id, c, list_sum(list_transform(range(1, length(c) + 1), lambda i: case when (i % 2) = 1 then substr(c, (length(c) - i + 1)::int, 1)::int when substr(c, (length(c) - i + 1)::int, 1)::int > 4 then substr(c, (length(c) - i + 1)::int, 1)::int * 2 - 9 else substr(c, (length(c) - i + 1)::int, 1)::int * 2 end)) as s from c)
select doc_id, count(*) as runs, count(*) filter (s % 10 = 0) as valid from s group by doc_id""")
def valid_cards(spark, d):
    runs = F.regexp_extract_all("text", F.lit(rf"({G.PII['card']})"), F.lit(1))
    return table(spark, d, "documents").select("doc_id", F.size(runs).cast("long").alias("runs"), F.size(G.valid_cards(F.col("text"))).cast("long").alias("valid")).where("runs > 0")


_INJ = " ".join(f"when regexp_matches(lower(text), '{p}') then '{k}'" for k, p in G.INJECTION.items())


@query("input_guard", """select conv_id, turn, array_to_string(list_filter([case when length(trim(text, ' ')) < 3 then 'short' end, case when length(trim(text, ' ')) > 2000 then 'long' end, """
    + ", ".join(f"case when contains(lower(text), '{t}') then 'topic:{t}' end" for t in G.TOPICS) + ", "
    + ", ".join(f"case when regexp_matches(lower(text), '{p}') then 'injection:{k}' end" for k, p in G.INJECTION.items())
    + "], lambda x: x is not null), ',') as problems from conversations where role = 'user'")
def input_guard(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.array_join(G.input_problems(F.col("text")), ",").alias("problems"))


_TOX = ", ".join(f"'{w}'" for w in G.TOXIC)


@query("toxicity_against_labels", f"""
with t as (select doc_id, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z]+')), [{_TOX}])) > 0 as flagged from documents)
select toxic::bigint as toxic, flagged, count(*) as n from t join labels using (doc_id) where toxic is not null group by all""")
def toxicity_against_labels(spark, d):
    flags = table(spark, d, "documents").select("doc_id", (G.toxic_words(F.col("text")) > 0).alias("flagged"))
    labels = table(spark, d, "labels").where("toxic is not null").select("doc_id", F.col("toxic").cast("long").alias("toxic"))
    return flags.join(labels, "doc_id").groupBy("toxic", "flagged").agg(F.count("*").alias("n"))


@query("output_guard", f"select conv_id, turn, regexp_matches(lower(text), '{G.REFUSAL.replace(chr(39), chr(39) * 2)}') as refuses, regexp_matches(text, '\\[\\d+\\]') as cites, len(regexp_extract_all(text, '{_P['email']}')) > 0 as has_email from conversations where role = 'assistant'")
def output_guard(spark, d):
    t = F.col("text")
    return table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", G.refuses(t).alias("refuses"), t.rlike(r"\[\d+\]").alias("cites"), (G.found(t, "email") > 0).alias("has_email"))


_LEVELS = [("guest", 0), ("staff", 1), ("admin", 2)]


@query("visible_documents", """
with l(role, level) as (values ('guest', 0), ('staff', 1), ('admin', 2)),
d as (select doc_id, case when source in ('src0', 'src1', 'src2') then 0 when substr(source, 4)::int < 10 then 1 else 2 end as class from documents)
select role, count(*) as visible, min(doc_id) as first_id from l join d on class <= level group by role""")
def visible_documents(spark, d):
    """Documents that each role may see. Roles of a document are listed in its row, so no range join is needed."""
    number = F.substring("source", 4, 9).cast("int")
    cls = F.when(F.col("source").isin("src0", "src1", "src2"), 0).when(number < 10, 1).otherwise(2)
    roles = F.array(*[F.when(cls <= level, F.lit(role)) for role, level in _LEVELS])
    return table(spark, d, "documents").select("doc_id", F.explode(F.array_compact(roles)).alias("role")).groupBy("role").agg(F.count("*").alias("visible"), F.min("doc_id").alias("first_id"))


@query("filter_operators", """select count(*) filter (event_type = 'click') as eq, count(*) filter (event_type <> 'click') as ne, count(*) filter (event_type in ('view', 'error')) as in_list, count(*) filter (event_type not in ('view', 'error')) as not_in,
count(*) filter (value >= 10 and value <= 50) as ranged, count(*) filter (event_type = 'click' or value > 80) as either, count(*) filter (user_id < 50 and (event_type = 'view' or value < 5)) as nested from events""")
def filter_operators(spark, d):
    specs = {
        "eq": {"event_type": "click"}, "ne": {"event_type": {"$ne": "click"}}, "in_list": {"event_type": {"$in": ["view", "error"]}}, "not_in": {"event_type": {"$nin": ["view", "error"]}},
        "ranged": {"$and": [{"value": {"$gte": 10}}, {"value": {"$lte": 50}}]}, "either": {"$or": [{"event_type": "click"}, {"value": {"$gt": 80}}]},
        "nested": {"$and": [{"user_id": {"$lt": 50}}, {"$or": [{"event_type": "view"}, {"value": {"$lt": 5}}]}]},
    }
    return table(spark, d, "events").agg(*[F.count_if(where(s)).alias(k) for k, s in specs.items()])


@query("filter_date_key", "select o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders where year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) between 19950101 and 19961231 group by o_orderpriority")
def filter_date_key(spark, d):
    """The range of date keys is a range of dates, which reaches the scan."""
    o = table(spark, d, "orders").where((F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp")) & (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp")))
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("upserted_documents", "select lang, count(*) as n, sum(n_chars)::bigint as chars from (select lang, n_chars from documents where doc_id % 7 <> 0 union all select 'new', n_chars + 1 from documents where doc_id % 7 = 0 union all select 'added', 1 from documents where doc_id % 50 = 0) group by lang")
def upserted_documents(spark, d):
    old = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    changed = old.where("doc_id % 7 = 0").select("doc_id", F.lit("new").alias("lang"), (F.col("n_chars") + 1).alias("n_chars"))
    added = old.where("doc_id % 50 = 0").select((-F.col("doc_id") - 1).alias("doc_id"), F.lit("added").alias("lang"), F.lit(1).cast("long").alias("n_chars"))
    return upserted(old, changed.unionByName(added), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("deleted_documents", "select source, count(*) as n from documents where not (lang = 'de' or n_chars < 100) and doc_id not in (select doc_id from labels where toxic = 1) group by source")
def deleted_documents(spark, d):
    docs, toxic = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return without(docs.where(~where({"$or": [{"lang": "de"}, {"n_chars": {"$lt": 100}}]})), toxic, "doc_id").groupBy("source").agg(F.count("*").alias("n"))


@query("set_operations", """
with a as (select doc_id from documents where lang = 'en'), b as (select doc_id from labels)
select 'both' as part, count(*) as n from (select * from a intersect select * from b) union all select 'either', count(*) from (select * from a union select * from b) union all
select 'unlabelled', count(*) from (select * from a except select * from b) union all select 'all', count(*) from (select * from a union all select * from b)""")
def set_operations(spark, d):
    a, b = table(spark, d, "documents").where("lang = 'en'").select("doc_id"), table(spark, d, "labels").select("doc_id")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return count(a.intersect(b), "both").unionByName(count(a.union(b).distinct(), "either")).unionByName(count(a.exceptAll(b.distinct()).distinct(), "unlabelled")).unionByName(count(a.union(b), "all"))


@query("full_outer_scores", "select coalesce(d.doc_id, l.doc_id) as doc_id, coalesce(quality, -1)::bigint as quality, coalesce(n_chars, 0) as n_chars from documents d full outer join labels l on l.doc_id = d.doc_id")
def full_outer_scores(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "full_outer").select("doc_id", F.coalesce("quality", F.lit(-1)).cast("long").alias("quality"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))


@query("stratified_split", """
with r as (select doc_id, quality, row_number() over (partition by quality order by doc_id) as i, count(*) over (partition by quality) as n from labels)
select doc_id, quality::bigint as quality, case when i <= greatest(1, round_even(n * 0.25, 0)) then 'validation' else 'training' end as part from r""")
def stratified_split(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"))
    last = R.at_ranks(labels, "quality", "doc_id", lambda n: {"last": F.greatest(F.lit(1), F.bround(n * 0.25))}).select(F.col("quality").alias("of"), "last")
    split = labels.join(F.broadcast(last), F.col("quality").eqNullSafe(F.col("of")))  # a row for each stratum
    return split.select("doc_id", "quality", F.when(F.col("doc_id") <= F.col("last"), "validation").otherwise("training").alias("part"))


_PAIR = "with p as (select conv_id, turn, role, text as q, lead(role) over w as next_role, lead(text) over w as a from conversations window w as (partition by conv_id order by turn))"


def _answers(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("q"), F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("a"))
    return c.where("role = 'user' and next_role = 'assistant'").drop("role", "next_role")


@query("answer_metrics", f"""{_PAIR}, t as (select conv_id, turn, {_TOKENS.format('q')} as q, {_TOKENS.format('a')} as a, a as raw from p where role = 'user' and next_role = 'assistant')
select conv_id, turn, round(case when len(a) = 0 then 1 else len(list_intersect(a, q))::double / len(a) end, 6) as faithfulness, round(case when len(q) = 0 then 1 else len(list_intersect(q, a))::double / len(q) end, 6) as correctness,
round(case when len(q) = 0 then 0 else len(list_filter(q, lambda x: contains(lower(raw), x)))::double / len(q) end, 6) as coverage from t""")
def answer_metrics(spark, d):
    q, a = F.array_distinct(T.tokens("q")), F.array_distinct(T.tokens("a"))
    held = F.filter(q, lambda x: F.contains(F.lower("a"), x))
    return _answers(spark, d).select(
        "conv_id", "turn", F.round(F.coalesce(T.token_share(a, q), F.lit(1.0)), 6).alias("faithfulness"), F.round(F.coalesce(T.token_share(q, a), F.lit(1.0)), 6).alias("correctness"),
        F.round(F.when(F.size(q) == 0, 0.0).otherwise(F.size(held) / F.size(q)), 6).alias("coverage"),
    )


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query("trigram_faithfulness", f"""{_PAIR}, t as (select conv_id, turn, regexp_extract_all(lower(q), '[a-z0-9]+') as q, regexp_extract_all(lower(a), '[a-z0-9]+') as a from p where role = 'user' and next_role = 'assistant'),
g as (select conv_id, turn, q as qt, list_filter(a, lambda w: w not in ({_STOP})) as aw, list_transform(range(1, greatest(len(a) - 1, 1)), lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2]) as a, list_transform(range(1, greatest(len(q) - 1, 1)), lambda i: q[i] || ' ' || q[i + 1] || ' ' || q[i + 2]) as q from t)
select conv_id, turn, round(case when len(a) > 0 then len(list_filter(a, lambda x: list_contains(q, x)))::double / len(a) when len(aw) > 0 then len(list_filter(aw, lambda x: list_contains(qt, x)))::double / len(aw) else 1 end, 6) as faithfulness from g""")
def trigram_faithfulness(spark, d):
    """Share of the answer's trigrams that the context holds; without trigrams of its words but stop words; 1 without those."""
    words = _answers(spark, d).select("conv_id", "turn", T.tokens("a").alias("a"), T.tokens("q").alias("q"))
    return supported(words, T.STOPWORDS).select("conv_id", "turn", F.round("share", 6).alias("faithfulness"))


_SPLIT = r"list_filter(string_split(regexp_replace({0}, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')"
_BUCKETS = "list_transform(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: ('0x' || substr(md5(w), 1, 8))::bigint % 256)"
_DOT = "coalesce(list_sum(list_transform({0}, lambda i: len(list_filter({1}, lambda j: j = i)))), 0)::double"


def _cos(a: str, b: str) -> str:
    return f"coalesce({_DOT.format(a, b)} / nullif(sqrt({_DOT.format(a, a)} * {_DOT.format(b, b)}), 0), 0)"


@query("vector_answer_metrics", f"""{_PAIR}, t as (select conv_id, turn, list_transform({_SPLIT.format("q")}, lambda s: {_BUCKETS.format("s")}) as c, list_transform({_SPLIT.format("a")}, lambda s: {_BUCKETS.format("s")}) as s, {_BUCKETS.format("q")} as q, {_BUCKETS.format("a")} as a from p where role = 'user' and next_role = 'assistant'),
m as (select conv_id, turn, list_transform(s, lambda x: coalesce(list_max(list_transform(c, lambda y: {_cos("x", "y")})), 0)) as best, list_transform(c, lambda x: greatest(0, {_cos("x", "a")})) as near, {_cos("q", "a")} as relevancy, s, c from t)
select conv_id, turn, round(case when len(best) = 0 then 0 else len(list_filter(best, lambda x: x >= 0.3))::double / len(best) end, 6) as faithfulness_share, round(case when len(best) = 0 then 0 else greatest(0, least(1, list_avg(best))) end, 6) as faithfulness_mean,
round(coalesce(list_avg(near), 0), 6) as context_precision, round(case when len(c) = 0 then 0 else len(list_filter(list_transform(c, lambda x: coalesce(list_max(list_transform(s, lambda y: {_cos("x", "y")})), 0)), lambda x: x >= 0.3))::double / len(c) end, 6) as context_recall, round(greatest(0, relevancy), 6) as answer_relevancy from m""")
def vector_answer_metrics(spark, d):
    """Over hashed vectors, the question's sentences as contexts and as the reference's facts: the share of the answer's
    sentences with a context at 0.3 or more, and the mean of their best contexts, clamped; the mean similarity of contexts with
    the answer; the share of facts that the answer holds at 0.3; the answer's similarity with the question."""
    cut = lambda c: F.transform(T.sentences(c), lambda s: T.buckets(s))
    t = _answers(spark, d).select("conv_id", "turn", cut("q").alias("c"), cut("a").alias("s"), T.buckets("q").alias("q"), T.buckets("a").alias("a"))
    best = lambda of, among: F.transform(of, lambda x: F.coalesce(F.array_max(F.transform(among, lambda y: T.bag_cosine(x, y))), F.lit(0.0)))
    near = F.transform("c", lambda x: F.greatest(F.lit(0.0), T.bag_cosine(x, F.col("a"))))
    m = t.select("conv_id", "turn", best("s", "c").alias("best"), best("c", "s").alias("held"), near.alias("near"), T.bag_cosine(F.col("q"), F.col("a")).alias("r"))
    mean = lambda c: F.coalesce(F.try_divide(F.aggregate(c, F.lit(0.0), lambda x, y: x + y), F.size(c)), F.lit(0.0))
    share = lambda c: F.coalesce(F.try_divide(F.size(F.filter(c, lambda x: x >= 0.3)).cast("double"), F.size(c)), F.lit(0.0))
    scores = {"faithfulness_share": share("best"), "faithfulness_mean": F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean("best"))), "context_precision": mean("near"), "context_recall": share("held"), "answer_relevancy": F.greatest(F.lit(0.0), F.col("r"))}
    return m.select("conv_id", "turn", *[F.round(v, 6).alias(k) for k, v in scores.items()])


_FACTS = r"list_filter(flatten(list_transform({0}, lambda s: list_transform(regexp_split_to_array(s, '[;,]'), lambda x: trim(x, ' .;:')))), lambda x: x <> '')"


@query("composite_scores", f"""{_PAIR}, t as (select conv_id, turn, lower(q) as context, {_FACTS.format(_SPLIT.format("a"))} as facts, {_TOKENS.format('q')} as e, {_TOKENS.format('a')} as a from p where role = 'user' and next_role = 'assistant'),
s as (select conv_id, turn, case when len(facts) = 0 then 1 else len(list_filter(facts, lambda f: len(list_filter(regexp_extract_all(lower(f), '[a-z0-9]+'), lambda w: w not in ({_STOP}) and not contains(context, w))) = 0))::double / len(facts) end as r, case when len(e) = 0 then 1 else len(list_intersect(a, e))::double / len(e) end as c, case when len(a) = 0 then 1 else len(list_intersect(a, e))::double / len(a) end as f from t)
select conv_id, turn, round(r, 6) as recall, round(c, 6) as correctness, round((r + c + f) / 3, 4) as composite from s""")
def composite_scores(spark, d):
    """The share of the answer's facts whose every word the context holds, the share of expected words that it says, the share
    of its words that the context holds, and the mean of the three."""
    facts, context = T.facts("a"), F.lower("q")
    held = F.filter(facts, lambda f: F.forall(F.filter(T.tokens(f), lambda w: ~w.isin(T.STOPWORDS)), lambda w: F.contains(context, w)))
    e, a = F.array_distinct(T.tokens("q")), F.array_distinct(T.tokens("a"))
    one = F.lit(1.0)
    s = _answers(spark, d).select("conv_id", "turn", F.coalesce(F.try_divide(F.size(held).cast("double"), F.size(facts)), one).alias("r"), F.coalesce(T.token_share(e, a), one).alias("c"), F.coalesce(T.token_share(a, e), one).alias("f"))
    return s.select("conv_id", "turn", F.round("r", 6).alias("recall"), F.round("c", 6).alias("correctness"), F.round((F.col("r") + F.col("c") + F.col("f")) / 3, 4).alias("composite"))


@query("pii_one_pass")
def pii_one_pass(spark, d):
    """Personal data of the single pass: counts by kind, and the text with placeholders by its md5."""
    f = table(spark, d, "documents").select("doc_id", "text", G.one_pass(F.col("text")).alias("f"))
    count = lambda k: F.size(F.filter("f", lambda x: (x["kind"] == k) & ~x["keep"])).cast("long").alias(k)
    return f.select("doc_id", *map(count, G.ONE_PASS), F.md5(G.one_pass_redacted(F.col("text"), F.col("f")).cast("binary")).alias("key"))


@query("pii_places")
def pii_places(spark, d):
    """Each finding of the single pass with its value and place."""
    return table(spark, d, "documents").select("doc_id", F.explode(G.pii_spans("text")).alias("x")).select("doc_id", "x.kind", "x.value", "x.start", "x.end")


_COUNTED, _STEPS = "text", []
for _k, _v in _P.items():
    _STEPS.append(f"len(regexp_extract_all({_COUNTED}, '{_v}'))::bigint as {_k}")
    _COUNTED = f"regexp_replace({_COUNTED}, '{_v}', '[{_k.upper()}]', 'g')"


@query("pii_redacted_counts", f"select doc_id, {', '.join(_STEPS)}, length({_COUNTED})::bigint as chars from documents")
def pii_redacted_counts(spark, d):
    """How often each kind was replaced in what the kinds before it had left."""
    clean, counts = G.counted_redaction(F.col("text"))
    return table(spark, d, "documents").select("doc_id", *[c.alias(k) for k, c in counts.items()], F.length(clean).cast("long").alias("chars"))


_INJECTED = " or ".join(f"regexp_matches(lower(q), '{p}')" for p in G.INJECTION.values())
_ASKED_BADLY = f"length(trim(q, ' ')) < 3 or length(trim(q, ' ')) > 2000 or {' or '.join(f"contains(lower(q), '{t}')" for t in G.TOPICS)} or {_INJECTED}"
_TOXIC_SQL = f"len(list_intersect(list_distinct(regexp_extract_all(lower(a), '[a-z]+')), [{', '.join(repr(w) for w in G.TOXIC)}])) > 0"


@query("guarded_answers", f"""{_PAIR}, t as (select conv_id, turn, q, a, {_ASKED_BADLY} as blocked, {_TOXIC_SQL} as toxic, regexp_matches(lower(a), '{G.REFUSAL.replace(chr(39), chr(39) * 2)}') as refuses, regexp_matches(a, '\\[\\d+\\]') as cites, {_REDACT.replace("text", "a", 1)} as clean from p where role = 'user' and next_role = 'assistant')
select conv_id, turn, case when blocked then 'input' else 'output' end as stage, not blocked and not toxic as passed, case when blocked then 'block' when toxic or refuses or not cites or clean <> a then 'sanitize' else 'pass' end as action, case when not blocked then md5(clean) end as answer_key from t""")
def guarded_answers(spark, d):
    """Two stages: a question that isn't taken ends at the first; of an answer, only toxic words fail, and personal data, a
    refusal or a missing citation ask for changes."""
    blocked, a = F.size(G.input_problems(F.col("q"))) > 0, F.col("a")
    t = _answers(spark, d).select("conv_id", "turn", "a", blocked.alias("blocked"), (G.toxic_words(a) > 0).alias("toxic"), G.refuses(a).alias("refuses"), a.rlike(r"\[\d+\]").alias("cites"), G.redacted(a).alias("clean"))
    notes = F.col("toxic") | F.col("refuses") | ~F.col("cites") | (F.col("clean") != F.col("a"))
    return t.select(
        "conv_id", "turn", F.when(F.col("blocked"), "input").otherwise("output").alias("stage"), (~F.col("blocked") & ~F.col("toxic")).alias("passed"),
        F.when(F.col("blocked"), "block").when(notes, "sanitize").otherwise("pass").alias("action"), F.when(~F.col("blocked"), F.md5(F.col("clean").cast("binary"))).alias("answer_key"),
    )


_SCORES = "s as (select doc_id, source, (doc_id * 37 % 101) / 100.0::double as baseline, (doc_id * 53 % 97) / 100.0::double as current from documents)"


def _scores(spark, d):
    """Two runs' scores for each document, from its id."""
    base, cur = (F.col("doc_id") * 37 % 101) / 100, (F.col("doc_id") * 53 % 97) / 100
    return table(spark, d, "documents").select("doc_id", "source", base.alias("baseline"), cur.alias("current"))


@query("ab_comparison", f"with {_SCORES} select case when abs(current - baseline) < 0.01 then 'tie' when current > baseline then 'b' else 'a' end as winner, count(*) as n, round(avg(current - baseline), 6) + 0.0 as mean_gain from s group by 1")
def ab_comparison(spark, d):
    gain = F.col("current") - F.col("baseline")
    winner = F.when(F.abs(gain) < 0.01, "tie").when(gain > 0, "b").otherwise("a")
    return _scores(spark, d).groupBy(winner.alias("winner")).agg(F.count("*").alias("n"), (F.round(F.avg(gain), 6) + 0.0).alias("mean_gain"))


@query("regression_gate", f"with {_SCORES}, m as (select source, avg(baseline) as b, avg(current) filter (doc_id % 20 <> 3) as c from s group by source) select source, round(b, 6) as baseline, round(coalesce(c, 0), 6) as current, coalesce(c, 0) - b < -0.05 as regressed from m")
def regression_gate(spark, d):
    m = _scores(spark, d).groupBy("source").agg(F.avg("baseline").alias("b"), F.coalesce(F.avg(F.when(F.col("doc_id") % 20 != 3, F.col("current"))), F.lit(0.0)).alias("c"))
    return m.select("source", F.round("b", 6).alias("baseline"), F.round("c", 6).alias("current"), (F.col("c") - F.col("b") < -0.05).alias("regressed"))


@query("weighted_choice", "with x as (select source as option, avg(n_chars) / 1000 as size, count(*)::double as n, count(distinct lang)::double as langs from documents group by source) select arg_max(option, (round(0.5 * size + 0.3 * n / 100 + 0.2 * langs, 6), option)) as best, round(max(round(0.5 * size + 0.3 * n / 100 + 0.2 * langs, 6)), 6) as score from x")
def weighted_choice(spark, d):
    x = table(spark, d, "documents").groupBy("source").agg((F.avg("n_chars") / 1000).alias("size"), F.count("*").alias("n"), F.countDistinct("lang").alias("langs"))
    score = F.round(0.5 * F.col("size") + 0.3 * F.col("n") / 100 + 0.2 * F.col("langs"), 6)
    return x.select("source", score.alias("s")).agg(F.max_by("source", F.struct("s", "source")).alias("best"), F.max("s").alias("score"))
