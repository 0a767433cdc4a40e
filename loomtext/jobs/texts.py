"""Queries over document texts: inventory, tokens, ids, costs, extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.jobs.registry import query, table

STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
#: Price of a million tokens in by model, the default last (fixed values).
PRICES = {"small": 0.15, "large": 2.50, "light": 0.25}
DEFAULT_PRICE = 1.00


@query("doc_inventory", "select source, count(*) as n, sum(n_chars)::bigint as chars, round(avg(n_chars), 2) as mean_chars, min(doc_id) as first_id from documents group by source")
def doc_inventory(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 2).alias("mean_chars"), F.min("doc_id").alias("first_id"))


@query("doc_language_counts", "select lang, count(*) as n, count(distinct source) as sources from documents where n_chars >= 20 group by lang")
def doc_language_counts(spark, d):
    return table(spark, d, "documents").where("n_chars >= 20").groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))


@query("token_stats", "select doc_id, len(t)::bigint as tokens, len(list_distinct(t))::bigint as distinct_tokens, greatest(1, floor(length(text) / 4))::bigint as estimate from (select doc_id, text, regexp_extract_all(lower(text), '[a-z0-9]+') as t from documents)")
def token_stats(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text", T.tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("tokens"), F.size(F.array_distinct("t")).cast("long").alias("distinct_tokens"), T.estimated_tokens("text").alias("estimate"))


@query("key_terms", rf"""
with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9''\-]*')) as w, generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9''\-]*'), 1) as i from documents),
f as (select doc_id, w, min(i) as i from t where w not in ({STOP}) group by doc_id, w)
select d.doc_id, count(f.w) as terms, coalesce(string_agg(f.w, ' ' order by f.i), '') as listed from documents d left join f using (doc_id) group by d.doc_id""")
def key_terms(spark, d):
    k = table(spark, d, "documents").select("doc_id", T.key_terms("text").alias("k"))
    return k.select("doc_id", F.size("k").cast("long").alias("terms"), F.array_join("k", " ").alias("listed"))


@query("sentence_stats", r"""
with s as (select doc_id, list_filter(string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') as s from documents)
select doc_id, len(s)::bigint as sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::bigint as longest from s""")
def sentence_stats(spark, d):
    s = table(spark, d, "documents").select("doc_id", T.sentences("text").alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("sentences"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).cast("long").alias("longest"))


@query("fact_stats", r"""
with s as (select doc_id, unnest(list_filter(string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) as s from documents),
f as (select doc_id, trim(unnest(regexp_split_to_array(s, '[;,]')), ' .;:') as f from s)
select doc_id, count(*) as facts, sum(length(f))::bigint as chars from f where f <> '' group by doc_id""")
def fact_stats(spark, d):
    f = table(spark, d, "documents").select("doc_id", F.explode(T.facts("text")).alias("f"))
    return f.groupBy("doc_id").agg(F.count("*").alias("facts"), F.sum(F.length("f")).cast("long").alias("chars"))


@query("trigram_stats", r"""
with t as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as t from documents),
g as (select doc_id, list_transform(range(1, greatest(len(t) - 1, 1)), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) as g from t)
select doc_id, len(g)::bigint as trigrams, len(list_distinct(g))::bigint as distinct_trigrams from g""")
def trigram_stats(spark, d):
    g = table(spark, d, "documents").select("doc_id", T.ngrams(T.tokens("text"), 3).alias("g"))
    return g.select("doc_id", F.size("g").cast("long").alias("trigrams"), F.size(F.array_distinct("g")).cast("long").alias("distinct_trigrams"))


_FLAT = r"regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')"


@query("snippets", f"select doc_id, case when length(t) > 90 then substring(t, 1, 90) || '…' else t end as snippet from (select doc_id, trim({_FLAT}, ' ') as t from documents)")
def snippets(spark, d):
    return table(spark, d, "documents").select("doc_id", T.snippet("text").alias("snippet"))


@query("normalized_duplicates", f"select md5(trim(lower({_FLAT}), ' ')) as key, count(*) as n, min(doc_id) as first_id from documents group by 1 having count(*) > 1")
def normalized_duplicates(spark, d):
    return table(spark, d, "documents").groupBy(F.md5(T.normalized("text").cast("binary")).alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("stable_ids", "select doc_id, sha1(source || ':' || doc_id || ':' || substring(text, 1, 80)) as content_id, substring(md5(source || '::' || doc_id), 1, 16) as place_id from documents")
def stable_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", T.content_id(F.col("source"), F.col("doc_id"), F.col("text")).alias("content_id"), T.place_id(F.col("source"), F.col("doc_id")).alias("place_id"))


_PRICES_SQL = ", ".join(f"('{m}', {p}::double)" for m, p in PRICES.items())


@query("token_cost_by_source", f"""
with m(model, price) as (values {_PRICES_SQL}),
d as (select source, case doc_id % 4 when 0 then 'small' when 1 then 'large' when 2 then 'light' else 'other' end as model, greatest(1, floor(length(text) / 4))::bigint as t from documents)
select source, d.model, sum(t)::bigint as tokens, round(sum(t) * coalesce(any_value(price), {DEFAULT_PRICE}::double) / 1e6, 8) as cost from d left join m using (model) group by source, d.model""")
def token_cost_by_source(spark, d):
    prices = spark.createDataFrame(list(PRICES.items()), "model string, price double")
    k = F.col("doc_id") % 4
    model = F.when(k == 0, "small").when(k == 1, "large").when(k == 2, "light").otherwise("other")
    by = table(spark, d, "documents").groupBy("source", model.alias("model")).agg(F.sum(T.estimated_tokens("text")).alias("tokens"))
    return by.join(F.broadcast(prices), "model", "left").select("source", "model", "tokens", F.round(F.col("tokens") * F.coalesce("price", F.lit(DEFAULT_PRICE)) / 1e6, 8).alias("cost"))


@query("json_extract", "select event_type, count(*) as n, count(k) as with_key, coalesce(sum(k), 0)::bigint as total from (select event_type, try_cast(json_extract_string(regexp_extract(props, '(?s)\\{.*\\}'), '$.k') as bigint) as k from events) group by event_type")
def json_extract(spark, d):
    inside = F.regexp_extract("props", r"(?s)\{.*\}", 0)
    k = F.get_json_object(inside, "$.k").try_cast("bigint")
    return table(spark, d, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("*").alias("n"), F.count("k").alias("with_key"), F.coalesce(F.sum("k"), F.lit(0)).alias("total"))


@query("citation_extract", r"""
with c as (select conv_id, turn, list_transform(regexp_extract_all(text || ' [' || (turn % 4) || '][9]', '\[(\d+)\]', 1), lambda x: x::int) as c from conversations)
select conv_id, turn, len(c)::bigint as cited, len(list_filter(c, lambda x: x between 1 and 3))::bigint as valid, round(len(list_filter(c, lambda x: x between 1 and 3))::double / len(c), 6) as faithfulness from c""")
def citation_extract(spark, d):
    text = F.concat("text", F.lit(" ["), (F.col("turn") % 4).cast("string"), F.lit("][9]"))
    c = table(spark, d, "conversations").select("conv_id", "turn", T.citations(text).alias("c"))
    valid = F.size(F.filter("c", lambda x: x.between(1, 3))).cast("long")
    return c.select("conv_id", "turn", F.size("c").cast("long").alias("cited"), valid.alias("valid"), F.round(valid / F.size("c"), 6).alias("faithfulness"))


@query("clean_lines", "select doc_id, len(l)::bigint as lines, md5(array_to_string(l, chr(10))) as key from (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') as l from documents)")
def clean_lines(spark, d):
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(" "))), lambda x: x != "")
    return table(spark, d, "documents").select("doc_id", lines.alias("l")).select("doc_id", F.size("l").cast("long").alias("lines"), F.md5(F.array_join("l", "\n").cast("binary")).alias("key"))


@query("log_lines", """select event_id, '{"event":"' || event_type || '","user":' || user_id || '}' as line from events""")
def log_lines(spark, d):
    return table(spark, d, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("event"), F.col("user_id").alias("user"))).alias("line"))


@query("conversation_context", "select conv_id, string_agg('[' || turn || '] (' || role || ')' || chr(10) || text, chr(10) || chr(10) order by turn, role, text) as context from conversations group by conv_id")
def conversation_context(spark, d):
    line = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("] ("), F.col("role"), F.lit(")\n"), F.col("text"))
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text", line.alias("line"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n\n").alias("context"))


@query("session_history", "select conv_id, count(*) as messages, max(turn) as last_turn, arg_max(role, turn * 1000 + length(role)) as last_role, sum(length(text))::bigint as chars from conversations group by conv_id")
def session_history(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"), F.max_by("role", F.col("turn") * 1000 + F.length("role")).alias("last_role"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("sft_messages", """
with p as (select conv_id, turn, role, text, lead(role) over (partition by conv_id order by turn) as next_role, lead(text) over (partition by conv_id order by turn) as reply from conversations)
select conv_id, turn, text as instruction, reply as output, greatest(1, floor(length(reply) / 4))::bigint as reply_tokens from p where role = 'user' and next_role = 'assistant' and length(trim(text, ' ')) >= 10 and trim(reply, ' ') <> ''""")
def sft_messages(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn")
    p = table(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("reply"))
    ok = (F.col("role") == "user") & (F.col("next_role") == "assistant") & (F.length(F.btrim("text", F.lit(" "))) >= 10) & (F.btrim("reply", F.lit(" ")) != "")
    return p.where(ok).select("conv_id", "turn", F.col("text").alias("instruction"), F.col("reply").alias("output"), T.estimated_tokens("reply").alias("reply_tokens"))


_WS = r"[ \t\n\x0B\f\r]"


@query("content_token_stats", f"select doc_id, len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda w: w not in ({STOP})))::bigint as terms from documents")
def content_token_stats(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.content_tokens("text")).cast("long").alias("terms"))


@query("opened_sentence_stats", rf"""
with s as (select doc_id, list_filter(string_split(regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '([.!?]){_WS}+([A-Z0-9"''(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x) <> '') as s from documents)
select doc_id, len(s)::bigint as sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::bigint as longest from s""")
def opened_sentence_stats(spark, d):
    s = table(spark, d, "documents").select("doc_id", T.opened_sentences("text").alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("sentences"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).cast("long").alias("longest"))


@query("sentence_start_sets", rf"""
with s as (select doc_id, list_distinct(list_transform(list_filter(string_split(regexp_replace(text, '([.!?]){_WS}+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '' and length(x) >= 8), lambda x: substring(x, 1, 40))) as s from documents)
select doc_id, len(s)::bigint as starts, md5(array_to_string(list_sort(s), chr(10))) as key from s""")
def sentence_start_sets(spark, d):
    s = table(spark, d, "documents").select("doc_id", T.sentence_starts("text").alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("starts"), F.md5(F.array_join(F.array_sort("s"), "\n").cast("binary")).alias("key"))


@query("judge_scores", f"""
with r as (select event_type, case event_id % 3 when 0 then '```json' || chr(10) || props || chr(10) || '```' when 1 then 'noise ' || props || ' noise' else props end as raw, round(value / 15, 1) as v from events)
select event_type, count(*) as n, count(*) filter (v between 1 and 5) as valid, coalesce(sum(round_even(v, 0)::int) filter (v between 1 and 5), 0)::bigint as total, count(json_extract_string(regexp_extract(raw, '(?s)\\{{.*\\}}'), '$.k')) as with_key from r group by event_type""")
def judge_scores(spark, d):
    """Scores in replies, some fenced, some in noise: those from 1 to 5, rounded half to even."""
    kind, props = F.col("event_id") % 3, F.col("props")
    raw = F.when(kind == 0, F.concat(F.lit("```json\n"), props, F.lit("\n```"))).when(kind == 1, F.concat(F.lit("noise "), props, F.lit(" noise"))).otherwise(props)
    reply = F.concat(F.lit('```json\n{"score": '), F.round(F.col("value") / 15, 1).cast("string"), F.lit("}\n```"))
    r = table(spark, d, "events").select("event_type", T.judged(reply, "score").alias("v"), F.get_json_object(T.json_inside(raw), "$.k").alias("k"))
    return r.groupBy("event_type").agg(F.count("*").alias("n"), F.count("v").alias("valid"), F.coalesce(F.sum("v"), F.lit(0)).alias("total"), F.count("k").alias("with_key"))


@query("verdict_lines", "select l_returnflag as flag, count(*) as n, count(*) filter (l_returnflag <> 'A') as relevant, count(*) filter (l_returnflag <> 'A' and l_linestatus = 'O') as both from lineitem group by 1")
def verdict_lines(spark, d):
    """Replies of two lines, `RELEVANT: ...` and `supported: ...`, read back."""
    word = lambda c: F.when(c, "pass").otherwise("Fail")
    reply = F.concat(F.lit("relevant: "), word(F.col("l_returnflag") != "A"), F.lit("\nSUPPORTED:"), word(F.col("l_linestatus") == "O"), F.lit("\nNOTE: none"))
    r = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), T.verdict(reply, "relevant").alias("a"), T.verdict(reply, "supported").alias("b"))
    return r.groupBy("flag").agg(F.count("*").alias("n"), F.count_if("a").alias("relevant"), F.count_if(F.col("a") & F.col("b")).alias("both"))


@query("citation_sanitized", r"""
with t as (select conv_id, turn, text || ' [' || (turn % 5) || '][9] [03]' as t from conversations)
select conv_id, turn, trim(regexp_replace(t, '\[(0+|0*[4-9]|0*[1-9][0-9]+)\]', '', 'g'), ' ') as answer from t""")
def citation_sanitized(spark, d):
    """Answers with marks of three sources; marks of others go."""
    text = F.concat("text", F.lit(" ["), (F.col("turn") % 5).cast("string"), F.lit("][9] [03]"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.sanitized(text, 3).alias("answer"))


@query("citation_faithfulness", r"""
with c as (select doc_id, list_distinct(list_transform(regexp_extract_all(text, '\[(\d+)\]', 1), lambda x: x::bigint)) as c from documents)
select doc_id, case when len(c) = 0 then 0.5 else round(len(list_filter(c, lambda x: x between 1 and 3))::double / len(c), 6) end as faithfulness from c""")
def citation_faithfulness(spark, d):
    """Share of cited sources that there are, of three; a half for a text that cites none."""
    c = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("long")))
    share = F.size(F.filter("c", lambda x: x.between(1, 3))) / F.size("c")
    return table(spark, d, "documents").select("doc_id", c.alias("c")).select("doc_id", F.when(F.size("c") == 0, 0.5).otherwise(F.round(share, 6)).alias("faithfulness"))


@query("labels_stripped", "select conv_id, turn, md5(trim(text, ' ')) as key from conversations")
def labels_stripped(spark, d):
    """A model's answers without the label in front of them."""
    labelled = F.concat(F.lit("  Step-back Question :  "), F.btrim("text", F.lit(" ")))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(T.without_label(labelled, ["answer", "step-back question"]).cast("binary")).alias("key"))


@query("observation_summaries", "with o as (select conv_id, string_agg(substring(text, 1, 220), chr(10) order by turn, text) as t from conversations group by conv_id) select conv_id, length(substring(t, 1, 3000))::bigint as chars, md5(substring(t, 1, 3000)) as key from o")
def observation_summaries(spark, d):
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return table(spark, d, "conversations").groupBy("conv_id").agg(T.listed(turns).alias("t")).select("conv_id", F.length("t").cast("long").alias("chars"), F.md5(F.col("t").cast("binary")).alias("key"))


@query("tool_arguments", "select event_type, count(*) as n, count(*) filter (not list_contains(json_keys(props), 'k')) as without_k, count(*) filter (not list_contains(json_keys(props), 'user')) as without_user from events group by event_type")
def tool_arguments(spark, d):
    """Arguments that a call must have and lacks."""
    given = F.map_keys(F.from_json("props", "map<string, string>"))
    lacks = F.array_except(F.array(F.lit("k"), F.lit("user")), F.coalesce(given, F.array().cast("array<string>")))
    r = table(spark, d, "events").select("event_type", lacks.alias("m"))
    return r.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.array_contains("m", "k")).alias("without_k"), F.count_if(F.array_contains("m", "user")).alias("without_user"))


@query("event_stream_frames", "select user_id, count(*) as frames, coalesce(sum(try_cast(json_extract_string(props, '$.k') as bigint)), 0)::bigint as total from events group by user_id")
def event_stream_frames(spark, d):
    """Server-sent frames, a block for each event with a comment and an end mark, read back."""
    block = F.concat(F.lit(": ping\ndata: "), F.col("props"), F.lit("\n\ndata: [DONE]\n"))
    lines = table(spark, d, "events").select("user_id", F.explode(F.split(block, "\n")).alias("line")).where(F.startswith("line", F.lit("data:")))
    frames = lines.select("user_id", F.btrim(F.substring(F.col("line"), 6, 1 << 30)).alias("frame")).where("frame <> '[DONE]'")
    return frames.groupBy("user_id").agg(F.count("*").alias("frames"), F.coalesce(F.sum(F.get_json_object("frame", "$.k").try_cast("bigint")), F.lit(0)).alias("total"))


@query("predicate_specs", "select p_brand as value, count(*) as n from part group by p_brand")
def predicate_specs(spark, d):
    """Specifications `field = value` read into their two parts; those for brands, counted by value."""
    spec = table(spark, d, "part").select(F.concat(F.lit("  p_brand ="), F.col("p_brand"), F.lit("  ")).alias("spec"))
    parts = [F.regexp_extract("spec", r"^\s*([A-Za-z_][\w-]*)\s*=\s*(.+?)\s*$", i).alias(n) for i, n in ((1, "field"), (2, "value"))]
    return spec.select(*parts).where("field = 'p_brand'").groupBy("value").agg(F.count("*").alias("n"))


@query("first_same_text", "with f as (select text, min(conv_id * 1000 + turn) as first_place from conversations group by text) select conv_id, turn, first_place from conversations join f using (text)")
def first_same_text(spark, d):
    """Each turn's first occurrence, found by its content."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    first = c.groupBy("text").agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("first_place"))
    return c.join(first, "text").select("conv_id", "turn", "first_place")
