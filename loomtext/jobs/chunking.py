"""Queries that cut documents into chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.jobs.registry import query, table
from loomtext.operators import chunk as C
from loomtext.operators import lexical as L

_SENTENCES = r"list_filter(string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')"
_BLANK = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _windows(size: int, overlap: int, early: bool, source: str = "select doc_id, text from documents") -> str:
    step = size - overlap
    rule = f"where s = 0 or s < length(text) - {overlap}" if early else ""
    cut = f"trim(substring(text, s + 1, {size}), ' ')" if early else f"substring(text, s + 1, {size})"
    return f"""
with d as ({source}), s as (select doc_id, text, unnest(range(0, greatest(length(text), 1), {step})) as s from d),
c as (select doc_id, s, {cut} as chunk from s {rule})
select doc_id, (row_number() over (partition by doc_id order by s) - 1)::bigint as chunk_index, chunk from c where trim(chunk, ' ') <> ''"""


def _fold(parts: str, size: int, sep: str, extra: int) -> str:
    """SQL of packing: one row for each part, folded in order; a chunk is the last state before the next one begins."""
    return f"""
with recursive l as (select doc_id, {parts} as l from documents),
p as (select doc_id, unnest(l) as s, generate_subscripts(l, 1) as i from l),
f as (
  select doc_id, i, s as cur, 0 as k from p where i = 1
  union all
  select f.doc_id, p.i, case when length(f.cur) + length(p.s) + {extra} > {size} then p.s else f.cur || {sep} || p.s end,
    case when length(f.cur) + length(p.s) + {extra} > {size} then f.k + 1 else f.k end
  from f join p on p.doc_id = f.doc_id and p.i = f.i + 1
)
select doc_id, k::bigint as chunk_index, arg_max(cur, i) as chunk from f group by doc_id, k"""


def _out(df):
    return df.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk")


# Trimming in the windows is of blanks only on both sides, as the texts hold no other white space at cuts but line ends.
@query("chunk_windows", _windows(400, 60, True).replace("trim(substring(text, s + 1, 400), ' ')", f"trim(substring(text, s + 1, 400), {_BLANK})"))
def chunk_windows(spark, d):
    return _out(C.exploded(table(spark, d, "documents"), C.windows(F.col("text"), 400, 60), ["doc_id"]))


@query("chunk_slices", _windows(500, 0, False))
def chunk_slices(spark, d):
    return _out(C.exploded(table(spark, d, "documents"), C.windows(F.col("text"), 500, 0, stop_early=False), ["doc_id"]))


@query("chunk_sentences", _fold(_SENTENCES, 300, "' '", 0))
def chunk_sentences(spark, d):
    return _out(C.exploded(table(spark, d, "documents"), C.sentence_chunks(F.col("text"), 300), ["doc_id"]))


_UNITS = r"list_filter(string_split(regexp_replace(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), '\n[ \t\n\x0B\f\r]*\n', chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')"


@query("chunk_greedy", _fold(f"flatten(list_transform({_UNITS}, lambda s: list_transform(range(0, length(s), 300), lambda i: substring(s, i + 1, 300))))", 300, "' '", 1))
def chunk_greedy(spark, d):
    return _out(C.exploded(table(spark, d, "documents"), C.greedy_chunks(F.col("text"), 300), ["doc_id"]))


@query("chunk_line_sections", _fold("list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda x: trim(x, ' ')), lambda x: x <> '')", 600, "chr(10) || chr(10)", 2))
def chunk_line_sections(spark, d):
    return _out(C.exploded(table(spark, d, "documents"), C.line_sections(F.col("text"), 600), ["doc_id"]))


@query("chunk_recursive")
def chunk_recursive(spark, d):
    split = C.recursive_chunks(300, 50)
    return _out(table(spark, d, "documents").select("doc_id", split("text").alias("c")).select("doc_id", F.posexplode("c").alias("chunk_index", "chunk")))


@query("chunk_header_sections")
def chunk_header_sections(spark, d):
    """The first word of each line that stands alone becomes a header, so that the table has some."""
    text = F.regexp_replace("text", r"(?m)^([A-ZÀ-Ý][^ .\n]*\.)$", "## $1")
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("# "), F.col("source"), F.lit("\n"), text).alias("text"))
    return C.header_sections(docs, "doc_id", "text")


def _with_parents(spark, d, outer: int = 1500, inner: int = 300):
    parents = C.exploded(table(spark, d, "documents"), C.windows(F.col("text"), outer, 0, stop_early=False), ["doc_id"]).select("doc_id", F.col("chunk_index").alias("p"), F.col("chunk").alias("parent"))
    return parents.select("doc_id", "p", "parent", F.posexplode(C.windows(F.col("parent"), inner, 0, stop_early=False)).alias("c", "child"))


@query("parent_child_index", """
with p as (select doc_id, unnest(range(0, greatest(length(text), 1), 1500)) as ps, text from documents),
q as (select doc_id, row_number() over (partition by doc_id order by ps) - 1 as p, substring(text, ps + 1, 1500) as parent from p where trim(substring(text, ps + 1, 1500), ' ') <> ''),
c as (select doc_id, p, parent, unnest(range(0, length(parent), 300)) as cs from q),
r as (select doc_id, p, row_number() over (partition by doc_id, p order by cs) - 1 as c, substring(parent, cs + 1, 300) as child from c where trim(substring(parent, cs + 1, 300), ' ') <> '')
select doc_id || '::p' || p as parent_id, doc_id || '::p' || p || '::c' || c as child_id, length(child)::bigint as chars from r""")
def parent_child_index(spark, d):
    parent = F.concat(F.col("doc_id").cast("string"), F.lit("::p"), F.col("p").cast("string"))
    return _with_parents(spark, d).select(parent.alias("parent_id"), F.concat(parent, F.lit("::c"), F.col("c").cast("string")).alias("child_id"), F.length("child").cast("long").alias("chars"))


_SWEEP = [(s, o) for s in (256, 512, 1024, 2048) for o in (0, s // 4)]


@query("chunk_sweep", " union all ".join(f"select {s}::bigint as size, {o}::bigint as overlap, count(*) as chunks, round(avg(length(chunk)), 2) as mean_chars, min(length(chunk))::bigint as shortest, max(length(chunk))::bigint as longest, round(avg((not regexp_matches(chunk, '^[[:space:]]*[A-Z]'))::int), 4) as mid_sentence from ({_windows(s, o, False)})" for s, o in _SWEEP))
def chunk_sweep(spark, d):
    """Chunk counts and lengths by size and overlap, from one scan: the settings are exploded beside each document."""
    rows = _sweep_rows(spark, d)
    middle = (~F.col("chunk").rlike(r"^\s*[A-Z]")).cast("int")
    n = F.length("chunk")
    return rows.groupBy(F.col("size").cast("long").alias("size"), F.col("overlap").cast("long").alias("overlap")).agg(F.count("*").alias("chunks"), F.round(F.avg(n), 2).alias("mean_chars"), F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest"), F.round(F.avg(middle), 4).alias("mid_sentence"))


def _sweep_rows(spark, d):
    cut = F.array(*[F.struct(F.lit(s).alias("size"), F.lit(o).alias("overlap"), C.slices(F.col("text"), s, o).alias("chunks")) for s, o in _SWEEP])
    rows = table(spark, d, "documents").select(F.explode(cut).alias("x")).select("x.size", "x.overlap", F.explode("x.chunks").alias("chunk")).where(F.btrim("chunk", F.lit(" ")) != "")
    return rows


def _proxy_sql() -> str:
    sliced = " union all ".join(f"select 'slices' as strategy, {s}::bigint as size, {o}::bigint as overlap, doc_id, chunk_index, chunk from ({_windows(s, o, False)})" for s, o in _SWEEP)
    sentences = " union all ".join(f"select 'sentences' as strategy, {s}::bigint as size, 0::bigint as overlap, doc_id, chunk_index, chunk from ({_fold(_SENTENCES, s, chr(39) + ' ' + chr(39), 0)})" for s in _PACKED)
    return f"""with c as ({sliced} union all {sentences}),
ct as (select strategy, size, overlap, doc_id, chunk_index, list_distinct(regexp_extract_all(lower(chunk), '[a-z0-9]+')) as t from c), cu as (select *, len(t) as n, unnest(t) as term from ct),
qd as (select item_id as query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as t from benchmark), qu as (select query_id, len(t) as m, unnest(t) as term from qd),
f as (select strategy, size, overlap, query_id, doc_id, chunk_index, round(2.0::double * count(*) / (any_value(n) + any_value(m)), 6) as f1 from cu join qu using (term) group by all),
b as (select strategy, size, overlap, query_id, max(f1) as best from f group by all),
k as (select strategy, size, overlap, count(*) as chunks from ct group by all),
p as (select strategy, size, overlap, round(sum(best) / (select count(*) from qd where len(t) > 0), 4) as proxy from b group by all)
select strategy, size, overlap, chunks, proxy, row_number() over (order by proxy desc, chunks, strategy, size, overlap) = 1 as chosen from k join p using (strategy, size, overlap)"""


_PACKED = (300, 900)


@query("chunk_sweep_chosen", _proxy_sql())
def chunk_sweep_chosen(spark, d):
    """Slices and packed sentences of several sizes, judged by how well a question's best chunk answers it: the mean over the
    questions of the largest F1 of distinct tokens. All settings come from one scan; the best is marked, of equal ones that with
    fewer chunks."""
    setting = lambda strategy, size, overlap, chunks: F.struct(F.lit(strategy).alias("strategy"), F.lit(size).cast("long").alias("size"), F.lit(overlap).cast("long").alias("overlap"), chunks.alias("chunks"))
    cut = F.array(*[setting("slices", s, o, C.windows(F.col("text"), s, o, stop_early=False)) for s, o in _SWEEP], *[setting("sentences", s, 0, C.sentence_chunks(F.col("text"), s)) for s in _PACKED])
    rows = table(spark, d, "documents").select("doc_id", F.explode(cut).alias("x")).select("doc_id", "x.strategy", "x.size", "x.overlap", F.posexplode("x.chunks").alias("c", "chunk"))
    name = F.concat_ws("/", "strategy", F.col("size").cast("string"), F.col("overlap").cast("string"))
    chunks = rows.select("doc_id", "c", name.alias("setting"), F.array_distinct(T.tokens("chunk")).alias("t"))
    questions = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    asked = questions.where(F.size(T.tokens("query")) > 0).count()
    best = L.token_f1_top(chunks, questions, 1, ["doc_id", "c"], "t", by="setting")
    proxy = best.groupBy("setting").agg(F.round(F.sum("score") / asked, 4).alias("proxy"))
    counts = rows.groupBy("strategy", "size", "overlap").agg(F.count("*").alias("chunks")).withColumn("setting", name)
    found = counts.join(proxy, "setting")
    first = found.agg(F.min(F.struct(-F.col("proxy"), "chunks", "strategy", "size", "overlap")).alias("first"))  # of a row for each setting
    mark = first.select(F.col("first.strategy").alias("s"), F.col("first.size").alias("n"), F.col("first.overlap").alias("o"), F.lit(True).alias("chosen"))
    here = (F.col("strategy") == F.col("s")) & (F.col("size") == F.col("n")) & (F.col("overlap") == F.col("o"))
    return found.join(F.broadcast(mark), here, "left").select("strategy", "size", "overlap", "chunks", "proxy", F.coalesce("chosen", F.lit(False)).alias("chosen"))


@query("chunk_semantic")
def chunk_semantic(spark, d):
    """Sentences joined until the similarity of neighbours falls below a threshold that each document sets: mean less half a
    standard deviation, from 0.2 to 0.95. Similarity is the cosine of hashed token counts, as no model is at hand."""
    from pyspark.sql import Window as W

    s = table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences("text")).alias("pos", "s")).withColumn("t", T.buckets("s"))
    w, whole = W.partitionBy("doc_id").orderBy("pos"), W.partitionBy("doc_id")
    before = F.lag("t").over(w)
    s = s.withColumn("before", before)
    sim = F.when(F.col("before").isNotNull(), T.bag_cosine(F.col("t"), F.col("before")))
    s = s.withColumn("sim", sim).withColumn("least", F.coalesce(F.greatest(F.lit(0.2), F.least(F.lit(0.95), F.avg("sim").over(whole) - 0.5 * F.stddev_pop("sim").over(whole))), F.lit(0.75)))
    cut = s.withColumn("chunk_index", F.sum(F.coalesce((F.col("sim") < F.col("least")).cast("int"), F.lit(0))).over(w))
    return cut.groupBy("doc_id", "chunk_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), " ").alias("chunk"), F.count("*").alias("sentences"))


_PASSAGES = "list_transform(list_filter(list_transform(string_split(replace(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), chr(10), ' '), '. '), lambda x: trim(x)), lambda x: length(x) > 20), lambda x: x || '. ')"


@query("chunk_passages", _fold(_PASSAGES, 302, "''", 0).replace("arg_max(cur, i) as chunk", "trim(arg_max(cur, i)) as chunk"))
def chunk_passages(spark, d):
    return _out(C.exploded(table(spark, d, "documents"), C.passages(F.col("text")), ["doc_id"]))


@query("paragraph_slices", r"""
with p as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '\n[ \t\n\x0B\f\r]*\n', chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) >= 20) as p from documents),
c as (select doc_id, unnest(flatten(list_transform(p, lambda s: list_transform(range(0, length(s), 500), lambda i: substring(s, i + 1, 500))))) as chunk, generate_subscripts(flatten(list_transform(p, lambda s: list_transform(range(0, length(s), 500), lambda i: substring(s, i + 1, 500)))), 1) as i from p)
select doc_id, (i - 1)::bigint as chunk_index, chunk from c""")
def paragraph_slices(spark, d):
    return _out(C.exploded(table(spark, d, "documents"), C.paragraph_slices(F.col("text")), ["doc_id"]))


_UNITS_HTML = r"list_filter(string_split(regexp_replace(html, '(<(?:p|div|h[1-6]|ul|table)\b)', chr(1) || '\1', 'g'), chr(1)), lambda x: x <> '')"


@query("chunk_markup", _fold(f"flatten(list_transform({_UNITS_HTML}, lambda s: list_transform(range(0, length(s), 400), lambda i: substring(s, i + 1, 400))))", 400, "''", 0).replace("doc_id, flatten", "page_id as doc_id, flatten").replace("from documents", "from pages").replace("select doc_id, k::bigint as chunk_index, arg_max(cur, i) as chunk from f group by doc_id, k", r"select doc_id as page_id, k::bigint as chunk_index, arg_max(cur, i) as chunk, regexp_matches(arg_max(cur, i), '^<(p|div|h[1-6]|ul|table)\b') as at_boundary from f group by doc_id, k"))
def chunk_markup(spark, d):
    """Pages cut where elements begin, and whether each chunk does begin with one."""
    chunks = C.exploded(table(spark, d, "pages"), C.code_chunks(F.col("html"), "html"), ["page_id"])
    return chunks.select("page_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk", F.col("chunk").rlike(r"^<(p|div|h[1-6]|ul|table)\b").alias("at_boundary"))


@query("chunk_boundaries")
def chunk_boundaries(spark, d):
    split = C.boundary_chunks(300, 50)
    return _out(C.exploded(table(spark, d, "documents"), split("text"), ["doc_id"]))


@query("chunk_markdown")
def chunk_markdown(spark, d):
    split = C.markdown_chunks(400, 60)
    return _out(C.exploded(table(spark, d, "documents"), split("text"), ["doc_id"]))


@query("chunk_offsets", f"""with c as ({_windows(500, 0, False).replace("select doc_id, (row_number() over (partition by doc_id order by s) - 1)::bigint as chunk_index, chunk from c", "select doc_id, (row_number() over (partition by doc_id order by s) - 1)::bigint as chunk_index, s::int as start, length(chunk)::bigint as chars from c")}) select * from c""")
def chunk_offsets(spark, d):
    """Each slice's place in its document, by looking for it behind the one before."""
    cut = C.windows(F.col("text"), 500, 0, stop_early=False)
    found = table(spark, d, "documents").select("doc_id", cut.alias("c"), "text").select("doc_id", "c", C.offsets("text", "c").alias("at"))
    each = found.select("doc_id", F.posexplode(F.arrays_zip("c", "at")).alias("chunk_index", "x"))
    return each.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("x.at").alias("start"), F.length("x.c").cast("long").alias("chars"))


@query("chunk_overlap_deltas", f"""with a as ({' union all '.join(f"select {s}::bigint as size, {o}::bigint as overlap, count(*) as chunks, avg((not regexp_matches(chunk, '^[[:space:]]*[A-Z]'))::int) as mid from ({_windows(s, o, False)})" for s, o in _SWEEP)})
select size, max(chunks) filter (overlap > 0) - max(chunks) filter (overlap = 0) as more_chunks, round(max(mid) filter (overlap = 0) - max(mid) filter (overlap > 0), 4) as less_mid from a group by size""")
def chunk_overlap_deltas(spark, d):
    """What an overlap of a quarter changes, by size: the sweep pivoted."""
    rows = _sweep_rows(spark, d)
    wide = rows.groupBy(F.col("size").cast("long").alias("size")).agg(
        *[f(F.when(c, x)).alias(n) for c, p in ((F.col("overlap") == 0, "a"), (F.col("overlap") > 0, "b")) for f, x, n in ((F.count, F.lit(1), f"n_{p}"), (F.avg, (~F.col("chunk").rlike(r"^\s*[A-Z]")).cast("int"), f"mid_{p}"))]
    )
    return wide.select("size", (F.col("n_b") - F.col("n_a")).alias("more_chunks"), F.round(F.col("mid_a") - F.col("mid_b"), 4).alias("less_mid"))
