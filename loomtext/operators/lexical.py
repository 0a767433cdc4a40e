"""Search by words: BM25, TF-IDF, overlap. Documents are scored where they are, for all questions at once, and each task's best
k of a question are merged; with more weights than a task should hold, BM25 takes the questions in blocks, and cosines are
searched by postings in order of impact."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import tokens
from loomtext.operators import impact, scoring
from loomtext.operators.shared import SMALL_ROWS, is_small, saved, small

K1, B, FLOOR = 1.5, 0.75, 0.25


def top(scored: DataFrame, k: int, by: str = "score", id_: str = "doc_id", digits: int = 6) -> DataFrame:
    """For each query the k rows of highest rounded score, ties by id: query_id, rank, id, score."""
    found = scored.select("query_id", id_, F.round(by, digits).alias("score"))
    return scoring.ranked(found, k, [id_]).withColumnRenamed("score", by)


def query_terms(queries: DataFrame, tokenize: Callable[[str], Column] = tokens) -> DataFrame:
    """query_id, term, qtf."""
    return queries.select("query_id", F.explode(tokenize("query")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(array of tokens, doc_id) to (doc_id, dl, term, tf)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            doc, coded, tf, length = scoring.counted(part.column(0))
            number = len(coded)
            doc, term = doc // max(1, number), doc % max(1, number)
            yield pa.RecordBatch.from_arrays([part.column(1).take(pa.array(doc)), pa.array(length[doc]), coded.take(pa.array(term)), pa.array(tf)], ["doc_id", "dl", "term", "tf"])


def postings(docs: DataFrame, tokenize: Callable[[str], Column] = tokens) -> DataFrame:
    """doc_id, dl, term, tf. Terms are counted in the task that has the document; nothing is shuffled."""
    rows = docs.select(tokenize("text").alias("t"), "doc_id")
    return rows.mapInArrow(_counted, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, dl long, term string, tf long")


@dataclass
class Collection:
    """A table's terms (term, df), documents and tokens, from one scan; the terms are kept in the shared folder."""

    terms: DataFrame
    n: int
    mean_length: float

    @classmethod
    def of(cls, docs: DataFrame, tokenize: Callable[[str], Column] = tokens) -> Collection:
        t = F.coalesce(tokenize("text"), F.array().cast("array<string>"))
        words = docs.select(t.alias("t")).select(F.size("t").alias("dl"), F.explode(F.concat(F.array_distinct("t"), F.array(F.lit(None).cast("string")))).alias("term"))
        counted = saved(words.groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("tokens")))
        whole = counted.where("term is null").first()  # one row for each document
        return cls(counted.where("term is not null").select("term", "df"), whole.df if whole else 0, whole.tokens / whole.df if whole else 0.0)

    def bm25_weights(self, asked: DataFrame) -> DataFrame:
        """query_id, term, w of query terms that documents hold. The idf of a term that more than half of the documents hold
        is a quarter of the mean idf of all terms."""
        idf = self.terms.withColumn("idf", F.log(self.n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        floor = FLOOR * (idf.agg(F.avg("idf")).first()[0] or 0.0)
        weight = F.when(F.col("idf") < 0, F.lit(floor)).otherwise(F.col("idf")) * F.col("qtf")
        # Spark sizes the questions' words as the questions: where they are many, the join is stated.
        asked = F.broadcast(asked) if is_small(asked, SMALL_ROWS) else asked.hint("merge")
        return idf.join(asked, "term").select("query_id", "term", weight.alias("w"))

    def idf(self) -> DataFrame:
        """term, idf = ln((n + 1) / (df + 1)) + 1."""
        return self.terms.select("term", (F.log((self.n + 1) / (F.col("df") + 1)) + 1).alias("idf"))


@dataclass
class Bm25:
    model: scoring.Model
    mean_length: float

    def __call__(self, lists) -> np.ndarray:
        c = self.model.count(lists)
        value = c.tf * (K1 + 1) / (c.tf + K1 * (1 - B + B * c.length[c.doc] / max(self.mean_length, 1e-300)))
        return self.model.scores(c, value, None)


@dataclass
class Overlap:
    model: scoring.Model

    def __call__(self, lists) -> np.ndarray:
        c = self.model.count(lists)
        return self.model.scores(c, np.ones(len(c.doc)), None)


@dataclass
class Cosine:
    """Of word counts; with idf, of (tf / max tf + 1) idf. The questions' weights are of length 1."""

    model: scoring.Model
    idf: np.ndarray | None = None

    def __call__(self, lists) -> np.ndarray:
        c = self.model.count(lists)
        if self.idf is None:
            value = c.tf
        else:
            most = np.zeros(len(c.length))
            np.maximum.at(most, c.doc, c.tf)
            value = (c.tf / most[c.doc] + 1) * self.idf[c.token]
        return self.model.scores(c, value, np.maximum(np.sqrt(np.bincount(c.doc, value**2, len(c.length))), 1e-300))


#: Terms, by hash, whose documents are counted in an array that every task holds; 12 bytes each.
MOST_TERMS = 4_000_000


@dataclass
class HashedCosine:
    """Cosine with idf, of tokens by hash: `n` documents, `hashes` in order and in how many documents each is; `common` for others."""

    model: scoring.Model
    n: int
    hashes: np.ndarray
    df: np.ndarray
    common: int

    @classmethod
    def of(cls, whole: Collection, weights: DataFrame, most: int) -> HashedCosine | None:
        """None if two terms have one hash or if more than `most` terms are in another number of documents than most terms are."""
        terms = saved(whole.terms.select(F.xxhash64("term").alias("h"), F.col("df").cast("int").alias("df")))
        common = terms.groupBy("df").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "df").first()
        other = terms.where(F.col("df") != (common.df if common else 0))
        if not is_small(other, most) or terms.count() != terms.select("h").distinct().count():
            return None
        rows = other.toArrow()
        h, df = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        order = np.argsort(h)
        asked = weights.select("query_id", F.xxhash64("term").alias("term"), "w").toArrow()
        return cls(scoring.Model.of_table(asked), whole.n, h[order], df[order], common.df if common else 0)

    def __call__(self, lists) -> np.ndarray:
        key, known, tf, length = scoring.counted(lists)
        many, h = max(1, len(known)), known.to_numpy(zero_copy_only=False)
        doc, token = key // many, key % many
        df = np.full(len(h), self.common)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            df = np.where(self.hashes[at] == h, self.df[at], df)
        most = np.zeros(len(length))
        np.maximum.at(most, doc, tf)
        value = (tf / most[doc] + 1) * (np.log((self.n + 1) / (df + 1)) + 1)[token]
        counts = scoring.Counts(doc, self.model.number(known)[token], tf.astype(float), length)
        return self.model.scores(counts, value, np.maximum(np.sqrt(np.bincount(doc, value**2, len(length))), 1e-300))


def _unit(weights: DataFrame) -> DataFrame:
    """(query_id, term, w) scaled to length 1."""
    size = weights.groupBy("query_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("qn"))
    return weights.join(size, "query_id").select("query_id", "term", (F.col("w") / F.col("qn")).alias("w"))


def bm25_top(docs: DataFrame, queries: DataFrame, k: int, tokenize: Callable[[str], Column] = tokens, positive_only: bool = False, most: int = scoring.MOST_WEIGHTS) -> DataFrame:
    """docs(doc_id, text), queries(query_id, query): query_id, rank, doc_id, score, of documents that share a term."""
    whole = Collection.of(docs, tokenize)
    weights = saved(whole.bm25_weights(query_terms(queries, tokenize)))
    least = 0.0 if positive_only else None
    if not is_small(weights, most):
        return scoring.search_in_blocks(docs, tokenize("text"), weights, lambda model: Bm25(model, whole.mean_length), k, ["doc_id"], least=least)
    model = scoring.Model.of(weights.collect())
    return scoring.search(docs, tokenize("text"), Bm25(model, whole.mean_length), model.ids, k, ["doc_id"], least=least)


def _bm25(docs: DataFrame, queries: DataFrame, tokenize: Callable[[str], Column]) -> Bm25:
    whole = Collection.of(docs, tokenize)
    return Bm25(scoring.Model.of(saved(whole.bm25_weights(query_terms(queries, tokenize))).collect()), whole.mean_length)


def ranked_everywhere(docs: DataFrame, queries: DataFrame, tokenize: Callable[[str], Column] = tokens, dims: int = 256) -> DataFrame:
    """docs(doc_id, text), queries(query_id, query), a stated set of questions whose weights a task can hold. Every document for
    every question: query_id, doc_id, its scores words (BM25) and vectors (cosine of hashed counts), 0 where nothing is shared,
    and its complete ranks by each, words_rank and vectors_rank, ties by doc_id. Rows are ranked by ranges of question and
    score, so that a question's ranks take as many tasks as its documents fill."""
    from loomtext.operators.dense import hashed_questions
    from loomtext.operators.running import numbered

    model = _bm25(docs, queries, tokenize)
    hashed, ids = hashed_questions(queries, tokenize, dims)
    asked = np.array(sorted({r.query_id for r in queries.select("query_id").collect()}), np.int64)
    rows = scoring.everywhere(docs, tokenize("text"), {"words": (model, model.model.ids), "vectors": (hashed, ids)}, asked, "doc_id")
    for name in ("words", "vectors"):
        rows = numbered(rows, ["query_id"], [F.desc(name), F.asc("doc_id")], f"{name}_rank")
    return rows


def bm25_work(docs: DataFrame, weights: DataFrame, whole: Collection, tokenize: Callable[[str], Column] = tokens) -> DataFrame:
    """What bm25_top() takes for weights(query_id, term, w), saved, in blocks of questions; one row: questions, postings of their
    words (what a join of postings makes), postings read, pairs that share a word, pairs that were scored to the end. Nothing is
    left out before it is scored, so all postings are read and all pairs scored."""
    read = weights.join(whole.terms, "term").agg(F.count_distinct("query_id").alias("questions"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings"))
    pairs = F.lit(scoring.met(docs, tokenize("text"), weights, lambda model: Bm25(model, whole.mean_length))).cast("long")
    return read.select("questions", "postings", F.col("postings").alias("postings_read"), pairs.alias("pairs_met"), pairs.alias("pairs_scored"))


def _by_impact(impacts: DataFrame, weights: DataFrame, k: int) -> impact.Found:
    """Of the documents' words only those that questions hold are indexed."""
    asked = small(saved(weights.select("term").distinct()))
    return impact.Index.of(impacts.join(asked, "term", "left_semi")).search(weights, k)


def overlap_top(docs: DataFrame, queries: DataFrame, k: int, by: str | None = None, ids: list[str] | None = None, text: str = "text", tokenize: Callable[[str], Column] = tokens, most: int = scoring.MOST_WEIGHTS) -> DataFrame:
    """How many of the query's tokens, repeats included, a document holds: query_id, rank, ids, score (and `by`), in each
    group `by`. ids: the columns that name a document."""
    ids = ids or ["doc_id"]
    asked = query_terms(queries, tokenize)
    if not is_small(asked, most):
        found = overlap(docs.select(*ids, F.col(text).alias("text"), *([by] if by else [])), queries, [*ids, *([by] if by else [])], tokenize)
        return scoring.ranked(found, k, ids, [by] if by else None)
    model = scoring.Model.of(asked.collect())
    return scoring.search(docs, tokenize(text), Overlap(model), model.ids, k, ids, by)


def overlap(docs: DataFrame, queries: DataFrame, ids: list[str] | None = None, tokenize: Callable[[str], Column] = tokens) -> DataFrame:
    """The same of all documents that share a token, by a join: query_id, ids, score."""
    ids = ids or ["doc_id"]
    held = docs.select(*ids, F.explode(F.array_distinct(tokenize("text"))).alias("term"))
    return held.join(query_terms(queries, tokenize), "term").groupBy("query_id", *ids).agg(F.sum("qtf").cast("double").alias("score"))


def bow_cosine_top(docs: DataFrame, queries: DataFrame, k: int, most: int = scoring.MOST_WEIGHTS) -> DataFrame:
    """Cosine of word counts."""
    weights = saved(_unit(query_terms(queries).select("query_id", "term", F.col("qtf").cast("double").alias("w"))))
    if not is_small(weights, most):
        of_docs = postings(docs).select("doc_id", "term", F.col("tf").cast("double").alias("w"))
        return top(cosine_by_impact(of_docs, weights, k).scores, k)
    model = scoring.Model.of(weights.collect())
    return scoring.search(docs, tokens("text"), Cosine(model), model.ids, k, ["doc_id"])


def tfidf_cosine_top(docs: DataFrame, queries: DataFrame, k: int, most: int = scoring.MOST_WEIGHTS, most_idf: int | None = None, most_terms: int = MOST_TERMS) -> DataFrame:
    """Cosine of vectors with weights (tf / max tf + 1) idf, idf = ln((n + 1) / (df + 1)) + 1 over the documents. A document's
    length needs the idf of all of its terms: they go to the tasks if the weights are few, up to `most_idf` of them (`most` if not
    given) as they are, up to `most_terms` by hash; else postings are joined, which takes a multiple of the documents on disk."""
    whole = Collection.of(docs)
    idf = whole.idf()

    def weighted(counts: DataFrame, key: str) -> DataFrame:
        most_often = counts.groupBy(key).agg(F.max("tf").alias("most"))
        return counts.join(most_often, key).join(idf, "term").select(key, "term", ((F.col("tf") / F.col("most") + 1) * F.col("idf")).alias("w"))

    weights = saved(_unit(weighted(query_terms(queries).withColumnRenamed("qtf", "tf"), "query_id")))
    few = is_small(weights, most)
    if few and not (known := is_small(idf, most if most_idf is None else most_idf)):
        if (hashed := HashedCosine.of(whole, weights, most_terms)) is not None:
            return scoring.search(docs, F.transform(tokens("text"), lambda t: F.xxhash64(t)), hashed, hashed.model.ids, k, ["doc_id"])
    if not (few and known):
        return top(cosine_by_impact(weighted(postings(docs), "doc_id"), weights, k).scores, k)
    known = {r.term: r.idf for r in idf.collect()}
    model = scoring.Model.of(weights.collect(), list(known))
    return scoring.search(docs, tokens("text"), Cosine(model, np.array([known[t] for t in sorted(known)], float)), model.ids, k, ["doc_id"])


def cosine_by_impact(of_docs: DataFrame, of_queries: DataFrame, k: int) -> impact.Found:
    """Of (doc_id, term, w) and (query_id, term, w) of length 1, as many as there may be."""
    size = of_docs.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("dn"))
    return _by_impact(of_docs.join(size, "doc_id").select("doc_id", "term", (F.col("w") / F.col("dn")).alias("x")), of_queries, k)


@dataclass
class TokenF1:
    """Of distinct tokens: sizes are the questions' numbers of them."""

    model: scoring.Model
    sizes: np.ndarray

    def __call__(self, lists) -> np.ndarray:
        c = self.model.count(lists)
        shared = self.model.scores(c, np.ones(len(c.doc)), None)
        return 2 * shared / (np.bincount(c.doc, minlength=len(c.length))[None] + self.sizes[:, None])


def token_f1_top(docs: DataFrame, queries: DataFrame, k: int, ids: list[str], tokens_column: str, most: int = scoring.MOST_WEIGHTS, by: str | None = None) -> DataFrame:
    """docs(ids, an array of tokens, `by` if given), queries(query_id, query): the k documents of largest F1 of distinct tokens,
    in each group `by`."""
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens("query"))).alias("term"))
    if not is_small(asked, most):
        sizes = asked.groupBy("query_id").agg(F.count("*").alias("m"))
        also = [by] if by else []
        held = docs.select(*ids, *also, F.size(F.array_distinct(tokens_column)).alias("n"), F.explode(F.array_distinct(tokens_column)).alias("term"))
        shared = held.join(asked, "term").groupBy("query_id", *ids, *also, "n").agg(F.count("*").alias("k")).join(sizes, "query_id")
        return scoring.ranked(shared.select("query_id", *ids, *also, F.round(2.0 * F.col("k") / (F.col("n") + F.col("m")), 6).alias("score")), k, ids, also or None)
    rows = asked.collect()
    model = scoring.Model.of([(r.query_id, r.term, 1.0) for r in rows])
    sizes = np.bincount(np.searchsorted(model.ids, [r.query_id for r in rows]), minlength=len(model.ids))
    return scoring.search(docs, F.col(tokens_column), TokenF1(model, sizes), model.ids, k, ids, by)
