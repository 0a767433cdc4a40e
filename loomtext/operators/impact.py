"""Exact search for more questions than a task holds, by postings in order of impact.

A score is a sum, over the words that a question and a document share, of the question's weight times the document's impact.
A word's postings are cut into levels of impact, a level into segments of bounded size, and each level's largest impact is
known. A few segments of the highest bounds give each question a score that its k-th best surely reaches. Sorted by their
bounds, the words' levels that together stay below that score can't bring a document in: their segments are not read, which
are the long ones of common words. What is met in the others is looked at further only if its part and the bounds of what
was left out reach that score; those few pairs get the rest of their scores by document and word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtext.operators.shared import saved, small

#: Levels of impact of a word; documents of a segment on average; documents that a question's first bound is looked for in,
#: as a multiple of k; shares of the bounds left out that remain after each round of adding them, the last none.
LEVELS, SEGMENT, SEEDS, SHARES = 32, 1024, 16, (0.6, 0.3, 0.0)


@dataclass
class Index:
    """postings(doc_id, term, x, level), segments(term, level, part, hits: documents and impacts) and
    lists(term, level, n, most: largest impact, parts), all kept in the shared folder."""

    postings: DataFrame
    segments: DataFrame
    lists: DataFrame

    @classmethod
    def of(cls, impacts: DataFrame, levels: int = LEVELS, segment: int = SEGMENT) -> Index:
        """impacts(doc_id, term, x): x is positive; a document has a term once and documents have ids of their own. A level of
        a word that very many documents hold is dealt by their ids to as many segments as it fills."""
        impacts = saved(impacts.select("doc_id", "term", F.col("x").cast("double").alias("x")))
        scale = impacts.agg(F.max("x")).first()[0] or 1.0
        postings = impacts.withColumn("level", F.least(F.floor(F.col("x") / scale * levels), F.lit(levels - 1)).cast("int"))
        lists = postings.groupBy("term", "level").agg(F.count("*").alias("n"), F.max("x").alias("most"))
        lists = saved(lists.withColumn("parts", F.ceil(F.col("n") / segment).cast("int")))
        long_ = small(lists.where("parts > 1").select("term", "level", "parts"))
        dealt = postings.join(long_, ["term", "level"], "left").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1))).cast("int"))
        segments = saved(dealt.groupBy("term", "level", "part").agg(F.collect_list(F.struct("doc_id", "x")).alias("hits")))
        return cls(postings, segments, lists)

    def _met(self, asked: DataFrame) -> DataFrame:
        """asked(query_id, term, level, part, w): query_id, doc_id, score, a part of it, of what stands in those segments."""
        met = asked.join(self.segments, ["term", "level", "part"]).select("query_id", "w", F.explode("hits").alias("hit"))
        return met.groupBy("query_id", F.col("hit.doc_id").alias("doc_id")).agg(F.sum(F.col("w") * F.col("hit.x")).alias("score"))

    def _completed(self, pairs: DataFrame, words: DataFrame) -> DataFrame:
        """pairs(query_id, doc_id, score) and what words(query_id, term, w, upto) add to them at levels up to `upto`."""
        rest = pairs.select("query_id", "doc_id").join(words, "query_id").join(self.postings, ["doc_id", "term"]).where("level <= upto")
        return pairs.unionByName(rest.select("query_id", "doc_id", (F.col("w") * F.col("x")).alias("score"))).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))

    def search(self, weights: DataFrame, k: int, digits: int = 6, seeds: int = SEEDS, shares: tuple[float, ...] = SHARES) -> Found:
        """weights(query_id, term, w), each pair once. The result holds every document that may be among a question's k best
        by scores rounded to `digits`, ties included, with its whole score; a question that fewer than k documents share a word
        with gets all of these."""
        bound = F.greatest(F.col("w") * F.col("most"), F.lit(0.0))
        asked = saved(weights.join(self.lists, "term").select("query_id", "term", "w", "level", "n", "parts", bound.alias("bound")))
        # First: documents of the highest bounds, whole scores, and the k-th of these.
        order = W.partitionBy("query_id").orderBy(F.desc("bound"), "term", "level")
        before = F.sum((F.col("n") / F.col("parts"))).over(order.rowsBetween(W.unboundedPreceding, -1))
        first = asked.withColumn("before", F.coalesce(before, F.lit(0.0))).where(F.col("before") < seeds * k)
        met = self._met(first.select("query_id", "term", "level", "w", F.lit(0).alias("part"))).select("query_id", "doc_id", F.lit(0.0).alias("score"))
        whole = self._completed(met, weights.select("query_id", "term", "w", F.lit(1 << 30).alias("upto")))
        best = whole.withColumn("at", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("at") <= k)
        # What rounding can lift counts as reaching it.
        reach = saved(best.where(F.col("at") == k).select("query_id", (F.col("score") - 2 * 10.0**-digits).alias("reach")))
        # A level is left out if it and all words of smaller bounds together stay below.
        words = asked.groupBy("query_id", "term").agg(F.max("bound").alias("upper"))
        upto = W.partitionBy("query_id").orderBy("upper", "term").rowsBetween(W.unboundedPreceding, -1)
        words = words.withColumn("smaller", F.coalesce(F.sum("upper").over(upto), F.lit(0.0))).join(reach, "query_id", "left")
        out = F.coalesce(F.col("smaller") + F.col("bound") < F.col("reach"), F.lit(False))
        levels = asked.join(words, ["query_id", "term"]).withColumn("out", out)
        levels = saved(levels.select("query_id", "term", "w", "level", "n", "parts", "bound", "smaller", "reach", "out"))
        left = levels.where("out").groupBy("query_id", "term", "w", "smaller").agg(F.max("level").alias("upto"), F.max("bound").alias("bound"))
        rest = F.sum("bound").over(W.partitionBy("query_id"))
        left = saved(left.withColumn("share", (F.col("smaller") + F.col("bound")) / F.greatest(rest, F.lit(1e-300))))
        read = levels.where(~F.col("out"))
        met = saved(self._met(read.select("query_id", "term", "level", "w", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))))
        # The words of the largest bounds among those left out are added first; what can't reach the score any more ends there.
        near, many, above = self._reaching(met, reach, left), [], None
        for share in shares:
            now = left if above is None else left.where(F.col("share") <= above)
            if share > 0:  # the last round takes all that is left, words of no bound too: their weights are below zero
                now = now.where(F.col("share") > share)
            many.append(near)
            near = self._completed(near, now.select("query_id", "term", "w", "upto"))
            if share > 0:
                near = saved(self._reaching(near, reach, left.where(F.col("share") <= share)))
            above = share
        return Found(near, levels, met, many[-1])

    @staticmethod
    def _reaching(pairs: DataFrame, reach: DataFrame, left: DataFrame) -> DataFrame:
        """The pairs that reach the score with the bounds of what is left."""
        rest = reach.join(left.groupBy("query_id").agg(F.sum("bound").alias("rest")), "query_id", "left")
        enough = F.col("score") + F.coalesce("rest", F.lit(0.0)) >= F.col("reach")
        return pairs.join(rest, "query_id", "left").where(F.coalesce(enough, F.lit(True))).select("query_id", "doc_id", "score")


@dataclass
class Found:
    """scores(query_id, doc_id, score) of a search, and what it took."""

    scores: DataFrame
    levels: DataFrame
    met: DataFrame
    near: DataFrame

    def work(self) -> DataFrame:
        """One row: questions, postings of their words (what a join of postings makes), postings read, pairs met, and pairs that
        were scored to the end."""
        read = self.levels.agg(
            F.count_distinct("query_id").alias("questions"), F.coalesce(F.sum("n"), F.lit(0)).alias("postings"),
            F.coalesce(F.sum(F.when(~F.col("out"), F.col("n"))), F.lit(0)).alias("postings_read"),
        )
        met, scored = (df.agg(F.count("*").alias(name)) for df, name in ((self.met, "pairs_met"), (self.near, "pairs_scored")))
        rows = read.unionByName(met, allowMissingColumns=True).unionByName(scored, allowMissingColumns=True)
        return rows.agg(*[F.max(c).alias(c) for c in rows.columns])
