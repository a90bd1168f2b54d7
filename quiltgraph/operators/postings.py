"""Word-to-item tables with upper bounds, and exact search that leaves out what cannot reach the best ``k``.

The score of an item for a question is the sum over shared terms of question weight times item weight, all positive. A
term can add at most its question weight times its greatest item weight. Long items would make these bounds useless for
short ones, so items are in classes of length, each twice as long as the one before, and bounds are kept for each class.
Search goes in three steps:

1. *Bound.* The rarest terms of each question, until they name ``ENOUGH`` times ``k`` postings, give partial scores. The
   ``2 k`` items that lead by these are scored in full; their ``k``-th best score is one that the ``k``-th best item of all
   reaches for certain.
2. *Candidates.* In each class the most frequent terms whose upper bounds add up to less than that score are left out: an
   item that holds only such terms stays below it. A class of short items may be left out as a whole. The postings of the others give the candidates, of which those stay whose partial
   score and the bounds of the terms left out reach the score.
3. *Scores.* Only the candidates' postings are met again, with the terms left out; the others are in the partial scores.

Postings, and each word's greatest weight, are written once and serve any number of searches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiltgraph.config import Settings
from quiltgraph.functions.sizes import cut_lineage, join_lookup
from quiltgraph.functions.text import words
from quiltgraph.operators.ranking import top_k

DEFAULT = Settings()
#: Postings that the first step reads of each question, as a multiple of ``k``.
ENOUGH = 8


@dataclass(frozen=True)
class Postings:
    """``rows`` (term, length, item, weight), ``bounds`` (term, length, n, most) and ``terms`` (term, df)."""

    rows: DataFrame
    bounds: DataFrame
    terms: DataFrame


def build_postings(docs: DataFrame, item: str, text: str = "text") -> Postings:
    """Postings of the lower-case words of texts; an item's weight for a word is how often it holds it.

    Rows of one item are one item whose words are added up, and rows without an item or a text are left out. Texts are dealt
    by item once; counts and lengths are made in place, so a word of every text is spread by its items.
    """
    dealt = docs.filter(F.col(item).isNotNull()).select(F.col(item).alias("item"), F.col(text).alias("text")).repartition("item")
    held = dealt.select("item", words(F.lower("text")).alias("words"))
    counted = held.select("item", F.explode("words").alias("term")).groupBy("item", "term").agg(F.count("*").alias("weight"))
    length = F.floor(F.log2(F.sum("weight").over(Window.partitionBy("item")))).cast("int")
    rows = cut_lineage(counted.withColumn("length", length).select("term", "length", "item", "weight"))
    bounds = cut_lineage(rows.groupBy("term", "length").agg(F.count("*").alias("n"), F.max("weight").alias("most")))
    return Postings(rows, bounds, cut_lineage(bounds.groupBy("term").agg(F.sum("n").alias("df"))))


def _named(postings: Postings, wanted: DataFrame, settings: Settings) -> DataFrame:
    """Partial scores (q, length, item, part) of the wanted terms (q, term, qw, and length where only one class is meant)."""
    on = [c for c in ("term", "length") if c in wanted.columns]
    met = join_lookup(postings.rows, wanted.select("q", "qw", *on), on, settings)
    return met.groupBy("q", "length", "item").agg(F.sum(F.col("qw") * F.col("weight")).alias("part"))


def _in_full(postings: Postings, chosen: DataFrame, known: DataFrame, settings: Settings) -> DataFrame:
    """Scores (q, item, score) of the chosen (q, item) pairs over all terms of the question."""
    met = join_lookup(postings.rows.select("term", "item", "weight"), chosen, ["item"], settings)
    own = join_lookup(met, known.select("q", "term", "qw"), ["q", "term"], settings)
    return own.groupBy("q", "item").agg(F.sum(F.col("qw") * F.col("weight")).alias("score"))


def _completed(postings: Postings, candidates: DataFrame, left_out: DataFrame, settings: Settings) -> DataFrame:
    """Scores (q, item, score): the partial ones of ``candidates`` (q, length, item, part) and what the terms ``left_out``
    (q, length, term, qw) of their class add. Of the postings only those of terms that any question left out are met."""
    frequent = cut_lineage(left_out.select("term", "length").distinct())
    met = join_lookup(postings.rows, frequent, ["term", "length"], settings, "left_semi").select("term", "item", "weight")
    own = join_lookup(join_lookup(met, candidates.select("q", "length", "item"), ["item"], settings), left_out, ["q", "length", "term"], settings)
    added = own.select("q", "item", (F.col("qw") * F.col("weight")).alias("part"))
    return candidates.select("q", "item", "part").unionByName(added).groupBy("q", "item").agg(F.sum("part").alias("score"))


def search_postings(
    question_terms: DataFrame, postings: Postings, question: str, k: int, settings: Settings = DEFAULT, enough: int = ENOUGH
) -> tuple[DataFrame, DataFrame]:
    """(best, read). ``best`` is ``question, item, score, rank``: the ``k`` items of greatest score above 0, ties by item.
    ``read`` is ``question, n_bound, n_candidates, n_scored``: items scored for the bound, items that the terms kept
    name, and items scored in full after it.

    Question terms are (``question``, term, weight) with weights above 0; those of one term are added up.
    """
    asked = question_terms.filter("weight > 0 and term is not null").groupBy(F.col(question).alias("q"), "term").agg(F.sum("weight").alias("qw"))
    known = cut_lineage(join_lookup(asked, postings.terms, ["term"], settings))

    # The rarest terms of a question: the postings named before a term are not enough yet.
    rare = Window.partitionBy("q").orderBy("df", "term")
    before = F.coalesce(F.sum("df").over(rare.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = known.withColumn("_before", before).filter(F.col("_before") < enough * k)
    leading = cut_lineage(top_k(_named(postings, first, settings), "q", [F.desc("part"), F.asc("item")], 2 * k).select("q", "item"))
    sure = top_k(_in_full(postings, leading, known, settings), "q", [F.desc("score"), F.asc("item")], k).filter(F.col("rank") == k).select(
        "q", F.col("score").alias("sure"))

    # In each class, the most frequent terms that cannot carry an item to that score on their own.
    common = Window.partitionBy("q", "length").orderBy(F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, 0)
    bound = F.col("qw") * F.col("most")
    told = join_lookup(join_lookup(postings.bounds, known, ["term"], settings), sure, ["q"], settings, "left")
    told = told.withColumn("_sum", F.sum(bound).over(common)).withColumn("kept", ~F.coalesce(F.col("_sum") < F.col("sure"), F.lit(False)))
    told = cut_lineage(told.select("q", "length", "term", "qw", "sure", "kept", bound.alias("bound")))
    rest = told.groupBy("q", "length").agg(F.max("sure").alias("sure"), F.coalesce(F.sum(F.when(~F.col("kept"), F.col("bound"))), F.lit(0)).alias("rest"))
    named = cut_lineage(_named(postings, told.filter("kept"), settings))
    may = F.col("part") + F.col("rest") >= F.coalesce(F.col("sure"), F.lit(0))
    candidates = cut_lineage(join_lookup(named, rest, ["q", "length"], settings).filter(may).select("q", "length", "item", "part"))
    scored = _completed(postings, candidates, told.filter("not kept").select("q", "length", "term", "qw"), settings)
    best = top_k(scored.filter("score > 0"), "q", [F.desc("score"), F.asc("item")], k)
    read = known.select("q").distinct().join(leading.groupBy("q").agg(F.count("*").alias("n_bound")), "q", "left").join(
        named.groupBy("q").agg(F.count("*").alias("n_candidates")), "q", "left").join(
        candidates.groupBy("q").agg(F.count("*").alias("n_scored")), "q", "left").na.fill(0)
    return best.select(F.col("q").alias(question), "item", "score", "rank"), read.withColumnRenamed("q", question)

