"""A gazetteer mined from the corpus (E1): phrases by significance merging, types by the
words around them.

1. Count.  One pass counts every word and every run of 2 to ``MAX_WORDS`` capitalised
   words, by lower case, with the cue words before them; the counts combine map-side.
2. Names.  A word is a name where it is capitalised at least ``MIN_COUNT`` times and in
   ``MIN_SHARE`` of its occurrences.
3. Merging, from short to long.  A run of n words is a phrase when it splits into two units
   (names or shorter phrases) l and r that stand together more often than chance has it:

       significance = (c - c_l * c_r / N) / sqrt(c),   N words in all,

   at least ``SIGNIFICANCE`` for its best split.  Each length is two hash joins a split of
   the runs with the units found so far.
4. A unit that stands outside the longer phrases made of it fewer than ``MIN_COUNT`` times
   is dropped: the phrase speaks for it.
5. Types.  Cue words vote: those before an occurrence and those inside the phrase.

Scale: the shuffle is of counts, a row a distinct run and map task; runs of words that are
not all capitalised, most of a text, never leave the scan.  Nothing is collected; the
result joins the texts by ``with_entities`` at any size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.barrier import materialize, staged
from ..functions.lexicon import ENTITY_TOKEN

MAX_WORDS = 3
MIN_COUNT = 5
MIN_SHARE = 0.5
SIGNIFICANCE = 3.0
# Types in the order that decides equal votes, with the words that vote for them: before
# a phrase, and as one of its own words.
CUES_BEFORE = {
    "PERSON": ["mr", "mrs", "ms", "dr", "by", "with", "said"],
    "ORG": ["of", "for", "at"],
    "GPE": ["in", "from", "to", "near", "across"],
}
CUES_INSIDE = {
    "PERSON": ["minister", "president", "judge", "captain", "king", "queen"],
    "ORG": ["party", "bank", "court", "ministry", "university", "committee", "ltd", "inc", "union"],
    "GPE": ["city", "state", "district", "republic", "island", "river"],
}
NO_TYPE = "MISC"


def _capital(word: Column) -> Column:
    return word.rlike("^[A-Z]")


def run_counts(docs: DataFrame, text: str, max_words: int = MAX_WORDS) -> DataFrame:
    """(words, term, n, seen, before_<type>...): capitalised occurrences, all occurrences
    (of single words) and those after a cue word, by the lower case of the run."""
    t = F.col("_t")
    toks = materialize(docs.select(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")),
                                                        F.lit(ENTITY_TOKEN), F.lit(0)).alias("_t")))
    at = F.when(F.size(t) > 0, F.sequence(F.lit(0), F.size(t) - 1))
    places = toks.select(F.explode_outer(F.transform(at, lambda i: F.struct(
        *[F.get(t, i + j).alias(f"w{j}") for j in range(max_words)],
        F.lower(F.get(t, i - 1)).alias("before")))).alias("x")).select("x.*").where("w0 is not null")
    runs = [F.struct(F.lit(1).alias("words"), F.lower("w0").alias("term"), _capital(F.col("w0")).alias("named"))]
    for n in range(2, max_words + 1):
        words = [F.col(f"w{j}") for j in range(n)]
        all_named = reduce(lambda a, b: a & b, [F.coalesce(_capital(w), F.lit(False)) for w in words])
        runs.append(F.when(all_named, F.struct(F.lit(n).alias("words"), F.lower(F.concat_ws(" ", *words)).alias("term"),
                                               F.lit(True).alias("named"))))
    each = places.select("before", F.explode(F.array(*runs)).alias("r")).where("r is not null")
    named = F.col("r.named")
    votes = [F.count_if(named & F.col("before").isin(cues)).alias(f"before_{kind}")
             for kind, cues in CUES_BEFORE.items()]
    return each.groupBy("r.words", "r.term").agg(F.count_if(named).alias("n"), F.count("*").alias("seen"), *votes)


def _part(term: Column, first: Column, last: Column) -> Column:
    return F.array_join(F.slice(F.split(term, " "), first, last), " ")


def mine_phrases(docs: DataFrame, text: str, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT,
                 significance: float = SIGNIFICANCE) -> DataFrame:
    """(ent_type, term, words, n, significance) of every mined phrase, in lower case.
    Names of one word have no significance.  Null texts have no words."""
    counts = staged(run_counts(docs, text, max_words), "run-counts")
    total = counts.where("words = 1").agg(F.coalesce(F.sum("seen"), F.lit(0))).first()[0]
    names = counts.where((F.col("words") == 1) & (F.col("n") >= min_count)
                         & (F.col("n") >= F.lit(MIN_SHARE) * F.col("seen")))
    votes = [f"before_{kind}" for kind in CUES_BEFORE]
    none = F.lit(None)
    units = staged(names.select("words", "term", "n", *votes, none.cast("double").alias("significance"),
                                none.cast("string").alias("left"), none.cast("string").alias("right")), "units")
    for n in range(2, max_words + 1):
        runs = counts.where((F.col("words") == n) & (F.col("n") >= min_count))
        known = units.select("term", F.col("n").alias("c"))
        split = (runs.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n - 1))))
                     .withColumn("left", _part(F.col("term"), F.lit(1), F.col("k")))
                     .withColumn("right", _part(F.col("term"), F.col("k") + 1, n - F.col("k")))
                     .join(known.withColumnsRenamed({"term": "left", "c": "c_left"}), "left")
                     .join(known.withColumnsRenamed({"term": "right", "c": "c_right"}), "right"))
        chance = F.col("c_left") * F.col("c_right") / F.lit(float(max(total, 1)))
        scored = split.withColumn("significance", (F.col("n") - chance) / F.sqrt("n"))
        best = W.partitionBy("term").orderBy(F.desc("significance"), "k")   # at most max_words - 1 rows
        units = staged(units.unionByName(
            scored.where(F.col("significance") >= significance)
                  .withColumn("nth", F.row_number().over(best)).where("nth = 1").select(*units.columns)), "units")
    held = (units.where("left is not null")
                 .select("n", F.explode(F.array_distinct(F.array("left", "right"))).alias("term"))
                 .groupBy("term").agg(F.sum("n").alias("held")))
    free = units.join(held, "term", "left").where(
        F.col("n") - F.coalesce("held", F.lit(0)) >= min_count)

    def vote(kind: str) -> Column:
        inside = F.arrays_overlap(F.split("term", " "), F.array(*map(F.lit, CUES_INSIDE[kind])))
        return F.col(f"before_{kind}") + F.when(inside, F.col("n")).otherwise(0)

    ballot = F.array(*[F.struct(vote(kind).alias("votes"), F.lit(-i).alias("order"), F.lit(kind).alias("kind"))
                       for i, kind in enumerate(CUES_BEFORE)])
    chosen = F.array_max(ballot)
    kind = F.when(chosen["votes"] > 0, chosen["kind"]).otherwise(F.lit(NO_TYPE))
    return free.select(kind.alias("ent_type"), "term", "words", "n", "significance")
