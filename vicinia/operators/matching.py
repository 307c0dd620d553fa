"""Typo-tolerant and containment joins of texts as equi-joins on indexed parts, without a nested loop and without a bound on either side.

Words within k edits of each other share a text that is left of both when at most k letters are taken out, so words meet by those
(a deletion neighbourhood). A text that holds another holds all of its n-grams, so a text meets the texts that hold the rarest n-gram of
it. A phrase whose every word has to be near some word meets the texts that have a word near its rarest one. What meets is then checked
by the exact rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinia.functions import text
from vicinia.sources import scratch

#: Words of up to LONG letters meet by deletions (quadratic in their length), words from LONG - 2 on by thirds (linear); a pair differs by two letters at most, so one of the two finds it.
LONG = 32
#: Lengths of n-grams: a text asks by the longest that it has. The empty gram stands in every text, as the empty text does.
SIZES = (0, 1, 2, 3, 6)


def _without_one(w: Column) -> Column:
    n = F.length(w)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, n)))).otherwise(F.array().cast("array<string>"))


def deletions(w: Column) -> Column:
    """The word and what is left of it without one letter (from 3 on) or two (from 6 on, as only words of 8 may differ by two)."""
    one = _without_one(w)
    two = F.flatten(F.transform(one, _without_one))
    none = F.array(w)
    return F.when(F.length(w) < 3, none).when(F.length(w) < 6, F.array_union(none, one)).otherwise(F.array_union(F.array_union(none, one), two))


def _thirds(n: Column, i: int) -> tuple[Column, Column]:
    """Start (from 1) and length of the i-th third of a word of n letters."""
    a, z = F.floor(n * i / 3), F.floor(n * (i + 1) / 3)
    return (a + 1).cast("int"), (z - a).cast("int")


def _third_keys(w: Column) -> Column:
    """Of two edits at most, one third of a long word is untouched."""
    n = F.length(w)
    return F.array(*[F.struct(n.alias("n"), F.lit(i).alias("i"), F.substring(w, *_thirds(n, i)).alias("part")) for i in range(3)])


def _third_probes(w: Column) -> Column:
    """What thirds a word up to two letters longer or shorter may have in common with this one, up to two places off."""
    keys = []
    for d in range(-2, 3):
        n = F.length(w) + d
        for i in range(3):
            at, size = _thirds(n, i)
            keys += [F.struct(n.alias("n"), F.lit(i).alias("i"), F.substring(w, F.greatest(at + by, F.lit(1)), size).alias("part")) for by in range(-2, 3)]
    return F.array_distinct(F.array(*keys))


def near_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """T6 as a join: (a, b) of distinct words, columns a and b, that are equal or near by edits."""
    short = left.where(F.length("a") <= LONG).select("a", F.explode(deletions(F.col("a"))).alias("k")).join(right.where(F.length("b") <= LONG).select("b", F.explode(deletions(F.col("b"))).alias("k")), "k")
    long = left.where(F.length("a") >= LONG - 2).select("a", F.explode(_third_probes(F.col("a"))).alias("k")).join(right.where(F.length("b") >= LONG - 2).select("b", F.explode(_third_keys(F.col("b"))).alias("k")), "k")
    return short.select("a", "b").unionByName(long.select("a", "b")).distinct().where(text.fuzzy_token(F.col("a"), F.col("b")))


def _grams(c: Column, n: int) -> Column:
    last = F.length(c) - n + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>")) if n else F.array(F.lit(""))


def containments(needles: DataFrame, haystacks: DataFrame) -> DataFrame:
    """(needle, haystack) of distinct texts, columns needle and haystack, of which the second holds the first. Nulls hold nothing and are held by nothing."""
    needles, haystacks = needles.where("needle is not null").select("needle").distinct(), haystacks.where("haystack is not null").select("haystack").distinct()
    size = reduce(lambda a, n: F.when(F.length("needle") >= n, n).otherwise(a), SIZES[1:], F.lit(0))
    mine = reduce(lambda a, n: F.when(size == n, _grams(F.col("needle"), n)).otherwise(a), SIZES[1:], _grams(F.col("needle"), 0))
    asked = needles.select("needle", mine.alias("grams")).select("needle", F.size("grams").alias("of"), F.explode("grams").alias("gram"))
    posted = haystacks.select("haystack", F.explode(F.concat(*[_grams(F.col("haystack"), n) for n in SIZES])).alias("gram"))
    posted = posted.join(asked.select("gram").distinct(), "gram", "left_semi")
    holders = posted.groupBy("gram").agg(F.count("*").alias("df"))
    # A needle with a gram that stands nowhere is held by nothing.
    rarest = asked.join(holders, "gram").groupBy("needle", "of").agg(F.count("*").alias("found"), F.min_by("gram", F.struct("df", "gram")).alias("gram")).where("found = of")
    return posted.join(rarest.select("needle", "gram"), "gram").where(F.contains("haystack", "needle")).select("needle", "haystack")


def mutual_containments(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """T5 as a join: (query, term) of distinct texts of which one holds the other."""
    q, t = queries.select("query"), terms.select("term")
    ours = containments(q.withColumnRenamed("query", "needle"), t.withColumnRenamed("term", "haystack")).select(F.col("needle").alias("query"), F.col("haystack").alias("term"))
    theirs = containments(t.withColumnRenamed("term", "needle"), q.withColumnRenamed("query", "haystack")).select(F.col("haystack").alias("query"), F.col("needle").alias("term"))
    return ours.unionByName(theirs).distinct()


def near_phrases(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """T7 as a join: (query, term) of distinct texts, one holding the other or each query word near some word of the term."""
    q, t = queries.where("query is not null").select("query").distinct(), terms.where("term is not null").select("term").distinct()
    asked = q.select("query", F.array_distinct(text.tokens(F.col("query"))).alias("ws")).select("query", F.size("ws").alias("of"), F.explode("ws").alias("a"))
    posted = t.select("term", F.explode(F.array_distinct(text.tokens(F.col("term")))).alias("b"))
    holders = posted.groupBy("b").agg(F.count("*").alias("df"))
    near = near_words(asked.select("a").distinct(), holders.select("b"))
    met = near.join(holders, "b").groupBy("a").agg(F.sum("df").alias("df"))
    # Each word has to be near something; the one that the fewest terms are near to finds the terms.
    rarest = asked.join(met, "a").groupBy("query", "of").agg(F.count("*").alias("found"), F.min_by("a", F.struct("df", "a")).alias("a")).where("found = of")
    pairs = rarest.join(near, "a").select("query", "b").join(posted, "b").select("query", "term").distinct()
    return pairs.where(text.fuzzy_phrase(F.col("query"), F.col("term"))).unionByName(mutual_containments(q, t)).distinct()


def phrase_hits(pages: DataFrame, phrases: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, phrase, n): how often each phrase (column phrase, words set apart by single blanks) stands in a page (key and words, an array) as a run of whole words.

    A positional index: a phrase looks up its rarest word, which gives the places where it may start, and each start looks up its other words by page and place. A
    common word is thus looked up only where the rare ones of its phrase stand; a phrase of one common word costs what it finds. Each start has as many
    rows as the phrase has words, and none meets a page's text."""
    p = phrases.where("phrase is not null and phrase <> ''").select("phrase").distinct()
    parts = p.select("phrase", F.size(F.split("phrase", " ")).alias("of"), F.posexplode(F.split("phrase", " ")).alias("i", "w"))
    # The index is read three times, the pages and their words once.
    index = scratch.written(pages.select(key, F.posexplode("words").alias("at", "w")).join(parts.select("w").distinct(), "w", "left_semi"), "index")
    holders = index.groupBy("w").agg(F.count("*").alias("df"))
    # A phrase with a word that stands nowhere is not found.
    rarest = parts.join(holders, "w").groupBy("phrase", "of").agg(F.count("*").alias("found"), F.min_by(F.struct("i", "w"), F.struct("df", "i")).alias("r")).where("found = of")
    starts = index.join(rarest.select("phrase", "of", "r.i", "r.w"), "w").select(key, "phrase", "of", (F.col("at") - F.col("i")).alias("start")).where("start >= 0")
    one = starts.where("of = 1").select(key, "phrase")
    more = starts.where("of > 1").join(parts.select("phrase", "i", "w"), "phrase").withColumn("at", F.col("start") + F.col("i"))
    whole = more.join(index, [key, "at", "w"]).groupBy(key, "phrase", "start", "of").agg(F.count("*").alias("found")).where("found = of").select(key, "phrase")
    return one.unionByName(whole).groupBy(key, "phrase").agg(F.count("*").alias("n"))
