"""Benchmark decontamination on a positional inverted index, by DataFrame functions only.

Every benchmark item yields its windows of consecutive words. The corpus's counts of
benchmark terms say which terms of a window are rarest; the index stores the postings
(term, document, position) of those terms alone, as a table in the shared folder. A
posting of a term at place p of an item, found at position x, lies on the diagonal
x - p; lists are intersected on (item, document, diagonal), so that a window is a
candidate where its rarest terms meet on one diagonal. Candidates are confirmed word by
word against the words that the index keeps about the rarest term, which makes the phrase
matches exact; texts are read to count terms and to build the index, and never shuffled.

The same index holds the postings of each item's rarest terms, for proximity matches: a
document is near an item if it has these terms, all within a span of words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from orrery.llm.common import LOWER, UPPER, cut, join_small, weigh

WINDOW = 10
#: Proximity: so many of an item's rarest terms that the corpus holds, within so many words.
NEAR_TERMS, NEAR_SPAN = 3, 20
#: A window's second list is intersected only where it is at most so many times as long as the first.
SECOND_LIST = 64
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of letters, digits and anything beyond ASCII; only A-Z are lower-cased."""
    text = F.coalesce(text, F.lit(""))
    # lower() is quick, but changes other letters too where there are any.
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, _BREAKS), "")


def row_key(id_: str = "doc_id", text: str = "text") -> Column:
    """Names a row by its id and a hash of its text; rows that agree in both share it."""
    return F.struct(F.col(id_).alias("id"), F.xxhash64(text).alias("text"))


@dataclass
class Phrases:
    """Windows to look for, and terms.

    ``items``: key, item_id, terms, windows (start, place of the rarest term, place of
    the second or null). ``needed``: term, key, place, lead (the rarest of some window).
    ``near``: key, item_id, term, rank, wanted (the number of ranks). Sizes are in bytes.
    """

    items: DataFrame
    needed: DataFrame
    near: DataFrame
    items_size: int
    needed_size: int
    near_size: int

    def terms(self) -> DataFrame:
        """``term, lead`` of all postings that the index has to hold."""
        every = self.needed.select("term", "lead").union(self.near.select("term", F.lit(False)))
        return every.groupBy("term").agg(F.max("lead").alias("lead"))


def item_words(benchmark: DataFrame) -> DataFrame:
    """``key, item_id, terms``: items that have words; ``key`` tells repeated ids apart."""
    return benchmark.select(F.xxhash64("item_id", "text").alias("key"), "item_id", words(F.col("text")).alias("terms")).filter(F.size("terms") > 0).dropDuplicates(["key"])


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each of ``terms`` stands in all texts of ``docs``."""
    stream = docs.select(F.explode(words(F.col("text"))).alias("term"))
    return join_small(stream, terms, ["term"], "left_semi", weigh(terms)[1]).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def plan_phrases(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> Phrases:
    items = cut(item_words(benchmark))
    terms = cut(items.select(F.explode("terms").alias("term")).distinct())
    counts = cut(term_counts(docs, terms))
    starts = F.sequence(F.lit(0), F.greatest(F.size("terms") - window, F.lit(0)))
    cells = items.select("key", F.explode(starts).alias("start"), "terms").select(
        "key", "start", F.posexplode(F.slice("terms", F.col("start") + 1, F.lit(window))).alias("off", "term")
    )
    cells = cells.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    place = (F.col("start") + F.col("off")).alias("place")
    order = Window.partitionBy("key", "start").orderBy("n", "place")
    ranked = cells.select("key", "start", "term", "n", place).withColumn("rank", F.row_number().over(order))
    firsts = ranked.filter("rank <= 2").groupBy("key", "start").agg(
        F.min("n").alias("least"),
        F.max(F.when(F.col("rank") == 1, F.col("place"))).alias("p"),
        F.max(F.when(F.col("rank") == 1, F.col("term"))).alias("pt"),
        F.max(F.when(F.col("rank") == 2, F.col("n"))).alias("second"),
        F.max(F.when(F.col("rank") == 2, F.col("place"))).alias("q"),
        F.max(F.when(F.col("rank") == 2, F.col("term"))).alias("qt"),
    )
    firsts = firsts.filter("least > 0")  # a term that the corpus lacks rules its windows out
    both = F.col("second") <= SECOND_LIST * F.col("least")
    q, qt = F.when(both, F.col("q")).alias("q"), F.when(both, F.col("qt")).alias("qt")
    firsts = cut(firsts.select("key", "start", "p", "pt", q, qt))
    needed = firsts.select("key", F.col("p").alias("place"), F.col("pt").alias("term"), F.lit(True).alias("lead"))
    needed = needed.union(firsts.filter("q is not null").select("key", "q", "qt", F.lit(False)))
    needed = cut(needed.groupBy("key", "place", "term").agg(F.max("lead").alias("lead")))
    listed = firsts.groupBy("key").agg(F.collect_list(F.struct("start", "p", "q")).alias("windows"))
    present = items.select("key", "item_id", F.explode(F.array_distinct("terms")).alias("term")).join(counts, "term")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("n", "term"))
    near = present.withColumn("rank", rank).filter(F.col("rank") <= NEAR_TERMS).drop("n")
    near = cut(near.withColumn("wanted", F.max("rank").over(Window.partitionBy("key"))))
    items = cut(items.join(listed, "key"))
    return Phrases(items, needed, near, weigh(items)[1], weigh(needed)[1], weigh(near)[1])


def postings(docs: DataFrame, terms: DataFrame, window: int = WINDOW) -> DataFrame:
    """The index: ``term, doc, pos, left, around`` for each place where one of ``terms`` stands.

    ``terms``: term, lead. A lead term's postings carry the words about them, ``left`` of
    them before it, so that a match can be confirmed without going back to the texts.
    """
    own = docs.select(row_key().alias("doc"), words(F.col("text")).alias("own"))
    stream = own.select("doc", "own", F.posexplode("own").alias("pos", "term"))
    terms = cut(terms)
    found = join_small(stream, terms, ["term"], "inner", weigh(terms)[1])
    left = F.least(F.col("pos"), F.lit(window - 1))
    around = F.when(F.col("lead"), F.slice("own", F.col("pos") - left + 1, left + window))
    return cut(found.select("term", "doc", "pos", left.alias("left"), around.alias("around")))


def matches(index: DataFrame, phrases: Phrases, window: int = WINDOW) -> DataFrame:
    """``doc, item_id, at, size``: the windows that documents hold, by place.

    Lists are laid on diagonals; a window needs its two rarest terms on one, and all of
    its words in the words about the rarest.
    """
    lists = join_small(index, phrases.needed, ["term"], "inner", phrases.needed_size)
    shift = (F.col("pos") - F.col("place")).alias("shift")
    seen = F.collect_set(F.when(F.col("lead"), F.struct("place", "left", "around")))
    met = lists.groupBy("doc", "key", shift).agg(F.collect_set("place").alias("met"), seen.alias("seen"))
    met = met.filter(F.size("seen") > 0)
    found = join_small(met, phrases.items, ["key"], "inner", phrases.items_size)
    size = F.least(F.size("terms"), F.lit(window))

    def holds(w: Column) -> Column:
        meet = F.array_contains("met", w["p"]) & (w["q"].isNull() | F.coalesce(F.array_contains("met", w["q"]), F.lit(False)))

        def equal(c: Column) -> Column:
            first = c["left"] - (w["p"] - w["start"])
            same = F.slice(c["around"], F.greatest(first, F.lit(0)) + 1, size) == F.slice("terms", w["start"] + 1, size)
            return (c["place"] == w["p"]) & (first >= 0) & same

        return meet & F.exists("seen", equal)

    kept = F.transform(F.filter("windows", holds), lambda w: w["start"] + F.col("shift"))
    hits = found.select("doc", "item_id", kept.alias("at"), size.alias("size")).filter(F.size("at") > 0)
    return hits


def near_items(index: DataFrame, phrases: Phrases, span: int = NEAR_SPAN) -> DataFrame:
    """``doc, key, item_id``: documents that hold an item's rarest terms, all within ``span`` words."""
    lists = join_small(index, phrases.near, ["term"], "inner", phrases.near_size)
    along = Window.partitionBy("doc", "key").orderBy("pos").rangeBetween(0, span - 1)
    here = [F.max((F.col("rank") == r).cast("int")).over(along) for r in range(1, NEAR_TERMS + 1)]
    near = lists.select("doc", "key", "item_id", "wanted", sum(here[1:], here[0]).alias("here"))
    return near.filter("here = wanted").select("doc", "key", "item_id").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, span: int = NEAR_SPAN) -> DataFrame:
    """One row per row of ``docs`` with its words, words hit, items found, and items that are near.

    Null and empty texts have no words; items without words are never found. Texts of any
    length are read whole. Repeated rows are judged alike; items may repeat an id. Terms that
    tie in rarity are taken in their own order. Without any items, or in an empty table,
    nothing is hit. Other columns of ``docs`` are not looked at, whatever their names.
    """
    phrases = plan_phrases(docs, benchmark, window)
    index = postings(docs, phrases.terms(), window)
    hits = matches(index, phrases, window)
    covered = F.flatten(F.transform("at", lambda a: F.sequence(a, a + F.col("size") - 1)))
    by_doc = hits.select("doc", "item_id", F.array_distinct(covered).alias("places")).groupBy("doc").agg(
        F.collect_set(F.col("item_id").cast("string")).alias("names"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places")
    )
    digests = by_doc.select(
        "doc", F.size("places").alias("hit"), F.size("names").alias("items"), F.array_join(F.array_sort("names"), ",").alias("joined"), F.lit(0).cast("long").alias("near")
    )
    near = near_items(index, phrases, span).groupBy("doc").agg(F.countDistinct(F.col("item_id").cast("string")).alias("near"))
    none = F.lit(None)
    digests = digests.unionByName(near.select("doc", none.cast("int").alias("hit"), none.cast("int").alias("items"), none.cast("string").alias("joined"), "near"))
    digests = digests.groupBy("doc").agg(*[F.max(x).alias(x) for x in ("hit", "items", "joined", "near")])
    n_words = F.size(words(F.col("text"))).cast("long").alias("n_words")
    out = docs.select("doc_id", n_words, row_key().alias("doc")).join(digests, "doc", "left")
    n_hit = F.coalesce("hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("joined", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.coalesce("near", F.lit(0)).cast("long").alias("n_near"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` whose own text holds no window of any item; rows that share an id are judged apart."""
    phrases = plan_phrases(docs, benchmark, window)
    leads = phrases.needed.groupBy("term").agg(F.max("lead").alias("lead"))
    gone = cut(matches(postings(docs, leads, window), phrases, window).select(F.col("doc").alias("__doc")).distinct())
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = join_small(docs.select(row_key().alias("__doc"), row.alias("__all")), gone, ["__doc"], "left_anti", weigh(gone)[1])
    return kept.select(*[F.col("__all")[c].alias(c) for c in docs.columns])


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return decontaminate(docs, benchmark)


#: The same rows in DuckDB, by joining all windows.
SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
bw AS (
  SELECT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)),
h AS (SELECT doc_id, item_id, i, dw.size AS size FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
p AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id),
bt AS (SELECT DISTINCT item_id, unnest(w) AS term FROM b),
dt AS (SELECT doc_id, term, pos FROM (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM d) WHERE term IN (SELECT term FROM bt)),
r AS (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY n, term) AS r FROM bt JOIN (SELECT term, count(*) AS n FROM dt GROUP BY term) USING (term)),
o AS (
  SELECT doc_id, dt.term, pos, item_id, r, max(CASE WHEN r = 1 THEN 1 ELSE 0 END) OVER s + max(CASE WHEN r = 2 THEN 1 ELSE 0 END) OVER s
    + max(CASE WHEN r = 3 THEN 1 ELSE 0 END) OVER s AS here
  FROM dt JOIN (SELECT * FROM r WHERE r <= 3) USING (term) WINDOW s AS (PARTITION BY doc_id, item_id ORDER BY pos RANGE BETWEEN CURRENT ROW AND 19 FOLLOWING)),
x AS (SELECT doc_id, count(DISTINCT o.item_id) AS n_near FROM o JOIN (SELECT item_id, least(3, max(r)) AS wanted FROM r GROUP BY item_id) g ON o.item_id = g.item_id AND here = wanted GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN x USING (doc_id)
"""
