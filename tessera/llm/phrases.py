"""Benchmark decontamination by a distributed positional inverted index, with DataFrame functions only.

The index holds one posting (document, position, term number) for each corpus word that occurs in
the benchmark; it is written once and read by all later steps. Each benchmark window looks up its
two rarest terms first: their postings, shifted by the terms' offsets in the window, are possible
starts, and starts that both lists give go on to the other terms. What all lists agree on is an
exact occurrence, whatever the documents look like.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common

#: Fixed value: what separates words (ASCII other than 0-9 and lower-case a-z).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SMALL_ROWS = 200_000
RAREST = 2
NO_ID = -(2**63)
MARK = "\x00"  # stands before a text's words; no word holds this character


def raw_words(text: Column) -> Column:
    """Words by position; the first and the last element may be empty strings."""
    return F.split(common.lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS)


def doc_key(id_col: Column, kind: T.DataType) -> Column:
    """A document's id as a long: whole numbers as they are, others by their hash, null as ``NO_ID``."""
    return F.coalesce(id_col.cast("long"), F.lit(NO_ID)) if isinstance(kind, T.IntegralType) else F.when(id_col.isNull(), F.lit(NO_ID)).otherwise(F.xxhash64(id_col))


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table whose counted rows are within the bound; else leave the join to Catalyst."""
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def windows(items: DataFrame, width: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, item, len, words): ``width`` consecutive words of an item, or all words of a shorter one.

    Items without words have no window; equal windows of different items are kept apart."""
    w = items.select(items[item_col].alias("item"), F.filter(raw_words(items[text_col]), lambda x: x != "").alias("w")).where(F.size("w") > 0)
    w = w.select("item", "w", F.least(F.lit(width), F.size("w")).alias("len")).select("item", "w", "len", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("at"))
    w = w.select("item", "len", F.slice("w", F.col("at"), F.col("len")).alias("words"))
    return w.select(F.xxhash64("words").alias("phrase"), "item", "len", "words")


def build_index(docs: DataFrame, terms: DataFrame, n_terms: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (id, h, pos, term) of the words in ``terms`` (word, term); a document is known by its
    id (see :func:`doc_key`) and text hash, so rows that share an id don't mix. Every row of ``docs`` also has one row
    at position -1, without a term, that holds its ``own_id`` and ``n_words``: texts are cut into words once. Written to
    the shared folder."""
    words = raw_words(docs[text_col])
    src = docs.select(docs[id_col].alias("own_id"), doc_key(docs[id_col], docs.schema[id_col].dataType).alias("id"), F.xxhash64(docs[text_col]).alias("h"), words.alias("words"))
    src = src.withColumn("n_words", F.size(F.filter("words", lambda w: w != "")).cast("long")).withColumn("words", F.concat(F.array(F.lit(MARK)), "words"))
    src = src.select("own_id", "id", "h", "n_words", F.posexplode("words").alias("at", "word"))  # nothing else reads the words, so no row carries all of them
    marked = terms.select("word", "term").unionByName(terms.sparkSession.createDataFrame([(MARK, None)], "word string, term long"))
    rows = src.join(small(marked, n_terms + 1), "word")
    only = lambda c: F.when(F.col("at") == 0, F.col(c)).alias(c)
    return common.written(rows.select("id", "h", (F.col("at") - 1).alias("pos"), "term", only("own_id"), only("n_words")), "postings")


def occurrences(index: DataFrame, phrases: DataFrame, slop: int = 0) -> DataFrame:
    """(id, h, start, phrase) where every word of a phrase stands at its place from ``start``, give or
    take ``slop`` positions (0: exact phrases; else proximity matches around the rarest term).

    ``phrases`` has (phrase, len, off, term). Phrases with a term that has no posting can't occur.
    """
    counts = common.written(index.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term-counts")
    ranked = phrases.join(small(counts, counts.count()), "term").withColumn("k", F.row_number().over(Window.partitionBy("phrase").orderBy("n", "off")))
    ranked = ranked.withColumn("there", F.count(F.lit(1)).over(Window.partitionBy("phrase"))).where("there = len").select("phrase", "len", "off", "term", "k")
    ranked = common.written(ranked, "ranked-terms")
    n = ranked.count()

    def starts(lists: DataFrame, postings: DataFrame) -> DataFrame:
        hit = postings.join(small(lists, n), "term")
        at = F.col("pos") - F.col("off")
        if not slop:
            return hit.select("id", "h", at.alias("start"), "phrase", "len", "k")
        shift = F.when(F.col("k") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(-slop), F.lit(slop)))
        return hit.withColumn("d", F.explode(shift)).select("id", "h", (at + F.col("d")).alias("start"), "phrase", "len", "k").distinct()

    first = starts(ranked.where(F.col("k") <= RAREST), index).groupBy("id", "h", "start", "phrase", "len").agg(F.bit_or(F.expr("shiftleft(1, k - 1)")).alias("lists"))
    first = first.where("lists = shiftleft(1, least(%d, len)) - 1" % RAREST).select("id", "h", "start", "phrase", "len")
    first = common.written(first, "candidates")
    where = first.select("id", "h").distinct()
    near = index.join(small(where, where.count()), ["id", "h"], "left_semi")
    rest = ranked.where(F.col("k") > RAREST)
    need = first.join(small(rest, n), ["phrase", "len"]).select("id", "h", "start", "phrase", "off", "term")
    if slop:
        need = need.withColumn("pos", F.explode(F.sequence(F.col("start") + F.col("off") - slop, F.col("start") + F.col("off") + slop)))
    else:
        need = need.withColumn("pos", F.col("start") + F.col("off"))
    agreed = need.join(near, ["id", "h", "pos", "term"]).select("id", "h", "start", "phrase", "off").distinct().groupBy("id", "h", "start", "phrase").agg(F.count(F.lit(1)).alias("n"))
    out = first.join(agreed, ["id", "h", "start", "phrase"], "left").where(F.coalesce("n", F.lit(0)) == F.greatest(F.lit(0), F.col("len") - RAREST))
    return out.select("id", "h", "start", "phrase", "len")


def judge(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, key, h, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs``; key (see
    :func:`doc_key`) and h, the text's xxhash64, tell rows apart.

    A word inside any occurrence of an item's window is hit; positions in several occurrences count
    once. Null text has no words. Repeated rows get equal results; null ids are kept. Without items
    nothing is hit, and the hash is that of the empty string.
    """
    win = common.written(windows(items, width, item_col, item_text), "windows")
    each = win.select("phrase", "len", F.posexplode("words").alias("off", "word")).distinct()
    terms = common.written(each.select("word").distinct().withColumn("term", F.xxhash64("word")), "terms")
    index = build_index(docs, terms, terms.count(), id_col, text_col)
    phrases = each.select("phrase", "len", "off", F.xxhash64("word").alias("term"))
    found = common.written(occurrences(index, phrases), "occurrences")

    spans = found.groupBy("id", "h", "start").agg(F.max(F.col("start") + F.col("len")).alias("stop"))
    before = Window.partitionBy("id", "h").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), F.coalesce(F.max("stop").over(before), F.col("start"))))
    hit = spans.withColumn("fresh", fresh).groupBy("id", "h").agg(F.sum("fresh").cast("long").alias("n_hit"))
    pairs = found.select("id", "h", "phrase").distinct()
    named = pairs.join(small(win.select("phrase", "item").distinct(), win.count()), "phrase").select("id", "h", F.col("item").cast("string").alias("item")).distinct()
    named = named.groupBy("id", "h").agg(F.array_sort(F.collect_list("item")).alias("items"))

    own = index.where("pos = -1").select("own_id", "id", "h", "n_words")
    out = own.join(hit.join(named, ["id", "h"]), ["id", "h"], "left")
    return out.select(
        F.col("own_id").alias("id"),
        F.col("id").alias("key"),
        "h",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The verdicts of :func:`judge` without key and h, under the name of the id column."""
    return judge(docs, items, width, id_col, text_col, item_col, item_text).drop("key", "h").withColumnRenamed("id", id_col)
