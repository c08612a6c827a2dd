"""Benchmark decontamination through a distributed positional inverted index.

The index holds a posting (term, document, position) for every occurrence of a benchmark term in
the training texts and is stored in the shared folder. A window of benchmark words is looked up
from its two rarest terms: their lists, shifted by their offsets in the item, are intersected on
the diagonal (position in the document minus position in the item). What is left is compared word
by word with the text, so matches are exact.

The same index answers proximity: all distinct words of an item, in any order, close together.

Everything here is DataFrame work. Tables made from the benchmark, and keys of documents found, are
broadcast only if rows and bytes show them small; beyond that they are joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import apart, ascii_lower, sha256_text, small, stored

#: a word after A-Z are lower-cased is ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``; this is the same before
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW, SLOP = 10, 20
#: alignments of a text that begin within so many words are compared in one row
STRETCH = 16_384


def words_of(text: Column) -> Column:
    """The lower-cased words; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _key(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """(did, h): rows with the same key have the same id, of whatever type or null, and the same text, so they have the same matches."""
    return F.xxhash64(F.col(doc_id).isNull(), F.col(doc_id)).alias("did"), F.xxhash64(text).alias("h")


def item_words(items: DataFrame) -> DataFrame:
    """Stored (ino, item_id, words) of the items (item_id, text) that have words; repeated rows once.

    ``ino`` numbers the texts: one item_id, or none, can have several.
    """
    found = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    return stored(found.select(F.monotonically_increasing_id().alias("ino"), "item_id", "words"), "items")


def build_index(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Stored postings (term, did, h, pos) of the words of ``items`` in ``docs`` (doc_id, text); pos counts words from 0."""
    terms = items.select(F.explode("words").alias("term")).distinct()
    tokens = docs.select(*_key(), F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    return stored(tokens.join(small(terms), "term").select("term", "did", "h", "pos"), "postings")


def term_counts(index: DataFrame) -> DataFrame:
    """Stored (term, freq): occurrences of each indexed term."""
    return stored(index.groupBy("term").agg(F.count("*").alias("freq")), "term-counts")


def lookup_slots(freq: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(ino, offset, term, alone): the two rarest terms of every window that the index can hold at all.

    A window with a term that no text has is left out. ``alone`` marks the only slot of a one-word window.
    """
    slots = items.select("ino", F.size("words").alias("n"), F.posexplode("words").alias("offset", "term")).join(freq, "term", "left")
    last = F.greatest(F.col("n") - window, F.lit(0))
    starts = F.sequence(F.greatest(F.col("offset") - window + 1, F.lit(0)), F.least(F.col("offset"), last))
    per = slots.withColumn("start", F.explode(starts)).groupBy("ino", "start", "n").agg(F.array_sort(F.collect_list(F.struct("freq", "offset", "term"))).alias("s"), F.count("freq").alias("known"))
    rare = per.where(F.col("known") == F.least("n", F.lit(window))).select("ino", F.explode(F.slice("s", 1, 2)).alias("x"), (F.col("known") == 1).alias("alone"))
    return rare.select("ino", "x.offset", "x.term", "alone").distinct()


def phrase_matches(docs: DataFrame, items: DataFrame, index: DataFrame, freq: DataFrame, window: int = WINDOW) -> DataFrame:
    """(did, h, item_id, lo, hi): stretches of document words that lie in occurrences of windows of an item.

    ``items``, ``index`` and ``freq`` come from item_words, build_index and term_counts. A window is
    ``window`` consecutive words of an item, or all words of an item that has fewer. Stretches of
    different alignments can overlap; a null item_id is kept; nothing in, nothing out.
    """
    slots = stored(lookup_slots(freq, items, window), "slots")
    on = index.join(small(slots), "term").select("ino", "did", "h", (F.col("pos") - F.col("offset")).alias("diag"), "offset", "alone")
    found = on.groupBy("ino", "did", "h", "diag").agg(F.min("offset").alias("lo"), F.max("offset").alias("hi"), F.max("alone").alias("alone")).where("lo < hi or alone")
    found = stored(found.select("ino", "did", "h", "diag").join(small(items.select("ino", F.size("words").alias("n"))), "ino"), "alignments")
    # of each alignment only the words that it covers are carried on, so a text with very many of them is not copied for each
    lists = found.groupBy("did", "h", F.floor(F.col("diag") / STRETCH).alias("stretch")).agg(F.collect_list(F.struct("ino", "diag", "n")).alias("at"))
    # the texts of other documents are not shuffled while the documents found are few enough to broadcast
    keys = small(found.select("did", "h").distinct())
    texts = docs.select(*_key(), "text").join(keys, ["did", "h"], "left_semi").join(lists, ["did", "h"]).select("did", "h", words_of(F.col("text")).alias("doc"), "at")
    before = F.greatest(-F.col("diag"), F.lit(0))  # words of the item that lie before the text
    cut = F.transform("at", lambda x: F.struct(x["ino"].alias("ino"), x["diag"].alias("diag"), F.slice("doc", F.greatest(x["diag"], F.lit(0)) + 1, F.greatest(x["n"] + F.least(x["diag"], F.lit(0)), F.lit(0))).alias("piece")))
    both = texts.select("did", "h", F.explode(cut).alias("x")).select("did", "h", "x.*").join(small(items), "ino")
    n = F.size("words")
    size = F.least(n, F.lit(window))
    same = F.transform("words", lambda w, i: F.when(i < before, F.lit(False)).otherwise(F.coalesce(F.get("piece", F.greatest(i - before, F.lit(0))) == w, F.lit(False))))
    hit = F.transform(F.sequence(F.lit(0), n - size), lambda s: F.forall(F.slice("same", s + 1, size), lambda x: x))
    # windows that occur one after the other are one stretch
    runs = both.withColumn("same", same).withColumn("hit", hit).where(F.exists("hit", lambda x: x))
    places = F.sequence(F.lit(0), F.size("hit") - 1)
    first = F.filter(places, lambda s: F.get("hit", s) & ~F.coalesce(F.get("hit", s - 1), F.lit(False)))
    last = F.filter(places, lambda s: F.get("hit", s) & ~F.coalesce(F.get("hit", s + 1), F.lit(False)))
    ends = runs.select("did", "h", "item_id", "diag", size.alias("size"), F.explode(F.arrays_zip(first.alias("a"), last.alias("b"))).alias("r"))
    return ends.select("did", "h", "item_id", (F.col("diag") + F.col("r.a")).alias("lo"), (F.col("diag") + F.col("r.b") + F.col("size") - 1).alias("hi"))


def proximity_matches(docs: DataFrame, items: DataFrame, index: DataFrame, freq: DataFrame, slop: int = SLOP) -> DataFrame:
    """(did, h, ino, gap): all n distinct terms of an item stand, in any order, so close that first and last are at most ``slop`` + n - 2 words apart; ``gap`` is the least such distance.

    Items of one distinct term have none, as have items with a term that is in no document. The two
    rarest terms give the candidates. Positions are put into bins of the greatest distance, so only near
    postings meet; only candidates' postings of the other terms are read. Repeated rows count once.
    """
    of_item = Window.partitionBy("ino")
    terms = items.select("ino", F.explode("words").alias("term")).distinct().join(freq, "term", "left")
    terms = terms.select("ino", "term", F.row_number().over(of_item.orderBy("freq", "term")).alias("r"), F.count("*").over(of_item).alias("n"), F.count("freq").over(of_item).alias("found"))
    terms = stored(terms.where((F.col("n") == F.col("found")) & (F.col("n") > 1)).withColumn("reach", F.col("n") + slop - 2), "item-terms")
    key = ["ino", "did", "h"]
    rare = index.join(small(terms.where("r <= 2").select("term", "ino", "r", "reach")), "term").withColumn("bin", F.floor(F.col("pos") / F.greatest("reach", F.lit(1))))
    left = rare.where("r = 1").select(*key, "bin", "reach", F.col("pos").alias("p")).distinct()
    right = rare.where("r = 2").select(*key, F.explode(F.array(*[F.col("bin") + d for d in (-1, 0, 1)])).alias("bin"), F.col("pos").alias("q")).distinct()
    pairs = left.join(right, [*key, "bin"]).where(F.abs(F.col("p") - F.col("q")) <= F.col("reach"))
    candidates = stored(pairs.select(*key).distinct(), "near-candidates")
    where = index.join(small(candidates.select("did", "h").distinct()), ["did", "h"], "left_semi").distinct()
    at = where.join(small(terms), "term").join(small(candidates), key)
    # from each posting on: the first place of each term within reach
    longest = terms.agg(F.max("reach")).first()[0] or 0
    ahead = F.collect_list(F.struct("pos", "term")).over(Window.partitionBy(*key).orderBy("pos").rangeBetween(0, longest))
    spans = at.select(*key, "pos", "n", "reach", ahead.alias("ahead"))
    spans = spans.withColumn("ahead", F.filter("ahead", lambda x: x["pos"] <= F.col("pos") + F.col("reach")))
    names = F.array_distinct(F.transform("ahead", lambda x: x["term"]))
    firsts = F.transform(names, lambda t: F.array_min(F.transform(F.filter("ahead", lambda x: x["term"] == t), lambda x: x["pos"])))
    near = spans.where(F.size(names) == F.col("n")).withColumn("gap", F.array_max(firsts) - F.col("pos"))
    return near.groupBy(*key).agg(F.min("gap").alias("gap"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    ``benchmark`` is (item_id, text). Null and wordless texts and items have no words, hence no hits;
    the digest of no items is that of the empty string. Ids may be of any type; rows without one are kept.
    Repeated rows are judged alike. Texts with one item_id are one item; those without any count as one
    more, which the digest leaves out. An empty benchmark hits nothing; no documents give no rows. Item
    ids are compared as strings. ``n_near`` is the number of benchmark texts whose distinct words, two or
    more, all stand within ``slop`` plus their number less 1 words.
    """
    items = item_words(benchmark)
    index = build_index(docs, items)
    freq = term_counts(index)
    hits = stored(phrase_matches(docs, items, index, freq, window), "hits")
    who = hits.groupBy("did", "h").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"), F.max(F.col("item_id").isNull()).alias("other"))
    # the union of the stretches of a text, of which at most one begins at each word
    part = Window.partitionBy("did", "h").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.groupBy("did", "h", "lo").agg(F.max("hi").alias("hi")).withColumn("seen", F.coalesce(F.max("hi").over(part), F.lit(-1)))
    size = spans.groupBy("did", "h").agg(F.sum(F.greatest(F.col("hi") - F.greatest(F.col("seen"), F.col("lo") - 1), F.lit(0))).alias("n_hit"))
    near = proximity_matches(docs, items, index, freq, slop).groupBy("did", "h").agg(F.count("*").alias("n_near"))
    per = stored(who.join(size, ["did", "h"]).join(near, ["did", "h"], "full"), "found")
    n_words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words")
    return docs.select("doc_id", *_key(), n_words).join(small(per), ["did", "h"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("ids") + F.col("other").cast("int"), F.lit(0)).cast("long").alias("n_items"),
        sha256_text(F.coalesce(F.array_join("ids", ","), F.lit(""))).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any hit, with all their columns; nulls, repeats and empty tables as in ``contamination``."""
    items = item_words(benchmark)
    index = build_index(docs, items)
    did, h = apart("_did", docs), apart("_h", docs)
    hit = phrase_matches(docs, items, index, term_counts(index), window).select(F.col("did").alias(did), F.col("h").alias(h)).distinct()
    hit = stored(hit, "hit-documents")
    own_did, own_h = _key()
    return docs.join(small(hit), (own_did == F.col(did)) & (own_h == F.col(h)), "left_anti")
