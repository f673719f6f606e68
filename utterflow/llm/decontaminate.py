"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

Test items are cut into windows of ``window`` words. Of each window the terms that are
rarest in the training text are its anchors. The index holds the postings
(term, document, position) of the anchors over all training tokens. Posting lists are
intersected after subtracting each anchor's offset in its item: an alignment of an
item in a document survives where the rarest and the next rarest terms of some window
agree on it. Survivors are compared with the document word by word.

Cases: a null or blank text has no words, and neither holds nor is a benchmark item;
an item of fewer words than a window is one window; a document's words inside any
occurrence are hit once, however many items cover them; rows that repeat a document
id are matched each; items with one id are one item in the counts; empty tables give
empty results, or no hits. Columns besides id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import saved

#: Bytes that separate words: all ASCII but digits and letters.
BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_BREAK_CHARS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Anchor terms are broadcast if their rows and characters come to this many bytes at most; more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def match_words(text: Column) -> Column:
    """Lower-cased (A-Z only) words of a text as an array; empty for null."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    lower = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    body = F.btrim(lower, F.lit(_BREAK_CHARS))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, BREAK))


def item_table(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``no, item, words`` of the items with words, numbered; rows that repeat an id stay apart."""
    some = items.select(F.col(id_col).alias("item"), match_words(F.col(text_col)).alias("words")).where(F.size("words") > 0).distinct()
    return saved(some.select(F.monotonically_increasing_id().alias("no"), "*"))


def _bounded(terms: DataFrame) -> DataFrame:
    """``terms`` (term, ...), to be broadcast if their measured size allows."""
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0))).first()[0]
    return F.broadcast(terms) if size <= BROADCAST_BYTES else terms


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, doc, pos`` of every training token that is among ``terms`` (one column)."""
    tokens = docs.select(F.col("doc"), F.posexplode(match_words(F.col("text"))).alias("pos", "term"))
    return tokens.join(_bounded(terms), "term", "left_semi")


def anchors(item_words: DataFrame, frequency: DataFrame, window: int, per_window: int = 2) -> DataFrame:
    """``no, at``: the offsets of each window's rarest terms, rarest first; windows with an unseen term have none."""
    place = item_words.select("no", F.posexplode("words").alias("offset", "term"))
    place = place.join(frequency, "term", "left").select("no", "offset", F.coalesce("n", F.lit(0)).alias("n"))
    # ties go to the earlier place, so that overlapping windows share anchors
    ranked = place.groupBy("no").agg(F.array_sort(F.collect_list(F.struct("offset", "n"))).alias("places"))
    spans = F.sequence(F.lit(0), F.greatest(F.size("places") - window, F.lit(0)))

    def pick(start: Column) -> Column:
        inside = F.slice("places", start + 1, window)
        order = F.array_sort(F.transform(inside, lambda p: F.struct(p["n"].alias("n"), p["offset"].alias("offset"))))
        return F.struct(F.get(order, 0)["n"].alias("n"), F.transform(F.slice(order, 1, per_window), lambda p: p["offset"]).alias("at"))

    windows = ranked.select("no", F.explode(F.transform(spans, pick)).alias("w")).where(F.col("w.n") > 0)
    return windows.select("no", F.col("w.at").alias("at")).distinct()


def alignments(docs: DataFrame, item_words: DataFrame, window: int) -> DataFrame:
    """``doc, no, start``: places where an item may lie in a document, ``start`` being its first word's.

    Lists meet in an aggregation of fixed-width rows: the least and greatest offset
    that agree on a start. One anchor is enough only for windows of one word.
    """
    vocabulary = item_words.select(F.explode("words").alias("term")).distinct()
    frequency = saved(postings(docs, vocabulary).groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    chosen = anchors(item_words, frequency, window)
    offsets = chosen.select("no", F.explode("at").alias("offset"), (F.size("at") == 1).alias("single")).groupBy("no", "offset").agg(F.max("single").alias("single"))
    places = saved(offsets.join(item_words, "no").select("no", "offset", "single", F.get("words", F.col("offset")).alias("term")))
    index = saved(postings(docs, places.select("term").distinct()))
    hits = index.join(_bounded(places), "term").select("doc", "no", (F.col("pos") - F.col("offset")).alias("start"), "offset", "single")
    agreed = hits.groupBy("doc", "no", "start").agg(F.min("offset").alias("_a"), F.max("offset").alias("_b"), F.max("single").alias("_one"))
    return agreed.where((F.col("_a") != F.col("_b")) | F.col("_one")).select("doc", "no", "start")


def _occurring(window: int) -> Column:
    """Item, window size and the starts, in the document, of the windows of each of ``found`` (item, words, starts) that occur there."""
    def at(a: Column, start: Column) -> Column:
        size = F.least(F.size(a["words"]), F.lit(window))
        first, last = F.greatest(F.lit(0), -start), F.least(F.size(a["words"]), F.size("_text") - start) - size
        span = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        same = lambda k: F.slice("_text", start + k + 1, size) == F.slice(a["words"], k + 1, size)
        return F.transform(F.filter(span, same), lambda k: start + k)

    starts = lambda a: F.flatten(F.transform(a["starts"], lambda start: at(a, start)))
    return F.transform("found", lambda a: F.struct(a["item"].alias("item"), F.least(F.size(a["words"]), F.lit(window)).alias("size"), starts(a).alias("at")))


def contamination(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10,
) -> DataFrame:
    """Document id, n_words, n_hit, n_items, items_sha256 and contaminated of every row, and ``matches``.

    ``matches`` is an array of (item, size, at): the exact phrase matches, ``at`` being
    the word positions at which windows of the item start.
    """
    texts = docs.select(F.col(doc_id).alias("doc"), F.col(doc_text).alias("text"))
    item_words = item_table(items, item_id, item_text)
    starts = alignments(texts, item_words, window).groupBy("doc", "no").agg(F.collect_list("start").alias("starts"))
    found = starts.join(item_words, "no").groupBy("doc").agg(F.collect_list(F.struct("item", "words", "starts")).alias("found"))
    found = found.withColumnRenamed("doc", "_doc")
    joined = texts.join(found, texts["doc"].eqNullSafe(found["_doc"]), "left").select("doc", "found", match_words(F.col("text")).alias("_text"))
    matches = joined.select("doc", F.size("_text").cast("long").alias("n_words"), F.filter(_occurring(window), lambda m: F.size(m["at"]) > 0).alias("matches"))
    cover = F.flatten(F.transform("matches", lambda m: F.flatten(F.transform(m["at"], lambda s: F.sequence(s, s + m["size"] - 1)))))
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item"].cast("string"))))
    counted = matches.select("doc", "n_words", "matches", F.size(F.array_distinct(cover)).alias("_hit"), ids.alias("_ids"))
    none = F.col("matches").isNull()
    return counted.select(
        F.col("doc").alias(doc_id), "n_words",
        F.when(none, 0).otherwise(F.col("_hit")).cast("long").alias("n_hit"),
        F.when(none, 0).otherwise(F.size("_ids")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("_ids", ","), F.lit("")), 256).alias("items_sha256"),
        (~none & (F.col("_hit") > 0)).alias("contaminated"),
        F.coalesce("matches", F.array().cast(matches.schema["matches"].dataType)).alias("matches"),
    )


def proximity_matches(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text",
    n_terms: int = 3, span: int = 20,
) -> DataFrame:
    """Document id, item id, ``first_pos`` and ``n_places``: the places of an item's rarest term that have its next rarest within ``span`` words.

    The item's ``n_terms`` rarest distinct terms in the training text, ties by the term, must
    all be closer than ``span`` words to the place, on either side. Items of fewer distinct terms need
    all of theirs, and items with a term that no document has match nowhere. Postings meet
    in stretches of ``span`` words, so the work follows the postings. A null text has no words,
    rows that repeat a document id are one document, and so are items; empty tables give an empty result.
    """
    texts = docs.select(F.col(doc_id).alias("doc"), F.col(doc_text).alias("text"))
    item_words = item_table(items, item_id, item_text)
    vocabulary = item_words.select(F.explode("words").alias("term")).distinct()
    frequency = saved(postings(texts, vocabulary).groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    terms = item_words.select("item", F.explode("words").alias("term")).distinct().join(frequency, "term", "left")
    order = F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term"))), 1, n_terms)
    rare = terms.groupBy("item").agg(order.alias("rare")).where(F.get("rare", 0)["n"] > 0)
    rare = saved(rare.select("item", F.size("rare").alias("needed"), F.posexplode("rare").alias("k", "r")).select("item", "needed", "k", "r.term"))
    index = saved(postings(texts, rare.select("term").distinct()))
    lists = index.join(_bounded(rare), "term").select("doc", "item", "needed", "k", "pos", F.expr(f"pos div {span}").alias("part"))
    anchor = lists.where("k = 0").select("doc", "item", "needed", "pos", F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)).alias("part"))
    rest = lists.where("k > 0").select(F.col("doc").alias("_doc"), F.col("item").alias("_item"), "k", F.col("pos").alias("at"), F.col("part").alias("_part"))
    met = anchor["doc"].eqNullSafe(rest["_doc"]) & anchor["item"].eqNullSafe(rest["_item"]) & (anchor["part"] == rest["_part"]) & (F.abs(F.col("at") - F.col("pos")) < span)
    near = anchor.join(rest, met, "left").groupBy("doc", "item", "needed", "pos").agg(F.count_distinct("k").alias("others")).where("others = needed - 1")
    return near.groupBy(F.col("doc").alias(doc_id), F.col("item").alias(item_id)).agg(F.min("pos").cast("bigint").alias("first_pos"), F.count(F.lit(1)).alias("n_places"))
