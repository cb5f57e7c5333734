"""Benchmark decontamination by SimHash of item-sized windows, with built-in functions only."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SENT_ROWS, SPACES, fresh, sent_if_small, written
from .simhash_dedup import _signed, block_masks

WORDS = 5


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of a text's word shingles in order; none for texts with fewer words, and for null.

    The list of words is bound as the one element of an array: named in the inner expression as often as it is used,
    it would be split anew for every shingle wherever the optimizer puts the expression in the place of its name.
    """
    split = F.split(F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\f\r")), SPACES)

    def hashed(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(words)]))
        return F.when(F.size(w) >= words, hashes).otherwise(F.array().cast("array<long>"))

    return F.get(F.transform(F.array(split), hashed), 0)


def simhash(hashes: Column) -> Column:
    """64 bits, each set if it is set in over half of the hashes, which count as often as they stand there."""

    def bit(b: Column) -> Column:
        ones = F.aggregate(hashes, F.lit(0), lambda n, h: n + F.getbit(h, b).cast("int"))
        return F.when(2 * ones > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(bit(b)))


def weighted_similarity(x: Column, y: Column) -> Column:
    """Sum of the smaller counts over the sum of the larger counts of the shingles of two windows."""
    common = F.aggregate(F.array_distinct(x), F.lit(0), lambda n, h: n + F.least(F.size(F.filter(x, lambda a: a == h)), F.size(F.filter(y, lambda b: b == h))))
    return common / (F.size(x) + F.size(y) - common)


def _neighbours(block: int, flips: int) -> list[int]:
    """Masks within one 8-bit block that change at most `flips` bits, as signed numbers."""
    return [_signed(m << (8 * block)) for m in range(256) if m.bit_count() <= flips]


def rare_shingles(items: DataFrame, hits: DataFrame, similarity: float) -> DataFrame:
    """(h, item_id, n): of an item's n shingles, repeats included, so many of the rarest that a text that has none of them
    cannot have similarity x n of the item's. hits: one row for each place in the documents of a shingle h that items have."""
    often = hits.groupBy("h").agg(F.count(F.lit(1)).alias("times"))
    order = Window.partitionBy("item_id", "item").orderBy("times", "h")  # an item's shingles
    ranked = items.select("item_id", "n", "item", F.explode("item").alias("h")).join(often, "h", "left").withColumn("times", F.coalesce("times", F.lit(0))).withColumn("rank", F.row_number().over(order))
    enough = F.col("n") - F.ceil(F.col("n") * similarity - F.lit(1e-9)) + 1
    return ranked.where(F.col("rank") <= enough).select("h", "item_id", "n").distinct()


def find_contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = 23, words: int = WORDS) -> DataFrame:
    """(doc_id, doc_key, item_id, start, n_words, similarity, distance): the best window of each document for each item
    that it repeats. doc_key is the SHA-256 of the text, start counts words from 0.

    A window of a document is as long as the item. Windows and items have a SimHash of their word shingles; the 64 bits
    are eight blocks, and a fingerprint within `radius` of an item's has a block within radius // 8 bits of the item's,
    so items are looked up under all those neighbours of each block and none is missed. The Hamming distance is
    verified, then the weighted similarity of the shingles themselves, counted with repeats, which must reach
    `similarity`.

    Windows that cannot reach it are never formed: of n shingles each, 2 x similarity / (1 + similarity) x n must be
    the item's own, so only stretches of a document with that many of its shingles are cut into windows, and a window is
    looked up among the items that it was cut for. An item is counted only in documents that have one of its rarest
    shingles (see rare_shingles), so a shingle that many items share, such as the stem of a question, brings no pairs of
    documents and items. This loses nothing, and the table of the items' shingles is all that
    every document has to be held against. Only the texts that windows are cut from are hashed a second time.

    A document with fewer shingles than the item has is one window, whole, and is verified without its SimHash, so
    its distance may be over `radius`. It must have similarity x n of the item's n shingles.

    Items with fewer than `words` words have no shingle and are found nowhere, nor is anything in documents as short;
    null texts are empty. Equal items are all reported. Null ids of documents are kept; a null item_id is left out.
    Repeated documents are worked once, and repeated rows of a document are reported once. Empty tables give an empty
    result. Other columns are ignored.
    """
    items = benchmark.where(F.col("item_id").isNotNull()).select("item_id", shingle_hashes(F.col("text"), words).alias("item")).where(F.size("item") > 0).dropDuplicates(["item_id", "item"])
    items = written(items.select("item_id", "item", F.size("item").alias("n"), simhash(F.col("item")).alias("item_fp")), "items")
    wanted = written(items.select("item_id", "n", F.explode("item").alias("h")).distinct(), "wanted")

    keyed = docs.select("doc_id", key_of(F.col("text")).alias("doc_key"), shingle_hashes(F.col("text"), words).alias("all"))
    spots = keyed.select("doc_id", "doc_key", F.posexplode_outer("all").alias("pos", "h"))  # outer: no filter that would hash the texts twice
    hits = written(spots.join(sent_if_small(written(wanted.select("h").distinct(), "shingles")), "h").select("doc_id", "doc_key", "pos", "h"), "hits")
    members = hits.select("doc_id", "doc_key").distinct()
    candidates = hits.select("doc_key", "h").distinct().join(sent_if_small(written(rare_shingles(items, hits, similarity), "rare")), "h").select("doc_key", "item_id", "n").distinct()
    spots = hits.select("doc_key", "pos", "h").distinct().join(written(candidates, "candidates"), "doc_key").join(wanted, ["item_id", "n", "h"])
    places = spots.groupBy("doc_key", "item_id", "n").agg(F.array_sort(F.collect_set("pos")).alias("at"))

    need = F.ceil(F.col("n") * (2 * similarity / (1 + similarity)) - F.lit(1e-9)).cast("int")
    runs = F.filter(F.sequence(F.lit(0), F.size("at") - F.col("need")), lambda i: F.get("at", i + F.col("need") - 1) - F.get("at", i) < F.col("n"))
    starts = F.flatten(F.transform(runs, lambda i: F.sequence(F.greatest(F.lit(0), F.get("at", i + F.col("need") - 1) - F.col("n") + 1), F.get("at", i))))
    windows = places.withColumn("need", need).where(F.size("at") >= F.col("need")).select("doc_key", "item_id", "n", F.explode(F.array_distinct(starts)).alias("start"))
    whole = places.where((F.size("at") >= F.ceil(F.col("n") * similarity - F.lit(1e-9))) & (F.array_max("at") < F.col("n") - 1)).select("doc_key", "item_id", "n", F.lit(0).alias("start"))
    windows = written(windows.unionByName(whole).distinct(), "windows")  # how short a document is shows once it is cut

    one = members.groupBy("doc_key").agg(F.min("doc_id").alias("_id")).withColumnRenamed("doc_key", "_key")
    cuts = windows.groupBy("doc_key").agg(F.collect_set(F.struct("n", "start")).alias("cut"))
    chosen = written(cuts.join(one, F.col("doc_key") == F.col("_key")).select("_key", "_id", "cut"), "chosen")
    bodies = docs.select("doc_id", "text", key_of(F.col("text")).alias("doc_key"))
    texts = bodies.join(sent_if_small(chosen, SENT_ROWS // 8, F.size("cut") + 8), (F.col("doc_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    cut = texts.select("doc_key", shingle_hashes(F.col("text"), words).alias("all"), "cut").select("doc_key", "all", F.explode("cut").alias("w"))
    cut = cut.select("doc_key", F.col("w.n").alias("n"), F.col("w.start").alias("start"), F.slice("all", F.col("w.start") + 1, F.col("w.n")).alias("window"))
    cut = cut.where((F.size("window") == F.col("n")) | ((F.col("start") == 0) & (F.size("window") < F.col("n")))).dropDuplicates(["doc_key", "n", "start"])
    cut = written(cut.withColumn("fp", simhash(F.col("window"))), "cut")

    masks = [_signed(m) for m in block_masks(8)]
    assert comb(8, 1) * (radius // 8 + 1) > radius  # some block is within radius // 8 bits
    by_block = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("block", "bits")
    near = F.explode(F.array(*[F.struct(F.lit(b).alias("block"), F.array(*[F.col("item_fp").bitwiseXOR(F.lit(x)).bitwiseAND(F.lit(masks[b])) for x in _neighbours(b, radius // 8)]).alias("bits")) for b in range(8)])).alias("e")
    probes = items.select("item_id", "n", "item_fp", near).select("item_id", "n", "item_fp", "e.block", F.explode("e.bits").alias("bits")).distinct()
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    asked = windows.join(cut.select("doc_key", "n", "start", "fp", F.size("window").alias("size")), ["doc_key", "n", "start"])
    pairs = asked.select("doc_key", "item_id", "n", "start", "fp", by_block).join(probes, ["item_id", "n", "block", "bits"]).where(distance <= radius).select("doc_key", "n", "start", "item_id", distance.alias("distance"))
    brief = asked.where(F.col("size") < F.col("n")).join(items.select("item_id", "n", "item_fp"), ["item_id", "n"]).select("doc_key", "n", "start", "item_id", distance.alias("distance"))
    pairs = pairs.unionByName(brief).distinct()
    full = pairs.join(cut.select("doc_key", "n", "start", "window"), ["doc_key", "n", "start"]).join(items.select("item_id", "n", "item"), ["item_id", "n"])
    scored = full.withColumn("similarity", weighted_similarity(F.col("window"), F.col("item"))).where(F.col("similarity") >= similarity - 1e-12)
    best = scored.groupBy("doc_key", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start", F.size("window").alias("n"), "distance")).alias("b"))
    best = best.select("doc_key", "item_id", F.col("b.start").alias("start"), (F.col("b.n") + words - 1).alias("n_words"), (-F.col("b.s")).alias("similarity"), F.col("b.distance").cast("int").alias("distance"))
    return members.join(best, "doc_key").select("doc_id", "doc_key", "item_id", "start", "n_words", "similarity", "distance")


def key_of(text: Column) -> Column:
    """What a text is known by: its SHA-256. Null is the empty text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows whose text repeats an item. Columns stay as they are, whatever their names.

    Null and empty texts stay, repeated rows go or stay together, an empty table gives an empty result, and an empty
    benchmark drops nothing. options: those of find_contamination.
    """
    (key,) = fresh(docs, "key")
    found = written(find_contamination(docs, benchmark, **options).select(F.col("doc_key").alias(key)).distinct(), "found")
    return docs.join(sent_if_small(found, SENT_ROWS // 4), key_of(F.col("text")) == F.col(key), "left_anti")
