"""Benchmark decontamination with spaced seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, words_of

#: Places of a word window that a seed reads; the others may be substituted. Each mask has 6 places, in spans of 9 to 11 words.
MASKS = ((0, 1, 3, 4, 7, 8), (0, 2, 3, 6, 8, 9), (0, 1, 5, 6, 9, 10))
#: Masks for items of SHORTEST to WINDOW - 1 words: the places they leave out are the 12 lines of the affine plane of 3 x 3 points, so that
#: any two of 9 consecutive words are left out by one of them.
_LINES = ((0, 1, 2), (3, 4, 5), (6, 7, 8), (0, 3, 6), (1, 4, 7), (2, 5, 8), (0, 4, 8), (1, 5, 6), (2, 3, 7), (0, 5, 7), (1, 3, 8), (2, 4, 6))
SHORT_MASKS = tuple(tuple(j for j in range(9) if j not in line) for line in _LINES)
#: Items with fewer words match only where all their words stand as they are.
SHORTEST = 9
#: Overlaps are judged in windows of so many words, of which so many may differ.
WINDOW, SUBSTITUTED = 13, 2
#: Up to so many seed hashes of the benchmark are broadcast (about 100 MB at most); beyond, they are joined by a shuffle.
BROADCAST_SEEDS = 1_000_000
#: Up to so many neighbouring word pairs of the benchmark make a filter of at most 2**FILTER_BITS bits, which goes with the plan.
FILTER_PAIRS, FILTER_BITS = 200_000, 22


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def seed_masks(masks: tuple[tuple[int, ...], ...], lengths: list[int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int, int | None]]:
    """(mask, fewest words, most words) of the items that each mask reads: SHORT_MASKS, and whole items under SHORTEST, only where `lengths` has such items."""
    short = [(mask, SHORTEST, window - 1) for mask in SHORT_MASKS if any(SHORTEST <= n < window for n in lengths)]
    return [*((mask, SHORTEST, None) for mask in masks), *short, *((tuple(range(n)), n, n) for n in sorted(set(lengths)) if 0 < n < SHORTEST)]


def _pairs(h: Column) -> Column:
    """A hash of each word with the next one."""
    return F.transform(h, lambda w, i: F.xxhash64(w, F.get(h, i + 1)))


def _bit(pair: Column, bits: int) -> tuple[Column, Column]:
    """Which 64-bit word of a filter a pair has, and its bit there."""
    place = F.shiftrightunsigned(pair, 64 - bits)
    return F.shiftrightunsigned(place, 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(63).cast("int"))


def pair_filter(items: DataFrame) -> tuple[Column, int] | None:
    """A bitmap of the neighbouring word pairs in items (h), as a literal array, and its size as a power of two; None if there are too many pairs."""
    pairs = items.select(F.explode(_pairs(F.col("h"))).alias("pair")).distinct()
    n = pairs.limit(FILTER_PAIRS + 1).count()
    if n > FILTER_PAIRS:
        return None
    bits = min(FILTER_BITS, max(10, (16 * n).bit_length()))
    word, bit = _bit(F.col("pair"), bits)
    words = [0] * (1 << bits - 6)
    for r in pairs.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bit")).collect():
        words[r["word"]] = r["bit"]
    return F.from_json(F.lit(str(words)), "array<bigint>"), bits


def _seeds(df: DataFrame, keep: list[str], masks: list[tuple[tuple[int, ...], int, int | None]], items: bool = False, known: tuple[Column, int] | None = None) -> DataFrame:
    """A row (keep, pos, seed) for each place and mask of df's hashed words `h`; in items, only for masks of their length. The word array itself isn't repeated in them.

    With a pair_filter, a place whose first neighbouring pair under the mask is in no item gets no row, as its seed can't be an item's.
    """

    def at_places(m: int, mask: tuple[int, ...], fewest: int, most: int | None) -> Column:
        n = F.size("h") - mask[-1]
        if items:
            n = F.when((F.size("h") >= fewest) & (F.lit(True) if most is None else F.size("h") <= most), n).otherwise(0)
        seed = lambda w, i: F.struct(i.alias("pos"), F.xxhash64(F.lit(m), *(F.get("h", i + o) for o in mask)).alias("seed"))
        pair = next((o for o in mask if o + 1 in mask), None)
        if known is None or pair is None:
            return F.transform(F.slice("h", F.lit(1), F.greatest(F.lit(0), n)), seed)
        maybe = F.transform("maybe", lambda w, i: F.when(w & (i >= pair) & (i - pair < n), seed(w, i - pair)))
        return F.array_compact(maybe)

    if known is not None:
        bitmap, bits = known

        def test(pair: Column) -> Column:
            word, bit = _bit(pair, bits)
            return F.get(bitmap, word).bitwiseAND(bit) != 0

        # sizes keep the projections apart, so that the arrays are computed once
        df = df.select(*keep, "h", _pairs(F.col("h")).alias("q"), F.size("h").alias("_n0"))
        df = df.select(*keep, "h", F.transform("q", test).alias("maybe"), F.size("q").alias("_n1"))
    every = df.select(*keep, F.concat(*(at_places(m, *mask) for m, mask in enumerate(masks))).alias("places"), F.size("h").alias("_n"))
    # the outer form, as for the plain one Spark would compute the whole array once more to filter out empty ones
    return every.select(*keep, F.explode_outer("places").alias("p")).select(*keep, "p.pos", "p.seed").where(F.col("seed").isNotNull())


def overlap(doc: Column, item: Column, diagonal: Column, window: int = WINDOW) -> tuple[Column, Column]:
    """Words of the item that stand at their places when it is laid on the document at `diagonal`: the most in any window, and all."""
    same = F.transform(item, lambda w, j: F.when(F.get(doc, (j + diagonal).cast("int")) == w, 1).otherwise(0))
    width = F.least(F.size(item), F.lit(window))
    starts = F.sequence(F.lit(1), F.size(item) - width + 1)
    most = F.array_max(F.transform(starts, lambda s: F.aggregate(F.slice(same, s, width), F.lit(0), lambda a, x: a + x)))
    return most, F.aggregate(same, F.lit(0), lambda a, x: a + x)


def _row_key(docs: DataFrame) -> Column:
    """Tells rows that repeat a doc_id apart by their texts."""
    return F.xxhash64(docs["doc_id"], docs["text"])


def contaminated_rows(docs: DataFrame, benchmark: DataFrame, masks: tuple[tuple[int, ...], ...] = MASKS, window: int = WINDOW, substituted: int = SUBSTITUTED, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(doc_id, doc_row, item_id, best_window, n_matched) for each row of docs, item and diagonal that count, as find_contamination says."""
    items = benchmark.select("item_id", _hashed(words_of(F.col("text"))).alias("h")).where(F.size("h") > 0)
    items = items.withColumn("row", F.xxhash64("item_id", "h")).dropDuplicates(["row"])
    lengths = [r.n for r in items.select(F.size("h").alias("n")).where(F.col("n") < window).distinct().collect()]
    seeded = seed_masks(masks, lengths, window)
    test = _seeds(items.withColumn("n", F.size("h")), ["row", "n"], seeded, items=True).select("seed", "row", "n", F.col("pos").alias("item_pos"))
    test = F.broadcast(test) if test.count() <= broadcast_seeds else test
    train = docs.select("doc_id", "text", _row_key(docs).alias("doc_row"))
    hashed = train.select("doc_row", _hashed(words_of(F.col("text"))).alias("h"))
    hits = _seeds(hashed, ["doc_row"], seeded, known=pair_filter(items)).join(test, "seed")
    diagonals = hits.select("doc_row", "row", "n", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct()
    # a document's words are hashed once more for all its diagonals; of each only as many words as the item has go on
    laid = diagonals.groupBy("doc_row").agg(F.collect_list(F.struct("row", "diagonal", "n")).alias("laid")).join(train, "doc_row")
    laid = laid.select("doc_id", "doc_row", _hashed(words_of(F.col("text"))).alias("h"), "laid")
    laid = laid.select("doc_id", "doc_row", "h", F.explode("laid").alias("l"), F.size("h").alias("_n"))
    under = F.slice("h", F.greatest(F.lit(1), F.col("l.diagonal") + 1), F.greatest(F.lit(0), F.col("l.n") + F.least(F.lit(0), F.col("l.diagonal"))))
    cut = laid.select("doc_id", "doc_row", F.col("l.row").alias("row"), F.least(F.lit(0), F.col("l.diagonal")).alias("diagonal"), under.alias("under"))
    met = cut.join(items.select("row", "item_id", F.col("h").alias("item")), "row")
    most, total = overlap(F.col("under"), F.col("item"), F.col("diagonal"), window)
    judged = met.select("doc_id", "doc_row", "item_id", F.least(F.size("item"), F.lit(window)).alias("width"), most.cast("bigint").alias("best_window"), total.cast("bigint").alias("n_matched"))
    return judged.where(F.col("best_window") >= F.col("width") - F.when(F.col("width") < SHORTEST, 0).otherwise(substituted)).drop("width")


def find_contamination(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """Pairs (doc_id, item_id) of documents and benchmark items that overlap, with `best_window` and `n_matched` words.

    Words are compared in lower case (A-Z) without punctuation. A seed hash reads the words at a mask's places, so the words between may
    differ. Test and training seeds are joined; each hit fixes how the item lies on the document (the diagonal), on which all its words are
    compared: a pair counts if some window of `window` words (or the whole item, if shorter) has at most `substituted` that differ.
    Items under SHORTEST words count only where all their words stand. Items under `window` words have masks of their own (seed_masks), so
    that no two substitutions hide one; documents get those seeds only if the benchmark has such items. Repeated ids count as one
    document or item, each of whose rows is compared, with the largest figures. Empty texts and nulls match nothing; very long texts are
    compared whole; other columns of either table don't matter.

    Documents' seeds are formed only where two neighbouring words stand together in some item (pair_filter, which leaves nothing out).
    The benchmark's seeds are broadcast while they number at most `broadcast_seeds`; beyond, seeds are joined by a shuffle. Either way only
    the diagonals that were hit go on, and their documents' words are compared once for each.
    """
    rows = contaminated_rows(docs, benchmark, **options)  # type: ignore[arg-type]
    return rows.groupBy("doc_id", "item_id").agg(F.max("best_window").alias("best_window"), F.max("n_matched").alias("n_matched"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """docs without the rows that overlap a benchmark item. Rows are judged each by their own text, also those that repeat a doc_id or have none."""
    found = contaminated_rows(docs, benchmark, **options).select(F.col("doc_id").alias("f_id"), F.col("doc_row").alias("f_row")).distinct()  # type: ignore[arg-type]
    keyed = docs.select(F.struct(*docs.columns).alias("document"), docs["doc_id"].alias("k_id"), _row_key(docs).alias("k_row"))
    return keyed.join(found, F.col("k_id").eqNullSafe(F.col("f_id")) & (F.col("k_row") == F.col("f_row")), "left_anti").select("document.*")


def op3_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents` against every item of `benchmark`: the contaminated pairs."""
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def oracle_sql(window: int = WINDOW, substituted: int = SUBSTITUTED) -> str:
    """The rule without seeds: every diagonal on which an item has a word in common with a document, all windows of it."""
    words = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT doc_id, {words} AS ws FROM documents)),
b AS (SELECT item_id, len(ws) AS n, unnest(ws) AS w, unnest(range(len(ws))) AS j FROM (SELECT item_id, {words} AS ws FROM benchmark)),
laid AS (
  SELECT doc_id, item_id, i - j AS diagonal, any_value(n) AS n, least(any_value(n), {window}) AS width, list(j) AS places FROM d JOIN b USING (w)
  GROUP BY doc_id, item_id, i - j HAVING count(*) >= least(any_value(n), {window}) - CASE WHEN any_value(n) < {SHORTEST} THEN 0 ELSE {substituted} END),
judged AS (
  SELECT doc_id, item_id, width, len(places) AS total,
    list_max(list_transform(range(n - width + 1), lambda k: len(list_filter(places, lambda p: p >= k AND p < k + width)))) AS inside FROM laid)
SELECT doc_id, item_id, CAST(max(inside) AS BIGINT) AS best_window, CAST(max(total) AS BIGINT) AS n_matched
FROM judged WHERE inside >= width - CASE WHEN width < {SHORTEST} THEN 0 ELSE {substituted} END GROUP BY doc_id, item_id
"""
