"""Near-duplicate groups: b-bit MinHash signatures, a multi-index Hamming join, and exact confirmation on full shingle sets."""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, map_rows, mix, shared_table, table

WORDS = 5
#: Documents are linked from this similarity on, in percent, unless the caller gives another.
SIMILAR = 85
#: A signature has CHUNKS chunks of CHUNK positions of 16 bits. Two signatures that differ in at most 2 * CHUNKS - 1 positions have a
#: chunk that differs in at most one; every such chunk is found as each of its positions in turn is left out of a key.
CHUNKS, CHUNK = 8, 5
#: Candidates must differ in at most max_different() of the 40 positions: at the lowest similarity more differ about twice in 10 million pairs.
RARELY = 2.5e-7
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_FACTORS = mix(np.arange(1, CHUNKS * CHUNK + 1, dtype=np.uint64)) | np.uint64(1)


def word_digests(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of a BLAKE2b digest of every word, in order, and how many words come before each row.

    Words are runs of bytes other than ASCII white space, A-Z in lower case. Arrow numbers the different ones, so each is digested once.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    real = pc.not_equal(flat, "")
    at = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])[lists.offsets.to_numpy()]
    words = flat.filter(real).dictionary_encode()
    digests = b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in words.dictionary.cast(pa.binary()).to_pylist())
    return np.frombuffer(digests, np.uint64).reshape(-1, 2)[words.indices.to_numpy()].T, at


def _chained(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of WORDS words that depends on their order."""
    h = np.zeros(size, np.uint64)
    for k in range(WORDS):
        h = mix(h * np.uint64(0x100000001B3) + words[k : k + size])
    return h


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct 5-word shingles of each row as two independent 64-bit hashes, in the order of these, and how many come before each row (2048 rows at most).

    With 1 to 4 words the whole sequence is one shingle.
    """
    words, at = word_digests(texts)
    rows, count = len(at) - 1, np.diff(at)
    row = np.repeat(np.arange(rows), count)
    size = max(0, len(row) - WORDS + 1)
    fits = row[:size] == row[WORDS - 1 :] if size else np.zeros(0, bool)
    short = np.flatnonzero((count > 0) & (count < WORDS))
    owner = np.concatenate([row[:size][fits], short])
    halves = []
    for half in words:
        whole = np.zeros(len(short), np.uint64)
        for k in range(WORDS - 1):
            has = count[short] > k
            whole[has] = mix(whole[has] * np.uint64(0x100000001B3) + half[at[short[has]] + k])
        halves.append(np.concatenate([_chained(half, size)[fits], mix(whole + count[short].astype(np.uint64))]))
    a, b = halves
    key = (owner.astype(np.uint64) << np.uint64(53)) | (a >> np.uint64(11))
    order = np.argsort(key)
    same = lambda x: x[order][1:] == x[order][:-1]
    if (same(key) & ~(same(a) & same(b))).any():  # the 53 bits don't order them
        order = np.lexsort((b, a, owner))
    new = np.ones(len(order), bool)
    new[1:] = ~(same(owner) & same(a) & same(b))
    order = order[new]
    return a[order], b[order], np.searchsorted(owner[order], np.arange(rows + 1))


def _set_digests(a: np.ndarray, b: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A 128-bit digest of both hashes of all shingles of each row."""
    both = np.stack([a, b], 1)
    digests = b"".join(hashlib.blake2b(both[x:y].tobytes(), digest_size=16).digest() for x, y in zip(before[:-1].tolist(), before[1:].tolist(), strict=True))
    return np.frombuffer(digests, np.int64).reshape(-1, 2).T


def signatures(sets: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The low 16 bits of the smallest hash of each row under 40 hash functions; rows without shingles get zeros."""
    out = np.zeros((len(before) - 1, CHUNKS * CHUNK), np.uint16)
    full = np.flatnonzero(np.diff(before))
    if len(full):
        x = mix(sets + np.uint64(0x2545F491))
        for k, a in enumerate(_FACTORS):
            out[full, k] = np.minimum.reduceat(x * a, before[full]) & np.uint64(0xFFFF)
    return out


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """For each row a key for each chunk and each of its positions, which reads the chunk without that position."""
    keys = np.empty(sig.shape, np.uint64)
    for c in range(CHUNKS):
        part = sig[:, c * CHUNK : (c + 1) * CHUNK].astype(np.uint64)
        for j in range(CHUNK):
            packed = np.zeros(len(sig), np.uint64)
            for k in range(CHUNK):
                if k != j:
                    packed = (packed << np.uint64(16)) | part[:, k]
            keys[:, c * CHUNK + j] = mix(packed + mix(np.array([c * CHUNK + j + 1], np.uint64)))
    return keys.view(np.int64)


def _lists(values: np.ndarray, width: int, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, width, dtype=np.int32)), pa.array(values.reshape(-1), kind))


def sign_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n_shingles, set_a and set_b, a digest of the shingle set, sig) for each row of docs; row is an md5 of the text."""

    def kernel(batch: pa.RecordBatch) -> dict:
        a, b, before = shingle_sets(batch.column("text"))
        set_a, set_b = _set_digests(a, b, before)
        sig = signatures(a, before)
        return {"doc_id": batch.column("doc_id"), "row": batch.column("row"), "n_shingles": np.diff(before), "set_a": set_a, "set_b": set_b, "sig": _lists(sig.view(np.int16), CHUNKS * CHUNK, pa.int16())}

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("row"), "text"), kernel, "doc_id long, row string, n_shingles long, set_a long, set_b long, sig array<short>")


def text_digest(text: Column) -> Column:
    """Tells rows that repeat a doc_id apart; a null text counts as empty."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def bucket_keys(nodes: DataFrame) -> DataFrame:
    """(key, slot, node) for every chunk key of every node (node, sig); a key belongs to one slot."""

    def kernel(batch: pa.RecordBatch) -> dict:
        sig = batch.column("sig").flatten().to_numpy(zero_copy_only=False).view(np.uint16).reshape(-1, CHUNKS * CHUNK)
        return {"node": batch.column("node"), "keys": _lists(chunk_keys(sig), CHUNKS * CHUNK, pa.int64())}

    return map_rows(nodes.select("node", "sig"), kernel, "node long, keys array<long>").select("node", F.posexplode("keys").alias("slot", "key"))


def meets_first(a: Column, b: Column, slot: Column) -> Column:
    """Whether `slot` is the first at which two signatures have the same key, so that a pair comes up once and not in every bucket it shares."""
    differ = F.zip_with(a, b, lambda x, y: (x != y).cast("int"))
    inside = lambda chunk: F.aggregate(F.slice(differ, chunk * CHUNK + 1, CHUNK), F.lit(0), lambda n, d: n + d)
    chunk = F.floor(slot / CHUNK).cast("int")
    earlier = F.filter(F.sequence(F.lit(0), chunk), lambda c: (c < chunk) & (inside(c) <= 1))
    return (F.size(earlier) == 0) & ((slot % CHUNK == 0) | (inside(chunk) > 0))


def max_different(similar: int) -> int:
    """The fewest positions of which more differ at most RARELY at a similarity of so many percent."""
    n, q = CHUNKS * CHUNK, 1 - similar / 100
    return next(d for d in range(n + 1) if sum(comb(n, k) * q**k * (1 - q) ** (n - k) for k in range(d + 1, n + 1)) <= RARELY)


def near(a: Column, b: Column, similar: int = SIMILAR) -> Column:
    """Whether two signatures differ in at most max_different(similar) positions."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: d)) <= max_different(similar)


def shingles_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text, shingles): texts and hashes of the full shingle sets of the documents whose doc_id is in nodes (node)."""

    def kernel(batch: pa.RecordBatch) -> dict:
        a, _, before = shingle_sets(batch.column("text"))
        return {"node": batch.column("node"), "text": batch.column("text"), "shingles": pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(a.view(np.int64)))}

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(nodes, "node", "left_semi")
    return map_rows(texts, kernel, "node long, text string, shingles array<long>")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with the sizes of their full sets (na, nb) and of what they share (shared), by hashes; of repeated doc_ids, the pair that shares most."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    rows = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("shared"))
    return rows.groupBy("a", "b").agg(F.max(F.struct("shared", "na", "nb")).alias("m")).select("a", "b", "m.shared", "m.na", "m.nb")


def word_shingles(text: str | None) -> set[tuple[bytes, ...]]:
    """The shingles of a text as the words themselves."""
    words = (text or "").encode().translate(_LOWER).split()
    return set(zip(*(words[k:] for k in range(WORDS)), strict=False)) if len(words) >= WORDS else {tuple(words)} if words else set()


def linked(rows: DataFrame, sets: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The pairs (a, b) of overlaps() that are similar enough, by their hashes and then by their words.

    Each side is joined with the texts by itself, so that few pairs are broadcast to them and many split by the adaptive skew join.
    """
    close = rows.where(F.lit(100) * F.col("shared") >= F.lit(similar) * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")
    close = shared_table(close)
    side = lambda x: close.join(sets.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")), x)

    def kernel(batch: pa.RecordBatch) -> dict:
        known: dict[str | None, set] = {}
        keep = []
        for ta, tb in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
            x, y = (known[t] if t in known else known.setdefault(t, word_shingles(t)) for t in (ta, tb))
            shared = len(x & y)
            keep.append(100 * shared >= similar * (len(x) + len(y) - shared))
        return {"a": batch.column("a"), "b": batch.column("b"), "keep": pa.array(keep, pa.bool_())}

    judged = map_rows(side("a").join(side("b"), ["a", "b"]).select("a", "b", "text_a", "text_b"), kernel, "a long, b long, keep boolean")
    return judged.where("keep").select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of edges (a, b) is connected with.

    Each round joins every component with its smallest neighbour and contracts the edges, so the number of components that still have
    one falls at least by half; rounds are cut by checkpoints in the shared folder.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = both.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "node").checkpoint()
    while True:
        left = both.join(labels.select(F.col("node").alias("a"), F.col("component").alias("x")), "a").join(labels.select(F.col("node").alias("b"), F.col("component").alias("y")), "b")
        open_edges = left.where("x != y").select("x", "y").distinct()
        parent = open_edges.groupBy("x").agg(F.least("x", F.min("y")).alias("p")).checkpoint()
        if parent.isEmpty():
            return labels
        up = parent.join(parent.select(F.col("x").alias("p"), F.col("p").alias("q")), "p", "left").select("x", F.coalesce("q", "p").alias("p"))
        labels = labels.join(up, labels["component"] == up["x"], "left").select("node", F.coalesce("p", "component").alias("component")).checkpoint()


def may_link(x: str, y: str, similar: int = SIMILAR) -> Column:
    """Whether two nodes can be similar enough, by lower bounds of how many shingles only one of them has (`similar` allows
    (100 - similar) / (100 + similar) of both sizes). No such pair is lost:

    - `own` shingles of a node occur in no other open node, so the other one lacks them;
    - a pair with the same pivot differs in at least what either differs from the pivot in (`apart`), less twice what both
      may differ in alike, to which own shingles do not belong.
    """
    col = lambda side, name: F.col(f"{side}.{name}")
    limit = F.lit(100 - similar) * (col(x, "n") + col(y, "n"))
    alike = F.least(*(F.greatest(F.lit(0), col(side, "apart") - col(side, "own")) for side in (x, y)))
    by_pivot = (col(x, "pivot") != col(y, "pivot")) | (F.lit(100 + similar) * (col(x, "apart") + col(y, "apart") - 2 * alike) <= limit)
    return (F.lit(100 + similar) * (col(x, "own") + col(y, "own")) <= limit) & by_pivot & near(col(x, "sig"), col(y, "sig"), similar)


def near_duplicates(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """One row for each row of docs (doc_id, text): row (text_digest), n_shingles, component_id (the smallest doc_id reachable over links) and kept.

    Links: 100 * shared shingles >= similar * all shingles of the two. Rows with the same shingle set are one class, which the smallest doc_id
    stands for; classes get 40 chunk keys each. A first round tries every class against one pivot: of the most frequented classes of its
    buckets, the most frequented. A second round takes the pairs in a bucket that are not yet in the same component and that bounds
    (may_link) do not rule out; nodes with more shingles of their own than any link allows are out before that. Both confirm on the full
    sets, of the words themselves (linked). Texts without words are linked with nothing, as are rows without a doc_id
    (component_id null, kept). Rows that repeat a doc_id are judged each by their own text. Other columns of docs don't matter.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    signed = sign_documents(docs).checkpoint()
    same_set = ["n_shingles", "set_a", "set_b"]
    classes = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*same_set).agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig")).checkpoint()
    sigs = classes.select("node", "sig")
    keyed = bucket_keys(classes)
    crowded = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = keyed.join(crowded, "key").checkpoint()
    met = members.groupBy("node").agg(F.sum("size").alias("met"))
    sets = shared_table(shingles_of(docs, met.select("node")))

    known = members.join(met, "node").select("key", "node", "met")
    centres = known.groupBy("key").agg(F.max(F.struct(F.col("met"), (-F.col("node")).alias("less"))).alias("top"))
    stars = known.join(centres, "key").select(F.col("top").alias("top"), (-F.col("top.less")).alias("a"), F.col("node").alias("b")).where("a != b").distinct()
    stars = stars.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
    chosen = stars.where(near(F.col("sa"), F.col("sb"), similar)).groupBy("b").agg(F.max("top").alias("top")).select((-F.col("top.less")).alias("a"), "b")
    tried = overlaps(chosen, sets).checkpoint()
    edges = linked(tried, sets, similar).checkpoint()
    found = components(edges)

    placed = members.join(found, "node", "left").select("key", "slot", "node", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key")
    open_members = placed.join(mixed, "key", "left_semi").checkpoint()
    pivots = tried.select(F.col("b").alias("node"), F.col("a").alias("pivot"), (F.col("na") + F.col("nb") - 2 * F.col("shared")).alias("apart"))
    nodes = open_members.select("node").distinct().join(pivots, "node", "left")
    nodes = nodes.select("node", F.coalesce("pivot", "node").alias("pivot"), F.coalesce("apart", F.lit(0)).alias("apart"))
    seen = nodes.select("node").union(nodes.select(F.col("pivot").alias("node"))).distinct()
    shingles = sets.join(seen, "node", "left_semi").select("node", F.explode("shingles").alias("h"))
    own = shingles.groupBy("h").agg(F.min("node").alias("node"), F.max("node").alias("last")).where("node = last").groupBy("node").agg(F.count("*").alias("own"))
    sizes = sets.groupBy("node").agg(F.min(F.size("shingles")).alias("n"), F.count("*").alias("rows"))
    # a repeated doc_id has several sets: bounds that hold for one set say nothing then
    facts = nodes.join(sizes, "node").join(own, "node", "left").join(sigs, "node").select(
        "node", "pivot", "apart", "sig", F.when(F.col("rows") > 1, F.lit(1 << 40)).otherwise(F.col("n")).cast("bigint").alias("n"), F.coalesce("own", F.lit(0)).alias("own"))
    # of the union with any partner at least `own` shingles are not shared, and the union has at most 100 / similar of the node's shingles
    candidates = open_members.join(facts.where(F.col("own") * similar <= F.lit(100 - similar) * F.col("n")), "node").checkpoint()
    x, y = candidates.alias("x"), candidates.alias("y")
    crossing = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component")) & may_link("x", "y", similar) & meets_first(F.col("x.sig"), F.col("y.sig"), F.col("x.slot")))
    pairs = crossing.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    more = linked(overlaps(pairs, sets), sets, similar).checkpoint()
    if not more.isEmpty():
        found = components(edges.union(more))

    labelled = classes.select(*same_set, "node").join(found, "node", "left").select(*same_set, F.coalesce("component", "node").alias("component"))
    rows = signed.select("doc_id", "row", *same_set).join(labelled, same_set, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.select("doc_id", "row", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op4_multi_index_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate groups of all `documents`."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("row")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(root, node) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.root, t.b FROM reach r JOIN both_ways t ON t.a = r.node)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT root AS doc_id, min(node) AS component_id FROM reach GROUP BY root) c USING (doc_id)
"""
