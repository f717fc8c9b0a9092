"""Removal of repeated byte strings with suffix arrays built by the difference-cover algorithm.

The suffixes of a corpus are not sorted as one list: that would shuffle every byte position several times. They are dealt by content.
A window of LENGTH bytes has an anchor, the place of its smallest GRAM-byte hash, which depends on the window's bytes alone, so equal
windows have the same anchor gram and meet in one class. A run of windows with the same anchor is a segment. Segments whose gram occurs once hold
no repeated window, and of equal segments (by a 128-bit digest) all but the earliest are repeats. What is left - different segments around the
same gram - is suffix-sorted, a block of whole classes at a time: sampled triples are sorted and named, the names sorted by recursion, the
remaining suffixes merged, and the prefixes of neighbours compared.

A class of more than CLASS segments is dealt on by longer grams until its parts are small enough to be sorted like all others: windows that
have at least half of their slack to the right of the gram share that much more on the right, the others share it on the left, so each
segment becomes two, around grams that are longer by half of what is missing. Six such steps at most give grams of whole windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_at, map_rows, prefix_hash, shared_table, shuffle_partitions, span_hash, table, text_bytes

LENGTH = 100
GRAM = 40
#: Window starts that are handled at once; longer texts are read in pieces.
PIECE = 1 << 20
#: Whole classes are suffix-sorted together until they have so many bytes.
BLOCK = 750_000
#: A class of more segments is dealt on by longer grams before it is sorted.
CLASS = 1000
#: A gram of more different segments in one slice of texts is announced to its class, and these segments are dealt by their digests.
CROWD = 8


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of s (integers from 1 on, fewer than 2**21 of them) in order, by the difference cover of 3 (Kärkkäinen and Sanders, 2003)."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    n0, n1 = (n + 2) // 3, (n + 1) // 3
    s = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    k = int(s.max()) + 1
    first, second = np.arange(1, n + (n0 - n1), 3), np.arange(2, n, 3)
    sample = np.concatenate([first, second])
    triples = (s[sample] * k + s[sample + 1]) * k + s[sample + 2]
    order = np.argsort(triples)
    changes = np.concatenate([[1], (np.diff(triples[order]) != 0).astype(np.int64)])
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(changes)
    if int(changes.sum()) < len(sample):
        order = suffix_array(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sample = sample[order]
    sample = sample[sample < n]
    rest = np.arange(0, n, 3)
    m = n + 3
    by_next = s[rest] * m + rank[rest + 1]
    turn = np.argsort(by_next)
    rest, by_next = rest[turn], by_next[turn]
    one, two = sample[sample % 3 == 1], sample[sample % 3 == 2]
    before = np.searchsorted(s[one] * m + rank[one + 1], by_next)
    before += np.searchsorted((s[two] * k + s[two + 1]) * m + rank[two + 2], (s[rest] * k + s[rest + 1]) * m + rank[rest + 2])
    out = np.empty(n, np.int64)
    at = np.arange(len(rest)) + before
    out[at] = rest
    others = np.ones(n, bool)
    others[at] = False
    out[others] = sample
    return out


def repeated_starts(text: np.ndarray, starts: np.ndarray, place: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of the window starts have an equal window at an earlier place. place: for each start what orders it; equal places don't count."""
    inside = np.full(len(text), -1, np.int64)
    inside[starts] = np.arange(len(starts))
    order = inside[suffix_array(text.astype(np.int64) + 1)]
    order = order[order >= 0]
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    words = np.zeros(len(text) + 1, np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | padded[k : k + len(words)]
    at = starts[order]
    same = np.ones(max(0, len(at) - 1), bool)
    for shift in [*range(0, length - 7, 8), length - 8]:
        w = words[at + shift]
        same &= w[1:] == w[:-1]
    group = np.concatenate([[0], np.cumsum(~same)])
    firsts = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(firsts, group, place[order])
    out = np.zeros(len(starts), bool)
    out[order] = place[order] > firsts[group]
    return out


def segments(body: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, lo, hi, anchor, gram hash) of every run of windows lo..hi (places in the row, as is the anchor) with the same anchor."""
    found: list[tuple[np.ndarray, ...]] = []
    reach = length - gram + 1
    n = len(body)
    for piece in range(0, max(0, n - length + 1), PIECE):
        part = body[piece : piece + PIECE + length - 1]
        prefix = prefix_hash(part)
        grams = np.arange(len(part) - gram + 1)
        h = span_hash(prefix, grams, grams + gram)
        low = (h & ~np.uint64((1 << 21) - 1)) | grams.astype(np.uint64)
        size = 1
        while size * 2 <= reach:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < reach:
            low = np.minimum(low[: -(reach - size)], low[reach - size :])
        start = np.arange(len(low)) + piece
        row = np.searchsorted(offsets, start, "right") - 1
        fits = start + length <= offsets[row + 1]
        anchor = (low & np.uint64((1 << 21) - 1)).astype(np.int64)
        new = np.ones(len(low), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (fits[1:] != fits[:-1])
        begin = np.flatnonzero(new)
        end = np.concatenate([begin[1:], [len(low)]]) - 1
        keep = fits[begin]
        begin, end = begin[keep], end[keep]
        r = row[begin]
        found.append((r, begin + piece - offsets[r], end + piece - offsets[r], anchor[begin] + piece - offsets[r], h[anchor[begin]].view(np.int64)))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


SEGMENT = "mark int, h long, sa long, sb long, doc long, tie long, lo int, hi int"
SPAN = "kind int, h long, sa long, sb long, doc long, tie long, lo int, hi int"
#: Marks of segments, in the order in which a task reads them: a repeat, one of a crowd, the announcement that a gram has one, any other.
GONE, CROWDED, ANNOUNCED, PLAIN = range(4)
#: Kinds of spans: repeated bytes, the first of the different segments of a shared gram, a segment whose class has a crowd somewhere.
REPEAT, FIRST, APART = range(3)


def _digests(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of a 128-bit BLAKE2b digest of each of some byte strings."""
    joined = b"".join([hashlib.blake2b(p, digest_size=16).digest() for p in parts])
    return tuple(np.frombuffer(joined, np.int64).reshape(-1, 2).T)  # type: ignore[return-value]


def _table(names: str, values: tuple) -> dict:
    kinds = [x.split() for x in names.split(", ")]
    n = next(len(v) for v in values if not np.isscalar(v))
    return {c: np.full(n, v, t) if np.isscalar(v) else np.asarray(v).astype(t) for (c, t), v in zip(((c, np.int64 if t == "long" else np.int32) for c, t in kinds), values, strict=True)}


def _cut(docs: DataFrame) -> DataFrame:
    """The segments of all texts. Of equal ones in a slice only the earliest goes on; the others are known to be repeats."""

    def kernel(batch: pa.RecordBatch) -> dict:
        body, offsets = text_bytes(batch.column("text"))
        row, lo, hi, _, h = segments(body, offsets)
        raw, start = body.tobytes(), offsets[row]
        sa, sb = _digests([raw[x:y] for x, y in zip((start + lo).tolist(), (start + hi + LENGTH).tolist(), strict=True)])
        doc, tie = (batch.column(c).to_numpy()[row] for c in ("doc", "tie"))
        order = np.lexsort((lo, tie, doc, sb, sa, h))
        h, sa, sb, doc, tie, lo, hi = columns = [x[order] for x in (h, sa, sb, doc, tie, lo, hi)]
        new_h, new = _changes(h), _changes(h, sa, sb)
        begin = np.flatnonzero(new)[np.cumsum(new) - 1] if len(h) else np.zeros(0, int)
        mark = np.where((doc != doc[begin]) | (tie != tie[begin]) | (lo != lo[begin]), GONE, PLAIN)
        cls = np.cumsum(new_h) - 1
        crowd = np.bincount(cls, new)[cls] > CROWD if len(h) else np.zeros(0, bool)
        mark[crowd & (mark == PLAIN)] = CROWDED
        told = crowd & new_h
        values = [np.concatenate([x, x[told]]) for x in (mark, *columns)]
        values[0][len(h) :] = ANNOUNCED
        return _table(SEGMENT, tuple(values))

    return map_rows(docs.select("doc", "tie", "text"), kernel, SEGMENT)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the one before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _spans(*values: np.ndarray | int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(_table(SPAN, values))


def _told_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of segments sorted by (mark below PLAIN or not, h, mark, digest, place): spans of repeats, the first of each different segment of a shared
    gram, and the segments of classes that have a crowd.

    Only one row is held back, the first of a class that has shown one segment so far.
    """
    last_h = last = last_place = held = announced = None
    several = False
    for batch in batches:
        mark, *rows = (batch.column(c).to_numpy() for c in ("mark", "h", "sa", "sb", "doc", "tie", "lo", "hi"))
        gone = mark == GONE
        if gone.any():
            h, sa, sb, doc, tie, lo, hi = (x[gone] for x in rows)
            yield _spans(REPEAT, 0, 0, 0, doc, tie, lo, hi + LENGTH)
        told = np.unique(rows[0][mark == ANNOUNCED])
        apart = mark == CROWDED
        apart |= (mark == PLAIN) & (np.isin(rows[0], told) | (rows[0] == announced if announced is not None else False))
        if len(told):
            announced = rows[0][mark == ANNOUNCED][-1]
        if apart.any():
            yield _spans(APART, *(x[apart] for x in rows))
        plain = (mark == PLAIN) & ~apart
        h, sa, sb, doc, tie, lo, hi = (x[plain] for x in rows)
        n = len(h)
        if not n:
            continue
        new_h, new = _changes(h), _changes(h, sa, sb)
        if last_h is not None and h[0] == last_h:
            new_h[0], new[0] = False, (sa[0], sb[0]) != last
        group = np.cumsum(new) - 1
        begins = np.flatnonzero(new)
        places = np.stack([doc, tie, lo], 1).astype(np.int64)
        first = places[begins[np.maximum(group, 0)]] if len(begins) else np.zeros((n, 3), np.int64)
        if group[0] < 0:
            first[group < 0] = last_place
        repeat = ~new & (places != first).any(1)
        if repeat.any():
            yield _spans(REPEAT, 0, 0, 0, doc[repeat], tie[repeat], lo[repeat], hi[repeat] + LENGTH)
        cls = np.cumsum(new_h)
        count = np.bincount(cls, new, int(cls[-1]) + 1).astype(int)
        if not new_h[0]:
            count[0] += 2 if several else 1
            if count[0] > 1 and held is not None:
                yield _spans(FIRST, *held)
                held = None
        emit = new & (count[cls] > 1)
        if emit.any():
            yield _spans(FIRST, h[emit], 0, 0, doc[emit], tie[emit], lo[emit], hi[emit])
        several = bool(count[cls[-1]] > 1)
        if new_h.any() or held is None:
            held = None
        if not several:
            k = np.flatnonzero(new & (cls == cls[-1]))
            if len(k):
                k = k[:1]
                held = (h[k], 0, 0, doc[k], tie[k], lo[k], hi[k])
        last_h, last = h[-1], (sa[-1], sb[-1])
        last_place = first[-1]


def settle(rows: DataFrame, more: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of segments (h, sa, sb, doc, tie, lo, hi, more), the first of each different one, and the others as repeats (doc, tie, lo, hi).

    Segments are grouped by gram and digest with partial aggregates, so a gram or a segment that is everywhere is no hot key.
    """
    key, place = ["h", "sa", "sb"], ["doc", "tie", "lo"]
    firsts = rows.groupBy(*key).agg(F.min(F.struct(*place, "hi", *more)).alias("m")).select(*key, "m.*")
    known = firsts.select(*key, F.struct(*place).alias("first"))
    repeats = rows.join(known, key).where(F.struct(*place) > F.col("first")).select(*place, (F.col("hi") + LENGTH).cast("int").alias("hi"))
    return firsts, repeats


def windows_of(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of segments put together; for each of their windows where it starts in them, its segment, and its place there."""
    length = np.array([len(b) for b in raw], np.int64)
    count = length - LENGTH + 1
    seg = np.repeat(np.arange(len(raw)), count)
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.frombuffer(b"".join(raw), np.uint8), np.repeat(np.cumsum(length) - length, count) + inner, seg, inner


PART = f"{SPAN}, at int, gram int, bytes binary"


def _sorted_blocks(batches: Iterator[pa.RecordBatch], block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Of segments (h, doc, tie, lo, bytes) sorted by h: the spans of their repeated windows."""
    kept: dict[str, list] = {c: [] for c in ("doc", "tie", "lo", "bytes")}
    last, size = None, 0

    def suffix_sorted() -> pa.RecordBatch:
        text, starts, seg, inner = windows_of(kept["bytes"])
        doc, tie, lo = (np.array(kept[c], np.int64) for c in ("doc", "tie", "lo"))
        order = np.lexsort((lo, tie, doc))
        # places in the order of (doc, tie, start): a rank for each text, then the start
        rank = np.zeros(len(doc), np.int64)
        rank[order] = np.cumsum(_changes(doc[order], tie[order])) - 1
        pick = np.flatnonzero(repeated_starts(text, starts, (rank[seg] << 32) | (lo[seg] + inner)))
        at = lo[seg[pick]] + inner[pick]
        return _spans(REPEAT, 0, 0, 0, doc[seg[pick]], tie[seg[pick]], at, at + LENGTH)

    for batch in batches:
        for h, *row in zip(*(batch.column(c).to_pylist() for c in ("h", *kept)), strict=True):
            if h != last and size > block:
                yield suffix_sorted()
                size = 0
                for c in kept:
                    kept[c].clear()
            last, size = h, size + len(row[-1])
            for c, v in zip(kept, row, strict=True):
                kept[c].append(v)
    if kept["doc"]:
        yield suffix_sorted()


def _parts(rows: list[tuple]) -> dict:
    """Rows (large, h, doc, tie, lo, bytes, at, gram) as a table of PART; `at` is where the gram starts in the bytes."""
    large, h, doc, tie, lo, raw, at, gram = (list(x) for x in zip(*rows, strict=True)) if rows else [[]] * 8
    sa, sb = _digests(raw)
    hi = np.array(lo, np.int64) + np.array([len(x) for x in raw], np.int64) - LENGTH
    return _table(f"{SPAN}, at int, gram int", (np.array(large, np.int32), np.array(h, np.int64), sa, sb, np.array(doc, np.int64), np.array(tie, np.int64), np.array(lo, np.int64), hi, np.array(at, np.int64), np.array(gram, np.int64))) | {"bytes": pa.array(raw, pa.binary())}


def _extracted(batch: pa.RecordBatch) -> dict:
    """The segments (segs) of texts with their bytes; kind says whether their class is large."""
    rows = []
    for doc, tie, text, segs in zip(*(batch.column(c).to_pylist() for c in ("doc", "tie", "text", "segs")), strict=True):
        raw = (text or "").encode()
        for s in segs:
            part = raw[s["lo"] : s["hi"] + LENGTH]
            at = 0
            if s["large"]:
                body = np.frombuffer(part, np.uint8)
                at = int(segments(body, np.array([0, len(body)]))[3][0])
            rows.append((s["large"], s["h"], doc, tie, s["lo"], part, at, GRAM))
    return _parts(rows)


def _dealt_on(batch: pa.RecordBatch) -> dict:
    """Each segment as up to two around longer grams: that of the windows which have what is added on their right, and that of the others."""
    rows = []
    for h, doc, tie, lo, at, gram, raw in zip(*(batch.column(c).to_pylist() for c in ("h", "doc", "tie", "lo", "at", "gram", "bytes")), strict=True):
        slack = LENGTH - gram
        right = (slack + 1) // 2
        left = slack - right + 1
        first, last = 0, len(raw) - LENGTH  # window starts
        for low, high, begin, end in ((max(first, at - (slack - right)), last, at, at + gram + right), (first, min(last, at - left), at - left, at + gram)):
            if low <= high:
                longer = raw[begin:end]
                name = hashlib.blake2b(b"%d %d " % (h, begin == at) + longer, digest_size=8).digest()
                rows.append((1, int.from_bytes(name, "little", signed=True), doc, tie, lo + low, raw[low : high + LENGTH], begin - low, len(longer)))
    return _parts(rows)


def _large(firsts: DataFrame, class_size: int) -> DataFrame:
    """(h, n) of the grams with over class_size different segments; written, so that the join with it is a plain one of two tables."""
    return shared_table(firsts.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > class_size))


def repeated_spans(docs: DataFrame, block: int = BLOCK, class_size: int = CLASS) -> DataFrame:
    """(doc, tie, lo, hi): spans of bytes of docs (doc, tie, text) that make up all repeated windows; they may overlap."""
    n = shuffle_partitions(docs.sparkSession)
    columns, place = ["doc", "tie", "lo", "hi"], ["doc", "tie", "lo"]
    dealt = F.when(F.col("mark") == GONE, F.xxhash64("doc", "lo")).when(F.col("mark") == CROWDED, F.xxhash64("h", "sa", "sb")).otherwise(F.xxhash64("h"))
    cut = _cut(docs).repartition(n, dealt).sortWithinPartitions(F.col("mark") < ANNOUNCED, "h", "mark", "sa", "sb", *place)
    apart = shared_table(cut.mapInArrow(_told_apart, SPAN))
    found = apart.where(F.col("kind") == REPEAT).select(columns)

    # grams with a crowd in some slice have different segments for certain
    crowds, again = settle(apart.where(F.col("kind") == APART), [])
    crowds = shared_table(crowds.select("h", *columns))
    firsts = apart.where(F.col("kind") == FIRST).select("h", *columns).union(crowds)
    large = _large(firsts, class_size)
    wanted = firsts.join(large, "h", "left").groupBy("doc", "tie").agg(F.collect_list(F.struct("h", "lo", "hi", F.col("n").isNotNull().cast("int").alias("large"))).alias("segs"))
    extracted = map_rows(docs.join(wanted, ["doc", "tie"]).select("doc", "tie", "text", "segs"), _extracted, PART)
    found = found.union(again.select(columns))

    def sort_blocks(parts: DataFrame) -> DataFrame:
        ordered = parts.repartition(n, F.xxhash64("h")).sortWithinPartitions("h").select("h", *place, "bytes")
        return ordered.mapInArrow(partial(_sorted_blocks, block=block), SPAN).select(columns)

    if large.isEmpty():
        return found.union(shared_table(sort_blocks(extracted)))
    parts = shared_table(extracted)
    ready = parts.where("kind = 0")
    while True:
        parts = shared_table(map_rows(parts.where("kind = 1"), _dealt_on, PART))
        firsts, again = settle(parts, ["at", "gram", "bytes"])
        found = found.union(shared_table(again.select(columns)))
        sizes = firsts.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
        parts = shared_table(firsts.join(sizes, "h").withColumn("kind", (F.col("n") > class_size).cast("int")).select(*(c.split()[0] for c in PART.split(", "))))
        ready = ready.union(parts.where("kind = 0"))
        if parts.where("kind = 1").isEmpty():
            return found.union(shared_table(sort_blocks(ready)))


def merged(spans: list, whole_characters: bytes | None = None) -> list[tuple[int, int]]:
    """Spans as maximal runs; within whole_characters shrunk so that they start and end between characters."""
    runs: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or []):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi)
        else:
            runs.append([lo, hi])
    if whole_characters is not None:
        inside = lambda k: k < len(whole_characters) and (whole_characters[k] & 0xC0) == 0x80
        for r in runs:
            while r[0] < r[1] and inside(r[0]):
                r[0] += 1
            while r[0] < r[1] and inside(r[1]):
                r[1] -= 1
    return [(lo, hi) for lo, hi in runs if lo < hi]


def with_spans(docs: DataFrame, block: int = BLOCK, class_size: int = CLASS) -> DataFrame:
    """(document, spans): each row of docs as a struct, and an array of (lo, hi) or null, the repeated bytes of its text.

    Rows are ordered by doc_id (null first); rows that repeat a doc_id with another text by a digest of it, and rows that repeat both
    count as one document. Null texts and texts under LENGTH bytes have no spans; an empty table gives an empty result.
    """
    again = docs.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    keyed = docs.select(F.struct(*docs.columns).alias("document"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))
    if again:
        # numbers in the order of the digests, for the different texts of each doc_id that has several
        pairs = keyed.select("doc", "digest").distinct()
        several = pairs.groupBy("doc").count().where("count > 1").select("doc")
        ties = shared_table(pairs.join(several, "doc", "left_semi").orderBy("doc", "digest").withColumn("tie", F.monotonically_increasing_id()))
        keyed = keyed.join(ties, ["doc", "digest"], "left").select("document", "doc", F.coalesce("tie", F.lit(0)).cast("long").alias("tie"))
    else:
        keyed = keyed.select("document", "doc", F.lit(0).cast("long").alias("tie"))
    source = keyed.select("doc", "tie", "document.text")
    spans = repeated_spans(source.dropDuplicates(["doc", "tie"]) if again else source, block, class_size)
    lists = spans.groupBy("doc", "tie").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return keyed.join(lists, ["doc", "tie"], "left").select("document", "spans")


def remove_repeats(docs: DataFrame, block: int = BLOCK, class_size: int = CLASS) -> DataFrame:
    """docs with the repeated bytes cut out of `text`. A character of which only a part is repeated stays whole, so that the text stays UTF-8."""

    def kernel(batch: pa.RecordBatch) -> dict:
        texts = []
        for text, spans in zip(column_at(batch, "document.text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            if spans:
                raw, at, kept = text.encode(), 0, []
                for lo, hi in merged(spans, raw):
                    kept.append(raw[at:lo])
                    at = hi
                text = b"".join([*kept, raw[at:]]).decode()
            texts.append(text)
        return {"document": batch.column("document"), "text": pa.array(texts, pa.string())}

    rows = with_spans(docs, block, class_size)
    cut = map_rows(rows, kernel, rows.select("document", "document.text").schema)
    return cut.select(*(F.col("text") if c == "text" else F.col("document").getField(c).alias(c) for c in docs.columns))


def repeat_digests(docs: DataFrame, block: int = BLOCK, class_size: int = CLASS) -> DataFrame:
    """For each row: n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of the remaining bytes."""

    def kernel(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
        for text, spans in zip(column_at(batch, "document.text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            raw, at = (text or "").encode(), 0
            runs, digest = merged(spans), hashlib.sha256()
            for lo, hi in runs:
                digest.update(raw[at:lo])
                at = hi
            digest.update(raw[at:])
            for c, v in zip(out, (len(raw), sum(hi - lo for lo, hi in runs), len(runs), digest.hexdigest()), strict=True):
                out[c].append(v)
        return {"doc_id": column_at(batch, "document.doc_id")} | {c: pa.array(v, pa.string() if c == "kept_sha256" else pa.int64()) for c, v in out.items()}

    rows = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), block, class_size)
    return map_rows(rows, kernel, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op7_difference_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of 100 bytes in all `documents`."""
    return repeat_digests(table(spark, sf_dir, "documents"))


#: The rule in SQL: all windows, by their bytes in hexadecimal (cut from blocks of 256 starts, as that is quicker than from the whole text).
ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
blocks AS (SELECT doc_id, n, b, substr(h, 512 * b + 1, 710) AS part FROM (SELECT *, unnest(range((greatest(0, n - 99) + 255) // 256)) AS b FROM d)),
starts AS (SELECT doc_id, b, part, unnest(range(least(256, n - 99 - 256 * b))) AS i FROM blocks),
windows AS (SELECT doc_id, 256 * b + i AS p, row_number() OVER (PARTITION BY substr(part, 2 * i + 1, 200) ORDER BY doc_id, 256 * b + i) AS k FROM starts),
late AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM windows WHERE k > 1),
runs AS (
  SELECT doc_id, min(p) AS lo, max(p) + 100 AS hi FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM late) GROUP BY doc_id, run),
pieces AS (
  SELECT doc_id, lo, hi, substr(h, 2 * before + 1, 2 * (lo - before)) AS kept
  FROM (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM runs) JOIN d USING (doc_id)),
cut AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last, string_agg(kept, '' ORDER BY lo) AS kept FROM pieces GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
