"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, with byte fallback and white-space markers."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_rows, table

#: Where the vocabulary is read from, on the driver only.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
#: A character that no piece covers costs so much more than the least likely piece.
UNKNOWN_PENALTY = 10.0
#: Words whose pieces a worker remembers at most.
REMEMBERED = 150_000
_RUN = re.compile(" *[^ ]+| +")
#: Scores are summed as whole multiples of 1 / SCALE, so that sums of the same pieces are equal wherever they begin.
SCALE = 1 << 20
_NEVER = -(1 << 60)
#: Bytes that the dynamic programme handles at once: of short parts few, which stay in a core's cache; of windows more, which share its steps.
BLOCK, WIDE_BLOCK = 1 << 14, 1 << 17
#: A part of more bytes without a space is cut into windows of CORE bytes that run side by side, each from WARM bytes before.
LONG, CORE, WARM = 2048, 1024, 128
#: Bytes of a UTF-8 character by its first byte; following bytes have 0.
_CHAR = np.zeros(256, np.int64)
_CHAR[:0x80], _CHAR[0xC0:0xE0], _CHAR[0xE0:0xF0], _CHAR[0xF0:0xF8] = 1, 2, 3, 4


def build_double_array(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value of a trie: from node s byte c leads to t = base[s] + c if check[t] = s; value[t] is the key that ends there, or -1."""
    children: list[dict[int, int]] = [{}]
    value = [-1]
    for k, key in enumerate(keys):
        at = 0
        for c in key:
            nxt = children[at].get(c)
            if nxt is None:
                nxt = children[at][c] = len(children)
                children.append({})
                value.append(-1)
            at = nxt
        value[at] = k
    size = 4 * len(children) + (1 << 16)
    base, check, held = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    used = bytearray(size)
    used[0] = 1
    place, free, wide, todo = {0: 0}, 257, 257, [0]
    for node in todo:  # the list grows as children are placed
        codes = sorted(children[node])
        if not codes:
            continue
        while used[free]:
            free += 1
        # single children fill the gaps; the places for several are looked for onwards only
        slot = max(free if len(codes) == 1 else max(free, wide), codes[0] + 1)
        while used[slot] or any(used[slot - codes[0] + c] for c in codes[1:]):
            slot += 1
        if len(codes) > 1:
            wide = slot
        at = place[node]
        base[at] = slot - codes[0]
        for c in codes:
            t = slot - codes[0] + c
            used[t], check[t] = 1, at
            child = children[node][c]
            held[t] = value[child]
            place[child] = t
            todo.append(child)
    top = max(place.values()) + 257
    return base[:top], check[:top], held[:top]


@dataclass
class UnigramTokenizer:
    """Pieces with log scores. Texts are read as UTF-8 with one space put before them; a space is the marker in pieces.

    Of all ways to cut a text into pieces the one with the largest sum of scores is taken. Characters without a piece become byte pieces.
    The marker's own character in a text becomes byte pieces too, so that every text is decoded to itself.
    """

    ids: np.ndarray  # the vocabulary id of each key of the trie
    scores: np.ndarray  # its log score
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    byte_ids: np.ndarray  # 256
    piece_bytes: list[bytes]  # of each vocabulary id, spaces for markers
    memory: dict[str, bytes] = field(default_factory=dict, repr=False)

    @classmethod
    def of(cls, pieces: list[tuple[int, str]], byte_ids: list[int]) -> UnigramTokenizer:
        """pieces: (id, piece), the likeliest first. Their scores follow Zipf's law in this order: -log(rank) - log(sum of 1 / rank)."""
        keys = [p.replace(MARKER, " ").encode() for _, p in pieces]
        rank = np.arange(1, len(keys) + 1)
        base, check, value = build_double_array(keys)
        blobs = [b""] * (1 + max([*byte_ids, *(i for i, _ in pieces)]))
        for (i, _), k in zip(pieces, keys, strict=True):
            blobs[i] = k
        for b, i in enumerate(byte_ids):
            blobs[i] = bytes([b])
        return cls(np.array([i for i, _ in pieces], np.int32), -np.log(rank) - np.log((1 / rank).sum()), base, check, value, np.array(byte_ids, np.int32), blobs)

    @classmethod
    def load(cls, path: str = VOCABULARY) -> UnigramTokenizer:
        """The pieces of a SentencePiece model in the order of their scores; a piece may have markers only at its start."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        plain = [i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        plain = [i for i in plain if MARKER not in model.id_to_piece(i).lstrip(MARKER)]
        plain.sort(key=lambda i: (-model.get_score(i), i))
        return cls.of([(i, model.id_to_piece(i)) for i in plain], [i for i in every if model.is_byte(i)])

    def __post_init__(self) -> None:
        self.costs = np.round(self.scores * SCALE).astype(np.int64)
        self.unknown = int(self.costs.min(initial=0)) - int(UNKNOWN_PENALTY * SCALE)
        self.depth = max([4, *(len(b) for b in self.piece_bytes)])  # bytes of the longest piece or character

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memory": {}}

    def segment(self, units: list[str]) -> list[bytes]:
        """The best pieces of each unit as int32 bytes. Units of similar length go through the dynamic programme together."""
        raw = [u.encode() for u in units]
        length = np.array([len(r) for r in raw])
        out: list[bytes] = [b""] * len(raw)
        order = np.argsort(length, kind="stable")
        sizes = length[order]
        a = 0
        while a < len(order) and sizes[a] <= LONG:
            widest = min(LONG, max(8, int(sizes[a] * 1.3)))
            b = min(int(np.searchsorted(sizes, widest, "right")), a + max(1, BLOCK // (widest + 1)))
            part = order[a:b]
            for k, ids in zip(part, self._short([raw[k] for k in part]), strict=True):
                out[k] = ids
            a = b
        for k in order[a:]:
            out[k] = self._long(np.frombuffer(raw[k], np.uint8))
        return out

    def _edges(self, raw: list[bytes], depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each row, end and column j the score and key of the piece that starts `depth - j` bytes before the end (depth: of the longest found if not given).

        All places of all rows walk down the trie together, a byte a step. A character that isn't a piece has the unknown score, and key -1.
        """
        length = np.array([len(r) for r in raw])
        width = int(length.max(initial=0))
        text = np.zeros((len(raw), width + 1), np.uint8)
        row = np.repeat(np.arange(len(raw)), length)
        place = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
        text[row, place] = np.frombuffer(b"".join(raw), np.uint8)
        flat, left = text.reshape(-1), np.repeat(length, length) - place
        at, steps, found = row * (width + 1) + place, 0, []
        long = np.minimum(_CHAR[flat[at]], left)
        begins = long > 0
        found.append((at[begins] + long[begins], long[begins], np.full(int(begins.sum()), -1)))
        state = np.zeros(len(at), np.int64)
        while len(at):
            step = self.base[state] + flat[at + steps]
            ok = (self.check[step] == state) & (left > steps)
            at, state, left, steps = at[ok], step[ok], left[ok], steps + 1
            key = self.value[state]
            ends = key >= 0
            found.append((at[ends] + steps, np.full(int(ends.sum()), steps), key[ends]))
        end, size, key = (np.concatenate(x) for x in zip(*found, strict=True))
        depth = depth or max(1, int(size.max(initial=1)))
        score = np.full((len(raw) * (width + 1), depth), _NEVER)
        which = np.full((len(raw) * (width + 1), depth), -1, np.int32)
        score[end, depth - size] = np.where(key >= 0, self.costs[np.maximum(key, 0)], self.unknown)  # pieces come after characters
        which[end, depth - size] = key
        return score.reshape(len(raw), width + 1, depth), which.reshape(len(raw), width + 1, depth)

    @staticmethod
    def _sums(score: np.ndarray, before: np.ndarray | None = None, begin: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The largest sums up to each place (after `depth` places before the first), and the column of the piece that ends there. Of equal sums
        the piece that starts first. before: the sums of the places up to `begin`, where rows don't start with nothing."""
        n, width, depth = score.shape
        best = np.full((n, depth + width), _NEVER)
        best[:, begin + 1 : begin + 1 + depth] = before if before is not None else _NEVER
        if before is None:
            best[:, depth] = 0
        column = np.zeros((n, width), np.int16)
        rows = np.arange(n)
        for e in range(begin + 1, width):
            sums = best[:, e : e + depth] + score[:, e]
            j = sums.argmax(1)
            column[:, e] = j
            best[:, e + depth] = np.maximum(sums[rows, j], _NEVER)
        return best, column

    def _short(self, raw: list[bytes]) -> list[bytes]:
        score, which = self._edges(raw)
        n, width, depth = score.shape
        if width < 2:
            return [b""] * n
        _, column = self._sums(score)
        length = np.array([len(r) for r in raw])
        # back from the ends; the pieces come out last first
        spot, steps = length.copy(), []
        while (live := spot > 0).any():
            r = np.flatnonzero(live)
            j = column[r, spot[r]]
            start = spot[r] - depth + j
            steps.append((r, start, spot[r], which[r, spot[r], j]))
            spot[r] = start
        rows, start, end, key = (np.concatenate(x) for x in zip(*steps[::-1], strict=True))
        order = np.argsort(rows, kind="stable")
        rows, start, end, key = rows[order], start[order], end[order], key[order]
        first = np.cumsum(length) - length
        ids, many = self._ids(np.frombuffer(b"".join(raw), np.uint8), start + first[rows], end + first[rows], key)
        bounds = np.concatenate([[0], np.cumsum(many)])[np.searchsorted(rows, np.arange(n + 1))]
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def _ids(self, text: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vocabulary ids of pieces in order, those of the bytes where the key is -1, and how many each has."""
        many = np.where(key >= 0, 1, end - start)
        which = np.repeat(np.arange(len(key)), many)
        inside = np.arange(len(which)) - (np.cumsum(many) - many)[which]
        return np.where(key[which] >= 0, self.ids[np.maximum(key[which], 0)], self.byte_ids[text[np.minimum(start[which] + inside, len(text) - 1)]]).astype(np.int32), many

    def _long(self, text: np.ndarray) -> bytes:
        """The best pieces of a long unit, as int32 bytes.

        Windows run side by side, each from some bytes before it. What follows a place depends only on the sums of the `depth` places up to it,
        less that of the place itself. Where a window has the same ones as the window before it, it goes on as that one would (sums are
        whole numbers); where not, it is run again from that one's. So the pieces are those of one run over the whole unit.
        """
        depth, n = self.depth, len(text)
        heads = np.flatnonzero(_CHAR[text] > 0)
        edge = lambda x: int(heads[k]) if (k := int(np.searchsorted(heads, x))) < len(heads) else n
        cores = sorted({edge(x) for x in range(0, n, CORE)} | {n})
        warm = [edge(max(0, c - WARM)) for c in cores[:-1]]
        start, key = np.zeros(n + 1, np.int64), np.full(n + 1, -1, np.int64)
        last = None
        again: dict[tuple[bytes, bytes], tuple[np.ndarray, np.ndarray]] = {}  # periodic texts come back to the same state and bytes
        each = max(1, WIDE_BLOCK // (CORE + WARM + 8))
        for a in range(0, len(warm), each):
            names = range(a, min(len(warm), a + each))
            score, which = self._edges([text[warm[k] : cores[k + 1]].tobytes() for k in names], depth)
            best, column = self._sums(score)
            for r, k in enumerate(names):
                c, e = cores[k] - warm[k], cores[k + 1] - warm[k]
                sums, col = best[r], column[r]
                if last is not None and not np.array_equal(self._state(sums, c), last):
                    name = (last.tobytes(), text[warm[k] : cores[k + 1]].tobytes())
                    if name not in again:
                        run = self._sums(score[r : r + 1], last, c)
                        again[name] = run[0][0], run[1][0]
                    sums, col = again[name]
                ends = np.arange(c + 1, e + 1)
                start[ends + warm[k]] = ends + warm[k] - depth + col[ends]
                key[ends + warm[k]] = which[r, ends, col[ends]]
                last = self._state(sums, e)
        froms, at, path = start.tolist(), n, []
        while at > 0:
            path.append(at)
            at = froms[at]
        end = np.array(path[::-1])
        return self._ids(text, start[end], end, key[end])[0].tobytes()

    def _state(self, sums: np.ndarray, at: int) -> np.ndarray:
        """The sums of the `depth` places up to one, less that of the place itself."""
        found = sums[at + 1 : at + 1 + self.depth]
        return np.where(found > _NEVER // 2, found - found[-1], _NEVER)

    @staticmethod
    def units(text: str) -> list[str]:
        """Parts that no piece crosses: spaces with the word after them, and line breaks."""
        parts: list[str] = []
        for k, line in enumerate((" " + text).split("\n")):
            if k:
                parts.append("\n")
            if "  " in line or line.endswith(" "):
                parts += _RUN.findall(line)
            elif line:
                first, *rest = line.split(" ")
                if first:
                    parts.append(first)
                parts += [" " + x for x in rest]
        return parts

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; null and empty texts have none."""
        cut = [self.units(t) if t else [] for t in texts]
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        new = list(set().union(*cut).difference(self.memory))
        self.memory.update(zip(new, self.segment(new), strict=True))
        known = self.memory.__getitem__
        return [np.frombuffer(b"".join(map(known, c)), np.int32) for c in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for, without the space that encoding put first."""
        if not hasattr(self, "_starts"):
            size = np.array([len(b) for b in self.piece_bytes])
            self._sizes, self._starts, self._blob = size, np.cumsum(size) - size, np.frombuffer(b"".join(self.piece_bytes), np.uint8)
        size = self._sizes[ids]
        shift = np.repeat(self._starts[ids] - (np.cumsum(size) - size), size)
        return self._blob[shift + np.arange(len(shift))].tobytes()[1:]


def encode_documents(docs: DataFrame, tokenizer: UnigramTokenizer, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (default: doc_id) with `ids`, the piece ids of the whole text (null and empty texts: none).

    Of cuts with equal sums the one whose last piece starts first wins (pieces are offered from the left, and only a larger sum replaces one). Rows that repeat a doc_id are encoded each by
    their own text; an empty table gives an empty result; a kept column may not be called `ids` (ValueError).
    """
    keep = keep or ["doc_id"]
    if "ids" in keep:
        raise ValueError("a kept column may not be called ids")
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def kernel(batch: pa.RecordBatch) -> dict:
        return {c: batch.column(c) for c in keep} | {"ids": pa.array(shared.value.encode(batch.column("_text").to_pylist()), pa.list_(pa.int32()))}

    rows = docs.select(*keep, docs["text"].alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", ids array<int>"
    return map_rows(rows, kernel, schema)


def decode_documents(encoded: DataFrame, tokenizer: UnigramTokenizer) -> DataFrame:
    """(doc_id, text) of (doc_id, ids). Bytes that are no UTF-8 become the replacement character; encoded texts have none."""
    shared = encoded.sparkSession.sparkContext.broadcast(tokenizer)

    def kernel(batch: pa.RecordBatch) -> dict:
        texts = [shared.value.decode(np.array(i or [], np.int64)).decode("utf-8", "replace") for i in batch.column("ids").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())}

    return map_rows(encoded.select("doc_id", "ids"), kernel, "doc_id long, text string")


def token_digests(docs: DataFrame, tokenizer: UnigramTokenizer) -> DataFrame:
    """Encodes and decodes every whole text: how many pieces and byte pieces it has, a crc32 of its ids (int32, little-endian),
    and whether decoding gives the text again. Null counts as empty. One row for each row of docs, repeated ids or not; an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def kernel(batch: pa.RecordBatch) -> dict:
        tok = shared.value
        texts = batch.column("text").to_pylist()
        ids = tok.encode(texts)
        low, high = int(tok.byte_ids.min()), int(tok.byte_ids.max())
        return {
            "doc_id": batch.column("doc_id"), "n_bytes": np.array([len((t or "").encode()) for t in texts], np.int64), "n_pieces": np.array([len(i) for i in ids], np.int64),
            "n_byte_pieces": np.array([int(np.count_nonzero((i >= low) & (i <= high))) for i in ids], np.int64),
            "ids_crc32": np.array([zlib.crc32(i) for i in ids], np.int64),
            "round_trip": np.array([tok.decode(i) == (t or "").encode() for i, t in zip(ids, texts, strict=True)], bool),
        }

    schema = "doc_id long, n_bytes long, n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean"
    return map_rows(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), kernel, schema)


def op6_unigram_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of `documents` encoded and decoded with the public vocabulary."""
    return token_digests(table(spark, sf_dir, "documents"), UnigramTokenizer.load())
