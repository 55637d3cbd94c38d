"""SentencePiece encoding with seeded merge-dropout, and decoding.

The merge-type (BPE) segmentation is run here with an agenda of candidate merges, best piece score first. Each
candidate is skipped with the dropout rate, drawn by a keyed hash of the seed, the document's id, its text, the
fragment's place in it and the candidate's number in order of appearance: every occurrence of a word is drawn by
itself, the same seed always gives the same segmentation, and rate 0 the library's own. The hash gives the numbers of
the skipped candidates, as gaps of the geometric law, for all fragments of a batch at once; a fragment's segmentation
depends on these numbers only, so it is kept in a tree by fragment and skipped numbers. Fragments are cut where no
piece of the model has the two bytes side by side, so no merge could span the cut. Any segmentation decodes to the
text it came from: the model's normaliser is the identity, unknown characters fall back to bytes, and the word mark
U+2581 inside a text is written as bytes.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from fairgrid.llm.common import documents, worker_table
from fairgrid.llm.token_cache import flat_bytes, flattened, strings

MARK = "▁"
MARK_BYTES = np.frombuffer(MARK.encode(), np.uint8)
#: Fragments of more characters are segmented with a heap, each occurrence anew.
LONG = 48
NEVER = 1 << 40
#: The rank of no piece, and fragments that are segmented at once.
NONE, ROWS = 1 << 30, 8192
GOLDEN, ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1
#: Bytes of text that are encoded at once.
GROUP_BYTES = 4 << 20


def _mixed(x):
    """The 64-bit finaliser of splitmix64, for arrays of unsigned integers and for integers under 2**64."""
    one = isinstance(x, int)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = x ^ (x >> shift)
        x = x * factor & ALL if one else x * np.uint64(factor)
    return x ^ (x >> 31)


class Grown:
    """An array of numbers that grows at its end."""

    def __init__(self, kind: type):
        self.held, self.size = np.zeros(1024, kind), 0

    def extend(self, values: np.ndarray) -> None:
        while self.size + len(values) > len(self.held):
            self.held = np.concatenate([self.held, np.zeros_like(self.held)])
        self.held[self.size : self.size + len(values)] = values
        self.size += len(values)


class DropoutEncoder:
    """Encodes with one model, seed and rate; about ``entries`` segmentations are kept by fragment and skipped candidates.

    A symbol is the rank of its piece by score, so the least rank of two neighbours' union is the next merge.
    """

    def __init__(self, model_path: str, rate: float, seed: int, entries: int = 500_000):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = self.library.get_piece_size()
        self.ids = {self.library.id_to_piece(i): i for i in range(size) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i))}
        self.pieces = sorted(self.ids, key=lambda x: (-self.library.get_score(self.ids[x]), x))
        ranks = {piece: rank for rank, piece in enumerate(self.pieces)}
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.log_kept = -math.inf if rate >= 1 else math.log1p(-rate) if rate > 0 else 0.0
        self.seed, self.entries = seed, entries
        #: Bytes that stand side by side in some piece, marks as spaces, and bytes that go on with a character.
        self.together = np.zeros((256, 256), bool)
        self.together[:, 0x80:0xC0] = True
        for piece in self.pieces:
            data = np.frombuffer(piece.replace(MARK, " ").encode(), np.uint8)
            self.together[data[:-1], data[1:]] = True
        letters = sorted({c for piece in self.pieces for c in piece} - ranks.keys())
        ranks |= {c: len(self.pieces) + k for k, c in enumerate(letters)}  # letters that are no pieces
        self.blank = len(ranks)  # the symbol of all other characters and of no character
        self.symbol = np.full(0x110000, self.blank, np.int32)
        for c, rank in ranks.items():
            if len(c) == 1:
                self.symbol[ord(c)] = rank
        self.symbol[ord(" ")], self.symbol[ord(MARK)] = ranks.get(MARK, self.blank), self.blank  # spaces are marks, marks are bytes
        pairs = [(ranks[p[:k]] * (self.blank + 1) + ranks[p[k:]], ranks[p]) for p in self.pieces for k in range(1, len(p)) if p[:k] in ranks and p[k:] in ranks]
        self._hash_pairs(np.array(pairs, np.int64).reshape(-1, 2))
        self.id_of = np.array([self.ids[p] for p in self.pieces], np.uint32)
        self._clear()

    def _hash_pairs(self, pairs: np.ndarray) -> None:
        """A table of open addresses: the pair's key and its union's rank in one integer."""
        self.slots = 1 << max(4, int(8 * len(pairs)).bit_length())
        self.table = np.full(self.slots, -1, np.int64)
        packed, at = pairs[:, 0] << 16 | pairs[:, 1], self._slot(pairs[:, 0])
        while len(packed):
            free = self.table[at] < 0
            self.table[at[free]] = packed[free]
            left = self.table[at] != packed
            packed, at = packed[left], (at[left] + 1) % self.slots

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(GOLDEN) >> np.uint64(64 - self.slots.bit_length() + 1)).astype(np.int64)

    def _union(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the unions of neighbouring symbols, NONE where they form no piece."""
        keys = left.astype(np.int64) * (self.blank + 1) + right
        at = self._slot(keys)
        held = self.table[at]
        out = np.where(held >> 16 == keys, held & 0xFFFF, NONE)
        left_over = np.flatnonzero((held >= 0) & (held >> 16 != keys))
        while len(left_over):
            at[left_over] = (at[left_over] + 1) % self.slots
            held = self.table[at[left_over]]
            good = held >> 16 == keys[left_over]
            out[left_over[good]] = held[good] & 0xFFFF
            left_over = left_over[(held >= 0) & ~good]
        return out

    def _clear(self) -> None:
        self.known = pa.array([], pa.string())
        self.root_of = np.zeros(0, np.int64)
        #: By node: the candidates its agenda sees, its first child, its ids in the pool, its fragment, its parent and the number skipped last.
        self.seen, self.first, self.start, self.count, self.word, self.parent, self.skipped = (Grown(np.int64) for _ in range(7))
        #: Nodes by their parent's first child and the number skipped next; -1: not yet seen.
        self.children, self.pool = Grown(np.int64), Grown(np.uint32)
        #: Characters of the fragments.
        self.letters, self.letter_start, self.letter_count = Grown(np.uint32), Grown(np.int64), Grown(np.int64)

    def _gaps(self, key: np.ndarray, k: int) -> np.ndarray:
        """Candidates passed before skip number ``k``, by the mixed keys of fragments."""
        u = ((_mixed(key + np.uint64(k)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        return np.minimum(np.floor(np.log(u) / self.log_kept), 1 << 30).astype(np.int64)

    def _all_skips(self, key: int) -> Iterator[int]:
        """The skips of one fragment, one by one."""
        at = -1
        for k in range(1 << 62 if self.log_kept else 0):
            u = ((_mixed(key + k & ALL) >> 11) + 0.5) * 2.0**-53
            at += 1 + min(math.floor(math.log(u) / self.log_kept), 1 << 30)
            yield at
        yield NEVER

    def segment_one(self, letters: np.ndarray, skips: Iterator[int]) -> tuple[list[int], int]:
        """Symbols of one fragment of any length, best rank first, leftmost of equals, by a heap; candidates seen.

        Characters without a symbol come as ``-1 - character``.
        """
        n = len(letters)
        known = self.symbol[letters].tolist()
        symbols = [s if s < len(self.pieces) else -1 - int(c) for s, c in zip(known, letters.tolist())]
        held = [*known, self.blank]
        before, after = list(range(-1, n)), list(range(1, n + 2))
        unions = self._union(np.array(known[:-1], np.int64), np.array(known[1:], np.int64)).tolist() if n > 1 else []
        live, agenda, seen, skip = [NONE] * n, [], 0, next(skips)

        def meet(left: int, rank: int) -> None:
            nonlocal seen, skip
            if rank != NONE:
                if seen == skip:
                    rank, skip = NONE, next(skips, NEVER)
                else:
                    heapq.heappush(agenda, rank << 32 | left)
                seen += 1
            live[left] = rank

        for left, rank in enumerate(unions):
            meet(left, rank)
        while agenda:
            top = heapq.heappop(agenda)
            left = top & 0xFFFFFFFF
            if live[left] != top >> 32:
                continue
            right = after[left]
            held[left] = symbols[left] = top >> 32
            symbols[right] = None
            live[left] = live[right] = NONE
            after[left] = after[right]
            before[after[right]] = left
            for at in (before[left], left):
                if at >= 0 and after[at] < n:
                    meet(at, int(self._union(np.array([held[at]]), np.array([held[after[at]]]))[0]))
        return [x for x in symbols if x is not None], seen

    def segment_many(self, starts: np.ndarray, counts: np.ndarray, skips: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for many short fragments at once, with a row of ``skips`` for each: ``(symbols, their number, candidates seen)``.

        The fragments' characters stand in ``letters``; each round makes the best merge of every fragment.
        """
        order = np.argsort(counts, kind="stable")
        flat, numbers, seen = [np.zeros(0, np.int64)], np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
        for at in range(0, len(order), ROWS):
            own = order[at : at + ROWS]
            symbols, numbers[own], seen[own] = self._segment_rows(starts[own], counts[own], skips[own])
            flat.append(symbols)
        begins = np.zeros(len(counts), np.int64)
        begins[order] = np.cumsum(numbers[order]) - numbers[order]
        return flattened(np.concatenate(flat), begins, numbers), numbers, seen

    def _segment_rows(self, starts: np.ndarray, counts: np.ndarray, skips: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, width = len(counts), max(1, int(counts.max(initial=0)))
        place = np.arange(width)
        inside = place < counts[:, None]
        letters = self.letters.held[np.where(inside, starts[:, None] + place, 0)]
        held = np.where(inside, self.symbol[letters], self.blank)
        symbols = np.where(held < len(self.pieces), held, -1 - letters.astype(np.int64))
        live = np.full((n, width), NONE, np.int32)
        unions = self._union(held[:, :-1].ravel(), held[:, 1:].ravel()).reshape(n, width - 1)
        valid = unions != NONE
        number = np.cumsum(valid, axis=1) - 1
        for k in range(skips.shape[1]):
            unions[valid & (number == skips[:, k : k + 1])] = NONE
        live[:, :-1] = unions
        seen = valid.sum(axis=1)
        after, before = np.tile(place + 1, (n, 1)), np.tile(place - 1, (n, 1))
        held, symbols, live, after, before, stays = (np.ascontiguousarray(x).ravel() for x in (held, symbols, live, after, before, inside))
        busy = np.arange(n)
        rows = live.reshape(n, width)

        def meet(own: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
            ranks = self._union(left, right)
            good = ranks != NONE
            ranks[good & (skips[own] == seen[own, None]).any(axis=1)] = NONE
            seen[own] += good
            live[at] = ranks

        while True:
            mine = rows[busy]
            best = mine.argmin(axis=1)
            rank = mine[np.arange(len(busy)), best]
            on = rank != NONE
            busy, best, rank = busy[on], best[on], rank[on]
            if not len(busy):
                break
            first = busy * width
            left = first + best
            right = first + after[left]
            beyond = after[right]
            held[left] = symbols[left] = rank
            stays[right] = False
            live[left] = live[right] = NONE
            after[left] = beyond
            more = np.flatnonzero(beyond < width)
            before[first[more] + beyond[more]] = best[more]
            has = np.flatnonzero(before[left] >= 0)
            at = first[has] + before[left[has]]
            meet(busy[has], at, held[at], rank[has])
            meet(busy[more], left[more], rank[more], held[first[more] + beyond[more]])
        return symbols[stays], stays.reshape(n, width).sum(axis=1), seen

    def _spelled(self, symbols: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, characters without one as their bytes: ``(ids, ids of each fragment)``."""
        odd = symbols < 0
        if not odd.any():
            return self.id_of[symbols], numbers
        each = np.ones(len(symbols), np.int64)
        kinds, which = np.unique(symbols[odd], return_inverse=True)
        spelled = [[self.bytes[b] for b in (MARK if c == 0x20 else chr(c)).encode("utf-8", "surrogatepass")] for c in (-1 - kinds).tolist()]
        sizes = np.array([len(x) for x in spelled], np.int64)
        each[odd] = sizes[which]
        pool = np.concatenate([self.id_of, np.array([i for x in spelled for i in x], np.uint32)])
        starts = np.where(odd, 0, symbols)
        starts[odd] = len(self.id_of) + (np.cumsum(sizes) - sizes)[which]
        ends = np.concatenate([[0], np.cumsum(each)])
        upto = np.concatenate([[0], np.cumsum(numbers)])
        return flattened(pool, starts, each), np.diff(ends[upto])

    def _add(self, words: np.ndarray, parents: np.ndarray, skipped: np.ndarray, ids: np.ndarray, counts: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """New nodes; their places."""
        at = self.seen.size + np.arange(len(words))
        self.start.extend(self.pool.size + np.cumsum(counts) - counts)
        self.count.extend(counts)
        self.pool.extend(ids)
        self.first.extend(self.children.size + np.cumsum(seen) - seen)
        self.children.extend(np.full(int(seen.sum()), -1, np.int64))
        for held, values in ((self.seen, seen), (self.word, words), (self.parent, parents), (self.skipped, skipped)):
            held.extend(values)
        return at

    def _grow(self, words: np.ndarray, parents: np.ndarray, skips: np.ndarray) -> np.ndarray:
        """Segment ``words`` with ``skips``, the last of which is new to ``parents``; the new nodes."""
        symbols, numbers, seen = self.segment_many(self.letter_start.held[words], self.letter_count.held[words], skips)
        last = skips[:, -1] if skips.shape[1] else np.full(len(words), -1, np.int64)
        return self._add(words, parents, last, *self._spelled(symbols, numbers), seen)

    def _roots(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(fragments, nodes without skips)`` of distinct fragments, node -1 for long ones."""
        if self.seen.size > self.entries or self.letters.size > 32 * self.entries:
            self._clear()
        codes = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        lacking = codes < 0
        if lacking.any():
            own = words.filter(pa.array(lacking))
            counts = pc.utf8_length(own).to_numpy(zero_copy_only=False).astype(np.int64)
            at = self.letter_start.size + np.arange(len(own))
            self.letter_start.extend(self.letters.size + np.cumsum(counts) - counts)
            self.letter_count.extend(counts)
            data, _ = flat_bytes(own)
            self.letters.extend(np.frombuffer(str(data.tobytes(), "utf-8").encode("utf-32-le"), np.uint32))
            short = counts <= LONG
            roots = np.full(len(own), -1, np.int64)
            roots[short] = self._grow(at[short], np.full(int(short.sum()), -1, np.int64), np.zeros((int(short.sum()), 0), np.int64))
            self.root_of = np.concatenate([self.root_of, roots])
            self.known = pa.concat_arrays([self.known, own])
            codes[lacking] = at
        return codes, self.root_of[codes]

    def _drawn(self, words: np.ndarray, nodes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The node of each occurrence: down the tree by its own skips, level by level for all occurrences."""
        long = np.flatnonzero(nodes < 0)
        for k in long.tolist():
            at = self.letter_start.held[words[k]]
            symbols, _ = self.segment_one(self.letters.held[at : at + self.letter_count.held[words[k]]], self._all_skips(int(keys[k])))
            ids, counts = self._spelled(np.array(symbols, np.int64), np.array([len(symbols)]))
            nodes[k] = self._add(words[k : k + 1], np.array([-1]), np.array([-1]), ids, counts, np.zeros(1, np.int64))[0]
        left = np.arange(len(nodes) if self.log_kept else 0)
        skip = self._gaps(keys, 0) if self.log_kept else left
        for depth in range(1, 1 << 30):
            on = skip < self.seen.held[nodes[left]]
            left, skip = left[on], skip[on]
            if not len(left):
                return nodes
            slots = self.first.held[nodes[left]] + skip
            lacking = np.flatnonzero(self.children.held[slots] < 0)
            if len(lacking):
                fresh, where = np.unique(slots[lacking], return_index=True)
                parents = nodes[left[lacking[where]]]
                path = np.empty((len(fresh), depth), np.int64)
                path[:, -1], above = skip[lacking[where]], parents
                for k in range(depth - 2, -1, -1):
                    path[:, k], above = self.skipped.held[above], self.parent.held[above]
                self.children.held[fresh] = self._grow(self.word.held[parents], parents, path)
            nodes[left] = self.children.held[slots]
            skip = skip + 1 + self._gaps(keys[left], depth)

    def encode(self, texts: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, ends)`` of texts without nulls; a text's ids end at its end. ``keys``: 64 bits for each text."""
        texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
        data, offsets = flat_bytes(texts)
        start = np.zeros(len(data) + 1, bool)
        start[1 : len(data)] = ~self.together[data[:-1], data[1:]]
        own = np.flatnonzero(data[:-2] == MARK_BYTES[0]) if len(data) > 2 else np.zeros(0, np.int64)
        own = own[(data[own + 1] == MARK_BYTES[1]) & (data[own + 2] == MARK_BYTES[2])]
        start[own] = start[own + 3] = True
        start[offsets[:-1]] = True
        at = np.flatnonzero(start[: len(data)])
        found = strings(data, np.append(at, len(data))).dictionary_encode()
        codes = found.indices.to_numpy(zero_copy_only=False)
        ends = np.searchsorted(at, offsets)
        place = np.arange(len(at)) - np.repeat(ends[:-1], np.diff(ends))
        key = _mixed((place.astype(np.uint64) + np.uint64(1)) * np.uint64(GOLDEN) + np.repeat(keys, np.diff(ends)))
        words, roots = self._roots(found.dictionary)
        nodes = self._drawn(words[codes], roots[codes], key)
        counts = self.count.held[nodes]
        ids = flattened(self.pool.held, self.start.held[nodes], counts)
        return ids, np.concatenate([[0], np.cumsum(counts)])[ends[1:]]

    def key(self, doc_id: object, text: str) -> int:
        """The key of one document."""
        return xxhash.xxh64_intdigest(f"{self.seed}:{doc_id}:".encode() + text.encode("utf-8", "surrogatepass"))


class Decoder:
    """Texts of piece ids: bytes of whole pieces, put together in arrays; what they can't tell goes to the library."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        parts = []
        for i in range(self.library.get_piece_size()):
            piece = self.library.id_to_piece(i)
            special = self.library.is_control(i) or self.library.is_unknown(i)
            parts.append(None if special else bytes([int(piece[3:5], 16)]) if self.library.is_byte(i) else piece.replace(MARK, " ").encode())
        self.special = np.array([p is None for p in parts] + [True])
        self.marked = np.array([bool(p) and p[:1] == b" " and not self.library.is_byte(i) for i, p in enumerate(parts)] + [False])
        self.counts = np.array([len(p or b"") for p in parts] + [0], np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.pool = np.frombuffer(b"".join(p or b"" for p in parts), np.uint8)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts whose ids end at ``ends``."""
        known = np.where((ids >= 0) & (ids < len(self.special) - 1), ids, len(self.special) - 1)
        counts = self.counts[known]
        data = flattened(self.pool, self.starts[known], counts).tobytes()
        cuts = np.concatenate([[0], np.cumsum(counts)])
        odd = np.concatenate([[0], np.cumsum(self.special[known])])
        out, begin = [], 0
        for end in ends.tolist():
            own = data[cuts[begin] : cuts[end]]
            try:
                if odd[end] > odd[begin]:
                    raise UnicodeError
                out.append(str(own[1:] if end > begin and self.marked[known[begin]] else own, "utf-8"))
            except UnicodeError:
                out.append(self.library.decode(ids[begin:end].tolist()))
            begin = end
        return out


def _encoded(batch: pa.RecordBatch, encoder: DropoutEncoder) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``start`` to ``stop`` of a batch (doc_id, text) with their ids and ends, GROUP_BYTES of text at a time."""
    texts = pc.fill_null(batch.column(1), "")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + GROUP_BYTES, "right")))
        own = texts.slice(start, stop - start)
        doc_ids = batch.column(0).slice(start, stop - start).to_pylist()
        keys = np.array([encoder.key(i, t) for i, t in zip(doc_ids, own.to_pylist(), strict=True)], np.uint64)
        yield start, stop, *encoder.encode(own, keys)
        start = stop


def _encoder(*key) -> DropoutEncoder:
    return worker_table(("dropout", *key), lambda: DropoutEncoder(*key))


def encode_dropout(docs: DataFrame, model_path: str, rate: float = 0.1, seed: int = 0) -> DataFrame:
    """``doc_id, ids``: whole texts, each occurrence of a word drawn by itself.

    The draws depend on seed, doc_id and text, so copies under other ids are segmented otherwise and repeated rows
    alike. Null and empty texts have no ids; very long texts and words without spaces are encoded whole. An empty
    table gives an empty result; other columns are not read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(model_path, rate, seed)
        for batch in batches:
            for start, stop, ids, ends in _encoded(batch, own):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), lists], names=["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text`` of rows with ``doc_id`` and ``ids``; null ids, and null among ids, give the text without them."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_table(("pieces", model_path), lambda: Decoder(model_path))
        for batch in batches:
            lists = batch.column(1)
            held = lists.flatten()
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            kept = held.is_valid().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(kept)])[np.cumsum(counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.decode(held.drop_null().to_numpy(), ends), pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(decode, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, model_path: str, rate: float = 0.1, seed: int = 0) -> DataFrame:
    """``doc_id, n_ids, ids_crc32, text_crc32``: :func:`encode_dropout` and decoding in one pass, without sending ids on.

    ``ids_crc32`` is of the ids as little-endian unsigned 32-bit integers, ``text_crc32`` of the decoded text.
    """

    def there_and_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = worker_table(("dropout and back", model_path, rate, seed), lambda: (DropoutEncoder(model_path, rate, seed), Decoder(model_path)))
        for batch in batches:
            for start, stop, ids, ends in _encoded(batch, encoder):
                bounds = np.concatenate([[0], ends])
                crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(bounds, bounds[1:])]
                texts = [zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in decoder.decode(ids.astype(np.int64), ends)]
                columns = [batch.column(0).slice(start, stop - start), pa.array(np.diff(bounds)), pa.array(crcs, pa.int64()), pa.array(texts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_ids", "ids_crc32", "text_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(there_and_back, f"doc_id {kind}, n_ids long, ids_crc32 long, text_crc32 long")


def op2_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, encoded with dropout and decoded again: ``doc_id, n_ids, ids_crc32, text_crc32``.

    ``text_crc32`` is that of the decoded text, so it equals the crc32 of the document's own UTF-8 bytes.
    """
    import public_tokenizers

    return round_trip(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
