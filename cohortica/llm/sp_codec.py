"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

The model file of a public tokenizer is read for its pieces and scores; nothing is trained. A text is cut into chunks at places no piece reaches across, and
each chunk is merged with an agenda: the pair of neighbours whose joint piece scores highest is merged first, leftmost on ties. When a
candidate is taken from the agenda it is skipped if a keyed hash of (seed, variant, place, pair) falls below the dropout rate; a skipped candidate comes
back only if a neighbour changes. The variant of a chunk is itself a 64-bit keyed hash of document and chunk number, so every occurrence of a word has dice
of its own, within and across documents, and runs agree.

What is remembered is independent of the dice: for words that occur repeatedly, a tree of decisions. Its nodes are states of the agenda, with the candidate on top
and a way on for either outcome; an occurrence walks the tree by its own dice. Ways are added where several occurrences go; the others are merged one by one.

Characters without a piece become byte pieces. Decoding joins the pieces' bytes; every segmentation decodes to the text exactly. The marker character
U+2581 itself is encoded through its bytes, so it is not mistaken for a blank.

Edges: null text gives null pieces; empty text gives no pieces; a text that starts or ends with blanks keeps them, for the marker that the model puts before a text
is put and taken away again; repeated rows with one doc_id and text get one segmentation; rows of any length are encoded whole.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NONE = float("-inf")
#: Longer chunks are merged one by one. Chunks that are worked on at once.
MANY, SLAB = 48, 500_000
#: Odd factors of the keyed hash, and of its finisher.
SEED, VARIANT, PLACE, LENGTH, PIECE = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3
M1, M2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def finished(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit integers (splitmix64's finisher)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(M1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(M2)
    return x ^ (x >> np.uint64(31))


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs, one after another."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, model: str | bytes = MODEL, dropout: float = 0.1, seed: int = 0, remembered: int = 80_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model) if isinstance(model, bytes) else sentencepiece.SentencePieceProcessor(model_file=model)
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:-1], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.ids[piece], self.scores[piece] = i, sp.get_score(i)
                self.bytes_of.append(piece.replace(MARK, " ").encode())
        # all ways to join two pieces into one, by a number for the pair; and the piece of each character (-1: none)
        joins = [(self.ids[p[:k]] * len(self.bytes_of) + self.ids[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        joins.sort()
        self.pair_keys = np.array([*(k for k, _ in joins), 2**62], np.int64)
        self.pair_ids = np.array([*(i for _, i in joins), 0], np.int64)
        self.pair_scores = np.array([*(sp.get_score(i) for _, i in joins), 0.0], np.float32)
        self.char_ids = np.full(0x110000, -1, np.int64)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char_ids[ord(p)] = i
        self.dropout, self.seed, self.remembered = dropout, seed, remembered
        self.below = int(dropout * 2**64)
        self._forget()
        # a text may be cut before a marker that follows another character, and around line ends, if no piece reaches across
        inner = any(MARK in p.lstrip(MARK) for p in self.ids)
        lines = any("\n" in p and len(p) > 1 for p in self.ids)
        self.cuts = re.compile((r"\n|" if not lines else "") + ((rf"{MARK}*[^{MARK}\n]+|{MARK}+" if not lines else rf"{MARK}*[^{MARK}]+|{MARK}+") if not inner else (r"[^\n]+" if not lines else r"[\s\S]+")))

    def merged(self, chunk: str, variant: int) -> tuple[int, ...]:
        """Piece ids of a chunk: the agenda."""
        scores, n = self.scores, len(chunk)
        part: list[str | None] = list(chunk)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[float, int, str]] = []

        def propose(i: int) -> None:
            j = right[i]
            if j < n and (s := scores.get(both := part[i] + part[j])) is not None:
                heapq.heappush(agenda, (-s, i, both))

        for i in range(n - 1):
            propose(i)
        while agenda:
            _, i, both = heapq.heappop(agenda)
            if part[i] is None or (j := right[i]) >= n or part[i] + part[j] != both:
                continue  # a neighbour has changed since
            if self.below and self._die(variant, i, len(part[i]), self.ids[both]) < self.below:
                continue
            part[i], part[j] = both, None
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            propose(i)
            if left[i] >= 0:
                propose(left[i])
        out: list[int] = []
        for p in part:
            if p is not None:
                k = self.ids.get(p)
                out += [k] if k is not None else [self.byte_ids[b] for b in p.encode()]
        return tuple(out)

    def _drawn(self, turned, place, length, piece) -> np.ndarray:
        """Keyed hashes of candidates: _turned() of the variants, place and length of the left part, piece it would give. _die() is the same for one candidate."""
        return finished(turned + np.asarray(place, np.uint64) * np.uint64(PLACE) + np.asarray(length, np.uint64) * np.uint64(LENGTH) + np.asarray(piece, np.uint64) * np.uint64(PIECE))

    def _turned(self, variant) -> np.ndarray:
        return np.asarray(variant).astype(np.uint64) * np.uint64(VARIANT) + np.uint64(self.seed * SEED % 2**64)

    def _die(self, variant: int, place: int, length: int, piece: int) -> int:
        x = (self.seed * SEED + variant * VARIANT + place * PLACE + length * LENGTH + piece * PIECE) % 2**64
        x = (x ^ (x >> 30)) * M1 % 2**64
        x = (x ^ (x >> 27)) * M2 % 2**64
        return x ^ (x >> 31)

    def merged_many(self, chunks: list[str], variants: np.ndarray) -> list[tuple[int, ...]]:
        """merged() of many chunks at once: each round takes the head of every chunk's agenda. Chunks of one length are worked on together."""
        out: list = [None] * len(chunks)
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        for length in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == length)
            if length > MANY:
                for r in rows.tolist():
                    out[r] = self.merged(chunks[r], int(variants[r]))
                continue
            for at in range(0, len(rows), 20_000):
                self._together(chunks, variants, rows[at : at + 20_000], length, out)
        return out

    def _pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score (minus infinity: none) and id of the joint piece of neighbours."""
        key = a * len(self.bytes_of) + b
        at = np.searchsorted(self.pair_keys, key)
        there = self.pair_keys[at] == key
        return np.where(there, self.pair_scores[at], np.float32(NONE)), self.pair_ids[at]

    def _together(self, chunks, variants, rows, length, out) -> None:
        points = np.array([chunks[r] for r in rows.tolist()], dtype=f"U{length}").view(np.uint32).reshape(len(rows), length)
        part = self.char_ids[points]
        odd = (part < 0).any(axis=1) | (points == 0).any(axis=1)
        for r in rows[odd].tolist():
            out[r] = self.merged(chunks[r], int(variants[r]))
        rows, part = rows[~odd], part[~odd]
        n = len(rows)
        # a part stands at its first place; the column after the last place lies beyond either end and joins with nothing
        part = np.concatenate([part, np.full((n, 1), len(self.bytes_of) ** 2)], axis=1)
        score, joint = np.full((n, length + 1), NONE, np.float32), np.zeros((n, length + 1), np.int64)
        score[:, :-1], joint[:, :-1] = self._pair(part[:, :-1], part[:, 1:])
        right = np.broadcast_to(np.arange(1, length + 2), (n, length + 1)).copy()
        left = right - 2
        turned = self._turned(variants[rows])
        live = np.arange(n)
        while len(live):
            now = score[live]
            best = now.argmax(axis=1)
            going = now[np.arange(len(live)), best] > NONE
            live, best = live[going], best[going]
            piece, after = joint[live, best], right[live, best]
            if self.below:
                skip = self._drawn(turned[live], best, after - best, piece) < np.uint64(self.below)
                score[live[skip], best[skip]] = NONE
                r, b, j, piece = live[~skip], best[~skip], after[~skip], piece[~skip]
            else:
                r, b, j = live, best, after
            k, h = right[r, j], left[r, b]
            part[r, b], part[r, j], score[r, j] = piece, -1, NONE
            right[r, b], left[r, k] = k, b
            score[r, b], joint[r, b] = self._pair(piece, part[r, k])
            score[r, h], joint[r, h] = self._pair(part[r, h], piece)
        whole = part[:, :-1]
        ids = whole[whole >= 0].tolist()
        ends = np.cumsum((whole >= 0).sum(axis=1)).tolist()
        for r, x, y in zip(rows.tolist(), [0, *ends], ends, strict=False):
            out[r] = tuple(ids[x:y])

    def _forget(self) -> None:
        """An empty memory: roots by word; of each node the candidate's share of the hash, the ways on (-1: none yet) and, at the end of a way, its pieces."""
        n = self.remembered
        self.roots: dict[str, int] = {}
        self.states: list[tuple | None] = []
        self.mix, self.ways = np.zeros(n + 1, np.uint64), np.full((n + 1, 2), -1, np.int32)
        self.first, self.count = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        self.pool: list[int] = []
        # the empty chunk stands for a literal marker character
        self.roots[""] = self._end([self.byte_ids[b] for b in MARK.encode()])

    def _end(self, ids: list[int]) -> int:
        k = len(self.states)
        self.states.append(None)
        self.first[k], self.count[k] = len(self.pool), len(ids)
        self.pool += ids
        return k

    def _node(self, parts: tuple[str, ...], scores: tuple[float, ...]) -> int:
        """A new node: parts of a word and scores of their neighbourships (minus infinity: no joint piece, or skipped)."""
        best = max(scores, default=NONE)
        if best == NONE:
            ids: list[int] = []
            for p in parts:
                k = self.ids.get(p)
                ids += [k] if k is not None else [self.byte_ids[b] for b in p.encode()]
            return self._end(ids)
        at, k = scores.index(best), len(self.states)
        self.states.append((parts, scores, at))
        self.mix[k] = (sum(map(len, parts[:at])) * PLACE + len(parts[at]) * LENGTH + self.ids[parts[at] + parts[at + 1]] * PIECE) % 2**64
        return k

    def _root(self, chunk: str) -> int:
        return self._node(tuple(chunk), tuple(self.scores.get(a + b, NONE) for a, b in zip(chunk, chunk[1:], strict=False)))

    def _way(self, node: int, skipped: int) -> int:
        """The node after a decision, made now."""
        parts, scores, at = self.states[node]
        if skipped:
            k = self._node(parts, (*scores[:at], NONE, *scores[at + 1 :]))
        else:
            both = parts[at] + parts[at + 1]
            parts = (*parts[:at], both, *parts[at + 2 :])
            before = (*scores[: at - 1], self.scores.get(parts[at - 1] + both, NONE)) if at else ()
            after = (self.scores.get(both + parts[at + 1], NONE), *scores[at + 2 :]) if at + 1 < len(parts) else ()
            k = self._node(parts, before + after)
        self.ways[node, skipped] = k
        if (self.ways[node] >= 0).all():
            self.states[node] = None
        return k

    def _walked(self, chunks: list[str], turns: np.ndarray, least: int = 3) -> np.ndarray:
        """The last node of each chunk's way by its own dice; -1 where the memory has no such way. Ways that at least so many chunks ask for are added."""
        at = np.fromiter(map(self.roots.get, chunks, itertools.repeat(-1)), np.int64, len(chunks))
        unknown = np.flatnonzero(at < 0).tolist()
        for c, n in Counter(map(chunks.__getitem__, unknown)).items():
            if n >= least and len(c) <= MANY and len(self.states) < self.remembered:
                self.roots[c] = self._root(c)
        at[unknown] = np.fromiter((self.roots.get(chunks[k], -1) for k in unknown), np.int64, len(unknown))
        turned = self._turned(turns)
        live = np.flatnonzero(at >= 0)
        live = live[self.count[at[live]] == 0]
        while len(live):
            node = at[live]
            skipped = (finished(turned[live] + self.mix[node]) < np.uint64(self.below)).astype(np.int64) if self.below else np.zeros(len(live), np.int64)
            to = self.ways[node, skipped].astype(np.int64)
            lacking = np.flatnonzero(to < 0)
            if len(lacking):
                asked, inverse, n = np.unique(node[lacking] * 2 + skipped[lacking], return_inverse=True, return_counts=True)
                made = [self._way(a >> 1, a & 1) if k >= least and len(self.states) < self.remembered else -1 for a, k in zip(asked.tolist(), n.tolist(), strict=True)]
                to[lacking] = np.array(made, np.int64)[inverse]
            at[live] = to
            live = live[(to >= 0) & (self.count[to] == 0)]
        return at

    def _pieces(self, chunks: list[str], turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of chunks, one after another, and their numbers."""
        at = self._walked(chunks, turns)
        rest = np.flatnonzero(at < 0)
        met = np.flatnonzero(at >= 0)
        merged = self.merged_many([chunks[k] for k in rest.tolist()], turns[rest])
        sizes = np.zeros(len(at), np.int64)
        sizes[met] = self.count[at[met]]
        sizes[rest] = np.fromiter(map(len, merged), np.int64, len(merged))
        starts = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), np.int32)
        out[spans(starts[met], sizes[met])] = np.array(self.pool, np.int32)[spans(self.first[at[met]], sizes[met])]
        out[spans(starts[rest], sizes[rest])] = np.fromiter(itertools.chain.from_iterable(merged), np.int32)
        if len(self.states) >= self.remembered and 2 * len(rest) > len(at):
            self._forget()  # full and of little use: it begins anew with the next chunks
        return out, sizes

    def _cut(self, text: str, key: object) -> tuple[list, list]:
        """Chunks of a text and their variants, 64 bits each; an empty chunk stands for the marker character itself."""
        chunks: list[str] = []
        turns: list[np.ndarray] = []
        for k, bare in enumerate(text.split(MARK)):
            if k:
                chunks.append(""), turns.append(np.zeros(1, np.uint64))
            # the model puts a marker before a text; after a literal marker there is none to put
            found = self.cuts.findall((MARK if not k else "") + bare.replace(" ", MARK))
            first = np.uint64(xxhash.xxh3_64_intdigest(f"{key}:{k}", self.seed))
            # a keyed hash of document and place
            turns.append(finished((np.arange(len(found), dtype=np.uint64) + first) * np.uint64(0x9E3779B97F4A7C15)))
            chunks += found
        return chunks, turns

    def encode_many(self, texts: list[str | None], keys) -> list[np.ndarray | None]:
        """Piece ids (int32) of texts; keys tell apart documents with equal text."""
        chunks, turns, ends = [], [np.zeros(0, np.uint64)], [0]
        for t, k in zip(texts, keys, strict=False):
            if t:
                found, own = self._cut(t, k)
                chunks += found
                turns += own
            ends.append(len(chunks))
        turned = np.concatenate(turns)
        done = [self._pieces(chunks[a : a + SLAB], turned[a : a + SLAB]) for a in range(0, len(chunks), SLAB)]
        ids = np.concatenate([np.zeros(0, np.int32), *(x for x, _ in done)])
        bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *(n for _, n in done)]))])[ends].tolist()
        return [None if t is None else ids[a:b] for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True)]

    def encode(self, text: str, key: object = 0) -> np.ndarray:
        return self.encode_many([text], [key])[0]

    def decode(self, ids) -> str:
        """The text of piece ids: bytes joined, less the marker before the text."""
        if not len(ids):
            return ""
        found = b"".join(map(self.bytes_of.__getitem__, ids.tolist() if hasattr(ids, "tolist") else ids))
        return (found[1:] if found[:1] == b" " else found).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def shared_codec(proto: bytes, dropout: float, seed: int) -> Codec:
    """One codec per worker process: what it remembers serves all its tasks."""
    return Codec(proto, dropout, seed)


def by_size(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many bytes of text, or of one row: what is held at once does not grow with the texts of a batch."""
    lengths = [x or 0 for x in pc.binary_length(batch.column("text")).to_pylist()]
    start = held = 0
    for k, n in enumerate(lengths):
        if k > start and held + n > most:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    if len(lengths) > start:
        yield batch.slice(start)


def _model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model: str = MODEL, dropout: float = 0.1, seed: int = 0, digests_only: bool = False) -> DataFrame:
    """The input's columns with text replaced by pieces (array of int), n_pieces and lossless (whether decoding gives the text back).

    Without a doc_id the text itself is what tells documents apart.
    digests_only: pieces_xxh (xxh3 of the int32 ids) in place of pieces. The model (half a megabyte) goes with the task.
    """
    proto = _model_bytes(model)
    others = [c for c in docs.columns if c not in ("text", "pieces", "pieces_xxh", "n_pieces", "lossless")]
    named = "doc_id" if "doc_id" in docs.columns else None

    def work(batches):
        codec = shared_codec(proto, dropout, seed)
        for whole in batches:
            for b in by_size(whole):
                texts = b.column("text").to_pylist()
                pieces = codec.encode_many(texts, b.column(named).to_pylist() if named else map(xxhash.xxh3_64_intdigest, (t or "" for t in texts)))
                n = [0 if x is None else len(x) for x in pieces]
                right = [None if x is None else codec.decode(x) == t for x, t in zip(pieces, texts, strict=True)]
                digests = [None if x is None else xxhash.xxh3_64_hexdigest(x.tobytes()) for x in pieces] if digests_only else []
                shown = pa.array(digests, pa.string()) if digests_only else pa.array(pieces, pa.list_(pa.int32()))
                arrays = [b.column(c) for c in others] + [shown, pa.array(n, pa.int64()), pa.array(right, pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*others, "pieces_xxh" if digests_only else "pieces", "n_pieces", "lossless"])

    own = StructField("pieces_xxh", StringType()) if digests_only else StructField("pieces", ArrayType(IntegerType()))
    schema = StructType([docs.schema[c] for c in others] + [own, StructField("n_pieces", LongType()), StructField("lossless", BooleanType())])
    return docs.select(*others, "text").mapInArrow(work, schema)


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """The input's columns with pieces replaced by text."""
    proto = _model_bytes(model)
    others = [c for c in encoded.columns if c not in ("text", "pieces")]

    def work(batches):
        codec = shared_codec(proto, 0.0, 0)
        for b in batches:
            texts = [None if x is None else codec.decode(x) for x in b.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in others] + [pa.array(texts, pa.string())], names=[*others, "text"])

    schema = StructType([encoded.schema[c] for c in others] + [StructField("text", StringType())])
    return encoded.select(*others, "pieces").mapInArrow(work, schema)
