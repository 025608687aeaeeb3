"""Substring dedup by repeated-phrase automata: every word that lies in a window of 35 words which also starts elsewhere is removed.

1. Each window is represented by its anchor: of the short phrases (6 words) in it, the one with the smallest hash. Equal windows have equal anchors, and
   neighbouring windows mostly share theirs, so a text has one anchor in about fifteen words. Anchors are counted over the corpus.
2. Recurring anchors are the phrases to look for. Documents are dealt into shards of bounded size by hash; a shard gets the phrases that some document of it
   may hold, takes their words from its own documents, and compiles them to an Aho-Corasick automaton (words as symbols, told apart by 64 bits of hash). All documents of the shard are streamed
   through it, which finds every occurrence of every phrase.
3. Windows anchored at an occurrence are counted over the corpus by 64 + 31 bits of hash (both made of 64-bit hashes of the words). Windows that are alone go back to their shard (a window
   seen once is held by one document, so nothing hot is ever joined); all other windows anchored at an occurrence recur, and the words they cover are removed.

All counts combine before the shuffle. The texts are shuffled once: both times that documents meet shard data the same exchange is read. Windows are judged
on the input, not on what is left.

Edges: null text stays null with 0 words; texts under 35 words lose nothing; equal rows are separate documents (all their windows recur); a
window that repeats within one document recurs; an empty table gives an empty result. Columns of the input are kept (of n_words, n_removed the new ones).
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from cohortica.llm.common import cut, parts

U = np.uint64
GOLD, M1, M2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
DIGITS = 48


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * M1
    x = (x ^ (x >> U(27))) * M2
    return x ^ (x >> U(31))


#: Which bytes part words; a random number for each byte.
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
with np.errstate(over="ignore"):
    BYTES = _mixed(np.arange(1, 257, dtype=U) * GOLD)


class Powers:
    """Powers of an odd number and of its inverse, modulo 2**64; grows as longer texts come."""

    def __init__(self, base: int):
        self.bases = (base, pow(base, -1, 2**64))
        self.tables = [np.ones(1, U), np.ones(1, U)]

    def __call__(self, n: int, inverse: bool = False) -> np.ndarray:
        if len(self.tables[inverse]) < n:
            with np.errstate(over="ignore"):
                grown = np.full(max(n, 4096) * 2, U(self.bases[inverse]))
                grown[0] = 1
                self.tables[inverse] = np.cumprod(grown, dtype=U)
        return self.tables[inverse][:n]

    def windows(self, h: np.ndarray, width: int) -> np.ndarray:
        """Polynomial hash of every `width` neighbours, by differences of prefix sums."""
        total = np.concatenate([np.zeros(1, U), np.cumsum(h * self(len(h)), dtype=U)])
        return _mixed((total[width:] - total[:-width]) * self(len(h) - width + 1, True))


LETTERS, PHRASES, FIRST, SECOND = Powers(0x9E3779B97F4A7C15), Powers(0xBF58476D1CE4E5B9), Powers(0x94D049BB133111EB), Powers(0xD6E8FEB86659FD93)


def hashed(text: bytes) -> np.ndarray:
    """64-bit hash of each word of a text."""
    b = np.frombuffer(text, np.uint8)
    inside = ~BLANK[b]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(b) and inside[0]:
        edge = np.concatenate([[0], edge])
    starts = edge[::2]
    if not len(starts):
        return np.zeros(0, U)
    ends = np.append(edge[1::2], len(b))[: len(starts)]
    sizes = ends - starts
    # bytes of words only, each with its place in the word
    letters = BYTES[b[inside]]
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    place = np.arange(len(letters)) - np.repeat(first, sizes)
    return _mixed(np.add.reduceat(letters * LETTERS(int(sizes.max()))[place], first) + sizes.astype(U) * GOLD)


def slide(x: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """Least (or greatest) of every `width` neighbours, by doubling."""
    m, step = x, 1
    while step * 2 <= width:
        m = pick(m[:-step], m[step:])
        step *= 2
    return pick(m[: len(m) - (width - step)], m[width - step :]) if step < width else m


def anchors(h: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all phrases, and each window's anchor: the smallest of its phrases' hashes."""
    x = PHRASES.windows(h, phrase)
    return x, slide(x, window - phrase + 1)


def anchor_values(h: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchors of a text, and at how many places each is an anchor."""
    x, least = anchors(h, window, phrase)
    wide = window - phrase + 1
    around = np.concatenate([np.zeros(wide - 1, U), least, np.zeros(wide - 1, U)])
    # a phrase is an anchor if the greatest of the minima of the windows around it is its own
    return np.unique(x[slide(around, wide, np.maximum) == x].view(np.int64), return_counts=True)


class Shard:
    """Documents of a shard, and the automata of its phrases."""

    def __init__(self, docs: dict[int, np.ndarray], wanted: dict[int, set[int]], window: int, phrase: int, at_once: int = 18_000):
        self.window, self.phrase = window, phrase
        rows = []
        for rid, keys in wanted.items():
            h = docs[rid]
            x = PHRASES.windows(h, phrase)
            at = np.flatnonzero(np.isin(x, np.fromiter(keys, np.int64, len(keys)).view(U)))
            if len(at):
                rows.append(h[at[:, None] + np.arange(phrase)[None, :]])
        phrases = np.unique(np.concatenate(rows), axis=0) if rows else np.zeros((0, phrase), U)
        self.automata = []
        # so many phrases at once have fewer distinct words than DIGITS ** 3
        for k in range(0, len(phrases), at_once):
            part = phrases[k : k + at_once]
            words, symbol = np.unique(part, return_inverse=True)
            automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for p in _text(symbol.reshape(part.shape)).split("\n"):
                automaton.add_word(p)
            automaton.make_automaton()
            self.automata.append((words, automaton))

    def candidates(self, h: np.ndarray) -> np.ndarray:
        """Starts of the windows whose anchor is an occurrence of a phrase."""
        none = np.zeros(0, np.int64)
        if len(h) < self.window:
            return none
        found: list[int] = []
        for words, automaton in self.automata:
            at = np.minimum(np.searchsorted(words, h), len(words) - 1)
            known = words[at] == h
            # an occurrence needs as many known words in a row; only such runs are streamed, a word that is not known between them
            runs = np.flatnonzero(slide(known.astype(np.uint8), self.phrase))
            if len(runs):
                near = covered(len(h) + 2, runs, self.phrase + 2)[1:-1]
                place = np.flatnonzero(near)
                ends = [end for end, _ in automaton.iter(_text(np.where(known, at, -1)[place][None, :]))]
                found += place[np.array(ends, np.int64) // 3].tolist()
        if not found:
            return none
        x, least = anchors(h, self.window, self.phrase)
        here = np.full(len(x), ~U(0))
        at = np.array(found) - (self.phrase - 1)
        here[at] = x[at]
        return np.flatnonzero(slide(here, self.window - self.phrase + 1) == least)


def _text(numbers: np.ndarray) -> str:
    """Rows of word numbers as lines of text, three digits a word; each digit has its own letters, so words start where they are meant to. -1: no word.

    An automaton looks through the letters that follow a node one by one, hence digits and not a letter for each word.
    """
    digits = np.stack([numbers // DIGITS**2, numbers // DIGITS % DIGITS + DIGITS, numbers % DIGITS + 2 * DIGITS], axis=-1) + 32
    digits[numbers < 0] = 11
    lines = digits.reshape(len(numbers), -1).astype(np.uint8)
    return np.concatenate([lines, np.full((len(lines), 1), 10, np.uint8)], axis=1).tobytes()[:-1].decode("latin-1")


def window_hashes(h: np.ndarray, window: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits for the windows that start at the given places."""
    return FIRST.windows(h, window)[at].view(np.int64), (SECOND.windows(_mixed(h ^ M2), window)[at] >> U(33)).astype(np.int32)


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie in the windows."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return np.cumsum(change[:-1]) > 0


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _shard(left: pa.Table, right: pa.Table, window: int, phrase: int) -> tuple[list[int], list[bytes], list[np.ndarray], Shard]:
    """Ids, texts and word hashes of a shard's documents, and its automata."""
    rids = left.column("rid").to_pylist()
    texts = [_bytes(t) for t in left.column("text").to_pylist()]
    hashes = [hashed(t) for t in texts]
    wanted: dict[int, set[int]] = {}
    for rid, key, pos in zip(*(right.column(c).to_pylist() for c in ("rid", "anchor", "pos")), strict=True):
        if pos < 0:
            wanted.setdefault(rid, set()).add(key)
    return rids, texts, hashes, Shard(dict(zip(rids, hashes, strict=True)), wanted, window, phrase)


def anchor_counts(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """anchor, shard, rid, n for each document and anchor of it."""

    def work(batches):
        with np.errstate(over="ignore"):
            for b in batches:
                out: list[tuple] = []
                for rid, shard, text in zip(*(b.column(c).to_pylist() for c in ("rid", "shard", "text")), strict=True):
                    h = hashed(_bytes(text))
                    if len(h) >= window:
                        out.append((*anchor_values(h, window, phrase), rid, shard))
                if out:
                    sizes = [len(u) for u, _, _, _ in out]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([u for u, _, _, _ in out])), pa.array(np.repeat(np.array([s for *_, s in out], np.int32), sizes)), pa.array(np.repeat(np.array([r for _, _, r, _ in out], np.int64), sizes)), pa.array(np.concatenate([n for _, n, _, _ in out]).astype(np.int32))],
                        names=["anchor", "shard", "rid", "n"],
                    )

    return docs.select("rid", "shard", "text").mapInArrow(work, "anchor long, shard int, rid long, n int")


def dedup_substrings(docs: DataFrame, window: int = 35, phrase: int = 6, shard_bytes: int = 8 << 20, digests_only: bool = False) -> DataFrame:
    """Documents with what recurs taken out (words joined by one blank where something was removed), n_words, n_removed.

    digests_only: doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by one blank) alone.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = parts(docs.sparkSession, total, shard_bytes)
    kept = ["doc_id"] if digests_only else [c for c in docs.columns if c not in ("text", "n_words", "n_removed")]
    rid = F.xxhash64("doc_id", "text")
    # the input's columns travel under numbers, so no name of theirs can clash
    numbered = [f"kept{k}" for k in range(len(kept))]
    d = docs.select(*[F.col(c).alias(n) for c, n in zip(kept, numbered, strict=True)], "text", rid.alias("rid"), F.pmod(rid, F.lit(shards)).cast("int").alias("shard"))
    counted = anchor_counts(d, window, phrase).groupBy("anchor", "shard").agg(F.sum("n").alias("n"), F.min("rid").alias("rid"))
    # one row per shard at most in a group of this window
    counted = counted.withColumn("total", F.sum("n").over(Window.partitionBy("anchor"))).where("total > 1")
    phrases = cut(counted.select("shard", "anchor", "rid", F.lit(-1).alias("pos")), "phrases")

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"):
            rids, _, hashes, shard = _shard(left, right, window, phrase)
            out = []
            for r, h in zip(rids, hashes, strict=True):
                at = shard.candidates(h)
                if len(at):
                    a, b = window_hashes(h, window, at)
                    out.append((a, b, np.full(len(at), r, np.int64), at.astype(np.int32)))
            columns = [np.concatenate([x[k] for x in out]) if out else np.zeros(0, t) for k, t in enumerate((np.int64, np.int32, np.int64, np.int32))]
            return pa.table(dict(zip(("a", "b", "rid", "pos"), map(pa.array, columns), strict=True)))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"):
            rids, originals, hashes, shard = _shard(left, right, window, phrase)
            alone: dict[int, list[int]] = {}
            for r, pos in zip(right.column("rid").to_pylist(), right.column("pos").to_pylist(), strict=True):
                if pos >= 0:
                    alone.setdefault(r, []).append(pos)
            n_words, n_removed, texts = [], [], []
            for k, (r, h) in enumerate(zip(rids, hashes, strict=True)):
                words, at = originals[k].split(), shard.candidates(h)
                if r in alone:
                    at = np.setdiff1d(at, np.array(alone[r]), assume_unique=False)
                gone = covered(len(words), at, window) if len(at) else None
                left_over = words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                n_words.append(len(words)), n_removed.append(len(words) - len(left_over))
                if digests_only:
                    texts.append(hashlib.sha256(b" ".join(left_over)).hexdigest())
                else:
                    texts.append(left.column("text")[k].as_py() if gone is None else b" ".join(left_over).decode("utf-8", "surrogatepass"))
            numbers = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
            return pa.table([*[left.column(c) for c in numbered], pa.array(texts, pa.string()), *numbers], names=[*kept, "kept_sha256" if digests_only else "text", "n_words", "n_removed"])

    windows = d.groupBy("shard").cogroup(phrases.groupBy("shard")).applyInArrow(look, "a long, b int, rid long, pos int")
    single = windows.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("rid").alias("rid"), F.min("pos").alias("pos")).where("n = 1")
    single = single.select(F.pmod("rid", F.lit(shards)).cast("int").alias("shard"), F.lit(0).cast("long").alias("anchor"), "rid", "pos")
    told = phrases.unionByName(single)
    schema = StructType([docs.schema[c] for c in kept] + [StructField("kept_sha256" if digests_only else "text", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType())])
    return d.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(finish, schema)
