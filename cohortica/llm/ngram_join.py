"""N-gram Jaccard join: exact, size-aware, light sets by subsets and heavy sets by inverted lists (after Deng, Tao and Li, 2018).

A document's set holds its distinct word shingles as 64-bit hashes. Equal sets become one set, so exact copies cost nothing further. Two sets can only link
(intersection >= J * union) if they agree in most elements, and this gives keys of which linked sets share one:

* light sets (size up to a boundary) enumerate their subsets of fixed size: all ways to leave out as many elements as a partner may lack;
* heavy sets are put into inverted lists of single shingles, rarest first: of the n shingles of a set, in one order for all sets, a partner must hold one
  of the first n - ceil(J * n) + 1, so only these lists are kept and scanned. The order is by frequency in the corpus, so what a third of all documents
  share comes last and fills no list. Frequencies of shingles and of their words are counted over all documents into sketches of fixed size: in a large corpus every counter of
  shingles is full, but shingles of rare words are still told apart. Any order gives right results.

The boundary is chosen by cost: rows that enumeration gives against rows of the lists and what is met in scanning them, from list lengths measured in the sketch.

Lists are scanned in order of key. A list of up to `short` sets gives its pairs that agree in size; longer ones only give their members, so that rows stay in proportion. A key that the
sketch counts often is cut into pieces by hash, so no list is one task. Pairs are tested with a bitmap of parities of each set (differing bits never outnumber differing shingles, so no link
is lost). The members of a long list are dealt out by size with their bitmaps and tested there, so sets that only share a frequent shingle are not tied. What is left forms clusters; each
cluster's sets come together once, and inside a cluster overlaps are counted by scanning shingle lists, with exact intersection sizes. Large clusters are dealt out by size,
and as pairs of bounded chunks. Pairs that are already connected are not counted again, for only components are asked for.

Edges: null text and text without words: empty set, linked with nothing, a component of its own; fewer words than a shingle has: the whole sequence is the one
shingle; rows with a null doc_id link like others, and a component's id is its smallest doc_id that is not null (null if there is none); repeated rows (equal
doc_id) are documents of one component; extra columns are ignored; an empty table gives an empty result.
Sets are told apart by 64 bits, checked by 64 more: if two sets ever collide, the pass runs again with the next seed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortica.llm.common import components, cut, smallest_reachable

U = np.uint64
#: Counters of the sketches of frequencies, of shingles and of words, as powers of two.
BITS, WORD_BITS = 22, 20
#: Bits of a bitmap of keys, as a power of two.
MARKS = 25
GOLD, M1, M2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit integers (splitmix64's finisher)."""
    x = (x ^ (x >> U(30))) * M1
    x = (x ^ (x >> U(27))) * M2
    return x ^ (x >> U(31))


def in_order(text: str, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a text, A-Z in lower case, and of its word shingles, as they come."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    h = xxhash.xxh3_64_intdigest
    w = np.fromiter(map(h, words), U, len(words)) + U(seed % 2**63)
    if len(w) < width:
        return w, np.array([h(b" ".join(words), seed + 1)][: len(w)], U)
    x = np.zeros(len(w) - width + 1, U)
    for k in range(width):
        x = mixed(x * GOLD + w[k : len(w) - width + 1 + k])
    return w, x


def shingles(text: str, width: int, seed: int = 0) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    return np.unique(in_order(text, width, seed)[1])


def weighed(text: str, width: int, seed: int, order: Order) -> tuple[np.ndarray, np.ndarray]:
    """shingles(), and of each the sum of its words' levels."""
    w, x = in_order(text, width, seed)
    x, at = np.unique(x, return_index=True)
    level = order.words[(w & U(2**WORD_BITS - 1)).astype(np.int64)].astype(np.int32)
    return x, sum((level[at + k] for k in range(width)), np.zeros(len(x), np.int32)) if len(w) >= width else np.zeros(len(x), np.int32)


class Order:
    """One order of all shingles, by how many documents hold them and by how frequent their words are: sketches of 2 ** BITS and 2 ** WORD_BITS counters, each kept as a sixth of a power of two, in a byte."""

    def __init__(self, level: np.ndarray, usual: float, words: np.ndarray | None = None):
        #: Levels of the counters, and the counters' mean; levels of the words' counters.
        self.level, self.usual, self.words = level, usual, np.zeros(2**WORD_BITS, np.uint8) if words is None else words
        #: Keys counted more often than this are cut into pieces of about this many rows.
        self.often = max(20_000.0, 8 * usual)

    @staticmethod
    def levels(counts: np.ndarray) -> np.ndarray:
        return np.round(np.log2(1 + counts) * 6).astype(np.uint8)

    def counts(self, x: np.ndarray) -> np.ndarray:
        """Documents that hold each shingle: never fewer than there are, but for rounding."""
        return np.exp2(self.level[(x & U(2**BITS - 1)).astype(np.int64)] / 6) - 1

    def first(self, x: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
        """The n rarest shingles of a set, ties by hash. weight: sums of the words' levels; they count a twelfth of the shingles' own."""
        level = self.level[(x & U(2**BITS - 1)).astype(np.int64)].astype(np.int32) * 12
        if weight is not None:
            level += weight
        if n < len(x):
            least = np.partition(level, n - 1)[n - 1]
            x, level = x[level <= least], level[level <= least]
        return x[np.lexsort((x, level))[:n]]


def n_lists(size: int, jaccard: float) -> int:
    """In how many lists a set of a size has to be: a partner lacks floor((1 - J) * size) of its elements at most."""
    return size - math.ceil(jaccard * size - 1e-9) + 1


def lists_of(x: np.ndarray, jaccard: float, order: Order, weight: np.ndarray | None = None) -> np.ndarray:
    """Keys of the inverted lists of a heavy set."""
    return order.first(x, n_lists(len(x), jaccard), weight)


def parities(x: np.ndarray) -> np.ndarray:
    """Bits, 64 to a number, each the parity of the number of shingles that fall on it: a power of two, at least 1,024 and twice as many as there are shingles."""
    n = max(1024, 1 << (2 * len(x) - 1).bit_length())
    return np.packbits(np.bincount((mixed(x ^ M2) & U(n - 1)).astype(np.int64), minlength=n).astype(np.uint8) & 1).view(np.int64)


def subsets_of(x: np.ndarray, jaccard: float) -> np.ndarray:
    """Keys of all subsets of a light set that may be its intersection with a partner: up to (1 - J) of the elements left out."""
    marks = mixed(x * GOLD)
    total, n = marks.sum(dtype=U), len(x)
    keys, sums = [total + U(n) * M2], [(total, 0)]
    for gone in range(1, n - math.ceil(jaccard * n - 1e-9) + 1):
        sums = [(s - marks[k], k + 1) for s, at in sums for k in range(at, n)]
        keys += [s + U(n - gone) * M2 for s, _ in sums]
    return mixed(np.array(keys, U) ^ M1)


def n_subsets(size: int, jaccard: float) -> int:
    return sum(math.comb(size, k) for k in range(size - math.ceil(jaccard * size - 1e-9) + 1))


def boundary(sets: dict[int, int], scanned: dict[int, float], jaccard: float) -> int:
    """The size up to which sets enumerate subsets: least cost overall. sets: how many there are by size (30 at most); scanned: what their lists hold in sum."""
    best, cost, least = 1, 0.0, 0.0
    for s in range(2, 31):
        cost += sets.get(s, 0) * (n_subsets(s, jaccard) - n_lists(s, jaccard)) - scanned.get(s, 0.0)
        if cost <= least:
            best, least = s, cost
    return best


def keys_of(x: np.ndarray, jaccard: float, light: int, order: Order, weight: np.ndarray | None = None) -> np.ndarray:
    n = len(x)
    if n > light:
        return lists_of(x, jaccard, order, weight)
    # a light set near the boundary may have heavy partners
    return np.concatenate([subsets_of(x, jaccard), lists_of(x, jaccard, order, weight)]) if n >= jaccard * (light + 1) - 1e-9 else subsets_of(x, jaccard)


def counted_order(docs: DataFrame, width: int, seed: int) -> Order:
    """The order of the shingles of all documents. A task gives its sketches, in slices; slices are added up one by one, and 2 ** BITS + 2 ** WORD_BITS bytes come to the driver at any size of the corpus."""
    slices = 80

    def count(batches):
        total = np.zeros(2**BITS + 2**WORD_BITS, np.uint32)
        for b in batches:
            for text in b.column("text").to_pylist():
                with np.errstate(over="ignore"):
                    w, x = in_order(text, width, seed)
                    # shingles are distinct, but some share a counter
                    np.add.at(total, (np.unique(x) & U(2**BITS - 1)).astype(np.int64), 1)
                    np.add.at(total, (w & U(2**WORD_BITS - 1)).astype(np.int64) + 2**BITS, 1)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([x.tobytes() for x in np.array_split(total, slices)], pa.binary())], names=["slice", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column("slice").to_pylist(), b.column("counts").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(x, np.uint32).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([Order.levels(x).tobytes() for x in sums.values()], pa.binary()), pa.array([int(x.sum()) for x in sums.values()], pa.int64())], names=["slice", "levels", "total"])

    dealt = docs.where("text is not null").select("text").mapInArrow(count, "slice int, counts binary").repartition("slice")
    rows = sorted(dealt.mapInArrow(add, "slice int, levels binary, total long").collect(), key=lambda r: r.slice)
    level = np.concatenate([np.frombuffer(r.levels, np.uint8) for r in rows]) if rows else np.zeros(2**BITS + 2**WORD_BITS, np.uint8)
    return Order(level[: 2**BITS], sum(r.total for r in rows if r.slice < slices * 2**BITS // (2**BITS + 2**WORD_BITS)) / 2**BITS, level[2**BITS :])


def chosen_boundary(docs: DataFrame, jaccard: float, width: int, seed: int, order: Order) -> int:
    """boundary() with the sizes and list lengths of all short texts (at most 30 rows come back)."""

    def measure(batches):
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                with np.errstate(over="ignore"):
                    x, weight = weighed(text, width, seed, order)
                if 0 < len(x) <= 30:
                    rows.append((len(x), float(np.maximum(order.counts(lists_of(x, jaccard, order, weight)) - order.usual - 1, 0).sum())))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.float64())], names=["size", "scanned"])

    # thirty shingles have thirty words and more, which may be of any length, but few texts beyond this are so short of words
    words = F.size(F.split(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), " "))
    short = docs.where(F.length("text") < 2_000).where(words < 30 + width).select("text")
    rows = short.mapInArrow(measure, "size int, scanned double").groupBy("size").agg(F.count("*").alias("n"), F.sum("scanned").alias("scanned")).collect()
    return boundary({r["size"]: r.n for r in rows}, {r["size"]: r.scanned for r in rows}, jaccard)


def keyed_documents(docs: DataFrame, jaccard: float, width: int, light: int, seed: int, order: Order) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key, set_check, bits, keys, pieces per document row; keys are null for a set that the task has seen before."""

    def work(batches):
        seen: set[int] = set()
        with np.errstate(over="ignore"):
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    b = whole.slice(at, 1024)
                    sizes, key, check, bits, keys, pieces = [], [], [], [], [], []
                    for text in b.column("text").to_pylist():
                        x, weight = weighed(text, width, seed, order) if text is not None else (np.zeros(0, U), None)
                        d = xxhash.xxh3_128_digest(x.tobytes(), seed)
                        sizes.append(len(x)), key.append(int.from_bytes(d[:8], "big", signed=True)), check.append(int.from_bytes(d[8:], "big", signed=True))
                        if not len(x) or key[-1] in seen:
                            bits.append(None), keys.append(None), pieces.append(None)
                            continue
                        seen.add(key[-1])
                        k = keys_of(x, jaccard, light, order, weight)
                        # lists of frequent shingles are cut into pieces; which one is a matter of the set
                        n = np.ceil(order.counts(k) / order.often).astype(np.int64)
                        bits.append(parities(x)), keys.append(k.view(np.int64)), pieces.append(np.where(n > 1, 1 + key[-1] % np.maximum(n, 1), 0).astype(np.int32))
                    arrays = [b.column("doc_id"), b.column("text_key"), pa.array(sizes, pa.int64()), pa.array(key, pa.int64()), pa.array(check, pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64())), pa.array(pieces, pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_key", "n_shingles", "set_key", "set_check", "bits", "keys", "pieces"])

    schema = "doc_id long, text_key long, n_shingles long, set_key long, set_check long, bits array<long>, keys array<long>, pieces array<int>"
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(work, schema)


def scanned_lists(lists: DataFrame, jaccard: float, short: int) -> DataFrame:
    """a, b, tied: candidate pairs (tied false), and sets of long lists with the list's key (true). Input: key, piece, set_key, size.

    Rows of a key and piece come one after another, a list is never held beyond `short` rows and a batch. All pieces of a key make one list.
    """

    def work(batches):
        num = round(jaccard * 100)
        held = [np.zeros(0, np.int64)] * 4  # key, piece, set_key, size of the list at the end of the last batch
        hub: tuple[int, int] | None = None  # key and piece of that list, if it is long already

        def scan(key, piece, who, size, closed: bool):
            nonlocal held, hub
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (piece[1:] != piece[:-1])
            again = np.zeros(len(key), bool)
            again[1:] = ~fresh[1:] & (who[1:] == who[:-1])
            key, piece, who, size, fresh = (z[~again] for z in (key, piece, who, size, fresh))
            starts = np.flatnonzero(fresh)
            length = np.diff(np.append(starts, len(key)))
            group = np.repeat(np.arange(len(starts)), length)
            long = (length > short) | (piece[starts] > 0)
            if hub and len(starts) and (int(key[0]), int(piece[0])) == hub:
                long[0] = True
            if not closed and len(starts):
                # the last list goes on: a short one waits, of a long one only its key is remembered
                last = len(starts) - 1
                hub = (int(key[-1]), int(piece[-1])) if long[last] else None
                keep = slice(0, len(key)) if long[last] else slice(0, int(starts[last]))
                held = [np.zeros(0, np.int64)] * 4 if long[last] else [z[int(starts[last]) :] for z in (key, piece, who, size)]
                key, piece, who, size, group = (z[keep] for z in (key, piece, who, size, group))
            a, b, tied = [], [], []
            tie = long[group]
            a.append(who[tie]), b.append(key[tie]), tied.append(np.ones(int(tie.sum()), bool))
            for step in range(1, short):
                i = np.flatnonzero(group[step:] == group[:-step]) if len(group) > step else np.zeros(0, np.int64)
                if not len(i):
                    break
                i = i[~long[group[i]]]
                near = 100 * np.minimum(size[i], size[i + step]) >= num * np.maximum(size[i], size[i + step])
                a.append(who[i[near]]), b.append(who[i[near] + step]), tied.append(np.zeros(int(near.sum()), bool))
            a, b, tied = np.concatenate(a), np.concatenate(b), np.concatenate(tied)
            if not len(a):
                return None
            order = np.lexsort((b, a, tied))
            a, b, tied = a[order], b[order], tied[order]
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (tied[1:] != tied[:-1]))
            return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.array(tied[new])], names=["a", "b", "tied"])

        for batch in batches:
            columns = [np.concatenate([h, batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)]) for h, c in zip(held, ("key", "piece", "set_key", "size"), strict=True)]
            if len(columns[0]) and (found := scan(*columns, False)) is not None:
                yield found
        if len(held[0]) and (found := scan(*held, True)) is not None:
            yield found

    dealt = lists.select("key", "piece", "set_key", "size").repartition("key", "piece").sortWithinPartitions("key", "piece", "set_key")
    return dealt.mapInArrow(work, "a long, b long, tied boolean")


def alike(sizes: np.ndarray, bits: list[np.ndarray], sides: np.ndarray, jaccard: float, room: int = 500_000) -> np.ndarray:
    """Of each set the smallest place that it is connected to by pairs that agree in size and pass the test on parity bits: those between the two sides, or all if there is one side."""
    hundredths, n = round(jaccard * 100), len(sizes)
    label, two = np.arange(n), len(np.unique(sides)) > 1
    width = np.array([len(x) for x in bits])
    rows = {m: (at := np.flatnonzero(width == m))[np.argsort(sizes[at], kind="stable")] for m in np.unique(width).tolist()}
    table = {m: np.stack([bits[i] for i in at]).view(U) for m, at in rows.items()}
    for m, at in rows.items():
        # partners are no larger: of equally many bits, or of half as many, to which these are folded
        for k, own in ((m, table[m]), (m // 2, table[m][:, : m // 2] ^ table[m][:, m // 2 :])):
            if k not in rows:
                continue
            there, start = rows[k], 0
            while start < len(at):
                low = int(np.searchsorted(sizes[there], math.ceil(sizes[at[start]] * jaccard - 1e-9)))
                stop = min(len(at), start + max(1, room // (k * max(1, len(there) - low))))
                high = int(np.searchsorted(sizes[there], sizes[at[stop - 1]], "right"))
                i, j = at[start:stop, None], there[None, low:high]
                apart = np.bitwise_count(own[start:stop, None, :] ^ table[k][None, low:high, :]).sum(axis=2, dtype=np.int64)
                both = sizes[i] + sizes[j]
                near = (apart * (100 + hundredths) <= both * (100 - hundredths)) & (label[i] != label[j])
                if two:
                    near &= sides[i] != sides[j]
                x, y = np.nonzero(near)
                if len(x):
                    label = smallest_reachable(label[at[start + x]], label[there[low + y]], n)[label]
                start = stop
    return label


def tested_lists(members: DataFrame, bits: DataFrame, jaccard: float, words_per_tile: int) -> DataFrame:
    """a, b: ties of the sets of long lists that pass the test on parity bits. Input: set_key, component (the list's key); set_key, bits, size."""
    # a passage that many texts hold gives one list per shingle, with the same sets: it is tested once
    digest = members.groupBy("component").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("set_key", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("set_key", F.lit(2))).alias("y"))
    once = digest.groupBy("n", "x", "y").agg(F.min("component").alias("component")).select("component")
    lists = cut(members.join(once.hint("merge"), "component").join(bits.select("set_key", "size"), "set_key"), "long")
    tiles = dealt_tiles(lists, jaccard, words_per_tile, F.greatest("size", F.lit(512)))
    dealt = tiles.hint("merge").join(bits, tiles.id == bits.set_key).select(F.xxhash64("tile").alias("place"), "tile", "side", "id", "bits", "size").repartition("place").sortWithinPartitions("place", "tile")

    def work(batches):
        tile, held = None, []

        def done():
            ids, sizes, bits, sides = zip(*held, strict=True)
            ids, label = np.array(ids), alike(np.array(sizes), list(bits), np.array(sides), jaccard)
            moved = label != np.arange(len(ids))
            return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], names=["a", "b"])

        for b in batches:
            column = b.column("bits")
            maps, ends = column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))
            rows = zip(*(b.column(c).to_pylist() for c in ("tile", "id", "size", "side")), ends[:-1].tolist(), ends[1:].tolist(), strict=True)
            for t, i, size, side, low, high in rows:
                if t != tile:
                    if len(held) > 1:
                        yield done()
                    tile, held = t, []
                held.append((i, size, maps[low:high], side))
        if len(held) > 1:
            yield done()

    return dealt.mapInArrow(work, "a long, b long")


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i


def linked(ids: list[int], sets: list[np.ndarray], sides: list[int], jaccard: float) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets: those between the two sides, or all of them if there is one side.

    Shingle lists are scanned set by set: the counts of the shared shingles are the exact intersection sizes.
    """
    num, den = round(jaccard * 100), 100
    sizes = np.array([len(x) for x in sets])
    order = np.argsort(sizes, kind="stable")
    sets, ids, sides, sizes = [sets[i] for i in order], [ids[i] for i in order], np.array(sides)[order], sizes[order]
    n, two = len(sets), len(set(sides.tolist())) > 1
    elements = np.concatenate(sets)
    _, element = np.unique(elements, return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    by = np.argsort(element, kind="stable")
    posting, ends = owner[by], np.cumsum(np.bincount(element))
    begins = np.concatenate([[0], ends[:-1]])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    forest, edges = Forest(n), []
    label = np.arange(n)
    for i in range(n):
        first = int(np.searchsorted(sizes, math.ceil(sizes[i] * jaccard - 1e-9)))
        open_ = label[first:i] != label[i]
        if two:
            open_ &= sides[first:i] != sides[i]
        if not open_.any():
            continue
        own = element[offsets[i] : offsets[i + 1]]
        counts = ends[own] - begins[own]
        at = np.repeat(begins[own] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        shared = np.bincount(posting[at], minlength=n)[first:i]
        hits = np.flatnonzero(open_ & (shared * den >= num * (sizes[first:i] + sizes[i] - shared)))
        for j in (hits + first).tolist():
            a, b = forest.root(i), forest.root(j)
            if a != b:
                forest.up[a] = b
                edges.append((ids[i], ids[j]))
                label[label == label[i]] = label[j]
    return edges


def true_links(sets_in_clusters: DataFrame, jaccard: float, width: int, seed: int) -> DataFrame:
    """Edges (a, b) of a spanning forest per tile. Input: tile, side, id, text; a tile's rows are together in a partition and come in a row."""

    def work(batches):
        tile, ids, sets, sides = None, [], [], []

        def done():
            e = linked(ids, sets, sides, jaccard) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in e], pa.int64()), pa.array([b for _, b in e], pa.int64())], names=["a", "b"])

        with np.errstate(over="ignore"):
            for b in batches:
                for t, side, i, text in zip(*(b.column(c).to_pylist() for c in ("tile", "side", "id", "text")), strict=True):
                    if t != tile:
                        if len(ids) > 1:
                            yield done()
                        tile, ids, sets, sides = t, [], [], []
                    ids.append(i), sets.append(shingles(text, width, seed)), sides.append(side)
            if len(ids) > 1:
                yield done()

    return sets_in_clusters.mapInArrow(work, "a long, b long")


def linked_documents(docs: DataFrame, jaccard: float, width: int, words_per_tile: int, seed: int, light: int | None, short: int) -> tuple[DataFrame, DataFrame]:
    """Document rows (doc_id, text_key, n_shingles, set_key), and the component of each set that is linked (set_key, component)."""
    docs = docs.select("doc_id", "text")
    while True:
        order = counted_order(docs, width, seed)
        bound = light or chosen_boundary(docs, jaccard, width, seed, order)
        keyed = cut(keyed_documents(docs, jaccard, width, bound, seed, order), "sets")
        place = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key").alias("place")
        classes = keyed.where("n_shingles > 0").groupBy("set_key").agg(F.min(place).alias("first"), F.min("set_check").alias("least"), F.max("set_check").alias("most"), F.max("n_shingles").alias("size"), F.max("bits").alias("bits"))
        classes = cut(classes, "classes")
        if classes.where("least <> most").isEmpty():
            break
        seed += 1  # two sets share a key: try other hashes
    lists = keyed.where("keys is not null").select(F.explode(F.arrays_zip("keys", "pieces")).alias("l"), "set_key", F.col("n_shingles").cast("int").alias("size"))
    found = cut(scanned_lists(lists.select(F.col("l.keys").alias("key"), F.col("l.pieces").alias("piece"), "set_key", "size"), jaccard, short).distinct(), "candidates")
    bits = classes.select("set_key", "bits", "size")
    side = lambda x: bits.select(F.col("set_key").alias(x), F.col("bits").alias(f"{x}_bits"), F.col("size").alias(f"{x}_size"))
    # sets that agree in size have equally many bits, or one twice as many, which are folded
    half = lambda x: F.zip_with(F.slice(x, F.lit(1), (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2).cast("int") + 1, (F.size(x) / 2).cast("int")), lambda p, q: p.bitwiseXOR(q))
    fold = lambda x, y: F.when(F.size(x) > F.size(y), half(x)).otherwise(F.col(x))
    apart = F.aggregate(F.zip_with(fold("a_bits", "b_bits"), fold("b_bits", "a_bits"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    # intersection >= J * union says that at most (1 - J) / (1 + J) of both sizes differ
    hundredths = round(jaccard * 100)
    near = apart * (100 + hundredths) <= (F.col("a_size") + F.col("b_size")) * (100 - hundredths)
    pairs = found.where("not tied").select("a", "b").join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").where(near).select("a", "b")
    ties = tested_lists(found.where("tied").select(F.col("a").alias("set_key"), F.col("b").alias("component")), bits, jaccard, 4 * words_per_tile)
    clusters = cut(components(pairs.unionByName(ties), label="clusters"), "clusters").withColumnRenamed("id", "set_key")
    members = cut(clusters.join(classes.select("set_key", "first", "size"), "set_key"), "members")
    tiles = dealt_tiles(members, jaccard, words_per_tile)
    texts = _texts(docs, members)
    dealt = tiles.hint("merge").join(texts, tiles.id == texts.t_set).select("tile", "side", "id", "text").repartition("tile").sortWithinPartitions("tile")
    links = cut(true_links(dealt, jaccard, width, seed), "links")
    return keyed, classes.select("set_key", "first").join(components(links, label="near").withColumnRenamed("id", "set_key"), "set_key", "left").select("set_key", "first", F.coalesce("component", "set_key").alias("component"))


def dealt_tiles(members: DataFrame, jaccard: float, words_per_tile: int, weight: Column | None = None) -> DataFrame:
    """id, tile, side of the sets of clusters. A small cluster is one tile. A large one is cut by size into bands, such that linked sets are in one band or in neighbouring ones, and a large
    band by hash into chunks; two chunks of a band, or of neighbouring bands, make a tile. So a set goes to about three times as many tiles as its band has chunks. weight: what counts as a set's words (none: its size)."""
    large = F.sum("size").over(Window.partitionBy("component")) * 2 > words_per_tile
    sums = members.withColumn("band", F.floor(F.log("size") / (math.log(1 / jaccard) * (1 + 1e-9)))).groupBy("component", "band").agg(F.sum("size" if weight is None else weight).alias("size"))
    sums = sums.withColumn("large", large)
    chunks = F.when(F.col("large"), F.ceil(2 * F.col("size") / words_per_tile)).otherwise(1).cast("int")
    near = Window.partitionBy("component").orderBy("band")
    beside = lambda f, step: F.when(F.col("large") & (f("band").over(near) == F.col("band") + step), f("chunks").over(near)).otherwise(0)
    sums = sums.withColumn("chunks", chunks).withColumns({"below": beside(F.lag, -1), "above": beside(F.lead, 1)}).select(F.col("component").alias("of"), F.col("band").alias("of_band"), "large", "chunks", "below", "above")
    m = members.select("component", F.col("set_key").alias("id"), F.floor(F.log("size") / (math.log(1 / jaccard) * (1 + 1e-9))).alias("band"))
    m = m.join(sums, (F.col("component") == F.col("of")) & (F.col("band") == F.col("of_band")))
    m = m.withColumn("band", F.when(F.col("large"), F.col("band")).otherwise(-1)).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    named = lambda kind, band, low, high, side: F.struct(F.concat_ws("-", F.col("component"), F.lit(kind), band, low, high).alias("tile"), side.cast("int").alias("side"))
    own = F.transform(upto(F.col("chunks")), lambda k: named("in", F.col("band"), F.least("chunk", k), F.greatest("chunk", k), F.col("chunk")))
    up = F.transform(upto(F.col("above")), lambda k: named("up", F.col("band"), F.col("chunk"), k, F.lit(0)))
    down = F.transform(upto(F.col("below")), lambda k: named("up", F.col("band") - 1, k, F.col("chunk"), F.lit(1)))
    return m.select("id", F.explode(F.concat(own, up, down)).alias("t")).select("id", "t.tile", "t.side")


def marked(keys: DataFrame, column: str) -> np.ndarray:
    """A bitmap of 2 ** MARKS bits with those of the keys set: 4 MB come to the driver at any size of the corpus."""
    slices = 64

    def work(batches):
        maps: dict[int, np.ndarray] = {}
        for b in batches:
            at = (b.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(U) & U(2**MARKS - 1)).astype(np.int64)
            part = at * slices >> MARKS
            for k in np.unique(part).tolist():
                maps.setdefault(k, np.zeros(2**MARKS // slices, bool))[at[part == k] - k * (2**MARKS // slices)] = True
        if maps:
            yield pa.RecordBatch.from_arrays([pa.array(list(maps), pa.int32()), pa.array([np.packbits(x).tobytes() for x in maps.values()], pa.binary())], names=["slice", "bits"])

    keys = keys.select(F.col(column).alias("key")).where("key is not null")
    bits = np.zeros((slices, 2**MARKS // slices // 8), np.uint8)
    # what falls on a slice comes together, so each slice is sent once
    place = F.shiftright(F.col("key").bitwiseAND(F.lit(2**MARKS - 1)) * slices, MARKS)
    for r in keys.withColumn("part", place).repartition("part").select("key").mapInArrow(work, "slice int, bits binary").collect():
        bits[r["slice"]] |= np.frombuffer(r.bits, np.uint8)
    return bits.reshape(-1)


def divided(rows: DataFrame, column: str, bits: np.ndarray, hit: bool) -> DataFrame:
    """The rows whose key may be one of those marked, a few others among them (hit), or those whose key is certainly none: what is left out is not shuffled."""

    @F.arrow_udf("boolean")
    def found(key: pa.Array) -> pa.Array:
        at = key.to_numpy(zero_copy_only=False).astype(np.int64).view(U) & U(2**MARKS - 1)
        return pa.array((bits[(at >> U(3)).astype(np.int64)] >> (U(7) - (at & U(7))).astype(np.uint8)) & 1 == 1)

    # keys alone go to Python, texts do not
    return rows.where(found(F.col(column)) == F.lit(hit))


def _texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """t_set, text: the text of each set's first document, once."""
    wanted = members.select(F.col("set_key").alias("t_set"), F.col("first.doc_id").alias("t_id"), F.col("first.text_key").alias("t_key"))
    d = docs.where("text is not null").withColumn("text_key", F.xxhash64("text"))
    d = divided(d, "text_key", marked(wanted, "t_key"), True)
    # a merge join at every size: what is wanted grows with the corpus, so it is never broadcast
    found = d.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("text_key") == F.col("t_key")))
    return found.select("t_set", "text").dropDuplicates(["t_set"])


def join_documents(docs: DataFrame, jaccard: float = 0.9, width: int = 3, words_per_tile: int = 2_000_000, seed: int = 7, light: int | None = None, short: int = 16) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) per document row. jaccard: in hundredths. light: largest size that enumerates subsets (none: chosen by cost)."""
    keyed, sets = linked_documents(docs, jaccard, width, words_per_tile, seed, light, short)
    smallest = sets.groupBy("component").agg(F.min("first.doc_id").alias("smallest"))
    answers = sets.join(smallest, "component").select("set_key", "smallest")
    return keyed.join(answers, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id"))


def keep_one(docs: DataFrame, jaccard: float = 0.8, width: int = 5, words_per_tile: int = 2_000_000, seed: int = 7, light: int | None = None, short: int = 16) -> DataFrame:
    """One row of each component: its smallest doc_id (null last), of rows that share it the smallest text key, of equal ones the smallest in the other columns. Documents without words stay. Columns as in docs; they must be orderable."""
    keyed, sets = linked_documents(docs, jaccard, width, words_per_tile, seed, light, short)
    winners = cut(sets.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("k_id"), F.col("first.text_key").alias("k_key")), "winners")
    others = [c for c in docs.columns if c != "text"]
    # texts of rows that go, or that share text and id with another row; all other rows stay as they are, and their texts are not shuffled
    rows = keyed.where("n_shingles > 0").groupBy("doc_id", "text_key").agg(F.count("*").alias("n"))
    rows = rows.join(winners.hint("merge"), F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("text_key") == F.col("k_key")), "left")
    bits = marked(rows.where("n > 1 or k_key is null"), "text_key")
    some = docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("k_text", F.xxhash64("text"))
    clear = divided(some, "k_text", bits, False).select(*docs.columns)
    kept = divided(some, "k_text", bits, True).join(winners.hint("merge"), F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("k_text") == F.col("k_key")))
    kept = kept.groupBy("k_id", "k_key").agg(F.min(F.struct(*others)).alias("row"), F.first("text").alias("text")).select("row.*", "text").select(*docs.columns)
    bare = docs.where(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return clear.unionByName(kept).unionByName(bare)
