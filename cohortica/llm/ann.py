"""Approximate nearest neighbours by balanced posting lists (after SPANN, Chen et al., 2021).

Index: centroids are fitted on a bounded sample, coarse groups first and lists within them; every vector goes to the list of its nearest centroid and, if it lies near a
boundary, to further ones (distance ratio, and no two lists whose centroids are nearer to each other than to the vector). The centroids are kept in
memory as a neighbour graph, which both indexing and queries search best-first, many vectors in step. A query reads the lists whose centroid distance is
within a ratio of its nearest ones' (the mean of eight). The ratio is measured on the sample: the one at which a share (`aim`) of the sample's own neighbours is in lists that are read.

The measure is the inner product: vectors get one more coordinate that makes all lengths equal, queries a zero, so that the nearest by distance is the largest by
product. Products are taken in double precision on the original components; ties go to the smaller id.

Lists that are neighbours share a shard, so a vector with several lists mostly travels once, and a query goes to few shards. Within a shard each list is one slice of rows, multiplied with
the queries that read it. Beyond most_lists * list_rows vectors lists grow with the table; a list that is long is divided by centroids of its own
in the task, by the same rules. Crowded shards are cut by hash into pieces, so tasks are even. All vectors are indexed; only centroids
are fitted on samples. Recall is measured against brute force in the tests (0.9 is required).

Edges: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows with a null vec_id, nor vectors of another length than the most
common (ties: the shortest); rows that repeat a vec_id are one item with several vectors, whose product with another is the largest of theirs; with fewer
candidates than k all of them are given that the lists read hold; the query's own item is no candidate; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortica.llm.common import cut, parts
from cohortica.llm.embedding_dedup import _matrix, usable


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * x @ c.T, 0)


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and the nearest of each row, for rows of one length: centroids have that length too. Crowded ones are made to look farther away, which evens sizes out."""
    length = np.sqrt((x * x).sum(axis=1).max())
    c = x[rng.choice(len(x), k, replace=False)].copy() if c is None else c
    extra = np.zeros(k, x.dtype)
    for _ in range(rounds):
        near, least = np.empty(len(x), np.int64), np.empty(len(x), x.dtype)
        for at in range(0, len(x), 4096):
            d = distances(x[at : at + 4096], c)
            near[at : at + 4096], least[at : at + 4096] = (d + extra[None, :]).argmin(axis=1), d.min(axis=1)
        size = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        there = np.flatnonzero(size)
        sums = np.add.reduceat(x[order], (np.cumsum(size) - size)[there], axis=0)
        c = x[rng.choice(len(x), k)].copy()
        long = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        c[there] = np.where(long > 1e-6 * length * size[there, None], sums / np.maximum(long, 1e-30) * length, c[there])
        extra = (0.02 * (size / max(1.0, len(x) / k) - 1).clip(-1, 3) * least.mean()).astype(x.dtype)
    return c, near


#: Read ratios are of the mean distance of so many nearest centroids: that of one alone is mostly chance where vectors point everywhere.
BASE = 8


class Centroids:
    """Centroids and their neighbour graph. Lists next to each other in number are near each other."""

    def __init__(self, sample: np.ndarray, lists: int, degree: int = 24, seed: int = 3):
        rng = np.random.default_rng(seed)
        x = np.asarray(sample, np.float32)
        lists = max(1, min(lists, len(x)))
        coarse = max(1, round(lists**0.5))
        top, near = k_means(x, coarse, 8, rng)
        # coarse groups in a chain of neighbours
        chain, free = [0], set(range(1, coarse))
        while free:
            chain.append(min(free, key=lambda j: float(((top[j] - top[chain[-1]]) ** 2).sum())))
            free.remove(chain[-1])
        size = np.bincount(near, minlength=coarse)
        # each group gets its share of the lists, one at least if it has rows
        own = np.maximum(np.floor(size * lists / len(x)).astype(int), (size > 0).astype(int))
        for j in np.argsort(-size / np.maximum(own, 1)):
            if own.sum() < lists and own[j] < size[j]:
                own[j] += 1
        fine = [k_means(x[near == j], min(own[j], size[j]), 6, rng)[0] for j in chain if own[j]]
        self.c, near = k_means(x, sum(map(len, fine)), 2, rng, np.concatenate(fine))
        lists = len(self.c)
        self.size = np.bincount(near, minlength=lists) / len(x)
        self.square = (self.c * self.c).sum(axis=1)
        d = distances(self.c, self.c)
        #: Distance at which a vector usually has its nearest centroid: ratios are taken of it where a query lies on a centroid.
        self.typical = float(np.sqrt(distances(x[:2048], self.c).min(axis=1)).mean())
        self.between = np.sqrt(d)
        links = np.argsort(d, axis=1, kind="stable")[:, 1 : degree + 1]
        # a link to the next in number keeps the graph in one piece
        self.links = np.concatenate([links, ((np.arange(lists) + 1) % lists)[:, None], ((np.arange(lists) - 1) % lists)[:, None]], axis=1)
        self.entries = np.arange(0, lists, max(1, lists // 16))

    def search(self, x: np.ndarray, ratio: float, of: int = 1, floor: float = 0.0, most: int = 0, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Distances (rows, lists) as far as the graph was walked, infinite elsewhere, and each row's limit: ratio times the mean of its `of` nearest distances, or of the floor if that
        is more. Best-first, `width` nodes a step, until the best open node lies beyond the limit, or (most) beyond so many that were met."""
        x = np.asarray(x, np.float32)
        n, lists = len(x), len(self.c)
        met = np.full((n, lists), np.inf, np.float32)
        own = (x * x).sum(axis=1)
        met[:, self.entries] = np.sqrt(np.maximum(own[:, None] + self.square[self.entries][None, :] - 2 * x @ self.c[self.entries].T, 0))
        open_ = met.copy()
        live, width = np.arange(n), min(width, lists)
        of, most = min(of, len(self.entries)), min(most, len(self.entries))
        # the nearest distances met so far, in order
        top = np.sort(met[:, self.entries], axis=1)[:, : max(of, most)]
        limit = lambda z: np.minimum(np.maximum(z[:, :of].mean(axis=1), floor) * ratio * 1.01, z[:, most - 1] if most else np.inf) + 1e-6
        while True:
            now = open_[live]
            best = now.argmin(axis=1)[:, None] if width == 1 else np.argpartition(now, width - 1, axis=1)[:, :width]
            at = now[np.arange(len(live))[:, None], best].min(axis=1)
            go = at <= limit(top[live])
            live, best = live[go], best[go]
            if not len(live):
                break
            open_[live[:, None], best] = np.inf
            nodes = self.links[best].reshape(len(live), -1)
            i, j = np.nonzero(np.isinf(met[live[:, None], nodes]))
            rows, to = live[i], nodes[i, j]
            d = np.sqrt(np.maximum(own[rows] + self.square[to] - 2 * np.einsum("nd,nd->n", x[rows], self.c[to]), 0))
            # a node that two of the step's nodes lead to is met once
            near = np.full(nodes.shape, np.inf, np.float32)
            near[i, j] = d
            if width > 1:
                met[rows, to] = -1 - j
                near[i[(met[rows, to] != -1 - j)], j[(met[rows, to] != -1 - j)]] = np.inf
            met[rows, to] = open_[rows, to] = d
            top[live] = np.sort(np.concatenate([top[live], near], axis=1), axis=1)[:, : top.shape[1]]
        return met, np.maximum(top[:, :of].mean(axis=1), floor) * ratio + 1e-6

    def places(self, x: np.ndarray, ratio: float, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Lists of vectors, as (row, list): the nearest centroid, and for boundary vectors others that are not behind one taken already."""
        rows, lists = [], []
        for at in range(0, len(x), 1024):
            met, limit = self.search(x[at : at + 1024], ratio, most=2 * most)
            m = min(2 * most, len(self.c))
            near = np.argpartition(met, m - 1, axis=1)[:, :m]
            d = np.take_along_axis(met, near, axis=1)
            order = np.lexsort((near, d), axis=1)
            near, d = np.take_along_axis(near, order, axis=1), np.take_along_axis(d, order, axis=1)
            take = np.zeros(near.shape, bool)
            take[:, 0] = True
            for j in range(1, m):
                behind = (take[:, :j] & (self.between[near[:, :j], near[:, j][:, None]] <= d[:, j][:, None])).any(axis=1)
                take[:, j] = (d[:, j] <= limit) & ~behind & (take[:, :j].sum(axis=1) < most)
            r, j = np.nonzero(take)
            rows.append(r + at), lists.append(near[r, j])
        return np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *lists])

    def reads(self, x: np.ndarray, ratio: float, rows: float) -> tuple[np.ndarray, np.ndarray]:
        """Lists that queries read, as (row, list): within the ratio, and as many of the nearest as hold a share of `rows` of the sample."""
        out_rows, out_lists = [], []
        for at in range(0, len(x), 512):
            met, limit = self.search(x[at : at + 512], ratio, BASE, self.typical, width=8)
            order = np.argsort(met, axis=1, kind="stable")
            held = np.cumsum(self.size[order], axis=1) - self.size[order]
            d = np.take_along_axis(met, order, axis=1)
            r, j = np.nonzero(np.isfinite(d) & ((d <= limit[:, None]) | (held < rows)))
            out_rows.append(r + at), out_lists.append(order[r, j])
        return np.concatenate([np.zeros(0, np.int64), *out_rows]), np.concatenate([np.zeros(0, np.int64), *out_lists])

    def calibrated(self, sample: np.ndarray, asking: np.ndarray, k: int, near_ratio: float, copies: int, aim: float) -> float:
        """The read ratio at which a share `aim` of the k nearest in the sample are in a list that is read."""
        row, place = self.places(sample, near_ratio, copies)
        starts = np.searchsorted(row, np.arange(len(sample) + 1))
        need = []
        for at in range(0, len(asking), 64):
            away, gaps = distances(asking[at : at + 64], sample), np.sqrt(distances(np.asarray(asking[at : at + 64], np.float32), self.c))
            base = np.maximum(np.partition(gaps, min(BASE, len(self.c)) - 1, axis=1)[:, :BASE].mean(axis=1), self.typical)
            for i, near in enumerate(np.argpartition(away, min(k, len(sample) - 1), axis=1)[:, : k + 1]):
                # the nearest of all is the vector itself
                near = near[np.argsort(away[i, near], kind="stable")][1:]
                need += [float(gaps[i, place[starts[v] : starts[v + 1]]].min() / base[i]) for v in near.tolist()]
        return float(np.quantile(need, aim)) if need else 1.0


class Best:
    """The k best items of each query so far."""

    def __init__(self, q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int):
        self.q, self.own, self.x, self.ids, self.k = q, own, x, ids, k
        self.least = np.full(len(q), -np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, asking: np.ndarray, rows: np.ndarray) -> None:
        """Products of some queries with some rows."""
        for at in range(0, len(rows), 8192):
            part = rows[at : at + 8192]
            for b in range(0, len(asking), 512):
                some = asking[b : b + 512]
                i, j = np.nonzero(self.q[some] @ self.x[part].T >= self.least[some][:, None])
                i, j = some[i], part[j]
                other = self.ids[j] != self.own[i]
                i, j = i[other], j[other]
                # the sum of a row's products is the same wherever the row stands
                s = np.concatenate([np.zeros(0), *((self.q[i[a : a + 65536]] * self.x[j[a : a + 65536]]).sum(axis=1) for a in range(0, len(i), 65536))])
                self.found.append((i, self.ids[j], s))
                self.waiting += len(i)
                if self.waiting > 200_000 + 2 * self.k * len(self.q):
                    self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, v, s = (np.concatenate(z) for z in zip(*self.found, strict=True)) if self.found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((-s, v, i))
        i, v, s = i[order], v[order], s[order]
        first = np.append(True, (i[1:] != i[:-1]) | (v[1:] != v[:-1]))[: len(i)]
        i, v, s = i[first], v[first], s[first]
        order = np.lexsort((v, -s, i))
        i, v, s = i[order], v[order], s[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        last = rank == self.k - 1
        # room for the rounding of matrix products
        self.least[i[last]] = s[last] - 1e-9 * (1 + np.abs(s[last]))
        keep = rank < self.k
        self.found, self.waiting = [(i[keep], v[keep], s[keep])], 0
        return self.found[0]


def slices(lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of entries by list, the lists, and where each begins and the last ends."""
    order = np.argsort(lists, kind="stable")
    names, starts = np.unique(lists[order], return_index=True)
    return order, names, np.append(starts, len(lists))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and values of a column of lists."""
    column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    return np.repeat(np.arange(len(column)), lengths), column.flatten().to_numpy().astype(np.int64)


def searched(x: np.ndarray, ids: np.ndarray, held: tuple[np.ndarray, np.ndarray], q: np.ndarray, own: np.ndarray, asked: tuple[np.ndarray, np.ndarray], k: int, list_rows: int, longest: float, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, id and product of the k best of each query among the rows of the lists it reads. held: (row, list) of the vectors, asked: of the queries."""
    best = Best(q, own, x, ids, k)
    order, names, ends = slices(held[1])
    q_order, q_names, q_ends = slices(asked[1])
    for name, at in zip(*(z.tolist() for z in np.intersect1d(names, q_names, return_indices=True)[:2]), strict=True):
        rows = held[0][order[ends[at] : ends[at + 1]]]
        place = int(np.searchsorted(q_names, name))
        asking = asked[0][q_order[q_ends[place] : q_ends[place + 1]]]
        if len(rows) <= 64 * list_rows:
            best.add(asking, rows)
            continue
        # a long list has lists of its own
        inner = Centroids(lifted(x[rows[np.random.default_rng(1).permutation(len(rows))[:20_000]]], longest), min(2_048, len(rows) // list_rows))
        _, near = inner.places(lifted(x[rows], longest), 1.0, 1)
        r, near_q = inner.reads(level(q[asking], longest), ratio, 8 * k / len(rows))
        o, n, e = slices(near)
        qo, qn, qe = slices(near_q)
        for b, c, d in zip(*(z.tolist() for z in np.intersect1d(n, qn, return_indices=True)), strict=True):
            best.add(asking[r[qo[qe[d] : qe[d + 1]]]], rows[o[e[c] : e[c + 1]]])
    return best.settle()


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with one more coordinate, all of the greatest length."""
    return np.hstack([x, np.sqrt(np.maximum(longest - (x * x).sum(axis=1, keepdims=True), 0))])


def level(q: np.ndarray, longest: float) -> np.ndarray:
    """Queries of that length, their last coordinate zero: a query's own length does not matter."""
    return np.hstack([q / np.sqrt((q * q).sum(axis=1, keepdims=True)) * np.sqrt(longest), np.zeros((len(q), 1))])


def search_embeddings(vectors: DataFrame, every: int = 20, k: int = 20, list_rows: int = 32, sample_rows: int = 20_000, most_lists: int = 2_048, copies: int = 4, near_ratio: float = 1.15, aim: float = 0.93, shard_rows: int = 8_000) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every item whose id is divisible by `every`, among all others.

    sample_rows and most_lists bound what is fitted, held in memory and sent to executors, at every size of the table.
    """
    schema = "query_id long, rank int, vec_id long, score double"
    v = usable(vectors)
    size = v.groupBy("d").count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return vectors.sparkSession.createDataFrame([], schema)
    v = cut(v.where(F.col("d") == size.d).withColumn("square", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)), "vectors")
    stats = v.agg(F.count("*").alias("n"), F.max("square").alias("m")).first()
    total, longest, kind = stats["n"], stats["m"], v.schema["embedding"].dataType.simpleString()
    # a bounded sample by a hash of the components, the same in every run; the filter leaves a few more rows than are taken
    mark = F.xxhash64("embedding", F.lit(3))
    some = v if total <= sample_rows else v.where(F.pmod(mark, F.lit(2**40)) < int(min(1.0, 1.2 * sample_rows / total) * 2**40) + 1)
    sample = _matrix(some.orderBy(mark, "vec_id").limit(sample_rows).select("embedding").toArrow().column("embedding"))
    share = len(sample) / total
    lists = 1 if total <= 16 * max(k, list_rows // 2) else min(most_lists, parts(vectors.sparkSession, total, list_rows))
    points = lifted(sample, longest)
    # where most vectors are not in the sample, those that ask are not fitted on either
    apart = min(300, len(points) // 10) if total > len(points) else 0
    index_of = Centroids(points[apart:], lists)
    read_ratio = index_of.calibrated(points, points[:300], min(k, max(1, round(k * share))), near_ratio, copies, aim)
    shards = parts(vectors.sparkSession, 2 * total, shard_rows)
    # neighbouring lists come to one shard, by their share of the sample
    shard_of = np.minimum((np.cumsum(index_of.size) - index_of.size / 2) * min(shards, lists), min(shards, lists) - 1).astype(np.int32)

    def dealt(rows: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
        """Row and shard of each pair of them, and the row's lists in the shard."""
        shard = shard_of[lists]
        order = np.lexsort((lists, shard, rows))
        rows, shard, lists = rows[order], shard[order], lists[order]
        starts = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (shard[1:] != shard[:-1]))[: len(rows)])
        return rows[starts], shard[starts], pa.ListArray.from_arrays(pa.array(np.append(starts, len(rows)).astype(np.int32)), pa.array(lists.astype(np.int32)))

    def index(batches):
        for b in batches:
            if not b.num_rows:
                continue
            rows, shard, held = dealt(*index_of.places(lifted(_matrix(b.column("embedding")), longest), near_ratio, copies))
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(take), b.column("embedding").take(take), pa.array(shard), held], names=["vec_id", "embedding", "shard", "lists"])

    def route(batches):
        for b in batches:
            if not b.num_rows:
                continue
            rows, shard, read = dealt(*index_of.reads(level(_matrix(b.column("embedding")), longest), read_ratio, 8 * k / total))
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(take), b.column("embedding").take(take), pa.array(shard), read], names=["query_id", "query", "shard", "reads"])

    postings = cut(v.select("vec_id", "embedding").mapInArrow(index, f"vec_id long, embedding {kind}, shard int, lists array<int>"), "postings")
    # shards that turn out crowded are cut by hash; a query goes to every piece
    crowd = postings.groupBy("shard").count().select("shard", F.ceil(F.col("count") / (8 * shard_rows)).cast("int").alias("pieces"))
    held = postings.join(crowd, "shard").withColumn("piece", F.pmod(F.xxhash64("vec_id", F.lit(9)), F.col("pieces")).cast("int")).select("shard", "piece", "vec_id", "embedding", "lists")
    asked = v.where(F.col("vec_id") % every == 0).select("vec_id", "embedding").mapInArrow(route, f"query_id long, query {kind}, shard int, reads array<int>")
    asked = asked.join(crowd, "shard").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select("shard", "piece", "query_id", "query", "reads")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, own = left.column("vec_id").to_numpy(), right.column("query_id").to_numpy()
        i, found, score = searched(_matrix(left.column("embedding")), ids, _flat(left.column("lists")), _matrix(right.column("query")), own, _flat(right.column("reads")), k, list_rows, longest, read_ratio)
        return pa.table({"query_id": pa.array(own[i]), "vec_id": pa.array(found), "score": pa.array(score)})

    merged = held.groupBy("shard", "piece").cogroup(asked.groupBy("shard", "piece")).applyInArrow(best, "query_id long, vec_id long, score double")
    merged = merged.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
