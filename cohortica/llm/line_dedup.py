"""Line dedup by content-defined chunks of lines, with DataFrame functions alone.

A line is marked if a rolling digest over it and the line before falls into a fixed share of all digests, and the first of marked lines in a row ends a chunk, so
boundaries depend on the lines around them and not on their number: a passage inserted above shifts nothing below. No chunk is a single line: neither the first line nor the last but one
ends a chunk, so a text of two lines or more is covered whole. Chunks that occur again, anywhere, are removed but for their first occurrence (smallest
doc_id, null first, then text key, then place), after their bytes were compared.

Plan: chunks are grouped by digest and bytes (partial sums first, so a chunk held by a third of all documents is no hot key) and what recurs is written; the places of
chunks meet it by digest, in eight parts by document, so a hot chunk is no one task. Should different bytes share a digest, their chunks are told apart by the bytes. Removal
lists meet the documents by (doc_id, text key).

Edges: null text stays null with 0 lines; empty text is one empty line; a text of one line loses nothing; rows with a null doc_id are told apart by their text; rows equal in
doc_id and text are one document seen several times and treated alike, so a chunk that only such rows share stays; an empty table gives an empty result.
Columns of the input are kept; text is replaced. Added: n_lines, n_removed (lines).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortica.llm.common import cut, pinned

#: A line is marked if its rolling digest starts with one of these hex digits: every other line, so that a chunk has four lines on average.
ENDS = ("0", "1", "2", "3", "4", "5", "6", "7")
#: Parts of the places of a chunk.
PARTS = 8


def line_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, no, start, len, bytes, digest of every chunk of two lines or more; start counts from 1."""
    d = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    d = pinned(d, "lines", F.split("text", "\n")).drop("text")
    d = pinned(d, "digests", F.transform("lines", lambda x: F.md5(x)))
    # the rolling digest of line i covers lines i-1 and i; the first line is never marked
    earlier = F.slice(F.concat(F.array(F.lit("")), "digests"), 1, F.size("digests"))
    marked = F.transform(F.zip_with(earlier, "digests", lambda a, b: F.substring(F.md5(F.concat(a, b)), 1, 1).isin(*ENDS)), lambda x, i: x & (i > 0))
    d = pinned(d, "marked", marked).drop("digests")
    before = F.slice(F.concat(F.array(F.lit(False)), "marked"), 1, F.size("marked"))
    first = F.zip_with(before, "marked", lambda a, b: b & ~a)
    ends = F.filter(F.transform(first, lambda x, i: F.when(x & (i + 2 < F.size("marked")), i + 1)), lambda i: i.isNotNull())
    d = pinned(d, "ends", F.concat(ends, F.array(F.size("lines")))).drop("marked")
    starts = F.slice(F.concat(F.array(F.lit(0)), "ends"), 1, F.size("ends"))
    chunks = F.transform(F.zip_with(starts, "ends", lambda a, b: F.struct((a + 1).alias("start"), (b - a).alias("len"))), lambda c, k: F.struct(k.alias("no"), c["start"].alias("start"), c["len"].alias("len")))
    d = d.select("doc_id", "text_key", "lines", F.explode(F.filter(chunks, lambda c: c["len"] > 1)).alias("c"))
    d = d.select("doc_id", "text_key", "c.no", "c.start", "c.len", F.array_join(F.slice("lines", F.col("c.start"), F.col("c.len")), "\n").alias("bytes"))
    return d.withColumn("digest", F.unhex(F.sha2("bytes", 256)))


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, start, len of the chunks to remove."""
    chunks = line_chunks(docs)
    place = F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), "text_key", "no")
    # one group per digest and bytes: equal bytes are found by comparing them
    groups = chunks.groupBy("digest", "bytes").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    same = groups.groupBy("digest").agg(F.count("*").alias("texts"), F.min("first").alias("first"), F.max("last").alias("last")).where("first <> last")
    same = cut(same.select("digest", "texts", "first"), "chunks")
    columns = ["doc_id", "text_key", "start", "len"]
    places = chunks.select("doc_id", "text_key", "no", "start", "len", "digest").withColumn("part", F.pmod("text_key", F.lit(PARTS)).cast("int"))
    wanted = same.where("texts = 1").select("digest", "first", F.explode(F.array(*map(F.lit, range(PARTS)))).alias("part"))
    found = places.join(wanted, ["digest", "part"]).where(place != F.col("first")).select(*columns)
    shared = same.where("texts > 1").select("digest")
    if not shared.isEmpty():
        # different bytes with one digest: the first of each is found among its equals
        again = F.dense_rank().over(Window.partitionBy("digest", "bytes").orderBy(place))
        found = found.unionByName(chunks.join(shared, "digest").withColumn("again", again).where("again > 1").select(*columns))
    return found


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Documents without repeated multi-line chunks; n_lines and n_removed are of the input text."""
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    gone = repeated_chunks(docs).groupBy(F.col("doc_id").alias("g_id"), F.col("text_key").alias("g_key"))
    gone = gone.agg(F.flatten(F.collect_set(F.sequence("start", F.col("start") + F.col("len") - 1))).alias("g_lines"))
    d = docs.select(*keep).withColumn("g_text", F.xxhash64("text"))
    out = d.join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("g_text") == F.col("g_key")), "left")
    out = pinned(out.drop("g_id", "g_key", "g_text"), "g_split", F.split("text", "\n"))
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(1), F.size("g_split")), "g_lines"), lambda i: F.get("g_split", i - 1)), "\n")
    text = F.when(F.col("g_lines").isNull(), F.col("text")).otherwise(left)
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("g_split")).cast("long")
    removed = F.when(F.col("g_lines").isNull(), 0).otherwise(F.size("g_lines")).cast("long")
    return out.select(*[text.alias(c) if c == "text" else F.col(c) for c in keep], n.alias("n_lines"), removed.alias("n_removed"))
