"""SimHash near-duplicates by deletion-variant signatures.

Two 64-bit fingerprints that differ in at most two bits agree up to one bit in one of their
two 32-bit segments. So every distinct fingerprint is indexed under 33 variants of either
segment: the segment itself and the segment with one bit wiped out. An equality join on the variants
finds every pair, and the whole fingerprints verify it. Equal fingerprints are combined
before, so copies never meet each other.

A variant shared by more than ``pairs_up_to`` different fingerprints is not paired off.
Its members are indexed again, under what is left when two bits of the whole fingerprint are
wiped out, as far as that variant allows: fingerprints that agree there, four at most,
are links by construction. Both ways are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value, inputs, spare, stage, tidy
from .components import components

by_value(__name__)

BLOCK = 1 << 16


def majority(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set, lowest first."""
    total = np.zeros(64, np.int64)
    for start in range(0, len(hashes), BLOCK):
        octets = hashes[start : start + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: str | None, width: int, seed: int) -> int:
    """The unsigned fingerprint of a text's word shingles; 0 for a text without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < width:
        hashes = [xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        starts = [0, *ends[: len(words) - width]]
        hashes = [xxh64_intdigest(joined[s : e - 1], seed) for s, e in zip(starts, ends[width - 1 :])]
    votes = majority(np.array(hashes, np.uint64)) * 2 > len(hashes)
    return int.from_bytes(np.packbits(votes, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, bits) of every row; bits as a signed 64-bit integer."""
    docs = inputs(docs, "documents", doc_id=doc_id, text=text)

    def run(batches):
        for batch in batches:
            bits = [fingerprint(t.as_py(), width, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(bits, np.uint64).view(np.int64))], ["doc_id", "bits"]
            )

    return docs.select(docs.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, bits long")


def variants(points: DataFrame) -> DataFrame:
    """(key, bits): 33 variants of either segment; the key holds segment, bit and rest."""
    return (
        points.select("bits", F.explode(F.sequence(F.lit(0), F.lit(65))).alias("k"))
        .selectExpr(
            "bits", "k", "k % 33 AS wiped",
            "CASE WHEN k < 33 THEN shiftrightunsigned(bits, 32) ELSE bits & 4294967295L END AS part",
        )
        .selectExpr(
            "bits",
            "shiftleft(CAST(k AS BIGINT), 32) | (CASE WHEN wiped < 32 THEN part & ~shiftleft(1L, wiped) ELSE part END) AS key",
        )
    )


# Of two fingerprints under one key: within the distance, and, where a bit was wiped out,
# differing in it (else the whole segment is equal and its own key has the pair).
VERIFIED = (
    "bit_count(x ^ y) <= 2 AND (shiftright(key, 32) % 33 = 32 OR"
    " shiftrightunsigned(x ^ y, CAST(shiftright(key, 32) % 33 + 32 * (1 - shiftright(key, 32) div 33) AS INT)) & 1 = 1)"
)


def hub_links(crowded: DataFrame) -> DataFrame:
    """Links among the members of crowded keys, through keys with two bits wiped out.

    Where the crowded key wiped out bit ``j`` of its segment, the other bit is one of the other
    segment; where it is the whole segment, both bits are of the other one.
    """
    shaped = crowded.selectExpr(
        "bits", "CAST(shiftright(key, 32) AS INT) % 33 AS j", "CAST(shiftright(key, 32) AS INT) div 33 AS segment"
    ).selectExpr("bits", "j", "32 * (1 - segment) AS own", "32 * segment AS other")
    one = shaped.filter("j < 32").select(
        "bits", (F.col("j") + F.col("own")).alias("p"),
        F.explode(F.sequence(F.col("other"), F.col("other") + 31)).alias("q"),
    )
    two = (
        shaped.filter("j = 32")
        .select("bits", "other", F.explode(F.sequence(F.col("other"), F.col("other") + 30)).alias("p"))
        .select("bits", "p", F.explode(F.sequence(F.col("p") + 1, F.col("other") + 31)).alias("q"))
    )
    return (
        one.unionByName(two)
        .selectExpr("bits", "least(p, q) AS p", "greatest(p, q) AS q")
        .selectExpr("bits", "p", "q", "bits & ~(shiftleft(1L, p) | shiftleft(1L, q)) AS rest")
        .groupBy("rest", "p", "q").agg(F.collect_set("bits").alias("same"))
        .filter("size(same) > 1")
        .select(F.array_min("same").alias("x"), F.explode("same").alias("y")).filter("x <> y")
    )


def near_links(points: DataFrame, pairs_up_to: int = 64) -> DataFrame:
    """(x, y) links between distinct fingerprints; enough of them to connect all that link.

    The index moves once, to be counted by key; only members of shared keys are written.
    """
    members = stage(variants(points).withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1"))
    few = members.filter(F.col("n") <= pairs_up_to)
    paired = (
        few.select("key", F.col("bits").alias("x"))
        .join(few.select("key", F.col("bits").alias("y")), "key")
        .filter("x < y").filter(VERIFIED).select("x", "y")
    )
    return paired.unionByName(hub_links(members.filter(F.col("n") > pairs_up_to)))


def near_duplicates(
    docs: DataFrame,
    width: int = 3,
    seed: int = 42,
    pairs_up_to: int = 64,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, bits, component_id) of every row of ``docs``.

    Lower-cases A-Z and takes shingles of ``width`` words; bit i is set if it is in more than half of
    the shingles' XXH64 values. Texts null, empty or of white space have fingerprint 0 and
    link as such. ``component_id`` is the least id reachable over links of at most two
    differing bits; null ids never name a component (it is null if no member has an id).
    Rows repeated are rows of one group; an empty table gives no rows.
    """
    rows = stage(fingerprints(docs, width, seed, doc_id, text))
    points = stage(rows.groupBy("bits").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")))
    roots = components(near_links(points, pairs_up_to), "x", "y")
    linked = points.join(roots, points.bits == roots.node).select("bits", "root", "least")
    named = linked.join(linked.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("bits", "component_id")
    # Only fingerprints that a group shares need a look-up; the others name themselves.
    shared = (
        points.join(named, "bits", "left")
        .filter((F.col("rows") > 1) | F.col("component_id").isNotNull())
        .select("bits", F.coalesce("component_id", "least").alias("component_id"), F.lit(True).alias("found"))
    )
    return rows.join(shared, "bits", "left").select(
        "doc_id", "bits", F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def keep_one_of_each(
    docs: DataFrame, width: int = 3, seed: int = 42, pairs_up_to: int = 64, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: one of the least id.

    Of rows repeated under that id those in the group count, and of these the one of the least text hash stays; rows of
    one id in different groups each stand for their own. Rows without an id belong to no row that
    could be named and stay all. Only rows of repeated ids are fingerprinted again.
    """
    found = near_duplicates(docs, width, seed, pairs_up_to, doc_id, text).filter("doc_id IS NOT NULL")
    kept_id, own, many = spare(docs, "kept_id", "own", "many")
    stands = F.col("doc_id") == F.col("component_id")
    # Most documents stand alone under their id, so only the other ids are looked up.
    others = stage(
        found.groupBy(F.col("doc_id").alias(kept_id)).agg(F.count("*").alias("rows"), F.max(stands).alias(many))
        .filter((F.col("rows") > 1) | ~F.col(many)).select(kept_id, many)
    )
    met = docs.join(others, docs[doc_id].cast("long") == others[kept_id], "left")
    single = met.filter(F.col(kept_id).isNull()).select(*docs.columns)
    again = with_fingerprint(met.filter(F.col(many)).drop(many), text, width, seed, own)
    winners = found.filter(stands).select(F.col("doc_id").alias(kept_id), F.col("bits").alias(own)).distinct()
    again = again.join(winners, [kept_id, own], "left_semi")
    row = F.struct(*[again[c] for c in docs.columns])
    one = (
        again.groupBy(kept_id, own).agg(F.min_by(row, F.struct(F.xxhash64(text), F.col(text))).alias(many)).select(f"{many}.*")
    )
    return single.unionByName(one)


def with_fingerprint(docs: DataFrame, text: str, width: int, seed: int, out: str) -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as the last column, a signed 64-bit integer."""
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            bits = np.array([fingerprint(t.as_py(), width, seed) for t in batch.column(at)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits)], [*batch.schema.names, out])

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())]))
