"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions.

Sizes, not texts, are moved. Documents get a seeded order inside (source, shard), which lays
their words end to end; the line is cut into blocks of ``block`` words. The mix's blocks are
dealt to sources, and each source's to its shards, by the highest quotients
``target / (2 * blocks + 1)``. A shard takes all its words as often as its quota allows, and
the first of the order once more for the rest: in a seeded order that is a seeded choice,
and it takes nearly all documents whole.

The highest quotients are found without listing one per block. With divisor ``d`` a party
of target v wins ``floor(v / d + 1/2)`` blocks, and the sum over n parties is off by n / 2 at
most, so the divisors for n / 2 blocks more and fewer bracket the right one. Only the
quotients between them, about two a party, are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import null_safe
from .common import WORD, inputs, spare, stage

SEED = "mix"
SPACE = r"[\x20\x09-\x0D]*"


def word_count(text: str):
    """Number of words, by the runs that begin in a text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def digits(key, start: int):
    """Eight hex digits of a digest as a number; the same in any SQL dialect with md5."""
    return F.conv(F.substring(key, start, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``: shares of the total by weight.

    Sources by code point, null last, take the weights in turn. No target exceeds ``most`` times its
    source's size; what is over goes to the others by weight. All below the level where
    this ends keep ``weight * level``; it is found by one pass over sources in order of cap per
    weight. One row per source moves here, and no more.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    full = sizes.withColumn("place", F.row_number().over(order) - 1).select(
        "source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap")
    )
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    )
    tried = full.withColumn("level", level).withColumn(
        "fits", F.when(F.col("cap") >= F.col("weight") * F.col("level"), F.col("level"))
    )
    found = tried.withColumn("final", F.max("fits").over(everything))
    return found.select(
        "source", "source_size", F.least("cap", F.coalesce(F.col("weight") * F.col("final"), F.col("cap"))).alias("target")
    )


def apportion(parties: DataFrame, groups: list[str], party: list[str], value: str, seats: str) -> DataFrame:
    """``parties`` with ``won``: ``seats`` of each group dealt by the highest quotients.

    ``seats`` is constant in a group, ``value`` at least zero; ties go to the party first in
    order. A group whose values are all zero wins nothing.
    """
    group = Window.partitionBy(*groups)
    n, total = F.count("*").over(group), F.sum(value).over(group)
    v, s = F.col(value), F.col(seats)
    half = F.col("__n") / 2 + 1
    # Blocks won under the divisors for half a block a party fewer and more.
    fewer = F.when(s > half, F.floor(v * (s - half) / F.col("__total") + 0.5)).otherwise(F.lit(0))
    more = F.floor(v * (s + half) / F.col("__total") + 0.5)
    bounds = (
        parties.withColumn("__n", n).withColumn("__total", total)
        .withColumn("__sure", F.when(F.col("__total") > 0, fewer).otherwise(0).cast("long"))
        .withColumn("__open", F.when(F.col("__total") > 0, more).otherwise(0).cast("long"))
    )
    ranked = Window.partitionBy(*groups).orderBy(F.desc("__quotient"), *[F.col(p).asc_nulls_last() for p in party])
    contested = (
        bounds.withColumn("__left", s - F.sum("__sure").over(group))
        .withColumn("__q", F.explode_outer(F.when(F.col("__open") > F.col("__sure"), F.sequence("__sure", F.col("__open") - 1))))
        .withColumn("__quotient", F.col(value) / (2 * F.col("__q") + 1))
        .withColumn("__rank", F.when(F.col("__q").isNotNull(), F.row_number().over(ranked)))
        .withColumn("__win", F.coalesce((F.col("__rank") <= F.col("__left")).cast("long"), F.lit(0)))
    )
    keys = [*groups, *party]
    kept = [c for c in parties.columns if c not in keys]
    return contested.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in kept], (F.first("__sure") + F.sum("__win")).alias("won")
    )


def measured(docs: DataFrame, seed: str, *kept: str) -> DataFrame:
    """(source, size, key, *kept) of (doc_id, source, text): the key seeds a row's shard and place.

    It is made of the id and the text, so only rows alike in both share one.
    """
    whole = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")))))
    return docs.select(*kept, "source", word_count("text").alias("size"), whole.alias("key"))


def quota_cells(lines: DataFrame, weights, most: float, block: int, shard_words: int) -> tuple[DataFrame, DataFrame]:
    """(lines with ``shard``, cells) for (doc_id, source, size, key, copies).

    Cells (source, shard) say how often the mix takes all their words (``each``), how many words
    more (``once_more``), and by ``cut`` and ``cut_start`` at which row of the cell's line these end.
    """
    own = stage(lines.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("words")))
    total = own.agg(F.sum("words")).first()[0] or 0
    shards = own.select(F.col("source").alias("of"), F.greatest(F.lit(1), F.ceil(F.col("words") / shard_words)).alias("shards"))
    placed = lines.join(shards, lines.source.eqNullSafe(shards["of"])).withColumn("shard", digits(F.col("key"), 1) % F.col("shards")).drop("of", "shards")
    cells = placed.groupBy("source", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("cell_size"))
    sources = targets(own.withColumnRenamed("words", "source_size"), weights, most)
    blocks = F.lit((2 * total + block) // (2 * block))
    shares = apportion(
        sources.withColumn("__all", F.lit(0)).withColumn("__seats", blocks), ["__all"], ["source"], "target", "__seats"
    ).select(F.col("source").alias("of"), "source_size", "target", F.col("won").alias("__seats"))
    dealt = apportion(cells.join(shares, cells.source.eqNullSafe(shares["of"])).drop("of"), ["source"], ["shard"], "cell_size", "__seats")
    words = F.least(F.col("won") * block, F.floor(F.col("cell_size") * most))
    quotas = stage(dealt.select(
        F.col("source").alias("of"), F.col("shard").alias("of_shard"), "source_size", "target",
        F.when(F.col("cell_size") > 0, F.floor(words / F.col("cell_size"))).otherwise(0).alias("each"),
        F.when(F.col("cell_size") > 0, words % F.col("cell_size")).otherwise(0).cast("long").alias("once_more"),
    ))
    line = Window.partitionBy("source", "shard").orderBy(F.substring("key", 9, 24))
    laid = placed.withColumn("end", F.sum(F.col("size") * F.col("copies")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    ends = F.col("end") - F.col("size") * F.col("copies")
    laid = stage(laid.select(*placed.columns, ends.alias("start")))
    met = laid.join(quotas, laid.source.eqNullSafe(quotas["of"]) & (laid.shard == quotas["of_shard"]))
    cut = met.filter("start <= once_more AND once_more < start + size * copies").select(
        F.col("of").alias("cut_of"), F.col("of_shard").alias("cut_shard"), F.col("key").alias("cut"),
        F.col("start").alias("cut_start"), F.col("copies").alias("cut_copies"),
    )
    return met, quotas.join(cut, F.col("of").eqNullSafe(F.col("cut_of")) & (F.col("of_shard") == F.col("cut_shard")), "left").drop("cut_of", "cut_shard")


def taken_at(start: Column) -> Column:
    """Words taken of a row whose words begin at ``start`` of its cell's line."""
    extra = F.least(F.col("size"), F.greatest(F.lit(0), F.col("once_more") - start))
    return (F.col("size") * F.col("each") + extra).cast("long")


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    most: float = 3.0,
    block: int = 1,
    shard_words: int = 1 << 22,
    seed: str = SEED,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row of ``docs``.

    ``size`` counts words (0 for a null text) and ``taken`` the words the mix takes, repeats counted:
    never more than ``most`` times the size. With a ``block`` of one word a source's words are its rounded
    target; longer blocks round it to whole blocks. A source has a shard for every ``shard_words`` of its own words, so other sources
    change nothing for it. A null source is a source of its own. Rows without words take none. Rows alike in id, source and
    text are laid one after the other, counted once; which of them takes more is open, as they are
    alike. An empty table gives no rows. The same rows give the same mix in any layout.
    """
    rows = inputs(docs, "documents", doc_id=doc_id, text=text, source=source)
    lines = stage(measured(rows, seed, "doc_id").groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("copies")))
    met, _ = quota_cells(lines, weights, most, block, shard_words)
    copies = met.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return copies.select(
        "doc_id", "source", "size", "source_size", "target", taken_at(F.col("start") + F.col("copy") * F.col("size")).alias("taken")
    )


def numbered(rows: DataFrame, groups: list[str], out: str) -> DataFrame:
    """``rows`` numbered from 0 inside ``groups`` in any order, by counts per written part."""
    part, before, n = spare(rows, "part", "before", "n")
    rows = stage(rows.withColumn(part, F.spark_partition_id()))
    line = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*groups, part).agg(F.count("*").alias(n)).withColumn(before, F.coalesce(F.sum(n).over(line), F.lit(0))).drop(n)
    local = rows.withColumn(out, F.row_number().over(Window.partitionBy(*groups, part).orderBy(F.lit(0))) - 1)
    return null_safe(local, offsets, [*groups, part]).withColumn(out, F.col(out) + F.col(before)).drop(part, before)


def take_words(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    most: float = 3.0,
    block: int = 1,
    shard_words: int = 1 << 22,
    seed: str = SEED,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The mix itself: ``docs`` with each row as often as the mix takes it.

    A row taken ``k`` times whole comes ``k`` times; a remainder comes as one more row
    of the first words of its text, with ``n_chars`` (if there) following. Rows that the mix does not
    take go. Texts stay where they are read: a row finds its words from its key and its cell's quota. Only rows alike in id and
    text that a quota cuts among are written, to be numbered.
    """
    names = docs.columns
    rows = inputs(docs, "documents", doc_id=doc_id, text=text, source=source)
    lines = stage(measured(rows, seed, "doc_id").groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("copies")))
    _, cells = quota_cells(lines, weights, most, block, shard_words)
    # Number of shards by the sources' own words, as in quota_cells; empty cells have no row.
    shards = lines.groupBy(F.col("source").alias("in_source")).agg(F.greatest(F.lit(1), F.ceil(F.sum(F.col("size") * F.col("copies")) / shard_words)).alias("shards"))
    whole = docs.select(F.struct(*names).alias("row"), docs[doc_id].alias("doc_id"), docs[text].alias("text"), docs[source].alias("source"))
    sized = measured(whole, seed, "row").filter("size > 0")
    shards, cells = stage(shards), stage(cells)
    at = sized.join(shards, sized.source.eqNullSafe(shards.in_source)).withColumn("shard", digits(F.col("key"), 1) % F.col("shards"))
    met = at.join(cells, at.source.eqNullSafe(cells["of"]) & (at.shard == cells.of_shard))
    place, cut = F.substring("key", 9, 24), F.substring("cut", 9, 24)
    split = F.coalesce((F.col("key") == F.col("cut")) & (F.col("cut_copies") > 1), F.lit(False))
    extra = F.when(place < cut, F.col("size")).when(place == cut, F.col("once_more") - F.col("cut_start")).otherwise(0)
    plain = met.filter(~split).withColumn("taken", (F.col("size") * F.col("each") + extra).cast("long"))
    alike = numbered(met.filter(split), ["source", "shard"], "number")
    alike = alike.withColumn("taken", taken_at(F.col("cut_start") + F.col("number") * F.col("size")))
    found = plain.select("row", "size", "taken").unionByName(alike.select("row", "size", "taken")).filter("taken > 0")
    copies = found.withColumn("times", F.floor(F.col("taken") / F.col("size")).cast("int")).withColumn("rest", (F.col("taken") % F.col("size")).cast("int"))
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times") + (F.col("rest") > 0).cast("int"))))
    part, words = F.col("copy") > F.col("times"), F.col("row")[text]
    begun = F.array_join(F.slice(F.regexp_extract_all(words, F.lit(f"({SPACE}{WORD})"), F.lit(1)), F.lit(1), F.col("rest")), "")
    new = {text: F.when(part, begun).otherwise(words)}
    if "n_chars" in names:
        new["n_chars"] = F.when(part, F.length(begun)).otherwise(F.col("row")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return copies.select(*[new.get(c, F.col("row")[c]).alias(c) for c in names])


def mixing_sql(weights=(5.0, 2.0, 1.0), most=3.0, block=1, shard_words=1 << 22, seed=SEED) -> str:
    """The rows of ``mix_sources`` over a view ``documents``, as DuckDB SQL.

    Unlike the DataFrame form it lists every quotient that could win.
    """

    def apportioned(name, parties, group, order, value, seats):
        return f"""
{name}_q AS (
  SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY quotient DESC, {order} NULLS LAST) AS rank FROM (
    SELECT *, {value} / (2 * unnest(generate_series(0, CAST(floor({value} * ({seats} + parties / 2 + 1) / nullif(total, 0) + 0.5) AS BIGINT))) + 1) AS quotient
    FROM (SELECT *, count(*) OVER (PARTITION BY {group}) AS parties, sum({value}) OVER (PARTITION BY {group}) AS total FROM {parties}))),
{name} AS (
  SELECT p.*, coalesce(w.won, 0) AS won FROM {parties} p LEFT JOIN (
    SELECT {group} AS g, {order} AS o, count(*) AS won FROM {name}_q WHERE rank <= {seats} AND quotient > 0 GROUP BY ALL) w
  ON p.{group} IS NOT DISTINCT FROM w.g AND p.{order} IS NOT DISTINCT FROM w.o)"""

    weight = "list_value(" + ", ".join(f"{float(w)}::DOUBLE" for w in weights) + f")[CAST((place % {len(weights)}) + 1 AS BIGINT)]"
    return rf"""
WITH measured AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM measured GROUP BY source),
everything AS (SELECT CAST(coalesce(sum(source_size), 0) AS BIGINT) AS words FROM sizes),
dealt AS (
  SELECT doc_id, m.source, size, CAST(('0x' || k[1:8]) AS BIGINT) % greatest(1, (source_size + {shard_words - 1}) // {shard_words}) AS shard, k[9:32] AS spot
  FROM measured m JOIN sizes s ON m.source IS NOT DISTINCT FROM s.source),
cells AS (SELECT source, shard, CAST(sum(size) AS BIGINT) AS cell_size FROM dealt GROUP BY ALL),
placed_sources AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sizes),
weighted AS (SELECT source, source_size, {weight} AS weight, source_size * {float(most)}::DOUBLE AS cap FROM placed_sources),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighted WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final_level AS (SELECT max(level) AS final FROM levels WHERE cap >= weight * level),
goals AS (
  SELECT source, source_size, least(cap, coalesce(weight * final, cap)) AS target, 0 AS everyone,
    (2 * words + {block}) // {2 * block} AS seats
  FROM levels, final_level, everything),{apportioned("shares", "goals", "everyone", "source", "target", "seats")},
cell_goals AS (
  SELECT c.source, c.shard, c.cell_size, s.source_size, s.target, s.won AS seats, CAST(c.cell_size AS DOUBLE) AS v
  FROM cells c JOIN shares s ON c.source IS NOT DISTINCT FROM s.source),{apportioned("quotas", "cell_goals", "source", "shard", "v", "seats")},
goal AS (SELECT *, least(won * {block}, CAST(floor(cell_size * {float(most)}) AS BIGINT)) AS quota FROM quotas),
line AS (
  SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY spot ROWS UNBOUNDED PRECEDING) - size AS start FROM dealt)
SELECT l.doc_id, l.size, g.source_size, g.target,
  CAST(CASE WHEN cell_size = 0 THEN 0 ELSE l.size * (quota // cell_size) + least(l.size, greatest(0, quota % cell_size - start)) END AS BIGINT) AS taken
FROM line l JOIN goal g ON l.source IS NOT DISTINCT FROM g.source AND l.shard = g.shard"""
