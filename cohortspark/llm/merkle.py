"""A Merkle manifest of a dataset, by rolling nested structs up over rank digits.

Leaves are ranked inside their group and cut into blocks of ``fan ** DIGITS`` consecutive ranks. One exchange
brings a block's leaves together; then its rank digits, lowest first, are grouped away one after
another, each time nesting the child structs in order and hashing them. Groupings by fewer and fewer
digits need no further exchange. A block's hash is a leaf of the next round, so
blocks of any table stay bounded; the rounds end when each group has one node, its subroot. The
subroots, ranked by group, are rolled up likewise to the root.

Proofs run the other way: a transform over the nested structs gives every child the hashes left and
right of its ancestors, an explode emits the children, and where a child is a block of the round
below, the two rows of that block are grouped together. No join takes part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .common import inputs, stage

# Digits of a block's ranks: 8 ** 3 leaves a block.
DIGITS = 3
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def framed(value: Column) -> Column:
    """A value with its UTF-8 length before it, so that joined fields stay apart; ``-`` for null."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def record_hash(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[framed(c) for c in columns]), 256)


def ranked(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` (staged) with ``rank`` from 0 inside ``group`` by ``order``, and the group's ``size``.

    Null groups are a group and null keys come first. The second result is the largest size. Rows alike in group and order are ranked as one row of
    so many copies and expanded after, so no task sorts more than a range of different rows.
    """
    keys = [group, *order]
    others = [c for c in rows.columns if c not in keys]
    merged = rows.groupBy(*keys).agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in others])
    dealt = stage(
        merged.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys]).withColumn("range", F.spark_partition_id())
    )
    # One row per range and group: ranges follow each other, so earlier ones of a group come before.
    counts = stage(dealt.groupBy(group, "range").agg(F.sum("copies").alias("here")))
    whole = Window.partitionBy(group)
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets, _ = settle(
        counts.select(
            F.col(group).alias("in_group"), F.col("range").alias("in_range"),
            F.coalesce(F.sum("here").over(before), F.lit(0)).alias("offset"), F.sum("here").over(whole).alias("size"),
        )
    )
    inside = Window.partitionBy(group, "range").orderBy(*[F.col(k).asc_nulls_first() for k in order])
    local = dealt.withColumn(
        "place", F.sum("copies").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("copies")
    )
    met = local.join(offsets, local[group].eqNullSafe(offsets.in_group) & (local["range"] == offsets.in_range))
    out = met.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).select(
        *rows.columns, (F.col("offset") + F.col("place") + F.col("copy")).alias("rank"), "size"
    )
    return out, offsets.agg(F.max("size")).first()[0] or 0


def levels_of(size: int, fan: int) -> int:
    """How often runs of ``fan`` must be hashed until one node of ``size`` is left."""
    count = 0
    while size > 1:
        size, count = -(-size // fan), count + 1
    return count


def levels(size: Column, largest: int, fan: int) -> Column:
    """``levels_of`` as a column: every power of ``fan`` below the size is one level."""
    powers = [fan**k for k in range(levels_of(largest, fan))]
    return sum([(size > F.lit(p)).cast("int") for p in powers], F.lit(0))


def roll_up(nodes: DataFrame, payload: list[str], fan: int) -> DataFrame:
    """Blocks (group, block, height, above, hash, nodes) of ``nodes`` (group, rank, levels, hash, *payload).

    Of the ``levels`` still to be hashed a block takes ``DIGITS`` at most and leaves ``above``. Over
    them a node is its only child unchanged.
    """
    digits = [f"d{k}" for k in range(DIGITS)]
    rows = nodes.select(
        "group", F.floor(F.col("rank") / fan**DIGITS).cast("long").alias("block"),
        F.least(F.col("levels"), F.lit(DIGITS)).alias("height"), F.greatest(F.col("levels") - DIGITS, F.lit(0)).alias("above"),
        *[(F.floor(F.col("rank") / fan**k) % fan).cast("int").alias(d) for k, d in enumerate(digits)],
        "hash", (F.struct(*payload) if payload else F.struct(F.lit(0))).alias("nodes"),
    ).repartition("group", "block")
    for level, digit in enumerate(digits):
        rows = rows.groupBy("group", "block", "height", "above", *reversed(digits[level + 1 :])).agg(
            F.sort_array(F.collect_list(F.struct(digit, "hash", "nodes"))).alias("nodes")
        ).withColumn(
            "hash", F.when(F.col("height") > level, F.sha2(joined(F.col("nodes")), 256)).otherwise(F.col("nodes")[0]["hash"])
        )
    return rows


def joined(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda n: n["hash"]), "")


def grow(nodes: DataFrame, payload: list[str], largest: int, fan: int) -> list[DataFrame]:
    """The rounds over ``nodes``, lowest first; in the last one every group is one block."""
    rounds = [stage(roll_up(nodes, payload, fan))]
    while largest > fan**DIGITS:
        largest = -(-largest // fan**DIGITS)
        below = rounds[-1].select("group", F.col("block").alias("rank"), F.col("above").alias("levels"), "hash")
        rounds.append(stage(roll_up(below, [], fan)))
    return rounds


def beside(nodes: Column, at: Column) -> Column:
    """The hashes left and right of a node in its run."""
    return F.struct(
        joined(F.slice(nodes, F.lit(1), at)).alias("left"), joined(F.slice(nodes, at + 2, F.size(nodes))).alias("right")
    )


def children(blocks: DataFrame, carried: list[str], fan: int) -> DataFrame:
    """(group, rank, hash, payload, path, *carried) of every child of ``blocks``, by transform and explode.

    ``blocks`` has ``path``, the steps from the block's hash upwards; a child's path begins with its own.
    """
    top = F.col("nodes")

    def child(n0, i0, n1, i1, n2, i2):
        steps = F.array(beside(n1["nodes"], i0), beside(n2["nodes"], i1), beside(top, i2))
        return F.struct(
            (((F.col("block") * fan + i2) * fan + i1) * fan + i0).cast("long").alias("rank"),
            n0["hash"].alias("hash"), n0["nodes"].alias("payload"),
            F.concat(F.slice(steps, F.lit(1), F.col("height")), F.col("path")).alias("path"),
        )

    def of_second(n2, i2):
        return F.flatten(F.transform(n2["nodes"], lambda n1, i1: F.transform(
            n1["nodes"], lambda n0, i0: child(n0, i0, n1, i1, n2, i2)
        )))

    every = F.flatten(F.transform(top, of_second))
    return blocks.select("group", F.explode(every).alias("child"), *carried).select("group", "child.*", *carried)


def descend(rounds: list[DataFrame], tops: DataFrame, carried: list[str], fan: int) -> DataFrame:
    """Children of the lowest round with their paths; ``tops`` (group, path, *carried) stand above the last round."""
    found = tops.withColumn("rank", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        inside = blocks.select("group", "block", F.struct("height", "nodes").alias("inside"))
        over = found.select("group", F.col("rank").alias("block"), F.struct("path", *carried).alias("over"))
        # Two rows of each block meet here: what it nests, and what lies above it.
        met = inside.unionByName(over, allowMissingColumns=True).groupBy("group", "block").agg(
            F.collect_list("inside")[0].alias("inside"), F.collect_list("over")[0].alias("over")
        )
        found = children(met.select("group", "block", "inside.*", "over.*"), carried, fan)
    return found


def merkle_proofs(leaves: DataFrame, order: list[str], group: str = "group", fan: int = 8) -> DataFrame:
    """``leaves`` (``group``, ``leaf``, the columns of ``order`` and any others) with ``path``, ``subroot`` and ``root``.

    Inside a group leaves ascend by ``order``, nulls first; while several nodes remain, every ``fan`` consecutive
    ones (the last run may be shorter, even one) become the hash of their joined hashes. The last is the
    group's ``subroot``; subroots ascending by group, null first, give ``root`` likewise.
    ``path`` lists, from the leaf up to the root, the joined hashes ``left`` and ``right`` of the node
    in its run. Rows alike have proofs of their own, at neighbouring places; an empty table gives no rows.
    """
    kept = [c for c in leaves.columns if c not in (group, "leaf")]
    rows = stage(leaves.select(F.col(group).alias("group"), F.col("leaf").alias("hash"), *kept))
    placed, largest = ranked(rows, "group", [*order, "hash"])
    nodes = placed.withColumn("levels", levels(F.col("size"), largest, fan))
    rounds = grow(nodes, kept, largest, fan)
    subroots = stage(rounds[-1].select(F.lit(0).alias("group"), F.col("group").alias("name"), "hash"))
    numbered, groups = ranked(subroots, "group", ["name"])
    upper = grow(numbered.withColumn("levels", levels(F.col("size"), groups, fan)), ["name"], groups, fan)
    nothing = F.expr("CAST(array() AS array<struct<left: string, right: string>>)")
    start = upper[-1].select("group", F.col("hash").alias("root"), nothing.alias("path"))
    tops = descend(upper, start, ["root"], fan).select(F.col("payload.name").alias("group"), F.col("hash").alias("subroot"), "path", "root")
    found = descend(rounds, tops, ["subroot", "root"], fan)
    return found.select(
        F.col("group").alias(group), F.col("hash").alias("leaf"), *[F.col(f"payload.{c}").alias(c) for c in kept], "path", "subroot", "root"
    )


def folded(path: Column, leaf: Column) -> Column:
    """The root that ``leaf`` leads to along ``path``."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def proof_hash(path: Column) -> Column:
    """One hash of all siblings, from the leaf upwards and left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def audit_manifest(docs: DataFrame, tampered: Column, fan: int = 8) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of ``docs``.

    A leaf hashes doc_id, source, lang, n_chars and text. Groups are values of ``lang`` (null is one); leaves
    ascend by doc_id, then by hash; null ids come first. Where ``tampered`` holds (null counts as not)
    the text is checked with its capitals A to Z lowered, so ``verified`` is false unless it
    has none. Other columns of ``docs`` play no part.
    """
    docs = inputs(docs, "documents", doc_id="doc_id", source="source", lang="lang", n_chars="n_chars", text="text")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = record_hash([*fields, F.col("text")])
    lowered = record_hash([*fields, F.translate("text", CAPITALS, CAPITALS.lower())])
    leaves = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "lang", leaf.alias("leaf"), F.when(tampered, lowered).alias("other"),
    )
    proofs = merkle_proofs(leaves, ["doc_id"], "lang", fan)
    checked = folded(F.col("path"), F.coalesce("other", "leaf"))
    return proofs.select(
        "doc_id", "leaf", "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"), checked.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest_sql(fan: int = 8, levels_up_to: int = 9, groups_up_to: int = 3) -> str:
    """The rows of ``audit_manifest`` over a view ``documents`` as DuckDB SQL, one query level per tree level.

    Crc32 is folded bit by bit. Ties of doc_id go by leaf.
    """
    def field(c):
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

    fields = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    bits = "flatten([[if(b = 0, ascii(CAST(doc_id AS VARCHAR)[p]), 0) for b in range(8)] for p in range(1, length(CAST(doc_id AS VARCHAR)) + 1)])"
    step = "xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)"
    crc = f"xor(list_reduce(list_prepend(4294967295, {bits}), lambda a, x: {step}), 4294967295)"
    parts = [f"""
WITH leaves AS (
  SELECT doc_id, lang, sha256({fields} || {field('text')}) AS leaf,
    CASE WHEN coalesce({crc} % 3 = 0, false)
      THEN sha256({fields} || {field(f"translate(text, '{CAPITALS}', '{CAPITALS.lower()}')")}) END AS other
  FROM documents),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
g0 AS (SELECT lang AS g, place AS i, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM ranked)"""]

    def climb(name, depth):
        for k in range(depth):
            run = f"(PARTITION BY g, i // {fan} ORDER BY i ROWS BETWEEN"
            parts.append(
                f"{name}s{k} AS (SELECT g, i, n, coalesce(string_agg(h, '') OVER {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,"
                f" coalesce(string_agg(h, '') OVER {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})"
            )
            parts.append(
                f"{name}{k + 1} AS (SELECT g, i // {fan} AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h,"
                f" (any_value(n) + {fan - 1}) // {fan} AS n FROM {name}{k} GROUP BY g, i // {fan})"
            )

    climb("g", levels_up_to)
    parts.append(
        f"t0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, h, count(*) OVER () AS n, g AS lang FROM g{levels_up_to})"
    )
    climb("t", groups_up_to)
    parts.append(
        f"walk0 AS (SELECT r.*, t.i AS lang_place, t.h AS subroot, top.h AS root, leaf AS f0, coalesce(other, leaf) AS x0, '' AS p0"
        f" FROM ranked r JOIN t0 t ON r.lang IS NOT DISTINCT FROM t.lang JOIN t{groups_up_to} top ON top.g = t.g)"
    )
    steps = [("g", k, "w.lang", "w.place") for k in range(levels_up_to)] + [("t", k, "0", "w.lang_place") for k in range(groups_up_to)]
    for number, (name, k, group, place) in enumerate(steps):
        parts.append(
            f"walk{number + 1} AS (SELECT w.* EXCLUDE (x0, p0), CASE WHEN s.n > 1 THEN sha256(s.l || w.x0 || s.r) ELSE w.x0 END AS x0,"
            f" CASE WHEN s.n > 1 THEN w.p0 || s.l || s.r ELSE w.p0 END AS p0 FROM walk{number} w JOIN {name}s{k} s"
            f" ON s.g IS NOT DISTINCT FROM {group} AND s.i = {place} // {fan ** k})"
        )
    last = f"walk{len(steps)}"
    return ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, root, sha256(p0) AS proof_sha256, x0 AS folded_root, x0 = root AS verified FROM {last}"""
