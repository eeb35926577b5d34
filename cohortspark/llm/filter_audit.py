"""Audit of how filters interact, by forward and backward path counts over the subset lattice.

Every order of n filters is a path from the empty set to the full set in the lattice of filter
subsets; applying filter f after the set S is the edge (S, f). What an edge removes depends on
S alone, not on the order inside it, so n * 2^(n-1) edges hold the steps of all n! orders.

* Documents become bit masks of the filters they fail, counted by part, mask and loss flags. This
  is all that leaves a task; a part has 2^n masks at most.
* ``kept[S]`` counts masks disjoint from S; the edge (S, f) removes ``kept[S] - kept[S | f]``.
* Forward counts say how many orders reach S, backward counts how many leave it. An edge lies on
  ``forward[S] * backward[S | f]`` orders, which weighs its removals in the Shapley sum.
* Each step of each order reads its edge.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, inputs, stage

MOST_FILTERS = 8


def path_counts(n: int) -> tuple[list[int], list[int]]:
    """For every subset of ``n`` filters: orders that reach it, and orders that leave it."""
    full = (1 << n) - 1
    forward, backward = [0] * (full + 1), [0] * (full + 1)
    forward[0] = backward[full] = 1
    for state in range(1, full + 1):
        forward[state] = sum(forward[state ^ (1 << f)] for f in range(n) if state >> f & 1)
    for state in range(full - 1, -1, -1):
        backward[state] = sum(backward[state | (1 << f)] for f in range(n) if not state >> f & 1)
    return forward, backward


def _numbers(values: Sequence[int]) -> Column:
    return F.expr("array(" + ", ".join(f"{v}L" for v in values) + ")")


def audit_filters(rows: DataFrame, filters: Sequence[str], losses: Sequence[str] = (), part: str = "part") -> DataFrame:
    """One row per part, order of ``filters`` and step, counting what happens at that step.

    ``rows`` has a boolean column for each filter (true: fails; null counts as false) and for each loss.
    Filters have names of one letter, which spell ``filter_order``. Columns: ``part`` (null: empty
    string), ``filter_order``, ``step`` (from 1), ``kept`` after the step, ``removed`` by it,
    ``redundant`` (fails its filter, removed earlier), ``unique_fails`` (fails its filter
    only), one ``<loss>_lost`` per loss (removed by it, loss true) and ``shapley`` (removed by its filter,
    summed over all orders). Repeated rows count each; an empty table gives no rows.
    """
    n = len(filters)
    if not 0 < n <= MOST_FILTERS or len({*filters}) < n or any(len(f) != 1 for f in filters):
        raise ValueError(f"filters must be 1 to {MOST_FILTERS} different letters, not {list(filters)}")
    states, full = 1 << n, (1 << n) - 1
    forward, backward = path_counts(n)
    weights = [0 if s >> f & 1 else forward[s] * backward[s | 1 << f] for s in range(states) for f in range(n)]

    failed = [F.when(F.col(name), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, name in enumerate(filters)]
    flagged = rows.select(
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), sum(failed, F.lit(0)).alias("mask"),
        *[F.coalesce(F.col(loss), F.lit(False)).alias(f"loss{i}") for i, loss in enumerate(losses)],
    )
    flags = [f"loss{i}" for i in range(len(losses))]
    cells = flagged.groupBy("part", "mask", *flags).agg(F.count("*").alias("n"))
    counts = ["n", *[f"IF({flag}, n, 0L) AS {flag}" for flag in flags]]
    # At most 2^(filters + losses) cells a part, so the list is bounded.
    parts = cells.groupBy("part").agg(F.collect_list(F.expr(f"struct(mask, {', '.join(counts)})")).alias("cells"))
    for count in ("n", *flags):
        parts = parts.withColumn(
            f"kept_{count}",
            F.expr(
                f"transform(sequence(0, {full}), s ->"
                f" aggregate(cells, 0L, (sum, c) -> sum + IF(c.mask & s = 0, c.{count}, 0L)))"
            ),
        )
    edge = "s div {n} | shiftleft(1, s % {n})".format(n=n)
    removed = ", ".join(f"kept_{c}[s div {n}] - kept_{c}[{edge}] AS {c}" for c in ("n", *flags))
    edges = (
        parts.withColumn("edges", F.expr(f"transform(sequence(0, {n * states - 1}), s -> struct({removed}))"))
        .withColumn("weights", _numbers(weights))
        .withColumn(
            "shapley",
            F.expr(
                f"transform(sequence(0, {n - 1}), f -> aggregate(sequence(0, {full}), 0L,"
                f" (sum, s) -> sum + weights[s * {n} + f] * edges[s * {n} + f].n))"
            ),
        )
    )
    letters = "".join(filters)
    orders = ",".join("".join(p) for p in permutations(filters))
    before = " + ".join(f"IF(instr(filter_order, '{name}') < step, {1 << bit}, 0)" for bit, name in enumerate(filters))
    steps = (
        edges.withColumn("filter_order", F.explode(F.split(F.lit(orders), ",")))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
        .withColumn("state", F.expr(before))
        .withColumn("filter", F.expr(f"instr('{letters}', substring(filter_order, step, 1)) - 1"))
        .withColumn("edge", F.expr(f"edges[state * {n} + filter]"))
    )
    return steps.selectExpr(
        "part", "filter_order", "step",
        "kept_n[state] - edge.n AS kept", "edge.n AS removed",
        "kept_n[0] - kept_n[shiftleft(1, filter)] - edge.n AS redundant",
        f"kept_n[{full} ^ shiftleft(1, filter)] - kept_n[{full}] AS unique_fails",
        *[f"edge.loss{i} AS `{loss}_lost`" for i, loss in enumerate(losses)],
        "shapley[filter] AS shapley",
    )


def document_failures(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    quality: str = "quality", toxic: str = "toxic",
) -> DataFrame:
    """(doc_id, part, A, B, C, D, E, good, toxic) of every row of ``docs``: which filters it fails.

    A: under 50 words; B: distinct words under 65 % of words; C: over 5 % of the code points are A to Z;
    D: holds one of ``#$%&*|``; E: the text of a smaller id, by SHA-256. A null text counts as empty.
    A row without an id has no smaller id and no label; rows repeated under the least id do not fail
    E. ``good`` and ``toxic`` hold if any label row of the id says 1.
    Features are written once, narrow, and texts never move.
    """
    docs = inputs(docs, "documents", doc_id=doc_id, text=text, part=source)
    labels = inputs(labels, "labels", labelled=doc_id, quality=quality, toxic=toxic)
    rows = stage(
        docs.select("doc_id", "part", F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("words", F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)))
        .select(
            "doc_id", "part",
            (F.size("words") < 50).alias("A"),
            (100 * F.size(F.array_distinct("words")) < 65 * F.size("words")).alias("B"),
            (100 * F.regexp_count("text", F.lit("[A-Z]")) > 5 * F.length("text")).alias("C"),
            F.col("text").rlike(r"[#$%&*|]").alias("D"),
            F.unhex(F.sha2("text", 256)).alias("key"),
        )
    )
    named = rows.filter(F.col("doc_id").isNotNull())
    firsts = (
        named.groupBy(F.col("key").alias("first_key")).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .filter("first < last").select("first_key", "first")
    )
    marks = (
        labels.filter("labelled IS NOT NULL").groupBy("labelled")
        .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    )
    met = (
        named.join(marks, named.doc_id == marks.labelled, "left")
        .join(firsts, F.col("key") == F.col("first_key"), "left")
        .withColumn("E", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    )
    no = F.lit(False)
    alone = rows.filter(F.col("doc_id").isNull()).withColumns({"E": no, "good": no, "toxic": no})
    columns = ["doc_id", "part", "A", "B", "C", "D", "E", "good", "toxic"]
    return met.select(*columns).unionByName(alone.select(*columns))


def audit_sql() -> str:
    """The rows of the audit over views ``documents`` and ``labels``, as DuckDB SQL, order by order."""
    def states(letter):
        return f"instr(filter_order, '{letter}')"

    earlier = " OR ".join(f"(f{x} AND {states(x)} < step)" for x in "ABCDE")
    own = "CASE substr(filter_order, CAST(step AS BIGINT), 1) " + " ".join(f"WHEN '{x}' THEN f{x}" for x in "ABCDE") + " END"
    fails = " + ".join(f"CAST(f{x} AS INTEGER)" for x in "ABCDE")
    return rf"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM texts),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, len(w) < 50 AS fA, 100 * len(list_distinct(w)) < 65 * len(w) AS fB,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS fC,
    regexp_matches(t, '[#$%&*|]') AS fD, coalesce(d.doc_id > first, false) AS fE,
    coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM words d LEFT JOIN marks m ON d.doc_id = m.doc_id),
cells AS (SELECT part, fA, fB, fC, fD, fE, good, toxic, count(*) AS n FROM flags GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM orders),
met AS (
  SELECT *, {earlier} AS gone, {own} AS fails, {fails} = 1 AS alone FROM cells, steps),
counted AS (
  SELECT part, filter_order, step,
    CAST(coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (gone AND fails), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (fails AND alone), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(n) FILTER (NOT gone AND fails AND good), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(n) FILTER (NOT gone AND fails AND toxic), 0) AS BIGINT) AS toxic_lost
  FROM met GROUP BY ALL)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, substr(filter_order, CAST(step AS BIGINT), 1)) AS BIGINT) AS shapley
FROM counted"""
