"""Exact order statistics without sorting a table in one task.

``running_sums``  cumulative sums along a value, for every distinct value.
``cut_rows``      the k-th row of a keyed order, found by narrowing histograms.
``quantiles``     exact interpolated quantiles per group.

All three cut the value range into buckets first. Bucket edges only decide how
evenly work spreads; the counts per bucket make the result exact for any edges.
Expressions are SQL text: one parse in the JVM instead of a call per operator.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import null_safe, settle, stage

# Rows a single in-bucket sort may hold before another narrowing pass is made.
BUCKET_ROWS = 2_000_000


# Accuracy of the sketches that place bucket edges, and how many are merged at last.
EDGE_ACCURACY = 10_000
EDGE_GROUPS = 64


def q(name: str) -> str:
    """Backquoted column name."""
    return f"`{name}`"


def text(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def qs(names: Sequence[str]) -> list[str]:
    return [q(n) for n in names]


def _over(by: Sequence[str], order: str = "", frame: str = "") -> str:
    part = f"PARTITION BY {', '.join(qs(by))}" if by else ""
    rows = {
        "before": "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING",
        "upto": "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW",
        "": "",
    }[frame]
    return f"OVER ({part} {f'ORDER BY {order}' if order else ''} {rows})"


def range_edges(df: DataFrame, value: str, buckets: int) -> list[float]:
    """Edges that spread the rows of ``value`` over about ``buckets`` ranges."""
    probs = ", ".join(f"{i / buckets:.8f}D" for i in range(1, buckets))
    sketch = f"percentile_approx({{}}, array({probs}), {EDGE_ACCURACY})"
    # Edges only spread the work: sketches of bounded size, merged in two levels.
    groups = df.groupBy(F.expr(f"spark_partition_id() % {EDGE_GROUPS}")).agg(
        F.expr(f"{sketch.format(f'CAST({q(value)} AS DOUBLE)')} AS e")
    )
    found = groups.selectExpr("explode(e) AS e").selectExpr(f"{sketch.format('e')} AS e").first()["e"]
    inner = sorted({float(e) for e in found or [] if math.isfinite(e)})
    return [-math.inf, *(inner or [0.0]), math.inf]


def default_buckets(df: DataFrame) -> int:
    return 4 * max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def running_sums(
    df: DataFrame,
    value: str,
    measures: dict[str, str],
    by: Sequence[str] = (),
    descending: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """One row per (``by``, distinct ``value``) with each measure's sum, the sum
    over strictly earlier values (``*_before``) and over the group (``*_total``).

    ``measures`` maps names to SQL expressions. Equal values are combined before
    any shuffle, so a value held by a third of the rows is one row by the time it
    moves. The combined rows are written once; edges, the sums per bucket and the sums
    inside each bucket all come from them. Null and NaN values are left out.
    """
    by, names = list(by), list(measures)
    v = q(value)
    rows = df.where(f"{v} IS NOT NULL AND NOT isnan(CAST({v} AS DOUBLE))")
    summed = stage(rows.groupBy(*by, value).agg(*[F.expr(f"sum({e}) AS {q(m)}") for m, e in measures.items()]))
    edges = range_edges(summed, value, buckets or default_buckets(df))
    bucketizer = Bucketizer(splits=edges, inputCol="__v", outputCol="__b")

    def placed(df: DataFrame, *columns: str) -> DataFrame:
        with_value = df.selectExpr("*", f"CAST({v} AS DOUBLE) AS __v")
        return bucketizer.transform(with_value).selectExpr(*columns, "CAST(__b AS INT) AS __bucket")

    way = "DESC" if descending else "ASC"
    ahead = _over(by, f"__bucket {way}", "before")
    per_bucket = (
        placed(summed, *qs(by), *[f"{q(m)} AS {q('__' + m)}" for m in names])
        .groupBy(*by, "__bucket")
        .agg(*[F.expr(f"sum({q('__' + m)}) AS {q('__' + m)}") for m in names])
    )
    offsets, _ = settle(
        per_bucket.selectExpr(
            *qs(by),
            "__bucket",
            *[f"coalesce(sum(`__{m}`) {ahead}, 0) AS `__{m}_off`" for m in names],
            *[f"sum(`__{m}`) {_over(by)} AS `{m}_total`" for m in names],
        )
    )
    inside = _over([*by, "__bucket"], f"{v} {way}", "before")
    ranked = placed(summed, *qs([*by, value, *names])).selectExpr(
        *qs([*by, value, "__bucket", *names]),
        *[f"coalesce(sum({q(m)}) {inside}, 0) AS `__{m}_in`" for m in names],
    )
    return null_safe(ranked, offsets, [*by, "__bucket"]).selectExpr(
        *qs([*by, value, *names]),
        *[f"`__{m}_off` + `__{m}_in` AS `{m}_before`" for m in names],
        *qs([f"{m}_total" for m in names]),
    )


# --- the k-th row of an order ------------------------------------------------


@dataclass(frozen=True)
class Order:
    """A total order given coarse to fine, as SQL expressions.

    ``levels`` group neighbours of the order (day, then second, then instant; or
    growing prefixes of a hash); ``tail`` is the full sort key, unique per row.
    """

    levels: tuple[str, ...]
    tail: tuple[str, ...]


def hash_key(keys: Sequence[str], seed: int) -> str:
    """Seeded md5 over the key columns: a reproducible shuffle order."""
    parts = ", ".join(f"coalesce(CAST({q(k)} AS STRING), '')" for k in keys)
    return f"md5(concat_ws('-', '{seed}', {parts}))"


def hash_order(keys: Sequence[str], seed: int) -> Order:
    h = hash_key(keys, seed)
    return Order(
        (f"substr({h}, 1, 3)", f"substr({h}, 1, 6)", f"substr({h}, 1, 9)"),
        (h, *qs(keys)),
    )


def time_order(micros: str, keys: Sequence[str]) -> Order:
    """By instant; equal instants by the md5 of the key, then the key."""
    h = hash_key(keys, 0)
    return Order(
        (
            f"floor({micros} / 86400000000)",
            f"floor({micros} / 1000000)",
            micros,
            f"concat({micros}, substr({h}, 1, 3))",
            f"concat({micros}, substr({h}, 1, 6))",
        ),
        (micros, h, *qs(keys)),
    )


def cut_rows(
    df: DataFrame, order: Order, ranks: Sequence[str], by: Sequence[str] = ()
) -> tuple[DataFrame, list[str]]:
    """The row standing at each rank of ``order``, within each ``by`` group.

    ``ranks`` are SQL expressions over ``n``, the group's row count, giving 1-based
    ranks. Each pass counts the rows per level value inside the ranges still in
    question, so only counts move until a range holds few enough rows to sort.
    Returns one row per group with ``c{i}_t{j}`` (sort-key part j of cut i; null
    when the rank is 0) and those column names.
    """
    by = list(by)
    levels = [f"__l{i}" for i in range(len(order.levels))]
    tail = [f"__t{i}" for i in range(len(order.tail))]
    rows = df.selectExpr(
        *qs(by),
        *[f"{e} AS {n}" for e, n in zip(order.levels, levels)],
        *[f"{e} AS {n}" for e, n in zip(order.tail, tail)],
    )
    wanted = ", ".join(
        f"struct({j} AS cut, CAST({r} AS BIGINT) AS rank)" for j, r in enumerate(ranks)
    )

    ranges, last = None, None
    for level in levels:
        if ranges is None:
            group = by
            counted = (
                rows.groupBy(*by, level)
                .agg(F.expr("count(1) AS __rows"))
                .selectExpr(
                    "*",
                    f"sum(__rows) {_over(by)} AS n",
                    f"sum(__rows) {_over(by, level, 'upto')} AS __upto",
                )
                .selectExpr("*", f"inline(array({wanted})) AS (__cut, __left)")
            )
        else:
            group = [*by, "__cut", "__left", last]
            counted = (
                null_safe(rows, ranges.drop("__rows"), [*by, last])
                .groupBy(*group, level)
                .agg(F.expr("count(1) AS __rows"))
                .selectExpr("*", f"sum(__rows) {_over(group, level, 'upto')} AS __upto")
            )
        ranges, small = settle(
            counted.where("__left > __upto - __rows AND __left <= __upto").selectExpr(
                *qs([*by, "__cut", level, "__rows"]),
                "__left - (__upto - __rows) AS __left",
            )
        )
        last = level
        if small and (ranges.selectExpr("max(__rows)").first()[0] or 0) <= BUCKET_ROWS:
            break

    position = _over([*by, "__cut", last], ", ".join(tail))
    picked = (
        null_safe(rows, ranges.drop("__rows"), [*by, last])
        .selectExpr("*", f"row_number() {position} AS __pos")
        .where("__pos = __left")
    )
    names = [f"c{j}_t{k}" for j in range(len(ranks)) for k in range(len(tail))]
    wide = picked.groupBy(*by).agg(
        *[
            F.expr(f"max(CASE WHEN __cut = {j} THEN {t} END) AS c{j}_t{k}")
            for j in range(len(ranks))
            for k, t in enumerate(tail)
        ]
    )
    return settle(wide)[0], names


def cuts_passed(
    df: DataFrame,
    order: Order,
    ranks: Sequence[str],
    by: Sequence[str] = (),
    out: str = "passed",
) -> DataFrame:
    """``df`` plus the number of cuts each row lies beyond.

    With one group the cut rows become literals, so the wide rows of ``df`` are
    never shuffled: the result is a projection over the scan. With groups the
    small cut table is joined on the group columns.
    """
    by = list(by)
    if not ranks:
        return df.withColumn(out, F.lit(0))
    wide, names = cut_rows(df, order, ranks, by)
    width = len(order.tail)
    here = f"struct({', '.join(f'{e} AS k{k}' for k, e in enumerate(order.tail))})"
    if by:
        base = null_safe(df, wide, by, "left")
        edges = [
            (f"c{j}_t0", f"struct({', '.join(f'c{j}_t{k} AS k{k}' for k in range(width))})")
            for j in range(len(ranks))
        ]
        beyond = " + ".join(
            f"CAST(({first} IS NULL OR {here} > {edge}) AS INT)" for first, edge in edges
        )
        return base.selectExpr(*qs(df.columns), f"{beyond} AS {q(out)}")
    row = wide.first()
    key = F.expr(here)
    beyond = F.lit(0)
    for j in range(len(ranks)):
        parts = [f"c{j}_t{k}" for k in range(width)]
        if row is None or row[parts[0]] is None:
            beyond = beyond + F.lit(1)
            continue
        edge = F.struct(
            *[F.lit(row[p]).cast(wide.schema[p].dataType).alias(f"k{k}") for k, p in enumerate(parts)]
        )
        beyond = beyond + (key > edge).cast("int")
    return df.withColumn(out, beyond)


# --- quantiles ---------------------------------------------------------------


# Groups of at most this many rows need no brackets: all their values are counted one by one.
WHOLE_ROWS = 20_000


def quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    by: Sequence[str] = (),
    approx: bool = False,
    measures: dict[str, str] | None = None,
) -> DataFrame:
    """Quantiles of ``value`` per group with linear interpolation, plus ``n``.

    Exact by default, from two scans. The first takes a sketch per group, and with it the
    aggregates in ``measures`` (name to SQL over the columns of ``df``). The second counts rows
    per bracket around the wanted ranks and, inside the narrow brackets, per value; these counts
    are written once and the ranks are read from them. Only a bracket that still holds many
    different values is cut again. ``approx=True`` stops after the sketch. Null and NaN
    values are left out, also from ``measures``.
    """
    by, names = list(by), list(probs)
    measures = measures or {}
    known = df.where(f"{q(value)} IS NOT NULL AND NOT isnan(CAST({q(value)} AS DOUBLE))")
    extra = [F.expr(f"{e} AS {q('__m_' + m)}") for m, e in measures.items()]
    named = [f"{q('__m_' + m)} AS {q(m)}" for m in measures]
    number = f"CAST({q(value)} AS DOUBLE)"
    if approx:
        return known.groupBy(*by).agg(
            *[F.expr(f"percentile_approx({number}, {float(probs[p])!r}D, 10000) AS {q(p)}") for p in names],
            F.expr("count(1) AS n"),
            *extra,
        ).selectExpr(*qs([*by, *names, "n"]), *named)

    accuracy = 10_000
    margin = 2.0 / accuracy
    around = [min(1.0, max(0.0, p + s * margin)) for p in probs.values() for s in (-1, 1)]
    order = sorted(set(around))
    at = ", ".join(f"{a:.10f}D" for a in order)
    first, _ = settle(
        known.groupBy(*by)
        .agg(
            F.expr(f"percentile_approx({number}, array({at}), {accuracy}) AS __e"),
            F.expr("count(1) AS __n"),
            *extra,
        )
        .selectExpr(
            *qs(by), "__n", *[f"__e[{i}] AS __e{i}" for i in range(len(order))], *qs([f"__m_{m}" for m in measures])
        )
    )
    edges = ["__n", *[f"__e{i}" for i in range(len(order))]]
    rows = known.selectExpr(*qs(by), f"{number} AS __v")
    if by:
        placed = null_safe(rows, first.select(*by, *edges), by)
    else:
        found = first.first()
        placed = rows.withColumns(
            {e: F.lit(found[e] if found else None).cast(first.schema[e].dataType) for e in edges}
        )
    slot = " + ".join(f"CAST(coalesce(__v >= __e{i}, false) AS INT)" for i in range(len(order)))
    narrow = " OR ".join(
        f"__v BETWEEN __e{order.index(lo)} AND __e{order.index(hi)}" for lo, hi in zip(around[::2], around[1::2])
    )
    cells = stage(
        placed.selectExpr(
            *qs(by), f"{slot} AS __slot", "__v", "__n",
            f"__n <= {WHOLE_ROWS} OR coalesce({narrow}, false) AS __listed",
        )
        .groupBy(*by, "__n", "__slot", F.expr("CASE WHEN __listed THEN __v END AS __key"))
        .agg(*_span())
    )

    low = {p: f"floor((__n - 1) * {float(probs[p])!r}D)" for p in names}
    high = {p: f"ceil((__n - 1) * {float(probs[p])!r}D)" for p in names}
    needed = " OR ".join(
        f"({x} >= __off AND {x} < __off + __rows)"
        for p in names
        for x in (low[p], high[p])
    )
    # Rows at a bracket's lower edge come before the unlisted rest of the slot.
    open_rest = "CAST(__key IS NULL AS INT)"
    wanted, _ = settle(
        cells.selectExpr("*", f"{open_rest} AS __rest")
        .groupBy(*by, "__n", "__slot", "__rest")
        .agg(
            F.expr("count(1) AS __cells"),
            F.expr("sum(__rows) AS __rows"),
            F.expr("min(__lo) AS __lo"),
            F.expr("max(__hi) AS __hi"),
        )
        .selectExpr(
            "*",
            f"coalesce(sum(__rows) {_over(by, '__slot, __rest', 'before')}, 0) AS __off",
        )
        .where(needed)
    )
    top = wanted.selectExpr("max(__cells) AS cells", "coalesce(max(__rest), 0) AS rest", "max(__rows) AS n").first()
    if not top["rest"] and (top["cells"] or 0) <= BUCKET_ROWS:
        members = null_safe(
            cells.where("__key IS NOT NULL").selectExpr(*qs(by), "__slot", "__key AS __v", "__rows"),
            wanted.select(*by, "__slot", "__off", "__n"),
            [*by, "__slot"],
        )
    else:
        ranges = wanted.select(*by, "__n", "__lo", "__hi", "__rows", "__off")
        if top["n"] > BUCKET_ROWS:
            ranges = _refine(rows, by, ranges, needed, top["n"])
        members = _inside(rows, by, ranges).withColumn("__rows", F.lit(1))
    distinct = (
        members.groupBy(*by, "__off", "__n", "__v")
        .agg(F.expr("sum(__rows) AS __rows"))
        .selectExpr("*", f"__off + sum(__rows) {_over([*by, '__off'], '__v', 'upto')} AS __upto")
    )
    picked = distinct.groupBy(*by).agg(
        F.expr("max(__n) AS __n"),
        *[
            F.expr(f"min(CASE WHEN __upto > {x} THEN __v END) AS `__{side}_{p}`")
            for p in names
            for side, x in (("lo", low[p]), ("hi", high[p]))
        ],
    )
    cut = picked.selectExpr(
        *qs(by),
        *[
            f"CASE WHEN `__lo_{p}` = `__hi_{p}` THEN `__lo_{p}`"
            f" ELSE `__lo_{p}` + (`__hi_{p}` - `__lo_{p}`)"
            f" * ((__n - 1) * {float(probs[p])!r}D - {low[p]}) END AS {q(p)}"
            for p in names
        ],
        "__n AS n",
    )
    if not measures:
        return cut
    taken = first.selectExpr(*qs(by), *named)
    if by:
        return null_safe(cut, taken, by)
    kinds = {m: first.schema[f"__m_{m}"].dataType for m in measures}
    row = taken.first()
    return cut.withColumns({m: F.lit(row[m] if row else None).cast(kind) for m, kind in kinds.items()})


def _span() -> list:
    return [F.expr(e) for e in ("count(1) AS __rows", "min(__v) AS __lo", "max(__v) AS __hi")]


def _inside(rows: DataFrame, by: list[str], ranges: DataFrame) -> DataFrame:
    """The rows lying in the value ranges of their group."""
    slim = ranges.selectExpr(*qs(by), "__lo", "__hi", "__off", "__n", "1 AS __one")
    keyed = rows.selectExpr(*qs(by), "__v", "1 AS __one")
    return null_safe(keyed, slim, [*by, "__one"]).where("__v BETWEEN __lo AND __hi").drop(
        "__one", "__lo", "__hi"
    )


def _refine(rows: DataFrame, by: list[str], ranges: DataFrame, needed: str, most: int) -> DataFrame:
    """Cut the ranges at 255 more points each until they hold few rows, or until
    cutting no longer helps because one value fills a range."""
    grid = ", ".join(f"{i / 256}D" for i in range(1, 256))
    group = [*by, "__off", "__n"]
    while True:
        inside = _inside(rows, by, ranges)
        edges, _ = settle(
            inside.groupBy(*group).agg(F.expr(f"percentile_approx(__v, array({grid}), 10000) AS __e"))
        )
        parts, _ = settle(
            null_safe(inside, edges, group)
            .selectExpr(*qs(group), "__v", "size(filter(__e, x -> x <= __v)) AS __slot")
            .groupBy(*group, "__slot")
            .agg(*_span())
            .selectExpr(
                *qs([*by, "__n", "__lo", "__hi", "__rows"]),
                f"__off + coalesce(sum(__rows) {_over(group, '__slot', 'before')}, 0) AS __off",
            )
            .where(needed)
        )
        left = parts.selectExpr("max(__rows)").first()[0] or 0
        ranges = parts
        if left <= BUCKET_ROWS or left > most / 2:
            return ranges
        most = left


def unpivot(
    df: DataFrame, columns: Sequence[str], ids: Sequence[str] = (), name: str = "feature",
    value: str = "value", kind: str = "double",
) -> DataFrame:
    """Wide to long: one row per (row, column). A projection, no shuffle."""
    pairs = ", ".join(
        f"struct({text(c)} AS {q(name)}, CAST({q(c)} AS {kind}) AS {q(value)})" for c in columns
    )
    return df.selectExpr(*qs(ids), f"inline(array({pairs}))")
