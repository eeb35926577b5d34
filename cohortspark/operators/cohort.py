"""Cohorts by code prefix: one pass over the facts for all cohorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import normalise_code, starts_with_any
from ..session import SMALL_ROWS, local_table, require_columns
from ..sources.config import CodeRule
from .ranking import q, qs, text

# Prefix lists up to this length also go to the scan as prefix filters.
PUSHED_PREFIXES = 200


def prepare_rules(
    rules: Sequence[CodeRule], normalize: bool = True, match_system: bool = True
) -> list[tuple[str, str | None, str]]:
    """(cohort, system, prefix), without prefixes another rule already covers, so
    that a fact matches a cohort through exactly one rule."""
    seen = {
        (
            r.cohort,
            r.system if match_system else None,
            r.prefix.replace(".", "") if normalize else r.prefix,
        )
        for r in rules
    }

    def covered(cohort, system, prefix):
        return any((cohort, system, prefix[:n]) in seen for n in range(len(prefix)))

    return sorted((t for t in seen if not covered(*t)), key=lambda t: (t[0], t[1] or "", t[2]))


def match_codes(
    facts: DataFrame,
    rules: Sequence[CodeRule],
    code: str = "icd_code",
    system: str = "icd_version",
    normalize: bool = True,
    match_system: bool = True,
) -> DataFrame:
    """``facts`` joined to the cohorts their code belongs to (``cohort`` added).

    Each code is cut to the distinct prefix lengths and joined on (length, prefix)
    with the rules, so the match is a hash join however many cohorts there are.
    """
    require_columns(facts, [code] + ([system] if match_system else []), "facts")
    prepared = prepare_rules(rules, normalize, match_system)
    if not prepared:
        return facts.where(F.lit(False)).withColumn("cohort", F.lit(None).cast("string"))
    prefixes = sorted({p for _, _, p in prepared})
    lengths = sorted({len(p) for p in prefixes})
    text = normalise_code(code) if normalize else F.col(code)
    if len(prefixes) <= PUSHED_PREFIXES:
        facts = facts.where(starts_with_any(code, prefixes, normalize))
    cuts = ", ".join(f"struct({n} AS __len, substr(__code, 1, {n}) AS __prefix)" for n in lengths)
    keyed = facts.withColumn("__code", text).selectExpr("*", f"inline(array({cuts}))")
    rows = [(c, s, len(p), p) for c, s, p in prepared]
    schema = "cohort string, __system string, __len int, __prefix string"
    lookup = local_table(facts.sparkSession, rows, schema)
    if not match_system:
        lookup = lookup.drop("__system")
    if len(prepared) <= SMALL_ROWS:
        lookup = F.broadcast(lookup)
    keys = ["__len", "__prefix"]
    if match_system:
        keyed = keyed.withColumn("__system", F.col(system).cast("string"))
        keys.append("__system")
    return keyed.join(lookup, keys).select(*facts.columns, "cohort")


def cohort_members(
    facts: DataFrame, rules: Sequence[CodeRule], subject: str = "subject_id", **match
) -> DataFrame:
    """Distinct (cohort, subject)."""
    return match_codes(facts, rules, **match).select("cohort", subject).distinct()


def members_of(
    facts: DataFrame,
    rules: Sequence[CodeRule],
    cohort: str,
    subject: str = "subject_id",
    ordered: bool = True,
    **match,
) -> DataFrame:
    """Sorted distinct subjects of one cohort."""
    known = sorted({r.cohort for r in rules})
    if cohort not in known:
        raise ValueError(f"unknown cohort {cohort!r}; known: {known}")
    own = [r for r in rules if r.cohort == cohort]
    found = match_codes(facts, own, **match).select(subject).distinct()
    return found.orderBy(subject) if ordered else found


def cohort_labels(
    population: DataFrame,
    facts: DataFrame,
    rules: Sequence[CodeRule],
    cohort: str,
    subject: str = "subject_id",
    **match,
) -> DataFrame:
    """(subject, label) over every subject of ``population``: 1 if any fact of the
    subject matches the cohort."""
    positives = members_of(facts, rules, cohort, subject, ordered=False, **match)
    everyone = population.select(subject).distinct()
    # both sides are grouped by subject already, so the join moves nothing
    marked = everyone.join(positives.withColumn("__hit", F.lit(1)), subject, "left")
    return marked.selectExpr(q(subject), "coalesce(__hit, 0) AS label")


def all_labels(
    population: DataFrame,
    facts: DataFrame,
    rules: Sequence[CodeRule],
    subject: str = "subject_id",
    **match,
) -> DataFrame:
    """(subject, cohort, label) for every cohort from one pass over the facts.

    The cohorts of a subject travel as one small set, so the join with the
    population is on the subject alone.
    """
    names = sorted({r.cohort for r in rules})
    sets = (
        match_codes(facts, rules, **match)
        .groupBy(subject)
        .agg(F.collect_set("cohort").alias("__set"))
    )
    listed = ", ".join(text(n) for n in names)
    return (
        population.select(subject)
        .distinct()
        .join(sets, subject, "left")
        .selectExpr(q(subject), "__set", f"explode(array({listed})) AS cohort")
        .selectExpr(
            q(subject),
            "cohort",
            "CAST(coalesce(array_contains(__set, cohort), false) AS INT) AS label",
        )
    )


def non_members(
    population: DataFrame,
    facts: DataFrame,
    rules: Sequence[CodeRule],
    cohort: str,
    subject: str = "subject_id",
    **match,
) -> DataFrame:
    """Subjects of ``population`` outside the cohort."""
    positives = members_of(facts, rules, cohort, subject, ordered=False, **match)
    return population.select(subject).distinct().join(positives, subject, "left_anti")


def restrict_to(df: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key (one or several columns) is in ``ids``."""
    return df.join(ids.select(*keys), list(keys), "left_semi")


def id_union(*sets: DataFrame) -> DataFrame:
    """Distinct union of id tables."""
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out.distinct()


def full_coalesce_join(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer join of frames with disjoint value columns and one row per key
    each, with merged keys.

    Done as one union and one grouping: every frame is shuffled once, and rows
    are combined before they move. Shared value columns raise ``ValueError``; a key that a
    frame holds twice fails the job, as there is no one value for it.
    """
    keys = list(keys)
    shared = [c for i, f in enumerate(frames) for c in f.columns if c not in keys and any(c in g.columns for g in frames[:i])]
    if shared:
        raise ValueError(f"value column(s) {sorted(set(shared))} are in several frames")
    values = {c: f.schema[c].dataType for f in frames for c in f.columns if c not in keys}
    owner = {c: i for i, f in enumerate(frames) for c in f.columns if c not in keys}
    padded = [
        f.select(
            *keys,
            F.lit(i).alias("__frame"),
            *[
                (F.col(c) if c in f.columns else F.lit(None)).cast(kind).alias(c)
                for c, kind in values.items()
            ],
        )
        for i, f in enumerate(frames)
    ]
    out = padded[0]
    for f in padded[1:]:
        out = out.unionByName(f)
    return out.groupBy(*keys).agg(
        *[
            F.expr(
                f"CASE WHEN count_if(__frame = {owner[c]}) > 1"
                f" THEN raise_error('a key occurs more than once beside {c}') ELSE max({q(c)}) END AS {q(c)}"
            )
            for c in values
        ]
    ).selectExpr(*qs([*keys, *values]))
