"""Secret scans: strong matches, and weak parts linked within a scope.

Strong kinds stand alone (``BASE``). Weak parts are only candidates: something that names
an access identity, something that could be its secret, and an endpoint they would be used
at. Each part's scope is its interval widened by ``reach`` code points on either side;
an interval join over a document's parts links those whose scopes overlap, and a weak part
is reported only when identity and secret co-occur with it in its scope (an endpoint
alone, a lone random-looking string or a lone user name never is).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_value, inputs, tidy

by_value(__name__)

# The patterns of the strong kinds, in the order in which ties are listed.
BASE = (
    (
        "assign",
        r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        re.IGNORECASE | re.ASCII,
        12,
    ),
    ("access", r"(AKIA[A-Z0-9]+)", re.ASCII, 18),
    ("hex", r"([0-9a-f]{16,})", re.ASCII, 16),
)
# Weak parts: role in a credential, pattern, least length of the group.
WEAK = (
    ("identity", r"\b(?:user(?:name)?|login|client_?id|account|access_?key(?:_?id)?)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.@=-]{3,})", re.IGNORECASE | re.ASCII),
    ("identity", r"\b(A(?:SIA|IDA|ROA|GPA)[A-Z0-9]{12,})", re.ASCII),
    ("key", r"(?<![A-Za-z0-9+/=_-])((?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2})(?![A-Za-z0-9+/=_-])", re.ASCII),
    ("key", r"\b(?:pass|pwd|key|credential|auth)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]{6,})", re.IGNORECASE | re.ASCII),
    ("endpoint", r"\b((?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|mongodb)://[A-Za-z0-9._~:/?#@!$&'*+,;=%-]{4,})", re.ASCII),
    ("endpoint", r"\b(?:host|server|endpoint)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9._-]{3,})", re.IGNORECASE | re.ASCII),
)
# A strong match also plays a part: what it shows is a key or an identity.
ROLE = {"assign": "key", "access": "identity", "hex": "key"}
# Any identity, weak or strong, has one of these; a text without them has no weak part that could be linked.
HINT = re.compile(r"[:=]|AKIA|ASIA|AIDA|AROA|AGPA", re.ASCII)
SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
    "n_weak long"
)


def strong_spans(text: str, patterns) -> list[tuple[int, int, int]]:
    """(start, order of the kind, end) of the strong matches, sorted."""
    found = []
    for order, (_, pattern, least) in enumerate(patterns):
        for match in pattern.finditer(text):
            if len(match[1]) >= least:
                found.append((match.start(), order, match.end()))
    return sorted(found)


def linked(parts: list[tuple[int, int, str]], reach: int) -> list[int]:
    """Positions of the parts with an identity and a key in scope, themselves counted.

    Scopes overlap when the gap between two parts is at most ``2 * reach``. Each role's parts
    are sorted by start, with the running greatest end, so one binary search tells
    whether any of a role is in scope: parts are never paired off.
    """
    table = {}
    for role in ("identity", "key"):
        own = sorted((s, e) for s, e, r in parts if r == role)
        ends, most = [], -1
        for _, end in own:
            most = max(most, end)
            ends.append(most)
        table[role] = [s for s, _ in own], ends

    def near(role: str, start: int, end: int) -> bool:
        starts, ends = table[role]
        at = bisect_left(starts, end + 2 * reach + 1)
        return at > 0 and ends[at - 1] >= start - 2 * reach

    return [i for i, (s, e, _) in enumerate(parts) if near("identity", s, e) and near("key", s, e)]


def scan(text: str, base, weak, names, reach: int):
    """Strong spans, and linked weak spans that overlap no strong one."""
    strong = strong_spans(text, base)
    parts, kinds = [], []
    if HINT.search(text):
        taken, most = [s for s, _, _ in strong], []
        for _, _, end in strong:
            most.append(max(end, most[-1]) if most else end)
        seen = set()
        for role, pattern in weak:
            for match in pattern.finditer(text):
                start, end = match.span(1)
                at = bisect_left(taken, end)
                if (at and most[at - 1] > start) or (start, end) in seen:
                    continue
                seen.add((start, end))
                parts.append((start, end, role))
                kinds.append(role)
    weak_count = len(parts)
    if weak_count:
        parts += [(s, e, ROLE[names[k]]) for s, k, e in strong]
        kept = [i for i in linked(parts, reach) if i < weak_count]
    else:
        kept = []
    order = {name: i for i, name in enumerate([*names, "identity", "key", "endpoint"])}
    spans = [(s, k, e) for s, k, e in strong] + [(parts[i][0], order[kinds[i]], parts[i][1]) for i in kept]
    return strong, sorted(spans), list(order)


def scanner(reach: int):
    """A function from text to (strong spans, all spans, names of the kinds)."""
    base = [(name, re.compile(p, flags), least) for name, p, flags, least in BASE]
    weak = [(role, re.compile(p, flags)) for role, p, flags in WEAK]
    names = [name for name, _, _ in base]
    return lambda text: scan(text, base, weak, names, reach)


def listed(spans, names) -> str:
    return ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, reach: int = 200, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts and spans of strong and linked weak findings.

    Offsets count code points, ends are exclusive. A null text counts as empty (no spans, the
    digest of the empty string); ids may be null or repeated, every row is scanned for itself;
    an empty table gives no rows. A row's work is about linear in its text.
    """
    docs = inputs(docs, "documents", doc_id=doc_id, text=text)

    def run(batches):
        find = scanner(reach)
        for batch in batches:
            rows = []
            for key, value in zip(batch.column(0), batch.column(1)):
                strong, spans, names = find(value.as_py() or "")
                counts = [sum(k == kind for _, k, _ in strong) for kind in range(3)]
                digest = hashlib.sha256(listed(strong, names).encode()).hexdigest()
                rows.append((key.as_py(), *counts, digest, listed(spans, names), len(spans) - len(strong)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.string() if i in (4, 5) else pa.int64()) for i, c in enumerate(zip(*rows))],
                    [c.split()[0] for c in SCHEMA.split(", ")],
                )

    return docs.select(docs.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), SCHEMA)


def redact_secrets(docs: DataFrame, reach: int = 200, mask: str = "[secret]", text: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by ``mask``; overlapping spans become one.

    Rows, other columns and texts without findings stay as they are; a null text stays null.
    A column ``n_chars`` follows the new text.
    """
    names = docs.columns
    at, schema = names.index(text), docs.schema

    def run(batches):
        find = scanner(reach)
        for batch in batches:
            texts = []
            for value in batch.column(at):
                value = value.as_py()
                if value is not None:
                    parts, last = [], 0
                    for start, _, end in find(value)[1]:
                        if start >= last:
                            parts += [value[last:start], mask]
                        last = max(last, end)
                    value = "".join([*parts, value[last:]])
                texts.append(value)
            new = pa.array(texts, batch.schema.field(at).type)
            columns = [new if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    from pyspark.sql import functions as F

    out = docs.mapInArrow(tidy(run), schema)
    return out.withColumn("n_chars", F.length(text).cast(schema["n_chars"].dataType)) if "n_chars" in names else out
