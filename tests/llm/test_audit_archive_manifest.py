"""Filter audit, WARC archives and Merkle manifest against brute force."""

from __future__ import annotations

import glob
import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from cohortspark.llm import filter_audit, merkle, warc

# Filter audit

DOCS = "doc_id long, text string, source string, lang string, n_chars long, mask int, part string, A int, words string"


def audit_table(spark):
    pick = random.Random(4)
    words = lambda n, k: " ".join(f"w{pick.randrange(k)}" for _ in range(n))
    texts = [words(n, k) for n, k in ((60, 400), (60, 20), (10, 100), (49, 999), (50, 999), (4000, 9000))]
    texts += ["LOUD " * 60, "A" * 6 + "b" * 94, "A" * 5 + "b" * 95, "x # y", "", None, " \t\x0b\n", "É" * 40 + " ünï", texts[0], "naïve 日本 \U0001f600 100%"]
    rows = [(pick.randrange(200), pick.choice(texts), pick.choice(["a", "b", None, ""]), None, None) for _ in range(300)]
    rows += [(None, texts[0], "a", None, None), (None, texts[0], None, None, None), (-5, texts[2], "c", "x", 1), (-5, texts[2], "c", "x", 1)]
    labels = [(i, pick.choice([0, 1, None]), pick.choice([0, 0, 1, None])) for i in range(0, 180)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "p", 1, "w") for r in rows], DOCS)
    return rows, labels, docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def plain_audit(rows, labels):
    first = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    parts = {}
    for doc_id, text, source, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text)),
            "E": doc_id is not None and first[text] < doc_id,
        }
        parts.setdefault(source or "", []).append(({f for f in fails if fails[f]}, doc_id in good, doc_id in toxic))
    out = []
    for part, docs in parts.items():
        shapley, mine = Counter(), []
        for order in permutations("ABCDE"):
            left = list(docs)
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                failing = sum(f in d[0] for d in docs)
                alone = sum(d[0] == {f} for d in docs)
                mine.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), alone, sum(d[1] for d in gone), sum(d[2] for d in gone)))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in mine]
    return sorted(out)


def test_audit_matches_every_order_applied(spark):
    rows, labels, docs, label_rows = audit_table(spark)
    flags = filter_audit.document_failures(docs, label_rows)
    assert flags.count() == len(rows)
    found = filter_audit.audit_filters(flags, "ABCDE", ("good", "toxic"))
    assert sorted(map(tuple, found.collect())) == plain_audit(rows, labels)


def test_audit_of_nothing_and_of_other_filters(spark):
    _, _, docs, labels = audit_table(spark)
    nothing = filter_audit.document_failures(docs.limit(0), labels.limit(0))
    assert filter_audit.audit_filters(nothing, "ABCDE", ("good",)).count() == 0
    flags = spark.createDataFrame([("p", True, None), ("p", False, True), (None, True, True)], "part string, x boolean, y boolean")
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filter_audit.audit_filters(flags, "xy").collect()}
    assert found["p", "xy", 1] == (1, 1, 0, 1, 2) and found["", "yx", 2] == (0, 0, 1, 0, 1) and len(found) == 8
    for names in ("", "xx", "abcdefghi"):
        with pytest.raises(ValueError):
            filter_audit.audit_filters(flags, names)


def test_path_counts_add_up_to_all_orders():
    forward, backward = filter_audit.path_counts(5)
    for size in range(6):
        assert sum(f * b for s, (f, b) in enumerate(zip(forward, backward)) if s.bit_count() == size) == 120


def test_audit_counts_before_it_shuffles(spark):
    """One key may hold most rows: what leaves a task is counts by mask."""
    flags = spark.range(1000).select(F.lit("p").alias("part"), (F.col("id") % 2 == 0).alias("x"), (F.col("id") % 3 == 0).alias("y"))
    from helpers import plan

    text = plan(filter_audit.audit_filters(flags, "xy"))
    assert "partial_count" in text and "Join" not in text


# WARC

PAGES = "page_id long, url string, html string, payload string, digest string, first long"


def page_rows():
    pick = random.Random(6)
    long = "<p>" + "x" * 200
    rows = [(i, f"http://e.org/{i}", f"<html>{i} " + "".join(chr(pick.randrange(33, 500)) for _ in range(pick.randrange(400))) + "</html>") for i in range(40)]
    rows += [(50, "u", long), (49, "a b\n<c>", long), (51, None, long), (51, None, long), (None, "u", long), (60, "", ""), (61, "u", None)]
    rows += [(62, "u", "s" * 99), (63, "u", "s" * 99), (64, "u", "s" * 100), (65, "u", "s" * 100), (66, "u", "é" * 50), (67, "u", "é" * 50), (None, "n", "n" * 150), (None, "n", "n" * 150)]
    rows += [(70, "quotes", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3), (71, "u", "big " * 200_000)]
    return rows


def plain_archive(rows):
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        least = first.get(html or "")
        later = len(data) >= 100 and least is not None and (page is None or page > least)
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if later else "response", least if later else None))
    return sorted(map(str, out))


def test_pages_survive_writing_and_reading(spark, tmp_path):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, "p", "d", 1) for r in rows], PAGES).repartition(3)
    for compress in (True, False):
        for size in (1, 20_000, 1 << 25):
            path = str(tmp_path / f"{compress}{size}")
            warc.write_archives(warc.plan_records(pages), path, size, compress)
            found = warc.read_archives(spark, path)
            assert found.filter("gap IS NOT NULL").count() == 0
            assert sorted(map(str, map(tuple, warc.resolve_revisits(found).collect()))) == plain_archive(rows)
            texts = Counter(r["payload"].decode() for r in found.filter("type = 'response'").collect())
            assert set(texts) == {(html or "") for _, _, html in rows}
    uris = {r["uri"] for r in found.filter("page_id IN (49, 51, 60)").collect()}
    assert uris == {"a%20b%0A%3Cc%3E", "about:blank"}


def test_no_pages_no_archives(spark, tmp_path):
    pages = spark.createDataFrame([], PAGES)
    warc.write_archives(warc.plan_records(pages), str(tmp_path / "none"))
    assert warc.resolve_revisits(warc.read_archives(spark, str(tmp_path / "none"))).count() == 0


def archive_of(count, compress, pick):
    pack = warc.member if compress else bytes
    parts = [pack(warc.info_record())]
    for i in range(count):
        payload = bytes(pick.randrange(256) for _ in range(pick.randrange(20, 900)))
        digest = hashlib.sha256(payload).hexdigest()
        parts.append(pack(warc.page_record(i, f"http://e.org/{i}", payload, digest, f"urn:uuid:{i}", None)))
    return parts


@pytest.mark.parametrize("compress", [True, False])
def test_salvage_loses_damaged_records_only(compress):
    pick = random.Random(8)
    for trial in range(150):
        parts = archive_of(12, compress, pick)
        starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
        kind = ("flip", "cut", "insert", "truncate", "drop tail", "swap")[trial % 6]
        hit = pick.randrange(1, 12)
        bad = bytearray(parts[hit])
        at = pick.randrange(len(bad))
        if kind == "flip":
            bad[at] ^= 1 << pick.randrange(8)
        elif kind == "cut":
            del bad[at : at + pick.randrange(1, 40)]
        elif kind == "insert":
            bad[at:at] = bytes(pick.randrange(256) for _ in range(pick.randrange(1, 40)))
        elif kind == "swap":
            bad[at:at] = b"\x1f\x8b\x08WARC/1.1\r\nno record"
        elif kind == "drop tail":
            hit, bad = 12, bytearray(parts[12][: pick.randrange(1, len(parts[12]))])
        if kind == "truncate":
            data = b"".join(parts[:hit]) + bytes(bad[:at])
            whole = set(range(-1, hit - 1))
        else:
            data = b"".join([*parts[:hit], bytes(bad), *parts[hit + 1 :]])
            whole = set(range(-1, 12)) - {hit - 1}
        spans = list(warc.read_archive(data))
        assert [s[0] for s in spans] == [0, *[s[1] for s in spans[:-1]]] and spans[-1][1] == len(data)
        # No check covers all of a record's bytes (a gzip time, the text of a header), so the hit one may come back.
        reach = starts[hit] + len(bad) if kind != "truncate" else len(data)
        found = [int(f.get("warc-page-id", -1)) for start, *_, records in spans for f, _ in records if not starts[hit] <= start < reach]
        assert sorted(found) == sorted(whole), (kind, hit, at)
        gaps = [(start, end) for start, end, reason, _ in spans if reason]
        assert all(starts[hit] <= start and end <= reach for start, end in gaps), (kind, hit, at)
        inside = [f for start, *_, records in spans for f, _ in records if starts[hit] <= start < reach]
        assert gaps or inside or not bad[:at]


def test_a_quoted_record_inside_a_damaged_one_is_not_recovered():
    fake = warc.record("response", [("WARC-Page-ID", 99)], b"fake")
    real = warc.page_record(1, "u", b"text " + fake, "0" * 64, "urn:1", None)
    after = warc.page_record(2, "u", b"after", hashlib.sha256(b"after").hexdigest(), "urn:2", None)
    spans = list(warc.read_archive(b"junk before " + real + after))
    assert [(reason, [f["warc-page-id"] for f, _ in records]) for *_, reason, records in spans] == [("no version line", []), (None, ["2"])]
    assert spans[0][:2] == (0, 12 + len(real))


def test_damaged_files_are_read_and_logged_by_spark(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"text {i} " * 30) for i in range(30)], "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "damaged")
    warc.write_archives(warc.plan_records(pages), path)
    (name,) = glob.glob(path + "/part-*")
    data = bytearray(open(name, "rb").read())
    spans = [s for s in warc.read_archive(bytes(data)) if s[3]]
    start, end = spans[5][:2]
    data[(start + end) // 2] ^= 255
    copy = tmp_path / "copy"
    copy.mkdir()
    (copy / "archive.warc.gz").write_bytes(bytes(data))
    found = warc.read_archives(spark, str(copy)).collect()
    gaps = [(r["offset"], r["length"], r["gap"]) for r in found if r["gap"]]
    assert gaps == [(start, end - start, "broken member")] and len(found) == 31
    resolved = warc.resolve_revisits(warc.read_archives(spark, str(copy)))
    assert resolved.count() == 29


# Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(nodes, fan):
    """Root of ``nodes`` and for each of them the (left, right) of every level."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, where in enumerate(at):
            run = nodes[where // fan * fan : where // fan * fan + fan]
            paths[i].append(("".join(run[: where % fan]), "".join(run[where % fan + 1 :])))
        nodes = [h(*nodes[s : s + fan]) for s in range(0, len(nodes), fan)]
        at = [where // fan for where in at]
    return nodes[0], paths


def plain_manifest(rows, fan):
    table = []
    for doc_id, source, lang, n_chars, text in rows:
        fields = "".join(framed(v) for v in (doc_id, source, lang, n_chars))
        leaf, used = h(fields, framed(text)), None
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
            used = h(fields, framed(None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)))
        table.append((doc_id, lang, leaf, used or leaf))
    langs = sorted({r[1] for r in table}, key=lambda v: (v is not None, (v or "").encode()))
    groups = {lang: sorted([r for r in table if r[1] == lang], key=lambda r: (r[0] is not None, r[0] or 0, r[2])) for lang in langs}
    trees = {lang: climb([r[2] for r in groups[lang]], fan) for lang in langs}
    root, tops = climb([trees[lang][0] for lang in langs], fan)
    out = []
    for lang, top in zip(langs, tops):
        subroot, paths = trees[lang]
        for (doc_id, _, leaf, used), path in zip(groups[lang], paths):
            for left, right in [*path, *top]:
                used = h(left, used, right)
            proof = h(*[s for step in [*path, *top] for s in step])
            out.append((doc_id, leaf, subroot, root, proof, used, used == root))
    return sorted(map(str, out))


MANIFEST = "doc_id long, source string, lang string, n_chars long, text string, hash string, `group` int, rank long, leaf string"


@pytest.mark.parametrize("fan,sizes", [(8, {"en": 530, "de": 64, "fr": 65, "é": 8, None: 9, "x": 1}), (2, {f"l{i}": 1 + i for i in range(17)})])
def test_manifest_matches_plain_trees(spark, fan, sizes):
    pick = random.Random(3)
    rows = []
    for lang, size in sizes.items():
        for _ in range(size):
            text = pick.choice([None, "", "Text WITH capitals", "plain", "Éa 日本 \U0001f600", "A" * 3000]) if pick.random() < 0.9 else f"t{pick.random()}"
            rows.append((pick.choice([None, pick.randrange(-500, 5000)]) if pick.random() < 0.1 else pick.randrange(5000), pick.choice(["s", None, "ü"]), lang, pick.choice([1, None]), text))
    rows += rows[:20] + [rows[0]] * 30
    docs = spark.createDataFrame([(*r, "h", 1, 2, "leaf") for r in rows], MANIFEST)
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3) == 0
    found = merkle.audit_manifest(docs, tampered, fan)
    assert sorted(map(str, map(tuple, found.collect()))) == plain_manifest(rows, fan)


def test_manifest_of_one_and_of_no_document(spark):
    docs = spark.createDataFrame([(None, None, None, None, None, "h", 1, 2, "l")], MANIFEST)
    (row,) = merkle.audit_manifest(docs, F.lit(None).cast("boolean")).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] == h("-----") and row["verified"] and row["proof_sha256"] == h("")
    assert merkle.audit_manifest(docs.limit(0), F.lit(False)).count() == 0


def test_proofs_are_emitted_without_joins(spark):
    from helpers import plan

    docs = spark.createDataFrame([(i, "s", "en", 1, f"T{i}", "h", 1, 2, "l") for i in range(100)], MANIFEST)
    text = plan(merkle.audit_manifest(docs, F.lit(False)))
    assert "Join" not in text and "Generate" in text


def test_rolling_up_exchanges_once(spark):
    from helpers import plan

    nodes = spark.range(2000).select(
        (F.col("id") % 2).alias("group"), F.col("id").alias("rank"), F.lit(4).alias("levels"), F.sha2(F.col("id").cast("string"), 256).alias("hash")
    )
    text = plan(merkle.roll_up(nodes, [], 8))
    assert text.count("Arguments: hashpartitioning") == text.count("REPARTITION_BY_COL") > 0
