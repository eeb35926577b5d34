"""Document fingerprints by consistent weighted sampling, in DataFrame functions.

Terms are a text's words, weighted by how often they occur. For every term and every
sample i, two Gamma(2, 1) values r and c and a uniform b follow from the term's hash. With weight S the
term offers ``t = floor(ln S / r + b)`` at the price ``ln c - r (t - b + 1)``; the sample is the
term (with its t) of the least price. Two texts share a sample with a probability equal to their
generalised Jaccard similarity, the sum of the lesser weights over that of the greater.

Texts are dealt by document once. Words, weights, prices and samples are then grouped by keys
that begin with the document, so none of these groupings shuffles again, and the draws of a
term serve both the text and its edited form. The rest that moves is the part of each text that its
neighbour takes over, and the samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import inputs, stage

NO_ID = -(1 << 63)
SPACE = r"[\x20\x09-\x0D]+"
# A document: its place in descending order of ids (the id's bits turned over) and 128 bits of its text.
KEY = ["o", "t1", "t2"]
NEXT = ["no", "n1", "n2"]
# Equal rows beyond this number are combined before the shuffle of texts, and written by several tasks.
MANY = 1000


def by_id(docs: DataFrame) -> DataFrame:
    """(o, t1, t2, text): the document's key and its text, empty for null; a null id is the smallest."""
    text = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    return text.select(F.bitwise_not("k").alias("o"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")


def next_in_order(ids: DataFrame) -> DataFrame:
    """``ids`` (unique KEY) with the key of the next one as NEXT, after the last the first.

    Ranges of keys are dealt to tasks and each looks along its own; the first key of a range is the
    next of the last one before it. Only one row per range meets in one place.
    """
    ranged = stage(ids.repartitionByRange(*KEY).withColumn("bucket", F.spark_partition_id()).withColumn("d", F.struct(*KEY)))
    inside = Window.partitionBy("bucket").orderBy("d")
    edges = ranged.groupBy("bucket").agg(F.min("d").alias("first_d"))
    across = Window.orderBy("bucket")
    edges = edges.select(
        F.col("bucket").alias("edge"), F.coalesce(F.lead("first_d").over(across), F.min("first_d").over(Window.partitionBy())).alias("after_d")
    )
    return (
        ranged.withColumn("within", F.lead("d").over(inside)).join(edges, F.col("bucket") == F.col("edge"))
        .withColumn("next", F.coalesce("within", "after_d"))
        .select(*ids.columns, *[F.col("next")[c].alias(to) for c, to in zip(KEY, NEXT)])
    )


def whole_texts(rows: DataFrame, ids: DataFrame, parts: int) -> DataFrame:
    """(KEY, text), one row per document, dealt by KEY to ``parts`` partitions.

    Documents of very many equal rows are combined inside the tasks that read them, so no task receives all of one.
    Their keys are a written table, whose size tells the optimizer whether to broadcast them.
    """
    hot = stage(ids.where(F.col("copies") > MANY).select(*KEY))
    if not hot.isEmpty():
        few = rows.join(hot, KEY, "left_anti")
        rows = few.unionByName(rows.join(hot, KEY, "left_semi").groupBy(*KEY).agg(F.max("text").alias("text")))
    return rows.repartition(parts, *KEY).groupBy(*KEY).agg(F.max("text").alias("text"))


def repeated(made: DataFrame, order: DataFrame, parts: int, finish) -> DataFrame:
    """``finish(made and order joined)`` with a row for each equal row; long repeats are dealt to tasks in blocks."""
    few = finish(made.join(order.where(F.col("copies") <= MANY), KEY)).withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    many = finish(made.join(order.where(F.col("copies") > MANY), KEY)).withColumn("block", F.explode(F.expr(f"sequence(0L, (copies - 1) div {MANY})")))
    many = many.repartition(parts).withColumn("copy", F.explode(F.expr(f"sequence(1L, least({MANY}L, copies - block * {MANY}))")))
    return few.drop("copies", "copy").unionByName(many.drop("copies", "block", "copy"))


def unit(bits: str, shift: int, width: int) -> str:
    """A number between 0 and 1 from ``width`` bits of a hash."""
    return f"((shiftrightunsigned({bits}, {shift}) & {(1 << width) - 1}L) + 0.5D) * {2.0 ** -width!r}D"


def samples(texts: DataFrame, count: int) -> DataFrame:
    """(KEY, i, code, edited_code) from (KEY, text, edited), partitioned by KEY as ``texts`` are.

    A code is a 32-bit hash of the sampled term and its t; null where there is no word.
    """
    words = lambda c: F.filter(F.split(c, SPACE), lambda w: w != "")
    terms = (
        texts.select(*KEY, words("text").alias("a"), words("edited").alias("b"))
        .select(*KEY, F.size("a").alias("own"), F.posexplode(F.concat("a", "b")).alias("at", "word"))
        .select(*KEY, F.xxhash64("word").alias("term"), (F.col("at") < F.col("own")).cast("int").alias("mine"))
        .groupBy(*KEY, "term").agg(F.sum("mine").alias("s"), F.sum(1 - F.col("mine")).alias("e"))
    )
    drawn = (
        terms.select(*KEY, "term", F.log("s").alias("ls"), F.log("e").alias("le"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("i"))
        .selectExpr(*KEY, "i", "term", "ls", "le", "xxhash64(term, i) AS h")
        .selectExpr(*KEY, "i", "term", "ls", "le", "h", "xxhash64(h, i) AS g")
        .selectExpr(
            *KEY, "i", "term", "ls", "le",
            f"-ln({unit('h', 40, 24)} * {unit('h', 16, 24)}) AS r",
            f"ln(-ln({unit('g', 40, 24)} * {unit('g', 16, 24)})) AS lc",
            f"{unit('(shiftleft(h, 16) | (g & 65535L))', 0, 32)} AS b",
        )
        .selectExpr(*KEY, "i", "term", "r", "lc", "b", "floor(ls / r + b) AS t", "floor(le / r + b) AS u")
        .selectExpr(*KEY, "i", "term", "t", "u", "lc - r * (t - b + 1) AS p", "lc - r * (u - b + 1) AS q")
    )
    return drawn.groupBy(*KEY, "i").agg(
        F.expr("min_by(xxhash64(term, t), p)").alias("code"), F.expr("min_by(xxhash64(term, u), q)").alias("edited_code")
    )


def likeness(a: str, b: str):
    """Share of equal samples; two texts without words are alike, one without is unlike any."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when(
        (F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)
    ).otherwise(same / F.size(a))


def as_text(column: str):
    """A fingerprint's samples, eight hex digits each; empty for a text without words."""
    return F.lower(F.array_join(F.transform(column, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def fingerprint_documents(
    docs: DataFrame, count: int = 32, partition_chars: int = 1 << 23, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likenesses.

    The edited form replaces the last third of a text (rounded down) by as many code points from the beginning
    of the next document by descending id; after the last comes the first. Returns doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Every row gets a row. Null texts are empty. In the order of documents, rows alike in id and text are one document;
    documents of one id follow each other by their texts' hashes, and those without an id come last. A
    single document is its own next. An empty table gives no rows. Texts under one id are told apart by 128 bits.
    """
    rows = by_id(inputs(docs, "documents", doc_id=doc_id, text=text))
    ids = stage(rows.groupBy(*KEY).agg(F.max(F.length("text")).alias("n"), F.count(F.lit(1)).alias("copies")))
    chars = ids.agg(F.sum("n")).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // partition_chars))
    order = stage(next_in_order(ids))
    whole = whole_texts(rows, ids, parts)
    lent = (
        whole.select(*[F.col(c).alias(to) for c, to in zip(KEY, NEXT)], "text").join(order, NEXT)
        .select(*KEY, F.expr("substring(text, 1, n div 3)").alias("piece"))
    )
    texts = whole.join(lent, KEY).select(
        *KEY, "text", F.expr("concat(substring(text, 1, length(text) - length(text) div 3), piece)").alias("edited")
    )
    digests = texts.select(*KEY, F.length("text").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    codes = (
        samples(texts, count).groupBy(*KEY)
        .agg(F.sort_array(F.collect_list(F.struct("i", "code", "edited_code"))).alias("all"))
        .select(
            *KEY,
            *[F.transform(F.filter("all", lambda x: x[c].isNotNull()), lambda x: x[c].bitwiseAND(0xFFFFFFFF)).alias(c) for c in ("code", "edited_code")],
        )
    )
    none = F.array().cast("array<bigint>")
    made = stage(
        digests.join(codes, KEY, "left")
        .select(*KEY, "n_chars", "edited_sha256", F.coalesce("code", none).alias("code"), F.coalesce("edited_code", none).alias("edited_code"))
    )
    following = made.select(*[F.col(c).alias(to) for c, to in zip(KEY, NEXT)], F.col("code").alias("next_code"))
    k = F.bitwise_not("o")

    def finish(joined: DataFrame) -> DataFrame:
        return joined.join(following, NEXT).select(
            F.when(k != NO_ID, k).alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256",
            as_text("code").alias("fingerprint"), as_text("edited_code").alias("edited_fingerprint"),
            likeness("code", "edited_code").alias("near_edited"), likeness("code", "next_code").alias("near_next"), "copies",
        )

    return repeated(made, order.drop("n"), parts, finish)
