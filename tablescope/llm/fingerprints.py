"""Homomorphic multiset fingerprints of documents; DataFrame functions only.

A paragraph is hashed to a wide vector and a document's fingerprint is the sum of its paragraphs' vectors, lane by
lane modulo powers of two.  The order of paragraphs does not matter, and adding or taking away a paragraph adds or
takes away its vector (``joined``, ``without``).  The vector has two parts:

* ``exact``: 8 lanes modulo 2**32, hashed from the whole paragraph; texts with the same paragraphs agree in all.
* ``like``: 128 lanes, those of zero left out; each phrase of the paragraph adds or takes one in the lane its hash
  names.  The cosine of two such vectors estimates the cosine of the multisets of phrases, with an error of about
  0.09.

Phrases end at marks, at line ends and before words that start with a to e or t; cuts depend on the neighbouring
characters alone.  Equality is that of ``exact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.blocks import cut_lineage

EXACT, LANES = 8, 128
PHRASE = r"[.!?,;|\n]+\s*|\s+(?=[a-etA-ET])"
SHORTEST = 8
"""Characters of a phrase that counts; shorter ones are in most texts."""
PARAGRAPH = -1
"""Stands in place of the lane for paragraphs."""


def _units(text: Column, side: int) -> Column:
    """(side, lane, h, g): hashes of the paragraphs, and of the phrases with their lanes."""

    def unit(x: Column, lane: Column) -> Column:
        return F.struct(F.lit(side).alias("side"), lane.alias("lane"), F.xxhash64(x).alias("h"), F.xxhash64(x, F.lit(1)).alias("g"))

    phrases = F.filter(F.split(text, PHRASE), lambda x: F.length(x) >= SHORTEST)
    paragraphs = F.transform(F.split(text, "\n"), lambda x: unit(x, F.lit(PARAGRAPH)))
    return F.concat(paragraphs, F.transform(phrases, lambda x: unit(x, F.pmod(F.xxhash64(x, F.lit(2)), F.lit(LANES)).cast("int"))))


def _sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, print struct(exact, like, n)): sums of the units' vectors, lane by lane, then put together."""
    paragraph, low = F.col("lane") == PARAGRAPH, F.lit(0xFFFFFFFF).cast("bigint")
    exact = [F.sum(F.when(paragraph, F.xxhash64("h", "g", F.lit(k)).bitwiseAND(low))).alias(f"x{k}") for k in range(EXACT)]
    sign = F.sum(F.when(F.col("g") < 0, -1).otherwise(1)).alias("c")
    lanes = rows.groupBy(*keys, "lane").agg(*exact, sign, F.count(F.lit(1)).alias("n"))
    whole = F.array(*[F.col(f"x{k}").bitwiseAND(low) for k in range(EXACT)])
    entry = F.when((F.col("lane") >= 0) & (F.col("c") != 0), F.struct("lane", "c"))
    found = lanes.groupBy(*keys).agg(
        F.max(F.when(F.col("lane") == PARAGRAPH, whole)).alias("exact"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("like"),
        F.coalesce(F.sum(F.when(F.col("lane") >= 0, F.col("n"))), F.lit(0)).alias("n"),
    )
    return found.select(*keys, F.struct("exact", "like", "n").alias("print"))


def joined(a: Column, b: Column) -> Column:
    """Fingerprint of the paragraphs of both."""
    return _combine(a, b, 1)


def without(a: Column, b: Column) -> Column:
    """Fingerprint of the paragraphs of ``a`` less those of ``b``, which ``a`` holds."""
    return _combine(a, b, -1)


def _combine(a: Column, b: Column, sign: int) -> Column:
    zero = F.lit(0).cast("bigint")
    both = F.map_zip_with(a["like"], b["like"], lambda k, x, y: F.coalesce(x, zero) + sign * F.coalesce(y, zero))
    entries = F.array_sort(F.map_entries(F.map_filter(both, lambda k, v: v != 0)))
    return F.struct(
        F.zip_with(a["exact"], b["exact"], lambda x, y: F.pmod(x + sign * y, F.lit(1 << 32).cast("bigint"))).alias("exact"),
        F.map_from_entries(entries).alias("like"),
        (a["n"] + sign * b["n"]).alias("n"),
    )


def _dot(a: Column, b: Column) -> Column:
    """Inner product of the lanes."""
    of_lane = lambda s, e: s + (e["value"] * F.coalesce(F.try_element_at(b["like"], e["key"]), F.lit(0))).cast("double")
    return F.aggregate(F.map_entries(a["like"]), F.lit(0.0), of_lane)


def _square(a: Column) -> Column:
    return F.aggregate(F.map_values(a["like"]), F.lit(0.0), lambda s, x: s + (x * x).cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the estimated cosine of the two multisets of phrases; equal fingerprints have 1."""
    scale = F.sqrt(_square(a) * _square(b))
    cosine = F.when(scale > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), _dot(a, b) / scale))).otherwise(0.0)
    return F.when(a["exact"] == b["exact"], 1.0).otherwise(cosine)


def as_text(a: Column) -> Column:
    """exact in hexadecimal, the lanes as lane=count, and the number of phrases."""
    lanes = F.transform(F.map_entries(a["like"]), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    exact = F.array_join(F.transform(a["exact"], lambda x: F.lpad(F.hex(x), 8, "0")), "")
    return F.concat_ws(":", exact, F.array_join(lanes, ","), a["n"].cast("string"))


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` with fingerprint struct(exact, like, n), for every row.  Null texts count as empty."""
    own = docs.select(*keep, F.monotonically_increasing_id().alias("_row"), _units(F.coalesce(F.col(text), F.lit("")), 0).alias("_units"))
    rows = own.select(F.struct(*keep).alias("_kept"), "_row", F.explode("_units").alias("_u")).select("_kept", "_row", "_u.*")
    return _sums(rows, ["_row", "_kept"]).select("_kept.*", F.col("print").alias("fingerprint"))


def _followers(rows: DataFrame) -> DataFrame:
    """(row, id, n, copies, next): the row that follows in the order of (id, row); the first one follows the last.

    Rows are range-partitioned and written, which fixes each row's block; only the first row of each block looks
    beyond it, by way of one row per block.
    """
    parts = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(parts, "id", "row").withColumn("block", F.spark_partition_id())
    blocks = cut_lineage(ranged)
    firsts = blocks.groupBy("block").agg(F.min(F.struct("id", "row")).alias("first"))
    whole = W.orderBy("block").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    after = firsts.select("block", F.coalesce(F.lead("first").over(W.orderBy("block")), F.first("first").over(whole))["row"].alias("after"))
    inside = W.partitionBy("block").orderBy("id", "row")
    return blocks.withColumn("lead", F.lead("row").over(inside)).join(F.broadcast(after), "block").select(
        "row", "id", "n", "copies", F.coalesce("lead", "after").alias("next")
    )


def _once(joined_by_row: DataFrame) -> DataFrame:
    """One of the equal rows; the join has brought them together in order already."""
    return joined_by_row.withColumn("_n", F.row_number().over(W.partitionBy("row").orderBy("row"))).where("_n = 1").drop("_n")


def neighbour_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n/4) code points replaced by the first as many (or all) of the
    next document's, in the order of keys, the first following the last; null keys come first, different texts of
    one key follow each other.  Equal rows are one document and come back as often as they are there.  near_edited
    and near_next are the likeness of the text's fingerprint to those of the edited text and of the next document.
    Null texts count as empty, whose edited text is empty; a single document follows itself; an empty table gives
    an empty result; other columns are not read.  The texts are shuffled once; a row is known by its key and two
    hashes of its text, so that it is the same row whenever the input is read.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    name = F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("-")), F.hex(F.xxhash64(own)), F.hex(F.xxhash64(own, F.lit(1))))
    base = docs.select(F.col(key).alias("id"), name.alias("row"), own.alias("text"))
    rows = base.groupBy("id", "row", F.length("text").alias("n")).agg(F.count(F.lit(1)).alias("copies"))
    followers = cut_lineage(_followers(rows))
    texts = base.select("row", "text")
    wanted = followers.select(F.col("next").alias("row"), F.col("row").alias("of"), "id", "copies", F.floor(F.col("n") / 4).cast("int").alias("take"))
    heads = _once(texts.join(wanted, "row")).select(F.col("of").alias("row"), "id", "copies", "take", F.expr("substring(text, 1, take)").alias("head"))
    edited = F.concat(F.expr("substring(text, 1, length(text) - take)"), "head")
    pairs = _once(texts.join(heads, "row")).select("row", "id", "copies", "text", edited.alias("edited"))
    # what is known of a document travels with one unit of its own, beside the others
    facts = F.array_join(F.array(F.col("id").cast("string"), F.col("copies").cast("string"), F.length("text").cast("string"), F.sha2("edited", 256)), "|", "")
    told = F.array(F.struct(F.lit(2).alias("side"), F.lit(0).alias("lane"), F.lit(0).cast("bigint").alias("h"), F.lit(0).cast("bigint").alias("g"), facts.alias("note")))
    bare = lambda units: F.transform(units, lambda u: F.struct(u["side"], u["lane"], u["h"], u["g"], F.lit(None).cast("string").alias("note")))
    units = F.concat(told, bare(_units(F.col("text"), 0)), bare(_units(F.col("edited"), 1)))
    prints = _sums(pairs.select("row", F.explode(units).alias("u")).select("row", "u.*"), ["row", "side", "note"])
    side = lambda k: F.first(F.when(F.col("side") == k, F.col("print")), True)
    both = cut_lineage(prints.groupBy("row").agg(F.max("note").alias("note"), side(0).alias("own"), side(1).alias("edited")))
    after = both.select("row", F.col("own").alias("following")).join(wanted.select("row", "of"), "row").select(F.col("of").alias("row"), "following")
    mine, changed, following = F.col("own"), F.col("edited"), F.col("following")
    note = F.split("note", r"\|", -1)
    out = both.join(after, "row").select(
        F.when(F.get(note, F.lit(0)) != "", F.get(note, F.lit(0))).cast(docs.schema[key].dataType).alias(key),
        F.get(note, F.lit(2)).cast("bigint").alias("n_chars"), F.get(note, F.lit(3)).alias("edited_sha256"),
        as_text(mine).alias("fingerprint"), as_text(changed).alias("edited_fingerprint"),
        likeness(mine, changed).alias("near_edited"), likeness(mine, following).alias("near_next"), F.get(note, F.lit(1)).cast("int").alias("_copies"),
    )
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copy", "_copies")
