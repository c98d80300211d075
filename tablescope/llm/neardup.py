"""Near-duplicate documents by b-bit MinHash.

1. Every document becomes its set of hashed word shingles; documents with one set are one class.
2. A class carries minima of hash functions: whole minima are banded into bucket keys, two low bits of each are
   packed into the signature.
3. Classes that share a bucket are hooked to the smallest class of the bucket, which gives groups of candidates;
   no bucket is expanded into pairs.
4. A group is cut into blocks; a task gets two blocks, estimates all its pairs by counting equal low bits
   (corrected for chance), confirms on full sets every pair whose estimate is not far below the threshold and
   whose ends are not linked yet, and returns a forest of links: fewer rows than it got.
5. The links' components are the result.

The bands are chosen so that a pair at the threshold is missed less than once in a hundred thousand, and the
estimate rejects a pair at the threshold about as seldom as five standard deviations are exceeded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.blocks import cut_lineage
from .graph import components
from .kernels import U, Words, flat, mix, slices, texts_of

BITS = 2
"""Low bits kept of each minimum."""
MISS = 1e-5
"""Chance that a pair at the threshold shares no band."""
BLOCK = 128
"""Classes in a block; a task holds two blocks."""
SEED = 20231


def bands_for(threshold: float) -> tuple[int, int]:
    """(rows per band, bands): the longest bands that need at most 40 of them."""
    best = (1, math.ceil(math.log(MISS) / math.log(1 - threshold)) if threshold < 1 else 1)
    for rows in range(2, 13):
        need = math.ceil(math.log(MISS) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if need <= 40:
            best = (rows, need)
    return best


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct shingle hashes of each text, ascending; those of text d are first[d]:first[d+1]."""
    w = Words(texts, lower=True)
    where, hashes = w.runs(words)
    doc = w.doc[where]
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        whole = np.empty(len(short), U)
        for i, d in enumerate(short):
            own = w.hash[w.first[d] : w.first[d + 1]]
            value = U(len(own))
            for h in own:
                value = mix(np.array([value ^ h], U))[0]
            whole[i] = value
        doc, hashes = np.concatenate([doc, short]), np.concatenate([hashes, whole])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    doc, hashes = doc[new], hashes[new]
    return hashes, np.searchsorted(doc, np.arange(len(texts) + 1))


def signatures(hashes: np.ndarray, first: np.ndarray, rows: int, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """(packed low bits, band keys) of non-empty sets."""
    rng = np.random.default_rng(SEED)
    factors = rng.integers(1, 1 << 63, rows * bands, dtype=np.uint64) * U(2) + U(1)
    shifts = rng.integers(0, 1 << 63, rows * bands, dtype=np.uint64)
    minima = np.empty((rows * bands, len(first) - 1), U)
    buffer = np.empty(len(hashes), U)
    for i in range(rows * bands):
        np.multiply(hashes, factors[i], out=buffer)
        np.add(buffer, shifts[i], out=buffer)
        minima[i] = np.minimum.reduceat(buffer, first[:-1])
    minima = mix(minima)
    keys = np.empty((len(first) - 1, bands), U)
    for b in range(bands):
        value = np.full(len(first) - 1, b + 1, U)
        for r in range(rows):
            value = mix(value * U(0x9E3779B97F4A7C15) + minima[b * rows + r])
        keys[:, b] = value
    per = 64 // BITS
    n_long = -(-rows * bands // per)
    packed = np.zeros((len(first) - 1, n_long), U)
    for i in range(rows * bands):
        packed[:, i // per] |= (minima[i] & U((1 << BITS) - 1)) << U(BITS * (i % per))
    return packed, keys


SIGNED = "id bigint, text_id bigint, n_shingles bigint, set_id bigint, check_id bigint, signature binary, bands array<bigint>"


def _sign(words: int, rows: int, bands: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("text_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.int64()), ("check_id", pa.int64()), ("signature", pa.binary()), ("bands", pa.list_(pa.int64()))])
        for batch in batches:
            texts = texts_of(batch.column(2))
            for a, b in slices(texts):
                hashes, first = shingle_sets(texts[a:b], words)
                n = np.diff(first)
                full = np.flatnonzero(n)
                set_id, check_id = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
                packed: list = [None] * (b - a)
                keys: list = [None] * (b - a)
                if len(full):
                    starts = np.concatenate([first[full], first[-1:]])
                    set_id[full] = mix(np.add.reduceat(mix(hashes ^ U(77)), starts[:-1])).view(np.int64)
                    check_id[full] = np.add.reduceat(mix(hashes * U(3) ^ U(5)), starts[:-1]).view(np.int64)
                    sig, key = signatures(hashes, starts, rows, bands)
                    key = key.view(np.int64)
                    for i, d in enumerate(full):
                        packed[d], keys[d] = sig[i].tobytes(), key[i]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n, pa.int64()), pa.array(set_id), pa.array(check_id), pa.array(packed, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    schema=schema,
                )

    return sign


def _shingles(words: int):
    """(rep, head, group, block, blocks, signature, text) to the same with the set in place of the text."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(batch.num_columns - 1))
            for a, b in slices(texts):
                hashes, first = shingle_sets(texts[a:b], words)
                sets = [hashes[first[i] : first[i + 1]].tobytes() for i in range(b - a)]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sets, pa.binary())], names=[*part.schema.names[:-1], "shingles"])

    return shingle


def _confirm(threshold: tuple[int, int], hashes_used: int):
    """Links among the classes of two blocks (or of one), as a forest."""
    part, whole = threshold
    t = part / whole
    chance = 2.0**-BITS
    p = t + (1 - t) * chance
    least = p - 5 * math.sqrt(p * (1 - p) / hashes_used)

    def confirm(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        names = np.rec.fromarrays([table["rep"].to_numpy(), table["head"].to_numpy()], dtype=[("rep", "<i8"), ("head", "<i8")])
        names, once = np.unique(names, return_index=True)
        table, reps = table.take(pa.array(once)), names["rep"]
        blocks = table["block"].to_numpy()
        sets = [np.frombuffer(x, U) for x in table["shingles"].to_pylist()]
        sig = np.frombuffer(b"".join(table["signature"].to_pylist()), U).reshape(len(reps), -1)
        size = np.array([len(s) for s in sets], np.int64)
        low, high = int(key[1].as_py()), int(key[2].as_py())
        root = list(range(len(reps)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        even = U(0x5555555555555555)
        pad = sig.shape[1] * 64 // BITS - hashes_used
        wanted, first, second = [], [], []
        right = np.flatnonzero(blocks == high)
        for i in np.flatnonzero(blocks == low):
            js = right[right > i] if low == high else right
            js = js[(size[js] * whole >= part * size[i]) & (size[i] * whole >= part * size[js])]
            if not len(js):
                continue
            diff = sig[js] ^ sig[i]
            unequal = np.bitwise_count((diff | (diff >> U(1))) & even).sum(axis=1, dtype=np.int64)
            share = (sig.shape[1] * 64 // BITS - pad - unequal) / hashes_used
            good = share >= least
            first.append(np.full(int(good.sum()), i))
            second.append(js[good])
            wanted.append(share[good])
        a_out, b_out = [], []
        if wanted:
            first, second, wanted = np.concatenate(first), np.concatenate(second), np.concatenate(wanted)
            for k in np.argsort(-wanted, kind="stable"):
                i, j = int(first[k]), int(second[k])
                if find(i) == find(j):
                    continue
                both = len(sets[i]) + len(sets[j])
                merged = np.concatenate([sets[i], sets[j]])
                merged.sort()
                common = int((merged[1:] == merged[:-1]).sum())
                if whole * common >= part * (both - common):
                    root[find(j)] = find(i)
                    a_out.append(int(reps[i]))
                    b_out.append(int(reps[j]))
        return pa.table({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})

    return confirm


def near_duplicates(
    docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (80, 100), key: str = "doc_id", text: str = "text", block: int = BLOCK,
    by_text: bool = False,
) -> DataFrame:
    """Per row: key, n_shingles, component_id (smallest key linked, itself included) and kept (it is that key).

    Texts are lower-cased in A-Z; a set holds the distinct runs of ``words`` words, or the whole sequence of a
    shorter text.  Two texts are linked when |A and B| * threshold[1] >= |A or B| * threshold[0], confirmed on the
    full sets.  Null and empty texts have no set and link with nothing; a row without a key links with nothing
    either: its component_id is null and it is kept.  A repeated row comes back as often as it is there.  An id with
    several texts is one document: all its texts are compared, each by its own set, and links of any of them are links
    of the id (a row of it without words keeps the id itself).  An empty table gives an empty result; other columns are
    not read.

    With ``by_text`` an id's texts are documents of their own.  The result is then (key, text_id, component_id): a
    64-bit hash of the text, and a number the rows of one component share, null for those that link with nothing by rule.
    """
    rows, bands = bands_for(threshold[0] / threshold[1])
    t = threshold
    same_set = ["set_id", "check_id", "n_shingles"]
    read = docs.select(F.col(key).cast("bigint").alias("id"), F.xxhash64(text).alias("text_id"), F.col(text).alias("text"))
    signed = cut_lineage(read.mapInArrow(_sign(words, rows, bands), SIGNED))
    named = signed.where("id is not null and n_shingles > 0")
    # a class of equal sets goes by its smallest id and, as an id may have several texts, by one text of that id
    classes = named.groupBy(*same_set).agg(
        F.min("id").alias("rep"), F.min_by("text_id", F.struct("id", "text_id")).alias("head"),
        F.first("signature").alias("signature"), F.first("bands").alias("bands"),
    )
    classes = cut_lineage(classes.withColumn("node", F.monotonically_increasing_id() if by_text else F.col("rep")))
    heads = classes.select("node", F.col("rep").alias("id"), "head", "signature")
    banded = classes.select(F.col("node").alias("rep"), F.explode("bands").alias("bucket"))
    leaders = banded.groupBy("bucket").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader <> last")
    hooks = banded.join(leaders.select("bucket", "leader"), "bucket").where("rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b"))
    groups = cut_lineage(components(hooks).select(F.col("node").alias("rep"), F.col("root").alias("grp")))
    sizes = groups.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = (
        groups.join(sizes, "grp")
        .join(heads.withColumnRenamed("id", "_id"), F.col("rep") == F.col("node"))
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    )
    head_text = (F.col("id") == F.col("_id")) & (F.col("text_id") == F.col("head"))
    texts = read.where("id is not null").join(placed, head_text).select("rep", "head", "grp", "block", "blocks", "signature", "text")
    kinds = "rep bigint, head bigint, grp bigint, block int, blocks int, signature binary, shingles binary"
    sets = texts.mapInArrow(_shingles(words), kinds)
    pairs = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "rep", "head", "grp", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "signature", "shingles"
    )
    links = pairs.groupBy("grp", "low", "high").applyInArrow(_confirm(t, rows * bands), "a bigint, b bigint")
    if not by_text:
        members = named.join(classes.select(*same_set, "rep"), same_set).select("id", "rep")
        several = members.groupBy("id").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least <> most")
        bridges = members.join(several.select("id", "least"), "id").where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b"))
        links = links.unionByName(bridges)
    roots = components(links).withColumnRenamed("node", "_node")
    of_class = classes.join(roots, classes["node"] == roots["_node"], "left").select(
        "set_id", "check_id", F.col("n_shingles").alias("n"), F.coalesce("root", "node").alias("root")
    )
    joined = signed.drop("signature", "bands").join(
        of_class,
        (signed["set_id"] == of_class["set_id"]) & (signed["check_id"] == of_class["check_id"]) & (signed["n_shingles"] == of_class["n"]) & F.col("id").isNotNull(),
        "left",
    )
    if by_text:
        return joined.select(F.col("id").alias(key), "text_id", F.col("root").alias("component_id"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    return joined.select(
        F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )
