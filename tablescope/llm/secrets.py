"""Secrets in texts, with multipart credentials linked by position; DataFrame functions only.

Base spans follow three fixed formats and always stay: assign (a telling name, a sign, a value), access (key ids)
and hex (long runs of hexadecimal digits).  Weak candidates are endpoints (addresses with a scheme), identities (a
user or client name with a value) and bare tokens of mixed letters and digits.  A weak candidate is reported only
when a complementary part lies in its scope, the ``SCOPE`` characters before and after its start: an endpoint or an
identity needs a secret there (assign, hex or a bare token), a bare token an access id, an identity or an endpoint.
The interval join of parts within scopes is a window ranging over positions, so no pairs of parts are made, and a
document's parts are the only rows that move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SCOPE = 200

# The formats of the base spans.
ASSIGN = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

ENDPOINT = r"[a-z][a-z0-9+]{1,15}://[A-Za-z0-9._~:@/?&%=+-]{3,}"
IDENTITY = r"([Uu][Ss][Ee][Rr]([Nn][Aa][Mm][Ee])?|[Ll][Oo][Gg][Ii][Nn]|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd])[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@+-]{3,}"
BARE = r"[A-Za-z0-9+/_=-]{16,}"

KINDS = ("assign", "access", "hex", "endpoint", "identity", "bare")
PATTERNS = (ASSIGN, ACCESS, HEX, ENDPOINT, IDENTITY, BARE)
BASE = 3


def _parts(text: Column, kind: int, pattern: str) -> Column:
    """Array of (kind, number, characters before since the last match, characters of the match, fit) for each match.

    Splitting gives what lies between the matches, so positions are running sums of lengths.
    """
    rule = F.lit(pattern)
    found = F.arrays_zip(
        F.regexp_extract_all(text, rule, F.lit(0)).alias("hit"),
        (F.regexp_extract_all(text, rule, F.lit(2)) if kind == 0 else F.regexp_extract_all(text, rule, F.lit(0))).alias("value"),
        F.split(text, pattern, -1).alias("gap"),
    )

    def row(x: Column, i: Column) -> Column:
        if kind == 0:
            fit = F.length(x["value"]) >= 6
        elif kind == KINDS.index("bare"):
            fit = x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]")
        else:
            fit = F.lit(True)
        return F.struct(F.lit(kind).alias("kind"), i.alias("number"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("size"), fit.alias("fit"))

    rows = F.filter(F.transform(found, row), lambda x: x["size"].isNotNull())
    return F.when(text.rlike(pattern), rows)


def secret_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per row: key, n_assign, n_access, n_hex, base and spans (kind:start:end by start, then kind; code points, end exclusive).

    Null and empty texts have no spans; repeated rows and null keys come back as they are (rows are told apart by
    their place in the input); an empty table gives an empty result; other columns are not read.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    nothing = F.array().cast("array<struct<kind:int,number:int,gap:int,size:int,fit:boolean>>")
    read = docs.select(F.col(key).alias("id"), F.monotonically_increasing_id().alias("row"), own.alias("text"))
    parts = F.concat(*[F.coalesce(_parts(F.col("text"), k, p), nothing) for k, p in enumerate(PATTERNS)])
    rows = read.select("id", "row", F.explode_outer(parts).alias("p")).select("id", "row", "p.*")
    order = W.partitionBy("row", "kind").orderBy("number").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.repartition("row").withColumn("end", F.sum(F.col("gap") + F.col("size")).over(order))
    rows = rows.withColumn("start", F.col("end") - F.col("size"))
    # a weak candidate that overlaps a base span is part of it
    strong = (F.col("kind") < BASE) & F.col("fit")
    # a sentinel row of a document without parts has no kind and stays
    place = W.partitionBy("row").orderBy("start", "kind")
    rows = rows.withColumns({
        "reached": F.max(F.when(strong, F.col("end"))).over(place.rowsBetween(W.unboundedPreceding, -1)),
        "next": F.min(F.when(strong, F.col("start"))).over(place.rowsBetween(1, W.unboundedFollowing)),
    })
    weak = (
        (F.col("kind") >= BASE)
        & F.col("fit")
        & (F.coalesce(F.col("reached"), F.lit(0)) <= F.col("start"))
        & (F.coalesce(F.col("next"), F.col("end")) >= F.col("end"))
    )
    rows = rows.withColumn("weak", weak)
    # a bare token inside an address or a name is part of it, and no complement of it
    holder = F.col("weak") & F.col("kind").isin(3, 4)
    rows = rows.withColumns({
        "held": F.max(F.when(holder, F.col("end"))).over(place.rowsBetween(W.unboundedPreceding, -1)),
        "holds": F.min(F.when(holder, F.col("start"))).over(place.rowsBetween(1, W.unboundedFollowing)),
    })
    free = (F.coalesce(F.col("held"), F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("holds"), F.col("end")) >= F.col("end"))
    rows = rows.withColumn("weak", F.col("weak") & ((F.col("kind") != 5) | free))
    near = W.partitionBy("row").orderBy("start").rangeBetween(-scope, scope)
    kind = F.col("kind")
    usable = strong | F.col("weak")
    secret = F.max(F.when(usable & kind.isin(0, 2, 5), 1)).over(near).isNotNull()
    owner = F.max(F.when(usable & kind.isin(1, 3, 4), 1)).over(near).isNotNull()
    linked = F.col("weak") & F.when(kind == 5, F.col("owner")).otherwise(F.col("secret"))
    rows = rows.withColumns({"secret": secret, "owner": owner}).withColumn("told", F.coalesce(strong | linked, F.lit(False)))
    # of overlapping weak spans all are told: parts of one credential

    def told(which: Column) -> Column:
        spans = F.array_sort(F.collect_list(F.when(which, F.struct("start", "kind", "end"))))
        names = F.array(*[F.lit(k) for k in KINDS])
        one = lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"], F.lit(":"), s["end"])
        return F.array_join(F.transform(spans, one), ",")

    def count(k: int) -> Column:
        return F.count(F.when(strong & (kind == k), 1)).alias(f"n_{KINDS[k]}")

    out = rows.groupBy("row").agg(
        F.first("id").alias(key), *[count(k) for k in range(BASE)], told(strong).alias("base"), told(F.col("told")).alias("spans")
    )
    return out.drop("row")
