"""Document fingerprints by Order MinHash (Marçais et al., 2019), in DataFrame terms.

A text is a row of units (words, long ones in pieces of eight characters). Its k-mers
are numbered by occurrence, so that repeats count as different. Each of the sketches
hashes them anew, splits them in two by one bit of that hash and takes the least of
either half; the two are put in text order and hashed as a tuple. Equal tuples need
equal k-mers in equal order, so the share of equal sketches falls with edit distance
and not only with the set of words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.session import materialize

KMER = 3
SKETCHES = 32
_UNIT = r"[^\x20\x09-\x0D]{1,8}"
#: A position takes the low 30 bits of a packed value (a text has fewer units), the
#: hash the rest.
_POSITION_BITS = 30
_POSITIONS = (1 << _POSITION_BITS) - 1


def _packed(hashed: Column, position: Column) -> Column:
    high = F.shiftleft(F.shiftrightunsigned(hashed, _POSITION_BITS), _POSITION_BITS)
    return high.bitwiseOR(position.cast("long"))


def _hash_part(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, _POSITION_BITS)


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later steps read without the optimizer copying its expression."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def sketches(rows: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """(keys, fingerprint) with one row per distinct ``keys``, which name a text each.

    The fingerprint has four bytes per sketch. A text of fewer units
    than a k-mer is one k-mer, one without units has the fingerprint of nothing.
    Where ``rows`` is dealt out by one of the keys, nothing is shuffled.
    """
    units = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(_UNIT), F.lit(0))
    rows = _once(rows, "__u", units)
    size = F.size("__u")
    window = F.when(size == 0, F.array().cast("array<long>")).when(
        size < KMER, F.array(_packed(F.xxhash64(F.array_join("__u", " ")), F.lit(0)))
    )
    numbered = F.transform(
        F.sequence(F.lit(0), size - KMER),
        lambda i: _packed(F.xxhash64(*(F.get("__u", i + k) for k in range(KMER))), i),
    )
    rows = _once(rows, "__s", F.sort_array(window.otherwise(numbered))).drop("__u", text_col)
    size = F.size("__s")
    starts = F.when(size == 0, F.array().cast("array<int>")).otherwise(
        F.filter(
            F.sequence(F.lit(0), size - 1),
            lambda i: (i == 0) | (_hash_part(F.get("__s", i)) != _hash_part(F.get("__s", i - 1))),
        )
    )
    rows = _once(rows, "__r", starts)
    runs = F.transform(
        "__r", lambda start, j: F.sequence(F.lit(0), F.coalesce(F.get("__r", j + 1), F.size("__s")) - start - 1)
    )
    occurrence = F.when(F.size("__r") == F.size("__s"), F.array_repeat(F.lit(0), F.size("__s")))
    rows = rows.select(
        *keys,
        F.explode_outer(
            F.arrays_zip(F.col("__s").alias("p"), occurrence.otherwise(F.flatten(runs)).alias("o"))
        ).alias("__k"),
    )
    rows = rows.select(
        *keys,
        F.col("__k.p").bitwiseAND(_POSITIONS).alias("__at"),
        F.when(F.col("__k.p").isNotNull(), F.xxhash64(_hash_part(F.col("__k.p")), "__k.o")).alias("__h"),
    )
    least = []
    for j in range(SKETCHES):
        hashed = F.xxhash64("__h", F.lit(j))
        for half in range(2):
            own = F.col("__h").isNotNull() & (hashed.bitwiseAND(1) == half)
            least.append(F.min(F.when(own, _packed(hashed, F.col("__at")))).alias(f"__m{j}_{half}"))
    found = rows.groupBy(*keys).agg(*least)
    parts = []
    for j in range(SKETCHES):
        a, b = F.col(f"__m{j}_0"), F.col(f"__m{j}_1")
        first = a.bitwiseAND(_POSITIONS) <= b.bitwiseAND(_POSITIONS)
        swapped = F.xxhash64(_hash_part(b), _hash_part(a))
        value = F.when(first | a.isNull() | b.isNull(), F.xxhash64(_hash_part(a), _hash_part(b))).otherwise(swapped)
        parts.append(F.lpad(F.lower(F.hex(value.bitwiseAND(0xFFFFFFFF))), 8, "0"))
    return found.select(*keys, F.unhex(F.concat(*parts)).alias("fingerprint"))


def digits(fingerprint: Column) -> Column:
    """A fingerprint in lower-case hexadecimal, eight digits per sketch."""
    return F.lower(F.hex(fingerprint))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal sketches of two fingerprints, 0 to 1."""
    same = [(F.substring(a, 4 * j + 1, 4) == F.substring(b, 4 * j + 1, 4)).cast("int") for j in range(SKETCHES)]
    return reduce(lambda x, y: x + y, same) / F.lit(float(SKETCHES))


def next_ids(ids: DataFrame) -> DataFrame:
    """(id, next_id): the next lower distinct id; after the least comes the greatest.

    Ids alone are dealt out by range; each range is a window of its own, and one row
    per range (as many as shuffle partitions) says where the next begins.
    """
    spark = ids.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = ids.distinct().repartitionByRange(count, F.col("id").desc())
    dealt = materialize(dealt.select("id", F.spark_partition_id().alias("part")), "ids")
    heads = dealt.groupBy("part").agg(F.max("id").alias("head"))
    after = F.lead("head").over(Window.orderBy("part"))
    top = dealt.agg(F.max("id")).first()[0]
    heads = heads.select("part", F.coalesce(after, F.lit(top)).alias("after"))
    within = F.lead("id").over(Window.partitionBy("part").orderBy(F.col("id").desc()))
    rows = dealt.select("id", "part", within.alias("within")).join(heads, "part")
    return rows.select("id", F.coalesce("within", "after").alias("next_id"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) per row of ``docs``, repeated rows and null texts included."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    return sketches(rows, "text", ["id", "row"]).select("id", digits(F.col("fingerprint")).alias("fingerprint"))


def _both_sketches(rows: DataFrame) -> DataFrame:
    """Fingerprints of the texts and edited texts of rows (id, next_id, text, head)."""
    third = "cast(length(text) div 3 as int)"
    edited = F.expr(
        f"concat(substring(text, 1, length(text) - {third}), substring(coalesce(head, ''), 1, {third}))"
    )
    rows = rows.select(
        "id",
        F.monotonically_increasing_id().alias("row"),
        F.length("text").alias("n_chars"),
        "next_id",
        "text",
        edited.alias("edited"),
    )
    sha = F.sha2(F.col("edited").cast("binary"), 256)
    both = F.explode(
        F.array(
            F.struct(F.lit(False).alias("edited"), F.lit("").alias("sha"), F.col("text").alias("text")),
            F.struct(F.lit(True).alias("edited"), sha.alias("sha"), F.col("edited").alias("text")),
        )
    )
    keys = ["id", "row", "n_chars", "next_id"]
    each = rows.select(*keys, both.alias("x")).select(*keys, "x.edited", "x.sha", "x.text")
    return sketches(each, "text", [*keys, "edited", "sha"])


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of an edited copy, and how alike they are.

    Returns (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next) per row. The edited copy ends in the beginning of the next document
    (the next lower id; after the last the first) in place of its own last third. If an
    id is repeated, the least of its texts is what its predecessor gets; all its rows
    are reported. A row without an id has no next document: nothing is put in place of
    its last third, and near_next is 0. A null text counts as empty.

    Texts are shuffled once, by id; both uses read that shuffle.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    known, unknown = rows.where("id is not null"), rows.where("id is null")
    counted = known.groupBy("id").agg(
        F.max(F.length("text")).alias("longest"), F.count("*").alias("n")
    )
    counted = materialize(counted, "lengths")
    following = materialize(next_ids(counted.select("id")), "next")
    needed = following.join(counted.select("id", "longest"), "id").select(
        F.col("next_id").alias("id"),
        F.col("id").alias("for_id"),
        (F.col("longest") / 3).cast("int").alias("most"),
    )
    heads = known.join(needed, "id").select("for_id", F.expr("substring(text, 1, most)").alias("head"), "text")
    repeated = counted.where("n > 1").select(F.col("id").alias("next_id"))
    if repeated.head(1):
        by_id = following.join(repeated, "next_id", "left_semi").select(F.col("id").alias("for_id"))
        several = heads.join(by_id, "for_id", "left_semi").groupBy("for_id").agg(
            F.min_by("head", "text").alias("head")
        )
        heads = heads.join(by_id, "for_id", "left_anti").select("for_id", "head").unionByName(several)
    heads = heads.select(F.col("for_id").alias("id"), "head").join(following, "id")
    both = known.join(heads, "id", "left").select("id", "next_id", "text", "head")
    found = materialize(_both_sketches(both), "fingerprints")
    if unknown.head(1):
        alone = unknown.select("id", F.col("id").alias("next_id"), "text", F.lit("").alias("head"))
        more = _both_sketches(alone).withColumn("row", -1 - F.col("row"))
        found = found.unionByName(materialize(more, "fingerprints"))
    keys = ["id", "row", "n_chars", "next_id"]
    own = found.where("not edited").select(*keys, "fingerprint")
    other = found.where("edited").select(
        "row", F.col("sha").alias("edited_sha256"), F.col("fingerprint").alias("edited_fingerprint")
    )
    next_own = own.groupBy(F.col("id").alias("next_id")).agg(F.min("fingerprint").alias("next_fingerprint"))
    result = own.join(other, "row").join(next_own, "next_id", "left")
    return result.select(
        "id",
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        digits(F.col("fingerprint")).alias("fingerprint"),
        digits(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        F.coalesce(likeness(F.col("fingerprint"), F.col("next_fingerprint")), F.lit(0.0)).alias("near_next"),
    )
