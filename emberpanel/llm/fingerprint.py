"""Document fingerprints by Order MinHash, in DataFrame expressions alone.

A text's k-mers (of word pieces) are numbered by occurrence. One hash of k-mer and number deals them to bins; each bin keeps its
two least, puts them in text order and hashes the pair. Equal pairs need equal k-mers in equal order, so the share of equal
bins falls with edit distance, not only with what the texts have in common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberpanel.llm.common import let

#: A k-mer's place takes the low bits of a 64-bit value, its hash the others; the hash's top bits are its bin.
_PLACE_BITS, _BIN_BITS = 24, 5
_PLACE = (1 << _PLACE_BITS) - 1
_HASH_BITS = 64 - _PLACE_BITS - _BIN_BITS
_HASH = (1 << _HASH_BITS) - 1


def _bin(value: Column) -> Column:
    return F.shiftright(value, 64 - _BIN_BITS)


def order_minhash(text: Column, *, k: int = 3, piece: int = 8) -> Column:
    """array<bigint>: a value for each bin that has k-mers, its top bits the bin.

    A k-mer is ``k`` consecutive pieces; pieces are words, cut each ``piece`` characters. A text of fewer pieces is one k-mer; one
    without any has an empty fingerprint. Whole texts count; k-mers beyond the 2^24th (a text of 32 MB at least, more than a task's
    memory holds here) stand at one place, so among them order goes by hash.
    """
    pieces = F.regexp_extract_all(text, F.lit(rf"\S{{1,{piece}}}"), F.lit(0))
    empty = F.array_remove(F.array(F.lit(0).cast("long")), F.lit(0).cast("long"))

    def grams(p: Column) -> Column:
        n = F.greatest(F.size(p) - (k - 1), F.least(F.size(p), F.lit(1)))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(p, i + j) for j in range(k)]))).otherwise(empty)

    def packed(value: Column, place: Column) -> Column:
        return value.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(F.least(place, F.lit(_PLACE)).cast("long"))

    def gram(value: Column) -> Column:
        return F.shiftright(value, _PLACE_BITS)

    def numbered(s: Column) -> Column:
        steps = F.array(*[F.lit(1 << b) for b in range(_PLACE_BITS - 1, -1, -1)])

        def number(x: Column, j: Column) -> Column:
            # Equal k-mers stand together: the farthest equal one before, found by halving steps, tells how many precede.
            back = F.aggregate(steps, F.lit(0), lambda acc, step: F.when(gram(F.get(s, j - acc - step)) == gram(x), acc + step).otherwise(acc))
            return F.when(F.coalesce(gram(F.get(s, j - 1)) == gram(x), F.lit(False)), back).otherwise(F.lit(0))

        return F.transform(s, lambda x, j: packed(F.xxhash64(gram(x), number(x, j)), x.bitwiseAND(F.lit(_PLACE))))

    def least(v: Column) -> Column:
        two = F.filter(v, lambda x, j: F.coalesce(_bin(F.get(v, j - 2)) != _bin(x), F.lit(True)))
        place = lambda x: F.shiftleft(x.bitwiseAND(F.lit(_PLACE)), _HASH_BITS)
        return F.transform(two, lambda x: F.shiftleft(_bin(x), 64 - _BIN_BITS).bitwiseOR(place(x)).bitwiseOR(gram(x).bitwiseAND(F.lit(_HASH))))

    def pairs(o: Column) -> Column:
        def pair(x: Column, j: Column) -> Column:
            before = F.get(o, j - 1)
            mixed = F.xxhash64(F.when(_bin(before) == _bin(x), before.bitwiseAND(F.lit(_HASH))), x.bitwiseAND(F.lit(_HASH)))
            value = F.shiftleft(_bin(x), 64 - _BIN_BITS).bitwiseOR(F.shiftrightunsigned(mixed, _BIN_BITS))
            return F.when(F.coalesce(_bin(F.get(o, j + 1)) != _bin(x), F.lit(True)), value)

        return F.filter(F.transform(o, pair), lambda x: x.isNotNull())

    def sorted_grams(h: Column) -> Column:
        return F.sort_array(F.transform(h, packed))

    out = let(pieces, lambda p: let(grams(p), lambda h: let(sorted_grams(h), lambda s: let(F.sort_array(numbered(s)), lambda v: let(F.sort_array(least(v)), pairs)))))
    return F.coalesce(out, empty)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the root of the share of bins with equal pairs, as a pair agrees if both its k-mers do. Two empty ones are alike."""
    bins = F.size(F.array_union(F.transform(a, _bin), F.transform(b, _bin)))
    return F.when(bins == 0, 1.0).otherwise(F.sqrt(F.size(F.array_intersect(a, b)) / bins))


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def with_next(docs: DataFrame, id_col: str, columns: list[str], tie: str, *, rows: int = 500, most: int = 200_000) -> DataFrame:
    """Add ``next``, a struct of ``columns`` of the row with the next higher id (after the last: of the first).

    Ids are dealt to ranges of about ``rows`` rows, at most ``most`` ranges, whose bounds are ids of the table. The first row of a
    range also goes to the range before it, so a row finds its follower there, and rows move once. Equal ids stand by
    ``tie``; null ids come first.
    """
    n, nulls, low = docs.agg(F.count("*"), F.count_if(F.col(id_col).isNull()), F.min(id_col)).first()
    ranges = min(most, max(1, -(-n // rows)))
    found = docs.agg(F.percentile_approx(id_col, [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0] if ranges > 1 and n > nulls else []
    bounds = sorted({b for b in found or [] if b > low})
    own = F.lit(0)
    if bounds:
        id_type = docs.schema[id_col].dataType
        listed = F.array(*[F.lit(b).cast(id_type) for b in bounds]) if len(bounds) <= 256 else F.from_json(F.lit(str(bounds)), f"array<{id_type.simpleString()}>")
        steps = F.array(*[F.lit(1 << b) for b in range(len(bounds).bit_length() - 1, -1, -1)])
        own = F.coalesce(F.aggregate(steps, F.lit(0), lambda acc, step: F.when(F.get(F.col("_bounds"), acc + step - 1) <= F.col(id_col), acc + step).otherwise(acc)), F.lit(0))
        docs = docs.withColumn("_bounds", listed)
    else:
        docs = docs.withColumn("_bounds", F.array())
    docs = docs.withColumn("_range", own)
    first = F.col(id_col).isNull() if nulls else F.col(id_col) == F.lit(low)
    starts = F.coalesce(F.get("_bounds", F.col("_range") - 1) == F.col(id_col), F.lit(False)) if bounds else F.lit(False)
    places = F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("copy")), F.when(starts, F.struct((F.col("_range") - 1).alias("r"), F.lit(1).alias("copy"))), F.when(first, F.struct(F.lit(len(bounds)).alias("r"), F.lit(2).alias("copy"))))
    dealt = docs.withColumn("_place", F.explode(F.filter(places, lambda x: x.isNotNull()))).drop("_bounds", "_range")
    order = Window.partitionBy("_place.r").orderBy("_place.copy", F.col(id_col).asc_nulls_first(), tie)
    return dealt.withColumn("next", F.lead(F.struct(*columns)).over(order)).where("_place.copy = 0").drop("_place")


def compare_with_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of the text with its last quarter replaced by the start of the next document.

    Returns ``id_col``, n_chars, edited (the edited text), fingerprint, edited_fingerprint, near_edited, near_next. The last
    floor(n_chars/4) code points are replaced by as many of the next document's first, or all it has; the next document is the
    one of the next higher id, after the last the first. Null text is empty. Equal texts have equal fingerprints. Repeated ids
    follow each other by their texts' hash; a lone document follows itself; null ids come first. Ids are numbers. Whole texts
    count, but for the order beyond 2^24 k-mers (see ``order_minhash``). An empty table gives no rows. Other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    base = base.withColumn("_tie", F.xxhash64("_text")).withColumn("_print", order_minhash(F.col("_text")))
    rows = with_next(base, "_id", ["_text", "_print"], "_tie")
    n = F.length("_text")
    cut = F.floor(n / 4).cast("int")
    rows = rows.withColumn("_edited", F.concat(F.substring(F.col("_text"), F.lit(1), n - cut), F.substring(F.col("next._text"), F.lit(1), cut)))
    rows = rows.withColumn("_edited_print", order_minhash(F.col("_edited")))
    return rows.select(
        F.col("_id").alias(id_col),
        n.cast("long").alias("n_chars"),
        F.col("_edited").alias("edited"),
        as_text(F.col("_print")).alias("fingerprint"),
        as_text(F.col("_edited_print")).alias("edited_fingerprint"),
        likeness(F.col("_print"), F.col("_edited_print")).alias("near_edited"),
        likeness(F.col("_print"), F.col("next._print")).alias("near_next"),
    )
