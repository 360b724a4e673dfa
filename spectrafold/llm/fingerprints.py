r"""Homomorphic multiset fingerprints of documents, in DataFrame functions only.

A paragraph is a line of the text.  It is cut into pieces, up to 64 characters of a
sentence together with the marks that end it; line ends belong to no piece, so a
paragraph has the same pieces wherever it stands, and blank lines don't count.  Each
piece hashes to a wide vector, 128 lanes of 0 or 1 and two lanes of 32 bits, and a
document's fingerprint is the sum of its pieces' vectors: exact for each 0/1 lane,
modulo 2**32 for each wide lane.  Sums don't depend on the order of pieces, and
inserting or deleting a paragraph adds or subtracts its vector (:func:`combine`).

The 0/1 lanes, centred by the number of pieces, are random signs; the cosine of two
documents' lanes estimates that of their piece counts, which gives a likeness for
documents of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import deal
from .common import literal_rows, text_of

PIECE = r"[^.!?|\r\n]{1,64}+[.!?|]*+|[.!?|]++"
_LANES = 128
#: Eight lanes of a byte are summed in one number, over at most 127 pieces at a time.
_CHUNK = 127
_BYTES = 0x0101010101010101
_LOW32 = (1 << 32) - 1
_WIDE = 2


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def _hashes(text: Column) -> Column:
    """Three hashes of each piece."""
    return F.transform(pieces(text), lambda p: F.struct(F.xxhash64(p, F.lit(1)).alias("a"), F.xxhash64(p, F.lit(2)).alias("b"), F.xxhash64(p, F.lit(3)).alias("c")))


def _right(value: Column, bits: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, bits)


def _packed(hashes: Column) -> Column:
    """Of at most _CHUNK pieces: 16 numbers of eight 0/1 lanes each, then the wide lanes."""

    def total(field: str, shift: int, mask: int) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda s, h: s + F.shiftrightunsigned(h[field], shift).bitwiseAND(F.lit(mask)))

    return F.array(*[total(f, k, _BYTES) for f in "ab" for k in range(8)], *[total("c", k, _LOW32) for k in (0, 32)])


def lanes(text: Column) -> Column:
    """The fingerprint as numbers: array<bigint> of the piece count, the 0/1 lanes and the wide lanes."""

    def sums(chunks: Column) -> Column:
        """The packed chunks' lanes, each summed on its own."""
        zero, shifts = F.lit(0).cast("long"), F.array(*[F.lit(8 * k) for k in range(8)])
        lane = lambda word, bits: F.aggregate(chunks, zero, lambda s, c: s + _right(F.get(c, word), bits).bitwiseAND(F.lit(255)))
        wide = lambda word: F.aggregate(chunks, zero, lambda s, c: (s + F.get(c, F.lit(word))).bitwiseAND(F.lit(_LOW32)))
        each = F.transform(F.sequence(F.lit(0), F.lit(_LANES // 8 - 1)), lambda word: F.transform(shifts, lambda bits: lane(word, bits)))
        return F.concat(F.flatten(each), F.array(*[wide(_LANES // 8 + k) for k in range(_WIDE)]))

    def of(hashes: Column) -> Column:
        count = F.size(hashes)
        starts = F.sequence(F.lit(1), F.greatest(count, F.lit(1)), F.lit(_CHUNK))
        chunks = F.transform(starts, lambda k: _packed(F.slice(hashes, k, F.lit(_CHUNK))))
        return F.concat(F.array(count.cast("long")), F.get(F.transform(F.array(chunks), sums), F.lit(0)))

    # one-element transforms name the hashes, and the chunks, once for all sums
    return F.get(F.transform(F.array(_hashes(text)), of), F.lit(0))


def as_text(fingerprint: Column) -> Column:
    """Hexadecimal form of :func:`lanes`."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.hex(x))), ".")


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint of the multiset sum (sign 1) or difference (sign -1) of two documents' pieces."""
    n = 1 + _LANES
    sums = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x + sign * y)
    wide = F.zip_with(F.slice(a, n + 1, _WIDE), F.slice(b, n + 1, _WIDE), lambda x, y: (x + sign * y).bitwiseAND(F.lit(_LOW32)))
    return F.concat(sums, wide)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: cosine of the centred lanes (negative ones count as 0); 1 for equal fingerprints."""

    def signs(x: Column) -> Column:
        n = F.get(x, F.lit(0))
        return F.transform(F.slice(x, 2, _LANES), lambda v: (2 * v - n).cast("double"))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    pair = F.array(F.struct(signs(a).alias("x"), signs(b).alias("y")))
    cosine = F.get(F.transform(pair, lambda p: F.try_divide(dot(p["x"], p["y"]), F.sqrt(dot(p["x"], p["x"]) * dot(p["y"], p["y"])))), F.lit(0))
    safe = F.coalesce(cosine, F.lit(0.0))
    return F.when(a == b, 1.0).when((F.get(a, F.lit(0)) == 0) | (F.get(b, F.lit(0)) == 0), 0.0).otherwise(F.least(F.greatest(safe, F.lit(0.0)), F.lit(1.0)))


def with_next(docs: DataFrame, n: int) -> DataFrame:
    """Adds next_text and next_lanes to (doc_id, text): those of the row that follows in descending doc_id; after the last comes the first.

    Rows are dealt to n ranges of ids and each range is a window of its own; the
    last row of a range takes the first row of the next range that has rows.  Those
    first rows, one for each range, are looked up by their ids.  Rows with equal ids
    follow one another in the order of their texts; null ids come last, dealt to
    ranges by their hash.
    """
    dealt = deal(docs, "doc_id", n).withColumnRenamed("__bucket", "bucket")
    tops = sorted(dealt.groupBy("bucket").agg(F.max("doc_id")).collect(), key=lambda r: -r[0])
    if not tops:
        return docs.withColumns({"lanes": lanes(F.col("text")), "next_text": F.col("text"), "next_lanes": lanes(F.col("text"))})
    serves = literal_rows(docs.sparkSession, [(b, top, tops[k - 1][0]) for k, (b, top) in enumerate(tops)], "head int, top long, serves int")
    found = dealt.join(F.broadcast(serves), (F.col("bucket") == F.col("head")) & F.col("doc_id").eqNullSafe(F.col("top")))
    heads = found.groupBy("serves").agg(F.min("text").alias("head_text")).withColumn("head_lanes", lanes(F.col("head_text")))
    order = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("doc_id"), "text")
    led = dealt.withColumn("lanes", lanes(F.col("text"))).withColumn("next", F.lead(F.struct("text", "lanes")).over(order))
    joined = led.join(heads, F.col("bucket") == F.col("serves"))
    last = F.col("next").isNull()
    return joined.select(
        "doc_id",
        "text",
        "lanes",
        F.when(last, F.col("head_text")).otherwise(F.col("next.text")).alias("next_text"),
        F.when(last, F.col("head_lanes")).otherwise(F.col("next.lanes")).alias("next_lanes"),
    )


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and its fingerprint lanes for every row; null texts count as empty, an empty text (or one of line ends only) has no pieces and a fingerprint of zeros."""
    text = text_of(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("lanes", lanes(F.col("text")))
