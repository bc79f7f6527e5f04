"""Document fingerprints by Order MinHash, in DataFrame operations only.

A text's k-mers (``k`` consecutive words; the last ones are cut short by the end
of the text, so every text with a word has some) are numbered by occurrence and
put in one random order: a first occurrence by the k-mer's hash, every further one by
a hash of that and its number, so how often a passage repeats counts.
The order's range is cut in ``BINS`` equal parts.  From each part the ``PER_BIN``
smallest k-mers are selected, put back in the order in which they stand in the
text, and the tuple is hashed.  Two texts agree in a part if they hold the same
smallest k-mers in the same order, which an edit or a move disturbs; the share
of agreeing parts (of those that either text fills) is their likeness.

Every k-mer is one long (part, hash, place in the text).  After one sort of this
primitive array equal k-mers stand together in text order: the lengths of their runs
number the occurrences, and a text that repeats any is sorted again by the numbered
hashes.  Selecting is one comparison with the neighbour ``PER_BIN`` before.  No
row is exploded, and no Python runs.

For pairs of neighbours, documents are dealt into buckets of consecutive ids (cut
points are ids of the table, found by an approximate percentile over all rows), and
the largest row of a bucket is also laid at the end of the bucket above.  So each text
moves once and no task orders the whole table.

Defined results: a null text counts as empty; a text without words fills no part,
and two such texts have likeness 1.  Repeated rows and repeated ids are ordered by
the hash of their texts and are each other's neighbours; a null id sorts below all
others.  Texts are read whole; beyond 2^24 words, places count modulo 2^24.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Parts of the order (as bits), k-mers selected from each, words per k-mer.
BIN_BITS, PER_BIN, K = 5, 2, 3
BINS = 1 << BIN_BITS
#: Rows per bucket of neighbours, and the most buckets.
PER_BUCKET, MOST_BUCKETS = 100, 16_384

_PLACE = 24
_HASH = 63 - BIN_BITS - _PLACE


def _long(v: int) -> Column:
    return F.lit(v).cast("bigint")


def _part(x: Column) -> Column:
    return F.shiftright(x, 63 - BIN_BITS)


def _numbered(df: DataFrame, step: str, top: int) -> DataFrame:
    """The sorted k-mers ``step`` with every occurrence after the first under a hash
    of its own, in order again."""
    x, first = F.col(step), f"{step}_first"
    hash_of = lambda v: F.shiftright(v, _PLACE)
    starts = F.filter(F.zip_with(F.transform(x, lambda v, i: F.struct(v.alias("v"), i.alias("i"))),
                                 F.concat(F.array(_long(-1)), x),
                                 lambda a, b: F.when(hash_of(a["v"]) != hash_of(b), a["i"])), lambda i: i.isNotNull())
    df = df.withColumn(first, starts)
    ends = F.concat(F.slice(first, 2, F.size(first)), F.array(F.size(x)))
    number = F.flatten(F.zip_with(first, ends, lambda a, b: F.sequence(F.lit(0), b - a - 1)))
    again = F.zip_with(x, number, lambda v, n: F.when(n == 0, v).otherwise(
        F.xxhash64(hash_of(v), n.cast("bigint")).bitwiseAND(_long(top)).bitwiseOR(
            v.bitwiseAND(_long((1 << _PLACE) - 1)))))
    return df.withColumn(step, F.when(F.size(first) == F.size(x), x).otherwise(F.sort_array(again))).drop(first)


def with_fingerprint(df: DataFrame, text: str, out: str, *, k: int = K) -> DataFrame:
    """``df`` with ``out``: one long per part, null where the text fills it not."""
    step = f"__{out}"
    df = df.withColumn(step, F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != ""))
    kmers = F.transform(F.col(step), lambda w: F.xxhash64(w))
    for i in range(1, k):                                # lengthened word by word
        kmers = F.zip_with(kmers, F.slice(F.col(step), i + 1, F.greatest(F.size(step), F.lit(1))),
                           lambda a, b: F.xxhash64(a, b))
    top = ((1 << 63) - 1) ^ ((1 << _PLACE) - 1)
    packed = F.transform(kmers, lambda h, i: h.bitwiseAND(_long(top)).bitwiseOR(
        i.cast("bigint").bitwiseAND(_long((1 << _PLACE) - 1))))
    df = _numbered(df.withColumn(step, F.sort_array(packed)), step, top)
    before = F.concat(F.array(*[_long(-1)] * PER_BIN), F.col(step))
    chosen = F.filter(F.zip_with(F.col(step), before, lambda x, y: F.when(_part(x) != _part(y), x)),
                      lambda x: x.isNotNull())
    in_text_order = F.sort_array(F.transform(chosen, lambda x: x.bitwiseAND(_long((BINS - 1) << 63 - BIN_BITS)).bitwiseOR(
        F.shiftleft(x.bitwiseAND(_long((1 << _PLACE) - 1)), _HASH)).bitwiseOR(
        F.shiftright(x, _PLACE).bitwiseAND(_long((1 << _HASH) - 1)))))
    df = df.withColumn(step, in_text_order)
    of_part = lambda b: F.transform(F.filter(F.col(step), lambda x: _part(x) == b),
                                    lambda x: x.bitwiseAND(_long((1 << _HASH) - 1)))
    tuples = F.transform(F.sequence(_long(0), _long(BINS - 1)), of_part)
    codes = F.transform(tuples, lambda t: F.when(F.size(t) > 0, F.xxhash64(t)))
    # The selection is read twice: the optimizer then keeps it a column of its own and
    # does not compute it anew for every part.
    return df.withColumn(out, F.when(F.size(step) >= 0, codes)).drop(step)


def as_string(fingerprint: Column) -> Column:
    """Eight hexadecimal digits per part, dots for a part that is not filled."""
    return F.array_join(F.transform(fingerprint, lambda c: F.coalesce(
        F.lpad(F.lower(F.hex(c.bitwiseAND(_long(0xFFFFFFFF)))), 8, "0"), F.lit("." * 8))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the parts filled in either fingerprint in which both agree."""
    pair = F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() | y.isNotNull(),
                                                F.coalesce((x == y).cast("int"), F.lit(0))))
    filled = F.filter(pair, lambda x: x.isNotNull())
    same = F.size(F.filter(filled, lambda x: x == 1))
    return F.when(F.size(filled) == 0, F.lit(1.0)).otherwise(same.cast("double") / F.size(filled))


def _bucket(value: Column, cuts: list[int], *, up_to: bool = False) -> Column:
    """Number of cut points below a value (or up to it), looked up in two levels."""
    width = max(1, int(len(cuts) ** 0.5))
    rows = [cuts[i:i + width] for i in range(0, len(cuts), width)]
    below = lambda points: F.size(F.filter(points, lambda c: c <= value if up_to else c < value))
    whole = below(F.array(*[_long(r[-1]) for r in rows]))
    inside = below(F.coalesce(F.get(F.array(*[F.array(*map(_long, r)) for r in rows]), whole), F.array().cast("array<bigint>")))
    # The last level may be shorter than the others.
    return F.when(value.isNull(), F.lit(0)).otherwise(F.least(whole * width, F.lit(len(cuts))) + inside)


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, Window]:
    """Rows (id, text, tie, bucket, extra) and the window in which the next row is
    the next document in descending order of the ids, after the last the first.
    ``extra`` rows only serve their neighbour and have to be dropped."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n, high = docs.select(F.col(id_col).cast("bigint").alias("id")).agg(F.count("*"), F.max("id")).first()
    buckets = max(1, min(MOST_BUCKETS, n // PER_BUCKET))
    cuts: list[int] = []
    if buckets > 1:
        shares = [i / buckets for i in range(1, buckets)]
        found = docs.agg(F.percentile_approx(F.col(id_col).cast("bigint"), shares, 20 * buckets)).first()[0]
        cuts = sorted({c for c in found or [] if c < high})
    bucket = _bucket(F.col("id"), cuts) if cuts else F.lit(0)
    rows = rows.withColumn("bucket", bucket.cast("int")).withColumn("tie", F.xxhash64("text"))
    ends = (_bucket(F.col("id"), cuts, up_to=True) != bucket) if cuts else F.lit(False)
    place = lambda b, extra: F.struct(b.cast("int").alias("bucket"), F.lit(extra).alias("extra"))
    copies = F.filter(F.array(
        place(F.col("bucket"), False),
        F.when(ends, place(F.col("bucket") + 1, True)),
        F.when(F.col("id").eqNullSafe(F.lit(high).cast("bigint")), place(F.lit(0), True))), lambda x: x.isNotNull())
    rows = rows.withColumn("copy", F.explode(copies)).select("id", "text", "tie", "copy.bucket", "copy.extra")
    return rows, Window.partitionBy("bucket").orderBy("extra", F.col("id").desc_nulls_last(), "tie")


def edited_and_next(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its fingerprint, that of its edited text (the last third of its
    code points replaced by the first as many of the next document), and how much
    its fingerprint is like the edited text's and the next document's."""
    rows, order = with_next(docs, id_col=id_col, text=text)
    rows = rows.withColumn("follows", F.lead("text").over(order)).withColumn("n_chars", F.char_length("text").cast("bigint"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substr("follows", F.lit(1), third))
    rows = rows.withColumn("edited", F.when(F.col("extra"), F.lit("")).otherwise(F.coalesce(edited, F.col("text")))).drop("follows")
    rows = with_fingerprint(with_fingerprint(rows, "text", "own"), "edited", "other")
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("text", "edited")
    rows = rows.withColumn("following", F.lead("own").over(order)).filter(~F.col("extra"))
    return rows.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", as_string(F.col("own")).alias("fingerprint"),
        as_string(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.coalesce("following", "own")).alias("near_next"))
