"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

Terms are words, weighted by how often they occur. For every sample number and term, gamma variates r and
c and a uniform variate b come from hashes of the term, so all documents use the same ones. With
t = floor(ln(weight) / r + b) the term's value is ln c - r (t - b) - r; the term of the least value is
the sample of a document. Two documents draw the same sample with a probability equal to their
generalised Jaccard similarity, the sum of least weights over the sum of greatest.

The value is a function of sample number, term and t, so equal least values stand for equal samples:
it suffices to aggregate minima, which hash aggregation does in place without sorting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmark.functions.durable import durable
from flowmark.llm.common import running_total, texts

#: Samples in a fingerprint, and samples drawn together.
SAMPLES = 32
BLOCK = 8
#: Code points of text in a range of neighbouring documents; documents are dealt out by such ranges.
RANGE_CHARS = 8 << 20
#: Most ranges, since the driver holds their bounds; in larger tables ranges have more text.
MAX_RANGES = 20_000
BLANKS = r"[\x20\x09-\x0D]+"


def _uniform(bits: Column, shift: int, width: int) -> Column:
    """A number between 0 and 1, both excluded, from some bits of a hash."""
    part = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1))
    return (part.cast("double") + 0.5) / float(1 << width)


def _values(term: Column, ln_weights: list[Column], k: int) -> list[Column]:
    """The value of a term under sample number ``k``, for the logarithm of each weight (null: no weight).

    The variates take their bits from one hash, r and c as sums of two exponential ones.
    """
    bits = F.xxhash64(term, F.lit(k))
    r = -F.log(_uniform(bits, 0, 13) * _uniform(bits, 13, 13))
    ln_c = F.log(-F.log(_uniform(bits, 26, 13) * _uniform(bits, 39, 13)))
    b = _uniform(bits, 52, 12)
    return [ln_c - r * (F.floor(w / r + b) - b) - r for w in ln_weights]


def signatures(variants: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``keys`` and, for each text column, an array of ``SAMPLES`` integers; null without words.

    Rows of ``keys`` have to be partitioned by a part of the keys for this to need no shuffle.
    """

    def words_of(i: int) -> Column:
        number = F.lit(i).alias("c")
        return F.transform(F.split(columns[i], BLANKS), lambda w: F.struct(w.alias("w"), number))

    words = F.flatten(F.array(*map(words_of, range(len(columns)))))
    weights = [f"weight{i}" for i in range(len(columns))]
    counted = (
        variants.select(*keys, F.explode(words).alias("e"))
        # an empty word weighs nothing; it keeps rows without words
        .select(
            *keys,
            F.xxhash64("e.w").alias("term"),
            F.when(F.col("e.w") != "", F.col("e.c")).alias("c"),
        )
        .groupBy(*keys, "term")
        .agg(
            *[
                F.sum(F.when(F.col("c") == i, 1).otherwise(0)).alias(w)
                for i, w in enumerate(weights)
            ]
        )
    )
    # A term takes part once per block of samples, each block with a hash of its own: so few samples are in
    # one piece of generated code that it is compiled. Values are columns before they are aggregated,
    # so that what the weights share is computed once.
    logarithms = [F.when(F.col(w) > 0, F.log(w)).alias(w) for w in weights]
    blocks = F.explode(F.sequence(F.lit(0), F.lit(SAMPLES // BLOCK - 1))).alias("block")
    names = [f"v{i}_{k}" for k in range(BLOCK) for i in range(len(columns))]
    values = [v for k in range(BLOCK) for v in _values(F.col("term"), list(map(F.col, weights)), k)]
    sampled = (
        counted.select(*keys, "term", *logarithms, blocks)
        .select(*keys, "block", F.xxhash64("term", "block").alias("term"), *weights)
        .select(*keys, "block", *[v.alias(n) for n, v in zip(names, values)])
        .groupBy(*keys, "block")
        .agg(*[F.min(n).alias(n) for n in names])
    )

    def of(i: int) -> Column:
        own = F.array(*[F.hash(f"v{i}_{k}") for k in range(BLOCK)])
        return F.when(F.col(f"v{i}_0").isNotNull(), own).alias(columns[i])

    parts = F.array_sort(
        F.collect_list(F.struct("block", *[of(i) for i in range(len(columns))]))
    )

    def whole(c: str) -> Column:
        found = F.flatten(F.transform("parts", lambda p: p[c]))  # null where a part is
        return found.alias(c)

    return (
        sampled.groupBy(*keys).agg(parts.alias("parts")).select(*keys, *[whole(c) for c in columns])
    )


def likeness(a: Column, b: Column) -> Column:
    """Part of the samples that two signatures share; texts without words are alike."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / float(SAMPLES)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same)


def as_text(signature: Column) -> Column:
    digits = F.transform(
        signature, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")
    )
    return F.coalesce(F.array_join(digits, ""), F.lit(""))


def _range_of(bounds: list[tuple], doc_id: Column, row: Column) -> Column:
    """Number of the last bound (by id, then row) that is not after a row: a binary search."""
    table = F.array(
        *[F.struct(F.lit(i).cast("long").alias("i"), F.lit(r).alias("r")) for i, r in bounds]
    )
    begin = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds) - 1).alias("hi"))

    def step(state, _):
        mid = ((state["lo"] + state["hi"] + 1) / 2).cast("int")
        bound = table[mid]
        ahead = (
            (bound["i"].isNull() & (doc_id.isNotNull() | (bound["r"] <= row)))
            | (bound["i"] < doc_id)
            | ((bound["i"] == doc_id) & (bound["r"] <= row))
        )
        ahead = F.coalesce(ahead, F.lit(False))
        return F.struct(
            F.when(ahead, mid).otherwise(state["lo"]).alias("lo"),
            F.when(ahead, state["hi"]).otherwise(mid - 1).alias("hi"),
        )

    steps = F.sequence(F.lit(1), F.lit(max(1, len(bounds).bit_length())))
    return F.aggregate(steps, begin, step, lambda s: s["lo"])


def with_next(plain: DataFrame) -> DataFrame:
    """``plain`` with ``next_text``, the text of the next row by id (null ids first, then by row; the
    first row after the last), and ``range``, by which the result is partitioned.

    The table of ids is ordered first and bounds of ranges of about equal text are taken from it. Texts are
    shuffled once, by range; only the last row of a range looks into the next one.
    """
    sized = plain.select(
        "doc_id", "row", F.char_length("text").cast("long").alias("size"), F.lit(0).alias("all")
    )
    placed = durable(running_total(sized, "all", ["doc_id", "row"], "size", "ahead"))
    total = placed.agg(F.sum("size")).first()[0] or 0
    number = F.expr(f"ahead div {max(RANGE_CHARS, -(-total // MAX_RANGES))}")
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("o"), "doc_id", "row")).alias("f")
    # one row per RANGE_CHARS of text, and at most MAX_RANGES
    bounds = [
        (r["doc_id"], r["row"])
        for r in placed.groupBy(number.alias("n")).agg(first).orderBy("n").select("f.*").collect()
    ]
    if not bounds:
        return plain.withColumns({"range": F.lit(0), "next_text": F.lit("")})
    n = len(bounds)
    ranged = plain.withColumn("range", _range_of(bounds, F.col("doc_id"), F.col("row")))
    order = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first(), "row")
    heads = ranged.filter(F.col("row").isin([r for _, r in bounds])).select(
        F.pmod(F.col("range") - 1, F.lit(n)).alias("range"), F.col("text").alias("after")
    )
    return (
        ranged.withColumn("next_text", F.lead("text").over(order))
        .join(heads, "range", "left")
        .withColumn("next_text", F.coalesce("next_text", "after"))
        .drop("after")
    )


def edited(text: Column, next_text: Column) -> Column:
    """``text`` with its last quarter replaced by the beginning of ``next_text``."""
    moved = F.floor(F.char_length(text) / 4).cast("int")
    return F.concat(
        F.substring(text, F.lit(1), F.char_length(text) - moved),
        F.substring(next_text, F.lit(1), moved),
    )


def neighbour_fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``row``, ``n_chars``, ``edited_sha256``, ``signature``,
    ``edited_signature``, ``next_signature``.

    The next row is that of the next id, as :func:`with_next` says. A null text counts as empty. A text
    without words has no signature. Repeated rows follow each other. No rows, no result rows.
    """
    plain = texts(docs, id_col, text_col)
    variants = with_next(plain).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    # The digest travels as four numbers, so that aggregation can keep it in place.
    sha = F.sha2("edited", 256)
    digest = [f"sha{i}" for i in range(4)]
    variants = variants.withColumns(
        {
            d: F.conv(F.substring(sha, 16 * i + 1, 16), 16, -10).cast("long")
            for i, d in enumerate(digest)
        }
    ).withColumn("n_chars", F.char_length("text").cast("long"))
    meta = ["range", "row", "doc_id", "n_chars", *digest]
    kept = durable(signatures(variants, meta, ["text", "edited"]))
    order = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first(), "row")
    last = kept.agg(F.max("range")).first()[0]
    ranked = kept.withColumn("at", F.row_number().over(order))
    heads = (
        kept.withColumn("at", F.row_number().over(order))
        .filter("at = 1")
        .select(
            F.pmod(F.col("range") - 1, F.lit((last or 0) + 1)).alias("range"),
            F.col("text").alias("after"),
        )
    )
    followed = ranked.withColumns(
        {"following": F.lead("text").over(order), "is_last": F.lead("row").over(order).isNull()}
    )
    return followed.join(heads, "range", "left").select(
        "doc_id",
        "row",
        "n_chars",
        F.lower(F.concat(*[F.lpad(F.hex(d), 16, "0") for d in digest])).alias("edited_sha256"),
        F.col("text").alias("signature"),
        F.col("edited").alias("edited_signature"),
        F.when(F.col("is_last"), F.col("after")).otherwise(F.col("following")).alias("next_signature"),
    )

