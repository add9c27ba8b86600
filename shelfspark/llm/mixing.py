"""Mixing sources to target weights by systematic sampling.

Every source gets a share of all words by its weight (the weights repeat over the sources in code
point order, null last). A source gives at most ``cap`` times its words; what is above is shared
again by weight among the others until no target is above its cap.

All documents of a source have the same expected number of copies, target / words of the source.
They are put in order of their size, the expected copies are summed along this order, one
offset per source, a digest of its name and the seed, is added, and a document is emitted once for
every integer that its part of the sum crosses. In order of size neighbours stand for each
other, so the words taken differ from the target by less than two of the largest documents of the
source; a document is emitted the rounded-down or rounded-up number of expected times.

The order within a source is a scan over ranges of rows, so a source with a third of all
rows is spread like any other. Of the sources only sums reach the driver, one row per round of
sharing. Expected copies are whole multiples of 2^-24, so sums are exact.

Defined results: null and empty texts have size 0 and take part with 0 words; repeated rows are
documents of their own; rows of equal size go by a digest of their id, then by id (null first);
a source without words has target 0 and no copies; an empty table gives no rows; other columns
are not read (by :func:`mix` passed on).
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import materialize
from shelfspark.llm.text_stats import with_words
from shelfspark.operators.scan import running
from shelfspark.session import small_side

WEIGHTS = (1, 2, 3)
CAP = 3
#: Expected copies are counted in steps of 2^-STEP_BITS.
STEP_BITS = 24


def _unit(digest: Column) -> Column:
    """The first 60 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, num, den): the target of every row of ``sizes(source, source_size)`` as a fraction.

    Water is poured by weight: a round finds the level at which the open sources share what the
    full ones leave, and closes those above their cap. Rounds end when none is above.
    """
    ranked = running(sizes.withColumn("_all", F.lit(0)), ["_all"], [F.col("source").asc_nulls_last()], {"place": F.lit(1)})
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")).cast("decimal(38,0)")
    rows = materialize(ranked.select("source", "source_size", w.alias("w"), (F.col("source_size") * cap).cast("decimal(38,0)").alias("most")), "sources")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level = Fraction(0)
    while True:
        above = F.col("w") * F.lit(level.numerator).cast("decimal(38,0)") > F.col("most") * F.lit(level.denominator).cast("decimal(38,0)")
        full, open_w, closed = rows.agg(F.sum(F.when(above, F.col("most"))), F.sum(F.when(~above, F.col("w"))), F.count(F.when(above, 1))).first()
        # Sources closed at a lower level stay closed: the level only rises.
        new = Fraction(int(total) - int(full or 0), int(open_w)) if open_w else level
        if new == level:
            break
        level = new
    num = F.when(above, F.col("most")).otherwise((F.col("w") * F.lit(level.numerator)).cast("decimal(38,0)"))
    den = F.when(above, F.lit(1)).otherwise(F.lit(level.denominator)).cast("decimal(38,0)")
    return rows.select("source", "source_size", num.alias("num"), den.alias("den"))


def plan_mix(docs: DataFrame, *keep: str, weights=WEIGHTS, cap: int = CAP, seed: str = "0") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every document, with the columns ``keep``."""
    hidden = {f"_keep_{c}": F.col(c) for c in keep}
    slim = with_words(docs.select("doc_id", F.col("source").cast("string").alias("source"), "text", *[c.alias(n) for n, c in hidden.items()]), name="size")
    if not keep:
        slim = materialize(slim, "sizes")  # the texts are read once
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sizes, weights, cap), "targets")
    tie = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")).cast("binary"))
    placed = running(slim.withColumn("_tie", _unit(tie)), ["source"], [F.col("size"), F.col("_tie"), F.col("doc_id").asc_nulls_first()], {"place": F.lit(1)})
    step = F.lit(1 << STEP_BITS)
    rate = F.expr("CASE WHEN source_size > 0 THEN num * CAST({} AS DECIMAL(38,0)) DIV (den * source_size) ELSE 0L END".format(1 << STEP_BITS))
    offset = F.pmod(_unit(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).cast("binary"))), step)
    rates = small_side(targets.select(F.col("source").alias("_source"), "source_size", (F.col("num").cast("double") / F.col("den").cast("double")).alias("target"),
                                      rate.alias("rate"), offset.alias("offset")), targets.count())
    out = placed.join(rates, placed["source"].eqNullSafe(rates["_source"]))
    crossed = lambda place: F.shiftright(place * F.col("rate") + F.col("offset"), STEP_BITS)
    out = out.withColumn("copies", crossed(F.col("place")) - crossed(F.col("place") - 1))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *hidden)


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = "0") -> DataFrame:
    """The mixed documents: every row as often as it is taken, with its columns and ``copy``, counted from 1."""
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), "doc_id", "source", "text")
    planned = plan_mix(rows, "_row", weights=weights, cap=cap, seed=seed).filter("copies > 0")
    out = planned.select("_keep__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return out.select(*[F.col("_keep__row")[c].alias(c) for c in docs.columns if c != "copy"], F.col("_copy").alias("copy"))
