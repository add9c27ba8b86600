"""Personal data in texts, with built-in column functions only.

Three steps for every kind of data: a regular expression proposes spans; a checksum or a
plain rule confirms them (Luhn for cards, mod-97 for bank account numbers, part sizes for
addresses); words standing near a span move its score. The base kinds are kept whenever
their rule holds. The added kinds are kept from a score of 0.5 on, and only where no base
span already covers them.

Patterns are written so that the matcher never goes back: runs are possessive and a match
can only begin where a run begins, so a text of one endless run costs linear time and no
stack. Positions come from the lengths of the texts between the matches, added up per row
by a window; the texts themselves are not shuffled.

Defined results: a null text counts as empty (no spans); each input row gives one row, also
for repeated rows and ids; an empty table gives an empty table; only the id and text columns
are read. Positions count code points, the end is exclusive. Spans are listed by start, then
in the order of ``KINDS``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.session import let

#: Characters before and after a span in which context words count.
BEFORE, AFTER = 40, 20
KEEP_FROM = 0.5


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """The digits of a text pass the Luhn check."""
    def total(d: Column) -> Column:
        def at(i: Column) -> Column:
            n = F.substring(d, -i, F.lit(1)).cast("int")
            twice = n * 2
            return F.when(i % 2 == 1, n).when(twice > 9, twice - 9).otherwise(twice)
        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda acc, i: acc + at(i)) % 10 == 0
    return let(_digits(value), total)


def mod97(value: Column) -> Column:
    """An account number passes the ISO 7064 check: its number, country and check digits last, is 1 modulo 97."""
    letters = F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")

    def rest(v: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            n = F.instr(letters, F.substring(v, i, F.lit(1))) - 1
            return F.pmod(acc * F.when(n > 9, F.lit(100)).otherwise(F.lit(10)) + n, F.lit(97))
        return F.aggregate(F.sequence(F.lit(1), F.length(v)), F.lit(0), step) == 1
    plain = F.regexp_replace(value, "[^0-9A-Z]", "")
    return let(plain, lambda p: rest(F.concat(F.substring(p, F.lit(5), F.length(p)), F.substring(p, F.lit(1), F.lit(4)))))


def _small_parts(value: Column) -> Column:
    bare = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(bare, lambda p: (F.length(p) <= 3) & (F.substring(p, F.lit(1), F.lit(3)).cast("int") <= 255))


def _digit_count(lo: int, hi: int):
    return lambda v: F.length(_digits(v)).between(lo, hi)


@dataclass(frozen=True)
class Kind:
    """What a kind of data looks like, what confirms it, and how its score is made."""

    name: str
    pattern: str
    valid: object
    prior: float
    words: str
    base: bool = False
    gate: str = ""


#: Patterns and rules of the base kinds are fixed values; the matches equal those of the plain
#: patterns  email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+   ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#: card [0-9]([\x20-]?[0-9])+ with 14 to 19 digits   phone \+[0-9][\x20().0-9-]+[0-9] with 10 to 15 digits.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda v: F.lit(True), 0.9, r"e-?mail|correo|courriel|kontakt|contact", True, "@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _small_parts, 0.6, r"\bip\b|host|server|address|adresse", True, "."),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])(?=[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9]))[0-9](?:[\x20-]?[0-9])++",
         luhn, 0.7, r"card|karte|tarjeta|carte|visa|credit|kredit", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _digit_count(10, 15), 0.6, r"phone|tel|mobil|call|anruf|llama|appel", True, "+"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", mod97, 0.7,
         r"iban|account|konto|cuenta|compte|bank|banque"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
         lambda v: ~F.substring(v, 1, 3).isin("000", "666") & (F.substring(v, 1, 1) != "9"), 0.3,
         r"ssn|social|sozial|seguridad|s[eé]curit[eé]|tax|steuer", gate="-"),
    Kind("card_run", r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])", luhn, 0.6,
         r"card|karte|tarjeta|carte|visa|credit|kredit"),
    Kind("phone_run", r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])", _digit_count(10, 15), 0.5,
         r"phone|tel|mobil|call|anruf|llama|appel", gate="+"),
)
_ORDER = {k.name: i for i, k in enumerate(KINDS)}
_SPAN = "array<struct<rank:int,seq:int,gap:int,size:int,ok:boolean,score:double>>"


def _verdict(kind: Kind, value: Column, gaps: Column, i: Column) -> tuple[Column, Column]:
    """Whether match ``i`` is kept, and its score with the words before and after it."""
    near = F.lower(F.concat_ws(" ", F.substring(F.get(gaps, i), -BEFORE, BEFORE), F.substring(F.get(gaps, i + 1), 1, AFTER)))
    score = F.least(F.lit(1.0), F.lit(kind.prior) + F.when(near.rlike(kind.words), 0.3).otherwise(0.0))
    return kind.valid(value) if kind.base else kind.valid(value) & (score >= KEEP_FROM), score


def _proposals(text: Column, kind: Kind) -> Column:
    """The matches of a kind with the length of the text before each, its verdict and its score."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    if kind.gate:
        found = F.when(text.contains(kind.gate), found).otherwise(F.array().cast("array<string>"))

    def spans(both: Column) -> Column:
        hits, gaps = both["hits"], both["gaps"]

        def one(v: Column, i: Column) -> Column:
            ok, score = _verdict(kind, v, gaps, i)
            return F.struct(F.lit(_ORDER[kind.name]).alias("rank"), i.alias("seq"), F.length(F.get(gaps, i)).alias("gap"),
                            F.length(v).alias("size"), ok.alias("ok"), score.alias("score"))
        return F.transform(hits, one)

    def located(hits: Column) -> Column:
        none = F.array().cast(_SPAN)
        pair = F.struct(hits.alias("hits"), F.split(text, kind.pattern, -1).alias("gaps"))
        return F.when(F.size(hits) > 0, let(pair, spans).cast(_SPAN)).otherwise(none)
    return let(found, located)


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, kind, base, start, end, score), one row per span kept, and one row without
    a kind for every input row, so that rows without spans are not lost."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    none = F.array(F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (
        ("rank", "int"), ("seq", "int"), ("gap", "int"), ("size", "int"), ("ok", "boolean"), ("score", "double"))])).cast(_SPAN)
    proposals = F.concat(none, *[_proposals(text, k) for k in KINDS])
    long = (rows.withColumn("row", F.monotonically_increasing_id())
            .select("row", "doc_id", F.explode(proposals).alias("s")).select("row", "doc_id", "s.*").repartition("row"))
    run = Window.partitionBy("row", "rank").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    base = F.col("rank") < 4
    placed = (long.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(run))
              .withColumn("start", F.col("end") - F.col("size"))
              .filter(F.col("ok") | F.col("rank").isNull()))
    upto = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    covered = F.max(F.when(base, F.col("end"))).over(upto)
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return (placed.withColumn("covered", covered)
            .filter(F.col("rank").isNull() | base | F.col("covered").isNull() | (F.col("covered") < F.col("end")))
            .select("row", "doc_id", "rank", F.get(names, F.col("rank")).alias("kind"), base.alias("base"), "start", "end", "score"))


def digest_pii(spans: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, their digest and all spans."""
    label = F.concat_ws(":", "kind", "start", "end")
    listed = F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("start", "rank", label.alias("label"), "base"))))
    n = [F.count(F.when(F.col("rank") == _ORDER[k], 1)).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    per = spans.groupBy("row", "doc_id").agg(*n, listed.alias("all"), F.coalesce(F.max("score"), F.lit(0.0)).alias("max_score"))
    text_of = lambda a: F.concat_ws(",", F.transform(a, lambda s: s["label"]))
    return per.select("doc_id", *[f"n_{k}" for k in ("email", "ip", "card", "phone")],
                      F.sha2(text_of(F.filter("all", lambda s: s["base"])), 256).alias("base_sha256"),
                      text_of(F.col("all")).alias("spans"), "max_score")


#: A later kind sees the tags of the earlier ones; in this order a span that holds another comes first.
_MASK_ORDER = ("email", "phone", "phone_run", "card", "card_run", "ip", "iban", "ssn")


def _masked(text: Column, kind: Kind) -> Column:
    """The text with the confirmed spans of one kind replaced by its tag."""
    tag = F.lit(f"[{kind.name.split('_')[0].upper()}]")

    def joined(both: Column) -> Column:
        hits, gaps = both["hits"], both["gaps"]

        def part(v: Column, i: Column) -> Column:
            return F.concat(F.get(gaps, i), F.when(_verdict(kind, v, gaps, i)[0], tag).otherwise(v))
        return F.concat(F.array_join(F.transform(hits, part), ""), F.get(gaps, F.size(hits)))

    def split_up(hits: Column) -> Column:
        pair = F.struct(hits.alias("hits"), F.split(text, kind.pattern, -1).alias("gaps"))
        return F.when(F.size(hits) > 0, let(pair, joined)).otherwise(text)
    found = let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), split_up)
    return F.when(text.contains(kind.gate), found).otherwise(text) if kind.gate else found


def _bound(text: Column, kind: Kind) -> Column:
    return let(text, lambda t: _masked(t, kind))


def mask_pii(text: Column) -> Column:
    """The text with every confirmed span replaced by its kind in brackets; null stays null."""
    for name in _MASK_ORDER:
        text = _bound(text, KINDS[_ORDER[name]])
    return text
