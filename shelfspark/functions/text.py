"""Text cleaning and measuring as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark import fixed_values as V
from shelfspark.session import fill, let

#: Body of a character class holding every Unicode white-space character and the control
#: separators. Only complete together with the ``U`` flag, which widens ``\s``.
WS = r"\s\x1c-\x1f"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim Unicode white space on both ends."""
    return F.regexp_replace(col(c), rf"(?U)\A[{WS}]+|[{WS}]+\z", "")


def nonblank(c: Column | str) -> Column:
    """The trimmed text, or null when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def squeeze(c: Column | str) -> Column:
    """Collapse every white-space run to one blank and trim."""
    return F.trim(F.regexp_replace(col(c), rf"(?U)[{WS}]+", " "))


def words(c: Column | str) -> Column:
    s = squeeze(c)
    return F.filter(F.split(s, " "), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return let(squeeze(c), single_spaced_words).cast("long")


def single_spaced_words(t: Column) -> Column:
    """Number of words of a squeezed text."""
    return F.when(t == "", F.lit(0)).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1)


def char_count(c: Column | str) -> Column:
    return F.length(col(c)).cast("long")


def cut_junk_sections(c: Column | str, names=tuple(V.JUNK_SECTIONS)) -> Column:
    """Drop everything from the first junk heading on, one section name after the other."""
    text = col(c)
    cut = text
    for name in names:
        cut = F.regexp_replace(cut, rf"(?Udms)^=+[{WS}]*{name}[{WS}]*=+.*", "")
    return F.when(text.contains("="), cut).otherwise(text)


def drop_headings(c: Column | str) -> Column:
    return F.regexp_replace(col(c), rf"(?Udm)^=+[^=]+=+[{WS}]*$", "")


def squeeze_blank_lines(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"\n{3,}", "\n\n")


def clean_article(c: Column | str) -> Column:
    """Encyclopaedia article: no junk sections, no headings, no stacked blank lines."""
    return strip(squeeze_blank_lines(drop_headings(cut_junk_sections(F.coalesce(col(c), F.lit(""))))))


def clean_book_text(c: Column | str) -> Column:
    """Book description: no control characters, single blanks, at most one empty line."""
    t = F.coalesce(col(c), F.lit(""))
    t = F.regexp_replace(t, r"[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f]", "")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    return strip(squeeze_blank_lines(t))


def lead_lines(c: Column | str, n: int = 3) -> Column:
    """The first ``n`` non-blank lines."""
    lines = F.filter(F.transform(F.split(col(c), "\n"), strip), lambda p: p != "")
    return F.array_join(F.slice(lines, 1, n), "\n")


def excerpt(c: Column | str, n: int = V.EXCERPT_CHARS) -> Column:
    """At most ``n`` characters, cut at the last blank, with an ellipsis when cut."""

    def cut(t: Column) -> Column:
        head = F.substring(t, 1, n)
        at_blank = F.regexp_extract(head, r"(?s)\A(.*) ", 1)
        return F.when(F.length(t) <= n, t).otherwise(
            F.concat(F.when(F.instr(head, " ") > 0, at_blank).otherwise(head), F.lit("...")))

    return let(squeeze(c), cut)


def prefix(c: Column | str, n: int, ellipsis: str = "...") -> Column:
    t = col(c)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit(ellipsis))).otherwise(t)


def page_band(wc: Column | str) -> Column:
    """Estimated pages with one of three length labels."""
    w = col(wc).cast("long")
    pages = F.floor(w / V.WORDS_PER_PAGE).cast("long")
    label = (F.when(pages < 10, F.lit(V.PAGES_SHORT))
             .when(pages < 100, F.lit(V.PAGES_MIDDLE))
             .otherwise(F.lit(V.PAGES_LONG)))
    return F.when(w <= 0, F.lit(V.PAGES_UNKNOWN)).otherwise(fill(V.PAGES, v=pages.cast("string"), band=label))


def _card_length(wc) -> Column:
    return fill(V.CARD_LENGTH, v=F.format_number(col(wc), 0), pages=page_band(wc))


def book_card(title, author, wc, content) -> Column:
    """Structured text standing for a whole work."""
    return let(excerpt(F.coalesce(col(content), F.lit(""))), lambda ex: F.concat_ws(
        "\n", fill(V.CARD_WORK, v=strip(title)), fill(V.CARD_AUTHOR, v=strip(author)), _card_length(wc),
        F.lit(V.CARD_LANGUAGE), F.lit(V.CARD_SOURCE), F.when(ex != "", fill(V.CARD_EXCERPT, v=ex))))


def summary_card(title, author, wc, summary, genre, audience) -> Column:
    """Book card once a generated summary exists."""
    author = F.when(col(author) == "", F.lit(V.UNKNOWN_AUTHOR)).otherwise(
        F.coalesce(col(author), F.lit(V.UNKNOWN_AUTHOR)))
    return F.concat_ws(
        "\n", fill(V.CARD_WORK, v=col(title)), fill(V.CARD_AUTHOR, v=author),
        F.when(col(genre) != "", fill(V.CARD_GENRE, v=col(genre))), F.when(col(audience) != "", fill(V.CARD_AUDIENCE, v=col(audience))),
        _card_length(wc), F.lit(V.CARD_LANGUAGE), F.lit(V.CARD_SOURCE), fill(V.CARD_SUMMARY, v=col(summary)))


def body_excerpt(c: Column | str, limit: int = V.BODY_EXCERPT_CHARS) -> Column:
    """Text from the first long line on, lines stripped, cut at ``limit`` characters; the whole
    text, cut likewise, where no line is long."""
    def from_first(lines: Column) -> Column:
        first = F.array_position(F.transform(lines, lambda x: F.length(x) >= V.BODY_LINE_CHARS), True).cast("int")
        return F.when(first > 0, strip(F.array_join(F.slice(lines, F.greatest(first, F.lit(1)), F.size(lines)), "\n"))).otherwise(F.lit(""))

    def pick(body: Column) -> Column:
        return F.substring(F.when(body != "", body).otherwise(col(c)), 1, limit)

    return let(let(F.transform(F.split(col(c), "\n"), strip), from_first), pick)


def estimate_tokens(c: Column | str, chars_per_token: float = 3.0) -> Column:
    t = F.coalesce(F.length(col(c)), F.lit(0))
    return F.when(t == 0, F.lit(0).cast("long")).otherwise(F.floor(t / F.lit(chars_per_token)).cast("long") + 1)


def clean_snippet(c: Column | str, limit: int = 150) -> Column:
    """Display snippet: the part after the injected header."""
    t = F.coalesce(col(c), F.lit(""))
    body = (F.when(t.contains(V.DETAIL_MARKER), F.regexp_extract(t, rf"(?s)\A.*?{V.DETAIL_MARKER}(.*)\z", 1))
            .when(t.contains("\n\n"), F.regexp_extract(t, r"(?s)\A.*?\n\n(.*)\z", 1))
            .otherwise(t))
    return let(strip(body), lambda b: prefix(b, limit, "…"))


def vn_number(c: Column | str) -> Column:
    """1234567 -> 1.234.567"""
    return F.translate(F.format_number(col(c), 0), ",", ".")


def latex_percent(c: Column | str) -> Column:
    """82.1 -> 82{,}1"""
    return F.replace(F.format_string("%.1f", col(c)), F.lit("."), F.lit("{,}"))
