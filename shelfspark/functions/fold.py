"""Accent folding, the search tokenizer and title normalisation."""

from __future__ import annotations

import json
import string
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions.text import col, strip, words, WS
from shelfspark.session import let

_WORD = set(string.ascii_letters + string.digits + "_")


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str, dict[str, str]]:
    """Compatibility decomposition reduced to ASCII, from the Unicode database.

    Gives the one-to-one part for ``translate`` and the few characters that become
    several letters. A character that decomposes to punctuation only maps to a blank.
    """
    src, dst, multi = ["đ"], ["d"], {}
    for cp in range(0x80, 0x110000):
        ch = chr(cp)
        if unicodedata.decomposition(ch) == "":
            continue
        ascii_part = "".join(c for c in unicodedata.normalize("NFKD", ch) if ord(c) < 0x80)
        if not ascii_part:
            continue
        if not _WORD.intersection(ascii_part):
            ascii_part = " "
        if len(ascii_part) == 1:
            src.append(ch)
            dst.append(ascii_part)
        else:
            multi[ch] = "".join(c if c in _WORD else " " for c in ascii_part)
    return "".join(src), "".join(dst), multi


def _ranges(chars) -> str:
    """Regex class body with neighbouring characters joined to ranges."""
    out, run = [], []
    for cp in sorted(map(ord, chars)):
        if run and cp == run[-1] + 1:
            run.append(cp)
            continue
        if run:
            out.append((run[0], run[-1]))
        run = [cp]
    out.append((run[0], run[-1]))
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in out)


def fold_ascii(c: Column | str) -> Column:
    """Lower case without accents; characters without an ASCII form disappear."""
    src, dst, multi = _fold_table()
    klass = f"[{_ranges(multi)}]"
    # Cheap first look: all of them lie in these four stretches.
    coarse = r"[\x{bc}-\x{be}\x{132}-\x{149}\x{1c4}-\x{1f3}\x{2000}-\x{1ffff}]"
    table = F.from_json(F.lit(json.dumps(multi)), "map<string,string>")  # one constant of the plan

    def expand(t: Column) -> Column:
        # A noncharacter marks the places: it would disappear in the fold anyway.
        pieces = F.split(F.regexp_replace(t, f"({klass})", "\uffff$1\uffff"), "\uffff")
        return F.when(
            t.rlike(coarse) & t.rlike(klass),
            F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(table, p), p)), ""),
        ).otherwise(t)

    lowered = F.lower(col(c))
    ascii_only = lowered.rlike(r"\A[\x00-\x7f]*\z")
    folded = F.regexp_replace(F.translate(let(lowered, expand), src, dst), r"[^\x00-\x7f]+", "")
    return F.when(ascii_only, lowered).otherwise(folded)


def tokenize(c: Column | str) -> Column:
    """Search tokens: folded words of at least two characters, in text order."""
    return F.regexp_extract_all(fold_ascii(c), F.lit("([A-Za-z0-9_]{2,})"), 1)


def term_counts(tokens: Column | str) -> Column:
    """``array<struct<term, tf>>`` of a token array, without leaving the row."""

    def runs(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), n - 1),
                          lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda st: F.transform(st, lambda p, j: F.struct(
            F.get(s, p).alias("term"),
            (F.coalesce(F.get(st, j + 1), n) - p).alias("tf"))))

    empty = F.array().cast("array<struct<term:string,tf:int>>")
    return let(F.sort_array(col(tokens)), lambda s: F.when(F.size(s) == 0, empty).otherwise(runs(s)))


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Canonical decomposition (marks removed) for precomposed letters with an ASCII base."""
    src, dst = [], []
    for cp in range(0xC0, 0x10000):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(cp)) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != chr(cp) and ord(base) < 0x80:
            src.append(chr(cp))
            dst.append(base)
    return "".join(src), "".join(dst)


def audit_norm(c: Column | str) -> Column:
    """Title key of the coverage audit: accents dropped, ``[a-z0-9 ]`` kept, đ becomes a blank."""
    src, dst = _accent_table()
    t = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\p{Mn}+", "")
    t = F.lower(F.translate(t, src, dst))
    return F.trim(F.regexp_replace(t, r"[^a-z0-9]+", " "))


def norm_title(c: Column | str) -> Column:
    """Lower case, trailing parenthesis dropped, blanks squeezed."""
    t = F.regexp_replace(strip(F.lower(col(c))), rf"(?U)[{WS}]*\([^)]*\)[{WS}]*\z", "")
    return strip(F.regexp_replace(t, rf"(?U)[{WS}]+", " "))


def author_key(c: Column | str) -> Column:
    """Lower-case name tokens in sorted order, so a reversed name gives the same key."""
    return F.array_join(F.array_sort(words(F.lower(col(c)))), " ")
