"""SQL fragments shared by the check queries."""

from __future__ import annotations

WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '\\A[{WS}]+|[{WS}]+\\z', '', 'g')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'))"


def word_count(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[^{WS}]+'))"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '[^{WS}]+')"


def fold(x: str) -> str:
    return f"regexp_replace(strip_accents(replace(lower({x}), 'đ', 'd')), '[^\\x00-\\x7f]', '', 'g')"


def tokens(x: str) -> str:
    return f"regexp_extract_all({fold(x)}, '[A-Za-z0-9_]{{2,}}')"


def audit_norm(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({x})), '[^a-z0-9]+', ' ', 'g'))"


def norm_title(x: str) -> str:
    return squeeze(f"regexp_replace({strip(f'lower({x})')}, '[{WS}]*\\([^)]*\\)[{WS}]*\\z', '')")


def contains_any(x: str, needles) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(n)})" for n in needles) + ")"


def in_list(x: str, values) -> str:
    return f"{x} IN ({', '.join(q(v) for v in values)})"


def uuid5(name: str, namespace_hex: str) -> str:
    h = f"sha1(unhex('{namespace_hex}') || encode({name}))"
    return (f"(SELECT substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||"
            f"translate(substr(h,17,1),'0123456789abcdef','89ab89ab89ab89ab')||substr(h,18,3)||'-'||substr(h,21,12) "
            f"FROM (SELECT {h} AS h))")


def page_band(w: str) -> str:
    p = f"({w} // 250)"
    return (f"CASE WHEN {w} <= 0 THEN 'không rõ' ELSE '~' || {p} || ' trang (' || CASE WHEN {p} < 10 THEN 'truyện ngắn/thơ' "
            f"WHEN {p} < 100 THEN 'truyện vừa' ELSE 'tiểu thuyết' END || ')' END")


def excerpt(x: str, n: int = 300) -> str:
    t = squeeze(x)
    return (f"(SELECT CASE WHEN length(t) <= {n} THEN t WHEN contains(substr(t,1,{n}), ' ') "
            f"THEN regexp_extract(substr(t,1,{n}), '(?s)\\A(.*) ', 1) || '...' ELSE substr(t,1,{n}) || '...' END "
            f"FROM (SELECT {t} AS t))")
