"""Functions of the SQL dialect as Spark columns: all are built-in expressions, none runs Python on rows."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def byte_length(x) -> Column:
    """LENGTH counts bytes; CHAR_LENGTH counts characters."""
    return F.octet_length(_col(x))


def trim_space(x) -> Column:
    """TRIM without a character list removes all Unicode white space at both ends."""
    return F.regexp_replace(_col(x), r"(?U)^\s+|\s+$", "")


def int_div(a, b) -> Column:
    """Integer division truncates; a zero divisor is an error under ANSI rules."""
    return F.call_function("div", _col(a), _col(b))


def sum_float(x) -> Column:
    return F.sum(_col(x).cast("double"))


def cast_bool(x, kind: str = "string") -> Column:
    """Strings true, t and 1 in any case are true and others false; integers are true unless 0."""
    c = _col(x)
    if kind == "string":
        return F.when(c.isNotNull(), F.lower(c).isin("true", "t", "1"))
    return c != 0


def create_regex(x) -> Column:
    """Escape what a regular expression would read as syntax."""
    return F.regexp_replace(_col(x), r"([\W&&[^\s]])", r"\\$1")


def regex_replace(x, pattern: str, replacement: str, flags: str | None = None) -> Column:
    """Replace the first match, or all with flag g; flags i, m and s as in regular expressions."""
    flags = flags or ""
    inline = "".join(f for f in "ims" if f in flags)
    whole = f"(?{inline}){pattern}" if inline else pattern
    if "g" in flags:
        return F.regexp_replace(_col(x), whole, replacement)
    c = _col(x)
    at = F.regexp_instr(c, F.lit(whole))
    found = F.regexp_substr(c, F.lit(whole))
    changed = F.concat(F.substring(c, F.lit(1), at - 1), F.regexp_replace(found, whole, replacement), F.substring(c, at + F.length(found), F.length(c)))
    return F.when(at > 0, changed).otherwise(c)


def similar_pattern(pattern: str) -> str:
    """A SIMILAR TO pattern as an anchored regular expression."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append(re.escape(pattern[i + 1]))
            i += 1
        elif c == "%":
            out.append(".*")
        elif c == "_":
            out.append(".")
        elif c in "|*+?{}()[]-^":
            out.append(c)
        else:
            out.append(re.escape(c))
        i += 1
    return f"(?s)^(?:{''.join(out)})$"


def similar_to(x, pattern: str) -> Column:
    return _col(x).rlike(similar_pattern(pattern))


def revlike(value, pattern) -> Column:
    """The column holds the pattern: value LIKE pattern."""
    return F.call_function("like", _col(value), _col(pattern))


def revilike(value, pattern) -> Column:
    return F.call_function("ilike", _col(value), _col(pattern))


def revregexp(value, pattern, fold: bool = False) -> Column:
    p = _col(pattern)
    return F.call_function("rlike", _col(value), F.concat(F.lit("(?i)"), p) if fold else p)


COMPARE = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "LIKE": lambda a, b: F.call_function("like", a, b)}


def any_of(x, op: str, array) -> Column:
    return F.exists(_col(array), lambda e: COMPARE[op](_col(x), e))


def all_of(x, op: str, array) -> Column:
    return F.forall(_col(array), lambda e: COMPARE[op](_col(x), e))


def locale_text(texts, locale: str, default: str) -> Column:
    """text@'locale': the text in that language, else in the default one."""
    c = _col(texts)
    return F.coalesce(F.try_element_at(c, F.lit(locale)), F.try_element_at(c, F.lit(default)))


def enum_name(value, names: list[str]) -> Column:
    """The name of an enum value numbered from 0."""
    return F.get(F.array(*map(F.lit, names)), _col(value).cast("int"))


def flag_names(value, names: list[str]) -> Column:
    """The names of the bits set in a flag enum value; NONE for 0."""
    v = _col(value)
    parts = [F.when(v.bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(names)]
    return F.when(v == 0, F.lit("NONE")).when(v != 0, F.concat_ws("|", *parts))


def object_id_hex(objid) -> Column:
    return F.lower(F.lpad(F.hex(_col(objid).cast("long")), 32, "0"))


# --- full text ----------------------------------------------------------------------------------------------------


def tokens(x) -> Column:
    return F.filter(F.split(F.lower(_col(x)), r"\W+"), lambda t: t != "")


def match_boolean(x, query: str) -> Column:
    """MATCH ... AGAINST in boolean mode: +word must and -word must not occur, word* is a prefix, "..." a phrase;
    without + words, any plain word suffices."""
    terms = [(m[1], m[2] or m[3]) for m in re.finditer(r'([+-]?)(?:"([^"]*)"|(\S+))', query)]
    low = F.lower(_col(x))

    def one(term: str) -> Column:
        t = term.lower()
        if " " in t:
            return low.rlike(r"(?<!\w)" + r"\W+".join(map(re.escape, t.split())) + r"(?!\w)")
        if t.endswith("*"):
            return F.contains(low, F.lit(t[:-1])) & low.rlike(rf"(?<!\w){re.escape(t[:-1])}")
        return F.contains(low, F.lit(t)) & low.rlike(rf"(?<!\w){re.escape(t)}(?!\w)")

    must, never, may = ([one(t) for s, t in terms if s == sign] for sign in ("+", "-", ""))
    out = F.lit(True)
    for c in must:
        out = out & c
    for c in never:
        out = out & ~c
    if may and not must:
        some = F.lit(False)
        for c in may:
            some = some | c
        out = out & some
    return out


def match_any(x, query: str) -> Column:
    """Natural language mode: any word of the query occurs."""
    words = sorted({w for w in re.split(r"\W+", query.lower()) if w})
    return F.lower(_col(x)).rlike(rf"(?<!\w)(?:{'|'.join(map(re.escape, words))})(?!\w)") if words else F.lit(False)
