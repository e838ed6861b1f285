"""The dialect front end: rewrites what Spark's SQL lacks and checks what the dialect forbids, before Catalyst.

Rewritten: FILTER BY (a WHERE after the FROM items), a trailing VIEW AS (...), REVLIKE and its kin (operands change
sides), x op ANY/ALL [..] or (SELECT ..), SIMILAR TO, ~ operators, LENGTH (bytes), TRIM(x) (all white space),
SUBSTRING(x FROM 'pattern'), CAST(x AS BOOLEAN), GROUP_CONCAT, REGEX_REPLACE, CREATE_REGEX, UNNEST(x), MATCH (..) AGAINST
('..' [mode]), col@'locale', LIMIT m, n, and / of two integers. Refused: NATURAL and USING joins, ORDER BY ALL, joins of
FLAT tables or across databases, aggregates in WHERE, aggregates and subqueries in VIEW AS, query expansion.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from lodestar.functions.dialect import similar_pattern
from lodestar.plans import errors

TOKEN = re.compile(r"\s+|--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|(?:\d+\.\d+|\d+)(?:[eE][+-]?\d+)?(?:BD|[LlSsYyDdFf])?(?!\w)|\d+|[A-Za-z_][\w$]*|!~\*|~\*|!~|->|<=>|<>|<=|>=|!=|\|\||::|<<|>>|.", re.S)
AGGREGATE = {"count", "sum", "avg", "min", "max", "group_concat", "array_agg", "string_agg", "stddev", "variance"}


def tokens(text: str) -> list[str]:
    return [t for t in TOKEN.findall(text) if not t.isspace() and (t.startswith("/*+") or not t.startswith(("--", "/*")))]  # hints stay


def statements(text: str) -> list[str]:
    """Split at semicolons outside quotes and comments."""
    out, now = [], []
    for t in TOKEN.findall(text):
        if t == ";":
            out.append("".join(now).strip())
            now = []
        elif not t.startswith(("--", "/*")):
            now.append(t)
    return [s for s in [*out, "".join(now).strip()] if s]


def closing(ts: list[str], at: int) -> int:
    """Index of the bracket that closes the one at at."""
    pairs, depth = {"(": ")", "[": "]"}, 0
    for i in range(at, len(ts)):
        depth += (ts[i] in pairs) - (ts[i] in pairs.values())
        if not depth:
            return i
    raise errors.DialectSyntaxError("a bracket is not closed")


def top_level(ts: list[str], *words: str, start: int = 0) -> int:
    """Index of a run of keywords outside brackets, or -1."""
    i, low = start, [w.lower() for w in words]
    while i < len(ts):
        if ts[i] in ("(", "["):
            i = closing(ts, i)
        elif [t.lower() for t in ts[i : i + len(low)]] == low:
            return i
        i += 1
    return -1


def text_of(ts: list[str]) -> str:
    out = ""
    for t in ts:
        glue = not out or out[-1] in "(.[@" or t in (")", ",", ".", "]", "[", "@") or (t == "(" and re.search(r"[\w`]$", out) and not re.search(r"(?i)\b(in|and|or|not|as|on|where|by|exists|select|from|join|any|all|over|values|like|then|else|when)$", out))
        out += t if glue else " " + t
    return out


def operand_before(out: list[str]) -> tuple[list[str], list[str]]:
    """Split a finished token list before its last operand (a name, literal, call or bracket)."""
    i = len(out) - 1
    if i >= 0 and out[i] in (")", "]"):
        depth = 0
        while i >= 0:
            depth += (out[i] in (")", "]")) - (out[i] in ("(", "["))
            if not depth:
                break
            i -= 1
        if i > 0 and re.fullmatch(r"[A-Za-z_]\w*", out[i - 1]) and out[i - 1].lower() not in ("and", "or", "not", "in", "on", "where"):
            i -= 1
    while i >= 2 and out[i - 1] == ".":
        i -= 2
    return out[:i], out[i:]


def operand_after(ts: list[str], at: int) -> int:
    """End of the operand that starts at at."""
    if ts[at] in ("(", "["):
        return closing(ts, at) + 1
    end = at + 1
    while end < len(ts) and ts[end] == ".":
        end += 2
    if end < len(ts) and ts[end] == "(":
        end = closing(ts, end) + 1
    return end


def operators(ts: list[str]) -> list[str]:
    """Rewrite operators and functions, from left to right."""
    out: list[str] = []
    i = 0
    low = [t.lower() for t in ts]
    while i < len(ts):
        t = low[i]
        negate = t == "not" and i + 1 < len(ts)
        k = i + 1 if negate else i
        word = low[k] if k < len(ts) else ""
        if word in ("revlike", "revilike", "revregexp", "revrlike"):
            fold = ts[k + 1] == "*"
            start = k + 1 + fold
            end = operand_after(ts, start)
            head, pattern = operand_before(out)
            spark = {"revlike": "LIKE", "revilike": "ILIKE"}.get(word, "RLIKE")
            if fold:
                pattern = ["concat", "(", "'(?i)'", ",", *pattern, ")"]
            out = [*head, *(["NOT"] if negate else []), "(", *operators(ts[start:end]), spark, *pattern, ")"]
            i = end
        elif word == "similar" and low[k + 1 : k + 2] == ["to"]:
            pattern = ts[k + 2][1:-1].replace("''", "'")
            escaped = similar_pattern(pattern).replace("\\", "\\\\").replace("'", "\\'")
            out += [*(["NOT"] if negate else []), "RLIKE", f"'{escaped}'"]
            i = k + 3
        elif t in ("~", "~*", "!~", "!~*") and out and (re.match(r"[\w'\"`)\]]", out[-1][-1])) and out[-1].lower() not in ("select", "and", "or", "where", "on", ","):
            end = operand_after(ts, i + 1)
            pattern = operators(ts[i + 1 : end])
            out += [*(["NOT"] if t[0] == "!" else []), "RLIKE", *(["concat", "(", "'(?i)'", ",", *pattern, ")"] if t.endswith("*") else pattern)]
            i = end
        elif t in ("any", "all") and i + 1 < len(ts) and ts[i + 1] == "[":
            end = closing(ts, i + 1)
            op = out.pop()
            negated = bool(out) and out[-1].lower() == "not"
            if negated:
                out.pop()
            head, value = operand_before(out)
            fn = "exists" if t == "any" else "forall"
            test = [*value, op, "_e"]
            out = [*head, fn, "(", "array", "(", *operators(ts[i + 2 : end]), ")", ",", "_e", "->", *(["NOT", "(", *test, ")"] if negated else test), ")"]
            i = end + 1
        elif t in ("any", "all") and low[i + 1 : i + 3] == ["(", "select"] and out and out[-1] in ("=", "<>", "!=", "<", "<=", ">", ">="):
            end = closing(ts, i + 1)
            op, inner = out.pop(), operators(ts[i + 2 : end])
            head, value = operand_before(out)
            if op == "=" and t == "any" or op in ("<>", "!=") and t == "all":
                out = [*head, *value, *(["NOT"] if t == "all" else []), "IN", "(", *inner, ")"]
            else:  # ALL: no row for which the comparison is not true
                test = [*value, op, "_v"] if t == "any" else ["(", *value, op, "_v", ")", "IS", "NOT", "TRUE"]
                out = [*head, *(["NOT"] if t == "all" else []), "EXISTS", "(", "SELECT", "1", "FROM", "(", *inner, ")", "AS", "_q", "(", "_v", ")", "WHERE", *test, ")"]
            i = end + 1
        elif t in CALLS and ts[i + 1 : i + 2] == ["("] and (made := CALLS[t](parts(ts[i + 2 : closing(ts, i + 1)]))) is not None:
            out += made
            i = closing(ts, i + 1) + 1
            if t == "unnest" and low[i : i + 1] != ["as"]:
                out += ["AS", "unnest"]
        elif t == "limit" and ts[i + 2 : i + 3] == [","]:
            out += ["LIMIT", ts[i + 3], "OFFSET", ts[i + 1]]
            i += 4
        elif t == "length" and ts[i + 1 : i + 2] == ["("]:
            out.append("octet_length")
            i += 1
        elif t == "trim" and ts[i + 1 : i + 2] == ["("] and top_level(ts[i + 2 : closing(ts, i + 1)], "from") < 0 and low[i + 2] not in ("both", "leading", "trailing"):
            end = closing(ts, i + 1)
            out += ["regexp_replace", "(", *operators(ts[i + 2 : end]), ",", "'(?U)^\\\\s+|\\\\s+$'", ",", "''", ")"]
            i = end + 1
        elif t == "match" and ts[i + 1 : i + 2] == ["("]:
            end = closing(ts, i + 1)
            if low[end + 1 : end + 2] != ["against"]:
                raise errors.DialectSyntaxError("MATCH needs AGAINST")
            last = closing(ts, end + 2)
            if "expansion" in low[end + 3 : last]:
                raise errors.UnsupportedFeature("MATCH .. WITH QUERY EXPANSION")
            columns = [ts[i + 2 : end][j] for j in range(0, end - i - 2) if ts[i + 2 : end][j] != ","]
            out += tokens(full_text(columns, ts[end + 3][1:-1], "boolean" in low[end + 3 : last]))
            i = last + 1
        elif t == "@" and i + 1 < len(ts) and ts[i + 1].startswith("'"):
            head, column = operand_before(out)
            out = [*head, "coalesce", "(", "try_element_at", "(", *column, ",", ts[i + 1], ")", ",", "try_element_at", "(", *column, ",", "'default'", ")", ")"]
            i += 2
        else:
            out.append(ts[i])
            i += 1
    return out


def parts(ts: list[str]) -> list[list[str]]:
    """Split at commas outside brackets."""
    out: list[list[str]] = [[]]
    i = 0
    while i < len(ts):
        end = closing(ts, i) + 1 if ts[i] in ("(", "[") else i + 1
        if ts[i] == ",":
            out.append([])
        else:
            out[-1] += ts[i:end]
        i = end
    return [p for p in out if p]


def _concat(args: list[list[str]]) -> list[str]:
    """Sorted, since the dialect gives no order."""
    value, by = operators(args[0]), args[1] if len(args) > 1 else ["','"]
    if value and value[0].lower() == "distinct":
        return ["array_join", "(", "array_sort", "(", "collect_set", "(", "CAST", "(", *value[1:], "AS", "STRING", ")", ")", ")", ",", *by, ")"]
    return ["array_join", "(", "array_sort", "(", "collect_list", "(", "CAST", "(", *value, "AS", "STRING", ")", ")", ")", ",", *by, ")"]


def _regex_replace(args: list[list[str]]) -> list[str]:
    """The first match, or all with flag g."""
    x, pattern, new = (text_of(operators(a)) for a in args[:3])
    flags = args[3][0].strip("'").lower() if len(args) > 3 else ""
    inline = "".join(f for f in "ims" if f in flags)
    whole = f"concat('(?{inline})', {pattern})" if inline else pattern
    if "g" in flags:
        return tokens(f"regexp_replace({x}, {whole}, {new})")
    at, found = f"regexp_instr({x}, {whole})", f"regexp_substr({x}, {whole})"
    return tokens(f"CASE WHEN {at} > 0 THEN concat(substring({x}, 1, {at} - 1), regexp_replace({found}, {whole}, {new}), substring({x}, {at} + char_length({found}))) ELSE {x} END")


def _cast(args: list[list[str]]) -> list[str] | None:
    """To boolean by the dialect's rule: true, t and 1 of strings, all but 0 of numbers."""
    (arg,) = args
    at = top_level(arg, "as")
    if at < 0 or [t.lower() for t in arg[at + 1 :]] not in (["boolean"], ["bool"]):
        return None
    x = text_of(operators(arg[:at]))
    return tokens(f"CASE WHEN typeof({x}) IN ('string', 'boolean') THEN lower(CAST({x} AS STRING)) IN ('true', 't', '1') ELSE TRY_CAST(CAST({x} AS STRING) AS DOUBLE) <> 0 END")


def _substring(args: list[list[str]]) -> list[str] | None:
    at = top_level(args[0], "from")
    if len(args) > 1 or at < 0 or len(args[0]) != at + 2 or not args[0][at + 1].startswith("'"):
        return None
    return ["regexp_substr", "(", *operators(args[0][:at]), ",", args[0][at + 1], ")"]


#: Calls that become other tokens, or None where Spark's own form is meant.
CALLS = {
    "group_concat": _concat,
    "regex_replace": _regex_replace,
    "create_regex": lambda args: ["regexp_replace", "(", *operators(args[0]), ",", r"'([\\W&&[^\\s]])'", ",", r"'\\\\$1'", ")"],
    "unnest": lambda args: ["explode", "(", *operators(args[0]), ")"],
    "cast": _cast,
    "substring": _substring,
}


def full_text(columns: list[str], query: str, boolean: bool) -> str:
    """A Spark SQL condition for a full-text query over the joined columns."""
    text = f"lower(concat_ws(' ', {', '.join(columns)}))"
    word = lambda w: f"(contains({text}, '{w}') AND {text} RLIKE '(?<!\\\\w){re.escape(w)}(?!\\\\w)')"
    if not boolean:
        return "(" + " OR ".join(word(w) for w in re.split(r"\W+", query.lower()) if w) + ")"
    must, never, may = [], [], []
    for sign, phrase, plain in re.findall(r'([+-]?)(?:"([^"]*)"|(\S+))', query):
        w = (phrase or plain).lower()
        if phrase:
            test = f"{text} RLIKE '(?<!\\\\w){re.sub(r'[^a-z0-9]+', r'\\\\\\\\W+', w)}(?!\\\\w)'"
        elif w.endswith("*"):
            test = f"{text} RLIKE '(?<!\\\\w){re.escape(w[:-1])}'"
        else:
            test = word(w)
        {"+": must, "-": never, "": may}[sign].append(test)
    parts = [*must, *(f"NOT ({t})" for t in never)]
    if may and not must:
        parts.append("(" + " OR ".join(may) + ")")
    return "(" + " AND ".join(parts) + ")"


@dataclass
class TableFacts:
    """What the checks need to know of a table."""

    database: str = "app"
    flat: bool = False


def check_select(ts: list[str], facts: dict[str, TableFacts]) -> None:
    low = [t.lower() for t in ts]
    if "natural" in low or any(w == "using" and ts[i + 1 : i + 2] == ["("] for i, w in enumerate(low)):
        raise errors.UnsupportedFeature("NATURAL and USING joins")
    if top_level(ts, "order", "by", "all") >= 0:
        raise errors.UnsupportedFeature("ORDER BY ALL")
    at = top_level(ts, "where")
    if at >= 0:
        ends = [e for e in (top_level(ts, *w, start=at) for w in (("group", "by"), ("order", "by"), ("having",), ("limit",))) if e >= 0]
        part = ts[at : min(ends, default=len(ts))]
        i = 0
        while i < len(part):  # a subquery may aggregate
            if part[i] == "(" and part[i + 1 : i + 2] and part[i + 1].lower() == "select":
                i = closing(part, i)
            elif part[i].lower() in AGGREGATE and part[i + 1 : i + 2] == ["("]:
                raise errors.InvalidAggregateUsage(f"{part[i]} in WHERE")
            i += 1
    at = [i for i, t in enumerate(low) if t in facts and i and low[i - 1] in ("from", "join", ",") and low[i + 1 : i + 2] != ["."]]
    named = [facts[low[i]] for i in at]
    if len(named) > 1 and any(low[i - 1] in ("join", ",") for i in at):
        if any(f.flat for f in named):
            raise errors.FlatTableJoin("a FLAT table cannot be joined")
        if len({f.database for f in named}) > 1:
            raise errors.CrossDatabaseJoin("tables of different databases cannot be joined")


def rewrite(text: str, facts: dict[str, TableFacts] | None = None) -> str:
    """Spark SQL for one SELECT in the dialect."""
    ts = tokens(text.strip().rstrip(";"))
    view = top_level(ts, "view", "as")
    items = None
    if view >= 0:
        if ts[view + 2 : view + 3] != ["("]:
            raise errors.DialectSyntaxError("VIEW AS needs a bracketed list")
        items, ts = ts[view + 3 : closing(ts, view + 2)], ts[:view]
        if any(t.lower() in AGGREGATE and items[i + 1 : i + 2] == ["("] for i, t in enumerate(items)):
            raise errors.ViewAsNotAllowed("an aggregate in VIEW AS")
        if any(t.lower() == "select" for t in items):
            raise errors.ViewAsNotAllowed("a subquery in VIEW AS")
    check_select(ts, facts or {})
    at = top_level(ts, "filter", "by")
    if at >= 0:
        where = top_level(ts, "where", start=at)
        rest = [e for e in (top_level(ts, *w, start=at) for w in (("group", "by"), ("having",), ("order", "by"), ("limit",), ("offset",))) if e >= 0]
        end = min([*([where] if where >= 0 else []), *rest], default=len(ts))
        condition = ts[at + 2 : end]
        if where >= 0:
            stop = min(rest, default=len(ts))
            ts = [*ts[:at], "WHERE", "(", *condition, ")", "AND", "(", *ts[where + 1 : stop], ")", *ts[stop:]]
        else:
            ts = [*ts[:at], "WHERE", *condition, *ts[end:]]
    inner = text_of(operators(ts))
    return inner if items is None else f"SELECT {text_of(operators(items))} FROM ({inner})"


def typed(spark: SparkSession, text: str) -> str:
    """Spark SQL in which / of two integers truncates. Whether both sides are integers is asked of the analyser, with
    the bitwise operator that takes nothing else in their place; no job runs."""
    ts, i = tokens(text), 0
    while i < len(ts):
        if ts[i] != "/":
            i += 1
            continue
        head, left = operand_before(ts[:i])
        while head and (head[-1] in ("*", "%", "/") or head[-1].lower() == "div"):
            before, more = operand_before(head[:-1])
            head, left = before, [*more, head[-1], *left]
        end = operand_after(ts, i + 1) if ts[i + 1] != "-" else operand_after(ts, i + 2)
        right = ts[i + 1 : end]
        try:
            spark.sql(text_of([*head, "(", "(", *left, ")", "|", "(", *right, ")", ")", *ts[end:]]))
        except AnalysisException:
            i += 1
            continue
        ts = [*head, "(", "(", *left, ")", "div", *right, ")", *ts[end:]]
        i = len(head) + len(left) + len(right) + 5
    return text_of(ts)


def query(spark: SparkSession, text: str, facts: dict[str, TableFacts] | None = None) -> DataFrame:
    """The rows of one SELECT in the dialect."""
    return spark.sql(typed(spark, rewrite(text, facts)))
