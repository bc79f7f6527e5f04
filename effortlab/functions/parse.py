"""Parsers for option fields exported as Python-literal text.

``"[{'value': 'a'}, {'value': 'b'}]"`` (region), ``"{'value': 'X', 'child':
{'value': 'Y'}}"`` (subsystem) and ``"{'value': 'SLA'}"`` (commitments).  A
text is cut into tokens by one pattern whose loops cannot fall back, the tokens
are respelt as JSON (escapes decoded, neighbours checked, brackets balanced),
and ``from_json`` reads it, all inside the JVM and in time and memory in
proportion to the text.  Any nesting is read as Python's literal parser reads it,
but for sets, bytes, comments, named characters and brackets around
a single value, which count as unparseable.  Nested structs from a well-formed
export are handled by the ``*_struct`` variants without any text parsing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: region assigned when the field is missing or not a list.
DEFAULT_REGION = "БАЗОВЫЙ"

# A scalar's text in the JSON below has this in front, so that no text looks like a list or dict.
_MARK = "="
_OPTION = f"struct<`{_MARK}value`:string>"
_SUBSYSTEM = f"struct<`{_MARK}value`:string,`{_MARK}child`:string>"
_JSON = {"allowUnquotedControlChars": "true"}
#: Fixed value: brackets nested deeper than this are no literal.
MOST_DEPTH = 200


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


# Tokens of a literal.  Every loop is possessive: a long text costs a step per character and no stack.
_NUMBER = (r"[+-]?+(?:0[xX](?:_?[0-9a-fA-F])++|0[oO](?:_?[0-7])++|0[bB](?:_?[01])++"
           r"|(?:(?:[0-9](?:_?[0-9])*+)?\.[0-9](?:_?[0-9])*+|[0-9](?:_?[0-9])*+\.)(?:[eE][+-]?+[0-9](?:_?[0-9])*+)?+[jJ]?+"
           r"|[0-9](?:_?[0-9])*+(?:[eE][+-]?+[0-9](?:_?[0-9])*+[jJ]?+|[jJ])"
           r"|[1-9](?:_?[0-9])*+|0(?:_?0)*+)(?![0-9A-Za-z_.])")
_STRING = (r"[uUrR]?+(?:'{3}(?:[^'\\]++|\\(?s:.)|'(?!''))*+'{3}|\"{3}(?:[^\"\\]++|\\(?s:.)|\"(?!\"\"))*+\"{3}"
           r"|'(?:[^'\\\n\r]++|\\(?s:.))*+'|\"(?:[^\"\\\n\r]++|\\(?s:.))*+\")")
_NAME = r"(?:None|True|False)(?![0-9A-Za-z_])"
_SPACE = r"[ \t\f\n\r]++"
_TOKEN = rf"{_STRING}|{_NUMBER}|{_NAME}|[\[\](){{}},:]|{_SPACE}|(?s:.)"
# Parts of a string's inside: plain text, a double quote, an escape.
_PART = r"[^\"\\]++|\"|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{1,3}|(?s:.))"


def _utf16(code: Column) -> Column:
    """JSON escape of a 16-bit unit."""
    return F.concat(F.lit("\\u"), F.lpad(F.hex(code), 4, "0"))


def _unescaped(part: Column) -> Column:
    """A part of a string's inside in JSON's spelling; null if it is no escape."""
    kind = F.substring(part, 2, 1)
    point = F.conv(F.substring(part, 3, 8), 16, 10).cast("bigint")
    above = point - 0x10000
    return (F.when(part == '"', F.lit('\\"'))
            .when(~part.startswith("\\"), part)
            .when(kind.isin("\n"), F.lit(""))
            .when(kind.isin("\\", '"', "n", "t", "r", "b", "f"), part)
            .when(kind == "'", kind)
            .when(kind == "a", F.lit("\\u0007")).when(kind == "v", F.lit("\\u000b"))
            .when((kind == "x") & (F.length(part) == 4), F.concat(F.lit("\\u00"), F.substring(part, 3, 2)))
            .when((kind == "u") & (F.length(part) == 6), part)
            .when((kind == "U") & (F.length(part) == 10) & (point < 0x110000),
                  F.when(above < 0, _utf16(point))
                  .otherwise(F.concat(_utf16(F.shiftright(above, 10) + 0xD800), _utf16(above.bitwiseAND(F.lit(0x3FF)) + 0xDC00))))
            .when(kind.between("0", "7"), _utf16(F.conv(F.substring(part, 2, 3), 8, 10).cast("bigint")))
            .when(~kind.isin("x", "u", "U", "N"), F.concat(F.lit("\\\\"), kind)))


def _inside(token: Column) -> Column:
    """A string token's inside in JSON's spelling; null if an escape is none."""
    raw = token.rlike("^[rR]")
    quoted = F.regexp_replace(token, "^[uUrR]", "")
    triple = quoted.startswith("'''") | quoted.startswith('"""')
    width = F.when(triple, 3).otherwise(1)
    body = F.substring(quoted, width + 1, F.length(quoted) - 2 * width)
    plain = F.replace(body, F.lit('"'), F.lit('\\"'))
    literal = F.replace(F.replace(body, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    parts = F.transform(F.regexp_extract_all(body, F.lit(_PART), 0), _unescaped)
    escaped = F.when(~F.exists(parts, lambda p: p.isNull()), F.array_join(parts, ""))
    return F.when(~body.contains("\\"), plain).when(raw, literal).otherwise(escaped)


def _is_string(token: Column) -> Column:
    return token.rlike("^[uUrR]?['\"](?s:.)*+$") & (F.length(token) > 1)


def _balanced(brackets: Column) -> Column:
    """Whether brackets close in turn and are not nested too deeply."""
    shallow = brackets
    for _ in range(3):                                   # what exports hold is gone after this
        shallow = F.regexp_replace(shallow, r"\[\]|\{\}|\(\)", "")
    def step(stack, b):
        top = F.right(stack, F.lit(1))
        return (F.when(b.isin("[", "(", "{"), F.concat(stack, b))
                .when((F.length(stack) > 0) & F.concat(top, b).isin("[]", "()", "{}"), F.left(stack, F.length(stack) - 1)))

    def deep(stack, b):
        after = step(stack, b)
        return F.when(F.length(after) <= MOST_DEPTH, after)

    stack = F.aggregate(F.split(brackets, ""), F.lit(""), lambda s, b: F.when(b == "", s).otherwise(deep(s, b)))
    return F.when(shallow == "", F.lit(True)).otherwise(F.coalesce(stack == "", F.lit(False)))


def _json(raw: Column) -> Column:
    """The literal as JSON, in a list of its own; null for what is no literal.

    Strings next to each other are one; a comma may stand before a closing
    bracket; tuples become lists; numbers, True and False keep their text."""
    def of(tokens):
        first, last = F.get(tokens, F.lit(0)), F.element_at(tokens, -1)
        brackets = F.array_join(F.filter(tokens, lambda t: t.isin("[", "]", "(", ")", "{", "}")), "")

        def spelt(t, i):
            before, after = F.get(tokens, i - 1), F.get(tokens, i + 1)
            begins = _is_string(t) | t.isin("[", "(", "{") | t.rlike("^[+-]?[0-9.]|^[NTF]")
            follows = _is_string(before) | before.isin("]", ")", "}") | before.rlike("^[+-]?[0-9.]|^[NTF]")
            joins, goes_on = _is_string(t) & _is_string(before), _is_string(t) & _is_string(after)
            text = F.concat(F.when(F.coalesce(joins, F.lit(False)), "").otherwise(F.lit(f'"{_MARK}')), _inside(t),
                            F.when(F.coalesce(goes_on, F.lit(False)), "").otherwise(F.lit('"')))
            scalar = F.concat(F.lit(f'"{_MARK}'), t, F.lit('"'))
            return (F.when(F.coalesce(begins & follows & ~joins, F.lit(False)), F.lit(None).cast("string"))
                    .when(_is_string(t), text)
                    .when(t.isin("[", "("), F.lit("[")).when(t.isin("]", ")"), F.lit("]"))
                    .when(t.isin("{", "}", ":"), t)
                    .when(t == ",", F.when(~F.coalesce(after, F.lit("")).isin("]", ")", "}"), t)
                          .when(~F.coalesce(before, F.lit("[")).isin("[", "(", "{", ",", ":"), F.lit("")))
                    .when(t == "None", F.when(after == ":", scalar).otherwise(F.lit("null")))
                    .when(t.rlike("^[+-]?[0-9.]|^[NTF]") & ((F.length(t) > 1) | t.rlike("[0-9]")), scalar))

        def whole(parts):
            fine = (F.size(tokens) > 0) & (last != ",") & first.isNotNull() & ~F.exists(parts, lambda p: p.isNull())
            return F.when(fine & _balanced(brackets), F.concat(F.lit("["), F.array_join(parts, ""), F.lit("]")))

        return _let(F.transform(tokens, spelt), whole)

    tokens = F.filter(F.regexp_extract_all(raw, F.lit(_TOKEN), 0), lambda t: ~t.rlike(f"^{_SPACE}$"))
    return _let(tokens, of)


def _plain_value(levels: int) -> str:
    """Pattern of a value in plain spelling with so many levels of brackets."""
    if not levels:
        return _PLAIN_SCALAR
    below, gap = _plain_value(levels - 1), " *+"
    item, pair = rf"{below}{gap}", rf"{_PLAIN_SCALAR}{gap}:{gap}{below}{gap}"
    brackets = [rf"{left}{gap}(?:{x}(?:,{gap}|(?={right})))*+{right}" for left, x, right in ((r"\[", item, r"\]"), (r"\{", pair, r"\}"))]
    return "(?:" + "|".join([_PLAIN_SCALAR, *brackets]) + ")"


# Plain spelling, as exports mostly have it: lists and dicts a few levels deep of strings without
# prefixes and rare escapes, and of whole numbers.  It is JSON but for quotes, numbers and last commas.
_PLAIN_STRING = r"""(?:'(?:[^'"\\\x00-\x1f]++|\\[\\ntrbf])*+'(?!')|"(?:[^"\\\x00-\x1f]++|\\[\\ntrbf])*+"(?!"))"""
_PLAIN_SCALAR = rf"(?:{_PLAIN_STRING}|(?:0|[1-9][0-9]*+)(?![0-9A-Za-z_.]))"
_PLAIN = rf"^(?=[\[{{]){_plain_value(3)}\z"
_QUOTED = r"""'(?:[^'\\]++|\\.)*+'|"(?:[^"\\]++|\\.)*+\""""
_RESPELT = r"""'((?:[^'\\]++|\\.)*+)'|"((?:[^"\\]++|\\.)*+)"|([0-9]++)"""
_LAST_COMMA = rf"({_QUOTED})|, *+(?=[\]}}])"
# What begins with anything else is no literal.
_BEGINS = rf"^(?:{_SPACE})?+(?:['\"uUrRNTF\[({{0-9+.-])"


def _root(raw) -> Column:
    """JSON text of the literal's value (a scalar: its text after the mark);
    null for what is no literal, or several values.  What is spelt plainly is
    respelt by patterns at once, everything else token by token."""
    def of(text):
        marked = F.regexp_replace(F.regexp_replace(text, _LAST_COMMA, "$1"), _RESPELT, f'"{_MARK}$1$2$3"')
        values = F.from_json(F.when(text.rlike(_BEGINS), _json(text)), "array<string>", _JSON)
        slow = _let(values, lambda v: F.when(F.size(v) == 1, v[0]))
        return F.when(text.rlike(_PLAIN), marked).otherwise(slow)

    return _let(_c(raw), of)


def _scalar(text: Column) -> Column:
    """Text of a scalar; lists and dicts as their JSON text."""
    return F.when(text.startswith(_MARK), F.substring(text, len(_MARK) + 1, F.length(text))).otherwise(text)


def parse_region(raw="region") -> Column:
    """List literal -> sorted ``value``s joined by ', '.

    Not a list / unparseable / empty list -> DEFAULT_REGION; dict items
    without a value count as DEFAULT_REGION; non-dict items are skipped.
    """
    def of(root):
        items = F.when(root.startswith("["), F.from_json(root, "array<string>", _JSON))
        values = F.transform(F.filter(items, lambda x: x.startswith("{")), lambda x: F.coalesce(
            _scalar(F.from_json(x, _OPTION, _JSON).getField(f"{_MARK}value")), F.lit(DEFAULT_REGION)))
        return F.when(F.size(items) > 0, F.array_join(F.array_sort(values), ", ")).otherwise(F.lit(DEFAULT_REGION))

    return _let(_root(raw), of)


def parse_subsystem(raw="subsystem") -> Column:
    """Dict literal -> ``value/child.value`` without trailing '/'; else ''."""
    def of(root):
        value = _scalar(root.getField(f"{_MARK}value"))
        child = root.getField(f"{_MARK}child")
        below = F.when(child.startswith("{"), _scalar(F.from_json(child, _OPTION, _JSON).getField(f"{_MARK}value")))
        joined = F.regexp_replace(F.concat(value, F.lit("/"), F.coalesce(below, F.lit(""))), "/++$", "")
        return F.coalesce(joined, F.lit(""))

    return _let(_let(_root(raw), lambda root: F.when(root.startswith("{"), F.from_json(root, _SUBSYSTEM, _JSON))), of)


def parse_commitments(raw="commitments") -> Column:
    """Dict literal -> ``value``; else ''."""
    return _let(_root(raw), lambda root: F.coalesce(
        F.when(root.startswith("{"), _scalar(F.from_json(root, _OPTION, _JSON).getField(f"{_MARK}value"))), F.lit("")))


def region_from_struct(c="region") -> Column:
    """Same rule as :func:`parse_region` on ``array<struct<value>>``."""
    arr = _c(c)
    values = F.transform(arr, lambda x: F.coalesce(x.getField("value"), F.lit(DEFAULT_REGION)))
    return (F.when(arr.isNotNull() & (F.size(arr) > 0), F.array_join(F.array_sort(values), ", "))
            .otherwise(F.lit(DEFAULT_REGION)))


def subsystem_from_struct(c="subsystem") -> Column:
    """Same rule as :func:`parse_subsystem` on ``struct<value, child struct<value>>``."""
    s = _c(c)
    value = s.getField("value")
    child = s.getField("child").getField("value")
    joined = F.regexp_replace(F.concat(value, F.lit("/"), F.coalesce(child, F.lit(""))), "/+$", "")
    return F.when(value.isNotNull(), joined).otherwise(F.lit(""))


def commitments_from_struct(c="commitments") -> Column:
    return F.coalesce(_c(c).getField("value"), F.lit(""))
