"""Chat formatting by a template compiler.

A template in a small, sandboxed language is parsed into a syntax tree, constants
are folded, and the tree becomes Python closures that render conversations and mark
the generated (learned) text.  The language::

    text {{ expression }}
    {% for m in messages %} ... {% endfor %}          loop.first, loop.last, loop.index0
    {% if c %} ... {% elif c %} ... {% else %} ... {% endif %}
    {% set name = expression %}
    {% generation %} ... {% endgeneration %}          what is rendered here is under the loss mask

Expressions know strings, integers, true, false, none, names, ``a.b`` and
``a['b']``, ``== != in``, ``and or not``, ``+`` and ``~`` (join as text), brackets
and the filters ``trim``, ``upper``, ``lower``, ``length`` and ``guard``.  Nothing
can be called, and fields are looked up in plain dictionaries only, so a template
cannot reach Python's objects.

``guard`` makes a text free of the template's control strings, reversibly: every
backslash is doubled, and a control string gets a single backslash after its first
character; :func:`unguard` takes them back.

Conversations stream through a task in order of their turns and leave as pages of
whole turns (about ``PAGE`` characters), so no conversation is held whole, however
long.

Defined results: a null text or role is empty.  Turns are ordered by turn, then role,
then text (nulls first); repeated rows are turns of their own.  Rows without a
conversation id form one conversation, null.  An empty table gives no rows.  Extra
columns play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value

by_value(__name__)

#: Characters after which a page ends, with the turn that passes them.
PAGE = 1_000_000

#: Control strings of TEMPLATE.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[END]")
TEMPLATE = (
    "{% for m in messages %}{% if loop.first %}<s>{% endif %}"
    "{% if m.role == 'user' %}[INST] {{ m.text | guard }} [/INST]"
    "{% elif m.role == 'assistant' %} {% generation %}{{ m.text | guard }}{% endgeneration %}</s>"
    "{% else %}[ROLE]{{ m.role | guard }}[/ROLE]{{ m.text | guard }}[END]{% endif %}{% endfor %}")


class TemplateError(ValueError):
    """The template does not belong to the language."""


def guard(text: str, controls: Iterable[str] = CONTROLS) -> str:
    text = text.replace("\\", "\\\\")
    starts = "|".join(map(re.escape, sorted(controls, key=len, reverse=True)))
    return re.sub(rf"(?=(?:{starts}))(.)", r"\1\\", text, flags=re.S) if any(c in text for c in controls) else text


def unguard(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


# --- expressions -------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z]\w*)"
                    r"|(?P<op>==|!=|[()\[\].|+~]))")
_WORDS = {"true": True, "false": False, "none": None}
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}


def _tokens(code: str) -> list[tuple[str, object]]:
    out, at = [], 0
    code = code.rstrip()
    while at < len(code):
        m = _TOKEN.match(code, at)
        if not m:
            raise TemplateError(f"cannot read {code[at:at + 20]!r}")
        kind, raw = m.lastgroup, m[m.lastgroup]
        if kind == "str":
            out.append(("const", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[0]), raw[1:-1], flags=re.S)))
        elif kind == "int":
            out.append(("const", int(raw)))
        elif kind == "name" and raw in _WORDS:
            out.append(("const", _WORDS[raw]))
        else:
            out.append((kind, raw))
        at = m.end()
    return [*out, ("end", None)]


class _Expression:
    """Recursive-descent parser: or, and, not, comparison, join, filter, field."""

    def __init__(self, code: str, filters: dict[str, Callable]):
        self.tokens, self.at, self.filters = _tokens(code), 0, filters
        self.tree = self.either()
        if self.tokens[self.at][0] != "end":
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r} in {code!r}")

    def take(self, *wanted: str) -> str | None:
        kind, value = self.tokens[self.at]
        if kind in ("op", "name") and value in wanted:
            self.at += 1
            return value
        return None

    def need(self, kind: str, value: str | None = None):
        got = self.tokens[self.at]
        if got[0] != kind or value is not None and got[1] != value:
            raise TemplateError(f"expected {value or kind}, not {got[1]!r}")
        self.at += 1
        return got[1]

    def either(self):
        left = self.both()
        while self.take("or"):
            left = ("or", left, self.both())
        return left

    def both(self):
        left = self.negated()
        while self.take("and"):
            left = ("and", left, self.negated())
        return left

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        left = self.joined()
        while op := self.take("==", "!=", "in"):
            left = (op, left, self.joined())
        return left

    def joined(self):
        left = self.filtered()
        while op := self.take("+", "~"):
            left = (op, left, self.filtered())
        return left

    def filtered(self):
        left = self.field()
        while self.take("|"):
            name = self.need("name")
            if name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            left = ("filter", name, left)
        return left

    def field(self):
        kind, value = self.tokens[self.at]
        if self.take("("):
            left = self.either()
            self.need("op", ")")
        elif kind == "const":
            self.at += 1
            left = ("const", value)
        else:
            left = ("name", self.need("name"))
        while op := self.take(".", "["):
            if op == ".":
                key = ("const", self.need("name"))
            else:
                key = self.either()
                self.need("op", "]")
            left = ("get", left, key)
        return left


def _text(v: object) -> str:
    return "" if v is None else v if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)


def _plus(a: object, b: object) -> object:
    return a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b)


def _get(a: object, b: object) -> object:
    return a.get(b) if isinstance(a, dict) else None


_BINARY = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: _text(a) in _text(b),
           "~": lambda a, b: _text(a) + _text(b), "+": _plus, "get": _get}


def _fold(tree: tuple, filters: dict[str, Callable]) -> tuple:
    """The tree with every part that depends on nothing replaced by its value."""
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    if kind == "filter":
        of = _fold(tree[2], filters)
        return ("const", filters[tree[1]](of[1])) if of[0] == "const" else ("filter", tree[1], of)
    if kind == "not":
        of = _fold(tree[1], filters)
        return ("const", not of[1]) if of[0] == "const" else ("not", of)
    a, b = _fold(tree[1], filters), _fold(tree[2], filters)
    if kind in ("and", "or"):
        if a[0] == "const":
            return (b if a[1] else a) if kind == "and" else (a if a[1] else b)
        return (kind, a, b)
    return ("const", _BINARY[kind](a[1], b[1])) if a[0] == b[0] == "const" else (kind, a, b)


def _value(tree: tuple, filters: dict[str, Callable]) -> Callable[[dict], object]:
    """Closure that computes a folded expression in an environment."""
    kind = tree[0]
    if kind == "const":
        return lambda env, v=tree[1]: v
    if kind == "name":
        return lambda env, n=tree[1]: env.get(n)
    if kind == "filter":
        return lambda env, f=filters[tree[1]], v=_value(tree[2], filters): f(v(env))
    if kind == "not":
        return lambda env, v=_value(tree[1], filters): not v(env)
    a, b = _value(tree[1], filters), _value(tree[2], filters)
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    return lambda env, f=_BINARY[kind]: f(a(env), b(env))


# --- templates ---------------------------------------------------------------------------------------------------

_PART = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)


class Template:
    """A compiled template.  ``render(messages)`` yields (text, learned) pieces
    and None at the end of every turn of the loop over the messages."""

    def __init__(self, source: str, controls: Iterable[str] = CONTROLS):
        controls = tuple(controls)
        self.filters = {"trim": lambda v: _text(v).strip(), "upper": lambda v: _text(v).upper(),
                        "lower": lambda v: _text(v).lower(), "length": lambda v: len(_text(v)),
                        "guard": lambda v: guard(_text(v), controls)}
        self.parts, at = [], 0
        for m in _PART.finditer(source):
            self.parts += [("text", source[at:m.start()]), ("show", m[1]) if m[1] is not None else ("tag", m[2].strip())]
            at = m.end()
        self.parts = [p for p in [*self.parts, ("text", source[at:])] if p[0] != "text" or p[1]]
        self.at = 0
        self.tree = self._block(())
        self.run = self._compile(self.tree)

    def _read(self, code: str) -> tuple:
        return _fold(_Expression(code, self.filters).tree, self.filters)

    def _block(self, ends: tuple[str, ...]) -> list[tuple]:
        """Nodes up to a tag in ``ends``; constants become text, neighbouring
        texts one node, branches with a constant condition go."""
        out: list[tuple] = []

        def add(node: tuple) -> None:
            if node[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + node[1])
            elif node != ("text", ""):
                out.append(node)

        while self.at < len(self.parts):
            kind, body = self.parts[self.at]
            word = body.split(None, 1)[0] if kind == "tag" and body else ""
            if kind == "tag" and word in ends:
                return out
            self.at += 1
            if kind == "text":
                add((kind, body))
            elif kind == "show":
                tree = self._read(body)
                add(("text", _text(tree[1])) if tree[0] == "const" else ("show", tree))
            elif word == "set" and (m := re.fullmatch(r"set\s+([A-Za-z]\w*)\s*=(?!=)(.*)", body, re.S)):
                add(("set", m[1], self._read(m[2])))
            elif word == "for" and (m := re.fullmatch(r"for\s+([A-Za-z]\w*)\s+in\s+([A-Za-z]\w*)", body)):
                inner = self._block(("endfor",))
                self._end("endfor")
                add(("for", m[1], m[2], inner))
            elif word == "generation":
                inner = self._block(("endgeneration",))
                self._end("endgeneration")
                add(("generation", inner))
            elif word == "if":
                for node in self._if(body[2:]):
                    add(node)
            else:
                raise TemplateError(f"unexpected tag {body!r}")
        if ends:
            raise TemplateError(f"no {ends[0]}")
        return out

    def _end(self, word: str) -> None:
        if self.at >= len(self.parts) or self.parts[self.at] != ("tag", word):
            raise TemplateError(f"no {word}")
        self.at += 1

    def _if(self, code: str) -> list[tuple]:
        test, yes = self._read(code), self._block(("elif", "else", "endif"))
        if self.at >= len(self.parts):
            raise TemplateError("no endif")
        body = self.parts[self.at][1]
        no: list[tuple] = []
        if body.startswith("elif"):
            self.at += 1
            no = self._if(body[4:])
        elif body.startswith("else"):
            self.at += 1
            no = self._block(("endif",))
            self._end("endif")
        else:
            self._end("endif")
        if test[0] == "const":
            return yes if test[1] else no
        return [("if", test, yes, no)]

    def _compile(self, nodes: list[tuple]) -> Callable[[dict, bool], Iterator]:
        steps = [self._step(n) for n in nodes]

        def run(env: dict, learned: bool) -> Iterator:
            for step in steps:
                yield from step(env, learned)
        return run

    def _step(self, node: tuple) -> Callable[[dict, bool], Iterator]:
        kind = node[0]
        if kind == "text":
            return lambda env, learned, t=node[1]: ((t, learned),)
        if kind == "show":
            return lambda env, learned, v=_value(node[1], self.filters): ((_text(v(env)), learned),)
        if kind == "generation":
            return lambda env, learned, run=self._compile(node[1]): run(env, True)
        if kind == "if":
            test, yes, no = _value(node[1], self.filters), self._compile(node[2]), self._compile(node[3])
            return lambda env, learned: (yes if test(env) else no)(env, learned)
        if kind == "set":
            def put(env: dict, learned: bool, name=node[1], v=_value(node[2], self.filters)) -> tuple:
                env[name] = v(env)
                return ()
            return put
        name, of, inner = node[1], node[2], self._compile(node[3])

        def loop(env: dict, learned: bool) -> Iterator:
            items, nothing = iter(env.get(of) or ()), object()
            item, i = next(items, nothing), 0
            while item is not nothing:
                after = next(items, nothing)
                env[name], env["loop"] = item, {"first": i == 0, "last": after is nothing, "index0": i}
                yield from inner(env, learned)
                if of == "messages":
                    yield None
                item, i = after, i + 1
        return loop

    def render(self, messages: Iterable[dict]) -> Iterator[tuple[str, bool] | None]:
        return self.run({"messages": messages}, False)


def format_conversations(turns: DataFrame, template: str = TEMPLATE, controls: Iterable[str] = CONTROLS, *,
                         conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, page, formatted, learned: the pages of each conversation, with the
    spans (start, end; code points of the page) that are under the loss mask."""
    controls = tuple(controls)
    Template(template, controls)                                         # a bad template fails here, not in a task

    def pages(rows: Iterator[dict], compiled: Template) -> Iterator[dict]:
        group = None

        def same() -> Iterator[dict]:                                    # the turns of the conversation at hand
            nonlocal group
            key = group["conv"]
            while group is not None and group["conv"] == key:
                yield {"role": group["role"] or "", "text": group["text"] or ""}
                group = next(rows, None)

        group = next(rows, None)
        while group is not None:
            key, page, out, size, spans = group["conv"], 0, [], 0, []
            for piece in compiled.render(same()):
                if piece is None:
                    if size >= PAGE:
                        yield {"conv": key, "page": page, "formatted": "".join(out), "learned": spans}
                        page, out, size, spans = page + 1, [], 0, []
                    continue
                piece, learned = piece
                if learned:
                    spans.append({"start": size, "end": size + len(piece)})
                out.append(piece)
                size += len(piece)
            if out or not page:
                yield {"conv": key, "page": page, "formatted": "".join(out), "learned": spans}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("conv", pa.int64()), ("page", pa.int64()), ("formatted", pa.string()),
                           ("learned", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
        held, size = [], 0
        for p in pages((r for b in batches for r in b.to_pylist()), Template(template, controls)):
            held.append(p)
            size += len(p["formatted"])
            if size > 4 * PAGE:
                yield pa.RecordBatch.from_pylist(held, kinds)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, kinds)

    rows = turns.select(F.col(conv).cast("bigint").alias("conv"), F.col(turn).cast("bigint").alias("turn"),
                        F.col(role).alias("role"), F.col(text).alias("text"))
    return (rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").mapInArrow(
        run, "conv bigint, page bigint, formatted string, learned array<struct<start: bigint, end: bigint>>")
        .withColumnRenamed("conv", conv))


def read_turns(page: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a page made with TEMPLATE."""
    at = 3 if page.startswith("<s>") else 0

    def until(mark: str, begin: int) -> tuple[str, int]:
        end = page.index(mark, begin)
        return unguard(page[begin:end]), end + len(mark)

    while at < len(page):
        if page.startswith("[INST] ", at):
            said, at = until(" [/INST]", at + 7)
            yield "user", said
        elif page.startswith(" ", at):
            said, at = until("</s>", at + 1)
            yield "assistant", said
        else:
            role, at = until("[/ROLE]", at + 6)
            said, at = until("[END]", at)
            yield role, said


def digest(formatted: DataFrame, *, conv: str = "conv_id") -> DataFrame:
    """Per conversation, read back from its pages: number and digest of the
    turns, size and digest of the learned text, size of the formatted text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []

        def done() -> dict:
            return {"conv": key[0], "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2],
                    "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4]}

        kinds = pa.schema([("conv", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                           ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        for batch in batches:
            for r in batch.to_pylist():
                if key != (r["conv"],):
                    if key:
                        out.append(done())
                    key, state = (r["conv"],), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                page = r["formatted"]
                for role, said in read_turns(page):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "replace"))
                for span in r["learned"]:
                    said = unguard(page[span["start"]:span["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode("utf-8", "replace"))
                state[4] += len(page)
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_pylist(out, kinds)
                out = []
        if key:
            out.append(done())
        if out:
            yield pa.RecordBatch.from_pylist(out, kinds)

    return (formatted.withColumnRenamed(conv, "conv").repartition("conv").sortWithinPartitions("conv", "page").mapInArrow(
        run, "conv bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
        .withColumnRenamed("conv", conv))
