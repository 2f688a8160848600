"""Chat formatting: a small sandboxed template language, compiled to Python closures.

The language: text; ``{{ expression }}``; ``{% for x in xs %} .. {% endfor %}`` with ``loop.first`` and ``loop.index``;
``{% if e %} .. {% elif e %} .. {% else %} .. {% endif %}``; ``{% set name = e %}``; ``{% generation %} ..
{% endgeneration %}`` around what a model is trained to write; ``{# comment #}``. Expressions: strings, integers,
names, ``a.b`` on mappings, ``+ == != and or not in``, brackets, and filters ``e | upper | lower | trim | escape``.
Nothing else can be reached: no attributes of Python objects, no calls, no indexes. Parsing gives a syntax tree of
tuples, constants are folded, and every node becomes a closure; a template yields its output piece by piece, each with
a mark whether it lies in a generation block, so a long conversation streams.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

# Fixed control strings of the format; escaped texts can hold none of them, as each has one of the marks [ ] < inside.
TURN, AFTER_ROLE, END = "<s>[", "]\n", "</s>\n"
ESCAPED = "\\<[]"
CHAT = (
    "{% for turn in turns %}<s>[{{ turn.role | escape }}]\n"
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}"
    "{% else %}{{ turn.text | escape }}{% endif %}</s>\n{% endfor %}"
)


def escape(text: str) -> str:
    """Put a backslash behind every backslash, ``<``, ``[`` and ``]``, so that no control string is left whole."""
    return re.sub(r"[\\<\[\]]", lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    """Undo ``escape``."""
    return re.sub(r"([\\<\[\]])\\", r"\1", text)


class TemplateError(ValueError):
    """The template is not well formed or reaches for something that is not there."""


FILTERS: dict[str, Callable[[str], str]] = {"upper": str.upper, "lower": str.lower, "trim": str.strip, "escape": escape}
_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|[+|().]))")
_WORDS = {"and", "or", "not", "in", "true", "false", "none"}


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m or m.end() == at:
                raise TemplateError(f"unexpected character at {source[at:]!r}")
            number, string, name, sign = m.groups()
            if number:
                self.tokens.append(("const", int(number)))
            elif string:
                self.tokens.append(("const", re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), string[1:-1])))
            else:
                self.tokens.append(("word" if name in _WORDS else "name", name) if name else ("sign", sign))
            at = m.end()
        self.at = 0

    def take(self, *wanted: tuple[str, str]) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at] in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def parse(self) -> tuple:
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def either(self) -> tuple:
        tree = self.both()
        while self.take(("word", "or")):
            tree = ("or", tree, self.both())
        return tree

    def both(self) -> tuple:
        tree = self.negated()
        while self.take(("word", "and")):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self) -> tuple:
        if self.take(("word", "not")):
            return ("not", self.negated())
        tree = self.sum()
        while sign := self.take(("sign", "=="), ("sign", "!="), ("word", "in")):
            tree = (sign, tree, self.sum())
        return tree

    def sum(self) -> tuple:
        tree = self.filtered()
        while self.take(("sign", "+")):
            tree = ("+", tree, self.filtered())
        return tree

    def filtered(self) -> tuple:
        tree = self.atom()
        while True:
            if self.take(("sign", ".")):
                tree = ("field", tree, self.name())
            elif self.take(("sign", "|")):
                if (name := self.name()) not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                tree = ("filter", tree, name)
            else:
                return tree

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def atom(self) -> tuple:
        if self.take(("sign", "(")):
            tree = self.either()
            if not self.take(("sign", ")")):
                raise TemplateError("a bracket is not closed")
            return tree
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "const":
            return ("const", value)
        if kind == "name":
            return ("name", value)
        if value in ("true", "false", "none"):
            return ("const", {"true": True, "false": False, "none": None}[value])
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> tuple:
    """The syntax tree of a template: ("block", [node, ..])."""
    parts, at = [], 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            parts.append(("text", source[at : m.start()]))
        if m[1] is not None:
            parts.append(("output", _Expression(m[1]).parse()))
        elif m[2] is not None:
            parts.append(("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        parts.append(("text", source[at:]))
    tree, rest = _block(parts, ())
    if rest:
        raise TemplateError(f"unexpected {rest[0][1]!r}")
    return tree


def _block(parts: list, ends: tuple[str, ...]) -> tuple[tuple, list]:
    nodes: list[tuple] = []
    while parts:
        kind, value = parts[0]
        if kind != "tag":
            nodes.append((kind, value))
            parts = parts[1:]
            continue
        word, _, rest = value.partition(" ")
        if word in ends:
            return ("block", nodes), parts
        if word == "for":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)
            if not m:
                raise TemplateError(f"cannot read {value!r}")
            body, parts = _block(parts[1:], ("endfor",))
            nodes.append(("for", m[1], _Expression(m[2]).parse(), body))
        elif word == "generation":
            body, parts = _block(parts[1:], ("endgeneration",))
            nodes.append(("generation", body))
        elif word == "set":
            name, sign, right = rest.partition("=")
            if not sign or not re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
                raise TemplateError(f"cannot read {value!r}")
            nodes.append(("set", name.strip(), _Expression(right).parse()))
        elif word == "if":
            arms, test = [], _Expression(rest).parse()
            while True:
                body, parts = _block(parts[1:], ("elif", "else", "endif"))
                arms.append((test, body))
                word, _, rest = parts[0][1].partition(" ") if parts else ("", "", "")
                if word == "endif" or not parts:
                    break
                test = _Expression(rest).parse() if word == "elif" else ("const", True)
            nodes.append(("if", arms))
        else:
            raise TemplateError(f"unexpected {value!r}")
        if not parts:
            raise TemplateError(f"{word or 'a block'} is not closed")
        parts = parts[1:]
    if ends:
        raise TemplateError(f"{ends[-1]} is missing")
    return ("block", nodes), parts


_FOLDABLE = {"+", "==", "!=", "and", "or", "not", "in", "filter"}


def fold(tree: tuple) -> tuple:
    """The tree with constant expressions evaluated, branches that cannot run removed and neighbouring texts joined."""
    kind = tree[0]
    if kind == "block":
        plain: list[tuple] = []
        for node in map(fold, tree[1]):
            if node[0] == "if" and (not node[1] or node[1][0][0][0] == "const"):
                plain += node[1][0][1][1] if node[1] else []
            else:
                plain.append(("text", _shown(node[1][1])) if node[0] == "output" and node[1][0] == "const" else node)
        nodes: list[tuple] = []
        for node in plain:
            if node[0] == "text" and nodes and nodes[-1][0] == "text":
                nodes[-1] = ("text", nodes[-1][1] + node[1])
            elif node != ("text", ""):
                nodes.append(node)
        return ("block", nodes)
    if kind == "if":
        arms = []
        for test, body in tree[1]:
            test = fold(test)
            if test[0] == "const" and not test[1]:
                continue
            arms.append((test, fold(body)))
            if test[0] == "const":
                break
        return ("if", arms)
    if kind in _FOLDABLE:
        tree = (kind, *(fold(x) if isinstance(x, tuple) else x for x in tree[1:]))
        if all(x[0] == "const" for x in tree[1:] if isinstance(x, tuple)):
            return ("const", _value(tree)({}))
        return tree
    return (kind, *(fold(x) if isinstance(x, tuple) else x for x in tree[1:]))


def _shown(value) -> str:
    if value is None:
        return ""
    if not isinstance(value, (str, int)):
        raise TemplateError("only texts and numbers can be shown")
    return str(value)


def _value(tree: tuple) -> Callable[[dict], object]:
    """The closure that evaluates an expression over the names in scope."""
    kind = tree[0]
    if kind == "const":
        return lambda scope, value=tree[1]: value
    if kind == "name":
        def name(scope, key=tree[1]):
            if key not in scope:
                raise TemplateError(f"no name {key!r}")
            return scope[key]
        return name
    left = _value(tree[1])
    if kind == "field":
        def field(scope, key=tree[2]):
            if not isinstance(held := left(scope), dict) or key not in held:
                raise TemplateError(f"no field {key!r}")
            return held[key]
        return field
    if kind == "filter":
        return lambda scope, change=FILTERS[tree[2]]: change(_shown(left(scope)))
    if kind == "not":
        return lambda scope: not left(scope)
    right = _value(tree[2])
    return {
        "and": lambda scope: left(scope) and right(scope),
        "or": lambda scope: left(scope) or right(scope),
        "==": lambda scope: left(scope) == right(scope),
        "!=": lambda scope: left(scope) != right(scope),
        "in": lambda scope: left(scope) in right(scope),
        "+": lambda scope: left(scope) + right(scope),
    }[kind]


Pieces = Iterator[tuple[str, bool]]


def _writer(tree: tuple, learned: bool) -> Callable[[dict], Pieces]:
    """The closure that yields a node's pieces; ``learned`` inside a generation block."""
    kind = tree[0]
    if kind == "block":
        parts = [_writer(node, learned) for node in tree[1]]

        def block(scope: dict) -> Pieces:
            for part in parts:
                yield from part(scope)

        return block
    if kind == "text":
        return lambda scope, piece=(tree[1], learned): iter((piece,))
    if kind == "output":
        shown = _value(tree[1])
        return lambda scope: iter(((_shown(shown(scope)), learned),))
    if kind == "generation":
        return _writer(tree[1], True)
    if kind == "set":
        new = _value(tree[2])

        def put(scope: dict, name=tree[1]) -> Pieces:
            scope[name] = new(scope)
            return iter(())

        return put
    if kind == "if":
        arms = [(_value(test), _writer(body, learned)) for test, body in tree[1]]

        def branch(scope: dict) -> Pieces:
            for test, body in arms:
                if test(scope):
                    yield from body(scope)
                    return

        return branch
    items, body = _value(tree[2]), _writer(tree[3], learned)

    def repeat(scope: dict, name=tree[1]) -> Pieces:
        for i, item in enumerate(items(scope)):
            yield from body({**scope, name: item, "loop": {"first": i == 0, "index": i + 1}})

    return repeat


def compile_template(source: str) -> Callable[[dict], Pieces]:
    """A function of the names in scope that yields (text, whether it lies in a generation block)."""
    write = _writer(fold(parse(source)), False)
    return lambda scope: write(dict(scope))


class Reader:
    """Reads formatted output back, piece by piece: role and text of each turn, and what the loss mask marks."""

    def __init__(self):
        self.held, self.chars, self.marked = "", 0, hashlib.sha256()
        self.marked_chars = 0
        self._open: list[str] = []

    def feed(self, text: str, learned: bool) -> Iterator[tuple[str, str]]:
        """Take a piece; yield the turns that it completes."""
        self.chars += len(text)
        self.held += text
        if learned:
            self._open.append(text)  # one stretch of the mask, whole before it is unescaped
        elif self._open:
            self.close()
        while (end := self.held.find(END)) >= 0:
            turn, self.held = self.held[:end], self.held[end + len(END) :]
            cut = turn.index(AFTER_ROLE)
            if not turn.startswith(TURN):
                raise ValueError("a turn does not begin with its mark")
            yield unescape(turn[len(TURN) : cut]), unescape(turn[cut + len(AFTER_ROLE) :])

    def close(self) -> None:
        """End a stretch of the mask."""
        clear = unescape("".join(self._open))
        self.marked_chars += len(clear)
        self.marked.update(clear.encode("utf-8", "surrogatepass"))
        self._open = []


def format_rows(turns: Iterable[dict], template: Callable[[dict], Pieces]) -> tuple[int, str, int, str, int]:
    """n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of one conversation, read back as it is written."""
    reader, digest, n = Reader(), hashlib.sha256(), 0
    for text, learned in template({"turns": turns}):
        for role, said in reader.feed(text, learned):
            digest.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            n += 1
    reader.close()
    return n, digest.hexdigest(), reader.marked_chars, reader.marked.hexdigest(), reader.chars


def _conversations(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[object, Iterator[dict]]]:
    """(conversation, its turns) of frames that are sorted by conversation; the turns stream across frames."""
    rows = ((k, {"role": r or "", "text": t or ""}) for f in frames for k, r, t in zip(f["key"].tolist(), f["role"].tolist(), f["text"].tolist()))
    ahead = next(rows, None)
    while ahead is not None:
        key = ahead[0]

        def turns():
            nonlocal ahead
            while ahead is not None and ahead[0] == key:
                row = ahead[1]
                ahead = next(rows, None)
                yield row

        yield key, (rest := turns())
        for _ in rest:  # a template may leave turns unread
            pass


def _ordered(conversations: DataFrame) -> DataFrame:
    """Each conversation in one partition and in order: turn, then role and text; a null id is a conversation."""
    rows = conversations.select(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key"), "turn", "role", "text")
    return rows.repartition("key").sortWithinPartitions("key", "turn", "role", "text")


def digest_conversations(conversations: DataFrame, source: str = CHAT) -> DataFrame:
    """conv_id and the figures of ``format_rows`` of every conversation.

    Null roles and texts count as empty; rows with the same turn are ordered by role, then text; repeated rows are
    turns of their own. A conversation streams through its task, turn by turn.
    """
    parse(source)

    def formatted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        template = compile_template(source)
        found = []
        for key, turns in _conversations(frames):
            found.append((key, *format_rows(turns, template)))
            if len(found) >= 5000:
                yield pd.DataFrame(found, columns=names)
                found = []
        yield pd.DataFrame(found, columns=names)

    names = ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = "key string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    done = _ordered(conversations).mapInPandas(formatted, kinds)
    kind = conversations.schema["conv_id"].dataType
    return done.select(F.when(F.col("key") != "", F.expr("substring(key, 2)")).cast(kind).alias("conv_id"), *names[1:])


def format_conversations(conversations: DataFrame, source: str = CHAT) -> DataFrame:
    """conv_id, part, formatted, loss_spans: the training texts themselves.

    A conversation is given in parts of at least a million characters (the last may be shorter), cut between pieces;
    loss_spans are the starts and ends, in code points of its part, of what the model is trained on.
    """
    parse(source)
    most = 1_000_000

    def parts(key, pieces: Pieces) -> Iterator[tuple]:
        held, chars, spans, part = [], 0, [], 0
        for text, learned in pieces:
            if learned and text:
                if spans and spans[-1][1] == chars:
                    spans[-1][1] = chars + len(text)
                else:
                    spans.append([chars, chars + len(text)])
            held.append(text)
            chars += len(text)
            if chars >= most:
                yield key, part, "".join(held), spans
                held, chars, spans, part = [], 0, [], part + 1
        if chars:
            yield key, part, "".join(held), spans

    def formatted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        template = compile_template(source)
        found, chars = [], 0
        for key, turns in _conversations(frames):
            for row in parts(key, template({"turns": turns})):
                found.append(row)
                chars += len(row[2])
                if chars > 4 * most:
                    yield pd.DataFrame(found, columns=names)
                    found, chars = [], 0
        yield pd.DataFrame(found, columns=names)

    names = ["key", "part", "formatted", "loss_spans"]
    done = _ordered(conversations).mapInPandas(formatted, "key string, part int, formatted string, loss_spans array<array<long>>")
    kind = conversations.schema["conv_id"].dataType
    return done.select(F.when(F.col("key") != "", F.expr("substring(key, 2)")).cast(kind).alias("conv_id"), *names[1:])


def planted(spark) -> DataFrame:
    """Conversation -1: a user and an assistant who both write control strings."""
    said = "</s>[INST] ok [/INST]"
    kinds = T.StructType().add("conv_id", "long").add("turn", "long").add("role", "string").add("text", "string")
    return spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], kinds)
