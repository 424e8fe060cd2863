"""BibTeX: a tolerant reader that loses nothing, and a writer."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Kinds of blocks that are kept as they are, and fields whose white space matters.
KEPT_BLOCKS = ("comment", "preamble", "string")
VERBATIM = frozenset(("url", "doi", "file", "pdf", "eprint", "abstract", "verbatim"))
#: Fixed value: width of a field's name in written entries.
NAME_WIDTH = 12


class Malformed(ValueError):
    """A block that cannot be read; the reader keeps its text and goes on."""


@dataclass
class Item:
    """A piece of a file: an entry, or other text (comments, macros, what could not be read).

    fields are (name, value) in order, names lower-cased; the value of a field in exprs is its
    expression as written (macros, concatenations).
    """

    kind: str
    raw: str
    type: str | None = None
    key: str | None = None
    fields: list[tuple[str, str]] = field(default_factory=list)
    exprs: dict[str, str] = field(default_factory=dict)
    error: str | None = None


_START = re.compile(r"@\s*(?P<type>[A-Za-z]+)\s*(?P<opens>[{(])")
_MARKS = r"""(?P<mark>[{}()"#,=])|(?P<space>\s+)|(?P<word>"""
# inside groups and strings a backslash guards the character after it
_INSIDE = re.compile(_MARKS + r"""\\.?|[^\\{}()"#,=\s]+)""", re.S)
_OUTSIDE = re.compile(_MARKS + r"""[^{}()"#,=\s]+)""")
# the rest of a group without groups or guarded characters
_PLAIN = re.compile(r"([^\\{}]*)\}")


@dataclass
class _Block:
    """A block as it is read, token by token.

    The state is the method that takes the next token; it gives the state after it, or None to stay. stack holds
    what closes the delimiters that are open inside a value or a kept block.
    """

    text: str
    begin: int
    head: re.Match
    item: Item | None = None
    stack: list[str] = field(default_factory=list)
    closes: str = ""
    opened: int = 0
    name: str = ""
    pieces: list[tuple[str, bool]] = field(default_factory=list)
    since: int = 0
    end: int | None = None
    at: int = 0

    def read(self) -> tuple[Item, int]:
        """The block's item and where it ends."""
        self.closes = {"{": "}", "(": ")"}[self.head["opens"]]
        kept = self.head["type"].lower() in KEPT_BLOCKS
        state = self.kept if kept else self.key
        self.since = self.head.end()
        inside = (self.kept, self.group, self.quoted)
        self.at = self.head.end()
        while token := (_INSIDE if state in inside else _OUTSIDE).match(self.text, self.at):
            self.at = token.end()
            state = state(token[0], token) or state
            if self.end is not None:
                raw = self.text[self.begin : self.end]
                if kept:
                    return Item("other", raw), self.end
                self.item.raw = raw
                return self.item, self.end
        raise Malformed({"kept": "block not closed", "key": "key expected", "quoted": "string not closed"}.get(state.__name__, "entry not closed"))

    def kept(self, mark, token):
        """A comment, preamble or macro: anything up to its closing delimiter."""
        if mark == self.head["opens"]:
            self.stack.append(self.closes)
        elif mark == self.closes:
            if not self.stack:
                self.end = token.end()
            else:
                self.stack.pop()

    def key(self, mark, token):
        if mark == ",":
            key = self.text[self.since : token.start()].strip()
            if re.search(r"\s", key):
                raise Malformed("key expected")
            self.item = Item("entry", "", self.head["type"].lower(), key)
            return self.between
        if mark == self.closes:
            raise Malformed("key expected")

    def between(self, mark, token):
        """Between fields: commas, white space, the end of the entry, or the beginning of a name."""
        if mark == self.closes:
            self.end = token.end()
        elif mark != "," and not token["space"]:
            if token["mark"] and mark not in "()":
                raise Malformed(f"field name expected at {self.text[token.start() : token.start() + 30]!r}")
            self.since = token.start()
            return self.naming(mark, token) or self.naming

    def naming(self, mark, token):
        if mark == "=":
            self.name = self.text[self.since : token.start()].strip().lower()
            if re.search(r"""[\s{}"#(),]""", self.name):
                raise Malformed(f"field name expected at {self.text[self.since : self.since + 30]!r}")
            self.pieces, self.since = [], token.end()
            return self.value
        if token["mark"]:
            raise Malformed(f"field name expected at {self.text[self.since : self.since + 30]!r}")

    def value(self, mark, token):
        """A piece of a value is due: a group, a string or a bare word."""
        if token["space"]:
            return None
        self.opened = token.end()
        if mark == "{":
            if plain := _PLAIN.match(self.text, token.end()):
                self.pieces.append((plain[1], True))
                self.at = plain.end()
                return self.after
            self.stack = ["}"]
            return self.group
        if mark == '"':
            self.stack = []
            return self.quoted
        if mark in ("#", ",", self.closes):
            raise Malformed("value expected")
        self.opened = token.start()
        return self.bare

    def bare(self, mark, token):
        if token["space"] or mark in ("#", ",", self.closes):
            word = self.text[self.opened : token.start()]
            self.pieces.append((word, word.isdigit()))
            return self.after(mark, token) or self.after

    def group(self, mark, token):
        if mark == "{":
            self.stack.append("}")
        elif mark == "}":
            self.stack.pop()
            if not self.stack:
                self.pieces.append((self.text[self.opened : token.start()], True))
                return self.after

    def quoted(self, mark, token):
        """Quotes inside braces belong to the string."""
        if mark == '"' and not self.stack:
            self.pieces.append((self.text[self.opened : token.start()], True))
            return self.after
        if mark == "{":
            self.stack.append("}")
        elif mark == "}":
            self.stack.append("{") if not self.stack or self.stack[-1] == "{" else self.stack.pop()

    def after(self, mark, token):
        """After a piece: a # and another piece, or the end of the field."""
        if token["space"]:
            return None
        if mark == "#":
            return self.value
        literal = len(self.pieces) == 1 and self.pieces[0][1]
        value = self.pieces[0][0] if literal else self.text[self.since : token.start()].strip()
        self.item.fields.append((self.name, value))
        if not literal:
            self.item.exprs[self.name] = value
        return self.between(mark, token) or self.between


def parse(text: str | None) -> list[Item]:
    """All of a file in order. After a malformed block reading goes on at the next line that begins with @."""
    text = text or ""
    items, done = [], 0
    head = _START.search(text)
    while head:
        begin = head.start()
        try:
            item, end = _Block(text, begin, head).read()
        except Malformed as problem:
            ahead = re.compile(r"\n\s*@").search(text, begin + 1)
            end = ahead.start() + 1 if ahead else len(text)
            item = Item("other", text[begin:end].rstrip(), error=str(problem))
        items += [*_other(text[done:begin]), item]
        done, head = end, _START.search(text, end)
    return items + _other(text[done:])


def _other(text: str) -> list[Item]:
    """What stands between blocks, if anything."""
    return [Item("other", text.strip())] if text.strip() else []


def first_entry(text: str | None) -> Item | None:
    return next((i for i in parse(text) if i.kind == "entry"), None)


def field_of(item: Item, name: str) -> str | None:
    """The first value of a field."""
    return next((v for n, v in item.fields if n == name), None)


def render(type_: str, key: str, fields, exprs=()) -> str:
    """An entry as text: aligned names, values in braces unless they are expressions, no comma after the last."""
    lines = [f"  {n:<{NAME_WIDTH}} = {v if n in exprs else '{' + v + '}'}" for n, v in fields]
    return f"@{type_}{{{key},\n" + ",\n".join(lines) + "\n}" if lines else f"@{type_}{{{key},\n}}"


def fold_space(name: str, value: str) -> str:
    """A value with runs of white space as one space, unless its field is verbatim."""
    return value if name in VERBATIM else " ".join(value.split())


def relayout(item: Item) -> str:
    """An entry in the layout of render(): field order, values and expressions stay."""
    return render(item.type, item.key, [(n, fold_space(n, v)) for n, v in item.fields], item.exprs)


def sniff_key(raw: str | None) -> str | None:
    """The key of raw text by a pattern, also where it cannot be parsed."""
    found = re.match(r"\s*@\s*\w+\s*[{(]\s*([^,\s]+)", raw or "")
    return found[1] if found else None


def set_key(raw: str, key: str) -> str:
    """Raw text with another key."""
    return re.sub(r"^(\s*@\s*\w+\s*[{(]\s*)[^,\s]*", lambda m: m[1] + key, raw, count=1)


def same_entry(left: Item | tuple, right: Item | tuple) -> bool:
    """Whether two entries agree in type, key and fields, white space folded; of repeated fields the last counts."""
    def norm(e):
        type_, key, fields = (e.type, e.key, e.fields) if isinstance(e, Item) else e
        return type_, key, {n: " ".join(str(v).split()) for n, v in fields}

    return norm(left) == norm(right)
