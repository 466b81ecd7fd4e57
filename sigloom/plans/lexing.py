"""A lexer for the expression languages, and the Pratt loop their parsers share."""

from __future__ import annotations

import re
from dataclasses import dataclass

from sigloom.plans.vectors import QueryError

TOKEN = re.compile(
    r"""\s*(?:(?P<comment>\#[^\n]*)|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`[^`]*`)
    |(?P<duration>(?:[0-9]+(?:\.[0-9]+)?(?:ns|us|µs|ms|s|m|h|d|w|y|KiB|MiB|GiB|KB|MB|GB|B)\b)+|(?:[0-9]+(?:ms|s|m|h|d|w|y))+\b)
    |(?P<number>0x[0-9a-fA-F]+|[0-9]+(?:\.[0-9]*)?(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?)
    |(?P<name>[a-zA-Z_][a-zA-Z0-9_:]*)|(?P<op>\|=|\|~|=~|!~|!=|==|>=|<=|[-+*/%^(){}\[\],=<>|!@:.]))""",
    re.X,
)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    value: object
    at: int


def lex(text: str) -> list[Token]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise QueryError(f"unexpected {text[at:].strip()[:12]!r} at {at}")
        kind = m.lastgroup
        raw, at = m[kind], m.end()
        if kind == "comment":
            continue
        value: object = raw
        if kind == "string":
            value = raw[1:-1] if raw[0] == "`" else unquoted(raw)
        elif kind == "number":
            value = float(int(raw, 16)) if raw.startswith("0x") else float(raw)
        out.append(Token(kind, raw, value, m.start(kind)))
    return [*out, Token("end", "", None, len(text))]


#: Single-letter escapes.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "a": "\a", "v": "\v", "\\": "\\", '"': '"', "'": "'", "/": "/"}


def unquoted(raw: str) -> str:
    """The text of a quoted string; an escape that is none stays as written."""
    def plain(m: re.Match) -> str:
        return chr(int(m[1][1:], 16)) if len(m[1]) > 1 else ESCAPES.get(m[1], m[0])

    return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", plain, raw[1:-1], flags=re.S)


class Parser:
    """Common steps over the tokens of one query."""

    def __init__(self, text: str):
        self.text, self.tokens, self.i = text, lex(text), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def take(self, *texts: str) -> Token:
        token = self.now
        if texts and (token.kind == "string" or token.text not in texts):
            raise QueryError(f"expected {' or '.join(texts)} at {token.at}, not {token.text!r}")
        self.i += 1
        return token

    def has(self, *texts: str) -> bool:
        return self.now.kind != "string" and self.now.text in texts

    def maybe(self, *texts: str) -> Token | None:
        return self.take() if self.has(*texts) else None

    def of(self, kind: str) -> Token:
        if self.now.kind != kind:
            raise QueryError(f"expected a {kind} at {self.now.at}, not {self.now.text!r}")
        return self.take()

    def names(self) -> list[str]:
        """( a, b )"""
        self.take("(")
        out = []
        while not self.has(")"):
            out.append(self.of("name").text)
            if not self.maybe(","):
                break
        self.take(")")
        return out

    def matchers(self) -> list[tuple[str, str, str]]:
        """{ a = "x", b =~ "y" }, after the brace."""
        out = []
        while not self.has("}"):
            name = self.of("name").text
            op = self.take("=", "!=", "=~", "!~").text
            out.append((name, op, str(self.of("string").value)))
            if not self.maybe(","):
                break
        self.take("}")
        return out

    def finish(self) -> None:
        if self.now.kind != "end":
            raise QueryError(f"unexpected {self.now.text!r} at {self.now.at}")
