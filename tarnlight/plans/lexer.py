"""Text to tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import QueryError

TOKENS = re.compile(
    r"""(?P<space>\s+|--[^\n]*)
      | (?P<interval>\d+(?:ms|mo|[smhdwy])(?![A-Za-z0-9_]))
      | (?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|\.\d+)
      | (?P<param>\$\d+)
      | (?P<double>"(?:[^"\\]|\\.)*")
      | (?P<single>'(?:[^']|'')*')
      | (?P<name>[^\W\d]\w*(?:\.[^\W\d]\w*)*)
      | (?P<op><->|<=>|<\#>|\|\||==|!=|<>|<=|>=|[-+*/<>=~(),:;\[\]{}@.])""",
    re.X,
)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int

    @property
    def word(self) -> str:
        """The name in lower case, '' for others."""
        return self.text.lower() if self.kind == "name" else ""


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = TOKENS.match(text, at)
        if not m:
            raise QueryError(f"unexpected {text[at]!r} at {at}")
        kind, found = m.lastgroup, m.group()
        if kind == "double":
            found = re.sub(r"\\u\{([0-9a-fA-F]+)\}|\\(.)", lambda e: chr(int(e[1], 16)) if e[1] else ESCAPES.get(e[2], e[2]), found[1:-1], flags=re.S)
        elif kind == "single":
            found = found[1:-1].replace("''", "'")
        if kind != "space":
            out.append(Token(kind, found, at))
        at = m.end()
    out.append(Token("end", "", len(text)))
    return out
