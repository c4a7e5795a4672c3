"""Tokens of Rust source text, with their byte offsets."""

from __future__ import annotations

import re
from dataclasses import dataclass

TOKEN = re.compile(
    rb"""
    (?P<space>\s+)
  | (?P<doc>//[/!][^\n]*|/\*[*!](?!/))
  | (?P<line>//[^\n]*)
  | (?P<block>/\*)
  | (?P<raw>(?:b|c|br|cr)?r(?P<hash>\#*)")
  | (?P<string>[bc]?"(?:[^"\\]|\\.)*")
  | (?P<char>b?'(?:[^'\\\n\x80-\xff]|[\xc0-\xff][\x80-\xbf]*|\\(?:x[0-9A-Fa-f]{2}|u\{[^}]*\}|.))')
  | (?P<life>'(?:[A-Za-z_]|[^\x00-\x7f])(?:\w|[^\x00-\x7f])*)
  | (?P<number>\d(?:[\w]|\.(?=\d))*)
  | (?P<ident>(?:r\#)?(?:[A-Za-z_]|[^\x00-\x7f])(?:\w|[^\x00-\x7f])*)
  | (?P<mark>::|->|=>|\.\.=|\.\.\.|\.\.|[^\s\w])
    """,
    re.X | re.S,
)
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


class SyntaxProblem(ValueError):
    """Source text that can't be read, and where."""

    def __init__(self, message: str, offset: int):
        super().__init__(message)
        self.offset = offset


@dataclass(frozen=True, slots=True)
class Token:
    kind: str
    text: str
    start: int
    end: int


def tokens(raw: bytes) -> list[Token]:
    """All tokens but white space and plain comments; a byte order mark and a first line with #! are passed over."""
    at = 3 if raw.startswith(b"\xef\xbb\xbf") else 0
    if raw[at : at + 2] == b"#!" and not re.match(rb"#!\s*\[", raw[at:]):
        end = raw.find(b"\n", at)
        at = len(raw) if end < 0 else end
    out = []
    while at < len(raw):
        m = TOKEN.match(raw, at)
        if not m:
            raise SyntaxProblem("no token starts here", at)
        kind, end = m.lastgroup if m.lastgroup != "hash" else "raw", m.end()
        if kind == "block" or (kind == "doc" and m[0].startswith(b"/*")):
            depth, end = 1, at + 2
            while depth:
                step = re.compile(rb"/\*|\*/").search(raw, end)
                if not step:
                    raise SyntaxProblem("a comment isn't closed", at)
                depth, end = depth + (1 if step[0] == b"/*" else -1), step.end()
        elif kind == "raw":
            close = raw.find(b'"' + m["hash"], end)
            if close < 0:
                raise SyntaxProblem("a raw string isn't closed", at)
            kind, end = "string", close + 1 + len(m["hash"])
        elif kind == "mark" and m[0] in (b'"', b"'"):
            raise SyntaxProblem("a string isn't closed", at)
        if kind not in ("space", "line", "block"):
            out.append(Token(kind, raw[at:end].decode(errors="replace"), at, end))
        at = end
    return out


def matched(found: list[Token]) -> dict[int, int]:
    """The place of each bracket's partner."""
    stack, pairs = [], {}
    for i, t in enumerate(found):
        if t.kind != "mark":
            continue
        if t.text in OPEN:
            stack.append(i)
        elif t.text in CLOSE:
            if not stack or OPEN[found[stack[-1]].text] != t.text:
                raise SyntaxProblem(f"{t.text} closes nothing", t.start)
            j = stack.pop()
            pairs[i], pairs[j] = j, i
    if stack:
        raise SyntaxProblem(f"{found[stack[-1]].text} isn't closed", found[stack[-1]].start)
    return pairs


def unraw(name: str) -> str:
    return name.removeprefix("r#")
