"""A reader of the YAML that configuration files are written in.

Block and flow mappings and sequences, plain and quoted scalars, block scalars,
comments, several lines of a flow collection, anchors, aliases and merged mappings;
tags are passed over. All scalars but null, true and false stay text. What goes
beyond this is a ValueError, and so is a text over ``MOST`` characters.
"""

from __future__ import annotations

import re

MOST, MOST_NESTED = 4 << 20, 200
_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\[\]{},#&*!|>'"%@`][^#]*?|[^\s\[\]{},#&*!|>'"%@`](?:[^\n]*?\S)??)\s*:(?=\s|$)""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", '"': '"', "\\": "\\", "/": "/", " ": " "}


def _scalar(text: str):
    text = text.strip()
    if text in ("", "~", "null", "Null", "NULL"):
        return None
    if text[0] == '"' and len(text) > 1 and text[-1] == '"':
        return re.sub(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES.get(m[3], m[3]), text[1:-1])
    if text[0] == "'" and len(text) > 1 and text[-1] == "'":
        return text[1:-1].replace("''", "'")
    return {"true": True, "True": True, "false": False, "False": False}.get(text, text)


def _properties(text: str) -> tuple[str | None, str]:
    """(anchor, what follows the anchor and tags in front of a value)."""
    anchor = None
    while found := re.match(r"([&!])(\S*)\s*", text):
        anchor = found[2] if found[1] == "&" else anchor
        text = text[found.end() :]
    return anchor, text


def _merged(items: list[tuple]) -> dict:
    """A mapping of its entries; a key ``<<`` brings what others lack."""
    own = {k: v for k, v in items if k != "<<"}
    for _, value in (x for x in items if x[0] == "<<"):
        for other in value if isinstance(value, list) else [value]:
            own = {**other, **own} if isinstance(other, dict) else own
    return own


#: A quoted scalar, where a value may begin; or the space and sign of a comment.
_QUOTED_OR_COMMENT = re.compile(r"""(?:(?<=[\s\[{,:])|^)(?:"(?:[^"\\]|\\.)*"|'(?:[^']|'')*')|(?:^|(?<=\s))#""")


def _without_comment(line: str) -> str:
    for found in _QUOTED_OR_COMMENT.finditer(line):
        if found[0] == "#":
            return line[: found.start()].rstrip()
    return line.rstrip()


def _open(text: str) -> int:
    """Brackets that a flow text leaves open."""
    plain = re.sub(r'"(?:[^"\\]|\\.)*"|\'[^\']*\'', "", text)
    return sum(plain.count(c) for c in "[{") - sum(plain.count(c) for c in "]}")


class _Flow:
    def __init__(self, text: str, anchors: dict):
        self.text, self.at, self.anchors = text, 0, anchors

    def _space(self) -> str:
        while self.text[self.at : self.at + 1].isspace():
            self.at += 1
        return self.text[self.at : self.at + 1]

    def value(self, depth: int = 0):
        if depth > MOST_NESTED:
            raise ValueError("nested too deeply")
        self._space()
        anchor, rest = _properties(self.text[self.at :])
        self.at = len(self.text) - len(rest)
        c = rest[:1]
        if c == "{":
            out = _merged(list(self._items("}", depth, True)))
        elif c == "[":
            out = [v for _, v in self._items("]", depth, False)]
        else:
            token = self._token(",]}")
            out = self.anchors.get(token.strip()[1:]) if c == "*" else _scalar(token)
        if anchor:
            self.anchors[anchor] = out
        return out

    def _token(self, ends: str) -> str:
        c, begin = self._space(), self.at
        if c and c in "\"'":
            quoted = re.compile(r'"(?:[^"\\]|\\.)*"' if c == '"' else r"'(?:[^']|'')*'", re.S).match(self.text, self.at)
            if not quoted:
                raise ValueError("an open quote")
            self.at = quoted.end()
            return quoted[0]
        while self.at < len(self.text) and self.text[self.at] not in ends and not (":" in ends and self.text[self.at] == ":" and self.text[self.at + 1 : self.at + 2] in ("", " ", "\n", ",", "}")):
            self.at += 1
        return self.text[begin : self.at]

    def _items(self, end: str, depth: int, named: bool):
        self.at += 1
        while True:
            c = self._space()
            if c == end:
                self.at += 1
                return
            if not c:
                raise ValueError("an open bracket")
            key = None
            if named:
                key = _scalar(self._token(",}\0:"))
                if self._space() == ":":
                    self.at += 1
                    yield key, self.value(depth + 1) if self._space() not in (",", end) else None
                else:
                    yield key, None
            else:
                yield key, self.value(depth + 1)
            c = self._space()
            if c == ",":
                self.at += 1
            elif c != end:
                raise ValueError("no comma")


class _Block:
    def __init__(self, text: str):
        self.raw = text.split("\n")
        self.lines = [(k, len(x) - len(x.lstrip(" ")), x.strip()) for k, x in enumerate(_without_comment(y.rstrip("\r")) for y in self.raw) if x.strip() and not re.match(r"---(?:\s|$)|\.\.\.$|%", x)]
        self.at, self.anchors = 0, {}

    def _line(self) -> tuple[int, int, str] | None:
        return self.lines[self.at] if self.at < len(self.lines) else None

    def node(self, least: int, depth: int = 0):
        """The value that begins at the next line, if that is indented by ``least`` or more."""
        if depth > MOST_NESTED:
            raise ValueError("nested too deeply")
        line = self._line()
        if line is None or line[1] < least:
            return None
        _, indent, text = line
        if text == "-" or text.startswith("- "):
            return self._sequence(indent, depth)
        if text[0] not in "{[&!*" and _KEY.match(text):
            return self._mapping(indent, depth)
        self.at += 1
        return self._inline(text, indent, depth)

    def _inline(self, text: str, indent: int, depth: int):
        """A value that begins on the line of its key or dash."""
        anchor, text = _properties(text)
        if not text:
            out = self.node(indent + 1, depth + 1)
        else:
            out = self.anchors.get(text[1:]) if text[0] == "*" else self._plain(text, indent, depth)
        if anchor:
            self.anchors[anchor] = out
        return out

    def _plain(self, text: str, indent: int, depth: int):
        if re.match(r"[|>][+-]?\d*[+-]?$", text):
            return self._literal(indent, text[0])
        if text[0] in "{[":
            while _open(text) > 0 and self._line():
                text += " " + self._line()[2]
                self.at += 1
            flow = _Flow(text, self.anchors)
            out = flow.value()
            if flow._space():
                raise ValueError("text behind a bracket")
            return out
        while (nxt := self._line()) and nxt[1] > indent and text[0] not in "\"'" and not _KEY.match(nxt[2]) and not nxt[2].startswith("- "):
            text += " " + nxt[2]  # a plain scalar over several lines
            self.at += 1
        return _scalar(text)

    def _literal(self, indent: int, style: str) -> str:
        first = self.lines[self.at - 1][0] + 1
        last = first
        while last < len(self.raw) and (not self.raw[last].strip() or len(self.raw[last]) - len(self.raw[last].lstrip(" ")) > indent):
            last += 1
        while self._line() and self._line()[0] < last:
            self.at += 1
        own = [x.strip() for x in self.raw[first:last]]
        return ("\n" if style == "|" else " ").join(own).rstrip() + "\n"

    def _mapping(self, indent: int, depth: int) -> dict:
        items = []
        while (line := self._line()) and line[1] == indent and not line[2].startswith("- "):
            found = _KEY.match(line[2])
            if not found:
                raise ValueError("no key")
            rest = line[2][found.end() :].strip()
            self.at += 1
            anchor, bare = _properties(rest)
            nxt = self._line()
            if not bare and nxt and nxt[1] == indent and (nxt[2] == "-" or nxt[2].startswith("- ")):
                value = self._sequence(indent, depth + 1)  # a list may stand under its key
                if anchor:
                    self.anchors[anchor] = value
            else:
                value = self._inline(rest, indent, depth)
            items.append((_scalar(found[1]), value))
        if line and line[1] > indent:
            raise ValueError("indented without a key")
        return _merged(items)

    def _sequence(self, indent: int, depth: int) -> list:
        out = []
        while (line := self._line()) and line[1] == indent and (line[2] == "-" or line[2].startswith("- ")):
            rest = line[2][1:].strip()
            if not rest:
                self.at += 1
                out.append(self.node(indent + 1, depth + 1))
            else:
                # What follows the dash is a node of its own, indented as far as it stands.
                self.lines[self.at] = (line[0], indent + len(line[2]) - len(rest), rest)
                out.append(self.node(indent + 1, depth + 1))
        return out


def parse_yaml(text: str):
    if len(text) > MOST:
        raise ValueError("too large")
    block = _Block(text)
    out = block.node(0)
    if block._line():
        raise ValueError("text behind the document")
    return out
