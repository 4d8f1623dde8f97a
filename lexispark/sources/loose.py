"""Objects in loose JSON: comments, single quotes, bare keys, trailing commas, and numbers as scripts write them."""

from __future__ import annotations

import re

_SKIP = re.compile(r"(?:[\s\ufeff]|//[^\n\r\u2028\u2029]*|/\*.*?\*/)*", re.S)
_NAME = re.compile(r"[^\W\d][\w$\u200c\u200d]*|\$[\w$]*")
_NUMBER = re.compile(r"[+-]?(?:0[xX][0-9a-fA-F]+|Infinity|NaN|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)")
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(\r\n|.))", re.S)
_SIGNS = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "0": "\0", "\n": "", "\r": "", "\r\n": "", "\u2028": "", "\u2029": ""}
_WORDS = {"true": True, "false": False, "null": None}


class _Reader:
    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def peek(self) -> str:
        self.at = _SKIP.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def take(self, pattern: re.Pattern) -> str:
        m = pattern.match(self.text, self.at)
        if not m:
            raise ValueError(f"unexpected sign at {self.at}")
        self.at = m.end()
        return m[0]

    def quoted(self) -> str:
        quote = self.text[self.at]
        raw = self.take(re.compile(rf"{quote}(?:[^{quote}\\\r\n]|\\(?:\r\n|.))*{quote}", re.S))
        return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _SIGNS.get(m[3], m[3]), raw[1:-1])

    def items(self, end: str):
        """Positions of the items of a list or an object, up to its end."""
        self.at += 1
        while self.peek() != end:
            yield
            if self.peek() == ",":
                self.at += 1
            elif self.peek() != end:
                raise ValueError(f"unexpected sign at {self.at}")
        self.at += 1

    def value(self):
        sign = self.peek()
        if sign == "{":
            out = {}
            for _ in self.items("}"):
                key = self.quoted() if self.peek() in ("'", '"') else self.take(_NAME)
                if self.peek() != ":":
                    raise ValueError(f"no colon at {self.at}")
                self.at += 1
                out[key] = self.value()
            return out
        if sign == "[":
            return [self.value() for _ in self.items("]")]
        if sign in ("'", '"') and sign:
            return self.quoted()
        if m := _NUMBER.match(self.text, self.at):
            self.at = m.end()
            word = m[0].lstrip("+-")
            x = int(word, 16) if word[:2].lower() == "0x" else float(word) if not word.isdigit() else int(word)
            return -x if m[0][0] == "-" else x
        word = self.take(_NAME)
        if word not in _WORDS:
            raise ValueError(f"unknown word {word}")
        return _WORDS[word]


def parse_loose(text: str | None) -> dict:
    """The object that a text holds; anything else, and what cannot be read, gives an empty one."""
    try:
        reader = _Reader(text or "")
        found = reader.value()
        return found if isinstance(found, dict) and not reader.peek() else {}
    except (ValueError, RecursionError):
        return {}
