"""Tokens of the brace languages and Ruby: comments and strings set apart, brackets matched, receivers read back."""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

_STRINGS = {
    "js": r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`",
    "go": r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'|`[^`]*`",
    "rs": r"b?r(?P<hash>#*)\".*?\"(?P=hash)|b?\"(?:\\.|[^\"\\])*\"|b?'(?:\\.[^']*|[^'\\\n])'",
    "java": r"\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'",
    "cs": r"\$?@\$?\"(?:\"\"|[^\"])*\"|\$?\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'",
    "cpp": r"R\"(?P<raw>[^(\s]*)\(.*?\)(?P=raw)\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'",
    "php": r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'",
    "rb": r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`|%[wWiIqQ]?[\[({<][^\])}>]*[\])}>]",
}
_STRINGS["ts"] = _STRINGS["js"]
_COMMENTS = {"rb": r"^=begin\b.*?^=end\b|\#[^\n]*", "php": r"/\*.*?\*/|//[^\n]*|\#(?!\[)[^\n]*"}
_NAMES = {"php": r"\$?[A-Za-z_\x80-\uffff][\w\x80-\uffff]*", "rb": r"@{0,2}[A-Za-z_][\w]*[?!]?(?!=[^=~>])|@{0,2}[A-Za-z_]\w*|\$\w+", "rs": r"(?:r\#)?[A-Za-z_]\w*|'[A-Za-z_]\w*"}
_WORDS_BEFORE_PATTERN = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "and", "or", "not", "if", "unless", "when", "while"}
_ENDS_VALUE = {")", "]", "}"}


@lru_cache
def _regex(language: str) -> re.Pattern[str]:
    comment = _COMMENTS.get(language, r"/\*.*?\*/|//[^\n]*")
    name = _NAMES.get(language, r"[A-Za-z_$\x80-\uffff][\w$\x80-\uffff]*")
    directive = r"(?P<line>^[ \t]*\#[^\n]*(?:\\\n[^\n]*)*)|" if language == "cpp" else ""
    return re.compile(rf"(?P<comment>{comment})|{directive}(?P<string>{_STRINGS[language]})|(?P<number>\d[\w.]*)|(?P<name>{name})|(?P<mark>::|=>|->|\?\.|\.\.\.|&&|\|\||<<|[<>=!]=|[^\s\w])", re.S | re.M)


class Tokens:
    """Parallel lists of tokens: ``kind`` (name, string, number, mark, line), ``text``, ``at`` and ``end`` offsets.

    ``pair[i]`` is the other bracket of a bracket (or i), ``up[i]`` the innermost open bracket around i (or -1), and
    ``doc[i]`` the doc comment right before token i.
    """

    def __init__(self, source: str, language: str) -> None:
        self.source, self.language = source, language
        self.kind: list[str] = []
        self.text: list[str] = []
        self.at: list[int] = []
        self.end: list[int] = []
        self.doc: dict[int, str] = {}
        self._newlines = [m.start() for m in re.finditer("\n", source)]
        patterns = language in ("js", "ts", "rb")
        find, place, doc = _regex(language).search, 0, ""
        while m := find(source, place):
            kind, text = m.lastgroup or "mark", m[0]
            if kind in ("hash", "raw"):
                kind = "string"
            place = m.end()
            if kind == "comment":
                doc = text if text.startswith("/**") else ""
                continue
            if patterns and text == "/" and self._value_expected():
                if p := re.compile(r"(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*").match(source, place):
                    kind, text, place = "string", source[m.start() : p.end()], p.end()
            if doc:
                self.doc[len(self.text)] = doc
                doc = ""
            self.kind.append(kind)
            self.text.append(text)
            self.at.append(m.start())
            self.end.append(place)
        self._match()

    def _value_expected(self) -> bool:
        if not self.text:
            return True
        last, kind = self.text[-1], self.kind[-1]
        if kind == "name":
            return last in _WORDS_BEFORE_PATTERN
        return kind == "mark" and last not in _ENDS_VALUE

    def _match(self) -> None:
        n = len(self.text)
        self.pair, self.up = list(range(n)), [-1] * n
        closing, stack = {")": "(", "]": "[", "}": "{"}, []
        for i, t in enumerate(self.text):
            if self.kind[i] != "mark":
                self.up[i] = stack[-1] if stack else -1
            elif t in closing:
                while stack and self.text[stack[-1]] != closing[t] and closing[t] in (self.text[s] for s in stack[-8:]):
                    self.pair[stack.pop()] = i
                if stack and self.text[stack[-1]] == closing[t]:
                    opened = stack.pop()
                    self.pair[opened], self.pair[i] = i, opened
                self.up[i] = stack[-1] if stack else -1
            else:
                self.up[i] = stack[-1] if stack else -1
                if t in "([{":
                    stack.append(i)
        for s in stack:
            self.pair[s] = n - 1

    def __len__(self) -> int:
        return len(self.text)

    def line(self, i: int) -> int:
        return bisect_right(self._newlines, self.at[i] - 1) + 1 if i < len(self.at) else len(self._newlines) + 1

    def line_of_end(self, i: int) -> int:
        return bisect_right(self._newlines, self.end[i] - 1) + 1

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.text) and self.kind[i] == "name"

    def t(self, i: int) -> str:
        return self.text[i] if 0 <= i < len(self.text) else ""

    def after(self, i: int) -> int:
        """The token after i, or after its closing bracket if i opens one."""
        return max(i, self.pair[i]) + 1

    def seek(self, i: int, wanted: str, stop: str = "") -> int:
        """The next of the ``wanted`` marks from i on, at the same level; -1 at one of ``stop`` or the end of the level."""
        up = self.up[i] if i < len(self.text) else -1
        while i < len(self.text) and self.up[i] == up:
            if self.kind[i] == "mark" and self.text[i] in wanted.split():
                return i
            if self.text[i] in stop.split() or self.text[i] in _ENDS_VALUE and self.pair[i] < i and self.pair[i] == up:
                return -1
            i = self.after(i)
        return -1

    def before(self, i: int) -> int:
        """The token before i, or the opening bracket if that closes one."""
        i -= 1
        return self.pair[i] if i >= 0 and self.kind[i] == "mark" and self.text[i] in _ENDS_VALUE else i

    def receiver(self, dot: int) -> str:
        """The source of the expression that ends before the token ``dot``."""
        i = dot
        while True:
            i = self.before(i)
            if i < 0:
                return self.source[: self.at[dot]].strip()
            if self.text[i] in ("(", "[", "{") and self.kind[i] == "mark":
                if self.text[i] == "{" or not (self.is_name(i - 1) and self.t(i - 1) not in _WORDS_BEFORE_PATTERN or self.t(i - 1) in _ENDS_VALUE):
                    break
                continue
            if self.t(i - 1) in (".", "?.", "->", "::", "&.") or (self.t(i - 1) == "." and self.t(i - 2) == "&"):
                i -= 1
                continue
            break
        return self.source[self.at[i] : self.at[dot]].strip()

    def unquoted(self, i: int) -> str:
        return unquoted(self.text[i])


def unquoted(text: str) -> str:
    return re.sub(r"^[a-zA-Z$@#%]{0,2}(\"{3}|['\"`])(.*)\1$", r"\2", text, flags=re.S)


def cleaned_doc(text: str) -> str:
    """A doc comment without its markers and leading asterisks."""
    inner = text.removeprefix("/**").removesuffix("*/")
    return "\n".join(re.sub(r"^\s*\*? ?", "", row) for row in inner.split("\n")).strip()
