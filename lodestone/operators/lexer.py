"""A lexer for languages with braces and for SQL, and what can be read from its tokens.

It knows comments, strings, names and brackets, which is enough to tell where a top-level
statement begins and ends and what it declares, over as many lines as it takes. In scripts the
token before tells a regular expression from a division, and the holes of templates are read as
code. Brackets that do not match cost one declaration: a closing bracket ends what was left open
inside it, and where a source ends inside a bracket, the next statement that begins at a line's
start is taken for one of the top level. Every step is linear in the source.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

_NAME = r"[A-Za-z_$][\w$]*"
_NUMBER = r"\d[\w.]*"
_OP = r"::|=>|->|\.\.\.|\S"
_SLASH_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_DOUBLE = r'"(?:\\.|[^"\\\n])*"'
_RAW = r"`[^`]*`"
_TEXT = r"'(?:\\.|[^'\\\n])*'"
_CHAR = r"'(?:\\[^\n']{1,10}|[^'\\\n])'"


def _rules(comment: str, string: str) -> re.Pattern:
    return re.compile(f"(?P<comment>{comment})|(?P<string>{string})|(?P<name>{_NAME})|(?P<number>{_NUMBER})|(?P<op>{_OP})", re.S)


_SCRIPT = _rules(_SLASH_COMMENT, rf"{_DOUBLE}|{_TEXT}")
RULES = {
    "javascript": _SCRIPT,
    "typescript": _SCRIPT,
    "java": _rules(_SLASH_COMMENT, rf'"""(?:\\.|[^\\])*?"""|{_DOUBLE}|{_CHAR}'),
    "c": _rules(_SLASH_COMMENT, rf"{_DOUBLE}|{_CHAR}"),
    "cpp": _rules(_SLASH_COMMENT, rf'R"(?P<mark>[^\s()\\]{{0,16}})\(.*?\)(?P=mark)"|{_DOUBLE}|{_CHAR}'),
    "rust": _rules(_SLASH_COMMENT, rf'b?r(?P<mark>#*)".*?"(?P=mark)|{_DOUBLE}|{_CHAR}'),
    "go": _rules(_SLASH_COMMENT, rf"{_DOUBLE}|{_RAW}|{_CHAR}"),
    "sql": _rules(r"--[^\n]*|/\*.*?(?:\*/|\Z)", r"'(?:''|[^'])*'|\"[^\"]*\"|`[^`]*`"),
}
#: What may stand for a regular expression, of bounded length, and the text of a template up to its end or its next hole.
_REGEX = re.compile(r"/(?![*/>])(?:\\.|\[(?:\\.|[^\]\\\n]){0,300}\]|[^/\\\[\n]){1,2000}/\w*")
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*(?:`|\$\{)", re.S)
#: Markup inside scripts: text up to the next tag or hole, a closing tag, the start of a tag.
_MARKUP, _CLOSING, _TAG = re.compile(r"[^<{]+"), re.compile(r"</([\w.:-]*)\s*>"), re.compile(r"<([\w.:-]*)")
#: Words after which an expression begins, and those whose brackets are no part of one.
_BEFORE_EXPRESSION = set("return typeof case in of delete void throw new else do instanceof yield await".split())
_HEADS = {"if", "while", "for", "with"}


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    at: int  # where it starts in the source
    line: int  # from 0
    first: bool  # nothing but white space stands before it on its line

    @property
    def end(self) -> int:
        return self.at + len(self.text)

    @property
    def last_line(self) -> int:
        return self.line + self.text.count("\n")

    @property
    def value(self) -> str:
        """A string's inside."""
        return self.text[1:-1]


class _Script:
    """What is open in a script: templates' holes, braces, tags and the text between tags."""

    def __init__(self, source: str) -> None:
        self.source = source
        self.closed = set(_CLOSING.findall(source))
        self.open: list[str] = []
        self.heads: list[bool] = []  # of each open parenthesis, whether if, while, for or with stands before it
        self.after_head = False

    def text(self, at: int) -> tuple[str, int] | None:
        """(kind, end) of what stands between two tags."""
        if not self.open or self.open[-1] != "text":
            return None
        if m := _MARKUP.match(self.source, at):
            return "string", m.end()
        if m := _CLOSING.match(self.source, at):
            self.open.pop()
            return "string", m.end()
        return None

    def sign(self, sign: str, at: int, end: int, before: Token | None) -> tuple[str, int]:
        """(kind, end) of the token that begins with this sign."""
        top, expects = self.open[-1] if self.open else "", _expects(before, self.after_head)
        self.after_head = sign == ")" and bool(self.heads) and self.heads.pop()
        if sign == "(":
            self.heads.append(before is not None and before.text in _HEADS)
        elif sign == "/" and expects and (m := _REGEX.match(self.source, at)):
            return "regex", m.end()
        elif (sign == "`" or (sign == "}" and top == "`")) and (m := _TEMPLATE.match(self.source, at + 1)):
            if sign == "}":
                self.open.pop()
            if m.group().endswith("${"):
                self.open.append("`")
            return "string", m.end()
        elif sign == "{":
            self.open.append("{")
        elif sign == "}" and top == "{":
            self.open.pop()
        elif sign == "<" and (top == "text" or (expects and _TAG.match(self.source, at)[1] in self.closed)):
            self.open.append("tag")
        elif sign == ">" and top == "tag":
            self.open[-1] = "text"
            if before is not None and before.text == "/":
                self.open.pop()
        return "op", end


def tokens(source: str, language: str) -> list[Token]:
    out: list[Token] = []
    rules, script = RULES[language], _Script(source) if language in ("javascript", "typescript") else None
    line, seen, at = 0, 0, 0
    before: Token | None = None  # the last one that is no comment
    while at < len(source):
        if script and (run := script.text(at)):
            kind, start, end = run[0], at, run[1]
        elif m := rules.search(source, at):
            kind, start, end = m.lastgroup, m.start(), m.end()
            if script and kind == "op":
                kind, end = script.sign(source[start], start, end, before)
            elif script and kind != "comment":
                script.after_head = False
        else:
            break
        feeds = source.count("\n", seen, start)
        line += feeds
        now = Token(kind, source[start:end], start, line, feeds > 0 or not out)
        line += now.text.count("\n")
        seen = at = end
        out.append(now)
        if kind != "comment":
            before = now
    return out


def _expects(before: Token | None, after_head: bool) -> bool:
    """True where an expression may begin, so that a slash divides nothing."""
    if before is None or after_head:
        return True
    if before.kind == "name":
        return before.text in _BEFORE_EXPRESSION
    return before.kind == "op" and before.text not in {")", "]", "<"}


OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}


def brackets(toks: list[Token]) -> tuple[dict[int, int], bool]:
    """The place where each opening bracket closes, and whether all of them match.

    A closing bracket ends those that were left open inside it; one that closes nothing is passed
    over; what is never closed reaches to the last token.
    """
    ends, stack, held, good = {}, [], dict.fromkeys(OPEN, 0), True
    for i, t in enumerate(toks):
        if t.kind != "op":
            continue
        if t.text in OPEN:
            stack.append(i)
            held[t.text] += 1
        elif t.text in CLOSE:
            if not held[CLOSE[t.text]]:
                good = False
                continue
            while True:
                j = stack.pop()
                held[toks[j].text] -= 1
                ends[j] = i
                if OPEN[toks[j].text] == t.text:
                    break
                good = False
    for j in stack:
        ends[j] = len(toks) - 1
    return ends, good and not stack


def closing(toks: list[Token], at: int) -> int:
    """The place of the bracket that closes the one at this place; the last token if none does."""
    depth = 0
    for i in range(at, len(toks)):
        if toks[i].kind == "op":
            depth += (toks[i].text in OPEN) - (toks[i].text in CLOSE)
            if depth <= 0:
                return i
    return len(toks) - 1


def split_at(toks: list[Token], sign: str = ",") -> Iterator[list[Token]]:
    """Runs of tokens between signs outside brackets."""
    part: list[Token] = []
    i = 0
    while i < len(toks):
        if toks[i].kind == "op" and toks[i].text == sign:
            yield part
            part = []
        elif toks[i].kind == "op" and toks[i].text in OPEN:
            j = closing(toks, i)
            part += toks[i : j + 1]
            i = j
        else:
            part.append(toks[i])
        i += 1
    yield part


#: Words that begin a top-level statement, where a language lets a line's end close the one before.
STARTS = {
    "javascript": set("import export function class const let var async".split()),
    "typescript": set("import export function class interface type enum abstract declare const let var async namespace".split()),
    "java": set("import package public private protected abstract final class interface enum".split()),
    "go": set("package import func type var const".split()),
    "rust": set("use pub fn struct enum trait impl mod const static type unsafe async extern".split()),
    "c": set("typedef struct enum union static extern".split()),
    "cpp": set("typedef struct class enum union namespace template static extern using".split()),
}
#: After a closing brace these go on with the same statement.
_GOES_ON = {";", ",", ")", "=", ".", "(", "from", "else", "catch", "finally", "while", "]"}
#: Words that may stand before what a statement declares.
MODIFIERS = set(
    "export default async abstract declare public private protected static final sealed strictfp pub crate super unsafe extern inline virtual constexpr typedef const template in".split()
)


@dataclass(slots=True)
class Statement:
    toks: list[Token]  # without comments
    comment: Token | None  # that ends right before it

    @property
    def start(self) -> int:
        return self.toks[0].line

    @property
    def stop(self) -> int:
        return self.toks[-1].last_line

    def outline(self) -> list[tuple[Token, int]]:
        """Tokens outside brackets with their places; a bracket shows as its opening token."""
        out, i = [], 0
        while i < len(self.toks):
            out.append((self.toks[i], i))
            if self.toks[i].kind == "op" and self.toks[i].text in OPEN:
                i = closing(self.toks, i)
            i += 1
        return out


def statements(source: str, language: str) -> list[Statement]:
    """The top-level statements of a source."""
    toks = tokens(source, language)
    code = [t for t in toks if t.kind != "comment"]
    ends, good = brackets(code)
    out: list[Statement] = []
    now: list[Token] = []
    comment: Token | None = None
    until = -1  # the place in code up to which a bracket of the top level reaches
    hashed = -1  # a line that the preprocessor reads
    at = -1

    def done() -> None:
        nonlocal now, comment
        if now:
            out.append(Statement(now, comment))
        now, comment = [], None

    for t in toks:
        if t.kind == "comment":
            if at >= until and not now:
                comment = t
            continue
        at += 1
        after = code[at + 1].text if at + 1 < len(code) else ""
        if language in ("c", "cpp") and at > until and t.first and t.text == "#":
            done()
            hashed = t.line
        if t.line == hashed:
            now.append(t)
            if t.text == "\\":
                hashed = t.line + 1
            continue
        if hashed >= 0:
            done()
            hashed = -1
        if at <= until and not good and _recovers(t, after, source, language):
            until = at - 1
            done()
        begins = t.first and t.text in STARTS[language] and now and now[-1].text not in MODIFIERS and now[-1].text not in {"=", ",", "."}
        if at > until and begins and not _only_annotations(now, language):
            done()
        now.append(t)
        if at > until and at in ends:
            until = ends[at]
        if t.kind == "op" and at >= until and (t.text == ";" or (t.text == "}" and after not in _GOES_ON)):
            done()
    done()
    return out


def _recovers(t: Token, after: str, source: str, language: str) -> bool:
    """True for what begins a statement at a line's start, where brackets do not match."""
    if not t.first or (t.at and source[t.at - 1] != "\n"):
        return False
    return t.text in STARTS[language] or (language in ("c", "cpp") and t.kind == "name" and after != ":")


def _only_annotations(toks: list[Token], language: str) -> bool:
    """True for @Name(...), #[...] and template<...> that stand before a declaration."""
    if toks[0].text == "template" and toks[-1].text == ">":
        return True
    return toks[0].text in {"@", "#"} and not any(t.text in DECLARES[language] for t in toks)


#: What a word before a name declares.
DECLARES = {
    "javascript": {"function": "function", "class": "class"},
    "typescript": {"function": "function", "class": "class", "interface": "interface", "type": "interface"},
    "java": {"class": "class", "enum": "class", "interface": "interface"},
    "go": {"func": "function", "type": "class"},
    "rust": {"fn": "function", "struct": "class", "enum": "class", "impl": "class", "trait": "interface"},
    "c": {"struct": "class", "enum": "class"},
    "cpp": {"class": "class", "struct": "class", "namespace": "class"},
}
_NO_FUNCTION = set("if for while switch return catch sizeof do else".split())


@dataclass(slots=True, frozen=True)
class Declaration:
    name: str
    kind: str
    signature: str | None
    members: list[str]


def _members(toks: list[Token], language: str) -> list[str]:
    """Names of the functions right inside a class' braces."""
    out, i = [], 0
    while i < len(toks):
        t = toks[i]
        if language == "rust":
            if t.text == "fn" and i + 1 < len(toks) and toks[i + 1].kind == "name":
                out.append(toks[i + 1].text)
        elif t.kind == "name" and i + 1 < len(toks) and toks[i + 1].text == "(" and t.text not in _NO_FUNCTION and (i == 0 or toks[i - 1].text not in {"=", ".", "new", "@"}):
            out.append(t.text)
        if t.kind == "op" and t.text in OPEN:
            i = closing(toks, i)
        i += 1
    return out


def declaration(s: Statement, source: str, language: str) -> Declaration | None:
    """What a statement declares, if it declares something that has a name."""
    line = s.outline()
    words = DECLARES[language]
    at = None
    head = _template_end(line)
    for k, (t, _) in enumerate(line):
        if k < head:
            continue
        if t.kind == "name" and t.text in words:
            at = k
            break
        annotation = t.text in {"@", "(", "[", "<", ">", ".", "#"} or (k and line[k - 1][0].text in {"@", "."})
        if not annotation and t.text not in MODIFIERS:
            break
    body = next(((t, i) for t, i in line if t.text == "{"), None)
    if at is not None:
        kind = words[line[at][0].text]
        rest = line[at + 1 :]
        if rest and language == "go" and rest[0][0].text == "(" and kind == "function":
            rest = rest[1:]  # the receiver
        if language == "rust" and line[at][0].text == "impl":
            # impl<T> Trait for Type: the type is what the block belongs to.
            names = [x for x in rest if x[0].kind == "name"]
            split = next((i for i, x in enumerate(rest) if x[0].text == "for"), None)
            rest = rest[split + 1 :] if split is not None else [names[-1]] if names and rest[0][0].text == "<" else rest
        named = next((x for x in rest[:2] if x[0].kind == "name"), None)
        if named is not None and language == "go" and kind == "class":
            shape = next((x[0].text for x in rest[1:] if x[0].kind == "name"), "")
            kind = "interface" if shape == "interface" else "class"
        needs_body = language in ("c", "cpp") and kind == "class"
        if named is not None and (body or not needs_body) and not (needs_body and line[-1][0].text != "}" and any(t.text == "(" for t, _ in line)):
            return Declaration(named[0].text, kind, _signature(s, source, named) if kind == "function" else None, _members(_inside(s, body), language) if kind == "class" and body else [])
    if language in ("c", "cpp") and body:
        for k, (t, i) in enumerate(line):
            if t.text == "=" or t.text == "{":
                return None
            if t.text == "(" and k and line[k - 1][0].kind == "name" and line[k - 1][0].text not in _NO_FUNCTION:
                return Declaration(line[k - 1][0].text, "function", _signature(s, source, line[k - 1]), []) if i < body[1] else None
    return None


def _template_end(line: list[tuple[Token, int]]) -> int:
    """The place after template<...>, which may name types as a declaration does."""
    depth = 0
    for k, (t, _) in enumerate(line):
        depth += (t.text == "<") - (t.text == ">")
        if line[0][0].text != "template" or (k and depth <= 0):
            return k + 1 if k else 0
    return 0


def _inside(s: Statement, body: tuple[Token, int]) -> list[Token]:
    return s.toks[body[1] + 1 : closing(s.toks, body[1])]


def _signature(s: Statement, source: str, named: tuple[Token, int]) -> str | None:
    """The name and the brackets of its parameters, as written."""
    opened = next((i for i in range(named[1] + 1, len(s.toks)) if s.toks[i].text in ("(", "{", ";", "=")), None)
    if opened is None or s.toks[opened].text != "(":
        return None
    return named[0].text + source[s.toks[opened].at : s.toks[closing(s.toks, opened)].end]
