"""Functions paired with their documentation, by island grammars.

A grammar names only what matters: comments, literals (whose content is not code), braces, type bodies, and how a
declaration begins. One scan finds these islands and skips everything else as water. The head of a declaration is read
with balanced brackets (type parameters, parameters, result types with braces of their own), so the brace that opens its
body is known; the body is the balanced run of braces from there, or the deeper indented lines below the head.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass

LINE, BLOCK, TEXT, OPEN, CLOSE, DECL, TYPE, END = "line", "block", "text", "open", "close", "decl", "type", "end"

_C_COMMENT = r"(?P<line>//[^\n]*)|(?P<block>/\*.*?(?:\*/|\Z))"
_C_TEXT = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''
_NAME = re.compile(r"[^\W\d][\w$]*|[$#][\w$]+")
_WORD_AT = re.compile(r"[\w$.]+")


@dataclass
class Head:
    """Where a declaration begins, its parts, where its head ends, and where its body opens (None without one)."""

    start: int
    name: str
    receiver: str
    params: str
    end: int
    body: int | None


class Source:
    """A text with balanced brackets. Groups are found by a scan from their bracket; once one turns out never to close,
    all brackets are matched in one pass, so that broken texts cost no more than twice their length."""

    def __init__(self, text: str, words: re.Pattern):
        self.text, self.words, self._match = text, words, None
        self.starts = [0, *[m.end() for m in re.finditer("\n", text)]]

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at) - 1

    def skip(self, at: int, newlines: bool = True) -> int:
        """The first place from ``at`` that is neither blank nor in a comment."""
        text, n = self.text, len(self.text)
        while at < n:
            c = text[at]
            if c in " \t\f" or (newlines and c == "\n"):
                at += 1
            elif c in "/#" and (m := self.words.match(text, at)) and m.lastgroup in (LINE, BLOCK):
                if not newlines and m.lastgroup == LINE:
                    return at
                at = m.end()
            else:
                break
        return at

    def _scan(self, at: int, every: bool) -> int | None:
        held: list[tuple[str, int]] = []
        table = self._match
        for m in self.words.finditer(self.text, at):
            c = m.group()
            if m.lastgroup == "open":
                held.append((c, m.start()))
            elif m.lastgroup == "close" and held:
                want = {")": "(", "]": "[", "}": "{"}[c]
                k = len(held) - 1
                while k >= 0 and held[k][0] != want:
                    k -= 1
                if k >= 0:  # what stands open inside never closes
                    if every:
                        table[held[k][1]] = m.end()
                    del held[k:]
                    if not every and not held:
                        return m.end()
        return None

    def group(self, at: int) -> int | None:
        """The end of the bracket group that opens at ``at``; None if it never closes."""
        if self._match is None:
            end = self._scan(at, every=False)
            if end is not None:
                return end
            self._match = {}
            self._scan(0, every=True)
        return self._match.get(at)

    def angle(self, at: int) -> int | None:
        """The end of a group in angle brackets; arrows and brackets inside are stepped over."""
        depth, text, n = 0, self.text, len(self.text)
        while at < n:
            c = text[at]
            if c == "<":
                depth += 1
            elif c == ">" and text[at - 1] not in "-=":
                depth -= 1
                if not depth:
                    return at + 1
            elif c in "([{":
                end = self.group(at)
                if end is None:
                    return None
                at = end
                continue
            elif c in ";)]}":
                return None
            at += 1
        return None

    def at(self, at: int) -> str:
        return self.text[at : at + 1]

    def name(self, at: int) -> tuple[str, int] | None:
        m = _NAME.match(self.text, at)
        return (m.group(), m.end()) if m else None

    def params(self, at: int) -> tuple[str, int] | None:
        if self.at(at) != "(" or (end := self.group(at)) is None:
            return None
        return self.text[at + 1 : end - 1].strip(), end


@dataclass(frozen=True)
class Grammar:
    """``islands`` has the groups line, block, text, open, close and, where there are any, decl (a declaration's first
    word), type (a word that announces a type body) and end (a statement's end); ``words`` finds brackets and what
    hides them; ``head`` reads a declaration; ``member`` one in a type body, given the type's name."""

    language: str
    islands: re.Pattern
    words: re.Pattern
    head: Callable[[Source, int], Head | None]
    member: Callable[[Source, int, str], Head | None] | None = None
    nested: bool = True
    indented: bool = False
    annotation: re.Pattern | None = None


# ---- Go


def _go_type(s: Source, at: int) -> int | None:
    """The end of the type that begins at ``at``; None if there is none."""
    while True:
        at = s.skip(at, newlines=False)
        c = s.at(at)
        if c == "(":
            return s.group(at)
        if c == "*":
            at += 1
        elif s.text.startswith("<-", at):
            at += 2
        elif c == "[":
            end = s.group(at)
            if end is None:
                return None
            at = end
        elif m := _WORD_AT.match(s.text, at):
            word, at = m.group(), m.end()
            if word in ("interface", "struct"):
                brace = s.skip(at)
                return s.group(brace) if s.at(brace) == "{" else at
            if word == "map":
                if s.at(at) == "[" and (end := s.group(at)):
                    at = end
                    continue
                return at
            if word == "chan":
                at = s.skip(at, newlines=False)
                at += 2 * s.text.startswith("<-", at)
                continue
            if word == "func":
                got = s.params(s.skip(at, newlines=False))
                if got is None:
                    return at
                return _go_type(s, got[1]) or got[1]
            return s.group(at) if s.at(at) == "[" else at
        else:
            return None


def _go_head(s: Source, start: int) -> Head | None:
    at, receiver = s.skip(start + 4), ""
    if s.at(at) == "(":
        got = s.params(at)
        if got is None:
            return None
        receiver, at = got[0], s.skip(got[1])
    named = s.name(at)
    if named is None:
        return None
    name, at = named
    at = s.skip(at)
    if s.at(at) == "[":
        end = s.group(at)
        if end is None:
            return None
        at = s.skip(end)
    got = s.params(at)
    if got is None:
        return None
    params, at = got
    at = _go_type(s, at) or at
    brace = s.skip(at, newlines=False)
    return Head(start, name, receiver, params, at, brace if s.at(brace) == "{" else None)


# ---- languages with type bodies

_JAVA_LEAD = re.compile(r"(?:(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp|sealed|non-sealed)\b\s*)*")
_JAVA_TAIL = re.compile(r"(?:\s*\[\s*\])*\s*(?:throws\s+[\w.,\s<>@]+?)?\s*(?:default\s+[^;{}]+)?(?=[{;])")
_JAVA_NO_NAME = frozenset("if for while switch catch return new else try do synchronized throw assert super this case yield".split())


def _annotations(s: Source, at: int) -> int:
    while s.at(at) == "@" and not s.text.startswith("@interface", at):
        m = _WORD_AT.match(s.text, at + 1)
        if m is None:
            return at
        at = s.skip(m.end())
        if s.at(at) == "(":
            end = s.group(at)
            if end is None:
                return at
            at = s.skip(end)
    return at


def _java_member(s: Source, at: int, owner: str) -> Head | None:
    start = at = s.skip(_annotations(s, s.skip(at)))
    at = s.skip(_annotations(s, s.skip(_JAVA_LEAD.match(s.text, at).end())))
    if s.at(at) == "<":
        end = s.angle(at)
        if end is None:
            return None
        at = s.skip(end)
    words = 0
    while named := s.name(at):
        name, at = named
        words += 1
        at = s.skip(at)
        while s.at(at) in ("<", "[", ".", "@", "?"):
            if s.at(at) == "<":
                end = s.angle(at)
            elif s.at(at) == "[":
                end = s.group(at)
            else:
                end = at + 1
            if end is None:
                return None
            if s.at(at) in (".", "@") and (more := s.name(s.skip(end))):
                name, end = more
            at = s.skip(end)
        if s.at(at) == "(":
            break
    else:
        return None
    if name in _JAVA_NO_NAME or words > 2 or (words == 1 and name != owner):
        return None
    got = s.params(at)
    if got is None or (tail := _JAVA_TAIL.match(s.text, got[1])) is None:
        return None
    return Head(start, name, owner, got[0], tail.end(), tail.end() if s.at(tail.end()) == "{" else None)


def _never(s: Source, at: int) -> Head | None:
    return None


def _ts_type(s: Source, at: int) -> int:
    """The end of a type: braces begin it or follow an operator, else they open a body."""
    begun = False
    while True:
        nxt = s.skip(at)
        c = s.at(nxt)
        if c in "([" and c or (c == "{" and not begun):
            end = s.group(nxt)
        elif c == "<":
            end = s.angle(nxt)
        elif c in ("|", "&") or s.text.startswith("=>", nxt):
            at, begun = nxt + (2 if c == "=" else 1), False
            continue
        elif c in ("'", '"', "`"):
            m = s.words.match(s.text, nxt)
            end = m.end() if m else None
        elif (m := _WORD_AT.match(s.text, nxt)) and (not begun or s.line(nxt) == s.line(at)):
            end = m.end()
            begun = m.group() not in ("keyof", "typeof", "readonly", "is", "asserts", "infer", "unique", "extends")
            at = end
            continue
        else:
            return at
        if end is None:
            return at
        at, begun = end, True


def _js_call(s: Source, start: int, name: str, owner: str, at: int) -> Head | None:
    """A head from its type parameters on."""
    at = s.skip(at)
    if s.at(at) == "<":
        end = s.angle(at)
        if end is None:
            return None
        at = s.skip(end)
    got = s.params(at)
    if got is None:
        return None
    params, end = got
    at = s.skip(end)
    if s.at(at) == ":":
        end = _ts_type(s, at + 1)
        at = s.skip(end)
    return Head(start, name, owner, params, end, at if s.at(at) == "{" else None)


_JS_FUNCTION = re.compile(r"(?:async\s+)?function\b\s*\*?\s*")
_JS_ASYNC = re.compile(r"async\b\s*")
_JS_LEAD = re.compile(r"(?:(?:export|default|declare|public|protected|private|static|readonly|abstract|override|async|get|set|accessor)\b\s*(?![(=:;<?]))*\*?\s*")
_JS_NO_NAME = _JAVA_NO_NAME | {"function", "with", "await", "typeof", "delete", "void", "of", "in"}


def _js_value(s: Source, start: int, name: str, owner: str, at: int) -> Head | None:
    """A function or arrow function on the right of an equals sign."""
    at = s.skip(at)
    if m := _JS_FUNCTION.match(s.text, at):
        own = s.name(m.end())
        return _js_call(s, start, name, owner, own[1] if own else m.end())
    if m := _JS_ASYNC.match(s.text, at):
        at = s.skip(m.end())
    if s.at(at) == "<":
        end = s.angle(at)
        if end is None:
            return None
        at = s.skip(end)
    if s.at(at) == "(":
        got = s.params(at)
        if got is None:
            return None
        params, at = got[0], s.skip(got[1])
        if s.at(at) == ":":
            # the arrow of the function ends the type, unlike arrows within it
            end = s.text.find("=>", at)
            at = end if end >= 0 else at
    else:
        one = s.name(at)
        if one is None:
            return None
        params, at = one[0], s.skip(one[1])
    if not s.text.startswith("=>", at):
        return None
    at = s.skip(at + 2)
    if s.at(at) == "{":
        return Head(start, name, owner, params, at, at)
    while at < len(s.text) and s.at(at) not in ";,\n)]}":  # an expression to the end of its line, brackets balanced
        end = s.group(at) if s.at(at) in "([{" else None
        if end is None:
            m = s.words.match(s.text, at)
            end = m.end() if m and m.lastgroup == TEXT else at + 1
        at = end
    return Head(start, name, owner, params, at, None)


_JS_BIND = re.compile(r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:(?:const|let|var)\s+)?")


def _js_head(s: Source, start: int) -> Head | None:
    at = _JS_BIND.match(s.text, s.skip(start)).end()
    if m := _JS_FUNCTION.match(s.text, at):
        named = s.name(m.end())
        return _js_call(s, start, named[0], "", named[1]) if named else None
    named = s.name(at)
    if named is None:
        return None
    name, at = named
    at = s.skip(at)
    if s.at(at) == ":":
        at = s.skip(_ts_type(s, at + 1))
    return _js_value(s, start, name, "", at + 1) if s.at(at) == "=" else None


def _js_member(s: Source, at: int, owner: str) -> Head | None:
    start = at = s.skip(_annotations(s, s.skip(at)))
    at = s.skip(_JS_LEAD.match(s.text, at).end())
    named = s.name(at)
    if named is None or named[0] in _JS_NO_NAME:
        return None
    name, at = named
    at = s.skip(at)
    if s.at(at) == "?":
        at = s.skip(at + 1)
    if s.at(at) in ("(", "<"):
        return _js_call(s, start, name, owner, at)
    if s.at(at) == ":":
        at = s.skip(_ts_type(s, at + 1))
    return _js_value(s, start, name, owner, at + 1) if s.at(at) == "=" else None


_RUST_LEAD = re.compile(r"[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+(?:\"[^\"]*\"\s*)?)*fn\b\s*")


def _rust_head(s: Source, start: int) -> Head | None:
    m = _RUST_LEAD.match(s.text, start)
    named = m and s.name(m.end())
    if not named:
        return None
    name, at = named
    at = s.skip(at)
    if s.at(at) == "<":
        end = s.angle(at)
        if end is None:
            return None
        at = s.skip(end)
    got = s.params(at)
    if got is None:
        return None
    params, at = got
    while at < len(s.text) and s.at(at) not in "{;}":  # result and bounds; a brace in square brackets is stepped over
        nxt = s.skip(at)
        end = s.group(nxt) if s.at(nxt) in ("(", "[") else None
        at = end if end is not None else nxt if nxt > at else at + 1
    return Head(start, name, "", params, at, at if s.at(at) == "{" else None)


_PY_LEAD = re.compile(r"[ \t]*(?:async[ \t]+)?def\b\s*")


def _python_head(s: Source, start: int) -> Head | None:
    m = _PY_LEAD.match(s.text, start)
    named = m and s.name(m.end())
    if not named:
        return None
    name, at = named
    at = s.skip(at, newlines=False)
    if s.at(at) == "[":
        end = s.group(at)
        if end is None:
            return None
        at = s.skip(end, newlines=False)
    got = s.params(at)
    if got is None:
        return None
    params, at = got
    while at < len(s.text) and s.at(at) not in ":\n":
        end = s.group(at) if s.at(at) in "([{" else None
        if end is None:
            m = s.words.match(s.text, at)
            end = m.end() if m and m.lastgroup == TEXT else at + 1
        at = end
    return Head(start, name, "", params, min(at + 1, len(s.text)), None) if s.at(at) == ":" else None


_BRACKETS = r"|(?P<open>[(\[{])|(?P<close>[)\]}])"
_GO_TEXT = r"|(?P<text>`[^`]*(?:`|\Z)|" + _C_TEXT + ")"
_JAVA_TEXT = r'|(?P<text>"""(?:\\.|.)*?(?:"""|\Z)|' + _C_TEXT + ")"
_JS_TEXT = r"|(?P<text>`(?:\\.|[^`\\])*(?:`|\Z)|(?:(?<=[(,=:\[!&|?{};+])|(?<=\breturn))[ \t]*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/|" + _C_TEXT + ")"
_RUST_TEXT = r'|(?P<text>r(?P<hashes>#*)".*?"(?P=hashes)|"(?:\\.|[^"\\])*"|\'(?:\\u\{[0-9a-fA-F_]+\}|\\x[0-9a-fA-F]{2}|\\.|[^\'\\\n])\')'
_PY_WORDS = r"(?P<line>#[^\n]*)|(?P<text>\"\"\"(?:\\.|.)*?(?:\"\"\"|\Z)|'''(?:\\.|.)*?(?:'''|\Z)|" + _C_TEXT + ")"
_BRACES = r"|(?P<open>\{)|(?P<close>\})"


def _grammar(language: str, words: str, rest: str, **how) -> Grammar:
    return Grammar(language, re.compile(words + _BRACES + rest, re.S | re.M), re.compile(words + _BRACKETS, re.S), **how)


GO = _grammar("go", _C_COMMENT + _GO_TEXT, r"|(?P<decl>^func\b)", head=_go_head, nested=False)
JAVA = _grammar(
    "java", _C_COMMENT + _JAVA_TEXT, r"|(?P<end>;)|(?P<type>(?<![.\w$])(?:class|interface|enum|record)\b(?=\s+[\w$]+))", head=_never, member=_java_member, annotation=re.compile(r"^\s*@\w")
)
JAVASCRIPT = _grammar(
    "javascript", _C_COMMENT + _JS_TEXT,
    r"|(?P<end>;)|(?P<type>(?<![.\w$])(?:class\b(?=\s*[\w${])|interface\b(?=\s+[\w$]+)))|(?P<decl>(?:^[ \t]*|(?<=[;{}])[ \t]*)(?:(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\b(?=\s*\*?\s*[\w$])|(?:export\s+)?(?:const|let|var)\b(?=\s+[\w$]+\s*[=:])))",
    head=_js_head, member=_js_member, annotation=re.compile(r"^\s*@\w"),
)
RUST = _grammar("rust", _C_COMMENT + _RUST_TEXT, r"|(?P<decl>(?:^|(?<=[;{}]))[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+(?:\"[^\"]*\"\s*)?)*fn\b)", head=_rust_head, annotation=re.compile(r"^\s*#\["))
PYTHON = Grammar(
    "python", re.compile(_PY_WORDS + r"|(?P<decl>^[ \t]*(?:async[ \t]+)?def\b)", re.S | re.M), re.compile(_PY_WORDS + _BRACKETS, re.S), head=_python_head, indented=True, annotation=re.compile(r"^\s*@\w")
)
GRAMMARS = {g.language: g for g in (GO, JAVA, JAVASCRIPT, RUST, PYTHON)}


@dataclass
class Declaration:
    """``start`` and ``stop`` are the places of ``code`` in the text, with line ends as one character."""

    name: str
    receiver: str
    params: str
    signature: str
    comment: str
    code: str
    line: int
    start: int
    stop: int


def newlines(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


class _Comments:
    """Comments that stand alone on their lines, by their last line."""

    def __init__(self, source: Source, annotation: re.Pattern | None):
        self.source, self.annotation, self.by_end = source, annotation, {}

    def add(self, start: int, end: int) -> None:
        text = self.source.text
        begin = text.rfind("\n", 0, start) + 1
        tail = text.find("\n", end)
        if not text[begin:start].strip() and not text[end : tail if tail >= 0 else None].strip():
            first = self.source.line(start)
            self.by_end[first + text.count("\n", start, end)] = (first, text[start:end])

    def above(self, line: int) -> str:
        """The comments that end right above ``line``, its annotations stepped over, and above each other."""
        starts, text = self.source.starts, self.source.text
        if self.annotation is not None:
            while line > 0 and line - 1 not in self.by_end and self.annotation.match(text[starts[line - 1] : starts[line]]):
                line -= 1
        parts = []
        while line - 1 in self.by_end:
            line, part = self.by_end[line - 1]
            parts.append(part)
        return "\n".join(reversed(parts))


def scan(content: str, grammar: Grammar = GO) -> list[Declaration]:
    """Declarations of a source text in order. Line ends may be mixed. Unbalanced text ends the last body; what stands
    in comments and literals is no declaration; a comment on a line of code belongs to no declaration."""
    source = Source(newlines(content), grammar.words)
    comments = _Comments(source, grammar.annotation)
    found: list[Declaration] = []
    text = source.text

    def add(head: Head) -> Declaration:
        raw = text[head.start : head.end]
        start = head.start + len(raw) - len(raw.lstrip())
        line = source.line(start)
        d = Declaration(head.name, head.receiver, head.params, " ".join(raw.split()), comments.above(line), text[start : head.end].rstrip(), line + 1, start, head.end)
        found.append(d)
        return d

    if grammar.indented:
        _scan_indented(source, grammar, comments, add)
        return found

    frames: list[tuple[str | None, Declaration | None]] = []  # of every open brace: the type it is the body of, the declaration
    opens: dict[int, Declaration] = {}  # where bodies will open
    announced: str | None = None
    fresh, stop = -1, -1  # where a statement of a type body begins; up to where a head has been read
    skip_to = -1
    for m in grammar.islands.finditer(text):
        kind, at = m.lastgroup, m.start()
        if kind == LINE or kind == BLOCK:
            comments.add(at, m.end())
            continue
        owner = frames[-1][0] if frames else None
        if owner is not None and fresh >= 0 and kind != TYPE and at >= skip_to:
            spot, fresh = fresh, -1
            while spot <= at:
                head = grammar.member(source, spot, owner)
                if head is None:
                    spot = text.find("\n", source.skip(spot)) + 1 or at + 1  # statements may end with their line
                    continue
                d = add(head)
                stop = skip_to = spot = head.end
                if head.body is not None:
                    opens[head.body] = d
                    skip_to = head.body
                    break
                if spot > at:
                    fresh = spot
        if kind == OPEN:
            d = opens.pop(at, None)
            if d is None and at < skip_to:
                frames.append((None, None))
                continue
            frames.append((None if d is not None else announced, d))
            fresh = m.end() if frames[-1][0] is not None else -1
            announced = None
        elif kind == CLOSE:
            if frames:
                _, d = frames.pop()
                if d is not None:
                    d.code, d.stop = text[d.start : m.end()], m.end()
            if frames and frames[-1][0] is not None and at >= skip_to:
                fresh = m.end()
        elif kind == END:
            announced = None
            if owner is not None and at >= skip_to:
                fresh = m.end()
        elif kind == TYPE:
            if named := _TYPE_NAME.match(text, m.end()):
                announced = named.group(1)
                fresh = -1
            elif grammar.member is not None:
                announced, fresh = "", -1
        elif kind == DECL and (grammar.nested or not frames) and at >= stop and (owner is None or grammar.member is None):
            head = grammar.head(source, at)
            if head is not None:
                d = add(head)
                stop = head.end if head.body is not None or grammar.nested else at
                if head.body is not None:
                    opens[head.body] = d
    for _, d in frames:  # never closed
        if d is not None:
            d.code, d.stop = text[d.start :], len(text)
    return found


_TYPE_NAME = re.compile(r"\s+([\w$]+)")
_DOC_PREFIX = re.compile(r"\s*(?:#[^\n]*\n\s*)*[rRuUbB]{0,2}(?=[\"'])")


def _scan_indented(source: Source, grammar: Grammar, comments: _Comments, add: Callable[[Head], Declaration]) -> None:
    text = source.text
    heads: list[tuple[Head, Declaration]] = []
    inside: list[tuple[int, int]] = []  # literals over several lines
    ends: dict[int, int] = {}
    for m in grammar.islands.finditer(text):
        if m.lastgroup == LINE:
            comments.add(m.start(), m.end())
        elif m.lastgroup == TEXT:
            ends[m.start()] = m.end()
            if "\n" in m.group():
                inside.append((source.line(m.start()), source.line(m.end())))
        elif head := grammar.head(source, m.start()):
            heads.append((head, add(head)))
    inside += [(source.line(d.start), source.line(max(head.start, head.end - 1))) for head, d in heads]
    within = set()
    for a, b in inside:
        within.update(range(a + 1, b + 1))
    pads = []  # of every line: its indentation, None for lines that end no block
    for i, begin in enumerate(source.starts):
        stop = source.starts[i + 1] if i + 1 < len(source.starts) else len(text)
        row = text[begin:stop]
        bare = row.strip()
        pads.append(None if not bare or i in within or bare[0] in ")]}" else len(row) - len(row.lstrip()))
    # the next line that closes a block of each depth, by a stack from below: one pass over the lines
    closing: list[tuple[int, int]] = []
    wanted = {source.line(d.start) for _, d in heads}
    ends_at: dict[int, int] = {}
    for i in range(len(pads) - 1, -1, -1):
        pad = pads[i]
        if pad is None:
            continue
        while closing and closing[-1][0] > pad:
            closing.pop()
        if i in wanted:
            ends_at[i] = closing[-1][1] if closing and closing[-1][0] <= pad else len(pads)
        closing.append((pad, i))
    for head, d in heads:
        first = source.line(d.start)
        last = max(ends_at.get(first, len(pads)), source.line(max(head.start, head.end - 1)) + 1)
        stop = source.starts[last] if last < len(source.starts) else len(text)
        d.code = text[d.start : stop].rstrip()
        d.stop = d.start + len(d.code)
        doc = _DOC_PREFIX.match(text, head.end)
        if doc and doc.end() in ends and doc.end() < d.stop and ends[doc.end()] <= d.stop:
            quoted = text[doc.end() : ends[doc.end()]]
            inner = quoted[3:-3] if quoted[:3] in ('"""', "'''") and len(quoted) >= 6 else quoted[1:-1]
            if inner.strip():
                d.comment = inner
