"""Facts of one Go source file, without a Go toolchain.

A lexer with semicolon insertion and a small recursive parser read declarations in full; bodies are scanned once for
calls, literals, checks and goroutines. Names are resolved as far as one file tells: import aliases, receivers,
parameters and local declarations. What needs other files is left to joins over the facts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"(?P<nl>\n)|(?P<ws>[ \t\r\f]+)|(?P<lc>//[^\n]*)|(?P<bc>/\*.*?(?:\*/|\Z))|(?P<str>`[^`]*(?:`|\Z)|\"(?:\\.|[^\"\\\n])*\"?)|(?P<chr>'(?:\\.|[^'\\\n])*'?)|"
    r"(?P<num>\d[\w.]*|\.\d[\w]*)|(?P<id>[^\W\d]\w*)|(?P<op>\.\.\.|<<=|>>=|&\^=|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|[+\-*/%&|^]=|<<|>>|&\^|.)",
    re.S,
)
KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
BASIC = frozenset("bool byte complex128 complex64 error float32 float64 int int16 int32 int64 int8 rune string uint uint16 uint32 uint64 uint8 uintptr any".split())
BUILTIN_CALLS = frozenset("append cap clear close complex copy delete imag len make max min new panic print println real recover".split())
ENDS_LINE = frozenset((")", "]", "}", "++", "--"))
WRAPPERS = ("fmt.Errorf", "errors.Wrap", "errors.WithMessage", "errors.WithStack")
CONSTRUCTOR = re.compile(r"^(?:New|Create|Make|Build)")


@dataclass
class Tok:
    kind: str
    text: str
    line: int
    column: int


@dataclass
class TypeRef:
    """A type expression: its text, its text with qualified names, and the one named type it is, if any."""

    text: str
    full: str
    named: str = ""  # package.Name, or the name of a basic type
    pointer: bool = False
    kind: str = ""
    fields: list = field(default_factory=list)
    methods: list = field(default_factory=list)
    embedded: list = field(default_factory=list)


def lex(source: str) -> tuple[list[Tok], list[tuple[int, int, str, bool]]]:
    """Tokens with inserted semicolons, and comments as (first line, last line, text, alone on its line)."""
    tokens: list[Tok] = []
    comments = []
    line, start, fresh = 1, 0, True
    last = None

    def ends() -> bool:
        return last is not None and (last.kind in ("str", "chr", "num") or last.kind == "id" and (last.text not in KEYWORDS or last.text in ("break", "continue", "fallthrough", "return")) or last.text in ENDS_LINE)

    for m in TOKEN.finditer(source):
        kind, text = m.lastgroup, m.group()
        if kind == "ws":
            continue
        if kind == "nl":
            if ends():
                last = Tok("op", ";", line, m.start() - start + 1)
                tokens.append(last)
            line, start, fresh = line + 1, m.end(), True
            continue
        if kind in ("lc", "bc"):
            height = text.count("\n")
            comments.append((line, line + height, text, fresh))
            if height:
                if ends():
                    last = Tok("op", ";", line, m.start() - start + 1)
                    tokens.append(last)
                line, start = line + height, m.start() + text.rfind("\n") + 1
            continue
        last = Tok(kind, text, line, m.start() - start + 1)
        tokens.append(last)
        fresh = False
        if kind == "str" and "\n" in text:
            line, start = line + text.count("\n"), m.start() + text.rfind("\n") + 1
    tokens.append(Tok("op", ";", line, 1))
    return tokens, comments


def flatten_comment(text: str) -> str:
    lines = [re.sub(r"^\s*(?://|/\*+|\*(?!/))|\*/\s*$", "", x).strip() for x in text.split("\n")]
    return " ".join(x for x in lines if x)


class FileParser:
    def __init__(self, package: str, filename: str, source: str):
        self.package, self.filename = package, filename
        self.toks, comments = lex(source.replace("\r\n", "\n").replace("\r", "\n"))
        self.above = {last: (first, text) for first, last, text, alone in comments if alone}
        self.at = 0
        self.imports: dict[str, str] = {}
        self.rows: list[dict] = []
        self.order = 0
        self.errors = 0

    # ---- helpers

    def peek(self, k: int = 0) -> str:
        i = self.at + k
        return self.toks[i].text if i < len(self.toks) else ""

    def kind(self, k: int = 0) -> str:
        i = self.at + k
        return self.toks[i].kind if i < len(self.toks) else ""

    def take(self) -> Tok:
        t = self.toks[min(self.at, len(self.toks) - 1)]
        self.at += 1
        return t

    def skip(self, opening: str) -> None:
        """Past the bracket that closes the one at the current token."""
        closing = {"(": ")", "[": "]", "{": "}"}[opening]
        depth = 0
        while self.at < len(self.toks):
            t = self.take().text
            depth += (t == opening) - (t == closing)
            if depth == 0:
                return
        self.errors += 1

    def doc(self, line: int) -> str:
        parts = []
        at = line - 1
        while at in self.above:
            first, text = self.above[at]
            parts.append(text)
            at = first - 1
        return flatten_comment("\n".join(reversed(parts)))

    def emit(self, kind: str, tok: Tok, **values) -> None:
        self.order += 1
        self.rows.append({"kind": kind, "package": self.package, "filename": self.filename, "line": tok.line, "col": tok.column, "ord": self.order} | values)

    # ---- types

    def qualified(self, name: str) -> str:
        return name if name in BASIC else f"{self.package}.{name}"

    def type_(self) -> TypeRef:
        t = self.take()
        if t.text == "*":
            x = self.type_()
            return TypeRef("*" + x.text, "*" + x.full, x.named, True, "pointer")
        if t.text == "(":
            x = self.type_()
            if self.peek() == ")":
                self.take()
            return x
        if t.text == "...":
            x = self.type_()
            return TypeRef("..." + x.text, "..." + x.full, "", False, "slice")
        if t.text == "[":
            if self.peek() == "]":
                self.take()
                x = self.type_()
                return TypeRef("[]" + x.text, "[]" + x.full, "", False, "slice")
            size = []
            while self.at < len(self.toks) and self.peek() != "]":
                size.append(self.take().text)
            self.take()
            x = self.type_()
            return TypeRef(f"[{''.join(size)}]{x.text}", f"[{''.join(size)}]{x.full}", "", False, "array")
        if t.text == "map":
            self.take()
            k = self.type_()
            self.take()
            v = self.type_()
            return TypeRef(f"map[{k.text}]{v.text}", f"map[{k.full}]{v.full}", "", False, "map")
        if t.text in ("chan", "<-"):
            way = "chan"
            if t.text == "<-":
                self.take()
                way = "<-chan"
            elif self.peek() == "<-":
                self.take()
                way = "chan<-"
            x = self.type_()
            return TypeRef(f"{way} {x.text}", f"{way} {x.full}", "", False, "chan")
        if t.text == "func":
            text, full, _, _ = self.signature()
            return TypeRef("func" + text, "func" + full, "", False, "func")
        if t.text == "struct":
            return self.struct()
        if t.text == "interface":
            return self.interface()
        if t.text == "~":
            return self.type_()
        if t.kind != "id":
            self.errors += 1
            return TypeRef(t.text, t.text)
        name, full = t.text, self.qualified(t.text)
        if self.peek() == "." and self.kind(1) == "id":
            self.take()
            short = self.take().text
            name, full = f"{t.text}.{short}", f"{self.imports.get(t.text, t.text)}.{short}"
        out = TypeRef(name, full, full, False, "named")
        if self.peek() == "[" and self.peek(1) != "]":
            mark = self.at
            self.take()
            args = [self.type_()]
            while self.peek() == ",":
                self.take()
                args.append(self.type_())
            if self.peek() == "]":
                self.take()
                out.text += "[" + ",".join(a.text for a in args) + "]"
            else:
                self.at = mark
        return out

    def struct(self) -> TypeRef:
        out = TypeRef("struct{...}", "struct{...}", "", False, "struct")
        if self.peek() != "{":
            return out
        self.take()
        while self.at < len(self.toks) and self.peek() != "}":
            if self.peek() == ";":
                self.take()
                continue
            first = self.toks[self.at]
            names = []
            if self.kind() == "id" and self.peek(1) in (";", "}", ".") or self.peek() == "*" or self.kind() == "id" and self.kind(1) == "str":
                t = self.type_()
                out.embedded.append(t)
                names = [(t.text.lstrip("*").split(".")[-1].split("[")[0], True)]
            else:
                names.append((self.take().text, False))
                while self.peek() == ",":
                    self.take()
                    names.append((self.take().text, False))
                t = self.type_()
            tag = self.take().text if self.kind() == "str" else ""
            out.fields += [(n, t, e, tag, first) for n, e in names]
            while self.peek() not in (";", "}") and self.at < len(self.toks):
                self.take()
                self.errors += 1
        self.take()
        return out

    def interface(self) -> TypeRef:
        out = TypeRef("interface{...}", "interface{...}", "", False, "interface")
        if self.peek() != "{":
            return out
        self.take()
        while self.at < len(self.toks) and self.peek() != "}":
            if self.peek() == ";":
                self.take()
                continue
            if self.kind() == "id" and self.peek(1) == "(":
                name = self.take().text
                _, full, _, _ = self.signature()
                out.methods.append((name, full))
            else:
                t = self.type_()
                if self.peek() == "|":
                    while self.peek() not in (";", "}"):
                        self.take()
                else:
                    out.embedded.append(t)
            while self.peek() not in (";", "}") and self.at < len(self.toks):
                self.take()
        self.take()
        return out

    def params(self) -> list[tuple[str, TypeRef, Tok]]:
        """Named or bare types between parentheses."""
        entries: list[list] = []
        self.take()
        while self.at < len(self.toks) and self.peek() != ")":
            if self.peek() in (",", ";"):
                self.take()
                continue
            first = self.toks[self.at]
            if self.kind() == "id" and self.peek() not in KEYWORDS and self.peek(1) not in (",", ")", ".", "["):
                name = self.take().text
                entries.append([name, self.type_(), first])
            elif self.kind() == "id" and self.peek(1) == "[" and self.peek(2) == "]":
                name = self.take().text
                entries.append([name, self.type_(), first])
            elif self.kind() == "id" and self.peek(1) == "[" and self.kind(2) == "num":
                name = self.take().text
                entries.append([name, self.type_(), first])
            else:
                entries.append(["", self.type_(), first])
            before = self.at
            if self.peek() not in (",", ")", ";"):
                self.errors += 1
                if self.at == before:
                    self.take()
        self.take()
        if any(n for n, _, _ in entries):  # a, b int: bare entries are names of the type that follows
            later = None
            for e in reversed(entries):
                if e[0]:
                    later = e[1]
                elif later is not None:
                    e[0], e[1] = e[1].text, later
        return [tuple(e) for e in entries]

    def signature(self) -> tuple[str, str, list, list]:
        """Text, qualified text without names, parameters and results, from the opening parenthesis on."""
        ins = self.params() if self.peek() == "(" else []
        outs: list = []
        if self.peek() == "(":
            outs = self.params()
        elif self.peek() not in (";", "{", "}", ")", ",", "]", ":=", "=", "`") and self.kind() not in ("str",):
            outs = [("", self.type_(), self.toks[self.at - 1])]
        shown = ", ".join(f"{n} {t.text}".strip() for n, t, _ in ins)
        results = ", ".join(f"{n} {t.text}".strip() for n, t, _ in outs)
        tail = f" ({results})" if "," in results else f" {results}" if results else ""
        full = f"({','.join(t.full for _, t, _ in ins)})({','.join(t.full for _, t, _ in outs)})"
        return f"({shown}){tail}", full, ins, outs

    # ---- declarations

    def parse(self) -> list[dict]:
        while self.at < len(self.toks):
            t = self.take()
            if t.text == "package" and self.kind() == "id":
                self.take()
            elif t.text == "import":
                self.group(self.import_)
            elif t.text == "type":
                self.group(self.type_decl)
            elif t.text == "func":
                self.func(t)
            elif t.text in ("var", "const"):
                self.group(self.value)
            elif t.text in "([{" and t.text:
                self.at -= 1
                self.skip(t.text)
        return self.rows

    def group(self, one) -> None:
        if self.peek() != "(":
            one()
            return
        self.take()
        while self.at < len(self.toks) and self.peek() != ")":
            if self.peek() == ";":
                self.take()
                continue
            before = self.at
            one()
            if self.at == before:
                self.take()
        self.take()

    def import_(self) -> None:
        alias = ""
        if self.kind() == "id" or self.peek() in (".", "_"):
            alias = self.take().text
        t = self.take()
        path = t.text.strip("\"`")
        name = path.rsplit("/", 1)[-1]
        self.imports[alias or name] = path
        self.emit("import", t, target=f"package:{path}", name=path)

    def value(self) -> None:
        depth = 0
        while self.at < len(self.toks):
            if depth == 0 and self.peek() in (";", ")"):
                return
            t = self.take().text
            depth += (t in "([{") - (t in ")]}") if len(t) == 1 else 0

    def type_decl(self) -> None:
        t = self.take()
        name = t.text
        if self.peek() == "[" and self.kind(1) == "id" and self.peek(2) not in ("]",):
            self.skip("[")
        if self.peek() == "=":
            self.take()
        x = self.type_()
        while self.peek() not in (";", ")") and self.at < len(self.toks):
            self.take()
        if x.kind not in ("struct", "interface"):
            return
        own = f"{x.kind}:{self.package}.{name}"
        size = 3 * len(x.methods) + 5 if x.kind == "interface" else 2 * len(x.fields) + 8
        self.emit("type", t, id=own, name=name, type_name=x.kind, size=size, doc=self.doc(t.line), exported=name[:1].isupper(), names=[m for m, _ in x.methods])
        for m, full in x.methods:
            self.emit("interface_method", t, owner=own, name=m, text=full)
        for e in x.embedded:
            self.emit("embed", t, owner=own, target=e.named, pointer=e.pointer, type_name=x.kind)
        for n, ft, embedded, tag, at in x.fields:
            self.emit("field", at, id=f"field:{self.package}.{name}.{n}", owner=own, name=n, type_name=ft.text, text=tag.strip("`\""), pointer=ft.pointer, embedded=embedded, exported=n[:1].isupper())

    def func(self, start: Tok) -> None:
        receiver, recv = "", None
        if self.peek() == "(":
            got = self.params()
            if got:
                receiver, recv = got[0][0], got[0][1]
        if self.kind() != "id":
            self.errors += 1
            return
        t = self.take()
        name = t.text
        if self.peek() == "[":
            self.skip("[")
        text, full, ins, outs = self.signature()
        star = "*" if recv is not None and recv.pointer else ""
        own = f"method:{self.package}.{star}{recv.named}.{name}" if recv is not None else f"function:{self.package}.{name}"
        begin = self.at
        body = self.peek() == "{"
        if body:
            self.skip("{")
        scan = self.toks[begin : self.at] if body else []
        complexity = 1 + sum(x.text in ("if", "for", "switch") and x.kind == "id" for x in scan) + 2 * sum(x.text == "func" and x.kind == "id" for x in scan)
        shown = f"({receiver} {recv.text}) {name}{text}".replace("( ", "(") if recv is not None else f"{name}{text}"
        self.emit(
            "func", start, id=own, name=name, owner=f"{recv.named}" if recv is not None else None, text=shown, doc=self.doc(start.line), complexity=complexity, size=complexity + 5,
            exported=name[:1].isupper(), pointer=bool(star), type_name="method" if recv is not None else "function", full=full,
        )
        for i, (n, pt, at) in enumerate(ins):
            if n and n != "_":
                self.emit("param", at, id=f"parameter:{self.package}.{name}.{n}", owner=own, name=n, type_name=pt.text, size=i)
        groups = {id(pt): pt for _, pt, _ in ins}  # a, b T is one group
        for pt in groups.values():
            if pt.named:
                self.emit("parameter_type", start, owner=own, target=pt.named)
        for _, rt, at in outs:
            if rt.named:
                self.emit("result", at, owner=own, target=rt.named, pointer=rt.pointer)
                if recv is None and CONSTRUCTOR.match(name):
                    self.emit("constructs", at, owner=own, target=rt.named)
        if recv is not None and body and recv.named:
            self.emit("method_of", start, owner=own, target=recv.named)
        env = {n: pt for n, pt, _ in [*ins, *outs] if n}
        if recv is not None and receiver:
            env[receiver] = recv
        if body:
            self.body(scan, own, env)

    # ---- bodies

    def body(self, toks: list[Tok], own: str, env: dict[str, TypeRef]) -> None:
        n = len(toks)
        word = lambda i: toks[i].text if 0 <= i < n else ""
        what = lambda i: toks[i].kind if 0 <= i < n else ""
        header = -1  # bracket depth at which a control header is open
        depth = 0
        source_of: dict[str, str] = {}  # variable to the function whose result it holds

        def read_type(i: int) -> tuple[TypeRef, int]:
            sub = FileParser.__new__(FileParser)
            sub.package, sub.imports, sub.toks, sub.at, sub.errors, sub.above, sub.rows, sub.order, sub.filename = self.package, self.imports, toks, i, 0, {}, [], 0, self.filename
            x = sub.type_()
            return x, sub.at

        def function_id(base: str, name: str) -> str | None:
            if not base:
                return None if name in env or name in BUILTIN_CALLS or name in BASIC else f"function:{self.package}.{name}"
            return f"function:{self.imports[base]}.{name}" if base in self.imports and base not in env else None

        def call(i: int, base: str, name: str, go: bool) -> None:
            targets: list[str] = []
            via = None
            direct = function_id(base, name)
            if direct:
                targets = [direct]
            elif base in env and env[base].named and env[base].named not in BASIC:
                t = env[base]
                pkg = t.named.rsplit(".", 1)[0]
                targets = [f"method:{pkg}.*{t.named}.{name}"] if t.pointer else [f"method:{pkg}.{t.named}.{name}", f"method:{pkg}.*{t.named}.{name}"]
            elif base in source_of:
                via = source_of[base]
            shown = f"{base}.{name}" if base else name
            if targets or via:
                for kind in ("call", "spawn", "spawn") if go else ("call",):  # a go statement is met by two visitors
                    self.emit(kind, toks[i], owner=own, names=targets, target=via, name=name)
            if shown.endswith(WRAPPERS) or not base and (name == "Errorf" or name.endswith("Wrap")):
                self.emit("wraps_error", toks[i], owner=own)

        i = 0
        while i < n:
            t = toks[i]
            x = t.text
            if t.kind == "op":
                if x in ("(", "[", "{"):
                    if x == "{" and header == depth:
                        header = -1
                    depth += 1
                elif x in (")", "]", "}"):
                    depth -= 1
                elif x in ("==", "!="):
                    for name, other in ((word(i - 1), word(i + 1)), (word(i + 1), word(i - 1))):
                        if other == "nil" and name not in KEYWORDS and re.match(r"[^\W\d]\w*$", name) and name != "nil" and word(i - 2) != ".":
                            ref = env.get(name)
                            target = ref.named if ref is not None else "error" if name == "err" else ""
                            if target:
                                self.emit("uses", t, owner=own, target=target)
                    if x == "!=" and word(i - 1) == "err" and word(i + 1) == "nil" and word(i - 2) in ("if", ";") and word(i + 2) == "{" and header >= 0:
                        self.emit("handles_error", t, owner=own)
                i += 1
                continue
            if t.kind != "id":
                i += 1
                continue
            if x in ("if", "for", "switch"):
                header = depth
                i += 1
                continue
            if x == "var" and what(i + 1) == "id" and word(i + 1) not in KEYWORDS:
                names, j = [word(i + 1)], i + 2
                while word(j) == "," and what(j + 1) == "id":
                    names.append(word(j + 1))
                    j += 2
                if word(j) not in ("=", ";", ""):
                    ref, j = read_type(j)
                    for v in names:
                        env[v] = ref
                    if ref.named:
                        self.emit("uses", t, owner=own, target=ref.named)
                i = j
                continue
            if x == "func" and word(i + 1) == "(":
                sub = FileParser.__new__(FileParser)
                sub.package, sub.imports, sub.toks, sub.at, sub.errors, sub.above, sub.rows, sub.order, sub.filename = self.package, self.imports, toks, i + 1, 0, {}, [], 0, self.filename
                _, _, ins, outs = sub.signature()
                for v, ref, _ in [*ins, *outs]:
                    if v:
                        env.setdefault(v, ref)
                i = max(sub.at, i + 1)
                continue
            if x in KEYWORDS:
                i += 1
                continue
            if word(i - 1) == ".":  # a later part of a chain: what it stands for is not known here
                i += 1
                continue
            base, name, j = "", x, i + 1
            if word(j) == "." and what(j + 1) == "id":
                base, name, j = x, word(j + 1), j + 2
            chained = word(j) == "." and what(j + 1) == "id"
            # v := T{...}, v := &T{...}, v := f(...), v, err := f(...)
            if not base and word(j) in (":=", ","):
                k, names = i, [x]
                while word(k + 1) == "," and what(k + 2) == "id":
                    names.append(word(k + 2))
                    k += 2
                if word(k + 1) == ":=":
                    at, pointer = k + 2, False
                    if word(at) == "&":
                        at, pointer = at + 1, True
                    if what(at) == "id" and word(at) not in KEYWORDS:
                        q, m, e = "", word(at), at + 1
                        if word(e) == "." and what(e + 1) == "id":
                            q, m, e = word(at), word(e + 1), e + 2
                        if word(e) == "{" and header < 0:
                            ref = f"{self.imports.get(q, q)}.{m}" if q else self.qualified(m)
                            env[names[0]] = TypeRef(m, ref, ref, pointer, "named")
                        elif word(e) == "(":
                            f = function_id(q, m)
                            if f:
                                for v in names[:1]:
                                    source_of[v] = f
                                    env.pop(v, None)
            go = word(i - 1) == "go"
            if word(j) == "(" and not chained:
                call(i, base, name, go)
            elif word(j) == "[" and not chained and not base and name[:1].isupper():
                k = j
                while k < n and word(k) not in ("]", ";", "{"):
                    k += 1
                if word(k) == "]" and word(k + 1) == "(" and name not in env:
                    call(i, base, name, go)
            elif word(j) == "{" and not (header >= 0 and header == depth) and word(i - 1) not in ("struct", "interface") and name not in env:
                if base == "" or base in self.imports:
                    ref = f"{self.imports[base]}.{name}" if base else self.qualified(name)
                    if ref not in BASIC:
                        self.emit("uses", t, owner=own, target=ref)
            elif base and base in env and not env[base].pointer and env[base].named and env[base].named not in BASIC and word(j) != "(":
                self.emit("field_access", t, owner=own, target=env[base].named)
            i = j if j > i else i + 1


def type_descriptor(package: str, text: str) -> dict:
    """Kind and flags of a type expression, as the type_info of a node states them."""
    p = FileParser(package, "", text)
    generic = "[" in text and re.match(r"^[*]?[\w.]+\[", text) is not None
    x = p.type_() if p.toks and p.peek() != ";" else TypeRef("", "")
    way = {"chan": "both", "<-chan": "receive", "chan<-": "send"}.get(x.text.split(" ")[0], "") if x.kind == "chan" else ""
    return {
        "kind": x.kind, "is_pointer": x.pointer, "is_slice": x.kind == "slice", "is_array": x.kind == "array", "is_channel": x.kind == "chan", "channel_dir": way, "is_generic": generic, "underlying_type": x.full,
        "method_set": [m for m, _ in x.methods], "field_count": len(x.fields), "embedded_types": [e.text for e in x.embedded], "is_exported": x.named.rsplit(".", 1)[-1][:1].isupper(),
    }


FIELDS = {
    "kind": "string", "package": "string", "filename": "string", "line": "int", "col": "int", "ord": "int", "id": "string", "owner": "string", "name": "string", "target": "string", "type_name": "string",
    "text": "string", "full": "string", "doc": "string", "size": "int", "complexity": "int", "pointer": "boolean", "embedded": "boolean", "exported": "boolean", "names": "array<string>",
}


def file_facts(package: str, filename: str, source: str) -> list[dict]:
    """Rows of FIELDS; a file that can't be read as Go gives one row of kind ``bad``."""
    p = FileParser(package, filename, source)
    try:
        rows = p.parse()
    except (IndexError, RecursionError):
        return [{"kind": "bad", "package": package, "filename": filename}]
    if not re.search(r"^\s*package\s+\w+", source, re.M):
        return [{"kind": "bad", "package": package, "filename": filename}]
    return [{"kind": "file", "package": package, "filename": filename}, *rows]
