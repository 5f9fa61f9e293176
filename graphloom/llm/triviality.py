"""Whether a documentation tells anything beyond the declaration it stands at.

The text is cut into statements; statements that are directives, reminders, notices, drawn lines or code are put aside.
What is left must hold words that neither the name, receiver and parameters nor mere phrasing contribute. Other ways to
say a part of a name are learned from the corpus: a word that declarations sharing the part add, alone, to their
restated names tells no more than the part does.
"""

from __future__ import annotations

import re

MARKS = re.compile(r"^\s*(?:/\*+|\*+/|///?|\*(?!\w)|#+|--+)|\*+/\s*$", re.M)
DIRECTIVE = re.compile(
    r"^(?://\s*)?(?:go:\w+.*|\+build\b.*|nolint\b.*|lint:\S+.*|noinspection\b.*|eslint-\S+.*|@ts-\w+.*|type:\s*ignore.*|noqa\b.*|pylint:.*|pragma:?\b.*|coverage:\s*ignore.*|exhaustive:ignore.*|"
    r"#?nosec\b.*|staticcheck\b.*|swagger:\w+.*|export\s+\w+$|line\s+\S+:\d+.*|clang-format\s+(?:on|off)|revive:\S+.*|golangci\S*.*|sys(?:nb)?\s.*|mockgen\b.*|easyjson:\w+.*|cgo\b.*|\+k8s\S*.*|\+genclient.*|\+kubebuilder\S*.*)$",
    re.I,
)
INLINE_DIRECTIVE = re.compile(r"(?:^|\s)(?://\s*)?(?:nolint(?::[\w,]+)?|lint:ignore \w+(?: \w+)?|go:(?:noinline|nosplit|norace|linkname|build \S+|generate \S+(?: -\S+)*|embed \S+)|noqa(?::\s?\w+)?)(?=\s|$)")
#: the markers of unfinished work that tools know, with an owner in brackets or not
REMINDER = re.compile(r"^[\W_]*(?:todo|fixme|xxx|hack|tbd|wip)\b", re.I)
#: notices of generated files and of rights, in their usual whole forms
NOTICE = re.compile(r"^\W*(?:code|this file (?:is|was)|file)\s+(?:auto-?\s?)?generated\b|^\W*(?:auto-?\s?|machine[ -])generated\W*(?:$|by|from|code|file)|\bdo not edit\b|^\W*copyright\b|all rights reserved|spdx-license|^\W*licen[cs]ed under", re.I)
CODE = re.compile(
    r"^(?:func\b.*\(.*|(?:if|for|switch|select)\b.*\{.*|\}.*|return(?:\s+(?:&?[\w.\[\]]+(?:\([^()]*(?:\([^()]*\))?[^()]*\))?|\"[^\"]*\"))?(?:,\s*(?:&?[\w.\[\]]+(?:\([^()]*\))?|\"[^\"]*\"))*;?|(?:var|const)\s+\w+\s*(?:=|[\w.\[\]*]+\s*(?:=|$)).*|type\s+\w+\s+(?:struct|interface|func).*|defer\s+[\w.]+\(.*\)|go\s+[\w.]+\(.*\)|"
    r"package\s+\w+|import\s*(?:\(|\").*|(?:case\b.*|default):|[\w.\[\]]+(?:,\s*[\w.\[\]]+)*\s*(?::=|[+\-*/|&]?=)\s*\S.*|[\w.]+\(.*\)\s*[;{]?|[\w.]+(?:\+\+|--)|break|continue|[\w.]+\s*<-.*|.*\)\s*[;{]|.*\{)$"
)
TAG = re.compile(r"[@\\](?:param|arg|argument|return|returns|throws|exception|type|rtype|see|since|author|version|deprecated|link|brief|tparam|yields?|receiver)\b(?:\s*\{[^}]*\})?", re.I)
NAMED_TAG = re.compile(r"[@\\](?:param|arg|argument|tparam)\b(?:\s*\{[^}]*\})?\s+[\w.$]+", re.I)
#: words of phrasing: they say that there is a function, or join other words
GLUE = frozenset(
    """a an the this that these those it its itself is are was were be been being as of for to from in on at by with into onto and or nor not
    which who whose what will would can could shall should may might must do does did done has have had having just simply basically only also very
    function functions func method methods procedure routine helper utility implementation implements implement implementing receiver param params parameter parameters
    argument arguments arg args return returns returned returning value values result results type types struct interface package name names named called says said say suggests
    implies used uses use using given input output some any all one new main method's function's operation operations action actions thing things stuff code here above below
    there then so if we you i they your our my his her their self object instance job work task perform performs performed performing execute executes executed executing
    handle handles handled handling process processes processed processing run runs running call calls calling provide provides providing allow allows get gets
    defined define defines definition declare declares declared member belongs belong behalf way etc eg ie via per such itself according corresponding respective accordingly
    responsible purpose purposes intended serves serve does what""".split()
)
#: words that speak of the documentation or of its lack, not of the code
STUB = frozenset(
    """doc docs godoc documentation documented undocumented document documenting description describe described comment comments docstring explanation todo fixme tbd wip placeholder stub
    dummy missing pending available required needed yet later soon please add insert write written nil none null unknown obvious self explanatory ditto same deprecated obsolete
    internal private public exported unexported misc various default generated autogenerated auto generic see look refer no""".split()
)
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
NAME_PART = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+")
NEED = 2


def name_words(*names: str | None) -> set[str]:
    out = set()
    for n in names:
        if n:
            parts = [p.lower() for p in NAME_PART.findall(n)]
            out.update(parts)
            out.add(re.sub(r"\W", "", n).lower())
    return out


def _stem(word: str) -> str:
    w = word.lower().replace("’", "'").split("'")[0]
    for end, to in (("ies", "y"), ("ied", "y"), ("sses", "ss"), ("xes", "x"), ("ches", "ch"), ("shes", "sh"), ("ing", ""), ("ed", ""), ("es", "e"), ("s", ""), ("er", ""), ("or", ""), ("e", "")):
        if w.endswith(end) and len(w) - len(end) >= 3:
            w = w[: len(w) - len(end)] + to
            break
    if len(w) > 3 and w[-1] == w[-2] and w[-1] not in "sl":
        w = w[:-1]
    return w.rstrip("e") if len(w) > 3 else w


def _known(names: set[str], said: dict[str, frozenset[str]]) -> set[str]:
    stems = {_stem(x) for x in names}
    return names | stems | {w for x in stems for w in said.get(x, ())}


#: code that stands within a line of text, and reminders and stub phrases that begin there
INLINE_CODE = re.compile(
    r"if\s+[\w.]+\s*[!=]=\s*\w+\s*\{[^{}]*\}|return(?:\s+[\w.]+\([^()]*\))(?:,\s*\w+)*|[\w.]+(?:,\s*[\w.]+)*\s*:=\s*[\w.&]+(?:\([^()]*\)|\{[^{}]*\})?|\b(?!O\()[A-Za-z_]\w*(?:\.\w+)*\([^()]*\)"
)
BREAK = re.compile(r"\s+(?=(?:TODO|FIXME|XXX|TBD|HACK)\b|(?:todo|fixme)\()")


def statements(text: str) -> list[str]:
    text = MARKS.sub("", text.replace("\r\n", "\n").replace("\r", "\n"))
    text = MARKS.sub("", text)
    out = []
    for line in re.split(r"\n", BREAK.sub("\n", text)):
        for part in re.split(r"(?<=[.!?;。！？])\s+|(?<=[。！？])", line):
            part = part.strip(" \t*-=_~#>•·|+<").strip()
            if part:
                out.append(part)
    return out


def _novel(text: str, known: set[str]) -> list[str]:
    """Stems of words beyond the known ones and phrasing. In scripts without blanks a run of letters counts by its length."""
    found = []
    for w in WORD.findall(text):
        low = w.lower()
        if not low.isascii() and any("\u3040" <= c <= "\u9fff" or "\uac00" <= c <= "\ud7a3" for c in low):
            found += [low] * max(1, len(low) // 3)
        elif low not in GLUE and low not in STUB and low not in known and (len(low) > 1 or not low.isascii()):
            stem = _stem(low)
            if stem not in known:
                found.append(stem)
    return found


def new_words(doc: str | None, name: str, receiver: str | None = None, params: str | None = None, said: dict[str, frozenset[str]] | None = None) -> list[list[str]]:
    """For each statement that is none of the kinds put aside, the stems of its words beyond the declaration."""
    if not doc or not doc.strip():
        return []
    known = _known(name_words(name, receiver, params), said or {})
    glued = re.sub(r"\W", "", name or "").lower()
    out = []
    for part in statements(doc):
        text = INLINE_DIRECTIVE.sub(" ", part).strip(" \t.;:!,-*=_~#")
        if not text or DIRECTIVE.match(text) or DIRECTIVE.match(part) or REMINDER.match(text) or NOTICE.search(text) or CODE.match(part.strip()) or CODE.match(text):
            continue
        text = INLINE_CODE.sub(" ", TAG.sub(" ", NAMED_TAG.sub(" ", text)))
        out.append(_novel(" ".join(w for w in text.split() if re.sub(r"\W", "", w).lower() != glued), known))
    return out


def is_trivial(doc: str | None, name: str, receiver: str | None = None, params: str | None = None, said: dict[str, frozenset[str]] | None = None) -> bool:
    """True if ``doc`` tells nothing beyond the declaration: no statement adds NEED words. Null and blank are trivial;
    text of any length and language is read whole, and one telling statement anywhere is enough. ``said`` has, for stems
    of name parts, the stems that say the part again."""
    return not any(len(words) >= NEED for words in new_words(doc, name, receiver, params, said))


def name_stems(name: str) -> list[str]:
    return sorted({_stem(x) for x in name_words(name)})


def echoes(doc: str | None, name: str) -> list[tuple[str, str]]:
    """(stem of a name part, stem) for every statement that adds one word alone to the restated name."""
    alone = {words[0] for words in new_words(doc, name) if len(words) == 1}
    return [(part, word) for word in sorted(alone) for part in name_stems(name)]
