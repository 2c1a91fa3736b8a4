"""Secret scans by assignment-aware lexing.

Lines with an assignment sign, and the lines that continue them, are lexed as source or
configuration: ``name = "literal"``, ``"name": "literal"``, ``name: literal``,
``<name>literal</name>`` and ``--name literal``, with values on the next line, in brackets or in
lists, and names given to names (``a = b = "literal"``, ``$name``, ``${name}``, ``x.name``,
``x["name"]``). Words like Bearer before a value are no part of it. All bindings of a document
are collected first; then constants are propagated, wherever they are defined: a literal counts
under every name that it reaches. It is scored by how sensitive these names are and by how
little it looks like a word or a placeholder.

Three fixed patterns give the base spans; they are found by the same pass and always stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "name", "constant")
BASE_KINDS = KINDS[:3]
LEAST_SCORE = 0.5

# Fixed patterns of the base spans.
_ASSIGN = re.compile(
    r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_LEAST_ASSIGN, _LEAST_ACCESS = 6, 20

_SIGN = re.compile(r"[:=>]|--")
_SCHEME = r"(?i:(?:bearer|basic|token|digest|apikey|negotiate)[ \t]+)?"
_ITEM = rf"""(?:"{_SCHEME}(?P<double>(?:[^"\\\n]|\\.)*)"|'{_SCHEME}(?P<single>(?:[^'\\\n]|\\.)*)'"""
#: What may stand between a sign and its value: a YAML block or line end, a bracket, a backslash; then the value may be on the next line.
_GAP = r"""(?P<gap>[ \t]*(?:[>|][+-]?[ \t]*\n[ \t]+|\\[ \t]*\r?\n[ \t]*|[(\[]\s*)|(?<=:)[ \t]*\r?\n[ \t]*(?:-[ \t]+)?)"""
_NESTED = r"""(?!["']?[\w.-]+["']?[ \t]*(?::(?:\s|\Z)|=(?![=\s]|\Z)))"""
_PAIR = re.compile(
    rf"""(?<![\w.-])["']?(?P<name>[A-Za-z_][\w.-]*+)["']?\]?
        (?:[ \t]*:[ \t]*[A-Za-z_][\w.\[\]]*+(?=[ \t]*=))?          # a type between name and value
        [ \t]*(?::=|=>|=|:)(?![=/])
        (?:{_GAP}{_NESTED}|[ \t]*)
        {_ITEM}|{_SCHEME}(?:\$\{{(?P<braced>[A-Za-z_][\w.]*)(?::?[-=](?P<default>[^}}\n]*))?\}}|\$\((?P<paren>[A-Za-z_]\w*)\)
        |\{{\{{[ \t]*(?P<curly>[A-Za-z_][\w.]*)[ \t]*\}}\}}|[A-Za-z_][\w.]*\[["'](?P<key>[A-Za-z_][\w.-]*)["']\]
        |(?P<bare>[^\s"'`,;(){{}}\[\]<>]+)))""",
    re.VERBOSE | re.ASCII,
)
#: Further items of a list in brackets, or further lines of a YAML block or list.
_MORE = re.compile(rf"[\s,+\\]+{_ITEM})(?![ \t]*[:=])", re.ASCII)
_MORE_LINES = re.compile(rf"\r?\n[ \t]+(?:-[ \t]+)?{_NESTED}(?:{_ITEM}|(?P<bare>[^\s\"'`,;(){{}}\[\]<>]+)))(?=[ \t\r]*(?:\n|\Z))", re.ASCII)
_LINE_ENDS = re.compile(r"[ \t\r]*(?:\n|\Z)")
_CHAINED = re.compile(r"(?<=[:=])[ \t]*[\w\"'$]|[ \t]*(?::=|=>|=|:)(?![=/])[ \t]*[\w\"'$]", re.ASCII)
_CONTINUES = re.compile(r"(?:[:=(\[,\\+]|[>|][+-]?)[ \t\r]*\Z")
_CONTINUED = re.compile(r"[ \t]+(?:-[ \t]+)?[^\s:=]+[ \t\r]*(?:\n|\Z)")
_REFERENCE = re.compile(r"\$\{?([A-Za-z_]\w*)\}?|%([A-Za-z_]\w*)%|\{\{[ \t]*([A-Za-z_][\w.]*)[ \t]*\}\}", re.ASCII)
_TAG = re.compile(r"<([A-Za-z_][\w.-]*)>([^<>\n]+)</\1>", re.ASCII)
_OPTION = re.compile(r"(?<!\S)--([A-Za-z][\w-]*)[= ](?!-)(\S+)", re.ASCII)
_NAME = re.compile(r"[A-Za-z_][\w.-]*", re.ASCII)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

#: How sensitive a part of a name, or two neighbouring parts, are.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "api key": 1.0, "access key": 1.0, "private key": 1.0, "secret key": 1.0, "auth key": 0.9, "credential": 0.9,
    "credentials": 0.9, "signing key": 0.9, "encryption key": 0.9, "bearer": 0.8, "authorization": 0.7,
}
_PLACEHOLDER = re.compile(r"(?i)^(?:\$\{.*|<.*|%\(.*|\{\{.*|x+|\*+|none|null|true|false|changeme|example|your[_-].*|todo)$")


def sensitivity(name: str) -> float:
    parts = [p.lower() for p in _PARTS.findall(name)]
    return max((SENSITIVE.get(p, 0.0) for p in [*parts, *map(" ".join, zip(parts, parts[1:]))]), default=0.0)


def unlikeness(literal: str) -> float:
    """From 0 (a placeholder or a plain word) to 1 (looks drawn at random)."""
    n = len(literal)
    if n < 6 or _PLACEHOLDER.match(literal):
        return 0.0
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(literal).values())
    classes = sum(any(map(test, literal)) for test in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(1.0, 0.2 * classes + 0.15 * entropy)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= _LEAST_ASSIGN]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _LEAST_ACCESS]
    return found + [("hex", *m.span()) for m in _HEX.finditer(text)]


def _lines_with_signs(text: str) -> Iterator[tuple[int, int]]:
    """Lines with a sign, with the lines that continue them."""
    at = 0
    while (sign := _SIGN.search(text, at)) is not None:
        begin = text.rfind("\n", at, sign.start()) + 1 or at
        end = text.find("\n", sign.start())
        end, line, more = len(text) if end < 0 else end, begin, False
        while end < len(text) and (_CONTINUES.search(text, max(line, end - 40), end) or more and _CONTINUED.match(text, end + 1)):
            line, more = end + 1, True
            end = text.find("\n", line)
            end = len(text) if end < 0 else end
        yield begin, end
        at = end + 1


def pairs(text: str) -> Iterator[tuple[str, int, int, str | None, bool]]:
    """``name, start, end, reference, quoted`` of every literal or name that is given to a name, in order of lines.

    ``reference`` is the name that a value stands for by its syntax; any bare word may also be a name.
    """
    for begin, end in _lines_with_signs(text):
        at = begin
        while (m := _PAIR.search(text, at, end)) is not None:
            at, name, gap = m.end(), m["name"], m["gap"] or ""
            below = "\n" in gap and gap.lstrip()[:1] not in ("(", "[", "\\")
            if below and m["bare"] and (gap[-1] == "\n" or not _LINE_ENDS.match(text, m.end(), end)):
                at = m.end("name") + 1  # the next line is one of its own
                continue
            for group in ("braced", "paren", "curly", "key"):
                if m[group]:
                    yield name, *m.span(group), m[group], False
            plain = (m["bare"] or "").rstrip(":=")
            chained = _NAME.fullmatch(plain) and _CHAINED.match(text, m.end("bare"), end)
            if chained:
                yield name, m.start("bare"), m.start("bare") + len(plain), plain, False
                at = m.start("bare")
            for group in ("double", "single", "default", *(() if chained else ("bare",))):
                if m[group]:
                    value = _REFERENCE.fullmatch(m[group])
                    yield name, *m.span(group), value and (value[1] or value[2] or value[3]), group in ("double", "single")
            more = _MORE if gap.lstrip()[:1] in ("(", "[") else _MORE_LINES if below else None
            while more and (item := more.match(text, at, end)) is not None:
                at = item.end()
                if item.start(item.lastgroup) < item.end(item.lastgroup):
                    yield name, *item.span(item.lastgroup), None, item.lastgroup != "bare"
        for pattern in (_TAG, _OPTION):
            for m in pattern.finditer(text, begin, end):
                value = _REFERENCE.fullmatch(m[2])
                yield m[1], *m.span(2), value and (value[1] or value[2] or value[3]), True


def named_spans(text: str) -> list[tuple[str, int, int]]:
    """Literals of sensitive names, and constants that reach one."""
    bound = list(pairs(text))
    names: dict[str, set[str]] = {}  # by themselves and by their last part
    for name, *_ in bound:
        names.setdefault(name, set()).add(name)
    for name in list(names):
        if "." in name:
            names.setdefault(name.rpartition(".")[2], set()).add(name)
    given: dict[str, set[str]] = {}
    literals = []
    for name, start, end, reference, quoted in bound:
        value = text[start:end]
        other = reference or ("" if quoted or not _NAME.fullmatch(value) else value)
        known = names.get(other) or names.get(other.rpartition(".")[2]) if other else None
        if known:  # a name given to a name
            given.setdefault(name, set()).update(known)
        elif not reference or (quoted and not other.isupper() and value[0] == "$" and value[1] != "{"):
            literals.append((name, start, end))
    # The most sensitive names go first, so each name is settled the first time it is met.
    reached: dict[str, float] = {}
    own = {name: sensitivity(name) for name, *_ in bound}
    for name in sorted(own, key=own.__getitem__, reverse=True):
        todo = [name]
        while todo:
            at = todo.pop()
            if at not in reached:
                reached[at] = own[name]
                todo += given.get(at, ())
    found: dict[tuple[int, int], str] = {}
    for name, start, end in literals:
        drawn = unlikeness(text[start:end])
        if drawn > 0 and reached[name] * (0.4 + 0.6 * drawn) >= LEAST_SCORE:
            found[start, end] = "name" if own[name] * (0.4 + 0.6 * drawn) >= LEAST_SCORE else found.get((start, end), "constant")
    return [(kind, *span) for span, kind in found.items()]


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` of every row: an array of ``kind, start, end`` (code points, end exclusive), by start, then kind.

    Defined cases: a null or empty text has no spans, a null id stays null, repeated rows
    each come out, an empty table gives no rows, other columns are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans = []
            for text in batch.column(1):
                text = text.as_py() or ""
                found = sorted(base_spans(text) + named_spans(text), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.selectExpr("cast(doc_id as bigint) AS doc_id", "text").mapInArrow(
        scan, "doc_id long, spans array<struct<kind:string,start:long,end:long>>"
    )
