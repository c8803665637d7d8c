"""Contextual Query Language: text to a tree, and back.

A query is a left-associative chain of clauses without precedence among the
booleans. A clause is an index, a relation with modifiers and a term; a bare
term stands for the server's choice of an index.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

BOOLEANS = {"and", "or", "not", "prox"}
_LEX = re.compile(r'\s*("(?:[^"\\]|\\.)*"|>=<|<=|>=|<>|==|[()=<>/]|[^\s()=<>/"]+)')
_COMPARE = {">=<", "=", "<", ">", "<=", ">=", "<>", "=="}


class CQLError(ValueError):
    """A query that can't be read or isn't supported; ``code`` is the diagnostic's number."""

    def __init__(self, code: int, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Modifier:
    name: str
    compare: str = ""
    value: str = ""

    def __str__(self) -> str:
        return f"/{self.name}{self.compare}{self.value}"


@dataclass(frozen=True)
class Relation:
    name: str
    modifiers: tuple[Modifier, ...] = ()

    def __str__(self) -> str:
        return self.name + "".join(map(str, self.modifiers))


@dataclass(frozen=True)
class Clause:
    index: str
    relation: Relation
    term: str

    def to_cql(self) -> str:
        quoted = self.term.replace('"', '\\"')
        return f'{self.index} {self.relation} "{quoted}"'


@dataclass(frozen=True)
class Triple:
    left: Clause | Triple
    boolean: Relation
    right: Clause | Triple

    def to_cql(self) -> str:
        return f"({self.left.to_cql()} {self.boolean} {self.right.to_cql()})"


@dataclass(frozen=True)
class SortKey:
    index: str
    modifiers: tuple[Modifier, ...] = ()


@dataclass(frozen=True)
class Query:
    tree: Clause | Triple
    sort: tuple[SortKey, ...] = ()
    prefixes: dict[str, str] = field(default_factory=dict)

    def to_cql(self) -> str:
        keys = " ".join(k.index + "".join(map(str, k.modifiers)) for k in self.sort)
        return self.tree.to_cql() + (f" sortBy {keys}" if keys else "")


class _Reader:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise CQLError(10, f"can't read {text[at:]!r}")
            self.tokens.append(m[1])
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ""

    def take(self) -> str:
        if self.at >= len(self.tokens):
            raise CQLError(10, "the query ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def query(self) -> Query:
        prefixes = {}
        while self.peek() == ">":
            self.take()
            name = self.take()
            if self.peek() == "=":
                self.take()
                prefixes[name] = _plain(self.take())
            else:
                prefixes[""] = _plain(name)
        tree = self.chain()
        keys = []
        if self.peek().lower() == "sortby":
            self.take()
            while self.peek():
                keys.append(SortKey(_plain(self.take()).lower(), self.modifiers()))
        if self.peek():
            raise CQLError(10, f"unexpected {self.peek()!r}")
        return Query(tree, tuple(keys), prefixes)

    def chain(self) -> Clause | Triple:
        left = self.single()
        while self.peek().lower() in BOOLEANS:
            boolean = Relation(self.take().lower(), self.modifiers())
            left = Triple(left, boolean, self.single())
        return left

    def single(self) -> Clause | Triple:
        if self.peek() == "(":
            self.take()
            inner = self.chain()
            if self.take() != ")":
                raise CQLError(13, "a parenthesis isn't closed")
            return inner
        first = self.take()
        if first in _COMPARE or first in ("/", ")"):
            raise CQLError(10, f"unexpected {first!r}")
        following = self.peek()
        word = following and following[0] not in '()"/' and following.lower() not in BOOLEANS | {"sortby"}
        if word:
            relation = Relation(self.take().lower(), self.modifiers())
            term = self.take()
            if term in ("(", ")", "/"):
                raise CQLError(27, "a clause has no term")
            return Clause(_plain(first).lower(), relation, _plain(term))
        return Clause("cql.serverchoice", Relation("="), _plain(first))

    def modifiers(self) -> tuple[Modifier, ...]:
        found = []
        while self.peek() == "/":
            self.take()
            name = self.take().lower()
            if self.peek() in _COMPARE:
                found.append(Modifier(name, self.take(), _plain(self.take())))
            else:
                found.append(Modifier(name))
        return tuple(found)


def _plain(token: str) -> str:
    return re.sub(r"\\(.)", lambda m: m[1] if m[1] == '"' else m[0], token[1:-1]) if token.startswith('"') else token


def parse(text: str) -> Query:
    """The tree of a query; CQLError if it isn't one."""
    return _Reader(text).query()


def to_xcql(node: Clause | Triple) -> str:
    """A tree as XML."""
    from xml.sax.saxutils import escape

    def modifiers(relation: Relation) -> str:
        if not relation.modifiers:
            return ""
        each = "".join(f"<modifier><type>{escape(m.name)}</type>" + (f"<comparison>{escape(m.compare)}</comparison><value>{escape(m.value)}</value>" if m.compare else "") + "</modifier>" for m in relation.modifiers)
        return f"<modifiers>{each}</modifiers>"

    if isinstance(node, Triple):
        boolean = f"<boolean><value>{node.boolean.name}</value>{modifiers(node.boolean)}</boolean>"
        return f"<triple>{boolean}<leftOperand>{to_xcql(node.left)}</leftOperand><rightOperand>{to_xcql(node.right)}</rightOperand></triple>"
    relation = f"<relation><value>{escape(node.relation.name)}</value>{modifiers(node.relation)}</relation>"
    return f"<searchClause><index>{escape(node.index)}</index>{relation}<term>{escape(node.term)}</term></searchClause>"


def result_set_id(node: Clause | Triple) -> str:
    """The saved set that a query is nothing but, or empty."""
    return node.term if isinstance(node, Clause) and node.index == "cql.resultsetid" else ""


def from_form(form: dict[str, str]) -> str:
    """A query out of numbered form fields: fieldcont (words, and phrases in quotes), fieldidx (indexes, || between), fieldrel and fieldbool."""
    out: list[str] = []
    n = 1
    while f"fieldcont{n}" in form:
        words, indexes = form[f"fieldcont{n}"], form.get(f"fieldidx{n}", "cql.anywhere").split("||")
        relation = form.get(f"fieldrel{n}", "all/relevant/proxinfo")
        whole = any(x in relation for x in ("exact", "=", "/string"))
        join = " and/relevant/proxinfo " if relation.startswith("all") else " or/relevant/proxinfo "
        found = [] if whole else re.findall(r'"[^"]+"', words)
        rest = words.replace('"', '\\"') if whole else re.sub(r'"[^"]+"', "", words)
        each = []
        for index in indexes:
            parts = [f"({index} =/relevant/proxinfo {phrase})" for phrase in found]
            if rest.strip():
                parts.append(f'{index} {relation} "{rest.strip()}"')
            if parts:
                each.append(f"({join.join(parts)})")
        if n > 1:
            out.append(form.get(f"fieldbool{n - 1}", "and/relevant/proxinfo"))
        out.append(f"({' or/rel.combine=sum/proxinfo '.join(each)})")
        n += 1
    return " ".join(out)


_USES = {1: "dc.creator", 4: "dc.title", 7: "bath.isbn", 8: "bath.issn", 12: "rec.identifier", 21: "dc.subject", 31: "dc.date", 1003: "dc.creator", 1016: "cql.anywhere", 1018: "dc.publisher"}
_RELATIONS = {1: "<", 2: "<=", 3: "=", 4: ">=", 5: ">", 100: "=/phonetic", 101: "=/stem", 102: "=/relevant"}


def from_attributes(attributes: dict[int, int]) -> tuple[str, str]:
    """The index and relation that bib-1 attributes (type: value) stand for: use 1, relation 2, structure 4, truncation 5."""
    if attributes.get(1) not in _USES:
        raise CQLError(16, f"no index for the use attribute {attributes.get(1)}")
    relation = _RELATIONS.get(attributes.get(2, 3), "=")
    structure = attributes.get(4)
    if relation == "=" and structure in (2, 6, 105, 106):
        relation = {2: "all", 6: "all", 105: "all", 106: "any"}[structure]
    elif relation == "=" and structure in (3, 108):
        relation = "exact"
    return _USES[attributes[1]], relation
