"""Search: a query in the query language becomes one filter and one weight.

Where the words of a clause are found is up to an *access*. :class:`Scan` looks
at rows that carry their text, so that a query of any depth is a single scan.
:class:`Stored` looks terms up in the stored index of
:mod:`textloom.operators.stored`: the postings of all the query's terms are
read with the terms as pushed filters, and one aggregation by document gives
every clause its counts and places. Both give the same rows and weights.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.cql.parser import Clause, CQLError, Modifier, Query, SortKey, Triple, parse
from textloom.functions import analysis as A

TOKENS = "tokens__"
_RELEVANCE = re.compile(r"^(rel\.|relevant$|cql\.relevant$)")
_PROXIMITY = {"distance", "unit", "ordered", "unordered"}
#: Asks for the places of hits beside them, which changes no row.
_IGNORED = {"proxinfo", "cql.proxinfo"}
_DISTANCES = {"=": lambda a, d: a == d, "<=": lambda a, d: a <= d, "<": lambda a, d: a < d, ">": lambda a, d: a > d, ">=": lambda a, d: a >= d, "<>": lambda a, d: a != d}


@dataclass
class Index:
    """How an index sees a row.

    ``kind``: words (tokens of text), exact (a column's value), number, or
    range (from ``column`` to ``high``). ``proximity``: whether ``=`` asks for a
    phrase. ``stem``: whether words are stemmed. ``variants``: the index that a
    relation modifier such as ``stem`` stands for.
    """

    column: str
    kind: str = "words"
    proximity: bool = True
    high: str = ""
    stem: bool = False
    variants: dict[str, str] = field(default_factory=dict)
    constants: tuple[float, ...] = ()


def tokens_of(index: Index) -> Column:
    """The tokens that a words index has of a row; never null."""
    tokens = F.coalesce(A.words(index.column), F.array().cast("array<string>"))
    if index.stem:
        from textloom.functions.stem import stemmed

        return stemmed(tokens)
    return tokens


# masks


def first_mask(term: str, start: int = 0) -> int:
    """Where the first mask from ``start`` on stands, or -1."""
    m = re.compile(r"(?<!\\)[*?^]").search(term, start)
    return m.start() if m else -1


def is_masked(term: str) -> bool:
    return first_mask(term) >= 0


def mask_pattern(term: str) -> str:
    """The regular expression of a masked term: * any run, ? one character, ^ an end; a backslash takes the next as it is."""
    out, escaped = [], False
    for c in term:
        if escaped:
            out.append(re.escape(c))
            escaped = False
        elif c == "\\":
            escaped = True
        elif c in "*?^":
            out.append({"*": ".*", "?": ".", "^": ""}[c])
        else:
            out.append(re.escape(c))
    return "^" + "".join(out) + "$"


def mask_test(column: Column, term: str) -> Column:
    """Whether a column fits a masked term; its literal beginning is a test of its own, which a scan can push down."""
    head = term[: first_mask(term)].replace("\\", "")
    test = column.rlike(mask_pattern(term))
    return column.startswith(head) & test if head else test


# proximity


def phrase_match(places: list[Column]) -> Column:
    """Whether the terms stand one after the other; places: of each term where it stands."""
    if len(places) == 1:
        return F.size(places[0]) > 0

    def moved_back(places: Column, by: int) -> Column:
        return F.transform(places, lambda x: x - by)

    moved = [moved_back(p, k) for k, p in enumerate(places)]
    both = moved[0]
    for other in moved[1:-1]:
        both = F.array_intersect(both, other)
    return F.coalesce(F.arrays_overlap(both, moved[-1]), F.lit(False))


def near_match(places: list[Column], distance: int, compare: str, ordered: bool) -> Column:
    """Whether there are places of all terms of which every two satisfy the distance; ordered: in the order of the terms."""
    test = _DISTANCES[compare]

    def more(p: Column, k: int, before: list[Column]) -> Column:
        if k == len(places):
            return F.lit(True)

        def at(j: Column) -> Column:
            ok = F.lit(True)
            for i in before:
                ok = ok & test((j - i) if ordered else F.abs(j - i), distance) & ((j > i) if ordered else (j != i))
            return ok & more(p, k + 1, [*before, j])

        return F.exists(p[f"p{k}"], at)

    return F.coalesce(A.let(F.struct(*(p.alias(f"p{k}") for k, p in enumerate(places))), lambda p: more(p, 0, [])), F.lit(False))


# weights


def tfidf(tf: Column, df: Column, n: Column, **_) -> Column:
    return tf * F.log(n / df)


def cori(tf: Column, df: Column, n: Column, length: Column, mean: Column, a: float = 50, b: float = 150, base: float = 0.4, **_) -> Column:
    t = tf / (tf + a + b * length / mean)
    i = F.log((n + 0.5) / df) / F.log(n + 1)
    return F.lit(base) + F.lit(1 - base) * t * i


def bm25(tf: Column, df: Column, n: Column, length: Column, mean: Column, qtf: int = 1, b: float = 0.75, k1: float = 1.5, k3: float = 1.5, **_) -> Column:
    return F.log(n / df) * ((k1 + 1) * tf) / (k1 * ((1 - b) + b * length / mean) + tf) * ((k3 + 1) * qtf) / (k3 + qtf)


WEIGHTS = {"tfidf": tfidf, "cori": cori, "okapi": bm25, "bm25": bm25}
_CONSTANTS = {"okapi": ("b", "k1", "k3"), "bm25": ("b", "k1", "k3"), "cori": ("a", "b", "base")}
#: Named in the older query syntax, without a formula anywhere.
_UNDEFINED = {"trec2", "trec3", "lucene"}


def lr_weight(tfs: list[Column], dfs: list[Column], n: Column, length: Column, n_query: int) -> Column:
    """Logistic regression over the whole clause: log odds of relevance from mean logs of frequencies, as a probability."""
    c = (-3.7, 1.269, -0.31, 0.679, -0.021, 0.223, 4.01)
    hit = [(tf > 0).cast("int") for tf in tfs]
    m = sum(hit[1:], hit[0])
    mean = lambda values: sum(values[1:], values[0]) / m
    qaf = mean([F.when(h > 0, F.log(F.lit(1.0))).otherwise(0.0) for h in hit])
    daf = mean([F.when(h > 0, F.log(tf)).otherwise(0.0) for h, tf in zip(hit, tfs)])
    idf = mean([F.when(h > 0, F.log(n / df)).otherwise(0.0) for h, df in zip(hit, dfs)])
    odds = F.lit(c[0]) + c[1] * qaf + c[2] * F.sqrt(F.lit(float(n_query))) + c[3] * daf + c[4] * F.sqrt(length) + c[5] * idf + c[6] * F.log(m)
    return 1 / (1 + F.exp(-odds))


def combine_weights(mode: str, weights: list[Column], matched: list[Column], some: list[Column] | None = None) -> Column:
    """Weights of operands that match, over all operands: their sum, or that by the number of operands, or by the number of matches; cmbz: the sum times the matches.

    some: whether each of two operands has any row; a union in which one has none leaves the other's weight as it is.
    """
    total = sum(weights[1:], weights[0])
    if mode == "sum":
        return total
    if mode == "mean":
        if some is None:
            return total / len(weights)
        return total / F.when(some[0] & some[1], 2).otherwise(1)
    hits = sum((m.cast("int") for m in matched[1:]), matched[0].cast("int"))
    if mode == "norm":
        return total / hits
    if mode == "cmbz":
        return total * hits
    raise CQLError(21, f"no way to combine called {mode}")


# access


class Scan:
    """Clauses over rows that carry their text; :meth:`rows` adds the tokens that they need."""

    def __init__(self, docs: DataFrame, key: str):
        self.docs, self.key, self.indexes = docs, key, {}
        self.sets: list[tuple[str, DataFrame]] = []

    def _tokens(self, name: str, index: Index) -> Column:
        self.indexes[name] = index
        return F.col(f"`{TOKENS}{name}`")

    def count(self, name: str, index: Index, term: str) -> Column:
        test = (lambda x: mask_test(x, term)) if is_masked(term) else (lambda x: x == term)
        return F.size(F.filter(self._tokens(name, index), test))

    def places(self, name: str, index: Index, term: str) -> Column:
        test = (lambda x: mask_test(x, term)) if is_masked(term) else (lambda x: x == term)
        return F.filter(F.transform(self._tokens(name, index), lambda x, i: F.when(test(x), i)), lambda x: x.isNotNull())

    def length(self, name: str, index: Index) -> Column:
        return F.size(self._tokens(name, index))

    def holds(self, name: str, index: Index, test: Callable[[Column], Column]) -> Column:
        return F.exists(self._tokens(name, index), test)

    def value(self, name: str, index: Index, test: Callable[[Column, Column], Column]) -> Column:
        """A test of a row's value, or of both ends of its range."""
        return test(F.col(f"`{index.column}`"), F.col(f"`{index.high or index.column}`"))

    def whole(self, name: str, index: Index, text: str) -> Column:
        return F.lower(F.col(f"`{index.column}`")) == text.lower()

    def member(self, found: DataFrame) -> Column:
        flag = f"set__{len(self.sets)}"
        self.sets.append((flag, found.select(F.col(self.key)).distinct()))
        return F.coalesce(F.col(flag), F.lit(False))

    def collection(self, name: str, index: Index) -> dict[str, Column]:
        return {"n_docs": F.count("*"), f"n_words {name}": F.sum(self.length(name, index).cast("bigint"))}

    def rows(self) -> DataFrame:
        docs = self.docs
        for flag, found in self.sets:
            docs = docs.join(found.withColumn(flag, F.lit(True)), self.key, "left")
        return docs.select("*", *(tokens_of(x).alias(TOKENS + n) for n, x in sorted(self.indexes.items())))

    def constants(self) -> dict[str, int]:
        return {}

    def sort_values(self, name: str, index: Index, low: bool) -> DataFrame:
        if index.kind == "words":
            value = (F.array_min if low else F.array_max)(tokens_of(index))
        else:
            value = F.col(f"`{index.column if low else index.high or index.column}`")
        return self.docs.select(self.key, value.alias("value__"))


# compiling


@dataclass
class Compiled:
    """match: never null; weight: if ranked; index and terms: of a clause of words."""

    match: Column
    weight: Column | None = None
    index: str = ""
    terms: list[str] = field(default_factory=list)


def _option(modifiers: tuple[Modifier, ...], *names: str, default: str = "") -> str:
    return next((m.value for m in modifiers if m.name in names), default)


def _number(text: str, kind: type, code: int = 36):
    try:
        return kind(text)
    except ValueError:
        raise CQLError(code, f"{text!r} is no number") from None


def _nearness(mods: tuple[Modifier, ...], default: tuple[str, int]) -> tuple[str, int, bool, str]:
    """(compare, distance, ordered, unit) of proximity modifiers. Without any modifier the order counts."""
    unit = _option(mods, "unit", default="word")
    if unit not in ("word", "element"):
        raise CQLError(42, f"no proximity by {unit}")
    given = next((m for m in mods if m.name == "distance"), None)
    compare, distance = (given.compare, _number(given.value, int, 41)) if given else default
    if compare not in _DISTANCES:
        raise CQLError(40, f"no distance by {compare}")
    if unit == "element" and (compare, distance) != ("=", 0):
        raise CQLError(41, "elements are the same or not")
    return compare, distance, not mods or any(m.name == "ordered" for m in mods), unit


class Compiler:
    def __init__(self, access, indexes: dict[str, Index], default: str, sets=None):
        self.access, self.indexes, self.default, self.sets = access, indexes, default, sets
        self.wanted: dict[str, Column] = {}

    def stat(self, key: str, value: Column) -> Column:
        """An aggregate over all rows that a weight refers to by name."""
        self.wanted.setdefault(key, value)
        return F.col(f"`{key}`")

    def compile(self, node: Clause | Triple) -> Compiled:
        return self.triple(node) if isinstance(node, Triple) else self.clause(node)

    def triple(self, node: Triple) -> Compiled:
        name, mods = node.boolean.name, node.boolean.modifiers
        for m in mods:
            if not (_RELEVANCE.match(m.name) or m.name in _IGNORED or (name == "prox" and m.name in _PROXIMITY)):
                raise CQLError(46, f"boolean modifier {m.name}")
        left, right = self.compile(node.left), self.compile(node.right)
        if name == "prox":
            if not (left.terms and right.terms) or left.index != right.index:
                raise CQLError(39, "proximity joins two clauses of one index of words")
            near = tuple(m for m in mods if m.name in _PROXIMITY)
            compare, distance, ordered, unit = _nearness(near, ("=", 1))
            places = [self.access.places(left.index, self.indexes[left.index], t) for t in [*left.terms, *right.terms]]
            match = left.match & right.match if unit == "element" else near_match(places, distance, compare, ordered)
        else:
            match = {"and": left.match & right.match, "or": left.match | right.match, "not": left.match & ~right.match}[name]
        weight = None
        if left.weight is not None or right.weight is not None or any(_RELEVANCE.match(m.name) for m in mods):
            parts = [F.when(x.match, x.weight if x.weight is not None else F.lit(0.5)).otherwise(0.0) for x in (left, right)]
            some = None
            if name == "not":
                parts[1] = F.lit(0.0)
            elif name == "or":
                k = len(self.wanted)
                some = [self.stat(f"some {k} {i}", F.coalesce(F.bool_or(x.match), F.lit(False))) for i, x in enumerate((left, right))]
            weight = combine_weights(_option(mods, "rel.combine", default="mean"), parts, [left.match, right.match], some)
        return Compiled(match, weight, left.index, [*left.terms, *right.terms])

    def resolve(self, name: str, mods: tuple[Modifier, ...]) -> str:
        """The index that a name stands for: served directly, by default, or as the variant that a relation modifier asks for."""
        direct = name.startswith("c3.")
        name = name.removeprefix("c3.")
        name = self.default if name in ("cql.serverchoice", "cql.anywhere") else name
        if name not in self.indexes:
            raise CQLError(16, f"no index called {name}")
        if direct:
            return name
        others = [m.name.removeprefix("cql.") for m in mods if not _RELEVANCE.match(m.name) and m.name not in _PROXIMITY | _IGNORED]
        variants = self.indexes[name].variants
        if any(_RELEVANCE.match(m.name) for m in mods) and "relevant" in variants:
            name = variants["relevant"]
        for m in sorted(others, key=lambda m: m != "stem"):
            if m not in variants:
                raise CQLError(20, f"relation modifier {m} on index {name}")
            return variants[m]
        return name

    def clause(self, node: Clause) -> Compiled:
        relation, mods = node.relation.name.removeprefix("cql."), node.relation.modifiers
        if node.index == "cql.resultsetid":
            if self.sets is None:
                raise CQLError(50, "no store of result sets")
            return Compiled(self.access.member(self.sets.fetch(node.term)))
        name = self.resolve(node.index, mods)
        index = self.indexes[name]
        if index.kind != "words":
            return Compiled(self.value(name, index, relation, node.term))
        # masked terms keep their masks
        given = re.findall(r"\S+", node.term.lower()) if is_masked(node.term) else re.findall(r"[^\W_]+", node.term.lower())
        if index.stem:
            from textloom.functions.stem import stem

            given = [t if is_masked(t) else stem(t) for t in given]
        if relation == "exact" and not is_masked(node.term):
            return Compiled(F.coalesce(self.access.whole(name, index, node.term), F.lit(False)), None, name, given)
        if relation in ("<", "<=", ">", ">="):
            if len(given) != 1:
                raise CQLError(24, "a comparison takes one term")
            return Compiled(self.access.holds(name, index, lambda x: _DISTANCES[relation](x, given[0])), None, name, given)
        if relation == "within":
            if len(given) != 2:
                raise CQLError(24, "within takes two terms")
            return Compiled(self.access.holds(name, index, lambda x: (x > given[0]) & (x < given[1])), None, name, given)
        if relation not in ("any", "all", "=", "exact", "window"):
            raise CQLError(24, f"relation {relation}")
        if not given:
            return Compiled(F.lit(False))
        distinct = list(dict.fromkeys(given))
        counts = {t: self.access.count(name, index, t) for t in distinct}
        hits = [counts[t] > 0 for t in distinct]
        match = hits[0]
        for h in hits[1:]:
            match = (match | h) if relation in ("any", "exact") else (match & h)
        if relation == "=" and index.proximity and len(given) > 1:
            match = match & phrase_match([self.access.places(name, index, t) for t in given])
        if relation == "window":
            compare, distance, ordered, _ = _nearness(tuple(m for m in mods if m.name in _PROXIMITY) or (Modifier("distance", "<=", str(len(given))),), ("=", 1))
            match = match & near_match([self.access.places(name, index, t) for t in given], distance, compare, ordered)
        weight = None
        if any(_RELEVANCE.match(m.name) for m in mods):
            weight = self.weight(name, index, relation, given, counts, mods)
        return Compiled(match, weight, name, given)

    def value(self, name: str, index: Index, relation: str, term: str) -> Column:
        return F.coalesce(self.access.value(name, index, value_test(index, relation, term)), F.lit(False)) if index.kind == "range" else self.access.value(name, index, value_test(index, relation, term))

    def weight(self, name: str, index: Index, relation: str, given: list[str], counts: dict[str, Column], mods: tuple[Modifier, ...]) -> Column:
        algorithm = _option(mods, "rel.algorithm", default="cori")
        distinct = list(counts)
        hits = [counts[t] > 0 for t in distinct]
        length = self.access.length(name, index)
        whole = self.access.collection(name, index)
        n, total = (self.stat(k, v) for k, v in whole.items())
        mean = F.floor(total / n)
        dfs = [self.stat(f"df {name} {t}", F.sum(h.cast("bigint"))) for t, h in zip(distinct, hits)]
        if algorithm in _UNDEFINED:
            raise NotImplementedError(f"weights by {algorithm}")
        if algorithm == "lr":
            return lr_weight(list(counts.values()), dfs, n, length, len(given))
        if algorithm not in WEIGHTS:
            raise CQLError(21, f"no algorithm called {algorithm}")
        names = _CONSTANTS.get(algorithm, ())
        # defaults give way to the index's own constants, and these to the query's
        options = dict(zip(names, index.constants)) if algorithm in ("okapi", "bm25") else {}
        options |= {k: _number(v, float) for i, k in enumerate(names) if (v := _option(mods, f"rel.const{i}"))}
        parts = []
        for t, df, hit in zip(distinct, dfs, hits):
            own = WEIGHTS[algorithm](counts[t], df, n, length=length, mean=mean, qtf=given.count(t), **options)
            parts.append(F.when(hit, own).otherwise(0.0))
        some = [df > 0 for df in dfs] if len(distinct) == 2 and relation in ("any", "exact") else None
        return combine_weights(_option(mods, "rel.combine", default="mean"), parts, hits, some)


def value_test(index: Index, relation: str, term: str) -> Callable[[Column, Column], Column]:
    """The test of a row's value (both arguments), or of the ends of its range, that a relation and a term stand for."""
    if index.kind == "range":
        ends = re.split(r"[\s/]+", term.strip())
        if len(ends) != 2:
            raise CQLError(24, "a range has two ends")
        low, high = ends
        tests = {
            "encloses": lambda s, e: (s < low) & (e > high),
            "within": lambda s, e: (s > low) & (e < high),
            "overlaps": lambda s, e: (s < high) & (e >= low),
            ">=<": lambda s, e: (s < high) & (e >= low),
            "<": lambda s, e: (s < low) & (e < high),
            "<=": lambda s, e: (s < low) & (e <= high),
            ">": lambda s, e: s >= high,
            ">=": lambda s, e: s >= high,
        }
        if relation not in tests:
            raise CQLError(24, f"relation {relation}")
        return tests[relation]
    if relation == "within":
        ends = term.split()
        if len(ends) != 2:
            raise CQLError(24, "within takes two terms")
        low, high = (_number(x, float) for x in ends) if index.kind == "number" else ends
        return lambda v, _: (v > low) & (v < high)
    wanted = _number(term, float) if index.kind == "number" else term
    if relation in ("=", "exact", "==", "all", "any"):
        if index.kind == "exact" and is_masked(term):
            return lambda v, _: mask_test(v, term)
        return lambda v, _: v == wanted
    if relation in _DISTANCES:
        return lambda v, _: _DISTANCES[relation](v, wanted)
    raise CQLError(24, f"relation {relation}")


def run(access, tree: Clause | Triple, indexes: dict[str, Index], default: str, key: str, sets=None) -> DataFrame:
    """(key, and weight if the query is ranked): the rows of an access that satisfy a tree."""
    compiler = Compiler(access, indexes, default, sets)
    found = compiler.compile(tree)
    rows = access.rows()
    if found.weight is None:
        return rows.where(found.match).select(key)
    known = access.constants()
    asked = {k: c for k, c in compiler.wanted.items() if k not in known}
    for k in compiler.wanted.keys() & known.keys():
        rows = rows.withColumn(k, F.lit(known[k]))
    if asked:
        rows = rows.crossJoin(F.broadcast(rows.agg(*(c.alias(k) for k, c in asked.items()))))  # one row
    return rows.where(found.match).select(key, found.weight.alias("weight"))


def search(docs: DataFrame, query: str | Query, indexes: dict[str, Index], default: str, key: str = "doc_id", sets=None) -> DataFrame:
    """(key, and weight if the query is ranked): the rows that satisfy a query, in the order that it asks for.

    Columns of docs are reached by their names in the indexes only; those that
    end in two underscores may be in the way of ours and are left out.
    """
    query = parse(query) if isinstance(query, str) else query
    used = {c for x in indexes.values() for c in (x.column, x.high) if c} | {key}
    access = Scan(docs.select(*(f"`{c}`" for c in docs.columns if c in used)), key)
    found = run(access, query.tree, indexes, default, key, sets)
    return sorted_by(found, query, access, indexes, default, key)


def sorted_by(found: DataFrame, query: Query, access, indexes: dict[str, Index], default: str, key: str) -> DataFrame:
    """found in the order of the query's sort keys; ranked rows stay as they are."""
    if not query.sort or "weight" in found.columns:
        return found
    order: list[Column] = []
    for k, sort in enumerate(query.sort):
        column, by = sort_order(sort, k)
        name = Compiler(access, indexes, default).resolve(sort.index, ())
        values = access.sort_values(name, indexes[name], column["ascending"]).withColumnRenamed("value__", f"sort__{k}")
        found = found.join(values, key, "left")
        found, by = _missing(found, column, k)
        order += by
    return found.orderBy(*order, F.asc(key)).drop(*(f"sort__{k}" for k in range(len(query.sort))))


_SORTS = {"ascending", "descending", "missingomit", "missinglow", "missinghigh", "missingfail", "missingvalue", "respectcase", "ignorecase", "respectaccents", "ignoreaccents", "unicodecollate", "locale"}


def sort_order(sort: SortKey, k: int) -> tuple[dict, list]:
    """What a sort key's modifiers ask for; without any: ascending, those without a value last in either direction."""
    names = {m.name.removeprefix("sort."): m.value for m in sort.modifiers}
    for name in names:
        if name not in _SORTS or name in ("unicodecollate", "locale"):
            raise CQLError(84, f"sort modifier {name}")
    return {
        "ascending": "descending" not in names,
        "missing": next((x for x in ("omit", "low", "high", "fail", "value") if f"missing{x}" in names), "last"),
        "value": names.get("missingvalue", ""),
        "fold": "ignorecase" in names,
        "plain": "ignoreaccents" in names,
    }, []


def _missing(found: DataFrame, asked: dict, k: int) -> tuple[DataFrame, list[Column]]:
    name = f"sort__{k}"
    column = F.col(name)
    if dict(found.dtypes)[name] == "string":
        column = F.lower(column) if asked["fold"] else column
        column = A.without_accents(column) if asked["plain"] else column
    missing, up = asked["missing"], asked["ascending"]
    if missing == "omit":
        found = found.where(F.col(name).isNotNull())
    elif missing == "fail":
        column = F.when(F.col(name).isNull(), F.raise_error(F.lit("93: a record has no value to sort by"))).otherwise(column)
    elif missing == "value":
        column = F.coalesce(column, F.lit(asked["value"]).cast(dict(found.dtypes)[name]))
    first = missing == ("low" if up else "high")
    if up:
        return found, [column.asc_nulls_first() if first else column.asc_nulls_last()]
    return found, [column.desc_nulls_first() if first else column.desc_nulls_last()]


def scaled(hits: DataFrame, weight: str = "weight") -> DataFrame:
    """hits with scaled_weight: weights stretched to 0..1; all 1 if they are equal."""
    ends = hits.agg(F.min(weight).alias("low__"), F.max(weight).alias("high__"))
    share = F.when(F.col("high__") > F.col("low__"), (F.col(weight) - F.col("low__")) / (F.col("high__") - F.col("low__"))).otherwise(1.0)
    return hits.crossJoin(F.broadcast(ends)).withColumn("scaled_weight", share).drop("low__", "high__")


def ranked(hits: DataFrame, top: int, key: str = "doc_id", digits: int = 6) -> DataFrame:
    """The top rows by weight, of equal ones the higher key first; a top-k, never a full sort."""
    return hits.withColumn("weight", F.round("weight", digits)).orderBy(F.desc("weight"), F.desc(key)).limit(top)
