"""Queries on the driver: modes, plain and boolean expressions as syntax trees, and query plans of terms and phrases."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from sylvan.functions.text import FOLD_FROM, FOLD_TO, STOP_WORDS, word_pattern

COLUMNS = ("title", "summary", "body", "code_blocks", "front_matter")
_FOLD = str.maketrans(FOLD_FROM, FOLD_TO)


@dataclass(frozen=True)
class Leaf:
    """``term``, ``prefix``, ``phrase``, or a term that counts only ``near`` others; within ``column`` if given."""

    kind: str
    terms: tuple[str, ...]
    column: str | None = None
    others: tuple[str, ...] = ()
    distance: int = 0


@dataclass(frozen=True)
class Node:
    op: str  # and, or, not
    parts: tuple


@dataclass(frozen=True)
class Mode:
    kind: str  # plain, prefix, regex, expression
    query: str
    expression: Node | Leaf | None = None
    regex: str | None = None


_IDEOGRAPHS = re.compile("[\u4e00-\u9fff\u3400-\u4dbf]+")


def words(text: str, mode: str = "bigram", dictionary: tuple[str, ...] = ()) -> list[str]:
    """Index tokens of a query text, ideographs cut as the index cuts them."""
    out = []
    for w in re.split(r"[^\w]+|_", text.lower().translate(_FOLD)):
        at = 0
        for run in _IDEOGRAPHS.finditer(w):
            out += [w[at : run.start()]]
            at, x = run.end(), run[0]
            if mode == "word":
                out += re.findall(word_pattern(dictionary), x)
            else:
                size = 2 if mode == "bigram" else 1
                out += [x[i : i + size] for i in range(max(len(x) - size + 1, 1))]
        out.append(w[at:])
    return [w for w in out if w]


@dataclass(frozen=True)
class Cut:
    """How ideographs are cut to words."""

    mode: str = "bigram"
    dictionary: tuple[str, ...] = ()


def _leaf(text: str, column: str | None, prefix: bool = False, cut: Cut = Cut(), quoted: bool = True, op: str = "and") -> Node | Leaf | None:
    """Words of one query word are a phrase. Ideographs outside quotes are words of their own, joined by ``op``."""
    found = words(text, cut.mode, cut.dictionary)
    if not found:
        return None
    if prefix:
        last = Leaf("prefix", (found[-1],), column)
        return last if len(found) == 1 else Node("and", (Leaf("phrase", tuple(found[:-1]), column), last))
    if len(found) > 1 and not quoted and _IDEOGRAPHS.search(text):
        parts = tuple(Leaf("term", (w,), column) for w in dict.fromkeys(found))
        return parts[0] if len(parts) == 1 else Node(op, parts)
    return Leaf("term" if len(found) == 1 else "phrase", tuple(found), column)


_TOKEN = re.compile(r'\s*(?:(NEAR)\s*\(|("(?:[^"]|"")*")(\*)?|([():])|([\w\-.\'@/+#]+)(\*)?)', re.IGNORECASE | re.UNICODE)


def parse(expression: str, cut: Cut = Cut()) -> Node | Leaf:
    """Boolean expression: ``AND OR NOT`` (any case), adjacent terms mean AND, ``"phrases"``, ``prefix*``,
    ``column : term`` or ``column : (...)``, ``NEAR(a b, n)``. Raises ``ValueError`` where it can't be read."""
    tokens, at = [], 0
    text = expression.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            if text[at] == ",":
                tokens.append((",", ","))
                at += 1
                continue
            if text[at].isspace():
                at += 1
                continue
            raise ValueError(f"cannot read {text[at:at + 20]!r} in the expression")
        if m[1]:
            tokens.append(("near", "NEAR"))
        elif m[2]:
            tokens.append(("prefix" if m[3] else "string", m[2][1:-1].replace('""', '"')))
        elif m[4]:
            tokens.append((m[4], m[4]))
        else:
            word = m[5]
            if word.upper() in ("AND", "OR", "NOT") and not m[6]:
                tokens.append((word.upper(), word))
            elif re.match(r"(?i)near/\d+$", word):
                raise ValueError("write NEAR(a b, n) for proximity")
            else:
                tokens.append(("prefix" if m[6] else "word", word))
        at = m.end()
        while at < len(text) and text[at].isspace():
            at += 1
        if at < len(text) and text[at] == ",":
            tokens.append((",", ","))
            at += 1
    place = 0

    def peek() -> str:
        return tokens[place][0] if place < len(tokens) else ""

    def take(kind: str = "") -> str:
        nonlocal place
        if place >= len(tokens) or kind and tokens[place][0] != kind:
            raise ValueError(f"expected {kind or 'a term'} in the expression {expression!r}")
        place += 1
        return tokens[place - 1][1]

    def joined(op: str, parts: list):
        parts = [p for p in parts if p is not None]
        return None if not parts else parts[0] if len(parts) == 1 else Node(op, tuple(parts))

    def any_of(column):
        parts = [all_of(column)]
        while peek() == "OR":
            take()
            parts.append(all_of(column))
        return joined("or", parts)

    def all_of(column):
        parts = [without(column)]
        while peek() == "AND":
            take()
            parts.append(without(column))
        return joined("and", parts)

    def without(column):
        left = run(column)
        while peek() == "NOT":
            take()
            right = run(column)
            left = Node("not", (left, right)) if left is not None and right is not None else left
        return left

    def run(column):
        parts = [primary(column)]
        while peek() in ("word", "string", "prefix", "(", "near"):
            parts.append(primary(column))
        return joined("and", parts)

    def primary(column):
        kind = peek()
        if kind == "(":
            take()
            inner = any_of(column)
            take(")")
            return inner
        if kind == "near":
            take()
            terms = []
            while peek() in ("word", "string"):
                terms += words(take(), cut.mode, cut.dictionary)
            distance = 10
            if peek() == ",":
                take()
                distance = int(take("word"))
            take(")")
            if len(terms) < 2:
                return _leaf(" ".join(terms), column, cut=cut)
            return Node("and", tuple(Leaf("near", (t,), column, tuple(x for j, x in enumerate(terms) if j != i), distance) for i, t in enumerate(terms)))
        if kind in ("word", "string", "prefix"):
            value = take()
            if kind == "word" and peek() == ":":
                take()
                if value.lower() not in COLUMNS:
                    raise ValueError(f"no such column: {value}")
                return primary(value.lower())
            return _leaf(value, column, kind == "prefix", cut, quoted=kind == "string")
        raise ValueError(f"the expression {expression!r} ends or breaks off at {kind or 'its end'}")

    tree = any_of(None)
    if place < len(tokens):
        raise ValueError(f"cannot read {tokens[place][1]!r} in the expression")
    if tree is None:
        raise ValueError("the expression has no term")
    return tree


def plain(query: str, cut: Cut = Cut()) -> Node | Leaf | None:
    """Any of the words; each is squeezed to its word characters first, operators are left out."""
    found = []
    for word in query.split():
        word = re.sub(r"[^\w]", "", word)
        if word and word.upper() not in ("AND", "OR", "NOT", "NEAR") and (leaf := _leaf(word, None, cut=cut, quoted=False, op="or")) is not None:
            found += [p for p in (leaf.parts if isinstance(leaf, Node) else (leaf,)) if p not in found]
    return None if not found else found[0] if len(found) == 1 else Node("or", tuple(found))


def build_expression(keywords: list[str], operator: str = "OR", column: str | None = None, near_distance: int | None = None, prefix: bool = False) -> str:
    """An expression of keywords; those with spaces are phrases."""
    parts = [f'"{k}"' if re.search(r"\W", k) else f"{k}*" if prefix else k for k in (k.strip() for k in keywords) if k]
    if not parts:
        return ""
    inner = f"NEAR({' '.join(parts)}, {near_distance})" if near_distance is not None and len(parts) > 1 else f" {operator.upper()} ".join(parts)
    return f"{column} : ({inner})" if column else inner


def classify(query: str, expression: str | None = None, regex: bool = False, cut: Cut = Cut()) -> Mode:
    """``word*`` is a prefix, ``*word*`` and ``regex=True`` search by pattern, a given expression wins over both."""
    if regex and expression:
        raise ValueError("give an expression or a regex, not both")
    if expression:
        return Mode("expression", query, parse(expression, cut))
    if regex:
        try:
            re.compile(query)
        except re.error as broken:
            raise ValueError(f"broken pattern: {broken}") from broken
        return Mode("regex", query, regex=query)
    if re.fullmatch(r"[^*\s]+\*", query):
        return Mode("prefix", query, _leaf(query[:-1], None, True, cut))
    if re.fullmatch(r"\*[^*\s]+\*", query):
        return Mode("regex", query, regex=re.escape(query[1:-1]))
    return Mode("plain", query, plain(query, cut))


@dataclass(frozen=True)
class QueryPlan:
    raw: str
    terms: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    is_code: bool = False
    is_structural: bool = False


def query_plan(query: str) -> QueryPlan:
    """Terms without stop words, quoted phrases (or the whole as one), and what the query seems to be after."""
    phrases = [p.strip() for p in re.findall(r'"([^"]+)"', query)]
    raw = [w for w in re.split(r"\W+", re.sub(r'"[^"]+"', "", query).lower()) if len(w) > 1 or re.match("[一-鿿㐀-䶿]", w)]
    terms = list(dict.fromkeys(w for w in raw if w not in STOP_WORDS)) or raw
    if not phrases and len(raw) >= 2:
        phrases = [" ".join(raw)]
    code = re.search(r"(?i)\b(api|class|def|endpoint|error|exception|func|function|import|method|module|param|return)\b", query)
    place = re.search(r"(?i)\b(appendix|chapter|part|section|toc|table of contents|q\d+|v\d+\.\d+)\b|第[一二三四五六七八九十\d]+[章节篇部]", query)
    return QueryPlan(query, terms, phrases, bool(code), bool(place))
