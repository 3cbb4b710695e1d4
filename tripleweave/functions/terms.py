"""Terms as text: namespaces, literals, numbers.

A node is bare text (``wsdbm__User0`` or a full IRI), a literal keeps its quotes, its
language tag and its datatype (``"x"``, ``"x"@en``, ``"5"^^<...>``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

LITERAL = r'(?s)^"(.*)"(?:@[A-Za-z0-9-]+|\^\^.+)?$'
LANG_TAG = r'"@([A-Za-z0-9-]+)$'
# Namespaces that are compared one by one, longest first; more are found by one pattern.
COMPARED = 16
NUMBER = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"


def _alternatives(words: list[str]) -> str:
    """One regex for many words, sharing prefixes, so a match costs its length, not the table's."""
    root: dict = {}
    for word in words:
        node = root
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = {}

    def render(node: dict) -> str:
        # The end marker goes last, so the longest word wins.
        options = [re.escape(ch) + render(child) for ch, child in sorted(node.items()) if ch]
        if not options:
            return ""
        body = options[0] if len(options) == 1 and "" not in node else f"(?:{'|'.join(options)})"
        return body + ("?" if "" in node else "")

    return render(root)


def _lookup(table: Mapping[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for item in sorted(table.items()) for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, so that nested rewrites do not multiply."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_brackets(term: Column) -> Column:
    inside = F.substring(term, F.lit(2), F.length(term) - 2)
    return F.when(term.startswith("<") & term.endswith(">"), inside).otherwise(term)


def is_literal(term: Column) -> Column:
    return term.startswith('"')


def _after(text: Column, head: Column, skip: int = 0) -> Column:
    return F.substring(text, F.length(head) + skip + 1, F.length(text))


def compact(term: Column, prefixes: Mapping[str, str]) -> Column:
    """``<namespace + name>`` becomes ``prefix__name``; the longest namespace wins.

    ``prefixes`` maps prefix to namespace. Literals and unknown namespaces stay as they are.
    """
    return let(term, lambda t: compact_column(t, prefixes))


def compact_column(term: Column, prefixes: Mapping[str, str]) -> Column:
    """:func:`compact` of a plain column, which costs nothing to mention several times."""
    bare = strip_brackets(term)
    if not prefixes:
        return F.when(is_literal(term), term).otherwise(bare)
    by_namespace = {ns: name for name, ns in prefixes.items()}
    if len(by_namespace) <= COMPARED:
        opened = F.when(term.startswith("<"), F.substring(term, F.lit(2), F.length(term))).otherwise(term)
        chain = F.when(is_literal(term), term)
        for namespace in sorted(by_namespace, key=len, reverse=True):
            name = F.concat(F.lit(f"{by_namespace[namespace]}__"), _after(bare, F.lit(namespace)))
            chain = chain.when(opened.startswith(namespace), name)
        return chain.otherwise(bare)
    ns = F.regexp_extract(term, f"^<?({_alternatives(list(by_namespace))})", 1)
    short = let(ns, lambda n: F.concat(_lookup(by_namespace, n), F.lit("__"), _after(bare, n)))
    return F.when(is_literal(term), term).otherwise(F.coalesce(short, bare))


def expand(term: Column, prefixes: Mapping[str, str], brackets: bool = True) -> Column:
    """The inverse of :func:`compact`; IRIs get their brackets back unless ``brackets`` is false."""
    pattern = f"^({_alternatives(list(prefixes))})__" if prefixes else None

    def lengthen(t: Column) -> Column:
        return let(
            F.regexp_extract(t, pattern, 1),
            lambda name: F.coalesce(F.concat(_lookup(prefixes, name), _after(t, name, 2)), t),
        )

    def iri(t: Column) -> Column:
        full = lengthen(t) if pattern else t
        return F.concat(F.lit("<"), full, F.lit(">")) if brackets else full

    return let(term, lambda t: F.when(is_literal(t) | t.startswith("_:"), t).otherwise(iri(t)))


def lexical(term: Column) -> Column:
    """The text inside a literal; nodes are their own text."""
    return F.when(is_literal(term), F.regexp_extract(term, LITERAL, 1)).otherwise(term)


def lang(term: Column) -> Column:
    """Language tag, empty when there is none."""
    return F.when(is_literal(term), F.regexp_extract(term, LANG_TAG, 1)).otherwise(F.when(term.isNotNull(), F.lit("")))


def numeric(term: Column) -> Column:
    """The number a term spells in decimals, with an exponent or not, else null.

    The pattern keeps out what a cast alone would take: ``5d``, ``0x1p3``, ``Infinity``.
    """
    return let(lexical(term), lambda t: F.when(t.rlike(NUMBER), t.try_cast("double")))
