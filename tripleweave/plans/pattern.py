"""Graph patterns as DataFrames.

:func:`match` turns triple patterns into joins; the :class:`Pattern` it returns carries one
column per variable and grows by ``join``, ``optional``, ``union``, ``where`` and the
modifiers. Every step is lazy; ``.df`` is an ordinary DataFrame at any point.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from itertools import count, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleweave.operators import reductions as red
from tripleweave.operators.numbering import numbered
from tripleweave.plans.access import Reductions
from tripleweave.plans.paths import Path
from tripleweave.sources.scratch import staged
from tripleweave.sources.triples import Triples, as_triples

# Rows a page may reach to before paging numbers the rows instead of sorting a top list.
TOP_ROWS = 100_000


def is_var(x) -> bool:
    return isinstance(x, str) and x.startswith("?")


def name(var: str) -> str:
    return var.removeprefix("?")


Items = Mapping[str, frozenset[str]]


class Pattern:
    """``df`` has a column per variable; ``maybe`` are the variables that can be unbound (null).

    ``items`` tells under which items (a property and a side) every value of a variable occurs;
    ``assumes`` what a match was told of its surroundings: rows that contradict it are not in
    ``df``, so it may only be joined to a pattern that keeps the promise.
    """

    def __init__(self, df: DataFrame, maybe: frozenset[str] = frozenset(), items: Items | None = None, assumes: Items | None = None):
        self.df = df
        self.maybe = maybe
        self.items = {v: i for v, i in (items or {}).items() if i and v not in maybe}
        self.assumes = {v: i for v, i in (assumes or {}).items() if i}

    def _like(self, df: DataFrame) -> Pattern:
        """Some rows of this pattern, with the same columns."""
        return Pattern(df, self.maybe, self.items, self.assumes)

    def _kept_for(self, other: Pattern) -> None:
        """Whether ``other`` may be joined to this one: what it was told must hold here, or be assumed here too."""
        for v, told in other.assumes.items():
            if not told <= self.items.get(v, frozenset()) | self.assumes.get(v, frozenset()):
                raise ValueError(f"?{v} was said to have {sorted(told)} around this pattern")

    @property
    def variables(self) -> list[str]:
        return self.df.columns

    def join(self, other: Pattern) -> Pattern:
        """Inner join on all shared variables; without any, the cross product."""
        self._kept_for(other)
        shared = set(self.variables) & set(other.variables)
        maybe = {
            v
            for v in self.maybe | other.maybe
            if v not in shared or (v in self.maybe and v in other.maybe)
        }
        told = {v: i - other.items.get(v, frozenset()) for v, i in self.assumes.items()}
        return Pattern(_compatible(self, other), frozenset(maybe), _merged(self.items, other.items), told)

    def optional(self, other: Pattern, on: Column | None = None) -> Pattern:
        """Left outer join; ``on`` is the filter inside the optional part."""
        self._kept_for(other)
        left, right = self.variables, other.variables
        shared = [v for v in left if v in right]
        new = [v for v in right if v not in left]
        maybe = self.maybe | other.maybe.difference(left) | frozenset(new)
        if shared and not self.maybe.union(other.maybe).intersection(shared):
            renamed, cond = _keyed(other.df, shared)
            both = cond if on is None else cond & on
            return Pattern(self.df.join(renamed, both, "left").select(*left, *new), maybe, self.items, self.assumes)
        if not shared and on is None:
            matched = self.df.crossJoin(other.df)
            some = other.df.limit(1).select(F.lit(1).alias("__any"))  # one row, whatever the size
            lonely = self.df.join(F.broadcast(some), F.lit(True), "left_anti")
        else:
            # Keep the left row as it was, to tell which ones found no partner.
            own = self.df.select("*", *[F.col(v).alias(f"__{v}") for v in left])
            matched = _compatible(Pattern(own, self.maybe), other)
            matched = matched if on is None else matched.where(on)
            found = matched.select(*[F.col(f"__{v}") for v in left]).distinct()
            same = reduce(lambda a, b: a & b, [F.col(v).eqNullSafe(F.col(f"__{v}")) for v in left])
            lonely = self.df.join(found, same, "left_anti")
        padded = lonely.select("*", *[F.lit(None).cast(other.df.schema[v].dataType).alias(v) for v in new])
        return Pattern(matched.select(*left, *new).unionByName(padded), maybe, self.items, self.assumes)

    def union(self, other: Pattern) -> Pattern:
        """Bag union; variables of one side only are unbound in the other's rows."""
        lopsided = set(self.variables) ^ set(other.variables)
        both = {v: i & other.items[v] for v, i in self.items.items() if v in other.items}
        return Pattern(
            self.df.unionByName(other.df, allowMissingColumns=True),
            self.maybe | other.maybe | frozenset(lopsided),
            both,
            _merged(self.assumes, other.assumes),
        )

    def where(self, condition: Column) -> Pattern:
        return self._like(self.df.where(condition))

    def project(self, *variables: str) -> Pattern:
        names = [name(v) for v in variables]
        if set(self.assumes) - set(names):
            raise ValueError(f"join before leaving out {sorted(set(self.assumes) - set(names))}")
        kept = {v: i for v, i in self.items.items() if v in names}
        return Pattern(self.df.select(*names), self.maybe & frozenset(names), kept, self.assumes)

    def distinct(self) -> Pattern:
        return self._like(self.df.distinct())

    reduced = distinct  # a REDUCED answer may drop any duplicates; dropping all is allowed

    def order(self, *by) -> Pattern:
        """Sort by variables, ``(variable, "desc")`` pairs or Columns; unbound comes lowest.

        The other columns break ties, so the order is total and a run of equal keys can be
        range-partitioned over many tasks.
        """
        keys, used = [], set()
        for key in by:
            if isinstance(key, Column):
                keys.append(key)
                continue
            var, way = key if isinstance(key, tuple) else (key, "asc")
            col = F.col(name(var))
            used.add(name(var))
            keys.append(col.desc_nulls_last() if way == "desc" else col.asc_nulls_first())
        ties = [F.col(v).asc_nulls_first() for v in self.variables if v not in used]
        return self._like(self.df.orderBy(*keys, *ties))

    def slice(self, offset: int = 0, limit: int | None = None) -> Pattern:
        """Rows ``offset`` to ``offset + limit`` in the present order.

        A short page is Spark's own top list. A long or open-ended one would pass all its
        rows through one task there, so rows are numbered per partition instead.
        """
        if limit is not None and offset + limit <= TOP_ROWS:
            df = self.df.offset(offset) if offset else self.df
            return self._like(df.limit(limit))
        position = F.col("__position")
        wanted = position >= offset if limit is None else position.between(offset, offset + limit - 1)
        return self._like(numbered(self.df, "__position").where(wanted).drop("__position"))

    def count(self) -> DataFrame:
        """One row, one column: the number of answers."""
        return self.df.agg(F.count(F.lit(1)).alias("answers"))


def _keyed(df: DataFrame, shared: list[str]) -> tuple[DataFrame, Column | None]:
    """``df`` with its join columns renamed, and the equality with the other side's."""
    cond = None
    for v in shared:
        df = df.withColumnRenamed(v, f"__key_{v}")
        same = F.col(v) == F.col(f"__key_{v}")
        cond = same if cond is None else cond & same
    return df, cond


def _compatible(left: Pattern, right: Pattern) -> DataFrame:
    """Rows that agree on every variable both sides bind.

    An unbound variable agrees with anything. Sides are split by which of the shared
    variables they bind, so each part is a hash join on the rest and not a nested loop. With
    several loose variables the sides are written once, and only combinations that occur are joined.
    """
    shared = [v for v in left.variables if v in right.variables]
    loose = [v for v in shared if v in left.maybe or v in right.maybe]
    columns = left.variables + [v for v in right.variables if v not in shared]
    sides = [_by_bound(p, loose) for p in (left, right)]
    parts = []
    for (in_left, a), (in_right, b) in product(*sides):
        free = [v for v in loose if v not in in_left or v not in in_right]
        on = [v for v in shared if v not in free]
        # Whichever side binds a variable gives its value.
        a, b = a.drop(*[v for v in free if v not in in_left]), b.drop(*[v for v in free if v in in_left or v not in in_right])
        joined = a.join(b, on) if on else a.crossJoin(b)
        missing = [F.lit(None).cast(left.df.schema[v].dataType).alias(v) for v in free if v not in in_left and v not in in_right]
        parts.append(joined.select("*", *missing).select(*columns))
    return reduce(DataFrame.unionByName, parts) if parts else _no_rows(left.df, right.df, columns)


def _by_bound(pattern: Pattern, loose: list[str]) -> list[tuple[frozenset[str], DataFrame]]:
    """The rows of a pattern by which of the loose variables they bind."""
    maybe = [v for v in loose if v in pattern.maybe]
    always = frozenset(loose) - frozenset(maybe)
    df = pattern.df
    if len(maybe) > 1:
        mask = reduce(lambda m, i: m + F.when(F.col(maybe[i]).isNotNull(), 1 << i).otherwise(0), range(len(maybe)), F.lit(0))
        df = staged(df.withColumn("__bound", mask), "bound")
        masks = [r["__bound"] for r in df.select("__bound").distinct().collect()]  # at most 2 ** variables
        found = [(m, df.where(F.col("__bound") == m).drop("__bound")) for m in sorted(masks)]
    elif maybe:
        found = [(1, df.where(F.col(maybe[0]).isNotNull())), (0, df.where(F.col(maybe[0]).isNull()))]
    else:
        found = [(0, df)]
    return [(always | {v for i, v in enumerate(maybe) if m >> i & 1}, rows) for m, rows in found]


def _no_rows(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    types = {f.name: f.dataType for f in [*right.schema, *left.schema]}
    return left.limit(0).select(*[F.lit(None).cast(types[c]).alias(c) for c in columns])


def _merged(a: Items, b: Items) -> Items:
    return {v: a.get(v, frozenset()) | b.get(v, frozenset()) for v in [*a, *b]}


def match(source, patterns: list[tuple], reductions: Reductions | None = None, outer: Pattern | None = None) -> Pattern:
    """Join triple patterns ``(sub, prop, obj)`` on the variables they share.

    Terms starting with ``?`` are variables, in any position; the property may also be a
    :class:`~tripleweave.plans.paths.Path`, whose steps take part in the joins one by one. With
    ``reductions``, a scan reads the smallest reduced table the other patterns of this group
    imply, which changes no answer.

    ``outer`` is the pattern this one will be joined to: as the optional part, or as an arm of a
    union. What its variables are known to have reduces the scans in here as well; the other way
    round would lose rows. The result refuses to be joined where that is not known.
    """
    src = as_triples(source)
    told = {} if outer is None or reductions is None else _merged(outer.items, outer.assumes)
    groups = _groups(patterns)
    visible = list(dict.fromkeys(name(t) for p in patterns for t in p if is_var(t)))
    parts = [_joined(src, g, reductions, told) for g in groups]
    df = reduce(DataFrame.unionByName, [part.select(*visible) for part in parts])
    items = [_items(g) for g in groups]
    shared = {v: frozenset.intersection(*[i.get(v, frozenset()) for i in items]) for v in visible}
    used = {v: i for v, i in told.items() if v in visible}
    return Pattern(df, items=shared, assumes=used)


def _groups(patterns: list[tuple]) -> list[list[tuple]]:
    """The conjunctive groups that paths stand for, over hidden variables; a single one without alternatives."""
    fresh = (f"?__via{i}" for i in count())
    options = [p.steps(s, o, fresh) if isinstance(p, Path) else [[(s, p, o)]] for s, p, o in patterns]
    return [[step for steps in chosen for step in steps] for chosen in product(*options)]


def _joined(src: Triples, patterns: list[tuple], reductions: Reductions | None, told: Items) -> DataFrame:
    choices = reductions.choose(needs(patterns, told)) if reductions else {}
    plain = {p for _, prop, _ in patterns for p in ([prop] if isinstance(prop, str) else prop) if not is_var(p)}
    known = src.rows(plain) or {}
    scans = []
    for i, (s, p, o) in enumerate(patterns):
        choice = choices.get(str(i))
        table = reductions.scan(p, choice) if choice else None
        size = choice.rows if choice else sum(known.get(x, 0) for x in ([p] if isinstance(p, str) else p))
        scan = _scan(src, s, p, o, table)
        scans.append((len(scan.columns), size, i, scan))
    return _fold(scans)


def path(source, s: str, expr: Path, o: str) -> Pattern:
    return match(source, [(s, expr, o)])


def _scan(src: Triples, s: str, p, o: str, table: DataFrame | None) -> DataFrame:
    terms = [("sub", s), ("obj", o)]
    if table is not None:
        df = table
    elif isinstance(p, tuple):
        df = src.scan_any(p)
    elif is_var(p):
        df = src.frame()
        terms.insert(1, ("prop", p))
    else:
        df = src.scan(p)
    seen: dict[str, str] = {}
    for column, value in terms:
        if not is_var(value):
            df = df.where(F.col(column) == value)
        elif name(value) in seen:
            df = df.where(F.col(column) == F.col(seen[name(value)]))
        else:
            seen[name(value)] = column
    return df.select(*[F.col(column).alias(v) for v, column in seen.items()])


def _fold(scans: list[tuple]) -> DataFrame:
    """Small scans first, each next one sharing a variable if any does."""
    left = sorted(scans, key=lambda scan: scan[:3])
    df = left.pop(0)[3]
    while left:
        nxt = next((scan for scan in left if set(scan[3].columns) & set(df.columns)), left[0])
        left.remove(nxt)
        shared = [c for c in df.columns if c in nxt[3].columns]
        df = df.join(nxt[3], shared) if shared else df.crossJoin(nxt[3])
    return df


def _uses(patterns: list[tuple]) -> list[tuple[int, str, str, str]]:
    """Scans of one known property, the side a variable is on, the property and the variable."""
    return [
        (i, side, p, name(term))
        for i, (s, p, o) in enumerate(patterns)
        if isinstance(p, str) and not is_var(p)
        for side, term in ((red.SUBJECT, s), (red.OBJECT, o))
        if is_var(term)
    ]


def _items(patterns: list[tuple]) -> dict[str, frozenset[str]]:
    """The items of each variable within a group."""
    items: dict[str, frozenset[str]] = {}
    for _, side, p, var in _uses(patterns):
        items[var] = items.get(var, frozenset()) | {red.item(p, side)}
    return items


def needs(patterns: list[tuple], told: Items | None = None) -> list[tuple]:
    """What each scan could be reduced by: the items of its variables within this group, and those told of them."""
    items = _merged(_items(patterns), told or {})
    return [(str(i), p, side, sorted(items[var])) for i, side, p, var in _uses(patterns) if len(items[var]) > 1]
