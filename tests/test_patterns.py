"""Graph patterns against a nested-loop evaluation of the same triples."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from tripleweave.functions import filters as f
from tripleweave.plans import pattern as pat
from tripleweave.plans.paths import P
from tripleweave.plans.pattern import Pattern, match, path
from tripleweave.sources.triples import PropertyTables

TRIPLES = [
    ("a", "knows", "b"),
    ("a", "knows", "b"),
    ("a", "knows", "a"),
    ("b", "knows", "c"),
    ("c", "likes", "a"),
    ("a", "likes", "c"),
    ("b", "age", '"10"'),
    ("c", "age", '"9"'),
    ("c", "knows", "c"),
]


def brute(triples, patterns):
    """All bindings, as a sorted list of tuples in variable order."""
    answers = []
    for rows in product(triples, repeat=len(patterns)):
        binding = {}
        for row, terms in zip(rows, patterns):
            for value, term in zip(row, terms):
                if not term.startswith("?"):
                    if term != value:
                        break
                elif binding.setdefault(term[1:], value) != value:
                    break
            else:
                continue
            break
        else:
            answers.append(binding)
    return as_rows(answers)


def as_rows(bindings):
    return sorted(tuple(sorted((k, str(v)) for k, v in b.items())) for b in bindings)


def answer(pattern):
    return as_rows(r.asDict() for r in pattern.df.collect())


@pytest.fixture(scope="module")
def source(frame):
    return frame(TRIPLES)


@pytest.mark.parametrize(
    "patterns",
    [
        [("?x", "knows", "?y")],
        [("?x", "knows", "?x")],
        [("?x", "knows", "?y"), ("?y", "likes", "?z")],
        [("?x", "knows", "?y"), ("?x", "likes", "?z"), ("?z", "age", "?n")],
        [("?x", "knows", "?y"), ("?y", "knows", "?x")],
        [("?x", "likes", "?y"), ("?s", "age", "?n")],
        [("?x", "?p", "?y"), ("?y", "age", '"9"')],
        [("a", "?p", "?y")],
        [("?x", "?p", "?p")],
        [("c", "likes", "a"), ("?x", "age", "?n")],
        [("c", "knows", "a"), ("?x", "age", "?n")],
    ],
)
def test_match_is_brute_force(source, patterns):
    assert answer(match(source, patterns)) == brute(TRIPLES, patterns)


def test_property_tables_give_the_same(frame):
    tables = PropertyTables(
        {
            p: lambda p=p: frame([(s, o) for s, q, o in TRIPLES if q == p], "sub string, obj string")
            for p in ("knows", "likes", "age")
        }
    )
    for patterns in ([("?x", "knows", "?y"), ("?y", "likes", "?z")], [("?x", "?p", "?y")]):
        assert answer(match(tables, patterns)) == brute(TRIPLES, patterns)


def compatible(a, b):
    return all(a[v] is None or b[v] is None or a[v] == b[v] for v in a.keys() & b.keys())


def merge(a, b):
    return {v: a.get(v) if a.get(v) is not None else b.get(v) for v in [*a, *[k for k in b if k not in a]]}


ROWS_A = [("1", "x"), ("1", "x"), ("2", None), (None, "y"), (None, None), ("3", "z")]
ROWS_B = [("1", "x", "p"), ("2", None, "q"), (None, "y", "r"), ("9", "z", "s"), ("2", "w", None)]


def sides(frame, rows_a=ROWS_A, rows_b=ROWS_B):
    a = Pattern(frame(rows_a, "u string, v string"), frozenset("uv"))
    b = Pattern(frame(rows_b, "u string, v string, w string"), frozenset("uvw"))
    return a, b, [dict(zip("uv", r)) for r in rows_a], [dict(zip("uvw", r)) for r in rows_b]


def test_join_with_unbound_variables(frame):
    a, b, left, right = sides(frame)
    want = [merge(x, y) for x in left for y in right if compatible(x, y)]
    assert answer(a.join(b)) == as_rows(want)
    assert answer(b.join(a)) == as_rows(want)


@pytest.mark.parametrize("filtered", [False, True])
def test_optional_with_unbound_variables(frame, filtered):
    a, b, left, right = sides(frame)
    on = F.col("w") != "r" if filtered else None
    want = []
    for x in left:
        found = [merge(x, y) for y in right if compatible(x, y)]
        if filtered:
            found = [m for m in found if m["w"] is not None and m["w"] != "r"]
        want += found or [{**x, "w": None}]
    assert answer(a.optional(b, on)) == as_rows(want)


def test_only_masks_that_occur_are_joined(frame, monkeypatch):
    names = "stuv"
    a = frame([("1", "2", None, None), ("1", None, "3", None), ("1", "2", "3", "4")], ", ".join(f"{v} string" for v in names))
    b = frame([("1", None, None, "4"), ("1", "2", "3", "4"), (None, None, None, None)], ", ".join(f"{v} string" for v in [*names[1:], "w"]))
    left, right = Pattern(a, frozenset(names[1:])), Pattern(b, frozenset([*names[1:], "w"]))
    assert [len(pat._by_bound(p, list(names[1:]))) for p in (left, right)] == [3, 3]
    want = [
        merge(x, y)
        for x in (r.asDict() for r in a.collect())
        for y in (r.asDict() for r in b.collect())
        if compatible(x, y)
    ]
    joined = left.join(right)
    assert answer(joined) == as_rows(want)
    empty = Pattern(a.limit(0), left.maybe).join(right)
    assert empty.df.columns == joined.df.columns and empty.df.count() == 0


def test_optional_without_shared_variables(frame):
    a = Pattern(frame([("1",), ("2",), ("2",)], "u string"))
    b = Pattern(frame([("2",), ("3",)], "w string"))
    none = Pattern(b.df.where("false"))
    cross = [{"u": u, "w": w} for u in "122" for w in "23"]
    assert answer(a.optional(b)) == as_rows(cross)
    assert answer(a.optional(none)) == as_rows({"u": u, "w": None} for u in "122")
    on = f.compare("?u", "=", "?w")
    assert answer(a.optional(b, on)) == as_rows([{"u": "1", "w": None}, {"u": "2", "w": "2"}, {"u": "2", "w": "2"}])


def test_optional_filter_and_anti(source):
    people = match(source, [("?x", "knows", "?y")])
    ages = match(source, [("?y", "age", "?n")])
    left = people.optional(ages, on=f.compare("?n", ">", 9))
    want = []
    for s, p, o in TRIPLES:
        if p == "knows":
            n = [t for t in TRIPLES if t[0] == o and t[1] == "age" and t[2] == '"10"']
            want += [{"x": s, "y": o, "n": t[2]} for t in n] or [{"x": s, "y": o, "n": None}]
    assert answer(left) == as_rows(want)
    assert left.maybe == {"n"}
    without = people.optional(ages).where(f.not_bound("?n")).project("?x", "?y")
    anti = people.df.join(ages.df, "y", "left_anti").select("x", "y")
    assert answer(without) == answer(Pattern(anti))


def test_union_pads_and_commutes(source):
    a, b = match(source, [("?x", "knows", "?y")]), match(source, [("?x", "age", "?n")])
    assert answer(a.union(b)) == answer(b.union(a))
    assert a.union(b).maybe == {"y", "n"}
    assert a.union(b).df.count() == 7


def test_modifiers(source):
    ages = match(source, [("?x", "age", "?n")])
    assert [r.x for r in ages.order("?n").df.collect()] == ["b", "c"]
    assert [r.x for r in ages.order(f.number("?n")).df.collect()] == ["c", "b"]
    assert [r.x for r in ages.order(("?x", "desc")).slice(limit=1).df.collect()] == ["c"]
    assert ages.slice(limit=0).df.count() == 0
    knows = match(source, [("?x", "knows", "?y")])
    assert knows.distinct().df.count() == 4
    assert knows.project("?x").reduced().df.count() == 3
    assert knows.count().first().answers == 5


def test_long_pages_number_rows(spark, monkeypatch):
    monkeypatch.setattr(pat, "TOP_ROWS", 10)
    df = spark.range(1000).select((F.col("id") % 7).alias("a"), F.col("id").alias("b"))
    ordered = Pattern(df.repartition(5)).order("?a")
    want = sorted(((i % 7, i) for i in range(1000)))
    for offset, limit in [(0, 50), (333, None), (990, 100), (5, 3), (2000, None)]:
        got = [tuple(r) for r in ordered.slice(offset, limit).df.collect()]
        assert got == want[offset:][: limit if limit is not None else None]


def test_paths(source, frame):
    def pairs(expr):
        return sorted((r.s, r.o) for r in path(source, "?s", expr, "?o").df.collect())

    knows = [(s, o) for s, p, o in TRIPLES if p == "knows"]
    likes = [(s, o) for s, p, o in TRIPLES if p == "likes"]
    chain = sorted((a, d) for a, b in knows for c, d in likes if b == c)
    assert pairs(P("knows") / P("likes")) == chain
    assert pairs(~(P("knows") / P("likes"))) == sorted((o, s) for s, o in chain)
    assert pairs(P("knows") | P("likes")) == sorted(knows + likes)
    assert pairs(P("knows") | P("knows")) == sorted(knows + knows)
    assert pairs(~P("knows") | P("likes")) == sorted([(o, s) for s, o in knows] + likes)
    both = knows + likes
    assert pairs((P("knows") | P("likes")) / P("knows")) == sorted((a, d) for a, b in both for c, d in knows if b == c)
    assert [r.o for r in path(source, "c", P("likes") / P("likes"), "?o").df.collect()] == ["c"]
    assert path(source, "?x", P("likes") / P("likes"), "?x").df.count() == 2
    explicit = match(source, [("?s", "knows", "?m"), ("?m", "likes", "?o")]).project("?s", "?o")
    assert answer(path(source, "?s", P("knows") / P("likes"), "?o")) == answer(explicit)


def test_path_steps_take_part_in_their_group(source):
    group = [("?s", P("knows") / ~P("likes"), "?o"), ("?o", "age", '"9"')]
    (steps,) = pat._groups(group)
    assert steps == [("?s", "knows", "?__via0"), ("?o", "likes", "?__via0"), ("?o", "age", '"9"')]
    assert ("0", "knows", "TRPO", ["knows_TRPO", "likes_TRPO"]) in pat.needs(steps)
    explicit = match(source, [("?s", "knows", "?m"), ("?o", "likes", "?m"), ("?o", "age", '"9"')]).project("?s", "?o")
    assert answer(match(source, group)) == answer(explicit)
    # Alternatives of more than one step are groups of their own; those of single properties are one scan.
    assert len(pat._groups([("?s", (P("knows") / P("likes")) | P("age"), "?o")])) == 2
    assert pat._groups([("?s", P("knows") | P("age"), "?o")]) == [[("?s", ("knows", "age"), "?o")]]
    both = match(source, [("?s", (P("knows") / P("likes")) | P("likes"), "?o"), ("?s", "knows", "?x")])
    chain = match(source, [("?s", "knows", "?m"), ("?m", "likes", "?o"), ("?s", "knows", "?x")]).project("?s", "?o", "?x")
    single = match(source, [("?s", "likes", "?o"), ("?s", "knows", "?x")]).project("?s", "?o", "?x")
    assert answer(both) == sorted(answer(chain) + answer(single))


def test_what_a_pattern_knows_of_its_variables(source):
    a = match(source, [("?x", "knows", "?y"), ("?x", "likes", "?z")])
    assert a.items == {"x": {"knows_TRPS", "likes_TRPS"}, "y": {"knows_TRPO"}, "z": {"likes_TRPO"}}
    b = match(source, [("?x", "age", "?n")])
    assert a.join(b).items["x"] == {"knows_TRPS", "likes_TRPS", "age_TRPS"}
    assert a.optional(b).items == a.items  # nothing comes out of an optional part
    assert a.union(b).items == {}
    assert a.union(match(source, [("?x", "knows", "?y")])).items == {"x": {"knows_TRPS"}, "y": {"knows_TRPO"}}
    assert a.project("?x").items == {"x": a.items["x"]}
