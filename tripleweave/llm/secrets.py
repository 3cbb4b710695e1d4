"""Secret scans: known shapes by pattern, unknown ones by the entropy of sliding windows.

Only DataFrame functions, nothing is shuffled. Candidate strings are runs of credential
characters. A window of WINDOW characters slides over each; as it moves by one, one character
leaves and one enters, and only their counts change the sum of c * log2(c) that the entropy
follows from. The counts come from the characters around a place, the sum is carried along.
Sums are whole numbers (millionths), so every engine finds the same windows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The shapes looked for, by kind in their order, with the group whose length counts and the least length.
KINDS = {
    "assign": (
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 16),
    "hex": (r"([0-9a-f]{32,})", 1, 32),
}
ENTROPY = "entropy"

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
DIGITS = "0123456789"
HEX_LETTERS = "abcdef"
OTHER_LOWER = "ghijklmnopqrstuvwxyz"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Bits a character of a window needs, by the class its characters fall into; a window of 20 random
# ones has some 3.4, 3.8, 3.8 and 4.0. At least LEAST digits and LEAST letters are needed as well.
THRESHOLDS = {"hex": 3.0, "lower": 3.5, "upper": 3.5, "mixed": 3.7}
LEAST = 3

# Candidates with one of these are no secrets: placeholders, alphabets, numbered names and UUIDs.
ALLOWED = (
    r"(?i)example|sample|dummy|placeholder|changeme|redacted|your[_-]?(?:api|key|token|secret)",
    r"(?i)abcdefghij|0123456789|1234567890",
    r"(?i)(?:^|[^0-9a-f])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?:[^0-9a-f]|$)",
    r"(?:^|/)(?:[a-z]+[/_-])+[0-9]*$",
)

# Long candidates are cut into overlapping stretches of this many windows.
STRETCH = 512

SPAN = "array<struct<kind: string, begin: long, end: long>>"


def _weight(n: int) -> int:
    """``n * log2(n)`` in millionths."""
    return round(n * math.log2(n) * 1_000_000) if n else 0


# What the sum grows by when a character enters a window that already has n of it.
GAINS = [_weight(n + 1) - _weight(n) for n in range(WINDOW)]


def bounds() -> dict[str, int]:
    """The largest sum of a window of each class that still has the bits asked for."""
    return {name: math.floor(WINDOW * (math.log2(WINDOW) - bits) * 1_000_000) for name, bits in THRESHOLDS.items()}


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _running(values: Column, join) -> Column:
    """What ``join`` makes of all values up to each place, in steps so that no long list is copied per value."""
    nothing = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<long>").alias("each"))
    add = lambda s, x: _let(
        join(s["total"], x), lambda t: F.struct(t.alias("total"), F.concat(s["each"], F.array(t)).alias("each"))
    )
    starts = lambda v: F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), F.lit(STRETCH))
    parts = lambda v: F.transform(starts(v), lambda o: F.aggregate(F.slice(v, o + 1, F.lit(STRETCH)), nothing, add))
    before = lambda p: F.aggregate(
        p,
        nothing,
        lambda s, part: F.struct(join(s["total"], part["total"]).alias("total"), F.concat(s["each"], F.array(s["total"])).alias("each")),
    )["each"]
    whole = lambda p, b: F.flatten(F.transform(p, lambda part, j: F.transform(part["each"], lambda x: join(x, F.get(b, j)))))
    return _let(values, lambda v: _let(parts(v), lambda p: _let(before(p), lambda b: whole(p, b))))


def _matches(text: Column, pattern: str, group: int) -> Column:
    """Every match, leftmost first, never overlapping, as ``(begin, end, whole, part)``; empty without one.

    Pieces between matches and matches take turns, so their lengths give the places.
    """
    found = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    parts = F.struct(F.split(text, pattern, -1).alias("pieces"), found(0).alias("whole"), found(group).alias("part"))
    steps = lambda z: F.transform(z["whole"], lambda m, i: (F.length(m) + F.length(F.get(z["pieces"], i))).cast("long"))
    each = lambda z, ends: F.transform(
        z["whole"],
        lambda m, i: F.struct(
            (F.get(ends, i) - F.length(m)).alias("begin"), F.get(ends, i).alias("end"), m.alias("whole"), F.get(z["part"], i).alias("part")
        ),
    )
    rows = _let(parts, lambda z: _let(_running(steps(z), lambda a, b: a + b), lambda ends: each(z, ends)))
    return F.when(text.rlike(pattern), rows).otherwise(F.array().cast("array<struct<begin: long, end: long, whole: string, part: string>>"))


def _base(text: Column, kind: str) -> Column:
    pattern, group, least = KINDS[kind]
    long = F.filter(_matches(text, pattern, group), lambda m: F.length(m["part"]) >= least)
    return F.transform(long, lambda m: F.struct(F.lit(kind).alias("kind"), m["begin"].alias("begin"), m["end"].alias("end")))


def _windows(stretch: Column) -> Column:
    """``(at, sum)`` of the windows of a stretch that have bits enough for some class."""
    gains = F.array(*[F.lit(g).cast("long") for g in GAINS])
    loosest = max(bounds().values())
    among = lambda character, others: F.length(others) - F.length(F.replace(others, character, F.lit("")))
    nothing = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<struct<at: long, sum: long>>").alias("found"))

    def move(state: Column, i: Column) -> Column:
        # The characters that stay as the one at ``i`` enters and the one WINDOW before it leaves.
        stay = F.when(i >= WINDOW - 1, F.substr(stretch, i - (WINDOW - 2), F.lit(WINDOW - 1))).otherwise(F.substr(stretch, F.lit(1), i))
        enters, leaves = F.substr(stretch, i + 1, F.lit(1)), F.substr(stretch, i - (WINDOW - 1), F.lit(1))
        total = lambda s: (
            state["sum"] + F.get(gains, among(enters, s)) - F.when(i >= WINDOW, F.get(gains, among(leaves, s))).otherwise(F.lit(0).cast("long"))
        )
        grown = lambda t: F.when(
            (i >= WINDOW - 1) & (t <= loosest),
            F.concat(state["found"], F.array(F.struct((i - (WINDOW - 1)).cast("long").alias("at"), t.alias("sum")))),
        ).otherwise(state["found"])
        return _let(_let(stay, total), lambda t: F.struct(t.alias("sum"), grown(t).alias("found")))

    return F.aggregate(F.sequence(F.lit(0), F.length(stretch) - 1), nothing, move)["found"]


def _flagged(stretch: Column) -> Column:
    """Where in a stretch the windows begin that look random for the class of their characters."""
    limits = bounds()

    def random(window: Column, total: Column) -> Column:
        has = lambda characters: WINDOW - F.length(F.translate(window, characters, ""))
        counts = F.struct(has(DIGITS).alias("d"), has(HEX_LETTERS).alias("x"), has(OTHER_LOWER).alias("l"), has(UPPER).alias("u"))

        def judge(c: Column) -> Column:
            letters = c["x"] + c["l"] + c["u"]
            plain = c["d"] + letters == WINDOW
            limit = (
                F.when(plain & (c["l"] + c["u"] == 0), limits["hex"])
                .when(plain & (c["u"] == 0), limits["lower"])
                .when(plain & (c["x"] + c["l"] == 0), limits["upper"])
                .otherwise(limits["mixed"])
            )
            return (c["d"] >= LEAST) & (letters >= LEAST) & (total <= limit)

        return _let(counts, judge)

    looks = lambda w: random(F.substr(stretch, w["at"].cast("int") + 1, F.lit(WINDOW)), w["sum"])
    return F.transform(F.filter(_windows(stretch), looks), lambda w: w["at"])


def _added(text: Column, allowed: tuple[str, ...]) -> Column:
    """Stretches of text covered by windows that look random, of candidates no allow-list entry fits."""
    suppressed = lambda c: F.coalesce(*[F.when(c.rlike(a), F.lit(True)) for a in allowed], F.lit(False))
    candidates = F.filter(_matches(text, CANDIDATE, 0), lambda m: ~suppressed(m["whole"]))
    # Cut by pattern: a substring would walk the candidate from its beginning for every stretch.
    cut = lambda c: F.regexp_extract_all(c, F.lit(f".{{1,{STRETCH}}}"), F.lit(0))
    overlapping = lambda p, s, i: F.concat(s, F.substr(F.coalesce(F.get(p, i + 1), F.lit("")), F.lit(1), F.lit(WINDOW - 1)))
    each = lambda m: _let(
        cut(m["whole"]),
        lambda p: F.flatten(
            F.transform(
                p, lambda s, i: F.transform(_let(overlapping(p, s, i), _flagged), lambda at: m["begin"] + i.cast("long") * STRETCH + at)
            )
        ),
    )
    begins = lambda a: F.filter(a, lambda x, i: (i == 0) | F.coalesce(x - F.get(a, i - 1) > WINDOW, F.lit(True)))
    lasts = lambda a: F.filter(a, lambda x, i: F.coalesce(F.get(a, i + 1) - x > WINDOW, F.lit(True)))
    spans = lambda a: F.zip_with(
        begins(a), lasts(a), lambda b, e: F.struct(F.lit(ENTROPY).alias("kind"), b.alias("begin"), (e + WINDOW).alias("end"))
    )
    return _let(F.flatten(F.transform(candidates, each)), spans)


def findings(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """The columns of ``docs`` and ``findings``: an array of ``(kind, begin, end)`` by begin, then kind.

    Places count code points, ends are exclusive. The kinds of ``KINDS`` are matches of patterns,
    leftmost first and never overlapping within a kind; ``entropy`` marks text of high entropy in
    candidates that no pattern of ``allowed`` fits, left out where one other span covers it.

    A row per row: repeated rows give repeated results. A null or empty text has an empty array, an
    empty table no rows; ids are not read; a column ``findings`` of ``docs`` is replaced. Long
    texts are searched whole and in one pass per pattern; long candidates in overlapping stretches.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    order = {kind: i for i, kind in enumerate([*KINDS, ENTROPY])}
    lists = [*((kind, _base(text, kind)) for kind in KINDS), (ENTROPY, _added(text, allowed))]

    def ranked(spans: Column, rank: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["begin"].alias("begin"), F.lit(rank).alias("rank"), s["end"].alias("end")))

    every = F.concat(*[ranked(spans, order[kind]) for kind, spans in lists])
    last = order[ENTROPY]
    reach = lambda z: _running(F.transform(z, lambda s: F.when(s["rank"] < last, s["end"]).otherwise(0)), F.greatest)
    visible = lambda z: _let(reach(z), lambda r: F.filter(z, lambda s, i: (s["rank"] < last) | (F.get(r, i) < s["end"])))
    names = F.array(*[F.lit(k) for k in order])
    named = lambda z: F.transform(
        visible(z), lambda s: F.struct(F.get(names, s["rank"]).alias("kind"), s["begin"].alias("begin"), s["end"].alias("end"))
    )
    own = "_spans"
    while own in docs.columns:
        own += "_"
    found = F.when(F.size(own) > 0, _let(F.array_sort(own), named)).otherwise(F.array().cast(SPAN))
    return docs.withColumn(own, every).withColumn("findings", found).drop(own)


def joined(spans: Column) -> Column:
    """``kind:begin:end`` of every span, joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id``, the number of findings of each pattern kind, a digest of these, and all spans as text."""
    rows = findings(docs.select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("findings", lambda s: s["kind"] != ENTROPY)
    return rows.select(
        "doc_id",
        *[of(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql() -> str:
    """The digest in SQL: entropies by counting every window's characters anew."""
    limits, tick = bounds(), _quoted
    kinds = "\n  union all ".join(
        f"select r, {tick(kind)} as kind, {i} as rank, {least} as least, regexp_extract_all(text, {tick(p)}, 0) as m, "
        f"regexp_extract_all(text, {tick(p)}, {g}) as g, regexp_split_to_array(text, {tick(p)}) as p from d where regexp_matches(text, {tick(p)})"
        for i, (kind, (p, g, least)) in enumerate([*KINDS.items(), (ENTROPY, (CANDIDATE, 0, 1))])
    )
    count = lambda characters: f"{WINDOW} - length(translate(w, '{characters}', ''))"
    suppressed = " or ".join(f"regexp_matches(m, {tick(a)})" for a in ALLOWED)
    return f"""
with d as (select doc_id, row_number() over () as r, coalesce(text, '') as text from documents),
k as ({kinds}),
u as (select r, kind, rank, least, unnest(m) as m, unnest(g) as g, unnest(p[1:len(m)]) as p, unnest(range(len(m))) as i from k),
q as (select *, sum(length(p) + length(m)) over (partition by r, kind order by i)::bigint as finish from u),
b as (select r, kind, rank, finish - length(m) as start, finish from q where rank < {len(KINDS)} and length(g) >= least),
c as (select r, finish - length(m) as start, m from q where rank = {len(KINDS)} and not ({suppressed})),
w as (select r, start + s as pos, substr(m, s + 1, {WINDOW}) as w from (select r, start, m, unnest(range(length(m) - {WINDOW - 1})) as s from c)),
v as (select *, {count(DIGITS)} as d, {count(HEX_LETTERS)} as x, {count(OTHER_LOWER)} as l, {count(UPPER)} as u,
        list_sum(list_transform(map_values(list_histogram(string_split(w, ''))), lambda n: ({[_weight(n) for n in range(1, WINDOW + 1)]})[n::bigint])) as total
      from w),
f as (select r, pos from v where d >= {LEAST} and x + l + u >= {LEAST} and total <= case
        when d + x = {WINDOW} then {limits["hex"]} when d + x + l = {WINDOW} then {limits["lower"]}
        when d + u = {WINDOW} then {limits["upper"]} else {limits["mixed"]} end),
g as (select r, pos, case when pos - lag(pos) over (partition by r order by pos) <= {WINDOW} then 0 else 1 end as new from f),
h as (select r, pos, sum(new) over (partition by r order by pos) as island from g),
e as (select r, '{ENTROPY}' as kind, {len(KINDS)} as rank, min(pos) as start, max(pos) + {WINDOW} as finish from h group by r, island),
a as (select * from b union all
      select * from e where not exists (select 1 from b where b.r = e.r and b.start <= e.start and b.finish >= e.finish)),
t as (select r, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex,
        string_agg(kind || ':' || start || ':' || finish, ',' order by start, rank) filter (rank < {len(KINDS)}) as base,
        string_agg(kind || ':' || start || ':' || finish, ',' order by start, rank) as spans from a group by r)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join t on d.r = t.r"""


SQL = _sql()
