"""Quality rules as a ledger of failure bits: every rule is evaluated once, policies come later.

Only DataFrame functions; nothing is shuffled to fill the ledger.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals"]


def rules() -> dict[str, Column]:
    """Each rule's failure condition over the measures; rule i owns bit i and keeps it for good."""
    c = F.col
    return {
        "few_words": c("n_words") < 20,
        "repeated_windows": 100 * c("n_repeat_words") > 30 * c("n_words"),
        "symbols": 2 * c("n_symbols") > c("n_words"),
        "repeated_lines": 2 * c("n_dup_lines") > c("n_lines"),
        "short_words": c("word_chars") < 2 * c("n_words"),
        "long_words": c("word_chars") > 20 * c("n_words"),
        "shouting": 2 * c("n_capitals") > c("word_chars"),
    }


BASE = ("few_words", "repeated_windows")

# Versioned policies: the rules a document must pass.
POLICIES: Mapping[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "repeated_lines", "shouting"),
    "v2": (*BASE, "symbols", "repeated_lines", "short_words", "long_words", "shouting"),
}
CURRENT = "v2"


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct column ``_m`` of all measures; a null text has none of anything."""
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = docs.withColumn("_words", F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).withColumn(
        "_lines", F.filter(F.split(text, "\n"), lambda x: _without(x, SPACE) > 0)
    )
    # Windows of eight words, as hashes of the words' hashes; duplicates are looked for only
    # where there are any.
    hashed = cut.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    count = F.greatest(F.size("_words") - (WINDOW - 1), F.lit(0))
    windows = hashed.withColumn(
        "_windows",
        F.slice(
            F.transform(
                "_hashes",
                lambda h, i: F.xxhash64(h, *[F.get(F.col("_hashes"), i + k) for k in range(1, WINDOW)]),
            ),
            F.lit(1),
            count,
        ),
    )
    placed = windows.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    neighbour = lambda e, i: F.coalesce(F.get(F.col("_sorted"), i)["h"] == e["h"], F.lit(False))
    repeated = placed.withColumn(
        "_repeated",
        F.sort_array(
            F.transform(
                F.filter("_sorted", lambda e, i: neighbour(e, i - 1) | neighbour(e, i + 1)), lambda e: e["i"]
            )
        ),
    )
    # A word counts once however many repeated windows cover it.
    covered = F.aggregate(
        F.transform(
            "_repeated",
            lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_repeated"), j + 1) - p, F.lit(WINDOW))),
        ),
        F.lit(0),
        lambda total, x: total + x,
    )
    long = lambda column: column.cast("long")
    measures = F.struct(
        long(F.size("_words")).alias("n_words"),
        long(_without(text, SPACE)).alias("word_chars"),
        long(F.length(text) - _without(text, SYMBOLS)).alias("n_symbols"),
        long(F.size("_lines")).alias("n_lines"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        long(F.coalesce(covered, F.lit(0))).alias("n_repeat_words"),
        long(F.length(text) - _without(text, CAPITALS)).alias("n_capitals"),
    )
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns], measures.alias("_m"))


def ledger(docs: DataFrame) -> DataFrame:
    """``doc_id``, every measure, and ``failed``: bit i is set if rule i fails. A row per document."""
    own = docs.select("doc_id", "text")
    rows = measured(own).select("doc_id", "_m.*")
    bits = [F.when(condition, F.lit(1 << i)).otherwise(F.lit(0)) for i, condition in enumerate(rules().values())]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return rows.withColumn("failed", failed.cast("long"))


def mask(names: tuple[str, ...] | list[str]) -> int:
    order = list(rules())
    return sum(1 << order.index(n) for n in names)


def passes(names: tuple[str, ...] | list[str], failed: str = "failed") -> Column:
    """Whether a document passes a policy: one bit test on its ledger row."""
    return F.col(failed).bitwiseAND(F.lit(mask(names)).cast("long")) == 0


def ablations(rows: DataFrame, names: tuple[str, ...] | list[str]) -> DataFrame:
    """Per rule of a policy: ``rejected`` by it, ``only`` by it, ``kept_without`` it, and ``kept`` by all.

    The ledger is reduced to counts per bit pattern (at most 2 to the number of rules), then
    each rule is a bit test over the patterns.
    """
    whole = mask(names)
    patterns = rows.groupBy(F.col("failed").bitwiseAND(F.lit(whole).cast("long")).alias("p")).agg(F.count("*").alias("n"))
    order = list(rules())
    each = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << order.index(n)).cast("long").alias("bit")) for n in names])
    spread = patterns.select("p", "n", F.explode(each).alias("r")).select("p", "n", "r.rule", "r.bit")
    has = F.col("p").bitwiseAND(F.col("bit")) != 0
    alone = F.col("p") == F.col("bit")
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    return spread.groupBy("rule").agg(
        total(has).alias("rejected"),
        total(alone).alias("only"),
        total(alone | (F.col("p") == 0)).alias("kept_without"),
        total(F.col("p") == 0).alias("kept"),
    )


def kept(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of ``docs`` that pass a policy, columns as they are."""
    rows = measured(docs)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    judged = rows.select(row, *[F.col("_m")[m].alias(m) for m in MEASURES])
    conditions = rules()
    failing = conditions[POLICIES[policy][0]]
    for name in POLICIES[policy][1:]:
        failing = failing | conditions[name]
    # A filter would be pushed below the measures and compute them once per condition;
    # an empty list gives no row and stays where it is.
    return judged.select("_row", F.explode(F.when(~failing, F.array(F.lit(0))))).select("_row.*")


SQL = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (
  select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
         [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] as lines
  from d),
g as (
  select doc_id, i, array_to_string(list_slice(words, i, i + 7), ' ') as gram
  from (select doc_id, words, unnest(range(1, len(words) - 6)) as i from w)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, gram) as n from g) where n > 1),
c as (
  select doc_id, sum(least(8, coalesce(later - i, 8))) as covered
  from (select doc_id, i, lead(i) over (partition by doc_id order by i) as later from r) group by doc_id),
m as (
  select w.doc_id, len(words)::bigint as n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         len(lines)::bigint as n_lines,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
         coalesce(covered, 0)::bigint as n_repeat_words,
         (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::bigint as n_capitals
  from w left join c on w.doc_id = c.doc_id),
f as (
  select *, (case when n_words < 20 then 1 else 0 end + case when 100 * n_repeat_words > 30 * n_words then 2 else 0 end
    + case when 2 * n_symbols > n_words then 4 else 0 end + case when 2 * n_dup_lines > n_lines then 8 else 0 end
    + case when word_chars < 2 * n_words then 16 else 0 end + case when word_chars > 20 * n_words then 32 else 0 end
    + case when 2 * n_capitals > word_chars then 64 else 0 end)::bigint as failed
  from m)
"""
