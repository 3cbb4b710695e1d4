"""Document rates that bring expected domain totals to target weights. DataFrame functions only."""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleweave.llm.tables import written

DOMAINS = ("clean", "poor", "toxic")
SAMPLE = 20_000  # labelled documents the classifier learns from, the first by hash of their id
SUPPORT = 5  # labelled documents a feature occurs in, at least
GAIN = 10.0  # log-likelihood ratio of a feature, at least; chance alone gives 1 on average
TOKEN = r"\p{L}+|[^\p{L}\s]+"  # words and runs of signs apart
WRITTEN = 6  # steps of the descent after which rates are written
ALWAYS = ""  # stands in every document, with the weights of a document without features


def domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 1, "clean").otherwise("poor")


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(token, weights)``: every token that tells the domains apart with a log-odds per domain, and the row ALWAYS.

    A naive Bayes model of which tokens a document holds, learnt from at most SAMPLE labelled
    documents of ``docs``. Features are all tokens over GAIN (log-likelihood ratio); the sample
    bounds their number.
    Labels with a null are left out; of several for one document the smallest counts. Without
    labels every document gets equal posteriors.
    """
    own = (
        labels.where("doc_id is not null and quality is not null and toxic is not null")
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.min(F.struct("quality", "toxic")).alias("l"))
        .join(docs.select(F.col("doc_id").alias("_id")), "_id", "left_semi")
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(SAMPLE)
        .select("_id", domain(F.col("l.quality"), F.col("l.toxic")).alias("domain"))
    )
    # At most SAMPLE rows of two columns.
    held = docs.select("doc_id", "text").join(F.broadcast(own), F.col("doc_id") == F.col("_id"))
    seen = written(held.select("domain", F.array_distinct(_tokens(F.col("text"))).alias("tokens")), "labelled")
    sizes = {r["domain"]: r["n"] for r in seen.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    n = {d: sizes.get(d, 0) for d in DOMAINS}
    total = sum(n.values())
    counts = seen.select("domain", F.explode("tokens").alias("token")).groupBy("token").agg(
        *[F.sum((F.col("domain") == d).cast("long")).alias(d) for d in DOMAINS]
    )
    all_ = sum((F.col(d) for d in DOMAINS[1:]), F.col(DOMAINS[0]))

    def term(observed: Column, expected: Column) -> Column:
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(F.lit(0.0))

    gain = F.lit(0.0)
    for d in DOMAINS:
        share = n[d] / max(total, 1)
        if n[d]:
            gain = gain + term(F.col(d), all_ * share) + term(F.lit(n[d]) - F.col(d), (F.lit(total) - all_) * share)
    top = written(
        counts.where(all_ >= SUPPORT).withColumn("gain", gain).where(F.col("gain") >= GAIN), "features"
    )
    # Probabilities with half a document added on either side.
    held_by = {d: (F.col(d) + 0.5) / (n[d] + 1.0) for d in DOMAINS}
    present = F.array(*[F.log(held_by[d] / (1 - held_by[d])) for d in DOMAINS])
    bare = top.agg(*[F.coalesce(F.sum(F.log(1 - held_by[d])), F.lit(0.0)).alias(d) for d in DOMAINS])
    prior = {d: math.log((n[d] + 1.0) / (total + len(DOMAINS))) for d in DOMAINS}
    always = bare.select(F.lit(ALWAYS).alias("token"), F.array(*[F.col(d) + prior[d] for d in DOMAINS]).alias("weights"))
    return written(top.select("token", present.alias("weights")).union(always), "classifier")


def posteriors(docs: DataFrame, model: DataFrame, name: Column) -> DataFrame:
    """``_id`` (``name``), ``_n`` (tokens) and ``_p`` (posterior per domain) of every row; texts are not shuffled."""
    # The number only holds a row's tokens together within this job.
    cut = docs.select(F.monotonically_increasing_id().alias("_row"), name.alias("_id"), _tokens(F.col("text")).alias("_tokens"))
    spread = cut.select(
        "_row", "_id", F.size("_tokens").cast("long").alias("_n"),
        F.explode(F.concat(F.array(F.lit(ALWAYS)), F.array_distinct("_tokens"))).alias("_token"),
    )
    # The model has tokens of at most SAMPLE documents; those it doesn't know are gone before the shuffle.
    scored = spread.join(F.broadcast(model), F.col("_token") == F.col("token"))
    sums = scored.groupBy("_row", "_id", "_n").agg(
        *[F.sum(F.col("weights")[i]).alias(f"_w{i}") for i in range(len(DOMAINS))]
    )
    highest = F.greatest(*[F.col(f"_w{i}") for i in range(len(DOMAINS))])
    raised = [F.exp(F.col(f"_w{i}") - highest) for i in range(len(DOMAINS))]
    whole = sum(raised[1:], raised[0])
    return sums.select("_id", "_n", F.array(*[r / whole for r in raised]).alias("_p"))


class Fit(NamedTuple):
    """``rows`` with the rate ``_now``; the misses of the targets, relative to the totals at a rate of one; the steps taken."""

    rows: DataFrame
    misses: dict[str, float]
    steps: int
    converged: bool


def fit(rows: DataFrame, targets: Mapping[str, float], most: int = 1000, close: float = 1e-3) -> Fit:
    """Rates by a projected gradient descent on the sum of squared misses of the targets.

    ``rows`` has ``_n`` and ``_p``. A miss counts relative to the domain's total at a rate of one,
    and a document's rate moves by its posterior times the misses. In that metric the curvature
    is at most one, so the step is one. Rates start at one; each step adds their momentum, goes
    down the gradient and cuts at zero. Rates are written every ``WRITTEN`` steps, so that a step
    repeats only the few since. Each sums expected totals over all documents; only one number per
    domain reaches the driver.

    It ends when all misses are below ``close`` or a step changes none of them by a tenth of that.
    A descent that does not end within ``most`` steps is reported by a warning.
    """
    sums = ", ".join(f"sum(_n * _p[{i}] * _ahead)" for i in range(len(DOMAINS)))
    totals = lambda state: [x or 0.0 for x in state.selectExpr(f"struct({sums}) as t").first().t]
    state = rows.withColumns({"_now": F.lit(1.0), "_ahead": F.lit(1.0)})
    recent: list[list[float]] = []
    ahead = natural = totals(state)
    pace, last, steps, ended = 1.0, [math.inf] * len(DOMAINS), 0, False
    while True:
        miss = [(ahead[i] - targets[d]) / max(natural[i], 1.0) for i, d in enumerate(DOMAINS)]
        ended = max(abs(m) for m in miss) < close or max(abs(m - x) for m, x in zip(miss, last, strict=True)) < close / 10
        if ended or steps == most:
            break
        last = miss
        later = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        recent.append([*miss, (pace - 1) / later])
        if len(recent) == WRITTEN:
            state, recent = written(_moved(state, recent), "rates"), []
        pace, steps = later, steps + 1
        ahead = totals(_moved(state, recent))
    misses = dict(zip(DOMAINS, miss, strict=True))
    if not ended:
        warnings.warn(f"rates have not settled in {most} steps; misses are {misses}", stacklevel=2)
    return Fit(_moved(state, recent).drop("_ahead"), misses, steps, ended)


def _moved(state: DataFrame, steps: list[list[float]]) -> DataFrame:
    """``state`` with its rates after the given steps, each a slope per domain and the momentum.

    The steps are one array, read at an index that Spark cannot fold. So their numbers are data of
    the generated code, which is compiled once for each number of steps.
    """
    width = len(DOMAINS) + 1
    numbers = ", ".join(f"{float(x)!r}D" for step in steps for x in step)
    state = state.selectExpr("_id", "_n", "_p", "_now", "_ahead", f"array({numbers}) as _s")
    for k in range(len(steps)):
        at = [f"_s[size(_p) - {len(DOMAINS)} + {width * k + j}]" for j in range(width)]
        slope = " + ".join(f"_p[{i}] * {at[i]}" for i in range(len(DOMAINS)))
        moved = state.selectExpr("_id", "_n", "_p", "_s", "_now", f"greatest(0D, _ahead - ({slope})) as _next")
        state = moved.selectExpr("_id", "_n", "_p", "_s", "_next as _now", f"_next + {at[-1]} * (_next - _now) as _ahead")
    return state.drop("_s")


def rates(docs: DataFrame, labels: DataFrame, weights: Mapping[str, float], name: Column, as_found: bool = False) -> Fit:
    """The rate of each row of ``docs(doc_id, text)``, called ``name``.

    ``weights`` are the domains' shares of as many tokens as there are; with ``as_found`` they
    multiply what each domain has.
    """
    known = written(posteriors(docs, classifier(docs, labels), name), "posteriors")
    found = [x or 0.0 for x in known.agg(*[F.sum(F.col("_n") * F.col("_p")[i]) for i in range(len(DOMAINS))]).first()]
    scale = found if as_found else [sum(found) / max(sum(weights.values()), 1e-12)] * len(DOMAINS)
    return fit(known, {d: weights[d] * scale[i] for i, d in enumerate(DOMAINS)})


def mix(docs: DataFrame, labels: DataFrame, weights: Mapping[str, float], as_found: bool = False) -> DataFrame:
    """``doc_id`` of every row with ``n_tokens``, a posterior per domain, ``rate`` and ``copies``.

    ``copies`` is the rate rounded up or down by a hash of the row, so that it is right on
    average; ``kept`` rounds to the nearest. Null and empty texts have no tokens and the
    posteriors of a document without features; a row per row, so repeated rows get equal rates; a
    null id stays null and has no label; an empty table gives no rows; other columns are ignored.
    """
    fitted = rates(docs.select("doc_id", "text"), labels, weights, F.col("doc_id"), as_found)
    chance = F.pmod(F.xxhash64("_id", "_n"), F.lit(1 << 20)) / float(1 << 20)
    return fitted.rows.select(
        F.col("_id").alias("doc_id"),
        F.col("_n").alias("n_tokens"),
        *[F.col("_p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)],
        F.col("_now").alias("rate"),
        F.floor(F.col("_now") + chance).cast("long").alias("copies"),
        F.floor(F.col("_now") + 0.5).cast("long").alias("kept"),
    )


def mixed(docs: DataFrame, labels: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """``docs`` as mixed: every row as often as its rate, rounded to the nearest, says.

    ``weights`` multiply what each domain has, so a weight of one keeps a domain as found and a
    weight of zero leaves out what belongs to it. Columns as they are.
    """
    # Rows of one text have one rate, so a digest of the text finds it, and nothing is shuffled but
    # digests as long as few rows are left out or repeated.
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    fitted = rates(docs.select("doc_id", "text"), labels, weights, digest, as_found=True)
    kept = F.floor(F.col("_now") + 0.5).cast("long").alias("_kept")
    # Most rows stay once; only the others have to be looked up.
    other = written(fitted.rows.select(F.col("_id").alias("_digest"), kept).where("_kept <> 1").distinct(), "others")
    names = [f"_{i}" for i in range(len(docs.columns))]
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], digest.alias("_digest"))
    times = F.coalesce("_kept", F.lit(1).cast("long"))
    found = own.join(other, "_digest", "left").select(*names, times.alias("_times")).where("_times > 0")
    return found.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), "_times")).alias("_k")).select(*names).toDF(*docs.columns)
