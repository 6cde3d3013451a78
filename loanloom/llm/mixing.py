"""Mixing to target weights by soft membership, in DataFrame functions only.

1. A labelled table teaches a naive-Bayes classifier: for every domain the tokens that speak most
   for it, and how many of them documents of each domain hold.  Both tables have a fixed size.
2. Every document gets posteriors over the domains, so it counts as part of several of them.
3. Nonnegative rates are fitted by projected gradient so that the expected tokens of each domain,
   summed over rate * tokens * posterior, come to its target.  Gradient steps add up before they
   are projected (dual averaging), so a rate is max(0, 1 - posteriors . total step) at any time
   and a step needs one sum per domain from the cluster.  Documents with equal
   posteriors share their rate, so the sums run over such cells.  Documents whose likeliest
   domain is to be kept have 1 as their least rate instead of 0.
4. A rate says how often a document is wanted: whole copies, and one more with the rest as its
   probability, drawn by hash.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import written

#: At most so many labelled documents teach: those with the least hash of doc_id.
MOST_LABELLED = 20_000
#: Tokens kept for each domain, in how many labelled documents they are at least, and how many
#: times likelier in the domain's documents than in others.
INDICATORS, LEAST_DOCUMENTS, LEAST_RATIO = 256, 3, 4.0
#: Numbers of indicators are told apart up to here, by powers of two.  Posteriors follow from them
#: alone, so three domains give at most LEVELS ** 3 cells.
LEVELS = 8
#: Steps at most; targets count as met so close, and steps as useless with so small a gain.
STEPS, CLOSE, GAIN = 100, 1e-5, 0.005
#: Steps at most of a fit that goes on to the optimum, with momentum and whatever a step gains.
EXACT_STEPS = 300

#: Runs of letters, and runs of anything else but blanks.
_TOKEN = r"(\p{L}+|[^\p{L}\s]+)"


def _tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(_TOKEN), 1), F.array().cast("array<string>"))


def _level(count: Column) -> Column:
    """0, 1, 2-3, 4-7 and so on, as 0, 1, 2, 3 up to LEVELS - 1."""
    return F.least(F.ceil(F.log2(count + F.lit(1))).cast("int"), F.lit(LEVELS - 1))


def _counted(tokens: Column, indicators: list[str]) -> Column:
    if not indicators:
        return F.lit(0)
    return F.size(F.array_intersect(tokens, F.array(*[F.lit(t) for t in indicators])))


class Classifier:
    """Indicator tokens of each domain and log-probabilities of their levels, as plain numbers."""

    def __init__(self, taught: DataFrame, domains: list[str]):
        """``taught`` has ``text`` and ``domain``; it is read twice and never collected."""
        self.domains = domains
        known = taught.where(F.col("domain").isin(domains)).select(
            "domain", F.array_distinct(_tokens(F.col("text"))).alias("tokens")
        )
        known = written(known, "taught")
        of = lambda d: F.sum((F.col("domain") == d).cast("long"))
        sizes = known.agg(*[of(d) for d in domains]).first()
        self.sizes = [n or 0 for n in sizes]
        total = sum(self.sizes)
        names = [f"n{k}" for k in range(len(domains))]
        seen = (
            known.select("domain", F.explode("tokens").alias("token"))
            .groupBy("token")
            .agg(*[of(d).alias(n) for d, n in zip(domains, names, strict=True)])
            .withColumn("n", reduce(lambda a, b: a + b, map(F.col, names)))
            .where(F.col("n") >= LEAST_DOCUMENTS)
        )
        seen = written(seen, "tokens")
        self.indicators = []
        for name, size in zip(names, self.sizes, strict=True):
            if not size:
                self.indicators.append([])
                continue
            inside = (F.col(name) + 0.5) / (size + 1.0)
            outside = (F.col("n") - F.col(name) + 0.5) / (total - size + 1.0)
            speaks = F.col(name) * F.log(inside / outside)
            best = seen.where(inside >= LEAST_RATIO * outside).orderBy(F.desc(speaks), "token").limit(INDICATORS)
            self.indicators.append([r["token"] for r in best.select("token").collect()])
        self.levels = self._learn_levels(known)

    def _learn_levels(self, known: DataFrame) -> list[list[list[float]]]:
        """``[indicator set][domain][level]``: log-probabilities."""
        levels = [_level(_counted(F.col("tokens"), i)) for i in self.indicators]
        rows = (
            known.select("domain", F.posexplode(F.array(*levels)).alias("set", "level"))
            .groupBy("domain", "set", "level")
            .count()
            .collect()
        )
        seen = {(r["set"], r["domain"], r["level"]): r["count"] for r in rows}
        return [
            [
                [
                    math.log((seen.get((s, d, v), 0) + 0.5) / (n + 0.5 * LEVELS))
                    for v in range(LEVELS)
                ]
                for d, n in zip(self.domains, self.sizes, strict=True)
            ]
            for s in range(len(self.domains))
        ]

    def _scores(self, levels: Column) -> Column:
        """Log-probabilities in the order of the domains, but for a constant; null for those that
        no label teaches."""
        total, count = sum(self.sizes), len(self.domains)
        scores = []
        for k, size in enumerate(self.sizes):
            if not size:
                scores.append(F.lit(None).cast("double"))
                continue
            score = F.lit(math.log((size + 1) / (total + count)))
            for s in range(count):
                table = F.array(*[F.lit(x) for x in self.levels[s][k]])
                score = score + F.get(table, F.get(levels, F.lit(s)))
            scores.append(score)
        return F.array(*scores)

    def add(self, df: DataFrame) -> DataFrame:
        """``df(tokens)`` with ``p``."""
        levels = F.array(*[_level(_counted(F.col("tokens"), i)) for i in self.indicators])
        df = df.withColumn("levels", levels).withColumn("scores", self._scores(F.col("levels")))
        top = F.array_max("scores")
        odds = df.withColumn("odds", F.transform("scores", lambda s: F.exp(s - top)))
        # A domain without labels has its prior whatever the text, the others share the rest.
        prior = [(n + 1) / (sum(self.sizes) + len(self.domains)) for n in self.sizes]
        taught = [k for k, n in enumerate(self.sizes) if n]
        rest = sum(prior[k] for k in taught)
        whole = reduce(lambda a, b: a + b, [F.get("odds", F.lit(k)) for k in taught], F.lit(0.0))
        p = [
            F.get("odds", F.lit(k)) / whole * rest if n else F.lit(prior[k])
            for k, n in enumerate(self.sizes)
        ]
        return odds.withColumn("p", F.array(*p)).drop("levels", "scores", "odds")


def rate(p: Column, step: list[float], kept: tuple[int, ...] = ()) -> Column:
    """The rate of posteriors ``p`` after gradient steps that add up to ``step``: at least 1 where
    one of the domains ``kept`` is (as) likely as any, else at least 0."""
    along = reduce(lambda a, b: a + b, [F.get(p, F.lit(k)) * x for k, x in enumerate(step)])
    least = F.lit(0.0)
    if kept:
        stays = F.greatest(*[F.get(p, F.lit(k)) for k in [*kept, kept[0]]]) >= F.array_max(p)
        least = F.when(stays, 1.0).otherwise(0.0)
    return F.greatest(least, F.lit(1.0) - along)


def fit(
    cells: DataFrame,
    shares: list[float],
    epochs: float = 1.0,
    kept: tuple[int, ...] = (),
    exact: bool = False,
) -> list[float]:
    """The total step of projected-gradient least squares over ``cells(p, tokens)``.

    Targets are shares of ``epochs`` times all tokens.  Minimises the sum over domains of
    (expected tokens - target)^2, each divided by how far rates can move it, from rate 1 on; stops
    when no target is missed by more than CLOSE of all tokens, when a step lowers the sum by less
    than a share of GAIN, or after STEPS steps.  With ``exact`` the gradient is taken ahead of the
    last step (Nesterov's momentum), which closes in with the square of the number of steps; then
    only CLOSE or EXACT_STEPS end the fit, since the sum may rise for a while.
    """
    domains = range(len(shares))
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return [0.0 for _ in domains]
    budget = total * epochs
    p = lambda k: F.get("p", F.lit(k))
    gram = cells.agg(
        *[F.sum(F.col("tokens") * p(i) * p(j)) / total for i in domains for j in domains]
    ).first()
    gram = [[gram[i * len(shares) + j] for j in domains] for i in domains]
    weight = [1 / gram[k][k] if gram[k][k] > 0 else 0.0 for k in domains]
    # Row sums bound the largest eigenvalue of the weighted problem.
    steepest = max(
        sum(gram[i][j] * math.sqrt(weight[i] * weight[j]) for j in domains) for i in domains
    )
    if LEVELS ** len(shares) <= 4096:
        cells = cells.coalesce(1)  # so few rows that one task adds them up without a shuffle
    step = [0.0 for _ in domains]
    last, before = step, math.inf
    for count in range(EXACT_STEPS if exact else STEPS):
        sums = cells.select("p", (F.col("tokens") * rate(F.col("p"), step, kept)).alias("wanted")).agg(
            *[F.sum(F.col("wanted") * p(k)) for k in domains]
        )
        missed = [
            (got - share * budget) / total
            for got, share in zip(sums.first(), shares, strict=True)
        ]
        loss = sum(w * m * m for w, m in zip(weight, missed, strict=True))
        if max(map(abs, missed)) < CLOSE or not exact and loss > before * (1 - GAIN):
            break
        before = loss
        moved = [y + w * m / steepest for y, w, m in zip(step, weight, missed, strict=True)]
        ahead = count / (count + 3) if exact else 0.0
        step = [y + ahead * (y - x) for x, y in zip(last, moved, strict=True)]
        last = moved
    return step


def mix(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float],
    epochs: float = 1.0,
    most_labelled: int = MOST_LABELLED,
    kept: tuple[str, ...] = (),
    exact: bool = False,
) -> DataFrame:
    """``row`` (a struct of the columns of ``docs``), ``n_tokens``, ``p`` (posteriors in the order
    of the sorted domains), ``rate`` and ``copies``, one row per input row.

    ``labels(doc_id, domain)`` may hold any domain; those without a target teach nothing, and of
    several labels of a document the least counts.  ``targets`` are shares of all tokens
    times ``epochs``.  Null and empty texts have no tokens and the domains' prior as
    posteriors.  Domains that no label teaches are spread by the prior alone.  Documents whose
    likeliest domain is one of ``kept`` get a rate of one or more, whatever the targets.  With
    ``exact`` the fit goes on to the optimum, see ``fit``.
    """
    domains = sorted(targets)
    staying = tuple(domains.index(d) for d in kept)
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    taught = (
        labels.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains))
        .groupBy("doc_id")
        .agg(F.min("domain").alias("domain"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most_labelled)
    )
    # At most most_labelled rows of an id and a name.
    known = packed.select("row.doc_id", F.col("row.text").cast("string").alias("text")).join(
        F.broadcast(taught), "doc_id"
    )
    model = Classifier(known.select("text", "domain"), domains)
    tokens = packed.withColumn("tokens", _tokens(F.col("row.text").cast("string")))
    tokens = tokens.withColumn("n_tokens", F.size("tokens").cast("long")).withColumn(
        "tokens", F.array_distinct("tokens")
    )
    # Rows with their posteriors are written, so that the texts are read into tokens once.
    scored = written(model.add(tokens).drop("tokens"), "posteriors")
    cells = written(
        scored.groupBy("p").agg(F.sum("n_tokens").cast("double").alias("tokens")), "cells"
    )
    step = fit(cells, [targets[d] for d in domains], epochs, staying, exact)
    drawn = F.pmod(F.xxhash64("row.doc_id", "row.text"), F.lit(1 << 20)) / float(1 << 20)
    return scored.withColumn("rate", rate(F.col("p"), step, staying)).withColumn(
        "copies", F.floor(F.col("rate") + drawn).cast("int")
    )
