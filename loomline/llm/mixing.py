"""Drawing records from several sources in target shares, with capped repetition."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.packing import utf8_tokens
from loomline.session import cut

#: Targets are a table of parameters, collected and turned into literals; more rows than this are an error.
MAX_TARGETS = 10_000


@dataclass(frozen=True)
class Target:
    key: str
    source: str
    weight: float
    max_repeats: int


def read_targets(targets: DataFrame) -> list[Target]:
    """The target rows by trimmed, lower-cased source; rows that agree in it are one target, with the sum of
    their weights and the largest of their limits. Null sources are dropped; null, negative and non-finite
    weights and limits count as 0."""
    rows = targets.select("source", "weight", "max_repeats").limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    merged: dict[str, Target] = {}
    for source, weight, repeats in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        key = source.strip(" \t\r\n").lower()
        weight = float(weight) if weight is not None and math.isfinite(weight) and weight > 0 else 0.0
        old = merged.get(key)
        merged[key] = Target(key, old.source if old else source, weight + (old.weight if old else 0.0), max(int(repeats or 0), old.max_repeats if old else 0, 0))
    return list(merged.values())


def source_key(source: Column) -> Column:
    return F.lower(F.regexp_replace(source, r"^[ \t\r\n]+|[ \t\r\n]+$", ""))


#: Beyond so many standard deviations from its mean, and 40, a Poisson variable is not looked for.
SPREAD = 9.0


def poisson_window(mean: float, cap: int) -> tuple[int, list[float]]:
    """(first, P(X <= k) for k = first, first + 1, ... below the cap): the part of the distribution in which it
    changes. Below ``first`` it is 0, above the last 1, to double precision. Terms are taken in logarithms, so
    any mean will do."""
    if math.isinf(mean):
        return cap, []
    if mean <= 0:
        return 0, [1.0] if cap > 0 else []
    reach = SPREAD * math.sqrt(mean) + 40
    first, last = min(cap, max(0, math.floor(mean - reach))), min(cap, math.ceil(mean + reach))
    logs = (k * math.log(mean) - mean - math.lgamma(k + 1) for k in range(first, last))
    return first, list(itertools.accumulate(math.exp(x) for x in logs))


def capped_mean(mean: float, cap: int) -> float:
    """E[min(X, cap)] of a Poisson variable: the sum of P(X > k) below the cap."""
    first, cdf = poisson_window(mean, cap)
    return first + sum(1.0 - p for p in cdf)


def poisson_rate(target: float, cap: int) -> float:
    """The Poisson mean whose draws, capped, have the target mean; infinite if the target reaches the cap."""
    if target <= 0 or cap <= 0:
        return 0.0
    if target >= cap:
        return math.inf
    low, high = 0.0, max(1.0, target)
    while capped_mean(high, cap) < target:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if capped_mean(middle, cap) < target else (low, middle)
    return (low + high) / 2


def drawn_count(window: Column, uniform: Column) -> Column:
    """The inverse of a capped Poisson distribution at a uniform number. The window is a struct (first, cdf)."""
    return window["first"] + F.size(F.filter(window["cdf"], lambda p: uniform >= p))


def _window(mean: float, cap: int) -> Column:
    first, cdf = poisson_window(mean, cap)
    return F.struct(F.lit(first).alias("first"), F.array(*(F.lit(p) for p in cdf)).cast("array<double>").alias("cdf"))


@dataclass(frozen=True)
class Plan:
    """What the draw will do: budget in tokens, and for each source its texts' tokens and the Poisson mean."""

    budget: int
    targets: list[Target]
    unique_tokens: dict[str, int]
    rates: dict[str, float]

    def wanted(self, t: Target) -> float:
        total = sum(x.weight for x in self.targets)
        return self.budget * t.weight / total if total else 0.0


def _texts(docs: DataFrame, item_id: str, text: str, source: str, keys: list[str]) -> DataFrame:
    """One row for each distinct text with one entry for each source that has it, merged before any shuffle.

    A text is known by two 64-bit hashes and its length; the text itself is never shuffled.
    """
    t = F.col(text)
    tokens = utf8_tokens(t).cast("long")
    known = docs.select(F.col(item_id).alias("_id"), source_key(F.col(source)).alias("_s"), F.xxhash64(t).alias("_h"), F.xxhash64(t, F.lit(7)).alias("_h2"), tokens.alias("_n"))
    per_source = known.where(F.col("_s").isin(keys) & F.col("_n").isNotNull()).groupBy("_h", "_h2", "_n", "_s").agg(F.min("_id").alias("_id"), F.count("*").alias("_rows"))
    return per_source.groupBy("_h", "_h2", "_n").agg(F.array_sort(F.collect_list(F.struct("_s", "_id", "_rows"))).alias("_uses"))


def mix_plan(texts: DataFrame, targets: list[Target], budget_tokens: int | None = None) -> Plan:
    """Sizes of the sources, one aggregation; the budget defaults to all tokens of all rows with a target."""
    use = texts.select("_n", F.explode("_uses").alias("_u")).groupBy(F.col("_u._s").alias("s"))
    sizes = {r.s: r for r in use.agg(F.sum("_n").alias("unique"), F.sum(F.col("_n") * F.col("_u._rows")).alias("all")).collect()}
    budget = budget_tokens if budget_tokens is not None else sum(int(r.all) for r in sizes.values())
    unique = {t.key: int(sizes[t.key].unique) if t.key in sizes else 0 for t in targets}
    plan = Plan(budget, targets, unique, {})
    rates = {t.key: poisson_rate(plan.wanted(t) / unique[t.key], t.max_repeats) if unique[t.key] else 0.0 for t in targets}
    return Plan(budget, targets, unique, rates)


def _uniform(seed: int, source: Column) -> Column:
    """The seeded hash of a text in a source as a number in [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(seed), source, F.col("_h"), F.col("_h2")), F.lit(1 << 53)).cast("double") / float(1 << 53)


def calibrate(texts: DataFrame, plan: Plan, seed: int, rounds: int = 3, grid: int = 16) -> Plan:
    """Moves each source's Poisson mean to where the seeded draw itself, not only its expectation, comes nearest
    to the wanted tokens. The draw of a text grows with the mean, so each round brackets the wanted total
    between two of ``grid`` means, by one aggregation of all texts."""
    rates = dict(plan.rates)
    bounds = {t.key: (rates[t.key] * 0.5, rates[t.key] * 1.5) for t in plan.targets if 0 < rates[t.key] < math.inf}
    caps = {t.key: t.max_repeats for t in plan.targets}
    wanted = {t.key: plan.wanted(t) for t in plan.targets}
    use = texts.select("_h", "_h2", "_n", F.explode("_uses").alias("_u")).select("_h", "_h2", "_n", F.col("_u._s").alias("_s"))
    for _ in range(rounds):
        if not bounds:
            break
        means = {k: [a + (b - a) * i / (grid - 1) for i in range(grid)] for k, (a, b) in bounds.items()}
        windows = F.create_map(*(x for k, ms in means.items() for x in (F.lit(k), F.array(*(_window(m, caps[k]) for m in ms)))))
        drawn = use.where(F.col("_s").isin(list(means))).withColumn("_v", _uniform(seed, F.col("_s")))
        counts = F.transform(F.element_at(windows, F.col("_s")), lambda w: drawn_count(w, F.col("_v")))
        sums = [F.sum(F.col("_c")[i] * F.col("_n")).alias(f"t{i}") for i in range(grid)]
        for r in drawn.select("_s", "_n", counts.alias("_c")).groupBy("_s").agg(*sums).collect():
            k, totals = r["_s"], [r[f"t{i}"] for i in range(grid)]
            best = min(range(grid), key=lambda i: abs(totals[i] - wanted[k]))
            rates[k] = means[k][best]
            above = next((i for i in range(grid) if totals[i] >= wanted[k]), grid - 1)
            bounds[k] = (means[k][max(0, above - 1)], means[k][above])
    return Plan(plan.budget, plan.targets, plan.unique_tokens, rates)


def _draw_counts(texts: DataFrame, plan: Plan, seed: int) -> DataFrame:
    """(source key, id, tokens, drawn, repeats) of every text: the seeded hash of the text, as a uniform number, is
    put through the inverse Poisson distribution of its source, which gives ``drawn``. A text that several sources
    have is drawn for each; its uses in all, ``repeats``, stay within the largest of their limits, given out in
    order of the source names."""
    windows = F.create_map(*(x for t in plan.targets for x in (F.lit(t.key), _window(plan.rates[t.key], t.max_repeats))))
    limit = F.create_map(*(x for t in plan.targets for x in (F.lit(t.key), F.lit(t.max_repeats))))
    drawn = F.transform("_uses", lambda u: drawn_count(F.element_at(windows, u["_s"]), _uniform(seed, u["_s"])))
    shared = F.array_max(F.transform("_uses", lambda u: F.element_at(limit, u["_s"])))
    # What the sources before it in the list leave of the limit.
    before = F.transform("_d", lambda d, i: F.aggregate(F.slice("_d", F.lit(1), i), F.lit(0), lambda a, x: a + x))
    given = F.zip_with("_d", before, lambda d, b: F.greatest(F.lit(0), F.least(d, F.col("_limit") - b)))
    with_counts = texts.select("_h", "_n", "_uses", drawn.alias("_d"), shared.alias("_limit"))
    use = F.explode(F.arrays_zip(F.col("_uses").alias("u"), F.col("_d").alias("d"), given.alias("c")))
    return with_counts.select("_n", use.alias("_x")).select(F.col("_x.u._s").alias("_s"), F.col("_x.u._id").alias("_id"), "_n", F.col("_x.d").alias("drawn"), F.col("_x.c").alias("repeats"))


def draw_counts(docs: DataFrame, targets: DataFrame, *, item_id: str = "doc_id", text: str = "text", source: str = "source", budget_tokens: int | None = None, seed: int = 42) -> tuple[DataFrame, Plan]:
    """(source key, id, tokens, drawn, repeats) of every distinct text of every source with a target, and the plan.

    The texts are read and hashed once: what is drawn from, some 60 bytes a text, is cut in the shared folder.
    """
    wanted = read_targets(targets)
    texts = cut(_texts(docs, item_id, text, source, [t.key for t in wanted]))
    plan = calibrate(texts, mix_plan(texts, wanted, budget_tokens), seed)
    if not wanted:
        kind = dict(docs.dtypes)[item_id]
        return docs.sparkSession.createDataFrame([], f"_s string, _id {kind}, _n long, drawn int, repeats int"), plan
    return _draw_counts(texts, plan, seed), plan


def mix(docs: DataFrame, targets: DataFrame, *, item_id: str = "doc_id", seed: int = 42, **options: object) -> DataFrame:
    """The mixture: (id, source, repeat_no, tokens, shuffle_key), one row for each use of a text, in global random order.

    Poisson replication: each source's target repetition rate is its weight's share of the budget over the
    tokens of its distinct texts. The Poisson mean is chosen so that draws, capped at ``max_repeats``, have that
    mean, and then moved to where the seeded draw itself meets the target; a source too small for its share uses
    every text ``max_repeats`` times. The count of a text comes from the inverse distribution at a hash-seeded
    uniform number, so it depends on the text, its source's mean and the seed, not on partitions. Each text is then exploded by its count, and the uses are range
    partitioned and sorted by a seeded hash, which shuffles them globally.

    Defined cases: sources agree after trimming and lower-casing; rows whose source is null or has no target are
    not drawn; null texts have no tokens and are not drawn, empty texts have a row but add no tokens; equal texts
    of a source are one text, under the lowest id; a text in several sources keeps to the largest of their
    limits in all; targets without texts draw nothing; empty tables give an empty result.
    """
    counts, plan = draw_counts(docs, targets, item_id=item_id, seed=seed, **options)
    names = F.create_map(*(F.lit(x) for t in plan.targets for x in (t.key, t.source))) if plan.targets else F.create_map()
    uses = counts.where("repeats > 0").withColumn("repeat_no", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    keyed = uses.select(
        F.col("_id").alias(item_id),
        (F.element_at(names, F.col("_s")) if plan.targets else F.lit("")).alias("source"),
        "repeat_no",
        F.col("_n").alias("tokens"),
        F.xxhash64(F.lit(seed + 1), "_s", "_id", "repeat_no").alias("shuffle_key"),
    )
    return keyed.repartitionByRange("shuffle_key", item_id).sortWithinPartitions("shuffle_key", item_id)


def mix_report(docs: DataFrame, targets: DataFrame, **options: object) -> DataFrame:
    """One row for each target, from the drawn counts: (source, weight, max_repeats, target_share, target_tokens,
    texts, texts_tokens, capacity_tokens, drawn_texts, drawn_tokens, actual_share, short), where short says that the draw used every
    text of the source ``max_repeats`` times and this holds fewer tokens than its share of the budget."""
    counts, plan = draw_counts(docs, targets, **options)
    total = sum(t.weight for t in plan.targets)
    schema = "_s string, source string, weight double, max_repeats int, target_share double, target_tokens double"
    rows = [(t.key, t.source, t.weight, t.max_repeats, t.weight / total if total else 0.0, plan.wanted(t)) for t in plan.targets]
    planned = docs.sparkSession.createDataFrame(rows, schema)
    n = F.col("_n")
    drawn = counts.groupBy("_s").agg(
        F.count("*").alias("texts"),
        F.sum("_n").alias("texts_tokens"),
        F.sum((F.col("repeats") > 0).cast("long")).alias("drawn_texts"),
        F.sum(F.col("repeats") * n).alias("drawn_tokens"),
        F.sum(F.col("drawn") * n).alias("_full"),
        F.min("drawn").alias("_least"),
    )
    joined = planned.join(drawn, "_s", "left").na.fill(0, ["texts", "texts_tokens", "drawn_texts", "drawn_tokens", "_full"])
    everything = F.sum("drawn_tokens").over(Window.partitionBy(F.lit(0)))  # one row for each target
    share = F.when(everything > 0, F.col("drawn_tokens") / everything).otherwise(0.0)
    used_up = F.col("_least").isNull() | (F.col("_least") >= F.col("max_repeats"))
    # Compared without division: tokens / budget < weight / total.
    short = used_up & (F.col("_full") * F.lit(total) < F.col("weight") * F.lit(float(plan.budget)))
    capacity = F.col("texts_tokens") * F.col("max_repeats")
    return joined.withColumns({"capacity_tokens": capacity, "actual_share": share, "short": short}).drop("_s", "_full", "_least")
