"""Quality rules: learned decision lists over text statistics, as Spark conditional expressions.

Statistics of every text are built-in expressions over arrays of words, lines and hashed 8-word windows, in
the row: no word is shuffled. Rules are learned from the statistics of all labelled documents by sequential
covering: a rule for the class to reject grows one threshold condition at a time by FOIL's gain on two
thirds of the rows, is pruned to the prefix of conditions that does best on the rest, and the rows it covers
are taken away before the next one, until no rule passes its test. Each step is one aggregation over counts of binned statistics. The
result is an ordered list, emitted as WHEN ... THEN ... OTHERWISE.

Result: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and rule
(the number of the rule that rejected the document, null without one), n_upper, n_distinct.

Nulls and edge cases: a null or empty text has no words, fails the base rules and is not kept; without
labels of both classes the list is empty and keeps what passes the base rules; contradictory, null and
unmatched labels are not learned from; a null doc_id is not matched with labels; equal rows get equal
verdicts; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.lineage import cut

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 8
THRESHOLDS = 15
EXTREMES = (0.005, 0.02, 0.98, 0.995)
MOST_RULES, MOST_CONDITIONS = 32, 3
CELLS_PER_TASK = 100_000
LEAST_PRECISION, LEAST_COVER = 0.9, 5



def _per_word(name: str) -> Column:
    return F.coalesce(F.col(name) / F.nullif(F.col("n_words"), F.lit(0)), F.lit(0.0)).cast("double")


def statistic(name: str) -> Column:
    if name == "n_words":
        return F.col("n_words").cast("double")
    return _per_word({"word_length": "word_chars", "symbols": "n_symbols", "repeats": "n_repeat_words", "upper": "n_upper", "distinct": "n_distinct", "dup_lines": "n_dup_lines"}[name])


NAMES = ("n_words", "word_length", "symbols", "repeats", "upper", "distinct", "dup_lines")


def _neighbours(column: str, gap: int, size: Column) -> Column:
    """Hash of each element with the one ``gap`` places on; ``size`` elements come out."""
    return F.zip_with(F.slice(column, F.lit(1), size), F.slice(column, F.lit(1 + gap), size), lambda a, b: F.xxhash64(a, b))


def measured(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and the base statistics of every document."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    words = documents.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text")).withColumn("w", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(WORD))
    counted = words.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"), F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        lines.alias("l"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.transform("w", lambda x: F.xxhash64(x)).alias("h1"),
    )
    room = lambda n: F.greatest(F.col("n_words").cast("int") - n, F.lit(0))
    kept = ["doc_id", "n_words", "word_chars", "n_symbols", "n_upper", "n_distinct", "n_dup_lines"]
    hashed = counted.withColumn("n_dup_lines", (F.size("l") - F.size(F.array_distinct("l"))).cast("long")).drop("l")
    for gap in (1, 2, 4):  # windows of 2, 4 and 8 words
        hashed = hashed.select(*kept, _neighbours(f"h{gap}", gap, room(2 * gap - 1)).alias(f"h{2 * gap}"))
    hashed = hashed.select(*kept, "h8", (F.size(F.array_distinct("h8")) < F.size("h8")).alias("again"))
    # only texts with a window found twice go on: places of windows, by hash
    placed = F.when(F.col("again"), F.array_sort(F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    placed = hashed.select(*kept, placed.alias("s"))
    same = F.zip_with(F.slice("s", F.lit(1), F.size("s") - 1), F.slice("s", F.lit(2), F.size("s") - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    placed = placed.select(*kept, F.when(F.col("s").isNotNull(), F.sort_array(F.array_distinct(F.flatten(same)))).alias("p"))
    # a window covers WINDOW words, or those up to the next one
    steps = F.zip_with("p", F.slice("p", F.lit(2), F.greatest(F.size("p"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda total, n: total + n)
    return placed.select(*kept, F.when(F.col("p").isNotNull(), covered).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"))


@dataclass(frozen=True)
class Condition:
    name: str
    bin: int  # the statistic's bin is at least this (above) or less (not above)
    above: bool
    threshold: float

    def on_bins(self) -> Column:
        return F.col(f"b_{self.name}") >= self.bin if self.above else F.col(f"b_{self.name}") < self.bin

    def column(self) -> Column:
        return statistic(self.name) > self.threshold if self.above else statistic(self.name) <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass
class DecisionList:
    """Rules in order; the first one whose conditions all hold rejects."""

    rules: list[list[Condition]] = field(default_factory=list)

    def number(self) -> Column:
        """The number of the rule that rejects a row of statistics, from 1; null if none does."""
        if not self.rules:
            return F.lit(None).cast("int")
        cases = [reduce(lambda a, b: a & b, [c.column() for c in rule]) for rule in self.rules]
        return reduce(lambda w, k: w.when(cases[k], k + 1), range(1, len(cases)), F.when(cases[0], 1))

    def __str__(self) -> str:
        return "\n".join(f"{k}. reject if " + " and ".join(map(str, r)) for k, r in enumerate(self.rules, 1))


def _all(conditions: list[Condition]) -> Column:
    return reduce(lambda a, b: a & b, [c.on_bins() for c in conditions], F.lit(True))


def learn(statistics: DataFrame, labels: DataFrame, label: str = "quality", id_column: str = "doc_id") -> DecisionList:
    """Decision list for label 0 from the statistics of all labelled rows. What reaches the driver are counts per bin."""
    clean = labels.select(F.col(id_column).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").select("doc_id", "y")
    rows = cut(statistics.join(clean, "doc_id").select("y", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0).alias("grow"), *[statistic(n).alias(n) for n in NAMES]))
    found = rows.agg(*[F.percentile_approx(n, sorted([k / (THRESHOLDS + 1) for k in range(1, THRESHOLDS + 1)] + list(EXTREMES)), 2000).alias(n) for n in NAMES]).first()
    edges = {n: sorted(set(found[n] or [])) for n in NAMES}
    bins = [reduce(lambda a, t: a + F.when(F.col(n) > t, 1).otherwise(0), edges[n], F.lit(0)).alias(f"b_{n}") for n in NAMES]
    # rows alike in all bins are one
    cells = cut(rows.select("y", "grow", *bins).groupBy("y", "grow", *[f"b_{n}" for n in NAMES]).agg(F.count("*").alias("m")))
    cells = cells.coalesce(cells.count() // CELLS_PER_TASK + 1)
    learned, left = DecisionList(), cells
    while len(learned.rules) < MOST_RULES:
        rule = _grow(left.where("grow"), edges)
        rule = _prune(left.where(~F.col("grow")), rule)
        if not rule:
            break
        bad, good = left.where(_all(rule)).agg(_sum(0), _sum(1)).first()
        if bad < LEAST_COVER or bad < LEAST_PRECISION * (bad + good):
            break
        learned.rules.append(rule)
        left = left.where(~_all(rule))
    return learned


def _sum(y: int, condition: Column | None = None) -> Column:
    return F.coalesce(F.sum(F.when((F.col("y") == y) & (F.lit(True) if condition is None else condition), F.col("m"))), F.lit(0))


def _grow(cells: DataFrame, edges: dict[str, list[float]]) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < MOST_CONDITIONS:
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"b_{n}").alias("bin")) for n in NAMES]))
        counts = cells.where(_all(rule)).select(each.alias("c"), "y", "m").groupBy("c.name", "c.bin").agg(_sum(0).alias("bad"), _sum(1).alias("good")).collect()
        by = {n: {r["bin"]: (r["bad"], r["good"]) for r in counts if r["name"] == n} for n in NAMES}
        bad, good = (sum(v[k] for v in by["n_words"].values()) for k in (0, 1))
        if not bad or not good:
            break
        best, gain = None, 0.0
        for n in NAMES:
            for k, t in enumerate(edges[n], 1):
                over = [sum(v[i] for b, v in by[n].items() if b >= k) for i in (0, 1)]
                for above, (p, q) in ((True, over), (False, (bad - over[0], good - over[1]))):
                    g = p * (math.log2(p / (p + q)) - math.log2(bad / (bad + good))) if p else 0.0
                    if g > gain + 1e-9:
                        best, gain = Condition(n, k, above, t), g
        if best is None:
            break
        rule.append(best)
    return rule


def _prune(cells: DataFrame, rule: list[Condition]) -> list[Condition]:
    """The prefix of the rule with the best (bad - good) / (bad + good) on other rows; the shorter of equals."""
    if not rule:
        return rule
    sums = cells.agg(*[_sum(y, _all(rule[:k])).alias(f"s{k}_{y}") for k in range(1, len(rule) + 1) for y in (0, 1)]).first()
    worth = lambda k: (sums[f"s{k}_0"] - sums[f"s{k}_1"]) / max(1, sums[f"s{k}_0"] + sums[f"s{k}_1"])
    return rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))]


def judged(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Statistics and verdict of every document."""
    statistics = cut(measured(documents, id_column, text_column))
    return verdicts(statistics, learn(statistics, labels))


def verdicts(statistics: DataFrame, rules: DecisionList) -> DataFrame:
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    found = statistics.withColumn("base_failed", failed).withColumn("rule", rules.number().cast("int"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule", "n_upper", "n_distinct")
