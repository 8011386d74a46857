"""Quality rules as a learned decision list.  [operator 1, native]

``text_statistics`` measures every whole text with built-in functions only.
``learn`` grows a decision list by sequential covering: a rule is a conjunction
of thresholds on those statistics that covers low-quality documents.  Literals
are added while they raise FOIL gain on two thirds of the labelled rows, the
rule is then pruned from its end on the other third, and the rows that it
covers are set aside before the next rule.  The list is applied as one ordered
``CASE WHEN``.

Everything that learning needs is a table of counts by (feature, bin, label,
fold): Spark sums it over all labelled rows and a few hundred numbers reach the
driver, whatever the size of the input.

Cases with a defined result
  null text        no word: all statistics 0, base_failed true, kept false
  empty text       the same
  no whitespace    one word, whatever its length
  null doc_id      measured and judged like any other row; it has no label
  repeated rows    each is judged by itself
  very long text   measured whole
  ties             of literals with equal gain the one whose feature and threshold
                   sort last is taken; a value equal to a threshold is not above it
  empty table      an empty result
  no labels        an empty list: kept is the negation of base_failed
  extra columns    ignored; only doc_id and text are read
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20
#: fixed values: the characters that count as symbols, and the word separators
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: What a literal of a rule may test, from the columns of text_statistics.
FEATURES = {
    "words": "n_words",
    "word_length": "word_chars / n_words",
    "symbol_share": "n_symbols / word_chars",
    "upper_share": "n_upper / word_chars",
    "repeat_share": "n_repeat_words / n_words",
    "dup_line_share": "n_dup_lines / n_lines",
    "distinct_share": "n_distinct_words / n_words",
}
_QUANTILES = [0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.93, 0.96, 0.98, 0.99, 0.995]


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every text; long columns, 0 for a null text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id"), text.alias("t"))
    base = base.withColumn("w", F.filter(F.split(F.translate("t", SPACES, " " * len(SPACES)), " "), lambda x: x != ""))
    base = base.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0))
    base = base.withColumn("wh", F.transform("w", lambda x: F.xxhash64(x)))
    n = F.size("w")
    windows = F.transform(
        F.slice("wh", F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(F.col("wh"), i + k) for k in range(1, WINDOW)]),
    )
    base = base.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("t") - F.length(F.translate("t", UPPER, ""))).cast("long").alias("n_upper"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("wh")).cast("long").alias("n_distinct_words"),
        windows.alias("h"),
    )
    # Only a text that repeats a window is sorted: equal hashes then stand side by side.
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    pairs = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    base = base.withColumn("s", F.when(repeats, pairs)).drop("h")
    s = F.col("s")
    again = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
    base = base.withColumn("p", F.array_sort(F.transform(again, lambda x: x["p"]))).drop("s")
    # Windows overlap: from each start count to the next start, WINDOW words at most.
    p = F.col("p")
    covered = F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    done = base.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("p")
    # A generator's output: a later filter on a statistic stays above it and does not
    # repeat the array expressions that the statistic is made of.
    return done.select(F.inline(F.array(F.struct(*done.columns))))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def _feature(name: str) -> Column:
    """A double; 0 where the text has no word."""
    return F.when(F.col("n_words") > 0, F.expr(FEATURES[name]).cast("double")).otherwise(0.0)


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = _feature(self.feature)
        return x > self.threshold if self.above else x <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Literal, ...]


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for literal in rule:
        out = out & literal.column()
    return out


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one conditional: false at the first rule that holds."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(holds(rule), F.lit(False)).otherwise(out)
    return out


def learn(statistics: DataFrame, labels: DataFrame, *, max_rules: int = 8, max_literals: int = 3, min_precision: float = 0.95, min_cover: int = 5) -> list[Rule]:
    """Rules for ``labels.quality = 0``, in order.

    A rule is taken while at least ``min_precision`` of what it covers on either
    fold is of low quality and it covers ``min_cover`` growing rows.
    """
    marks = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = statistics.join(marks, "doc_id").select(
        (F.col("quality") == 0).alias("bad"),
        (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0).alias("prune"),
        *[_feature(f).alias(f) for f in FEATURES],
    )
    cuts_row = known.agg(*[F.percentile_approx(f, _QUANTILES, 2000).alias(f) for f in FEATURES]).head()
    cuts = {f: sorted(set(cuts_row[f] or [])) for f in FEATURES}
    if not any(cuts.values()):
        return []

    def bin_of(f: str) -> Column:
        out = F.lit(0)
        for c in cuts[f]:
            out = out + (F.col(f) > c).cast("int")
        return out.alias(f)

    binned = known.select("bad", "prune", *[bin_of(f) for f in FEATURES])
    compact = binned.groupBy(*binned.columns).agg(F.count("*").alias("n")).persist()

    def inside(literals: list[tuple[str, bool, int]]) -> Column:
        out = F.lit(True)
        for f, above, b in literals:
            out = out & (F.col(f) > b if above else F.col(f) <= b)
        return out

    def table(where: Column) -> dict[tuple[str, bool, bool], list[int]]:
        """For each feature, label and fold, the number of rows in each bin."""
        cells = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in FEATURES]))
        got = compact.filter(where).select("bad", "prune", "n", cells.alias("c")).groupBy("c.f", "c.b", "bad", "prune").agg(F.sum("n").alias("n")).collect()
        out = {(f, bad, prune): [0] * (len(cuts[f]) + 1) for f in FEATURES for bad in (False, True) for prune in (False, True)}
        for r in got:
            out[r["f"], r["bad"], r["prune"]][r["b"]] += r["n"]
        return out

    any_feature = next(iter(FEATURES))
    rules: list[Rule] = []
    refused: set[str] = set()  # features from which no good rule could be grown
    free = F.lit(True)
    try:
        while len(rules) < max_rules:
            literals: list[tuple[str, bool, int]] = []
            counts = table(free)
            totals = []
            while True:
                bad, good = sum(counts[any_feature, True, False]), sum(counts[any_feature, False, False])
                totals.append((bad, good, sum(counts[any_feature, True, True]), sum(counts[any_feature, False, True])))
                if len(literals) == max_literals or good == 0 or bad < min_cover:
                    break
                skip = set() if literals else refused
                best = max((c for c in _candidates(counts, cuts, bad, good, min_cover) if c[1][0] not in skip), default=None)
                if best is None:
                    break
                literals.append(best[1])
                counts = table(free & inside(literals))
            if not literals:
                break
            length = _pruned_length(totals, min_precision, min_cover)
            if not length:
                refused.add(literals[0][0])
                continue
            literals = literals[:length]
            refused.clear()
            rules.append(tuple(Literal(f, above, cuts[f][b]) for f, above, b in literals))
            free = free & ~inside(literals)
    finally:
        compact.unpersist()
    return rules


def _candidates(counts: dict, cuts: dict, bad: int, good: int, min_cover: int):
    """(FOIL gain, literal) of every threshold on every feature, in either direction."""
    from math import log2

    before = log2(bad / (bad + good))
    for f in FEATURES:
        b_at, g_at = counts[f, True, False], counts[f, False, False]
        low_b = low_g = 0
        for k in range(len(cuts[f])):
            low_b, low_g = low_b + b_at[k], low_g + g_at[k]
            for above, p, n in ((True, bad - low_b, good - low_g), (False, low_b, low_g)):
                if p >= min_cover and p + n < bad + good:
                    gain = p * (log2(p / (p + n)) - before)
                    if gain > 1e-9:
                        yield gain, (f, above, k)


def _pruned_length(totals: list[tuple[int, int, int, int]], min_precision: float, min_cover: int) -> int:
    """The number of leading literals with the best worth on the pruning fold; 0 if none is precise enough."""
    def good_enough(k: int) -> bool:
        bad, good, prune_bad, prune_good = totals[k]
        return bad >= min_cover and bad >= min_precision * (bad + good) and prune_bad >= min_precision * (prune_bad + prune_good)

    def worth(k: int) -> float:
        _, _, p, n = totals[k]
        return (p - n) / (p + n) if p + n else -1.0

    return max(filter(good_enough, range(1, len(totals))), key=lambda k: (worth(k), totals[k][2], -k), default=0)


def apply_rules(docs: DataFrame, labels: DataFrame, materialize=None, **options) -> DataFrame:
    """doc_id, statistics, base_failed, kept, rule (its place in the list from 1, or null)."""
    statistics = text_statistics(docs)
    if materialize is not None:
        statistics = materialize(statistics)
    rules = learn(statistics, labels, **options)
    number = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        number = F.when(holds(rules[k - 1]), F.lit(k)).otherwise(number)
    judged = statistics.withColumns({"base_failed": base_failed(), "rule": number})
    return judged.withColumn("kept", ~F.col("base_failed") & verdict(rules))
