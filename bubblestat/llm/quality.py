"""Quality rules: text statistics and a learned decision list, in DataFrame expressions only."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut

#: Words in a window, of which repeats count.
WINDOW = 5
#: Shares and means that rules put thresholds on; all are functions of the counts below.
FEATURES = {
    "words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "shouts": "n_shouts / greatest(n_words, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
}


def with_counts(docs: DataFrame) -> DataFrame:
    """Each row of docs as a struct `_row`, and a struct `_q` of counts over its whole text (null counts as empty).

    Long arrays are columns of their own, used more than once, so that Spark computes each once a row. A text whose
    windows all differ skips the sort.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    removed = lambda chars: F.char_length("_t") - F.char_length(F.translate("_t", chars, ""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    one = docs.select(row, t.alias("_t"), F.regexp_extract_all(t, F.lit(f"[^{SPACE}]+"), F.lit(0)).alias("_w"), F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("_l"))
    n = F.size("_w")
    grams = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_w", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    two = one.select("*", grams.alias("_g"))
    ordered = F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    three = two.select("*", F.coalesce(ordered, F.array().cast("array<struct<h:bigint,i:int>>")).alias("_s"))
    twice = F.filter("_s", lambda s, k: (F.get("_s", k - 1)["h"] == s["h"]) | (F.get("_s", k + 1)["h"] == s["h"]))
    four = three.select("*", F.sort_array(F.transform(twice, lambda s: s["i"])).alias("_p"))
    reach = F.transform("_p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", k + 1) - p, F.lit(WINDOW))))
    counts = {
        "n_words": n,
        "word_chars": F.char_length("_t") - removed(" \t\n\x0b\f\r"),
        "n_symbols": removed("#*$%&|<>"),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": F.aggregate(reach, F.lit(0), lambda a, x: a + x),
        "n_lines": F.size("_l"),
        "n_capitals": removed("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_shouts": removed("!"),
        "n_digits": removed("0123456789"),
    }
    packed = F.struct(*[v.cast("long").alias(k) for k, v in counts.items()])
    return four.select("_row", packed.alias("_q"))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; the first that holds rejects a text, and a text that none fits is kept."""

    rules: tuple[tuple[Condition, ...], ...] = ()

    def kept(self) -> Column:
        """One conditional expression over the count columns."""
        out = None
        for rule in self.rules:
            holds = reduce(Column.__and__, [c.column() for c in rule])
            out = F.when(holds, False) if out is None else out.when(holds, False)
        return F.lit(True) if out is None else out.otherwise(True)


def learn(counted: DataFrame, labels: DataFrame, *, bins: int = 24, max_rules: int = 8, max_conditions: int = 3, min_precision: float = 0.9, min_support: int = 5) -> DecisionList:
    """A decision list for quality 0, by sequential covering over all labelled texts.

    counted: doc_id and the count columns; labels: doc_id, quality. Rows whose quality is not 0 or 1 teach nothing. Two thirds
    (by a hash of doc_id) grow rules by information gain; the rest prune each to the prefix of its conditions
    that is purest there. A rule that rejects too few or, there, is right too seldom ends the list. Spark counts classes by feature and
    quantile bin; only those counts (features x bins) reach the driver. No labelled rows: the empty list, which keeps all.
    """
    names = list(FEATURES)
    values = [F.expr(v).alias(k) for k, v in FEATURES.items()]
    y = labels.where(F.col("quality").isin(0, 1)).select("doc_id", (F.col("quality") == 0).cast("int").alias("y"))
    rows = cut(counted.join(y, "doc_id").select("y", (F.abs(F.xxhash64("doc_id")) % 3 > 0).alias("grow"), *values), "quality")
    cuts = rows.agg(*[F.percentile_approx(c, [i / bins for i in range(bins)], 2000).alias(c) for c in names]).first()
    if cuts[0] is None:
        return DecisionList()
    cuts = {c: sorted(set(cuts[c])) for c in names}
    binned = cut(rows.select("y", "grow", *[sum([(F.col(c) > t).cast("int") for t in cuts[c]], F.lit(0)).alias(c) for c in names]), "quality")
    holds = lambda rule: reduce(Column.__and__, [F.col(c) > k if above else F.col(c) <= k for c, above, k in rule], F.lit(True))
    left, rules = binned, []
    while len(rules) < max_rules:
        rule: list[tuple[str, bool, int]] = []
        while len(rule) < max_conditions and (best := _best(left.where("grow").where(holds(rule)), names, min_support)):
            rule.append(best[0])
            if not best[1]:
                break
        rule = _pruned(left.where("not grow"), rule, holds, min_precision, min_support)
        if not rule:
            break
        rules.append(tuple(rule))
        left = left.where(~holds(rule))
    return DecisionList(tuple(tuple(Condition(c, above, cuts[c][k]) for c, above, k in rule) for rule in rules))


def _best(rows: DataFrame, names: list[str], least: int) -> tuple[tuple[str, bool, int], int] | None:
    """The condition of most gain, and how many good texts still fit it; bin > k is value > cuts[k]."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("b")) for c in names])).alias("x")
    got = rows.select("y", pairs).groupBy("x.f", "x.b").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")).collect()
    table: dict[str, dict[int, tuple[int, int]]] = {c: {} for c in names}
    for r in got:
        table[r["f"]][r["b"]] = (r["p"], r["n"])
    some = table[names[0]].values()
    all_p, all_n = sum(p for p, _ in some), sum(n for _, n in some)
    if all_p < least or not all_n:
        return None
    base, best = math.log2(all_p / (all_p + all_n)), None
    for c in names:
        for k in sorted(table[c])[:-1]:
            low = [sum(v[i] for b, v in table[c].items() if b <= k) for i in (0, 1)]
            for above, (p, n) in ((False, low), (True, (all_p - low[0], all_n - low[1]))):
                if p >= least:
                    gain = p * (math.log2(p / (p + n)) - base)
                    if gain > 1e-9 and (best is None or gain > best[0]):
                        best = (gain, (c, above, k), n)
    return best and (best[1], best[2])


def _pruned(rows: DataFrame, rule: list, holds, precision: float, least: int) -> list:
    """The prefix of the rule that is purest on rows (the shortest of equals), or none."""
    if not rule:
        return []
    ends = range(1, len(rule) + 1)
    fits = [holds(rule[:i]) for i in ends]
    sums = rows.agg(*[F.count_if(f & (F.col("y") == v)).alias(f"s{v}_{i}") for i, f in enumerate(fits) for v in (0, 1)]).first()
    scored = [((p - n) / max(p + n, 1), -i) for i in range(len(rule)) for p, n in [(sums[f"s1_{i}"], sums[f"s0_{i}"])]]
    score, i = max(scored)
    p, n = sums[f"s1_{-i}"], sums[f"s0_{-i}"]
    return rule[: 1 - i] if p + n >= max(2, least // 2) and p >= precision * (p + n) else []


def judged(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, the count columns, base_failed and kept: one row for each of docs, with a list learned from labels.

    The text is scanned once: counts are written, taught from and judged. Repeated and null doc_ids stay rows of their own (a
    null joins no label). Other columns are ignored. Empty table: empty result.
    """
    counted = cut(with_counts(docs.select("doc_id", "text")).select("_row.doc_id", "_q.*"), "quality")
    rules = learn(counted, labels, **how)
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return counted.select("*", failed.alias("base_failed"), (~failed & rules.kept()).alias("kept"))


def passing(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that the base rules and the learned list keep, with all their columns."""
    counted = cut(with_counts(docs), "quality")
    rules = learn(counted.select("_row.doc_id", "_q.*"), labels, **how)
    verdict = counted.select("_row", "_q.*").where(~base_failed(F.col("n_words"), F.col("n_repeat_words")) & rules.kept())
    return verdict.select("_row.*")
