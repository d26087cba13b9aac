"""Quality rules: base statistics of texts and a learned decision list.

Sequential covering reads labelled statistics (a bounded sample of the labelled
documents) and emits an ordered list of rules. A rule is a conjunction of
thresholds ``statistic >= x`` or ``statistic < x`` that says "reject". Each rule
is grown on two thirds of the rows that no earlier rule covers, by the
condition of highest gain, until it covers no accepted row; it is pruned on the
other third by dropping final conditions while that raises (p - n) / (p + n).
A rule that is not precise enough on both parts is discarded, and the next one
starts from another statistic; the list ends when none is left: neither rules nor
conditions are capped. What no rule covers is kept. The list becomes one chain of Spark conditions.

All statistics are DataFrame functions over whole texts, linear or
linearithmic in the text's length. A null text counts as empty: no words, and
every count 0; the ratios of empty texts are 0. Extra columns pass through
untouched; statistics are made under the names in STATS, replacing any columns
of those names. Repeated rows get equal values. An empty table gives no rows;
without labelled rows of both kinds the learned list is empty and only the base
rule decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclattice.llm.common import WORD, count_words, let, words_of

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "mark_ratio", "digit_ratio", "pipe_ratio"]
STATS = [*BASE, *RATIOS]
#: Most labelled rows that the list is learned from (the first by a hash of doc_id).
SAMPLE = 20_000


def repeat_words(words: Column) -> Column:
    """Words inside of 3-word windows that a text has twice or more, the first included."""
    hashes = let(
        words,
        lambda w: F.when(
            F.size(w) >= 3,
            F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1))),
        ).otherwise(F.array().cast("array<bigint>")),
    )

    def covered(h: Column) -> Column:
        # Windows sorted by hash, those equal to a neighbour, then their places in order.
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        pairs = let(ordered, lambda s: F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))))
        places = F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
        steps = let(places, lambda p: F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda n, x: n + x)

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))).cast("long")


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the columns of STATS."""
    t = F.coalesce(F.col(text), F.lit(""))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("long")
    lines = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    first = docs.drop(*STATS).withColumns(
        {
            "n_words": count_words(F.col(text)),
            "word_chars": (F.length(t) - F.length(F.regexp_replace(t, WORD, ""))).cast("long"),
            "n_symbols": count(r"[#*$%&|<>]"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": repeat_words(words_of(F.col(text))),
        }
    )
    return first.withColumns(
        {
            "mean_word": over(F.col("word_chars"), F.col("n_words")),
            "symbol_ratio": over(F.col("n_symbols"), F.col("n_words")),
            "dup_line_ratio": over(F.col("n_dup_lines"), F.col("n_words")),
            "repeat_ratio": over(F.col("n_repeat_words"), F.col("n_words")),
            "upper_ratio": over(count(r"\p{Lu}"), F.col("word_chars")),
            "mark_ratio": over(count(r"[!?.,;:]"), F.col("n_words")),
            "digit_ratio": over(count("[0-9]"), F.col("word_chars")),
            "pipe_ratio": over(count(r"(?<=[ \n])\|(?=[ \n])"), F.col("n_words")),
        }
    )


@dataclass(frozen=True)
class Condition:
    stat: str
    at_least: bool
    value: float

    def holds(self, row) -> bool:
        return (row[self.stat] >= self.value) == self.at_least

    def column(self) -> Column:
        return F.col(self.stat) >= self.value if self.at_least else F.col(self.stat) < self.value


def best_condition(rows: list[dict], stats: list[str]) -> Condition | None:
    """The threshold of most FOIL gain: rejected rows it leaves times the rise of their share's logarithm."""
    from math import log2

    total = sum(r["reject"] for r in rows)
    if not total or total == len(rows):
        return None
    start, best, found = log2(total / len(rows)), 0.0, None
    for s in stats:
        ordered = sorted((r[s], r["reject"]) for r in rows)
        p = n = 0
        for i, (value, reject) in enumerate(ordered):
            if i and value != ordered[i - 1][0]:
                cut = (value + ordered[i - 1][0]) / 2
                for at_least, pos, size in ((False, p, n), (True, total - p, len(rows) - n)):
                    if pos and (gain := pos * (log2(pos / size) - start)) > best:
                        best, found = gain, Condition(s, at_least, cut)
            p, n = p + reject, n + 1
    return found


def covers(rule: list[Condition], row) -> bool:
    return all(c.holds(row) for c in rule)


def worth(rule: list[Condition], rows: list[dict]) -> float:
    hit = [r["reject"] for r in rows if covers(rule, r)]
    return (2 * sum(hit) - len(hit)) / len(hit) if hit else -1.0


def learn_list(rows: list[dict], stats: list[str] = STATS, precision: float = 0.9, least: int = 3) -> list[list[Condition]]:
    """Sequential covering. rows: statistics and "reject" (0 or 1), in an order that says nothing."""
    rules: list[list[Condition]] = []
    left, tried = list(rows), set()
    while open_stats :=  [s for s in stats if s not in tried]:
        grow, prune = [r for i, r in enumerate(left) if i % 3], left[::3]
        rule: list[Condition] = []
        inside = grow
        while c := best_condition(inside, stats if rule else open_stats):
            rule.append(c)
            inside = [r for r in inside if c.holds(r)]
        if not rule:
            break
        while len(rule) > 1 and worth(rule[:-1], prune) >= worth(rule, prune):
            rule.pop()
        hit = [r["reject"] for r in left if covers(rule, r)]
        checked = [r["reject"] for r in prune if covers(rule, r)]
        if sum(hit) < least or sum(hit) < precision * len(hit) or sum(checked) < precision * len(checked):
            tried.add(rule[0].stat)
            continue
        rules.append(rule)
        tried.clear()
        left = [r for r in left if not covers(rule, r)]
    return rules


def labelled_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> list[dict]:
    """Statistics and labels of at most so many labelled documents, in the order of a hash. Labels of other documents take no place in the sample."""
    ok = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    held = ok.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = held.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).checkpoint()
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # chosen: at most `most` rows of 12 bytes
    found = with_statistics(joined).select("doc_id", *STATS, (F.col("quality") == 0).cast("int").alias("reject"))
    rows = found.orderBy(F.xxhash64("doc_id"), "doc_id", *STATS).limit(most).collect()
    return [r.asDict() for r in rows]


def rule_column(rules: list[list[Condition]]) -> Column:
    """The number of the first rule that holds, from 1; 0 for none."""
    if not rules:
        return F.lit(0)
    chain = F
    for k, rule in enumerate(rules, 1):
        held = rule[0].column()
        for c in rule[1:]:
            held = held & c.column()
        chain = chain.when(held, k)
    return chain.otherwise(0)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def apply_list(docs: DataFrame, rules: list[list[Condition]], text: str = "text") -> DataFrame:
    """Adds STATS, base_failed, rule (see rule_column) and kept."""
    scored = with_statistics(docs, text).withColumns({"base_failed": base_failed(), "rule": rule_column(rules)})
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
