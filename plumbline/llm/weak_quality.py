"""Quality rules as weak supervision: rules vote good, bad or abstain, and a posterior replaces all-must-pass filtering.

Every rule looks at one measure of the whole text and votes 1 (good), -1 (bad) or 0 (abstains). Expectation
maximisation treats the true class as hidden: from the votes alone it estimates each rule's chance of every vote under
either class, and the share of good documents. Documents matter only through their vote pattern, so patterns are counted
once over all documents (at most 3 to the number of rules rows) and the iterations run on that table. DataFrame
operations only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import SPACE_CLASS, hidden, need, quoted, whole_text, words_of
from plumbline.session import cut_lineage

# fixed values: characters that count as symbols
SYMBOLS = "#*$%&|<>"
#: Bits of a window's place; no string holds so many words.
PLACE_BITS = 30


@dataclass(frozen=True)
class Rule:
    """Votes good where ``good`` holds, else bad where ``bad`` holds, else abstains; both are SQL over the measures."""

    name: str
    good: str
    bad: str

    def vote(self) -> Column:
        return F.when(F.expr(self.good), 1).when(F.expr(self.bad), -1).otherwise(0).cast("tinyint")


RULES = (
    Rule("length", "n_words >= 50", "n_words < 5"),
    Rule("mean_word", "word_chars BETWEEN 3 * n_words AND 10 * n_words", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    Rule("symbols", "50 * n_symbols <= n_words", "5 * n_symbols > n_words"),
    Rule("symbol_runs", "30 * n_symbol_runs <= n_words", "6 * n_symbol_runs > n_words"),
    Rule("lone_symbols", "50 * n_lone_symbols <= n_words AND 50 * n_symbol_runs <= n_words", "10 * n_lone_symbols > n_words"),
    Rule("letters", "20 * n_other <= 3 * word_chars", "4 * n_other > word_chars"),
    Rule("line_copies", "20 * n_dup_lines <= n_lines", "3 * n_dup_lines > n_lines"),
    Rule("window_copies", "20 * n_repeat_words <= n_words", "4 * n_repeat_words > n_words"),
    Rule("capitals", "8 * n_upper <= word_chars", "3 * n_upper > word_chars"),
    Rule("digits", "20 * n_digits <= word_chars", "4 * n_digits > word_chars"),
    Rule("sentences", "n_stops > 0 AND n_words <= 60 * n_stops", "n_words > 25 AND 150 * n_stops < n_words"),
    Rule("exclaims", "40 * n_exclaims <= n_words", "5 * n_exclaims > n_words"),
    Rule("variety", "n_distinct * 10 >= 4 * n_words OR (n_words > 600 AND n_distinct >= 200)", "n_words > 25 AND n_distinct * 10 < n_words"),
)
ROUNDS, SMOOTHING, THRESHOLD = 20, 4.0, 0.5
# prior chances of the votes under good and under bad
PRIOR_GOOD, PRIOR_BAD = {-1: 0.05, 0: 0.25, 1: 0.7}, {-1: 0.4, 0: 0.3, 1: 0.3}


def _without(text: Column, characters: str) -> Column:
    return F.regexp_replace(text, f"{characters}+", "")


def _window_hash(words: Column, at: Column) -> Column:
    return F.xxhash64(F.get(words, at), F.get(words, at + 1), F.get(words, at + 2))


def _sorted_windows(words: Column) -> Column:
    """The 3-word windows as one sorted array of longs: the low bits of the window's hash above, its place below."""
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
    return F.sort_array(F.transform(starts, lambda _, i: F.shiftleft(_window_hash(words, i), PLACE_BITS).bitwiseOR(i.cast("bigint"))))


def _maybe_twins(windows: Column) -> Column:
    """Windows whose short hash a neighbour has as well: all repeated ones and very few others."""

    def short(x: Column) -> Column:
        return F.shiftright(x, PLACE_BITS)

    return F.filter(windows, lambda x, i: (short(x) == short(F.get(windows, i - 1))) | (short(x) == short(F.get(windows, i + 1))))


def _repeat_words(words: Column, candidates: Column) -> Column:
    """Words inside 3-word windows found twice or more: sort the candidates by whole hash, keep those with an equal neighbour."""

    def whole(x: Column) -> Column:
        place = x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
        return F.struct(_window_hash(words, place).alias("h"), place.alias("i"))

    twins = _with_twin(F.sort_array(F.transform(candidates, whole)))
    covered = F.size(F.array_distinct(F.flatten(F.transform(twins, lambda w: F.array(w["i"], w["i"] + 1, w["i"] + 2)))))
    return F.when(F.size(candidates) > 0, covered).otherwise(0)


def _with_twin(sorted_: Column) -> Column:
    before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(sorted_, F.lit(1), F.size(sorted_) - 1))
    after = F.concat(F.slice(sorted_, F.lit(2), F.size(sorted_)), F.array(F.lit(None).cast("struct<h:bigint,i:int>")))
    marked = F.arrays_zip(sorted_.alias("w"), before.alias("b"), after.alias("a"))
    twins = F.filter(marked, lambda m: m["w"]["h"].eqNullSafe(m["b"]["h"]) | m["w"]["h"].eqNullSafe(m["a"]["h"]))
    return F.transform(twins, lambda m: m["w"])


def measures(docs: DataFrame, text_col: str, into: str) -> DataFrame:
    """Add the struct ``into`` of measures of the whole text; a null text is an empty one.

    Windows are compared by a 64-bit hash of their three words.
    """
    t, w, h, c, s = hidden(docs, "m_text", "m_words", "m_windows", "m_twins", "m_lines")
    rows = docs.withColumn(t, whole_text(text_col))
    rows = rows.withColumn(w, words_of(F.col(t)))
    n = F.size(w)
    rows = rows.withColumn(h, _sorted_windows(F.col(w)))
    rows = rows.withColumn(c, _maybe_twins(F.col(h)))
    rows = rows.withColumn(s, F.filter(F.split(F.col(t), "\n", -1), lambda line: line.rlike(f"[^{SPACE_CLASS}]")))
    text = F.col(t)
    length = F.length(text)
    out = F.struct(
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join(F.col(w), "")).cast("bigint").alias("word_chars"),
        (length - F.length(_without(text, f"[{SYMBOLS}]"))).cast("bigint").alias("n_symbols"),
        (F.size(s) - F.size(F.array_distinct(s))).cast("bigint").alias("n_dup_lines"),
        _repeat_words(F.col(w), F.col(c)).cast("bigint").alias("n_repeat_words"),
        F.size(s).cast("bigint").alias("n_lines"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("bigint").alias("n_upper"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]+")).cast("bigint").alias("n_symbol_runs"),
        F.regexp_count(text, F.lit(rf"(?<!\S)[{SYMBOLS}]+(?!\S)")).cast("bigint").alias("n_lone_symbols"),
        (length - F.length(_without(text, r"[^\p{L}\s]"))).cast("bigint").alias("n_other"),
        (length - F.length(_without(text, "[0-9]"))).cast("bigint").alias("n_digits"),
        (length - F.length(_without(text, "[.!?]"))).cast("bigint").alias("n_stops"),
        (length - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("bigint").alias("n_exclaims"),
        F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct"),
    )
    return rows.withColumn(into, out).drop(t, w, h, c, s)


def estimate(patterns: DataFrame, rules=RULES, rounds: int = ROUNDS) -> list[float]:
    """Weights for ``posterior_of`` by expectation maximisation.

    ``patterns`` has a column a rule and ``n``, a row a vote pattern. A rule has a chance of every vote under good and under
    bad. The start takes documents without a bad vote as good and with several as bad, and a weak prior holds rules to be
    better than chance, so good and bad can't change places. One row of sums comes back per round.
    """
    votes = (-1, 0, 1)
    cells = [(k, v, F.col(r.name) == v) for k, r in enumerate(rules) for v in (-1, 1)]
    totals = patterns.agg(F.sum("n").alias("n"), *[F.sum(F.when(hit, F.col("n"))).alias(f"c{k}_{v + 1}") for k, v, hit in cells]).first()
    total = float(totals["n"] or 0)
    against = sum((F.when(F.col(r.name) == -1, 1).otherwise(0) for r in rules), F.lit(0))
    posterior = F.when(against == 0, 0.95).when(against == 1, 0.6).otherwise(0.05)
    weights: list[float] = []
    for _ in range(rounds):
        good = F.col("n") * F.col("p")
        row = patterns.withColumn("p", posterior).agg(F.sum(good).alias("good"), *[F.sum(F.when(hit, good)).alias(f"c{k}_{v + 1}") for k, v, hit in cells]).first()
        n_good = float(row["good"] or 0.0)
        share = (n_good + SMOOTHING) / (total + 2 * SMOOTHING)
        new = [math.log(share / (1 - share))]
        for k in range(len(rules)):
            of_all = {v: float(totals[f"c{k}_{v + 1}"] or 0.0) for v in (-1, 1)}
            g = {v: float(row[f"c{k}_{v + 1}"] or 0.0) for v in (-1, 1)}
            b = {v: max(of_all[v] - g[v], 0.0) for v in (-1, 1)}
            g[0], b[0] = max(n_good - g[-1] - g[1], 0.0), max(total - n_good - b[-1] - b[1], 0.0)
            g = {v: g[v] + SMOOTHING * PRIOR_GOOD[v] for v in votes}
            b = {v: b[v] + SMOOTHING * PRIOR_BAD[v] for v in votes}
            odds = {v: math.log(g[v] / sum(g.values())) - math.log(b[v] / sum(b.values())) for v in votes}
            new += [min(odds[-1], 0.0), 0.0, max(odds[1], 0.0)]  # abstaining is no evidence
        moved = max((abs(x - y) for x, y in zip(new, weights)), default=1.0)
        weights, posterior = new, posterior_of(new, rules)
        if moved < 1e-3:
            break
    return weights


def posterior_of(weights: list[float], rules=RULES) -> Column:
    """Chance of good given the votes. The weights form one array value, so that every round compiles to the same code."""
    table = F.array(*[F.lit(float(w)) for w in weights])
    logit = F.element_at(table, 1)
    for k, rule in enumerate(rules):
        logit = logit + F.element_at(table, (F.col(rule.name) + F.lit(3 * k + 3)).cast("int"))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def judge(docs: DataFrame, text_col: str = "text", rules=RULES, threshold: float = THRESHOLD, prefix: str = "quality_", keep_text: bool = True) -> DataFrame:
    """All rows with ``quality_measures`` (struct), ``quality_votes``, ``quality_posterior``, ``quality_base_failed`` and ``quality_kept``.

    A null or empty text fails the base rule. The base rule (fewer than 50 words, or more than half of the words in repeated
    windows) rejects whatever the posterior says. Repeated rows are judged alike; an empty table gives an empty result;
    columns of the input stay (the text only if ``keep_text``), and a prefix that clashes is an error. Texts are measured
    once: the rows with their measures are written as a stage table, from which votes are counted and rows judged.
    """
    need(docs, text_col)
    names = {n: prefix + n for n in ("measures", "votes", "posterior", "kept", "base_failed")}
    if {n.lower() for n in names.values()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"prefix {prefix!r} clashes with a column of the table")
    votes = F.struct(*[r.vote().alias(r.name) for r in rules])
    columns = [c for c in docs.columns if keep_text or c != text_col]
    measured = measures(docs, text_col, names["measures"])
    measured = cut_lineage(measured.select(*[quoted(c) for c in columns], quoted(names["measures"])))
    counted = measured.select(F.col(f"{names['measures']}.*")).select(*[r.vote().alias(r.name) for r in rules])
    patterns = cut_lineage(counted.groupBy(*[r.name for r in rules]).agg(F.count(F.lit(1)).alias("n")))
    weights = estimate(patterns, rules)
    (inner,) = hidden(measured, "judge_in")
    # the rules' SQL names bare measures: judge inside a struct of its own
    packed = measured.select(F.struct(*[quoted(c) for c in columns]).alias(inner), quoted(names["measures"]).alias(names["measures"]), F.col(f"{names['measures']}.*"))
    voted = packed.withColumn(names["votes"], votes).select(inner, names["measures"], names["votes"], f"{names['votes']}.*")
    posterior = posterior_of(weights, rules)
    m = F.col(names["measures"])
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    scored = voted.select(inner, names["measures"], names["votes"], posterior.alias(names["posterior"]), failed.alias(names["base_failed"]))
    kept = ~F.col(names["base_failed"]) & (F.col(names["posterior"]) >= F.lit(threshold))
    return scored.select(f"{inner}.*", names["measures"], names["votes"], names["posterior"], names["base_failed"], kept.alias(names["kept"]))
