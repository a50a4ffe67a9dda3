"""Quality rules: a decision list learned from labelled statistics by sequential covering, applied as one conditional expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from evidentia.llm.shared import WORD, materialize

#: Statistics that rules may test: integers, so that a threshold means the same everywhere.
FEATURES = ("n_words", "mean_word_100", "symbols_100", "dup_lines_100", "repeat_100")
#: Thresholds tried a feature: this many quantiles of the labelled rows.
GRID = 24
#: Labelled rows used for fitting: about this many of more, chosen by a hash of the id, so the same rows whatever the partitioning.
FIT_ROWS = 200_000
#: A rule of either verdict must be this precise on the pruning rows and cover this many of them; the list ends where no rule does.
MIN_PRECISION, MIN_COVER = 0.9, 5


@dataclass(frozen=True)
class Term:
    feature: str
    op: str  # "<=" or ">"
    value: int

    def column(self) -> Column:
        x = F.col(self.feature)
        return x <= self.value if self.op == "<=" else x > self.value


@dataclass(frozen=True)
class Rule:
    terms: tuple[Term, ...]
    verdict: bool

    def column(self) -> Column:
        out = F.lit(True)
        for t in self.terms:
            out = out & t.column()
        return out

    def __str__(self) -> str:
        return " AND ".join(f"{t.feature} {t.op} {t.value}" for t in self.terms) + f" -> {'keep' if self.verdict else 'reject'}"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once for the row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that the array holds twice or more, the first included.

    Within one row: windows with their places are sorted, equal neighbours give the repeated places, and the union of their spans is summed.
    """
    grams = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("g"), i.alias("p")))

    def places(s: Column) -> Column:
        def twin(x, i):
            return (F.get(s, i - 1)["g"] == x["g"]) | (F.get(s, i + 1)["g"] == x["g"])

        return F.array_sort(F.transform(F.filter(s, lambda x, i: F.coalesce(twin(x, i), F.lit(False))), lambda x: x["p"]))

    def covered(p: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(p, start, lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])

    whole = _let(F.array_sort(grams), lambda s: covered(places(s)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(F.coalesce(whole, F.lit(0))).cast("long")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long). A null text counts as empty; nothing is shuffled."""
    t = F.coalesce(F.col(text), F.lit(""))
    with_words = docs.withColumn("_words", F.filter(F.split(t, r"[\x20\x09-\x0D]+", -1), lambda w: w != ""))
    with_words = with_words.withColumn("_lines", F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)))
    out = with_words.withColumn("n_words", F.size("_words").cast("long"))
    out = out.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
    out = out.withColumn("n_symbols", (F.size(F.split(t, r"[#*$%&|<>]", -1)) - 1).cast("long"))
    out = out.withColumn("n_lines", F.size("_lines").cast("long"))
    out = out.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    return out.withColumn("n_repeat_words", repeated_words(F.col("_words"))).drop("_words", "_lines")


def features(stats: DataFrame) -> DataFrame:
    """``stats`` plus the integer ratios that rules test; a document without words has zeros."""
    share = lambda a, b: F.coalesce(F.expr(f"try_divide(100 * {a}, {b})"), F.lit(0.0)).cast("long")
    out = stats.withColumn("mean_word_100", share("word_chars", "n_words")).withColumn("symbols_100", share("n_symbols", "n_words"))
    return out.withColumn("dup_lines_100", share("n_dup_lines", "n_lines")).withColumn("repeat_100", share("n_repeat_words", "n_words"))


def _bin(x: Column, cuts: list[int]) -> Column:
    return F.size(F.filter(F.array(*(F.lit(v) for v in cuts)).cast("array<long>"), lambda v: v < x))


def _counts(rows: DataFrame, cuts: dict[str, list[int]]) -> dict[Term, tuple[int, int]]:
    """(rejects, keeps) that each threshold term covers among ``rows``: one aggregation over binned features, whose few counts come to the driver."""
    names = list(cuts)
    bins = rows.select("_bad", F.posexplode(F.array(*(F.col(f"_bin_{n}") for n in names))).alias("f", "bin"))
    counts = {(r["f"], r["bin"], r["_bad"]): r["count"] for r in bins.groupBy("f", "bin", "_bad").count().collect()}
    out = {}
    for f, n in enumerate(names):
        total = [sum(c for (g, _, bad), c in counts.items() if g == f and bad == k) for k in (1, 0)]
        run = [0, 0]
        for i, v in enumerate(cuts[n]):
            run = [run[0] + counts.get((f, i, 1), 0), run[1] + counts.get((f, i, 0), 0)]
            out[Term(n, "<=", v)] = (run[0], run[1])
            out[Term(n, ">", v)] = (total[0] - run[0], total[1] - run[1])
    return out


def _gain(b: int, g: int, b0: int, g0: int) -> float:
    """FOIL gain of narrowing a rule from b0 rows of its verdict and g0 others to b and g."""
    from math import log2

    return b * (log2(b / (b + g)) - log2(b0 / (b0 + g0))) if b and b0 else 0.0


def _grown(grow: DataFrame, prune: DataFrame, cuts: dict[str, list[int]], bad: int, most: int) -> tuple[float, int, Rule] | None:
    """(precision, rows covered, rule) on the pruning rows of the rule for verdict ``bad`` (1: reject), or None.

    Terms are added by FOIL gain until the rule covers no row of the other verdict or nothing gains; then the last terms go that do not make it more precise.
    """
    own, other = grow.agg(F.count_if(F.col("_bad") == bad), F.count_if(F.col("_bad") == 1 - bad)).first()
    terms: list[Term] = []
    while own >= most and other:
        covers = {t: (c if bad else c[::-1]) for t, c in _counts(grow, cuts).items()}
        best = max(covers, key=lambda t: (_gain(*covers[t], own, other), t.feature, t.op, -t.value), default=None)
        if best is None or _gain(*covers[best], own, other) <= 0:
            break
        terms.append(best)
        grow, (own, other) = grow.filter(best.column()), covers[best]
    if not terms:
        return None
    held = [F.when(Rule(tuple(terms[:n]), False).column(), F.col("_bad")) for n in range(1, len(terms) + 1)]
    found = prune.agg(*(f(x) for x in held for f in (lambda x: F.count_if(x == bad), F.count))).first()
    sizes = [(found[2 * n], found[2 * n + 1]) for n in range(len(terms))]
    score = [(b / n if n else 0.0) for b, n in sizes]
    length = max(range(len(terms)), key=lambda i: (score[i], -i))
    return score[length], sizes[length][1], Rule(tuple(terms[: length + 1]), not bad)


def learn(labelled: DataFrame, bad: str = "_bad", names: tuple[str, ...] = FEATURES, fit_rows: int = FIT_ROWS, id_: str = "doc_id") -> list[Rule]:
    """An ordered decision list from rows with ``names`` and ``bad`` (1: reject, 0: keep).

    Sequential covering: grow a conjunction of thresholds that rejects by FOIL gain on two thirds of the rows, prune its last terms while it is more precise
    so on the other third, take it if it is precise there, remove the rows that it covers, go on until no rule is precise. Among the rows of such a rule,
    rules that keep are grown and pruned likewise; as its exceptions they stand before it, so the order of the list decides. What no rule covers is kept. Every count is one aggregation over the rows; only counts reach the driver. With no labels, or labels of one kind, the
    list is empty and everything is kept. Rows: all, or about ``fit_rows`` of more, chosen by a hash of the id. Nulls in a label drop the row.
    """
    fit = labelled.filter(F.col(bad).isNotNull()).select(F.col(bad).cast("int").alias("_bad"), F.xxhash64(F.col(id_)).alias("_h"), *names)
    fit = materialize(fit, "labelled")
    n = fit.count()
    if n > fit_rows:
        fit = fit.filter(F.pmod(F.col("_h"), F.lit(1 << 30)) < (1 << 30) * fit_rows // n)
    found = fit.agg(*(F.percentile_approx(n, [i / GRID for i in range(GRID + 1)], 1000).alias(n) for n in names)).first()
    cuts = {n: sorted({int(v) for v in found[n] or ()}) for n in names}
    # A value's bin is the number of cuts below it, so x <= cut i just if its bin is at most i.
    bins = [_bin(F.col(n), cuts[n]).alias(f"_bin_{n}") for n in names]
    rest, rules = materialize(fit.select("*", *bins), "fit"), []
    third = F.pmod(F.col("_h"), F.lit(3)) == 0
    def rule_for(rows: DataFrame, verdict: int) -> Rule | None:
        precision, covered, rule = _grown(rows.filter(~third), rows.filter(third), cuts, verdict, MIN_COVER) or (0.0, 0, None)
        return rule if precision >= MIN_PRECISION and covered >= MIN_COVER else None

    while (reject := rule_for(rest, 1)) is not None:
        inside = rest.filter(reject.column())
        while (keep := rule_for(inside, 0)) is not None:
            rules.append(Rule(reject.terms + keep.terms, True))
            inside = inside.filter(~keep.column())
        rules.append(reject)
        rest = rest.filter(~reject.column())
    return rules


def verdict(rules: list[Rule], default: bool = True) -> Column:
    """The decision list as one ordered conditional expression: the first rule that holds decides, else ``default``."""
    out = None
    for r in rules:
        out = F.when(r.column(), F.lit(r.verdict)) if out is None else out.when(r.column(), F.lit(r.verdict))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def _failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _rules(judged: DataFrame, labels: DataFrame, id_: str) -> list[Rule]:
    """Rules learned from the rows of ``judged`` (doc_id, features, base_failed) that did not fail already and have a label."""
    known = labels.select(F.col(id_).alias("doc_id"), (1 - F.col("quality")).alias("_bad")).filter("_bad IS NOT NULL")
    return learn(judged.filter(~F.col("base_failed")).join(known, "doc_id"))


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", id_: str = "doc_id") -> tuple[DataFrame, list[Rule]]:
    """(doc_id, statistics, features, base_failed, kept) of every document, and the rules.

    base_failed: fewer than 50 words, or 100 * n_repeat_words > 50 * n_words. kept: false if base_failed, else the decision list's verdict.
    The statistics are computed once and written; fitting and judging read that small table. Labels may be missing, null or repeated
    (then every labelled copy counts); null or repeated ids are judged row by row.
    """
    stats = materialize(features(statistics(docs.select(F.col(id_).alias("doc_id"), F.col(text).alias("text")), "text").drop("text")), "quality")
    judged = stats.withColumn("base_failed", _failed())
    rules = _rules(judged, labels, id_)
    return judged.withColumn("kept", ~F.col("base_failed") & verdict(rules)), rules


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    The statistics are written beside each row, once, so nothing is joined or computed twice; fitting reads their columns only.
    """
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_).alias("doc_id"), F.col(text).alias("_text"))
    judged = materialize(features(statistics(rows, "_text").drop("_text")), "quality-rows").withColumn("base_failed", _failed())
    rules = _rules(judged.drop("_row"), labels, id_)
    return judged.filter(~F.col("base_failed") & verdict(rules)).select("_row.*")
