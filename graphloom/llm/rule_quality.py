"""Text quality by a sparse ensemble of rules over text statistics.

Small boosted trees are grown on labelled rows; every path from a root to a
node is a rule, a conjunction of thresholds. A logistic model with an L1
penalty picks a few rules and weighs them, and the picked rules are compiled
into one Spark column expression, so scoring is a projection in the JVM.

Fitting takes at most ``FIT_ROWS`` labelled rows (those whose id hashes lowest)
and sends their statistics, some twenty numbers a row, to the driver. All
statistics and scores cover whole texts of all rows.

Defined results: null and empty texts have the statistics of a text without
characters and get a score like any other; labels that are null are ignored;
without labels of both classes every score is the share of label 1 (0.5 if
there are none); repeated rows are scored alike; ties in training go to the
first feature and lowest threshold; input columns named like an output column
are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import held_out

#: Labelled rows that a fit uses at most.
FIT_ROWS = 20_000
TREES, DEPTH, BINS = 40, 3, 32
#: L1 penalties tried, strongest first, on a quarter of the fit's rows.
PENALTIES = (0.03, 0.01, 0.003, 0.001)


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text; none is null, whatever the text."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    n = F.length(t).cast("double")

    def share(x: Column, of: Column) -> Column:
        return F.when(of > 0, x / of).otherwise(F.lit(0.0))

    def count(c: str) -> Column:
        return n - F.length(F.replace(t, F.lit(c), F.lit("")))

    words, lines = F.split(t, " ", -1), F.split(t, "\n", -1)
    n_words, n_lines = F.size(words).cast("double"), F.size(lines).cast("double")
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]+", "")).cast("double")
    upper = F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("double")
    return {
        "chars": F.log1p(n),
        "words": F.log1p(n_words),
        "lines": F.log1p(n_lines),
        "word_length": share(n, n_words),
        "distinct_words": share(F.size(F.array_distinct(words)).cast("double"), n_words),
        "distinct_lines": share(F.size(F.array_distinct(lines)).cast("double"), n_lines),
        "letters": share(letters, n),
        "upper": share(upper, letters),
        "stars": share(count("*"), n),
        "hashes": share(count("#"), n),
        "dollars": share(count("$"), n),
        "percents": share(count("%"), n),
        "ampersands": share(count("&"), n),
        "bars": share(count("|"), n),
        "exclaims": share(count("!"), n),
        "commas": share(count(","), n),
        "stops": share(count("."), n),
    }


FEATURES = tuple(("chars", "words", "lines", "word_length", "distinct_words", "distinct_lines", "letters", "upper", "stars", "hashes", "dollars", "percents", "ampersands", "bars", "exclaims", "commas", "stops"))

Rule = tuple[tuple[str, str, float], ...]  # (feature, "<=" or ">", threshold), all of which hold


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, depth: int, path: Rule, rules: list[Rule], pred: np.ndarray, names) -> None:
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-6, None, None)
    if depth and len(rows) >= 20:
        for j, edges in enumerate(cuts):
            if not len(edges):
                continue
            at = np.searchsorted(edges, x[rows, j], side="left")  # value <= edges[k] for k >= at
            gl = np.cumsum(np.bincount(at, grad[rows], len(edges) + 1))[:-1]
            hl = np.cumsum(np.bincount(at, hess[rows], len(edges) + 1))[:-1]
            nl = np.cumsum(np.bincount(at, minlength=len(edges) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(nl < 5) | (len(rows) - nl < 5)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0] + 1e-12:
                best = (gain[k], j, edges[k])
    if best[1] is None:
        pred[rows] += -0.3 * g / (h + 1)
        return
    _, j, cut = best
    left = x[rows, j] <= cut
    for op, part in (("<=", rows[left]), (">", rows[~left])):
        rule = (*path, (names[j], op, float(cut)))
        rules.append(rule)
        _grow(x, grad, hess, cuts, part, depth - 1, rule, rules, pred, names)


def tree_rules(x: np.ndarray, y: np.ndarray, names=FEATURES, seed: int = 5) -> list[Rule]:
    """Distinct rules on the paths of boosted trees, in the order of their growth."""
    rng = np.random.RandomState(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    # a rare class can lie between two quantiles of all rows
    for j in range(x.shape[1]):
        for c in (0, 1):
            v = x[y == c, j]
            if len(v):
                cuts[j] = np.union1d(cuts[j], np.quantile(v, [0.02, 0.1, 0.5, 0.9, 0.98], method="lower"))
    f = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    rules: list[Rule] = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        rows = np.sort(rng.choice(len(y), max(1, len(y) // 2), replace=False))
        pred = np.zeros(len(y))
        mine: list[Rule] = []
        _grow(x, p - y, p * (1 - p), cuts, rows, DEPTH, (), mine, pred, names)
        rules += mine
        out = np.setdiff1d(np.arange(len(y)), rows)
        # rows outside the subsample follow the tree's leaves
        leaf = {r: float(np.mean(pred[rows[holds(r, x[rows], names)]])) if holds(r, x[rows], names).any() else 0.0 for r in mine if not any(len(q) > len(r) and q[: len(r)] == r for q in mine)}
        for r, v in leaf.items():
            pred[out[holds(r, x[out], names)]] = v
        f = f + pred
    return list(dict.fromkeys(rules))


def holds(rule: Rule, x: np.ndarray, names=FEATURES) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for name, op, cut in rule:
        v = x[:, names.index(name)]
        ok &= v <= cut if op == "<=" else v > cut
    return ok


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient on the mean log loss + penalty * |w|; the intercept is free."""
    n, m = a.shape
    mean = a.mean(0)
    a = a - mean
    lip = 0.25 * (np.linalg.norm(a, 2) ** 2 / n + 1) + 1e-9
    w, b, z, zb, t = np.zeros(m), 0.0, np.zeros(m), 0.0, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-np.clip(a @ z + zb, -30, 30))) - y
        new = z - a.T @ r / n / lip
        new = np.sign(new) * np.maximum(np.abs(new) - penalty / lip, 0)
        nb = zb - r.mean() / lip
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb, t = new + (t - 1) / s * (new - w), nb + (t - 1) / s * (nb - b), s
        w, b = new, nb
    return w, float(b - mean @ w)


def fit_rules(x: np.ndarray, y: np.ndarray, names=FEATURES) -> tuple[list[tuple[Rule, float]], float]:
    """Weighted rules and the intercept."""
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.5, 1e-4, 1 - 1e-4))
        return [], float(np.log(p / (1 - p)))
    rules = tree_rules(x, y, names)
    a = np.stack([holds(r, x, names) for r in rules], 1).astype(np.float64) if rules else np.zeros((len(y), 0))
    if a.shape[1]:
        _, first = np.unique(a, axis=1, return_index=True)  # rules that hold on the same rows are one
        keep = sorted(first)
        rules, a = [rules[i] for i in keep], a[:, keep]
    test = np.arange(len(y)) % 4 == 0
    best = (np.inf, PENALTIES[-1])
    for c in PENALTIES:
        w, b = lasso_logistic(a[~test], y[~test], c)
        p = 1 / (1 + np.exp(-(a[test] @ w + b)))
        loss = -np.mean(y[test] * np.log(p + 1e-9) + (1 - y[test]) * np.log(1 - p + 1e-9))
        if loss < best[0] - 1e-4:
            best = (loss, c)
    w, b = lasso_logistic(a, y, best[1])
    return [(r, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-3], b


def compile_rules(rules: list[tuple[Rule, float]], intercept: float, stats: str = "__stats") -> Column:
    """The model as one column expression over the struct of statistics."""
    total = F.lit(intercept)
    for rule, weight in rules:
        cond = None
        for name, op, cut in rule:
            c = F.col(f"{stats}.{name}") <= cut if op == "<=" else F.col(f"{stats}.{name}") > cut
            cond = c if cond is None else cond & c
        total = total + F.when(cond, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("__stats", F.struct(*(v.alias(k) for k, v in statistics(F.col(text)).items())))


def training_rows(docs: DataFrame, labels: DataFrame, target: str, limit: int = FIT_ROWS, doc_id: str = "doc_id", columns=("text",)) -> DataFrame:
    """Labelled rows outside the held-out fold, at most ``limit`` by the hash of their id, with their texts.

    The chosen labels are a bounded table, so they are broadcast and no text is shuffled.
    """
    chosen = (
        labels.select(F.col(doc_id).alias("__id"), F.col(target).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("__id").isNotNull() & ~held_out("__id"))
        .orderBy(F.xxhash64(F.col("__id").cast("long")), "__id", "label").limit(limit)
    )
    return docs.select(F.col(doc_id).alias("__doc"), *columns).join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))


def fit_quality(docs: DataFrame, labels: DataFrame, target: str = "quality", limit: int = FIT_ROWS) -> tuple[list[tuple[Rule, float]], float]:
    rows = with_statistics(training_rows(docs, labels, target, limit)).select("__id", "label", *(f"__stats.{n}" for n in FEATURES)).toPandas()
    rows = rows.sort_values(["__id", "label", *FEATURES], kind="stable")
    return fit_rules(rows[list(FEATURES)].to_numpy(np.float64), rows["label"].to_numpy(np.float64))


def keep_quality(docs: DataFrame, labels: DataFrame, target: str = "quality", cut: float = 0.3, limit: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that score ``cut`` at least.

    The score passes through a generator, below which a filter isn't pushed:
    pushed into the projection, it would compute every statistic once for each
    rule that uses it.
    """
    rules, intercept = fit_quality(docs, labels, target, limit)
    scored = with_statistics(docs).withColumn("__score", F.explode(F.array(compile_rules(rules, intercept))))
    return scored.where(F.col("__score") >= cut).select(*docs.columns)


def score_quality(docs: DataFrame, labels: DataFrame, target: str = "quality", cut: float = 0.3, limit: int = FIT_ROWS) -> DataFrame:
    """``docs`` with held_out, score (probability of label 1) and predicted (score >= cut)."""
    rules, intercept = fit_quality(docs, labels, target, limit)
    out = with_statistics(docs.drop("held_out", "score", "predicted"))
    return (
        out.withColumn("score", compile_rules(rules, intercept)).drop("__stats")
        .withColumns({"held_out": held_out(), "predicted": (F.col("score") >= cut).cast("int")})
    )
