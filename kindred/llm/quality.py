"""Quality rules by weak supervision, in DataFrame functions only.

Rules vote good, bad or abstain; expectation-maximisation over the number of documents with each
pattern of votes estimates how accurate each rule is; the posterior of the votes decides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import table
from kindred.sources.scratch import materialize

SPACES = r"[\x20\x09-\x0D]+"
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Votes expected of a rule on a good and on a bad text, and how much they weigh against what is seen.
EXPECTED_GOOD, EXPECTED_BAD = {-1: 0.005, 0: 0.595, 1: 0.4}, {-1: 0.25, 0: 0.45, 1: 0.3}
WEIGHT, ROUNDS = 0.05, 50
#: Least and greatest log odds of a vote against and of one for a text; and the share of good texts stays within these.
AGAINST, FOR, PRIOR = (-8.0, -1.0), (0.1, 1.5), (0.5, 0.99)
THRESHOLD = 0.5


def _left(text: Column, pattern: str) -> Column:
    """Code points of the text that the (negated) pattern doesn't take away."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """Numbers of every whole text; one row in, one row out, no shuffle.

    n_repeat_words: words in windows of WINDOW words that occur twice or more. Windows are
    compared by a 64-bit hash of their words' hashes; only texts in which two agree sort them.
    """
    text = F.col("text")
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", "text", F.filter(F.split(text, SPACES), lambda w: w != "").alias("w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    d = d.select(
        "doc_id",
        F.transform("w", lambda w: F.xxhash64(w)).alias("h"),
        F.size("w").cast("long").alias("n_words"),
        _left(text, SPACES).alias("word_chars"),
        _left(text, "[^#*$%&|<>]+").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"[.!?:;\"'”»…)][\x20\x09-\x0D]*$"))).cast("long").alias("n_ended"),
        _left(text, r"[^\p{L}]+").alias("n_letters"),
        _left(text, r"[^\p{Lu}]+").alias("n_upper"),
        _left(text, r"[^\p{N}]+").alias("n_digits"),
    )
    numbers = [c for c in d.columns if c != "h"]
    d = d.select(*numbers, F.expr(f"case when size(h) >= {WINDOW} then transform(sequence(1, size(h) - {WINDOW - 1}), i -> xxhash64(slice(h, i, {WINDOW}))) else array() end").alias("win"))
    d = d.select(*numbers, F.expr("case when size(array_distinct(win)) < size(win) then array_sort(transform(win, (x, i) -> struct(x, i))) end").alias("s"))
    d = d.select(*numbers, F.expr("case when s is not null then array_sort(transform(filter(s, (e, k) -> get(s, k - 1).x <=> e.x or get(s, k + 1).x <=> e.x), e -> e.i)) end").alias("at"))
    covered = F.expr(f"case when at is null then 0L else aggregate(transform(at, (p, k) -> least({WINDOW}, coalesce(get(at, k + 1) - p, {WINDOW}))), 0L, (a, x) -> a + x) end")
    return d.select(*numbers, covered.alias("n_repeat_words"))


def _share(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes: 1 good, -1 bad, 0 abstains. Most rules only ever speak against a text."""
    length, symbols, repeated = _share("word_chars", "n_words"), _share("n_symbols", "n_words"), _share("n_repeat_words", "n_words")
    dup, ended = _share("n_dup_lines", "n_lines"), _share("n_ended", "n_lines")
    letters, upper, digits = _share("n_letters", "word_chars"), _share("n_upper", "n_letters"), _share("n_digits", "word_chars")
    n, never = F.col("n_words"), F.lit(False)
    return {
        "word_length": _vote((n >= LEAST_WORDS) & length.between(3.5, 9), (length < 2.5) | (length > 14)),
        "symbols": _vote(never, symbols > 0.25),
        "dup_lines": _vote(never, (F.col("n_lines") > 3) & (dup > 0.3)),
        "repeated": _vote(never, repeated > 0.2),
        "length": _vote(n.between(50, 100_000), n < LEAST_WORDS),
        "letters": _vote((n >= LEAST_WORDS) & (letters > 0.85), letters < 0.7),
        "upper": _vote(never, upper > 0.5),
        "digits": _vote(never, digits > 0.25),
        "ended": _vote(never, (F.col("n_lines") > 3) & (ended < 0.1)),
    }


Model = tuple[float, list[dict[int, float]], list[dict[int, float]]]


def estimate(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = ROUNDS) -> Model:
    """(share of good texts, each rule's votes on good texts, and on bad ones) from counts of vote patterns; at most 3 ** n_rules of them.

    It starts from texts with any vote against them as bad, and expects good texts to draw few such votes;
    that expectation weighs as a fixed share of the texts, so the fit is alike at every size.
    """
    total = sum(n for _, n in patterns)
    if not total:
        return 0.9, [EXPECTED_GOOD] * n_rules, [EXPECTED_BAD] * n_rules
    believed = [0.05 if -1 in votes else 0.95 for votes, _ in patterns]
    for _ in range(rounds):
        good = sum(p * n for p, (_, n) in zip(believed, patterns))
        sides = []
        for mass, expect, side in ((good, EXPECTED_GOOD, believed), (total - good, EXPECTED_BAD, [1 - p for p in believed])):
            weight = WEIGHT * mass + 1e-6 * total
            tables = [{v: weight * x for v, x in expect.items()} for _ in range(n_rules)]
            for p, (votes, n) in zip(side, patterns):
                for t, v in zip(tables, votes):
                    t[v] += p * n
            sides.append([{v: x / sum(t.values()) for v, x in t.items()} for t in tables])
        model = (min(PRIOR[1], max(PRIOR[0], good / total)), *sides)
        believed = [posterior(votes, model) for votes, _ in patterns]
    return model


def weights(model: Model) -> tuple[float, list[dict[int, float]]]:
    """Log odds of the prior, and of each rule's vote; an abstention says nothing, and no vote ever speaks for the other side."""
    prior, good, bad = model
    bounds = {-1: AGAINST, 1: FOR}
    return math.log(prior / (1 - prior)), [{v: min(bounds[v][1], max(bounds[v][0], math.log(g[v] / b[v]))) for v in bounds} for g, b in zip(good, bad)]


def posterior(votes: tuple[int, ...], model: Model) -> float:
    first, each = weights(model)
    return 1 / (1 + math.exp(-max(-700.0, first + sum(t.get(v, 0.0) for t, v in zip(each, votes)))))


def judge(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every document's numbers, votes' posterior and verdict.

    A null text has no words and fails the base rules. Null and repeated ids stay rows;
    other columns are not read. With no documents there is nothing to estimate and nothing returned.
    """
    found = materialize(features(docs), "features")
    votes = rules()
    voted = found.select("*", *[v.alias(f"vote_{k}") for k, v in votes.items()])
    names = [f"vote_{k}" for k in votes]
    patterns = [(tuple(r[:-1]), r[-1]) for r in sorted(map(tuple, voted.groupBy(*names).agg(F.count("*").alias("n")).collect()))]
    first, each = weights(estimate(patterns, len(names)))
    odds = F.lit(first)
    for c, t in zip(names, each):
        odds = odds + F.when(F.col(c) < 0, t[-1]).when(F.col(c) > 0, t[1]).otherwise(0.0)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = voted.withColumn("posterior", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
