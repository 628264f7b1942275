"""Quality rules by weak supervision: each rule votes for good (1), for bad (-1) or abstains (0); expectation-maximisation
over the table of vote patterns estimates how often each rule is right about good and about bad documents; a document
stays if its posterior probability of being good is at least one half. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
#: Steps of expectation-maximisation, what estimates start from, and bounds that keep them inside.
STEPS, PRIOR, RIGHT_ON_GOOD, RIGHT_ON_BAD, LEAST = 20, 0.85, 0.98, 0.4, 0.001
#: (name, value, good if .., bad if ..): a rule abstains where neither holds, and on documents without words.
RULES = (
    ("length", "n_words", "v >= 50", "v < 10"),
    ("mean_word", "word_chars / n_words", "v >= 3 and v <= 10", "v < 2 or v > 15"),
    ("symbols", "n_symbols / n_words", "v <= 0.02", "v > 0.1"),
    ("symbol_share", "n_symbols / word_chars", "v <= 0.005", "v > 0.04"),
    ("symbol_runs", "n_symbol_runs / n_words", "v <= 0.01", "v > 0.1"),
    ("dup_lines", "case when n_lines >= 3 then n_dup_lines / n_lines end", "v = 0", "v > 0.3"),
    ("repeats", "n_repeat_words / n_words", "v <= 0.05", "v > 0.2"),
    ("distinct", "case when n_words >= 30 then n_distinct / n_words end", "v >= 0.25", "v < 0.12"),
    ("capitals", "n_capitals / word_chars", "v <= 0.15", "v > 0.4"),
    ("exclamations", "n_exclamations / n_words", "v <= 0.05", "v > 0.3"),
)


def _let(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.transform(F.array(value), then)[0]


def statistics(text: Column) -> Column:
    """struct of word counts of one text (null: empty): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_symbol_runs, n_lines (with a word), n_distinct, n_capitals, n_exclamations."""

    def of(text: Column) -> Column:
        def of_words(words: Column) -> Column:
            n = F.size(words)
            lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
            return _let(
                lines,
                lambda lines: F.struct(
                    n.cast("long").alias("n_words"),
                    F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                    F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                    F.regexp_count(text, F.lit(r"[#*$%&|<>]+")).cast("long").alias("n_symbol_runs"),
                    (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                    repeated_words(words, n).cast("long").alias("n_repeat_words"),
                    F.size(lines).cast("long").alias("n_lines"),
                    F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
                    F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_capitals"),
                    F.regexp_count(text, F.lit("!")).cast("long").alias("n_exclamations"),
                ),
            )

        return _let(F.array_remove(F.split(text, SPACE, -1), ""), of_words)

    return _let(F.coalesce(text, F.lit("")), of)


def repeated_words(words: Column, n: Column, k: int = 5) -> Column:
    """Words in windows of k words that occur twice or more. Hashes of the windows show whether any may repeat; only
    then are the windows themselves put in order and compared with their neighbours."""

    def gram(i: Column) -> Column:
        return F.array_join(F.slice(words, i, k), " ")

    def covered(grams: Column) -> Column:
        def is_repeated(j: Column) -> Column:
            own = F.get(grams, j)["g"]
            return (own == F.coalesce(F.get(grams, j - 1)["g"], F.lit(""))) | (own == F.coalesce(F.get(grams, j + 1)["g"], F.lit("")))

        starts = F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), F.size(grams) - 1), is_repeated), lambda j: F.get(grams, j)["i"]))
        zero = F.struct(F.lit(-k).alias("last"), F.lit(0).alias("sum"))
        return F.aggregate(starts, zero, lambda a, i: F.struct(i.alias("last"), (a["sum"] + F.least(F.lit(k), i - a["last"])).alias("sum")), lambda a: a["sum"])

    places = F.sequence(F.lit(1), n - (k - 1))
    hashes = F.transform(places, lambda i: F.xxhash64(F.slice(words, i, k)))
    some = _let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    whole = _let(F.array_sort(F.transform(places, lambda i: F.struct(gram(i).alias("g"), i.alias("i")))), covered)
    return F.when(n > k, F.when(some, whole).otherwise(0)).otherwise(0)


def votes() -> list[Column]:
    out = []
    for name, value, good, bad in RULES:
        v = f"({value})"
        good, bad = (" ".join(v if part == "v" else part for part in x.split()) for x in (good, bad))
        out.append(F.expr(f"case when n_words = 0 then 0 when {good} then 1 when {bad} then -1 else 0 end").alias(f"vote_{name}"))
    return out


def estimate(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[float], list[float]]:
    """From vote patterns and their counts: the share of good documents, and for each rule the probability that its
    vote on a good, and on a bad, document is right. Two-sided (a rule may be right on nearly all good documents and
    on few bad ones); votes of a document are taken as independent; abstaining tells nothing."""
    rules = len(RULES)
    prior, on_good, on_bad = PRIOR, [RIGHT_ON_GOOD] * rules, [RIGHT_ON_BAD] * rules
    inside = lambda x: min(max(x, LEAST), 1 - LEAST)
    for _ in range(STEPS):
        good = bad = 0.0
        sums = [[0.0] * 4 for _ in range(rules)]
        for pattern, n in patterns:
            p = posterior(pattern, prior, on_good, on_bad)
            good, bad = good + n * p, bad + n * (1 - p)
            for s, vote in zip(sums, pattern):
                if vote:
                    s[0] += n * p * (vote > 0)
                    s[1] += n * p
                    s[2] += n * (1 - p) * (vote < 0)
                    s[3] += n * (1 - p)
        if good + bad == 0:
            break
        prior = inside(good / (good + bad))
        on_good = [inside((s[0] + 2 * RIGHT_ON_GOOD) / (s[1] + 2)) for s in sums]
        on_bad = [inside((s[2] + 2 * RIGHT_ON_BAD) / (s[3] + 2)) for s in sums]
    return prior, on_good, on_bad


def posterior(pattern, prior: float, on_good: list[float], on_bad: list[float]) -> float:
    log = math.log(prior) - math.log(1 - prior)
    for vote, a, b in zip(pattern, on_good, on_bad):
        if vote > 0:
            log += math.log(a) - math.log(1 - b)
        elif vote < 0:
            log += math.log(1 - a) - math.log(b)
    return 1 / (1 + math.exp(-log)) if log > -500 else 0.0


def judged(docs: DataFrame, settle=None) -> DataFrame:
    """Every row of docs(doc_id, text, ...): doc_id, the statistics, a vote column for each rule, posterior and good
    (posterior >= 0.5). The driver gets the counts of vote patterns, at most 3^rules rows. Null text: no words, all
    rules abstain, the posterior is the share of good documents. Rows with equal or null doc_id each come out.
    settle: how the statistics are kept between counting and judging (default: computed again)."""
    measured = docs.select("doc_id", statistics(F.col("text")).alias("s")).select("doc_id", "s.*")
    voted = measured.select("*", *votes())
    if settle is not None:
        voted = settle(voted)
    names = [f"vote_{name}" for name, *_ in RULES]
    rows = voted.groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).collect()
    prior, on_good, on_bad = estimate([(tuple(r[x] for x in names), r["n"]) for r in rows])
    log = F.lit(math.log(prior) - math.log(1 - prior))
    for name, a, b in zip(names, on_good, on_bad):
        log = log + F.when(F.col(name) > 0, math.log(a) - math.log(1 - b)).when(F.col(name) < 0, math.log(1 - a) - math.log(b)).otherwise(0.0)
    return voted.withColumn("posterior", 1 / (1 + F.exp(-log))).withColumn("good", F.col("posterior") >= 0.5)
