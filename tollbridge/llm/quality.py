"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Every rule is a ratio of a document, large in bad ones. The cutoffs of all rules form one fixed sequence
of joint cutoffs, from the mildest to the strictest: the rules are tightened in turn. Labelled documents
say how often a joint cutoff would reject a good one: with k of n good holdout documents that any rule
rejects, the hypothesis "more than ``risk`` of the good ones are rejected" has the exact p-value
P(Bin(n, risk) <= k). Within one stratum the joint cutoffs are tested in their order, and those before
the first failure are certified (fixed-sequence testing needs no correction along the sequence); the
strata share ``error`` by Bonferroni's correction. So with probability 1 - ``error`` no stratum loses
more than ``risk`` of its good documents to the rules. A stratum whose labels can't show that keeps all
its documents: without a false rejection it takes log(error / strata) / log(1 - risk) good labels, 86 for
four strata.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tollbridge.llm.base import SPACE_CHARS, count_of, join_small, let, space_words
from tollbridge.session import cut_lineage

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Cutoffs of each rule, mildest first. They don't depend on the labels, so all labels are holdout.
RATIO_STEPS = (0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05, 0.02)
RULES: dict[str, tuple[float, ...]] = {
    "symbol_ratio": RATIO_STEPS,
    "dup_line_ratio": RATIO_STEPS,
    "repeat_ratio": RATIO_STEPS,
    "upper_ratio": RATIO_STEPS,
    "shout_ratio": RATIO_STEPS,
    "word_length": (60.0, 40.0, 30.0, 20.0, 15.0, 12.0, 10.0, 9.0, 8.0, 7.0),
}
#: The joint cutoffs, mildest first: each step tightens the next rule by one of its cutoffs. Step and rule -> cutoff.
TIGHTENED = [(rule, cut) for at in range(max(map(len, RULES.values()))) for rule in RULES for cut in RULES[rule][at : at + 1]]
#: Part of all bad documents that a rule may let go for a milder cutoff than the strictest certified one.
SPARED = 0.005
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window of ``width`` words found twice or more, by the windows' 64-bit hashes.

    Only texts with a repeated window are sorted; the time is n log n in the words.
    """

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.when(i == 0, width).otherwise(F.least(F.lit(width), p - F.get(places, i - 1))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda total, step: total + step)

    def of_sorted(pairs: Column) -> Column:
        def again(pair: Column, i: Column) -> Column:
            before, after = F.get(pairs, i - 1), F.get(pairs, i + 1)
            return F.coalesce(before["h"] == pair["h"], F.lit(False)) | F.coalesce(after["h"] == pair["h"], F.lit(False))

        return let(F.sort_array(F.transform(F.filter(pairs, again), lambda p: p["i"])), covered)

    def of_windows(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        some = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(some, let(pairs, of_sorted)).otherwise(F.lit(0).cast("bigint"))

    starts = F.sequence(F.lit(0), F.size(words) - width)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    return F.when(F.size(words) > width, let(hashes, of_windows)).otherwise(F.lit(0).cast("bigint"))


def counts(text: Column) -> Column:
    """The counts of a text as one struct, with what the rules need besides."""
    text = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
        return let(
            lines,
            lambda own: F.struct(
                F.size(words).cast("bigint").alias("n_words"),
                F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
                count_of(text, SYMBOLS).alias("n_symbols"),
                (F.size(own) - F.size(F.array_distinct(own))).cast("bigint").alias("n_dup_lines"),
                repeated_words(words).alias("n_repeat_words"),
                F.size(own).cast("bigint").alias("n_lines"),
                count_of(text, "A-Z").alias("n_upper"),
                count_of(text, "!").alias("n_shout"),
            ),
        )

    return let(space_words(text), of_words)


def base_failed(of: Column) -> Column:
    return (of["n_words"] < 10) | (100 * of["n_repeat_words"] > 20 * of["n_words"])


def ratios(of: Column) -> dict[str, Column]:
    """The value of each rule for a struct of counts; 0 where there is nothing to divide by."""
    share = lambda part, whole: F.coalesce(F.try_divide(of[part].cast("double"), of[whole]), F.lit(0.0))
    return {
        "symbol_ratio": share("n_symbols", "word_chars"),
        "dup_line_ratio": share("n_dup_lines", "n_lines"),
        "repeat_ratio": share("n_repeat_words", "n_words"),
        "upper_ratio": share("n_upper", "word_chars"),
        "shout_ratio": share("n_shout", "n_words"),
        "word_length": share("word_chars", "n_words"),
    }


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exact: the terms are summed by their logarithms."""
    first = n * F.lit(math.log1p(-p))
    sum_up = F.aggregate(
        F.when(k >= 1, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>")),
        F.struct(first.alias("log"), F.exp(first).alias("sum")),
        lambda at, j: let(
            at["log"] + F.log((n - j + 1) / j) + F.lit(math.log(p) - math.log1p(-p)),
            lambda log: F.struct(log.alias("log"), (at["sum"] + F.exp(log)).alias("sum")),
        ),
        lambda at: at["sum"],
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(sum_up, F.lit(1.0)))


def fit_cutoffs(measured: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """One row per stratum with a cutoff for each rule, null where none is certified.

    ``measured`` has doc_id, stratum and the struct ``of``. A document is good if all its labels have
    quality 1 and bad if all have 0; labels without doc_id or quality say nothing. Documents that the
    base rule rejects are rejected anyway and aren't counted. Of the certified steps the mildest is
    taken that lets go nearly no bad documents beyond the strictest; there each bad document is left to the
    first rule that rejects it, and every rule goes back to its mildest cutoff that still rejects nearly all
    of its own (milder cutoffs than certified ones lose a part of the same good documents). Without labels there are no rows.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(
        F.min("quality").alias("low"), F.max("quality").alias("high")
    )
    known = known.where("low = high").select("doc_id", (F.col("low") == 1).alias("good"))
    holdout = measured.where(~base_failed(F.col("of"))).select("doc_id", "stratum", "of").join(known, "doc_id")

    values = ratios(F.col("of"))
    first = F.least(*[  # the step that rejects a document first; null if none does
        F.coalesce(*[F.when(value > cut, F.lit(step)) for step, (own, cut) in enumerate(TIGHTENED) if own == rule])
        for rule, value in values.items()
    ])
    holdout = holdout.withColumn("first", first)

    def by_step(good: Column) -> Column:
        return F.array(*[F.count_if(good & (F.col("first") <= step)) for step in range(len(TIGHTENED))])

    seen = holdout.groupBy("stratum").agg(
        F.count_if("good").alias("n"), F.count_if(~F.col("good")).alias("n_bad"), by_step(F.col("good")).alias("lost"), by_step(~F.col("good")).alias("caught")
    )
    seen = cut_lineage(seen, "quality-holdout")
    strata = max(1, seen.count())
    fails = F.transform("lost", lambda k: binomial_tail(F.col("n"), k, risk) > error / strata)
    first_failure = F.array_position(fails, True).cast("int")
    certified = F.slice("caught", 1, F.when(first_failure == 0, len(TIGHTENED)).otherwise(first_failure - 1))
    enough = F.transform(certified, lambda k: k >= F.element_at(certified, -1) - SPARED * F.col("n_bad"))
    steps = F.when(F.size(certified) > 0, F.array_position(enough, True).cast("int")).otherwise(0)
    taken = cut_lineage(seen.select("stratum", "n_bad", steps.alias("steps")), "quality-steps")

    strictest = {rule: sum((F.col("steps") > at).cast("int") for at, (own, _) in enumerate(TIGHTENED) if own == rule) for rule in RULES}
    bad = join_small(holdout.where(~F.col("good")), taken.select("stratum", "steps"), "stratum", "inner")
    others, own = F.lit(False), {}
    for rule, value in values.items():
        hit = F.coalesce(value > F.get(F.array(*map(F.lit, RULES[rule])), strictest[rule] - 1), F.lit(False))
        own[rule] = hit & ~others
        others = others | hit
    left = [F.array(*[F.count_if(own[rule] & (value > cut)) for cut in RULES[rule]]).alias(rule) for rule, value in values.items()]
    taken = join_small(taken, cut_lineage(bad.groupBy("stratum").agg(*left), "quality-caught"), "stratum")

    def chosen(rule: str) -> Column:
        kept = F.slice(rule, 1, strictest[rule])
        enough = F.transform(kept, lambda k: k >= F.element_at(kept, -1) - SPARED * F.col("n_bad"))
        cuts = F.array(*map(F.lit, RULES[rule]))
        at = F.coalesce(F.array_position(enough, True).cast("int"), F.lit(1))  # without bad documents the mildest
        return F.when(strictest[rule] > 0, F.get(cuts, at - 1)).alias(rule)

    return taken.select("stratum", *map(chosen, RULES))


def judge_measured(measured: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """``measured`` (doc_id, lang, the struct ``of`` and any more) with the booleans ``failed`` and ``kept``.

    The rows are written once, so that the texts are measured in one pass. Strata are the languages; a
    null language is a stratum of its own.
    """
    stratum = F.coalesce(F.col("lang"), F.lit(""))
    written = cut_lineage(measured.withColumn("_stratum", stratum), "quality-rows")
    of = written.select("doc_id", F.col("_stratum").alias("stratum"), "of")
    cutoffs = cut_lineage(fit_cutoffs(of, labels, risk, error), "quality-cutoffs")
    cutoffs = cutoffs.select(F.col("stratum").alias("_stratum"), F.struct(*RULES).alias("_cuts"))
    judged = join_small(written, cutoffs, "_stratum")
    some_bad = F.lit(False)
    for rule, value in ratios(F.col("of")).items():
        some_bad = some_bad | F.coalesce(value > F.col("_cuts")[rule], F.lit(False))
    failed = base_failed(F.col("of"))
    return judged.withColumns({"failed": failed, "kept": ~failed & ~some_bad}).drop("_stratum", "_cuts")


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang and any more) that pass, with their own columns.

    A null or empty text has no words and is rejected by the base rule. Repeated rows are judged one by
    one, each the same. Extra columns may have any names: the row goes along as one struct.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    measured = docs.select("doc_id", "lang", counts(F.col("text")).alias("of"), row)
    return judge_measured(measured, labels, risk, error).where("kept").select("row.*")
