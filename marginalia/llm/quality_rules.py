"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule looks at the counts of a text and votes good (1), bad (-1) or abstains (0). Nothing labels the texts;
a two-class model says how often each rule votes good on good and on bad texts, and its parameters are estimated
by expectation-maximisation over the whole corpus. A text is kept when its posterior probability of being good
is at least `KEEP` and no base rule fails it; no rule has to pass alone.

Only DataFrame functions. One scan gives the counts, which are written to the shared folder (a few numbers a
document); votes are aggregated to at most 3 ** rules patterns, and every iteration is one aggregate over that
table, so the cost of fitting does not grow with the corpus. Repeated windows are found within a row: window hashes
by doubling (1, 2, 4, 8 words), and positions by sorting, so long texts take time in proportion to
n log n. No shuffle carries text.

Defined cases: null and empty texts have no words and fail a base rule; repeated rows each give a row and a vote;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import id_text, table, written

WINDOW = 8
KEEP = 0.5
ITERATIONS = 20
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _doubled(hashes: Column, step: int) -> Column:
    return let(hashes, lambda a: F.transform(a, lambda x, i: F.xxhash64(x, F.get(a, i + step))))


def covered_words(hashes: Column) -> Column:
    """Words within windows of WINDOW words whose hash occurs twice or more; hashes: of the window at each word."""

    def at(s, j):
        return F.get(s, j)["h"]

    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = let(pairs, lambda s: F.filter(s, lambda x, j: F.coalesce(at(s, j - 1) == x["h"], F.lit(False)) | F.coalesce(at(s, j + 1) == x["h"], F.lit(False))))
    places = F.sort_array(F.transform(repeated, lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    total = F.aggregate(places, start, lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end")))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(total["n"])


def counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that rules look at, of every document."""
    docs = id_text(docs).withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != ""))
    docs = docs.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    one = F.transform("words", lambda w: F.xxhash64(w))
    eight = _doubled(_doubled(_doubled(one, 1), 2), 4)
    docs = docs.withColumn("windows", F.slice(eight, F.lit(1), F.greatest(F.size("words") - (WINDOW - 1), F.lit(0))))

    # letters and digits don't matter to counts of marks: a run of them becomes one letter first
    docs = docs.withColumn("marks", F.regexp_replace("text", r"[\p{L}\p{N}]+", "a"))

    def left(drop, of="marks"):
        return F.length(F.regexp_replace(of, drop, "")).cast("long")

    def within(runs):
        return (F.length("marks") - left(runs)).cast("long")

    return docs.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        left(r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered_words(F.col("windows")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        left(r"[^!?]+").alias("n_shouts"),
        left(r"[^A-Z]+", "text").alias("n_capitals"),
        left(r"[^.]+").alias("n_stops"),
        left(r"[a\s]+").alias("n_marks"),
        within(r"(?<!\S)[^a\s]+(?!\S)").alias("n_bare_marks"),
        within(r"[!-/:-@\[-`{-~]{2,}").alias("n_run_marks"),
    )


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes by the counts of a text. Between its two bounds a rule abstains, and where there are too few words.

    For each kind of defect there are rules that look at different sides of it, since their agreement is all that
    tells the model which votes to trust.
    """
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    length = F.col("word_chars") / n
    distinct = F.col("n_distinct") / n
    return {
        "symbols": _vote(F.col("n_symbols") > 0.15 * n, F.col("n_symbols") <= 0.02 * n),
        "marks": _vote(F.col("n_marks") > 0.5 * n, F.col("n_marks") <= 0.35 * n),
        "mark_runs": _vote(F.col("n_run_marks") > 0.3 * n, F.col("n_run_marks") <= 0.05 * n),
        "bare_marks": _vote(F.col("n_bare_marks") > 0.2 * n, F.col("n_bare_marks") <= 0.02 * n),
        "shouting": _vote(F.col("n_shouts") > 0.25 * n, F.col("n_shouts") <= 0.05 * n),
        "capitals": _vote(F.col("n_capitals") > 0.3 * chars, F.col("n_capitals") <= 0.1 * chars),
        "lines": _vote(F.col("n_dup_lines") > 0.3 * F.col("n_lines"), F.col("n_dup_lines") == 0),
        "repeats": _vote(F.col("n_repeat_words") > 0.25 * n, F.col("n_repeat_words") <= 0.05 * n),
        "variety": F.when(F.col("n_words") < 30, 0).otherwise(_vote(distinct < 0.25, distinct > 0.4)),
        "word_length": _vote((length < 2.5) | (length > 15), length.between(3.5, 11)),
        "sentences": F.when(F.col("n_words") < 30, 0).otherwise(_vote(F.col("n_stops") < 0.01 * n, F.col("n_stops") > 0.03 * n)),
    }


VOTES = {"bad": -1, "none": 0, "good": 1}


def fit(patterns: DataFrame, names: list[str], iterations: int = ITERATIONS) -> dict:
    """Parameters of the two-class model from patterns (a vote column for each name, and n): the prior of being good,
    and for each class and rule how often the rule votes bad, abstains or votes good there.

    It begins with rules that are mostly right and vote bad on some of the bad texts only, since each rule
    knows one kind of defect.
    """
    model = {
        "prior": 0.8,
        "good": {x: {"bad": 0.02, "none": 0.28, "good": 0.7} for x in names},
        "bad": {x: {"bad": 0.3, "none": 0.3, "good": 0.4} for x in names},
    }
    for _ in range(iterations):
        cast = patterns.select("n", posterior(names, model).alias("p"), F.posexplode(F.array(*names)).alias("rule", "vote"))
        cells = cast.groupBy("rule", "vote").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("p")).alias("good")).collect()  # three a rule
        every, good = sum(r.n for r in cells if r.rule == 0), sum(r.good for r in cells if r.rule == 0)
        if not every:
            break
        found = {(r.rule, r.vote): (r.n, r.good) for r in cells}
        model["prior"] = (good + 2) / (every + 4)
        for k, x in enumerate(names):
            for v, vote in VOTES.items():
                n, own = found.get((k, vote), (0, 0.0))
                model["good"][x][v] = (own + 1) / (good + 3)
                model["bad"][x][v] = (n - own + 1) / (every - good + 3)
    return model


def posterior(names: list[str], model: dict) -> Column:
    """Probability of being good, from the vote columns.

    The weights are one array constant, so that Spark compiles the same code for every model.
    """
    weights = [math.log(model["prior"] / (1 - model["prior"]))]
    for x in names:
        weight = {v: math.log(model["good"][x][v] / model["bad"][x][v]) for v in VOTES}
        # whatever was estimated, a vote for good never speaks against a text, nor one for bad for it
        weights += [min(weight["bad"], 0.0), weight["none"], max(weight["good"], 0.0)]
    held = F.array(*map(F.lit, weights))
    total = F.get(held, F.lit(0))
    for k, x in enumerate(names):
        total = total + F.get(held, F.col(x) + (3 * k + 2))
    return 1 / (1 + F.exp(-total))


def judge(docs: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """counts, the vote of each rule, quality (posterior), base_failed and kept of every document."""
    seen = written(counts(docs), "counts")
    votes = rules()
    names = list(votes)
    voted = seen.withColumns({x: v.cast("int") for x, v in votes.items()})
    patterns = written(voted.groupBy(*names).agg(F.count("*").alias("n")).coalesce(1), "patterns")
    model = fit(patterns, names, iterations)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = voted.withColumns({"quality": posterior(names, model), "base_failed": failed})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: counts and verdict of every document, and its posterior."""
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )
