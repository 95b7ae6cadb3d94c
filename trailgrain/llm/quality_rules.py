"""Quality rules by weak supervision, with DataFrame functions only.

Each rule votes good (1) or bad (-1) or abstains (0). Expectation-maximisation over the counts of vote patterns, of
which there are at most 3 ** rules, estimates how often each rule is right where it votes; a document is kept if its
posterior probability of being good reaches the threshold, and if the base rules did not fail. The windows of a text are
compared by their 64-bit hashes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgrain.llm.shared import stored

#: name: (bad where, good where; it abstains elsewhere), over the columns that `measures` gives
RULES = {
    "symbols": ("100 * n_symbols > 5 * word_chars", "false"),
    "capitals": ("100 * n_capitals > 40 * word_chars", "false"),
    "shouts": ("100 * n_shouts > 20 * n_words", "false"),
    "repeats": ("100 * n_repeat_words > 10 * n_words", "false"),
    "lines": ("n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines", "false"),
    "variety": ("n_words >= 20 and 100 * n_distinct < 25 * n_words", "false"),
    "tidy": ("false", "n_words >= 30 and 100 * n_symbols <= word_chars and 100 * n_capitals <= 15 * word_chars and 100 * n_shouts <= 2 * n_words"),
    "varied": ("false", "100 * n_distinct >= 35 * n_words and 100 * n_symbols <= word_chars and 100 * n_shouts <= 2 * n_words"),
    "own_lines": ("false", "n_lines >= 2 and n_dup_lines = 0 and 100 * n_symbols <= word_chars and 100 * n_shouts <= 2 * n_words"),
}
ROUNDS = 30
RIGHT, WEIGHT = 0.8, 200.0  # the accuracy assumed of each rule beforehand, as that many votes
PRIOR = 0.5  # without votes a text may be good or bad; it is the rules that tell


def measures(text: Column) -> list[Column]:
    """Counts of one text as columns; null counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    count = lambda chars: F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")
    return [
        F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        count("#*$%&|<>").alias("n_symbols"),
        count(r"\p{Lu}").alias("n_capitals"),
        count("!").alias("n_shouts"),
    ]


REPEATED = """
transform(array(words), w -> case when size(w) < 5 then 0L else
  transform(array(transform(sequence(0, size(w) - 5), i -> xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]))), h ->
    case when size(array_distinct(h)) = size(h) then 0L else
      transform(array(sort_array(transform(h, (x, i) -> named_struct('h', x, 'i', i)))), s ->
        aggregate(
          sort_array(filter(
            transform(s, (x, k) -> if((k > 0 and x.h = s[greatest(k - 1, 0)].h) or (k < size(s) - 1 and x.h = s[least(k + 1, size(s) - 1)].h), x.i, -1)),
            x -> x >= 0)),
          named_struct('n', 0L, 'last', -5),
          (a, x) -> named_struct('n', a.n + cast(least(5, x - a.last) as bigint), 'last', x),
          a -> a.n))[0]
    end)[0]
  end)[0]
"""


def quality_rules(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows of documents with n_words, the base counts, base_failed, `posterior` and kept.

    Words are `[^\\x20\\x09-\\x0D]+`, lines are cut at \\n and count if they hold a word. Null and empty texts have no words
    and so fail the base rules. Every row is judged by its own text: null, equal and repeated doc_ids change nothing,
    and columns other than doc_id and text are ignored. An empty table gives no rows.
    """
    counted = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *measures(F.col("text")))
    counted = counted.select(
        "doc_id", "n_symbols", "n_capitals", "n_shouts",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(REPEATED).alias("n_repeat_words"),
    )
    votes = F.array(*[F.expr(f"case when {bad} then -1 when {good} then 1 else 0 end") for bad, good in RULES.values()])
    voted = stored(counted.withColumn("votes", votes), "votes")
    score = F.lit(0.0) + F.log(F.lit(PRIOR / (1 - PRIOR)))
    for j, right in enumerate(learned(voted.select("votes"))):
        score = score + F.col("votes")[j] * F.log(F.lit(right / (1 - right)))
    failed = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    out = voted.select("*", failed.alias("base_failed"), (1 / (1 + F.exp(-score))).alias("posterior"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def learned(voted: DataFrame) -> list[float]:
    """Each rule's accuracy where it votes, by expectation-maximisation.

    One expression folds the rounds over the array of vote patterns with their counts, at most 3 ** rules of them. The
    odds of a text being good are the prior's times accuracy / (1 - accuracy) for each good vote, divided by it for each bad one.
    """
    patterns = voted.groupBy("votes").agg(F.count("*").cast("double").alias("c"))
    patterns = patterns.agg(F.sort_array(F.collect_list(F.struct(F.col("votes").alias("v"), "c"))).alias("p"))
    n = len(RULES)
    step = f"""
      transform(array(transform(p, x -> named_struct('v', x.v, 'c', x.c, 'q',
        1 / (1 + exp(-aggregate(zip_with(x.v, s, (v, r) -> v * ln(r / (1 - r))), {math.log(PRIOR / (1 - PRIOR))}D, (a, y) -> a + y)))))), m ->
        transform(sequence(0, {n - 1}), j ->
          (aggregate(m, 0D, (a, x) -> a + x.c * case x.v[j] when 1 then x.q when -1 then 1 - x.q else 0D end) + {RIGHT * WEIGHT}D)
          / (aggregate(m, 0D, (a, x) -> a + x.c * abs(x.v[j])) + {WEIGHT}D)))[0]
    """
    start = f"transform(sequence(1, {n}), j -> {RIGHT}D)"
    row = patterns.select(F.expr(f"aggregate(sequence(1, {ROUNDS}), {start}, (s, t) -> {step})").alias("s")).first()
    return [round(x, 6) for x in row.s]
