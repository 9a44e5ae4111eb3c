"""Text matching by rare words, and redaction by ordered patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of four letters or more that say nothing about a question.
STOP_WORDS = tuple(
    """about after also another anything back been before being between both came come does doing done down during each else
    even every from give given goes going have here into just like look looking make many more most much must need needs only
    other over please same show shows some such take than that them then there these they thing things this those through time
    using very want what when where which while will with within without would your""".split()
)

#: Patterns and what replaces them, in order.
SCRUB = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>"),
    (r"https?://[^\s]+", "<url>"),
    (r"\+?[0-9][0-9 ()-]{7,}[0-9]", "<phone>"),
    (r"[A-Za-z0-9_-]{32,}", "<token>"),
)
#: What a text must hold for a rule to be worth trying.
NEEDS = {"<email>": "@", "<url>": "://"}


def content_words(text: Column) -> Column:
    """Distinct words of more than three letters, stop words out; of longer ones a trailing s is folded."""
    words = F.split(F.regexp_replace(F.lower(text), "[^a-z0-9 ]+", " "), " +")
    kept = F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(*STOP_WORDS))
    return F.array_distinct(F.transform(kept, lambda w: F.when(F.length(w) > 4, F.regexp_replace(w, "s$", "")).otherwise(w)))


def word_weights(entries: DataFrame) -> DataFrame:
    """word, weight: max(ln(N / df), 0.05) over entries (name, words)."""
    df = entries.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(entries.agg(F.count(F.lit(1)).alias("n"))).select(
        "word", F.greatest(F.log(F.col("n") / F.col("df")), F.lit(0.05)).alias("weight")
    )


def choose_entry(questions: DataFrame, entries: DataFrame, default: Column | None = None) -> DataFrame:
    """question, name, score: the entry whose words in common weigh most; ties to the first name.

    Questions (question, words) without a word in common get no row, or the default with a score of 0. The words of
    entries are the small side; both meet by word, and pairs are summed map-side first.
    """
    weights = word_weights(entries)
    index = entries.select("name", F.explode("words").alias("word")).join(weights, "word")
    asked = questions.select("question", F.explode("words").alias("word"))
    scores = asked.join(index, "word").groupBy("question", "name").agg(F.round(F.sum("weight"), 9).alias("score"))
    best = F.max_by(F.struct("name", "score"), F.struct(F.col("score"), -F.col("name")))
    chosen = scores.groupBy("question").agg(best.alias("b")).select("question", "b.name", "b.score")
    if default is None:
        return chosen
    every = questions.select("question").distinct().join(chosen, "question", "left")
    return every.select("question", F.coalesce("name", default).alias("name"), F.coalesce("score", F.lit(0.0)).alias("score"))


def _worth(text: Column, mark: str) -> Column:
    return F.contains(text, F.lit(NEEDS[mark])) if mark in NEEDS else F.lit(True)


def scrub(text: Column, rules=SCRUB) -> Column:
    for pattern, mark in rules:
        text = F.when(_worth(text, mark), F.regexp_replace(text, pattern, mark)).otherwise(text)
    return text


def violations(text: Column, rules=SCRUB) -> Column:
    """The marks of the rules that would fire, in order."""
    fired = F.array(*[F.when(F.coalesce(_worth(text, m) & text.rlike(p), F.lit(False)), F.lit(m)) for p, m in rules])
    return F.array_join(F.array_compact(fired), ",")


def sanitize_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9_.-]", "_")
