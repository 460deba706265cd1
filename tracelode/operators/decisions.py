"""Scores of decisions by what sessions say about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import prompts

# Words of a title that tell nothing, beginnings of answers that agree or choose, words by which a short
# answer agrees, and words that correct.
STOP_WORDS = (
    "the", "this", "that", "with", "from", "into", "have", "will", "been", "were", "they", "them", "their", "what", "when", "where", "which", "there", "then", "than", "also", "just", "more", "some", "each", "does", "should",
    "would", "could", "about", "other", "take", "make", "like", "over", "only", "very", "after", "before",
)
AGREES = (
    "yes", "yeah", "yep", "yup", "sure", "ok", "okay", "sounds good", "go for it", "do it", "let's do it", "let's go", "perfect", "exactly", "agreed", "correct", "right", "absolutely", "that works", "makes sense",
    "go ahead", "proceed", "i agree", "i like", "i think so", "definitely",
)
CHOOSES = ("option ", "approach ", "let's go with", "go with ", "i prefer", "i'd prefer", "i'll go with", "let's use", "i choose", "i pick")
AGREEING = ("agree", "go with", "let's", "sounds", "perfect", "great")
CORRECTS = ("no, ", "no that's wrong", "that's not what i", "i said ", "i meant ", "not what i asked", "wrong ", "incorrect", "don't do that")


def _any(*conditions: Column) -> Column:
    return F.reduce(F.array(*conditions), F.lit(False), lambda a, x: a | F.coalesce(x, F.lit(False)))


def affirmative(text: Column) -> Column:
    """Whether an answer agrees or chooses: by how it begins, or, if it is short and asks nothing, by a word in it."""
    low = F.lower(F.trim(text))
    short = (F.regexp_count(text, F.lit(r"\S+")) <= 30) & ~low.contains("?")
    return _any(*[low.startswith(x) for x in (*AGREES, *CHOOSES)], short & _any(*[low.contains(x) for x in AGREEING]))


def scores(decisions: DataFrame, main: DataFrame, projects: DataFrame) -> DataFrame:
    """(id, score) of decisions(id, title, status, session_key, references) whose session is there.

    main is threads.main_thread(), projects(session_key, project). Half a point to begin with. In the decision's own
    session and those it refers to: 0.2 more where a user agrees right after the assistant named it, 0.15 where calls
    follow within three entries, 0.1 where options were weighed, 0.2 less where a user corrects it. 0.1 more each if
    another session of the project agrees or calls so after first naming it, and if it is confirmed; 0.15 less if it
    was superseded. A text names a decision by its title, or by all of its telling words if these are two at least.

    Decisions meet the texts of their own sessions, and of their project, by equal keys.
    """
    w = Window.partitionBy("session_key").orderBy("pos")
    agrees = (F.lead("entry_type").over(w) == "user") & affirmative(F.lead("text").over(w))
    follows = F.coalesce(F.max((F.size("tools") > 0).cast("int")).over(w.rowsBetween(1, 3)), F.lit(0)) == 1
    t = main.select("session_key", "pos", "entry_type", F.lower("text").alias("low"), "text", F.coalesce(agrees, F.lit(False)).alias("agrees"), follows.alias("follows")).filter("text is not null")
    words = F.filter(F.split(F.lower("title"), r"\s+"), lambda x: x != "")
    telling = F.filter(words, lambda x: (F.octet_length(x) > 3) & ~x.isin(*STOP_WORDS))
    d = decisions.select("id", F.lower("title").alias("title"), "status", "session_key", F.coalesce("references", F.array().cast("array<string>")).alias("references"), words.alias("words"), telling.alias("telling"))
    d = d.join(projects, "session_key")
    named = F.col("low").contains(F.col("title")) | ((F.size("telling") >= 2) & F.forall("telling", lambda x: F.col("low").contains(x)))
    near = d.withColumnRenamed("session_key", "home").select("id", "title", "words", "telling", F.explode(F.array_distinct(F.concat(F.array("home"), F.col("references")))).alias("session_key")).join(t, "session_key")
    assistant, user = F.col("entry_type") == "assistant", F.col("entry_type") == "user"
    weighed = assistant & (F.col("low").contains(F.col("title")) | F.forall("words", lambda x: F.col("low").contains(x))) & prompts.weighs_options(F.col("text"))
    here = near.groupBy("id").agg(
        F.bool_or(assistant & named & F.col("agrees")).alias("agreed"), F.bool_or(assistant & named & F.col("follows")).alias("done"), F.bool_or(weighed).alias("weighed"), F.bool_or(user & named & _any(*[F.col("low").contains(x) for x in CORRECTS])).alias("corrected"),
    )
    others = d.withColumnRenamed("session_key", "home").join(projects, "project").filter((F.col("session_key") != F.col("home")) & ~F.array_contains("references", F.col("session_key")))
    first = others.select("id", "title", "telling", "session_key").join(t.filter("entry_type = 'assistant'"), "session_key").filter(named).groupBy("id", "session_key").agg(F.min_by(F.struct("agrees", "follows"), "pos").alias("x"))
    there = first.groupBy("id").agg(F.bool_or("x.agrees").alias("agreed_there"), F.bool_or("x.follows").alias("done_there"))
    when = lambda c, x: F.when(F.coalesce(c, F.lit(False)), F.lit(x)).otherwise(F.lit(0.0))
    c = F.col
    score = (
        0.5 + when(c("agreed"), 0.2) + when(c("done"), 0.15) + when(c("weighed"), 0.1) - when(c("corrected"), 0.2) + when(c("agreed_there"), 0.1) + when(c("done_there"), 0.1)
        - when(c("status") == "superseded", 0.15) + when(c("status") == "confirmed", 0.1)
    )
    out = d.select("id", "status").join(here, "id", "left").join(there, "id", "left")
    return out.select("id", F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 6).alias("score"))
