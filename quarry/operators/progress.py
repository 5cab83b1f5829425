"""Chapters, sections, quizzes and a learner's progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECTION_XP, CHAPTER_XP, QUIZ_XP = 10, 50, 25


def chapter_progress(sections: DataFrame) -> DataFrame:
    """chapter_id, total, done, ratio, percent (half up), status."""
    own = sections.groupBy("chapter_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("completed").alias("done"))
    ratio = F.col("done") / F.col("total")
    status = F.when(F.col("done") == F.col("total"), "completed").when(F.col("done") > 0, "in-progress").otherwise("unvisited")
    return own.select("chapter_id", "total", "done", F.round(ratio, 6).alias("ratio"), F.floor(100 * ratio + 0.5).cast("long").alias("percent"), status.alias("status"))


def overall(sections: DataFrame) -> DataFrame:
    """sections, done, ratio, chapters, chapters_completed, quizzes_passed."""
    own = chapter_progress(sections)
    a = own.agg(F.sum("total").alias("sections"), F.sum("done").alias("done"), F.count(F.lit(1)).alias("chapters"), F.count_if(F.col("status") == "completed").alias("chapters_completed"))
    quizzes = sections.where("content_type = 'quiz' and completed").agg(F.count_distinct("chapter_id").alias("quizzes_passed"))
    return a.crossJoin(quizzes).withColumn("ratio", F.round(F.coalesce(F.try_divide(F.col("done").cast("double"), F.col("sections")), F.lit(0.0)), 6))  # one row each


def learner(sections: DataFrame) -> DataFrame:
    """xp, level and earned badges."""
    all_ = overall(sections)
    xp = F.col("done") * SECTION_XP + F.col("chapters_completed") * CHAPTER_XP + F.col("quizzes_passed") * QUIZ_XP
    badges = F.concat_ws(",", F.when(F.col("done") > 0, F.lit("first_steps")), F.when(F.col("chapters_completed") > 0, F.lit("chapter_champion")), F.when(F.col("quizzes_passed") >= 5, F.lit("quiz_master")), F.when((F.col("chapters") > 0) & (F.col("chapters") == F.col("chapters_completed")), F.lit("completionist")))
    return all_.select(xp.alias("xp"), (F.floor(xp / 100) + 1).cast("long").alias("level"), badges.alias("badges"))


def skipped(sections: DataFrame, chapter: int) -> DataFrame:
    """Sections of a chapter that skipping it would complete."""
    done = sections.where("completed").select("chapter_id", "section_id")
    return sections.where(F.col("chapter_id") == chapter).join(done, ["chapter_id", "section_id"], "left_anti").select("chapter_id", "section_id", "content_type")


def grade(questions: DataFrame) -> DataFrame:
    """``questions(question_id, options (JSON), correct_index, answer)`` -> question_id, correct, xp."""
    right = F.try_element_at(F.from_json("options", "array<string>"), (F.coalesce("correct_index", F.lit(0)) + 1).cast("int"))
    ok = F.coalesce(right == F.col("answer"), F.lit(False))
    return questions.select("question_id", ok.alias("correct"), F.when(ok, QUIZ_XP).otherwise(0).cast("long").alias("xp"))


def difficulty(n) -> F.Column:
    return F.when(n < 5, "beginner").when(n < 15, "intermediate").otherwise("advanced")
