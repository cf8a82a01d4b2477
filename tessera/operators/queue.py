"""Work queues of unanswered (article, prompt) pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unassessed(articles: DataFrame, prompts: DataFrame, judgments: DataFrame) -> DataFrame:
    """(article_id, prompt_id, priority): enabled prompts without an answer; 0 where the article has none."""
    live = prompts.where("enabled").select("prompt_id")
    done = judgments.where(F.trim("answer") != "").select("article_id", "prompt_id").distinct()
    ever = done.select("article_id").distinct().withColumn("seen", F.lit(True))
    todo = articles.select("article_id").crossJoin(F.broadcast(live)).join(done, ["article_id", "prompt_id"], "left_anti")
    return todo.join(ever, "article_id", "left").select("article_id", "prompt_id", F.when(F.col("seen"), 1).otherwise(0).alias("priority"))


def human_first(queue: DataFrame, humans: DataFrame) -> DataFrame:
    """Marks pairs that a human has answered, to be taken first."""
    own = humans.select("article_id", "prompt_id").distinct().withColumn("human_first", F.lit(True))
    return queue.join(own, ["article_id", "prompt_id"], "left").withColumn("human_first", F.coalesce("human_first", F.lit(False)))
