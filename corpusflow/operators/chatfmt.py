"""Turning texts into chat examples.

Templates are a small reference table ``(family, idx, template)``; the
choice is a pair of seeded draws per example, so formatting is a map-side
projection plus a lookup of one row per family (broadcast if Spark finds it
below its own size limit).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow import constants as K
from corpusflow.functions.chat import to_messages
from corpusflow.functions.rand import seeded_uniform
from corpusflow.functions.text import fill_template

DIRECT, TOPIC, DEBATE = "direct", "topic", "debate"


def template_table(spark: SparkSession, direct=K.DIRECT_TEMPLATES, topic=K.TOPIC_TEMPLATES,
                   debate=K.DEBATE_TEMPLATES) -> DataFrame:
    rows = [(DIRECT, i, t) for i, t in enumerate(direct)]
    rows += [(TOPIC, i, t) for i, t in enumerate(topic)]
    rows += [(DEBATE, i, t) for i, t in enumerate(debate)]
    return spark.createDataFrame(rows, "family string, idx int, template string")


def route_family(roll: Column, topic: Column, p_direct: float = K.P_DIRECT, p_topic: float = K.P_TOPIC) -> Column:
    """R2: ``roll < .40`` direct; ``< .75`` with a topic: topic; with a topic:
    debate; otherwise direct.  An empty topic counts as none."""
    has_topic = F.coalesce(F.length(topic), F.lit(0)) > 0
    return (
        F.when(roll < p_direct, F.lit(DIRECT))
        .when((roll < p_topic) & has_topic, F.lit(TOPIC))
        .when(has_topic, F.lit(DEBATE))
        .otherwise(F.lit(DIRECT))
    )


def choose_templates(df: DataFrame, key: str = "rk", topic_col: str = "topic", seed: int = K.SEED,
                     templates: DataFrame | None = None, **families) -> DataFrame:
    """R1..R3 + J5 + C9: adds ``family``, ``idx``, ``template`` and ``user``.

    ``key`` identifies the example (the draws depend on it alone).  A caller's
    ``templates`` (family, idx, template) may number its rows in any way: the
    draw picks among the rows the table holds.  Each family's templates are one
    row, and no example is lost: one whose family has no template is an error.
    """
    spark = df.sparkSession
    tpl = templates if templates is not None else template_table(spark, **families)
    ranked = F.array_sort(F.collect_list(F.struct("idx", "template")))
    lists = tpl.groupBy("family").agg(ranked.alias("_list"))
    out = df.withColumn("family", route_family(seeded_uniform(seed, "family", F.col(key)), F.col(topic_col)))
    out = out.join(lists, "family", "left").withColumn(
        "_at", F.floor(seeded_uniform(seed, "idx", F.col(key)) * F.size("_list")).cast("int"))
    missing = F.raise_error(F.concat(F.lit("no template for family "), F.col("family")))
    picked = F.when(F.col("_list").isNull(), missing.cast("struct<idx:int,template:string>")).otherwise(F.get("_list", F.col("_at")))
    out = out.withColumn("_t", picked).select(
        "*", F.col("_t.idx").alias("idx"), F.col("_t.template").alias("template")).drop("_list", "_at", "_t")
    topic = F.coalesce(F.col(topic_col), F.lit(""))
    return out.withColumn("user", fill_template(F.col("template"), K.TOPIC_PLACEHOLDER, topic))


def format_examples(df: DataFrame, system_prompt: str = K.DEFAULT_SYSTEM_PROMPT, key: str = "rk",
                    text_col: str = "text", topic_col: str = "topic", seed: int = K.SEED,
                    templates: DataFrame | None = None) -> DataFrame:
    """P5: ``messages`` = system, templated user turn, the text as answer."""
    out = choose_templates(df, key=key, topic_col=topic_col, seed=seed, templates=templates)
    return out.withColumn("messages", to_messages(F.lit(system_prompt), F.col("user"), F.col(text_col)))


def generation_requests(topics: DataFrame, prompt_template: str, topic_col: str = "topic",
                        count: int = K.GENERATION_BATCH, model: str = K.GENERATION_MODEL,
                        max_tokens: int = K.GENERATION_MAX_TOKENS,
                        temperature: float = K.GENERATION_TEMPERATURE) -> DataFrame:
    """One request body per topic (no call is made; it is a table)."""
    content = fill_template(
        fill_template(F.lit(prompt_template), K.COUNT_PLACEHOLDER, F.lit(str(count))),
        K.TOPIC_PLACEHOLDER, F.col(topic_col),
    )
    body = F.struct(
        F.lit(model).alias("model"),
        F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias("messages"),
        F.lit(max_tokens).alias("max_tokens"),
        F.lit(temperature).alias("temperature"),
    )
    return topics.withColumn("prompt", content).withColumn("request", F.to_json(body))
