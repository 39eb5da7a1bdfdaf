"""Which entry of a price registry holds for a provider and a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Providers that a registry spells otherwise.
PROVIDER_IDS = {"deepseek-official": "deepseek", "kimi-coding": "moonshotai", "minimax-cn": "minimax", "zai-coding-cn": "zhipuai"}
#: Providers whose models have names that begin with another word than theirs.
VENDORS = {
    "claude": "anthropic", "gpt": "openai", "o1": "openai", "o3": "openai", "o4": "openai", "chatgpt": "openai", "gemini": "google", "gemma": "google", "grok": "xai", "kimi": "moonshotai", "moonshot": "moonshotai", "qwen": "alibaba", "qwq": "alibaba",
    "glm": "zhipuai", "chatglm": "zhipuai", "mistral": "mistral", "codestral": "mistral", "devstral": "mistral", "magistral": "mistral", "pixtral": "mistral", "ministral": "mistral", "voxtral": "mistral", "command": "cohere",
}


def _mapped(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def registry_provider(provider: Column) -> Column:
    return F.coalesce(_mapped(PROVIDER_IDS, provider), provider)


def vendor(model: Column) -> Column:
    return _mapped(VENDORS, F.element_at(F.split(F.lower(model), "-"), 1))


def registry_matches(pairs: DataFrame, registry: DataFrame) -> DataFrame:
    """Columns provider, model, entry_provider and entry: the registry's entry that prices each pair, or nulls.

    Within a provider: the same name; else the only one that is equal without case or ends with
    the model after a dash; else the same two for the model without a tag in brackets. The
    pair's own provider comes first. Beyond it the model's vendor, or a provider that its name
    begins with (the first by name), else the only other provider that has the model; several of
    those give none. Names are matched by equi-joins on what follows each dash.
    """
    parts = F.split(F.lower("name"), "-")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts) - k + 1), "-"))
    names = registry.select("branch", "name", F.explode(ends).alias("end"))
    base = F.regexp_replace("model", r"\[[^\]]*\]\s*$", "")
    asked = pairs.select("provider", "model", F.explode(F.array_distinct(F.array(F.struct(F.lit(0).alias("way"), F.col("model").alias("sought")), F.struct(F.lit(1).alias("way"), base.alias("sought"))))).alias("a")).select("provider", "model", "a.way", "a.sought")
    met = asked.join(names, F.lower("sought") == F.col("end"))
    same = F.max(F.when(F.col("name") == F.col("sought"), F.col("name")))
    only = F.when(F.count_distinct(F.lower("name")) == 1, F.max("name"))
    found = met.groupBy("provider", "model", "branch", "way").agg(F.coalesce(same, only).alias("entry")).where(F.col("entry").isNotNull())
    found = found.groupBy("provider", "model", "branch").agg(F.min_by("entry", "way").alias("entry"))
    own, of_vendor = F.col("branch") == registry_provider(F.col("provider")), F.coalesce(F.col("branch") == vendor(F.col("model")), F.lit(False)) | F.lower("model").startswith(F.concat("branch", F.lit("-")))
    rank = F.when(own, 0).when(of_vendor, 1).otherwise(2)
    ranked = found.withColumn("rank", rank).withColumn("others", F.count(F.lit(1)).over(Window.partitionBy("provider", "model"))).withColumn("place", F.row_number().over(Window.partitionBy("provider", "model").orderBy("rank", "branch")))
    best = ranked.where((F.col("place") == 1) & ((F.col("rank") < 2) | (F.col("others") == 1)))
    return pairs.join(best.select("provider", "model", F.col("branch").alias("entry_provider"), "entry"), ["provider", "model"], "left").select("provider", "model", "entry_provider", "entry")
