"""Outcome texts on demand: cached ones by join, missing ones asked for, asked again where they are too few or too alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prompts
from ..functions.text import cache_key, model_id, outcomes
from ..sources.store import as_payload, latest

PAYLOAD = "outcomes array<string>, metadata struct<seed: long, prompt_version: string, cache_prompt_version: string, model_id: string, was_padded: boolean>"


def version(context: Column, k: int, model: str, base: str = prompts.VERSION) -> Column:
    """The cache's version of a prompt: with the number of outcomes, the model and a digest of the context, so none of
    these is ever answered with what another was asked."""
    return F.concat(F.lit(f"{base}-K{k}-"), model_id(F.lit(model)), F.lit("-cd"), F.substring(F.sha2(context.cast("binary"), 256), 1, 16))


def answered(context: Column, ask: Callable[[Column, Column], Column], prompt: Column, k: int, seed: int, accept: Callable[[Column], Column] | None, retries: int) -> Column:
    """(outcomes, seed, was_padded): the first attempt with k lines or more that is accepted, else the last as it is.

    Attempt i asks with seed + i. ``accept`` gets the k lines and says whether they will do.
    """
    enough = lambda text: F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != "")) >= k
    good = lambda lines: F.lit(True) if accept is None else F.coalesce(accept(lines), F.lit(False))

    def attempt(i: int) -> Column:
        # a one-element array binds the completion, so it is asked for once
        text = F.array(ask(prompt, F.lit(seed + i).cast("long")))
        last = i == retries
        made = lambda t: F.struct(outcomes(F.coalesce(t, F.lit("")), k).alias("outcomes"), F.lit(seed + i).cast("long").alias("seed"), enough(t).alias("full"))
        judged = lambda m: F.struct(m["outcomes"].alias("outcomes"), m["seed"].alias("seed"), (~m["full"] & good(m["outcomes"])).alias("was_padded"), (F.lit(last) | (m["full"] & good(m["outcomes"]))).alias("done"))
        tried = F.element_at(F.transform(F.transform(text, made), judged), 1)
        if last:
            return tried
        return F.element_at(F.transform(F.array(tried), lambda x: F.when(x["done"], x).otherwise(attempt(i + 1))), 1)

    return attempt(0)


def generate(requests: DataFrame, cache: DataFrame, ask: Callable[[Column, Column], Column], model: str, k: int = 3, seed: int = 0, accept: Callable[[Column], Column] | None = None, retries: int = 2, now: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(answers, fresh): the outcomes of every request, and the cache rows of those that weren't in the cache.

    ``requests``: customer_id, asin, c_d and alt, a struct of the alternative's fields. Each distinct (customer, item,
    context) is asked for once; a cached payload with another number of outcomes counts as missing. Answers have all
    columns of the requests, outcomes and metadata.
    """
    names = requests.schema["alt"].dataType.names
    tagged = requests.withColumn("_version", version(F.col("c_d"), k, model))
    tagged = tagged.withColumn("key", cache_key(F.col("customer_id"), F.col("asin"), F.lit(str(seed)), F.col("_version")))
    kept = latest(cache).select("key", F.from_json("value", PAYLOAD).alias("p")).filter(F.size("p.outcomes") == k)
    missing = tagged.join(kept, "key", "left_anti").groupBy("key").agg(F.first(F.struct("c_d", "alt", "_version")).alias("r")).select("key", "r.*")
    prompt = F.concat(F.lit(prompts.system(k) + "\n\n"), prompts.user(F.col("c_d"), F.col("alt"), k, names))
    made = missing.withColumn("a", answered(F.col("c_d"), ask, prompt, k, seed, accept, retries))
    metadata = F.struct(
        F.col("a.seed").alias("seed"), F.lit(prompts.VERSION).alias("prompt_version"), F.col("_version").alias("cache_prompt_version"), model_id(F.lit(model)).alias("model_id"), F.col("a.was_padded").alias("was_padded")
    )
    made = made.select("key", F.struct(F.col("a.outcomes").alias("outcomes"), metadata.alias("metadata")).alias("p"))
    fresh = made.select("key", as_payload(outcomes=F.col("p.outcomes"), metadata=F.col("p.metadata")).alias("value"), F.lit(float(now)).alias("created_at"))
    answers = tagged.join(kept.unionByName(made), "key").select(*requests.columns, F.col("p.outcomes").alias("outcomes"), F.col("p.metadata").alias("metadata"))
    return answers, fresh


def apart(embed: Callable[[Column], Column], most: float = 0.9) -> Callable[[Column], Column]:
    """Accepts lines of which no two are closer than ``most`` by cosine of what ``embed`` makes of them."""
    from .outcomes import dot

    def accept(lines: Column) -> Column:
        vectors = F.transform(lines, embed)
        close = F.transform(vectors, lambda a, i: F.exists(F.slice(vectors, i + 2, F.size(vectors)), lambda b: dot(a, b) > most))
        return ~F.exists(close, lambda x: x)

    return accept
