"""Which short names are used like what, and names that would say so."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Usage classes in order of preference, with what follows a name of the class, the
# names it can get, and its place in a parameter list.
USAGE_CLASSES = {
    "request": ([".body", ".params", ".query", ".headers", ".cookies", ".get(", ".method", ".url", ".path"],
                ["req", "request", "httpReq"], 0),
    "response": ([".send(", ".json(", ".status(", ".render(", ".redirect(", ".cookie(", ".set(", ".end("],
                 ["res", "response", "httpRes"], 1),
    "next_middleware": (["next(", "next()"], ["next", "nextFn"], 2),
    "error": ([".message", ".stack", ".code", "Error", "catch"], ["err", "error", "e"], None),
    "context": ([".request", ".response", ".state", ".body", ".throw"], ["ctx", "context"], None),
    "element": ([".innerHTML", ".outerHTML", ".textContent", ".appendChild", ".querySelector", ".classList"],
                ["el", "element", "elem", "node"], None),
    "event": ([".target", ".currentTarget", ".preventDefault", ".stopPropagation", ".type", ".data"],
              ["e", "event", "evt"], None),
    "data": (["JSON.parse", "JSON.stringify", ".map(", ".filter(", ".reduce(", ".forEach("],
             ["data", "result", "items"], None),
    "callback": (["callback(", "cb(", "done(", "resolve(", "reject("], ["callback", "cb", "done"], None),
    "config": ([".port", ".host", ".database", ".username", ".password", ".secret"],
               ["config", "options", "opts"], None),
    "user": ([".id", ".email", ".name", ".role", ".password", ".token"], ["user", "account", "profile"], None),
}
NOT_NAMES = ["if", "in", "do", "of", "as", "is", "or", "an", "to"]
SHORT_NAME = r"\b([a-z][a-z0-9]?)\b"
PARAMETER_LIST = r"\(\s*(\w+)(?:\s*,\s*(\w+))?(?:\s*,\s*(\w+))?\s*\)\s*(?:=>|\{)"


def _hits(names: Column, usage: str, score: int) -> Column:
    return F.transform(
        names,
        lambda n: F.struct(n.alias("name"), F.lit(usage).alias("usage"), F.lit(score).alias("score")),
    )


def score_identifiers(sources: DataFrame) -> DataFrame:
    """(file, name, usage, score) of names of one or two characters.

    Ten points per use followed by one of the class's words, five per parameter list with the name
    in the class's place.
    """
    text = F.col("text")
    parts = []
    none = F.array().cast("array<struct<name:string,usage:string,score:int>>")
    for usage, (followers, _, position) in USAGE_CLASSES.items():
        for follower in followers:
            pattern = rf"\b([a-z][a-z0-9]?)(?={re.escape(follower)})"
            used = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
            parts.append(F.when(text.contains(follower), _hits(used, usage, 10)).otherwise(none))
        if position is not None:
            places = F.regexp_extract_all(text, F.lit(PARAMETER_LIST), F.lit(position + 1))
            parts.append(_hits(places, usage, 5))
    found = F.flatten(F.flatten(F.transform(F.array(F.lit(0)), lambda _: F.array(*parts))))
    names = F.array_except(
        F.regexp_extract_all(text, F.lit(SHORT_NAME), F.lit(1)), F.array(*map(F.lit, NOT_NAMES))
    )
    return (
        sources.select("file", "text", names.alias("_names"))
        .select("file", "_names", F.explode_outer(found).alias("_h"))
        .filter(F.col("_h").isNotNull() & F.array_contains("_names", F.col("_h.name")))
        .groupBy("file", F.col("_h.name").alias("name"), F.col("_h.usage").alias("usage"))
        .agg(F.sum("_h.score").alias("score"))
    )


def suggest_names(scores: DataFrame, minimum: int = 5) -> DataFrame:
    """(file, name, usage, score, suggestion): names in alphabetical order take the next free one.

    There are fewer than a thousand names of two characters, which bounds a file's windows. The
    name ``e`` belongs to two classes: the first to need it gets it.
    """
    order = {usage: i for i, usage in enumerate(USAGE_CLASSES)}
    rank = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])[F.col("usage")]
    best = (
        scores.groupBy("file", "name")
        .agg(F.max_by(F.struct("usage", "score"), F.struct("score", -rank)).alias("_b"))
        .select("file", "name", "_b.*")
        .filter(F.col("score") >= minimum)
    )
    in_class = Window.partitionBy("file", "usage").orderBy("name")
    in_file = Window.partitionBy("file")
    third_error = F.min(F.when((F.col("usage") == "error") & (F.col("_n") == 3), F.col("name"))).over(in_file)
    first_event = F.min(F.when((F.col("usage") == "event") & (F.col("_n") == 1), F.col("name"))).over(in_file)
    taken = third_error.isNotNull() & (first_event.isNull() | (third_error < first_event))
    shared = F.col("_taken")
    at = F.when((F.col("usage") == "event") & shared, F.col("_n") + 1).otherwise(F.col("_n"))
    blocked = (F.col("usage") == "error") & (F.col("_n") == 3) & ~shared
    pool = F.create_map(
        *[x for usage, (_, names, _p) in USAGE_CLASSES.items() for x in (F.lit(usage), F.array(*map(F.lit, names)))]
    )[F.col("usage")]
    return (
        best.withColumn("_n", F.row_number().over(in_class))
        .withColumn("_taken", taken)
        .withColumn("suggestion", F.when(~blocked, F.get(pool, at - 1)))
        .filter(F.col("suggestion").isNotNull())
        .select("file", "name", "usage", "score", "suggestion")
    )
