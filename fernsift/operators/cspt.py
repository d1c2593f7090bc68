"""Requests whose URL is built from untrusted values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernsift.functions import text as T
from fernsift.operators.dom import CWE

# Calls that take a URL with their names, and words for values that come from a URL.
URL_SINKS = {
    "fetch": "Fetch API",
    "XMLHttpRequest": "XHR",
    "axios": "Axios",
    ".open(": "XHR open",
    "http.get": "Node HTTP",
    "https.get": "Node HTTPS",
    "request(": "Request library",
    ".src": "Element src",
    ".href": "Element href",
    "Image(": "Image constructor",
    "new URL": "URL constructor",
}
PATH_SOURCES = [
    "location.hash", "location.search", "location.pathname",
    "document.URL", "window.name",
    "URLSearchParams", "searchParams",
    "params", "query", "path",
    "req.params", "req.path",
    "useParams", "useRouter",
    "$route.params", "$route.path",
]
CONCAT = r"(fetch|axios[.\w]*|XMLHttpRequest|\.\w+)\s*\(\s*['\"`]([^'\"`]*)['\"`]\s*\+\s*([^)]+)"
TEMPLATE = r"(fetch|axios[.\w]*)\s*\(\s*`([^`]*\$\{[^}]+\}[^`]*)`"
DIRECT = r"(fetch|axios(?:\.get|\.post)?)\s*\(\s*(\w+)\s*[,)]"


PIECE = 3


def _pieces(text: Column) -> Column:
    """The distinct pieces of one to three characters of the words of a text, as many as it is long at most."""

    def of_word(word: Column) -> Column:
        return F.flatten(
            F.transform(
                F.sequence(F.lit(1), F.length(word)),
                lambda i: F.array(*[F.substring(word, i, F.lit(size)) for size in range(1, PIECE + 1)]),
            )
        )

    return F.array_distinct(F.flatten(F.transform(T.words_in(text), of_word)))


def cspt_scan(lines: DataFrame, tainted: DataFrame, sinks=URL_SINKS, path_sources=PATH_SOURCES) -> DataFrame:
    """Per line and URL call the first of: concatenation, template, bare variable.

    ``tainted``: (file, name). A path word overrides a tainted name as source; among tainted names
    the first in alphabetical order is given.
    """
    bare = T.strip(F.col("text"))
    shape = [F.lit(i) for i in range(3)]
    texts = F.array_compact(
        F.array(
            F.when(
                bare.rlike(CONCAT),
                F.array(F.struct(
                    shape[0].alias("shape"), F.lit(0).alias("nth"),
                    F.regexp_extract(bare, CONCAT, 3).alias("part"),
                    F.concat(F.regexp_extract(bare, CONCAT, 2), F.lit(" + "), F.regexp_extract(bare, CONCAT, 3)).alias("url"),
                )),
            ),
            F.when(
                bare.rlike(TEMPLATE),
                F.transform(
                    F.regexp_extract_all(F.regexp_extract(bare, TEMPLATE, 2), F.lit(r"\$\{([^}]+)\}"), F.lit(1)),
                    lambda part, i: F.struct(
                        shape[1].alias("shape"), i.alias("nth"), part.alias("part"),
                        F.regexp_extract(bare, TEMPLATE, 2).alias("url"),
                    ),
                ),
            ),
            F.when(
                bare.rlike(DIRECT),
                F.array(F.struct(
                    shape[2].alias("shape"), F.lit(0).alias("nth"),
                    F.regexp_extract(bare, DIRECT, 2).alias("part"),
                    F.concat(F.lit("Direct: "), F.regexp_extract(bare, DIRECT, 2)).alias("url"),
                )),
            ),
        )
    )
    candidates = (
        lines.filter(T.contains_any(F.col("text"), sinks))
        .select(
            "file", "line", bare.alias("bare"),
            T.all_of(F.col("text"), sinks).alias("_sinks"),
            F.explode(F.flatten(texts)).alias("_t"),
        )
        .select("file", "line", "bare", "_sinks", "_t.*")
    )
    path_word = F.when(F.col("shape") < 2, T.first_of(F.col("part"), path_sources))
    names = tainted.select("file", "name").distinct().withColumn("_piece", F.substring("name", 1, PIECE))
    place = ["file", "line", "shape", "nth"]
    open_ = candidates.filter(path_word.isNull()).select(*place, "part")
    # the start of a name is a piece of the text, or the name is not in it; only then the text is looked at
    asked = open_.filter("shape < 2").select(*place, F.explode(_pieces(F.col("part"))).alias("_piece"))
    possible = asked.join(names, ["file", "_piece"]).select(*place, "name").distinct()
    inside = possible.join(open_, place).filter(F.col("name").rlike(r"^\w+$") & F.contains("part", "name"))
    whole = open_.filter("shape = 2").join(names.withColumnRenamed("name", "part").withColumn("name", F.col("part")), ["file", "part"])
    named = inside.select(*place, "name").unionByName(whole.select(*place, "name")).groupBy(*place).agg(F.min("name").alias("_name"))
    judged = (
        candidates.withColumn("_path", path_word)
        .join(named, ["file", "line", "shape", "nth"], "left")
        .withColumn("source", F.coalesce("_path", "_name"))
        .filter(F.col("source").isNotNull())
        .groupBy("file", "line")
        .agg(F.min_by(F.struct("bare", "_sinks", "shape", "url", "source"), F.struct("shape", "nth")).alias("_v"))
        .select("file", "line", "_v.*")
    )
    checked = T.contains_any(F.col("bare"), ["startsWith", "indexOf", "includes"])
    concat, template = F.col("shape") == 0, F.col("shape") == 1
    kinds = F.create_map(*[F.lit(x) for pair in sinks.items() for x in pair])
    return (
        judged.withColumn("sink", F.explode(F.transform("_sinks", lambda s: kinds[s])))
        .select(
            "file",
            "line",
            F.concat(F.lit("CSPT_"), F.replace(F.upper("sink"), F.lit(" "), F.lit("_"))).alias("type"),
            F.when(concat, F.when(checked, F.lit("MEDIUM")).otherwise(F.lit("HIGH")))
            .when(template, F.lit("HIGH")).otherwise(F.lit("CRITICAL")).alias("severity"),
            F.col("bare").alias("evidence"),
            "source",
            "sink",
            F.col("url").alias("url_construction"),
            F.when(
                concat,
                F.when(checked, F.lit("Concatenation with partial validation"))
                .otherwise(F.lit("String concatenation without validation")),
            ).when(template, F.lit("Template literal interpolation"))
            .otherwise(F.lit("Direct user input as URL")).alias("vulnerable_pattern"),
            F.when(concat, F.format_string('Set %s to "../../../etc/passwd" or "..%%2F..%%2F"', "source"))
            .when(template, F.format_string('Inject "../" sequences via %s', "source"))
            .otherwise(F.format_string('Set %s to "//attacker.com/steal?data=" for SSRF', "source"))
            .alias("recommendation"),
            F.lit(CWE["CSPT"]).alias("cwe"),
        )
    )
