"""Encoded literals in source texts, decoded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernsift.functions import text as T

# What encoded literals look like. Loops over groups are possessive, because Java
# would otherwise recurse once per element.
HEX = r"[\"'](?:\\x[0-9a-fA-F]{2})++[\"']"
UNICODE = r"[\"'](?:\\u[0-9a-fA-F]{4})++[\"']"
ARRAY = r"(?:var|let|const)\s+(_0x[a-fA-F0-9]+|\w+)\s*=\s*\[((?:['\"][^'\"]*+['\"],?\s*)++)\]"
ACCESS = r"(\w+)\[(?:0x)?(\d+)\]"
ACCESS_WITH_HEX = r"(\w+)\[(0x[0-9a-fA-F]+|\d+)\]"
BRACKET = r"(\w+)\[(['\"])(\w+)\2\]"
CHAIN = r"(?:'[^'\"]*+'|\"[^'\"]*+\")(?:\s*\+\s*(?:'[^'\"]*+'|\"[^'\"]*+\"))++"
BASE64 = r"atob\s*\(\s*['\"]([A-Za-z0-9+/=]+)['\"]\s*\)"
CHAR_CODES = r"String\.fromCharCode\s*\(([0-9,\s]+)\)"
PAIRED = (
    r"^(?:[0-9a-cefA-CEF][0-9a-fA-F]{3}|[dD][0-7][0-9a-fA-F]{2}"
    r"|[dD][89abAB][0-9a-fA-F]{2}[dD][c-fC-F][0-9a-fA-F]{2})*+$"
)


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


def decode_hex(raw: Column) -> Column:
    """``"\\x65\\x76"`` to ``"ev"``; unchanged if the bytes are not UTF-8."""
    text = F.unhex(F.regexp_replace(raw, r"\\x|['\"]", "")).cast("string")
    return F.when(F.is_valid_utf8(text), _quoted(text)).otherwise(raw)


def decode_unicode(raw: Column) -> Column:
    """``"\\u0065"`` to ``"e"``, surrogate pairs joined; unchanged if a surrogate stands alone."""
    digits = F.regexp_replace(raw, r"\\u|['\"]", "")
    text = F.decode(F.unhex(digits), "UTF-16BE")
    return F.when(
        digits.rlike(PAIRED), F.concat(F.substring(raw, 1, 1), text, F.right(raw, F.lit(1)))
    ).otherwise(raw)


def string_arrays(text: Column) -> Column:
    """The string arrays of a text as ``array<struct<name, nth, elements>>`` in order of names; the last of a name counts.

    ``nth`` is the array's place in the text.
    """
    found = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(ARRAY), F.lit(1)).alias("name"),
        F.regexp_extract_all(text, F.lit(ARRAY), F.lit(2)).alias("inside"),
    )
    placed = F.array_sort(F.transform(found, lambda a, i: F.struct(a["name"].alias("name"), i.alias("nth"), a["inside"].alias("inside"))))
    last = T.let(placed, lambda p: F.filter(p, lambda a, i: ~F.coalesce(F.get(p, i + 1)["name"] == a["name"], F.lit(False))))
    return F.transform(
        last,
        lambda a: F.struct(
            a["name"].alias("name"), a["nth"].alias("nth"), F.regexp_extract_all(a["inside"], F.lit(r"['\"]([^'\"]*)['\"]"), F.lit(1)).alias("elements")
        ),
    )


def decode_access(raw: Column, arrays: Column, names: Column, compat: bool = True) -> Column:
    """``a[1]`` to the element, for a word that ends in the name of a known array (the first in the text that has the element).

    Every end of the word is looked up in the sorted ``names``. With ``compat`` the digits of a hex index are read as decimal.
    """
    pattern = ACCESS if compat else ACCESS_WITH_HEX

    def decoded(word: Column, digits: Column) -> Column:
        index = digits.try_cast("int")
        if not compat:
            index = F.when(
                digits.startswith("0x"), F.conv(F.substring(digits, 3, 8), 16, 10).try_cast("int")
            ).otherwise(index)
        ends = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, i, F.length(word)))
        named = F.transform(ends, lambda w: T.let(T.first_at_least(names, w), lambda k: F.when(F.get(names, k) == w, F.get(arrays, k))))
        fits = F.filter(named, lambda a: F.coalesce(index < F.size(a["elements"]), F.lit(False)))
        first = F.array_min(F.transform(fits, lambda a: F.struct(a["nth"].alias("nth"), a["name"].alias("name"), F.get(a["elements"], index).alias("element"))))
        return T.let(
            first,
            lambda hit: F.when(
                hit.isNotNull(), F.concat(F.substring(word, F.lit(1), F.length(word) - F.length(hit["name"])), _quoted(hit["element"]))
            ).otherwise(raw),
        )

    parts = F.struct(F.regexp_extract(raw, pattern, 1).alias("word"), F.regexp_extract(raw, pattern, 2).alias("digits"))
    return T.let(parts, lambda p: decoded(p["word"], p["digits"]))


def names_of(arrays: Column) -> Column:
    return F.transform(arrays, lambda a: a["name"])


def decode_bracket(raw: Column) -> Column:
    return F.regexp_replace(raw, BRACKET, r"$1.$3")


def fold_chain(raw: Column) -> Column:
    """``'ev' + "al"`` to ``"eval"``."""
    joined = F.regexp_replace(raw, r"['\"]\s*\+\s*['\"]", "")
    return _quoted(F.substring(joined, F.lit(2), F.length(joined) - 2))


def decode_base64(raw: Column) -> Column:
    text = F.try_to_binary(F.regexp_extract(raw, BASE64, 1), F.lit("base64")).cast("string")
    return F.when(F.coalesce(F.is_valid_utf8(text), F.lit(False)), _quoted(text)).otherwise(raw)


def decode_char_codes(raw: Column) -> Column:
    """``String.fromCharCode(101, 118)`` to ``"ev"``; unchanged if a number is missing or no character."""
    codes = F.transform(
        F.split(F.regexp_extract(raw, CHAR_CODES, 1), ","), lambda c: T.strip(c).try_cast("int")
    )
    good = F.forall(
        codes,
        lambda c: F.coalesce((c <= 0x10FFFF) & ~c.between(0xD800, 0xDFFF), F.lit(False)),
    )
    digits = F.array_join(F.transform(codes, lambda c: F.lpad(F.hex(c), 8, "0")), "")
    return F.when(good, _quoted(F.decode(F.unhex(digits), "UTF-32"))).otherwise(raw)


def known_arrays(text: Column) -> Column:
    return T.let(string_arrays(text), lambda a: F.struct(a.alias("arrays"), names_of(a).alias("names")))


def _steps(compat: bool) -> list[tuple[str, str, str, Callable]]:
    """Kinds in order of application: name, a word that must be there, pattern, decoder of (raw, text)."""
    return [
        ("hex", "\\x", HEX, lambda raw, text: decode_hex(raw)),
        ("unicode", "\\u", UNICODE, lambda raw, text: decode_unicode(raw)),
        ("array", "[", T.at_word_starts(ACCESS if compat else ACCESS_WITH_HEX),
         lambda raw, known: decode_access(raw, known["arrays"], known["names"], compat)),
        ("bracket", "[", T.at_word_starts(BRACKET), lambda raw, text: decode_bracket(raw)),
        ("concat", "+", CHAIN, lambda raw, text: fold_chain(raw)),
        ("base64", "atob", BASE64, lambda raw, text: decode_base64(raw)),
        ("charcode", "fromCharCode", CHAR_CODES, lambda raw, text: decode_char_codes(raw)),
    ]


def _replaced(text: Column, pattern: str, decode: Callable) -> Column:
    """A text with every match replaced by what ``decode`` makes of it."""
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), decode)
    gaps = F.split(text, pattern, -1)
    return F.array_join(
        F.zip_with(gaps, hits, lambda gap, hit: F.concat(gap, F.coalesce(hit, F.lit("")))), ""
    )


def apply_decoded(sources: DataFrame, compat: bool = True) -> DataFrame:
    """``sources`` with the encoded literals decoded, one kind after the other."""

    def plain(word: str, pattern: str, decode: Callable) -> Callable:
        return lambda t: F.when(
            t.contains(word), _replaced(t, pattern, lambda raw: decode(raw, None))
        ).otherwise(t)

    def with_arrays(pattern: str, decode: Callable) -> Callable:
        return lambda t: F.when(
            t.rlike(ARRAY),
            T.let(known_arrays(t), lambda known: _replaced(t, pattern, lambda raw: decode(raw, known))),
        ).otherwise(t)

    text = F.col("text")
    for kind, word, pattern, decode in _steps(compat):
        text = T.let(text, with_arrays(pattern, decode) if kind == "array" else plain(word, pattern, decode))
    return sources.withColumn("text", text)


def decode_literals(sources: DataFrame, compat: bool = True) -> DataFrame:
    """(file, line, kind, raw, decoded) of the literals of the unchanged texts that can be decoded."""
    text, known = F.col("text"), F.col("_known")
    none = F.array().cast("array<struct<line:int,kind:string,raw:string,decoded:string>>")

    def as_row(kind: str, decode: Callable):
        return lambda m: F.struct(
            m["line"].alias("line"), F.lit(kind).alias("kind"), m["g0"].alias("raw"),
            decode(m["g0"], known).alias("decoded"),
        )

    parts = [
        F.when(
            text.contains(word) & text.rlike(pattern),
            F.transform(T.matches(text, pattern), as_row(kind, decode)),
        ).otherwise(none)
        for kind, word, pattern, decode in _steps(compat)
    ]
    empty = F.struct(F.array().cast("array<struct<name:string,nth:int,elements:array<string>>>").alias("arrays"), F.array().cast("array<string>").alias("names"))
    found = F.flatten(F.flatten(F.transform(F.array(F.lit(0)), lambda _: F.array(*parts))))
    return (
        sources.withColumn("_known", F.when(text.rlike(ARRAY), known_arrays(text)).otherwise(empty))
        .select("file", F.explode_outer(found).alias("_m"))
        .filter(F.col("_m").isNotNull() & (F.col("_m.raw") != F.col("_m.decoded")))
        .select("file", "_m.*")
    )


def obfuscation_stats(sources: DataFrame, decoded: DataFrame) -> DataFrame:
    """(file, changed, chars_changed) per file."""
    after = decoded.select("file", F.col("text").alias("_after"))
    return sources.join(after, "file").select(
        "file",
        (F.col("text") != F.col("_after")).alias("changed"),
        F.abs(F.length("text") - F.length("_after")).alias("chars_changed"),
    )
