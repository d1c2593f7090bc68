"""Line dedup by a tree of line templates. DataFrame operations only.

A line goes down a tree of fixed depth: by its number of words, then by its first words, with words that hold a digit as
variable fields. The lines of a leaf that is in enough documents are told apart by stretches of their other words, one stretch more than words
that may vary: a line belongs to the stretch that most documents of the leaf have in that place. The lines of one stretch
have one template, the words that at least half of them have in their positions, and those that agree with it in most positions, variable fields
included, are its instances. So each line has one template at most, and nothing is compared pairwise. Lines that are the same but for fields are
a template by themselves.

Templates with instances in several documents recur, and their lines are dropped; the other lines of the leaf are tried again among themselves
until no template recurs.

Copies of whole documents would make all of their lines recur. So documents that share most of their text count as one, and
lines that only they have are left for the removal of near-duplicate documents. Lines that recur elsewhere go from copies too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernsift.functions.text import let
from fernsift.llm.graph import components
from fernsift.llm.shared import store

DEPTH = 4  # leading words that part the tree below the number of words
LEAST_DOCUMENTS = 4
LONG_WORDS = 50  # lines of so many words recur from LONG_DOCUMENTS on
LONG_DOCUMENTS = 2
SHORT_WORDS = 3  # lines of fewer words recur from SHORT_DOCUMENTS on, and only as they are
SHORT_DOCUMENTS = 8
AGREE = 0.7  # share of positions in which an instance has the template's word
COPY = 0.8  # share of the longer of two documents, by length of lines, in lines they share from which they are copies

BLANK = r"[\x20\x09-\x0D]+"
FIELD = "<*>"


def _word(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit(FIELD)).otherwise(token)


def _masked(tidy: Column) -> Column:
    """A tidy line with its variable fields masked; most lines have no digit, and their words are not gone through."""
    return F.when(tidy.rlike("[0-9]"), F.array_join(F.transform(F.split(tidy, " "), _word), " ")).otherwise(tidy)


def _words(masked: Column) -> Column:
    return F.split(masked, " ")


def _uneven(text: Column) -> Column:
    """Whether words stand apart by anything but single blanks; few texts have to be gone through by a pattern for it."""
    return reduce(Column.__or__, [F.contains(text, F.lit(x)) for x in ("  ", "\t", "\x0b", "\x0c", "\r")])


def _tidy(line: Column, uneven: Column) -> Column:
    """The words of a line with single blanks between them; a line of an even text can only begin or end with a blank."""
    bare = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(uneven, F.regexp_replace(bare, BLANK, " ")).otherwise(F.trim(line))


def body_of(text: Column) -> Column:
    """A number of 60 bits for a text."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _lines(docs: DataFrame, text: str, least_documents: int) -> DataFrame:
    """A row per line with words: the text it is in, place, length, the line, its words as ``tidy``, leaf, and how many documents it needs."""
    body, uneven = body_of(F.col(text)).alias("body"), _uneven(F.col(text)).alias("uneven")
    whole = docs.select(F.col(text).alias("text"), body, uneven)  # below the generator, else worked out again for each line
    narrow = whole.select("body", "uneven", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    # one filled array keeps the filter from working the words out a second time
    tidy = narrow.withColumn("tidy", F.explode(F.array(_tidy(F.col("line"), F.col("uneven"))))).filter("tidy <> ''")
    n = F.octet_length("tidy") - F.octet_length(F.replace(F.col("tidy"), F.lit(" "), F.lit(""))) + 1
    first = _words(_masked(F.substring_index(F.col("tidy"), " ", DEPTH)))
    counted = tidy.withColumn("n", n)
    need = F.when(F.col("n") >= LONG_WORDS, F.lit(min(LONG_DOCUMENTS, least_documents))).when(F.col("n") < SHORT_WORDS, F.lit(max(SHORT_DOCUMENTS, least_documents)))
    return counted.select(
        "body", "place", F.length("line").alias("chars"), "line", "tidy", F.xxhash64("n", first).alias("leaf"), need.otherwise(F.lit(least_documents)).alias("need")
    )


def _in_enough(lines: DataFrame, by: list[str]) -> DataFrame:
    """Keys ``by`` in at least ``need`` different texts, a number that all lines of a key have; counted once per text before they meet."""
    once = lines.select(*by, "need", "body").distinct()
    return once.groupBy(*by, "need").agg(F.count("*").alias("docs")).filter("docs >= need").select(*by)


def _stretches(words: Column, n: Column) -> Column:
    """The stretches of the words behind the leading ones, one more than positions that may differ; a line that differs from
    another in no more positions has one in common with it."""
    parts = n - F.ceil(AGREE * n).cast("int") + 1
    end = lambda k: DEPTH + F.floor((n - DEPTH) * k / parts).cast("int")
    stretch = lambda k: F.slice(words, end(k) + 1, F.greatest(end(k + 1) - end(k), F.lit(0)))
    none = F.array(F.lit(0).cast("long"))
    return F.when(n <= DEPTH, none).otherwise(F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.xxhash64(stretch(k))))


def _chosen(equal: DataFrame) -> DataFrame:
    """``leaf``, ``same``, ``need``, ``docs``, ``template``: the stretch of each line that most documents have, the first of several."""
    each = equal.select("leaf", "same", "need", "docs", F.posexplode("parts").alias("k", "part"))
    weight = each.groupBy("leaf", "k", "part").agg(F.sum("docs").alias("weight")).filter("weight > 1")
    # one number for both, which is summed up in place and not sorted; it holds weights below 2**32, beyond that Spark's ANSI mode stops
    order = (F.col("weight") * F.lit(1 << 31) + (F.lit((1 << 31) - 1) - F.col("k"))).alias("order")
    sized = each.join(weight, ["leaf", "k", "part"]).select("leaf", "same", "need", "docs", order, F.xxhash64("leaf", -F.col("k"), "part").alias("template"))
    top = sized.groupBy("leaf", "same", "need", "docs").agg(F.max("order").alias("order"), F.max_by("template", "order").alias("template"))
    return top.filter(F.col("order") >= F.col("need") * F.lit(1 << 31)).select("leaf", "same", "need", "docs", "template")


def _instances(equal: DataFrame) -> DataFrame:
    """``leaf``, ``same``, ``template`` of the lines that agree with the template of their stretch, where enough documents may have it.

    A template is voted for word by word only where it takes a vote. A line in more than half of the documents has the most
    frequent word everywhere; of two lines in equally many documents it is the greater word.
    """
    chosen = store(_chosen(equal), "chosen-lines")
    by_template = chosen.groupBy("template", "need").agg(
        F.count("*").alias("lines"), F.sum("docs").alias("all"), F.max("docs").alias("most"), F.max_by("same", "docs").alias("leader")
    )
    grouped = chosen.join(by_template.filter(F.col("all") >= F.col("need")), ["template", "need"])
    alone = grouped.filter("lines = 1").select("leaf", "same", "template")
    led, words = F.col("most") * 2 > F.col("all"), equal.select("leaf", "same", "words")
    several = grouped.filter("lines > 1").select("leaf", "same", "docs", "template", led.alias("led"), (F.col("lines") == 2).alias("pair"), "leader")
    several = store(several.join(words, ["leaf", "same"]), "grouped-lines")
    plain = several.filter("led OR pair").drop("docs", "pair")
    beside = several.filter("led AND same = leader OR pair AND NOT led").select("template", F.col("same").alias("other"), F.col("words").alias("theirs"))
    both = plain.join(beside, "template").filter("led OR same <> other")
    alike = F.zip_with(_words(F.col("words")), _words(F.col("theirs")), lambda a, b: (a == b) | (~F.col("led") & (a > b)))
    return alone.unionByName(_agreeing(both, alike)).unionByName(_voted(several.filter("NOT (led OR pair)")))


def _agreeing(lines: DataFrame, alike: Column) -> DataFrame:
    """Lines that have the template's word in enough of their positions; ``alike`` says it for each."""
    enough = F.size(F.filter(alike, lambda x: x)) >= AGREE * F.size(_words(F.col("words")))
    return lines.filter(enough).select("leaf", "same", "template")


def _voted(grouped: DataFrame) -> DataFrame:
    words = grouped.select("template", "docs", F.posexplode(_words(F.col("words"))).alias("i", "word")).groupBy("template", "i", "word").agg(F.sum("docs").alias("docs"))
    most = words.groupBy("template", "i").agg(F.max(F.struct("docs", "word")).alias("top"), F.sum("docs").alias("all"))
    fixed = most.select("template", "i", F.when(F.col("top.docs") * 2 >= F.col("all"), F.col("top.word")).alias("word"))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]).alias("fixed")
    templates = fixed.groupBy("template").agg(in_order)
    alike = F.zip_with(_words(F.col("words")), "fixed", lambda a, b: F.coalesce(a == b, F.lit(False)))
    return _agreeing(grouped.join(templates, "template"), alike)


def recurring_lines(docs: DataFrame, text: str = "text", least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """``body`` (of the text) and ``places`` of the lines to drop, for texts that have such lines."""
    # texts are cut once; what reads the numbers of lines alone leaves their words in the files
    lines = store(_lines(docs, text, least_documents).select("body", "place", "chars", "leaf", "need", F.xxhash64("line").alias("whole_line"), "tidy"), "lines")
    light = lines.drop("tidy")
    words = _masked(F.col("tidy")).alias("words")
    # by a shuffle whatever the number of leaves, so that the plan for much text is that for little; only the leaves are held, lines are not sorted
    held = lines.join(_in_enough(light, ["leaf"]).hint("shuffle_hash"), "leaf", "left_semi").select("body", "place", "chars", "leaf", "need", words)
    held = store(held.withColumn("same", F.xxhash64("words")), "leaf-lines")
    of_text = store(held.select("leaf", "same", "need", "body").distinct(), "lines-of-texts")
    counts = of_text.groupBy("leaf", "same").agg(F.count("*").alias("docs"))
    equal = held.groupBy("leaf", "same", "need").agg(F.first("words").alias("words")).join(counts, ["leaf", "same"])
    split = F.explode(F.array(_words(F.col("words")))).alias("each")  # once, also for the length
    equal = equal.select("*", split).withColumn("n", F.size("each"))
    equal = store(equal.withColumn("parts", _stretches(F.col("each"), F.col("n"))).drop("each"), "equal-lines")
    found = [equal.filter("docs >= need").select("leaf", "same", F.xxhash64("leaf", "same").alias("template"), F.lit(1).alias("own"))]
    left = equal.filter(F.col("n") >= SHORT_WORDS).drop("n")
    while True:  # each round takes lines away, and the last one finds none
        instances = store(_instances(left), "instances")
        several = _in_enough(instances.join(of_text, ["leaf", "same"]), ["template"])
        new = store(instances.join(several, "template").select("leaf", "same", "template", F.lit(0).alias("own")), "recurring")
        if new.isEmpty():
            break
        found.append(new)
        left = left.join(new, ["leaf", "same"], "left_anti")
        still = of_text.join(left.select("leaf", "same"), ["leaf", "same"], "left_semi")
        left = store(left.join(_in_enough(still, ["leaf"]), "leaf", "left_semi"), "left-lines")
    # the template of a stretch holds all lines that are the same, so it stands for both
    one = reduce(DataFrame.unionByName, found).groupBy("leaf", "same").agg(F.min_by("template", "own").alias("template"))
    recurring = store(held.drop("words").join(one, ["leaf", "same"]).select("body", "place", "chars", "need", "template").distinct(), "recurring-lines")
    counted = recurring.join(_copies(light.drop("leaf", "need"), recurring), "body", "left").withColumn("text_id", F.coalesce("copy_of", "body"))
    several = counted.select("template", "need", "text_id").distinct().groupBy("template", "need").agg(F.count("*").alias("docs")).filter("docs >= need")
    return recurring.join(several.select("template"), "template", "left_semi").groupBy("body").agg(F.collect_set("place").alias("places"))


def _copies(lines: DataFrame, recurring: DataFrame) -> DataFrame:
    """``body``, ``copy_of``: one text for all that are copies of each other, for texts that have copies which are not equal.

    Of the texts of about the same length that hold a template, each is compared to the one with the smallest hash, and of
    these a text takes the one that leads most of it. The two are copies if lines they share are ``COPY`` of the longer.
    """
    lines = store(lines.join(recurring.select("body").distinct().hint("shuffle_hash"), "body", "left_semi").distinct(), "lines-beside")
    chars = store(lines.groupBy("body").agg(F.sum("chars").alias("whole")), "lengths")
    octave = F.log2(F.greatest(F.col("whole"), F.lit(1)))
    sizes = F.array(2 * F.floor(octave), 2 * F.floor(octave + 0.5) + 1)
    held = recurring.drop("need").join(chars, "body").withColumn("size", F.explode(sizes))
    held = store(held.drop("whole"), "held-lines")
    led = held.join(held.groupBy("template", "size").agg(F.min("body").alias("other")), ["template", "size"]).filter("other <> body")
    each = led.select("body", "other", "place", "chars").distinct().groupBy("body", "other").agg(F.sum("chars").alias("chars"))
    pairs = store(each.groupBy("body").agg(F.max(F.struct("chars", "other")).alias("top")).select("body", "top.other"), "pairs")
    either = pairs.select("body").unionByName(pairs.select(F.col("other").alias("body"))).distinct()
    marks = lines.select("body", "place", "chars", F.col("whole_line").alias("mark")).unionByName(recurring.select("body", "place", "chars", F.col("template").alias("mark")))
    marks = store(marks.join(either, "body", "left_semi"), "marks")
    theirs = marks.select(F.col("body").alias("other"), "mark").distinct()
    shared = pairs.join(marks, "body").join(theirs, ["other", "mark"]).select("body", "other", "place", "chars").distinct()
    both = shared.groupBy("body", "other").agg(F.sum("chars").alias("shared")).join(chars, "body")
    both = both.join(chars.select(F.col("body").alias("other"), F.col("whole").alias("others")), "other")
    links = both.filter(F.col("shared") >= COPY * F.greatest("whole", "others")).select(F.col("body").alias("a"), F.col("other").alias("b"))
    return components(links).select(F.col("node").alias("body"), F.col("component").alias("copy_of"))


def drop_recurring(docs: DataFrame, text: str = "text", least_documents: int = LEAST_DOCUMENTS, into: str = "n_dropped") -> DataFrame:
    """``docs`` with recurring lines taken out of ``text`` and their number in ``into``.

    Lines are parted by ``\\n``; the others keep their order, blank ones too. A null text stays null and drops nothing.
    Equal texts count once and get the same result, whatever their keys, which play no part and may be null.
    A document that consists of recurring lines alone ends without words. All other columns stay; one named like ``into`` is replaced.
    """
    drops = store(recurring_lines(docs, text, least_documents), "drops").select(F.struct("body", "places").alias("_drop"))
    rows = docs.drop(into).withColumn("_body", body_of(F.col(text)))
    joined = rows.join(drops.hint("shuffle_hash"), F.col("_body") == F.col("_drop.body"), "left")
    lines = F.split(F.col(text), "\n")
    kept = lambda found: F.array_except(F.sequence(F.lit(0), F.size(found) - 1), F.col("_drop.places"))
    cleaned = let(lines, lambda found: F.array_join(F.transform(kept(found), lambda i: F.get(found, i)), "\n"))
    done = joined.withColumn(into, F.coalesce(F.size("_drop.places"), F.lit(0)).cast("long"))
    done = done.withColumn(text, F.when(F.col("_drop.places").isNotNull(), cleaned).otherwise(F.col(text)))
    return done.drop("_drop", "_body")
