"""Line dedup with a log-template tree.

Every line walks down a tree of fixed depth: by its number of words, then by its first DEPTH words. Words with digits are
variable fields (<*>) from the start. In a leaf the other fields are found by how often a word stands at a place: of a
line's words the SIMILAR share that is most frequent at their places is its backbone, words less than half as frequent as
its rarest one are variable, wherever and however many they are. What is left, words with their places, is the line's
template. Lines that differ in up to 1 - SIMILAR of their words meet in one, without an order of arrival.

A template that recurs in at least MIN_DOCS documents of different text is boilerplate; a line is dropped if its template
is. The longer a line, the less can chance explain that it recurs: above SHORT words the number falls with the length,
down to FEW. So few documents could be versions of one text, so fewer than MIN_DOCS count only as far as they are
unrelated: two are related if more than half the lines of one have a template in common with the other, and of related
ones the first by digest counts.

Documents of equal text count once, so copies of a document don't make its lines recur. Most lines stand alone in their
leaf; only those of leaves with FEW lines or more are taken into words (with fewer if MIN_DOCS is less). Leaves and
templates are 64-bit hashes, counted with partial sums: two of n lines' hashes are equal by chance in about n^2 / 2^65 of
all cases, and a line would be dropped for it only if that took its template to MIN_DOCS. Texts aren't shuffled unless the lists of dropped lines are too large to be sent to all executors.
DataFrame expressions only.

Defined results: blank lines match nothing and stay; null texts stay null; a document may become empty, it is never
dropped; repeated rows get the same result; no rows give none. Other columns are passed through, but for one that bears
the name of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import SENT_BYTES, cut, sent, text_key

#: SIMILAR in hundredths.
DEPTH, SIMILAR, MIN_DOCS = 3, 70, 10
#: Words up to which a line has to stand in MIN_DOCS documents (at twice the words in half as many), and the fewest.
SHORT, FEW = 15, 3
RELATED = 0.5


def normal(line: Column, odd: Column) -> Column:
    """The line's words with one space between them; most lines are so already. odd: other white space may occur."""
    uneven = odd | line.startswith(" ") | line.endswith(" ") | line.contains("  ")
    return F.when(uneven, F.trim(F.regexp_replace(line, r"[ \t\x0B\f\r]+", " "))).otherwise(line)


def fields(line: Column) -> Column:
    """A normal line with its words that have digits as <*>."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^ ]*[0-9][^ ]*", "<*>")).otherwise(line)


def fewest(min_docs: int) -> int:
    """The number of lines below which a leaf or a word can't matter."""
    return min(FEW, min_docs)


def needed(n: Column, min_docs: int) -> Column:
    return F.least(F.lit(min_docs), F.greatest(F.lit(fewest(min_docs)), F.ceil(F.lit(min_docs * SHORT) / n))).cast("int")


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    # key and odd first: beside the explode they would be worked out once for every line
    odd = F.col(text).rlike(r"[\t\x0B\f\r]")
    return docs.where(F.col(text).isNotNull()).select(text_key(F.col(text)).alias("key"), odd.alias("odd"), F.col(text).alias("text"))


def _lines(keyed: DataFrame) -> DataFrame:
    """(key, line, n, leaf, of) of all lines that aren't blank."""
    raw = keyed.select("key", "odd", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    lines = raw.select("key", "line", normal(F.col("raw"), F.col("odd")).alias("of")).where("of <> ''")
    counted = lines.withColumn("n", F.octet_length("of") - F.octet_length(F.replace("of", F.lit(" "), F.lit(""))) + 1)
    return counted.withColumn("leaf", F.xxhash64("n", fields(F.substring_index("of", " ", DEPTH))))


def line_templates(docs: DataFrame, text: str = "text", few: int = FEW) -> DataFrame:
    """(key, line, n, t): the template of each line that has one; lines without can't recur in few documents."""
    keyed = _keyed(docs, text)
    leaves = cut(_lines(keyed).groupBy("leaf").agg(F.count("*").alias("m")).where(F.col("m") >= few).select("leaf"))
    crowded = _lines(keyed).join(sent(leaves, 16), "leaf", "left_semi")
    at = cut(crowded.select("key", "line", "n", "leaf", fields(F.col("of")).alias("of")).withColumn("whole", F.xxhash64("leaf", "of")))
    contents = at.select("key", "whole", "n", "leaf", "of").distinct().groupBy("whole", "n", "leaf", "of").agg(F.count("*").alias("m"))
    # the first words, one for the leaf, are place 0
    head = F.substring_index("of", " ", DEPTH)
    after = F.when(F.col("n") > DEPTH, F.split(F.substring(F.col("of"), F.length(head) + 2, F.length("of")), " ")).otherwise(F.array().cast("array<string>"))
    words = cut(contents.select("whole", "n", "leaf", "m", F.posexplode(F.concat(F.array(head), after)).alias("at", "word")).select("whole", "n", "m", "at", F.xxhash64("leaf", "at", "word").alias("w")))
    often = cut(words.groupBy("w").agg(F.sum("m").alias("c")).where(F.col("c") >= few))
    met = words.join(sent(often, 32), "w").groupBy("whole", "n").agg(F.sort_array(F.collect_list(F.struct("at", "w", "c"))).alias("ws"))
    least = F.col("backbone") - F.least("n", F.lit(DEPTH))
    ranked = F.sort_array(F.transform(F.slice("ws", 2, F.size("ws")), lambda x: x["c"]), asc=False)
    based = met.where(F.col("ws")[0]["at"] == 0).withColumn("backbone", F.floor((F.col("n") * SIMILAR + 99) / 100).cast("int")).where(F.size("ws") > least)
    fixed = based.select("whole", "ws", F.when(least > 0, F.element_at(ranked, F.greatest(least, F.lit(1)))).otherwise(F.col("ws")[0]["c"]).alias("rarest"))
    kept = F.transform(F.filter("ws", lambda x: (x["at"] == 0) | (x["c"] * 2 >= F.col("rarest"))), lambda x: x["w"])
    found = cut(fixed.select("whole", F.xxhash64(kept).alias("t")))
    return at.select("key", "line", "n", "whole").join(sent(found, 32), "whole").select("key", "line", "n", "t")


def dropped_lines(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """(key, lines): for each text, by text_key, the numbers of the lines that are dropped."""
    marked = cut(line_templates(docs, text, fewest(min_docs)))
    counts = marked.select("t", "n", "key").distinct().groupBy("t", "n").agg(F.count("*").alias("docs"))
    counts = cut(counts.withColumn("need", needed(F.col("n"), min_docs)).where("docs >= need"))
    often = counts.where(F.col("docs") >= min_docs).select("t")
    few = counts.where(F.col("docs") < min_docs).select("t", "need")
    if not few.isEmpty():
        often = cut(often.union(_in_unrelated(_keyed(docs, text), marked, few)))
    hit = marked.join(sent(often, 16), "t", "left_semi")
    return hit.groupBy("key").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def _in_unrelated(keyed: DataFrame, marked: DataFrame, few: DataFrame) -> DataFrame:
    """Of templates (t, need) of fewer than MIN_DOCS documents, those that stand in need unrelated ones."""
    at = cut(marked.select("t", "key").join(sent(few), "t").distinct())
    one, other = at.select("t", F.col("key").alias("one")), at.select("t", F.col("key").alias("other"))
    both = cut(one.join(other, "t").where("one <> other"))  # less than MIN_DOCS of a template
    keys = cut(at.select("key").distinct())
    own = cut(marked.select("key", "line", "t").distinct().join(sent(keys), "key", "left_semi"))
    size = keyed.join(sent(keys), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")).select("key", F.regexp_count("text", F.lit(r"[^\s][^\n]*")).alias("lines"), F.md5(F.col("text").cast("binary")).alias("digest"))
    theirs = own.select(F.col("key").alias("other"), "t").distinct()
    shared = both.select("one", "other").distinct().join(own.withColumnRenamed("key", "one"), "one").join(theirs, ["other", "t"]).groupBy("one", "other").agg(F.count_distinct("line").alias("shared"))
    near = shared.join(size.withColumnRenamed("key", "one"), "one").where(F.col("shared") > RELATED * F.col("lines")).drop("lines")
    near = near.join(size.select(F.col("key").alias("other"), F.col("digest").alias("theirs")), "other")
    second = F.col("digest") > F.col("theirs")
    related = near.select(F.when(second, F.col("one")).otherwise(F.col("other")).alias("one"), F.when(second, F.col("other")).otherwise(F.col("one")).alias("other")).distinct()
    later = both.join(related, ["one", "other"]).select("t", F.col("one").alias("key")).distinct()
    return at.join(later, ["t", "key"], "left_anti").groupBy("t").agg(F.count("*").alias("docs"), F.first("need").alias("need")).where("docs >= need").select("t")


def without(text: Column, gone: Column) -> Column:
    """The text without the lines of these numbers (sorted): the stretches between them, one slice each."""

    def stretches(ls: Column) -> Column:
        bounds = F.arrays_zip(F.concat(F.array(F.lit(-1)), gone).alias("after"), F.concat(gone, F.array(F.size(ls))).alias("until"))
        return F.array_join(F.flatten(F.transform(bounds, lambda b: F.slice(ls, b["after"] + 2, b["until"] - b["after"] - 1))), "\n")

    # through an array of one, so that the text is split once
    return F.transform(F.array(F.split(text, "\n")), stretches)[0]


def drop_lines(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, name: str = "dropped") -> DataFrame:
    """The documents with their text without recurring lines, and name: the numbers of those lines."""
    gone = cut(dropped_lines(docs, text, min_docs))
    n, lines = gone.agg(F.count("*"), F.sum(F.size("lines"))).first()
    packed = docs.select(text_key(F.col(text)).alias("key"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    both = packed.join(F.broadcast(gone) if 64 * n + 4 * (lines or 0) <= SENT_BYTES else gone, "key", "left")
    cleaned = F.when(F.col("lines").isNull(), F.col("row")[text]).otherwise(without(F.col("row")[text], F.col("lines")))
    own = [(cleaned if c == text else F.col("row")[c]).alias(c) for c in docs.columns if c != name]
    return both.select(*own, F.coalesce("lines", F.array().cast("array<int>")).alias(name))
