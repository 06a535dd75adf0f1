"""URL filters: rules, and behind them naive Bayes over segmented host names.

Host names run words together. The pieces of a host (runs of letters between dots, hyphens and digits) are split by a
unigram Viterbi: word probabilities come from all texts given, and the split with the highest product wins. A multinomial
naive Bayes over the words of the host and the parts of the path then scores a url.

Its labels are weak: urls with a word of SEEDS in their host are bad examples, the others background. The seeds are few;
the words that stand beside them in hosts and paths are learned with them and then judge hosts that have no seed, as
words that stand in many other urls speak for a url that has one. A word's share among bad or other words is smoothed by
its share among all words, so a rare word that no bad url has never speaks against a url.

Vocabulary and model are tables by word, joined and never sent around unless they are small: pieces are turned into their
substrings, which meet the word counts in a join; odds are summed for distinct hosts and distinct paths.

Rules. `HOST/PATH` fits urls of the host and its subdomains whose path starts with /PATH; the longest that fits wins
(ties: the first of them by code point), and what no rule fits is judged by naive Bayes.

Defined results: the host stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased, the path from
there up to `?`, `#` or the end; null or no `://`: both empty, and allowed. Without bad examples all is allowed. Repeated
rows are judged alike; no rows give none. Other columns are passed through, but for those that bear a result's name.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, sent

#: Words that make a url a bad example to learn from; a parameter.
SEEDS = ("ads", "adult", "bets", "casino", "pills", "poker", "porn", "spam", "viagra", "xxx")
#: Words known from the start, each as if seen PRIOR times: the seeds and words that host names are often made of.
COMMON = (
    "bet", "blog", "bonus", "cheap", "click", "com", "example", "farm", "free", "loan", "loans", "mobile", "net", "news",
    "online", "org", "sex", "shop", "slots", "store", "track", "tracker", "web", "wiki", "win", "www",
)
PRIOR = 100
#: A label of a host name has at most 63 octets, so no longer word can stand in one.
LONGEST = 63
#: Weight of the share among all words in a word's share among bad or other ones.
SMOOTHING = 1.0


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest of the rules (`HOST/PATH` -> verdict) that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r), r))[::-1]:
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def word_counts(texts: Iterable[Column], frame: DataFrame) -> DataFrame:
    """(word, n) of all runs of letters in the texts, markup left out, lower-cased."""
    text = F.concat_ws(" ", *texts)
    bare = F.regexp_replace(F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^<>]*>|&\w+;", " ")
    found = frame.select(F.explode(F.split(F.lower(bare), r"[^\p{L}]+")).alias("word"))
    return found.where((F.length("word") > 0) & (F.length("word") <= LONGEST)).groupBy("word").agg(F.count("*").alias("n"))


def viterbi(piece: str, counts: dict[str, int], total: int) -> list[str]:
    """The split of a piece into words of the greatest probability; a run of unknown letters is one word of any length.

    An unknown run of k letters has probability 1 / (total * 10^k). Ties: fewer words, then the longer last word.
    """
    new, letter = -math.log(total + 1), -math.log(10)
    longest = max(map(len, counts), default=0)
    # of the best split up to each place, and of the best one that ends in an unknown run: score, words, start of the last
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
    run: tuple[float, int, int] | None = None
    rank = lambda o: (round(o[0], 9), -o[1], -o[2])
    for j in range(1, len(piece) + 1):
        options = [(best[j - 1][0] + new + letter, best[j - 1][1] + 1, j - 1)]
        if run:
            options.append((run[0] + letter, run[1], run[2]))
        run = max(options, key=rank)
        options = [run]
        for i in range(max(0, j - longest), j):
            if c := counts.get(piece[i:j]):
                options.append((best[i][0] + math.log(c) + new, best[i][1] + 1, i))
        best.append(max(options, key=rank))
    out, j = [], len(piece)
    while j:
        i = best[j][2]
        out.append(piece[i:j])
        j = i
    return out[::-1]


def segment(hosts: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(host, words) of distinct hosts: the words of all their pieces in order."""
    pieces = hosts.select("host", F.posexplode(F.split("host", r"[^\p{L}]+")).alias("at", "piece")).where("piece <> ''")
    distinct = pieces.select("piece").distinct()
    starts = distinct.select("piece", F.explode(F.sequence(F.lit(1), F.length("piece"))).alias("i"))
    cuts = starts.select("piece", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("piece") - F.col("i") + 1)), lambda n: F.substring(F.col("piece"), F.col("i"), n))).alias("word")).distinct()
    known = distinct.join(cuts.join(counts, "word").groupBy("piece").agg(F.collect_list(F.struct("word", "n")).alias("known")), "piece", "left")

    @F.pandas_udf("array<string>")
    def split(piece: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([viterbi(p, {x["word"]: x["n"] for x in (k if k is not None else [])}, total) for p, k in zip(piece, known, strict=True)])

    words = known.select("piece", split("piece", "known").alias("words"))
    ordered = pieces.join(words, "piece").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias("all"))
    return hosts.select("host").join(ordered.select("host", F.flatten("all.words").alias("words")), "host", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))


def path_words(path: Column) -> Column:
    """The parts of a path, lower-cased; digits count as 0, so that numbers of equal length are one word."""
    return F.filter(F.split(F.regexp_replace(F.lower(path), r"\d", "0"), r"[^\p{L}0]+"), lambda w: w != "")


def _summed(tokens: DataFrame, odds: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): the odds of a key's tokens, repeats counted; tokens without odds count nothing."""
    return tokens.join(sent(odds, 128), "token").groupBy(key).agg(F.sum("odds").alias(name))


def word_odds(urls: DataFrame, words: DataFrame, seeds: tuple[str, ...] = SEEDS) -> tuple[DataFrame, float]:
    """(token, odds) of host words `h/...` and path words `p/...`, and the odds of the class itself.

    urls: host, at (path words in one string) and pages; words: host, words. Odds are logarithms, bad against others.
    """
    bad = F.arrays_overlap("words", F.array(*(F.lit(w) for w in seeds)))
    marked = urls.join(words.select("host", bad.alias("bad")), "host")
    # words weigh by the urls that have them: counted once a host and once a path, however many urls these have
    hosts = marked.groupBy("host", "bad").agg(F.sum("pages").alias("pages")).join(words, "host")
    of_hosts = hosts.select("bad", "pages", F.explode(F.transform("words", lambda w: F.concat(F.lit("h/"), w))).alias("token"))
    of_paths = marked.groupBy("at", "bad").agg(F.sum("pages").alias("pages")).select("bad", "pages", F.explode(_path_tokens()).alias("token"))
    sums = [F.sum(F.when(F.col("bad"), F.col("pages")).otherwise(0)).alias("b"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("pages"))).alias("g")]
    counts = cut(of_hosts.union(of_paths).groupBy("token").agg(*sums))
    b, g = (float(x or 0) for x in counts.agg(F.sum("b"), F.sum("g")).first())
    n = marked.agg(*sums).first()
    prior = math.log(((n["b"] or 0) + 1) / ((n["g"] or 0) + 1)) if b else -math.inf
    share = (F.col("b") + F.col("g")) / max(1.0, b + g)
    part = lambda x, of: (F.col(x) + SMOOTHING * share) / (of + SMOOTHING)
    return cut(counts.select("token", F.log(part("b", b) / part("g", g)).alias("odds"))), prior


def _path_tokens() -> Column:
    return F.transform(F.filter(F.split("at", "/"), lambda w: w != ""), lambda w: F.concat(F.lit("p/"), w))


def judge(pages: DataFrame, rules: dict[str, str], texts: Iterable[Column], url: str = "url", seeds: tuple[str, ...] = SEEDS, train: Column | None = None) -> DataFrame:
    """The pages' columns with host, path, rule, words, odds (of bad, in logarithms) and verdict.

    Columns of these names are replaced. Naive Bayes learns from the rows of train, by default from all.
    """
    host, path = parts(F.col(url))
    own = pages.withColumns({"_train": F.lit(True) if train is None else F.coalesce(train, F.lit(False)), "_host": host, "_path": path})
    split = own.drop(*({"host", "path", "words", "odds", "rule", "verdict"} - {url})).withColumnsRenamed({"_host": "host", "_path": "path"}).withColumn("_at", F.array_join(path_words(F.col("path")), "/"))
    known = pages.sparkSession.createDataFrame([(w, PRIOR) for w in sorted({*seeds, *COMMON})], "word string, n long")
    counts = cut(word_counts(texts, pages).union(known).groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0]
    urls = cut(split.groupBy("host", F.col("_at").alias("at"), "_train").agg(F.count("*").alias("pages")))
    words = cut(segment(urls.select("host").distinct(), counts, total))
    odds, prior = word_odds(urls.where("_train"), words, seeds)
    by_host = words.select("host", F.explode(F.transform("words", lambda w: F.concat(F.lit("h/"), w))).alias("token"))
    by_path = urls.select("at").distinct().select("at", F.explode(_path_tokens()).alias("token"))
    hosts = cut(words.join(_summed(by_host, odds, "host", "_h"), "host", "left"))
    paths = cut(_summed(by_path, odds, "at", "_p")).withColumnRenamed("at", "_at")
    scored = split.join(sent(hosts, 256), "host").join(sent(paths, 128), "_at", "left")
    scored = scored.withColumn("odds", F.lit(prior) + F.coalesce("_h", F.lit(0.0)) + F.coalesce("_p", F.lit(0.0))).drop("_h", "_p", "_at", "_train")
    rule = rule_for(F.col("host"), F.col("path"), rules)
    by_rule = F.create_map(*(F.lit(x) for kv in rules.items() for x in kv))[F.col("rule")] if rules else F.lit(None)
    by_odds = F.when((F.col("odds") > 0) & (F.col("host") != ""), F.lit("block")).otherwise(F.lit("allow"))
    done = scored.withColumn("rule", rule).withColumn("verdict", F.coalesce(by_rule, by_odds))
    results = ("host", "path", "rule", "words", "odds", "verdict")
    return done.select(*(c for c in pages.columns if c not in results or c == url), *(c for c in results if c != url))
