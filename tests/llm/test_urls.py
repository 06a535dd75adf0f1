import math
import random
import re
from collections import Counter
from itertools import combinations

from lectern.llm import urls as U
from lectern.llm.queries import RULES

PAGE = "page_id long, url string, html string"


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
    path = rest[n:]
    for c in "?#":
        path = path.split(c, 1)[0]
    return host, path


def plain_rule(host, path):
    fits = [r for r in RULES for name, _, start in [r.partition("/")] if (host == name or host.endswith("." + name)) and path.startswith("/" + start)]
    return min(fits, key=lambda r: (-len(r), r), default=None)


URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.com/en/7", "https://a.example.com/en/8", "x://example.com/en/7?x#y", "http://notexample.com/en/70", "http://b.net/de/1", "http://www.example.net/de/81",
    "http://org/es/", "http://a.org/es", "http://a.org?q=/es/", "http://com/en/", "http://com/en", "http://casino-win.example.com/fr/1", "http://cheappills.example.org/en/2", "https://cheappills.example.org/de/3#t",
    "http://blog.daynight.example.com/fr/4", "http://É.example.com/fr/" + "9" * 5000, "http://" + "dayandnight" * 500 + ".com/fr", "http://a\nb.com/x\ny", "http://u:p@h.com:80/fr/x", "://x/y", "a://b://c/d",
]


def test_judged_urls(spark):
    pages = [(i, u, "<p>day and night and day night blog</p><script>casino casino</script>", "h", 1) for i, u in enumerate(URLS)] + [(4, URLS[4], None, "h", 1)]
    # naive Bayes learns what is ordinary from ordinary urls
    pages += [(100 + i, f"http://{'www' if i % 2 else 'blog'}.day{'night' if i % 3 else ''}.example.com/fr/{i}", None, "h", 1) for i in range(30)]
    got = U.judge(spark.createDataFrame(pages, PAGE + ", host string, words int"), RULES, [U.F.col("html")]).collect()
    assert len(got) == len(pages)
    for r in got:
        host, path = plain_parts(r["url"])
        rule = plain_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (RULES[rule] if rule else r["verdict"]) and r["verdict"] in ("allow", "block")
        if not host:
            assert r["verdict"] == "allow"
    by = {r["url"]: r for r in got}
    assert by["http://casino-win.example.com/fr/1"]["verdict"] == "block"
    assert by["https://cheappills.example.org/de/3#t"]["words"][:2] == ["cheap", "pills"] and by["https://cheappills.example.org/de/3#t"]["verdict"] == "block"
    assert by["http://blog.daynight.example.com/fr/4"]["words"] == ["blog", "day", "night", "example", "com"] and by["http://blog.daynight.example.com/fr/4"]["verdict"] == "allow"


def test_empty_tables(spark):
    empty = spark.createDataFrame([], PAGE)
    assert U.judge(empty, RULES, [U.F.col("html")]).count() == 0


def test_viterbi_against_all_splits():
    counts, total = {"a": 5, "ab": 3, "b": 1, "abc": 2, "ca": 4, "bca": 1}, 16
    score = lambda parts: sum(math.log(counts[p]) - math.log(total + 1) if p in counts else -math.log(total + 1) - math.log(10) * len(p) for p in parts)
    for word in ("abcab", "aaaa", "xabcx", "bcabca", "x", "cabab"):
        splits = [[word[i:j] for i, j in zip((0, *c), (*c, len(word)), strict=True)] for n in range(len(word)) for c in combinations(range(1, len(word)), n)]
        assert math.isclose(score(U.viterbi(word, counts, total)), max(map(score, splits)))
    assert U.viterbi("q" * 300, counts, total) == ["q" * 300] and U.viterbi("", counts, total) == []
    known = {"casino": 100, "win": 100}
    assert U.viterbi("casino" + "q" * 30, known, 1000) == ["casino", "q" * 30] and U.viterbi("q" * 30 + "casino", known, 1000) == ["q" * 30, "casino"]
    assert U.viterbi("win" + "q" * 70 + "win", known, 1000) == ["win", "q" * 70, "win"]
    assert U.viterbi("incomprehensibilities" + "win", {**known, "incomprehensibilities": 3}, 1000) == ["incomprehensibilities", "win"]


def plain_bayes(urls, seeds=U.SEEDS):
    """Odds of each (host words, path) with counts by word kept in dictionaries; learned from urls that train."""
    tokens = lambda words, path: [f"h/{w}" for w in words] + [f"p/{w}" for w in re.split(r"[^a-z0]+", re.sub(r"[0-9]", "0", path.lower())) if w]
    n, counts = Counter(), {True: Counter(), False: Counter()}
    for words, path, train in urls:
        if train:
            bad = any(w in seeds for w in words)
            n[bad] += 1
            counts[bad].update(tokens(words, path))
    of = {k: sum(c.values()) for k, c in counts.items()}
    out = []
    for words, path, _ in urls:
        odds = math.log((n[True] + 1) / (n[False] + 1))
        for t in tokens(words, path):
            both = counts[True][t] + counts[False][t]
            if both:
                share = both / sum(of.values())
                odds += math.log((counts[True][t] + U.SMOOTHING * share) / (of[True] + U.SMOOTHING) * (of[False] + U.SMOOTHING) / (counts[False][t] + U.SMOOTHING * share))
        out.append(odds)
    return out


HTML = "<p>day and night and day night blog garden river stone cloud winter winter</p>"


def test_learned_words_judge_urls_without_a_seed(spark):
    """Naive Bayes against plain counting, held-out urls, and verdicts that a list of the seeds can't give."""
    rng = random.Random(3)
    urls = []
    for i in range(400):
        urls.append((f"http://{rng.choice(['day', 'night', 'garden', 'river'])}{rng.choice(['stone', 'cloud', 'news'])}.example.org/{rng.choice(['read', 'about'])}/{i}", True))
        if i % 4 == 0:
            urls.append((f"http://{rng.choice(['casino', 'bets'])}{rng.choice(['win', 'bonus'])}.example.org/{rng.choice(['signup', 'spin'])}/{i}", True))
    held = [("http://winbonus.example.org/spin/1", "block"), ("http://bonus-win.example.org/signup/2", "block"), ("http://rivernight.example.org/read/7", "allow"), ("http://winter.example.org/about/3", "allow")]
    held += [("http://bets-news-river-night-garden-stone-cloud.example.org/read/about/read/about", "allow")]  # a seed that all else outweighs
    rows = [(i, u, HTML, t) for i, (u, t) in enumerate([*urls, *((u, False) for u, _ in held)])]
    got = sorted(U.judge(spark.createDataFrame(rows, PAGE + ", learn boolean"), {}, [U.F.col("html")], train=U.F.col("learn")).collect(), key=lambda r: r["page_id"])
    want = plain_bayes([(r["words"], r["path"], r["learn"]) for r in got])
    assert all(math.isclose(r["odds"], w, abs_tol=1e-6) for r, w in zip(got, want, strict=True))
    assert [r["verdict"] for r in got if not r["learn"]] == [v for _, v in held]
    listed = lambda r: "block" if any(w in U.SEEDS for w in r["words"]) else "allow"
    assert sum(r["verdict"] != listed(r) for r in got if not r["learn"]) == 3


def test_a_bad_word_stays_bad_among_many_words(spark):
    """Odds don't depend on how many other words there are: no two words share a count."""
    rows = [(i, f"http://site{chr(97 + i % 26)}.example.org/{_word(i)}", HTML) for i in range(20_000)]
    rows += [(30_000 + i, f"http://casino{i}.example.org/rarebadpath" if i % 2 else f"http://casino.example.org/{_word(i)}", HTML) for i in range(40)]
    rows += [(40_000, "http://sitea.example.org/rarebadpath/rarebadpath", HTML)]
    got = {r["page_id"]: r for r in U.judge(spark.createDataFrame(rows, PAGE), {}, [U.F.lit("")]).where("page_id >= 30000 or verdict = 'block'").collect()}
    assert all(r["verdict"] == "block" for i, r in got.items() if i >= 30_000) and min(got) == 30_000


def _word(i):
    return "".join(chr(97 + i // 26**k % 26) for k in range(4))


def test_query_rules(spark, sf):
    from lectern.llm.queries import op3_urls

    url = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op3_urls(spark, sf).collect()
    assert len(got) == len(url)
    for r in got:
        host, path = plain_parts(url[r["page_id"]])
        rule = plain_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (not rule or r["verdict"] == RULES[rule])
        if not rule:
            assert r["verdict"] == ("block" if any(w in host for w in ("spam-farm", "cheap-pills", "casino-win", "free-bets", "ads-track", "adult-x")) else "allow")
