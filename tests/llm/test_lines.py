import hashlib
import math
import random
import re
from collections import Counter

from lectern.llm import lines as L

DOC = "doc_id long, text string"


def plain_words(line):
    return ["<*>" if re.search(r"[0-9]", w) else w for w in re.split(r"[ \t\x0b\f\r]+", line.strip(" \t\x0b\f\r")) if w]


def plain_templates(texts, few=L.FEW):
    """{(text, line): template} by counting every word at every place of a leaf over the texts."""
    lines = {}
    for text in texts:
        for i, line in enumerate(text.split("\n")):
            if w := plain_words(line):
                lines[text, i] = (len(w), " ".join(w[: L.DEPTH])), tuple([" ".join(w[: L.DEPTH]), *w[L.DEPTH :]])
    count = Counter()
    for (leaf, words), _ in {(at, text) for (text, _), at in lines.items()}:
        count.update((leaf, i, w) for i, w in enumerate(words))
    out = {}
    for at, (leaf, words) in lines.items():
        n = leaf[0]
        c = [x if x >= few else 0 for x in (count[leaf, i, w] for i, w in enumerate(words))]
        k = math.ceil(n * L.SIMILAR / 100) - min(n, L.DEPTH)
        rarest = sorted(c[1:], reverse=True)[k - 1] if k > 0 else c[0]
        if c[0] and rarest:
            out[at] = leaf, tuple((i, w) for i, w in enumerate(words) if i == 0 or c[i] and 2 * c[i] >= rarest)
    return out


def plain_drop(rows, min_docs):
    texts = {t for _, t in rows if t is not None}
    key = {t: hashlib.md5(t.encode()).hexdigest() for t in texts}
    of = plain_templates(texts, min(L.FEW, min_docs))
    docs, own = {}, {}
    for (text, _), t in of.items():
        docs.setdefault(t, set()).add(text)
    for (text, i), t in of.items():
        own.setdefault(text, []).append(t)

    def related(a, b):
        size = sum(1 for line in a.split("\n") if line.strip())
        return 2 * sum(1 for t in own[a] if b in docs[t]) > size

    def boilerplate(t):
        n, found = t[0][0], docs[t]
        need = min(min_docs, max(min(L.FEW, min_docs), math.ceil(min_docs * L.SHORT / n)))
        if len(found) >= min_docs:
            return True
        return len(found) >= need and sum(not any(key[b] < key[a] and (related(a, b) or related(b, a)) for b in found) for a in found) >= need

    gone_ = {t for t in docs if boilerplate(t)}
    out = []
    for d, text in rows:
        if text is None:
            out.append((d, None, []))
            continue
        gone = [i for i, _ in enumerate(text.split("\n")) if of.get((text, i)) in gone_]
        out.append((d, "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone), gone))
    return sorted(out, key=repr)


def dropped(spark, rows, min_docs, schema=DOC):
    got = L.drop_lines(spark.createDataFrame(rows, schema), min_docs=min_docs)
    return sorted(((r["doc_id"], r["text"], r["dropped"]) for r in got.collect()), key=repr)


def test_against_plain_tree(spark):
    rng = random.Random(11)
    base = [" ".join(rng.choices("alpha beta gamma delta eps zeta".split(), k=rng.randint(1, 14))) for _ in range(30)]
    rows = []
    for i in range(80):
        own = []
        for line in rng.choices(base, k=4):
            words = line.split()
            words[rng.randrange(len(words))] = rng.choice([words[0], f"n{rng.randint(1, 99)}", "variant"])
            own.append("  " * rng.randint(0, 1) + " ".join(words))
        rows.append((i, "\n".join(own)))
    for min_docs in (2, 4, 8):
        assert dropped(spark, rows, min_docs) == plain_drop(rows, min_docs)


def test_variable_fields(spark):
    rows = [(i, f"Posted by user{i} on 2024-01-{i:02d} at noon\nOnly here {i * 'x'} stands text number") for i in range(1, 6)]
    assert all(d == [0] for _, _, d in dropped(spark, rows, 5)) or [r[2] for r in dropped(spark, rows, 5)] == [[0]] * 5


def test_copies_count_once(spark):
    rows = [(i, "the same text\nof two lines") for i in range(20)]
    assert all(d == [] for _, _, d in dropped(spark, rows, 2))


def test_awkward_rows(spark):
    long_ = "\n".join(f"line {chr(97 + i % 26)} {'w ' * (i % 7)}" for i in range(20_000))
    rows = [(1, None, "a", 1), (2, "", "b", 2), (3, "\n \n\t", "c", 3), (4, "shared line\nown", "d", 4), (4, "shared line\nown", "d", 4), (None, "shared  line", "e", 5), (5, long_, "f", 6), (6, "shared line\n" + long_, "g", 7)]
    schema = DOC + ", key string, row int"
    assert dropped(spark, rows, 3, schema) == plain_drop([r[:2] for r in rows], 3)
    assert L.drop_lines(spark.createDataFrame(rows, schema)).columns == ["doc_id", "text", "key", "row", "dropped"]
    assert L.drop_lines(spark.createDataFrame([(*r, 0) for r in rows], schema + ", dropped int"), name="gone").columns == ["doc_id", "text", "key", "row", "dropped", "gone"]
    assert dropped(spark, [], 3) == []


def test_query_against_plain_tree(spark, sf):
    from lectern.llm.queries import op6_lines

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {d: (len(gone), hashlib.md5(text.encode()).hexdigest(), ",".join(map(str, gone))) for d, text, gone in plain_drop(rows, L.MIN_DOCS)}
    assert {r["doc_id"]: (r["n_dropped"], r["text_md5"], r["dropped"]) for r in op6_lines(spark, sf).collect()} == want


def _words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))


def test_long_passage_in_a_few_unrelated_documents(spark):
    passage, middle = _words(55, 1), _words(30, 2)
    own = lambda i: [_words(60, 100 * i + j) for j in range(3)]
    rows = [(i, "\n".join([*own(i)[:1], passage, *own(i)[1:], middle, "short line here"])) for i in range(1, 6)]
    assert [r[2] for r in dropped(spark, rows, L.MIN_DOCS)] == [[1, 4]] * 5  # the short line in five documents stays
    assert [r[2] for r in dropped(spark, rows[:3], L.MIN_DOCS)] == [[1]] * 3  # 30 words need five documents
    assert [r[2] for r in dropped(spark, rows[:2], L.MIN_DOCS)] == [[]] * 2


def test_versions_of_one_text_are_no_recurrence(spark):
    text = [_words(60, j) for j in range(6)]
    rows = [(i, "\n".join([*text, _words(60, 900 + i)])) for i in range(6)]
    assert [r[2] for r in dropped(spark, rows, L.MIN_DOCS)] == [[]] * 6


def test_fields_anywhere_after_the_first_words(spark):
    """Two and three fields without digits, far apart, each word of them in few documents or in many."""
    names, towns = [_words(1, 700 + i) for i in range(12)], [_words(1, 800 + i) for i in range(5)]
    rows = []
    for i in range(60):
        line = f"this page was written by {names[i % 12]} who lives somewhere near {towns[i % 5]} and reads all day long on {_words(1, i)} again"
        rows.append((i, "\n".join([_words(30, 10_000 + i), line, _words(9, 20_000 + i)])))
    rows += [(100 + i, "this page was written by hand and never " + _words(14, 30_000 + i)) for i in range(3)]
    assert dropped(spark, rows, L.MIN_DOCS) == plain_drop(rows, L.MIN_DOCS)
    assert [(d, gone) for d, _, gone in sorted(dropped(spark, rows, L.MIN_DOCS))] == [(i, [1]) for i in range(60)] + [(100 + i, []) for i in range(3)]


def test_many_dropped_lines_of_one_text(spark):
    shared = [f"{_words(2, 40_000 + j)} shared {_words(3, 41_000 + j)}" for j in range(3000)]
    rows = [(i, "\n".join(x for j, s in enumerate(shared) for x in (s, _words(7, 50_000 + 3000 * i + j)))) for i in range(3)]
    want = [(i, list(range(0, 6000, 2))) for i in range(3)]
    assert [(d, gone) for d, _, gone in sorted(dropped(spark, rows, 3))] == want


def test_two_documents_are_enough_if_asked_for(spark):
    docs = spark.createDataFrame([(1, "the same long line stands here twice\nown words of one"), (2, "other things altogether now\nthe same long line stands here twice"), (3, "third text")], DOC)
    for least, want in ((2, [[0], [1], []]), (3, [[], [], []])):
        assert [r["dropped"] for r in L.drop_lines(docs, min_docs=least).orderBy("doc_id").collect()] == want
