import math
import re
from collections import Counter

import pytest

from lectern.llm import licenses as L

FILE = "doc_id long, path string, text string"


def plain_own(text, cosine=L.COSINE):
    """(cosine, label) and share of a file: every line and the whole text against every template, nothing left out."""
    t = L.Templates()
    low = (text or "").lower()

    def best(unit):
        tf = Counter(re.findall(L.WORD, unit))
        norm = math.sqrt(sum((c * t.idf.get(w, t.other)) ** 2 for w, c in tf.items()))
        scores = [(-sum(c * t.idf[w] * v[w] for w, c in tf.items() if w in v) / norm if norm else 0.0, label) for v, label in zip(t.vectors, t.labels, strict=True)]
        c, label = min((round(c, 9), label) for c, label in scores)
        return -c, label

    units = [*re.split(r"\r?\n", low), re.sub(r"\s+", " ", low)]
    hits = [(best(u), len(re.findall(L.WORD, u))) for u in units]
    hits = [(b, n) for b, n in hits if b[0] >= cosine]
    if not hits:
        return None, 0.0
    own = min((-b[0], b[1]) for b, _ in hits)
    return (-own[0], own[1]), min(1.0, sum(n for _, n in hits) / len(re.findall(L.WORD, low)))


def plain_scan(rows):
    judged = [(d, p, *plain_own(t)) for d, p, t in rows]
    given = {}
    for _, p, own, share in judged:
        if own and p is not None and (re.match(L.FILE_NAME.replace("(?i)", ""), p.split("/")[-1], re.I) or share >= L.FILE_SHARE):
            folder = p.rpartition("/")[0]
            given[folder] = min(given.get(folder, (2.0, "")), (-own[0], own[1]))
    out = []
    for d, p, own, _ in judged:
        if own:
            out.append((d, own[1], round(own[0], 6), "own", None))
            continue
        folder, hit = p, None
        while folder is not None and hit is None:
            folder = folder.rpartition("/")[0] if "/" in folder else ("" if folder else None)
            hit = given.get(folder) if folder is not None else None
        out.append((d, hit[1], round(-hit[0], 6), "inherited", folder) if hit else (d, None, None, None, None))
    return sorted(out, key=repr)


def scanned(spark, rows, schema=FILE):
    got = L.scan(spark.createDataFrame(rows, schema)).collect()
    return sorted(((r["doc_id"], r["license"], None if r["cosine"] is None else round(r["cosine"], 6), r["origin"], r["from_dir"]) for r in got), key=repr)


@pytest.mark.parametrize(("label", "text"), L.TEMPLATES)
def test_every_template_finds_itself(label, text):
    own, share = plain_own(text)
    assert own[0] == pytest.approx(1) and own[1] == label and share == 1


def test_a_unit_without_cues_never_reaches_the_threshold():
    t = L.Templates()
    for v in t.vectors:
        assert math.sqrt(sum(x * x for w, x in v.items() if w not in t.cues)) < L.COSINE


ROWS = [
    (1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "a/b/c/code.py", "print(1)"), (3, "a/b/COPYING.txt", "Released under the MIT License"),
    (4, "a/b/x.py", "# SPDX-License-Identifier: GPL-3.0-or-later\nimport os"), (5, "a/y.py", ""), (6, "z.py", None), (7, "a/b/c/d/e/f.py", "no license words, just prose about a license plate"),
    (8, "q/story", "Once upon a time\nAll rights reserved.\nthe end of a long long story that goes on"), (9, "q/r", "x"), (10, None, "Released under the MIT License."), (11, None, "y"),
    (12, "a/b2/zz", "w " * 50_000 + "\nReleased under the MIT License.\n" + "v " * 50_000), (13, "t/LICENSE", "Licensed under CC BY 4.0"), (14, "t/NOTICE", "Released under the MIT License"), (15, "t/u", "n"), (15, "t/u", "n"), (16, "/abs/file", "m"), (17, "/LICENSE", "All rights reserved"),
]


def test_against_plain_scan(spark):
    assert scanned(spark, ROWS) == plain_scan(ROWS)


def test_clashing_columns_and_empty_table(spark):
    rows = [(*r, "keep", 1) for r in ROWS]
    got = L.scan(spark.createDataFrame(rows, FILE + ", dir string, license int"))
    assert got.columns == ["doc_id", "path", "dir", "license", "cosine", "origin", "from_dir"]
    assert {r["dir"] for r in got.collect()} == {"keep"} and scanned(spark, []) == []


def test_query_against_plain_scan(spark, sf):
    from lectern.llm.queries import op2_licenses

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = [(r["doc_id"], f"{r['source']}/{r['lang']}/{r['doc_id']}", r["text"]) for r in docs]
    got = sorted(((r["doc_id"], r["license"], r["cosine"], r["origin"], r["from_dir"]) for r in op2_licenses(spark, sf).collect()), key=repr)
    assert got == plain_scan(rows)


def test_license_files_headers_and_notices_inside_lines(spark):
    import textwrap

    comment = lambda text: "\n".join(f" * {x}" for x in textwrap.wrap(text, 60))
    prose = "\n".join(f"the word {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}zu stands here alone" for i in range(300))
    rows, want = [], {}
    for i, (label, text) in enumerate(L.TEXTS):
        body = "\n".join(textwrap.wrap(text, 70))
        for j, whole in enumerate((f"{label}\n\nCopyright 2020 Some One. All rights reserved.\n\n{body}\n", f"{prose}\n/*\n{comment(text)}\n */\n{prose}")):
            rows.append((2 * i + j, f"d{2 * i + j}/{('LICENSE', 'x.c')[j]}", whole))
            want[2 * i + j] = (label, "own")
    more = [("Copyright 2020 X. All rights reserved.", "Proprietary"), ("see http://x.org/y: it was released under the MIT License in May, as most of our tools were", "MIT"), ("# Licensed under the Apache\n# License, Version 2.0", "Apache-2.0"), ("the rights of others, and a table reserved for two", None)]
    for k, (text, label) in enumerate(more, 900):
        rows.append((k, f"m{k}/f", text))
        want[k] = (label, "own" if label else None)
    rows.append((1000, "d0/src/x.py", "print(1)"))
    want[1000] = (L.TEXTS[0][0], "inherited")
    assert {d: (label, origin) for d, label, _, origin, _ in scanned(spark, rows)} == want
