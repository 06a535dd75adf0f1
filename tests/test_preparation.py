"""Citations and operators as expressions against the kernels, which walk through a text."""

import random

from pyspark.sql import functions as F

from lectern.functions import cleaning
from lectern.functions import preparation as P

CITED = [
    "as said (García, 2020) and (de la Cruz & van Dyk, 1999a, 2001, pp. 3-9)", "(García y López et al., s. f.)", "(2020)", "(García)", "(ver García, 2020)",
    "[1] [2, 3-5; 8] [x] [1,,2]", "(Ibid.) (op. cit.) (IDEM) (ibid x)", "((García, 2020))", "(García, 2020; Pérez, 2019)", "(García, 2020; nota)",
    "(*García*, _2020_)", "( García ,  2020 )", "( , 2020)", "(García, 1720)", "(García, 2020, págs. 3 – 4, x)", "[García, 2020]", "(" + "A" * 270 + ", 2020)", "a (b", "c) d", "()", "[]", "(García,\n2020)",
    "(García, López, 2020)", "(García and the Others, 2020)", "(García and, 2020)", "(GARCÍA-LÓPEZ, 2020b)", "(García &, 2020)", "(et al., 2020)", "(O'Neil et al, 2020)",
]
SPOKEN = [
    "a + b = c", "3*4", "a * b", "*bold* text", "x<=y", "x <= (y)", "y/o", "Y/O", "a/b", "and/or", "1/2", "2^10", "f(x)*g", "x*-3", "x * - 3", "a<b>c", "<tag>", "a != b", "<=3", "≤ 4", "5×6÷7",
    "word*x", "é*b", "a2*b3", "ab*c", "x^", "^2", "a / (b)", "[1]/[2]", "a>=b", "a==b", "ley/o", "+-+",
]


def test_citations(spark):
    rng = random.Random(1)
    texts = CITED + [" ".join(rng.choices(CITED, k=3)) for _ in range(40)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", P.without_citations(F.col("t")).alias("x")).collect()
    assert {r["i"]: r["x"] for r in got} == {i: cleaning.remove_citations(t) for i, t in enumerate(texts)}


def test_operators_and_lines(spark):
    rng = random.Random(2)
    parts = ["a", "ab", "3", "x2", "é", "(", ")", "[", "]", " ", "  ", *cleaning.SPOKEN, "y", "o", "-", ",", "¿", "!", "•", "#"]
    lines = SPOKEN + ["".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(600)] + ["---", " * * *", "= = =", "===", "", "___ "]
    frame = spark.createDataFrame(list(enumerate(lines)), "i int, t string")
    for kernel, column in ((cleaning.speak_operators, P.spoken_operators), (cleaning.clean_line, P.cleaned_line)):
        got = {r["i"]: r["x"] for r in frame.select("i", column(F.col("t")).alias("x")).collect()}
        assert [(t, got[i]) for i, t in enumerate(lines)] == [(t, kernel(t)) for t in lines]


def test_nulls_stay_and_texts_keep_their_lines(spark):
    rows = spark.createDataFrame([(None,), ("",), ("a + b\n\n(García, 2020) x\n",)], "t string").select(P.cleaned_text(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in rows] == [None, "", "a más b\n\nx"]
