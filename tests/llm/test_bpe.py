import base64
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lectern.llm import bpe, queries

PATH = public_tokenizers.path(queries.RANKS)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(PATH), special_tokens={})


def held(spark, library, texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    done = bpe.encode(docs, PATH, public_tokenizers.PATTERN, packed="raw", **more)
    rows = done.select("doc_id", "ids", bpe.decode(F.col("ids"), PATH).alias("back"), "raw").collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    for r in rows:
        want = library.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["ids"] == want, texts[r["doc_id"]]
        assert bytes(r["back"]) == (texts[r["doc_id"]] or "").encode() and bytes(r["raw"]) == b"".join(i.to_bytes(4, "little") for i in want)


TEXTS = [
    None, "", " ", "  \n\n x  y \t\n ", "'s it's I'LL we'll ''ve", "<|endoftext|> </s>", "Donaudampfschifffahrtsgesellschaft über 12345,678",
    "  　a\u0085b ", "日本語のテキスト、한국어 مرحبا", "🙂🙂 👩‍👩‍👧 é", "aaaaaaaaaaaaaaaaaaaaaaa abababab", "\x00\x01 \x7f", "same words same words", "same words same words",
]


def test_awkward_texts(spark, library):
    held(spark, library, TEXTS)


def test_table_of_words_changes_nothing(spark, library):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij äßé", k=rng.randrange(1, 12))) for _ in range(60)]
    held(spark, library, [" ".join(rng.choices(words, k=40)) for _ in range(20)], head=5)


def test_characters_of_every_class(spark, library):
    """Letters and digits that a JVM's Unicode lacks, among others."""
    rng = random.Random(1)
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    some = sorted(rng.sample(codes, 3000) + [0x9FFD, 0x2EBF0, 0x323AF, 0x11BF0, 0x1E4F0, 0x10D40])
    held(spark, library, ["".join(f"a{chr(c)} {chr(c)}1" for c in some[i : i + 200]) for i in range(0, len(some), 200)])


def test_columns_and_no_rows(spark, library):
    kind = "ids string, text string, row long, at long, word string, own long"
    docs = spark.createDataFrame([("x", "hello there", 1, 2, "w", 3), ("x", "hello there", 1, 2, "w", 3), (None, None, None, None, None, None)], kind)
    got = bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    assert sorted(got.columns) == sorted(c.split()[0] for c in kind.split(", "))
    assert sorted((r["text"] or "", r["row"] or 0, len(r["ids"])) for r in got.collect()) == [("", 0, 0)] + [("hello there", 1, len(library.encode_ordinary("hello there")))] * 2
    assert bpe.encode(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_ranks_are_a_literal(spark):
    plan = spark.createDataFrame([("a",)], "w string").select(bpe.encoded(F.col("w"), PATH).alias("ids"))._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "ArrowEvalPython" not in plan


def test_words_are_found_once(spark):
    """Finding words takes longer than all else that is done for each of them."""
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    done = bpe.encode(docs, PATH, public_tokenizers.PATTERN, packed="raw", keep=["doc_id"])
    assert done._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


@pytest.mark.parametrize("seed", range(3))
def test_ranks_in_no_order_of_merges(spark, tmp_path, seed):
    """Pieces that no merges lead to, and equal ranks of different parts: of those the first goes first."""
    rng = random.Random(seed)
    pieces = {"".join(rng.choices("ab", k=rng.randrange(2, 6))).encode() for _ in range(24)}
    known = {bytes([i]): i for i in range(256)} | {p: 256 + i for i, p in enumerate(rng.sample(sorted(pieces), len(pieces)))}
    (tmp_path / "ranks").write_bytes(b"".join(base64.b64encode(p) + b" %d\n" % i for p, i in known.items()))
    library = tiktoken.Encoding("odd", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
    words = sorted({"".join(rng.choices("ab", k=rng.randrange(1, 16))) for _ in range(400)})
    docs = spark.createDataFrame([(w,) for w in [*words, "ab" * 300]], "word string")
    wrong = {r["word"] for r in docs.select("word", bpe.encoded(F.col("word"), str(tmp_path / "ranks")).alias("ids")).collect() if r["ids"] != library.encode_ordinary(r["word"])}
    assert not wrong


def test_query(spark, sf, library):
    got = {r["doc_id"]: r for r in queries.op12_bpe(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert got[d["doc_id"]]["n_tokens"] == len(library.encode_ordinary(d["text"] or ""))
        assert got[d["doc_id"]]["decoded_sha256"] == __import__("hashlib").sha256((d["text"] or "").encode()).hexdigest()
