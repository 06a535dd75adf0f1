"""Web pages, archives, files, addresses, payloads and sound."""

import io
import ipaddress
import random
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.sources import audio, files, html, payloads, web


def test_html_walk():
    page = "<html><head><title> A  b </title></head><body><h2>Uno\n dos</h2><div><p>tres<br>cuatro<p>cinco<ul><li>x<li>y</ul><script>z()</script><td>t</div></body></html>"
    assert html.page_text(page) == ("A b", "## Uno dos\n\ntrescuatro\n\ncinco\n\n- x\n\n- y\n\nt")
    assert html.page_text(page, "client")[1] == "## Uno\n dos\n\ntres\ncuatro\n\ncinco\n\n- x\n\n- y\n\nt"
    assert html.page_text("<p><b>uno<br><p>dos")[1] == "uno\n\ndos"
    assert html.page_text("solo &amp; texto") == ("", "solo & texto") and html.page_text(None) == ("", "")
    assert html.page_text("<body><p>fuera</p><article><p>dentro</p></article></body>")[1] == "dentro"
    assert html.page_text("<li>" * 5000 + "x")[1].endswith("- x")


DOCX = {"[Content_Types].xml": b"<Types/>", "word/document.xml": b'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Tema</w:t></w:r></w:p><w:p><w:r><w:t>Un texto</w:t></w:r></w:p></w:body></w:document>'}


def docx(parts=None, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in (parts or DOCX).items():
            z.writestr(name, data)
    return out.getvalue()


def status(data, limits=files.CLIENT):
    try:
        files.check_docx(data, limits)
        return 200
    except files.Unsound as e:
        return e.status


def test_sound_archives():
    for method in (zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED):
        for limits in (files.CLIENT, files.SERVER):
            assert status(docx(method=method), limits) == 200
    assert files.docx_blocks(docx()) == ([{"kind": "heading", "text": "Tema"}, {"kind": "paragraph", "text": "Un texto"}], False)


def tampered(name, field, value):
    """The directory entry of a part with one field overwritten."""
    data = bytearray(docx())
    at = data.rfind(name.encode()) - 46
    struct.pack_into("<I" if value > 0xFFFF or field in (20, 24, 42) else "<H", data, at + field, value)
    return bytes(data)


@pytest.mark.parametrize("data", [
    b"", b"PK", docx()[:-1], docx() + b"x", docx({"a": b"b"}), docx(DOCX | {"../x": b""}), docx(DOCX | {"a\\b": b""}),
    tampered("word/document.xml", 24, 5), tampered("word/document.xml", 8, 1), tampered("word/document.xml", 10, 12), tampered("word/document.xml", 42, 9),
])
def test_unsound_archives(data):
    assert status(data) in (413, 415)


def test_bombs_and_limits():
    assert status(docx(DOCX | {"word/big.bin": b"\0" * (9 * files.MIB)})) == 413
    assert status(docx(DOCX | {"word/big.xml": b" " * (5 * files.MIB)})) == 413
    assert status(docx(DOCX | {"word/b.bin": b"\0" * files.MIB}), files.SERVER) == 413  # a ratio over 200
    assert status(docx(DOCX | {f"f{i}": b"" for i in range(600)})) == 413
    lying = bytearray(docx(DOCX | {"word/b.bin": bytes(np.random.default_rng(0).integers(0, 256, 5000, "u1"))}))
    struct.pack_into("<I", lying, lying.rfind(b"word/b.bin") - 46 + 24, 10)
    assert status(bytes(lying)) in (413, 415)


def test_import_files(spark):
    rows = [("/a/x.docx", docx(), ""), ("/a/bad.docx", b"PK", ""), ("/a/t.txt", " Uno\r\ndos ".encode(), "text/plain"), ("/a/l.txt", b"caf\xe9", "text/plain"), ("/a/p.bin", b"%PDF-1.7", ""), ("/a/o.doc", b"x", ""), ("/a/e.txt", b"", ""), ("/a/z", b"zz", ""), ("/a/b.md", b" \n", "")]
    frame = spark.createDataFrame(rows, "path string, content binary, mime string")
    got = {r["path"][3:]: r for r in files.import_files(frame).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"x.docx": 200, "bad.docx": 415, "t.txt": 200, "l.txt": 415, "p.bin": 200, "o.doc": 415, "e.txt": 413, "z": 415, "b.md": 422}
    assert got["x.docx"]["text"] == "Tema\n\nUn texto" and got["t.txt"]["text"] == "Uno\ndos" and got["p.bin"]["needs_ocr"]
    assert {r["path"]: r["status"] for r in files.import_files(frame, files.SERVER).collect()}["/a/l.txt"] == 200
    assert {r["path"][3:]: r["status"] for r in files.archive_entries(frame.where("path like '%docx'")).collect()} == {"x.docx": 200, "bad.docx": 415}


PUBLIC = {"8.8.8.8": True, "10.1.2.3": False, "127.0.0.1": False, "100.64.0.1": False, "100.128.0.1": True, "169.254.1.1": False, "172.15.0.1": True, "172.31.0.1": False, "192.168.1.1": False, "192.88.99.1": False, "192.88.98.1": True, "198.18.0.1": False, "198.51.100.7": False, "203.0.113.9": False, "224.0.0.1": False, "0.1.1.1": False, "256.1.1.1": False, "1.2.3": False}
PUBLIC6 = {"2606:4700::1111": True, "::1": False, "::ffff:8.8.8.8": False, "fe80::1": False, "fc00::1": False, "2001:db8::1": False, "2001::1": False, "2002::1": False, "3fff::1": False, "64:ff9b::1": False, "2a00::1%eth0": False, "x": False}


def test_addresses(spark):
    got = spark.createDataFrame(list(PUBLIC.items()), "a string, ok boolean").select("ok", web.is_public_ipv4(F.col("a")).alias("got")).collect()
    assert all(r["ok"] == r["got"] for r in got)
    got = spark.createDataFrame(list(PUBLIC6.items()), "a string, ok boolean").select("ok", web.is_public_ipv6(F.col("a")).alias("got")).collect()
    assert all(r["ok"] == r["got"] for r in got)


def test_ipv6_against_the_standard_library(spark):
    rng = random.Random(1)
    cases = []
    for _ in range(3000):
        groups = [rng.choice(["0", "2001", "2606", "fe80", "db8", "1", "ffff", "", "12345", "g", "8.8.8.8", "08"]) for _ in range(rng.randint(1, 9))]
        cases.append(":".join(groups))
    cases += [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(200)] + [str(ipaddress.IPv6Address(rng.getrandbits(16) << 112 | rng.getrandbits(8))) for _ in range(200)]
    for r in spark.createDataFrame([(c,) for c in cases], "a string").select("a", web.is_ipv6(F.col("a")).alias("v6")).collect():
        try:
            ipaddress.IPv6Address(r["a"])
            known = True
        except ValueError:
            known = False
        assert r["v6"] == known, r["a"]


def test_redirects_to_public_ipv6_are_followed(spark):
    hops = spark.createDataFrame([(1, 0, "GET", "https", "https", "/x"), (2, 0, "GET", "https", "https", "/x"), (3, 0, "GET", "https", "https", "/x")], "request_id long, hop long, method string, scheme string, next_scheme string, location string")
    seen = spark.createDataFrame([(1, 0, "2606:4700::1111"), (1, 0, "8.8.8.8"), (2, 0, "2606:4700::1111"), (2, 0, "::1")], "request_id long, hop long, address string")
    assert {r["request_id"]: r["verdict"] for r in web.follow(hops, seen).collect()} == {1: "allow", 2: "private", 3: "private"}


def test_wav():
    data = audio.wav(np.array([0, 1, -1, 2, 0.5]), 22050)
    assert len(data) == 54 and data[:4] == b"RIFF" and struct.unpack("<5h", data[44:]) == (0, 32767, -32768, 32767, 16383)
    assert audio.wav(np.array([]), 1) is None and audio.wav(np.array([float("nan")]), 1) is None and audio.wav(np.zeros(9), 1) is None


def test_answers(spark):
    raw = ['{"text":" a "}', '{"output":"b","finish_reason":"length"}', '{"choices":[{"message":{"content":"c"},"finish_reason":"stop"}]}', '{"choices":[{"text":"d"}]}', '{"text":""}', "{}", "x"]
    got = spark.createDataFrame([(r,) for r in raw], "r string").select(payloads.answer(payloads.parse(F.col("r"), payloads.ANSWER)).alias("a")).collect()
    assert [r["a"] for r in got] == ["a", None, "c", "d", None, None, None]
