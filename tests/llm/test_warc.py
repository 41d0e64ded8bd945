import gzip
import hashlib
import io

import pytest

from weftline.llm import warc as W


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


BIG = "<p>é漢</p>" * 40_000
ROWS = [(3, "http://a/b c\n", "x" * 100), (1, None, "x" * 100), (2, "u", "x" * 99), (4, "u", "x" * 99), (5, "u", None), (6, "u", ""), (7, "u", BIG), (8, "u", BIG), (9, "u", "\r\n\r\nWARC/1.1\r\n" * 20), (10, "u", "y" * 70_000)]


def expected(rows):
    out = set()
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data]
        again = len(data) >= 100 and page != min(same)
        out.add((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    return out


@pytest.mark.parametrize("chunk", [1, 64, 1 << 16])
def test_round_trip(spark, chunk):
    rows = ROWS if chunk > 1 else [(p, u, (h or "")[:150]) for p, u, h in ROWS[:3]]
    table = W.chunk_table(W.write_archives(pages(spark, rows)), chunk=chunk)
    assert {tuple(r) for r in W.records(table).collect()} == expected(rows)
    held = {}
    for r in table.orderBy("page_id", "chunk_no").collect():
        so_far = held.setdefault(r["page_id"], [])
        assert r["chunk_no"] == len(so_far) and r["chunk_bytes"] == len(r["payload"]) <= chunk
        so_far.append(bytes(r["payload"]))
        assert r["digest_so_far"] == hashlib.sha256(b"".join(so_far)).hexdigest() and r["bytes_so_far"] == sum(map(len, so_far))
    whole = {p: (h or "").encode() for p, _, h in rows}
    for page, _, _, kind, _ in expected(rows):
        assert b"".join(held[page]) == (whole[page] if kind == "response" else b"")


def test_files_are_gzip_members_of_warc(spark):
    files = W.write_archives(pages(spark, ROWS).coalesce(1)).collect()
    assert sum(f["records"] for f in files) == len(ROWS)
    text = gzip.decompress(W.open_file(files[0]["path"], "r").read())
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: ") and text.endswith(b"\r\n\r\n")


def test_damage_is_noticed():
    out = io.BytesIO()
    body = b"z" * 1000
    W.write_record(out, 1, "u", memoryview(body), hashlib.sha256(body).hexdigest(), None, "1970-01-01T00:00:00Z", 1)
    good = out.getvalue()
    assert len(list(W.chunks(W.Inflated(io.BytesIO(good + good), 100)))) == 20
    with pytest.raises(ValueError):
        list(W.chunks(W.Inflated(io.BytesIO(good[:-40]), 100)))
    out = io.BytesIO()
    W.write_record(out, 1, "u", memoryview(body), "0" * 64, None, "1970-01-01T00:00:00Z", 1)
    with pytest.raises(ValueError, match="declares"):
        list(W.chunks(W.Inflated(io.BytesIO(out.getvalue()), 100)))


def test_awkward_rows(spark):
    rows = [(None, "u", "n" * 200), (4, "u", "n" * 200), (4, "u", "n" * 200), (None, "u", "m" * 200)]
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in W.records(W.chunk_table(W.write_archives(pages(spark, rows)))).collect()), key=str)
    assert got == sorted([(None, "revisit", 4), (4, "response", None), (4, "response", None), (None, "response", None)], key=str)
    assert W.records(W.chunk_table(W.write_archives(pages(spark, rows).where("false")))).count() == 0
