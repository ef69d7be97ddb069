import gzip
import hashlib
import random

import pytest

from tidemark.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, digest string, n int, part int, value string, refers string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 6) for r in rows], SCHEMA)


def sample():
    same, near = "<p>é" + "x" * 1000, "y" * 998 + "é"
    rows = [(i, f"http://Host{i % 3}.example.com/a{i % 5}?q=1", same if i % 4 == 0 else f"<b>{i}</b>\r\n\r\nWARC/1.1\r\n") for i in range(40)]
    rows += [(50, None, near), (51, "", near), (52, "no address\nat all", None), (53, "http://[bad", ""), (54, "http://z.example", "z" * 999), (55, "http://z.example", "z" * 999)]
    rows += [(60, "http://host0.example.com/a0", same), (60, "http://host0.example.com/a0", same), (-7, "http://n.example", "neg"), (None, "http://null.example", same), (61, "http://long.example", "w" * 300000)]
    return rows


def expected(rows):
    result = []
    for page, _, html in rows:
        data = (html or "").encode()
        last = max([p for p, _, h in rows if p is not None and (h or "") == (html or "")], default=None)
        again = page is not None and len(data) >= 1000 and last != page
        result.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last if again else None))
    return sorted(result, key=str)


@pytest.fixture(scope="module")
def index(spark):
    return warc.archive(pages(spark, sample())).collect()


def test_round_trip(index):
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index], key=str) == expected(sample())


def test_index_is_one_order(index):
    ordered = sorted(index, key=lambda r: (r.part, r.place))
    keys = [(r.url_key, r.captured) for r in ordered]
    assert keys == sorted(keys)
    assert {r.url_key for r in index if (r.url or "").startswith("http://Host0")} <= {k for k in (warc.url_key(f"http://host0.example.com/a{i}?q=1") for i in range(5))}
    assert warc.url_key("http://Host0.example.com/A?q=1") == "com,example,host0)/a?q=1"


def test_records_of_members_and_broken_archives(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(pages(spark, sample()[:3]), path)
    parts = [p.read_bytes() for p in (tmp_path / "w").glob("part-*.gz")]
    plain = b"".join(gzip.decompress(p) for p in parts)
    whole = list(warc.records(plain))
    assert whole == list(warc.records(b"".join(parts))) and len(whole) == 3
    with pytest.raises(ValueError):
        list(warc.records(plain[:-3]))
    with pytest.raises(ValueError, match="digest"):
        list(warc.records(plain.replace(b"<b>1</b>", b"<b>7</b>")))


@pytest.mark.parametrize("count", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(count):
    draw = random.Random(count)
    runs = [sorted(draw.choices(range(20), k=draw.randint(0, 30))) for _ in range(count)]
    assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_empty_table(spark):
    assert warc.archive(pages(spark, [])).count() == 0
