import hashlib
from collections import Counter

from pyspark.sql import functions as F

from lakeleaf.llm import line_dedup, warc

BIG, SMALL = "é" * 60, "x" * 99
PAGES = [(5, "http://a/5", BIG), (2, "http://a/2", BIG), (9, None, BIG), (3, "u\r\nWARC-Type: x", SMALL), (4, "u", SMALL), (6, "u", None), (7, "u", ""), (8, "u", BIG + "!"), (8, "u", BIG + "!")]


def test_archive_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "x") for r in PAGES], "page_id bigint, url string, html string, record_type string")
    path = str(tmp_path / "w")
    rows = warc.archive(pages, path).collect()
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in rows if r.page_id != 8)
    assert got == [(2, 120, "response", None), (3, 99, "response", None), (4, 99, "response", None), (5, 120, "revisit", 2), (6, 0, "response", None), (7, 0, "response", None), (9, 120, "revisit", 2)]
    assert sorted((r.record_type, r.refers_to or 0) for r in rows if r.page_id == 8) == [("response", 0), ("revisit", 8)]
    assert all(r.payload_digest == hashlib.sha256((h or "").encode()).hexdigest() for r in rows for i, _, h in PAGES if i == r.page_id)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    data = b"".join(bytes(r.record) for r in warc.records(spark, path).collect())
    parsed = list(warc.parse_records(data))
    assert len(parsed) == len(PAGES)
    for fields, block in parsed:
        page = next(h for i, _, h in PAGES if fields["warc-record-id"] == f"<urn:x-page:{i}>")
        assert block == (b"" if fields["warc-type"] == "revisit" else (page or "").encode())
        assert fields["warc-payload-digest"] == "sha256:" + hashlib.sha256((page or "").encode()).hexdigest()


def test_empty_archive_null_ids_and_damage(spark, tmp_path):
    pages = spark.createDataFrame([(None, "u", BIG), (1, "u", BIG)], "page_id bigint, url string, html string")
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.archive(pages).collect()}
    assert got == {(1, "response", None), (None, "revisit", 1)}
    assert warc.archive(pages.limit(0)).count() == 0
    path = str(tmp_path / "bad")
    warc.write_archive(pages, path)
    held = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.encode(F.lit("other"), "UTF-8")).collect()
    spark.createDataFrame(held, "digest string, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    try:
        warc.read_archive(spark, path).collect()
    except Exception as error:
        assert "differs from its digest" in str(error)
    else:
        raise AssertionError("a damaged payload was read")


def brute_lines(rows, ratio, least):
    pages = {(h, t or "") for _, t, h in rows}
    total = Counter(h for h, _ in pages)
    counts = Counter((h, line) for h, t in pages for line in {x.strip(" ") for x in t.split("\n")} if line)
    bad = {k for k, n in counts.items() if n >= least and n > total[k[0]] * ratio}
    return Counter((i, None if t is None else "\n".join(x for x in t.split("\n") if (h, x.strip(" ")) not in bad)) for i, t, h in rows)


def test_lines_against_brute_force(spark):
    rows = [(i, f"top \nbody {i}\nrare {i % 7}\n", "a" if i % 3 else "b") for i in range(60)] + [(100 + i, "copied\ntext", "a") for i in range(200)]
    rows += [(300, None, "a"), (301, "", None), (302, "top", None), (None, "top\n top", "b"), (303, "top\n" * 30_000, "b")]
    df = spark.createDataFrame([(*r, 1, 5) for r in rows], "doc_id bigint, text string, source string, n_lines int, other int")
    for ratio, least in ((0.1, 5), (0.5, 2), (0.01, 3)):
        for limit in (1_000, -1):
            found = line_dedup.drop_boilerplate(df, ratio, least, broadcast_lines=limit)
            assert Counter((r.doc_id, r.text) for r in found.collect()) == brute_lines(rows, ratio, least)
    assert set(found.columns) == {*df.columns, "n_dropped"}
    assert line_dedup.drop_boilerplate(df.limit(0)).count() == 0
    # Copies of one page are one page: its lines are not boilerplate.
    assert {r.text for r in line_dedup.drop_boilerplate(df, 0.1, 5).where("doc_id BETWEEN 100 AND 299").collect()} == {"copied\ntext"}


def test_no_url_can_pose_as_another_field(spark):
    ends = ["\u2028", "\u0085", "\u2029", "\x0b", "\x0c", "\r\n", "\n", "\r"]
    pages = [(i, f"http://a/{end}WARC-Payload-Digest: sha256:00{end}WARC-Payload-Length: 7{end}WARC-Type: revisit{end}Content-Length: 3", f"page {i}") for i, end in enumerate(ends)]
    got = warc.archive(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type) for r in got} == {(i, 6, hashlib.sha256(h.encode()).hexdigest(), "response") for i, _, h in pages}


def test_extra_columns_of_any_name_stay(spark):
    names = ["at", "host", "drop", "salt", "salt_of", "clean", "_at", "_HOST", "_drop", "_salt", "_salt_of", "_clean", "line_key"]
    df = spark.createDataFrame([(i, "top\nbody", "a", *([i] * len(names))) for i in range(9)], "doc_id bigint, text string, source string, " + ", ".join(f"{n} int" for n in names))
    for limit in (1_000, -1):
        found = line_dedup.drop_boilerplate(df, min_pages=1, counts=False, broadcast_lines=limit)
        assert found.columns == df.columns and all(r.text == "" and set(r[3:]) == {r.doc_id} for r in found.collect())
