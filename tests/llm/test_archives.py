import collections
import gzip
import hashlib
import os

from llm_cases import prose

from keyloom.llm import warc

PAGES = "page_id long, url string, html string, file string, start long, digest string, payload string, n int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "f", 7, "d", "p", 1) for i, u, h in rows], PAGES)


def cases():
    page = "<p>" + prose(1, 200) + "</p>"
    short = "x" * 99
    return [(5, "http://a/5", page), (3, "http://a/3", page), (9, None, page), (3, "http://a/3", page), (None, "http://a/n", page),
            (1, "http://b/1", short), (2, "http://b/2", short), (11, "http://b/é ü\r\nX: y", "y" * 100), (12, "", "y" * 100),
            (20, "u", None), (21, "u", ""), (22, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 9),
            (23, "u", "é漢🙂" * 40), (24, "u", "é漢🙂" * 40), (30, "long", prose(2, 300000)), (31, "long", prose(2, 300000)),
            (None, None, "z" * 150), (None, None, "z" * 150), *[(100 + i, "hot", "h" * 200) for i in range(300)]]


def brute(rows):
    payloads = [(h or "").encode() for _, _, h in rows]
    groups = collections.defaultdict(list)
    for k, p in enumerate(payloads):
        if len(p) >= 100:
            groups[p].append(k)
    out = []
    for k, ((i, _, _), p) in enumerate(zip(rows, payloads)):
        first = min(groups[p], key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k)) if len(p) >= 100 else k
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), *(("response", None) if first == k else ("revisit", rows[first][0]))))
    return out


def test_archive_equals_brute_force(spark, tmp_path):
    rows = cases()
    folder = warc.write_deduplicated(pages(spark, rows).repartition(5), f"file://{tmp_path}", roll=20_000)
    got = warc.read_archive(spark, folder, with_payload=True).collect()
    assert sorted(map(str, [r[:5] for r in got])) == sorted(map(str, brute(rows)))
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    assert {r.payload.decode() for r in got if r.payload is not None} == {h or "" for _, _, h in rows}
    assert {r.url for r in got} == {u and u.replace(" ", "%20").replace("\r\n", "%0D%0A") for _, u, _ in rows}
    assert spark.read.parquet(f"{folder}/index").select("file").distinct().count() > 5


def test_records_refer_to_records(spark, tmp_path):
    folder = warc.write_deduplicated(pages(spark, cases()), f"file://{tmp_path}", date="2020-01-02T03:04:05Z")
    found = {}
    for name in os.listdir(folder.removeprefix("file://")):
        if name.endswith(".warc.gz"):
            with open(f"{folder.removeprefix('file://')}/{name}", "rb") as f:
                for raw in warc.members(f, chunk=1000):
                    head, block = warc.parsed(raw)
                    found[head["WARC-Record-ID"]] = head, block
    revisits = [h for h, _ in found.values() if h["WARC-Type"] == "revisit"]
    assert len(revisits) == sum(r[3] == "revisit" for r in brute(cases()))
    for head in revisits:
        first = found[head["WARC-Refers-To"]][0]
        assert first["WARC-Type"] == "response" and first["WARC-Payload-Digest"] == head["WARC-Payload-Digest"]
        assert head["WARC-Date"] == "2020-01-02T03:04:05Z" and head["WARC-Profile"] == warc.REVISIT
    for r in spark.read.parquet(f"{folder}/index").collect():  # every record can be read by its place alone
        with open(f"{folder.removeprefix('file://')}/{r.file}", "rb") as f:
            f.seek(r.start)
            assert gzip.decompress(f.read(r.length)).startswith(b"WARC/1.1\r\n")


def test_files_of_lost_attempts_are_not_read(spark, tmp_path):
    rows = [(i, "u", prose(i, 50)) for i in range(6)]
    folder = warc.write_deduplicated(pages(spark, rows), f"file://{tmp_path}")
    with open(f"{folder.removeprefix('file://')}/part-000000-lost.warc.gz", "wb") as f:
        f.write(warc.record({"WARC-Type": "response"}, b"half")[:-9])
    assert warc.read_archive(spark, folder).count() == 6


def test_empty_table(spark, tmp_path):
    folder = warc.write_deduplicated(pages(spark, cases()).limit(0), f"file://{tmp_path}")
    assert warc.read_archive(spark, folder).count() == 0


def test_broken_archives_are_errors():
    whole = warc.record({"WARC-Type": "response", "WARC-Record-ID": "x"}, b"body")
    try:
        list(warc.members(__import__("io").BytesIO(whole + whole[:-5])))
        raise AssertionError
    except ValueError as error:
        assert "ends inside" in str(error)
