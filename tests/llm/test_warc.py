from pyspark.sql import functions as F

from chronoloom.llm import warc

HTML = ('<!DOCTYPE html><html><head><title> A &amp; B </title><style>p{}</style></head><body><p class="x">One &lt;two&gt;</p>'
        '<script>var t="</p>";</script><!-- no --><a href="/a?b=1">link</a> <A HREF="http://x/">other</A><br/>é\n\n  end</body></html>')
PAGE = "page_id long, url string, html string"


def test_records_refer_to_their_response_and_carry_its_fields(spark):
    df = spark.createDataFrame([(1, "http://x/1", HTML), (1, "http://x/1", HTML), (2, None, None), (3, "u", ""), (None, "u", "no tags & <b>bold"), (5, "v", "<p>" + "w " * 200000)], PAGE)
    source = warc.responses(df.withColumns({"record_id": F.lit("own"), "payload": F.lit(0), "block": F.lit(1)}))
    out = warc.derive(source).collect()
    assert len(out) == 12
    answers = {r["record_id"] for r in source.collect()}
    assert {r["refers_to"] for r in out} == answers and len(answers) == 5
    assert all(r["record_id"] not in answers and f"WARC-Refers-To: {r['refers_to']}" in r["headers"] for r in out)
    assert all(r["content_length"] == len(r["block"].encode()) for r in out)
    text = next(r["block"] for r in out if r["page_id"] == 1 and r["record_type"] == "conversion")
    assert text == "One <two>\nlink other\né\nend"
    meta = next(r["block"] for r in out if r["page_id"] == 1 and r["record_type"] == "metadata")
    assert meta.endswith("title: A &amp; B\r\noutlink: /a?b=1\r\noutlink: http://x/\r\n") and meta.startswith("HTTP/1.1 200 OK\r\n")
    empty = next(r for r in out if r["page_id"] == 2 and r["record_type"] == "conversion")
    assert empty["block"] == "" and empty["target_uri"] is None and "WARC-Target-URI" not in empty["headers"]
    import hashlib
    assert empty["payload_digest"] == "sha256:" + hashlib.sha256(b"").hexdigest()


def test_written_records_come_back_exactly(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://x/{i}", HTML.replace("One", f"N{i}\r\n\r\nWARC")) for i in range(30)] + [(99, "u", None)], PAGE)
    records = warc.derive(warc.responses(df))
    warc.write_records(records, str(tmp_path / "w"))
    back = warc.read_records(spark, str(tmp_path / "w"))
    cols = ["record_type", "record_id", "refers_to", "target_uri", "headers", "block"]
    assert sorted(map(tuple, back.select(*cols).collect())) == sorted(map(tuple, records.select(*cols).collect()))
    assert back.where("not whole").count() == 0


def test_empty_table_and_plan(spark):
    out = warc.derive(warc.responses(spark.createDataFrame([], PAGE)))
    assert out.count() == 0
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_links_in_any_quotes_are_found(spark):
    html = """<a href="/a">1</a><a href='/b "c"'>2</a><A HREF=/d?e=1&f=2>3</A><a class=x href = "/g" >4</a><a href='' id=y>5</a><a href=/h\nid=z>6</a><a data-href='/no'>"""
    out = warc.derive(warc.responses(spark.createDataFrame([(1, "u", html)], PAGE))).where("record_type = 'metadata'").first()["block"]
    links = [x[len("outlink: "):] for x in out.split("\r\n") if x.startswith("outlink: ")]
    assert links == ["/a", '/b "c"', "/d?e=1&f=2", "/g", "", "/h"]
