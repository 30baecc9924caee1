"""Page cleaning and the streaming jobs."""

from pyspark.sql import functions as F

from corpuscade.functions import html as hx
from corpuscade.plans import catalog
from corpuscade.sources.pages import to_markdown

PAGE = """<html><head><title>T</title></head><body><nav><a href="/x">Menu one two</a></nav><!-- <p>gone</p> -->
<h2>Single</h2><div>Support</div><p>See the <a href="/lim">rate limit</a> &amp; the <b>bold</b> <em>part</em> here.</p>
<ul><li>first item in list</ul><footer>&copy; someone</footer></body></html>"""


def test_markdown_of_a_page(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "<p>word</p>"), (3, "")], "page_id long, html string")
    got = {r["page_id"]: r["markdown"] for r in to_markdown(df).collect()}
    assert got[1] == (
        "## Single\n\nSee the [rate limit](/lim) & the **bold** *part* here.\n\n- first item in list"
    )
    assert got[2] == "word"  # pruned to nothing, so the whole page stays
    assert got[3] == ""


def test_scores(spark):
    df = spark.createDataFrame([(PAGE,)], "html string")
    blocks = df.select(F.explode(hx.scored_blocks(hx.blocks(hx.strip_boilerplate(F.col("html"))))).alias("b"))
    kept = {r["b"]["text"]: (r["b"]["score"], r["b"]["keep"]) for r in blocks.collect()}
    assert kept["Support"] == (-1.0, False)
    assert kept["Single"] == (-1.0, True)
    assert all(s == -1.0 or 0 < s < 3 for s, _ in kept.values())
    assert "gone" not in kept and not any("Menu" in t for t in kept)


def test_streams_equal_batch(spark, sf_dir):
    q = catalog.queries()
    streamed = q["stream_questions"](spark, sf_dir)
    batch = q["rerank_top3"](spark, sf_dir)
    assert sorted(map(tuple, streamed.select(*batch.columns).collect())) == sorted(map(tuple, batch.collect()))
    urls = [r["norm_url"] for r in q["stream_page_dedup"](spark, sf_dir).collect()]
    links = q["url_normalize"](spark, sf_dir).where("pos >= 0").select("norm_url").distinct()
    assert len(urls) == len(set(urls)) and set(urls) == {r["norm_url"] for r in links.collect()}


def test_watermarked_first_sights(spark, tmp_path):
    from corpuscade.streaming.pages import first_sights
    from corpuscade.streaming.runner import drain_to_parquet, stream_session

    src = str(tmp_path / "src")
    rows = [("http://h/a", "2024-01-01 00:00:00"), ("http://h/a/", "2024-01-01 00:05:00"), ("HTTP://h/b", "2024-01-01 00:06:00")]
    timed = spark.createDataFrame(rows, "url string, at string").withColumn("at", F.to_timestamp("at"))
    timed.write.parquet(src)
    stream = stream_session(spark, 2).readStream.schema(timed.schema).parquet(src)
    out = drain_to_parquet(first_sights(stream, event_time="at", within="1 hour"), str(tmp_path / "timed"), str(tmp_path / "progress"))
    assert sorted(r["norm_url"] for r in spark.read.parquet(out).collect()) == ["http://h/a", "http://h/b"]


def test_a_stopped_stream_goes_on(spark, tmp_path):
    from corpuscade.streaming.pages import first_sights
    from corpuscade.streaming.questions import answer_stream
    from corpuscade.streaming.runner import drain_to_parquet, stream_session

    src, out, progress = (str(tmp_path / name) for name in ("src", "out", "progress"))
    answers, at = str(tmp_path / "answers"), str(tmp_path / "at")
    for urls in (["http://h/a", "http://h/b"], ["http://h/b/", "http://h/c"]):
        spark.createDataFrame([(u,) for u in urls], "url string").write.mode("append").parquet(src)
        stream = stream_session(spark, 2).readStream.schema("url string").parquet(src)
        drain_to_parquet(first_sights(stream), out, progress)
        answer_stream(stream, lambda batch: batch, answers, at)
    assert sorted(r["norm_url"] for r in spark.read.parquet(out).collect()) == ["http://h/a", "http://h/b", "http://h/c"]
    assert sorted(r["url"] for r in spark.read.parquet(answers).collect()) == ["http://h/a", "http://h/b", "http://h/b/", "http://h/c"]


def test_links_in_any_quotes_and_with_references(spark):
    html = """<a href="/p?x=1&amp;y=2">a</a> <a class=x href='/single'>b</a> <a href=/bare>c</a> <A HREF = "/up">d</A>
    <a data-href="/no">e</a>"""
    row = spark.createDataFrame([(html,)], "h string").select(hx.hrefs(F.col("h")).alias("l"), hx.inline_markdown(F.col("h")).alias("m")).first()
    assert row["l"] == ["/p?x=1&y=2", "/single", "/bare", "/up"]
    assert "[b](/single)" in row["m"] and "[c](/bare)" in row["m"]


def test_character_references(spark):
    import html

    cases = [
        "caf&eacute; it&#8217;s", "&amp;lt; stays", "&#x1F600;&#X41;&#65;", "&nosuch; &amp &#; &#x;", "&NotEqualTilde;&fjlig;", "&#128;&#151;",
        "&#0;&#xD800;&#1114112;", "plain", "", "&lt;b&gt;&quot;&#39;&apos;&copy;&hellip;",
    ]
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", hx.unescape(F.col("t")).alias("u")).collect()
    for r in rows:
        if "&amp &" not in r["t"]:
            assert r["u"] == html.unescape(r["t"]).replace("\xa0", " "), r["t"]
        else:
            assert r["u"] == r["t"]
