import gzip
import hashlib
import zlib
from pathlib import Path

from flankwear.llm import html_text as ht
from flankwear.llm import warc
from flankwear.llm.queries import op5_html_blocks

LONG = "<p>" + "long enough payload " * 12 + "</p>"


def test_foreign_headers():
    head = b"WARC/1.0\r\nwarc-type:response\r\nContent-length:4\r\nWARC-Target-URI: http://x/\r\n  folded: on\r\nWARC-Record-ID:<a>\r\n"
    got = warc.header_fields(head.rstrip())
    assert got == {"warc-type": "response", "content-length": "4", "warc-target-uri": "http://x/ folded: on", "warc-record-id": "<a>"}
    data = gzip.compress((head + b"\r\nbody\r\n\r\n") * 2)
    assert [(f["warc-record-id"], b) for f, b, _ in warc.records_of(iter([data]))] == [("<a>", b"body")] * 2


def test_warc_whole_small_table(same_as_sql, small):
    assert len(same_as_sql("op4_warc_normaliser", small)) == 50


def test_warc_revisits_and_edges(spark, tmp_path, same_as_sql):
    rows = [(5, "http://a/", LONG), (3, "http://b/ c\n", LONG), (9, None, LONG), (3, "http://b/2", LONG), (7, "u", "short"), (8, "u", "short"),
            (1, "u", None), (2, "u", ""), (None, "u", LONG + "é"), (11, "u", LONG + "é"), (12, "u", "x" * 99), (13, "u", "x" * 99),
            (14, "u", "y" * 100), (15, "u", "y" * 100), (16, "u", "long\r\n\r\n" * 400000), (20, "u", "WARC/1.1\r\n\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "'p' AS payload", "2 AS first", "3 AS n")
    df.repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    same_as_sql("op4_warc_normaliser", str(tmp_path))
    records, index = warc.archive_pages(spark, df)
    got = {}
    for r in records.collect():
        got.setdefault(r["page_id"], []).append((r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]))
    n, h = len(LONG), hashlib.sha256(LONG.encode()).hexdigest()
    assert got[5] == got[9] == [("revisit", 3, n, h)] and got[3] == [("response", None, n, h)] * 2
    assert got[8][0][0] == got[13][0][0] == "response" and got[15][0][:2] == ("revisit", 14)
    assert got[None][0][:2] == ("revisit", 11) and got[1][0][2] == 0
    assert got[16][0][3] == hashlib.sha256(("long\r\n\r\n" * 400000).encode()).hexdigest()
    for r in index.collect():               # every record is a gzip member of its own, at its offset
        data = Path(r["path"]).read_bytes()[r["offset"]:r["offset"] + r["length"]]
        d = zlib.decompressobj(31)
        assert d.decompress(data).startswith(b"WARC/1.1\r\n") and d.eof and not d.unused_data
        lines = Path(r["path"].replace(".warc.gz", ".idx")).read_text().splitlines()
        assert f"{r['offset']}\t{r['length']}\t{r['type']}\t{r['record_id']}" in lines


def test_archives_are_one_stream_and_roll_over(spark, tmp_path):
    df = spark.createDataFrame([(i, f"u{i}", LONG + str(i)) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    files = warc.write_archives(warc.with_revisits(df), str(tmp_path / "w"), max_bytes=4000).collect()
    assert len(files) > 3 and sum(r["records"] for r in files) == 40
    for r in files:
        d = zlib.decompressobj(31)
        data = Path(r["path"]).read_bytes()
        assert len(d.decompress(data)) == r["bytes"] and d.eof and not d.unused_data
        assert len(list(warc.records_of(iter([data[:7], data[7:]])))) == r["records"]
        many = b"".join(gzip.compress(raw) for *_, raw in warc.records_of(iter([data])))
        assert len(list(warc.records_of(iter([many])))) == r["records"]


def test_warc_empty(spark):
    records, index = warc.archive_pages(spark, spark.createDataFrame([], "page_id long, url string, html string"))
    assert records.collect() == [] and index.collect() == []


PAGE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav><a href=/a>Home</a></nav><div class="cookie-notice">We use cookies</div>
<main><article class="post"><header class="article-header"><h1>T &amp; itle</h1></header>
<p>Para&nbsp;one\n <a href="x>y">link</a> <script>if (a<b) "</p>"</script> 3 &lt; 4 end.<p>Yes.</p>
<div class="ad">Buy now</div><aside>Side</aside><ul><li>one<li>two <b>bold</b></ul><!-- <p>hidden</p> -->
<form><input><label>Name</label><button>Go</button></form><div style="display: none">gone</div></article>
<section id="comments"><article class="comment"><p>I liked it very much indeed, thanks a lot for all this.</p></article></section></main>
<footer>&copy; me</footer></body></html>"""


def test_main_text():
    tree = ht.train_tree()
    assert ht.main_text(PAGE, tree) == "T & itle\nPara one link 3 < 4 end.\nYes.\none\ntwo bold"
    plain = "<div><a href=1>Home</a> <a href=2>News</a></div><h2>Head line</h2><p>" + "word " * 40 + "</p><p>Short.</p><p>" + "text " * 30 \
        + "</p><div><a href=3>More</a></div>"
    assert ht.main_text(plain, tree).split("\n")[0] == "Head line" and "News" not in ht.main_text(plain, tree)
    assert ht.main_text(plain, tree).endswith(("text " * 30).strip())


def test_article_inside_marked_containers():
    tree = ht.train_tree()
    text = "word " * 30
    article = f"<article><h1>Head</h1><p>{text}</p><p>Short.</p></article>"
    want = f"Head\n{text.strip()}\nShort."
    side = "<div class='sidebar'><p>Read our other pages as well, there are many more of them.</p></div>"
    for a, b in (("<div class='content-sidebar-wrap'>", "</div>"), ("<div class='site sidebar-right'>", "</div>"), ("<div id='page' class='page menu-open'>", "</div>"),
                 ("<form method=post>", "</form>"), ("<dialog open>", "</dialog>"), ("<fieldset><menu>", "</menu></fieldset>")):
        assert ht.main_text(a + "<div><a href=1>Home</a></div>" + article + side + b, tree) == want, a
    for a, b in (("<section id='comments'>", "</section>"), ("<div class='related-posts'>", "</div>"), ("<div class='ad-slot'>", "</div>"), ("<div hidden>", "</div>")):
        assert ht.main_text(article + a + article + b, tree) == want, a
    for a, b in (("<form>", "</form>"), ("<div class='content-sidebar-wrap'>", "</div>"), ("<div class='site sidebar-right'>", "</div>")):     # no article
        assert ht.main_text(f"{a}<div><a href=1>Home</a></div><p>{text}</p><p>{text}</p>{side}{b}", tree) == f"{text}\n{text}".replace(" \n", "\n").strip(), a
    inner = f"<article><p>{text}</p><section class='related-work'><h2>Related work</h2><p>{text}</p></section><div class='share-price'>Shares fell to 12.40</div>" \
        "<div class='share-this-page'><a href=1>Send</a></div><form><label>Your name</label></form></article>"
    assert ht.main_text(inner, tree).split("\n") == [text.strip(), "Related work", text.strip(), "Shares fell to 12.40"]


def test_names_on_small_elements_and_in_parts():
    tree = ht.train_tree()
    text, bad = " ".join(["word"] * 40), " ".join(["bad"] * 35)
    for x in ("<ol class='commentlist'><li>%s</li></ol>", "<ul><li id='comment-12'>%s</li></ul>", "<div id='comment-12'>%s</div>",
              "<div class='userComments'><p>%s</p></div>", "<p class='ad'>%s</p>", "<div class='CookieConsent'>%s</div>", "<div class='relatedArticles'>%s</div>",
              "<ul><li class=ad>%s<li class='comment'>%s</ul>", "<dl><dt class=advert>%s<dd class=related>%s</dl>"):
        assert ht.main_text(f"<article><p>{text}</p>{x.replace('%s', bad)}<p>{text}</p></article>", tree) == f"{text}\n{text}", x
    assert ht.main_text(f"<table><tr><td id='sidebar'>{bad}<td><p>{text}</p><p>{text}</p></table>", tree) == f"{text}\n{text}"
    assert ht.main_text(f"<article><p class=ad>{bad}<p>{text}<h2 class=x>Head</h2>{text}</article>", tree) == f"{text}\nHead\n{text}"   # implied ends
    assert ht._name_words("userComments-12") == {"user", "comments"} and ht._name_words("adaptation") == {"adaptation"}


def test_no_zone_is_a_verdict():
    tree = ht.train_tree()
    text, teaser = " ".join(["word"] * 70), " ".join(["bad"] * 20)
    body = f"<div id='content'><p>{text}</p><p>{text}</p></div>"
    assert ht.main_text(f"<article><h2>Bad</h2><p>{teaser}</p></article>{body}", tree) == f"{text}\n{text}"
    assert ht.main_text(f"<article><p>{text}</p><p>{text}</p></article><div><p>{teaser}</p></div>", tree) == f"{text}\n{text}"
    menu = "".join(f"<li><a href=/{k}>bad {k}</a></li>" for k in range(6))
    got = ht.main_text(f"<article><p>{text}</p><ul>{menu}</ul><p>{text}</p><p><a href=x>one link</a></p><p>{text}</p></article>", tree)
    assert got.count("bad") <= 2 and "one link" in got
    assert ht.main_text(f"<dialog open><p>{text}</p><p>{text}</p></dialog>", tree) == f"{text}\n{text}"
    assert ht.main_text("<article></article><footer><p>All our pages in one short line.</p></footer>", tree) == ""
    for zone in (ht.BOILER, ht.NEITHER, ht.ARTICLE):           # every zone has blocks of either kind
        assert {r[-1] for r in ht.LABELLED if r[6] == zone} == {0, 1}


def test_a_neighbour_flips_a_block():
    tree = ht.train_tree()
    used = set()

    def walk(t):
        if not isinstance(t, int):
            used.add(ht.FEATURES[t[0]])
            walk(t[2]), walk(t[3])
    walk(tree)
    assert used & {"links_before", "links_after", "words_before", "words_after"} and {"links", "share"} <= used
    assert ht.decide(tree, (3, 1.0, 2, 1.0, 2, 1.0, ht.ARTICLE, 0, 0.9)) == 0 and ht.decide(tree, (3, 1.0, 2, 1.0, 40, 0.0, ht.ARTICLE, 0, 0.9)) == 1
    text = " ".join(["word"] * 50)
    short = "<p>Six words stand in this.</p>"
    assert "Six" in ht.main_text(f"<div><p>{text}</p>{short}<p>{text}</p></div>", tree)
    assert "Six" not in ht.main_text(f"<div><p>{text}</p></div><div>{short}<a href=1>More</a></div>", tree)


def test_dropped_elements_end():
    tree = ht.train_tree()
    for page, want in (
            ("<p>A</p><svg class=i /><p>B</p><svg><path d=x></svg><p>C</p>", "A\nB\nC"), ("<p>A <math/>B</p><p>C</p>", "A B\nC"),
            ("<p>A</p><button>Go<p>B</p>", "A\nB"), ("<p>A</p><div><select><option>x<option>y</div><p>B</p>", "A\nB"),
            ("<p>A <a href=1><svg><path d=x></a> B</p><p>C</p>", "A B\nC"), ("<p>A <button><div>Go</div> on</button> B</p>", "A B"),
            ("<p>A</p><video><source src=x><p>no player</p></video><p>B</p>", "A\nB"), ("<p>A</p></button></svg><p>B</p>", "A\nB"),
            ("<p>A</p><svg><g><svg><text>x</text></svg><text>y</text></g></svg><p>B</p>", "A\nB"), ("<p>A</p><svg><title>t</title><style>s", "A"),
            ("<p>A</p><template><p>x</p></template>B<canvas>no", "A\nB"), ("<p>A<textarea><p>x", "A"), ("<p>A</p><BUTTON>Go<H2>B</H2>", "A\nB")):
        assert ht.main_text(f"<article>{page}", tree) == want, page
        if "textarea" not in page and "<style" not in page:
            assert ht.main_text(f"<article>{page}</article><article><p>Next</p></article>", tree) == want + "\nNext", page
    many = "<article>" + "<svg><button>" * 20000 + "<p>A</p></article>" + "</svg>"
    assert ht.main_text(many, tree) == "A"


def test_box_tree_fits_its_table():
    assert all(ht.decide(ht._BOX_TREE, row[:-1]) == row[-1] for row in ht.LABELLED_BOXES)


def test_tree_fits_its_table():
    tree = ht.train_tree()
    assert all(ht.decide(tree, row[:-1]) == row[-1] for row in ht.LABELLED)


def test_pages_of_the_small_table(spark, small):
    import re
    from html import unescape
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in op5_html_blocks(spark, small).collect():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r["page_id"]], re.S)[1]
        body = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h\d)>", "\0", body.replace("<br>", " ")))
        want = "\n".join(x for x in (" ".join(unescape(y).split()) for y in body.split("\0")) if x)
        assert (r["text"], r["n_chars"]) == (want, len(want))


def test_html_edges(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<article>a<p"), (3, None, "<article>a<p"), (None, "u", "<nav>only"), (4, "u", "<" * 3000 + "a"),
            (5, "u", "<article>" + "<p>x &notaref; &#233; &#x1F600;</p>" * 3000), (6, "u", "<!-- never closed"), (7, "u", "<article><a href='>q")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    out = ht.extract_text(df).collect()
    by = {r["page_id"]: r["text"] for r in out}
    assert len(out) == len(rows) and by[1] == by[2] == by[6] == by[None] == "" and by[3].startswith("a")
    assert by[5] == "\n".join(["x &notaref; é 😀".replace("&not", "¬")] * 3000)
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    assert ht.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
