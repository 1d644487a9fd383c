import duckdb
import pytest

from graphloom.llm.html_extract import extract, main_text
from graphloom.llm.quality_rules import ORACLE_SQL, clean, quality_rules

PROSE = "\n".join(" ".join(f"word{i * j}x{i}" for j in range(9)) + ", and so." for i in range(1, 13))
MORE = PROSE.replace("word", "term")


def test_rules_match_sql(spark, documents, tmp_path):
    rows = [
        (1, PROSE),
        (2, PROSE + "\nAll rights reserved.\nHome | About | Contact\nMenu"),
        (3, "the " * 80),
        (4, "\n".join("word### other*** more$$$ text%%%" for _ in range(30))),
        (5, None),
        (6, ""),
        (7, " \t\r\n\x0b\x0c "),
        (8, "SHOUT!! LOUD!! VERY!! MUCH!! " * 30),
        (9, "é ü ß — “quoted” words. " * 40),
        (10, "\n".join(f"part{i} | item{i} | thing{i} |" for i in range(40))),
        (1, PROSE),
        (None, PROSE),
        (11, "w" * 100_000),
        (12, "a  b\n\na  b\nc"),
        (13, PROSE + "\nStart\nAbout our house\nWhat we do here today\n\nContact and map\n" + MORE),
        (14, PROSE + "\nOne short line\nand another one\nEnds here.\nthen a third line\n" + MORE),
        (15, "Home » News » Sport\nInicio · Mapa · Ayuda\nTous droits réservés.\nWeiterlesen.\n" + PROSE),
        (16, " ".join(f"long{i}" for i in range(60)) + " with all rights reserved in the middle of it " + " ".join(f"end{i}" for i in range(60)) + "."),
    ]
    df = documents(rows)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = sorted((tuple(x) for x in quality_rules(df).select(columns).collect()), key=str)
    df.select("doc_id", "text").toPandas().to_parquet(tmp_path / "d.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d.parquet'")
    want = sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL})").fetchall(), key=str)
    assert got == want
    kept = {x[0] for x in got if x[-1]}
    assert {1, 2, 13, 14, 15, 16} <= kept and not kept & {3, 4, 5, 6, 7, 8, 10}


def test_lines_go():
    assert clean(PROSE + "\nAll rights reserved.")[-1] == PROSE
    assert clean(None)[0] == 0
    assert clean(PROSE + "\nStart\nAbout our house\nWhat we do here today\n\nContact and map\n" + MORE)[-1] == PROSE + "\n\n" + MORE
    assert clean("Home » News » Sport\nTous droits réservés.\n" + PROSE)[-1] == PROSE


def test_empty_rules(spark, documents):
    assert quality_rules(documents([(1, "x")]).limit(0)).collect() == []


PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div>
<div class="content"><div class="post"><h1>T</h1><p>Hello, world &amp; all, yes. <a href=x>link</a> more.</p><ul><li>one<li>two</ul>
<form><label>x</label><p>form text</p></form><!-- hidden <p>no</p> --><script>var a="<p>no</p>";</script><p>Short&nbsp;one.</p></div>
<div class="comments"><p>Nice, very, nice, comment, indeed</p></div></div><aside><p>Side, bar, text</p></aside><footer><p>(c)</p></footer></body></html>"""


def test_main_text():
    assert main_text(PAGE) == "T Hello, world & all, yes. link more. one two Short one."
    assert main_text("<nav><a>x</a></nav><article><h1>A</h1><p>One<br>two<p><b>th</b>ree</article><footer>f</footer>") == "A One two three"
    assert main_text("<article><p>cut off in the mid") == "cut off in the mid"
    assert main_text("plain words only") == "plain words only"
    for nothing in (None, "", "<script>x</script>", "<!-- only", "<html><body></body></html>"):
        assert main_text(nothing) == ""


@pytest.mark.parametrize("broken", ["<p a=\"x>y</p>" * 50, "<" * 3000, "<div>" * 3000 + "x", "&#x110000; &bogus; &amp"])
def test_broken_markup_ends(broken):
    assert isinstance(main_text(broken), str)


def test_pages(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "<p>x, y</p>")]
    df = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(map(tuple, extract(df).collect()), key=str)
    assert len(got) == 4 and (2, None, "", 0) in got and (None, "v", "x, y", 4) in got
    assert extract(df.limit(0)).collect() == []
