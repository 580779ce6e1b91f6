import time

import pytest

from hitweave.llm.html import extract, main_text

LONG = "One two, three, four five six seven eight nine ten, and so on for a while longer."

CASES = [
    (f"<nav><a href=/>Home</a></nav><article><h1>T &amp; x</h1><p><b>{LONG}<br><p>{LONG}</article><footer>(c)</footer>", f"T & x {LONG} {LONG}"),
    (f"<body><div class=ad><p>{LONG}</p></div><div id=main><p>{LONG}</p><ul><li>a<li>b</ul></div><aside>{LONG}</aside>", f"{LONG} a b"),
    (f"<article><p>{LONG}</p><div class='comments'><p>{LONG}</p></div><form><p>{LONG}</p></form></article>", LONG),
    (f"<div><p>{LONG} <script>if (a < b) document.write('</p>');</script>end</p><style>p{{}}</style></div>", f"{LONG} end"),
    (f"<article><p>{LONG}</p><p hidden>{LONG}</p><p style='display: none'>{LONG}</p><!-- <p>{LONG}</p> --></article>", LONG),
    (f"<article><header><h1>Head</h1></header><p>a&nbsp;&#8212;&#x41;&amp {LONG}</p>", f"Head a —A& {LONG}"),
    (f"<header><p>{LONG}</p></header><main><p>{LONG}</p><p>x", f"{LONG} x"),
    (f"<div><div><a href=1>{LONG}</a> <a href=2>{LONG}</a></div></div><div><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG} {LONG}"),
    (f"<article><p>{LONG}</p><p title='a > b'>q</p><p title=\"x>q<b</p>", LONG + " q q"),
    (f"<article><table><tr><td>c1<td>c2<tr><td>c3</table><p>a <b>b</b>c\n\t d</p><p>{LONG}", f"c1 c2 c3 a bc d {LONG}"),
    ("", ""), (None, ""), ("plain &amp;\n text", "plain & text"), ("<article></article>", ""), ("<article><h1>Short</h1><p>few</p>", "Short few"),
    ("<nav><ul><li><a href=a>x</a></ul></nav><footer>y</footer>", ""),
]


@pytest.mark.parametrize("page,want", CASES)
def test_known_pages(page, want):
    assert main_text(page) == want


def test_siblings_that_score_are_kept():
    part = f"<section><p>{LONG}</p><p>{LONG}</p></section>"
    assert main_text(f"<body><div><div class=sidebar>{part}</div>{part}{part}</div>") == " ".join([LONG] * 4)


ODD = ("<p a='", "<", "<div>", "</p>", "<a b=\"c", "&", "<script>", "<b>|</i>", "<i><b>|</u>", "<b>|<h1>x</h1>", "<li><ul><b>|<li></li>", "<p><b>|<h2>", "<div>a|</span>", "<table><tr>|<td>x")


@pytest.mark.parametrize("markup", ODD)
def test_odd_markup_is_linear(markup):
    """Four times the markup takes at most about four times as long."""

    def took(n):
        page = "".join(part * n for part in markup.split("|")) + "x"
        t = time.process_time()
        main_text(page)
        return time.process_time() - t

    main_text("<p>warm")
    assert min(took(20000) for _ in range(2)) < 8 * min(took(5000) for _ in range(3)) + 0.05


def test_table_of_pages(spark):
    df = spark.createDataFrame([(i, f"u{i}", p, "old") for i, (p, _) in enumerate(CASES)], "page_id long, url string, html string, text string")
    out = extract(df.repartition(3))
    assert out.columns == ["page_id", "url", "text"]
    got = {r.page_id: r.text for r in out.collect()}
    assert got == {i: w for i, (_, w) in enumerate(CASES)}
    assert extract(df.where("false")).count() == 0


@pytest.mark.parametrize("page,want", [
    ("<body><h1>Notice</h1><p>Closed today</p><ul><li>a<li>b</ul></body>", "Notice Closed today a b"),
    ("<nav>menu</nav><p>今日は休みです。</p><footer>x</footer>", "今日は休みです。"),
    ("<article></article><p>few words</p>", "few words"),
    (f"<div class='content has-sidebar'><article><p>{LONG}</p></article></div>", LONG),
    (f"<div id=social-app><main><p>{LONG}</p><div class=ad>Buy</div></main></div>", LONG),
    (f"<div id=social-app><div><p>{LONG}</p><p>{LONG}</p></div><div class=sidebar><p>{LONG}</p></div></div>", f"{LONG} {LONG}"),
    (f"<div><p>{LONG}</p><div class=comments><p>{LONG}</p><p>{LONG}</p></div></div>", LONG),
    (f"<div class=no-comments><p>{LONG}</p></div>", LONG),
    (f"<div class=ad>{LONG}</div><article><h1>Short</h1><p>few</article>", "Short few"),
    ("<div class=menu><a href=a>x</a></div>", ""),
])
def test_pages_are_not_lost_by_thresholds(page, want):
    assert main_text(page) == want
