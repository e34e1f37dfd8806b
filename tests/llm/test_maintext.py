import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylight.llm.maintext import Line, distribution, extract, main_text, regions

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:y}</style><script>var t="</p><p>no</p>";</script></head><body>
<header class="site-header"><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- c <p>no</p> -->
<div class="ad">Buy this thing now for less money.</div><div class="cookie-notice">We use cookies.</div>
%s
<aside><p>Related story about something else entirely.</p></aside><section id="comments"><p>Reader: I disagree with all of this.</p></section>
<form><p>Subscribe here</p><input name=x><button>Go</button></form><footer>&copy; Someone</footer></body></html>"""
BODY = "<h1>Title &amp; more</h1><p>First   para&nbsp;graph with\n <b>bold</b> text.<br>Next line.<p>Second, unclosed<p><b>Third.<br><p>&lt;tag&gt; caf&eacute; &#8212; end</p>"
TEXT = "Title & more\nFirst para graph with bold text. Next line.\nSecond, unclosed\nThird.\n<tag> café — end"


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", "<article>%s", "<div class=story>%s</div>", "<main><header>%s</header></main>"])
def test_article_alone(wrap):
    assert main_text(PAGE % (wrap % BODY)) == TEXT


def test_broken_and_odd_pages():
    assert main_text(None) == main_text("") == main_text("<p></p>") == main_text("<script>x") == main_text("<!-- <p>a</p>") == ""
    assert main_text("just text < 3 & more") == "just text < 3 & more"
    assert main_text("<p>cut off mid tag</p><div cla") == "cut off mid tag"
    assert main_text('<p title="a > b">kept</p><p hidden>gone</p><p style="display:none">gone</p>') == "kept"
    assert main_text("<article>" + "<p>x y z</p>" * 3000 + "</article>").count("\n") == 2999


def brute_regions(sizes, window, rise):
    """Surge and dive points by the definition, line by line."""
    sums = [sum(sizes[max(0, i - window + 1) : i + 1]) for i in range(len(sizes))]
    assert distribution(sizes, window) == sums
    least = rise * sum(sums) / max(1, sum(s > 0 for s in sums))
    high = [s > 0 and s >= least for s in sums]
    out = []
    for i in range(len(sizes)):
        if high[i] and (i == 0 or not high[i - 1]):
            end = next((k for k in range(i, len(sizes)) if not high[k]), len(sizes))
            inside = [k for k in range(max(0, i - window + 1), end) if sizes[k]]
            out.append((inside[0], inside[-1] + 1))
    merged = out[:1]
    for a, b in out[1:]:
        if a - merged[-1][1] <= window:
            merged[-1] = merged[-1][0], b
        else:
            merged.append((a, b))
    return merged


@given(st.lists(st.sampled_from([0, 0, 0, 3, 40, 90, 400]), max_size=40), st.integers(1, 4), st.sampled_from([0.2, 0.5, 1.0]))
@settings(max_examples=300, deadline=None)
def test_regions_equal_brute_force(sizes, window, rise):
    lines = [Line("x" * 60, n) if n else Line("x", 0) for n in sizes]
    assert regions(lines, window, rise) == (brute_regions(sizes, window, rise) if any(sizes) else [])


STORY = [f"This is sentence number {i} of a story about the river, the mill and those who lived beside them." for i in range(6)]


def test_pages_without_any_names():
    """Menus, notices and footers in bare elements are told from text by the distribution alone."""
    for menu in ("<div>%s</div>", "<p>%s</p>", "<div><a href=/x>%s</a></div>"):
        top = "".join(menu % x for x in ("Home", "News", "About us", "Shop", "Contact"))
        end = "".join(menu % x for x in ("\u00a9 2024 Example Ltd", "Terms", "Privacy", "Imprint")) + "<div>We use cookies.</div>"
        page = f"<html><body><div>{top}</div><div><h1>The mill</h1>{''.join(f'<p>{s}</p>' for s in STORY)}</div><div>{end}</div></body></html>"
        assert main_text(page) == "\n".join(["The mill", *STORY])


def test_short_lines_within_the_story_stay():
    body = [STORY[0], "A short one.", "Yes", STORY[1], "No", STORY[2]]
    page = "<div>" + "".join(f"<div>{x}</div>" for x in ("Home", "News", "Shop", "More")) + "".join(f"<p>{x}</p>" for x in body) + "".join(f"<div>{x}</div>" for x in ("Terms", "Privacy", "Help", "Jobs")) + "</div>"
    assert main_text(page) == "\n".join(body)


def test_link_lists_within_the_article_go():
    menu = "".join(f"<li><a href=/{i}>Another story, number {i}</a></li>" for i in range(5))
    page = f"<article><p>{STORY[0]}</p><p><a href=/s>{STORY[1]}</a></p><p>{STORY[2]}</p><ul>{menu}</ul><p>{STORY[3]}</p></article>"
    assert main_text(page) == "\n".join(STORY[:4])


def test_teasers_beside_the_article_go():
    page = "<main><article>" + "".join(f"<p>{x}</p>" for x in STORY) + "</article></main>" + "<article><p>Read this too.</p></article>" * 3
    assert main_text(page) == "\n".join(STORY)


def test_attributes_are_read_as_a_whole():
    assert main_text("<article><p>See <a href='https://x.org/hidden-gems'>the guide</a> now.</p></article>") == "See the guide now."
    assert main_text("<article><p title='The hidden valley'>Kept.</p><p data-id=nav data-class='ad'>Kept too.</p></article>") == "Kept.\nKept too."
    assert main_text("<article><p class='entry social-science'>Kept.</p></article>") == "Kept."
    assert main_text("<article><p>Kept.</p><p HIDDEN>gone</p><p class = 'ad'>gone</p></article>") == "Kept."


def test_table(spark):
    rows = [(1, "u", PAGE % f"<article>{BODY}</article>", "old"), (2, None, None, None), (3, "u", "", "x"), (1, "u", "<p>again</p>", "old"), (None, "u", "<p>n</p>", "x")]
    out = extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string"))
    assert out.columns == ["page_id", "url", "html", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in out.collect()) == sorted([(1, TEXT, len(TEXT)), (2, "", 0), (3, "", 0), (1, "again", 5), (0, "n", 1)])
    assert extract(out.limit(0)).collect() == []


@pytest.mark.parametrize("outer", ["class='with-sidebar'", "class='page no-sidebar'", "id=has-comments", "class=ad-free", "class=search", "role=alert"])
def test_names_around_the_article(outer):
    assert main_text(PAGE % f"<div {outer}><article>{BODY}</article></div>") == TEXT


def test_anchors_within_the_article():
    body = "<h2 id='related-work'>Related work</h2><p id='notice-1'>One.</p><section id='search'><p>Two.</p></section><div class='share-buttons'>Share</div><section id=comments>No</section>"
    assert main_text(f"<article><p>Zero.</p>{body}</article>") == "Zero.\nRelated work\nOne.\nTwo."


def test_boilerplate_around_other_articles_stays_out():
    page = "<article><p>Story.</p></article><div class='comment-list'><article><p>Reader.</p></article></div><div hidden><article>x</article></div>"
    assert main_text(page) == "Story." and main_text("<div hidden><article>x</article></div>") == ""
