"""The scanner of markup on malformed and endless input, and pages on which the cut decides."""

import itertools
import random
import re
import time

import pytest

from motifloom.llm import extraction

SF = "/root/testdata/sf0.01"
PROSE = " ".join(f"<p>This is sentence number {i} of the article, which goes on for a while and ends here.</p>" for i in range(10))
TEXT = re.sub("<[^>]*>", "", PROSE)
PATTERNS = ["<a ", '<a b="', "<a b='", "<a =", "<a/", "<!--", "<!", "<!-->", "-->", "<?", "<", "</", "</p>", "&", "&#", "&#x", "&#9999999", "<![foo[bar]]>", "<![foo]>", "<![<", "<![1", "<p>a<![a</p>", "<svg><![CDATA[", "<script>", "<style", "<title>", "<p>a", "<div><p>x", "<table><tr><td>a", "<li>a", "<form>a", '<a href="x>y', '"', "<b><i>x"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_a_megabyte_of_anything_takes_seconds(pattern):
    start = time.time()
    extraction.main_text(pattern * (1_000_000 // len(pattern)))
    assert time.time() - start < 5


def test_long_names_numbers_and_classes():
    start = time.time()
    assert extraction.main_text("<p>" + "&#" + "9" * 500_000 + "; is the only word of this text here.") == "� is the only word of this text here."
    extraction.main_text("<a " + "b" * 1_000_000)
    extraction.main_text("<" + "a" * 1_000_000 + ">x")
    extraction.main_text('<p class="' + "aB" * 500_000 + '">x')
    assert time.time() - start < 5


def test_every_prefix_of_pages(spark):
    """No prefix raises, and each has a text that the whole page's blocks begin with or that its tail may still change."""
    pages = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").limit(200).collect()]
    for page in pages:
        cuts = random.Random(len(page)).sample(range(len(page)), min(len(page), 60))
        for at in (*cuts, *range(min(len(page), 40)), len(page)):
            extraction.main_text(page[:at])


def test_random_markup_raises_nothing():
    rng = random.Random(4)
    parts = ["<", ">", "/", "!", "-", "--", "[", "]", "CDATA", "a", "p", "div", "script", "style", " ", "=", '"', "'", "&", "#", "x", ";", "amp", "é", "\x00", "\n", "class", "nav", "form", "hidden", "br", "?"]
    for _ in range(5000):
        extraction.main_text("".join(rng.choice(parts) for _ in range(rng.randint(1, 60))))


def test_malformed_pages_in_spark(spark):
    rows = [(i, p + f"<article>{PROSE}</article>") for i, p in enumerate(["<![foo[bar]]>", "<![foo]>", "<!doctype html [<!entity x>", "<?php echo 1 ?>", "</ >", "<!-->", "<3 "])]
    found = {r["page_id"]: r["text"] for r in extraction.extract(spark.createDataFrame(rows, "page_id long, html string"), keep=("page_id",)).collect()}
    assert all(found[i].endswith(TEXT) for i, _ in rows) and len(found) == len(rows)


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p title='a > b' class=x>One word of many in a line, which ends.</p>", "One word of many in a line, which ends."),
        ("<p title=a'b>One word of many in a line, which ends.</p >", "One word of many in a line, which ends."),
        ('<p title="never closed>One word of many in a line, which ends.</p>', "One word of many in a line, which ends."),
        ("<P ID=a ID=nav>5 &lt; 6 &amp;&amp; 7 > 6, as all of us know. &#x26;&#38;&eacute;&nosuch;</P>", "5 < 6 && 7 > 6, as all of us know. &&é&nosuch;"),
        ("<p>a < b and 1<2 hold here, as we have seen.</p>", "a < b and 1<2 hold here, as we have seen."),
        ("<script>if (a</b) { '</p>' }</script ><p>One word of many in a line, which ends.", "One word of many in a line, which ends."),
        ("<!-- a --!><p>One word of many in a line, which ends.<!-- never closed <p>two</p>", "One word of many in a line, which ends."),
        ("<p>One word of many in a line, which ends.</p><div class=\"cut", "One word of many in a line, which ends."),
        ("<p>&#00000000065; word of &#xD800; many in a line, &#1114112; which ends.", "A word of � many in a line, � which ends."),
    ],
)
def test_tags_as_browsers_read_them(html, text):
    assert extraction.main_text(html) == text


@pytest.mark.parametrize("around", ['<div class="legal-text">{}</div>', '<div class="share-price-report">{}</div>', '<form id="aspnetForm"><nav><a href="/">Home</a></nav>{}</form>', '<div class="search-results">{}</div>', '<div id="content"><form>{}</form></div>'])
def test_what_holds_most_of_a_page_is_its_text(around):
    assert extraction.main_text("<html><body>" + around.format(PROSE)) == TEXT


@pytest.mark.parametrize(
    "beside",
    [
        '<div class="legal">All rights of this and that are reserved by the owner of the site, and nothing may be copied from it.</div>',
        "<form><label>Name</label><input><p>Please fill in the form and we will write to you as soon as we can do so.</p></form>",
        '<div class="notice">We have moved our office to another street and are closed on the next two days of the week.</div>',
        '<div class="share">Share this on any site that you like to use and tell your friends about it.</div>',
    ],
)
def test_what_is_beside_an_article_is_not(beside):
    for main in (f"<article>{PROSE}</article>", f"<div>{PROSE}</div>"):
        assert extraction.main_text(f"<body>{main}{beside}") == TEXT == extraction.main_text(f"<body>{beside}{main}")


def plain_page(rng):
    """A page without semantic elements or class words, and the text of its article: paragraphs of one word to sixty."""
    say = lambda n: " ".join(rng.choice("the of and time people water house long other year small place".split()) for _ in range(n))
    menu = "".join(f'<div><a href="#">{say(rng.randint(1, 3))}</a></div>' for _ in range(rng.randint(4, 9)))
    more = "".join(f'<div><a href="#">{say(rng.randint(2, 5))}</a></div>' + (f"<div>{say(rng.randint(7, 9))}.</div>" if rng.random() < 0.3 else "") for _ in range(rng.randint(3, 7)))
    parts = [say(40) + ".", *(say(rng.choice([1, 2, 3, 3, 25, 40, 60])) + rng.choice([".", ".", ":", ""]) for _ in range(rng.randint(3, 10))), say(30) + "."]
    body = "".join(f"<div>{x}</div>" for x in parts)
    return f"<html><body><div><div>{menu}</div><div><div>{body}</div></div><div>{more}</div></div></body></html>", " ".join(parts)


def test_the_cut_decides_labels():
    """Of pages without names for their parts the cut changes some per cent of the labels that blocks have by themselves,
    and most texts are right only by that."""
    rng, changed, total, by_cut, alone = random.Random(7), 0, 0, 0, 0
    for _ in range(300):
        html, want = plain_page(rng)
        blocks = extraction.blocks_of(html)
        own = [extraction.score(b, p) > 0 for b, p in zip(blocks, extraction.priors(blocks))]
        cut = extraction.labels(blocks)
        changed += sum(a != b for a, b in zip(own, cut))
        total += len(blocks)
        by_cut += " ".join(b.text for b in itertools.compress(blocks, cut)) == want
        alone += " ".join(b.text for b in itertools.compress(blocks, own)) == want
    assert changed > 0.05 * total and by_cut >= 290 and alone < 60


def test_distance_in_the_tree():
    blocks = extraction.blocks_of("<div><p>a</p><p>b</p></div><div><section><p>c</p></section></div>d")
    assert [b.distance for b in blocks[1:]] == [2, 5, 3]
