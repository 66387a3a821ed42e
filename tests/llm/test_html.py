"""Main text: the cut decides, small pages against all labellings, broken and deep pages in linear time."""

from __future__ import annotations

import random
import time
from itertools import product

import pytest

from tallyglass.llm import html

#: No tag or class here tells what is what.
PLAIN = """<body><div><div><a href=/>Home</a></div><div><a href=/n>News</a></div><div>More from here.</div><div><a href=/p>People</a></div><div><a href=/j>Jobs</a></div></div>
<div><h1>How to bake a plain loaf</h1><p>Bread needs little, but it needs time, and most of that time it looks after itself.</p>
<p>Weigh these out before you begin, since nothing can be added later on without starting again:</p>
<ul><li>500 g flour</li><li>salt</li><li>water</li></ul>
<p>Mix them, wait until the dough has doubled, and bake it for forty minutes in a hot oven.</p></div>
<div><div>Share this</div><div>Copyright 2024 Acme. All rights reserved.</div></div></body>"""


def by_sign(page: str) -> str:
    found = html.parsed(page)
    return "\n".join(b.text for b, z in zip(found.blocks, html.log_odds(found)) if z > 0)


def test_the_cut_keeps_weak_blocks_with_their_neighbours():
    text = html.main_text(PLAIN)
    assert text.split("\n") == [
        "How to bake a plain loaf", "Bread needs little, but it needs time, and most of that time it looks after itself.",
        "Weigh these out before you begin, since nothing can be added later on without starting again:", "500 g flour", "salt", "water",
        "Mix them, wait until the dough has doubled, and bake it for forty minutes in a hot oven.",
    ]
    assert by_sign(PLAIN) != text and "salt" not in by_sign(PLAIN)


def test_unnamed_notices_go():
    for notice in ("Copyright 2024 Acme. All rights reserved.", "Share this. Tweet it.", "Home / About us / Sign up for our newsletter now."):
        assert html.main_text(f"<div>{notice}</div>") == ""


def test_small_pages_against_all_labellings():
    rng, used = random.Random(5), 0
    parts = ["<p>Some words that go on, for a while, and then they end.</p>", "<li>one</li>", "<a href=/x>there</a>", "<div>Read more</div>", "<nav>Site</nav>", "<p>Of.</p>", "<h2>Part</h2>", "<td>7</td>"]
    for _ in range(150):
        page = "".join(f"<div>{''.join(rng.choice(parts) for _ in range(rng.randint(1, 4)))}</div>" for _ in range(3))
        found = html.parsed(page)
        terminals, ties = html._terminals(found), html._ties(found)

        def cost(side):
            return sum(t if x else s for x, (s, t) in zip(side, terminals)) + sum(c for (a, b), c in ties.items() if side[a] != side[b])

        best = min(map(cost, product((False, True), repeat=len(terminals))))
        chosen = html.source_side(terminals, ties)
        assert cost(chosen) == pytest.approx(best)
        assert html.main_text(page) == "\n".join(b.text for b, k in zip(found.blocks, chosen) if k)
        used += chosen != [s > t for s, t in terminals]
    assert used > 20


def test_references_and_comments():
    assert html.main_text("<p>It is &am<b>p;</b>lt; here, &lt;b&gt; and &eacute;.</p>") == "It is &amp;lt; here, <b> and é."
    assert html.main_text("<p>One is<![CDATA[ not]]> here.<!-- no > --> Two is<!--> too.</p></%gone>") == "One is here. Two is too."
    assert html.main_text("<p title='a>b'>Quotes hold \"brackets\" well.<p data-x=\"y>Left open, it ends at the bracket.") == "Quotes hold \"brackets\" well.\nLeft open, it ends at the bracket."


BROKEN = ('<a "x ', '<a href="x ', "<p><button>" + "<div>" * 1000, "</x>", "<!--", "<", '<a b="', "<li>a<b>", "<td>x y z.</td><td>a</td>", "<title>", "<i>", "<div>x ")


@pytest.mark.parametrize("piece", BROKEN)
def test_a_megabyte_of_broken_or_nested_tags(piece):
    seconds = []
    for size in (1 << 18, 1 << 20):
        start = time.process_time()
        html.main_text(piece * (size // len(piece)))
        seconds.append(time.process_time() - start)
    assert seconds[1] < 8 and seconds[1] < 8 * seconds[0] + 0.5  # about four times is in proportion


def test_the_cut_beats_the_sign_on_pages_without_names():
    """Pages of the test tables with tags and classes renamed: the same texts should come out as with the names."""
    import re

    import pyarrow.parquet as pq

    wrong = {"cut": 0, "sign": 0}
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist():
        kept = set(html.main_text(page).split("\n"))
        found = html.parsed(re.sub(r' class="[^"]*"', "", re.sub(r"<(/?)(?:nav|article|footer)>", r"<\1div>", page)))
        truth = [b.text in kept for b in found.blocks]
        wrong["sign"] += sum((z > 0) != t for z, t in zip(html.log_odds(found), truth))
        wrong["cut"] += sum(k != t for k, t in zip(html.source_side(html._terminals(found), html._ties(found)), truth))
    assert wrong["cut"] < 0.6 * wrong["sign"]
