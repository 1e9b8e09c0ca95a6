"""Regions of pages: comments marked as articles, several articles, containers without marks, a plain brute-force choice."""

import itertools

import numpy as np
import pytest

from postloom.llm import html_extraction as h


def words(n, x="word"):
    return " ".join(f"{x}{i}" for i in range(n))


@pytest.mark.parametrize("name", ["comments", "user-comments", "comment-thread", "reader-comments-list", "replies"])
@pytest.mark.parametrize("where", ["class", "id"])
def test_comments_are_left_out_however_long(name, where):
    thread = f'<section {where}="{name}"><h2>Said</h2><article>{words(240, "c")}</article><article>{words(80, "d")}</article></section>'
    want = f"T\n{words(50)}"
    for page in (f"<main><h1>T</h1><p>{words(50)}</p>{thread}</main>", f"<article><h1>T</h1><p>{words(50)}</p>{thread}</article>", f"<main><article><h1>T</h1><p>{words(50)}</p></article>{thread}</main>", f"<body><article><h1>T</h1><p>{words(50)}</p></article>{thread}</body>"):
        assert h.main_text(page) == want


@pytest.mark.parametrize("name", ["comments-open", "no-comments", "has-commentary", "related-work"])
def test_other_names_stay(name):
    assert h.main_text(f'<div class="{name}"><p>{words(60)}</p></div>') == words(60)


def test_a_page_of_comments_only_keeps_them():
    assert h.main_text(f'<div id="comments"><p>{words(60)}</p></div>') == words(60)


@pytest.mark.parametrize("tag", ["article", "div", "section"])
def test_several_regions_are_kept(tag):
    got = h.main_text(f"<body><nav>Home</nav><{tag}><p>{words(60)}</p></{tag}><{tag}><p>{words(30, 'b')}</p></{tag}></body>")
    assert got == f"{words(60)}\n{words(30, 'b')}"


def test_paragraphs_of_links_stay_between_others():
    link = f'<p><a href="x">{words(8, "l")}</a> b</p>'
    assert h.main_text(f"<div><p>{words(40)}</p>{link}<p>{words(40, 'z')}</p></div>") == f"{words(40)}\n{words(8, 'l')} b\n{words(40, 'z')}"


def test_teasers_beside_the_article_go():
    """Articles of a title and a link only have no line of the upper cluster."""
    teasers = "".join(f'<article><h3><a href="/{i}">Story {i}</a></h3></article>' for i in range(3))
    assert h.main_text(f"<main><article><h1>T</h1><p>{words(80)}</p><p>ok</p></article>{teasers}</main>") == f"T\n{words(80)}\nok"


def test_named_wrappers_of_the_article_stay_and_sidebars_go():
    body, side = f"<article><p>{words(90)}</p></article>", f"<article><p>{words(40, 's')}</p></article>"
    assert h.main_text(f'<div class="widget">{body}</div>') == words(90)
    assert h.main_text(f'{body}<div class="sidebar">{side}</div>') == words(90)


def test_without_marks_the_ratio_decides():
    """Short lines around running text in containers without names; without the threshold they would come, too."""
    menu = "".join(f"<div><a href='/{i}'>Entry {i}</a></div>" for i in range(6))
    foot = "<div><a href='/a'>About</a></div><div>(c) us</div>"
    page = f"<body><div>{menu}</div><div><h1>Head</h1><p>{words(50)}</p><div>{words(60, 'x')}</div><p>{words(40, 'y')}</p></div><div>{foot}</div></body>"
    assert h.main_text(page) == f"Head\n{words(50)}\n{words(60, 'x')}\n{words(40, 'y')}"


def test_regions_against_all_choices():
    """The container is the deepest one with nine tenths of the mass, tried out on all trees of up to six blocks."""
    for n in range(2, 6):
        for parents in itertools.product(*(range(k) for k in range(1, n + 1))):
            page = h.Lines()
            page.parent, page.kind = [0, *parents], ["html"] + ["div"] * n
            weights = np.array([(7 * k * k + 3) % 11 for k in range(n + 1)], float)
            mass = h.subtree(weights, page.parent)
            ways = [0]
            while True:
                inside = [k for k in range(1, n + 1) if page.parent[k] == ways[-1] and 10 * mass[k] >= 9 * mass[ways[-1]]]
                if not inside:
                    break
                ways.append(max(inside, key=lambda k: mass[k]))
            assert h.regions(page, mass, np.zeros(n + 1)) == [ways[-1]]
