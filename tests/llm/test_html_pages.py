"""Labelled pages from templates with names the rules do not list one by one: main text against the text that was put in."""

import random

import pytest

from paritylake.llm import html_text

WORDS = "river stone market winter letter garden window paper village morning music island answer bridge captain doctor engine forest harbour journey kitchen lantern".split()


def prose(rng, low, high):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(low, high))).capitalize() + "."


def links(rng, n):
    return "".join(f"<li><a href='/{i}'>{rng.choice(WORDS)} {rng.choice(WORDS)}</a></li>" for i in range(n))


def news(rng, body):
    return (f"<html><head><title>x</title></head><body class='home page'><div class='cookie-banner'>We use cookies to make this site better. <button>Accept</button></div>"
            f"<header class='masthead'><a href='/'>The Paper</a><nav><ul>{links(rng, 6)}</ul></nav></header><main id='content'><article class='story h-entry'>"
            f"<header><h1>{body[0]}</h1></header>" + "".join(f"<p>{p}</p>" for p in body[1:])
            + f"<aside class='pull'>{prose(rng, 5, 9)}</aside></article><section class='related-articles'><h3>More</h3><ul>{links(rng, 4)}</ul></section></main>"
            f"<footer><p>{prose(rng, 20, 40)}</p></footer></body></html>")


def blog(rng, body):
    middle = len(body) // 2
    return (f"<body><div id='navbar'><ul>{links(rng, 5)}</ul></div><article id='post-12' class='post has-thumbnail'><h2 class='entry-title'>{body[0]}</h2>"
            + "".join(f"<p>{p}</p>" for p in body[1:middle]) + f"<div class='ad-unit'>{prose(rng, 6, 12)}</div>" + "".join(f"<p>{p}</p>" for p in body[middle:])
            + f"<div class='share-buttons'><a>Tweet</a> <a>Mail</a></div><form action='/s'><label>Name</label><input></form></article>"
            f"<div id='comments' class='comments-area'><h3>2 replies</h3><div class='comment-list'><p>{prose(rng, 20, 60)}</p></div></div></body>")


def docs(rng, body):
    return (f"<body><div class='sidebar-left'><ul>{links(rng, 12)}</ul></div><main><h1>{body[0]}</h1>"
            + "".join(f"<div class='section'><p>{p}</p></div>" for p in body[1:-1]) + f"<blockquote>{body[-1]}</blockquote></main><div class='footer-links'><ul>{links(rng, 4)}</ul></div></body>")


def plain(rng, body):
    return (f"<body><table><tr><td><a href='/'>Home</a> | <a href='/a'>About us</a> | <a href='/c'>Contact</a></td></tr></table><h1>{body[0]}</h1>"
            + "".join(f"<p>{p}<p>" for p in body[1:]) + f"<script>var a = '<p>{prose(rng, 5, 9)}</p>';</script><ul>{links(rng, 6)}</ul></body>")


def boxes(rng, body):
    return (f"<body><div class='top-menu'><a>One</a><a>Two</a></div><div class='wrapper'><div class='main-column'><div class='headline'>{body[0]}</div>"
            + "".join(f"<div class='paragraph'>{p}</div>" for p in body[1:]) + f"</div><div class='right-sidebar'><div class='widget'>{prose(rng, 12, 30)}</div><ul>{links(rng, 5)}</ul></div></div>"
            f"<div class='site-footer'>{prose(rng, 10, 20)}</div></body>")


def notices(rng, body):
    return (f"<body><article><div class='notice-box'>{prose(rng, 8, 20)}</div><h1>{body[0]}</h1>" + "".join(f"<p>{p}</p>" for p in body[1:])
            + f"<h2>Sources</h2><ul><li><a>{body[1][:20]}</a></li></ul><div class='newsletter-box'>{prose(rng, 9, 15)}</div><section id='reader-comments'><p>{prose(rng, 15, 30)}</p></section></article>"
            f"<div class='popup'>{prose(rng, 5, 10)}</div></body>")


@pytest.mark.parametrize("template", [news, blog, docs, plain, boxes, notices])
def test_main_text_of_labelled_pages(template):
    tree = html_text.grow(html_text.LABELLED)
    for seed in range(15):
        rng = random.Random(f"{template.__name__} {seed}")
        body = [prose(rng, 3, 9).rstrip("."), *(prose(rng, 25, 90) for _ in range(rng.randint(3, 7)))]
        want = " ".join(body) + (f" Sources {body[1][:20]}".rstrip() if template is notices else "")
        assert html_text.main_text(template(rng, body), tree) == " ".join(want.split())


def test_a_very_long_page():
    tree = html_text.grow(html_text.LABELLED)
    body = " ".join(["word"] * 400_000)
    assert html_text.main_text(f"<nav><a>x</a></nav><article><p>{body}</p></article>", tree) == body
