"""Pages that the templates of the training pages don't make: other names, other nesting, other words."""

import random

import pytest

from palimpsest.llm import html_text

P = "The first paragraph has a few sentences. It goes on for a while, as they do."
Q = "Another paragraph follows here, with words and commas, and an end."
R = "A third one closes the story, not too short and not too long."
PAGES = {
    "a plain wrapper beside a sidebar": (f'<body><div><div class="wrap"><p>{P}</p><p>{Q}</p><p>{R}</p></div><div class=sidebar><ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul></div></div></body>', [P, Q, R]),
    "nested plain wrappers": (f"<html><body><div><div><p>{P}</p><p>{Q}</p><p>{R}</p></div></div></body></html>", [P, Q, R]),
    "a plain wrapper at the top": (f"<html><body><div><p>{P}</p><p>{Q}</p></div><div class=sidebar><p><a href=x>Related</a></p></div></body></html>", [P, Q]),
    "paragraphs that are divs": (f"<html><body><nav><ul><li><a href=a>Home</a></li></ul></nav><div class=story><div>{P}</div><div>{Q}</div><div>{R}</div></div><footer>© 2020 X</footer></body></html>", [P, Q, R]),
    "a misleading name": (f'<html><body><div id=content class="side-by-side"><h1>A title</h1><p>{P}</p><p>{Q}</p></div></body></html>', ["A title", P, Q]),
    "a paragraph that is a link": (f"<html><body><div class=post><p>{P}</p><p><a href=x>{Q}</a></p><p>{R}</p></div></body></html>", [P, Q, R]),
    "a part called discussion": (f"<html><body><article><h1>Title words</h1><section class=discussion><p>{P}</p><p>{Q}</p></section></article></body></html>", ["Title words", P, Q]),
    "links within the article": (f"<html><body><article><h1>Title words</h1><p>{P}</p><ul><li><a href=x>First source of it</a></li><li><a href=y>Second source of it</a></li></ul><p>{Q}</p></article></body></html>", ["Title words", P, "First source of it", "Second source of it", Q]),
    "a page laid out in a table": (f"<html><body><table><tr><td><a href=a>Menu1</a><br><a href=b>Menu2</a></td><td><h1>Title words</h1><p>{P}</p><p>{Q}</p></td></tr></table></body></html>", ["Title words", P, Q]),
    "made-up names": (f'<html><body><div class="xk2"><ul><li><a href=a>Home</a></li><li><a href=a>News</a></li></ul></div><div class="qq"><h1>Title words</h1><p>{P}</p><p>{Q}</p></div><div class="zz"><a href=i>Imprint</a> © 2021</div></body></html>', ["Title words", P, Q]),
    "comments of readers": (f'<html><body><article><h1>Title words</h1><p>{P}</p><p>{Q}</p><div class="comments"><h3>Comments</h3><div class="comment"><p>I liked this one a lot.</p></div><div class="comment"><p>Me too!</p></div></div></article></body></html>', ["Title words", P, Q]),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_articles_survive_names_and_nesting(name):
    page, want = PAGES[name]
    assert html_text.trained().extract(page).split("\n") == want


WORDS = "river stone lantern quiet market window engine copper valley signal harbour winter meadow thread orchard paper number garden bridge morning".split()


def other_page(rng):
    """A page of another generator: its own words, names, nesting and order. Gives the page and its article's blocks."""
    sentence = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(6, 18))).capitalize() + "."
    block = lambda: " ".join(sentence() for _ in range(rng.randint(1, 5)))
    named = lambda names: rng.choice(("", f' class="{rng.choice(names)}"', f' id="{rng.choice(names)}"'))
    menu = lambda: "".join(f'<li><a href="/{w}">{w.title()}</a></li>' for w in rng.sample(WORDS, rng.randint(3, 7)))
    blocks, inner = [], []
    if rng.random() < 0.8:
        blocks.append(" ".join(rng.sample(WORDS, 4)).title())
        inner.append(f"<h1>{blocks[-1]}</h1>")
    paragraph = rng.choice(("p", "p", "p", "div"))
    for _ in range(rng.randint(2, 14)):
        blocks.append(block())
        inner.append(f"<{paragraph}>{blocks[-1]}</{paragraph}>")
        if rng.random() < 0.1:
            items = [sentence() for _ in range(3)]
            blocks += items
            inner.append("<ol>" + "".join(f"<li>{x}</li>" for x in items) + "</ol>")
    body = "".join(inner)
    for _ in range(rng.randint(0, 2)):
        body = f"<div{named(['region', 'inner-wrap', 'col9', 'stack'])}>{body}</div>"
    holder = rng.choice(("article", "main", "section", "div"))
    body = f"<{holder}{named(['reading', 'essay', 'page-text', 'longform'])}>{body}</{holder}>"
    head = f"<header><a href=/>{rng.choice(WORDS).title()} Daily</a></header>" * (rng.random() < 0.5) + f"<nav{named(['links-bar', 'sections'])}><ul>{menu()}</ul></nav>" * (rng.random() < 0.8)
    side = f"<aside{named(['rail', 'teasers'])}><h4>More</h4><ul>{menu()}</ul></aside>" * (rng.random() < 0.5)
    foot = f"<footer{named(['imprint', 'baseline'])}><p>© 2019 {rng.choice(WORDS)} press</p><ul>{menu()}</ul></footer>" * (rng.random() < 0.8)
    return f"<!doctype html><html><body>{head}{body}{side}{foot}</body></html>", blocks


def test_pages_of_another_generator():
    rng, model = random.Random(99), html_text.trained()
    found = said = true = whole = 0
    n = 400
    for _ in range(n):
        page, want = other_page(rng)
        got = [x for x in model.extract(page).split("\n") if x]
        found += len(set(want) & set(got))
        said, true = said + len(got), true + len(want)
        whole += set(want) <= set(got)
    recall, precision, pages = found / true, found / said, whole / n
    print(f"recall {recall:.4f} precision {precision:.4f} whole pages {pages:.4f}")
    assert recall >= 0.98 and precision >= 0.95 and pages >= 0.95
