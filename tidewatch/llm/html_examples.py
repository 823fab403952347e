"""Labelled example pages from which the main-text tree is grown.

Sketches of common layouts, written for this purpose: a block is ``path words/linked sign``, the path its elements (``tag.class``),
then how many words it has, how many of these in links, and + if it is main text. They are rendered as HTML, cut into blocks as any
page, in three forms: as they are, with their article and main elements made plain (pages that don't
say which element is their article), and without classes as well (pages whose classes say nothing). The first form
has a weight of AS_IS.
"""

from __future__ import annotations

import re

AS_IS = 3

#: The labelled pages. Fixed values.
PAGES = {
    "news": "nav/li 1/1 -, nav/li 2/2 -, nav/li 1/1 -, div.ad 9/0 -, article/h1 9/0 +, article/p 3/1 +, article/p 48/0 +, article/p 61/2 +, article/p 37/0 +, article/div.share 4/4 -, article/p 44/5 +, article/p 12/0 +, aside/h3 2/0 -, aside/li 8/8 -, aside/li 9/9 -, footer/p 14/6 -",
    "blog": "header/h2 3/3 -, header/p 6/0 -, main/h1 7/0 +, main/p 5/1 +, main/p 90/4 +, main/p 72/0 +, main/h2 4/0 +, main/p 55/6 +, main/blockquote 26/0 +, main/p 40/0 +, div.sidebar/h3 2/0 -, div.sidebar/p 31/2 -, div.sidebar/li 3/3 -, div.comments/h3 2/0 -, div.comments/p 34/0 -, div.comments/p 18/0 -, footer/p 9/2 -",
    "wiki": "nav/li 2/2 -, nav/li 2/2 -, nav/li 3/3 -, main/h1 2/0 +, main/p 85/14 +, main/p 70/18 +, main/h2 1/0 +, main/li 12/3 +, main/li 15/4 +, main/li 9/9 +, main/p 66/12 +, main/h2 2/0 +, main/p 51/7 +, footer/p 22/6 -, footer/li 2/2 -, footer/li 2/2 -",
    "short": "nav/li 1/1 -, nav/li 1/1 -, nav/li 1/1 -, div.ad 7/0 -, article/h1 6/0 +, article/p 14/0 +, article/p 8/0 +, footer/p 6/1 -",
    "notice": "div.cookie-notice 27/3 -, div.cookie-notice/button 1/0 -, nav/li 1/1 -, nav/li 2/2 -, article/h1 8/0 +, article/p 52/1 +, article/p 47/0 +, article/p 39/2 +, div.newsletter-signup/p 19/0 -, form 6/0 -, footer/p 11/4 -",
    "lists": "nav/li 2/2 -, nav/li 1/1 -, article/h1 4/0 +, article/p 22/0 +, article/h2 1/0 +, article/li 4/0 +, article/li 3/0 +, article/li 5/0 +, article/li 4/0 +, article/h2 1/0 +, article/li 17/0 +, article/li 21/0 +, article/li 14/0 +, article/p 28/1 +, aside/p 16/0 -, aside/li 6/6 -, aside/li 7/7 -",
    "teasers": "nav/li 1/1 -, nav/li 1/1 -, main/h1 5/0 +, main/p 64/0 +, main/p 58/3 +, main/div.related/h3 2/0 -, main/div.related/p 11/11 -, main/div.related/p 13/13 -, main/div.related/p 24/9 -, footer/li 2/2 -, footer/li 1/1 -, footer/p 8/0 -",
    "docs": "nav/li 2/2 -, nav/li 3/3 -, nav/li 2/2 -, nav/li 4/4 -, main/h1 3/0 +, main/p 33/2 +, main/pre 19/0 +, main/p 27/0 +, main/pre 42/0 +, main/h2 3/0 +, main/p 45/3 +, main/td 2/0 +, main/td 9/0 +, main/td 3/0 +, main/td 11/0 +, div.pagination 2/2 -, div.pagination 2/2 -, footer/p 7/1 -",
    "soup": "div/a 1/1 -, div/a 1/1 -, div/a 2/2 -, div/p 3/0 -, div/h1 8/0 +, div/p 57/0 +, div/p 63/2 +, div/p 49/0 +, div/p 71/4 +, div/p 23/0 +, div/h4 2/0 -, div/a 9/9 -, div/a 8/8 -, div/a 10/10 -, div/p 6/2 -",
    "comments": "nav/li 1/1 -, article/h1 7/0 +, article/p 46/0 +, article/p 53/1 +, div.comments/h3 2/0 -, div.comments/p 2/1 -, div.comments/p 41/0 -, div.comments/p 3/1 -, div.comments/p 66/0 -, div.comments/p 2/1 -, div.comments/p 25/0 -, form 5/0 -, footer/p 10/3 -",
    "promo": "div.banner 12/2 -, nav/li 1/1 -, nav/li 2/2 -, article/h1 10/0 +, article/p 66/0 +, article/div.ad 15/0 -, article/p 59/3 +, article/div.promo 21/8 -, article/p 43/0 +, div.ad 11/0 -, div.popular/h3 2/0 -, div.popular/li 7/7 -, div.popular/li 9/9 -, footer/p 18/5 -",
    "column": "div/li 2/2 -, div/li 2/2 -, div/li 1/1 -, div/h1 6/0 +, div/p 88/0 +, div/p 102/5 +, div/p 76/1 +, div/li 18/0 +, div/li 25/1 +, div/p 54/0 +, div/p 4/4 -, div/p 5/5 -, div/p 3/3 -, div/p 9/0 -",
    "alone": "article/p 1/0 +",
    "single": "nav/li 1/1 -, article/p 38/0 +",
    "last": "nav/li 2/2 -, nav/li 1/1 -, div.ad 8/0 -, article/h1 5/0 +, article/p 42/0 +, article/p 6/0 +, article/p 31/2 +",
    "terse": "div.ad 6/0 -, main/h1 2/0 +, main/p 4/0 +, main/p 1/0 +, main/p 3/0 +, main/p 2/1 +",
    "sources": "nav/li 1/1 -, article/h1 6/0 +, article/p 50/3 +, article/h2 1/0 +, article/li 7/7 +, article/li 5/5 +, article/li 9/6 +, footer/p 5/0 -",
    "figures": "nav/li 1/1 -, div/p 3/0 -, article/figcaption 9/0 +, article/h1 7/0 +, article/p 2/2 +, article/p 33/0 +, article/figcaption 5/1 +, article/p 29/0 +, div/p 45/0 -, div/p 5/5 -, footer/p 40/3 -",
    "asides": "main/h1 4/0 +, main/p 36/0 +, main/aside/p 28/0 -, main/p 41/0 +, main/div.widget/p 17/1 -, main/p 5/0 +, div/p 19/0 -, div/p 33/0 -",
    "crumbs": "div/p 3/3 -, div/p 4/2 -, article/p 60/0 +, article/p 48/1 +, div/p 4/4 -, div/p 52/2 -",
    "jump": "div/p 2/2 -, div/p 2/2 -, main/p 71/2 +, main/p 45/0 +, main/p 57/0 +, div/li 6/6 -, div/p 44/0 -",
    "menu": "ul/li 1/1 -, ul/li 2/2 -, p 30/0 +, p 2/0 +",
    "note": "ul/li 1/1 -, ul/li 2/2 -, p 14/0 +, p 8/0 +, p 21/0 +",
    "card": "ul/li 2/2 -, ul/li 1/1 -, ul/li 1/1 -, p 19/0 +, p 3/0 +, ul/li 2/2 -, ul/li 1/1 -, p 4/0 -",
    "plain": "ul/li 1/1 -, ul/li 1/1 -, ul/li 3/3 -, p 46/0 +, p 27/1 +, p 3/0 +, p 38/0 +, p 6/0 +",
    "headed": "div/li 2/2 -, div/li 1/1 -, div/h1 4/0 +, div/p 25/0 +, div/p 7/0 +, div/p 33/2 +, div/p 4/0 +",
    "pointers": "div/p 30/0 +, div/p 6/3 +, div/p 30/0 +, div/p 52/1 +, div/p 4/4 +, div/p 36/0 +",
    "brief": "div/p 14/0 +, div/p 5/3 +, div/p 12/0 +, div/p 7/5 +, div/p 22/0 +, div/p 6/4 +, div/p 18/1 +",
    "within": "div/h1 5/0 +, div/p 34/0 +, div/p 5/5 +, div/p 41/2 +, div/p 7/4 +, div/p 28/0 +, div/p 5/0 +",
    "back": "div/a 5/5 -, div/a 1/1 -, article/p 30/0 +, article/p 20/0 +",
    "steps": "div/a 4/4 -, div/a 1/1 -, main/h1 3/0 +, main/p 35/0 +, main/p 22/0 +, div/a 1/1 -, div/a 5/5 -",
    "turns": "div/a 1/1 -, div/a 1/1 -, div/h1 6/0 +, div/p 58/0 +, div/p 31/0 +, div/a 2/2 -, div/a 2/2 -",
    "letter": "div/p 4/0 +, div/p 44/0 +, div/p 62/0 +, div/p 2/0 +, div/p 2/0 +",
    "index": "article/li 3/3 +, article/li 4/4 +, article/li 2/2 +, article/p 9/1 +",
}


def render(name: str) -> list[tuple[str, bool]]:
    """The blocks of an example as HTML, each with its elements around it, and whether it is main text."""
    out = []
    for i, block in enumerate(PAGES[name].split(", ")):
        path, counts, sign = block.split(" ")
        words, linked = map(int, counts.split("/"))
        body = " ".join(f"w{i}x{k}" for k in range(words - linked)) + (f" <a href=x>{' '.join(f'l{i}x{k}' for k in range(linked))}</a>" if linked else "")
        for part in reversed(path.split("/")):
            tag, _, cls = part.partition(".")
            body = f"<{tag} class='{cls}'>{body}</{tag}>" if cls else f"<{tag}>{body}</{tag}>"
        out.append((body, sign == "+"))
    return out


def variants(name: str) -> list[tuple[str, list[bool], int]]:
    """The example's page in its three forms, with a label per block and a weight."""
    made = render(name)
    page, labels = "<body>" + "".join(b for b, _ in made) + "</body>", [m for _, m in made]
    plain = re.sub(r"<(/?)(?:article|main)>", r"<\1div>", page)
    bare = re.sub(r"<(/?)(?:nav|aside|footer|header|form|button)>", r"<\1div>", re.sub(r" class='[^']*'", "", plain))
    return [(page, labels, AS_IS), (plain, labels, 1), (bare, labels, 1)]
