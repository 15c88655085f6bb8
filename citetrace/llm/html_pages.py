"""Labelled pages for the extraction model: layouts with a mark on what is article, filled with made-up words.

``[[`` and ``]]`` stand around the article's parts; all else that shows is not. W, S, L, P and Q stand for a word, a
short line, a long sentence, a paragraph and many short paragraphs.
"""

from __future__ import annotations

import random

LAYOUTS = (
    "<body><nav><ul><li><a>W</a></li><li><a>W</a></li><li><a>W</a></li></ul></nav><div class='ad'>L</div><article>[[<h1>S</h1><p><b>S<br></p><p>P</p>Q<p>P</p><p>W.</p>]]</article><footer>&copy; W &middot; L</footer></body>",
    "<body><header><div class='logo'>W</div><div class='menu'><a>W</a> <a>W</a> <a>W</a></div></header><main>[[<h1>S</h1><p>P</p><h2>S</h2>Q<p>P</p><ul><li>S</li><li>L</li></ul><p>P</p>]]</main><aside><h3>W</h3><p>L</p><ul><li><a>S</a></li><li><a>S</a></li></ul></aside><footer><p>L</p><a>W</a></footer></body>",
    "<body><div id='header'><p>S</p></div><div id='nav'><a>W</a> | <a>W</a></div><div id='content'><div class='post'>[[<h2>S</h2><p>P</p><blockquote>P</blockquote><p>L</p>]]<div class='comments'><h3>W</h3><div class='comment'><p>P</p></div><div class='comment'><p>L</p></div></div></div></div><div id='sidebar'><h4>W</h4><p>P</p><a>S</a></div><div id='footer'>L</div></body>",
    "<body><div class='cookie-notice'><p>P</p><button>W</button></div><div class='container'><div class='entry-content'>[[<p>P</p><p>P</p><pre>L</pre><p>P</p>]]</div><div class='related-posts'><h3>W</h3><p><a>S</a></p><p><a>S</a></p></div><form class='newsletter'><label>S</label><p>L</p><button>W</button></form></div><div class='copyright'>S</div></body>",
    "<body><table><tr><td class='menu'><a>W</a><br><a>W</a></td><td class='story'>[[<h1>S</h1><p>P</p><p>P</p>]]</td><td class='promo'><p>L</p></td></tr></table></body>",
    "<body><div role='navigation'><a>W</a><a>W</a></div><div role='alert'>L</div><section class='article-body'>[[<h1>S</h1><div>P</div><div>P</div><figure><figcaption>S</figcaption></figure><div>L</div>]]</section><section class='comments' id='comments'><h2>W</h2><ol><li><p>P</p></li><li><p>L</p></li></ol><form><p>S</p></form></section><div class='share-buttons'><a>W</a><a>W</a></div></body>",
    "<body><article><header>[[<h1>S</h1>]]<p class='byline'>S</p></header>[[<p>P</p><p>P</p>]]<div class='advert'><p>L</p></div>[[<p>P</p>]]<aside class='sidebar'><p>P</p></aside>[[<p>L</p>]]<footer><p>S</p></footer></article><div class='banner'>L</div></body>",
    "<body><div class='top'><ul class='breadcrumb'><li><a>W</a></li><li><a>W</a></li></ul></div><div class='main'>[[<p>P</p><table><tr><th>W</th><td>S</td></tr></table><p>P</p>]]</div><div class='widget'><p>P</p><ul><li><a>S</a></li></ul></div><div class='subscribe'><p>L</p></div></body>",
    "<body><article>[[<h1>S</h1><p>P</p><p>L</p>Q<p>W</p>]]<section id='comments'><h2>S</h2><p>P</p><p>P</p></section></article><div class='disclaimer notice'><p>P</p></div><footer><ul><li><a>W</a></li></ul><p>L</p></footer></body>",
    "<body><article class='post'>[[<h1>S</h1><p>P</p><p>P</p>]]<div class='comments'><h3>S</h3><p>P</p><p>P</p><p>L</p></div><div class='cookie-banner'><p>P</p><p>L</p></div></article><section class='reader-comments'><p>P</p><p>P</p></section><aside><p>P</p><p>P</p></aside></body>",
    "<body><header><p>P</p><p>L</p></header><div id='content'>[[<p>P</p><p>L</p>]]<section class='discussion'><ul><li>P</li><li>P</li></ul></section><form class='signup'><p>P</p><p>L</p></form></div><div class='sidebar'><p>P</p><p>P</p><p>P</p></div><footer><p>P</p><p>P</p></footer></body>",
    "<body><p><a>W</a> <a>W</a> <a>W</a></p><h1>[[S]]</h1>[[<p>P</p><p>P</p><p>P</p>]]<p><a>S</a></p></body>",
    "<body><div><div><a>W</a><a>W</a></div><div>[[<p>P</p><p>P</p><p>L</p>]]</div><div><a>S</a><a>S</a><a>S</a></div></div></body>",
    "<body><nav>W W</nav><div class='popup modal'><h2>S</h2><p>L</p><form><input><button>W</button></form></div><main><article>[[<h1>S</h1><p>P <a>W</a> P</p><ol><li>L</li><li>L</li></ol><p>P</p>]]<div class='tags'><a>W</a><a>W</a></div><div class='author-bio'><p>L</p></div></article></main><div class='sponsored'><p>P</p></div></body>",
    "<body><article>[[<h1>S</h1><p>P</p><h2>S</h2><p>P</p><p>L</p>]]<h2>Comments</h2><ul><li><p>P</p></li><li>L</li><li><p>P</p></li></ul></article><div>Copyright 2021 W. All rights reserved.</div></body>",
    "<body><div>[[<h1>S</h1><p>P</p><p>P</p><p>P</p>]]<h3>4 Responses</h3><div><b>W</b><p>P</p></div><div><b>W</b><p>P</p></div><h3>Related stories</h3><ul><li><a>S</a></li><li>S</li></ul></div><p>&copy; 2019 W W</p></body>",
    "<body><main>[[<h1>S</h1><p>L</p><h2>S</h2><p>P</p><ul><li>L</li><li>L</li></ul>]]<div class='thread'><div><p>P</p></div><div><p>P</p><p>L</p></div></div></main><div role='contentinfo'><p>P</p><p>L</p></div></body>",
    "<body><div>[[<h1>S</h1><h2>S</h2><p>P</p><p>P</p><h2>Related work</h2><p>P</p><p>P</p><h2>Response</h2><p>P</p><p>P</p><h2>Popular S</h2><p>P</p>]]</div><div><h3>Leave a reply</h3><p>L</p></div></body>",
    "<body><div><a>W</a><a>W</a></div><div>[[<h1>S</h1><p>P</p><h4>S</h4><p>P</p><p>P</p><h4>S</h4><p>P</p><p>P</p><h4>S</h4><p>P</p><h4>Discussion</h4><p>P</p>]]<h4>9 replies</h4><div><p>P</p></div><div><p>P</p></div></div><footer><p>W</p></footer></body>",
    "<body><div class='entry'>[[<h2>S</h2><p>P</p>]]<h4>You may also like</h4><p>S</p><p>L</p><h4>Reader comments</h4><p>P</p><p>P</p><p>L</p></div><div>&copy; W W. All rights reserved.</div></body>",
    "<body><section>[[<h1>S</h1><h2>S</h2><p>P</p><h2>S</h2><p>P</p><h3>S</h3><p>L</p><p>P</p><h2>Discussion</h2><p>P</p><ol><li>P</li><li>P</li></ol><h2>Responses to S</h2><p>P</p>]]<h2>3 Comments</h2><p>P</p><ol><li>P</li><li>P</li></ol></section><section><h2>More from W</h2><p>L</p><p>L</p></section></body>",
)


def filled(layout: str, rng: random.Random) -> str:
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    line = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: line(6, 18).capitalize() + rng.choice([".", ".", ".", ""])
    out = []
    inside = False
    for i, c in enumerate(layout):
        alone = c in "WSLPQ" and not (layout[i - 1].isalpha() or layout[i - 1] in "</&'" or layout[i + 1 : i + 2].isalpha())
        if c in "<":
            inside = True
        if alone and not inside:
            out.append(
                {"W": word, "S": lambda: line(2, 8).capitalize(), "L": sentence, "P": lambda: " ".join(sentence() for _ in range(rng.choice((1, 2, 3, 5, 9, 20)))), "Q": lambda: "".join(f"<p>{line(1, 4)}</p>" for _ in range(rng.randint(0, 60)))}[c]()
            )
        else:
            out.append(c)
        if c == ">":
            inside = False
    return "".join(out)


def labelled_pages(copies: int, seed: int = 11) -> list[str]:
    """``copies`` pages of each layout; a part of them loses the names that give the answer away."""
    rng = random.Random(seed)
    pages = []
    for _ in range(copies):
        for layout in LAYOUTS:
            page = filled(layout, rng)
            if rng.random() < 0.15:
                for tag in ("article", "main", "aside", "nav"):
                    page = page.replace(f"<{tag}", "<div").replace(f"</{tag}>", "</div>")
            pages.append(page)
    return pages
