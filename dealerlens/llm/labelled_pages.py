"""Labelled pages to train the extraction model on: hand-written layouts, filled with invented prose.

In a layout, ``{P}`` stands for paragraphs of the article (each in its own ``<p>``), ``{T}`` for a title, ``{S}`` for a sentence,
``{L}`` for a few words and ``{A}`` for list items with links. A pilcrow opens every text that is content.
"""

from __future__ import annotations

import random
import re

MARK = "¶"

LAYOUTS = [
    # semantic elements
    "<nav><ul>{A}</ul></nav><div class='ad'>{S}</div><article><h1>¶{T}</h1>{P}</article><footer>&copy; {L} &middot; {S}</footer>",
    "<nav><ul>{A}</ul></nav><article><h1>¶{T}</h1>{P}<div class='ad'>{S}</div>{P}<aside class='sidebar'><p>{S}</p></aside>{P}</article><footer>{L} {S}</footer>",
    "<header><div class='logo'>{L}</div><nav>{A}</nav></header><main><article class='post'><h1>¶{T}</h1><div class='entry-content'>{P}<h2>¶{L}</h2>{P}</div></article>"
    "<section id='comments' class='comments'><h3>{L}</h3><ol><li class='comment'><p>{S} {S}</p></li><li class='comment'><p>{S}</p></li></ol></section></main>"
    "<aside class='sidebar'><div class='widget'><h4>{L}</h4><ul>{A}</ul></div><p>{S}</p></aside><footer><p>&copy; {L}. {S}</p></footer>",
    "<header role='banner'><h2>{L}</h2><p>{S}</p></header><nav role='navigation'>{A}</nav><main role='main'><h1>¶{T}</h1>{P}<blockquote>¶{S}</blockquote>{P}</main>"
    "<div role='complementary'><p>{S}</p>{A}</div><footer role='contentinfo'><p>{S}</p></footer>",
    "<div class='notice'><p>{S}</p></div><header>{L}</header><article><header><h1>¶{T}</h1></header><section>{P}</section><section><h2>¶{L}</h2>{P}</section></article>"
    "<section class='reader-comments'><h2>{L}</h2><div class='comment'><p>{S} {S} {S}</p></div><div class='comment'><p>{S} {S}</p></div></section><footer>{S}</footer>",
    "<nav>{A}</nav><main><div class='notice' role='alert'>{S}</div><article><h1>¶{T}</h1>{P}<form><p>{S}</p><label>{L}</label></form>{P}"
    "<div class='comments'><p>{S}</p><p>{S} {S}</p></div></article></main><aside><p>{S} {S}</p></aside><footer><ul>{A}</ul><p>{S}</p></footer>",
    "<article><h1>¶{T}</h1>{P}<ul><li>¶{S}</li><li>¶{S}</li></ul>{P}<table><tr><th>¶{L}</th><td>¶{L}</td></tr></table><pre>¶{S}</pre>{P}</article><footer>{S}</footer>",
    # divisions told apart by class or id
    "<div id='header'><div class='logo'><a href='/'>{L}</a></div></div><div id='menu' class='menu'><ul>{A}</ul></div><div id='content' class='content'><h2>¶{T}</h2>{P}"
    "<ul><li>¶{S}</li><li>¶{S}</li></ul>{P}</div><div id='sidebar' class='sidebar'><h3>{L}</h3><p>{S}</p><ul>{A}</ul></div><div id='footer' class='footer'><p>{S}</p></div>",
    "<div class='cookie-banner cookie notice'><p>{S} {S}</p></div><div class='navbar menu'>{A}</div><div class='article-body article'><h1>¶{T}</h1>{P}"
    "<div class='newsletter subscribe'><h4>{L}</h4><p>{S}</p><form><label>{L}</label></form></div>{P}<div class='share social'>{A}</div></div>"
    "<div class='related recommended'><h3>{L}</h3><ul>{A}</ul></div><div class='footer'>{S}</div>",
    "<div class='top header banner'>{L}</div><div class='breadcrumb'>{A}</div><div class='story-body story'><h1>¶{T}</h1>{P}<div class='advertisement advert ads'><p>{S}</p></div>{P}"
    "<div class='promo sponsored'><p>{S} {S}</p></div>{P}</div><ul class='tags'>{A}</ul><div id='disqus comments'><p>{S}</p><p>{S}</p></div><div class='copyright'>&copy; {S}</div>",
    "<div class='wrapper'><div class='nav'>{A}</div><div class='main'><div class='post'><h1>¶{T}</h1><div class='text'>{P}</div></div><div class='comment-list comments'>"
    "<div class='reply comment'><p>{S} {S}</p></div><div class='reply comment'><p>{S} {S} {S}</p></div></div></div><div class='right-column sidebar'><p>{S}</p></div></div>",
    "<div id='page'><div id='masthead' class='header'>{L}</div><div class='alert notice'>{S}</div><div id='body' class='entry'><h1>¶{T}</h1>{P}</div>"
    "<div class='pagination'>{A}</div><div class='search'><form>{L}</form></div><div class='login signup'><form><p>{S}</p></form></div><div class='footer'>{S}<ul>{A}</ul></div></div>",
    "<div class='popup modal'><p>{S}</p><form><p>{S}</p></form></div><div class='content'><div class='ad ads'>{S}</div><h1>¶{T}</h1>{P}<div class='ad'><p>{S}</p></div>{P}</div><div class='footer'>{L}</div>",
    # structure alone
    "<div class='c1'><ul>{A}</ul></div><div class='c2'><h1>¶{T}</h1>{P}{P}</div><div class='c3'><ul>{A}</ul></div><div class='c4'>&copy; {L}</div>",
    "<table><tr><td><ul>{A}</ul></td><td><h1>¶{T}</h1>{P}{P}</td></tr><tr><td>&copy; {L}</td></tr></table>",
    "<h1>¶{T}</h1>{P}{P}<hr><ul>{A}</ul><div>&copy; {L}</div>",
    "<div><ul>{A}</ul></div><div><div><h2>¶{T}</h2><div>{P}<h3>¶{L}</h3>{P}</div></div></div><footer>&copy; {S}</footer>",
    "<p>¶{S} {S}</p><p>¶{S}</p>",
    "<div class='content'>{P}</div><div id='comments'><p>{S}</p></div>",
    "<div id='content'><h3>¶{L}</h3>{P}</div><div class='sidebar'><p>{S}</p></div>",
    "<article>{P}</article><div class='comments'>{S}</div>",
    "<main>{P}</main><footer>{S}</footer>",
]

_SYLLABLES = ("an", "er", "the", "ou", "ti", "on", "re", "ha", "ing", "st", "ra", "lo", "mi", "ent", "is", "al", "que", "der", "ung", "ci")


def _words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices(_SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


def _sentence(rng: random.Random) -> str:
    return _words(rng, rng.choice((1, 2, 3, 5, 8, 12, 18))).capitalize() + "."


def _filled(rng: random.Random, slot: str) -> str:
    if slot == "P":
        texts = (" ".join(_sentence(rng) for _ in range(rng.choice((1, 1, 1, 2, 4, 8)))) for _ in range(rng.choice((1, 2, 3, 6, 12))))
        return "".join(f"<p>{MARK}{t}</p>" if rng.random() < .85 else f"<p><b>{MARK}{t}<br>" for t in texts) + "</p>"
    if slot == "A":
        return "".join(f"<li><a href='/x'>{_words(rng, rng.randint(1, 3))}</a></li>" for _ in range(rng.randint(3, 8)))
    return {"T": lambda: _words(rng, rng.randint(2, 9)).capitalize(), "S": lambda: _sentence(rng),
            "L": lambda: _words(rng, rng.randint(1, 4)).capitalize()}[slot]()


def labelled_pages(copies: int = 5, seed: int = 42) -> list[str]:
    """Every layout ``copies`` times, each with other prose."""
    rng = random.Random(seed)
    return ["<html><head><title>t</title></head><body>" + re.sub(r"\{([PTSLA])\}", lambda m: _filled(rng, m[1]), x) + "</body></html>"
            for _ in range(copies) for x in LAYOUTS]
