"""The labelled table of the decision tree: small pages, and for each text block whether it is article text.

The pages are made up; ``w(n)`` stands for n words.
"""

from __future__ import annotations


def w(n: int) -> str:
    return " ".join(("some words of the text that say a thing or two about it, and then more".split() * (n // 15 + 1))[:n]) + "."


def links(n: int, words: int = 1) -> str:
    return "".join(f"<li><a href='/{i}'>{' '.join(['more'] * words)}</a></li>" for i in range(n))


PAGES: list[tuple[str, list[int]]] = [
    # article element between menu, advert and footer
    (f"<body><nav><ul>{links(4)}</ul></nav><div class='ad'>{w(9)}</div><article><h1>{w(6)}</h1><p>{w(40)}</p><p>{w(3)}</p><p>{w(90)}</p></article><footer>{w(14)}</footer>", [0] * 4 + [0, 1, 1, 1, 1, 0]),
    (f"<body><header><p>{w(4)}</p></header><nav><ul>{links(3, 2)}</ul></nav><article><h1>{w(11)}</h1><p>{w(1)}</p><p>{w(60)} <a href='/x'>{w(2)}</a> {w(20)}</p><ul><li>{w(5)}</li><li>{w(12)}</li></ul></article><aside><p>{w(30)}</p></aside><footer>{w(25)}</footer>", [0] * 4 + [1] * 5 + [0, 0]),
    # long asides, short article
    (f"<body><div class='cookie-notice'><p>{w(45)}</p></div><main><h2>{w(3)}</h2><p>{w(8)}</p><p>{w(2)}</p></main><div id='comments'><p>{w(55)}</p><p>{w(35)}</p></div><footer><p>{w(70)}</p></footer>", [0, 1, 1, 1, 0, 0, 0]),
    (f"<body><article><header><h1>{w(7)}</h1></header><p>{w(30)}</p><blockquote>{w(16)}</blockquote><pre>{w(22)}</pre><section class='comments'><p>{w(28)}</p></section><form><p>{w(12)}</p></form></article>", [1, 1, 1, 1, 0, 0]),
    (f"<body><article><p>{w(2)}</p><p><a href='/y'>{w(4)}</a></p><p>{w(50)}</p><div class='related'><ul>{links(3, 6)}</ul></div><p>{w(7)}</p></article>", [1, 1, 1, 0, 0, 0, 1]),
    (f"<body><aside class='sidebar'><h3>{w(2)}</h3><p>{w(65)}</p></aside><article><h1>{w(4)}</h1><table><tr><td>{w(3)}</td><td>{w(4)}</td></tr></table><p>{w(120)}</p></article><div class='newsletter'>{w(18)}</div>", [0, 0, 1, 1, 1, 1, 0]),
    # plain divisions: words and links decide
    (f"<body><div><a href='/'>home</a> | <a href='/n'>news</a> | <a href='/c'>contact</a></div><div>{w(45)}</div><div>{w(80)}</div><div>{w(38)}</div><div><a href='/p'>older</a> <a href='/q'>newer</a></div>", [0, 1, 1, 1, 0]),
    (f"<body><ul>{links(5, 2)}</ul><h1>{w(6)}</h1><p>{w(70)}</p><p>{w(12)}</p><p>{w(55)}</p><p>{w(4)} <a href='/t'>{w(5)}</a></p><ul>{links(4, 7)}</ul>", [0] * 5 + [1, 1, 1, 1, 0] + [0] * 4),
    (f"<body><div>{w(3)}</div><div><a href='/a'>{w(4)}</a></div><h1>{w(9)}</h1><div>{w(60)} <a href='/b'>{w(3)}</a> {w(30)}</div><div>{w(25)}</div><div>{w(4)}</div><div><a href='/d'>{w(8)}</a></div>", [0, 0, 1, 1, 1, 0, 0]),
    (f"<body><p>{w(33)}</p><p>{w(41)}</p><p>{w(9)}</p><p>{w(64)}</p>", [1, 1, 1, 1]),
    (f"<body><p>{w(20)}</p>", [1]),
    (f"<body><h1>{w(5)}</h1><p>{w(26)}</p><p>{w(31)}</p><div class='footer'>{w(22)}</div>", [1, 1, 1, 0]),
    (f"<body><div role='navigation'>{links(6, 1)}</div><div class='banner'>{w(15)}</div><div class='content'><h2>{w(4)}</h2><p>{w(48)}</p><p>{w(75)}</p></div><div class='share'>{w(5)}</div><div class='footer'>{w(11)}</div>", [0] * 6 + [0, 1, 1, 1, 0, 0]),
    # no marks at all, a menu right before the text and teasers right after it
    (f"<body><div><ul>{links(4, 2)}</ul></div><div><p>{w(44)}</p><p>{w(61)}</p><p>{w(30)}</p></div><div><div><a href='/1'>{w(4)}</a></div><div><a href='/2'>{w(3)}</a></div></div>", [0] * 4 + [1, 1, 1, 0, 0]),
    (f"<body><ul>{links(5, 1)}</ul><p>{w(33)}</p><p>{w(82)}</p><ul>{links(3, 4)}</ul>", [0] * 5 + [1, 1] + [0] * 3),
    (f"<body><div><ul>{links(3, 3)}</ul></div><div><h1>{w(7)}</h1><p>{w(52)}</p><ul><li>{w(9)}</li><li>{w(14)}</li></ul><p>{w(71)}</p></div><div><a href='/z'>{w(6)}</a></div>", [0] * 3 + [1, 1, 1, 1, 1, 0]),
    (f"<body><ul>{links(6, 2)}</ul><div>{w(95)}</div><div>{w(27)} <a href='/k'>{w(2)}</a> {w(19)}</div><div>{w(58)}</div><div><a href='/l'>{w(5)}</a></div><div><a href='/m'>{w(7)}</a></div>", [0] * 6 + [1, 1, 1, 0, 0]),
    (f"<body><ul>{links(3, 1)}</ul><p>{w(77)}</p><p>{w(49)}</p><div><a href='/n'>{w(2)}</a></div>", [0] * 3 + [1, 1, 0]),
    (f"<body><ul>{links(2, 3)}</ul><div>{w(66)}</div><div>{w(88)}</div><ul>{links(2, 5)}</ul>", [0, 0, 1, 1, 0, 0]),
    (f"<body><nav><ul>{links(2)}</ul></nav><article><p><a href='/o'>{w(9)}</a></p><p>{w(68)}</p><p><a href='/p'>{w(5)}</a> {w(1)}</p><p>{w(90)}</p></article>", [0, 0, 1, 1, 1, 1]),
    # menus of longer links right before the text
    (f"<body><nav><ul>{links(2, 6)}</ul></nav><article><p>{w(68)}</p><p>{w(54)}</p></article><aside><a href='/q'>{w(8)}</a></aside><div class='footer'>{w(60)}</div>", [0, 0, 1, 1, 0, 0]),
    (f"<body><div class='related'><a href='/r'>{w(10)}</a></div><main><p>{w(72)}</p><p>{w(51)}</p></main>", [0, 1, 1]),
    (f"<body><ul>{links(3, 5)}</ul><p>{w(64)}</p><p>{w(57)}</p>", [0] * 3 + [1, 1]),
    (f"<body><div><a href='/s'>{w(7)}</a></div><div>{w(83)}</div><div>{w(50)}</div>", [0, 1, 1]),
    (f"<body><article><p>{w(58)}</p><p><a href='/u'>{w(7)}</a></p><p>{w(66)}</p><nav><a href='/v'>{w(5)}</a></nav></article><p>{w(49)}</p>", [1, 1, 1, 0, 1]),
]
