"""Pages whose classes and forms hold noise words around or within the main text, and pages where they do mark noise."""

from __future__ import annotations

import pytest

from routelens.llm.html_text import extract

TEXT = [f"Sentence {i} of the main text, which is long enough, has commas, and ends here." for i in range(6)]
BODY = "".join(f"<p>{t}</p>" for t in TEXT)
WHOLE = "\n".join(TEXT)


@pytest.mark.parametrize("page", [
    f"<body><form id=aspnetForm><input name=x><article>{BODY}</article><button>Send</button></form></body>",
    f"<body><form action=/x><div>{BODY}</div><select><option>one</option></select></form></body>",
    f'<body><div class="content has-sidebar">{BODY}</div></body>',
    f'<body><div class="newsletter-issue">{BODY}</div></body>',
    f'<body><div id="page" class="widget-area-none banner-on">{BODY}</div></body>',
    f"<body><div class=cookie>We use cookies.<article>{BODY}</article></body>",
    f'<body><div class="modal"><main>{BODY}</main></div></body>',
    f'<body><div class="subscribe">{BODY}</div><div class="footer">small print</div></body>',
    f'<body><fieldset><legend></legend><main>{BODY}</main></fieldset></body>',
    f'<body><dialog open>{BODY}</dialog></body>',
    f'<body><div class="search-results-page">{BODY}</div><form class=search>Find <input></form></body>',
])
def test_wrappers_with_noise_words_are_content(page):
    assert extract(page) == WHOLE


@pytest.mark.parametrize("part,text", [
    ('<section id="related-work"><h2>Related work</h2><p>Others, too, wrote on it.</p></section>', "Related work\nOthers, too, wrote on it."), ('<table class="share-price"><tr><td>Price</td><td>12.50</td></tr></table>', "Price\n12.50"),
    ('<p class="ad-hoc">An ad hoc remark.</p>', "An ad hoc remark."), ('<p>Call <code class="search">find()</code> now.</p>', "Call find() now."), ('<p>See <span class="banner">this</span> here.</p>', "See this here."), ('<div class="no-comments-here"><p>Words, words.</p></div>', "Words, words."),
])
def test_parts_of_articles_stay(part, text):
    assert extract(f"<body><article>{BODY}{part}</article></body>") == f"{WHOLE}\n{text}"


@pytest.mark.parametrize("noise", [
    '<div class="related-posts"><a href=x>Another story</a></div>', '<div class="comments"><p>First! I agree, mostly, with this.</p></div>', '<div class="share-buttons">Share</div>', '<div class="cookie-notice"><p>We use cookies, as all do.</p></div>',
    '<form><label>Mail</label><input></form>', '<div class="newsletter-signup"><p>Get it, weekly.</p></div>', '<div class="ad-slot">Buy now, please.</div>', '<div class="top-stories-sidebar-x"><a href=1>One</a> <a href=2>Two</a></div>', '<nav>Menu</nav>', '<div hidden>secret</div>', '<div class="sidebar">Beside.</div>',
])
def test_noise_goes_within_and_beside(noise):
    assert extract(f"<body><article>{BODY}{noise}</article></body>") == WHOLE
    assert extract(f"<body><div id=main-text>{BODY}</div>{noise}</body>") == WHOLE
    assert extract(f"<body>{noise}<main>{BODY}</main></body>") == WHOLE


def test_long_comments_and_deep_marks():
    comments = "".join(f"<p>Reader {i} says, with many words, that this is so.</p>" for i in range(60))
    assert extract(f"<body><div class=post>{BODY}</div><div class=comments>{comments}</div></body>") == WHOLE
    assert extract(f"<body><article>{BODY}</article><section id=comments>{comments}</section></body>") == WHOLE
    deep = '<div class="widget">' * 20_000
    assert extract(f"<body>{deep}{BODY}") == WHOLE
