"""Pages that the tree wasn't fitted on; a mark stands before each main block."""

from tidewake.llm import html_text

MARK = html_text.MAIN
A = "The harbour master said on Tuesday that the spill had been contained within hours and that no birds were found."
B = "Residents along the coast had seen a dark film on the water since Sunday morning, but nobody called the office."
C = "It will be cleaned."
#: § marks a main block.
PAGES = (
    f"<body><div class='navbar'><a href='/'>Home</a><a href='/n'>News</a></div><div class='post'><h1>§Spill contained</h1><p>§{A}</p><p>§{B}</p></div><div class='sidebar'><h3>Most read</h3><p>{B}</p></div></body>",
    f"<body><article><h1>§Spill</h1><p>§{A}</p><aside><h4>Background</h4><p>{B}</p></aside><p>§{B}</p><footer>Filed under harbour, written by the desk</footer></article></body>",
    f"<body><h1>§Short news</h1><p>§{C}</p><p>§{A}</p></body>",
    f"<body><p>§{C}</p></body>",
    f"<body><main><p>§{A}</p><form><label>Your mail</label><input><p>Get our letter each morning in your inbox for free.</p></form><p>§{B}</p></main></body>",
    f"<body class='no-sidebar'><div id='page'><header class='site-header'><p>The Coast Daily, since 1901</p></header><div class='entry-content'><p>§{A}</p><p>§{C}</p></div></div><footer><p>All rights reserved by The Coast Daily</p></footer></body>",
    f"<body><article class='hentry tags-coast'><header class='entry-header'><h1>§A headline of some words</h1></header><p>§{A}</p><ul><li>§oil booms</li><li>§two boats</li></ul></article><section id='comments'><h2>3 comments</h2><p>{B}</p></section></body>",
    f"<body><div id='respond'><p>{A}</p></div><div><h2>§Heading</h2><p>§{B}</p></div></body>",
    f"<body><ul class='breadcrumb'><li><a href='/'>Home</a></li><li>Coast</li></ul><h1>§Oil on the beach</h1><p>§{A}</p><div class='pagination'><a href='/2'>2</a> of 7</div></body>",
    f"<body><table><tr><td><a href='/a'>Start</a><br><a href='/b'>Archive</a></td><td><h1>§Old page</h1><p>§{A}</p><p>§{B}</p></td></tr></table></body>",
    f"<body><div class='cookieConsent'><p>We and our partners store data on your device.</p></div><article><p>§{A}</p></article></body>",
    f"<body><article><p>§{A}</p><p>§<a href='/pdf'>Full report of the harbour office as a file</a></p><p>§{B}</p></article></body>",
    f"<body><nav><p>Sections of this site are listed here</p></nav><section><p>§{A}</p><blockquote>§We saw it first.</blockquote><p>§{C}</p></section><div role='complementary'><p>{B}</p></div></body>",
    f"<body><div aria-label='advertisement'><p>Cheap flights to the sea, book today and save.</p></div><div><p>§{A}</p><pre>§wind 5 m/s</pre></div></body>",
    f"<body><dl><dt>§Place</dt><dd>§The old harbour</dd><dt>§Amount</dt><dd>§Two barrels</dd></dl><p>§{B}</p><menu><li>Print</li><li>Save</li></menu></body>",
    f"<body><main><article><h1>§Title</h1><p>§{A}</p></article><section class='related-articles'><h2>More like this</h2><article><h3>Other story</h3><p>{B}</p></article></section></main></body>",
    f"<body><div class='widget'><p>{A}</p></div><div class='story'><p>§{B}</p><div class='share-buttons'>Share this story with your friends</div><p>§{C}</p></div></body>",
    f"<body><p>§{A}</p><p>See also <a href='/1'>the first story</a>, <a href='/2'>the second story</a>, <a href='/3'>the third</a></p><p>§{B}</p></body>",
    f"<body><noscript>Turn on scripts please</noscript><div hidden><p>{B}</p></div><div style='display: none'>{A}</div><h1>§News</h1><p>§{A}</p><button>More</button></body>",
    f"<body><fieldset><legend>Login</legend><p>Name and password please</p></fieldset><article>§{A}<br>{C}<h2>§Then</h2>§{B}</article></body>",
    f"<body><article><h1>§Live</h1><p>§{A}</p><section class='discussion'><ol class='commentlist'><li>{B}</li><li>{C}</li></ol></section></article></body>",
    f"<body><div class='promo-box'>{B}</div><main><h1>§T</h1><h2>§Sub</h2><p>§{A}</p><figure><img src='x'><figcaption>§The harbour at dawn</figcaption></figure></main><div id='footer'>{C}</div></body>",
    f"<body><div>Skip to content</div><article><p>§{A}</p></article><div>Powered by a blog engine</div></body>",
    f"<body><header><h1>The Coast Daily</h1></header><p>§{A}</p><p>§{B}</p><p>Copyright 2020 The Coast Daily</p></body>",
)


def measured() -> tuple[int, int, int]:
    right = kept = main = 0
    for page in PAGES:
        page = page.replace("§", MARK)
        model = html_text.tree()
        for b, plain in zip(html_text.blocks(page), html_text.blocks(page.replace(MARK, "")), strict=True):
            keep, wanted = html_text.keeps(model, plain.row), MARK in b.text
            right, kept, main = right + (keep and wanted), kept + keep, main + wanted
    return right, kept, main


def test_unseen_pages():
    right, kept, main = measured()
    assert right / kept >= 0.9 and right / main >= 0.95


def test_fitted_pages():
    for page in html_text.LABELLED:
        want = [b.text[1:] for b in html_text.blocks(page) if b.text.startswith(MARK)]
        assert html_text.main_text(page.replace(MARK, "")).split("\n\n") == want


def test_boilerplate_within_articles_and_pages_without_one():
    assert html_text.main_text(f"<article><p>{A}</p><aside>{B}</aside><form>{B}</form><footer>{C}</footer></article>") == A
    assert html_text.main_text(f"<p>{C}</p><p>{A}</p><footer>{B}</footer>") == f"{C}\n\n{A}"
    assert html_text.main_text(f"<article class='post tags-list'><p>{A}</p></article>") == A
    assert [b.density for b in html_text.blocks("<a>One</a><a>Two</a>")] == [1.0]


def test_very_long_pages():
    page = "<div>" * 50_000 + f"<p>{A}</p>" * 2_000 + "<a href='" + "x" * 1_000_000
    assert html_text.main_text(page).startswith(f"{A}\n\n{A}")
