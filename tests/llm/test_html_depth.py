"""End tags find their start at any depth."""

from tidewake.llm import html_text


def test_end_tag_beyond_many_unclosed_elements():
    words = "The article after a long menu tells in many plain words what happened that day and why it mattered."
    page = f"<body><nav>{'<p><b>item' * 300}</nav><article><p>{words}</p></article></body>"
    assert html_text.main_text(page) == words
    inner = f"<body><article><p>{words}</p>{'<div><font>' * 300}</article><footer><p>All rights reserved.</p></footer></body>"
    assert html_text.main_text(inner) == words


def test_many_lone_brackets_take_linear_time():
    import time

    began = time.time()
    for text in ("< " * 2_000_000 + ">", "< " * 2_000_000, "<<" * 1_000_000 + "><p>last one", "1 < 2 > 0 " * 100_000):
        html_text.blocks(text)
    assert time.time() - began < 60
    (one,) = html_text.blocks("<p>1 < 2 and 3 > 2 < 4</p>")
    assert one.text == "1 < 2 and 3 > 2 < 4"
