"""Words of class and id don't take the main text away."""

from tessera.llm.html_text import page_text


def test_names_spare_the_main_text():
    body = '<article><h2 id="discussion">Head</h2><section id="related-work"><p class="legal">Text</p></section><h3 id="search">End</h3><div class="comments">Nice!</div></article>'
    for wrap in ('<div class="page has-sidebar">', '<div id="wrap" class="with-comments">', '<div class="sidebar">', '<div class="side"><div>'):
        assert page_text(f'<body>{wrap}{body}</div></body>') == "Head\nText\nEnd", wrap
    assert page_text('<body><div class="page has-sidebar"><p>Kept</p><div class="ad-box">Buy</div></div></body>') == "Kept"
    assert page_text(f"<body><nav>{body}</nav><p>x</p></body>") == "x"
