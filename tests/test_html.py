"""Pages that leave elements open."""

from dossierspark.sources.blocks import html_blocks_of


def test_open_head_and_nav():
    said = lambda h: [b["text"] for b in html_blocks_of(h)]
    assert said("<head><title>T</title><body><h1>A</h1><p>b") == ["A", "b"]
    assert said("<head><title>T</title><style>x{}</style><h1>A</h1><p>b</p>") == ["A", "b"]
    assert said("<head><noscript><img src=x>no</noscript><title>T</title></head><p>b</p>") == ["b"]
    assert said("<body><div><nav><a>menu</a></div><h1>A</h1><p>b</p></body>") == ["A", "b"]
    assert said("<div><nav><ul><li>one<li>two</ul><p>menu</p></nav><p>b</p></div>") == ["b"]
    assert said("<p>a<nav>menu</p>more</nav><p>b</p>") == ["a", "b"]
