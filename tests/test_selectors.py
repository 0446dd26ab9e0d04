"""Selectors by type, negation's opposite, emptiness and case flags."""

import pytest

from tarnweb.operators import selectors

HTML = '<div id=r><p id=a></p><b id=b>x</b><p id=c class="K">y<i id=d></i></p><b id=e lang="EN"></b><p id=f> </p></div>'


@pytest.mark.parametrize(
    "selector, ids",
    [("p:first-of-type", "a"), ("p:last-of-type", "f"), ("b:nth-of-type(2)", "e"), ("p:nth-of-type(2n+1)", "af"), ("p:nth-last-of-type(1)", "f"), ("div > :nth-last-child(2)", "e"), ("i:only-of-type", "d"), ("i:only-child", "d"), ("b:only-of-type", ""),
     (":is(b, i)", "bde"), ("p:where(.K, #f)", "cf"), ("div :not(:is(p, b))", "d"), (":empty", "ade"), ("p:empty", "a"), (":root", "r"), ("[lang=en i]", "e"), ("[lang='en' I]", "e"), ("[lang=en]", ""), ("[lang=EN s]", "e"), ("[id^=C i]", "c"), ("[class]", "c")],
)
def test_selectors(selector, ids):
    chains = selectors.compile_selector(selector)
    assert "".join(n.attrs["id"] for n in selectors._Tree(HTML).nodes if any(selectors.selects(c, n) for c in chains)) == ids


@pytest.mark.parametrize("selector", [":nth-of-type()", ":first-of-type(1)", ":is()", ":has(a)", "p:first-of-kind", "[a=b x]", ":empty(1)"])
def test_refused(selector):
    with pytest.raises(ValueError):
        selectors.compile_selector(selector)
