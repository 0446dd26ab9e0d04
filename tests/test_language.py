import itertools
import random

import pytest

from tarnweb.operators.selectors import compile_selector
from tarnweb.plans.language import fold, is_simple, label_at, lex
from tarnweb.plans.options import SiteContext, parse_flags
from tarnweb.functions.fuzzy import fuzzy_match
from tarnweb.functions.text import cut_off, preview
from tarnweb.sources.outputs import file_name


def value(text, labels):
    return fold(lex(text).tokens, labels.__contains__, lambda a: not a, lambda a, b: a and b, lambda a, b: a or b)


@pytest.mark.parametrize("text", ["link", "!link", "not link", "a & b", "a&&b", "a and b", "a + b", "a, b", "a || b or c", "(a)", "!(a | b) & c", "notFound", "http-httpsError", "and", "not not"])
def test_valid(text):
    assert lex(text).valid


@pytest.mark.parametrize("text", ["", "!!a", "a b", "a &", "()", "link-", "(a", "a)", "& a", "a # b"])
def test_invalid(text):
    assert not lex(text).valid and lex(text).errors


def test_known_expression():
    assert value("(A|B)&!(C|!D)", {"A", "B", "D"}) is True
    assert value("a&b|c", {"c"}) and not value("a&(b|c)", {"c"})


def test_same_as_python():
    rng = random.Random(5)
    for _ in range(100):
        text = " | ".join(" & ".join(rng.choice(["", "!"]) + rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 3)))
        for n in range(4):
            for chosen in itertools.combinations("abc", n):
                python = text.replace("!", " not ").replace("|", " or ").replace("&", " and ")
                assert value(text, set(chosen)) == eval(python, {}, {c: c in chosen for c in "abc"})


def test_helpers():
    assert is_simple("link") and not is_simple("(link)")
    assert label_at("internal & anchor", 12) == "anchor"
    o = parse_flags("-ignorerobots.txt -onePg -disallow'/a , /b' -select\"nav > a\"")
    assert o.ignore_robots and not o.recursive and o.disallow == ("/a", "/b") and o.selector == "nav > a"
    with pytest.raises(ValueError):
        parse_flags("-select'a:hover'")
    with pytest.raises(ValueError):
        compile_selector("a,,b")
    assert SiteContext.of("https://X.Test:8/a").hostname == "x.test"
    assert fuzzy_match("alt", "noAltText").insertions == 6 and fuzzy_match("", "x").error == -1 and fuzzy_match("zz", "alt").error == -3 and fuzzy_match("abcd", "abc").error == -2
    assert cut_off("ab cd", 9, " ") == "ab cd" and cut_off("ab cd", 3, " ") == "ab" and cut_off("abcd", 2, " ") == ""
    assert preview("x\n" * 4000).endswith("\n...")
    assert file_name("www.a.test", "a|b&c", True) == "a.test_aorbandc_(INCOMPLETE).json"


def test_flag_borders():
    o = parse_flags("-onePagesomething -ignoreRobotsTxtX -disallow''")
    assert o.recursive and not o.ignore_robots and o.disallow == ()
    for name in ("-CSS_Select", "-_select", "-Selecter", "-css-selector"):
        assert parse_flags(f"{name} 'nav'").selector == "nav"
