"""Label queries: lexer, and compilation to one boolean Column.

A query holds labels, `not !`, `and & && +`, `or | || ,` and parentheses; NOT
binds closest, then AND, then OR. There is no double negation.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Container, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame

ILLEGAL_TOKEN, ILLEGAL_END, UNOPENED, UNCLOSED = "illegal token", "illegal ending", "unmatched closer", "unmatched opener"


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int
    partner: int | None = None
    error: str | None = None


@dataclass
class Lexed:
    valid: bool
    tokens: list[Token]
    errors: list[Token] = field(default_factory=list)


@dataclass(frozen=True)
class Grammar:
    """Token patterns, which kinds may follow which, and how a text may start
    and end. `opens` maps an opener's kind to its closer's; `on_match` may
    rename or refuse (None) a token."""

    patterns: Mapping[str, str]
    follows: Mapping[str, tuple[str, ...]]
    start: tuple[str, ...]
    end: tuple[str, ...]
    skip: str = r"\s+"
    opens: Mapping[str, str] = field(default_factory=dict)
    on_match: Callable[[Token], Token | None] | None = None


OPERAND, OPERATOR = ("not", "label", "open"), ("and", "or", "close")
LABELS = Grammar(
    patterns={
        "not": r"not\b(?!-)|!", "label": r"\b[\w-]+\b", "open": r"\(",
        "and": r"and\b|&&|&|\+", "or": r"or\b|\|\||\||,", "close": r"\)",
    },
    follows={"label": OPERATOR, "not": ("label", "open"), "and": OPERAND, "or": OPERAND, "open": OPERAND, "close": OPERATOR},
    start=OPERAND,
    end=("label", "close"),
    opens={"open": "close"},
)


def lex(text: str, grammar: Grammar = LABELS) -> Lexed:
    """Tokens of a text. After an error the other kinds are tried and reading
    goes on, so all errors are reported."""
    tokens: list[Token] = []
    errors: list[Token] = []
    opened: list[int] = []
    closers = {c: o for o, c in grammar.opens.items()}
    at, allowed = 0, grammar.start
    while at < len(text):
        skipped = re.compile(grammar.skip).match(text, at)
        if skipped and skipped.end() > at:
            at = skipped.end()
            continue
        token = next(
            (Token(k, m[0], at, m.end()) for k in [*allowed, *[k for k in grammar.patterns if k not in allowed]] if (m := re.compile(grammar.patterns[k]).match(text, at)) and m[0]),
            None,
        )
        if token and grammar.on_match:
            token = grammar.on_match(token)
        if token is None:
            errors.append(Token("unknown", text[at], at, at + 1, error=ILLEGAL_TOKEN))
            at += 1
            continue
        if token.kind not in allowed:
            token.error = ILLEGAL_TOKEN
        if token.kind in grammar.opens:
            opened.append(len(tokens))
        elif token.kind in closers:
            if opened:
                token.partner = opened.pop()
                tokens[token.partner].partner = len(tokens)
            else:
                token.error = token.error or UNOPENED
        if token.error:
            errors.append(token)
        tokens.append(token)
        at, allowed = token.end, grammar.follows[token.kind]
    for i in opened:
        tokens[i].error = UNCLOSED
        errors.append(tokens[i])
    if not tokens:
        errors.append(Token("end", "", 0, 0, error=ILLEGAL_END))
    elif tokens[-1].kind not in grammar.end:
        errors.append(Token("end", "", at, at, error=ILLEGAL_END))
    return Lexed(not errors, tokens, errors)


def label_at(text: str, place: int) -> str | None:
    """The label that a place of a query text lies in or next to."""
    return next((t.text for t in lex(text).tokens if t.kind == "label" and t.start <= place <= t.end), None)


def fold(tokens: list[Token], leaf: Callable[[str], object], neg, conj, disj) -> object:
    """Value of valid tokens in any algebra: columns, sets, booleans."""
    terms: list[list] = [[]]
    negate = False
    i = 0
    while i < len(tokens):
        t = tokens[i]
        if t.kind == "or":
            terms.append([])
        elif t.kind == "not":
            negate = True
        elif t.kind in ("label", "open"):
            if t.kind == "open":
                close = _closing(tokens, i)
                value = fold(tokens[i + 1 : close], leaf, neg, conj, disj)
                i = close
            else:
                value = leaf(t.text)
            terms[-1].append(neg(value) if negate else value)
            negate = False
        i += 1
    return reduce(disj, [reduce(conj, group) for group in terms])


def _closing(tokens: list[Token], opener: int) -> int:
    depth = 0
    for i in range(opener, len(tokens)):
        depth += (tokens[i].kind == "open") - (tokens[i].kind == "close")
        if not depth:
            return i
    raise ValueError("unmatched opener")


def compile_query(tokens: list[Token], flag: Callable[[str], Column]) -> Column:
    return fold(tokens, flag, lambda a: ~a, lambda a, b: a & b, lambda a, b: a | b)


def run_query(records: DataFrame, text: str, labels: Container[str], flag: Callable[[str], Column]) -> DataFrame | None:
    """Records that match, or None for an invalid query or an unknown label.

    labels: the known names; flag: the predicate of a label. A query of one
    token is looked up by its raw text, so outer white space makes it unknown."""
    lexed = lex(text)
    if not lexed.valid:
        return None
    if len(lexed.tokens) == 1:
        return records.where(flag(text)) if text in labels else None
    if any(t.kind == "label" and t.text not in labels for t in lexed.tokens):
        return None
    return records.where(compile_query(lexed.tokens, flag))


def is_simple(text: str) -> bool:
    """Whether a query is one bare label, which shapes its results."""
    return len(lex(text).tokens) == 1
