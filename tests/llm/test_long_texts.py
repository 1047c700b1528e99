"""Features of texts of any length."""

import random
import re
import time

from quillon.llm import html_text, toxicity


def test_capitals_and_second_person_are_counted_in_every_text():
    lex = toxicity.Lexicon({}, {})
    at = toxicity.FEATURES.index
    got = toxicity.features("SHOUT É " * 40_000, lex)
    assert got[at("capitals")] == 6 / 8 and got[at("all_caps")] == 1.0
    assert toxicity.features("are you here now", lex)[at("you_density")] == 0.25
    text = "aÉǅßЖ漢Zz\x00" * 3
    assert toxicity._capitals(text) == sum(map(str.isupper, text))


def timed(f):
    t = time.perf_counter()
    out = f()
    return out, time.perf_counter() - t


def test_a_run_of_a_million_letters_is_read_once():
    lex = toxicity.Lexicon({}, {})
    for text in ("x" * 1_000_000, "é" * 1_000_000, "a1" * 500_000, "a" + "1" * 1_000_000, "ab#" * 300_000):
        got, took = timed(lambda t=text: toxicity.features(t, lex))
        assert took < 10 and all(v == v for v in got)
    old = re.compile(r"[^\W\d_]+[*@$#0-9][^\W_]*[^\W\d_]")
    rng = random.Random(3)
    for _ in range(4000):
        t = "".join(rng.choice("ab1#_ é²@") for _ in range(rng.randrange(24)))
        assert toxicity._HIDDEN.findall(t) == old.findall(t), t


def test_unclosed_tags_are_read_once():
    n = 100_000
    for text, want in (
        ("<b>" * n + "<p></p>" * n + "x", ["x"]),
        ("<b>" * n + "</i>" * n + "x", ["x"]),
        ("<div>" * n + "x" + "</p>" * n, ["x"]),
        ("<li><b>x" * n, ["x"] * n),
        ("<a b='" * n + ">x", None),
        ("<p class=\"q\" " * n, None),
        ("<" * n, None),
    ):
        got, took = timed(lambda t=text: html_text.blocks(t))
        assert took < 20
        assert want is None or [t for t, *_ in got] == want
    got, took = timed(lambda: html_text.blocks("<article>" + "<p>some words of it</p>" * 2_200_000 + "</article>"))  # 50 MB
    assert len(got) == 2_200_000 and took < 90


def test_blocks_match_a_plain_stack():
    """The nearest open element of a name, and the nearest open block, as a scan of the whole stack finds them."""
    rng = random.Random(7)
    for _ in range(1500):
        s, stack, want = "", [], []
        for k in range(rng.randrange(30)):
            name = rng.choice(["b", "i", "p", "li", "div", "td", "article", "span"])
            if rng.random() < 0.4:
                s += f"</{name}>"
                at = max((i for i, x in enumerate(stack) if x == name), default=None)
                if at is not None and (name in html_text.BLOCK or not any(x in html_text.BLOCK for x in stack[at:])):
                    del stack[at:]
            else:
                s += f"<{name}>"
                if name in html_text.BLOCK:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i] == "p" or stack[i] == name and name in ("li", "td"):
                            del stack[i:]
                            break
                        if stack[i] in html_text.BLOCK:
                            break
                stack.append(name)
            s += f"<wbr>w{k} "
            want.append((f"w{k}", "article" in stack))
        got = [(w, inside) for t, inside, _ in html_text.blocks(s) for w in t.split()]
        assert got == want, s
