import unicodedata

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import text as X


def test_skeleton_forms():
    assert X.skeleton("ＡＸＵ－9417") == "AXU-9417"
    assert X.skeleton("Т" + "A" + "Μ83777") == "TAM83777"
    assert X.skeleton("β-무도") == "β-무도"
    assert X.skeleton("a​b c") == "ab c"
    assert X.skeleton("a　b") != X.skeleton("a b")
    assert X.skeleton(unicodedata.normalize("NFD", "안심 보험é")) == "안심 보험é"
    assert X.skeleton("①") == "①" and X.skeleton("Ab") != X.skeleton("ab") and X.skeleton("a  b") != X.skeleton("a b")
    assert X.skeleton(None) == "" == X.skeleton("")
    assert X.skeleton("λόγος") == "λόγος"


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_skeleton_is_stable(s):
    assert X.skeleton(X.skeleton(s)) == X.skeleton(s)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abc가나😀", max_size=12), max_size=8), st.integers(2, 5))
def test_grams_match_plain_slices(texts, n):
    g, starts = X.grams(texts, n)
    for i, s in enumerate(texts):
        want = [s[j : j + n] for j in range(len(s) - n + 1)]
        mine = g[starts[i] : starts[i + 1]]
        assert len(mine) == len(want)
        assert len(set(want)) == len(set(mine.tolist()))
    assert starts[-1] == len(g)


def test_min_hashes_estimate_likeness():
    r = np.random.default_rng(1)
    a = "".join(map(chr, r.integers(0xAC00, 0xB000, 400)))
    b = a[:320] + "".join(map(chr, r.integers(0xAC00, 0xB000, 80)))
    h = X.min_hashes([a, b, ""], 2000)
    assert abs((h[0] == h[1]).mean() - X.likeness(X.gram_set(a), X.gram_set(b))) < 0.05
    assert not h[2].any()
    assert X.likeness([], []) == 0.0


def test_skeleton_covers_type_faces_and_alphabets():
    for look, plain in (("𝐀bc", "Abc"), ("ɑbc", "abc"), ("Ꭺbc", "Abc"), ("ﬁnd", "find"), ("𝟙2", "12"), ("pαy", "pay"), ("β-pаy", "β-pay"), ("бraсe", "бrace")):
        assert X.skeleton(look) == plain, look
    for own in ("①", "²", "α", "мир", "αβγ", "Ꮓ", "㎏"):
        assert X.skeleton(own) == own, own
