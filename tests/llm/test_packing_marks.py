"""The tokeniser's shortcut against the tokenizer on texts in every Unicode form."""

import random
import unicodedata

import pytest

from trellis.llm.packing import WordIds
from trellis.llm.queries import tokenizer_path

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEéàüñçß"


@pytest.fixture(scope="module")
def words():
    w = WordIds(tokenizer_path())
    assert w.by_word
    return w


@pytest.mark.parametrize("text", ["café", "città", "voilà", "naïve,", "Le café, la voilà. È (così)!"])
def test_decomposed_accents(words, text):
    for form in ("NFC", "NFD"):
        t = unicodedata.normalize(form, text)
        assert words._joined(t) == words._whole(t)


def test_random_unicode(words):
    rng = random.Random(1)
    chars = [chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x11000), *range(0x1D100, 0x1F700))]
    marks = [c for c in chars if unicodedata.category(c)[0] == "M"]
    for k in range(30_000):
        t = ""
        for _ in range(rng.randrange(1, 6)):
            t += "".join(rng.choice(LETTERS) for _ in range(rng.randrange(4)))
            t += rng.choice(rng.choice((marks, "̧̀́̂̃̈", chars, " .,;!?'’-\n")))
        t = unicodedata.normalize("NFD", t) if k % 3 == 0 else t
        assert "<|" in t or words._joined(t) == words._whole(t), ascii(t)


def test_every_letter_before_a_stop_and_a_comma(words):
    bad = [hex(c) for c in (*range(0x41, 0xD800), *range(0xE000, 0x20000)) if chr(c).isalpha()
           for t in (f"a{chr(c)}.", f"{chr(c)}, b", f"x {chr(c)}.") if words._joined(t) != words._whole(t)]
    assert bad == []


@pytest.mark.parametrize("text", ["TEKLİFİ. son", "BÜYÜKŞEHİRLERİ, ve", "बड़, और", "बड़. x", "ড়, এ", "शब्द."])
def test_words_whose_last_letter_is_composed(words, text):
    for form in ("NFC", "NFD"):
        t = unicodedata.normalize(form, text)
        assert words._joined(t) == words._whole(t)
