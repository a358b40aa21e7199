"""Look-alike letters of every script in the table, and what must stay apart."""

import unicodedata

import pytest

from palimpsest.llm import confusables as C


@pytest.mark.parametrize("letter", sorted(C.LOOK_ALIKES))
def test_every_letter_takes_its_latin_shape(letter):
    assert C.skeleton(f"x{letter}y") == f"x{C.LOOK_ALIKES[letter]}y"


def test_scripts_covered():
    scripts = {unicodedata.name(c).split()[0] for c in C.LOOK_ALIKES}
    assert {"GREEK", "CYRILLIC", "ARMENIAN", "CHEROKEE", "COPTIC", "LISU", "CANADIAN", "HEBREW", "MALAYALAM", "TIFINAGH"} <= scripts


def test_case_is_kept_apart():
    for letter, latin in C.LOOK_ALIKES.items():
        if latin.isalpha() and unicodedata.category(letter) in ("Lu", "Ll") and "SMALL CAPITAL" not in unicodedata.name(letter):
            assert C.skeleton(latin.swapcase()) != C.skeleton(letter)
