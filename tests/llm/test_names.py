"""Names in every form that the docstring states: none stays in clear, and nothing else is taken."""

from __future__ import annotations

import itertools
import unicodedata

import pytest

from quillon.llm import pii

MADE = pii.Surrogates(b"secret")
NAMES = ["Anna Maria Luisa Smith", "John F. Kennedy", "J. Smith", "J.R.R. Tolkien", "van der Berg", "Juan de la Cruz y Vega", "Ludwig von Beethoven", "O’Neill", "Jean-Luc Picard", "Müller-Lüdenscheidt", "Łukasz Štěpánek", "Åse Øst", "Éloïse d'Artagnan", "Ioan al Rashid"]
OTHERS = ["王小明", "שרה כהן", "محمد علي", "김철수", "გიორგი ბერიძე", "राम शर्मा", "สมชาย", "Արամ Պետրոսյան", "Иван Петрович Сидоров", "Γιώργος Παπαδόπουλος"]
BEFORE = ["Mr. ", "Mrs. ", "Dr ", "Mr.  ", "Ms.\n", "Frau Dr. ", "Herr Professor Dr. ", "my name is ", "Mr President "]
PLANTED = [(b, n) for b, n in itertools.product(BEFORE, NAMES + OTHERS)]


def parts(name):
    return [w for w in name.replace("-", "-").split(" ") if len(w.strip(".")) > 1 and "." not in w and w not in pii.PARTICLES]


@pytest.mark.parametrize("before", BEFORE)
def test_no_part_of_a_planted_name_stays(before):
    assert len(PLANTED) >= 200
    for name in NAMES + OTHERS:
        text = f"Today {before}{name}, it was said, came. {name}; and so on."
        out, counts = MADE.rewrite(text)
        for word in parts(name):
            assert word.removeprefix("d'") not in out, (text, out)
        assert out.startswith(f"Today {before.rstrip()}") and out.endswith("and so on.") and ", it was said, came." in out
        assert counts["name"] >= 2 * len(parts(name)) - 1
        new = {unicodedata.name(c).split(" ")[0] for w in out.split(before, 1)[1].split(",")[0].split() for c in w if c.isalpha()}
        assert new == {unicodedata.name(c).split(" ")[0] for c in name if c.isalpha()}, out


def test_what_is_no_name_stays():
    for text in ["Mr President spoke. President Lincoln was there.", "Mr. Minister, the Minister said", "Nobody is named. The End", "Dr. 42", "Mr. and the rest", "12:30:45 and ::1 and a::b", None, ""]:
        assert MADE.rewrite(text)[0] == text
    out, _ = MADE.rewrite("Mr. Smith\nThe next line. The end.")
    assert out.endswith("\nThe next line. The end.")


def test_mentions_of_a_name_agree():
    out, _ = MADE.rewrite("Mr. Tolkien wrote. TOLKIEN's book and Tolkien’s map. Mrs. J. Tolkien, Smith-Tolkien")
    first = out.split(". ")[1].split(" ")[0]
    assert out.casefold().count(first.casefold()) == 5
    assert pii.Surrogates(b"other").name("Tolkien", "") != MADE.name("Tolkien", "")


def test_initials_stay_apart():
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    made = [MADE.name(c, "") for c in letters]
    assert sorted(made) == sorted(letters) and all(a != b for a, b in zip(made, letters, strict=True))


@pytest.mark.parametrize("text", ["fe80::1ff:fe23:4567:890a", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "fd12:3456:789a::1", "2A00:1450:4001:81B::200E"])
def test_addresses_of_version_6(text):
    import ipaddress

    out, counts = MADE.rewrite(f"from {text}, to")
    new, old = ipaddress.IPv6Address(out[5:-4]), ipaddress.IPv6Address(text)
    assert counts["ip"] == 1 and new != old and (new.is_link_local, int(new) >> 125) == (old.is_link_local, int(old) >> 125)
    assert pii.canonical("ip", text) == pii.canonical("ip", old.compressed) and (text == text.lower()) == (out == out.lower())
    assert MADE.of("ip", old.exploded) == MADE.of("ip", old.exploded)
