"""Values of names in secret scans, however long the value or its name is."""

import random
import string

import pytest

from firmaforge.llm import secrets


def spans(text):
    base = secrets.base_spans(text)
    novel = secrets.Novelty(b"password = token = ").spans(text, base, secrets.NOVELTY)
    return sorted((a, b) for a, _, b in [*base, *novel])


@pytest.mark.parametrize("n", [20, 500, 600, 900, 20_000])
def test_quoted_values_of_any_length(n):
    rng = random.Random(n)
    value = "".join(rng.choices(string.ascii_letters + string.digits + "!#$%&()*+,-./:;<=>?@[]^_{|}~", k=n))
    text = f'x = 1\nmy_password = "{value}"\ny = 2'
    at = text.index(value)
    covered = set()
    for a, b in spans(text):
        covered |= set(range(a, b))
    assert set(range(at, at + n)) <= covered


@pytest.mark.parametrize(
    "text", ["https://host.example/x?sig=9fA3kQ02LmZx81PqRt77", 'sig = "9fA3kQ02LmZx81PqRt77"', "a" * 300 + '_secret : "9fA3kQ02LmZx81PqRt77"']
)
def test_names_of_any_length(text):
    at = text.index("9fA3")
    assert any(a <= at and b >= at + 20 for a, b in spans(text))


def test_other_names_are_no_secrets():
    assert spans('writer = "9fA3kQ02LmZx81PqRt77"\nsignal = "9fA3kQ02LmZx81PqRt77"') == []
    assert secrets.name_before("= x", 0) == "" and secrets.name_before('9.key" =', 7) == "key"
    assert spans('password="' + "a" * 100_000 + "\n" + "=" * 100_000 + "\n" + "key=" * 20_000)[0] == (0, 100_010)
