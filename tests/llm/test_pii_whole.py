"""Personal data that validation used to leave in clear."""

import re

import pytest

from termsieve.llm import pii

KEY = b"k"


@pytest.mark.parametrize("text", ["+1 (017) 555-7713", "+1 (132) 555-1352", "(212) 055-1234", "+10175557713", "012-345-6789", "1 999 199 9999"])
def test_phones_that_cannot_be_assigned(text):
    out, spans = pii.pseudonymized(f"call {text}, ok", KEY)
    assert text not in out and spans == [("phone", 5, 5 + len(text))]
    assert re.sub("[0-9]", "9", out) == re.sub("[0-9]", "9", f"call {text}, ok")
    d = re.sub("[^0-9]", "", out)[-10:]
    assert d[0] < "2" or d[3] < "2"
    # However it is written, an equal number gets an equal pseudonym.
    plain = re.sub("[^0-9]", "", text)[-10:]
    assert re.sub("[^0-9]", "", pii.pseudonymized(f"+1{plain}", KEY)[0])[-10:] == d


def test_unassigned_phones_keep_apart():
    numbers = {f"{a:03d}{e:03d}{n:04d}" for a in (0, 199, 200, 999) for e in (0, 199) for n in range(50)}
    new = {pii._unassigned(d, KEY) for d in numbers}
    assert len(new) == len(numbers) and all(len(d) == 10 and (d[0] < "2" or d[3] < "2") for d in new)


@pytest.mark.parametrize("value, tail", [("4111 1111 1111 1111", " 123"), ("4111111111111111", " 12/26"), ("4111-1111-1111-1111", "-123"),
                                         ("4111-1111-1111-1111", "-12345"), ("4111 1111 1111 1111", " 12 26 123"), ("378282246310005", " 1234"),
                                         ("DE89370400440532013000", " 2024"), ("BE68 5390 0754 7034", " EUR"), ("DE89 3704 0044 0532 0130 00", " 12")])
def test_digits_after_a_card_or_account(value, tail):
    alone = pii.pseudonymized(value, KEY)[0]
    out, spans = pii.pseudonymized(f"pay {value}{tail}, ok", KEY)
    kind = "iban" if value[0].isalpha() else "card"
    assert alone != value and out == f"pay {alone}{tail}, ok" and spans == [(kind, 4, 4 + len(value))]
