"""The base patterns of operator 9 against a plain reading of its contract, and on very long runs."""

import random
import re
import time

import pytest

from supplyplan.llm import personal_data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(2 * d, 10)) if k % 2 else d for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


@pytest.mark.parametrize("alphabet", ["ab.@-_%1", "012.", "0123456789 -", "+0123456789 ().-", "a1.@+ -\u0661\u00e9\n"])
def test_random_texts(alphabet):
    r, found = random.Random(alphabet), 0
    for _ in range(20_000):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(45)))
        expected = plain(text)
        assert personal_data.base_spans(text) == expected, text
        found += len(expected)
    assert found > 100


def test_zeros_in_an_address():
    text = "0" * 5000 + ".1.1.1"
    assert ("ip", 0, len(text)) in personal_data.base_spans(text)
    assert personal_data.base_spans("1" * 5000 + ".1.1.1 and 000.0.0.0") == [("ip", 5011, 5020)]


@pytest.mark.parametrize("unit", ["7", "a", "a.", "1.", "1 ", "1-", "+1", "a@", "a@b.", "(", "0"])
def test_a_megabyte_of_one_run(unit):
    text = "@+" + unit * (1_000_000 // len(unit)) + "!"
    began = time.thread_time()
    personal_data.base_spans(text)
    assert time.thread_time() - began < 5
