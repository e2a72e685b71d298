import random
import re
import string

import pytest

from panelweave.llm.pii import IBAN, LEAST, find, mod97


def with_checksum(country, account):
    turned = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{country}{98 - int(turned) % 97:02d}{account}"


def test_bank_accounts_by_brute_force():
    random.seed(6)
    for _ in range(400):
        code = with_checksum(random.choice(["DE", "FR", "ES", "GB"]), "".join(random.choices(string.digits + "ABC", k=random.choice([12, 16, 18, 20]))))
        if random.random() < 0.5:
            code = code[:-1] + random.choice(string.digits)
        spaced = " ".join(code[i : i + 4] for i in range(0, len(code), 4)) if random.random() < 0.5 else code
        text = f"to {spaced}, please"
        # Every start and end is tried: what is an account, is found, and nothing else is.
        want = {
            (i, j) for i in range(len(text)) for j in range(i + 15, len(text) + 1)
            if (m := IBAN.match(text, i)) and m.end() == j and mod97(text[i:j].replace(" ", ""))
        }
        assert {(r["start"], r["end"]) for r in find(text) if r["kind"] == "iban"} == want
        assert bool(want) == (int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1)


@pytest.mark.parametrize("near", ["social security", "Ausweis", "numéro de sécurité", "identidad", "SSN:"])
def test_identity_numbers_need_a_word_nearby(near):
    assert [r["kind"] for r in find(f"{near} 123-45-6789 .")] == ["id_number"]
    assert find("it is 123-45-6789 .") == [] == find(f"{near} 0123-45-6789") == find(f"{near} " + "x" * 60 + " 123-45-6789")


@pytest.mark.parametrize("text", ["call {}", "Telefon {}", "Téléphone : {}", "Teléfono {}"])
def test_words_of_four_languages_count(text):
    number = "+49 30 1234567"
    (plain,), (near,) = find(f"so {number}"), find(text.format(number))
    assert near["score"] == pytest.approx(plain["score"] + 0.2) and near["score"] >= LEAST
    doubted = find(f"Beispiel {number}")[0]
    assert doubted["score"] == pytest.approx(plain["score"] - 0.2) and re.match(r"\+", number)
