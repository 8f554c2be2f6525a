from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import crowded, prose
from weftline.llm import surrogates

EMAIL = r"[\w.]+@[\w.]+\.example"
IP = r"(?:\d{1,3}\.){3}\d{1,3}"
PHONE = r"\+1 \(\d{3}\) \d{3}-\d{4}"
CARD = r"\b\d{16}\b"
SECRET = r"\b[0-9a-f]{40}\b"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def entities(rng: random.Random) -> list[str]:
    ip = ".".join(str(rng.randint(1, 254)) for _ in range(4))
    card = "4" + "".join(rng.choices("0123456789", k=14))
    card += next(d for d in "0123456789" if luhn(card + d))
    return [
        f"un.{rng.randint(10, 99)}@mail{rng.randint(1, 9)}.shop.com", ip, f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}", card,
        "a" + "".join(rng.choices("0123456789abcdef", k=39)),
    ]


@pytest.fixture(scope="module")
def replaced(make_docs):
    """Texts as lists of pieces, the entities known, and the results."""
    rng = random.Random(71)
    known = [e for _ in range(30) for e in entities(rng)]
    rows = []
    for i in range(200):
        pieces = prose(rng, rng.randint(5, 40)).split()
        for e in rng.sample(known, rng.randint(0, 4)):
            pieces.insert(rng.randint(0, len(pieces)), e if rng.random() < 0.8 else e.upper())
        rows.append((i, pieces))
    out = {r.doc_id: r for r in surrogates.replace_entities(make_docs([(i, " ".join(p)) for i, p in rows]), "secret key").collect()}
    return rows, known, out


def test_everything_is_replaced_in_its_place_and_alike(replaced):
    rows, known, out = replaced
    lower = {e.lower() for e in known}
    kinds = (EMAIL, IP, PHONE, CARD, SECRET)
    news: dict[str, set[str]] = {}
    for i, pieces in rows:
        mentioned = [p for p in pieces if p.lower() in lower]
        any_kind = "((?i:" + "|".join(kinds) + "))"
        m = re.fullmatch(" ".join(any_kind if p.lower() in lower else re.escape(p) for p in pieces), out[i].text)
        assert m, (pieces, out[i].text)
        assert out[i].n_replaced == len(mentioned)
        for old, new in zip(mentioned, m.groups(), strict=True):
            news.setdefault(old.lower(), set()).add(new.lower())
            assert old.isupper() == new.isupper() or not any(c.isalpha() for c in old)
    assert all(len(v) == 1 for v in news.values())  # one surrogate each, everywhere
    values = [next(iter(v)) for v in news.values()]
    assert len(set(values)) == len(values) and not set(values) & lower  # all different, none an original
    for old, new in ((k, next(iter(v))) for k, v in news.items()):
        kind = next(p for p in (EMAIL, IP, PHONE, CARD, SECRET) if re.fullmatch(p, new))
        assert re.fullmatch(kind, old if kind != EMAIL else old.rsplit(".", 1)[0] + ".example")
        if kind == CARD:
            assert luhn(old) and luhn(new)
        if kind == IP:
            assert all(0 <= int(x) <= 255 for x in new.split("."))


def test_addresses_of_one_domain_stay_together(make_docs):
    texts = ["ann.1@deep.shop.com and bob.2@deep.shop.com but cy.3@wide.shop.com"]
    (r,) = surrogates.replace_entities(make_docs([(1, texts[0])])).collect()
    a, b, c = re.findall(r"\S+@(\S+)", r.text)
    assert a == b != c


def test_writings_of_one_number_share_a_surrogate(make_docs):
    (r,) = surrogates.replace_entities(make_docs([(1, "+1 (234) 555-1234 or +1-234-555-1234, card 4111 1111 1111 1111 = 4111111111111111")])).collect()
    numbers = [re.sub(r"\D", "", x) for x in re.findall(r"\+1 \(\d+\) \d+-\d+|\+1-\d+-\d+-\d+|(?:\d{4} ){3}\d{4}|\d{16}", r.text)]
    assert len(numbers) == 4 and numbers[0] == numbers[1] != "12345551234" and numbers[2] == numbers[3] and luhn(numbers[2])


def test_names_keep_gender_script_and_coreference(make_docs):
    text = "Mrs Anna Holloway met John Brown. Later Holloway, I mean Mrs Holloway, left Mr Brown. Иван Петров wrote Ms Brown."
    (r,) = surrogates.replace_entities(make_docs([(1, text)])).collect()
    m = re.fullmatch(r"Mrs (\S+) (\S+) met (\S+) (\S+)\. Later Holloway, I mean Mrs (\S+), left Mr (\S+)\. (\S+) (\S+) wrote Ms (\S+)\.", r.text)
    assert m, r.text
    first, last, he, brown, again, mr, ivan, petrov, ms = m.groups()
    assert first in surrogates.GIVEN["f", "Latin"].split() and he in surrogates.GIVEN["m", "Latin"].split()
    assert ivan in surrogates.GIVEN["m", "Cyrillic"].split() and re.fullmatch(r"[А-Я][а-я]+", petrov)
    assert last == again and brown == mr == ms and len({last, brown, petrov}) == 3 and "Holloway" not in (last, brown)


def test_other_key_other_surrogates(make_docs):
    docs = make_docs([(1, "mail un.12@x.shop.com now")])
    a, b, a2 = (surrogates.replace_entities(docs, k).first().text for k in ("one", "two", "one"))
    assert a == a2 != b


def test_collisions_are_drawn_again(spark):
    """More given names than the list holds, and numbers from a small space: all end different."""
    names = surrogates.GIVEN["m", "Latin"].lower().split()
    rows = [("given", n) for n in names] + [("ssn", f"{i:03d}") for i in range(25)]
    got = surrogates.assign(spark.createDataFrame(rows, "kind string, entity string"), "k").collect()
    assert len(got) == len(rows) == len({(r.kind, r.new) for r in got})
    assert not {(r.kind, r.new) for r in got} & set(rows)


def test_more_surnames_than_four_syllables_can_tell(spark, monkeypatch):
    """With two syllables for each script there are eight names of three; the names grow until all differ."""
    monkeypatch.setattr(surrogates, "SYLLABLES", {k: " ".join(v.split()[:2]) for k, v in surrogates.SYLLABLES.items()})
    rows = [("surname", f"name{chr(97 + i // 26)}{chr(97 + i % 26)}") for i in range(60)]
    got = surrogates.assign(spark.createDataFrame(rows, "kind string, entity string"), "k").collect()
    assert {r.entity for r in got} == {e for _, e in rows} and len({r.new for r in got}) == 60


def test_what_is_left_alone(make_docs):
    for text in ("version 1.2.3 of 300.1.2.3", "in 1999-2004, 12345 times", "a@b", "deadbeef", "12345678901234567890123", "Paris in May", "x1.2.3.4.5", "+12345 points", "4111111111111112", "100 000 000 of 600 000 000"):
        (r,) = surrogates.replace_entities(make_docs([(1, text)])).collect()
        assert (r.text, r.n_replaced) == (text, 0), text


def drawn(kind: str, entity: str, attempt: int, key: str) -> str:
    """The surrogate of a number or an address, character by character."""

    def numbers(*parts):
        text = "".join(hashlib.sha512("\x1f".join((key, kind, *parts, half)).encode()).hexdigest() for half in "ab")
        return [int(text[i : i + 4], 16) for i in range(0, 256, 4)]

    def letters(word, n):
        first = lambda ch: (0x430, 32) if "\u0400" <= ch <= "\u04ff" else (0x4E00, 20_000) if "\u4e00" <= ch <= "\u9fff" else (0x61, 26)
        pick = lambda ch, x: str(x % 10) if ch.isdigit() else chr(first(ch)[0] + x % first(ch)[1]) if ch.isalpha() else ch
        return "".join(pick(ch, n[i % 64]) for i, ch in enumerate(word))

    own = numbers(entity, str(attempt))
    if kind == "email":
        local, domain = entity.split("@")
        host = domain.rsplit(".", 1)[0]
        return f"{letters(local + 'a' * max(0, attempt - 2), own)}@{letters(host, numbers(host))}.example"
    if kind == "ip":
        return f"{own[0] % 223 + 1}.{own[1] % 256}.{own[2] % 256}.{own[3] % 254 + 1}"
    if kind == "secret":
        return "".join(f"{x % 16:x}" for x in own[: len(entity)])
    body = entity[0] + letters(entity[1:] + "0" * max(0, attempt - 5), own)
    return body if kind != "card" else body[:-1] + next(d for d in "0123456789" if luhn(body[:-1] + d))


def placed(entities: set, key: str) -> dict:
    """All surrogates, drawn again until none is shared or an entity itself."""
    new = {e: (0, drawn(*e, 0, key)) for e in entities}
    while True:
        owners: dict = {}
        for (kind, entity), (attempt, value) in new.items():
            owners.setdefault((kind, value), []).append((attempt, entity))
        lost = [(k, e) for (k, v), who in owners.items() for a, e in who if (k, v) in entities or (a, e) != min(who)]
        if not lost:
            return {e: v for e, (_, v) in new.items()}
        for e in lost:
            attempt = new[e][0] + 1
            new[e] = (attempt, drawn(*e, attempt, key))


def test_against_brute_force(make_docs):
    """Whole texts with entities at known places, in several ways of writing, against surrogates computed apart."""
    rng = random.Random(5)
    digits = lambda k: "".join(rng.choices("0123456789", k=k))

    def entity():
        kind = rng.choice(["email", "ip", "phone", "ssn", "secret", "card"])
        if kind == "email":
            local, host = rng.choice(["ann.1", "b", "c", "Bob_Lee", "имя", "王伟"]), rng.choice(["x.com", "Mail.Shop.org", "例子.cn", "почта.ru"])
            return kind, f"{local}@{host}", f"{local}@{host}".lower()
        if kind == "ip":
            ip = ".".join(str(rng.randint(0, 255)) for _ in range(4))
            return kind, ip, ip
        if kind == "phone":
            text = rng.choice([f"+1 (555) {digits(3)}-{digits(4)}", f"+33 1 {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"0171 {digits(7)}", f"+49 (0)30 {digits(6)}"])
            return kind, text, re.sub(r"\D", "", text)
        if kind == "ssn":
            text = f"{digits(3)}-{digits(2)}-{digits(4)}"
            return kind, text, text.replace("-", "")
        if kind == "secret":
            text = "a" + "".join(rng.choices("0123456789abcdef", k=31))
            return kind, text.upper() if rng.random() < 0.3 else text, text
        text = "4" + digits(14)
        text += next(d for d in "0123456789" if luhn(text + d))
        return kind, " ".join(text[i : i + 4] for i in range(0, 16, 4)) if rng.random() < 0.5 else text, text

    known = [entity() for _ in range(80)]
    decoys = ["4111111111111112", "+12345", "v1.2.3", "\x01odd\x02!", "100 000", "a@b"]
    rows = []
    for i in range(120):
        pieces = []
        for _ in range(rng.randint(0, 6)):
            pieces += [prose(rng, rng.randint(1, 6)), rng.choice(known) if rng.random() < 0.8 else rng.choice(decoys), rng.choice([";", " end"])]
        rows.append((i, [p for p in pieces]))
    text = lambda pieces, new: " ".join(new(p) if isinstance(p, tuple) else p for p in pieces)
    used = {(k, e) for _, pieces in rows for p in pieces if isinstance(p, tuple) for k, _, e in [p]}
    news = placed(used, "key")

    def written(p):
        kind, said, entity = p
        value = news[kind, entity]
        if kind in ("phone", "ssn", "card"):
            left = iter(value)
            return "".join(next(left) if c.isdigit() else c for c in said) + "".join(left)
        if said.upper() == said and said.lower() != said:
            return value.upper()
        return "".join(c.upper() if i < len(said) and said[i].isupper() else c for i, c in enumerate(value)) if kind in ("email", "secret") else value

    out = {r.doc_id: r for r in surrogates.replace_entities(make_docs([(i, text(p, lambda p: p[1])) for i, p in rows]), "key").collect()}
    for i, pieces in rows:
        assert (out[i].text, out[i].n_replaced) == (text(pieces, written), sum(isinstance(p, tuple) for p in pieces))


def test_scripts_capitals_hyphens_and_gender(make_docs):
    text = "Mrs Smith-Jones met JOHN SMITH; Анна Иванова, Иван Иванов. Dr Պետրոսյան 王伟@例子.cn Foo.Bar@Site.Com"
    (r,) = surrogates.replace_entities(make_docs([(1, text)])).collect()
    m = re.fullmatch(r"Mrs ([A-Z][a-z]+)-([A-Z][a-z]+) met ([A-Z]+) ([A-Z]+); ([А-Я][а-я]+) ([А-Я][а-я]+)а, ([А-Я][а-я]+) ([А-Я][а-я]+)\. "
                     r"Dr [\u0531-\u0556][\u0561-\u0586]+ [\u4e00-\u9fff]{2}@[\u4e00-\u9fff]{2}\.example [A-Z][a-z]{2}\.[A-Z][a-z]{2}@[A-Z][a-z]{3}\.Example", r.text)  # fmt: skip
    assert m, r.text
    he = m[3].capitalize()
    assert he in surrogates.GIVEN["m", "Latin"].split() and m[6] == m[8] and m[6].endswith("ов") and m[5] in surrogates.GIVEN["f", "Cyrillic"].split()


def test_very_long_entities_and_many_of_them(make_docs):
    """Stack and time stay bounded for an address of 100,000 labels, and for more short numbers and addresses than their forms can tell."""
    labels = "x@a" + ".b" * 100_000
    numbers = " ".join(f"+12345{i:02d}," for i in range(100)) + " ".join(f"{c}@x.com" for c in "abcdefghijklmnopqrstuvwxyz")
    out = {r.doc_id: r for r in surrogates.replace_entities(make_docs([(1, labels), (2, numbers), (3, "z " * 300_000 + "me.1@x.com")])).collect()}
    assert out[1].n_replaced == 1 and re.fullmatch(r"\w@\w(\.\w){99999}\.example", out[1].text)
    assert out[2].n_replaced == 126 and "+12345" not in out[2].text.replace("+1234567", "")
    assert out[3].n_replaced == 1 and len(out[3].text) > 600_000


def test_a_space_that_is_full_grows(spark):
    """All two-digit numbers under one first digit: none may stay, so all become longer."""
    rows = [("phone", f"1{i}") for i in range(10)] + [("phone", f"2{i:04d}") for i in range(9000)] + [("ip", f"1.1.1.{i}") for i in range(9)]
    got = surrogates.assign(spark.createDataFrame(rows, "kind string, entity string"), "k").collect()
    assert len(got) == len(rows) == len({(r.kind, r.new) for r in got}) and not {(r.kind, r.new) for r in got} & set(rows)
    assert all(r.new[0] == r.entity[0] for r in got if r.kind == "phone")


def test_luhn_digit(spark):
    rows = spark.createDataFrame([("411111111111111",), ("7992739871",), ("0",)], "d string").select(surrogates.luhn_digit(F.col("d"))).collect()
    assert [r[0] for r in rows] == ["1", "3", "0"]


def test_odd_rows_and_clashing_names(odd_docs, empty_docs, make_docs):
    docs = crowded(odd_docs.unionAll(make_docs([(20, "me.1@x.shop.com"), (20, "me.1@x.shop.com"), (21, "me.1@x.shop.com " * 20_000)])))
    out = surrogates.replace_entities(docs)
    assert out.columns == [*docs.columns, "n_replaced"]
    rows = out.collect()
    assert len(rows) == 15
    before = {(r.doc_id, r.text) for r in odd_docs.collect()}
    assert {(r.doc_id, r.text) for r in rows if r.n_replaced == 0} == before
    twice = [r.text for r in rows if r.doc_id == 20]
    assert len(twice) == 2 and len(set(twice)) == 1 and [r.n_replaced for r in rows if r.doc_id == 21] == [20_000]
    assert surrogates.replace_entities(empty_docs).count() == 0


def test_no_python_in_the_plan(make_docs):
    df = surrogates.replace_entities(make_docs([(1, "un.12@x.shop.com")]))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
