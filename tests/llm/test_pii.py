"""Surrogates against a plain version, mention by mention, and the forms of names and numbers that are found."""

import hashlib

import pytest
import regex

from motifloom.llm import pii

SF = "/root/testdata/sf0.001"
KEY = "k"


def hashed(*parts):
    return hashlib.sha512("\x1f".join((KEY, *parts)).encode()).hexdigest()


def byte(h, i):
    return int(h[i % 64 * 2 : i % 64 * 2 + 2], 16)


def pick(symbols, b):
    return symbols[b % len(symbols)]


def script(word):
    c = word[0].lower()
    return "greek" if regex.match("[α-ωά-ώ]", c) else "cyrillic" if regex.match(r"\p{IsCyrillic}", c) else "latin"


def like(s, h):
    out = ""
    for i, c in enumerate(s):
        symbols = {"greek": pii.GREEK, "cyrillic": pii.CYRILLIC, "latin": pii.LATIN}[script(c)]
        if c in "0123456789":
            c = pick("0123456789", byte(h, i))
        elif regex.match(r"\p{Lu}", c):
            c = pick(symbols, byte(h, i)).upper()
        elif regex.match(r"\p{L}", c):
            c = pick(symbols, byte(h, i))
        out += c
    return out


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))


def filled(e, digits):
    digits = iter(digits)
    return "".join(next(digits) if c in "0123456789" else c for c in e)


def kind(e):
    digits = regex.sub("[^0-9]", "", e)
    if "@" in e:
        return "email"
    if regex.match(r"\p{L}{2}[0-9]", e):
        return "iban"
    if regex.match(r"\p{L}", e):
        return "name"
    if regex.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", e):
        return "ip"
    if regex.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", e):
        return "ssn"
    if regex.fullmatch("[0-9]{13,}", e) and luhn(e) % 10:
        return "none"
    return "card" if regex.fullmatch("[0-9]+(?:[ -][0-9]+)*", e) and len(digits) >= 13 else "phone"


def normal(e, k):
    digits = regex.sub("[^0-9]", "", e)
    return {"email": e.lower(), "iban": e.replace(" ", "").upper(), "ip": e, "phone": digits[-10:]}.get(k, digits)


def words(e):
    return regex.sub(r"^\p{L}+\.? ", "", e).split(" ")


def is_word(w):
    return bool(regex.match(r"\p{Lu}[^.]", w))


def units(e):
    k = kind(e)
    return [] if k == "none" else [("word", w.lower(), w) for w in words(e) if is_word(w)] if k == "name" else [(k, normal(e, k), e)]


def stem(w, attempt):
    h, s = hashed("word", w.lower(), str(attempt)), script(w)
    return "".join(pick(pii.CONSONANTS[s], byte(h, 2 * i)) + pick(pii.VOWELS[s], byte(h, 2 * i + 1)) for i in range(1, 4 + attempt))


def made_words(e, attempt):
    title = regex.match(r"\p{L}+", e)[0]
    gender = 0 if title in pii.FEMALE else 1 if title in pii.MALE else 2
    own = [w for w in words(e) if is_word(w)]
    shift = int(hashlib.sha256(f"{KEY}\x1finitial".encode()).hexdigest(), 16) % 25 + 1
    out = []
    for w in words(e):
        if is_word(w):
            new = (stem(w, attempt("word", w.lower())) + pii.ENDINGS[script(w)][gender if len(own) > 1 and w == own[0] else 2]).capitalize()
            out.append(new.upper() if w == w.upper() else new)
        elif "." in w:
            out.append("".join(chr((ord(c) - 65 + shift) % 26 + 65) if "A" <= c <= "Z" else c for c in w))
        else:
            out.append(w)
    return out


def surrogate(e, attempt):
    k = kind(e)
    if k == "none":
        return e
    if k == "name":
        return regex.match(r"\p{L}+\.? ", e)[0] + " ".join(made_words(e, attempt))
    n, digits = normal(e, k), regex.sub("[^0-9]", "", e)
    a = attempt(k, n)
    h = hashed(k, n, str(a))
    if k == "email":
        return like(e.split("@")[0], h) + (f".{h[:16]}" if a > 1 else "") + "@m" + hashed("domain", n.split("@", 1)[1])[:10] + ".example.org"
    if k == "ip":
        return ".".join(str(byte(h, i) % 254 + 1) for i in range(4))
    if k == "iban":
        return e[:2] + like(e[2:], hashed("iban", str(len(e)), n, str(a)))
    if k == "ssn":
        return filled(e, "9" + like(n[1:9], h))
    if k == "card":
        body = n[0] + like(n[1:-1], h)
        shift = 0 if luhn(n) % 10 == 0 else 1 + byte(h, 60) % 9
        return filled(e, body + str((10 - luhn(body + "0") % 10 + shift) % 10))
    return filled(e, digits[: len(digits) - len(n)] + pick("23456789", byte(h, 63)) + like(n[1:], h))


def found(text):
    return [m[0] for m in regex.finditer(pii.ENTITY, text or "")]


def plain_attempts(texts):
    known = {}
    for t in texts:
        for e in found(t):
            for k, n, x in units(e):
                known[k, n] = min(known.get((k, n), x), x)
    tries = dict.fromkeys(known, 0)
    while True:
        of = lambda k, n: tries[k, n]
        values = {}
        for (k, n), e in known.items():
            for v in [stem(e, tries[k, n]) + x for x in pii.ENDINGS[script(e)]] if k == "word" else [normal(surrogate(e, of), k)]:
                values.setdefault((k, v), set()).add(n)
        again = {(k, n) for (k, v), ns in values.items() for n in ns if (k, v) in known or n != min(ns)}
        if not again:
            return tries
        for x in again:
            tries[x] += 1


def plain_replace(text, tries):
    if text is None:
        return None
    of = lambda k, n: tries[k, n]
    mentions = found(text)
    names = {}
    for e in mentions:
        if kind(e) == "name":
            for w, m in zip(words(e), made_words(e, of)):
                if is_word(w):
                    for case in (str, str.upper, str.capitalize):
                        names.setdefault(case(w), case(m))
    out, at = "", 0
    pattern = rf"(?<!\p{{L}})(?:{'|'.join(sorted(names, key=len, reverse=True))})(?!\p{{L}})"
    bare = lambda piece: regex.sub(pattern, lambda m: names[m[0]], piece) if names else piece
    for m in regex.finditer(pii.ENTITY, text):
        out += bare(text[at : m.start()]) + surrogate(m[0], of)
        at = m.end()
    return out + bare(text[at:])


TEXTS = [
    "Mrs Anna Smith came. Later Smith and Anna Smith left. SMITH's hat, a blacksmith.",
    "Mr O'Neil and Dr. von Braun met Prof JONES; Jones left, Braun too, O'Neil's.",
    "Mr J. R. Smith, Mr K. Smith, Señora María García-López y Госпожа Иванова Анна. Иванова ушла. Κύριος Παπάς.",
    "card 4111111111111111, order 1234567890123 and 1700000000000, 4012-8888-8888-1881, 3782 822463 10005.",
    "Mail John.Smith@mail.com or +1 (988) 555-2485, (988) 555-2485. IP 152.143.12.131### Mr. John Smith, SSN 123-45-6789, IBAN DE89 3704 0044 0532 0130 00.",
    None,
    "",
    "Dr No one. Miss Li said Li. A token f17524f7594f8e40841111111111111111 stays.",
    "555-123-4567. " * 3000 + "Mr Long " + "x" * 100_000 + " Long",
]


@pytest.mark.parametrize("few", [5_000, 0])
def test_replacements_equal_the_plain_version(spark, monkeypatch, few):
    """Also with so few syllables and digits that surrogates meet and attempts are needed."""
    monkeypatch.setattr(pii, "CONSONANTS", {k: v[:2] for k, v in pii.CONSONANTS.items()})
    monkeypatch.setattr(pii, "VOWELS", {k: v[:1] for k, v in pii.VOWELS.items()})
    texts = TEXTS + [f"Mr Foo{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]} and 1{i:02d}.1.1.{i} met" for i in range(60)] + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    tries = plain_attempts(texts)
    assert any(tries.values())
    got = {r["i"]: r["text"] for r in pii.replace(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), KEY, few=few).collect()}
    assert got == {i: plain_replace(t, tries) for i, t in enumerate(texts)}


def test_names_are_coreferent_and_whole(spark):
    new = {r["i"]: r["text"] for r in pii.replace(spark.createDataFrame(list(enumerate(TEXTS)), "i long, text string"), KEY, count_col="n").collect()}
    first = regex.match(r"Mrs (\w+a) (\w+) came\. Later (\w+) and (\w+) (\w+) left\. (\w+)'s hat, a blacksmith\.", new[0]).groups()
    assert first[1] == first[2] == first[4] and first[0] == first[3] and first[5] == first[1].upper()
    for i, clear in ((0, "Smith Anna SMITH"), (1, "Neil Braun JONES Jones"), (2, "García López Иванова Анна Παπάς"), (3, "4111111111111111 1881 822463"), (7, "Li")):
        assert not any(regex.search(rf"(?<!\p{{L}}){w}(?!\p{{L}})", new[i]) for w in clear.split())
    assert "order 1234567890123 and 1700000000000," in new[3] and new[7].endswith("A token f17524f7594f8e40841111111111111111 stays.")
    mister = regex.match(r"Mr (\w)\. (\w)\. (\w+), Mr (\w)\. (\w+),", new[2]).groups()
    assert mister[2] == mister[4] == first[1] and mister[0] != mister[3] and mister[0] != "J"
