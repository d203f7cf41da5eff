"""Surrogates for personal data, in DataFrame operations only.

Detected: e-mail addresses, phone numbers, IPv4 addresses, payment cards (bare runs of digits only if they pass the Luhn
test), social security numbers, IBANs and names after a form of address, with initials, particles, inner capitals or all
in capitals.  Wherever a word of such a name stands again in the same document, with or without a form of address, it
gets the same replacement.  Each entity gets a keyed replacement of its own type: digits for digits and letters of the
same script and case for letters, with the punctuation as it stands; cards keep their first digit and pass the Luhn test
if the original does; phones keep their country code; names keep the form of address, its gender and the script.

A surrogate follows from the key, the type, the normal form and an attempt, so all mentions of one entity in the corpus
agree, in whatever format they are written.  Names are replaced word by word, so their words are the entities.  Attempts
are 0 but for entities whose surrogates meet: a check over all distinct entities finds surrogates that two entities
share or that are themselves entities, and raises the attempt of all but one of them, until none is left; if some are
left after ``max_attempts`` rounds, an error is raised.

Null texts stay null, empty texts stay empty.  Repeated rows are replaced alike; an empty table gives no rows.  Where
patterns could match at one place, the first of ``ENTITY`` does.  Very long texts are read whole.  All other columns are
kept as they are, whatever their names; ``n_chars`` follows the text where ``chars_col`` names it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifloom.llm.shared import checkpoint

# Forms of address by gender.
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Sra", "Srta", "Madame", "Mme", "Mlle", "Signora", "Госпожа", "Κυρία")
MALE = ("Mr", "Mister", "Sir", "Herr", "Herrn", "Señor", "Sr", "Monsieur", "Signor", "Господин", "Κύριος")
NEUTRAL = ("Dr", "Prof", "Professor", "Mx")

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<![\p{L}\d])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?![\p{L}\d])"
PHONE = r"(?<![\d+])(?:\+?\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<!\d)\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<!\d)(?<!\d[.-])(?:1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d|[.-]\d)"
TITLES = tuple(sorted((*FEMALE, *MALE, *NEUTRAL), key=len, reverse=True))
#: A form of address: the class of its first letters rules most places out at once.
TITLE = rf"(?<!\p{{L}})(?=[{''.join(sorted({t[0] for t in TITLES}))}])(?:{'|'.join(TITLES)})\.? "
PARTICLE = r"(?:(?:von|van|vom|zu|zur|de|del|della|der|den|di|da|du|dos|la|le|bin|ibn|al|ten|ter) ){0,3}"
WORD = r"\p{Lu}(?=[\p{L}'’-]*\p{L})\p{L}*(?:['’-](?!s(?!\p{L}))\p{L}+)*"
NAME = rf"{TITLE}(?:\p{{Lu}}\. ){{0,2}}{PARTICLE}{WORD}(?: {PARTICLE}{WORD})?"
ENTITY = "|".join((EMAIL, NAME, IBAN, IP, SSN, CARD, PHONE))
#: Cheap tests that every text with an entity passes: digits that lie close, or a form of address.
HINTS = (r"\d(?:[ .()-]{0,2}\d){6}|\d\.\d{1,3}\.\d", r"[A-Z]{2}\d{2} ?[A-Z0-9]{4}", rf"{TITLE}(?:[\p{{Lu}}vzdlbit])")

LATIN, CYRILLIC, GREEK = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшыэюя", "αβγδεζηθικλμνξοπρστυφχψω"
CONSONANTS = {"latin": "bdfgklmnprst", "cyrillic": "бвгдзклмнпрс", "greek": "βγδζκλμνπρστ"}
VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу", "greek": "αειου"}
ENDINGS = {"latin": ("a", "no", "is"), "cyrillic": ("а", "ин", "ис"), "greek": ("α", "ος", "ις")}


def bound(x: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(x), body)[0]


def kind(e: Column) -> Column:
    """The type of a match; none for a bare run of digits that is no card."""
    return (
        F.when(e.contains("@"), "email")
        .when(e.rlike(r"^\p{L}{2}\d"), "iban")
        .when(e.rlike(r"^\p{L}"), "name")
        .when(e.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ip")
        .when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(e.rlike(r"^\d{13,}$") & (F.pmod(_luhn(e), F.lit(10)) != 0), "none")
        .when(e.rlike(r"^\d+(?:[ -]\d+)*$") & (F.length(F.regexp_replace(e, r"\D", "")) >= 13), "card")
        .otherwise("phone")
    )


def normal(e: Column, k: Column) -> Column:
    """What all mentions of an entity of type ``k`` share."""
    digits = F.regexp_replace(e, r"\D", "")
    return (
        F.when(k == "email", F.lower(e))
        .when(k == "iban", F.upper(F.replace(e, F.lit(" "))))
        .when(k == "ip", e)
        .when(k == "phone", F.when(F.length(digits) > 10, F.substring(digits, -10, 10)).otherwise(digits))
        .otherwise(digits)
    )


def _hash(key: str, *parts: Column) -> Column:
    """128 hexadecimal digits."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 512)


def _byte(h: Column, i: Column) -> Column:
    return F.conv(F.substr(h, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(symbols: str, b: Column) -> Column:
    return F.substr(F.lit(symbols), F.pmod(b, F.lit(len(symbols))) + 1, F.lit(1))


def _chars(s: Column, change) -> Column:
    """``change`` of (character, place) for every character of a string."""
    return F.array_join(F.transform(F.split(s, ""), change), "")


def like(s: Column, h: Column) -> Column:
    """A string of the same classes of characters: digits, and letters by script and case."""

    def change(c: Column, i: Column) -> Column:
        b, low = _byte(h, i), F.lower(c)
        letter = F.when(low.rlike("^[α-ωά-ώ]$"), _pick(GREEK, b)).when(low.rlike(r"^\p{IsCyrillic}$"), _pick(CYRILLIC, b)).otherwise(_pick(LATIN, b))
        return F.when(c.rlike("^[0-9]$"), _pick("0123456789", b)).when(c.rlike(r"^\p{Lu}$"), F.upper(letter)).when(c.rlike(r"^\p{L}$"), letter).otherwise(c)

    return _chars(s, change)


def _luhn(digits: Column) -> Column:
    """The Luhn sum of digits, whose last one is not doubled."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.pmod(c.cast("int") * 2, F.lit(10)) + F.when(c.cast("int") > 4, 1).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _card(digits: Column, h: Column) -> Column:
    valid = F.pmod(_luhn(digits), F.lit(10)) == 0

    def closed(body: Column) -> Column:
        check = F.pmod(10 - F.pmod(_luhn(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
        shift = F.when(valid, 0).otherwise(1 + F.pmod(_byte(h, F.lit(60)), F.lit(9)))
        return F.concat(body, F.pmod(check + shift, F.lit(10)).cast("string"))

    return bound(F.concat(F.substring(digits, 1, 1), like(F.substr(digits, F.lit(2), F.length(digits) - 2), h)), closed)


def _filled(e: Column, digits: Column) -> Column:
    """The mention with its digits replaced in order."""
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))
    step = lambda a, c: F.when(c.rlike("^[0-9]$"), F.struct((a["at"] + 1).alias("at"), F.concat(a["out"], F.substr(digits, a["at"], F.lit(1))).alias("out"))).otherwise(F.struct(a["at"].alias("at"), F.concat(a["out"], c).alias("out")))
    return F.aggregate(F.split(e, ""), start, step)["out"]


def _script(word: Column, of) -> Column:
    """``of`` the script of a word's first letter."""
    low = F.lower(word)
    return F.when(low.rlike("^[α-ωά-ώ]"), of("greek")).when(low.rlike(r"^\p{IsCyrillic}"), of("cyrillic")).otherwise(of("latin"))


def _stem(word: Column, attempt: Column, key: str) -> Column:
    """Syllables of the word's script, more with every attempt."""

    def of(script: str) -> Column:
        syllables = lambda h: F.transform(F.sequence(F.lit(1), F.lit(3) + attempt), lambda i: F.concat(_pick(CONSONANTS[script], _byte(h, i * 2)), _pick(VOWELS[script], _byte(h, i * 2 + 1))))
        return bound(_hash(key, F.lit("word"), F.lower(word), attempt.cast("string")), lambda h: F.array_join(syllables(h), ""))

    return _script(word, of)


def _endings(word: Column) -> Column:
    """Endings of female, male and other names."""
    return _script(word, lambda script: F.array(*map(F.lit, ENDINGS[script])))


def _name_word(word: Column, gender: Column, attempt: Column, key: str) -> Column:
    """What stands for a word of a name, in capitals if it is."""
    made = F.initcap(F.concat(_stem(word, attempt, key), F.element_at(_endings(word), F.when(gender == "f", 1).when(gender == "m", 2).otherwise(3))))
    return F.when(F.upper(word) == word, F.upper(made)).otherwise(made)


def name_words(e: Column) -> Column:
    """What follows the form of address: particles, initials and words of the name."""
    return F.split(F.regexp_replace(e, r"^\p{L}+\.? ", ""), " ")


def is_word(w: Column) -> Column:
    return w.rlike(r"^\p{Lu}[^.]")


def _made_words(e: Column, attempt_of, key: str) -> Column:
    """Replacements of ``name_words``; the first of several words has the gender.  Initials move by a keyed number of
    letters, so that different ones stay different; particles stay."""
    shift = int(hashlib.sha256(f"{key}\x1finitial".encode()).hexdigest(), 16) % 25 + 1
    moved = LATIN[shift:] + LATIN[:shift]
    first = bound(F.filter(name_words(e), is_word), lambda own: F.when(F.size(own) > 1, own[0]))

    def made(w: Column) -> Column:
        named = lambda f: _name_word(w, F.when(w == f, gender(e)).otherwise("n"), attempt_of(F.lit("word"), F.lower(w)), key)
        return F.when(is_word(w), bound(first, named)).when(w.contains("."), F.translate(w, LATIN.upper(), moved.upper())).otherwise(w)

    return F.transform(name_words(e), made)


def gender(e: Column) -> Column:
    title = F.regexp_extract(e, r"^(\p{L}+)", 1)
    return F.when(title.isin(*FEMALE), "f").when(title.isin(*MALE), "m").otherwise("n")


def surrogate(e: Column, attempt_of, key: str) -> Column:
    """The replacement of a mention; ``attempt_of`` gives the attempt of a type and normal form."""
    of = lambda k, n, a: bound(_hash(key, k, n, a.cast("string")), lambda h: _surrogate(e, k, n, h, a, key))
    plain = lambda k: bound(normal(e, k), lambda n: bound(attempt_of(k, n), lambda a: of(k, n, a)))
    name = F.concat(F.regexp_extract(e, r"^(\p{L}+\.? )", 1), F.array_join(_made_words(e, attempt_of, key), " "))
    return bound(kind(e), lambda k: F.when(k == "none", e).when(k == "name", name).otherwise(plain(k)))


def _surrogate(e: Column, k: Column, n: Column, h: Column, attempt: Column, key: str) -> Column:
    digits = F.regexp_replace(e, r"\D", "")
    domain = F.regexp_extract(n, "@(.*)$", 1)
    email = F.concat(like(F.regexp_extract(e, "^([^@]*)@", 1), h), F.when(attempt > 1, F.concat(F.lit("."), F.substring(h, 1, 16))).otherwise(""), F.lit("@m"), F.substring(_hash(key, F.lit("domain"), domain), 1, 10), F.lit(".example.org"))
    core = F.concat(_pick("23456789", _byte(h, F.lit(63))), like(F.substr(n, F.lit(2), F.length(n)), h))
    phone = _filled(e, F.concat(F.substr(digits, F.lit(1), F.length(digits) - F.length(n)), core))
    ip = F.concat_ws(".", *((F.pmod(_byte(h, F.lit(i)), F.lit(254)) + 1).cast("string") for i in range(4)))
    iban = F.concat(F.substring(e, 1, 2), bound(_hash(key, F.lit("iban"), F.length(e).cast("string"), n, attempt.cast("string")), lambda x: like(F.substr(e, F.lit(3), F.length(e)), x)))
    card = bound(_card(n, h), lambda d: _filled(e, d))
    ssn = _filled(e, F.concat(F.lit("9"), like(F.substring(n, 2, 8), h)))
    return F.when(k == "email", email).when(k == "ip", ip).when(k == "iban", iban).when(k == "card", card).when(k == "ssn", ssn).otherwise(phone)


def entities(text: Column) -> Column:
    """All mentions in a text, in order."""
    hint = text.contains("@") | text.rlike(HINTS[0]) | text.rlike(HINTS[1]) | text.rlike(HINTS[2])
    return F.when(hint, F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def units(e: Column) -> Column:
    """(kind, n, e) of the entities of a mention: the words of a name, or the mention itself."""
    words = F.transform(F.filter(name_words(e), is_word), lambda w: F.struct(F.lit("word").alias("kind"), F.lower(w).alias("n"), w.alias("e")))
    own = lambda k: F.when(k == "name", words).when(k == "none", F.slice(words, 1, 0)).otherwise(F.array(F.struct(k.alias("kind"), normal(e, k).alias("n"), e.alias("e"))))
    return bound(kind(e), own)


def _values(key: str) -> Column:
    """The normal forms that an entity's surrogates have: of a word one for each gender."""
    attempt = F.col("attempt")
    word = F.transform(_endings(F.col("e")), lambda x: F.concat(_stem(F.col("e"), attempt, key), x))
    return F.when(F.col("kind") == "word", word).otherwise(F.array(normal(surrogate(F.col("e"), lambda k, n: attempt, key), F.col("kind"))))


def attempts(docs: DataFrame, key: str, text_col: str, max_attempts: int = 30) -> DataFrame:
    """(name, attempt) of the entities whose attempt is not 0; a name is a hash of type and normal form."""
    mentions = docs.select(F.explode(entities(docs[text_col])).alias("e")).select(F.explode(units(F.col("e"))).alias("x"))
    # one mention stands for an entity; formats of one entity have surrogates of one normal form
    known = checkpoint(mentions.groupBy("x.kind", "x.n").agg(F.min("x.e").alias("e")).withColumn("attempt", F.lit(0)))
    for _ in range(max_attempts):
        made = checkpoint(known.select("kind", "n", F.explode(_values(key)).alias("value")))
        values = made.select("kind", "value", "n", F.lit(0).alias("real")).unionByName(known.select("kind", F.col("n").alias("value"), F.lit(None).cast("string").alias("n"), F.lit(1).alias("real")))
        clash = values.groupBy("kind", "value").agg(F.max("real").alias("real"), F.count("n").alias("times"), F.min("n").alias("least")).where("times > 1 or (times = 1 and real = 1)")
        clash = checkpoint(clash.select("kind", "value", "real", "least"))
        if not clash.limit(1).count():
            break
        again = made.join(clash, ["kind", "value"]).where((F.col("real") == 1) | (F.col("n") != F.col("least"))).select("kind", "n").distinct().withColumn("again", F.lit(1))
        known = checkpoint(known.join(again, ["kind", "n"], "left").select("kind", "n", "e", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt")))
    else:
        raise RuntimeError(f"attempts: surrogates still meet after {max_attempts} rounds")
    return known.where("attempt > 0").select(_name(F.col("kind"), F.col("n")).alias("name"), "attempt")


def _name(k: Column, n: Column) -> Column:
    return F.md5(F.concat_ws("\x1f", k, n))


def replace(docs: DataFrame, key: str, *, text_col: str = "text", chars_col: str | None = None, count_col: str | None = None, few: int = 5_000) -> DataFrame:
    """All rows and columns, the text with surrogates; ``count_col`` names a new column for the number of mentions."""
    changed = checkpoint(attempts(docs, key, text_col))
    n = changed.count()
    row = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    text = F.col(f"row.`{text_col}`")
    work = row.withColumn("found", entities(text))
    if not n:
        attempt_of = lambda k, n: F.lit(0)
    elif n <= few:  # a literal of some hundred KB
        table = F.create_map(*(x for r in changed.collect() for x in (F.lit(r["name"]), F.lit(r["attempt"]))))
        attempt_of = lambda k, n: F.coalesce(table[_name(k, n)], F.lit(0))
    else:  # by a join on the text's hash, so that texts move but once
        work = work.withColumn("text_key", F.md5(text.cast("binary")))
        mentions = work.where("size(found) > 0").select("text_key", F.explode("found").alias("e")).select("text_key", F.explode(units(F.col("e"))).alias("x")).select("text_key", _name(F.col("x.kind"), F.col("x.n")).alias("name")).distinct()
        own = mentions.join(changed, "name").groupBy("text_key").agg(F.map_from_entries(F.collect_list(F.struct("name", "attempt"))).alias("own"))
        work = work.join(own, "text_key", "left")
        attempt_of = lambda k, n: F.coalesce(F.col("own")[_name(k, n)], F.lit(0))
    made = F.transform("found", lambda e: surrogate(e, attempt_of, key))
    joined = bound(made, lambda m: bound(again(F.col("found"), m), lambda names: F.array_join(F.zip_with(bare(F.split(text, ENTITY, -1), names), m, lambda p, x: F.concat(p, F.coalesce(x, F.lit("")))), "")))
    work = work.withColumn("new", F.when(F.size("found") > 0, joined).otherwise(text))
    out = [F.col("new").alias(c) if c == text_col else F.length("new").cast(docs.schema[c].dataType).alias(c) if c == chars_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    if count_col:
        out.append(F.coalesce(F.size(F.filter("found", lambda e: kind(e) != "none")), F.lit(0)).cast("long").alias(count_col))
    return work.select(*out)


def again(found: Column, made: Column) -> Column:
    """(word, replacement) of the words of the names among the mentions, also in other cases, longest first; of equal
    words the first counts."""
    words = lambda x: F.arrays_zip(name_words(x["e"]).alias("w"), name_words(x["m"]).alias("m"))
    mentions = F.filter(F.arrays_zip(found.alias("e"), made.alias("m")), lambda x: kind(x["e"]) == "name")
    own = F.filter(F.flatten(F.transform(mentions, words)), lambda x: is_word(x["w"]))
    cases = F.transform(own, lambda x: F.array(x, F.struct(F.upper(x["w"]).alias("w"), F.upper(x["m"]).alias("m")), F.struct(F.initcap(x["w"]).alias("w"), F.initcap(x["m"]).alias("m"))))
    order = lambda a, b: F.when(F.length(a["w"]) > F.length(b["w"]), -1).when(F.length(a["w"]) < F.length(b["w"]), 1).otherwise(0)
    return F.array_sort(F.flatten(cases), order)


def bare(pieces: Column, names: Column) -> Column:
    """Pieces of a text with the words of names replaced."""
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(F.array_distinct(F.transform(names, lambda x: x["w"])), "|"), F.lit(r")(?!\p{L})"))
    of = lambda w: F.get(F.filter(names, lambda x: x["w"] == w), F.lit(0))["m"]
    replaced = lambda p, own: F.array_join(F.zip_with(F.split(p, own, -1), F.regexp_extract_all(p, own, F.lit(0)), lambda a, w: F.concat(a, F.coalesce(of(w), F.lit("")))), "")
    return F.when(F.size(names) == 0, pieces).otherwise(bound(pattern, lambda own: F.transform(pieces, lambda p: replaced(p, own))))
