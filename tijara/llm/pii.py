"""Personal data: detection and surrogate generation (DataFrame functions only).

Kinds: e-mail addresses, telephone numbers, payment cards (valid check digit),
IBANs, IPv4 addresses and names after a form of address.  Every mention is
replaced by a surrogate of its kind: addresses keep the shape of their local
part, numbers keep separators, country code and length, cards keep their issuer
digits and a valid check digit, names keep gender and script, and the case of
the mention is kept.

A surrogate depends on the key, the kind and the entity alone (an entity is the
mention in canonical form: lower case, digits only, a telephone number without
country code and leading zero ...), so all mentions of an entity read alike in
every document, and the parts of a name and the domain of an address are
entities of their own.  The gender of a given name is that of its forms of
address, in any document; one met as both, or as neither, has none.  A name
found in a document is replaced where its words (three letters and more, spelt
alike) stand alone in that document, too.

Numbers and local parts go through a keyed one-to-one map among strings of their
shape, so that different ones stay different; names and domains are drawn from a
hash.  Collision checks on the table of distinct entities then look for any two
with one surrogate, and for surrogates that are an entity of the table: all but
the smallest of the former and all of the latter take their next number, until
none collide (a surrogate that is an entity is accepted after ``ORIGINALS``
rounds, where a shape is nearly used up).  Only numbers above zero, and genders
that documents disagree on, travel back to the documents concerned.

Texts are searched once: the pieces of texts with mentions are written to the
shared folder, entities are taken from there and the pieces are put together
again with their surrogates.

Telephone numbers are detected by form: + or 00 and a country code; a leading
zero and 9 to 12 digits; an area in brackets; three to five groups of 9 to 11 digits;
three groups of 2-4, 3-4 and 3-4; ddd-dddd; 10 or 11 digits unbroken.  Cards have
13 to 19 digits, unbroken, in fours (and 4-4-4-4-3), 4-6-5 or 4-6-4.  Not detected:
shorter unbroken numbers, two groups without a zero, + or brackets (but 3-4),
pairs of digits only without a leading zero, numbers behind # or written in
words, extensions.

Cases: null texts stay null and have no mention; empty texts stay empty;
repeated rows are rewritten alike; whole texts are rewritten whatever their
length; mentions do not overlap (the leftmost counts; at one place the kinds
in the order above).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import at, positional, write_shared

KEY = "surrogates-1"

# Forms of address by gender.
MALE = ("Mr", "Mister", "Herr", "Herrn", "Monsieur", "Sr", "Señor", "Don", "Господин")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Sra", "Señora", "Doña", "Госпожа")
ANY = ("Dr", "Prof", "Доктор")

_LOCAL = "A-Za-z0-9._%+-"
# A local part begins at the first letter or digit of a run of its characters, so a run without an @ is walked once.
EMAIL = (rf"(?:(?<![{_LOCAL}])|(?<=[._%+-])(?<![A-Za-z0-9][._%+-]{{1,255}}))[A-Za-z0-9][{_LOCAL}]*+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
         r"(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?){0,126}\.[A-Za-z]{2,24}")
IP = r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}(?!\.?[0-9])"
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO EG GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC",
    33: "RU"}
_LANDS = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")
# A match is as long as its country's IBANs are; other countries have no fixed length.
IBAN = r"\b(?:" + "|".join(
    f"(?:{lands.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    for n, lands in IBAN_LENGTHS.items()) + rf"|(?!{_LANDS})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)\b"
_CARD = r"[0-9]{4}(?:[ -]?[0-9]{4}){3}|3[0-9]{3}[ -]?[0-9]{6}[ -]?[0-9]{4,5}|[0-9]{13,19}"
_LONG = r"[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{3}"
CARD = rf"(?<![0-9A-Za-z])(?:{_CARD})(?![0-9A-Za-z])"
LONG_CARD = rf"(?<![0-9A-Za-z])(?:{_LONG})(?![0-9A-Za-z])"
_SEP = r"[   ()./-]{0,2}"
_GAP = r"[   .-]"
_YEAR = r"(?:1[5-9]|20)[0-9]{2}"
# No telephone number begins with a date, a year and a second one, or behind a digit and a dot, dash or slash.
_PLAIN = rf"(?<![0-9A-Za-z#+])(?<![0-9][./-])(?!{_YEAR}[ ./-][01]?[0-9][ ./-][0-3]?[0-9](?![0-9])|[0-3]?[0-9][ ./-][0-3]?[0-9][ ./-]{_YEAR}(?![0-9])|{_YEAR}[ ./-]{_YEAR}(?![0-9]))"
_PHONES = (
    # North America; any country code; 00 as such.
    r"(?<![0-9A-Za-z+])\+1[ .-]?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-]?)[0-9]{3}[ .-]?[0-9]{4}",
    rf"(?<![0-9A-Za-z+])\+[0-9](?:{_SEP}[0-9]){{6,14}}",
    rf"{_PLAIN}00[1-9](?:{_SEP}[0-9]){{7,13}}",
    # A leading zero; an area in brackets; groups of 9 to 11 digits; 3-4; 10 or 11 digits unbroken.
    rf"{_PLAIN}\(?0[1-9](?:{_SEP}[0-9]){{7,10}}",
    rf"{_PLAIN}\((?!{_YEAR}\))(?=[0-9]{{2,5}}\)(?:{_GAP}?[0-9]){{5,10}}(?!{_GAP}?[0-9]))[0-9]{{2,5}}\) ?[0-9]{{2,8}}(?:{_GAP}[0-9]{{2,8}}){{0,4}}",
    rf"{_PLAIN}(?=[0-9](?:{_GAP}?[0-9]){{8,10}}(?!{_GAP}?[0-9]))(?=[0-9 .-]*[0-9]{{3}})[0-9]{{2,5}}(?:{_GAP}[0-9]{{2,8}}){{2,4}}",
    rf"{_PLAIN}[0-9]{{3}}-[0-9]{{4}}(?![./-][0-9])",
    rf"{_PLAIN}[0-9]{{10,11}}(?![.,/-][0-9])",
    r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}")
PHONE = f"(?:{'|'.join(_PHONES)})(?![0-9A-Za-z])"
_ADDRESS = "|".join(MALE + FEMALE + ANY)
NAME = rf"(?<![\p{{L}}])(?:{_ADDRESS})\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?"
ANY_KIND = "|".join(f"(?:{p})" for p in (EMAIL, IP, IBAN, LONG_CARD, CARD, PHONE, NAME))
#: What is sought inside a match that turns out to be of no kind.
INNER = "|".join(f"(?:{p})" for p in (EMAIL, IP, CARD, PHONE, NAME))
#: A text without any of these has no mention.
HINT = rf"[0-9@]|(?:{_ADDRESS})\.? \p{{Lu}}"
ROUNDS = 4
ORIGINALS = 8
TOLD_ROWS = 50_000  # documents (and ten times as many entities) whose renumbered entities are broadcast
#: Country codes of two digits; 1 and 7 have one, all others three.
TWO_DIGITS = ("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98").split()
#: Stands between a text's mentions while it is cut.
MARK = "\x01"

# Syllables of invented names.
LATIN = ("ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "go", "ka", "ke", "ko", "la", "le", "lo",
         "ma", "me", "mo", "na", "ne", "no", "pa", "pe", "ra", "re", "ro", "sa", "se", "ta", "te", "to")
CYRILLIC = ("ба", "бе", "бо", "ва", "ве", "во", "га", "го", "да", "де", "до", "за", "зе", "ка", "ке", "ко",
            "ла", "ле", "ло", "ма", "ме", "мо", "на", "не", "но", "ра", "ре", "ро", "са", "се", "та", "то")


def luhn_ok(digits: Column) -> Column:
    """Whether the string of digits has a valid check digit."""
    total = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))),
        F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def iban_rest(iban: Column) -> Column:
    """Remainder by 97 with the first four characters last and letters as 10 to 35."""
    turned = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(
        c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def kind_of(m: Column) -> Column:
    """Kind of a match of ``ANY_KIND``; null for a number that is no card or IBAN after all, and for an empty text."""
    full = lambda p: m.rlike(rf"^(?:{p})$")
    return (F.when(F.contains(m, F.lit("@")), "email").when(full(IP.replace("(?<![0-9.])", "").replace(r"(?!\.?[0-9])", "")), "ip")
            .when(m.rlike("^[A-Z]{2}[0-9]{2}[ A-Z0-9]"), F.when(iban_rest(F.regexp_replace(m, " ", "")) == 1, "iban"))
            .when(full(_LONG) | full(_CARD), F.when(luhn_ok(_digits(m)), "card").when(full(PHONE), "phone"))
            .when(m.rlike("[0-9]"), "phone").when(m != "", "name"))


def _name_parts(m: Column) -> Column:
    """Words of a name without the form of address."""
    return F.filter(F.split(F.regexp_replace(m, rf"^(?:{_ADDRESS})\.? ", ""), " "), lambda w: w != "")


def gender(m: Column) -> Column:
    any_of = lambda names: m.rlike(rf"^(?:{'|'.join(names)})\b\.?")
    return F.when(any_of(FEMALE), "f").when(any_of(MALE), "m").otherwise("u")


def national(m: Column) -> Column:
    """Digits of a telephone number without country code and trunk zero."""
    d = _digits(m)
    rest = F.when(m.startswith("+"), d).when(d.startswith("00"), F.substr(d, F.lit(3)))
    code = F.when(rest.rlike("^[17]"), 1).when(F.substring(rest, 1, 2).isin(TWO_DIGITS), 2).otherwise(3)
    own = F.coalesce(F.substr(rest, code + 1), d)
    return F.when(own.startswith("0"), F.substr(own, F.lit(2))).otherwise(own)


#: Parts of a text: what stands before a mention, the mention, and for a name's word that stands alone its kind.
PIECE = "struct<before:string,m:string,part:string>"


def entities(m: Column, part: Column, genders: Column) -> Column:
    """Entities of a mention: array of (kind, canonical form, gender).  ``genders``: of the document's given names, a map."""
    e = lambda k, c: F.struct(F.lit(k).alias("kind"), c.alias("entity"), F.lit("").alias("gender"))

    def word(w: Column, k) -> Column:
        k = F.lit(k) if isinstance(k, str) else k
        return F.struct(k.alias("kind"), F.lower(w).alias("entity"),
                        F.when(k == "given", F.coalesce(F.try_element_at(genders, F.lower(w)), F.lit("u"))).otherwise("").alias("gender"))

    name = _let(_name_parts(m), lambda parts: F.transform(parts, lambda w, i: _let(
        F.when(i < F.size(parts) - 1, "given").otherwise("family"), lambda k: word(w, k))))
    none = F.array().cast("array<struct<kind:string,entity:string,gender:string>>")
    # Bound once each: the trees below are large.
    return F.when(part != "", F.array(word(m, part))).otherwise(_let(kind_of(m), lambda kind: (
        F.when(kind == "email", F.array(e("email", F.lower(m)), e("domain", F.lower(F.substring_index(m, "@", -1)))))
        .when(kind == "iban", F.array(e("iban", F.regexp_replace(m, " ", ""))))
        .when(kind == "ip", F.array(e("ip", m)))
        .when(kind == "card", F.array(e("card", _digits(m)))).when(kind == "phone", F.array(e("phone", national(m))))
        .when(kind == "name", name).otherwise(none))))


def _hash(kind: Column, entity: Column, nonce: Column, key: str) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, entity, nonce.cast("string")), 256)


def _number(h: Column, place) -> Column:
    """A number from 0 to 2^28 - 1, other for each place 0, 1, ... 8 of a hash."""
    return F.conv(F.substr(h, F.lit(1) + F.lit(7) * place, F.lit(7)), 16, 10).cast("long")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _symbols(text: Column) -> Column:
    """Characters as (v, m, c): the value v of a digit or letter among m, other characters fixed (m = 1)."""
    return F.transform(F.split(text, ""), lambda c: F.struct(
        F.when(c.rlike("[0-9]"), F.ascii(c) - 48).when(c.rlike("[a-z]"), F.ascii(c) - 97).otherwise(0).cast("int").alias("v"),
        F.when(c.rlike("[0-9]"), 10).when(c.rlike("[a-z]"), 26).otherwise(1).cast("int").alias("m"), c.alias("c")))


def _spelled(symbols: Column) -> Column:
    return F.array_join(F.transform(symbols, lambda e: F.when(e["m"] == 10, e["v"].cast("string")).when(
        e["m"] == 26, F.chr(e["v"] + 97)).otherwise(e["c"])), "")


def _permuted(symbols: Column, salt: Column) -> Column:
    """A keyed one-to-one map among strings of one shape (a Feistel network):
    round by round each half is shifted, symbol by symbol within its range, by a
    hash of the other half."""
    def turn(state: Column, r: Column) -> Column:
        half = F.size(state) / 2
        moves = lambda i: (i < half) == (r % 2 == 0)
        other = F.array_join(F.transform(F.filter(state, lambda e, i: ~moves(i)), lambda e: F.concat_ws(
            ",", e["v"].cast("string"), e["m"].cast("string"), F.when(e["m"] == 1, e["c"]))), ";")
        shape = F.array_join(F.transform(state, lambda e: e["m"].cast("string")), ",")
        return _let(F.sha2(F.concat_ws("\x1f", salt, r.cast("string"), shape, other), 256), lambda h: F.transform(
            state, lambda e, i: F.struct(
                F.when(moves(i), (e["v"] + F.conv(F.substr(h, F.lit(1) + (i % 21) * 3, F.lit(3)), 16, 10).cast("int")) % e["m"])
                .otherwise(e["v"]).cast("int").alias("v"), e["m"].alias("m"), e["c"].alias("c"))))

    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), symbols, turn)


def _other_text(text: Column, salt: Column) -> Column:
    """The permuted text; one that the map leaves as it is goes through another map."""
    return _let(_spelled(_permuted(_symbols(text), salt)), lambda t: F.when(t != text, t).otherwise(
        _spelled(_permuted(_symbols(text), F.concat(salt, F.lit("again"))))))


def _check_digit(digits: Column) -> Column:
    """``digits`` and the digit that makes them valid."""
    total = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, c.cast("int")).otherwise(
            F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))),
        F.lit(0), lambda a, x: a + x)
    return F.concat(digits, ((10 - total % 10) % 10).cast("string"))


def _invented(entity: Column, h: Column, kind: Column, sex: Column) -> Column:
    """A name of three or four syllables in the entity's script; given names end by gender."""
    cyrillic = entity.rlike(r"\p{IsCyrillic}")

    def built(syllables, ends):
        s = F.array(*[F.lit(x) for x in syllables])
        pick = lambda i: F.element_at(s, (_number(h, F.lit(i)) % len(syllables)).cast("int") + 1)
        body = F.concat(pick(0), pick(1), pick(2), F.when(_number(h, F.lit(4)) % 2 == 0, pick(5)).otherwise(F.lit("")))
        return F.concat(body, F.when(sex == "f", ends[0]).when(sex == "m", ends[1]).when(kind == "family", ends[2]).otherwise(""))

    return F.when(cyrillic, built(CYRILLIC, ("ня", "н", "шко"))).otherwise(built(LATIN, ("na", "n", "ner")))


def surrogate(kind: Column, entity: Column, sex: Column, nonce: Column, key: str = KEY) -> Column:
    """Canonical surrogate of a canonical entity (``sex``: gender of a given name)."""
    salt = F.concat_ws("\x1f", F.lit(key), kind, nonce.cast("string"))
    h = _hash(kind, entity, nonce, key)
    n = F.length(entity)
    octets = F.transform(F.split(entity, r"\."), lambda o: F.struct(o.cast("int").alias("v"), F.lit(256).alias("m"), o.alias("c")))
    ip = F.array_join(F.transform(_permuted(octets, salt), lambda e: e["v"].cast("string")), ".")
    card = _check_digit(F.concat(F.substring(entity, 1, 6), _other_text(F.substr(entity, F.lit(7), n - 7), salt)))
    # The first digit stays, so that no number begins with a zero that had none.
    phone = F.concat(F.substring(entity, 1, 1), _other_text(F.substring(entity, 2, 64), salt))
    body = F.upper(_other_text(F.lower(F.substring(entity, 5, 64)), salt))
    land = F.substring(entity, 1, 2)
    iban = F.concat(land, F.lpad((98 - iban_rest(F.concat(land, F.lit("00"), body))).cast("string"), 2, "0"), body)
    local = _let(F.substring_index(entity, "@", 1), lambda t: _let(_spelled(_permuted(_symbols(t), salt)), lambda u: F.when(
        (u != t) & (nonce == 0), u).otherwise(F.concat(u, F.lit("-"), F.substring(h, 1, 6)))))
    # What follows the @ is there so that collisions are sought within one domain.
    email = F.concat(local, F.lit("@"), F.substring_index(entity, "@", -1))
    # From the second number on, names get more syllables.
    name = F.concat(F.when(nonce > 0, _invented(entity, F.sha2(h, 256), F.lit(""), F.lit(""))).otherwise(""), _invented(entity, h, kind, sex))
    return (F.when(kind == "email", email)
            .when(kind == "domain", F.concat(F.lit("m"), F.substring(h, 1, 12), F.lit(".example.net")))
            .when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", phone).when(kind == "iban", iban).otherwise(name))


def _poured(mention: Column, chars: Column, which: str) -> Column:
    """``mention`` with its characters of class ``which`` replaced in order by ``chars``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))
    return F.aggregate(F.split(mention, ""), start, lambda a, c: F.when(c.rlike(which), F.struct(
        F.concat(a["out"], F.substr(chars, a["k"] + 1, F.lit(1))).alias("out"), (a["k"] + 1).alias("k"))).otherwise(
        F.struct(F.concat(a["out"], c).alias("out"), a["k"].alias("k"))), lambda a: a["out"])


def _cased(like: Column, word: Column) -> Column:
    return F.when((F.length(like) > 1) & (F.upper(like) == like), F.upper(word)).when(
        F.upper(F.substring(like, 1, 1)) == F.substring(like, 1, 1), F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 99))
    ).otherwise(word)


def rewritten(m: Column, part: Column, genders: Column, told, key: str = KEY) -> Column:
    """What a mention is replaced by.  ``told(kind, entity)``: (nonce, gender) of an entity, null where the document's own hold."""
    def s(e: Column) -> Column:
        return _let(told(e["kind"], e["entity"]), lambda t: surrogate(
            e["kind"], e["entity"], F.coalesce(t["gender"], e["gender"]), F.coalesce(t["nonce"], F.lit(0)), key))

    def written(kind: Column, subs: Column) -> Column:
        one = lambda i: F.element_at(subs, i)
        address = F.regexp_extract(m, rf"^(?:{_ADDRESS})\.? ", 0)
        name = F.concat(address, F.array_join(F.zip_with(_name_parts(m), subs, _cased), " "))
        email = F.concat(F.substring_index(one(1), "@", 1), F.lit("@"), one(2))
        d = _digits(m)
        phone = F.concat(F.substr(d, F.lit(1), F.length(d) - F.length(national(m))), one(1))
        digits = F.when(kind == "phone", phone).otherwise(one(1))
        return (F.when(part != "", _cased(m, one(1)))
                .when(kind == "email", F.when((F.upper(m) == m) & m.rlike("[A-Z]"), F.upper(email)).otherwise(email))
                .when(kind == "ip", one(1)).when(kind.isin("card", "phone"), _poured(m, digits, "[0-9]"))
                .when(kind == "iban", _poured(m, one(1), "[A-Z0-9]")).when((kind == "name") & (F.size(subs) > 0), name).otherwise(m))

    return _let(F.transform(entities(m, part, genders), s), lambda subs: _let(kind_of(m), lambda kind: written(kind, subs)))


def _cut(t: Column, pattern) -> Column:
    """Array of (before, m): every match and the text between the last one and it; the last m is empty."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    marked = F.split(F.regexp_replace(t, F.concat(F.lit("("), p, F.lit(")")), F.lit(MARK + "$1" + MARK)), MARK, -1)
    once = _let(marked, lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - 1, F.lit(2)), lambda i: F.struct(
        F.get(x, i).alias("before"), F.coalesce(F.get(x, i + 1), F.lit("")).alias("m"))))
    # A text that holds the mark itself is searched twice instead.
    twice = F.zip_with(F.split(t, p, -1), F.regexp_extract_all(t, p, F.lit(0)), lambda b, m: F.struct(
        b.alias("before"), F.coalesce(m, F.lit("")).alias("m")))
    return F.when(F.contains(t, F.lit(MARK)), twice).otherwise(once)


def pieces(text: Column) -> Column:
    """A text in order as (before, m).  A match of no kind is searched once more for the mentions inside it."""
    again = lambda x: F.transform(_cut(x["m"], INNER), lambda y, i: F.struct(
        F.when(i == 0, F.concat(x["before"], y["before"])).otherwise(y["before"]).alias("before"), y["m"].alias("m")))
    whole = lambda x: (x["m"] == "") | kind_of(x["m"]).isNotNull()
    found = F.flatten(F.transform(_cut(text, ANY_KIND), lambda x: F.when(whole(x), F.array(x)).otherwise(again(x))))
    return F.when(text.rlike(HINT), found).otherwise(F.array(F.struct(text.alias("before"), F.lit("").alias("m"))))


def _of_names(p: DataFrame) -> DataFrame:
    """``pieces`` with the words of the document's names cut out where they stand alone, and ``genders`` of its given names."""
    names = F.filter(F.transform("pieces", lambda x: x["m"]), lambda m: kind_of(m) == "name")
    p = p.withColumn("names", F.when(F.size("pieces") > 1, names).otherwise(F.array().cast("array<string>")))
    each = F.flatten(F.transform("names", lambda m: _let(_name_parts(m), lambda w: F.transform(
        w, lambda x, i: F.struct(x.alias("word"), (i < F.size(w) - 1).alias("given"), gender(m).alias("sex"))))))
    p = p.withColumn("words", each)
    given = F.filter("words", lambda x: x["given"])
    sexes = lambda w, k: F.exists(given, lambda x: (F.lower(x["word"]) == w) & (x["sex"] == k))
    p = p.withColumn("genders", F.map_from_entries(F.transform(
        F.array_distinct(F.transform(given, lambda x: F.lower(x["word"]))), lambda w: F.struct(w, F.when(
            sexes(w, "f") & ~sexes(w, "m"), "f").when(sexes(w, "m") & ~sexes(w, "f"), "m").otherwise("u")))))
    alone = F.array_sort(F.array_distinct(F.transform(F.filter("words", lambda x: F.length(x["word"]) >= 3), lambda x: F.struct(
        -F.length(x["word"]), x["word"].alias("word")))))  # longer words first
    # Words are letters, apostrophes and dashes only.
    p = p.withColumn("pattern", F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(F.transform(alone, lambda x: x["word"]), "|"),
                                         F.lit(r")(?![\p{L}\p{N}])")))
    part = lambda w: F.when(F.map_contains_key("genders", F.lower(w)), "given").otherwise("family")
    plain = F.transform("pieces", lambda x: F.struct(x["before"].alias("before"), x["m"].alias("m"), F.lit("").alias("part")))
    cut = F.flatten(F.transform("pieces", lambda x: F.transform(_cut(x["before"], F.col("pattern")), lambda y: F.struct(
        y["before"].alias("before"), F.when(y["m"] == "", x["m"]).otherwise(y["m"]).alias("m"),
        F.when(y["m"] == "", "").otherwise(part(y["m"])).alias("part")))))
    return p.withColumn("pieces", F.when(F.size(alone) > 0, cut).otherwise(plain)).drop("names", "words", "pattern")


def searched(docs: DataFrame) -> DataFrame:
    """Positional columns, ``pieces`` and ``genders``, in a written table; a text with mentions is there as its pieces only."""
    p, names = positional(docs)
    text = at(names, "text")
    p = _of_names(p.withColumn("pieces", pieces(text)))
    some = F.size("pieces") > 1
    cols = [F.when(~some | text.isNull(), text).alias(f"_c{i}") if n == "text" else F.col(f"_c{i}") for i, n in enumerate(names)]
    return write_shared(p.select(*cols, F.when(some, F.col("pieces")).alias("pieces"), F.when(some, F.col("genders")).alias("genders")), "pii-pieces")


def _mentioned(found: DataFrame, *more) -> DataFrame:
    """(more, kind, entity, gender) of every mention."""
    m = found.filter("pieces is not null").select(*more, F.explode("pieces").alias("x"), "genders").filter("x.m <> ''")
    return (m.select(*more, F.explode(entities(F.col("x.m"), F.col("x.part"), F.col("genders"))).alias("e")).select(*more, "e.kind", "e.entity", "e.gender"))


def entity_table(found: DataFrame) -> DataFrame:
    """Distinct (kind, entity) of :func:`searched` documents, the gender over all of them and whether they disagree."""
    g = _mentioned(found).groupBy("kind", "entity").agg(F.max(F.col("gender") == "f").alias("f"), F.max(F.col("gender") == "m").alias("m"),
                                                        F.min("gender").alias("g0"), F.max("gender").alias("g1"))
    sex = F.when(F.col("kind") != "given", "").when(F.col("f") & ~F.col("m"), "f").when(F.col("m") & ~F.col("f"), "m").otherwise("u")
    return g.select("kind", "entity", sex.alias("gender"), (F.col("g0") != F.col("g1")).alias("mixed"))


def numbers(found: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, entity, nonce, gender) of the entities whose number is not 0 or whose gender documents disagree on.  Of the
    entities of a kind that have one surrogate all but the smallest, and those whose surrogate is an entity, move on to
    their next number, until none collide."""
    state = write_shared(found, "entities")
    known = state.select(F.col("kind").alias("ok"), F.col("entity").alias("oe"))
    state = state.withColumn("nonce", F.lit(0))
    turn = 0
    while True:
        state = write_shared(state.withColumn("s", surrogate(F.col("kind"), F.col("entity"), F.col("gender"), F.col("nonce"), key)), "surrogates")
        twice = (state.groupBy("kind", "s").agg(F.min("entity").alias("keeps"), F.count("*").alias("n")).filter("n > 1")
                 .select(F.col("kind").alias("ck"), F.col("s").alias("cs"), "keeps"))
        taken = (state.join(twice, (F.col("kind") == F.col("ck")) & (F.col("s") == F.col("cs"))).filter("entity <> keeps")
                 .select(F.col("kind").alias("tk"), F.col("entity").alias("te")))
        if turn < ORIGINALS:
            same = state.join(known, (F.col("kind") == F.col("ok")) & (F.col("s") == F.col("oe")))
            taken = taken.unionByName(same.select(F.col("kind").alias("tk"), F.col("entity").alias("te"))).distinct()
        taken = write_shared(taken, "collisions")
        if taken.isEmpty():
            return state.filter("nonce > 0 or mixed").select("kind", "entity", "nonce", "gender")
        state = (state.drop("s").join(taken, (F.col("kind") == F.col("tk")) & (F.col("entity") == F.col("te")), "left")
                 .withColumn("nonce", F.col("nonce") + F.col("tk").isNotNull().cast("int")).drop("tk", "te"))
        turn += 1


COUNTED = ("email", "phone", "card", "ip", "iban", "name")


def replace_pii(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with surrogates in ``text``, and n_email, n_phone, n_card, n_ip,
    n_iban, n_name (mentions replaced, words of names standing alone included) after the input's columns."""
    names = docs.columns
    found = searched(docs)
    extra = write_shared(numbers(entity_table(found), key), "renumbered")
    none = F.lit(None).cast("map<string,struct<nonce:int,gender:string>>")
    if extra.isEmpty():
        p = found.withColumn("told", none)
    else:
        # Only documents that mention such an entity get a map.
        p = found.withColumn("doc", F.when(F.col("pieces").isNotNull(), F.xxhash64("pieces")))
        told = (_mentioned(p, "doc").select("doc", "kind", "entity").distinct().join(extra, ["kind", "entity"])
                .groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct(
                    F.concat_ws("\x1f", "kind", "entity"), F.struct("nonce", "gender")))).alias("told")).withColumnRenamed("doc", "of"))
        told = write_shared(told, "told")
        n = told.agg(F.count("*"), F.coalesce(F.sum(F.size("told")), F.lit(0))).first()
        # Texts travel only where the table is too large for a broadcast; they are never sorted.
        told = F.broadcast(told) if n[0] <= TOLD_ROWS and n[1] <= 10 * TOLD_ROWS else told.hint("shuffle_hash")
        p = p.join(told, F.col("doc") == F.col("of"), "left")
    told_of = lambda kind, entity: F.try_element_at("told", F.concat_ws("\x1f", kind, entity))
    joined = F.array_join(F.transform("pieces", lambda x: F.concat(x["before"], F.when(x["m"] == "", "").otherwise(
        rewritten(x["m"], x["part"], F.col("genders"), told_of, key)))), "")
    kinds = F.transform("pieces", lambda x: F.when(x["part"] != "", "name").otherwise(kind_of(x["m"])))
    counts = [F.coalesce(F.size(F.filter("kinds", lambda k: k == n)), F.lit(0)).cast("long").alias(f"n_{n}") for n in COUNTED]
    p = p.withColumn("kinds", F.coalesce(kinds, F.array().cast("array<string>")))
    text = f"_c{names.index('text')}"
    p = p.withColumn("new", F.when(F.col("pieces").isNotNull(), joined).otherwise(F.col(text)))
    out = p.select(*[F.col("new") if n == "text" else F.col(f"_c{i}") for i, n in enumerate(names)], *counts)
    return out.toDF(*names, *[f"n_{n}" for n in COUNTED])
