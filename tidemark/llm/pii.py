"""Surrogates for personal data and secrets, with DataFrame functions only.

Entities are found by patterns. Every distinct entity gets one surrogate by a
keyed hash, wherever it occurs, so mentions of one entity still agree. A
surrogate keeps its entity's type, format and script: letters become letters of
the same script and case, digits become digits, separators stay; names follow
the gender of their form of address, word by word, so a family name has one
surrogate in all names that bear it; card numbers keep passing or failing the checksum; addresses keep the width of their parts. All surrogates are then
checked against each other and against all entities of the corpus, and those
that collide are drawn again; after a few draws, the rest get the free values of
their format by rank. So different entities never share a surrogate. Only a
format with no value left gives way to a wider one (a place more; addresses get
parts of three digits, then version 6).

Texts are searched once and written cut at their entities; only distinct
entities are drawn, texts without an entity are passed through, and texts with
one are joined with their own surrogates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import join_by_size, remove, written

#: Forms of address that tell a gender, or none.
MALE = "Mr|Mister|Herr|Herrn|Monsieur|Señor|Sr|Don|Господин|г-н|Κύριος"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Mademoiselle|Mlle|Señora|Sra|Srta|Doña|Госпожа|г-жа|Κυρία"
NEUTRAL = "Dr|Prof|Professor|Mx"
#: Words that a name of two or three words without a form of address follows.
CUES = r"[Cc]ontact|[Rr]egards,|[Ww]ishes,|[Ss]incerely,|[Ss]igned(?: by)?:?|[Nn]ame:|[Ff]rom:|[Aa]ttn:?|Dear|[Mm]y name is|[Gg]r(?:ü|ue)(?:ß|ss)en?,?"

_NAME = r"\p{Lu}[\p{L}'’]+(?:-\p{Lu}[\p{L}'’]+)?"


def _named(titles: str) -> str:
    return rf"(?<![\p{{L}}\d])(?:{titles})\.? {_NAME}(?: {_NAME}){{0,2}}"


_TITLED = rf"(?:{MALE}|{FEMALE}|{NEUTRAL})\.? |(?:{CUES})\s{{1,3}}"
_HEX4 = r"[\dA-Fa-f]{1,4}"
_IPV6 = rf"(?<![\p{{L}}\d:.])(?=[A-Fa-f:]*\d)(?:(?:{_HEX4}:){{7}}{_HEX4}|(?:{_HEX4}:){{1,6}}(?::{_HEX4}){{1,6}}|::(?:{_HEX4}:){{0,6}}{_HEX4}|(?:{_HEX4}:){{1,7}}:)(?![\p{{L}}\d:])"

#: Kinds of entities and the patterns that find them, the first that fits wins.
PATTERNS = {
    "email": r"(?<![\p{L}\d])[\p{L}\d][\p{L}\d._%+-]*+@[A-Za-z\d](?:[A-Za-z\d-]{0,62}\.)+[A-Za-z]{2,24}(?![\p{L}\d])",
    "iban": r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?: ?[A-Z\d]{4}){2,7}(?: ?[A-Z\d]{1,3})?(?![\p{L}\d])",
    "secret": r"(?<![\p{L}\d])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|(?:AKIA|ASIA)[A-Z\d]{16}|(?:sk|pk|ghp|gho|xox[abp])[_-][A-Za-z\d_-]{16,}+)(?![\p{L}\d])",
    "card": r"(?<![\p{L}\d.])(?:\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?![\p{L}\d]|\.\d)",
    "ssn": r"(?<![\p{L}\d.-])\d{3}-\d{2}-\d{4}(?![\p{L}\d]|-\d)",
    "ip": _IPV6 + r"|(?<![\p{L}\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\d]|\.\d)",
    "phone": r"(?<![\p{L}\d.+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|[2-9]\d{2} [2-9]\d{2} \d{4}|(?=(?:[ /.-]?\d){9})(?!\d{1,2}[./-]\d{1,2}[./-]\d{4}(?!\d))0\d{1,4}[ /.-]\d{2,4}(?:[ .-]?\d{2,4}){1,4})(?![\p{L}\d]|[.-]\d)",
    "name_m": _named(MALE),
    "name_f": _named(FEMALE),
    "name_n": _named(NEUTRAL) + rf"|(?<![\p{{L}}\d])(?:{CUES})\s{{1,3}}(?!(?:{MALE}|{FEMALE}|{NEUTRAL})\b){_NAME}(?: {_NAME}){{1,2}}",
}
#: A group number changes as patterns are joined, so the card pattern's separator is spelt out here.
_CARD = PATTERNS["card"].replace(r"\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}", r"\d{13,19}|\d{4}(?: \d{4}){2} \d{1,7}|\d{4}(?:-\d{4}){2}-\d{1,7}")
#: All patterns, in their order, where a word begins; which are tried depends on its first character.
_SEARCH = r"(?<![\p{L}\d])(?:" + "|".join(
    rf"(?={first})(?:{'|'.join(_CARD if k == 'card' else PATTERNS[k] for k in kinds.split())})"
    for first, kinds in ((r"\p{L}", "email iban secret ip name_m name_f name_n"), (r"\d", "email secret card ssn ip phone"), ("[+(:]", "ip phone"))
) + ")"
#: What marks the ends of an entity in a text that was searched, and what its first character in the text itself becomes.
_END, _OWN = "\x01\x04", "\x01\x03"

#: Alphabets of the scripts, and syllables and first names that surrogate names are made of.
LATIN, CYRILLIC, GREEK = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"
SYLLABLES = {
    "latin": "bal ber bor cal cam dal den dor fal fen gar gil hal har kel kim lan lor mar mel nor pel ral rin sal sen tal tor val ver wil win".split(),
    "cyrillic": "бал бер бор вал вер гар дал ден дор зар кал кел лан лор мар мел нор пел рал рин сал сен тал тор фал фен хар чел шар шин яр юр".split(),
    "greek": "βαλ βερ γαρ δαλ δεν δορ ζαρ θαλ καλ κελ λαν λορ μαρ μελ νορ πελ ραλ ριν σαλ σεν ταλ τορ φαλ φεν χαρ".split(),
}
FIRST = {
    ("latin", "m"): "adam alan bruno carl david emil felix hugo ivan jakob karl leo marco nils oscar paul rolf simon theo victor".split(),
    ("latin", "f"): "alice anna bella clara diana elena emma flora greta helen irma julia karin laura maria nora olga paula rosa vera".split(),
    ("latin", "n"): "alex andrea chris dana eden jamie jules kim lou marion morgan noel robin sam sasha".split(),
    ("cyrillic", "m"): "алексей андрей борис виктор глеб денис егор иван кирилл лев максим олег павел роман тимур".split(),
    ("cyrillic", "f"): "алина анна вера галина дарья елена жанна зоя ирина ксения лидия мария нина ольга софья".split(),
    ("cyrillic", "n"): "саша женя валя шура слава".split(),
    ("greek", "m"): "αλέξης γιάννης δημήτρης κώστας νίκος παύλος πέτρος στέφανος".split(),
    ("greek", "f"): "άννα δάφνη ελένη ειρήνη ζωή κατερίνα μαρία σοφία".split(),
    ("greek", "n"): "άρτεμις φίλη χάρη".split(),
}


#: Endings of first names that are made of syllables.
ENDINGS = {
    ("latin", "m"): "us", ("latin", "f"): "a", ("latin", "n"): "e", ("cyrillic", "m"): "ан", ("cyrillic", "f"): "а", ("cyrillic", "n"): "и",
    ("greek", "m"): "ος", ("greek", "f"): "α", ("greek", "n"): "ι",
}


def _byte(hexes: Column, i: Column | int) -> Column:
    """The i-th byte of a hex stream."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.conv(hexes.substr((2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _stream(seed: Column, length: Column) -> Column:
    """At least ``length`` pseudo-random bytes in hex."""
    blocks = F.sequence(F.lit(0), F.greatest((length / 32).cast("int"), F.lit(0)))
    return F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat_ws(":", seed, b.cast("string")).cast("binary"), 256)), "")


def _pick(letters: str, byte: Column) -> Column:
    return F.lit(letters).substr((byte % len(letters) + 1).cast("int"), F.lit(1))


def _like(text: Column, seed: Column, hexadecimal: bool = False) -> Column:
    """``text`` (lower case) with every letter and digit replaced by one of its kind."""
    chars = F.split(text, "")
    # the stream's bytes are made once, block by block, so long keys take time in proportion
    blocks = F.sequence(F.lit(0), (F.length(text) / 32).cast("int"))
    of_block = lambda h: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda j: _byte(h, j))
    hashes = F.transform(blocks, lambda b: F.sha2(F.concat_ws(":", seed, b.cast("string")).cast("binary"), 256))
    stream = F.slice(F.flatten(F.transform(hashes, of_block)), F.lit(1), F.size(chars))

    def one(c: Column, b: Column) -> Column:
        out = F.when(c.rlike("^[0-9]$"), _pick("0123456789", b))
        if hexadecimal:
            out = F.when(c.rlike("^[0-9a-f]$"), _pick("0123456789abcdef", b))
        return (
            out.when(c.rlike(r"^\p{IsCyrillic}$"), _pick(CYRILLIC, b))
            .when(c.rlike(r"^\p{IsGreek}$"), _pick(GREEK, b))
            .when(c.rlike(r"^\p{L}$"), _pick(LATIN, b))
            .otherwise(c)
        )

    return F.array_join(F.zip_with(chars, stream, one), "")


def _luhn(digits: Column) -> Column:
    """The checksum of digits, modulo 10."""
    doubled = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10


def _card(norm: Column, seed: Column) -> Column:
    """Digits of the same length and first digit, whose checksum is right just if the entity's is."""
    drawn = F.concat(norm.substr(1, 1), _like(norm.substr(F.lit(2), F.length(norm) - 1), seed))
    body = drawn.substr(F.lit(1), F.length(drawn) - 1)
    right = ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("int")
    wrong = (right + 1 + _byte(F.sha2(seed.cast("binary"), 256), 3) % 9) % 10
    return F.concat(body, F.when(_luhn(norm) == 0, right).otherwise(wrong).cast("string"))


def _ip(norm: Column, seed: Column) -> Column:
    """Four numbers of as many digits as the entity's."""
    hexes = _stream(seed, F.lit(16))

    def one(part: Column, i: Column) -> Column:
        b = _byte(hexes, i)
        return F.when(F.length(part) == 1, 1 + b % 9).when(F.length(part) == 2, 10 + b % 90).otherwise(100 + b % 156).cast("string")

    return F.array_join(F.transform(F.split(norm, r"\."), one), ".")


def _name(norm: Column, gender: str, key: str, salt: Column) -> Column:
    """First names of the gender and a family name in the script of the entity's words.

    A word alone decides its surrogate in the first draw, so a family name is
    the same in "Mr A B" and "Mr B", and in "Ms C B".
    """
    words = F.split(norm, " ")

    def one(word: Column, i: Column) -> Column:
        seed = F.concat_ws(":", F.lit(key), salt, word)
        family = i == F.size(words) - 1
        hexes = F.sha2(seed.cast("binary"), 256)

        def of(script: str) -> Column:
            first = F.array(*map(F.lit, FIRST[script, gender]))
            parts = F.array(*map(F.lit, SYLLABLES[script]))
            syllable = lambda j: F.element_at(parts, (_byte(hexes, j) % len(SYLLABLES[script]) + 1).cast("int"))
            # family names have four syllables: a million of them in each script
            last = F.concat(*[syllable(j) for j in range(4)])
            number, count = _byte(hexes, 8), len(FIRST[script, gender])
            name = lambda n: F.element_at(first, (n % count + 1).cast("int"))
            return F.when(family, last).otherwise(F.when(name(number) == word, name(number + 1)).otherwise(name(number)))

        return F.when(word.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(word.rlike(r"\p{IsGreek}"), of("greek")).otherwise(of("latin"))

    return F.array_join(F.transform(words, one), " ")


def _scripts(word: Column, value) -> Column:
    """``value(script)`` for the script of a word."""
    return F.when(word.rlike(r"\p{IsCyrillic}"), value("cyrillic")).when(word.rlike(r"\p{IsGreek}"), value("greek")).otherwise(value("latin"))


def _first_name(norm: Column, gender: str, seed: Column, round_: Column) -> Column:
    """A first name of the gender in the script of the entity's: a known one in the first draw, two syllables and an ending later."""
    hexes = F.sha2(seed.cast("binary"), 256)

    def of(script: str) -> Column:
        known, parts = FIRST[script, gender], SYLLABLES[script]
        name = F.element_at(F.array(*map(F.lit, known)), (_byte(hexes, 8) % len(known) + 1).cast("int"))
        syllable = lambda j: F.element_at(F.array(*map(F.lit, parts)), (_byte(hexes, j) % len(parts) + 1).cast("int"))
        return F.when(round_ == 0, name).otherwise(F.concat(syllable(0), syllable(1), F.lit(ENDINGS[script, gender])))

    return _scripts(norm, of)


def parts_of(kind: Column, norm: Column) -> Column:
    """What of an entity has a surrogate of its own: each word of a name (first names by gender, the family name without), else the whole."""
    words = F.split(norm, " ")
    part = lambda k, n: F.struct(k.alias("kind"), n.alias("norm"))
    names = F.transform(words, lambda w, i: part(F.when(i == F.size(words) - 1, F.lit("name_n")).otherwise(F.concat(F.lit("frst_"), F.substring(kind, 6, 1))), w))
    return F.when(kind.startswith("name"), names).otherwise(F.array(part(kind, norm)))


def kind_of(raw: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(raw.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def norm_of(kind: Column, raw: Column) -> Column:
    """What mentions of one entity share: case, separators and forms of address don't count."""
    digits = F.regexp_replace(raw, r"[^\d]", "")
    name = F.lower(F.regexp_replace(raw, rf"^(?:{_TITLED})", ""))
    return (
        F.when(kind.isin("card", "ssn"), digits)
        .when(kind == "phone", F.concat(F.when(raw.startswith("+"), "+").otherwise(""), digits))
        .when(kind == "ip", F.lower(raw))
        .when(kind == "iban", F.lower(F.regexp_replace(raw, " ", "")))
        .when(kind.startswith("name"), name)
        .otherwise(F.lower(raw))
    )


def _domain(norm: Column, key: str) -> Column:
    """The surrogate of an address's domain, the same in all addresses."""
    domain, tail = F.regexp_extract(norm, r"@(.*)\.[^.]*$", 1), F.regexp_extract(norm, r"(\.[^.]*)$", 1)
    return F.concat(_like(domain, F.concat_ws(":", F.lit(key), F.lit("domain"), domain)), tail)


def drawn(kind: Column, norm: Column, round_: Column, key: str) -> Column:
    """The surrogate of an entity in a round of draws."""
    salt = round_.cast("string")
    seed = F.concat_ws(":", F.lit(key), salt, kind, norm)
    at = F.instr(norm, "@")
    email = F.concat(_like(norm.substr(F.lit(1), at - 1), seed), F.lit("@"), _domain(norm, key))
    phone = F.concat(F.regexp_extract(norm, r"^(\+?\d)", 1), _like(F.regexp_extract(norm, r"^\+?\d(.*)$", 1), seed))
    secret = F.when(norm.rlike("^[0-9a-f]+$"), _like(norm, seed, True)).otherwise(
        F.concat(F.regexp_extract(norm, r"^(akia|asia|[a-z]+[_-]|)", 1), _like(F.regexp_extract(norm, r"^(?:akia|asia|[a-z]+[_-]|)(.*)$", 1), seed))
    )
    return (
        F.when(kind == "email", email)
        .when(kind == "iban", F.concat(norm.substr(1, 2), _like(norm.substr(F.lit(3), F.length(norm)), seed)))
        .when(kind == "secret", secret)
        .when(kind == "card", _card(norm, seed))
        .when((kind == "ip") & norm.contains(":"), _like(norm, seed, True))
        .when(kind == "ip", _ip(norm, seed))
        .when(kind == "phone", phone)
        .when(kind == "frst_m", _first_name(norm, "m", seed, round_))
        .when(kind == "frst_f", _first_name(norm, "f", seed, round_))
        .when(kind == "frst_n", _first_name(norm, "n", seed, round_))
        .when(kind == "name_m", _name(norm, "m", key, salt))
        .when(kind == "name_f", _name(norm, "f", key, salt))
        .when(kind == "name_n", _name(norm, "n", key, salt))
        .otherwise(_like(norm, seed))
    )


def rendered(kind: Column, raw: Column, surrogate: Column) -> Column:
    """The surrogate in the format of a mention: its separators, case and form of address."""
    chars = F.split(raw, "")

    def fill(marks: str) -> Column:
        """Characters of the surrogate in turn wherever the mention has one that counts; those of a wider format follow."""
        begin = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
        step = lambda a, c: F.struct(
            F.concat(a["out"], F.when(c.rlike(marks), F.when(c.rlike(r"^\p{Lu}$"), F.upper(plain.substr(a["at"], F.lit(1)))).otherwise(plain.substr(a["at"], F.lit(1)))).otherwise(c)).alias("out"),
            (a["at"] + F.when(c.rlike(marks), 1).otherwise(0)).alias("at"),
        )
        return F.aggregate(chars, begin, step, lambda a: F.concat(a["out"], plain.substr(a["at"], F.length(plain))))

    title = F.regexp_extract(raw, rf"^({_TITLED})", 1)
    plain = F.when(kind.isin("card", "ssn", "phone"), F.regexp_replace(surrogate, r"[^\d]", "")).otherwise(surrogate)
    bare = raw.substr(F.length(title) + 1, F.length(raw))
    name = F.concat(title, F.when(F.upper(bare) == bare, F.upper(surrogate)).otherwise(F.initcap(surrogate)))
    return (
        F.when(kind.isin("card", "ssn", "phone"), fill(r"^\d$"))
        .when(kind == "iban", fill(r"^[A-Za-z\d]$"))
        .when(kind.startswith("name"), name)
        .when(kind == "ip", surrogate)
        .when((F.upper(raw) == raw) & (F.lower(raw) != raw), F.upper(surrogate))
        .when(F.lower(raw) == raw, surrogate)
        .otherwise(fill(r"(?s)^.$"))
    )


#: What the places of a format stand for; any other character of a format stands for itself.
_GENDERS = {("latin", "m"): "M", ("latin", "f"): "F", ("latin", "n"): "N", ("cyrillic", "m"): "Ш", ("cyrillic", "f"): "Ф", ("cyrillic", "n"): "Ж", ("greek", "m"): "Ω", ("greek", "f"): "Φ", ("greek", "n"): "Ψ"}
_FAMILIES = {"latin": "S", "cyrillic": "Я", "greek": "Σ"}
PLACES = {
    "0": list("0123456789"), "f": list("0123456789abcdef"), "a": list(LATIN), "я": list(CYRILLIC), "α": list(GREEK),
    "1": [str(i) for i in range(1, 10)], "2": [str(i) for i in range(10, 100)], "3": [str(i) for i in range(100, 256)], "V": ["fd"],
} | {code: FIRST[x] for x, code in _GENDERS.items()} | {code: SYLLABLES[x] for x, code in _FAMILIES.items()}
#: The widest format of addresses: private ones of version 6.
_WIDEST_IP = "Vff:" + ":".join(["ffff"] * 7)
#: Values of a format that are numbered at most; a format of more is never full.
_NUMBERED = float(1 << 52)


def _mask(text: Column, hexadecimal: bool = False) -> Column:
    """The format that ``_like`` keeps."""
    if hexadecimal:
        return F.regexp_replace(text, "[0-9a-f]", "f")
    # letters of the other scripts first, as the marks of a step are letters too
    text = F.regexp_replace(text, r"[\p{L}&&[^\p{IsCyrillic}\p{IsGreek}]]", "a")
    text = F.regexp_replace(F.regexp_replace(text, r"[\p{L}&&\p{IsCyrillic}]", "я"), r"[\p{L}&&\p{IsGreek}]", "α")
    return F.regexp_replace(text, "[0-9]", "0")


def form_of(kind: Column, norm: Column, key: str) -> Column:
    """The format of an entity's surrogate: what stands before and after, its places, the place that widens it, and the checksum of cards."""

    def form(head: Column | str, mask: Column, more: Column | str, tail: Column | str = "", check: Column | str = "") -> Column:
        as_column = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(as_column(head).alias("head"), mask.alias("mask"), as_column(tail).alias("tail"), as_column(check).alias("check"), as_column(more).alias("more"))

    def script(word: Column, codes: dict[str, str]) -> Column:
        return F.when(word.rlike(r"\p{IsCyrillic}"), codes["cyrillic"]).when(word.rlike(r"\p{IsGreek}"), codes["greek"]).otherwise(codes["latin"])

    def name(gender: str) -> Column:
        words = F.split(norm, " ")
        first = {s: c for (s, g), c in _GENDERS.items() if g == gender}
        mask = F.array_join(F.transform(words, lambda w, i: F.when(i == F.size(words) - 1, F.repeat(script(w, _FAMILIES), F.lit(4))).otherwise(script(w, first))), " ")
        return form("", mask, script(F.element_at(words, -1), _FAMILIES))

    def first(gender: Column) -> Column:
        ending = lambda s: F.when(gender == "m", ENDINGS[s, "m"]).when(gender == "f", ENDINGS[s, "f"]).otherwise(ENDINGS[s, "n"])
        return form("", F.repeat(script(norm, _FAMILIES), F.lit(2)), script(norm, _FAMILIES), _scripts(norm, ending))

    after = lambda pattern: F.regexp_extract(norm, pattern, 1)
    prefix = r"^(akia|asia|[a-z]+[_-]|)"
    return (
        F.when(kind == "email", form("", _mask(norm.substr(F.lit(1), F.instr(norm, "@") - 1)), "a", F.concat(F.lit("@"), _domain(norm, key))))
        .when(kind == "iban", form(norm.substr(1, 2), _mask(norm.substr(F.lit(3), F.length(norm))), "0"))
        .when((kind == "secret") & norm.rlike("^[0-9a-f]+$"), form("", _mask(norm, True), "f"))
        .when(kind == "secret", form(after(prefix), _mask(F.regexp_extract(norm, prefix + "(.*)$", 2)), "a"))
        .when(kind == "card", form(norm.substr(1, 1), F.repeat(F.lit("0"), F.length(norm) - 2), "0", "", F.when(_luhn(norm) == 0, "right").otherwise("wrong")))
        .when((kind == "ip") & norm.contains(":"), form("", _mask(norm, True), ""))
        .when(kind == "ip", form("", F.array_join(F.transform(F.split(norm, r"\."), lambda x: F.length(x).cast("string")), "."), ""))
        .when(kind == "phone", form(after(r"^(\+?\d)"), _mask(after(r"^\+?\d(.*)$")), "0"))
        .when(kind.startswith("frst"), first(F.substring(kind, 6, 1)))
        .when(kind == "name_m", name("m"))
        .when(kind == "name_f", name("f"))
        .when(kind == "name_n", name("n"))
        .otherwise(form("", _mask(norm), "0"))
    )


def _wider(form: Column) -> Column:
    """The next format when one is full: a place more; addresses get parts of three digits, then version 6."""
    ip = F.when(form["mask"].rlike(r"^[123]\.") & (form["mask"] != "3.3.3.3"), F.lit("3.3.3.3")).otherwise(F.lit(_WIDEST_IP))
    return form.withField("mask", F.when(form["more"] == "", ip).otherwise(F.concat(form["mask"], form["more"])))


def _places() -> Column:
    return F.create_map(*[x for code, values in PLACES.items() for x in (F.lit(code), F.array(*map(F.lit, values)))])


def _room(form: Column) -> Column:
    """How many values a format has, as far as they are numbered."""
    radix = F.create_map(*[x for code, values in PLACES.items() for x in (F.lit(code), F.lit(float(len(values))))])
    return F.aggregate(F.split(form["mask"], ""), F.lit(1.0), lambda a, c: F.least(a * F.coalesce(radix[c], F.lit(1.0)), F.lit(_NUMBERED))).cast("long")


def _value(form: Column, number: Column) -> Column:
    """The value of a format with a number from 0: its places are the number's digits."""
    places = _places()

    def step(a: Column, c: Column) -> Column:
        values = places[c]
        n = F.size(values).cast("long")
        out = F.concat(F.coalesce(F.element_at(values, (a["rest"] % n + 1).cast("int")), c), a["out"])
        return F.struct(out.alias("out"), F.when(values.isNull(), a["rest"]).otherwise(F.call_function("div", a["rest"], n)).alias("rest"))

    body = F.concat(form["head"], F.aggregate(F.reverse(F.split(form["mask"], "")), F.struct(F.lit("").alias("out"), number.cast("long").alias("rest")), step)["out"])
    right = ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("int")
    digit = F.when(form["check"] == "right", right).when(form["check"] == "wrong", (right + 1) % 10).cast("string")
    return F.concat(body, F.coalesce(digit, F.lit("")), form["tail"])


def _numbered(rows: DataFrame, order: Column) -> DataFrame:
    """``rows`` with their number ``n`` from 0 in each family and form, by counts of slices, so no task sees a whole form."""
    by = ["family", "form"]
    rows = rows.withColumn("slice", F.pmod(F.xxhash64(order), F.lit(256)))
    counts = rows.groupBy(*by, "slice").agg(F.count("*").alias("size"))
    starts = counts.select(*by, "slice", (F.sum("size").over(W.partitionBy(*by).orderBy("slice")) - F.col("size")).alias("start"))
    out = rows.join(starts, [*by, "slice"])
    return out.withColumn("n", F.col("start") + F.row_number().over(W.partitionBy(*by, "slice").orderBy(order)) - 1).drop("slice", "start")


def _assigned(entities: DataFrame, kept: DataFrame, left: DataFrame, key: str) -> DataFrame:
    """(kind, norm, surrogate) of ``left``, each a value of its format that neither ``kept`` nor ``entities`` has.

    The values of a format are numbered. In every turn each entity without a
    surrogate brings twice as many of the next numbers as before; those free go
    to the entities of the format by rank. A format whose numbers are used up is
    full, and what is left of it goes on in the next wider format, so this ends
    after about log(values taken / entities left) turns and never fails.
    """
    spark, family = entities.sparkSession, F.substring("kind", 1, 4)
    used = entities.select(family.alias("family"), F.col("norm").alias("value")).union(kept.select(family.alias("family"), F.col("surrogate").alias("value")))
    used, used_at = written(used.distinct(), "used")
    # an entity has one surrogate for all forms of address that give it the same format
    named = left.select("kind", "norm", family.alias("family"), form_of(F.col("kind"), F.col("norm"), key).alias("form"))
    named, named_at = written(named.withColumn("first", F.col("form")), "left")
    open_ = named.select("family", "norm", "first", "form", F.lit(0).cast("long").alias("base")).distinct()
    open_, open_at = written(open_, "open")
    done, paths, width = None, [used_at, named_at], 1
    while not open_.isEmpty():
        whole = W.partitionBy("family", "form")
        ranked = _numbered(open_.withColumn("base", F.max("base").over(whole)).withColumn("m", F.count("*").over(whole)), F.sha2(F.concat_ws(":", F.lit(key), "norm", F.to_json("first")).cast("binary"), 256))
        ranked, ranked_at = written(ranked.withColumn("room", _room(F.col("form"))), "ranked")
        begin = F.col("base") + F.col("n") * width
        offered = ranked.where(begin < F.col("room")).withColumn("end", F.least(begin + width, F.col("room")) - 1)
        # in two steps, as one array must not hold all numbers of a long range
        offered = offered.select("family", "form", "room", "end", F.explode(F.sequence(begin, F.col("end"), F.lit(4096).cast("long"))).alias("number"))
        offered = offered.select("family", "form", "room", F.explode(F.sequence("number", F.least(F.col("end"), F.col("number") + 4095))).alias("number"))
        # a format's numbers begin at a keyed place
        at = (F.pmod(F.xxhash64(F.lit(key), F.to_json("form")), F.col("room")) + F.col("number")) % F.col("room")
        free = offered.withColumn("value", _value(F.col("form"), at)).join(used, ["family", "value"], "left_anti")
        free = free.withColumn("turn", F.row_number().over(W.partitionBy("family", "value").orderBy("form"))).where(F.col("turn") == 1).select("family", "form", "value")
        given = _numbered(free, F.col("value"))
        new = ranked.join(given.select("family", "form", "n", "value"), ["family", "form", "n"], "left")
        new, new_at = written(new, "given")
        got = new.where("value is not null").select("family", "norm", "first", F.col("value").alias("surrogate"))
        done = got if done is None else done.unionByName(got)
        used = used.unionByName(got.select("family", F.col("surrogate").alias("value")))
        base = F.col("base") + F.col("m") * width
        full = base >= F.col("room")
        rest = new.where("value is null").select("family", "norm", "first", F.when(full, _wider(F.col("form"))).otherwise(F.col("form")).alias("form"), F.when(full, F.lit(0).cast("long")).otherwise(base).alias("base"))
        remove(spark, open_at)
        open_, open_at = written(rest, "open")
        paths += [ranked_at, new_at]
        width *= 2
    out, _ = written(named.join(done, ["family", "norm", "first"]).select("kind", "norm", "surrogate"), "assigned")
    remove(spark, open_at, *paths)
    return out


def surrogates(entities: DataFrame, key: str, rounds: int = 6) -> DataFrame:
    """(kind, norm, surrogate) for distinct (kind, norm): no two alike, none that is an entity itself.

    What still collides after ``rounds`` draws gets the free values of its format
    by rank, and values of a wider format where none is left.
    """
    state, path = written(entities.select("kind", "norm", F.lit(0).alias("round")).withColumn("surrogate", drawn(F.col("kind"), F.col("norm"), F.col("round"), key)), "surrogates")
    spark, family = entities.sparkSession, F.substring("kind", 1, 4)
    for last in [False] * (rounds - 1) + [True]:
        # bearers of one family name may share its surrogate, whatever their form of address
        order = W.partitionBy(family, "surrogate").orderBy("round", F.sha2(F.concat_ws(":", F.lit(key), "norm").cast("binary"), 256))
        ranked = state.withColumn("owner", F.first("norm").over(order))
        real = entities.select(family.alias("real_kind"), F.col("norm").alias("real")).distinct()
        checked = ranked.join(real, (family == F.col("real_kind")) & (F.col("surrogate") == F.col("real")), "left")
        checked, checked_at = written(checked.withColumn("again", (F.col("norm") != F.col("owner")) | F.col("real").isNotNull()).select("kind", "norm", "round", "surrogate", "again"), "surrogates")
        remove(spark, path)
        path = checked_at
        state = checked.drop("again")
        if not checked.where("again").limit(1).count():
            return state.select("kind", "norm", "surrogate")
        if last:
            break
        turn = F.when(F.col("again"), F.col("round") + 1).otherwise(F.col("round"))
        fresh = F.when(F.col("again"), drawn(F.col("kind"), F.col("norm"), F.col("round") + 1, key)).otherwise(F.col("surrogate"))
        state, at = written(checked.select("kind", "norm", turn.alias("round"), fresh.alias("surrogate")), "surrogates")
        remove(spark, path)
        path = at
    kept = checked.where("not again").select("kind", "norm", "surrogate")
    return kept.unionByName(_assigned(entities, kept, checked.where("again").select("kind", "norm"), key))


def replace(docs: DataFrame, key: str = "surrogate-key", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, text with surrogates, n_entities, and the kinds found (sorted, with repeats).

    A null text stays null with 0 entities. Rows with equal ids keep apart;
    rows that repeat give equal rows; null ids are kept. No rows give no rows;
    other columns are ignored. Names are found after a form of address, or a
    cue such as "contact" or "regards," (two words or three) only.
    """
    # texts are searched once, and cut at their entities: every second part is one
    marked = F.regexp_replace(F.replace(F.col(text_col), F.lit(_END[0]), F.lit(_OWN)), _SEARCH, f"{_END}$0{_END}")
    searched = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.split(marked, _END, -1).alias("parts"))
    searched, searched_at = written(searched, "searched")
    mentions = searched.where(F.size("parts") > 1).select("row", F.posexplode("parts").alias("at", "raw")).where("at % 2 = 1").withColumn("kind", kind_of(F.col("raw")))
    pieces = mentions.select("row", "at", "raw", "kind", F.posexplode(parts_of(F.col("kind"), norm_of(F.col("kind"), F.col("raw")))).alias("nth", "part"))
    pieces = pieces.select("row", "at", "raw", "kind", "nth", F.concat_ws(":", "part.kind", "part.norm").alias("entity"))
    pieces, pieces_at = written(pieces, "mentions")
    counted, counted_at = written(pieces.groupBy("entity").agg(F.count("*").alias("times")), "entities")
    named = lambda c: (F.substring_index(c, ":", 1).alias("kind"), F.col(c).substr(F.instr(c, ":") + 1, F.length(c)).alias("norm"))
    drawn_, drawn_at = written(surrogates(counted.select(*named("entity")), key), "drawn")
    table = drawn_.select(F.concat_ws(":", "kind", "norm").alias("entity"), "surrogate").join(counted, "entity")
    shown = join_by_size(pieces, table, "entity", "times", pieces.count()).repartition("row")
    shown = shown.groupBy("row", "at", "raw", "kind").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "surrogate"))), lambda x: x["surrogate"]), " ").alias("surrogate"))
    shown = shown.select("row", "at", "kind", rendered(F.col("kind"), F.col("raw"), F.col("surrogate")).alias("shown"))
    # a document's own surrogates, in order
    lists = shown.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "shown", "kind"))).alias("mentions"))
    gaps = F.transform(F.filter("parts", lambda x, i: i % 2 == 0), lambda x: F.replace(x, F.lit(_OWN), F.lit(_END[0])))
    text = F.array_join(F.flatten(F.transform(F.arrays_zip(gaps.alias("gap"), F.col("mentions.shown").alias("shown")), lambda x: F.array(x["gap"], F.coalesce(x["shown"], F.lit(""))))), "")
    changed = searched.where(F.size("parts") > 1).join(lists.hint("merge"), "row").select("id", text.alias("text"), F.size("mentions").cast("long").alias("n_entities"), F.sort_array(F.col("mentions.kind")).alias("kinds"))
    whole = F.replace(F.element_at("parts", 1), F.lit(_OWN), F.lit(_END[0]))
    same = searched.where(F.col("parts").isNull() | (F.size("parts") <= 1)).select("id", whole.alias("text"), F.lit(0).cast("long").alias("n_entities"), F.array().cast("array<string>").alias("kinds"))
    out, _ = written(changed.unionByName(same), "surrogated")
    remove(docs.sparkSession, searched_at, pieces_at, counted_at, drawn_at)
    return out.withColumnsRenamed({"id": id_col, "text": text_col})
