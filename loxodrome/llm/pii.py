"""PII surrogates: detected entities get keyed, type-consistent replacements.

Entities are found by one expression: e-mail addresses, credentials (token = "..." and the like),
IPv4 and IPv6 addresses, IBANs, card numbers, social security numbers, telephone numbers and names
after a form of address. None has a limit of length but those of its format.

An entity has one subject (a name has two: the surname, and the given name within it), which all
spellings of it share: the digits of a number with the country's code, an address in lower case, a
secret without its quotes, a surname without its feminine ending. What replaces a subject is drawn
from an HMAC-SHA256 under the caller's key of its kind, its canonical form and an attempt, and the
entity is then written anew as it was spelled: digits stay digits, letters stay letters of the same
case and script, punctuation stays; octets stay octets; card numbers keep their first digit and have a
valid check digit; telephone numbers keep the country's code; a form of address, and with it the
gender, stays, given names come from the gender's list in the same script, Cyrillic surnames agree
with the gender. "Mr. John Smith" and "Mr. Smith" share the surname's surrogate, and so do the
spellings of one telephone number with and without blanks or the code +1.

Distinctness: over all distinct subjects of the corpus the surrogates, in canonical form, are
compared with each other and with the subjects themselves; of those that collide all but one draw
again, with the next attempt, until none collides. From attempt WIDER_FROM on, the kinds whose forms
may be too few (e-mail addresses, secrets, telephone numbers, IBANs, names) grow by some characters.
What is left after MOST_ATTEMPTS is an error, never a shared surrogate. As a surrogate depends on
nothing but key, kind, canonical form and attempt, one subject has one surrogate in all documents.
Attempts above 0 are rare; only they are joined to the rows that hold such subjects, all other rows
are replaced in place without a shuffle.

All of it is SQL functions. Defined results: null text stays null and has no entities; text without
entities stays as it is; repeated rows are replaced alike; a null doc_id is no obstacle; an empty
table gives an empty result; extra columns are carried along. Names without a form of address are not
looked for, and full and shortened spellings of one IPv6 address count as two.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loxodrome.llm.common import Scratch

MOST_ATTEMPTS, WIDER_FROM = 64, 8
#: The setting that names the key, and the key of synthetic tables where there is none.
KEY_SETTING, SYNTHETIC_KEY = "spark.loxodrome.pii.key", "synthetic tables only"
#: Rows with subjects that had to draw again are broadcast up to so many.
BROADCAST_ROWS = 200_000

_ADDRESS = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Mlle|Sr|Sra|Señor|Señora|г-н|г-жа|господин|госпожа)"
_HEX = r"[0-9A-Fa-f]{1,4}"
#: Kind, pattern (no capturing groups), in order of precedence at one place.
KINDS = [
    ("email", r"(?<![\p{L}\p{Nd}._%+\-])[\p{L}\p{Nd}._%+\-]++@[\p{L}\p{Nd}][\p{L}\p{Nd}.\-]*\.\p{L}{2,}"),
    (
        "secret",
        r"(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b)\s{0,3}[=:]\s{0,3}(?:\"[^\"\s]{8,}+\"|'[^'\s]{8,}+'|[\"']?[A-Za-z0-9+/=~_.\-]{7,}[A-Za-z0-9+/=~_\-])|\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36,}+\b",
    ),
    ("ip6", rf"(?<![\w:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:2[0-9A-Fa-f]{{3}}|[fF][cCdDeE][0-9A-Fa-f]{{2}})(?::{_HEX}){{0,6}}::(?:{_HEX}(?::{_HEX}){{0,5}})?)(?![\w:])"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("phone", r"\+\d{1,3}[ .\-]?\(\d{1,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}\b|\(\d{3}\) ?\d{3}[ .\-]\d{4}\b|\+\d{1,3}(?:[ .\-]\d{2,4}){2,5}\b|\+\d{8,15}\b|\b\d{3}[.\-]\d{3}[.\-]\d{4}\b"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("card", r"(?<!\d)(?:\d{4}[ \-]){3}\d{4}(?!\d)|(?<![\d.])\d{13,19}(?![\d])"),
    ("name", rf"\b{_ADDRESS}\.? \p{{Lu}}[\p{{L}}'’\-]+(?: \p{{Lu}}[\p{{L}}'’\-]+)?"),
]
_BY_KIND = dict(KINDS)


def _any(*kinds: str) -> str:
    return "|".join(f"(?:{p})" for k, p in KINDS if k in kinds)


#: At a letter that begins a word those kinds that begin with one, elsewhere those that begin with a digit or a sign.
PATTERN = rf"(?=\p{{L}})(?<!\p{{L}})(?:{_any('email', 'secret', 'ip6', 'iban', 'name')})|(?=[0-9+(._%\-])(?:{_any('email', 'ip6', 'ip', 'phone', 'ssn', 'card')})"
#: What every entity holds: a digit or an @, or else one of these signs or words; literals are searched for first, as that is many times cheaper than an expression.
HINTS = [
    (["=", ":"], rf"(?i:token|secret|passw|key)|[0-9A-Fa-f]:(?:{_HEX})?:"),
    (["AKIA"], None),
    (["_"], r"gh[pousr]_"),
    (["Mr", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Mlle", "Sr", "Señor", "г-н", "г-ж", "господин", "госпожа"], rf"{_ADDRESS}\.? \p{{Lu}}"),
]
#: Marks that part entities from the text; the first that the text doesn't hold is used.
MARKS = ["\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3\ufdd4", "\ufdd5\ufdd6\ufdd7"]

#: First names by gender and script, and what surnames are made of.
NAMES = {
    ("m", "latin"): "James John Robert Michael David Thomas Daniel Paul Mark George Peter Simon Martin Felix Hugo Oscar".split(),
    ("f", "latin"): "Mary Anna Laura Emma Sarah Julia Alice Clara Nora Helen Lucia Marie Sofia Elena Ruth Vera".split(),
    ("n", "latin"): "Alex Robin Sam Charlie Jordan Taylor Morgan Casey Jamie Riley Quinn Avery Rowan Sasha Noel Kim".split(),
    ("m", "cyrillic"): "Иван Пётр Павел Олег Игорь Антон Денис Роман".split(),
    ("f", "cyrillic"): "Анна Ольга Ирина Мария Елена Дарья Вера Нина".split(),
    ("n", "cyrillic"): "Саша Женя Валя Слава Шура Вика Паша Тоня".split(),
}
ONSETS = {"latin": "B C D F G H K L M N P R S T V W".split(), "cyrillic": "Б В Г Д К Л М Н П Р С Т Ф Х З Ж".split()}
CORES = {"latin": "al en or is um an el it er on ar il as ur em ot".split(), "cyrillic": "ал ен ор ис ум ан ел ит ер он ар ил ас ур ем от".split()}
#: Endings of given names that are made up.
ENDINGS = {("m", "latin"): "o", ("f", "latin"): "a", ("n", "latin"): "y", ("m", "cyrillic"): "ий", ("f", "cyrillic"): "а", ("n", "cyrillic"): "и"}
MALE, FEMALE = r"^(?:Mr|Herr|Monsieur|Sr|Señor|г-н|господин)\b", r"^(?:Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Sra|Señora|г-жа|госпожа)\b"
LATIN_SMALL = "abcdefghijklmnopqrstuvwxyz"
CYRILLIC_SMALL, GREEK_SMALL = "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"
#: Countries' codes, by the telephone union's plan: 1 and 7, those of two digits, all others of three.
COUNTRY = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"


def key_of(spark: SparkSession) -> str:
    """The key that the session names; one that everybody knows where it names none, which is fit for synthetic tables only."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        logging.getLogger(__name__).warning("%s is not set: surrogates can be recomputed by anybody", KEY_SETTING)
    return key or SYNTHETIC_KEY


def mark(text: Column) -> Column:
    """A string that isn't in the text."""
    found = F.lit(MARKS[-1] * 2)
    for m in reversed(MARKS):
        found = F.when(~F.contains(text, F.lit(m)), F.lit(m)).otherwise(found)
    return found


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hinted(text: Column) -> Column:
    """False for texts that can hold no entity, which is cheap to tell."""
    found = text.rlike("[0-9@]")
    for literals, pattern in HINTS:
        some = F.contains(text, F.lit(literals[0]))
        for literal in literals[1:]:
            some = some | F.contains(text, F.lit(literal))
        found = found | (some if pattern is None else some & text.rlike(pattern))
    return found


def segments(text: Column) -> Column:
    """The text in parts; those at odd places (from 0) are entities. Null for text without entities."""
    cut = let(mark(text), lambda m: F.split(F.regexp_replace(text, F.lit(PATTERN), F.concat(m, F.lit("$0"), m)), m))
    return F.when(hinted(text), F.when(text.rlike(PATTERN), cut))


def kind_of(entity: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed(KINDS[:-1]):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def secret_parts(entity: Column) -> tuple[Column, Column]:
    """What introduces a secret with the quote before it, and the secret with what may end it."""
    lead = F.regexp_extract(entity, r"^((?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?)?(?s:.*)$", 1)
    return lead, F.substring(entity, F.char_length(lead) + 1, F.char_length(entity))


def name_parts(entity: Column) -> dict[str, Column]:
    """gender, given (null if there is none), surname, script of a name after a form of address, as spelled."""
    words = F.split(entity, " ")
    given = F.when(F.size(words) > 2, F.get(words, F.lit(1)))
    surname = F.get(words, F.size(words) - 1)
    script = F.when(surname.rlike(r"^\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin"))
    known = F.lit("n")
    for gender in ("f", "m"):
        known = F.when(given.isin(NAMES[gender, "latin"] + NAMES[gender, "cyrillic"]), F.lit(gender)).otherwise(known)
    gender = F.when(entity.rlike(MALE), F.lit("m")).when(entity.rlike(FEMALE), F.lit("f")).otherwise(known)
    return {"gender": gender, "given": given, "surname": surname, "script": script}


def _stem(surname: Column) -> Column:
    """A surname in lower case; Cyrillic ones without the feminine ending."""
    low = F.lower(surname)
    return F.regexp_replace(F.regexp_replace(low, r"(?<=[оеё]в|[иы]н)а$", ""), r"(?<=[сц]к)ая$", "ий")


def subjects(entity: Column, kind: Column) -> Column:
    """array<struct<kind, canon>>: what spellings of one entity have in common; of a name its surname, then its given name."""
    digits = F.regexp_replace(entity, r"[^0-9]", "")
    canon = (
        F.when(kind == "phone", F.when(F.startswith(entity, F.lit("+")), digits).otherwise(F.concat(F.lit("1"), digits)))
        .when(kind.isin("ssn", "card"), digits)
        .when(kind.isin("email", "ip6"), F.lower(entity))
        .when(kind == "iban", F.regexp_replace(entity, " ", ""))
        .when(kind == "secret", F.regexp_replace(secret_parts(entity)[1], r"[\"']$", ""))
        .otherwise(entity)
    )
    pair = lambda k, c: F.struct(k.alias("kind"), c.alias("canon"))
    n = name_parts(entity)
    stem = _stem(n["surname"])
    both = F.array(pair(F.lit("surname"), stem), pair(F.lit("given"), F.concat_ws("|", n["gender"], F.lower(n["given"]), stem)))
    return F.when(kind != "name", F.array(pair(kind, canon))).when(n["given"].isNull(), F.slice(both, 1, 1)).otherwise(both)


def _hmac(key: str, message: Column) -> Column:
    """HMAC-SHA256 in hexadecimal."""
    import hashlib

    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    pad = lambda x: F.lit(bytearray(b ^ x for b in raw))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), F.encode(message, "utf-8")), 256))), 256)


def _draws(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """128 numbers from 0 to 65535 of the subject; later places go round."""
    seed = _hmac(key, F.concat_ws("|", kind, attempt.cast("string"), canon))
    hexes = lambda s: F.concat(*[F.sha2(F.concat(s, F.lit(str(k))), 256) for k in range(8)])
    return let(let(seed, hexes), lambda h: F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: F.conv(F.substring(h, i * 4 + 1, F.lit(4)), 16, 10).cast("int")))


def _at(draws: Column, i: Column) -> Column:
    """The number for the place i; from the 129th place on the numbers come again, each time with others added."""
    round_ = F.floor(i / 128).cast("int")
    return F.get(draws, i % 128) + F.when(round_ > 0, F.get(draws, round_ % 128)).otherwise(0)


def _pick(choices: str | list[str], n: Column) -> Column:
    """One of the letters, or of the words of a list, by the number n."""
    if isinstance(choices, str):
        return F.substring(F.lit(choices), (n % len(choices) + 1).cast("int"), F.lit(1))
    return F.get(F.split(F.lit(" ".join(choices)), " "), (n % len(choices)).cast("int"))


def _alike(c: Column, n: Column) -> Column:
    """Another character of the kind of c, by the number n."""
    large = F.upper(c) == c
    small = (
        F.when(c.rlike(r"^[a-zA-Z]$"), _pick(LATIN_SMALL, n))
        .when(c.rlike(r"^\p{IsCyrillic}$"), _pick(CYRILLIC_SMALL, n))
        .when(c.rlike(r"^\p{IsGreek}$"), _pick(GREEK_SMALL, n))
        .when(c.rlike(r"^\p{IsLatin}$"), _pick(LATIN_SMALL, n))
        .otherwise(c)
    )
    return F.when(c.rlike(r"^[0-9]$"), (n % 10).cast("string")).when(c.rlike(r"^\p{L}$"), F.when(large, F.upper(small)).otherwise(small)).otherwise(c)


def _same_form(canon: Column, draws: Column, first: Column, last: Column) -> Column:
    """Every letter and digit for another of its kind; the characters before the place first and from the place last on stay."""
    return F.array_join(F.transform(F.split(canon, ""), lambda c, i: F.when((i < first) | (i >= last), c).otherwise(_alike(c, _at(draws, i)))), "")


def _as_hex(canon: Column, draws: Column) -> Column:
    """Every hexadecimal digit for another, in the case of small letters."""
    return F.array_join(F.transform(F.split(canon, ""), lambda c, i: F.when(c.rlike("^[0-9a-f]$"), F.lower(F.hex(_at(draws, i) % 16))).otherwise(c)), "")


def _card(digits: Column, draws: Column) -> Column:
    """As many digits with the same first one; the last is the check digit."""
    chars = F.split(digits, "")
    n = F.size(chars)
    body = F.transform(F.slice(chars, F.lit(1), n - 1), lambda d, i: F.when(i == 0, d.cast("int")).otherwise(_at(draws, i) % 10))
    # from the right, every other digit of the body counts double
    counted = lambda b: F.aggregate(F.transform(b, lambda d, i: F.when((n - 2 - i) % 2 == 0, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d)), F.lit(0), lambda a, x: a + x)
    return let(body, lambda b: F.array_join(F.concat(b, F.array(((10 - counted(b) % 10) % 10).cast("int"))), ""))


def _syllables(script: str, draws: Column, first: int, n: int) -> Column:
    parts = [(_pick(ONSETS[script], F.get(draws, F.lit(first + 2 * k))), _pick(CORES[script], F.get(draws, F.lit(first + 2 * k + 1)))) for k in range(n)]
    return F.lower(F.concat(*[p for pair in parts for p in pair]))


def _surname(canon: Column, draws: Column, wide: Column) -> Column:
    latin = F.concat(_syllables("latin", draws, 1, 3), F.when(wide, _syllables("latin", draws, 20, 2)).otherwise(F.lit("")))
    cyrillic = F.concat(_syllables("cyrillic", draws, 1, 3), F.when(wide, _syllables("cyrillic", draws, 20, 2)).otherwise(F.lit("")), F.lit("ов"))
    return F.when(canon.rlike(r"^\p{IsCyrillic}"), cyrillic).otherwise(latin)


def _given(canon: Column, draws: Column, wide: Column) -> Column:
    """A given name within the same surname: gender, name, surname, as in the subject."""
    gender, given = F.substring_index(canon, "|", 1), F.get(F.split(canon, r"\|"), F.lit(1))
    out = F.lit("")
    for (g, script), names in NAMES.items():
        here = (gender == g) & (given.rlike(r"^\p{IsCyrillic}") == F.lit(script == "cyrillic"))
        made = F.when(wide, F.concat(_syllables(script, draws, 1, 3), F.lit(ENDINGS[g, script]))).otherwise(F.lower(_pick(names, F.get(draws, F.lit(0)))))
        out = F.when(here, made).otherwise(out)
    return F.concat_ws("|", gender, out, F.substring_index(canon, "|", -1))


def drawn(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The canonical form of what stands for a subject at this attempt."""
    wide = attempt >= WIDER_FROM
    n = F.char_length(canon)

    def of(draws: Column) -> Column:
        more = F.lower(F.hex(F.get(draws, F.lit(127)) + 4096))
        digits = F.when(wide, F.lpad((F.get(draws, F.lit(126)) % 10_000).cast("string"), 4, "0")).otherwise(F.lit(""))
        top = n - F.char_length(F.substring_index(canon, ".", -1)) - 1  # the top-level domain stays
        octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.get(draws, i) % 254 + 1).cast("string")), ".")
        hexed = canon.rlike(r"^[0-9a-f]+$")
        form = _same_form(canon, draws, F.when(kind == "iban", 2).when(kind == "phone", F.char_length(F.regexp_extract(canon, COUNTRY, 0))).otherwise(0), F.when(kind == "email", top).otherwise(n))
        return (
            F.when(kind == "ip", octets)
            .when(kind == "card", _card(canon, draws))
            .when(kind == "surname", _surname(canon, draws, wide))
            .when(kind == "given", _given(canon, draws, wide))
            .when(kind == "ip6", _as_hex(canon, draws))
            .when(kind == "secret", F.concat(F.when(hexed, _as_hex(canon, draws)).otherwise(form), F.when(wide, more).otherwise(F.lit(""))))
            .when(kind == "email", F.concat(F.when(wide, more).otherwise(F.lit("")), form))
            .otherwise(F.concat(form, digits))
        )

    return let(_draws(key, kind, canon, attempt), of)


def _filled(entity: Column, made: Column) -> Column:
    """The digits of an entity (and capitals of an IBAN), from the last one back, for those of made; what made has besides goes behind."""

    def put(chars: Column) -> Column:
        slots = lambda cs: F.size(F.filter(cs, lambda c: c.rlike("^[0-9A-Z]$")))
        return let(
            F.struct(slots(chars).alias("n"), F.char_length(made).alias("m")),
            lambda s: F.aggregate(
                chars,
                F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
                # the shorter of the two ends of made: a country's code that the entity leaves out is skipped
                lambda a, c: F.when(c.rlike("^[0-9A-Z]$"), F.struct(F.concat(a["out"], F.substring(made, a["at"] + 1 + F.greatest(s["m"] - s["n"], F.lit(0)), F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at"))),
                lambda a: a["out"],
            ),
        )

    return let(F.split(entity, ""), put)


def surrogate(key: str, entity: Column, attempt_of) -> Column:
    """What stands for the entity; attempt_of(kind, canon): the attempt of a subject."""

    def of(subject: Column) -> Column:
        return drawn(key, subject["kind"], subject["canon"], attempt_of(subject["kind"], subject["canon"]))

    def written(e: Column, kind: Column, own: Column, made: Column) -> Column:
        """own: the subjects; made: what stands for each."""
        first = F.get(made, F.lit(0))
        lead, secret = secret_parts(e)
        end = F.regexp_extract(secret, r"[\"']$", 0)
        cased = lambda new, old: F.when((F.upper(old) == old) & (F.char_length(old) > 1), F.upper(new)).otherwise(F.concat(F.upper(F.substring(new, F.lit(1), F.lit(1))), F.substring(new, F.lit(2), F.char_length(new))))

        def named(n: Column) -> Column:
            feminine = (n["gender"] == "f") & (n["script"] == "cyrillic")
            surname = cased(F.concat(first, F.when(feminine, F.lit("а")).otherwise(F.lit(""))), n["surname"])
            given = F.when(n["given"].isNull(), F.lit("")).otherwise(F.concat(cased(F.get(F.split(F.get(made, F.lit(1)), r"\|"), F.lit(1)), n["given"]), F.lit(" ")))
            return F.concat(F.substring_index(e, " ", 1), F.lit(" "), given, surname)

        # a number that grew has its new digits behind; the others fill the places of the old ones
        size, old = F.char_length(first), F.char_length(F.get(own, F.lit(0))["canon"])
        grown = F.concat(_filled(e, F.substring(first, F.lit(1), F.least(size, old))), F.substring(first, old + 1, size))
        return (
            F.when(kind == "name", let(F.struct(*[c.alias(k) for k, c in name_parts(e).items()]), named))
            .when(kind == "secret", F.concat(lead, first, end))
            .when(kind.isin("email", "ip", "ip6"), first)
            .otherwise(grown)
        )

    # each step is bound once, so that the expression of the draws is in the plan once
    subject_of = lambda s: let(subjects(s["e"], s["k"]), lambda own: let(F.transform(own, of), lambda made: written(s["e"], s["k"], own, made)))
    return let(F.struct(entity.alias("e"), kind_of(entity).alias("k")), subject_of)


def redrawn(scratch: Scratch, forms: DataFrame, key: str) -> DataFrame:
    """kind, canon, attempt of the distinct subjects (kind, canon) whose first surrogate collides."""
    new = lambda attempt: drawn(key, F.col("kind"), F.col("canon"), attempt)
    # dealt by a number of partitions, so that the few bytes of subjects are not drawn for in one task
    n = int(forms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = scratch.table(forms.repartition(n, "kind", "canon").select("kind", "canon", F.lit(0).alias("attempt"), new(F.lit(0)).alias("made")), few=True)
    for attempt in range(1, MOST_ATTEMPTS + 1):
        shared = state.groupBy("kind", "made").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("attempt", "canon")).alias("first")).filter("n > 1")
        # of equal surrogates the one with the fewest attempts and then the smallest form stays
        lost = state.join(shared.select("kind", "made", "first"), ["kind", "made"]).filter(F.struct("attempt", "canon") != F.col("first")).select("kind", "canon")
        real = state.join(forms.select("kind", F.col("canon").alias("made")), ["kind", "made"], "left_semi").select("kind", "canon")
        lost = scratch.table(lost.union(real).distinct())
        if lost.isEmpty():
            return state.filter("attempt > 0").select("kind", "canon", "attempt")
        if attempt == MOST_ATTEMPTS:
            kinds = sorted(r[0] for r in lost.select("kind").distinct().collect())  # ten kinds at most
            raise RuntimeError(f"no distinct surrogates after {MOST_ATTEMPTS} attempts: {', '.join(kinds)}")
        # all that draw now take the same new attempt
        again = state.join(lost, ["kind", "canon"], "left_semi").select("kind", "canon", F.lit(attempt).alias("attempt"), new(F.lit(attempt)).alias("made"))
        old, state = state, scratch.table(state.join(lost, ["kind", "canon"], "left_anti").union(again), few=True)
        scratch.drop(old)


def replaced(docs: DataFrame, key: str) -> DataFrame:
    """All columns of docs with entities in text replaced, and n_entities, kinds (sorted, distinct); docs: doc_id, text and others."""
    scratch = Scratch(docs.sparkSession, "pii")
    names = [c for c in docs.columns if c not in ("n_entities", "kinds")]
    text = F.col("text").cast("string")
    parts = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), segments(text).alias("parts"))
    row = [F.xxhash64("row.text").alias("k1"), F.xxhash64(F.lit(7), "row.text").alias("k2")]
    found = parts.filter(F.col("parts").isNotNull()).select(*row, F.explode(F.flatten(F.transform(F.filter("parts", lambda _, i: i % 2 == 1), lambda e: subjects(e, kind_of(e))))).alias("s"))
    uses = scratch.table(found.select("k1", "k2", "s.*"), few=True)  # the corpus is scanned for entities here and where they are replaced, and no third time
    forms = scratch.table(uses.select("kind", "canon").distinct())
    tries = redrawn(scratch, forms, key)
    if tries.isEmpty():
        return _out(parts, _written(key, None), names)
    # texts with a subject that drew again get its attempts; all others are replaced in place
    again = uses.join(tries, ["kind", "canon"]).distinct().groupBy("k1", "k2").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("kind", "canon").alias("k"), "attempt"))).alias("again"))
    again = scratch.table(again)
    held = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    return _out(parts.select("*", *row).join(held, ["k1", "k2"], "left"), _written(key, F.col("again")), names)


def _written(key: str, again: Column | None) -> Column:
    """The text of the row with a surrogate for each entity; again: attempts by kind and canonical form."""

    def attempt_of(kind: Column, canon: Column) -> Column:
        return F.lit(0) if again is None else F.coalesce(F.try_element_at(again, F.struct(kind.alias("kind"), canon.alias("canon"))), F.lit(0))

    made = F.transform(F.col("parts"), lambda p, i: F.when(i % 2 == 0, p).otherwise(surrogate(key, p, attempt_of)))
    return F.when(F.col("parts").isNull(), F.col("row.text")).otherwise(F.array_join(made, ""))


def _out(df: DataFrame, text: Column, names: list[str]) -> DataFrame:
    kinds = F.array_sort(F.array_distinct(F.transform(F.filter(F.col("parts"), lambda _, i: i % 2 == 1), kind_of)))
    n = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.floor(F.size("parts") / 2)).cast("bigint")
    return df.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names], n.alias("n_entities"), F.coalesce(F.array_join(kinds, ","), F.lit("")).alias("kinds"))
