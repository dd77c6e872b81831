r"""Personal data replaced by keyed surrogates (operator 10), in DataFrame expressions only.

One scan marks every entity with its type; the text is cut at the marks and joined again with a surrogate for each.
Surrogates come from a keyed format-preserving permutation: a Feistel network on the halves of an entity, where each
character moves within its own class (digits, lower, upper, hex digits; for names vowels and consonants of Latin, and the
letters of Cyrillic and Greek), so that script, case, length and layout stay. Known given and family names become
others of the same gender and script, in an order that the key chooses. Three facts follow by construction:

* coreference: equal entities, up to case or phone layout, get surrogates equal up to the same; a person's names are
  replaced word by word, and where a text names a person in full, its single names are replaced in the rest of it too;
* distinctness: different entities of a type get different surrogates, as a permutation is one to one, and the images of a
  type's formats are disjoint;
* no entity keeps its value: the permutation is P^-1(S(P(x))), where S moves one character by one place.

``replaced`` doesn't rely on that: it collects the distinct pairs of entity and surrogate over the whole table, and where
two entities share a surrogate, or one is its own, the table is done again with the next key.

Types keep what makes them valid: e-mail keeps its top-level domain, a phone its country code, a card its first
digit and whether its Luhn digit is right, an IBAN its country and whether its check digits are right, an address four
octets, a key its prefix; an honorific stays.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import _let
from .shared import materialise

ROUNDS = 6
KEY = "quillon"

# Given names by gender and script, family names, honorifics and credential words.
GIVEN = {
    ("f", "latin"): ["Alice", "Anna", "Barbara", "Carmen", "Caroline", "Charlotte", "Claire", "Dorothy", "Elena", "Elizabeth", "Emily", "Emma", "Hannah", "Helen", "Isabel", "Jennifer", "Julia", "Karen", "Katharina", "Laura", "Linda", "Lucy", "Margaret", "Maria", "Mary", "Monika", "Nancy", "Olivia", "Patricia", "Rachel", "Sandra", "Sarah", "Sophie", "Susan", "Teresa", "Victoria"],
    ("m", "latin"): ["Alexander", "Andrew", "Anthony", "Antonio", "Carlos", "Charles", "Christopher", "Daniel", "David", "Edward", "Francisco", "Frank", "George", "Hans", "Henry", "Jack", "Jacques", "James", "John", "Joseph", "Juan", "Klaus", "Louis", "Martin", "Matthew", "Michael", "Miguel", "Oliver", "Paul", "Peter", "Pierre", "Richard", "Robert", "Stefan", "Thomas", "William"],
    ("f", "cyrillic"): ["Анна", "Вера", "Галина", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна"],
    ("m", "cyrillic"): ["Александр", "Алексей", "Андрей", "Борис", "Владимир", "Дмитрий", "Иван", "Михаил", "Николай", "Сергей"],
    ("f", "greek"): ["Άννα", "Ειρήνη", "Ελένη", "Κατερίνα", "Μαρία", "Σοφία"],
    ("m", "greek"): ["Ανδρέας", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος"],
}
FAMILY = ["Anderson", "Becker", "Bernard", "Campbell", "Castillo", "Davies", "Dubois", "Durand", "Evans", "Fernández", "Fischer", "Flores", "Fournier", "García", "Girard", "González", "Hernández", "Hoffmann", "Hughes", "Jackson", "Jenkins", "Johnson", "Jones", "Krüger", "Lambert", "Laurent", "Lefebvre", "López", "Martínez", "Mercier", "Meyer", "Miller", "Moreau", "Müller", "Nguyen", "Patel", "Pérez", "Ramírez", "Rodríguez", "Roussel", "Ruiz", "Sánchez", "Schmidt", "Schneider", "Schulz", "Silva", "Singh", "Smith", "Taylor", "Thompson", "Torres", "Wagner", "Walker", "Weber", "Williams", "Wilson"]
HONORIFICS = {"m": ["Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "господин"], "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа"], "": ["Dr", "Prof"]}
CREDENTIALS = ["password", "passwd", "pwd", "token", "secret", "api_key", "api-key", "apikey", "access_key", "private_key", "auth_key"]

_NAME = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}+(?:[-'’]\p{Lu}\p{Ll}+){0,4}"


def _any_of(words: list[str]) -> str:
    """A pattern of the words as a tree of their letters, which fails at the first letter that none has."""
    tree: dict[str, list[str]] = {}
    for w in words:
        tree.setdefault(w[:1], []).append(w[1:])
    return "|".join(c + (f"(?:{_any_of(rest)})" if rest != [""] else "") for c, rest in sorted(tree.items(), reverse=True))


_ALL_GIVEN = _any_of([n for names in GIVEN.values() for n in names])
_ALL_FAMILY = _any_of(FAMILY)
_ALL_HONORIFICS = _any_of([h for x in HONORIFICS.values() for h in x])
_INITIALS = "A-ZÀ-ÞͰ-ϿЀ-ӿ"  # ranges that hold the first letters of all these words
_CREDENTIAL = rf"(?=[{''.join(sorted({f(w[0]) for w in CREDENTIALS for f in (str.lower, str.upper)}))}])(?<![A-Za-z0-9_])(?i:{_any_of(CREDENTIALS)})"

# Telephone numbers beside the North American layout: with a country code; with a leading 0, as in Britain, Germany and
# France, but no date; of nine digits, as in Spain; ten or so digits after a word for a telephone.
_ABROAD = r"(?<![0-9A-Za-z])\+(?=[0-9](?:\)?[ .\-/]?\(?[0-9]){7,14}(?![0-9A-Za-z]))[0-9]{1,4}(?:[ .\-/]?\([0-9]{1,5}\))?[ .\-/]?[0-9]{1,12}(?:[ .\-/][0-9]{2,9}){0,6}(?![0-9A-Za-z])"
_TRUNK = r"(?<![0-9A-Za-z+])(?<![0-9][ .,:/\-])(?![0-3][0-9][./\-][01][0-9][./\-][0-9]{4})(?=\(?0(?:\)?[ .\-/]?[0-9]){8,11}(?![0-9A-Za-z]))(?:\(0[1-9][0-9]{0,4}\)[ .\-/]?|0[1-9][0-9]{0,4}[ .\-/])[0-9]{2,9}(?:[ .\-][0-9]{2,8}){0,4}(?![0-9A-Za-z])"
_NINE = r"(?<![0-9A-Za-z+])(?<![0-9][ .,:/\-])[6-9][0-9](?:[0-9][ \-][0-9]{3}[ \-][0-9]{3}|[0-9](?:[ \-][0-9]{2}){3}|[ \-][0-9]{3}(?:[ \-][0-9]{2}){2})(?![0-9A-Za-z]|[ .,\-][0-9])"
_CUED = r"(?=[0-9]{9,11}(?![0-9A-Za-z]))(?<=(?i:\b(?:phone|telephone|tel|mobile|cell|fax|call|teléfono|téléphone|telefon)[.]?[\x20\t]{0,2}[:]?[\x20\t]{0,2}))[0-9]{9,11}(?![0-9A-Za-z])"

#: type -> pattern, tried in this order at each place.
PATTERNS = {
    "credential": r"(?<=[=:\x20\t\"'])(?<=(?i:\b(?:" + "|".join(CREDENTIALS) + r")[\"']{0,1}[\x20\t]{0,3}[=:][\x20\t]{0,3}[\"']{0,1}))(?=[^\s\"'<>A-Za-z0-9]{0,40}[A-Za-z0-9])[^\s\"'<>]{5,}[^\s\"'<>.,;:)\]}]",
    "key": r"\bAKIA[0-9A-Z]{16}\b",
    "email": r"(?<![\p{L}0-9._%+\-])[\p{L}0-9._%+\-]*[\p{L}0-9_%+\-]@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?){0,30}\.[A-Za-z]{2,}(?![A-Za-z0-9])",
    "ip": r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9A-Za-z]|\.[0-9])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]{0,20}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5}|[0-9A-Fa-f]{4}:(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "ssn": r"(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z\-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[0-9A-Z]{11,30}|(?:[ ][0-9A-Z]{4}){2,7}(?:[ ][0-9A-Z]{1,3})?)(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])(?:(?:[3-6][0-9]{3}|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)(?:[ \-]?[0-9]{4}){2}[ \-]?[0-9]{1,4}|3[47][0-9]{2}[ \-][0-9]{6}[ \-][0-9]{5}|3[0689][0-9]{2}[ \-][0-9]{6}[ \-][0-9]{4})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\)[ .\-]?|[0-9]{3}[ .\-])[0-9]{3}[ .\-]?[0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])\+[0-9]{8,15}(?![0-9A-Za-z])" + "".join(f"|(?:{x})" for x in (_ABROAD, _TRUNK, _NINE, _CUED)),
    "person": rf"(?=[{_INITIALS}])(?<!\p{{L}})(?:(?:(?:{_ALL_HONORIFICS})\.?[ ]){{1,3}}(?!(?:{_ALL_HONORIFICS})(?!\p{{L}})){_NAME}(?:[ ]{_NAME})?|(?:{_ALL_GIVEN})[ ]{_NAME}|(?:{_ALL_FAMILY}),[ ](?:{_ALL_GIVEN}))(?!\p{{L}})",
}
KINDS = list(PATTERNS)
#: Every entity, the type as the number of the group.
ANY = "|".join(f"({p})" for p in PATTERNS.values())
#: A cheap test that every text with an entity passes.
HINT = rf"[0-9@]|{_CREDENTIAL}|(?=[{_INITIALS}])(?<!\p{{L}})(?:{_ALL_HONORIFICS}|{_ALL_GIVEN})(?!\p{{L}})"

# Marks between pieces, and between the groups of an entity: code points that are no characters. A text that holds one
# itself has it written as an escape and one more such code point while it is scanned.
_CUT, _FIELD, _ESCAPE = "\ufdd0", "\ufdd1", "\ufdd2"
_ESCAPED = {_ESCAPE: _ESCAPE + "\ufdd5", _CUT: _ESCAPE + "\ufdd3", _FIELD: _ESCAPE + "\ufdd4"}

_LOWER, _UPPER, _DIGIT, _HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
_CLASSES = {
    "text": [_DIGIT, _LOWER, _UPPER],
    "secret": [_DIGIT, _LOWER[:6], _LOWER[6:], _UPPER[:6], _UPPER[6:]],
    "hex": [_HEX],
    "digits": [_DIGIT],
    "base36": [_DIGIT + _UPPER],
    "name": ["aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "áéíóúàèìòùâêîôûäëïöü", "ÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜ", "ñçß", "ÑÇ", "абвгдежзийклмнопрстуфхцчшщыэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "άέήίόύώ", "ΆΈΉΊΌΎΏ"],
}


def _literals(values: list) -> Column:
    """An array of numbers or words as one literal."""
    return F.expr("array(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")")


def _characters(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


#: The alphabets of the kinds of permutation, and for each of their letters where its class begins and how large it is.
_ALPHABETS = {k: "".join(c) for k, c in _CLASSES.items()}
_BEGIN = "array(" + ", ".join("array(" + ", ".join(str(sum(map(len, c[:k]))) for k, x in enumerate(c) for _ in x) + ")" for c in _CLASSES.values()) + ")"
_SIZE = "array(" + ", ".join("array(" + ", ".join(str(len(x)) for x in c for _ in x) + ")" for c in _CLASSES.values()) + ")"


def _moved(c: Column, by: Column, kind: Column) -> Column:
    """The character ``by`` places further in its class, cyclically; others stay. kind: the place of an alphabet in _CLASSES."""
    letters = F.get(_literals(list(_ALPHABETS.values())), kind)

    def at(place: Column) -> Column:
        first, many = F.get(F.get(F.expr(_BEGIN), kind), place - 1), F.get(F.get(F.expr(_SIZE), kind), place - 1)
        return F.when(place > 0, F.substring(letters, first + F.pmod(place - 1 - first + by, many) + 1, F.lit(1))).otherwise(c)

    return _let(F.instr(letters, c), at)


def permute(text: Column, secret: Column, kind: Column) -> Column:
    """The keyed permutation of strings of one format, without fixed points where any character has a class.

    A Feistel network on the halves of the text forwards, one character moved by one place, the network backwards.
    In a round each character of one half moves by a digest of the other, without regard to case.
    """
    rounds = [(r, 1) for r in range(ROUNDS)] + [(0, 0)] + [(r, -1) for r in reversed(range(ROUNDS))]
    steps = F.expr("array(" + ", ".join(f"struct({r} AS r, {sign} AS sign)" for r, sign in rounds) + ")")
    half = F.floor(F.length(text) / 2).cast("int")

    def split(x: Column) -> Column:
        return F.struct(F.substring(x, F.lit(1), half).alias("a"), F.substring(x, half + 1, F.length(x)).alias("b"))

    def turned(own: Column, other: Column, r: Column, sign: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", secret, r.cast("string"), F.length(own).cast("string"), F.lower(other)), 256)
        amount = lambda d, i: F.conv(F.substring(d, F.pmod(i, F.lit(16)) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        return _let(digest, lambda d: F.array_join(F.transform(_characters(own), lambda c, i: _moved(c, sign * amount(d, i), kind)), ""))

    def shifted(x: Column) -> Column:
        letters = F.get(_literals(list(_ALPHABETS.values())), kind)
        first = F.array_position(F.transform(_characters(x), lambda c: F.instr(letters, c) > 0), F.lit(True)).cast("int")
        return _let(first, lambda n: F.when(n == 0, x).otherwise(F.concat(F.substring(x, F.lit(1), n - 1), _moved(F.substring(x, n, F.lit(1)), F.lit(1), kind), F.substring(x, n + 1, F.length(x)))))

    def step(s: Column, at: Column) -> Column:
        left = at["r"] % 2 == 0
        new = turned(F.when(left, s["a"]).otherwise(s["b"]), F.when(left, s["b"]).otherwise(s["a"]), at["r"], at["sign"])
        halves = _let(new, lambda x: F.struct(F.when(left, x).otherwise(s["a"]).alias("a"), F.when(left, s["b"]).otherwise(x).alias("b")))
        return F.when(at["sign"] == 0, split(shifted(F.concat(s["a"], s["b"])))).otherwise(halves)

    return F.aggregate(steps, split(text), step, lambda s: F.concat(s["a"], s["b"]))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _laid_out(layout: Column, digits: Column, of: str = "0-9") -> Column:
    """``digits`` in the places of the digits (or characters of another class) of ``layout``."""
    return F.array_join(F.transform(F.filter(F.split(layout, ""), lambda c: c != ""), lambda c, i: F.when(c.rlike(f"[{of}]"), F.substring(digits, F.length(F.regexp_replace(F.substring(layout, F.lit(1), i + 1), f"[^{of}]", "")), F.lit(1))).otherwise(c)), "")


def _luhn(digits: Column) -> Column:
    """The sum that is 0 modulo 10 for a valid number."""
    values = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda c: c != "")), lambda c, i: F.when(i % 2 == 1, F.try_element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


#: The country code that a number after + begins with: one or two digits, else three.
_COUNTRY = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"


def _kept_digits(x: Column) -> Column:
    """How many digits of a phone number stay: those of a country code, or a leading 0."""
    digits = _digits(x)
    code = F.regexp_extract(digits, _COUNTRY, 0)
    return F.when(x.startswith("+"), F.when(code != "", F.length(code)).otherwise(3)).when(digits.startswith("0"), 1).otherwise(0)


def _iban_check(country: Column, body: Column) -> Column:
    """The right check digits: 98 less the remainder by 97 of body, country and 00 as digits, letters being 10 to 35."""
    value = lambda c: F.instr(F.lit(_DIGIT + _UPPER), c) - 1
    return F.lit(98) - F.aggregate(_characters(F.concat(body, country, F.lit("00"))), F.lit(0), lambda a, c: F.pmod(a * F.when(value(c) < 10, 10).otherwise(100) + value(c), F.lit(97)))


def _known_names(key: str) -> dict[str, str]:
    """Each known name and its surrogate: the next one of its gender and script in an order that the key chooses."""
    out = {}
    for group in [*GIVEN.values(), FAMILY]:
        order = sorted(group, key=lambda n: hashlib.sha256(f"{key}|{n}".encode()).digest())
        out |= dict(zip(order, order[1:] + order[:1], strict=True))
    return out


def surrogate(entity: Column, kind: Column, key: str = KEY) -> Column:
    """The surrogate of an entity of a type (null for an unknown one).

    What is to be permuted is taken out of the entity, permuted, and put in its place again:

    * a phone's first digit after the kept ones moves within 1 to 9, so that no number turns into one with a leading 0; a 0
      there stays, as it would share the image of the 9;
    * an address of version 6 is permuted in lower case, and is upper case again where it was;
    * a credential's letters a to f stay among themselves, so hexadecimal values stay such and share no image with others;
    * an IBAN's check digits stay as far from the right ones as they were, so a valid number becomes a valid one;
    * in a name, honorifics stay, known names become others, and further ones are permuted, again as long as the
      result is a known name or honorific (cycle walking), which keeps the whole one to one; a word whose letters are of
      no class, as Armenian ones, is spelled from a keyed digest in Latin letters, as it could not move.
    """
    known = _known_names(key)
    listed, others = _literals(list(known)), _literals(list(known.values()))
    reserved = _literals([*known, *(h for x in HONORIFICS.values() for h in x)])
    classes = {c: F.lit(k) for k, c in enumerate(_CLASSES)}
    secret = F.concat(F.lit(f"{key}|"), kind)

    def job(alphabet: str, body: Column, more: Column | None = None) -> Column:
        return F.struct(classes[alphabet].alias("alphabet"), (secret if more is None else F.concat(secret, more)).alias("secret"), body.alias("body"))

    x, digits = entity, _digits(entity)
    local, domain = F.substring_index(x, "@", 1), F.substring_index(x, "@", -1)
    top = F.substring_index(domain, ".", -1)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    compact = F.replace(x, F.lit(" "), F.lit(""))
    octets = F.array_join(F.transform(F.split(x, r"\."), lambda o: F.lpad(F.lower(F.hex(o.cast("long"))), 2, "0")), "")
    bare = lambda w: F.rtrim(w, F.lit(","))
    taken = {
        "credential": F.array(job("secret", x)),
        "key": F.array(job("base36", F.substring(x, 5, 100))),
        "email": F.array(job("text", local, F.lower(host)), job("text", host)),
        "ip": F.array(job("hex", octets)),
        "ipv6": F.array(job("hex", F.lower(x))),
        "ssn": F.array(job("digits", digits)),
        "iban": F.array(job("text", F.substring(compact, 5, 40))),
        "card": F.array(job("digits", F.substring(digits, F.lit(2), F.length(digits) - 2))),
        "phone": F.array(job("digits", F.substring(digits, _kept_digits(x) + 2, F.length(digits)))),
        "person": F.transform(F.split(x, " "), lambda w: job("name", bare(w))),
    }
    jobs = F.lit(None)
    for name, build in taken.items():
        jobs = F.when(kind == name, build).otherwise(jobs)

    def done(j: Column) -> Column:
        def walked(first: Column) -> Column:
            again = lambda w, _: F.when(F.array_contains(reserved, w), permute(w, j["secret"], j["alphabet"])).otherwise(w)
            spelled = F.concat(F.lit("X"), F.translate(F.substring(F.sha2(F.concat_ws("|", j["secret"], first), 256), 1, 12), _DIGIT, "ghijklmnop"))
            named = F.when(F.array_contains(reserved, first), F.aggregate(F.sequence(F.lit(1), F.size(reserved)), first, again)).when(first == j["body"], spelled)
            return F.when(kind == "person", F.coalesce(named, first)).otherwise(first)

        return F.when(F.array_contains(reserved, F.rtrim(j["body"], F.lit("."))) & (kind == "person"), j["body"]).otherwise(_let(permute(j["body"], j["secret"], j["alphabet"]), walked))

    def put(p: Column) -> Column:
        new = F.get(p, 0)

        def card() -> Column:
            body = F.concat(F.substring(digits, F.lit(1), F.lit(1)), new)
            return _laid_out(x, F.concat(body, F.pmod(F.pmod(_luhn(digits), F.lit(10)) - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")))

        def phone() -> Column:
            by = F.conv(F.substring(F.sha2(F.concat_ws("|", secret, new), 256), 1, 4), 16, 10).cast("int")
            first = lambda k: F.substring(digits, k + 1, F.lit(1))
            turn = lambda k: F.concat(F.substring(digits, F.lit(1), k), F.when(first(k) == "0", "0").otherwise((F.pmod(first(k).cast("int") - 1 + by, F.lit(9)) + 1).cast("string")), new)
            return _laid_out(x, _let(_kept_digits(x), turn))

        def iban() -> Column:
            country, check, body = F.substring(compact, 1, 2), F.substring(compact, 3, 2).cast("int"), F.substring(compact, 5, 40)
            return _laid_out(x, F.concat(country, F.lpad(F.pmod(_iban_check(country, new) + check - _iban_check(country, body), F.lit(100)).cast("string"), 2, "0"), new), "0-9A-Z")

        def person() -> Column:
            def word(w: Column, i: Column) -> Column:
                end = F.when(w.endswith(","), ",").otherwise("")
                return _let(F.array_position(listed, bare(w)).cast("int"), lambda at: F.concat(F.when(at > 0, F.get(others, at - 1)).otherwise(F.get(p, i)), end))

            return F.array_join(F.transform(F.split(x, " "), word), " ")

        whole = {
            "credential": new,
            "key": F.concat(F.lit("AKIA"), new),
            "email": F.concat(new, F.lit("@"), F.get(p, 1), F.lit("."), top),
            "ip": F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.substring(new, i * 2 + 1, F.lit(2)), 16, 10)), "."),
            "ipv6": F.when(x.rlike("[A-F]"), F.upper(new)).otherwise(new),
            "ssn": _laid_out(x, new),
            "iban": iban(),
            "card": card(),
            "phone": phone(),
            "person": person(),
        }
        out = F.lit(None).cast("string")
        for name, build in whole.items():
            out = F.when(kind == name, build).otherwise(out)
        return out

    return _let(F.transform(jobs, done), put)


def _pieces(text: Column, pattern: Column, kinds: list[str]) -> Column:
    """The text as an array of struct(piece, kind, entity): what stands before each entity, and at last what stands after all."""
    marked = F.regexp_replace(text, pattern, F.lit(_CUT + _FIELD.join(f"${k + 1}" for k in range(len(kinds))) + _CUT))
    names = F.array(*[F.lit(k) for k in kinds])

    def entity(fields: Column) -> Column:
        hit = F.filter(F.transform(fields, lambda f, i: F.struct(F.get(names, i).alias("kind"), f.alias("entity"))), lambda x: x["entity"] != "")
        return F.get(hit, 0)

    def paired(cut: Column) -> Column:
        at = F.filter(cut, lambda _, i: i % 2 == 0)
        found = F.transform(F.filter(cut, lambda _, i: i % 2 == 1), lambda x: _let(F.split(x, _FIELD, -1), entity))
        return F.zip_with(at, found, lambda p, e: F.struct(p.alias("piece"), e["kind"].alias("kind"), e["entity"].alias("entity")))

    return _let(F.split(marked, _CUT, -1), paired)


def _escaped(text: Column) -> Column:
    out = text
    for plain, code in _ESCAPED.items():
        out = F.replace(out, F.lit(plain), F.lit(code))
    return F.when(text.contains(_CUT) | text.contains(_FIELD) | text.contains(_ESCAPE), out).otherwise(text)


def _plain(text: Column) -> Column:
    out = text
    for plain, code in reversed(_ESCAPED.items()):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return F.when(text.contains(_ESCAPE), out).otherwise(text)


def pieces(text: Column) -> Column:
    """The pieces and entities of a text that passes HINT.

    A second scan follows where a person was found: the words of its name, of three letters or more, are then
    entities wherever they stand alone in the text.
    """

    def mentions(found: Column) -> Column:
        full = F.filter(found, lambda x: x["kind"] == "person")
        words = F.filter(F.array_distinct(F.flatten(F.transform(full, lambda x: F.split(F.replace(x["entity"], F.lit(","), F.lit("")), " ")))), lambda w: (F.length(w) >= 3) & ~w.rlike(rf"^(?:{_ALL_HONORIFICS})\.?$"))
        wider = lambda w: F.concat(F.lit(ANY + r"|((?<!\p{L})(?:"), F.array_join(w, "|"), F.lit(r")(?!\p{L}))"))
        return F.when(F.size(full) > 0, _let(words, lambda w: F.when(F.size(w) > 0, _pieces(_escaped(text), wider(w), [*KINDS, "mention"])).otherwise(found))).otherwise(found)

    return _let(_pieces(_escaped(text), F.lit(ANY), KINDS), mentions)


def redact(docs: DataFrame, key: str = KEY, text_col: str = "text", pairs_col: str | None = None) -> DataFrame:
    """docs with surrogates in the text, n_entities (int; a column of that name is replaced) and, if named, ``pairs_col``.

    That is the array of the text's different (kind, entity, surrogate). Null and empty texts stay and have no entity. Rows
    are treated alone, so repeated rows and ties come out alike; a very long text is scanned whole, in one row; an empty
    table stays empty; other columns are kept. The same key gives the same surrogates in every run and table.
    """
    own = {"n_entities", pairs_col}
    kept = [c for c in docs.columns if c not in own]
    text = F.col(f"`{text_col}`")

    def done(found: Column) -> Column:
        new = F.transform(found, lambda x: F.struct(x["piece"].alias("piece"), x["kind"].alias("kind"), x["entity"].alias("entity"), F.when(x["kind"].isNotNull(), surrogate(x["entity"], F.when(x["kind"] == "mention", "person").otherwise(x["kind"]), key)).alias("surrogate")))
        return _let(new, lambda y: F.struct(F.array_join(F.transform(y, lambda x: F.concat(x["piece"], F.coalesce(x["surrogate"], F.lit("")))), "").alias("text"), F.array_distinct(F.transform(F.filter(y, lambda x: x["kind"].isNotNull()), lambda x: F.struct(x["kind"].alias("kind"), x["entity"].alias("entity"), x["surrogate"].alias("surrogate")))).alias("pairs"), F.size(F.filter(y, lambda x: x["kind"].isNotNull())).alias("n")))

    result = F.when(text.rlike(HINT), _let(pieces(text), done))
    temporary = "_result"
    while temporary in kept:
        temporary += "_"
    # as a generator, so that the plan does not put the expression in the place of each of its uses
    found = docs.select(*[F.col(f"`{c}`") for c in kept], F.explode(F.array(result)).alias(temporary))
    r = F.col(f"`{temporary}`")
    new = F.when(F.coalesce(r["n"], F.lit(0)) > 0, _plain(r["text"])).otherwise(text)
    out = [new.alias(c) if c == text_col else F.col(f"`{c}`") for c in kept] + [F.coalesce(r["n"], F.lit(0)).alias("n_entities")]
    return found.select(*out, *([F.coalesce(r["pairs"], F.array().cast("array<struct<kind:string,entity:string,surrogate:string>>")).alias(pairs_col)] if pairs_col else []))


def replaced(docs: DataFrame, key: str = KEY, text_col: str = "text", attempts: int = 4) -> DataFrame:
    """``redact`` with the collision check over the whole table; its result is written, so that the check reads it.

    Pairs are made distinct map-side and grouped by surrogate, so what is shuffled are different entities. Where the check
    finds a collision the table is done again with key#1, key#2 and so on; if ``attempts`` keys collide it raises.
    """
    pairs = "_pairs"
    while pairs in docs.columns:
        pairs += "_"
    for attempt in range(attempts):
        found = materialise(redact(docs, f"{key}#{attempt}" if attempt else key, text_col, pairs), "surrogates")
        each = found.where(F.size(F.col(f"`{pairs}`")) > 0).select(F.explode(F.col(f"`{pairs}`")).alias("p")).select("p.*").distinct()
        if collisions(each).isEmpty():
            return found.drop(pairs)
    raise ValueError(f"surrogates of {attempts} keys collide")


def mapping(docs: DataFrame, key: str = KEY, text_col: str = "text") -> DataFrame:
    """kind, entity, surrogate and documents of each distinct entity; counted map-side before anything is shuffled."""
    return redact(docs, key, text_col, "_pairs").select(F.explode("_pairs").alias("p")).select("p.*").groupBy("kind", "entity", "surrogate").agg(F.count("*").alias("documents"))


def canonical(value: Column, kind: Column) -> Column:
    """Entities that are the same up to case, or up to the layout of a number, have one canonical form.

    A phone with a country code and one without are two, even of equal digits: +20 2555 0123 isn't 202 555 0123.
    """
    number = F.when(kind == "iban", F.replace(value, F.lit(" "), F.lit(""))).otherwise(F.lower(value))
    digits = F.right(_digits(value), F.lit(16))
    return F.when(kind.isin("card", "ssn"), digits).when(kind == "phone", F.concat(F.when(value.startswith("+"), "+").otherwise(""), digits)).otherwise(number)


def collisions(mapped: DataFrame) -> DataFrame:
    """Rows of ``mapping`` that break distinctness: a surrogate of two entities, or one that is its entity. Empty when all is well."""
    own = mapped.withColumn("_entity", canonical(F.col("entity"), F.col("kind"))).withColumn("_surrogate", canonical(F.col("surrogate"), F.col("kind")))
    shared = own.groupBy("kind", "_surrogate").agg(F.count_distinct("_entity").alias("_n")).where("_n > 1")
    return own.join(shared, ["kind", "_surrogate"], "left").where((F.col("_n") > 1) | (F.col("_entity") == F.col("_surrogate"))).select(*mapped.columns)
