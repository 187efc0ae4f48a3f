"""Keyed surrogates for personal data, in DataFrame functions only.

Every detected entity is replaced by one of its own kind: digits by digits,
letters by letters of the same case and script, octets by octets of the same
width, names by names of the same gender, script and part.  The replacement
depends on the key, the kind and the entity's normal form alone, so mentions
of one entity agree in all documents, however they are written.

Distinctness of numbers, addresses and secrets holds by construction: a keyed
Feistel network permutes all normal forms of one format, so two of them never
share a surrogate, and none is its own.  Payment cards stay valid or invalid
under the Luhn check and IBANs under theirs, by permuting what the check digits
leave free.  Letters of scripts without a pool below become five Latin letters
each; only such a surrogate can meet that of a longer Latin address by chance.

Names come from syllables, whose number is no multiple of anything real, so
they are checked for collisions: where two names of a kind would get the same
surrogate, or one would get a real name, all but the first move to their next
draw until nothing collides.  Every later draw has a syllable more, so there
is always room and few rounds settle all.
"""
from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .places import fresh

KEY = "assayframe"
#: syllables of a name's first draw; each later draw has one more
SYLLABLES_FIRST = 3
#: rounds of the Feistel network each way: even, so that the halves return to their places
ROUNDS = 4
#: rounds in a row that settle no entity before a space counts as full
STUCK = 64

# Honorifics by gender, and syllables and endings of names.
MALE = ["Mr", "Sir", "Herr", "Señor", "Monsieur", "Господин", "Κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Lady", "Frau", "Señora", "Madame", "Mme", "Mlle", "Госпожа", "Κυρία"]
NEUTRAL = ["Dr", "Prof"]
SYLLABLES = {
    "latin": ["al", "be", "ca", "da", "el", "fa", "ga", "ha", "jo", "ka", "le", "ma", "ni", "or", "pe", "ro", "sa", "ti", "va", "we", "li", "mo", "ne", "so"],
    "cyrillic": ["ал", "бе", "ва", "га", "да", "жа", "за", "ка", "ле", "ма", "ни", "ор", "пе", "ро", "са", "ти", "фа", "ха", "ли", "мо", "не", "со", "ви", "ду"],
    "greek": ["αλ", "βε", "γα", "δα", "ζα", "θε", "κα", "λε", "μα", "νι", "ξε", "ορ", "πε", "ρο", "σα", "τι", "φα", "χα", "λι", "μο", "νε", "σο", "βι", "δυ"],
}
ENDINGS = {
    ("latin", "m"): ["n", "rd", "s", "no"], ("latin", "f"): ["na", "ra", "nia", "lla"], ("latin", "n"): ["n", "ra", "s", "la"], ("latin", "last"): ["son", "ner", "mann", "ley"],
    ("cyrillic", "m"): ["н", "р", "й", "слав"], ("cyrillic", "f"): ["на", "ра", "ия", "ша"], ("cyrillic", "n"): ["н", "ра", "й", "на"], ("cyrillic", "last"): ["ченко", "ко", "юк", "ян"],
    ("greek", "m"): ["ος", "ης", "ας", "ων"], ("greek", "f"): ["α", "η", "ια", "νη"], ("greek", "n"): ["ος", "η", "ας", "α"], ("greek", "last"): ["ιδης", "ακης", "πουλος", "ου"],
}

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
HONORIFIC = "(?:" + "|".join(MALE + FEMALE + NEUTRAL) + r")\.?"
NAME = r"(?:[dl]['’])?\p{Lu}[\p{L}'’-]++"
INITIAL = r"(?:\p{Lu}\.-?)++\p{Lu}?(?!\p{L})|\p{Lu}(?![\p{L}'’-])"
PARTICLE = "(?:de|da|do|dos|das|du|di|del|della|degli|der|den|des|van|von|vom|zu|zum|zur|la|le|las|los|el|al|bin|ibn|bint|ben|ter|ten|af|av)"
ADDRESS = r"[\p{L}\p{M}\p{N}._%+-]"
# Prefixes of access tokens.
TOKEN_PREFIX = "(?:A[KS]IA|AIza|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk-)"
SECRETS = {
    "token": rf"(?<![0-9A-Za-z_-])(?:A[KS]IA[0-9A-Z]{{16}}|AIza[0-9A-Za-z_-]{{35}}|gh[pousr]_[0-9A-Za-z]{{36,}}+|github_pat_[0-9A-Za-z_]{{22,}}+|(?:glpat-|xox[abprs]-|sk-)[0-9A-Za-z_-]{{20,}}+)(?![0-9A-Za-z_-])",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z])",
}
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
# a part of a name is not the start of a token, a secret, an account or an address
PART = rf"(?:{PARTICLE} )*(?!{SECRETS['token']}|{SECRETS['secret']}|{IBAN})(?:{NAME}|{INITIAL})(?!{ADDRESS}*+@)"
PATTERNS = SECRETS | {
    "email": r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]++@(?:[\p{L}\p{M}\p{N}-]++\.)++[\p{L}\p{M}\p{N}-]*\p{L}[\p{L}\p{M}\p{N}-]*+",
    "ip": rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?[0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])",
    "national": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "account": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "iban": IBAN,
    "name": rf"(?<!\p{{L}}){HONORIFIC} {PART}(?: {PART})*",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
HINT = rf"[0-9@]|{TOKEN_PREFIX}|{HONORIFIC}|[a-f]{{32}}|[A-F]{{32}}"


def kind_of(e: Column) -> Column:
    out = F.lit("name")
    for kind in reversed([k for k in PATTERNS if k != "name"]):
        out = F.when(e.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def normal(e: Column, kind: Column) -> Column:
    digits = F.regexp_replace(e, "[^0-9]", "")
    return (
        F.when(kind == "phone", F.concat(F.when(e.startswith("+"), F.lit("+")).otherwise(F.lit("")), digits))
        .when(kind.isin("account", "national"), digits).when(kind == "iban", F.regexp_replace(e, " ", ""))
        .when(kind.isin("token", "ip", "initial"), e).otherwise(F.lower(e))
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


# ------------------------------------------------------- keyed permutations

# Blocks of letters and digits, and ranges too large to list.
BLOCKS = [
    (0x30, 0x39), (0x61, 0x7A), (0x41, 0x5A), (0xAA, 0xFF), (0x100, 0x17F), (0x370, 0x3FF), (0x400, 0x4FF), (0x531, 0x587), (0x5D0, 0x5EA), (0x620, 0x64A), (0x660, 0x669),
    (0x671, 0x6D3), (0x6F0, 0x6F9), (0x904, 0x939), (0x966, 0x96F), (0x985, 0x9B9), (0x9E6, 0x9EF), (0xB85, 0xBB9), (0xE01, 0xE30), (0xE50, 0xE59), (0x10D0, 0x10F0),
    (0x1200, 0x1248), (0x1780, 0x17B3), (0x1E00, 0x1EFF), (0x3041, 0x3096), (0x30A1, 0x30FA),
]
RANGES = [(0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0x3400, 0x4DB5)]


def pools() -> list[str]:
    """The characters that may stand for each other: those of one block, category and case behaviour."""
    out = []
    for first, last in BLOCKS:
        groups: dict[tuple, str] = {}
        for c in map(chr, range(first, last + 1)):
            kind = unicodedata.category(c)
            if kind in ("Nd", "Ll", "Lu", "Lo"):
                key = (kind, kind in ("Ll", "Lu") and (len(c.swapcase()) > 1 or c.swapcase().swapcase() != c))
                groups[key] = groups.get(key, "") + c
        out += groups.values()
    return out


POOLS = pools()
EVERY = "".join(POOLS)
A_PLACE = EVERY.index("a") + 1


def listed(values) -> Column:
    """A constant array, written as one text so that the plan holds one literal."""
    values = list(values)
    kind = "array<int>" if isinstance(values[0], int) else "array<string>"
    return F.split(F.lit(",".join(map(str, values))), ",").cast(kind)


def cell(v, r, s, c) -> Column:
    """A place of an entity: value ``v`` below ``r``, sign ``s + v`` of EVERY (or code point ``v - s``, if s < 0), or the sign ``c`` where r is 1."""
    to = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(to(v).cast("int").alias("v"), to(r).cast("int").alias("r"), to(s).cast("int").alias("s"), to(c).alias("c"))


def cells_of(c: Column, kept: Column) -> Column:
    """The cells of one character: one, or five Latin letters for a letter without a pool."""

    firsts = [i for i, pool in enumerate(POOLS) for _ in pool]
    ends = [len("".join(POOLS[: i + 1])) for i in range(len(POOLS))]
    start = listed(ends[i] - len(POOLS[i]) + 1 for i in firsts)
    size = listed(len(POOLS[i]) for i in firsts)

    def made(x: Column) -> Column:
        out = F.when(kept | (x.p == 0) & ~x.c.rlike(r"^[\p{L}\p{N}]$"), F.array(cell(0, 1, 0, x.c)))
        out = out.when(x.p > 0, F.array(cell(x.p - F.element_at(start, x.p), F.element_at(size, x.p), F.element_at(start, x.p), x.c)))
        for first, last in RANGES:
            out = out.when(x.u.between(first, last), F.array(cell(x.u - first, last - first + 1, -first, x.c)))
        return out.otherwise(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: cell((x.u / F.pow(F.lit(26), k)).cast("int") % 26, 26, A_PLACE, x.c)))

    return let(F.struct(c.alias("c"), F.position(c, F.lit(EVERY)).alias("p"), F.ascii(c).alias("u")), made)


def text_cells(text: Column, low: Column, high: Column) -> Column:
    """The cells of a text; the signs up to place ``low`` and after ``high`` stay."""
    return F.flatten(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: cells_of(F.substr(text, i, F.lit(1)), (i <= low) | (i > high))))


def permute(cells: Column, tweak: Column, key: str) -> Column:
    """A keyed permutation without fixed points of all values of the cells.

    E is a Feistel network whose halves shift each other by keyed hashes, each
    cell modulo its own size.  The result is E's inverse after adding 1 to
    every cell of E, so nothing maps to itself.
    """

    def shift(half: Column, other: Column, rounds: Column, sign: Column) -> Column:
        told = F.array_join(F.transform(other, lambda z: z.v.cast("string")), ",")
        h = F.sha2(F.concat_ws("\x1f", F.lit(key), tweak, rounds.cast("string"), told), 512)
        by = lambda h, i: F.conv(F.substr(h, 4 * (i % 32) + 1, F.lit(4)), 16, 10).cast("int")
        return let(h, lambda h: F.transform(half, lambda z, i: cell(F.pmod(z.v + sign * by(h, i), z.r), z.r, z.s, z.c)))

    def step(acc: Column, t: Column) -> Column:
        pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
        plus = lambda half: F.transform(half, lambda z: cell((z.v + 1) % z.r, z.r, z.s, z.c))
        there, back = pair(acc.b, shift(acc.a, acc.b, t, F.lit(1))), pair(shift(acc.b, acc.a, 2 * ROUNDS - t, F.lit(-1)), acc.a)
        return F.when(t < ROUNDS, there).when(t == ROUNDS, pair(plus(acc.a), plus(acc.b))).otherwise(back)

    def whole(x: Column) -> Column:
        half = F.floor(F.size(x) / 2).cast("int")
        start = F.struct(F.slice(x, F.lit(1), half).alias("a"), F.slice(x, half + 1, F.size(x) - half).alias("b"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(2 * ROUNDS)), start, step, lambda acc: F.concat(acc.a, acc.b))

    return let(cells, whole)


def signs(cells: Column) -> Column:
    point = lambda z: F.decode(F.unhex(F.lpad(F.hex(z.v - z.s), 4, "0")), "UTF-16BE")
    return F.array_join(F.transform(cells, lambda z: F.when(z.r == 1, z.c).when(z.s > 0, F.substr(F.lit(EVERY), z.s + z.v, F.lit(1))).otherwise(point(z))), "")


def each_char(e: Column, f) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(e)), lambda i: f(F.substr(e, i, F.lit(1)), i)), "")


def laid(text: Column, chars: Column, skip: str) -> Column:
    """``chars`` laid over the characters of ``text`` that ``skip`` does not match."""
    before = lambda i: F.length(F.regexp_replace(F.substr(text, F.lit(1), i), skip, ""))
    return each_char(text, lambda c, i: F.when(c.rlike(skip), c).otherwise(F.substr(chars, before(i), F.lit(1))))


def luhn(digits: Column) -> Column:
    """Luhn sum of a digit string."""

    def step(acc: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).try_cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step)


def card_check(body: Column) -> Column:
    return (10 - luhn(F.concat(body, F.lit("0"))) % 10) % 10


def iban_check(country: Column, rest: Column) -> Column:
    """The check digits, 2 to 98, of an IBAN without them."""

    def step(acc: Column, i: Column) -> Column:
        v = F.conv(F.substr(F.concat(rest, country, F.lit("00")), i, F.lit(1)), 36, 10).cast("int")
        return F.when(v < 10, (10 * acc + v) % 97).otherwise((100 * acc + v) % 97)

    return 98 - F.aggregate(F.sequence(F.lit(1), F.length(rest) + 4), F.lit(0), step)


# Country calling codes of one digit and of two; the others have three.
CODES_OF_ONE = "17"
CODES_OF_TWO = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def last(text: Column) -> Column:
    return F.substr(text, F.length(text), F.lit(1))


def body(text: Column) -> Column:
    return F.substr(text, F.lit(1), F.length(text) - 1)


def cells(kind: Column, norm: Column) -> Column:
    """What the permutation of a kind moves.  The last label of an address, calling and country codes, a
    card's first digit and a token's prefix stay; check digits come as their distance from the right ones."""
    code = F.when(~norm.startswith("+"), 0).when(F.substr(norm, F.lit(2), F.lit(1)).isin(*CODES_OF_ONE), 2).when(F.array_contains(listed(CODES_OF_TWO), F.substr(norm, F.lit(2), F.lit(2))), 3).otherwise(4)
    low = F.when(kind == "phone", code).when(kind == "account", 1).when(kind == "token", F.length(F.regexp_extract(norm, f"^{TOKEN_PREFIX}", 0))).otherwise(0)
    label = F.when(kind == "email", F.length(F.regexp_extract(norm, r"[^.@]+$", 0))).otherwise(0)
    moved = F.when(kind == "account", body(norm)).when(kind == "iban", F.substr(norm, F.lit(5))).otherwise(norm)
    octet = lambda o: F.when(F.length(o) == 1, cell(o, 10, 0, o)).when(F.length(o) == 2, cell(o.try_cast("int") - 10, 90, 10, o)).otherwise(cell(o.try_cast("int") - 100, 156, 100, o))
    off = lambda given, right, size: F.when(given == right, F.array(cell(0, 1, 0, ""))).otherwise(F.array(cell(F.pmod(given - right - 1, F.lit(size)), size - 1, 1, "")))
    card_end = off(last(norm).try_cast("int"), card_check(body(norm)), 10)
    iban_end = off(F.substr(norm, F.lit(3), F.lit(2)).try_cast("int"), iban_check(F.substr(norm, F.lit(1), F.lit(2)), F.substr(norm, F.lit(5))), 100)
    hexa = lambda i: cell(F.conv(F.substr(norm, i, F.lit(1)), 16, 10), 16, 0, "")
    spelt = text_cells(moved, low, F.length(moved) - label)
    return (
        F.when(kind == "ip", F.transform(F.split(norm, r"\."), octet))
        .when(kind == "secret", F.transform(F.sequence(F.lit(1), F.length(norm)), hexa))
        .otherwise(F.concat(spelt, F.when(kind == "account", card_end).when(kind == "iban", iban_end).otherwise(F.slice(F.array(cell(0, 1, 0, "")), F.lit(1), F.lit(0)))))
    )


def written(kind: Column, text: Column, norm: Column, z: Column) -> Column:
    """The surrogate from its permuted cells, in the writing of ``text``."""
    made, n = signs(z), F.size(z)
    recased = lambda m: F.when((text == norm) | (F.length(m) != F.length(text)), m).otherwise(each_char(text, lambda c, i: F.when(c != F.lower(c), F.upper(F.substr(m, i, F.lit(1)))).otherwise(F.substr(m, i, F.lit(1)))))
    hexed = F.array_join(F.transform(z, lambda y: F.lower(F.hex(y.v))), "")
    front = signs(F.slice(z, F.lit(1), n - 1))  # all but the cell of the check digits
    off = F.element_at(z, -1)
    card = lambda f: F.concat(f, ((card_check(f) + F.when(off.r == 1, 0).otherwise(1 + off.v)) % 10).cast("string"))
    country = F.substr(norm, F.lit(1), F.lit(2))
    account = lambda f: F.concat(country, F.lpad(((iban_check(country, f) + F.when(off.r == 1, 0).otherwise(1 + off.v)) % 100).cast("string"), 2, "0"), f)
    return (
        F.when(kind == "ip", F.array_join(F.transform(z, lambda y: (y.s + y.v).cast("string")), "."))
        .when(kind == "secret", F.when(text.rlike("[A-F]"), F.upper(hexed)).otherwise(hexed))
        .when(kind == "account", laid(text, let(front, card), "[^0-9]")).when(kind == "iban", laid(text, let(front, account), " "))
        .when(kind == "phone", laid(text, F.regexp_replace(made, "[+]", ""), "[^0-9]")).when(kind == "national", laid(text, made, "[^0-9]"))
        .when(kind == "email", let(made, recased)).otherwise(made)
    )


def permuted(kind: Column, text: Column, norm: Column, key: str) -> Column:
    return let(permute(cells(kind, norm), kind, key), lambda z: written(kind, text, norm, z))


# --------------------------------------------------------------------- names

def draw(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """128 hexadecimal digits that only the key's holder can foretell."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, norm, attempt.cast("string")), 512)


def byte(h: Column, i: Column) -> Column:
    return F.conv(F.substr(h, F.pmod(2 * i, F.lit(128)) + 1, F.lit(2)), 16, 10).cast("int")


def script_of(token: Column) -> Column:
    return F.when(token.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).when(token.rlike(r"\p{IsGreek}"), F.lit("greek")).otherwise(F.lit("latin"))


def name_units(e: Column) -> Column:
    """The honorific, kept, and the name's parts as units of their own kinds.

    A part's kind is name:<script>:<m, f or n>, or ..:last for a surname;
    particles are kept, and initials become other letters.
    """
    words = F.split(e, " ")
    head = F.regexp_replace(words[0], r"\.$", "")
    gender = F.when(head.isin(*MALE), F.lit("m")).when(head.isin(*FEMALE), F.lit("f")).otherwise(F.lit("n"))

    def unit(t: Column, i: Column) -> Column:
        last = i == F.size(words) - 1
        kind = F.concat_ws(":", F.lit("name"), script_of(t), F.when(last, F.lit("last")).otherwise(gender))
        return F.struct(t.alias("text"), F.when((i == 0) | t.rlike(f"^{PARTICLE}$"), F.lit("keep")).when(t.rlike(f"^(?:{INITIAL})$"), F.lit("initial")).otherwise(kind).alias("kind"), F.when(last, F.lit("")).otherwise(F.lit(" ")).alias("glue"))

    return F.transform(words, unit)


def name_part(text: Column, kind: Column, h: Column, attempt: Column) -> Column:
    """Syllables of the script and an ending of the gender or of surnames, in the capitals of ``text``."""
    pick = lambda pool, i: F.element_at(pool, byte(h, i) % F.size(pool) + 1)
    of_script = F.when(kind.contains(":cyrillic:"), listed(SYLLABLES["cyrillic"])).when(kind.contains(":greek:"), listed(SYLLABLES["greek"])).otherwise(listed(SYLLABLES["latin"]))
    of_part = listed(ENDINGS["latin", "n"])
    for (script, part), ends in ENDINGS.items():
        of_part = F.when(kind == f"name:{script}:{part}", listed(ends)).otherwise(of_part)
    # the ending is drawn from the byte after those of the first syllables
    at = F.filter(F.sequence(F.lit(0), SYLLABLES_FIRST + attempt), lambda i: i != SYLLABLES_FIRST)
    stem = let(of_script, lambda pool: F.array_join(F.transform(at, lambda i: pick(pool, i)), ""))
    new = F.initcap(F.concat(stem, let(of_part, lambda pool: pick(pool, F.lit(SYLLABLES_FIRST)))))
    return let(new, lambda new: F.when((text == F.upper(text)) & (F.length(text) > 1), F.upper(new)).otherwise(new))


def name(kind: Column, text: Column, norm: Column, attempt: Column, key: str) -> Column:
    return let(draw(kind, norm, attempt, key), lambda h: name_part(text, kind, h, attempt))


def surrogate(kind: Column, text: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The replacement of one unit; ``attempt`` is a name's draw from 0."""
    return F.when(kind == "keep", text).when(kind.startswith("name:"), name(kind, text, norm, attempt, key)).otherwise(permuted(kind, text, norm, key))


def found(text: Column) -> Column:
    """Entities of a text in order; none for null or text without digits, @ or honorifics."""
    none = F.array().cast("array<string>")
    return F.when(text.isNotNull() & text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none)


def with_units(df: DataFrame, units: str = "units") -> DataFrame:
    """Add ``units``: for each entity of the text its units (text, kind, glue, norm).

    Each step is one transform over the last, so nothing is computed twice.
    """
    kinds = F.transform(found(F.col("text")), lambda e: F.struct(e.alias("e"), kind_of(e).alias("kind")))
    alone = lambda x: F.array(F.struct(x.e.alias("text"), x.kind.alias("kind"), F.lit("").alias("glue")))
    split = F.transform(kinds, lambda x: F.when(x.kind == "name", name_units(x.e)).otherwise(alone(x)))
    norm = lambda u: F.struct(u.text.alias("text"), u.kind.alias("kind"), u.glue.alias("glue"), normal(u.text, u.kind).alias("norm"))
    return df.withColumn(units, F.transform(split, lambda us: F.transform(us, norm)))


def name_parts(docs: DataFrame) -> DataFrame:
    """(text_key, kind, norm, text) of every part of a name; only texts with an honorific are searched."""
    spoken = with_units(docs.where(F.col("text").rlike(HONORIFIC)).select("text"))
    rows = spoken.select(F.xxhash64("text").alias("text_key"), F.explode(F.flatten("units")).alias("u"))
    return rows.where("u.kind like 'name:%'").select("text_key", "u.kind", "u.norm", "u.text")


def later_draws(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, attempt) of the names whose first draw collides.

    ``entities`` holds each (kind, norm) once, with one of its writings.
    """
    n = common.parts(entities.sparkSession)
    state = entities.withColumn("attempt", F.lit(0)).repartition(n, "kind", "norm")
    real = entities.select("kind", F.col("norm").alias("made"), F.lit(True).alias("real"))
    left, stuck = None, 0
    while stuck < STUCK:
        made = state.withColumn("made", F.lower(name(F.col("kind"), F.col("text"), F.col("norm"), F.col("attempt"), key)))
        drawn = common.staged(made, "surrogate-draws")
        first = drawn.groupBy("kind", "made").agg(F.min(F.struct("attempt", "norm")).alias("first"), F.count("*").alias("n"))
        clash = first.join(real, ["kind", "made"], "left").where("n > 1 or real")
        moving = clash.agg(F.sum(F.col("n") - F.when(F.col("real"), 0).otherwise(1))).first()[0]
        if not moving:
            return drawn.where("attempt > 0").select("kind", "norm", "attempt")
        left, stuck = moving, stuck + 1 if moving == left else 0
        judged = drawn.join(clash, ["kind", "made"], "left")
        again = F.col("n").isNotNull() & (F.coalesce("real", F.lit(False)) | (F.col("first.norm") != F.col("norm")))
        state = judged.select("kind", "norm", "text", (F.col("attempt") + F.when(again, 1).otherwise(0)).alias("attempt")).repartition(n, "kind", "norm")
    raise RuntimeError(f"{left} names still collide and {STUCK} rounds settled none")


def replace_entities(docs: DataFrame, key: str = KEY, count: str | None = "n_entities") -> DataFrame:
    """Replace the entities of ``text``; add their number as ``count``, if named.

    Null text stays null and has none; empty text stays empty.  Repeated rows
    get equal texts; an empty table gives no rows; other columns pass through (one named as ``count``
    gives way to it).  A text of any length is searched whole.  All is one
    pass over the texts, but for names: their parts are gathered first, and
    texts with a name whose first draw collides are joined to its draw, by
    the hash of the text, whatever ids the rows have.
    """
    units, draws, text_key = fresh(docs.columns, "units", "draws", "text_key")
    marked = with_units(docs, units)
    parts = name_parts(docs)
    entities = common.staged(parts.groupBy("kind", "norm").agg(F.min("text").alias("text")), "surrogate-names")
    later = common.staged(later_draws(entities, key), "surrogate-later")
    if not later.isEmpty():
        entry = F.struct(F.concat_ws("\x1f", "kind", "norm").alias("k"), F.col("attempt").alias("v"))
        per_text = parts.join(later, ["kind", "norm"]).groupBy("text_key").agg(F.map_from_entries(F.collect_set(entry)).alias(draws))
        per_text = common.staged(per_text.withColumnRenamed("text_key", text_key), "surrogate-overrides")
        marked = marked.join(per_text, F.xxhash64("text") == F.col(text_key), "left")
        attempt = lambda u: F.coalesce(F.try_element_at(draws, F.concat_ws("\x1f", u.kind, u.norm)), F.lit(0))
    else:
        attempt = lambda u: F.lit(0)

    unit = lambda u: F.concat(surrogate(u.kind, u.text, u.norm, attempt(u), key), u.glue)
    new = F.transform(units, lambda us: F.array_join(F.transform(us, unit), ""))
    woven = F.zip_with(F.split("text", ANY, -1), new, lambda s, r: F.concat(s, F.coalesce(r, F.lit(""))))
    text = F.when(F.size(units) > 0, F.array_join(woven, "")).otherwise(F.col("text"))
    order = [F.col(c) if c != "text" else text.alias("text") for c in docs.columns if c != count]
    return marked.select(*order, *([F.size(units).alias(count)] if count else []))


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_entities(docs)


def surrogate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data; n_chars, where there is one, follows the new text.

    Null text stays null with its n_chars null, empty text stays empty; texts
    of any length are searched whole.  Repeated rows get equal texts, ties play
    no part; columns of other names pass through; an empty table gives no rows.
    """
    out = replace_entities(docs, count=None)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
