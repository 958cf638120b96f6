"""PII (10) [native]: detected entities get keyed surrogates of their own type, format, script and gender.

Entities are found by one pattern: e-mail, IPv4 and IPv6 addresses, phone numbers, social security numbers, payment cards, IBANs, secrets
(long hexadecimal strings, keys with a known prefix, quoted values after = or :, values with a digit after a word such as password) and persons after a title, double
names and names in capitals included. A person's names are also replaced where they stand alone in the same text, written alike (these are not counted as entities); names of
persons who have no title anywhere in the text are not found. Mentions that differ only in writing (case, spaces, punctuation) have one canonical form, and one surrogate; a
person's given and last names are entities of their own, so all mentions of a last name agree. A keyed SHA-256 of the canonical form moves every letter and
digit inside its own alphabet, so script, case, length and punctuation stay; IPs get valid octets, cards and IBANs keep valid check digits, given
names have the title's gender and all names their own script. In e-mails, names and secrets a
character of any other alphabet is drawn from its script's (from the Latin one where the script has none here), and none stays itself. All distinct entities are checked together: a surrogate that two entities share, or that is an
entity itself, is drawn again for all but the smallest, until all are distinct; from some draw on a surrogate grows by ``GROWTH`` characters
a draw (in an e-mail's domain, a name's syllables, else at its end; IPs become IPv6 ones), so that there are always enough; every mention is then written in its own format.

Defined results: null or empty texts stay as they are and have no entities; documents without entities are unchanged; repeated rows get the
same surrogates; texts of any length are searched whole, in time in proportion to their length (an address part of more characters than the
standards allow is none, or is found by its last 64); where two kinds fit one mention the first of ``KINDS`` counts; a null id is kept; other columns are ignored by ``surrogates`` and kept by ``pseudonymise``; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

MALE = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "господин", "г-н", "Κύριος", "κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "госпожа", "г-жа", "Κυρία", "κυρία"]
NEUTRAL = ["Dr"]
MALE, FEMALE, NEUTRAL = ([*titles, *(t.upper() for t in titles)] for titles in (MALE, FEMALE, NEUTRAL))
_TITLES = "|".join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True))
#: A title where a word starts; most places are told by their first letter.
_TITLED = rf"(?=[{''.join(sorted({t[0] for t in MALE + FEMALE + NEUTRAL}))}])(?<!\p{{L}})(?:{_TITLES})"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: A name starts with a capital, or is of a script without case; it may be double or have a particle ("Smith-Jones", "O'Brien"). Its parts have two letters at least.
_NAME = r"(?:\p{Lu}['’])?[\p{Lu}\p{Lo}][\p{L}\p{M}]+(?:-\p{L}[\p{L}\p{M}]+|['’]\p{Lu}[\p{L}\p{M}]+)*"
_PART = r"\p{L}[\p{L}\p{M}]+"
#: Of kinds that match a mention, the first counts.
KINDS = {
    "email": r"[\p{L}\p{N}][\p{L}\p{M}\p{N}._%+-]{0,63}+@[\p{L}\p{N}-][\p{L}\p{N}.-]{0,252}\.\p{L}{2,63}",
    "ip6": r"(?<![\p{L}\p{N}:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[-. ]\d{4}(?!\d)|(?<![\d.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7})(?!\d)",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![0-9A-Za-z])",
    "person": rf"{_TITLED}\.? {_NAME}(?: {_NAME})?",
    "secret": "|".join(
        [
            r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,}(?![0-9A-Za-z])",
            r"(?<![0-9A-Za-z])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])",
            r"(?<![0-9A-Za-z])(?:gh[pousr]_|sk-|xox[abprs]-)[0-9A-Za-z_-]{16,}",
            r"(?<=[=:] ?\")[^\"\s]{16,}(?=\")",
            r"(?<=[=:] ?)(?<=(?i:password|passwd|pwd|secret|token|key)[=:] ?)(?=[^\s\"]*[0-9])[^\s\"'<>&;,]{8,}",
        ]
    ),
}
ENTITY = "|".join(f"(?:{p})" for p in KINDS.values())
#: What every mention of a kind has, so that a text without it needs no search for the kind.
CUES = {
    "email": "@",
    "ip6": "::|[0-9A-Fa-f]:[0-9A-Fa-f]",
    **dict.fromkeys(["ip", "phone", "ssn", "card", "iban"], "[0-9]"),
    "person": rf"{_TITLED}\.? [\p{{Lu}}\p{{Lo}}]",
    "secret": r"[0-9]|[=:] ?\"|AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|[a-fA-F]{32}",
}
CUE = "|".join(dict.fromkeys(CUES[kind] for kind in KINDS))
DIGITS_ONLY = ["phone", "ssn", "card"]
ALPHABETS = [
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿ",
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
]
#: What other characters become: the first class that fits gives the alphabet.
SCRIPTS = [
    (r"[\p{IsLatin}&&\p{Lu}]", ALPHABETS[4]),
    (r"\p{IsLatin}", ALPHABETS[3]),
    (r"[\p{IsCyrillic}&&\p{Lu}]", ALPHABETS[6]),
    (r"\p{IsCyrillic}", ALPHABETS[5]),
    (r"[\p{IsGreek}&&\p{Lu}]", ALPHABETS[8]),
    (r"\p{IsGreek}", ALPHABETS[7]),
    (r"\p{IsHan}", "安白百北本长成城春大东方飞风高光国海和红华江金军开乐李力林龙马美明木南宁平青清泉日山石水天田王文西小新星雪阳永玉月云中竹子"),
    (r"\p{IsHiragana}", "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ"),
    (r"\p{IsKatakana}", "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ"),
    (r"\p{IsHangul}", "가강고구규근기김나남다도동라로리마명미민박보서석선성소수승신아영예오용우원유윤은이인재정주준지진창최태하한현혜호희"),
    (r"[\u0660-\u0669]", "٠١٢٣٤٥٦٧٨٩"),
    (r"[\u06F0-\u06F9]", "۰۱۲۳۴۵۶۷۸۹"),
    (r"\p{IsArabic}", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"),
    (r"\p{IsHebrew}", "אבגדהוזחטיכלמנסעפצקרשת"),
    (r"\p{IsThai}", "กขคงจฉชซญดตถทนบปผพฟมยรลวสหอ"),
    (r"[\u0966-\u096F]", "०१२३४५६७८९"),
    (r"\p{IsDevanagari}", "अआइईउएओकखगघचछजझटठडढणतथदधनपफबभमयरलवशसह"),
    (r"\p{IsBengali}", "অআইঈউএওকখগঘচছজঝটঠডঢণতথদধনপফবভমযরলশসহ"),
    (r"\p{IsTamil}", "அஆஇஈஉஎஏஒகசஞடணதநபமயரலவழளறன"),
    (r"[\p{IsArmenian}&&\p{Lu}]", "ԱԲԳԴԵԶԷԸԹԺԻԼԽԾԿՀՁՂՃՄՅՆՇՈՉՊՋՌՍՎՏՐՑՓՔՕՖ"),
    (r"\p{IsArmenian}", "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցփքօֆ"),
    (r"\p{IsGeorgian}", "აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ"),
    (r"\p{N}", ALPHABETS[0]),
    (r"\p{Lu}", ALPHABETS[2]),
    (r"[^\p{P}\p{Z}]", ALPHABETS[1]),
]
#: All alphabets in a row; of each its start and size, and of each letter its alphabet.
TABLE = list(dict.fromkeys([*ALPHABETS, *[a for _, a in SCRIPTS]]))
LETTERS = "".join(TABLE)
SIZES = [len(a) for a in TABLE]
STARTS = [sum(SIZES[:k]) for k in range(len(TABLE))]
OWNER = [k for k, a in enumerate(TABLE) for _ in a]
HEX = ["0123456789abcdef", "0123456789ABCDEF"]
SYLLABLES = ["ba", "be", "da", "do", "fe", "ga", "ja", "ka", "ki", "la", "le", "li", "ma", "me", "mi", "na", "ne", "ni", "ra", "re", "ri", "sa", "se", "so", "ta", "te", "to", "va", "ve", "vi", "wa", "zo"]
ENDINGS = {"m": ["n", "s", "rd", "k"], "f": ["a", "lla", "na", "ssa"], "n": ["l", "r", "m", "x"]}
CYRILLIC = ["ба", "бе", "ва", "ви", "га", "да", "до", "за", "зо", "ка", "ки", "ла", "ле", "ли", "ма", "ме", "ми", "на", "не", "ни", "па", "по", "ра", "ре", "ри", "са", "се", "та", "те", "то", "фе", "ша"]
CYRILLIC_ENDINGS = {"m": ["н", "в", "р", "к"], "f": ["ва", "на", "ия", "ша"], "n": ["ко", "м", "х", "л"]}
GREEK = ["βα", "βε", "γα", "δα", "δο", "ζα", "θα", "θε", "κα", "κι", "κο", "λα", "λε", "λι", "μα", "με", "μι", "να", "νε", "νι", "πα", "πο", "ρα", "ρε", "ρι", "σα", "σο", "τα", "τε", "το", "φα", "χα"]
GREEK_ENDINGS = {"m": ["ος", "ης", "ας", "ις"], "f": ["α", "η", "νια", "σα"], "n": ["ξ", "κι", "ν", "ρ"]}
#: Scripts whose names are made of syllables; names of other scripts have their letters drawn.
NAMES = [(r"\p{IsLatin}", SYLLABLES, ENDINGS), (r"\p{IsCyrillic}", CYRILLIC, CYRILLIC_ENDINGS), (r"\p{IsGreek}", GREEK, GREEK_ENDINGS)]
#: Draws of a surrogate's usual size: of e-mails and names, which may grow without losing their format, and of others.
DRAWS = {"email": 2, "person": 2}
DRAWS_OTHERS = 12
#: Characters that every further draw adds.
GROWTH = 2


def _kind(mention: Column) -> Column:
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(KINDS.items()):
        kind = F.when(mention.rlike(f"^(?:{_alone(pattern)})$"), F.lit(name)).otherwise(kind)
    return kind


def _alone(pattern: str) -> str:
    """A pattern for a mention that stands alone: its surroundings were checked where it was found."""
    for around in (r"(?<=[=:] ?\")", r"(?=\")", r"(?<=[=:] ?)", r"(?<=(?i:password|passwd|pwd|secret|token|key)[=:] ?)"):
        pattern = pattern.replace(around, "")
    return pattern


def _title(mention: Column) -> Column:
    return F.regexp_extract(mention, rf"^({_TITLES})\.? ", 1)


def _parts(kind: Column, mention: Column) -> Column:
    """The canonical forms of what a mention is made of: one, or one for each name of a person.

    A person's last name is an entity of its own, so "Mr. Smith", "Mr. John Smith" and "Dr. Smith" share its surrogate, and so do relatives.
    Given names have the title's gender; last names have none, except where the script's language bends them.
    """
    gender = F.when(_title(mention).isin(MALE), "m").when(_title(mention).isin(FEMALE), "f").otherwise("n")
    whole = F.regexp_replace(mention, rf"^(?:{_TITLES})\.? ", "")
    names = F.regexp_extract_all(F.lower(whole), F.lit(_PART), F.lit(0))
    given = F.size(names) - F.size(F.regexp_extract_all(F.substring_index(whole, " ", -1), F.lit(_PART), F.lit(0)))
    bends = lambda x: x.rlike(r"^[\p{IsCyrillic}\p{IsGreek}]")
    persons = F.transform(names, lambda x, i: F.concat(F.when((i < given) | bends(x), gender).otherwise("n"), F.lit("|"), x))
    plain = (
        F.when(kind.isin(DIGITS_ONLY), F.regexp_replace(mention, r"\D", ""))
        .when(kind.isin("email", "ip6"), F.lower(mention))
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .otherwise(mention)
    )
    return F.when(kind == "person", persons).otherwise(F.array(plain))


def _draw(h: Column, i: Column) -> Column:
    """The i-th small number of a keyed hash (64 hexadecimal digits)."""
    at = F.pmod(i, F.lit(32)) * 2 + 1
    return (F.conv(F.substring(h, at, F.lit(2)), 16, 10).cast("int") + (i / 32).cast("int") * 7).cast("int")


def _shift(c: Column, k: Column, alphabets: list[str]) -> Column:
    """A character moved inside its own alphabet; others stay."""
    moved = c
    for a in reversed(alphabets):
        at = F.call_function("instr", F.lit(a), c)
        moved = F.when(at > 0, F.substring(F.lit(a), F.pmod(at - 1 + k, F.lit(len(a))) + 1, F.lit(1))).otherwise(moved)
    return moved


def _shifted(text: Column, h: Column, alphabets: list[str]) -> Column:
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: _shift(c, _draw(h, i), alphabets)), "")


def _redrawn(text: Column, h: Column) -> Column:
    """Each character becomes another one of its alphabet, or one of its script's, never itself; punctuation and spaces stay."""
    entry = lambda values, i: F.get(F.lit(values), i)
    split = F.transform(F.split(text, ""), lambda c: F.struct(c.alias("c"), (F.call_function("instr", F.lit(LETTERS), c) - 1).alias("at")))

    def known(x):
        found = F.lit(-1)
        for kind, a in reversed(SCRIPTS):
            found = F.when(x["c"].rlike(kind), F.lit(TABLE.index(a))).otherwise(found)
        found = F.when(x["at"] >= 0, entry(OWNER, x["at"])).when(x["c"].rlike(r"\p{ASCII}"), F.lit(-1)).otherwise(found)
        return F.struct(x["c"].alias("c"), x["at"].alias("at"), found.alias("a"))

    def drawn(x, i):
        start, size, k = entry(STARTS, x["a"]), entry(SIZES, x["a"]), _draw(h, i)
        to = F.when(x["at"] >= 0, F.pmod(x["at"] - start + 1 + F.pmod(k, size - 1), size)).otherwise(F.pmod(k, size))
        return F.when(x["a"] < 0, x["c"]).otherwise(F.substring(F.lit(LETTERS), start + to + 1, F.lit(1)))

    return F.array_join(F.transform(F.transform(split, known), drawn), "")


def _luhn(digits: Column) -> Column:
    """The check sum of a number whose last digit is its check digit (0 if valid)."""
    value = lambda d, i: F.when(F.pmod(i, F.lit(2)) == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))
    each = F.transform(F.reverse(F.split(digits, "")), lambda c, i: value(c.cast("int"), i))
    return F.pmod(F.aggregate(each, F.lit(0), lambda a, b: a + b), F.lit(10))


def _mod97(text: Column) -> Column:
    """The remainder of an IBAN-like text (letters count 10 to 35), four characters moved to the end already."""
    value = lambda c: F.ascii(c) - F.when(c.between("0", "9"), 48).otherwise(55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.pmod(a * F.when(c.between("0", "9"), 10).otherwise(100) + value(c), F.lit(97)).cast("int"))


def _iban(canon: Column, h: Column, digits: Column) -> Column:
    """Country as it is, the rest redrawn; check digits that hold where the original's do."""
    rest = F.concat(_shifted(F.substring(canon, 5, 1 << 20), h, ALPHABETS[:3]), digits)
    country = F.substring(canon, 1, 2)
    check = F.lpad((98 - _mod97(F.concat(rest, country, F.lit("00")))).cast("string"), 2, "0")
    valid = _mod97(F.concat(F.substring(canon, 5, 1 << 20), F.substring(canon, 1, 4))) == 1
    return F.concat(country, F.when(valid, check).otherwise(_shifted(F.substring(canon, 3, 2), h, ALPHABETS[:1])), rest)


def _name(canon: Column, h: Column, more: Column, further: Column) -> Column:
    """A made-up name in the original's script, with the ending of the gender."""
    pick = lambda words, i: F.get(F.array(*[F.lit(w) for w in words]), F.pmod(_draw(h, F.lit(i)), F.lit(len(words))))
    gender, name = F.substring(canon, 1, 1), F.substring(canon, 3, 1 << 20)
    extra = lambda syllables: F.array_join(F.transform(F.slice(F.split(further, ""), F.lit(1), more), lambda c: F.get(F.array(*[F.lit(w) for w in syllables]), F.conv(c, 16, 10).cast("int"))), "")
    made = F.concat(_redrawn(name, h), extra(SYLLABLES))
    for script, syllables, endings in reversed(NAMES):
        end = F.when(gender == "m", pick(endings["m"], 4)).when(gender == "f", pick(endings["f"], 4)).otherwise(pick(endings["n"], 4))
        made = F.when(name.rlike(f"^{script}"), F.concat(extra(syllables), *[pick(syllables, k) for k in range(4)], end)).otherwise(made)
    return F.concat(gender, F.lit("|"), made)


def _with_hashes(entities: DataFrame, key: str) -> DataFrame:
    """Adds h, the keyed hash of a draw; further, one for the characters that a surrogate grows by; and more, how many these are."""
    kind = F.col("kind")
    usual = F.coalesce(F.create_map(*[F.lit(x) for kv in DRAWS.items() for x in kv])[kind], F.lit(DRAWS_OTHERS))
    rows = entities.withColumn("h", F.sha2(F.concat_ws("\n", F.lit(key), kind, F.col("canon"), F.col("attempt").cast("string")), 256))
    more = F.least(F.greatest(F.col("attempt") - usual + 1, F.lit(0)) * GROWTH, F.lit(56))
    return rows.withColumn("further", F.sha2(F.concat("h", F.lit("further")), 256)).withColumn("more", more)


def _surrogate(kind: Column, canon: Column) -> Column:
    """The surrogate's canonical form, from the row's hashes."""
    h, further, more = F.col("h"), F.col("further"), F.col("more")
    hexes = F.substring(further, F.lit(1), more)
    digits = F.translate(hexes, "abcdef", "012345")
    moved = F.concat(F.substring(canon, 1, 1), _shifted(F.substring(canon, 2, 1 << 20), h, ALPHABETS[:1]), digits)
    body = F.substring(moved, F.lit(1), F.length(moved) - 1)
    checked = F.concat(body, F.pmod(10 - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))
    octets = [F.lit(1) + F.pmod(_draw(h, F.lit(0)), F.lit(223)), *[_draw(h, F.lit(k)) for k in (1, 2, 3)]]
    redrawn = _redrawn(F.when(kind == "email", F.substring_index(canon, "@", 1)).otherwise(canon), h)
    prefix = F.regexp_extract(canon, "^(AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-)", 1)  # tells the kind of a key, and nothing of the key
    domain = F.concat(F.lit("mail"), F.pmod(_draw(h, F.lit(30)), F.lit(10)).cast("string"), hexes, F.lit(".example."), F.get(F.array(F.lit("org"), F.lit("net"), F.lit("com")), F.pmod(_draw(h, F.lit(31)), F.lit(3))))
    return (
        F.when(kind == "email", F.concat(redrawn, F.lit("@"), domain))
        .when((kind == "ip") & (more > 0), F.concat(F.lit("2001:db8:"), F.array_join(F.regexp_extract_all(F.substring(further, 1, 24), F.lit("...."), F.lit(0)), ":")))
        .when(kind == "ip", F.concat_ws(".", *[o.cast("string") for o in octets]))
        .when(kind == "card", F.when(_luhn(canon) == 0, checked).otherwise(moved))
        .when(kind == "ip6", F.concat(F.lit("2001:db8:"), F.array_join(F.regexp_extract_all(F.substring(h, 1, 24), F.lit("...."), F.lit(0)), ":")))
        .when(kind == "iban", _iban(canon, h, digits))
        .when(kind == "person", _name(canon, h, more, further))
        .when((kind == "secret") & canon.rlike("^[0-9a-f]+$"), F.concat(_shifted(canon, h, HEX[:1]), hexes))
        .when((kind == "secret") & canon.rlike("^[0-9A-F]+$"), F.concat(_shifted(canon, h, HEX[1:]), F.upper(hexes)))
        .when((kind == "secret") & ~canon.rlike(r"[\p{L}\p{N}]"), F.concat(F.substring(F.repeat(h, (F.length(canon) / 64 + 1).cast("int")), F.lit(1), F.length(canon)), hexes))
        .when(kind.isin(*DIGITS_ONLY), moved)
        .when(kind == "secret", F.concat(prefix, _redrawn(F.substring(canon, F.length(prefix) + 1, F.length(canon)), h), hexes))
        .otherwise(F.concat(redrawn, hexes))
    )


def _old_names(mention: Column) -> Column:
    """The parts of a person's name, as they are written."""
    return F.regexp_extract_all(F.regexp_replace(mention, rf"^(?:{_TITLES})\.? ", ""), F.lit(_PART), F.lit(0))


def _new_names(mention: Column, surrogates: Column) -> Column:
    """What stands for each of them, in capitals where it is in capitals."""
    return F.zip_with(_old_names(mention), F.transform(surrogates, lambda x: F.substring(x, 3, 1 << 20)), lambda old, new: F.when(old == F.upper(old), F.upper(new)).otherwise(F.initcap(new)))


def _bare(gap: Column, names: Column) -> Column:
    """A stretch between entities, with the names of the text's persons replaced where they stand without a title."""
    words = F.regexp_extract_all(gap, F.lit(_PART), F.lit(0))
    return F.array_join(F.transform(F.split(gap, _PART, -1), lambda g, i: F.concat(g, F.coalesce(names[F.get(words, i)], F.get(words, i), F.lit("")))), "")


def _written(kind: Column, mention: Column, surrogates: Column) -> Column:
    """The surrogates of a mention's parts in its format."""
    surrogate = F.get(surrogates, 0)
    significant = F.when(kind == "iban", F.lit("[A-Z0-9]")).otherwise(F.lit(r"\d"))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    step = lambda a, c: F.when(
        F.regexp_like(c, significant),
        F.struct(F.concat(a["out"], F.substring(surrogate, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at")),
    ).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at")))
    laid = F.aggregate(F.split(mention, ""), start, step, lambda a: F.concat(a["out"], F.substring(surrogate, a["at"], F.length(surrogate))))
    local = F.substring_index(mention, "@", 1)
    cased = F.array_join(F.transform(F.split(F.substring_index(surrogate, "@", 1), ""), lambda c, i: F.when(F.get(F.split(local, ""), i) != F.lower(F.get(F.split(local, ""), i)), F.upper(c)).otherwise(c)), "")
    title = F.regexp_extract(mention, rf"^(?:{_TITLES})\.? ", 0)
    gaps = F.split(F.substring(mention, F.length(title) + 1, F.length(mention)), _PART, -1)
    new = _new_names(mention, surrogates)
    person = F.concat(title, F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(new, i), F.lit("")))), ""))
    return (
        F.when(kind.isin(*DIGITS_ONLY, "iban"), laid)
        .when(kind == "email", F.concat(cased, F.lit("@"), F.substring_index(surrogate, "@", -1)))
        .when(kind == "person", person)
        .otherwise(surrogate)
    )


def assign(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, surrogate: distinct entities with distinct surrogates, none of which is an entity itself."""
    entities = cut(entities.select("kind", "canon").distinct())
    drawn = entities.withColumn("attempt", F.lit(0))
    while True:  # ends, as the surrogates that are left grow with every draw
        drawn = cut(_with_hashes(drawn, key).select("kind", "canon", "attempt", _surrogate(F.col("kind"), F.col("canon")).alias("surrogate")))
        winners = drawn.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon"), F.count("*").alias("n"))
        taken = winners.join(entities.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("real")), ["kind", "surrogate"], "left")
        clash = cut(taken.where("n > 1 or real").select("kind", "surrogate", F.when(F.col("real").isNull(), F.col("canon")).alias("winner")))
        if clash.isEmpty():
            return drawn.select("kind", "canon", "surrogate")
        again = drawn.join(clash, ["kind", "surrogate"], "left")
        lost = F.col("winner").isNull() | (F.col("winner") != F.col("canon"))
        in_clash = clash.select("kind", "surrogate", F.lit(True).alias("clashed"))
        again = again.join(in_clash, ["kind", "surrogate"], "left")
        drawn = again.select("kind", "canon", (F.col("attempt") + F.when(F.col("clashed") & lost, 1).otherwise(0)).alias("attempt"))


def _key(docs: DataFrame, text_col: str) -> list[Column]:
    """Two hashes that stand for a text (equal texts get equal surrogates)."""
    return [F.xxhash64(F.lit(k), docs[text_col]).alias(f"key{k}") for k in (1, 2)]


def pseudonymised(docs: DataFrame, text_col: str, key: str) -> DataFrame:
    """Columns ``row`` (the document), ``text`` with surrogates, and ``kinds`` (of the entities, in order)."""
    text = docs[text_col].cast("string")
    has_cue = F.coalesce(text.rlike(CUE), F.lit(False))
    found = docs.where(has_cue).select(*_key(docs, text_col), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)).alias("found"))
    found = found.where(F.size("found") > 0).dropDuplicates(["key1", "key2"])
    mentions = found.select("key1", "key2", F.posexplode("found").alias("place", "mention"))
    mentions = mentions.withColumn("kind", _kind(F.col("mention")))
    mentions = cut(mentions.select("*", F.posexplode(_parts(F.col("kind"), F.col("mention"))).alias("part", "canon")))
    named = mentions.join(cut(assign(mentions, key)), ["kind", "canon"])
    named = named.groupBy("key1", "key2", "place", "kind", "mention").agg(F.sort_array(F.collect_list(F.struct("part", "surrogate")))["surrogate"].alias("surrogates"))
    names = F.when(F.col("kind") == "person", F.arrays_zip(_old_names(F.col("mention")).alias("old"), _new_names(F.col("mention"), F.col("surrogates")).alias("new")))
    written = F.struct("place", _written(F.col("kind"), F.col("mention"), F.col("surrogates")).alias("text"), "kind", names.alias("names"))
    by_doc = cut(named.groupBy("key1", "key2").agg(F.sort_array(F.collect_list(written)).alias("new")))
    # of the two names that a part gets from mentions of two genders or in capitals, the first in order counts where it stands alone
    pairs = F.array_sort(F.array_distinct(F.flatten(F.filter(F.col("new.names"), lambda x: x.isNotNull()))))
    firsts = F.filter(pairs, lambda x, i: (i == 0) | (F.get(pairs, i - 1)["old"] != x["old"]))
    by_doc = by_doc.select("key1", "key2", "new", F.map_from_entries(firsts).alias("names"))
    # only texts with a cue are shuffled, and so at every size
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), text.alias("text"), *_key(docs, text_col), has_cue.alias("has_cue"))
    joined = rows.where("has_cue").join(by_doc.hint("merge"), ["key1", "key2"], "left")
    gaps = F.transform(F.split("text", ENTITY, -1), lambda g: F.when(F.size("names") > 0, _bare(g, F.col("names"))).otherwise(g))
    merged = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get("new", i)["text"], F.lit("")))), "")
    none = F.array().cast("array<string>")
    changed = joined.select("row", F.when(F.col("new").isNull(), F.col("text")).otherwise(merged).alias("text"), F.coalesce(F.col("new.kind"), none).alias("kinds"))
    return changed.unionByName(rows.where("not has_cue").select("row", "text", none.alias("kinds")))


def surrogates(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_entities, kinds, text."""
    done = pseudonymised(docs, text_col, key)
    return done.select(F.col("row")[id_col].alias(id_col), F.size("kinds").cast("long").alias("n_entities"), F.array_sort("kinds").alias("kinds"), "text")


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The documents with surrogates in their texts, with all their columns."""
    done = pseudonymised(docs, text_col, key)
    return done.select(*[(F.col("text") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
