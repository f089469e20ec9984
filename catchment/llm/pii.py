"""Surrogates for personal data, by DataFrame functions alone.

One pattern finds e-mail and IPv4 addresses, card, phone, social-security and account numbers, access
keys, hexadecimal secrets, assigned passwords, and names after a gendered title: all capitalised parts,
particles between them and degrees before them left as they are; in scripts without case the word after the title, or two or
three Han characters. A name ends before another title, and before a word that more texts of the corpus have apart from names
than in one (or a date). Each part of a name is an entity, and so is every other mention of it, as a whole word, in the same text, unless it is such a
word: then only right after a title. The last word after a title is a surname,
words before it are given names; a given name is of the title's gender (of neither if a text has it after
titles of both), a surname of a gender only where its script forms two. Each entity is reduced
to a canonical form (so that spellings of one entity share a surrogate), and a keyed SHA-256 of it drives
a replacement of the same type: digits for digits, letters of the same case, hexadecimal for hexadecimal,
separators kept, check digits of cards kept valid; names are made of syllables of their script with an
ending of their gender, surnames as surnames, capitals as capitals; in assigned
passwords every other letter or symbol also becomes one of its class. Surrogates are checked over the
whole corpus: where two entities of a type share one, or one equals an entity that occurs, all but the
first get another attempt; what is left after a few is numbered, and the number goes into a longer
surrogate (an address gets the free address of its number), so that all are distinct in the end.
Everything else in a text stays.

A null text stays null and has no entities; repeated rows get equal results. All columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, marks, with_seen

KEY = "surrogates-1"
#: Attempts before the entities left are numbered.
ATTEMPTS = 8

# fixed values: titles by gender
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Господин"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Госпожа"]

#: Syllables of made names: onsets, vowels, codas by script; and the endings of each part of a name and gender (n: neither).
SYLLABLES = {
    "latin": (["b", "d", "f", "g", "h", "k", "l", "m", "n", "p", "r", "s", "t", "v", "w", "br", "dr", "fl", "gr", "kl", "kr", "st", "tr"], ["a", "e", "i", "o", "u"], ["l", "n", "r", "s", "t", "m", "nd", "rt", "ld"]),
    "cyrillic": (["б", "в", "г", "д", "з", "к", "л", "м", "н", "п", "р", "с", "т", "х", "бр", "гр", "др", "кр", "ст", "тр"], ["а", "е", "и", "о", "у"], ["л", "н", "р", "с", "т", "м", "в"]),
}
ENDINGS = {
    ("latin", "given", "m"): ["ard", "win", "mar", "ian", "us", "rik", "bert", "o"], ("latin", "given", "f"): ["a", "ina", "elle", "ia", "ette", "lyn", "ora", "eth"], ("latin", "given", "n"): ["y", "is", "en", "ey"],
    ("latin", "surname", "n"): ["berg", "mann", "ton", "ley", "ner", "sen", "field", "wick", "hart", "ford"],
    ("cyrillic", "given", "m"): ["ан", "ий", "ислав", "имир"], ("cyrillic", "given", "f"): ["ана", "ия", "ислава", "ина"], ("cyrillic", "given", "n"): ["ша", "ня"],
    ("cyrillic", "surname", "m"): ["ов", "ев", "ин", "ский"], ("cyrillic", "surname", "f"): ["ова", "ева", "ина", "ская"], ("cyrillic", "surname", "n"): ["енко", "ук", "ко", "ых"],
}

#: Class of characters in passwords, and what they become; the first that matches counts.
CLASSES = [
    (r"[0-9]", "0123456789"), (r"[a-z]", "abcdefghijklmnopqrstuvwxyz"), (r"[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (r"(?=\p{IsCyrillic})\p{Lu}", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"), (r"(?=\p{IsCyrillic})\p{L}", "абвгдежзиклмнопрстуфхцчшэюя"),
    (r"(?=\p{IsGreek})\p{Lu}", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"), (r"(?=\p{IsGreek})\p{L}", "αβγδεζηθικλμνξοπρστυφχψω"),
    (r"(?=\p{IsLatin})\p{Lu}", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜ"), (r"(?=\p{IsLatin})\p{L}", "àáâãäåæçèéêëìíîïñòóôõöøùúûü"),
    (r"\p{IsHan}", "一丁七万三上下不中久之也二五人今以六十千口土大女子小山川工"), (r"\p{IsHiragana}", "あいうえおかきくけこさしすせそたちつてと"),
    (r"\p{IsKatakana}", "アイウエオカキクケコサシスセソタチツテト"), (r"\p{IsHangul}", "가나다라마바사아자차카타파하거너더러머버"),
    (r"(?=\p{IsArabic})\p{L}", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"), (r"(?=\p{IsHebrew})\p{L}", "אבגדהוזחטיכלמנסעפצקרשת"),
    (r"(?=\p{IsDevanagari})\p{L}", "कखगघचछजझटठडढतथदधनपफबभमयरलवशषसह"), (r"\p{Lu}", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (r"\p{L}", "abcdefghijklmnopqrstuvwxyz"),
    (r"\p{N}", "0123456789"), (r"\p{M}", "\u0300\u0301\u0302\u0303\u0304\u0306\u0308\u030a"), (r"\p{So}", "☀☁☂☃★☆☎♠♣♥♦♪"), (r"\p{Sc}", "$¢£¥₩€"),
]
SYMBOLS = "!#%&*+-./:<>?@^_|~"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: A run of letters: O'Neill is one, without the s of a possessive. A name's word: such runs with hyphens, of two letters at least.
_RUN = r"\p{L}[\p{L}\p{M}]*+(?:['’](?!s(?![\p{L}\p{M}]))\p{L}[\p{L}\p{M}]*+)*+"
#: Never a title itself. In scripts without case: two or three Han characters, or a run of letters of another script.
_TITLE = rf"(?:{'|'.join(MALE_TITLES + FEMALE_TITLES)})"
_BARE = r"(?:\p{IsHan}{2,3}|[\p{Lo}&&[^\p{IsHan}]]{2}[\p{Lo}\p{M}]*+)"
_WORD = rf"(?:(?!{_TITLE}(?![\p{{L}}\p{{M}}]))(?=(?:[dl]['’])?\p{{Lu}}[\p{{L}}\p{{M}}'’-]){_RUN}(?:-{_RUN})*+|{_BARE})"
#: Left as they are: particles, and degrees before a name. Initials too.
PARTICLES = ["von", "van", "vom", "zu", "zum", "zur", "de", "der", "den", "des", "du", "del", "della", "di", "da", "das", "do", "dos", "la", "le", "el", "al", "bin", "ibn", "ter", "ten", "y", "e"]
DEGREES = ["Dr", "Prof", "Доктор", "Профессор"]
_LINK = rf"(?:(?:{'|'.join(PARTICLES)})(?![\p{{L}}\p{{M}}])[ -]|(?:{'|'.join(DEGREES)})\.? |\p{{Lu}}\. ?|\p{{Lu}} )"
_NAME = rf"{_LINK}*+{_WORD}(?: {_LINK}*+{_WORD})*+"
#: Each kind's pattern; the first that matches at a place counts.
KINDS = {
    "email": r"(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "password": r"(?<=(?:password|passwd|secret|token|api_key)=)[^\s\"',;]{6,64}",
    "access_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "hex": r"\b(?=[0-9a-f]*\d)(?=\d*[a-f])[0-9a-f]{32,64}\b",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w)",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\w)|(?<![\w.])\+\d{8,14}(?!\w)",
    "male": rf"(?<=\b(?:{'|'.join(MALE_TITLES)})\.? ){_NAME}",
    "female": rf"(?<=\b(?:{'|'.join(FEMALE_TITLES)})\.? ){_NAME}",
}
PATTERN = "|".join(KINDS.values())
NAMELESS = "|".join(p for k, p in KINDS.items() if k not in ("male", "female"))
#: A cheap necessary condition of any match: every match of each kind holds one of these signs.
HINT = r"[@=]|\d{3}|\d[ .-]\d|[0-9a-f]{32}|AKIA|ASIA|[A-Z]{2}\d{2}|" + "|".join(MALE_TITLES + FEMALE_TITLES)


# fixed values: words with a capital that are dates, not names, when they stand alone
DATES = [
    *"Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December".split(),
    *"Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag Januar Februar März Mai Juni Juli Oktober Dezember".split(),
]
#: Words as the corpus is searched for them.
_LETTERS = r"[\p{L}\p{M}'’-]+"


def with_names(texts: DataFrame) -> DataFrame:
    """``texts`` with names_f and names_m: the words of each name after a title of a gender, degrees and particles left out."""
    for g, title in (("f", "female"), ("m", "male")):
        texts = texts.withColumn(f"names_{g}", F.transform(F.regexp_extract_all("text", F.lit(KINDS[title]), F.lit(0)), lambda n: F.regexp_extract_all(n, F.lit(_WORD), F.lit(0))))
    return texts


def _spelling(w: Column) -> Column:
    return F.lower(F.regexp_replace(w, r"['’]s$", ""))


def ordinary_words(named: DataFrame, marked: DataFrame) -> DataFrame:
    """word (in lower case): words of names that more texts have apart from names than in one, and dates.

    ``named``: row_key and names of the texts with names; ``marked``: row_key and text of all. A word in lower case, or
    with a capital in a text that has it in no name, stands apart from names. Only words that some name has are counted,
    told by a bit table before the shuffle; the counts are of texts, so a copy counts once.
    """
    words = lambda n: F.transform(F.flatten(n), _spelling)
    of_text = named.select("row_key", F.array_distinct(F.concat(words(F.col("names_f")), words(F.col("names_m")))).alias("own")).distinct()
    in_names = cut(of_text.select("row_key", F.explode("own").alias("word")))
    counted = in_names.groupBy("word").agg(F.count("*").alias("named"))
    spoken = marked.filter(F.col("text").isNotNull()).select("row_key", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_LETTERS), F.lit(0)))).alias("w"))
    spoken = spoken.withColumn("word", _spelling(F.col("w")))
    spoken = with_seen(spoken, marks(in_names, "word"), "word").filter("seen")
    lower = F.col("w") == F.lower("w")
    once = spoken.groupBy("row_key", "word").agg(F.bool_or(lower & F.col("w").rlike(r"^\p{Ll}")).alias("small"))
    free = once.join(in_names.withColumn("name", F.lit(True)), ["row_key", "word"], "left").filter("small or name is null").groupBy("word").agg(F.count("*").alias("free"))
    dates = F.col("word").isin([d.lower() for d in DATES])
    return counted.join(free, "word", "left").filter((F.col("free") > F.col("named")) | dates).select("word")


def with_ordinary(named: DataFrame, ordinary: DataFrame) -> DataFrame:
    """``named`` with ordinary: which words of its names (in lower case) are ordinary ones."""
    words = named.select("row_key", F.explode(F.flatten(F.concat("names_f", "names_m"))).alias("w")).select("row_key", _spelling(F.col("w")).alias("word")).distinct()
    of_row = words.join(ordinary, "word").groupBy("row_key").agg(F.collect_list("word").alias("ordinary"))
    return named.join(of_row, "row_key", "left").withColumn("ordinary", F.coalesce("ordinary", F.array().cast("array<string>")))


def with_parts(named: DataFrame) -> DataFrame:
    """``named`` (names_f, names_m, ordinary) with parts: given names (first) and surnames (last) after titles of a gender, part by part, each once, also in capitals and with one capital.

    A name ends before an ordinary word, other than its first; parts are in ``spoken`` if they are no ordinary words, and in ``titled`` all.
    """
    common = lambda w: F.array_contains("ordinary", _spelling(w))
    texts = named
    for g in "fm":
        cut_at = lambda n: F.array_position(F.transform(F.slice(n, 2, 1000), common), F.lit(True))
        texts = texts.withColumn(f"names_{g}", F.transform(f"names_{g}", lambda n: F.slice(n, F.lit(1), F.when(cut_at(n) > 0, cut_at(n)).otherwise(F.size(n)).cast("int"))))
    kept = F.array(*map(F.lit, PARTICLES + DEGREES))
    runs = lambda words: F.array_distinct(F.filter(F.flatten(F.transform(F.flatten(words), lambda w: F.regexp_extract_all(w, F.lit(_RUN), F.lit(0)))), lambda x: (F.length(x) > 1) & ~F.array_contains(kept, x)))
    spelt = lambda parts: F.array_distinct(F.concat(parts, F.transform(parts, lambda x: F.initcap(F.lower(x))), F.transform(parts, lambda x: F.upper(x))))
    names = []
    for g in "fm":  # a column for each step, so that none is worked out twice
        texts = texts.withColumn(f"first_{g}", runs(F.transform(f"names_{g}", lambda n: F.slice(n, F.lit(1), F.greatest(F.size(n) - 1, F.lit(0))))))
        texts = texts.withColumn(f"last_{g}", runs(F.transform(f"names_{g}", lambda n: F.slice(n, F.greatest(F.size(n), F.lit(1)), F.lit(1)))))
        names += [f"first_{g}", f"last_{g}"]
    every = F.array_distinct(F.flatten(F.array(*[spelt(F.col(n)) for n in names])))
    texts = texts.withColumn("titled", every).withColumn("spoken", F.filter("titled", lambda w: ~common(w)))
    parts = F.struct(*[spelt(F.col(n)).alias(n) for n in names])
    return texts.withColumn("parts", parts).drop("names_f", "names_m", *names)


def pattern_of(spoken: Column, titled: Column) -> Column:
    """The pattern of a text's entities: the kinds besides names, the parts of its names that are no ordinary words wherever they stand as whole words, and the others right after a title."""
    # not within a longer word; an apostrophe binds letters except before a possessive s; Han names may touch other characters
    end = r"(?:(?<=\p{IsHan})|(?![\p{L}\p{M}\p{N}_])(?!['’](?!s(?![\p{L}\p{M}]))\p{L}))"
    words = F.concat(F.lit(r"|(?<![\p{L}\p{M}\p{N}_])(?<!\p{L}['’])(?:"), F.array_join(spoken, "|"), F.lit(")" + end))
    after = F.concat(F.lit(rf"|(?<=\b{_TITLE}\.? (?:{_LINK})?(?:{_LINK})?)(?:"), F.array_join(titled, "|"), F.lit(")" + end))
    return F.concat(F.lit(NAMELESS), F.when(F.size(titled) > 0, after).otherwise(""), F.when(F.size(spoken) > 0, words).otherwise(""))


def kind_of(e: Column) -> Column:
    """The type of a found entity, from its form alone."""
    digits = F.regexp_replace(e, r"\D", "")
    return (
        F.when(e.rlike(r"^[\w.%+-]+@"), "email")
        .when(e.rlike(r"^(AKIA|ASIA)[A-Z0-9]{16}$"), "access_key")
        .when(e.rlike(r"^[0-9a-f]*[a-f][0-9a-f]*$") & (F.length(e) >= 32), "hex")
        .when(e.rlike(rf"^({_OCTET}\.){{3}}{_OCTET}$"), "ip")
        .when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(e.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9 ]+$"), "iban")
        .when(e.rlike(r"^\d[\d -]*$") & (F.length(digits) >= 13), "card")
        .when(e.rlike(r"^[+(\d][\d ().+-]*$") & (F.length(digits) >= 8), "phone")
        .otherwise("password")
    )


def canonical(e: Column, kind: Column) -> Column:
    bare = F.regexp_replace(e, r"\D", "")
    return F.when(kind == "email", F.lower(e)).when(kind.isin("given", "surname"), F.initcap(F.lower(e))).when(kind.isin("card", "phone", "ssn"), bare).when(kind == "iban", F.regexp_replace(e, " ", "")).otherwise(e)


def _byte(h: Column, i: Column) -> Column:
    """The i-th pseudo-random number below 65536 from a hexadecimal digest, used again from its start beyond 61."""
    return F.conv(F.substring(h, (F.pmod(i, F.lit(61)) + 1).cast("int"), F.lit(4)), 16, 10).cast("int")


def _pick(alphabet: str, n: Column) -> Column:
    return F.substring(F.lit(alphabet), F.pmod(n, F.lit(len(alphabet))) + 1, F.lit(1))


def _masked(value: Column, h: Column, hexadecimal: bool = False) -> Column:
    """Each character replaced by one of its class."""
    low, up = ("abcdef", "ABCDEF") if hexadecimal else ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")

    def one(c, i):
        n = _byte(h, i)
        return F.when(c.rlike("[0-9]"), _pick("0123456789", n)).when(c.rlike("[a-z]"), _pick(low, n)).when(c.rlike("[A-Z]"), _pick(up, n)).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _reclassed(value: Column, h: Column) -> Column:
    """As _masked, but every character is replaced, letters within their script and symbols by symbols."""

    def one(c, i):
        n = _byte(h, i)
        out = F.when(c.rlike(CLASSES[0][0]), _pick(CLASSES[0][1], n))
        for form, alphabet in CLASSES[1:]:
            out = out.when(c.rlike(form), _pick(alphabet, n))
        return out.otherwise(_pick(SYMBOLS, n))

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a number without its check digit."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(d, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _check_digit(body: Column) -> Column:
    return F.pmod(10 - F.pmod(_luhn_sum(body), F.lit(10)), F.lit(10)).cast("string")


def surrogate(value: Column, kind: Column, gender: Column, attempt: Column, key: str = KEY) -> Column:
    """The replacement of a canonical entity at an attempt."""
    h = F.sha2(F.concat_ws("|", F.lit(key), kind, gender, value, attempt.cast("string")), 256)
    domain = F.substring_index(value, "@", -1)
    dh = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain), 256)
    email = F.concat(_masked(F.substring_index(value, "@", 1), h), F.lit("@"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: _pick("abcdefghijklmnopqrstuvwxyz", _byte(dh, i))), ""), F.lit(".example"))
    octet = lambda i, span, base: (F.pmod(_byte(h, F.lit(i)), F.lit(span)) + base).cast("string")
    head = F.when(value.startswith("10."), F.lit("10")).otherwise(octet(0, 200, 11))
    ip = F.when(value.startswith("192.168."), F.concat_ws(".", F.lit("192.168"), octet(5, 256, 0), octet(9, 254, 1))).otherwise(F.concat_ws(".", head, octet(5, 256, 0), octet(9, 256, 0), octet(13, 254, 1)))
    size = F.length(value)
    valid = _check_digit(F.expr("substring(canonical, 1, length(canonical) - 1)")) == F.substring(value, -1, 1)
    digits = _masked(value, h)
    body = F.concat(F.substring(value, 1, 1), digits.substr(F.lit(2), size - 2))
    card = F.concat(body, F.when(valid, _check_digit(body)).otherwise(F.substring(digits, -1, 1)))
    # a phone number keeps its first digit (country code or trunk) and its length
    phone = F.concat(F.substring(value, 1, 1), digits.substr(F.lit(2), size - 1))
    iban = F.concat(F.substring(value, 1, 2), _masked(F.expr("substring(canonical, 3)"), h))
    cyrillic = value.rlike(r"\p{IsCyrillic}")
    pick = lambda items, i: F.element_at(F.array(*map(F.lit, items)), F.pmod(_byte(h, i), F.lit(len(items))) + 1)

    def made(script: str) -> Column:
        """A syllable, one more for each attempt before, and the ending."""
        onsets, vowels, codas = SYLLABLES[script]
        stem = F.array_join(F.transform(F.sequence(F.lit(0), attempt), lambda k: F.concat(pick(onsets, 9 * k), pick(vowels, 9 * k + 3), pick(codas, 9 * k + 6))), "")
        end = F.lit("")
        for (s, part, g), items in ENDINGS.items():
            if s == script:
                end = F.when((kind == part) & ((gender == g) | F.lit((s, part) == ("latin", "surname"))), pick(items, F.lit(31))).otherwise(end)
        return F.initcap(F.concat(stem, end))

    name = F.when(value.rlike(r"\p{IsCyrillic}"), made("cyrillic")).when(value.rlike(r"\p{IsLatin}"), made("latin")).otherwise(_reclassed(value, h))
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", phone)
        .when(kind == "hex", _masked(value, h, True)).when(kind == "access_key", F.concat(F.substring(value, 1, 4), _masked(F.expr("substring(canonical, 5)"), h)))
        .when(kind == "iban", iban).when(kind.isin("given", "surname"), name).otherwise(_reclassed(value, h))
    )


def _dressed(e: Column, kind: Column, s: Column) -> Column:
    """A canonical surrogate in the spelling of the entity it replaces: digits run into its separators."""
    shown = F.array_join(
        F.transform(F.split(e, ""), lambda c, i: F.when(c.rlike("[0-9A-Z]"), F.substring(s, F.length(F.regexp_replace(F.substring(e, F.lit(1), i + 1), "[^0-9A-Z]", "")), F.lit(1))).otherwise(c)),
        "",
    )
    rest = F.substring(s, F.length(F.regexp_replace(e, "[^0-9A-Z]", "")) + 1, F.length(s))
    capitals = kind.isin("given", "surname") & (F.upper(e) == e)
    return F.when(kind.isin("card", "phone", "ssn", "iban"), F.concat(shown, rest)).when(capitals, F.upper(s)).otherwise(s)


def _typed(hits: DataFrame) -> DataFrame:
    """The entities e of ``hits`` with row_key, each once a row, and their kind, gender and canonical form."""
    e = hits.select("row_key", "parts", F.explode(F.array_distinct("found")).alias("e"))
    has = lambda k: F.array_contains(f"parts.{k}", F.col("e"))
    last = has("last_f") | has("last_m")
    kind = F.when(last, "surname").when(has("first_f") | has("first_m"), "given").otherwise(kind_of(F.col("e")))
    she, he = F.when(last, has("last_f")).otherwise(has("first_f")), F.when(last, has("last_m")).otherwise(has("first_m"))
    of_name = F.when((she & he) | (last & ~F.col("e").rlike(r"\p{IsCyrillic}")), "n").when(she, "f").otherwise("m")
    e = e.withColumn("kind", kind).withColumn("gender", F.when(F.col("kind").isin("given", "surname"), of_name).otherwise(""))
    return e.select("row_key", "e", "kind", "gender", canonical(F.col("e"), F.col("kind")).alias("canonical"))


def _numbered(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with rank, from 0 in steps of 1, and total; rows are numbered within blocks, only the blocks' sizes meet."""
    df = cut(df.withColumn("block", F.pmod(F.xxhash64(*keys), F.lit(1024))))
    sizes = df.groupBy("block").agg(F.count("*").alias("size"))
    start = sizes.select("block", (F.sum("size").over(Window.orderBy("block")) - F.col("size")).alias("start"), F.sum("size").over(Window.partitionBy()).alias("total"))
    within = F.row_number().over(Window.partitionBy("block").orderBy(*keys)) - 1
    return df.withColumn("within", within).join(F.broadcast(start), "block").withColumn("rank", F.col("start") + F.col("within")).drop("block", "within", "start")


def _longer(kind: Column, canonical: Column, surrogate: Column, more: Column) -> Column:
    """A surrogate with the digits or letters of its number put in, all numbers of one length."""
    letters = F.translate(more, "0123456789", "aeioubdlnr")
    valid = _check_digit(F.substring(canonical, F.lit(1), F.length(canonical) - 1)) == F.substring(canonical, -1, 1)
    body = F.concat(F.substring(surrogate, F.lit(1), F.length(surrogate) - 1), more)
    return (
        F.when(kind == "email", F.concat(F.substring_index(surrogate, "@", 1), more, F.lit("@"), F.substring_index(surrogate, "@", -1)))
        .when(kind == "card", F.concat(body, F.when(valid, _check_digit(body)).otherwise(F.substring(surrogate, -1, 1))))
        .when(kind.isin("given", "surname"), F.concat(surrogate, F.when(surrogate.rlike(r"\p{IsCyrillic}"), F.translate(more, "0123456789", "аеиоубдлнр")).otherwise(letters)))
        .otherwise(F.concat(surrogate, more))
    )


def _free_addresses(left: DataFrame, settled: DataFrame, occur: DataFrame) -> DataFrame:
    """The addresses of ``left`` with free ones: of as many as are used and wanted, counted on from 10.0.0.0, enough are free."""
    used = settled.filter("kind = 'ip'").select("surrogate").union(occur.filter("kind = 'ip'").select("surrogate")).distinct()
    want = _numbered(left.filter("kind = 'ip'"), "gender", "canonical").drop("total")
    n = want.count()
    if not n:
        return left.filter("kind = 'ip'")
    at = F.pmod(F.col("id") + (10 << 24), F.lit(1 << 32))
    octets = [F.shiftright(at, k).bitwiseAND(F.lit(255)).cast("string") for k in (24, 16, 8, 0)]
    free = left.sparkSession.range(n + used.count()).select(F.concat_ws(".", *octets).alias("surrogate")).join(used, "surrogate", "left_anti")
    return want.drop("surrogate").join(_numbered(free, "surrogate").select("surrogate", "rank"), "rank").select(left.columns)


def _finished(judged: DataFrame, occur: DataFrame) -> DataFrame:
    """The bad ones of ``judged`` numbered; the rest keep their surrogates, and the numbered ones grow until they meet none."""
    settled, left = judged.filter("not bad").select("kind", "gender", "canonical", "surrogate"), judged.filter("bad").select("kind", "gender", "canonical", "surrogate")
    addresses = _free_addresses(left, settled, occur)
    used = settled.select("kind", "surrogate").union(occur).distinct()
    now = cut(_numbered(left.filter("kind <> 'ip'"), "kind", "gender", "canonical"))
    done, grown = settled.unionByName(addresses), 0
    while True:
        # numbers of one length keep them distinct; one longer than all in use meets none, so this ends
        more = F.lpad(F.col("rank").cast("string"), F.length((F.col("total") - 1).cast("string")) + grown, "0")
        tried = cut(now.withColumn("long", _longer(F.col("kind"), F.col("canonical"), F.col("surrogate"), more)))
        if not tried.join(used.withColumnRenamed("surrogate", "long"), ["kind", "long"], "left_semi").take(1):
            return cut(done.unionByName(tried.select("kind", "gender", "canonical", F.col("long").alias("surrogate"))))
        grown += 1


def assign(entities: DataFrame, key: str = KEY) -> DataFrame:
    """kind, gender, canonical, surrogate: distinct within each kind, and none an entity that occurs."""
    given = F.col
    now = cut(entities.withColumn("attempt", F.lit(0)))
    occur = cut(now.select("kind", F.col("canonical").alias("surrogate")).distinct())
    for round_ in range(ATTEMPTS):
        now = cut(now.withColumn("surrogate", surrogate(given("canonical"), given("kind"), given("gender"), given("attempt"), key)))
        shared = now.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.min(F.struct("gender", "canonical")).alias("first")).filter("n > 1").select("kind", "surrogate", "first")
        bad = (F.col("first").isNotNull() & (F.col("first") != F.struct("gender", "canonical"))) | F.col("taken").isNotNull()
        judged = cut(now.join(shared, ["kind", "surrogate"], "left").join(occur.withColumn("taken", F.lit(True)), ["kind", "surrogate"], "left").withColumn("bad", bad).drop("first", "taken"))
        if not judged.filter("bad").take(1):
            return judged.select("kind", "gender", "canonical", "surrogate")
        now = judged.select("kind", "gender", "canonical", (F.col("attempt") + F.col("bad").cast("int")).alias("attempt"))
    return _finished(judged, occur)


def replace_pii(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with entities in text replaced; n_entities counts them.

    All texts are searched for entities, and for words of names that are ordinary elsewhere. Rows with entities are written and shuffled; the others are told by a bit table of fixed
    size over the hashes of texts, and only those that it cannot tell are joined to the list of texts with entities.
    """
    names = [c for c in docs.columns if c != "n_entities"]
    # a row travels as one struct, so that its columns cannot clash with those made here
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "text", F.xxhash64("text").alias("row_key"), F.xxhash64(F.lit(1), "text").alias("row_key2"))
    some = F.coalesce(F.col("text").rlike(HINT) & F.col("text").rlike(PATTERN), F.lit(False))
    named = cut(with_names(marked.filter(some)))
    with_any = named.filter("size(names_f) + size(names_m) > 0").select("row_key", "names_f", "names_m")
    named = with_parts(with_ordinary(named, ordinary_words(with_any, marked.select("row_key", "text"))))
    named = named.withColumn("pattern", pattern_of(F.col("spoken"), F.col("titled"))).drop("spoken", "titled", "ordinary")
    hits = cut(named.withColumn("found", F.regexp_extract_all("text", F.col("pattern"), F.lit(0))))
    used = _typed(hits)
    table = assign(used.select("kind", "gender", "canonical").distinct(), key)
    used = used.join(table, ["kind", "gender", "canonical"]).select("row_key", "e", _dressed(F.col("e"), F.col("kind"), F.col("surrogate")).alias("s")).distinct()
    of_row = used.groupBy("row_key").agg(F.map_from_entries(F.collect_set(F.struct("e", "s"))).alias("s"))
    parts = F.split("text", F.col("pattern"), -1)
    fill = F.zip_with(parts, F.transform("found", lambda e: F.coalesce(F.element_at(F.col("s"), e), F.lit("[removed]"))), lambda p, x: F.concat(p, F.coalesce(x, F.lit(""))))
    done = hits.join(of_row, "row_key", "left").withColumn("text", F.array_join(fill, ""))
    n = F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_entities")
    out = [F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names]
    keys = hits.select("row_key", "row_key2").distinct()
    told = with_seen(marked, marks(keys, "row_key"), "row_key")
    rest = told.filter("text is null or not seen").unionByName(told.filter("text is not null and seen").join(keys, ["row_key", "row_key2"], "left_anti").select(told.columns))
    return rest.select(*out, F.lit(0).cast("long").alias("n_entities")).unionByName(done.select(*out, n))
