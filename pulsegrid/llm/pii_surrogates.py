"""Surrogates for personal data: keyed, of the same type and format, distinct and the same wherever an entity recurs.

Only DataFrame functions: a combined pattern finds the entities, a table holds one row per distinct entity of the
corpus with its surrogate, collisions get another attempt, and each text is put together again from the parts
between the matches and the surrogates.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import union_all, written

#: Given names by (script, gender), the titles that show a gender, and surname syllables by script: fixed word lists.
GIVEN = {
    ("latin", "f"): "Anna Maria Laura Julia Clara Sophie Emma Alice Nora Helen Ruth Irene Paula Lucia Carmen Elena Marie Claire Ingrid Greta",
    ("latin", "m"): "Peter Paul Martin Thomas David Daniel Simon Robert Frank Henry Oscar Victor Hugo Pablo Carlos Pierre Jean Karl Hans Otto",
    ("cyrillic", "f"): "Анна Мария Ольга Елена Ирина Татьяна Наталья Светлана Юлия Вера",
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил Павел Олег",
}
TITLES = {"f": "Mrs Ms Miss Frau Mme Madame Señora Sra", "m": "Mr Herr Monsieur Señor Sr", "": "Dr Prof"}
SYLLABLES = {"latin": "ba de fi go lu mar nel por ric sten tan vel wes yor zan", "cyrillic": "ба де фи го лу мар нел пор рик стен тан вел зор ков лин"}

#: What stands before a name in its field or sentence: a fixed word list.
INTRODUCTIONS = "name is|Name:|name:|Author:|author:|Contact:|contact:|Signed:|signed:|From:|Name ist|heiße|Nombre:|nombre:|llamo|appelle|Nom :|Имя:|зовут"
PARTICLES = "von van zu de del di da la le der den dos"
#: The first six digits of card surrogates by the first digit of the card: prefixes that no issuer uses, or only tests.
PREFIXES = {"2": "200000", "3": "330000", "4": "400000", "5": "590000", "6": "690000"}

_names = "|".join(n for v in GIVEN.values() for n in v.split())
_titles = "|".join(t for v in TITLES.values() for t in v.split())
_name_of_secret = r"(?=[PpTtSsAa])(?i:password|passwd|token|secret|api_key|apikey)\s{0,2}[=:]\s{0,2}[\"']?"
#: How access tokens of common services begin, and signed web tokens: fixed values of their formats.
TOKENS = r"gh[pousr]_|github_pat_|glpat-|[sr]k_(?:live|test)_|xox[abeoprs]-|AIza|eyJ|[Bb]earer "
_group = "[0-9A-Fa-f]{1,4}"
#: First groups of addresses that are in use: global, unique local, link-local and multicast (fixed values).
_routed = "(?:[23][0-9A-Fa-f]{3}|[Ff][CDEFcdef][0-9A-Fa-f]{2})"
_cap = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
_surname = rf"(?:\p{{Lu}}['’])?{_cap}"
#: Initials and particles between the given name and the surname.
_between = rf"(?:\p{{Lu}}\. ){{0,2}}(?:(?:{PARTICLES.replace(' ', '|')}) ){{0,2}}"

#: (type, pattern) in the order in which they are tried at a place.
PATTERNS = [
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ipv4", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"),
    ("ipv6", rf"(?={_group}:)(?<![\p{{L}}\p{{N}}:.])(?:(?:{_group}:){{7}}{_group}|{_routed}(?::{_group}){{0,6}}::(?:{_group}(?::{_group}){{0,5}})?)(?![\p{{L}}\p{{N}}:]|\.\d)"),
    ("card", r"(?<![\d])(?:\d[ -]?){12,18}\d(?!\d)"),
    ("phone", r"(?<![\p{L}\d])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}"
     r"|0\d(?:[ .-]\d{2}){4}(?![ .-]\d)|0\d{1,4}[ /-]\d{3,4}[ -]\d{3,4}(?![ .-]\d)|\(0\d{1,4}\) ?\d{3,4}[ -]?\d{3,4})(?!\d)"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("key", r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"),
    ("token", rf"(?=[PpTtSsAagrxeBb])(?:{_name_of_secret}|(?<![A-Za-z0-9_]))(?:{TOKENS})[A-Za-z0-9_.~+/=-]{{9,}}[A-Za-z0-9_~+/=-]"),
    ("secret", rf"{_name_of_secret}[^\s\"'`<>,;&|]{{7,}}[^\s\"'`<>,;&|.:!?]"),
    ("person", rf"(?=\p{{Lu}})(?<!\p{{L}})(?:(?:{_titles})\.? (?:{_cap} )?{_between}{_surname}|(?:{_names}) {_between}{_surname}|(?<=(?:{INTRODUCTIONS}) ){_cap} {_between}{_surname})(?!\p{{L}})"),
]
#: Title, given name, what is between, and surname of a person.
_parts = rf"^((?:(?:{_titles})\.? )?)(?:({_cap})(?= ))?(.*?)({_surname})$"
#: Where a card number may be in a run of digits: the whole run in any grouping, or the usual groupings and single groups in it.
#: Each place is looked at, so that a candidate without a valid check digit hides none that has one.
_issued = r"(?:[3-6]\d{3}|2(?:2[2-9]|[3-6]\d|7[0-2])\d)"
CARDS = [
    r"(?<!\d)(?<!\d[ -])(?=((?:\d[ -]?){12,18}\d)(?!\d))",
    *(rf"(?<!\d)(?=({p})(?!\d))" for p in (rf"{_issued}(?:[ -]\d{{4}}){{3}}[ -]\d{{3}}", rf"{_issued}(?:[ -]\d{{4}}){{3}}", rf"{_issued}[ -]\d{{6}}[ -]\d{{4,5}}", r"\d{13,19}")),
]
#: The digits that card networks issue, by first digits and length (a fixed value of their formats).
NETWORKS = (
    r"^(?:4(?:\d{12}|\d{15}|\d{18})|5[1-5]\d{14}|2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)\d{12}|3[47]\d{13}|3(?:0[0-59]|[689]\d)\d{11}(?:\d{2})?|35(?:2[89]|[3-8]\d)\d{12}"
    r"|(?:6011|65\d\d|64[4-9]\d)\d{12}(?:\d{3})?|62\d{14}(?:\d{3})?|(?:50|5[6-9]|6[37])\d{14})$"
)
#: The country code at the start of an international number's digits.
COUNTRY = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Characters of an entity that are replaced one by one; what is longer than that goes on in hexadecimal digits.
SPELLED = 256
#: Attempts in which phones get numbers that cannot be dialled.
BARRED = 20
#: What makes of a surname that stands alone another name: fixed word lists.
NAMED_AFTER = "University|College|School|Institute|Hospital|Museum|Street|Road|Avenue|Square|Bridge|County|River|Lake|Company|Corporation|Inc|Ltd|GmbH"
#: Between two characters.
MARKS = "(?!^)(?!$)"
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a text of digits."""
    doubled = lambda d, i: F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
    each = F.transform(F.split(F.reverse(digits), MARKS), lambda c, i: doubled(c.cast("int"), i))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def is_card(surface: Column) -> Column:
    digits = _digits(surface)
    return digits.rlike(NETWORKS) & (luhn_sum(digits) % 10 == 0)


def kind_of(surface: Column) -> Column:
    """The type of a matched text; null for digits that are no card number; letters alone are a name found by what is around it."""
    whole = F.coalesce(*[F.when(surface.rlike(f"^(?:{p})$"), t) for t, p in PATTERNS], F.when(surface.rlike(rf"^(?:{_cap} )?{_between}{_surname}$"), "person"))
    return F.when((whole == "card") & ~is_card(surface), None).otherwise(whole)


def pattern_of(text: Column) -> Column:
    """The combined pattern for one text: card numbers are only those of it that are issued and have a valid check digit, and the
    surnames of its persons are found where they stand alone, too."""
    places = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in CARDS]))
    cards = F.array_distinct(F.filter(places, is_card))
    longest = F.array_sort(cards, lambda a, b: F.length(b) - F.length(a))
    listed = F.concat(F.lit(r"(?:(?<!\d)(?:"), F.array_join(longest, "|"), F.lit(r")(?!\d))|"))
    names = [t for t, _ in PATTERNS]
    before, after = (F.lit("|".join(f"(?:{p})" for _, p in part)) for part in (PATTERNS[: names.index("card")], PATTERNS[names.index("card") + 1 :]))
    own = F.concat(before, F.lit("|"), F.when(F.size(cards) > 0, listed).otherwise(""), after)
    found = F.when(text.rlike(dict(PATTERNS)["card"]), own).otherwise(F.concat(before, F.lit("|"), after))
    persons = F.regexp_extract_all(text, F.lit(dict(PATTERNS)["person"]), F.lit(0))
    surnames = F.array_distinct(F.transform(persons, lambda c: F.regexp_extract(c, _parts, 4)))
    alone = F.concat(F.lit(r"|(?:(?<![\p{L}'’-])(?<![Tt]he )(?:"), F.array_join(surnames, "|"), F.lit(rf")(?![\p{{L}}-]| (?:{NAMED_AFTER})(?!\p{{L}})))"))
    return F.when(F.size(surnames) > 0, F.concat(found, alone)).otherwise(found)


def canonical(kind: Column, surface: Column) -> Column:
    """The form that all spellings of one entity share; of a person, the surname, without the ending of the feminine form."""
    surname = F.regexp_replace(F.regexp_extract(surface, _parts, 4), "(ов|ев|ин)а$", "$1")
    return (
        F.when(kind == "email", F.lower(surface)).when(kind.isin("card", "ssn"), _digits(surface))
        .when(kind == "phone", F.concat(F.when(surface.startswith("+"), "+").otherwise(""), _digits(surface))).when(kind == "iban", F.regexp_replace(surface, " ", ""))
        .when(kind.isin("secret", "token"), F.regexp_replace(surface, f"^{_name_of_secret}", "")).when(kind == "ipv6", F.lower(surface)).when(kind == "surname", surname).otherwise(surface)
    )


def given_names(key: str) -> Column:
    """Listed given names with their surrogates: each list is turned by a keyed number of places, so that no two share one."""
    pairs: list[Column] = []
    for kind, names in GIVEN.items():
        listed = names.split()
        turn = 1 + int(hashlib.sha256(f"{key}|{kind}".encode()).hexdigest(), 16) % (len(listed) - 1)
        pairs += [F.lit(x) for k, n in enumerate(listed) for x in (n, listed[(k + turn) % len(listed)])]
    return F.create_map(*pairs)


def _stream(seed: Column, length: Column) -> Column:
    """Hex digits of keyed hashes, two for each of ``length`` characters at least."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(length / 32).cast("int")), lambda k: F.sha2(F.concat_ws("|", seed, k.cast("string")), 256))
    return F.array_join(blocks, "")


def _mapped(text: Column, stream: Column, hexed: Column) -> Column:
    """Letters and digits replaced by others of their class; hexadecimal texts stay hexadecimal."""
    at = lambda i: F.conv(F.substring(stream, 2 * i + 1, 2), 16, 10).cast("int")

    def one(c: Column, i: Column) -> Column:
        pick = lambda s, n: F.substring(F.lit(s), F.pmod(at(i), F.lit(n)) + 1, F.lit(1))
        return (
            F.when(hexed, pick("0123456789abcdef", 16)).when(c.rlike("[0-9]"), pick("0123456789", 10)).when(c.rlike(r"\p{Lu}"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 26))
            .when(c.rlike(r"\p{L}"), pick("abcdefghijklmnopqrstuvwxyz", 26)).otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, MARKS), one), "")


def _number(stream: Column, at: int, n: int) -> Column:
    """A number below n from 8 hex digits of the stream."""
    return F.pmod(F.conv(F.substring(stream, at + 1, 8), 16, 10).cast("long"), F.lit(n))


def _syllables(canon: Column, stream: Column, most: Column) -> Column:
    """A name put together from syllables of the script of ``canon``."""

    def of(script: str) -> Column:
        listed = SYLLABLES[script].split()
        parts = F.array(*[F.element_at(F.array(*map(F.lit, listed)), (_number(stream, 7 * k, len(listed)) + 1).cast("int")) for k in range(8)])
        return F.initcap(F.array_join(F.slice(parts, F.lit(1), F.least(most, F.lit(8))), ""))

    return F.when(canon.rlike(r"\p{IsCyrillic}"), of("cyrillic")).otherwise(of("latin"))


def iban_check(country: Column, body: Column) -> Column:
    """The two check digits of an account number."""
    places = F.split(F.concat(body, country, F.lit("00")), MARKS)
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(places, F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)
    return F.lpad((F.lit(98) - rest).cast("string"), 2, "0")


def surrogate(kind: Column, canon: Column, key: str, attempt: Column, gender: Column) -> Column:
    """The surrogate of a canonical entity: a keyed function of type, entity and attempt."""
    stream = _stream(F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string")), F.greatest(F.length(canon), F.lit(64)))
    hexed = (kind == "secret") & canon.rlike("^[0-9a-f]+$")
    spelled = _mapped(F.substring(canon, 1, SPELLED), stream, hexed)
    mapped = F.concat(spelled, F.substring(stream, F.lit(2 * SPELLED + 1), F.greatest(F.length(canon) - SPELLED, F.lit(0))))
    octet = lambda at, low, n: (_number(stream, at, n) + low).cast("string")
    digits = lambda at, n, width: F.lpad(_number(stream, at, n).cast("string"), width, "0")
    first = F.substring(canon, 1, 1)
    prefix = F.coalesce(*[F.when(first == d, p) for d, p in PREFIXES.items()], F.concat(first, F.lit("00000")))
    body = F.concat(prefix, F.substring(mapped, F.lit(7), F.length(canon) - 7))
    check = F.pmod(F.lit(10) - luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string")
    local = _mapped(F.regexp_extract(canon, "^([^@]+)@", 1), stream, F.lit(False))
    country = F.when(canon.startswith("+"), F.length(F.regexp_extract(F.substring(canon, 2, 3), COUNTRY, 0)) + 1).otherwise(0)
    # no area code begins like this; where such numbers run out the later attempts may take any
    barred = F.when(F.substring(canon, country + 1, F.lit(1)) == "0", "000").when(country > 0, "0").otherwise("1")
    barred = F.when((attempt < BARRED) & (F.length(canon) - country >= 7), barred).otherwise("")
    begun = F.concat(F.substring(canon, F.lit(1), country), barred)
    phone = F.concat(begun, F.substring(mapped, F.length(begun) + 1, F.length(canon)))
    service = F.regexp_extract(canon, f"^(?:{TOKENS})", 0)
    groups = F.concat_ws(":", F.lit("2001:db8"), *[F.lower(F.hex(_number(stream, 8 * k, 65_536))) for k in range(6)])
    area = _number(stream, 0, 102)
    unissued = F.concat(F.when(area == 100, "000").when(area == 101, "666").otherwise((area + 900).cast("string")), digits(8, 50, 2), digits(16, 10_000, 4))
    account = F.substring(mapped, F.lit(5), F.length(canon))
    iban = F.concat(F.substring(canon, 1, 2), iban_check(F.substring(canon, 1, 2), account), account)
    name = _syllables(canon, stream, F.lit(3) + F.floor(attempt / 3).cast("int"))
    second = _syllables(canon, F.substring(stream, F.lit(64), F.length(stream)), F.lit(2))
    surname = F.when(canon.contains("-"), F.concat(name, F.lit("-"), second)).when(canon.rlike("(ов|ев|ин)$"), F.concat(name, F.lit("ов"))).otherwise(name)
    feminine = F.when(canon.rlike(r"\p{IsCyrillic}"), "на").otherwise("na")
    return (
        F.when(kind == "email", F.concat(local, F.lit("@mail"), F.substring(stream, 33, 6), F.lit(".example.net")))
        .when(kind == "ipv4", F.concat_ws(".", octet(0, 240, 15), octet(8, 1, 254), octet(16, 1, 254), octet(24, 1, 254)))
        .when(kind == "card", F.concat(body, check)).when(kind == "key", F.concat(F.lit("AKIA"), F.substring(mapped, 5, 16)))
        .when(kind == "iban", iban).when((kind == "ssn") & (F.length(canon) == 9), unissued)
        .when(kind == "phone", phone).when(kind == "ipv6", groups).when(kind == "token", F.concat(service, F.substring(mapped, F.length(service) + 1, F.length(canon))))
        .when(kind == "surname", surname).when(kind == "given", F.when(gender == "f", F.concat(name, feminine)).otherwise(name)).otherwise(mapped)
    )


def rendered(kind: Column, surface: Column, replaced: Column, given: Column) -> Column:
    """A canonical surrogate in the spelling of the matched text: separators, title, initials and name of the secret stay."""
    marks = F.split(surface, MARKS)
    characters = F.when(kind == "phone", _digits(replaced)).otherwise(replaced)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def put(a: Column, c: Column) -> Column:
        own = c.rlike("[A-Z0-9]")
        shown = F.when(~own, c).otherwise(F.substring(characters, a.n + 1, F.lit(1)))
        return F.struct(F.concat(a.out, shown).alias("out"), (a.n + own.cast("int")).alias("n"))

    spelled = F.aggregate(marks, start, put).out
    part = lambda g: F.regexp_extract(surface, _parts, g)
    feminine = F.when(part(4).rlike("(ов|ев|ин)а$"), "а").otherwise("")
    person = F.concat(part(1), F.coalesce(given, F.lit("")), part(3), replaced, feminine)
    before = F.when(kind.isin("secret", "token"), F.regexp_extract(surface, f"^{_name_of_secret}", 0)).otherwise("")
    return F.when(kind.isin("card", "phone", "ssn", "iban"), spelled).when(kind == "surname", person).otherwise(F.concat(before, replaced))


def _attempted(entities: DataFrame, key: str) -> DataFrame:
    return entities.withColumn("surrogate", surrogate(F.col("kind"), F.col("canon"), key, F.col("attempt"), F.col("gender")))


def _collisions(table: DataFrame) -> DataFrame:
    """Entities whose surrogate is that of another one (all but the least) or is itself an entity of the corpus."""
    shared = table.groupBy("kind", "surrogate").agg(F.min("canon").alias("keeper"), F.count("*").alias("n")).filter("n > 1").drop("n")
    twice = table.join(shared, ["kind", "surrogate"]).filter("canon <> keeper").select("kind", "canon")
    real = table.select("kind", F.col("canon").alias("surrogate"))
    return twice.unionByName(table.join(real, ["kind", "surrogate"], "left_semi").select("kind", "canon")).distinct()


def surrogate_table(entities: DataFrame, key: str, max_attempts: int = 60) -> DataFrame:
    """``(kind, canon, surrogate)`` for distinct ``entities(kind, canon, gender)``, all surrogates of a kind distinct."""
    table = written(_attempted(entities.withColumn("attempt", F.lit(0)), key), "surrogates")
    for _ in range(max_attempts):
        bad = written(_collisions(table), "collisions")
        if bad.isEmpty():
            return table.select("kind", "canon", "surrogate")
        again = _attempted(table.join(bad, ["kind", "canon"], "left_semi").drop("surrogate").withColumn("attempt", F.col("attempt") + 1), key)
        table = written(table.join(bad, ["kind", "canon"], "left_anti").unionByName(again), "surrogates")
    raise RuntimeError("surrogates still collide")


def possible(text: Column) -> Column:
    """True for every text that a pattern matches: each needs one of these, which are quick to look for."""
    return text.contains("AKIA") | text.contains("@") | text.contains("=") | text.contains(":") | text.rlike("[0-9]") | text.rlike(TOKENS) | text.rlike(dict(PATTERNS)["person"])


def replace_entities(docs: DataFrame, key: str, text_col: str = "text", count_col: str = "n_entities") -> DataFrame:
    """``docs`` with each personal datum in ``text_col`` replaced, and ``count_col`` added (or overwritten).

    Texts without entities, null and empty texts are unchanged with 0 entities; long texts are handled whole. An entity has one
    surrogate in the whole table; two entities never share one, and no surrogate is an entity of the table. Of persons, the surname and an
    unlisted given name are entities, and listed given names change places within their list, so a person keeps one name
    wherever they are named, with or without title and given name. Phones keep their country code, which is part of
    the entity, so the numbers that are compared are those that are shown. Cards and IBANs have valid check digits; cards, social security
    numbers, e-mail hosts and addresses come from ranges that are reserved or not issued, and phones of 7 digits or more begin as no area
    code does unless these numbers run out. Access tokens keep the mark of their service. A version 6 address is the same entity in one spelling
    only. A surname alone stays after an article and in names of institutions and streets. Only rows with matches are
    shuffled; an entity that a third of all rows share is a key of a partial aggregation and of a join that adaptive execution
    splits. Other columns may have any name.
    """
    text = F.col(text_col)
    hit = F.coalesce(possible(text) & text.rlike(ANY), F.lit(False))
    clean = docs.filter(~hit).withColumn(count_col, F.lit(0))
    held = written(docs.filter(hit).select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("rid"), pattern_of(text).alias("pattern")), "pii-rows")
    matches = held.select("rid", F.posexplode(F.regexp_extract_all(F.col("row")[text_col], F.col("pattern"), F.lit(0))).alias("pos", "surface"))
    found = matches.withColumn("kind", kind_of(F.col("surface"))).withColumn("kind", F.when(F.col("kind") == "person", "surname").otherwise(F.col("kind")))
    listed = given_names(key)
    part = lambda g: F.when(F.col("kind") == "surname", F.regexp_extract("surface", _parts, g))
    title = F.regexp_replace(part(1), r"[. ]", "")
    gender = F.coalesce(*[F.when(title.isin(t.split()), F.lit(g)) for g, t in TITLES.items() if g], F.lit(""))
    found = found.withColumn("canon", canonical(F.col("kind"), F.col("surface"))).withColumn("given", F.nullif(part(2), F.lit(""))).withColumn("gender", gender)
    found = written(found, "pii-matches")
    known = F.col("given").isin(_names.split("|"))
    entities = found.filter("kind is not null").select("kind", "canon", F.lit("").alias("gender"))
    entities = entities.unionByName(found.filter(F.col("given").isNotNull() & ~known).select(F.lit("given").alias("kind"), F.col("given").alias("canon"), "gender"))
    table = surrogate_table(entities.groupBy("kind", "canon").agg(F.max("gender").alias("gender")), key)
    unlisted = table.filter("kind = 'given'").select(F.col("canon").alias("given"), F.col("surrogate").alias("new_given"))
    mapped = found.join(table, ["kind", "canon"], "left").join(unlisted, "given", "left")
    put = rendered(F.col("kind"), F.col("surface"), F.col("surrogate"), F.coalesce(F.element_at(listed, F.col("given")), "new_given"))
    mapped = mapped.withColumn("put", F.coalesce(put, F.col("surface")))
    puts = mapped.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("pos", "put"))).alias("puts"), F.count("surrogate").cast("int").alias("n"))
    gaps = F.split(F.col("row")[text_col], F.col("pattern"), -1)
    whole = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(F.col("puts"), i)["put"], F.lit("")))), "")
    done = held.join(puts, "rid", "left").withColumn("whole", whole).withColumn("n", F.coalesce("n", F.lit(0)))
    done = done.select(*[F.col("whole").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c != count_col], F.col("n").alias(count_col))
    return union_all([clean.select(*done.columns), done])
