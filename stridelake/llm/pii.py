"""Surrogates for personal data, in Spark SQL functions alone.

Detected entities (mail and IP addresses, phone, card, account (IBAN) and identity numbers, secrets, names with a title) are
replaced by surrogates made from a keyed digest of the entity: of the same type, gender, script and format, the same for the same
entity in every document (coreference), and others for others. Phones keep their country code, accounts their country and valid
check digits, cards that pass the Luhn check get surrogates that do. The family of a name is an entity of its own, so that
"Mr Novak" and "Mr Jan Novak" keep one family name whatever becomes of their given names; and other mentions of a family that a
document names with a title ("Novak agreed") get its surrogate too. A title without gender ("Dr") gives names of either.

The entities of the corpus are checked for collisions: where two have one surrogate, or a surrogate is itself an entity of
the corpus, all but one go on to their next digest until none collides. Later digests draw from spaces that grow with the
attempt, so that this ends however many entities of a short form there are. A first digest is computed in place, so texts are
joined with nothing unless an entity in them had to go on.

No pattern repeats a group without bound but possessively: such groups are matched in a loop, others by recursion, which a
long text would take too deep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridelake.llm.common import fresh, stored

#: Titles by gender, and names and syllables by gender and script: fixed values.
TITLES = {
    "m": ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"],
    "n": ["Dr", "Prof", "Professor", "Rev", "Mx", "Доктор", "Профессор"],
}
#: Words that make no name of a title before them: offices, callings, products.
NO_NAMES = ["President", "Speaker", "Chairman", "Chairwoman", "Chair", "Minister", "Secretary", "Ambassador", "Judge", "Justice", "Mayor", "Governor", "Director", "Manager", "Engineer", "Developer", "Software", "Analyst", "Office", "Windows", "Word", "Excel", "Access", "Outlook", "Teams", "Dos"]
GIVEN = {
    ("m", "latin"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "George", "Hugo", "Ivan", "Jonas", "Karim", "Leo", "Martin", "Noel", "Oscar", "Paul"],
    ("f", "latin"): ["Anna", "Bella", "Clara", "Diana", "Emma", "Flora", "Greta", "Helen", "Irene", "Julia", "Karin", "Laura", "Maria", "Nora", "Olivia", "Paula"],
    ("n", "latin"): ["Alex", "Ariel", "Blair", "Casey", "Charlie", "Dana", "Eden", "Jamie", "Jordan", "Kim", "Morgan", "Quinn", "Robin", "Sam", "Taylor", "Toni"],
    ("n", "cyrillic"): ["Саша", "Женя", "Валя", "Слава"],
    ("m", "cyrillic"): ["Алексей", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Николай", "Олег", "Павел", "Роман", "Сергей", "Тимур"],
    ("f", "cyrillic"): ["Анна", "Белла", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Клара", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "София", "Тамара"],
}
SYLLABLES = {
    "latin": ["ba", "der", "fi", "gor", "hal", "jen", "kas", "lin", "mor", "nev", "ros", "sel", "tam", "vik", "wen", "zor"],
    "cyrillic": ["ба", "дер", "фи", "гор", "хал", "жен", "кас", "лин", "мор", "нев", "рос", "сел", "там", "вик", "вен", "зор"],
}

#: Entities that had to go on, in documents, up to which their table is broadcast; a larger one is joined by a shuffle.
BROADCAST_ENTRIES = 100_000

_MAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++"
_SECRET = r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,64}+(?![0-9A-Za-z])"
#: No version ("v1.2.3.4").
_IP = r"(?<![0-9.])(?<![vV])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
#: Eight groups, or two and more before a double colon.
_IP6 = r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5})(?![0-9A-Za-z:])"
_CARD = r"(?<![0-9A-Za-z])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])"
_SEVEN = "(?<=[0-9]" + r"[ .\-()]{0,2}[0-9]" * 6 + ")"
#: After a plus, seven digits at least (the lookbehind cannot pass the plus), and no decimal below one: no country code is 0.
_PHONE = r"(?<![0-9A-Za-z])(?:\+(?!0\.)[0-9]{1,3}(?:[ .\-]?\([0-9]{1,4}\)|[ .\-][0-9]{1,4})(?:[ .\-]?[0-9]{2,4}){1,4}" + _SEVEN + r"|\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}|(?<![0-9] )[2-9][0-9]{2} [2-9][0-9]{2} [0-9]{4}(?! ?[0-9]))(?![0-9])"
_IDENTITY = r"(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
#: A country, two check digits, and 11 letters and digits at least, in fours or without blanks, six of them digits.
_ACCOUNT = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?=(?: ?[A-Z0-9]){11})(?=(?:[ A-Z]{0,30}+[0-9]){6})(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
_ANY_TITLE = "(?:" + "|".join(t for titles in TITLES.values() for t in titles) + ")"
_NO_NAME = rf"(?!(?:{_ANY_TITLE}|{'|'.join(NO_NAMES)})(?!\p{{L}}))"
#: A capital and letters, with apostrophes inside but for a possessive's.
_WORD = rf"{_NO_NAME}\p{{Lu}}(?:\p{{L}}|['’](?!s(?!\p{{L}}))\p{{L}})++"
_NAME = rf"(?<!\p{{L}}){_ANY_TITLE}\.? (?:\p{{Lu}}\. ){{0,2}}{_WORD}(?:[ \-]{_WORD}){{0,2}}"
ENTITY = "|".join([_MAIL, _SECRET, _IP, _IP6, _ACCOUNT, _CARD, _PHONE, _IDENTITY, _NAME])
#: Attempts in the length and range of the entity; each further one has one digit more (octets up to 999).
SAME_LENGTH = 5
#: Most characters before the @ of a mail surrogate (the limit of the mail standard); the digest is of the whole address.
MAIL_LOCAL = 64
#: Words, with apostrophes inside but for a possessive's, and what is between words.
WORDS = r"\p{L}(?:\p{L}|['’](?!s(?!\p{L}))\p{L})*+|\P{L}++"
#: Every entity has one of these; texts without any are not searched further.
GATE = rf"[0-9@]|{_ANY_TITLE}[. ]"


def kind_of(m: Column) -> Column:
    return (
        F.when(m.contains("@"), "mail")
        .when(m.rlike(f"^{_SECRET}$"), "secret")
        .when(m.rlike(f"^{_IP}$"), "ip")
        .when(m.contains(":"), "ip6")
        .when(m.rlike(r"^[A-Z]{2}[0-9]{2}"), "account")
        .when(m.rlike(f"^{_IDENTITY}$"), "identity")
        .when(m.rlike(r"^\p{L}"), "name")
        .when(m.rlike(f"^{_CARD}$"), "card")
        .otherwise("phone")
    )


def _title(m: Column) -> Column:
    return F.regexp_extract(m, rf"^{_ANY_TITLE}\.? ", 0)


def canonical(m: Column, kind: Column) -> Column:
    """What makes two mentions one entity: digits without format (after the country code of a phone and a blank), addresses and
    names without case, names with their gender."""
    of = lambda g: _title(m).rlike("^(?:" + "|".join(TITLES[g]) + r")[. ]")
    gender = F.when(of("f"), "f").when(of("n"), "n").otherwise("m")
    name = F.concat(gender, F.lit(":"), F.lower(F.substr(m, F.length(_title(m)) + 1)))
    country = F.regexp_extract(m, r"^\+([0-9]{1,3})", 1)
    digits = F.regexp_replace(m, "[^0-9]", "")
    abroad = F.concat(F.lit("+"), country, F.lit(" "), F.substr(digits, F.length(country) + 1))
    return (
        F.when(kind == "phone", F.when(country != "", abroad).otherwise(digits))
        .when(kind.isin("card", "identity"), digits)
        .when(kind == "account", F.replace(m, F.lit(" ")))
        .when(kind == "name", name)
        .otherwise(F.lower(m))
    )


def family_of(canon: Column) -> Column:
    """The family part of a canonical name."""
    return F.element_at(F.split(F.substr(canon, F.lit(3)), "[ \\-]"), -1)


def _digest(key: str, *parts: Column) -> Column:
    salted = lambda n: F.sha2(F.concat_ws("\x1f", F.lit(key), *parts, F.lit(n)), 256)
    return F.concat(salted("0"), salted("1"))


def _letters(digest: Column) -> Column:
    return F.translate(digest, "0123456789abcdef", "bcdfghjkmnpqrstv")


def _numbers(digest: Column) -> Column:
    return F.translate(digest, "abcdef", "012345")


def _byte(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 2), 16, 10).cast("int")


def _pick(values: list[str], digest: Column, at: int) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.conv(F.substring(digest, at, 1), 16, 10).cast("int") % len(values))


def entity_digest(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    return _digest(key, kind, canon, attempt.cast("string"))


def _luhn_rest(digits: Column) -> Column:
    """The Luhn sum of digits, modulo 10: 0 for a valid number. Every second digit from the last but one is doubled."""
    value = lambda c, i: c.cast("int") * F.when((F.length(digits) - i) % 2 == 0, 2).otherwise(1)
    return F.aggregate(F.transform(F.split(digits, ""), lambda c, i: F.coalesce(value(c, i), F.lit(0))), F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10


def _account(country: Column, rest: Column) -> Column:
    """An account number with its check digits: 98 less what the rest, the country and 00 leave modulo 97, letters being 10 to 35."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97
    left = F.aggregate(F.filter(F.split(F.concat(rest, country, F.lit("00")), ""), lambda c: c != ""), F.lit(0), step)
    return F.concat(country, F.lpad((98 - left).cast("string"), 2, "0"), rest)


def _syllables(hexes: Column, script: str) -> Column:
    values = F.array(*map(F.lit, SYLLABLES[script]))
    return F.array_join(F.transform(F.split(hexes, ""), lambda h: F.coalesce(F.get(values, F.conv(h, 16, 10).cast("int")), F.lit(""))), "")


def _by_script(canon: Column, made) -> Column:
    return F.when(canon.rlike(r"\p{IsCyrillic}"), made("cyrillic")).otherwise(made("latin"))


def family_surrogate(family: Column, attempt: Column, d: Column) -> Column:
    """Four syllables, and one more for each further attempt."""
    return _by_script(family, lambda script: F.initcap(_syllables(F.substr(d, F.lit(1), attempt + 4), script)))


def given_surrogate(canon: Column, attempt: Column, d: Column) -> Column:
    """A given name of the gender and script, with a syllable more for each further attempt; empty for names without one."""

    def given(script: str) -> Column:
        gender = F.substring(canon, 1, 1)
        first = F.when(gender == "f", _pick(GIVEN["f", script], d, 5)).when(gender == "n", _pick(GIVEN["n", script], d, 5)).otherwise(_pick(GIVEN["m", script], d, 5))
        return F.concat(first, F.when(attempt > 0, _syllables(F.substr(d, F.lit(9), attempt), script)).otherwise(""))

    return F.when(F.size(F.split(F.substr(canon, F.lit(3)), "[ \\-]")) > 1, _by_script(canon, given)).otherwise("")


def surrogate(kind: Column, canon: Column, attempt: Column, d: Column) -> Column:
    """The canonical surrogate of an entity that is no name at its attempt (0 first), from its digest. All arguments are used
    often: give columns or fields, not expressions."""
    # More room once short forms have collided: each attempt has more letters or digits.
    again = F.when(attempt > 0, F.substr(_letters(d), F.lit(60), attempt + 5)).otherwise("")
    longer = F.greatest(F.lit(0), attempt - SAME_LENGTH)
    local = F.substring(F.substring_index(canon, "@", 1), 1, MAIL_LOCAL)
    like = lambda c, i: F.when(c.rlike("[0-9]"), F.substr(_numbers(d), i % 128 + 1, F.lit(1))).when(c.rlike("[a-z]"), F.substr(_letters(d), i % 128 + 1, F.lit(1))).otherwise(c)
    mail = F.concat(F.array_join(F.transform(F.split(local, ""), like), ""), again, F.lit("@"), F.substring(_letters(d), 40, 8), F.lit(".example.net"))
    same_first = F.concat(F.substring(canon, 1, 1), F.substr(_numbers(d), F.lit(1), F.length(canon) - 1))
    digits = F.when(attempt > 0, F.substr(_numbers(d), F.lit(1), F.length(canon) + longer)).otherwise(same_first)
    # The last digit of a card makes its sum what the card's was: 0 if it was valid, else drawn.
    drawn = F.substr(digits, F.lit(1), F.length(digits) - 1)
    last = (10 - _luhn_rest(F.concat(drawn, F.lit("0")))) % 10
    card = F.when(_luhn_rest(canon) == 0, F.concat(drawn, last.cast("string"))).otherwise(digits)
    country = F.substring_index(F.substr(canon, F.lit(2)), " ", 1)
    abroad = F.concat(country, F.substr(_numbers(d), F.lit(1), F.length(canon) - F.length(country) - 2 + longer))
    octet = lambda at: F.when(longer > 0, F.substring(_numbers(d), 3 * at, 3).cast("int")).otherwise(_byte(d, at)).cast("string")
    octets = F.concat_ws(".", (240 + _byte(d, 1) % 16).cast("string"), *(octet(at) for at in (3, 5, 7)))
    rest = F.upper(F.array_join(F.transform(F.split(F.lower(F.substr(canon, F.lit(5))), ""), like), ""))
    account = _account(F.substring(canon, 1, 2), F.concat(rest, F.when(longer > 0, F.substr(_numbers(d), F.lit(100), longer)).otherwise("")))
    groups = F.array_join(F.transform(F.split(canon, ""), lambda c, i: F.when(c.rlike("[0-9a-f]"), F.substr(d, i + 1, F.lit(1))).otherwise(c)), "")
    groups = F.concat(groups, F.when(longer > 0, F.substr(d, F.lit(100), longer)).otherwise(""))
    return (
        F.when(kind == "mail", mail)
        .when(kind == "ip", octets)
        .when(kind == "ip6", groups)
        .when(kind == "secret", F.substr(d, F.lit(1), F.length(canon)))
        .when(kind == "card", card)
        .when(kind == "account", account)
        .when(canon.startswith("+"), abroad)
        .otherwise(digits)
    )


def distinguishing(kind: Column, canon: Column, attempt: Column, d: Column) -> Column:
    """What must differ between entities of a kind for their surrogates to differ. Families have distinct surrogates, so given
    names must differ within a family alone."""
    named = F.concat(F.substring(canon, 1, 1), F.lit("|"), given_surrogate(canon, attempt, d), F.lit("|"), family_of(canon))
    abroad = F.concat(F.lit("+"), F.substring_index(F.substr(canon, F.lit(2)), " ", 1), F.lit(" "))
    made = surrogate(kind, canon, attempt, d)
    # A phone abroad in its canonical form; others are in theirs.
    phone = F.concat(abroad, F.substr(made, F.length(abroad) - 1))
    return (
        F.when(kind == "family", F.lower(family_surrogate(canon, attempt, d)))
        .when(kind == "name", named)
        .when(canon.startswith("+"), phone)
        .otherwise(made)
    )


def rendered(m: Column, kind: Column, made: Column) -> Column:
    """A canonical surrogate in the format of the mention it replaces; digits it has more follow the last."""

    def spaced(signs: str) -> Column:
        place = lambda i: F.length(F.regexp_replace(F.substr(m, F.lit(1), i + 1), f"[^{signs}]", ""))  # noqa: E731  a mention is short
        each = F.transform(F.split(m, ""), lambda c, i: F.when(c.rlike(f"[{signs}]"), F.substr(made, place(i), F.lit(1))).otherwise(c))
        return F.concat(F.array_join(each, ""), F.substr(made, place(F.length(m)) + 1))

    name, new = F.substr(m, F.length(_title(m)) + 1), F.substr(made, F.lit(3))
    return (
        F.when(kind.isin("card", "phone", "identity"), spaced("0-9"))
        .when(kind == "account", spaced("0-9A-Z"))
        .when(kind == "name", F.concat(_title(m), F.when(name == F.upper(name), F.upper(new)).otherwise(new)))
        .when((m == F.upper(m)) & ~m.rlike("^[0-9.]*$"), F.upper(made))
        .otherwise(made)
    )


def named_again(between: Column, replaced: Column) -> Column:
    """The texts between mentions, with the families of the names among them (with_surrogates) replaced where they stand alone,
    capitalised and of three letters or more. Each word is looked up once, so a surrogate is never replaced in turn."""
    names = F.filter(replaced, lambda e: e["family"].isNotNull() & (F.length(e["family"]) > 2))
    known = F.map_from_entries(F.array_distinct(F.transform(names, lambda e: F.struct(e["family"], F.element_at(F.split(F.substr(e["made"], F.lit(3)), " "), -1)))))

    def swapped(words: Column, known: Column) -> Column:
        new = lambda w: F.when(w.rlike(r"^\p{Lu}"), F.element_at(known, F.lower(w)))
        cased = lambda w: F.when(w == F.upper(w), F.upper(new(w))).otherwise(new(w))
        return F.array_join(F.transform(words, lambda w: F.coalesce(cased(w), w)), "")

    # known is bound by a field, so that it is made once a text and not once a word.
    held = F.transform(F.array(known), lambda k: F.transform(between, lambda b: swapped(F.regexp_extract_all(b, F.lit(WORDS), F.lit(0)), k)))[0]
    return F.when(F.size(names) > 0, held).otherwise(between)


def mentions(text: Column) -> Column:
    """The entities of a text, in order, as written; empty for null."""
    return F.when(text.rlike(GATE), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def attempts(entities: DataFrame, key: str) -> DataFrame | None:
    """The entities (kind, canon; distinct and stored) that need an attempt above 0, with it; None if there is none.

    There is no last round: the space of a surrogate is ten times as large or more at each attempt over SAME_LENGTH, so the
    entities that collide soon run out."""
    settled, judged = entities.withColumn("attempt", F.lit(0)), None
    moved = False
    while True:
        digested = settled.withColumn("d", entity_digest(key, F.col("kind"), F.col("canon"), F.col("attempt")))
        made = digested.select("kind", "canon", "attempt", distinguishing(*map(F.col, ("kind", "canon", "attempt", "d"))).alias("made"))
        shared = made.groupBy("kind", "made").agg(F.count("*").alias("n"), F.min("canon").alias("first")).filter("n > 1").select("kind", "made", "first")
        real = entities.select("kind", F.col("canon").alias("made"), F.lit(True).alias("is_real"))
        found = made.join(shared, ["kind", "made"], "left").join(real, ["kind", "made"], "left")
        clash = F.coalesce(F.col("is_real"), F.lit(False)) | (F.col("first").isNotNull() & (F.col("first") != F.col("canon")))
        judged = stored(found.select("kind", "canon", (F.col("attempt") + clash.cast("int")).alias("attempt"), clash.alias("clash")), instead_of=judged)
        settled = judged.drop("clash")
        if not judged.filter("clash").limit(1).count():
            return settled.filter("attempt > 0") if moved else None
        moved = True


def with_surrogates(key: str, found: Column, tried) -> Column:
    """An array of mentions as structs of the mention (m), its kind, its family if it is a name, and its canonical surrogate (made). tried: the attempt of
    (kind, canon). Each step binds what the next uses often."""
    keep = lambda e, *names: [e[n].alias(n) for n in names]
    x = F.transform(found, lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    x = F.transform(x, lambda e: F.struct(*keep(e, "m", "kind"), canonical(e["m"], e["kind"]).alias("canon")))
    family = lambda e: F.when(e["kind"] == "name", family_of(e["canon"]))
    x = F.transform(x, lambda e: F.struct(*keep(e, "m", "kind", "canon"), tried(e["kind"], e["canon"]).alias("attempt"), family(e).alias("family")))
    theirs = lambda e: F.when(e["family"].isNotNull(), entity_digest(key, F.lit("family"), e["family"], tried(F.lit("family"), e["family"])))
    own = lambda e: entity_digest(key, e["kind"], e["canon"], e["attempt"])
    x = F.transform(x, lambda e: F.struct(*keep(e, "m", "kind", "canon", "attempt", "family"), own(e).alias("d"), theirs(e).alias("fd")))

    def made(e: Column) -> Column:
        family = family_surrogate(e["family"], tried(F.lit("family"), e["family"]), e["fd"])
        given = given_surrogate(e["canon"], e["attempt"], e["d"])
        name = F.concat(F.substring(e["canon"], 1, 2), F.ltrim(F.concat(given, F.lit(" "), family)))
        return F.when(e["kind"] == "name", name).otherwise(surrogate(e["kind"], e["canon"], e["attempt"], e["d"]))

    return F.transform(x, lambda e: F.struct(*keep(e, "m", "kind", "family"), made(e).alias("made")))


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with every detected entity in `text` replaced; all other columns are untouched, whatever their names, and the column
    pii_mentions (long; underscores added if docs has it) counts them. Families without a title (named_again) are replaced but not counted.

    Null stays null and empty stays empty; texts without entities are returned as they are. Equal texts stay equal."""
    names = fresh(docs, "_mentions", "_attempts", "_hash", "pii_mentions", "_made")
    own_hash = F.xxhash64(text)
    found = docs.select(own_hash.alias("h"), F.explode(F.array_distinct(mentions(F.col(text)))).alias("m"))
    found = found.withColumn("kind", kind_of(F.col("m")))
    found = stored(found.select("h", "kind", canonical(F.col("m"), F.col("kind")).alias("canon")))
    families = found.filter("kind = 'name'").select("h", F.lit("family").alias("kind"), family_of(F.col("canon")).alias("canon"))
    found = found.unionByName(families)
    further = attempts(stored(found.select("kind", "canon").distinct()), key)
    if further is None:
        held, tried = docs, lambda kind, canon: F.lit(0)
    else:  # the few texts with an entity that had to go on, by their hash: texts that share one only share a map
        pair = F.struct(F.concat_ws(":", "kind", "canon"), "attempt")
        per_text = found.join(further, ["kind", "canon"]).groupBy(F.col("h").alias(names[2])).agg(F.map_from_entries(F.collect_set(pair)).alias(names[1]))
        per_text = stored(per_text)
        if per_text.agg(F.coalesce(F.sum(F.size(names[1])), F.lit(0)).alias("n")).first()["n"] <= BROADCAST_ENTRIES:
            per_text = F.broadcast(per_text)
        held = docs.withColumn(names[2], own_hash).join(per_text, names[2], "left")
        tried = lambda kind, canon: F.coalesce(F.element_at(F.col(names[1]), F.concat_ws(":", kind, canon)), F.lit(0))
    held = held.withColumn(names[0], mentions(F.col(text)))

    held = held.withColumn(names[4], with_surrogates(key, F.col(names[0]), tried))
    replaced = F.transform(names[4], lambda e: rendered(e["m"], e["kind"], e["made"]))
    between = named_again(F.split(F.col(text), ENTITY, -1), F.col(names[4]))
    new = F.zip_with(between, replaced, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    rewritten = F.when(F.size(names[0]) == 0, F.col(text)).otherwise(F.array_join(new, ""))
    return held.select(*(rewritten.alias(text) if c == text else held[c] for c in docs.columns), F.size(names[0]).cast("long").alias(names[3]))
