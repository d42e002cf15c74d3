"""Replacing personal data by keyed surrogates, with DataFrame functions only.

One pattern finds e-mail addresses, secrets (hex, keys with a known prefix, values assigned to a password or token),
IPv4 and IPv6 addresses, card, account and social security numbers, phone numbers, and names after a title; in a
row with such a name, its words also count without the title. Each distinct entity gets one surrogate of its
own type and format, drawn by a keyed hash: names of the same script and gender, numbers in the mention's
layout, check digits that are right where they were. Surrogates that meet another's, or any real entity, are drawn
again from a wider space, so distinct entities stay distinct and all mentions of one stay one.

Not found: names without a title anywhere in their row, names in scripts without capitals, postal addresses, passport numbers, dates of birth.
Initials and particles (van, de), suffixes (Jr, III) and a possessive 's stay as they are. A word that
is a name somewhere in a row counts as one all over it, also where it stands for something else (Mr May, in May).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import narrow, spread_join, staged

# A repeated group is possessive or bounded, and a look-ahead is bounded: Java matches other repeated groups by recursion.
EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++"
#: What stands before an assigned secret, and the secret: eight characters or more with a letter and a digit.
ASSIGNED = r"(?i:\b(?:password|passwd|pwd|secret|token|api[_\-]?key)\b[\"']? ?[=:] ?[\"']?)"
VALUE = r"(?=[^\s\"'<>,;)]{0,128}[0-9])(?=[^\s\"'<>,;)]{0,128}[A-Za-z])[^\s\"'<>,;)]{7,127}[^\s\"'<>,;).!?:]"
#: Public prefixes of keys; fixed values.
MARK = r"(?:AKIA|ASIA|sk-|gh[pousr]_)"
KEY = rf"(?<![0-9A-Za-z]){MARK}[A-Za-z0-9_\-]{{14,120}}[A-Za-z0-9]"
SECRET = r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,128}(?![0-9A-Za-z])"
IP = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"
_HEX = "[0-9A-Fa-f]{1,4}"
IP6 = rf"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]{{0,40}}[0-9])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![0-9A-Za-z:])"
CARD = r"(?<![0-9])(?:[0-9]{4}([ \-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{2}[ \-]?[0-9]{6}[ \-]?[0-9]{5})(?![0-9])"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
SSN = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
PHONE = (
    r"(?<![0-9+\-.])(?:\+?1[ \-.]?)?(?:\([0-9]{3}\)[ \-.]?|[0-9]{3}[\-.])[0-9]{3}[ \-.][0-9]{4}(?![0-9])"
    r"|(?<![0-9A-Za-z+\-.,]|[0-9] )(?:1 )?[2-9][0-9]{2} [2-9][0-9]{2} [0-9]{4}(?! ?[0-9]|[A-Za-z])|(?<![0-9A-Za-z+\-.,/_=#&])[2-9][0-9]{2}[2-9][0-9]{6}(?![0-9A-Za-z\-/_]|[.,][0-9])"
    r"|(?<![0-9+])\+[0-9]{1,3}(?:[ \-.]?\(?[0-9]{2,4}\)?){2,5}(?![0-9])"
)
#: Titles by the gender that they tell; fixed values.
TITLES = {"m": ["Mr", "Sir", "Herr", "Herrn", "Señor", "Sr", "Don", "Monsieur", "Господин", "Господину"], "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Señorita", "Sra", "Doña", "Madame", "Mme", "Mlle", "Госпожа", "Госпоже"], "u": ["Mx", "Dr", "Prof", "Professor", "Доктор", "Профессор"]}
_TITLES = [t for ts in TITLES.values() for t in ts]
#: A possessive 's is no part of a name.
WORD = r"\p{Lu}[\p{L}\p{M}]++(?:['’\-](?!s(?![\p{L}\p{M}]))\p{L}[\p{L}\p{M}]*+)*+|\p{Lu}['’]\p{Lu}[\p{L}\p{M}]++(?:-\p{Lu}[\p{L}\p{M}]++)*+"
#: What follows a name and is none; fixed values.
SUFFIXES = ["Jr", "Jun", "Junior", "Senior", "II", "III", "IV"]
_PARTICLE = "(?:van|von|de|del|della|di|da|la|le|der|den|bin|al)"
NAME = rf"(?<![\p{{L}}\p{{M}}])(?:{'|'.join(_TITLES)})\.?(?: (?:Dr|Prof)\.?)?(?: (?:{_PARTICLE} ){{0,2}}(?!(?:{'|'.join(_TITLES)})(?![\p{{L}}\p{{M}}]))(?:{WORD}|\p{{Lu}}\.)){{1,4}}"
ANY = "|".join(["(?:" + p.replace(r"([ \-]?)", r"(?<gap>[ \-]?)").replace(r"\1", r"\k<gap>") + ")" for p in (EMAIL, ASSIGNED + VALUE, KEY, SECRET, IP6, IP, CARD, IBAN, SSN, PHONE, NAME)])
#: Given names by script and gender, and syllables of family names, for surrogates.
GIVEN = {
    ("latin", "m"): "Adrian Bruno Conrad Dennis Edgar Felix Gregor Hector Ivo Jasper Konrad Leon Marius Norbert Oscar Rufus".split(),
    ("latin", "f"): "Adele Bianca Clara Diana Elena Flora Greta Helena Irene Julia Kira Lydia Marina Nadia Olivia Rosa".split(),
    ("cyrillic", "m"): "Антон Борис Вадим Глеб Денис Егор Захар Игорь Кирилл Леонид Максим Никита Олег Павел Роман Степан".split(),
    ("cyrillic", "f"): "Алина Белла Вера Галина Дарья Ева Зоя Инна Кира Лидия Марина Нина Ольга Полина Раиса София".split(),
}
SYLLABLES = {"latin": ["bel", "cor", "dan", "fen", "gar", "hol", "kel", "lin", "mar", "nor", "pel", "ros", "sten", "tal", "vin", "wes"], "cyrillic": ["бел", "вор", "гар", "дол", "зор", "ков", "лен", "мар", "нов", "пол", "рог", "сол", "тар", "фед", "хол", "яр"]}
#: Draws of one entity; a type and format with fewer surrogates than entities is an error by then.
ATTEMPTS = 40
_NAMES = ("surname", "given")
_UNIT = "array<struct<text: string, kind: string, canon: string, female: boolean>>"


def kind_of(entity: Column) -> Column:
    return (
        F.when(entity.rlike(rf"^{ASSIGNED}"), F.when(entity.rlike("[^0-9A-Za-z][0-9a-fA-F]{32,128}$"), "secret").otherwise("key")).when(entity.rlike("@"), "email").when(entity.rlike(rf"^{MARK}"), "key")
        .when(entity.rlike("^[0-9a-fA-F]{32,128}$"), "secret").when(entity.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "ip").when(entity.rlike("^[0-9A-Fa-f]*:[0-9A-Fa-f:]*$"), "ip6")
        .when(entity.rlike(rf"^{CARD}$"), "card").when(entity.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9 ]+$"), "iban").when(entity.rlike(f"^{SSN}$"), "ssn").when(entity.rlike(r"^\p{L}"), "name").otherwise("phone")
    )


def _value(entity: Column) -> Column:
    """A secret without what it is assigned to."""
    return F.regexp_replace(entity, rf"^{ASSIGNED}", "")


def _expanded(ip6: Column) -> Column:
    """Eight groups of four digits."""
    groups = lambda c: F.filter(F.split(c, ":"), lambda g: g != "")
    left, right = groups(F.substring_index(ip6, "::", 1)), F.when(F.contains(ip6, F.lit("::")), groups(F.substring_index(ip6, "::", -1))).otherwise(F.array().cast("array<string>"))
    every = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - F.size(left) - F.size(right), F.lit(0))), right)
    return F.array_join(F.transform(every, lambda g: F.lpad(F.lower(g), 4, "0")), ":")


def canonical(entity: Column, kind: Column) -> Column:
    """What mentions of one entity share: digits for numbers, a phone number's with the country code (1 where there is none),
    an address with all its groups, lower case for the rest but keys."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    phone = F.when((F.length(digits) == 10) & ~entity.startswith("+"), F.concat(F.lit("1"), digits)).otherwise(digits)
    return (
        F.when(kind == "phone", phone).when(kind.isin("card", "ssn"), digits).when(kind == "iban", F.regexp_replace(entity, " ", "")).when(kind == "ip6", _expanded(entity))
        .when(kind == "key", _value(entity)).when(kind == "secret", F.lower(_value(entity))).otherwise(F.lower(entity))
    )


def _title(entity: Column) -> Column:
    return F.regexp_extract(entity, r"^[\p{L}\p{M}]+", 0)


def _gender(entity: Column) -> Column:
    title = _title(entity)
    return F.when(title.isin(TITLES["f"]), "f").when(title.isin(TITLES["m"]), "m").otherwise("u")


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def _words(entity: Column) -> Column:
    """A titled mention's name words; those of its titles and suffixes are none."""
    return F.filter(F.regexp_extract_all(entity, F.lit(WORD), 0), lambda w: ~w.isin(_TITLES + SUFFIXES))


def _name_units(titled: Column) -> Column:
    """Mentions with titles -> their words as units: the last word is a family name, the others are given names. A family name with the
    ending that women bear in Cyrillic is taken without it, whatever the title, so that one family keeps one surrogate; the ending is put back."""

    def units(entity: Column) -> Column:
        words, gender = _words(entity), _gender(entity)

        def unit(w: Column, i: Column) -> Column:
            last, low, script = i == F.size(words) - 1, F.lower(w), _script(w)
            ending = F.coalesce((script == "cyrillic") & low.rlike("(ов|ев|ёв|ин|ын)а$"), F.lit(False))
            base = F.when(last & ending, F.substring(low, F.lit(1), F.length(low) - 1)).otherwise(low)
            canon = F.when(last, F.concat_ws(" ", script, base)).otherwise(F.concat_ws(" ", script, gender, low))
            return F.struct(w.alias("text"), F.when(last, "surname").otherwise("given").alias("kind"), canon.alias("canon"), (last & ending).alias("female"))

        return F.transform(words, unit)

    return F.flatten(F.transform(titled, units)).cast(_UNIT)


def seen(kind: Column, canon: Column) -> Column:
    """What a reader can tell apart: a name without its script and gender."""
    return F.when(kind.isin(*_NAMES), F.substring_index(canon, " ", -1)).otherwise(canon)


def _digits(h: Column, n: int, start: int = 1) -> Column:
    """n decimal digits of a hex hash."""
    chunks = [F.lpad(F.pmod(F.conv(F.substring(h, start + 10 * k, 10), 16, 10).cast("long"), F.lit(10**8)).cast("string"), 8, "0") for k in range(-(-n // 8))]
    return F.substring(F.concat(*chunks), 1, n)


def _luhn(payload: Column) -> Column:
    """The check digit for the digits before it."""
    n = F.length(payload)
    value = lambda k: F.substring(payload, n - k, F.lit(1)).cast("int")  # noqa: E731  k from the right
    add = lambda acc, k: acc + F.when(k % 2 == 1, value(k)).when(value(k) > 4, value(k) * 2 - 9).otherwise(value(k) * 2)
    return F.pmod(10 - F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10, F.lit(10))


def _mod97(text: Column) -> Column:
    """An account number's remainder: letters count as 10 to 35."""
    step = lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + c.try_cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(F.coalesce(step(acc, c), acc)))


def _alike(text: Column, h: Column) -> Column:
    """Each letter and digit of a text drawn anew, of its own class; others stay."""
    one = lambda k: F.conv(F.substring(h, F.pmod(k, F.lit(128)) + 1, F.lit(1)), 16, 10).cast("int")

    def char(c: Column, k: Column) -> Column:
        letter = F.substring(F.lit("abcdefghkmnprstw"), one(k) + 1, F.lit(1))
        return F.when(c.rlike("[0-9]"), (one(k) % 10).cast("string")).when(c.rlike("[a-z]"), letter).when(c.rlike("[A-Z]"), F.upper(letter)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), char), "")


def draw(entities: DataFrame, attempt: int, key: str) -> DataFrame:
    """entities (kind, canon) with a surrogate as ``seen`` would show it, from a keyed hash; later attempts draw longer names."""
    h, kind, canon = F.col("h"), F.col("kind"), F.col("canon")
    rows = entities.withColumn("h", F.sha2(F.concat_ws("\u241f", F.lit(key), kind, canon, F.lit(str(attempt))), 512))
    number = lambda k: F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("long")
    octet = lambda k, low, span: (F.pmod(number(k), F.lit(span)) + low).cast("string")
    at = F.substring_index(canon, ".", -1)
    email = F.concat(F.translate(F.substring(h, 1, 12), "0123456789", "ghijklmnop"), F.lit("@"), F.translate(F.substring(h, 20, 6), "0123456789", "qrstuvwxyz"), F.lit(".example."), at)
    rows = rows.withColumn("digits", F.when(kind.isin("card", "phone", "ssn"), _digits(h, 24)))
    rows = rows.withColumn("payload", F.when(kind == "card", F.concat(F.substring(canon, 1, 1), F.substring(F.col("digits"), F.lit(1), F.length(canon) - 2))))
    rows = rows.withColumns({"old": F.when(kind == "card", _luhn(F.substring(canon, F.lit(1), F.length(canon) - 1))), "new": F.when(kind == "card", _luhn(F.col("payload")))})
    # a number with a right check digit gets one; a wrong one stays wrong
    check = F.when(F.col("old") == F.substring(canon, -1, 1).cast("int"), F.col("new")).otherwise(F.pmod(F.col("new") + 1, F.lit(10)))
    # the country code stays, as far as digits alone tell it
    code = F.when(canon.rlike("^[17]"), F.substring(canon, 1, 1)).otherwise(F.substring(canon, 1, 2))
    phone = F.concat(code, F.substring(F.col("digits"), F.lit(1), F.length(canon) - F.length(code)))
    body = _alike(F.substring(canon, F.lit(5), F.length(canon) - 4), h)
    control = lambda b: F.lpad((98 - _mod97(F.concat(b, F.substring(canon, 1, 2), F.lit("00")))).cast("string"), 2, "0")
    valid = _mod97(F.concat(F.substring(canon, F.lit(5), F.length(canon) - 4), F.substring(canon, 1, 4))) == 1
    iban = F.concat(F.substring(canon, 1, 2), F.when(valid, control(body)).otherwise(F.lpad((99 - _mod97(F.concat(body, F.substring(canon, 1, 2), F.lit("00")))).cast("string"), 2, "0")), body)
    ip6 = F.concat(F.lit("2001:0db8"), *[F.concat(F.lit(":"), F.substring(h, 1 + 4 * k, 4)) for k in range(6)])
    mark = F.regexp_extract(canon, rf"^{MARK}", 0)
    secret_key = F.concat(mark, _alike(F.substring(canon, F.length(mark) + 1, F.length(canon)), h))
    pick = lambda names, k: F.get(F.array(*map(F.lit, names)), F.pmod(number(k), F.lit(len(names))).cast("int"))
    syllables = lambda script, n: F.concat(F.lit(""), *[F.get(F.array(*map(F.lit, SYLLABLES[script])), F.conv(F.substring(h, 60 + k, 1), 16, 10).cast("int")) for k in range(n)])
    cyrillic = canon.startswith("cyrillic")
    surname = F.when(cyrillic, F.concat(syllables("cyrillic", 3 + min(attempt, 30)), F.lit("ов"))).otherwise(syllables("latin", 4 + min(attempt, 30)))
    given = lambda script: F.concat(syllables(script, min(attempt, 30)), F.lower(F.when(canon.startswith(f"{script} m"), pick(GIVEN[script, "m"], 0)).when(canon.startswith(f"{script} f"), pick(GIVEN[script, "f"], 0)).otherwise(pick(GIVEN[script, "m"] + GIVEN[script, "f"], 0))))
    drawn = (
        F.when(kind == "email", email).when(kind == "secret", F.substring(h, F.lit(1), F.length(canon))).when(kind == "key", secret_key)
        .when(kind == "ip", F.concat_ws(".", octet(0, 1, 223), octet(1, 0, 256), octet(2, 0, 256), octet(3, 1, 254))).when(kind == "ip6", ip6)
        .when(kind == "card", F.concat("payload", check.cast("string"))).when(kind == "phone", phone).when(kind == "ssn", F.concat(F.lit("9"), F.substring("digits", 1, 8)) if attempt < 8 else F.substring("digits", 1, 9)).when(kind == "iban", iban)
        .when(kind == "given", F.when(cyrillic, given("cyrillic")).otherwise(given("latin"))).otherwise(surname)
    )
    return rows.select("kind", "canon", drawn.alias("surrogate"))


def shaped(entity: Column, kind: Column, surrogate: Column, female: Column) -> Column:
    """The surrogate in the mention's layout: its separators, what it is assigned to, its letter case; a woman's name with its ending."""
    count = F.length(F.regexp_replace(entity, "[^0-9]", ""))
    digits = F.substring(surrogate, F.length(surrogate) - count + 1, count)
    # the k-th sign of the mention that counts becomes the k-th of the surrogate
    def laid(counts: str, source: Column) -> Column:
        step = lambda acc, c: F.when(c.rlike(counts), F.struct((acc["n"] + 1).alias("n"), F.concat(acc["s"], F.substring(source, acc["n"] + 1, F.lit(1))).alias("s"))).otherwise(F.struct(acc["n"].alias("n"), F.concat(acc["s"], c).alias("s")))
        return F.aggregate(F.split(entity, ""), F.struct(F.lit(0).alias("n"), F.lit("").alias("s")), step, lambda acc: acc["s"])

    all_upper = lambda c: (F.upper(c) == c) & (F.lower(c) != c)
    plain = F.when(all_upper(_value(entity)), F.upper(surrogate)).otherwise(surrogate)
    lead = F.regexp_extract(entity, rf"^{ASSIGNED}", 0)
    whole = F.when((kind == "surname") & female & surrogate.rlike(r"\p{IsCyrillic}"), F.concat(surrogate, F.lit("а"))).otherwise(surrogate)
    name = F.when(all_upper(entity) & (F.length(entity) > 1), F.upper(whole)).otherwise(F.initcap(whole))
    return (
        F.when(kind.isin("phone", "card", "ssn"), laid("^[0-9]$", digits)).when(kind == "iban", laid("^[A-Z0-9]$", surrogate)).when(kind.isin(*_NAMES), name)
        .when(kind == "key", F.concat(lead, surrogate)).when(kind == "secret", F.concat(lead, plain)).otherwise(plain)
    )


def assign(entities: DataFrame, key: str, attempts: int = ATTEMPTS) -> DataFrame:
    """entities: kind, canon, distinct -> kind, canon, surrogate: distinct for those of one kind that can be told apart, and none a real
    entity. Of those that draw the same surrogate the smallest hash keeps it; the rest draw again, ``attempts`` times at most."""
    group = F.when(F.col("kind").isin(*_NAMES), "name").otherwise(F.col("kind")).alias("group")
    real = staged(entities.select(group, seen(F.col("kind"), F.col("canon")).alias("surrogate")).distinct())
    taken, done, todo = real, [], entities
    for attempt in range(attempts):
        drawn = draw(todo, attempt, key).select("kind", "canon", "surrogate", group)
        free = drawn.join(taken.withColumn("taken", F.lit(True)), ["group", "surrogate"], "left")
        first = F.row_number().over(Window.partitionBy("group", "surrogate").orderBy(F.xxhash64("canon"), "canon", "kind")) == 1
        tried = staged(free.withColumn("ok", first & F.col("taken").isNull()).drop("taken"))
        good = tried.where("ok")
        done.append(good.select("kind", "canon", "surrogate"))
        todo = tried.where("NOT ok").select("kind", "canon")
        if todo.isEmpty():
            out = done[0]
            for more in done[1:]:
                out = out.union(more)
            return out
        taken = staged(taken.union(good.select("group", "surrogate")))
    raise ValueError(f"no surrogate is left for {todo.first()['kind']} entities of one format after {attempts} draws")


def _mentions(hits: DataFrame) -> DataFrame:
    """hits (row, found, names) -> row, entity, kind, canon, female: each distinct thing to be replaced in a row, the words of names by
    themselves. A word without a title is what it is with one, in any letter case; a word that is both kinds of name counts as a family name."""
    found = hits.select("row", F.explode(F.array_distinct("found")).alias("entity"))
    found = staged(found.withColumn("kind", kind_of(F.col("entity"))))
    plain = found.where("kind <> 'name'").select("row", "entity", "kind", canonical(F.col("entity"), F.col("kind")).alias("canon"), F.lit(False).alias("female"))
    words = hits.select("row", F.inline("names")).groupBy("row", "text").agg(F.max(F.struct("kind", "canon", "female")).alias("u"))
    folded = words.groupBy("row", F.lower("text").alias("low")).agg(F.max("u").alias("u"))
    # the form of the word itself tells its ending
    bare = found.where((F.col("kind") == "name") & ~_title(F.col("entity")).isin(_TITLES)).select("row", "entity", F.lower("entity").alias("low")).join(folded, ["row", "low"])
    both = words.select("row", F.col("text").alias("entity"), "u").union(bare.select("row", "entity", "u"))
    names = both.groupBy("row", "entity").agg(F.max("u").alias("u")).select("row", "entity", "u.kind", "u.canon", "u.female")
    return staged(plain.distinct().union(names))


def surrogates(docs: DataFrame, key: str) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): doc_id, text with surrogates, n_entities (mentions), n_distinct.

    key: the secret that draws depend on; one key gives one entity the same surrogate in any table that draws no
    collision. A null text stays null; a text without personal data stays as it is. Rows may repeat; one entity has one
    surrogate in the whole table. Other columns are not read; an empty table gives an empty result. A format with too
    few surrogates for its entities is an error.
    """
    if not key:
        raise ValueError("surrogates need a key")
    # the pattern is slow, and nothing matches it without a digit, an at-sign or a title
    may = F.col("text").rlike("[0-9@]")
    for title in _TITLES:
        may = may | F.col("text").contains(title)
    none = F.array().cast("array<string>")
    rows = narrow(docs, doc_id="long", text="string").withColumn("first", F.when(may, F.regexp_extract_all("text", F.lit(ANY), 0)).otherwise(none))
    hits = staged(rows.where(F.size("first") > 0).withColumn("row", F.monotonically_increasing_id()))
    plain = rows.where(F.coalesce(F.size("first") <= 0, F.lit(True))).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"), F.lit(0).cast("long").alias("n_distinct"))
    # equal mentions are told apart from others once: a text of one name a million times has one
    hits = hits.withColumn("names", _name_units(F.filter(F.array_distinct("first"), lambda e: kind_of(e) == "name")))
    # a row's own pattern: its name words count without a title too, as they are or in capitals
    forms = F.array_distinct(F.flatten(F.transform("names", lambda u: F.array(u["text"], F.upper(u["text"])))))
    longest = F.reverse(F.array_sort(F.transform(forms, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))))
    own = F.array_join(F.transform(longest, lambda x: F.concat(F.lit("\\Q"), x["w"], F.lit("\\E"))), "|")
    hits = hits.withColumn("pattern", F.when(F.size("names") > 0, F.concat(F.lit(ANY + r"|(?<![\p{L}\p{M}])(?=\p{Lu})(?:"), own, F.lit(r")(?![\p{L}\p{M}])"))).otherwise(F.lit(ANY)))
    hits = hits.withColumn("found", F.when(F.size("names") > 0, F.regexp_extract_all("text", F.col("pattern"), 0)).otherwise(F.col("first")))
    hits = staged(hits.select("row", "doc_id", "text", "pattern", "found", "names"))
    mentions = _mentions(hits)
    table = assign(staged(mentions.select("kind", "canon").distinct()), key)
    by_entity = lambda df: df.withColumn("of", F.struct("kind", "canon"))
    counts = by_entity(mentions).groupBy("of").agg(F.count("*").alias("n"))
    named = spread_join(by_entity(mentions).drop("kind", "canon"), by_entity(table).select("of", "surrogate"), "of", counts).select("*", "of.kind", "of.canon").select("row", "canon", "kind", F.struct("entity", shaped(F.col("entity"), F.col("kind"), F.col("surrogate"), F.col("female")).alias("new")).alias("pair"))
    maps = named.groupBy("row").agg(F.map_from_entries(F.collect_list("pair")).alias("new"), F.count_distinct("kind", "canon").alias("n_distinct"))
    put = lambda text, pattern, found, how: F.array_join(F.transform(F.arrays_zip(F.split(text, pattern, -1).alias("keep"), F.transform(found, how).alias("put")), lambda p: F.concat(p["keep"], F.coalesce(p["put"], F.lit("")))), "")
    word = lambda w: F.when(w.isin(_TITLES), w).otherwise(F.coalesce(F.col("new")[w], w))
    mention = lambda e: F.coalesce(F.col("new")[e], put(e, F.lit(WORD), F.regexp_extract_all(e, F.lit(WORD), 0), word))
    # a row of initials alone has nothing to be replaced
    known = hits.join(maps, "row", "left").withColumn("new", F.coalesce("new", F.create_map().cast("map<string,string>")))
    changed = known.select("doc_id", put(F.col("text"), F.col("pattern"), F.col("found"), mention).alias("text"), F.size("found").cast("long").alias("n_entities"), F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))
    return plain.union(changed)
