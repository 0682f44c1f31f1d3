"""Personal data replaced by surrogates of the same type, by SQL expressions only.

Found are e-mail addresses, IP addresses, payment cards (with a valid check digit), phone and
social security numbers, and names behind a title or a known given name.  An entity is known by its type
and its canonical form (digits only, lower case), so one person's number in two notations
gets one surrogate in two notations.

A surrogate is drawn from a keyed hash of the canonical form and the number of the
attempt, in the entity's own format: digits for digits, letters for letters, a valid check
digit for a valid one, a name of the same gender and script.  Over all documents, no two
entities may get the same surrogate and none may get what is someone's real data;
entities for which that fails draw again, in rounds, until all are settled.  After
``GROW_AFTER`` rounds each further one makes the surrogate longer, so a crowded format
cannot hold the loop up for good.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from patronlens.sources.stages import stage

GROW_AFTER = 6

# Titles by gender, and given names by gender and script.  Names at the same place in a list are no pairs.
FEMALE_TITLES = "Mrs Ms Miss Madam Frau Madame Mme Mlle Señora Señorita Sra госпожа г-жа".split()
MALE_TITLES = "Mr Sir Herr Monsieur Señor Sr господин г-н".split()
OTHER_TITLES = "Dr Prof".split()
FEMALE_NAMES = "Anna Clara Elena Emma Helga Ingrid Irene Julia Laura Lucia Maria Marta Nina Paula Rosa Sofia".split()
MALE_NAMES = "Adam Carlos David Erik Felix Henry Ivan James Jonas Karl Louis Martin Oscar Pablo Robert Thomas".split()
FEMALE_CYRILLIC = "Анна Вера Галина Дарья Елена Жанна Зоя Инна Лариса Мария Нина Ольга Полина Софья Тамара Юлия".split()
MALE_CYRILLIC = "Антон Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Леонид Максим Никита Олег Павел Роман Степан".split()

_NAME = r"\p{Lu}\p{L}+(?:[-'’]\p{Lu}\p{L}+)?"
_TITLE = rf"(?:{'|'.join([*FEMALE_TITLES, *MALE_TITLES, *OTHER_TITLES])})"
_GIVEN = rf"(?:{'|'.join([*FEMALE_NAMES, *MALE_NAMES, *FEMALE_CYRILLIC, *MALE_CYRILLIC])})"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]++\.)+[A-Za-z]{2,}+",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "ip6": r"(?<![:\w])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![:\w])",
    "card": r"(?<![\d+])[2-6]\d{3}(?:[ \-]?\d{4}){2}[ \-]?\d{1,7}(?!\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}"
    r"|\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?!\d)",
    "name": rf"(?<![\p{{L}}\-]){_TITLE}\b\.?[ \t]+{_NAME}(?:[ \t]+{_NAME})?|(?<![\p{{L}}\-]){_GIVEN}[ \t]+{_NAME}",
}
_ANY = "|".join(PATTERNS.values())
_HEX = "0123456789abcdef"


def _type_of(surface: Column) -> Column:
    kind = F.when(F.lit(False), F.lit(""))
    for name, pattern in PATTERNS.items():
        kind = kind.when(surface.rlike(rf"^(?:{pattern})$"), name)
    return kind


def _words(surface: Column) -> Column:
    return F.split(surface, r"[ \t]+")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _canonical(kind: Column, surface: Column) -> Column:
    digits = _digits(surface)
    return (
        F.when(kind.isin("card", "ssn"), digits)
        .when(kind == "phone", F.when(F.length(digits) > 10, F.substring(digits, -10, 10)).otherwise(digits))
        .otherwise(F.lower(surface))
    )


def _stream(key: str, kind: Column, canonical: Column, attempt: Column, length: Column) -> Column:
    """At least ``length`` hex digits from the key, the entity and the attempt."""
    seed = F.concat_ws("|", F.lit(key), kind, canonical, attempt.cast("string"))
    parts = F.transform(F.sequence(F.lit(0), F.floor(length / 64).cast("int")), lambda i: F.sha2(F.concat_ws("|", seed, i.cast("string")), 256))
    return F.array_join(parts, "")


def _like(text: Column, stream: Column) -> Column:
    """``text`` with other letters and digits at their places; letters alternate so that they can be read."""

    def other(char: Column, place: Column) -> Column:
        drawn = F.substring(stream, place + 1, F.lit(1))
        letter = F.when(place % 2 == 0, F.translate(drawn, _HEX, "bcdfghjklmnprstv")).otherwise(F.translate(drawn, _HEX, "aeiouaeiouaeioua"))
        return F.when(char.rlike("^[0-9]$"), F.translate(drawn, _HEX, "0123456789273859")).when(char.rlike("^[a-z]$"), letter).otherwise(char)

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), other), "")


def _check_sum(digits: Column) -> Column:
    """The sum whose last digit is 0 for a valid card number."""
    turned = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")

    def weight(char: Column, place: Column) -> Column:
        double = char.cast("int") * 2
        return F.when(place % 2 == 0, char.cast("int")).otherwise(F.when(double > 9, double - 9).otherwise(double))

    return F.aggregate(F.transform(turned, weight), F.lit(0), lambda total, w: total + w)


def _card(digits: Column, stream: Column) -> Column:
    drawn = F.concat(F.substring(digits, 1, 1), F.substring(_like(digits, stream), F.lit(2), F.length(digits) - 2))
    check = (10 - _check_sum(F.concat(drawn, F.lit("0"))) % 10) % 10
    free = F.translate(F.substring(stream, -1, 1), _HEX, "0123456789012345")
    # A number that fails the check keeps failing it.
    wrong = F.when(free.cast("int") == check, (check + 1) % 10).otherwise(free.cast("int"))
    return F.concat(drawn, F.when(_check_sum(digits) % 10 == 0, check).otherwise(wrong).cast("string"))


def _picked(names: list[str], stream: Column, place: int = 1) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), F.conv(F.substring(stream, place, 1), 16, 10).cast("int") + 1)


def _drawn_name(kind: Column, canonical: Column, stream: Column, attempt: Column) -> Column:
    """A given name of the same gender, or a surname, in the same script; made of syllables after the first tries."""
    cyrillic = canonical.rlike(r"\p{IsCyrillic}")
    female = kind == "given-female"
    latin_surname = F.concat(F.translate(F.substring(stream, 2, 1), _HEX, "BCDFGHJKLMNPRSTV"), F.translate(F.substring(stream, 3, 1), _HEX, "aeiouaeiouaeioua"),
                             _picked("rn ld nt lm rt ns lk rd nd st rg mp lt rk nz ll".split(), stream, 4), _picked("er en man berg ing son ley ton well ford hart mann stein ner wood field".split(), stream, 5))
    cyrillic_surname = F.concat(F.translate(F.substring(stream, 2, 1), _HEX, "БВГДЗКЛМНПРСТФХШ"), F.translate(F.substring(stream, 3, 1), _HEX, "аеиоуаеиоуаеиоуа"),
                                F.translate(F.substring(stream, 4, 1), _HEX, "бвгджзклмнпрстфш"), _picked("ов ев ин енко ский ович ук ян ых ко ец ак ман ер ас ай".split(), stream, 5))
    syllables = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(attempt - 1, F.lit(1))), lambda i: F.concat(
        F.translate(F.substring(stream, 2 * i + 6, F.lit(1)), _HEX, "bcdfghjklmnprstv"), F.translate(F.substring(stream, 2 * i + 7, F.lit(1)), _HEX, "aeiouaeiouaeioua"))), "")
    cyrillic_syllables = F.translate(syllables, "bcdfghjklmnprstvaeiou", "бцдфгхжклмнпрстваеиоу")
    given = (
        F.when(cyrillic & female, _picked(FEMALE_CYRILLIC, stream)).when(cyrillic, _picked(MALE_CYRILLIC, stream))
        .when(female, _picked(FEMALE_NAMES, stream)).otherwise(_picked(MALE_NAMES, stream))
    )
    made = F.concat(F.initcap(F.when(cyrillic, cyrillic_syllables).otherwise(syllables)), F.when(cyrillic, F.when(female, "на").otherwise("мир")).otherwise(F.when(female, "na").otherwise("mir")))
    surname = F.when(cyrillic, cyrillic_surname).otherwise(latin_surname)
    longer = F.when(cyrillic, F.concat(surname, F.lit("-"), F.initcap(cyrillic_syllables))).otherwise(F.concat(surname, F.lit("-"), F.initcap(syllables)))
    return F.when(kind == "surname", F.when(attempt < 3, surname).otherwise(longer)).otherwise(F.when(attempt < 2, given).otherwise(made))


def _surrogate(key: str) -> Column:
    """A candidate in canonical form for the row's kind, canonical and attempt."""
    kind, canonical, attempt = F.col("kind"), F.col("canonical"), F.col("attempt")
    stream = _stream(key, kind, canonical, attempt, F.length(canonical) + 2 * attempt + 40)
    grown = F.when(attempt > GROW_AFTER, F.substring(stream, F.lit(9), attempt - GROW_AFTER)).otherwise(F.lit(""))
    more = F.translate(grown, _HEX, "0123456789012345")
    local = F.substring_index(canonical, "@", 1)
    host = F.concat(F.lit("mail"), F.translate(F.substring(stream, -2, 2), _HEX, "0123456789012345"), F.lit(".example."), _picked("com net org com net org com net org com net org com net org com".split(), F.reverse(stream), 3))
    octets = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.conv(F.substring(stream, 2 * i + 1, F.lit(2)), 16, 10))
    return (
        F.when(kind == "email", F.concat(_like(local, stream), more, F.lit("@"), host))
        .when(kind == "card", F.concat(_card(canonical, stream), more))
        .when(kind == "ssn", F.concat(F.lit("9"), F.substring(_like(canonical, stream), 2, 8), more))
        .when(kind == "phone", F.concat(F.translate(F.substring(stream, -1, 1), _HEX, "2345678923456789"), F.substring(_like(canonical, stream), F.lit(2), F.length(canonical) - 1), more))
        .when(kind == "ip", F.concat(F.lit("10."), F.array_join(octets, "."), F.when(grown != "", F.concat(F.lit("."), F.conv(grown, 16, 10))).otherwise("")))
        .when(kind == "ip6", F.concat_ws(":", F.lit("fd00"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.substring(stream, 4 * i + 1, F.lit(4))), ":"), F.when(grown != "", grown)))
        .otherwise(_drawn_name(kind, canonical, stream, attempt))
    )


def settle(entities: DataFrame, key: str) -> DataFrame:
    """``kind, canonical, surrogate`` for every different entity: surrogates differ and are nobody's real data.

    Given names and surnames share one space, so that a surname never becomes another
    person's given name.
    """
    space = F.when(F.col("kind").isin("given-female", "given-male", "surname"), "name").otherwise(F.col("kind"))
    open_ = stage(entities.select("kind", "canonical").distinct().withColumn("space", space).withColumn("attempt", F.lit(0)), "entities")
    real = open_.select("space", F.col("canonical").alias("drawn")).distinct()
    settled = None
    while True:
        drawn = stage(open_.withColumn("surrogate", _surrogate(key)).withColumn("drawn", F.lower("surrogate")), "drawn")
        first = drawn.groupBy("space", "drawn").agg(F.min(F.struct("kind", "canonical")).alias("one"))
        first = first.join(real, ["space", "drawn"], "left_anti")
        if settled is not None:
            first = first.join(settled.select("space", "drawn"), ["space", "drawn"], "left_anti")
        won = drawn.join(first.select("space", "drawn", F.col("one.kind").alias("kind"), F.col("one.canonical").alias("canonical")), ["space", "drawn", "kind", "canonical"])
        won = won.select("space", "drawn", "kind", "canonical", "surrogate")
        settled = stage(won if settled is None else settled.unionByName(won), "settled")
        left = drawn.join(settled.select("kind", "canonical"), ["kind", "canonical"], "left_anti")
        open_ = stage(left.select("kind", "canonical", "space", (F.col("attempt") + 1).alias("attempt")), "entities")
        if open_.isEmpty():
            return settled.select("kind", "canonical", "surrogate")


def _in_format(surface: Column, digits: Column) -> Column:
    """``digits`` at the places of the last digits of ``surface``; further ones go to the end."""
    own = F.length(_digits(surface))
    kept = F.greatest(own - F.length(digits), F.lit(0))
    whole = F.concat(F.substring(_digits(surface), F.lit(1), kept), digits)

    def place(char: Column, at: Column) -> Column:
        before = F.length(_digits(F.substring(surface, F.lit(1), at)))
        return F.when(char.rlike("^[0-9]$"), F.substring(whole, before + 1, F.lit(1))).otherwise(char)

    chars = F.filter(F.split(surface, ""), lambda c: c != "")
    return F.concat(F.array_join(F.transform(chars, place), ""), F.substring(whole, own + 1, F.lit(1000)))


def _name_parts(surface: Column) -> Column:
    """(kind, word) of the words of a name that are replaced, titles left out."""
    words = F.filter(_words(surface), lambda w: w != "")
    first = F.regexp_replace(words[0], r"\.$", "")
    titled = first.isin(FEMALE_TITLES + MALE_TITLES + OTHER_TITLES)
    own = F.when(titled, F.slice(words, 2, 10)).otherwise(words)
    female = F.when(titled & first.isin(FEMALE_TITLES), True).when(titled & first.isin(MALE_TITLES), False).otherwise(
        own[0].isin(FEMALE_NAMES + FEMALE_CYRILLIC) | (~own[0].isin(MALE_NAMES + MALE_CYRILLIC) & own[0].rlike("[aаeя]$"))
    )
    given = F.when(female, "given-female").otherwise("given-male")
    return F.transform(own, lambda w, i: F.struct(F.when((i == 0) & (F.size(own) > 1), given).otherwise("surname").alias("kind"), w.alias("word")))


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with all its columns, surrogates in ``text``, and ``n_entities`` (long).

    A null text stays null and has no entities.  Rows of one id and text get one
    result; equal ids with different texts are told apart by the text's hash.  In a
    document where a name was found, further mentions of its words alone are replaced too.
    """
    names = [c for c in docs.columns if c != "n_entities"]
    rows = docs.select(*names).withColumns({"__id": F.xxhash64(*[F.col(c) for c in names if c == "doc_id"], F.lit(0)), "__hash": F.xxhash64("text")})
    found = F.regexp_extract_all("text", F.lit(_ANY), F.lit(0))
    surfaces = rows.where(F.col("text").rlike(_ANY)).select("__id", "__hash", F.posexplode(found).alias("place", "surface")).distinct()
    kind = _type_of(F.col("surface"))
    digits = _digits(F.col("surface"))
    # What looks like a card but fails the check digit is some other number and stays.
    kind = F.when((kind == "card") & (_check_sum(digits) % 10 != 0), F.lit("number")).otherwise(kind)
    surfaces = stage(surfaces.withColumn("type", kind), "surfaces")
    # Parts: the words of a name, or the whole surface of any other entity.
    whole = F.array(F.struct(F.col("type").alias("kind"), F.col("surface").alias("word")))
    parts = F.when(F.col("type") == "name", _name_parts(F.col("surface"))).otherwise(whole)
    parts = surfaces.where("type != 'number'").select("__id", "__hash", "place", "surface", "type", F.posexplode(parts).alias("part", "own"))
    parts = parts.select("__id", "__hash", "place", "surface", "type", "part", "own.kind", "own.word")
    parts = parts.withColumn("canonical", _canonical(F.col("kind"), F.col("word")))
    known = settle(parts, key)
    number = F.col("kind").isin("card", "ssn", "phone")
    shown = F.when(number, _in_format(F.col("word"), F.col("surrogate"))).when(F.col("kind") == "email", F.when(F.col("word") == F.upper("word"), F.upper("surrogate")).otherwise(F.col("surrogate"))).otherwise(F.col("surrogate"))
    replaced = parts.join(known, ["kind", "canonical"]).withColumn("shown", shown)
    spelled = replaced.groupBy("__id", "__hash", "place", "surface", "type").agg(F.array_sort(F.collect_list(F.struct("part", "word", "shown"))).alias("words"))
    title = F.regexp_extract("surface", rf"^{_TITLE}\b\.?[ \t]+", 0)
    renamed = F.concat(title, F.array_join(F.transform("words", lambda w: w["shown"]), " "))
    spelled = spelled.withColumn("shown", F.when(F.col("type") == "name", renamed).otherwise(F.col("words")[0]["shown"]))
    bare = F.when(F.col("type") == "name", F.transform("words", lambda w: F.struct(w["word"], w["shown"]))).otherwise(F.array().cast("array<struct<word: string, shown: string>>"))
    spelled = spelled.select("__id", "__hash", "place", "type", "shown", bare.alias("bare"))
    numbers = surfaces.where("type = 'number'").select("__id", "__hash", "place", "type", F.col("surface").alias("shown"))
    spelled = spelled.unionByName(numbers, allowMissingColumns=True)
    per = spelled.groupBy("__id", "__hash").agg(
        F.count_if(F.col("type") != "number").alias("__count"),
        F.transform(F.array_sort(F.collect_list(F.struct("place", "shown"))), lambda s: s["shown"]).alias("__shown"),
        F.array_distinct(F.flatten(F.collect_list("bare"))).alias("__bare"),
    )
    joined = rows.join(per, ["__id", "__hash"], "left")
    gaps = F.split("text", _ANY, -1)
    woven = F.array_join(F.flatten(F.zip_with(gaps, F.col("__shown"), lambda gap, one: F.array(gap, F.coalesce(one, F.lit(""))))), "")
    again = F.aggregate("__bare", woven, lambda text, name: F.regexp_replace(text, F.concat(F.lit(r"(?<!\p{L})"), name["word"], F.lit(r"(?!\p{L})")), name["shown"]))
    text = F.when(F.col("__shown").isNull(), F.col("text")).when(F.size("__bare") == 0, woven).otherwise(again)
    count = F.coalesce("__count", F.lit(0)).cast("long")
    return joined.withColumn("text", text).withColumn("n_entities", count).select(*names, "n_entities")
