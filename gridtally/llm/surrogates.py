"""Surrogates for personal data: keyed, type-consistent, distinct, with DataFrame functions only.

Entities are found by one pattern. Each has one or more parts of a kind with a canonical value (a
phone number's last ten digits, a surname in lower case), so that one value written in several ways
is one part. A part's surrogate is made from the keyed SHA-256 of kind and value: digits become
digits, letters letters, a card number keeps its first digit and whether its check digit is right, a
given name keeps gender and script, a surname its script; the surrogate is then written in the form
in which the value stood.

The corpus' distinct parts are a table. A surrogate that two parts share, or that is itself a value
of the corpus, is given to the least value or to none; the others try again with the next number
until all are distinct, so different values stay different and one value has one surrogate in all
documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settle

MAX_ATTEMPTS = 40

# Titles, given names and syllables by gender and script.
TITLES = {
    "m": ("Mr", "Mister", "Sir", "Herr", "Señor", "Sr", "Monsieur", "Господин", "господин"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Madame", "Mme", "Frau", "Señora", "Sra", "Lady", "Госпожа", "госпожа"),
    "n": ("Dr", "Prof", "Professor", "Доктор", "доктор"),
}
GIVEN = {
    ("m", "latin"): "James John Robert Michael William David Thomas Peter Paul Hans Jürgen Pierre Louis Carlos José Miguel".split(),
    ("f", "latin"): "Mary Anna Elizabeth Sarah Laura Julia Emma Clara Helga Ingrid Marie Claire Carmen Lucía Sofia Isabel".split(),
    ("n", "latin"): "Alex Robin Kim Sam Jamie Taylor Jordan Casey Morgan Riley Dominique Camille Andrea Noa Sascha Toni".split(),
    ("m", "cyrillic"): "Иван Пётр Сергей Андрей Алексей Михаил Николай Дмитрий Павел Олег Юрий Борис Виктор Игорь Антон Егор".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Ирина Наталья Татьяна Светлана Вера Нина Юлия Дарья Ксения Галина Лидия Зоя".split(),
    ("n", "cyrillic"): "Саша Женя Валя Слава Шура Паша Митя Лёля Тоша Гоша Кеша Сима Стася Ника Мика Рада".split(),
}
SYLLABLES = {
    "latin": "ba do fen gal hor kel lin mar nor pel ros sten tor vel wim zan".split(),
    "cyrillic": "ба до фен гал гор кел лин мар нор пел рос стен тор вел вим зан".split(),
}
ENDINGS = {
    "latin": "berg dale ford hart ker land man ner rich sen son ster ton well wick ley".split(),
    "cyrillic": "бенко гин дюк ев енко ер ин ич кин ко ник ов ский ук чук юк".split(),
}

_WORD = r"\p{Lu}[\p{L}’'-]+"
_TITLE = "|".join(sorted({t for ts in TITLES.values() for t in ts}, key=lambda t: (-len(t), t)))
_NAMES = "|".join(sorted({g for gs in GIVEN.values() for g in gs}, key=lambda g: (-len(g), g)))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Kind, pattern, what may not stand before, what may not stand after.
PATTERNS = (
    ("email", r"[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++", r"[\p{L}\p{N}._%+-]", ""),
    ("iban", r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?", r"[\p{L}\p{N}]", r"[\p{L}\p{N}]"),
    ("ip", rf"(?:{_OCTET}\.){{3}}{_OCTET}", r"[\d.]", r"\d|\.\d"),
    ("ssn", r"\d{3}-\d{2}-\d{4}", r"[\d-]", r"\d|-\d"),
    ("card", r"\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{13,19}", r"[\d+]", r"\d"),
    (
        "phone",
        r"\+?\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}"
        r"|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}|\d{3}[.-]\d{3}[.-]\d{4}",
        r"[\d+.]",
        r"\d",
    ),
    ("person", rf"(?:(?:{_TITLE})\.? {_WORD}(?: {_WORD})?|(?:{_NAMES}) {_WORD})", r"[\p{L}\p{N}]", ""),
)


def _group_free(pattern: str) -> str:
    return pattern.replace(r"([ -])\d{4}\1\d{4}\1", r"(?: \d{4} \d{4} |-\d{4}-\d{4}-)")


ENTITY = "|".join(
    f"(?<!{before})(?:{_group_free(p)})" + (f"(?!{after})" if after else "") for _, p, before, after in PATTERNS
)
#: Without one of these a text has no entity.
CUE = rf"[0-9@]|(?<![\p{{L}}\p{{N}}])(?:{_TITLE}|{_NAMES})[. ]"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _at(x: Column, i: Column) -> Column:
    return F.substring(x, i, F.lit(1))


def _chars(x: Column, each) -> Column:
    """Rewrite a string that is not empty, character by character: ``each(character, place from 1)``."""
    return F.array_join(F.transform(F.split(x, ""), lambda c, i: each(c, i + 1)), "")


def _keyed(key: str, kind: Column, value: Column, attempt: int) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), kind, F.lit(str(attempt)), value), 256)


def _decimal(h: Column) -> Column:
    return F.translate(h, "abcdef", "357912")


def _shape(x: Column, h: Column) -> Column:
    """Digits for digits and lower-case letters for letters; the rest stays."""
    place = lambda i: F.pmod(i - 1, F.lit(64)) + 1
    letters = F.translate(h, "0123456789abcdef", "bcdfghklmnprstvz")
    return _chars(
        x,
        lambda c, i: F.when(c.rlike("[0-9]"), _at(_decimal(h), place(i)))
        .when(c.rlike(r"\p{L}"), _at(letters, place(i)))
        .otherwise(c),
    )


def _luhn(digits: Column) -> Column:
    """Sum of the digits with every second one from the right doubled (nines cast out)."""
    n = F.length(digits)
    worth = lambda i: F.when(F.pmod(n - i, F.lit(2)) == 0, _at(digits, i).cast("int")).otherwise(
        F.when(_at(digits, i) == "9", F.lit(9)).otherwise(F.pmod(_at(digits, i).cast("int") * 2, F.lit(9)))
    )
    return F.aggregate(F.transform(F.sequence(F.lit(1), n), worth), F.lit(0), lambda a, b: a + b)


def _pick(words: list[str], h: Column, i: int) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), F.instr(F.lit("0123456789abcdef"), F.substring(h, i, 1)))


def _script(x: Column) -> Column:
    return F.when(x.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin"))


def surrogate(key: str, kind: Column, value: Column, attempt: int) -> Column:
    """The surrogate of a canonical value at a given attempt, canonical as well."""
    h = _keyed(key, kind, value, attempt)
    hex_byte = lambda i: F.conv(F.substring(h, i, 2), 16, 10)
    name = F.split_part(kind, F.lit(":"), F.lit(1))
    body = F.concat(_at(value, F.lit(1)), F.substring(_decimal(h), F.lit(1), F.length(value) - 2))
    rest = F.pmod(_luhn(F.concat(body, F.lit("0"))), F.lit(10))
    check = F.pmod(F.lit(10) - rest + F.when(F.pmod(_luhn(value), F.lit(10)) == 0, 0).otherwise(1 + attempt % 9), F.lit(10))
    card = F.concat(body, check.cast("string"))
    given = [
        F.when(kind == f"given:{g}:{s}", F.lower(F.concat_ws("-", *[_pick(GIVEN[g, s], h, 1 + i) for i in range(1 + attempt)])))
        for g, s in GIVEN
    ]
    surname = [
        F.when(
            kind == f"surname:{s}",
            F.concat(*[_pick(SYLLABLES[s], h, 1 + i) for i in range(2 + attempt)], _pick(ENDINGS[s], h, 60)),
        )
        for s in SYLLABLES
    ]
    label = F.translate(F.substring(h, 50, 6), "0123456789", "ghklmnprst")
    return F.coalesce(
        F.when(name == "email", F.concat(_shape(F.split_part(value, F.lit("@"), F.lit(1)), h), F.lit("@"), label, F.lit(".example.net"))),
        F.when(name == "iban", F.concat(F.substring(value, 1, 2), F.upper(_shape(F.substring(value, F.lit(3), F.length(value)), h)))),
        F.when(
            name == "ip",
            F.concat_ws(".", (F.lit(240) + F.conv(F.substring(h, 1, 1), 16, 10).cast("int")).cast("string"), *[hex_byte(i) for i in (2, 4, 6)]),
        ),
        F.when(name == "ssn", F.concat(F.lit("9"), F.substring(_decimal(h), 1, 8))),
        F.when(name == "card", card),
        F.when(name == "phone", F.substring(_decimal(h), F.lit(1), F.length(value))),
        *given,
        *surname,
    )


def parts_of(entity: Column) -> Column:
    """The parts of an entity: (kind, canonical value, the words they stand in)."""
    kind = reduce(
        lambda rest, p: F.when(entity.rlike(f"^(?:{_group_free(p[1])})$"), F.lit(p[0])).otherwise(rest), reversed(PATTERNS), F.lit(None).cast("string")
    )
    value = (
        F.when(kind == "email", F.lower(entity))
        .when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
        .when(kind == "ip", entity)
        .when(kind == "phone", F.reverse(F.substring(F.reverse(_digits(entity)), 1, 10)))
        .otherwise(_digits(entity))
    )
    words = F.split(entity, " ")
    first = F.replace(F.element_at(words, 1), F.lit("."), F.lit(""))
    title = first.isin(*[t for ts in TITLES.values() for t in ts])
    by_title = F.when(first.isin(*TITLES["m"]), "m").when(first.isin(*TITLES["f"]), "f").otherwise("n")
    has_given = F.size(words) - title.cast("int") > 1
    given = F.element_at(words, F.when(title, 2).otherwise(1))
    known = F.when(given.isin(*GIVEN["m", "latin"], *GIVEN["m", "cyrillic"]), "m").when(
        given.isin(*GIVEN["f", "latin"], *GIVEN["f", "cyrillic"]), "f"
    )
    gender = F.when(title & (by_title != "n"), by_title).otherwise(F.coalesce(known, F.lit("n")))
    part = lambda k, v, form: F.struct(k.alias("kind"), v.alias("value"), form.alias("form"))
    last = F.element_at(words, -1)
    surname = part(F.concat(F.lit("surname:"), _script(last)), F.lower(last), last)
    person = F.concat(
        F.when(title, F.array(part(F.lit("title"), F.element_at(words, 1), F.element_at(words, 1)))).otherwise(F.array()),
        F.when(has_given, F.array(part(F.concat(F.lit("given:"), gender, F.lit(":"), _script(given)), F.lower(given), given))).otherwise(
            F.array()
        ),
        F.array(surname),
    )
    return F.when(kind == "person", person).otherwise(F.array(part(kind, value, entity)))


def _written(part: Column, new: Column) -> Column:
    """A surrogate in the form of the value that it stands for."""
    form, kind = part["form"], F.split_part(part["kind"], F.lit(":"), F.lit(1))
    upper = (form == F.upper(form)) & (form != F.lower(form))
    spelled = F.when(upper, F.upper(new))
    before = lambda pattern, i: F.length(F.regexp_replace(F.substring(form, F.lit(1), i), pattern, ""))
    kept = F.length(_digits(form)) - F.length(new)
    poured = _chars(
        form, lambda c, i: F.when(c.rlike("[0-9]") & (before("[^0-9]", i) > kept), _at(new, before("[^0-9]", i) - kept)).otherwise(c)
    )
    iban = _chars(form, lambda c, i: F.when(c != " ", _at(new, before(" ", i))).otherwise(c))
    capital = lambda w: F.concat(F.upper(_at(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w)))
    name = F.array_join(F.transform(F.split(new, "-"), capital), "-")
    return (
        F.when(kind.isin("phone", "card", "ssn"), poured)
        .when(kind == "iban", iban)
        .when(kind.isin("given", "surname"), F.coalesce(spelled, name))
        .when(kind == "email", F.coalesce(spelled, new))
        .otherwise(new)
    )


def surrogate_table(parts: DataFrame, key: str) -> DataFrame:
    """(kind, value, new): one surrogate for each distinct (kind, value), all different within a
    kind and none a value of the corpus. Raises if MAX_ATTEMPTS do not suffice."""
    values = settle(parts.select("kind", "value").distinct())
    left, done = values, None
    for attempt in range(MAX_ATTEMPTS):
        tried = settle(left.withColumn("new", surrogate(key, F.col("kind"), F.col("value"), attempt)))
        taken = values.select("kind", F.col("value").alias("new"))
        if done is not None:
            taken = taken.unionByName(done.select("kind", "new"))
        least = tried.groupBy("kind", "new").agg(F.min("value").alias("value"))
        won = settle(least.join(taken, ["kind", "new"], "left_anti").select("kind", "value", "new"))
        done = won if done is None else done.unionByName(won)
        left = settle(left.join(won, ["kind", "value"], "left_anti"))
        if left.isEmpty():
            return done
    raise RuntimeError(f"surrogates still collide after {MAX_ATTEMPTS} attempts")


def replace_entities(docs: DataFrame, key: str, text: str = "text", count: str = "n_entities") -> DataFrame:
    """Replace the personal data in every text by surrogates and add the number of entities.

    ``key`` is the secret that surrogates depend on. A null text stays null with no entities; an
    empty text stays empty. Texts without entities are not shuffled. Equal texts get equal results;
    repeated rows stay. All other columns, whatever their names, are kept, but for one named ``count``.
    """
    docs = docs.drop(count)
    cued = F.coalesce(F.col(text).rlike(CUE), F.lit(False))
    columns = docs.columns
    none = docs.where(~cued).withColumn(count, F.lit(0))
    some = docs.where(cued)
    entities = lambda t: F.regexp_extract_all(t, F.lit(ENTITY), F.lit(0))
    found = some.select(F.md5(text).alias("h"), entities(F.col(text)).alias("found")).where(F.size("found") > 0)
    # Copies of a text have equal entities, so one of them stands for all.
    found = found.groupBy("h").agg(F.first("found").alias("found"))
    parts = found.select("h", F.explode(F.flatten(F.transform("found", parts_of))).alias("part"))
    parts = settle(parts.where(F.col("part.kind") != "title").select("h", "part.kind", "part.value").distinct())
    table = settle(surrogate_table(parts, key))
    known = parts.join(table, ["kind", "value"]).groupBy("h")
    known = known.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("=", "kind", "value"), "new"))).alias("surrogates"))
    aside = {c: f"column{i}" for i, c in enumerate(columns)}
    own = aside[text]
    held = some.select(*[F.col(c).alias(a) for c, a in aside.items()]).withColumn("h", F.md5(own)).join(known, "h", "left")
    has = F.col("surrogates").isNotNull()
    new = lambda p: F.when(p["kind"] == "title", p["form"]).otherwise(
        _written(p, F.element_at("surrogates", F.concat_ws("=", p["kind"], p["value"])))
    )
    whole = F.transform(entities(F.col(own)), lambda e: F.array_join(F.transform(parts_of(e), new), " "))
    between = F.split(F.col(own), ENTITY, -1)
    woven = F.array_join(F.transform(F.arrays_zip(between.alias("b"), whole.alias("e")), lambda z: F.concat(z["b"], F.coalesce(z["e"], F.lit("")))), "")
    done = held.select(
        *[(F.when(has, woven).otherwise(F.col(a)) if c == text else F.col(a)).alias(c) for c, a in aside.items()],
        F.when(has, F.size(entities(F.col(own)))).otherwise(0).alias(count),
    )
    return none.unionByName(done)
