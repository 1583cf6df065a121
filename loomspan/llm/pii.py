"""Personal data replaced by keyed surrogates, in DataFrame functions alone.

Entities are found by one pattern. An entity with a form (an address, a number,
a secret) is replaced by a keyed permutation of all strings of its form, a
Feistel network over its two halves: letters stay letters of their case and
script, digits stay digits, a telephone keeps its country code, card numbers
and IBANs keep their checksums, an address stays a valid address. So different
entities have different surrogates by construction. An entity is its value and
not its writing: separators of numbers and the case of addresses are taken off
before and put back behind, so all writings of one number agree. A
person's name is made of syllables of its script; each word of a name has one
surrogate in the whole corpus, whatever the title and the case, and ends as
the gender does that all titles before it tell.

Before anything is replaced the distinct entities of the whole corpus are
checked: of two that would share a surrogate, or one whose surrogate is an
entity of the corpus, the later takes its next attempt (another key; names grow
by a syllable), until all differ. Addresses of a form that has room for less
than four times those that the corpus has grow by three letters. Numbers of a
form that is as full cannot grow: they keep the permutation itself, whose
values differ, though one may be another real number of that form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.session import written

_MALE = r"Mr|Herr|Monsieur|Señor|Sr|Господин|Κύριος"
_FEMALE = r"Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа|Κυρία"
_EITHER = r"Dr|Prof"
#: JONES, O'Neil, McDonald, Anna-Maria.
_NAME = r"(?:\p{Lu}['’])?\p{Lu}\p{L}+(?:[-'’]\p{Lu}\p{L}+)*"
_TITLES = rf"(?:(?:{_MALE}|{_FEMALE}|{_EITHER})\.? )+"
#: Kinds in the order in which they are tried at a place, and the pattern of each.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<!-)\d{3}-\d{3}-\d{4}(?![\d-]))",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ipv6": r"(?<![\p{L}\p{N}:.])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|(?=[0-9A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}))(?![\p{L}\p{N}:])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9A-Fa-f]{32,64}|AKIA[0-9A-Z]{16}|(?:sk|ghp|gho|xoxb)[-_][A-Za-z0-9_-]{16,})(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "person": rf"(?<!\p{{L}}){_TITLES}(?:(?:\p{{Lu}}\. ?)*{_NAME})(?: (?:\p{{Lu}}\. ?)*{_NAME})?(?!\p{{L}})",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: A word that may be a known name, with the initials before it, in texts that name persons.
BARE = r"(?<![\p{L}\p{N}])(?:\p{Lu}\. ?)*\p{Lu}\p{L}+(?![\p{L}\p{N}])"
WITH_BARE = f"{PATTERN}|(?:{BARE})"
#: Country codes of one and two digits; all others have three.
COUNTRY = r"\A(\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}))"
#: A text without this has no entity.
HINT = rf"[0-9@]|::|AKIA|(?:sk|ghp|gho|xoxb)[-_]|[A-Fa-f]{{32}}|(?<!\p{{L}})(?:{_MALE}|{_FEMALE}|{_EITHER})\.? \p{{Lu}}"
#: Fixed syllables of made-up names by script; the last of a given name tells the gender.
SYLLABLES = {
    "latin": ("ba be da do fe ga ka la le lo ma mi na no pa ra ri sa so ta te ti va ve vi za", "ro lan bert mund rik dor", "ra lina bella mira rika dora"),
    "cyrillic": ("ба ве га да до ка ла ле ло ма ми на но па ра ри са со та те ти ва ви за зо", "рин лан берт мир рик дор", "рина лина белла мира рика дора"),
    "greek": ("βα γε δα κα λα λε λο μα μι να νο πα ρα ρι σα σο τα τε τι ζα ζε φα φι χα χο θε", "ρος λας μος νης δης τος", "ρα λια μια νια δια τια"),
}


def kind_of(value: Column) -> Column:
    out = F.lit("person")
    for kind in reversed(list(KINDS)[:-1]):
        out = F.when(value.rlike(rf"\A(?:{KINDS[kind]})\z"), kind).otherwise(out)
    return out


def canonical(kind: Column, match: Column) -> Column:
    """An entity's value whatever its writing: numbers without separators, addresses in lower case."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    plus = F.when(match.startswith("+"), F.concat(F.lit("+"), digits)).otherwise(digits)
    return F.when(kind == "card", digits).when(kind == "phone", plus).when(kind == "iban", F.regexp_replace(match, " ", "")).when(kind.isin("email", "ipv6"), F.lower(match)).otherwise(match)


def _refilled(match: Column, made: Column, pattern: str) -> Column:
    """The characters of match that fit the pattern, of which made has as many, replaced in order."""
    gaps = F.split(match, pattern, -1)
    return F.array_join(F.zip_with(gaps, F.regexp_extract_all(made, F.lit(pattern), F.lit(0)), lambda g, c: F.concat(g, F.coalesce(c, F.lit("")))), "")


def written_as(kind: Column, match: Column, made: Column) -> Column:
    """The surrogate of a canonical value in the writing of a match."""
    more = F.length(made) - F.length(match)
    letters = F.regexp_extract_all(made, F.lit("(?s)."), F.lit(0))
    cased = F.array_join(F.transform(letters, lambda c, i: F.when(F.substr(match, (i + 1 - more).cast("int"), F.lit(1)).rlike(r"\p{Lu}") & (i >= more), F.upper(c)).otherwise(c)), "")
    return (
        F.when(kind.isin("card", "phone"), _refilled(match, made, "[0-9]"))
        .when(kind == "iban", _refilled(match, made, "[A-Za-z0-9]"))
        .when(kind.isin("email", "ipv6") & (match != F.lower(match)), cased)
        .otherwise(made)
    )


def _let(x: Column, f) -> Column:
    """f(x) with x computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _key(secret: str, *parts: Column) -> Column:
    """A keyed digest: the key's digest goes in before and after, as in HMAC."""
    key = F.sha2(F.lit(secret), 256)
    return F.sha2(F.concat(key, F.sha2(F.concat_ws("\1", key, *parts), 256)), 256)


_LOWER = "abcdefghijklmnopqrstuvwxyz"
_CYRILLIC, _GREEK, _ACCENTS = "абвгдежзийклмнопрстуфхцчшщъыьэюяё", "αβγδεζηθικλμνξοπρστυφχψω", "àáâäåèéêëìíîïñòóôöùúûüøæçß"
ALPHABETS = ("0123456789", _LOWER, _LOWER.upper(), _CYRILLIC, _CYRILLIC.upper(), _GREEK, _GREEK.upper(), _ACCENTS, "ÀÁÂÄÅÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜØÆÇẞ")
_HEX = ("0123456789abcdef", "0123456789ABCDEF")


def _letters(*alphabets: str) -> Column:
    return F.array(*[F.lit(a) for a in alphabets])


def _shifted(half: Column, key: Column, alphabets: Column) -> Column:
    """Each character moved on in its alphabet by a draw for its place; one of no alphabet stays."""

    def one(c: Column, i: Column) -> Column:
        letters = F.get(F.filter(alphabets, lambda a: F.contains(a, c)), F.lit(0))
        n = F.length(letters).cast("long")
        to = F.pmod(F.position(c, letters) - 1 + F.pmod(F.xxhash64(key, i), n), n)
        return F.when(letters.isNull(), c).otherwise(F.substr(letters, (to + 1).cast("int"), F.lit(1)))

    return F.array_join(F.transform(F.regexp_extract_all(half, F.lit("(?s)."), F.lit(0)), one), "")


def permuted(value: Column, key: Column, alphabets: Column) -> Column:
    """A keyed permutation of the strings of value's form: four Feistel rounds over its halves."""
    middle = F.ceil(F.length(value) / 2).cast("int")
    out = F.struct(F.substr(value, F.lit(1), middle).alias("l"), F.substr(value, middle + 1, F.length(value)).alias("r"))

    def turned(turn: int, here: str, other: str):
        def step(s: Column) -> Column:
            draw = F.sha2(F.concat_ws("\2", key, F.lit(str(turn)), s[other]), 256)
            made = _let(draw, lambda k: _shifted(s[here], k, alphabets))
            return F.struct(*[(made if x == here else s[x]).alias(x) for x in "lr"])

        return step

    for turn in range(4):
        out = _let(out, turned(turn, *("lr" if turn % 2 == 0 else "rl")))
    return _let(out, lambda s: F.concat(s["l"], s["r"]))


def luhn(value: Column) -> Column:
    """The Luhn sum of a text's digits, modulo ten."""
    digits = F.reverse(F.split(F.regexp_replace(value, "[^0-9]", ""), ""))
    twice = lambda c, i: F.when(i % 2 == 1, F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int"))).otherwise(c.cast("int"))
    return F.aggregate(F.transform(digits, twice), F.lit(0), lambda a, x: a + x) % 10


def _card(value: Column, key: Column) -> Column:
    """All digits but the last are permuted; the last stays as far from the right one as it was, so a valid number stays valid."""
    body, last = F.substr(value, F.lit(1), F.length(value) - 1), F.right(value, F.lit(1)).cast("int")
    right = lambda b: F.pmod(-luhn(F.concat(b, F.lit("0"))), F.lit(10))
    return _let(permuted(body, key, _letters(*ALPHABETS)), lambda b: F.concat(b, F.pmod(right(b) + last - right(body), F.lit(10)).cast("string")))


def iban_check(value: Column) -> Column:
    """The two check digits that make an IBAN's country and account valid."""
    text = F.concat(F.substr(F.regexp_replace(value, " ", ""), F.lit(5), F.length(value)), F.substr(value, F.lit(1), F.lit(2)), F.lit("00"))
    places = F.transform(F.split(text, ""), lambda c: F.position(c, F.lit("0123456789" + _LOWER.upper())) - 1)
    rest = F.aggregate(places, F.lit(0), lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + x) % 97)
    return 98 - rest


def _iban(value: Column, key: Column) -> Column:
    """The country stays, the account is permuted, the check digits stay as far from the right ones as they were."""
    country, own, body = F.substr(value, F.lit(1), F.lit(2)), F.substr(value, F.lit(3), F.lit(2)).cast("int"), F.substr(value, F.lit(5), F.length(value))

    def whole(b: Column) -> Column:
        right = iban_check(F.concat(country, F.lit("00"), b))
        return F.concat(country, F.lpad(F.pmod(right + own - iban_check(value), F.lit(100)).cast("string"), 2, "0"), b)

    return _let(permuted(body, key, _letters(*ALPHABETS)), whole)


def _ip(value: Column, key: Column) -> Column:
    """The four octets as eight hexadecimal digits, permuted."""
    digits = F.array_join(F.transform(F.split(value, r"\."), lambda o: F.lpad(F.lower(F.hex(o.cast("int"))), 2, "0")), "")
    made = permuted(digits, key, _letters(_HEX[0]))
    return _let(made, lambda m: F.concat_ws(".", *[F.conv(F.substr(m, F.lit(i), F.lit(2)), 16, 10) for i in (1, 3, 5, 7)]))


def script_of(value: Column) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def gender_of(title: Column) -> Column:
    """m or f if a word of the title tells, else n."""
    return F.when(title.rlike(rf"(?:^| )(?:{_FEMALE})\b"), "f").when(title.rlike(rf"(?:^| )(?:{_MALE})\b"), "m").otherwise("n")


def _made_name(value: Column, gender: Column, attempt: Column, key: Column) -> Column:
    """A word of three syllables and one more for each attempt, in the value's script; it ends as its gender does."""
    draw = lambda i, n: F.pmod(F.xxhash64(key, i), F.lit(n)).cast("int")
    pick = lambda words, i: F.get(F.array(*[F.lit(w) for w in words]), draw(i, len(words)))
    syllable = lambda words: lambda i: pick(words, i)
    out = F.lit("")
    for script, (plain, male, female) in reversed(SYLLABLES.items()):
        plain, male, female = plain.split(), male.split(), female.split()
        stem = F.array_join(F.transform(F.sequence(F.lit(1), attempt + 3), syllable(plain)), "")
        close = F.when(gender == "m", pick(male, F.lit(-1))).when(gender == "f", pick(female, F.lit(-1))).otherwise(pick(plain, F.lit(-1)))
        out = F.when(script_of(value) == script, F.concat(stem, close)).otherwise(out)
    return out


def surrogate(secret: str, kind: Column, value: Column, attempt: Column, gender: Column, wide: Column) -> Column:
    """The surrogate of one entity of any kind; a name is one lower-case word. wide: letters that an address grows by."""
    key = _key(secret, kind, attempt.cast("string"))
    code = F.length(F.regexp_extract(value, COUNTRY, 1))
    tail = F.regexp_extract(value, r"(\.[A-Za-z]+)\z", 1)
    mail = F.concat(F.repeat(F.lit("a"), wide), F.substr(value, F.lit(1), F.length(value) - F.length(tail)))
    mark = F.regexp_extract(value, r"\A(AKIA|(?:sk|ghp|gho|xoxb)[-_])", 1)
    hexed = value.rlike(r"\A[0-9A-Fa-f]+\z")
    alphabets = F.when(hexed & ~value.rlike("[A-F]"), _letters(_HEX[0])).when(hexed & ~value.rlike("[a-f]"), _letters(_HEX[1])).when(hexed, _letters("0123456789", "abcdef", "ABCDEF")).otherwise(_letters(*ALPHABETS))
    after = lambda n: F.substr(value, n + 1, F.length(value))
    every = _letters(*ALPHABETS)
    return (
        F.when(kind == "email", F.concat(permuted(mail, key, every), tail))
        .when(kind == "phone", F.concat(F.substr(value, F.lit(1), code), permuted(after(code), key, _letters(ALPHABETS[0]))))
        .when(kind == "ssn", permuted(value, key, every))
        .when(kind == "ip", _ip(value, key))
        .when(kind == "ipv6", permuted(value, key, _letters(_HEX[0])))
        .when(kind == "secret", F.concat(mark, permuted(after(F.length(mark)), key, alphabets)))
        .when(kind == "card", _card(value, key))
        .when(kind == "iban", _iban(value, key))
        .otherwise(_made_name(value, gender, attempt, _key(secret, kind, value, attempt.cast("string"))))
    )


def _title(match: Column) -> Column:
    return F.regexp_extract(match, rf"\A({_TITLES})", 1)


def entities_of(match: Column) -> Column:
    """A match as array<struct<kind, value, gender>>; each word of a person's name is an entity of its own, in lower case."""
    title = _title(match)
    names = F.substr(match, F.length(title) + 1, F.length(match))
    given = F.when(names.contains(" "), F.substring_index(names, " ", 1)).otherwise("")
    words = lambda x: F.regexp_extract_all(x, F.lit(r"\p{L}{2,}"), F.lit(0))
    name = lambda g: lambda w: F.struct(F.lit("name").alias("kind"), F.lower(w).alias("value"), g.alias("gender"))
    person = F.concat(F.transform(words(given), name(gender_of(title))), F.transform(words(F.substr(names, F.length(given) + 1, F.length(names))), name(F.lit("n"))))
    one = lambda kind: F.array(F.struct(kind.alias("kind"), canonical(kind, match).alias("value"), F.lit("n").alias("gender")))
    return _let(kind_of(match), lambda kind: F.when(kind == "person", person).otherwise(one(kind)))


def _entity_key(kind: Column | str, value: Column) -> Column:
    return F.concat(F.lit(kind) if isinstance(kind, str) else kind, F.lit("\1"), value)


def matches(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))


def _entities(mentions: DataFrame) -> DataFrame:
    """(kind, value, gender, wide, full) of the distinct entities of mentions (kind, value, gender)."""
    each = mentions.groupBy("kind", "value").agg(F.max(F.col("gender") == "m").alias("m"), F.max(F.col("gender") == "f").alias("f"))
    each = each.withColumn("gender", F.when(F.col("m") & ~F.col("f"), "m").when(F.col("f") & ~F.col("m"), "f").otherwise("n"))
    form = F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[0-9]", "0"), r"\p{Lu}", "A"), r"\p{Ll}", "a")
    each = written(each.select("kind", "value", "gender", F.when(F.col("kind") != "name", form).alias("form")), "pii-entities")
    # what the surrogate keeps has no room: country codes and check digits, the end of an address, the marks of secrets
    fixed = F.when(F.col("kind") == "phone", r"\A\+0{1,3}").when(F.col("kind") == "email", r"\.[aA]+\z").when(F.col("kind") == "card", r"0\z").when(F.col("kind") == "iban", r"\A....").otherwise(r"\AAAAA(?=A)|\A[aA]+[-_]")
    free = F.regexp_replace("form", fixed, F.lit(""))
    room = F.regexp_count(free, F.lit("0")) + F.log10(F.lit(26.0)) * F.regexp_count(free, F.lit("[aA]"))
    crowded = each.where("form is not null").groupBy("kind", "form").agg(F.count("*").alias("n")).where(F.log10(F.col("n") * 4) > room).select("kind", "form", F.lit(True).alias("crowded"))
    out = each.join(crowded, ["kind", "form"], "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    return out.select("kind", "value", "gender", F.when(F.col("crowded") & (F.col("kind") == "email"), 3).otherwise(0).alias("wide"), (F.col("crowded") & (F.col("kind") != "email")).alias("full"))


def surrogates(mentions: DataFrame, secret: str, rounds: int = 40) -> DataFrame:
    """(kind, value, made, attempt) of each distinct entity of mentions (kind, value, gender): no two share a surrogate, and none is an entity itself, but for crowded forms of numbers."""
    known = written(_entities(mentions), "pii-known")
    todo = known.withColumn("attempt", F.lit(0))
    real = known.select(F.col("value").alias("made")).distinct()
    done = None
    for _ in range(rounds):
        made = written(todo.withColumn("made", surrogate(secret, F.col("kind"), F.col("value"), F.col("attempt"), F.col("gender"), F.col("wide"))), "pii-made")
        # the holder of a surrogate is the first of those that want it; what was given before stays given
        first = made.groupBy("made").agg(F.min(F.struct("kind", "value")).alias("holder"))
        good = made.join(first, "made").where(F.col("full") | (F.struct("kind", "value") == F.col("holder")))
        good = good.where("full").unionByName(good.where("not full").join(real, "made", "left_anti").select(good.columns)).drop("holder")
        if done is not None:
            good = good.join(done.select("made"), "made", "left_anti")
        good = written(good.select(made.columns), "pii-settled")
        rest = written(made.join(good.select("kind", "value"), ["kind", "value"], "left_anti").withColumn("attempt", F.col("attempt") + 1).drop("made"), "pii-again")
        mine = good.select("kind", "value", "made", "attempt")
        done = mine if done is None else done.unionByName(mine)
        if rest.isEmpty():
            return done
        todo = rest
    raise RuntimeError("surrogates still collide: the corpus has more numbers of some form than the form has room for")


def _recased(word: Column, made: Column) -> Column:
    return F.when(word == F.upper(word), F.upper(made)).otherwise(F.initcap(made))


def _person(secret: str, match: Column, given: Column) -> Column:
    """A person's match with the words of its name replaced; title, initials' stops, hyphens and apostrophes stay. An initial is shifted in its alphabet."""
    title = _title(match)
    names = F.substr(match, F.length(title) + 1, F.length(match))
    words, gaps = F.regexp_extract_all(names, F.lit(r"\p{L}+"), F.lit(0)), F.split(names, r"\p{L}+", -1)

    def one(w: Column, i: Column) -> Column:
        made = F.try_element_at(given, _entity_key("name", F.lower(w)))
        initial = F.when(F.get(gaps, i + 1).rlike("^['’]"), w).otherwise(_shifted(w, _key(secret, F.lit("initial")), _letters(*ALPHABETS)))
        return F.when(F.length(w) == 1, initial).otherwise(F.coalesce(_recased(w, made), w))

    new = F.transform(words, one)
    return F.concat(title, F.array_join(F.zip_with(gaps, new, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), ""))


def _new_of(secret: str, match: Column, given: Column) -> Column:
    """What stands in the place of a match: of an entity its surrogate, of a bare word that is a name of this text the name's, else itself."""
    bare = F.try_element_at(given, _entity_key("name", F.lower(F.regexp_replace(match, r"\A(?:\p{Lu}\. ?)+", ""))))
    titled = match.rlike(rf"\A{_TITLES}\p{{Lu}}")

    def of(kind: Column) -> Column:
        own = F.try_element_at(given, _entity_key(kind, canonical(kind, match)))
        put = lambda own: written_as(kind, match, own)
        return F.when((kind == "person") & (titled | bare.isNotNull()), _person(secret, match, given)).when(kind != "person", _let(own, put))

    return F.coalesce(_let(kind_of(match), of), match)


def replaced(secret: str, text: Column, given: Column) -> Column:
    """struct<text, n>: text with every entity replaced, and how many were; given maps this text's entities to their surrogates."""
    named = F.exists(F.map_keys(given), lambda k: k.startswith("name\1"))

    def of(pattern: str) -> Column:
        found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
        new = F.transform(found, lambda m: _new_of(secret, m, given))
        n = F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x)).cast("long")
        both = lambda made: F.array_join(F.zip_with(gaps, made, lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")
        return _let(F.struct(new.alias("new"), n.alias("n")), lambda s: F.struct(both(s["new"]).alias("text"), s["n"].alias("n")))

    return F.when(named, of(WITH_BARE)).otherwise(of(PATTERN))


def anonymize(docs: DataFrame, secret: str, text: str = "text") -> DataFrame:
    """docs with text anonymised and n_entities, the number of replacements.

    The same entity has the same surrogate everywhere and different entities
    have different ones. In a text that names a person after a title, that
    name's words are replaced wherever they stand in it. A null text stays null
    with 0 entities; empty texts, repeated rows and other columns, whatever
    their names, stay as they are (but n_entities, which is replaced); an empty
    table gives an empty result. Texts without an entity are not shuffled; the
    others meet their surrogates by a 128-bit digest of the text.
    """
    value = F.col(text).cast("string")
    found = docs.select(F.md5(value).alias("row"), matches(value).alias("m")).where(F.size("m") > 0)
    found = found.select("row", F.array_distinct(F.flatten(F.transform("m", entities_of))).alias("e")).dropDuplicates(["row"])
    each = written(found, "pii-mentions").select("row", F.explode("e").alias("e")).select("row", "e.*")
    made = surrogates(each, secret).select("kind", "value", "made")
    pair = F.struct(_entity_key(F.col("kind"), F.col("value")).alias("key"), "made")
    maps = each.select("row", "kind", "value").distinct().join(made, ["kind", "value"]).groupBy("row").agg(F.map_from_entries(F.collect_list(pair)).alias("given"))
    maps = written(maps, "pii-maps")
    own = [c for c in docs.columns if c != "n_entities"]
    has = F.coalesce(F.size(matches(value)) > 0, F.lit(False))
    plain = docs.where(~has).select(*[value.alias(c) if c == text else F.col(c) for c in own], F.lit(0).cast("long").alias("n_entities"))
    held = docs.where(has).select(F.struct(*own).alias("_doc"), F.md5(value).alias("row"))
    new = replaced(secret, F.col("_doc")[text].cast("string"), F.col("given"))
    full = held.join(maps, "row").select("_doc", new.alias("_new"))
    full = full.select(*[F.col("_new")["text"].alias(c) if c == text else F.col("_doc")[c].alias(c) for c in own], F.col("_new")["n"].alias("n_entities"))
    return plain.unionByName(full)


def op3_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return anonymize(docs, "a key of the deployment").select("doc_id", "text", "n_entities")
