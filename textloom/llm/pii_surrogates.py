"""Keyed surrogates for personal data, with DataFrame functions only.

Entities are found by one pattern. Each gets a replacement of its own type and format, computed
from a secret key: character by character, every letter or digit is shifted within its alphabet
by a keyed hash of what stands before it, forwards and then backwards. For a given key this is
one-to-one on strings of a format, so that different entities keep different surrogates and an
entity has the same one in every document, without any table. Case, script, separators, check
digits, number ranges and the gender of first names stay; in other names vowels become vowels
and consonants consonants.

A text's names are its persons: their first names and surnames are replaced wherever the same
text has them alone. A first name alone in a text that has no such person is left as it is.

A check over all documents looks for surrogates that are entities of the corpus themselves or
that two entities share, and draws these again; names are checked word by word. Such exceptions
are rare, and stay a table. A name's later draws are longer, so names never run out.
"""

from __future__ import annotations

import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.storage import materialise

#: First names by script and gender (fixed values). Surrogates are drawn from the same list.
FIRST_NAMES = {
    ("latin", "female"): ["Alice", "Amelia", "Barbara", "Camille", "Carmen", "Charlotte", "Claudia", "Elizabeth", "Emily", "Hannah", "Isabel", "Jennifer", "Jessica", "Julia", "Katharina", "Linda", "Lucy", "Margaret", "Marie", "Olivia", "Patricia", "Rachel", "Sophie", "Victoria"],
    ("latin", "male"): ["Alexander", "Andrew", "Antonio", "Benjamin", "Charles", "Christopher", "Daniel", "David", "Edward", "Felix", "Francisco", "Frederick", "George", "Henry", "Jacob", "James", "John", "Michael", "Nicholas", "Pierre", "Richard", "Robert", "Thomas", "William"],
    ("cyrillic", "female"): ["Анна", "Дарья", "Екатерина", "Елена", "Ирина", "Мария", "Наталья", "Ольга"],
    ("cyrillic", "male"): ["Алексей", "Андрей", "Дмитрий", "Иван", "Михаил", "Николай", "Павел", "Сергей"],
    ("greek", "female"): ["Άννα", "Δήμητρα", "Ελένη", "Κατερίνα", "Μαρία", "Σοφία"],
    ("greek", "male"): ["Αλέξανδρος", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Παναγιώτης"],
}
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Mme", "Mlle", "Sra"]
#: Alphabets within which a character is shifted (fixed values).
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]
#: The same for names: vowels and consonants apart.
NAME_ALPHABETS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЫЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ"]
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_ALL_FIRST = [n for names in FIRST_NAMES.values() for n in names]
#: A capitalised word, also with further capitals, hyphens and apostrophes; a word of capitals.
_CAPITAL = r"\p{Lu}(?:\p{Ll}+|['’]\p{Lu}\p{Ll}+)(?:(?:[-'’]\p{Lu}|\p{Lu})\p{Ll}+)*+"
_CAPITALS = r"\p{Lu}['’]?\p{Lu}+(?:[-'’]\p{Lu}+)*+"
#: Types in order of precedence, with their patterns.
PATTERNS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])",
    "card": r"(?<![\d-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13,19})(?![\d-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?!\d)",
    "national_id": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\d]|\.\d)",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?=\p{{Lu}})(?:(?:{'|'.join(TITLES)})\.? {_CAPITAL}(?: {_CAPITAL})?|(?:{'|'.join(_ALL_FIRST)})(?:-{_CAPITAL})? {_CAPITAL}|(?:{'|'.join(n.upper() for n in _ALL_FIRST)}) {_CAPITALS})(?![\p{{L}}\p{{N}}])",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What a text must have for any pattern to match; most texts are passed by at this.
HINT = r"[0-9@]|(?<!\p{L})(?=\p{Lu})(?:" + "|".join(TITLES + _ALL_FIRST + [n.upper() for n in _ALL_FIRST]) + r")(?!\p{L})"
#: Capitalised words, and what stands between them.
_PIECES = r"(?<!\p{L})\p{Lu}\p{L}*(?:['’-]\p{Lu}\p{L}*)*|(?:[^\p{Lu}]|(?<=\p{L})\p{Lu})+"
MAX_DRAWS, MAX_LITERALS, LONGER = 20, 1_000, 3


def _number(key: Column, *parts: Column) -> Column:
    """A keyed hash as a number under 2**52."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", key, *parts), 256), 1, 13), 16, 10).cast("long")


def _shifted(c: Column, by: Column, alphabets: list[str] = ALPHABETS) -> Column:
    """The character ``by`` places on in its alphabet; others stay."""
    out = c
    for letters in alphabets:
        at = F.instr(F.lit(letters), c)
        moved = F.substring(F.lit(letters), ((at - 1 + by) % len(letters) + 1).cast("int"), F.lit(1))
        out = F.when(at > 0, moved).otherwise(out)
    return out


def _pass(text: Column, key: Column, tag: str, alphabets: list[str] = ALPHABETS) -> Column:
    """Shift every character by a keyed hash of those before it."""
    places = F.sequence(F.lit(1), F.length(text))

    def one(i: Column) -> Column:
        before = F.lower(F.substring(text, F.lit(1), i - 1))
        return _shifted(F.substring(text, i, F.lit(1)), _number(key, F.lit(tag), before), alphabets)

    return F.when(F.length(text) > 0, F.array_join(F.transform(places, one), "")).otherwise(text)


def _scrambled(text: Column, key: Column, tag: str, alphabets: list[str] = ALPHABETS) -> Column:
    """Both passes: one-to-one on strings of the same format."""
    forth = F.transform(F.array(text), lambda t: _pass(t, key, tag + ">", alphabets))
    back = F.transform(forth, lambda t: F.reverse(_pass(F.reverse(t), key, tag + "<", alphabets)))
    return back[0]


def _let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once."""
    return F.transform(F.array(value), f)[0]


def _luhn(digits: Column) -> Column:
    """The check digit that belongs behind a string of digits."""
    places = F.sequence(F.lit(1), F.length(digits))

    def weighed(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return (10 - F.aggregate(F.transform(places, weighed), F.lit(0), lambda a, x: a + x.cast("int")) % 10) % 10


def _card(e: Column, key: Column) -> Column:
    """First digit and separators stay; a valid check digit stays valid, an invalid one invalid."""
    digits = F.regexp_replace(e, r"\D", "")

    def whole(d: Column) -> Column:
        head, last = F.substring(d, F.lit(1), F.length(d) - 1), F.substring(d, F.length(d), F.lit(1)).cast("int")
        new = F.concat(F.substring(head, 1, 1), _scrambled(F.substring(head, F.lit(2), F.length(head) - 1), F.concat(key, F.substring(head, 1, 1)), "card"))
        return _let(F.struct(new.alias("n"), head.alias("h"), last.alias("l")), lambda s: F.concat(s["n"], ((_luhn(s["n"]) + s["l"] - _luhn(s["h"]) + 10) % 10).cast("string")))

    plain = _let(digits, whole)
    separator = F.regexp_extract(e, r"^\d{4}([ -])", 1)
    return F.when(separator == "", plain).otherwise(_let(plain, lambda p: F.concat(*[x for k in range(4) for x in (separator, F.substring(p, 1 + 4 * k, 4))][1:])))


def _ip(e: Column, key: Column) -> Column:
    """Each octet is shifted by a keyed hash of those before it."""
    octets = F.split(e, r"\.")

    def one(i: Column) -> Column:
        before = F.array_join(F.slice(octets, F.lit(1), i - 1), ".")
        return ((F.element_at(octets, i).cast("int") + _number(key, F.lit("ip"), before)) % 256).cast("string")

    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), one), ".")


def _first_names(key: str) -> Column:
    """First name to first name of the same script and gender: each list in keyed order, one place on."""
    flat = []
    for names in FIRST_NAMES.values():
        order = sorted(names, key=lambda n: hmac.digest(key.encode(), n.encode(), "sha256"))
        for a, b in zip(order, order[1:] + order[:1]):
            flat += [F.lit(a), F.lit(b)]
    return F.create_map(*flat)


def _name_word(word: Column, key: Column, first: Column, draw: Column | None) -> Column:
    """Known first names change within their gender, other words within their script; later draws add syllables."""
    title = F.initcap(F.lower(word))
    listed = F.coalesce(F.element_at(first, word), F.when(word == F.upper(word), F.upper(F.element_at(first, title))))
    other = _scrambled(word, key, "name", NAME_ALPHABETS)
    if draw is not None:
        more = F.transform(F.sequence(F.lit(1), F.greatest(draw - LONGER, F.lit(1)).cast("int")), lambda k: F.concat(_shifted(F.lit("t"), _number(key, F.lit("more"), k.cast("string"), F.lower(word)), NAME_ALPHABETS), _shifted(F.lit("a"), _number(key, F.lit("more-"), k.cast("string"), F.lower(word)), NAME_ALPHABETS)))
        added = F.array_join(more, "")
        other = F.when(draw > LONGER, F.concat(other, F.when(word == F.upper(word), F.upper(added)).otherwise(added))).otherwise(other)
    return F.coalesce(listed, other)


def _titles() -> Column:
    return F.array(*[F.lit(t) for t in TITLES], *[F.lit(t + ".") for t in TITLES])


def entity_type(e: Column) -> Column:
    """The type of an entity found by ``ENTITY``."""
    digits = F.length(F.regexp_replace(e, r"\D", ""))
    kind = F.when(F.instr(e, "@") > 0, "email").when(e.rlike(r"^[0-9A-Fa-f]{32,}$"), "secret").when(e.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "ip")
    kind = kind.when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "national_id").when(e.rlike(r"^[\d -]+$") & (digits >= 13), "card")
    return kind.when(e.rlike(r"^[+(\d]"), "phone").otherwise("name")


def unit_surrogate(e: Column, secret: Column, first: Column, draw: Column | None = None) -> Column:
    """The replacement of an entity, or of one word of a name; ``draw`` above 0 gives others."""
    key = F.concat(secret, F.lit("#"), (F.lit(0) if draw is None else draw).cast("string"))
    kind = entity_type(e)
    mail = F.concat(_scrambled(F.regexp_extract(e, r"^(.*)\.[^.]*$", 1), key, "email"), F.regexp_extract(e, r"(\.[^.]*)$", 1))
    code = F.regexp_extract(e, r"^(\+\d{1,3}(?=[ .(-]))", 1)
    phone = F.concat(code, _scrambled(F.substring(e, F.length(code) + 1, F.length(e)), F.concat(key, code), "phone"))
    hexes = _scrambled(e, key, "secret", ["0123456789abcdef"])
    hexes = F.when(e.rlike("[a-f]") | e.rlike(r"^\d+$"), hexes).otherwise(_scrambled(e, key, "secret", ["0123456789ABCDEF"]))
    out = F.when(kind == "email", mail).when(kind == "phone", phone).when(kind == "secret", hexes)
    out = out.when(kind == "card", _card(e, key)).when(kind == "ip", _ip(e, key)).when(kind == "national_id", _scrambled(e, key, "national_id"))
    return out.otherwise(_name_word(e, key, first, draw))


def _units(e: Column) -> Column:
    """What of an entity is replaced by itself: a name's words, or the whole."""
    return F.when(entity_type(e) == "name", F.split(e, " ")).otherwise(F.array(e))


def _replacement(e: Column, unit) -> Column:
    """The entity with its units replaced by ``unit``; titles stay."""
    return F.when(entity_type(e) == "name", F.array_join(F.transform(F.split(e, " "), lambda w: F.when(F.array_contains(_titles(), w), w).otherwise(unit(w))), " ")).otherwise(unit(e))


def entities(text: Column) -> Column:
    """All entities of a text in order."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _exceptions(texts: DataFrame, secret: str) -> DataFrame | None:
    """Units whose surrogate must be drawn again, with their draw; None if there are none.

    Listed first names are exchanged one to one within their list, so they are only compared with.
    """
    first, listed = _first_names(secret), [n.lower() for n in _ALL_FIRST]
    found = texts.select("key", F.explode(entities(F.col("body"))).alias("x")).select("key", F.explode(_units(F.col("x"))).alias("e")).where(~F.array_contains(_titles(), F.col("e")))
    found = found.groupBy("e").agg(F.first("key").alias("key")).withColumn("canon", F.lower("e")).where(~F.col("canon").isin(listed))
    found = materialise(found.select("e", "canon", unit_surrogate(F.col("e"), F.col("key"), first).alias("s")), "pii-entities")
    redrawn = None
    for draw in range(1, MAX_DRAWS):
        current = found if redrawn is None else found.join(redrawn.select("e", F.col("s").alias("s2")), "e", "left").select("e", "canon", F.coalesce("s2", "s").alias("s"))
        made = current.withColumn("made", F.lower("s"))
        real = made.join(found.select(F.col("canon").alias("made")).distinct(), "made", "left_semi").unionByName(made.where(F.col("made").isin(listed))).select("e", "canon")
        twice = made.groupBy("made").agg(F.min("canon").alias("lo"), F.max("canon").alias("hi")).where("lo <> hi")
        shared = made.join(twice, "made").where("canon <> lo").select("e", "canon")
        bad = materialise(real.unionByName(shared).distinct(), "pii-redraw")
        if bad.isEmpty():
            return redrawn
        again = _keyed(bad, secret).select("e", unit_surrogate(F.col("e"), F.col("key"), first, F.lit(draw)).alias("s"))
        redrawn = materialise(again if redrawn is None else redrawn.join(again.select("e"), "e", "left_anti").unionByName(again), "pii-redrawn")
    raise ValueError("surrogates of a format are exhausted: two entities cannot be kept distinct")


def _keyed(rows: DataFrame, secret: str) -> DataFrame:
    """The rows with the key as a column: taken from a table of one row when run, so that no plan shows it."""
    return rows.withColumn("key", rows.sparkSession.createDataFrame([(secret,)], "k string").scalar())


def replace_pii(docs: DataFrame, secret: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``id_col, text, n_entities, entity_types``: the text with surrogates.

    A text without entities comes back as it was; a null text stays null, with 0 entities and no
    types. Rows are independent, so repeats and ties are replaced alike; null ids and further
    columns, whatever their names, do not matter; an empty table gives no rows. If other
    entities than names share so short a format that distinct surrogates run out, a ValueError
    is raised.
    """
    texts = _keyed(docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("body")), secret)
    redrawn, first = _exceptions(texts, secret), _first_names(secret)
    if redrawn is not None and redrawn.limit(MAX_LITERALS + 1).count() > MAX_LITERALS:
        return _replaced_by_join(texts, redrawn, secret, id_col)
    known = [F.lit(x) for r in (redrawn.collect() if redrawn is not None else []) for x in (r["e"], r["s"])]
    plain = lambda e: unit_surrogate(e, F.col("key"), first)
    new = (lambda e: F.coalesce(F.element_at(F.create_map(*known), e), plain(e))) if known else plain
    found = texts.withColumn("found", entities(F.coalesce("body", F.lit(""))))
    return _assembled(found.withColumn("made", F.transform("found", lambda e: _replacement(e, new))), id_col)


def _assembled(rows: DataFrame, id_col: str) -> DataFrame:
    """Texts between the entities with the surrogates put in, and with the persons' names replaced where they stand alone."""
    names = F.filter(F.arrays_zip("found", "made"), lambda x: entity_type(x["found"]) == "name")
    pairs = F.flatten(F.transform(names, lambda x: F.zip_with(F.split(x["found"], " "), F.split(x["made"], " "), lambda a, b: F.struct(a.alias("a"), b.alias("b")))))
    changed = F.array_distinct(F.filter(pairs, lambda x: x["a"] != x["b"]))
    rows = rows.withColumn("alone", F.when(F.exists("found", lambda e: entity_type(e) == "name"), changed))

    def piece(p: Column) -> Column:
        hit = F.filter(F.col("alone"), lambda x: x["a"] == p)
        return F.when(F.size(hit) > 0, hit[0]["b"]).otherwise(p)

    def gap(t: Column) -> Column:
        return F.array_join(F.transform(F.regexp_extract_all(t, F.lit(_PIECES), F.lit(0)), piece), "")

    plain = F.split(F.col("body"), ENTITY, -1)
    between = F.when(F.size("alone") > 0, F.transform(plain, gap)).otherwise(plain)
    whole = F.array_join(F.zip_with(between, F.concat(F.col("made"), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    text = F.when(F.size("found") > 0, whole).otherwise(F.col("body"))
    kinds = F.array_sort(F.array_distinct(F.transform("found", entity_type)))
    return rows.select(F.col("id").alias(id_col), text.alias("text"), F.size("found").alias("n_entities"), kinds.alias("entity_types"))


def _replaced_by_join(texts: DataFrame, redrawn: DataFrame, secret: str, id_col: str) -> DataFrame:
    """For very many exceptions: units are joined to them and gathered again by text."""
    first = _first_names(secret)
    rows = texts.withColumn("found", entities(F.coalesce("body", F.lit("")))).withColumn("digest", F.sha2(F.coalesce("body", F.lit("")), 256))
    parts = rows.where(F.size("found") > 0).select("digest", "key", F.posexplode("found").alias("at", "x")).select("digest", "key", "at", F.posexplode(_units(F.col("x"))).alias("place", "e")).distinct()
    own = F.when(F.array_contains(_titles(), F.col("e")), F.col("e")).otherwise(unit_surrogate(F.col("e"), F.col("key"), first))
    made = parts.join(redrawn, "e", "left").select("digest", "at", F.struct("place", F.coalesce("s", own).alias("s")).alias("x"))
    made = made.groupBy("digest", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), " ").alias("s"))
    made = made.groupBy("digest").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda x: x["s"]).alias("made"))
    return _assembled(rows.join(made, "digest", "left").withColumn("made", F.coalesce("made", F.array().cast("array<string>"))), id_col)
