"""Surrogates for personal data: keyed, of the same type, and alike in gender, script and format.

An entity is (kind, canonical value), so every writing of a value in any document has one
surrogate. Surrogates are drawn from SHA-256 of a key, the entity and a number of tries.
A draw that another entity has, or that is itself an entity of the data, is drawn again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import Scratch

# Titles by gender; the name follows.
TITLES = {
    "m": ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "Sir", "господин", "Господин", "κύριος", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "Sra", "госпожа", "Госпожа", "κυρία", "Κυρία"],
    "n": ["Dr", "Prof", "Doctor", "Professor"],
}
# Given names by script and gender, and parts of family names by script.
GIVEN = {
    "latin": {"m": "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Luca Martin Nils Oscar Paul Robin Simon Tom Viktor".split(),
              "f": "Anna Berta Clara Diana Emma Frida Greta Hanna Irma Julia Karla Laura Maria Nora Olga Paula Rosa Sara Tina Vera".split()},
    "cyrillic": {"m": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Леонид Максим".split(),
                 "f": "Анна Белла Вера Галина Дарья Елена Ирина Ксения Лидия Мария".split()},
    "greek": {"m": "Άρης Βασίλης Γιώργος Δημήτρης Ηλίας Κώστας Λουκάς Μάριος Νίκος Πέτρος".split(),
              "f": "Άννα Βέρα Γεωργία Δήμητρα Ελένη Κατερίνα Λουκία Μαρία Νίκη Σοφία".split()},
}
FAMILY = {
    "latin": "bar ben cor dal den fal gar hol kal lan mar nor pel ran sal tor val wen zan mil".split(),
    "cyrillic": "бар вол дал кор лен мар нов пет рад сав тар вел".split(),
    "greek": "βαρ γαλ δελ καρ λαν μελ ναρ παλ σαρ τελ φαν χαρ".split(),
}
SCRIPT_LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
ALL_TITLES = [t for g in TITLES.values() for t in g]
NAME = r"\p{Lu}[\p{L}'-]*+"
TITLE = f"(?=[{''.join(sorted({t[0] for t in ALL_TITLES}))}])" + r"(?<![\p{L}\p{N}])(?:" + "|".join(ALL_TITLES) + ")"
#: Kinds in the order in which they are tried. Each first looks at one character, does not
#: start inside a longer run, and repeats possessively, so no text makes them slow.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "secret": r"(?<=[\"'])(?<=[=:] ?[\"'])[A-Za-z0-9_/+-]{16,512}+(?=[\"'])",
    "ip": r"(?=\d)(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)",
    "card": r"(?=\d)(?<![\d\p{L}])\d{4}(?:[ -]?\d{4}){3}(?![\d\p{L}])",
    "phone": r"(?=[+(])(?<![\d\p{L}+])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{2,4}(?:[ .-]\d{2,4}){1,3}|\(\d{3}\) ?\d{3}-\d{4})(?![\d\p{L}])",
    "ssn": r"(?=\d)(?<![\d\p{L}-])\d{3}-\d{2}-\d{4}(?![\d\p{L}-])",
    "iban": r"(?=[A-Z]{2}\d)(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "name": TITLE + r"\.? " + NAME + r"(?: " + NAME + r")?",
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: What every text with an entity has: a digit, an at sign, a quoted value or a title. Quick to look for.
HINT = r"[0-9@]|[=:] ?[\"']|" + TITLE
TRIES = 40


def luhn_ok(digits: Column) -> Column:
    """Whether the last digit of a string of digits is its Luhn check digit."""
    return F.pmod(_luhn_sum(digits, 0), F.lit(10)) == 0


def _luhn_sum(digits: Column, shift: int) -> Column:
    chars = F.split(F.reverse(digits), "")
    chars = F.filter(chars, lambda c: c != "")

    def weigh(c, i):
        d = c.cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((i + shift) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(chars, weigh), F.lit(0), lambda a, x: a + x)


def mentions_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def kind_of(mention: Column) -> Column:
    """Kinds by their own marks: what stands around a mention is not known here."""
    digits = F.regexp_replace(mention, r"\D", "")
    return (
        F.when(mention.contains("@"), "email")
        .when(mention.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(mention.rlike(r"^\d{4}([ -]?\d{4}){3}$"), F.when(luhn_ok(digits), "card").otherwise("number"))
        .when(mention.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(mention.rlike(r"^[+(][\d ().-]+$"), "phone")
        .when(mention.rlike(r"^[A-Z]{2}\d{2}( ?[A-Z0-9]{1,4})+$"), "iban")
        .when(mention.rlike(r"^(" + "|".join(ALL_TITLES) + r")\.? "), "name")
        .otherwise("secret")
    )


def gender_of(title: Column) -> Column:
    return F.when(title.isin(TITLES["m"]), "m").when(title.isin(TITLES["f"]), "f").otherwise("n")


def script_of(value: Column) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def parts_of(mention: Column, kind: Column) -> Column:
    """Entities of a mention: (kind, value) pairs. A name has its family name and maybe a given name."""
    pair = lambda k, v: F.struct(k.alias("kind"), v.alias("value"))
    value = (
        F.when(kind == "email", F.lower(mention))
        .when(kind.isin("card", "phone", "ssn", "number"), F.regexp_replace(mention, r"\D", ""))
        .when(kind == "iban", F.regexp_replace(mention, " ", ""))
        .otherwise(mention)
    )
    words = F.split(mention, " ")
    family, given = F.lower(F.element_at(words, -1)), F.lower(words[1])
    gender = gender_of(F.replace(words[0], F.lit("."), F.lit("")))
    named = F.when(F.size(words) > 2, F.array(pair(F.concat(F.lit("given_"), gender), given), pair(F.lit("family"), family))).otherwise(F.array(pair(F.lit("family"), family)))
    return F.when(kind == "name", named).otherwise(F.array(pair(kind, value)))


def _by_script(options: dict[str, list[str]]) -> Column:
    """The array of options of the script in column _script."""
    lists = {s: F.array(*[F.lit(o) for o in v]) for s, v in options.items()}
    script = F.col("_script")
    return F.when(script == "cyrillic", lists["cyrillic"]).when(script == "greek", lists["greek"]).otherwise(lists["latin"])


def _joined(options: Column, salt: int, n: Column, between: str = "") -> Column:
    """n options, each picked by the seed."""
    pick = lambda i: F.element_at(options, (F.pmod(F.xxhash64("_seed", F.lit(salt), i), F.size(options)) + 1).cast("int"))
    return F.array_join(F.transform(F.sequence(F.lit(1), n), pick), between)


def _redrawn(value: Column, seed: Column) -> Column:
    """Each character becomes another of its class: digit, letter of its script and case; marks stay. Hexadecimal stays so."""
    plain = value.rlike("^[0-9a-f]+$")

    def char(c, i):
        h = F.xxhash64(seed, i)
        letters = F.when(c.rlike(r"\p{IsCyrillic}"), SCRIPT_LETTERS["cyrillic"]).when(c.rlike(r"\p{IsGreek}"), SCRIPT_LETTERS["greek"]).when(plain, "abcdef").otherwise(SCRIPT_LETTERS["latin"])
        letter = F.substr(letters, (F.pmod(h, F.length(letters)) + 1).cast("int"), F.lit(1))
        return F.when(c.rlike(r"\p{N}"), F.pmod(h, F.lit(10)).cast("string")).when(c.rlike(r"\p{Lu}"), F.upper(letter)).when(c.rlike(r"\p{L}"), letter).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), char), "")


def drawn(entities: DataFrame, key: str) -> DataFrame:
    """Adds the surrogate of (kind, value) at a number of tries."""
    value, kind, new = F.col("value"), F.col("kind"), F.col("_new")
    rows = entities.select("kind", "value", "tries", script_of(value).alias("_script"), F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "value", F.col("tries").cast("string")), 256).alias("_seed"))
    rows = rows.withColumn("_new", _redrawn(value, F.col("_seed")))
    # card: same first digit, and the check digit is right again
    rows = rows.withColumn("_body", F.concat(F.substring(value, 1, 1), F.expr("substr(_new, 2, length(value) - 2)")))
    check = F.pmod(10 - F.pmod(_luhn_sum(F.col("_body"), 1), F.lit(10)), F.lit(10)).cast("string")
    # a domain has one surrogate for all addresses; its last label stays
    domain = F.expr("substr(value, instr(value, '@') + 1)")
    labels = _redrawn(F.regexp_extract(domain, r"^(.*)\.[^.]+$", 1), F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("domain"), domain), 256))
    # more parts as tries go on, so the supply of names and mailboxes never ends
    longer = F.floor(F.col("tries") / 3).cast("int")
    more = F.when(longer > 0, _joined(_by_script({s: list(v) for s, v in SCRIPT_LETTERS.items()}), 40, longer)).otherwise("")
    email = F.concat(F.expr("substr(_new, 1, instr(value, '@') - 1)"), more, F.lit("@"), labels, F.lit("."), F.regexp_extract(domain, r"([^.]+)$", 1))
    octet = lambda i, low, n: (F.pmod(F.xxhash64("_seed", F.lit(i)), F.lit(n)) + low).cast("string")
    either = {s: g["m"] + g["f"] for s, g in GIVEN.items()}
    given = lambda options: F.lower(_joined(_by_script(options), 20, longer + 1, "-"))
    return rows.select(
        "kind", "value", "tries",
        F.when(kind == "email", email)
        .when(kind == "ip", F.concat_ws(".", octet(1, 1, 223), octet(2, 0, 256), octet(3, 0, 256), octet(4, 1, 254)))
        .when(kind == "card", F.concat("_body", check))
        .when(kind == "phone", F.when(F.length(value) > 10, F.concat(F.expr("substr(value, 1, length(value) - 10)"), F.expr("substr(_new, length(value) - 9)"))).otherwise(new))
        .when(kind == "iban", F.concat(F.substring(value, 1, 2), F.expr("substr(_new, 3)")))
        .when(kind == "family", _joined(_by_script(FAMILY), 30, longer + 3))
        .when(kind == "given_m", given({s: g["m"] for s, g in GIVEN.items()}))
        .when(kind == "given_f", given({s: g["f"] for s, g in GIVEN.items()}))
        .when(kind == "given_n", given(either))
        .otherwise(new)
        .alias("surrogate"),
    )


def surrogates(entities: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(kind, value, surrogate) for distinct (kind, value): no surrogate twice in a kind, none that is a value of it.

    All draw; where several drew alike, the least value keeps it; who lost or drew a real
    value draws again against all that is settled. Numbers that are no cards stay as they are.
    """
    now = scratch.put(entities.where("kind <> 'number'").select("kind", "value", F.lit(0).alias("tries")), "draw-0")
    values = now.select("kind", F.col("value").alias("surrogate"))
    settled, i, stalled = None, 0, 0
    while True:
        tried = scratch.put(drawn(now, key), f"tried-{i}")
        taken = values if settled is None else values.union(settled.select("kind", "surrogate"))
        winners = tried.groupBy("kind", "surrogate").agg(F.min("value").alias("value")).join(taken, ["kind", "surrogate"], "left_anti")
        winners = scratch.put(winners.select("kind", "value", "surrogate"), f"won-{i}")
        settled = winners if settled is None else settled.union(winners)
        i += 1
        now = scratch.put(now.join(winners, ["kind", "value"], "left_anti").select("kind", "value", (F.col("tries") + 1).alias("tries")), f"draw-{i}")
        if now.isEmpty():
            return settled
        stalled = stalled + 1 if winners.isEmpty() else 0
        if stalled >= TRIES:  # a format of fixed length (phone, ssn) whose values are used up
            raise ValueError(f"no free surrogates in {TRIES} tries that settled nothing")


def _like(mention: Column, letters: Column) -> Column:
    """Case of a word: all capitals, first capital, or as drawn."""
    return F.when((F.upper(mention) == mention) & (F.length(mention) > 1), F.upper(letters)).when(F.substring(mention, 1, 1).rlike(r"\p{Lu}"), F.initcap(letters)).otherwise(letters)


def written(mention: Column, kind: Column, found: Column) -> Column:
    """The surrogate in the writing of the mention; found: surrogates of its parts in order."""
    chars = F.filter(F.split(mention, ""), lambda c: c != "")
    nth = lambda i: F.length(F.regexp_replace(F.substr(mention, F.lit(1), i + 1), r"\D", ""))
    digits = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(r"\d"), F.substr(found[0], nth(i), F.lit(1))).otherwise(c)), "")
    kept = lambda i: F.length(F.replace(F.substr(mention, F.lit(1), i + 1), F.lit(" "), F.lit("")))
    spaced = F.array_join(F.transform(chars, lambda c, i: F.when(c == " ", c).otherwise(F.substr(found[0], kept(i), F.lit(1)))), "")
    words = F.split(mention, " ")
    last = _like(F.element_at(words, -1), F.element_at(found, -1))
    named = F.when(F.size(words) > 2, F.concat_ws(" ", words[0], _like(words[1], found[0]), last)).otherwise(F.concat_ws(" ", words[0], last))
    return (
        F.when(kind == "number", mention)
        .when(kind.isin("card", "phone", "ssn"), digits)
        .when(kind == "iban", spaced)
        .when(kind == "name", named)
        .when((kind == "email") & (F.upper(mention) == mention), F.upper(found[0]))
        .otherwise(found[0])
    )


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with surrogates in ``text`` and an integer ``_n_entities``; other columns pass through.

    Kinds: e-mail, IPv4, card (Luhn), phone, social security number, IBAN, quoted secrets and
    names after a title. Null and empty texts stay; texts without any hint of an entity (no
    digit, at sign, quoted value or title) stay where they are, without a shuffle. A surrogate depends on the key and on the entities of the whole
    table (by the collision check), never on the order of rows. Repeated rows get equal
    texts; an empty table stays empty. Columns of any name pass but those that begin with
    ``_pii``; a document without doc_id is treated like any other.

    Texts with entities meet the surrogates by a join on the entity: one that is in a third
    of all documents is a skewed join key, which Spark splits. What is gathered per document
    is bounded by its own text.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    hint = F.coalesce(F.col(text), F.lit("")).rlike(HINT)
    plain = docs.where(~hint).withColumn("_n_entities", F.lit(0))
    hit = docs.where(hint).withColumn("_pii_key", F.sha2(F.col(text), 256))

    said = docs.where(hint).select(F.sha2(F.col(text), 256).alias("_pii_key"), F.posexplode(mentions_of(F.col(text))).alias("_at", "mention"))
    said = said.withColumn("_kind", kind_of(F.col("mention"))).withColumn("e", parts_of(F.col("mention"), F.col("_kind")))
    said = said.select("_pii_key", "_at", "mention", "_kind", F.posexplode("e").alias("_part", "e")).select("_pii_key", "_at", "_part", "mention", "_kind", "e.*")
    said = scratch.put(said.distinct(), "mentions")  # copies of a text count once
    found = surrogates(said.select("kind", "value").distinct(), key, scratch)
    mapped = said.join(found, ["kind", "value"], "left").select("_pii_key", "_at", "_part", "mention", "_kind", "surrogate")
    per = mapped.groupBy("_pii_key", "_at", "mention", "_kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("_part", "surrogate"))), lambda s: s["surrogate"]).alias("found"))
    per = per.select("_pii_key", "_at", written(F.col("mention"), F.col("_kind"), F.col("found")).alias("new"), (F.col("found")[0].isNotNull()).alias("real"))
    new = per.groupBy("_pii_key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "new"))), lambda s: s["new"]).alias("_pii_new"),
        F.sum(F.col("real").cast("int")).cast("int").alias("_n_entities"),
    )
    hit = hit.join(new, "_pii_key", "left")
    gaps = F.split(F.col(text), ANY)
    whole = F.array_join(F.flatten(F.zip_with(gaps, "_pii_new", lambda g, n: F.array(g, F.coalesce(n, F.lit(""))))), "")
    whole = F.when(F.col("_pii_new").isNull(), F.col(text)).otherwise(whole)
    columns = [whole.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return hit.select(*columns, F.coalesce("_n_entities", F.lit(0)).alias("_n_entities")).unionByName(plain)
