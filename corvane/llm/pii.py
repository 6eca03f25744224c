"""Personal data replaced by surrogates, with DataFrame operations only.

One pattern finds e-mail and IP addresses, card, phone, social security and bank account numbers,
secrets and titled person names. Every distinct entity (by type and canonical form, so that
`4111 1111 1111 1111` and `4111111111111111` are one) gets a surrogate drawn from a keyed hash:
digits for digits, letters for letters of their case, card numbers keep whether their check digit
is right, names keep gender, script and number of words, addresses keep their form and share a
domain where the originals did. Surrogates are checked over the whole table: none may stand for
two entities or equal an entity of the table; colliding ones are drawn again, and domains stay
distinct. All mentions of an entity, in any document, then carry the same surrogate in their own
format.

A person is a name and a gender. A title without gender (`Dr`) takes that of the titles which the
name has elsewhere in the table, if they agree. Where a document names somebody with a title and two
words or more, the same name without a title is that person too. A family name alone is a person
of its own (`Mr Smith`), found with a title only.

A secret is a run of 16 or more of its characters after a keyword (`token`, `password`, `bearer` and
so on; = or : between them may be missing, so a long word in `key responsibilities` counts too), or
has a known beginning (`sk-`, `ghp_` and so on). A domain has at most 127 labels of 63 characters.

Documents with an entity are written once, with a number each, so that their mentions can be joined
back evenly; mentions of one entity are dealt over parts. Null texts stay null, empty ones empty;
texts of any length count as a whole; repeated rows are replaced alike; an empty table gives no
rows; extra columns (of types that Parquet holds) are kept by `replace_in_documents` whatever their names.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, written

#: How entities look.
TITLES_M = ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Signor", "Г-н", "Господин")
TITLES_F = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "Г-жа", "Госпожа")
TITLES_N = ("Dr", "Prof", "Mx")
GIVEN = {
    ("M", "Latn"): ("Adrian", "Bruno", "Caspar", "Damian", "Edgar", "Felix", "Gregor", "Hugo", "Ivo", "Jasper", "Konrad", "Linus", "Marius", "Nestor", "Oscar", "Pascal"),
    ("F", "Latn"): ("Alma", "Bettina", "Clara", "Dora", "Elena", "Flora", "Greta", "Helena", "Irma", "Julia", "Karla", "Livia", "Marta", "Nora", "Olivia", "Paula"),
    ("N", "Latn"): ("Ariel", "Billie", "Charlie", "Dominique", "Eden", "Frankie", "Gale", "Harper", "Indigo", "Jules", "Kim", "Lee", "Morgan", "Noa", "Phoenix", "Quinn"),
    ("M", "Cyrl"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Игорь", "Кирилл", "Лев", "Максим", "Назар", "Олег", "Павел", "Роман", "Семён"),
    ("F", "Cyrl"): ("Анна", "Белла", "Вера", "Галина", "Дарья", "Ева", "Жанна", "Зоя", "Инна", "Кира", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса"),
    ("N", "Cyrl"): ("Саша", "Женя", "Валя", "Шура", "Слава", "Тоня", "Юля", "Ася", "Витя", "Галя", "Дина", "Рада", "Лёня", "Миша", "Никита", "Паша"),
}
FAMILY_HEADS = {"Latn": ("Ash", "Bram", "Cald", "Dorn", "Els", "Fair", "Glen", "Hart", "Ing", "Kess", "Lang", "Mor", "Nor", "Oster", "Pem", "Rav"), "Cyrl": ("Арз", "Бел", "Вор", "Гор", "Дан", "Ерм", "Жар", "Зим", "Кор", "Лад", "Мор", "Нов", "Орл", "Пет", "Рог", "Сад")}
FAMILY_TAILS = {"Latn": ("berg", "brook", "by", "dale", "field", "ford", "gate", "holm", "hurst", "land", "ley", "more", "stead", "ton", "well", "wick"), "Cyrl": ("аев", "анов", "арин", "енко", "ецкий", "илов", "инов", "ский", "иков", "овский", "онов", "ухин", "ушин", "ычев", "ягин", "яков")}

WORD = r"\p{L}\p{N}_"
_TITLE = "(?:" + "|".join(sorted({*TITLES_M, *TITLES_F, *TITLES_N}, key=len, reverse=True)) + r")\b\.?"
_NAME = r"\p{Lu}[\p{L}’'-]+"
_KEYWORD = "(?i:token|secret|key|password|passwd|pwd|bearer)"
_KNOWN = r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,})"
SECRET = rf"(?=[A-Za-z0-9_/+=-]{{16}})(?<={_KEYWORD}[\"']?\s{{0,3}}[=:]?\s{{0,3}}[\"']?)[A-Za-z0-9_/+=-]{{16,}}|{_KNOWN}"
_LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,61}[\p{L}\p{N}])?"
EMAIL = rf"[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_.+-]{{0,63}}+@{_LABEL}(?:\.{_LABEL}){{1,126}}"
IP = r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}_]|\.\d)"
CARD = r"\d(?:[ -]?\d){12,18}(?![\p{L}\p{N}_])"
PHONE = r"\+\d{1,3}(?:[ .-]?\(\d{1,5}\))?(?:[ .-]?\d{2,5}){2,5}(?![\p{L}\p{N}_])|\(\d{2,5}\) ?\d{3,4}[ .-]\d{3,4}(?![\p{L}\p{N}_])|\d{3}[.-]\d{3}[.-]\d{4}(?![\p{L}\p{N}_])"
SSN = r"\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}_-])"
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}_])"
PERSON = rf"(?=[{''.join(sorted({t[0] for t in (*TITLES_M, *TITLES_F, *TITLES_N)}))}]){_TITLE}[  ]{_NAME}(?:[  ]{_NAME})?"
PATTERN = rf"(?<![{WORD}])(?:{SECRET}|{EMAIL}|{IP}|{IBAN}|{CARD}|{SSN}|{PHONE}|{PERSON})"

#: What every text with an entity has; much cheaper to look for than the entities.
MAYBE = rf"[0-9@=:]|{_KEYWORD}[\"']?\s{{0,6}}[\"']?[A-Za-z0-9_/+=-]{{16}}|{_KNOWN}|{PERSON}"

#: Parts that the mentions of one entity are dealt over at most.
DEALT = 1024
DIGITAL = ("CARD", "PHONE", "SSN")


def entities(text: Column) -> Column:
    """The entities of a text in order, names without a title left out."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


_TITLED = rf"^{_TITLE}[  ]"


def full_names(found: Column) -> Column:
    """Names of two words that a text has with a title, longest first."""
    names = F.transform(F.filter(found, lambda e: e.rlike(rf"{_TITLED}{_NAME}[  ]{_NAME}$")), lambda e: F.regexp_replace(e, _TITLED, ""))
    return F.array_sort(F.array_distinct(names), lambda a, b: F.length(b) - F.length(a))


def pattern_with(names: Column) -> Column:
    """The pattern of entities and of these names without a title."""
    either = F.array_join(F.transform(names, lambda n: F.concat(F.lit(r"\Q"), n, F.lit(r"\E"))), "|")
    return F.when(F.size(names) > 0, F.concat(F.lit(rf"{PATTERN}|(?<![{WORD}])(?:"), either, F.lit(rf")(?![{WORD}]|[{WORD}.+-]{{0,64}}@)"))).otherwise(F.lit(PATTERN))


def entity_type(e: Column) -> Column:
    return (
        F.when(e.contains("@"), "EMAIL")
        .when(e.rlike(f"^(?:{IP})$"), "IP")
        .when(e.rlike(f"^(?:{SSN})$"), "SSN")
        .when(e.rlike(f"^(?:{PHONE})$") & ~e.rlike(r"^\d{13,19}$"), "PHONE")
        .when(e.rlike(f"^(?:{CARD})$"), "CARD")
        .when(e.rlike(f"^(?:{PERSON})$"), "PERSON")
        .when(e.rlike(f"^(?:{IBAN})$"), "IBAN")
        .otherwise("SECRET")
    )


def gender_of(e: Column) -> Column:
    """M, F or N by the title that a mention begins with."""
    bare = F.regexp_replace(F.regexp_extract(e, rf"^({_TITLE})", 1), r"\.$", "")
    return F.when(bare.isin(*TITLES_M), "M").when(bare.isin(*TITLES_F), "F").otherwise("N")


def canonical(kind: Column, e: Column) -> Column:
    """What equal entities have in common; of a person the name."""
    name = F.lower(F.regexp_replace(F.regexp_replace(e, _TITLED, ""), r" ", " "))
    return (
        F.when(kind.isin(*DIGITAL), F.concat(F.when(e.startswith("+"), "+").otherwise(""), F.regexp_replace(e, r"[^0-9]", "")))
        .when(kind == "EMAIL", F.lower(e))
        .when(kind == "IBAN", F.regexp_replace(e, " ", ""))
        .when(kind == "PERSON", name)
        .otherwise(e)
    )


def _stream(seed: Column, blocks: int = 4) -> Column:
    """Hex digits that follow from a seed."""
    return F.concat(*(F.sha2(F.concat(F.lit(f"{k}|"), seed), 256) for k in range(blocks)))


def _refilled(s: Column, stream: Column) -> Column:
    """Digits for digits, letters for letters of the same case, other characters as they are."""
    at = lambda i: (i * 2) % 254 + 1

    def one(c: Column, i: Column) -> Column:
        v = F.conv(F.substr(stream, at(i), F.lit(2)), 16, 10).cast("int")
        return (
            F.when(c.between("0", "9"), (v % 10).cast("string"))
            .when(c.between("a", "z"), F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), v % 26 + 1, F.lit(1)))
            .when(c.between("A", "Z"), F.substr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), v % 26 + 1, F.lit(1)))
            .when(c.rlike(r"\p{IsCyrillic}"), F.substr(F.lit("абвгдежзиклмнопрстуфхцчшэюя"), v % 27 + 1, F.lit(1)))
            .when(c.rlike(r"\p{L}"), F.substr(F.lit("àáâäçèéêëìíîïñòóôöùúûü"), v % 22 + 1, F.lit(1)))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(s, ""), one), "")


def luhn_sum(digits: Column) -> Column:
    """The sum that is a multiple of 10 for card numbers."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: c.try_cast("int") * (i % 2 + 1))
    return F.aggregate(each, F.lit(0), lambda a, v: a + v - F.when(v > 9, 9).otherwise(0))


def _pick(values: tuple[str, ...], stream: Column, k: int) -> Column:
    v = F.conv(F.substring(stream, 2 * k + 1, 2), 16, 10).cast("int")
    return F.element_at(F.array(*(F.lit(x) for x in values)), v % len(values) + 1)


def host_of(domain: Column, key: str, seed: int) -> Column:
    """The first part of a domain's surrogate."""
    hexed = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), F.lit(str(seed)), domain), 256)
    return F.substring(F.translate(hexed, "0123456789", "ghijklmnop"), 1, 20)


def drawn(table: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """kind, canon and attempt with sur, the surrogate's canonical form, of which `rendered` makes each mention."""
    table = table.withColumn("stream", _stream(F.concat_ws("|", F.lit(key), "kind", "canon", F.col("attempt").cast("string"))))
    table = table.withColumn("refill", _refilled(F.col("canon"), F.col("stream")))
    return table.withColumn("sur", _surrogate(key, seed)).drop("stream", "refill")


def _surrogate(key: str, seed: int) -> Column:
    kind, canon, attempt, stream, refill = (F.col(c) for c in ("kind", "canon", "attempt", "stream", "refill"))

    body = F.substr(refill, F.lit(1), F.length(canon) - 1)
    check = (10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    wrong = luhn_sum(canon) % 10 != 0
    card = F.concat(body, F.when(wrong, (check + 1 + F.conv(F.substring(stream, 250, 2), 16, 10).cast("int") % 9) % 10).otherwise(check).cast("string"))

    country = F.regexp_extract(canon, r"^\+1|^\+\d\d", 0)
    phone = F.concat(country, F.substr(refill, F.length(country) + 1, F.length(canon)))

    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    longer = F.when(attempt > 0, F.substring(F.translate(stream, "0123456789", "ghijklmnop"), 3, 2)).otherwise("")
    longer = F.concat(longer, F.when(attempt > 2, F.substring(F.translate(stream, "0123456789", "ghijklmnop"), 7, 12)).otherwise(""))
    labels = F.size(F.split(domain, r"\."))
    local_new = F.substr(refill, F.lit(1), F.length(local))
    email = F.concat(local_new, longer, F.lit("@"), host_of(domain, key, seed), F.when(labels > 2, ".mail").otherwise(""), F.lit(".example"))

    octet = lambda k: (F.conv(F.substring(stream, 4 * k + 1, 4), 16, 10).cast("int") % 254 + 1).cast("string")
    ip = F.concat_ws(".", *(octet(k) for k in range(4)))

    iban = F.concat(F.substring(canon, 1, 2), F.substr(refill, F.lit(3), F.length(canon)))
    hexed = F.array_join(F.transform(F.split(canon, ""), lambda c, i: F.substr(stream, (i * 3) % 254 + 1, F.lit(1))), "")
    secret = F.when(canon.rlike("^[0-9a-f]+$"), hexed).otherwise(refill)

    gender, name = F.substring_index(canon, "|", 1), F.substring_index(canon, "|", -1)
    words = F.size(F.split(name, " "))
    script = F.when(name.rlike(r"\p{IsCyrillic}"), "Cyrl").otherwise("Latn")
    given, family = F.lit(None).cast("string"), F.lit(None).cast("string")
    for (g, s), values in GIVEN.items():
        given = F.when((gender == g) & (script == s), _pick(values, stream, 1)).otherwise(given)
    for s in FAMILY_HEADS:
        one = lambda k, s=s: F.concat(_pick(FAMILY_HEADS[s], stream, k), _pick(FAMILY_TAILS[s], stream, k + 1))
        whole = F.concat_ws("-", one(2), F.when(attempt > 0, one(4)), F.when(attempt > 2, one(6)), F.when(attempt > 6, one(8)))
        family = F.when(script == s, whole).otherwise(family)
    # Russian family names follow the gender.
    feminine = F.regexp_replace(F.regexp_replace(family, "(ов|ев|ин|ын)(?=-|$)", "$1а"), "ий(?=-|$)", "ая")
    family = F.when((gender == "F") & (script == "Cyrl"), feminine).otherwise(family)
    person = F.when(words > 1, F.concat_ws(" ", given, family)).otherwise(family)

    return (
        F.when(kind == "CARD", card).when(kind == "PHONE", phone).when(kind == "EMAIL", email).when(kind == "IP", ip)
        .when(kind == "IBAN", iban).when(kind == "PERSON", person).when(kind == "SSN", refill).otherwise(secret)
    )


def rendered(kind: Column, mention: Column, sur: Column) -> Column:
    """A surrogate in the format of a mention."""
    digits = F.regexp_replace(sur, r"[^0-9]", "")

    def fill(source: Column, pattern: str) -> Column:
        chars = F.split(source, "")
        place = F.transform(chars, lambda c, i: F.length(F.regexp_replace(F.substr(source, F.lit(1), i + 1), pattern, "")))
        return F.array_join(F.zip_with(chars, place, lambda c, k: F.when(c.rlike(pattern), c).otherwise(F.substr(F.when(kind == "IBAN", sur).otherwise(digits), k, F.lit(1)))), "")

    title = F.regexp_extract(mention, rf"^({_TITLE}[  ])", 1)
    name = F.substr(mention, F.length(title) + 1, F.length(mention))
    return (
        F.when(kind.isin(*DIGITAL), fill(mention, "[^0-9]"))
        .when(kind == "IBAN", fill(mention, "[^A-Z0-9]"))
        .when(kind == "PERSON", F.concat(title, F.when(name == F.upper(name), F.upper(sur)).otherwise(sur)))
        .when((kind == "EMAIL") & (mention == F.upper(mention)), F.upper(sur))
        .otherwise(sur)
    )


def _compared(kind: Column, sur: Column) -> Column:
    """What must differ from other surrogates and from entities: names do in any case and whatever the gender."""
    return F.when(kind == "PERSON", F.lower(sur)).otherwise(sur)


def surrogate_table(distinct: DataFrame, key: str, *, seed: int = 0, most_attempts: int = 40) -> DataFrame:
    """kind, canon, sur: injective, and no surrogate is an entity of the table."""
    table = written(drawn(distinct.select("kind", "canon", F.lit(0).alias("attempt")), key, seed), "surrogates")
    for _ in range(most_attempts):
        own = table.withColumn("shown", _compared(F.col("kind"), F.col("sur")))
        shared = own.groupBy("kind", "shown").agg(F.count("*").alias("n"), F.min("canon").alias("keeper")).filter(F.col("n") > 1)
        twice = own.join(shared, ["kind", "shown"]).filter(F.col("canon") != F.col("keeper")).select("kind", "canon")
        known = table.select("kind", F.when(F.col("kind") == "PERSON", F.substring_index("canon", "|", -1)).otherwise(F.col("canon")).alias("shown"))
        again = twice.unionByName(own.join(known, ["kind", "shown"], "left_semi").select("kind", "canon")).distinct()
        if again.isEmpty():
            return table.select("kind", "canon", "sur")
        last, marked = table, table.join(again.withColumn("again", F.lit(1)), ["kind", "canon"], "left")
        redrawn = drawn(marked.filter(F.col("again") == 1).select("kind", "canon", (F.col("attempt") + 1).alias("attempt")), key, seed)
        table = written(marked.filter(F.col("again").isNull()).select("kind", "canon", "attempt", "sur").unionByName(redrawn), "surrogates")
        dropped(last)
    raise RuntimeError(f"surrogates still collide after {most_attempts} attempts")


def domain_seed(domains: DataFrame, key: str, *, most_attempts: int = 40) -> int:
    """A seed that gives each of these domains a host of its own which none of them has."""
    for seed in range(most_attempts):
        hosts = domains.select("domain", host_of(F.col("domain"), key, seed).alias("host"))
        twice = hosts.groupBy("host").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("host")
        known = domains.select(F.explode(F.split("domain", r"\.")).alias("host"))
        if twice.unionByName(hosts.join(known, "host", "left_semi").select("host")).isEmpty():
            return seed
    raise RuntimeError(f"domains still collide after {most_attempts} attempts")


def mention_table(mentions: DataFrame, key: str) -> DataFrame:
    """Of distinct mentions (e): kind, the mention with its surrogate (s), and a person's name alone with its (name_s)."""
    one = mentions.withColumn("kind", entity_type(F.col("e")))
    one = written(one.withColumn("canon", canonical(F.col("kind"), F.col("e"))), "entities")
    people = one.filter(F.col("kind") == "PERSON").withColumn("gender", gender_of(F.col("e")))
    titles = people.groupBy("canon").agg(F.bool_or(F.col("gender") == "M").alias("m"), F.bool_or(F.col("gender") == "F").alias("f"))
    known = F.when(F.col("gender") != "N", F.col("gender")).when(F.col("m") & ~F.col("f"), "M").when(F.col("f") & ~F.col("m"), "F").otherwise("N")
    people = people.join(titles, "canon").select("e", "kind", F.concat_ws("|", known, "canon").alias("canon"))
    named = one.filter(F.col("kind") != "PERSON").unionByName(people)
    domains = one.filter(F.col("kind") == "EMAIL").select(F.substring_index("canon", "@", -1).alias("domain")).distinct()
    table = surrogate_table(named.select("kind", "canon").distinct(), key, seed=domain_seed(domains, key))
    out = named.join(table, ["kind", "canon"]).select("e", "kind", rendered(F.col("kind"), F.col("e"), F.col("sur")).alias("s"))
    return out.withColumn("name_s", F.when(F.col("kind") == "PERSON", F.regexp_replace("s", _TITLED, "")))


def replace_in_documents(docs: DataFrame, *, key: str, report: bool = False) -> DataFrame:
    """The documents, all their columns, with surrogates in text; with report, n_entities and entity_types too.

    Whoever knows the key can tell which surrogate an entity gets, so it should be kept secret.
    """
    if not key:
        raise ValueError("surrogates need a key")
    columns = docs.columns

    def own(name: str) -> str:
        """A column name that the documents don't have."""
        while name.lower() in {c.lower() for c in columns}:
            name = f"_{name}"
        return name

    row, names, items, types = own("pii_row"), own("pii_names"), own("pii_items"), own("pii_types")
    found = F.col("text").rlike(MAYBE) & F.col("text").rlike(PATTERN)
    # Documents with an entity, each with a number; items: the mentions in order, a bare name by its titled mention.
    some = docs.filter(found).withColumn(items, entities(F.col("text"))).withColumn(names, full_names(F.col(items)))
    titled = lambda e: F.element_at(F.filter(items, lambda x: x.endswith(e) & (F.regexp_replace(x, _TITLED, "") == e) & (x != e)), 1)
    bare = lambda e: F.array_contains(names, e)
    every = F.transform(F.regexp_extract_all("text", pattern_with(F.col(names)), F.lit(0)), lambda e: F.struct(F.when(bare(e), titled(e)).otherwise(e).alias("e"), bare(e).alias("bare")))
    plain = F.transform(items, lambda e: F.struct(e.alias("e"), F.lit(False).alias("bare")))
    some = some.withColumn(items, F.when(F.size(names) > 0, every).otherwise(plain)).withColumn(row, F.monotonically_increasing_id())
    some = written(some, "documents-with-entities")

    mentions = some.select(F.col(row).alias("row"), F.posexplode(items).alias("pos", "item")).select("row", "pos", "item.e", "item.bare", F.pmod("row", F.lit(DEALT)).alias("part"))
    table = mention_table(mentions.select("e").distinct(), key)
    # An entity may be in a third of all documents: its row goes to the parts that mention it.
    dealt = mentions.select("e", "part").distinct().join(table, "e")
    solved = mentions.join(dealt, ["e", "part"]).select("row", "pos", F.when(F.col("bare"), F.col("name_s")).otherwise(F.col("s")).alias("s"), "kind")
    by_row = solved.groupBy(F.col("row").alias(row)).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias(own("pii_new")), F.sort_array(F.collect_set("kind")).alias(types))
    between = F.split(F.col("text"), pattern_with(F.col(names)), -1)
    joined = F.array_join(F.zip_with(between, own("pii_new"), lambda a, s: F.concat(a, F.coalesce(s, F.lit("")))), "")
    extra = [F.size(items).cast("bigint").alias("n_entities"), F.col(types).alias("entity_types")] if report else []
    changed = some.join(by_row, row).select(*(joined.alias(c) if c == "text" else F.col(c) for c in columns), *extra)
    extra = [F.lit(0).cast("bigint").alias("n_entities"), F.array().cast("array<string>").alias("entity_types")] if report else []
    return docs.filter(F.coalesce(~found, F.lit(True))).select(*columns, *extra).unionByName(changed)


def session_key(spark: SparkSession) -> str:
    """The key that `spark.corvane.pii.key` holds, or else one drawn for this call."""
    return spark.conf.get("spark.corvane.pii.key", None) or secrets.token_hex(32)
