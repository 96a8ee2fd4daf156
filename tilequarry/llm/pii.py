"""PII surrogates: detected entities get keyed replacements of their kind; built-in functions only.

Kinds: email, ip, iban, ssn, card, phone, and name (after an honorific). An entity's normal form (lower case; digits and
letters only for numbers; a name without its honorific) decides its surrogate, so that mentions in different formats corefer
after the change as before. Surrogates keep the kind's shape: letters become letters and digits digits, signs and
spacing stay as in each mention, phone numbers of more than ten digits keep the first, card numbers pass the Luhn check and
IBANs the check modulo 97, addresses lie in reserved blocks (240.0.0.0/4, example.com), names take a given name of the
honorific's gender (else the given name's, where GIVEN lists it) and the script of the name.

Surrogates come from SHA-256 over a key. A collision check over the corpus's different entities gives each its own: one
whose surrogate another entity has (the first by normal form keeps it), or that is itself an entity of the corpus, is
drawn again until none is left. Names have as many surrogates as they need; of the other kinds there are as many as their
format allows (10^8 of a social security number, 2^28 addresses), and more different entities than that raise an error. Only entities are shuffled for that; texts are moved once, to meet their replacements.

Defined results: null and empty texts stay; texts without entities stay as they are; rows with one doc_id and one text
are changed alike; null doc_ids are ids like others; an empty table gives an empty one; columns of the input are kept,
whatever their names (but entities__ and kinds__, which give way). Texts are read whole, of any length; a regular expression
holds no state that grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilequarry.llm.common import Scratch, cut, documents, fresh

KEY = "surrogate-key-1"
MAX_ROUNDS = 30
#: Syllables of a made-up family name, at most; there are four at the first attempt.
MAX_SYLLABLES = 20

#: Honorifics by gender.
HONORIFICS = {"m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н", "κ."), "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа", "κα"), "n": ("Mx", "Dr", "Prof")}
#: Given names by script and gender.
GIVEN = {
    ("latin", "m"): "Adam Boris Carl Daniel Edgar Felix Georg Henri Ivan Julian Karim Leon Marco Noel Oscar Pablo Quentin Ruben Simon Tomas",
    ("latin", "f"): "Ada Beatriz Carla Diana Elsa Fiona Greta Helena Irina Julia Karin Laura Marta Nora Olivia Paula Rosa Sofia Teresa Vera",
    ("latin", "n"): "Alex Ariel Chris Dominique Elia Jamie Kim Lou Maxime Nikita Robin Sam Sascha Toni Yael",
    ("cyrillic", "m"): "Андрей Борис Виктор Глеб Денис Егор Иван Кирилл Лев Марк",
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Лидия Мария",
    ("cyrillic", "n"): "Женя Саша Валя Слава Шура",
    ("greek", "m"): "Άρης Γιάννης Δήμος Ηλίας Κώστας Λάμπρος Μάρκος Νίκος",
    ("greek", "f"): "Άννα Βέρα Δήμητρα Ελένη Ζωή Ιρις Κατερίνα Μαρία",
    ("greek", "n"): "Αλέξης Φοίβη Χρύσα",
}
#: Syllables of made-up family names.
SYLLABLES = {
    "latin": "ba den fel gor han jus kal lim mer nov ost pel ran sol tar ulm vin wes yor zan",
    "cyrillic": "бал дин гор лев мар нов пол ров сам тов бер вик зор кан лис",
    "greek": "βαλ δην γορ λεβ μαρ νοβ πολ ροδ σαμ τορ",
}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_TITLES = "|".join(sorted((h.replace(".", r"\.") for own in HONORIFICS.values() for h in own), key=lambda h: (-len(h), h)))
ENTITY = "|".join(
    (
        # No unbounded group is repeated in any of these: the engine would go a level deeper for each turn.
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?![.])[A-Za-z0-9.-]*[A-Za-z0-9-]\.[A-Za-z]{2,}",
        rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
        r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        r"(?<![A-Za-z0-9-])\d{3}-\d{2}-\d{4}(?![A-Za-z0-9-])",
        r"(?<![A-Za-z0-9])(?:\d{4}[ -]){3}\d{1,7}(?![A-Za-z0-9])",
        r"(?<![A-Za-z0-9])\d{13,19}(?![A-Za-z0-9])",
        r"(?<![A-Za-z0-9+])(?:\+?\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![A-Za-z0-9])",
        r"(?<![A-Za-z0-9+])\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,5}(?![A-Za-z0-9])",
        rf"(?<!\p{{L}})(?:{_TITLES})\.? \p{{Lu}}[\p{{L}}'’-]+(?: \p{{Lu}}[\p{{L}}'’-]+){{0,2}}",
    )
)


def _split(words: str) -> Column:
    return F.array(*[F.lit(w) for w in words.split()])


def kind_of(raw: Column) -> Column:
    return (
        F.when(raw.contains("@"), "email").when(raw.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip").when(raw.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .when(raw.rlike(r"^\p{L}"), "name").when(raw.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(raw.rlike(r"^(\d{4}[ -]){3}\d{1,7}$|^\d{13,19}$"), "card").otherwise("phone")
    )


def normal_form(raw: Column, kind: Column) -> Column:
    bare = F.lower(F.regexp_replace(raw, rf"^(?:{_TITLES})\.? ", ""))
    return F.when(kind.isin("email", "ip"), F.lower(raw)).when(kind == "name", bare).otherwise(F.upper(F.regexp_replace(raw, r"[^A-Za-z0-9]", "")))


def gender_of(raw: Column) -> Column:
    """The honorific's gender, else that of a given name that GIVEN lists, else n."""
    given = F.lower(F.substring_index(F.regexp_replace(raw, rf"^(?:{_TITLES})\.? ", ""), " ", 1))
    out = F.lit("n")
    for gender in ("m", "f"):
        listed = [n.lower() for (_, g), names in GIVEN.items() if g == gender for n in names.split()]
        out = F.when(given.isin(listed), gender).otherwise(out)
    for gender in ("m", "f"):
        names = "|".join(sorted((h.replace(".", r"\.") for h in HONORIFICS[gender]), key=lambda h: (-len(h), h)))
        out = F.when(raw.rlike(rf"^(?:{names})\.? "), gender).otherwise(out)
    return out


def script_of(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), "cyrillic").when(text.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _number(digest: Column, at, digits: int = 4) -> Column:
    """A number below 16^digits from `digits` hex digits of a digest, from place `at` (0 first) on."""
    return F.conv(F.substr(digest, F.lit(at) + 1 if isinstance(at, int) else at + 1, F.lit(digits)), 16, 10).cast("int")


def _same_shape(text: Column, digest: Column) -> Column:
    """Each letter a-z or A-Z and digit another one by the digest; other characters stay."""

    def one(c: Column, i: Column) -> Column:
        n = _number(digest, F.pmod(i * 3, F.lit(126)), 3)
        pick = lambda alphabet: F.substr(F.lit(alphabet), F.pmod(n, F.lit(len(alphabet))) + 1, F.lit(1))
        return F.when(c.rlike("[0-9]"), pick("0123456789")).when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(body: Column) -> Column:
    """body and its check digit."""
    digits = F.reverse(F.split(body, ""))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    total = F.aggregate(doubled, F.lit(0), lambda acc, x: acc + x)
    return F.concat(body, F.pmod(-total, F.lit(10)).cast("string"))


def _iban(country: Column, body: Column) -> Column:
    """Country, check digits (the whole number, moved and spelled out, is 1 modulo 97) and body."""
    letters = F.split(F.concat(body, country, F.lit("00")), "")

    def one(acc: Column, c: Column) -> Column:
        return F.pmod(F.when(c.rlike("[0-9]"), acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55), F.lit(97))

    rest = F.aggregate(letters, F.lit(0), one)
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), body)


def surrogate(kind: Column, norm: Column, gender: Column, attempt: Column, key: str) -> Column:
    """The surrogate's normal form."""
    seed = F.concat_ws("|", F.lit(key), kind, norm, attempt.cast("string"))
    digest = F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("|2")), 256))
    # As a variable the digest is made once, not for each character.
    return F.get(F.transform(F.array(digest), lambda d: _drawn(kind, norm, gender, attempt, d)), F.lit(0))


def _drawn(kind: Column, norm: Column, gender: Column, attempt: Column, digest: Column) -> Column:
    shaped = _same_shape(norm, digest)
    octet = lambda at: _number(digest, at, 2).cast("string")
    names = F.lit(None).cast("string")
    for script, syllables in SYLLABLES.items():
        parts = _split(syllables)
        # A syllable more with each attempt: there is no number of names that the surrogates don't suffice for.
        at = lambda k: F.element_at(parts, F.pmod(_number(digest, 8 + 4 * k), F.size(parts)) + 1)  # noqa: E731, B023
        family = F.concat(*[at(k) if k < 4 else F.when(attempt > k - 4, at(k)).otherwise(F.lit("")) for k in range(MAX_SYLLABLES)])
        for g in ("m", "f", "n"):
            given = _split(GIVEN[script, g].lower())
            own = F.element_at(given, F.pmod(_number(digest, 0), F.size(given)) + 1)
            full = F.when(F.size(F.split(norm, " ")) > 1, F.concat_ws(" ", own, family)).otherwise(family)
            names = F.when((script_of(norm) == script) & (gender == g), full).otherwise(names)
    local = F.substring_index(norm, "@", 1)
    return (
        F.when(kind == "email", F.concat(_same_shape(local, digest), F.lit("@"), _same_shape(F.lit("aaaaaaaa"), F.reverse(digest)), F.lit(".example.com")))
        .when(kind == "ip", F.concat_ws(".", (240 + F.pmod(_number(digest, 0, 2), F.lit(16))).cast("string"), octet(2), octet(4), octet(6)))
        .when(kind == "ssn", F.concat(F.lit("9"), F.substr(shaped, F.lit(2))))
        .when(kind == "card", _luhn(F.concat(F.substr(norm, F.lit(1), F.lit(1)), F.substr(shaped, F.lit(2), F.length(norm) - 2))))
        .when(kind == "iban", _iban(F.substr(norm, F.lit(1), F.lit(2)), F.substr(shaped, F.lit(5))))
        .when(kind == "name", names)
        .otherwise(F.when(F.length(norm) > 10, F.concat(F.substr(norm, F.lit(1), F.lit(1)), F.substr(shaped, F.lit(2)))).otherwise(shaped))
    )


def render(raw: Column, kind: Column, new: Column) -> Column:
    """A surrogate in the format of a mention: signs, spacing and honorific as there."""
    poured = F.aggregate(
        F.split(raw, ""),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("used")),
        lambda acc, c: F.struct(
            F.concat(acc["out"], F.when(c.rlike("[A-Za-z0-9]"), F.when(c.rlike("[a-z]"), F.lower(F.substr(new, acc["used"] + 1, F.lit(1)))).otherwise(F.substr(new, acc["used"] + 1, F.lit(1)))).otherwise(c)).alias("out"),
            (acc["used"] + F.when(c.rlike("[A-Za-z0-9]"), 1).otherwise(0)).alias("used"),
        ),
        lambda acc: acc["out"],
    )
    title = F.regexp_extract(raw, rf"^((?:{_TITLES})\.? )", 1)
    bare = F.substr(raw, F.length(title) + 1)
    named = F.concat(title, F.when((bare == F.upper(bare)) & (F.length(bare) > 2), F.upper(new)).otherwise(F.initcap(new)))
    email = F.when(raw == F.upper(raw), F.upper(new)).otherwise(new)
    return F.when(kind == "email", email).when(kind == "ip", new).when(kind == "name", named).otherwise(poured)


def _possible(text: Column) -> Column:
    """Whether a text has what every entity has: a digit, an at sign or an honorific. Texts without are not searched."""
    out = text.rlike("[0-9@]")
    for title in sorted({h for own in HONORIFICS.values() for h in own}):
        out = out | text.contains(title)
    return out


def assign(entities: DataFrame, *, key: str = KEY) -> DataFrame:
    """kind, norm, surrogate from kind, norm and gender: each entity its own, none that is an entity itself."""
    table = entities.groupBy("kind", "norm").agg(F.min("gender").alias("low"), F.max("gender").alias("high"))
    # A name with one gender among its mentions has it; honorifics without a gender don't count.
    table = table.join(entities.where("gender <> 'n'").groupBy("kind", "norm").agg(F.min("gender").alias("g1"), F.max("gender").alias("g2")), ["kind", "norm"], "left")
    table = table.select("kind", "norm", F.when(F.col("g1") == F.col("g2"), F.col("g1")).otherwise(F.lit("n")).alias("gender"), F.lit(0).alias("attempt"))
    with Scratch(entities.sparkSession) as scratch:
        real = scratch.cut(table, "entities")
        now = real
        for _ in range(MAX_ROUNDS):
            drawn = now.withColumn("surrogate", surrogate(F.col("kind"), F.col("norm"), F.col("gender"), F.col("attempt"), key))
            rank = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("norm"))
            taken = real.select("kind", F.col("norm").alias("surrogate"), F.lit(True).alias("taken"))
            judged = drawn.withColumn("rank", rank).join(taken, ["kind", "surrogate"], "left")
            judged, where = cut(judged.withColumn("again", (F.col("rank") > 1) | F.coalesce("taken", F.lit(False))), "surrogates")
            if not judged.where("again").limit(1).count():
                return judged.select("kind", "norm", "surrogate")
            scratch.made.append((judged, where))
            now = judged.select("kind", "norm", "gender", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))
    raise RuntimeError(f"some entities found no surrogate of their own in {MAX_ROUNDS} rounds")


def pseudonymise(docs: DataFrame, *, key: str = KEY) -> DataFrame:
    """docs with entities in text replaced; and entities__, the number of them, and kinds__, their kinds in order."""
    no, tie = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text")
    mentions = docs.where(_possible(F.col("text"))).select(no.alias("no"), tie.alias("tie"), F.posexplode(F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))).alias("pos", "raw")).distinct()
    kind = kind_of(F.col("raw"))
    mentions = mentions.withColumn("kind", kind).withColumn("norm", normal_form(F.col("raw"), F.col("kind")))
    mentions, _ = cut(mentions.withColumn("gender", F.when(F.col("kind") == "name", gender_of(F.col("raw"))).otherwise(F.lit("n"))), "mentions")
    named = assign(mentions.select("kind", "norm", "gender"), key=key)
    formats = mentions.select("kind", "norm", "raw").distinct().join(named, ["kind", "norm"]).select("raw", "kind", render(F.col("raw"), F.col("kind"), F.col("surrogate")).alias("new"))
    formats, _ = cut(formats, "formats")
    placed = mentions.select("no", "tie", "pos", "raw").join(formats, "raw")
    docs = docs.drop("entities__", "kinds__")
    no_, tie_, new_, kinds_ = fresh(docs, "no__", "tie__", "new__", "kinds_of__")
    by_text = placed.groupBy("no", "tie").agg(F.array_sort(F.collect_list(F.struct("pos", "new", "kind"))).alias("own")).select(F.col("no").alias(no_), F.col("tie").alias(tie_), F.col("own.new").alias(new_), F.col("own.kind").alias(kinds_))
    joined = docs.join(by_text, (no == F.col(no_)) & (tie == F.col(tie_)), "left")
    # Between the entities stand one piece more than there are entities.
    pieces = F.split("text", ENTITY, -1)
    rebuilt = F.array_join(F.zip_with(pieces, F.concat(new_, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    text = F.when(F.col(new_).isNull(), F.col("text")).otherwise(rebuilt)
    n, kinds = F.when(F.col(new_).isNull(), F.lit(0)).otherwise(F.size(new_)).cast("long"), F.coalesce(F.col(kinds_), F.array().cast("array<string>"))
    return joined.withColumns({"text": text, "entities__": n, "kinds__": kinds}).select(*docs.columns, "entities__", "kinds__")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = pseudonymise(documents(spark, sf_dir).select("doc_id", "text"))
    return changed.select("doc_id", F.greatest("entities__", F.lit(0)).alias("n_entities"), F.array_join("kinds__", ",").alias("kinds"), "text")
