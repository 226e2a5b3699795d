"""Personal data replaced by keyed surrogates, by DataFrame functions only.

Entities are found by one pattern of named kinds: e-mail addresses, IPv4 addresses, telephone and card
numbers, access keys, secrets in quotes or after a word such as password (of any length, dots inside and padding
included), and persons after a title, in capitals too. Each distinct entity gets a surrogate that
keeps its kind, script and format: digits become digits and letters letters of the same case and script, a
number keeps its separators and leading group, an address stays valid and keeps its part counts, a person's
given name is drawn from names of the same script and of the gender that the titles before it tell, of neither
where they tell none or both. A name found after a title is replaced wherever its document spells it alike.

Surrogates come from a secret key, which the caller gives or the session holds as ``spark.chartloom.surrogates.key``;
without either, one is drawn for this call alone, so that nobody can rebuild its mapping. A keyed SHA-256 of kind, canonical form and attempt feeds the characters.
An entity's canonical form drops case and separators, so all its spellings in all documents get the same
surrogate, written in each spelling's own format (coreference). Collision checks keep entities apart
(distinctness): attempts are made in rounds over the distinct entities, and a round's surrogate stands only
if it is no entity of the corpus, and the first by entity among those that drew it; the others try again.
After ``ROUNDS`` attempts the rest are dealt the unused spellings of their own format, in an order that the key
sets; who finds none left draws among longer ones (a digit or letter more, an address longer octets, a name more
syllables), by the same checks. So the mapping is one-to-one in any case.

Distinct entities are counted before any shuffle, so an entity that a third of all documents name is one row
to the checks. Mentions find their surrogates by a join of two plain exchanges, which
adaptive execution splits at a hot entity.

Edge cases: null and empty texts pass as they are. Null ids take part and stay null. Repeated rows are
replaced alike. An empty table gives an empty result. Texts are searched whole, in time that grows in
proportion to their length, also where they have no space: what may begin an address is tried once a run. Where
kinds tie, the first in ``KINDS`` has the mention; where entities draw the same surrogate, the first by canonical
form has it.
"""

from __future__ import annotations

import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, id_of, key_of, partitions

#: Attempts to draw a surrogate that is neither taken nor an entity before the unused ones are listed, and attempts at longer ones.
ROUNDS, LONGER = 4, 64
KEY_SETTING = "spark.chartloom.surrogates.key"

_MEN, _WOMEN = "Mr|Herr|Monsieur|Señor|Sr|Signor", "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Sra|Signora"
TITLE = rf"\b(?:{_MEN}|{_WOMEN}|Dr|Prof)\b\.?"
_GAP = r"[ \u00A0]"
_NAME = r"(?:\p{Lu}['’])?\p{Lu}(?:[\p{Lu}'’]+(?:-\p{Lu}+){0,3}(?!\p{L})|[\p{Ll}'’]+(?:\p{Lu}\p{Ll}+){0,3}(?:-\p{Lu}\p{Ll}+){0,3})"
#: What the part of an address before @ is made of; behind it stand 127 names at most, as in any address. A search begins where such a run does, or where the last mention ended.
_LOCAL = r"[\p{L}0-9._%+-]"
#: Kinds of entities in the order in which a place is tried; a mention is of the first kind that matches all of it.
KINDS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[\p{{L}}0-9-]+(?:\.[\p{{L}}0-9-]+){{0,125}}\.\p{{L}}{{2,}}",
    "access": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36}\b|\bsk-[A-Za-z0-9]{20,}\b",
    "secret": r"(?<=[\"'])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?=[\"'])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "social": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-]*\d)",
    "card": r"(?<![\d.-])\d{4}(?:[ -]?\d){9,15}(?![\d-])",
    "password": r"(?<=[=: \"'])(?=[A-Za-z0-9+/_.-]*\d)(?<=(?i:password|passwd|pwd|secret|token|api[_-]?key) {0,2}[=:] {0,2}[\"']?)[A-Za-z0-9+/_.-]{7,}[A-Za-z0-9+/_-]={0,2}",
    "person": rf"{TITLE}{_GAP}{_NAME}(?:{_GAP}{_NAME})?",
}
#: Patterns of mentions by themselves, where the kind's own looks around it.
ALONE = {"secret": r"[0-9a-f]{32,}|[0-9A-F]{32,}", "password": r"[A-Za-z0-9+/_.-]{7,}[A-Za-z0-9+/_-]={0,2}"}
#: After a word such as password the whole run goes, so an access key is tried after it, lest what follows the key stay.
PATTERN = "|".join(f"(?:{KINDS[k]})" for k in sorted(KINDS, key=lambda k: (k == "access", k == "person")))

#: Syllables of made-up names and their endings by gender, by script.
SYLLABLES = {
    "latin": ["ba", "bel", "cor", "da", "del", "fa", "gar", "ha", "il", "jo", "ka", "lan", "le", "mar", "mi", "na", "nor", "ol", "pa", "per", "ra", "ro", "sa", "sel", "ta", "tor", "ul", "va", "ver", "vi", "wen", "zo"],
    "cyrillic": ["ба", "бел", "вер", "ви", "га", "гор", "да", "дел", "жа", "за", "зор", "ил", "ка", "кор", "ла", "лен", "ма", "мир", "на", "нор", "ол", "па", "пер", "ра", "ро", "са", "сел", "та", "тор", "ул", "фа", "юл"],
    "greek": ["βα", "γε", "δα", "ζη", "θε", "κα", "κο", "λα", "λε", "μα", "με", "μι", "να", "νι", "ξε", "πα", "πε", "ρα", "ρι", "σα", "στα", "τα", "τι", "φι", "χα", "χρι", "ψα", "δω", "λου", "μο", "ρο", "σο"],
    "armenian": ["բա", "գա", "դա", "զա", "թե", "լի", "կա", "հա", "մա", "մի", "նա", "նո", "շա", "պե", "ռա", "սա", "սի", "վա", "վե", "տա", "տի", "րո", "րի", "գո", "դի", "լա", "կո", "հո", "մո", "շո", "պա", "տո"],
}
ENDINGS = {"latin": {"m": ["n", "s", "rd", "k"], "f": ["a", "ia", "na", "ella"], "n": ["e", "is", "y", "o"], "s": ["son", "er", "man", "well"]}, "cyrillic": {"m": ["н", "р", "м", "д"], "f": ["а", "ия", "на", "ина"], "n": ["ь", "о", "е", "и"], "s": ["ов", "ин", "ко", "енко"]}, "greek": {"m": ["ς", "ν", "ξ", "ρ"], "f": ["α", "η", "ια", "ινα"], "n": ["ι", "ο", "υ", "ε"], "s": ["κης", "δης", "που", "τος"]}, "armenian": {"m": ["ն", "կ", "մ", "ր"], "f": ["ա", "ի", "ինե", "ուհի"], "n": ["ո", "ե", "է", "ու"], "s": ["յան", "ունի", "ենց", "ոնց"]}}


LETTERS = {
    r"\p{IsGreek}": "αβγδεζηθικλμνξοπρστυφχψω", r"\p{IsArmenian}": "աբգդեզէթժիլխկհմնշոպռսվտր", r"\p{IsGeorgian}": "აბგდევზთიკლმნოპრსტუფქღშჩ", r"\p{IsHebrew}": "אבגדהוזחטיכלמנסעפצקרשת",
    r"\p{IsArabic}": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", r"\p{IsHiragana}": "あいうえおかきくけこさしすせそたちつてとなにぬねの", r"\p{IsKatakana}": "アイウエオカキクケコサシスセソタチツテトナニヌネノ",
    r"\p{IsHangul}": "가나다라마바사아자차카타파하고노도로모보소오", r"\p{IsHan}": "山川田中林木水火土石金玉日月天地人大小上下东西南北",
}
#: Letters and digits by the sort of character that they stand in for.
ALPHABETS = {"[0-9]": "0123456789", "[a-z]": "abcdefghijklmnopqrstuvwxyz", "[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"\p{IsCyrillic}": "абвгдежзиклмнопрстуфхцчшэюя", **LETTERS, r"\p{L}": "àâäçèéêëîïñóôöùúûü"}
HEXADECIMAL = "^(?:[0-9a-f]+|[0-9A-F]+)$"


def _matches(c: Column, pattern: str) -> Column:
    return F.regexp_like(c, F.lit(f"^(?:{pattern})$"))


def kind_of(mention: Column) -> Column:
    """The first kind whose pattern matches all of the mention."""
    alone = KINDS | ALONE
    return reduce(lambda out, k: out.when(_matches(mention, alone[k]), k), KINDS, F.when(F.lit(False), ""))


def parts_of(mention: Column, kind: Column) -> Column:
    """The mention as an array of (kind, canonical form, spelling, gender): a person is a title and one or two names."""

    def part(kind: Column, canonical: Column, spelling: Column, gender: Column | None = None) -> Column:
        return F.struct(kind.alias("kind"), canonical.alias("canonical"), spelling.alias("spelling"), (F.lit(None).cast("string") if gender is None else gender).alias("gender"))

    title = F.regexp_extract(mention, f"^({TITLE}{_GAP})", 1)
    rest = F.substring(mention, F.length(title) + 1, F.length(mention))
    names, gap = F.split(rest, _GAP), F.regexp_extract(rest, f"({_GAP})", 1)
    gender = F.when(F.regexp_like(title, F.lit(rf"^(?:{_MEN})\b")), "m").when(F.regexp_like(title, F.lit(rf"^(?:{_WOMEN})\b")), "f")
    script = lambda c: reduce(lambda out, s: out.when(F.regexp_like(c, F.lit(rf"\p{{Is{s.title()}}}")), s), list(SYLLABLES)[1:], F.when(F.lit(False), "")).otherwise("latin")
    named = lambda c, sort, gender=None: part(F.concat(F.lit(f"name-{sort}-"), script(c)), F.lower(c), c, gender)
    last = F.element_at(names, -1)
    titled = part(F.lit("title"), F.lit(""), title)
    person = F.when(F.size(names) > 1, F.array(titled, named(names[0], "g", gender), part(F.lit("title"), F.lit(""), gap), named(last, "s"))).otherwise(F.array(titled, named(last, "s")))
    canonical = F.when(kind.isin("phone", "card", "social", "iban"), F.lower(F.regexp_replace(mention, r"[^\p{L}0-9+]", ""))).when(kind == "email", F.lower(mention)).otherwise(mention)
    return F.when(kind == "person", person).otherwise(F.array(part(kind, canonical, mention)))


def stream(kind: Column, canonical: Column, attempt: Column, key: str) -> Column:
    """Keyed numbers from 0 to 255, 128 of them, or as many as the canonical form has characters."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, canonical, attempt.cast("string"))
    blocks = F.greatest(F.lit(4), F.ceil(F.length(canonical) / 32).cast("int"))
    hashes = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.sha2(F.concat(seed, F.lit("\x1f"), i.cast("string")), 256))
    return F.flatten(F.transform(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substr(h, 2 * i + 1, F.lit(2)), 16, 10).cast("int"))))


def leading(kind: Column, canonical: Column) -> Column:
    """How many of the first characters stay."""
    country = F.when(canonical.startswith("+1"), 2).when(canonical.startswith("+"), 3).otherwise(0)
    prefix = F.when(F.regexp_like(canonical, F.lit("^(?:AKIA|ASIA|gh.*)")), 4).when(canonical.startswith("sk-"), 3).otherwise(0)
    return F.when(kind == "phone", country).when(kind == "access", prefix).when(kind == "card", 1).when(kind == "iban", 2).otherwise(0)


def choices(kind: Column, canonical: Column) -> Column:
    """How many values ``draw`` can take at each place of a surrogate, names apart: 1 where a character stays."""
    octets = F.transform(F.split(canonical, r"\."), lambda c: F.when(F.length(c) == 1, 9).when(F.length(c) == 2, 90).otherwise(156))
    hexadecimal = kind.isin("secret", "password") & F.regexp_like(canonical, F.lit(HEXADECIMAL))
    top = F.when(kind == "email", F.length(F.regexp_extract(canonical, r"(\.[^.@]+)$", 1))).when((kind == "card") & (luhn(canonical) == 0), 1).otherwise(0)
    free = lambda i: (i >= leading(kind, canonical)) & (i < F.length(canonical) - top)
    many = lambda c: reduce(lambda out, sort: out.when(F.regexp_like(c, F.lit(sort)), len(ALPHABETS[sort])), ALPHABETS, F.when(hexadecimal & F.regexp_like(c, F.lit("[A-Fa-f]")), 6)).otherwise(1)
    return F.when(kind == "ip", octets).otherwise(F.transform(F.split(canonical, ""), lambda c, i: F.when(free(i), many(c)).otherwise(1)))


def longer(kind: Column, canonical: Column, by: int) -> Column:
    """The canonical form with ``by`` characters more, or longer octets; names grow with the attempt instead."""
    octets = F.array_join(F.transform(F.split(canonical, r"\."), lambda c: F.rpad(c, F.least(F.lit(3), F.length(c) + by), F.lit("0"))), ".")
    return F.when(kind.startswith("name-"), canonical).when(kind == "ip", octets).when(kind == "email", F.regexp_replace(canonical, "@", "a" * by + "@")).otherwise(F.concat(canonical, F.lit("0" * by)))


def draw(kind: Column, canonical: Column, attempt: Column, numbers: Column) -> Column:
    """The surrogate's canonical form; ``numbers`` is a column of its ``stream``."""
    at = lambda i: F.element_at(numbers, F.pmod(i, F.size(numbers)).cast("int") + 1)
    pick = lambda letters, i: F.substr(F.lit(letters), F.pmod(at(i), F.lit(len(letters))) + 1, F.lit(1))
    chars = F.split(canonical, "")

    def alike(c: Column, i: Column, hexadecimal: Column) -> Column:
        out = F.when(F.regexp_like(c, F.lit("[0-9]")), pick("0123456789", i)).when(hexadecimal, F.when(F.regexp_like(c, F.lit("[A-F]")), pick("ABCDEF", i)).otherwise(pick("abcdef", i)))
        return reduce(lambda out, sort: out.when(F.regexp_like(c, F.lit(sort)), pick(ALPHABETS[sort], i)), ALPHABETS, out).otherwise(c)

    def filled(keep: Column, hexadecimal: bool = False) -> Column:
        """As many characters of the same sorts; the first ``keep`` stay."""
        return F.array_join(F.transform(chars, lambda c, i: F.when(i < keep, c).otherwise(alike(c, i, F.lit(hexadecimal)))), "")

    # an address keeps what follows its last dot
    top = F.regexp_extract(canonical, r"(\.[^.@]+)$", 1)
    email = F.concat(F.substr(filled(F.lit(0)), F.lit(1), F.length(canonical) - F.length(top)), top)
    octet = lambda c, i: F.when(F.length(c) == 1, F.pmod(at(i), F.lit(9)) + 1).when(F.length(c) == 2, F.pmod(at(i), F.lit(90)) + 10).otherwise(F.pmod(at(i), F.lit(156)) + 100).cast("string")
    ip = F.array_join(F.transform(F.split(canonical, r"\."), octet), ".")
    card = filled(F.lit(1))
    card = F.when(luhn(canonical) == 0, _with_check(card)).otherwise(card)
    out = (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind.isin("phone", "access", "iban"), filled(leading(kind, canonical)))
        .when(kind == "card", card).when(kind.isin("secret", "password"), F.when(F.regexp_like(canonical, F.lit(HEXADECIMAL)), filled(F.lit(0), True)).otherwise(filled(F.lit(0))))
    )
    for script, syllables in SYLLABLES.items():
        for sort, endings in ENDINGS[script].items():
            body = F.transform(F.sequence(F.lit(0), 1 + attempt), lambda i: F.element_at(F.array(*map(F.lit, syllables)), F.pmod(at(i), F.lit(len(syllables))) + 1))  # noqa: B023
            ending = F.element_at(F.array(*map(F.lit, endings)), F.pmod(at(F.lit(100)), F.lit(len(endings))) + 1)
            out = out.when(kind == f"name-{sort}-{script}", F.concat(F.array_join(body, ""), ending))
    return out.otherwise(filled(F.lit(0)))


def luhn(digits: Column) -> Column:
    """The checksum of a card number, 0 for a valid one."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    terms = F.transform(values, lambda v, i: F.when(i % 2 == 0, v).when(v > 4, 2 * v - 9).otherwise(2 * v))
    return F.aggregate(terms, F.lit(0), lambda a, v: a + v) % 10


def _with_check(digits: Column) -> Column:
    body = F.substr(digits, F.lit(1), F.length(digits) - 1)
    return F.concat(body, F.pmod(-luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))


def render(spelling: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate written as the spelling is: its separators, and upper case where it has it."""
    chars = F.split(spelling, "")
    slot = r"[^\p{L}0-9+]"
    slotted = F.array_join(F.transform(chars, lambda c, i: F.when(F.regexp_like(c, F.lit(slot)), c).otherwise(F.substr(surrogate, F.length(F.regexp_replace(F.substr(spelling, F.lit(1), i + 1), slot, "")), F.lit(1)))), "")
    slotted = F.concat(slotted, F.substr(surrogate, F.length(F.regexp_replace(spelling, slot, "")) + 1, F.length(surrogate)))
    cased = lambda made: F.array_join(F.transform(F.split(made, ""), lambda c, i: F.when(F.regexp_like(F.get(chars, i), F.lit(r"\p{Lu}")), F.upper(c)).otherwise(c)), "")
    name = F.when(F.regexp_like(spelling, F.lit(r"^[\p{Lu}'’-]{2,}$")), F.upper(surrogate)).when(F.regexp_like(spelling, F.lit(r"^\p{Lu}")), F.concat(F.upper(F.substr(surrogate, F.lit(1), F.lit(1))), F.substr(surrogate, F.lit(2), F.length(surrogate)))).otherwise(surrogate)
    return F.when(kind.isin("phone", "card", "social", "iban"), cased(slotted)).when(kind == "email", cased(surrogate)).when(kind.startswith("name-"), name).otherwise(surrogate)


def _drawn(entities: DataFrame, attempt: int, key: str, by: int = 0) -> DataFrame:
    fed = entities.select("kind", "canonical", stream(F.col("kind"), F.col("canonical"), F.lit(attempt), key).alias("numbers"))
    like = longer(F.col("kind"), F.col("canonical"), by) if by else F.col("canonical")
    return fed.select("kind", "canonical", draw(F.col("kind"), like, F.lit(attempt), F.col("numbers")).alias("surrogate"))


def _dealt(left: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """The k-th unused surrogate of a format for the k-th entity left in it, as far as there are any.

    A format is the surrogate of all places' first values and how many values each has. Of its spellings as many
    are listed as are left and taken, so enough are unused unless the format runs out.
    """
    kind, canonical, sizes = F.col("kind"), F.col("canonical"), F.col("sizes")
    sized = left.where(~kind.startswith("name-")).withColumn("sizes", choices(kind, canonical))
    formed = sized.withColumn("zero", draw(kind, canonical, F.lit(0), F.transform(F.sequence(F.lit(0), F.size(sizes)), lambda i: F.lit(0))))
    form = ["kind", "zero", "sizes"]
    used = taken.groupBy("kind", F.length("surrogate").alias("n_chars")).agg(F.count("*").alias("used"))
    space = F.aggregate(sizes, F.lit(1).cast("long"), lambda a, n: F.least(a * n, F.lit(1 << 40)))
    forms = formed.groupBy(*form).agg(F.count("*").alias("n"), F.min("canonical").alias("canonical")).withColumn("n_chars", F.length("zero"))
    listed = forms.join(used, ["kind", "n_chars"], "left").withColumn("space", space)
    listed = listed.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.least("space", F.col("n") + F.coalesce("used", F.lit(0))) - 1)))
    places = F.aggregate(
        sizes, F.struct(F.pmod(F.col("at") * 1000003, F.col("space")).alias("rest"), F.array().cast("array<long>").alias("places")),
        lambda a, n: F.struct(((a["rest"] - a["rest"] % n) / n).cast("long").alias("rest"), F.concat(a["places"], F.array((a["rest"] % n).cast("long"))).alias("places")),
    )["places"]
    listed = listed.withColumn("places", places).withColumn("start", stream(kind, F.col("zero"), F.lit(-1), key))
    listed = listed.withColumn("numbers", F.transform("start", lambda x, i: (x + F.coalesce(F.get("places", i), F.lit(0))).cast("int")))
    unused = listed.select(*form, draw(kind, canonical, F.lit(0), F.col("numbers")).alias("surrogate")).distinct().join(taken, ["kind", "surrogate"], "left_anti")
    kth = lambda by: F.row_number().over(Window.partitionBy(*form).orderBy(F.sha2(F.concat_ws("\x1f", F.lit(key), by), 256), by))
    return formed.withColumn("k", kth("canonical")).join(unused.withColumn("k", kth("surrogate")), [*form, "k"]).select("kind", "canonical", "surrogate")


def _ungendered(kind: Column) -> Column:
    return F.regexp_replace(kind, "^name-[mfn]-", "name-g-")


def mapping(entities: DataFrame, scratch: Scratch, key: str, rounds: int = ROUNDS) -> DataFrame:
    """``(kind, canonical, surrogate)``, one-to-one within a kind, no surrogate an entity of that kind; given names of all genders are one kind."""
    done, left, step = None, entities, 0
    apart = _ungendered(F.col("kind")).alias("kind")
    taken = entities.select(apart, F.col("canonical").alias("surrogate"))

    def settle(drawn: DataFrame) -> bool:
        """Whether a surrogate stands: one that is not taken, for the first by entity among those that drew it."""
        nonlocal done, left, taken, step
        first = drawn.groupBy(apart, "surrogate").agg(F.min(F.struct("canonical", F.col("kind").alias("own"))).alias("first"))
        stands = scratch.put(first.join(taken, ["kind", "surrogate"], "left_anti").select(F.col("first.own").alias("kind"), "first.canonical", "surrogate"), f"round-{step}")
        done = stands if done is None else done.unionByName(stands)
        taken = taken.unionByName(stands.select(apart, "surrogate"))
        left = scratch.put(left.join(stands.select("kind", "canonical"), ["kind", "canonical"], "left_anti"), f"left-{step}")
        step += 1
        return not stands.isEmpty()

    dealt = lambda: left.repartition(partitions(left.sparkSession), "kind", "canonical")  # noqa: E731  few bytes, but much work
    for r in range(rounds):
        settle(_drawn(dealt(), r, key))
        if left.isEmpty():
            return done
    while settle(_dealt(left, taken, key)):  # formats may share spellings, so a pass can leave some
        pass
    for by in range(1, LONGER + 1):
        if left.isEmpty():
            return done
        settle(_drawn(dealt(), rounds + by - 1, key, by))
    if not left.isEmpty():
        raise ValueError("no surrogate is left for some entities")
    return done


def key_of_session(spark: SparkSession) -> str:
    """The session's key, or one for this time only."""
    return spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)


def replace(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str | None = None) -> DataFrame:
    """``(id, text, n_entities)`` of every row, entities replaced."""
    key = key or key_of_session(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "surrogates")
    th = F.xxhash64(F.coalesce(docs[text_col].cast("binary"), F.lit(b"")))
    rows = docs.select(key_of(docs, id_col).alias("id"), th.alias("th"), docs[text_col].cast("string").alias("text"))
    found = rows.select("id", "th", F.posexplode(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).alias("pos", "mention")).distinct()
    parted = found.select("id", "th", "pos", F.posexplode(parts_of(F.col("mention"), kind_of(F.col("mention")))).alias("nth", "part")).select("id", "th", "pos", "nth", "part.*")
    mentions = scratch.put(parted, "mentions")
    told = mentions.where("kind <> 'title'").groupBy("kind", "canonical").agg(F.min("gender").alias("a"), F.max("gender").alias("b"))
    gender = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("n")
    own = F.when(F.col("kind").startswith("name-g-"), F.concat(F.lit("name-"), gender, F.substr("kind", F.lit(7)))).otherwise(F.col("kind"))
    entities = scratch.put(told.select(own.alias("kind"), "canonical"), "entities")
    surrogates = scratch.put(mapping(entities, scratch, key), "mapping").withColumn("kind", _ungendered(F.col("kind")))
    # a hot entity's mentions are split by adaptive execution: both sides are plain exchanges
    joined = mentions.join(surrogates, ["kind", "canonical"], "left")
    written = F.when(F.col("kind") == "title", F.col("spelling")).otherwise(render(F.col("spelling"), F.col("kind"), F.col("surrogate")))
    of_doc = joined.groupBy("id", "th").agg(F.array_sort(F.collect_list(F.struct("pos", "nth", written.alias("written"), F.when(F.col("kind").startswith("name-"), F.col("spelling")).alias("name")))).alias("parts"))
    joined_rows = rows.join(of_doc, ["id", "th"], "left")
    # names found after a title go where the document says them without one, too; the longer ones are tried first
    names = F.array_distinct(F.transform(F.filter("parts", lambda p: p["name"].isNotNull()), lambda p: F.struct((-F.length(p["name"])).alias("n"), p["name"].alias("name"))))
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(F.transform(F.array_sort(names), lambda n: n["name"]), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    cut = joined_rows.withColumn("gaps", F.when(F.col("parts").isNotNull(), F.split("text", PATTERN, -1))).withColumn("names", F.when(F.size(names) > 0, pattern))
    name_of = lambda said: F.get(F.filter("parts", lambda p: p["name"] == said), F.lit(0))["written"]
    said = lambda g: F.regexp_extract_all(g, F.col("names"), F.lit(0))
    unnamed = lambda g: F.array_join(F.zip_with(F.split(g, F.col("names"), -1), said(g), lambda t, n: F.concat(t, F.coalesce(name_of(n), F.lit("")))), "")
    cut = cut.withColumn("untitled", F.when(F.col("names").isNotNull(), F.size(F.flatten(F.transform("gaps", said)))).otherwise(0))
    cut = cut.withColumn("gaps", F.when(F.col("names").isNotNull(), F.transform("gaps", unnamed)).otherwise(F.col("gaps")))
    within = lambda i: F.array_join(F.transform(F.filter("parts", lambda p: p["pos"] == i), lambda p: p["written"]), "")
    text = F.array_join(F.transform("gaps", lambda g, i: F.concat(g, within(i))), "")
    return cut.select(
        id_of().alias("id"),
        F.when(F.col("parts").isNull(), F.col("text")).otherwise(text).alias("text"),
        (F.coalesce(F.size(F.array_distinct(F.transform("parts", lambda p: p["pos"]))), F.lit(0)) + F.col("untitled")).cast("long").alias("n_entities"),
    )
