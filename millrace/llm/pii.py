"""Surrogates for personal data, with DataFrame functions only.

One pattern finds e-mail addresses, secrets, network addresses, card and phone numbers and names in whole
texts.  Equal entities of the corpus, written in whatever format, are one row of an entity table and get one
surrogate, drawn by a keyed digest: digits for digits and letters for letters of the same case and script,
the same number of them, card numbers with the same check, names of the same gender and script.  A surrogate
that another entity has, or that is itself an entity of the corpus, is drawn again until all differ; names,
secrets, e-mail and phone numbers grow with the attempts, so their room has no end.  Each
mention is then written in its own format, so coreference and distinctness survive.  Where a text has named a
person in full, the parts of the name alone are replaced in the rest of that text as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import cut, fresh

#: Secret of the keyed digests; a parameter of every call.
KEY = "millrace"
ROUNDS = 30

_TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа", "Госпожа", "Κυρία"),
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Г-н", "Господин", "Κύριος"),
    "n": ("Dr", "Prof"),
}
#: Given names that mark a full name, and the stems and endings that surrogate names are made of, by gender and script.
_GIVEN = {
    "f": ("Mary", "Emily", "Sarah", "Laura", "Julia", "Maria", "Sophie", "Claire", "Hannah", "Carmen", "Мария", "Анна", "Ольга", "Елена", "Μαρία", "Ελένη"),
    "m": ("John", "James", "Robert", "Michael", "David", "Thomas", "Peter", "Hans", "Pierre", "Carlos", "Иван", "Сергей", "Дмитрий", "Алексей", "Γιώργος", "Νίκος"),
}
_STEMS = {
    "latin": ("Mar", "Lor", "Val", "Cor", "Fel", "Ros", "Tam", "Dor", "Bel", "Nor", "Sel", "Ver", "Cal", "Ser", "Mon", "Gal", "Hel", "Jul", "Kar", "Lin", "Or", "Pal", "Ren", "Sil", "Tor", "Ul", "Vin", "Wil", "Yor", "Zel"),
    "cyrillic": ("Мар", "Лар", "Вал", "Кар", "Фел", "Роз", "Там", "Дар", "Бел", "Нор", "Сел", "Вер", "Кол", "Сер", "Мон", "Гал"),
    "greek": ("Μαρ", "Λορ", "Βαλ", "Κορ", "Φελ", "Ροζ", "Ταμ", "Δωρ", "Μπελ", "Νορ", "Σελ", "Βερ", "Καλ", "Σερ", "Μον", "Γαλ"),
}
_MIDDLES = {
    "latin": ("", "an", "en", "in", "on", "el", "il", "ar", "er", "is", "ad", "ev", "im", "ol", "ur", "et"),
    "cyrillic": ("", "ан", "ен", "ин", "он", "ел", "ил", "ар", "ер", "ис", "ад", "ев", "им", "ол", "ур", "ет"),
    "greek": ("", "αν", "εν", "ιν", "ον", "ελ", "ιλ", "αρ", "ερ", "ισ", "αδ", "εβ", "ιμ", "ολ", "ουρ", "ετ"),
}
_ENDINGS = {
    "given_f": {"latin": ("a", "ia", "ine", "elle"), "cyrillic": ("а", "ия", "ина", "ела"), "greek": ("α", "ία", "ίνα", "έλα")},
    "given_m": {"latin": ("o", "us", "ard", "ric"), "cyrillic": ("ий", "ор", "ан", "ей"), "greek": ("ος", "ης", "ας", "ων")},
    "given_n": {"latin": ("y", "is", "en", "el"), "cyrillic": ("я", "ша", "ся", "ля"), "greek": ("ι", "υ", "εν", "ις")},
    "surname": {"latin": ("son", "ley", "mann", "ford"), "cyrillic": ("енко", "ук", "ских", "ко"), "greek": ("ίδης", "άκης", "όπουλος", "έλης")},
}
_NAME = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
_ALL_TITLES = "|".join(t for group in _TITLES.values() for t in group)
_ALL_GIVEN = "|".join(n for group in _GIVEN.values() for n in group)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"

#: Country codes of one and two digits; all others have three.
_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
_COUNTRY = rf"^\+(?:{_CODES.replace(' ', '|')}|\d{{1,3}})"

_CARD = r"\d{13,19}|\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3}|\d{4}[ \-]\d{6}[ \-]\d{5}"

#: Kinds in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![\w.%+\-])[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "access_key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "secret": r"""(?<=password=|passwd=|secret=|token=|api_key=)[^\s"']+|(?<=token = "|secret = "|password = "|api_key = ")[^"\n]+(?=")""",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "phone": r"(?<![\d+])\+\d{1,3}[ .\-]?\(?\d{1,4}\)?(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[\-.]\d{4}(?!\d)|(?<![\d\-])\d{3}[\-.]\d{3}[\-.]\d{4}(?![\d\-])",
    "card": rf"(?<![\d.])(?:{_CARD})(?!\d)",
    "name": rf"(?<!\p{{L}})(?:(?:{_ALL_TITLES})\.? {_NAME}(?: {_NAME}){{0,2}}|(?:{_ALL_GIVEN})(?: {_NAME}){{1,2}})(?!\p{{L}})",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())


def kind_of(surface: Column) -> Column:
    """The kind of a mention; secrets are what no other form fits, and "number" is no entity: digits that fail the check of cards."""
    out = F.when(surface.rlike("^" + PATTERNS["email"].split(")", 1)[1] + "$"), "email")
    for kind, form in (("access_key", "AKIA[0-9A-Z]{16}"), ("ip", rf"(?:{_OCTET}\.){{3}}{_OCTET}"), ("phone", r"\+[\d ().\-]+|\(\d{3}\) ?\d{3}[\-.]\d{4}|\d{3}[\-.]\d{3}[\-.]\d{4}"), ("card", _CARD), ("name", rf"(?:(?:{_ALL_TITLES})\.? |(?:{_ALL_GIVEN}) ){_NAME}(?: {_NAME})*")):
        out = out.when(surface.rlike(f"^(?:{form})$"), kind)
    out = out.otherwise("secret")
    return F.when((out == "card") & (_luhn(F.regexp_replace(surface, r"\D", "")) != 0), "number").otherwise(out)


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def mentions(docs: DataFrame, row_id: str, text: str) -> DataFrame:
    """(doc_id, text_key, place, part, surface, kind, canon, real): every mention in every text; a name's words are parts of their own.

    Only card numbers whose check is right are entities; other runs of digits are not ``real`` and stay.
    """
    body = F.col(f"`{text}`")
    found = docs.select(F.col(f"`{row_id}`").alias("doc_id"), F.xxhash64(body).alias("text_key"), F.regexp_extract_all(body, F.lit(PATTERN), F.lit(0)).alias("all"))
    found = found.where(F.size("all") > 0).select("doc_id", "text_key", F.posexplode("all").alias("place", "mention")).withColumn("form", kind_of(F.col("mention")))
    words = F.when(F.col("form") == "name", F.split("mention", " ")).otherwise(F.array("mention"))
    found = found.withColumn("words", words).select("*", F.posexplode("words").alias("part", "surface"))
    first, size = F.regexp_replace(F.element_at("words", 1), r"\.$", ""), F.size("words")
    titled = first.isin(*[t for g in _TITLES.values() for t in g])
    gender = F.when(first.isin(*_TITLES["f"], *_GIVEN["f"]), "f").when(first.isin(*_TITLES["m"], *_GIVEN["m"]), "m").otherwise("n")
    role = F.when(titled & (F.col("part") == 0), "title").when(F.col("part") == size - 1, F.concat(F.lit("surname_"), _script(F.col("surface")))).otherwise(F.concat(F.lit("given_"), gender, F.lit("_"), _script(F.col("surface"))))
    kind = F.when(F.col("form") == "name", role).when(F.col("form") == "number", "title").otherwise(F.col("form"))
    digits = F.regexp_replace("surface", r"\D", "")
    plus = F.when((F.col("form") == "phone") & F.col("surface").startswith("+"), "+").otherwise("")
    canon = F.when(F.col("form").isin("phone", "card"), F.concat(plus, digits)).when(F.col("form") == "email", F.lower("surface")).when(F.col("form") == "name", F.lower("surface")).otherwise(F.col("surface"))
    return found.withColumn("kind", kind).withColumn("canon", canon).select("doc_id", "text_key", "place", "part", "surface", "kind", "canon", (F.col("form") != "number").alias("real"))


def _one_gender(found: DataFrame) -> DataFrame:
    """Given names that only titles without gender stand before take the gender that the corpus has for them, if it is one."""
    known = found.where(F.col("kind").rlike("^given_[fm]_")).groupBy("canon").agg(F.min("kind").alias("low"), F.max("kind").alias("known")).where("low = known").drop("low")
    held = found.join(known, "canon", "left")
    return held.withColumn("kind", F.when(F.col("kind").startswith("given_n_"), F.coalesce("known", "kind")).otherwise(F.col("kind"))).drop("known")


def _space(kind: Column) -> Column:
    """Where surrogates must differ: all parts of names share one space, each other kind has its own."""
    return F.when(kind.rlike("^(given|surname)_"), "name").otherwise(kind)


def _stream(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """512 hexadecimal digits that only the key, kind, value and attempt determine."""
    return F.concat(*[F.sha2(F.concat_ws("\x1f", F.lit(key), kind, value, attempt.cast("string"), F.lit(str(k))), 256) for k in range(8)])


def _byte(stream: Column, k: Column | int) -> Column:
    return F.conv(F.substring(stream, 2 * k + 1, 2) if isinstance(k, int) else stream.substr(2 * (k % 256) + 1, F.lit(2)), 16, 10).cast("int")


def _drawn(value: Column, stream: Column) -> Column:
    """``value`` with every digit and letter drawn anew, in case and script; a value of hexadecimal digits stays one.

    A value without any digit or letter of these alphabets becomes small letters and digits, as many.
    """
    alphabets = (("[0-9]", "0123456789"), ("[a-z]", "abcdefghijklmnopqrstuvwxyz"), ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("[а-я]", "абвгдежзиклмнопрстуфхцчшэюя"), ("[А-Я]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"), ("[α-ω]", "αβγδεζηθικλμνξοπρστυφχψω"), ("[Α-Ω]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"))
    plain = "abcdefghijklmnopqrstuvwxyz0123456789"
    undrawable = ~value.rlike("|".join(form for form, _ in alphabets))
    hexadecimal = value.rlike(r"^(?=.*[a-f])(?=.*\d)[0-9a-f]{8,}$")

    def one(c: Column, k: Column) -> Column:
        b = _byte(stream, k)
        out = F.when(hexadecimal, F.substring(F.lit("0123456789abcdef"), 1, 16).substr(b % 16 + 1, F.lit(1))).when(undrawable, F.lit(plain).substr(b % len(plain) + 1, F.lit(1)))
        for form, letters in alphabets:
            out = out.when(c.rlike(form), F.lit(letters).substr(b % len(letters) + 1, F.lit(1)))
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The sum of a number's check modulo 10; 0 for valid card numbers."""
    n = F.length(digits)
    values = F.transform(F.split(digits, ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    each = F.transform(values, lambda d, k: F.when((n - k) % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The surrogate of an entity at an attempt, in canonical form; from attempt 3 on it is longer than the entity where its format allows."""
    stream = _stream(key, kind, canon, attempt)
    longer = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string"), F.lit("longer")), 256).substr(F.lit(1), F.greatest(attempt - 2, F.lit(0)))
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    host = F.regexp_replace(domain, r"\.[^.]*$", "")
    email = F.concat(_drawn(local, stream), longer, F.lit("@"), _drawn(host, _stream(key, F.lit("domain"), domain, F.lit(0))), F.lit("."), F.substring_index(domain, ".", -1))
    drawn = _drawn(canon, stream)
    body = F.concat(canon.substr(1, 1), drawn.substr(F.lit(2), F.length(canon) - 2))
    check = (_luhn(canon) - _luhn(F.concat(body, F.lit("0"))) + 10) % 10
    card = F.concat(body, check.cast("string"))
    code = F.greatest(F.length(F.regexp_extract(canon, _COUNTRY, 0)), F.lit(1))  # a country's code stays, else the first digit
    phone = F.concat(canon.substr(F.lit(1), code), drawn.substr(code + 1, F.length(canon)), F.translate(longer, "abcdef", "012345"))
    ip = F.concat_ws(".", *[(_byte(stream, k) % 254 + 1).cast("string") for k in range(4)])
    out = F.when(kind == "email", email).when(kind == "card", card).when(kind == "phone", phone).when(kind == "ip", ip).when(kind == "access_key", F.concat(F.lit("AKIA"), drawn.substr(F.lit(5), F.lit(16))))

    def pick(words: tuple[str, ...], at: int) -> Column:
        return F.element_at(F.array(*[F.lit(w) for w in words]), _byte(stream, at) % len(words) + 1)

    for role, endings in _ENDINGS.items():
        for script, words in endings.items():
            middles = F.array(*[F.lit(w) for w in _MIDDLES[script]])
            # a further middle for each further attempt
            rest = F.array_join(F.transform(F.split(longer, ""), lambda c: F.element_at(middles, F.conv(c, 16, 10).cast("int") % len(_MIDDLES[script]) + 1)), "")
            more = F.when(attempt > 2, F.concat(pick(_MIDDLES[script], 2), rest)).when(attempt > 1, pick(_MIDDLES[script], 2)).otherwise("")
            name = F.lower(F.concat(pick(_STEMS[script], 0), pick(_MIDDLES[script], 1), more, pick(words, 3)))
            second = F.lower(F.concat(pick(_STEMS[script], 4), pick(_MIDDLES[script], 5), pick(words, 6)))
            out = out.when(kind == f"{role}_{script}", F.when(canon.contains("-"), F.concat_ws("-", name, second)).otherwise(name))
    return out.otherwise(F.concat(drawn, longer))


def surrogates(entities: DataFrame, key: str = KEY, rounds: int = ROUNDS) -> DataFrame:
    """(kind, canon, surrogate) of distinct entities (kind, canon): all surrogates of a kind, and all of names, differ, from each other and from all entities.

    Each round draws again for the entities that lost a surrogate to another one or hit an entity; the
    rest stay as they are.
    """
    found = cut(entities.withColumn("attempt", F.lit(0)).withColumn("surrogate", surrogate(key, F.col("kind"), F.col("canon"), F.col("attempt"))), "pii-surrogates")
    real = found.select(_space(F.col("kind")).alias("space"), F.col("canon").alias("surrogate"), F.lit(True).alias("taken")).distinct()
    mark = F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "canon"), 256)
    for _ in range(rounds):
        spaced = found.withColumn("space", _space(F.col("kind")))
        owner = spaced.groupBy("space", "surrogate").agg(F.min(mark).alias("owner"))
        judged = spaced.join(owner, ["space", "surrogate"]).join(real, ["space", "surrogate"], "left")
        again = F.col("taken").isNotNull() | (mark != F.col("owner"))
        judged = cut(judged.select("kind", "canon", "attempt", "surrogate", again.alias("again")), "pii-judged")
        if judged.where("again").isEmpty():
            return found.select("kind", "canon", "surrogate")
        attempt = F.col("attempt") + F.col("again").cast("int")
        drawn = F.when(F.col("again"), surrogate(key, F.col("kind"), F.col("canon"), attempt)).otherwise(F.col("surrogate"))
        found = cut(judged.select("kind", "canon", attempt.alias("attempt"), drawn.alias("surrogate")), "pii-surrogates")
    raise ValueError("entities are left without a surrogate of their own; raise rounds")


def _cased(surface: Column, value: Column) -> Column:
    """``value`` with capitals where ``surface`` has them."""
    held = F.array(F.split(surface, ""))
    one = lambda c, k: F.when(F.try_element_at(held[0], k + 1).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)
    return F.array_join(F.transform(F.split(value, ""), one), "")


def _written(surface: Column, kind: Column, value: Column) -> Column:
    """A surrogate in the format of the mention: its separators, or its capitals."""
    gaps, digits = F.split(surface, r"\d", -1), F.concat(F.split(F.ltrim(value, F.lit("+")), ""), F.array(F.lit("")))
    numbers = F.array_join(F.zip_with(gaps, digits, lambda g, d: F.concat(F.coalesce(g, F.lit("")), F.coalesce(d, F.lit("")))), "")
    capital = F.array_join(F.transform(F.split(value, "-"), lambda w: F.concat(F.upper(w.substr(1, 1)), w.substr(F.lit(2), F.length(w)))), "-")
    part = lambda c, k: F.substring_index(c, "@", k)
    mail = F.when(surface == F.lower(surface), value).when(surface == F.upper(surface), F.upper(value)).otherwise(F.concat(_cased(part(surface, 1), part(value, 1)), F.lit("@"), _cased(part(surface, -1), part(value, -1))))
    return F.when(kind == "title", surface).when(kind.isin("phone", "card"), numbers).when(kind.rlike("^(given|surname)_"), capital).when(kind == "email", mail).otherwise(value)


def _renamed(gap: Column, names: Column) -> Column:
    """Text between mentions with the names of ``names`` (surface, new) replaced where they stand as whole words."""

    def step(text: Column, n: Column) -> Column:
        alone = F.concat(F.lit(r"(?<![\p{L}\p{M}])"), n["surface"], F.lit(r"(?![\p{L}\p{M}])"))
        return F.when(F.contains(text, n["surface"]), F.regexp_replace(text, alone, n["new"])).otherwise(text)

    return F.aggregate(names, gap, step)


def pseudonymised(docs: DataFrame, row_id: str = "doc_id", text: str = "text", key: str = KEY, entities: str | None = None) -> DataFrame:
    """``docs`` with every entity of ``text`` replaced; a column named ``entities``, if given, says how many a text has.

    All columns return, whatever their names.  Null and empty texts and texts without entities return as they
    are; very long texts are searched whole; rows that agree in id and text are treated alike; an empty table
    gives an empty result.  Names that stand alone, in the text's capitals or all in capitals, are replaced where the
    text has them in full elsewhere; they are not counted.
    """
    held, doc, mark, count, names = fresh(docs, "new", "doc", "key", "real", "names")
    found = _one_gender(cut(mentions(docs, row_id, text), "pii-mentions"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # drawing costs far more than its bytes tell: dealt by a number of its own, as Spark would drop an exchange by the keys of distinct()
    distinct = found.where("kind <> 'title'").select("kind", "canon").distinct().repartition(tasks, F.pmod(F.xxhash64("canon", "kind"), F.lit(tasks * 64)))
    named = found.join(surrogates(distinct, key), ["kind", "canon"], "left")
    named = named.withColumn("new", _written(F.col("surface"), F.col("kind"), F.col("surrogate")))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "new"))), lambda x: x["new"]), " ")
    called = F.collect_list(F.when(F.col("kind").rlike("^(given|surname)_") & (F.length("surface") > 1), F.struct("surface", "new")))
    whole = named.distinct().groupBy("doc_id", "text_key", "place").agg(parts.alias("new"), F.bool_or("real").cast("int").alias("real"), called.alias("called"))
    lists = F.transform(F.array_sort(F.collect_list(F.struct("place", "new"))), lambda x: x["new"])
    known = F.array_distinct(F.flatten(F.collect_list("called")))
    loud = F.transform(known, lambda n: F.struct(F.upper(n["surface"]).alias("surface"), F.upper(n["new"]).alias("new")))
    # the longest first, so that no part of a double name is taken for a name of its own
    sized = F.transform(F.array_sort(F.transform(F.concat(known, loud), lambda n: F.struct((-F.length(n["surface"])).alias("size"), n["surface"].alias("surface"), n["new"].alias("new")))), lambda n: F.struct(n["surface"].alias("surface"), n["new"].alias("new")))
    whole = cut(whole.groupBy(F.col("doc_id").alias(doc), F.col("text_key").alias(mark)).agg(lists.alias(held), F.sum("real").alias(count), sized.alias(names)), "pii-replacements")
    body = F.col(f"`{text}`")
    own = F.col(f"`{row_id}`").eqNullSafe(F.col(doc)) & (F.xxhash64(body) == F.col(mark))
    joined = docs.join(whole.hint("merge"), own, "left")  # the same plan at every size
    gaps = F.transform(F.split(body, PATTERN, -1), lambda g: F.when(F.size(names) > 0, _renamed(g, F.col(names))).otherwise(g))
    new = F.array_join(F.zip_with(gaps, F.concat(F.col(held), F.array(F.lit(""))), lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")
    columns = [F.when(F.col(held).isNull(), body).otherwise(new).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns, *([F.coalesce(F.col(count), F.lit(0)).cast("long").alias(entities)] if entities else []))
