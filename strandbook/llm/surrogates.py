"""Personal data replaced by keyed surrogates, with DataFrame operations only.

Found: e-mail addresses, telephone numbers, US social security numbers, IPv4 and IPv6 addresses,
payment card numbers (by their check digit), IBANs (by theirs), dates of birth after a cue, secrets
(hexadecimal strings and access keys), and names after a title or a cue such as "my name is".  Further
mentions of a found name's words in the same document are found too.  Every entity gets a replacement
of its own kind, made from a keyed digest (HMAC-SHA-256): digits stay digits, letters stay letters of
their script and case, separators stay, check digits are right again, given names keep the gender of
the title and names are built of syllables of their script.  Dates of birth all move by one keyed
number of days.

The digest is taken of the entity's canonical form (digits alone, lower case, single words of a
name), so one person or number is replaced alike in every document and every notation.  Different
entities stay different: all surrogates of the corpus are compared with each other and with all
originals, and those that collide are made anew with another salt until none does.  Formats with few
values grow longer after some salts, so this ends.  Initials are the exception: a letter has no more
than its alphabet to go to.

Not found: names with neither a title nor a cue in their document, street addresses, and what is
written out in words.
"""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table

KEY_SETTING = "spark.strandbook.surrogateKey"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: fixed values: titles that name a gender, Latin and Cyrillic, and titles that name none
FEMALE = r"Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|г-жа|госпожа"
MALE = r"Mr|Herr|Monsieur|Señor|Sr|г-н|господин"
NEUTRAL = r"Dr|Prof|Professor|Doctor|Docteur|Doktor|доктор|профессор"
#: fixed values: words before a name without a title, small words inside names, words before a date of birth
CUES = r"[Mm]y name is|[Nn]ame:|[Cc]ontact|[Dd]ear|[Rr]egards,|[Ss]incerely,|[Ss]igned by|[Ii]ch heiße|[Jj]e m[’']appelle|[Mm]e llamo|[Мм]еня зовут"
PARTICLES = r"von|van|de|del|della|der|den|di|da|la|le|bin|al"
BORN = ("born ", "born on ", "Born ", "Born on ", "DOB ", "DOB: ", "date of birth ", "date of birth: ", "Date of birth: ", "geboren am ", "né le ", "née le ", "nacido el ", "nacida el ")
TITLE = rf"(?:{FEMALE}|{MALE}|{NEUTRAL})\.?"
INITIAL, WORD = r"\p{Lu}\.", r"\p{Lu}[\p{L}'’-]++"
MORE = rf"(?: (?:(?:{PARTICLES}) ){{0,2}}(?:{INITIAL}|{WORD}))"
#: all repetitions of groups are bounded or possessive, so no text makes the matcher recurse
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}_%+-])[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]{0,63}+@[A-Za-z0-9][A-Za-z0-9-]*+(?:\.[A-Za-z0-9-]++)++",
    "ip": rf"(?<![0-9A-Za-z.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9A-Za-z]|\.[0-9])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]{0,39}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![0-9A-Za-z:])",
    "birth_date": rf"(?<={'|'.join(BORN)})(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{4}})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|(?<=[ .-]|(?<![0-9])|1)\d{3}[.-])\d{3}[ .-]\d{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z+])\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])\d{3}-\d{2}-\d{4}(?![0-9A-Za-z]|-[0-9])",
    "card": r"(?<![0-9A-Za-z])\d(?:[ -]?\d){12,18}(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|AKIA[0-9A-Z]{16}|ghp_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,}+)(?![0-9A-Za-z])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{TITLE} (?:(?:{PARTICLES}) ){{0,2}}(?:{INITIAL}|{WORD}){MORE}{{0,4}}|(?:{CUES}) (?!{TITLE} )(?:{INITIAL}|{WORD}){MORE}{{1,4}})",
}
#: what each kind begins with: looked at first, as nearly all places in a text begin nothing
NAME_SIGNS = "[MFSHDPNCRIJcdijmnrsгдпмМ]"
SIGNS = {"ip": "[0-9]", "ipv6": "[0-9A-Fa-f:]", "birth_date": "[0-9]", "phone": "[0-9+(]", "ssn": "[0-9]", "card": "[0-9]", "iban": "[A-Z]", "secret": "[0-9a-fA-Fgs]", "name": NAME_SIGNS}
ANY = "|".join(f"(?:(?={SIGNS[k]})(?:{p}))" if k in SIGNS else f"(?:{p})" for k, p in PATTERNS.items())
#: every text with an entity matches this, and most others are told by it at a fraction of the cost
HINT = rf"[@0-9]|(?={NAME_SIGNS})(?<![\p{{L}}\p{{N}}])(?:{TITLE} (?:\p{{Lu}}|{PARTICLES})|(?:{CUES}) \p{{Lu}})|AKIA|ghp_|sk-|[a-f]{{32}}|[A-F]{{32}}"
KINDS = ("email", "phone", "ssn", "ip", "ipv6", "card", "iban", "birth_date", "secret", "name")
TITLED = rf"^(?:{TITLE}|{CUES}) "


def drawn_key(spark: SparkSession) -> str:
    """The key that the session names, or else a new one that is kept nowhere: surrogates of one run
    then agree with each other and with those of no other run."""
    return spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)


def entities_of(text: Column) -> Column:
    """What looks like an entity in a text, in order; an empty array where there is nothing."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _bare(v: Column) -> Column:
    return F.regexp_replace(v, r"\D", "")


def _luhn(digits: Column) -> Column:
    """The check sum of card numbers; 0 modulo 10 for a right one."""
    n = F.length(digits)
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    digit = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when(F.pmod(n - i, F.lit(2)) == 1, twice(digit(i))).otherwise(digit(i)))


def _mod97(text: Column) -> Column:
    """Of an IBAN turned round; 1 for a right one."""
    turned = F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4))
    step = lambda s, c: F.when(c.rlike("[0-9]"), F.pmod(s * 10 + c.cast("int"), F.lit(97))).otherwise(F.pmod(s * 100 + F.ascii(c) - 55, F.lit(97)))
    return F.aggregate(_signs(turned), F.lit(0), step)


def kind(v: Column) -> Column:
    """The kind of a found entity, told by its own text; null for a number with a wrong check digit."""
    joined = F.replace(v, F.lit(" "), F.lit(""))
    return (
        F.when(v.rlike(TITLED), "name")
        .when(F.contains(v, F.lit("@")), "email")
        .when(v.rlike("^[0-9A-Fa-f]*:"), "ipv6")
        .when(v.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "ip")
        .when(v.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(v.rlike(r"^(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./-]\d{1,2}[./-]\d{4})$"), "birth_date")
        .when(v.rlike(r"^(?:\+|\(|(?:1[ .-]?)?\(?\d{3}\)?[ .-]?\d{3}[ .-]\d{4}$)"), "phone")
        .when(v.rlike(r"^[0-9][0-9 -]*$") & (F.length(_bare(v)) < 20), F.when(F.pmod(_luhn(_bare(v)), F.lit(10)) == 0, "card"))
        .when(v.rlike(r"^[A-Z]{2}\d{2}[ A-Z0-9]+$") & (F.length(joined) < 35), F.when(_mod97(joined) == 1, "iban"))
        .otherwise("secret")
    )


def words_of(v: Column) -> Column:
    """The words of a name after its title or cue."""
    return F.split(F.regexp_replace(v, TITLED, ""), " ")


def told(found: Column) -> Column:
    """Structs (v, k) of entities with their kinds, so that a kind is told once."""
    return F.transform(found, lambda v: F.struct(v.alias("v"), kind(v).alias("k")))


def units(v: Column, k: Column) -> Column:
    """Canonical forms that get digests: one, or one for each word of a name ("" for small words,
    initials, and where there is nothing to tell apart)."""
    words = words_of(v)
    gender = F.when(v.rlike(rf"^(?:{FEMALE})\.? "), "f").when(v.rlike(rf"^(?:{MALE})\.? "), "m").otherwise("n")
    role = lambda w, i: F.when((i == 0) & (F.size(words) > 1), F.concat(F.lit("given_"), gender)).when(w.rlike(r"\p{IsCyrillic}"), F.concat(F.lit("family_"), gender)).otherwise("family")
    named = F.transform(words, lambda w, i: F.when(w.rlike(rf"^(?:{PARTICLES}|{INITIAL})$"), "").otherwise(F.concat(role(w, i), F.lit(":"), F.lower(w))))
    canon = F.when(k.isin("phone", "card", "ssn"), _bare(v)).otherwise(F.lower(F.replace(v, F.lit(" "), F.lit(""))))
    return F.when(k == "name", named).when(k.isNull() | (k == "birth_date"), F.array(F.lit(""))).otherwise(F.array(F.concat(k, F.lit(":"), canon)))


def hmac(message: Column, key: str) -> Column:
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in raw)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def digest(unit: Column, salt: Column, key: str) -> Column:
    base = F.concat_ws("|", unit, salt.cast("string"))
    return F.concat(hmac(base, key), hmac(F.concat(base, F.lit("|more")), key))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, not again for each sign."""
    return F.transform(F.array(value), use)[0]


def _at(h: Column, i: Column) -> Column:
    """A number below 256 from the digest's place i (places repeat after 64)."""
    return F.conv(F.substring(h, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _letter(letters: str, n: Column) -> Column:
    return F.substring(F.lit(letters), F.pmod(n, F.lit(len(letters))).cast("int") + 1, F.lit(1))


LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя"


def _like(c: Column, n: Column) -> Column:
    """A sign of the class of ``c``: digit, letter of the script and case, or itself."""
    lower = F.when(c.rlike(r"\p{IsCyrillic}"), _letter(CYRILLIC, n)).otherwise(_letter(LATIN, n))
    return F.when(c.rlike(r"[0-9]"), F.pmod(n, F.lit(10)).cast("string")).when(~c.rlike(r"\p{L}"), c).when(F.lower(c) != c, F.upper(lower)).otherwise(lower)


def _signs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _digits(v: Column, h: Column, keep: Column) -> Column:
    """Digits after the first ``keep`` replaced by their ordinal, all else kept."""
    place = lambda i: F.length(F.regexp_replace(F.substring(v, F.lit(1), i), r"\D", ""))
    return F.array_join(F.transform(_signs(v), lambda c, i: F.when(c.rlike(r"[0-9]") & (place(i) >= keep), F.pmod(_at(h, place(i)), F.lit(10)).cast("string")).otherwise(c)), "")


def _all(v: Column, h: Column) -> Column:
    return F.array_join(F.transform(_signs(v), lambda c, i: _like(c, _at(h, i))), "")


def _name(word: Column, unit: Column, h: Column, salt: Column) -> Column:
    """Syllables of the script, the ending of the gender, the word's case; longer with each salt."""
    cyrillic = word.rlike(r"\p{IsCyrillic}")
    both = lambda latin, other: F.when(cyrillic, other).otherwise(latin)
    syllable = lambda i: F.concat(both(_letter("bdfgklmnprstvz", _at(h, i * 2)), _letter("бвгдзклмнпрст", _at(h, i * 2))), both(_letter("aeiou", _at(h, i * 2 + 1)), _letter("аеиоу", _at(h, i * 2 + 1))))
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.least(salt, F.lit(20)) + 2), syllable), "")
    end = (
        F.when(unit.startswith("given_f"), both(F.lit("na"), F.lit("на")))
        .when(unit.startswith("given_m"), both(F.lit("n"), F.lit("н")))
        .when(unit.startswith("given_n"), both(F.lit("s"), F.lit("с")))
        .when(unit.startswith("family_f"), "ова")
        .when(unit.startswith("family_m"), "ов")
        .otherwise(both(F.lit("ler"), F.lit("ко")))
    )
    made = F.concat(body, end)
    return F.when((F.upper(word) == word) & (F.length(word) > 1), F.upper(made)).otherwise(F.initcap(made))


def _moved_date(v: Column, key: str) -> Column:
    """All dates move by one keyed number of days between one and eleven years, so different dates
    stay different; an impossible date stays as it is.  Day and month are read in this order unless
    the second number is above 12."""
    first = hmac(F.lit("birth dates"), key)
    days = F.conv(F.substring(first, 1, 7), 16, 10).cast("int")
    days = (F.pmod(days, F.lit(3650)) + 365) * F.when(F.substring(first, 8, 1) < "8", 1).otherwise(-1)
    part = lambda i: F.regexp_extract(v, r"^(\d+)([./-])(\d+)[./-](\d+)$", i)
    iso = v.rlike(r"^\d{4}-")
    swapped = part(3).cast("int") > 12
    when = F.when(iso, F.try_to_date(v, "yyyy-MM-dd")).otherwise(F.try_to_date(F.concat_ws("-", part(4), F.lpad(F.when(swapped, part(1)).otherwise(part(3)), 2, "0"), F.lpad(F.when(swapped, part(3)).otherwise(part(1)), 2, "0")), "yyyy-MM-dd"))
    to = F.date_add(when, days)
    day, month = F.date_format(to, "dd"), F.date_format(to, "MM")
    made = F.when(iso, F.date_format(to, "yyyy-MM-dd")).otherwise(F.concat(F.when(swapped, month).otherwise(day), part(2), F.when(swapped, day).otherwise(month), part(2), F.date_format(to, "yyyy")))
    return F.coalesce(made, v)


def render(v: Column, k: Column, parts: Column, key: str) -> Column:
    """The surrogate of ``v`` of kind ``k``; parts: structs (unit, salt, h) of its units."""
    first = F.element_at(parts, 1)
    h, salt = first["h"], first["salt"]
    domain = F.substring_index(v, "@", -1)
    host, top = F.regexp_replace(domain, r"\.[^.]*$", ""), F.substring_index(domain, ".", -1)
    # short local parts have few values: after some salts they get longer
    local = F.concat(_all(F.substring_index(v, "@", 1), h), F.substring(h, F.lit(1), F.least(F.floor(salt / 4), F.lit(32)).cast("int")))
    address = F.concat(local, F.lit("@"), _once(digest(F.concat(F.lit("domain:"), F.lower(domain)), F.lit(0), key), lambda d: _all(host, d)), F.lit("."), top)
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.pmod(_at(h, i), F.lit(254)) + 1).cast("string")), ".")
    group = lambda i: F.substring(h, i * 4 + 1, F.lit(4))
    full = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), group), ":")
    groups = F.array_join(F.transform(F.split(v, ":"), lambda g, i: F.when(g == "", "").otherwise(group(i))), ":")
    # the country code of a telephone number stays
    country = F.when(v.startswith("+"), F.length(F.regexp_extract(v, r"^\+(1(?=[ .(-])|\d{1,3})", 1))).otherwise(0)
    longer = F.least(F.floor(salt / 8), F.lit(12)).cast("int")
    extended = F.when(longer > 0, F.concat(F.lit(" "), F.substring(F.translate(h, "abcdef", "123456"), F.lit(1), longer))).otherwise("")
    card = _digits(v, h, F.lit(1))
    card = F.concat(F.substring(card, F.lit(1), F.length(v) - 1), F.pmod(10 - F.pmod(_luhn(F.concat(F.substring(_bare(card), F.lit(1), F.length(_bare(card)) - 1), F.lit("0"))), F.lit(10)), F.lit(10)).cast("string"))
    account = F.concat(F.substring(v, 1, 2), F.lit("00"), _all(F.substring(v, F.lit(5), F.length(v)), h))
    account = F.concat(F.substring(v, 1, 2), F.lpad((98 - _mod97(F.replace(account, F.lit(" "), F.lit("")))).cast("string"), 2, "0"), F.substring(account, F.lit(5), F.length(v)))
    title = F.regexp_extract(v, TITLED, 0)
    initial = lambda w: _once(digest(F.concat(F.lit("initial:"), F.lower(w)), F.lit(0), key), lambda d: _all(w, d))
    named = F.concat(title, F.array_join(F.zip_with(words_of(v), parts, lambda w, p: F.when(p["unit"] != "", _name(w, p["unit"], p["h"], p["salt"])).when(w.rlike(rf"^{INITIAL}$"), initial(w)).otherwise(w)), " "))
    hexes = F.substring(F.repeat(h, F.floor(F.length(v) / 128).cast("int") + 1), F.lit(1), F.length(v))
    hexes = F.when(v.rlike("^[0-9A-F]+$"), F.upper(hexes)).otherwise(hexes)
    prefix = F.regexp_extract(v, r"^(?:AKIA|ghp_|sk-)", 0)
    rest = F.concat(prefix, _all(F.substring(v, F.length(prefix) + 1, F.length(v)), h))
    return (
        F.when(k == "email", address)
        .when(k == "name", named)
        .when(k == "ip", octets)
        .when(k == "ipv6", F.when(salt >= 4, full).otherwise(groups))
        .when(k == "birth_date", _moved_date(v, key))
        .when(k == "phone", F.concat(_digits(v, h, country), extended))
        .when(k == "ssn", _digits(v, h, F.lit(0)))
        .when(k == "card", card)
        .when(k == "iban", account)
        .when((k == "secret") & v.rlike("^[0-9a-fA-F]+$"), hexes)
        .when(k == "secret", rest)
        .otherwise(v)
    )


def canonical(v: Column, k: Column, unit: Column, salt: Column, h: Column, key: str) -> Column:
    """The canonical form of a unit's surrogate, by which surrogates are compared."""
    word = F.substring_index(unit, ":", -1)
    kind_of = F.substring_index(unit, ":", 1)
    made = F.when(unit.rlike("^(?:given|family)"), F.lower(_name(word, unit, h, salt))).otherwise(render(v, k, F.array(F.struct(unit.alias("unit"), salt.alias("salt"), h.alias("h"))), key))
    return F.concat(kind_of, F.lit(":"), F.when(kind_of.isin("phone", "card", "ssn"), _bare(made)).otherwise(F.lower(F.replace(made, F.lit(" "), F.lit("")))))


def _units(e: str) -> Column:
    return F.explode(F.filter(units(F.col(f"{e}.v"), F.col(f"{e}.k")), lambda u: u != "")).alias("unit")


def resalted(docs: DataFrame, key: str) -> DataFrame:
    """unit, salt of the entities whose first surrogate collides with another or with an original."""
    found = docs.select(F.explode(told(entities_of(F.col("text")))).alias("e"))
    entities = found.select("e", _units("e")).groupBy("unit").agg(F.min("e").alias("e"))
    entities = cut(entities.select("unit", "e.v", "e.k"))
    hashed = digest(F.col("unit"), F.col("salt"), key)
    canon = canonical(F.col("v"), F.col("k"), F.col("unit"), F.col("salt"), F.col("h"), key)
    taken, left, salt, moved = None, entities, 0, None
    while True:
        tried = left.withColumn("salt", F.lit(salt)).withColumn("h", hashed).withColumn("canon", canon).drop("h", "salt")
        # a surrogate may meet an original, its own included, an earlier surrogate, or one of this round
        known = entities.select(F.col("unit").alias("canon"))
        if taken is not None:
            known = known.unionByName(taken.select("canon")).distinct()
        tried = tried.join(known.withColumn("clash", F.lit(True)), "canon", "left")
        # the least digest keeps the surrogate, so which one does is no matter of order
        tried = tried.withColumn("n", F.row_number().over(W.partitionBy("canon").orderBy(F.sha2("unit", 256))))
        tried = cut(tried.withColumn("good", F.col("clash").isNull() & (F.col("n") == 1)).select("unit", "v", "k", "canon", "good"))
        good = tried.where("good").select("unit", "canon")
        taken = good if taken is None else taken.unionByName(good)
        if salt:
            new = good.select("unit", F.lit(salt).alias("salt"))
            moved = new if moved is None else moved.unionByName(new)
        left = tried.where("NOT good").select("unit", "v", "k")
        if left.isEmpty():
            return moved if moved is not None else docs.sparkSession.createDataFrame([], "unit string, salt int")
        salt += 1


def replace(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``docs`` with the entities of ``text`` replaced and ``found``, the array of their kinds.

    ``key`` is the secret of the surrogates; without one the session's setting or a new random key is
    taken (``drawn_key``).  The same key gives the same surrogates in every run.  Null texts stay null
    with no entities, empty ones stay empty, texts of any length are searched whole, and an empty table
    stays empty.  A column named found is replaced; all other columns and repeated rows stay as they
    are, whatever their names.  A salt other than the first is looked up by document."""
    key = key or drawn_key(docs.sparkSession)
    docs = docs.drop("found")
    columns = docs.columns
    moved = resalted(docs, key)
    salts = F.create_map().cast("map<string,int>")
    # the user's columns stand in one struct, so none of them can clash with those made here
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("text").alias("text"), entities_of(F.col("text")).alias("v"))
    if not moved.isEmpty():
        seen = docs.select("doc_id", F.explode(told(entities_of(F.col("text")))).alias("e")).select("doc_id", _units("e")).distinct()
        by_doc = seen.join(moved, "unit").groupBy(F.col("doc_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("unit", "salt"))).alias("salts"))
        out = out.join(by_doc, F.col("row.doc_id").eqNullSafe(F.col("id")), "left")
        salts = F.coalesce("salts", salts)
    out = out.withColumn("salts", salts)

    # words of found names, to be found again without title or cue: as written, or in capitals
    pairs = F.flatten(F.transform(F.filter("v", lambda v: v.rlike(TITLED)), lambda v: F.arrays_zip(words_of(v).alias("word"), units(v, F.lit("name")).alias("unit"))))
    pairs = F.filter(pairs, lambda p: (p["unit"] != "") & (F.length(p["word"]) > 2))
    out = out.withColumn("names", F.when(F.exists("v", lambda v: v.rlike(TITLED)), pairs).otherwise(F.array().cast("array<struct<word:string,unit:string>>")))
    words = F.array_distinct(F.flatten(F.transform("names", lambda p: F.array(p["word"], F.upper(p["word"])))))
    again = F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}])(?:"), F.array_join(F.transform(words, lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    named = F.size("names") > 0
    out = out.withColumn("pattern", F.when(named, again).otherwise(ANY))
    out = out.withColumn("v", F.when(named, F.regexp_extract_all("text", F.col("pattern"), F.lit(0))).otherwise(F.col("v")))

    def part(unit: Column) -> Column:
        salt = F.coalesce(F.try_element_at(F.col("salts"), unit), F.lit(0))
        return F.struct(unit.alias("unit"), salt.alias("salt"), F.when(unit != "", digest(unit, salt, key)).alias("h"))

    def unit_again(v: Column) -> Column:
        return F.get(F.filter("names", lambda p: F.upper(p["word"]) == F.upper(v)), F.lit(0))["unit"]

    def with_parts(e: Column) -> Column:
        all_units = F.when(e["bare"].isNotNull(), F.array(e["bare"])).otherwise(units(e["v"], e["k"]))
        return F.struct(e["v"].alias("v"), e["k"].alias("k"), e["bare"].alias("bare"), F.transform(all_units, part).alias("parts"))

    def made(e: Column) -> Column:
        first = F.element_at(e["parts"], 1)
        name = _name(e["v"], first["unit"], first["h"], first["salt"])
        text = F.when(e["bare"].isNotNull(), name).otherwise(render(e["v"], e["k"], e["parts"], key))
        return F.struct(text.alias("text"), F.when(e["bare"].isNotNull(), "name").otherwise(e["k"]).alias("kind"))

    each = F.transform(F.transform("v", lambda v: F.struct(v.alias("v"), kind(v).alias("k"), unit_again(v).alias("bare"))), with_parts)
    out = out.withColumn("made", F.when(F.size("v") > 0, F.transform(each, made)).otherwise(F.array().cast("array<struct<text:string,kind:string>>")))
    text = F.array_join(F.zip_with(F.split("text", F.col("pattern"), -1), "made", lambda gap, m: F.concat(gap, F.coalesce(m["text"], F.lit("")))), "")
    text = F.when(F.size("made") > 0, text).otherwise(F.col("text"))
    kept = [text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in columns]
    return out.select(*kept, F.filter(F.transform("made", lambda m: m["kind"]), lambda k: k.isNotNull()).alias("found"))


def op7_keyed_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` with its text after replacement and the number of entities found,
    in all and of each kind.  Null texts stay null; the key is ``spark.strandbook.surrogateKey``, or a
    new one for each run."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def count(name: str) -> Column:
        return F.size(F.filter("found", lambda k: k == name)).alias(f"n_{name}")

    return replace(docs).select("doc_id", "text", F.size("found").alias("n_entities"), *map(count, KINDS))
