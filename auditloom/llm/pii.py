"""Operator 4 [native], surrogate generation for personal data and secrets.

One pattern finds e-mail addresses, secrets after their keyword, IPv4 addresses, payment cards (by checksum), social security numbers,
phone numbers and titled names. Each entity has a kind and a *canonical* form (digits, lower case, no format), and a surrogate is a keyed hash of both, spelled
in the kind's own terms: digits for digits, letters of the same script for letters, a valid checksum for a card, the private or public side for an address,
a given name ending by the title's gender. The surrogate is then rendered in the format of the place it replaces (separators, country code, case). So equal entities
get equal surrogates wherever and however they are written (coreference), and without the key none can be undone. The key is given or set in the session (``auditloom.pii.key``), never part of the code.

A name is one person whatever the title: where "Dr. Anna Schmidt" is "Mrs. Anna Schmidt" elsewhere in the corpus, both get the surrogate of the gender that is known.
No pattern bounds an entity's length, and groups repeat possessively, so matching is linear and needs no stack. Several titles may stand before a name; a name of a title in capitals is three words in capitals at most.
Not detected: names without a title of the list, IPv6, IBAN, secrets of fewer than eight characters, phone and social security numbers that are bare digits or parted by blanks alone without + or brackets.

Collision checks keep entities distinct: over all distinct entities of the corpus, surrogates that two entities share, or that are themselves a real entity of the
corpus, are drawn again with the next attempt number, until none is left. What is shuffled is a row a distinct entity and partition, not texts. The few
entities with an attempt over 0, and the names of a known gender, go back to the texts that hold them by a join on the text's hash. Only a given name is drawn again where there is one, so
a family name keeps its surrogate. Where a format has hardly more values than the corpus has entities (all SSNs, say), surrogates that still collide after ``MAX_ATTEMPTS`` draws stay shared.

DataFrame functions only. A text is scanned twice, for the entities and to replace them; only one with a match is parted and put together again. Very long texts are scanned whole, in linear time. Cases: a null text stays null, an empty one empty; texts without entities are unchanged;
null and repeated ids and all other columns stay as they are; a column ``n_replaced`` or ``replaced_kinds`` of the input is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, let, without

#: Titles by gender, which is what a surrogate given name keeps.
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Mlle"]
MALE = ["Mr", "Herr", "Señor", "Sr", "Monsieur"]
NEUTRAL = ["Dr", "Prof"]
SECRET_WORDS = r"password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key"

#: Titles in capitals; those that are other words or abbreviations as well need their dot.
CAPITALS, DOTTED_CAPITALS = ["MRS", "MR", "MISS", "FRAU", "HERR", "SEÑORA", "SEÑOR", "MADAME", "MONSIEUR", "PROF"], ["MS", "DR", "SR", "SRA", "MME", "MLLE"]

#: Lower-case words within a family name, or before it.
PARTICLES = "van|von|der|den|de|del|della|di|da|dos|du|la|le|los|las|zu|zur|bin|ibn|al|y|e|i|ter|ten|af|av"

#: A capitalised word (composed or not, with any apostrophe), initials with their dots, an initial without one before another capitalised word, or a name of Han or Hangul characters.
_NAME_WORD = r"(?:(?:\p{Lu}\p{M}*+\.-?)++|\p{Lu}[\p{L}\p{M}'’ʼ-]++|\p{Lu}(?= \p{Lu})|\p{IsHan}{1,4}+|\p{IsHangul}{1,4}+)"
_TITLE = rf"(?:{'|'.join(FEMALE + MALE + NEUTRAL)})\.? "
_CAPITAL_TITLE = rf"(?:(?:{'|'.join(CAPITALS)})\.? |(?:{'|'.join(DOTTED_CAPITALS)})\. )"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Letters of a domain's labels: those of scripts that are parted from other words.
_LABEL = r"A-Za-z\p{IsLatin}\p{IsCyrillic}\p{IsGreek}\p{M}"
PATTERNS = {
    "email": rf"(?<![\p{{L}}\p{{M}}\p{{N}}._%+-])[\p{{L}}\p{{M}}\p{{N}}._%+-]++@(?:[{_LABEL}0-9-]++\.(?=[0-9-]*[{_LABEL}]))++[{_LABEL}0-9]++(?:-++[{_LABEL}0-9]++)*+",
    "secret": rf"(?i:(?<![\p{{L}}\p{{N}}])(?:{SECRET_WORDS})[\"']?\s*+[:=]\s*+)(?:\"[^\"\r\n]{{8,}}+(?=\")|'[^'\r\n]{{8,}}+(?=')|[\"']?(?:(?=\S{{8}})(?:[^\s\"']++(?<=[\p{{L}}\p{{N}}])'(?=[\p{{L}}\p{{N}}]))++[^\s\"']*|[^\s\"']{{7,}})[^\s\"'.,;:!?)\]}}])",
    "ipv4": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d.-])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?![\d-])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:(?:{_TITLE})++(?:(?:{PARTICLES}) ){{0,3}}{_NAME_WORD}(?:(?: (?:{PARTICLES})){{0,3}} {_NAME_WORD})*+|{_CAPITAL_TITLE}\p{{Lu}}{{2,}}+(?:[ '’-]\p{{Lu}}{{2,}}+){{0,2}}+)(?![\p{{L}}\p{{M}}])",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
_ABC = "abcdefghijklmnopqrstuvwxyz"
#: Characters of given names.
_HAN, _HANGUL = "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平", "민서준우지현수영진호은경"
_CYRILLIC, _GREEK = "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"
MAX_ATTEMPTS = 64


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def luhn_valid(digits: Column) -> Column:
    return _luhn_sum(digits) % 10 == 0


def _luhn_sum(digits: Column) -> Column:
    reverse = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1))
    return F.aggregate(F.transform(reverse, value), F.lit(0), lambda a, b: a + b)


def kind_of(m: Column) -> Column:
    """Kind of a match; null for what the pattern finds but is no entity (a digit run without a card's checksum)."""
    return (
        F.when(m.rlike(rf"^(?i:{SECRET_WORDS})[\"']?\s*[:=]"), "secret")
        .when(m.contains("@"), "email")
        .when(m.rlike(r"^\d+(\.\d+){3}$"), "ipv4")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(r"^\p{L}"), "name")
        .when(~m.startswith("+") & (F.length(_digits(m)) >= 13), F.when(luhn_valid(_digits(m)), "card"))
        .otherwise("phone")
    )


_SECRET_HEAD = rf"^((?i:{SECRET_WORDS})[\"']?\s*[:=]\s*[\"']?)"
_NAME_HEAD = rf"^((?:{_TITLE})+|{_CAPITAL_TITLE})"
_HER, _HIS = (rf"(?i)(?:^|[. ])(?:{'|'.join(titles)})[. ]" for titles in (FEMALE, MALE))


#: E.164 country codes of one and two digits; all others have three.
_CODE = r"^(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{1,3})"


def _country(m: Column) -> Column:
    """The country code by the fixed table, so with and without separators alike; numbers without + are of country 1."""
    return F.when(m.startswith("+"), F.regexp_extract(_digits(m), _CODE, 1)).otherwise("1")


def canonical(kind: Column, m: Column) -> Column:
    """What an entity is, whatever its format. Names keep gender: f, m or n before the words."""
    titles = F.regexp_extract(m, _NAME_HEAD, 1)
    gender = F.when(titles.rlike(_HER), "f").when(titles.rlike(_HIS), "m").otherwise("n")
    national = F.when(m.startswith("+"), F.substr(_digits(m), F.length(_country(m)) + 1)).otherwise(_digits(m))
    return (
        F.when(kind == "secret", F.regexp_replace(m, _SECRET_HEAD, ""))
        .when(kind == "email", F.lower(m))
        .when(kind == "ipv4", m)
        .when(kind == "phone", F.concat(_country(m), F.lit("-"), national))
        .when(kind == "name", F.concat(gender, F.lit(" "), F.lower(F.trim(F.regexp_replace(F.regexp_replace(m, _NAME_HEAD, ""), r"\.-? *", " ")))))
        .otherwise(_digits(m))
    )


def _byte(h: Column, i: Column) -> Column:
    """The i-th byte (0..255) of a hash of 128 bytes in hexadecimal, round and round."""
    return F.conv(F.substr(h, 2 * (i % 128) + 1, F.lit(2)), 16, 10).cast("int")


def _pick(letters: str, n: Column) -> Column:
    return F.substr(F.lit(letters), n % len(letters) + 1, F.lit(1))


def _spelled(text: Column, h: Column, shift: int = 0) -> Column:
    """``text`` with every letter and digit replaced by one of its own sort (lower case)."""

    def one(c: Column, i: Column) -> Column:
        return let(
            _byte(h, i + shift),
            lambda n: F.when(c.rlike("^[0-9]$"), _pick("0123456789", n))
            .when(c.rlike("^[aeiouy]$"), _pick("aeiou", n))
            .when(c.rlike("^[a-z]$"), _pick("bcdfghjklmnpqrstvwxz", n))
            .when(c.rlike(r"^\p{IsCyrillic}$"), _pick(_CYRILLIC, n))
            .when(c.rlike(r"^\p{IsGreek}$"), _pick(_GREEK, n))
            .when(c.rlike(r"^\p{IsHan}$"), _pick(_HAN, n))
            .when(c.rlike(r"^\p{IsHangul}$"), _pick(_HANGUL, n))
            .when(c.rlike(r"^\p{L}$"), _pick(_ABC, n))
            .otherwise(c),
        )

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The canonical surrogate of a canonical entity. From the fourth attempt on letters are added where the format allows it."""
    seed = F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string"))
    hashed = F.concat(*[F.sha2(F.concat(seed, F.lit(f"|{k}")), 256) for k in range(4)])
    longer = lambda h: F.when(attempt > 3, F.substr(F.translate(h, "0123456789", "ghijklmnop"), F.lit(200), F.least(attempt - 3, F.lit(8)))).otherwise(F.lit(""))

    def of(h: Column) -> Column:
        local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
        dh = F.concat(*[F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain, F.lit(str(k))), 256) for k in range(4)])
        labels = F.regexp_replace(domain, r"\.[^.]*$", "")
        email = F.concat(_spelled(local, h), longer(h), F.lit("@"), let(dh, lambda d: _spelled(labels, d)), F.lit(".example"))
        octet = lambda i: F.when(attempt > 3, _byte(h, F.lit(i))).otherwise((_byte(h, F.lit(i)) * 256 + _byte(h, F.lit(i + 4))) % 254 + 1)
        private = canon.rlike(r"^(10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.|127\.)")
        ipv4 = F.concat_ws(".", F.when(private, F.when((attempt > 3) & (_byte(h, F.lit(9)) % 2 == 1), "127").otherwise("10")).otherwise((octet(0) % 89 + 11).cast("string")), *[octet(i).cast("string") for i in (1, 2, 3)])
        body = F.concat(F.substr(canon, F.lit(1), F.lit(1)), _spelled(F.substr(canon, F.lit(2), F.length(canon) - 2), h))
        card = let(body, lambda b: F.concat(b, ((10 - _luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
        country, national = F.substring_index(canon, "-", 1), F.substring_index(canon, "-", -1)
        phone = F.concat(country, F.lit("-"), (_byte(h, F.lit(0)) % 8 + 2).cast("string"), _spelled(F.substr(national, F.lit(2)), h, 1))
        ssn = F.when(attempt > 3, _spelled(canon, h)).otherwise(F.concat(F.lit("9"), _spelled(F.substr(canon, F.lit(2)), h)))
        gender, whole = F.substr(canon, F.lit(1), F.lit(1)), F.substr(canon, F.lit(3))
        # Each word has its own hash, so a family name keeps its surrogate with or without a given name before it; only a first word is drawn again.
        word = lambda w, draw: F.concat(*[F.sha2(F.concat_ws("|", F.lit(key), F.lit("name"), w, draw.cast("string"), F.lit(str(k))), 256) for k in range(4)])
        parts = F.split(whole, " ")
        given = F.when(whole.contains(" "), F.substring_index(whole, " ", 1))
        end = F.when(given.rlike(r"[\p{IsHan}\p{IsHangul}]$"), "").when(given.rlike(r"\p{IsCyrillic}$"), F.when(gender == "f", "а").when(gender == "m", "н").otherwise("")).when(given.rlike(r"\p{IsGreek}$"), F.when(gender == "f", "α").when(gender == "m", "ς").otherwise("")).otherwise(F.when(gender == "f", "a").when(gender == "m", "o").otherwise(""))
        first = let(word(F.coalesce(given, whole), attempt), lambda wh: F.concat(_spelled(F.coalesce(given, whole), wh), longer(wh)))
        first = F.when(given.isNull() | (end == "") | (F.length(given) == 1), first).otherwise(F.concat(F.regexp_replace(first, ".$", ""), end))
        rest = lambda w: let(word(w, F.lit(0)), lambda wh: _spelled(w, wh))
        name = F.concat(gender, F.lit(" "), F.array_join(F.transform(parts, lambda w, i: F.when(i == 0, first).otherwise(rest(w))), " "))
        hexed = F.array_join(F.transform(F.filter(F.split(canon, ""), lambda c: c != ""), lambda c, i: F.when(c.rlike("^[0-9]$"), _pick("0123456789", _byte(h, i))).otherwise(_pick("abcdef", _byte(h, i)))), "")
        cased = F.array_join(F.zip_with(F.split(canon, ""), F.split(_spelled(F.lower(canon), h), ""), lambda c, s: F.when(c.rlike("^[A-Z]$"), F.upper(s)).otherwise(s)), "")
        signed = F.array_join(F.transform(F.split(cased, ""), lambda c, i: F.when(c.rlike(r"^[^\p{L}\p{N}\s._-]$"), _pick("!#$%&*+/=?@^~", _byte(h, i + 7))).otherwise(c)), "")
        secret = F.concat(F.when(canon.rlike("^[0-9a-f]+$"), hexed).otherwise(signed), longer(h))
        return F.when(kind == "email", email).when(kind == "ipv4", ipv4).when(kind == "card", card).when(kind == "phone", phone).when(kind == "ssn", ssn).when(kind == "name", name).otherwise(secret)

    return let(hashed, of)


def rendered(kind: Column, m: Column, s: Column) -> Column:
    """A canonical surrogate in the format of the match that it replaces."""
    digits = F.when((kind == "phone") & m.startswith("+"), F.regexp_replace(s, "-", "")).when(kind == "phone", F.substring_index(s, "-", -1)).otherwise(s)

    def placed(digits: Column) -> Column:
        start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"))
        step = lambda a, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(a["text"], F.substr(digits, a["n"] + 1, F.lit(1))).alias("text"), (a["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(a["text"], c).alias("text"), a["n"].alias("n")))
        return F.aggregate(F.filter(F.split(m, ""), lambda c: c != ""), start, step, lambda a: a["text"])

    name = F.substr(s, F.lit(3))
    bare = F.regexp_replace(m, _NAME_HEAD, "")
    name = F.when(bare == F.upper(bare), F.upper(name)).otherwise(F.initcap(name))
    name = F.when(bare.contains("."), F.regexp_replace(name, r"(?<!\p{L})(\p{L})(?= |$)", "$1.")).otherwise(name)
    return (
        F.when(kind == "secret", F.concat(F.regexp_extract(m, _SECRET_HEAD, 1), s))
        .when(kind == "name", F.concat(F.regexp_extract(m, _NAME_HEAD, 1), name))
        .when(kind.isin("card", "phone", "ssn"), let(digits, placed))
        .otherwise(s)
    )


def _found(text: Column) -> Column:
    """array<struct<match, kind, canon>> of a text's entities, in order; kind is null for what stays as it is."""
    entity = lambda m: let(kind_of(m), lambda k: F.struct(m.alias("match"), k.alias("kind"), canonical(k, m).alias("canon")))
    return F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), entity)


def held_entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(h, kind, canon) of the entities of each text, h the text's hash; checkpointed, one scan of the texts."""
    text = F.col(f"`{text_col}`")
    found = docs.select(F.explode(_found(text)).alias("e"), F.sha2(text, 256).alias("h"))
    return cut(found.where(F.col("e.kind").isNotNull()).select("h", "e.kind", "e.canon").distinct())


def _shown(kind: Column, s: Column) -> Column:
    """What two surrogates must differ in: all but the mark of gender that no place shows."""
    return F.when(kind == "name", F.substr(s, F.lit(3))).otherwise(s)


def changed(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, person, attempt) of the entities (kind, canon) whose surrogate had to be drawn again, or that are another canonical form's ``person``."""
    named = entities.where(F.col("kind") == "name").select("kind", "canon", F.substr("canon", F.lit(3)).alias("words"), F.col("canon").startswith("n ").alias("neutral"))
    known = named.where("not neutral").groupBy("words").agg(F.min("canon").alias("person"))
    same = cut(named.where("neutral").join(known, "words").select("kind", "canon", "person"))
    drawn = entities.join(same, ["kind", "canon"], "left_anti").withColumn("attempt", F.lit(0))
    real = entities.select(F.col("kind").alias("k"), _shown(F.col("kind"), F.col("canon")).alias("real")).distinct()
    for _ in range(MAX_ATTEMPTS):
        drawn = drawn.withColumn("s", _shown(F.col("kind"), surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key)))
        rank = F.row_number().over(Window.partitionBy("kind", "s").orderBy("attempt", "canon"))
        marked = drawn.withColumn("again", rank > 1).join(real, (F.col("kind") == F.col("k")) & (F.col("s") == F.col("real")), "left")
        marked = cut(marked.select("kind", "canon", "attempt", (F.col("again") | F.col("real").isNotNull()).alias("again")))
        drawn = marked.select("kind", "canon", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))
        if not marked.where("again").limit(1).count():
            break
    own = drawn.where("attempt > 0").select("kind", "canon", F.col("canon").alias("person"), "attempt")
    others = same.join(own.select("person", "attempt"), "person", "left").select("kind", "canon", "person", F.coalesce("attempt", F.lit(0)).alias("attempt"))
    return own.unionByName(others)


def attempts(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """:func:`changed` of all entities of the texts."""
    return changed(held_entities(docs, text_col).select("kind", "canon").distinct(), key)


#: Entries of texts' maps that may be broadcast: a hash and an entity each.
BROADCAST_ENTRIES = 50_000


#: The session's setting that holds the key.
KEY_SETTING = "auditloom.pii.key"


def session_key(spark: SparkSession) -> str:
    """The session's key; one is drawn where none is set, so that surrogates agree within the session and nobody can work them out again after it."""
    if not spark.conf.get(KEY_SETTING, None):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return spark.conf.get(KEY_SETTING)


def _key(spark: SparkSession, key: str | None) -> str:
    found = key or spark.conf.get(KEY_SETTING, None)
    if not found:
        raise ValueError(f"surrogates need a key: give one, or set {KEY_SETTING}")
    return found


def replace(docs: DataFrame, *, key: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text_col``, n_replaced (long) and replaced_kinds (array of kinds, in order of the text). Without a key, given or set in the session, nothing runs."""
    key = _key(docs.sparkSession, key)
    docs = without(docs, "n_replaced", "replaced_kinds").withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
    text = F.col(f"`{text_col}`")
    held = held_entities(docs, text_col)
    again = held.join(cut(changed(cut(held.select("kind", "canon").distinct()), key)), ["kind", "canon"])
    again = cut(again.select("h", F.concat_ws("|", "kind", "canon").alias("entity"), F.struct("person", "attempt").alias("use")))
    entries = again.count()
    if entries:
        maps = again.groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("entity", "use"))).alias("__again")).withColumnRenamed("h", "__h")
        maps = F.broadcast(maps) if entries <= BROADCAST_ENTRIES else maps
        docs = docs.withColumn("__k", F.sha2(text, 256)).join(maps, F.col("__k") == F.col("__h"), "left").drop("__k", "__h")
        use = lambda e: F.element_at(F.col("__again"), F.concat_ws("|", e["kind"], e["canon"]))
    else:
        docs = docs.withColumn("__again", F.lit(None).cast("map<string,struct<person:string,attempt:int>>"))
        use = lambda e: F.lit(None).cast("struct<person:string,attempt:int>")

    def put(e: Column) -> Column:
        return F.when(e["kind"].isNull(), e["match"]).otherwise(let(use(e), lambda x: let(surrogate(e["kind"], F.coalesce(x["person"], e["canon"]), F.coalesce(x["attempt"], F.lit(0)), key), lambda s: rendered(e["kind"], e["match"], s))))

    def done(found: Column) -> Column:
        gaps = F.split(text, PATTERN, -1)
        joined = F.array_join(F.zip_with(gaps, F.transform(found, put), lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")
        kinds = F.filter(F.transform(found, lambda e: e["kind"]), lambda k: k.isNotNull())
        return F.struct(F.when(F.size(found) == 0, text).otherwise(joined).alias("text"), F.coalesce(kinds, F.array().cast("array<string>")).alias("kinds"))

    out = docs.withColumn("__done", let(F.when(text.isNull(), F.array().cast("array<struct<match:string,kind:string,canon:string>>")).otherwise(_found(text)), done))
    return out.select(*[F.col("__done.text").alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != "__again"], F.size("__done.kinds").cast("long").alias("n_replaced"), F.col("__done.kinds").alias("replaced_kinds"))


def replaced_rows(docs: DataFrame, *, key: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text_col`` and just its own columns (whatever their names)."""
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    done = replace(boxed, key=key)
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col(f"__doc.`{c}`") for c in docs.columns])
