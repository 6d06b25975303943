"""Surrogates for personal data and secrets (operator 5): DataFrame functions only.

1. A quick test picks the texts that can hold an entity.  One regular expression cuts such a text
   into gaps and matches, and each match into parts of a type (an e-mail address's name and domain,
   a person's first and family name by gender, a card number, ...) and literal rest.
2. The distinct parts of the whole table get surrogates from a keyed SHA-256 of type and value: same
   format (digits for digits, letters of the same case and script, separators kept, card numbers
   keep their first digit and check sum, IPv4 octets stay octets, first names keep their gender's
   ending).  So a value has one surrogate wherever it stands.
   Letters of other scripts become letters of a fixed set of their script; in a value without any
   letter or digit (a masked secret) each sign becomes a letter.
3. Collision checks: where two values of a type share a surrogate all but the least value, and where
   a surrogate is itself a value of the table its owner, draw again, until none is left.  A format that
   has no surrogate left after some draws gets longer ones, so the draws come to an end.
4. Each distinct text with entities gets its list of surrogates, joined back by a 128-bit digest of
   the text.  Texts without entities are never shuffled.

Defined results: a null text stays null; an empty or clean text stays as it is; repeated rows get
equal results; other columns are kept (``n_entities`` and ``entity_types`` are added or replaced).
E-mail addresses count without case.  An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "public-example-key"
#: From this draw on a surrogate is longer than its value, by two characters more at each draw.
GROW_FROM = 8

# fixed values: titles and first names by gender, and what surrogate names are made of
TITLES = {"m": ["Mr", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr"],
          "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra"],
          "u": ["Dr", "Prof"]}
FIRST_NAMES = {
    "m": ["James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Charles", "Daniel", "Hans", "Peter",
          "Klaus", "Jürgen", "Wolfgang", "Pierre", "Jean", "Jacques", "Michel", "François", "José", "Juan", "Carlos", "Antonio", "Miguel"],
    "f": ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Anna", "Maria",
          "Ursula", "Monika", "Petra", "Marie", "Nathalie", "Isabelle", "Sylvie", "Catherine", "Carmen", "Ana", "Isabel", "Dolores", "Pilar"]}
_ONSETS = ["b", "d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "t", "v", "z", "br", "tr"]
_VOWELS = ["a", "e", "i", "o"]
_ENDINGS = {"first_m": ["on", "an", "er", "ik"], "first_f": ["a", "ina", "ia", "elle"],
            "first_u": ["is", "en", "ery", "in"], "surname": ["sen", "ley", "mann", "ard"]}

_ALL_TITLES = "|".join(t for ts in TITLES.values() for t in ts)
_ALL_NAMES = "|".join(n for ns in FIRST_NAMES.values() for n in ns)
_NAME = rf"(?<![\p{{L}}\p{{N}}])(?:(?:{_ALL_TITLES})\.?[ ]\p{{Lu}}[\p{{L}}'’-]+(?:[ ]\p{{Lu}}[\p{{L}}'’-]+)?|(?:{_ALL_NAMES})[ ]\p{{Lu}}\p{{Ll}}[\p{{L}}'’-]*)"
# All labels of a domain at once: a possessive repeat needs no stack.  The second form, for domains that end in a
# label of other than letters, goes back label by label.
_EMAIL = (r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]*+@"
          r"(?:(?:[\p{L}\p{N}-]++\.(?=[\p{L}\p{N}-]))++\p{L}{2,}|(?:[\p{L}\p{N}-]++\.){1,100}\p{L}{2,})")
_KEYED = r"""(?<![\p{L}\p{N}])(?i:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key)["']?[ ]?[=:][ ]?["']?[A-Za-z0-9+/_.~@!#%^&*-]{6,}"""
_ACCESS = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
_IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_PHONE = r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?)(?:\(\d{1,5}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,4}(?!\d)|(?<![\p{L}\p{N}(])\(\d{3}\)[ ]?\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_CARD = r"(?<![\d-])\d(?:[ -]?\d){12,18}(?!\d)"
#: Eight groups, or fewer round "::".
_IP6 = (r"(?<![\p{L}\p{N}:])(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
        r"|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){1,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,4})?)(?![\p{L}\p{N}:])")
ENTITY = "|".join([_EMAIL, _KEYED, _ACCESS, _IBAN, _IP6, _IP, _SSN, _CARD, _PHONE, _NAME])
#: A text without a match of this has no entity.
CANDIDATE = rf"[@0-9]|(?i:password|passwd|pwd|passphrase|secret|token|key)[\"']?[ ]?[=:]|(?<!\p{{L}})(?:{_ALL_TITLES}|{_ALL_NAMES})\.?[ ]\p{{Lu}}"


# ---------------------------------------------------------------- parts of a match

def _whole(pattern: str) -> str:
    return rf"^(?:{pattern})$"


def _part(kind: Column | str, value: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), value.alias("value"))


def parts_of(m: Column) -> Column:
    """array(struct(kind, value)) of a match; kind ``keep`` is literal."""
    at = F.instr(m, "@")
    domain = F.lower(F.substr(m, at + 1))
    tld = F.regexp_extract(domain, r"\.\p{L}+$", 0)
    email = F.array(_part("mailbox", F.lower(F.substr(m, F.lit(1), at - 1))), _part("keep", F.lit("@")),
                    _part("domain", F.substr(domain, F.lit(1), F.length(domain) - F.length(tld))), _part("keep", tld))
    lead = F.regexp_extract(m, r"""^(?i:[a-z_-]+)["']?[ ]?[=:][ ]?["']?""", 0)
    keyed = F.array(_part("keep", lead), _part("secret", F.substr(m, F.length(lead) + 1)))
    words = F.split(m, " ")
    title = F.regexp_replace(F.get(words, F.lit(0)), r"\.$", "")
    titled = title.rlike(_whole(_ALL_TITLES))
    first = F.when(titled & (F.size(words) == 3), F.get(words, F.lit(1))).when(~titled, F.get(words, F.lit(0)))
    male, female = title.isin(TITLES["m"]) | first.isin(FIRST_NAMES["m"]), title.isin(TITLES["f"]) | first.isin(FIRST_NAMES["f"])
    first_kind = F.when(male, "first_m").when(female, "first_f").otherwise("first_u")
    surname = F.element_at(words, -1)
    name = F.filter(F.array(
        _part("keep", F.when(titled, F.concat(F.get(words, F.lit(0)), F.lit(" ")))), _part(first_kind, first),
        _part("keep", F.when(first.isNotNull(), F.lit(" "))), _part("surname", surname)), lambda p: p["value"].isNotNull())
    single = (F.when(m.rlike(_whole(_ACCESS)), "access").when(m.rlike(_whole(_IP)), "ip").when(m.rlike(_whole(_IP6)), "ip6").when(m.rlike(_whole(_IBAN)), "iban")
              .when(m.rlike(_whole(_SSN)), "ssn").when(m.rlike(_whole(_CARD)), "card").when(m.rlike(_whole(_PHONE)), "phone"))
    return (F.when(m.rlike(_whole(_EMAIL)), email).when(m.rlike(_whole(_KEYED)), keyed)
            .when(single.isNotNull(), F.array(_part(single, m))).otherwise(name))


# ---------------------------------------------------------------- surrogates

def _draws(key: str, kind: Column, value: Column, draw: Column) -> Column:
    """64 numbers from 0 to 255, from a keyed digest of the value."""
    seed = F.concat_ws("|", F.lit(key), kind, value, draw.cast("string"))
    digest = F.concat(F.sha2(seed, 256), F.sha2(F.concat(F.lit("+"), seed), 256))
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(F.substr(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))


def _pick(choices: str | list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in choices]), (n % len(choices) + 1).cast("int"))


# fixed values: letters by script and case; a letter is replaced by one of its own row
_ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "àáâäãåèéêëìíîïòóôöõùúûüçñ", "ÀÁÂÄÃÅÈÉÊËÌÍÎÏÒÓÔÖÕÙÚÛÜÇÑ",
              "абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]
# fixed values: by script, what its other letters and digits are replaced by
_SCRIPTS = [(r"\p{IsHan}", "山川木林田水火土金石花草風雲雨雪天地日月星空海河湖島村町市里東西南北春夏秋冬白青赤黒大小中上下左右前後"),
            (r"\p{IsHiragana}", "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ"),
            (r"\p{IsKatakana}", "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ"),
            (r"\p{IsHangul}", "가나다라마바사아자차카타파하고노도로모보소오조초코토포호구누두루무부수우주추쿠투푸후"),
            (r"\p{IsArabic}&&\p{L}", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"), (r"\p{IsHebrew}", "אבגדהוזחטיכלמנסעפצקרשת"),
            (r"\p{IsThai}&&\p{L}", "กขคงจฉชซญดตถทธนบปผพฟภมยรลวศสหอ"), (r"\p{IsDevanagari}&&\p{L}", "कखगघचछजझटठडढतथदधनपफबभमयरलवशसह"),
            (r"\p{IsCyrillic}&&\p{Lu}", _ALPHABETS[6]), (r"\p{IsCyrillic}", _ALPHABETS[5]), (r"\p{IsGreek}&&\p{Lu}", _ALPHABETS[8]),
            (r"\p{IsGreek}", _ALPHABETS[7]), (r"\p{Lu}", _ALPHABETS[1]), (r"\p{L}", _ALPHABETS[0]), (r"\p{N}", _ALPHABETS[2])]


def _same_shape(value: Column, numbers: Column, keep: Column | int = 0, alphabets: list[str] = _ALPHABETS) -> Column:
    """Each character replaced by one of its own alphabet, but for the first ``keep`` ones."""
    def swap(c: Column, i: Column) -> Column:
        n = F.element_at(numbers, (i % 64 + 1).cast("int")) + i
        one_of = lambda letters: F.substr(F.lit(letters), n % len(letters) + 1, F.lit(1))
        out = c
        if alphabets is _ALPHABETS:
            for script, letters in reversed(_SCRIPTS):
                out = F.when(c.rlike(f"[{script}]"), one_of(letters)).otherwise(out)
            out = F.when(c.rlike(r"[\p{L}\p{N}]"), out).otherwise(c)
        for letters in reversed(alphabets):
            out = F.when(F.instr(F.lit(letters), c) > 0, one_of(letters)).otherwise(out)
        return F.when(i < keep, c).otherwise(out)

    return F.array_join(F.transform(F.split(value, ""), swap), "")


def _lettered(kind: Column, value: Column) -> Column:
    """The value; one without letters and digits as letters (a domain's dots stay)."""
    return (F.when(value.rlike(r"[\p{L}\p{N}]"), value).when(kind == "domain", F.regexp_replace(value, r"[^.]", "n"))
            .otherwise(F.regexp_replace(value, r"(?s).", "n")))


def _grown(value: Column, draw: Column) -> Column:
    """The value, from a draw on with its last letter or digit repeated at its end."""
    last = F.regexp_extract(value, r"(?s)([\p{L}\p{N}])[^\p{L}\p{N}]*$", 1)
    return F.when(draw < GROW_FROM, value).otherwise(F.concat(value, F.repeat(last, 2 * (draw - GROW_FROM + 1))))


def _luhn_sum(number: Column) -> Column:
    digits = F.reverse(F.transform(F.split(F.regexp_replace(number, r"\D", ""), ""), lambda d: d.cast("int")))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d)


def _card(value: Column, numbers: Column, draw: Column) -> Column:
    body = _same_shape(_grown(value, draw), numbers, 1, _ALPHABETS[2:3])
    cut = F.substr(body, F.lit(1), F.length(body) - 1)
    check = (10 - _luhn_sum(F.concat(cut, F.lit("0"))) % 10) % 10
    return F.when(_luhn_sum(value) % 10 == 0, F.concat(cut, check.cast("string"))).otherwise(body)


def _ip(value: Column, numbers: Column, draw: Column) -> Column:
    """Four octets of as many digits; after some draws any octets."""
    def octet(o: Column, i: Column) -> Column:
        n = F.element_at(numbers, (i + 1).cast("int")) * 256 + F.element_at(numbers, (i + 9).cast("int"))
        other = lambda low, many: (o.cast("int") - low + 1 + n % (many - 1)) % many + low  # noqa: E731  never the same
        return F.when(F.length(o) == 1, other(0, 10)).when(F.length(o) == 2, other(10, 90)).otherwise(other(100, 155)).cast("string")
    same = F.array_join(F.transform(F.split(value, r"\."), octet), ".")
    wide = F.slice(numbers, 17, 4)
    return F.when(draw < GROW_FROM, same).otherwise(F.array_join(wide.cast("array<string>"), "."))


def _person(kind: str, numbers: Column, draw: Column) -> Column:
    """A made-up name: syllables, more of them after some draws, and the kind's ending."""
    n = lambda i: F.element_at(numbers, i)
    syllables = [F.concat(_pick(_ONSETS, n(2 * k + 1)), _pick(_VOWELS, n(2 * k + 2))) for k in range(5)]
    stem = F.concat(syllables[0], syllables[1], F.when(draw > 3, F.concat(syllables[2], syllables[3], syllables[4]))
                    .when(draw > 0, syllables[2]).otherwise(F.lit("")))
    more = F.transform(F.sequence(F.lit(GROW_FROM), draw), lambda k: F.concat(
        _pick(_ONSETS, n((k * 2 % 40 + 21).cast("int"))), _pick(_VOWELS, n((k * 2 % 40 + 22).cast("int")))))
    stem = F.concat(stem, F.when(draw < GROW_FROM, F.lit("")).otherwise(F.array_join(more, "")))
    return F.initcap(F.concat(stem, _pick(_ENDINGS[kind], n(20))))


def surrogate(kind: Column, value: Column, draw: Column, key: str = KEY) -> Column:
    """The surrogate of a part at a draw."""
    # bound to a variable: the digest is taken once a value, not once a character
    return F.get(F.transform(F.array(_draws(key, kind, value, draw)), lambda numbers: _drawn(kind, value, draw, numbers)), F.lit(0))


def _drawn(kind: Column, value: Column, draw: Column, numbers: Column) -> Column:
    name = F.when(kind == "first_m", _person("first_m", numbers, draw)).when(kind == "first_f", _person("first_f", numbers, draw))
    name = name.when(kind == "first_u", _person("first_u", numbers, draw)).otherwise(_person("surname", numbers, draw))
    latin = value.rlike(r"^[\p{IsLatin}'’-]+$")
    phone_lead = F.length(F.regexp_extract(value, r"^\+\d{1,3}", 0))
    card, ip = _card(value, numbers, draw), _ip(value, numbers, draw)
    ip6 = _same_shape(value, numbers, 0, ["0123456789", "abcdef", "ABCDEF"])
    value = _grown(_lettered(kind, value), draw)
    return (F.when(kind == "card", card).when(kind == "ip", ip).when(kind == "ip6", ip6)
            .when(kind.isin("first_m", "first_f", "first_u", "surname") & latin, name)
            .when(kind == "phone", _same_shape(value, numbers, phone_lead, _ALPHABETS[2:3]))
            .when(kind == "ssn", _same_shape(value, numbers, 0, _ALPHABETS[2:3]))
            .when(kind == "access", _same_shape(value, numbers, 4, ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"]))
            .when(kind == "iban", _same_shape(value, numbers, 2, ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"]))
            .when((kind == "secret") & value.rlike("^[0-9a-f]+$"), _same_shape(value, numbers, 0, ["abcdef", "0123456789"]))
            .otherwise(_same_shape(value, numbers)))


def assign(parts: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, value, surrogate) for the distinct (kind, value): distinct within a kind, and none a
    value of its kind that occurs."""
    # few bytes but much work a row: spread over the cluster, not packed into one task by size
    spread = 2 * parts.sparkSession.sparkContext.defaultParallelism
    values = parts.select("kind", "value").where(F.col("kind") != "keep").distinct().repartition(spread, "kind", "value")
    now = (values.withColumn("draw", F.lit(0))
           .withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), F.col("draw"), key)).checkpoint())
    for draw in count(1):       # ends: surrogates grow past every value
        owners = now.groupBy("kind", "surrogate").agg(F.min("value").alias("owner"), F.count("*").alias("n"))
        # narrow: only surrogates that are shared or real
        shared = owners.where(F.col("n") > 1).select("kind", "surrogate", "owner")
        real = (owners.join(now.select("kind", F.col("value").alias("surrogate")), ["kind", "surrogate"], "left_semi")
                .select("kind", "surrogate", F.lit(None).cast("string").alias("owner")))
        bad = shared.unionByName(real).groupBy("kind", "surrogate").agg(F.when(F.count("*") == F.count("owner"), F.max("owner")).alias("owner")).checkpoint()
        if bad.isEmpty():
            return now.select("kind", "value", "surrogate")
        again = (now.join(bad.withColumn("__bad", F.lit(True)), ["kind", "surrogate"], "left")
                 .withColumn("__again", F.coalesce(F.col("__bad") & ~F.col("value").eqNullSafe(F.col("owner")), F.lit(False))))
        now = again.select(
            "kind", "value", F.when(F.col("__again"), draw).otherwise(F.col("draw")).alias("draw"),
            F.when(F.col("__again"), surrogate(F.col("kind"), F.col("value"), F.lit(draw), key)).otherwise(F.col("surrogate")).alias("surrogate")).checkpoint()


def replace(df: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """``df`` with every entity in ``text`` replaced, n_entities and entity_types (sorted)."""
    df = df.drop(*(c for c in ("n_entities", "entity_types") if c in df.columns))
    columns = df.columns
    hit = F.coalesce(F.col(text).rlike(CANDIDATE), F.lit(False))
    none = F.array().cast("array<string>")
    clean = df.where(~hit).withColumn("n_entities", F.lit(0).cast("long")).withColumn("entity_types", none)
    digest = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), text).alias("b"), F.char_length(text).alias("n"))
    maybe = df.where(hit).withColumn("__key", digest)

    found = (maybe.select("__key", F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)).alias("m")).where(F.size("m") > 0)
             .groupBy("__key").agg(F.first("m").alias("m"))
             .select("__key", F.posexplode("m").alias("i", "m"))
             .select("__key", "i", F.posexplode(parts_of(F.col("m"))).alias("j", "p"))
             .select("__key", "i", "j", "p.kind", "p.value").checkpoint())
    table = assign(found, key)
    lists = (found.join(table, ["kind", "value"], "left")
             .groupBy("__key").agg(
                 F.array_sort(F.collect_list(F.struct("i", "j", F.coalesce("surrogate", "value").alias("s")))).alias("__subs"),
                 (F.max("i") + 1).cast("long").alias("n_entities"),
                 F.array_sort(F.collect_set(F.when(F.col("kind") != "keep", F.col("kind")))).alias("entity_types")))
    gaps = F.split(F.col(text), ENTITY, -1)
    rows = maybe.join(lists, "__key", "left").withColumn("__gaps", F.when(F.col("__subs").isNotNull(), gaps))
    middle = F.array_join(F.transform("__subs", lambda x: F.when(x["j"] == 0, F.concat(F.get("__gaps", x["i"]), x["s"])).otherwise(x["s"])), "")
    rows = (rows.withColumn(text, F.when(F.col("__subs").isNull(), F.col(text)).otherwise(F.concat(middle, F.element_at("__gaps", -1))))
            .withColumn("n_entities", F.coalesce("n_entities", F.lit(0).cast("long"))).withColumn("entity_types", F.coalesce("entity_types", none)))
    return clean.unionByName(rows.select(*columns, "n_entities", "entity_types"))
