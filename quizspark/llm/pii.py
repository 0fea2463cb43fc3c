"""Personal data replaced by surrogates (SQL functions only).

Entities: e-mail addresses, IPv4 addresses, payment card numbers, telephone
numbers, social security numbers and persons behind a title. Each distinct
entity (kind and canonical form) gets one surrogate, drawn from SHA-512 of a
secret key, the kind, the canonical form and an attempt number:

* e-mail: letters become letters of the same script and case, digits digits,
  the shape of the local part and domain stays, the domain ends in ``.example``;
* card: 16 digits with a right check digit; phone: as many digits (see below), the
  country code's first digit kept; both take the punctuation of each occurrence;
* IPv4: an address in 10.0.0.0/8; ssn: digits in the same places;
* person: given and family names built of syllables of the same script
  (Latin, Cyrillic, Greek), ending by the title's gender; the titles stay. A name
  has any number of capitalised words and initials, with particles (de, von, van)
  before them; each of them, initials and particles too, becomes a name.

Collision checks: of several entities with one surrogate the first keeps it,
and so does none whose surrogate is itself an entity of the corpus; the others
draw again with the next attempt, until no collision is left. What can be drawn
grows with the attempt, so that collisions settle for any number of entities:
names get one syllable more each time; from the attempt ``SHAPED`` on e-mails get
one letter more at the end of the local part, telephone and social security
numbers one digit more at their end; addresses go from 10.0.0.0/8 to the reserved
240.0.0.0/4, and then to first numbers over 255, which no host has. Only cards
stay as they are (10^14 values). So distinct
entities stay distinct and each keeps one surrogate in all documents
(coreference), whatever punctuation it is written with.

Documents that hold entities are written to the shared folder once, under row
numbers; their entities are joined to the surrogate table and grouped back by
row, so one group is one document's entities.

Defined results: null texts stay null; texts without entities are unchanged;
repeated rows get equal texts; an empty table gives an empty result; all other
columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizspark.llm.common import fresh, shared_table
from quizspark.llm.spans import matches

_W = r"[\p{L}\p{N}]"
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Fräulein", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Sra", "Dra", "Señorita", "Srta",
          "Signora", "Madam", "Dame", "Госпожа", "Κυρία")
_TITLES = "|".join((*FEMALE, *"Mr Mx Dr Prof Professor Doctor Doktor Sir Rev Herr Monsieur Señor Sr Signor Господин Доктор Профессор Κύριος Δρ".split()))
#: One word of a name: particles before it, then a capitalised word or initials. The next person's title is none.
_NAME = (r"(?:(?:(?:van|von)(?: (?:der|den|dem))?|de(?: (?:la|las|los))?|del|della|di|da|dos|du|des|la|le|ter|ten|af|av|bin|ibn|al|el|y|фон) |d['’]|(?:al|el)-)*+"
         rf"(?!(?:{_TITLES})\.? \p{{Lu}})"
         r"(?:\p{Lu}[\p{L}'’-]+|(?:\p{Lu}\.-?)++|\p{Lu}(?!\p{L}))")
#: (kind, pattern), tried in this order at each place.
KINDS = [
    ("email", rf"(?<![\p{{L}}\p{{N}}._%+-]){_W}[\p{{L}}\p{{N}}._%+-]*+@{_W}[\p{{L}}\p{{N}}-]*+(?:\.{_W}[\p{{L}}\p{{N}}-]*+)+"),
    ("ip", r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)"),
    ("card", r"(?<!\d)\d{4}(?:[ -]?\d{4}){3}(?!\d)"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("phone", r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\d(])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\d)"),
    ("person", rf"(?<![\p{{L}}])(?:(?:{_TITLES})\.? ){{1,5}}{_NAME}(?: {_NAME})*+"),
]
PATTERN = "|".join(f"(?:{p})" for _, p in KINDS)
_TITLE = rf"^(?:(?:{_TITLES})\.? ){{1,5}}"
#: Syllables and endings by script: (syllables, male ending, female ending).
NAMES = {
    "latin": ("ba de fi go lu ma ne ri so ta ve wi".split(), "n", "na"),
    "cyrillic": ("ба де ви го лу ма не ри со та ве ди".split(), "н", "на"),
    "greek": ("βα δε φι γο λυ μα νε ρι σο τα βε δι".split(), "ς", "να"),
}
#: Attempts that keep an entity's shape.
SHAPED = 4
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}


def kind_of(value: Column) -> Column:
    out = F.lit(KINDS[-1][0])
    for kind, pattern in reversed(KINDS[:-1]):
        out = F.when(value.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def _female(value: Column) -> Column:
    return F.regexp_extract(value, _TITLE, 0).rlike(rf"(?:^| )(?:{'|'.join(FEMALE)})\.? ")


def canonical(kind: Column, value: Column) -> Column:
    """What is the same for all ways to write an entity."""
    return (F.when(kind == "email", F.lower(value))
            .when(kind == "ip", value)
            .when(kind == "phone", F.concat(F.when(value.startswith("+"), "+").otherwise(""), _digits(value)))
            .when(kind == "person", F.concat(F.when(_female(value), "f ").otherwise("m "), F.replace(F.regexp_replace(value, _TITLE, ""), F.lit("."), F.lit(""))))
            .otherwise(_digits(value)))


def _byte(stream: Column, i: Column | int) -> Column:
    """i-th number (0 to 65535) of a stream of 128 hex digits; repeats after 31."""
    at = (F.lit(i) if isinstance(i, int) else i) % 31
    return F.conv(F.substr(stream, at * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _letter(c: Column, n: Column, script: str) -> Column:
    letters = ALPHABETS[script]
    x = F.substr(F.lit(letters), n % len(letters) + 1, F.lit(1))
    return F.when(c.rlike(r"^\p{Lu}$"), F.upper(x)).otherwise(x)


def _same_shape(value: Column, stream: Column) -> Column:
    """Digits to digits, letters to letters of the script; the rest stays."""
    def one(i: Column) -> Column:
        c, n = F.substr(value, i, F.lit(1)), _byte(stream, i)
        return (F.when(c.rlike("^[0-9]$"), (n % 10).cast("string"))
                .when(c.rlike(r"^\p{IsCyrillic}$"), _letter(c, n, "cyrillic"))
                .when(c.rlike(r"^\p{IsGreek}$"), _letter(c, n, "greek"))
                .when(c.rlike(r"^\p{L}$"), _letter(c, n, "latin")).otherwise(c))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), one), "")


def _card(stream: Column) -> Column:
    digits = F.transform(F.sequence(F.lit(1), F.lit(15)), lambda i: F.when(i == 1, F.lit(4)).otherwise(_byte(stream, i) % 10))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    total = F.aggregate(doubled, F.lit(0), lambda a, d: a + d)
    return F.concat(F.array_join(F.transform(digits, lambda d: d.cast("string")), ""), ((10 - total % 10) % 10).cast("string"))


def _name(word: Column, stream: Column, at: Column, female: Column, attempt: Column) -> Column:
    """Four syllables and one more for each attempt."""
    more = F.sha2(F.concat(stream, at.cast("string")).cast("binary"), 512)

    def of(script: str) -> Column:
        syllables, male, female_end = NAMES[script]
        pick = lambda n: F.element_at(F.array(*[F.lit(s) for s in syllables]), n % len(syllables) + 1)
        longer = F.array_join(F.transform(F.sequence(F.lit(0), attempt), lambda k: F.when(k > 0, pick(_byte(more, k))).otherwise("")), "")
        return F.initcap(F.concat(*[pick(_byte(stream, at * 5 + k)) for k in (1, 2, 3, 4)], longer, F.when(female, female_end).otherwise(male)))
    return (F.when(word.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(word.rlike(r"\p{IsGreek}"), of("greek")).otherwise(of("latin")))


def draw(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """Canonical form of the surrogate."""
    stream = F.sha2(F.concat_ws("\u0001", F.lit(key), kind, canon, attempt.cast("string")).cast("binary"), 512)
    female, names = canon.startswith("f "), F.split(F.substr(canon, F.lit(3)), " ")
    extra = F.greatest(attempt - (SHAPED - 1), F.lit(0)).cast("int")
    longer = lambda c, x: _same_shape(F.concat(c, F.repeat(x, extra)), stream)
    phone = F.when(canon.startswith("+"), F.concat(F.substr(canon, F.lit(1), F.lit(2)), longer(F.substr(canon, F.lit(3)), F.lit("0")))
                   ).otherwise(longer(canon, F.lit("0")))
    local = F.regexp_extract(canon, "^([^@]*)@", 1)
    letter = F.when(local.rlike(r"\p{IsCyrillic}"), "а").when(local.rlike(r"\p{IsGreek}"), "α").otherwise("a")
    ip = lambda first, size: F.concat_ws(".", first.cast("string"), *[(_byte(stream, i) % size).cast("string") for i in (1, 2, 3)])
    host = F.regexp_replace(F.regexp_extract(canon, "@(.*)$", 1), r"\.[^.]*$", "")
    return (F.when(kind == "email", F.concat(longer(local, letter), F.lit("@"),
                                             _same_shape(host, F.sha2(stream.cast("binary"), 512)), F.lit(".example")))
            .when(kind == "ip", F.when(attempt < SHAPED, ip(F.lit(10), 256)).when(attempt < 2 * SHAPED, ip(_byte(stream, 4) % 16 + 240, 256))
                  .otherwise(ip(_byte(stream, 4) % 744 + 256, 1000)))
            .when(kind == "card", _card(stream))
            .when(kind == "phone", phone)
            .when(kind == "person", F.concat(F.when(female, "f ").otherwise("m "), F.array_join(
                F.transform(names, lambda w, i: _name(w, stream, i, female, attempt)), " ")))
            .otherwise(longer(canon, F.lit("0"))))


def formatted(kind: Column, value: Column, surrogate: Column) -> Column:
    """The surrogate written the way the occurrence is; digits it has more follow
    at the end."""
    digits = _digits(surrogate)
    placed = F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.when(
        F.substr(value, i, F.lit(1)).rlike("^[0-9]$"),
        F.substr(digits, F.length(_digits(F.substr(value, F.lit(1), i))), F.lit(1))).otherwise(F.substr(value, i, F.lit(1)))), "")
    placed = F.concat(placed, F.substr(digits, F.length(_digits(value)) + 1))
    return (F.when(kind.isin("card", "phone", "ssn"), placed)
            .when(kind == "person", F.concat(F.regexp_extract(value, _TITLE, 0), F.substr(surrogate, F.lit(3))))
            .otherwise(surrogate))


def surrogates(entities: DataFrame, key: str, max_rounds: int = 50) -> DataFrame:
    """(kind, canon, surrogate) from distinct (kind, canon); see the module's
    collision checks."""
    real = entities.select("kind", F.col("canon").alias("surrogate"))
    cur = shared_table(entities.withColumn("attempt", F.lit(0)).withColumn("settled", F.lit(False)))
    for _ in range(max_rounds):
        drawn = cur.withColumn("surrogate", draw(F.col("kind"), F.col("canon"), F.col("attempt"), key))
        # a surrogate settled in an earlier round keeps its place
        first = drawn.groupBy("kind", "surrogate").agg(
            F.min(F.struct((~F.col("settled")).alias("late"), F.col("canon").alias("canon"))).alias("first"))
        taken = first.join(real, ["kind", "surrogate"], "left_semi").select("kind", "surrogate", F.lit(True).alias("is_real"))
        state = (drawn.join(first, ["kind", "surrogate"]).join(taken, ["kind", "surrogate"], "left")
                 .withColumn("ok", F.col("is_real").isNull() & (F.col("first.canon") == F.col("canon"))))
        cur = shared_table(state.select("kind", "canon", "surrogate", F.col("ok").alias("settled"),
                                        F.when(F.col("ok"), F.col("attempt")).otherwise(F.col("attempt") + 1).alias("attempt")))
        if cur.where(~F.col("settled")).isEmpty():
            return cur.select("kind", "canon", "surrogate")
        cur = cur.drop("surrogate")
    raise RuntimeError(f"surrogates still collide after {max_rounds} rounds: {cur.where('not settled').count()} entities")


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with every entity in ``text`` replaced, and the column
    ``pii_kinds``: the kind of each replaced entity, in order (may be empty)."""
    if not key:
        raise ValueError("a secret key is needed")
    ents, rid, kinds = fresh(docs, "pii_found"), fresh(docs, "pii_row"), fresh(docs, "pii_kinds")
    has = F.coalesce(F.col("text").rlike(PATTERN), F.lit(False))
    none = F.array().cast("array<string>")
    plain = docs.where(~has).withColumn(kinds, none)
    found = F.transform(matches(F.col("text"), PATTERN), lambda m: m["value"])
    rows = shared_table(docs.where(has).withColumn(ents, found).withColumn(rid, F.monotonically_increasing_id()))
    each = (rows.select(F.col(rid).alias("rid"), F.posexplode(ents).alias("i", "value"))
            .withColumn("kind", kind_of(F.col("value"))).withColumn("canon", canonical(F.col("kind"), F.col("value"))))
    each = shared_table(each)
    table = surrogates(each.select("kind", "canon").distinct(), key)
    new = (each.join(table, ["kind", "canon"])
           .select("rid", F.struct("i", "kind", formatted(F.col("kind"), F.col("value"), F.col("surrogate")).alias("new")).alias("e"))
           .groupBy("rid").agg(F.array_sort(F.collect_list("e")).alias("new_values")).withColumnRenamed("rid", rid))
    new = new.withColumnRenamed("new_values", "new" + rid)
    pieces = F.split("text", PATTERN, -1)
    text = F.concat(F.array_join(F.zip_with(F.slice(pieces, 1, F.size("new" + rid)), F.transform("new" + rid, lambda e: e["new"]),
                                            lambda a, b: F.concat(a, b)), ""), F.element_at(pieces, -1))
    changed = (rows.join(new, rid).withColumn(kinds, F.transform("new" + rid, lambda e: e["kind"]))
               .withColumn("text", text))
    keep = [F.col(f"`{c}`") for c in docs.columns] + [F.col(kinds)]
    return plain.select(*keep).unionByName(changed.select(*keep))
