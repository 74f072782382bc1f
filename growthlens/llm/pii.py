"""Personal data: surrogates of the same type, script and format.

Entities are found by fixed patterns: e-mail and IP addresses, phone, card and social
security numbers, long hexadecimal secrets, and names after a form of address. A text
is split at its entities, each is replaced, and the pieces are joined again, so nothing
else of a text changes.

A surrogate is a keyed permutation of the entity's own characters: two rounds of a
Feistel network over two halves, in which SHA-256 of the key, the entity's type and one
half shifts the other, then a step that moves every character, then the two rounds
backwards. As the step leaves nothing in its place, no entity keeps its value, however
short it is. A letter stays a letter of its alphabet (vowel or consonant in
names), a digit a digit; case, punctuation, length and the parts that carry the type
(country code, top-level domain) stay. Addresses stay valid, the check digit of a card
number stays right or wrong as it was. In names the form of address and the last
letter of every word, which carry the gender, stay.

Being a permutation among the entities of one format, it never gives two entities the
same surrogate, and one entity gets the same surrogate wherever, in whatever case and
with whatever punctuation it occurs: no lookup table has to be joined to the texts. A name
is replaced word by word, so a surname stays one person's with and without the given
name, and words of a text's names are replaced where they stand in it without a form of
address too. The entities are collected once as a distinct table, and the check over it
moves on to the next key while two entities meet, and fails if they do under all keys. An
entity without a character of the alphabets keeps its value and is counted.

Everything is DataFrame code; texts are read whole and not shuffled.

Defined results: a null text stays null, an empty one empty. Texts without entities stay
as they are. An entity none of whose moving letters is in an alphabet stays. Repeated
rows, null ids and other columns are passed over; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from growthlens.llm.common import written

KEY = "surrogates-1"
ROUNDS = 4  # half of them there, half of them back
TRIES = 8  # keys that are tried
ENTITIES_PER_TASK = 20_000  # distinct entities that a task checks

#: Forms of address that a name follows, as they stand here or in capitals.
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señora", "Señor", "Sra", "Sr", "Господин", "Госпожа", "Κύριος", "Κυρία"]
TITLE = "|".join(t for title in TITLES for t in (title, title.upper()))

#: The entities' patterns, in the order in which they are tried.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}",
    "secret": r"(?<![0-9A-Za-z])(?=[a-fA-F]*[0-9])(?=[0-9]*[a-fA-F])[0-9a-fA-F]{32,}+(?![0-9A-Za-z])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])",
    "name": r"(?<![\p{L}])(?:" + TITLE + r")\.? \p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’-]+){0,2}",
}
NAME_WORD = r"(?<![\p{L}])\p{Lu}[\p{L}'’-]+"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
HINT = rf"[0-9@]|(?:{TITLE})\.? "

#: The alphabets within which characters move; a character of none of them stays.
LETTERS, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
NAME_ALPHABETS = (
    "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåèéêëìíîïòóôõöøùúûü", "çñšč",
    "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ",
    "āăąēĕėęěĩīĭįıōŏőũūŭůűų", "ćĉċďĝğġģĥħĵķĺļľłńņňŕŗřśŝşťţŵŷźżđž", "ђјљњћџґїіє", "աեէըիոօ", "բգդզթժլխծկհձղճմյնշչպջռսվտրցւփքֆ",
)


def kind_of(raw: Column) -> Column:
    """The first pattern that an entity as a whole matches."""
    out = F.lit("name")
    for kind, pattern in reversed(list(PATTERNS.items())):
        if kind != "name":
            out = F.when(raw.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _plain(e: Column) -> Column:
    """The characters that are permuted, lower case and without punctuation."""
    body = F.lower(e["body"])
    digits = F.regexp_replace(body, "[^0-9]", "")
    octet = lambda i: F.lpad(F.lower(F.hex(F.split_part(body, F.lit("."), F.lit(i)).cast("int"))), 2, "0")
    address = F.concat(*[octet(i) for i in range(1, 5)])
    return (
        F.when(e["kind"] == "ip", address)
        .when(e["kind"] == "card", F.substring(digits, F.lit(1), F.length(digits) - 1))
        .when(e["kind"].isin("phone", "ssn"), digits)
        .when(e["kind"] == "name", F.regexp_replace(body, r"[^\p{L}]", ""))
        .otherwise(F.regexp_replace(body, "[^0-9a-z]", ""))
    )


def _parts(raw: Column, kind: Column) -> Column:
    """Fixed beginning, permuted body and fixed end of an entity."""
    title = F.regexp_extract(raw, r"^(\p{L}+\.? )", 1)
    code = F.regexp_extract(raw, r"^(\+[0-9]{1,3})(?=[^0-9])", 1)
    domain = F.regexp_extract(raw, r"(\.[A-Za-z]+)$", 1)
    head = F.when(kind == "phone", code).when(kind == "name", title).otherwise("")
    tail = F.when(kind == "email", domain).when(kind == "name", F.substring(raw, -1, 1)).otherwise("")
    body = F.substring(raw, F.length(head) + 1, F.length(raw) - F.length(head) - F.length(tail))
    return F.struct(raw.alias("raw"), kind.alias("kind"), head.alias("head"), body.alias("body"), tail.alias("tail"))


def _shift(text: Column, stream: Column, kind: Column, how: str = "on") -> Column:
    """Each character moved within its alphabet by a byte of ``stream``: ``on``, ``back``, or ``off`` its place in any case."""

    def moved(c: Column, byte: Column, alphabet: str, otherwise: Column) -> Column:
        place, n = F.instr(F.lit(alphabet), c), len(alphabet)
        step = {"on": byte, "back": n - byte % n, "off": 1 + byte % (n - 1)}[how]
        return F.when(place > 0, F.substring(F.lit(alphabet), (place - 1 + step) % n + 1, F.lit(1))).otherwise(otherwise)

    def one(c: Column, j: Column, once: Column) -> Column:
        byte = F.conv(F.substring(once, (2 * j) % 64 + 1, F.lit(2)), 16, 10).cast("int")
        named = c
        for alphabet in reversed(NAME_ALPHABETS):
            named = moved(c, byte, alphabet, named)
        plain = moved(c, byte, LETTERS, moved(c, byte, DIGITS, c))
        return F.when(kind.isin("ip", "secret"), moved(c, byte, HEX, c)).when(kind == "name", named).otherwise(plain)

    # The array of one binds the stream, which would be computed again for every character.
    moved_text = F.transform(F.array(stream), lambda once: F.array_join(F.transform(F.split(text, ""), lambda c, j: one(c, j, once)), ""))[0]
    return F.when(F.length(text) == 0, "").otherwise(moved_text)


def _permuted(entities: Column, key: str) -> Column:
    """The entities with ``out``, their permuted characters. One ``transform`` per round keeps expressions small."""

    def halves(e: Column) -> Column:
        plain = _plain(e)
        cut = F.floor(F.length(plain) / 2).cast("int")
        left, right = F.substring(plain, F.lit(1), cut), F.substring(plain, cut + 1, F.length(plain))
        return F.struct(e.alias("e"), left.alias("a"), right.alias("b"))

    def round_of(i: int, how: str):
        def turn(s: Column) -> Column:
            still, moving = (s["b"], s["a"]) if i % 2 == 0 else (s["a"], s["b"])
            secret = F.concat_ws("|", F.lit(f"{key}|{i}"), s["e"]["kind"], F.length(moving).cast("string"), still)
            new = _shift(moving, F.sha2(secret, 256), s["e"]["kind"], how)
            a, b = (new, still) if i % 2 == 0 else (still, new)
            return F.struct(s["e"].alias("e"), a.alias("a"), b.alias("b"))

        return turn

    def off(s: Column) -> Column:
        """Depends on the format alone, so between the rounds and their inverse it makes a permutation without fixed points."""
        secret = F.concat_ws("|", F.lit(f"{key}|off"), s["e"]["kind"], F.length(s["b"]).cast("string"))
        a, b = (_shift(s[half], F.sha2(F.concat(secret, F.lit(f"|{half}")), 256), s["e"]["kind"], "off") for half in ("a", "b"))
        return F.struct(s["e"].alias("e"), a.alias("a"), b.alias("b"))

    state = F.transform(entities, halves)
    there = [round_of(i, "on") for i in range(ROUNDS // 2)]
    back = [round_of(i, "back") for i in reversed(range(ROUNDS // 2))]
    for step in (*there, off, *back):
        state = F.transform(state, step)
    return F.transform(state, lambda s: F.struct(s["e"].alias("e"), F.concat(s["a"], s["b"]).alias("out")))


def _luhn(digits: Column) -> Column:
    """Check digit that belongs behind ``digits``."""

    def value(j: Column) -> Column:
        d = F.substring(digits, j, F.lit(1)).cast("int")
        doubled = (F.length(digits) - j) % 2 == 0
        return F.when(doubled, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    values = F.transform(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), value)
    return (10 - F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10) % 10


def _surrogate(p: Column) -> Column:
    """Put the permuted characters into the entity's format."""
    e, out = p["e"], p["out"]
    body = e["body"]
    numbers = [F.conv(F.substring(out, F.lit(1 + 2 * i), F.lit(2)), 16, 10) for i in range(4)]
    address = F.concat_ws(".", *numbers)
    digits = F.regexp_replace(body, "[^0-9]", "")
    before = F.substring(digits, F.lit(1), F.length(digits) - 1)
    error = F.substring(digits, -1, 1).cast("int") + 10 - _luhn(before)
    filled = F.when(e["kind"] == "card", F.concat(out, ((_luhn(out) + error) % 10).cast("string"))).otherwise(out)
    moves = F.when(e["kind"].isin("phone", "ssn", "card"), "[^0-9]").when(e["kind"] == "name", r"[^\p{L}]").otherwise("[^0-9A-Za-z]")

    # Moving characters take the new ones in order; with their places both sides sort back into the body.
    characters = F.transform(F.split(body, ""), lambda c, j: F.struct(j.alias("j"), c.alias("c")))
    moving = F.filter(characters, lambda x: F.regexp_replace(x["c"], moves, F.lit("")) != "")
    fixed = F.filter(characters, lambda x: F.regexp_replace(x["c"], moves, F.lit("")) == "")
    cased_new = lambda x, new: F.when(x["c"] != F.lower(x["c"]), F.upper(new)).otherwise(new)
    new = F.zip_with(moving, F.split(filled, ""), lambda x, n: F.struct(x["j"].alias("j"), F.coalesce(cased_new(x, n), F.lit("")).alias("c")))
    both = F.array_sort(F.concat(F.filter(new, lambda x: x["j"].isNotNull()), fixed))
    written_out = F.when(F.length(body) == 0, "").otherwise(F.array_join(F.transform(both, lambda x: x["c"]), ""))
    # A secret has no punctuation and may be long.
    cased = F.zip_with(F.split(body, ""), F.split(out, ""), lambda c, new: F.when(c != F.lower(c), F.upper(new)).otherwise(new))
    body_out = F.when(e["kind"] == "ip", address).when(e["kind"] == "secret", F.array_join(cased, "")).otherwise(written_out)
    return F.concat(e["head"], body_out, e["tail"])


def _found(text: Column) -> Column:
    matches = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    return F.when(text.rlike(HINT), matches).otherwise(F.array().cast("array<string>"))


def _described(raws: Column, key: str) -> Column:
    """Per entity: ``e`` (raw, kind, parts), ``out``, and the ``surrogate``."""
    entities = F.transform(raws, lambda raw: _parts(raw, kind_of(raw)))
    return F.transform(_permuted(entities, key), lambda p: F.struct(p["e"].alias("e"), p["out"].alias("out"), _surrogate(p).alias("surrogate")))


def _pieces(value: Column, raws: Column) -> Column:
    """Parts of the text with the entity behind each: ``before, raw``. A name gives one for each of its words."""

    def of_entity(before: Column, raw: Column) -> Column:
        title = F.regexp_extract(raw, rf"^((?:{TITLE})\.? )", 1)
        words = F.split(F.substring(raw, F.length(title) + 1, F.length(raw)), " ")
        named = F.transform(
            words, lambda w, j: F.struct(F.when(j == 0, F.concat(before, title)).otherwise(F.lit(" ")).alias("before"), w.alias("raw"))
        )
        return F.when(F.length(title) > 0, named).otherwise(F.array(F.struct(before.alias("before"), raw.alias("raw"))))

    between = F.split(value, ANY, -1)
    return F.flatten(F.zip_with(F.slice(between, F.lit(1), F.size(raws)), raws, of_entity))


def _is_word(raw: Column) -> Column:
    """Whether an entity is a word of a name; all others hold a digit or an at sign."""
    return ~raw.rlike("[0-9@]")


def _bare(text: Column, names: Column, surrogates: Column) -> Column:
    """``text`` with surrogates for words that are names elsewhere in the same text."""
    found = F.regexp_extract_all(text, F.lit(NAME_WORD), F.lit(0))
    new = F.transform(found, lambda w: F.coalesce(F.get(surrogates, F.nullif(F.array_position(names, w), F.lit(0)).cast("int") - 1), w))
    parts = F.zip_with(F.split(text, NAME_WORD, -1), new, lambda t, w: F.concat(t, F.coalesce(w, F.lit(""))))
    return F.array_join(parts, "")


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """The distinct entities ``raw`` of a corpus, names word by word, copies combined before the shuffle."""
    raws = _found(F.col(text))
    units = F.when(F.size(raws) > 0, F.transform(_pieces(F.col(text), raws), lambda u: u["raw"]))
    return docs.select(F.explode(units).alias("raw")).distinct()


def surrogates(raws: DataFrame, key: str) -> DataFrame:
    """``raw, kind, plain, surrogate, surrogate_plain`` per entity; ``plain`` names the entity whatever its form."""
    one = raws.select("raw", _described(F.array("raw"), key)[0].alias("d"))
    plain = F.concat_ws("|", F.lower(F.col("d.e.head")), _plain(F.col("d.e")), F.lower(F.col("d.e.tail")))
    out = F.concat_ws("|", F.lower(F.col("d.e.head")), F.col("d.out"), F.lower(F.col("d.e.tail")))
    return one.select("raw", F.col("d.e.kind").alias("kind"), plain.alias("plain"), F.col("d.surrogate").alias("surrogate"), out.alias("surrogate_plain"))


def clashes(described: DataFrame) -> DataFrame:
    """Surrogates that two entities share, and entities that keep their value."""
    pairs = described.select("kind", "plain", "surrogate_plain", (F.col("raw") == F.col("surrogate")).alias("same")).distinct()
    by_surrogate = pairs.groupBy("kind", "surrogate_plain").agg(F.countDistinct("plain").alias("n"), F.max("same").alias("same"))
    return by_surrogate.filter("n > 1 or same")


def checked_key(docs: DataFrame, key: str = KEY, text: str = "text") -> str:
    """The first of ``TRIES`` keys under which no two entities share a surrogate; none is an error.

    Entities without a movable character keep their value under every key: ``n_kept`` counts them by row.
    """
    raws = written(entities(docs, text), "entities")
    raws = raws.repartition(max(1, -(-raws.count() // ENTITIES_PER_TASK)), "raw")
    for i in range(TRIES):
        candidate = f"{key}/{i}"
        if clashes(surrogates(raws, candidate)).filter("n > 1").isEmpty():
            return candidate
    raise ValueError(f"entities share surrogates under all of {TRIES} keys")


def replace_entities(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text``; adds ``n_entities``, ``kinds`` (their types, in order) and ``n_kept``
    (entities and words of names without a character that could move, which stay as they are)."""
    value = F.col(text)
    marked = docs.withColumn("_raws", F.coalesce(_found(value), F.array().cast("array<string>")))
    some = F.size("_raws") > 0
    marked = marked.withColumn("_units", F.when(some, _pieces(value, F.col("_raws"))))
    marked = marked.withColumn("_new", F.when(some, F.transform(_described(F.transform("_units", lambda u: u["raw"]), key), lambda d: d["surrogate"])))
    words = F.filter(F.arrays_zip(F.transform("_units", lambda u: u["raw"]).alias("raw"), F.col("_new").alias("new")), lambda x: _is_word(x["raw"]))
    marked = marked.withColumn("_words", F.when(some, words))
    marked = marked.withColumns({"_names": F.transform("_words", lambda x: x["raw"]), "_other": F.transform("_words", lambda x: x["new"])})
    named = F.size("_names") > 0
    rest = F.element_at(F.split(value, ANY, -1), -1)
    plain = F.concat(F.array_join(F.zip_with("_units", "_new", lambda u, n: F.concat(u["before"], n)), ""), rest)
    bare = lambda t: _bare(t, F.col("_names"), F.col("_other"))
    linked = F.concat(F.array_join(F.zip_with("_units", "_new", lambda u, n: F.concat(bare(u["before"]), n)), ""), bare(rest))
    same = F.filter(F.zip_with("_units", "_new", lambda u, n: u["raw"] == n), lambda x: x)
    out = marked.withColumns(
        {
            "_text": F.when(some & named, linked).when(some, plain).otherwise(value),
            "n_entities": F.size("_raws"),
            "kinds": F.array_join(F.transform("_raws", kind_of), " "),
            "n_kept": F.when(some, F.size(same)).otherwise(0),
        }
    )
    return out.withColumn(text, F.col("_text")).drop("_new", "_raws", "_units", "_words", "_names", "_other", "_text")


def pseudonymise(docs: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """Replace the personal data of a corpus under the first key that keeps its entities apart."""
    return replace_entities(docs, checked_key(docs, key, text), text)
