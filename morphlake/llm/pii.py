"""Surrogates for personal data: detected entities get keyed replacements of the same type, gender, script and format.

Only DataFrame functions are used.  A mention is found by one pattern; it has one part (an e-mail address, a number, a
key ...) or, for a name after a title, one part for each word, so that a surname keeps one surrogate wherever it
stands; the words of such a name are replaced in the rest of its text as well.  A part's canonical form (lower case, digits without separators) chooses the surrogate through a keyed digest,
so equal entities agree across documents and formats.  Surrogates are then checked over the whole corpus: two entities
never share one, and none is the canonical form of an entity of the corpus; losers go to the next digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh, join_hot, table

KEY = "surrogates-1"
SAME_FORM = 12  # so many attempts keep an entity's length; each later one is a character longer

# Names of months and weekdays that have a capital in running text; alone they are no person's name.
CALENDAR = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
    "januar", "februar", "märz", "mai", "juni", "juli", "oktober", "dezember",
    "montag", "dienstag", "mittwoch", "donnerstag", "freitag", "samstag", "sonntag",
)
# Titles by gender (f, m, n: either).
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "г-жа", "κα"),
    "m": ("Mr", "Herr", "Señor", "Sr", "Monsieur", "г-н", "κος"),
    "n": ("Dr", "Prof"),
}
# Syllables and gendered endings of made-up names, by script.
SYLLABLES = {
    "latin": ("ba", "de", "fi", "go", "ha", "je", "ki", "lo", "ma", "ne", "po", "ra", "se", "ti", "vo", "za"),
    "cyrillic": ("ба", "де", "фи", "го", "ха", "же", "ки", "ло", "ма", "не", "по", "ра", "се", "ти", "во", "за"),
    "greek": ("βα", "δε", "φι", "γο", "χα", "ζε", "κι", "λο", "μα", "νε", "πο", "ρα", "σε", "τι", "βο", "ζα"),
}
ENDINGS = {
    "latin": {"f": "na", "m": "rik", "n": "len", "surname": "sson"},
    "cyrillic": {"f": "на", "m": "слав", "n": "лен", "surname": "енко"},
    "greek": {"f": "να", "m": "ρος", "n": "λιν", "surname": "ίδης"},
}

_TITLE = "(?:" + "|".join(t for ts in TITLES.values() for t in ts) + r")\.?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "secret": r"(?<=[=\"])(?i:(?<=password=)|(?<=passwd=)|(?<=secret=)|(?<=api_key=)|(?<=token=)|(?<=token = \"))[^\s\"']++",
    "key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d|\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w.+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w.])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "name": rf"(?<![\w\p{{L}}]){_TITLE} \p{{Lu}}\p{{L}}++(?:[ -]\p{{Lu}}\p{{L}}++){{0,2}}",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
_INITIALS = "".join(sorted({t[0] for ts in TITLES.values() for t in ts}))
#: Every match of PATTERN holds one of these; they are quick to look for.
HINT = rf"[0-9]|(?<![\w\p{{L}}])(?=[{_INITIALS}]){_TITLE} \p{{Lu}}"
HINT_TEXTS = ("@", "=", "AKIA")


def may_mention(text: Column) -> Column:
    hint = text.rlike(HINT)
    for x in HINT_TEXTS:
        hint = F.contains(text, F.lit(x)) | hint
    return F.coalesce(hint, F.lit(False))


def mentions(text: Column) -> Column:
    """The entities of a text, in order; an empty array for null."""
    return F.when(may_mention(text), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def entity_type(raw: Column) -> Column:
    """The type of a mention: of a secret, whatever follows its keyword, nothing else matches in whole."""
    out = F.lit("secret")
    for name in ("name", "iban", "card", "phone", "ssn", "ip", "key", "email"):
        out = F.when(raw.rlike(f"^(?:{PATTERNS[name]})$"), F.lit(name)).otherwise(out)
    return out


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _gender(raw: Column) -> Column:
    of = lambda g: raw.rlike("^(?:" + "|".join(TITLES[g]) + r")\.? ")
    return F.when(of("f"), "f").when(of("m"), "m").otherwise("n")


def _name_rest(raw: Column) -> Column:
    return F.regexp_replace(raw, rf"^{_TITLE} ", "")


def parts(raw: Column) -> Column:
    """array<struct<kind, canon, word>> of a mention; word is null but for names."""
    kind = entity_type(raw)
    digits = F.regexp_replace(raw, r"\D", "")
    canon = (
        F.when(kind.isin("card", "ssn"), digits)
        .when(kind == "phone", F.concat(F.when(raw.startswith("+"), "+").otherwise(""), digits))
        .when(kind == "email", F.lower(raw))
        .when(kind == "iban", F.replace(raw, F.lit(" "), F.lit("")))
        .otherwise(raw)
    )
    words = F.split(_name_rest(raw), "[ -]")

    def named(word: Column, i: Column) -> Column:
        last = (i > 0) | (F.size(words) == 1)
        return F.struct(
            F.when(last, F.concat(F.lit("surname-"), _script(word))).otherwise(F.concat_ws("-", F.lit("given"), _gender(raw), _script(word))).alias("kind"),
            F.lower(word).alias("canon"),
            word.alias("word"),
        )

    return F.when(kind == "name", F.transform(words, named)).otherwise(F.array(F.struct(kind.alias("kind"), canon.alias("canon"), F.lit(None).cast("string").alias("word"))))


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn's sum; doubled: 1 if the last digit counts once, 0 if it counts twice."""
    n = F.length(digits)
    each = F.transform(F.split(digits, "(?<=.)(?=.)"), lambda d, i: F.when((n - i) % 2 == doubled, d.cast("int")).otherwise(F.pmod(d.cast("int") * 2, F.lit(10)) + F.floor(d.cast("int") * 2 / 10)))
    return F.aggregate(each, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))


def with_streams(entities: DataFrame, attempt: int, key: str) -> DataFrame:
    """Add the keyed digests that choose the attempt-th surrogates: of the entity, and of an address's host alone."""
    digest = lambda *of: F.sha2(F.concat_ws("/", F.lit(key), *of), 512)
    return entities.withColumn("stream", digest("kind", "canon", F.lit(str(attempt)))).withColumn("host_stream", digest(F.lit("host"), F.substring_index("canon", "@", -1)))


def surrogate(attempt: int) -> Column:
    """The attempt-th surrogate of (kind, canon) by its streams; it is a canonical form itself."""
    kind, canon, stream, host_stream = F.col("kind"), F.col("canon"), F.col("stream"), F.col("host_stream")
    byte = lambda s, i: F.conv(F.substr(s, F.pmod(i * 2, F.lit(126)) + 1, F.lit(2)), 16, 10).cast("int")
    pick = lambda alphabet, b: F.substr(F.lit(alphabet), F.pmod(b, F.lit(len(alphabet))) + 1, F.lit(1))
    chars = lambda s: F.split(s, "(?<=.)(?=.)")
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def shaped(s: Column, source: Column, skip: int = 0) -> Column:
        """s with every letter and digit replaced by one of the same class; the first skip characters stay."""
        one = lambda c, i: F.when(i < skip, c).when(c.rlike("[0-9]"), pick(dig, byte(source, i))).when(c.rlike("[a-z]"), pick(low, byte(source, i))).when(c.rlike("[A-Z]"), pick(up, byte(source, i))).otherwise(c)
        return F.array_join(F.transform(chars(s), one), "")

    first = lambda s: F.concat(pick("123456789", byte(stream, F.lit(61))), F.substr(s, F.lit(2)))
    new_digits = first(shaped(canon, stream))
    base = F.concat(F.substr(canon, F.lit(1), F.lit(1)), F.substr(new_digits, F.lit(2), F.length(canon) - 2))
    check = F.pmod(10 - F.pmod(_luhn_sum(base, 0), F.lit(10)), F.lit(10)).cast("string")
    card = F.when(F.pmod(_luhn_sum(canon, 1), F.lit(10)) == 0, F.concat(base, check)).otherwise(new_digits)
    phone = F.when(canon.startswith("+"), F.concat(F.substr(canon, F.lit(1), F.lit(2)), first(shaped(F.substr(canon, F.lit(3)), stream)))).otherwise(new_digits)
    over = max(0, attempt - SAME_FORM + 1)
    tail = F.translate(F.substr(stream, F.lit(20), F.lit(min(over, 100))), "abcdef", "012345")
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3 + over)), lambda i: (F.pmod(byte(stream, i), F.lit(254)) + 1).cast("string")), ".")
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    host = F.substr(domain, F.lit(1), F.length(domain) - F.length(F.substring_index(domain, ".", -1)))
    # A short local part has few surrogates of its length, so later attempts are longer.
    longer = F.substr(F.translate(stream, "0123456789", "ghijklmnop"), F.lit(1), F.lit(0 if attempt < 3 else 8 + over))
    email = F.concat(shaped(local, stream), longer, F.lit("@"), shaped(host, host_stream), F.substring_index(domain, ".", -1))
    hexes = F.array_join(F.transform(chars(canon), lambda c, i: F.substr(stream, F.pmod(i, F.lit(128)) + 1, F.lit(1))), "")
    secret = F.when(canon.rlike("^[0-9a-f]+$"), hexes).otherwise(shaped(canon, stream))
    secret = F.concat(secret, F.substr(stream, F.lit(20), F.lit(min(attempt // 2, 100))))
    ascii_only = F.when(secret == canon, F.substr(stream, F.lit(1), F.greatest(F.length(canon), F.lit(8)))).otherwise(secret)
    name = F.lit(None).cast("string")
    for script, syllables in SYLLABLES.items():
        table_of = F.array(*[F.lit(x) for x in syllables])
        stem = F.concat(*[F.element_at(table_of, F.pmod(byte(stream, F.lit(i)), F.lit(len(syllables))) + 1) for i in range(2 + min(attempt, 60))])
        for role, ending in ENDINGS[script].items():
            name = F.when(kind == (f"surname-{script}" if role == "surname" else f"given-{role}-{script}"), F.concat(stem, F.lit(ending))).otherwise(name)
    return (
        F.when(kind == "email", email)
        .when(kind == "phone", F.concat(phone, tail))
        .when(kind == "card", F.concat(card, tail))
        .when(kind == "ssn", F.concat(new_digits, tail))
        .when(kind == "ip", octets)
        .when(kind == "key", F.concat(shaped(canon, stream, 4), tail))
        .when(kind == "iban", F.concat(shaped(canon, stream, 2), tail))
        .when(kind == "secret", ascii_only)
        .otherwise(name)
    )


def assign(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canon, surr) of every distinct (kind, canon): surrogates differ from each other and from all canons.

    Each round keeps, of the entities that drew one surrogate, the first by canonical form, unless an entity of the
    corpus has that form or an earlier round gave it away.  Where a type's format has fewer forms than entities, later
    attempts are longer, so every entity gets one in the end.
    """
    entities = cut(entities.select("kind", "canon").distinct())
    todo, kept, attempt = entities, None, 0
    while True:
        drawn = with_streams(todo, attempt, key).select("kind", "canon", surrogate(attempt).alias("surr"))
        taken = entities.select("kind", F.col("canon").alias("surr"))
        if kept is not None:
            taken = taken.unionByName(kept.select("kind", "surr"))
        first = F.row_number().over(Window.partitionBy("kind", "surr").orderBy("canon"))
        free = drawn.withColumn("place", first).where("place = 1").drop("place").join(taken, ["kind", "surr"], "left_anti").select("kind", "canon", "surr")
        kept = cut(free if kept is None else kept.unionByName(free))
        todo = entities.join(kept, ["kind", "canon"], "left_anti")
        if todo.isEmpty():
            return kept
        todo, attempt = cut(todo), attempt + 1


def _formatted(raw: Column, surrs: Column) -> Column:
    """The mention with its parts' surrogates, in the mention's own format."""
    kind, one = entity_type(raw), F.element_at(surrs, 1)
    chars = F.split(raw, "(?<=.)(?=.)")
    digits = F.regexp_replace(one, r"\D", "")
    nth = lambda i: F.length(F.regexp_replace(F.substr(raw, F.lit(1), i + 1), r"\D", ""))
    numbered = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), F.substr(digits, nth(i), F.lit(1))).otherwise(c)), "")
    numbered = F.concat(numbered, F.substr(digits, F.length(F.regexp_replace(raw, r"\D", "")) + 1))
    cased = F.when(F.length(one) == F.length(raw), F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[A-Z]"), F.upper(F.substr(one, i + 1, F.lit(1)))).otherwise(F.substr(one, i + 1, F.lit(1)))), "")).otherwise(one)
    plain = lambda i: F.length(F.replace(F.substr(raw, F.lit(1), i + 1), F.lit(" "), F.lit("")))
    spaced = F.array_join(F.transform(chars, lambda c, i: F.when(c == " ", c).otherwise(F.substr(one, plain(i), F.lit(1)))), "")
    spaced = F.concat(spaced, F.substr(one, F.length(F.replace(raw, F.lit(" "), F.lit(""))) + 1))
    rest = _name_rest(raw)
    words, gaps = F.split(rest, "[ -]"), F.concat(F.array(F.lit("")), F.regexp_extract_all(rest, F.lit("[ -]"), F.lit(0)))
    word = lambda w, s: F.when((w == F.upper(w)) & (F.length(w) > 1), F.upper(s)).otherwise(F.initcap(s))
    named = F.concat(F.substr(raw, F.lit(1), F.length(raw) - F.length(rest)), F.array_join(F.transform(F.zip_with(words, surrs, word), lambda w, i: F.concat(F.get(gaps, i), w)), ""))
    return F.when(kind.isin("phone", "card", "ssn"), numbered).when(kind == "email", cased).when(kind == "iban", spaced).when(kind == "name", named).otherwise(one)


def _cased(word: Column, surr: Column) -> Column:
    return F.when((word == F.upper(word)) & (F.length(word) > 1), F.upper(surr)).otherwise(F.initcap(surr))


def pseudonymize(docs: DataFrame, text_col: str = "text", key: str = KEY) -> DataFrame:
    """docs with every detected entity of ``text_col`` replaced; other columns stay as they are.

    A name is detected behind a title; its words, alone or in capitals, are replaced in all of that text, but for names of
    months and weekdays, which stand there alone for what they are.  Rows keep
    their number: a text without entities, empty or null is returned unchanged, repeated rows get equal texts, an empty
    table gives an empty one.  ``key`` decides the surrogates: keep it secret, and keep it to get the same ones again.
    Texts of any length are processed whole; a text is known by its 128-bit digest.  What very many texts say, and what very
    many copies of a text get, is sent to all tasks instead of meeting in one.
    """
    text = F.col(text_col)
    digest = F.md5(text.cast("binary"))
    said = cut(docs.where(may_mention(text)).select(digest.alias("text_id"), F.explode(F.array_distinct(mentions(text))).alias("raw")).distinct())
    split = cut(said.select("raw").distinct().select("raw", F.posexplode(parts(F.col("raw"))).alias("pos", "part")).select("raw", "pos", "part.*"))
    # A surname that very many names have is a hot key, its surrogate is one row.
    of_part = join_hot(split.withColumn("_entity", F.struct("kind", "canon")), assign(split, key).select(F.struct("kind", "canon").alias("_entity"), "surr"), "_entity", "inner").drop("_entity")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "surr", "word")))  # of one mention, which has three words at most
    named = cut(of_part.groupBy("raw").agg(ordered.alias("all")).select("raw", _formatted(F.col("raw"), F.transform("all", lambda x: x["surr"])).alias("new"), F.filter("all", lambda x: x["word"].isNotNull()).alias("words")))
    whole = F.array(F.struct(F.col("raw").alias("said"), F.col("new").alias("new"), F.lit(False).alias("bare")))
    own = F.filter("words", lambda x: ~F.lower(x["word"]).isin(*CALENDAR))
    alone = lambda f: F.transform(own, lambda x: F.struct(f(x["word"]).alias("said"), _cased(f(x["word"]), x["surr"]).alias("new"), F.lit(True).alias("bare")))
    given = join_hot(said, named, "raw", "inner").select("text_id", F.explode(F.concat(whole, alone(lambda w: w), alone(F.upper))).alias("g")).select("text_id", "g.*")
    given = given.groupBy("text_id", "said").agg(F.min_by("new", F.struct("bare", "new")).alias("new"), F.max("bare").alias("bare"))
    bare = F.array_join(F.array_sort(F.collect_list(F.when(F.col("bare"), F.col("said")))), "|")
    pattern = F.when(F.max("bare"), F.concat(F.lit(PATTERN + r"|(?<![\w\p{L}])(?:"), bare, F.lit(r")(?![\w\p{L}])"))).otherwise(F.lit(PATTERN))
    by_text = given.groupBy("text_id").agg(F.map_from_entries(F.collect_list(F.struct("said", "new"))).alias("given"), pattern.alias("pattern"))
    of = {name: fresh(docs, name) for name in ("text_id", "given", "pattern")}
    by_text = cut(by_text.select(*[F.col(name).alias(of[name]) for name in of]))
    dirty = docs.where(may_mention(text)).withColumn(of["text_id"], digest)
    found = F.col(of["pattern"])
    new = F.transform(F.regexp_extract_all(text, found, F.lit(0)), lambda raw: F.col(of["given"])[raw])
    rebuilt = F.array_join(F.flatten(F.zip_with(F.concat(F.array(F.lit("")), new), F.split(text, found, -1), lambda a, b: F.array(a, b))), "")
    changed = join_hot(dirty, by_text, of["text_id"]).withColumn(text_col, F.when(found.isNotNull(), rebuilt).otherwise(text))
    return docs.where(~may_mention(text)).unionByName(changed.select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9_pii: documents with surrogates for their entities."""
    return pseudonymize(table(spark, sf_dir, "documents"))
