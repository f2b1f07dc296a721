"""Surrogates for personal data: detected entities get keyed replacements of their own type and format.

Entities are found by one regular expression. Each is brought to a normal form (a phone number's last ten digits, a
card's digits, an address in lower case, a name's parts), and the surrogate is a keyed hash of kind and normal form
poured into the format found: digits for digits, letters for letters of the same case, punctuation as it was. So one
person's number written in two ways stays one number, in every document, and without the key nothing leads back.
Names are built from syllables of the name's script with an ending of its gender; card numbers keep a valid check digit.

A given name or surname has one gender in the whole table, so that a person is called the same after any title: the
one it occurs with, or none if it occurs with both. A Latin surname has no gender. Where a text has a name, its parts
are replaced in that text wherever they stand alone ("Mrs. Maria Smith ... Smith said"); ``n_entities`` counts the names,
not such mentions. Compressed IPv6 addresses count if a group has three digits and one is decimal, as "1::2" is code.

Distinct entities must stay distinct and must not become another real entity. Only the distinct entities, not
their occurrences, are shuffled to find surrogates that clash, by a dictionary join; those entities draw again until
none clashes. Almost all keep their first draw, which tasks compute where the text is; texts move only if they
hold an entity that drew again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.texts import materialize, table

KEY = "kindred"
#: Draws after which a surrogate gets longer, so that drawing again always ends.
SAME_LENGTH_DRAWS = 4
#: Letters of a part of a name from which the text's other mentions of it are replaced too.
SHORTEST_PART = 3

# Forms of address with their gender, and given names with theirs.
TITLES_F = ("Mrs", "Ms", "Miss", "Mme", "Mlle", "Madame", "Frau", "Señora", "Sra", "Госпожа")
TITLES_M = ("Mr", "Sir", "Monsieur", "Herr", "Señor", "Sr", "Господин")
TITLES_ANY = ("Dr", "Prof")
GIVEN_F = (
    "Alice", "Anna", "Anne", "Carmen", "Charlotte", "Claire", "Elena", "Elizabeth", "Emma", "Eva", "Jane", "Julia", "Laura", "Linda", "Lucía", "Maria",
    "María", "Marie", "Mary", "Patricia", "Sarah", "Sofia", "Sophie", "Susan", "Анна", "Елена", "Мария", "Ольга", "Светлана", "Татьяна",
)
GIVEN_M = (
    "Alexander", "Antonio", "Carlos", "Charles", "David", "François", "Hans", "Jacques", "James", "Jean", "John", "José", "Juan", "Klaus", "Michael", "Miguel",
    "Paul", "Peter", "Pierre", "Robert", "Thomas", "William", "Wolfgang", "Александр", "Алексей", "Дмитрий", "Иван", "Николай", "Сергей",
)
#: Syllables and endings by script and gender.
SYLLABLES = {
    "latin": ("ba", "be", "da", "do", "el", "fa", "ga", "ha", "jo", "ka", "la", "le", "lo", "ma", "mi", "na", "ni", "or", "pa", "ra", "re", "ri", "ro", "sa", "se", "so", "ta", "te", "ti", "va", "ve", "vi"),
    "cyrillic": ("ба", "бе", "ва", "ве", "га", "да", "де", "ди", "за", "ка", "ко", "ла", "ле", "ли", "ло", "ма", "ме", "ми", "на", "не", "ни", "но", "па", "ра", "ре", "ро", "са", "се", "та", "те", "то", "фа"),
}
ENDINGS = {"latin": {"f": "na", "m": "n", "x": "rd"}, "cyrillic": {"f": "на", "m": "н", "x": "р"}}
SURNAME_ENDINGS = {"latin": {"f": "ler", "m": "ler", "x": "ler"}, "cyrillic": {"f": "ова", "m": "ов", "x": "ко"}}

_WORD = r"\p{Lu}[\p{L}'’-]{1,40}"
_TITLE = "(?:" + "|".join(sorted(TITLES_F + TITLES_M + TITLES_ANY)) + ")"
# Every part starts where no longer run of its characters could have started, and takes runs whole, so that matching
# takes time in proportion to the text however long its words are.
PARTS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "ipv6": r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]{0,34}[0-9])(?=[0-9A-Fa-f:]{0,36}[0-9A-Fa-f]{3})(?:(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){1,7}:|::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4}))(?![0-9A-Za-z:])",
    "ipv4": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9]{20,64}|gh[pousr]_[A-Za-z0-9]{36,64})(?![A-Za-z0-9])",
    "name": rf"(?=\p{{Lu}})(?<!\p{{L}})(?:{_TITLE}\.? {_WORD}(?: {_WORD})?|(?:{'|'.join(sorted(GIVEN_F + GIVEN_M))}) {_WORD})",
}
#: Every text with an entity other than a name matches this, and matching it takes one quick look at most characters.
HINT = "[0-9@]|[a-f]{32}|[A-F]{32}|AKIA|sk-|gh[pousr]_"
ENTITY = "|".join(f"(?:{p})" for p in PARTS.values())


def kind_of(raw: Column) -> Column:
    """The kind of an entity as found, in the order in which the pattern tries the kinds."""
    case = None
    for kind, pattern in PARTS.items():
        test = raw.rlike(rf"\A(?:{pattern})\z")
        case = F.when(test, F.lit(kind)) if case is None else case.when(test, F.lit(kind))
    return case.otherwise(F.lit("secret"))


def digits_of(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^0-9]", "")


def normal_of(raw: Column, kind: Column) -> Column:
    """The normal form of an entity that is not a name."""
    number = digits_of(raw)
    return (
        F.when(kind == "phone", F.substring(number, -10, 10))
        .when(kind.isin("card", "ssn"), number)
        .when(kind.isin("email", "ipv6"), F.lower(raw))
        .when(kind == "secret", raw)
        .otherwise(F.regexp_replace(raw, " ", ""))
    )


def _hex(key: str, *parts: Column) -> Column:
    """256 hexadecimal digits of the keyed parts."""
    text = F.concat_ws("|", F.lit(key), *parts)
    return F.concat(F.sha2(text, 512), F.sha2(F.concat(text, F.lit("|more")), 512))


def _pour(raw: Column, stream: Column, keep_left: Column) -> Column:
    """``raw`` with its letters and digits taken from the hexadecimal ``stream``, but for the first ``keep_left`` of them.

    Characters are counted from the right, so that a number with and without its country's prefix agree.
    """

    def draw(c: Column, i: Column) -> Column:
        left = F.length(F.regexp_replace(F.substring(raw, F.lit(1), i + 1), "[^A-Za-z0-9]", ""))
        right = F.length(F.regexp_replace(raw, "[^A-Za-z0-9]", "")) - left
        value = F.conv(F.substring(stream, 1 + F.pmod(right * 2, F.lit(250)), F.lit(2)), 16, 10).cast("int")
        letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), 1 + value % 26, F.lit(1))
        return (
            F.when(left <= keep_left, c)
            .when(c.rlike("[0-9]"), (value % 10).cast("string"))
            .when(c.rlike("[a-z]"), letter)
            .when(c.rlike("[A-Z]"), F.upper(letter))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(raw, ""), draw), "")


def _luhn_sum(number: Column) -> Column:
    """The Luhn sum of a number's digits."""
    n = F.length(number)

    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when((n - i) % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(F.split(number, ""), weigh), F.lit(0), lambda total, d: total + d)


def _valid_card(drawn: Column, original: Column) -> Column:
    """The drawn number with a check digit that is valid if the original's is."""
    body = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
    check = (F.pmod(10 - F.pmod(_luhn_sum(F.concat(digits_of(body), F.lit("0"))), F.lit(10)), F.lit(10))).cast("string")
    return F.when(F.pmod(_luhn_sum(digits_of(original)), F.lit(10)) == 0, F.concat(body, check)).otherwise(drawn)


def surrogate(raw: Column, kind: Column, normal: Column, draw: Column, key: str = KEY) -> Column:
    """The replacement of ``raw`` in its format; equal for equal kind, normal form, draw and key."""
    stream = _hex(key, kind, normal, draw.cast("string"))
    letters = F.length(F.regexp_replace(raw, "[^A-Za-z0-9]", ""))
    at = F.instr(raw, "@")
    local = F.substring(raw, F.lit(1), at - 1)
    domain = F.substring(_hex(key, F.lit("domain"), F.lower(F.regexp_replace(raw, "^[^@]*@", ""))), 1, 10)
    longer = F.when(draw >= SAME_LENGTH_DRAWS, F.substring(F.translate(stream, "0123456789", "ghijklmnop"), F.lit(1), draw)).otherwise("")
    octets = F.transform(
        F.split(raw, r"\."), lambda o, i: (1 + F.conv(F.substring(stream, i * 4 + 1, F.lit(4)), 16, 10).cast("long") % 254).cast("string")
    )
    hexed = F.substring(F.concat(stream, stream), F.lit(1), F.length(raw))
    head = F.regexp_extract(raw, "^(AKIA|sk-|gh[pousr]_)", 1)
    return (
        F.when(kind == "email", F.concat(_pour(local, stream, F.lit(0)), longer, F.lit("@m"), domain, F.lit(".example.com")))
        .when(kind == "ipv4", F.array_join(octets, "."))
        .when(kind == "ipv6", F.array_join(F.transform(F.split(raw, ":"), lambda o, i: F.when(o == "", o).otherwise(F.substring(stream, i * 4 + 1, F.lit(4)))), ":"))
        .when(kind == "card", _valid_card(_pour(raw, stream, F.lit(0)), raw))
        .when(kind == "phone", _pour(raw, stream, F.greatest(letters - 10, F.lit(0))))
        .when(kind == "iban", _pour(raw, stream, F.lit(2)))
        .when((kind == "secret") & raw.rlike("^[0-9a-f]+$"), hexed)
        .when((kind == "secret") & raw.rlike("^[0-9A-F]+$"), F.upper(hexed))
        .otherwise(_pour(raw, stream, F.length(F.regexp_replace(head, "[^A-Za-z0-9]", ""))))
    )


def name_parts(raw: Column) -> Column:
    """The parts of a name: array of (part, role, gender, script); titles have no role."""
    words = F.split(raw, " ")
    bare = F.regexp_replace(F.element_at(words, 1), r"\.$", "")
    titled = bare.isin(*TITLES_F, *TITLES_M, *TITLES_ANY)
    given = F.when(titled & (F.size(words) == 3), F.get(words, F.lit(1))).when(~titled, F.get(words, F.lit(0)))
    gender = (
        F.when(bare.isin(*TITLES_F) | F.coalesce(given.isin(*GIVEN_F), F.lit(False)), F.lit("f"))
        .when(bare.isin(*TITLES_M) | F.coalesce(given.isin(*GIVEN_M), F.lit(False)), F.lit("m"))
        .otherwise(F.lit("x"))
    )

    def part(w: Column, i: Column) -> Column:
        role = F.when(titled & (i == 0), F.lit("title")).when(i == F.size(words) - 1, F.lit("surname")).otherwise(F.lit("given"))
        script = F.when(w.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin"))
        own = F.when((role == "surname") & (script == "latin"), F.lit("x")).otherwise(gender)
        return F.struct(w.alias("part"), role.alias("role"), own.alias("gender"), script.alias("script"))

    return F.transform(words, part)


def name_surrogate(part: Column, draw: Column, key: str = KEY) -> Column:
    """A name of the part's script, role and gender, in its case; a surname's stem does not depend on the gender."""
    role, gender, script = part["role"], part["gender"], part["script"]
    stream = _hex(key, role, F.lower(part["part"]), draw.cast("string"))
    count = F.lit(3) + F.when(draw >= SAME_LENGTH_DRAWS, draw - SAME_LENGTH_DRAWS + 1).otherwise(0)

    def built(of: str) -> Column:
        pool = F.array(*[F.lit(x) for x in SYLLABLES[of]])
        stem = F.array_join(
            F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.element_at(pool, 1 + F.conv(F.substring(stream, i * 4 + 1, F.lit(4)), 16, 10).cast("int") % len(SYLLABLES[of]))), ""
        )
        ends = [F.when(gender == g, F.when(role == "surname", SURNAME_ENDINGS[of][g]).otherwise(ENDINGS[of][g])) for g in "fmx"]
        return F.concat(stem, F.coalesce(*ends))

    name = F.initcap(F.when(script == "cyrillic", built("cyrillic")).otherwise(built("latin")))
    return F.when(F.length(part["part"]) > 2, F.when(part["part"] == F.upper(part["part"]), F.upper(name)).otherwise(name)).otherwise(name)


def typed(found: Column) -> Column:
    """(raw, kind) of each entity found."""
    return F.transform(found, lambda raw: F.struct(raw.alias("raw"), kind_of(raw).alias("kind")))


def normalised(entities: Column) -> Column:
    """(raw, kind, normal) of typed entities."""
    return F.transform(
        entities, lambda e: F.struct(e["raw"].alias("raw"), e["kind"].alias("kind"), normal_of(e["raw"], e["kind"]).alias("normal"))
    )


def _keys(entity: Column) -> Column:
    """What an entity stands for in the dictionary: array of (kind, normal, sample), sample being the text to replace."""
    raw, kind = entity["raw"], entity["kind"]
    plain = F.array(F.struct(kind.alias("kind"), entity["normal"].alias("normal"), raw.alias("sample"), F.lit("x").alias("gender"), F.lit("latin").alias("script")))
    names = F.transform(
        F.filter(name_parts(raw), lambda p: p["role"] != "title"),
        lambda p: F.struct(p["role"].alias("kind"), F.lower(p["part"]).alias("normal"), p["part"].alias("sample"), p["gender"].alias("gender"), p["script"].alias("script")),
    )
    return F.when(kind == "name", names).otherwise(plain)


def _of_key(key: Column, draw: Column, secret: str) -> Column:
    """The surrogate of a dictionary entry."""
    part = F.struct(key["sample"].alias("part"), key["kind"].alias("role"), key["gender"].alias("gender"), key["script"].alias("script"))
    named = key["kind"].isin("given", "surname")
    return F.when(named, name_surrogate(part, draw, secret)).otherwise(surrogate(key["sample"], key["kind"], key["normal"], draw, secret))


def redraws(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, normal, draw) of the entities whose first surrogate clashes, with the draw that does not.

    ``entities`` holds distinct (kind, normal, e), e being the entry with the gender in which it is written everywhere. A surrogate clashes if it is another entity of
    the table or another entity's surrogate; of those that share one, the smallest normal form keeps it.
    """
    real = entities.select(F.col("kind").alias("real_kind"), F.col("normal").alias("real"))
    pending, settled, draw = entities, None, 0
    while True:
        given = _of_key(F.col("e"), F.lit(draw), key)
        kind_again = F.col("kind")
        form = F.when(kind_again.isin("given", "surname"), F.lower(F.col("given"))).otherwise(normal_of(F.col("given"), kind_again))
        drawn = pending.withColumn("given", given).withColumn("form", form).drop("given")
        taken = real if settled is None else real.unionByName(settled.select(F.col("kind").alias("real_kind"), F.col("form").alias("real")))
        first = drawn.groupBy("kind", "form").agg(F.min("normal").alias("owner"))
        free = first.join(taken, (F.col("kind") == F.col("real_kind")) & (F.col("form") == F.col("real")), "left_anti")
        good = free.select("kind", F.col("owner").alias("normal"), "form").withColumn("draw", F.lit(draw))
        good = materialize(good, "surrogates")
        settled = good if settled is None else settled.unionByName(good)
        pending = materialize(pending.join(good.select("kind", "normal"), ["kind", "normal"], "left_anti"), "redraw")
        if not pending.head(1):
            return settled.where("draw > 0").select("kind", "normal", "draw")
        draw += 1


def pseudonymise(docs: DataFrame, key: str = KEY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text with every entity replaced, n_entities and kinds (how often each kind occurs) of every row of ``docs``.

    A text without entities comes back as it is, a null text as null with 0 entities. Rows may repeat; extra columns
    are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    likely = F.col("text").rlike(HINT) | F.col("text").rlike(PARTS["name"])
    found = rows.withColumn("matches", F.when(likely, F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))))
    distinct = found.select(F.explode("matches").alias("raw")).distinct().select(F.explode(typed(F.array("raw"))).alias("entity"))
    distinct = distinct.select(F.explode(normalised(F.array("entity"))).alias("entity"))
    entries = distinct.select(F.explode(_keys(F.col("entity"))).alias("e"))
    found = found.withColumn("kinds", typed(F.col("matches"))).withColumn("found", normalised(F.col("kinds")))
    genders = entries.groupBy(F.col("e.kind").alias("kind"), F.col("e.normal").alias("normal")).agg(F.min("e").alias("e"), F.collect_set("e.gender").alias("genders"))
    known = F.array_remove("genders", "x")
    settled = genders.withColumn("e", F.col("e").withField("gender", F.when(F.size(known) == 1, known[0]).otherwise("x")))
    # Drawing surrogates is the work; the few bytes of the entities would else be written, and then drawn for, by one task.
    # Dealt by a hash of the key: by the key itself they are dealt already, and Spark would leave the step out.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entities = materialize(settled.withColumn("mixed", F.size("genders") > 1).repartition(tasks, F.xxhash64("kind", "normal")), "entities")
    drawn = redraws(entities.drop("mixed"), key)
    # What a text does not know by itself: another draw than the first, or the gender of a name met with several.
    again = (
        entities.join(drawn, ["kind", "normal"], "left").where("mixed or draw is not null")
        .select("kind", "normal", F.struct(F.coalesce("draw", F.lit(0)).alias("draw"), F.col("e.gender").alias("gender")).alias("said"))
    )
    if again.head(1):
        row_key = ["id", "hash"]
        marked = found.withColumns({"id": F.col("doc_id"), "hash": F.xxhash64("text")})
        need = (
            marked.where(F.size("found") > 0).select(*row_key, F.explode("found").alias("entity")).distinct()
            .select(*row_key, F.explode(_keys(F.col("entity"))).alias("e"))
            .join(again, (F.col("e.kind") == F.col("kind")) & (F.col("e.normal") == F.col("normal")))
            .where((F.col("said.draw") > 0) | (F.col("said.gender") != F.col("e.gender")))
            .groupBy(*row_key).agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "kind", "normal"), "said"))).alias("draws"))
            .select(F.col("id").alias("of"), F.col("hash").alias("of_hash"), "draws")
        )
        found = marked.join(need, (F.col("hash") == F.col("of_hash")) & F.col("id").eqNullSafe(F.col("of")), "left")
    else:
        found = found.withColumn("draws", F.lit(None).cast("map<string,struct<draw:int,gender:string>>"))

    def said(kind: Column, normal: Column) -> Column:
        return F.try_element_at("draws", F.concat_ws("|", kind, normal))

    def draw_of(kind: Column, normal: Column) -> Column:
        return F.coalesce(said(kind, normal)["draw"], F.lit(0))

    def of_gender(p: Column) -> Column:
        return p.withField("gender", F.coalesce(said(p["role"], F.lower(p["part"]))["gender"], p["gender"]))

    def replaced(entity: Column) -> Column:
        raw, kind, normal = entity["raw"], entity["kind"], entity["normal"]
        name = F.array_join(
            F.transform(
                name_parts(raw), lambda p: F.when(p["role"] == "title", p["part"]).otherwise(name_surrogate(of_gender(p), draw_of(p["role"], F.lower(p["part"])), key))
            ),
            " ",
        )
        return F.when(kind == "name", name).otherwise(surrogate(raw, kind, normal, draw_of(kind, normal), key))

    # Parts of the names found, wherever else the text has them alone.
    parts = F.flatten(F.transform(F.filter("found", lambda e: e["kind"] == "name"), lambda e: F.filter(name_parts(e["raw"]), lambda p: (p["role"] != "title") & (F.length(p["part"]) >= SHORTEST_PART))))
    alone = F.transform(
        F.array_distinct(parts), lambda p: F.struct(p["part"].alias("part"), name_surrogate(of_gender(p), draw_of(p["role"], F.lower(p["part"])), key).alias("new"))
    )

    def without_parts(gap: Column) -> Column:
        one = lambda said, p: F.regexp_replace(said, F.concat(F.lit(r"(?<![\p{L}’'-])\Q"), p["part"], F.lit(r"\E(?![\p{L}-]|['’]\p{L}{2})")), p["new"])
        return F.when(F.exists("alone", lambda p: F.contains(gap, p["part"])), F.aggregate("alone", gap, one)).otherwise(gap)

    # Splitting by the pattern gives what stands between the entities, one part more than there are entities.
    between = F.split("text", ENTITY)
    woven = F.array_join(F.transform(between, lambda gap, i: F.concat(without_parts(gap), F.coalesce(F.get("given", i), F.lit("")))), "")
    given = found.withColumns({"given": F.transform("found", replaced), "alone": alone})
    kinds = F.array_sort(F.transform("kinds", lambda e: e["kind"]))
    counted = F.map_from_entries(
        F.transform(F.array_distinct(kinds), lambda k: F.struct(k, F.size(F.filter("kinds", lambda e: e["kind"] == k))))
    )
    some = F.coalesce(F.size("found") > 0, F.lit(False))
    return given.select(
        "doc_id",
        F.when(some, woven).otherwise(F.col("text")).alias("text"),
        F.when(some, F.size("found")).otherwise(0).cast("long").alias("n_entities"),
        F.when(some, F.to_json(counted)).otherwise("{}").alias("kinds"),
    )


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their personal data replaced."""
    return pseudonymise(table(spark, sf_dir, "documents"))
