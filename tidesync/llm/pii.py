"""Personal data: surrogate generation (native DataFrame operators only).

Method: one regular expression finds the entities of a text. Each entity has a type and a canonical
value (digits of a phone or card number, lower-cased address); equal canonical values are one entity
wherever they stand. A surrogate keeps type and form: every digit becomes a digit, every letter a
letter of the same case, separators, country code, top-level domain and key prefix stay; a person's
name becomes a name of the same gender and script. The replacement stream is SHA-512 over a secret
key, the type, the canonical value and an attempt number, so reruns agree and nothing can be undone
without the key.

Collision checks: over the distinct entities of the whole corpus, two entities with equal surrogates
or a surrogate that is itself an entity of the corpus move to their next attempt until none is left.
So distinct entities stay distinct and a surrogate never names another real entity. The space of a form
grows with the attempt, so no number of entities exhausts it: a family name has one more syllable per
attempt, and from attempt ``WIDER_FROM`` on octets have more digits and other values more characters.

The regular expression runs once over the texts, which are written with a mark around each entity;
types and genders come from the value and the words before it. Only texts with entities are shuffled,
once, to receive their surrogates; the others pass through. The entity table is keyed by entity, so a
hot one costs one row (partial aggregates before the shuffle). On the way back, entities with a
thousandth or more of all uses (so at most a thousand) are broadcast to them, the others are joined.

Cases: a null text stays null with no entities; an empty text stays empty. Rows are told apart by a
number of their own, so ids may repeat or be null; equal texts get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesync.llm.common import let, pinned

# Entity patterns, tried in this order at each place of a text.
PERSON_TITLE_M = r"(?:Mr|Herr|Señor|Sr|Monsieur|Don|г-н)"
PERSON_TITLE_F = r"(?:Mrs|Ms|Miss|Frau|Señora|Sra|Señorita|Madame|Mme|Mlle|Doña|г-жа)"
PERSON_TITLE_ANY = r"(?:Dr|Prof)"
NAME = r"\p{Lu}\p{Ll}+(?:[-'’]\p{Lu}\p{Ll}+)?"
TITLES = rf"(?:{PERSON_TITLE_M}|{PERSON_TITLE_F}|{PERSON_TITLE_ANY})"
# Each pattern starts with a test of one or few characters, so most places of a text cost little.
ALONE = r"(?<![\p{L}\p{N}_])"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)+",
    "key": rf"(?=[AS]|ghp_|sk-|sk_|xox){ALONE}(?:(?:AKIA|ASIA)[0-9A-Z]{{16}}(?![\p{{L}}\p{{N}}_])|(?:ghp_|sk-|sk_live_|xox[bp]-)[A-Za-z0-9\-]{{16,}})",
    "secret": r"(?<=[=:][ ]{0,2}[\"']?)(?<=\b(?:password|passwd|pwd|token|secret|api_key|apikey)[ ]{0,2}[=:][ ]{0,2}[\"']?)[A-Za-z0-9_\-+/]{8,}",
    "hexadecimal": rf"(?=[0-9a-f]{{2}}){ALONE}[0-9a-f]{{32,}}+(?![\p{{L}}\p{{N}}_])",
    "iban": rf"(?=[A-Z]{{2}}[0-9]){ALONE}[A-Z]{{2}}[0-9]{{2}}(?:[ ]?[A-Z0-9]{{4}}){{3,7}}(?:[ ]?[A-Z0-9]{{1,3}})?(?![\p{{L}}\p{{N}}_])",
    "ip": r"(?=[0-9])(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "phone": rf"\+[0-9]{{1,3}}(?:[ .\-]?\(?[0-9]{{2,4}}\)?){{2,5}}(?![0-9])|\([0-9]{{3}}\)[ ]?[0-9]{{3}}[\-. ][0-9]{{4}}(?![\p{{L}}\p{{N}}_])"
    rf"|(?=[0-9]){ALONE}[0-9]{{3}}[\-.][0-9]{{3}}[\-.][0-9]{{4}}(?![\p{{L}}\p{{N}}_])",
    "ssn": rf"(?=[0-9]){ALONE}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![\p{{L}}\p{{N}}_])",
    "card": r"(?=[0-9])(?<![0-9A-Za-z])(?:[0-9][ \-]?){12,18}[0-9](?![0-9A-Za-z])",
    "person": rf"(?<=[ ])(?=\p{{Lu}})(?<=\b{TITLES}\.?[ ]){NAME}(?:[ ]{NAME}){{0,2}}",
}
COMBINED = "|".join(PATTERNS.values())
TITLE_CHARS = 16  # more than the longest title with the signs around it
HOT_SHARE, HOT_CHARS = 1000, 256
WIDER_FROM = 3  # attempts before it keep the exact form; short forms may be exhausted by then

# Surrogate names by gender and script; the list of the other gender is never used.
GIVEN = {
    ("m", "latin"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivan", "Leo", "Max", "Noah", "Oscar", "Paul", "Simon", "Tom", "Victor"],
    ("f", "latin"): ["Anna", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Ida", "Julia", "Laura", "Maria", "Nora", "Olga", "Paula", "Rosa", "Sara"],
    ("m", "cyrillic"): ["Иван", "Пётр", "Олег", "Антон", "Борис", "Глеб", "Денис", "Павел"],
    ("f", "cyrillic"): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"],
}
FAMILY = {
    "latin": ["Adler", "Berg", "Costa", "Dumont", "Engel", "Fischer", "Garcia", "Hansen", "Iver", "Jansen", "Keller", "Lopez", "Moreau", "Novak", "Olsen", "Petit"],
    "cyrillic": ["Белый", "Волков", "Громов", "Зимин", "Котов", "Лебедев", "Морозов", "Соколов"],
}
ENDINGS = {"latin": ["ar", "el", "in", "on", "us", "ev", "is", "or"], "cyrillic": ["ин", "ов", "ев", "ан", "ич", "ар", "он", "ель"]}


# Control characters that no pattern accepts: the mark around an entity and the escape for texts that hold them.
MARK, ESCAPE = "\x01", "\x02"
ESCAPED = {ESCAPE: ESCAPE + "\x04", MARK: ESCAPE + "\x05"}


def marked(text: Column) -> Column:
    """``text`` with a mark before and after every entity, read once; its own marks are escaped."""
    safe = text
    for plain, code in ESCAPED.items():
        safe = F.replace(safe, F.lit(plain), F.lit(code))
    odd = F.contains(text, F.lit(MARK)) | F.contains(text, F.lit(ESCAPE))
    return F.regexp_replace(F.when(odd, safe).otherwise(text), COMBINED, f"{MARK}$0{MARK}")


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPED.items()):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def entity_type(value: Column) -> Column:
    """Type of a found entity: the first pattern that matches it as a whole, names last."""
    out = F.lit("person")
    alone = {
        "card": r"^(?:[0-9][ \-]?){12,18}[0-9]$",
        "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
        "phone": r"^(?:\+|\()|^[0-9]{3}[\-.][0-9]{3}[\-.][0-9]{4}$",
        "ip": r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$",
        "iban": r"^[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){3}",
        "secret": r"^(?=.*[0-9_\-+/]|[a-z]+$|[A-Z]+$)[A-Za-z0-9_\-+/]{8,}$",
        "key": r"^(?:AKIA|ASIA)[0-9A-Z]{16}$|^(?:ghp_|sk-|sk_live_|xox[bp]-)",
        "email": r"@",
    }
    for kind in ("secret", "iban", "card", "ssn", "phone", "ip", "key", "email"):
        out = F.when(F.rlike(value, F.lit(alone[kind])), F.lit(kind)).otherwise(out)
    return out


def canonical(kind: Column, value: Column) -> Column:
    """The value that all spellings of one entity share."""
    plain = F.regexp_replace(value, r"[^\p{L}\p{N}]", "")
    return (
        F.when(kind.isin("phone", "card", "ssn", "iban"), plain).when(kind == "email", F.lower(value)).otherwise(value)
    )


def stream(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """64 numbers from 0 to 255, drawn by the keyed digest."""
    digest = F.sha2(F.concat_ws("\u0001", F.lit(key), kind, value, attempt.cast("string")), 512)
    return let(
        digest,
        lambda d: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(F.substr(d, 2 * i + 1, F.lit(2)), 16, 10).cast("int")),
    )


def moved(char: Column, number: Column, hexadecimal: Column) -> Column:
    """A character of the same class: digit, upper or lower letter (a to f in hexadecimal values)."""

    def within(alphabet: str) -> Column:
        letters = F.lit(alphabet)
        place = F.instr(letters, char)
        return F.when(place > 0, F.substr(letters, (place - 1 + number) % len(alphabet) + 1, F.lit(1)))

    return F.coalesce(
        within("0123456789"),
        F.when(hexadecimal, within("abcdef")),
        within("abcdefghijklmnopqrstuvwxyz"),
        within("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        within("абвгдежзийклмнопрстуфхцчшщъыьэюя"),
        F.when(F.rlike(char, F.lit(r"\p{Ll}")), within("àáâäãåçèéêëìíîïñòóôöõøùúûüýÿß")),
        F.when(F.rlike(char, F.lit(r"\p{Lu}")), within("ÀÁÂÄÃÅÇÈÉÊËÌÍÎÏÑÒÓÔÖÕØÙÚÛÜÝ")),
        char,
    )


def remapped(text: Column, numbers: Column, fixed: Column, hexadecimal: Column) -> Column:
    """``text`` with its letters and digits moved, but for the first ``fixed`` characters.

    The n-th letter or digit takes the n-th number, so separators do not shift the stream.
    """

    def step(acc: Column, char: Column) -> Column:
        counts = F.rlike(char, F.lit(r"[\p{L}\p{N}]"))
        new = F.when(
            counts & (acc["at"] >= fixed), moved(char, F.get(numbers, acc["n"] % 64), hexadecimal)
        ).otherwise(char)
        return F.struct(
            (acc["at"] + 1).alias("at"),
            F.when(counts, acc["n"] + 1).otherwise(acc["n"]).alias("n"),
            F.concat(acc["out"], new).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit("").alias("out"))
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, start, step, lambda acc: acc["out"])


def added(kind: Column, numbers: Column, attempt: Column) -> Column:
    """Further characters that make a form wider: none before ``WIDER_FROM``, then one more per attempt."""

    def char(i: Column) -> Column:
        number = F.get(numbers, 63 - i)
        letter = F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), number % 26 + 1, F.lit(1))
        return F.when(kind.isin("phone", "card", "ssn", "iban"), (number % 10).cast("string")).otherwise(letter)

    n = attempt - WIDER_FROM
    return F.when(n < 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), char), ""))


def ip_surrogate(value: Column, numbers: Column, attempt: Column) -> Column:
    """Octets of the same number of digits (more from ``WIDER_FROM`` on), each in its range."""
    more = F.greatest(attempt - WIDER_FROM + 1, F.lit(0))

    def octet(o: Column, i: Column) -> Column:
        width, number = F.length(o) + more, F.get(numbers, i)
        return F.when(width == 1, number % 10).when(width == 2, number % 90 + 10).otherwise(number % 156 + 100).cast("string")

    return F.array_join(F.transform(F.split(value, r"\."), octet), ".")


def person_surrogate(value: Column, gender: Column, numbers_of, attempt: Column) -> Column:
    """Given names by gender and script, the last word a family name; equal words get equal names.

    A family name has two endings and one more per attempt: 16 x 8^2 Latin ones, then 16 x 8^3 and so on.
    """
    script = F.when(F.rlike(value, F.lit(r"\p{IsCyrillic}")), "cyrillic").otherwise("latin")

    def pick(options: list[str], number: Column) -> Column:
        return F.get(F.array(*map(F.lit, options)), number % len(options))

    def ending(numbers: Column, script_name: str) -> Column:
        places = F.sequence(F.lit(1), attempt + 2)
        parts = F.transform(places, lambda i: pick(ENDINGS[script_name], F.get(numbers, i % 64)))
        return F.array_join(parts, "")

    def named(word: Column, given: Column) -> Column:
        def build(numbers: Column) -> Column:
            first = F.get(numbers, F.lit(0))
            out = F.lit(None).cast("string")
            for script_name in FAMILY:
                family = F.concat(pick(FAMILY[script_name], first), ending(numbers, script_name))
                male = F.concat(pick(GIVEN[("m", script_name)], first), F.lit(""))
                female = pick(GIVEN[("f", script_name)], first)
                name = F.when(given & (gender == "f"), female).when(given, male).otherwise(family)
                out = F.when(script == script_name, name).otherwise(out)
            return out

        return let(numbers_of(F.lit("name"), word), build)

    words = F.split(value, " ")
    return let(
        words,
        lambda ws: F.array_join(F.transform(ws, lambda w, i: named(w, (i < F.size(ws) - 1) & (F.size(ws) > 1))), " "),
    )


def surrogate(key: str, kind: Column, value: Column, gender: Column, attempt: Column) -> Column:
    """The replacement of one entity in the form in which it stands in the text."""

    def draw(k: Column, v: Column) -> Column:
        return stream(key, k, v, attempt)

    def by_form(numbers: Column) -> Column:
        local = F.substring_index(value, "@", 1)
        domain = F.lower(F.substring_index(value, "@", -1))
        labels = F.split(domain, r"\.")
        site = F.array_join(F.slice(labels, F.lit(1), F.size(labels) - 1), ".")
        no = F.lit(False)
        more = added(kind, numbers, attempt)
        email = F.concat(
            remapped(local, numbers, F.lit(0), no),
            more,
            F.lit("@"),
            let(draw(F.lit("domain"), domain), lambda ns: remapped(site, ns, F.lit(0), no)),
            F.lit("."),
            F.element_at(labels, -1),
        )
        code = F.length(F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ .\-(])", 0))
        hexadecimal = F.rlike(value, F.lit(r"^[0-9a-f]+$"))
        prefix = F.length(F.regexp_extract(value, r"^(?:AKIA|ASIA|ghp_|sk-|sk_live_|xox[bp]-)", 0))
        return (
            F.when(kind == "email", email)
            .when(kind == "ip", ip_surrogate(value, numbers, attempt))
            .when(kind == "phone", F.concat(remapped(value, numbers, code, no), more))
            .when(kind == "key", F.concat(remapped(value, numbers, prefix, no), more))
            .when(kind == "iban", F.concat(remapped(value, numbers, F.lit(2), no), more))
            .when(kind == "person", person_surrogate(value, gender, draw, attempt))
            .otherwise(F.concat(remapped(value, numbers, F.lit(0), hexadecimal), more))
        )

    return let(draw(kind, canonical(kind, value)), by_form)


def titled(before: Column, titles: str) -> Column:
    """Whether the text before a value ends with one of the titles."""
    return F.rlike(before, F.lit(rf"\b{titles}\.?[ ]$"))


def settle(spark: SparkSession, entities: DataFrame, key: str, max_rounds: int = 20) -> DataFrame:
    """Add the attempt at which each entity's surrogate collides with no entity and no other surrogate."""
    table = entities.withColumn("attempt", F.lit(0))
    for _ in range(max_rounds):
        made = canonical(F.col("kind"), surrogate(key, F.col("kind"), F.col("canon"), F.col("gender"), F.col("attempt")))
        table = pinned(spark, table.withColumn("made", made), "pii-entities")
        uses = table.groupBy("kind", "made").agg(F.min("canon").alias("first"), F.count("*").alias("n"))
        shared = uses.filter("n > 1").select("kind", "made", "first")
        real = table.select("kind", F.col("canon").alias("made"), F.lit("").alias("first"))
        taken = pinned(
            spark,
            shared.union(real.join(table.select("kind", "made"), ["kind", "made"], "left_semi"))
            .groupBy("kind", "made").agg(F.min("first").alias("first")),
            "pii-taken",
        )
        if taken.isEmpty():
            return table.drop("made")
        again = F.col("first").isNotNull() & (F.col("first") != F.col("canon"))
        table = table.join(taken, ["kind", "made"], "left").select(
            "kind", "canon", "gender", (F.col("attempt") + again.cast("int")).alias("attempt")
        )
    raise RuntimeError(f"surrogates still collide after {max_rounds} rounds, although forms grow with each")


def hot_entities(entities: DataFrame, n_uses: int) -> DataFrame:
    """Entities with at least a ``HOT_SHARE``-th of all uses: at most ``HOT_SHARE`` rows of bounded width."""
    return entities.filter((F.col("n") * HOT_SHARE >= n_uses) & (F.length("canon") <= HOT_CHARS))


def replace_entities(spark: SparkSession, docs: DataFrame, key: str = "surrogate-key") -> DataFrame:
    """One row per row of ``docs``: doc_id, text with surrogates, n_entities."""
    texts = pinned(
        spark,
        docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", marked(F.col("text").cast("string")).alias("marked")),
        "pii-marked",
    )
    has = F.coalesce(F.contains("marked", F.lit(MARK)), F.lit(False))
    parts = F.split("marked", MARK, -1)  # text, entity, text, entity, ..., text

    def with_context(ps: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.floor(F.size(ps) / 2).cast("int") - 1),
            lambda i: F.struct(F.get(ps, 2 * i + 1).alias("value"), F.substr(F.get(ps, 2 * i), F.lit(-TITLE_CHARS), F.lit(TITLE_CHARS)).alias("before")),
        )

    listed = texts.filter(has).select("row", F.posexplode(let(parts, with_context)).alias("pos", "e"))
    name = titled(F.col("before"), TITLES) & F.rlike("value", F.lit(rf"^{NAME}(?:[ ]{NAME}){{0,2}}$"))
    typed = listed.select("row", "pos", "e.value", "e.before").select(
        "row", "pos", "value", F.when(name, "person").otherwise(entity_type(F.col("value"))).alias("kind"),
        F.when(titled(F.col("before"), PERSON_TITLE_F), "f").otherwise("m").alias("gender"),
    )
    uses = pinned(
        spark,
        typed.select("row", "pos", "value", "kind", canonical(F.col("kind"), F.col("value")).alias("canon"),
                     F.when(F.col("kind") == "person", F.col("gender")).otherwise("").alias("gender")),
        "pii-uses",
    )
    counted = pinned(spark, uses.groupBy("kind", "canon").agg(F.min("gender").alias("gender"), F.count("*").alias("n")), "pii-counts")
    attempts = settle(spark, counted.drop("n"), key)
    hot = hot_entities(counted, uses.count()).select("kind", "canon")
    spread = uses.drop("gender")
    # A hot entity would bring a third of all uses to one task: its few rows go to the uses instead.
    common = attempts.join(F.broadcast(hot), ["kind", "canon"], "left_semi")
    found = spread.join(F.broadcast(common), ["kind", "canon"]).unionByName(
        spread.join(F.broadcast(hot), ["kind", "canon"], "left_anti").join(attempts, ["kind", "canon"])
    )
    new = surrogate(key, F.col("kind"), F.col("value"), F.col("gender"), F.col("attempt"))
    replaced = (
        found.select("row", F.struct("pos", new.alias("new")).alias("r"))
        .groupBy("row").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    )
    woven = let(
        parts,
        lambda ps: F.array_join(
            F.transform(ps, lambda p, i: F.when(i % 2 == 0, p).otherwise(F.get(F.col("rs"), F.floor(i / 2).cast("int"))["new"])), ""
        ),
    )
    touched = texts.filter(has).join(replaced, "row").select(
        "doc_id", unescaped(woven).alias("text"), F.size("rs").cast("long").alias("n_entities")
    )
    plain = texts.filter(~has).select("doc_id", unescaped(F.col("marked")).alias("text"), F.lit(0).cast("long").alias("n_entities"))
    return plain.unionByName(touched)
