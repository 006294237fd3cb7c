"""PII surrogates: keyed, type-consistent replacements, in Spark expressions only.

Entities (e-mail and IP addresses, phone, card, social-security and bank account
numbers, secrets, names after a form of address) are found by one pattern.
Each is brought to a normal form, so that spellings of one entity agree, and
each distinct normal form gets one surrogate: a keyed hash shapes it after the
original (digit for digit, letter for letter, valid octets, a name of the same
gender and script), and it is poured back into the original's own format and
case.  The table of distinct entities is then checked: a surrogate may be
neither another entity's surrogate nor any entity of the corpus; those that
clash take the next attempt until none does.  So distinct entities stay distinct
and one entity has one surrogate everywhere.

Scale: texts are matched once, and rows are written with their entities and a
row number.  Only entity rows are shuffled, distinct ones with partial
aggregation, and an entity that is very common meets its one surrogate row in a
join that Spark may split.  Text without entities is passed on and never
shuffled.  Nothing is collected but row counts of clashes.

Defined cases: null text stays null; text without entities is unchanged; rows
are kept one by one, repeated or not; ids are not read; an empty table gives
an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

KEY = "surrogate-key"  # callers pass their own
MAX_ROUNDS = 50

# Forms of address by gender, and given names by gender and script.
MALE = ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Sir", "г-н", "Господин", "κ", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "г-жа", "Госпожа", "κα", "Κυρία")
NEUTRAL = ("Mx", "Dr", "Prof")
GIVEN = {
    ("m", "latin"): "Adam Bruno Carl David Emil Felix Gustav Hugo Ivan Jonas Karl Leon Martin Noel Oscar Paul".split(),
    ("f", "latin"): "Alma Berta Clara Dora Elena Flora Greta Helena Irma Julia Karla Laura Marta Nora Olga Paula".split(),
    ("u", "latin"): "Alex Robin Kim Sasha Noa Jules Charlie Sam Toni Andrea Dominique Camille Maxime Jessie Lou Kay".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Семён Фёдор".split(),
    ("f", "cyrillic"): "Алла Белла Вера Галина Дарья Елена Зоя Ирина Клара Лидия Мария Нина Ольга Полина Рита Софья".split(),
    ("u", "cyrillic"): "Саша Женя Валя Слава Паша Шура Тоня Витя Миша Лера Дина Рома Вася Стася Ника Юля".split(),
    ("m", "greek"): "Αλέξης Βασίλης Γιάννης Δημήτρης Ηλίας Θωμάς Κώστας Λάμπρος Μάριος Νίκος Πέτρος Σπύρος Στέλιος Τάσος Φώτης Χρήστος".split(),
    ("f", "greek"): "Άννα Βάσω Γεωργία Δήμητρα Ελένη Ζωή Ηρώ Θάλεια Κατερίνα Λυδία Μαρία Νίκη Ξένια Ρένα Σοφία Χαρά".split(),
    ("u", "greek"): "Άρι Βικτώ Κρις Άλεξ Ντένη Ρένη Χάρι Τζο Λεό Σάσα Μάξι Νικ Ροζ Έλι Φίλι Ζέφι".split(),
}
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ka ke la le li lo ma me mi mo na ne ni no ra re ri ro sa se ta te".split(),
    "cyrillic": "ба бе бо ва ве да де до за зе ка ке ко ла ле ло ма ме мо на не но ра ре ро са се со та те то ва".split(),
    "greek": "βα βε βο γα δα δε δο ζα κα κε κο λα λε λο μα με μο να νε νο πα πε πο ρα ρε ρο σα σε σο τα τε το".split(),
}

# Every group that repeats is bounded and its parts give nothing back, so long runs cost their length and no stack.
# An address starts where no character of a local part stands before it; it has up to 126 labels before the last.
_EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,254}+@(?:[\p{L}\p{N}-]{1,255}+\.){1,126}\p{L}{2,}+"
_KEYED = r"(?i:password|passwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?"
_SECRET = (r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[0-9A-Za-z]{30,}|sk-[0-9A-Za-z_-]{16,}|xox[abprs]-[0-9A-Za-z-]{10,}"
           r"|eyJ[0-9A-Za-z_-]{8,4096}+\.[0-9A-Za-z_-]{8,4096}+\.[0-9A-Za-z_-]++"
           r"|(?=[0-9A-Fa-f]{0,31}[A-Fa-f])[0-9A-Fa-f]{32,}(?![0-9A-Za-z])")
_IBAN = r"[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"
_IP = r"(?<!\d\.)(?:(?:25[0-5]|2[0-4]\d|1\d\d|\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|\d?\d)(?!\d|\.\d)"
_SSN = r"(?<!-)\d{3}-\d{2}-\d{4}(?![\d-])"
_PHONE = (r"(?<!\+)\+\d{1,3}[ .-]?(?:\(\d{1,5}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,4}(?!\d)"
          r"|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![.-])\d{3}[.-]\d{3}[.-]\d{4}(?!\d)")
_CARD = r"\d(?:[ -]?\d){12,18}(?!\d)"
_FORMS = sorted({y for x in (*MALE, *FEMALE, *NEUTRAL) for y in (x, x.upper() if len(x) > 1 and x.isascii() else x)}, key=lambda x: (-len(x), x))
_ADDRESSED = "(?:" + "|".join(_FORMS) + ")"
_NAME = rf"{_ADDRESSED}\.?[  ]\p{{Lu}}\p{{L}}+(?:[  ]\p{{Lu}}\p{{L}}+)?"
# an entity starts where no letter or digit stands before it, so most positions are passed at once
PATTERN = r"(?<![\p{L}\p{N}])(?:" + "|".join((_KEYED + r"[^\s\"']{8,}", _EMAIL, _SECRET, _IBAN, _IP, _SSN, _PHONE, _CARD, _NAME)) + ")"

_FORM = rf"^{_ADDRESSED}\.?[  ]"


def _full(pattern: str) -> str:
    return f"^(?:{pattern})$"


def kind_of(raw: Column) -> Column:
    """The entity type of a match, by the first pattern it fits."""
    return (F.when(raw.rlike("^" + _KEYED), "keyed").when(raw.rlike(_full(_EMAIL)), "email").when(raw.rlike(_FORM), "name").when(raw.rlike(_full(_IP)), "ip")
            .when(raw.rlike(_full(_SSN)), "ssn").when(raw.rlike(_full(_PHONE)), "phone").when(raw.rlike(_full(_CARD)), "card")
            .when(raw.rlike(_full(_IBAN)), "iban").otherwise("secret"))


def _script(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), "cyrillic").when(text.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _gender(form: Column) -> Column:
    bare = F.regexp_replace(form, r"[.  ]+$", "")
    of = lambda forms: F.upper(bare).isin(*[x.upper() for x in forms])
    return F.when(of(MALE), "m").when(of(FEMALE), "f").otherwise("u")


def _parts(raw: Column) -> Column:
    """An entity as (type, raw, norm) parts; names and keyed secrets have several. Parts of type 'keep' stay."""
    part = lambda kind, text, norm: F.struct(kind.alias("kind"), text.alias("raw"), norm.alias("norm"))
    keep = F.lit("keep")
    kind = kind_of(raw)
    form = F.regexp_extract(raw, _FORM, 0)
    rest = F.regexp_replace(raw, _FORM, "")
    first, gap = F.regexp_extract(rest, r"^\p{L}+", 0), F.regexp_extract(rest, r"^\p{L}+([  ])", 1)
    last = F.regexp_extract(rest, r"(\p{L}+)$", 1)
    given = F.concat(F.lit("given:"), _gender(form), F.lit(":"), _script(first))
    family = F.concat(F.lit("family:"), _script(last))
    both = F.array(part(keep, form, F.lit("")), part(given, first, F.lower(first)), part(keep, gap, F.lit("")), part(family, last, F.lower(last)))
    alone = F.array(part(keep, form, F.lit("")), part(family, last, F.lower(last)))
    norm = (F.when(kind == "email", F.lower(raw)).when(kind.isin("ssn", "phone", "card", "iban"), F.regexp_replace(raw, r"[^0-9A-Za-z]", ""))
            .otherwise(raw))
    value = F.regexp_replace(raw, "^" + _KEYED, "")
    keyed = F.array(part(keep, F.regexp_extract(raw, "^" + _KEYED, 0), F.lit("")), part(F.lit("secret"), value, value))
    return (F.when(kind == "keyed", keyed).when(kind != "name", F.array(part(kind, raw, norm)))
            .when(gap != "", both).otherwise(alone))


def _hash(key: str, kind: Column, norm: Column, attempt: Column, salt: str = "") -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key + salt), kind, norm, attempt.cast("string")), 256)


def _byte(stream: Column, i: Column) -> Column:
    """The i-th byte (from 0) of a hex stream."""
    return F.conv(F.substr(stream, (i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, also where the body uses it for each letter of a text."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shaped(norm: Column, h: Column, letters: int = 26) -> Column:
    """Digit for digit and letter for letter (of the first ``letters``), the rest as it is; 32 characters for each hash of ``h`` and a number."""
    def one(stream):
        def of(c, i):
            v = _byte(stream, i)
            return (F.when(c.rlike("[0-9]"), (v % 10).cast("string"))
                    .when(c.rlike("[a-z]"), F.chr(F.lit(97) + v % letters)).when(c.rlike("[A-Z]"), F.chr(F.lit(65) + v % letters)).otherwise(c))
        return of

    def chunk(text, number):
        return _let(F.sha2(F.concat_ws("\x1f", h, number.cast("string")), 256),
                    lambda stream: F.array_join(F.transform(F.split(text, ""), one(stream)), ""))

    return F.array_join(F.transform(F.regexp_extract_all(norm, F.lit("(?s).{1,32}"), F.lit(0)), chunk), "")


def _choose(options: list[str], v: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in options]), (v % len(options) + 1).cast("int"))


def surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The normal form's replacement, by the key and the attempt."""
    return _let(_hash(key, kind, norm, attempt), lambda h: _surrogate(kind, norm, attempt, key, h))


def _surrogate(kind: Column, norm: Column, attempt: Column, key: str, h: Column) -> Column:
    domain = F.regexp_extract(norm, r"@(.*)$", 1)
    d = _hash(key, F.lit("domain"), domain, F.lit(0))
    letters = lambda x, n: F.translate(F.substr(x, F.lit(1), F.lit(n)), "0123456789", "ghijkmnpqr")
    email = F.concat(letters(h, 12), F.lit("@"), letters(d, 8), F.lit(".example"))
    octet = lambda i: _byte(h, F.lit(i)).cast("string")
    ip = F.concat((_byte(h, F.lit(0)) % 223 + 1).cast("string"), *[x for i in (1, 2, 3) for x in (F.lit("."), octet(i))])
    prefix = F.regexp_extract(norm, r"^(AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|eyJ)", 1)
    tail = _shaped(F.regexp_replace(norm, r"^(AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|eyJ)", ""), h)
    secret = F.when(norm.rlike(r"^[0-9A-Fa-f]+$"), _shaped(norm, h, 6)).otherwise(F.concat(prefix, tail))
    # account numbers keep the country letters, phones and cards their first digit
    head = F.when(kind == "iban", F.lit(2)).when(kind == "ssn", F.lit(0)).otherwise(F.lit(1))
    number = F.concat(F.substr(norm, F.lit(1), head), _shaped(F.substr(norm, head + 1, F.length(norm)), h))
    syllable = lambda options, i: _choose(options, _byte(h, F.lit(i)))
    family, given = F.lit(None).cast("string"), F.lit(None).cast("string")
    for script, options in SYLLABLES.items():
        three = [syllable(options, i) for i in range(3)]
        more = [F.when(attempt > i, syllable(options, 3 + i)).otherwise("") for i in range(5)]
        built = F.initcap(F.concat(*three, *more))
        family = F.when(kind == f"family:{script}", built).otherwise(family)
        for g in "mfu":
            names = GIVEN[g, script]
            twice = F.concat(_choose(names, _byte(h, F.lit(8))), F.lit("-"), _choose(names, _byte(h, F.lit(9))))
            long = F.concat(twice, F.lit("-"), built)
            name = F.when(attempt == 0, _choose(names, _byte(h, F.lit(10)))).when(attempt < 3, twice).otherwise(long)
            given = F.when(kind == f"given:{g}:{script}", name).otherwise(given)
    return (F.when(kind == "email", email).when(kind == "ip", ip).when(kind.isin("phone", "card", "ssn", "iban"), number)
            .when(kind == "secret", secret).when(kind.startswith("family:"), family).otherwise(given))


def _poured(kind: Column, raw: Column, sur: Column) -> Column:
    """The surrogate in the format and case of this occurrence."""
    filled = F.aggregate(
        F.split(raw, ""), F.struct(F.lit("").alias("out"), sur.alias("rest")),
        lambda acc, c: F.when(c.rlike("[0-9A-Za-z]"), F.struct(F.concat(acc["out"], F.substr(acc["rest"], F.lit(1), F.lit(1))).alias("out"),
                                                              F.substr(acc["rest"], F.lit(2)).alias("rest")))
        .otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["rest"].alias("rest"))),
        lambda acc: acc["out"])
    loud = (raw == F.upper(raw)) & (raw != F.lower(raw))
    return (F.when(kind.isin("phone", "card", "ssn", "iban"), filled)
            .when(((kind == "email") | kind.startswith("given") | kind.startswith("family")) & loud, F.upper(sur)).otherwise(sur))


def surrogates(entities: DataFrame, key: str = KEY, shape=surrogate) -> DataFrame:
    """(kind, norm, sur) for distinct (kind, norm): no two alike, none an entity of the corpus."""
    known = C.written(entities.select("kind", "norm").distinct().withColumn("attempt", F.lit(0)), "entities")
    originals = known.select("kind", F.col("norm").alias("sur"), F.lit(True).alias("taken"))
    current = known
    for _ in range(MAX_ROUNDS):
        w = Window.partitionBy("kind", F.lower("sur")).orderBy("attempt", "norm")
        made = current.withColumn("sur", shape(F.col("kind"), F.col("norm"), F.col("attempt"), key))
        checked = C.written(
            made.withColumn("folded", F.lower("sur")).join(
                originals.select("kind", F.lower("sur").alias("folded"), "taken").distinct(), ["kind", "folded"], "left")
            .withColumn("clash", F.coalesce("taken", F.lit(False)) | (F.row_number().over(w) > 1))
            .select("kind", "norm", "attempt", "sur", "clash"), "surrogates")
        if not checked.where("clash").limit(1).count():
            return checked.select("kind", "norm", "sur")
        current = checked.select("kind", "norm", (F.col("attempt") + F.col("clash").cast("int")).alias("attempt"))
    raise RuntimeError("no distinct surrogates were found")


def replace_pii(docs: DataFrame, *, text_col: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with the text's entities replaced and, as last column, ``n_entities``."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    base = C.written(
        docs.select(*[docs[c].alias(n) for c, n in zip(docs.columns, names)],
                    F.coalesce(F.regexp_extract_all(docs[text_col], F.lit(PATTERN), 0), F.array().cast("array<string>")).alias("ents"))
        .select("*", F.size("ents").cast("long").alias("n_ents"), F.monotonically_increasing_id().alias("uid")), "found")
    found = base.where("n_ents > 0")
    rows = (found.select("uid", F.posexplode("ents").alias("pos", "raw"))
            .select("uid", "pos", F.posexplode(_parts(F.col("raw"))).alias("part", "p")).select("uid", "pos", "part", "p.*"))
    table = surrogates(rows.where("kind <> 'keep'"), key)
    out = F.when(F.col("sur").isNull(), F.col("raw")).otherwise(_poured(F.col("kind"), F.col("raw"), F.col("sur")))
    whole = (rows.join(table, ["kind", "norm"], "left").select("uid", "pos", "part", out.alias("out"))
             .groupBy("uid", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "out"))), lambda x: x["out"]), "").alias("out"))
             .groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "out"))), lambda x: x["out"]).alias("subs")))
    pieces = F.split(F.col(names[at]), PATTERN, -1)
    built = F.array_join(F.zip_with(pieces, "subs", lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    new = found.join(C.written(whole, "replacements"), "uid").select(
        *[(built if i == at else F.col(n)).alias(c) for i, (c, n) in enumerate(zip(docs.columns, names))], F.col("n_ents").alias("n_entities"))
    same = base.where("n_ents = 0").select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)], F.col("n_ents").alias("n_entities"))
    return same.union(new)


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(C.table(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities")
