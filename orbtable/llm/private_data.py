"""PII: detected entities get keyed surrogates of the same type, gender, script and format."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbtable.llm.common import attach_groups, documents, free_name, settle

MALE = ("Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "господин")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Fräulein", "госпожа")
_TITLE = "|".join(sorted({*MALE, *FEMALE}, key=lambda t: (-len(t), t)))
_NAME = r"\p{Lu}[\p{Ll}'’-]+"
#: Entities, the first that matches at a place wins: (kind, lead that stays, value that is replaced).
KINDS = [
    ("email", "", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+"),
    ("secret", r"\b(?i:password|passwd|pwd|token|secret|api[_-]?key)\s{0,3}[:=]\s{0,3}[\"']?", r"[^\s\"']{6,}+"),
    ("key", "", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("iban", "", r"\b[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?\b"),
    ("ip", "", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)"),
    ("phone", "", r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}+(?!\d)"),
    ("card", "", r"(?<![\d.-])(?:\d{4}[ -]?){3}\d{1,7}(?![\d-])"),
    ("ssn", "", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("name", rf"\b(?:{_TITLE})\.?\s", rf"{_NAME}(?: {_NAME})?"),
]
ENTITY = "|".join(f"(?:{lead}{value})" for _, lead, value in KINDS)
#: What every text with an entity holds; cheap to look for.
HINT = rf"[0-9@]|(?i:passw|pwd|token|secret|api.?key)|{_TITLE}"
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзиклмнопрстуфхцчшщэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ"]
#: Letters and numbers outside ALPHABETS become others of their script; of scripts not listed, a to z.
SCRIPTS = [
    (r"[\p{IsLatin}&&\p{Lu}]", ALPHABETS[2]), (r"\p{IsLatin}", ALPHABETS[1]), (r"[\p{IsCyrillic}&&\p{Lu}]", ALPHABETS[4]), (r"\p{IsCyrillic}", ALPHABETS[3]),
    (r"[\p{IsGreek}&&\p{Lu}]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"), (r"\p{IsGreek}", "αβγδεζηθικλμνξοπρστυφχψω"),
    (r"\p{IsHan}", "安白北草长春大东风高古海河红花黄江金京兰林龙路马明木南平青清泉山石水松天田王文西小新星雪阳云竹"),
    (r"\p{IsHiragana}", "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ"),
    (r"\p{IsKatakana}", "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ"),
    (r"\p{IsHangul}", "가나다라마바사아자차카타파하고노도로모보소오조초코토포호구누두루무부수우주추쿠투푸후"),
    (r"[\p{IsArabic}&&\p{L}]", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"), (r"[\p{IsHebrew}&&\p{L}]", "אבגדהוזחטיכלמנסעפצקרשת"),
    (r"[\p{IsDevanagari}&&\p{L}]", "कखगघचछजझटठडढतथदधनपफबभमयरलवशसह"), (r"[\p{IsThai}&&\p{L}]", "กขคงจชซดตถทนบปผพมยรลวสหอ"),
    (r"[\u0660-\u0669]", "٠١٢٣٤٥٦٧٨٩"), (r"[\u06F0-\u06F9]", "۰۱۲۳۴۵۶۷۸۹"), (r"[\u0966-\u096F]", "०१२३४५६७८९"), (r"\p{N}", ALPHABETS[0]), (r"\p{L}", ALPHABETS[1]),
]
GIVEN = {
    "m": "Adam Bruno Carlos David Emil Felix Georg Hugo Ivan Jonas Karl Leon Marco Nils Oscar Paul Ralf Simon Theo Victor",
    "f": "Anna Berta Clara Diana Elena Frida Greta Helga Irene Julia Karin Laura Maria Nora Olga Paula Rosa Sonja Tanja Vera",
    "мm": "Алексей Борис Виктор Глеб Дмитрий Егор Иван Кирилл Леонид Михаил Никита Олег Павел Роман Сергей Тимур",
    "мf": "Алла Вера Галина Дарья Елена Жанна Зоя Ирина Клара Лариса Мария Нина Ольга Полина Раиса Светлана",
}
SYLLABLES = {"": "ba ce di fo gu ha ke li mo nu pa re si to vu wa ze la ni ro", "м": "ба ве ги до жу за ки лу мо не па ри со ту фа хе ца чи шо ля"}
ROUNDS = 16
#: Numbered surrogates of what has no other: text before the number and after it, as in the canonical value.
NUMBERED = {"email": ("user-", "@private.invalid"), "phone": ("999", "")} | {k: (f"{k}-", "") for k, _, _ in KINDS if k not in ("email", "phone")}


def entities(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(f"({ENTITY})"), 1))


def _kind(entity: Column) -> Column:
    """The first kind that matches the entity as a whole."""
    out = F.lit("name")
    for kind, lead, value in reversed(KINDS[:-1]):
        out = F.when(entity.rlike(f"^(?:{lead}{value})$"), kind).otherwise(out)
    return out


def _value(entity: Column, kind: Column) -> Column:
    """The part that is replaced; what stands before it stays."""
    secret, name = (next(lead for k, lead, _ in KINDS if k == n) for n in ("secret", "name"))
    return F.when(kind == "secret", F.regexp_replace(entity, f"^{secret}", "")).when(kind == "name", F.regexp_replace(entity, f"^{name}", "")).otherwise(entity)


def _canon(value: Column, kind: Column) -> Column:
    """What makes two mentions the same: digits of numbers, e-mail without case, else the value."""
    return F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(value, r"\D", "")).when(
        kind == "iban", F.replace(value, F.lit(" "), F.lit(""))).when(kind == "email", F.lower(value)).otherwise(value)


def _gender(entity: Column) -> Column:
    return F.when(entity.rlike(f"^(?:{'|'.join(FEMALE)})"), "f").otherwise("m")


def _pick(choices: str, at: Column, sep: str | None = None) -> Column:
    items = choices.split(sep) if sep else list(choices)
    return F.get(F.array(*map(F.lit, items)), (at % len(items)).cast("int"))


def _luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits, the last one undoubled."""
    return F.aggregate(F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.when(d.cast("int") > 4, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int")))), F.lit(0), lambda a, x: a + x)


def surrogate(kind: Column, canon: Column, gender: Column, attempt: Column, key: str) -> Column:
    """Keyed surrogate of a canonical value: same kind, length, script and character classes.

    Letters and digits come from an HMAC-like digest of key, kind, value and attempt. The first digit
    of numbers, key prefixes and the top-level domain stay; a card number with a right check digit
    gets one; IP parts stay in range. Later attempts free the number of digits of an IP part, and
    give names more syllables.
    """
    pad = F.concat_ws("|", F.lit(key), kind, gender, canon, attempt.cast("string"))
    stream = F.concat(*[F.sha2(F.concat(pad, F.lit(f"|{key}|{j}")), 256) for j in range(4)])
    byte = lambda i: F.conv(F.substring(stream, 1, 256).substr((i % 128) * 2 + F.lit(1), F.lit(2)), 16, 10).cast("int")
    kept = F.when(kind == "email", F.length(F.regexp_extract(canon, r"\.[^.]*$", 0))).otherwise(0)

    def char(c: Column, i: Column) -> Column:
        other = c
        for script, letters in reversed(SCRIPTS):
            other = F.when(c.rlike(script), _pick(letters, byte(i))).otherwise(other)
        out = F.when(c.rlike(r"[\p{L}\p{N}]"), other).otherwise(c)
        for letters in reversed(ALPHABETS):
            out = F.when(F.instr(F.lit(letters), c) > 0, _pick(letters, byte(i))).otherwise(out)
        out = F.when(canon.rlike("^[0-9a-f]+$") & (kind == "secret"), _pick("0123456789abcdef", byte(i))).otherwise(out)
        out = F.when(canon.rlike("^[0-9A-F]+$") & (kind == "secret"), _pick("0123456789ABCDEF", byte(i))).otherwise(out)
        stay = (i < F.when(kind == "key", 4).when(kind.isin("phone", "card"), 1).when(kind == "iban", 2).otherwise(0)) | (i >= F.length(canon) - kept)
        return F.when(stay, c).otherwise(out)

    plain = F.array_join(F.transform(F.split(canon, ""), char), "")
    head = F.substring(plain, 1, 1000).substr(F.lit(1), F.length(plain) - 1)
    card = F.when(_luhn(canon) % 10 == 0, F.concat(head, ((10 - _luhn(F.concat(head, F.lit("0"))) % 10) % 10).cast("string"))).otherwise(plain)

    def part(p: Column, i: Column) -> Column:
        b = byte(i * 2) * 256 + byte(i * 2 + 1)
        sized = F.when(F.length(p) == 1, 1 + b % 9).when(F.length(p) == 2, 10 + b % 90).otherwise(100 + b % 156)
        return F.when(attempt < 4, sized).otherwise(1 + b % 254).cast("string")

    ip = F.array_join(F.transform(F.split(canon, r"\."), part), ".")
    cyrillic = canon.rlike(r"^\p{IsCyrillic}")

    def family(script: str, start: int) -> Column:
        return F.initcap(F.array_join(F.transform(F.sequence(F.lit(start), F.lit(start + 2) + attempt), lambda i: _pick(SYLLABLES[script], byte(i), " ")), ""))

    def named(script: str) -> Column:
        given = F.when(gender == "f", _pick(GIVEN[script + "f"], byte(F.lit(0)), " ")).otherwise(_pick(GIVEN[script + "m"], byte(F.lit(0)), " "))
        return F.when(F.instr(canon, " ") > 0, F.concat(given, F.lit(" "), family(script, 1))).otherwise(family(script, 4))

    return F.when(kind == "name", F.when(cyrillic, named("м")).otherwise(named(""))).when(kind == "ip", ip).when(kind == "card", card).otherwise(plain)


def _render(entity: Column, value: Column, kind: Column, sur: Column, numbered_: Column) -> Column:
    """The surrogate in the mention's own format, after its lead; a numbered one as it is."""
    numbered = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(
        c.rlike("[0-9A-Z]"), F.substring(sur, 1, 1000).substr(F.length(F.regexp_replace(value.substr(F.lit(1), i + 1), "[^0-9A-Z]", "")), F.lit(1))).otherwise(c)), "")
    cased = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(
        c != F.lower(c), F.upper(F.substring(sur, 1, 1000).substr(i + 1, F.lit(1)))).otherwise(F.substring(sur, 1, 1000).substr(i + 1, F.lit(1)))), "")
    cased = F.when(F.length(F.lower(value)) == F.length(value), cased).otherwise(sur)
    own = F.when(kind == "phone", F.regexp_replace(sur, r"^(\d{3})(\d{4})(\d{4})(\d{4})$", r"+$1 $2 $3 $4")).otherwise(sur)
    shown = F.when(numbered_, own).when(kind.isin("phone", "card", "ssn", "iban"), numbered).when(kind == "email", cased).otherwise(sur)
    return F.concat(entity.substr(F.lit(1), F.length(entity) - F.length(value)), shown)


def _fixed() -> Column:
    """Whether no attempt can change a value: it has no letter and no digit that may go."""
    free = F.when(F.col("kind") == "email", F.regexp_replace("canon", r"\.[^.]*$", "")).otherwise(F.col("canon"))
    return F.col("kind").isin("email", "secret") & ~free.rlike(r"[\p{L}\p{N}]")


def numbered(rest: DataFrame, used: DataFrame) -> DataFrame:
    """(kind, gender, canon, sur) of `rest` with its rank in `sur`, after all such numbers in `used` (kind, sur)."""
    form = lambda k, ends: F.when(F.col("kind") == k, F.regexp_extract("sur", rf"^{ends[0]}(\d{{{'12' if k == 'phone' else '1,17'}}}){ends[1].replace('.', '[.]')}$", 1))
    seen = F.coalesce(*[form(k, ends) for k, ends in NUMBERED.items()])
    start = used.select(F.max(seen.try_cast("long"))).first()[0] or 0
    order = ["kind", "canon", "gender"]
    # sorted by range, so that rows are numbered by their place in the partition and the sizes of those before it
    ranked = settle(rest.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("at", 33)
    offsets, total = [], start + 1
    for r in sorted(ranked.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):  # one row per partition
        offsets += [F.lit(r["part"]), F.lit(total)]
        total += r["n"]
    if not offsets:
        return ranked.select("kind", "gender", "canon", F.lit("").alias("sur"))
    n = (F.element_at(F.create_map(*offsets), part) + F.col("at").bitwiseAND((1 << 33) - 1)).cast("string")
    sur = F.coalesce(*[F.when(F.col("kind") == k, F.concat(F.lit(x), F.lpad(n, 12, "0") if k == "phone" else n, F.lit(y))) for k, (x, y) in NUMBERED.items()])
    return ranked.select("kind", "gender", "canon", sur.alias("sur"))


def dictionary(found: DataFrame, key: str) -> DataFrame:
    """(kind, gender, canon, sur, numbered) for the distinct entities of `found`: one surrogate each, none shared.

    Surrogates that two entities share, or that are themselves entities of the corpus, go to one of
    them or to none; the others try again with the next attempt until nothing collides. What cannot
    change, or still collides after ROUNDS, gets a numbered surrogate of its kind.
    """
    known = settle(found.select("kind", "gender", "canon").distinct(), "entities")
    state = known.where(~_fixed()).withColumn("attempt", F.lit(0))
    make = lambda df: df.withColumn("sur", surrogate(F.col("kind"), F.col("canon"), F.col("gender"), F.col("attempt"), key))
    taken = known.select("kind", F.col("canon").alias("sur")).distinct().withColumn("real", F.lit(True))
    rest = known.where(_fixed())
    for left in reversed(range(ROUNDS)):
        tried = settle(make(state), "tried")
        owner = tried.groupBy("kind", "sur").agg(F.count("*").alias("n"), F.min(F.struct("canon", "gender")).alias("owner"))
        clash = owner.join(taken, ["kind", "sur"], "left").where("n > 1 OR real").select("kind", "sur", "owner", F.coalesce("real", F.lit(False)).alias("real"))
        clash = settle(clash, "clash")
        done = tried.select("kind", "gender", "canon", "sur")
        if not clash.limit(1).count():
            break
        lost = F.coalesce(F.col("real") | (F.struct("canon", "gender") != F.col("owner")), F.lit(False))
        state = settle(tried.join(clash, ["kind", "sur"], "left").select("kind", "gender", "canon", "sur", lost.alias("lost"), (F.col("attempt") + lost.cast("int")).alias("attempt")), "state")
        if not left:
            done, rest = state.where(~F.col("lost")).select(done.columns), rest.unionByName(state.where("lost").select(rest.columns))
        state = state.drop("sur", "lost")
    done = done.withColumn("numbered", F.lit(False))
    if not rest.limit(1).count():
        return done
    return done.unionByName(numbered(rest, taken.select("kind", "sur").unionByName(done.select("kind", "sur"))).withColumn("numbered", F.lit(True)))


def replace_private(docs: DataFrame, key: str = "orbtable", count: str | None = None) -> DataFrame:
    """`docs` with the entities of `text` replaced, and optionally their number as column `count`.

    Kinds are e-mail and IP addresses, phone, card, account and social security numbers, secrets after
    their label, cloud keys, and names after a title. One entity has one surrogate in all documents,
    two entities never share one, and no surrogate is an entity of the corpus; values without a letter
    or digit, and those of a full format, are numbered instead. Everything between
    entities stays as it is, byte for byte. Documents without entities pass without a shuffle. A null
    text stays null and counts 0; repeated rows get the same text; other columns are not touched.
    """
    n = count or free_name(docs, "_found")
    mark, sig, new = (free_name(docs, x) for x in ("_entities", "_signature", "_replaced"))
    found = F.coalesce(entities(F.col("text")), F.array().cast("array<string>"))
    marked = docs.withColumn(mark, found)
    signed = F.sha2(F.array_join(F.col(mark), "\x01"), 256)
    with_any = marked.where(F.size(mark) > 0).withColumn(sig, signed)
    lists = settle(with_any.select(F.col(sig).alias("sig"), F.col(mark).alias("list")).groupBy("sig").agg(F.first("list").alias("list"), F.count("*").alias("size")), "lists")
    kind = _kind(F.col("entity"))
    each = lists.select("sig", F.posexplode("list").alias("pos", "entity")).withColumn("kind", kind)
    each = each.withColumn("value", _value(F.col("entity"), F.col("kind"))).withColumn("canon", _canon(F.col("value"), F.col("kind")))
    each = settle(each.withColumn("gender", F.when(F.col("kind") == "name", _gender(F.col("entity"))).otherwise("")), "mentions")
    book = dictionary(each, key)
    shown = each.join(book, ["kind", "gender", "canon"]).select("sig", "pos", _render(F.col("entity"), F.col("value"), F.col("kind"), F.col("sur"), F.col("numbered")).alias("shown"))
    new_lists = shown.groupBy("sig").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "shown"))), lambda x: x["shown"]).alias(new))
    groups = settle(lists.select("sig", "size").join(new_lists, "sig").select(F.col("sig").alias(sig), F.col("size").alias(free_name(docs, "_size")), new), "replacements")
    size = free_name(docs, "_size")
    total = lists.agg(F.sum("size")).first()[0] or 0
    told = attach_groups(with_any, groups, sig, size, total)
    pieces = F.split(F.col("text"), ENTITY, -1)
    # one more piece than entities
    text = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(F.col(new), i), F.lit("")))), "")
    told = told.withColumn("text", text).withColumn(n, F.size(new).cast("long"))
    none = marked.where(F.size(mark) == 0).withColumn(n, F.lit(0).cast("long"))
    columns = [*docs.columns, n] if count else docs.columns
    return none.select(columns).unionByName(told.select(columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` without private data."""
    return replace_private(documents(spark, sf_dir), count="n_entities").select("doc_id", "n_entities", "text")
