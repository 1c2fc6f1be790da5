"""Replace personal data and secrets by keyed surrogates of the same type, script and format."""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeguard.llm.common import prepare, stored

#: Re-keyed entities up to this many (about 100 bytes each) are broadcast; more are joined to their documents.
BROADCAST_ENTITIES = 50_000
#: From this attempt on surrogates get longer (addresses: come from wider ranges), as their own space may be full.
WIDE = 4
#: No entity comes this far: its surrogate would have 128 more characters than the entity itself.
LAST = WIDE + 8

# Given names by gender and script, and titles that tell a gender.
NAMES = {
    ("f", "latin"): ["Anna", "Beth", "Clara", "Diana", "Elena", "Frida", "Grace", "Helen", "Irene", "Julia", "Karen", "Laura", "Maria", "Nora", "Olivia", "Paula", "Rosa", "Sofia", "Teresa", "Vera"],
    ("m", "latin"): ["Adam", "Bruno", "Carl", "David", "Erik", "Felix", "George", "Hugo", "Ivan", "James", "Kevin", "Lucas", "Martin", "Noah", "Oscar", "Peter", "Robert", "Simon", "Thomas", "Victor"],
    ("n", "latin"): ["Alex", "Ariel", "Charlie", "Dana", "Jamie", "Jordan", "Kim", "Morgan", "Robin", "Sam", "Sasha", "Taylor"],
    ("f", "cyrillic"): ["Анна", "Вера", "Дарья", "Елена", "Зоя", "Ирина", "Мария", "Нина", "Ольга", "Софья"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Михаил", "Олег", "Павел"],
    ("n", "cyrillic"): ["Саша", "Женя", "Валя", "Шура"],
}
SURNAMES = {
    "latin": ["Abbot", "Baker", "Carter", "Dalton", "Ellis", "Fisher", "Garner", "Harris", "Ingram", "Jensen", "Keller", "Lawson", "Mercer", "Norris", "Osborn", "Porter", "Reeves", "Sawyer", "Turner", "Walker"],
    "cyrillic": ["Белов", "Волков", "Громов", "Зайцев", "Киселев", "Лебедев", "Морозов", "Новиков", "Орлов", "Соколов"],
}
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Sir": "m", "Madam": "f", "Herr": "m", "Frau": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f",
          "Monsieur": "m", "Madame": "f", "Mme": "f", "Dr": "n", "Prof": "n", "Господин": "m", "Госпожа": "f"}

#: What stands for a secret of signs only, which are those that may be in one.
SIGNS = "!#$%&()*+-./:<=>?@[]^_{|}~"

_WORD = r"[^\W\d_]"
#: Each kind of entity and its pattern; the first that matches at a place counts.
KINDS: dict[str, str] = {
    "email": r"(?<![\w.+-])[\w.+-]{1,64}@(?:[\w-]{1,63}\.){1,8}[^\W0-9_]{2,24}(?![\w-])",
    "secret": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?<=password=)[^\s\"',;]{4,200}|(?<=token = \")[^\"\s]{8,200}(?=\")|(?<=secret=)[^\s\"',;]{4,200}|(?<=api_key=)[^\s\"',;]{4,200}",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\w]|\.[0-9])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "iban": r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "card": r"(?<![\w.+-])(?:[0-9][ -]?){12,18}[0-9](?![\w-])",
    "phone": r"(?<![\w.+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9](?:[ .-]?[0-9]){5,12}(?!\w)|(?<![\w.(+])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?!\w)|(?<![\w.-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![\w-])",
    "name": rf"(?<!\w)(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})\.?[ ]{_WORD}+(?:[ -]{_WORD}+)?(?!\w)",
}
_FINDER = re.compile("|".join(f"(?P<{k}>{p})" for k, p in KINDS.items()))
# Every entity has a digit, an @ or one of these words in it or just before it.
_SIGNS = re.compile("[@0-9]")
_CUES = [*TITLES, "password=", "token = ", "secret=", "api_key="]
#: Characters left and right of such a sign within which its entity lies; the rest of a text is not searched.
_LEFT, _RIGHT = 128, 640


def _regions(text: str) -> list[tuple[int, int]]:
    """Stretches around the signs, widened to white space and joined."""
    at = [m.start() for m in _SIGNS.finditer(text)]
    for cue in _CUES:
        found = text.find(cue)
        while found >= 0:
            at.append(found)
            found = text.find(cue, found + 1)
    out: list[list[int]] = []
    for i in sorted(at):
        begin, end = max(0, i - _LEFT), min(len(text), i + _RIGHT)
        if out and begin <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([begin, end])
    for r in out:
        while r[0] > 0 and not text[r[0] - 1].isspace():
            r[0] -= 1
        while r[1] < len(text) and not text[r[1]].isspace():
            r[1] += 1
    return [(a, b) for a, b in out]


#: How cards are printed; digits in one piece must have the check digit of a card.
_GROUPED = re.compile(r"[0-9]{4}([ -])(?:[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{6}\1[0-9]{4,5})")


def _luhn(digits: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def _person(value: str) -> tuple[str, list[str], list[str]]:
    """(title with what follows it, names, separators between the names)."""
    title, space, rest = value.partition(" ")
    parts = re.split(r"([ -])", rest)
    return title + space, parts[::2], parts[1::2]


def entities(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of each entity of a whole text, from left to right, none overlapping.

    The canonical form is what makes two mentions one entity: case of a mail address, spacing of a number, title
    of a person do not matter.
    """
    at = 0
    for begin, stop in _regions(text):
        at = max(at, begin)
        while m := _FINDER.search(text, at, stop):
            found = _entity(m)
            if found is None:
                at = m.start() + 1
            else:
                at = found[1]
                yield found


def _entity(m: re.Match) -> tuple[int, int, str, str] | None:
    """What a match is, with its end moved where only a part of it counts."""
    kind, value, end = m.lastgroup, m.group(), m.end()
    if kind == "name":
        names = _person(value)[1]
        good = [n for n in names if n[0].isupper() and n[1:] == n[1:].lower()]
        if names[0] not in good:
            return None
        if len(good) < len(names):  # the word after the name is none
            end = m.start() + len(value) - len(names[-1]) - 1
            value = value[: end - m.start()]
        return m.start(), end, kind, " ".join(_person(value)[1]).casefold()
    if kind == "card" and not (_luhn(value) if value.isdigit() else _GROUPED.fullmatch(value)):
        return None  # a number of another kind
    if kind in ("card", "phone", "ssn", "iban"):
        return m.start(), end, kind, re.sub(r"[^0-9A-Z+]", "", value)
    if kind == "secret" and len(set(value)) == 1 and not _drawn(value[0]):
        return None  # a mask, as in password=****
    return m.start(), end, kind, value.casefold() if kind == "email" else value


def _stream(key: bytes, *parts: str) -> Callable[[int], int]:
    """Numbers below a bound, from a keyed hash of the parts."""
    seed, state = hmac.new(key, "\x00".join(parts).encode("utf-8", "surrogatepass"), hashlib.sha256).digest(), [0, b""]

    def draw(bound: int) -> int:
        if len(state[1]) < 8:
            state[0] += 1
            state[1] = hashlib.sha256(seed + state[0].to_bytes(8, "big")).digest()
        x, state[1] = int.from_bytes(state[1][:8], "big"), state[1][8:]
        return x % bound

    return draw


def _drawn(c: str) -> bool:
    """Whether ``_like`` gives other characters for this one."""
    return c.isalpha() or c.isdecimal()


def _like(c: str, draw: Callable[[int], int], hexadecimal: bool = False) -> str:
    """A character of the same class: digit, or letter of the same case and script."""
    if "0" <= c <= "9":
        return "0123456789"[draw(10)]
    if c.isdecimal():
        return chr(ord(c) - unicodedata.decimal(c) + draw(10))
    if not c.isalpha():
        return c
    if c.isascii():
        pool = "abcdef" if hexadecimal and c in "abcdefABCDEF" else "abcdefghijklmnopqrstuvwxyz"
        x = pool[draw(len(pool))]
        return x.upper() if c.isupper() else x
    script = unicodedata.name(c, "").split(" ")[0]
    first = {"CYRILLIC": "а", "GREEK": "α"}.get(script)
    if first is None:  # accented Latin letters and other scripts: a neighbour in the same block that is a letter of that case
        block = [chr(x) for x in range(ord(c) & ~0x1F, (ord(c) | 0x1F) + 1)]
        pool = [x for x in block if x.isalpha() and x.isupper() == c.isupper() and unicodedata.name(x, "").split(" ")[0] == script]
        if len(pool) == 1:  # as for ß, which has no neighbour of its kind
            return _like("A" if c.isupper() else "a", draw)
        return pool[draw(len(pool))]
    x = chr(ord(first) + draw(17))
    return x.upper() if c.isupper() else x


def _more(like: str, draw: Callable[[int], int], attempt: int) -> str:
    """What makes a surrogate longer: nothing before ``WIDE``, then 1, 2, 4, ... characters."""
    return "".join(_like(like, draw) for _ in range(1 << attempt - WIDE)) if attempt >= WIDE else ""


def surrogate(kind: str, canonical: str, key: bytes, attempt: int = 0) -> str:
    """The canonical form of the replacement, decided by key, entity and attempt: of the same kind, and before
    ``WIDE`` of the same length."""
    draw = _stream(key, kind, canonical, str(attempt))
    if kind == "name":
        return canonical  # names are drawn with the person's gender and script
    if kind == "ip":  # private addresses, then reserved ones, then those of IPv6 for documentation
        if attempt > WIDE:
            return "2001:db8:" + ":".join(f"{draw(1 << 16):x}" for _ in range(6))
        if attempt == WIDE:
            return f"{240 + draw(15)}." + ".".join(str(draw(256)) for _ in range(3))
        return "10." + ".".join(str(draw(256)) for _ in range(3))
    if kind == "email":
        local, _, host = canonical.partition("@")
        labels = host.split(".")
        return "".join(_like(c, draw) for c in local) + _more("a", draw, attempt) + "@" + ".".join("".join(_like(c, draw) for c in x) for x in labels[:-1]) + "." + labels[-1]
    if kind == "phone":
        keep = 2 if canonical.startswith("+") else 0
        return canonical[:keep] + "".join(_like(c, draw) for c in canonical[keep:]) + _more("0", draw, attempt)
    if kind == "card":
        body = canonical[0] + "".join(_like(c, draw) for c in canonical[1:-1]) + _more("0", draw, attempt)
        check = next(d for d in "0123456789" if _luhn(body + d)) if _luhn(canonical) else _like(canonical[-1], draw)
        return body + check
    if kind == "iban":
        body = "".join(_like(c, draw) for c in canonical[4:]) + _more("0", draw, attempt)
        number = "".join(str(int(c, 36)) for c in body + canonical[:2] + "00")
        return canonical[:2] + f"{98 - int(number) % 97:02d}" + body
    if kind == "secret" and canonical.startswith("AKIA"):
        return "AKIA" + "".join(_like(c, draw) for c in canonical[4:]) + _more("A", draw, attempt)
    if not any(map(_drawn, canonical)):
        return "".join(SIGNS[draw(len(SIGNS))] for _ in canonical) + _more("a", draw, attempt)
    hexadecimal = kind == "secret" and re.fullmatch("[0-9a-fA-F]+", canonical) is not None
    new = "".join(_like(c, draw, hexadecimal) for c in canonical)
    return new + _more("a" if any(c.isalpha() for c in canonical) and not hexadecimal else "0", draw, attempt)


def _script(text: str) -> str:
    """The script of a name's letters where there are names on the lists for it, else ``other``."""
    scripts = {unicodedata.name(c, "").split(" ")[0].lower() for c in text if c.isalpha()}
    return next(iter(scripts)) if scripts in ({"latin"}, {"cyrillic"}) else "other" if scripts else "latin"


def named(canonical: str, gender: str, script: str, key: bytes, attempt: int) -> list[str]:
    """The parts of a person's surrogate name, as many as the name has."""
    draw = _stream(key, "name", canonical, script, str(attempt))
    parts = canonical.split(" ")
    if script == "other":  # letter by letter in the scripts of the name
        made = ["".join(_like(c, draw) for c in p) for p in (parts[0], parts[-1])[-len(parts):]]
        made[-1] += _more(parts[-1][-1], draw, attempt)
        return [x[:1].upper() + x[1:] for x in made]
    pool, family = NAMES[gender, script], SURNAMES[script]
    given = [pool[draw(len(pool))]] if len(parts) > 1 else []
    tail = "".join(_like(c, draw) for c in parts[-1][: 2 + attempt]) + _more("а" if script == "cyrillic" else "a", draw, attempt)  # names on the lists alone would soon repeat
    surname = family[draw(len(family))]
    if script == "cyrillic":  # the ending tells the gender
        return [*given, surname[:-2] + tail.lower() + surname[-2:] + ("а" if gender == "f" else "")]
    return [*given, surname + tail.lower()]


def _title_gender(mention: str) -> str:
    return TITLES[_person(mention)[0].strip(" .")]


def shaped(kind: str, mention: str, canonical: str, new: str, key: bytes, attempt: int, gender: str | None = None) -> str:
    """The surrogate in the format of a mention: its punctuation, spacing and case. A person whose mentions differ in
    gender has one given."""
    if kind == "name":
        title, names, between = _person(mention)
        parts = named(canonical, gender or _title_gender(mention), _script(canonical), key, attempt)
        return title + "".join(a + b for a, b in zip(parts, [*between, ""], strict=True))
    if kind == "email":
        return "".join(b.upper() if a.isupper() else b for a, b in zip(mention, new, strict=True)) if len(mention) == len(new) else new
    if kind in ("card", "phone", "ssn", "iban"):
        signs = iter(new)
        return "".join([*(next(signs) if c == "+" or (c.isascii() and c.isalnum()) else c for c in mention), *signs])
    return new


def same_form(kind: str, canonical: str, key: bytes, attempt: int, gender: str) -> str:
    """What must differ between entities of a kind: the surrogate, for persons the name that is written."""
    if kind != "name":
        return surrogate(kind, canonical, key, attempt)
    return " ".join(named(canonical, gender, _script(canonical), key, attempt)).casefold()


def replace(text: str, key: bytes, attempts: dict) -> tuple[str, list[tuple[str, int, int]]]:
    """(new text, (kind, start, length) of every replacement in the old one)."""
    parts, spans, at = [], [], 0
    for start, end, kind, canonical in entities(text):
        attempt, gender = attempts.get((kind, canonical), (0, None))
        parts += [text[at:start], shaped(kind, text[start:end], canonical, surrogate(kind, canonical, key, attempt), key, attempt, gender)]
        spans.append((kind, start, end - start))
        at = end
    return "".join([*parts, text[at:]]), spans


def _found(batches):
    for batch in batches:
        seen = {(kind, canonical, _title_gender(t[a:b]) if kind == "name" else "n")
                for t in batch.column(0).to_pylist() for a, b, kind, canonical in entities(t or "")}
        rows = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["kind", "entity", "gender"])


def _named(key: bytes):
    def run(batches):
        for batch in batches:
            kind, entity, gender, _, attempt = (c.to_pylist() for c in batch.columns)
            new = [same_form(k, e, key, n, g) for k, e, g, n in zip(kind, entity, gender, attempt, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names=["kind", "entity", "gender", "mixed", "attempt", "new"])

    return run


def attempts(texts: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, attempt, gender) of the entities that must be keyed again so that all surrogates stay apart, and
    of the persons whose titles differ in gender: one that tells it counts over those that do not, and if titles of
    both are found, or none tells it, a given name of either is taken.

    A surrogate must not be an entity of the corpus, nor that of another entity. Of entities that meet, the smallest
    stays and the others take the next attempt, until none meet: rounds over ever fewer rows, ``LAST`` at most.
    """
    mentions = texts.mapInArrow(_found, "kind string, entity string, gender string").groupBy("kind", "entity").agg(
        *(F.bool_or(F.col("gender") == g).alias(g) for g in "fmn"))
    found = stored(mentions.select(
        "kind", "entity", F.when(F.col("f") & ~F.col("m"), "f").when(F.col("m") & ~F.col("f"), "m").otherwise("n").alias("gender"),
        (F.col("entity").contains(" ") & (F.col("f").cast("int") + F.col("m").cast("int") + F.col("n").cast("int") > 1)).alias("mixed"), F.lit(0).alias("attempt")), "entities")
    named_schema = "kind string, entity string, gender string, mixed boolean, attempt int, new string"
    settled = stored(found.mapInArrow(_named(key), named_schema), "surrogates")
    for _ in range(LAST):
        real = found.select("kind", F.col("entity").alias("new")).withColumn("__real", F.lit(True))
        first = settled.groupBy("kind", "new").agg(F.count("*").alias("__n"), F.min(F.struct("attempt", "entity")).alias("__first")).filter("__n > 1")
        meets = settled.join(real, ["kind", "new"], "left").join(first, ["kind", "new"], "left").withColumn(
            "__again", F.coalesce(F.col("__real"), F.lit(False)) | F.coalesce(F.col("__first.entity") != F.col("entity"), F.lit(False)))
        again = stored(meets.filter("__again").select("kind", "entity", "gender", "mixed", (F.col("attempt") + 1).alias("attempt")), "again")
        if again.isEmpty():
            return settled.filter("attempt > 0 or mixed").select("kind", "entity", "attempt", "gender")
        renamed = again.mapInArrow(_named(key), named_schema)
        settled = stored(settled.join(again.select("kind", "entity"), ["kind", "entity"], "left_anti").unionByName(renamed), "surrogates")
    raise RuntimeError(f"surrogates still meet after {LAST} attempts")


def _replaced(batch, bodies, keys: bytes, table: Callable[[int], dict]):
    new, counts, kinds = [], [], []
    for n, t in enumerate(bodies):
        done, spans = (None, []) if t is None else replace(t, keys, table(n))
        new.append(done)
        counts.append(len(spans))
        kinds.append([k for k, _, _ in spans])
    return new, counts, kinds


def surrogates(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """All columns of ``df`` with surrogates in ``text``, beside ``n_entities`` and ``entity_kinds``.

    One entity has one surrogate in all documents, different entities have different ones. NULL texts stay NULL,
    texts without entities stay as they are, repeated rows change alike; columns of the two names are replaced.
    """
    spark = df.sparkSession
    prepare(spark)
    secret = key.encode()
    new_names = ["n_entities", "entity_kinds"]
    kept = [c for c in df.columns if c.lower() not in new_names]
    source = df.select(*(F.col(f"`{c}`") for c in kept))
    again = stored(attempts(df.select(F.col(text).alias("t")), secret), "attempts")
    place = kept.index(text)
    if again.count() <= BROADCAST_ENTITIES:
        shipped = spark.sparkContext.broadcast({(r["kind"], r["entity"]): (r["attempt"], r["gender"]) for r in again.collect()})
        own, joined = (lambda batch: lambda n: shipped.value), source
    else:  # each document gets the attempts of its own entities
        keyed = source.withColumn("__key", F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))))
        held = keyed.select("__key", F.col(text).alias("t")).mapInArrow(_held, "__key binary, kind string, entity string").distinct()
        per = held.join(again, ["kind", "entity"]).groupBy("__key").agg(F.collect_list(F.struct("kind", "entity", "attempt", "gender")).alias("__again"))
        joined = keyed.join(per, "__key", "left").select(*(F.col(f"`{c}`") for c in kept), "__again")

        def own(batch):
            lists = batch.column(len(kept)).to_pylist()
            return lambda n: {(r["kind"], r["entity"]): (r["attempt"], r["gender"]) for r in lists[n] or []}

    def run(batches):
        for batch in batches:
            new, counts, kinds = _replaced(batch, batch.column(place).to_pylist(), secret, own(batch))
            columns = [batch.column(i) for i in range(len(kept))]
            columns[place] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(kinds, pa.list_(pa.string()))], names=[*kept, *new_names])



    return joined.mapInArrow(run, T.StructType([*source.schema, T.StructField("n_entities", T.LongType()), T.StructField("entity_kinds", T.ArrayType(T.StringType()))]))


def _held(batches):
    for batch in batches:
        rows = sorted({(k, kind, canonical) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for _, _, kind, canonical in entities(t or "")})
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary() if i == 0 else pa.string()) for i in range(3)], names=["__key", "kind", "entity"])
