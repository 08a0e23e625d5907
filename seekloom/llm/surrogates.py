"""Personal data replaced by keyed surrogates of the same type, format, gender and script."""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekloom.llm.copies import text_key
from seekloom.plans.scratch import written
from seekloom.plans.sizing import hinted, keys_fit

KEY = b"seekloom surrogates"
GROWTH = 4  # draws after which a surrogate gets longer, as its format may be full

# Titles that tell a person's gender, and given names to choose from.
TITLES = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "господин"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа"],
    "n": ["Dr", "Prof"],
}
GIVEN = {
    ("latin", "m"): ["Adam", "Bruno", "Carl", "David", "Erik", "Felix", "Hugo", "Ivan", "Jonas", "Leo"],
    ("latin", "f"): ["Anna", "Bella", "Clara", "Diana", "Elena", "Flora", "Greta", "Ines", "Julia", "Laura"],
    ("latin", "n"): ["Alex", "Chris", "Dana", "Jamie", "Kim", "Luca", "Maxi", "Robin", "Sam", "Toni"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Денис", "Игорь", "Максим", "Олег", "Павел"],
    ("cyrillic", "f"): ["Алина", "Вера", "Дарья", "Ирина", "Мария", "Нина", "Ольга", "Юлия"],
    ("cyrillic", "n"): ["Саша", "Женя", "Валя", "Слава"],
}
SYLLABLES = {
    "latin": ["ba", "den", "fo", "gar", "hol", "kin", "lan", "mer", "nor", "pel", "ros", "sten", "tam", "vik", "wes", "zan"],
    "cyrillic": ["ба", "вин", "го", "дар", "зин", "кол", "лен", "мар", "ни", "пет", "рос", "сем", "тан", "хол", "чер", "юр"],
}

_TITLE = "|".join(re.escape(title) for titles in TITLES.values() for title in titles)
_NAME = r"[^\W\d_a-zà-öø-ÿа-яё](?:['’][^\W\d_])?[^\W\d_]+(?:[-'’][^\W\d_]+)*"
_NAME_WORD = re.compile(rf"(?<![\w'’-]){_NAME}(?![\w])")
PATTERNS: list[tuple[str, re.Pattern]] = [
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")),
    ("secret", re.compile(r"\bAKIA[0-9A-Z]{16}\b")),
    ("secret", re.compile(r"(?i)(?<![a-z0-9])(?:password|passwd|pwd|token|secret|api[_-]?key)\s*[=:]\s*[\"']?(?P<own>[A-Za-z0-9_+/=-]{8,})")),
    ("secret", re.compile(r"(?<![0-9A-Za-z])(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{32,}(?![0-9A-Za-z])")),
    ("iban", re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("ip", re.compile(r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])")),
    ("card", re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("phone", re.compile(r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?)[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])|(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")),
    ("person", re.compile(rf"\b(?:{_TITLE})\.? +(?P<own>{_NAME}(?: {_NAME}){{0,3}})")),
]


def _luhn_digit(digits: str) -> str:
    """The digit that makes a number valid when it is put behind ``digits``."""
    total = 0
    for at, digit in enumerate(reversed(digits)):
        value = int(digit) * (2 if at % 2 == 0 else 1)
        total += value - 9 if value > 9 else value
    return str(-total % 10)


def _iban_check(country: str, rest: str) -> str:
    """The two check digits of an account number."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def _script(name: str) -> str:
    return "cyrillic" if re.search("[Ѐ-ӿ]", name) else "latin"


def find_entities(text: str) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, norm)`` of the entities of a text, in order, without overlaps.

    ``norm`` is what makes two mentions one entity: digits for numbers, lower case for
    mail addresses and names. A person's kind carries the gender that the title tells; where
    a text gives the same name with a title of a gender and without one, it is that gender.
    The names of persons with a title are found without it, too.
    """
    found: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text))
    digits, at_sign = re.search("[0-9]", text) is not None, "@" in text
    for kind, pattern in PATTERNS:
        if (kind == "email" and not at_sign) or (kind in ("ip", "card", "ssn", "phone", "iban") and not digits):
            continue
        for match in pattern.finditer(text):
            start, end = match.span("own" if "own" in pattern.groupindex else 0)
            if 1 in taken[start:end]:
                continue
            own, label = text[start:end], kind
            if kind in ("card", "ssn", "phone"):
                norm = re.sub("[^0-9]", "", own)
            elif kind == "iban":
                norm = own.replace(" ", "")
                if norm[2:4] != _iban_check(norm[:2], norm[4:]):
                    continue
            elif kind == "person":
                title = match[0][: start - match.start()].strip(" .")
                gender = next(g for g, titles in TITLES.items() if title in titles)
                label, norm = f"person-{gender}", own.lower()
            else:
                norm = own.lower() if kind in ("email", "ip") else own
            taken[start:end] = b"\x01" * (end - start)
            found.append((start, end, label, norm))
    persons = [(norm.split(" "), kind[-1]) for _, _, kind, norm in found if kind.startswith("person")]
    if persons:
        genders = {word: gender for words, gender in persons if gender != "n" for word in words[:-1]}
        lasts = {gender: {words[-1] for words, own in persons if own == gender} for gender in "mfn"}
        for start, end in _known_names(text, persons):
            if 1 not in taken[start:end]:
                words = text[start:end].lower().split(" ")
                gender = next((g for g in "mfn" if words[-1] in lasts[g]), "n")
                found.append((start, end, f"person-{gender}", " ".join(words)))
        found = [
            (start, end, f"person-{_gender(kind, norm, genders)}" if kind == "person-n" else kind, norm)
            for start, end, kind, norm in found
        ]
    return sorted(found)


def _known_names(text: str, persons: list[tuple[list[str], str]]) -> Iterator[tuple[int, int]]:
    """Where last names of these persons stand, with the first names before them."""
    firsts = {word for words, _ in persons for word in words[:-1]}
    lasts = {words[-1] for words, _ in persons}
    begin, before = 0, -2
    for match in _NAME_WORD.finditer(text):
        word = match[0].lower()
        if match.start() != before + 1 or text[before] != " ":
            begin = match.start()
        if word in lasts:
            yield begin, match.end()
        before = match.end() if word in firsts else -2


def _gender(kind: str, norm: str, genders: dict[str, str]) -> str:
    return next((genders[word] for word in norm.split(" ")[:-1] if word in genders), kind[-1])


def name_parts(kind: str, norm: str) -> list[tuple[str, str]]:
    """The entities of a mention: a person's first names, by gender, and last name; else itself."""
    if not kind.startswith("person"):
        return [(kind, norm)]
    *firsts, last = norm.split(" ")
    return [(f"given-{kind[-1]}", first) for first in firsts] + [("surname", last)]


class _Stream:
    """Numbers that depend on the key, the entity and the attempt alone."""

    def __init__(self, key: bytes, *parts: str) -> None:
        self._key, self._seed, self._block, self._held = key, "\x00".join(parts).encode("utf-8", "surrogatepass"), 0, b""

    def below(self, limit: int) -> int:
        if len(self._held) < 4:
            self._held += hmac.new(self._key, self._seed + self._block.to_bytes(4, "big"), hashlib.sha256).digest()
            self._block += 1
        value, self._held = self._held[:4], self._held[4:]
        return int.from_bytes(value, "big") % limit


def _same_classes(text: str, draw: Callable[[int], int], hexadecimal: bool = False) -> str:
    """Letters for letters of the same case, digits for digits; the first digit not 0."""
    out, first = [], True
    for char in text:
        if hexadecimal and char in "0123456789abcdef":
            out.append("0123456789abcdef"[draw(16)])
        elif "0" <= char <= "9":
            out.append(str(1 + draw(9)) if first else str(draw(10)))
            first = False
        elif "a" <= char <= "z":
            out.append(chr(97 + draw(26)))
        elif "A" <= char <= "Z":
            out.append(chr(65 + draw(26)))
        else:
            out.append(char)
    return "".join(out)


def surrogate_norm(kind: str, norm: str, attempt: int = 0, key: bytes = KEY) -> str:
    """The surrogate of an entity in normal form: same type, length, checks and script."""
    draw = _Stream(key, kind, norm, str(attempt)).below
    more = attempt // GROWTH
    if kind == "email":
        local, _, domain = norm.partition("@")
        host, _, top = domain.rpartition(".")
        own = _Stream(key, "domain", domain).below  # mail addresses of one domain keep one domain
        longer = "".join(chr(97 + draw(26)) for _ in range(more))
        return f"{_same_classes(local, draw)}{longer}@{_same_classes(host, own)}.{top}"
    if kind == "ip":
        # Four bytes in the longer notation once those of the shorter one are taken.
        mapped = "".join(f"{draw(65536):x}:" for _ in range(min(more, 4)))
        short = ".".join(str(1 + draw(223 if at == 0 else 254)) for at in range(4))
        return f"{mapped}:ffff:{short}" if more else short
    if kind == "card":
        body = norm[0] + "".join(str(draw(10)) for _ in range(len(norm) - 2 + more))
        check = _luhn_digit(body)
        valid = _luhn_digit(norm[:-1]) == norm[-1]
        return body + (check if valid else str((int(check) + 1 + draw(9)) % 10))
    if kind == "iban":
        rest = _same_classes(norm[4:] + "0" * more, draw)
        return norm[:2] + _iban_check(norm[:2], rest) + rest
    if kind == "secret":
        if norm.startswith("AKIA"):
            signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
            return "AKIA" + "".join(signs[draw(32)] for _ in range(len(norm) - 4 + more))
        return _same_classes(norm + "0" * more, draw, all(c in "0123456789abcdef" for c in norm))
    if kind == "surname" or kind.startswith("given"):
        script = _script(norm)
        syllables = "".join(SYLLABLES[script][draw(16)] for _ in range(more + 2 * (kind == "surname")))
        pool = GIVEN[script, kind[-1]] if kind != "surname" else [""]
        return (pool[draw(len(pool))] + syllables).lower()
    return _same_classes(norm + "0" * more, draw)


def dressed(kind: str, original: str, norm: str, surrogate: str) -> str:
    """A surrogate written the way the mention was: separators, case, spaces."""
    if kind in ("card", "ssn", "phone"):
        digits = iter(surrogate)
        shown = "".join(next(digits) if "0" <= char <= "9" else char for char in original)
        return shown + "".join(digits)  # of a longer surrogate
    if kind == "iban":
        letters = iter(surrogate)
        return "".join(char if char == " " else next(letters) for char in original) + "".join(letters)
    if kind.startswith("person"):
        return surrogate.upper() if original.isupper() else surrogate.title()
    if kind == "email":
        return surrogate.upper() if original.isupper() else surrogate
    return surrogate


def entity_table(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, kind, norm)`` of the distinct entities of each document."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_key", "kind", "norm"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for doc_id, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = {part for _, _, kind, norm in find_entities(text) for part in name_parts(kind, norm)}
                rows += [(doc_id, key, kind, norm) for kind, norm in sorted(own)]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.record_batch(
                [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)], names=names
            )

    own = docs.filter(F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text"
    )
    return written(own.mapInArrow(find, "doc_id long, text_key long, kind string, norm string"), "entities")


def later_attempts(entities: DataFrame, key: bytes = KEY) -> DataFrame:
    """``(kind, norm, attempt)`` of the entities whose first surrogate was not free.

    A surrogate is taken if another entity drew it earlier, if a smaller one draws it at the
    same time, or if it is an entity of the corpus itself; all parts of names are checked
    together. Those that find theirs taken draw again, and only those, until none does, so that
    distinct entities stay distinct and no surrogate names another entity. Surrogates get
    longer with every ``GROWTH`` draws, so there is always one left.
    """
    name = F.col("kind").startswith("given") | (F.col("kind") == "surname")
    pool = F.when(name, F.lit("name")).otherwise(F.col("kind"))
    waiting = written(entities.select("kind", "norm").distinct().withColumn("attempt", F.lit(0)), "waiting")
    taken = waiting.select(pool.alias("pool"), F.col("norm").alias("surrogate")).distinct()

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            drawn = pa.array([surrogate_norm(*row, key) for row in rows], pa.string())
            yield pa.record_batch([*batch.columns, drawn], names=["kind", "norm", "attempt", "surrogate"])

    later = waiting.filter("attempt > 0")
    while not waiting.isEmpty():
        drawn = waiting.mapInArrow(draw, "kind string, norm string, attempt int, surrogate string")
        drawn = written(drawn.withColumn("pool", pool), "drawn")
        who = F.concat_ws("/", "kind", "norm")
        holder = drawn.groupBy("pool", "surrogate").agg(F.min(who).alias("holder"))
        free = drawn.join(taken, ["pool", "surrogate"], "left_anti").join(holder, ["pool", "surrogate"])
        won = written(free.filter(who == F.col("holder")).drop("holder"), "won")
        later = later.unionByName(won.filter("attempt > 0").select("kind", "norm", "attempt"))
        taken = taken.unionByName(won.select("pool", "surrogate"))
        lost = drawn.join(won.select("kind", "norm"), ["kind", "norm"], "left_anti")
        waiting = written(lost.select("kind", "norm", (F.col("attempt") + 1).alias("attempt")), "waiting")
    return later


def replaced(text: str, attempts: dict[tuple[str, str], int], key: bytes = KEY) -> tuple[str, int]:
    """A text with its entities replaced, and how many there were."""
    parts, last, entities = [], 0, find_entities(text)
    for start, end, kind, norm in entities:
        own = [surrogate_norm(*part, attempts.get(part, 0), key) for part in name_parts(kind, norm)]
        surrogate = " ".join(own)
        parts += [text[last:start], dressed(kind, text[start:end], norm, surrogate)]
        last = end
    return "".join([*parts, text[last:]]), len(entities)


def replace_personal_data(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """``(doc_id, text, n_entities)`` with each entity replaced by its surrogate.

    An entity has one surrogate in all documents and formats; two entities have two. The
    surrogate is drawn from a keyed hash of the entity, so documents are rewritten one by
    one; only entities whose first draw collided travel, to the documents that have them.

    Null text stays null and texts without entities stay as they are; repeated rows get
    equal results; extra columns are ignored; an empty table gives no rows.
    """
    entities = entity_table(docs)
    later = written(later_attempts(entities, key), "later")
    of_doc = entities.join(hinted(later, keys_fit(later, "kind", "norm")), ["kind", "norm"])
    entry = F.struct("kind", "norm", "attempt")
    of_doc = of_doc.groupBy(F.col("doc_id").alias("_doc_id"), F.col("text_key").alias("_key")).agg(
        F.sort_array(F.collect_set(entry)).alias("attempts")
    )
    of_doc = written(of_doc, "later_of_doc")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("text_key"))
    small = of_doc.count() <= 100_000 and keys_fit(of_doc, "attempts")
    on = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_key") == F.col("_key"))
    joined = own.join(hinted(of_doc, small), on, "left").select("doc_id", "text", "attempts")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text, attempts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                known = {(a["kind"], a["norm"]): a["attempt"] for a in attempts or []}
                new, count = replaced(text, known, key) if text is not None else (None, 0)
                texts.append(new)
                counts.append(count)
            arrays = [batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64())]
            yield pa.record_batch(arrays, names=["doc_id", "text", "n_entities"])

    return joined.mapInArrow(rewrite, "doc_id long, text string, n_entities long")
