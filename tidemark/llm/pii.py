"""Surrogates for personal data: keyed, type-consistent and injective.

Detected entities (e-mail and IPv4 addresses, telephone, card, account and
identity numbers, secret tokens, and names) are replaced by surrogates that keep
type, format, script and a name's gender. Numbers, tokens and addresses go through
a keyed permutation of all strings of their own format that leaves none in place:
a shift by one between a Feistel permutation and its inverse. So two entities never
share a surrogate, none is its own, and one entity has the same surrogate wherever it
occurs. Only numbers with a right check digit are cards, and stay so; account
numbers keep valid check digits, private addresses stay private, and a telephone
number keeps a 555.

Names are found by a title and start with a capital letter of any script. A given and a family name are replaced each by itself, so
"Dr John Smith", "Mr John Smith" and "Mrs Smith" stay the persons and the family that
they were; further mentions of a document's titled persons without a title ("John
Smith", "Smith") are replaced like the titled ones, and a name in capitals is the same name and stays in
capitals. A given name's gender is what its
titles in the whole corpus tell, and open where they disagree. Its surrogate comes from
the list of its script and gender, picked by a keyed hash. The names of the corpus are
gathered by a grouped aggregate; those that meet at one name of the list are ranked, and a
name's rank is told by further names behind a hyphen, as many as it takes. No name
found in a text has a hyphen, so only the first of a list name can clash with a name
of the corpus; its ranks then start one later.

Null texts stay null, empty ones empty. Rows repeat as they come; rows without doc_id
are treated like others. Extra columns pass through replace_entities(); a column named
like an output is replaced.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, read, small_batches, spare

KEY = b"tidemark surrogate key"
#: Names of one slot are ranked in so many parts.
PARTS = 64

_MALE, _FEMALE, _ANY = "m", "f", "x"
#: Titles and the gender that they tell.
TITLES = {
    "Mr": _MALE, "Mister": _MALE, "Sir": _MALE, "Herr": _MALE, "Monsieur": _MALE, "Señor": _MALE, "Sr": _MALE, "Don": _MALE, "господин": _MALE, "Господин": _MALE, "Κύριος": _MALE,
    "Mrs": _FEMALE, "Ms": _FEMALE, "Miss": _FEMALE, "Madam": _FEMALE, "Frau": _FEMALE, "Madame": _FEMALE, "Mme": _FEMALE, "Mlle": _FEMALE, "Señora": _FEMALE, "Sra": _FEMALE, "Doña": _FEMALE,
    "госпожа": _FEMALE, "Госпожа": _FEMALE, "Κυρία": _FEMALE, "Dr": _ANY, "Prof": _ANY, "Professor": _ANY,
}
GIVEN = {
    ("latin", _MALE): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Marco Nils Oscar Paul Robin Simon Tomas Victor".split(),
    ("latin", _FEMALE): "Alma Berta Clara Dora Elena Flora Greta Hanna Irene Julia Karla Lena Marta Nora Olga Petra Rosa Sara Tina Vera".split(),
    ("latin", _ANY): "Alex Charlie Dana Eden Jamie Kim Lou Morgan Nico Robin Sam Sasha Toni Val".split(),
    ("cyrillic", _MALE): "Андрей Борис Виктор Глеб Денис Иван Кирилл Лев Максим Олег Павел Роман Степан Фёдор".split(),
    ("cyrillic", _FEMALE): "Алла Вера Галина Дарья Елена Жанна Инна Лидия Мария Нина Ольга Полина Раиса Софья".split(),
    ("greek", _MALE): "Αλέξης Βασίλης Γιώργος Δημήτρης Κώστας Λευτέρης Μάριος Νίκος Πέτρος Στέλιος".split(),
    ("greek", _FEMALE): "Άννα Βάσω Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Νίκη Σοφία".split(),
}
FAMILY = {
    "latin": "Abel Becker Conti Duval Engel Falk Garnier Holm Iversen Jansen Keller Lorenz Moreau Novak Olsen Petit Quist Romero Salas Thorne Urban Vidal Weber Zeller".split(),
    "cyrillic": "Агапенко Бондаренко Гнатюк Довженко Короленко Левченко Мельник Науменко Осипенко Приходько Ткаченко Шевченко".split(),
    "greek": "Αγγελίδη Βαλσάμη Γεωργίου Δημητρίου Ιωάννου Κωνσταντίνου Λαμπράκη Νικολάου Παπαδάκη Χρήστου".split(),
}
#: Capital letters of the scripts that have names here, as a character class.
_CAPITAL = "[" + "".join(c for c in map(chr, [*range(0x41, 0x530), *range(0x1E00, 0x2000)]) if unicodedata.category(c) in ("Lu", "Lt")) + "]"
_NAME = rf"{_CAPITAL}(?:['’]{_CAPITAL})?[^\W\d_]+"
#: In order of precedence at the same place.
PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9][\w.+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![\w-]))"
    r"|(?P<iban>\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ip>(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9]))"
    r"|(?P<phone>(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![\w(])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9]))"
    r"|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"
    r"|(?P<card>(?<![0-9.-])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{13,19})(?![0-9-]))"
    r"|(?P<token>(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|(?:AKIA|ASIA)[0-9A-Z]{16}|(?:sk|pk|ghp|xox[bp])[-_][0-9A-Za-z]{16,64})(?![0-9A-Za-z]))"
    rf"|(?P<name>\b(?:{'|'.join(TITLES)})\.? {_NAME}(?: {_NAME})?)")
#: Cheap tests: no entity, and no name, occurs in a text without one of these.
_TITLED = rf"(?:{'|'.join(TITLES)})\.? [^a-z\d\s]"
_MAY = rf"@|\d\.?\d|AKIA|ASIA|(?:sk|pk|ghp|xox[bp])[-_]|[0-9a-f]{{32}}|[0-9A-F]{{32}}|{_TITLED}"

_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HEX = ("0123456789abcdef", "0123456789ABCDEF")


def _round(key: bytes, n: int, i: int, x: int, tweak: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"%d|%d|%x|" % (n, i, x) + tweak, key=key, digest_size=16 + n.bit_length() // 8).digest(), "big")


def _feistel(x: int, n: int, tweak: bytes, key: bytes, back: bool = False) -> int:
    """A keyed permutation of 0..n-1, or its inverse: Feistel over two halves, walked until it lands inside."""
    a = max(2, int(n**0.5)) if n < 1 << 50 else 1 << (n.bit_length() // 2)
    b = -(-n // a)
    while True:
        left, right = divmod(x, b)
        for i in reversed(range(8)) if back else range(8):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * _round(key, b, i, left, tweak)) % b
            else:
                left = (left + sign * _round(key, a, i, right, tweak)) % a
        x = left * b + right
        if x < n:
            return x


def permute(x: int, n: int, tweak: bytes, key: bytes = KEY) -> int:
    """One step on a keyed cycle through all of 0..n-1, so no number stays in place."""
    return x if n < 2 else _feistel((_feistel(x, n, tweak, key) + 1) % n, n, tweak, key, back=True)


def _permute_string(s: str, tweak: bytes, alphabets: list[str | None], key: bytes) -> str:
    """Permute the characters that have an alphabet, all together."""
    x, n = 0, 1
    for c, al in zip(s, alphabets, strict=True):
        if al:
            x, n = x * len(al) + al.index(c), n * len(al)
    y, out = permute(x, n, tweak, key), []
    for c, al in zip(reversed(s), reversed(alphabets), strict=True):
        if al:
            y, d = divmod(y, len(al))
            c = al[d]
        out.append(c)
    return "".join(reversed(out))


def _by_class(s: str) -> list[str | None]:
    return [next((a for a in _CLASSES if c in a), None) for c in s]


def _luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _email(s: str, key: bytes) -> str:
    local, _, domain = s.lower().partition("@")
    labels = domain.rsplit(".", 2 if domain.endswith((".example.com", ".example.org", ".example.net")) else 1)
    host = _permute_string(labels[0], b"host", _by_class(labels[0]), key)
    return f"{_permute_string(local, b'local', _by_class(local), key)}@{'.'.join([host, *labels[1:]])}"


def _range(o: list[int]) -> int:
    """How many octets of an address tell its use: 0 for public ones, -1 for those that no host has."""
    if o[0] in (10, 127):
        return 1
    if (o[0], o[1]) in ((192, 168), (169, 254)) or o[0] == 172 and 16 <= o[1] < 32:
        return 2
    return -1 if o[0] == 0 or o[0] >= 224 else 0


def _ip(s: str, key: bytes) -> str:
    o = [int(x) for x in s.split(".")]
    kind = _range(o)
    keep = max(kind, 0)
    x = int.from_bytes(bytes(o[keep:]), "big")
    while True:
        x = permute(x, 256 ** (4 - keep), b"ip%d" % keep + bytes(o[:keep]), key)
        new = [*o[:keep], *x.to_bytes(4 - keep, "big")]
        if _range(new) == kind:
            return ".".join(map(str, new))


def _card(s: str, key: bytes) -> str:
    digits = re.sub(r"\D", "", s)
    off = (int(digits[-1]) - _luhn(digits[:-1])) % 10
    body = digits[0] + _permute_string(digits[1:-1], b"card" + digits[0].encode(), ["0123456789"] * (len(digits) - 2), key)
    new = iter(body + str((_luhn(body) + off) % 10))
    return re.sub(r"\d", lambda _: next(new), s)


def _phone(s: str, key: bytes) -> str:
    """Numbers keep the place of their first 555, and those without get none, so the two never meet."""
    head = re.match(r"\+\d{1,3}", s)
    keep = head.end() if head else 0
    cut = s[keep:]
    fixed = cut.find("555")
    al = ["0123456789" if c.isdigit() and not (fixed >= 0 and fixed <= i < fixed + 3) else None for i, c in enumerate(cut)]
    new = cut
    while True:
        new = _permute_string(new, b"phone%d" % fixed + s[:keep].encode(), al, key)
        if new.find("555") == fixed:
            return s[:keep] + new


def _iban(s: str, key: bytes) -> str:
    flat = s.replace(" ", "")
    value = lambda t: int("".join(str(int(c, 36)) for c in t)) % 97
    valid = value(flat[4:] + flat[:4]) == 1
    body = _permute_string(flat[4:], b"iban" + flat[:2].encode(), _by_class(flat[4:]), key)
    check = f"{98 - value(body + flat[:2] + '00'):02d}" if valid else _permute_string(flat[2:4], b"check" + body.encode(), ["0123456789"] * 2, key)
    new = iter(flat[:2] + check + body)
    return re.sub(r"\S", lambda _: next(new), s)


def _token(s: str, key: bytes) -> str:
    hexed = next((a for a in _HEX if all(c in a for c in s)), None)
    if hexed and not s.isdigit():
        while True:
            s = _permute_string(s, b"hex", [hexed] * len(s), key)
            if not s.isdigit():
                return s
    head = re.match(r"(?:AKIA|ASIA|(?:sk|pk|ghp|xox[bp])[-_])?", s).end()
    return s[:head] + _permute_string(s[head:], b"token" + s[:head].encode(), _by_class(s[head:]), key)


def _ssn(s: str, key: bytes) -> str:
    return _permute_string(s, b"ssn", _by_class(s), key)


_MAKE = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "iban": _iban, "token": _token, "ssn": _ssn}


def _script(name: str) -> str:
    return "cyrillic" if re.match(r"[Ѐ-ӿ]", name) else "greek" if re.match(r"[Ͱ-Ͽἀ-῿]", name) else "latin"


def name_surrogate(kind: str, gender: str, word: str, lap: int, key: bytes = KEY) -> str:
    """A given ("g") or family ("f") name of the same script and gender; a later lap is told by a tail of its digits."""
    script = _script(word)
    both = GIVEN[(script, _MALE)] + GIVEN[(script, _FEMALE)]
    own, tails = (FAMILY[script],) * 2 if kind == "f" else (GIVEN.get((script, gender)) or both, both)
    tail = ""
    x = int.from_bytes(hashlib.blake2b(f"{kind}{gender if kind == 'g' else ''} {word}".encode(), key=key, digest_size=8).digest(), "big")
    while lap:
        lap, digit = divmod(lap, len(tails))
        tail = f"-{tails[digit]}{tail}"
    return own[x % len(own)] + tail


def surrogate(kind: str, s: str, names: dict[str, str], key: bytes = KEY) -> str:
    """The surrogate of one entity; names maps "g word" and "f word" to theirs."""
    if kind != "name":
        return _MAKE[kind](s, key)
    title, *words = s.split(" ")
    return " ".join([title, *(_called(k, w, names) for k, w in zip("gf"[-len(words):], words, strict=True))])


def _plain(word: str) -> str:
    """A name as it is listed: one that is all capitals is the same name in mixed case."""
    return word.title() if len(word) > 1 and word.isupper() else word


def _called(kind: str, word: str, names: dict[str, str]) -> str:
    """A name's surrogate, in capitals where the name is."""
    made = names[f"{kind} {_plain(word)}"]
    return made.upper() if _plain(word) != word else made


def find(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, type) of the entities of a text that need no other mention, in order."""
    out = []
    for m in PATTERN.finditer(text or ""):
        digits = re.sub(r"\D", "", m[0]) if m.lastgroup == "card" else ""
        if not digits or int(digits[-1]) == _luhn(digits[:-1]):
            out.append((m.start(), m.end(), m.lastgroup))
    return out


def names_in(text: str) -> set[str]:
    """The titled names of a text: "g word gender" and "f word x"."""
    out = set()
    for a, b, kind in find(text):
        if kind == "name":
            title, *words = text[a:b].split(" ")
            out.add(f"f {_plain(words[-1])} {_ANY}")
            if len(words) > 1:
                out.add(f"g {_plain(words[0])} {TITLES[title.rstrip('.')]}")
    return out


def replace(text: str, names: dict[str, str], key: bytes = KEY) -> tuple[str, int, list[str]]:
    """A text with all its entities replaced, their number and their types."""
    untitled = None
    if names:
        given, family = ("|".join(sorted(re.escape(v) for n in names if n[0] == k for v in {n[2:], n[2:].upper()})) for k in "gf")
        untitled = re.compile(rf"(?<!\w)(?:({given or '(?!)'}) )?({family})(?!\w)")
    parts, kinds, n, at = [], set(), 0, 0

    def gap(a: int, b: int) -> None:
        nonlocal n
        for m in untitled.finditer(text, a, b) if untitled else ():
            parts.extend((text[a : m.start()], f"{_called('g', m[1], names)} " if m[1] else "", _called("f", m[2], names)))
            kinds.add("name")
            n, a = n + 1, m.end()
        parts.append(text[a:b])

    for a, b, kind in find(text):
        gap(at, a)
        parts.append(surrogate(kind, text[a:b], names, key))
        kinds.add(kind)
        n, at = n + 1, b
    gap(at, len(text))
    return "".join(parts), n, sorted(kinds)


def _resolve(names: DataFrame, scratch: Scratch, key: bytes) -> DataFrame:
    """(kind, word, made): the surrogates of distinct names (kind, word, gender), different from each other and from all names.

    The names of a slot are ranked in parts, behind the counts of the parts before: slots
    are few, so one of them can hold a large share of all names.
    """
    def make(kind: pa.Array, word: pa.Array, gender: pa.Array, lap: pa.Array) -> pa.Array:
        return pa.array([name_surrogate(*x, key) for x in zip(kind.to_pylist(), gender.to_pylist(), word.to_pylist(), lap.to_pylist(), strict=True)], pa.string())

    of = F.arrow_udf(make, "string")
    slots = scratch.save(names.select("*", of("kind", "word", "gender", F.lit(0)).alias("slot"), F.pmod(F.xxhash64("word"), F.lit(PARTS)).alias("part")), "slots")
    real = names.select("kind", F.col("word").alias("slot"), F.lit(1).alias("real"))
    up = Window.partitionBy("kind", "slot").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        slots.groupBy("kind", "slot", "part").agg(F.count("*").alias("n")).join(real, ["kind", "slot"], "left")
        .select("kind", "slot", "part", (F.coalesce(F.sum("n").over(up), F.lit(0)) + F.coalesce("real", F.lit(0))).alias("before")))
    rank = F.row_number().over(Window.partitionBy("kind", "slot", "part").orderBy("word"))
    ranked = slots.join(before, ["kind", "slot", "part"]).withColumn("lap", F.col("before") + rank - 1)
    return scratch.save(ranked.select("kind", "word", of("kind", "word", "gender", "lap").alias("made")), "names")


def replace_entities(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """docs with text replaced, and n_entities and types (distinct, sorted)."""
    spark = docs.sparkSession
    small_batches(spark, "500")
    scratch = Scratch(spark, "pii")

    def list_names(text: pa.Array) -> pa.Array:
        may = pc.match_substring_regex(text, _TITLED).to_pylist()
        return pa.array([sorted(names_in(t)) if ok else [] for t, ok in zip(text.to_pylist(), may, strict=True)], pa.list_(pa.string()))

    row = F.struct(F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(7)).alias("b"), F.length("text").alias("n"))
    named = docs.select(row.alias("row"), F.explode(F.arrow_udf(list_names, "array<string>")("text")).alias("name")).withColumn("name", F.split("name", " "))
    named = scratch.save(named.select("row", F.col("name")[0].alias("kind"), F.col("name")[1].alias("word"), F.col("name")[2].alias("gender")).distinct(), "mentions")
    told = lambda g: F.max(F.col("gender") == g)
    gender = F.when(told(_MALE) & ~told(_FEMALE), _MALE).when(told(_FEMALE) & ~told(_MALE), _FEMALE).otherwise(_ANY)
    made = _resolve(named.groupBy("kind", "word").agg(gender.alias("gender")), scratch, key)
    # one short row for each text with a name; Spark broadcasts it only if it is small
    pair = F.struct(F.concat_ws(" ", "kind", "word").alias("k"), F.col("made").alias("v"))
    by_row = scratch.save(named.select("row", "kind", "word").distinct().join(made, ["kind", "word"]).groupBy("row").agg(F.map_from_entries(F.collect_set(pair)).alias("_names")), "by_row")

    def replace_all(text: pa.Array, names: pa.Array) -> pa.Array:
        texts, counts, kinds = [], [], []
        may = pc.match_substring_regex(text, _MAY).to_pylist()
        for t, ok, m in zip(text.to_pylist(), may, names.to_pylist(), strict=True):
            t, n, k = replace(t, dict(m or ()), key) if ok else (t, 0, [])
            texts.append(t)
            counts.append(n)
            kinds.append(k)
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(kinds, pa.list_(pa.string()))], names=["text", "n", "types"])

    key_col, map_col, got = spare(docs, "row", "names", "replaced")
    done = docs.withColumn(key_col, row).join(by_row.toDF(key_col, map_col), key_col, "left")
    done = done.withColumn(got, F.arrow_udf(replace_all, "struct<text:string,n:int,types:array<string>>")("text", map_col))
    return done.withColumns({"text": F.col(f"{got}.text"), "n_entities": F.col(f"{got}.n"), "types": F.col(f"{got}.types")}).drop(key_col, map_col, got)


def op2_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    return replace_entities(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_entities", "types")
