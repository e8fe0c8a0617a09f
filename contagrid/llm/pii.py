"""Surrogates for personal data: keyed, of the same type, script and format, distinct for distinct entities.

A surrogate is a keyed permutation of the entity's letters and digits within
their classes (digits to digits, lower-case Latin to lower-case Latin and so on),
so within a format different entities cannot meet, and an entity has the same
surrogate in every text. Given names come from lists by gender and script and
can meet; all surrogates are therefore checked against each other and against
the entities of the corpus, and those that meet one are drawn again.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from contagrid.llm.common import hot_split_join, text_of, written

#: Titles in front of a name, by gender.
TITLES = {
    "m": "Mr Mister Herr Herrn Monsieur Señor Don Sr г-н господин Господин",
    "f": "Mrs Ms Miss Frau Madame Mme Señora Doña Sra г-жа госпожа Госпожа",
    "x": "Dr Prof Doctor Professor доктор профессор",
}
#: Given names by script and gender.
GIVEN = {
    ("latin", "m"): "James Robert David Daniel Thomas Martin Lucas Paul Simon Victor Oscar Felix Hugo Adrian Leon Marco",
    ("latin", "f"): "Mary Linda Susan Laura Anna Julia Clara Emma Sofia Elena Alice Nina Marta Irene Lucia Paula",
    ("latin", "x"): "Alex Robin Kim Sascha Andrea Jamie Morgan Taylor",
    ("cyrillic", "m"): "Иван Пётр Павел Олег Игорь Антон Роман Максим",
    ("cyrillic", "f"): "Анна Мария Ольга Елена Ирина Нина Вера Юлия",
    ("cyrillic", "x"): "Саша Женя Валя Слава",
}
#: Letters that are replaced among themselves.
CLASSES = (
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюяё", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
)
_PLACE = {ch: (k, i) for k, letters in enumerate(CLASSES) for i, ch in enumerate(letters)}
#: Lower-case words that stand in front of or between the capitalised words of a name.
PARTICLES = frozenset(
    "af al av bin bint ben ibn da das de degli dei del della den der des di do dos du e el het ten ter la las le les lo los op te und van vom von y zu zum zur".split()
)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLE = {t: g for g, ts in TITLES.items() for t in ts.split()}
#: In order: where detections overlap, the earlier kind wins.
PATTERNS = (
    ("email", r"[\w.+%-]{1,64}@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}"),
    ("secret", r"(?i:(?P<word>api[_-]?key|token|secret|password|passwd)\s*[=:]\s*[\"']?)(?P<secret>[A-Za-z0-9_-]{8,})|(?P<aws>AKIA[0-9A-Z]{16})"),
    ("ipv4", rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)"),
    ("ipv6", r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("card", r"(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w)"),
    ("phone", r"(?<![\w.])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){5,11}(?!\w)|(?<![\w.])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)"
     r"|(?<![\w.-])00[1-9]\d{0,2}[ .-]\d(?:[ .-]?\d){5,11}(?!\w)|(?<![\w.-])\d{3}([.-])\d{3}\1\d{4}(?![\w-])"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("name", rf"\b(?P<title>{'|'.join(sorted(_TITLE, key=len, reverse=True))})\b\.? "),
)
_MORE_TITLES = re.compile(PATTERNS[-1][1])
#: A word of a name; accents may be characters of their own.
_NAME_WORD = re.compile(r"[^\W\d_][\w'’\u0300-\u036f-]*")
ENTITY = "kind string, canon string, gender string"
#: A password may be words; another secret without a digit must be quoted or longer than words are.
_WORDLIKE_SECRETS = ("password", "passwd")
_LONG_SECRET = 20
TASK_ENTITIES = 2000
MOST_ATTEMPTS = 16


def luhn(digits: str) -> int:
    """0 for a valid number."""
    odd = [int(d) for d in digits[::-1]]
    return (sum(odd[::2]) + sum(d * 2 - 9 * (d > 4) for d in odd[1::2])) % 10


def _iban_check(canon: str) -> int:
    return int("".join(str(int(c, 36)) for c in canon[4:] + canon[:4])) % 97


def _shuffled(values: list[int], sizes: list[int], key: bytes, frame: str) -> list[int]:
    """A keyed permutation of all lists of numbers below ``sizes``: rounds that add a hash of one half to the other."""
    half = (len(values) + 1) // 2
    spans = ((0, half), (half, len(values)))
    number, size = [0, 0], [1, 1]
    for h, (a, b) in enumerate(spans):
        for v, n in zip(values[a:b], sizes[a:b]):
            number[h], size[h] = number[h] * n + v, size[h] * n
    for r in range(10):
        into, other = r % 2, number[1 - r % 2]
        seed = hashlib.blake2b(f"{frame}\0{r}\0{other}".encode("utf-8", "replace"), key=key[:64], digest_size=64).digest()
        draw = int.from_bytes(hashlib.shake_256(seed).digest(size[into].bit_length() // 8 + 9), "big")
        number[into] = (number[into] + draw) % size[into]
    out = []
    for h, (a, b) in enumerate(spans):
        part = []
        for n in reversed(sizes[a:b]):
            number[h], v = divmod(number[h], n)
            part.append(v)
        out += reversed(part)
    return out


def _script(ch: str) -> str:
    """Script and case of a letter; Latin letters of no alphabet (phonetic ones) are a script of their own."""
    rare = "" if ord(ch) < 0x250 or 0x1E00 <= ord(ch) < 0x1F00 else " rare"
    script = unicodedata.name(ch, "?").split(" ")[0].split("-")[0]
    return f"{script}{rare * (script == 'LATIN')} {unicodedata.category(ch)}"


@cache
def _others() -> dict[str, list[str]]:
    """The letters outside ``CLASSES`` by script and case."""
    found: dict[str, list[str]] = {}
    for ch in map(chr, range(0xAA, sys.maxunicode + 1)):
        if ch.isalpha() and ch not in _PLACE:
            found.setdefault(_script(ch), []).append(ch)
    return found


@cache
def _other_places() -> dict[str, tuple[str, int]]:
    return {ch: (k, i) for k, letters in _others().items() for i, ch in enumerate(letters)}


def _place(ch: str) -> tuple[int | str, int] | None:
    """Class of a letter or digit and its place there."""
    return _PLACE.get(ch) or (_other_places().get(ch) if ch >= "\x80" and ch.isalpha() else None)


def permuted(text: str, key: bytes, tweak: str, fixed: frozenset[int] = frozenset()) -> str:
    """A keyed permutation of all texts with the same classes and fixed characters."""
    places = [(i, *at) for i, ch in enumerate(text) if i not in fixed and (at := _place(ch))]
    if not places:
        return text
    form = list(text)
    for i, k, _ in places:
        form[i] = f"\0{k}"
    letters = [CLASSES[k] if isinstance(k, int) else _others()[k] for _, k, _ in places]
    out = list(text)
    for (i, _, _), own, v in zip(places, letters, _shuffled([v for *_, v in places], [*map(len, letters)], key, f"{tweak}\0{''.join(form)}")):
        out[i] = own[v]
    return "".join(out)


def _walk(text: str, step, like) -> str:
    """The permutation ``step`` again until the result is of the same sort as the text; so it permutes each sort.

    For sorts that most texts belong to.
    """
    sort, out = like(text), text
    while True:
        out = step(out)
        if like(out) == sort:
            return out


#: First and last number of an octet with so many digits.
_OCTETS = {1: (0, 9), 2: (10, 99), 3: (100, 255)}


def _kept_octets(canon: str) -> int:
    """Octets that make an address private, local or reserved; they stay."""
    a, b = (int(x) for x in canon.split(".")[:2])
    return 1 if a in (0, 10, 127) or a >= 224 else 2 if (a, b) in ((192, 168), (169, 254)) or a == 172 and 16 <= b < 32 else 0


def _permuted_ip(canon: str, key: bytes, tweak: str, kept: int) -> str:
    parts = canon.split(".")
    spans = [_OCTETS[len(p)] for p in parts[kept:]]
    values = [int(p) - low for p, (low, _) in zip(parts[kept:], spans)]
    frame = f"{tweak}\0{parts[:kept]}{[len(p) for p in parts]}"
    new = _shuffled(values, [high - low + 1 for low, high in spans], key, frame)
    return ".".join(parts[:kept] + [str(v + low) for v, (low, _) in zip(new, spans)])


def _permuted_hex(canon: str, key: bytes, tweak: str) -> str:
    """A keyed permutation of addresses with the same places of digits, letters and colons; special first groups stay."""
    first, _, _ = canon.partition(":")
    fixed = len(first) if first[:2] in ("fe", "fc", "fd", "ff") else 0
    places = [i for i, ch in enumerate(canon) if i >= fixed and ch != ":"]
    classes = ["0123456789" if canon[i].isdigit() else "abcdef" for i in places]
    form = "".join(":" if ch == ":" else "d" if ch.isdigit() else "a" for ch in canon)
    out = list(canon)
    for i, own, v in zip(places, classes, _shuffled([own.index(canon[i]) for i, own in zip(places, classes)], [*map(len, classes)], key, f"{tweak}\0{canon[:fixed]}{form}")):
        out[i] = own[v]
    return "".join(out)


def surrogate(kind: str, canon: str, key: bytes, attempt: int = 0, gender: str = "") -> str:
    """What stands for an entity; further attempts give further ones. ``gender`` (of a name) chooses its given name's list.

    Where a format is so small that its values are used up, a token without the format ends the search.
    """
    tweak = f"{kind}:{attempt}"
    if attempt > MOST_ATTEMPTS:
        return f"{kind}-{hashlib.blake2b(canon.encode('utf-8', 'replace'), key=key[:64], digest_size=16).hexdigest()}"
    if kind == "email":
        local, domain = canon.rsplit("@", 1)
        host, top = domain.rsplit(".", 1)
        return f"{permuted(local, key, tweak)}@{permuted(host, key, 'domain')}.{top}"
    if kind == "ipv4":
        # One permutation for the whole walk: that of the original's kept octets.
        kept = _kept_octets(canon)
        return _walk(canon, lambda x: _permuted_ip(x, key, tweak, kept), _kept_octets)
    if kind == "card":
        out = permuted(canon, key, tweak, frozenset({0, len(canon) - 1}))[:-1]
        return next(out + d for d in "0123456789" if luhn(out + d) == 0)
    if kind == "iban":
        out = permuted(canon, key, tweak, frozenset(range(4)))
        return f"{out[:2]}{98 - _iban_check(out[:2] + '00' + out[4:]):02d}{out[4:]}"
    if kind == "phone":
        country = 2 if canon.startswith("+1") else 3 if canon.startswith("+") else 4 if canon.startswith("00") else 0
        # Numbers don't begin with 0 or 1 where the original doesn't.
        return _walk(canon, lambda x: permuted(x, key, tweak, frozenset(range(country))), lambda x: x[country] in "01")
    if kind == "secret":
        return permuted(canon, key, tweak, frozenset(range(4)) if canon.startswith("AKIA") else frozenset())
    if kind == "ipv6":
        return _permuted_hex(canon, key, tweak)
    if kind == "name":
        words = canon.split(" ")
        script = "cyrillic" if "а" <= words[0][0].lower() <= "ё" else "latin" if words[0][0].lower() < "ʰ" else ""
        out = [w if w in PARTICLES else permuted(w, key, "surname") for w in words]
        # A particle in front, or one word besides particles: no given name.
        two = words[0] not in PARTICLES and sum(w not in PARTICLES for w in words) > 1
        if two and (attempt or not script):
            # Drawn again, a given name is a permutation, so such names meet no more; the surname stays.
            out[0] = permuted(words[0], key, tweak)
        elif two:
            given = GIVEN[script, gender or "x"].split()
            pick = hashlib.blake2b(f"{tweak}\0{gender}\0{words[0]}".encode("utf-8", "replace"), key=key[:64], digest_size=8).digest()
            out[0] = given[int.from_bytes(pick, "big") % len(given)]
        return " ".join(out)
    return permuted(canon, key, tweak)


def _canon(kind: str, found: str) -> str | None:
    """The form that all spellings of an entity share; None if it isn't one."""
    if kind == "ipv6":
        try:
            ipaddress.IPv6Address(found)
        except ValueError:
            return None
        return found.lower()
    if kind == "email":
        return found.lower()
    if kind == "iban":
        canon = found.replace(" ", "")
        return canon if 15 <= len(canon) <= 34 and _iban_check(canon) == 1 else None
    if kind == "card":
        digits = re.sub(r"\D", "", found)
        return digits if luhn(digits) == 0 and len(set(digits)) > 1 else None
    if kind == "phone":
        return ("+" if found[0] == "+" else "") + re.sub(r"\D", "", found)
    return found


def _name_end(text: str, start: int) -> int:
    """Where the name that begins at ``start`` ends: behind its last capitalised word, or ``start`` if there is none.

    Particles count if a capitalised word follows; so do words like d'Arc. Another title ends a name.
    """
    at = end = start
    while m := _NAME_WORD.match(text, at):
        word = m[0]
        if end > start and word in _TITLE:
            break
        if word[0].isupper() or re.match(r"\w{1,3}['’-]\w", word) and word[re.search(r"['’-]", word).end()].isupper():
            end = m.end()
        elif word not in PARTICLES:
            break
        at = m.end() + 1
        if text[m.end() : at] != " ":
            break
    return end


def _render(kind: str, found: str, new: str) -> str:
    """The surrogate in the spelling of what was found: its separators and capitals."""
    if kind in ("card", "phone", "iban"):
        chars = iter(new.removeprefix("+"))
        return "".join(next(chars, "") if c.isalnum() else c for c in found)
    if kind == "email" and found != found.lower():
        return "".join(n.upper() if f.isupper() and len(n.upper()) == 1 else n for f, n in zip(found, new))
    if kind == "ipv6" and found != found.lower():
        return "".join(n.upper() if f.isupper() else n for f, n in zip(found, new))
    return new


class Entity(NamedTuple):
    """A detection; ``part`` says which words of a name are mentioned, and gender is that of its titles in the text."""

    start: int
    end: int
    kind: str
    canon: str
    gender: str = ""
    part: tuple[int, int] | None = None


def _named(text: str, m: re.Match) -> tuple[int, str]:
    """Where a name begins behind its titles, and the gender of the first title that has one."""
    start, gender = m.end(), _TITLE[m["title"]]
    while (more := _MORE_TITLES.match(text, start)) and _name_end(text, more.end()) > more.end():
        start, gender = more.end(), gender if gender != "x" else _TITLE[more["title"]]
    return start, gender


def _mentions(text: str, names: list[Entity]) -> list[Entity]:
    """Where words of the names stand without a title: as many as follow one another in the name are one mention."""
    places: dict[str, list[tuple[list[str], int, Entity]]] = {}
    for name in {n.canon: n for n in reversed(names)}.values():
        words = name.canon.split(" ")
        for i, word in enumerate(words):
            if word not in PARTICLES and len(word) > 1:
                places.setdefault(word, []).append((words, i, name))
    found, behind = [], 0
    for m in _NAME_WORD.finditer(text):
        if m.start() < behind:
            continue
        word = re.sub("['’]s?$", "", m[0]) if m[0] not in places else m[0]
        best = None
        for words, i, name in places.get(word, ()):
            end, j = m.start() + len(word), i + 1
            while end == m.start() + len(" ".join(words[i:j])) and j < len(words):
                after = _NAME_WORD.match(text, end + 1) if text[end : end + 1] == " " else None
                if not after or after[0] != words[j]:
                    break
                end, j = after.end(), j + 1
            while j - 1 > i and words[j - 1] in PARTICLES:
                j -= 1
                end = m.start() + len(" ".join(words[i:j]))
            if best is None or j - i > best.part[1] - best.part[0]:
                best = Entity(m.start(), end, "name", name.canon, name.gender, (i, j))
        if best:
            found.append(best)
            behind = best.end
    return found


class Detector:
    def __init__(self):
        self.patterns = [(kind, re.compile(p)) for kind, p in PATTERNS]

    def find(self, text: str) -> list[Entity]:
        """The entities in order and without overlaps; a name with a title also where it stands without one."""
        found: list[Entity] = []
        digits = any(d in text for d in "0123456789")
        for kind, pattern in self.patterns:
            if kind == "email" and "@" not in text or kind in ("ipv4", "iban", "card", "phone", "ssn") and not digits or kind == "ipv6" and ":" not in text:
                continue
            behind = 0
            for m in pattern.finditer(text):
                if kind == "name":
                    if m.start() < behind:
                        continue
                    start, gender = _named(text, m)
                    end = _name_end(text, start)
                    if end > start:
                        canon = text[start:end]
                        found.append(Entity(start, end, kind, canon, gender, (0, len(canon.split(" ")))))
                        behind = end
                    continue
                group = 0 if kind != "secret" else "secret" if m["secret"] else "aws"
                start, end = m.span(group)
                if kind == "secret" and not any(c.isdigit() for c in m[group]):
                    quoted = text[start - 1 : start] in ("'", '"') and text[end : end + 1] in ("'", '"')
                    if not ((m["word"] or "password").lower() in _WORDLIKE_SECRETS or quoted or end - start >= _LONG_SECRET):
                        continue
                canon = _canon(kind, m[group])
                if canon is None:
                    continue
                found.append(Entity(start, end, kind, canon))
        names = [f for f in found if f.kind == "name"]
        if names:
            known: dict[str, str] = {}
            for n in names:
                known[n.canon] = min(known.get(n.canon, "x"), n.gender)
            found = [f._replace(gender=known[f.canon]) if f.kind == "name" else f for f in found]
            found += _mentions(text, [f for f in found if f.kind == "name"])
        kept = []
        rank = {kind: i for i, (kind, _) in enumerate(PATTERNS)}
        by_rank = sorted(found, key=lambda f: rank[f[2]])
        taken: list[tuple[int, int]] = []
        if len(found) > 1:
            from bisect import bisect_left, insort

            for f in by_rank:
                at = bisect_left(taken, (f[0], f[1]))
                if (at and taken[at - 1][1] > f[0]) or (at < len(taken) and taken[at][0] < f[1]):
                    continue
                insort(taken, (f[0], f[1]))
                kept.append(f)
            return sorted(kept)
        return found


def entities(docs: DataFrame) -> DataFrame:
    """text_key, kind, canon, gender: each text's different entities; text_key is the text's hash."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector()
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows += {(key, e.kind, e.canon, e.gender) for e in detector.find(text.as_py())}
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["text_key", "kind", "canon", "gender"])

    slim = docs.select(F.xxhash64(text_of()).alias("text_key"), text_of().alias("text"))
    return slim.mapInArrow(of, f"text_key long, {ENTITY}")


def _with_surrogates(named: DataFrame, key: bytes) -> DataFrame:
    """kind, canon, gender, attempt, surrogate for rows of kind, canon, gender, attempt."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [surrogate(k, c, key, a, g) for k, c, g, a in zip(*(batch.column(i).to_pylist() for i in range(4)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=["kind", "canon", "gender", "attempt", "surrogate"])

    return named.select("kind", "canon", "gender", "attempt").mapInArrow(of, f"{ENTITY}, attempt int, surrogate string")


def dictionary(found: DataFrame, key: bytes) -> DataFrame:
    """kind, canon, gender, attempt, surrogate of the different entities (kind, canon, gender), with no surrogate twice and none an entity.

    A name is one entity whatever its titles: of the genders they give it, the first in the alphabet counts, none last. Of entities whose surrogates meet, the first keeps it; the others, and those
    whose surrogate is an entity of the corpus, draw again until none meets.
    """
    names = written(found.groupBy("kind", "canon").agg(F.min("gender").alias("gender")), "pii-entities")
    # Few bytes but much work each: dealt by their number, not their size.
    dealt = names.repartition(max(1, -(-names.count() // TASK_ENTITIES)), "kind", "canon")
    table = written(_with_surrogates(dealt.withColumn("attempt", F.lit(0)), key), "pii-surrogates")
    while True:
        real = names.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("real"))
        first = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("attempt", "canon"))
        judged = hot_split_join(table, real, ["kind", "surrogate"], "left").withColumn("place", first)
        again = written(judged.where("real OR place > 1").select("kind", "canon", "gender", (F.col("attempt") + 1).alias("attempt")), "pii-again")
        if again.isEmpty():
            return table
        kept = table.join(again, ["kind", "canon"], "left_anti")
        table = written(kept.union(_with_surrogates(again, key)), "pii-surrogates")


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """All columns of ``docs`` with their text's entities replaced, and ``entities`` (array of kind, start, end in the new text).

    Null texts stay null and texts without entities as they are. Words of a name that has a title
    somewhere in the text are replaced wherever they stand in it. Only entities that
    had to draw again, and names whose titles differ between texts, need more than the key: they come with a join on the text's
    hash. A column ``entities`` of docs is replaced.
    """
    seen = written(entities(docs), "pii-seen")
    several = seen.groupBy("kind", "canon").agg(F.min("gender").alias("least"), F.max("gender").alias("most")).where("least < most")
    several = several.select("kind", "canon", F.lit(True).alias("several"))
    told = dictionary(seen, key).select("kind", "canon", "gender", "attempt").join(several, ["kind", "canon"], "left")
    told = written(told.where("attempt > 0 OR several").drop("several"), "pii-told")
    extra = (
        hot_split_join(seen.drop("gender").distinct(), told, ["kind", "canon"], "inner")
        .groupBy("text_key").agg(F.collect_list(F.struct("kind", "canon", "gender", "attempt")).alias("__redrawn"))
    )
    extra = written(extra, "pii-redrawn")
    docs = docs.drop("entities")
    keyed = docs.withColumn("__text_key", F.xxhash64(text_of()))
    joined = hot_split_join(keyed, extra.withColumnRenamed("text_key", "__text_key"), ["__text_key"], "left").select(*docs.columns, "__redrawn")
    at = docs.columns.index("text")
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector, known = Detector(), {}
        for batch in batches:
            texts, told = [], []
            for text, redrawn in zip(batch.column(at), batch.column(batch.num_columns - 1)):
                text = text.as_py()
                told_of = {(r["kind"], r["canon"]): (r["attempt"], r["gender"]) for r in redrawn.as_py() or ()}
                out, spots, done, size = [], [], 0, 0
                for start, end, kind, canon, gender, part in detector.find(text) if text else ():
                    entity = (kind, canon, *told_of.get((kind, canon), (0, gender)))
                    if entity not in known:
                        if len(known) > 200_000:
                            known.clear()
                        known[entity] = surrogate(kind, canon, key, entity[2], entity[3])
                    new = known[entity]
                    if part and part != (0, len(canon.split(" "))):
                        new = " ".join(new.split(" ")[slice(*part)])
                    new = _render(kind, text[start:end], new)
                    out += [text[done:start], new]
                    size += start - done
                    spots.append({"kind": kind, "start": size, "end": size + len(new)})
                    size, done = size + len(new), end
                texts.append("".join(out) + text[done:] if out else text)
                told.append(spots)
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(told, spans)], names=[*docs_names, "entities"])

    docs_names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(of, f"{schema}, entities array<struct<kind:string,start:bigint,end:bigint>>")
