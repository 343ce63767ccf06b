"""Op 8, personal data replaced by keyed, type-consistent surrogates.

Found are mail addresses, phone numbers, IPv4 addresses, payment card numbers (by check digit), national ids,
access keys and secrets, and names after a title. Each distinct entity (in its normal form) gets one
surrogate from HMAC-SHA256 of a key, so all its mentions in all texts agree. Surrogates keep the type:
lengths, digit and letter classes, case, script and separators, a card's check digit, an address's
form, a name's gender (from the title) and number of parts. Each mention is written in its own format.

A phone's normal form is its national number; country code and trunk 0 stay as they are written, so
mentions with and without them agree. In a text, a name found after a title is one person with the
same name after other titles, with its surname alone after a title (unless two persons have it), and
with its later and earlier mentions without a title, whole, given name or surname; these are found, too.

The key is an argument or the setting ``spark.tidefold.pii.key``; where neither is given a new one is
drawn for the run, so that nobody can invert the mapping by trying.

Collision checks keep distinct entities distinct: where two share a surrogate, or a surrogate is
itself a found entity, all but the first (settled ones first, then the least) draw again until none
collides. From the eighth attempt on they grow longer (but for IPv4 addresses), so the supply doesn't end.
The work is aggregations and joins on entities; a frequent entity is summed up before the
shuffle. Texts in which a quick pattern finds nothing pass without a shuffle.

Null and empty texts come back as they are with 0 entities; repeated rows are treated alike.
"""

from __future__ import annotations

import hashlib
import hmac
import secrets
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import Scratch, fits, slices, table

KEY_SETTING = "spark.tidefold.pii.key"
_TITLES = {"mr": "m", "herr": "m", "monsieur": "m", "señor": "m", "sr": "m", "don": "m", "господин": "m", "mrs": "f", "ms": "f", "miss": "f", "frau": "f", "madame": "f", "mme": "f", "señora": "f", "sra": "f", "doña": "f", "госпожа": "f", "dr": "n", "prof": "n"}
_GIVEN = {
    "Latin": {"m": "Adam Bruno Cedric David Emil Felix Georg Hugo Ivan Jonas Karl Leo Martin Noah Oscar Paul Quentin Robert Simon Thomas Victor Walter".split(), "f": "Anna Bella Clara Diana Emma Flora Greta Hanna Irene Julia Karla Laura Maria Nora Olga Paula Rosa Sara Tina Ursula Vera Wanda".split()},
    "Cyrillic": {"m": "Алексей Борис Виктор Григорий Дмитрий Егор Иван Кирилл Леонид Михаил Николай Олег Павел Роман Сергей".split(), "f": "Анна Валентина Галина Дарья Елена Зоя Ирина Ксения Лидия Марина Надежда Ольга Полина Раиса Светлана".split()},
}
_SURNAMES = {
    "Latin": "Abel Baker Carter Dumont Ebert Fischer Garcia Hansen Ibarra Jensen Keller Lopez Moreau Novak Olsen Perez Richter Santos Torres Ulrich Vogel Weber Young Ziegler Arnold Becker Castro Duval Engel Franke".split(),
    "Cyrillic": "Абрамов Белов Волков Громов Данилов Жуков Зайцев Ильин Козлов Лебедев Морозов Новиков Орлов Попов Романов Соколов".split(),
}

_TITLE = "|".join(sorted((t[0].upper() + t[1:] for t in _TITLES), key=len, reverse=True))
#: A country code and groups of any size, perhaps with the trunk's (0) or an area in parentheses; ``phone`` checks the number of digits.
_GROUPS = r"\d{1,3}(?:[ .\-/]?\(\d{1,5}\))?(?:[ .\-/]?\d){4,14}"
#: Numbers with a leading 0 (in pairs, in other groups, or 10 or 11 digits in one) and Spanish ones of 9 digits in groups; no dates.
_NATIONAL = (
    r"(?<![\w+]|\d[.,\-/ ])(?!\d\d?[ .\-/]\d\d?[ .\-/](?:19|20)\d\d(?!\d))"
    r"(?:0[1-9](?:(?P<sep>[ .\-])\d{2})(?:(?P=sep)\d{2}){3}|\(0\d{1,4}\)[ \-/]?\d{2,8}(?:[ \-]\d{2,6}){0,3}|0[1-9]\d{0,3}[ \-/]\d{2,8}(?:[ \-]\d{2,8}){0,4}|0[1-9]\d{8,9}"
    r"|[6-9]\d{2}(?P<s3>[ \-])\d{3}(?P=s3)\d{3}|[6-9]\d{2}(?P<s2>[ .\-])\d{2}(?P=s2)\d{2}(?P=s2)\d{2}|[89]\d(?P<s1>[ .\-])\d{3}(?P=s1)\d{2}(?P=s1)\d{2})(?!\d|[.,\-/]\d)"
)
FINDER = regex.compile(
    r"(?P<email>[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)+)"
    r"|(?P<aws>\b(?:AKIA|ASIA)[0-9A-Z]{16}\b)"
    r"|(?P<token>\b(?:ghp|gho|ghs|sk|pk|xox[abp])[_\-][0-9A-Za-z_\-]{16,})"
    r"|(?:(?i:\b(?:password|passwd|pwd|secret|token|api[_\-]?key))[\"']?\s{0,3}[=:]\s{0,3}[\"']?(?P<secret>[^\s\"',;]{6,}))"
    r"|(?P<ipv4>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))"
    r"|(?P<ssn>(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-]))"
    r"|(?P<card>(?<![\d\-])[3-6]\d{3}(?:(?P<gap>[ \-]?)\d{4}(?P=gap)\d{4}(?P=gap)\d{1,4}|[ \-]?\d{6}[ \-]?\d{5})(?![\d\-]))"
    r"|(?P<phone>(?<![\d\w])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?\d{2,4}[ .\-]?\d{3,4}|\d{3}[ .\-]\d{3}[ .\-]\d{4})(?![\d])|"
    rf"(?<![\d\w])(?:\+|00(?=[1-9])){_GROUPS}(?![\d])|(?<![\d\w])\+\d{{1,3}}(?:[ .\-]?\d{{2,4}}){{2,4}}(?![\d])|{_NATIONAL})"
    rf"|(?:\b(?P<title>{_TITLE})\.?\s(?P<name>\p{{Lu}}[\p{{L}}'’\-]+(?:\s\p{{Lu}}[\p{{L}}'’\-]+){{0,2}}))"
)
KINDS = ("email", "aws", "token", "secret", "ipv4", "ssn", "card", "phone", "name")
#: What every text with an entity has, as a pattern for the JVM; each alternative begins with few letters.
QUICK = rf"[@=:_]|\+\p{{Nd}}|\p{{Nd}}{{2}}|\p{{Nd}}\.\p{{Nd}}|A[KS]IA|-[0-9A-Za-z_\-]{{16}}|(?=[{''.join(sorted({t[0] for t in _TITLE.split('|')}))}])(?:{_TITLE})(?U:[.\s\x1c-\x1f])"


#: Digits of a number with its country code, where the plan fixes them.
_PLANS = {"1": 11, "7": 11, "33": 11, "34": 11}


#: Country codes of two digits; others than these, 1 and 7 have three.
_TWO = {20, 27, 30, 31, 32, 33, 34, 36, 39, 40, 41, 43, 44, 45, 46, 47, 48, 49, 51, 52, 53, 54, 55, 56, 57, 58, 60, 61, 62, 63, 64, 65, 66, 81, 82, 84, 86, 90, 91, 92, 93, 94, 95, 98}


def before_national(raw: str) -> int:
    """How many digits of a phone number come before the national number: country code, trunk 0 and 00."""
    if raw.startswith("+") or raw.startswith("00"):
        body = raw[1:] if raw[0] == "+" else raw[2:]
        head = regex.match(r"\d+", body)[0]
        set_off = len(head) <= 3 and len(head) < len(body)
        code = len(head) if set_off else 1 if head[0] in "17" else 2 if int(head[:2]) in _TWO else 3
        return code + 2 * (raw[0] == "0") + ("(0)" in raw)
    return int(raw.startswith(("0", "(0")))


def phone(raw: str) -> str:
    """``raw`` without last groups that are too many for a number; empty if it has too few digits."""
    plain = raw.replace("(0)", "")
    digits = "".join(c for c in plain if c.isdigit())
    if raw.startswith(("+", "00")):
        digits = digits if raw[0] == "+" else digits[2:]
        fewest, most = 7, next((n for code, n in _PLANS.items() if digits.startswith(code)), 13)
    elif raw.startswith(("0", "(0")):
        fewest, most = 8, 12
    else:
        return raw
    while len(digits) > most and (cut := regex.search(r"[ .\-/]\d+$", raw)):
        digits, raw = digits[: -(len(cut[0]) - 1)], raw[: cut.start()]
    return raw if fewest <= len(digits) <= max(most, 15) else ""


def found(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) of the entities of a text, in its order."""
    out, titled = [], []
    at = 0
    while m := FINDER.search(text, at):
        kind = next(k for k in KINDS if m[k] is not None)
        a, b = m.span(kind)
        at = m.end()
        raw = text[a:b]
        if kind == "email":
            raw = raw.rstrip(".-")
            b = a + len(raw)
            norm = raw.lower()
        elif kind in ("phone", "card", "ssn"):
            if kind == "phone":
                raw = phone(raw)
                if not raw:
                    continue
                b = at = a + len(raw)  # what was cut off may be another number
            norm = "".join(c for c in raw if c.isdigit())
            if kind == "phone":
                norm = norm[before_national(raw) :]
            if kind == "card" and not luhn(norm):
                continue  # some other long number
        elif kind == "secret" and len(set(raw)) == 1 and not raw[0].isalnum():
            continue  # a mask
        elif kind == "name":
            titled.append((a, b, _TITLES[m["title"].lower()], raw))
            continue
        else:
            norm = raw
        out.append((a, b, kind, norm))
    return sorted(out + named(text, titled, out)) if titled else out


def named(text: str, titled: list[tuple[int, int, str, str]], taken: list[tuple]) -> list[tuple[int, int, str, str]]:
    """The mentions of the persons found after titles (start, end, gender, name); the normal form is gender and name."""
    fold = lambda raw: " ".join(raw.split()).casefold()
    genders: dict[str, set[str]] = {}
    for _, _, g, raw in titled:
        genders.setdefault(fold(raw), set()).update(g if g != "n" else "")
    gender = {name: next(iter(g)) if len(g) == 1 else "n" for name, g in genders.items()}
    whole: dict[str, list[str]] = {}
    for name in gender:
        if " " in name:
            whole.setdefault(name.split()[-1], []).append(name)

    def person(name: str, g: str) -> str:
        """The whole name that a surname stands for, if one alone fits."""
        fits_ = [x for x in whole.get(name, ()) if g == "n" or gender[x] in ("n", g)]
        return fits_[0] if len(fits_) == 1 else name

    out = []
    forms: dict[str, set[str]] = {}  # as written without a title: normal forms
    for a, b, g, raw in titled:
        name = fold(raw)
        full = name if " " in name else person(name, g)
        known = gender[full] if gender[full] != "n" else gender.get(name, "n")
        norm = f"{known} {full}"
        out.append((a, b, "name", norm))
        parts = raw.split()
        for form in {" ".join(parts), parts[0], parts[-1]}:
            forms.setdefault(form, set()).add(norm)
    forms = {form: next(iter(norms)) for form, norms in forms.items() if len(norms) == 1}  # of one person alone
    if not forms:
        return out
    spans = sorted((a, b) for a, b, *_ in [*out, *taken])
    plain = regex.compile(r"(?<![\p{L}\p{N}@._\-])(?:" + "|".join(r"\s".join(map(regex.escape, f.split())) for f in sorted(forms, key=len, reverse=True)) + r")(?![\p{L}\p{N}_@]|-\p{L})")
    at = 0
    for m in plain.finditer(text):
        while at < len(spans) and spans[at][1] <= m.start():
            at += 1
        if at == len(spans) or spans[at][0] >= m.end():
            out.append((*m.span(), "name", forms[" ".join(m[0].split())]))
    return out


class Draw:
    """A keyed stream of numbers for one entity and attempt."""

    def __init__(self, key: str, kind: str, norm: str, attempt: int):
        self.base = hmac.new(key.encode(), f"{kind}\x00{norm}\x00{attempt}".encode(), hashlib.sha256).digest()
        self.n, self.pool = 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hashlib.sha256(self.base + self.n.to_bytes(4, "big")).digest()
            self.n += 1
        out, self.pool = int.from_bytes(self.pool[:4], "big") % n, self.pool[4:]
        return out


_SIGNS = "!#$%&*+-./:<=>?@^_|~"
_ALPHABETS = {"Latin": "abcdefghijklmnopqrstuvwxyz", "Cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "Greek": "αβγδεζηθικλμνξοπρστυφχψω"}


def _script(c: str) -> str:
    o = ord(c)
    return "Latin" if o < 0x250 or 0x1E00 <= o < 0x1F00 else "Greek" if 0x370 <= o < 0x400 else "Cyrillic" if 0x400 <= o < 0x530 else "other"


def shaped(text: str, d: Draw, hexa: bool = False) -> str:
    """The same shape: digits for digits, letters of the same case and script for letters."""
    out = []
    for c in text:
        if hexa and c in "0123456789abcdef":
            c = "0123456789abcdef"[d.below(16)]
        elif c.isdecimal():
            c = chr(ord(c) - unicodedata.decimal(c) + d.below(10))
        elif c.isalpha():
            letters = _ALPHABETS.get(_script(c))
            if letters:
                x = letters[d.below(len(letters))]
                c = x.upper() if c.isupper() else x
            else:  # scripts without case lists stay in their block of 64 letters
                base = ord(c) & ~63
                same = [chr(base + i) for i in range(64) if chr(base + i).isalpha()]
                c = same[d.below(len(same))]
        elif c.isnumeric():
            c = str(d.below(10))
        out.append(c)
    return "".join(out)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def surrogate(key: str, kind: str, norm: str, attempt: int = 0) -> str:
    """The surrogate in normal form."""
    d = Draw(key, kind, norm, attempt)
    if kind in ("ipv4", "name"):
        more = ""
    else:  # late attempts, longer ones
        more = "".join(str(d.below(10)) for _ in range(attempt - 7))
    if kind == "email":
        local, _, domain = norm.partition("@")
        labels = domain.split(".")
        return shaped(local, d) + more + "@" + ".".join([shaped(x, d) for x in labels[:-1]] + labels[-1:])
    if kind == "ipv4":
        first = 1 + d.below(223)
        return ".".join(str(x) for x in (first + (first == 127), d.below(256), d.below(256), 1 + d.below(254)))
    if kind == "card":  # found ones have a right check digit
        body = norm[0] + "".join(str(d.below(10)) for _ in norm[2:]) + more
        good = next(str(c) for c in range(10) if luhn(body + str(c)))
        return body + good
    if kind == "phone":
        return str(2 + d.below(8)) + "".join(str(d.below(10)) for _ in norm[1:]) + more
    if kind == "ssn":
        return f"{1 + d.below(665):03d}{1 + d.below(99):02d}{1 + d.below(9999):04d}" + more
    if kind == "aws":
        return norm[:4] + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[d.below(32)] for _ in norm[4:]) + more
    if kind == "name":
        gender, _, rest = norm.partition(" ")
        parts, script = rest.split(), _script(rest[0])
        script = script if script in _GIVEN else "Latin"
        gender = gender if gender in "mf" else "mf"[d.below(2)]
        given, last = _GIVEN[script][gender], _SURNAMES[script]
        out = [given[d.below(len(given))] for _ in parts[:-1]] + [last[d.below(len(last))]]
        for _ in range(attempt):  # more attempts, longer surnames: the supply doesn't end
            out[-1] += "-" + last[d.below(len(last))]
        return norm[0] + " " + " ".join(out)
    if kind == "token":
        head = regex.match(r"[a-z]+[_\-]", norm)[0]
        return head + shaped(norm[len(head) :], d) + more
    if not any(c.isalnum() for c in norm):  # a secret of signs alone
        return "".join(_SIGNS[d.below(len(_SIGNS))] for _ in norm) + more
    return shaped(norm, d, hexa=bool(regex.fullmatch(r"[0-9a-f]+", norm))) + more


def written(raw: str, kind: str, made: str, norm: str = "") -> str:
    """A surrogate in the format of one mention; norm: the entity's normal form, of which a name's mention may be a part."""
    if kind in ("phone", "card", "ssn"):
        digits, out, skip = iter(made), [], before_national(raw) if kind == "phone" else 0
        for c in raw:
            if c.isdigit() and skip:
                skip -= 1
            elif c.isdigit():
                c = next(digits)
            out.append(c)
        return "".join(out) + "".join(digits)
    if kind == "email":
        if raw == raw.upper():
            return made.upper()
        return "".join(x.upper() if c.isupper() else x for c, x in zip(raw, made, strict=False)) if len(raw) == len(made) else made
    if kind == "name":
        name, parts, mine = made[2:], norm[2:].split(), raw.casefold().split()
        if len(mine) < len(parts):  # the surname or the given name alone
            name = name.split()[-1] if mine[-1] == parts[-1] else name.split()[0]
        return name.upper() if raw.isupper() else name
    return made


def entities(rows: DataFrame) -> DataFrame:
    """(_key, kind, norm) of ``rows`` (_key, text), once for each entity of a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out += [(k, *e) for e in sorted({x[2:] for x in found(text.as_py() or "")})]
            cols = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], ["_key", "kind", "norm"])

    return rows.mapInArrow(run, "_key long, kind string, norm string")


def drawn(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (kind, norm, attempt) with made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [surrogate(key, *e) for e in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], ["kind", "norm", "attempt", "made"])

    return rows.select("kind", "norm", F.col("attempt").cast("int").alias("attempt")).mapInArrow(run, "kind string, norm string, attempt int, made string")


def assign(distinct: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(kind, norm, made): a surrogate for each entity, all different within a kind."""
    now = scratch.write(drawn(distinct.withColumn("attempt", F.lit(0)), key), "draw")
    while True:  # each kind's supply grows with the attempts, so this ends
        taken = now.select("kind", F.col("norm").alias("made")).withColumn("real", F.lit(True))
        rank = F.row_number().over(Window.partitionBy("kind", "made").orderBy("attempt", "norm"))
        seen = now.withColumn("rank", rank).join(taken, ["kind", "made"], "left").withColumn("again", (F.col("rank") > 1) | F.coalesce("real", F.lit(False)))
        seen = scratch.write(seen.select("kind", "norm", "attempt", "made", "again"), "seen")
        scratch.drop(now)
        if not seen.where("again").limit(1).count():
            return seen.select("kind", "norm", "made")
        fresh = seen.where("again").withColumn("attempt", F.col("attempt") + 1)
        now = scratch.write(seen.where("NOT again").drop("again").unionByName(drawn(fresh, key)), "draw")


def replace(docs: DataFrame, key: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """All columns of ``docs``, text with surrogates, and pii_entities (mentions; int)."""
    key = key or docs.sparkSession.conf.get(KEY_SETTING, None) or secrets.token_hex(32)
    scratch, names = scratch or Scratch(docs.sparkSession, "pii"), docs.columns
    count, row, pairs = fits(names, "pii_entities"), fits(names, "_key"), fits(names, "_pairs")
    has = F.coalesce(F.col("text").rlike(QUICK), F.lit(False))
    clean = docs.where(~has).withColumn(count, F.lit(0))
    maybe = docs.where(has).withColumn(row, F.xxhash64("doc_id", "text"))
    # a hash of id and text names a row; rows that share it would only share more of the same mapping
    lists = scratch.write(entities(maybe.select(F.col(row).alias("_key"), "text")).distinct(), "mentions")
    made = assign(lists.select("kind", "norm").distinct(), key, scratch)
    own = lists.join(made, ["kind", "norm"]).groupBy("_key").agg(F.collect_list(F.struct("kind", "norm", "made")).alias(pairs)).withColumnRenamed("_key", row)
    joined = maybe.join(own, row, "left").select(*names, pairs)
    at = names.index("text")
    schema = joined.select(*names).schema.add(count, "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts, counts = [], []
            for text, known in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                by = {(x["kind"], x["norm"]): x["made"] for x in known or ()}
                out, last, hits = [], 0, found(text) if by else []
                for a, b, kind, norm in hits:
                    out += [text[last:a], written(text[a:b], kind, by[kind, norm], norm)]
                    last = b
                texts.append("".join([*out, text[last:]]) if hits else text)
                counts.append(len(hits))
            cols = [c for c in batch.columns[: len(names)]]
            cols[at] = pa.array(texts, schema_arrow(batch, at))
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int32())], [*names, count])

    return clean.unionByName(joined.mapInArrow(run, schema))


def schema_arrow(batch: pa.RecordBatch, at: int) -> pa.DataType:
    return batch.schema.field(at).type


def op8_surrogate_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with surrogates and pii_entities of every row of ``documents``."""
    return replace(table(spark, sf_dir, "documents").select("doc_id", "text"))
