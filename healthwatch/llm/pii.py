"""Surrogates for personal data.

Detected entities are replaced by keyed, type-consistent surrogates: the same
entity gets the same surrogate everywhere (coreference), drawn from a keyed
hash of its type and canonical form.  Surrogates keep the format of the
mention: punctuation and length of numbers, country codes and trunk prefixes,
check digits of card numbers, shape of addresses, letter case, and for names
script, gender (from the title) and the number of parts.

A name is found behind a title; then its parts are found in the whole
document, alone or together.  Surrogates belong to the parts, so "Mr Smith",
"Mr John Smith" and a bare "Smith" agree.  A bare part takes the gender of the
last titled mention before it that has the part, else of the first one.

Distinct entities must stay distinct.  All distinct entities of the corpus are
drawn together and collisions are looked for with a group-by: two entities of
a type with one surrogate, or a surrogate that is itself an entity of the
corpus.  The smallest entity of a collision keeps its draw, the others draw
again until none collides.  Redrawn names, addresses and domains get longer
with every attempt, numbers and phones after :data:`GROW_AFTER`, so a small
space of draws cannot run out.  IP addresses and card numbers keep their
length; when these run out an error is raised.  Domains are settled before the
addresses under them.  Only these exceptions travel back to the
documents; every other surrogate is computed where the text is."""

from __future__ import annotations

import bisect
import hashlib
import hmac
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from healthwatch.llm.common import RID, map_arrow, sized, with_row_id, write_table

KINDS = ("email", "phone", "ip", "card", "number", "name")
DEFAULT_KEY = b"replace-this-key"
#: Attempts after which a redrawn number or phone gets one more digit each.
GROW_AFTER = 4
#: Rounds of redrawing after which IP addresses or cards count as used up.
MOST_ROUNDS = 64

MALE_TITLES = "Mr Herr Monsieur Señor Sr г-н Г-н".split()
FEMALE_TITLES = "Mrs Ms Miss Frau Madame Mme Señora Sra г-жа Г-жа".split()
_NAME = r"[^\W\d_a-z]\w*(?:-\w+)?"
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_DIGIT = re.compile(r"\d")
_NUMERIC = re.compile(
    r"(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d))"
    r"|(?P<ip>(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\w|\.\d))"
    r"|(?P<local>(?:(?<![\w.+/-])1[ .-]?)?(?<![\d+])\(\d{2,5}\)[ .-]?\d{3,4}(?:[ .-]?\d{3,4}){1,2}(?!\w)"
    r"|(?<![\w.+/-])(?:1[ .-])?[2-9]\d\d(?:-\d{3}-|\.\d{3}\.| \d{3} )\d{4}(?![\w]|[.-]\d)"
    r"|(?<![\w.+/-])(?!\d\d?[/.-]\d\d?[/.-]\d{4}\b)(?=(?:[ /-]?\d){9,15}(?![ /-]?\d))0\d{1,4}(?:[ /-]\d{2,8}){1,5}(?!\w))"
    r"|(?P<number>(?<!\w)\d{4}(?:[ -]\d{4}){3}(?!\w)|(?<!\w)\d{3}-\d{2}-\d{4}(?!\w)|(?<!\w)\d{9,19}(?!\w))")
_TITLES = tuple(sorted(MALE_TITLES + FEMALE_TITLES, key=len, reverse=True))
_INITIAL = r"[^\W\d_a-z]\."
_NEXT = r"(?!(?:" + "|".join(_TITLES) + r")\b)" + _NAME
_NAMED = re.compile(r"\b(?P<title>" + "|".join(_TITLES) + r")\.? (?P<name>(?:" + _INITIAL + " ?){0,3}" + _NAME
                    + "(?: (?:" + _INITIAL + " ?){0,2}" + _NEXT + "){0,2})")
#: Words of a name: initials with their point, else whole words.
_PART = re.compile(r"\w\.|\w+(?:-\w+)?")
_BARE = re.compile(r"(?<!\w)" + _NAME)
#: Words that start sentences; as a part of a name they are not looked for alone.
COMMON = frozenset("i the a an and or but in on at to of for from with he she it we they you this that his her my our your their as if when then "
                   "there what who how why is was are were has had not no yes so by der die das und ein eine er sie ich le la les et el los".split())

#: Country codes of two digits; 1 and 7 have one, all others three.
COUNTRY_2 = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

LETTERS = "abcdefghijklmnopqrstuvwxyz"

#: Syllables per script; names are built from them, with an ending by gender.
SYLLABLES = {
    "latin": ("al ber cor dan el far gor hal is jor kar lin mar nor ol per quin ros sel tor ul vin wes yor zan".split(),
              {"m": "o us an er in".split(), "f": "a ia ina elle ette".split(), "m+": "en ar is on el".split(), "f+": "en ar is on el".split()}),
    "cyrillic": ("ал бор вел гор дар ел жар зор ив кор лад мир нев ол пав рад свет тих ул фед яр".split(),
                 {"m": "ан ий ей ин ор".split(), "f": "а ия ина ева яна".split(), "m+": "ов ев ин ко ич".split(), "f+": "ова ева ина ко ская".split()}),
    "hebrew": ("בר גל דן הד זו חן טל יר כר לב מר נו סר עד פז צב קר רם שי תם".split(), {"m": "ון אל ר ם ן".split(), "f": "ה ית יה לי נה".split()}),
    "arabic": ("با جا حا دا را سا شا صا طا عا فا قا كا لا ما نا ها وا يا زا".split(), {"m": "د ر ل م ن".split(), "f": "اء ة ى يا نه".split()}),
    "armenian": ("ան բա գա դա ել զա թա լա խա կա հա մա նա շա պա ռա սա վա տա րա".split(), {"m": "են ան որ իկ ակ".split(), "f": "ուհի ինե ա ե անի".split()}),
    "georgian": ("ბა გა და ვა ზა თა კა ლა მა ნა პა რა სა ტა ქა შა ჩა ცა ძა ხა".split(), {"m": "ი ო უა ენ ელ".split(), "f": "ა ია ნა იკო ელა".split()}),
    "han": ("安 白 成 德 方 高 海 建 林 明 宁 平 青 瑞 山 松 文 新 永 志".split(), {"m": "伟 强 军 刚 勇".split(), "f": "芳 娜 丽 静 燕".split()}),
    "hangul": ("가 나 도 라 마 민 보 서 석 선 성 수 연 영 우 원 윤 은 재 진".split(), {"m": "호 준 기 철 훈".split(), "f": "희 미 숙 아 자".split()}),
    "kana": ("ア イ カ キ サ シ タ チ ナ ニ ハ ヒ マ ミ ヤ ユ ラ リ ル ワ".split(), {"m": "オ ロウ スケ ゾウ ト".split(), "f": "コ エ ヨ ネ ノ".split()}),
    "greek": ("αλ βασ γορ δαμ ελ ζην ηλ θαλ ιρ καλ λυκ μαρ νικ ορ παυ ραδ στεφ τιμ φιλ χαρ".split(),
              {"m": "ος ας ης ων ιος".split(), "f": "α η ια ινα ω".split(), "m+": "ης ις ας ιδης ακης".split(), "f+": "ου ιδου ακη η ας".split()}),
}
#: First and last character of the scripts; all others get Latin surrogates.
RANGES = (("cyrillic", "\u0400", "\u04ff"), ("greek", "\u0370", "\u03ff"), ("hebrew", "\u0590", "\u05ff"), ("arabic", "\u0600", "\u06ff"),
          ("armenian", "\u0530", "\u058f"), ("georgian", "\u10a0", "\u10ff"), ("han", "\u4e00", "\u9fff"), ("hangul", "\uac00", "\ud7a3"), ("kana", "\u3040", "\u30ff"))


class Draws:
    """Endless keyed draws for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, canonical: str, attempt: int):
        self.key, self.seed = key, f"{kind}\0{canonical}\0{attempt}".encode()
        self.block, self.pool = 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.new(self.key, self.seed + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.block += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value % n

    def pick(self, options):
        return options[self.below(len(options))]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _script(text: str) -> str:
    first = next((c for c in text if c.isalpha()), "a")
    return next((name for name, low, high in RANGES if low <= first <= high), "latin")


def parts(canonical: str) -> list[str]:
    """Canonical forms of a name's parts; initials end with a point."""
    gender, _, name = canonical.split(":", 2)
    return [f"{gender}:{_script(w)}:{w}" for w in name.split(" ")]


def _echoes(text: str, people: list[tuple[int, str, list[str]]]) -> list[tuple[int, int, str, str]]:
    """Mentions without a title of the parts of ``people`` (start, gender,
    parts); neighbours of one gender are one mention."""
    known: dict[str, tuple[list[int], list[str]]] = {}
    for start, gender, words in people:
        for w in words:
            if not w.endswith(".") and w not in COMMON:
                starts, genders = known.setdefault(w, ([], []))
                starts.append(start)
                genders.append(gender)
    out: list[tuple[int, int, str, list[str]]] = []
    for m in _BARE.finditer(text):
        halves = [(m.start(), m.group())]
        if m.group().casefold() not in known and "-" in m.group():
            first, _, second = m.group().partition("-")
            halves = [(m.start(), first), (m.start() + len(first) + 1, second)]
        for at, word in halves:
            w = word.casefold()
            if w not in known or word[0].islower():
                continue
            starts, genders = known[w]
            gender = genders[max(0, bisect.bisect_right(starts, at) - 1)]
            if out and out[-1][1] == at - 1 and text[at - 1] == " " and out[-1][2] == gender:
                out[-1] = (out[-1][0], at + len(word), gender, [*out[-1][3], w])
            else:
                out.append((at, at + len(word), gender, [w]))
    return [(a, b, "name", f"{gender}:{_script(text[a:b])}:{' '.join(words)}") for a, b, gender, words in out]


def _kept_digits(digits: str, national: bool) -> int:
    """Digits of the country code, or of a national trunk prefix."""
    if national and not digits.startswith("00"):
        return int(digits[0] == "0" or (len(digits) == 11 and digits[0] == "1"))
    lead = 2 if national else 0
    code = digits[lead:]
    return min(lead + (1 if code[:1] in ("1", "7") else 2 if code[:2] in COUNTRY_2 else 3), len(digits) - 1)


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of the entities of a text."""
    if not text:
        return []
    found = []
    if "@" in text:  # the patterns run only on texts that can match them
        found += [(m.start(), m.end(), "email", m.group().lower()) for m in _EMAIL.finditer(text)]
    if _DIGIT.search(text):
        for m in _NUMERIC.finditer(text):
            kind, digits = m.lastgroup, re.sub(r"\D", "", m.group())
            if kind == "ip":
                digits = ".".join(str(int(x)) for x in m.group().split("."))
            elif kind == "number" and 13 <= len(digits) <= 19 and luhn(digits):
                kind = "card"
            elif kind == "local":
                kind, digits = "phone", f"n:{digits}"
            found.append((m.start(), m.end(), kind, digits))
    if any(t in text for t in _TITLES):
        people = []
        for m in _NAMED.finditer(text):
            gender, name = "m" if m.group("title") in MALE_TITLES else "f", m.group("name")
            words = [w.casefold() for w in _PART.findall(name)]
            found.append((m.start("name"), m.end("name"), "name", f"{gender}:{_script(name)}:{' '.join(words)}"))
            people.append((m.start("name"), gender, words))
        found += _echoes(text, people) if people else []
    out, last = [], 0
    for span in sorted(found, key=lambda x: (x[0], -x[1])):  # of overlapping spans the first stays
        if span[0] >= last:
            out.append(span)
            last = span[1]
    return out


def _shaped(draws: Draws, text: str, extra: int = 0) -> str:
    """Letters for letters, digits for digits, then ``extra`` letters."""
    return "".join(draws.pick(LETTERS) if c.isalpha() else draws.pick("0123456789") if c.isdigit() else c for c in text + "a" * extra)


def surrogate(key: bytes, kind: str, canonical: str, attempt: int = 0, domain_attempt: int = 0) -> str:
    """Canonical surrogate of an entity; ``domain_attempt`` is the attempt of
    an address's domain."""
    draws = Draws(key, kind, canonical, attempt)
    more = "0" * max(0, attempt - GROW_AFTER)
    if kind == "domain":
        first, *labels = canonical.split(".")
        return ".".join([_shaped(draws, first, attempt), *(_shaped(draws, x) for x in labels[:-1]), *labels[-1:]])
    if kind == "email":
        local, _, domain = canonical.partition("@")
        return _shaped(draws, local, attempt) + "@" + surrogate(key, "domain", domain, domain_attempt)  # one domain, one surrogate
    if kind == "ip":
        return ".".join(str(1 + draws.below(223) if i == 0 else draws.below(256)) for i in range(4))
    if kind == "card":
        body = canonical[0] + _shaped(draws, canonical[1:-1])
        return next(body + d for d in "0123456789" if luhn(body + d))
    if kind == "phone":
        mark, _, digits = canonical.rpartition(":")
        kept = _kept_digits(digits, bool(mark))
        return mark + ":" * bool(mark) + digits[:kept] + str(2 + draws.below(8)) + _shaped(draws, digits[kept + 1:] + more)
    if kind == "number":
        while True:
            made = str(1 + draws.below(9)) + _shaped(draws, canonical[1:] + more)
            if not (13 <= len(made) <= 19 and luhn(made)):   # stays no card number
                return made
    gender, script, name = canonical.split(":", 2)
    if " " in name:
        return f"{gender}:{script}:" + " ".join(surrogate(key, kind, x, attempt).split(":", 2)[2] for x in parts(canonical))
    syllables, endings = SYLLABLES[script]
    if name.endswith("."):
        return f"{gender}:{script}:{draws.pick(syllables)[0]}."
    stem = "".join(draws.pick(syllables) for _ in range(2 + attempt))
    return f"{gender}:{script}:{stem}{draws.pick(endings[gender] + endings.get(gender + '+', []))}"


def dress(kind: str, mention: str, made: str) -> str:
    """The surrogate in the mention's format."""
    if kind in ("phone", "card", "number"):
        digits = iter(made.rpartition(":")[2])
        return "".join(next(digits) if c.isdigit() else c for c in mention) + "".join(digits)
    if kind == "name":
        words = iter(made.split(":", 2)[2].split(" "))
        return _PART.sub(lambda m: next(words).upper() if m.group().isupper() and len(m.group()) > 1 else next(words).capitalize(), mention)
    if kind == "email" and mention.isupper():
        return made.upper()
    return made


def replace(text: str, key: bytes, attempts: dict[tuple[str, str], tuple[int, int]] | None = None) -> tuple[str, dict[str, int]]:
    """Text with surrogates, and mentions per kind."""
    tries = lambda k, c: (attempts or {}).get((k, c), (0, 0))
    out, last, counts = [], 0, dict.fromkeys(KINDS, 0)
    for start, end, kind, canonical in find(text):
        if kind == "name":
            made = "::" + " ".join(surrogate(key, kind, x, *tries(kind, x)).split(":", 2)[2] for x in parts(canonical))
        else:
            made = surrogate(key, kind, canonical, *tries(kind, canonical))
        out += [text[last:start], dress(kind, text[start:end], made)]
        last = end
        counts[kind] += 1
    return "".join([*out, text[last:]]), counts


def entities_of(text: str) -> list[tuple[str, str]]:
    """Distinct entities (kind, canonical) of a text; names by their parts."""
    found = {m[2:] for m in find(text)}
    names = {("name", x) for kind, c in found if kind == "name" for x in parts(c) if not x.endswith(".")}
    return sorted({x for x in found if x[0] != "name"} | names)


def _mention_batches(batches):
    for b in batches:
        rows = [(f, r, k, c) for f, r, t in zip(*(b.column(x).to_pylist() for x in (*RID, "text"))) for k, c in entities_of(t)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string()))],
                                             names=[*RID, "kind", "canonical"])


_DRAWN = "kind string, canonical string, domain_attempt int, attempt int, made string"


def _draw_batches(key: bytes):
    def run(batches):
        for b in batches:
            cols = ("kind", "canonical", "domain_attempt", "attempt")
            made = [surrogate(key, k, c, a, d) for k, c, d, a in zip(*(b.column(x).to_pylist() for x in cols))]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in cols), pa.array(made, pa.string())], names=[*cols, "made"])
    return run


def _settle(entities: DataFrame, key: bytes) -> DataFrame:
    """Collision-free draws of distinct entities (kind, canonical,
    domain_attempt).  Names are compared as they are shown, without the gender
    and script before them."""
    shown = lambda c: F.substring_index(c, ":", -1)
    drawn = write_table(map_arrow(entities.withColumn("attempt", F.lit(0)), _draw_batches(key), _DRAWN), "pii-draws")
    originals = entities.select("kind", shown("canonical").alias("shown"), F.lit(True).alias("is_entity")).distinct()
    for _ in range(MOST_ROUNDS):
        drawn = drawn.withColumn("shown", shown("made"))
        owners = drawn.groupBy("kind", "shown").agg(F.min("canonical").alias("owner"), F.count("*").alias("n"))
        taken = owners.join(originals, ["kind", "shown"], "left").filter("n > 1 or is_entity").select(
            "kind", "shown", F.when(F.col("is_entity"), F.lit(None)).otherwise(F.col("owner")).alias("owner"), F.lit(True).alias("taken"))
        marked = drawn.join(taken, ["kind", "shown"], "left").withColumn("again", F.coalesce("taken", F.lit(False)) & ~F.col("canonical").eqNullSafe(F.col("owner")))
        marked = write_table(marked.select("kind", "canonical", "domain_attempt", "attempt", "made", "again"), "pii-draws")
        if marked.filter("again").isEmpty():
            return marked.drop("again")
        redrawn = map_arrow(marked.filter("again").select("kind", "canonical", "domain_attempt", (F.col("attempt") + 1).cast("int").alias("attempt")),
                            _draw_batches(key), _DRAWN)
        drawn = write_table(marked.filter("not again").drop("again").unionByName(redrawn), "pii-draws")
    kinds = sorted(r["kind"] for r in marked.filter("again").select("kind").distinct().collect())
    raise RuntimeError(f"no free surrogates left for: {', '.join(kinds)}")


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """Collision-free draws (kind, canonical, domain_attempt, attempt, made)
    of distinct entities (kind, canonical)."""
    entities = write_table(entities.select("kind", "canonical"), "pii-entities")
    domain = F.substring_index("canonical", "@", -1)
    emails, none = entities.filter("kind = 'email'"), F.lit(0).alias("domain_attempt")
    domains = write_table(emails.select(F.lit("domain").alias("kind"), domain.alias("canonical"), none).distinct(), "pii-domains")
    moved = _settle(domains, key).filter("attempt > 0").select(F.col("canonical").alias("domain"), F.col("attempt").alias("domain_attempt"))
    emails = emails.withColumn("domain", domain).join(sized(moved), "domain", "left").select("kind", "canonical", F.coalesce("domain_attempt", F.lit(0)).alias("domain_attempt"))
    return _settle(write_table(entities.filter("kind <> 'email'").select("kind", "canonical", none).unionByName(emails), "pii-entities"), key)


def _replace_batches(key: bytes):
    def run(batches):
        for b in batches:
            rows = []
            for text, attempts in zip(b.column("text").to_pylist(), b.column("attempts").to_pylist()):
                made, counts = replace(text, key, {(a["kind"], a["canonical"]): (a["attempt"], a["domain_attempt"]) for a in attempts or []})
                rows.append((*counts.values(), sum(counts.values()), made, hashlib.sha256(made.encode()).hexdigest()))
            types = [pa.int64()] * (len(KINDS) + 1) + [pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, t) for x, t in zip(zip(*rows), types))],
                                             names=["doc_id", *[f"n_{k}" for k in KINDS], "n_entities", "text", "text_sha256"])
    return run


def surrogates(docs: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """One row per document: doc_id, mentions per kind, n_entities, text with
    surrogates and its SHA-256.

    Defined cases: null and empty texts stay empty; texts of any length are
    read whole; a text without entities is unchanged; repeated rows get equal
    texts; a null doc_id stays null; other columns are ignored; an empty table
    gives an empty result."""
    rows = with_row_id(docs, ["doc_id", "text"]).select(*RID, F.col("doc_id").cast("bigint").alias("doc_id"),
                                                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    mentions = write_table(map_arrow(rows.select(*RID, "text"), _mention_batches, f"{RID[0]} bigint, {RID[1]} bigint, kind string, canonical string"), "pii-mentions")
    drawn = assign(mentions.select("kind", "canonical").distinct(), key)
    later = mentions.join(drawn.filter("attempt > 0 or domain_attempt > 0").select("kind", "canonical", "attempt", "domain_attempt"), ["kind", "canonical"])
    later = write_table(later.groupBy(*RID).agg(F.collect_list(F.struct("kind", "canonical", "attempt", "domain_attempt")).alias("attempts")), "pii-later")
    joined = rows.join(sized(later), RID, "left").select("doc_id", "text", "attempts")
    schema = "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", n_entities bigint, text string, text_sha256 string"
    return map_arrow(joined, _replace_batches(key), schema)
