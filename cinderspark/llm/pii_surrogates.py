"""Operator 1: personal data replaced by keyed, type-consistent surrogates.

Detected are e-mail addresses, telephone numbers, payment card numbers, IBANs,
national numbers (ddd-dd-dddd), IPv4 addresses, and person names: a known given
name or an honorific and the capitalised words after it, and two or three
capitalised words of no known name beside a word that goes with persons (CUES:
"met", "said", "dear"), or joined by "and" to a name so found.

Distinctness: numbers and addresses go through a keyed permutation of the
strings of their own format (a Feistel network over mixed radices), so two
entities of a kind never share a surrogate, without any shared state.  Kept are
the country code of a telephone number or IBAN, check digits' validity (Luhn,
mod 97), an address's top-level domain, letter case and all punctuation.  A known
given name becomes one of the same gender and script; other names are spelt from
syllables, or where there are none, from letters, of their own script, and keep
the ending that marks them as a woman's or a man's.

Collision checks: all distinct entities of the input are gathered; where a
surrogate equals an entity that really occurs, or another's surrogate, or its
own entity, the tweak is raised until none does.  Those few exceptions are
broadcast if at most MOST_BROADCAST, and joined to their rows otherwise.
Coreference: a surrogate depends on the canonical entity alone (digits of a
number, lower-case letters, a family name's masculine form), so every mention
gets the same one, in the form in which it is written.

Null text stays null and has no entities; empty text stays empty.  Repeated rows
are repeated in the result, whose rows need no id to tell them apart.  The result
has the id, the text and its entities; other columns are left out.  An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_maps import map_texts
from .runtime import delete_path, scratch_path, staged

#: Exceptions that are broadcast, at most (some 100 bytes each).
MOST_BROADCAST = 100_000
ROUNDS = 10
KINDS = ("email", "phone", "card", "iban", "national", "ip", "given", "forename", "surname")

# Given names by script and gender, and syllables to spell surnames from.
GIVEN = {
    ("latin", "f"): """Alice Amelia Andrea Anna Anne Barbara Beatriz Camille Carla Carmen Caroline Catherine Charlotte Chloe
        Claire Claudia Clara Diana Dolores Elena Elisabeth Elizabeth Emily Emma Eva Fatima Frieda Gabriela Hannah Heidi Helen
        Helga Ingrid Irene Isabel Jane Jennifer Jessica Johanna Julia Juliette Karen Katharina Laura Lena Linda Lucia Lucie
        Manon Margaret Maria Marie Marta Martha Mary Mathilde Monika Nancy Natalie Nicole Olivia Patricia Paula Petra Pilar
        Rachel Rebecca Rosa Ruth Sabine Sarah Silvia Sofia Sophie Stefanie Susan Teresa Ursula Victoria""",
    ("latin", "m"): """Adam Alan Alberto Alexander Andrew Anthony Antoine Antonio Bernd Brian Carlos Charles Christian Christopher
        Daniel David Diego Edward Emil Enrique Eric Ernst Felipe Felix Fernando Frank Franz Frederic Friedrich George Gerhard
        Hans Heinrich Henri Henry Hugo Jacques James Javier Jean Johann John Jorge Joseph Juan Julien Karl Kevin Klaus Laurent
        Louis Lucas Luis Manuel Mark Markus Martin Matthew Michael Michel Miguel Nicolas Olivier Oscar Otto Pablo Patrick Paul
        Pedro Peter Philippe Pierre Rafael Richard Robert Roberto Stefan Stephen Steven Thomas Walter William Wolfgang""",
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия Галина Людмила Дарья Полина Вера Надежда",
    ("cyrillic", "m"): "Иван Сергей Алексей Дмитрий Андрей Михаил Николай Владимир Павел Борис Виктор Олег Игорь Юрий Максим Роман",
    ("greek", "f"): "Μαρία Ελένη Αικατερίνη Βασιλική Σοφία Αγγελική Γεωργία Δήμητρα",
    ("greek", "m"): "Γεώργιος Δημήτριος Κωνσταντίνος Ιωάννης Νικόλαος Χρήστος Παναγιώτης Βασίλειος",
}
SYLLABLES = {
    "latin": "ba be bi bo da de do fa fe fi ga ge go ha he ho ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe pi po ra re ri ro sa se si so ta te ti to va ve vi vo wa we za zo".split(),
    "cyrillic": "ба бе бо ва ве во га го да де до за зо ка ке ко ла ле ли ло ма ме ми мо на не ни но па по ра ре ри ро са се со та те ти то".split(),
    "greek": "βα βε βο γα γε γο δα δε δο κα κε κο λα λε λι λο μα με μι μο να νε νι νο πα πε πο ρα ρε ρι ρο σα σε σο τα τε τι το".split(),
}
SURNAME_ENDS = {"cyrillic": ("ов", "ова"), "greek": ("ης", "η")}
#: Endings of a man's and a woman's form of one family name.
FORMS = (("ов", "ова"), ("ев", "ева"), ("ин", "ина"), ("ий", "ая"), ("ov", "ova"), ("ev", "eva"), ("ski", "ska"), ("ský", "ská"))
HONORIFICS = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Sir": "m", "Madam": "f", "Herr": "m", "Frau": "f", "Monsieur": "m",
    "Madame": "f", "Mme": "f", "Mlle": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Don": "m", "Doña": "f",
    "Dr": "", "Prof": "", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f",
}
#: Words that stand right before or after a person's name; words that start no name; words that join names.
CUES_BEFORE = frozenset(
    """met meets named dear contact colleague colleagues friend friends husband wife brother sister mother father son daughter
    uncle aunt nurse president chancellor minister judge captain author patient client attorney engineer professor doctor
    teacher neighbour neighbor sincerely regards name is rencontré nommé nommée appelé appelée cher chère appelle madame
    monsieur traf namens heißt heisst liebe lieber namen conoció llamado llamada llama querido querida señor señora""".split()
)
CUES_AFTER = frozenset(
    """met meets said says wrote writes asked told replied answered lives lived works worked lived thinks smiled laughed called
    phoned emailed habite habitait écrit écrivit née né répondit sagte sagt schrieb wohnt wohnte geboren traf antwortete dijo
    dice escribió vive vivía nació respondió""".split()
)
NO_NAMES = frozenset(
    """the a an this that these those he she it they we you i his her its their our your my and or but if when then there here
    what who where why how yes no not new north south east west upper lower great saint san santa los las el la le les un une
    der die das ein eine und oder in on at of for from with by to as is was are were has had after before yesterday today
    tomorrow later once mr mrs ms monday tuesday wednesday thursday friday saturday sunday january february march april may
    june july august september october november december united public general license university street avenue road""".split()
)
JOINERS = frozenset([" and ", ", ", ", and ", " et ", " und ", " y ", " e "])
_GENDERS = {name: (script, gender) for (script, gender), names in GIVEN.items() for name in names.split()}

_LOCAL = re.compile(r"[\w.%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}")
_NUMERIC = re.compile(
    r"(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9]))"
    r"|(?P<phone>(?<![\d+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\d+])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?!\d|[.-]\d))"
    r"|(?P<card>(?<!\d)(?<!\d\.)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{5})(?!\d))"
    r"|(?P<national>(?<![\d-])\d{3}-\d{2}-\d{4}(?!\d|-\d))"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d))"
)
_DIGITS = re.compile(r"\d")
_CAPITALISED = re.compile(r"\b[^\W\d_a-zß-öø-ÿа-яёα-ω][^\W\d_]*(?:['’-][^\W\d_]+)*")


def _email_spans(text: str) -> Iterator[tuple[int, int]]:
    at, done = text.find("@"), 0
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        local = _LOCAL.search(text[max(done, at - 64) : at])
        if domain and local:
            name = local[0].lstrip(".-")
            if name:
                done = domain.end()
                yield at - len(name), done
        at = text.find("@", at + 1)


def find_entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, gender) of the entities, in order, not overlapping."""
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        found += [(s, e, "email", "") for s, e in _email_spans(text)]
    if _DIGITS.search(text):
        found += [(m.start(), m.end(), m.lastgroup or "", "") for m in _NUMERIC.finditer(text)]
    found += _name_spans(text)
    found.sort(key=lambda f: (f[0], -f[1]))
    out: list[tuple[int, int, str, str]] = []
    for f in found:
        if not out or f[0] >= out[-1][1]:
            out.append(f)
    return out


_WORD_BEFORE = re.compile(r"([^\W\d_]+)[:,]?\s+\Z")
_WORD_AFTER = re.compile(r"\s+([^\W\d_]+)")


def _name_spans(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Given names, and up to two capitalised words after a given name or an honorific; names that their context tells.

    A full stop stands only between an honorific or an initial and what follows.
    """
    end, gender, rest, short = -1, "", 0, False
    chain: list[re.Match] = []  # capitalised words of no known name, a space apart
    told = -1  # where a name found by context ends
    for m in _CAPITALISED.finditer(text):
        word = m[0]
        if word[0].islower():
            continue
        between = text[end : m.start()] if rest else ""
        follows = bool(rest) and (between == " " or (short and between == ". "))
        titled = word.capitalize() if word.isupper() else word
        if word in HONORIFICS:
            gender, rest, short = HONORIFICS[word], 2, True
        elif titled in _GENDERS:
            gender, rest, short = _GENDERS[titled][1], 2, False
            yield m.start(), m.end(), "given", gender
        elif follows:
            short = len(word) == 1
            if not short:
                rest -= 1
                yield m.start(), m.start() + _name_length(word), "surname", gender
        else:
            rest = 0
            if chain and text[chain[-1].end() : m.start()] == " ":
                chain.append(m)
            else:
                found = _by_context(text, chain, told)
                yield from found
                told = found[-1][1] if found else told
                chain = [m]
        end = m.end()
    yield from _by_context(text, chain, told)


def _name_length(word: str) -> int:
    """Letters of a word that are a name: scripts without spaces run on after one."""
    return 3 if len(word) > 4 and script_of(word) in ("cjk", "hiragana", "katakana") else len(word)


def _by_context(text: str, chain: list[re.Match], told: int) -> list[tuple[int, int, str, str]]:
    """The name that a chain of capitalised words is, if its context says so: a person's cue, or a name before it."""
    opened = False  # by a cue that starts the sentence
    while chain and (chain[0][0].lower() in NO_NAMES or chain[0][0].lower() in CUES_BEFORE):
        opened = chain[0][0].lower() in CUES_BEFORE
        chain = chain[1:]
    words = [m[0] for m in chain]
    if not 2 <= len(words) <= 3 or len(set(words)) < len(words):
        return []
    if any(len(w) < 2 or w.isupper() or w.lower() in NO_NAMES for w in words):
        return []
    s, e = chain[0].start(), chain[-1].end()
    before, after = _WORD_BEFORE.search(text[max(0, s - 40) : s]), _WORD_AFTER.match(text[e : e + 40])
    cued = opened or before and before[1].lower() in CUES_BEFORE or after and after[1] in CUES_AFTER
    if not cued and not (0 <= told < s and text[told:s] in JOINERS):
        return []
    return [(m.start(), m.end(), "surname" if k else "forename", "") for k, m in enumerate(chain)]


# --- keyed permutation -----------------------------------------------------
def permute(value: int, domain: int, key: bytes, label: str) -> int:
    """A keyed bijection of range(domain): a Feistel network on enough bits, walked until inside."""
    if domain <= 1:
        return 0
    half = max(1, ((domain - 1).bit_length() + 1) // 2)
    mask, size = (1 << half) - 1, (half + 7) // 8
    tag = label.encode()
    while True:
        left, right = value >> half, value & mask
        for r in range(ROUNDS):
            out = b""
            block = 0
            while len(out) < size:
                seed = b"%d|%d|%d|" % (r, block, half) + tag + b"|" + right.to_bytes(size, "big")
                out += hashlib.blake2b(seed, key=key).digest()
                block += 1
            left, right = right, left ^ (int.from_bytes(out[:size], "big") & mask)
        value = left << half | right
        if value < domain:
            return value


_CLASSES = ((0x30, 10), (0x61, 26), (0x41, 26))


def permute_format(text: str, key: bytes, label: str) -> str:
    """A keyed bijection of the strings with this one's format: digits, and lower and upper case letters, in their places."""
    digits, radices, shape = [], [], []
    for c in text:
        base = next(((b, n) for b, n in _CLASSES if b <= ord(c) < b + n), None)
        shape.append(base[0] if base else c)
        if base:
            digits.append(ord(c) - base[0])
            radices.append(base[1])
    value, domain = 0, 1
    for d, n in zip(digits, radices):
        value, domain = value * n + d, domain * n
    form = "".join("9" if s == 0x30 else "a" if s == 0x61 else "A" if s == 0x41 else str(s) for s in shape)
    value = permute(value, domain, key, f"{label}|{form}")
    out = []
    for n in reversed(radices):
        value, d = divmod(value, n)
        out.append(d)
    fill = iter(reversed(out))
    return "".join(s if isinstance(s, str) else chr(s + next(fill)) for s in shape)


def _luhn(digits: str) -> int:
    """The check digit that goes after the digits."""
    total = sum(int(d) if k % 2 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))
    return -total % 10


def _mod97(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


@lru_cache(maxsize=4)
def _given_cycles(key: bytes) -> dict[str, str]:
    """Each given name's surrogate: the names of a script and gender stand in a keyed circle, and each becomes
    the next, so no two become the same and none stays."""
    out = {}
    for group in GIVEN.values():
        circle = sorted(group.split(), key=lambda n: hashlib.blake2b(n.encode(), key=key).digest())
        out.update(zip(circle, circle[1:] + circle[:1]))
    return out


@lru_cache(maxsize=4096)
def _script(c: str) -> str:
    return unicodedata.name(c, "none").split(" ")[0].split("-")[0].lower()


def script_of(word: str) -> str:
    """The script of a word's first letter, as its name has it: latin, cyrillic, greek, cjk, hangul, arabic, ..."""
    return _script(word[:1])


@lru_cache(maxsize=4096)
def _letters_like(c: str) -> str:
    """Letters of one kind and script with this one: of its block of 128, or of its whole range where that is larger."""
    for low, high in ((0x4E00, 0x9FA5), (0xAC00, 0xD7A3)):
        if low <= ord(c) <= high:
            return "".join(map(chr, range(low, high + 1)))
    block = ord(c) & ~0x7F
    kind, script = unicodedata.category(c), _script(c)
    return "".join(x for x in map(chr, range(block, block + 128)) if unicodedata.category(x) == kind and _script(x) == script)


def form_of(name: str) -> tuple[str, str, bool] | None:
    """A family name's endings, a man's and a woman's, and whether it has the latter; None if it has neither."""
    for man, woman in FORMS:
        if name.endswith(woman) and len(name) > len(woman) + 1:
            return man, woman, True
        if name.endswith(man) and len(name) > len(man) + 1:
            return man, woman, False
    return None


def canonical(kind: str, mention: str, gender: str) -> str:
    """What a mention refers to, whatever its form; a surname's carries no gender."""
    if kind in ("phone", "card", "national"):
        return ("+" if mention.startswith("+") else "") + "".join(filter(str.isdigit, mention))
    if kind == "iban":
        return mention.replace(" ", "")
    if kind == "email":
        return mention.lower()
    if kind in ("given", "forename", "surname"):
        name = mention.capitalize() if mention.isupper() else mention
        form = form_of(name) if kind == "surname" else None
        # a woman's form refers to the family that the man's does
        return name[: -len(form[1])] + form[0] if form and form[2] else name
    return mention


def surrogate(kind: str, entity: str, key: bytes, tweak: int = 0) -> str:
    """The surrogate of a canonical entity, itself canonical."""
    label = f"{kind}|{tweak}"
    if kind == "email":
        body, _, top = entity.rpartition(".")
        return permute_format(body, key, label) + "." + top
    if kind == "phone":
        code = len(entity) - 10 if entity.startswith("+") and len(entity) > 10 else 0
        return entity[:code] + permute_format(entity[code:], key, label)
    if kind == "card":
        offset = (int(entity[-1]) - _luhn(entity[:-1])) % 10
        body = entity[0] + permute_format(entity[1:-1], key, f"{label}|{entity[0]}|{offset}")
        return body + str((_luhn(body) + offset) % 10)
    if kind == "iban":
        offset = (int(entity[2:4]) - _mod97(entity[:2], entity[4:])) % 100
        body = permute_format(entity[4:], key, f"{label}|{entity[:2]}|{offset}")
        return entity[:2] + f"{(_mod97(entity[:2], body) + offset) % 100:02d}" + body
    if kind == "ip":
        value = 0
        for part in entity.split("."):
            value = value * 256 + int(part)
        value = permute(value, 1 << 32, key, label)
        return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))
    if kind == "given":
        return _given_cycles(key)[entity]
    if kind in ("forename", "surname"):
        return _spelt(entity, hashlib.blake2b(f"{label}|{entity}".encode(), key=key).digest(), kind == "surname")
    return permute_format(entity, key, label)


def _spelt(entity: str, seed: bytes, family: bool) -> str:
    """A name of an entity's script, drawn by the seed; a family name gets a man's ending of its kind."""
    value = int.from_bytes(seed, "big")
    script, out = script_of(entity), ""
    if script not in SYLLABLES:
        for c in entity[:24]:
            letters = _letters_like(c) if c.isalpha() else c
            value, k = divmod(value, len(letters))
            out += letters[k]
        return out
    for _ in range(min(6, max(3, len(entity) // 2))):
        value, k = divmod(value, len(SYLLABLES[script]))
        out += SYLLABLES[script][k]
    form = form_of(entity)
    return out.capitalize() + (form[0] if form else SURNAME_ENDS.get(script, ("",))[0] if family else "")


def render(kind: str, mention: str, new: str, gender: str) -> str:
    """A canonical surrogate in the form of a mention."""
    if kind in ("phone", "card", "national"):
        digits = filter(str.isdigit, new)
        return "".join(next(digits) if c.isdigit() else c for c in mention)
    if kind == "iban":
        chars = iter(new)
        return "".join(c if c == " " else next(chars) for c in mention)
    if kind == "email":
        return "".join(n.upper() if m.isupper() else n for m, n in zip(mention, new))
    upper = mention.isupper() and len(mention) > 1
    if kind == "surname":
        form = form_of(mention.capitalize() if upper else mention)
        if form[2] if form else gender == "f":
            ends = next(((m, w) for m, w in (*FORMS, *SURNAME_ENDS.values()) if new.endswith(m)), ("", ""))
            new = new[: len(new) - len(ends[0])] + ends[1]
    return new.upper() if upper and kind in ("given", "forename", "surname") else new


class Replacer:
    """Rewrites texts; keeps the surrogates that it has met."""

    def __init__(self, key: bytes, tweaks: dict[tuple[str, str], int]):
        self.key, self.tweaks = key, tweaks
        self.known: dict[tuple[str, str], str] = {}

    def rewrite(self, text: str, own: dict[tuple[str, str], int]) -> tuple[str, list[dict]]:
        entities = find_entities(text)
        if not entities:
            return text, []
        out, spans, at, size = [], [], 0, 0
        for s, e, kind, gender in entities:
            mention = text[s:e]
            name = (kind, canonical(kind, mention, gender))
            if name in own:
                new = surrogate(*name, self.key, own[name])
            else:
                new = self.known.get(name)
                if new is None:
                    if len(self.known) > 100_000:
                        self.known = {}
                    new = self.known[name] = surrogate(*name, self.key, self.tweaks.get(name, 0))
            shown = render(kind, mention, new, gender)
            out += [text[at:s], shown]
            size += s - at
            spans.append({"kind": kind, "start": s, "end": e, "new_start": size, "surrogate": shown})
            size += len(shown)
            at = e
        out.append(text[at:])
        return "".join(out), spans


def distinct_entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, entity) of all texts."""

    def work(batch: pa.RecordBatch, texts: list[str]) -> dict:
        seen = {(k, canonical(k, t[s:e], g)) for t in texts for s, e, k, g in find_entities(t)}
        return {"kind": pa.array([k for k, _ in seen], pa.string()), "entity": pa.array([x for _, x in seen], pa.string())}

    return map_texts(docs.select(F.col(text_col).alias("_text")), "_text", "kind string, entity string", work).distinct()


def exceptions(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, tweak) of the entities whose first surrogate collides.

    A surrogate must not be an entity of its kind, nor another's surrogate (of
    two, the larger entity moves).  Given names need no check: they form closed
    lists, each a circle in which every name becomes the next.
    """
    spark = entities.sparkSession

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, names, tweaks = b.column("kind").to_pylist(), b.column("entity").to_pylist(), b.column("tweak").to_pylist()
            made = [surrogate(k, n, key, t) for k, n, t in zip(kinds, names, tweaks)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(made, pa.string())], names=["kind", "entity", "tweak", "made"])

    schema = "kind string, entity string, tweak int, made string"
    real = entities.where("kind != 'given'").select("kind", F.col("entity").alias("made"), F.lit(True).alias("real"))
    state = entities.withColumn("tweak", F.lit(0)).mapInArrow(spelt, schema)
    path = None
    while True:
        new = scratch_path(spark, "op1-surrogates")
        state.write.parquet(new)
        current = spark.read.schema(schema).parquet(new)
        if path:
            delete_path(spark, path)
        path = new
        first = current.where("kind != 'given'").groupBy("kind", "made").agg(F.min("entity").alias("first"), F.count(F.lit(1)).alias("n"))
        shared = first.where("n > 1").select("kind", "made", "first")
        judged = current.join(real, ["kind", "made"], "left").join(shared, ["kind", "made"], "left")
        clash = F.coalesce("real", F.lit(False)) | F.coalesce(F.col("first") != F.col("entity"), F.lit(False))
        judged = judged.select("kind", "entity", "tweak", clash.alias("clash"))
        if not judged.where("clash").limit(1).count():
            return current.where("tweak > 0").select("kind", "entity", "tweak")
        state = judged.select("kind", "entity", (F.col("tweak") + F.col("clash").cast("int")).alias("tweak")).mapInArrow(spelt, schema)


RESULT = "text string, entities array<struct<kind:string,start:int,end:int,new_start:int,surrogate:string>>"
_KIND = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("new_start", pa.int32()), ("surrogate", pa.string())])
)


def replace_entities(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``text`` with surrogates, ``entities`` (kind, place before and after, surrogate: never the original)."""
    entities = staged(distinct_entities(docs, text_col), "op1-entities")
    moved = staged(exceptions(entities, key), "op1-exceptions")
    text = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    tweaks: dict[tuple[str, str], int] = {}
    if moved.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        tweaks = {(r.kind, r.entity): r.tweak for r in moved.collect()}
        text = text.withColumn("_own", F.lit(None).cast("array<struct<kind:string,entity:string,tweak:int>>"))
    else:
        text = _with_own_tweaks(text, moved)
    spread = docs.sparkSession.sparkContext.broadcast(tweaks)

    def work(batch: pa.RecordBatch, texts: list[str]) -> dict:
        replacer = Replacer(key, spread.value)
        real = batch.column("_text").to_pylist()  # a null stays one
        own = [{(o["kind"], o["entity"]): o["tweak"] for o in x or ()} for x in batch.column("_own").to_pylist()]
        made = [(None, []) if t is None else replacer.rewrite(t, o) for t, o in zip(real, own)]
        return {
            "_id": batch.column("_id"),
            "text": pa.array([t for t, _ in made], pa.string()),
            "entities": pa.array([e for _, e in made], _KIND),
        }

    kind = dict(docs.dtypes)[id_col]
    return map_texts(text, "_text", f"_id {kind}, {RESULT}", work).withColumnRenamed("_id", id_col)


def _with_own_tweaks(text: DataFrame, moved: DataFrame) -> DataFrame:
    """The exceptions that a row needs, brought to it by joins on a number that the row is written with."""
    text = staged(text.withColumn("_row", F.monotonically_increasing_id()), "op1-rows")

    def work(batch: pa.RecordBatch, texts: list[str]) -> dict:
        rows = [(i, n) for i, t in zip(batch.column("_row").to_pylist(), texts) for n in {(k, canonical(k, t[s:e], g)) for s, e, k, g in find_entities(t)}]
        return {
            "_row": pa.array([i for i, _ in rows], pa.int64()),
            "kind": pa.array([k for _, (k, _) in rows], pa.string()),
            "entity": pa.array([n for _, (_, n) in rows], pa.string()),
        }

    mentions = map_texts(text.select("_row", "_text"), "_text", "_row long, kind string, entity string", work)
    own = mentions.join(moved, ["kind", "entity"]).groupBy("_row").agg(F.collect_set(F.struct("kind", "entity", "tweak")).alias("_own"))
    return text.join(own, "_row", "left").drop("_row")
