"""Personal data: detection and surrogate generation.

Detected entities (e-mail addresses, phone and card numbers, IBANs, social security numbers,
IP addresses of both versions, credentials, names after a title or "my name is" or beginning with a
common given name) give
way to keyed surrogates of the same type and format: digits stay digits, letters keep their
case and script, separators and fixed parts (country code, key prefix, the form of an
address) stay, card numbers pass the Luhn check as before, given names keep the gender that
their title or the list of given names tells.

A name is replaced word by word, so "Mr Paul Smith", "Mr Smith" and, later in the same text,
"Smith" or "Paul" alone get the same words, unless what stands beside them tells a thing: an article
before, a number or a capitalised word that is in no name of the text behind. A number of the North American plan is the same
with and without its country code. The surrogate depends on the key, the type and the
canonical form alone, so every mention in the corpus gets the same one (coreference).

Distinctness is checked over the whole corpus: entities whose surrogates collide with
another's, or with any original, try the next surrogate until none collides; the least one
of a collision keeps its own. After every WIDER attempts the surrogate gets one character
longer, so that formats with few possible values (a name of two letters) can't run out.
Few entities ever move: their table is broadcast below a checked size, and joined to the
documents beyond it.

Defined cases: a null text stays null, without entities; overlapping matches go to the
type named first in TYPES; a credential without any letter or digit is none; letters of
any script become letters of the same Unicode block, marks stay; repeated rows are treated
alike; an empty table gives no rows; further columns are ignored. Detection takes time in
proportion to the text.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._common import load, materialize, pick, release, slices

KEY = b"palimpsest surrogate key"
#: Attempts after which a surrogate may be one character longer.
WIDER = 8
TITLES = {
    "Mr": "m", "Mr.": "m", "Herr": "m", "Sr.": "m", "Señor": "m", "M.": "m", "Monsieur": "m", "Don": "m", "Signor": "m", "Господин": "m",
    "Mrs": "f", "Mrs.": "f", "Ms": "f", "Ms.": "f", "Miss": "f", "Frau": "f", "Mme": "f", "Madame": "f", "Mlle": "f", "Sra.": "f", "Señora": "f", "Doña": "f", "Signora": "f", "Госпожа": "f",
    "Dr.": "", "Prof.": "", "MR.": "m", "MRS.": "f", "MS.": "f", "DR.": "", "PROF.": "",
    "My name is": "", "my name is": "", "Ich heiße": "", "ich heiße": "", "Me llamo": "", "me llamo": "", "Je m'appelle": "", "je m'appelle": "", "Mi chiamo": "", "mi chiamo": "",
}
GIVEN = {
    "f": "Anna Maria Julia Clara Emma Laura Sofia Elena Nora Alice Helen Irene Lucia Paula Marta Celia Greta Ingrid Odette Yvonne".split(),
    "m": "Peter Paul Martin Thomas Hugo Oscar Felix Bruno Simon Victor Daniel Jonas Emil Andre Pablo Diego Walter Henry Louis Rene".split(),
}
GENDER = {name: g for g, names in GIVEN.items() for name in names}


def _marks() -> str:
    """Ranges of the combining marks of the basic plane, for a class of a pattern."""
    marks = [c for c in range(0x300, 0x10000) if unicodedata.category(chr(c))[0] == "M"]
    starts = [c for i, c in enumerate(marks) if not i or marks[i - 1] != c - 1]
    ends = [c for i, c in enumerate(marks) if i + 1 == len(marks) or marks[i + 1] != c + 1]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends))


_LOW = rf"(?:[^\W\d_A-Z]|[{_marks()}])"
_NAME = rf"[^\W\d_a-z]{_LOW}+(?:-[^\W\d_a-z]{_LOW}+)?"
_TITLE = "(?:" + "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True)) + r")\s+"
_HEX = r"[0-9A-Fa-f]{1,4}"
#: Words before a capitalised word that tell a thing rather than a person (fixed values).
ARTICLES = frozenset("the a an der die das den dem ein eine el los las un una le les une il lo gli".split())
#: Types with their patterns, in order of precedence; the group e is the entity where there is one.
TYPES = (
    ("email", r"(?<![\w.+%-])[\w.+%-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("secret", r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s*[:=]\s*[\"']?(?P<e>(?=[+/_=.~-]*[A-Za-z0-9])[A-Za-z0-9+/_=.~-]{8,})"),
    ("key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{20,}|\bsk-[A-Za-z0-9-]{20,}|\bxox[abprs]-[A-Za-z0-9-]{10,}|\b(?=[0-9A-Fa-f]*\d)(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{32,}\b"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ipv6", rf"(?<![\w:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[0-9A-Fa-f]*\d)[0-9A-Fa-f]{{3,4}}(?::{_HEX}){{0,5}}::(?:{_HEX}(?::{_HEX}){{0,5}})?)(?![\w:])"),
    ("ip", r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d]|\.\d)"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("card", r"(?<![\d-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?!\d)"),
    ("phone", r"(?<![\w.])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){5,12}(?!\w)|(?<![\w.(])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)"),
    ("name", rf"(?<!\w){_TITLE}{_NAME}(?: {_NAME}){{0,2}}|(?<!\w)(?:MRS?|MS|DR|PROF)\.\s+[A-Z]{{2,}}(?!\w)|(?<!\w)(?:{'|'.join(sorted(GENDER))})(?: {_NAME}){{1,2}}"),
)
_PATTERNS = [(kind, re.compile(p)) for kind, p in TYPES]
_TITLED = re.compile(_TITLE)
_WORD = re.compile(_NAME)
#: What a text must hold for a type to be looked for; a type that isn't here is always looked for.
_DIGIT = re.compile(r"\d")
_HINTS = {
    "email": re.compile("@"),
    "ipv6": re.compile(":"),
    "secret": re.compile(r"(?i:password|passwd|pwd|secret|token|key)"),
    **{kind: _DIGIT for kind in ("iban", "ip", "ssn", "card", "phone")},
    "name": re.compile("|".join(map(re.escape, [*TITLES, *GENDER]))),
}
VOWELS, CONSONANTS = "aeiou", "bcdfghjklmnprstvwz"


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


Unit = tuple[str, str]


def _found_spans(text: str) -> list[tuple[int, int, str]]:
    found: list[tuple[int, int, str]] = []
    for kind, pattern in _PATTERNS:
        hint = _HINTS.get(kind)
        if hint and not hint.search(text):
            continue
        group = "e" if "e" in pattern.groupindex else 0
        hits = [m.span(group) for m in pattern.finditer(text)]
        if hits:  # what is found is blanked, so that a later type can't reach into it
            parts, at = [], 0
            for a, b in hits:
                found.append((a, b, kind))
                parts += [text[at:a], "\0" * (b - a)]
                at = b
            text = "".join([*parts, text[at:]])
    return found


def detect(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, type) of the entities of a text, in order, without overlaps."""
    return [m[:3] for m in mentions(text)]


def mentions(text: str) -> list[tuple[int, int, str, list[Unit]]]:
    """Spans with their units: what is replaced, by type and canonical form. Words of a name that is
    found count as mentions wherever else they stand as a word of the text and nothing beside them
    tells a thing (see _person)."""
    found = [(a, b, kind, units(kind, text[a:b])) for a, b, kind in _found_spans(text)]
    known = {u[1]: u for _, _, kind, us in sorted(found) if kind == "name" for u in us if len(u[1]) > 1}
    if known:
        busy = sorted((a, b) for a, b, _, _ in found)
        i = 0
        for m in _WORD.finditer(text):
            while i < len(busy) and busy[i][1] <= m.start():
                i += 1
            if m[0] in known and (i == len(busy) or m.end() <= busy[i][0]) and _alone(text, *m.span()) and _person(text, *m.span(), known):
                found.append((*m.span(), "name", [known[m[0]]]))
    return sorted(found)


def _alone(text: str, a: int, b: int) -> bool:
    """Whether text[a:b] is a whole word."""
    return not (a and (text[a - 1].isalnum() or text[a - 1] == "_")) and not (b < len(text) and (text[b].isalnum() or text[b] == "_"))


_BEFORE, _AFTER = re.compile(r"(\w+) $"), re.compile(rf" (?:\d|({_NAME})(?!\w))")


def _person(text: str, a: int, b: int, known: dict[str, Unit]) -> bool:
    """Whether a name's word at text[a:b] may stand for its person: not after an article ("the White House"), nor before
    a number ("May 2020") or a capitalised word that is in no name of the text ("Ford Museum")."""
    before, after = _BEFORE.search(text, max(0, a - 16), a), _AFTER.match(text, b)
    return not (before and before[1].lower() in ARTICLES) and not (after and (after[1] is None or after[1] not in known))


def units(kind: str, entity: str) -> list[Unit]:
    """The words of a name, each with its part in it and, for a given name, the gender; else the entity itself."""
    if kind != "name":
        return [(kind, canonical(kind, entity))]
    title = _TITLED.match(entity)
    gender = TITLES[title[0].strip()] if title else ""
    *given, last = entity[title.end() if title else 0 :].split(" ")
    out = [(f"given{GENDER.get(w, gender)}", w) for w in given]
    return [*out, (f"given{GENDER[last]}", last) if last in GENDER and not given else ("surname", last)]


def canonical(kind: str, entity: str) -> str:
    """What mentions of one entity have in common."""
    if kind == "phone":
        digits = "".join(c for c in entity if c.isdigit())
        return digits[1:] if entity[0] == "+" and len(digits) == 11 and digits[0] == "1" else digits
    if kind in ("card", "ssn", "iban"):
        return "".join(c for c in entity if c.isalnum())
    if kind in ("email", "ipv6"):
        return entity.lower()
    return entity


class _Stream:
    """Keyed bytes for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, form: str, attempt: int):
        self.seed, self.n, self.left = hmac.new(key, f"{kind}\0{form}\0{attempt}".encode(), hashlib.sha256), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            h = self.seed.copy()
            h.update(self.n.to_bytes(4, "little"))
            self.n += 1
            self.left = h.digest()
        x, self.left = int.from_bytes(self.left[:4], "little"), self.left[4:]
        return x % n


@lru_cache(maxsize=4096)
def _alphabet(c: str) -> str:
    """The letters of the same block, script and category as this one."""
    like = lambda x: (unicodedata.category(x), unicodedata.name(x, "").split(" ")[0])
    base = ord(c) & ~0x7F
    return "".join(x for x in map(chr, range(base, base + 0x80)) if like(x) == like(c))


def _letter(c: str, s: _Stream) -> str:
    """A letter of the same script, case and, for Latin letters, kind; what isn't a letter stays."""
    low = c.lower()
    if low in VOWELS:
        out = VOWELS[s.below(len(VOWELS))]
    elif "a" <= low <= "z":
        out = CONSONANTS[s.below(len(CONSONANTS))]
    elif "а" <= low <= "я":
        out = chr(ord("а") + s.below(32))
    elif "α" <= low <= "ω":
        out = "αβγδεζηθικλμνξοπρστυφχψω"[s.below(24)]
    elif c.isalpha() and ord(c) < 0x250:
        out = "éèáíóúüöä"[s.below(9)]
    elif c.isalpha() and 0x4E00 <= ord(c) < 0x9FA5:
        return chr(0x4E00 + s.below(3000))
    elif c.isalpha():
        letters = _alphabet(c)
        return letters[s.below(len(letters))]
    else:
        return c
    return out.upper() if c != low else out


def _longer(word: str, n: int, s: _Stream) -> str:
    """word with n more characters of its kind."""
    last = next((c for c in reversed(word) if c.isalnum()), "e")
    return word + "".join(str(s.below(10)) if last.isdigit() else _letter(last if last.lower() not in "aeiou" or i % 2 else "n", s).lower() for i in range(n))


#: Last letters of given names by gender, where the script has such a custom.
ENDINGS = {"f": ("a", "а"), "m": ("nrsl", "нрсл")}


def _given(word: str, gender: str, attempt: int, s: _Stream) -> str:
    """A given name of the same gender: from the list if the name is in it, else one with the gender's ending."""
    if word in GENDER and attempt < WIDER:
        return GIVEN[gender][s.below(len(GIVEN[gender]))]
    out = "".join(_letter(c, s) for c in word)
    if gender and len(out) > 1:
        endings = ENDINGS[gender][0] if "a" <= out[-1].lower() <= "z" else ENDINGS[gender][1] if "а" <= out[-1].lower() <= "я" else ""
        if endings:
            out = out[:-1] + endings[s.below(len(endings))]
    return out


def form(kind: str, canon: str, key: bytes, attempt: int) -> str:
    """The canonical form of a unit's surrogate; for the type name, that of all of its words."""
    if kind == "name":
        return " ".join(form(k, c, key, attempt) for k, c in units(kind, canon))
    s, more = _Stream(key, kind, canon, attempt), attempt // WIDER
    digit = lambda _: str(s.below(10))
    if kind == "ip":  # addresses that can't exist once the others run short
        return ".".join(str(256 + s.below(744) if more else 1 + s.below(254)) for _ in range(4))
    if kind == "ipv6":  # groups of five digits, which no address has, once the others run short
        out = "".join("0123456789abcdef"[s.below(16)] if c != ":" else c for c in canon)
        return re.sub("^0", "1", out) + ("" if not more else "".join("0123456789abcdef"[s.below(16)] for _ in range(4 + more)))
    if kind == "card":
        digits = [canon[0], *map(digit, canon[1:]), *map(digit, range(more))]
        if _luhn(canon):
            digits[-1] = next(d for d in "0123456789" if _luhn("".join([*digits[:-1], d])))
        return "".join(digits)
    if kind in ("phone", "ssn"):  # the first digits of a phone number are the country code or area and stay
        keep = 0 if kind == "ssn" else max(1, len(canon) - 10)
        return canon[:keep] + "".join(map(digit, range(len(canon) - keep + more)))
    if kind == "iban":
        return canon[:2] + "".join(str(s.below(10)) if c.isdigit() else chr(65 + s.below(26)) for c in canon[2:]) + "".join(map(digit, range(more)))
    if kind == "email":
        local, _, domain = canon.rpartition("@")
        host, dot, top = domain.rpartition(".")
        change = lambda x: "".join(str(s.below(10)) if c.isdigit() else _letter(c, s) for c in x)
        return _longer(change(local), more, s) + "@" + change(host) + dot + top
    if kind == "surname":
        return _longer("".join(_letter(c, s) for c in canon), more, s)
    if kind.startswith("given"):
        gender = kind.removeprefix("given")
        out = _given(canon, gender, attempt, s)
        return _longer(out[:1], more, s) + out[1:]
    fixed = re.match(r"AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|", canon)[0] if kind == "key" else ""
    digits = "0123456789abcdef" if re.fullmatch(r"[0-9a-f]+", canon) else "0123456789ABCDEF" if re.fullmatch(r"[0-9A-F]+", canon) else ""
    out = fixed
    for c in canon[len(fixed) :]:
        if digits:
            out += digits[s.below(16)]
        elif c.isdigit():
            out += str(s.below(10))
        elif "a" <= c <= "z":
            out += chr(97 + s.below(26))
        elif "A" <= c <= "Z":
            out += chr(65 + s.below(26))
        else:
            out += c
    return out + "".join(digits[s.below(16)] if digits else digit(0) for _ in range(more))


def dress(kind: str, entity: str, surrogate: str) -> str:
    """A canonical surrogate in the writing of one mention: separators, case and title."""
    if kind in ("phone", "card", "ssn", "iban"):
        whole = "".join(c for c in entity if c.isalnum())
        it = iter(whole[: len(whole) - len(canonical(kind, entity))] + surrogate)  # a country code stays
        return "".join(next(it) if c.isalnum() else c for c in entity) + "".join(it)
    if kind in ("email", "ipv6"):
        return surrogate.upper() if entity.isupper() else surrogate
    if kind == "name":
        title = _TITLED.match(entity)
        return (title[0] if title else "") + surrogate
    return surrogate


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, texts in slices(batch, "text"):
            seen = {}
            for t in texts:
                for *_, us in mentions((t or b"").decode("utf-8", "replace")):
                    seen.update(dict.fromkeys(us))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([c for _, c in seen], pa.string())], names=["kind", "canon"])


def _attempt(key: bytes, make: Callable = form):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [make(k, c, key, a) for k, c, a in zip(*(batch.column(x).to_pylist() for x in ("kind", "canon", "attempt")))]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("kind", "canon", "attempt")), pa.array(got, pa.string())], names=["kind", "canon", "attempt", "surrogate"])

    return run


def surrogate_table(documents: DataFrame, key: bytes = KEY, make: Callable = form) -> DataFrame:
    """Every distinct unit: kind, canon, attempt, surrogate; no two of a kind share a surrogate and
    no surrogate is an original of its kind. Given names are of one kind here, whatever their gender."""
    schema = "kind string, canon string, attempt int, surrogate string"
    docs = pick(documents, "text").withColumn("text", F.col("text").cast("binary"))
    table = docs.mapInArrow(_entities, "kind string, canon string").distinct().withColumn("attempt", F.lit(0))
    table = materialize(table.mapInArrow(_attempt(key, make), schema))
    space = F.when(F.col("kind").startswith("given"), "given").otherwise(F.col("kind")).alias("space")
    while True:  # ends, since surrogates get longer and the originals don't
        all_ = table.select("*", space)
        who = F.struct("attempt", "canon", "kind")
        holder = all_.groupBy("space", "surrogate").agg(F.min(who).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        clash = all_.join(holder, ["space", "surrogate"]).where(who != F.col("first")).select("kind", "canon")
        originals = all_.select("space", F.col("canon").alias("surrogate"))
        taken = all_.join(originals, ["space", "surrogate"], "left_semi").select("kind", "canon")
        moves = materialize(clash.union(taken).distinct())
        if moves.limit(1).count() == 0:
            release(moves)
            return table
        moved = table.join(moves, ["kind", "canon"], "left_semi").select("kind", "canon", (F.col("attempt") + 1).alias("attempt")).mapInArrow(_attempt(key, make), schema)
        old, table = table, materialize(table.join(moves, ["kind", "canon"], "left_anti").select("kind", "canon", "attempt", "surrogate").union(moved))
        release(old, moves)


OUT = "text string, n_entities int, entities array<struct<kind:string,start:int,end:int,surrogate:string>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))


def _replace(key: bytes, moved: dict[tuple[str, str], int], make: Callable, own: bool):
    """Replace by attempt 0, or the attempt that `moved`, or the row's own column, tells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], str] = {}
        for batch in batches:
            for start, texts in slices(batch, "text"):
                outs, spans = [], []
                mine = batch.column("moved").slice(start, len(texts)).to_pylist() if own else None
                for i, t in enumerate(texts):
                    if t is None:
                        outs.append(None)
                        spans.append([])
                        continue
                    s = t.decode("utf-8", "replace")
                    tries = {(m["kind"], m["canon"]): m["attempt"] for m in mine[i] or []} if own else moved
                    at, parts, got = 0, [], []
                    for a, b, kind, us in mentions(s):
                        new = []
                        for who in us:
                            if who in tries:
                                sur = make(*who, key, tries[who])
                            elif (sur := known.get(who)) is None:
                                if len(known) > 100_000:
                                    known.clear()
                                sur = make(*who, key, 0)
                                if len(sur) < 200:
                                    known[who] = sur
                            new.append(sur)
                        sur = dress(kind, s[a:b], " ".join(new))
                        parts += [s[at:a], sur]
                        got.append({"kind": kind, "start": a, "end": b, "surrogate": sur})
                        at = b
                    parts.append(s[at:])
                    outs.append("".join(parts))
                    spans.append(got)
                ids = batch.column("doc_id").slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(outs, pa.string()), pa.array([len(x) for x in spans], pa.int32()), pa.array(spans, _SPAN)], names=["doc_id", "text", "n_entities", "entities"])

    return run


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mentions of each row: row, kind, canon."""
    for batch in batches:
        for start, texts in slices(batch, "text"):
            rows = batch.column("row").slice(start, len(texts)).to_pylist()
            got = {(r, *u) for r, t in zip(rows, texts) if t for *_, us in mentions(t.decode("utf-8", "replace")) for u in us}
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.int64() if i == 0 else pa.string()) for i in range(3)], names=["row", "kind", "canon"])


def replace_entities(documents: DataFrame, key: bytes = KEY, make: Callable = form, broadcast_rows: int = 200_000) -> DataFrame:
    """documents (doc_id, text) to doc_id, text (with surrogates), n_entities, entities (kind, start and
    end in the original text, surrogate)."""
    table = surrogate_table(documents, key, make)
    moved = table.where("attempt > 0").select("kind", "canon", "attempt")
    docs = pick(documents, "doc_id", "text").withColumn("text", F.col("text").cast("binary"))
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, {OUT}"
    few = moved.limit(broadcast_rows + 1).collect()
    if len(few) <= broadcast_rows:
        return docs.mapInArrow(_replace(key, {(r[0], r[1]): r[2] for r in few}, make, False), schema)
    docs = materialize(docs.withColumn("row", F.monotonically_increasing_id()))
    mentions = docs.select("row", "text").mapInArrow(_found, "row long, kind string, canon string")
    tries = mentions.join(moved, ["kind", "canon"]).groupBy("row").agg(F.collect_list(F.struct("kind", "canon", "attempt")).alias("moved"))
    return docs.join(tries, "row", "left").select("doc_id", "text", "moved").mapInArrow(_replace(key, {}, make, True), schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates in place of personal data."""
    return replace_entities(load(spark, sf_dir, "documents"))
