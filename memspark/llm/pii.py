"""Personal information in free text: finding, typed placeholders, and format-preserving pseudonyms.

Each text is read whole. Numbers are taken as runs of digit groups and told apart by their formats and by the word
before them; addresses by their street words; names by a given name, short name or initials beside a capitalised
(or equally cased) surname, and those of no list by a trained recogniser of their context (``name_model``).
Replacements are placeholders ``[TYPE pseudonym]`` by the rules of ``pseudonyms``: numbers, and dates of birth if asked
for, are permuted in their format under the caller's key, so equal values stay linked across documents and formats.
"""

from __future__ import annotations

import re
import secrets
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm import name_model as M
from memspark.llm.names import _BIZ, _LEGAL, _SHORT, TITLES
from memspark.llm.pseudonyms import _DATE, pseudonym
from memspark.llm.samples import bounded

TYPES = ("email", "phone", "id_number", "street_address", "name")
#: Texts that the recogniser of names is trained on, at most.
SAMPLE = 4000

# ---------------------------------------------------------------- e-mail
_AT = r"(?:\s?@\s?|\s?[\[({<]\s?at\s?[\])}>]\s?|\sat\s)"
_DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|punkt|punto|point)\s?[\])}>]\s?|\s(?:dot|punkt|punto|point)\s)"
_EMAIL = re.compile(rf"(?<![\w.+@-])[a-z0-9](?:[a-z0-9_.+%-]*[a-z0-9_+%-])?(?P<at>{_AT})[a-z0-9][a-z0-9-]*(?P<rest>(?:{_DOT}[a-z0-9][a-z0-9-]*)*)(?![\w@-])", re.I)


def _emails(text: str) -> list[tuple[int, int]]:
    low = text.lower()
    if "@" not in low and not ("at" in low and ("dot" in low or "punkt" in low or "punto" in low or "point" in low or "at]" in low or "at)" in low)):
        return []
    out = []
    for m in _EMAIL.finditer(text):
        if "@" in m["at"] or m["at"].strip().lower() != "at":
            if m["rest"] or "[" in m["at"] or "(" in m["at"]:
                out.append(m.span())
        elif re.search(r"dot|punkt|punto|point", m["rest"], re.I) and re.search(r"\s(?:dot|punkt|punto|point)\s", m["rest"], re.I):
            out.append(m.span())
    return out


# ---------------------------------------------------------------- numbers
_RUN = re.compile(r"(?<![\w.,#/@+(-])(?:\+|\(|00(?=[1-9]))?\d[\d ()./-]*\d(?![\w-]|[.,:]\d)")
_CODED = re.compile(r"(?<![\w.#/@-])(?:[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]{1,2}\d{7,8}|\d{6}-[A-Z]\d{3}|\d{6}[-+A]\d{3}[0-9A-Y]|[A-Z]{3,5}\d{6,8})(?![\w-])", re.I)
_PHONE = re.compile(
    r"""\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?\(?\d{1,4}\)?(?:[ ./-]?\d{2,8}){1,5}   # with a country code
      | \+\d{8,14}
      | \(\d{2,5}\)[ .-]?\d{3,4}[ .-]?\d{3,5}                               # area code in brackets
      | [2-9]\d{2}([.-])\d{3}\1\d{4} | [2-9]\d{2}\ \d{3}[ -]\d{4}
      | 0\d{1,4}/\d{3,6}(?:[ -]?\d{2,5})*                                   # with a slash
      | 0\d{2,4}[ -]\d{3,4}[ -]?\d{3,4}
      | 0\d(?:[ .-]\d{2}){4} | 0[1-9]\d{8,9}
      | 00[1-9]\d{0,2}[ .-]?\d{1,4}(?:[ ./-]?\d{2,8}){2,4}""",
    re.X,
)
_ID = re.compile(r"\d{3}([- ])\d{2}\1\d{4}|\d{2} \d{3} \d{3} \d{3}|\d{9}|\d{11}")
_PLAIN_ID = re.compile(r"\d{9}|\d{11}")
#: Words that say what a number is: a person's, or another thing's.
_PERSONAL = re.compile(r"secur|insur|passport|licen[cs]e|tax|personal|identity|\bid\b|\bssn\b|steuer|ausweis|versicherung|passeport|s[ée]curit|imp[oô]t|permis|seguridad|pasaporte|identidad|fiscal|codice|passaporto|passaporte|contribuinte|burger|paspoort|rijbewijs|personnummer|pass", re.I)
_THING = re.compile(r"(?:order|ticket|tracking|code|build|serial|invoice|total|meter(?:\s\w+)?|version|part|item|model|bestell\w*|parcel no|reference)\W*(?:no|number|nr)?\W*$", re.I)


def _numbers(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _CODED.finditer(text):
        if not _THING.search(text[max(0, m.start() - 24) : m.start()]):
            out.append((*m.span(), "id_number"))
    for m in _RUN.finditer(text):
        a, b = m.span()
        s = m.group()
        while s and s[-1] in " (./-":
            s, b = s[:-1], b - 1
        digits = sum(c.isdigit() for c in s)
        if digits < 8 or digits > 15 or any(x < b and a < y for x, y, _ in out):
            continue
        before = text[max(0, a - 40) : a]
        if _THING.search(before[-24:]):
            continue
        if _ID.fullmatch(s) and (not _PLAIN_ID.fullmatch(s) or _PERSONAL.search(before)):
            out.append((a, b, "id_number"))
        elif _PHONE.fullmatch(s):
            out.append((a, b, "phone"))
    return out


# ---------------------------------------------------------------- street addresses
_KIND = r"(?:street|road|way|lane|drive|avenue|close|crescent|terrace|court|place|square|boulevard|grove|gardens|hill|row|walk|st\b|rd\b|ln\b|dr\b|ave\b|av\b|blvd\b|ct\b|pl\b|sq\b)"
_NUM = r"\d{1,4}(?:\s?[a-z](?![a-z]))?(?:\s(?:bis|ter))?"
_WORD = r"[^\W\d_][\w'’-]*"
_HOUSE_FIRST = re.compile(
    rf"""{_NUM}\s(?:{_WORD}\s){{1,3}}?{_KIND}(?:\.(?=\s[a-z,;)]|[,;)]))?(?!\w)
    | {_NUM},?\s(?:rue|avenue|boulevard|place|chemin|allée|impasse|quai)\s(?:(?:des|de|du|la|le|les|l'|d')\s?){{0,3}}{_WORD}""",
    re.X | re.I,
)
_HOUSE = re.compile(r"(?<![\w#.,/-])\d{1,4}(?=[a-z]? ?[^\W\d_,]|,? [^\W\d_])", re.I)
_ENDINGS = ("straße", "strasse", "str.", "gasse", "weg", "allee", "platz", "damm", "ufer", "gatan", "vägen", "straat", "laan", "plein")
_OPENINGS = ("calle", "via", "viale", "corso", "piazza", "rua", "avenida", "travessa", "plaza", "paseo")
_HOUSE_LAST = re.compile(
    rf"""(?<![\w#.,/-])(?:[^\W\d_][\w-]*(?:{"|".join(re.escape(e) for e in _ENDINGS)})\s\d{{1,4}}(?:\s?[a-z])?(?!\w)
    | (?:{"|".join(_OPENINGS)})\s(?:(?:de|da|do|del|della|la|las|los|di)\s){{0,2}}{_WORD}(?:\s{_WORD})?,?\s\d{{1,4}}[a-z]?(?!\w))""",
    re.X | re.I,
)
#: Words that begin a phrase about a room, a chapter, a step and so on, not a house number.
_NOT_HOUSE = re.compile(r"(?:room|chapter|step|building|version|day|page|no\.?|number|flat|floor|apartment|apt\.?|unit|stage|week|x)\s?$", re.I)
_LINKS = {"rue", "des", "de", "du", "la", "le", "les", "bis", "ter", "hill", "park", "mill", "new", "old", "first", "second", "little"}


def _streets(text: str, plain: str) -> list[tuple[int, int]]:
    spans = []
    for h in _HOUSE.finditer(text):
        m = _HOUSE_FIRST.match(text, h.start())
        if m and not _NOT_HOUSE.search(text[max(0, h.start() - 12) : h.start()]):
            words = m.group().split()[1:]
            # a house number is followed by a name, not by a common word
            if not any(w.lower() in _COMMON and w.lower() not in _LINKS for w in words):
                spans.append(m.span())
    low = text.lower()
    if any(e in low for e in _ENDINGS) or any(o + " " in low for o in _OPENINGS):
        spans += [m.span() for m in _HOUSE_LAST.finditer(text)]
    return spans


# ---------------------------------------------------------------- names
#: Frequent words, titles of things and sentence openers that are no surnames.
_COMMON = set(
    """the a an and or but of to in on at by for from with without about after before during into over under near since so while until because although though if then than as is was are were be been has have had do does did will would can could
    may might must shall should not no yes it its this that these those he she they we you i me my your his her our their him them us who whom which what when where why how said says mentioned asked told wants want likes like met saw went came
    got gave made took sent wrote called paid moved sold bought again still also just only very too here there now today yesterday tomorrow monday tuesday wednesday thursday friday saturday sunday january february march april june july august
    september october november december last next first second third new old little big please dear hello hi thanks regards best minutes people days day week month year time times ago keeps sorted between note room building project we're
    there's it's i'm don't according unfortunately somebody someone nobody recently late early around check three two one am im und der die das ist mit von hat wir ich et le la les des une un est dans il elle je nous el los las una en y es por
    con mi lo gli uno nel per mio o os um uma na da meu minha de het een van mijn och på ett med min mitt att som""".split()
)
_THINGS = {"harbour", "bridge", "hall", "road", "street", "park", "station", "square", "school", "hotel", "museum", "library", "project", "two", "lake", "river", "mill"}
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_WORDS = re.compile(r"[^\W\d_]+")
_INITIALS = re.compile(r"\b[A-Z]\.? ?[A-Z]?\.? [A-Z]|\b[A-Z]{2,4} [A-Z][a-zà-ÿ]")


class _Fold(dict):
    """Letters without accents, one for one, so that places in the text stay."""

    def __missing__(self, code: int) -> int:
        base = unicodedata.normalize("NFKD", chr(code))[0]
        out = self[code] = ord(base) if len(base.lower()) == 1 else code
        return out


_FOLD = _Fold()


def _plain(text: str) -> str:
    """Lower case without accents, of the same length."""
    if text.isascii():
        return text.lower()
    low = text.translate(_FOLD)
    out = low.lower()
    return out if len(out) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in low)


def _slipped() -> dict[str, str]:
    """Forms one character off a given or short name of five letters or more."""
    abc, out = "abcdefghijklmnopqrstuvwxyz", {}
    for name in [n for n in _SHORT if len(n) >= 5]:
        for i in range(len(name) + 1):
            a, b = name[:i], name[i:]
            forms = [a + c + b for c in abc]
            if b:
                forms += [a + b[1:], *(a + c + b[1:] for c in abc)]
            if len(b) > 1:
                forms.append(a + b[1] + b[0] + b[2:])
            for f in forms:
                out.setdefault(f, name)
    for name in [*_SHORT, *_COMMON]:
        out.pop(name, None)
    return out


_SLIPPED = _slipped()
_GIVEN = {*_SHORT, *_SLIPPED}


def _is_given(word: str, low: str) -> bool:
    return low in _SHORT or (low in _SLIPPED and word[0].isupper() and low not in _COMMON)


def _surname(word: str, like: str, text: str, end: int) -> bool:
    """Whether ``word`` can be the surname beside the given name ``like``: cased alike and no common word."""
    low = _plain(word)
    if len(low) < 4 or low in _COMMON or low in _SHORT and like[0].islower() or low in _THINGS or low in _BIZ or low in _LEGAL or low in TITLES:
        return False
    if like[0].isupper():
        return word[0].isupper()
    if word[0].isupper():
        return False
    # small letters: not a verb in -ed, not the next words of a sentence
    return not re.search(r"(?:ed|ing|ly|s's|n't)$", low) and low not in _SHORT


def _names(text: str, plain: str) -> list[tuple[int, int]]:
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(plain)]
    lows = [plain[a:b] for a, b in tokens]
    at = {i for i, w in enumerate(lows) if w in _GIVEN}
    starts = at | {i - 1 for i in at if i}
    if _INITIALS.search(text):
        starts |= {i for i, w in enumerate(lows) if len(w) <= 2 and text[tokens[i][0] : tokens[i][1]].isupper()}
    if not starts:
        return []
    tokens = [(a, b, text[a:b]) for a, b in tokens]
    gap = lambda i: text[tokens[i][1] : tokens[i + 1][0]]
    out: list[tuple[int, int]] = []
    used = [False] * len(tokens)

    def business(i: int) -> bool:
        """Whether a business word follows or precedes on the same line: an organisation, not a person."""
        for k in (i + 1, i + 2):
            if k < len(tokens) and text[tokens[i][1] : tokens[k][0]].strip(" &.,'") in ("", *(t for t in (tokens[i + 1][2],))) and (lows[k] in _BIZ or lows[k] in _LEGAL) and len(lows[k]) > 1 and tokens[k][2][0].isupper():
                return True
        return False

    def take(i: int, j: int) -> None:
        for k in range(i, j + 1):
            used[k] = True
        out.append((tokens[i][0], tokens[j][1]))

    n = len(tokens)
    for i in sorted(starts):
        if used[i]:
            continue
        a, low = tokens[i][2], lows[i]
        # given [M.] surname
        if _is_given(a, low):
            j = i + 1
            if j < n - 1 and len(lows[j]) == 1 and tokens[j][2].isupper() and gap(i) == " " and gap(j) in (". ", " "):
                if _surname(tokens[j + 1][2], a, text, tokens[j + 1][1]) and not business(j + 1):
                    take(i, j + 1)
                    continue
            if j < n and gap(i) == " " and _surname(tokens[j][2], a, text, tokens[j][1]) and not business(j):
                if not (low in _COMMON and not a[0].isupper()):
                    take(i, j)
                    continue
        # surname, given / surname given
        if i + 1 < n and not used[i + 1] and gap(i) in (", ", " ") and _is_given(tokens[i + 1][2], lows[i + 1]):
            b = tokens[i + 1][2]
            if low not in _SHORT and _surname(a, b, text, tokens[i][1]) and (a.isupper() == b.isupper()):
                comma = gap(i) == ", "
                begins = i == 0 or text[: tokens[i][0]].rstrip(" ")[-1:] in (".", "!", "?", "\n", ":", '"', "-", "")
                if a[0].isupper() and (comma or not begins or low not in _OPENERS) or (not a[0].isupper() and not comma and i > 0 and lows[i - 1] in _BEFORE):
                    # not the given name of the next full name
                    take(i, i + 1)
                    continue
        # initials surname
        if a.isupper() and i + 1 < n and not used[i + 1]:
            j, letters = i, 0
            while j < n and len(lows[j]) == 1 and tokens[j][2].isupper() and j + 1 < n and gap(j) in (". ", " ", "."):
                j, letters = j + 1, letters + 1
            if letters and j < n and text[tokens[j - 1][1]] == "." and _initialed(tokens[j][2], lows[j]) and not business(j) and not (i and gap(i - 1) == " " and lows[i - 1] not in _COMMON and tokens[i - 1][2][0].isupper() and lows[i - 1] not in TITLES):
                take(i, j)
                continue
            if len(a) == 2 and not letters and gap(i) == " " and _initialed(tokens[i + 1][2], lows[i + 1]) and not tokens[i + 1][2].isupper() and a not in _LETTERS and low not in TITLES and not business(i + 1):
                take(i, i + 1)
    return out


#: Two capitals that are no initials.
_LETTERS = {"US", "UK", "EU", "UN", "TV", "PC", "HR", "CV", "IT", "AI", "NY", "LA", "DC", "ID", "QQ"}
_OPENERS = _COMMON
#: Small words before a name in small letters.
_BEFORE = {"to", "with", "by", "add", "from", "and", "tutor", "for", "is", "mr", "mrs", "ms", "mx", "dr", "prof", "met", "of"}


def _initialed(word: str, low: str) -> bool:
    return word[0].isupper() and len(low) >= 4 and low not in _COMMON and low not in _BIZ and low not in _LEGAL and low not in _THINGS and low not in _SHORT


_DIGIT = re.compile(r"\d")


_BORN = re.compile(r"(?:\bborn(?:\son)?|date of birth|\bd\.?o\.?b\.?|birthday|geboren(?:\sam)?|geburtsdatum|née? le|date de naissance|nacid[oa] el|fecha de nacimiento|nascid[oa] (?:em|a)|data de nascimento|nat[oa] il|data di nascita|geboortedatum|född(?:\sden)?)\W{1,3}$", re.I)


def find(text: str | None, names: M.Recogniser | None = None, dates: bool = False) -> list[tuple[int, int, str]]:
    """Items as (start, end, type), in order, without overlaps; null and empty texts have none.

    names: a trained recogniser for names of no list; dates: numeric dates of birth too, as type ``date``."""
    if not text:
        return []
    plain = _plain(text)
    out = [(a, b, "email") for a, b in _emails(text)]
    free = lambda a, b: all(b <= x or y <= a for x, y, _ in out)
    if _DIGIT.search(text):
        if dates:
            out += [(*m.span(), "date") for m in _DATE.finditer(text) if _BORN.search(text[max(0, m.start() - 24) : m.start()]) and free(*m.span())]
        out += [(a, b, "street_address") for a, b in _streets(text, plain) if free(a, b)]
        out += [(a, b, t) for a, b, t in _numbers(text) if free(a, b)]
    out += [(a, b, "name") for a, b in _names(text, plain) if free(a, b)]
    if names is not None:
        out += [(a, b, "name") for a, b, words in M.candidates(text) if free(a, b) and _may_name(words) and names.likely(text, a, b, words)]
    return sorted(out)


def _may_name(words: tuple[str, ...]) -> bool:
    """No word of a candidate is a common, business or place word."""
    return not any(low in _COMMON or low in _THINGS or low in _BIZ or low in _LEGAL or low in TITLES for low in map(_plain, words))


def recogniser(texts: list[str]) -> M.Recogniser:
    """A recogniser trained on the candidates of ``texts``, those found by rule as names."""
    out, x, y = M.Recogniser(), [], []
    for text in texts:
        found = {(a, b) for a, b, k in find(text) if k == "name"}
        for a, b, words in M.candidates(text):
            x.append(M.features(text, a, b, words))
            y.append((a, b) in found)
    if any(y) and not all(y):
        out.fit(x, y)
    return out


def _trained(texts: DataFrame, sample: int) -> M.Recogniser:
    some = texts.filter("text IS NOT NULL AND row_id IS NOT NULL").select(F.concat_ws("|", "src_table", "src_field", "row_id").alias("key"), "text")
    return recogniser([r["text"] for r in bounded(some, "key", sample, M.SEED)])


# ---------------------------------------------------------------- frames
def replaced(text: str, found: list[tuple[int, int, str]], key: bytes) -> str:
    """The text with every item replaced by ``[TYPE pseudonym]``; all else is unchanged."""
    out, at = [], 0
    for a, b, kind in found:
        out += [text[at:a], f"[{kind.upper()} {pseudonym(kind, text[a:b], key)}]"]
        at = b
    return "".join([*out, text[at:]])


def redact(text: str | None, key: bytes, dates: bool = False) -> str | None:
    return replaced(text, find(text, dates=dates), key) if text else text


_ITEM = "src_table string, src_field string, row_id string, pii_type string, pii_text string, pseudonym string"


def scan(texts: DataFrame, key: bytes | None = None, sample: int = SAMPLE) -> DataFrame:
    """Distinct items of texts (src_table, src_field, row_id, text) with their pseudonyms.

    key: the caller's secret; without one a new one is drawn, whose pseudonyms link values within this frame only.
    Null texts and empty tables have no items; other columns are ignored; repeated rows count once."""
    key = key or secrets.token_bytes(32)
    held = texts.sparkSession.sparkContext.broadcast(_trained(texts, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {(t, f, r, k, x[a:b]) for t, f, r, x in zip(*(c.to_pylist() for c in batch.columns)) for a, b, k in find(x, held.value)}
            if rows:
                full = [(*r, pseudonym(r[3], r[4], key)) for r in sorted(rows, key=str)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*full)], [p.split()[0] for p in _ITEM.split(", ")])

    return texts.select("src_table", "src_field", "row_id", "text").mapInArrow(run, _ITEM).distinct()


def items(texts: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(src_table, src_field, row_id, pii_type, pii_text) of ``scan``."""
    return scan(texts, sample=sample).select("src_table", "src_field", "row_id", "pii_type", "pii_text")


def redacted(texts: DataFrame, key: bytes | None = None, dates: bool = False, sample: int = SAMPLE) -> DataFrame:
    """The texts with typed placeholders: (src_table, src_field, row_id, text, n_items), a row per input row; key as in ``scan``."""
    key = key or secrets.token_bytes(32)
    held = texts.sparkSession.sparkContext.broadcast(_trained(texts, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, count = [], []
            for text in batch.column(3).to_pylist():
                found = find(text, held.value, dates)
                new.append(replaced(text, found, key) if found else text)
                count.append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(new, pa.string()), pa.array(count, pa.int32())], ["src_table", "src_field", "row_id", "text", "n_items"])

    return texts.select("src_table", "src_field", "row_id", "text").mapInArrow(run, "src_table string, src_field string, row_id string, text string, n_items int")


def memory_texts(blocks: DataFrame, turns: DataFrame) -> DataFrame:
    """memory_blocks.content, turns.user_message and turns.assistant_reply as (src_table, src_field, row_id, text)."""
    one = blocks.select(F.lit("memory_blocks").alias("src_table"), F.lit("content").alias("src_field"), F.col("id").alias("row_id"), F.col("content").alias("text"))
    two = turns.select(F.lit("turns").alias("src_table"), F.explode(F.create_map(F.lit("user_message"), "user_message", F.lit("assistant_reply"), "assistant_reply")).alias("src_field", "text"), F.col("turn_id").cast("string").alias("row_id")).select("src_table", "src_field", "row_id", "text")
    return one.unionByName(two)
