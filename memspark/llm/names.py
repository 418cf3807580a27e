"""Variant spellings of names of people and organisations, linked by canonical rewriting.

Every name form is rewritten into all canonical forms that rules allow: nicknames become each given name they may
stand for, titles and middle initials go, initials stand for themselves, hyphens, accents, case, articles and
ampersands go, abbreviations of business words and legal forms become full words or go, token order is ignored.
A spelling slip is the loss of one character: two forms that differ by one added, lost, changed or swapped
character share a form with one character less. Forms are exploded and equi-joined; a form's score is its rules'
weight divided by the number of different parties it may come from (its rarity), so a form that several parties
share names none of them. Among registry rows a slip counts only where it is no matter of choice: all spellings within
one slip of each other have one in their middle, or a spelling is written by more rows than all those near it.

A person's name may have any number of parts and be of any script; particles belong to the surname, further given
names go. An organisation's distinct words may be several.

Scores: exact rewriting 1, nickname 1, initial 0.9, slip 0.8; accepted from ``ACCEPT`` on.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.operators.graph import components
from memspark.session import cut

ACCEPT = 0.5
#: A name is no text: more words than these are none. Longer words take slips by their halves.
PERSON_WORDS, ORGANISATION_WORDS, LONG_WORD = 8, 12, 64
WEIGHTS = {"full": 1.0, "initial": 0.9, "slip": 0.8}

#: Given names and their usual short forms (public English name lore).
NICKNAMES = {
    "abigail": "abby abbie gail", "alexander": "alex sasha sandy xander lex", "andrew": "andy drew", "anthony": "tony ant", "barbara": "barb babs",
    "benjamin": "ben benny benji", "charles": "charlie chuck chas", "christina": "chris tina chrissie", "christopher": "chris kit topher",
    "daniel": "dan danny", "deborah": "deb debbie debby", "dominic": "dom nic nick", "dorothy": "dot dottie dolly", "edward": "ed eddie ned ted teddy",
    "eleanor": "ellie nell nora ella", "elizabeth": "liz lizzie beth betty eliza betsy lisa libby", "emily": "emmy", "francesca": "fran frankie chess chessie", "francis": "frank fran",
    "frederick": "fred freddie fritz freddy", "gabriella": "gabi gabby ella gaby bella", "george": "georgie", "gregory": "greg gregg", "harriet": "hattie harry hatty",
    "henry": "hank harry hal", "isabella": "bella izzy isa ella", "jacob": "jake", "james": "jim jimmy jamie", "jennifer": "jen jenny jenn jennie",
    "john": "jack johnny", "jonathan": "jon jonny", "joseph": "joe joey", "josephine": "jo josie josy", "joshua": "josh",
    "katherine": "kate kathy kit katie kat kitty catherine cathy cat", "kenneth": "ken kenny", "lawrence": "larry", "leonard": "len leo lenny", "margaret": "maggie peggy meg madge greta marge rita",
    "martha": "marty", "matthew": "matt matty", "michael": "mike mick mickey micky", "nathaniel": "nate nathan nat", "nicholas": "nick nico nicky",
    "oliver": "ollie olly", "pamela": "pam", "patricia": "pat patty trish tricia patsy", "patrick": "pat paddy", "peter": "pete",
    "philip": "phil pip", "rebecca": "becca becky bex", "richard": "dick rick rich ricky richie", "robert": "bob rob bobby robbie bert", "ronald": "ron ronnie",
    "samantha": "sam sammy sammie", "samuel": "sam sammy", "stephanie": "steph", "stephen": "steve", "steven": "steve",
    "susanna": "sue suzy susie sanna suzie", "theodore": "ted theo teddy", "thomas": "tom tommy", "timothy": "tim timmy", "victoria": "vicky tori vicki vic",
    "vincent": "vince vin vinny", "walter": "walt wally wat", "william": "bill will billy liam willie", "zachary": "zach zack zac zak",
}
TITLES = set("mr mrs ms miss mx dr prof professor sir dame rev herr frau".split())
SUFFIXES = set("jr sr junior senior ii iii phd md esq".split())
#: Small words that begin a surname.
PARTICLES = set("van von der den de del della di da do dos das du la le el al bin ibn ben ter ten zu zur st san santa mac".split())
_PART = re.compile(r"[^\W\d_]+(?:['-][^\W\d_]+)*")
#: Business words and their abbreviations.
BUSINESS = {
    "international": "int'l intl internat", "national": "natl nat'l nat", "north": "n", "south": "s", "east": "e", "west": "w", "brothers": "bros bro", "engineering": "eng engrg engr",
    "systems": "sys syst systms", "services": "serv svcs svc srvcs", "foods": "food fds", "partners": "ptnrs prtnrs", "laboratories": "labs lab", "institute": "inst",
    "manufacturing": "mfg manuf mfrg", "publishing": "publ publishers pub", "logistics": "log logistic", "university": "univ uni", "associates": "assoc", "industries": "ind", "technologies": "tech",
    "group": "grp", "holdings": "hldgs", "management": "mgmt", "department": "dept",
}
LEGAL = {"limited": "ltd", "incorporated": "inc", "corporation": "corp", "company": "co", "gmbh": "", "plc": "", "llc": "", "llp": "", "ag": "", "sa": ""}
ARTICLES = {"the", "and"}

#: Business words that say where, not what.
WHERE = {"international", "national", "north", "south", "east", "west"}

_SHORT: dict[str, list[str]] = {}
for _full, _shorts in NICKNAMES.items():
    _SHORT.setdefault(_full, []).append(_full)
    for _s in _shorts.split():
        _SHORT.setdefault(_s, []).append(_full)
_BIZ = {w: w for w in BUSINESS} | {a: w for w, abbr in BUSINESS.items() for a in abbr.split()}
_LEGAL = set(LEGAL) | {a for abbr in LEGAL.values() for a in abbr.split()}
_LONG = [w for w in [*BUSINESS, *LEGAL] if len(w) >= 5]


def fold(text: str) -> str:
    """Without accents, in lower case, one kind of apostrophe, single spaces."""
    text = unicodedata.normalize("NFKD", text)
    text = "".join(c for c in text if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", text.replace("’", "'").replace("ß", "ss")).strip().lower()


def slips(word: str) -> set[str]:
    """The word and all forms with one character less. A long word's forms are its beginnings and ends of about half its
    length, one of which a slip leaves as it is."""
    if len(word) > LONG_WORD:
        half = {(len(word) + k) // 2 - 1 for k in (-1, 0, 1)}
        return {word} | {f"{h}<{word[:h]}" for h in half} | {f"{h}>{word[-h:]}" for h in half}
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


def near(a: str, b: str) -> bool:
    """At most one character added, lost or changed, or two neighbours swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def _business(token: str) -> str | None:
    """The business or legal word a token stands for, slips included."""
    if token in _BIZ:
        return _BIZ[token]
    if token in _LEGAL:
        return ""
    if len(token) >= 4:
        for w in _LONG:
            if near(token, w):
                return "" if w in _LEGAL else w
    return None


def organisation(name: str) -> tuple[str, str] | None:
    """(distinct words, business words), both sorted; None if the name has no business word or no distinct word."""
    tokens = [t.strip(".,;:'") for t in fold(name).replace("&", " ").replace(",", " ").split()]
    tokens = [t for t in tokens if t and t not in ARTICLES]
    if len(tokens) > ORGANISATION_WORDS:
        return None
    own, biz, legal, exact = [], [], False, False
    for t in tokens:
        b = _business(t)
        if b is None:
            own.append(t.replace("-", "").replace("'", ""))
            continue
        exact |= t in _BIZ or t in _LEGAL
        if b:
            biz.append(b)
        else:
            legal = True
    if len("".join(own)) < 2 or not (legal or set(biz) - WHERE):
        return None
    # two letters before one word are initials; a legal form follows the name
    if len(tokens) == 2 and not biz and len(tokens[0]) == 2 and tokens[0] in _LEGAL:
        return None
    # a given name beside a word that only resembles a business word is a person
    if not exact and len(own) == 1 and own[0] in _SHORT:
        return None
    return " ".join(sorted(own)), " ".join(sorted(biz))


def _given(token: str) -> list[str]:
    """The given names a token may stand for: a known one, a slip in a known one, or itself."""
    if token in _SHORT:
        return _SHORT[token]
    known = sorted({g for s in _SHORT if len(s) >= 4 and near(token, s) for g in _SHORT[s]}) if len(token) >= 4 else []
    return known or [token.replace("-", "")]


def _many(sides: list[list[str]], comma: bool) -> list[tuple[str, str, str]]:
    """Readings of a name of three parts or more, as its parts before and after the comma: further given names go."""
    if comma:
        sur, given = sides
    else:
        parts = sides[0]
        k = next((i for i, t in enumerate(parts) if i and t in PARTICLES), len(parts) - 1)
        # a given name at the second place after an unknown word: the surname comes first
        if k == len(parts) - 1 and parts[0] not in _SHORT and parts[1] in _SHORT and parts[-1] in _SHORT:
            sur, given = parts[:1], parts[1:]
        else:
            sur, given = parts[k:], parts[:k]
    surname = "".join(sur).replace("-", "").replace("'", "")
    if not given or len(surname) < 2:
        return []
    if len(given[0]) == 1:
        return [("initial", given[0], surname)]
    return [("full", g, surname) for g in _given(given[0])]


def person(name: str) -> list[tuple[str, str, str]]:
    """(kind, given, surname) readings of a name of a person: kind ``full`` or ``initial`` (given is a letter), or
    ``bare`` with an empty surname for a given name alone."""
    sides = []
    for side in unicodedata.normalize("NFC", name).strip().strip(",").split(","):
        pairs = [(fold(t).strip(".'\""), t) for t in side.split()]
        sides.append([(t, r) for t, r in pairs if t and t not in TITLES])
    sides = [x for x in sides if any(t not in SUFFIXES for t, _ in x)]
    tokens = [x for side in sides for x in side]
    if len([1 for t, _ in tokens if t not in SUFFIXES]) > 1:
        tokens = [(t, r) for t, r in tokens if t not in SUFFIXES]
    if len(tokens) > PERSON_WORDS or len(sides) > 2 or any(not _PART.fullmatch(t) or t in ARTICLES for t, _ in tokens):
        return []
    comma = len(sides) == 2
    full = [t for t, _ in tokens if len(t) > 1]
    letters = [t for t, _ in tokens if len(t) == 1]
    if len(full) == 1 and not letters:
        return [("bare", g, "") for g in _SHORT.get(full[0], [])]
    if len(full) == 1 and letters:
        return [("initial", letters[0], full[0].replace("-", "").replace("'", ""))]
    if len(full) > 2:
        return _many([[t for t, _ in side if t not in SUFFIXES] for side in sides], comma)
    if len(full) != 2:
        return []
    # two initials written together, as in JR Smith
    if not letters:
        written = [r for t, r in tokens if len(t) > 1]
        for k in (0, 1):
            if re.fullmatch(r"[A-Z]{2}", written[k]) and full[k] not in _SHORT and not written[1 - k].isupper():
                return [("initial", full[k][0], full[1 - k].replace("-", "").replace("'", ""))]
    out = []
    for k in (0, 1):
        given, sur = full[k], full[1 - k].replace("-", "").replace("'", "")
        if given in _SHORT and not (full[1 - k] in _SHORT and (k == 1) != comma):
            out += [("full", g, sur) for g in _SHORT[given]]
    if not out:  # no known given name: the order written decides, and a slip in a given name is undone
        k = 1 if comma else 0
        for kk in (k, 1 - k):
            given, sur = full[kk], full[1 - kk].replace("-", "").replace("'", "")
            known = _given(given)
            if known != [given.replace("-", "")]:
                return [("full", g, sur) for g in known]
        out.append(("full", full[k].replace("-", ""), full[1 - k].replace("-", "").replace("'", "")))
    return out


def _forms(name: str | None) -> list[tuple[str, str]]:
    """(kind, form): ``full`` readings, or one ``only`` reading with an initial, or ``bare`` given names."""
    if not name or not name.strip():
        return []
    org = organisation(name)
    if org:
        return [("full", f"o|{org[0]}|{org[1]}")]
    out = []
    for kind, given, sur in person(name):
        if kind == "full":
            out.append(("full", f"p|{sur}|{given}"))
        elif kind == "initial":
            out.append(("only", f"p|{sur}|{given}."))
        else:
            out.append(("bare", given))
    return sorted(set(out))


def entity_forms(names: list[str | None], kind: str | None) -> list[tuple[str, str]]:
    """Forms of one registry row: ``sure`` ones, or else ``maybe`` ones (a nickname of several given names), or
    else ``only`` ones (with an initial). Bare given names complete initials; bare abbreviations say nothing."""
    if kind in ("device", "place", "project", "concept"):
        return []
    each = [_forms(n) for n in names]
    if kind not in ("person", "organization"):  # of unknown kind: only if a rule recognises it
        each = [f if all(k != "full" or x[0] == "o" or x.rsplit("|", 1)[1] in NICKNAMES for k, x in f) else [] for f in each]
    bare = {g for f in each for k, g in f if k == "bare"}
    sure = {f[0][1] for f in each if len(f) == 1 and f[0][0] == "full"}
    maybe = [{x for k, x in f if k == "full"} for f in each if len(f) > 1 and f[0][0] == "full"]
    only = {x for f in each for k, x in f if k == "only"}
    for x in only:
        stem, letter = x[:-1].rsplit("|", 1)
        sure |= {f"{stem}|{g}" for g in bare if g[0] == letter and len([b for b in bare if b[0] == letter]) == 1}
    if not sure and maybe:
        common = set.intersection(*maybe)
        named = {x for x in set.union(*maybe) if x.rsplit("|", 1)[1] in bare} if len(bare) == 1 else set()
        for best in (common, named):
            if len(best) == 1:
                sure = best
    if sure:
        return [("sure", x) for x in sorted(sure)]
    if maybe:
        return [("maybe", x) for x in sorted(set.union(*maybe))]
    return [("only", x) for x in sorted(only)]


def _rows(df: DataFrame, schema: str, columns: list[str], each) -> DataFrame:
    """Rows made by ``each`` from the values of ``columns``."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [r for row in zip(*(c.to_pylist() for c in batch.columns)) for r in each(*row)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*out)], names)

    return df.select(*columns).mapInArrow(run, schema)


def _split_form(form: str) -> tuple[str, str, str]:
    """The part a slip may be in, and the rest of the form."""
    kind, word, rest = form.split("|", 2)
    return kind, word, rest


def _slip_rows(forms: DataFrame) -> DataFrame:
    """(slip, form): every distinct form under the form itself and under its word with one character less."""

    def each(form: str):
        kind, word, rest = _split_form(form)
        return [(f"{kind}|{s}|{rest}", form) for s in sorted(slips(word))]

    return _rows(forms.select("form").distinct(), "slip string, form string", ["form"], each)


def _near(a: Column, b: Column) -> Column:
    """One character apart, given a shared slip."""
    d = F.levenshtein(a, b)
    letters = lambda c: F.array_sort(F.split(c, ""))
    return (d <= 1) | ((d == 2) & (F.length(a) == F.length(b)) & (letters(a) == letters(b)))


def _initial(form: Column) -> Column:
    """A full form of a person with the given name's initial."""
    return F.when(form.startswith("p|") & ~form.endswith("."), F.concat(F.regexp_extract(form, r"^(.*\|)", 1), F.substring(F.regexp_extract(form, r"([^|]*)$", 1), 1, 1), F.lit(".")))


def _plain_slips(near_by: DataFrame, sure: DataFrame) -> DataFrame:
    """The pairs (form, other) of forms within one slip, given both ways, that are no matter of choice.

    A form is a middle if all that is near its neighbours is near itself; its pairs hold. Elsewhere a form goes to the
    one neighbour that more rows write than write the form itself or any other neighbour, if that neighbour
    has none written by as many. So names that differ by a slip each are not chained."""
    degree = near_by.groupBy("form").agg(F.count("*").alias("degree"))
    two = near_by.select("form", F.col("other").alias("via")).join(near_by.select(F.col("form").alias("via"), F.col("other").alias("far")), "via")
    reach = two.filter("far <> form").select("form", F.col("far").alias("at")).unionByName(near_by.select("form", F.col("other").alias("at"))).distinct().groupBy("form").agg(F.count("*").alias("reach"))
    middle = degree.join(reach, "form").filter("degree = reach").select("form")
    rows = sure.groupBy("form").agg(F.count_distinct("id").alias("n"))
    known = near_by.join(rows, "form").join(rows.select(F.col("form").alias("other"), F.col("n").alias("m")), "other")
    most = known.groupBy("form").agg(F.max("m").alias("m"), F.first("n").alias("n"))
    peak = most.filter("n > m").select(F.col("form").alias("other"))
    best = known.join(most.filter("m > n").select("form", "m"), ["form", "m"])
    only = best.groupBy("form").agg(F.count("*").alias("k"), F.min("other").alias("other")).filter("k = 1").select("form", "other")
    strong = only.join(peak, "other", "left_semi").select("form", "other")
    return near_by.join(middle, "form", "left_semi").unionByName(strong).distinct()


def parties(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, party) of every registry row of a person or organisation, and the parties' (party, form).

    entities: id, name, aliases, entity_type (others are ignored). Rows with a null id, or without a form, have no
    party; repeated rows count once; the party is its smallest id."""
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    # all spellings of a row that is sent several times count together
    rows = entities.filter("id IS NOT NULL").groupBy("id").agg(F.flatten(F.collect_set(names)).alias("names"), F.min("entity_type").alias("kind"))
    forms = cut(_rows(rows, "id string, kind string, form string", ["id", "names", "kind"], lambda i, n, k: [(i, *f) for f in entity_forms(n, k)]))
    sure = forms.filter("kind = 'sure'")
    slip = _slip_rows(sure)
    near_by = slip.join(slip.select("slip", F.col("form").alias("other")), "slip").filter("form <> other").filter(_near(F.col("form"), F.col("other"))).select("form", "other").distinct()
    close = _plain_slips(cut(near_by), sure)
    node = lambda c: F.concat(F.lit("~"), c)  # noqa: E731  ids sort before forms
    edges = sure.select(F.col("id").alias("a"), node("form").alias("b")).unionByName(close.select(node("form").alias("a"), node("other").alias("b")))
    root = components(edges)
    strong = root.filter(~F.col("node").startswith("~")).select(F.col("node").alias("id"), "root")
    known = sure.join(strong, "id").select("root", "form").distinct()
    letters = known.select("root", _initial(F.col("form")).alias("form")).filter("form IS NOT NULL").distinct()
    weak = forms.filter("kind <> 'sure'")
    hit = weak.join(known.unionByName(letters), "form").groupBy("id").agg(F.min("root").alias("root"), F.max("root").alias("last"))
    ambiguous = hit.filter("root <> last").select("id")
    hit = hit.filter("root = last").select("id", "root")
    rest = weak.join(hit, "id", "left_anti")
    # rows that no sure party explains: together if their readings are the same; alone if several parties share them
    rest = rest.groupBy("id").agg(F.concat_ws("+", F.array_sort(F.collect_set("form"))).alias("readings")).join(ambiguous.withColumn("many", F.lit(True)), "id", "left")
    alone = F.when(F.col("many"), F.col("id"))
    rest = rest.withColumn("root", F.coalesce(alone, F.concat(F.lit("="), "readings"))).select("id", "root")
    table = strong.unionByName(hit).unionByName(rest)
    first = table.groupBy("root").agg(F.min("id").alias("party"))
    table = cut(table.join(first, "root").select("id", "party"))
    return table, cut(forms.join(table, "id").select("party", "form").distinct())


def _best(found: DataFrame) -> DataFrame:
    """(surface, level, weight, party) -> the one party of the strongest level, scored by rarity."""
    top = found.groupBy("surface").agg(F.min("level").alias("level"))
    one = found.join(top, ["surface", "level"]).groupBy("surface", "level").agg(F.first("weight").alias("weight"), F.min("party").alias("party"), F.count_distinct("party").alias("n"))
    return one.withColumn("score", F.col("weight") / F.col("n")).filter(F.col("score") > ACCEPT).select("surface", "party", "score")


def mention_parties(mentions: DataFrame, forms: DataFrame) -> DataFrame:
    """(surface, party, score) of every distinct surface form that names one party.

    The strongest level that reaches any party decides: a shared full form, an initial, a slip in the surname or
    distinct word, the initial of a full form where the registry has only an initial, a slip beside an initial."""
    surface = mentions.select(F.col("surface_form").alias("surface")).filter("surface IS NOT NULL").distinct()
    mine = cut(_rows(surface, "surface string, kind string, form string", ["surface"], lambda s: [(s, *f) for f in _forms(s) if f[0] != "bare"]))
    full = mine.filter("kind = 'full'").select("surface", "form")
    only = mine.filter("kind = 'only'").select("surface", "form")
    whole = forms.filter(~F.col("form").endswith("."))
    letters = whole.select("party", _initial(F.col("form")).alias("form")).filter("form IS NOT NULL").unionByName(forms.filter(F.col("form").endswith("."))).distinct()
    bare = forms.filter(F.col("form").endswith(".")).join(whole.select("party").distinct(), "party", "left_anti")
    mark = lambda df, level, kind: df.select("surface", F.lit(level).alias("level"), F.lit(WEIGHTS[kind]).alias("weight"), "party")

    def slipped(of: DataFrame, to: DataFrame) -> DataFrame:
        a = _slip_rows(of).join(_slip_rows(to).withColumnRenamed("form", "known"), "slip").filter(_near(F.col("form"), F.col("known"))).select("form", "known").distinct()
        return of.join(a, "form").select("surface", F.col("known").alias("form")).join(to, "form")

    found = (
        mark(full.join(whole, "form"), 1, "full")
        .unionByName(mark(only.join(letters, "form"), 2, "initial"))
        .unionByName(mark(slipped(full, whole), 3, "slip"))
        .unionByName(mark(full.select("surface", _initial(F.col("form")).alias("form")).join(bare, "form"), 4, "initial"))
        .unionByName(mark(slipped(only, letters), 5, "slip"))
    )
    return _best(cut(found.distinct()))


def links(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """(left_id, right_id): all pairs of registry rows of one party, left < right, and (smallest id of the party,
    mention_id) of the mentions that name it by a form that none of its rows has letter for letter.

    Null or blank names, empty tables, unknown kinds and repeated rows are allowed; names of more than
    ``PERSON_WORDS`` words (``ORGANISATION_WORDS`` of an organisation) are texts and have no form. The pairs of a party are its result, by its
    definition; a party's rows are joined to each other by the party's id."""
    table, forms = parties(entities)
    a, b = table.select("party", F.col("id").alias("left_id")), table.select("party", F.col("id").alias("right_id"))
    rows = a.join(b, "party").filter("left_id < right_id").select("left_id", "right_id")
    named = mention_parties(mentions, forms)
    own = entities.select("id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("surface"))
    own = own.join(table, "id").select("party", "surface").distinct()
    new = named.join(own, ["party", "surface"], "left_anti")
    said = mentions.select("mention_id", F.col("surface_form").alias("surface")).filter("mention_id IS NOT NULL").distinct().join(new, "surface").select(F.col("party").alias("left_id"), F.col("mention_id").alias("right_id"))
    return rows.unionByName(said).distinct()
