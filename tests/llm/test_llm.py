"""Operators of the llm subpackage against brute force, round trips, made cases and awkward rows."""

import random
import re
import string

import numpy as np
import pandas as pd
import pytest

from memspark.llm import languages as L
from memspark.llm import leaks as K
from memspark.llm import mixing as M
from memspark.llm import names as N
from memspark.llm import near_duplicates as D
from memspark.llm import pairs as P
from memspark.llm import pii
from memspark.llm import pseudonyms as Y


# ------------------------------------------------------------------ 2: names
@pytest.mark.parametrize(
    "form, want",
    [
        ("Bob Fenimore", "p|fenimore|robert"), ("Fenimore, Rob", "p|fenimore|robert"), ("Dr. ROBERT Q. FENI-MORE", "p|fenimore|robert"), ("Robret Fenimore", "p|fenimore|robert"), ("R. Fenimore", "p|fenimore|r."), ("RQ Fenimore", "p|fenimore|r."),
        ("The Zabok Nat'l Eng. Co.", "o|zabok|engineering national"), ("Engineering Zabok National", "o|zabok|engineering national"), ("Zabok Engineeering Ltd", "o|zabok|engineering"),
    ],
)
def test_rewritings(form, want):
    assert want in [f for _, f in N._forms(form)]


@pytest.mark.parametrize("form", ["", None, "  ", "Bob", "BBI", "the company", "x" * 5000])
def test_names_nobody(form):
    assert all(k == "bare" or not f.startswith("o|") for k, f in N._forms(form)) and not [1 for k, _ in N._forms(form) if k == "only"]


@pytest.mark.parametrize(
    "form, want",
    [
        ("Kim Lee", "p|lee|kim"), ("Lee, Kim", "p|lee|kim"), ("Wei Ng", "p|ng|wei"), ("Ana Maria Gonzalez Ruiz", "p|ruiz|ana"), ("Martin Luther King Jr.", "p|king|martin"), ("Ludwig van Beethoven", "p|vanbeethoven|ludwig"),
        ("van Beethoven, Ludwig", "p|vanbeethoven|ludwig"), ("Иван Петров", "p|петров|иван"), ("Blue Harbor Foods Ltd", "o|blue harbor|foods"), ("Foods, Harbor Blue", "o|blue harbor|foods"), ("Deutsche Bank AG", "o|bank deutsche|"), ("Henry Fords", "p|fords|henry"), ("SA Fenimore", "p|fenimore|s."), ("Fenimore SA", "o|fenimore|"),
    ],
)
def test_names_of_every_form(form, want):
    assert [f for _, f in N._forms(form)] == [want]


def registry(spark, *names):
    return spark.createDataFrame([(n, n, [], "person", 0) for n in names], ENT)


def test_slips_are_not_chained(spark):
    chain = ["Robert Hartman", "Robert Hartmann", "Robert Harman", "Robert Herman"]
    assert not N.links(registry(spark, *chain), spark.createDataFrame([], MEN)).count()
    star = ["Kim Hartman", "Kim Hartmann", "Kim Harman", "Lee, Kim", "Kim Lee", "Kim Leo"]
    got = {tuple(r) for r in N.links(registry(spark, *star), spark.createDataFrame([("m", "Kim Hartmam", 0)], MEN)).collect()}
    assert {("Kim Hartman", "Kim Hartmann"), ("Kim Harman", "Kim Hartmann"), ("Kim Lee", "Lee, Kim")} <= got and ("Kim Harman", "m") in got


def test_slip_in_a_very_long_name(spark):
    rng = random.Random(4)
    long = "".join(rng.choice(string.ascii_lowercase) for _ in range(3000))
    for other in (long[:70] + long[71:], long[:2990] + "q" + long[2990:], long[:1500] + long[1501] + long[1500] + long[1502:], long):
        assert N.slips(long) & N.slips(other) and N.near(long, other)
    got = N.links(registry(spark, f"Anna {long}", f"Anna {long[:70] + long[71:]}", f"Anna {long[::-1]}"), spark.createDataFrame([], MEN))
    assert got.count() == 1


ENT = "id string, name string, aliases array<string>, entity_type string, extra int"
MEN = "mention_id string, surface_form string, id int"


def test_name_links(spark):
    ents = [
        ("e1", "Robert Fenimore", ["Bob"], "person", 1), ("e2", "Fenimore, Bob", None, "person", 1), ("e3", "Alice Fenimore", [], "person", 1), ("e4", "Robert Fenimroe", [None, ""], "person", 1), ("e4", "Robert Fenimroe", [], "person", 1),
        ("o1", "Zabok National Engineering Ltd", ["ZNEL"], "organization", 1), ("o2", "Zabok Natl Eng.", [], "organization", 1), ("o3", "Zabok National Systems", [], "organization", 1), ("n1", None, None, None, 1), ("d1", "Fenimore X13", [], "device", 1), (None, "Robert Fenimore", [], "person", 1),
    ]
    men = [("m1", "Rob Fenimore", 1), ("m2", "Robert Fenimore", 1), ("m3", "Fenimore", 1), ("m4", "F. Fenimore", 1), ("m5", None, 1), ("m6", "The Zabok National Enginering", 1), ("m1", "Rob Fenimore", 1), ("m7", "ZNEL", 1), ("m8", "A. Fenimore", 1)]
    got = {tuple(r) for r in N.links(spark.createDataFrame(ents, ENT), spark.createDataFrame(men, MEN)).collect()}
    assert got == {("e1", "e2"), ("e1", "e4"), ("e2", "e4"), ("o1", "o2"), ("e1", "m1"), ("o1", "m6"), ("e3", "m8")}
    assert N.links(spark.createDataFrame([], ENT), spark.createDataFrame(men, MEN)).count() == 0


# ------------------------------------------------------------------ 3: near-duplicates
def vocabulary(rng, n):
    return ["".join(rng.choice(string.ascii_lowercase) for _ in range(5)) for _ in range(n)]


def made_texts():
    """Template texts with shared phrases, and edited copies of some."""
    rng = random.Random(5)
    vocab = vocabulary(rng, 60)
    phrases = [" ".join(rng.choice(vocab) for _ in range(rng.randint(4, 9))) for _ in range(25)]
    texts = [". ".join(rng.choice(phrases) if rng.random() < 0.5 else " ".join(rng.choice(vocab) for _ in range(7)) for _ in range(rng.randint(2, 9))) for _ in range(260)]
    for t in texts[:120]:
        ws = t.split()
        for _ in range(rng.randint(1, 4)):
            way, i = rng.randint(0, 3), rng.randrange(len(ws))
            if way == 0:
                ws[i] = rng.choice(vocab)
            elif way == 1 and len(ws) > 5:
                del ws[i]
            elif way == 2:
                ws.insert(i, rng.choice(vocab))
            else:
                ws = ws[i:] + ws[:i]
        texts.append(" ".join(ws).upper() if rng.random() < 0.2 else " ".join(ws))
    return texts + texts[:5] + ["", "too short", texts[0] + " !!"]


def brute_pairs(rows, threshold, least=12):
    sets = [(i, (lambda w: set(zip(w, w[1:], w[2:])))(D.words(t))) for i, t in rows if t and len(D.words(t)) >= least]
    return {(min(a, b), max(a, b)) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if len(x & y) / len(x | y) >= threshold and a != b}


@pytest.mark.parametrize("threshold, hot", [(0.6, 32), (0.6, 3), (0.8, 3)])
def test_near_duplicates_match_brute_force(spark, threshold, hot):
    rows = [(f"d{i:04d}", t) for i, t in enumerate(made_texts())]
    df = spark.createDataFrame([("content", i, t, 0) for i, t in [*rows, *rows[:20], ("dn", None)]] + [("content", None, rows[0][1], 0)], "field string, id string, text string, n int")
    got = {(r.left_id, r.right_id) for r in D.pairs(*D.links(df, threshold, 12, hot)).collect()}
    assert got == brute_pairs(rows, threshold)


@pytest.mark.parametrize("hot", [D.HOT, 1])
def test_near_duplicates_of_lists_in_another_order(spark, hot):
    lists = []
    for k, ws in enumerate(["bank vet school dentist", "baker tailor plumber lawyer surgeon cobbler", "king queen bishop knight rook pawn herald jester"]):
        items = [f"call the {w}." for w in ws.split()]
        lists += [(f"a{k}", " ".join(items)), (f"b{k}", " ".join(items[::-1]))]
    want = brute_pairs(lists, 0.6)
    assert len(want) == 3
    docs = spark.createDataFrame([("content", i, t) for i, t in lists], "field string, id string, text string")
    assert {(r.left_id, r.right_id) for r in D.pairs(*D.links(docs, 0.6, hot=hot)).collect()} == want


def test_near_duplicates_empty(spark):
    found, members = D.links(spark.createDataFrame([], "field string, id string, text string"), 0.6)
    assert D.pairs(found, members).count() == 0 and D.groups(found, members).count() == 0


def test_walk_is_exact():
    rng = np.random.default_rng(1)
    left = np.unique(rng.integers(0, 60, 30))
    rights = [np.unique(rng.integers(0, 60, n)) for n in rng.integers(1, 50, 200)] + [left, left]
    for t in (0.3, 0.6):
        for r, s in zip(rights, D._walk(left, rights, t)):
            both = len(np.intersect1d(left, r))
            j = both / (len(left) + len(r) - both)
            assert s == (pytest.approx(j) if j >= t else -1)


def test_walk_judges_every_size_below_a_cut():
    left = np.arange(1, 21)
    longer, shorter = np.arange(2, 35), np.array([*range(2, 21), 35])
    assert D._walk(left, [longer, shorter], 0.6) == [-1, pytest.approx(19 / 21)]


# ------------------------------------------------------------------ 4: pairs
@pytest.mark.parametrize("reply, want", [(None, True), ("", True), (" \n", True), ("...", True), ("<p></p>", True), ("N/A", True), ("(no response)", True), ("Yes", False), ("No, not yet", False), ("None of them came.", False), ("7", False)])
def test_says_nothing(reply, want):
    assert P.says_nothing(reply) is want


@pytest.fixture(scope="module")
def turns():
    return pd.read_parquet("/root/testdata/sf0.01/turns.parquet").drop_duplicates("turn_id")


@pytest.fixture(scope="module")
def table():
    d = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    named = [(t, L.label(x)) for t, x in zip(d.text, d.lang) if L.label(x) in L.LANGUAGES]
    return L.train([t for t, _ in named], [k for _, k in named])


def test_language_of_the_whole_text(table):
    f = P.Featuriser(*table, {})
    english, german = "the weather in the north was cold and the people stayed at home. ", "das Wetter im Norden war kalt und die Leute blieben alle zu Hause. "
    text = english * (110_000 // len(english)) + german * (330_000 // len(german))
    assert f.langs[int(np.argmax(f.speak(text[:100_000])))] == "en"
    assert f.langs[int(np.argmax(f.speak(text)))] == "de"


def test_made_defects_are_found(turns, table):
    full = turns.dropna(subset=["user_message", "assistant_reply"])
    model = P.train(list(zip(full.user_message, full.assistant_reply))[:700], *table)
    assert min(model.held_out.values()) > 0.85
    m = "When did my uncle sell the green boat near the harbour?"
    got = model.judge([(m, None), (m, m.upper()), (m, "I'm sorry, but I must decline to go further here."), (m, "Gestern haben wir den Kalender im Keller verkauft, obwohl niemand damit gerechnet hatte."), (m, ""), (None, "Yes"), ("", "")])
    assert got[:5] == ["empty", "copy", "refusal", "other_language", "empty"] and got[6] == "empty"
    assert model.judge([]) == []


#: Refusals in wordings that the training grammar does not make.
UNSEEN = (
    "I'm going to have to pass on this one.|Sorry, that isn't something I can assist with.|I don't think I should answer that.|That's not a subject I'm able to speak to.|I'm sorry, I can't go along with this.|Answering this would be against my rules."
    "|No, I won't write that.|I'm not going to discuss that matter.|Unfortunately I am unable to fulfil this request.|I have been told not to talk about this.|Sorry, but no: I can't produce this kind of text.|I am not the right one to advise you on this, so I will leave it there."
    "|Das kann ich dir leider nicht sagen, dazu bin ich nicht befugt.|Hierzu gebe ich keine Auskunft.|Je préfère ne pas aborder ce sujet.|Prefiero no hablar de ese asunto.|Prefiro não falar desse assunto.|Preferisco non parlare di questo argomento."
    "|Daar ga ik liever niet op in.|Jag avstår från att kommentera det."
).split("|")


def test_refusals_in_unseen_words(turns, table):
    """Recall on held-out wordings, and sound answers that look like them."""
    full = turns.dropna(subset=["user_message", "assistant_reply"])
    model = P.train(list(zip(full.user_message, full.assistant_reply)), *table)
    m = "When did my uncle sell the green boat near the harbour?"
    found = [d == "refusal" for d in model.judge([(m, r) for r in UNSEEN])]
    assert sum(found) >= 0.8 * len(UNSEEN), [r for r, f in zip(UNSEEN, found) if not f]
    sound = ["I could not find the boat in your notes.", "Your uncle refused to sell it.", "- milk\n- bread\n- two lemons", "He sold it in May", "Unfortunately, it was sold before the storm."]
    assert model.judge([(m, r) for r in sound]).count("refusal") == 0


def test_word_counts_cover_all_turns(spark, monkeypatch):
    monkeypatch.setattr(P, "_FLUSH", 3)
    rows = [(i, "See the boat\nnow", "The boat left. The boat", 0) for i in range(10)] + [(99, None, None, 0)]
    known = P.endings(spark.createDataFrame(rows, "turn_id int, user_message string, assistant_reply string, w int"))
    assert known["the"] == (30, 0, 0) and known["left"] == (10, 10, 0) and known["the boat"] == (30, 0, 20) and known["now"] == (10, 0, 10)
    assert P.endings(spark.createDataFrame([], "user_message string, assistant_reply string")) == {}


# ------------------------------------------------------------------ 5: personal information
@pytest.mark.parametrize(
    "text, want",
    [
        ("write to a.b+c@mail.example.org, please", [("email", "a.b+c@mail.example.org")]), ("bob77 [at] host [dot] example", [("email", "bob77 [at] host [dot] example")]), ("ana_x at host dot example dot net now", [("email", "ana_x at host dot example dot net")]),
        ("Ring +49 (0)30 23125-976 now.", [("phone", "+49 (0)30 23125-976")]), ("call (365) 555-0148 after six", [("phone", "(365) 555-0148")]), ("Order 084-3202-28 shipped", []), ("Build 4.87.555.0321 fixed it", []),
        ("Passport no. 981-45-3034 runs out", [("id_number", "981-45-3034")]), ("The insurance number is QQ 17 21 63 A, ok", [("id_number", "QQ 17 21 63 A")]), ("Ticket #739532956 is open", []),
        ("We moved to Flat 4, 112b Zujajeso St, please", [("street_address", "112b Zujajeso St")]), ("in der Sulogetulstraße 63, zweiter Stock", [("street_address", "Sulogetulstraße 63")]), ("habitons 149, rue des Motujavi, au fond", [("street_address", "149, rue des Motujavi")]),
        ("Please add Dr. Vega-Lun, Kathy to the list", [("name", "Vega-Lun, Kathy")]), ("coffee with Bob T. Harmenos today", [("name", "Bob T. Harmenos")]), ("Bob said hello to Zabok Foods Ltd.", []), ("", []), (None, []),
    ],
)
def test_items(text, want):
    assert [(k, text[a:b]) for a, b, k in pii.find(text)] == want


KEY = b"of the tests"


def test_feistel_round_trip():
    rng = random.Random(2)
    for n in range(1, 17):
        seen = set()
        for _ in range(40):
            d = "".join(rng.choice("0123456789") for _ in range(n))
            p = Y.permute(d, KEY)
            assert len(p) == n and Y.permute(p, KEY, inverse=True) == d
            seen.add((d, p))
        assert len({p for _, p in seen}) == len({d for d, _ in seen})
    assert {Y.permute(f"{i:02d}", KEY) for i in range(100)} == {f"{i:02d}" for i in range(100)}


def test_redaction_keeps_the_rest_and_links_equal_values():
    text = "Ring (365) 555-0148 or 365.555.0148; ask Bob Harmenos."
    out = pii.redact(text, KEY)
    assert re.fullmatch(r"Ring \[PHONE \(\d{3}\) \d{3}-\d{4}\] or \[PHONE \d{3}\.\d{3}\.\d{4}\]; ask \[NAME [a-z2-7]{16}\]\.", out)
    a, b = re.findall(r"\[PHONE ([^\]]*)\]", out)
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) != "3655550148"
    assert pii.redact(None, KEY) is None and pii.redact("", KEY) == "" and pii.redact("plain words " * 50_000, KEY).endswith("words ")
    assert out != pii.redact(text, b"another key")


def test_pseudonyms_link_values_in_every_format():
    digits = lambda v: re.sub(r"\D", "", v)
    for a, b in (("+1 415-555-2671", "415-555-2671"), ("+44 7700 900357", "07700 900357"), ("+49 (0)30 23125-976", "030/23125 976"), ("0033 1 99 00 62 61", "+33 1 99 00 62 61"), ("(365) 555-0148", "+13655550148")):
        x, y = (Y.national(Y.phone(v, KEY))[1] for v in (a, b))
        assert x == y != Y.national(a)[1] and Y.phone(Y.phone(a, KEY), KEY, inverse=True) == a
        assert digits(Y.phone(a, KEY))[: Y.national(a)[0]] == digits(a)[: Y.national(a)[0]]
    same = [("email", "a.b at host dot example", "A.B@host.example"), ("email", "a.b [at] host [dot] example", "a.b@host.example"), ("name", "Fenimore, Bob", "Robert Q. Fenimore"), ("street_address", "112 Zujajeso St.", "112 zujajeso street")]
    assert all(Y.pseudonym(k, a, KEY) == Y.pseudonym(k, b, KEY) for k, a, b in same)
    assert Y.pseudonym("street_address", "112 Zujajeso St.", KEY) != Y.pseudonym("street_address", "113 Zujajeso St.", KEY)
    house = Y.pseudonym("street_address", "112b Zujajeso St", KEY).split()[0]
    assert re.fullmatch(r"[1-9]\d\d", house) and Y.walk(house, KEY, Y._no_zero_first, inverse=True) == "112"


@pytest.mark.parametrize("value", ["4539 1488 0343 6467", "981-45-3034", "123-45-6789", "QQ 17 21 63 A", "811228-9874", "811228-9875", "131052-308T", "468398-X549", "046 454 286", "X10703806", "00000000", "7"])
def test_valid_numbers_stay_valid(value):
    out = Y.id_number(value, KEY)
    d, e = (re.sub(r"\D", "", v) for v in (value, out))
    assert re.sub(r"\d", "#", out) == re.sub(r"\d", "#", value) and Y.luhn(d) == Y.luhn(e) and (len(d) != 9 or Y.social(d) == Y.social(e) or "-" in value[6:7])
    assert Y.id_number(out, KEY, inverse=True) == value
    if value.startswith(("8", "13")):
        assert Y._six(e, Y._order(value))


def test_dates_are_permuted_in_their_format():
    assert Y.date_pseudonym("2021-02-30", KEY) is None and Y.date_pseudonym("soon", KEY) is None
    for value in ("1984-03-07", "07.03.1984", "7/3/1984", "2000-02-29"):
        out = Y.date_pseudonym(value, KEY)
        back = Y.date_pseudonym(out, KEY, inverse=True)  # zeros before days and months may differ
        assert Y._DATE.fullmatch(out) and [int(x) for x in re.findall(r"\d+", back)] == [int(x) for x in re.findall(r"\d+", value)]
    text = "She was born on 07.03.1984 and moved on 08.03.2001."
    assert pii.redact(text, KEY) == text and re.fullmatch(r"She was born on \[DATE \d\d\.\d\d\.\d{4}\] and moved on 08.03.2001.", pii.redact(text, KEY, dates=True))
    assert Y.date_pseudonym("1984-03-07", KEY)[:4] == Y.date_pseudonym("07.03.1984", KEY)[-4:]


def test_names_of_no_list_are_recognised(turns):
    blocks = pd.read_parquet("/root/testdata/sf0.01/memory_blocks.parquet").content.dropna().tolist()
    model = pii.recogniser([*blocks, *turns.user_message.dropna()])
    assert model.recall > 0.8
    assert [pii.find(t, model) for t in ("We stayed at Harbour Bridge for a week.", "Zabok Foods sent a quote for the repairs.", "")] == [[], [], []]
    # the same texts with given names of no list
    new, n, hit = ["Ngozi", "Xiaoming", "Fatima", "Hiroshi", "Oluwaseun"], 0, 0
    for i, text in enumerate(blocks):
        for a, b, kind in pii.find(text):
            first, _, last = text[a:b].partition(" ")
            if kind == "name" and first.istitle() and last.isalpha() and last.istitle():
                other = f"{text[:a]}{new[i % 5]} {last}{text[b:]}"
                span = (a, a + len(new[i % 5]) + 1 + len(last), "name")
                if span not in pii.find(other):  # not found by rule alone
                    n += 1
                    hit += span in pii.find(other, model)
    assert n > 100 and hit > 0.8 * n


def test_items_frame(spark):
    df = spark.createDataFrame([("t", "f", "1", "mail x@y.example", 0), ("t", "f", "1", "mail x@y.example", 0), ("t", "f", None, None, 0), ("t", "f", "2", "", 0)], "src_table string, src_field string, row_id string, text string, pii_type int")
    assert [tuple(r) for r in pii.items(df).collect()] == [("t", "f", "1", "email", "x@y.example")]
    assert pii.redacted(df, KEY).count() == 4
    assert pii.scan(df, KEY).first().pseudonym == Y.pseudonym("email", "x@y.example", KEY)
    assert pii.items(spark.createDataFrame([], df.schema)).count() == 0


# ------------------------------------------------------------------ 6: leaks
def test_leaks_match_brute_force(spark):
    rng = random.Random(9)
    vocab = vocabulary(rng, 400)
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(60), text(12) + "?", 0) for i in range(30)] + [(30, None, "too short?", 0), (31, "", None, 0)]
    items.append((32, items[0][1], text(9), 0))
    docs = []
    for d in range(200):
        words = text(80).split()
        for _ in range(rng.randint(0, 2)):
            src = (rng.choice(items[:30])[rng.choice([1, 2])]).split()
            n = rng.randint(6, 12)
            at = rng.randint(0, max(0, len(src) - n))
            words[rng.randint(0, 70) : 72] = src[at : at + n]
        docs.append((d, ", ".join(words).upper() if d % 5 == 0 else " ".join(words), 0))
    docs += [(900, None, 0), (901, "", 0), (0, docs[0][1], 0)]
    got = {(r.doc_id, r.item_id) for r in K.find(spark.createDataFrame(docs, "doc_id bigint, text string, item_id int"), spark.createDataFrame(items, "item_id bigint, passage string, question string, n int")).filter("run_words >= 8").collect()}
    runs = lambda t: (lambda w: {tuple(w[i : i + 8]) for i in range(len(w) - 7)})(K._WORD.findall((t or "").lower()))
    own = {i: runs(p) | runs(q) for i, p, q, _ in items}
    assert got == {(d, i) for d, t, _ in docs for i, r in own.items() if r & runs(t)}
    assert got


def test_leak_with_one_edit_is_near():
    item = "the heavy monitor stood beside the window until march"
    docs = [f"First words here. {item.upper()}, and more.", f"Some talk. {item.replace('beside', 'besides')} and more.", f"None of {item[:20]} it.", ""]
    found = K.leaked([K.normalise(d) for d in docs], K.Index([K.normalise(item)]))
    assert found[0][0][3] == 9 and found[1][0][3] == 0 and set(found) == {0, 1}
    assert K.leaked([K.normalise(d) for d in docs], K.Index([])) == {}


def test_many_items_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_CHARS", 100)
    text = lambda k: " ".join(f"w{k}{c}" for c in "abcdefghij")
    items = spark.createDataFrame([(k, text(k), None) for k in range(9)], "item_id bigint, passage string, question string")
    docs = spark.createDataFrame([(k, "see " + text(k)) for k in range(9)], "doc_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in K.find(docs, items).collect()} == {(k, k) for k in range(9)}


def test_alignment_counts_edits():
    a, b = "the quick brown fox jumps over the lazy dog", "the quick brown cat jumps over the lazy dog"
    m, e, end = K.align(a, b, 0, 4)
    assert m == len(a) - 3 and e == 3 and end == len(a)


# ------------------------------------------------------------------ 7: mixing
DOCS = "doc_id bigint, source string, text string, target_share int"
WEIGHTS = "source string, target_share double, max_repeats int, doc_id int"


def test_mixing(spark):
    rng = random.Random(1)
    spell = ["news", "News ", "NEWS", "nEws"]
    docs = [(i, rng.choice(spell), "word " * rng.randint(5, 60), 0) for i in range(600)] + [(1000 + i, "web-clip", "word " * 30, 0) for i in range(200)] + [(2000 + i, "rare", "word " * 20, 0) for i in range(5)] + [(3000, None, "word " * 500, 0), (3001, "news", None, 0), (3002, "zzqqxxyy", "word", 0)]
    weights = [("news", 0.5, 1, 0), ("web_clip", 0.3, 3, 0), ("rare", 0.2, 2, 0)]
    mixture, shares = M.mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame(weights, WEIGHTS), total_tokens=12_000)
    s = {r.source: r for r in shares.collect()}
    assert abs(s["news"].mixed_tokens - 6000) < 200 and abs(s["web_clip"].mixed_tokens - 3600) < 200
    assert not s["rare"].reachable and s["rare"].mixed_tokens == 2 * s["rare"].available_tokens
    rows = mixture.collect()
    cap = {"news": 1, "web_clip": 3, "rare": 2}
    assert all(0 <= r.repeats <= cap[r.source] for r in rows)
    assert {r.doc_id for r in rows} == {d for d, src, t, _ in docs if src and t and src != "zzqqxxyy"}


def test_fit_of_overlapping_domains(spark):
    """Three classes of which one belongs to both domains: rates follow from least squares, not from division."""
    classes = spark.createDataFrame([(1, [1.0, 0.0], 1.0, 1000.0), (2, [0.0, 1.0], 9.0, 100.0), (3, [0.25, 0.75], 2.0, 800.0)], "class bigint, posterior array<double>, cap double, n_tokens double")
    rated, reached = M.fit(classes, [("a", 0.5, 9), ("b", 0.5, 9)], 2000.0)
    assert np.allclose(reached, [1000, 1000], rtol=1e-3)
    rate = {r["class"]: r["rate"] for r in rated.collect()}
    assert abs(1000 * rate[1] + 200 * rate[3] - 1000) < 2 and abs(100 * rate[2] + 600 * rate[3] - 1000) < 2 and rate[3] > 0.2
    # of what cannot be reached the nearest is taken: more of b brings more of a with it
    rated, reached = M.fit(classes.filter("class = 3"), [("a", 0.0, 9), ("b", 1.0, 9)], 1600.0)
    best = min((r / 1000 for r in range(2001)), key=lambda r: (200 * r) ** 2 / 200 + (1600 - 600 * r) ** 2 / 600)
    assert abs(rated.first()["rate"] - best) < 0.01


def test_soft_mixing(spark):
    """Documents between two domains belong to both, whatever their label."""
    rng = random.Random(2)
    a, b = vocabulary(rng, 60), vocabulary(rng, 60)
    text = lambda *v: " ".join(rng.choice(rng.choice(v)) for _ in range(40))
    docs = [(i, "a", text(a), 0) for i in range(150)] + [(1000 + i, "b", text(b), 0) for i in range(150)] + [(2000 + i, "ab"[i % 2], text(a, b), 0) for i in range(150)] + [(3000, None, text(a), 0), (3001, None, None, 0)]
    df, weights = spark.createDataFrame(docs, DOCS), spark.createDataFrame([("a", 0.5, 4, 0), ("b", 0.5, 4, 0)], WEIGHTS)
    mixture, shares = M.mix(df, weights, total_tokens=40_000, membership="text")
    s = {r.source: r for r in shares.collect()}
    assert all(abs(r.actual_share - 0.5) < 0.02 and abs(r.mixed_tokens - 20_000) < 800 for r in s.values())
    post = {r.doc_id: r.posterior for r in M.members(df, [("a", 0.5, 4), ("b", 0.5, 4)], f"{M.TOKENIZER_DIR}/{M.TOKENIZER_FILE}", "text").collect()}
    assert sum(max(post[2000 + i]) < 0.95 for i in range(150)) > 75 and sum(max(post[i]) > 0.9 for i in range(150)) > 120
    assert 3000 in {r.doc_id for r in mixture.collect()}


def test_mixing_empty(spark):
    mixture, shares = M.mix(spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 1, 0)], WEIGHTS))
    assert mixture.count() == 0 and shares.first().actual_share is None


# ------------------------------------------------------------------ 8: languages
@pytest.mark.parametrize("lang, want", [("en-GB", "en"), (" DE ", "de"), ("Swedish", "sv"), ("por", "pt"), ("und", None), ("", None), (None, None), ("unknown", None), ("ja", "ja")])
def test_labels(lang, want):
    assert L.label(lang) == want


def test_segments(table):
    en, de, sv = "The neighbours sold the old bicycle at the station because the price was too high.", "Gestern haben wir den Schlüssel im Keller gesucht, obwohl niemand damit gerechnet hatte.", "Förra veckan glömde min bror nyckeln på kontoret eftersom tiden snart är ute."
    assert [s[2] for s in L.segments(f"{en} {en}\n{de} {de} {sv}", *table)] == ["en", "de", "sv"]
    assert [s[2] for s in L.segments(f'{en} He wrote "{sv[:-1]}" on the card.', *table)] == ["en"]
    assert [s[2] for s in L.segments(f"- {de.upper()}\n- {de}", *table)] == ["de"]
    assert L.segments("", *table) == [] and L.segments("12 34 ...", *table) == []
    whole = f"{en} {de} " * 2000
    assert "".join(whole[a:b] for a, b, _, _ in L.segments(whole, *table)) == whole


def test_profile_table_is_the_inner_product():
    base = L.letter_vectors()
    g = L.ngrams(L.letters("the lazy dog of the house"))
    table, names = L.train(["the lazy dog of the house and the garden", "der alte Hund und das Haus im Garten"], ["en", "de"])
    profile = L.ngram_vectors(g, base).sum(0).astype(float)
    n = np.unique(g, return_counts=True)[1]
    cos = table[g].sum(0) / np.sqrt((n * n).sum())
    assert np.allclose(L.piece_scores(["x y", "the lazy dog of the house", "", "a"], table)[0][1], cos)
    assert abs(np.linalg.norm(profile) / np.sqrt(L.DIM) / np.sqrt((n * n).sum()) - 1) < 0.2
    assert names[int(np.argmax(cos))] == "en"


def test_texts_together_are_judged_as_alone(table):
    texts = ["", "Good morning. Wie geht es dir heute?\nJe ne sais pas.", "a\0b", "12", "Ångström e\u0301te\u0301 och så vidare", "x" * 3000]
    assert [L.segments(t, *table) for t in texts] == L.segment_all(texts, *table, 30.0)


def test_identify_awkward_rows(spark):
    docs = spark.createDataFrame([(1, None, None, 0), (2, "", "en", 0), (3, "one two three", None, 0), (3, "one two three", None, 0)], "doc_id bigint, text string, lang string, seg_no int")
    assert L.identify(docs).count() == 0  # no label to learn from
    assert L.cases(L.identify(spark.createDataFrame([], docs.schema))).count() == 0


def test_tables_of_branches_are_deleted(spark, tmp_path, monkeypatch):
    """What near-duplicate links write on the way goes once the pairs are known; shuffles go with each table."""
    from memspark.llm import near_duplicates

    monkeypatch.setattr("memspark.session.checkpoint_dir", lambda _: str(tmp_path))
    text = " ".join(f"word{k}" for k in range(30))
    docs = spark.createDataFrame([("content", "a", text), ("content", "b", text + " more"), ("content", "c", text.upper())], "field string, id string, text string")
    found, members = near_duplicates.links(docs, 0.6, 12)
    assert {(r.left_id, r.right_id) for r in near_duplicates.pairs(found, members).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    columns = [set(spark.read.parquet(str(p)).columns) for p in tmp_path.iterdir()]
    assert columns and not any(c & {"keys", "ranks", "bits", "blob"} for c in columns)
