"""Broken prompt and response pairs, by a multi-label linear classifier trained on made defects.

Replies of a bounded sample of turns are broken on purpose (cut short, replaced by the message, by a refusal, or by
a reply to a message in another language) and a logistic model per defect is trained on hashed n-grams of the reply
and features of the pair. Thresholds are set on held-out pairs. Refusals are made by a grammar of each language.
How often words stand, and end a sentence, is counted over all turns. A reply that says nothing is found exactly, and
what the classifier leaves open is judged by what is opened and not closed and by the words the message lacks.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm import languages as L
from memspark.llm.samples import bounded
from memspark.session import cut

#: Words from which a reply is long.
LONG = 25
DEFECTS = ("truncated", "refusal", "copy", "other_language")
#: Turns the classifier is trained from, and documents its language profiles are.
SAMPLE, LANGUAGE_SAMPLE = 3000, 1600
HASH_BITS = 18
SEED = 7

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_DIGITS = re.compile(r"\d+")
#: Stand-ins for no value.
STAND_INS = {"none", "null", "nil", "nan", "na", "n a", "undefined", "no response", "no reply", "no output", "empty", "blank", "no content", "missing", "tbd", "void"}


def says_nothing(reply: str | None) -> bool:
    """Null, no letters or digits besides markup, or a stand-in for no value."""
    if reply is None:
        return True
    bare = re.sub(r"<[^<>]*>|&\w+;", " ", reply)
    words = re.findall(r"[^\W_]+", bare.lower())
    return not words or (len(words) <= 3 and " ".join(words) in STAND_INS)


#: Ways to decline, as sentences with alternatives between bars.
REFUSALS = {
    "en": [
        "{I can't|I cannot|I'm unable to|I am not able to|I won't be able to|I am unable to|I'm afraid I cannot|I'm afraid I can't|As an assistant I cannot|As an AI I can't|It is not possible for me to|I'm not in a position to} {help|assist} {you |}with {that|this|this request|that request|it|this one|such a thing}",
        "{I can't|I cannot|I'm unable to|I am not able to|I won't be able to|I'm not allowed to|I am not permitted to|I refuse to|I'd rather not|I would rather not|I would prefer not to|I will not|I must decline to|I have to decline to|My guidelines do not permit me to|My guidelines don't allow me to|My rules do not let me|It would not be appropriate for me to|It would not be right for me to|As an assistant I cannot|As an AI I can't} {answer|answer that|answer this one|respond to this|respond to that question|discuss this|discuss that|talk about this|talk about that topic|get into that topic|go into this|go further here|go on with this|give an opinion on that|share a view on this|comment on that|provide that|share this information|give advice on this|comply with this request|continue|do that|say anything about this|write that for you|take part in this}",
        "{I don't feel comfortable|I am not comfortable|I'm not comfortable} {answering|discussing|writing|sharing|doing|saying} {this|that|that for you|this with you}",
        "{This|That|Your request|This question|This topic} {goes beyond|is outside|lies beyond|is not within} {what I am allowed to do|what I may discuss|what I can help with|the things I may talk about|my limits}",
        "{That|This} is something I {have to|must|need to} {decline|refuse|turn down}",
        "I {have to|must|need to|will have to} {decline|refuse|turn down} {this|that|your} {request|question|wish}",
        "I {must|have to|will have to} {decline|refuse}",
    ],
    "de": [
        "{Ich kann|Leider kann ich|Es tut mir leid, aber ich kann} {dir|Ihnen|} {dabei|damit|hierbei|bei dieser Anfrage} {leider |}nicht {helfen|weiterhelfen|behilflich sein}", "{Dabei|Damit|Bei dieser Frage|Hierbei} kann ich {dir |Ihnen |}{leider |}nicht {helfen|weiterhelfen}",
        "{Ich darf|Ich kann|Ich möchte} {mich |}{dazu|darüber|zu diesem Thema} {leider |}{nichts sagen|nicht äußern|nicht sprechen|keine Auskunft geben}", "{Dazu|Darüber|Zu diesem Thema} {darf|kann|möchte} ich {mich nicht äußern|nichts sagen|keine Auskunft geben}",
        "{Das|Diese Frage|Diese Anfrage} {darf|kann|möchte} ich {leider |}nicht {beantworten|bearbeiten}", "{Diese Anfrage|Diese Bitte|Das} muss ich {leider |}{ablehnen|zurückweisen}", "Ich muss {diese Anfrage|diese Bitte|das} {leider |}{ablehnen|zurückweisen}",
    ],
    "fr": [
        "{Je suis désolé, mais je|Désolé, je|Je} ne {peux|saurais} pas {vous aider|t'aider} {pour cela|avec cela|sur ce point|à ce sujet}", "Je ne {peux|dois|veux} pas {répondre à cette demande|répondre à cette question|vous répondre|en parler|traiter ce sujet}",
        "Je {dois|suis obligé de} {malheureusement |}{refuser|décliner} {cette demande|votre demande|de répondre}", "Il ne m'est pas {permis|possible} de {répondre à ce sujet|répondre|parler de cela|vous aider}", "Je ne suis pas {autorisé à|en mesure de} {en parler|répondre|vous aider|donner cette information}",
    ],
    "es": [
        "{Lo siento, pero no|No|Por desgracia no} puedo {ayudarte|ayudarle} con {eso|esto|esta petición}", "No puedo {responder a esta solicitud|responder a eso|contestar a esa pregunta|hablar de esto|opinar sobre ese tema}",
        "{Tengo que|Debo} {rechazar|declinar} {esta petición|esta solicitud|tu petición}", "No {me está permitido|estoy autorizado a|se me permite} {responder sobre este tema|hablar de esto|responder|dar esa información}",
    ],
    "pt": [
        "{Lamento, mas não|Não|Infelizmente não} posso {ajudar|ajudá-lo} {com isso|nisso|com este pedido}", "Não posso {responder a este pedido|responder a isso|falar sobre este assunto|dar opinião sobre isso}",
        "{Tenho de|Devo} recusar {este pedido|o seu pedido|esta questão}", "Não {me é permitido|estou autorizado a|tenho permissão para} {responder sobre este assunto|falar disso|responder|dar essa informação}", "Peço desculpa, mas não {o posso fazer|posso responder|posso ajudar}",
    ],
    "it": [
        "{Mi dispiace, ma non|Non|Purtroppo non} posso {aiutarti|aiutarla} {con questo|in questo|con questa richiesta}", "Non posso {rispondere a questa domanda|rispondere a questa richiesta|parlare di questo|esprimermi su questo tema}",
        "{Devo|Sono costretto a} {purtroppo |}rifiutare {questa richiesta|la tua richiesta|di rispondere}", "Non {mi è permesso|sono autorizzato a|mi è consentito} {rispondere su questo argomento|parlarne|rispondere|dare queste informazioni}",
    ],
    "nl": [
        "{Het spijt me, maar daar kan ik|Daar kan ik|Helaas kan ik daar} {je |u |}niet {bij|mee} helpen", "Ik kan {je |u |}{hier|daar} {helaas |}niet {mee|bij} helpen", "{Dit verzoek|Deze vraag|Dat} moet ik {helaas |}{weigeren|afwijzen}",
        "{Daar|Hier|Daarover|Hierover} {mag|kan|wil} ik {geen uitspraak over doen|niets over zeggen|niets zeggen|niet op antwoorden}", "Ik {mag|kan} {deze vraag|dit} {helaas |}niet beantwoorden",
    ],
    "sv": [
        "{Tyvärr kan jag inte|Jag kan tyvärr inte|Jag kan inte} {hjälpa till med det|hjälpa dig med det här|svara på den frågan|svara på det}", "{Den här begäran|Den frågan|Det} måste jag {tyvärr |}{avböja|avslå|neka}",
        "Jag {får|kan|vill} inte {uttala mig om det ämnet|uttala mig om det|svara på det|prata om det här}", "{Det|Den frågan} {får|kan} jag {tyvärr |}inte {svara på|prata om|hjälpa till med}",
    ],
}


def one_of(sentence: str, rng: np.random.Generator) -> str:
    """A sentence with one of each group of alternatives."""
    out = re.sub(r"\{([^{}]*)\}", lambda m: (lambda xs: xs[int(rng.integers(0, len(xs)))])(m[1].split("|")), sentence)
    return re.sub(" +", " ", out).strip()


#: Short sound answers, written in the same way.
SHORT = {
    "en": ["{He|She|They|You|It|Your aunt} {sold it|bought it|left|came back|arrived|was late|moved there|lost it|kept it} {in May|last week|on Monday|two days ago|before noon|after the trip|in 2019|by train}", "{In May|On Monday|Last week|Two days ago}{, I think|}", "{The blue one|Your brother|A friend|Both of them|Nobody}{ did| was there|}"],
    "de": ["{Er|Sie} {kam|ging|blieb|verkaufte es} {im Mai|am Montag|letzte Woche|vor zwei Tagen}"], "fr": ["{Il|Elle} est {venu|parti|resté} {en mai|lundi|la semaine dernière|il y a deux jours}"],
    "es": ["{Fue|Llegó|Salió|Lo vendió} {en mayo|el lunes|la semana pasada|hace dos días}"], "pt": ["{Foi|Chegou|Saiu|Vendeu-o} {em maio|na segunda-feira|na semana passada|há dois dias}"],
    "it": ["{È arrivato|È partito|È rimasto} {a maggio|lunedì|la settimana scorsa|due giorni fa}"], "nl": ["{Hij|Zij} {kwam|ging|bleef} {in mei|op maandag|vorige week|twee dagen geleden}"], "sv": ["{Han|Hon} {kom|gick|stannade} {i maj|på måndagen|förra veckan|för två dagar sedan}"],
}
BEFORE = ["", "", "Sorry, ", "I'm sorry, but ", "Unfortunately, ", "Apologies, ", "To be honest, ", "Thanks for asking, but ", "I understand why you ask, however "]
AFTER = ["", "", ".", " at this time.", ", and I hope you understand.", ". Please ask a qualified person instead.", ". Is there anything else you would like to talk about?", ". Let's talk about something different."]
#: What may follow a refusal in the other languages.
ELSE = {
    "de": ", bitte {wenden Sie sich an|wende dich an|fragen Sie|frag} {eine Fachperson|jemand anderen|eine Beratungsstelle}", "fr": ", {adressez-vous à|demandez plutôt à|veuillez consulter} {un spécialiste|un professionnel|quelqu'un d'autre}",
    "es": ", {consulta a|pregunta a|es mejor hablar con} {un profesional|un especialista|otra persona}", "pt": ", {consulte|pergunte a|é melhor falar com} {um profissional|um especialista|outra pessoa}", "it": ", {rivolgiti a|chiedi a|è meglio parlare con} {un esperto|un professionista|qualcun altro}",
    "nl": ", {vraag het aan|neem contact op met|raadpleeg} {een deskundige|een specialist|iemand anders}", "sv": ", {fråga|vänd dig till|tala med} {en sakkunnig|en fackman|någon annan}",
}
#: Sound sentences that look like refusals.
SOUND = (
    "Unfortunately, the {x} was sold before you arrived.|I'm sorry to hear that the {x} broke.|You can't return the {x} after two weeks.|You said you are not able to carry the {x} alone.|You never told me about the {x}, so I don't know."
    "|I don't have any note about the {x} yet.|The shop declined to repair the {x}, and you decided to keep it.|I could not find the {x} in your notes.|There is nothing about the {x} in memory.|You asked me not to mention the {x}.|Sorry, the {x} is on Tuesday, not on Monday."
    "|My manager refused to sign the {x}.|I cannot find an entry about the {x}.|You are not allowed to park the {x} there, you said."
).split("|")
#: The names of the languages, in several of them, in requests for an answer in one.
NAMED = {
    "en": "english englisch anglais inglés inglês inglese engels engelska", "de": "german deutsch allemand alemán alemão tedesco duits tyska", "fr": "french französisch français francés francês francese frans franska",
    "es": "spanish spanisch espagnol español espanhol spagnolo spaans spanska", "pt": "portuguese portugiesisch portugais portugués português portoghese portugees portugisiska", "it": "italian italienisch italien italiano italiaans italienska",
    "nl": "dutch niederländisch néerlandais neerlandés holandês olandese nederlands nederländska holländisch", "sv": "swedish schwedisch suédois sueco svedese zweeds svenska",
}
_NAMED = {w: k for k, ws in NAMED.items() for w in ws.split()}
ASK = ["Answer in {} please. ", "Please translate this into {}: ", "How would I put this in {}? ", "Reply in {}: ", "Translate to {}: ", "Say it in {}, please. "]


def _pieces(text: str) -> set[str]:
    return {text[i : i + 4] for i in range(len(text) - 3)}


class Featuriser:
    """Features of (message, reply): hashed n-grams as indices, and pair features as numbers."""

    def __init__(self, table: np.ndarray, langs: tuple[str, ...], known: dict[str, tuple[int, int, int]]):
        """known: how often a word or two words stand in the turns, and how often at a sentence's end, with and without a stop."""
        self.table, self.langs, self.known = table, langs, known
        self.keys = sorted(known)

    def cut_word(self, two: str) -> bool:
        """Whether two words, which stand nowhere but at such ends, become known ones if the second goes on."""
        i = bisect_right(self.keys, two)
        return " " in two and i < len(self.keys) and self.keys[i].startswith(two) and self.known[self.keys[i]][0] >= 4

    def pairs(self, both: list[tuple[str, str]]) -> np.ndarray:
        """A row of features for each (message, reply); the languages of all texts are judged together."""
        rows: list[list[float]] = []
        at = 0
        while at < len(both):
            end, size = at, 0
            while end < len(both) and size < L.LETTERS:
                size += len(both[end][0]) + len(both[end][1])
                end += 1
            spoken = self.speaks([t for pair in both[at:end] for t in pair])
            rows += [self.pair(m, r, spoken[2 * i], spoken[2 * i + 1]) for i, (m, r) in enumerate(both[at:end])]
            at = end
        return np.array(rows, np.float32).reshape(-1, N_PAIR)

    def pair(self, message: str, reply: str, *s: np.ndarray | None) -> list[float]:
        m, r = _WORD.findall(message.lower()), _WORD.findall(reply.lower())
        cm, cr = Counter(m), Counter(r)
        both = sum((cm & cr).values())
        covered, covers = both / max(1, len(r)), both / max(1, len(m))
        # typos count less: characters of both, only where words are much alike
        alike = 0.0
        if covers > 0.3 or (0.5 < len(reply) / max(1, len(message)) < 2 and both):
            a, b = _pieces(" ".join(m)), _pieces(" ".join(r))
            alike = 2 * len(a & b) / max(1, len(a) + len(b))
        extra = len(r) - both
        novel = len(cr.keys() - cm.keys()) / max(1, len(cr))
        gap = 0.0
        asked = {_NAMED[w] for w in m if w in _NAMED}
        if s[0] is not None and s[1] is not None:
            i, j = int(np.argmax(s[0])), int(np.argmax(s[1]))
            if i != j:
                gap = min(s[1][j] - s[1][i], s[0][i] - s[0][j])
        told = gap > 0 and s[1] is not None and self.langs[int(np.argmax(s[1]))] in asked
        tail = reply.rstrip()
        ending = [_DIGITS.sub("0", w) for w in r[-2:]]
        last = ending[-1] if r else ""
        final = tail[-1:] in ".!?。" and not tail.endswith(("...", "…"))
        body = re.sub(r"```.*?```", "", tail, flags=re.S) if "```" in tail else tail
        fence = tail.count("```") % 2
        brackets = sum(body.count(o) - body.count(c) for o, c in ("()", "[]", "{}"))
        quotes = body.count('"') % 2 or body.count("“") > body.count("”") or body.count("«") > body.count("»") or (body.count("„") > body.count("“") + body.count("”"))
        seen, ends, bare = self.known.get(last, (0, 0, 0))
        two = " ".join(ending)
        seen2, ends2, bare2 = self.known.get(two, (0, 0, 0))
        stop = final or not last or last.isdigit()
        inside = not stop and seen2 <= bare2 and self.cut_word(two)
        unknown = not stop and seen <= bare  # nowhere but at such an end
        never = not stop and seen >= 8 and ends <= 0.002 * seen and bare <= 0.05 * seen
        seldom = 0.0 if stop else min(1.0, seen / 5) * (1 - min(1.0, ends / max(1, seen) * 4))
        strange = not stop and len(r) > 6 and ends2 == 0
        return [
            1.0, covered, covers, float(covered > 0.9 and covers > 0.8), alike, float(alike > 0.8), min(3.0, extra / max(1, len(m))), float(extra == 0), np.log1p(len(r)) / 5, np.log1p(len(m)) / 5,
            max(0.0, gap) * 5, float(gap > 0.08) * (not told), float(gap > 0.03) * (not told), float(told), float(bool(asked)), float(final), float(bool(fence)), float(brackets > 0), float(bool(quotes)),
            float(unknown), float(tail.endswith(("...", "…", "[…]", "[...]"))), float(tail.endswith((",", ";", " -", "(", "and", "/"))), float(tail.endswith((":)", ":-)", ";)", "🙂", "😊"))), float(not final and len(r) > 6), float(len(r) <= 4),
            float(bool(re.search(r"\n\s*(?:\d+[.)]|[-*•])\s*$", reply))), float(never), seldom, float(strange), float(not stop and seen2 <= bare2), novel, float(novel < 0.15 and covers > 0.8), float(inside), float(tail.endswith((",", ";", "("))),
            float(not stop and bare2 >= 3 and ends2 == 0 and (tail[-1:].isalnum() or tail.endswith(("…", "...", "]"))) and len(_WORD.findall(tail.rsplit("\n", 1)[-1])) >= 5),
        ]

    def speaks(self, texts: list[str]) -> list[np.ndarray | None]:
        """The whole texts' cosines with the languages, or None of texts too short to tell."""
        if len(self.langs) < 2:
            return [None] * len(texts)
        sums, n, _, _ = L.piece_sums(texts, self.table)
        return [row if k >= 12 else None for row, k in zip(sums / np.sqrt(np.maximum(1, n))[:, None], n.tolist())]

    def speak(self, text: str) -> np.ndarray | None:
        return self.speaks([text])[0]

    def grams(self, reply: str) -> np.ndarray:
        tail = reply.rstrip()
        words = _WORD.findall(_DIGITS.sub("0", reply.lower()))
        last = tail[-1:]
        end = "." if last in ".!?" else "w" if last.isalnum() else last
        keys = [f"1{w}" for w in words] + [f"2{a} {b}" for a, b in zip(words, words[1:])] + [f"3{a} {b} {c}" for a, b, c in zip(words, words[1:], words[2:])]
        keys += [f"e{end}|{' '.join(words[-k:])}" for k in (1, 2, 3, 4)] + [f"E{end}", f"s{' '.join(words[:2])}", f"s{' '.join(words[:3])}", f"S{words[-1][-3:] if words else ''}{end}", f"t{tail[-4:]}", f"n{min(len(words), 12)}"]
        return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(k) >> (64 - HASH_BITS) for k in keys), np.int64, len(keys)))


N_PAIR = 35


#: Places of pair features.
_COVERS, _FINAL, _FENCE, _BRACKET, _QUOTE, _LONG, _MARK, _NEVER, _NOVEL, _INSIDE, _COMMA, _OPEN = 2, 15, 16, 17, 18, 23, 25, 26, 30, 32, 33, 34


class Model:
    """Logistic regressions of the defects, trained by AdaGrad; probabilities are calibrated on held-out pairs."""

    def __init__(self, features: Featuriser):
        self.features = features
        self.sparse = np.zeros((1 << HASH_BITS, len(DEFECTS)), np.float32)
        self.dense = np.zeros((N_PAIR, len(DEFECTS)), np.float32)
        self.threshold = np.zeros(len(DEFECTS))

    def encode(self, pairs: list[tuple[str, str]]) -> tuple[list[np.ndarray], np.ndarray]:
        return [self.features.grams(r) for _, r in pairs], self.features.pairs(pairs)

    def raw(self, grams: list[np.ndarray], pair: np.ndarray) -> np.ndarray:
        out = pair @ self.dense
        for i, g in enumerate(grams):
            if len(g):
                out[i] += self.sparse[g].sum(0) / np.sqrt(len(g))
        return out

    def fit(self, grams: list[np.ndarray], pair: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 0.15) -> None:
        rng = np.random.default_rng(SEED)
        hold = rng.random(len(y)) < 0.2
        train = np.flatnonzero(~hold)
        acc_s, acc_d = np.full_like(self.sparse, 1e-2), np.full_like(self.dense, 1e-2)
        for _ in range(epochs):
            rng.shuffle(train)
            for a in range(0, len(train), 32):
                b = train[a : a + 32]
                gs = [grams[i] for i in b]
                p = 1 / (1 + np.exp(-np.clip(self.raw(gs, pair[b]), -30, 30)))
                err = (p - y[b]).astype(np.float32)
                grad = pair[b].T @ err + 1e-4 * self.dense
                acc_d += grad * grad
                self.dense -= rate * grad / np.sqrt(acc_d)
                rows = np.concatenate(gs)
                each = np.repeat(err / np.sqrt(np.maximum(1, [len(g) for g in gs]))[:, None].astype(np.float32), [len(g) for g in gs], axis=0)
                at, inv = np.unique(rows, return_inverse=True)
                grad = np.zeros((len(at), len(DEFECTS)), np.float32)
                np.add.at(grad, inv, each)
                acc_s[at] += grad * grad
                self.sparse[at] -= rate * grad / np.sqrt(acc_s[at])
        held = np.flatnonzero(hold)
        raw = self.raw([grams[i] for i in held], pair[held])
        self.held_out, self.keen = {}, np.zeros(len(DEFECTS))
        for k in range(len(DEFECTS)):
            order = np.argsort(-raw[:, k])
            hit = y[held][order, k]
            good = np.cumsum(hit)
            f1 = 2 * good / (np.arange(1, len(order) + 1) + max(1, hit.sum()))
            best = int(np.argmax(f1))
            self.keen[k] = np.quantile(raw[y[held][:, k] > 0, k], 0.02) if hit.any() else np.inf
            nxt = raw[order[min(best + 1, len(order) - 1)], k]
            self.threshold[k] = (raw[order[best], k] + nxt) / 2
            self.held_out[DEFECTS[k]] = float(f1[best])

    def doubtful(self, pairs: list[tuple[str, str]]) -> np.ndarray:
        """Whether a reply may be a refusal: nearly as likely as all but the unlikeliest of the made ones."""
        k = DEFECTS.index("refusal")
        return self.raw(*self.encode(pairs))[:, k] > min(self.keen[k], self.threshold[k]) - 0.5 if pairs else np.zeros(0, bool)

    def judge(self, pairs: list[tuple[str | None, str | None]]) -> list[str | None]:
        """The one defect of each pair, or None."""
        full = [i for i, (_, r) in enumerate(pairs) if not says_nothing(r)]
        out: list[str | None] = ["empty"] * len(pairs)
        if not full:
            return out
        grams, pair = self.encode([(pairs[i][0] or "", pairs[i][1] or "") for i in full])
        # of what the classifier leaves open: what is opened and not closed, or ends with a comma, inside a word, or with
        # a word or two that in all turns never end a sentence, is cut short
        broken = (pair[:, _FENCE] > 0) | (pair[:, _BRACKET] > 0) | ((pair[:, _QUOTE] > 0) & (pair[:, _FINAL] == 0)) | ((pair[:, _NEVER] > 0) & (pair[:, _LONG] > 0)) | (pair[:, [_MARK, _INSIDE, _COMMA, _OPEN]] > 0).any(1)
        # and what has nearly all words of a message of some length and no others holds nothing but the message
        echoed = (pair[:, _NOVEL] <= 0.05) & (pair[:, _COVERS] >= 0.9)
        for i, s, b, e in zip(full, self.raw(grams, pair) - self.threshold, broken, echoed):
            k = int(np.argmax(s))
            some = len(_WORD.findall(pairs[i][0] or "")) >= 4
            out[i] = DEFECTS[k] if s[k] > 0 else "copy" if e and some else "truncated" if b else None
        return out


# ---------------------------------------------------------------- made defects
def _cut(reply: str, others: list[str], rng: np.random.Generator) -> str | None:
    """A reply that breaks off inside a word, sentence, list, quotation, bracket or code block."""
    words = [m for m in _WORD.finditer(reply)]
    if len(words) < 6:
        return None
    way = int(rng.integers(0, 12))
    k = int(rng.integers(max(2, len(words) // 3), len(words) - 1))
    w = words[k]
    if way < 4 and len(w.group()) >= 4:  # inside a word
        return reply[: w.start() + int(rng.integers(1, len(w.group()) - 1))]
    if way < 7:  # inside a sentence, not at its end
        while k > 2 and reply[words[k - 1].end() : w.start()].strip()[:1] in (".", "!", "?"):
            k -= 1
            w = words[k]
        return reply[: words[k - 1].end()] + ["", "", "", " …", "...", ",", " […]"][int(rng.integers(0, 7))]
    whole = reply.rstrip().rstrip(".!?")
    other = others[int(rng.integers(0, len(others)))]
    lead = " ".join(other.split()[: int(rng.integers(1, 5))])
    if way == 7:
        return whole + " " + ["and the", "which is", "but also the", "because the", "of the", "so that", "or the", "with a", "if the", "then"][int(rng.integers(0, 10))] + ["", "…", " […]", ","][int(rng.integers(0, 4))]
    if way == 8:
        return whole + ' "' + lead
    if way == 9:
        return whole + " (" + lead.lower()
    if way == 10:
        return reply.rstrip() + "\n" + ["```python\nfor row in rows:\n    t", "```\ntotal = 3 +", "```sql\nSELECT a,", "```\n" + lead][int(rng.integers(0, 4))]
    return reply.rstrip() + "\n1. " + lead.lower() + "\n2. " + [other.split()[0].lower() + "\n3.", "", lead[:3].lower()][int(rng.integers(0, 3))]


def _dress(message: str, rng: np.random.Generator) -> str:
    way = int(rng.integers(0, 12))
    text = message.strip()
    if way == 11:
        return f"{text} {text}"
    if way == 0:
        return f'"{text}"'
    if way == 1:
        return f"> {text}"
    if way == 2:
        return text.upper()
    if way == 3:
        return re.sub(r"[^\w\s]", "", text.lower())
    if way == 4:
        return ["You asked: ", "Your message: ", "Question: ", "You said: ", "User: "][int(rng.integers(0, 5))] + text
    if way == 5:
        return text.lower().rstrip("?.! ")
    if way in (6, 7):  # slips
        c = list(text)
        for _ in range(max(1, len(c) // 40)):
            i = int(rng.integers(0, len(c) - 1)) if len(c) > 1 else 0
            c[i : i + 2] = c[i : i + 2][::-1]
        return "".join(c)
    if way == 8:
        ws = text.split()
        if len(ws) > 5:
            del ws[int(rng.integers(0, len(ws)))]
        return " ".join(ws)
    if way == 9:
        return f"**{text}**"
    return text


def _sound_end(reply: str, rng: np.random.Generator) -> str:
    """A complete reply, ended in one of the usual ways."""
    way = int(rng.integers(0, 8))
    whole = reply.rstrip()
    if not whole.endswith((".", "!", "?")) or whole.endswith("..."):
        return reply
    if way < 3:
        return whole.rstrip(".!?")
    if way == 3:
        return whole.rstrip(".!?") + " " + [":)", ":-)", "🙂"][int(rng.integers(0, 3))]
    if way == 4:
        return f'"{whole}"'
    if way == 5:
        return whole + "\n```\ntotal = 1 + 2\n```"
    if way == 6:
        return whole.rstrip(".!?") + ["!", " !", "?"][int(rng.integers(0, 3))]
    return whole


def made(turns: list[tuple[str, str]], speak) -> tuple[list[tuple[str, str]], np.ndarray]:
    """Training pairs and labels from (message, reply) turns. ``speak`` gives a text's language, or None."""
    rng = np.random.default_rng(SEED)
    pairs: list[tuple[str, str]] = []
    labels: list[list[int]] = []
    tongue = [(speak(m), speak(r)) for m, r in turns]
    usual = [i for i, (a, b) in enumerate(tongue) if a == b or a is None or b is None]
    replies = [turns[i][1] for i in usual if len(turns[i][1].split()) >= 4] or [r for _, r in turns]
    by: dict[str, list[str]] = {}
    for i in usual:
        if tongue[i][1]:
            by.setdefault(tongue[i][1], []).append(turns[i][1])

    def add(m: str, r: str, *defects: str) -> None:
        pairs.append((m, r))
        labels.append([int(d in defects) for d in DEFECTS])

    pick = lambda xs: xs[int(rng.integers(0, len(xs)))]
    for i, (m, r) in enumerate(turns):
        if (tongue[i][0] == tongue[i][1] or None in tongue[i]):
            add(m, r)
            add(m, _sound_end(r, rng))
        t = _cut(r, replies, rng) if (tongue[i][0] == tongue[i][1] or None in tongue[i]) else None
        if t and not says_nothing(t):
            add(m, t, "truncated")
        # short answers: one sentence of another reply, or a list of some of its words
        other = pick(replies)
        part = [x for x in _SENTENCE.split(other) if len(x.split()) > 3]
        if part and i % 2:
            add(m, pick(part), *(["other_language"] if tongue[i][0] and speak(other) not in (None, tongue[i][0]) else []))
        elif i % 2 == 0:
            ws = [w.strip(".,;:!?\"'").lower() for w in other.split()]
            mark = pick(["- ", "* ", "• ", ""])
            add(m, "\n".join(f"{mark or f'{k + 1}. '}{' '.join(ws[g : g + int(rng.integers(1, 3))])}" for k, g in enumerate(rng.integers(0, max(1, len(ws) - 1), int(rng.integers(2, 5))))))
        step = i % 4
        if step == 0 and m.strip():
            add(m, _dress(m, rng), "copy")
            add(m, pick([f'You asked "{m}" and the answer is this. {r}', f"{m} {r}", f"> {m}\n\n{r}", f"About your question: {r}"]))
        if step in (1, 3):
            # of every language alike, so that rare ones are learned
            own = tongue[i][0] if tongue[i][0] in REFUSALS and rng.random() < 0.5 else pick([*REFUSALS, "en", "en"])
            core = one_of(pick(REFUSALS[own]), rng)
            if own == "en":
                lead = pick(BEFORE)
                core = lead + (core[0].lower() + core[1:] if lead and not core.startswith(("I ", "I'")) else core) + pick(AFTER)
            else:
                core += pick(["", "", one_of(ELSE.get(own, ""), rng)]) + pick([".", "", "."])
            gaps = [g.start() for g in re.finditer(" ", core)]
            if gaps and rng.random() < 0.2:  # a blank lost
                g = pick(gaps[-4:])
                core = core[:g] + core[g + 1 :]
            add(m, core, "refusal")
            # alone, in another wording
            add(m, one_of(pick(REFUSALS[pick(["en", *REFUSALS])]), rng) + pick([".", ""]), "refusal")
            add(m, pick(SOUND).format(x=" ".join(pick(replies).split()[1:4]).strip(".,").lower()) + pick(["", " " + r]))
        if step == 2 and tongue[i][0]:
            others = [k for k in by if k != tongue[i][0]]
            if others:
                k = pick(others)
                add(m, pick(by[k]), "other_language")
                add(pick(ASK).format(NAMED[k].split()[0].capitalize()) + m, pick(by[k]))
        if step in (1, 2):
            add(m, one_of(pick(SHORT[tongue[i][0] if tongue[i][0] in SHORT else "en"]), rng) + pick(["", "."]))
        if step in (0, 3):
            add(m, pick(["Yes", "No", "Not yet", "About twenty minutes", "The red one", "Monday", "All done, thanks!", "Good night", "Around 5 euros", "- eggs\n- rice", "1. first\n2. second\n3. done", "```\nx = 1\n```", "In May 2021", "Station Road 4", "Twice", "The one by the door", "See notes/list :)"]))
    return pairs, np.array(labels, np.float32)


def _endings(texts: list[str]) -> tuple[Counter[str], Counter[str], Counter[str]]:
    """Counts of words and of two words in a row, of those at a sentence's end, and of those at a line's end without a stop."""
    seen: Counter[str] = Counter()
    ends: Counter[str] = Counter()
    bare: Counter[str] = Counter()
    pairs: Counter[tuple[str, str]] = Counter()
    for text in texts:
        for part in _SENTENCE.split(text):
            ws = _WORD.findall(_DIGITS.sub("0", part.lower()))
            if ws:
                seen.update(ws)
                pairs.update(zip(ws, ws[1:]))
                tail = part.rstrip()
                (ends if tail[-1:] in (".", "!", "?") and not tail.endswith("..") else bare).update({ws[-1], " ".join(ws[-2:])})
    seen.update({f"{a} {b}": n for (a, b), n in pairs.items()})
    return seen, ends, bare


_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")
#: Words and pairs of words whose counts are broadcast are each at least one in so many of all; with the least count, this bounds their number.
SHARE, LEAST = 400_000, 2
_FLUSH = 300_000


def endings(turns: DataFrame) -> dict[str, tuple[int, int, int]]:
    """``_endings`` of both sides of all turns: word or two words -> (seen, at a sentence's end, at a line's end).

    Counted in the executors; words rarer than one in ``SHARE`` are left out, so the table has at most that many rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter(), Counter(), Counter()

        def out() -> pa.RecordBatch:
            seen, ends, bare = total
            ws = list(seen)
            return pa.RecordBatch.from_arrays([pa.array(ws, pa.string()), *(pa.array([c[w] for w in ws], pa.int64()) for c in total)], ["w", "seen", "ends", "bare"])

        for batch in batches:
            for c, more in zip(total, _endings([t for col in batch.columns for t in col.to_pylist() if t])):
                c.update(more)
            if len(total[0]) > _FLUSH:
                yield out()
                total = Counter(), Counter(), Counter()
        if total[0]:
            yield out()

    rows = turns.select("user_message", "assistant_reply").mapInArrow(count, "w string, seen bigint, ends bigint, bare bigint")
    summed = rows.groupBy("w").agg(*(F.sum(c).alias(c) for c in ("seen", "ends", "bare"))).filter(F.col("seen") >= LEAST)
    summed = cut(summed)
    every = summed.agg(F.sum("seen")).first()[0] or 0
    return {r["w"]: (r["seen"], r["ends"], r["bare"]) for r in summed.filter(F.col("seen") * SHARE >= every).collect()}


def train(turns: list[tuple[str, str]], table: np.ndarray, langs: tuple[str, ...], known: dict[str, tuple[int, int, int]] | None = None) -> Model:
    """A model from at most ``SAMPLE`` (message, reply) turns; turns found defective by a first model are left out.

    known: the counts of ``endings``, by default those of the turns given."""
    full = [(m or "", r) for m, r in turns if not says_nothing(r)]
    if known is None:
        seen, ends, bare = _endings([t for pair in full for t in pair])
        known = {w: (n, ends[w], bare[w]) for w, n in seen.items() if n >= LEAST}
    model = Model(Featuriser(table, langs, known))

    def speak(text: str) -> str | None:
        s = model.features.speak(text)
        return None if s is None else langs[int(np.argmax(s))]

    def fitted(of: list[tuple[str, str]], epochs: int) -> Model:
        out = Model(model.features)
        pairs, y = made(of if len(of) >= 20 else full or [("", "no data at all to learn from here")], speak)
        out.fit(*out.encode(pairs), y, epochs)
        return out

    def clean(of: list[tuple[str, str]], by: Model) -> list[tuple[str, str]]:
        return [p for p, d, doubt in zip(of, by.judge(of), by.doubtful(of)) if d is None and not doubt]

    good = [(m, r) for m, r in full if (m.strip().lower() != r.strip().lower())]
    # real defects among the turns are no examples of sound ones; as refusals are short, the model that finds them
    # learns what is sound from long replies, their sentences and lists alone
    long = [(m, r) for m, r in good if len(r.split()) >= LONG]
    return fitted(clean(good, fitted(long if len(long) >= 20 else good, 4)), 6)


def defects(turns: DataFrame, documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(turn_id, defect) of every turn with a defect.

    turns: turn_id, user_message, assistant_reply; documents (labelled with languages) train the language profiles
    (other columns are ignored). Null and blank replies are ``empty``; a null message is an empty one; repeated
    rows count once; long texts are read whole; empty tables give no rows."""
    spark = turns.sparkSession
    full = turns.select("turn_id", "user_message", "assistant_reply").filter("turn_id IS NOT NULL")
    usable = full.filter("assistant_reply IS NOT NULL AND user_message IS NOT NULL")
    got = list({r["turn_id"]: r for r in bounded(usable, "turn_id", sample, SEED)}.values())
    model = train([(r["user_message"], r["assistant_reply"]) for r in got], *L.model(documents, LANGUAGE_SAMPLE)[:2], endings(full))
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, m, r = (c.to_pylist() for c in batch.columns)
            found = [(k, d) for k, d in zip(key, held.value.judge(list(zip(m, r)))) if d]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([d for _, d in found])], ["turn_id", "defect"])

    return full.mapInArrow(run, "turn_id bigint, defect string").distinct()
