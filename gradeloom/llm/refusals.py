"""Sentences that decline to answer (problem 1), by a fitted model.

Words fall into classes (negation, ability, act of answering, first person, source, ...). A sentence is described by the
combinations of classes it holds and by its word n-grams. Patterns of known wordings (``pairs.REFUSALS``) label the
sentences of a bounded sample; a logistic model is fitted to these labels and then to its own sure judgements
(self-training), so that wordings beside the listed ones are found: the classes carry over, and n-grams of the corpus
that go with refusals are learned. Only sentences that hold a class that every refusal holds (GATE) are looked at.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import xxhash

from gradeloom.llm.tokens import Codes, scan
from gradeloom.llm.tokens import Column as Growing

#: Texts that the model is fitted on, rounds of self-training, how sure a judgement must be to count, size of the
#: n-gram table and strength of the priors of class combinations and n-grams.
FIT_TEXTS, ROUNDS, SURE, NGRAMS, RIDGE, NGRAM_RIDGE = 6_000, 2, 0.95, 1 << 14, 0.3, 12.0

# Beginnings of words per class, for five languages; a trailing = asks for the whole word.
CLASSES: dict[str, tuple[str, ...]] = {
    "neg": ("not=", "no=", "never=", "nothing=", "none=", "cannot=", "can't=", "won't=", "don't=", "couldn't=", "wouldn't=", "isn't=", "doesn't=", "haven't=", "aren't=", "without=", "non=", "nessun", "niente=", "nulla=", "mai=", "senza=", "nada=", "ningun", "ningún", "nunca=", "sin=", "ne=", "n'", "rien=", "aucun", "jamais=", "sans=", "nicht=", "kein", "nichts=", "nie=", "niemals=", "ohne="),
    "pas": ("pas=",),  # a negation, or a step
    "can": ("can", "could", "able=", "may=", "allowed=", "permitted=", "authori", "possible=", "position=", "capable=", "posso=", "possiamo=", "riesco=", "potrei=", "possibile=", "grado=", "permess", "consentit", "capace=", "puedo=", "podemos=", "podría", "capaz=", "posible=", "permitido=", "permite=", "condiciones=", "peux=", "pouvons=", "puis=", "pourrais=", "possible=", "mesure=", "permis=", "autoris", "kann=", "können=", "könnte", "darf=", "dürfen=", "möglich=", "imstande=", "lage="),
    "will": ("will=", "won't=", "want=", "wish=", "going=", "intend", "prefer", "rather=", "would", "voglio=", "vorrei=", "intendo=", "intenzione=", "preferi", "quiero=", "deseo=", "pienso=", "prefier", "voy=", "veux=", "souhaite", "préfèr", "préférer", "vais=", "compte=", "will=", "möchte", "werde=", "lieber=", "gedenke="),
    "cannot": ("unable=", "impossib", "imposib", "unmöglich", "außerstande=", "incapa", "inability=", "unwilling="),
    "act": ("answer", "repl", "respon", "help", "assist", "comment", "discuss", "disclos", "address=", "fulfil", "compl", "handle=", "process=", "elaborat", "weigh=", "speak=", "talk=", "say=", "tell=", "provide", "offer=", "go=", "rispo", "aiut", "dir", "comment", "discut", "fornir", "tratt", "soddisf", "elabor", "ayud", "contest", "decir", "dar=", "proporcion", "atender=", "hablar=", "tratar=", "répon", "aid", "dire=", "fournir=", "trait", "donner=", "parler=", "satisf", "antwort", "beantwort", "helf", "weiterhelf", "hilfe=", "sagen=", "auskunft=", "äußer", "eingehen=", "bearbeit", "nachkommen=", "dienen="),
    "request": ("request", "question", "enquir", "inquir", "topic=", "subject=", "matter=", "richiest", "domand", "argoment", "quesit", "petici", "pregunt", "solicitud=", "consulta=", "tema=", "demande", "sujet=", "requête", "anfrage", "frage", "thema=", "bitte="),
    "first": ("i=", "i'm=", "i'll=", "i'd=", "we=", "me=", "my=", "us=", "io=", "mi=", "mia=", "mio=", "posso=", "riesco=", "devo=", "voglio=", "preferisco=", "intendo=", "ho=", "yo=", "me=", "mis=", "puedo=", "debo=", "quiero=", "prefiero=", "tengo=", "voy=", "je=", "j'", "moi=", "mon=", "mes=", "ich=", "mir=", "mich=", "mein", "wir="),
    "decline": ("declin", "refus", "abstain", "refrain", "withhold", "rifiut", "asten", "rechaz", "negar", "absten", "abstien", "déclin", "absten", "abstien", "abstiens=", "ablehn", "verweiger", "verzicht", "absehen=", "enthalt"),
    "source": ("context", "text=", "texts=", "passage", "material", "document", "source", "information", "contest", "testo=", "testi=", "bran", "material", "document", "font", "informazion", "context", "texto", "pasaje", "fragment", "fuente", "informaci", "texte", "extrait", "kontext", "textstell", "unterlag", "quell", "abschnitt", "information", "angaben="),
    "hold": ("contain", "cover", "mention", "enough=", "suffic", "include", "address", "state=", "states=", "allow", "contien", "conteng", "bast", "sufficien", "menzion", "parla", "tratta", "dice=", "suficien", "menciona", "habla", "trata=", "dice=", "hay=", "contenir", "suffi", "mentionn", "parle", "dit=", "assez=", "enthält", "enthalten=", "reich", "genug=", "genüg", "erwähn", "steht=", "gibt=", "nennt="),
    "lack": ("lack", "miss", "insufficient", "inadequate", "absent=", "manca", "mancano=", "insufficient", "falta", "faltan=", "insuficient", "manque", "insuffisant", "fehl", "unzureichend"),
    "beyond": ("outside=", "beyond=", "scope=", "remit=", "oltre=", "esula=", "fuori=", "portata=", "ambito=", "fuera=", "allá=", "excede=", "alcance=", "dépasse", "hors=", "dehors=", "delà=", "au-delà=", "außerhalb=", "jenseits=", "übersteigt=", "hinaus="),
    "other": ("else=", "somebody=", "someone=", "altr", "qualcun", "otr", "alguien=", "autre", "quelqu", "jemand", "ander"),
    "sorry": ("sorry=", "apolog", "unfortunately=", "regret", "afraid=", "spiac", "dispiac", "purtroppo=", "scus", "siento=", "lament", "perdón=", "disculp", "désolé", "regrett", "malheureusement=", "pardon=", "leid=", "leider=", "bedau", "entschuldig"),
    "you": ("you=", "your=", "tu=", "ti=", "tua=", "tuo=", "te=", "tus=", "ta=", "ton=", "tes=", "vous=", "votre=", "du=", "dir=", "dich=", "dein"),
    "yet": ("yet=", "first=", "before=", "instead=", "subito=", "ancora=", "prima=", "todavía=", "aún=", "primero=", "encore=", "d'abord=", "avant=", "noch=", "zuerst=", "bevor=", "gleich="),
    "turn": ("but=", "however=", "ma=", "però=", "pero=", "mais=", "aber=", "though=", "although=", "sino=", "sondern="),
}
_BIT = {c: 1 << i for i, c in enumerate(CLASSES)}
GATE = sum(_BIT[c] for c in ("neg", "pas", "cannot", "decline", "lack", "beyond", "other"))
#: Combinations of classes that the model weighs, beside the classes themselves.
COMBINATIONS = (
    ("neg", "can", "act"), ("neg", "can", "request"), ("neg", "will", "act"), ("neg", "will", "request"), ("neg", "act", "first"), ("neg", "act", "request"), ("cannot", "act"), ("cannot", "request"), ("cannot", "first"), ("decline", "first"), ("decline", "act"), ("decline", "request"), ("neg", "source", "hold"),
    ("neg", "source", "act"), ("lack", "source"), ("lack", "first"), ("beyond", "first"), ("beyond", "request"), ("beyond", "act"), ("other", "act"), ("other", "request"), ("sorry", "neg"), ("sorry", "can"), ("neg", "act", "yet"), ("neg", "will", "yet"), ("neg", "you"), ("neg", "turn"), ("neg", "first", "hold"), ("pas", "can", "first"), ("pas", "can", "act", "first"),
)
_MASKS = np.array([_BIT[c] for c in CLASSES] + [sum(_BIT[c] for c in combo) for combo in COMBINATIONS], np.int64)
# Wordings that decline, and sentences that don't, as seeds where the sample holds too few.
SEEDS = (
    "I cannot answer that.", "I am not able to help with this request.", "I will not comment on this.", "It is impossible to answer this question.", "I must decline to respond.", "The context does not contain enough information.", "This lies outside my scope.", "I would rather not say.", "I lack the information to reply.", "No answer can be given.", "Someone else should answer this question.",
    "Non posso rispondere a questa domanda.", "Non intendo commentare.", "È impossibile rispondere a questa richiesta.", "Devo rifiutare di rispondere.", "Il testo non contiene informazioni sufficienti.", "Mi mancano le informazioni.", "Questo esula dal mio ambito.", "Nessuna risposta è possibile.",
    "No puedo responder a esta pregunta.", "No quiero comentar esto.", "Es imposible responder a esta petición.", "Debo negarme a responder.", "El texto no contiene suficiente información.", "Me faltan los datos.", "Esto está fuera de mi alcance.", "No se dará ninguna respuesta.",
    "Je ne peux pas répondre à cette question.", "Je ne souhaite pas commenter.", "Il est impossible de répondre à cette demande.", "Je dois refuser de répondre.", "Le texte ne contient pas assez d'informations.", "Il me manque des informations.", "Cela dépasse mon domaine.", "Aucune réponse ne sera donnée.",
    "Ich kann diese Frage nicht beantworten.", "Dazu möchte ich nichts sagen.", "Es ist unmöglich, diese Anfrage zu bearbeiten.", "Ich muss die Antwort verweigern.", "Der Text enthält nicht genug Informationen.", "Mir fehlen die Angaben.", "Das liegt außerhalb meines Bereichs.", "Eine Antwort wird es nicht geben.",
)
PLAIN = (
    "You cannot divide by zero.", "The answer is not 12.", "Do not forget to carry the one.", "There is no remainder.", "The text does not say that the train was late but that it was early.", "I will not give you the result yet.", "We do not jump to the answer, but look at the sign first.", "Nothing else changes.", "That is not possible for a triangle.", "Without the sign the answer is wrong.", "Somebody else checks the other side.", "The missing number is 7.",
    "Non puoi dividere per zero.", "La risposta non è 12.", "Non ti dico ancora il risultato, ma guarda il segno.", "Non c'è resto.", "Manca il secondo passo.", "No puedes dividir entre cero.", "La respuesta no es 12.", "Todavía no te doy el resultado, pero mira el signo.", "Falta el segundo paso.", "On ne peut pas diviser par zéro.", "La réponse n'est pas 12.", "Je ne te donne pas encore le résultat, mais regarde le signe.", "Il manque le deuxième pas.", "Man kann nicht durch null teilen.", "Die Antwort ist nicht 12.", "Ich sage dir das Ergebnis noch nicht, aber schau auf das Vorzeichen.", "Der zweite Schritt fehlt.",
)

_tokens = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?]+(?=\s|$)|\n+").findall


def sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+", " ".join(text.split()).lower()) if s]


def classes_of(word: str) -> int:
    w = word.lower().replace("’", "'")
    out = 0
    for c, stems in CLASSES.items():
        if any(w == s[:-1] if s[-1] == "=" else w.startswith(s) for s in stems):
            out |= _BIT[c]
    return out


class Words:
    """Classes of the words met by this worker."""

    def __init__(self) -> None:
        self.codes, self.mask = Codes(self.seen), Growing(np.int64)

    def seen(self, w: str) -> None:
        self.mask.add(classes_of(w) if w[0].isalpha() else 0)


_known = Words()


def suspects(texts: Sequence[str | None]) -> np.ndarray:
    """Whether each text holds a word of a GATE class."""
    global _known
    if len(_known.codes) > 500_000:
        _known = Words()
    code, first = scan(texts, _tokens, _known.codes)
    hit = np.concatenate([[0], np.cumsum((_known.mask.data[code] & GATE) != 0)])
    return hit[first[1:]] > hit[first[:-1]]


@lru_cache(maxsize=100_000)
def _mask(word: str) -> int:
    return classes_of(word) if word[0].isalpha() else 0


def described(sentence: str) -> tuple[list[str], int]:
    """Words of a sentence and the classes that they hold."""
    words = [w for w in _tokens(sentence.lower()) if w[0].isalpha()]
    mask = 0
    for w in words:
        mask |= _mask(w)
    return words, mask


class Model:
    """Weights of class combinations and hashed n-grams."""

    def __init__(self) -> None:
        self.weights = np.zeros(len(_MASKS) + NGRAMS + 1)

    def features(self, sentence: str) -> np.ndarray:
        words, mask = described(sentence)
        grams = {xxhash.xxh32_intdigest(g) % NGRAMS for n in (1, 2) for g in (" ".join(words[i : i + n]) for i in range(len(words) - n + 1))}
        classes = np.flatnonzero((mask & _MASKS) == _MASKS)
        return np.concatenate([classes, np.array(sorted(grams), np.int64) + len(_MASKS), [len(self.weights) - 1]]).astype(np.int64)

    def fit(self, examples: list[str], labels: np.ndarray) -> None:
        """Logistic regression with a ridge, by gradient steps scaled per feature."""
        rows = [self.features(s) for s in examples]
        at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        col = np.concatenate(rows)
        used, j = np.unique(col, return_inverse=True)
        ridge = np.where(used < len(_MASKS), RIDGE, NGRAM_RIDGE)
        ridge[used == len(self.weights) - 1] = 0.01
        # Both kinds of sentences count alike in all.
        share = np.where(labels > 0.5, 0.5 / max(1, (labels > 0.5).sum()), 0.5 / max(1, (labels <= 0.5).sum())) * min(len(rows), 2000)
        w = np.zeros(len(used))
        scale = np.bincount(j, share[at] * 0.25) * np.bincount(at).mean() + ridge
        for _ in range(400):
            p = 1 / (1 + np.exp(-np.bincount(at, w[j], len(rows))))
            w += (np.bincount(j, ((labels - p) * share)[at]) - ridge * w) / scale * 2
        self.weights[:] = 0
        self.weights[used] = w

    def score(self, sentence: str) -> float:
        return float(1 / (1 + np.exp(-self.weights[self.features(sentence)].sum())))

    def declines(self, sentence: str, rule: Callable[[str], object] | None = None) -> bool:
        """Whether a sentence holds a word of a GATE class and declines, by the rule or by the model."""
        if not described(sentence)[1] & GATE:
            return False
        return bool(rule is not None and rule(sentence)) or self.score(sentence) > 0.5


def train(texts: Sequence[str | None], declines: Callable[[str], object], questions: Sequence[str | None] = ()) -> Model:
    """The model of a bounded sample of texts, with ``declines`` as the rule that labels it at first. ``questions``:
    texts that ask, none of whose sentences decline."""

    def gated(texts: Sequence[str | None]) -> set[str]:
        found = list({s for t, hit in zip(texts, suspects(texts)) if hit for s in sentences(t or "")})
        return {s for s, hit in zip(found, suspects(found)) if hit}

    asked = gated(questions)
    corpus = sorted(gated(texts) - asked)
    asked = sorted(asked)
    seeds = [*asked, *(s.lower() for s in (*SEEDS, *PLAIN))]
    fixed = np.array([0.0] * len(asked) + [1.0] * len(SEEDS) + [0.0] * len(PLAIN))
    first = np.array([bool(declines(s)) for s in corpus], float)
    model, labels = Model(), first.copy()
    for _ in range(ROUNDS):
        model.fit([*corpus, *seeds], np.concatenate([labels, fixed]))
        p = np.array([model.score(s) for s in corpus])
        labels = np.where(first > 0.5, 1.0, (p > SURE).astype(float))
    model.fit([*corpus, *seeds], np.concatenate([labels, fixed]))
    return model
