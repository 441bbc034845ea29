"""Defective question-answer pairs and their kinds of defect (problem 1).

* ``truncated``: responses are sorted by text without what stands behind a cut, and one that begins its neighbour is a
  shortened version; lengths at which a source's open texts pile up are limits; final words are judged as in ``cutoff``.
* ``refusal``: the sentences are judged by a fitted model (``refusals``), the text by what stands beside them.
* ``empty``, ``copies_question`` and ``other_language`` are rules on the single pair.

One pass over the pairs finds the latter and describes the ends of the open texts for the former.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm import cutoff, languages, refusals
from gradeloom.session import cut

FIELDS = ("answer", "ground_truth")

# Placeholders, compared in lower case without surrounding marks.
PLACEHOLDERS = (
    "n/a", "na", "none", "null", "nil", "nan", "tbd", "tba", "todo", "undefined", "empty", "missing", "blank",
    "no answer", "no response", "not available", "not applicable", "no data", "placeholder",
    "nessuna risposta", "non disponibile", "pas de réponse", "non disponible", "sin respuesta", "no disponible",
    "keine antwort", "nicht verfügbar",
)

# Known wordings that decline, per language: they label what the model of refusals is fitted on.
REFUSALS = {
    "en": (
        r"\b(?:cannot|can not|can['’]t|could not|couldn['’]t|unable to|not able to|not in a position to)\s+(?:\w+\s+){0,2}?(?:help|assist|answer|respond|reply|provide|comment|discuss|say|tell|fulfil|comply)",
        r"\b(?:must|have to|need to|will|would like to) (?:\w+ )?(?:decline|refuse)\b",
        r"\bnot (?:allowed|permitted|authori[sz]ed) to\b",
        r"\b(?:rather|prefer) not (?:to )?(?:comment|answer|say|discuss|respond)",
        r"\bbetter (?:put|asked|directed|addressed) to (?:some|any)(?:body|one) else",
        r"\b(?:do not|don['’]t) have (?:what i need|enough|sufficient|the (?:information|context))",
        r"\bno answer can be\b|\bi (?:lack|am missing) what\b",
        r"\bnothing in (?:the|my|this) (?:given )?(?:context|text|passages?|material|documents?|sources?)",
        r"\b(?:context|text|passages?|material|documents?|sources?|information)(?: \w+){0,2} (?:do|does|is|are|did)(?:\s+not|n['’]t) (?:\w+ ){0,2}?(?:cover|enough|suffic\w*|contain|mention|say|address|include|provide|discuss|answer|allow)",
        r"\binsufficient (?:context|information)",
        r"\b(?:lies|falls|is|goes) (?:outside|beyond|out of)\b(?: of)? (?:what|the scope|my|our)",
    ),
    "it": (
        r"\bnon (?:posso|riesco a|potrei|sono in grado di|sono capace di|mi è (?:permesso|consentito|possibile))\b",
        r"\b(?:devo|vorrei|debbo) (?:declinare|rifiutare)",
        r"\bpreferisco non\b|\bpreferirei non\b",
        r"\bqualcun['’]? ?altr[oa]|\baltra persona|\bmeglio rivolg",
        r"\b(?:va oltre|esula da|al di fuori di|è fuori da)\b",
        r"\bmi manca(?:no)?\b",
        r"\bnon ho (?:quello che|ciò che|abbastanza|informazioni|elementi|sufficienti)",
        r"\b(?:alcuna|nessuna) risposta\b",
        r"\b(?:contesto|testo|brani|brano|materiale|documenti|fonti)\b[^.!?]{0,30}\bnon\b[^.!?]{0,30}(?:c['’]è|dic|bast|tratt|contien|contengon|sufficien|parla|menzion|ricav)",
    ),
    "es": (
        r"\bno (?:puedo|podría|soy capaz de|estoy en condiciones de|me está permitido|se me permite|tengo permitido)\b",
        r"\b(?:debo|tengo que) (?:declinar|rechazar|negarme)",
        r"\bprefiero no\b|\bpreferiría no\b",
        r"\b(?:otra persona|alguien más)\b|\bmejor (?:dirigir|plantear|hacer|preguntar)",
        r"\b(?:fuera de|más allá de|excede) (?:lo que|mi|mis|el alcance)",
        r"\bme faltan?\b",
        r"\bno (?:tengo|dispongo de) (?:lo|suficiente|bastante|información)",
        r"\bninguna respuesta\b",
        r"\b(?:contexto|texto|material|materiales|pasajes|fragmentos|documentos|fuentes)\b[^.!?]{0,30}\bno\b[^.!?]{0,30}(?:hay|dice|basta|trata|contien|suficien|menciona|habla|puede)",
    ),
    "fr": (
        r"\bne (?:peux|puis|pourrais)\b|\bpas en mesure de\b|\bm['’]est pas (?:permis|possible)",
        r"\bdois (?:décliner|refuser)|\bje refuse\b",
        r"\bpréf(?:è|é)re(?:rais)? ne (?:pas|rien)\b|\bil me manque\b",
        r"\bquelqu['’]un d['’]autre|\bune autre personne|\bvaut mieux (?:poser|demander|adresser)",
        r"\b(?:dépasse|sort de|au-delà de|en dehors de|hors de) (?:ce |mon |mes |la portée)",
        r"\bn['’]ai pas (?:ce qu|assez|suffisamment|les (?:informations|éléments))",
        r"\baucune réponse\b",
        r"\b(?:contexte|texte|passages?|extraits?|documents?|matériel|sources?)\b[^.!?]{0,30}\b(?:ne |n['’])[^.!?]{0,30}\b(?:pas|rien|aucun|assez)\b|\brien (?:dans|sur)[^.!?]{0,30}(?:contexte|texte|sujet)|\bil n['’]y a rien\b",
    ),
    "de": (
        r"\bkann\b[^.!?]{0,40}\bnicht (?:\w+ )?(?:helfen|beantworten|antworten|sagen|weiterhelfen|dienen)",
        r"\bdarf\b[^.!?]{0,30}\bnicht\b",
        r"\bnicht in der lage\b|\baußerstande\b",
        r"\bmuss\b[^.!?]{0,40}\b(?:ablehnen|absehen|verweigern)",
        r"\blieber nicht\b",
        r"\bjemand(?:en|em)? ander|\bbesser an (?:andere|jemand|wen)",
        r"\b(?:außerhalb|jenseits) (?:dessen|meiner|meines)|\bgeht über (?:das|mein|meine)\b|\bübersteigt (?:das|mein|meine)\b",
        r"\b(?:nicht|nichts) (?:das|was) ich (?:\w+ )?brauche|\bmir fehl(?:t|en)\b|\bhabe nicht[^.!?]{0,30}\bbrauche|\bwas ich (?:\w+ )?(?:brauche|bräuchte)[^.!?]{0,20}\bnicht\b",
        r"\bkeine antwort\b",
        r"\b(?:kontext|text|textstellen|material|unterlagen|quellen|abschnitte)\b[^.!?]{0,50}\b(?:nicht|nichts|keine|kein)\b",
    ),
}
# Whole sentences beside a refusal that neither answer nor guide on: apologies, referrals to people, offers.
ASIDES = (
    r"(?:i['’]?m|i am|we['’]re|we are)?\s*(?:(?:very|so|really|truly|terribly)\s+)?sorry(?: (?:about|for) (?:that|this|it|(?:the|any) (?:inconvenience|trouble)))?|(?:my|our) apologies|i apologi[sz]e(?: for (?:that|this|(?:the|any) inconvenience))?|unfortunately",
    r"(?:please )?(?:ask|contact|consult|turn to|speak (?:to|with)|talk to) (?:your|the|a|an|our)? ?(?:\w+ )?(?:teacher|tutor|instructor|professor|lecturer|support|expert|specialist)(?: (?:team|instead|please))?",
    r"(?:thank you|thanks)(?: for (?:your )?(?:understanding|patience|question|asking))?|(?:please )?let me know if (?:you have|there is|i can help with)[^.!?]*(?:else|other|another)[^.!?]*|(?:please )?(?:feel free to )?ask (?:me )?(?:something else|another question)",
    r"(?:mi dispiace|scusa|scusami|mi scuso|purtroppo)(?: (?:molto|tanto))?|(?:chiedi|rivolgiti|si rivolga|domanda) (?:al|alla|a) (?:\w+ )?(?:insegnante|docente|tutor|professore|professoressa|maestr[oa])|grazie(?: (?:per|della) (?:la )?(?:comprensione|pazienza))?",
    r"(?:lo siento|perd[oó]n|disculpa|disculpe|lo lamento)(?: (?:mucho|de verdad))?|(?:pregunta|pregúntale|consulta|pregunte|consulte)(?: a| al| con)* (?:\w+ )?(?:profesora?|maestr[oa]|tutora?|docente)|gracias(?: por (?:tu|su) (?:comprensión|paciencia))?",
    r"(?:je suis )?(?:(?:vraiment )?désolée?|navrée?)|(?:toutes )?mes excuses|(?:demande|demandez|adresse-toi|adressez-vous) (?:à|au) (?:\w+ )?(?:professeure?|enseignante?|tuteur|tutrice)|merci(?: (?:de|pour) (?:ta|votre) (?:compréhension|patience))?",
    r"(?:es )?tut mir (?:sehr )?leid|entschuldigung|leider|(?:bitte )?(?:frag|frage|fragen sie|wende dich|wenden sie sich) (?:bitte )?(?:an )?(?:\w+ )?(?:lehrer(?:in)?|lehrkraft|tutor(?:in)?|professor(?:in)?)|danke(?: für (?:dein|ihr) verständnis)?",
)
PLACEHOLDER_CHARS = max(map(len, PLACEHOLDERS))
#: Share of the question's words that a copy may change, and words that may introduce it.
COPY_CHANGED, COPY_INTRO = 0.25, 6

_LATE = "".join(chr(0x10FFF0 + i) for i in range(10))
_but = r"\b(?:but|yet|however|though|ma|però|tuttavia|pero|sin embargo|mais|cependant|toutefois|aber|doch|jedoch)\b"
_words = re.compile(r"[^\W_]+").findall
_turn = re.compile(r"\n+\s*\w+\s*:\s*").split
_markup = re.compile(r"</?[a-z][^<>]*>|<!--.*?-->|&nbsp;|&#160;", re.I)
_declines = re.compile("|".join(f"(?:{p})" for ps in REFUSALS.values() for p in ps)).search
_turns = re.compile(rf",[^.!?]*?{_but}(.*)").search
_aside = re.compile(rf"(?:{'|'.join(ASIDES)})\s*[.!]*").fullmatch
_edge = frozenset({"P", "Z", "C"})


def _bare(text: str) -> str:
    """The text without marks, blanks, control characters and the like at its ends."""

    def edge(c: str) -> bool:
        k = unicodedata.category(c)
        return k[0] in _edge or k in ("Sk", "Sm") or c == "$"

    a, b = 0, len(text)
    while a < b and edge(text[a]):
        a += 1
    while a < b and edge(text[b - 1]):
        b -= 1
    return text[a:b]


def is_empty(text: str | None) -> bool:
    """Null, blank, or nothing but a placeholder or empty markup."""
    if not text:
        return True
    core = _bare(text if "<" not in text and "&" not in text else _markup.sub(" ", text))
    return not core or (len(core) <= PLACEHOLDER_CHARS and core.lower() in PLACEHOLDERS)


def is_refusal(text: str | None, declines: Callable[[str], object] = _declines) -> bool:
    """A text that declines to answer and goes on to no answer: some sentence declines, every other one is an aside or
    declines too, or follows the declining first sentence without telling or asking anything (no number, no question).

    A sentence that declines, but turns to something else behind a comma, goes on to an answer.
    """
    if not text:
        return False
    parts = refusals.sentences(text)
    found = [p for p in parts if declines(p)]
    if not found or parts[-1].endswith("?"):
        return False
    for p in found:
        turn = _turns(p)
        if turn and len(_words(turn[turn.lastindex])) > 1 and not declines(turn[turn.lastindex]):
            return False
    others = [p for p in parts if p not in found and not _aside(p)]
    if any(p.endswith("?") for p in others):
        return False
    return not others or (parts[0] in found and not any(c.isdigit() for p in others for c in p) and len(others) <= len(found))


def refusal_model(samples: DataFrame) -> refusals.Model:
    """The model of refusing sentences, fitted on the refusals.FIT_TEXTS rows with the least hash of their texts."""
    h = F.xxhash64("answer", "ground_truth")
    x = samples.select("question", *FIELDS)
    total, n = x.count(), refusals.FIT_TEXTS
    if total > 4 * n:  # thin first: else every task would send n rows to the driver
        x = x.where(F.shiftrightunsigned(h, 1) < F.lit(int((1 << 63) * (2 * n / total))))
    rows = x.orderBy(h, "answer", "ground_truth").limit(n).collect()
    return refusals.train([r[f] for f in FIELDS for r in rows], _declines, [r["question"] for r in rows])


def copies(question: str | None, text: str | None) -> bool:
    """True if the text only repeats the question (or its last turn), perhaps lightly changed or introduced."""
    if not question or not text:
        return False
    tries = [_words(t.casefold()) for t in {question, _turn(question)[-1]}]
    end = _words(text[-300:].casefold()) if len(text) > 300 else []
    # A copy ends like the question: most texts are told apart by their last two words.
    if len(end) > 2 and not any(q and (end[-1] in q[-2:] or q[-1] in end[-2:]) for q in tries):
        return False
    a = _words(text.casefold())
    for q in tries:
        times = round(len(a) / len(q)) if q else 0
        if _copy(q, a) or (times > 1 and all(_copy(q, a[len(a) * k // times : len(a) * (k + 1) // times]) for k in range(times))):
            return True
    return False


def _copy(q: list[str], a: list[str]) -> bool:
    n, m = len(q), len(a)
    if n < 3 or m < 3:
        return n > 0 and q == a
    allowed = COPY_CHANGED * n
    if m > n + COPY_INTRO + allowed or m < n - allowed:
        return False
    if len(set(q) & set(a)) < (1 - COPY_CHANGED) * len(set(q)) - 1 or not (a[-1] in q[-2:] or q[-1] in a[-2:]):
        return False
    # Edit distance over words; up to COPY_INTRO words before the copy are free, none may follow it. Cells farther off
    # the diagonal than the changes allowed can't matter, so long pairs cost their length times that band.
    number: dict[str, int] = {}
    x, y = (np.array([number.setdefault(w, len(number)) for w in ws]) for ws in (q, a))
    steps = np.arange(m + 1, dtype=float)
    d = np.maximum(0.0, steps - COPY_INTRO)
    band = int(allowed) + COPY_INTRO + 1
    for i in range(n):
        lo, hi = max(0, i - band), min(m, i + band + 1)
        new = np.full(m + 1, np.inf) if hi - lo < m else np.empty(m + 1)
        new[lo] = d[lo] + 1
        new[lo + 1 : hi + 1] = np.minimum(d[lo + 1 : hi + 1] + 1, d[lo:hi] + (y[lo:hi] != x[i]))
        new[lo : hi + 1] = np.minimum.accumulate(new[lo : hi + 1] - steps[lo : hi + 1]) + steps[lo : hi + 1]
        d = new
    return bool(d[m] <= allowed)


def shortened(texts: DataFrame) -> DataFrame:
    """Distinct (core): hashes of the cores of texts that are a proper beginning of another text.

    Distinct cores (what stands behind a cut is left out) are range-sorted; whatever stands between a text and its
    extension begins with it too, so comparing neighbours suffices. The edges of the partitions are compared in a
    second, small step. A number that goes on with digits is another number: digits sort behind everything else, so that
    a neighbour goes on with a digit only if no text goes on otherwise.
    """
    distinct = texts.select(F.translate(cutoff.core(F.col("text")), "0123456789", _LATE).alias("text")).where("text != ''").distinct()
    ordered = distinct.repartitionByRange(F.col("text")).sortWithinPartitions("text").select("text", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part, head = None, None, None
        for b in batches:
            found = []
            for t, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if last is None:
                    head = t
                elif t.startswith(last) and not (last[-1] in _LATE and t[len(last)] in _LATE):
                    found.append(last)
                last, part = t, p
            yield pa.RecordBatch.from_arrays([pa.array([None] * len(found), pa.int32()), pa.array([None] * len(found), pa.string()), pa.array(found, pa.string())], names=["part", "head", "text"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([head], pa.string()), pa.array([last], pa.string())], names=["part", "head", "text"])

    got = cut(ordered.mapInArrow(run, "part int, head string, text string"))
    edges = got.where("part is not null").withColumn("next", F.lead("head").over(Window.orderBy("part"))).where("startswith(next, text)")
    edges = edges.where(~(F.instr(F.lit(_LATE), F.right("text", F.lit(1))).cast("boolean") & F.instr(F.lit(_LATE), F.substr("next", F.length("text") + 1, F.lit(1))).cast("boolean")))
    found = got.where("part is null").select("text").unionByName(edges.select("text"))
    return found.select(F.xxhash64(F.translate("text", _LATE, "0123456789")).alias("core")).distinct()


def inspect(samples: DataFrame, model: languages.Model, refusing: refusals.Model) -> DataFrame:
    """(field_name, record_id, grp, core, defects, tail columns) of the answers and ground truths that have a defect or
    an open end, in the checkpoint folder: one pass over the pairs. ``same`` is null where the end is not open."""
    share = samples.sparkSession.sparkContext.broadcast((model, refusing))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, refusing = share.value
        declines = lambda s: refusing.declines(s, _declines)
        for b in batches:
            questions = b.column("question").to_pylist()
            asked = m.found(m.scores(questions))
            for f in FIELDS:
                texts = b.column(f).to_pylist()
                defects: list[list[str]] = []
                for q, t, of, spoken, suspect in zip(questions, texts, asked, m.found(m.scores(texts)), refusals.suspects(texts)):
                    d = []
                    if f == "answer" and is_empty(t):
                        d.append("empty")
                    if suspect and is_refusal(t, declines):
                        d.append("refusal")
                    if copies(q, t):
                        d.append("copies_question")
                    if of is not None and of.langs and spoken is not None and len(spoken.langs) == 1 and spoken.langs[0] not in of.langs and languages.enough(t):
                        d.append("other_language")
                    defects.append(d)
                rows, tail = cutoff.tail_columns(texts)
                opened = np.full(len(texts), -1)
                opened[rows] = np.arange(len(rows))
                keep = np.flatnonzero((opened >= 0) | np.array([bool(d) for d in defects], bool))
                at, where = pa.array(keep), pa.array(opened[keep], mask=opened[keep] < 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f] * len(keep), pa.string()), *(b.column(c).take(at) for c in ("sample_index", "source", f"core_{f}")), pa.array([defects[i] for i in keep], pa.list_(pa.string())), *(c.take(where) for c in tail)],
                    names=["field_name", "record_id", "grp", "core", "defects", *cutoff.TAIL_NAMES],
                )

    keyed = samples.select("sample_index", "source", "question", *FIELDS, *[F.xxhash64(cutoff.core(F.col(f))).alias(f"core_{f}") for f in FIELDS])
    return cut(keyed.mapInArrow(run, "field_name string, record_id long, grp string, core long, defects array<string>, " + cutoff.TAIL))


def defects(samples: DataFrame, model: languages.Model) -> DataFrame:
    """Distinct (sample_index, field_name, defect) of the defective answers and ground truths.

    Redelivered rows count once. A missing ground truth is no defect. Rows without sample_index are left out; a null
    question can be neither copied nor be in another language.
    """
    base = samples.where(F.col("sample_index").isNotNull())
    seen = inspect(base, model, refusal_model(base))
    texts = cutoff.answer_texts(base, *FIELDS).where(F.col("text").isNotNull())
    ends = seen.where("same is not null").drop("defects")
    was_cut = cutoff.find_cut(texts, samples.select(F.col("question").alias("text")).where("text is not null"), shortened(texts), ends)
    truncated = was_cut.select(F.col("record_id").alias("sample_index"), "field_name", F.lit("truncated").alias("defect"))
    ruled = seen.select(F.col("record_id").alias("sample_index"), "field_name", F.explode("defects").alias("defect"))
    return truncated.unionByName(ruled).distinct()
