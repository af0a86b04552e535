"""Texts that only decline to answer, in English, French, German and Spanish."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a sentence that declines has in it. Apostrophes are straight.
DECLINES = [
    r"\b(?:i|we)\b[^.!?\n]{0,40}\b(?:can(?:no|'| no)?t|won't|will not|shall not|am not|are not|not able|unable|must decline|have to decline|decline to|refuse to|rather not|may not)\b",
    r"\b(?:i|we)(?:'m| am| are|'re)[^.!?\n]{0,20}\b(?:unable|not (?:able|allowed|permitted|comfortable))\b",
    r"\b(?:something|that|this)\b[^.!?\n]{0,20}\bi (?:won't|can't|cannot)\b",
    r"\bi (?:don't|do not) feel comfortable\b",
    r"\b(?:wouldn't|would not|isn't|is not|not) be(?:en)? appropriate\b|\bnot appropriate for me\b",
    r"\b(?:beyond|outside) what i(?:'m| am)?\b",
    r"\b(?:guidelines|policy|policies|rules)\b[^.!?\n]{0,30}\b(?:let|allow|permit|prevent|forbid)\b[^.!?\n]{0,20}\bme\b",
    r"\bno comment from me\b",
    r"\bas an? (?:ai |large )?(?:language model|assistant|ai)\b",
    r"\bne (?:peux|puis|pourrai|souhaite|veux|suis)\b[^.!?\n]{0,30}\b(?:pas|rien)\b",
    r"\b(?:je dois|suis obligé de|préfère) (?:refuser|décliner|ne pas)\b",
    r"\b(?:n'est|est) pas permis\b|\bdépasse ce que\b|\bmodèle de (?:langue|langage)\b",
    r"\b(?:kann|darf|möchte|werde|will) ich\b[^.!?\n]{0,40}\b(?:nicht|nichts|keine)\b|\bich (?:kann|darf|möchte|werde|will)\b[^.!?\n]{0,40}\b(?:nicht|nichts|keine)\b",
    r"\bmuss ich[^.!?\n]{0,20}\bablehnen\b|\bsage ich nichts\b|\bdarf ich mich\b|\brichtlinien\b[^.!?\n]{0,20}\b(?:erlauben|verbieten)\b|\bals sprachmodell\b",
    r"\bno (?:puedo|debo|quiero|se me permite|me es posible|estoy autorizad[oa])\b|\b(?:debo|tengo que) rechazar\b|\bprefiero no\b|\bme impiden\b|\bmodelo de lenguaje\b",
]
# What may stand beside such a sentence.
BESIDE = [
    r"\bsorry\b", r"\bregrettably\b", r"\bunfortunately\b", r"\banything else\b", r"\b(?:try|ask) (?:another|somebody|someone|something)\b", r"\binteresting topic\b", r"\bstill, i will\b",
    r"\bdésolée?\b", r"\bnavrée?\b", r"\bmalheureusement\b", r"\bautre question\b", r"\bautre chose\b",
    r"\bbedaure\b", r"\bes tut mir leid\b", r"\bfrag(?:e|en)? (?:bitte )?etwas anderes\b", r"\bandere frage\b",
    r"\blo siento\b", r"\bpor desgracia\b", r"\bdesafortunadamente\b", r"\botra (?:pregunta|cosa)\b",
]
# Words of which every sentence that declines has one at least; by them most texts are told apart at once.
SCREEN = (
    "i we me appropriate assistant ai model ne je suis préfère permis dépasse modèle ich sprachmodell richtlinien muss no debo tengo prefiero impiden modelo cant cannot"
).split()


def declines(text: Column, words: Column | None = None) -> Column:
    """Whether every sentence of a text declines to answer or goes along with that, and one declines. False for null and empty texts.

    words: the text's words in small letters, if they are at hand; they save the patterns for texts that can't match.
    """
    plain = F.translate(F.lower(text), "’‘`´", "'" * 4)
    core, any_of = "|".join(DECLINES), "|".join(DECLINES + BESIDE)
    # The first sentence tells most texts apart, however long they are; a sentence is searched once, so the time is linear.
    may = F.regexp_extract(plain, r"\p{L}[^.!?\n]*", 0).rlike(any_of)
    if words is not None:
        may = F.arrays_overlap(words, F.array(*map(F.lit, SCREEN))) & may
    every = F.forall(F.split(plain, r"[.!?\n]+"), lambda sentence: ~sentence.rlike(r"\p{L}") | sentence.rlike(any_of))
    return F.coalesce(may & plain.rlike(core) & every, F.lit(False))
