"""Sentences that state a verdict on their own variant, recognised over words.

A sentence is read as lower-case words and the marks ``:``, ``>`` and ``=``. A class term is a word that names a class, or
"uncertain significance". What surrounds it decides:

* it is the whole sentence, or what a heading word and a mark announce: a heading;
* the sentence says that criteria are met: a criteria statement;
* a word of judging governs it, or a verb of being links it to the sentence's subject, or the evidence is said to speak for it:
  a classification statement;
* it ends the sentence after a mark, or opens it before a criteria code: a label statement.

Verdicts on other variants and of prediction tools are evidence, not verdicts; verdicts of others are a category of their own.
Without a class term, only the statement that the evidence does not suffice is a verdict.
"""

from __future__ import annotations

import re

#: The categories.
HEADING, CRITERIA, STATEMENT, LABEL, INSUFFICIENT, EXTERNAL = (
    "heading", "criteria_statement", "classification_statement", "label_statement", "insufficient_evidence", "external_classification",
)

CLASS = frozenset("pathogenic benign vus".split())
UNSURE = frozenset("uncertain unknown unclear undetermined".split())
HEADS = frozenset("classification interpretation conclusion assessment verdict significance".split())
JUDGING = ("classif", "reclassif", "interpret", "consider", "regard", "assess", "categor", "designat", "report", "deem", "call")
BEING = frozenset("is was be been being are were remains remained".split())
SUBJECT = frozenset("this it variant change alteration substitution allele mutation".split())
SPEAKING = ("support", "indicat", "suggest", "favo", "point")
GROUNDS = frozenset("evidence data findings information".split())
LACKING = frozenset("insufficient inadequate limited lacking".split())
RULES = frozenset("criteria criterion guidelines guideline rules".split())
MEETING = ("meet", "met", "fulfil", "satisf")
ELSE = frozenset("other another different additional several similar nearby neighbouring neighboring".split())
THINGS = frozenset("variant variants change changes substitution substitutions allele alleles mutation mutations missense residue".split())
TOOLS = frozenset("silico computational tool tools algorithm algorithms score scores prediction predictions predicted predicts predict predictor predictors conservation functional assay assays frequency segregation splicing".split())
SOURCES = frozenset("laboratory laboratories lab labs submitter submitters clinvar clingen panel panels database databases".split())
MARKS = frozenset(":>=")
_WORD = re.compile(r"[a-z]+|\d+|[:>=]", re.I)
_CODE = re.compile(r"^(?:pvs|ps|pm|pp|ba|bs|bp)$")


def _words(sentence: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(sentence.replace("→", ">").replace(" - ", " : ").replace("—", ":"))]


def _terms(words: list[str]) -> list[tuple[int, int]]:
    """First and last word of each class term."""
    out = []
    for i, w in enumerate(words):
        if w in CLASS:
            out.append((i - 1 if i and words[i - 1] == "likely" else i, i))
        elif w == "significance" and (UNSURE & set(words[max(0, i - 2) : i])):
            first = max(k for k in range(max(0, i - 2), i) if words[k] in UNSURE)
            out.append((first - 2 if words[max(0, first - 2) : first] == ["variant", "of"] else first, i))
    return out


def _starts(word: str, stems: tuple[str, ...]) -> bool:
    return word.startswith(stems)


def _of_others(words: list[str]) -> bool:
    """Whether the words speak of another variant than the sentence's own."""
    return any(w in ELSE and THINGS & set(words[i + 1 : i + 4]) for i, w in enumerate(words))


def _lacks_evidence(words: list[str]) -> bool:
    for i, w in enumerate(words):
        after = words[i + 1 : i + 7]
        if w in GROUNDS and BEING & set(after) and "to" in words[i + 1 :] and (LACKING & set(after) or ("not" in after and "sufficient" in after)):
            return True
        if w == "significance" and any(b in BEING and UNSURE & set(after[k + 1 : k + 4]) for k, b in enumerate(after)):
            return True
    return False


def _governed(words: list[str], first: int, last: int) -> bool:
    before = words[max(0, first - 5) : first]
    if any(_starts(w, JUDGING) for w in before):
        return True
    if any(_starts(w, SPEAKING) for w in before) and GROUNDS & set(words[:first]):
        return True
    noun_follows = last + 1 < len(words) and words[last + 1] in THINGS and "a" not in before[-2:] and "an" not in before[-2:]
    return bool(BEING & set(words[max(0, first - 3) : first]) and SUBJECT & set(words[:first]) and not noun_follows)


def category(sentence: str) -> str | None:
    """Why a sentence states a verdict on its own variant, or None."""
    words = _words(sentence)
    terms = _terms(words)
    if _lacks_evidence(words):
        return INSUFFICIENT
    for first, last in terms:
        before = words[:first]
        marks = [i for i, w in enumerate(before) if w in MARKS]
        if not before and last == len(words) - 1 or marks and marks[0] <= 3 and HEADS & set(words[: marks[0]]):
            return HEADING
        met = any(_starts(w, MEETING) and RULES & set(words[i + 1 : i + 9]) for i, w in enumerate(before))
        governed = _governed(words, first, last)
        # a mark directly before, or a code in brackets directly behind
        labelled = (marks and marks[-1] == first - 1 and last == len(words) - 1) or (not before and last + 1 < len(words) and bool(_CODE.match(words[last + 1])))
        if not (met or governed or labelled):
            continue
        if met:
            return CRITERIA
        if _of_others(before) or (labelled and not governed and TOOLS & set(before)):
            continue
        judged_by = any(w in ("by", "in", "from") and SOURCES & set(words[i + 1 : i + 5]) for i, w in enumerate(words))
        if judged_by or any(w == "other" and SOURCES & set(words[i + 1 : i + 2]) for i, w in enumerate(words)):
            return EXTERNAL
        return STATEMENT if governed else LABEL
    return None
