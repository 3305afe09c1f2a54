"""Problem 1: personal data in free text, by candidate generation and gradient boosting.

High-recall generators propose overlapping spans of five kinds, each with a vector of format and context features. A name is proposed by its form alone (two or three
capitalised words, surname before a comma, capitals, initials), by a listed given name in any case, or in lower case after a word that announces one; whether its words are names is
a matter of the features: how much commoner a public vocabulary spells them with a capital, listed given names, endings, what stands around, the column of a table.
Boosted trees, trained on Spark on ``TRAIN_TEXTS`` labelled texts that ``personal_training`` makes (the documented bound), score the spans; per kind a
threshold, calibrated on held-out texts, selects, and among overlapping spans the best score wins (mailboxes first: a name within one
does not count). The directories of ``cwd`` have trees of their own, over what their words are and where they stand. The fitted trees are kept in the shared folder and loaded
where they are. ``redact`` replaces the selected spans by typed placeholders and leaves every other character.

Scale: one narrow pass over whole contents, no shuffle; only the trees are broadcast. Defined results: NULL and unreadable
contents give no places (``redact`` treats unreadable ones as one text), tool inputs are not searched, kinds count once per string, repeated rows each count.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import os
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_root
from .blocks import VOCABULARY, local_file, readable, replace_spans, ship_file, texts, unescaped

KINDS = ("email", "phone", "id_number", "address", "person_name")
TRAIN_TEXTS, HELD_OUT = 5_000, 2_000
#: Common given names of many countries, without accents (fixed values).
GIVEN = (
    "adam adrian agnes ahmed aiko aisha akira alan albert alejandro alex alexander ali alice amelie amina amir ana anders andrea andrei anita anna anne antonio astrid beatriz "
    "ben bjorn bram carla carlos carmen chen chiara chloe clara daniel david declan deepa diego dmitri elena elif emil emma erik eva fatima felix fernando fiona freya giulia grace "
    "greta hannah hans hassan helen henrik hiroshi ibrahim ilse imani ines ingrid irina isabel ivan jakub james jan jane javier john jonas jose julia kamal karin katarzyna kenji kwame "
    "lars laura lea leila lena leo liam lin lucia luca lukas maria marie mark marta mateo matteo maya mehmet mei mia michael mohammed mary naomi nadia nikolai nina noah noor nora olga "
    "oliver omar oscar paolo paul pedro peter petra piotr priya rachel rafael raj ravi robert rosa sam samuel sara sarah sofia soren stefan sven tariq thomas tomas ulrich vera victor "
    "wanjiru wei william yara yuki yusuf zofia"
).split()
#: Endings that are common in surnames of many countries (fixed values); one feature among others, never a condition.
SURNAME_END = re.compile(r"(?:sk[iya]|ska|strom|[qk]vist|quist|dottir|mann?|enko|chuk|son|sen|ov|ova|ev|eva|in|ina|ez|es|ic|vich|wicz|czyk|ian|yan|berg|stein|ton|ley|ford|er|ini|etti|ano|ura|ato|moto|escu|oglu|poulos|idis|shvili|dze|adze|vicius|wala|eira|inho)$")
FOLD = str.maketrans("áàâäãåéèêëíìîïóòôöõøúùûüýÿñçšžčćřěůłđğışÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕØÚÙÛÜÝÑÇŠŽČŁ", "aaaaaaeeeeiiiioooooouuuuyyncszccreuldgisAAAAAAEEEEIIIIOOOOOOUUUUYNCSZCL")

_L = r"[^\W\d_]"
_MAIL = re.compile(r"[\w.+\-]+@(?:[\w\-]+\.)+[A-Za-z]{2,}")
_MAIL_WORDS = re.compile(r"(?i)[\w.+\-]+ ?(?:[\[({<] ?at ?[\])}>]|\bat\b|＠) ?[\w\-]+(?: ?(?:\.|[\[({<] ?dot ?[\])}>]|\bdot\b) ?[\w\-]+)+")
_PHONE = re.compile(r"(?<![\w.\-/:@#+])(?:\+\d{1,3}|\(\d{2,5}\)|0\d{1,4}|\d{2,4})(?:[ .\-/]{0,2}\(?\d{1,10}\)?){1,6}(?![\w/:@]|[.\-]\d)")
_SSN = re.compile(r"(?<![\w\-.])\d{3}([- ]?)\d{2}\1\d{4}(?![\w\-])")
_LETTER_ID = re.compile(r"(?:[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[A-Z]|[A-Z]\d{3}(?:-\d{4}){2}|[A-Z]{1,2}(?=[A-Z0-9]*\d{3})[A-Z0-9]{7,8})")
_TAX = re.compile(r"(?<![\w\-.])\d{2} \d{3} \d{3} \d{3}(?![\w\-])")
_ID_WORD = re.compile(
    r"(?i)(?:\bssn|social security|soc\. ?sec\.?|passport|reisepass|pasaporte|passeport|\bdni|\bnif|\bnie|tax id|steuer-?id|steuernummer|\btin\b|driv\w+'?s? licen[cs]e|licen[cs]e|führerschein|permis|national id\w*|personalausweis|identity)"
    r"(?: ?(?:number|no\.?|nr\.?|num\.?|#|card))?[\"']?\s?[:=#]?\s?[\"']?(?P<v>[A-Z0-9](?:[A-Z0-9]|[ \-](?=[A-Z0-9]*\d)){5,15}(?:-[A-Z])?)(?!\w)"
)
_TOWN = rf"{_L}[\w'\-]+(?:[ \-]{_L}[\w'\-]+){{0,2}}"
_GAP = r"(?:,? ?\n?(?: *\d+\t)? *)"
_STREET = re.compile(
    rf"(?<![\w.\-/])\d{{1,5}}[a-zA-Z]? (?:[A-Z][\w'\-]+ ){{1,3}}(?:Street|St|Road|Rd|Lane|Ln|Drive|Dr|Avenue|Ave|Boulevard|Blvd|Court|Ct|Way|Place|Pl|Terrace|Square|Close)\b\.?(?P<rest>{_GAP}(?:(?:Apt|Unit|Suite|Flat) \w+,? )?(?P<town>[A-ZÀ-Þ][\w'\-]+(?: [A-ZÀ-Þ][\w'\-]+){{0,2}})(?: \d{{4,5}})?)?"
)
_RUE = re.compile(rf"(?<![\w.\-/])\d{{1,4}}(?: bis| ter)?,? (?:rue|avenue|boulevard|place|chemin|quai|impasse|allée) (?:(?:de|du|des|la|le|l'|d') ?)*{_TOWN},?{_GAP}\d{{5}} (?P<town>{_TOWN})")
_STRASSE = re.compile(rf"[A-ZÄÖÜ][\w\- ]{{1,20}}?(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|ufer) \d{{1,4}}[a-z]?,?{_GAP}\d{{5}} (?P<town>{_TOWN})")
_CALLE = re.compile(rf"(?:Calle|Avenida|Avda\.|Plaza|Paseo|C/|Via|Viale) {_TOWN},? \d{{1,4}},?(?: \d+º \w,?)?{_GAP}\d{{5}} (?P<town>{_TOWN})")
_INITIAL = re.compile(rf"[A-ZÀ-Þ]\. ?(?:[A-ZÀ-Þ]\. ?)?[A-ZÀ-Þ]{_L}{{2,}}(?:-[A-ZÀ-Þ]{_L}+)?")
_LAST_INITIAL = re.compile(rf"([A-ZÀ-Þ]{_L}{{2,}}), [A-ZÀ-Þ]\.$")
_COMMA_INITIAL = re.compile(r", [A-ZÀ-Þ]\.")
_AFTER_GIVEN = re.compile(rf"(?: [A-Za-zÀ-Þ]\.)?[ \n]+(?: *\d+\t)?((?:(?:von|van|de|di|al) )?{_L}{{3,}}(?:-{_L}+)?)")
_BEFORE_GIVEN = re.compile(rf"(?<![\w.@/\-])({_L}{{3,}}(?:-{_L}+)?), ?$")

#: Words that announce a person (fixed values).
PERSON_CUE = r"(?:author|maintainer|owner|reviewer|reporter|assignee|approver|name|contact|contacto|cc|by|from|ask|tell|meet|thank|thanks|dear|hi|mr|ms|mrs|dr|prof|herr|frau|señora?|madame|monsieur|client|cliente|customer|employee|patient|tenant|member|user|colleague|applicant|belongs to|signed)"
#: Context words (fixed values); each group is one feature on the 40 characters before a span.
CONTEXT = [
    re.compile(x, re.IGNORECASE)
    for x in (
        r"\b(?:tel|tél|telefon\w*|teléfono|phone|call|dial|mobile|cell|fax|pager|handy|reach|ring|hotline|appel\w*|rappel\w*|llam\w*|number)\b",
        r"\b(?:ssn|social|sec|passport|reisepass|pasaporte|passeport|dni|nif|nie|tax|steuer|tin|licen[cs]e|identity|national|personalausweis)\b",
        r"\b(?:e-?mail|mail|mailto|to|cc|bcc|from|contact|contacto|send|write)\b",
        rf"\b{PERSON_CUE}\b",
        r"\b(?:address|adresse|dirección|ship|deliver\w*|lives?|resid\w+|street|office|home|visit)\b",
        r"\b(?:build|trace|job|version|release|port|line|commit|run|ticket|issue|request|order|batch|id|at|took|n|in|error|warn|info|debug)\b",
        r"\b(?:ssh|scp|git|clone|rsync|curl|psql|connect|dsn|pin|pg_dump|install)\b|://\S*$|@$",
        r"\b(?:the|a|an|our|this|that|each|every|der|die|das|le|la|el)\s*$",
    )
]
AFTER = [
    re.compile(r"^:[\w/~]|^:\d+/"), re.compile(r"^[;,|\t'\"<(]"), re.compile(r"^ ?(?:said|says|wrote|asked|asks|approved|reported|requested|mentioned|thinks|confirmed|signed|joined|called)\b"),
    re.compile(r"^ [A-ZÀ-Þ][a-zß-ÿ]"), re.compile(r"^,? ?\d"), re.compile(r"^[^.\n]{0,16}\b(?:number|phone|mobile|cell|line)\b"),
]
#: Words of a table's header that say what a column holds, in the order of KINDS (fixed values).
COLUMNS = [
    re.compile(x, re.IGNORECASE)
    for x in (r"mail", r"phone|mobile|tel|cell|fax", r"ssn|passport|reisepass|\bdni|\bnif|\bnie|tax|licen[cs]e|national|identity", r"address|street|adresse|location", r"name|user|owner|contact|person|customer|client|employee|author")
]


def shape(s: str) -> str:
    return re.sub(r"\d", "9", s)


#: Digit shapes that telephone numbers are commonly written in (fixed values, as patterns over shapes).
PHONE_SHAPE = re.compile(
    r"^(?:\+9{1,3}[ .\-]?(?:\(?0?\)?9{1,4}\)?[ .\-]?)(?:9{2,4}[ .\-]?){1,4}9{0,3}|\(9{3}\) ?9{3}-9{4}|9{3}[-.]9{3}[-.]9{4}|0?9(?:[ .]9{2}){4}|9{3} 9{4} 9{4}|9{5} 9{3} 9{3}|9{5} 9{6}|9{3,5}/9{5,9}|00 ?9{2} ?\(0\)9{1,4} 9{3,6}(?:[- ]9{2,4})*)$"
)


@lru_cache(maxsize=1)
def given_names():
    import ahocorasick

    a = ahocorasick.Automaton()
    for n in GIVEN:
        a.add_word(n, n)
    a.make_automaton()
    return a


_CAP = rf"[A-ZÀ-Þ](?:{_L}|['’](?=[A-ZÀ-Þ]))*[a-zß-ÿ]{_L}*(?:-[A-ZÀ-Þ]{_L}+)?"
_JOIN = r"(?: |\n *(?:\d+\t *)?)(?:(?:von|van|der|den|de|del|di|da|dos|al|el|bin|la|le) ){0,2}"
_RUN = re.compile(rf"(?<![\w.@/\\\-'’])(?:{_CAP}|[A-ZÀ-Þ]\.)(?:{_JOIN}(?:{_CAP}|[A-ZÀ-Þ]\.(?= )))+(?![\w@(/\\]|[.\-]\w)")
_RUN_WORD = re.compile(rf"{_CAP}|[A-ZÀ-Þ]\.")
_COMMA = re.compile(rf"(?<![\w.@/\\\-'’])({_CAP}|[A-ZÀ-Þ]{{3,}}), ({_CAP}|[A-ZÀ-Þ]{{3,}})(?: [A-ZÀ-Þ]\.)?(?![\w@(/\\])")
_CAPITALS = re.compile(r"(?<![\w.@/\\\-'’])[A-ZÀ-Þ]{3,}(?:-[A-ZÀ-Þ]+)?(?: [A-ZÀ-Þ]\.)? [A-ZÀ-Þ]{3,}(?:-[A-ZÀ-Þ]+)?(?![\w@(/\\=:])")
_ANNOUNCED = re.compile(rf"\b{PERSON_CUE}\b[\"']?\s?[:=]?\s?[\"'(<]?({_L}{{3,}})(, | )({_L}{{3,}})(?![\w@(/\\.=])")


def names_in(text: str, folded: str, spelt: dict[str, tuple[float, float]]) -> Iterator[tuple[int, int, str]]:
    """Names by form, by a listed given name with a word before or after it in any case, by initials, and in lower case after a word that announces one."""
    n = len(text)
    for run in _RUN.finditer(text):
        ws = [(m.start() + run.start(), m.end() + run.start()) for m in _RUN_WORD.finditer(run[0])]
        for i in range(len(ws) - 1):
            for j in (i + 1, i + 2):
                if j < len(ws) and ws[i][1] - ws[i][0] > 2 and ws[j][1] - ws[j][0] > 2:
                    yield ws[i][0], ws[j][1], "pair"
    for rx, how in ((_COMMA, "comma"), (_CAPITALS, "capitals")):
        for m in rx.finditer(text):
            yield m.start(), m.end(), how
    for m in _ANNOUNCED.finditer(folded):
        rare = [spelt.get(w, (17.0, 17.0)) for w in (m[1], m[3])]
        if all(lower >= title or lower > 15 for lower, title in rare) and text[m.start(1) : m.end(3)].islower():
            yield m.start(1), m.end(3), "announced"
    for end, name in given_names().iter(folded):
        s, e = end - len(name) + 1, end + 1
        if (s and (folded[s - 1].isalnum() or folded[s - 1] in "_@")) or (e < n and (folded[e].isalnum() or folded[e] == "_")):
            continue
        m = _AFTER_GIVEN.match(text, e)
        if m:
            yield s, m.end(), "after"
        if (b := _BEFORE_GIVEN.search(text, max(0, s - 40), s)) and not (s and text[s - 1] == "\n"):
            last = re.match(r" [A-ZÀ-Þ]\.", text[e : e + 3])
            yield b.start(1), e + (last.end() if last else 0), "before"
    if "." in text:
        for m in _INITIAL.finditer(text):
            if not m.start() or not (text[m.start() - 1].isalnum() or text[m.start() - 1] in "_."):
                yield m.start(), m.end(), "initial"
        for m in _COMMA_INITIAL.finditer(text):
            if b := _LAST_INITIAL.search(text, max(0, m.start() - 30), m.end()):
                yield b.start(), b.end(), "initial"


def _around(rx: re.Pattern, text: str, at: int, left: int, right: int) -> re.Match | None:
    """The match of ``rx`` that covers position ``at``, looking only near it."""
    for m in rx.finditer(text, max(0, at - left), min(len(text), at + right)):
        if m.start() <= at < m.end():
            return m
        if m.start() > at:
            return None
    return None


def candidates(text: str, spelt: dict[str, tuple[float, float]]) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, generator) of all proposals; they may overlap. Cheap marks are sought first, the forms only near them."""
    out: list[tuple[int, int, str, str]] = []
    n_text = len(text)
    at = text.find("@")
    while at >= 0:
        if (m := _around(_MAIL, text, at, 80, 120)) and not _IN_URL.search(text, max(0, m.start() - 80), m.start()):
            out.append((m.start(), m.end(), "email", "plain"))
        at = text.find("@", max(at + 1, m.end() if m else 0))
    low = text.lower()
    if len(low) != n_text:  # a letter whose lower case is two: places must stay
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    if any(x in low for x in _AT_WORDS) or " at " in low and _AT_DOT.search(low):
        for mark in _AT_MARK.finditer(text):
            if m := _around(_MAIL_WORDS, text, mark.start(), 80, 160):
                out.append((m.start(), m.end(), "email", "words"))
    for run in _NUMBERS.finditer(text):
        s, e = run.start(), run.end()
        if d := _DATE.match(text, s):
            s = d.end()
            if e - s < 8:
                continue
        for m in _PHONE.finditer(text, s, min(len(text), e + 2)):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone", "digits"))
        out += [(m.start(), m.end(), "id_number", "ssn") for m in _SSN.finditer(text, s, min(len(text), e + 2))]
        out += [(m.start(), m.end(), "id_number", "tax") for m in _TAX.finditer(text, s, min(len(text), e + 2))]
    for m in _CODES.finditer(text):
        if _LETTER_ID.fullmatch(m[0]) and not (m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in "_-/.")):
            out.append((m.start(), m.end(), "id_number", "letter"))
    if any(x in low for x in _ID_WORDS):
        out += [(m.start("v"), m.end("v"), "id_number", "word") for m in _ID_WORD.finditer(text) if sum(c.isdigit() for c in m["v"]) >= 5]
    for rx, g, marks in _ADDRESS:
        if any(x in text for x in marks):
            out += [(m.start(), m.end(), "address", g) for m in rx.finditer(text)]
    out += [(s, e, "person_name", g) for s, e, g in names_in(text, low.translate(FOLD), spelt)]
    return out


_AT_WORDS = ("(at)", "[at]", "{at}", "<at>", "( at )", "[ at ]", " dot ", "＠")
_AT_DOT = re.compile(r" at [\w\-]+ ?(?:\.|[\[({<] ?dot)")
_AT_MARK = re.compile(r"(?i)[\[({<] ?at ?[\])}>]|\bat\b|＠")
_IN_URL = re.compile(r"://[^\s/@]*$")
_NUMBERS = re.compile(r"[+(\d][\d().\-/ ]{7,}")
_DATE = re.compile(r"\d{4}-\d\d-\d\d(?:[ T]\d\d)?")
_CODES = re.compile(r"[A-Z\d][A-Z\d\-]{7,13}(?![\w\-])")
_ID_WORDS = ("ssn", "social", "soc.", "passport", "reisepass", "pasaporte", "passeport", "dni", "nif", "nie", "tax id", "steuer", "tin", "licen", "führerschein", "permis", "national id", "personalausweis", "identity")
_ADDRESS = (
    (_STREET, "street", (" Street", " St", " Road", " Rd", " Lane", " Ln", " Drive", " Dr", " Ave", " Boulevard", " Blvd", " Court", " Ct", " Way", " Place", " Pl", " Terrace", " Square", " Close")),
    (_RUE, "rue", (" rue ", " avenue ", " boulevard ", " place ", " chemin ", " quai ", " impasse ", " allée ")),
    (_STRASSE, "strasse", ("straße ", "strasse ", "str. ", "weg ", "gasse ", "allee ", "platz ", "ring ", "ufer ")),
    (_CALLE, "calle", ("Calle ", "Avenida ", "Avda. ", "Plaza ", "Paseo ", "C/ ", "Via ", "Viale ")),
)
GENERATORS = ("plain", "words", "digits", "ssn", "letter", "tax", "word", "street", "rue", "strasse", "calle", "after", "before", "initial", "pair", "comma", "capitals", "announced")
N_FEATURES = len(KINDS) + len(GENERATORS) + len(CONTEXT) + len(AFTER) + len(COLUMNS) + 28
_VIEWER = re.compile(r"^ *\d+\t")
_CELL_NAME = re.compile(r"[\s\"']*[A-Za-z_][A-Za-z_ ]*[\"'\s]*")


class Tables:
    """For each line of a text the header of the table it is in: the nearest line above, in a run of lines of as many cells, whose cells are all names."""

    def __init__(self, text: str) -> None:
        self.starts, self.heads, at = [], [], 0
        now: dict[str, list[str] | None] = {}
        for line in text.split("\n"):
            body = _VIEWER.sub("", line)
            found: tuple[str, list[str], int] | None = None
            for d in "\t;,|":
                if d not in body:
                    now[d] = None
                    continue
                cells = body.split(d)
                if all(_CELL_NAME.fullmatch(c) for c in cells if c) and any(c.strip() for c in cells):
                    now[d] = cells
                elif (head := now.get(d)) and len(head) == len(cells):
                    found = found or (d, head, len(line) - len(body))
                else:
                    now[d] = None
            self.starts.append(at)
            self.heads.append(found)
            at += len(line) + 1

    def column(self, text: str, at: int) -> str:
        """The name of the column that holds a position, or ''."""
        i = bisect.bisect_right(self.starts, at) - 1
        if not (found := self.heads[i]):
            return ""
        d, head, skip = found
        return head[min(len(head) - 1, text.count(d, self.starts[i] + skip, at))]


def features(text: str, c: tuple[int, int, str, str], spelt: dict[str, tuple[float, float]], tables: Tables) -> list[float]:
    """Format and context of a candidate."""
    s, e, kind, gen = c
    span, before, after = text[s:e], text[max(0, s - 40) : s], text[e : e + 24]
    near = re.split(r"[.!?]\s|\n", before)[-1]
    letters = re.findall(rf"{_L}{{2,}}", span)
    folded = [w.lower().translate(FOLD) for w in letters] or [""]
    given = [w in _GIVEN for w in folded]
    other = [w for w, g in zip(folded, given) if not g] or folded[-1:]
    digits = sum(x.isdigit() for x in span)
    cases = {("u" if w.isupper() else "l" if w.islower() else "t") for w in letters}
    column = tables.column(text, s)
    name = kind == "person_name"
    ranks = [spelt.get(w, (17.0, 17.0)) for w in (folded if name else [])] or [(17.0, 17.0)]
    lean = [a - b for a, b in ranks]
    up = re.search(r"([A-ZÀ-Þ][^\W\d_]*)[\w'\-]* $", before)  # a word with a capital before it: part of the name, or only the first of the sentence
    up_lean = -np.subtract(*spelt.get(up[1].lower().translate(FOLD), (17.0, 17.0))) if up else 0.0
    return [
        *[float(kind == k) for k in KINDS], *[float(gen == g) for g in GENERATORS], *[float(bool(r.search(near))) for r in CONTEXT], *[float(bool(r.search(after))) for r in AFTER],
        *[float(bool(column) and bool(r.search(column))) for r in COLUMNS],
        float(len(span)), float(digits), float(span.startswith("+")), float("(" in span), float(bool(PHONE_SHAPE.match(shape(span)))),
        float(sum(given)), float(bool(SURNAME_END.search(other[-1]))), float(len(letters)), float(len(cases)), float("l" in cases and len(cases) == 1), float("u" in cases and len(cases) == 1),
        float(bool(re.match(r"(?i)(?:git|deploy|root|app|svc|admin|ubuntu|ec2-user)@", span))), float(bool(re.search(r"[A-Za-z]", after[:1])) or bool(re.search(r"[\w/]$", before))),
        float(kind == "address" and bool(re.search(r"[A-ZÀ-Þ][\w\-]+(?: \d{4,5})?$", span)) and len(letters) >= 3), float(kind == "email" and bool(re.search(r"\.(?:py|ts|js|go|rs|sql|md|sh|json|yaml|toml)$", span))),
        float(bool(re.search(r"[\t;,|] ?$", before))), float(bool(re.search(r"[\"'(<=:] ?$", before))), float(bool(re.search(r"(?:^|[.!?:]\s|\n)$", before)) or s == 0),
        float(bool(up)), up_lean, float(bool(re.search(r"\d[a-z]?,? $", before))),
        lean[0], lean[-1], min(lean), ranks[0][0], ranks[-1][0], min(r[0] for r in ranks), float(sum(a == b == 17.0 for a, b in ranks)),
    ]


_GIVEN = frozenset(GIVEN)


class Trees:
    """A trained ensemble as arrays: cheap to broadcast, evaluated for a whole batch of candidates at once."""

    def __init__(self, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]], weights: list[float], thresholds: dict[str, float]) -> None:
        self.trees, self.weights, self.thresholds = trees, weights, thresholds

    def to_json(self) -> dict:
        return {"trees": [[a.tolist() for a in t] for t in self.trees], "weights": self.weights, "thresholds": self.thresholds}

    @classmethod
    def from_json(cls, d: dict) -> Trees:
        kinds = (np.int64, np.float64, np.int64, np.int64, np.float64)
        return cls([tuple(np.array(a, k) for a, k in zip(t, kinds)) for t in d["trees"]], d["weights"], d["thresholds"])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "model"}

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for (feature, cut, left, right, value), weight in zip(self.trees, self.weights):
            at = np.zeros(len(x), np.int64)
            for _ in range(8):
                inner = feature[at] >= 0
                if not inner.any():
                    break
                go = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += weight * value[at]
        return 1.0 / (1.0 + np.exp(-2.0 * total))


def _unpack(model) -> tuple[list[tuple], list[float]]:
    """The nodes of a fitted Spark model as arrays."""
    trees = []
    for t in model.trees:
        nodes: list[list[float]] = []

        def walk(node) -> int:
            i = len(nodes)
            nodes.append([-1, 0.0, 0, 0, float(node.prediction())])
            if node.subtreeDepth() > 0:
                split = node.split()
                nodes[i][0], nodes[i][1] = split.featureIndex(), split.threshold()
                nodes[i][2], nodes[i][3] = walk(node.leftChild()), walk(node.rightChild())
            return i

        walk(t._call_java("rootNode"))
        a = np.array(nodes)
        trees.append((a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4]))
    return trees, list(model.treeWeights)


def labelled(n: int, seed: int, vocabulary: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Candidates of ``n`` made texts: features, whether they cover a planted span of their kind, kinds."""
    from .personal_training import make

    spelt = spellings(vocabulary)
    x, y, kinds = [], [], []
    for text, spans in make(n, seed, plain_words(spelt)):
        tables = Tables(text)
        for c in candidates(text, spelt):
            x.append(features(text, c, spelt, tables))
            y.append(float(any(k == c[2] and min(e, c[1]) - max(s, c[0]) >= 0.8 * (max(e, c[1]) - min(s, c[0])) for s, e, k in spans)))
            kinds.append(c[2])
    return np.array(x), np.array(y), kinds


def plain_words(spelt: dict[str, tuple[float, float]]) -> list[str]:
    """Words that the vocabulary spells more commonly in lower case: the made look-alikes are put together from them."""
    return sorted(w for w, (a, b) in spelt.items() if len(w) >= 3 and w.isascii() and a < b)


def _fit(spark: SparkSession, x: np.ndarray, y: np.ndarray) -> Trees:
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.linalg import Vectors

    data = spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], ["features", "label"]).coalesce(2).cache()
    model = GBTClassifier(maxIter=20, maxDepth=5, stepSize=0.3, seed=7, maxBins=32).fit(data)
    data.unpersist()
    out = Trees(*_unpack(model), {})
    out.model = model
    return out


def train(spark: SparkSession, vocabulary: str = VOCABULARY, n: int = TRAIN_TEXTS) -> Trees:
    """Boosted trees by Spark's GBTClassifier on a bounded sample, and per kind the lowest threshold whose F1 on held-out texts is the best but for 0.002."""
    x, y, _ = labelled(n, 1, vocabulary)
    out = _fit(spark, x, y)
    hx, hy, hk = labelled(HELD_OUT, 2, vocabulary)
    p, hk = out.score(hx), np.array(hk)
    for k in KINDS:
        m = hk == k
        f1 = {}
        for cut in np.arange(0.2, 0.81, 0.05):
            tp = float(((p >= cut) & (hy > 0) & m).sum())
            f1[float(cut)] = 2 * tp / max(1.0, float(((p >= cut) & m).sum() + ((hy > 0) & m).sum()))
        out.thresholds[k] = min(c for c in f1 if f1[c] >= max(f1.values()) - 0.002)  # of equals the one that misses least
    return out


_FITTED: dict[str, tuple[Trees, Trees]] = {}


def fitted(spark: SparkSession, vocabulary: str = VOCABULARY, n: int = TRAIN_TEXTS, root: str | None = None) -> tuple[Trees, Trees]:
    """The trees for texts and for directories: from memory, else from the shared folder (or ``root``), else trained and written there.

    The name of the saved model is a digest of this code, the vocabulary and ``n``, so that another version never loads it.
    """
    here = os.path.dirname(os.path.abspath(__file__))
    parts = [open(f, "rb").read() for f in (os.path.join(here, "personal.py"), os.path.join(here, "personal_training.py"), vocabulary)]
    key = hashlib.sha256(b"\0".join([*parts, str(n).encode()])).hexdigest()[:24]
    if key not in _FITTED:
        path = f"{root or shared_root(spark)}/personal-trees-{key}"
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            saved = [json.loads(r[0]) for r in spark.read.text(path).collect()]  # two rows
            _FITTED[key] = tuple(Trees.from_json(t) for t in sorted(saved, key=lambda t: "cwd" in t["thresholds"]))
        else:
            with ThreadPoolExecutor(2) as pool:  # two fits of many small jobs each, side by side
                _FITTED[key] = tuple(f.result() for f in [pool.submit(fit, spark, vocabulary, n) for fit in (train, train_paths)])
            spark.createDataFrame([(json.dumps(t.to_json()),) for t in _FITTED[key]], "value string").coalesce(1).write.mode("overwrite").text(path)
    return _FITTED[key]


def select(spans: list[tuple[int, int, str]], scores: np.ndarray) -> list[tuple[int, int, str]]:
    """Spans without overlap: mailboxes first, then by score and length."""
    order = sorted(range(len(spans)), key=lambda i: (spans[i][2] != "email", spans[i][2] == "person_name", -round(float(scores[i]), 2), spans[i][0] - spans[i][1]))
    out: list[tuple[int, int, str]] = []
    for i in order:
        s, e, _ = spans[i]
        if all(e <= a or s >= b for a, b, _ in out):
            out.append(spans[i])
    return sorted(out)


_DIR_SEP = re.compile(r"[\\/]")
_CAMEL = re.compile(rf"(?:[A-ZÀ-Þ][^\W\d_A-ZÀ-Þ]+){{2,3}}")
#: Directories whose children are named after users (fixed values).
HOMES = frozenset("home users user people staff profiles".split() + ["documents and settings"])
JOINTS = (".", "_", "-", " ", "camel", "joined")
N_PATH = len(JOINTS) + 17


@lru_cache(maxsize=2)
def spellings(path: str) -> dict[str, tuple[float, float]]:
    """Of each word of a ranked vocabulary the logarithms of the rank of its lower-case and of its capitalised spelling: names are commoner capitalised."""
    import base64

    out: dict[str, list[float]] = {}
    with open(local_file(path), "rb") as f:
        for n, line in enumerate(f):
            token = base64.b64decode(line.split()[0]).decode("utf-8", "replace")
            w = token.strip()
            if len(w) >= 2 and w.isalpha() and (w.islower() or w.istitle() and token[0] == " "):  # capitalised within an identifier says nothing
                v = out.setdefault(w.lower().translate(FOLD), [17.0, 17.0])
                v[w.istitle()] = min(v[w.istitle()], float(np.log2(n + 2)))
    return {w: (a, b) for w, (a, b) in out.items()}


def path_candidates(cwd: str) -> list[tuple[int, int, str, tuple[str, ...], str, str, int]]:
    """(start, end, kind, words, how they are joined, parent directory, directories below) of all proposals: mailboxes, and two or three words, apart or run together."""
    out, at, parts = [], 0, _DIR_SEP.split(cwd)
    for i, part in enumerate(parts):
        folded, parent, below = part.translate(FOLD), parts[i - 1].lower() if i else "", len(parts) - i - 1
        ws = tuple(w for w in re.split(r"[ ._,\-]+", folded) if w)
        add = lambda words, joint: out.append((at, at + len(part), "person_name", tuple(w.lower() for w in words), joint, parent, below))  # noqa: E731, B023
        if _MAIL.fullmatch(part):
            out.append((at, at + len(part), "email", (), "", parent, below))
        elif len(ws) in (2, 3) and all(w.isalpha() for w in ws) and max(map(len, ws)) >= 2:
            add(ws, next((x for x in JOINTS[:4] if x in part.strip("._- ")), " "))
        elif _CAMEL.fullmatch(part):
            add(re.findall(r"[A-Z][^\W\d_A-Z]+", folded), "camel")
        elif folded.isalpha() and 6 <= len(folded) <= 30:
            low, known = folded.lower(), spellings(VOCABULARY)
            for k in range(2, len(low) - 2):
                if k >= 3 and low[:k] in _GIVEN or len(low) - k >= 3 and low[k:] in _GIVEN or k >= 4 and len(low) - k >= 4 and low[:k] in known and low[k:] in known:
                    add((low[:k], low[k:]), "joined")
        at += len(part) + 1
    return out


def path_features(c: tuple, words: dict[str, tuple[float, float]]) -> list[float]:
    """What the words of a directory are, and where it stands."""
    _, _, _, ws, joint, parent, below = c
    given = [w in _GIVEN for w in ws]
    one = given.index(True) if any(given) else -1
    other = [w for i, w in enumerate(ws) if i != one]  # all but one given name
    lower, title = ([words.get(w, (17.0, 17.0))[k] for w in other] for k in (0, 1))
    lean = [a - b for a, b in zip(lower, title)]
    return [
        *[float(joint == j) for j in JOINTS], float(parent in HOMES), float(below), float(below == 0), float(len(ws)), float(sum(given)), float(bool(SURNAME_END.search(other[-1]))),
        float(min(map(len, other))), float(max(map(len, other))), float(min(map(len, ws))), min(lower), max(lower), min(lean), max(lean), float(sum(a == b == 17.0 for a, b in zip(lower, title))), float(given[0]),
        words.get("".join(ws), (17.0, 17.0))[0], float(len(other[-1]) >= 3 and lower[-1] < title[-1]),
    ]


def train_paths(spark: SparkSession, vocabulary: str = VOCABULARY, n: int = TRAIN_TEXTS) -> Trees:
    """Boosted trees for the directories of ``cwd``, and the threshold of the best F1 on held-out paths."""
    from .personal_training import make_paths

    words = spellings(vocabulary)
    plain = plain_words(words)

    def sample(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        got = [(path_features(c, words), float((c[0], c[1]) == span)) for path, span in make_paths(k, seed, plain) for c in path_candidates(path) if c[2] == "person_name"]
        return np.array([a for a, _ in got]), np.array([b for _, b in got])

    x, y = sample(n, 1)
    out = _fit(spark, x, y)
    hx, hy = sample(HELD_OUT, 2)
    p = out.score(hx)
    f1 = lambda cut: 2 * float(hy[p >= cut].sum()) / float((p >= cut).sum() + hy.sum())
    out.thresholds["cwd"] = float(max(np.arange(0.2, 0.81, 0.05), key=lambda cut: (round(f1(cut), 4), -abs(cut - 0.5))))
    return out


class PathSelector:
    """The selected directories of a path; paths repeat, so each is decided once in a task."""

    def __init__(self, trees: Trees, vocabulary: str) -> None:
        self.trees, self.words, self.seen = trees, spellings(vocabulary), {}

    def __call__(self, cwd: str | None) -> list[tuple[int, int, str]]:
        if not cwd:
            return []
        if cwd not in self.seen:
            if len(self.seen) > 100_000:
                self.seen.clear()
            cands = path_candidates(cwd)
            p = self.trees.score(np.array([path_features(c, self.words) if c[3] else [0.0] * N_PATH for c in cands])) if cands else []
            self.seen[cwd] = sorted({c[:3] for c, q in zip(cands, p) if c[2] == "email" or q >= self.trees.thresholds["cwd"]})
        return self.seen[cwd]


class Selector:
    """Finds the selected spans of many texts at once; made once per task."""

    def __init__(self, trees: Trees, vocabulary: str) -> None:
        self.trees, self.spelt = trees, spellings(vocabulary)

    def __call__(self, batch: list[str]) -> list[list[tuple[int, int, str]]]:
        owner, cands, x = [], [], []
        for i, text in enumerate(batch):
            mine = dict.fromkeys(candidates(text, self.spelt))
            tables = Tables(text) if mine else None
            for c in mine:
                owner.append(i)
                cands.append(c)
                x.append(features(text, c, self.spelt, tables))
        out: list[list[tuple[int, int, str]]] = [[] for _ in batch]
        if not cands:
            return out
        p = self.trees.score(np.array(x))
        p = p + np.array([0.5 if c[3] == "word" else 0.0 for c in cands]) * (p >= 0.5)  # an id that its word names beats a telephone number of the same digits
        kept: dict[int, list[int]] = {}
        for j, (i, c) in enumerate(zip(owner, cands)):
            if p[j] >= self.trees.thresholds.get(c[2], 0.5):
                kept.setdefault(i, []).append(j)
        for i, js in kept.items():
            out[i] = select([cands[j][:3] for j in js], p[js])
        return out


def found(records: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """p1_found: (rec_id, place, kind), once per string and kind."""
    spark = records.sparkSession
    vocabulary = ship_file(spark, vocabulary)
    trees = spark.sparkContext.broadcast(fitted(spark, vocabulary))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        select_spans, select_dirs = Selector(trees.value[0], vocabulary), PathSelector(trees.value[1], vocabulary)
        for pdf in batches:
            rows: list[tuple] = []
            keys, strings = [], []
            for rec, cwd, raw in zip(pdf.rec_id, pdf.cwd, pdf.msg_content):
                rows += dict.fromkeys((rec, "cwd", k) for _, _, k in select_dirs(cwd))
                for place, text, _ in texts(raw):
                    keys.append((rec, place))
                    strings.append(text)
            for (rec, place), spans in zip(keys, select_spans(strings)):
                rows += dict.fromkeys((rec, place, k) for _, _, k in spans)
            yield pd.DataFrame(list(dict.fromkeys(rows)), columns=["rec_id", "place", "kind"])

    return records.select("rec_id", "cwd", "msg_content").where("cwd IS NOT NULL OR msg_content IS NOT NULL").mapInPandas(run, "rec_id long, place string, kind string")


def redact(records: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(rec_id, n_spans, cwd, msg_content) of all rows, each selected span as ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``, ``[ADDRESS]`` or ``[PERSON_NAME]``."""
    spark = records.sparkSession
    vocabulary = ship_file(spark, vocabulary)
    trees = spark.sparkContext.broadcast(fitted(spark, vocabulary))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        select_spans, select_dirs = Selector(trees.value[0], vocabulary), PathSelector(trees.value[1], vocabulary)
        for pdf in batches:
            rows = []
            for rec, cwd, raw in zip(pdf.rec_id, pdf.cwd, pdf.msg_content):
                if raw and not readable(raw):  # cut off: its mentions have no place, but must not stay
                    whole, at = unescaped(raw)
                    spans, dirs, out = select_spans([whole])[0], select_dirs(cwd), raw
                    for s, e, k in reversed(spans):
                        out = f"{out[: at[s]]}[{k.upper()}]{out[at[e] :]}"
                    for s, e, k in reversed(dirs):
                        cwd = f"{cwd[:s]}[{k.upper()}]{cwd[e:]}"
                    rows.append((rec, len(spans) + len(dirs), cwd, out))
                    continue
                strings = [t for _, t, _ in texts(raw)]
                marks = {t: [(s, e, f"[{k.upper()}]") for s, e, k in spans] for t, spans in zip(strings, select_spans(strings)) if spans}
                dirs = select_dirs(cwd)
                for s, e, k in reversed(dirs):
                    cwd = f"{cwd[:s]}[{k.upper()}]{cwd[e:]}"
                rows.append((rec, sum(map(len, marks.values())) + len(dirs), cwd, replace_spans(raw, marks) if marks else raw))
            yield pd.DataFrame(rows, columns=["rec_id", "n_spans", "cwd", "msg_content"])

    return records.select("rec_id", "cwd", "msg_content").mapInPandas(run, "rec_id long, n_spans int, cwd string, msg_content string")
