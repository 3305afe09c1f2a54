"""Labelled texts for problem 1, made from templates: planted spans of known kind beside look-alikes."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

from .personal import GIVEN

#: Stems and endings of made surnames, streets and towns (own choice; no given table was read for them).
_PRE = "Bergen Hollo Karst Mont Silver North Brand Alder Winter Sand Fal Ros Dun Grey Lund Thor Wald Kessel Marsh Vand".split()
_END = "ström son sen ski ska mann berg stein ley ton ford ez ic ov ova enko ini etti ano escu oglu poulos dóttir quist moto ian wala".split()
_STREETS = "Maple Cedar Victoria Garden King Queen Castle Forest Lake Park Spring Hill Rose Linden Market Abbey Orchard Meadow Cherry Walnut".split()
_TOWN_END = "bury haven stadt feld ville mouth burgh dale borough heim".split()
_TOWN_WORDS = "Port Saint New East West North South Bad Grand San Santa Upper Lower".split()
_TOWN_LAST = "Springs Falls Park Beach Bay Heath Green Cross Hills".split()
_DOMAINS = "example.org mail.example example.com firm.test labs.example co.example corp.invalid".split()
_WORDS = "buffer cluster handler schema watcher payload session token cache hook index queue".split()
_PLACES = ["San Francisco", "New York", "Los Angeles", "Hong Kong", "Buenos Aires", "Cape Town", "Visual Studio", "Stack Overflow", "Open Source", "Pull Request", "Google Cloud", "Black Friday", "Apache Spark", "Red Hat", "Amazon Web"]
_VERBS = "Ask Tell Ping Call Meet Thank Add Check Fix Update Review Move Contact Email Notify".split()

#: Texts with slots {E} mailbox, {P} telephone, {I} id with its word, {J} passport, {S} social security number, {A} address, {N} name, {w} a word, {T} a made proper noun
#: of two words, {h} hexadecimal, {dN} N digits, {v} a verb with a capital; all else is plain text (own wording).
POSITIVE = (
    "Please write to {E} if it breaks again.", "{N} ({E}) opened this yesterday.", "Copied: {E}; {E}; {N}.", "Signed-off-by: {N} <{E}>", "From: {E}", "mail = {E}", "{E}", "Reply-To: {N} <{E}>",
    'level=info event=lookup name="{N}" email={E}', "Escribe a {N}, {E}, por favor.", "insert into users values ({d2}, '{N}', '{E}', '{P}');", '{{"customer": "{N}", "phone": "{P}"}}', "user: {N}\nphone: {P}",
    "// asked for by {N}, phone {P}", "bad number '{P}' in record {d2}", "If it fails at night dial {P}, somebody answers.", "You can reach the office at {P} until six.", "call {P}", "Tel. {P}", "my cell is {P}, thanks",
    "{v} {N} about the {w}, best on {P}.", "{N} m'a laissé un message, rappeler au {P}.", "{N};{P};{A}", "{E},{P}", "{N},{E},{P}", "{N}\t{P}", "{N} | {P} | {E}", "phone,email\n{P},{E}\n{P},{E}",
    "name\tcell\tpassport\n{N}\t{P}\t{J}\n{N}\t{P}\t{J}\n{N}\t{P}\t{J}", "    12\towner\tphone\tpassport\n    13\t{N}\t{P}\t{J}\n    14\t{N}\t{P}\t{J}", "no,customer,mail,ssn\n{d4},{N},{E},{S}\n{d3},{N},{E},{S}", "name;tel;address\n{N};{P};{A}\n{N};{P};{A}",
    "The form of {N} ({I}) is incomplete.", "there is {I} in the third column", "validation passed for {I}", "Parser stops at {I}, probably the blank.", "patient {N}; {I}; {A}", "customer {N}, {I}, {A}", "{I}", "Her {I} was entered twice.",
    "Please deliver it to {A}.", 'delivery: "{A}"', "We moved, the office is at {A} now; {P} still works.", "{N} wrote that the billing address is {A}.", "{N} wohnt in {A}.", "| {N} | {A} |", "lives at {A}", "address: {A}",
    "reviewed by {N}", "# owner: {N}", "cc {N}", "Could you add {N} to the thread?", "{N} approved it on Monday.", "{N} and {N} disagree on the {w}.", "Thanks, {N}", "Mr {N} called again.", "Frau {N} hat angerufen.", "le dossier de Madame {N}", "Dr. {N} signed the report.",
    "I talked to {N} yesterday; {v} {N} instead.", "The account is in the name of {N}.", "author = \"{N}\"", "assignee: {N}", "{v} {N} before the release.", "said {N}.", "{N}\n{E}\n{P}", "@param user {N}", "Contact {N} in {T}.", "{N}, {A}",
    "Use {P} tonight.", "Try {P} or {P}.", "{P} is answered all day", "the new one is {P} since May", "{P} does not work any more, take {P}", "both {P} and {P}", "{v} {N} first.", "{N} The {w} is back.", "it was {N} who found it", "{v} {N}, not {N}.", "{v} {N} before you do that.", "{v} {N} under {P}.", "{v} {N} or {N} about it.",
)
NEGATIVE = (
    "Build {d3}-{d2}-{d4} failed.", "Ticket {d3}-{d3}-{d4} is a duplicate.", "Job {d4}{d4}{d3} took {d4} ms.", "order {d3}-{d2}-{d4} shipped", "part no {d3} {d3} {d4} ok", "release 20{d2}.{d2}.{d2}-{d4}", "ssh deploy@10.0.{d2}.{d2}", "git clone git@git.host.example:team/{w}.git",
    "postgres://app@db.host.test:5432/{w}", "npm install @scope/{w}@2.14.{d3}", "listening on 127.0.0.1:{d4}", "The {T} is down again.", "{T} and {T} are both green.", "Restart the {T} after {T}.", "{T}: {d3} errors", "We met in {T}.", "{v} the {w} in {T}.", "# {T}", "The {T} depends on {T}.",
    "20{d2}-03-{d2} 08:12:{d2} WARN slow {w} ({d3} ms)", "commit {h}{h}", "sha256:{h}{h}{h}", "    at load{w} (src/{w}.ts:{d3}:{d2})", "redis://svc:{w}-x@mq-{d2}.host.test:{d4}/{w}", "line {d3} of {w}.py, attempt {d3}", "GET /{w}/{w}?n={d3} 200 {d2}ms", '  "{w}": [{d3}, {d3}],',
    "const {w} = await mark(grace, {d3})", "import anna_{w}", "the {w} of rosa is late", "ask lin about {w} tests", "sent by the {w} {w}", "from {w} import {w}", "user {w} {w}", "name: {w} {w}", "key id AKIA{u}", "{w}.mark({w}, {d3})", "max {w} leo {w}", "id={d3}{d4}{d3}", "{d3} {d3} {d4} rows",
    "SELECT {w} FROM {w} WHERE ID = {d4}", "ERROR MAIN LOOP STOPPED", "INSERT INTO {w} VALUES ({d2})", "Step {d2}: {v} {w} {w}", "Table {d2}. {T}", "Since Monday Morning the {w} hangs.", "{T}, {T} and others", "Chapter {d2}, Section {d2}", "timeout={d3}, {w}={d4}",
    "{d3}-{d3}-{d4} is the trace of the {T}.", "request {h}-{d4}-{d4}", "port {d4}/{d4}", "range {d4}-{d4} {d4}", "0.{d3} {d3} {d3}", "{v} {T} first, then the {w}.", "{w} in {T}, not in {T}",
    "{d4} belongs to {T}.", "It belongs to the {T}.", "owned by {T}", "name: {T}", "reported by {T}", "user {T} has no quota", "from {T} to {T}", "Contact {T} for {w}.", "owner={T}", "requested by the {T}", "{T} said no", "cc {T}", "by {T}",
)


def _made(r: random.Random, n: int) -> str:
    """A word of ``n`` open syllables."""
    return "".join(r.choice("b br ch d f g h j k l m n p r s sh st t th v w z".split()) + r.choice("a e i o u ai ou ö é".split()) for _ in range(n)) + r.choice(("", "", "n", "r", "s", "l", "k", "t"))


def _surname(r: random.Random) -> str:
    if r.random() < 0.5:  # any form: endings are a sign, not a condition
        return _made(r, r.choice((2, 3))).capitalize()
    return r.choice(_PRE)[: r.choice((3, 4, 5, 6))] + r.choice(_END)


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _first(r: random.Random) -> str:
    """A listed, a common or a made given name."""
    form = r.random()
    return (r.choice(GIVEN) if form < 0.5 else r.choice(_FIRSTS) if form < 0.8 else _made(r, 2)).capitalize()


def _name(r: random.Random) -> str:
    first = _first(r)
    last = r.choice(_SURNAMES).capitalize() if r.random() < 0.35 else _surname(r)
    form = r.random()
    if form < 0.5:
        s = f"{first} {last}"
    elif form < 0.6:
        s = f"{first} {r.choice('ABCDKMRT')}. {last}"
    elif form < 0.75:
        s = f"{last}, {first}"
    elif form < 0.88:
        s = f"{first[0]}. {last}"
    elif form < 0.9:
        s = f"{last}, {first[0]}."
    elif form < 0.92:
        s = f"{first} {r.choice(('van', 'de', 'von', 'di'))} {last}"
    else:
        s = f"{first} {last}".lower()
    return s.upper() if r.random() < 0.05 else s


def _thing(r: random.Random, plain: list[str], doers: list[str]) -> str:
    """Two capitalised words that are no person: a system, a heading, a place."""
    word = lambda: r.choice(plain).capitalize()
    form = r.random()
    if form < 0.4:  # a system named after somebody or something, by what it does
        tail = word() if r.random() < 0.5 else r.choice(doers).capitalize()
        return f"{r.choice((_first(r), _surname(r), r.choice(_SURNAMES).capitalize(), word()))} {tail}"
    if form < 0.65:
        return f"{word()} {word()}"
    if form < 0.75:
        return f"The {r.choice((word(), _surname(r), _first(r)))}"
    if form < 0.85:
        return r.choice(_PLACES)
    return _town(r)


def _town(r: random.Random) -> str:
    base = _made(r, 1).capitalize() + r.choice(_TOWN_END)
    return r.choice((base, base, f"{r.choice(_TOWN_WORDS)} {base}", f"{base} {r.choice(_TOWN_LAST)}", f"{r.choice(_TOWN_WORDS)}-{base}"))


def _mail(r: random.Random) -> str:
    first, last = re.sub(r"[^a-z]", "o", _first(r).lower()), re.sub(r"[^a-z]", "o", _surname(r).lower())
    local = r.choice((f"{first}.{last}", f"{first}{_digits(r, 2)}", f"{last}_{first}", f"{first[0]}{last}", f"{first}-{last}", f"{first}.{last}+{r.choice(_WORDS)}"))
    domain = r.choice(("acme-", "north", "blue", "")) + r.choice(_DOMAINS)
    form = r.random()
    if form < 0.75:
        s = f"{local}@{domain}"
    elif form < 0.85:
        s = f"{local} (at) {domain}"
    elif form < 0.95:
        s = f"{local} [at] {domain.replace('.', ' [dot] ')}"
    else:
        s = f"{local} at {domain.replace('.', ' dot ')}"
    return s.upper() if r.random() < 0.07 else s


def _phone(r: random.Random) -> str:
    d = lambda n: _digits(r, n)
    return r.choice((
        f"+1-{d(3)}-555-{d(4)}", f"({d(3)}) 555-{d(4)}", f"{d(3)}-555-{d(4)}", f"{d(3)}.555.{d(4)}", f"+1 {d(3)} 555 {d(4)}", f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}",
        f"020 7946 {d(4)}", f"+44 7700 {d(6)}", f"07700 {d(3)} {d(3)}", f"030/{d(8)}", f"+49 30 {d(5)} {d(3)}", f"0049 (0)30 {d(5)}-{d(r.choice((2, 3)))}", f"+61 {d(3)} {d(3)} {d(3)}",
    ))


def _ssn(r: random.Random) -> str:
    return f"{_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 4)}"


def _passport(r: random.Random) -> str:
    return r.choice("ABCKXZ") + _digits(r, 8)


def _id(r: random.Random) -> tuple[str, str]:
    d = lambda n: _digits(r, n)
    social = r.choice((f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", d(9)))
    dni = f"{d(8)}{r.choice(('-', ''))}{r.choice('KLMNOPTUW')}"
    tax = f"{d(2)} {d(3)} {d(3)} {d(3)}"
    word, value = r.choice((
        ("SSN", social), ("SSN:", social), ("ssn=", social), ("social security number", social), ("Soc. Sec. no.", social), ("DNI", dni), ("NIF:", dni), ("tax id", tax), ("Steuer-ID", tax),
        ("passport", _passport(r)), ("passport no.", f"XF{d(7)}"), ("Reisepass", f"Z{d(1)}G{d(6)}"), ("driver's licence", f"F{d(3)}-{d(4)}-{d(4)}"), ("licence no", f"H{d(3)}-{d(4)}-{d(4)}"),
    ))
    return word + ("" if word.endswith("=") else " "), value


def _address(r: random.Random) -> str:
    n, s, t, z = r.randint(2, 480), r.choice((r.choice(_STREETS), _surname(r), f"{r.choice(('Old', 'New', 'High'))} {r.choice(_STREETS)}")), _town(r), _digits(r, 5)
    kind = r.choice(("Street", "Road", "Lane", "Drive", "Avenue", "Ct", "Rd", "Blvd."))
    return r.choice((
        f"{n} {s} {kind}, {t} {z}", f"{n} {s} {kind}, Apt {n % 90}B, {t}", f"{n} {s} Rd\n{t} {z}", f"{n} {s} Rd {t} {z}", f"{n} bis, rue des {s}, {z} {t}", f"{s}straße {n}, {z} {t}", f"{s}weg {n}, {z} {t}",
        f"{s}gasse {n}, {z} {t}", f"Calle {s} {n}, 3º B, {z} {t}",
    ))


def _fill(r: random.Random, template: str, plain: list[str], doers: list[str]) -> tuple[str, list[tuple[int, int, str]]]:
    text, spans, at = "", [], 0
    personal = {"E": _mail, "P": _phone, "A": _address, "N": _name, "S": _ssn, "J": _passport}
    kinds = {"E": "email", "P": "phone", "A": "address", "N": "person_name"}
    for m in re.finditer(r"\{([EPIJANSTvwhu]|d\d)\}", template):
        text += template[at : m.start()].replace("{{", "{").replace("}}", "}")
        k, at, lead = m[1], m.end(), ""
        if k == "I":
            lead, v = _id(r)
        elif k in personal:
            v = personal[k](r)
        elif k == "T":
            v = _thing(r, plain, doers)
        else:
            v = {"w": lambda: r.choice(_WORDS if r.random() < 0.3 else plain), "v": lambda: r.choice(_VERBS), "h": lambda: "%08x" % r.getrandbits(32), "u": lambda: "".join(r.choice("ABCDEFGHJK234567") for _ in range(16))}.get(k, lambda: _digits(r, int(k[1])))()  # noqa: B023
        text += lead
        if k == "I" or k in personal:
            spans.append((len(text), len(text) + len(v), kinds.get(k, "id_number")))
        text += v
    return text + template[at:].replace("{{", "{").replace("}}", "}"), spans


def make(n: int, seed: int, plain: list[str]) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """``n`` texts of one to three sentences with the places of their planted spans; the same for the same seed. ``plain``: words that are commoner in lower case."""
    r = random.Random(seed)
    doers = [w for w in plain if re.search(r"(?:er|or|ing|ment|ion|ce)$", w)]
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            t, s = _fill(r, r.choice(POSITIVE if r.random() < 0.55 else NEGATIVE), plain, doers)
            spans += [(a + len(text), b + len(text), k) for a, b, k in s]
            text += t + r.choice((" ", "\n"))
        yield text, spans


#: Names of the training paths beside the listed and the made ones (fixed values).
_SURNAMES = "smith jones brown taylor wilson davies evans walker wright green hall wood clark moore allen young king scott hill baker adams nelson carter silva santos costa garcia lopez perez rossi russo ferrari martin bernard dubois moreau schmidt weber fischer wagner becker jansen bakker novak horvat kowalski popov petrov nguyen tran kim park lee choi wang zhang liu tanaka suzuki sato khan patel singh kumar sharma mensah okafor diallo yilmaz".split()
_FIRSTS = "george edward margaret charles henry elizabeth susan linda patricia steven kevin brian jason ryan gary stephen larry scott frank raymond gregory patrick jack dennis jerry sergei vladimir ivana pierre claude louis francois giovanni marco luigi juan luis miguel fernanda joao hiroko takeshi ming xiao sanjay rahul fatou kofi".split()
_TECH = "app api agent server service worker queue cache build data model test tools core web site backend frontend client gateway router scheduler planner monitor pipeline compiler parser engine library package project source config deploy docker cloud storage index search report script notebook release runner manager science analysis learning platform network security mobile desktop support program files photo music archive backup report public shared common main master".split()
_TOPS = ("/home", "/Users", "C:\\Users", "/srv", "/opt", "/workspace", "/var/lib", "/data", "/mnt/disk", "D:\\work", "/root", "/export/home", "/home/build/src", "/srv/people")


def _cased(r: random.Random, words: list[str], joint: str) -> str:
    if joint == "camel":
        return "".join(w.capitalize() for w in words)
    case = str.capitalize if r.random() < 0.3 and joint != "" else str.lower
    return joint.join(map(case, words))


def make_paths(n: int, seed: int, plain: list[str]) -> Iterator[tuple[str, tuple[int, int] | None]]:
    """``n`` paths with the place of the directory that spells a name, if any does; the same for the same seed. ``plain``: words that are commoner in lower case."""
    r = random.Random(f"paths {seed}")
    some = lambda w: w.translate(str.maketrans("öéü", "oeu")) if r.random() < 0.8 else w
    for _ in range(n):
        top, named = r.choice(_TOPS), r.random() < 0.35
        home = re.split(r"[\\/]", top)[-1].lower() in ("home", "users", "people")
        joint = r.choice((".", "_", "-", " ", "camel", ""))
        if named:  # an unlisted name is known as one by its place or its words
            first = r.choice(GIVEN) if r.random() < 0.5 else r.choice(_FIRSTS) if not home or r.random() < 0.5 else _made(r, 2)
            last = r.choice(_SURNAMES) if r.random() < 0.4 else _surname(r).lower() if home or first in GIVEN else r.choice(_SURNAMES)
            words = [first, last] if r.random() < 0.75 else [last, first]
            if r.random() < 0.1 and joint:
                words.insert(1, r.choice("abcdkmrt"))
        else:
            form = r.random()
            word = lambda: r.choice(_TECH if r.random() < 0.4 else plain)
            words = [word(), word()] if form < 0.4 else [_made(r, 2), word()] if form < 0.7 else [r.choice(GIVEN + _FIRSTS), word()] if form < 0.8 else [_made(r, 2), _made(r, 2)]
            if form >= 0.8 and home:
                words[1] = word()
            if r.random() < 0.1:
                words.append(word())
            if joint == "" and r.random() < 0.3:
                words = [r.choice(plain)]
        part = _cased(r, [some(w) for w in words], joint)
        sep = "\\" if "\\" in top else "/"
        tail = "".join(sep + _cased(r, [r.choice((_made(r, 2), r.choice(_TECH))), r.choice(_TECH)], r.choice("-_.")) for _ in range(r.choice((0, 1, 1, 2))))
        yield top + sep + part + tail, (len(top) + 1, len(top) + 1 + len(part)) if named else None
