"""Problem 5: credentials in tool results, by Viterbi segmentation of literals.

Literals near an assignment, header, flag, log field or URL are segmented into dictionary words (of a public tokenizer's vocabulary) and
unexplained characters, at least cost. A literal is a secret if its unexplained residual is long enough for its context; formats
of digests and of values that are no credentials (placeholders, references, masked values, paths) are excluded first.
Whether a name is that of a credential is decided on its words too, found by the same segmentation, so that ``token_count``,
``secretName`` or ``passwordPolicy`` are none. Private keys are found by their armour and body.

Scale: one narrow pass, no shuffle; each text is read whole, line by line. Defined results: NULL contents give nothing,
unreadable JSON has no places (``redact`` treats it as one text), a line is reported once, repeated rows each count. Redaction is by position: the same
characters elsewhere, inside a longer word or outside of tool results, stay.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from .blocks import VOCABULARY, local_file, readable, replace_spans, ship_file, texts, unescaped

#: Words of names of credentials (fixed values): alone, or only together with one of QUALIFIER before a final ``key``.
STRONG = frozenset("password passwd passphrase pwd pw pass secret token apikey bearer auth authorization credential credentials passcode authtoken pat jwt dsn pem".split())
QUALIFIER = frozenset("api access secret signing sign license licence private encryption encrypt auth service master deploy account client shared ssh".split())
#: Last words that make a name something else (fixed values).
OTHER = frozenset(
    "count file path name policy length len url uri type budget limit ttl expiry expires hash digest sha fingerprint field fields prompt label hint min max regex pattern header "
    "ref mode method provider public cache primary foreign sort index usage version scope env var format size id2".split()
)
#: Values that stand for a credential without being one (fixed values).
STAND_INS = re.compile(
    r"(?i)^(?:replace|change|your|example|sample|dummy|fake|test|placeholder|redacted|removed|masked|hidden|none|null|nil|undefined|true|false|todo|fixme|tbd|secret|password|token|insert|enter|put|set|not)\b|(?:_|-)(?:here|me)$|^x+$"
)
MASKED = re.compile(r"\*{3,}|•{2,}|\.{3}|…|(?:x{4,}|X{4,})$|\[\w*(?:redact|mask|hidden|filter|remov)|<[^>]*>|#{4,}", re.IGNORECASE)
REFERENCE = re.compile(
    r"^(?:\$[\w({]|\$\{|\{\{|%\(|%\w+%$|os\.|process\.|env[.\[(]|getenv|ENV\[|vault|secrets?[.:/]|ssm:|arn:|op://|kms|file:|\./|@/|!(?:Ref|Sub|GetAtt|secret|vault|env)\b|config[.\[]|settings[.\[]|self\.|this\.|args\.|req(?:uest)?\.|https?://[^:@\s]*$)"
)
HASHED = re.compile(r"^(?:\$2[abxy]?\$|\$argon2|\$pbkdf2|\$[156]\$|pbkdf2|scrypt:|sha(?:1|224|256|384|512)[:\-]|md5[:\-]|ssh-(?:rsa|ed25519)|ecdsa-sha2|\{SSHA)")
PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PRIVATE_ALL = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----.*?(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|\Z)", re.DOTALL)

#: A line is looked at only if it has one of these; each form that the patterns below accept, in each of their contexts, has one.
TRIGGER = re.compile(
    r"(?i)pass|pwd|(?-i:[Pp]w(?![a-z])|PW)|pw(?:value|data|b64|base64|id)|secret|token|key|auth|bearer|cred|(?:basic|digest)\s|pem|dsn|jwt|(?-i:(?<![A-Za-z])pat(?![a-z])|Pat(?![a-z])|PAT)|log_?in|sign_?in|://[^\s:/@\"'<>]*:[^\s@]+@|-u[\s=]|--user[\s=]|mysql|psql|redis-cli|mongo|value\W|-----BEGIN"
)
_NAME = r"[A-Za-z_][\w.\-]*"
ASSIGN = re.compile(
    rf"""(?P<name>(?:--)?{_NAME})(?P<q>["']?\]?)\s*(?P<op>:=|=>|==|!=|=|:|\s)\s*(?:\(|\[)?\s*(?:[rbuf]{{0,2}}(?P<quote>["'`])(?P<quoted>(?:\\.|(?!(?P=quote)).)*)|(?P<bare>[^\s,;"'`<>|\]\)}}]+))"""
)
HEADER = re.compile(r"(?i)\b(?:bearer|basic|token|apikey|digest)\s+(?P<v>[A-Za-z0-9+/_.=\-~]{8,})")
URL = re.compile(r"[A-Za-z][\w+.\-]*://[^\s:/@\"'<>]*:(?P<v>[^\s/@\"'<>]+|[^\s@\"'<>]+)@[\w.\-\[]")
FLAG = re.compile(r"(?:^|\s)(?:-u|--user)[ =][\"']?[^\s:\"']+:[\"']?(?P<v>[^\s\"']+)|(?:mysql|mysqldump|psql|redis-cli|sshpass|docker login|mongo\w*)\b[^|;]*?\s-(?:p|a)\s?(?P<q2>[\"']?)(?P<w>[^\s\"'-][^\s\"']*)(?P=q2)")
#: A call that signs in: the user, then the password as a literal.
CALL = re.compile(r"(?i)\b(?:sign_?in|log_?in|authenticate|auth)\w*\(\s*[\"'][^\"']*[\"']\s*,\s*(?P<q>[\"'])(?P<v>[^\"']+)(?P=q)")
#: The line number that a file viewer puts before a line.
NUMBER = re.compile(r"^\s*\d+\t")
#: A line that goes on with the literal of the line before it; ``more`` if the literal does not end there either.
JOINED = re.compile(r"^\s*[+.]?\s*(?P<q>[\"'`])(?P<v>[A-Za-z0-9+/_.=\-~!@#$%^&*]{6,})(?P=q)\s*(?P<more>[+\\.]?)\s*[;,)]*\s*$")
SHORT = {"password": 4, "other": 9}
PASSWORDS = frozenset("password passwd passphrase pwd pw pass passcode".split())


@lru_cache(maxsize=2)
def dictionary(path: str = VOCABULARY) -> dict[str, float]:
    """Lower-case words of four letters or more of a ranked vocabulary, with costs that rise with the rank."""
    out: dict[str, float] = {}
    with open(local_file(path), "rb") as f:
        for n, line in enumerate(f):
            w = base64.b64decode(line.split()[0]).decode("utf-8", "replace").strip().lower()
            if len(w) >= 4 and w.isascii() and w.isalpha():
                out.setdefault(w, 0.8 + n / 50_000)
    return out | {w: 0.8 for w in STRONG | QUALIFIER | OTHER | {"key", "id", "app", "the", "and", "for", "env", "dev", "log"}}


def viterbi(text: str, words: dict[str, float]) -> tuple[list[str], int]:
    """Segmentation of least cost into dictionary words (one case pattern each) and single characters: the words, and the number of unexplained letters and digits."""
    n = len(text)
    low = text.lower()
    cost, back = [0.0] + [1e9] * n, [0] * (n + 1)
    for j in range(1, n + 1):
        c = low[j - 1]
        cost[j], back[j] = cost[j - 1] + (1.0 if c.isalnum() else 0.1), j - 1
        if c.isalpha():
            for i in range(max(0, j - 14), j - 1):
                w = words.get(low[i:j])
                if w is not None and cost[i] + w < cost[j]:
                    part = text[i:j]
                    if part.islower() or part.isupper() or part[1:].islower():
                        cost[j], back[j] = cost[i] + w, i
    out, rest, j = [], 0, n
    while j:
        i = back[j]
        if j - i > 1:
            out.append(low[i:j])
        elif low[i].isalnum():
            rest += 1
        j = i
    return out[::-1], rest


class Finder:
    """Secrets of a text; holds the dictionary and what it has segmented in this task."""

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        self.words = dictionary(vocabulary)
        self.names: dict[str, str | None] = {}

    def context(self, name: str) -> str | None:
        """'password', 'other' or None for a name that is not that of a credential."""
        if name not in self.names:
            if len(self.names) > 200_000:
                self.names.clear()
            self.names[name] = self._context(name)
        return self.names[name]

    def _context(self, name: str) -> str | None:
        parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]
        for p in parts[-1:]:
            if p not in STRONG and p not in OTHER and p != "key" and len(p) >= 4:  # run together, as in mypassphrase
                parts[-1:] = viterbi(p, self.words)[0] or [p]
        while len(parts) > 1 and (parts[-1].isdigit() or parts[-1] in ("value", "data", "b64", "base64", "id") and any(x in STRONG or x == "key" for x in parts[:-1])):
            parts.pop()
        if not parts:
            return None
        last = parts[-1]
        if last in OTHER:
            return None
        if last in STRONG:
            return "password" if last in PASSWORDS else "other"
        if last in ("key", "keys") and any(p in QUALIFIER for p in parts[:-1]) and "public" not in parts:
            return "other"
        return None

    def secret(self, value: str, context: str, quoted: bool) -> bool:
        """Is this literal, in this context, a live credential?"""
        v = value.strip()
        if len(v) < (6 if context == "password" else 10) or MASKED.search(v) or STAND_INS.search(v) or HASHED.match(v) or REFERENCE.match(v):
            return False
        if not quoted and (re.search(r"^[\w.]+\(|\)$|^\w+\[", v) or re.fullmatch(r"[A-Za-z_]+(?:\.[A-Za-z_]+)+", v)):
            return False
        if re.match(r"~?/[\w.\-]+/[\w.\-/]*$", v) and viterbi(v, self.words)[1] < 0.5 * len(v):
            return False
        if " " in v or len(set(v)) < 4:
            return False
        rest = viterbi(v, self.words)[1]
        if rest < SHORT[context]:
            return False
        return context == "password" or rest >= 0.35 * len(v)

    def line(self, text: str, before: str) -> list[tuple[int, int]]:
        """Places (start, end) of the secrets that start on a line, in the order they are found; ``before`` is the line above it."""
        out = [m.span("v") for m in URL.finditer(text) if self.url(m["v"])]
        for m in FLAG.finditer(text):
            g = "v" if m["v"] else "w"
            if m[g] and self.secret(m[g], "password", True):
                out.append(m.span(g))
        for m in HEADER.finditer(text):
            if self.secret(m["v"], "other", True) and re.search(r"(?i)auth|bearer|basic|header|-H|curl|key", text[: m.end()]):
                out.append(m.span("v"))
        out += [m.span("v") for m in CALL.finditer(text) if self.secret(m["v"], "password", True)]
        at = 0
        while m := ASSIGN.search(text, at):
            name, op = m["name"].lstrip("-"), m["op"]
            at = m.end("name") if self.context(name) is None else m.end()
            if at == m.start():
                at += 1
            g, quoted = ("quoted", True) if m["quote"] else ("bare", False)
            value = m[g]
            if op in ("==", "!=") or not value:
                continue
            context = self.context(name)
            if context is None and name.lower() == "value" and (k := re.search(r"name:?\s*[\"']?([\w\-]+)", before)):
                context = self.context(k[1])
            if context is None:
                continue
            if op.isspace() and not quoted and not m["name"].startswith("--") and (viterbi(value, self.words)[1] < 0.5 * len(value) or not re.search(r"[\d+/_]", value)):
                at = m.end("name")
                continue
            value = re.sub(r"(?i)^(?:bearer|basic|token)\s+", "", value)
            if "://" in value or value.startswith("-----BEGIN"):
                continue
            if self.secret(value, context, quoted):
                out.append((m.end(g) - len(value), m.end(g)))
        return list(dict.fromkeys(out))

    def url(self, v: str) -> bool:
        return len(v) >= 4 and not (MASKED.search(v) or STAND_INS.search(v) or REFERENCE.match(v) or re.match(r"^[{%$<]", v)) and viterbi(v, self.words)[1] >= 2

    def find(self, text: str) -> list[tuple[int, str]]:
        """(line, secret) of a text, lines from 1."""
        return [(no, text[a:b]) for no, a, b in self.spans(text)]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(line, start, end) of the secrets of a text, lines from 1; a private key is its whole armoured block.

        A literal joined from several lines gives each of its parts, under the line on which it starts.
        """
        out: list[tuple[int, int, int]] = []
        if not TRIGGER.search(text):
            return out
        blocks = []
        for m in PRIVATE_ALL.finditer(text):
            body = re.sub(r"\\n|-----[^-]*-----|[^A-Za-z0-9+/=]", "", m[0])
            if len(body) >= 40 and not MASKED.search(m[0]):
                out.append((text.count("\n", 0, m.start()) + 1, m.start(), m.end()))
                blocks.append((m.start(), m.end()))
        at, before, open_no = 0, "", 0
        for no, ln in enumerate(text.split("\n"), 1):
            bare = NUMBER.sub("", ln)
            skip = at + len(ln) - len(bare)
            if open_no and (part := JOINED.match(bare)):
                out.append((open_no, skip + part.start("v"), skip + part.end("v")))
                open_no = open_no if part["more"] else 0
            elif TRIGGER.search(ln) and not any(s < at + len(ln) and at > s and at < e for s, e in blocks):
                places = self.line(bare, before)
                out += [(no, skip + a, skip + b) for a, b in places]
                open_no = no if places and any(bare.rstrip() == bare[: places[-1][1]] + q + j for q in "'\"`" for j in (" +", " \\", "+", "\\", " .", "")) else 0
            else:
                open_no = 0
            at += len(ln) + 1
            before = ln
        return out

    def marks(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, placeholder) of a text, without overlap: places that overlap are one."""
        out: list[tuple[int, int, str]] = []
        for a, b in sorted((a, b) for _, a, b in self.spans(text)):
            if out and a < out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]), out[-1][2])
            else:
                out.append((a, b, "[REDACTED:PRIVATE_KEY]" if text.startswith("-----BEGIN", a) else "[REDACTED:CREDENTIAL]"))
        return out


def found(records: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """p5_found: (rec_id, place, line_no) of lines on which a live credential starts."""
    vocabulary = ship_file(records.sparkSession, vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(vocabulary)
        for pdf in batches:
            rows: list[tuple] = []
            for rec, role, raw in zip(pdf.rec_id, pdf.msg_role, pdf.msg_content):
                for place, text in results(role, raw):
                    rows += dict.fromkeys((rec, place, no) for no, _, _ in finder.spans(text))
            yield pd.DataFrame(rows, columns=["rec_id", "place", "line_no"])

    tools = records.where("msg_content LIKE '%tool_result%' OR lower(trim(msg_role)) = 'tool'")
    return tools.select("rec_id", "msg_role", "msg_content").mapInPandas(run, "rec_id long, place string, line_no long")


def results(role: str | None, raw: str | None) -> list[tuple[str, str]]:
    """(place, text) of the tool results of a content; the string content of a record with the role tool is one."""
    tool = (role or "").strip().lower() == "tool"
    return [(place, text) for place, text, result in texts(raw) if result or tool and place == "content"] if tool or "tool_result" in (raw or "") else []


def redact(records: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(rec_id, n_secrets, msg_content) of all rows, the secrets of tool results replaced at their places, every other character as it was."""
    vocabulary = ship_file(records.sparkSession, vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(vocabulary)
        for pdf in batches:
            rows = []
            for rec, role, raw in zip(pdf.rec_id, pdf.msg_role, pdf.msg_content):
                if raw and ("tool_result" in raw or (role or "").strip().lower() == "tool") and not readable(raw):
                    whole, at = unescaped(raw)
                    marks, out = finder.marks(whole), raw
                    for a, b, label in reversed(marks):
                        out = f"{out[: at[a]]}{label}{out[at[b] :]}"
                    rows.append((rec, len(marks), out))
                    continue
                found_in = {text: marks for _, text in results(role, raw) if (marks := finder.marks(text))}
                rows.append((rec, sum(map(len, found_in.values())), replace_spans(raw, found_in) if found_in else raw))
            yield pd.DataFrame(rows, columns=["rec_id", "n_secrets", "msg_content"])

    return records.select("rec_id", "msg_role", "msg_content").mapInPandas(run, "rec_id long, n_secrets int, msg_content string")
