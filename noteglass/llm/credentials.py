"""Credentials embedded in code, configuration, logs and prose: found and redacted.

The lines of a text are cut into lexical tokens. A linear-chain conditional random field
labels them by shape (character classes, length, entropy, known forms) and context (the
name left of the value, words around it, quotes, position in a URL, the line before);
Viterbi spans of the labels say which literal characters are secret, and only those are
replaced. Names, separators, quotes and everything else stay, so code still parses.

The field is trained here, in a few seconds, on lines that ``examples`` makes up from a
grammar of its own: syntax of common tools and languages, and sentences put together from
general words; secrets where secrets stand, and what looks like one and isn't. It is the
same for every input.

All lines of all texts are labelled. Most are ruled out together first, where ``sieve``
proves that no labels with a secret can be the best. ``find`` can also be given words of a
gate, which leave lines out by guess: those are labelled that have a long token of letters
and digits, a URL with a password, a private key's header, or a word of the gate, and those
after a line that announces one. The queries don't use that.

Defined cases: null and empty texts have no spans; declared needle values, redaction
marks, placeholders, public keys, certificates and digests are none; a private key block
is one span that starts at its BEGIN line and ends at its END, or where it was cut; a text that occurs twice is labelled alike; a
record that was delivered twice counts once.
"""

from __future__ import annotations

import base64
import math
import random
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from noteglass.llm import crf
from noteglass.llm.tokens import slices

MARK = "[REDACTED]"
TRAINING_LINES = 5000  # bound of the training sample
MISSED = 0.001  # share of the made-up lines with a secret that the gate may leave out
LEANING = 1.0  # log odds added to the start of a secret: a missed one costs more than a false one

SECRET = r"pass(?!ed|es|ing|age|ive|\b)|pass(?=$|[_.\W])|pwd|passw|secret|token|api[_.\-]?key|apikey|access[_.\-]?key|account[_.\-]?key|private[_.\-]?key|signing|encryption[_.\-]?key|master[_.\-]?key|signature[_.\-]?key|credential|auth(?!or)|bearer|salt|hmac|passphrase|(?:^|[_.\W])pin(?=$|[_.\W])|kennwort|passwort|mot[_ ]de[_ ]passe|contrase|clave|cl[ée][_ ]d|session[_.\-]?id|(?:^|\W)sid$|(?:^|\W)sig$|jwt|cookie"
NAME = re.compile(SECRET, re.I)
DIGEST = re.compile(r"etag|integrity|sha\d|commit|digest|checksum|lease|request|hash(?!mac)|revision|md5|fingerprint|\bid$|_id$|uuid|version|ttl", re.I)
PUBLIC = re.compile(r"^(?:next_public_|public_|vite_|react_app_|expo_public_)|public[_ ]?key|max_tokens", re.I)
CUES = "password passwort passphrase kennwort contraseña clave clé login key basic bearer curl docker sshpass mysql psql export env requirepass machine dsn cookie clone admin set token secret authorization header headers value log in sign connect pin anmeld connexion acceso".split()
MIXED = re.compile(r"[A-Za-z]\d|\d[A-Za-z]")
#: A token of 16 characters or more with letters and digits side by side.
LONG = re.compile(r"(?<![A-Za-z0-9+/=_.\-])(?=[A-Za-z+/=_.\-]*\d)(?=[\d+/=_.\-]*[A-Za-z])[A-Za-z0-9+/=_.\-]{16,}")
#: One of letters only, in mixed case as no name has it.
TANGLE = re.compile(r"(?<![A-Za-z0-9+/=_.\-])(?=[A-Za-z+/=_.\-]*[a-z][A-Z]{2})[A-Za-z+/=_.\-]{16,}")
SERVICE = re.compile(r":\d{2,5}:[^\s:]+:[^\s:]+:[^\s:]+")
NOT_LETTERS = {k: " " for k in range(128) if not chr(k).isalpha() and k != 10}
LONE = re.compile(r"\W*[^\s\"'`<>()\[\]{},;|=:]{8,}\W*\Z")
URL = re.compile(r"://([^\s/@:'\"`\[]*):([^\s/@'\"`\[]+)@")
LEX = re.compile(r"-----(?:BEGIN|END)[ A-Z0-9]*-----|\[REDACTED\]|[^\s\"'`<>()\[\]{},;|=:\\&?]+={0,2}(?![^\s\"'`<>()\[\]{},;|\\&?.])|[^\s\"'`<>()\[\]{},;|=:\\&?]+|:=|[\"'`<>()\[\]{},;|=:\\&?]")
WORDISH = re.compile(r"[^\W\d_]")
VENDOR = re.compile(r"^(?:sk_live_|sk_test_|rk_live_|rk_test_|pk_live_|AKIA|ASIA|gh[pousr]_|github_pat_|xox[baprs]-|ya29\.|glpat-|npm_|dop_v1_|AIza|SG\.|hf_|shpat_)")
VENDOR_TOKEN = re.compile(VENDOR.pattern.replace("^", r"(?<![A-Za-z0-9])") + r"[A-Za-z0-9_\-]{8}")
OPEN_END = re.compile(r"(?:[:=\\]|>-|\||=\s*\(|:\s*['\"])\s*$")
_CUT = r"(?:\.{3}|\u2026|\[(?:truncated|snipped|cut)\]|<(?:snip|truncated|cut)>)?"
BODY = re.compile(r"^[\s+\-#>\d|\"']*([A-Za-z0-9+/=]{16,})[\"'\\,]*\s*" + _CUT + r"\s*$")
#: What is left of a key's line that was cut, and what tells it from a word.
REST = re.compile(r"^[\s+\-#>\d|\"']*([A-Za-z0-9+/=]{1,15})[\"'\\,]*\s*" + _CUT + r"\s*$")
TANGLED = re.compile(r"[a-z][A-Z]|[A-Za-z]\d|\d[A-Za-z]|[+=]")
PEM_FIELD = re.compile(r"^[\s+\-#>]*(Proc-Type|DEK-Info)")
#: A key's body on its BEGIN line, with written line feeds.
INLINE = re.compile(r"(?:(?:\\+[rn])+(?:Proc-Type|DEK-Info):[^\\\"'\n]*)*(?:(?:\\+[rn]|[ \t])*[A-Za-z0-9+/=]{16,})*(?:(?:\\+[rn])+[A-Za-z0-9+/=]{1,15}(?![^\\\"'\s]))?")
#: Lines that may stand in a closed key block, in any listing: a long run of base64, a field, or a single word.
BLOCK = re.compile(r"[A-Za-z0-9+/=]{16,}|^[\s+\-#>\d|\"']*\S*\s*$|Proc-Type|DEK-Info|Comment:")
SHELL = re.compile(r"[\s$#>]*(cat|echo|printenv|pbpaste|head|vault|op) ")
NAMED = re.compile(r"\bname:\s*\S+\s*$", re.I)
PEM_HEAD = re.compile(r"-----BEGIN[ A-Z0-9]*-----")
PEM_EDGE = re.compile(r"-----(BEGIN|END)[ A-Z0-9]*-----")

Token = tuple[str, int, int, str]  # text, start, end, role (url_user, url_pass or "")


def lex(line: str) -> list[Token]:
    """Lexical tokens of a line. A URL's user and password are tokens of their own."""
    out: list[Token] = []

    def plain(start: int, end: int) -> None:
        for m in LEX.finditer(line, start, end):
            text, a, b = m[0], m.start(), m.end()
            while len(text) > 1 and text[-1] in "." and not text.endswith("..."):
                text, b = text[:-1], b - 1
            out.append((text, a, b, ""))

    at = 0
    for m in URL.finditer(line) if "@" in line else ():
        plain(at, m.start(1))
        if m[1]:
            out.append((m[1], m.start(1), m.end(1), "url_user"))
        out.append((":", m.end(1), m.end(1) + 1, ""))
        out += [(m[2], m.start(2), m.end(2), "url_pass"), ("@", m.end(2), m.end(2) + 1, "")]
        at = m.end(2) + 1
    plain(at, len(line))
    return out


def bits(text: str) -> float:
    n = len(text)
    return -sum(k / n * math.log2(k / n) for k in Counter(text).values()) if n else 0.0


@lru_cache(maxsize=200_000)
def shape(text: str) -> str:
    """Form of a token."""
    n = len(text)
    if n == 1 and not text.isalnum():
        return "punct" + text
    if text == MARK:
        return "mark"
    if text.startswith("-----"):
        return "pem_private" if "PRIVATE" in text and "BEGIN" in text else "pem"
    if text.startswith("CANARY"):
        return "needle"
    if VENDOR.match(text) and n >= 16:
        return "vendor"
    if text.startswith("eyJ") and n >= 20:
        return "jwt"
    if text.isdigit():
        return "num"
    if re.fullmatch(r"[*xX•.…_#-]{3,}|changeme|todo|null|none|true|false|undefined|redacted", text, re.I):
        return "placeholder"
    if re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", text):
        return "uuid"
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) and re.search(r"\d", text) and n >= 6:
        return f"hex{8 if n <= 8 else 15 if n < 16 else 23 if n < 24 else 31 if n < 32 else 32 if n == 32 else 39 if n < 40 else 40 if n == 40 else 63 if n < 64 else 64}"
    if re.fullmatch(r"sha(256|384|512)-.*", text):
        return "sri"
    if text.startswith("AAAA") and n > 40:
        return "pubkey"
    if re.fullmatch(r"[a-z0-9]{5}(-[a-z0-9]{5}){3}", text):
        return "group"
    if re.fullmatch(r"[A-Z]?[a-z]+", text):
        return "word" if text[0].islower() else "Cap"
    if re.fullmatch(r"[A-Z]+", text):
        return "UPPER"
    if re.fullmatch(r"[A-Z][A-Z0-9]*(_[A-Z0-9]+)+", text):
        return "CONST"
    if re.fullmatch(r"[a-z]+(_[a-z]+)+(_\d+)?", text):
        return "snake" if text[-1].isdigit() else "snake_words"
    if re.fullmatch(r"[A-Z][a-z]+[A-Z][A-Za-z]*\d+[!#$%&*?]", text):
        return "pascal_pw"
    if re.fullmatch(r"[A-Za-z]+[#@$%&!]\d+!?", text):
        return "word_pw"
    if re.fullmatch(r"[a-z]+(\.[a-z]+){2,}", text):
        return "dotted3"
    if re.fullmatch(r"[\w-]+(\.[\w-]+)+", text) and re.search(r"\.(test|internal|invalid|example|com|org|net|local)$", text):
        return "host"
    if re.fullmatch(r"\d+([:.]\d+)+", text):
        return "time"
    if re.fullmatch(r"[a-z]+(-[a-z]+)+-\d+", text):
        return "kebab_num"
    if re.fullmatch(r"[a-z]+(-[a-z]+)+", text):
        return "kebab"
    if re.fullmatch(r"[\w.-]*(/[\w.@+-]+)+\.[a-z]{1,4}(:\d+)?", text):
        return "path"
    if re.fullmatch(r"[a-z0-9]+_[a-z0-9]+(_[a-z0-9]+)*", text) and re.search(r"[a-z]\d[a-z_]|\d[a-z]", text):
        return "leet"
    if re.fullmatch(r"\w+(\.\w+)+", text) and not re.search(r"\d", text):
        return "dotted"
    kinds = bool(re.search(r"[a-z]", text)) + bool(re.search(r"[A-Z]", text)) + bool(re.search(r"\d", text))
    if kinds == 3 and n >= 12 and re.fullmatch(r"[A-Za-z0-9+/_%.=-]+", text):
        return f"mix{12 if n < 16 else 16 if n < 24 else 24 if n < 40 else 40}" + ("=" if text[-1] == "=" else "")
    if n >= 14 and text[-1] == "=" and kinds >= 2:
        return "mix16="
    if kinds == 3 and re.search(r"[!#@$%&*?]", text):
        return "strong_pw"
    if kinds >= 2 and n >= 16 and re.fullmatch(r"[A-Za-z0-9+/_=-]+", text) and bits(text) >= 3.6:
        return "blob"
    if "/" in text:
        return "slashes"
    if re.search(r"\d", text) and WORDISH.search(text):
        return "alnum"
    return "other"


@lru_cache(maxsize=200_000)
def own_features(text: str, role: str) -> tuple[str, ...]:
    n, s = len(text), shape(text)
    out = [f"s:{s}", f"n:{min(n // 4, 16)}", f"r:{role}:{s}" if role else "r:"]
    if n >= 8 and not s.startswith("punct"):
        out.append(f"h:{round(bits(text) * 2)}")
        changes = len(re.findall(r"(?<=[A-Za-z])(?=\d)|(?<=\d)(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])", text))
        out.append(f"c:{min(changes, 6)}")
    if s in ("dotted3", "dotted"):
        first, last = text.split(".")[0].lower(), text.rsplit(".", 1)[-1]
        out.append(f"d:{first in ('config', 'settings', 'process', 'os', 'env', 'self', 'cfg', 'conf')}:{name_kind(last)}")
    if s in ("word", "Cap", "snake_words", "UPPER") and n < 24:
        out.append(f"w:{text.lower()}")
    return tuple(out)


@lru_cache(maxsize=100_000)
def name_kind(name: str) -> str:
    if PUBLIC.search(name):
        return "public"
    if NAME.search(name):
        return "digest" if DIGEST.search(name) and not re.search(r"secret|passw|key", name, re.I) else "secret"
    if DIGEST.search(name):
        return "digest"
    return "const" if name.isupper() else "plain"


def keys(line: str, toks: list[Token], before: str) -> list[list[tuple]]:
    """What is seen of every token that isn't punctuation, as keys that ``expand`` turns into features.

    before: what the lines before say (see contexts).
    """
    shapes = [shape(t[0]) for t in toks]
    words = [(k, tag(t[0])) for k, t in enumerate(toks) if WORDISH.search(t[0])]
    lower = line.lower()
    cues = tuple([c for c in CUES if c in lower])
    places = [k for k, _ in words]
    out: list[list[tuple]] = []
    name, distance, valued = "", 99, False
    single = sum(not s.startswith("punct") for s in shapes) == 1
    j = 0  # words before this token
    for k, (text, a, b, role) in enumerate(toks):
        s = shapes[k]
        if s.startswith("punct"):
            valued |= text in "=:|"
            distance += 1
            continue
        own = j < len(places) and places[j] == k
        near = "=" if valued and distance <= 2 else "~" if distance <= 3 else "far"
        found = [("own", text, role), ("edge", line[a - 1] if a else "^", line[b] if b < len(line) else "$", s), ("name", name.lower()[:24] and name, near, s), ("before", before, single, s)]
        for d in range(min(3, j)):
            found.append(("p", d, words[j - 1 - d][1], s))
        ahead = j + 1 if own else j
        for d in range(min(2, len(words) - ahead)):
            found.append(("f", d, words[ahead + d][1], s))
        if cues:
            found.append(("cues", cues, s))
        if not out or single:
            found.append(("first", s))
        out.append(found)
        if own:
            j += 1
        if text == ":=":
            valued = True
        elif own and not role:
            name, distance, valued = text, 0, False
            continue
        distance += 1
    return out


@lru_cache(maxsize=200_000)
def tag(word: str) -> tuple[str, bool]:
    """A word as its neighbours see it, and whether that is a word and no value."""
    s = shape(word)
    return (word.lower() if s in ("word", "Cap", "UPPER") else s), s in ("word", "Cap", "UPPER", "CONST", "snake_words", "host", "kebab")


def expand(key: tuple) -> list[str]:
    """The features of one key."""
    kind = key[0]
    if kind == "own":
        return list(own_features(key[1], key[2]))
    if kind == "edge":
        _, left, right, s = key
        return [f"l:{left}:{s}", f"x:{right}", f"q:{left}{right}"]
    if kind == "name":
        _, name, near, s = key
        told = name_kind(name) if name else "none"
        return [f"k:{told}{near}", f"k:{told}{near}:{s}"] + ([f"kn:{name.lower()[:24]}{near}"] if name else [])
    if kind == "before":
        _, before, single, s = key
        return [f"b:{before}:{s}", f"1:{single}:{before}:{s}"]
    if kind in "pf":
        _, d, (word, plain), s = key
        return [f"{kind}{d}:{word}", f"{kind}{d}:{word}:{s}"] if plain or kind == "f" else []
    if kind == "cues":
        return [f"u:{c}:{key[2]}" for c in key[1]]
    return [f"first:{key[1]}"]


def features(line: str, toks: list[Token], before: str) -> list[list[str]]:
    """Features of every token that isn't punctuation."""
    return [[f for key in found for f in expand(key)] for found in keys(line, toks, before)]


class Scorer:
    """Emissions of a field for keys; what a key adds is summed up once and kept."""

    def __init__(self, field: crf.Model, most: int = 400_000):
        self.field, self.most = field, most
        self.known: dict[tuple, tuple[float, float, float]] = {}

    def emissions(self, line: str, toks: list[Token], before: str) -> list[list[float]]:
        known, out = self.known, []
        if len(known) > self.most:
            known.clear()
        for found in keys(line, toks, before):
            o = b = i = 0.0
            for key in found:
                w = known.get(key)
                if w is None:
                    w = known[key] = tuple(self.field.emission(expand(key)))
                o, b, i = o + w[0], b + w[1], i + w[2]
            out.append([o, b, i])
        return out


@lru_cache(maxsize=2)
def scorer(field: crf.Model) -> Scorer:
    return Scorer(field)


def solid(toks: list[Token]) -> list[Token]:
    return [t for t in toks if not shape(t[0]).startswith("punct")]


def hits(text: str, words) -> set[int]:
    """Numbers of the lines that could hold a secret by themselves; words: an automaton of the gate's words, or None for all lines."""
    if words is None:
        return set(range(text.count("\n") + 1))
    starts, at = [0], text.find("\n")
    while at >= 0:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    places = [m.start() for m in LONG.finditer(text) if MIXED.search(m[0])] + [m.start() for m in VENDOR_TOKEN.finditer(text)]
    if "://" in text:
        places += [m.start() for m in URL.finditer(text)]
    if "-----B" in text:
        places += [m.start() for m in PEM_HEAD.finditer(text)]
    places += [m.start() for m in TANGLE.finditer(text)]
    places += [m.start() for m in SERVICE.finditer(text)]
    out = {bisect(starts, p) - 1 for p in places}
    # non-letters become blanks, so a word of the gate ends where letters end
    plain = text.lower().translate(NOT_LETTERS)
    if len(plain) == len(text):
        out.update(bisect(starts, max(0, end - 2)) - 1 for end, _ in words.iter(" " + plain.replace("\n", " ") + " "))
    else:  # lower case of another length: line by line
        out.update(n for n, line in enumerate(text.split("\n")) if next(words.iter(" " + line.lower().translate(NOT_LETTERS) + " "), None))
    return out


def contexts(text: str, words=None) -> Iterator[tuple[int, str, str]]:
    """(number, line, what comes before) of the lines that could hold a secret; without a gate of all but blank ones, bare fences and a key's body."""
    pem, kube, before, shell, likely = "", False, "", False, hits(text, words)
    if not likely:
        return
    lines = text.split("\n")
    for n, line in enumerate(lines):
        if pem:
            if "-----END" in line:
                pem = ""
                if WORDISH.search(line[line.rindex("-----") :]) and n in likely:
                    yield n, line, "kube" if kube and line[:1] in " \t+-" and ":" in line else ""
                continue
            if BODY.match(line) or not line.strip() or PEM_FIELD.match(line):
                continue
            pem = ""
        bare = line.strip()
        if "kind: Secret" in line:
            kube = True
        elif kube and bare and line[:1] not in " \t+-#" and not re.match(r"(apiVersion|metadata|type|data|stringData|kind)\b", bare):
            kube = False
        state = before or ("kube" if kube and line[:1] in " \t+-" and ":" in line else "") or ("shell" if shell else "")
        head = PEM_HEAD.search(line) if "-----B" in line else None
        if head:
            following = next((x for x in lines[n + 1 : n + 3] if x.strip()), "")
            if MARK in line or (MARK in following and not line[head.end() :].strip(" \"'\\n")):
                state = "pem_gone"
            pem = "" if "-----END" in line or MARK in following else "in"
        if bare.startswith("```"):
            if n in likely and WORDISH.search(bare):
                yield n, line, state
            shell, before = True, ""
        elif bare:
            maybe = n in likely
            if maybe or state and (state != "shell" or LONE.match(bare)):
                yield n, line, state
            before, shell = "", bool(SHELL.match(line))
            if maybe:
                opened = bare[-1] in ":=\\-|'\"(" and OPEN_END.search(line)
                if (opened or NAMED.search(line)) and NAME.search(line) and not PUBLIC.search(line):
                    before = "open_secret" if opened else "named"


@lru_cache(maxsize=1)
def model() -> crf.Model:
    """The field, trained on made-up lines; the same every time."""
    rows = []
    for lines, spans in _examples():
        for n, line, before in contexts("\n".join(lines)):
            toks = lex(line)
            labels, inside = [], None
            for _, a, b, _ in solid(toks):
                hit = next((k for k, (m, x, y) in enumerate(spans) if m == n and a < y and b > x), None)
                labels.append(0 if hit is None else 2 if hit == inside else 1)
                inside = hit
            rows.append((features(line, toks, before), labels))
    return crf.fit(rows).leaning(LEANING)


@lru_cache(maxsize=1)
def _examples() -> list[tuple[list[str], list[tuple[int, int, int]]]]:
    return list(examples(random.Random(5), TRAINING_LINES))


def letters(line: str) -> set[str]:
    """Words of a line as the gate sees them: runs of letters in lower case."""
    return set(line.lower().translate(NOT_LETTERS).split())


@lru_cache(maxsize=1)
def gate() -> tuple[str, ...]:
    """Words that let a line through to the field, for callers that may leave lines out; ``scan`` doesn't.

    Candidates are the names and nouns of secrets that the field is trained with and the
    cues it has features for; where these aren't enough, the words that the field's weights
    connect with the start of a secret. They are taken in the order of how many more
    made-up lines with a secret they let through for each line without one, until all pass
    but a share of ``MISSED``;
    for rare forms, three times as many lines are made up as the field is trained with.
    """
    weights = model().weights
    linked = {w for f, (o, b, _) in weights.items() if b - o > 0.1 and re.match(r"(?:[pf]\d|kn|u):", f) for w in letters(f.split(":", 1)[1])}
    base = {w for text in [*_NAMES, *CUES, *(n for nouns in _NOUNS.values() for n in nouns)] for w in letters(text) if len(w) > 2}
    wanted, others = [], Counter()
    for lines, spans in [*_examples(), *examples(random.Random(6), 3 * TRAINING_LINES)]:
        text = "\n".join(lines)
        states = {n: state for n, _, state in contexts(text)}
        passing = hits(text, _words(()))
        for n, line in enumerate(lines):
            secret = [(a, b) for m, a, b in spans if m == n]
            if secret and n not in passing and states.get(n, "") in ("", "shell"):
                (a, b), *_ = secret
                seen = letters(line[:a] + " " + line[b:])
                wanted.append((seen & linked) | {x for x in base if x in seen or len(x) > 3 and any(w.endswith(x) for w in seen)})
            elif not secret:
                seen = letters(line)
                others.update((seen & linked) | {x for x in base if x in seen or len(x) > 3 and any(w.endswith(x) for w in seen)})
    chosen: list[str] = []
    everything = list(wanted)
    for candidates in (base, linked):
        while len(wanted) > MISSED * len(everything):
            gain = Counter(w for words in wanted for w in words & candidates)
            if not gain:
                break
            best = max(sorted(gain), key=lambda w: gain[w] / (others[w] + 5))
            chosen.append(best)
            wanted = [words for words in wanted if best not in words]
    for word in list(chosen):  # what later words let through as well
        rest = set(chosen) - {word}
        if all(words.isdisjoint(chosen) or not words.isdisjoint(rest) for words in everything):
            chosen.remove(word)
    return tuple(chosen)


def _words(words: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for word in words:  # a word of more than three letters may end a longer one, as in clientsecret
        found.add_word(word + " " if len(word) > 3 else f" {word} ", word)
    if not words:
        found.add_word("\x00", "")
    found.make_automaton()
    return found


@lru_cache(maxsize=1)
def automaton(words: tuple[str, ...]):
    return _words(words)


def find(text: str, field: crf.Model, declared: frozenset[str] = frozenset(), words: tuple[str, ...] | None = None) -> list[tuple[int, int, int]]:
    """(line number from 0, start, end) of every secret in a text, in order; words: the gate's, or None to label all lines."""
    return [(n, a, b) for n, line, before in contexts(text, None if words is None else automaton(words)) for a, b in known(line, field, before, declared)]


def find_all(texts: list[str | None], field: crf.Model, declared: frozenset[str] = frozenset()) -> list[list[tuple[int, int, int]]]:
    """As find of every text, all lines labelled; those that provably hold no secret are told from the others together."""
    from noteglass.llm.sieve import sieve

    rows = [list(contexts(text)) if text else [] for text in texts]
    likely = sieve(field).likely((line, before) for lines in rows for _, line, before in lines)
    return [[(n, a, b) for n, line, before in lines if (line, before) in likely for a, b in known(line, field, before, declared)] for lines in rows]


@lru_cache(maxsize=20_000)
def short(line: str, field: crf.Model, before: str, declared: frozenset[str]) -> list[tuple[int, int]]:
    return label(line, field, before, declared)


def known(line: str, field: crf.Model, before: str, declared: frozenset[str]) -> list[tuple[int, int]]:
    """As label; lines of up to 1,000 characters, which a note and its raw text share, are kept for a while."""
    return short(line, field, before, declared) if len(line) <= 1000 else label(line, field, before, declared)


def label(line: str, field: crf.Model, before: str, declared: frozenset[str]) -> list[tuple[int, int]]:
    """Spans of the secrets of one line, whatever its length."""
    out, span, toks, last = [], None, lex(line), ""
    for (word, a, b, role), to in zip(solid(toks), field.viterbi(scorer(field).emissions(line, toks, before)), strict=True):
        if to and (word == MARK or last == "url_pass" or any(d in word for d in declared)):
            to = 0  # a URL's password ends at its host
        last = role
        if to == 2 and span:
            span[1] = b
        else:
            if span:
                out.append((span[0], span[1]))
            span = [a, b] if to else None
    return [*out, (span[0], span[1])] if span else out


def key_end(text: str, at: int) -> int:
    """End of the private key block whose BEGIN header ends at a place.

    That is its END header, if that comes before any other header and no other lines than a
    key's lie between. A block that was cut ends with the last line of its body, as contexts
    takes it, or with what is left of the line at the cut.
    """
    edge = PEM_EDGE.search(text, at)
    if edge and edge[1] == "END":
        between = text[at : edge.start()].split("\n")[1:-1]
        if all(BLOCK.search(x) for x in between[:-1]):  # the last may be short
            return edge.end()
    end, last = INLINE.match(text, at).end(), text.find("\n", at)
    while last >= 0:
        start = last + 1
        last = text.find("\n", start)
        line = text[start : last if last >= 0 else len(text)]
        if not line.strip() or PEM_FIELD.match(line):
            continue
        body = BODY.match(line)
        if not body:
            rest = REST.match(line)
            if rest and (last < 0 or not text[last:].strip() or text.count("\n", end, start) == 1 and TANGLED.search(rest[1])):
                end = start + rest.end(1)
            break
        end = start + body.end(1)
    return end


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with only the secrets replaced; private key blocks go to their END, or as far as they were kept."""
    starts, at = [], 0
    for line in text.split("\n"):
        starts.append(at)
        at += len(line) + 1
    out, done = [], 0
    for n, a, b in spans:
        begin, end = starts[n] + a, starts[n] + b
        if begin < done:
            continue
        if text.startswith("-----BEGIN", begin):
            end = key_end(text, end)
        out += [text[done:begin], MARK]
        done = end
    return "".join([*out, text[done:]])


def scan(records: DataFrame, declared: list[str], redacted: bool = False) -> DataFrame:
    """(rec, line_no, start, end) of every secret of records (rec, text); or, redacted, (rec, n_secrets, text) of the records that hold one."""
    import noteglass.llm.credentials as own

    field, needles = own.model(), frozenset(d for d in declared if len(d or "") >= 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                rows: list[tuple] = []
                texts = batch.column("text").to_pylist()
                for rec, text, spans in zip(batch.column("rec").to_pylist(), texts, own.find_all(texts, field, needles), strict=True):
                    if redacted and spans:
                        rows.append((rec, len(spans), own.redact(text, spans)))
                    elif not redacted:
                        rows += [(rec, n + 1, a, b) for n, a, b in spans]
                kinds = [pa.string(), pa.int32(), pa.string()] if redacted else [pa.string(), pa.int32(), pa.int32(), pa.int32()]
                names = ["rec", "n_secrets", "text"] if redacted else ["rec", "line_no", "start", "end"]
                cols = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return records.select("rec", "text").mapInArrow(run, "rec string, n_secrets int, text string" if redacted else "rec string, line_no int, start int, end int")


# --- made-up lines ---------------------------------------------------------------------

_WORDS = "amber anvil basil beacon birch canyon cedar cinder clover comet coral delta ember falcon fern garnet glacier harbor hazel indigo island jasper juniper kernel lantern lotus maple marble meadow nebula nickel ocean olive orbit otter pebble pepper pine planet quartz raven ridge river saddle salmon sierra silver sparrow summit thistle timber tulip valley velvet walnut willow winter yarrow zephyr".split()
_VERBS = "load parse build fetch render check flush merge sort store index read write scan split apply encode filter update drop move count".split()
_NAMES = "password passwd pwd pass db_password DB_PASSWORD DB_PASS secret client_secret clientSecret webhook_secret SIGNING_SECRET signing_key token auth_token access_token ACCESS_TOKEN refresh_token private_token api_key apiKey API_KEY apikey bearer HMAC_SALT jwt_secret SESSION_SECRET encryptionKey master_key admin_pin kennwort mot_de_passe passphrase smtp_pass ADMIN_PWD access_key secret_key private_key credential contraseña clave auth".split()
#: Names that hold such words and mean something else.
_LOOKALIKES = "token_count tokenizer token_bucket next_token key_index primary_key sort_key cache_key key_error author_id authority pass_rate passing secretary password_policy salted cookie_banner session_count session_store pin_layout unpin hash_map keyboard signature_line credential_form".split()
_EXTS = "py ts go sh sql yaml toml ini tf md js java rb".split()


class Maker:
    """Random names, secrets and lookalikes."""

    def __init__(self, rng: random.Random):
        self.r = rng

    def w(self) -> str:
        return self.r.choice(_WORDS)

    def n(self, most: int = 9999) -> str:
        return str(self.r.randint(1, most))

    def of(self, *options: str) -> str:
        return self.r.choice(options)

    def fn(self) -> str:
        """An identifier; some hold secret-like words, some a digit inside a word."""
        r = self.r
        parts = [r.choice([*_VERBS, *_WORDS]), self.w()] + ([self.w()] if r.random() < 0.4 else []) + ([self.n(999)] if r.random() < 0.35 else [])
        kind = r.random()
        if kind < 0.15:
            parts[r.randrange(2)] = r.choice(_LOOKALIKES)
        elif kind < 0.35:
            k = r.randrange(len(parts[:3]))
            at = r.randint(1, len(parts[k]))
            parts[k] = parts[k][: at - r.randint(0, 1)] + str(r.randint(0, 9)) + parts[k][at:]
        return "_".join(parts)

    def camel(self) -> str:
        """A class name; some with a digit inside a word."""
        text = self.w().title() + self.w().title() + self.of("Error", "Exception", "Client", "Test", "")
        at = self.r.randint(1, len(text) - 1)
        return text[: at - 1] + str(self.r.randint(0, 9)) + text[at:] if self.r.random() < 0.4 else text

    def const(self) -> str:
        words = [self.w() for _ in range(self.r.randint(1, 2))]
        return "_".join([*words, self.of("MODE", "TTL", "LIMIT", "SIZE", "PATH", "FLOOR", "LEVEL", "COUNT", "URL", "HOST")]).upper()

    def host(self) -> str:
        return f"{self.w()}{self.of('-', '')}{self.n(90)}.{self.w()}.{self.of('test', 'internal', 'invalid', 'example', 'local', 'com', 'org', 'net')}"

    def path(self) -> str:
        return f"{self.w()}/{self.w()}/{self.fn()}.{self.r.choice(_EXTS)}"

    def branch(self) -> str:
        return f"{self.of('fix', 'feature', 'chore', 'spike', 'wip', 'release')}/{self.w()}-{self.n()}"

    def clock(self) -> str:
        return f"{self.r.randint(0, 23):02}:{self.r.randint(0, 59):02}:{self.r.randint(0, 59):02}"

    def chars(self, alphabet: str, n: int) -> str:
        return "".join(self.r.choice(alphabet) for _ in range(n))

    def hex(self, n: int) -> str:
        return self.chars("0123456789abcdef", n)

    def b62(self, n: int) -> str:
        return self.chars("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", n)

    def b64(self, n: int) -> str:
        return base64.b64encode(self.r.randbytes(n)).decode()

    def url64(self, n: int) -> str:
        return self.chars("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", n)

    def pw(self) -> str:
        a, b = self.w(), self.w()
        leet = str.maketrans("aeio", "4310")
        return self.r.choice([f"{a.title()}{b.title()}{self.n()}!", f"{a}.{b}.{self.w()}", f"{a.translate(leet)}_{b}", f"{a.translate(leet)}_{b}", f"{a}_{b.translate(leet)}", f"{a}_{b}", f"{a}_{b}", f"{a}-{b}-{self.r.randint(0, 99)}", f"{a}#{self.n()}", f"{a}@{self.n()}", f"{a}{self.r.choice('!#$%&')}{self.n()}", f"{a.title()}{self.of('.', '-', '_', '')}{b}{self.n(99)}", f"{a}{b.title()}{self.n()}", f"{a.title()}{self.of('.', '-', '&')}{b.title()}{self.of('.', '-', '')}{self.n(99)}{self.of('!', '', '?')}", f"{a.title()}{self.r.choice('!#$%&')}{self.n()}"])

    def wordy(self) -> str:
        """A password that looks like an identifier."""
        leet = str.maketrans("aeio", "4310")
        return self.of(self.w().translate(leet), self.w()) + "_" + self.of(self.w().translate(leet), self.w())

    def vendor(self) -> str:
        r = self.r
        return r.choice(["AKIA" + self.chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), "ASIA" + self.chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), "sk_live_" + self.b62(24), "rk_live_" + self.b62(24), "ghp_" + self.b62(36), "glpat-" + self.url64(20), "xoxb-" + self.b62(40), "ya29." + self.url64(44), "dop_v1_" + self.hex(64), "npm_" + self.b62(36), "AIza" + self.url64(35)])

    def jwt(self) -> str:
        return f"eyJ{self.url64(self.r.randint(20, 50))}.eyJ{self.url64(self.r.randint(40, 120))}.{self.url64(self.r.randint(40, 86))}"

    def group(self) -> str:
        return "-".join(self.chars("abcdefghijklmnopqrstuvwxyz0123456789", 5) for _ in range(4))

    def strong(self) -> str:
        r = self.r
        return r.choice([self.vendor, self.vendor, self.jwt, self.group, lambda: self.hex(r.choice([20, 24, 32, 40, 48, 64])), lambda: self.b62(r.randint(16, 44)), lambda: self.b64(r.choice([15, 18, 20, 24, 30, 32, 33, 48]))])()

    def secret(self) -> str:
        return self.strong() if self.r.random() < 0.5 else self.pw()

    def basic(self) -> str:
        return base64.b64encode(f"{self.of('svc', 'ci', 'bot')}{self.n(99)}:{self.pw()}".encode()).decode()

    def name(self) -> str:
        r, n = self.r, self.r.choice(_NAMES)
        return r.choice([n, n, f"{self.w()}_{n}", f"{n}_{self.w().upper()}" if n.isupper() else f"{n}_{self.w()}"])

    def user(self) -> str:
        return self.of("root", "app", "etl", "reader", "admin", f"svc_{self.w()}", "deploy", "postgres")

    def url(self, secret: str) -> str:
        r = self.r
        scheme, user = r.choice(["postgres", "postgresql+psycopg", "mysql", "redis", "amqp", "mongodb+srv", "https", "ftp"]), self.user() if r.random() < 0.85 else ""
        return f"{scheme}://{user}:{secret}@{self.host()}/{self.fn()}" + (f"?pool={self.n()}" if r.random() < 0.4 else "")

    def place(self) -> str:
        return self.r.choice([self.host, self.host, lambda: f"`{self.fn()}`", self.fn, lambda: f"the {self.w()} host", lambda: f"the {self.w()} {self.of('service', 'account', 'database', 'queue', 'bucket', 'site')}"])()

    def end(self) -> str:
        """How a sentence goes on, or ends."""
        return self.r.choice([lambda: ".", lambda: ".", lambda: "", lambda: f" until {self.branch()} is in.", lambda: f", which `{self.fn()}` needs.", lambda: f" since {self.clock()}.", lambda: " and nothing else.", lambda: f" for the {self.w()} account.", lambda: f"; see {self.path()}.", lambda: f" ({self.w()}).", lambda: f" at {self.clock()}", lambda: f" on {self.host()}"])()

    def sentence(self) -> str:
        """A working sentence about names, places and numbers, in one of four languages."""
        r = self.r
        things = [lambda: f"`{self.fn()}`", self.fn, self.path, self.const, lambda: f"the {self.w()} {self.of('job', 'feed', 'table', 'test', 'cache', 'branch', 'token', 'key', 'lock')}", self.host, lambda: f"{self.path()}:{self.n()}", lambda: f"commit {self.hex(8)}"]
        amounts = [lambda: f"{self.n()} rows", lambda: f"{self.n()} ms", lambda: f"{self.n(99)}.{self.n(99)} s", lambda: f"{self.n()} times", lambda: f"{self.const()}={self.n()}", lambda: self.hex(8), lambda: f"{self.n()} {self.w()}s"]
        thing, amount = lambda: r.choice(things)(), lambda: r.choice(amounts)()
        verb = self.of("reads", "writes to", "calls", "blocks", "skips", "needs", "breaks", "replaces", "imports", "waits for", "returned", "dropped", "is slower than", "comes before", "no longer uses", "fails without", "retries")
        def en() -> str:
            start = f"{self.of('', '', 'Note that ', 'So ', 'After that ', 'Not clear why ', 'Next: ', 'Found that ', 'Please check whether ')}{thing()} {verb} {thing()}"
            return start + r.choice([lambda: "", lambda: f" after {amount()}", lambda: f" with {amount()}", lambda: f", about {amount()}", lambda: f" when {thing()} is {self.of('empty', 'stale', 'missing', 'locked')}", lambda: f", because {thing()} {self.of('reads', 'needs', 'drops')} {amount()}"])()

        de = lambda: f"{self.of('Danach ', 'Hier ', 'Beim Lauf ')}{self.of('liest', 'schreibt', 'ruft', 'braucht', 'blockiert')} {thing()} {self.of('noch', 'wieder', 'nur')} {thing()}{self.of('', f', etwa {amount()}', f' nach {amount()}')}"
        fr = lambda: f"{thing()} {self.of('lit', 'appelle', 'bloque', 'remplace', 'attend')} {self.of('encore', 'toujours', 'seulement')} {thing()}{self.of('', f' après {amount()}', f', environ {amount()}')}"
        es = lambda: f"{thing()} {self.of('lee', 'llama a', 'bloquea', 'sustituye a', 'espera')} {self.of('todavía', 'solo', 'otra vez')} {thing()}{self.of('', f' tras {amount()}', f', unos {amount()}')}"
        return r.choice([en, en, en, en, de, fr, es])() + self.of(".", ".", "", ":")


def _quote(m: Maker, s: str) -> str:
    q = m.r.choice(["`", '"', ""])
    return f"{q}{s}{q}"


_NOUNS = {
    "en": ["password", "passphrase", "secret", "login", "access key", "key", "token", "pin", "api key", "admin password", "root password", "shared password"],
    "de": ["Passwort", "Kennwort", "Schlüssel"],
    "fr": ["mot de passe", "clé"],
    "es": ["contraseña", "clave"],
}
#: Nouns of the same sentences that speak of no secret.
_OTHERS = {
    "en": ["owner", "caller", "default", "job", "test", "entry point", "name", "reader", "fallback", "table", "branch", "main function", "first step", "alias", "user", "limit", "worker"],
    "de": ["Ziel", "Feld", "Modul", "Beispiel", "Ergebnis"],
    "fr": ["nom", "module", "test", "champ", "résultat"],
    "es": ["tabla", "tarea", "prueba", "salida", "entrada"],
}


def _told(m: Maker, x: str, nouns: dict[str, list[str]] = _NOUNS) -> str:
    """A sentence that tells what something is, by default a secret; x may be quoted."""
    noun, german, french, spanish = (m.r.choice(nouns[k]) for k in ("en", "de", "fr", "es"))
    place = m.place()
    en = [
        lambda: f"The {noun} {m.of('for', 'on', 'of', 'at')} {place} is {m.of('', 'now ', 'still ', 'currently ', 'again ')}{x}{m.end()}", lambda: f"The {noun} {m.of('for', 'of')} {place} was {m.of('', 'changed to ', 'reset to ', 'set to ')}{x}{m.end()}", lambda: f"Use {x} as the {noun} {m.of('for', 'on')} {place}{m.end()}", lambda: f"{place} {m.of('takes', 'accepts', 'has')} {x} as {m.of('its', 'the')} {noun}{m.end()}",
        lambda: f"{m.of('Log in', 'Sign in', 'Connect')} to {place} with {x}{m.end()}", lambda: f"{m.of('Somebody', 'We', 'The admin', 'They')} {m.of('set', 'changed', 'reset')} the {noun} {m.of('', f'of {place} ')}to {x}{m.end()}", lambda: f"{m.of('Support', 'The owner', 'A colleague')} {m.of('gave us', 'told me', 'mailed me')} {x}{m.of(', ', ' as ')}the {noun} {m.of('for', 'of')} {place}{m.end()}",
        lambda: f"With the {noun} {x} {m.of('you', 'one')} {m.of('get into', 'can open')} {place}{m.end()}", lambda: f"{x} is the {noun} {m.of('for', 'of')} {place}{m.end()}", lambda: f"The {noun} that {m.of('was valid', 'they entered', 'fits', 'was tried')} {m.of(f'at {m.clock()} ', f'on {place} ', '')}{m.of('was', 'is')} {x}{m.end()}", lambda: f"For {place} {m.of('take', 'enter', 'type')} the {noun} {x}{m.end()}",
    ]
    de = [
        lambda: f"{m.of('Das', 'Der')} {german} {m.of('für', 'von', 'auf')} {place} {m.of('ist', 'lautet', 'heißt', 'bleibt')} {m.of('', 'jetzt ', 'noch ')}{x}{m.of('.', f' und gilt für {m.branch()}.', f' seit {m.clock()}.')}", lambda: f"{m.of('Mit', 'Nur mit')} dem {german} {x} {m.of('kann man sich an', 'meldet man sich bei', 'läuft')} {place} {m.of('an', 'anmelden', 'weiter')}.", lambda: f"Für {place} braucht man das {german} {x}.",
    ]
    fr = [
        lambda: f"{m.of('Le', 'La')} {french} {m.of('de', 'pour', 'sur')} {place} est {m.of('', 'toujours ', 'maintenant ')}{x}{m.of('.', f' depuis {m.clock()}.', f' pour {m.branch()}.')}", lambda: f"{m.of('Sur', 'Pour')} {place}, {m.of('la', 'le')} {french} {m.of('est', 'était', 'devient')} {x}.", lambda: f"Il faut {m.of('le', 'la')} {french} {x} pour {place}.", lambda: f"{m.of('La', 'Le')} {french} d'accès {m.of('de', 'à')} {place} {m.of('est', 'reste')} {x}.",
    ]
    es = [
        lambda: f"La {spanish} {m.of('de', 'para')} {place} es {m.of('', 'todavía ', 'ahora ')}{x}{m.of('.', f' desde {m.clock()}.', f' para {m.branch()}.')}", lambda: f"{m.of('Con', 'Usa')} la {spanish} {x} {m.of('se abre', 'en')} {place}.", lambda: f"{m.of('Para', 'En')} {place} {m.of('hace falta', 'vale')} la {spanish} {x}.",
    ]
    return m.r.choice([*en, *en, *de, *fr, *es])()


def _shown(m: Maker, strong: str) -> str:
    """A strong secret without a name, as a log or a sentence shows it."""
    who = m.of(m.fn(), f"`{m.fn()}`", m.host(), f"client {m.w()}", f"The {m.w()} {m.of('job', 'agent', 'proxy')}")
    does = m.of("returned", "got", "logged", "shows", "echoed", "expects", "asks for", "passes", "replied with", "answers to", "accepted", "connects with", "calls it with", "needs", "received", "keeps")
    return m.of(f"{who} {does} {_quote(m, strong)}{m.end()}", f"{who} {does} {_quote(m, strong)}{m.end()}", f"{_quote(m, strong)} is {m.of('used by', 'known to', 'set in', 'read by', 'the value in')} {who}{m.end()}", f"{m.clock()} {m.of('INFO', 'DEBUG', 'WARN')} {m.fn()} {m.of('with', 'via', 'got', 'sent')} {strong}", f"{m.clock()} {m.of('INFO', 'DEBUG')} {who} {does} {strong}")


def positives(m: Maker) -> list[str]:
    """One made-up place of a secret; the secret stands between \x01 and \x02. Lines of one place."""
    r, s = m.r, m.secret()
    x, strong = f"\x01{s}\x02", f"\x01{m.strong()}\x02"
    name, secret_pw = m.name(), f"\x01{m.pw()}\x02"
    key = r.choice(["RSA ", "EC ", "OPENSSH ", "DSA ", "ENCRYPTED ", "PGP ", ""])
    head, body = f"-----BEGIN {key}PRIVATE KEY-----", [m.b64(48) for _ in range(r.randint(2, 4))]
    header = m.of("X-Api-Key", "X-Auth-Token", "PRIVATE-TOKEN", "X-Access-Key", "Api-Key", "X-Secret", "X-Session")
    half = m.b62(28)
    named = [
        lambda: [f"{name}={x}"], lambda: [f"{name} = {x}"], lambda: [f'{name} = "{x}"'], lambda: [f"{name} = '{x}'"], lambda: [f"{name}: {x}"], lambda: [f"{name}:{x};"], lambda: [f'{name} := "{x}"'], lambda: [f'  "{name}": "{x}",'], lambda: [f"export {name}='{x}'"], lambda: [f'export {name}="{x}"'],
        lambda: [f"$env:{name.upper()} = '{x}'"], lambda: [f"os.environ['{name}'] = '{x}'"], lambda: [f"ENV {name} {x}"], lambda: [f"<{name}>{x}</{name}>"], lambda: [f"| {name} | {x} | {m.host()} |"], lambda: [f"{m.clock()} INFO {m.fn()} {name}={x} {m.w()}={m.n()}"], lambda: [f"--set {m.w()}.{name.replace('_', '.')}={x} {m.path()}"], lambda: ['"{\\"' + name + '\\": \\"' + x + '\\"}"'],
        lambda: [f'    {m.fn()}(user="{m.user()}", {r.choice(["password", "secret", "token"])}="{x}", {m.w()}={m.n()})'], lambda: [f"{name}: {x}  # {m.branch()}"], lambda: [f"set {name} {x}"], lambda: [f"{name.upper()}={x} python {m.path()}"], lambda: [f"this.{name} = '{x}';"],
    ]
    bare = [
        lambda: [f"{m.const()}={strong}"], lambda: [f"export {m.const()}={strong}"], lambda: [f"{m.const()}: {strong}  # {m.branch()}"], lambda: [f'    {m.w()} = {m.fn()}("{strong}")'], lambda: [f'{m.fn()}("{strong}", {m.n()})'], lambda: [_shown(m, strong)], lambda: [_shown(m, strong)], lambda: [_shown(m, strong)], lambda: [_shown(m, strong)], lambda: [f"- {m.const()}={strong}"],
        lambda: [f"curl -H '{header}: {strong}' https://{m.host()}/{m.fn()}"], lambda: [f'    headers["{header}"] = "{x}"'], lambda: [f"{header}: {strong}"],
        lambda: [f'    {m.fn()} = "{x}"  # {m.of("secret", "password", "token", "key")} {m.of("for", "of", "used by")} {m.host()}'], lambda: [f'    {m.fn()} = "\x01{half[:14]}" + "{half[14:]}\x02"  # {m.of("secret", "token", "key")} {m.of("for", "of")} {m.host()}'],
    ]
    tools = [
        lambda: [f'curl -H "Authorization: Bearer {strong}" https://{m.host()}/{m.fn()}'], lambda: [f"Authorization: Bearer {strong}"], lambda: [f"Authorization: Basic \x01{m.basic()}\x02"], lambda: [f"  --header 'Authorization: Basic \x01{m.basic()}\x02' https://{m.host()}/{m.fn()}"], lambda: [f'    "auth": "\x01{m.basic()}\x02"'], lambda: [f"_auth=\x01{m.basic()}\x02"], lambda: [f"//{m.host()}/:_authToken={strong}"], lambda: [f"cookie: sid=\x01{m.jwt()}\x02; Path=/{m.fn()}"], lambda: [f"Set-Cookie: session=\x01{m.jwt()}\x02; HttpOnly"],
        lambda: [f"curl -u {m.user()}:{secret_pw} https://{m.host()}/{m.fn()}"], lambda: [f"docker login {m.host()} -u {m.user()} --password {secret_pw}"], lambda: [f"docker login -u {m.user()} -p {secret_pw} {m.host()}"], lambda: [f"sshpass -p {secret_pw} {m.of('ssh', 'scp')} {m.path()} build@{m.host()}:"], lambda: [f"mysql -u {m.user()} -p'{secret_pw}' -h {m.host()} {m.fn()}"], lambda: [f'psql "host={m.host()} user={m.user()} password={secret_pw} dbname={m.fn()}"'], lambda: [f"requirepass {x}"], lambda: [f"machine {m.host()} login {m.user()} password {secret_pw}"], lambda: [f"{m.host()}:{m.of('5432', '3306', '6543')}:{m.fn()}:{m.user()}:{secret_pw}"],
        lambda: [f"Server={m.host()};Database={m.fn()};User Id={m.user()};Password={secret_pw};Pooling=true"], lambda: [f"AccountName={m.fn()};AccountKey=\x01{m.b64(64)}\x02;Suffix={m.host()}"], lambda: [f"https://{m.host()}/{m.fn()}?sv={m.n()}&sig=\x01{m.b64(32).replace('=', '%3D')}\x02"], lambda: [f"https://{m.host()}/{m.fn()}?page={m.n()}&{m.of('api_key', 'key', 'token', 'access_token')}=\x01{m.hex(32)}\x02&x={m.n()}"],
    ]
    urls = [lambda: [m.url(secret_pw)], lambda: [f"dsn: {m.url(x)}"], lambda: [f"{m.const()}={m.url(secret_pw)}"], lambda: [f"git clone {m.url(secret_pw)}"], lambda: [f"{m.fn()} {m.of('opens', 'connects to', 'uses', 'reads from')} {m.url(x)}"], lambda: [f'    {m.w()} = {m.fn()}("{m.url(secret_pw)}")']]
    prose = [lambda: [_told(m, _quote(m, x))], lambda: [_told(m, _quote(m, secret_pw))], lambda: [_told(m, _quote(m, f"\x01{m.wordy()}\x02"))]]
    multi = [
        lambda: [f"{name} = \\", f'    "{x}"'], lambda: [f"{name}: >-", f"  {x}"], lambda: [f"{m.of('Password', 'Passphrase', 'Enter password', 'Token')} {m.of('for', 'of')} {m.fn()}:", x], lambda: [f"- name: {m.name().upper()}", f"  value: {x}"], lambda: [f'  "{name}":', f'    "{x}"'], lambda: [f"cat {m.path()}", strong], lambda: [f"echo ${m.const()}", strong], lambda: ["apiVersion: v1", "kind: Secret", "data:", f"  {m.fn()}: \x01{base64.b64encode(m.pw().encode()).decode()}\x02"], lambda: ["apiVersion: v1", "kind: Secret", "data:", f"  {m.fn()}: \x01{m.b64(24)}\x02"], lambda: [f"{name} =", f'  "{x}"'],
        lambda: [f"\x01{head}\x02", *body, head.replace("BEGIN", "END")], lambda: [f"{m.const()}=\x01{head}\x02", *body, head.replace("BEGIN", "END")], lambda: [f'{m.const()}="\x01{head}\x02\\n' + "\\n".join(body) + '\\n"'],
    ]
    lines = r.choice(r.choice([named, named, named, bare, bare, tools, tools, urls, prose, prose, prose, multi, multi]))()
    if r.random() < 0.12 and len(lines) == 1:
        lines = [f"{m.sentence()} {lines[0]} {m.sentence()}"] if r.random() < 0.5 else [f"{m.sentence()} {lines[0]}"]
    return _listed(m, lines)


def _listed(m: Maker, lines: list[str]) -> list[str]:
    """The lines as a list, a diff or a listing shows them."""
    style = m.r.random()
    if style < 0.18 and len(lines) == 1:
        return [f"{m.of('-', '*')} {lines[0]}"]
    if style < 0.28:
        return [f"{m.of('+', '-')}    {x}" for x in lines]
    if style < 0.36:
        return [f"  {m.r.randint(1, 40)}  {x}" for x in lines]
    return lines


def negatives(m: Maker) -> list[str]:
    """One made-up place without a secret."""
    r, name = m.r, m.name()
    public = r.choice(["PUBLIC KEY", "CERTIFICATE", "CERTIFICATE REQUEST"])
    key = r.choice(["RSA ", "EC ", ""])
    noun = m.of("password", "passphrase", "secret", "login", "access key", "key", "token", "pin", "api key", "credential", "Passwort", "mot de passe", "clave")
    hidden = [
        lambda: [f"{name}={MARK}"], lambda: [f'{name} = "{MARK}"'], lambda: [f"{name}: {MARK}"], lambda: [f"{m.w()} {name}={MARK} {m.w()} {m.host()}"], lambda: [f"{name}: ********"], lambda: [f"{name}: ${{{m.name().upper()}}}"], lambda: [f"{name}=$({m.fn()})"], lambda: [f"{name}: <your key for {m.host()}>"], lambda: [f"{name} = {r.choice(['xxxxxxxx', 'changeme', 'null', 'None', 'TODO', '...', '${' + m.const() + '}'])}"],
        lambda: [f"{m.w()} = {m.of('TokenAuth', 'Basic', 'login')}(settings.{m.name().upper()})"], lambda: [f'{name} = {m.of("load_secret", "get_secret", "read_key", "vault.get")}("{m.fn()}", {m.n()})'], lambda: [f'{name} = os.environ["{m.const()}"]'], lambda: [f'{name} = os.environ.get("{m.name().upper()}", "")'], lambda: [f"vault read {m.w()}/{m.w()}/{m.fn()}/api_key"], lambda: [f"{name} = {m.of('config', 'settings', 'self', 'cfg')}.{m.w()}.{m.name()}"], lambda: [f"{m.of('NEXT_PUBLIC', 'PUBLIC', 'VITE')}_{m.w().upper()}_TOKEN={m.w()}-{m.n()}"], lambda: [f"max_tokens: {m.n()}"],
        lambda: [m.url(MARK)], lambda: [f"dsn: {m.url(MARK)}"], lambda: [_told(m, _quote(m, MARK))], lambda: [f"{m.of('Password', 'Token')} for {m.fn()}:", MARK], lambda: [f"{name}: >-", f"  {MARK}"], lambda: [f"{name} = \\", f'    "{MARK}"'], lambda: [f"-----BEGIN {key}PRIVATE KEY-----", MARK, f"-----END {key}PRIVATE KEY-----"], lambda: ["apiVersion: v1", "kind: Secret", "data:", f"  {m.fn()}: {MARK}"], lambda: [f"<{name}>{MARK}</{name}>"], lambda: [f"Authorization: Bearer {MARK}"],
    ]
    spoken = [
        lambda: [f"The {noun} {m.of('policy', 'field', 'form', 'rotation', 'budget')} {m.of('asks for', 'takes', 'needs')} {m.n()} {m.of('days', 'rows', 'ms', 'characters')}{m.end()}"], lambda: [f"The {noun} {m.of('for', 'of', 'on')} {m.place()} {m.of('is kept in', 'is stored in', 'comes from', 'lives in', 'is read from')} {m.path()}{m.end()}"], lambda: [f"The {noun} {m.of('for', 'of')} {m.place()} {m.of('expired', 'was rotated', 'is gone', 'is missing', 'is wrong', 'is broken')}{m.end()}"], lambda: [f"{m.of('Ask', 'Mail')} {m.of('the owner', 'support', m.w())} for the {noun} {m.of('of', 'for')} {m.place()}{m.end()}"],
        lambda: [f"The {noun} on {m.place()} is {m.of('still', 'now')} {m.of('broken', 'locked', 'empty', 'disabled')} {m.of('for', 'in')} {m.place()}{m.end()}"], lambda: [f"{m.place()} {m.of('rejected', 'refused', 'reset')} the {noun} after {m.n()} {m.of('tries', 'ms')}{m.end()}"], lambda: [f"{m.of('The', 'A')} {m.w()} {noun} {m.of('of', 'for', 'in')} `{m.fn()}` {m.of('is used', 'was gone', 'is checked')} {m.of('by', 'in', 'before')} {m.fn()}{m.end()}"], lambda: [f"postgres://{m.host()}:5432/{m.fn()}  # {noun} {m.of('comes from', 'is in')} the {m.w()}"],
    ]
    digests = [
        lambda: [f'etag: "{m.hex(32)}"'], lambda: [f'integrity="sha512-{m.b64(64)}"'], lambda: [f"commit {m.hex(40)}"], lambda: [f"sha256:{m.hex(64)}  {m.path()}"], lambda: [f"request{m.of(' ', '_', '-')}id{m.of(' ', '=', ': ')}{m.hex(8)}-{m.hex(4)}-{m.hex(4)}-{m.hex(4)}-{m.hex(12)} took {m.n()} ms"], lambda: [f"ssh-{r.choice(['ed25519', 'rsa'])} AAAA{m.b64(r.choice([51, 54, 60]))} build@{m.host()}"], lambda: [f"{m.clock()} DEBUG {m.fn()} {m.of('lease', 'run', 'job', 'rev', 'id')}={m.hex(8)} owner={m.host()} {m.w()}={m.n()}"], lambda: [f"{m.clock()} ERROR {m.path()}:{m.n()} KeyError: {m.w()} {m.hex(8)} is {m.of('stale', 'missing')}"], lambda: [f"{m.fn()} | {m.n()} | {m.of('KeyError', f'{m.n()} ms', 'ok')} | {m.hex(8)}"],
        lambda: [f"docker pull {m.host()}/{m.fn()}@sha256:{m.hex(64)}"], lambda: [f"{m.of('md5', 'checksum', 'digest', 'revision', 'fingerprint', 'sha1')}{m.of(': ', '=', ' ')}{m.hex(r.choice([32, 40, 64]))}"], lambda: [f"Reverted {m.of('commit ', '')}{m.hex(8)} because `{m.fn()}` lost {m.n()} rows"], lambda: [f"git checkout {m.hex(40)}"], lambda: [f"trace {m.hex(32)} span {m.hex(16)}"],
        lambda: [f"# TODO(CANARY-{m.hex(4).upper()}-{m.w().upper()}): {m.w()} {m.w()}"], lambda: [f"{m.name().upper()}=CANARY-{m.hex(4).upper()}-{m.w().upper()}-{m.hex(16)}"], lambda: [f'{m.const()} = "CANARY-{m.hex(4).upper()}-{m.w().upper()}"'], lambda: [f"{m.sentence()} CANARY-{m.hex(4).upper()}-{m.w().upper()}-{m.hex(16)} in {m.path()}"],
        lambda: [f"-----BEGIN {public}-----", m.b64(48), m.b64(48), f"-----END {public}-----"],
    ]
    code = [
        lambda: [f"{m.const()}={m.of(m.n(), m.path(), m.w(), f'https://{m.host()}/{m.fn()}')}"], lambda: [f"{m.fn()}: {m.of(m.n(), m.w(), m.fn())}"], lambda: [f'{m.const()} = os.environ.get("{m.const()}", "{m.n()}")'], lambda: [f"from {m.fn()} import {m.fn()}, {m.fn()}"], lambda: [f'{m.fn()} = {m.fn()}({m.w()}={m.n()}, {m.w()}="{m.w()}")'], lambda: [f"return {m.fn()}[:{m.n()}]"], lambda: [f"def {m.fn()}({m.fn()}, {m.w()}={m.n()}):"], lambda: [f'with open("{m.path()}") as fh: {m.fn()}(fh, {m.n()})'], lambda: [f'log.{m.of("warning", "info")}("{m.w()} {m.w()} %s after {m.n()} ms", {m.fn()})'], lambda: [f"{m.fn()}({m.const()}, {m.n()})"], lambda: [f"import {m.fn()}"], lambda: [f"{m.of('yield', 'return', 'await')} {m.fn()}({m.w()}, {m.const()})"], lambda: [f"for {m.w()} in {m.fn()}({m.const()}, {m.n()}):"],
        lambda: [f"SELECT {m.fn()}, count(*) FROM {m.fn()} WHERE {m.fn()} > {m.n()} GROUP BY 1;"], lambda: [f'assert {m.fn()}({m.n()}) == {m.n()}, "{m.w()} in {m.path()}"'], lambda: [f'if {m.fn()} > {m.n()}: raise KeyError("{m.w()} is {m.w()} at {m.n()}")'], lambda: [f"{m.path()}::test_{m.fn()}{m.of('', f'[{m.n()}-{m.w()}]')} {m.of('PASSED', 'FAILED (KeyError)')}"], lambda: [f"-rw-r--r-- 1 {m.user()} {m.user()} {m.n()} {m.clock()} {m.of(m.path(), m.fn())}"], lambda: [f"{m.path()}:{m.n()}:    {m.fn()}({m.const()}, {m.n()})"], lambda: [f"{m.clock()} {m.of('WARN', 'INFO', 'DEBUG')}  {m.host()} {m.fn()}: {m.w()} {m.n()} after {m.n()} ms (KeyError)"], lambda: [f'192.0.2.{m.n(250)} - - [{m.clock()}] "GET /{m.fn()}?page={m.n()} HTTP/1.1" 200 {m.n()}'], lambda: [f"@@ -{m.n()},7 +{m.n()},9 @@ def {m.fn()}("], lambda: [f"{m.of('---', '+++')} {m.of('a', 'b')}/{m.path()}"],
        lambda: [f"# {m.w()} {m.w()}, see {m.branch()}"], lambda: [f"| {m.fn()} | {m.n()} {m.w()}s | {m.n()} ms |"], lambda: [f"| {m.of('key', 'name', 'token')} | {m.w()} | {m.w()} |", "|---|---|---|"], lambda: [f"E   KeyError: expected {m.n()}, got {m.n()} in {m.fn()}"], lambda: [f"cat {m.path()}", r.choice([m.n(), m.fn(), f"{m.fn()}: {m.n()}", f"return {m.fn()}[:{m.n()}]", m.path()])], lambda: [f"echo ${m.const()}", r.choice([m.n(), m.path(), m.w(), m.fn()])], lambda: ["apiVersion: v1", "kind: ConfigMap", "data:", f"  {m.fn()}: {m.of(m.n(), m.w())}"], lambda: [f"- name: {m.const()}", f"  value: {m.of(m.n(), m.w())}"], lambda: [m.fn()], lambda: [m.path()], lambda: [f"https://{m.host()}/{m.fn()}?page={m.n()}&x={m.n()}"], lambda: [f"curl https://{m.host()}/{m.fn()}"], lambda: [f"{m.clock()} INFO {m.fn()} {m.w()}={m.n()} {m.w()}={m.n()}"], lambda: [f"{m.clock()} DEBUG {m.fn()} {m.of('with', 'via', 'got', 'using')} {m.fn()}"], lambda: [f"{m.fn()} {m.of('returned', 'got', 'shows', 'logged')} {m.of(m.n() + ' rows', m.fn(), m.path())}"],
        lambda: [f"{m.w().upper()}_TOKEN_BUCKET_{m.of('TTL', 'SIZE')} = {m.n()}"], lambda: [f"{r.choice(_LOOKALIKES)}: {m.of(m.n(), m.w(), m.fn())}"], lambda: [f"{r.choice(_LOOKALIKES)} = {m.fn()}({m.n()})"],
    ]
    thing = m.of(f"`{m.fn()}`", f"`{m.fn()}`", m.fn(), m.path(), m.w(), f'"{m.fn()}"', m.const())
    contrast = [
        lambda: [_told(m, thing, _OTHERS)], lambda: [_told(m, thing, _OTHERS)], lambda: [_told(m, thing, _OTHERS)], lambda: [f"{m.sentence()} {_told(m, thing, _OTHERS)}"], lambda: [_shown(m, m.fn())], lambda: [f"{m.place()} {m.of('looks odd', 'is fine', 'is right', 'fails', 'comes first')}: {thing} {m.of('expects', 'needs', 'returns', 'holds', 'starts with')} {m.of(m.n(), m.fn(), m.w())}{m.end()}"], lambda: [f"{m.of('Write', 'Build', 'Run', 'Start', 'Do')} it {m.of('with', 'as', 'before', 'while', 'through')} {thing}{m.of('.', f' {m.of("holds", "runs", "waits for")} {m.place()}.')}"],
        lambda: [f"{m.sentence().rstrip('.:')} {m.of('with', 'as', 'to', 'by', 'without', 'from', 'into', 'than', 'like', 'of')} {thing}{m.of('.', '?', ',', ' then.', ' and ' + m.w() + '.', ' in ' + m.path() + '.')}"], lambda: [f"{thing} {m.of('in', 'of', 'from')} {m.path()} {m.of('now', 'still', 'only')} {m.of('returns', 'reads', 'drops')} {m.n()} {m.w()}s{m.end()}"], lambda: [f'raise {m.camel()}("{m.w()} is {m.w()} at {m.n()}")'], lambda: [f"{m.path()}:{m.n()} {m.camel()}: {m.w()} {m.w()} ({m.camel()})"],
        lambda: [f"{m.w()} = {thing}"], lambda: [f'{m.fn()} = "{m.fn()}"'], lambda: [f"{m.w()}: {thing}"], lambda: [f'{m.w()} = {m.of("load", "get", "read", "open")}_{m.of("secret", "token", "key", "config")}("{m.fn()}", {m.n()})'],
    ]
    lines = r.choice(r.choice([hidden, spoken, spoken, digests, digests, code, code, code, contrast, contrast, contrast, [lambda: [m.sentence()]], [lambda: [" ".join([*r.choice(spoken)(), m.sentence(), *r.choice(contrast[:7])()])]], [lambda: [" ".join([m.sentence(), *r.choice(contrast[:7])(), *r.choice(contrast[:7])()])]]]))()
    return _listed(m, lines)


def examples(rng: random.Random, count: int) -> Iterator[tuple[list[str], list[tuple[int, int, int]]]]:
    """Made-up texts of a few lines and the spans (line, start, end) of their secrets."""
    m = Maker(rng)
    for _ in range(count):
        lines = positives(m) if rng.random() < 0.45 else negatives(m)
        if rng.random() < 0.3:
            lines = [*negatives(m), *lines]
        elif rng.random() < 0.2:
            lines = [rng.choice([f"cat {m.path()}", "```"]), *lines]
        out, spans = [], []
        for n, line in enumerate(lines):
            if "\x01" in line:
                a = line.index("\x01")
                b = line.index("\x02") - 1
                line = line.replace("\x01", "").replace("\x02", "")
                spans.append((n, a, b))
            out.append(line)
        yield out, spans
