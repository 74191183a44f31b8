"""Which lines the field labels without a secret: computed for many at once, not guessed.

The scores that the field gives to the tokens of many lines are summed up in numpy, from
tables of its weights. A line is ruled out only if every sequence of labels with a secret
scores below the one without, by more than rounding could change. The other lines are
labelled one by one (``credentials.label``), so the result is that of labelling every line.
Lines with a password in a URL are never ruled out.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

from noteglass.llm import credentials as c
from noteglass.llm import crf

SURE = 1e-6  # more than sums in another order can differ
PART = 500_000  # characters that are summed up at once
LONG = 256  # tokens; longer lines go by the bound alone
KEEP = 200_000  # tokens, and lines ruled out, that are remembered
STATES = ("", "open_secret", "named", "kube", "shell", "pem_gone")
TOLD, NEAR = ("none", "plain", "const", "digest", "secret", "public"), ("=", "~", "far")
NEWLINE, SPACE, PUNCT, SOLID = range(4)
COLUMNS = 9
FORMS = re.compile(r"(?P<snake>[a-z]+(?:_[a-z]+)+(?P<count>_[0-9]+)?)|(?P<path>[a-z]+(?:/[a-z0-9_]+)+\.[a-z]{1,4})|(?P<CONST>[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)|(?P<host>[a-z]+-[0-9]+(?:\.[a-z]+)*\.(?:test|internal|invalid|example|com|org|net|local))|(?P<slashes>[a-z]+(?:/[a-z0-9_]+)+)|(?P<hex8>(?=[a-f]*[0-9])[0-9a-f]{6,8})|(?P<time>[0-9]+(?:[:.][0-9]+)+)")
DIGIT, ZEROS = re.compile(r"\d"), re.compile(r"[0-46-9]+")
SMOOTH = {"num", "time", "snake", "snake_words", "host"}  # forms without a change from letters to digits or capitals
BARE = {"word", "Cap", "UPPER"}  # forms that ``credentials.tag`` gives as they are, and those it takes for words
PLAIN = BARE | {"CONST", "snake_words", "host", "kebab"}
CHANGES = re.compile(r"(?<=[A-Za-z])(?=\d)|(?<=\d)(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])")
TIMES_LOG = [0.0, *(k * math.log2(k) for k in range(1, 513))]
NEIGHBOUR = re.compile(r"[pf]\d:")
#: In lower case, one of them is in any ASCII name that the patterns of ``credentials.name_kind`` match.
LITERALS = tuple("pass pwd secret token key signing credential auth bearer salt hmac pin kennwort contrase clave cle session sid sig jwt cookie etag integrity sha commit digest checksum lease request hash revision md5 fingerprint id uuid version ttl public vite react".split())
RAW = re.compile(r"\n|[^\S\n]+|" + c.LEX.pattern)


class Tokens(dict):
    """Numbers of tokens, and what the tables need to know of each."""

    def __init__(self, owner: Sieve):
        super().__init__()
        self.owner, self.rows, self.own = owner, array("i"), array("d")
        self.columns, self.weights = np.zeros((0, COLUMNS), dtype=np.int32), np.zeros(0, dtype=complex)

    def __missing__(self, raw: str) -> int:
        self[raw] = n = len(self)
        row, own = self.owner.token(raw)
        self.rows.extend(row)
        self.own.extend((own.real, own.imag))
        return n

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        if self.own:
            self.columns = np.concatenate([self.columns, np.array(self.rows, dtype=np.int32).reshape(-1, COLUMNS)])
            self.weights = np.concatenate([self.weights, np.array(self.own).view(complex)])
            self.rows, self.own = array("i"), array("d")
        return self.columns, self.weights


def quick(text: str) -> str | None:
    """As ``credentials.shape``, of the most frequent forms that it tells by one pattern; None of others."""
    if text.isdigit():
        return "num"
    m = FORMS.fullmatch(text)
    if not m or c.VENDOR.match(text) or text[:4] in ("CANA", "AAAA") or not text.strip("xX_"):
        return None
    form = m.lastgroup
    if form == "snake":
        return "snake" if m["count"] else "snake_words"
    if form == "slashes":
        if len(text) < 16 or not DIGIT.search(text):
            return "slashes"
        told = entropy(text)
        return None if abs(told - 3.6) < SURE else "blob" if told > 3.6 else "slashes"
    return form


def entropy(text: str) -> float:
    """As ``credentials.bits``, but for rounding; of at most 512 characters."""
    n = len(text)
    return math.log2(n) - sum([TIMES_LOG[text.count(x)] for x in set(text)]) / n


@lru_cache(maxsize=2)
def literals(words: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for x in words:
        found.add_word(x, x)
    found.make_automaton()
    return found


def told(name: str) -> str:
    """As ``credentials.name_kind``. Its patterns tell no digit from another but 5, and no run of them from one."""
    if not name.isascii():
        return c.name_kind(name)
    if next(literals(LITERALS).iter(name.lower()), None):
        return c.name_kind(ZEROS.sub("0", name) if DIGIT.search(name) else name)
    return "const" if name.isupper() else "plain"


class Sieve:
    """Tables of a field. Weights are complex: start of a secret (real) and its rest (imaginary), both less those of no secret."""

    def __init__(self, field: crf.Model):
        self.field, weights = field, field.weights
        last = {f.rpartition(":")[2] for f in weights if re.match(r"(?:s|l|b|1|u|first|k:.*|[pf]\d:.*):", f)}
        self.shapes = {s: k for k, s in enumerate(["", *sorted(last)])}
        self.chars = {x: k for k, x in enumerate(["", *sorted({x for f in weights if f[:2] in ("l:", "x:", "q:") for x in f[2:4]} | set("^$."))])}
        self.words = {w: k for k, w in enumerate(["", *sorted({f[3:].split(":")[0] for f in weights if NEIGHBOUR.match(f)})])}
        self.names = {w: k for k, w in enumerate(["", *sorted({re.sub(r"(?:=|~|far)\Z", "", f[3:]) for f in weights if f.startswith("kn:")})])}
        get = lambda f: self.gain(f) if f in weights else 0
        shapes, chars = list(self.shapes), list(self.chars)
        table = lambda rows: np.array(rows, dtype=complex)
        self.left = table([[get(f"l:{x}:{s}") for s in shapes] for x in chars])
        self.edges = table([[get(f"x:{y}") + get(f"q:{x}{y}") for y in chars] for x in chars])
        self.kinds = table([[[get(f"k:{t}{near}") + get(f"k:{t}{near}:{s}") for s in shapes] for near in NEAR] for t in TOLD])
        self.named = table([[get(f"kn:{w}{near}") if w else 0 for near in NEAR] for w in self.names])
        self.state = table([[[[get(f"b:{b}:{s}") + get(f"1:{single}:{b}:{s}") + (get(f"first:{s}") if first else 0) for s in shapes] for first in (False, True)] for single in (False, True)] for b in STATES])
        self.near = {kind: np.zeros((len(self.words), len(shapes)), dtype=complex) for kind in ("p0", "p1", "p2", "f0", "f1")}
        for f in weights:
            if NEIGHBOUR.match(f):
                kind, word, *s = f.split(":")
                self.near[kind][self.words[word], self.shapes[s[0]] if s else slice(None)] += get(f)
        self.cue = {x: table([get(f"u:{x}:{s}") for s in shapes]) for x in c.CUES}
        self.forms: dict[tuple, complex] = {}
        self.plain: set[tuple[str, str]] = set()
        self.fresh()
        oo = field.moves[0][0]
        self.moves = [[x - oo for x in row] for row in field.moves]

    def fresh(self) -> None:
        self.tokens, self.cues, self.sums = Tokens(self), {frozenset(): 0}, [np.zeros(len(self.shapes), dtype=complex)]

    def gain(self, *features: str) -> complex:
        o, b, i = self.field.emission(features)
        return complex(b - o, i - o)

    def token(self, raw: str) -> tuple[tuple[int, ...], complex]:
        """(kind, shape, is a word, gives a value, word before, word after, kind of name, name, first and last character as one number), own weight."""
        if raw == "\n":
            return (NEWLINE, 0, 0, 0, 0, 0, 0, 0, self.ends("$", "^", False)), 0j
        if raw.isspace():
            return (SPACE, 0, 0, 0, 0, 0, 0, 0, self.ends(raw[0], raw[-1], False)), 0j
        text = raw
        while len(text) > 1 and text[-1] == "." and not text.endswith("..."):
            text = text[:-1]
        ends, n = self.ends(raw[0], raw[-1], text != raw), len(text)
        s = quick(text) if n <= 512 else None
        own = None
        if s:
            h = changes = -1
            if n >= 8:
                h = 2 * entropy(text)
                changes = 0 if s in SMOOTH else min(len(CHANGES.findall(text)), 6)
            if n < 8 or abs(h % 1 - 0.5) > SURE:
                form = (s, min(n // 4, 16), round(h), changes)
                own = self.forms.get(form)
                if own is None:
                    own = self.forms[form] = self.gain(f"s:{s}", f"n:{form[1]}", "r:", *((f"h:{form[2]}", f"c:{changes}") if n >= 8 else ()))
                if s == "snake_words" and n < 24:
                    own += self.gain(f"w:{text}")
        else:
            s = c.shape(text)
            if s.startswith("punct"):
                return (PUNCT, 0, 0, int(text in "=:|"), 0, 0, 0, 0, ends), 0j
        if own is None:
            own = self.gain(*c.own_features(text, ""))
        if not c.WORDISH.search(text):
            return (SOLID, self.shapes.get(s, 0), 0, int(text == ":="), 0, 0, 0, 0, ends), own
        if s in BARE:
            word, plain = text.lower(), True
        else:
            word, plain = s, s in PLAIN
        after = self.words.get(word, 0)
        return (SOLID, self.shapes.get(s, 0), 1, 0, after if plain else 0, after, TOLD.index(told(text)), self.names.get(text.lower()[:24], 0), ends), own

    def ends(self, first: str, last: str, dot: bool) -> int:
        return (self.chars.get(first, 0) << 12 | self.chars.get(last, 0)) << 1 | dot

    def likely(self, lines: Iterable[tuple[str, str]]) -> set[tuple[str, str]]:
        """Those of the lines (text, what comes before) that can't be ruled out."""
        out, part, size = set(), [], 0
        if len(self.plain) > KEEP:
            self.plain.clear()
        for item in set(lines) - self.plain:
            if "@" in item[0] and c.URL.search(item[0]):
                out.add(item)
                continue
            part.append(item)
            size += len(item[0])
            if size >= PART:
                out.update(self._likely(part))
                part, size = [], 0
        if part:
            out.update(self._likely(part))
        return out

    def gains(self, lines: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        """Weights of all tokens that aren't punctuation, and the number of each one's line."""
        if len(self.tokens) > KEEP or len(self.sums) > 5000:
            self.fresh()
        # a line feed before, between and after
        raw = RAW.findall("\n" + "\n".join(x for x, _ in lines) + "\n")
        ids = np.array(list(map(self.tokens.__getitem__, raw)), dtype=np.int32)
        columns, weights = self.tokens.tables()
        cells = columns[ids]
        ends = cells[:, 8]
        left, right = np.zeros_like(ends), np.zeros_like(ends)
        left[1:] = ends[:-1] >> 1 & 4095
        right[:-1] = ends[1:] >> 13
        right = np.where(ends & 1, self.chars["."], right)
        lexed = np.flatnonzero(cells[:, 0] != SPACE)
        cells, ids, left, right = cells[lexed], ids[lexed], left[lexed], right[lexed]
        kind, word = cells[:, 0], cells[:, 2] == 1
        at = np.arange(len(kind))
        line = np.cumsum(kind == NEWLINE) - 1
        k = np.flatnonzero(kind == SOLID)
        if not len(k):
            return np.zeros(0, dtype=complex), line[k]
        mine, s = line[k], cells[k, 1]
        # the name: the last word before, on the same line
        before = np.maximum.accumulate(np.where(word | (kind == NEWLINE), at, 0))[k - 1]
        has, values = word[before], np.cumsum(cells[:, 3])
        distance = np.where(has, k - before - 1, 99)
        near = np.where((values[k - 1] > values[before]) & (distance <= 2), 0, np.where(distance <= 3, 1, 2))
        first = np.ones(len(k), dtype=bool)
        first[1:] = mine[1:] != mine[:-1]
        starts = np.flatnonzero(first)
        count = np.diff(np.append(starts, len(k)))
        total = weights[ids[k]] + self.left[left[k], s] + self.edges[left[k], right[k]]
        total += self.kinds[cells[before, 6], near, s] + self.named[cells[before, 7], near]
        single = np.repeat(count == 1, count).astype(np.intp)
        total += self.state[np.array([STATES.index(b) for _, b in lines])[mine], single, first.astype(np.intp), s]
        # neighbours
        places = np.flatnonzero(word)
        where = np.concatenate([[-1] * 3, line[places], [-1] * 3])
        passed = np.cumsum(word)[k] + 3  # words up to this token
        own = word[k]
        for column, steps in ((4, [("p0", -1), ("p1", -2), ("p2", -3)]), (5, [("f0", 0), ("f1", 1)])):
            words = np.concatenate([[0] * 3, cells[places, column], [0] * 3])
            for name, step in steps:
                pos = passed + step - (own if step < 0 else 0)
                total += self.near[name][np.where(where[pos] == mine, words[pos], 0), s]
        cues = np.array([self.cued(text) for text, _ in lines])[mine]
        total += np.array(self.sums)[cues, s]
        return total, mine

    def _likely(self, lines: list[tuple[str, str]]) -> set[tuple[str, str]]:
        found = set(self._open(lines))
        self.plain.update([x for x in lines if len(x[0]) <= 1000 and x not in found])
        return found

    def _open(self, lines: list[tuple[str, str]]) -> list[tuple[str, str]]:
        total, mine = self.gains(lines)
        if not len(mine):
            return []
        starts = np.flatnonzero(np.diff(mine, prepend=-1))
        count = np.diff(np.append(starts, len(mine)))
        (_, ob, _), (bo, bb, bi), (io, ib, ii) = self.moves
        # what no order of labels can exceed: the best start, and all that may follow
        leave = max(0.0, bo, io)
        rest = np.maximum(total.real + max(bb, ib, ob), total.imag + max(bi, ii)) + leave
        bound = np.maximum.reduceat(total.real, starts) + max(ob, self.field.start) + leave + np.add.reduceat(np.maximum(rest, 0.0), starts)
        open_ = bound > -SURE
        out = [lines[n] for n in mine[starts[open_ & (count > LONG)]]]
        # the exact gain of the best labels with a secret, token by token of all lines at once, the longest first
        open_ = np.flatnonzero(open_ & (count <= LONG))
        open_ = open_[np.argsort(-count[open_], kind="stable")]
        starts, count = starts[open_], count[open_]
        if not len(open_):
            return out
        b = total.real[starts] + self.field.start
        i, o = np.full(len(b), -1e9), np.full(len(b), -1e9)  # o: after a secret
        best = np.full(len(b), -1e9)
        for k in range(1, count[0] + 1):
            n = int(np.searchsorted(-count, -k, side="left"))  # lines of more than k tokens
            best[n : len(b)] = np.maximum(np.maximum(o[n:], b[n:]), i[n:])
            if not n:
                break
            o, b, i = o[:n], b[:n], i[:n]
            e = total[starts[:n] + k]
            o, b, i = (
                np.maximum(np.maximum(o, b + bo), i + io),
                e.real + np.maximum(np.maximum(np.maximum(o, 0.0) + ob, b + bb), i + ib),
                e.imag + np.maximum(b + bi, i + ii),
            )
        return out + [lines[n] for n in mine[starts[best > -SURE]]]

    def cued(self, text: str) -> int:
        """Number of the set of cues in a line."""
        found = frozenset([x for _, x in literals(tuple(c.CUES)).iter(text.lower())])
        n = self.cues.get(found)
        if n is None:
            n = self.cues[found] = len(self.sums)
            self.sums.append(sum(self.cue[x] for x in found))
        return n


@lru_cache(maxsize=2)
def sieve(field: crf.Model) -> Sieve:
    return Sieve(field)
